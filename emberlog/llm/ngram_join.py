"""N-gram Jaccard join by grouped prefixes.

A document's set of word shingles is reduced to a prefix: the first
``n - ceil(t n) + 1`` shingles in one global order, in which two sets of similarity
``t`` or more must share an element. The order puts rare shingles first: by the
frequencies of their words, taken from a sketch of fixed size (see
:func:`word_weights`), and last those shingles that many documents have (see
:func:`frequent`). The order affects how many candidates there are, never a result.

1. Equal sets are one node; nodes with the same prefix and size are one group.
2. Groups that share a prefix shingle meet in a bucket. Shingles with the same
   posting list make one bucket, and groups without another of a fitting size in
   their bucket leave it.
3. Group pairs are filtered by size and by how many prefix shingles they share.
   What the surviving pairs connect is a family of groups.
4. Groups are expanded to their nodes, and nodes are verified on whole sets,
   recomputed from whole texts. A family of one block is verified there. In a larger
   one each block and a pivot are; where that leaves unconnected parts, the pairs of
   nodes that pass the filter of step 3 and lie in different parts are verified,
   each in the bucket of its smallest common prefix shingle (:func:`_completed`).

Only connectivity is needed, so no step emits all pairs of a bucket. A bucket is
cut into blocks (:func:`_first_round`): each block links its members among themselves
and to the bucket's pivot; a member that is then not connected to the bucket's main
component, and only such a member, meets the other blocks (:func:`_second_round`).
Blocks are bounded by members and by elements, so long texts make smaller blocks.

A null or empty text has no shingles and is linked with nothing. Rows are told
apart by their sets, so repeated rows and repeated ids are copies of one node; a
null id never names a component if another member has an id. Texts are looked up
by id and a hash of the text, so many texts under one id (or none) make no pairs.
Very long texts are taken whole. Other columns are not read. An empty table gives
an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm import shingles
from emberlog.llm.common import materialize, small_batches, trim, utf8_view
from emberlog.llm.components import components

#: Shingles whose documents are counted together, for finding frequent ones.
COUNTED_TOGETHER = 500_000
#: A shingle that this share of all documents has is found frequent for sure; its
#: count then only places it in the order and never affects a result.
FREQUENT_SHARE = 0.0005
#: Most frequent shingles that are broadcast, 16 bytes each.
MAX_FREQUENT = 1 << 18
#: Members of a block, and elements of all their sets (but for one set alone).
BLOCK = 256
BLOCK_ELEMENTS = 1_000_000
#: Sets that a task remembers in order not to write their prefixes again.
REMEMBERED = 50_000


def _prefix_length(n: int, num: int, den: int) -> int:
    return n + (-num * n // den) + 1


def _scan(docs: DataFrame, width: int) -> DataFrame:
    """Per row its id, key, set size and set digest; per stretch of rows also the frequent
    shingles and their counts; per task a sketch of its word counts."""

    def run(batches):
        held: dict[bytes, np.ndarray] = {}
        size = 0

        def frequent():
            if not held:
                return
            every = np.concatenate(list(held.values()))
            found, count = np.unique(every, return_counts=True)
            keep = count >= max(3, FREQUENT_SHARE / 2 * len(held))
            found, count = found[keep], count[keep]
            n = len(found)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, kind), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(found.view(np.int64)), pa.array(count, pa.int64()), pa.nulls(n, pa.binary())], names)

        names, kind = ["doc", "key", "n_shingles", "node", "token", "documents", "sketch"], None
        seen = np.zeros(1 << shingles.SLOT_BITS, np.int64)
        for batch in batches:
            ids = batch.column("doc")
            kind = ids.type
            counts, nodes = [], []
            for own in shingles.sets(*utf8_view(batch.column("text")), width, seen=seen):
                counts.append(len(own))
                if not len(own):
                    nodes.append(None)
                    continue
                d = shingles.digest(own)
                nodes.append(d)
                if d not in held:
                    held[d] = own
                    size += len(own)
                    if size >= COUNTED_TOGETHER:
                        yield from frequent()
                        held.clear()
                        size = 0
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([ids, batch.column("key"), pa.array(counts, pa.int64()), pa.array(nodes, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], names)
        yield from frequent()
        if kind is not None:
            none = pa.nulls(1, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), none, none, pa.nulls(1, pa.binary()), none, none, pa.array([zlib.compress(seen.astype("<i8").tobytes(), 1)], pa.binary())], names)
        held.clear()
        trim()

    kind = docs.schema["doc"].dataType.simpleString()
    return docs.withColumn("key", F.xxhash64("text")).mapInArrow(run, f"doc {kind}, key long, n_shingles long, node binary, token long, documents long, sketch binary")


def frequent(scan: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles (sorted) and their rank, the rarest first.

    A stretch reports what half of FREQUENT_SHARE of its own documents have, so
    whatever FREQUENT_SHARE of all have is reported for half its count at least.
    """
    counts = scan.where("token is not null").groupBy("token").agg(F.sum("documents").alias("n"))
    # counts by power of two, at most 64 of them, say from where on MAX_FREQUENT shingles are kept; nothing is sorted
    powers = dict(counts.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).agg(F.count("*").alias("k")).collect())
    held, least = 0, 1 << 62
    for power in sorted(powers, reverse=True):
        held += powers[power]
        if held > MAX_FREQUENT:
            break
        least = 1 << power
    top = counts.where(F.col("n") >= least).toArrow()
    token, n = top["token"].to_numpy().view(np.uint64), top["n"].to_numpy()
    rank = np.empty(len(token), np.int64)
    rank[np.lexsort((token, n))] = np.arange(len(token))
    by = np.argsort(token)
    return token[by], rank[by]


def word_weights(scan: DataFrame) -> np.ndarray:
    """A weight from 0 to 255 for each slot of the word sketch, the logarithm of its
    share of all words. The tasks' sketches are added up 64 at a time."""

    def add(batches):
        total = np.zeros(1 << shingles.SLOT_BITS, np.int64)
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                total += np.frombuffer(zlib.decompress(blob), "<i8")
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], ["sketch"])

    left = scan.where("sketch is not null").select("sketch")
    parts = left.count()
    while parts > 1:
        parts = -(-parts // 64)
        left = materialize(left.repartition(parts).mapInArrow(add, "sketch binary"), "sketch")
    total = np.zeros(1 << shingles.SLOT_BITS, np.int64)
    for row in left.collect():  # one row of fixed size
        total += np.frombuffer(zlib.decompress(row["sketch"]), "<i8")
    share = np.maximum(total, 1) / max(1, total.sum())
    return np.clip(np.round(8 * np.log2(share * (1 << 30))), 0, 255).astype(np.uint8)


def _prefixes(docs: DataFrame, weight: np.ndarray, common: tuple[np.ndarray, np.ndarray], width: int, num: int, den: int) -> DataFrame:
    """Per distinct set (at least once): node, its group, the set size and the prefix."""
    held = docs.sparkSession.sparkContext.broadcast((weight, *common))

    def run(batches):
        weight, token, rank = held.value
        seen: set[bytes] = set()
        for batch in batches:
            nodes, groups, sizes, flat, ends = [], [], [], [], [0]
            for own, own_weight in shingles.sets(*utf8_view(batch.column("text")), width, weight):
                if not len(own) or (d := shingles.digest(own)) in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(d)
                most = _prefix_length(len(own), num, den)
                at = np.searchsorted(token, own)
                at[at == len(token)] = 0
                is_common = token[at] == own if len(token) else np.zeros(len(own), bool)
                rare = own[~is_common]
                prefix = rare[np.argsort(own_weight[~is_common], kind="stable")[:most]]  # by weight, then hash
                if len(prefix) < most:
                    rest, place = own[is_common], rank[at[is_common]]
                    prefix = np.concatenate([prefix, rest[np.argsort(place)][: most - len(prefix)]])
                nodes.append(d)
                groups.append(shingles.digest(prefix, len(own).to_bytes(8, "little")))
                sizes.append(len(own))
                flat.append(prefix)
                ends.append(ends[-1] + len(prefix))
            values = np.concatenate([np.zeros(0, np.uint64), *flat]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(groups, pa.binary()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))], ["node", "grp", "n", "prefix"])
        trim()

    return docs.select("text").mapInArrow(run, "node binary, grp binary, n long, prefix array<long>")


def _spanning(pairs: tuple[np.ndarray, np.ndarray], members: list[bytes]) -> list[tuple[bytes, bytes]]:
    """Links (member, smallest of its component) that connect what the pairs connect."""
    parent = list(range(len(members)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(pairs[0].tolist(), pairs[1].tolist()):
        rx, ry = root(x), root(y)
        if rx != ry:
            if members[rx] < members[ry]:
                parent[ry] = rx
            else:
                parent[rx] = ry
    return [(members[x], members[r]) for x in range(len(members)) if (r := root(x)) != x and members[x] != members[r]]


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections."""
    m = len(sets)
    if m == 2:
        a, b = sets if len(sets[0]) <= len(sets[1]) else sets[::-1]
        at = np.searchsorted(b, a)
        at[at == len(b)] = 0
        both = int((b[at] == a).sum()) if len(b) else 0
        return np.array([[len(sets[0]), both], [both, len(sets[1])]])
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1  # what one set alone has can't meet
    column = np.cumsum(shared) - 1
    use = shared[at]
    total = np.zeros((m, m), np.int64)
    width = int(shared.sum())
    owner, column = owner[use], column[at[use]]
    by = np.argsort(column, kind="stable")
    owner, column = owner[by], column[by]
    for low in range(0, width, 16384):
        a, z = np.searchsorted(column, [low, low + 16384])
        table = np.zeros((m, min(16384, width - low)), np.float32)
        table[owner[a:z], column[a:z] - low] = 1
        total += np.rint(table @ table.T).astype(np.int64)
    return total


def _prefixes_meet(sets: list[np.ndarray], n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Pairs whose sizes fit and whose prefixes share enough.

    Of two prefixes, the one that ends first in the order lies wholly before the
    other's end, so each of its elements that isn't shared is missing from the other
    set; more than ``n`` less the needed overlap may not be missing.
    """
    shared = _overlaps(sets)
    need = -(-num * (n[:, None] + n[None, :]) // (num + den))
    p = np.array([len(s) for s in sets])
    least = p - n
    enough = np.minimum(least[:, None], least[None, :]) + need
    return (shared >= np.maximum(1, enough)) & (den * np.minimum(n[:, None], n[None, :]) >= num * np.maximum(n[:, None], n[None, :]))


def _sets_link(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    n = np.array([len(s) for s in sets])
    both = _overlaps(sets)
    return den * both >= num * (n[:, None] + n[None, :] - both)


def _cells(rows: DataFrame, payload: str, judge) -> DataFrame:
    """Judge the pairs within each cell (bucket, block, probe): rows (a, b) as ``judge(cell)``
    returns them for the cell's rows, an Arrow table. A probe cell compares probes with all rows only.
    """

    def run(batches):
        pending: list[pa.RecordBatch] = []
        key = None

        def done():
            if not pending:
                return []
            return judge(pa.Table.from_batches(pending))

        a, b = [], []
        for batch in batches:
            bucket, block, probe = (batch.column(i) for i in range(3))
            cells = list(zip(bucket.to_pylist(), block.to_pylist(), probe.to_pylist()))
            begin = 0
            for i in range(1, len(cells) + 1):
                if i == len(cells) or cells[i] != cells[begin]:
                    if cells[begin] != key:
                        for x, y in done():
                            a.append(x)
                            b.append(y)
                        pending, key = [], cells[begin]
                    pending.append(batch.slice(begin, i - begin))
                    begin = i
            if len(a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])
                a, b = [], []
        for x, y in done():
            a.append(x)
            b.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])
        trim()

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.select(*_CELL, payload).repartition(parts, "bucket", "block", "probe").sortWithinPartitions("bucket", "block", "probe")
    return ordered.mapInArrow(run, "a binary, b binary")


_CELL = ("bucket", "block", "probe", "is_probe", "member", "label", "n")


def _blocks() -> Column:
    """How many blocks ``m`` members of ``elements`` elements make."""
    return F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("elements") / BLOCK_ELEMENTS)).cast("int")


def _sizes(rows: DataFrame) -> DataFrame:
    """Buckets of two members or more: their pivot and number of blocks."""
    held = rows.groupBy("bucket").agg(F.count("*").alias("m"), F.sum("n").alias("elements"), F.min(F.xxhash64("member")).alias("pivot")).where("m > 1")
    return materialize(held.select("bucket", "pivot", F.least(F.col("m"), _blocks()).cast("int").alias("blocks")), "sizes")


def _first_round(rows: DataFrame, sizes: DataFrame, attach: Callable[[DataFrame], DataFrame], payload: str, judge) -> DataFrame:
    """Links of the members (bucket, member, n) within their blocks; the bucket's pivot is in each of them."""
    h = F.xxhash64("member")
    first = rows.join(sizes, "bucket")
    everywhere = F.sequence(F.lit(0), F.col("blocks") - 1)
    own = F.array(F.pmod(h, F.col("blocks").cast("long")).cast("int"))
    first = first.withColumn("block", F.explode(F.when((F.col("blocks") > 1) & (h == F.col("pivot")), everywhere).otherwise(own)))
    plain = first.withColumns({"probe": F.lit(0), "is_probe": F.lit(False), "label": F.lit(None).cast("binary")}).select(*_CELL)
    return materialize(_cells(attach(plain), payload, judge), "links")


def _second_round(rows: DataFrame, attach: Callable[[DataFrame], DataFrame], payload: str, judge) -> DataFrame:
    """What ``judge`` says of the members (bucket, member, n, label) with unlike labels: those
    outside the bucket's most frequent label are probes, which meet every member of every block."""
    groups = rows.groupBy("bucket", "label").agg(F.count("*").alias("k"), F.sum("n").alias("elements"))
    all_of = groups.groupBy("bucket").agg(F.max(F.struct("k", "label"))["label"].alias("top"), F.sum("k").alias("m"), F.sum("elements").alias("elements"), F.count("*").alias("labels")).where("labels > 1")
    all_of = all_of.select("bucket", "top", _blocks().alias("blocks"))
    probes = groups.join(all_of, "bucket").where("label != top").groupBy("bucket", "top", "blocks").agg(F.sum("k").alias("m"), F.sum("elements").alias("elements"))
    main = materialize(probes.select("bucket", "top", "blocks", _blocks().alias("probes")), "main")
    h = F.xxhash64("member")
    big = rows.join(main, "bucket")
    over_probes, over_blocks = F.sequence(F.lit(0), F.col("probes") - 1), F.sequence(F.lit(0), F.col("blocks") - 1)
    base = big.withColumns({"block": F.pmod(h, F.col("blocks").cast("long")).cast("int"), "probe": F.explode(over_probes), "is_probe": F.lit(False)})
    probing = big.where("label != top").withColumns({"block": F.explode(over_blocks), "probe": F.pmod(F.shiftright(h, 20), F.col("probes").cast("long")).cast("int"), "is_probe": F.lit(True)})
    return materialize(_cells(attach(base.select(*_CELL).unionAll(probing.select(*_CELL))), payload, judge), "links")


def _labelled(rows: DataFrame, links: DataFrame) -> DataFrame:
    return rows.join(components(links), "member", "left").withColumn("label", F.coalesce("label", "member"))


def linked(rows: DataFrame, attach: Callable[[DataFrame], DataFrame], payload: str, judge) -> DataFrame:
    """Links (a, b) that connect the members (bucket, member, n) whose pairs ``judge`` accepts,
    exact up to connectivity. ``attach`` adds the payload that the judge needs."""
    sizes = _sizes(rows)
    links = _first_round(rows, sizes, attach, payload, judge)
    many = sizes.where("blocks > 1").select("bucket")
    if many.isEmpty():
        return links
    return links.unionAll(_second_round(materialize(_labelled(rows.join(many, "bucket", "left_semi"), links), "large-buckets"), attach, payload, judge))


def _open(cell: pa.Table) -> np.ndarray | bool:
    """The pairs of a cell that are asked for: all, or in a probe cell those of a probe and an unlike label."""
    probe = cell["is_probe"].to_numpy(zero_copy_only=False)
    if not probe.any():
        return True
    label = np.array(cell["label"].to_pylist(), object)
    return (probe[:, None] | probe[None, :]) & (label[:, None] != label[None, :])


def _judged(cell: pa.Table, members: list[bytes], accepted: np.ndarray) -> list[tuple[bytes, bytes]]:
    """Spanning links of the accepted pairs."""
    return _spanning(np.nonzero(np.triu(accepted & _open(cell), 1)), members)


def _arrays(lists: pa.ChunkedArray) -> list[np.ndarray]:
    flat = lists.combine_chunks()
    ends, values = flat.offsets.to_numpy(), flat.values.to_numpy()
    return [np.unique(values[a:z]) for a, z in zip(ends[:-1], ends[1:])]


def _met(sets: list[np.ndarray], pairs: np.ndarray, token: int) -> np.ndarray:
    """Members of pairs whose smallest common element is ``token``."""
    out = np.zeros(len(sets), bool)
    for x, y in zip(*(p.tolist() for p in np.nonzero(np.triu(pairs, 1)))):
        if not (out[x] and out[y]):
            a, b = (s[: np.searchsorted(s, token)] for s in (sets[x], sets[y]))
            if not np.isin(a, b, assume_unique=True).any():
                out[x] = out[y] = True
    return out


def _completed(posted: DataFrame, nodes: DataFrame, links: DataFrame, prefixes: DataFrame, num: int, den: int, with_text, set_judge) -> DataFrame:
    """Links between nodes (grp, node, n) that ``links`` leave apart: the pairs that pass the
    filter and have unlike labels, each in the bucket of its smallest common prefix shingle."""
    labelled = _labelled(nodes.withColumnRenamed("node", "member"), links)
    rows = posted.select("bucket", F.col("member").alias("grp")).join(labelled, "grp").select("bucket", "member", "n", "label")
    several = rows.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("bucket")
    rows = materialize(rows.join(several, "bucket", "left_semi"), "apart")
    if rows.isEmpty():
        return links
    whole = nodes.select(F.col("node").alias("of"), "grp").join(prefixes, "grp").select("of", "prefix")

    def with_prefix(members: DataFrame) -> DataFrame:
        return members.join(whole, members["member"] == whole["of"]).drop("of")

    def pair_filter(cell: pa.Table):
        token, members, sets = cell["bucket"][0].as_py(), cell["member"].to_pylist(), _arrays(cell["prefix"])
        met = _met(sets, _prefixes_meet(sets, cell["n"].to_numpy(), num, den) & _open(cell), token)
        return [(token.to_bytes(8, "big", signed=True), members[i]) for i in np.flatnonzero(met).tolist()]

    kept = _second_round(rows, with_prefix, "prefix", pair_filter).distinct()
    kept = kept.select(F.conv(F.hex("a"), 16, -10).cast("long").alias("bucket"), F.col("b").alias("member"))
    return links.unionAll(_second_round(materialize(rows.join(kept, ["bucket", "member"]), "pairs"), with_text, "text", set_judge))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """One row per document: the id column, n_shingles and component_id.

    Two documents link when ``den * intersection >= num * union``; component_id is
    the smallest id that links reach, the own one included.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    scan = materialize(_scan(rows, width), "sets")
    found = materialize(_prefixes(rows, word_weights(scan), frequent(scan), width, num, den), "prefixes")
    node_group = found.groupBy("node").agg(F.first("grp").alias("grp"), F.first("n").alias("n"))
    groups = materialize(found.groupBy("grp").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix")), "groups")

    # buckets: shingles that two groups of about the same size have, one for each posting list.
    # A clash of the short group numbers could only make two groups share what they link to,
    # and nodes are verified on their sets.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    short_id = F.xxhash64("grp")
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(den / num))).cast("int")
    entries = groups.select(short_id.alias("g"), F.col("n").cast("int").alias("n"), F.explode("prefix").alias("token")).repartition(parts, "token")
    lists = entries.groupBy("token").agg(F.count("*").alias("m"), F.min("n").alias("least"), F.max("n").alias("most"), F.bit_xor("g").alias("x"), F.min("g").alias("lo"), F.max("g").alias("hi"))
    lists = lists.where((F.col("m") > 1) & ((F.col("m") > 2) | (den * F.col("least").cast("long") >= num * F.col("most").cast("long"))))
    kept = lists.groupBy("m", "x", "lo", "hi").agg(F.min("token").alias("token")).select("token")
    posted = materialize(entries.join(kept, "token"), "postings")
    near = posted.groupBy("token", band.alias("band")).agg(F.count("*").alias("k"))
    near = near.select("token", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), "k").groupBy("token", "band").agg(F.sum("k").alias("k")).where("k > 1").select("token", "band")
    posted = posted.withColumn("band", band).join(near, ["token", "band"], "left_semi")
    member = F.unhex(F.lpad(F.hex("g"), 16, "0"))
    posted = materialize(posted.select(F.col("token").alias("bucket"), member.alias("member"), F.col("n").cast("long").alias("n")), "members")
    # four bytes of each shingle do for a filter: a clash can only let a pair through
    short = groups.select(F.unhex(F.lpad(F.hex(short_id), 16, "0")).alias("grp"), F.transform("prefix", lambda x: (x.bitwiseAND(F.lit(0xFFFFFFFF)) - F.lit(1 << 31)).cast("int")).alias("prefix"))

    def with_prefix(members: DataFrame) -> DataFrame:
        return members.join(short, members["member"] == short["grp"]).drop("grp")

    def prefix_judge(cell: pa.Table):
        members = cell["member"].to_pylist()
        if len(members) < 2:
            return []
        return _judged(cell, members, _prefixes_meet(_arrays(cell["prefix"]), cell["n"].to_numpy(), num, den))

    coarse = components(linked(posted, with_prefix, "prefix", prefix_judge))

    # expand: the nodes of each family, each with the text of one document
    grouped = node_group.withColumn("grp", F.unhex(F.lpad(F.hex(short_id), 16, "0")))
    placed = grouped.join(coarse.withColumnRenamed("member", "grp"), "grp", "left").select("node", "grp", "n", F.coalesce("label", "grp").alias("bucket"))
    crowded = placed.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1").select("bucket")
    first_of = F.min(F.struct(F.col("doc").isNull().alias("no_doc"), "doc", "key")).alias("first")
    own = scan.where("node is not null").groupBy("node").agg(first_of).select("node", "first.doc", "first.key")
    wanted = materialize(placed.join(crowded, "bucket", "left_semi").join(own, "node"), "candidates")
    members = wanted.select("bucket", F.col("node").alias("member"), "n")

    # texts are looked up once; all later rounds read the few that are needed
    of = wanted.select("node", F.col("doc").alias("of"), F.col("key").alias("of_key"))
    keyed = rows.withColumn("key", F.xxhash64("text"))
    texts = keyed.join(of.hint("shuffle_hash"), F.col("doc").eqNullSafe(F.col("of")) & (F.col("key") == F.col("of_key"))).select("node", "text")
    texts = materialize(texts, "texts")
    if texts.count() > wanted.count():  # rows that repeat id and text
        texts = materialize(texts.groupBy("node").agg(F.first("text").alias("text")), "texts")

    def with_text(members: DataFrame) -> DataFrame:
        return members.join(texts, members["member"] == texts["node"]).drop("node")

    def set_judge(cell: pa.Table):
        members = cell["member"].to_pylist()
        sets = list(shingles.sets(*utf8_view(cell["text"]), width))
        # another text with the same id and hash is not the node that was asked for
        held = [i for i, s in enumerate(sets) if shingles.digest(s) == members[i]]
        if len(held) < 2:
            return []
        if len(held) < len(members):
            cell, members, sets = cell.take(held), [members[i] for i in held], [sets[i] for i in held]
        return _judged(cell, members, _sets_link(sets, num, den))

    sizes = _sizes(members)
    links = _first_round(members, sizes, with_text, "text", set_judge)
    many = sizes.where("blocks > 1").select("bucket")
    if not many.isEmpty():
        nodes = materialize(wanted.join(many, "bucket", "left_semi").select("grp", "node", "n"), "nodes")
        prefixes = groups.select(F.unhex(F.lpad(F.hex(short_id), 16, "0")).alias("grp"), "prefix")
        links = _completed(posted, nodes, links, prefixes, num, den, with_text, set_judge)
    labels = components(links)
    named = own.join(labels.withColumnRenamed("member", "node"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    names = named.groupBy("label").agg(F.min("doc").alias("component_id"))
    component = named.join(names, "label").select("node", "component_id")
    out = scan.where("n_shingles is not null").join(component, "node", "left")
    return out.select(F.col("doc").alias(id_col), "n_shingles", F.coalesce("component_id", "doc").alias("component_id"))
