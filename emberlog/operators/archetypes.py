"""Pulls that are nearly the same, and the archetype of each. Planned by the analysed design, beyond its code.

A pull is a multiset of species. Two pulls of a dungeon are alike when the weight that
they share is at least ``num / den`` of the weight that either has. Pulls with the same
multiset are one composition first, however many they are. Two sizes fix how much weight
each of two alike compositions has beside what they share: at 4/5 the smaller one at most
a ninth, so most lie in the larger one whole. Compositions meet by their size and the
first three species they share in order of rarity, of which the smaller one passes over no more than
its share and the larger one no more than its own. Groups are what likenesses connect; the archetype is the
group's medoid, the composition that is nearest to all pulls of the group it is alike to.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.operators.duplicates import connected
from emberlog.session import materialize

NUM, DEN = 4, 5


def compositions(pulls: DataFrame, npcs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pull_id, node) of every pull with species, and the distinct compositions (node, dungeon_key, species, size,
    pulls), both tables of the shared folder. A count that isn't known is 1, one under 1 isn't there; species without
    an id don't count. A null dungeon is one of its own."""
    there = npcs.where("npc_game_id is not null and coalesce(instance_count, 1) > 0").select("pull_id", F.col("npc_game_id").cast("long").alias("npc_game_id"), F.coalesce("instance_count", F.lit(1)).alias("n"))
    # dealt out by pull once, for both aggregates and the join
    each = there.repartition("pull_id").groupBy("pull_id", "npc_game_id").agg(F.sum("n").cast("long").alias("n"))
    held = each.groupBy("pull_id").agg(F.sort_array(F.collect_list(F.struct("npc_game_id", "n"))).alias("species"), F.sum("n").alias("size"))
    node = F.sha2(F.to_json(F.struct("dungeon_key", "species"), {"ignoreNullFields": "false"}), 256)
    known = materialize(pulls.select("pull_id", "dungeon_key").join(held, "pull_id").withColumn("node", F.unhex(node)), "pulls")
    distinct = known.groupBy("dungeon_key", "size", "species").agg(F.count("*").alias("pulls"))
    nodes = materialize(distinct.select(node.alias("node"), "dungeon_key", "species", "pulls", "size"), "nodes")
    return known.select("pull_id", F.lower(F.hex("node")).alias("node")), nodes


def shared(a: Column, b: Column) -> Column:
    """The weight that two multisets have in common."""
    other = F.map_from_entries(b)
    return F.aggregate(a, F.lit(0).cast("long"), lambda total, x: total + F.least(x["n"], F.coalesce(F.try_element_at(other, x["npc_game_id"]), F.lit(0))))


#: Species that two compositions meet by: the first ones they share.
_MEET = 3
#: Species are counted in so many slots: species of one slot count as equally rare.
_SLOTS = 1 << 16
#: Paths through species that are followed at once, and bytes of a batch of what is dealt out.
_AT_ONCE, _BATCH = 200_000, 4 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _then(h: np.ndarray, npc: np.ndarray) -> np.ndarray:
    return _mix(h * np.uint64(0x9E3779B97F4A7C15) + _mix(npc.view(np.uint64) + np.uint64(1)))


def _band(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of a size's band, and the first size behind the band: sizes of up to five binary digits are bands of their own."""
    over = np.maximum(np.frexp(size.astype(np.float64))[1].astype(np.int64) - 5, 0)
    return (size >> over) * 64 + over, ((size >> over) + 1) << over


def _least(x: np.ndarray, y: np.ndarray, num: int, den: int) -> np.ndarray:
    """The weight that compositions of these sizes have to share."""
    return -(-num * (x + y) // (num + den))


def _start(dungeon: np.ndarray, band: np.ndarray) -> np.ndarray:
    return _mix(dungeon.view(np.uint64) ^ _mix(band.view(np.uint64) + np.uint64(7)))


def _places(start: np.ndarray, lens: np.ndarray, npc: np.ndarray, n: np.ndarray, h: np.ndarray, slack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place): every choice of the first ``_MEET`` species, or of fewer at the end, that passes over no more weight than ``slack``."""
    row, at, picked = np.arange(len(h)), np.zeros(len(h), np.int64), np.zeros(len(h), np.uint64)
    rows, places = [row[:0]], [h[:0]]
    while len(row):
        done = (at == lens[row]) | (picked == _MEET)
        rows.append(row[done])
        places.append(_mix(h[done] + picked[done]))
        row, at, picked, h, slack = (x[~done] for x in (row, at, picked, h, slack))
        here = start[row] + at
        over = n[here] <= slack
        row, at, picked, h, slack = (
            np.concatenate(pair)
            for pair in ((row, row[over]), (at + 1, at[over] + 1), (picked + np.uint64(1), picked[over]), (_then(h, npc[here]), h[over]), (slack, slack[over] - n[here][over]))
        )
    return np.concatenate(rows), np.concatenate(places)


def _dealt(larger: bool, seen: np.ndarray, num: int, den: int) -> Callable:
    """Each composition at every place where it may meet one that is alike, as the smaller or the larger of the two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            species, size, dungeon = batch.column("species"), batch.column("size").to_numpy(), batch.column("dungeon").to_numpy()
            flat, offsets = species.flatten(), species.offsets.to_numpy().astype(np.int64)
            start, lens = offsets[:-1] - offsets[0], np.diff(offsets)
            npc, n = flat.field("npc_game_id").to_numpy(), flat.field("n").to_numpy()
            order = np.lexsort((npc, seen[npc % _SLOTS], np.repeat(np.arange(len(lens)), lens)))
            npc, n = npc[order], n[order]
            code = pa.Array.from_buffers(pa.binary(), len(lens), [None, pa.py_buffer((16 * (offsets - offsets[0])).astype(np.int32)), pa.py_buffer(np.stack((npc, n), axis=1))])
            # (row, least size of the smaller one, slack)
            asked = []
            if larger:
                row, x = np.arange(len(size)), -(-num * size // den)
                while len(row):
                    slack = size[row] - _least(x, size[row], num, den)
                    asked.append((row[slack > 0], x[slack > 0], slack[slack > 0]))
                    x = _band(x)[1]
                    row, x = row[x <= size[row]], x[x <= size[row]]
            else:
                asked.append((np.arange(len(size)), size, size - _least(size, size, num, den)))
            row, x, slack = (np.concatenate(c) for c in zip(*asked))
            wide = np.minimum(lens[row], slack + _MEET).astype(np.float64)
            cuts = np.flatnonzero(np.diff(np.cumsum(wide**_MEET) // _AT_ONCE)) + 1
            for part in np.split(np.arange(len(row)), cuts):
                r = row[part]
                which, place = _places(start[r], lens[r], npc, n, _start(dungeon[r], _band(x[part])[0]), slack[part])
                which = r[which]
                some = max(1, _BATCH // (64 + 16 * int(lens[which].max(initial=1))))
                for i in range(0, len(which), some):
                    own = pa.array(which[i : i + some])
                    yield pa.RecordBatch.from_arrays([pa.array(place[i : i + some].view(np.int64)), *[batch.column(c).take(own) for c in ("node", "dungeon_key", "size")], code.take(own)], ["at", "node", "dungeon_key", "size", "code"])

    return run


def _told(code: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first entry of each row, species, counts) of coded compositions."""
    _, offsets, held = code.buffers()
    offsets = np.frombuffer(offsets, np.int32)[code.offset : code.offset + len(code) + 1].astype(np.int64)
    entries = np.frombuffer(held, np.int64, (offsets[-1] - offsets[0]) // 8, offsets[0]).reshape(-1, 2)
    return (offsets - offsets[0]) // 16, entries[:, 0], entries[:, 1]


def _judged(num: int, den: int) -> Callable:
    """Of the pairs that meet those that are alike, each at the place of the species they do share first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            (x, x_npc, x_n), (y, y_npc, y_n) = _told(batch.column("x_code")), _told(batch.column("y_code"))
            of = np.repeat(np.arange(len(batch)), np.diff(x))
            ids, number = np.unique(np.concatenate((x_npc, y_npc)), return_inverse=True)
            left, right = of * len(ids) + number[: len(x_npc)], np.repeat(np.arange(len(batch)), np.diff(y)) * len(ids) + number[len(x_npc) :]
            order = np.argsort(right)
            found = np.minimum(np.searchsorted(right, left, sorter=order), len(right) - 1)
            common = right[order][found] == left
            both = np.add.reduceat(np.where(common, np.minimum(x_n, y_n[order][found]), 0), x[:-1])
            nth = np.cumsum(common)
            nth = nth - (nth[x[:-1]] - common[x[:-1]])[of]
            size = batch.column("x_size").to_numpy()
            either = size + batch.column("y_size").to_numpy() - both
            h, picked = _start(batch.column("dungeon").to_numpy(), _band(size)[0]), np.zeros(len(batch), np.uint64)
            for i in range(1, _MEET + 1):
                entry = np.flatnonzero(common & (nth == i))
                h[of[entry]] = _then(h[of[entry]], x_npc[entry])
                picked[of[entry]] += np.uint64(1)
            held = (_mix(h + picked).view(np.int64) == batch.column("at").to_numpy()) & (den * both >= num * either)
            own = pa.array(np.flatnonzero(held))
            yield pa.RecordBatch.from_arrays([batch.column("x_node").take(own), batch.column("y_node").take(own), pa.array(both[held]), pa.array(either[held])], ["x_node", "y_node", "shared", "either"])

    return run


def similar(nodes: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """(a, b, shared, either) of the compositions a < b that are alike, each pair once."""
    slots = nodes.select(F.explode("species.npc_game_id").alias("npc")).groupBy(F.pmod("npc", F.lit(_SLOTS)).alias("slot")).count()
    seen = np.zeros(_SLOTS, np.int64)
    for slot, count in slots.collect():
        seen[slot] = count
    dungeon = lambda c: F.xxhash64(F.col(c).isNull(), F.col(c)).alias("dungeon")
    held = nodes.select(F.unhex("node").alias("node"), "dungeon_key", dungeon("dungeon_key"), "species", "size")
    side = lambda s, larger: held.mapInArrow(_dealt(larger, seen, num, den), "at long, node binary, dungeon_key string, size long, code binary").select("at", *[F.col(c).alias(f"{s}_{c}") for c in ("node", "dungeon_key", "size", "code")])
    fits = (F.col("x_size") < F.col("y_size")) | (F.col("x_size") == F.col("y_size")) & (F.col("x_node") < F.col("y_node"))
    fits = fits & (den * F.col("x_size") >= num * F.col("y_size")) & F.col("x_dungeon_key").eqNullSafe(F.col("y_dungeon_key"))
    met = side("x", False).join(side("y", True).hint("merge"), "at").where(fits).select("at", dungeon("x_dungeon_key"), "x_node", "x_size", "x_code", "y_node", "y_size", "y_code")
    alike = met.mapInArrow(_judged(num, den), "x_node binary, y_node binary, shared long, either long")
    name = lambda pick: F.lower(F.hex(pick("x_node", "y_node")))
    return alike.select(name(F.least).alias("a"), name(F.greatest).alias("b"), "shared", "either")


def archetypes(pulls: DataFrame, npcs: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """(pull_id, archetype_id, match_kind, distance, members) of every pull with species: the medoid of its group,
    whether the pull is it (exact), has its species in other numbers (species) or is merely near (fuzzy), and how
    far from it (1 less the share of weight in common, six places). Of equal medoids the smallest id counts."""
    of, nodes = compositions(pulls, npcs)
    links = materialize(similar(nodes, num, den), "likenesses")
    label = connected(links.select("a", "b"))
    likeness = F.round(F.col("shared") / F.col("either"), 6)
    both = links.select("a", "b", likeness.alias("s")).unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"), likeness.alias("s")))
    weight = both.join(nodes.select(F.col("node").alias("b"), F.col("pulls").alias("m")).hint("merge"), "b").groupBy("a").agg(F.round(F.sum(F.col("s") * F.col("m")), 4).alias("near"))
    named = label.withColumnRenamed("member", "node")
    # what is like no other composition is its own archetype
    alone = nodes.join(named, "node", "left_anti").select("node", F.col("node").alias("archetype_id"), F.lit("exact").alias("match_kind"), F.lit(0.0).alias("distance"), F.col("pulls").alias("members"))
    placed = nodes.hint("merge").join(named, "node").join(weight.withColumnRenamed("a", "node"), "node").select("node", "species", "size", "pulls", "label", (F.col("near") + F.col("pulls")).alias("near"))
    placed = materialize(placed, "placed")
    best = placed.groupBy("label").agg(F.min(F.struct(-F.col("near"), "node")).alias("top"), F.sum("pulls").alias("members"))
    medoid = best.select("label", F.col("top.node").alias("archetype_id"), "members").join(placed.select(F.col("node").alias("archetype_id"), F.col("species").alias("core"), F.col("size").alias("core_size")), "archetype_id")
    core = F.col("node") == F.col("archetype_id")
    met = placed.join(medoid, "label").withColumn("both", F.when(core, F.col("size")).otherwise(shared(F.col("species"), F.col("core"))))
    distance = F.round(1 - F.col("both") / (F.col("size") + F.col("core_size") - F.col("both")), 6)
    kind = F.when(core, "exact").when(F.col("species")["npc_game_id"] == F.col("core")["npc_game_id"], "species").otherwise("fuzzy")
    met = met.select("node", "archetype_id", kind.alias("match_kind"), distance.alias("distance"), "members").unionAll(alone)
    return of.join(met, "node").drop("node")
