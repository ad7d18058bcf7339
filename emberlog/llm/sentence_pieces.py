"""SentencePiece encoding and decoding by vectorised merge rounds.

The pieces of a BPE model are merged as the library merges them: of all adjacent
symbols whose union is a piece the pair with the best score first, of equal scores the
leftmost. A text is cut where no piece can reach across: before a space mark that
follows another character, and between characters that stand side by side in no piece.
The parts are independent, and parts repeat far more often than texts do, so a worker
encodes each new word once and keeps its ids in a bounded memo.

New words lie one after another in flat arrays. A round takes the least rank of the
pairs in each part, merges the pairs of that rank in all parts at once, leftmost first
and without overlap, and compacts the arrays; parts without a pair leave. In a part, a
merge that makes a new pair of the same or a better rank ends the round behind it,
because the library would take that pair next. A part of more than LONG symbols, a
run of as many characters that cannot be cut, takes a round for nearly each merge; it is
merged with a heap of pairs instead, in the same order.

Characters outside the model become the pieces of their bytes. Decoding joins the
bytes of all pieces of a batch at once, takes the space mark from the front and turns
bytes that are no UTF-8 into U+FFFD one by one, as the library does.

Cases: a null text counts as empty and has the begin and end ids alone; null ids decode
to an empty text. Texts of any length are read in slices between words. Repeated rows
give repeated results, other columns pass through, an empty table gives an empty table;
a column that is named like a result column is replaced. Models with a normalisation
table, with user-defined or unused pieces or without byte pieces are refused.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from emberlog.llm.common import enter, hold, small_batches, text_groups, text_or_empty, tokenizer_path, trim
from emberlog.llm.tokens import _Numbers, gather

MARK = "▁"
#: Symbols of a part that is merged with a heap.
LONG = 256
#: Bytes of text that are encoded together, and characters of a slice of a long one.
GROUP_BYTES = 4 << 20
SLICE_CHARS = 1 << 20
#: Characters of text whose new words are merged together.
FLUSH_CHARS = 4 << 20
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
_NEVER = np.int64(1 << 40)
_SHIFT = 21
_WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
_BREAK = re.compile(f"(?<=[^{MARK}]){MARK}")


class PieceModel:
    """The tables of a model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as format_

        model = format_.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        rules, kinds = model.normalizer_spec, np.array([p.type for p in model.pieces])
        odd = set(kinds.tolist()) - {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}
        if model.trainer_spec.model_type != 2 or rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix or odd or (kinds == _BYTE).sum() != 256:
            raise ValueError("a BPE model with byte pieces, a leading space mark and no normalisation is needed")
        self.size = len(model.pieces)
        self.kinds = kinds
        names = [p.piece for p in model.pieces]
        self.begin, self.end = model.trainer_spec.bos_id, model.trainer_spec.eos_id
        self.byte_ids = np.zeros(256, np.int32)
        for i in np.flatnonzero(kinds == _BYTE):
            self.byte_ids[int(names[i][3:5], 16)] = i
        normal = {names[i]: int(i) for i in np.flatnonzero(kinds == _NORMAL)}
        # a symbol is a piece, or a character that is none: its code point above the pieces
        self.char = np.arange(0x110000, dtype=np.int64) + self.size
        for piece, i in normal.items():
            if len(piece) == 1:
                self.char[ord(piece)] = i
        symbol = lambda s: normal.get(s, self.size + ord(s) if len(s) == 1 else None)
        keys, made = [], []
        for piece, i in normal.items():
            for k in range(1, len(piece)):
                x, y = symbol(piece[:k]), symbol(piece[k:])
                if x is not None and y is not None:
                    keys.append(x << _SHIFT | y)
                    made.append(i)
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_made = np.array(keys, np.int64)[order], np.array(made, np.int64)[order]
        scores = np.array([-p.score for p in model.pieces])
        self.pair_ranks = np.unique(scores, return_inverse=True)[1][self.pair_made].astype(np.int64)
        beside = {(ord(a), ord(b)) for piece in normal for a, b in zip(piece, piece[1:])}
        self.beside = np.array(sorted(int(self.char[a]) << _SHIFT | int(self.char[b]) for a, b in beside), np.int64)
        self.slot_pairs = dict(zip(self.pair_keys.tolist(), zip(self.pair_ranks.tolist(), self.pair_made.tolist())))
        surfaces = [bytes([int(n[3:5], 16)]) if k == _BYTE else b"" if k == _CONTROL else model.trainer_spec.unk_surface.encode() if k == _UNKNOWN else n.replace(MARK, " ").encode() for n, k in zip(names, kinds)]
        self.surfaces = surfaces
        self.surface_bytes = np.frombuffer(b"".join(surfaces), np.uint8)
        self.surface_len = np.array([len(s) for s in surfaces], np.int64)
        self.surface_at = np.cumsum(self.surface_len) - self.surface_len
        self.spaced = np.array([k == _NORMAL and n.startswith(MARK) for n, k in zip(names, kinds)])

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank and the piece of each pair; _NEVER where the two make none."""
        key = left << _SHIFT | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        hit = self.pair_keys[at] == key
        return np.where(hit, self.pair_ranks[at], _NEVER), np.where(hit, self.pair_made[at], -1)

    def _by_heap(self, symbols: list[int]) -> list[int]:
        """One long part: a linked list and a heap of (rank, place)."""
        n, slot = len(symbols), self.slot_pairs
        after, before, alive = [*range(1, n), -1], list(range(-1, n - 1)), [True] * n
        heap = [(found[0], i, symbols[i], symbols[i + 1], found[1]) for i in range(n - 1) if (found := slot.get(symbols[i] << _SHIFT | symbols[i + 1]))]
        heapq.heapify(heap)

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and (found := slot.get(symbols[i] << _SHIFT | symbols[j])):
                heapq.heappush(heap, (found[0], i, symbols[i], symbols[j], found[1]))

        while heap:
            _, i, x, y, made = heapq.heappop(heap)
            if not alive[i] or symbols[i] != x or (j := after[i]) < 0 or symbols[j] != y:
                continue
            symbols[i], alive[j] = made, False
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [s for s, a in zip(symbols, alive) if a]

    def _rounds(self, sym: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and the numbers of their parts (ascending), merged until no pair remains."""
        done_sym, done_part = [], []
        rank, made = np.full(len(sym), _NEVER), np.full(len(sym), -1, np.int64)
        if len(sym) > 1:
            rank[:-1], made[:-1] = self.pairs(sym[:-1], sym[1:])
            rank[:-1][part[:-1] != part[1:]] = _NEVER
        while len(sym):
            first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            sizes = np.diff(np.append(first, len(sym)))
            least = np.minimum.reduceat(rank, first)
            live = np.repeat(least < _NEVER, sizes)
            if not live.all():
                done_sym.append(sym[~live])
                done_part.append(part[~live])
                sym, part, rank, made, sizes, least = sym[live], part[live], rank[live], made[live], sizes[least < _NEVER], least[least < _NEVER]
                if not len(sym):
                    break
            first = np.cumsum(sizes) - sizes
            best = np.repeat(least, sizes)
            n, at = len(sym), np.flatnonzero(rank == best)
            # of overlapping pairs every second one, from the left
            begins = np.concatenate([[True], np.diff(at) != 1])
            run = np.flatnonzero(begins)
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
            # what the new symbol would make with its neighbours
            z, own = made[at], part[at]
            right = np.minimum(at + 2, n - 1)
            worse = np.where((at + 2 < n) & (part[right] == own), self.pairs(z, sym[right])[0], _NEVER)
            left = np.maximum(at - 1, 0)
            merged = np.concatenate([[False], at[1:] - at[:-1] == 2]) if len(at) else np.zeros(0, bool)
            left_sym = np.where(merged, np.concatenate([[0], z[:-1]]), sym[left])
            worse = np.minimum(worse, np.where((at > 0) & (part[left] == own), self.pairs(left_sym, z)[0], _NEVER))
            stops = np.cumsum(worse <= best[at])
            stops_before = np.concatenate([[0], stops[:-1]])
            group = np.concatenate([[True], own[1:] != own[:-1]])
            base = stops_before[np.maximum.accumulate(np.where(group, np.arange(len(at)), 0))]
            at = at[stops_before == base]
            sym[at] = made[at]
            kept = np.ones(n, bool)
            kept[at + 1] = False
            sym, part, rank, made = sym[kept], part[kept], rank[kept], made[kept]
            new = at - np.arange(len(at))
            touched = np.zeros(len(sym), bool)
            touched[new] = touched[np.maximum(new - 1, 0)] = True
            again = np.flatnonzero(touched)
            beyond = np.minimum(again + 1, len(sym) - 1)
            fresh_rank, fresh_made = self.pairs(sym[again], sym[beyond])
            inside = (again + 1 < len(sym)) & (part[beyond] == part[again])
            rank[again], made[again] = np.where(inside, fresh_rank, _NEVER), fresh_made
        if not done_sym:
            return sym, part
        sym, part = np.concatenate(done_sym), np.concatenate(done_part)
        order = np.argsort(part, kind="stable")
        return sym[order], part[order]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Counts and ids of words, space marks included."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        sym = self.char[points]
        if not len(sym):
            return np.zeros(len(words), np.int64), np.zeros(0, np.int32)
        word = np.repeat(np.arange(len(words)), lengths)
        key = sym[:-1] << _SHIFT | sym[1:]
        spot = np.minimum(np.searchsorted(self.beside, key), len(self.beside) - 1)
        cut = (self.beside[spot] != key) | (word[1:] != word[:-1])
        part = np.concatenate([[0], np.cumsum(cut)])
        sizes = np.bincount(part)
        if (long := np.flatnonzero(sizes > LONG)).size:
            starts, pieces, owners = np.cumsum(sizes) - sizes, [], []
            for p in long:
                pieces.append(np.array(self._by_heap(sym[starts[p] : starts[p] + sizes[p]].tolist()), np.int64))
                owners.append(np.full(len(pieces[-1]), p))
            short = np.repeat(sizes <= LONG, sizes)
            s, p = self._rounds(sym[short], part[short])
            s, p = np.concatenate([s, *pieces]), np.concatenate([p, *owners])
            order = np.argsort(p, kind="stable")
            s, p = s[order], p[order]
        else:
            s, p = self._rounds(sym, part)
        owner = word[np.concatenate([[0], np.flatnonzero(cut) + 1])][p]
        strange = s >= self.size
        if strange.any():
            raw = [chr(c).encode("utf-8", "surrogatepass") for c in (s[strange] - self.size).tolist()]
            times = np.ones(len(s), np.int64)
            times[strange] = [len(r) for r in raw]
            owner, out = np.repeat(owner, times), np.repeat(s, times)
            out[np.repeat(strange, times)] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
            s = out
        return np.bincount(owner, minlength=len(words)), s.astype(np.int32)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of stretches of ids."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size):
            raise ValueError("an id is none of the model's")
        data = gather(self.surface_bytes, self.surface_at[ids], self.surface_len[ids]) if len(ids) else np.zeros(0, np.uint8)
        ends_id = np.cumsum(counts)
        ends = np.concatenate([[0], np.cumsum(self.surface_len[ids])])[np.concatenate([[0], ends_id])]
        data, out = data.tobytes(), []
        said = np.flatnonzero(self.surface_len[ids] > 0)  # the first piece of each text that says anything
        firsts = np.searchsorted(said, ends_id - counts)
        for k in range(len(counts)):
            a, z = int(ends[k]), int(ends[k + 1])
            if a < z and self.spaced[ids[said[firsts[k]]]]:
                a += 1
            try:
                out.append(data[a:z].decode("utf-8"))
            except UnicodeDecodeError:
                out.append(self._broken(ids[ends_id[k] - counts[k] : ends_id[k]].tolist()))
        return out

    def _broken(self, ids: list[int]) -> str:
        """A text with byte pieces that are no UTF-8: each such byte is one U+FFFD."""
        out, run = [], b""
        for i in [*ids, -1]:
            if i >= 0 and self.kinds[i] == _BYTE:
                run += self.surfaces[i]
                continue
            while run:
                size = next((k for k in range(1, 5) if _is_char(run[:k])), 0)
                out.append(run[:size].decode() if size else "�")
                run = run[max(size, 1) :]
            if i >= 0 and (surface := self.surfaces[i].decode()):
                out.append(surface[1:] if self.spaced[i] and not any(out) else surface)
        return "".join(out)


def _is_char(raw: bytes) -> bool:
    try:
        return len(raw.decode("utf-8")) == 1
    except UnicodeDecodeError:
        return False


def words_of(text: str):
    """The words of a text, a list for each slice: a run of space marks and what follows it."""
    if not text:
        return
    text = MARK + text.replace(" ", MARK)
    start = 0
    while start < len(text):
        cut = _BREAK.search(text, start + SLICE_CHARS) if len(text) - start > SLICE_CHARS else None
        end = cut.start() if cut else len(text)
        yield _WORD.findall(text, start, end)
        start = end


class PieceEncoder:
    """Ids of texts, word by word. Beyond ``memo`` words, or MEMO_CHARS characters of them, the memo starts anew."""

    MEMO_CHARS = 32 << 20

    def __init__(self, path: str, memo: int = 1_000_000):
        self.model, self.memo = PieceModel(path), memo
        self._reset()

    def _reset(self) -> None:
        self.number, self.chars, self.used = _Numbers(), 0, 0
        self.ids, self.at, self.counts = np.zeros(1 << 12, np.int32), np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64)

    def _learn(self, first: int, new: list[str]) -> None:
        counts, ids = self.model.encode_words(new)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while first + len(new) > len(self.at):
            self.at, self.counts = (np.concatenate([a, np.zeros_like(a)]) for a in (self.at, self.counts))
        self.ids[self.used : self.used + len(ids)] = ids
        self.counts[first : first + len(new)] = counts
        self.at[first : first + len(new)] = self.used + np.cumsum(counts) - counts
        self.used += len(ids)
        self.chars += sum(map(len, new))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Counts and ids of texts, begin and end ids among them."""
        counts, out = np.zeros(len(texts), np.int64), [np.zeros(0, np.int32)]
        parts: list[tuple[int, np.ndarray]] = []  # text and numbers of its words
        held = 0

        def flush() -> None:
            """Learn the new words of the parts together, then spell the parts."""
            new, self.number.new = self.number.new, []
            if new:
                self._learn(len(self.number) - len(new), new)
            if parts:
                owner = np.repeat([k for k, _ in parts], [len(n) for _, n in parts])
                numbers = np.concatenate([n for _, n in parts])
                own = self.counts[numbers]
                out.append(gather(self.ids, self.at[numbers], own))
                counts[:] += np.bincount(owner, own, len(texts)).astype(np.int64)
                parts.clear()
            if len(self.number) > self.memo or self.chars > self.MEMO_CHARS:
                self._reset()

        for k, text in enumerate(texts):
            for words in words_of(text):
                parts.append((k, np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))))
                held += sum(map(len, words))
                if held >= FLUSH_CHARS:
                    flush()
                    held = 0
        flush()
        ends = np.cumsum(counts)
        edges = np.stack([ends - counts, ends], axis=1).ravel()  # each text's begin before its end
        return counts + 2, np.insert(np.concatenate(out), edges, np.tile([self.model.begin, self.model.end], len(texts)))


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder for each worker process and file."""
    enter("pieces")
    hold("pieces", _ENCODERS.clear)
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def with_ids(df: DataFrame, text_col: str = "text", vocabulary: str = "piece_bpe_32k.model", path: str | None = None, ids_col: str = "ids") -> DataFrame:
    """``df`` with the ids of each text. ``path`` overrides the place of the model file."""
    small_batches(df.sparkSession)

    @arrow_udf("array<int>")
    def encode(text: pa.Array) -> pa.Array:
        enc = encoder(path or tokenizer_path(vocabulary))
        counts, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for group in text_groups(text, GROUP_BYTES):
            c, i = enc.encode(group)
            counts.append(c)
            ids.append(i)
        trim()
        ends = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids), pa.int32()))

    return df.withColumn(ids_col, encode(text_or_empty(text_col)))


def with_text(df: DataFrame, ids_col: str = "ids", vocabulary: str = "piece_bpe_32k.model", path: str | None = None, text_col: str = "decoded") -> DataFrame:
    """``df`` with the text that each array of ids decodes to."""
    small_batches(df.sparkSession)

    @arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        model = encoder(path or tokenizer_path(vocabulary)).model
        values, ends = _flat(ids)
        return pa.array(model.decode(values, np.diff(ends)), pa.string())

    return df.withColumn(text_col, decode(F.col(ids_col)))


def _flat(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list array and the offsets of its rows; nulls are empty."""
    counts = np.asarray(ids.value_lengths().fill_null(0)).astype(np.int64)
    values = ids.flatten().fill_null(-1)
    return np.asarray(values).astype(np.int64), np.concatenate([[0], np.cumsum(counts)])


def with_digest(df: DataFrame, ids_col: str = "ids", out_col: str = "ids_sha256") -> DataFrame:
    """``df`` with the SHA-256 of each array of ids as little-endian unsigned 32-bit integers."""
    import hashlib

    @arrow_udf("string")
    def digest(ids: pa.Array) -> pa.Array:
        values, ends = _flat(ids)
        raw = values.astype("<u4").tobytes()
        return pa.array([hashlib.sha256(raw[4 * a : 4 * z]).hexdigest() for a, z in zip(ends[:-1], ends[1:])], pa.string())

    return df.withColumn(out_col, digest(F.col(ids_col)))
