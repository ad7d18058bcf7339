"""Secret scans by grammar inference.

Credentials of known kinds (from the caller, or those that the base rules mark in
a bounded sample of texts) form a prefix tree per kind. States whose outgoing
frequencies agree within a Hoeffding bound are merged (ALERGIA), which leaves a
small probabilistic automaton of the format. Ordinary token runs of the same sample
make one more automaton, the background.

Every candidate of every text is scored by its log-likelihood per character: each
run of token characters that is as long as the shortest credential of the base
rules, whatever it is made of and however long; if no format takes the whole run,
also its parts between ``= / . +``, and the stretches that begin with a literal
prefix of a learned format (from there to the end, and of each learned length). A
candidate is reported as ``format`` if a format makes it as likely as the
credentials it was learned from, and likelier than the background does.

Base rules (kinds ``assign``, ``access``, ``hex``) always report their matches,
whatever the automata say; of the accepted candidates those that lie inside a base
match are not reported a second time.

A null text counts as empty. Offsets are code points, the end exclusive. Texts
are read whole and no rows are shuffled. Repeated rows repeat their result, other
columns pass through, except that ``spans`` is replaced; an empty table gives an empty
one. Without credentials to learn from, only the base rules report. Spans that start
together are listed by kind; of formats that begin together the longest accepted end counts.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections import Counter
from itertools import accumulate, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from emberlog.llm.common import small_batches, text_groups, text_or_empty

BASE_KINDS = ("assign", "access", "hex")
#: Bytes of text that are decoded together.
GROUP_BYTES = 1 << 20
KINDS = (*BASE_KINDS, "format")

_CUE = re.compile(r"passw|secret|token|api_?key", re.I | re.A)
_ASSIGN = re.compile(r"(?:password|passwd|secret|token|api_?key)", re.I | re.A)
_VALUE = re.compile(r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
#: The base rules' shortest credential; shorter runs are no candidates.
MIN_CANDIDATE = 8
#: Groups in which the examples of a kind are first picked.
SALTS = 64
#: Symbols spelt out at each end of a long credential.
EDGE = 64
#: Scores of runs that a worker remembers before it starts anew.
REMEMBERED = 100_000

#: Classes of characters: digits, hexadecimal and other lower letters, upper letters, the marks
#: of tokens themselves; whatever else separates candidates.
_CLASS = np.full(129, ord(" "), np.uint8)
for _c in "+/_.=-":
    _CLASS[ord(_c)] = ord(_c)
_CLASS[ord("0") : ord("9") + 1] = ord("d")
_CLASS[ord("a") : ord("z") + 1] = ord("l")
_CLASS[ord("a") : ord("f") + 1] = ord("a")
_CLASS[ord("A") : ord("Z") + 1] = ord("u")
_RUN = re.compile("[^ ]{%d,}" % MIN_CANDIDATE)
_PART = re.compile("[^=/.+]{%d,}" % MIN_CANDIDATE)
_HEAD = re.compile("[A-Za-z]{2,6}[_-]|AKIA")
#: Class strings of runs in which a literal prefix may stand; others are told by their classes alone.
_MAY_HAVE_HEAD = re.compile("[alu]{2}[_-]|uuuu")


def classes(text: str) -> str:
    """The class of each character."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _CLASS[np.minimum(points, 128)].tobytes().decode("ascii")


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """Base matches (kind, start, end, credential), by start, then kind as listed."""
    found = []
    if _CUE.search(text):
        at = 0
        while cue := _ASSIGN.search(text, at):
            if value := _VALUE.match(text, cue.end()):
                if len(value[1]) >= 8:
                    found.append(("assign", cue.start(), value.end(), value[1]))
                at = value.end()
            else:
                at = cue.start() + 1
    if "AKIA" in text:
        found += [("access", *m.span(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [("hex", *m.span(), m[0]) for m in _HEX.finditer(text)]
    order = BASE_KINDS.index
    return sorted(found, key=lambda s: (s[1], order(s[0])))


class Run:
    """A run of token characters with its classes, of which stretches are spelt as symbols. What a stretch
    holds is looked up, so spelling one takes as long as its two ends, however long it is."""

    def __init__(self, value: str, kinds: str | None = None):
        self.value, self.kinds = value, classes(value) if kinds is None else kinds
        self._where: dict[str, np.ndarray] | None = None

    def _holds(self, c: str, a: int, z: int) -> bool:
        if z - a <= 4 * EDGE:
            return c in self.kinds[a:z]
        if self._where is None:
            raw = np.frombuffer(self.kinds.encode(), np.uint8)
            self._where = {k: np.flatnonzero(raw == ord(k)) for k in "adlu+/_.=-"}
        own = self._where[c]
        at = int(np.searchsorted(own, a))
        return at < len(own) and int(own[at]) < z

    def head(self, a: int, z: int) -> int:
        found = _HEAD.match(self.value, a, z)
        return found.end() - a if found else 0

    def symbols(self, a: int, z: int) -> str:
        """value[a:z] as symbols: lower hex, other lower, upper, digit and the marks themselves.
        A prefix up to a mark (``sk_``, ``ghp_``) and ``AKIA`` stay literal. Of a long credential both
        ends are spelt out; which classes it has and the order of magnitude of its length stand between."""
        skip = self.head(a, z)
        b = a + skip
        plain = not any(self._holds(c, b, z) for c in "lu+/_.=-")
        spell = (lambda k: k.replace("a", "h").replace("d", "h")) if plain else (lambda k: k.replace("a", "l"))
        if z - b > 2 * EDGE:
            held = {"h"} if plain else {"l" if c == "a" else c for c in "adlu+/_.=-" if self._holds(c, b, z)}
            marks = sum(1 << i for i, c in enumerate("hdlu+/_.=-") if c in held)
            kinds = spell(self.kinds[b : b + EDGE]) + chr(0x1000 + marks) + chr(0x100 + (z - b).bit_length()) + spell(self.kinds[z - EDGE : z])
        else:
            kinds = spell(self.kinds[b:z])
        return "".join("\x01" + c for c in self.value[a:b]) + kinds


def symbols(value: str) -> str:
    return Run(value).symbols(0, len(value))


class Automaton:
    """A probabilistic automaton learned from strings of symbols by state merging."""

    def __init__(self, strings: list[str], alpha: float = 0.05):
        self.arcs: list[dict[str, int]] = [{}]
        self.arc_count: list[Counter] = [Counter()]
        self.ends: list[int] = [0]
        self.passed: list[int] = [0]
        for s in sorted(strings):
            self._add(s)
        self.bound = math.sqrt(0.5 * math.log(2.0 / alpha))
        self._merge_states()
        self._to_probabilities()

    def _add(self, s: str) -> None:
        state = 0
        self.passed[0] += 1
        for c in s:
            self.arc_count[state][c] += 1
            if c not in self.arcs[state]:
                self.arcs[state][c] = len(self.arcs)
                self.arcs.append({})
                self.arc_count.append(Counter())
                self.ends.append(0)
                self.passed.append(0)
            state = self.arcs[state][c]
            self.passed[state] += 1
        self.ends[state] += 1

    def _differ(self, k1: int, n1: int, k2: int, n2: int) -> bool:
        return n1 > 0 and n2 > 0 and abs(k1 / n1 - k2 / n2) > self.bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int) -> bool:
        todo, seen = [(a, b)], set()
        while todo:
            x, y = todo.pop()
            if (x, y) in seen or x == y:
                continue
            seen.add((x, y))
            n1, n2 = self.passed[x], self.passed[y]
            if self._differ(self.ends[x], n1, self.ends[y], n2):
                return False
            for c in {*self.arc_count[x], *self.arc_count[y]}:
                if self._differ(self.arc_count[x][c], n1, self.arc_count[y][c], n2):
                    return False
                if c in self.arcs[x] and c in self.arcs[y]:
                    todo.append((self.arcs[x][c], self.arcs[y][c]))
        return True

    def _fold(self, kept: int, gone: int) -> set[int]:
        """Add the tree under ``gone`` to ``kept``; the states that were given new arcs."""
        todo, widened = [(kept, gone)], set()
        while todo:
            x, y = todo.pop()
            self.passed[x] += self.passed[y]
            self.ends[x] += self.ends[y]
            self.arc_count[x].update(self.arc_count[y])
            for c, under in self.arcs[y].items():
                if c in self.arcs[x]:
                    todo.append((self.arcs[x][c], under))
                else:
                    self.arcs[x][c] = under
                    widened.add(x)
        return widened

    def _merge_states(self) -> None:
        """Red states are final; the next blue one, a child of the earliest red one that has
        any, is folded into the first compatible red state or becomes red itself."""
        red, place = [0], {0: 0}
        blue = [(0, c) for c in self.arcs[0]]
        heapq.heapify(blue)
        while blue:
            at, c = heapq.heappop(blue)
            state = self.arcs[red[at]][c]
            if state in place:
                continue
            into = next((r for r in red if self._compatible(r, state)), None)
            if into is None:
                place[state] = len(red)
                red.append(state)
                widened = {state}
            else:
                self.arcs[red[at]][c] = into
                widened = self._fold(into, state)
            for x in widened & place.keys():
                for c in self.arcs[x]:
                    heapq.heappush(blue, (place[x], c))

    def _to_probabilities(self) -> None:
        self.steps, self.stop = [], []
        for state, arcs in enumerate(self.arcs):
            n = self.passed[state] + 1.0
            self.steps.append({c: (q, math.log(self.arc_count[state][c] / n)) for c, q in arcs.items() if self.arc_count[state][c]})
            self.stop.append(math.log((self.ends[state] + 0.01) / n))

    def score(self, s: str) -> float:
        """Mean log-likelihood per symbol, minus infinity for what the format can't make."""
        state, total = 0, 0.0
        for c in s:
            step = self.steps[state].get(c)
            if step is None:
                return -math.inf
            state = step[0]
            total += step[1]
        return (total + self.stop[state]) / (len(s) + 1)

    def reach(self, s: str, state: int = 0) -> tuple[int, int]:
        """How many of the symbols the format can make from a state on, and the state behind them."""
        for i, c in enumerate(s):
            step = self.steps[state].get(c)
            if step is None:
                return i, state
            state = step[0]
        return len(s), state


#: Kind of the ordinary runs among what is learned from.
ORDINARY = "ordinary"


class Grammar:
    """An automaton and a threshold for each kind of credential, and the background."""

    def __init__(self, labelled: list[tuple[str, str]]):
        self.parts: list[tuple[Automaton, float]] = []
        self.heads: dict[str, set[int]] = {}
        self.background = None
        for kind in sorted({k for k, _ in labelled}):
            values = [v for k, v in labelled if k == kind and len(v) >= MIN_CANDIDATE]
            if len(values) < 5:
                continue
            made = Automaton([symbols(v) for v in values])
            if kind == ORDINARY:
                self.background = made
                continue
            scores = sorted(made.score(symbols(v)) for v in values)
            # the least likely twentieth of the examples doesn't widen the format
            self.parts.append((made, scores[len(scores) // 20]))
            for v in values:
                if head := _HEAD.match(v):
                    self.heads.setdefault(head[0], set()).add(len(v))
        self.by_class: dict[str, tuple] = {}
        self.by_value: dict[str, tuple] = {}

    def accepts(self, value: str) -> bool:
        return self._accepts(Run(value), 0, len(value))

    def _accepts(self, run: Run, a: int, z: int) -> bool:
        s = run.symbols(a, z)
        best = max((score for part, least in self.parts if (score := part.score(s)) >= least), default=-math.inf)
        return best > -math.inf and (self.background is None or best > self.background.score(s))

    def _furthest(self, run: Run, at: int) -> int:
        """How many characters from ``at`` on some format can make, at most; those behind the first EDGE aren't tried."""
        skip = run.head(at, len(run.value))
        literal = "".join("\x01" + c for c in run.value[at : at + skip])
        rest = run.kinds[at + skip : at + skip + EDGE]
        digits = rest[: len(rest) - len(rest.lstrip("ad"))]
        spelt = (digits.replace("a", "h").replace("d", "h"), rest.replace("a", "l"))
        most = 0
        for part, _ in self.parts:
            n, state = part.reach(literal)
            if n == len(literal):
                most = max(most, *(skip + part.reach(s, state)[0] for s in spelt))
        return most

    def _within(self, value: str, kinds: str) -> tuple[tuple[int, int], ...]:
        """The accepted spans of a run. A start is left as soon as no format can go on, so the time
        grows with the run and not with its square."""
        run, n = Run(value, kinds), len(value)
        if self._accepts(run, 0, n):
            return ((0, n),)
        found, taken = set(), bytearray(n)

        def take(a: int, z: int) -> None:
            found.add((a, z))
            taken[a:z] = b"\x01" * (z - a)

        for m in _PART.finditer(value):
            a, z = m.span()
            if z - a < n and self._accepts(run, a, z):
                take(a, z)
        for head, lengths in sorted(self.heads.items()):
            longest_first, at = sorted(lengths, reverse=True), value.find(head)
            while at >= 0:
                if not taken[at] and n - at >= MIN_CANDIDATE:
                    far = self._furthest(run, at)
                    whole = far >= run.head(at, n) + EDGE  # ends behind the tried symbols are open
                    for z in (n, *(at + k for k in longest_first if at + k < n)):
                        if z - at >= MIN_CANDIDATE and (whole or z - at <= far) and self._accepts(run, at, z):
                            take(at, z)
                            break
                at = value.find(head, at + 1)
        return tuple(sorted(found))

    def found(self, run: str, kinds: str) -> tuple[tuple[int, int], ...]:
        """The accepted spans of a run with these classes, looked up or scored."""
        memo, key = (self.by_value, run) if _MAY_HAVE_HEAD.search(kinds) else (self.by_class, kinds)
        hit = memo.get(key)
        if hit is None:
            hit = self._within(run, kinds)
            if len(key) <= 256:
                if len(memo) >= REMEMBERED:
                    memo.clear()
                memo[key] = hit
        return hit


def format_spans(texts: list[str], grammar: Grammar) -> list[list[tuple[int, int]]]:
    """The accepted candidates of each text."""
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    whole = "\n".join(texts)
    begins = [0, *accumulate(len(t) + 1 for t in texts)]
    at = 0
    for m in _RUN.finditer(classes(whole)):
        a, z = m.span()
        if hits := grammar.found(whole[a:z], m[0]):
            while begins[at + 1] <= a:
                at += 1
            out[at] += [(a - begins[at] + x, a - begins[at] + y) for x, y in hits]
    return out


def with_formats(base: list[tuple[str, int, int, str]], formats: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """Base spans and the accepted candidates that don't lie inside one, by start, then kind as listed."""
    order = KINDS.index
    every = sorted([(a, -z, order(k), k) for k, a, z, _ in base] + [(a, -z, order("format"), "format") for a, z in formats])
    kept, reach = [], -1
    for a, z, _, kind in every:  # of equal starts the longest first
        if kind != "format":
            reach = max(reach, -z)
        if kind != "format" or -z > reach:
            kept.append((kind, a, -z))
    return sorted(kept, key=lambda s: (s[1], order(s[0])))


def spans(text: str, grammar: Grammar | None) -> list[tuple[str, int, int]]:
    formats = format_spans([text], grammar)[0] if grammar is not None and grammar.parts else []
    return with_formats(base_spans(text), formats)


def _smallest(best: dict[str, dict[int, str]], kind: str, value: str, most: int) -> None:
    """Keep the ``most`` values of a kind with the smallest hash, twice as many at times."""
    own = best.setdefault(kind, {})
    own[zlib.crc32(value.encode("utf-8", "surrogatepass")) << 32 | zlib.adler32(value.encode("utf-8", "surrogatepass"))] = value
    if len(own) >= 2 * most:
        for h in sorted(own)[most:]:
            del own[h]


def learn(df: DataFrame, key_col: str, text_col: str = "text", sample_rows: int = 20_000, examples_per_kind: int = 400) -> Grammar:
    """Learn from what the base rules mark in about ``sample_rows`` rows, chosen by a
    hash of ``key_col`` and the text, and from the ordinary runs beside it: of each at most
    ``examples_per_kind`` distinct values, those with the smallest hash. One pass over the
    texts, of which every task sends back so many values at most."""
    small_batches(df.sparkSession)
    rows = df.count()  # known from the files
    share = min(1_000_000, -(-sample_rows * 1_000_000 // max(1, rows)))
    sample = df.where(F.pmod(F.xxhash64(key_col, text_col), F.lit(1_000_000)) < share).select(text_or_empty(text_col).alias("text"))

    def marked(batches):
        best: dict[str, dict[int, str]] = {}
        for batch in batches:
            for text in (t for group in text_groups(batch.column(0), GROUP_BYTES) for t in group):
                own = base_spans(text)
                for kind, _, _, value in own:
                    _smallest(best, kind, value, examples_per_kind)
                reach, i = -1, 0
                for m in _RUN.finditer(classes(text)):
                    while i < len(own) and own[i][1] < m.end():
                        reach, i = max(reach, own[i][2]), i + 1
                    if reach <= m.start():
                        _smallest(best, ORDINARY, text[m.start() : m.end()], examples_per_kind)
        flat = [(kind, h - (1 << 63), value) for kind, own in best.items() for h, value in sorted(own.items())[:examples_per_kind]]
        yield pa.RecordBatch.from_pylist([dict(zip(("kind", "h", "value"), row)) for row in flat], schema=pa.schema([("kind", pa.string()), ("h", pa.int64()), ("value", pa.string())]))

    found = sample.mapInArrow(marked, "kind string, h long, value string").distinct()
    # what a task or the driver sees is bounded whatever the number of tasks before: SALTS times the examples
    place = F.row_number().over(Window.partitionBy("kind", "salt").orderBy("h", "value"))
    kept = found.withColumn("salt", F.pmod("h", F.lit(SALTS))).withColumn("place", place).where(F.col("place") <= examples_per_kind)
    rows = sorted((r["kind"], r["h"], r["value"]) for r in kept.select("kind", "h", "value").collect())
    return Grammar([(kind, value) for kind, own in groupby(rows, key=lambda r: r[0]) for _, _, value in list(own)[:examples_per_kind]])


def with_spans(df: DataFrame, grammar: Grammar | None, text_col: str = "text") -> DataFrame:
    """``df`` with ``spans``, an array of (kind, start, end) by start, then kind as listed."""
    held = df.sparkSession.sparkContext.broadcast(grammar)

    small_batches(df.sparkSession)

    @arrow_udf("array<struct<kind:string,start:int,end:int>>")
    def found(text: pa.Array) -> pa.Array:
        grammar = held.value
        per_text, kinds, starts, ends = [0], [], [], []
        for group in text_groups(text, GROUP_BYTES):
            formats = format_spans(group, grammar) if grammar is not None and grammar.parts else [[]] * len(group)
            for t, own in zip(group, formats):
                for kind, a, z in with_formats(base_spans(t), own):
                    kinds.append(kind)
                    starts.append(a)
                    ends.append(z)
                per_text.append(len(kinds))
        rows = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["kind", "start", "end"])
        return pa.ListArray.from_arrays(pa.array(per_text, pa.int32()), rows)

    return df.withColumn("spans", found(text_or_empty(text_col)))
