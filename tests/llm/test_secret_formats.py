"""Learned formats: the automaton against a plain one, candidates of any length, recall and false alarms."""

import random
import time
import zlib

import brute
import pyarrow.parquet as pq
import pytest

from emberlog.llm import secrets

ALNUM = "ABCDEFGHJKMNPQRSTabcdefghijkmnopqrstuvwxyz0123456789"


def tokens(rng, n, size, head="", alphabet=ALNUM):
    return [head + "".join(rng.choice(alphabet) for _ in range(size)) for _ in range(n)]


@pytest.mark.parametrize("seed", range(6))
def test_merging_and_scores_as_the_plain_version(seed):
    rng = random.Random(seed)
    strings = ["".join(rng.choice(["ab", "b", "cab"]) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(5, 80))]
    strings += ["x" + "d" * rng.choice([4, 8]) for _ in range(rng.randint(0, 30))]
    made, plain = secrets.Automaton(strings), brute.alergia(strings)
    for s in [*strings, *("".join(rng.choice("abcdx") for _ in range(rng.randint(0, 12))) for _ in range(300))]:
        assert made.score(s) == pytest.approx(plain(s)), s


@pytest.mark.parametrize("size", [8, 12, 19, 513, 2000])
def test_credentials_of_any_length(size):
    rng = random.Random(size)
    grammar = secrets.Grammar([("own", v) for v in tokens(rng, 120, size, alphabet="0123456789abcdef")] + [("ordinary", v) for v in tokens(rng, 100, 9, alphabet="etaoinshrdlu")])
    new = tokens(rng, 40, size, alphabet="0123456789abcdef")
    assert sum(("format", 5, 5 + size) in secrets.spans(f"left {v} right", grammar) or secrets.base_spans(v) != [] for v in new) >= 36


def test_letters_alone_can_be_a_credential():
    rng = random.Random(2)
    grammar = secrets.Grammar([("own", v) for v in tokens(rng, 150, 24, alphabet="ABCDEFGHIJ")] + [("ordinary", v) for v in tokens(rng, 150, 10, alphabet="etaoinshrdlu")])
    value = tokens(rng, 1, 24, alphabet="ABCDEFGHIJ")[0]
    assert secrets.spans(f"is {value}!", grammar) == [("format", 3, 27)]


def test_inside_long_runs_and_beside_base_spans():
    rng = random.Random(3)
    make = lambda: tokens(rng, 1, 36, "ghp_")[0]
    grammar = secrets.Grammar([("own", make()) for _ in range(200)])
    value = next(v for v in (make() for _ in range(50)) if grammar.accepts(v))
    blob = "A" * 3000 + "/"
    for text, at in [(f"{blob}{value}", len(blob)), (f"url=/x/{value}/y", 7), (f"{'z' * 700}{value}{'q' * 700}", 700)]:
        assert ("format", at, at + 40) in secrets.spans(text, grammar), text[:80]
    # inside a base match it is not said again; partly outside it is
    assert [k for k, *_ in secrets.spans(f"token = {value}", grammar)] == ["assign"]
    long = f"{value} " + "w " * 1_000_000 + value
    assert [s for s in secrets.spans(long, grammar) if s[0] == "format"] == [("format", 0, 40), ("format", len(long) - 40, len(long))]


def test_ordinary_words_are_no_format():
    rng = random.Random(4)
    words = tokens(rng, 300, 11, alphabet="etaoinshrdlu")
    grammar = secrets.Grammar([("own", v) for v in words[:100] + tokens(rng, 100, 11)] + [("ordinary", v) for v in words[100:200]])
    assert not any(grammar.accepts(v) for v in words[200:])


def test_recall_and_false_alarms_on_documents(spark):
    table = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text"])
    docs = [(i, t) for i, t in zip(table["doc_id"].to_pylist(), table["text"].to_pylist()) if t]
    held_out = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    train = spark.createDataFrame([d for d in docs if not held_out(d[0])], "doc_id long, text string")
    grammar = secrets.learn(train, "doc_id")
    values = {v for i, t in docs if held_out(i) for *_, v in secrets.base_spans(t)}
    # without their cue, between other words
    found = sum(any(k in ("format", "hex") and t[a:z] == v for k, a, z in secrets.spans(t, grammar)) for v in values for t in [f"left {v} right"])
    assert found >= 0.9 * len(values) and sum(map(grammar.accepts, values)) >= 0.9 * len(values)
    texts = [t for i, t in docs if held_out(i)]
    alarms = [s for t in texts for s in secrets.spans(t, grammar) if s[0] == "format"]
    assert len(alarms) * 1000 <= len(texts)


def _slow_within(grammar, value):
    """Every head and every learned length, each scored on its own."""
    if grammar.accepts(value):
        return ((0, len(value)),)
    found = {m.span() for m in secrets._PART.finditer(value) if m.end() - m.start() < len(value) and grammar.accepts(m[0])}
    for head, lengths in sorted(grammar.heads.items()):
        for at in range(len(value)):
            if value.startswith(head, at) and not any(a <= at < z for a, z in found):
                ends = [len(value), *(at + n for n in sorted(lengths, reverse=True) if at + n < len(value))]
                end = next((z for z in ends if z - at >= secrets.MIN_CANDIDATE and grammar.accepts(value[at:z])), None)
                found |= set() if end is None else {(at, end)}
    return tuple(sorted(found))


def test_runs_of_prefixes():
    """As when every start is scored on its own; a long run of a learned prefix takes time in proportion."""
    rng = random.Random(11)
    letters, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    draw = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    kinds = [lambda: "ghp_" + draw(letters + letters.upper() + digits, 36), lambda: "sk_" + draw(letters + digits, rng.choice([24, 200])), lambda: draw("abcdef" + digits, rng.choice([32, 64])), lambda: "AKIA" + draw(letters.upper() + digits, 16)]
    grammar = secrets.Grammar([(str(i), make()) for i, make in enumerate(kinds) for _ in range(60)] + [(secrets.ORDINARY, draw("etaoinshr", rng.randint(8, 14))) for _ in range(100)])
    hits = 0
    for _ in range(400):
        value = "".join(rng.choice(kinds)() if rng.random() < 0.5 else rng.choice(["ghp_", "sk_", "AKIA", "=", "/", "abc-", "0" * rng.randint(1, 300), draw("abXY01_-+/=.", rng.randint(1, 200))]) for _ in range(rng.randint(1, 6)))
        if len(value) >= secrets.MIN_CANDIDATE:
            got = grammar._within(value, secrets.classes(value))
            hits += len(got)
            assert got == _slow_within(grammar, value)
    assert hits > 200

    def took(n):
        value = "ghp_" * (n // 4)
        start = time.process_time()
        grammar._within(value, secrets.classes(value))
        return time.process_time() - start

    assert took(1_600_000) < 40 * max(took(100_000), 0.05)  # sixteen times as long; squared it would be 256
