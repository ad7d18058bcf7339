import random

import numpy as np
import pytest
from brute import BENCH_WORD, FOLD
from brute import decontaminate as brute

from emberlog.llm import decontaminate
from emberlog.llm.fm_index import FMIndex, WaveletTree, suffix_array


def test_wavelet_ranks():
    rng = np.random.default_rng(1)
    text = rng.integers(0, 11, 500)
    tree = WaveletTree(text, 11)
    at, c = rng.integers(0, 501, 300), rng.integers(0, 11, 300)
    assert tree.rank(c, at).tolist() == [int((text[:i] == x).sum()) for i, x in zip(at, c)]
    symbol, before = tree.access(np.arange(500))
    assert symbol.tolist() == text.tolist() and before.tolist() == [int((text[:i] == x).sum()) for i, x in enumerate(text)]


def test_suffix_array_and_search():
    rng = random.Random(2)
    for _ in range(50):
        text = np.array([x for _ in range(6) for x in [*(rng.randint(1, 3) for _ in range(rng.randint(1, 12))), 0]])
        ranks = np.where(text == 0, np.cumsum(text == 0) - 1, text + 10).astype(np.int64)
        assert suffix_array(ranks).tolist() == sorted(range(len(text)), key=lambda i: ranks[i:].tolist())
        index = FMIndex(text, 4, sample=3)
        pattern = np.array([[rng.randint(1, 3) for _ in range(3)]])
        low, high = index.search(pattern, np.array([3]))
        want = [i for i in range(len(text) - 2) if text[i : i + 3].tolist() == pattern[0].tolist()]
        assert sorted(index.locate(np.arange(low[0], high[0])).tolist()) == want


def found(spark, docs, items, **kw):
    left = spark.createDataFrame([(i, t, 7) for i, t in enumerate(docs)], "doc_id long, text string, items int")
    right = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.find(left, right, **kw).orderBy("doc_id").collect()
    return [(r.n_words, r.n_hit, list(r["items"])) for r in rows], rows


@pytest.mark.parametrize("windows", [200_000, 3])
def test_as_brute_force(spark, monkeypatch, windows):
    monkeypatch.setattr(decontaminate, "MAX_WINDOWS", windows)
    rng = random.Random(windows)
    text = lambda a, b: " ".join(rng.choice("abcdé") for _ in range(rng.randint(a, b)))
    items = [(i, text(0, 9)) for i in range(5)] + [(9, None), (None, "e a e a"), (3, text(4, 6))]
    docs = [text(0, 50) for _ in range(30)] + [None, "", "!!", "A-B c.D", "a " * 5000]
    assert found(spark, docs, items, width=4)[0] == brute(docs, items, 4)


def test_empty_tables(spark):
    assert found(spark, ["a b"], [])[0] == [(2, 0, [])]
    assert found(spark, [], [(1, "a b")])[0] == []


def test_spans_are_removed(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    doc = "Before it.\nOne, two three four five six seven eight nine ten eleven twelve THIRTEEN! After it."
    _, rows = found(spark, [doc], [(1, item)])
    spans = [(s.start, s.end) for s in rows[0].spans]
    assert spans == [(2, 15)]
    assert BENCH_WORD.findall(decontaminate.without_spans(doc, spans).translate(FOLD)) == ["before", "it", "after", "it"]


def test_whole_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    got = decontaminate.find(docs, bench).orderBy("doc_id").collect()
    want = brute([r.text for r in got], [tuple(r) for r in bench.select("item_id", "text").collect()])
    assert [(r.n_words, r.n_hit, list(r["items"])) for r in got] == want and any(h for _, h, _ in want)


def test_slices_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "MAX_WINDOWS", 10)
    items = [(i, "the very same text of every item " * 2) for i in range(30)] + [(99, " ".join(f"w{i}" for i in range(100)))]
    made = list(decontaminate.slices(spark.createDataFrame(items, "item_id long, text string"), "item_id", "text", 13))
    assert all(sum(map(len, names)) <= 10 and len(patterns) <= 10 for _, patterns, _, names in made)
    assert {n for *_, names in made for own in names for n in own} == {str(i) for i, _ in items}
    docs = [items[0][1], items[-1][1], "nothing"]
    assert found(spark, docs, items)[0] == brute(docs, items)


def test_very_long_text_and_columns_of_any_name(spark):
    rng = random.Random(3)
    item = " ".join(f"b{i}" for i in range(40))
    long = " ".join(rng.choice(["b1", "b2", "x", "y"]) for _ in range(300_000)) + " " + item
    names = ["given", "_searched_text", "spans", "n_hit", "a.b"]
    df = spark.createDataFrame([(1, long, *"abcde"), (2, None, *"abcde")], ["doc_id", "text", *names])
    rows = decontaminate.find(df, spark.createDataFrame([(7, item)], "item_id long, text string")).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_hit, list(r["items"])) for r in rows] == brute([long, None], [(7, item)])
    assert [(r.given, r._searched_text, r["a.b"], r.text) for r in rows] == [("a", "b", "e", long), ("a", "b", "e", None)]


def test_many_passes_hold_one_table(spark, monkeypatch):
    """Half a million windows in scale, by patched bounds: each pass's table goes when the next is written."""
    monkeypatch.setattr(decontaminate, "MAX_WINDOWS", 40)
    rng = random.Random(12)
    items = [(i, " ".join(f"v{rng.randint(0, 60)}" for _ in range(60))) for i in range(12)]
    docs = [" ".join([*(f"v{rng.randint(0, 60)}" for _ in range(20)), *items[rng.randrange(12)][1].split()[5:30]]) for _ in range(20)]
    from pathlib import Path

    from emberlog.session import shared_folder

    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = set(folder.glob("*-searched"))
    assert found(spark, docs, items)[0] == brute(docs, items)
    assert len(set(folder.glob("*-searched")) - before) == 1
    pairs = decontaminate.window_pairs(spark.createDataFrame([*items, items[0]], "item_id long, text string"), "item_id", "text", 13)
    assert pairs.count() == len({(i, tuple(t.split()[k : k + 13])) for i, t in items for k in range(48)}) > 10 * 40
