import random

import pytest
from brute import ngram_join as brute
from brute import thue_morse

from emberlog.llm import ngram_join


def near_copies(rng, words, n, edits):
    out = []
    for _ in range(n):
        own = list(words)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(len(own))] = f"new{rng.randint(0, 9999)}"
        out.append(" ".join(own))
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = []
    for size in (40, 90, 200):
        words = [rng.choice(vocabulary) for _ in range(size)]
        texts += near_copies(rng, words, 25, 6)
    texts += [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 30))) for _ in range(30)]
    texts += ["", None, "a", "A", "a b", "A  b", "a b c", "a\nb\tc", "x " * 3000, "X " * 2999]
    rng.shuffle(texts)
    return [(3 * i + 1, t) for i, t in enumerate(texts)]


def result(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("text", "text")
    return sorted((tuple(r) for r in ngram_join.join(df, **kw).collect()), key=str)


@pytest.mark.parametrize("block", [256, 4])
def test_as_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = corpus(block)
    assert result(spark, rows) == brute(rows)


def test_five_words_at_four_fifths(spark):
    rows = corpus(9)
    assert result(spark, rows, width=5, num=80, den=100) == brute(rows, 5, 80, 100)


def test_frequent_shingles_only_change_the_order(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "MAX_FREQUENT", 3)
    rows = corpus(11)[:80]
    assert result(spark, rows) == brute(rows)


def test_nulls_and_repeated_ids(spark):
    rows = [(None, "one two three four"), (5, "one two three four"), (5, "one two three four"), (5, "something else entirely here"), (None, None), (2, ""), (None, "only without id")]
    assert result(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert result(spark, []) == []


def test_words_that_polynomials_confuse(spark):
    rows = [(2 * n + k, word) for n in range(6, 13) for k, word in enumerate(thue_morse(n))]
    rows += [(100 + i, f"{w} and the same words behind it") for i, w in enumerate(thue_morse(10))]
    assert result(spark, rows) == brute(rows)


@pytest.mark.parametrize("one_id", [7, None])
def test_many_texts_under_one_id(spark, monkeypatch, one_id):
    held = {}
    real = ngram_join.materialize

    def watched(df, name):
        out = real(df, name)
        held[name] = out.count()
        return out

    monkeypatch.setattr(ngram_join, "materialize", watched)
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 50)}" for _ in range(80)]
    rows = [(one_id, t) for t in near_copies(rng, base, 300, 3)] + [(one_id, "twice the same text")] * 40
    assert result(spark, rows) == brute(rows)
    assert held["texts"] <= 301


@pytest.mark.parametrize("elements", [1, 200])
def test_blocks_by_elements(spark, monkeypatch, elements):
    monkeypatch.setattr(ngram_join, "BLOCK_ELEMENTS", elements)
    rows = corpus(21)
    assert result(spark, rows) == brute(rows)


def test_small_clusters_of_one_template(spark, monkeypatch):
    # all share most words, so one family holds them all, but only the few copies of each link
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    rng = random.Random(31)
    template = [f"w{i}" for i in range(60)]
    texts = []
    for k in range(25):
        own = template[:10] + [f"own{k}x{i}" for i in range(8)] + template[10 + k : 45 + k]
        texts += near_copies(rng, own, 3, 1)
    rows = list(enumerate(texts))
    assert result(spark, rows) == brute(rows)


def test_a_column_that_the_result_has(spark):
    df = spark.createDataFrame([(1, "a b c d", 5, 6, 7), (2, "a b c d", 5, 6, 7)], "doc_id long, text string, component_id int, node int, key int")
    assert sorted(map(tuple, ngram_join.join(df).collect())) == [(1, 2, 1), (2, 2, 1)]


def test_very_long_texts_as_brute_force(spark):
    """Texts of tens of thousands of words, near copies and halves among them."""
    rng = random.Random(31)
    words = [f"w{rng.randint(0, 20_000)}" for _ in range(40_000)]
    copies = near_copies(rng, words, 3, 400)
    rows = [(1, " ".join(words)), *enumerate(copies, 2), (7, " ".join(words[:20_000])), (8, " ".join(words[:38_500])), (9, " ".join(words[:30_000])), (10, "w1 w2"), (11, None)]
    assert result(spark, rows) == brute(rows)
