"""Repeated runs of more than 50 words, against a plain version that doesn't chunk."""

import random

import brute

import corpus_pipeline
from emberlog.llm import line_dedup, queries

WORDS = 50


def repeated_lines(rows):
    """Line numbers, by id, that lie in a run of more than WORDS words that occurs earlier: all runs are tried."""
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    first, out = {}, {}
    for i, text in order:
        lines = (text or "").split("\n")
        count = [len(brute.SPACE_WORD.findall(x)) for x in lines]
        for a in range(len(lines)):
            for z in range(a, len(lines)):
                if sum(count[a : z + 1]) > WORDS:
                    first.setdefault(tuple(lines[a : z + 1]), (i, a))
    for i, text in order:
        lines, lost = (text or "").split("\n"), set()
        count = [len(brute.SPACE_WORD.findall(x)) for x in lines]
        for a in range(len(lines)):
            for z in range(a, len(lines)):
                if sum(count[a : z + 1]) > WORDS and (at := first[tuple(lines[a : z + 1])]) != (i, a):
                    lost |= set(range(max(a, at[1] + z + 1 - a) if at[0] == i else a, z + 1))
        out[i] = {k for k in lost if count[k]}
    return out


def expected(rows):
    """Words of each text that stay: neither in a repeated chunk nor in a repeated run."""
    runs, seen, out = repeated_lines(rows), set(), {}
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        lost, at = set(runs[i]), 0
        for c in brute.chunks(text or ""):
            whole, own = "\n".join(c), set(range(at, at + len(c)))
            at += len(c)
            if len(c) > 1:
                lost |= own if whole in seen else set()
                seen.add(whole)
        out[i] = [x for k, x in enumerate((text or "").split("\n")) if k not in lost and x.strip()]
    return out


def contexts(seed):
    """Passages of 2 to 6 short lines, each in three different surroundings, and overlapping ones."""
    rng = random.Random(seed)
    line = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
    rows, planted = [], []
    for n in range(2, 7):
        for _ in range(12):
            passage = [line(rng.randint(51 // n + 1, 50)) for _ in range(n)]
            planted.append(passage)
            rows += ["\n".join([line(rng.randint(1, 20)) for _ in range(rng.randint(1, 4))] + passage + [line(rng.randint(1, 20)) for _ in range(rng.randint(1, 4))]) for _ in range(3)]
    long = [line(rng.randint(5, 60)) for _ in range(20)]
    rows += ["\n".join(long[a : a + rng.randint(3, 12)] + [line(4)]) for a in range(12)]
    edge = [line(25), line(25), line(1)]
    rows += ["\n".join([line(3), *edge[:2], line(3)]), "\n".join([line(3), *edge[:2], line(2)]), "\n".join([line(3), *edge]), "\n".join([*edge, line(2)])]
    same = line(26)
    rows += ["\n".join([same] * 5), "\n".join([line(3), same, same, line(3)]), f"{long[0]}\n\n\n{long[1]}\n{long[2]}", f"x\n{long[0]}\n\n\n{long[1]}\n{long[2]}"]
    rng.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)] + [(9000, None), (9001, "")], planted


def test_repeated_runs_go_whole(spark):
    for seed in (1, 2):
        rows, planted = contexts(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = {r.doc_id: r for r in line_dedup.dedup(df, run_words=WORDS).collect()}
        assert {i: [x for x in (r.text or "").split("\n") if x.strip()] for i, r in got.items()} == expected(rows)
        assert all((r.n_removed > 0) == (r.text != t) and r.n_removed <= r.n_chunks for i, t in rows for r in [got[i]])
        for passage in planted:
            assert [sum(x in (r.text or "").split("\n") for r in got.values()) for x in passage] == [1] * len(passage)


def test_whole_copies_go(spark):
    rng = random.Random(7)
    line = lambda: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(1, 6)))
    texts = ["\n".join(line() for _ in range(rng.randint(2, 7))) for _ in range(40)]
    rows = list(enumerate(texts + texts + ["one line", "one line", None, None, texts[0] + "\nand more"]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.dedup(df, run_words=WORDS, whole=True).collect()}
    assert all(got[i].text == texts[i] and got[40 + i].text == "" and got[40 + i].n_removed == got[i].n_chunks for i in range(40))
    assert got[80].text == got[81].text == "one line" and got[84].text.endswith("and more")


def test_query_removes_runs(spark, tmp_path):
    rows, planted = contexts(3)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op5_line_dedup(spark, str(tmp_path))
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    left = [(r.text or "").split("\n") for r in out.collect()]
    assert all(sum(x in t for t in left) == 1 for passage in planted for x in passage)


def test_pipeline_leaves_each_passage_in_one_document(spark, tmp_path):
    rows, planted = contexts(4)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.dedup_lines(spark, docs, str(tmp_path)).collect()
    held = [set(r.text.split("\n")) for r in left if r.text]
    assert all(sum(x in t for t in held) == 1 for passage in planted for x in passage)
    assert all(r.n_chars == len(r.text or "") for r in left)
