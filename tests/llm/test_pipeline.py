import random
import zlib

import brute
import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from emberlog.llm import language_id
from emberlog.llm.common import tokenizer_path

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def planted():
    rng = random.Random(12)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "re", "so") for b in ("ban", "dor", "fel", "gim", "hut", "jor")]
    para = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = "\n".join(para(12) for _ in range(12))
    near = base.split(" ")
    near[40] = "changed"
    passage = "\n".join(para(9) for _ in range(30))
    clean = [(9000 + i, "\n".join(para(rng.randint(5, 15)) for _ in range(6))) for i in range(10)]
    return {
        "rows": [(9100, base), (9101, base), (9102, " ".join(near)), (9103, None), (9104, ""), (9105, "12 34 !!"), (9106, f"{para(20)}\n{passage}"), (9107, f"{passage}\n{para(20)}"), *clean],
        "clean": {i for i, _ in clean},
    }


def as_brute_force(docs, bench):
    """(doc_id, text) that reach packing, and the ids after each stage."""
    kept = [(i, t) for i, t in docs if t is not None and any(c.isalpha() for c in t)]
    steps = [{i for i, _ in kept}]
    before = dict(kept)
    kept = [(i, t) for i, t, gone in brute.line_runs(kept) if not gone or brute.SPACE_WORD.search(t)]
    steps.append({i for i, _ in kept})
    component = {i: c for i, _, c in brute.ngram_join(kept, 5, 80, 100)}
    kept = [(i, t) for i, t in kept if component[i] == i]
    steps.append({i for i, _ in kept})
    hits = brute.decontaminate([t for _, t in kept], bench)
    kept = [d for d, (n, h, _) in zip(kept, hits) if not (h and 20 * h >= n)]
    steps.append({i for i, _ in kept})
    return kept, steps, before


def test_stages_and_run_as_brute_force(spark, tmp_path):
    sf = str(tmp_path)
    own = planted()
    extra = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in own["rows"]], SCHEMA)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    docs.unionByName(extra).coalesce(3).write.parquet(f"{sf}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{sf}/benchmark.parquet")
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept, steps, _ = as_brute_force(rows, bench)

    now, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, now, sf)
        assert out.schema.simpleString() == now.schema.simpleString(), name
        out.write.parquet(f"{sf}/stage{k}")
        now = spark.read.parquet(f"{sf}/stage{k}")
        seen.append({r.doc_id for r in now.select("doc_id").collect()})
    assert seen == steps
    assert own["clean"] <= steps[-1] and 9100 in steps[-1] and not {9101, 9103, 9104, 9105} & steps[-1]
    last = {r.doc_id: (r.text, r.n_chars) for r in now.collect()}
    assert {i: t for i, (t, _) in last.items()} == dict(kept) and all(len(t) == n for t, n in last.values())

    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = set()
    for i, t in kept:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        want |= {(i, s, len(p), zlib.crc32(np.array(p, "<u4").tobytes()), len(ids)) for s in range(0, len(ids), 2048) for p in [ids[s : s + 2048]]}
    got = corpus_pipeline.run(spark, sf).collect()
    assert {(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got} == want and len(got) == len(want)
    # one sequence more than the fewest that can hold all ids, at most
    assert brute.padding([(r.sequence_id, r.offset, r.length) for r in got]) <= 2048 + -sum(r.length for r in got) % 2048


def test_each_group_of_near_copies_keeps_one_row(spark, tmp_path):
    text = "some words that repeat and more of them so that the set is no small one " * 3
    rows = [(5, text, "en", "a", 1), (5, text, "en", "b", 1), (5, "a clean text under the same id", "en", "a", 1), (7, text + " end", "en", "a", 1)]
    rows += [(None, text, "en", "a", 1), (None, "a clean text without an id", "en", "a", 1), (None, None, "en", "a", 1), (None, None, "en", "a", 1), (8, "", "en", "a", 1)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], f"{SCHEMA}, node int, key int")
    got = corpus_pipeline.join_near_duplicates(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(5, text), (5, rows[2][1]), (None, rows[5][1]), (None, None), (None, None), (8, "")], key=str)


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    sf = str(tmp_path)
    names = ["n_words", "spans", "items", "n_chunks", "n_removed", "_lang", "lang_pred", "score", "held_out", "component_id", "_key", "_searched_text"]
    docs = spark.createDataFrame([(i, f"text number {i} has words of its own {i * 7919}", "en", "s", 5, *["x"] * len(names)) for i in range(30)], f"{SCHEMA}, " + ", ".join(f"{n} string" for n in names))
    spark.createDataFrame([(1, "a benchmark item of some words")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert {tuple(r[n] for n in names) for r in out.collect()} == {("x",) * len(names)}, name
    assert corpus_pipeline.pack_sequences(spark, docs, sf).count() == 30


def test_empty_table(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_stage_names_follow_the_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_join", "decontamination", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None and language_id.UNKNOWN == "und"
