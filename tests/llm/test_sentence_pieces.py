"""Encoding and decoding against the library."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece as spm

from emberlog.llm import queries, sentence_pieces
from emberlog.llm.common import tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")
PARTS = [*" \n\t▁abcdefghtinr", "  ", "    ", "the", "ing", "<s>", "</s>", "<0x0A>", "🙂", "日本", "語", "\x00", "ж", " " * 20, "é", "é", "　", "<unk>"]
ODD = ["", "a", " ", "  ", "▁", " " * 300, "x" * 700, "ab" * 2000, " " * 17 + "a", "a" + " " * 40 + "b", "\x00\x01", "￿", "\U0010ffff", None]


@pytest.fixture(scope="module")
def library():
    return spm.SentencePieceProcessor(model_file=PATH)


def texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(n)] + ["".join(rng.choice("abcdef0123456789") for _ in range(rng.randint(200, 900))) for _ in range(20)]


@pytest.mark.parametrize("long, memo, piece", [(256, 1_000_000, 1 << 20), (3, 1_000_000, 1 << 20), (10_000, 7, 5)])
def test_ids_are_the_librarys(library, monkeypatch, long, memo, piece):
    monkeypatch.setattr(sentence_pieces, "LONG", long)
    monkeypatch.setattr(sentence_pieces, "SLICE_CHARS", piece)
    given = [t or "" for t in ODD] + texts(long, 600)
    enc = sentence_pieces.PieceEncoder(PATH, memo)
    counts, ids = enc.encode(given)
    want = library.encode(given, add_bos=True, add_eos=True)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want
    assert enc.model.decode(ids.astype(np.int64), counts) == [library.decode(w) for w in want]


def test_any_ids_decode_as_in_the_library(library):
    rng = random.Random(2)
    common = [0, 1, 2, 259, 260, 29871, 35, 100, 198, 230, 231, 232, 243]
    many = [[rng.choice(common) if rng.random() < 0.8 else rng.randrange(32000) for _ in range(rng.randint(0, 9))] for _ in range(5000)]
    model = sentence_pieces.PieceModel(PATH)
    assert model.decode(np.array(sum(many, []), np.int64), np.array(list(map(len, many)))) == [library.decode(x) for x in many]
    with pytest.raises(ValueError):
        model.decode(np.array([32000]), np.array([1]))


def test_the_query(spark, library, tmp_path):
    given = ODD + texts(5, 200)
    spark.createDataFrame([(i, t, i, "x") for i, t in enumerate(given)], "doc_id long, text string, ids long, decoded string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op12_sentence_pieces(spark, str(tmp_path)).collect()}
    want = {}
    for i, t in enumerate(given):
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    assert got == want


def test_columns_and_empty_tables(spark, library):
    df = spark.createDataFrame([(1, None, "kept"), (None, "", "kept")], "ids long, text string, source string")
    both = sentence_pieces.with_text(sentence_pieces.with_ids(df)).collect()
    assert [(r.ids, r.decoded, r.source) for r in both] == [([1, 2], "", "kept")] * 2
    assert sentence_pieces.with_text(sentence_pieces.with_ids(df.limit(0))).count() == 0
    nulls = spark.createDataFrame([(None,), ([],), ([1, library.piece_to_id("▁the"), 2],)], "ids array<int>")
    assert [r.decoded for r in sentence_pieces.with_text(nulls).collect()] == ["", "", "the"]
