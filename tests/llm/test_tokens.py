"""Token counts and token files against the tokenizers library itself."""

import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusloom.llm.encoder import Encoder
from corpusloom.llm.token_counts import token_counts
from corpusloom.llm.token_files import read_token_files, token_file_digest, write_token_files

BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
AWKWARD = ["", None, " ", "  a  b ", "a,b", "!!,, x", "it's, I'll", "<|endoftext|>a <|endoftext|>", "a  b  c", "É, é ̈x", "\n\n x\t\ty\r\n", "a\x1cb !\x1c!", "İ, Σας ΣΑΣ", "日本 語、x", "x" * 5000, "a " * 20000, "0123,45 6"]


@pytest.fixture(scope="module")
def encoders():
    return [(Encoder(p, w), Tokenizer.from_file(p)) for p, w in ((BYTE, True), (WORD, False))]


@given(st.lists(st.one_of(st.text(alphabet="ab,.' \n éÀ×!0<|>̈\x1c", max_size=30), st.text(max_size=20)), max_size=5))
@settings(max_examples=500, deadline=None)
def test_pieces_encode_as_whole_texts(encoders, texts):
    for mine, theirs in encoders:
        whole = [theirs.encode(t, add_special_tokens=False).ids for t in texts]
        assert mine.counts(texts) == [len(x) for x in whole]
        mine.known.clear(), mine.older.clear()
        assert [np.frombuffer(x, "<u4").tolist() for x in mine.ids(texts)] == whole
        mine.known.clear(), mine.older.clear()


def rows(spark, texts, ids=None):
    ids = ids or list(range(len(texts)))
    return spark.createDataFrame([(i, t, "x") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, digest string")


def test_counts_of_awkward_texts(spark, tmp_path):
    texts = AWKWARD + AWKWARD[:6] + ["same text"] * 50
    tok = Tokenizer.from_file(BYTE)
    want = sorted((i, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts))
    got = token_counts(rows(spark, texts), BYTE, str(tmp_path / "cache")).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    cache = spark.read.parquet(str(tmp_path / "cache"))
    assert cache.count() == len({t or "" for t in texts})


def test_only_misses_are_encoded(spark, tmp_path):
    cache = str(tmp_path / "cache")
    token_counts(rows(spark, ["a b", "c d e"]), BYTE, cache).collect()
    spark.createDataFrame([(r.digest, 1000 + r.n_tokens) for r in spark.read.parquet(cache).collect()], "digest binary, n_tokens long").write.parquet(cache + "2")
    got = token_counts(rows(spark, ["a b", "new one", "new one"]), BYTE, cache + "2").orderBy("doc_id").collect()
    assert [r.n_tokens for r in got] == [1002, 2, 2]  # the stored count is taken as it stands
    assert spark.read.parquet(cache + "2").count() == 3


def test_empty_tables(spark, tmp_path):
    assert token_counts(rows(spark, []), BYTE, str(tmp_path / "c")).count() == 0
    write_token_files(rows(spark, []), str(tmp_path / "o"), WORD)
    assert token_file_digest(spark, str(tmp_path / "o")).count() == 0


def test_token_files_round_trip(spark, tmp_path):
    texts = AWKWARD + ["same text"] * 5
    ids = [*range(len(AWKWARD), 0, -1), *[7] * 5]
    out = str(tmp_path / "ids")
    write_token_files(rows(spark, texts, ids), out, WORD)
    tok = Tokenizer.from_file(WORD)
    want, start = [], 0
    for i, t in sorted(zip(ids, texts, strict=True), key=lambda x: (x[0], x[1] or "")):
        x = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start += len(x)
    assert sorted(map(tuple, token_file_digest(spark, out).select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == sorted(want)
    one = read_token_files(spark, out).filter("doc_id = 3").select("doc_id", "n_tokens")
    assert one.count() == 1
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,3)" in plan and "ReadSchema: struct<doc_id:bigint,n_tokens:bigint>" in plan  # pruned by statistics and Bloom filter, ids unread
