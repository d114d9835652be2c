"""The pipeline on planted documents, stage by stage."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import corpus_pipeline

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """60 clean documents, 60 toxic ones, near copies of clean ones, and documents with a benchmark item in parts."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randrange(3, 8)))
    clean = [[word() for _ in range(60)] for _ in range(60)]
    item = [word() for _ in range(24)]
    texts = {i: " ".join(w) for i, w in enumerate(clean)}
    for i in range(60):
        w = [word() for _ in range(40)]
        w[rng.randrange(40)] = "vilestinsult"
        texts[100 + i] = " ".join(w)
    texts |= {200 + i: " ".join(clean[i] + ["more"]) for i in range(10)} | {300: texts[0]}
    texts |= {400: " ".join(clean[30][:5] + item[12:] + [word() for _ in range(20)] + item[:12]).upper(), 401: " ".join([word() for _ in range(40)] + item[:7])}
    texts |= {500: "", 501: None}
    rows = [(i, t, "en", "big" if i % 3 else "small", len(t or "")) for i, t in texts.items()]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(100 <= i < 200)) for i in texts], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, texts


def test_stages(spark, folder):
    path, texts = folder
    docs, kept = spark.read.parquet(f"{path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == COLUMNS, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept.append([r.doc_id for r in docs.collect()])
    clean = [i for i in texts if not 100 <= i < 200]
    assert sorted(kept[0]) == clean
    alone = [i for i in clean if not 200 <= i < 210 and i != 300]
    assert sorted(kept[1]) == alone
    assert sorted(kept[2]) == [i for i in alone if i != 400]
    assert set(kept[3]) == set(kept[2])


def test_run(spark, folder):
    path, texts = folder
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = corpus_pipeline.run(spark, path).collect()
    starts = sorted((r.start, r.n_tokens) for r in got)
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))
    for r in got:
        ids = [*tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 1]
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    by_start = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert by_start == sorted(by_start)


def test_empty_tables(spark, folder, tmp_path):
    path, _ = folder
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
