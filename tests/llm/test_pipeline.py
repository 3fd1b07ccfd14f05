"""The pipeline against brute force of its stages."""

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from rasterweave.llm import bpe, decontam, langid, secrets_crf  # noqa: E402
from tests_llm_brute import brute_components, sets_of  # noqa: E402

SF = "/root/testdata/sf0.01"


def test_run_equals_brute_force(spark):
    import public_tokenizers as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    predict = langid.predictor(spark, langid.train(docs))
    score = {r["doc_id"]: r["p"] for r in docs.select("doc_id", predict("text").alias("p")).collect()}
    rows = [r for r in rows if score[r["doc_id"]]["lang"] != "und" and score[r["doc_id"]]["score"] >= corpus_pipeline.LEAST_SCORE]
    sets = sets_of([(r["doc_id"], r["text"]) for r in rows], 5)
    rows = [r for r, c in zip(rows, brute_components(sets, 80), strict=True) if r["doc_id"] == c]
    items = decontam.Benchmark([(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    rows = [r for r in rows if not items.leaks(r["text"])]
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == {r["doc_id"] for r in rows}
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        coder = bpe.BPE(bpe.parse_ranks(f.read()), P.PATTERN)
    for r in rows:
        text = coder.decode(__import__("numpy").array(got[r["doc_id"]]["ids"], dtype="int32")).decode()
        assert got[r["doc_id"]]["intact"]
        base = secrets_crf.base_spans(r["text"])
        assert text == r["text"] if not base and "[SECRET]" not in text else not secrets_crf.base_spans(text)


def test_stages_keep_columns_and_edges(spark):
    data = [(0, "Ein Text mit ein paar deutschen Worten darin.", "de", "s", 1), (1, None, "en", "s", None), (2, "", None, None, 0), (None, "some english words in a row here", "en", "s", 2), (4, "!!! 123", "en", "s", 7), (5, "token = abcdef0123456789 and some more english words", "en", "s", 3)]
    docs = spark.createDataFrame(data * 2, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    extra = {c: F.lit("x") for c in ("_language", "ids", "_found", "_id", "_hash", "_what", "_text_hash", "_text", "_key", "node", "item_id", "found")}
    docs = docs.withColumns(extra)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and {r[c] for r in out.collect() for c in extra} <= {"x"}
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert {r["doc_id"] for r in docs.collect()} == {0, None, 5}
    assert "[SECRET]" in docs.where("doc_id = 5").first()["text"]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(last) == 3 and all(r["intact"] for r in last)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
