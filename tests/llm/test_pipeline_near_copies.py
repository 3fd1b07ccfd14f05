"""The near-copy stage against brute force over five-word shingles, eight tenths alike."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tests_llm_brute import brute_components, sets_of  # noqa: E402

SF = "/root/testdata/sf0.01"


def test_near_copies_are_five_words_and_eight_tenths(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pairs = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    least = brute_components(sets_of(pairs, 5), 80)
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, SF).select("doc_id").collect())
    assert got == sorted(d for (d, _), c in zip(pairs, least, strict=True) if d == c)


def test_an_edited_copy_between_the_thresholds_goes(spark):
    words = [f"word{i}" for i in range(54)]
    edited = [*words[:27], "other", *words[28:]]  # 45 of 55 shingles of five words are in both (over 0.8), and 49 of 55 of three (under 0.9)
    far = [*words[:20], "other", *words[21:40], "another", *words[41:]]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(edited)), (3, " ".join(far))], "doc_id bigint, text string")
    assert [r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs.where("doc_id < 3"), SF).collect()] == [1]
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs.where("doc_id <> 2"), SF).collect()) == [1, 3]
