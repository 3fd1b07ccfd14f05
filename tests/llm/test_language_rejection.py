"""A text in a language that was never learned, or in none, scores 0; clean held-out documents do not."""

import random

import pytest
from pyspark.sql import functions as F

from rasterweave.llm import langid

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.01"


def test_texts_that_no_learned_language_fits_go(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("text IS NOT NULL")
    r = random.Random(4)
    noise = [(-1 - i, " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(80))) for i in range(50)]
    predict = langid.predictor(spark, langid.train(docs.where("lang IN ('en', 'de')")))
    real = docs.select("doc_id", "text", "lang", langid.held_out(F.col("doc_id")).alias("held"))
    asked = real.unionByName(spark.createDataFrame(noise, "doc_id bigint, text string").withColumns({"lang": F.lit("noise"), "held": F.lit(False)}))
    got = asked.where("lang NOT IN ('en', 'de') OR held").select("lang", (predict("text")["score"] >= corpus_pipeline.LEAST_SCORE).alias("stays")).toPandas()
    stays = got.groupby("lang")["stays"].mean().to_dict()
    print(stays)
    assert stays["noise"] == 0
    assert stays["fr"] < 0.05 and stays["es"] < 0.05
    assert stays["en"] > 0.99 and stays["de"] > 0.99
    assert got["lang"].nunique() == 5, stays


def test_the_stage_drops_gibberish(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bad = docs.limit(1).withColumn("doc_id", F.lit(-1).cast("bigint")).withColumn("text", F.lit("qzxv wkjq zzvx pfqw xkcd vbnq jjqz wvxk qpzm " * 9))
    out = corpus_pipeline.language(spark, docs.unionByName(bad), SF)
    assert out.where("doc_id = -1").count() == 0
    assert out.where("doc_id <> -1").count() >= 0.995 * docs.count()
