"""The registered queries of this subpackage: each applies one operator, as in production, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterweave.llm import decontam, jaccard, langid, lm, secrets_crf, toxicity
from rasterweave.llm.bpe import digests
from rasterweave.llm.fingerprints import fingerprints
from rasterweave.llm.html_blocks import extract
from rasterweave.llm.oracles import ORACLES
from rasterweave.llm.sharding import shard


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the documents that labels call good."""
    good = _read(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    found = lm.score(spark, _read(spark, sf_dir, "documents"), good)
    return found.select("doc_id", "n_tokens", *[F.round(c, 6).alias(c) for c in ("ce_target", "ce_background", "score")])


def op2_toxicity_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    score = toxicity.scorer(spark, toxicity.train(docs, labels))
    scored = docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))


def op3_greedy_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item that it leaks."""
    found = decontam.with_leaks(spark, _read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("_leaks").alias("x")).select("doc_id", "x.*")


def op4_line_block_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("main_text")
    return extract(_read(spark, sf_dir, "pages")).select("page_id", "url", text.alias("text"), F.length(text).cast("bigint").alias("n_chars"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    predict = langid.predictor(spark, langid.train(docs))
    found = docs.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), predict("text").alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(spark, _read(spark, sf_dir, "documents"))


def op7_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(_read(spark, sf_dir, "documents"))


def op8_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(spark, _read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard(_read(spark, sf_dir, "documents"), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op10_secret_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    scan = secrets_crf.scanner(spark, secrets_crf.train(docs))
    found = docs.select("doc_id", scan("text").alias("found"))
    of = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint")
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("found", lambda s: s["kind"] != "crf")
    return found.select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(line(base).cast("binary"), 256).alias("base_sha256"), line(F.col("found")).alias("spans"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_cross_entropy_difference": op1_cross_entropy_difference,
    "op2_toxicity_machine": op2_toxicity_machine,
    "op3_greedy_string_tiling": op3_greedy_string_tiling,
    "op4_line_block_extraction": op4_line_block_extraction,
    "op5_language_id": op5_language_id,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_weighted_fingerprints": op7_weighted_fingerprints,
    "op8_byte_level_bpe": op8_byte_level_bpe,
    "op9_rendezvous_sharding": op9_rendezvous_sharding,
    "op10_secret_crf": op10_secret_crf,
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
