"""From documents to token ids: language, near copies, benchmark leaks, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the
last return the columns of documents. A rejected row is gone for the stages after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterweave.llm import bpe, decontam, jaccard, langid, secrets_crf
from rasterweave.llm.graph import stored
from rasterweave.llm.tokens import fresh

#: A document goes if its language is undetermined or scored below this: 0 for a text that does not fit the language that won; one that fits scores near 1, a mixture of two near one half.
LEAST_SCORE = 0.2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those that no learned language fits, go."""
    predict = langid.predictor(spark, langid.train(docs))
    own = fresh(docs, "_language")
    found = docs.withColumn(own, predict("text"))
    return found.where((F.col(own)["lang"] != langid.UNDETERMINED) & (F.col(own)["score"] >= LEAST_SCORE)).drop(own)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links connect stays, the one with the least id: five-word shingles, eight tenths alike."""
    return jaccard.keep_one(spark, docs, size=5, similarity=80)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return decontam.decontaminate(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are cut from texts; n_chars is that of the text that is left."""
    columns = docs.columns
    clean = secrets_crf.redact(docs, secrets_crf.scanner(spark, secrets_crf.train(docs)))
    if "n_chars" in columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids and intact: whether the ids decode to the text."""
    import public_tokenizers

    coded = bpe.encoded(spark, docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.withColumn("n_tokens", F.size("ids").cast("bigint"))


STAGES = [
    ("language_id", language),
    ("ngram_jaccard_join", near_copies),
    ("benchmark_decontamination", benchmark_leaks),
    ("secret_scan", secrets),
    ("byte_level_bpe", tokens),
]

#: Language machines, string tiling, the random field and merges are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on documents, each written to the shared folder and read again as the next one's docs."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
