"""The short way to the sample of a term of weight 1."""

import math

from pyspark.sql import functions as F

from rasterweave.llm import fingerprints


def test_single_is_the_sample_of_weight_one(spark):
    rows = spark.range(20_000).select(F.xxhash64("id").alias("h"))
    both = rows.select(fingerprints._single(F.col("h")).alias("a"), fingerprints._sample(F.col("h"), F.lit(1)).alias("b"))
    assert both.where("a IS NULL OR a <> b").count() == 0
    assert both.select("a").distinct().count() == 20_000


def test_ranks_need_no_bounds():
    least, most = -math.log((0.5 / 2**32) ** 2), -math.log((1 - 0.5 / 2**32) ** 2)  # greatest and least gamma draw
    assert math.log(most) - math.log(fingerprints.PIECE) - least > -96 and math.log(least) < 32
