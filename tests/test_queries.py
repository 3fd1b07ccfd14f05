"""Every query of the raster engine against its DuckDB SQL, and negative controls."""

import oracle
import pytest
from pyspark.sql import functions as F

from rasterweave.plans.oracles import ORACLES
from rasterweave.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert oracle.differences(QUERIES[name](spark, SF), ORACLES[name], SF) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", ["d3_over_composite", "p4_mip_pyramid", "a5_luminance_chroma", "e5_bilinear"])
def test_a_perturbed_result_is_told(spark, name):
    out = QUERIES[name](spark, SF)
    column = next(c for c, t in out.dtypes if t == "double")
    assert oracle.differences(out.withColumn(column, F.col(column) + 1e-3), ORACLES[name], SF)


def test_a_reversed_depth_order_is_told(spark):
    from rasterweave.operators import deep
    from rasterweave.plans import adapters
    from rasterweave.plans.queries import TIES, rounded

    turned = adapters.deep(spark, SF).withColumn("z", -F.col("z")).withColumn("zback", -F.col("zback"))
    assert oracle.differences(rounded(deep.composite(turned, TIES)), ORACLES["d3_over_composite"], SF)


def test_partitions_do_not_matter(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    one = oracle.norm(QUERIES["d3_over_composite"](spark, SF).toPandas())
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    eight = oracle.norm(QUERIES["d3_over_composite"](spark, SF).toPandas())
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert one == eight


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
