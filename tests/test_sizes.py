"""What keeps large tables out of the driver and out of single tasks: joins that are not broadcast by estimate, and bounded work."""

import pytest
from pyspark.sql import functions as F

from sparkrecon.operators import similar
from sparkrecon.plans import catalogue, flows, readings  # noqa: F401


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["near_names", "company_rungs_match", "company_match", "rulings_to_ledger", "enforcement_flow"])
def test_no_table_is_broadcast_by_estimate(spark, sf, name):
    assert "BroadcastHashJoin" not in plan(catalogue.QUERIES[name](spark, sf))


def test_names_of_few_letters_that_are_not_alike_make_no_rows(spark):
    name = F.concat(F.md5(F.col("id").cast("string")), F.lit("有限公司"))
    a, b = spark.range(300).select(name.alias("a")), spark.range(300, 600).select(name.alias("b"))
    assert similar.candidates(a, "a", b, "b", 0.85).count() <= 900  # of 90,000 pairs, none alike
