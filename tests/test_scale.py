"""Hot keys: plans split them, and nothing is paired or collected in one task."""

import pytest
from pyspark.sql import functions as F

from rehome.operators import mapping as M
from rehome.operators.picks import first_rows

SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    "spark.sql.shuffle.partitions": "8",
}
N = 60_000


@pytest.fixture
def skewed(spark):
    before = {key: spark.conf.get(key, None) for key in SKEW}
    for key, value in SKEW.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def hot(spark, prefix, column="id"):
    """A third of all rows share one name."""
    key = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id"))
    return spark.range(N).repartition(8).select(
        F.concat(F.lit(prefix), F.col("id")).alias(column), F.concat(F.lit("n"), key).alias("name")
    )


def test_first_rows_reduces_before_the_shuffle(spark):
    plan = final_plan(first_rows(hot(spark, "i"), ["name"], ["id"]))
    assert "row_number(), 1, Partial" in plan and "row_number(), 1, Final" in plan


def test_hot_requests_are_split(skewed):
    items = hot(skewed, "i").select("id", F.lit("w").alias("workspaceId"), F.col("name").alias("displayName"), F.lit("T").alias("type"))
    asked = hot(skewed, "r", "rid").select("rid", F.lit("w").alias("workspace_id"), F.col("name").alias("item_name"), F.lit("T").alias("item_type"))
    found = M.resolve_item(asked, items)
    assert "skew=true" in final_plan(found)
    assert found.filter("item_id = 'NotExists'").isEmpty() and found.count() == N


def test_hot_names_do_not_pair_up(skewed):
    """20,000 old and 20,000 new items of one name: one row for each old item."""
    ws = lambda *rows: skewed.createDataFrame(rows, "Id STRING, Name STRING")
    item = lambda p, w: hot(skewed, p).select("id", F.lit("T").alias("type"), F.col("name").alias("displayName"), F.lit(w).alias("workspaceId"))
    unique = M.unique_map(item("o", "w1"), ws(("w1", "W")), item("n", "w2"), ws(("w2", "W_DR")), "_DR")
    assert "skew=true" in final_plan(unique)
    assert unique.count() == N
    assert unique.filter("ambiguous").count() == N / 3


def test_hot_references_are_split(skewed):
    key = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id"))
    refs = skewed.range(N).repartition(8).select("id", F.concat(F.lit("x"), key).alias("old_item_id"))
    ids = skewed.range(N).repartition(8).select(
        F.concat(F.lit("x"), "id").alias("old_item_id"), F.lit("n").alias("new_item_id"), F.lit(False).alias("ambiguous")
    )
    found = M.lookup_items(refs, ids)
    assert "skew=true" in final_plan(found)
    assert found.filter("status = 'mapped'").count() == N


def test_suffix_filter_reaches_the_scan(spark, tmp_path):
    rows = spark.createDataFrame([("1", "Workspace", "A_DR", "c")], "Id STRING, Type STRING, Name STRING, Capacity_Id STRING")
    rows.write.parquet(str(tmp_path / "ws"))
    ws = spark.read.parquet(str(tmp_path / "ws"))
    plan = M.workspace_map(ws, ws, "_DR")._jdf.queryExecution().executedPlan().toString()
    assert "StringEndsWith(Name,_DR)" in plan
    assert "Capacity_Id" not in plan.split("ReadSchema")[-1]
