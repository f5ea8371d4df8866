"""Growing tables, as-of selection, rejects, load ledger and Spark's listing on odd input."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rehome.operators import rewrite as W
from rehome.sinks import load as L
from rehome.sinks.snapshot import common_type, drop_snapshot, newest_rows, save_snapshot
from rehome.sources.objects import session_files


@pytest.fixture
def table(spark, request):
    name = "grown_" + "".join(c if c.isalnum() else "_" for c in request.node.name)
    yield name
    drop_snapshot(spark, name)


@pytest.mark.parametrize("a, b, wide", [
    ("int", "bigint", "bigint"), ("bigint", "decimal(5,2)", "decimal(21,2)"), ("decimal(10,2)", "decimal(8,4)", "decimal(12,4)"),
    ("decimal(38,0)", "decimal(38,10)", "string"), ("float", "double", "double"), ("int", "double", "double"), ("int", "float", "string"),
    ("bigint", "double", "string"), ("smallint", "float", "float"), ("date", "timestamp_ntz", "timestamp_ntz"), ("date", "timestamp", "string"),
    ("boolean", "int", "string"), ("string", "int", "string"), ("void", "date", "date"), ("array<int>", "array<int>", "array<int>"),
])
def test_common_types_lose_nothing(spark, a, b, wide):
    kinds = [T._parse_datatype_string(x) for x in (a, b)]
    assert common_type(*kinds).simpleString() == wide == common_type(*kinds[::-1]).simpleString()


def test_no_common_type_of_nested_values(spark):
    with pytest.raises(ValueError, match="no common type"):
        common_type(T._parse_datatype_string("array<int>"), T.IntegerType())


def test_an_append_widens_the_table(spark, table, rows):
    save_snapshot(spark.createDataFrame([(1, "a"), (None, "b")], "k INT, s STRING"), table)
    assert save_snapshot(spark.createDataFrame([(3000000000, 7)], "K LONG, n INT"), table, "append").rows == 1
    assert rows(spark.table(table), "k", "s", "n") == sorted([(1, "a", None), (None, "b", None), (3000000000, None, 7)], key=repr)
    save_snapshot(spark.createDataFrame([(Decimal("0.5"), "c")], "k DECIMAL(3,1), s STRING"), table, "append")
    assert spark.table(table).schema["k"].dataType == T.DecimalType(20, 1)
    save_snapshot(spark.createDataFrame([("x", True)], "k STRING, s BOOLEAN"), table, "append")
    assert rows(spark.table(table), "k") == sorted([("1.0",), (None,), ("3000000000.0",), ("0.5",), ("x",)], key=repr)
    save_snapshot(spark.createDataFrame([(5,)], "k INT"), table, "append")  # a narrower value takes the table's type
    assert ("5",) in rows(spark.table(table), "k") and not spark.catalog.tableExists(table + "__staging")


def test_a_failed_widening_leaves_the_table(spark, table, rows):
    save_snapshot(spark.createDataFrame([(1,)], "k INT"), table)
    bad = spark.range(3).select(F.when(F.col("id") < 2, F.col("id")).otherwise(F.raise_error(F.lit("no"))).cast("bigint").alias("k"))
    with pytest.raises(Exception):
        save_snapshot(bad, table, "append")
    assert rows(spark.table(table), "k") == [(1,)]


def test_newest_rows_of_ties_nulls_and_nothing(spark, rows):
    df = spark.createDataFrame(
        [("a", 1, "x"), ("a", 3, "old"), ("a", 3, "z"), ("a", 9, "later"), (None, 2, "n"), (None, None, "m"), ("b", None, "only"), ("c", 9, "later")],
        "k STRING, t INT, v STRING")
    assert rows(newest_rows(df, ["k"], 3, "t")) == sorted([("a", 3, "z"), (None, 2, "n"), ("b", None, "only")], key=repr)
    assert rows(newest_rows(df, ["k"], None, "t")) == sorted([("a", 9, "later"), (None, 2, "n"), ("b", None, "only"), ("c", 9, "later")], key=repr)
    assert newest_rows(df.limit(0), ["k"], 3, "t").isEmpty()


def test_one_key_with_most_of_the_rows_is_reduced_before_the_shuffle(spark):
    df = spark.range(100000).select(F.lit("hot").alias("k"), F.col("id").alias("t"), F.col("id").alias("v"))
    plan = newest_rows(df, ["k"], 99, "t")._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in plan
    assert newest_rows(df, ["k"], 99, "t").first()["v"] == 99


def test_rejects(spark, rows):
    df = spark.createDataFrame([(1, "x", True, [1]), (2, "7", None, None), (3, None, False, [2])], "id INT, `a b` STRING, f BOOLEAN, l ARRAY<INT>")
    lost = L.conversion_rejects(df, "id INT, `a b` INT, f INT", ["id"])
    assert rows(lost) == sorted([(1, "a b", "x", "int"), (1, "f", "true", "int"), (3, "f", "false", "int")], key=repr)
    assert L.conversion_rejects(df.limit(0), "f INT", ["id"]).isEmpty()


def test_a_load_goes_on_where_it_stopped(spark, tmp_path, rows):
    for db in ("led_source", "led_target"):
        spark.sql(f"CREATE DATABASE {db} LOCATION '{tmp_path / db}'")
    for name in "abc":
        spark.range(3).write.saveAsTable(f"led_source.s_{name}")
    tables = spark.createDataFrame([("s", name) for name in "abcd"], "schema STRING, name STRING")
    options = dict(source_database="led_source", target_database="led_target", retries=0, load_id="it's one")
    status = lambda: dict(rows(L.bulk_load(spark, tables, **options), "table", "status"))
    assert sorted(status().values()) == ["failed", "loaded", "loaded", "loaded"]
    spark.sql("DROP TABLE led_target.s_b")
    spark.range(5).write.saveAsTable("led_source.s_d")
    again = L.bulk_load(spark, tables, **options)
    assert rows(again, "table", "status", "rows") == [("led_target.`s_a`", "done", 3), ("led_target.`s_b`", "loaded", 3), ("led_target.`s_c`", "done", 3), ("led_target.`s_d`", "loaded", 5)]
    assert set(dict(rows(L.bulk_load(spark, tables, **options | {"load_id": "two"}), "table", "status")).values()) == {"loaded"}
    for db in ("led_source", "led_target"):
        spark.sql(f"DROP DATABASE {db} CASCADE")


def test_listing_by_the_session(spark, tmp_path):
    for name, text in (("r 1/[x]/a.txt", "1"), ("r 1/[x]/deep/b#.txt", "22"), ("r 1/_hidden/c", "3"), ("r{2}/d", "4444")):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    roots = spark.createDataFrame([(str(tmp_path / "r 1") + "/",), (str(tmp_path / "r{2}"),), (str(tmp_path / "none"),)], "base_path STRING")
    found = session_files(roots, strict=False, roots_each=2).collect()
    assert sorted((r["root"].rsplit("/", 1)[1], r["path"].rsplit("/", 1)[1], r["size"]) for r in found if r["error"] is None) == [("r 1", "a.txt", 1), ("r 1", "b#.txt", 2), ("r{2}", "d", 4)]
    assert [r["root"].rsplit("/", 1)[1] for r in found if r["error"]] == ["none"]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        session_files(roots)
    assert session_files(roots.limit(0)).isEmpty()


def test_references_in_sql(spark, rows):
    W.register_table_functions(spark, "refs_here")
    text = '{"linkedService":{"properties":{"type":"Lakehouse","typeProperties":{"artifactId":"x","workspaceId":5}}},"externalReferences":{"connection":"c"}}'
    spark.createDataFrame([("a", text), ("b", "no json"), ("c", None)], "doc_id STRING, definition STRING").createOrReplaceTempView("odd_definitions")
    found = spark.sql("SELECT d.doc_id, r.* FROM odd_definitions d, LATERAL refs_here(d.definition) r")
    assert rows(found) == rows(W.extract_refs(spark.table("odd_definitions"))) and found.count() == 2
