import json
from datetime import date

import pytest

from pyspark.sql import functions as F

from rehome.plans.data import load_plan, pointer_plan, staging_plan
from rehome.plans.estate import recover_warehouses
from rehome.sinks import load as L


def test_convert_types(spark):
    df = spark.createDataFrame(
        [("7", 2.9, True, "2024-01-02 10:00:00", "x"), (" -8 ", -2.9, False, "no date", None), ("7x", None, None, None, "99999999999")],
        "a STRING, b DOUBLE, c BOOLEAN, d STRING, e STRING",
    )
    schema = "a INT, b INT, c INT, d DATE, e INT"
    got = [tuple(r) for r in L.convert_types(df, schema).collect()]
    assert got == [(7, 2, None, date(2024, 1, 2), None), (-8, -2, None, None, None), (None,) * 5]
    lost = {r["column_name"]: (r["n_values"], r["n_lost"]) for r in L.conversion_losses(df, schema).collect()}
    assert lost == {"a": (3, 1), "b": (2, 0), "c": (2, 2), "d": (2, 1), "e": (2, 2)}
    assert L.convert_types(df, "c BOOLEAN, a STRING").first()[0] is True


def test_with_retry():
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("again")
        return "done"

    assert L.with_retry(flaky, wait=0) == "done" and len(calls) == 3
    with pytest.raises(ZeroDivisionError):
        L.with_retry(lambda: 1 / 0, retries=1, wait=0)


@pytest.fixture
def databases(spark):
    for db in ("stage_db", "house_db"):
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {db}")
    yield "stage_db", "house_db"
    for db in ("stage_db", "house_db"):
        spark.sql(f"DROP DATABASE {db} CASCADE")


def test_pointers_and_bulk_load(spark, tmp_path, databases, rows):
    stage, house = databases
    for schema, n in (("dbo", 5), ("sales", 7)):
        spark.range(n).write.parquet(str(tmp_path / schema / "trips"))
    tables = spark.createDataFrame(
        [(s, "trips", str(tmp_path / s / "trips")) for s in ("dbo", "sales")] + [("dbo", "gone", str(tmp_path / "gone"))],
        "schema STRING, name STRING, src_path STRING",
    )
    first = {r["table"].split(".")[1]: r["status"] for r in L.register_pointers(spark, tables, stage).collect()}
    assert first["`dbo_trips`"] == first["`sales_trips`"] == "created"
    again = L.register_pointers(spark, tables.filter("name = 'trips'"), stage).collect()
    assert {r["status"] for r in again} == {"exists"}

    for _ in range(2):
        done = L.bulk_load(spark, tables, source_database=stage, target_database=house, retries=0, wait=0)
        got = {r["table"].split(".")[1]: (r["status"], r["rows"]) for r in done.collect()}
        assert got["`dbo_trips`"] == ("loaded", 5) and got["`sales_trips`"] == ("loaded", 7)
        assert got["`dbo_gone`"][0] == "failed"
    assert spark.table(f"{house}.sales_trips").count() == 7


def test_names_that_meet_are_rows_of_their_own(spark, databases, tmp_path):
    stage, house = databases
    spark.range(3).write.parquet(str(tmp_path / "ok"))
    tables = spark.createDataFrame(
        [("a_b", "c", "/x"), ("a", "b_c", "/y"), ("s", "ok", str(tmp_path / "ok")), ("s", "n" * 300, "/z"), ("s", "n" * 299 + "m", "/z")],
        "schema STRING, name STRING, src_path STRING",
    )
    first = sorted((r["table"][:20], r["status"]) for r in L.register_pointers(spark, tables, stage).collect())
    assert [x[1] for x in first].count("collision") == 2 and [x[1] for x in first].count("name_too_long") == 2
    assert ("stage_db.`s_ok`", "created") in first
    moved = tables.filter("name = 'ok'").withColumn("src_path", F.lit("/elsewhere"))
    assert L.register_pointers(spark, moved, stage).first()["status"] == "other_location"
    done = {r["status"] for r in L.bulk_load(spark, tables, source_database=stage, target_database=house, retries=0, wait=0).collect()}
    assert done == {"loaded", "collision", "name_too_long"}


def test_warehouses_with_equal_table_names(spark, tmp_path):
    names = ["stage_a", "stage_b", "house_a", "house_b"]
    for db in names:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {db}")
    try:
        for k, n in (("w1", 4), ("w2", 9)):
            spark.range(n).write.parquet(str(tmp_path / k))
        objects = spark.createDataFrame(
            [("w1", "dbo", "t", "table", str(tmp_path / "w1")), ("w2", "dbo", "t", "table", str(tmp_path / "w2"))],
            "item_id STRING, schema STRING, name STRING, type STRING, src_path STRING")
        recovery = spark.createDataFrame([(f"w{k}", "Warehouse", f"n{k}") for k in range(1, 5)], "primary_id STRING, primary_type STRING, secondary_id STRING")
        where = spark.createDataFrame(
            [("n1", "stage_a", "house_a"), ("n2", "stage_b", "house_b"), ("n3", "stage_a", "house_c")],
            "secondary_id STRING, source_database STRING, target_database STRING")
        got = {(r["table"], r["status"], r["rows"]) for r in recover_warehouses(spark, objects, recovery, where, retries=0, wait=0).collect()}
        assert got == {("house_a.`dbo_t`", "loaded", 4), ("house_b.`dbo_t`", "loaded", 9), ("house_c", "no_tables", None), ("n4", "no_database", None)}
    finally:
        for db in names:
            spark.sql(f"DROP DATABASE {db} CASCADE")


@pytest.mark.parametrize("chunks", [1, 7, 500])
def test_tables_to_copy_json(spark, chunks):
    hot = [("hot", f"s{i % 3}", f"t{i}") for i in range(500)]
    tables = spark.createDataFrame(hot + [("cold", "s", "t")] + hot[:20], "item_id STRING, schema STRING, name STRING")
    got = L.tables_to_copy_json(tables, chunks=chunks).collect()
    entries = [(r["item_id"], e["schema"], e["name"]) for r in got for e in json.loads(r["tables_json"])]
    assert sorted(entries) == sorted(set(hot) | {("cold", "s", "t")})
    assert all(len(json.loads(r["tables_json"])) == r["n_tables"] for r in got)
    assert len(got) == 2 if chunks == 1 else max(r["n_tables"] for r in got) < 600 / min(chunks, 100) * 2


def test_warehouse_plans(spark):
    names = "primary_ws_name primary_type primary_name primary_ws_id primary_id secondary_ws_id secondary_ws_name secondary_id"
    recovery = spark.createDataFrame(
        [("Prod", "Warehouse", "House", "w1", "h1", "w2", "Prod_DR", "h2"), ("P" * 300, "Warehouse", "Two", "w1", "h3", "w2", "P_DR", "h4")],
        names.split(),
    )
    items = spark.createDataFrame(
        [("l9", "w2", "Lakehouse", "temp_rlh_Prod_House"), ("p9", "w2", "DataPipeline", "plRecover_WH6_Prod_House")],
        "id STRING, workspaceId STRING, type STRING, displayName STRING",
    )
    staging = staging_plan(recovery, items).cache()
    by = {r["primary_id"]: r for r in staging.collect()}
    assert (by["h1"]["staging_id"], by["h1"]["loader_id"], by["h1"]["payload"]) == ("l9", "p9", None)
    assert by["h3"]["staging_id"] == "NotExists" and len(by["h3"]["staging_name"]) == 256
    assert json.loads(by["h3"]["payload"])["displayName"] == by["h3"]["staging_name"]

    objects = spark.createDataFrame(
        [("h1", "dbo", "Date", "table", "p"), ("h1", "dbo", 'q"t', "table", "p"), ("h3", "dbo", "Trip", "table", "p")],
        "item_id STRING, schema STRING, name STRING, type STRING, src_path STRING",
    )
    there = spark.createDataFrame([("h2", "dbo_Date")], "secondary_id STRING, pointer STRING")
    pointers = pointer_plan(objects, recovery, there, target_key="lake").collect()
    assert sorted(r["pointer"] for r in pointers) == ["dbo_Trip", 'dbo_q"t']
    body = json.loads(next(r for r in pointers if r["name"] == 'q"t')["payload"])
    assert body == {
        "path": "Tables/", "name": 'dbo_q"t',
        "target": {"lake": {"workspaceId": "w1", "itemId": "h1", "path": '/Tables/dbo/q"t'}},
    }
    ends = spark.createDataFrame(
        [("w2", "l9", "Lakehouse", "cs-l"), ("w2", "h2", "Warehouse", "cs\\h\"x")],
        "workspace_id STRING, item_id STRING, type STRING, connection_string STRING",
    )
    listing = spark.createDataFrame(
        [("w2", "e9", "temp_rlh_Prod_House", "SQLEndpoint")],
        "workspace_id STRING, Id STRING, `Display Name` STRING, Type STRING",
    )
    plan = {r["primary_id"]: r for r in load_plan(staging, objects, ends, listing, chunks=1).collect()}
    assert plan["h3"]["status"] == "no_loader" and plan["h3"]["payload"] is None
    assert json.loads(plan["h1"]["payload"])["executionData"]["parameters"] == {
        "lakehouseId": "e9",
        "tablesToCopy": [{"schema": "dbo", "name": "Date"}, {"schema": "dbo", "name": 'q"t'}],
        "workspaceId": "w2",
        "warehouseId": "h2",
        "lakehouseConnStr": "cs-l",
        "warehouseConnStr": "cs\\h\"x",
    }
