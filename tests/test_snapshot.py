from datetime import datetime

import pytest

from rehome.plans.estate import restore_estate, snapshot_estate
from rehome.sources.records import landed_frames
from rehome.sinks.snapshot import STAMP, drop_snapshot, save_snapshot

AS_OF = datetime(2024, 1, 2, 3, 4, 5)


@pytest.fixture
def table(spark, request):
    name = "snap_" + request.node.name
    yield name
    drop_snapshot(spark, name)


def test_save_and_replace(spark, table, rows):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "`the id` INT, `na.me` STRING")
    saved = save_snapshot(df, table, as_of=AS_OF)
    assert (saved.rows, saved.status) == (2, "saved")
    assert spark.table(table).columns == ["the_id", "na_me", STAMP]
    assert {r[STAMP] for r in spark.table(table).collect()} == {AS_OF}
    assert save_snapshot(df.limit(1), table).rows == 1
    assert spark.table(table).count() == 1
    assert not spark.catalog.tableExists(table + "__staging")


def test_empty_leaves_the_old_table(spark, table):
    df = spark.createDataFrame([(1,)], "k INT")
    assert save_snapshot(df.limit(0), table).status == "empty"
    assert not spark.catalog.tableExists(table)
    save_snapshot(df, table)
    assert save_snapshot(df.limit(0), table).status == "empty"
    assert save_snapshot(df.filter("k > 5"), table, "append").status == "empty"
    assert spark.table(table).count() == 1


def test_a_failed_save_leaves_the_old_table(spark, table):
    save_snapshot(spark.createDataFrame([(1,)], "k INT"), table)
    bad = spark.range(3).selectExpr("raise_error('no') AS k")
    with pytest.raises(Exception):
        save_snapshot(bad, table)
    assert [r["k"] for r in spark.table(table).collect()] == [1]


def test_an_interrupted_swap_is_taken_back(spark, table):
    save_snapshot(spark.createDataFrame([(1,)], "k INT"), table)
    spark.sql(f"ALTER TABLE {table} RENAME TO {table}__before")
    assert save_snapshot(spark.createDataFrame([], "k INT"), table).status == "empty"
    assert spark.table(table).count() == 1
    assert not spark.catalog.tableExists(f"{table}__before")


def test_saving_a_table_over_itself(spark, table):
    save_snapshot(spark.createDataFrame([(1,), (2,)], "k INT"), table)
    assert save_snapshot(spark.table(table).filter("k = 2").select("k"), table).rows == 1
    assert [r["k"] for r in spark.table(table).collect()] == [2]


def test_append_merges_schemas(spark, table, rows):
    first = spark.createDataFrame([(1, "a")], "k INT, t STRING")
    assert save_snapshot(first, table, "append").rows == 1
    more = spark.createDataFrame([(2.5, 2), (3.5, 3)], "x DOUBLE, k INT")
    assert save_snapshot(more, table, "append").rows == 2
    assert rows(spark.table(table), "k", "t", "x") == sorted(
        [(1, "a", None), (2, None, 2.5), (3, None, 3.5)], key=repr
    )


def test_snapshot_and_restore(spark, tmp_path, rows):
    frames = {
        "est_items": spark.createDataFrame([("i", None), ("j", "W")], "id STRING, ws STRING"),
        "est_caps": spark.createDataFrame([("c",)], "Id STRING"),
        "est_bad": spark.range(2).selectExpr("raise_error('no') AS k"),
    }
    saved = {r["table"]: (r["status"], r["rows"]) for r in snapshot_estate(spark, frames).collect()}
    assert saved == {"est_items": ("saved", 2), "est_caps": ("saved", 1), "est_bad": ("failed", 0)}
    base = str(tmp_path / "dbo")
    for name in ("est_items", "est_caps"):
        spark.table(name).write.parquet(f"{base}/{name}")
    back = restore_estate(spark, base, ["est_items", "est_caps", "est_none"])
    assert rows(back, "table", "status", "rows") == [
        ("est_caps_recovered", "saved", 1),
        ("est_items_recovered", "saved", 2),
        ("est_none_recovered", "failed", 0),
    ]
    assert rows(spark.table("est_items_recovered")) == rows(spark.table("est_items"))
    for name in ("est_items", "est_caps", "est_items_recovered", "est_caps_recovered"):
        drop_snapshot(spark, name)


LANDED = {
    "capacities": '{"Id":"c","Display Name":"East","State":"Active"}',
    "workspaces": '{"Id":"w","Type":"Workspace","Name":"W","Capacity Id":"c"}',
    "items": '{"id":"i","type":"Lakehouse","displayName":"L","workspaceId":"w"}\n{broken',
    "gitconnections": '{"workspaceId":"w","workspaceName":"W","gitConnectionState":"S","gitProviderDetails":{"repo":"r"},"gitSyncDetails":{}}',
    "wsroleassignments": '{"role":"Admin","principal":{"id":"p","type":"User"},"workspaceId":"w","workspaceName":"W"}',
    "reports": '{"Id":"r","Name":"R","Dataset Id":"d","Subscriptions":[{"a":1}],"Users":[]}',
}


def test_landed_estate(spark, tmp_path):
    for name, text in LANDED.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "part.json").write_text(text + "\n")
    frames = {f"land_{name}": df for name, df in landed_frames(spark, str(tmp_path)).items()}
    saved = {r["table"]: (r["status"], r["rows"]) for r in snapshot_estate(spark, frames).collect()}
    assert {t: s for t, s in saved.items() if not t.endswith("_rejected")} == {
        f"land_{name}": ("saved", 1) for name in LANDED
    }
    assert saved["land_items_rejected"] == ("saved", 1) and saved["land_reports_rejected"] == ("empty", 0)
    assert spark.table("land_reports").columns == ["Id", "Name", "Dataset_Id", STAMP]
    assert spark.table("land_workspaces").columns == ["Id", "Type", "Name", "Capacity_Id", STAMP]
    assert spark.table("land_gitconnections").first()["gitProviderDetails"] == '{"repo":"r"}'
    assert spark.table("land_wsroleassignments").first()["principalId"] == "p"
    assert spark.table("land_items_rejected").first()[0] == "{broken"
    for name in frames:
        drop_snapshot(spark, name)
