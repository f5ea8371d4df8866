"""The whole way: land, save, restore, map, copy, plan."""

import json

from pyspark.sql import functions as F

from rehome.operators.mapping import item_id_map, recovery_map, report_map, unique_map, unique_old_items, new_item_lookup
from rehome.plans.estate import recover_data, restore_estate, snapshot_estate
from rehome.plans.items import definition_plan, report_plan
from rehome.plans.workspaces import cleanup_plan, git_plan, recreate_plan, role_plan
from rehome.sinks.snapshot import drop_snapshot
from rehome.sources.records import landed_frames


def gid(n, kind):
    return f"{n:08}-0000-4000-8000-0000000000{kind}"


def land(root, name, *records):
    (root / name).mkdir(parents=True)
    (root / name / "part.json").write_text("".join(json.dumps(r) + "\n" for r in records))


def item(n, kind, item_type, name, ws):
    return {"id": gid(n, kind), "type": item_type, "displayName": name, "workspaceId": gid(ws, "a" + kind[1])}


def estate(root, kind, suffix):
    ws = lambda n, name: {"Id": gid(n, "a" + kind), "Type": "Workspace", "Name": name + suffix, "Capacity Id": "cap"}
    land(root, "capacities", {"Id": "cap", "Display Name": "East", "State": "Active"})
    land(root, "workspaces", ws(1, "Sales"), ws(2, "O'Brien"))
    b = "b" + kind
    land(
        root,
        "items",
        item(1, b, "Lakehouse", "lake", 1),
        item(2, b, "DataPipeline", "load", 1),
        item(3, b, "Notebook", "clean", 2),
        item(4, b, "Report", "sales", 1),
        item(5, b, "SemanticModel", "model", 1),
    )
    land(root, "reports", {"Id": gid(4, b), "Name": "sales", "Dataset Id": gid(5, "b1")})
    land(
        root,
        "gitconnections",
        {"workspaceId": gid(1, "a" + kind), "workspaceName": "Sales", "gitConnectionState": "ConnectedAndInitialized",
         "gitProviderDetails": {"repo": "r"}, "gitSyncDetails": {}},
    )
    land(
        root,
        "wsroleassignments",
        {"role": "Admin", "principal": {"id": "p", "type": "Group"}, "workspaceId": gid(2, "a" + kind), "workspaceName": "O'Brien"},
    )


def test_recovery(spark, tmp_path, rows):
    estate(tmp_path / "one", "1", "")
    estate(tmp_path / "two", "2", "_DR")

    # Primary: snapshot. Secondary: restore it next to the present estate.
    frames = landed_frames(spark, str(tmp_path / "one"))
    snapshot_estate(spark, {f"e2e_{n}": df for n, df in frames.items()})
    names = ["e2e_capacities", "e2e_workspaces", "e2e_items", "e2e_reports", "e2e_gitconnections", "e2e_wsroleassignments"]
    for name in names:
        spark.table(name).write.parquet(str(tmp_path / "dbo" / name))
        drop_snapshot(spark, name)
    assert restore_estate(spark, str(tmp_path / "dbo"), names).filter("status <> 'saved'").isEmpty()
    caps, old_ws, old_items, old_reports, git, roles = (spark.table(f"{n}_recovered") for n in names)
    assert "metaTimestamp" in old_ws.columns

    made = recreate_plan(old_ws, "_DR", "target")
    assert rows(made, "new_ws_name") == [("O'Brien_DR",), ("Sales_DR",)]

    now = landed_frames(spark, str(tmp_path / "two"), ["workspaces", "items", "reports"])
    ws, items = now["workspaces"].withColumnRenamed("Capacity Id", "Capacity_Id"), now["items"]
    reports = now["reports"].withColumnRenamed("Dataset Id", "Dataset_Id")
    inputs = (old_items, old_ws, items, ws, "_DR")

    assert rows(git_plan(git, ws, "_DR"), "Workspace_ID", "payload") == [
        (gid(1, "a2"), '{"gitProviderDetails":{"repo":"r"}}')
    ]
    assert rows(role_plan(roles, ws, "_DR"), "new_workspace_id", "role") == [(gid(2, "a2"), "Admin")]
    assert item_id_map(*inputs).count() == unique_map(*inputs).count() == 5

    # Data.
    source = tmp_path / gid(1, "a1") / gid(1, "b1")
    (source / "Tables/trips").mkdir(parents=True)
    (source / "Tables/trips/part-0").write_text("rows")
    (source / "Files").mkdir()
    (source / "Files/note.txt").write_text("note")
    stores = spark.createDataFrame(
        [(gid(1, "b1"), str(source), "{}")], "item_id STRING, base_path STRING, properties STRING"
    )
    recovery = recovery_map(old_items, old_ws, caps, items, ws, "_DR", unique=True)
    audit = recover_data(stores, recovery, scheme=f"{tmp_path}/")
    assert rows(audit, "status") == [("copied",), ("copied",)]
    target = tmp_path / gid(1, "a2") / gid(1, "b2")
    assert (target / "Tables/trips/part-0").read_text() == "rows"
    assert (target / "Files/note.txt").read_text() == "note"

    # Definitions and reports.
    doc = {"activities": [{"type": "TridentNotebook", "typeProperties": {"notebookId": gid(3, "b1"), "workspaceId": gid(2, "a1")}}]}
    docs = spark.createDataFrame([(gid(2, "b2"), "DataPipeline", json.dumps(doc))], "doc_id STRING, kind STRING, definition STRING")
    plan = definition_plan(docs, unique_map(*inputs)).first()
    assert json.loads(plan["new_definition"])["activities"][0]["typeProperties"] == {
        "notebookId": gid(3, "b2"), "workspaceId": gid(2, "a2"),
    }
    matched = report_map(reports, items, ws, old_reports, old_items, old_ws, "_DR", unique=True)
    bound = report_plan(matched, unique_old_items(old_items, old_ws, ws, "_DR"), new_item_lookup(items, ws, "_DR"))
    assert rows(bound, "new_rep_id", "status", "dataset_name", "dataset_ws_name") == [
        (gid(4, "b2"), "rebind", "model", "Sales_DR")
    ]
    assert cleanup_plan(ws, "_DR", self_id=gid(1, "a2")).agg(F.collect_list("Name")).first()[0] == ["O'Brien_DR"]
    for name in names:
        drop_snapshot(spark, f"{name}_recovered")
