import base64
import json
import random

import pytest
from pyspark.sql import functions as F

from rehome.functions import references as R
from rehome.operators import rewrite as W
from rehome.plans.items import definition_plan, model_plan, report_plan, status_counts


def gid(n, kind="b1"):
    return f"{n:08}-0000-4000-8000-0000000000{kind}"


def link(kind, item, ws="ow", **extra):
    return {"linkedService": {"properties": {"type": kind, "typeProperties": {"artifactId": item, "workspaceId": ws, **extra}}}}


def notebook(item):
    return {"type": "TridentNotebook", "typeProperties": {"notebookId": item, "workspaceId": "ow"}}


DOC = {
    "properties": {
        "activities": [
            notebook(gid(3)),
            {"type": "ForEach", "typeProperties": {"activities": [
                {"type": "Copy", "source": link("DataWarehouse", gid(1), endpoint="old"), "sink": link("Lakehouse", gid(2))},
                {"type": "If", "cases": [{"activities": [notebook("@pipeline().parameters.nb"), notebook(gid(99))]}]},
            ]}},
            {"type": "Web", "externalReferences": {"connection": gid(5, "e1")}},
        ],
        "activities ": 1,
        "unknown": {"keep": [1, 2.50, None, True, "é"]},
    },
    "linkedService": {"properties": {"type": "AzureBlob", "typeProperties": {"artifactId": gid(1)}}},
}


def brute(doc):
    """Descend into everything, as the path expressions of the original do."""
    out = []
    if isinstance(doc, list):
        return [x for child in doc for x in brute(child)]
    if not isinstance(doc, dict):
        return out
    for key, child in doc.items():
        if key == "linkedService":
            kind = {"DataWarehouse": "warehouse", "Lakehouse": "lakehouse"}.get(child["properties"]["type"])
            out += [(kind, child["properties"]["typeProperties"]["artifactId"])] if kind else []
        if key == "activities":
            out += [("notebook", a["typeProperties"]["notebookId"]) for a in child if a["type"] == "TridentNotebook"]
        if key == "externalReferences":
            out.append(("connection", child["connection"]))
        out += brute(child)
    return out


def definitions(spark, *docs):
    text = [d if isinstance(d, str) or d is None else json.dumps(d) for d in docs]
    return spark.createDataFrame([(f"d{i}", "DataPipeline", t) for i, t in enumerate(text)], "doc_id STRING, kind STRING, definition STRING")


MAP = "type STRING, old_item_id STRING, new_item_id STRING, new_ws_id STRING, ambiguous BOOLEAN"


def id_map(spark, *ids, ambiguous=()):
    return spark.createDataFrame(
        [("T", gid(i), gid(i, "b2"), f"nw{i}", i in ambiguous) for i in ids], MAP
    )


def endpoints(spark, *ids):
    return spark.createDataFrame(
        [(f"nw{i}", gid(i, "b2"), "Warehouse", f"sql{i}") for i in ids],
        "workspace_id STRING, item_id STRING, type STRING, connection_string STRING",
    )


def conns(spark):
    return spark.createDataFrame([(gid(5, "e1"), gid(6, "e1"))], "old_id STRING, new_id STRING")


def test_extract(spark):
    got = W.extract_refs(definitions(spark, DOC)).collect()
    assert sorted((r["kind"], r["old_id"]) for r in got) == sorted(brute(DOC))
    by_path = {r["path"]: r for r in got}
    house = by_path["$.properties.activities[1].typeProperties.activities[0].source.linkedService"]
    assert (house["kind"], house["workspace_id"], house["endpoint"]) == ("warehouse", "ow", "old")


@pytest.mark.parametrize(
    "text", [None, "", "{broken", "7", "[]", "{}", '{"linkedService":7,"activities":{"a":1},"externalReferences":[]}',
             '{"linkedService":{"properties":null}}', '{"activities":[null,{"type":"TridentNotebook"}]}', "[" * 50000]
)
def test_odd_documents_have_no_references(spark, text):
    docs = definitions(spark, text)
    assert W.extract_refs(docs).isEmpty()
    edits = W.reference_edits(W.ref_status(W.extract_refs(docs), id_map(spark, 1)))
    swapped = W.swap_references(docs, edits).first()
    assert swapped["new_definition"] == text
    readable = isinstance(R.parse(text), (dict, list))
    assert W.unreadable_definitions(docs).isEmpty() is readable


def test_escaped_keys(spark):
    text = json.dumps({"a": link("Lakehouse", gid(2))}).replace("linked", "l\\u0069nked")
    assert "linkedService" not in text
    assert W.extract_refs(definitions(spark, text)).first()["old_id"] == gid(2)


def test_deep_documents(spark):
    text = '{"a":' * 900 + json.dumps(link("Lakehouse", gid(2))) + "}" * 900
    assert W.extract_refs(definitions(spark, text)).first()["old_id"] == gid(2)


def test_random_documents(spark):
    rng = random.Random(3)

    def grow(depth):
        pick = rng.randrange(7 if depth else 2)
        if pick == 0:
            return rng.choice([1, "text", None, gid(4)])
        if pick == 1:
            return link(rng.choice(["DataWarehouse", "Lakehouse", "Other"]), gid(rng.randrange(9)))
        if pick == 2:
            return {"activities": [notebook(gid(rng.randrange(9))), {"type": "X", "in": grow(depth - 1)}]}
        if pick == 3:
            return {"externalReferences": {"connection": gid(5, "e1"), "more": grow(depth - 1)}}
        if pick == 4:
            return [grow(depth - 1) for _ in range(rng.randrange(4))]
        return {f"k {i}.": grow(depth - 1) for i in range(rng.randrange(1, 4))}

    docs = [grow(6) for _ in range(150)]
    got = W.extract_refs(definitions(spark, *docs)).collect()
    want = [(f"d{i}", *ref) for i, d in enumerate(docs) for ref in brute(d)]
    assert sorted((r["doc_id"], r["kind"], r["old_id"]) for r in got) == sorted(want) and len(want) > 100
    assert len({(r["doc_id"], r["path"], r["kind"]) for r in got}) == len(got)


def test_status(spark):
    refs = W.extract_refs(definitions(spark, DOC))
    status = W.ref_status(refs, id_map(spark, 1, 2, 3, ambiguous=(2,)), conns(spark))
    got = {(r["kind"], r["old_id"]): r["status"] for r in status.collect()}
    assert got == {
        ("warehouse", gid(1)): "mapped",
        ("lakehouse", gid(2)): "ambiguous",
        ("notebook", gid(3)): "mapped",
        ("notebook", gid(99)): "unmapped",
        ("notebook", "@pipeline().parameters.nb"): "parameter",
        ("connection", gid(5, "e1")): "mapped",
    }
    counts = status_counts(status)
    assert counts.agg(F.sum("n_rows")).first()[0] == refs.count()


def test_swap_keeps_everything_else(spark):
    docs = definitions(spark, DOC, {"no": "refs"}, json.dumps(DOC, indent=2))
    plan = definition_plan(docs, id_map(spark, 1, 2, 3), endpoints(spark, 1), conns(spark))
    got = {r["doc_id"]: r for r in plan.collect()}
    assert set(got) == {"d0", "d2"}
    want = json.loads(json.dumps(DOC))
    acts = want["properties"]["activities"]
    acts[0]["typeProperties"] = {"notebookId": gid(3, "b2"), "workspaceId": "nw3"}
    copy = acts[1]["typeProperties"]["activities"][0]
    copy["source"]["linkedService"]["properties"]["typeProperties"] = {"artifactId": gid(1, "b2"), "workspaceId": "nw1", "endpoint": "sql1"}
    copy["sink"]["linkedService"]["properties"]["typeProperties"] = {"artifactId": gid(2, "b2"), "workspaceId": "nw2"}
    acts[2]["externalReferences"]["connection"] = gid(6, "e1")
    for row in got.values():
        assert json.loads(row["new_definition"]) == want
        part = json.loads(row["payload"])["definition"]["parts"][0]
        assert base64.b64decode(part["payload"]).decode() == row["new_definition"]
        assert (part["path"], part["payloadType"]) == ("pipeline-content.json", "InlineBase64")


def test_kinds_and_missing_endpoint(spark):
    docs = definitions(spark, DOC)
    refs = W.extract_refs(docs)

    def after(ends, *kinds):
        status = W.ref_status(refs, id_map(spark, 1, 2, 3), conns(spark), ends)
        new = W.swap_references(docs, W.reference_edits(status), kinds).first()["new_definition"]
        return sorted(x for x in brute(json.loads(new)) if x not in brute(DOC))

    assert after(endpoints(spark, 1), "notebook") == [("notebook", gid(3, "b2"))]
    assert after(endpoints(spark, 1), "warehouse") == [("warehouse", gid(1, "b2"))]
    assert after(endpoints(spark, 2), "warehouse") == after(None, "warehouse") == []
    assert len(after(endpoints(spark, 2), *R.KINDS)) == 3


def test_twice_and_back(spark):
    forward, ends = id_map(spark, 1, 2, 3), endpoints(spark, 1)
    docs = definitions(spark, DOC)
    once = definition_plan(docs, forward, ends).select("doc_id", "kind", F.col("new_definition").alias("definition")).cache()
    assert definition_plan(once, forward, ends).isEmpty()
    back = forward.select(
        "type", F.col("new_item_id").alias("old_item_id"), F.col("old_item_id").alias("new_item_id"),
        F.lit("ow").alias("new_ws_id"), "ambiguous",
    )
    old_ends = spark.createDataFrame([("ow", gid(1), "Warehouse", "old")], ends.schema)
    assert json.loads(definition_plan(once, back, old_ends).first()["new_definition"]) == DOC


def old_items(spark, *ids):
    return spark.createDataFrame(
        [(gid(i), f"item {i}", "ow", "W", f"nw{i}", "W_DR", False) for i in ids],
        "old_item_id STRING, old_item_name STRING, old_ws_id STRING, old_ws_name STRING, new_ws_id STRING, new_ws_name STRING, ambiguous BOOLEAN",
    )


def notebooks(spark, *dependencies):
    docs = [{"metadata": {"dependencies": d} if d is not None else {}, "cells": ["x"]} for d in dependencies]
    return definitions(spark, *docs)


def test_definition_kind(spark):
    docs = notebooks(spark, {"lakehouse": {"a": 1}}, {"lakehouse": None, "warehouse": {"a": 1}}, {"warehouse": None}, {}, None)
    assert [r[0] for r in docs.orderBy("doc_id").select(W.definition_kind()).collect()] == [
        "lakehouse", "warehouse", "none", "none", "none",
    ]


def test_notebook_lakehouse(spark):
    lake = lambda i, **more: {"lakehouse": {"default_lakehouse": gid(i), **more}, "environment": {}}
    docs = notebooks(spark, lake(1, default_lakehouse_name="L"), lake(9, default_lakehouse_name="L"), lake(1), {"warehouse": {}})
    got = {r["doc_id"]: r for r in W.notebook_lakehouse_plan(docs, old_items(spark, 1)).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"d0": "mapped", "d1": "unmapped", "d2": "no_default"}
    assert got["d0"]["new_ws_id"] == "nw1" and got["d0"]["default_lakehouse_name"] == "L"
    new = json.loads(got["d0"]["new_definition"])
    assert new == {"metadata": {"dependencies": {"lakehouse": {}, "environment": {}}}, "cells": ["x"]}
    assert got["d1"]["new_definition"] == got["d1"]["definition"]


def test_notebook_warehouse(spark):
    house = lambda i: {"warehouse": {"default_warehouse": gid(i), "known_warehouses": [{"id": gid(i), "t": 1}, {"id": gid(8)}]}}
    docs = notebooks(spark, house(1), house(2), house(9), {"warehouse": {"known_warehouses": []}})
    items = spark.createDataFrame(
        [(gid(1, "b2"), "nw1", "Warehouse", "item 1"), (gid(2, "b2"), "nw2", "Lakehouse", "item 2")],
        "id STRING, workspaceId STRING, type STRING, displayName STRING",
    )
    got = {r["doc_id"]: r for r in W.notebook_warehouse_plan(docs, old_items(spark, 1, 2), items).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"d0": "mapped", "d1": "NotExists", "d2": "unmapped", "d3": "no_default"}
    house = json.loads(got["d0"]["new_definition"])["metadata"]["dependencies"]["warehouse"]
    assert house == {"default_warehouse": gid(1, "b2"), "known_warehouses": [{"id": gid(1, "b2"), "t": 1}, {"id": gid(8)}]}


def test_model_plan(spark):
    models = spark.createDataFrame(
        [("n1", "Sales_DR", "m", False), ("n1", "Sales_DR", "default", True), ("n1", "Sales_DR", "import", False)],
        "new_workspace_id STRING, new_workspace_name STRING, displayName STRING, is_default BOOLEAN",
    )
    ws = spark.createDataFrame([("o1", "Sales"), ("n1", "Sales_DR")], "Id STRING, Name STRING")
    ends = spark.createDataFrame([("o1", "m", "e1")], "workspace_id STRING, model_name STRING, endpoint_id STRING")
    listing = spark.createDataFrame(
        [("o1", "e1", "lake", "SQLEndpoint"), ("o1", "l1", "lake", "Lakehouse")],
        "workspace_id STRING, Id STRING, `Display Name` STRING, Type STRING",
    )
    got = model_plan(models, ends, listing, ws, "_DR").collect()
    assert sorted((r["model_name"], r["source_name"], r["source_type"], r["status"]) for r in got) == [
        ("import", None, None, "unmapped"), ("m", "lake", "Lakehouse", "mapped"),
    ]


def test_report_plan(spark):
    reports = spark.createDataFrame([("r1", gid(1)), ("r2", "n7"), ("r3", "zz")], "Name STRING, old_dataset_id STRING")
    new = spark.createDataFrame([("n7", "seven", "nw", "W_DR")], "new_item_id STRING, new_item_name STRING, new_ws_id STRING, new_ws_name STRING")
    got = {r["Name"]: (r["status"], r["dataset_name"]) for r in report_plan(reports, old_items(spark, 1), new).collect()}
    assert got == {"r1": ("rebind", "item 1"), "r2": ("in_place", "seven"), "r3": ("unknown", None)}


def test_an_id_that_is_an_object_is_its_json(spark):
    activity = {"name": "run", "type": "TridentNotebook", "typeProperties": {"notebookId": {"value": "@x", "on": True}, "workspaceId": "w"}}
    df = spark.createDataFrame([("d", json.dumps({"activities": [activity]}))], "doc_id STRING, definition STRING")
    assert [r["old_id"] for r in W.extract_refs(df).collect()] == ['{"value":"@x","on":true}']


ODD = ('{ "n": 0.12345678901234567890, "n" :1e400, "t":"\\u00e9\\/ \\"x\\" {[,:", "é😀": [ ],\n "linkedService":{"properties":{"type":"Lakehouse",'
       '"typeProperties":{"artifactId":"no","artifactId" : "%s", "workspaceId":null}}},\t"a":[{"linkedService":{"properties":{"type":"DataWarehouse",'
       '"typeProperties":{"artifactId":"%s"}}}}, -1.50E+3, true]}')


@pytest.mark.parametrize("path", ["python", "spark"])
def test_only_the_values_of_references_change(spark, path):
    from pyspark.sql import functions as F

    text = ODD % (gid(1), gid(2))
    docs = spark.createDataFrame([("d", "DataPipeline", text)], "doc_id STRING, kind STRING, definition STRING")
    refs = W.extract_refs(docs, places=True).withColumns({
        "status": F.lit("mapped"), "new_id": F.concat(F.lit("new "), "old_id"), "new_ws_id": F.lit('w"s'), "new_endpoint": F.lit("e\\é")})
    if path == "spark":
        new = W.splice_texts(docs, W.reference_splices(refs)).first()["new_definition"]
    else:
        new = W.swap_references(docs, W.reference_edits(refs)).first()["new_definition"]
    want = text.replace(f'"artifactId" : "{gid(1)}", "workspaceId":null', f'"artifactId" : "new {gid(1)}", "workspaceId":"w\\"s"')
    want = want.replace(f'{{"artifactId":"{gid(2)}"}}', f'{{"artifactId":"new {gid(2)}", "endpoint": "e\\\\é", "workspaceId": "w\\"s"}}')
    assert new == want


def test_splices_inside_others_are_left_out(spark):
    docs = spark.createDataFrame([("d", "éabcdef"), ("e", "kept"), ("n", None)], "doc_id STRING, definition STRING")
    splices = spark.createDataFrame([("d", 2, 5, "-"), ("d", 3, 4, "!"), ("d", 5, 5, "+"), ("d", 8, 8, "end")], "doc_id STRING, at LONG, end LONG, text STRING")
    found = W.splice_texts(docs, splices)
    assert {r["doc_id"]: r["new_definition"] for r in found.collect()} == {"d": "é-+defend", "e": "kept", "n": None}


def test_odd_notebooks_do_not_stop_the_job():
    from rehome.functions import references as R

    for known in ('["x", 5, null, {"id":"o"}]', '{"id":"o"}', '"o"', "7"):
        text = '{"metadata":{"dependencies":{"warehouse":{"default_warehouse" : "o", "known_warehouses":%s}}, "n":1.0}}' % known
        want = text.replace('"default_warehouse" : "o"', '"default_warehouse" : "w"')
        want = want.replace('{"id":"o"}]', '{"id":"w"}]')
        assert R.set_warehouse(text, "o", "w") == want
    for text in ("[1]", "no json", '{"metadata":5}', '{"metadata":{"dependencies":{"warehouse":[]}}}', None):
        assert R.set_warehouse(text, "o", "w") == text
        assert R.clear_lakehouse(text) == (text and text.replace("[]", '[], "lakehouse": {}'))
    text = '{"metadata":{"dependencies":{"lakehouse":{"a":[1,{"b":2}]}, "z":1e5}}}'
    assert R.clear_lakehouse(text) == '{"metadata":{"dependencies":{"lakehouse":{}, "z":1e5}}}'
