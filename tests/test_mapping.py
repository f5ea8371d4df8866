import random

import pytest

from rehome.operators import mapping as M

WS = "Id STRING, Type STRING, Name STRING, Capacity_Id STRING"
ITEM = "id STRING, type STRING, displayName STRING, workspaceId STRING"


def estate(spark, old_ws, old_items, new_ws, new_items):
    return (
        spark.createDataFrame(old_items, ITEM),
        spark.createDataFrame([(i, "Workspace", n, c) for i, n, c in old_ws], WS),
        spark.createDataFrame(new_items, ITEM),
        spark.createDataFrame([(i, "Workspace", n, c) for i, n, c in new_ws], WS),
    )


SMALL = (
    [("o1", "Sales", "c1"), ("o2", "A_DR_B", "c1"), ("o3", "Lost", "c1"), ("o4", None, "c1"), ("o5", "NoCap", "c9")],
    [
        ("i1", "Lakehouse", "lake", "o1"),
        ("i2", "Lakehouse", "lake", "o2"),
        ("i3", "Lakehouse", "lake", "o3"),
        ("i4", "Lakehouse", "lake", "o5"),
        ("i5", "Report", "lake", "o1"),
        ("i6", "Lakehouse", "twin", "o1"),
        ("i7", "Lakehouse", None, "o1"),
    ],
    [
        ("n1", "Sales_DR", "c1"),
        ("n2", "A_DR_B_DR", "c1"),
        ("n3", "SalesXDR", "c1"),
        ("n5", "NoCap_DR", "c1"),
        ("n6", None, "c1"),
        ("o1", "Sales", "c1"),
    ],
    [
        ("j1", "Lakehouse", "lake", "n1"),
        ("j2", "Lakehouse", "lake", "n2"),
        ("j4", "Lakehouse", "lake", "n5"),
        ("j6", "Lakehouse", "twin", "n1"),
        ("j7", "Lakehouse", "twin", "n1"),
        ("j8", "Lakehouse", None, "n1"),
        ("i1", "Lakehouse", "lake", "o1"),
    ],
)


def pairs(df):
    return sorted((r["old_item_id"], r["new_item_id"]) for r in df.collect())


def test_workspace_maps(spark):
    _, old, _, new = estate(spark, *SMALL)
    got = M.workspace_map(old, new, "_DR").select("old_ws_id", "new_ws_id").collect()
    assert sorted(map(tuple, got)) == [("o1", "n1"), ("o2", "n2"), ("o5", "n5")]
    protected = M.workspace_map(old, new, "_DR", self_id="n1", source_name="NoCap_DR")
    assert [r["new_ws_id"] for r in protected.collect()] == ["n2"]
    lost = M.unmatched_workspaces(old, new, "_DR").collect()
    assert sorted(r["old_ws_id"] for r in lost) == ["o3", "o4"]


def test_item_maps(spark):
    inputs = estate(spark, *SMALL)
    raw = pairs(M.item_id_map(*inputs, "_DR"))
    assert raw == [("i1", "j1"), ("i2", "j2"), ("i4", "j4"), ("i6", "j6"), ("i6", "j7")]
    unique = M.unique_map(*inputs, "_DR")
    assert pairs(unique) == [("i1", "j1"), ("i2", "j2"), ("i4", "j4"), ("i6", "j6")]
    assert [r["old_item_id"] for r in unique.filter("ambiguous").collect()] == ["i6"]
    assert pairs(M.item_id_map(*inputs, "_DR", self_id="n1")) == [("i2", "j2"), ("i4", "j4")]
    assert pairs(M.item_id_map(*inputs, "_DR", exclude_like=["A%"])) == [p for p in raw if p[0] != "i2"]


def test_recovery_map_needs_a_capacity(spark):
    snapshot, old, items, new = estate(spark, *SMALL)
    caps = spark.createDataFrame([("c1", "East")], "Id STRING, display_name STRING")
    got = M.recovery_map(snapshot, old, caps, items, new, "_DR")
    assert sorted((r["primary_id"], r["secondary_id"]) for r in got.collect()) == [
        ("i1", "j1"), ("i2", "j2"), ("i6", "j6"), ("i6", "j7"),
    ]
    assert [r["Id"] for r in M.unmatched_capacities(old, caps).collect()] == ["o5"]
    only = M.recovery_map(snapshot, old, caps, items, new, "_DR", include=["A_DR_B"])
    assert [r["primary_id"] for r in only.collect()] == ["i2"]
    assert M.counts_by(only.limit(0)).first()["any_rows"] is False


def brute(old_ws, old_items, new_ws, new_items, match):
    names = dict((i, n) for i, n, _ in old_ws)
    copies = dict((i, n) for i, n, _ in new_ws)
    out = []
    for i, t, d, w in old_items:
        for j, u, e, v in new_items:
            a, b = names.get(w), copies.get(v)
            if None in (a, b, d, e) or (t, d) != (u, e) or i == j or a == b:
                continue
            stripped = b.replace("_DR", "") if match == "like" else b[:-3] if b.endswith("_DR") else b
            if a == stripped:
                out.append((i, j))
    return sorted(out)


@pytest.mark.parametrize("match", ["literal", "like"])
def test_maps_against_brute_force(spark, match):
    rng = random.Random(7)
    stems = ["A", "B", "A_DR_B", "A_B", "CXDR", None]
    old_ws = [(f"o{k}", rng.choice(stems), "c") for k in range(12)]
    new_ws = [(f"n{k}", (s := rng.choice(stems)) and s + rng.choice(["_DR", "XDR", ""]), "c") for k in range(16)]
    shape = lambda: (rng.choice("TU"), rng.choice(["x", "y", None]))
    old_items = [(f"i{k}", *shape(), f"o{rng.randrange(14)}") for k in range(120)]
    new_items = [(f"j{k:03}", *shape(), f"n{rng.randrange(18)}") for k in range(160)]
    # Items that kept their id and now lie in a copy: they are no target of their own.
    new_items += [(i, t, d, f"n{rng.randrange(16)}") for i, t, d, _ in old_items[:40]]
    inputs = estate(spark, old_ws, old_items, new_ws, new_items)
    want = brute(old_ws, old_items, new_ws, new_items, match)
    assert pairs(M.item_id_map(*inputs, "_DR", match=match)) == want
    groups = {}
    for i, j in want:
        groups.setdefault(i, []).append(j)
    unique = M.unique_map(*inputs, "_DR", match=match).collect()
    assert {r["old_item_id"]: (r["new_item_id"], r["ambiguous"]) for r in unique} == {
        i: (min(js), len(js) > 1) for i, js in groups.items()
    }


def test_lookups(spark):
    inputs = estate(spark, *SMALL)
    unique = M.unique_map(*inputs, "_DR")
    asked = spark.createDataFrame([("i1",), ("i6",), ("zz",), ("i1",)], "old_item_id STRING")
    got = M.lookup_items(asked, unique).collect()
    assert sorted((r["old_item_id"], r["status"]) for r in got) == [
        ("i1", "mapped"), ("i1", "mapped"), ("i6", "ambiguous"), ("zz", "unmapped"),
    ]
    refs = asked.withColumnRenamed("old_item_id", "old_id")
    assert M.refs_known(refs, unique).count() == 3
    assert M.refs_unknown(refs, unique).count() == 1


def test_resolve_item(spark):
    items = spark.createDataFrame(
        [("b", "T", "x", "w"), ("a", "T", "x", "w"), ("0", "U", "x", "w"), ("c", "T", "x", "v")], ITEM
    )
    asked = spark.createDataFrame(
        [("w", "x", "T"), ("w", "y", "T"), ("v", "x", "U")],
        "workspace_id STRING, item_name STRING, item_type STRING",
    )
    got = M.resolve_item(asked, items).collect()
    assert sorted(r["item_id"] for r in got) == ["NotExists", "NotExists", "a"]
    any_type = M.resolve_item(asked, items, item_type=None).collect()
    assert sorted(r["item_id"] for r in any_type) == ["0", "NotExists", "c"]
    assert M.resolve_item(asked, items.limit(0)).filter("item_id = 'NotExists'").count() == 3


def test_model_sources(spark):
    listing = spark.createDataFrame(
        [
            ("w", "e1", "lake", "SQLEndpoint"),
            ("w", "l1", "lake", "Lakehouse"),
            ("w", "h1", "house", "Warehouse"),
            ("w", "e2", "alone", "SQLEndpoint"),
        ],
        "workspace_id STRING, Id STRING, `Display Name` STRING, Type STRING",
    )
    ends = spark.createDataFrame(
        [("w", "m1", "e1"), ("w", "m2", "h1"), ("w", "m3", "e2"), ("w", "m4", "zz")],
        "workspace_id STRING, model_name STRING, endpoint_id STRING",
    )
    got = M.model_sources(ends.drop("endpoint_id"), ends, listing).collect()
    assert {r["model_name"]: (r["source_id"], r["source_type"]) for r in got} == {
        "m1": ("l1", "Lakehouse"), "m2": ("h1", "Warehouse"), "m3": (None, None), "m4": (None, None),
    }


A, B, C = (f"{x * 8}-0000-4000-8000-000000000000" for x in "abc")


def test_connections(spark):
    conns = spark.createDataFrame(
        [("one", A), ("two", B), ("two", C)], "`Connection Name` STRING, `Connection Id` STRING"
    )
    resolved = M.resolve_connections([("one", "two"), (B, C), ("none", A)], conns)
    assert [r["status"] for r in resolved.orderBy("seq").collect()] == ["resolved", "resolved", "unresolved"]
    got = {r["old_id"]: r["new_id"] for r in M.connection_targets(resolved).collect()}
    assert got == {A: C, B: C}


def test_endpoint_lookup(spark):
    stores = spark.createDataFrame(
        [("w", "l1", "lake"), ("w", "l2", "other")], "workspace_id STRING, item_id STRING, item_name STRING"
    )
    ends = spark.createDataFrame(
        [("w", "l1", "Lakehouse", "cs")],
        "workspace_id STRING, item_id STRING, type STRING, connection_string STRING",
    )
    listing = spark.createDataFrame(
        [("w", "e1", "lake", "SQLEndpoint"), ("w", "l2", "other", "Lakehouse")],
        "workspace_id STRING, Id STRING, `Display Name` STRING, Type STRING",
    )
    got = {r["item_id"]: (r["endpoint_id"], r["status"]) for r in M.endpoint_lookup(stores, ends, listing).collect()}
    assert got == {"l1": ("e1", "ok"), "l2": (None, "no_connection_string")}
