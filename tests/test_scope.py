from rehome.operators.picks import split_by, union_frames
from rehome.operators.scope import distinct_workspaces, protect, scope
from rehome.plans.workspaces import capacity_gate, cleanup_plan, git_plan, recreate_plan, role_plan

WS = [
    ("1", "Workspace", "Sales", "c1"),
    ("2", "Workspace", "Sales_DR", "c1"),
    ("3", "Workspace", "SalesXDR", "c1"),
    ("4", "Workspace", "O'Brien", "c2"),
    ("5", "Workspace", None, "c1"),
    ("6", "AdminInsights", "Admin", "c1"),
    ("7", "Workspace", "O'Brien_DR", "c9"),
]


def ws(spark, rows=WS):
    return spark.createDataFrame(rows, "Id STRING, Type STRING, Name STRING, Capacity_Id STRING")


def ids(df):
    return sorted(r[0] for r in df.collect())


def test_empty_lists_keep_all(spark):
    assert len(ids(scope(ws(spark)))) == 7


def test_lists(spark):
    df = ws(spark)
    assert ids(scope(df, include=["O'Brien", "none"])) == ["4"]
    assert ids(scope(df, exclude=["O'Brien"])) == ["1", "2", "3", "6", "7"]
    assert ids(scope(df, exclude_like=["%DR", "Ad%"])) == ["1", "4"]
    assert ids(scope(df, exclude_like=["DR"])) == ["1", "2", "3", "4", "6", "7"]
    assert ids(scope(df, suffix="_DR")) == ["2", "7"]
    assert ids(scope(df, suffix="_DR", match="like")) == ["2", "3", "7"]
    assert ids(scope(df, suffix="_DR", exclude=["Sales_DR"])) == ["7"]


def test_protect_and_distinct(spark):
    df = ws(spark)
    assert ids(protect(df, self_id="1", source_name="Sales_DR")) == ["3", "4", "6", "7"]
    assert ids(distinct_workspaces(df.union(df))) == ["1", "2", "3", "4", "5", "7"]


def test_workspace_plans(spark):
    df = ws(spark)
    made = recreate_plan(df, "_DR", "cap", self_id="1", source_name="x").collect()
    assert {r["new_ws_name"] for r in made} == {"Sales_DR_DR", "SalesXDR_DR", "O'Brien_DR", "O'Brien_DR_DR"}
    assert made[0]["payload"].endswith('"capacityId":"cap"}')
    assert ids(cleanup_plan(df, "_DR", self_id="2")) == ["7"]


def test_git_and_roles(spark):
    git = spark.createDataFrame(
        [
            ("O'Brien", "ConnectedAndInitialized", '{"a":1}'),
            ("Sales", "NotConnected", '{"a":2}'),
            ("Gone", "ConnectedAndInitialized", "{}"),
        ],
        "Workspace_Name STRING, gitConnectionState STRING, gitProviderDetails STRING",
    )
    plan = git_plan(git, ws(spark), "_DR").collect()
    assert [(r["Workspace_ID"], r["payload"]) for r in plan] == [("7", '{"gitProviderDetails":{"a":1}}')]
    assert git_plan(git, ws(spark), "_DR", exclude_like=["O'B%"]).isEmpty()
    roles = spark.createDataFrame(
        [("Admin", "1", "Sales", "p1", "User"), ("Viewer", "4", "O'Brien", "p2", "Group")],
        "role STRING, workspaceId STRING, workspaceName STRING, principalId STRING, principalType STRING",
    )
    plan = role_plan(roles, ws(spark), "_DR", include=["Sales"]).collect()
    assert [(r["new_workspace_id"], r["payload"]) for r in plan] == [
        ("2", '{"principal":{"id":"p1","type":"User"},"role":"Admin"}')
    ]


def test_capacity_gate(spark):
    caps = spark.createDataFrame(
        [("be3709da-fc46-46f5-be5b-6f9bec79bbfb", "East", "Active"), ("2", "West", "Inactive")],
        "Id STRING, Display_Name STRING, State STRING",
    )
    asked = spark.createDataFrame(
        [("BE3709DA-FC46-46F5-BE5B-6F9BEC79BBFB",), ("West",), ("North",)], "capacity_ref STRING"
    )
    got = {r["capacity_ref"]: r["gate"] for r in capacity_gate(asked, caps).collect()}
    assert list(got.values()).count("ok") == 1
    assert got["West"] == "inactive" and got["North"] == "missing"


def test_union_and_split(spark):
    a = spark.createDataFrame([(1, "x")], "a INT, t STRING")
    b = spark.createDataFrame([("y", 2)], "t STRING, b INT")
    both = union_frames(a, b)
    assert both.columns == ["a", "t", "b"]
    parts = split_by(both, "t", ["x", "y"])
    assert parts["x"].count() == parts["y"].count() == 1
