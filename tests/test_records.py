from rehome.sources import records as S

LINES = [
    '{"role":"Admin","principal":{"id":"p1","displayName":"O\'Hara","type":"User","userDetails":{"userPrincipalName":"u"}},"workspaceId":"w","workspaceName":"W"}',
    '{"role":null,"principal":{"id":"p2","type":"App"},"workspaceId":"w","workspaceName":"W"}',
    '{"role":"Viewer","active":true}',
    "{broken",
]


def test_roles_from_text(spark, rows):
    raw = spark.createDataFrame([(line,) for line in LINES], "value STRING")
    records = S.from_json_records(raw, "value", S.ROLE_SCHEMA)
    assert [r[S.CORRUPT] for r in S.quarantined(records).collect()] == ["{broken"]
    flat = S.flatten_roles(S.valid(records))
    assert rows(flat, "principalId", "displayName", "userPrincipalName") == sorted(
        [("p1", "O'Hara", "u"), ("p2", None, None), (None, None, None)], key=repr
    )


def test_json_files(spark, tmp_path):
    (tmp_path / "a.json").write_text("\n".join(LINES) + "\n")
    inferred = S.from_json_files(spark, str(tmp_path))
    assert inferred.filter("active").count() == 1
    given = S.from_json_files(spark, str(tmp_path), S.ROLE_SCHEMA).cache()
    assert S.quarantined(given).count() == 1
    assert S.valid(given).count() == 3


def test_inferred_schema(spark):
    raw = spark.createDataFrame([(line,) for line in LINES], "value STRING")
    schema = S.infer_record_schema(raw, "value")
    assert schema["principal"].dataType["userDetails"].dataType.fieldNames() == ["userPrincipalName"]
    assert S.valid(S.from_json_records(raw, "value", schema)).filter("active").count() == 1


def test_git_and_admin_rows(spark):
    text = '{"workspaceId":"w","workspaceName":"W","gitConnectionState":"S","gitProviderDetails":{"a":"1"},"gitSyncDetails":{"h":null}}'
    raw = spark.createDataFrame([(text,)], "value STRING")
    schema = "workspaceId STRING, workspaceName STRING, gitConnectionState STRING, gitProviderDetails STRUCT<a: STRING>, gitSyncDetails STRUCT<h: STRING>"
    git = S.git_connections(S.from_json_records(raw, "value", schema)).first()
    assert (git["gitProviderDetails"], git["gitSyncDetails"]) == ('{"a":"1"}', "{}")
    admin = spark.createDataFrame(
        [("Admin", "w", "W", "g", "Ann", "User", "a@x")],
        "groupUserAccessRight STRING, workspaceId STRING, workspaceName STRING, graphId STRING, displayName STRING, principalType STRING, emailAddress STRING",
    )
    both = S.union_roles(S.admin_roles(admin), S.admin_roles(admin))
    assert sorted(r["source"] for r in both.collect()) == ["admin", "member"]
    assert both.first()["principalId"] == "g"


def test_local_rows_tables_and_preview(spark):
    import pandas as pd

    df = S.from_local(spark, pd.DataFrame({"k": [3, 1, 2]}))
    assert [r["k"] for r in S.preview(df, "k", n=2).collect()] == [1, 2]
    df.createOrReplaceTempView("local_rows")
    assert S.scan_table(spark, "local_rows").count() == 3
    assert S.table_exists(spark, "local_rows") and not S.table_exists(spark, "no_rows")
    assert S.constant_columns(df, a="x").first()["a"] == "x"


def test_fields_without_a_value_are_text(spark):
    raw = spark.createDataFrame([('{"a b":null,"c":{"e":[null]},"x":1}',), ('{"x":2.5}',)], "value STRING")
    schema = S.infer_record_schema(raw, "value")
    assert schema.simpleString() == "struct<a b:string,c:struct<e:array<string>>,x:decimal(21,1)>"
    assert S.valid(S.from_json_records(raw, "value", schema)).count() == 2
