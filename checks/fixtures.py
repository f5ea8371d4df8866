"""Estate tables as views over the given tables, in SQL that Spark and DuckDB both run.

The modulo terms shape the estate (which workspaces and items exist in the secondary region, which
ids are unknown); they are part of the input, and every view covers its whole tables.
"""

from __future__ import annotations

import re

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

SUFFIX = "_DR"


def guid(key: str, kind: str) -> str:
    """SQL for the id of a key: eight digits and a two-letter kind."""
    return f"(lpad(cast({key} AS STRING),8,'0') || '-0000-4000-8000-0000000000{kind}')"


ITEM_TYPE = (
    "CASE WHEN o_orderkey % 11 = 0 THEN 'Report' WHEN o_orderpriority = '1-URGENT' THEN 'Lakehouse' "
    "WHEN o_orderpriority = '2-HIGH' THEN 'Warehouse' WHEN o_orderpriority = '3-MEDIUM' THEN 'Notebook' "
    "WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'DataPipeline' ELSE 'SemanticModel' END"
)
ITEM_NAME = "'item_' || cast(o_orderkey % 40 AS STRING)"

# An id that a definition refers to: a snapshot item, or an expression where it is a parameter.
REF_ID = (
    "CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN '@pipeline().parameters.artifactId' "
    f"ELSE {guid('l_partkey', 'b1')} END"
)
REF_WS = guid("l_suppkey", "a1")


def _link(link_type: str, endpoint: str) -> str:
    return (
        "'{\"name\":\"copy ' || cast(l_linenumber AS STRING) || '\",\"type\":\"Copy\",\"typeProperties\":"
        "{\"source\":{\"datasetSettings\":{\"annotations\":[],\"linkedService\":{\"name\":\"ls\",\"properties\":"
        f"{{\"type\":\"{link_type}\",\"typeProperties\":{{{endpoint}\"artifactId\":\"' || {REF_ID} || "
        f"'\",\"workspaceId\":\"' || {REF_WS} || '\"}}}}}}}}}},"
        "\"batch\":' || cast(cast(l_quantity AS INT) AS STRING) || '}}'"
    )


# Activities by line: warehouse link, lakehouse link, notebook, connection.
ACTIVITY = f"""CASE l_linenumber % 4
  WHEN 0 THEN {_link("DataWarehouse", '"endpoint":"old.example.com",')}
  WHEN 1 THEN {_link("Lakehouse", "")}
  WHEN 2 THEN '{{"name":"run","type":"TridentNotebook","typeProperties":{{"notebookId":"' || {REF_ID} ||
    '","workspaceId":"' || {REF_WS} || '"}}}}'
  ELSE '{{"name":"web","type":"WebActivity","externalReferences":{{"connection":"' || {guid("l_suppkey", "e1")} ||
    '"}}}}' END"""

# {agg} is the ordered text aggregate, the one construct that the two engines spell differently.
VIEWS = {
    "capacities_recovered": f"""SELECT {guid("r_regionkey", "c1")} AS id, r_name AS display_name,
  CASE WHEN r_regionkey = 4 THEN 'Inactive' ELSE 'Active' END AS state FROM region""",
    "workspaces_recovered": f"""SELECT {guid("c_custkey", "a1")} AS Id,
  CASE WHEN c_custkey % 97 = 0 THEN 'AdminInsights' ELSE 'Workspace' END AS Type, c_name AS Name,
  {guid("n_regionkey", "c1")} AS Capacity_Id
  FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "workspaces": f"""SELECT Id, Type, Name, Capacity_Id FROM workspaces_recovered
  UNION ALL SELECT {guid("c_custkey", "a2")}, 'Workspace', c_name || '_DR', {guid("n_regionkey", "c1")}
  FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 3 <> 0""",
    "items_recovered": f"""SELECT {guid("o_orderkey", "b1")} AS id, {guid("o_custkey", "a1")} AS workspaceId,
  {ITEM_TYPE} AS type, {ITEM_NAME} AS displayName FROM orders""",
    "items": f"""SELECT id, workspaceId, type, displayName FROM items_recovered
  UNION ALL SELECT {guid("o_orderkey", "b2")}, {guid("o_custkey", "a2")}, {ITEM_TYPE}, {ITEM_NAME}
  FROM orders WHERE o_orderkey % 5 <> 0 AND o_custkey % 3 <> 0""",
    "gitconnections_recovered": f"""SELECT {guid("c_custkey", "a1")} AS Workspace_ID, c_name AS Workspace_Name,
  CASE WHEN c_custkey % 8 = 0 THEN 'ConnectedAndInitialized' ELSE 'NotConnected' END AS gitConnectionState,
  '{{"gitProviderType":"AzureDevOps","repositoryName":"repo_' || c_mktsegment || '"}}' AS gitProviderDetails
  FROM customer WHERE c_custkey % 4 = 0""",
    "roles_raw": f"""SELECT event_id, '{{"role":"' || CASE event_type WHEN 'purchase' THEN 'Admin'
  WHEN 'signup' THEN 'Member' WHEN 'error' THEN 'Contributor' ELSE 'Viewer' END || '","principal":{{"id":"' ||
  {guid("event_id % 50", "d1")} || '","displayName":"user ' || cast(event_id % 50 AS STRING) ||
  '","type":"User","userDetails":{{"userPrincipalName":"u' || cast(event_id % 50 AS STRING) ||
  '@example.com"}}}},"workspaceId":"' || {guid("user_id", "a1")} || '","workspaceName":"Customer#' ||
  lpad(cast(user_id AS STRING),9,'0') || '"}}' AS value FROM events""",
    "reports_recovered": f"""SELECT id AS Id, displayName AS Name,
  {guid("(cast(substr(id,1,8) AS INT) + 1)", "b1")} AS Dataset_Id FROM items_recovered WHERE type = 'Report'""",
    "reports": f"""SELECT id AS Id, displayName AS Name,
  {guid("(cast(substr(id,1,8) AS INT) + 1)", "b1")} AS Dataset_Id FROM items WHERE type = 'Report'""",
    "object_paths": f"""SELECT {guid("p_partkey % 100", "b1")} AS item_id, p_type AS schema,
  replace(p_name,' ','_') || '_' || cast(p_partkey AS STRING) AS name, 'table' AS type,
  'abfss://' || {guid("p_partkey % 50", "a1")} || '@store/' || {guid("p_partkey % 100", "b1")} ||
  '/Tables/' || p_type || '/' || replace(p_name,' ','_') || '_' || cast(p_partkey AS STRING) AS src_path
  FROM part""",
    # Tables of every lakehouse and warehouse: one for each part and supplier group of its order.
    "store_objects": f"""SELECT DISTINCT i.id AS item_id, 'sch_' || cast(l_suppkey % 4 AS STRING) AS schema,
  'tbl_' || cast(l_partkey AS STRING) AS name, 'table' AS type,
  'abfss://' || i.workspaceId || '@store/' || i.id || '/Tables/sch_' || cast(l_suppkey % 4 AS STRING) ||
  '/tbl_' || cast(l_partkey AS STRING) AS src_path
  FROM lineitem JOIN items_recovered i ON i.id = {guid("l_orderkey", "b1")}
  WHERE i.type IN ('Lakehouse', 'Warehouse')""",
    # Single files of those tables, as a storage inventory lists them.
    "inventory": """SELECT src_path || '/part-0.parquet' AS path FROM store_objects
  UNION ALL SELECT src_path || '/part-1.parquet' FROM store_objects
  UNION ALL SELECT 'abfss://' || workspaceId || '@store/' || id || '/Files/' || displayName || '.csv'
  FROM items_recovered WHERE type = 'Lakehouse'""",
    "connections": f"""SELECT s_name AS "Connection Name", {guid("s_suppkey", "e1")} AS "Connection Id"
  FROM supplier""",
    "endpoints": """SELECT workspaceId AS workspace_id, id AS item_id, type,
  'sql-' || substr(id,1,8) || '.example.com' AS connection_string FROM items
  WHERE type IN ('Lakehouse', 'Warehouse') AND cast(substr(id,1,8) AS INT) % 7 <> 0""",
    # Every lakehouse has an endpoint of its own name.
    "listing": """SELECT workspaceId AS workspace_id, id AS "Id", displayName AS "Display Name", type AS "Type"
  FROM items UNION ALL
  SELECT workspaceId, substr(id,1,34) || 'f' || substr(id,36,1), displayName, 'SQLEndpoint'
  FROM items WHERE type = 'Lakehouse'""",
    "store_properties": """SELECT id AS item_id, CASE WHEN cast(substr(id,1,8) AS INT) % 2 = 0
  THEN '{"tablesPath":"Tables","defaultSchema":"dbo"}' ELSE '{"tablesPath":"Tables"}' END AS properties
  FROM items WHERE type = 'Lakehouse'""",
    # A model reads the first endpoint or warehouse of its workspace; every fourth one is unknown.
    "model_endpoints": """SELECT i.workspaceId AS workspace_id, i.displayName AS model_name,
  CASE WHEN cast(substr(i.id,1,8) AS INT) % 4 = 0 THEN 'unknown' ELSE d.door END AS endpoint_id
  FROM items_recovered i JOIN (SELECT workspace_id, min("Id") AS door FROM listing
  WHERE "Type" IN ('SQLEndpoint', 'Warehouse') GROUP BY workspace_id) d ON d.workspace_id = i.workspaceId
  WHERE i.type = 'SemanticModel'""",
    "service_errors": """SELECT event_id, CASE event_type
  WHEN 'error' THEN 'Status 400. Error: {"errorCode":"E1","message":"failed for ' || cast(user_id AS STRING) || '"} Headers: {"x":1}'
  WHEN 'click' THEN 'Status 409. Error:{"message":"conflict ' || cast(event_id AS STRING) || '","inner":{"a":1}}'
  WHEN 'view' THEN 'Status 500. Error: {"errorCode":"E2"} Headers: none'
  ELSE 'timed out' END AS message FROM events""",
    "copy_times": """SELECT cast(user_id AS STRING) AS source, event_type AS target,
  min(ts) AS start_time, max(ts) AS end_time FROM events GROUP BY user_id, event_type""",
    "capacity_targets": f"""SELECT c_custkey AS target_key, CASE c_custkey % 3 WHEN 0 THEN r_name
  WHEN 1 THEN upper({guid("r_regionkey", "c1")}) ELSE c_name END AS capacity_ref
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "git_raw": f"""SELECT c_custkey, '{{"workspaceId":"' || {guid("c_custkey", "a1")} || '","workspaceName":"' || c_name ||
  '","gitConnectionState":"ConnectedAndInitialized","gitProviderDetails":{{"gitProviderType":"AzureDevOps",' ||
  '"repositoryName":"repo_' || c_mktsegment || '"}},"gitSyncDetails":{{"head":"' || cast(c_nationkey AS STRING) ||
  '"}}}}' AS value FROM customer""",
    "activity_definitions": f"""SELECT i.id AS doc_id, 'DataPipeline' AS kind,
  '{{"properties":{{"activities":[' || coalesce(d.top, '') || CASE WHEN d.top IS NULL THEN '' ELSE ',' END ||
  '{{"name":"loop","type":"ForEach","typeProperties":{{"batchCount":20,"activities":[' || coalesce(d.inner_, '') ||
  ']}}}}],"annotations":["kept"],"ratio":1.5}}}}' AS definition
  FROM items i JOIN (SELECT {guid("l_orderkey", "b1")} AS order_id,
    {{agg:CASE WHEN l_linenumber % 2 = 0 THEN activity END}} AS top,
    {{agg:CASE WHEN l_linenumber % 2 = 1 THEN activity END}} AS inner_
    FROM (SELECT l_orderkey, l_linenumber, {ACTIVITY} AS activity FROM lineitem) a GROUP BY l_orderkey) d
  ON substr(i.id,1,8) = substr(d.order_id,1,8) WHERE i.type = 'DataPipeline'""",
    "notebook_definitions": f"""SELECT i.id AS doc_id, 'Notebook' AS kind, CASE d.n_lines % 3
  WHEN 0 THEN '{{"metadata":{{"dependencies":{{"lakehouse":{{"default_lakehouse":"' || {guid("d.low", "b1")} || '"' ||
    CASE WHEN d.low % 5 = 0 THEN '' ELSE ',"default_lakehouse_name":"lake ' || cast(d.low AS STRING) || '"' END ||
    '}}}}}},"cells":["print(1)"]}}'
  WHEN 1 THEN '{{"metadata":{{"dependencies":{{"lakehouse":null,"warehouse":{{"default_warehouse":"' || {guid("d.low", "b1")} ||
    '","known_warehouses":[{{"id":"' || {guid("d.low", "b1")} || '","type":"Datawarehouse"}},{{"id":"' ||
    {guid("d.high", "b1")} || '"}}]}}}}}},"cells":[]}}'
  ELSE '{{"metadata":{{"language":"python"}},"cells":[]}}' END AS definition
  FROM items i JOIN (SELECT {guid("l_orderkey", "b1")} AS order_id, count(*) AS n_lines,
    min(l_partkey) AS low, max(l_partkey) AS high FROM lineitem GROUP BY l_orderkey) d
  ON substr(i.id,1,8) = substr(d.order_id,1,8) WHERE i.type = 'Notebook'""",
    "definitions": """SELECT doc_id, kind, definition FROM activity_definitions
  UNION ALL SELECT doc_id, kind, definition FROM notebook_definitions""",
}

# Folders that hold a data folder's views as tables (see write_views).
WRITTEN: dict[str, str] = {}

_WORD = re.compile(r"[A-Za-z_]+")
_AGG = re.compile(r"\{agg:(.*?)\}")


def needed(sql: str, whole: frozenset[str] = frozenset()) -> list[str]:
    """Views and tables that the text uses, each after those it builds on, if it is not a table as a ``whole``."""
    order: list[str] = []

    def visit(text: str) -> None:
        for word in _WORD.findall(text):
            if word in order:
                continue
            if word in VIEWS:
                if word not in whole:
                    visit(VIEWS[word])
                order.append(word)
            elif word in TABLES:
                order.append(word)

    visit(sql)
    return order


def with_views(sql: str, sf_dir: str | None = None) -> str:
    """The query with its views as CTEs: for Spark over ``sf_dir``, else for DuckDB."""
    spark = sf_dir is not None
    ctes = []
    written = WRITTEN.get(sf_dir)
    for name in needed(sql, frozenset(VIEWS) if written else frozenset()):
        if name in VIEWS and written:
            ctes.append(f"{name} AS (SELECT * FROM parquet.`{written}/{name}.parquet`)")
        elif name in VIEWS:
            if spark:
                body = _AGG.sub(r"listagg(\1, ',') WITHIN GROUP (ORDER BY \1)", VIEWS[name])
                body = body.replace('"Id"', "`Id`").replace('"Type"', "`Type`")
                body = re.sub(r'"(Connection Name|Connection Id|Display Name)"', r"`\1`", body)
            else:
                body = _AGG.sub(r"string_agg(\1, ',' ORDER BY \1)", VIEWS[name])
            ctes.append(f"{name} AS ({body})")
        elif spark:
            ctes.append(f"{name} AS (SELECT * FROM parquet.`{sf_dir}/{name}.parquet`)")
    if sql.startswith("WITH "):
        return f"WITH {', '.join(ctes)}, {sql[5:]}" if ctes else sql
    return f"WITH {', '.join(ctes)} {sql}" if ctes else sql


def write_views(spark, sf_dir: str, folder: str) -> None:
    """Every view as a table in a folder; from then on queries over ``sf_dir`` read those."""
    sf_dir = sf_dir.rstrip("/")
    for name in VIEWS:
        spark.sql(with_views(f"SELECT * FROM {name}", sf_dir)).write.parquet(f"{folder}/{name}.parquet")
    WRITTEN[sf_dir] = folder


class Estate:
    """The views as DataFrames: ``Estate(spark, sf_dir).items``."""

    def __init__(self, spark, sf_dir: str):
        self._spark, self._dir = spark, sf_dir.rstrip("/")

    def __getattr__(self, name: str):
        if name not in VIEWS and name not in TABLES:
            raise AttributeError(name)
        return self.sql(f"SELECT * FROM {name}")

    def sql(self, text: str):
        return self._spark.sql(with_views(text, self._dir))

    @property
    def spark(self):
        return self._spark

    def path(self, table: str) -> str:
        return f"{self._dir}/{table}.parquet"
