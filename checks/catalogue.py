"""Every query with the SQL that must give the same rows.

``QUERIES`` maps a name to a function of (spark, sf_dir); ``ORACLES`` maps the same name to SQL
over the given tables. Both cover whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.fixtures import SUFFIX, Estate, guid, with_views
from rehome.functions.names import (
    add_suffix,
    compose_name,
    is_guid,
    move_path,
    sanitize_columns,
    strip_suffix,
)
from rehome.functions.text import encoded, error_message, has_key, schema_enabled
from rehome.operators import mapping as M
from rehome.operators import rewrite as R
from rehome.operators.picks import first_rows, split_by, union_frames
from rehome.operators.scope import distinct_workspaces, scope
from rehome.plans import data as PD
from rehome.plans import items as PI
from rehome.plans import workspaces as PW
from rehome.sinks import copy as C
from rehome.sinks import load as L
from rehome.sources import objects as O
from rehome.sources import records as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# The workspace that runs the recovery, and the one that holds the snapshot.
SELF_ID = "00000001-0000-4000-8000-0000000000a2"
SOURCE_NAME = "Customer#000000002"
TARGET_CAPACITY = "00000000-0000-4000-8000-0000000000c1"
LISTS = {
    "include": [],
    "exclude": ["Customer#000000004", "Customer#000000005_DR"],
    "exclude_like": ["%0000007%", "%99_DR"],
}
# Connections to exchange, by id and by name; the second pair goes on from the first.
CONNECTION_PAIRS = [
    ("00000001-0000-4000-8000-0000000000e1", "Supplier#000000003"),
    ("Supplier#000000003", "00000005-0000-4000-8000-0000000000e1"),
    ("Supplier#000000007", "Supplier#000000008"),
    ("Supplier#000000009", "no such connection"),
    ("00000004-0000-4000-8000-0000000000e1", "00000002-0000-4000-8000-0000000000e1"),
]


def query(sql: str):
    """Register a function of an Estate under its name, with its SQL."""

    def register(fn):
        name = fn.__name__
        QUERIES[name] = lambda spark, sf_dir: fn(Estate(spark, sf_dir))
        ORACLES[name] = with_views(sql)
        return fn

    return register


def _scope_sql(name: str, exclude=True, like=True) -> str:
    tests = []
    if exclude:
        tests.append(f"{name} NOT IN ({', '.join(repr(x) for x in LISTS['exclude'])})")
    if like:
        tests.extend(f"{name} NOT LIKE '{p}'" for p in LISTS["exclude_like"])
    return " AND ".join(tests)


# The maps as plain SQL, in the order and form of a hand-written query.
STRIPPED = "left(w.Name, length(w.Name) - 3)"
WORKSPACE_MAP = f"""SELECT r.Id AS old_ws_id, r.Name AS old_ws_name, w.Id AS new_ws_id, w.Name AS new_ws_name
  FROM workspaces_recovered r JOIN workspaces w ON r.Name = {STRIPPED}
  WHERE ends_with(w.Name, '_DR') AND w.Id <> '{SELF_ID}' AND w.Name <> '{SOURCE_NAME}'"""
OLD_ITEMS = f"""SELECT i.id AS old_item_id, i.displayName AS old_item_name, m.* FROM items_recovered i
  JOIN ({WORKSPACE_MAP}) m ON i.workspaceId = m.old_ws_id"""
NEW_ITEMS = f"""SELECT i.id AS new_item_id, i.displayName AS new_item_name, w.Id AS new_ws_id, w.Name AS new_ws_name
  FROM items i JOIN workspaces w ON i.workspaceId = w.Id
  WHERE ends_with(w.Name, '_DR') AND w.Id <> '{SELF_ID}'"""
ITEM_MAP = f"""SELECT i.type, o.id AS old_item_id, i.id AS new_item_id, i.displayName AS itm_name,
  r.Id AS old_ws_id, r.Name AS old_ws_name, w.Id AS new_ws_id, w.Name AS new_ws_name
  FROM items i JOIN workspaces w ON i.workspaceId = w.Id
  JOIN workspaces_recovered r ON ends_with(w.Name, '_DR') AND r.Name = {STRIPPED}
  JOIN items_recovered o ON o.workspaceId = r.Id AND o.type = i.type AND o.displayName = i.displayName
  WHERE o.id <> i.id AND w.Name <> r.Name AND w.Id <> '{SELF_ID}' AND {_scope_sql('w.Name')}"""
UNIQUE_MAP = f"""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY old_item_id ORDER BY new_item_id) AS rn,
  count(*) OVER (PARTITION BY old_item_id) > 1 AS ambiguous FROM ({ITEM_MAP})) WHERE rn = 1"""
RECOVERY_MAP = f"""SELECT wr.Name AS primary_ws_name, ir.type AS primary_type, ir.displayName AS primary_name,
  wr.Id AS primary_ws_id, ir.id AS primary_id, w.Id AS secondary_ws_id, w.Name AS secondary_ws_name,
  it.id AS secondary_id, it.displayName AS secondary_name, cr.display_name AS capacity_name
  FROM items_recovered ir JOIN workspaces_recovered wr ON wr.Id = ir.workspaceId
  JOIN capacities_recovered cr ON wr.Capacity_Id = cr.id
  JOIN workspaces w ON wr.Name = {STRIPPED} AND ends_with(w.Name, '_DR')
  JOIN items it ON ir.displayName = it.displayName AND it.workspaceId = w.Id AND it.type = ir.type
  WHERE ir.type IN ('Lakehouse', 'Warehouse') AND w.Id <> '{SELF_ID}'"""


_PAIR_KEY = "PARTITION BY ws_name, type, displayName ORDER BY md5(id), id"
PAIRED_MAP = f"""SELECT o.ws_name AS primary_ws_name, o.type AS primary_type, o.displayName AS primary_name,
  o.workspaceId AS primary_ws_id, o.id AS primary_id, n.workspaceId AS secondary_ws_id, n.new_name AS secondary_ws_name,
  n.id AS secondary_id, n.displayName AS secondary_name, o.capacity_name,
  CASE WHEN n.id IS NULL THEN 'unpaired' ELSE 'paired' END AS status
  FROM (SELECT *, row_number() OVER ({_PAIR_KEY}) AS rank FROM (SELECT ir.*, wr.Name AS ws_name, cr.display_name AS capacity_name
    FROM items_recovered ir JOIN workspaces_recovered wr ON wr.Id = ir.workspaceId
    JOIN capacities_recovered cr ON wr.Capacity_Id = cr.id WHERE ir.type IN ('Lakehouse', 'Warehouse'))) o
  LEFT JOIN (SELECT *, row_number() OVER ({_PAIR_KEY}) AS rank FROM (SELECT it.*, {STRIPPED} AS ws_name, w.Name AS new_name
    FROM items it JOIN workspaces w ON it.workspaceId = w.Id AND ends_with(w.Name, '_DR') AND w.Id <> '{SELF_ID}'
    WHERE it.type IN ('Lakehouse', 'Warehouse'))) n
  ON n.ws_name = o.ws_name AND n.type = o.type AND n.displayName = o.displayName AND n.rank = o.rank"""
# What actions are built on: each old store once, with a new store of its own.
ACTION_MAP = f"SELECT * EXCLUDE (status) FROM ({PAIRED_MAP}) WHERE status = 'paired'"


def _paired(e: Estate) -> DataFrame:
    return M.paired_recovery_map(
        e.items_recovered, e.workspaces_recovered, e.capacities_recovered, e.items, e.workspaces, SUFFIX, self_id=SELF_ID
    )


def _actions(e: Estate) -> DataFrame:
    return _paired(e).filter("status = 'paired'").drop("status")


def _map_inputs(e: Estate):
    return e.items_recovered, e.workspaces_recovered, e.items, e.workspaces, SUFFIX


def _unique_map(e: Estate) -> DataFrame:
    return M.unique_map(*_map_inputs(e), self_id=SELF_ID, **LISTS)


def _recovery(e: Estate, unique: bool = False) -> DataFrame:
    return M.recovery_map(
        e.items_recovered,
        e.workspaces_recovered,
        e.capacities_recovered,
        e.items,
        e.workspaces,
        SUFFIX,
        self_id=SELF_ID,
        unique=unique,
    )


def _unique_old(e: Estate) -> DataFrame:
    return M.unique_old_items(
        e.items_recovered,
        e.workspaces_recovered,
        e.workspaces,
        SUFFIX,
        self_id=SELF_ID,
        source_name=SOURCE_NAME,
    )


# ---- sources -----------------------------------------------------------------------------


@query(
    """SELECT event_id, json_extract_string(value, '$.role') AS role,
  json_extract_string(value, '$.principal.id') AS principal_id,
  json_extract_string(value, '$.principal.userDetails.userPrincipalName') AS upn,
  json_extract_string(value, '$.workspaceId') AS workspace_id,
  json_extract_string(value, '$.workspaceName') AS workspace_name FROM roles_raw"""
)
def src_json_records(e):
    raw = e.roles_raw
    schema = S.infer_record_schema(raw, "value")
    return S.valid(S.from_json_records(raw, "value", schema, keep=("event_id",))).select(
        "event_id",
        "role",
        F.col("principal.id").alias("principal_id"),
        F.col("principal.userDetails.userPrincipalName").alias("upn"),
        F.col("workspaceId").alias("workspace_id"),
        F.col("workspaceName").alias("workspace_name"),
    )


@query(
    """SELECT Workspace_ID, Workspace_Name, gitConnectionState, 'landed' AS source, 7 AS batch
  FROM gitconnections_recovered"""
)
def src_literal_rows(e):
    rows = e.gitconnections_recovered.select("Workspace_ID", "Workspace_Name", "gitConnectionState")
    return S.constant_columns(rows, source="landed", batch=7)


@query("SELECT id, workspaceId, type, displayName FROM items")
def scan_table(e):
    e.items.createOrReplaceTempView("rehome_items")
    return S.scan_table(e.spark, "rehome_items")


@query("SELECT l_orderkey, l_partkey, l_shipdate FROM lineitem")
def scan_path(e):
    return S.scan_path(e.spark, e.path("lineitem")).select("l_orderkey", "l_partkey", "l_shipdate")


@query("SELECT id, workspaceId, type, displayName FROM items ORDER BY id LIMIT 1000")
def preview_limit(e):
    return S.preview(e.items, "id")


@query(
    r"""SELECT DISTINCT regexp_extract(path, '^(.*?)/(Tables|Files)/([^/]+)', 1) AS base_path,
  regexp_extract(path, '^(.*?)/(Tables|Files)/([^/]+)', 3) AS name,
  CASE WHEN path LIKE '%/Files/%' THEN 'file' ELSE 'table' END AS type,
  regexp_extract(path, '^(.*?)/(Tables|Files)/([^/]+)', 0) AS src_path FROM inventory"""
)
def list_objects(e):
    return O.objects_from_paths(e.inventory)


@query(
    """SELECT split_part(src_path, '/Tables/', 1) AS base_path, schema, name, type, src_path
  FROM object_paths WHERE schema IN ('ECONOMY', 'LARGE', 'SMALL')"""
)
def list_schema_tables(e):
    paths = e.object_paths.select(F.concat("src_path", F.lit("/part-0.parquet")).alias("path"))
    return O.tables_from_paths(paths, schemas=["ECONOMY", "LARGE", "SMALL"])


@query(
    """SELECT item_id, json_extract(properties, '$.defaultSchema') IS NOT NULL AS schema_enabled
  FROM store_properties"""
)
def schema_enabled_flag(e):
    return e.store_properties.select("item_id", schema_enabled("properties").alias("schema_enabled"))


# ---- projections and filters -------------------------------------------------------------


@query(
    """SELECT s_suppkey AS a_b, s_name AS a_b_2, s_acctbal AS c1, s_nationkey AS d FROM supplier"""
)
def sanitize_columns_(e):
    raw = e.supplier.select(
        F.col("s_suppkey").alias("a b"),
        F.col("s_name").alias("a.b"),
        F.col("s_acctbal").alias("c(1)"),
        F.col("s_nationkey").alias("d;{}"),
    )
    return sanitize_columns(raw)


ROLES = """SELECT json_extract_string(value, '$.role') AS role, json_extract_string(value, '$.workspaceId') AS workspaceId,
  json_extract_string(value, '$.workspaceName') AS workspaceName,
  json_extract_string(value, '$.principal.id') AS principalId,
  json_extract_string(value, '$.principal.displayName') AS displayName,
  json_extract_string(value, '$.principal.type') AS principalType,
  json_extract_string(value, '$.principal.userDetails.userPrincipalName') AS userPrincipalName FROM roles_raw"""


def _roles(e: Estate) -> DataFrame:
    return S.flatten_roles(S.valid(S.from_json_records(e.roles_raw, "value", S.ROLE_SCHEMA)))


@query(ROLES)
def flatten_roles(e):
    return _roles(e)


@query("SELECT Id, Name, Dataset_Id FROM reports")
def drop_columns(e):
    wide = S.constant_columns(e.reports, Subscriptions="[]", Users="[]")
    return wide.drop("Subscriptions", "Users")


@query("SELECT DISTINCT Id, Type, Name FROM workspaces WHERE Type <> 'AdminInsights' AND ends_with(Name, '_DR') AND "
       + _scope_sql("Name"))
def distinct_workspaces_(e):
    return distinct_workspaces(e.workspaces, suffix=SUFFIX, **LISTS)


@query("SELECT DISTINCT Id, Type, Name FROM workspaces WHERE Type <> 'AdminInsights'")
def distinct_all_workspaces(e):
    return distinct_workspaces(e.workspaces)


@query(
    """SELECT i.id AS item_id, left('temp_rlh_' || w.Name || '_' || i.displayName, 20) AS short_name,
  left('plRecover_WH6_' || w.Name || '_' || i.displayName, 256) AS loader_name
  FROM items i JOIN workspaces w ON i.workspaceId = w.Id"""
)
def composed_names(e):
    ws = e.workspaces.select(F.col("Id").alias("workspaceId"), "Name")
    parts = ("Name", "displayName")
    return e.items.join(ws, "workspaceId").select(
        F.col("id").alias("item_id"),
        compose_name(F.lit(PD.STAGING_PREFIX), *parts, max_length=20).alias("short_name"),
        compose_name(F.lit(PD.LOADER_PREFIX), *parts).alias("loader_name"),
    )


_OLD_WS = "substr(src_path, 10, 36)"


@query(
    f"""SELECT src_path, replace(replace(src_path, 'abfss://' || {_OLD_WS}, 'abfss://' || left({_OLD_WS}, 35) || '2'),
    item_id, left(item_id, 35) || '2') AS by_id,
  replace(src_path, 'abfss://' || {_OLD_WS}, 'abfss://' || left({_OLD_WS}, 35) || '2') || '_recovered' AS by_name
  FROM object_paths"""
)
def rewrite_paths(e):
    old_ws = F.substring("src_path", 10, 36)
    new_ws = F.concat(F.left(old_ws, F.lit(35)), F.lit("2"))
    new_item = F.concat(F.left("item_id", F.lit(35)), F.lit("2"))
    ids = (old_ws, new_ws, F.col("item_id"), new_item)
    return e.object_paths.select(
        "src_path",
        move_path("src_path", *ids).alias("by_id"),
        move_path("src_path", *ids, by="name", suffix="_recovered").alias("by_name"),
    )


@query(
    """SELECT c_custkey, json_extract(value, '$.gitProviderDetails')::VARCHAR AS gitProviderDetails,
  json_extract(value, '$.gitSyncDetails')::VARCHAR AS gitSyncDetails FROM git_raw"""
)
def git_details_json(e):
    schema = """workspaceId STRING, workspaceName STRING, gitConnectionState STRING,
      gitProviderDetails STRUCT<gitProviderType: STRING, repositoryName: STRING>,
      gitSyncDetails STRUCT<head: STRING>"""
    records = S.valid(S.from_json_records(e.git_raw, "value", schema, keep=("c_custkey",)))
    key = F.substring("Workspace_ID", 1, 8).cast("bigint").alias("c_custkey")
    return S.git_connections(records).select(key, "gitProviderDetails", "gitSyncDetails")


@query("SELECT * FROM items WHERE type <> 'Report'")
def filter_type(e):
    return e.items.filter(F.col("type") != "Report")


@query("SELECT * FROM workspaces WHERE Name IN ('Customer#000000003', 'Customer#000000001_DR', 'none')")
def filter_include(e):
    return scope(e.workspaces, include=["Customer#000000003", "Customer#000000001_DR", "none"])


@query(f"SELECT * FROM workspaces WHERE {_scope_sql('Name', like=False)}")
def filter_exclude(e):
    return scope(e.workspaces, exclude=LISTS["exclude"])


@query(f"SELECT * FROM workspaces WHERE {_scope_sql('Name', exclude=False)}")
def filter_exclude_like(e):
    return scope(e.workspaces, exclude_like=LISTS["exclude_like"])


@query("SELECT * FROM workspaces WHERE ends_with(Name, '_DR')")
def filter_suffix(e):
    return scope(e.workspaces, suffix=SUFFIX)


@query(
    f"""SELECT Id, Name, replace(Name, '_DR', '') AS stripped FROM workspaces
  WHERE Name LIKE '%_DR' AND {_scope_sql('Name')}"""
)
def scope_filter(e):
    kept = scope(e.workspaces, suffix=SUFFIX, match="like", **LISTS)
    return kept.select("Id", "Name", strip_suffix("Name", SUFFIX, "like").alias("stripped"))


_SHAPES = """SELECT id, CASE cast(substr(id,1,8) AS INT) % 6 WHEN 0 THEN id WHEN 1 THEN '{' || upper(id) || '}'
  WHEN 2 THEN 'urn:uuid:' || replace(id,'-','') WHEN 3 THEN substr(id,2) WHEN 4 THEN '@' || id
  ELSE replace(id,'a','x') END AS ref FROM items"""


@query(
    f"""SELECT id, ref, regexp_full_match(replace(trim(replace(replace(ref,'urn:',''),'uuid:',''), '{{}}'), '-', ''),
  '[0-9a-fA-F]{{32}}') AS is_guid FROM ({_SHAPES})"""
)
def is_guid_(e):
    return e.sql(f"SELECT * FROM ({_SHAPES})").select("id", "ref", is_guid("ref").alias("is_guid"))


@query(
    """SELECT c_custkey, replace(c_name, '#', '-') AS replaced, concat(c_name, '_DR') AS suffixed,
  concat_ws('_', c_mktsegment, c_name) AS joined, left(c_name, 5) AS cut,
  left(c_name, length(c_name) - 1) AS without_last, lower(c_mktsegment) AS lowered FROM customer"""
)
def scalar_strings(e):
    return e.customer.select(
        "c_custkey",
        F.replace("c_name", F.lit("#"), F.lit("-")).alias("replaced"),
        add_suffix("c_name", SUFFIX).alias("suffixed"),
        F.concat_ws("_", "c_mktsegment", "c_name").alias("joined"),
        F.left("c_name", F.lit(5)).alias("cut"),
        F.left("c_name", F.length("c_name") - F.lit(1)).alias("without_last"),
        F.lower("c_mktsegment").alias("lowered"),
    )


@query(
    r"""SELECT event_id, CASE WHEN body <> '' THEN coalesce(json_extract_string(nullif(body, ''), '$.message'), '') END
  AS error_message FROM (SELECT event_id,
  regexp_extract(message, '(?s)Error:\s*(\{.*?\})\s*(?:Headers:|\z)', 1) AS body FROM service_errors)"""
)
def error_message_(e):
    return e.service_errors.select("event_id", error_message("message").alias("error_message"))


# ---- maps and lookups --------------------------------------------------------------------


@query(WORKSPACE_MAP)
def workspace_map(e):
    return M.workspace_map(
        e.workspaces_recovered, e.workspaces, SUFFIX, self_id=SELF_ID, source_name=SOURCE_NAME
    )


@query(
    f"""SELECT Id AS old_ws_id, Name AS old_ws_name FROM workspaces_recovered r WHERE NOT EXISTS
  (SELECT 1 FROM workspaces w WHERE ends_with(w.Name, '_DR') AND {STRIPPED} = r.Name)"""
)
def unmatched_workspaces(e):
    return M.unmatched_workspaces(e.workspaces_recovered, e.workspaces, SUFFIX)


@query(
    f"""SELECT g.gitConnectionState, g.gitProviderDetails, w.Name AS Workspace_Name, w.Id AS Workspace_ID,
  '{{"gitProviderDetails":' || g.gitProviderDetails || '}}' AS payload
  FROM gitconnections_recovered g JOIN workspaces w ON g.Workspace_Name = {STRIPPED}
  WHERE g.gitConnectionState = 'ConnectedAndInitialized' AND ends_with(w.Name, '_DR') AND w.Id <> '{SELF_ID}'
  AND {_scope_sql('g.Workspace_Name', like=False)} AND {_scope_sql('w.Name', exclude=False)}"""
)
def git_plan(e):
    return PW.git_plan(e.gitconnections_recovered, e.workspaces, SUFFIX, self_id=SELF_ID, **LISTS)


@query(RECOVERY_MAP)
def recovery_map(e):
    return _recovery(e)


@query(
    f"""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY primary_id ORDER BY secondary_id) AS rn,
  count(*) OVER (PARTITION BY primary_id) > 1 AS ambiguous FROM ({RECOVERY_MAP})) WHERE rn = 1"""
)
def unique_recovery_map(e):
    return _recovery(e, unique=True)


@query("""SELECT w.* FROM workspaces_recovered w
  WHERE NOT EXISTS (SELECT 1 FROM capacities_recovered c WHERE c.id = w.Capacity_Id AND c.display_name <> 'ASIA')""")
def unmatched_capacities(e):
    return M.unmatched_capacities(e.workspaces_recovered, e.capacities_recovered.filter("display_name <> 'ASIA'"))


@query(PAIRED_MAP)
def paired_recovery_map(e):
    return _paired(e)


@query(f"SELECT status, count(*) AS n_rows, count(*) > 0 AS any_rows FROM ({PAIRED_MAP}) GROUP BY status")
def status_counts(e):
    return M.counts_by(_paired(e), "status")


@query(
    f"""SELECT primary_ws_name, primary_type, primary_name, secondary_ws_name, secondary_name, secondary_ws_id,
  capacity_name FROM ({RECOVERY_MAP}) ORDER BY primary_type, primary_ws_name, primary_id, secondary_id"""
)
def recovery_summary(e):
    return M.recovery_summary(_recovery(e))


@query(f"SELECT *, primary_type AS part FROM ({RECOVERY_MAP})")
def recovery_by_type(e):
    parts = split_by(_recovery(e), "primary_type", ["Lakehouse", "Warehouse"])
    return union_frames(*[part.withColumn("part", F.lit(name)) for name, part in parts.items()])


@query(
    f"""SELECT primary_type, count(*) AS n_rows, count(*) > 0 AS any_rows FROM ({RECOVERY_MAP}) GROUP BY primary_type"""
)
def recovery_counts(e):
    return M.counts_by(_recovery(e), "primary_type")


@query(
    f"""SELECT w.Id AS new_workspace_id, w.Name AS new_workspace, r.*,
  '{{"principal":{{"id":"' || r.principalId || '","type":"' || r.principalType || '"}},"role":"' || r.role || '"}}' AS payload
  FROM ({ROLES}) r JOIN workspaces w ON r.workspaceName = {STRIPPED}
  WHERE ends_with(w.Name, '_DR') AND w.Id <> '{SELF_ID}'
  AND {_scope_sql('r.workspaceName', like=False)} AND {_scope_sql('w.Name', exclude=False)}"""
)
def role_plan(e):
    return PW.role_plan(_roles(e), e.workspaces, SUFFIX, self_id=SELF_ID, **LISTS)


@query(OLD_ITEMS)
def old_item_lookup(e):
    return M.old_item_lookup(
        e.items_recovered,
        e.workspaces_recovered,
        e.workspaces,
        SUFFIX,
        self_id=SELF_ID,
        source_name=SOURCE_NAME,
    )


@query(NEW_ITEMS)
def new_item_lookup(e):
    return M.new_item_lookup(e.items, e.workspaces, SUFFIX, self_id=SELF_ID)


def _by_type_sql(item_type: str) -> str:
    return f"""SELECT w.Id AS new_workspace_id, w.Name AS new_workspace_name, i.* FROM items i
  JOIN workspaces w ON i.workspaceId = w.Id AND w.Name <> '{SOURCE_NAME}' AND i.type = '{item_type}'
  AND ends_with(w.Name, '_DR') AND w.Id <> '{SELF_ID}' WHERE {_scope_sql('w.Name')}"""


@query(_by_type_sql("Notebook"))
def items_by_type(e):
    return M.items_by_type(
        e.items, e.workspaces, "Notebook", SUFFIX, self_id=SELF_ID, source_name=SOURCE_NAME, **LISTS
    )


@query(ITEM_MAP)
def item_id_map(e):
    return M.item_id_map(*_map_inputs(e), self_id=SELF_ID, **LISTS)


@query(UNIQUE_MAP)
def unique_map(e):
    return _unique_map(e)


_IDS = guid("l_partkey", "b1")


def _asked_ids(e: Estate) -> DataFrame:
    return e.sql(f"SELECT l_orderkey, l_linenumber, {_IDS} AS old_id FROM lineitem")


@query(
    f"""SELECT {_IDS} AS old_item_id, l_orderkey, l_linenumber, m.* EXCLUDE (old_item_id, ambiguous),
  CASE WHEN m.new_item_id IS NULL THEN 'unmapped' WHEN m.ambiguous THEN 'ambiguous' ELSE 'mapped' END AS status
  FROM lineitem LEFT JOIN ({UNIQUE_MAP}) m ON m.old_item_id = {_IDS}"""
)
def lookup_items(e):
    return M.lookup_items(_asked_ids(e).withColumnRenamed("old_id", "old_item_id"), _unique_map(e))


@query(
    f"""SELECT l_orderkey, l_linenumber, {_IDS} AS old_id FROM lineitem
  WHERE {_IDS} IN (SELECT old_item_id FROM ({ITEM_MAP}))"""
)
def refs_known(e):
    return M.refs_known(_asked_ids(e), _unique_map(e))


@query(
    f"""SELECT l_orderkey, l_linenumber, {_IDS} AS old_id FROM lineitem
  WHERE {_IDS} NOT IN (SELECT old_item_id FROM ({ITEM_MAP}))"""
)
def refs_unknown(e):
    return M.refs_unknown(_asked_ids(e), _unique_map(e))


_REQUESTS = f"""SELECT l_orderkey, l_linenumber, {guid('o_custkey', 'a2')} AS workspace_id,
  'item_' || cast(l_partkey % 40 AS STRING) AS item_name,
  CASE WHEN l_linestatus = 'O' THEN 'Lakehouse' ELSE 'Warehouse' END AS item_type
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


@query(
    f"""SELECT q.*, coalesce(typed.id, 'NotExists') AS item_id, coalesce(anyt.id, 'NotExists') AS any_id FROM ({_REQUESTS}) q
  LEFT JOIN (SELECT workspaceId, displayName, type, min(id) AS id FROM items GROUP BY ALL) typed
    ON q.workspace_id = typed.workspaceId AND q.item_name = typed.displayName AND q.item_type = typed.type
  LEFT JOIN (SELECT workspaceId, displayName, min(id) AS id FROM items GROUP BY ALL) anyt
    ON q.workspace_id = anyt.workspaceId AND q.item_name = anyt.displayName"""
)
def resolve_item(e):
    typed = M.resolve_item(e.sql(_REQUESTS), e.items)
    return M.resolve_item(typed, e.items, item_type=None, output="any_id")


_MODELS = f"""SELECT w.Id AS new_workspace_id, w.Name AS new_workspace_name, i.displayName AS displayName, i.id AS model_id,
  cast(substr(i.id,1,8) AS INT) % 9 = 0 AS is_default FROM items i JOIN workspaces w ON i.workspaceId = w.Id
  WHERE i.type = 'SemanticModel' AND substr(w.Name, length(w.Name) - 2) = '_DR'"""


@query(
    f"""WITH m AS (SELECT x.*, r.Id AS workspace_id FROM ({_MODELS}) x
    LEFT JOIN workspaces r ON r.Name = left(x.new_workspace_name, length(x.new_workspace_name) - 3) WHERE NOT x.is_default),
  ep AS (SELECT workspace_id, model_name, min(endpoint_id) AS endpoint_id FROM model_endpoints GROUP BY ALL),
  st AS (SELECT workspace_id, "Display Name" AS source_name, min("Id") AS source_id, arg_min("Type", "Id") AS source_type
    FROM listing WHERE "Type" IN ('Lakehouse', 'Warehouse') GROUP BY ALL)
  SELECT m.model_id, m.new_workspace_id, m.displayName AS model_name, d."Display Name" AS source_name, st.source_id,
    st.source_type, CASE WHEN st.source_id IS NULL THEN 'unmapped' ELSE 'mapped' END AS status
  FROM m LEFT JOIN ep ON ep.workspace_id = m.workspace_id AND ep.model_name = m.displayName
  LEFT JOIN listing d ON d.workspace_id = m.workspace_id AND d."Id" = ep.endpoint_id AND d."Type" IN ('SQLEndpoint', 'Warehouse')
  LEFT JOIN st ON st.workspace_id = m.workspace_id AND st.source_name = d."Display Name" """
)
def model_source(e):
    plan = PI.model_plan(e.sql(_MODELS), e.model_endpoints, e.listing, e.workspaces, SUFFIX)
    return plan.select(
        "model_id", "new_workspace_id", "model_name", "source_name", "source_id", "source_type", "status"
    )


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


PAIRS_SQL = "(VALUES " + ", ".join(
    f"({i}, {_sql_text(a)}, {_sql_text(b)})" for i, (a, b) in enumerate(CONNECTION_PAIRS)
) + ") p(seq, from_ref, to_ref)"


def _conn_id(column: str) -> str:
    return (
        f"CASE WHEN regexp_full_match(replace({column}, '-', ''), '[0-9a-fA-F]{{32}}') THEN {column} ELSE "
        f"(SELECT min(\"Connection Id\") FROM connections WHERE \"Connection Name\" = {column}) END"
    )


RESOLVED = f"""SELECT *, CASE WHEN from_id IS NULL OR to_id IS NULL THEN 'unresolved' ELSE 'resolved' END AS status
  FROM (SELECT seq, from_ref, to_ref, {_conn_id('from_ref')} AS from_id, {_conn_id('to_ref')} AS to_id FROM {PAIRS_SQL})"""


@query(f"SELECT cast(seq AS INT) AS seq, from_ref, to_ref, from_id, to_id, status FROM ({RESOLVED})")
def resolve_connections(e):
    return M.resolve_connections(CONNECTION_PAIRS, e.connections)


REPORT_MAP = f"""SELECT rep.Name, rep.Dataset_Id AS old_dataset_id, rr.Id AS old_rep_id, rep.Id AS new_rep_id,
  r.Id AS old_ws_id, r.Name AS old_ws_name, w.Id AS new_ws_id, w.Name AS new_ws_name
  FROM reports rep JOIN items i ON rep.Id = i.id JOIN workspaces w ON i.workspaceId = w.Id
  JOIN workspaces_recovered r ON ends_with(w.Name, '_DR') AND r.Name = {STRIPPED}
  JOIN items_recovered ir ON r.Id = ir.workspaceId JOIN reports_recovered rr ON ir.id = rr.Id AND rep.Name = rr.Name
  WHERE rr.Id <> rep.Id AND w.Name <> r.Name AND {_scope_sql('w.Name')}"""


UNIQUE_REPORTS = f"""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY new_rep_id ORDER BY old_rep_id) AS rn,
  count(*) OVER (PARTITION BY new_rep_id) > 1 AS ambiguous FROM ({REPORT_MAP})) WHERE rn = 1"""


@query(
    f"""SELECT m.*, CASE WHEN o.old_item_id IS NOT NULL THEN 'rebind' WHEN n.new_item_id IS NOT NULL THEN 'in_place'
  ELSE 'unknown' END AS status, coalesce(o.old_item_name, n.new_item_name) AS dataset_name,
  coalesce(o.new_ws_id, n.new_ws_id) AS dataset_ws_id, coalesce(o.new_ws_name, n.new_ws_name) AS dataset_ws_name
  FROM ({UNIQUE_REPORTS}) m LEFT JOIN ({OLD_ITEMS}) o ON o.old_item_id = m.old_dataset_id
  LEFT JOIN ({NEW_ITEMS}) n ON n.new_item_id = m.old_dataset_id"""
)
def report_plan(e):
    reports = M.report_map(
        e.reports,
        e.items,
        e.workspaces,
        e.reports_recovered,
        e.items_recovered,
        e.workspaces_recovered,
        SUFFIX,
        unique=True,
        **LISTS,
    )
    new = M.new_item_lookup(e.items, e.workspaces, SUFFIX, self_id=SELF_ID)
    return PI.report_plan(reports, _unique_old(e), new)


@query(UNIQUE_REPORTS)
def unique_report_map(e):
    return M.report_map(
        e.reports,
        e.items,
        e.workspaces,
        e.reports_recovered,
        e.items_recovered,
        e.workspaces_recovered,
        SUFFIX,
        unique=True,
        **LISTS,
    )


_STORES = "SELECT workspaceId AS workspace_id, id AS item_id, displayName AS item_name FROM items WHERE type = 'Lakehouse'"


@query(
    f"""SELECT s.*, ep.connection_string, d.endpoint_id, CASE WHEN ep.connection_string IS NULL THEN 'no_connection_string'
  WHEN d.endpoint_id IS NULL THEN 'no_endpoint' ELSE 'ok' END AS status FROM ({_STORES}) s
  LEFT JOIN endpoints ep ON ep.workspace_id = s.workspace_id AND ep.item_id = s.item_id
  LEFT JOIN (SELECT workspace_id, "Display Name" AS n, min("Id") AS endpoint_id FROM listing WHERE "Type" = 'SQLEndpoint'
    GROUP BY ALL) d ON d.workspace_id = s.workspace_id AND d.n = s.item_name"""
)
def endpoint_lookup(e):
    return M.endpoint_lookup(e.sql(_STORES), e.endpoints, e.listing)


# ---- counts, picks and sets --------------------------------------------------------------


@query(
    """SELECT 'items' AS table_name, count(*) AS n_rows, count(*) > 0 AS any_rows FROM items UNION ALL
  SELECT 'workspaces', count(*), count(*) > 0 FROM workspaces UNION ALL
  SELECT 'reports', count(*), count(*) > 0 FROM reports"""
)
def snapshot_counts(e):
    frames = {"items": e.items, "workspaces": e.workspaces, "reports": e.reports}
    return union_frames(
        *[M.counts_by(df).select(F.lit(n).alias("table_name"), "*") for n, df in frames.items()]
    )


@query(
    """SELECT workspaceId, type, displayName, min(id) AS id FROM items GROUP BY workspaceId, type, displayName"""
)
def first_match(e):
    return first_rows(e.items, ["workspaceId", "type", "displayName"], ["id"])


@query(
    """SELECT Workspace_ID, Workspace_Name, gitConnectionState FROM gitconnections_recovered UNION ALL
  SELECT Id, Name, 'Unknown' FROM workspaces"""
)
def union_git(e):
    seen = e.gitconnections_recovered.select("Workspace_ID", "Workspace_Name", "gitConnectionState")
    rest = e.workspaces.select(
        F.col("Id").alias("Workspace_ID"),
        F.col("Name").alias("Workspace_Name"),
        F.lit("Unknown").alias("gitConnectionState"),
    )
    return seen.union(rest)


@query(
    """SELECT Id, Name, Dataset_Id, NULL::VARCHAR AS Type FROM reports_recovered UNION ALL
  SELECT Id, Name, NULL, Type FROM workspaces_recovered"""
)
def merge_schema_union(e):
    return union_frames(e.reports_recovered, e.workspaces_recovered.select("Type", "Name", "Id"))


# ---- data movement -----------------------------------------------------------------------


@query(
    f"""SELECT o.item_id, o.schema, o.name, o.type, o.src_path,
  replace(replace(o.src_path, 'abfss://' || m.primary_ws_id, 'abfss://' || m.secondary_ws_id), m.primary_id, m.secondary_id)
  AS dst_path, m.secondary_ws_id, m.secondary_id FROM store_objects o JOIN ({ACTION_MAP}) m ON m.primary_id = o.item_id"""
)
def copy_plan(e):
    return C.copy_plan(e.store_objects, _actions(e))


@query(
    """SELECT source, target, start_time, end_time, strftime(start_time, '%Y-%m-%d %H:%M:%S') AS start_text,
  strftime(end_time, '%Y-%m-%d %H:%M:%S') AS end_text,
  date_diff('microsecond', start_time, end_time) / 1e6 AS elapsed_seconds FROM copy_times"""
)
def copy_audit(e):
    return C.copy_audit(e.copy_times)


_LOAD = "l_orderkey STRING, l_quantity INT, l_extendedprice BIGINT, l_code INT, l_shipdate DATE, l_tax DOUBLE"
# A text column of which a part is a number.
_CODED = """SELECT *, CASE WHEN l_linestatus = 'O' THEN cast(l_partkey AS STRING) ELSE l_returnflag END AS l_code
  FROM lineitem"""


@query(
    f"""SELECT l_orderkey::VARCHAR AS l_orderkey, trunc(l_quantity)::INT AS l_quantity,
  trunc(l_extendedprice)::BIGINT AS l_extendedprice, coalesce(try_cast(l_code AS INT)::VARCHAR, 'lost') AS l_code,
  l_shipdate::DATE AS l_shipdate, l_tax FROM ({_CODED})"""
)
def load_type_conversion(e):
    code = F.coalesce(F.col("l_code").cast("string"), F.lit("lost"))
    return L.convert_types(e.sql(_CODED), _LOAD).withColumn("l_code", code)


@query(
    f"""SELECT 'l_orderkey' AS column_name, count(l_orderkey) AS n_values, 0::BIGINT AS n_lost FROM lineitem
  UNION ALL SELECT 'l_quantity', count(l_quantity), 0 FROM lineitem
  UNION ALL SELECT 'l_extendedprice', count(l_extendedprice), 0 FROM lineitem
  UNION ALL SELECT 'l_code', count(l_code), count(*) FILTER (try_cast(l_code AS INT) IS NULL) FROM ({_CODED})
  UNION ALL SELECT 'l_shipdate', count(l_shipdate), 0 FROM lineitem
  UNION ALL SELECT 'l_tax', count(l_tax), 0 FROM lineitem"""
)
def load_conversion_losses(e):
    return L.conversion_losses(e.sql(_CODED), _LOAD)


_EXISTING = """SELECT w.id AS secondary_id, s.pointer FROM items w
  JOIN (SELECT DISTINCT 'sch_0_tbl_' || cast(l_partkey AS STRING) AS pointer, l_orderkey FROM lineitem) s
  ON cast(substr(w.id,1,8) AS BIGINT) = s.l_orderkey WHERE w.type = 'Warehouse'"""


@query(
    f"""SELECT m.secondary_ws_id, m.secondary_id, o.item_id, o.schema, o.name, o.schema || '_' || o.name AS pointer, o.src_path,
  '{{"path":"Tables/","name":"' || o.schema || '_' || o.name || '","target":{{"store":{{"workspaceId":"' || m.primary_ws_id ||
  '","itemId":"' || o.item_id || '","path":"/Tables/' || o.schema || '/' || o.name || '"}}}}}}' AS payload
  FROM store_objects o JOIN ({ACTION_MAP}) m ON m.primary_id = o.item_id AND m.primary_type = 'Warehouse'
  WHERE NOT EXISTS (SELECT 1 FROM ({_EXISTING}) x WHERE x.secondary_id = m.secondary_id
    AND x.pointer = o.schema || '_' || o.name)"""
)
def pointer_plan(e):
    return PD.pointer_plan(e.store_objects, _actions(e), e.sql(_EXISTING))


CHUNKS = 4
_CHUNK = f"(('0x' || left(md5(schema || '.' || name), 6))::INT % {CHUNKS})"


@query(
    f"""SELECT item_id, {_CHUNK} AS chunk, count(*) AS n_tables,
  to_json(list(struct_pack(schema := schema, name := name) ORDER BY schema, name))::VARCHAR AS tables_json
  FROM store_objects GROUP BY item_id, {_CHUNK}"""
)
def tables_to_copy_json(e):
    return L.tables_to_copy_json(e.store_objects, chunks=CHUNKS)


# ---- plans -------------------------------------------------------------------------------


@query(
    f"""SELECT Id AS old_ws_id, Name AS old_ws_name, Capacity_Id AS old_capacity_id, Name || '_DR' AS new_ws_name,
  '{{"displayName":"' || Name || '_DR","capacityId":"{TARGET_CAPACITY}"}}' AS payload
  FROM (SELECT DISTINCT * FROM workspaces_recovered) w WHERE Id <> '{SELF_ID}' AND Name <> '{SOURCE_NAME}'
  AND Type = 'Workspace' AND {_scope_sql('Name')}"""
)
def recreate_plan(e):
    return PW.recreate_plan(
        e.workspaces_recovered,
        SUFFIX,
        TARGET_CAPACITY,
        self_id=SELF_ID,
        source_name=SOURCE_NAME,
        **LISTS,
    )


@query(
    """SELECT t.target_key, t.capacity_ref, c.id AS capacity_id, c.display_name AS capacity_name, c.state,
  CASE WHEN c.id IS NULL THEN 'missing' WHEN c.state = 'Inactive' THEN 'inactive' ELSE 'ok' END AS gate
  FROM capacity_targets t LEFT JOIN capacities_recovered c ON c.display_name = t.capacity_ref OR c.id = lower(t.capacity_ref)"""
)
def capacity_gate(e):
    return PW.capacity_gate(e.capacity_targets, e.capacities_recovered)


@query(
    f"""SELECT DISTINCT Id, Type, Name FROM workspaces WHERE ends_with(Name, '_DR') AND Type = 'Workspace'
  AND Id <> '{SELF_ID}' AND Name <> '{SOURCE_NAME}' AND {_scope_sql('Name')}"""
)
def cleanup_plan(e):
    return PW.cleanup_plan(e.workspaces, SUFFIX, self_id=SELF_ID, source_name=SOURCE_NAME, **LISTS)


# A staging store and a loader of every third warehouse's name are there already.
_HELPERS = (("c", "Lakehouse", "temp_rlh"), ("d", "DataPipeline", "plRecover_WH6"), ("e", "SQLEndpoint", "temp_rlh"))
_STAGED_ITEMS = "SELECT id, workspaceId, type, displayName FROM items" + "".join(
    f""" UNION ALL SELECT substr(i.id,1,34) || '{mark}2', i.workspaceId, '{kind}',
    '{prefix}_' || left(w.Name, length(w.Name) - 3) || '_' || i.displayName
  FROM items i JOIN workspaces w ON i.workspaceId = w.Id WHERE i.type = 'Warehouse'
  AND substr(w.Name, length(w.Name) - 2) = '_DR' AND cast(substr(i.id,1,8) AS INT) % 3 = 0"""
    for mark, kind, prefix in _HELPERS
)
_STAGED_ENDPOINTS = f"""SELECT workspace_id, item_id, type, connection_string FROM endpoints UNION ALL
  SELECT workspaceId, id, type, 'stage-' || substr(id,1,8) FROM ({_STAGED_ITEMS}) s
  WHERE type = 'Lakehouse' AND displayName LIKE 'temp%'"""
_STAGED_LISTING = f"""SELECT workspaceId AS workspace_id, id, displayName AS display_name, type FROM ({_STAGED_ITEMS}) s"""

_STAGING_SQL = f"""SELECT m.*, left('temp_rlh_' || primary_ws_name || '_' || primary_name, 256) AS staging_name,
  left('plRecover_WH6_' || primary_ws_name || '_' || primary_name, 256) AS loader_name,
  coalesce((SELECT min(id) FROM ({_STAGED_ITEMS}) s WHERE s.type = 'Lakehouse' AND s.workspaceId = m.secondary_ws_id
    AND s.displayName = left('temp_rlh_' || primary_ws_name || '_' || primary_name, 256)), 'NotExists') AS staging_id,
  coalesce((SELECT min(id) FROM ({_STAGED_ITEMS}) s WHERE s.type = 'DataPipeline' AND s.workspaceId = m.secondary_ws_id
    AND s.displayName = left('plRecover_WH6_' || primary_ws_name || '_' || primary_name, 256)), 'NotExists') AS loader_id
  FROM ({ACTION_MAP}) m WHERE primary_type = 'Warehouse'"""


_STATUS_SQL = f"""SELECT *, CASE WHEN count(*) OVER (PARTITION BY secondary_ws_id, staging_name) > 1 THEN 'name_collision'
  WHEN staging_id = 'NotExists' THEN 'to_create' ELSE 'exists' END AS staging_status FROM ({_STAGING_SQL})"""


def _staging(e: Estate) -> DataFrame:
    return PD.staging_plan(_actions(e), e.sql(f"SELECT * FROM ({_STAGED_ITEMS})"))


@query(
    f"""SELECT *, CASE WHEN staging_status = 'to_create' THEN '{{"displayName":"' || staging_name ||
  '","description":"Holds pointers to ' || primary_ws_name || '_' || primary_name ||
  ' while its tables load into ' || secondary_ws_name || ' ' || secondary_ws_id || '"}}' END AS payload FROM ({_STATUS_SQL})"""
)
def staging_plan(e):
    return _staging(e)


@query(
    f"""WITH st AS ({_STATUS_SQL}), lst AS ({_STAGED_LISTING}), eps AS ({_STAGED_ENDPOINTS}),
  js AS (SELECT item_id, {_CHUNK} AS chunk, count(*) AS n_tables,
    to_json(list(struct_pack(schema := schema, name := name) ORDER BY schema, name))::VARCHAR AS tables_json
    FROM store_objects WHERE type = 'table' GROUP BY item_id, {_CHUNK}),
  one AS (SELECT workspace_id, item_id, min(connection_string) AS cs FROM eps GROUP BY ALL),
  doors AS (SELECT workspace_id, display_name, min(id) AS endpoint_id FROM lst WHERE type = 'SQLEndpoint' GROUP BY ALL),
  j AS (SELECT st.primary_id, st.secondary_id, st.secondary_ws_id, st.loader_id, d.endpoint_id AS staging_endpoint_id,
    a.cs AS staging_connection, b.cs AS target_connection, js.chunk, coalesce(js.n_tables, 0) AS n_tables, js.tables_json,
    CASE WHEN js.item_id IS NULL THEN 'no_tables' WHEN st.staging_status = 'name_collision' THEN 'name_collision' WHEN st.loader_id = 'NotExists' THEN 'no_loader' WHEN d.endpoint_id IS NULL THEN 'no_staging_endpoint'
      WHEN a.cs IS NULL THEN 'no_staging_connection' WHEN b.cs IS NULL THEN 'no_target_connection' ELSE 'ready' END AS status
    FROM st LEFT JOIN js ON js.item_id = st.primary_id
    LEFT JOIN doors d ON d.workspace_id = st.secondary_ws_id AND d.display_name = st.staging_name
    LEFT JOIN one a ON a.workspace_id = st.secondary_ws_id AND a.item_id = st.staging_id
    LEFT JOIN one b ON b.workspace_id = st.secondary_ws_id AND b.item_id = st.secondary_id)
  SELECT primary_id, secondary_id, chunk, n_tables, status, CASE WHEN status = 'ready' THEN
    '{{"executionData":{{"parameters":{{"lakehouseId":"' || staging_endpoint_id || '","tablesToCopy":' || tables_json ||
    ',"workspaceId":"' || secondary_ws_id || '","warehouseId":"' || secondary_id || '","lakehouseConnStr":"' ||
    staging_connection || '","warehouseConnStr":"' || target_connection || '"}}}}}}' END AS payload FROM j"""
)
def plan_payloads(e):
    listing = e.sql(f"SELECT * FROM ({_STAGED_LISTING})").select(
        "workspace_id",
        F.col("id").alias("Id"),
        F.col("display_name").alias("Display Name"),
        F.col("type").alias("Type"),
    )
    plan = PD.load_plan(
        _staging(e), e.store_objects, e.sql(f"SELECT * FROM ({_STAGED_ENDPOINTS})"), listing, CHUNKS
    )
    return plan.select("primary_id", "secondary_id", "chunk", "n_tables", "status", "payload")


# ---- definitions -------------------------------------------------------------------------

# Reference sites by a walk over every node of every document.
REFS_SQL = r"""SELECT doc_id, fullkey AS path, CASE key WHEN 'externalReferences' THEN 'connection'
    ELSE CASE json_extract_string(value, '$.properties.type') WHEN 'DataWarehouse' THEN 'warehouse' ELSE 'lakehouse' END
    END AS kind,
  CASE key WHEN 'externalReferences' THEN json_extract_string(value, '$.connection')
    ELSE json_extract_string(value, '$.properties.typeProperties.artifactId') END AS old_id,
  CASE key WHEN 'linkedService' THEN json_extract_string(value, '$.properties.typeProperties.workspaceId') END AS workspace_id,
  CASE key WHEN 'linkedService' THEN json_extract_string(value, '$.properties.typeProperties.endpoint') END AS endpoint
  FROM definitions, json_tree(definition) t WHERE key IN ('linkedService', 'externalReferences')
  UNION ALL
  SELECT doc_id, fullkey, 'notebook', json_extract_string(value, '$.typeProperties.notebookId'),
    json_extract_string(value, '$.typeProperties.workspaceId'), NULL
  FROM definitions, json_tree(definition) t WHERE t.type = 'OBJECT' AND t.path LIKE '%.activities'
    AND json_extract_string(value, '$.type') = 'TridentNotebook'"""

# Connection targets after all pairs in order.
CHAIN_SQL = f"""SELECT DISTINCT from_id AS old_id, list_reduce(list_prepend(from_id, (SELECT list(from_id || '>' || to_id ORDER BY seq)
    FROM ({RESOLVED}) WHERE status = 'resolved')),
    lambda cur, step : CASE WHEN split_part(step, '>', 1) = cur THEN split_part(step, '>', 2) ELSE cur END) AS new_id
  FROM ({RESOLVED}) WHERE status = 'resolved'"""

STATUS_SQL = f"""SELECT r.*, coalesce(c.new_id, m.new_item_id) AS new_id, m.new_ws_id,
  CASE WHEN r.kind = 'connection' AND c.new_id IS NOT NULL THEN 'mapped'
    WHEN NOT regexp_full_match(replace(r.old_id, '-', ''), '[0-9a-fA-F]{{32}}') THEN 'parameter'
    WHEN m.new_item_id IS NULL THEN 'unmapped' WHEN m.ambiguous THEN 'ambiguous' ELSE 'mapped' END AS status
  FROM ({REFS_SQL}) r LEFT JOIN ({UNIQUE_MAP}) m ON r.kind <> 'connection' AND m.old_item_id = r.old_id
  LEFT JOIN ({CHAIN_SQL}) c ON r.kind = 'connection' AND c.old_id = r.old_id"""

SWAP_SQL = f"""SELECT s.*, CASE WHEN s.kind = 'warehouse' THEN ep.cs END AS new_endpoint,
  status IN ('mapped', 'ambiguous') AND (s.kind <> 'warehouse' OR ep.cs IS NOT NULL) AS applied
  FROM ({STATUS_SQL}) s LEFT JOIN (SELECT workspace_id, item_id, min(connection_string) AS cs FROM endpoints GROUP BY ALL) ep
  ON ep.workspace_id = s.new_ws_id AND ep.item_id = s.new_id"""


def _swapped_sql(*kinds: str) -> str:
    wanted = ", ".join(f"'{k}'" for k in kinds)
    hit = f"applied AND kind IN ({wanted})"
    return f"""SELECT doc_id, path, kind, CASE WHEN {hit} THEN new_id ELSE old_id END AS old_id,
  CASE WHEN {hit} AND kind <> 'connection' THEN new_ws_id ELSE workspace_id END AS workspace_id,
  CASE WHEN {hit} AND kind = 'warehouse' THEN new_endpoint ELSE endpoint END AS endpoint FROM ({SWAP_SQL})"""


def _connections(e: Estate) -> DataFrame:
    return M.connection_targets(M.resolve_connections(CONNECTION_PAIRS, e.connections))


def _status(e: Estate) -> DataFrame:
    refs = R.extract_refs(e.definitions)
    return R.ref_status(refs, _unique_map(e), _connections(e), e.endpoints)


def _swap(e: Estate, *kinds: str, only_edited: bool = False) -> DataFrame:
    return R.swap_references(e.definitions, R.reference_edits(_status(e)), kinds, only_edited)


def _refs_after(e: Estate, *kinds: str) -> DataFrame:
    new = _swap(e, *kinds).select("doc_id", F.col("new_definition").alias("definition"))
    return R.extract_refs(new)


def _spliced(e: Estate, definitions: DataFrame, only_edited: bool = False) -> DataFrame:
    """All kinds exchanged, by the places that extraction has found."""
    refs = R.extract_refs(definitions, places=True)
    status = R.ref_status(refs, _unique_map(e), _connections(e), e.endpoints)
    return R.splice_texts(definitions, R.reference_splices(status), only_edited)


@query(REFS_SQL)
def extract_refs(e):
    return R.extract_refs(e.definitions)


@query(f"SELECT doc_id, path, kind, old_id, new_id, new_ws_id, status FROM ({STATUS_SQL})")
def ref_status(e):
    return _status(e).select("doc_id", "path", "kind", "old_id", "new_id", "new_ws_id", "status")


@query(_swapped_sql("warehouse"))
def swap_warehouse(e):
    return _refs_after(e, "warehouse")


@query(_swapped_sql("lakehouse"))
def swap_lakehouse(e):
    return _refs_after(e, "lakehouse")


@query(_swapped_sql("notebook"))
def swap_notebook(e):
    return _refs_after(e, "notebook")


@query(_swapped_sql("connection"))
def swap_connection(e):
    return _refs_after(e, "connection")


@query(_swapped_sql("warehouse", "lakehouse", "notebook", "connection"))
def swap_all(e):
    new = _spliced(e, e.definitions)
    return R.extract_refs(new.select("doc_id", F.col("new_definition").alias("definition")))


# What a JSON library would not write back as it was: a long number, one beyond a double, a repeated key, blanks.
_ODD = '"ratio":0.12345678901234567890, "ratio" : 1e400,"kept":"\\u00e9\\/"'


@query(
    f"""SELECT d.doc_id, list_reduce(list_prepend(replace(d.definition, '"ratio":1.5', '{_ODD}'), coalesce(f.steps, [])), lambda text, step :
    replace(text, split_part(step, '=>', 1), split_part(step, '=>', 2))).replace('"connection":"@', '"connection":"') AS new_definition
  FROM definitions d LEFT JOIN (SELECT doc_id, list(DISTINCT CASE kind
      WHEN 'warehouse' THEN '"DataWarehouse","typeProperties":{{"endpoint":"' || endpoint || '","artifactId":"' || old_id || '","workspaceId":"' || workspace_id ||
        '"=>"DataWarehouse","typeProperties":{{"endpoint":"' || new_endpoint || '","artifactId":"' || new_id || '","workspaceId":"' || new_ws_id || '"'
      WHEN 'lakehouse' THEN '"Lakehouse","typeProperties":{{"artifactId":"' || old_id || '","workspaceId":"' || workspace_id ||
        '"=>"Lakehouse","typeProperties":{{"artifactId":"' || new_id || '","workspaceId":"' || new_ws_id || '"'
      WHEN 'notebook' THEN '"notebookId":"' || old_id || '","workspaceId":"' || workspace_id ||
        '"=>"notebookId":"' || new_id || '","workspaceId":"' || new_ws_id || '"'
      ELSE '"connection":"' || old_id || '"=>"connection":"@' || new_id || '"' END) AS steps
    FROM ({SWAP_SQL}) WHERE applied GROUP BY doc_id) f ON f.doc_id = d.doc_id"""
)
def spliced_texts(e):
    odd = F.replace("definition", F.lit('"ratio":1.5'), F.lit(_ODD))
    return _spliced(e, e.definitions.withColumn("definition", odd)).select("doc_id", "new_definition")


@query(
    f"""SELECT DISTINCT s.doc_id, d.kind, length(d.definition) AS old_length, n.new_ids FROM ({SWAP_SQL}) s
  JOIN definitions d ON d.doc_id = s.doc_id
  JOIN (SELECT doc_id, string_agg(coalesce(CASE WHEN applied THEN new_id ELSE old_id END, ''), ',' ORDER BY path) AS new_ids
    FROM ({SWAP_SQL}) GROUP BY doc_id) n ON n.doc_id = s.doc_id
  WHERE s.applied AND (s.old_id <> s.new_id
    OR s.kind <> 'connection' AND s.workspace_id IS DISTINCT FROM s.new_ws_id
    OR s.kind = 'warehouse' AND s.endpoint IS DISTINCT FROM s.new_endpoint)"""
)
def changed_definitions(e):
    changed = R.changed_definitions(_spliced(e, e.definitions, only_edited=True))
    ids = F.transform(F.sort_array(F.collect_list(F.struct("path", F.coalesce("old_id", F.lit("")).alias("id")))), lambda x: x["id"])
    refs = R.extract_refs(changed.select("doc_id", F.col("new_definition").alias("definition")))
    new = refs.groupBy("doc_id").agg(F.array_join(ids, ",").alias("new_ids"))
    old = changed.select("doc_id", "kind", F.length("definition").cast("bigint").alias("old_length"))
    return old.join(new, "doc_id")


@query("SELECT doc_id, base64(encode(definition)) AS payload FROM definitions")
def definition_base64(e):
    return e.definitions.select("doc_id", encoded("definition").alias("payload"))


@query(
    """SELECT doc_id, CASE WHEN json_extract_string(definition, '$.metadata.dependencies.lakehouse') IS NOT NULL THEN 'lakehouse'
  WHEN json_extract_string(definition, '$.metadata.dependencies.warehouse') IS NOT NULL THEN 'warehouse' ELSE 'none' END
  AS default_kind, json_extract(definition, '$.metadata') IS NOT NULL AS has_metadata FROM definitions"""
)
def definition_kind(e):
    return e.definitions.select(
        "doc_id",
        R.definition_kind().alias("default_kind"),
        has_key("definition", "$.metadata").alias("has_metadata"),
    )


_LH = "$.metadata.dependencies.lakehouse"
_WH = "$.metadata.dependencies.warehouse"


@query(
    f"""SELECT n.doc_id, n.old_item_id, n.lake AS default_lakehouse_name, o.new_ws_id, o.new_ws_name,
  CASE WHEN n.lake IS NULL THEN 'no_default' WHEN o.new_ws_id IS NULL THEN 'unmapped' ELSE 'mapped' END AS status,
  CASE WHEN n.lake IS NOT NULL AND o.new_ws_id IS NOT NULL THEN '{{}}' ELSE n.dependency END AS dependency,
  n.cells FROM (SELECT doc_id, json_extract_string(definition, '{_LH}.default_lakehouse') AS old_item_id,
    json_extract_string(definition, '{_LH}.default_lakehouse_name') AS lake, json_extract(definition, '{_LH}')::VARCHAR AS dependency,
    json_extract(definition, '$.cells')::VARCHAR AS cells FROM notebook_definitions
    WHERE json_extract_string(definition, '{_LH}') IS NOT NULL) n
  LEFT JOIN ({OLD_ITEMS}) o ON o.old_item_id = n.old_item_id"""
)
def notebook_lakehouse_plan(e):
    plan = R.notebook_lakehouse_plan(e.notebook_definitions, _unique_old(e))
    return plan.select(
        "doc_id",
        "old_item_id",
        "default_lakehouse_name",
        "new_ws_id",
        "new_ws_name",
        "status",
        F.get_json_object("new_definition", _LH).alias("dependency"),
        F.get_json_object("new_definition", "$.cells").alias("cells"),
    )


@query(
    f"""SELECT doc_id, old_item_id, new_ws_id, status, CASE WHEN status = 'mapped' THEN target_id ELSE old_item_id END AS new_default,
  CASE WHEN status = 'mapped' AND k0 = old_item_id THEN target_id ELSE k0 END AS known_0,
  CASE WHEN status = 'mapped' AND k1 = old_item_id THEN target_id ELSE k1 END AS known_1 FROM (
  SELECT n.*, o.new_ws_id, t.target_id, CASE WHEN o.new_ws_id IS NULL THEN 'unmapped' WHEN t.target_id IS NULL THEN 'NotExists'
    ELSE 'mapped' END AS status FROM (SELECT doc_id, json_extract_string(definition, '{_WH}.default_warehouse') AS old_item_id,
    json_extract_string(definition, '{_WH}.known_warehouses[0].id') AS k0,
    json_extract_string(definition, '{_WH}.known_warehouses[1].id') AS k1 FROM notebook_definitions
    WHERE json_extract_string(definition, '{_LH}') IS NULL AND json_extract_string(definition, '{_WH}') IS NOT NULL) n
  LEFT JOIN ({OLD_ITEMS}) o ON o.old_item_id = n.old_item_id
  LEFT JOIN (SELECT workspaceId, displayName, min(id) AS target_id FROM items WHERE type = 'Warehouse' GROUP BY ALL) t
    ON t.workspaceId = o.new_ws_id AND t.displayName = o.old_item_name)"""
)
def notebook_warehouse_plan(e):
    plan = R.notebook_warehouse_plan(e.notebook_definitions, _unique_old(e), e.items)
    new = "new_definition"
    return plan.select(
        "doc_id",
        "old_item_id",
        "new_ws_id",
        "status",
        F.get_json_object(new, _WH + ".default_warehouse").alias("new_default"),
        F.get_json_object(new, _WH + ".known_warehouses[0].id").alias("known_0"),
        F.get_json_object(new, _WH + ".known_warehouses[1].id").alias("known_1"),
    )


_HEAD = f"""SELECT doc_id, definition, json_extract_string(definition, '{_LH}') AS lh, json_extract_string(definition, '{_WH}') AS wh,
  json_extract_string(definition, '{_LH}.default_lakehouse') AS lake_id, json_extract_string(definition, '{_LH}.default_lakehouse_name') AS lake,
  json_extract_string(definition, '{_WH}.default_warehouse') AS house_id FROM notebook_definitions"""


@query(
    f"""SELECT n.doc_id, 'lakehouse' AS kind, lake_id AS old_item_id, o.new_ws_id, NULL::VARCHAR AS target_id,
  CASE WHEN lake IS NULL THEN 'no_default' WHEN o.new_ws_id IS NULL THEN 'unmapped' ELSE 'mapped' END AS status
  FROM ({_HEAD}) n LEFT JOIN ({OLD_ITEMS}) o ON o.old_item_id = n.lake_id WHERE lh IS NOT NULL
  UNION ALL SELECT n.doc_id, 'warehouse', house_id, o.new_ws_id, t.target_id,
  CASE WHEN house_id IS NULL THEN 'no_default' WHEN o.new_ws_id IS NULL THEN 'unmapped' WHEN t.target_id IS NULL THEN 'NotExists' ELSE 'mapped' END
  FROM ({_HEAD}) n LEFT JOIN ({OLD_ITEMS}) o ON o.old_item_id = n.house_id
  LEFT JOIN (SELECT workspaceId, displayName, min(id) AS target_id FROM items WHERE type = 'Warehouse' GROUP BY ALL) t
    ON t.workspaceId = o.new_ws_id AND t.displayName = o.old_item_name WHERE lh IS NULL AND wh IS NOT NULL
  UNION ALL SELECT doc_id, 'none', NULL, NULL, NULL, 'no_default' FROM ({_HEAD}) WHERE lh IS NULL AND wh IS NULL"""
)
def notebook_plan(e):
    plan = R.notebook_plan(e.notebook_definitions, _unique_old(e), e.items)
    return plan.select("doc_id", "kind", "old_item_id", "new_ws_id", "target_id", "status")


# Function names that would hide an import carry an underscore; the registered names do not.
for _name in [n for n in QUERIES if n.endswith("_")]:
    QUERIES[_name.rstrip("_")] = QUERIES.pop(_name)
    ORACLES[_name.rstrip("_")] = ORACLES.pop(_name)

from checks import written as _written  # noqa: E402, F401 - registers the queries that write
