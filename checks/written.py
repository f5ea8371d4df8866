"""Queries that write, and return what is read back: tables in a database, and stores below the shared folder.

Everything goes to a folder of the run below ``spark.checkpoint.dir``; nothing is cleared away there, as the
frames that are returned read it.
"""

from __future__ import annotations

import tempfile
import uuid
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.catalogue import _CODED, _LOAD, REFS_SQL, query
from checks.fixtures import Estate
from rehome.lineage import cut
from rehome.operators import rewrite as R
from rehome.plans.estate import recover_data, recover_warehouses, snapshot_estate
from rehome.sinks import load as L
from rehome.sinks.copy import copy_objects, verify_objects
from rehome.sinks.snapshot import newest_rows, restore_snapshot, save_snapshot
from rehome.sources.objects import objects_from_paths, session_files

AS_OF = datetime(2024, 1, 15, 12, 0, 0)


def folder(spark: SparkSession) -> str:
    """A new folder below the one that driver and executors share; only a local master may have one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="checks-")
        spark.conf.set("spark.checkpoint.dir", named)
    return f"{named.rstrip('/')}/written-{uuid.uuid4().hex}"


def database(spark: SparkSession) -> str:
    name = f"written_{uuid.uuid4().hex[:12]}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{folder(spark)}'")
    return name


def _bare(outcomes: DataFrame) -> DataFrame:
    """Outcome rows with the tables' own names."""
    return outcomes.withColumn("table", F.translate(F.substring_index("table", ".", -1), "`", ""))


def _all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


# ---- snapshots ---------------------------------------------------------------------------

_SAVED = ["capacities_recovered", "workspaces_recovered", "items_recovered", "gitconnections_recovered", "reports_recovered"]


@query(" UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*)::BIGINT AS rows, 'saved' AS status, count(*)::BIGINT AS read_back, 1::BIGINT AS n_stamps FROM {t}" for t in _SAVED)
       + " UNION ALL SELECT 'nothing', 0, 'empty', 0, 0")
def saved_snapshots(e):
    db = database(e.spark)
    frames = {f"{db}.{t}": getattr(e, t) for t in _SAVED}
    outcomes = _bare(snapshot_estate(e.spark, frames | {f"{db}.nothing": e.items.limit(0)}, as_of=AS_OF))
    read = _all([e.spark.table(f"{db}.{t}").agg(F.count("*").alias("read_back"), F.count_distinct(F.when(F.col("metaTimestamp") == F.lit(AS_OF), 1)).alias("n_stamps"))
                 .select(F.lit(t).alias("table"), "*") for t in _SAVED])
    return outcomes.drop("error").join(read, "table", "left").fillna(0, ["read_back", "n_stamps"])


@query(
    """SELECT 'supplier' AS source, s_suppkey::VARCHAR AS id, s_name AS name, s_acctbal::DECIMAL(24,2)::VARCHAR AS amount, NULL::VARCHAR AS brand FROM supplier
  UNION ALL SELECT 'customer', (3000000000 + c_custkey)::VARCHAR, c_name, NULL, NULL FROM customer
  UNION ALL SELECT 'part', 'P' || p_partkey, p_name, (p_retailprice::DECIMAL(20,2)::DECIMAL(24,2))::VARCHAR, p_brand FROM part"""
)
def appended_snapshots(e):
    """Appends to a table that is not there at first; its id goes from INT to BIGINT to text, its amount to a wider decimal."""
    name = f"{database(e.spark)}.grown"
    parts = [
        e.supplier.selectExpr("'supplier' AS source", "cast(s_suppkey AS INT) AS id", "s_name AS name", "cast(s_acctbal AS DECIMAL(14,2)) AS amount"),
        e.customer.selectExpr("'customer' AS source", "3000000000 + c_custkey AS id", "c_name AS name"),
        e.part.selectExpr("'part' AS source", "'P' || p_partkey AS id", "p_name AS name", "cast(p_retailprice AS DECIMAL(24,2)) AS amount", "p_brand AS brand"),
    ]
    for part in parts:
        save_snapshot(part, name, "append", as_of=AS_OF)
    return e.spark.table(name).select("source", "id", "name", F.col("amount").cast("decimal(24,2)").cast("string").alias("amount"), "brand")


def _stored(e: Estate, names: list[str]) -> str:
    root = folder(e.spark)
    for name in names:
        getattr(e, name).write.parquet(f"{root}/{name}")
    return root


@query("SELECT id, \"workspaceId\", type, \"displayName\" FROM items_recovered")
def restored_items(e):
    db, root = database(e.spark), _stored(e, ["items_recovered"])
    restore_snapshot(e.spark, {f"{db}.items": f"{root}/items_recovered"})
    return e.spark.table(f"{db}.items_recovered").select("id", "workspaceId", "type", "displayName")


@query(
    """SELECT 'items_recovered_2' AS "table", count(*)::BIGINT AS rows, 'saved' AS status, false AS failed FROM items_recovered
  UNION ALL SELECT 'workspaces_recovered_2', count(*)::BIGINT, 'saved', false FROM workspaces_recovered
  UNION ALL SELECT 'lost_2', 0, 'failed', true"""
)
def restore_status(e):
    db, root = database(e.spark), _stored(e, ["items_recovered", "workspaces_recovered"])
    paths = {f"{db}.{t}": f"{root}/{t}" for t in ("items_recovered", "lost", "workspaces_recovered")}
    return _bare(restore_snapshot(e.spark, paths, "_2")).select("table", "rows", "status", F.col("error").isNotNull().alias("failed"))


@query(
    f"""SELECT user_id, event_type, event_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n
  FROM events WHERE ts <= TIMESTAMP '{AS_OF}') WHERE n = 1"""
)
def newest_events(e):
    return newest_rows(e.events, ["user_id", "event_type"], AS_OF, stamp="ts").select("user_id", "event_type", "event_id", "ts", "value")


@query(
    f"""SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n
  FROM events WHERE ts <= TIMESTAMP '{AS_OF}') WHERE n = 1"""
)
def restored_as_of(e):
    """Snapshots that were appended to a table twice, restored as of a time: each key once."""
    db, root = database(e.spark), folder(e.spark)
    for _ in range(2):
        e.events.write.mode("append").parquet(f"{root}/events")
    restore_snapshot(e.spark, {f"{db}.events": f"{root}/events"}, as_of=AS_OF, keys={f"{db}.events": ["user_id"]}, stamp="ts")
    return e.spark.table(f"{db}.events_recovered").select("user_id", "event_id", "ts")


# ---- loads -------------------------------------------------------------------------------


@query(
    f"""SELECT l_orderkey AS order_key, l_linenumber AS line, 'l_code' AS column_name, l_code AS raw_value, 'int' AS target_type FROM ({_CODED})
  WHERE l_code IS NOT NULL AND try_cast(l_code AS INT) IS NULL"""
)
def load_rejects(e):
    lost = L.conversion_rejects(e.sql(_CODED), _LOAD, ["l_orderkey", "l_linenumber"])
    return lost.withColumnsRenamed({"l_orderkey": "order_key", "l_linenumber": "line"})


_HOUSES = {"supplier": "s_suppkey", "customer": "c_custkey", "part": "p_partkey"}


@query(
    " UNION ALL ".join(f"SELECT {run} AS run, 'sales_{t}' AS \"table\", count(*)::BIGINT AS rows, '{status}' AS status, sum({k})::BIGINT AS keys FROM {t}"
                       for t, k in _HOUSES.items() for run, status in ((1, "loaded"), (2, "done")))
    + " UNION ALL SELECT run, 'house_2', 0, 'no_database', NULL FROM (VALUES (1), (2)) r(run)"
)
def recover_warehouse_rows(e):
    """Tables in store folders, pointed at, loaded, and loaded again under the same id, which loads none."""
    spark, root, source, target = e.spark, folder(e.spark), database(e.spark), database(e.spark)
    for t in _HOUSES:
        getattr(e, t).write.parquet(f"{root}/w1/house_1/Tables/sales/{t}")
    objects = spark.createDataFrame([("house_1", "sales", t, "table", f"{root}/w1/house_1/Tables/sales/{t}") for t in _HOUSES],
                                    "item_id STRING, schema STRING, name STRING, type STRING, src_path STRING")
    recovery = spark.createDataFrame([("house_1", "house_1", "Warehouse"), ("house_2", "house_2", "Warehouse")], "primary_id STRING, secondary_id STRING, primary_type STRING")
    databases = spark.createDataFrame([("house_1", source, target)], "secondary_id STRING, source_database STRING, target_database STRING")
    runs = [_bare(recover_warehouses(spark, objects, recovery, databases, load_id="one")).withColumn("run", F.lit(n)) for n in (1, 2)]
    read = _all([spark.table(f"{target}.`sales_{t}`").agg(F.sum(k).alias("keys")).select(F.lit(f"sales_{t}").alias("table"), "keys") for t, k in _HOUSES.items()])
    return _all(runs).join(read, "table", "left").select("run", "table", F.coalesce("rows", F.lit(0)).alias("rows"), "status", "keys")


# ---- stores ------------------------------------------------------------------------------


def _lakehouses(e: Estate) -> tuple[str, DataFrame, DataFrame]:
    """(root, stores, recovery): a lakehouse with schemas and one without, written from given tables."""
    spark, root = e.spark, folder(e.spark)
    e.supplier.write.parquet(f"{root}/w1/lake_1/Tables/dbo/supplier")
    e.customer.write.parquet(f"{root}/w1/lake_1/Tables/sales/customer")
    e.part.write.parquet(f"{root}/w1/lake_2/Tables/part")
    e.nation.select("n_name").write.text(f"{root}/w1/lake_2/Files/nations")
    stores = spark.createDataFrame([("lake_1", f"{root}/w1/lake_1", '{"defaultSchema":"dbo"}'), ("lake_2", f"{root}/w1/lake_2", "{}"), ("lake_3", f"{root}/w1/lake_3", "{}")],
                                   "item_id STRING, base_path STRING, properties STRING")
    recovery = spark.createDataFrame([(f"lake_{i}", "w1", "W", f"L{i}", f"new_{i}", "w2", "W_DR", f"L{i}", "Lakehouse") for i in (1, 2, 3, 4)],
                                     "primary_id primary_ws_id primary_ws_name primary_name secondary_id secondary_ws_id secondary_ws_name secondary_name primary_type".split())
    return root, stores, recovery


@query(
    """SELECT 'supplier' AS source, s_suppkey AS key, s_name AS name FROM supplier UNION ALL SELECT 'customer', c_custkey, c_name FROM customer
  UNION ALL SELECT 'part', p_partkey, p_name FROM part UNION ALL SELECT 'nations', NULL, n_name FROM nation"""
)
def recover_data_rows(e):
    """Lakehouses listed, copied by their recovery map, and read where they now are."""
    root, stores, recovery = _lakehouses(e)
    recover_data(stores, recovery, scheme=f"{root}/").collect()
    read = e.spark.read
    return _all([
        read.parquet(f"{root}/w2/new_1/Tables/dbo/supplier").selectExpr("'supplier' AS source", "s_suppkey AS key", "s_name AS name"),
        read.parquet(f"{root}/w2/new_1/Tables/sales/customer").selectExpr("'customer' AS source", "c_custkey AS key", "c_name AS name"),
        read.parquet(f"{root}/w2/new_2/Tables/part").selectExpr("'part' AS source", "p_partkey AS key", "p_name AS name"),
        read.text(f"{root}/w2/new_2/Files/nations").selectExpr("'nations' AS source", "cast(NULL AS BIGINT) AS key", "value AS name"),
    ])


@query(
    """SELECT run, name, CASE WHEN run = 1 OR name = 'part' THEN 'copied' ELSE 'unchanged' END AS status, run = 1 OR name = 'part' AS moved, true AS equal
  FROM (VALUES (1), (2)) r(run), (VALUES ('supplier'), ('customer'), ('part'), ('nations')) n(name), (SELECT count(*) FROM supplier)
  UNION ALL SELECT run, name, status, false, false FROM (VALUES (1), (2)) r(run), (VALUES ('lake_3', 'empty'), ('lake_4', 'no_store')) n(name, status)"""
)
def recover_data_audit(e):
    """A second run by difference, after one table of the target was spoilt: only that one is copied."""
    root, stores, recovery = _lakehouses(e)
    audits = []
    for run in (1, 2):
        audit = recover_data(stores, recovery, changes_only=True, scheme=f"{root}/")
        plan = audit.filter("dst_path IS NOT NULL").select("src_path", "dst_path")
        checked = verify_objects(plan).select("dst_path", (F.col("status") == "equal").alias("equal"))
        name = F.coalesce(F.substring_index(F.when(F.col("dst_path").isNotNull(), F.col("src_path")), "/", -1), "item_id")
        told = audit.select(F.lit(run).alias("run"), name.alias("name"), "status", "dst_path", F.coalesce(F.col("copied_files") > 0, F.lit(False)).alias("moved"))
        # The state of this run is kept before the target is changed.
        audits.append(cut(told.join(checked, "dst_path", "left").drop("dst_path").fillna(False, ["equal"])))
        if run == 1:
            e.supplier.write.mode("overwrite").parquet(f"{root}/w2/new_2/Tables/part")
    return _all(audits)


@query(
    """SELECT run, n_nationkey::VARCHAR AS name, 1::BIGINT AS files, strlen(content)::BIGINT AS bytes, CASE WHEN run = 1 THEN 1 ELSE 0 END::BIGINT AS copied_files,
    CASE WHEN run = 1 THEN 'copied' ELSE 'unchanged' END AS status,
    sha256((('0x' || left(sha256(':' || strlen(content) || ':' || sha256(sha256(content))), 15))::BIGINT)::VARCHAR) AS digest
  FROM (VALUES (1), (2)) r(run), (SELECT n_nationkey, string_agg(s_name || chr(10), '' ORDER BY s_name) AS content
    FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_nationkey)"""
)
def copied_files(e):
    """Files of known content, found by Spark's listing, copied one by one with their digests, and not copied again."""
    spark, root = e.spark, folder(e.spark)
    lines = e.supplier.join(e.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("n_nationkey", F.col("s_name").alias("value"))
    lines.repartition("n_nationkey").sortWithinPartitions("n_nationkey", "value").write.partitionBy("n_nationkey").text(f"{root}/source")
    files = session_files(spark.createDataFrame([(f"{root}/source",)], "base_path STRING"))
    key = F.regexp_extract("path", "/n_nationkey=([0-9]+)/", 1)
    plan = files.select(F.col("path").alias("src_path"), F.concat(F.lit(f"{root}/target/"), key).alias("dst_path"))
    columns = [F.substring_index("dst_path", "/", -1).alias("name"), "files", "bytes", "copied_files", "status", "digest"]
    return _all([copy_objects(plan, changes_only=True).select(F.lit(run).alias("run"), *columns) for run in (1, 2)])


@query(
    """SELECT 'Tables' AS kind, name, 'table' AS type FROM (VALUES ('supplier'), ('part')) n(name), (SELECT count(*) FROM supplier)
  UNION ALL SELECT DISTINCT 'Files', n_name, 'file' FROM supplier JOIN nation ON s_nationkey = n_nationkey"""
)
def session_listing(e):
    """Real folders, listed by Spark's file source, as objects."""
    spark, root = e.spark, folder(e.spark)
    e.supplier.write.parquet(f"{root}/store/Tables/supplier")
    e.part.write.parquet(f"{root}/store/Tables/part")
    names = e.supplier.join(e.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("n_name", "s_name")
    names.write.partitionBy("n_name").text(f"{root}/written")
    source = session_files(spark.createDataFrame([(f"{root}/written",)], "base_path STRING"))
    name = F.regexp_extract("path", "/n_name=([^/]+)/", 1)
    copy_objects(source.select(F.col("path").alias("src_path"), F.concat(F.lit(f"{root}/store/Files/"), F.url_decode(name), F.lit("/"), F.substring_index("path", "/", -1)).alias("dst_path"))).collect()
    found = objects_from_paths(session_files(spark.createDataFrame([(f"{root}/store",)], "base_path STRING")))
    return found.select(F.regexp_extract("src_path", "/store/([A-Za-z]+)/", 1).alias("kind"), "name", "type")


# ---- references in SQL -------------------------------------------------------------------


@query(REFS_SQL)
def sql_refs(e):
    R.register_table_functions(e.spark)
    e.definitions.createOrReplaceTempView("refs_of_definitions")
    return e.spark.sql("SELECT d.doc_id, r.* FROM refs_of_definitions d, LATERAL definition_refs(d.definition) r")
