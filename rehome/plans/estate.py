"""Whole steps: snapshot the estate, restore it, recover its data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rehome.functions.text import schema_enabled
from rehome.lineage import cut
from rehome.operators.picks import union_frames
from rehome.sinks.copy import copy_objects, copy_plan
from rehome.sinks.load import bulk_load, pointer_name, register_pointers
from rehome.sinks.snapshot import outcome_frame, restore_snapshot, save_all
from rehome.sources.objects import list_objects, list_tables


def snapshot_estate(spark: SparkSession, frames: dict[str, DataFrame], **options) -> DataFrame:
    """Save capacities, workspaces, items, git connections, roles and reports: one status row each."""
    return outcome_frame(spark, save_all(frames, **options))


def restore_estate(
    spark: SparkSession, base_path: str, names: list[str], suffix: str = "_recovered", fmt: str = "parquet", **as_of
) -> DataFrame:
    """Restore the named tables below a folder as ``<name><suffix>``; ``as_of`` and ``keys`` as in restore_snapshot."""
    paths = {name: f"{base_path.rstrip('/')}/{name}" for name in names}
    return restore_snapshot(spark, paths, suffix, fmt, **as_of)


def store_objects(stores: DataFrame, strict: bool = True) -> DataFrame:
    """Tables and files of every store (item_id, base_path, properties).

    Stores with schemas are listed by schema, the others by table; files are listed for all of
    them, whether or not there are tables. If not ``strict``, a store that cannot be listed is a row
    with the ``error`` and no name.
    """
    flagged = stores.select("item_id", "base_path", schema_enabled("properties").alias("_schemas"))
    by_schema = list_tables(flagged.filter("_schemas"), strict=strict)
    plain = list_objects(flagged.filter("NOT _schemas"), ["Tables"], strict)
    files = list_objects(flagged, ["Files"], strict)
    found = by_schema.unionByName(plain, allowMissingColumns=True).unionByName(
        files, allowMissingColumns=True
    )
    return found.select("item_id", "schema", "name", "type", "src_path", *([] if strict else ["error"]))


def recover_data(stores: DataFrame, recovery: DataFrame, *, changes_only: bool = False, **rename) -> DataFrame:
    """List, plan and copy all lakehouse data of a recovery map; returns the audit.

    With ``changes_only`` a second run copies what the first has not (``copy_objects``).

    Every lakehouse of the map has a row: one for each object, or one with the status ``no_store``,
    ``unlisted`` (with the error) or ``empty``.
    """
    lakehouses = cut(recovery.filter(F.col("primary_type") == "Lakehouse"))
    wanted = lakehouses.select(F.col("primary_id").alias("item_id")).distinct()
    mine = stores.join(wanted, "item_id", "left_semi")
    found = cut(store_objects(mine, strict=False))
    listed, failed = found.filter("error IS NULL"), found.filter("error IS NOT NULL")
    audit = copy_objects(copy_plan(listed, lakehouses, **rename), changes_only=changes_only)
    bases = mine.select("item_id", F.col("base_path").alias("src_path"))
    empty = bases.join(found, "item_id", "left_anti")
    unread = failed.groupBy("item_id").agg(F.min("src_path").alias("src_path"), F.max("error").alias("error"))
    lost = wanted.join(stores, "item_id", "left_anti")
    return union_frames(
        audit,
        lost.select("item_id", F.lit("no_store").alias("status")),
        unread.select("item_id", "src_path", "error", F.lit("unlisted").alias("status")),
        empty.select("item_id", "src_path", F.lit("empty").alias("status")),
    )


def recover_warehouses(
    spark: SparkSession, objects: DataFrame, recovery: DataFrame, databases: DataFrame, **options
) -> DataFrame:
    """Load the tables of all warehouses of a recovery map; returns a status row for each table.

    ``databases`` (secondary_id, source_database, target_database) says where the pointers of a warehouse
    are created and where its tables go. A table whose pointer fails is not loaded; a warehouse
    without tables or without databases is a row with ``no_tables`` or ``no_database``.
    """
    houses = recovery.filter(F.col("primary_type") == "Warehouse").select(F.col("primary_id").alias("item_id"), "secondary_id")
    placed = houses.join(databases, "secondary_id", "left")
    tables = objects.filter(F.col("type") == "table").select("item_id", "schema", "name", "src_path")
    work = cut(placed.filter("source_database IS NOT NULL AND target_database IS NOT NULL").join(tables, "item_id"))
    pointers = register_pointers(spark, work.withColumn("database", F.col("source_database")))
    target = F.concat(F.col("source_database"), F.lit(".`"), pointer_name(), F.lit("`"))
    usable = pointers.filter(F.col("status").isin("created", "exists")).select(F.col("table").alias("_pointer")).distinct()
    ready = work.withColumn("_pointer", target).join(usable, "_pointer", "left_semi").drop("_pointer")
    loaded = bulk_load(spark, ready, **options)
    empty = placed.filter("source_database IS NOT NULL AND target_database IS NOT NULL").join(work.select("item_id").distinct(), "item_id", "left_anti")
    return union_frames(
        loaded,
        pointers.filter(~F.col("status").isin("created", "exists")),
        empty.select(F.col("target_database").alias("table"), F.lit("no_tables").alias("status")),
        placed.filter("source_database IS NULL OR target_database IS NULL").select(
            F.col("secondary_id").alias("table"), F.lit("no_database").alias("status")),
    )
