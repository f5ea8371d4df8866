"""Plans about data: warehouse staging, pointers and loads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rehome.functions.names import compose_name
from rehome.operators.mapping import NOT_EXISTS, endpoint_lookup, resolve_item
from rehome.operators.picks import first_rows, join_lookup
from rehome.sinks.load import pointer_name, tables_to_copy

# How the helper items of a warehouse load are named.
STAGING_PREFIX = "temp_rlh"
LOADER_PREFIX = "plRecover_WH6"


def with_names(warehouses: DataFrame) -> DataFrame:
    """Recovery rows with the names of the staging store and of the loading item."""
    ends = ("primary_ws_name", "primary_name")
    return warehouses.withColumns(
        {
            "staging_name": compose_name(F.lit(STAGING_PREFIX), *ends),
            "loader_name": compose_name(F.lit(LOADER_PREFIX), *ends),
        }
    )


def staging_plan(recovery: DataFrame, items: DataFrame) -> DataFrame:
    """For each warehouse the staging store and the loader: their id, or ``NotExists`` and a body."""
    named = with_names(recovery.filter(F.col("primary_type") == "Warehouse"))
    for part, item_type in (("staging", "Lakehouse"), ("loader", "DataPipeline")):
        named = resolve_item(
            named.withColumn("_type", F.lit(item_type)),
            items,
            workspace="secondary_ws_id",
            name=f"{part}_name",
            item_type="_type",
            output=f"{part}_id",
        ).drop("_type")
    note = F.concat(
        F.lit("Holds pointers to "),
        compose_name("primary_ws_name", "primary_name"),
        F.lit(" while its tables load into "),
        F.col("secondary_ws_name"),
        F.lit(" "),
        F.col("secondary_ws_id"),
    )
    body = F.to_json(F.struct(F.col("staging_name").alias("displayName"), note.alias("description")))
    # Two warehouses whose cut names meet must not share a staging store.
    rivals = named.groupBy("secondary_ws_id", "staging_name").agg((F.count(F.lit(1)) > 1).alias("_shared"))
    named = join_lookup(named, rivals, ["secondary_ws_id", "staging_name"])
    status = F.when(F.col("_shared"), "name_collision").when(F.col("staging_id") == NOT_EXISTS, "to_create").otherwise("exists")
    return named.withColumns({"payload": F.when(status == "to_create", body), "staging_status": status}).drop("_shared")


def pointer_plan(
    objects: DataFrame, recovery: DataFrame, existing: DataFrame | None = None, target_key: str = "store"
) -> DataFrame:
    """Pointer tables to create in the staging store: one for each table of a warehouse.

    ``existing`` (secondary_id, pointer) are skipped. ``target_key`` is the word the receiving
    service uses for its own storage.
    """
    houses = recovery.filter(F.col("primary_type") == "Warehouse").select(
        F.col("primary_id").alias("item_id"), "primary_ws_id", "secondary_ws_id", "secondary_id"
    )
    place = F.struct(
        F.col("primary_ws_id").alias("workspaceId"),
        F.col("item_id").alias("itemId"),
        F.concat_ws("/", F.lit("/Tables"), "schema", "name").alias("path"),
    )
    body = F.to_json(
        F.struct(
            F.lit("Tables/").alias("path"),
            F.col("pointer").alias("name"),
            F.struct(place.alias(target_key)).alias("target"),
        )
    )
    plan = (
        objects.filter(F.col("type") == "table")
        .join(houses, "item_id")
        .withColumn("pointer", pointer_name())
        .select(
            "secondary_ws_id",
            "secondary_id",
            "item_id",
            "schema",
            "name",
            "pointer",
            "src_path",
            body.alias("payload"),
        )
    )
    if existing is not None:
        plan = plan.join(existing, ["secondary_id", "pointer"], "left_anti")
    return plan


def load_plan(
    staging: DataFrame, objects: DataFrame, endpoints: DataFrame, listing: DataFrame, chunks: int = 16
) -> DataFrame:
    """Load calls for each warehouse: parameters as a body, and a status where one is missing.

    ``staging`` is ``staging_plan``. A warehouse's tables are dealt into ``chunks`` calls; one without
    tables is a row with the status ``no_tables``.
    """
    source = endpoint_lookup(
        staging.select(
            "primary_id",
            "secondary_id",
            "secondary_ws_id",
            F.col("secondary_ws_id").alias("workspace_id"),
            F.col("staging_id").alias("item_id"),
            F.col("staging_name").alias("item_name"),
            "loader_id",
            "staging_status",
        ),
        endpoints,
        listing,
    ).select(
        "primary_id",
        "secondary_id",
        "secondary_ws_id",
        "loader_id",
        "staging_status",
        F.col("endpoint_id").alias("staging_endpoint_id"),
        F.col("connection_string").alias("staging_connection"),
    )
    target = first_rows(
        endpoints.select(
            F.col("workspace_id").alias("secondary_ws_id"),
            F.col("item_id").alias("secondary_id"),
            F.col("connection_string").alias("target_connection"),
        ),
        ["secondary_ws_id", "secondary_id"],
        ["target_connection"],
    )
    mine = staging.select(F.col("primary_id").alias("item_id")).distinct()
    tables = objects.filter(F.col("type") == "table").join(mine, "item_id", "left_semi")
    lists = tables_to_copy(tables, chunks=chunks).withColumnRenamed("item_id", "primary_id")
    status = (
        F.when(F.col("tables").isNull(), "no_tables")
        .when(F.col("staging_status") == "name_collision", "name_collision")
        .when(F.col("loader_id") == NOT_EXISTS, "no_loader")
        .when(F.col("staging_endpoint_id").isNull(), "no_staging_endpoint")
        .when(F.col("staging_connection").isNull(), "no_staging_connection")
        .when(F.col("target_connection").isNull(), "no_target_connection")
        .otherwise("ready")
    )
    return (
        join_lookup(source, target, ["secondary_ws_id", "secondary_id"])
        .join(lists, "primary_id", "left")
        .withColumn("n_tables", F.coalesce("n_tables", F.lit(0)))
        .withColumn("status", status)
        .withColumn("payload", F.when(F.col("status") == "ready", _load_body()))
        .drop("tables")
    )


def _load_body() -> Column:
    parameters = F.struct(
        F.col("staging_endpoint_id").alias("lakehouseId"),
        F.col("tables").alias("tablesToCopy"),
        F.col("secondary_ws_id").alias("workspaceId"),
        F.col("secondary_id").alias("warehouseId"),
        F.col("staging_connection").alias("lakehouseConnStr"),
        F.col("target_connection").alias("warehouseConnStr"),
    )
    return F.to_json(F.struct(F.struct(parameters.alias("parameters")).alias("executionData")))
