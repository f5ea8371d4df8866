"""Plans about items: definitions, semantic models and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rehome.functions.names import LITERAL, strip_suffix
from rehome.functions.text import encoded
from rehome.operators.mapping import MAPPED, UNMAPPED, model_sources
from rehome.operators.picks import first_rows, join_lookup
from rehome.operators.rewrite import (
    changed_definitions,
    extract_refs,
    ref_status,
    reference_splices,
    splice_texts,
)

# How a definition is named and marked in an update request.
PART_PATH = "pipeline-content.json"
PART_TYPE = "InlineBase64"


def update_body(text: Column | str, part_path: str = PART_PATH) -> Column:
    """Request body that carries a definition."""
    part = F.struct(
        F.lit(part_path).alias("path"), encoded(text).alias("payload"), F.lit(PART_TYPE).alias("payloadType")
    )
    return F.to_json(F.struct(F.struct(F.array(part).alias("parts")).alias("definition")))


def definition_plan(
    definitions: DataFrame,
    id_map: DataFrame,
    endpoints: DataFrame | None = None,
    connections: DataFrame | None = None,
    kinds: tuple[str, ...] = ("warehouse", "lakehouse", "notebook", "connection"),
) -> DataFrame:
    """Changed definitions with the body of their update request.

    Texts are parsed once, where their references are found; the new values are spliced in by Spark.
    """
    status = ref_status(extract_refs(definitions, places=True), id_map, connections, endpoints)
    swapped = splice_texts(definitions, reference_splices(status, kinds), only_edited=True)
    changed = changed_definitions(swapped)
    return changed.withColumn("payload", update_body("new_definition"))


def model_plan(
    models: DataFrame,
    endpoints: DataFrame,
    listing: DataFrame,
    workspaces: DataFrame,
    suffix: str,
    match: str = LITERAL,
) -> DataFrame:
    """Semantic models of the new workspaces that are no defaults, with the store to point them at.

    ``models``: new_workspace_id, new_workspace_name, displayName, is_default. The store is that
    of the model of the same name in the old workspace.
    """
    old = workspaces.select(F.col("Id").alias("workspace_id"), F.col("Name").alias("old_ws_name"))
    mine = (
        models.filter(~F.col("is_default"))
        .withColumn("old_ws_name", strip_suffix("new_workspace_name", suffix, match))
        .withColumnRenamed("displayName", "model_name")
    )
    mine = join_lookup(mine, first_rows(old, ["old_ws_name"], ["workspace_id"]), ["old_ws_name"])
    found = model_sources(mine, endpoints, listing)
    return found.withColumn("status", F.when(F.col("source_id").isNull(), UNMAPPED).otherwise(MAPPED))


def report_plan(reports: DataFrame, old_items: DataFrame, new_items: DataFrame) -> DataFrame:
    """Reports (``report_map``) with what to bind them to.

    ``rebind``: the dataset is an item of the snapshot, and the one of its name in the new
    workspace takes its place. ``in_place``: the dataset already is in a new workspace.
    """
    old = old_items.select(
        F.col("old_item_id").alias("old_dataset_id"),
        F.col("old_item_name").alias("_old_name"),
        F.col("new_ws_id").alias("_old_ws_id"),
        F.col("new_ws_name").alias("_old_ws_name"),
    )
    new = new_items.select(
        F.col("new_item_id").alias("old_dataset_id"),
        F.col("new_item_name").alias("_new_name"),
        F.col("new_ws_id").alias("_new_ws_id"),
        F.col("new_ws_name").alias("_new_ws_name"),
    )
    status = (
        F.when(F.col("_old_ws_id").isNotNull(), "rebind")
        .when(F.col("_new_ws_id").isNotNull(), "in_place")
        .otherwise("unknown")
    )
    return (
        reports.join(old, "old_dataset_id", "left")
        .join(new, "old_dataset_id", "left")
        .select(
            *reports.columns,
            status.alias("status"),
            F.coalesce("_old_name", "_new_name").alias("dataset_name"),
            F.coalesce("_old_ws_id", "_new_ws_id").alias("dataset_ws_id"),
            F.coalesce("_old_ws_name", "_new_ws_name").alias("dataset_ws_name"),
        )
    )


def status_counts(plan: DataFrame, *keys: str) -> DataFrame:
    """Rows of a plan by status: the outcome of all rows, not of the last one."""
    return plan.groupBy(*keys, "status").agg(F.count(F.lit(1)).alias("n_rows"))
