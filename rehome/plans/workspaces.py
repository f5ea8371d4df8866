"""Plans about workspaces: capacity gate, recreate, git, roles, clean up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rehome.functions.names import LITERAL, add_suffix, has_suffix, is_guid, strip_suffix
from rehome.operators.picks import first_rows, join_lookup
from rehome.operators.scope import WORKSPACE, in_scope, protect, scope

# A capacity that cannot take a workspace, and a connection worth restoring.
INACTIVE = "Inactive"
CONNECTED = "ConnectedAndInitialized"


def capacity_gate(targets: DataFrame, capacities: DataFrame, column: str = "capacity_ref") -> DataFrame:
    """Targets named by id or by name, with the capacity found and ``ok``, ``inactive`` or ``missing``."""
    known = capacities.select(
        F.col("Id").alias("capacity_id"), F.col("Display_Name").alias("capacity_name"), F.col("State").alias("state")
    )
    # One lookup table for both ways of naming keeps the join an equi-join.
    by_ref = known.select(F.lower("capacity_id").alias("_ref"), "*").unionByName(
        known.select(F.col("capacity_name").alias("_ref"), "*")
    )
    ref = F.when(is_guid(column), F.lower(column)).otherwise(F.col(column))
    gate = (
        F.when(F.col("capacity_id").isNull(), "missing")
        .when(F.col("state") == INACTIVE, "inactive")
        .otherwise("ok")
    )
    one = first_rows(by_ref, ["_ref"], ["capacity_id"])
    found = join_lookup(targets.withColumn("_ref", ref), one, ["_ref"])
    return found.withColumn("gate", gate).drop("_ref")


def recreate_plan(
    snapshot: DataFrame,
    suffix: str,
    capacity_id: str,
    *,
    self_id: str | None = None,
    source_name: str | None = None,
    **lists,
) -> DataFrame:
    """Workspaces to create: each in scope once, under its name with the suffix."""
    kept = protect(scope(snapshot, **lists), self_id=self_id, source_name=source_name)
    distinct = kept.filter(F.col("Type") == WORKSPACE).select("Id", "Type", "Name", "Capacity_Id").distinct()
    name = add_suffix("Name", suffix)
    return distinct.select(
        F.col("Id").alias("old_ws_id"),
        F.col("Name").alias("old_ws_name"),
        F.col("Capacity_Id").alias("old_capacity_id"),
        name.alias("new_ws_name"),
        F.to_json(F.struct(name.alias("displayName"), F.lit(capacity_id).alias("capacityId"))).alias("payload"),
    )


def _copies(workspaces: DataFrame, suffix: str, match: str, self_id: str | None) -> DataFrame:
    mine = protect(workspaces.filter(has_suffix("Name", suffix, match)), self_id=self_id)
    return mine.select(
        F.col("Id").alias("new_workspace_id"),
        F.col("Name").alias("new_workspace"),
        strip_suffix("Name", suffix, match).alias("_old_name"),
    )


def git_plan(
    git: DataFrame,
    workspaces: DataFrame,
    suffix: str,
    *,
    self_id: str | None = None,
    match: str = LITERAL,
    exclude_like: list[str] = (),
    **lists,
) -> DataFrame:
    """Present workspaces to connect to the repository of their original.

    ``include`` and ``exclude`` name the original, ``exclude_like`` the present workspace.
    """
    kept = git.filter((F.col("gitConnectionState") == CONNECTED) & in_scope("Workspace_Name", **lists)).select(
        F.col("Workspace_Name").alias("_old_name"), "gitConnectionState", "gitProviderDetails"
    )
    copies = _copies(workspaces, suffix, match, self_id).filter(
        in_scope("new_workspace", exclude_like=exclude_like)
    )
    return kept.join(copies, "_old_name").select(
        "gitConnectionState",
        "gitProviderDetails",
        F.col("new_workspace").alias("Workspace_Name"),
        F.col("new_workspace_id").alias("Workspace_ID"),
        F.concat(F.lit('{"gitProviderDetails":'), "gitProviderDetails", F.lit("}")).alias("payload"),
    )


def role_plan(
    roles: DataFrame,
    workspaces: DataFrame,
    suffix: str,
    *,
    self_id: str | None = None,
    match: str = LITERAL,
    exclude_like: list[str] = (),
    **lists,
) -> DataFrame:
    """Role assignments to repeat in the present workspaces, with all snapshot columns."""
    kept = roles.filter(in_scope("workspaceName", **lists))
    copies = _copies(workspaces, suffix, match, self_id).filter(
        in_scope("new_workspace", exclude_like=exclude_like)
    )
    payload = F.to_json(
        F.struct(
            F.struct(F.col("principalId").alias("id"), F.col("principalType").alias("type")).alias("principal"),
            F.col("role"),
        )
    )
    return kept.join(copies, F.col("workspaceName") == F.col("_old_name")).select(
        "new_workspace_id", "new_workspace", *roles.columns, payload.alias("payload")
    )


def cleanup_plan(
    workspaces: DataFrame,
    suffix: str,
    *,
    self_id: str | None = None,
    source_name: str | None = None,
    match: str = LITERAL,
    **lists,
) -> DataFrame:
    """Recovered workspaces that a clean up would remove. Nothing here removes them."""
    mine = protect(
        scope(workspaces, suffix=suffix, match=match, **lists), self_id=self_id, source_name=source_name
    )
    return mine.filter(F.col("Type") == WORKSPACE).select("Id", "Type", "Name").distinct()
