"""From the snapshot to the present estate: workspace and item maps, and lookups over them.

Every item first gets the name of its own workspace (ids are unique, so no row multiplies), and
the two estates meet once, on (workspace name, type, item name). Items that share a name in
other workspaces never meet, and the hot sides are split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rehome.functions.names import LIKE, LITERAL, has_suffix, is_guid, strip_suffix
from rehome.operators.picks import first_rows, join_lookup
from rehome.operators.scope import of_type, protect, scope

NOT_EXISTS = "NotExists"
MAPPED, UNMAPPED, PARAMETER, AMBIGUOUS = "mapped", "unmapped", "parameter", "ambiguous"
DATA_TYPES = ("Lakehouse", "Warehouse")


def _old_side(workspaces: DataFrame, *extra: Column) -> DataFrame:
    return workspaces.select(
        F.col("Id").alias("old_ws_id"), F.col("Name").alias("old_ws_name"), *extra
    )


def _new_side(
    workspaces: DataFrame,
    suffix: str,
    match: str,
    self_id: str | None = None,
    source_name: str | None = None,
    lists: dict | None = None,
    renamed: bool = False,
) -> DataFrame:
    """Present workspaces that may be a copy, with ``old_ws_name``, the name of the original.

    ``renamed`` asks only that removing the suffix changes the name.
    """
    if renamed and match == LIKE:
        mine = workspaces.filter(F.contains(F.col("Name"), F.lit(suffix)))
    else:
        mine = workspaces.filter(has_suffix("Name", suffix, match))
    mine = protect(mine, self_id=self_id, source_name=source_name)
    if lists:
        mine = scope(mine, **lists)
    return mine.select(
        F.col("Id").alias("new_ws_id"),
        F.col("Name").alias("new_ws_name"),
        strip_suffix("Name", suffix, match).alias("old_ws_name"),
    )


def workspace_map(
    snapshot: DataFrame,
    current: DataFrame,
    suffix: str,
    *,
    self_id: str | None = None,
    source_name: str | None = None,
    match: str = LITERAL,
) -> DataFrame:
    """old_ws_id, old_ws_name, new_ws_id, new_ws_name."""
    new = _new_side(current, suffix, match, self_id, source_name)
    return _old_side(snapshot).join(new, "old_ws_name").select(
        "old_ws_id", "old_ws_name", "new_ws_id", "new_ws_name"
    )


def unique_workspace_map(snapshot: DataFrame, current: DataFrame, suffix: str, **options) -> DataFrame:
    """One row for each old workspace: the copy with the smallest id, and whether there are more."""
    match = options.pop("match", LITERAL)
    new = _new_side(current, suffix, match, **options)
    one = _picked(new, ["old_ws_name"], "new_ws_id", ["new_ws_name"])
    return join_lookup(_old_side(snapshot), one, ["old_ws_name"], "inner").select(
        "old_ws_id",
        "old_ws_name",
        F.col("picks")[0]["new_ws_id"].alias("new_ws_id"),
        F.col("picks")[0]["new_ws_name"].alias("new_ws_name"),
        (F.size("picks") > 1).alias("ambiguous"),
    )


def unmatched_workspaces(snapshot: DataFrame, current: DataFrame, suffix: str, **options) -> DataFrame:
    """Snapshot workspaces that no present workspace stands for."""
    match = options.pop("match", LITERAL)
    new = _new_side(current, suffix, match, **options)
    return _old_side(snapshot).join(new, "old_ws_name", "left_anti")


def unmatched_capacities(workspaces: DataFrame, capacities: DataFrame) -> DataFrame:
    """Snapshot workspaces that the data recovery leaves out because their capacity is unknown."""
    known = capacities.select(F.col("Id").alias("Capacity_Id"))
    return workspaces.join(known, "Capacity_Id", "left_anti")


def _picked(df: DataFrame, keys: list[str], id: str, columns: list[str], n: int = 2) -> DataFrame:
    """For each key the n rows with the smallest ids, as an array ``picks`` in id order."""
    rows = first_rows(df.select(*keys, id, *columns), keys, [id], n)
    return rows.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(id, *columns))).alias("picks")
    )


def _old_items(items: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Snapshot items with the name of their workspace."""
    mine = items.select(
        F.col("id").alias("old_item_id"),
        "type",
        F.col("displayName").alias("itm_name"),
        F.col("workspaceId").alias("old_ws_id"),
    )
    return mine.join(workspaces, "old_ws_id")


def _new_items(items: DataFrame, new_workspaces: DataFrame) -> DataFrame:
    mine = items.select(
        F.col("id").alias("new_item_id"),
        "type",
        F.col("displayName").alias("itm_name"),
        F.col("workspaceId").alias("new_ws_id"),
    )
    return mine.join(new_workspaces, "new_ws_id")


ITEM_KEY = ["old_ws_name", "type", "itm_name"]


def item_id_map(
    snapshot_items: DataFrame,
    snapshot_ws: DataFrame,
    items: DataFrame,
    workspaces: DataFrame,
    suffix: str,
    *,
    self_id: str | None = None,
    match: str = LITERAL,
    **lists,
) -> DataFrame:
    """Every (old item, new item) pair of the same workspace, type and name.

    An item whose name occurs twice has several rows; ``unique_map`` has one for each old id.
    """
    new_ws = _new_side(workspaces, suffix, match, self_id, lists=lists, renamed=True)
    old = _old_items(snapshot_items, _old_side(snapshot_ws))
    new = _new_items(items, new_ws)
    pairs = old.join(new, ITEM_KEY)
    return pairs.filter(
        (F.col("old_item_id") != F.col("new_item_id"))
        & (F.col("new_ws_name") != F.col("old_ws_name"))
    ).select(
        "type",
        "old_item_id",
        "new_item_id",
        "itm_name",
        "old_ws_id",
        "old_ws_name",
        "new_ws_id",
        "new_ws_name",
    )


def _unique_pairs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old items with the candidate of the smallest id, and ``ambiguous``.

    Candidates are reduced before the join, so a name that a third of all items share costs one
    row on the new side and no pairs. Three are kept: one may be the old item itself, and two
    others tell that the pick had a rival.
    """
    picked = _picked(new, ITEM_KEY, "new_item_id", ["new_ws_id", "new_ws_name"], n=3)
    found = _with_pick(join_lookup(old, picked, ITEM_KEY, "inner"), "new_item_id", "old_item_id")
    return found.filter(F.col("pick.new_ws_name") != F.col("old_ws_name")).select(
        *old.columns, "pick.new_item_id", "pick.new_ws_id", "pick.new_ws_name", "ambiguous"
    )


def _with_pick(df: DataFrame, id: str, own: str) -> DataFrame:
    """Rows with the first of their ``picks`` that is not the row itself, and ``ambiguous``.

    Plain expressions keep this in generated code, which counts where one task has a hot key.
    """
    first = F.get("picks", F.lit(0))
    pick = F.when(first[id] == F.col(own), F.get("picks", F.lit(1))).otherwise(first)
    others = F.size("picks") - F.array_contains(F.col(f"picks.{id}"), F.col(own)).cast("int")
    found = df.withColumns({"pick": pick, "ambiguous": others > 1})
    return found.filter(F.col("pick").isNotNull())


def unique_map(
    snapshot_items: DataFrame,
    snapshot_ws: DataFrame,
    items: DataFrame,
    workspaces: DataFrame,
    suffix: str,
    *,
    self_id: str | None = None,
    match: str = LITERAL,
    **lists,
) -> DataFrame:
    """As item_id_map with one row for each old item, and ``ambiguous``."""
    new_ws = _new_side(workspaces, suffix, match, self_id, lists=lists, renamed=True)
    old = _old_items(snapshot_items, _old_side(snapshot_ws))
    return _unique_pairs(old, _new_items(items, new_ws)).select(
        "type",
        "old_item_id",
        "new_item_id",
        "itm_name",
        "old_ws_id",
        "old_ws_name",
        "new_ws_id",
        "new_ws_name",
        "ambiguous",
    )


def recovery_map(
    snapshot_items: DataFrame,
    snapshot_ws: DataFrame,
    capacities: DataFrame,
    items: DataFrame,
    workspaces: DataFrame,
    suffix: str,
    *,
    self_id: str | None = None,
    include: list[str] = (),
    match: str = LITERAL,
    unique: bool = False,
) -> DataFrame:
    """Stores whose data is to be moved, primary and secondary side by side.

    A store whose name occurs twice has several rows; with ``unique`` each has one, and a further
    column ``ambiguous``.
    """
    new_ws = _new_side(workspaces, suffix, match, self_id)
    cap = capacities.select(
        F.col("Id").alias("Capacity_Id"), F.col("display_name").alias("capacity_name")
    )
    old_ws = _old_side(scope(snapshot_ws, include=include), F.col("Capacity_Id")).join(
        cap, "Capacity_Id"
    )
    old = _old_items(of_type(snapshot_items, *DATA_TYPES), old_ws)
    new = _new_items(of_type(items, *DATA_TYPES), new_ws)
    pairs = _unique_pairs(old, new) if unique else old.join(new, ITEM_KEY)
    return pairs.select(
        F.col("old_ws_name").alias("primary_ws_name"),
        F.col("type").alias("primary_type"),
        F.col("itm_name").alias("primary_name"),
        F.col("old_ws_id").alias("primary_ws_id"),
        F.col("old_item_id").alias("primary_id"),
        F.col("new_ws_id").alias("secondary_ws_id"),
        F.col("new_ws_name").alias("secondary_ws_name"),
        F.col("new_item_id").alias("secondary_id"),
        F.col("itm_name").alias("secondary_name"),
        "capacity_name",
        *(["ambiguous"] if unique else []),
    )


def _ranked(df: DataFrame, keys: list[str], id: str) -> DataFrame:
    """Rows with their rank within the keys, in the order of md5(id).

    Rows of a key are dealt into 256 buckets by the first two digits of the hash. A bucket's rows are
    numbered by themselves, and its start is the sum of the counts of those before it, at most 256 rows a
    key: a name that very many items share is not one group in one task.
    """
    hashed = df.withColumn("_hash", F.md5(F.col(id).cast("binary"))).withColumn("_bucket", F.left("_hash", F.lit(2)))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = hashed.groupBy(*keys, "_bucket").count()
    starts = counts.select(*keys, "_bucket", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*keys, "_bucket").orderBy("_hash", id)
    numbered = hashed.withColumn("_n", F.row_number().over(within))
    ranked = numbered.join(starts, [*keys, "_bucket"]).withColumn("rank", F.col("_start") + F.col("_n"))
    return ranked.drop("_hash", "_bucket", "_start", "_n")


def paired_recovery_map(
    snapshot_items: DataFrame,
    snapshot_ws: DataFrame,
    capacities: DataFrame,
    items: DataFrame,
    workspaces: DataFrame,
    suffix: str,
    *,
    self_id: str | None = None,
    include: list[str] = (),
    match: str = LITERAL,
) -> DataFrame:
    """Each store of the snapshot once, with a store of its own: the map that actions are built on.

    Of the stores that share workspace name, type and name, the k-th old one goes with the k-th new
    one, in the order of md5(id). ``status`` is ``paired``, or ``unpaired`` where new ones run out.
    """
    new_ws = _new_side(workspaces, suffix, match, self_id)
    cap = capacities.select(F.col("Id").alias("Capacity_Id"), F.col("display_name").alias("capacity_name"))
    old_ws = _old_side(scope(snapshot_ws, include=include), F.col("Capacity_Id")).join(cap, "Capacity_Id")
    old = _ranked(_old_items(of_type(snapshot_items, *DATA_TYPES), old_ws), ITEM_KEY, "old_item_id")
    new = _ranked(_new_items(of_type(items, *DATA_TYPES), new_ws), ITEM_KEY, "new_item_id")
    pairs = old.join(new, [*ITEM_KEY, "rank"], "left")
    found = F.col("new_item_id").isNotNull()
    return pairs.select(
        F.col("old_ws_name").alias("primary_ws_name"),
        F.col("type").alias("primary_type"),
        F.col("itm_name").alias("primary_name"),
        F.col("old_ws_id").alias("primary_ws_id"),
        F.col("old_item_id").alias("primary_id"),
        F.col("new_ws_id").alias("secondary_ws_id"),
        F.col("new_ws_name").alias("secondary_ws_name"),
        F.col("new_item_id").alias("secondary_id"),
        F.when(found, F.col("itm_name")).alias("secondary_name"),
        "capacity_name",
        F.when(found, "paired").otherwise("unpaired").alias("status"),
    )


def recovery_summary(recovery: DataFrame) -> DataFrame:
    """The columns to look at, by type and workspace."""
    return recovery.orderBy("primary_type", "primary_ws_name", "primary_id", "secondary_id").select(
        "primary_ws_name",
        "primary_type",
        "primary_name",
        "secondary_ws_name",
        "secondary_name",
        "secondary_ws_id",
        "capacity_name",
    )


def counts_by(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of each group, and whether there are any; without keys one row for the frame."""
    grouped = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    return grouped.withColumn("any_rows", F.col("n_rows") > 0)


def old_item_lookup(
    snapshot_items: DataFrame, snapshot_ws: DataFrame, workspaces: DataFrame, suffix: str, **options
) -> DataFrame:
    """Snapshot items with the old and the new workspace."""
    return _old_item_columns(snapshot_items, workspace_map(snapshot_ws, workspaces, suffix, **options))


def unique_old_items(
    snapshot_items: DataFrame, snapshot_ws: DataFrame, workspaces: DataFrame, suffix: str, **options
) -> DataFrame:
    """As old_item_lookup with one row for each item, for lookups by id."""
    pairs = unique_workspace_map(snapshot_ws, workspaces, suffix, **options)
    return _old_item_columns(snapshot_items, pairs, "ambiguous")


def _old_item_columns(items: DataFrame, pairs: DataFrame, *extra: str) -> DataFrame:
    mine = items.select(
        F.col("id").alias("old_item_id"),
        F.col("displayName").alias("old_item_name"),
        F.col("workspaceId").alias("old_ws_id"),
    )
    return mine.join(pairs, "old_ws_id").select(
        "old_item_id",
        "old_item_name",
        "old_ws_id",
        "old_ws_name",
        "new_ws_id",
        "new_ws_name",
        *extra,
    )


def _in_copies(items, workspaces, suffix, self_id, source_name, match, lists) -> DataFrame:
    copies = protect(
        scope(workspaces, suffix=suffix, match=match, **lists),
        self_id=self_id,
        source_name=source_name,
    ).select(F.col("Id").alias("workspaceId"), F.col("Name").alias("_ws_name"))
    return items.join(copies, "workspaceId")


def new_item_lookup(
    items: DataFrame,
    workspaces: DataFrame,
    suffix: str,
    *,
    self_id: str | None = None,
    match: str = LITERAL,
) -> DataFrame:
    """Present items of the recovered workspaces."""
    return _in_copies(items, workspaces, suffix, self_id, None, match, {}).select(
        F.col("id").alias("new_item_id"),
        F.col("displayName").alias("new_item_name"),
        F.col("workspaceId").alias("new_ws_id"),
        F.col("_ws_name").alias("new_ws_name"),
    )


def items_by_type(
    items: DataFrame,
    workspaces: DataFrame,
    item_type: str,
    suffix: str,
    *,
    self_id: str | None = None,
    source_name: str | None = None,
    match: str = LITERAL,
    **lists,
) -> DataFrame:
    """Present items of one type in the recovered workspaces, all item columns kept."""
    mine = items.filter(F.col("type") == item_type)
    found = _in_copies(mine, workspaces, suffix, self_id, source_name, match, lists)
    return found.select(
        F.col("workspaceId").alias("new_workspace_id"),
        F.col("_ws_name").alias("new_workspace_name"),
        *items.columns,
    )


def lookup_items(ids: DataFrame, id_map: DataFrame, column: str = "old_item_id") -> DataFrame:
    """Rows of ``ids`` with the old and new names and ids of their item, and a status.

    ``id_map`` has one row for each old id (``unique_map``).
    """
    found = id_map.withColumnRenamed("old_item_id", column)
    status = (
        F.when(F.col("new_item_id").isNull(), UNMAPPED)
        .when(F.col("ambiguous"), AMBIGUOUS)
        .otherwise(MAPPED)
    )
    return ids.join(found, column, "left").withColumn("status", status).drop("ambiguous")


def refs_known(refs: DataFrame, id_map: DataFrame, column: str = "old_id") -> DataFrame:
    return refs.join(id_map.select(F.col("old_item_id").alias(column)), column, "left_semi")


def refs_unknown(refs: DataFrame, id_map: DataFrame, column: str = "old_id") -> DataFrame:
    return refs.join(id_map.select(F.col("old_item_id").alias(column)), column, "left_anti")


def resolve_item(
    requests: DataFrame,
    items: DataFrame,
    *,
    workspace: str = "workspace_id",
    name: str = "item_name",
    item_type: str | None = "item_type",
    output: str = "item_id",
) -> DataFrame:
    """Requests with the id of the item of that workspace, name and type, or ``NotExists``.

    Without a type any item of the name answers. Several answers: the smallest id.
    """
    keys = {workspace: "workspaceId", name: "displayName"}
    if item_type is not None:
        keys[item_type] = "type"
    listed = items.select(
        F.col("id").alias(output), *[F.col(there).alias(here) for here, there in keys.items()]
    )
    one = first_rows(listed, list(keys), [output])
    return join_lookup(requests, one, list(keys)).withColumn(
        output, F.coalesce(output, F.lit(NOT_EXISTS))
    )


def model_sources(models: DataFrame, endpoints: DataFrame, listing: DataFrame) -> DataFrame:
    """The store behind each semantic model: endpoint id → its name → the store of that name.

    ``models``: workspace_id, model_name and columns to keep; ``endpoints``: workspace_id,
    model_name, endpoint_id; ``listing``: workspace_id, Id, ``Display Name``, Type.
    """
    doors = listing.filter(F.col("Type").isin("SQLEndpoint", "Warehouse")).select(
        "workspace_id", F.col("Id").alias("endpoint_id"), F.col("Display Name").alias("source_name")
    )
    stores = listing.filter(F.col("Type").isin("Lakehouse", "Warehouse")).select(
        "workspace_id",
        F.col("Display Name").alias("source_name"),
        F.col("Id").alias("source_id"),
        F.col("Type").alias("source_type"),
    )
    stores = first_rows(stores, ["workspace_id", "source_name"], ["source_id"])
    endpoints = first_rows(endpoints, ["workspace_id", "model_name"], ["endpoint_id"])
    found = join_lookup(models, endpoints, ["workspace_id", "model_name"])
    found = found.join(doors, ["workspace_id", "endpoint_id"], "left")
    return join_lookup(found, stores, ["workspace_id", "source_name"])


def resolve_connections(pairs: list[tuple[str, str]], connections: DataFrame) -> DataFrame:
    """(from, to) pairs given by name or id, as ids: seq, from_ref, to_ref, from_id, to_id, status.

    A name that no connection has leaves its pair ``unresolved``.
    """
    spark = connections.sparkSession
    asked = spark.createDataFrame(
        [(i, a, b) for i, (a, b) in enumerate(pairs)], "seq INT, from_ref STRING, to_ref STRING"
    )
    names = sorted({ref for pair in pairs for ref in pair})
    named = connections.select(
        F.col("Connection Name").alias("ref"), F.col("Connection Id").alias("id")
    ).filter(F.col("ref").isin(names))
    named = first_rows(named, ["ref"], ["id"])
    for end in ("from", "to"):
        found = named.select(F.col("ref").alias(f"{end}_ref"), F.col("id").alias(f"_{end}"))
        asked = asked.join(found, f"{end}_ref", "left").withColumn(
            f"{end}_id", F.when(is_guid(f"{end}_ref"), F.col(f"{end}_ref")).otherwise(F.col(f"_{end}"))
        )
    resolved = F.col("from_id").isNotNull() & F.col("to_id").isNotNull()
    return asked.select(
        "seq",
        "from_ref",
        "to_ref",
        "from_id",
        "to_id",
        F.when(resolved, "resolved").otherwise("unresolved").alias("status"),
    )


def connection_targets(resolved: DataFrame) -> DataFrame:
    """old_id → new_id after all pairs have been applied in order, so A→B, B→C takes A to C.

    The pairs are the caller's own list, so an array of them is small whatever the estate.
    """
    good = resolved.filter(F.col("status") == "resolved")
    order = F.sort_array(F.collect_list(F.struct("seq", "from_id", "to_id")))
    steps = good.agg(order.alias("steps"))
    end = F.aggregate(
        "steps",
        F.col("old_id"),
        lambda at, step: F.when(step["from_id"] == at, step["to_id"]).otherwise(at),
    )
    return (
        steps.select("steps", F.explode(F.array_distinct(F.col("steps.from_id"))).alias("old_id"))
        .select("old_id", end.alias("new_id"))
    )


def endpoint_lookup(stores: DataFrame, endpoints: DataFrame, listing: DataFrame) -> DataFrame:
    """Stores (workspace_id, item_id, item_name) with endpoint id and connection string.

    ``endpoints``: workspace_id, item_id, type, connection_string. The endpoint id is that of
    the SQLEndpoint of the same name; a status tells what is missing.
    """
    strings = first_rows(
        endpoints.select("workspace_id", "item_id", "connection_string"),
        ["workspace_id", "item_id"],
        ["connection_string"],
    )
    doors = listing.filter(F.col("Type") == "SQLEndpoint").select(
        "workspace_id", F.col("Display Name").alias("item_name"), F.col("Id").alias("endpoint_id")
    )
    doors = first_rows(doors, ["workspace_id", "item_name"], ["endpoint_id"])
    status = (
        F.when(F.col("connection_string").isNull(), "no_connection_string")
        .when(F.col("endpoint_id").isNull(), "no_endpoint")
        .otherwise("ok")
    )
    found = join_lookup(stores, strings, ["workspace_id", "item_id"])
    return join_lookup(found, doors, ["workspace_id", "item_name"]).withColumn("status", status)


def report_map(
    reports: DataFrame,
    items: DataFrame,
    workspaces: DataFrame,
    snapshot_reports: DataFrame,
    snapshot_items: DataFrame,
    snapshot_ws: DataFrame,
    suffix: str,
    *,
    match: str = LITERAL,
    unique: bool = False,
    **lists,
) -> DataFrame:
    """Present reports with the snapshot report of the same workspace and name.

    With ``unique`` a present report has one row, with the smallest snapshot id, and a further
    column ``ambiguous``; the snapshot side is then reduced before the join.
    """
    new_ws = _new_side(workspaces, suffix, match, lists=lists, renamed=True)
    new = (
        reports.select(F.col("Id").alias("new_rep_id"), "Name", F.col("Dataset_Id").alias("old_dataset_id"))
        .join(items.select(F.col("id").alias("new_rep_id"), F.col("workspaceId").alias("new_ws_id")), "new_rep_id")
        .join(new_ws, "new_ws_id")
    )
    old = (
        snapshot_reports.select(F.col("Id").alias("old_rep_id"), "Name")
        .join(
            snapshot_items.select(F.col("id").alias("old_rep_id"), F.col("workspaceId").alias("old_ws_id")),
            "old_rep_id",
        )
        .join(_old_side(snapshot_ws), "old_ws_id")
    )
    columns = [
        "Name",
        "old_dataset_id",
        "old_rep_id",
        "new_rep_id",
        "old_ws_id",
        "old_ws_name",
        "new_ws_id",
        "new_ws_name",
    ]
    keys = ["old_ws_name", "Name"]
    renamed = F.col("new_ws_name") != F.col("old_ws_name")
    if not unique:
        pairs = new.join(old, keys)
        return pairs.filter(renamed & (F.col("old_rep_id") != F.col("new_rep_id"))).select(columns)
    picked = _picked(old, keys, "old_rep_id", ["old_ws_id"], n=3)
    found = _with_pick(join_lookup(new, picked, keys, "inner"), "old_rep_id", "new_rep_id")
    found = found.select("*", "pick.old_rep_id", "pick.old_ws_id")
    return found.filter(renamed).select(*columns, "ambiguous")
