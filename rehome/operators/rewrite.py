"""References inside definitions, for all documents in one job.

Only the small reference rows are looked up and grouped; a document's text is read in place,
and crosses a shuffle once, to meet its own edits.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rehome.functions import references as R
from rehome.functions.names import is_guid
from rehome.functions.text import has_key
from rehome.operators.mapping import AMBIGUOUS, MAPPED, NOT_EXISTS, PARAMETER, UNMAPPED
from rehome.operators.picks import first_rows, join_lookup

REF_SCHEMA = (
    "doc_id STRING, path STRING, kind STRING, old_id STRING, workspace_id STRING, endpoint STRING"
)
PLACED_SCHEMA = REF_SCHEMA + ", id_at LONG, id_end LONG, ws_at LONG, ws_end LONG, endpoint_at LONG, endpoint_end LONG"
LAKEHOUSE_PATH = "$.metadata.dependencies.lakehouse"
WAREHOUSE_PATH = "$.metadata.dependencies.warehouse"


def _extract(batches):
    for pdf in batches:
        rows = []
        for doc_id, text in zip(pdf["doc_id"], pdf["definition"]):
            for path, kind, holder in R.sites(R.parse(text)):
                link = kind != R.CONNECTION
                rows.append(
                    (
                        doc_id,
                        path,
                        kind,
                        R.as_text(holder[R.ID_FIELD[kind]]),
                        R.as_text(holder.get("workspaceId")) if link else None,
                        R.as_text(holder.get("endpoint")) if kind == R.WAREHOUSE else None,
                    )
                )
        yield pd.DataFrame(
            rows, columns=["doc_id", "path", "kind", "old_id", "workspace_id", "endpoint"], dtype=object
        )


def _locate(batches):
    for pdf in batches:
        rows = []
        for doc_id, text in zip(pdf["doc_id"], pdf["definition"]):
            plain = text.isascii() if text is not None else True
            for path, kind, holder, places in R.located(text):
                values = [R.as_text(holder.get(field)) for field in R.FIELDS[kind]]
                spots = [s if plain else tuple(len(text[:x].encode()) for x in s) for s in (places[field] for field in R.FIELDS[kind])]
                gap = [None] * (3 - len(values))
                rows.append((doc_id, path, kind, *values, *gap, *[x for s in spots for x in s], *gap, *gap))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in PLACED_SCHEMA.split(", ")], dtype=object)


def may_refer(column: Column | str = "definition") -> Column:
    """False only for a text that cannot hold a reference; such a text need not go to Python.

    A key is there in plain letters, or else spelt with a backslash-u escape.
    """
    text = F.col(column) if isinstance(column, str) else column
    words = (R.LINK_KEY, R.NOTEBOOK_ACTIVITY, R.EXTERNAL_KEY, "\\u")
    return reduce(or_, [text.contains(word) for word in words])


def extract_refs(definitions: DataFrame, places: bool = False) -> DataFrame:
    """One row for each reference at any depth: doc_id, path, kind, old_id, workspace_id, endpoint.

    With ``places`` also where each of the three values starts and ends in the text, in bytes; an absent one is
    an empty place after the last field. ``reference_splices`` needs them.
    """
    texts = definitions.select("doc_id", "definition").filter(may_refer())
    return texts.mapInPandas(_locate, PLACED_SCHEMA) if places else texts.mapInPandas(_extract, REF_SCHEMA)


class DefinitionRefs:
    """The references of one definition: path, kind, old_id, workspace_id, endpoint."""

    def eval(self, definition: str):
        for path, kind, holder in R.sites(R.parse(definition)):
            values = [R.as_text(holder.get(field)) for field in R.FIELDS[kind]]
            yield path, kind, *values, *[None] * (3 - len(values))


def register_table_functions(spark: SparkSession, name: str = "definition_refs") -> None:
    """Make ``extract_refs`` known to SQL: ``SELECT d.doc_id, r.* FROM definitions d, LATERAL definition_refs(d.definition) r``."""
    spark.udtf.register(name, F.udtf(DefinitionRefs, returnType=REF_SCHEMA.partition(", ")[2]))


@F.pandas_udf(T.BooleanType())
def _is_unreadable(text: pd.Series) -> pd.Series:
    return pd.Series([R.parse(t) is None for t in text])


def unreadable_definitions(definitions: DataFrame) -> DataFrame:
    """Documents that are no JSON object or array; every step leaves them as they are."""
    return definitions.filter(_is_unreadable("definition"))


def ref_status(
    refs: DataFrame,
    id_map: DataFrame,
    connections: DataFrame | None = None,
    endpoints: DataFrame | None = None,
) -> DataFrame:
    """References with their target and status: new_id, new_ws_id, new_endpoint, status.

    ``id_map`` is ``unique_map``; ``connections`` is ``connection_targets``; ``endpoints``
    (workspace_id, item_id, connection_string) meet the map, which is smaller than the references.
    ``parameter`` is an id that is an expression, ``ambiguous`` one whose target had rivals.
    """
    text = F.lit(None).cast("string")
    targets = id_map.select(
        F.lit(False).alias("_conn"),
        F.col("old_item_id").alias("old_id"),
        F.col("new_item_id").alias("new_id"),
        "new_ws_id",
        "ambiguous",
    )
    if endpoints is None:
        targets = targets.withColumn("new_endpoint", text)
    else:
        strings = endpoints.filter(F.col("connection_string").isNotNull()).select(
            F.col("workspace_id").alias("new_ws_id"),
            F.col("item_id").alias("new_id"),
            F.col("connection_string").alias("new_endpoint"),
        )
        keys = ["new_ws_id", "new_id"]
        targets = join_lookup(targets, first_rows(strings, keys, ["new_endpoint"]), keys)
    if connections is not None:
        targets = targets.unionByName(
            connections.select(
                F.lit(True).alias("_conn"),
                "old_id",
                "new_id",
                text.alias("new_ws_id"),
                F.lit(False).alias("ambiguous"),
                text.alias("new_endpoint"),
            )
        )
    guid = is_guid("old_id")
    found = F.col("new_id").isNotNull() & (guid | F.col("_conn"))
    status = (
        F.when(found & F.col("ambiguous"), AMBIGUOUS)
        .when(found, MAPPED)
        .when(guid, UNMAPPED)
        .otherwise(PARAMETER)
    )
    # An expression matches nothing, and one expression may be most references: each goes its own way.
    alone = F.concat_ws("/", F.lit("\0"), "doc_id", "path")
    key = F.when(guid | F.col("_conn"), F.col("old_id")).otherwise(alone)
    return (
        refs.withColumn("_conn", F.col("kind") == R.CONNECTION)
        .withColumn("_key", key)
        .join(targets.withColumnRenamed("old_id", "_key"), ["_conn", "_key"], "left")
        .withColumn("status", status)
        .drop("_conn", "_key", "ambiguous")
    )


def _ready() -> Column:
    """A warehouse reference needs the target's connection string; without one it is left alone."""
    return F.col("status").isin(MAPPED, AMBIGUOUS) & ((F.col("kind") != R.WAREHOUSE) | F.col("new_endpoint").isNotNull())


def reference_edits(status: DataFrame) -> DataFrame:
    """What to write for which id: doc_id, kind, old_id, new_id, new_ws_id, new_endpoint."""
    columns = ("doc_id", "kind", "old_id", "new_id", "new_ws_id", "new_endpoint")
    return status.filter(_ready()).select(*columns).distinct()


def _quoted(column: str) -> Column:
    """A text as JSON."""
    listed = F.to_json(F.array(column))
    return F.substring(listed, F.lit(2), F.length(listed) - F.lit(2))


def reference_splices(status: DataFrame, kinds: tuple[str, ...] = R.KINDS) -> DataFrame:
    """What to write at which place: doc_id, at, end, text. ``status`` is that of references with places."""
    def change(name: str, place: str, old: str, new: str) -> Column:
        at, end = F.col(f"{place}_at"), F.col(f"{place}_end")
        added = F.concat(F.lit(f', "{name}": '), _quoted(new))
        wanted = at.isNotNull() & ~F.col(old).eqNullSafe(F.col(new))
        return F.when(wanted, F.struct(at.alias("at"), end.alias("end"), F.when(at < end, _quoted(new)).otherwise(added).alias("text")))

    changes = F.array(change("id", "id", "old_id", "new_id"), change("workspaceId", "ws", "workspace_id", "new_ws_id"),
                      change("endpoint", "endpoint", "endpoint", "new_endpoint"))
    mine = status.filter(_ready() & F.col("kind").isin(list(kinds)))
    return mine.select("doc_id", F.explode(F.array_compact(changes)).alias("c")).select("doc_id", "c.*")


def splice_texts(definitions: DataFrame, splices: DataFrame, only_edited: bool = False) -> DataFrame:
    """Definitions with ``new_definition``: pieces of the text (at, end, in bytes) exchanged for others.

    No text goes to Python: a document's splices are sorted and its text is cut between them. A splice inside another
    that starts before it is left out. With ``only_edited`` documents without splices are left out, too.
    """
    one = F.struct("at", (-F.col("end")).alias("less"), "end", "text")
    per_doc = splices.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("_splices"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("pieces"))
    raw = F.col("definition").cast("binary")

    def cut_at(done, s):
        before = F.substring(raw, (done["at"] + 1).cast("int"), (s["at"] - done["at"]).cast("int")).cast("string")
        more = F.struct(s["end"].alias("at"), F.concat(done["pieces"], F.array(before, s["text"])).alias("pieces"))
        return F.when(s["at"] >= done["at"], more).otherwise(done)

    def whole(done):
        rest = F.substring(raw, (done["at"] + 1).cast("int"), F.octet_length(raw)).cast("string")
        return F.concat(F.array_join(done["pieces"], ""), rest)

    joined = definitions.join(per_doc, "doc_id", "inner" if only_edited else "left")
    spliced = F.aggregate("_splices", start, cut_at, whole)
    return joined.withColumn("new_definition", F.when(F.col("_splices").isNull(), F.col("definition")).otherwise(spliced)).drop("_splices")


def _once(fn):
    """A text function for columns. Spark may repeat a deterministic one for each use of its
    result, a filter on it included; this one is run once for each row."""
    return F.pandas_udf(fn, T.StringType()).asNondeterministic()


def _swap_texts(text: pd.Series, edits: pd.Series) -> pd.Series:
    return pd.Series([R.swap(t, e) for t, e in zip(text, edits)], dtype=object)


def _clear_texts(text: pd.Series) -> pd.Series:
    return pd.Series([R.clear_lakehouse(t) for t in text], dtype=object)


def _set_texts(text: pd.Series, old_id: pd.Series, new_id: pd.Series) -> pd.Series:
    return pd.Series([R.set_warehouse(*row) for row in zip(text, old_id, new_id)], dtype=object)


_swapped, _cleared, _warehouse_set = _once(_swap_texts), _once(_clear_texts), _once(_set_texts)


def swap_references(
    definitions: DataFrame,
    edits: DataFrame,
    kinds: tuple[str, ...] = R.KINDS,
    only_edited: bool = False,
) -> DataFrame:
    """Definitions with ``new_definition``; documents without edits keep their text.

    The group of a document holds its own distinct references, so it is never larger than the
    document. Only texts with edits are sent to Python. With ``only_edited`` the others are left
    out, and texts that cannot hold a reference are not shuffled.
    """
    if only_edited:
        definitions = definitions.filter(may_refer())
    edit = F.struct("kind", "old_id", "new_id", "new_ws_id", F.col("new_endpoint").alias("endpoint"))
    per_doc = (
        edits.filter(F.col("kind").isin(list(kinds)))
        .groupBy("doc_id")
        .agg(F.to_json(F.collect_list(edit), {"ignoreNullFields": "false"}).alias("_edits"))
    )
    has_edits = F.col("_edits").isNotNull()
    new = _swapped(F.when(has_edits, F.col("definition")), F.col("_edits"))
    return (
        definitions.join(per_doc, "doc_id", "inner" if only_edited else "left")
        .withColumn("new_definition", F.when(has_edits, new).otherwise(F.col("definition")))
        .drop("_edits")
    )


def changed_definitions(swapped: DataFrame) -> DataFrame:
    """Only documents whose text is now another one."""
    return swapped.filter(~F.col("definition").eqNullSafe(F.col("new_definition")))


def definition_kind(column: Column | str = "definition") -> Column:
    """``lakehouse``, ``warehouse`` or ``none``: the default a notebook definition names."""
    return (
        F.when(has_key(column, LAKEHOUSE_PATH), R.LAKEHOUSE)
        .when(has_key(column, WAREHOUSE_PATH), R.WAREHOUSE)
        .otherwise("none")
    )


def _looked_up(notebooks: DataFrame, found: DataFrame) -> DataFrame:
    """What is known of each notebook's default: (doc_id, old_item_id) and the columns of ``found``.

    Only ids go through the lookup; notebooks without a default stay out, so no key stands for all of them.
    """
    ids = notebooks.select("doc_id", "old_item_id").filter(F.col("old_item_id").isNotNull()).distinct()
    return join_lookup(ids, found, ["old_item_id"], "inner")


def _meet(notebooks: DataFrame, known: DataFrame) -> DataFrame:
    """The texts and what is known of them. This is the one shuffle that texts go through, by document."""
    return notebooks.join(known, ["doc_id", "old_item_id"], "left")


def notebook_lakehouse_plan(notebooks: DataFrame, old_items: DataFrame) -> DataFrame:
    """Notebooks with a lakehouse dependency: the default to set and the emptied definition.

    ``old_items`` is ``unique_old_items``.
    """
    mine = notebooks.filter(definition_kind() == R.LAKEHOUSE).select(
        "*",
        F.get_json_object("definition", LAKEHOUSE_PATH + ".default_lakehouse").alias("old_item_id"),
        F.get_json_object("definition", LAKEHOUSE_PATH + ".default_lakehouse_name").alias(
            "default_lakehouse_name"
        ),
    )
    found = old_items.select("old_item_id", "old_ws_id", "old_ws_name", "new_ws_id", "new_ws_name")
    status = (
        F.when(F.col("default_lakehouse_name").isNull(), "no_default")
        .when(F.col("new_ws_id").isNull(), UNMAPPED)
        .otherwise(MAPPED)
    )
    ready = F.col("status") == MAPPED
    cleared = _cleared(F.when(ready, F.col("definition")))
    return (
        _meet(mine, _looked_up(mine, found))
        .withColumn("status", status)
        .withColumn("new_definition", F.when(ready, cleared).otherwise(F.col("definition")))
    )


def notebook_warehouse_plan(notebooks: DataFrame, old_items: DataFrame, items: DataFrame) -> DataFrame:
    """Notebooks with a warehouse dependency: the ids exchanged for those of the new workspace.

    The new warehouse is the one of the old name in the new workspace.
    """
    mine = notebooks.filter(definition_kind() == R.WAREHOUSE).select(
        "*",
        F.get_json_object("definition", WAREHOUSE_PATH + ".default_warehouse").alias("old_item_id"),
    )
    found = old_items.select(
        "old_item_id", "old_item_name", "old_ws_id", "old_ws_name", "new_ws_id", "new_ws_name"
    )
    targets = first_rows(
        items.filter(F.col("type") == "Warehouse").select(
            F.col("workspaceId").alias("new_ws_id"),
            F.col("displayName").alias("old_item_name"),
            F.col("id").alias("target_id"),
        ),
        ["new_ws_id", "old_item_name"],
        ["target_id"],
    )
    status = (
        F.when(F.col("old_item_id").isNull(), "no_default")
        .when(F.col("new_ws_id").isNull(), UNMAPPED)
        .when(F.col("target_id").isNull(), NOT_EXISTS)
        .otherwise(MAPPED)
    )
    ready = F.col("status") == MAPPED
    new = _warehouse_set(F.when(ready, F.col("definition")), F.col("old_item_id"), F.col("target_id"))
    known = join_lookup(_looked_up(mine, found), targets, ["new_ws_id", "old_item_name"])
    return (
        _meet(mine, known)
        .withColumn("status", status)
        .withColumn("new_definition", F.when(ready, new).otherwise(F.col("definition")))
    )


def notebook_plan(notebooks: DataFrame, old_items: DataFrame, items: DataFrame) -> DataFrame:
    """All notebooks in one frame: doc_id, kind, old_item_id, new_ws_id, target_id, status, definition, new_definition.

    ``kind`` is the default they name; those that name none have the status ``no_default`` and their text.
    """
    columns = ["doc_id", "kind", "old_item_id", "new_ws_id", "target_id", "status", "definition", "new_definition"]
    text = F.lit(None).cast("string")
    lakes = notebook_lakehouse_plan(notebooks, old_items).withColumns({"kind": F.lit(R.LAKEHOUSE), "target_id": text})
    houses = notebook_warehouse_plan(notebooks, old_items, items).withColumn("kind", F.lit(R.WAREHOUSE))
    none = notebooks.filter(definition_kind() == "none").withColumns({
        "kind": F.lit("none"), "old_item_id": text, "new_ws_id": text, "target_id": text,
        "status": F.lit("no_default"), "new_definition": F.col("definition"),
    })
    return lakes.select(columns).unionByName(houses.select(columns)).unionByName(none.select(columns))
