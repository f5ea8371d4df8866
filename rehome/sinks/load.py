"""Bulk load of tables, type conversion, pointer tables and load parameters."""

from __future__ import annotations

import time
from collections import deque
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rehome.functions.names import MAX_NAME
from rehome.operators.picks import join_lookup
from rehome.sinks.snapshot import Saved, outcome_frame, put_in_place, write_staging
from rehome.sources.objects import bare

# Loads at a time, further attempts and the wait between them.
LOADS_AT_A_TIME = 20
RETRIES = 2
RETRY_SECONDS = 30
POOL = "bulk_load"
LOAD_ID, LOAD_ROWS = "rehome.load_id", "rehome.load_rows"


def pointer_name(schema: str = "schema", name: str = "name"):
    """The flat name under which a schema's table is staged; never cut, so that two names stay two."""
    return F.concat_ws("_", schema, name)


def collisions(tables: DataFrame, *keys: str) -> DataFrame:
    """Targets that more than one source table would be written to."""
    return (
        tables.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n_tables"))
        .filter(F.col("n_tables") > 1)
    )


def _checked(tables: DataFrame, *databases: Column) -> DataFrame:
    """Tables with their pointer, and a ``status`` for a name that is too long or meets another's."""
    named = tables.withColumn("pointer", pointer_name()).withColumns({f"_db{i}": d for i, d in enumerate(databases)})
    keys = ["pointer", f"_db{len(databases) - 1}"]
    counts = named.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    status = F.when(F.length("pointer") > MAX_NAME, "name_too_long").when(F.col("_n") > 1, "collision")
    return join_lookup(named, counts, keys, "inner").withColumn("status", status)


def _database(given: str | None, column: str) -> Column:
    return F.col(column) if given is None else F.lit(given)


def _in_pool(spark: SparkSession, work, rows, at_a_time: int) -> list[Saved]:
    """The outcome of each row of work, ``at_a_time`` of them under way; rows are drawn as places get free."""
    outcomes, waiting = [], deque()
    task = inheritable_thread_target(spark)(work)
    with ThreadPoolExecutor(at_a_time) as pool:
        for row in rows:
            if len(waiting) >= 2 * at_a_time:
                outcomes.append(waiting.popleft().result())
            waiting.append(pool.submit(task, row))
        outcomes += [w.result() for w in waiting]
    return outcomes


def _location(spark: SparkSession, target: str) -> str | None:
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {target}").filter("col_name = 'Location'").take(1)
    return bare(rows[0]["data_type"].removeprefix("file:")) if rows else None


def register_pointers(
    spark: SparkSession,
    tables: DataFrame,
    database: str | None = None,
    fmt: str = "parquet",
    at_a_time: int = LOADS_AT_A_TIME,
) -> DataFrame:
    """A table ``<schema>_<name>`` over each foreign folder (schema, name, src_path); a status for each.

    ``created``, or ``exists`` where it is there over the same folder and ``other_location`` where it is not;
    ``collision`` for names that two tables of a database would share, ``name_too_long``, ``failed``.
    Without ``database`` the column of that name says where. One catalog statement for each row, a
    few at a time; rows come to the driver a partition at a time.
    """
    named = _checked(tables, _database(database, "database"))

    def create(row) -> Saved:
        target = f"{row['_db0']}.`{row['pointer']}`"
        try:
            if row["status"]:
                return Saved(target, 0, row["status"])
            if spark.catalog.tableExists(target):
                same = _location(spark, target) == bare(row["src_path"].removeprefix("file://").removeprefix("file:"))
                return Saved(target, 0, "exists" if same else "other_location")
            path = row["src_path"].replace("\\", "\\\\").replace("'", "\\'")
            spark.sql(f"CREATE TABLE IF NOT EXISTS {target} USING {fmt} LOCATION '{path}'")
            return Saved(target, 0, "created")
        except Exception as error:  # noqa: BLE001
            return Saved(target, 0, "failed", str(error))

    rows = named.select("_db0", "pointer", "src_path", "status")
    return outcome_frame(spark, _in_pool(spark, create, rows.toLocalIterator(), at_a_time))


def _target(schema: T.StructType | str) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def _converted(df: DataFrame, field: T.StructField) -> Column:
    source = next(f.dataType for f in df.schema.fields if f.name.lower() == field.name.lower())
    column = F.col(f"`{field.name}`")
    if source == field.dataType:
        return column
    if isinstance(source, T.BooleanType) and isinstance(field.dataType, T.NumericType):
        return F.lit(None).cast(field.dataType)
    if isinstance(source, T.StringType) and isinstance(field.dataType, T.IntegralType):
        # Text without a digit, or with a letter, is no whole number. Telling so first is much
        # faster than the error that try_cast would raise and catch for every such value.
        column = F.when(column.rlike("[0-9]") & ~column.rlike("[A-Za-z]"), column)
    return column.try_cast(field.dataType)


def convert_types(df: DataFrame, schema: T.StructType | str) -> DataFrame:
    """Columns cast to the target's types; a value that does not fit becomes NULL.

    Fractions and times of day are cut off where the target has none. A boolean is no number.
    """
    return df.select(*[_converted(df, f).alias(f.name) for f in _target(schema).fields])


def conversion_losses(df: DataFrame, schema: T.StructType | str) -> DataFrame:
    """For each column, the values, and those that the conversion turns into NULL."""
    counts = [
        F.struct(
            F.lit(f.name).alias("column_name"),
            F.count(f"`{f.name}`").alias("n_values"),
            F.count_if(F.col(f"`{f.name}`").isNotNull() & _converted(df, f).isNull()).alias("n_lost"),
        )
        for f in _target(schema).fields
    ]
    return df.agg(F.array(*counts).alias("c")).select(F.inline("c"))


def conversion_rejects(df: DataFrame, schema: T.StructType | str, keys: list[str]) -> DataFrame:
    """The values that the conversion turns into NULL, one row each: the keys, column_name, raw_value, target_type.

    Every row is looked at where it lies; nothing is shuffled.
    """
    lost = [
        F.when(
            F.col(f"`{f.name}`").isNotNull() & _converted(df, f).isNull(),
            F.struct(
                F.lit(f.name).alias("column_name"),
                _as_written(df, f.name).alias("raw_value"),
                F.lit(f.dataType.simpleString()).alias("target_type"),
            ),
        )
        for f in _target(schema).fields
    ]
    return df.select(*[F.col(f"`{k}`") for k in keys], F.inline(F.array_compact(F.array(*lost))))


def _as_written(df: DataFrame, name: str) -> Column:
    kind = next(f.dataType for f in df.schema.fields if f.name.lower() == name.lower())
    nested = isinstance(kind, (T.ArrayType, T.MapType, T.StructType))
    return F.to_json(f"`{name}`") if nested else F.col(f"`{name}`").cast("string")


def with_retry(work, retries: int = RETRIES, wait: float = RETRY_SECONDS):
    """The result of ``work()``, tried again after a pause; the last error is raised."""
    for attempt in range(retries + 1):
        try:
            return work()
        except Exception:  # noqa: BLE001
            if attempt == retries:
                raise
            time.sleep(wait)


def _loaded_rows(spark: SparkSession, target: str, load_id: str | None) -> int | None:
    """The rows of a table that this load has finished before."""
    if load_id is None or not spark.catalog.tableExists(target):
        return None
    told = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {target}").collect()}
    return int(told[LOAD_ROWS]) if told.get(LOAD_ID) == load_id else None


def bulk_load(
    spark: SparkSession,
    tables: DataFrame,
    *,
    source_database: str | None = None,
    target_database: str | None = None,
    at_a_time: int = LOADS_AT_A_TIME,
    retries: int = RETRIES,
    wait: float = RETRY_SECONDS,
    fmt: str = "parquet",
    target_schemas: dict[str, T.StructType] | None = None,
    load_id: str | None = None,
) -> DataFrame:
    """Load ``<source>.<schema>_<name>`` into ``<target>.<schema>_<name>``, several jobs at a time.

    A database that is not given is read from the column of its name, so tables of many warehouses
    load in one call. The target keeps the schema in its name; tables that would share a target are
    not loaded and have the status ``collision``. Each load is one Spark job in a fair pool and
    writes a staging table first; a table that keeps failing gets a row in the result and stops nothing.

    With a ``load_id`` each loaded table carries it and its row count as properties, which appear with the
    table: a run that is started again under the same id, after the driver was lost, loads only what is left, and the others
    have the status ``done``.
    """
    named = _checked(tables, _database(source_database, "source_database"), _database(target_database, "target_database"))

    def load(row) -> Saved:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", POOL)
        pointer, target = row["pointer"], f"{row['_db1']}.`{row['pointer']}`"
        if row["status"]:
            return Saved(target, 0, row["status"])

        def once() -> int:
            rows = spark.table(f"{row['_db0']}.`{pointer}`")
            if target_schemas and pointer in target_schemas:
                rows = convert_types(rows, target_schemas[pointer])
            staging = write_staging(rows, target, fmt)
            count = spark.table(staging).count()
            if load_id is not None:
                mark = load_id.replace("\\", "\\\\").replace("'", "\\'")
                spark.sql(f"ALTER TABLE {staging} SET TBLPROPERTIES ('{LOAD_ID}' = '{mark}', '{LOAD_ROWS}' = '{count}')")
            put_in_place(spark, staging, target)
            return count

        try:
            done = _loaded_rows(spark, target, load_id)
            if done is not None:
                return Saved(target, done, "done")
            return Saved(target, with_retry(once, retries, wait), "loaded")
        except Exception as error:  # noqa: BLE001
            return Saved(target, 0, "failed", str(error))

    rows = named.select("_db0", "_db1", "pointer", "status")
    return outcome_frame(spark, _in_pool(spark, load, rows.toLocalIterator(), at_a_time))


def tables_to_copy(tables: DataFrame, store: str = "item_id", chunks: int = 16) -> DataFrame:
    """Sorted arrays of (schema, name) for each store: store, chunk, n_tables, tables.

    The tables of every store are dealt into ``chunks`` arrays by the first digits of an md5 of schema
    and name, for as many load calls; an array without tables is no row. Together they hold every table once.
    """
    digits = F.left(F.md5(F.concat_ws(".", "schema", "name").cast("binary")), F.lit(6))
    chunk = F.pmod(F.conv(digits, 16, 10).cast("int"), F.lit(chunks))
    # A set makes equal entries one: no shuffle of its own for that.
    return (
        tables.select(store, chunk.alias("chunk"), F.struct("schema", "name").alias("_entry"))
        .groupBy(store, "chunk")
        .agg(F.array_sort(F.collect_set("_entry")).alias("tables"))
        .select(store, "chunk", F.size("tables").cast("bigint").alias("n_tables"), "tables")
    )


def tables_to_copy_json(tables: DataFrame, store: str = "item_id", chunks: int = 16) -> DataFrame:
    """``tables_to_copy`` as JSON arrays of {schema, name}: store, chunk, n_tables, tables_json."""
    return tables_to_copy(tables, store, chunks).withColumn("tables", F.to_json("tables")).withColumnRenamed("tables", "tables_json")
