"""Snapshot tables: save, append with a growing schema, drop, restore."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rehome.functions.names import sanitize_columns

STAMP = "metaTimestamp"
STAGING, BEFORE = "__staging", "__before"
OUTCOME_SCHEMA = "table STRING, rows LONG, status STRING, error STRING"


@dataclass(frozen=True)
class Saved:
    table: str
    rows: int
    status: str
    error: str | None = None


def stamped(df: DataFrame, as_of: datetime | None = None) -> DataFrame:
    """Clean column names and the time of ingestion; ``as_of`` fixes the time."""
    when = F.current_timestamp() if as_of is None else F.lit(as_of)
    return sanitize_columns(df).withColumn(STAMP, when)


def save_snapshot(
    df: DataFrame,
    name: str,
    mode: str = "overwrite",
    *,
    fmt: str = "parquet",
    as_of: datetime | None = None,
) -> Saved:
    """Save a frame as a table; an empty frame leaves the table as it is.

    Overwriting writes a staging table first and then takes its place, so a failed or empty run
    loses nothing. Appending to a table that is not there creates it.
    """
    spark = df.sparkSession
    rows = stamped(df, as_of)
    if mode == "append" and spark.catalog.tableExists(name):
        return _append(rows, name, fmt)
    return _replace(rows, name, fmt)


def beside(name: str, ending: str) -> str:
    """The name of a table next to another; the name may be quoted."""
    return f"{name[:-1]}{ending}`" if name.endswith("`") else name + ending


def write_staging(rows: DataFrame, name: str, fmt: str) -> str:
    """Write the rows next to a table; a table that an interrupted run moved aside comes back."""
    spark = rows.sparkSession
    staging, before = beside(name, STAGING), beside(name, BEFORE)
    if not spark.catalog.tableExists(name) and spark.catalog.tableExists(before):
        spark.sql(f"ALTER TABLE {before} RENAME TO {name}")
    spark.sql(f"DROP TABLE IF EXISTS {staging}")
    rows.write.format(fmt).saveAsTable(staging)
    return staging


def put_in_place(spark: SparkSession, staging: str, name: str) -> None:
    """Let the staged table take the place of the old one, which is dropped last."""
    before = beside(name, BEFORE)
    spark.sql(f"DROP TABLE IF EXISTS {before}")
    if spark.catalog.tableExists(name):
        spark.sql(f"ALTER TABLE {name} RENAME TO {before}")
    spark.sql(f"ALTER TABLE {staging} RENAME TO {name}")
    spark.sql(f"DROP TABLE IF EXISTS {before}")


def _replace(rows: DataFrame, name: str, fmt: str) -> Saved:
    spark = rows.sparkSession
    staging = write_staging(rows, name, fmt)
    # Counted from the staged files' footers: the source is not evaluated again.
    count = spark.table(staging).count()
    if count == 0:
        spark.sql(f"DROP TABLE IF EXISTS {staging}")
        return Saved(name, 0, "empty")
    put_in_place(spark, staging, name)
    return Saved(name, count, "saved")


def _append(rows: DataFrame, name: str, fmt: str) -> Saved:
    if rows.isEmpty():
        return Saved(name, 0, "empty")
    spark, seen = rows.sparkSession, Observation()
    old = spark.table(name)
    if _widens(old.schema, rows.schema):
        # A column of the files themselves changes: they are written anew, once, beside the table.
        merged = merged_schema(old.schema, rows.schema)
        new = as_schema(rows, merged).observe(seen, F.count(F.lit(1)).alias("n"))
        put_in_place(spark, write_staging(as_schema(old, merged).unionByName(new), name, fmt), name)
    else:
        aligned = align_to_table(rows, name).observe(seen, F.count(F.lit(1)).alias("n"))
        aligned.write.format(fmt).mode("append").saveAsTable(name)
    return Saved(name, seen.get["n"], "saved")


# Whole numbers and the digits that their values may have.
WHOLE = {T.ByteType(): 3, T.ShortType(): 5, T.IntegerType(): 10, T.LongType(): 19}


def common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The narrowest type that holds every value of both as it is; text where no other does."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    kinds = {type(a), type(b)}
    digits = [WHOLE.get(x, x.precision - x.scale if isinstance(x, T.DecimalType) else None) for x in (a, b)]
    scale = max(x.scale if isinstance(x, T.DecimalType) else 0 for x in (a, b))
    if all(x in WHOLE for x in (a, b)):
        return max(a, b, key=WHOLE.get)
    if None not in digits and max(digits) + scale <= 38:
        return T.DecimalType(max(digits) + scale, scale)
    if kinds == {T.FloatType, T.DoubleType}:
        return T.DoubleType()
    exact = {T.FloatType(): 5, T.DoubleType(): 10}  # digits of the widest whole type that it holds
    for real, other in ((a, b), (b, a)):
        if real in exact and WHOLE.get(other, 99) <= exact[real]:
            return real
    if kinds == {T.DateType, T.TimestampNTZType}:
        return T.TimestampNTZType()
    if any(isinstance(x, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)) for x in (a, b)):
        raise ValueError(f"no common type of {a.simpleString()} and {b.simpleString()}")
    return T.StringType()


def merged_schema(old: T.StructType, new: T.StructType) -> T.StructType:
    """The columns of both, the old ones first, with their common types."""
    there = {f.name.lower(): f for f in new.fields}
    known = {f.name.lower() for f in old.fields}
    kept = [T.StructField(f.name, common_type(f.dataType, there[f.name.lower()].dataType if f.name.lower() in there else f.dataType)) for f in old.fields]
    return T.StructType(kept + [T.StructField(f.name, f.dataType) for f in new.fields if f.name.lower() not in known])


def _widens(old: T.StructType, new: T.StructType) -> bool:
    return any(f.dataType != m.dataType for f, m in zip(old.fields, merged_schema(old, new).fields))


def as_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of a schema in its order and types; what the frame lacks is NULL."""
    here = {c.lower() for c in df.columns}
    return df.select(*[(F.col(f"`{f.name}`") if f.name.lower() in here else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def align_to_table(df: DataFrame, name: str) -> DataFrame:
    """Merge schemas for an append: new columns are added to the table, absent ones are NULL.

    Values take the table's types, which hold them. Only metadata changes; files already there are not rewritten.
    """
    spark = df.sparkSession
    there = {f.name.lower() for f in spark.table(name).schema.fields}
    new = [f for f in df.schema.fields if f.name.lower() not in there]
    if new:
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new)
        spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({columns})")
    return as_schema(df, spark.table(name).schema)


def newest_rows(snapshots: DataFrame, keys: list[str], as_of: datetime | str | None = None, stamp: str = STAMP) -> DataFrame:
    """The newest row of each key in appended snapshots, none of them younger than ``as_of``.

    Each task keeps one row a key before the shuffle. Of rows with one time the greatest by its columns, in their
    order, counts. A key that a later snapshot has no more keeps its last row; rows without a time are the oldest.
    """
    rows = snapshots if as_of is None else snapshots.filter(F.col(stamp).isNull() | (F.col(stamp) <= F.lit(as_of).cast(snapshots.schema[stamp].dataType)))
    rest = [c for c in snapshots.columns if c not in {*keys, stamp}]
    newest = F.max(F.struct(*[F.col(f"`{c}`") for c in [stamp, *rest]])).alias("_newest")
    return rows.groupBy(*keys).agg(newest).select(*keys, "_newest.*").select(*[F.col(f"`{c}`") for c in snapshots.columns])


def drop_snapshot(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def save_all(frames: dict[str, DataFrame], **options) -> list[Saved]:
    """Save several snapshots; one that fails does not stop the others."""
    outcomes = []
    for name, frame in frames.items():
        try:
            outcomes.append(save_snapshot(frame, name, **options))
        except Exception as error:  # noqa: BLE001 - the error is the result of this table
            outcomes.append(Saved(name, 0, "failed", str(error)))
    return outcomes


def restore_snapshot(
    spark: SparkSession,
    paths: dict[str, str],
    suffix: str = "_recovered",
    fmt: str = "parquet",
    as_of: datetime | str | None = None,
    keys: dict[str, list[str]] | None = None,
    stamp: str = STAMP,
) -> DataFrame:
    """Read each table from its path and save it as ``<name><suffix>``: table, rows, status, error.

    The tables keep their columns and time stamps. A table that fails gets a row, too. Of tables that
    ``keys`` names, appended snapshots are reduced to the newest row of a key, as of a time if one is given.
    """
    outcomes = []
    for name, path in paths.items():
        target = name + suffix
        try:
            rows = spark.read.format(fmt).load(path)
            if name in (keys or {}):
                rows = newest_rows(rows, keys[name], as_of, stamp)
            outcomes.append(_replace(rows, target, fmt))
        except Exception as error:  # noqa: BLE001
            outcomes.append(Saved(target, 0, "failed", str(error)))
    return outcome_frame(spark, outcomes)


def outcome_frame(spark: SparkSession, outcomes: list[Saved]) -> DataFrame:
    return spark.createDataFrame(
        [(o.table, o.rows, o.status, o.error) for o in outcomes], OUTCOME_SCHEMA
    )
