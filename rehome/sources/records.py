"""Landed metadata records: JSON text, local frames, tables and paths."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"

# One role assignment as the listing returns it.
ROLE_SCHEMA = """
  role STRING,
  principal STRUCT<
    id: STRING, displayName: STRING, type: STRING,
    userDetails: STRUCT<userPrincipalName: STRING>>,
  workspaceId STRING,
  workspaceName STRING
"""


def from_json_files(spark: SparkSession, path: str | list[str], schema=None) -> DataFrame:
    """JSON-lines files as a table; broken lines stay visible in ``_corrupt_record``.

    Give a schema for stable runs: without one Spark reads the files once more to infer it.
    """
    reader = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    if schema is not None:
        reader = reader.schema(_with_corrupt(schema))
    return reader.json(path)


def from_json_records(df: DataFrame, column: str, schema, keep: tuple[str, ...] = ()) -> DataFrame:
    """A text column of JSON objects as columns, next to the ``keep`` columns."""
    full = _with_corrupt(schema)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    parsed = F.from_json(F.col(column), full, options)
    return df.select(*keep, parsed.alias("_record")).select(*keep, "_record.*")


def infer_record_schema(df: DataFrame, column: str) -> T.StructType:
    """Schema of all records of a text column, from one distributed aggregate.

    Only the schema text comes to the driver.
    """
    shape = F.schema_of_variant_agg(F.try_parse_json(column))
    text = df.agg(shape.alias("shape")).first()["shape"]
    empty = df.sparkSession.range(0).select(
        F.from_json(F.lit(None).cast("string"), text.replace("OBJECT<", "STRUCT<")).alias("r")
    )
    # A field that is null in every record is text: no table format stores the null type.
    found = empty.schema["r"].dataType.json()
    for part in ("type", "elementType"):
        found = found.replace(f'"{part}":"void"', f'"{part}":"string"')
    return T.StructType.fromJson(json.loads(found))


def quarantined(records: DataFrame) -> DataFrame:
    """Records that were no valid JSON object."""
    return records.filter(F.col(CORRUPT).isNotNull())


def valid(records: DataFrame) -> DataFrame:
    return records.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)


def _with_corrupt(schema) -> T.StructType:
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    return T.StructType([f for f in schema.fields if f.name != CORRUPT]
                        + [T.StructField(CORRUPT, T.StringType())])


def flatten_roles(roles: DataFrame) -> DataFrame:
    """Role assignments with the nested principal spread to columns."""
    return roles.select(
        "role",
        "workspaceId",
        "workspaceName",
        F.col("principal.id").alias("principalId"),
        F.col("principal.displayName").alias("displayName"),
        F.col("principal.type").alias("principalType"),
        F.col("principal.userDetails.userPrincipalName").alias("userPrincipalName"),
    )


def admin_roles(users: DataFrame) -> DataFrame:
    """Role assignments from the administrator's user listing, in the same columns."""
    return users.select(
        F.col("groupUserAccessRight").alias("role"),
        "workspaceId",
        "workspaceName",
        F.col("graphId").alias("principalId"),
        "displayName",
        "principalType",
        F.col("emailAddress").alias("userPrincipalName"),
    )


def union_roles(member: DataFrame, admin: DataFrame) -> DataFrame:
    """Both role listings as one table with a ``source`` flag, so neither replaces the other."""
    return member.withColumn("source", F.lit("member")).unionByName(
        admin.withColumn("source", F.lit("admin"))
    )


def git_connections(df: DataFrame) -> DataFrame:
    """Git connection records with their nested details kept as JSON text."""
    return df.select(
        F.col("workspaceId").alias("Workspace_ID"),
        F.col("workspaceName").alias("Workspace_Name"),
        "gitConnectionState",
        F.to_json("gitProviderDetails").alias("gitProviderDetails"),
        F.to_json("gitSyncDetails").alias("gitSyncDetails"),
    )


def from_local(spark: SparkSession, frame, schema=None) -> DataFrame:
    """A local frame or list of rows as a DataFrame; for listings that arrive on the driver."""
    return spark.createDataFrame(frame, schema=schema)


def constant_columns(df: DataFrame, **values) -> DataFrame:
    return df.withColumns({name: F.lit(value) for name, value in values.items()})


def scan_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def scan_path(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).load(path)


def preview(df: DataFrame, *keys: str, n: int = 1000) -> DataFrame:
    """The first n rows by key: each task keeps its own n, no full sort."""
    return df.orderBy(*keys).limit(n)


# Listings as they land, one JSON object a line.
LANDED = {
    "capacities": "Id STRING, `Display Name` STRING, Sku STRING, Region STRING, State STRING",
    "workspaces": "Id STRING, Type STRING, Name STRING, `Capacity Id` STRING",
    "items": "id STRING, type STRING, displayName STRING, description STRING, workspaceId STRING",
    "gitconnections": """workspaceId STRING, workspaceName STRING, gitConnectionState STRING,
      gitProviderDetails MAP<STRING, STRING>, gitSyncDetails MAP<STRING, STRING>""",
    "wsroleassignments": ROLE_SCHEMA,
    "reports": "Id STRING, Name STRING, `Dataset Id` STRING, Subscriptions STRING, Users STRING",
}
REJECTED = "_rejected"


def landed_frames(spark: SparkSession, base_path: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """The estate's tables from ``<base_path>/<name>``, ready to be saved.

    Lines that are no JSON object are kept in ``<name>_rejected``.
    """
    frames = {}
    for name in names or LANDED:
        lines = spark.read.text(f"{base_path.rstrip('/')}/{name}")
        records = from_json_records(lines, "value", LANDED[name])
        frames[name] = _shaped(name, valid(records))
        frames[name + REJECTED] = quarantined(records).select(CORRUPT)
    return frames


def _shaped(name: str, rows: DataFrame) -> DataFrame:
    if name == "gitconnections":
        return git_connections(rows)
    if name == "wsroleassignments":
        return flatten_roles(rows)
    return rows.drop("Subscriptions", "Users")
