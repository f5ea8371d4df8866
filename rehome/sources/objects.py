"""What lies in a store: folders and files, listed inside Spark tasks.

Directory names never pass through the driver. Each listing call is one row of work, spread
over a fixed number of partitions: adaptive execution would merge such small rows into one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rehome.lineage import cut

KINDS = ("Tables", "Files")
BATCH = 10_000
_GLOB = re.compile(r"[\\{}\[\]*?]")
# What a storage call raises: the store's own errors, a path that no filesystem understands, and
# an operation that a store does not have.
FAILURES = (OSError, ValueError, pa.ArrowException)
LISTED = {"name": None, "size": 0, "is_dir": False, "error": None}


def open_path(path: str):
    """(filesystem, path inside it) for a local path or a URI.

    Only a URI's root is parsed. What follows it is a name as the store lists it, in which ``#``,
    ``?``, ``%`` and spaces stand for themselves.
    """
    scheme, mark, rest = path.partition(":/")
    if not mark or "/" in scheme or not scheme:
        return fs.LocalFileSystem(), path
    if scheme == "file":
        host, _, inside = rest.removeprefix("/").partition("/") if rest.startswith("/") else ("", "", rest)
        if host:
            raise ValueError(f"a file of another host: {path}")
        return fs.LocalFileSystem(), "/" + inside
    host, _, inside = rest.removeprefix("/").partition("/")
    system, root = fs.FileSystem.from_uri(f"{scheme}://{host}/")
    return system, f"{root.rstrip('/')}/{inside}"


def bare(path: str) -> str:
    """A path without slashes at its end; the root stays."""
    return path.rstrip("/") or path[:1]


def width(spark: SparkSession) -> int:
    """Partitions for work whose rows are few but slow."""
    return max(
        spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))
    )


def _entries(path: str):
    """What lies at a path, one after the other: a file is itself, a folder its children, an absent path nothing."""
    system, inside = open_path(path)
    info = system.get_file_info(inside)
    if info.type == fs.FileType.File:
        yield {"name": info.base_name, "size": info.size, "is_dir": False}
        return
    base = bare(path)
    for child in system.get_file_info(fs.FileSelector(inside, allow_not_found=True)):
        yield {
            "path": f"{base}/{child.base_name}",
            "name": child.base_name,
            "size": child.size or 0,
            "is_dir": child.type == fs.FileType.Directory,
        }


def _tried(path: str, strict: bool):
    """The entries of a path; where the store fails, a last one with its error."""
    try:
        yield from _entries(path)
    except FAILURES as problem:
        if strict:
            raise
        yield {"size": 0, "is_dir": False, "error": str(problem)}


def _batched(entries):
    while part := list(islice(entries, BATCH)):
        yield part


def _lister(strict: bool):
    def list_batches(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                for part in _batched(_tried(row["path"], strict)):
                    yield pd.DataFrame([row | LISTED | entry for entry in part]).astype({"name": object, "error": object})

    return list_batches


def children(dirs: DataFrame, strict: bool = True) -> DataFrame:
    """One level below every ``path``: the input columns with path replaced, name, size, is_dir, error.

    A path that cannot be listed stops the job, or is a row with an error if not ``strict``.
    """
    keep = [f for f in dirs.schema.fields if f.name not in LISTED]
    schema = T.StructType(
        keep
        + [
            T.StructField("name", T.StringType()),
            T.StructField("size", T.LongType()),
            T.StructField("is_dir", T.BooleanType()),
            T.StructField("error", T.StringType()),
        ]
    )
    spread = dirs.select(*[f.name for f in keep]).repartition(width(dirs.sparkSession), "path")
    return spread.mapInPandas(_lister(strict), schema)


def _carried(stores: DataFrame) -> list[str]:
    """The columns of a store that its objects keep."""
    return [c for c in stores.columns if c not in {*LISTED, "base_path", "kind", "schema", "type", "path", "src_path"}]


def list_objects(stores: DataFrame, kinds: Iterable[str] = KINDS, strict: bool = True) -> DataFrame:
    """Tables and files of every store (``base_path``) → base_path, name, type, src_path.

    Other columns of the stores are carried along, behind those. If not ``strict``, a store that
    cannot be listed is a row without a name and with the ``error``, a last column.
    """
    kept = _carried(stores)
    pairs = F.explode(F.array(*[F.lit(k) for k in kinds])).alias("kind")
    dirs = stores.select("base_path", *kept, pairs).withColumn("path", F.concat_ws("/", F.rtrim("base_path", F.lit("/")), "kind"))
    found = children(dirs, strict).withColumnRenamed("path", "src_path").withColumn("type", _type_of("kind"))
    return found.select("base_path", "name", "type", "src_path", *kept, *([] if strict else ["error"]))


def list_tables(stores: DataFrame, schemas: list[str] | None = None, strict: bool = True) -> DataFrame:
    """Tables of every store by schema → base_path, schema, name, type, src_path; the rest as in list_objects.

    A store without tables gives no rows, and the columns are there all the same.
    """
    kept = _carried(stores)
    level = list_objects(stores, ["Tables"], strict)
    if schemas is not None:
        level = level.filter(F.col("name").isin(schemas) | (F.lit(False) if strict else F.col("error").isNotNull()))
    failed = None if strict else level.filter("error IS NOT NULL")
    level = level if strict else level.filter("error IS NULL")
    dirs = level.select("base_path", *kept, F.col("name").alias("schema"), F.col("src_path").alias("path"))
    names = ["base_path", "schema", "name", "type", "src_path", *kept, *([] if strict else ["error"])]
    found = children(dirs, strict).withColumnRenamed("path", "src_path").withColumn("type", F.lit("table")).select(names)
    return found if strict else found.unionByName(failed.withColumn("schema", F.lit(None).cast("string")).select(names))


def leaf_files(roots: DataFrame) -> DataFrame:
    """Every file below each ``path``; other input columns are carried along.

    One round for each directory level, so a table with most of the files is shared out again at
    every level. Levels are written out: a later round does not repeat the earlier ones. A folder
    that cannot be listed is a row with an ``error``.
    """
    level, found = roots, None
    while True:
        listed = cut(children(level, strict=False))
        files = listed.filter(~F.col("is_dir")).drop("is_dir")
        found = files if found is None else found.unionByName(files)
        level = listed.filter("is_dir").drop("is_dir")
        if level.isEmpty():
            return found


def session_files(roots: DataFrame, column: str = "base_path", strict: bool = True, roots_each: int = 200) -> DataFrame:
    """Every file below each root, by Spark's own file source: root, path, size, modified, error.

    Any path that the session's Hadoop settings reach will do (``s3a``, ``wasbs``, ``dbfs``, ``viewfs``, ...), and a large
    folder is listed by Spark, in parallel. Contents are not read. ``roots_each`` roots are listed at a time and written out, so the
    driver holds one such share of the listing. As Spark has it, files in folders or of names that start with
    ``_`` or ``.`` are hidden, paths are absolute URIs, and empty folders give no row. A root that cannot be listed stops the job, or is a
    row with an ``error`` if not ``strict``.
    """
    spark = roots.sparkSession
    schema = "root STRING, path STRING, size LONG, modified TIMESTAMP, error STRING"
    found = None
    names = (r[0] for r in roots.select(F.rtrim(column, F.lit("/"))).distinct().toLocalIterator())
    while part := list(islice(names, roots_each)):
        listed = spark.createDataFrame([], schema)
        for root in part:
            try:
                files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(_GLOB.sub(r"\\\g<0>", root))
                files = files.select(F.lit(root).alias("root"), "path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.lit(None).cast("string").alias("error"))
            except AnalysisException as problem:
                if strict:
                    raise
                files = spark.createDataFrame([(root, None, None, None, str(problem))], schema)
            listed = listed.unionByName(files)
        listed = cut(listed)
        found = listed if found is None else found.unionByName(listed)
    return spark.createDataFrame([], schema) if found is None else found


def _type_of(kind: str):
    """Folder name without its last letter, in lower case: Tables → table."""
    return F.lower(F.left(F.col(kind), F.length(kind) - F.lit(1)))


def _below(column: str, folders: str):
    """(what lies before the first of the folders, that folder, the steps after it)."""
    halves = F.split(column, f"/(?:{folders})/", 2)
    base = F.get(halves, 0)
    kind = F.substring_index(F.substring(F.col(column), F.length(base) + F.lit(2), F.lit(9)), "/", 1)
    return base, kind, F.split(F.get(halves, 1), "/")


def objects_from_paths(paths: DataFrame, column: str = "path") -> DataFrame:
    """The listing of an inventory that already holds paths: base_path, name, type, src_path.

    For estates whose storage publishes an inventory table: no listing call at all. Deeper paths
    count for the object they belong to. Paths are folded to objects in every task, before the
    shuffle.
    """
    base, kind, steps = _below(column, "Tables|Files")
    found = paths.select(base.alias("base_path"), kind.alias("kind"), F.get(steps, 0).alias("name"))
    found = found.filter(F.col("name") != "").distinct()
    whole = F.concat_ws("/", "base_path", "kind", "name")
    return found.select("base_path", "name", _type_of("kind").alias("type"), whole.alias("src_path"))


def tables_from_paths(
    paths: DataFrame, column: str = "path", schemas: list[str] | None = None
) -> DataFrame:
    """As objects_from_paths for schema-qualified tables: base_path, schema, name, type, src_path."""
    base, _, steps = _below(column, "Tables")
    found = paths.select(
        base.alias("base_path"), F.get(steps, 0).alias("schema"), F.get(steps, 1).alias("name")
    ).filter((F.col("schema") != "") & (F.col("name") != ""))
    if schemas is not None:
        found = found.filter(F.col("schema").isin(schemas))
    whole = F.concat_ws("/", "base_path", F.lit("Tables"), "schema", "name")
    return found.distinct().select(
        "base_path", "schema", "name", F.lit("table").alias("type"), whole.alias("src_path")
    )
