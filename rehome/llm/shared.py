"""What the operators share: tables, written intermediate results, and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The bytes that part words, as the regular expression of a word.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or else the context's own.

    Only a local master, whose tasks run in the driver's process, may fall back on a temporary folder.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def cut(df: DataFrame, *partition_by: str) -> DataFrame:
    """The rows, written as Parquet to the shared folder and read back: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(column):
    """A-Z in lower case; every other character as it is."""
    return F.translate(column, UPPER, LOWER)


def crc_of_id(column):
    """crc32 of the id written as text."""
    return F.crc32(column.cast("string").cast("binary"))


def parts_for(spark: SparkSession, rows: int, rows_each: int, least: int | None = None) -> int:
    """How many parts of about ``rows_each`` rows; at least as many as keep the cores busy."""
    least = spark.sparkContext.defaultParallelism if least is None else least
    return max(1, least, -(-rows // rows_each))


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id of the undirected edges (a, b): the smallest id it can reach.

    Star contraction: each id points at the smallest id of its neighbourhood, pointers are doubled
    until they meet their roots, and the graph between the roots, without loops and repeats, is the
    next round's. Each round at least halves the ids of a component, so rounds are logarithmic.
    Minima combine before the shuffle, and joins on a hot root have two fresh sides, which adaptive
    execution splits. All rounds are written to the shared folder; the driver sees counts only.
    """
    links = cut(edges.select("a", "b").filter("a <> b").distinct())
    found = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min("b").alias("b"))
        point = cut(near.select(F.col("a").alias("id"), F.least("a", "b").alias("root")))
        while True:
            step = point.select(F.col("id").alias("root"), F.col("root").alias("next"))
            jumped = cut(point.join(step, "root").select("id", F.col("next").alias("root"), (F.col("next") < F.col("root")).alias("moved")))
            point = jumped.select("id", "root")
            if jumped.filter("moved").isEmpty():
                break
        if found is None:
            found = point
        else:
            step = point.select(F.col("id").alias("root"), F.col("root").alias("next"))
            found = cut(found.join(step, "root", "left").select("id", F.coalesce("next", "root").alias("root")))
        of_a = point.select(F.col("id").alias("a"), F.col("root").alias("ra"))
        of_b = point.select(F.col("id").alias("b"), F.col("root").alias("rb"))
        ends = links.join(of_a, "a").join(of_b, "b")
        links = cut(ends.filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    if found is None:
        return edges.select(F.col("a").alias("id"), F.col("a").alias("component")).limit(0)
    return found.select("id", F.col("root").alias("component"))


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, str], parts: int) -> DataFrame:
    """The rows with, for each ``new: column``, the column's running sum in a global order, itself included.

    The rows are range-sorted into parts and written; totals of the parts, one row each, give every part
    its start, and a window runs inside each part. No task sees more than its range of the order, so
    the order should end in something that tells rows apart.
    """
    names = [f"_o{i}" for i in range(len(order))]
    keyed = df.select("*", *[c.alias(n) for c, n in zip(order, names)])
    ranged = cut(keyed.repartitionByRange(parts, *names).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_part").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    starts = totals.select("_part", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias("_s_" + n) for n in sums])
    inside = Window.partitionBy("_part").orderBy(*names).rowsBetween(Window.unboundedPreceding, 0)
    with_sums = ranged.select("*", *[F.sum(c).over(inside).alias(n) for n, c in sums.items()]).join(starts, "_part")
    for n in sums:
        with_sums = with_sums.withColumn(n, F.col(n) + F.col("_s_" + n))
    return with_sums.drop("_part", *names, *["_s_" + n for n in sums])


def rebuilt(kind: type, fields: dict):
    """An object of a class from its fields, as a broadcast carries them."""
    made = object.__new__(kind)
    made.__dict__.update(fields)
    return made


def free_name(columns: list[str], name: str) -> str:
    """A column name that no column has, whatever the letters' case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def with_scores(docs: DataFrame, text_column: str, keep: list[str], fields: str, score, rows: int = 1000) -> DataFrame:
    """The columns ``keep`` and new ``fields``, which ``score`` makes of a batch's texts (an Arrow array).

    A kept column that has the name of a new field gives way to it. Batches have the session's size;
    only the kept columns and the text go to Python.
    """
    import pyarrow as pa

    new = T._parse_datatype_string(fields)
    kept = [c for c in keep if c not in new.names]
    sent = docs.select(F.col(text_column).cast("string").alias(free_name(kept, "_text")), *kept)
    schema = T.StructType([*sent.schema.fields[1:], *new.fields])
    names = schema.names

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *score(part.column(0))], names)

    return sent.mapInArrow(run, schema)
