"""Sharding by a k-d tree: split at distributed weighted medians along the widest metadata dimension."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rehome.llm.shared import cut, parts_for

LEAST = -(2**63)


@dataclass
class Node:
    """A part of the tree that ends up as ``shards`` shards, the first of them ``first``."""

    first: int
    shards: int
    weight: int = 0
    axis: int = 0
    fixed: list[int] = field(default_factory=list)  # values of the key's components that are settled
    low: int = 0
    width: int = 0
    below: int = 0  # weight before the interval
    done: bool = False


def rows_of(spark: SparkSession, names: list[str], rows: list[tuple[int, ...]]) -> DataFrame:
    """A frame of whole numbers given by the driver; as many rows as the tree has nodes at a level."""
    values = ", ".join("(" + ", ".join(f"CAST('{x}' AS BIGINT)" for x in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(names)})")


def place_of_name(name: Column) -> Column:
    """A whole number that orders names as their first seven bytes do; null and empty names are 0."""
    head = F.substring(F.coalesce(name.cast("string"), F.lit("")).cast("binary"), 1, 7)
    return F.conv(F.rpad(F.hex(head), 14, "0"), 16, 10).cast("long")


def document_dimensions(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", names: tuple[str, ...] = ("source", "lang")) -> tuple[DataFrame, list[str]]:
    """Rows (id column, ``own_size``, ``own_group``, dimensions) for kd_shards, and the dimensions' names.

    The size is the UTF-8 bytes of the text and 8 more, the group the text's crc32. The dimensions of a document are its
    size, its number of characters, and the places of its ``names`` in byte order. Equal texts have one point: the least of
    the names of their group, null names coming first. Names are merged in tasks before they meet, and rows carry no texts. A null
    text is an empty one.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_column), (F.octet_length(text) + 8).cast("long").alias("own_size"), F.crc32(text.cast("binary")).alias("own_group"),
                       F.length(text).cast("long").alias("own_chars"), *[place_of_name(F.col(n)).alias(f"own_{n}") for n in names])
    places = [f"own_{n}" for n in names]
    rows = cut(rows)
    least = rows.groupBy("own_group").agg(*[F.min(p).alias(p) for p in places])
    return rows.drop(*places).join(least, "own_group"), ["own_size", "own_chars", *places]


def kd_shards(docs: DataFrame, shards: int, size: Column, dimensions: list[Column], group: Column,
              id_column: str = "doc_id", tolerance: float = 0.002, bins: int = 4096, slot_rows: int = 500_000) -> DataFrame:
    """(id, size, group, shard, slot) of every row: ``shards`` leaves of nearly equal size.

    ``dimensions`` and ``group`` are whole numbers, not null, ``group`` within 0 to 2**62. At each level the
    dimension whose values are widest in a node, measured against its range over all rows, is cut
    where the sizes below it reach the node's share. The cut is found by histograms: one pass sums sizes by
    bin for every node at once, and the bin in which the share lies is divided again, until it weighs
    less than ``tolerance`` of a leaf. Ties on the dimension are ordered by group, then by a hash of the id,
    so rows of one group (equal texts) part only where the group alone outweighs the tolerance.

    Histograms stay in Spark: one row a node comes to the driver. ``slot`` numbers a shard's rows from 0
    without a gap: rows are dealt into buckets by hash, buckets get their start from a sum over bucket
    counts, and rows are numbered inside a bucket. Repeated rows are rows of their own; an empty table
    gives no rows; a leaf may stay empty when there are fewer rows than shards.
    """
    spark = docs.sparkSession
    axes = [f"d{i}" for i in range(len(dimensions))]
    points = cut(docs.select(F.col(id_column).alias("id"), size.cast("long").alias("size"), group.cast("long").alias("grp"),
                             F.shiftrightunsigned(F.xxhash64(id_column), 2).alias("mix"),
                             *[d.cast("long").alias(a) for d, a in zip(dimensions, axes)]).withColumn("node", F.lit(0).cast("long")))
    ends = [f(a) for a in axes for f in (F.min, F.max)]
    span = points.agg(*ends).first()
    if span[0] is None:
        return points.select("id", "size", "grp", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    ranges = [max(1, span[2 * i + 1] - span[2 * i]) for i in range(len(axes))]
    nodes = {0: Node(0, shards)}
    leaf = None
    while any(node.shards > 1 for node in nodes.values()):
        open_nodes = {k: v for k, v in nodes.items() if v.shards > 1}
        inside = rows_of(spark, ["node"], [(k,) for k in open_nodes])
        stats = points.join(inside, "node").groupBy("node").agg(F.sum("size").alias("w"), *[f.alias(f"e{i}") for i, f in enumerate(ends)])
        filled = {r["node"]: r for r in stats.collect()}
        leaf = leaf or max(1, sum(r["w"] for r in filled.values()) // shards)
        for k, node in open_nodes.items():
            if k not in filled:
                node.fixed, node.done = [LEAST] * 3, True
                continue
            r = filled[k]
            wide = [(r[f"e{2 * i + 1}"] - r[f"e{2 * i}"]) / ranges[i] for i in range(len(axes))]
            node.axis = wide.index(max(wide))
            node.weight, node.low = r["w"], r[f"e{2 * node.axis}"]
            node.width = r[f"e{2 * node.axis + 1}"] - node.low + 1
        value = F.coalesce(*[F.when(F.col("axis") == i, F.col(a)) for i, a in enumerate(axes)])
        parts = [value, F.col("grp"), F.col("mix")]
        while waiting := {k: v for k, v in open_nodes.items() if not v.done}:
            state = rows_of(spark, ["node", "axis", "level", "f0", "f1", "low", "bin_width", "width", "need"], [
                (k, v.axis, len(v.fixed), *(v.fixed + [0, 0])[:2], v.low, -(-v.width // bins), v.width,
                 max(0, v.weight * (v.shards // 2) // v.shards - v.below)) for k, v in waiting.items()])
            at = F.when(F.col("level") == 0, parts[0]).when(F.col("level") == 1, parts[1]).otherwise(parts[2])
            here = points.join(state, "node").withColumn("x", at - F.col("low")).filter(
                ((F.col("level") < 1) | (parts[0] == F.col("f0"))) & ((F.col("level") < 2) | (parts[1] == F.col("f1")))
                & (F.col("x") >= 0) & (F.col("x") < F.col("width")))
            hist = here.withColumn("bin", F.floor(F.col("x") / F.col("bin_width"))).groupBy("node", "need", "bin").agg(F.sum("size").alias("w"))
            up_to = Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
            crossing = hist.withColumn("cum", F.sum("w").over(up_to)).filter("cum >= need")
            first = crossing.groupBy("node").agg(F.min(F.struct("bin", "cum", "w")).alias("m")).select("node", "m.*")
            for r in first.collect():
                node = waiting[r["node"]]
                need = max(0, node.weight * (node.shards // 2) // node.shards - node.below)
                step = -(-node.width // bins)
                start, before = node.low + r["bin"] * step, r["cum"] - r["w"]
                last_level = len(node.fixed) == 2
                if r["w"] <= tolerance * leaf or (step == 1 and last_level):
                    edge = start + step if r["cum"] - need < need - before else start
                    node.fixed, node.done = (node.fixed + [edge] + [LEAST, LEAST])[:3], True
                elif step > 1:
                    node.low, node.width, node.below = start, min(step, node.low + node.width - start), node.below + before
                else:
                    node.fixed, node.below = node.fixed + [start], node.below + before
                    node.low, node.width = 0, 2**62
        cuts = rows_of(spark, ["node", "axis", "t0", "t1", "t2"], [(k, v.axis, *v.fixed) for k, v in open_nodes.items()])
        left = (value < F.col("t0")) | ((value == F.col("t0")) & (
            (F.col("grp") < F.col("t1")) | ((F.col("grp") == F.col("t1")) & (F.col("mix") < F.col("t2")))))
        side = F.when(F.col("t0").isNull(), 0).when(left, 1).otherwise(2)
        points = cut(points.join(cuts, "node", "left").withColumn("node", F.col("node") * 3 + side).select(points.columns))
        grown = {}
        for k, node in nodes.items():
            if node.shards == 1:
                grown[3 * k] = Node(node.first, 1)
            else:
                half = node.shards // 2
                grown[3 * k + 1] = Node(node.first, half)
                grown[3 * k + 2] = Node(node.first + half, node.shards - half)
        nodes = grown
    leaves = rows_of(spark, ["node", "shard"], [(k, v.first) for k, v in nodes.items()])
    placed = points.join(leaves, "node").select("id", "size", "grp", F.col("shard").cast("int").alias("shard"), "mix")
    buckets = parts_for(spark, placed.count() // shards, slot_rows, 8)
    placed = placed.withColumn("bucket", F.pmod("mix", F.lit(buckets)))
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "bucket").count().select("shard", "bucket", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "bucket").orderBy("mix", "id", "grp", "size")
    slots = placed.withColumn("n", F.row_number().over(within) - 1).join(starts, ["shard", "bucket"])
    return slots.select("id", "size", "grp", "shard", (F.col("start") + F.col("n")).cast("long").alias("slot"))
