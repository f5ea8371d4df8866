"""Exact top-k search: tiled matrix products of queries and shards, merged as a tree of top lists."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rehome.llm.shared import cut, parts_for


def whole_numbers(x: np.ndarray, scale: int) -> tuple[np.ndarray, float]:
    """floor(scale * x), and its largest size: doubles while all are whole below 2**53, else Python's integers."""
    with np.errstate(over="ignore"):
        v = np.floor(x * float(scale))
    top = float(np.abs(v).max(initial=0))
    if top < 2**53:
        return v, top
    # A double of 2**53 or more is a whole number itself.
    return np.array([[int(e) * scale if abs(e) >= 2**53 else math.floor(e * scale) for e in row] for row in x.tolist()], object), top


def usable(vector: Column) -> Column:
    """Not null, and no component null or non-finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


def top_products(vectors: DataFrame, is_query: Column, k: int = 10, id_column: str = "vec_id",
                 vector_column: str = "embedding", scale: int = 1024, tile_rows: int = 2048,
                 shard_rows: int = 16384, fan: int = 16) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products of scaled whole numbers.

    Candidates are all usable rows but the query's own id; ties go to the smaller id. Queries are dealt
    into tiles and candidates into shards by a hash of the id; a task holds one tile and one shard,
    multiplies them block by block and keeps k rows a query of each block. A query's lists of all
    shards are merged ``fan`` at a time, so no task gathers more than ``fan * k`` rows of a query.

    Null, non-finite or null-component vectors take no part, nor do rows with a null id. Empty vectors
    score 0 among themselves; vectors score only with vectors of their own length. A row that is there
    twice counts once; an id with two vectors is two candidates, and as a query keeps its best k of both.
    Sums are exact; one beyond a long is given as 2**63 - 1 or its negative, and ranks as that.
    Other columns are not read. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.filter(usable(F.col(vector_column)) & F.col(id_column).isNotNull()).select(
        F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v"),
        is_query.alias("asks"))
    n, asking = rows.agg(F.count("*"), F.count_if("asks")).first()
    shards = parts_for(spark, n, shard_rows)
    tiles = parts_for(spark, asking, tile_rows, 1)
    # The hash of the length keeps vectors of different lengths apart.
    shard = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")
    tile = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(tiles)).cast("int")
    width = F.size("v").alias("width")

    def all_of(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    asked = rows.filter("asks").select("id", "v", width, tile.alias("tile"), all_of(shards).alias("shard"))
    held = rows.select("id", "v", width, shard.alias("shard"), all_of(tiles).alias("tile"))

    def once(pdf: pd.DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, float]:
        ids = pdf["id"].to_numpy(np.int64)
        v, top = whole_numbers(np.array(pdf["v"].tolist(), np.float64).reshape(len(ids), width), scale)
        order = np.argsort(ids, kind="stable")
        if len(np.unique(ids)) < len(ids):
            order = sorted({(i, *row): at for at, (i, row) in enumerate(zip(ids.tolist(), v.tolist()))}.values(), key=lambda at: ids[at])
        return ids[order], v[order], top

    def multiply(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "shard": [], "vec_id": [], "score": []})
        width = int(key[2])
        (qid, q, of_q), (cid, c, of_c) = once(left, width), once(right, width)
        top = of_q * of_c * max(width, 1)
        # Products and sums of whole numbers below 2**53 are exact in doubles; beyond 2**63 Python's integers are.
        kind = np.float64 if top < 2**53 else np.int64 if top < 2**62 and max(of_q, of_c) < 2**62 else object
        q, c = q.astype(kind), c.astype(kind)
        out = []
        for i in range(0, len(q), 256):
            best = None
            for j in range(0, len(c), 4096):
                s = q[i:i + 256] @ c[j:j + 4096].T
                s = (np.clip(s, 1 - 2**63, 2**63 - 1) if kind is object else s).astype(np.int64)
                mine = qid[i:i + 256, None] == cid[None, j:j + 4096]
                if s.shape[1] > k + 1:
                    low = np.partition(np.where(mine, np.iinfo(np.int64).min, s), s.shape[1] - k, axis=1)[:, s.shape[1] - k]
                    keep = ~mine & (s >= low[:, None])
                else:
                    keep = ~mine
                r, x = np.nonzero(keep)
                new = np.column_stack([r, s[r, x], cid[j:j + 4096][x]])
                best = new if best is None else np.vstack([best, new])
                order = np.lexsort((best[:, 2], ~best[:, 1], best[:, 0]))
                best = best[order]
                first = np.searchsorted(best[:, 0], best[:, 0])
                best = best[np.arange(len(best)) - first < k]
            out.append(np.column_stack([qid[i:i + 256][best[:, 0]], best[:, 2], best[:, 1]]))
        found = np.vstack(out)
        return pd.DataFrame({"query_id": found[:, 0], "shard": key[1], "vec_id": found[:, 1], "score": found[:, 2]})

    keys = ["tile", "shard", "width"]
    lists = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(
        multiply, "query_id long, shard int, vec_id long, score long")
    # The products are written once; the merges only read short lists.
    lists = cut(lists)
    while True:
        shards = -(-shards // fan)
        lists = lists.withColumn("shard", F.floor(F.col("shard") / fan).cast("int"))
        order = Window.partitionBy("query_id", "shard").orderBy(F.desc("score"), "vec_id")
        lists = lists.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        if shards == 1:
            return lists.select("query_id", "rank", "vec_id", "score")
