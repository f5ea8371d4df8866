"""Near-duplicate vectors: spherical k-means cells, blocked cosine products within cells, one row of a group kept."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rehome.llm.shared import components, cut
from rehome.llm.topk import usable


def spherical_centroids(sample: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids of unit vectors by cosine k-means; the start is spread over the sample in its order."""
    cells = max(1, min(cells, len(sample)))
    centres = sample[np.linspace(0, len(sample) - 1, cells).astype(int)]
    for _ in range(rounds):
        home = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.where(size > 0, size, 1.0), centres)
    return centres


def spanning_rows(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, root) rows that join the same ids as the links (left, right): each id once, with the smallest it reaches."""
    ids, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b, root = at[: len(left)], at[len(left):], np.arange(len(ids))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, root):
            return ids, ids[root]
        root = new


def near_vectors(vectors: DataFrame, threshold: float = 0.95, id_column: str = "vec_id",
                 vector_column: str = "embedding", sample_rows: int = 20000, cell_rows: int = 4096,
                 most_cells: int = 4096, block_rows: int = 8192) -> DataFrame:
    """(id, n_links, component_id, kept) for every row: cosine >= threshold links two vectors.

    Equal vectors are one before anything is compared. Centroids are fitted on at most ``sample_rows``
    distinct vectors (those of the smallest hash); about sqrt(n / cell_rows) * 2 cells, at most
    ``most_cells``. Every vector is assigned to its nearest cell. It is also a guest of each lower cell
    from whose border it is no further than the chord of the threshold: a linked vector of that cell
    cannot lie beyond it, so no link is lost and each pair meets once. Cells are dealt into blocks of
    about ``block_rows``; a task multiplies one block of residents with one block of guests, piece by
    piece, in double precision, and returns link counts and a spanning set of its links, never pairs.

    Null, empty, zero vectors and those with null or non-finite components link with nothing. Vectors of
    different lengths never link. Rows with equal vectors (repeated rows too) link with each other. A row
    with a null id takes no part: no links, a null component, not kept. Columns besides the two are not read. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).alias("v"))
    good = usable(F.col("v")) & (F.size("v") > 0) & F.exists("v", lambda x: x != 0)
    distinct = cut(rows.filter(good & F.col("vec_id").isNotNull()).groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
                   .withColumnRenamed("id", "rep"))
    n = distinct.count()
    width = distinct.select(F.max(F.size("v"))).first()[0] or 1
    picked = distinct.filter(F.size("v") == width).orderBy(F.xxhash64("v")).limit(sample_rows).select("v").toArrow()
    sample = np.array(picked.column("v").to_pylist(), float).reshape(-1, width)
    biggest = np.abs(sample).max(axis=1, keepdims=True) if len(sample) else sample
    sample = sample / biggest if len(sample) else sample
    sample = sample / np.linalg.norm(sample, axis=1, keepdims=True) if len(sample) else sample
    cells = min(most_cells, max(1, int(2 * np.sqrt(n / cell_rows))))
    centres = spherical_centroids(sample, cells) if len(sample) else np.zeros((1, width))
    gap = np.linalg.norm(centres[:, None] - centres[None], axis=2)
    # The longest chord of a link, and room for rounding: a longer one only makes more guests.
    chord = np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9

    def unit(arrays) -> np.ndarray:
        m = np.array(list(arrays), np.float64)
        m /= np.abs(m).max(axis=1, keepdims=True)
        return m / np.linalg.norm(m, axis=1, keepdims=True)

    def assign(batches):
        for pdf in batches:
            sizes = pdf["v"].map(len).to_numpy()
            # Vectors of another length than the centroids' have cells of their own, one a length.
            home = np.where(sizes == width, 0, -sizes)
            guest_of = [[int(h)] for h in home]
            at = np.nonzero(sizes == width)[0]
            for i in range(0, len(at), 4096):
                part = at[i:i + 4096]
                near = unit(pdf["v"].iloc[part]) @ centres.T
                own = near.argmax(axis=1)
                home[part] = own
                margin = near[np.arange(len(part)), own][:, None] - near
                seen = margin <= chord * gap[own]
                seen &= np.arange(len(centres))[None] < own[:, None]
                for row, cell in zip(part, own):
                    guest_of[row] = [int(cell)]
                for row, cell in zip(*np.nonzero(seen)):
                    guest_of[part[row]].append(int(cell))
            yield pd.DataFrame({"rep": pdf["rep"], "copies": pdf["copies"], "home": home, "cells": guest_of})

    placed = cut(distinct.select("rep", "copies", "v").mapInPandas(assign, "rep long, copies long, home int, cells array<int>"))
    # One row a cell, at most most_cells of them and one a vector length.
    live = {r["home"]: r["count"] for r in placed.groupBy("home").count().toLocalIterator()}
    met = {r["cell"]: r["count"] for r in placed.select(F.explode("cells").alias("cell")).groupBy("cell").count().toLocalIterator()}
    blocks = spark.createDataFrame(
        [(c, max(1, -(-live.get(c, 0) // block_rows)), max(1, -(-met[c] // block_rows))) for c in met] or [(0, 1, 1)],
        "cell int, live_blocks int, guest_blocks int")
    body = distinct.select("rep", "v").join(placed, "rep")
    hashed = F.xxhash64("rep")
    residents = (body.withColumn("cell", F.col("home")).join(blocks, "cell")
                 .withColumn("lb", F.pmod(hashed, F.col("live_blocks")).cast("int"))
                 .withColumn("gb", F.explode(F.sequence(F.lit(0), F.col("guest_blocks") - 1))))
    guests = (body.withColumn("cell", F.explode("cells")).join(blocks, "cell")
              .withColumn("gb", F.pmod(hashed, F.col("guest_blocks")).cast("int"))
              .withColumn("lb", F.explode(F.sequence(F.lit(0), F.col("live_blocks") - 1))))
    columns = ["cell", "lb", "gb", "rep", "copies", "home", "v"]
    meeting = residents.select(*columns, F.lit(True).alias("lives")).unionByName(guests.select(*columns, F.lit(False).alias("lives")))

    def compare(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        here, there = block[block["lives"]], block[~block["lives"]]
        if not len(here) or not len(there):
            return pd.DataFrame({"id": [], "links": [], "root": []})
        cell = int(key[0])
        a, b = unit(here["v"]), unit(there["v"])
        ida, idb = here["rep"].to_numpy(), there["rep"].to_numpy()
        na, nb = here["copies"].to_numpy(), there["copies"].to_numpy()
        home = there["home"].to_numpy()
        links_a, links_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in range(0, len(a), 1024):
            for j in range(0, len(b), 1024):
                hit = a[i:i + 1024] @ b[j:j + 1024].T >= threshold
                if not hit.any():
                    continue
                hit &= (home[None, j:j + 1024] > cell) | (idb[None, j:j + 1024] > ida[i:i + 1024, None])
                links_a[i:i + 1024] += hit @ nb[j:j + 1024]
                links_b[j:j + 1024] += na[i:i + 1024] @ hit
                x, y = np.nonzero(hit)
                if len(x):
                    ids, roots = spanning_rows(ida[i:i + 1024][x], idb[j:j + 1024][y])
                    left.append(ids)
                    right.append(roots)
        ends, roots = np.concatenate(left), np.concatenate(right)
        if len(ends):
            ends, roots = spanning_rows(ends, roots)
        counted = pd.concat([pd.DataFrame({"id": ida, "links": links_a}), pd.DataFrame({"id": idb, "links": links_b})])
        counted = counted[counted["links"] > 0].assign(root=lambda d: d["id"])
        return pd.concat([counted, pd.DataFrame({"id": ends, "links": 0, "root": roots})])

    found = cut(meeting.groupBy("cell", "lb", "gb").applyInPandas(compare, "id long, links long, root long"))
    groups = components(found.filter("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    answer = (distinct.join(links.withColumnRenamed("id", "rep"), "rep", "left")
              .join(groups.withColumnRenamed("id", "rep"), "rep", "left")
              .select("v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                      F.coalesce("component", "rep").alias("component_id")))
    answer = cut(answer)
    own = F.col("vec_id")
    # A vector that is not usable has no row in the answer; a null array equals nothing.
    joined = rows.join(answer, "v", "left")
    named = own.isNotNull()
    return joined.select(
        "vec_id", F.when(named, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        F.when(named, F.coalesce("component_id", own)).alias("component_id"),
        F.coalesce(own == F.coalesce("component_id", own), F.lit(False)).alias("kept"))
