"""SimHash near-dedup: fingerprints of word shingles, compared tile by tile with exclusive-or and bit counts."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rehome.llm.shared import components, cut, parts_for, running_sums
from rehome.llm.vector_groups import spanning_rows

SEED = 42  # fixed value: the seed of every shingle's hash


def fingerprint(text: str | None, shingle: int) -> int:
    """The 64 majority bits of the hashes of all shingles, repeats included; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    count = len(words) - shingle + 1
    ones, piece = np.zeros(64, np.int64), 1 << 16
    for i in range(0, count, piece):
        spans = zip(starts[i:min(i + piece, count)].tolist(), ends[i + shingle - 1:min(i + piece, count) + shingle - 1].tolist())
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)
        # Little-endian bytes, little bit order: column k of the bits is bit k of the hash.
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    high = np.packbits(ones * 2 > count, bitorder="little")
    return int(high.view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int, id_column: str, text_column: str) -> DataFrame:
    """(doc_id, bits): the fingerprint of every row as a signed 64-bit number."""

    def hash_texts(batches):
        for batch in batches:
            bits = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.view(np.int64))], ["doc_id", "bits"])

    rows = docs.select(F.col(id_column).cast("long"), F.col(text_column).cast("string"))
    return rows.mapInArrow(hash_texts, "doc_id long, bits long")


def word_counts(bits: np.ndarray) -> np.ndarray:
    """The population counts of the four 16-bit words of each fingerprint."""
    return np.bitwise_count(bits.view(np.uint16).reshape(-1, 4)).astype(np.int16)


def near_in_tiles(a: np.ndarray, b: np.ndarray, radius: int, same: bool, tile: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of the links between two sorted blocks of distinct fingerprints, as (id, root) rows.

    Tiles whose population counts, of the four words taken together, differ beyond the radius are
    skipped: each word's bits differ at least as often as its counts do.
    """
    def tiles(x):
        x = x[np.lexsort(word_counts(x).T[::-1])]
        pops = word_counts(x)
        return [(x[i:i + tile], pops[i:i + tile].min(axis=0), pops[i:i + tile].max(axis=0)) for i in range(0, len(x), tile)]

    one = tiles(a)
    other = one if same else tiles(b)
    low, high = np.array([t[1] for t in other]), np.array([t[2] for t in other])
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    held = 0
    for i, (x, lx, hx) in enumerate(one):
        gaps = np.maximum(0, np.maximum(low - hx, lx - high)).sum(axis=1)
        for j in np.nonzero(gaps <= radius)[0]:
            if same and j < i:
                continue
            y = other[j][0]
            near = np.bitwise_count(x[:, None] ^ y[None]) <= radius
            if same and i == j:
                near = np.triu(near, 1)
            r, c = np.nonzero(near)
            if len(r):
                ids, roots = spanning_rows(x[r].view(np.int64), y[c].view(np.int64))
                left.append(ids)
                right.append(roots)
                held += len(ids)
                if held > 1 << 20:
                    ids, roots = spanning_rows(np.concatenate(left), np.concatenate(right))
                    left, right, held = [ids], [roots], len(ids)
    ids, roots = np.concatenate(left), np.concatenate(right)
    return spanning_rows(ids, roots) if len(ids) else (ids, roots)


def simhash_groups(docs: DataFrame, shingle: int = 4, radius: int = 4, id_column: str = "doc_id",
                   text_column: str = "text", block_rows: int = 65_536) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    Texts in ASCII lower case, cut at ASCII white space, give shingles of ``shingle`` words (a shorter
    text is one shingle; no words: fingerprint 0). A fingerprint's bit is 1 where over half of the shingles'
    XXH64 hashes have it. Fingerprints with at most ``radius`` differing bits link, and ``component_id`` is
    the smallest id that links reach.

    Documents with equal fingerprints are one before the comparison. Distinct fingerprints are put in the
    order of the population counts of their words and dealt into blocks by that order; every pair of
    blocks that can hold a link is one task, which compares them tile by tile. A fingerprint goes to as many
    tasks as there are blocks near its own: the work is all pairs of distinct fingerprints but those that
    counts rule out, as the method says. Tasks return spanning links, never all pairs.

    Null and blank texts have fingerprint 0 and link like others. Rows with a null id get a fingerprint and a
    null component. Repeated rows are copies. Other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    marked = cut(fingerprints(docs, shingle, id_column, text_column))
    distinct = marked.filter("doc_id IS NOT NULL").groupBy("bits").agg(F.min("doc_id").alias("first"))
    counts = [F.bit_count(F.shiftrightunsigned("bits", 16 * w).bitwiseAND(0xFFFF)) for w in range(4)]
    distinct = cut(distinct.select("bits", "first", *[c.alias(f"w{w}") for w, c in enumerate(counts)]))
    n = distinct.count()
    order = [F.col(f"w{w}") for w in range(4)] + [F.col("bits")]
    blocks = min(parts_for(spark, n, block_rows), max(1, n))
    placed = running_sums(distinct.withColumn("one", F.lit(1)), order, {"place": "one"}, blocks)
    placed = cut(placed.select("bits", *[f"w{w}" for w in range(4)], F.floor((F.col("place") - 1) * blocks / max(1, n)).cast("int").alias("block")))
    ends = [f(f"w{w}").alias(f"{name}{w}") for w in range(4) for f, name in ((F.min, "l"), (F.max, "h"))]
    boxes = placed.groupBy("block").agg(*ends)
    # Blocks meet where the first word's counts overlap within the radius: an equi-join on each such count.
    reach = boxes.withColumn("at", F.explode(F.sequence("l0", F.col("h0") + radius)))
    other = boxes.select(*[F.col(c).alias("o_" + c) for c in boxes.columns]).withColumn("at", F.explode(F.sequence("o_l0", F.col("o_h0") + radius)))
    apart = sum((F.greatest(F.lit(0), F.col(f"l{w}") - F.col(f"o_h{w}"), F.col(f"o_l{w}") - F.col(f"h{w}")) for w in range(4)), F.lit(0))
    pairs = reach.join(other, "at").filter((F.col("block") <= F.col("o_block")) & (apart <= radius)).select("block", "o_block").distinct()
    pairs = cut(pairs.withColumnRenamed("block", "x").withColumnRenamed("o_block", "y"))
    goes = pairs.select(F.col("x").alias("block"), "x", "y").unionByName(pairs.filter("x <> y").select(F.col("y").alias("block"), "x", "y"))
    sent = placed.select("bits", "block").join(goes, "block")

    def compare(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        here = block["block"].to_numpy() == int(key[0])
        bits = block["bits"].to_numpy(np.int64).view(np.uint64)
        same = int(key[0]) == int(key[1])
        ids, roots = near_in_tiles(bits[here], bits[here] if same else bits[~here], radius, same)
        return pd.DataFrame({"a": ids, "b": roots})

    links = cut(sent.groupBy("x", "y").applyInPandas(compare, "a long, b long").filter("a <> b"))
    # From fingerprints to the smallest id of each, which is what components are named by.
    named = distinct.select("bits", "first")
    of_a = named.select(F.col("bits").alias("a"), F.col("first").alias("fa"))
    of_b = named.select(F.col("bits").alias("b"), F.col("first").alias("fb"))
    groups = components(links.join(of_a, "a").join(of_b, "b").select(F.col("fa").alias("a"), F.col("fb").alias("b")))
    answer = cut(named.join(groups.withColumnRenamed("id", "first"), "first", "left").select(
        "bits", F.coalesce("component", "first").alias("component_id")))
    joined = marked.join(answer, "bits", "left")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"),
                         F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
