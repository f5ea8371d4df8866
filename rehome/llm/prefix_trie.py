"""Prefix tree of conversations: sorted turn-id matrices in range shards, whose edges are put together again."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rehome.llm.shared import crc_of_id, cut, parts_for

NODE = ("shard int, depth long, key string, parent_key string, conv_id long, parent_conv_id long, n_convs long, "
        "n_children long, n_leaves long, saved_tokens long, chars long, ends_sha256 string, chunk int, ends binary")
NAMES = [field.split()[0] for field in NODE.split(", ")]
NO_ENDS = hashlib.sha256(b"").hexdigest()
# Bytes of a turn's id (of its SHA-256), cells of a padded matrix, and bytes of member ids in a row.
ID_BYTES, CELLS, CHUNK = 16, 4_000_000, 16384


def turn_ids(keys: np.ndarray) -> np.ndarray:
    """Whole numbers from 1 for 16-byte ids, in the order of their bytes."""
    if not len(keys):
        return np.zeros(0, np.int64)
    high, low = (keys.reshape(-1, 2, 8).view(">u8")[:, i, 0].astype(np.uint64) for i in (0, 1))
    order = np.lexsort((low, high))
    new = np.ones(len(order), bool)
    new[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
    ids = np.empty(len(order), np.int64)
    ids[order] = np.cumsum(new)
    return ids


def padded(ids: np.ndarray, offsets: np.ndarray, rows: np.ndarray, first: int, width: int) -> np.ndarray:
    """Columns first.. of the ids of the rows; 0 stands where a row has ended."""
    at = offsets[rows][:, None] + np.arange(first, first + width)
    inside = at < offsets[rows + 1][:, None]
    return np.where(inside, ids[np.minimum(at, max(len(ids) - 1, 0))], 0)


def segments(ufunc, values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """ufunc over values[start : start + count] for ascending segments that do not overlap."""
    if not len(starts):
        return values[:0]
    cuts = np.column_stack([starts, starts + counts]).ravel()
    return ufunc.reduceat(np.append(values, values[:1]), cuts)[::2]


def sorted_rows(ids: np.ndarray, offsets: np.ndarray, conv: np.ndarray, width: int) -> np.ndarray:
    """The order of the rows by their id sequences, a shorter one first, then by conversation."""
    lengths = np.diff(offsets)
    rank = np.zeros(len(conv), np.int64)
    for first in range((int(lengths.max(initial=0)) - 1) // width * width, -1, -width):
        rows = np.nonzero(lengths > first)[0]
        cells = padded(ids, offsets, rows, first, width)
        order = np.lexsort((rank[rows], *cells.T[::-1]))
        cells, after = cells[order], rank[rows][order]
        new = np.ones(len(rows), np.int64)
        new[1:] = (cells[1:] != cells[:-1]).any(axis=1) | (after[1:] != after[:-1])
        rank[:] = 0
        rank[rows[order]] = np.cumsum(new)
    return np.lexsort((conv, rank))


def path_keys(turns: bytes) -> list[str]:
    """A digest for each prefix of a row, the empty one included."""
    state, keys = hashlib.sha256(), []
    for i in range(0, len(turns) + 1, ID_BYTES):
        keys.append(state.hexdigest()[:40])
        state.update(turns[i:i + ID_BYTES])
    return keys


def fold(batches):
    """The nodes of one range shard.

    Nodes that hold the shard's first or last row may go on in another shard: they have a key, and the
    conversations that end in them come as rows of text. All other nodes are whole.
    """
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    shard = TaskContext.get().partitionId()
    table = pa.Table.from_batches(held).combine_chunks()
    conv = table.column("conv_id").to_numpy()
    keys = table.column("key").cast(pa.large_binary()).combine_chunks()
    keys = keys.chunk(0) if isinstance(keys, pa.ChunkedArray) else keys
    bounds = np.frombuffer(keys.buffers()[1], np.int64)[keys.offset:keys.offset + len(keys) + 1]
    raw = np.frombuffer(keys.buffers()[2] or b"", np.uint8)[bounds[0]:bounds[-1]]
    offsets = (bounds - bounds[0]) // ID_BYTES
    chars = table.column("chars").combine_chunks()
    chars = (chars.chunk(0) if isinstance(chars, pa.ChunkedArray) else chars).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    ids = turn_ids(np.ascontiguousarray(raw))
    n = len(conv)
    width = int(np.clip(CELLS // n, 4, 64))
    order = sorted_rows(ids, offsets, conv, width)
    conv, starts_at, lengths = conv[order], offsets[:-1][order], np.diff(offsets)[order]

    def keys_of(row: int) -> list[str]:
        return path_keys(raw[starts_at[row] * ID_BYTES:(starts_at[row] + lengths[row]) * ID_BYTES].tobytes())

    first_keys, last_keys = keys_of(0), keys_of(n - 1)

    # From the root down: where nodes start, how many rows they hold, and what their parents are.
    deepest = int(lengths.max())
    live, changed = np.arange(n), np.zeros(n, bool)
    low, top, end = np.full(n, conv.min()), np.zeros(n, np.int64), np.full(n, n)
    levels = []
    for first in range(0, deepest, width):
        keep = lengths[live] > first
        seen = np.cumsum(changed)[keep]
        changed = np.diff(seen, prepend=0) > 0
        live, low, top, end = live[keep], low[keep], top[keep], end[keep]
        cells = padded(ids, offsets, order[live], first, min(width, deepest - first))
        differs = np.zeros(cells.shape, bool)
        differs[1:] = cells[1:] != cells[:-1]
        differs[:, 0] |= changed
        differs[0] = True
        np.logical_or.accumulate(differs, axis=1, out=differs)
        columns = []
        for j in range(cells.shape[1]):
            at = np.nonzero(differs[:, j])[0]
            size = np.diff(np.append(at, len(live)))
            real = cells[at, j] > 0
            least = np.minimum.reduceat(conv[live], at)
            columns.append((at[real], size[real], least[real], low[at[real]], top[at[real]], end[at[real]]))
            low, top = np.repeat(least, size), np.repeat(live[at], size)
            end = top + np.repeat(size, size)
        changed = differs[:, -1]
        levels.append((first, live, columns))

    # From the leaves up: children, leaves and saved code points, each summed over a node's rows.
    begun, leaves, saved = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)

    def nodes(depth, rows, at, size, least, parent, parent_top, parent_end, begun, leaves, saved):
        children = segments(np.add, begun, at, size)
        leaves[at] += children == 0
        length = chars[starts_at[rows[at]] + depth - 1] if depth else np.zeros(len(at), np.int64)
        saved[at] += (size - 1) * length
        begins, ends = rows[at], rows[at] + size
        ending = segments(np.add, (lengths[rows] == depth).astype(np.int64), at, size)
        key = [first_keys[depth] if b == 0 else last_keys[depth] if e == n else None for b, e in zip(begins, ends)]
        above = [None] * len(at) if not depth else [first_keys[depth - 1] if b == 0 else last_keys[depth - 1] if e == n else None
                                                    for b, e in zip(parent_top, parent_end)]
        digest, more = [], []
        for k, b, many in zip(key, begins, ending):
            if k is None:
                digest.append(hashlib.sha256(",".join(map(str, conv[b:b + many].tolist())).encode()).hexdigest() if many else NO_ENDS)
                continue
            digest.append(None)
            text = ",".join(map(str, conv[b:b + many].tolist())).encode()
            more += [(k, i // CHUNK, text[i:i + CHUNK]) for i in range(0, len(text), CHUNK)]
        m = len(at)
        long = pa.int64()
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(m, shard, np.int32)), pa.array(np.full(m, depth), long), pa.array(key, pa.string()), pa.array(above, pa.string()),
            pa.array(least, long), pa.array(parent, long, mask=np.full(m, depth == 0)), pa.array(size, long), pa.array(children, long),
            pa.array(segments(np.add, leaves, at, size), long), pa.array(segments(np.add, saved, at, size), long), pa.array(length, long),
            pa.array(digest, pa.string()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], NAMES)
        if more:
            m = len(more)
            blank = [pa.nulls(m, long)] * 7
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(m, shard, np.int32)), pa.array(np.full(m, depth), long), pa.array([x[0] for x in more], pa.string()),
                pa.nulls(m, pa.string()), *blank, pa.nulls(m, pa.string()), pa.array([x[1] for x in more], pa.int32()),
                pa.array([x[2] for x in more], pa.binary())], NAMES)

    for first, rows, columns in reversed(levels):
        mine = begun[rows], leaves[rows], saved[rows]
        children = mine[0]
        for j in range(len(columns) - 1, -1, -1):
            at = columns[j][0]
            yield from nodes(first + j + 1, rows, *columns[j], children, mine[1], mine[2])
            children = np.zeros(len(rows), np.int64)
            children[at] = 1
        begun[:] = 0
        begun[rows], leaves[rows], saved[rows] = children, mine[1], mine[2]
    whole, one = np.arange(n), np.zeros(1, np.int64)
    yield from nodes(0, whole, one, np.array([n]), np.array([conv.min()]), one, one, one, begun, leaves, saved)


def hash_ends(batches):
    """The digest of each key's member ids, fed row by row; rows come in the order of the ids."""
    key, state = None, None
    for batch in batches:
        keys, shards, texts = (batch.column(i).to_pylist() for i in range(3))
        done = []
        for k, s, text in zip(keys, shards, texts):
            if k != key:
                if key is not None:
                    done.append((key, state.hexdigest()))
                key, state, shard = k, hashlib.sha256(), s
            elif s != shard:
                shard = s
                state.update(b",")
            state.update(text)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], pa.string()) for i in (0, 1)], ["key", "ends_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])], ["key", "ends_sha256"])


def conversation_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order, as (turn, id, chars) without their texts.

    A turn's id is the first half of the SHA-256 of its role and text, so that texts are read once and
    not moved. Turns order by ``turn``, nulls first; equal ones by id. Rows without a conv_id go.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.left(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), F.lit(2 * ID_BYTES))
    turns = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").alias("turn"), key.alias("id"), F.char_length(text).alias("chars")).alias("t"))
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def shared_starts(convs: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Conversations whose first h turns are those of the conversation c - c % every; h is crc32(c) % most."""
    h = (crc_of_id(F.col("conv_id")) % most).cast("int")
    base = F.col("conv_id") - F.col("conv_id") % every
    heads = convs.filter(base == F.col("conv_id")).select(F.col("conv_id").alias("base"), F.slice("turns", 1, max(most - 1, 1)).alias("head"))
    own = F.when(h < F.size("turns"), F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))).otherwise(F.slice("turns", 1, 0))
    head = F.when(F.col("head").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("head", 1, h))
    return convs.withColumn("base", base).join(heads, "base", "left").select("conv_id", F.concat(head, own).alias("turns"))


def prefix_trie(convs: DataFrame, shard_turns: int = 500_000) -> DataFrame:
    """One row for each node of the prefix tree of ``convs`` (conv_id, turns).

    Conversations are range-sorted by their whole id sequence and conv_id into shards of about
    ``shard_turns`` turns, so that a start (or a whole conversation) that very many share is spread over
    shards. A task pads the ids of its shard into matrices of bounded size, some columns at a time, and
    sorts the rows with numpy; accumulated changes between neighbours mark where nodes start, and
    reduceat sums them depth by depth. A node that holds the first or last row of a shard may go on in the
    next: such nodes, at most two paths a shard, are put together by Spark, and what a shard counted
    twice (the shared nodes of either side of an edge) is taken off. Member ids of a node that spans
    shards are hashed as a stream, in order.

    Nodes are as whole as the input: conversations without turns are members of the root. A conv_id
    occurs once. A conversation is one row, 20 bytes a turn, so very long texts weigh nothing; a
    table without rows gives no nodes. Null and empty texts and roles are equal (see
    ``conversation_turns``), repeated rows are turns of their own, and other columns are not read.
    """
    spark = convs.sparkSession
    rows = cut(convs.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["id"]), "")).alias("key"),
                            F.transform("turns", lambda t: t["chars"]).alias("chars")))
    turns = rows.agg(F.sum(F.size("chars") + 1)).first()[0] or 0
    found = cut(rows.repartitionByRange(parts_for(spark, turns, shard_turns), "key", "conv_id").mapInArrow(fold, NODE))
    nodes = found.filter("chunk IS NULL")
    edges = nodes.filter("key IS NOT NULL")

    # Shards that a node goes on into: the nodes of its path there were counted once more.
    goes_on = F.lead("shard").over(Window.partitionBy("key").orderBy("shard")).isNotNull()
    path = Window.partitionBy("shard", "goes_on").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    counted = edges.withColumn("goes_on", goes_on).select(
        "*", F.when(F.col("goes_on"), F.sum("chars").over(path)).otherwise(0).alias("more_saved"),
        F.when(F.col("goes_on") & (F.count("*").over(path) > 1), 1).otherwise(0).alias("less_children"),
        F.when(F.col("goes_on") & (F.first("n_children").over(path) == 0), 1).otherwise(0).alias("less_leaves"))
    whole = cut(counted.groupBy("key").agg(
        F.first("depth").alias("depth"), F.first("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"),
        F.sum("n_convs").alias("n_convs"), (F.sum("n_children") - F.sum("less_children")).alias("n_children"),
        (F.sum("n_leaves") - F.sum("less_leaves")).alias("n_leaves"), (F.sum("saved_tokens") + F.sum("more_saved")).alias("saved_tokens")))
    ends = (found.filter("chunk IS NOT NULL").select("key", "shard", "ends", "chunk").repartition("key")
            .sortWithinPartitions("key", "shard", "chunk").drop("chunk").mapInArrow(hash_ends, "key string, ends_sha256 string"))
    parents = whole.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    inner = nodes.filter("key IS NULL")
    return (inner.filter("parent_key IS NULL").select(columns)
            .unionByName(inner.filter("parent_key IS NOT NULL").drop("parent_conv_id").join(parents, "parent_key").select(columns))
            .unionByName(whole.join(parents, "parent_key", "left").join(ends, "key", "left")
                         .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS))).select(columns)))
