"""SentencePiece encoding and decoding as a relational lattice over distinct words."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rehome.llm.shared import cut, parts_for

SPACE = "▁"  # fixed value: how a model's pieces write a space
UNKNOWN_PENALTY = 10.0  # fixed value: what an unknown character costs beyond the worst piece
SHORT = 64  # characters; longer words are known by their hash
HASHED = "\n\n"  # in front of a long word's hash; no word begins so
SLICE = 1000  # texts at a time
LOW = 0x250  # characters below this are looked up in a table
SPACED = re.compile(" *[^ ]+| +")
PACK_BYTES = 32 << 20  # texts that a task holds before it sends them on
PACK_ROWS = 500_000  # words with a share that a task holds before it sends them on


@dataclass
class PieceModel:
    """The ordinary pieces of a model file, with spaces as spaces, and the ids of its byte pieces."""

    pieces: list[str]
    ids: list[int]
    scores: list[float]
    first_byte: int
    names: list[bytes]  # of every id: the bytes it stands for

    @property
    def longest(self) -> int:
        return max(map(len, self.pieces))

    @property
    def unknown(self) -> float:
        return min(self.scores) - UNKNOWN_PENALTY

    @property
    def reach(self) -> Reach:
        return Reach({p[i:i + 2] for p in self.pieces for i in range(len(p) - 1)})


class Reach:
    """Which neighbouring characters some piece has; between any other two no piece can reach."""

    def __init__(self, pairs: set[str]):
        codes = np.array([[ord(c) for c in p] for p in pairs], np.int64).reshape(-1, 2)
        self.others = np.sort(codes[:, 0] << 21 | codes[:, 1])
        self.table = np.zeros((LOW, LOW), bool)
        low = codes[(codes < LOW).all(axis=1)]
        self.table[low[:, 0], low[:, 1]] = True

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        low = (left < LOW) & (right < LOW)
        reached = self.table[np.where(low, left, 0), np.where(low, right, 0)] & low
        rest = np.nonzero(~low)[0]
        if len(rest):
            reached[rest] = np.isin(left[rest] << 21 | right[rest], self.others)
        return reached


def load_model(path: str) -> PieceModel:
    """The model at ``path``, which the driver reads. It needs byte pieces, and spaces only in front of a piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kept, names, first = [], [], None
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            first = i if first is None else first
            names.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            names.append(b"")
        else:
            kept.append((piece.replace(SPACE, " "), i, float(model.get_score(i))))
            names.append(kept[-1][0].encode())
    if first is None or names[first:first + 256] != [bytes([b]) for b in range(256)]:
        raise ValueError("the model has no byte pieces in order")
    if any(re.search("[^ ] ", p) for p, _, _ in kept):
        raise ValueError("a piece goes on behind a space")
    return PieceModel([p for p, _, _ in kept], [i for _, i, _ in kept], [s for _, _, s in kept], first, names)


def cut_words(words: pa.StringArray, reach: Reach) -> tuple[pa.StringArray, np.ndarray]:
    """All words' parts that no piece reaches across, one after the other, and how many each word has. No word is empty."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[: len(words) + 1]
    data = words.buffers()[2].to_pybytes()[: offsets[-1]]
    chars = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int64)
    size = 1 + (chars >= 0x80).astype(np.int32) + (chars >= 0x800) + (chars >= 0x10000)
    at = np.concatenate([[0], np.cumsum(size)])
    begins = np.searchsorted(at, offsets[:-1])
    new = np.ones(len(chars), bool)
    new[1:] = ~reach(chars[:-1], chars[1:])
    new[begins] = True
    starts = np.nonzero(new)[0]
    bounds = np.append(at[starts], offsets[-1]).astype(np.int32)
    parts = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(data))
    return parts, np.diff(np.append(np.searchsorted(starts, begins), len(starts)))


def words_in(texts: pa.Array, reach: Reach) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """(distinct words, the words of all texts by number, how many each text has).

    A text with a space before it is split at spaces, which stay with what follows them, and each distinct part
    is cut where no piece reaches across. Texts with runs of spaces are split by a pattern instead.
    """
    texts = pc.fill_null(texts, "")
    parts = pc.split_pattern(texts, " ")
    coded = parts.flatten().dictionary_encode()
    codes, bounds = coded.indices.to_numpy(), parts.offsets.to_numpy() - parts.offsets[0].as_py()
    spelled = pc.binary_join_element_wise(pa.scalar(" "), coded.dictionary, pa.scalar(""))
    blank = pc.index(coded.dictionary, "").as_py()
    spaced = np.unique(np.searchsorted(bounds, np.nonzero(codes == blank)[0], "right") - 1) if blank >= 0 else []
    if len(spaced):
        number: dict[str, int] = {}
        own = np.split(codes, bounds[1:-1])
        for i in spaced:
            own[i] = np.array([len(spelled) + number.setdefault(w, len(number)) for w in SPACED.findall(" " + texts[int(i)].as_py())], np.int64)
        spelled = pa.concat_arrays([spelled, pa.array(list(number), pa.string())])
        codes = np.concatenate(own)
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in own])])
    flat, many_of = cut_words(spelled, reach)
    flat = flat.dictionary_encode()
    at = np.concatenate([[0], np.cumsum(many_of)])
    many = many_of[codes]
    ends = np.cumsum(many)
    place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(at[codes] - (ends - many), many)
    return flat.dictionary, flat.indices.to_numpy()[place], np.diff(np.concatenate([[0], ends])[bounds])


def word_counts(docs: DataFrame, text_column: str, reach: Reach, most: int = 500_000) -> DataFrame:
    """(word, n): words are counted where the texts lie; a task sends its counts on when it holds ``most`` of them."""

    def count(batches):
        held, size = [], 0

        def folded():
            return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                distinct, words, _ = words_in(batch.column(0).slice(i, SLICE), reach)
                seen = np.bincount(words, minlength=len(distinct))
                held.append(pa.table({"word": distinct, "n": seen}).filter(pa.array(seen > 0)))
                size += held[-1].num_rows
                if size > most:
                    held = [folded()]
                    size = held[0].num_rows
                    if size > most // 2:
                        yield from held[0].to_batches()
                        held, size = [], 0
            pa.default_memory_pool().release_unused()
        if held:
            yield from folded().to_batches()

    parts = docs.select(F.col(text_column).cast("string").alias("text")).mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


# An edge is one number, so that edges sort as numbers: its end, 31 minus its length (5 bits), and its id (22
# bits). An unknown character has its code point and the highest bit of the id.
LENGTH, ID, UNKNOWN = 22, 27, 1 << 21


class Paths:
    """Viterbi over the edges of many words: at every place the best of the edges that end there, for all words at once."""

    def __init__(self, model: PieceModel):
        self.scores = np.full(max(model.ids) + 2, model.unknown)
        self.scores[model.ids] = model.scores
        self.first_byte = model.first_byte

    def __call__(self, edges: pa.Array) -> pa.ListArray:
        """The ids of the best path of each word. Of equal sums the longest last piece stays; unknown characters are bytes."""
        counts = pc.list_value_length(edges).to_numpy(zero_copy_only=False).astype(np.int64)
        word, e = np.repeat(np.arange(len(counts)), counts), pc.list_flatten(edges).to_numpy()
        end, size, number = e >> ID, 31 - (e >> LENGTH & 31), e & ((1 << LENGTH) - 1)
        length = np.zeros(len(counts), np.int64)
        np.maximum.at(length, word, end)
        base = np.cumsum(length + 1) - length - 1
        # best and taken go by place: those of word i begin at base[i]. Long words are walked one by one, behind the others.
        best, taken = np.zeros(int((length + 1).sum())), np.zeros(int((length + 1).sum()), np.int64)
        score = self.scores[np.minimum(number, len(self.scores) - 1)]
        to = base[word] + end
        since = to - size
        long = (length > SHORT)[word]
        order = np.lexsort((-size, word, np.where(long, 0, end), long))
        short = order[:len(order) - np.count_nonzero(long)]
        bounds = np.searchsorted(end[short], np.arange(1, SHORT + 2))
        for a, b in zip(bounds, bounds[1:]):
            if a < b:
                own = short[a:b]
                total, goal = score[own] + best[since[own]], to[own]
                first = np.nonzero(np.append(True, goal[1:] != goal[:-1]))[0]
                most = np.maximum.reduceat(total, first)
                equal = np.nonzero(total == np.repeat(most, np.diff(np.append(first, len(own)))))[0]
                best[goal[first]] = most
                taken[goal[first]] = own[equal[np.searchsorted(equal, first)]]
        rest = order[len(short):]
        rest = rest[np.lexsort((-size[rest], to[rest]))]
        reached, sums, last = -1, best.tolist() if len(rest) else [], taken
        for k, goal, before, plus in zip(rest.tolist(), to[rest].tolist(), since[rest].tolist(), score[rest].tolist()):
            total = plus + sums[before]
            if goal != reached or total > sums[goal]:
                reached, sums[goal], last[goal] = goal, total, k
        at, row, found, rows = (base + length)[length > 0], np.nonzero(length)[0], [], []
        while len(at):
            found.append(taken[at])
            rows.append(row)
            at = since[found[-1]]
            on = at > base[row]
            at, row = at[on], row[on]
        found, rows = (np.concatenate(x[::-1]) if x else np.zeros(0, np.int64) for x in (found, rows))
        ids = number[found[np.argsort(rows, kind="stable")]]
        rows = np.sort(rows, kind="stable")
        points = ids[ids >= UNKNOWN] - UNKNOWN
        width = np.ones(len(ids), np.int64)
        width[ids >= UNKNOWN] = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        spelled = np.repeat(ids >= UNKNOWN, width)
        ids = np.repeat(ids, width).astype(np.int32)
        ids[spelled] = np.frombuffer("".join(map(chr, points.tolist())).encode(), np.uint8).astype(np.int32) + self.first_byte
        sizes = np.bincount(rows, width, len(counts)).astype(np.int64)
        return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(ids, pa.int32()))


def key_of(word: Column) -> Column:
    return F.when(F.char_length(word) > SHORT, F.concat(F.lit(HASHED), F.md5(word.cast("binary")))).otherwise(word)


def keyed(words: DataFrame) -> DataFrame:
    """The rows with (key, long) in place of ``word``: the word itself and null, or for a long word its hash and the word."""
    rest = [c for c in words.columns if c != "word"]
    return words.select(key_of(F.col("word")).alias("key"), F.when(F.char_length("word") > SHORT, F.col("word")).alias("long"), *rest)


def word_edges(words: DataFrame, model: PieceModel) -> DataFrame:
    """``edges array<bigint>`` beside the columns of ``words``, which are dealt out by ``key``: the lattice of each word.

    Substrings up to the longest piece are exploded and joined to the piece table, which has as many rows as
    the model file; its first characters bound how long a substring can be. A character that
    is no piece is an edge of its own, worse than any piece, that ends as its bytes. ``long`` has the word where the key
    is not the word itself. As words lie by their key, grouping the edges by word moves nothing.
    """
    spark = words.sparkSession
    longest = model.longest
    if longest > 31 or max(model.ids) >= UNKNOWN:
        raise ValueError("a piece is longer than 31 characters, or its id does not fit an edge")
    heads: dict[str, int] = {}
    for p in model.pieces:
        heads[p[:3]] = max(heads.get(p[:3], 1), len(p))
    pieces = F.broadcast(spark.createDataFrame(pa.table({"piece": model.pieces, "id": pa.array(model.ids, pa.int32())})))
    starts = F.broadcast(spark.createDataFrame(pa.table({"head": list(heads), "reach": pa.array(heads.values(), pa.int32())})))
    kept = [c for c in words.columns if c != "long"]
    word = F.coalesce("long", "key")
    at = F.sequence(F.lit(1), F.char_length(word))
    letters = F.split(word, "")
    windows = F.when(F.col("long").isNull(), F.transform(at, lambda i: F.substring(word, i, F.lit(longest)))).otherwise(
        F.transform(at, lambda i: F.array_join(F.slice(letters, i, longest), "")))
    spread = words.select(*kept, F.posexplode(windows).alias("pos", "window"))
    spread = spread.withColumn("head", F.left("window", F.lit(3))).join(starts, "head", "left")
    # Without a piece that begins with the three characters, only one and two are tried.
    lengths = F.sequence(F.lit(1), F.least(F.char_length("window"), F.coalesce("reach", F.lit(2))))
    spread = spread.select(*kept, "pos", "window", F.explode(lengths).alias("size")).withColumn("piece", F.left("window", F.col("size")))
    edges = spread.join(pieces, "piece", "left").filter("id IS NOT NULL OR size = 1")
    number = F.coalesce("id", F.ascii("piece") + UNKNOWN).cast("long")
    edge = (F.shiftleft((F.col("pos") + F.col("size")).cast("long"), ID)
            .bitwiseOR(F.shiftleft((31 - F.col("size")).cast("long"), LENGTH)).bitwiseOR(number))
    return edges.select(*kept, edge.alias("edge")).groupBy(*kept).agg(F.collect_list("edge").alias("edges"))


def encode_words(words: DataFrame, model: PieceModel, parts: int) -> DataFrame:
    """(key, ids) of every distinct word (word)."""
    paths = Paths(model)

    def fold(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("key"), paths(batch.column("edges"))], ["key", "ids"])

    return word_edges(keyed(words).repartition(parts, "key"), model).mapInArrow(fold, "key string, ids array<int>")


def common_from(words: DataFrame, most: int) -> Column:
    """Whether a word (word, n) is among the commonest but long ones: all those of the highest steps of log2(n) that fit into ``most``."""
    step, short = F.floor(F.log2("n") * 8), F.char_length("word") <= SHORT
    total, least = 0, None
    for s, count in sorted(((r[0], r[1]) for r in words.filter(short).groupBy(step).count().collect()), reverse=True):
        total += count
        if total > most:
            break
        least = s
    return F.lit(False) if least is None else short & (step >= least)


def dictionary_of(vocabulary: DataFrame) -> dict[str, np.ndarray | pa.Array]:
    """The words of a vocabulary (key, ids), sorted by a hash; ``at`` is where a word's ids begin.

    Of two words with one hash the second stays out.
    """
    table = vocabulary.select("key", "ids", F.xxhash64("key").alias("hash")).orderBy("hash", "key").toArrow()
    hashes = table.column("hash").to_numpy()
    again = np.nonzero(hashes[1:] == hashes[:-1])[0] + 1
    if len(again):
        table = table.filter(pa.array(~np.isin(np.arange(len(hashes)), again)))
        hashes = np.delete(hashes, again)
    keys = pa.concat_arrays([pa.array([], pa.string()), *[c.cast(pa.string()) for c in table.column("key").chunks]])
    lists = table.column("ids")
    at = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())]).astype(np.int32)
    ids = np.concatenate([np.zeros(0, np.int32), *[c.flatten().to_numpy() for c in lists.chunks]]).astype(np.int32, copy=False)
    hashes = hashes.copy()
    del table, lists
    pa.default_memory_pool().release_unused()
    return {"hash": hashes, "key": keys, "ids": ids, "at": at}


def found_in(keys: pa.Array, table: dict) -> np.ndarray:
    """The place of each key in the table, -1 where it has none."""
    known = table["hash"]
    if not len(known) or not len(keys):
        return np.full(len(keys), -1)
    digest = xxhash.xxh64_intdigest
    own = np.fromiter((digest(k, 42) for k in keys.to_pylist()), np.uint64, len(keys)).view(np.int64)
    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
    same = pc.equal(table["key"].take(pa.array(at)).cast(pa.string()), keys.cast(pa.string())).to_numpy(zero_copy_only=False)
    return np.where(same, at, -1)


class Speller:
    """The bytes of every id, for decoding; ids outside the model have none."""

    def __init__(self, names: list[bytes]):
        self.width = np.array([len(n) for n in names] + [0])
        self.begin = np.concatenate([[0], np.cumsum(self.width[:-1])])
        self.letters = np.frombuffer(b"".join(names), np.uint8)

    def texts(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The text of each list: its pieces' bytes without the first space."""
        last = len(self.width) - 1
        own = np.where((ids >= 0) & (ids < last), ids, last)
        size = self.width[own]
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.begin[own] - (ends - size), size)
        raw, bounds = self.letters[at].tobytes(), np.concatenate([[0], ends])[offsets].tolist()
        return [raw[a:b].decode("utf-8", "replace").removeprefix(" ") for a, b in zip(bounds, bounds[1:])]


def encode_texts(docs: DataFrame, model: PieceModel, keep: list[str] | None = None, text_column: str = "text",
                 most_words: int = 200_000, part_words: int = 30_000, decoded: str | None = None,
                 share_bytes: int = 8 << 20) -> DataFrame:
    """The columns ``keep`` (all by default) and ``ids array<int>`` of every row; with ``decoded`` also what they decode to.

    The text, a space before it, is cut into words at every place that no piece reaches across; the best segmentation of
    each distinct word (highest sum of the file's piece scores; of equals the longest last piece)
    comes from the lattice. The commonest words of up to 64 characters, at most ``most_words`` of them, go to every task
    as a dictionary, whose size those two numbers bound. Other words are rare, so few a text. Texts are dealt by their hash
    into shares of about ``share_bytes``; each rare word is dealt by its key with the shares that ask for it, gets its lattice
    there, and goes with its ids to each of those shares, where the texts meet it. Both move once and packed. Equal texts of one pack are
    encoded once, so a text that has many copies makes no long share. Nothing is cut
    off, and if the dictionary holds every word the texts are not moved at all.

    Null texts encode as empty ones: the space alone. A space is a space: the mark that models write for it is spelled
    in bytes when a text holds it, so decoding gives the very text. Repeated rows encode alike; a kept
    column named ids gives way; an empty table gives no rows.
    """
    spark = docs.sparkSession
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("ids", decoded)]
    reach = model.reach
    words = cut(word_counts(docs, text_column, reach))
    # Words are parts of texts, so they have as many bytes.
    count, size = words.agg(F.count("*"), F.coalesce(F.sum(F.col("n") * F.octet_length("word")), F.lit(0))).first()
    common = words.filter(common_from(words, most_words)).select("word")
    table = dictionary_of(cut(encode_words(common, model, parts_for(spark, min(count, most_words), part_words))))
    shared = spark.sparkContext.broadcast(table)
    known = len(table["key"])
    del table
    # Kept columns whose names are used here have others on the way.
    back = {f"_kept{i}": c for i, c in enumerate(keep)}
    text = F.col(text_column).cast("string")
    sent = docs.select(text.alias("_text"), *[F.col(f"`{c}`").alias(k) for k, c in back.items()])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sent.schema.fields[1:])
    out = (fields + ", " if fields else "") + "ids array<int>" + f", `{decoded}` string" * bool(decoded)
    names = [*back, "ids"] + [decoded] * bool(decoded)
    # A decoder of its own would be one more Python process beside each of these.
    speller = Speller(model.names) if decoded else None

    def encoded(texts: pa.Array, fills: Fills | None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's begin."""
        table = shared.value
        distinct, at, sizes = words_in(texts, reach)
        where = found_in(distinct, table)
        starts, lengths, ids_of = table["at"][np.maximum(where, 0)].astype(np.int64), np.append(np.diff(table["at"]), 0)[where].astype(np.int64), table["ids"]
        if fills:
            starts, lengths, ids_of = fills(distinct, at, where, starts, lengths)
        lengths = lengths[at]
        ends = np.cumsum(lengths)
        ids = ids_of[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[at] - (ends - lengths), lengths)]
        return ids, np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)].astype(np.int32)

    def columns_of(texts: pa.Array, fills: Fills | None = None) -> list[pa.Array]:
        ids, offsets = encoded(texts, fills)
        return [pa.ListArray.from_arrays(offsets, pa.array(ids)), *([pa.array(speller.texts(ids, offsets), pa.string())] if speller else [])]

    def encode(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *columns_of(part.column(0))], names)
            pa.default_memory_pool().release_unused()

    if known == count:
        return sent.mapInArrow(encode, out).withColumnsRenamed(back)

    def rare(batches):
        table = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                distinct, at, sizes = words_in(part.column(0), reach)
                missing = found_in(distinct, table)[at] < 0
                share = np.repeat(part.column(1).to_numpy(), sizes)[missing]
                own = np.unique(share * np.int64(len(distinct)) + at[missing])
                yield pa.RecordBatch.from_arrays([distinct.take(pa.array(own % max(1, len(distinct)))).cast(pa.string()),
                                                  pa.array((own // max(1, len(distinct))).astype(np.int32))], ["word", "share"])
            pa.default_memory_pool().release_unused()

    paths = Paths(model)

    def fold(batches):
        held = []
        for batch in batches:
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column("shares")).to_numpy(zero_copy_only=False))
            found = pa.RecordBatch.from_arrays([batch.column("key"), paths(batch.column("edges"))], ["key", "ids"])
            held.append((pc.list_flatten(batch.column("shares")).to_numpy(), found.take(pa.array(row))))
            if sum(h.num_rows for _, h in held) > PACK_ROWS:
                yield from packs(held, 0)
                held = []
        yield from packs(held, 0)

    def pack(batches):
        held, held_bytes = [], 0
        for batch in batches:
            held.append((batch.column(1).to_numpy(), pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:]], ["_text", *back])))
            held_bytes += batch.nbytes
            if held_bytes > PACK_BYTES:
                yield from packs(held, 1)
                held, held_bytes = [], 0
        yield from packs(held, 1)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(kind, data) for batch in batches for kind, data in zip(batch.column("kind").to_pylist(), batch.column("data").to_pylist())]
        fills = Fills([b for kind, d in held if kind == 0 for b in unpacked(d)], shared.value["ids"])
        for whole in (b for kind, d in held if kind == 1 for b in unpacked(d)):
            texts = whole.column(0).dictionary_encode()
            for i in range(0, len(texts.dictionary), SLICE):
                found = columns_of(texts.dictionary.slice(i, SLICE), fills)
                rows = np.nonzero(texts.indices.to_numpy() // SLICE == i // SLICE)[0]
                for at in range(0, len(rows), SLICE):
                    own = pa.array(rows[at:at + SLICE])
                    place = pc.subtract(texts.indices.take(own), pa.scalar(i, pa.int32()))
                    yield pa.RecordBatch.from_arrays([*[c.take(own) for c in whole.columns[1:]], *[c.take(place) for c in found]], names)
        pa.default_memory_pool().release_unused()

    shares = -(-size // share_bytes)
    share = F.pmod(F.xxhash64(F.coalesce("_text", F.lit(""))), F.lit(shares)).cast("int").alias("share")
    asked = keyed(docs.select(text.alias("_text")).select("_text", share).mapInArrow(rare, "word string, share int"))
    parts = parts_for(spark, count - known, part_words)
    asked = asked.repartition(parts, "key").groupBy("key").agg(F.first("long").alias("long"), F.collect_set("share").alias("shares"))
    packed = "share int, kind int, data binary"
    moved = sent.select(F.coalesce("_text", F.lit("")).alias("_text"), share, *back).mapInArrow(pack, packed)
    both = word_edges(asked, model).mapInArrow(fold, packed).unionByName(moved)
    return both.groupBy("share").applyInArrow(meet, out).withColumnsRenamed(back)


def packs(held: list[tuple[np.ndarray, pa.RecordBatch]], kind: int) -> Iterator[pa.RecordBatch]:
    """(share, kind, data): the rows of each share as one compressed stream."""
    if not held:
        return
    share = np.concatenate([s for s, _ in held])
    rows = pa.Table.from_batches([r for _, r in held])
    order = np.argsort(share, kind="stable")
    names, first = np.unique(share[order], return_index=True)
    for name, a, b in zip(names.tolist(), first, np.append(first[1:], len(order))):
        sink = pa.BufferOutputStream()
        own = rows.take(pa.array(order[a:b]))
        with pa.ipc.new_stream(sink, own.schema) as stream:
            stream.write_table(own)
        raw = sink.getvalue()
        data = raw.size.to_bytes(8, "little") + pa.Codec("zstd", compression_level=3).compress(raw, asbytes=True)
        yield pa.RecordBatch.from_arrays([pa.array([name], pa.int32()), pa.array([kind], pa.int32()), pa.array([data], pa.binary())], ["share", "kind", "data"])


def unpacked(data: bytes) -> list[pa.RecordBatch]:
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd")
    return pa.ipc.open_stream(raw).read_all().combine_chunks().to_batches()


class Fills:
    """The rare words of one share and their ids, behind those of the dictionary."""

    def __init__(self, found: list[pa.RecordBatch], flat: np.ndarray):
        lists = [f.column("ids") for f in found]
        sizes = np.concatenate([np.zeros(0, np.int64), *[pc.list_value_length(x).to_numpy(zero_copy_only=False) for x in lists]]).astype(np.int64)
        self.ids = np.concatenate([flat, *[pc.list_flatten(x).to_numpy() for x in lists]])
        self.sizes, self.begin = sizes, len(flat) + np.cumsum(sizes) - sizes
        self.place = {k: i for i, k in enumerate(k for f in found for k in f.column("key").to_pylist())}

    def __call__(self, distinct: pa.Array, at: np.ndarray, where: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the ids of each distinct word begin, how many they are, and all ids.

        ``at`` has the words that the texts hold; a word that none holds needs no ids, one without any is an error.
        """
        missing = np.nonzero((where < 0) & (np.bincount(at, minlength=len(where)) > 0))[0]
        rare = distinct.take(pa.array(missing)).to_pylist()
        own = np.fromiter((self.place[w if len(w) <= SHORT else HASHED + hashlib.md5(w.encode()).hexdigest()] for w in rare), np.int64, len(rare))
        starts, lengths = starts.copy(), lengths.copy()
        starts[missing], lengths[missing] = self.begin[own], self.sizes[own]
        return starts, lengths, self.ids


def decode_ids(rows: DataFrame, model: PieceModel, ids_column: str = "ids", new_column: str = "decoded") -> DataFrame:
    """The rows with the text of each list of ids: the bytes of its pieces without the first space. Null for null.

    Ids outside the model and control pieces stand for nothing; bytes that are no UTF-8 become U+FFFD.
    """
    speller = Speller(model.names)
    kept = [c for c in rows.columns if c != new_column]

    def decode(batches):
        for batch in batches:
            lists = batch.column(ids_column)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            ids = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            texts = pa.array(speller.texts(ids, np.concatenate([[0], np.cumsum(sizes)])), pa.string())
            texts = pc.if_else(lists.is_valid(), texts, pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], texts], [*kept, new_column])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema.fields)
    return rows.select(*kept).mapInArrow(decode, f"{fields}, `{new_column}` string")
