"""Language-model scores: Katz backoff over words, counted and evaluated where the n-grams of a word meet.

The model is of order 2 or 3. P1(w) is the Good-Turing discounted share of w among all training tokens, and what the
discounts leave over is the probability of an unknown word. P(w | h) is the discounted count of (h, w) over
the count of h where the pair was seen; else backoff(h) * P1(w), and P1(w) alone where h is unknown. The weight
backoff(h) is what the pairs of h leave over, divided by the P1 mass of the words not seen behind h, so
that P(. | h) sums to one exactly. With order 3, P(w | g h) is the discounted count of (g, h, w) over the count of
(g, h) where the three were seen, else backoff(g, h) * P(w | h), and P(w | h) alone where (g, h) is unknown or h begins
the text; backoff(g, h) is normalised over P(. | h) in the same way.

A text's score is a sum over its tokens, and each summand is a function of one pair, one word or one history. So
texts are moved once, as packed lists of (n-gram, document) dealt out by the n-gram's last word: there the
counts of triples, pairs and words are whole, and each part returns sums for each document. Discounts depend on all
parts' counts of counts; sums are therefore kept for each small count and discounted at the end. Histories
get their weights in a second, smaller exchange by history, which unseen pairs take part in. Two-word histories get
theirs in a third one, of the triples, dealt by the history as if it were a pair, so the count of its last word is there.
"""

from __future__ import annotations

import ctypes
import json
import math
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rehome.llm.shared import crc_of_id, cut, parts_for, shared_folder

SMALL = 5  # counts up to this are discounted by Good-Turing
REST = 0.1  # what a larger count gives up, so that every history has mass to hand on
START, END = np.uint64(1), np.uint64(2)  # history of the first token; the token behind the last word
TABLE = "kind string, key long, part long, data binary"
NONE = np.zeros(0, np.uint64)
PLACES = "#"  # behind the name of an array of hashes: its places among the known ones


def shrink(x: np.ndarray) -> np.ndarray:
    """Counts and indices in the smallest type that holds them."""
    if x.dtype.kind not in "iu" or x.dtype == np.uint64 or not x.size:
        return x
    return x.astype(np.min_scalar_type(int(x.max()))) if x.min() >= 0 else x


def frame(arrays: dict[str, np.ndarray], known: np.ndarray = NONE) -> bytes:
    """Arrays by name as bytes: names, types, shapes and whether steps stand for values as JSON, then the values, packed.

    Integers that never fall are steps; rising hashes that are among those of ``known``, which rise, too, are their places there. All
    first bytes of an array of integers stand before all second ones, which pack better so.
    """
    head, planes, split = [], [], {}
    for k, v in arrays.items():
        if len(known) and v.dtype == np.uint64 and len(v) and (v[1:] > v[:-1]).all():
            at = np.minimum(np.searchsorted(known, v), len(known) - 1)
            there = known[at] == v
            split |= {k + PLACES: at[there], k: v[~there]}
        else:
            split[k] = v
    for k, v in split.items():
        steps = v.dtype.kind in "iu" and v.ndim == 1 and len(v) > 1 and bool((v[1:] >= v[:-1]).all())
        held = np.ascontiguousarray(shrink(np.diff(v, prepend=v.dtype.type(0)) if steps else v))
        head.append((k, held.dtype.str, held.shape, v.dtype.str if steps else ""))
        width = held.itemsize if held.dtype.kind in "iu" else 1
        planes.append(held.reshape(-1).view(np.uint8).reshape(-1, width).T.tobytes())
    text = json.dumps(head).encode()
    raw = b"".join([len(text).to_bytes(4, "little"), text, *planes])
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unframe(data: bytes, known: np.ndarray = NONE) -> dict[str, np.ndarray]:
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)
    at = 4 + int.from_bytes(raw[:4], "little")
    out = {}
    for name, kind, shape, steps in json.loads(raw[4:at]):
        size = np.dtype(kind).itemsize
        width = size if np.dtype(kind).kind in "iu" else 1
        planes = np.frombuffer(raw, np.uint8, math.prod(shape) * size, at)
        held = np.ascontiguousarray(planes.reshape(width, -1).T).reshape(-1).view(kind).reshape(shape)
        out[name] = shrink(np.cumsum(held, dtype=steps)) if steps else held
        at += len(planes)
    for name in [n for n in out if n.endswith(PLACES)]:
        whole = name.removesuffix(PLACES)
        out[whole] = np.sort(np.concatenate([known[out.pop(name)], out[whole].astype(np.uint64)]))
    return out


def discounted(counts_of_counts: list[int]) -> np.ndarray:
    """What counts 0 to SMALL become: Katz's discounts, or half a count less where Good-Turing gives no proper ones.

    ``counts_of_counts[r]`` is how many n-grams have count r, for r up to SMALL + 1.
    """
    n = np.array(counts_of_counts, float)
    r = np.arange(SMALL + 1, dtype=float)
    plain = np.maximum(r - 0.5, 0)
    if (n[1:] <= 0).any():
        return plain
    turned = (r[1:] + 1) * n[2:] / n[1:-1] / r[1:]
    common = (SMALL + 1) * n[SMALL + 1] / n[1]
    ratio = (turned - common) / (1 - common) if common != 1 else np.zeros(SMALL)
    return np.concatenate([[0], ratio * r[1:]]) if ((ratio > 0) & (ratio < 1)).all() else plain


def after_discount(counts: np.ndarray, small: np.ndarray) -> np.ndarray:
    return np.where(counts <= SMALL, small[np.minimum(counts, SMALL)], counts - REST)


def give_back() -> None:
    """Freed memory goes back to the system, for a Python worker outlives its tasks and lies beside the executor's own memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes of words; 0, 1 and 2 are kept for marks."""
    digest = xxhash.xxh64_intdigest
    return np.maximum(np.fromiter((digest(w) for w in words), np.uint64, len(words)), np.uint64(3))


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in ASCII lower case, and how many each text has; a null text has none."""
    # A copy: ascii_lower goes astray on a part of a larger array.
    texts = pc.fill_null(texts, "").take(pa.array(np.arange(len(texts)))).cast(pa.large_string())
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = parts.flatten()
    filled = pc.not_equal(pc.binary_length(words), 0)
    kept = np.concatenate([[0], np.cumsum(filled.to_numpy(zero_copy_only=False))])
    return words.filter(filled), np.diff(kept[parts.offsets.to_numpy() - parts.offsets[0].as_py()])


def slices(batch: pa.RecordBatch, size: int = 12 << 20):
    """A batch in parts of about ``size`` bytes of text, a whole text at least."""
    width = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        done = width[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(width, done + size)))
        yield batch.slice(start, end - start)
        start = end


def unigrams(docs: DataFrame) -> DataFrame:
    """(word, c) over the training texts; the end of a text is the empty word."""
    def count(batches):
        for batch in batches:
            trained = batch.filter(batch.column("trains"))
            if not trained.num_rows:
                continue
            held = [pa.table({"word": [""], "c": pa.array([trained.num_rows], pa.int64())})]
            for part in slices(trained):
                found = split_words(part.column("text"))[0].value_counts()
                held.append(pa.table({"word": found.field("values").cast(pa.string()), "c": found.field("counts").cast(pa.int64())}))
            yield from pa.concat_tables(held).group_by("word").aggregate([("c", "sum")]).rename_columns(["word", "c"]).to_batches()

    return docs.select("trains", "text").mapInArrow(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def common_hashes(words: DataFrame, most: int) -> np.ndarray:
    """The hashes, rising, of the commonest words (word, c) of up to 64 characters: all those of the highest steps of log2(c) that fit into ``most``."""
    step, total, least = F.floor(F.log2("c") * 8), 0, None
    short = words.filter(F.char_length("word").between(1, 64))
    for s, count in sorted(((r[0], r[1]) for r in short.groupBy(step).count().collect()), reverse=True):
        total += count
        if total > most:
            break
        least = s
    return NONE if least is None else np.unique(hashes(short.filter(step >= least).select("word").toArrow().column(0).to_pylist()))


def runs(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where a new combination of the keys begins."""
    if not len(sorted_keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(sorted_keys[0]), bool)
    new[0] = True
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return np.nonzero(new)[0]


def total(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts) if len(starts) else np.zeros(0, values.dtype)


def place_of(word: np.ndarray, history: np.ndarray, parts: int, hot: np.ndarray) -> np.ndarray:
    """The part of each pair: by word, and for words of ``hot`` (sorted hashes) by word and history."""
    part = (word % np.uint64(parts)).astype(np.int64)
    heavy = np.isin(word, hot)
    part[heavy] = (word[heavy] ^ (history[heavy] * np.uint64(0x9E3779B97F4A7C15))) % np.uint64(parts)  # any odd number spreads them
    return part


def deal_pairs(texts: pa.Array, trains: np.ndarray, parts: int, hot: np.ndarray, order: int = 2) -> tuple[np.ndarray, list[tuple[int, dict[str, np.ndarray]]]]:
    """The number of words of each text, and the texts' pairs, one list for each part.

    A list has its words, their histories by number, and the documents of each pair with how often they hold
    it; documents are numbered among those that have a token in the list (``docs``), so a list grows with its tokens alone. Words of ``hot`` (sorted hashes) are dealt by word and history, all others by word alone. With order 3 a list
    has triples in place of pairs; the word before the history of a text's first token is the start, too.
    """
    words, sizes = split_words(texts)
    coded = words.dictionary_encode()
    # Numbers rise with the hashes, so that lists of names do.
    names, number = np.unique(np.concatenate([hashes(coded.dictionary.to_pylist()), [START, END]]).astype(np.uint64), return_inverse=True)
    number = number.astype(np.int32)
    start, end = number[-2:]
    ends = np.cumsum(sizes + 1) - 1
    token = np.full(int(sizes.sum()) + len(sizes), end, np.int32)
    is_word = np.ones(len(token), bool)
    is_word[ends] = False
    token[is_word] = number[coded.indices.to_numpy()]
    del words, coded, is_word, number
    history = np.roll(token, 1)
    history[ends - sizes] = start
    if order > 2:
        before = np.roll(history, 1)
        before[ends - sizes] = start
    doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes + 1)
    place = (names % np.uint64(parts)).astype(np.int32)
    part = place[token]
    heavy = np.isin(names, hot)[token]
    part[heavy] = (names[token[heavy]] ^ (names[history[heavy]] * np.uint64(0x9E3779B97F4A7C15))) % np.uint64(parts)  # any odd number spreads them
    by_part = np.argsort(shrink(part), kind="stable")
    bounds = np.searchsorted(part[by_part], np.arange(parts + 1))
    out = []
    width = np.int64(len(names))
    for p in range(parts):
        own = by_part[bounds[p]:bounds[p + 1]]
        if not len(own):
            continue
        pair = token[own].astype(np.int64) * width + history[own]
        rest = before[own] * np.int64(len(sizes)) + doc[own] if order > 2 else doc[own]
        # Tokens are in the order of their documents, and stay so.
        g = before[own] if order > 2 else np.zeros(len(own), np.int32)
        sort = np.argsort(pair * width + g, kind="stable") if width <= 1 << 21 else np.lexsort((g, pair))
        pair, rest, d = pair[sort], rest[sort], doc[own][sort]
        once = runs(pair, rest)
        times = np.diff(np.append(once, len(pair)))
        pair, d, g = pair[once], d[once], rest[once] // len(sizes) if order > 2 else None
        first = runs(pair, g) if order > 2 else runs(pair)
        w, h = pair[first] // width, pair[first] % width
        word_at = runs(w)
        used, number = np.unique(np.concatenate([h, g[first]]) if order > 2 else h, return_inverse=True)
        number, older = number[:len(h)], {"gi": number[len(h):]} if order > 2 else {}
        often = np.nonzero(times > 1)[0]
        there = np.zeros(len(sizes), bool)
        there[d] = True
        held = np.nonzero(there)[0]
        d = (np.cumsum(there) - 1)[d]
        found = {"w": names[w[word_at]], "wn": np.diff(np.append(word_at, len(w))), "h": names[used], "hi": number,
                 "dn": np.diff(np.append(first, len(pair))), "di": d, "oi": often, "ot": times[often],
                 "docs": held, "trains": trains[held]} | older
        out.append((p, {k: shrink(v) for k, v in found.items()}))
    return sizes, out


def two_words(h: np.ndarray, g: np.ndarray) -> dict[str, np.ndarray]:
    """Two-word histories by number: the distinct words of either place and which of them each history has."""
    (h, hi), (g, gi) = np.unique(h, return_inverse=True), np.unique(g, return_inverse=True)
    return {"h": h, "hi": hi, "g": g, "gi": gi}


def finder(h: np.ndarray, g: np.ndarray, share: np.ndarray):
    """A function for the share of histories asked for, 0 for unknown ones; the known ones are in the order of (h, g)."""
    # Histories are told by the places of their words among the known ones, so that one number stands for the two.
    h_names, g_names = h[runs(h)], np.unique(g)
    width = np.int64(len(g_names))
    known = np.searchsorted(h_names, h) * width + np.searchsorted(g_names, g)

    def find(h_asked: np.ndarray, g_asked: np.ndarray) -> np.ndarray:
        if not len(known):
            return np.zeros(len(h_asked))
        at_h, at_g = (np.minimum(np.searchsorted(n, x), len(n) - 1) for n, x in ((h_names, h_asked), (g_names, g_asked)))
        asked = at_h * width + at_g
        at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
        return np.where((known[at] == asked) & (h_names[at_h] == h_asked) & (g_names[at_g] == g_asked), share[at], 0.0)

    return find


class Part:
    """All lists of one part: whole counts of its triples (``c3``; with order 2 the pairs again), pairs and words.

    ``w``, ``h`` and ``g`` are numbers of ``names``, the part's hashes, which rise. The lists keep what tells their entries' documents.
    """

    def __init__(self, lists: list[dict[str, np.ndarray]], hot: dict[int, int]):
        self.names = np.unique(np.concatenate([NONE, *(np.unique(np.concatenate([x["w"], x["h"]])) for x in lists)]))
        self.start, self.end = (int(i) if i < len(self.names) and self.names[i] == mark else -1 for mark in (START, END) for i in [np.searchsorted(self.names, mark)])
        self.sizes = [len(x["hi"]) for x in lists]
        w, h, g, counts = (np.zeros(sum(self.sizes), kind) for kind in (np.int32, np.int32, np.int32, np.int64))
        begin = 0
        for x, size in zip(lists, self.sizes):
            times = np.ones(len(x["di"]), np.min_scalar_type(int(x["ot"].max())) if len(x["ot"]) else np.uint8)
            times[x["oi"]] = x["ot"]
            x["times"] = times
            at = np.cumsum(x["dn"].astype(np.int64)) - x["dn"]
            own = slice(begin, begin + size)
            counts[own] = np.add.reduceat(times.astype(np.int64) * x["trains"][x["di"]], at)
            number = np.searchsorted(self.names, x.pop("h")).astype(np.int32)
            w[own] = np.repeat(np.searchsorted(self.names, x.pop("w")).astype(np.int32), x.pop("wn"))
            h[own] = number[x.pop("hi")]
            if "gi" in x:
                g[own] = number[x.pop("gi")]
            begin += size
        if len(self.names) <= 1 << 21:
            # As one number three sort faster, and need less memory.
            one = w.astype(np.int64)
            for x in (h, g):
                one <<= 21
                one |= x
            del w, h, g, x
            order = np.argsort(one)
            one = one[order]
            first = runs(one)
            one = one[first]
            self.w, self.h, self.g = ((one >> shift & (1 << 21) - 1).astype(np.int32) for shift in (42, 21, 0))
            del one
        else:
            order = np.lexsort((g, h, w))
            w, h, g = w[order], h[order], g[order]
            first = runs(w, h, g)
            self.w, self.h, self.g = w[first], h[first], g[first]
            del w, h, g
        self.c3 = total(counts[order], first)
        number = np.zeros(len(order), np.int32)
        number[first] = 1
        self.of_entry = np.empty(len(order), np.int32)
        self.of_entry[order] = np.cumsum(number, dtype=np.int32) - 1
        del counts, order, number, first
        self.pairs = runs(self.w, self.h)
        self.c = np.repeat(total(self.c3, self.pairs), np.diff(np.append(self.pairs, len(self.w))))
        by_word = runs(self.w)
        sums = total(self.c3, by_word)
        if hot:
            known = np.array(sorted(hot), np.uint64)
            own = self.names[self.w[by_word]]
            at = np.searchsorted(known, own)
            is_hot = (at < len(known)) & (known[np.minimum(at, len(known) - 1)] == own)
            values = np.array([hot[int(k)] for k in known], np.int64)
            sums = np.where(is_hot, values[np.minimum(at, len(known) - 1)], sums)
        self.cw = np.repeat(sums, np.diff(np.append(by_word, len(self.w))))
        # Not less than 32 bits, of which logarithms are in double precision.
        self.c3, self.c, self.cw = (x.astype(np.int32) if not len(x) or x.max() < 2**31 else x for x in (self.c3, self.c, self.cw))

    def places(self, h: np.ndarray, g: np.ndarray, parts: int, hot: np.ndarray) -> np.ndarray:
        """The part of each two-word history, as place_of has it."""
        place = (self.names % np.uint64(parts)).astype(np.int32)[h]
        heavy = np.nonzero(np.isin(self.names, hot)[h])[0]
        place[heavy] = place_of(self.names[h[heavy]], self.names[g[heavy]], parts, hot)
        return place


def katz_scores(docs: DataFrame, modulus: int = 7, held: int = 2, id_column: str = "doc_id", text_column: str = "text",
                part_tokens: int = 3_000_000, model_folder: str | None = None, order: int = 2, most_words: int = 200_000) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Texts in ASCII lower case, cut at ASCII white space; each ends with one end token. The model learns from ids whose
    crc32 modulo ``modulus`` is not ``held`` (rows with a null id learn, too). ``score`` is the sum of log10 P(token |
    the ``order`` - 1 tokens before it), ``order`` being 2 or 3; ``base_score`` the sum of log10((c + 1) / (N + V + 1)).

    What a part sends back has an entry for each document that has a token there, none for the others.
    With a ``model_folder`` the model's tables lie there, partitioned by kind: ``pairs`` and
    ``stats`` by part, ``backoff`` by history; with order 3 also ``triples`` and ``backoff2`` by the part of the two-word
    history. Without one only what the scores need is written, to a new folder of the shared one, and the hashes of at most
    ``most_words`` common words go to every task, so that lists of hashes are short. The number of parts follows the training tokens, so a task holds about
    ``part_tokens`` pairs or two thirds as many triples whatever the input. A word with over half a part's tokens is dealt by its history as well; there
    are at most twice as many such words as parts, and their counts go to every task. One pair is held
    by one part: a pair that a very large share of all documents has makes that part's list of documents longer.
    Words are told apart by 64-bit hashes behind the first count.

    Null and empty texts are the end alone. Repeated rows are documents of their own. With nothing learnt
    every probability is 1. Other columns are not read; an empty table gives no rows.
    """
    if order not in (2, 3):
        raise ValueError("order is 2 or 3")
    spark = docs.sparkSession
    folder = model_folder or f"{shared_folder(spark)}/katz-{uuid.uuid4().hex}"
    out_mark = F.coalesce(F.pmod(crc_of_id(F.col(id_column)), F.lit(modulus)) == held, F.lit(False))
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"), (~out_mark).alias("trains"))
    single = cut(unigrams(rows))
    cc = [F.count_if(F.col("c") == r) for r in range(SMALL + 2)]
    head = single.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("word") == "", F.col("c"))), F.lit(0)), *cc).first()
    tokens, types, trained = head[0], head[1], head[2]
    one = discounted(list(head[3:]))
    left = sum(head[3 + r] * (r - one[r]) for r in range(1, SMALL + 1)) + (types - sum(head[3:3 + SMALL + 1])) * REST
    unknown = left / tokens if tokens else 1.0
    parts = parts_for(spark, tokens, max(1, part_tokens * 2 // order))
    # At most 2 * parts words.
    heavy = single.filter((F.col("word") != "") & (F.col("c") > tokens / (2 * parts))).collect()
    hot = dict(zip(map(int, hashes([r["word"] for r in heavy])), [r["c"] for r in heavy])) | {int(END): trained}
    hot_keys = np.array(sorted(hot), np.uint64)
    tables = model_folder is not None
    # Tables that stay have whole hashes.
    shared = spark.sparkContext.broadcast(NONE if tables else common_hashes(single, most_words))

    def packed(arrays: dict[str, np.ndarray]) -> bytes:
        return frame(arrays, shared.value)

    def opened(data: bytes) -> dict[str, np.ndarray]:
        return unframe(data, shared.value)

    def deal(batches):
        base, n = TaskContext.get().partitionId() << 24, 0
        for batch in (part for whole in batches for part in slices(whole)):
            name = base + n
            n += 1
            trains = batch.column("trains").to_numpy(zero_copy_only=False)
            ids = batch.column("doc_id")
            sizes, lists = deal_pairs(batch.column("text"), trains, parts, hot_keys, order)
            docs = {"ids": pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), "none": ids.is_null().to_numpy(zero_copy_only=False), "trains": trains, "n": sizes + 1}
            keys, data = [-1 - name], [frame(docs)]
            for p, arrays in lists:
                keys.append(p)
                data.append(packed(arrays))
            del lists
            give_back()
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([name] * len(keys), pa.int64()), pa.array(data, pa.binary())], ["part", "batch", "data"])

    histories = np.uint64(parts)

    def entries(kind: str, q: np.ndarray, history: np.ndarray, batch: np.ndarray, d: np.ndarray, m: np.ndarray, named) -> list[tuple[str, int, bytes]]:
        """Entries (batch, document, times) that ask for histories, a list for each part of the histories. ``named`` gives a list's histories."""
        rows, q = [], q.astype(np.int64)
        turn = np.lexsort((d, batch, history, q))
        q = q[turn]
        for a, b in zip(begin := runs(q), np.append(begin[1:], len(q))):
            own = turn[a:b]
            asked, number = np.unique(history[own], return_inverse=True)
            batches, at_batch = np.unique(batch[own], return_inverse=True)
            rows.append((kind, int(q[a]), packed(named(asked) | {"n": number, "batches": batches, "b": at_batch, "d": d[own], "m": m[own]})))
        return rows

    def fixes(found: list[tuple[dict[str, np.ndarray], np.ndarray]]) -> list[tuple[str, int, bytes]]:
        """What entries add to each document: ``found`` has lists of entries and the share of each of their histories."""
        if not found:
            return []
        batch, d = np.concatenate([x["batches"].astype(np.int64)[x["b"]] for x, _ in found]), np.concatenate([x["d"].astype(np.int64) for x, _ in found])
        value = np.concatenate([share[x["n"]] * x["m"] for x, share in found])
        turn = np.lexsort((d, batch))
        batch, d = batch[turn], d[turn]
        first = runs(batch, d)
        value, batch, d = total(value[turn], first), batch[first], d[first]
        begin = runs(batch)
        return [("fixes", int(batch[a]), frame({"d": d[a:b], "score": value[a:b]})) for a, b in zip(begin, np.append(begin[1:], len(batch)))]

    def meet(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        if key[0] < 0:
            return pd.DataFrame({"kind": "docs", "key": block["batch"], "part": key[0], "data": block["data"]})
        block = block.sort_values("batch")
        lists, batches = [opened(d) for d in block["data"]], block["batch"].tolist()
        del block
        part = Part(lists, hot)
        p_one = np.where(part.cw > 0, after_discount(part.cw, one) / max(1, tokens), unknown)
        seen = part.c > 0
        deep = (part.c3 > 0) & (part.h != part.start) if order > 2 else np.zeros(len(seen), bool)
        top = np.where(deep, part.c3, part.c)
        value = np.where(seen, np.where(top > SMALL, np.log10(np.maximum(top - REST, 1e-9)), 0), np.log10(p_one))
        # Small counts of pairs are told by 0 to SMALL, those of triples by what follows.
        step = np.where(top <= SMALL, top, 0) + np.where(deep, SMALL + 1, 0)
        steps = 2 * (SMALL + 1)
        # The longest known history of the token behind a word ends with it, and its probability is over that history's count.
        over = np.where(part.w == part.end, 0.0, np.log10(np.maximum(np.where(seen, part.c, part.cw) if order > 2 else part.cw, 1)))
        value -= over
        base = np.log10(part.cw + 1.0)
        del top, over
        step = step.astype(np.uint8)
        out, at, missed, missed2 = [], 0, [], []
        wanted = [(~seen, missed), (~deep & (part.h != part.start), missed2)][:order - 1]
        is_known = part.cw > 0
        for name, x, size in zip(batches, lists, part.sizes):
            entry = part.of_entry[at:at + size]
            at += size
            pair, d, m = np.repeat(entry, x["dn"]), x["di"].astype(np.int64), x["times"].astype(np.int64)
            n = len(x["docs"])
            small = np.bincount(d * steps + step[pair], m, n * steps).astype(np.int64)
            filled = np.nonzero(small)[0]
            out.append(("sums", name, frame({
                "d": x["docs"], "score": np.bincount(d, value[pair] * m, n), "base": np.bincount(d, base[pair] * m, n),
                "known": np.bincount(d, is_known[pair] * m, n).astype(np.int64),
                "small_at": np.diff(filled, prepend=0), "small": small[filled]})))
            d = x["docs"].astype(np.int64)[d]
            for lacking, held in wanted:
                own = np.nonzero(lacking[pair])[0]
                held.append((pair[own], np.full(len(own), name), d[own], m[own].astype(np.int32)))
        rows = [(k, int(n), data) for k, n, data in out]
        del out, lists, value, base, step
        # One list for each part of histories, with the entries of all batches: lists would else grow with batches times parts, squared.
        pair, batch, d, m = map(np.concatenate, zip(*missed))
        del missed
        rows += entries("missed", part.names[part.h[pair]] % histories, part.h[pair], batch, d, m, lambda own: {"h": part.names[own]})
        if order > 2:
            pair, batch, d, m = map(np.concatenate, zip(*missed2))
            h, g = part.h[pair], part.g[pair]
            several = h.astype(np.int64) * len(part.names) + g
            rows += entries("missed2", part.places(h, g, parts, hot_keys), several, batch, d, m, lambda own: two_words(part.names[own // len(part.names)], part.names[own % len(part.names)]))
            del h, g, several
        del missed2, pair, batch, d, m
        if order > 2:
            own = np.nonzero(deep)[0]
            q = part.places(part.h[own], part.g[own], parts, hot_keys)
            own = own[sort := np.lexsort((part.g[own], part.h[own], q))]
            q = q[sort]
            for q_at, q_end in zip(b := runs(q), np.append(b[1:], len(q))):
                at_q = own[q_at:q_end]
                last = dict(zip(("w", "wi"), np.unique(part.names[part.w[at_q]], return_inverse=True))) if tables else {}
                rows.append(("triples", int(q[q_at]), packed(two_words(part.names[part.h[at_q]], part.names[part.g[at_q]]) | last | {"c": part.c3[at_q], "pair": part.c[at_q]})))
            own = runs(part.w)
            own = own[~np.isin(part.names[part.w[own]], hot_keys) & (part.cw[own] > 0)]
            rows.append(("words", int(key[0]), packed({"w": part.names[part.w[own]], "n": part.cw[own]})))
            rows.append(("counts3", 0, frame({"n": np.bincount(np.minimum(part.c3[deep], SMALL + 2), minlength=SMALL + 3)[:SMALL + 2]})))
        own = part.pairs[seen[part.pairs]]
        w, h, c, p1 = part.w[own], part.h[own], part.c[own], p_one[own]
        names, number = np.unique(h, return_inverse=True)
        names = part.names[names]
        kinds = np.bincount(number * (SMALL + 1) + np.where(c <= SMALL, c, 0), minlength=len(names) * (SMALL + 1)).reshape(-1, SMALL + 1)
        mass, count = np.bincount(number, p1, len(names)), np.bincount(number, c, len(names)).astype(np.int64)
        q = names % histories
        turn = np.lexsort((names, q))
        for q_at, q_end in zip(b := runs(q[turn]), np.append(b[1:], len(turn))):
            own = turn[q_at:q_end]
            rows.append(("stats", int(q[own[0]]), packed({"h": names[own], "kinds": kinds[own], "mass": mass[own], "count": count[own]})))
        if tables:
            # Histories are told by their place in the part's stats, in the order of (history part, hash).
            rank = np.empty(len(turn), np.int64)
            rank[turn] = np.arange(len(turn))
            at_word = runs(w)
            rows.append(("pairs", int(key[0]), packed({"w": part.names[w[at_word]], "wn": np.diff(np.append(at_word, len(w))), "h": rank[number], "c": c})))
        rows.append(("counts", 0, frame({"n": np.bincount(np.minimum(c, SMALL + 2), minlength=SMALL + 3)[:SMALL + 2]})))
        return pd.DataFrame(rows, columns=["kind", "key", "data"]).assign(part=key[0])[["kind", "key", "part", "data"]]

    def then_free(task):
        def run(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
            try:
                return task(key, block)
            finally:
                give_back()

        return run

    dealt = rows.mapInArrow(deal, "part long, batch long, data binary")
    dealt.groupBy("part").applyInPandas(then_free(meet), TABLE).write.partitionBy("kind").parquet(f"{folder}/counted")

    def counted(folder: str, kind: str) -> DataFrame:
        whole = spark.read.schema("key long, part long, data binary, kind string").parquet(folder)
        return whole.filter(F.col("kind") == kind).select("kind", "key", "part", "data")

    def discounts(kind: str) -> np.ndarray:
        def numbers(batches):
            for batch in batches:
                for data in batch.column("data").to_pylist():
                    n = unframe(data)["n"]
                    yield pa.RecordBatch.from_pydict({"r": np.arange(len(n)), "n": n.astype(np.int64)})

        totals = np.zeros(SMALL + 2, np.int64)
        for r in counted(f"{folder}/counted", kind).select("data").mapInArrow(numbers, "r long, n long").groupBy("r").agg(F.sum("n").alias("n")).collect():
            totals[r["r"]] = r["n"]
        return discounted(totals.tolist())

    two, three = discounts("counts"), discounts("counts3")
    gives, gives3 = (np.concatenate([[REST], np.arange(1, SMALL + 1) - x[1:]]) for x in (two, three))

    def weigh(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        stats = [opened(d) for d in block["data"][block["kind"] == "stats"]]
        missed = [opened(d) for d in block["data"][block["kind"] == "missed"]]
        names = np.concatenate([x["h"] for x in stats]) if stats else np.zeros(0, np.uint64)
        names, number = np.unique(names, return_inverse=True)

        def add(field: str, one_of=lambda x: x) -> np.ndarray:
            return np.bincount(number, np.concatenate([one_of(x[field]) for x in stats]), len(names)) if stats else np.zeros(0)

        handed, mass, count = add("kinds", lambda x: x @ gives), add("mass"), add("count")
        share = np.log10(handed) - np.log10(1 - mass)
        rows = [("backoff", int(key[0]), frame({"h": names, "weight": 10 ** share / np.maximum(count, 1)}))] if tables else []
        known_names = len(names)
        found = []
        for x in missed:
            at = np.minimum(np.searchsorted(names, x["h"]), max(0, known_names - 1))
            value = np.where(names[at] == x["h"], share[at], 0.0) if known_names else np.zeros(len(x["h"]))
            found.append((x, value))
        rows += fixes(found)
        return pd.DataFrame(rows, columns=["kind", "key", "data"]).assign(part=key[0])[["kind", "key", "part", "data"]]

    def weigh_two(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        found = {kind: [opened(d) for d in block["data"][block["kind"] == kind]] for kind in ("triples", "words", "missed2")}
        rows, share, h, g = [], np.zeros(0), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        if found["triples"]:
            h, g = (np.concatenate([x[k][x[k + "i"]] for x in found["triples"]]) for k in "hg")
            c, pair = (np.concatenate([x[k].astype(np.int64) for x in found["triples"]]) for k in ("c", "pair"))
            sort = np.lexsort((g, h))
            h, g, c, pair = h[sort], g[sort], c[sort], pair[sort]
            first = runs(h, g)
            h, g = h[first], g[first]
            words = np.concatenate([np.array(list(hot), np.uint64), *(x["w"] for x in found["words"])])
            sizes = np.concatenate([np.array(list(hot.values()), np.int64), *(x["n"].astype(np.int64) for x in found["words"])])
            by_word = np.argsort(words)
            size = sizes[by_word][np.searchsorted(words[by_word], h)]
            handed = total(gives3[np.where(c <= SMALL, c, 0)], first)
            # What P(. | h) leaves to the words not seen behind (g, h), times the count of h.
            left = size - total(pair, first) + total(gives[np.where(pair <= SMALL, pair, 0)], first)
            share = np.log10(handed) - np.log10(left)
            if tables:
                rows.append(("backoff2", int(key[0]), frame(two_words(h, g) | {"weight": handed * size / left / total(c, first)})))
            del c, pair, sort, first, size, handed, left
        find = finder(h, g, share)
        rows += fixes([(x, find(x["h"][x["hi"]], x["g"][x["gi"]])) for x in found["missed2"]])
        return pd.DataFrame(rows, columns=["kind", "key", "data"]).assign(part=key[0])[["kind", "key", "part", "data"]]

    by_history = counted(f"{folder}/counted", "stats").unionByName(counted(f"{folder}/counted", "missed"))
    by_history.groupBy("key").applyInPandas(then_free(weigh), TABLE).write.partitionBy("kind").parquet(f"{folder}/weighed")

    if order > 2:
        by_two = counted(f"{folder}/counted", "triples").unionByName(counted(f"{folder}/counted", "words")).unionByName(counted(f"{folder}/counted", "missed2"))
        by_two.groupBy("key").applyInPandas(then_free(weigh_two), TABLE).write.partitionBy("kind").parquet(f"{folder}/weighed2")

    small_logs = np.concatenate([[0], np.log10(np.maximum(two[1:], 1e-300)), [0], np.log10(np.maximum(three[1:], 1e-300))])
    level = np.log10(tokens + types + 1.0)
    begin = np.log10(max(1, trained))

    def finish(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        docs = unframe(block["data"][block["kind"] == "docs"].iloc[0])
        n, steps = len(docs["n"]), len(small_logs)
        score, base, known, small = np.zeros(n), np.zeros(n), np.zeros(n, np.int64), np.zeros(n * steps, np.int64)
        for kind, data in block.sort_values(["kind", "part"])[["kind", "data"]].itertuples(index=False):
            if kind == "sums":
                x = unframe(data)
                d = x["d"].astype(np.int64)
                score[d] += x["score"]
                base[d] += x["base"]
                known[d] += x["known"].astype(np.int64)
                at = np.cumsum(x["small_at"].astype(np.int64))
                small[d[at // steps] * steps + at % steps] += x["small"].astype(np.int64)
            elif kind == "fixes":
                x = unframe(data)
                score[x["d"]] += x["score"]
        score += small.reshape(n, -1) @ small_logs - begin * (trained > 0)
        ids = pd.array(docs["ids"].astype(np.int64), "Int64")
        ids[docs["none"]] = pd.NA
        return pd.DataFrame({"doc_id": ids, "held_out": ~docs["trains"], "n_tokens": docs["n"].astype(np.int64), "n_known": known, "train_tokens": tokens,
                             "base_score": base - docs["n"] * level, "score": score})

    pieces = counted(f"{folder}/counted", "docs").unionByName(counted(f"{folder}/counted", "sums")).unionByName(counted(f"{folder}/weighed", "fixes"))
    if order > 2:
        pieces = pieces.unionByName(counted(f"{folder}/weighed2", "fixes"))
    return pieces.groupBy("key").applyInPandas(
        finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
