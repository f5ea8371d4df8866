"""Language identification: a bidirectional gated recurrent network over bytes that labels every position."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rehome.llm.shared import crc_of_id, rebuilt, with_scores

LONGEST = 64  # bytes of one sequence between white space; a longer run is cut into several
WIDTH, PAD = 128, 16  # positions of a window; lengths of windows are rounded up to these, so that few lengths occur
LEAST_STEPS = 300  # steps of training, however little there is to learn from


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class ByteGru:
    """Two gated recurrent layers, one a direction, and a softmax over languages at every position.

    Weights are numpy arrays: per direction an input row for each byte (256 is the end), a recurrent
    matrix, and an output matrix. Sequences of one call have one length.
    """

    def __init__(self, languages: list[str], hidden: int = 16, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(hidden)).astype(np.float32)
        self.w = {f"{k}{d}": draw(*s) for d in "fb" for k, s in (("x", (257, 3 * hidden)), ("h", (hidden, 3 * hidden)), ("o", (hidden, len(languages))))}
        self.w["bias"] = np.zeros(len(languages), np.float32)

    def layer(self, x: np.ndarray, d: str, trace: bool = False):
        """States of one direction, position first; with ``trace`` what the backward pass needs."""
        size, wx, wh = self.hidden, self.w["x" + d], self.w["h" + d]
        h, states, kept = np.zeros((len(x), size), np.float32), [], []
        for t in range(x.shape[1]):
            given, own = wx[x[:, t]], h @ wh
            gates = sigmoid(given[:, :2 * size] + own[:, :2 * size])
            z, r = gates[:, :size], gates[:, size:]
            new = np.tanh(given[:, 2 * size:] + r * own[:, 2 * size:])
            if trace:
                kept.append((h, z, r, new, own[:, 2 * size:]))
            h = new + z * (h - new)
            states.append(h)
        return np.array(states), kept

    def states(self, x: np.ndarray, d: str) -> np.ndarray:
        """What ``layer`` gives, as (position, unit, sequence): long rows, worked on in their place."""
        size, n = self.hidden, len(x)
        wx, wh = (np.ascontiguousarray(self.w[k + d].T) for k in "xh")
        for w in (wx, wh):  # logistic(a) is 1 / (1 + exp(-a)), and tanh(a) is 1 - 2 / (1 + exp(2 a))
            w[:2 * size] *= -1
            w[2 * size:] *= 2
        marks = np.ascontiguousarray(x.T).astype(np.intp)
        h, given, own = np.zeros((size, n), np.float32), np.empty((3 * size, n), np.float32), np.empty((3 * size, n), np.float32)
        gates, new, found = given[:2 * size], given[2 * size:], np.empty((len(marks), size, n), np.float32)
        with np.errstate(over="ignore"):
            for mark, after in zip(marks, found):
                np.take(wx, mark, axis=1, out=given, mode="clip")
                np.matmul(wh, h, out=own)
                gates += own[:2 * size]
                np.exp(gates, out=gates)
                gates += 1
                np.reciprocal(gates, out=gates)
                own[2 * size:] *= gates[size:]
                new += own[2 * size:]
                np.exp(new, out=new)
                new += 1
                np.reciprocal(new, out=new)
                new *= -2
                new += 1
                np.subtract(h, new, out=after)
                after *= gates[:size]
                after += new
                h = after
        return found

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """P(language | sequence) at every position: (position, sequence, language)."""
        p = self.w["of"].T @ self.states(x, "f") + self.w["ob"].T @ self.states(x[:, ::-1], "b")[::-1] + self.w["bias"][:, None]
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        return p.transpose(0, 2, 1)

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over all positions and its gradient, by backpropagation through time."""
        size = self.hidden
        runs = {"f": (x, *self.layer(x, "f", True)), "b": (x[:, ::-1], *self.layer(x[:, ::-1], "b", True))}
        sides = {"f": runs["f"][1], "b": runs["b"][1][::-1]}
        logits = sides["f"] @ self.w["of"] + sides["b"] @ self.w["ob"] + self.w["bias"]
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        rows = np.arange(len(y))
        loss = float(-np.log(p[:, rows, y] + 1e-9).mean())
        p[:, rows, y] -= 1
        p /= p.shape[0] * p.shape[1]
        grad = {k: np.zeros_like(v) for k, v in self.w.items()}
        grad["bias"] = p.sum(axis=(0, 1))
        for d, (seq, states, kept) in runs.items():
            grad["o" + d] = np.einsum("tbh,tbl->hl", sides[d], p)
            from_output = p @ self.w["o" + d].T
            if d == "b":
                from_output = from_output[::-1]
            carry = np.zeros_like(states[0])
            for t in range(seq.shape[1] - 1, -1, -1):
                h, z, r, new, own = kept[t]
                dh = from_output[t] + carry
                dnew = dh * (1 - z) * (1 - new * new)
                dz = dh * (h - new) * z * (1 - z)
                dr = dnew * own * r * (1 - r)
                d_own = np.concatenate([dz, dr, dnew * r], axis=1)
                np.add.at(grad["x" + d], seq[:, t], np.concatenate([dz, dr, dnew], axis=1))
                grad["h" + d] += h.T @ d_own
                carry = dh * z + d_own @ self.w["h" + d].T
        return loss, grad

    def train(self, words: list[bytes], labels: np.ndarray, rounds: int, rate: float = 0.01, batch: int = 256, seed: int = 1, pad: int = 1,
              least_steps: int = 0) -> float:
        """Adam over batches of sequences of equal length, rounded up to ``pad``."""
        rng = np.random.default_rng(seed)
        lengths = -(-np.array([len(w) + 1 for w in words]) // pad) * pad
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        step, loss = 0, 0.0
        batches = []
        for n in np.unique(lengths):
            at = rng.permutation(np.nonzero(lengths == n)[0])
            batches += [at[i:i + batch] for i in range(0, len(at), batch)]
        rounds = max(rounds, -(-least_steps // len(batches)))
        total = rounds * len(batches)
        for _ in range(rounds):
            for at in (batches[i] for i in rng.permutation(len(batches))):
                step += 1
                loss, grad = self.gradient(sequences([words[i] for i in at], lengths[at[0]]), labels[at])
                pace = rate * (1 - step / (total + 1)) * min(1.0, len(at) / 64)
                for k, g in grad.items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    self.w[k] -= pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return loss

    def word_sums(self, words: list[bytes]) -> np.ndarray:
        """For each sequence the sum of the probabilities of its positions."""
        sums = np.zeros((len(words), len(self.languages)), np.float32)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        bounds = np.nonzero(np.diff(lengths[order]))[0] + 1
        for at in np.split(order, bounds):
            for i in range(0, len(at), 4096):
                part = at[i:i + 4096]
                sums[part] = self.probabilities(sequences([words[k] for k in part])).sum(axis=0)
        return sums


def sequences(words: list[bytes], width: int = 0) -> np.ndarray:
    """Words as rows of bytes with the end behind them, one time or up to ``width``."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    rows = np.full((len(words), max(width, int(sizes.max()) + 1)), 256, np.int16)
    rows[np.arange(rows.shape[1]) < sizes[:, None]] = np.frombuffer(b"".join(words), np.uint8)
    return rows


def windows(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, ...]:
    """(bytes of all texts, text of each window, its first byte, its core's first, its core's end, its end).

    The cores of a text's windows are its bytes, each once; a window reaches beyond its core on both sides as
    far as the text does and ``width`` allows. No window and no core is cut inside a character.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    core = width * 3 // 4
    margin = (width - core) // 2 - 2  # what is left holds a character's rest and the end
    count = -(-np.diff(offsets) // core)
    owner = np.repeat(np.arange(len(texts)), count)
    begin, end = offsets[:-1][owner], offsets[1:][owner]
    low = begin + (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * core

    def border(at: np.ndarray) -> np.ndarray:
        at = at.copy()
        for _ in range(3):
            at -= (at > begin) & (at < end) & (data[np.minimum(at, len(data) - 1)] & 0xC0 == 0x80)
        return at

    if not len(owner):
        return data, owner, low, low, low, low
    high = np.minimum(low + core, end)
    return data, owner, border(np.maximum(low - margin, begin)), border(low), border(high), border(np.minimum(high + margin, end))


def byte_runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(text of each run, its place among the distinct runs, distinct runs): bytes between ASCII white space."""
    parts = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    owner = np.repeat(np.arange(len(texts)), np.nan_to_num(pc.list_value_length(parts).to_numpy(zero_copy_only=False)).astype(np.int64))
    coded = parts.flatten().dictionary_encode()
    runs, at = [x.encode("utf-8") for x in coded.dictionary.to_pylist()], coded.indices.to_numpy()
    pieces = [[w[i:i + LONGEST] for i in range(0, len(w), LONGEST)] if len(w) > LONGEST else None for w in runs]
    if any(pieces):
        flat, start = [], []
        for w, cut in zip(runs, pieces):
            start.append(len(flat))
            flat += cut or [w]
        start.append(len(flat))
        start = np.array(start)
        count = (start[1:] - start[:-1])[at]
        owner = np.repeat(owner, count)
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        at, runs = np.repeat(start[:-1][at], count) + offset, flat
    filled = np.fromiter(map(len, runs), np.int64, len(runs))[at] > 0 if len(at) else np.zeros(0, bool)
    return owner[filled], at[filled], runs


def window_sums(net: ByteGru, texts: pa.Array, width: int) -> np.ndarray:
    """For each text the sum of the probabilities of its bytes."""
    data, owner, first, low, high, last = windows(texts, width)
    pooled = np.zeros((len(texts), len(net.languages)))
    lengths = -(-(last - first + 1) // PAD) * PAD
    for size in np.unique(lengths):
        same = np.nonzero(lengths == size)[0]
        for at in (same[i:i + 1024] for i in range(0, len(same), 1024)):
            place = first[at, None] + np.arange(size)
            rows = np.where(place < last[at, None], data[np.minimum(place, len(data) - 1)], np.int16(256))
            counts = (place >= low[at, None]) & (place < high[at, None])
            sums = np.einsum("tbl,bt->bl", net.probabilities(rows), counts.astype(np.float32))
            for k in range(len(net.languages)):
                pooled[:, k] += np.bincount(owner[at], sums[:, k], minlength=len(texts))
    return pooled


def identify(net: ByteGru, texts: pa.Array, width: int | None = None) -> tuple[list[str], np.ndarray]:
    """The language of each text and the mean of its probability over all positions.

    The network runs over windows of ``width`` positions, or over the runs between white space where that is None.
    """
    owner, at, runs = byte_runs(texts) if width is None else ((), (), ())
    pooled = np.zeros((len(texts), len(net.languages))) if width is None else window_sums(net, texts, width)
    if len(at):
        used = [r for r in runs]
        sums = np.zeros((len(runs), len(net.languages)))
        full = [i for i, r in enumerate(used) if r]
        sums[full] = net.word_sums([used[i] for i in full])
        for k in range(len(net.languages)):
            pooled[:, k] = np.bincount(owner, sums[at, k], minlength=len(texts))
    total = pooled.sum(axis=1, keepdims=True)
    share = np.clip(pooled / np.where(total > 0, total, 1), 0, 1)
    best = share.argmax(axis=1)
    lettered = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    known = lettered & (total[:, 0] > 0)
    return [net.languages[b] if ok else "und" for b, ok in zip(best, known)], np.where(known, share[np.arange(len(best)), best], 0.0)


def train_language(docs: DataFrame, each: int, sequences_each: int, rounds: int, hidden: int, modulus: int, held: int, longest_text: int,
                   id_column: str, text_column: str, lang_column: str, width: int | None = WIDTH) -> ByteGru | None:
    """A network from at most ``each`` documents with a letter a language: those of the smallest id hash.

    Of a text beyond ``longest_text`` characters it reads so many, from a place that the id's hash chooses.
    """
    lettered = F.regexp_like(F.col(text_column), F.lit(r"\p{L}"))
    own = docs.filter(F.col(lang_column).isNotNull() & lettered & (F.pmod(crc_of_id(F.col(id_column)), F.lit(modulus)) != held)).select(
        F.col(id_column).alias("id"), F.col(lang_column).alias("lang"), F.col(text_column).alias("text"), F.xxhash64(id_column).alias("h"))
    order = Window.partitionBy("lang").orderBy("h", "id")
    picked = own.select("id", "h", "lang").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= each).select("id").distinct()
    start = F.pmod("h", F.greatest(F.char_length("text") - longest_text, F.lit(0)) + 1) + 1
    rows = (own.join(F.broadcast(picked), "id", "left_semi").select("lang", F.substring("text", start.cast("int"), F.lit(longest_text)).alias("text"), "h")
            .distinct().orderBy("h", "lang", "text").toArrow().to_pylist())
    if not rows:
        return None
    languages = sorted({r["lang"] for r in rows})
    rng, words, labels = np.random.default_rng(2), [], []
    for k, lang in enumerate(languages):
        if width is None:
            own_runs = [w[i:i + LONGEST] for r in rows if r["lang"] == lang for w in r["text"].encode().split() for i in range(0, len(w), LONGEST)]
        else:
            data, _, first, _, _, last = windows(pa.array([r["text"] for r in rows if r["lang"] == lang], pa.string()), width)
            own_runs = [data[a:b].tobytes() for a, b in zip(first, last)]
        chosen = rng.permutation(len(own_runs))[:sequences_each]
        words += [own_runs[i] for i in chosen]
        labels += [k] * len(chosen)
    del rows
    net = ByteGru(languages, hidden)
    net.train(words, np.array(labels), rounds, **({} if width is None else {"batch": 128, "pad": PAD, "least_steps": LEAST_STEPS}))
    return net


def predict_language(docs: DataFrame, train: DataFrame | None = None, keep: list[str] | None = None, each: int = 200, sequences_each: int = 20000,
                     rounds: int = 3, hidden: int = 16, modulus: int = 3, held: int = 1, longest_text: int = 20000, id_column: str = "doc_id",
                     text_column: str = "text", lang_column: str = "lang", width: int | None = WIDTH) -> DataFrame:
    """The columns ``keep`` (all by default), held_out, lang_pred and score of every row.

    The network learns from ``train`` (else ``docs``) rows with a language whose id's crc32 modulo
    ``modulus`` is not ``held``: at most ``each`` documents and ``sequences_each`` sequences a language, on the
    driver, by backpropagation through time; of a text beyond ``longest_text`` characters it reads so many. A sequence is a window of at most ``width`` bytes, across white
    space and cut between characters, with ends behind it. The windows of a text overlap, so the network has read
    some bytes of either side when it labels a byte; each byte of the text counts in one window. A
    document's probabilities are the means over all its bytes; the largest is the score. With ``width`` None
    a sequence is a run of bytes between ASCII white space, cut at 64 bytes.

    ``und`` with score 0 for null texts, texts without a letter, and where nothing could be learnt. Repeated
    rows score alike; columns named like a result give way to it; an empty table gives no rows.
    """
    spark = docs.sparkSession
    keep = docs.columns if keep is None else keep
    net = train_language(docs if train is None else train, each, sequences_each, rounds, hidden, modulus, held, longest_text,
                         id_column, text_column, lang_column, width)
    # Plain arrays: a class of this package could not be read where the package is not installed.
    shared = spark.sparkContext.broadcast(None if net is None else vars(net))

    def score(column: pa.Array):
        if shared.value is None or not len(column):
            return [pa.array(["und"] * len(column), pa.string()), pa.array(np.zeros(len(column)))]
        names, scores = identify(rebuilt(ByteGru, shared.value), column, width)
        return [pa.array(names, pa.string()), pa.array(scores)]

    scored = with_scores(docs, text_column, [c for c in keep if c != "held_out"], "lang_pred string, score double", score, 2000)
    return scored.withColumn("held_out", F.coalesce(F.pmod(crc_of_id(F.col(id_column)), F.lit(modulus)) == held, F.lit(False)))
