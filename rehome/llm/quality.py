"""Quality classifier: votes of the nearest labelled documents in a latent-semantic space."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rehome.llm.shared import crc_of_id, rebuilt, with_scores

PAIRS, STEPS = 4096, 12  # buckets of byte pairs; steps of a share


def term_counts(text: str | None) -> np.ndarray:
    """Counts of a text's terms: hashed pairs of bytes, and steps of shares that describe its words and signs."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    shape = np.zeros((6, STEPS), np.float32)
    if len(raw) == 0:
        return np.concatenate([np.zeros(PAIRS, np.float32), shape.ravel()])
    pair = (raw[:-1].astype(np.int32) * 67 + raw[1:].astype(np.int32) * 2053) % PAIRS
    words = raw.tobytes().split()
    kinds = np.bincount(raw, minlength=256)
    letters = kinds[97:123].sum() + kinds[128:].sum()
    upper = kinds[65:91].sum()
    n = max(1, len(words))
    shares = [
        sum(map(bytes.__eq__, words, words[1:])) / n,
        len(set(words)) / n,
        upper / max(1, upper + letters),
        1 - (upper + letters + kinds[48:58].sum() + kinds[[9, 10, 13, 32]].sum()) / len(raw),
        min(1.0, np.log2(1 + len(words)) / 16),
        min(1.0, len(raw) / n / 24),
    ]
    for row, share in zip(shape, shares):
        row[min(STEPS - 1, int(share * STEPS))] = 1
    return np.concatenate([np.bincount(pair, minlength=PAIRS).astype(np.float32), shape.ravel()])


class LatentVoters:
    """Labelled documents as unit vectors of a truncated singular value decomposition of tf-idf terms."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, width: int, shape_weight: float, rounds: int = 4):
        self.shape_weight = shape_weight
        self.idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 1
        terms = self.weigh(counts)
        rng = np.random.default_rng(0)
        basis = terms.T @ (terms @ rng.standard_normal((terms.shape[1], width + 8), np.float32))
        for _ in range(rounds):
            basis, _ = np.linalg.qr(basis)
            basis = terms.T @ (terms @ basis)
        basis, _ = np.linalg.qr(basis)
        _, _, axes = np.linalg.svd(terms @ basis, full_matrices=False)
        self.axes = (basis @ axes[:width].T).astype(np.float32)
        self.vectors, self.labels = self.unit(terms), labels.astype(np.float32)

    def weigh(self, counts: np.ndarray) -> np.ndarray:
        """Counts become weights, in their place."""
        shape = (counts[:, PAIRS:] > 0) * np.float32(self.shape_weight)
        terms = np.log1p(counts, out=counts)
        terms *= self.idf
        norm = np.sqrt(np.einsum("ij,ij->i", terms[:, :PAIRS], terms[:, :PAIRS]))[:, None]
        terms[:, :PAIRS] /= np.where(norm > 0, norm, 1)
        terms[:, PAIRS:] = shape
        return terms

    def unit(self, terms: np.ndarray) -> np.ndarray:
        v = terms @ self.axes
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        return v / np.where(norm > 0, norm, 1)

    def score(self, counts: np.ndarray, neighbours: int, power: int) -> np.ndarray:
        """The share of the label 1 among the nearest neighbours, each weighted by a power of its cosine."""
        near = self.unit(self.weigh(counts)) @ self.vectors.T
        k = min(neighbours, near.shape[1])
        at = np.argpartition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k:]
        weight = np.maximum(np.take_along_axis(near, at, axis=1), 1e-6).astype(np.float64) ** power
        return np.clip((weight * self.labels[at]).sum(axis=1) / weight.sum(axis=1), 0, 1)


def train_voters(docs: DataFrame, labels: DataFrame, each: int, width: int, shape_weight: float, modulus: int, held: int,
                 id_column: str, text_column: str, label_column: str) -> LatentVoters | None:
    """Voters from at most ``each`` labelled documents of either label: those of the smallest id hash."""
    own = labels.filter(F.col(label_column).isNotNull() & (F.pmod(crc_of_id(F.col(id_column)), F.lit(modulus)) != held))
    one = own.groupBy(id_column).agg(F.max(label_column).alias("_label")).join(docs.select(id_column), id_column, "left_semi")
    picked = [one.filter(F.col("_label") == label).orderBy(F.xxhash64(id_column), id_column).limit(each) for label in (0, 1)]
    # At most 2 * each rows: labels are 0 and 1. Terms travel as places and counts of those that a text has.
    texts = docs.select(id_column, text_column).join(F.broadcast(picked[0].unionByName(picked[1])), id_column)

    def count(column: pa.Array):
        terms = [term_counts(t.as_py()) for t in column]
        places = [np.nonzero(x)[0].astype(np.uint16) for x in terms]
        return [pa.array([p.tobytes() for p in places], pa.binary()), pa.array([x[p].tobytes() for x, p in zip(terms, places)], pa.binary())]

    counted = with_scores(texts, text_column, [id_column, "_label"], "places binary, counts binary", count)
    # Of the texts of one id the smallest by its terms, so that reruns agree.
    counted = counted.groupBy(id_column).agg(F.min(F.struct("places", "counts", "_label")).alias("_one")).select(id_column, "_one.*")
    rows = counted.orderBy(F.xxhash64(id_column), id_column).limit(2 * each).select("_label", "places", "counts").toArrow()
    if not rows.num_rows:
        return None
    terms = np.zeros((rows.num_rows, len(term_counts(""))), np.float32)
    for row, places, counts in zip(terms, rows.column("places"), rows.column("counts")):
        row[np.frombuffer(places.as_py(), np.uint16)] = np.frombuffer(counts.as_py(), np.float32)
    return LatentVoters(terms, rows.column("_label").to_numpy(), width, shape_weight)


def judge_quality(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, each: int = 1000, width: int = 48,
                  neighbours: int = 15, power: int = 4, shape_weight: float = 0.5, threshold: float = 0.7, modulus: int = 4,
                  held: int = 2, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> DataFrame:
    """The columns ``keep`` (all of them by default), held_out, score and predicted of every row.

    Labels are learnt only from ids whose crc32 modulo ``modulus`` is not ``held`` (those are held_out). The
    sample has at most ``each`` documents of label 1 and of label 0. Terms are counted over the whole
    text where the text lies; the driver sees one term vector of fixed length for each sampled document,
    and voters (``2 * each`` vectors of ``width``) go to every task. A score depends on the text alone.

    Null and empty texts are one and the same text without terms, whose score is the sample's vote among equal
    distances. Without labels every score is 0.5. An id with several labels counts with the largest, one with several texts as one of them.
    Repeated rows score alike; columns named like a result give way to it; an empty table gives no rows.
    """
    spark = docs.sparkSession
    keep = docs.columns if keep is None else keep
    voters = train_voters(docs, labels, each, width, shape_weight, modulus, held, id_column, text_column, label_column)
    # Plain arrays: a class of this package could not be read where the package is not installed.
    shared = spark.sparkContext.broadcast(None if voters is None else vars(voters))

    def score(column: pa.Array):
        if shared.value is None:
            return [pa.array(np.full(len(column), 0.5))]
        counts = np.array([term_counts(t.as_py()) for t in column], np.float32).reshape(len(column), -1)
        return [pa.array(rebuilt(LatentVoters, shared.value).score(counts, neighbours, power))] if len(column) else [pa.array([], pa.float64())]

    scored = with_scores(docs, text_column, [c for c in keep if c not in ("held_out", "predicted")], "score double", score, 500)
    return scored.withColumns({
        "held_out": F.coalesce(F.pmod(crc_of_id(F.col(id_column)), F.lit(modulus)) == held, F.lit(False)),
        "predicted": (F.col("score") >= threshold).cast("int")})
