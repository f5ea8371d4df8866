"""Whitening of vectors: principal components by block Jacobi-Davidson over distributed centred products."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rehome.llm.shared import cut
from rehome.llm.topk import usable

# Whole numbers up to this bound (2**52) and their neighbours are exact as doubles.
LARGEST = float(2**52)


def minres(product: Callable[[np.ndarray], np.ndarray], right: np.ndarray, steps: int, enough: float) -> np.ndarray:
    """Columns x with a small residual of product(x) = right, each column by its own MINRES recurrence.

    ``product`` is symmetric in each column and is called once a step for all of them. A column stops
    changing when its residual has fallen by the factor ``enough`` or its Krylov space is used up.
    """
    x = np.zeros_like(right)
    start = np.linalg.norm(right, axis=0)
    live = start > 0
    v_old, v = np.zeros_like(right), right / np.where(live, start, 1)
    d_old, d = np.zeros_like(right), np.zeros_like(right)
    beta, rest = np.zeros(right.shape[1]), start.copy()
    c_old, c, s_old, s = (np.full(right.shape[1], y) for y in (1.0, 1.0, 0.0, 0.0))
    for _ in range(steps):
        if not live.any():
            break
        w = product(v)
        alpha = (v * w).sum(axis=0)
        w = w - alpha * v - beta * v_old
        beta_new = np.linalg.norm(w, axis=0)
        # The last two rotations, and a new one that removes the entry below the diagonal.
        over, delta = s_old * beta, c * c_old * beta + s * alpha
        gamma_bar = c * alpha - s * c_old * beta
        gamma = np.hypot(gamma_bar, beta_new)
        fine = live & (gamma > 0)
        safe = np.where(fine, gamma, 1)
        c_new, s_new = gamma_bar / safe, beta_new / safe
        d_new = np.where(fine, (v - delta * d - over * d_old) / safe, 0)
        x = x + np.where(fine, c_new * rest, 0) * d_new
        rest = np.where(fine, -s_new * rest, rest)
        live = fine & (np.abs(rest) > enough * start) & (beta_new > 1e-14 * np.abs(alpha))
        v_old, v = v, w / np.where(beta_new > 0, beta_new, 1)
        d_old, d, c_old, c, s_old, s, beta = d, d_new, c, c_new, s, s_new, beta_new
    return x


def orthonormal(basis: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Columns of ``new`` made orthonormal to the basis and each other; those that lie in its span are left out."""
    kept = basis
    for column in new.T:
        size = np.linalg.norm(column)
        if not size > 0:
            continue
        column = column / size
        for _ in range(3):
            column = column - kept @ (kept.T @ column)
            size = np.linalg.norm(column)
            if size < 1e-10:
                break
            column = column / size
        else:
            kept = np.column_stack([kept, column])
    return kept[:, basis.shape[1]:]


def jacobi_davidson(apply: Callable[[np.ndarray], np.ndarray], width: int, count: int, inner: int = 4,
                    most_basis: int | None = None, most_rounds: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, vectors, residuals): the ``count`` largest eigenpairs of a symmetric operator, largest first.

    ``apply`` multiplies a block of columns. Each round takes the Ritz pairs of the basis, locks the
    leading ones whose residuals have reached double precision, and widens the basis by corrections t of
    all other wanted pairs: (I - QQ')(A - theta I)(I - QQ') t = -r, solved by ``inner`` steps of MINRES
    for all of them at once, where Q holds the locked vectors and the pair's own. A basis of more than ``most_basis``
    columns starts again from its leading Ritz vectors.
    """
    count = min(count, width)
    most_basis = min(width, max(3 * count, count + 32) if most_basis is None else most_basis)
    block = min(width, count + min(count, 8))
    basis = orthonormal(np.zeros((width, 0)), np.random.default_rng(1).standard_normal((width, block)))
    image = apply(basis)
    locked, best, stuck = 0, np.inf, 0
    for _ in range(most_rounds):
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        vectors, images = basis @ turn, image @ turn
        wanted = min(count, len(values))
        rest = images[:, :wanted] - values[:wanted] * vectors[:, :wanted]
        size = np.linalg.norm(rest, axis=0)
        tight = width * np.finfo(float).eps * max(abs(values[0]), np.finfo(float).tiny)
        fine = size <= tight
        locked = wanted if fine.all() else int(np.argmin(fine))
        stuck = stuck + 1 if size.max() > best / 2 else 0
        best = min(best, size.max())
        # A basis of the whole space can grow no more: what is left is the rounding of the products.
        if locked == count or basis.shape[1] == width or (stuck >= 6 and best <= 100 * tight):
            return values[:count], vectors[:, :count], size
        theta, ritz, frozen = values[locked:wanted], vectors[:, locked:wanted], vectors[:, :locked]

        def project(x, ritz=ritz, frozen=frozen):
            x = x - frozen @ (frozen.T @ x)
            return x - ritz * (ritz * x).sum(axis=0)

        def correct(x, theta=theta, project=project):
            x = project(x)
            return project(apply(x) - theta * x)

        new = minres(correct, -project(rest[:, locked:]), inner, 1e-3)
        if basis.shape[1] + new.shape[1] > most_basis and basis.shape[1] > block:
            basis, image = vectors[:, :block], images[:, :block]
        new = orthonormal(basis, new)
        if not new.shape[1]:
            new = orthonormal(basis, np.random.default_rng(basis.shape[1]).standard_normal((width, 1)))
        basis, image = np.column_stack([basis, new]), np.column_stack([image, apply(new)])
    raise ArithmeticError(f"residuals of {best:g} after {most_rounds} rounds; {tight:g} is wanted")


def whole_vectors(vectors: DataFrame, scale: int, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, x): floor(scale * c) of each component of the vectors that take part."""
    scaled = F.transform(vector_column, lambda c: F.floor(c.cast("double") * F.lit(float(scale))))
    within = F.forall(vector_column, lambda c: F.abs(c.cast("double") * F.lit(float(scale))) < LARGEST)
    return vectors.filter(usable(F.col(vector_column)) & (F.size(vector_column) > 0)).filter(within).select(
        F.col(id_column).alias("vec_id"), scaled.alias("x"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.int64)


def deviations(x: np.ndarray, n: int, sums: list[int], largest: int) -> np.ndarray:
    """n * x - S, exactly: as longs where they fit, else as Python's whole numbers."""
    kind = np.int64 if 2 * n * max(largest, 1) < 2**62 else object
    return n * x.astype(kind) - np.array(sums, kind)


def summed(rows: DataFrame, work: Callable, cells: tuple[int, int], adders: int = 8) -> np.ndarray:
    """The sum of the matrices that ``work`` makes of the rows' batches: one a task, added by ``adders`` tasks."""

    def part(batches):
        total = np.zeros(cells)
        for batch in batches:
            total += work(batch)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["m"])

    def add(batches):
        total = np.zeros(cells)
        for batch in batches:
            for m in batch.column(0):
                total += np.frombuffer(m.as_py()).reshape(cells)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["m"])

    found = rows.mapInArrow(part, "m binary").repartition(adders).mapInArrow(add, "m binary").toLocalIterator()
    return sum((np.frombuffer(bytes(r["m"])).reshape(cells) for r in found), np.zeros(cells))


def whiten(vectors: DataFrame, components: int = 32, scale: int = 64, id_column: str = "vec_id",
           vector_column: str = "embedding", inner: int = 4) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each vector and component.

    A component c of a vector counts as x = floor(scale * c) plus any constant. Products with the
    covariance of x are one job over the written whole numbers: tasks centre their rows exactly
    (n * x - S in whole numbers), multiply them with a block of at most a few dozen columns, and send one small matrix
    each to a few adding tasks. The driver holds matrices of the vectors' width only, never rows, nor the covariance.

    Vectors that are null, or hold a null or non-finite component, or one whose x has over 52 bits, take no
    part; nor do empty ones. Vectors of another length are a list of their own, fitted by itself. Components are those with a variance beyond
    rounding, so equal vectors, or one alone, give no rows; there are at most as many as dimensions. Components of equal variance come in some order. Repeated rows and ids
    count each; a null id stays null. A deviation that does not fit a long is null. Other columns are not
    read. An empty table gives no rows.
    """
    rows = cut(whole_vectors(vectors, scale, id_column, vector_column))
    widths = [r["w"] for r in rows.select(F.size("x").alias("w")).groupBy("w").count().toLocalIterator()]
    found = None
    for width in sorted(widths):
        own = rows if len(widths) == 1 else rows.filter(F.size("x") == width)
        part = whiten_rows(own, width, components, inner)
        if part is not None:
            found = part if found is None else found.unionByName(part)
    if found is None:
        found = rows.sparkSession.createDataFrame([], answer_columns(rows))
    return found


def answer_columns(rows: DataFrame) -> str:
    kind = rows.schema["vec_id"].dataType.simpleString()
    return f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"


def exact_sums(rows: DataFrame, width: int) -> tuple[int, list[int], int]:
    """(n, S, largest): rows, sums of each dimension, and the largest absolute value, in whole numbers."""

    def part(batches):
        n, sums, largest = 0, [0] * width, 0
        for batch in batches:
            x = matrix(batch.column(0), width)
            n, largest = n + len(x), max(largest, int(np.abs(x).max(initial=0)))
            high, low = x >> 26, x & (2**26 - 1)
            sums = [s + (int(h) << 26) + int(l) for s, h, l in zip(sums, high.sum(axis=0), low.sum(axis=0))]
        parts = [*sums, n, largest]
        yield pa.RecordBatch.from_arrays([pa.array(range(width + 2), pa.int32()), pa.array([str(s) for s in parts])], ["d", "s"])

    number = F.col("s").cast("decimal(38,0)")
    found = rows.select("x").mapInArrow(part, "d int, s string").groupBy("d").agg(F.sum(number).alias("s"), F.max(number).alias("m"))
    whole = {r["d"]: r for r in found.toLocalIterator()}
    return int(whole[width]["s"]), [int(whole[d]["s"]) for d in range(width)], int(whole[width + 1]["m"])


def whiten_rows(rows: DataFrame, width: int, components: int, inner: int) -> DataFrame | None:
    n, sums, largest = exact_sums(rows, width)
    xs = rows.select("x")

    def centred(column: pa.Array) -> np.ndarray:
        return deviations(matrix(column, width), n, sums, largest).astype(float) / n

    def covariance_times(block: np.ndarray) -> np.ndarray:
        def work(batch):
            y = centred(batch.column(0))
            return y.T @ (y @ block)

        return summed(xs, work, block.shape) / n

    def spread(batch):
        y = centred(batch.column(0))
        return np.vstack([(y * y).sum(axis=0), y.sum(axis=0)])

    squares, means = summed(xs, spread, (2, width)) / n
    trace = float(squares.sum())
    if not trace > 0:
        return None
    values, axes, _ = jacobi_davidson(covariance_times, width, components, inner)
    keep = values > max(width, 16) * np.finfo(float).eps * values[0]
    values, axes = values[keep], axes[:, keep]
    # One sign for all: the largest entry of an axis is positive.
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    turn = axes / np.sqrt(values)
    middle = means @ turn

    def products(batch):
        w = centred(batch.column(0)) @ turn - middle
        return w.T @ w

    error = float(np.abs(summed(xs, products, (len(values),) * 2) / n - np.eye(len(values))).max())
    k, shares = len(values), values / trace

    def answer(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                piece = batch.slice(start, 1000)
                gap = deviations(matrix(piece.column(1), width), n, sums, largest)
                small = gap.dtype != object and width * (2 * n * max(largest, 1)) ** 2 < 2**63
                far = (gap if small else gap.astype(object)) ** 2
                far = [s if s < 2**63 else None for s in (int(v) for v in far.sum(axis=1))]
                m = len(far)
                yield pa.RecordBatch.from_arrays([
                    piece.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                    pa.array(np.full(m * k, n)), pa.array(far, pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(((gap.astype(float) / n) @ turn).ravel()), pa.array(np.tile(shares, m)), pa.array(np.full(m * k, error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(answer, answer_columns(rows))
