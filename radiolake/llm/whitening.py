"""Whitening of chunk embeddings: centred covariance in tasks, leading eigenpairs of one small matrix, projection in tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from radiolake.llm.common import free_name
from radiolake.session import cut_lineage

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
MOST_DIMENSIONS = 4096
FARTHEST = 1 << 31  # of floor(scale * c), so that products with the count stay in 64 bits
EPS = np.finfo(float).eps


# ---------------------------------------------------------------- a symmetric matrix

def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and Householder vectors with ``matrix = Q T Q'``; vector k mirrors rows k + 1 onward."""
    a, mirrors = np.array(matrix, float), []
    n = len(a)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        norm = np.linalg.norm(x)
        norm = norm if x[0] >= 0 else -norm
        v = x.copy()
        v[0] += norm
        size = np.linalg.norm(v)
        if size == 0 or norm == x[0]:
            mirrors.append(np.zeros_like(v))
            continue
        v /= size
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        q = p - (v @ p) * v
        rest -= 2 * (np.outer(v, q) + np.outer(q, v))
        a[k + 1 :, k] = a[k, k + 1 :] = 0
        a[k + 1, k] = a[k, k + 1] = -norm
        a[k + 1 :, k + 1 :] = (rest + rest.T) / 2
        mirrors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), mirrors


def below(diag: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sturm count: for every value, how many eigenvalues of the tridiagonal matrix are less than it."""
    tiny = np.finfo(float).tiny / EPS * max(1.0, float(np.max(off * off, initial=0.0)))
    count, q = np.zeros(len(at), int), np.ones(len(at))
    for i in range(len(diag)):
        q = diag[i] - at - ((off[i - 1] ** 2) / q if i else 0.0)
        q = np.where(np.abs(q) < tiny, -tiny, q)
        count += q < 0
    return count


def leading_values(diag: np.ndarray, off: np.ndarray, wanted: int) -> np.ndarray:
    """The ``wanted`` largest eigenvalues, falling, each cut down by halves until its bounds are neighbouring doubles."""
    n = len(diag)
    reach = np.abs(np.concatenate([off, [0.0]])) + np.abs(np.concatenate([[0.0], off]))
    lo, hi = np.full(wanted, np.min(diag - reach)), np.full(wanted, np.max(diag + reach))
    lo, hi = lo - EPS * np.abs(lo) - np.finfo(float).tiny, hi + EPS * np.abs(hi) + np.finfo(float).tiny
    place = n - 1 - np.arange(wanted)  # eigenvalues below the wanted one
    for _ in range(2200):  # far more than the halves between any two doubles of one size
        mid = lo + (hi - lo) / 2
        if ((mid <= lo) | (mid >= hi)).all():
            break
        many = below(diag, off, mid) > place
        hi, lo = np.where(many, mid, hi), np.where(many, lo, mid)
    return lo + (hi - lo) / 2


def _solve(diag: np.ndarray, off: np.ndarray, shift: float, b: np.ndarray, floor: float) -> np.ndarray:
    """(T - shift) x = b by elimination with row exchanges; a pivot of zero is taken as ``floor``."""
    n = len(diag)
    d, x = diag - shift, b.copy()
    up, up2, low = np.concatenate([off, [0.0]]), np.zeros(n), off.copy()
    for i in range(n - 1):
        if abs(low[i]) > abs(d[i]):  # the next row comes first
            d[i], low_i = low[i], d[i]
            up[i], d[i + 1] = d[i + 1], up[i]
            up2[i], up[i + 1] = (up[i + 1], 0.0) if i + 1 < n - 1 else (0.0, up[i + 1])
            x[i], x[i + 1] = x[i + 1], x[i]
        else:
            low_i = low[i]
        if abs(d[i]) < floor:
            d[i] = floor
        m = low_i / d[i]
        d[i + 1] -= m * up[i]
        if i + 1 < n - 1:
            up[i + 1] -= m * up2[i]
        x[i + 1] -= m * x[i]
    if abs(d[-1]) < floor:
        d[-1] = floor
    for i in range(n - 1, -1, -1):
        x[i] = (x[i] - (up[i] * x[i + 1] if i + 1 < n else 0.0) - (up2[i] * x[i + 2] if i + 2 < n else 0.0)) / d[i]
        if abs(x[i]) > 1e150:
            x /= 1e150
    return x


def leading_pairs(matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors as columns.

    Householder mirrors make the matrix tridiagonal, Sturm counts bisect its eigenvalues, inverse iteration gives its vectors.
    Vectors whose values lie within a thousandth of the norm form a cluster and are kept at right angles
    to those before them in every step.
    """
    n = len(matrix)
    wanted = min(wanted, n)
    norm = float(np.max(np.abs(matrix), initial=0.0))
    if not norm:
        return np.zeros(wanted), np.eye(n)[:, :wanted]
    diag, off, mirrors = tridiagonal(matrix / norm)
    values = leading_values(diag, off, wanted)
    size = float(np.max(np.abs(diag)) + 2 * np.max(np.abs(off), initial=0.0))
    rng, found, cluster = np.random.default_rng(7), np.zeros((n, wanted)), 0
    for k in range(wanted):
        if k and values[k - 1] - values[k] > 1e-3 * size:
            cluster = k
        shift = values[k] if k == cluster else min(values[k], values[k - 1] - (k - cluster) * EPS * size)
        x = rng.standard_normal(n)
        for _ in range(6):
            x = _solve(diag, off, shift, x / np.linalg.norm(x), EPS * size)
            for _ in range(2):
                x -= found[:, cluster:k] @ (found[:, cluster:k].T @ x)
            if not np.linalg.norm(x):
                x = rng.standard_normal(n)
        found[:, k] = x / np.linalg.norm(x)
    for k in range(len(mirrors) - 1, -1, -1):
        v = mirrors[k]
        found[k + 1 :] -= 2 * np.outer(v, v @ found[k + 1 :])
    return values * norm, found


# ---------------------------------------------------------------- vectors of a table

def _whole(vector: Column, scale: int, shift: int) -> Column:
    """A vector in whole numbers: floor(scale * c) + shift."""
    return F.transform(vector.cast("array<double>"), lambda c: (F.floor(c * scale) + shift).cast("long"))


def whole_vectors(chunks: DataFrame, vector: str, scale: int = SCALE, shift: int = SHIFT) -> Column:
    """The vector in whole numbers; null if it is null or holds a null, a NaN, an infinity or a number too far out."""
    c = chunks[vector].cast("array<double>")
    good = F.forall(c, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) * scale < float(FARTHEST)), F.lit(False)))
    return F.when(good, _whole(c, scale, shift))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int, empty: int) -> np.ndarray:
    """Lists as rows of whole numbers, shorter ones filled with zero components."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.full((len(sizes), width), empty, np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def _sums_of(width: int, shift: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for batch in batches:
            total += (_matrix(batch.column("x"), width, shift) - shift).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(total)], ["i", "total"])

    return run


def _centred(x: np.ndarray, n: int, sums: np.ndarray, shift: int) -> np.ndarray:
    """n * x - S in whole numbers, from numbers less the shift, which keeps them small."""
    return n * (x - shift) - sums


def _products_of(at, width: int, shift: int):
    """Per task the sums of products of the centred vectors: upper triangle, row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = at.value
        total = np.zeros((width, width))
        for batch in batches:
            y = _centred(_matrix(batch.column("x"), width, shift), n, sums, shift) / n
            total += y.T @ y
        rows = np.arange(width)
        for i in rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(width - i, i, np.int32)), pa.array(rows[i:].astype(np.int32)), pa.array(total[i, i:])], ["i", "j", "total"])

    return run


def _spread_of(at, basis, width: int, shift: int):
    """Per task the count, sums and products of the whitened fit vectors, for their covariance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = at.value
        turn = basis.value
        k = turn.shape[1]
        total, product = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            z = _centred(_matrix(batch.column("x"), width, shift), n, sums, shift) / n @ turn
            total += z.sum(axis=0)
            product += z.T @ z
        i, j = np.divmod(np.arange(k * k), k)
        i, j = np.concatenate([i, np.full(k, -1)]), np.concatenate([j, np.arange(k)])
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(np.concatenate([product.ravel(), total]))], ["i", "j", "total"])

    return run


def _whitened_of(at, basis, width: int, shift: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = at.value
        turn = basis.value
        k = turn.shape[1]
        for batch in batches:
            d = _centred(_matrix(batch.column("x"), width, shift), n, sums, shift)
            z = d / n @ turn
            far = float(np.max(np.abs(d), initial=0))
            if far * far * max(width, 1) < 2**62:
                deviation = pa.array((d * d).sum(axis=1))
            else:  # beyond a long a deviation is null
                exact = [sum(int(v) ** 2 for v in row) for row in d]
                deviation = pa.array([v if v < 2**63 else None for v in exact], pa.int64())
            rows = np.repeat(np.arange(len(d)), k)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(d))), deviation.take(pa.array(rows)), pa.array(z.ravel())],
                ["id", "component", "deviation", "whitened"],
            )

    return run


def whiten_chunks(
    chunks: DataFrame, chunk_id: str = "chunk_id", embedding: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT,
) -> DataFrame:
    """Chunk embeddings on their leading principal components, each scaled to unit variance.

    A component c counts as ``x = floor(scale * c) + shift``. Each distinct x vector is taken once: n vectors with
    sums S. Eigenpairs are those of their covariance (divisor n), numbered from 1 by falling eigenvalue e.

    Returns, per chunk and component, chunk_id, component, n, deviation (sum of (n * x - S)**2, exact; null beyond a long),
    whitened ((x - S / n) on the component, over sqrt(e)), explained (e over the sum of all eigenvalues) and
    identity_error (largest entry by which the whitened fit vectors' covariance differs from the identity).

    Chunks whose embedding is null or holds a null, a NaN, an infinity or a number of ``FARTHEST / scale`` or more are left out. Shorter vectors are
    filled with zero components to the longest. Directions without variance (e below rounding) are no components,
    so equal vectors alone give no rows, and neither does an empty table. Repeated rows come back as
    often; null ids stay; other columns are ignored. More than ``MOST_DIMENSIONS`` dimensions are an error, because the
    covariance, dimensions squared and nothing else, is what the driver solves and the tasks receive.

    Vectors are centred, in whole numbers, before they are multiplied. A task sends on its sums, never rows;
    copies meet in the distinct step, combined on the map side.
    """
    spark = chunks.sparkSession
    name = free_name(chunks, "x")
    held = chunks.withColumn(name, whole_vectors(chunks, embedding, scale, shift)).where(F.col(name).isNotNull())
    rows = held.select(held[chunk_id].alias("id"), F.col(name).alias("x"))
    fit = cut_lineage(rows.select("x").distinct(), "whitening-vectors")
    width, n = fit.agg(F.max(F.size("x")), F.count(F.lit(1))).first()
    kind = rows.select("id", F.lit(0).alias("component"), F.lit(0).cast("long").alias("deviation"), F.lit(0.0).alias("whitened")).schema
    width = width or 0
    if width > MOST_DIMENSIONS:
        raise ValueError(f"more than {MOST_DIMENSIONS} dimensions")
    values, vectors, trace = np.zeros(0), np.zeros((width, 0)), 0.0
    sums = np.zeros(width, np.int64)
    if n > 1 and width:
        if len(fit.where(F.size("x") < width).limit(1).take(1)):  # filled vectors may be equal now
            filled = F.concat("x", F.array_repeat(F.lit(shift).cast("long"), F.lit(width) - F.size("x")))
            fit = cut_lineage(fit.select(filled.alias("x")).distinct(), "whitening-vectors")
            n = fit.count()
        found = fit.mapInArrow(_sums_of(width, shift), "i int, total long").groupBy("i").agg(F.sum("total").alias("total")).toArrow()
        sums[found.column("i").to_numpy()] = found.column("total").to_numpy()
        at = spark.sparkContext.broadcast((n, sums))
        found = fit.mapInArrow(_products_of(at, width, shift), "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).toArrow()
        i, j = found.column("i").to_numpy(), found.column("j").to_numpy()
        covariance = np.zeros((width, width))
        covariance[i, j] = covariance[j, i] = found.column("total").to_numpy() / n
        trace = float(np.trace(covariance))
        values, vectors = leading_pairs(covariance, components)
        varied = values > width * EPS * max(float(values[0]), 0.0)
        values, vectors = values[varied], vectors[:, varied]
    if not len(values):
        none = spark.createDataFrame([], kind)
        return none.select(F.col("id").alias(chunk_id), "component", F.lit(0).cast("long").alias("n"), "deviation", "whitened", F.lit(0.0).alias("explained"), F.lit(0.0).alias("identity_error"))
    basis = spark.sparkContext.broadcast(vectors / np.sqrt(values))
    found = fit.mapInArrow(_spread_of(at, basis, width, shift), "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).toArrow()
    i, j, total = (found.column(c).to_numpy() for c in ("i", "j", "total"))
    k = len(values)
    product, mean = np.zeros((k, k)), np.zeros(k)
    product[i[i >= 0], j[i >= 0]] = total[i >= 0] / n
    mean[j[i < 0]] = total[i < 0] / n
    error = float(np.max(np.abs(product - np.outer(mean, mean) - np.eye(k))))
    share = F.get(F.array(*[F.lit(float(v / trace)) for v in values]), F.col("component") - 1)
    out = rows.mapInArrow(_whitened_of(at, basis, width, shift), kind)
    return out.select(F.col("id").alias(chunk_id), "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))
