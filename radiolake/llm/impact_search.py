"""Exact nearest knowledge chunks over an impact-ordered index, searched score at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 8192
ASKED = 512
LEVELS = 16
#: levels after which the proof is tried; the levels up to a try are added in one product, and a try costs about as much
TRIES = (4, 1)
FEW = 32


def impacts(vectors: DataFrame, chunk_id: str = "chunk_id", embedding: str = "embedding", scale: float = 256.0) -> DataFrame:
    """chunk_id and the vector as whole numbers, floor(scale * x) with x as double.

    Vectors that are null or hold a null, NaN or infinity are left out, as are rows
    without an id. Of rows that share an id the largest vector stays.
    """
    x = vectors[embedding].cast("array<double>")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = vectors.where(vectors[chunk_id].isNotNull() & x.isNotNull() & sound)
    whole = F.transform(rows[embedding].cast("array<double>"), lambda v: F.floor(v * F.lit(scale)).cast("long"))
    return rows.select(rows[chunk_id].alias("chunk_id"), whole.alias("v")).groupBy("chunk_id").agg(F.max("v").alias("v"))


class Index:
    """Impacts of one block of vectors by level: for each impact level its middle impact and, for each vector and dimension, the sign where the impact is of that level.

    ``residual[l]`` is, for each vector, the length of what is not yet known after the
    levels above ``l`` have been added at their middle impact.
    """

    def __init__(self, x: np.ndarray):
        self.x = x
        size = np.abs(x).astype(np.float64)
        self.step = max(float(size.max(initial=0)) / LEVELS, 1e-9)
        level = np.minimum(np.ceil(size / self.step), LEVELS).astype(np.int8)
        sign = np.sign(x).astype(np.int8)
        self.segments: list[list[tuple[float, np.ndarray]]] = [
            [((l - 0.5) * self.step, np.where(level == l, sign, 0).astype(np.int8))] for l in range(LEVELS, 0, -1)
        ]
        known = sign * (level - 0.5) * self.step
        self.residual = {l: np.sqrt((np.where(level > l, x - known, x).astype(np.float64) ** 2).sum(axis=1)) for l in (*TRIES, 0)}


def search(index: Index, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(query number, ids, scores): for each query the ``k`` best vectors of the block, ties to the smaller id.

    Segments are added by descending impact for all open queries. The length of a
    vector's unknown part times that of the query bounds what is missing from its score; a query ends
    when no more than ``FEW`` vectors can be among its best, or after the last level, and
    those that can be are scored exactly.
    """
    q = queries.astype(np.float64)
    norm = np.sqrt((q**2).sum(axis=1))
    own = query_ids[:, None] == ids[None, :]
    score, added = np.zeros((len(q), len(ids))), np.zeros(index.x.shape)
    open_, out = np.arange(len(q)), []
    for l, segments in zip(range(LEVELS - 1, -1, -1), index.segments):
        for impact, sign in segments:
            added += impact * sign
        if l and l not in TRIES:
            continue
        score += q[open_] @ added.T
        added[:] = 0
        slack = norm[open_][:, None] * index.residual[l] * (1 + 1e-9) + 1e-6
        low = np.where(own[open_], -np.inf, score - slack)
        least = np.partition(low, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(open_), -np.inf)
        possible = (score + slack >= least[:, None]) & ~own[open_]
        done = possible.sum(axis=1) <= (FEW if l else len(ids))
        for j in np.flatnonzero(done).tolist():
            at = np.flatnonzero(possible[j])
            exact = index.x[at] @ queries[open_[j]]
            best = np.lexsort((ids[at], -exact))[:k]
            out.append((int(open_[j]), ids[at][best], exact[best]))
        score, open_ = score[~done], open_[~done]
        if not len(open_):
            break
    return out


def _matrix(table: pa.Table, width: int) -> np.ndarray:
    """The vectors as rows; shorter ones are filled up with zeros."""
    lists = table["v"].combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy()
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def top_chunks(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` knowledge chunks with the highest inner product for each query chunk, by exact whole numbers.

    ``vectors`` and ``queries`` come from ``impacts``. A query's own id is no
    candidate; equal scores go to the smaller id; with fewer than ``k`` candidates all
    are given. Missing trailing components count as zero. Returns query_id, rank, chunk_id, score.
    Empty tables give no rows.

    Vectors are dealt into blocks of about ``BLOCK`` and queries into blocks of
    about ``ASKED`` by a hash of the id, so a task holds one block of either
    whatever the input; a block answers with ``k`` rows a query.
    """
    blocks, asked = (max(1, -(-df.count() // size)) for df, size in ((vectors, BLOCK), (queries, ASKED)))
    c = vectors.select(
        "chunk_id", "v", F.pmod(F.xxhash64("chunk_id"), F.lit(blocks)).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(asked - 1))).alias("a")
    )
    q = queries.select(
        "chunk_id", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("b"),
        F.pmod(F.xxhash64("chunk_id"), F.lit(asked)).cast("int").alias("a"),
    )

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "chunk_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64())] * 3, names)
        width = max(int(np.diff(t["v"].combine_chunks().offsets.to_numpy()).max()) for t in (left, right))
        ids, query_ids = right["chunk_id"].to_numpy(), left["chunk_id"].to_numpy()
        found = search(Index(_matrix(right, width)), ids, _matrix(left, width), query_ids, k)
        return pa.table(
            [np.concatenate([np.full(len(i), query_ids[n]) for n, i, _ in found]), np.concatenate([i for _, i, _ in found]),
             np.concatenate([s for _, _, s in found])], names,
        )

    found = q.groupBy("b", "a").cogroup(c.groupBy("b", "a")).applyInArrow(run, "query_id long, chunk_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "score")
