"""Abusive feedback comments: two class-conditional Kneser-Ney character models compared."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from radiolake.llm.common import in_portions
from radiolake.llm.points import normalised
from radiolake.session import cut_lineage

ORDER = 4
SHARED = 2
DISCOUNT = 0.75
#: bits of the context bucket by order; a context has 64 buckets for the next character
CONTEXT_BITS = {1: 0, 2: 10, 3: 14, 4: 16}
NEXT_BITS = 6
PORTION = 1 << 20
BINS = 1024
SPAN = 16.0


def _mix(h: np.ndarray) -> np.ndarray:
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _padded(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of the texts with single spaces between words, ``ORDER - 1`` spaces before each text; starts and sizes.

    Every text ends with a space, so the end of its last word counts; a text without a letter has size 0.
    """
    pad, parts, sizes = np.full(ORDER - 1, 32, np.uint32), [], []
    for t in texts:
        p = normalised(t, "isalpha")[0]
        parts += [pad, p, pad[:1]] if len(p) else [pad]
        sizes.append(len(p) + 1 if len(p) else 0)
    size = np.array(sizes, np.int64)
    starts = np.concatenate([[0], np.cumsum(size + ORDER - 1)[:-1]]).astype(np.int64)
    return np.concatenate([*parts, np.zeros(0, np.uint32)]).astype(np.uint64), starts, size


def _windows(points: np.ndarray) -> list[np.ndarray]:
    """The characters of the n-gram at each place, first to last, as shifted views."""
    n = max(len(points) - ORDER + 1, 0)
    return [points[k : k + n] for k in range(ORDER)]


def _cells(window: list[np.ndarray], order: int) -> np.ndarray:
    """Cell of the n-gram that ends the window: bucket of its context, then of its last character."""
    last = _mix(_mix(window[-1] + np.uint64(1))) >> np.uint64(64 - NEXT_BITS)
    bits = CONTEXT_BITS[order]
    if not bits:
        return last.astype(np.int64)
    h = np.full(len(last), order, np.uint64)
    for char in window[ORDER - order : -1]:
        h = _mix(h ^ (char + np.uint64(1)))
    return (((_mix(h) >> np.uint64(64 - bits)) << np.uint64(NEXT_BITS)) | last).astype(np.int64)


def _name(window: list[np.ndarray], order: int) -> np.ndarray:
    """64 bits that name the n-gram itself."""
    h = np.full(len(window[-1]), order, np.uint64)
    for char in window[ORDER - order :]:
        h = _mix(h ^ (char + np.uint64(1)))
    return _mix(h).view(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct n-grams of the highest order in a portion of the comments: names and cells of it and of its endings, counts by class."""
    names = [*(f"g{n}" for n in range(ORDER, 1, -1)), *(f"c{n}" for n in range(ORDER, 0, -1)), "n0", "n1"]
    rows = ((y, t) for b in batches for y, t in zip(b.column("abusive").to_pylist(), b.column("comment").to_pylist()))
    for part in in_portions(rows, 2 * PORTION):
        points, starts, size = _padded([t for _, t in part])
        if not size.sum():
            continue
        of = np.repeat(np.arange(len(part)), size)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + starts[of]  # place of an n-gram by its first character
        gram, first, inverse = np.unique(_name(_windows(points), ORDER)[at], return_index=True, return_inverse=True)
        y = np.array([y for y, _ in part], np.int8)[of]
        once = [points[at[first] + k] for k in range(ORDER)]
        columns = [gram, *(_name(once, n) for n in range(ORDER - 1, 1, -1)), *(_cells(once, n) for n in range(ORDER, 0, -1))]
        columns += [np.bincount(inverse[y == k], minlength=len(gram)) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


@dataclass(frozen=True)
class AbuseModel:
    """By order: discounted share of each cell and weight of the shorter n-gram for each context, by class; and the calibration.

    ``share[n]`` is cells x classes, ``rest[n]`` contexts x classes; ``slope`` and
    ``offset`` turn the normalised log ratio into a probability.
    """

    share: dict[int, np.ndarray]
    rest: dict[int, np.ndarray]
    slope: float
    offset: float


def _tables(rows: DataFrame) -> tuple[dict, dict]:
    """Kneser-Ney tables from labelled comments (abusive 0 or 1, comment).

    The highest order counts n-grams, each lower one the distinct n-grams that end
    in it; orders up to ``SHARED`` pool both classes.
    """
    names = ", ".join([*(f"g{n} long" for n in range(ORDER, 1, -1)), *(f"c{n} long" for n in range(ORDER, 0, -1)), "n0 long", "n1 long"])
    grams = rows.mapInArrow(_count, names)
    lower = [c for c in grams.columns if c not in (f"g{ORDER}", "n0", "n1")]
    level = cut_lineage(
        grams.groupBy(f"g{ORDER}").agg(*[F.first(c).alias(c) for c in lower], F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "ngrams"
    )
    counts = {}
    for n in range(ORDER, 0, -1):
        counts[n] = level.groupBy(F.col(f"c{n}").alias("cell")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum(F.lit(1)).alias("n"))
        if n > 1:
            key, carried = (f"g{n - 1}", [c for c in level.columns if c[0] in "gc" and c[1:].isdigit() and int(c[1:]) < n]) if n > 2 else ("c1", ["c1"])
            level = level.groupBy(key).agg(
                *[F.first(c).alias(c) for c in carried if c != key],
                F.sum((F.col("n0") > 0).cast("long")).alias("n0"), F.sum((F.col("n1") > 0).cast("long")).alias("n1"),
            )
    share, rest = {}, {}
    for n, df in counts.items():
        cells = np.zeros((1 << (CONTEXT_BITS[n] + NEXT_BITS), 2))
        got = df.select("cell", "n0", "n1").toArrow()
        cells[got["cell"].to_numpy()] = np.stack([got["n0"].to_numpy(), got["n1"].to_numpy()], axis=1)
        if n <= SHARED:
            cells[:] = cells.sum(axis=1, keepdims=True)
        rows_ = cells.reshape(-1, 1 << NEXT_BITS, 2)
        total, types = rows_.sum(axis=1), (rows_ > 0).sum(axis=1)
        known = np.maximum(total, 1)
        share[n] = (np.maximum(rows_ - DISCOUNT, 0) / known[:, None]).reshape(-1, 2).astype(np.float32)
        rest[n] = np.where(total > 0, DISCOUNT * types / known, 1).astype(np.float32)
    return share, rest


def log_ratio(share: dict, rest: dict, texts: list[str]) -> np.ndarray:
    """Log likelihood of each text as abusive less that as ordinary, over the root of its length; 0 without a letter.

    With the root, chance differences spread alike in short and long texts.
    """
    points, starts, size = _padded(texts)
    if not size.sum():
        return np.zeros(len(texts))
    window = _windows(points)
    p = np.full((len(window[0]), 1), 1 / (1 << NEXT_BITS), np.float32)
    for n in range(1, ORDER + 1):
        cell = _cells(window, n)
        kinds = slice(0, 1) if n <= SHARED else slice(0, 2)
        p = share[n][cell, kinds] + rest[n][cell >> NEXT_BITS, kinds] * p
    ratio = np.log(p[:, 1]) - np.log(p[:, 0])
    upto = np.concatenate([[0], np.cumsum(ratio, dtype=np.float64)])
    return (upto[starts + size] - upto[starts]) / np.sqrt(np.maximum(size, 1))


def _calibrate(bins: list, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of a logistic curve for counts (place, ordinary, abusive) in order of place.

    The curve passes a half where the fewest comments fall on the wrong side; its
    slope follows by Newton steps, with targets held off 0 and 1.
    """
    x, n0, n1 = (np.array(c, float) for c in zip(*bins)) if bins else (np.zeros(0),) * 3
    if not n0.sum() or not n1.sum():
        return 1.0, -2.0
    wrong = np.concatenate([[0], np.cumsum(n1)]) + n0.sum() - np.concatenate([[0], np.cumsum(n0)])  # if all below a place are ordinary
    best = np.flatnonzero(wrong == wrong.min())
    edges = np.concatenate([[x[0] - 1], (x[1:] + x[:-1]) / 2, [x[-1] + 1]])
    centre = edges[best[len(best) // 2]]
    high, low, slope = (n1.sum() + 1) / (n1.sum() + 2), 1 / (n0.sum() + 2), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(slope * (x - centre), -30, 30)))
        gradient = ((x - centre) * (n1 * high + n0 * low - (n0 + n1) * p)).sum() - 1e-2 * slope
        slope += gradient / (((x - centre) ** 2 * (n0 + n1) * np.maximum(p * (1 - p), 1e-6)).sum() + 1e-2)
        slope = float(np.clip(slope, 0.1, 20.0))
    return slope, -slope * float(centre)


def fit_abuse(feedback: DataFrame, feedback_id: str = "feedback_id", comment: str = "comment", abusive: str = "abusive") -> AbuseModel:
    """Model from feedback records whose ``abusive`` is 0 or 1; other rows, and rows without a comment, teach nothing.

    All labelled comments are used whole: four fifths (by a hash of the id) count
    n-grams, the rest place the logistic curve that turns log ratios into scores; what
    Spark shuffles are distinct n-grams per portion of text, so it grows with the
    input. The tables have a fixed number of cells (about 5.3 million at ``ORDER`` 4),
    which bounds what is broadcast. Without both classes the curve is a fixed one.
    """
    rows = feedback.select(
        feedback[abusive].cast("int").alias("abusive"), feedback[comment].cast("string").alias("comment"),
        (F.pmod(F.xxhash64(feedback[feedback_id].cast("string")), F.lit(5)) == 0).alias("apart"),
    ).where(F.col("abusive").isin(0, 1) & F.col("comment").isNotNull())
    rows = cut_lineage(rows, "labelled-comments")
    share, rest = _tables(rows.where(~F.col("apart")))
    scored = _ratios(rows.where("apart"), "abusive", "comment", share, rest)
    place = F.floor((F.least(F.greatest("ratio", F.lit(-SPAN)), F.lit(SPAN - 1e-6)) + SPAN) * (BINS / (2 * SPAN)))
    bins = scored.groupBy(place.alias("b")).agg(F.sum(1 - F.col("key")).alias("n0"), F.sum("key").alias("n1")).orderBy("b").collect()
    slope, offset = _calibrate([((r.b + 0.5) * 2 * SPAN / BINS - SPAN, r.n0, r.n1) for r in bins])
    return AbuseModel(share, rest, slope, offset)


def _ratios(df: DataFrame, key: str, comment: str, share: dict, rest: dict) -> DataFrame:
    """(key, ratio) of every row."""
    shared = df.sparkSession.sparkContext.broadcast((share, rest))
    rows = df.select(df[key].alias("key"), F.coalesce(df[comment].cast("string"), F.lit("")).alias("comment"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.zeros(0)]
            for part in in_portions(((None, t) for t in batch.column("comment").to_pylist()), PORTION):
                out.append(log_ratio(*shared.value, [t for _, t in part]))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(np.concatenate(out))], ["key", "ratio"])

    return rows.mapInArrow(run, rows.select("key", F.lit(0.0).alias("ratio")).schema)


def score_comments(feedback: DataFrame, model: AbuseModel, feedback_id: str = "feedback_id", comment: str = "comment") -> DataFrame:
    """How likely each feedback comment is abusive, from the whole comment alone: feedback_id, score, predicted.

    ``score`` is in 0 to 1, ``predicted`` is 1 from a half on. Null comments and
    comments without a letter compare as equal likelihoods, so their score is that of no
    evidence. Rows repeated come back as often; no rows in, no rows out; other columns are ignored.
    """
    ratios = _ratios(feedback, feedback_id, comment, model.share, model.rest)
    score = 1 / (1 + F.exp(-(F.col("ratio") * F.lit(model.slope) + F.lit(model.offset))))
    out = ratios.select(F.col("key").alias("feedback_id"), score.alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
