"""Series dealt once and packed slice by slice, so that many ordered computations share one reading of the rows.

``packed`` sorts the rows of all series by ranges of (keys, time, seq) and turns every stretch of a series
that an Arrow batch holds into one row: its columns as arrays, and a summary that can be merged (moments, extremes, regression
sums, first and last rows, leading digits of the values). A slice is at most a batch (``spark.sql.execution.arrow.maxRecordsPerBatch``
rows), whatever the keys and times look like: slices follow the number of rows. Means, trends and peers need the
summaries only; ordered passes read the arrays with what earlier slices hand on.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from radiolake.functions.ordered import DIGIT, KEY, SLICE
from radiolake.session import cut_lineage

TAIL = 8  # values at the end of a slice that its summary keeps
HOUR_US, ORIGIN_US = 3_600_000_000, 1_577_836_800_000_000

SUMMARY = {
    # all readings
    "n": "int", "mean": "double", "m2": "double", "lo": "double", "hi": "double",
    "first_seq": "bigint", "first_name": "string", "last_seq": "bigint", "last_value": "double", "end_value": "double",
    # readings with a time
    "tn": "int", "tmean": "double", "tm2": "double", "tfirst_ts": "bigint", "tfirst_name": "string", "tlast_seq": "bigint", "tlast_value": "double",
    "xmean": "double", "xx": "double", "xy": "double", "xlo": "double", "xhi": "double",
    # the end of the slice, with and without readings that have no time
    "tail": "array<double>", "ttail": "array<double>",
    "digits": "array<int>", "digit_counts": "array<int>",
    "kind": "string", "kind_seq": "bigint",
}
SUMMARY_COLUMNS = list(SUMMARY)


def order_bits_of(value: np.ndarray) -> np.ndarray:
    """``ordered.order_bits`` in numpy."""
    bits = (value + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64((1 << 63) - 1), bits)


def _moments(v: np.ndarray) -> tuple[float | None, float | None]:
    if not len(v):
        return None, None
    mean = v.mean()
    return float(mean), float(((v - mean) ** 2).sum())


def _summary(ts, timed, seq, value, names, kinds, kind_seqs) -> dict:
    """Summary of one slice; ``kinds`` are of all its rows, the rest of its rows with a reading."""
    out: dict = dict.fromkeys(SUMMARY_COLUMNS)
    n = len(value)
    out["n"], out["tail"], out["digits"], out["digit_counts"] = n, value[-TAIL:], [], []
    t = value[timed]
    out["tn"], out["ttail"] = len(t), t[-TAIL:]
    if len(kinds):
        k = min(range(len(kinds)), key=lambda i: (kind_seqs[i], kinds[i]))
        out["kind"], out["kind_seq"] = kinds[k], kind_seqs[k]
    if not n:
        return out
    out["mean"], out["m2"] = _moments(value)
    out["lo"], out["hi"] = float(value.min()), float(value.max())
    first, last = int(seq.argmin()), n - 1 - int(seq[::-1].argmax())
    out["first_seq"], out["last_seq"], out["last_value"], out["end_value"] = int(seq[first]), int(seq[last]), float(value[last]), float(value[-1])
    digits, counts = np.unique(order_bits_of(value) >> (64 - DIGIT), return_counts=True)
    out["digits"], out["digit_counts"] = digits.astype(np.int32), counts.astype(np.int32)
    if names is not None:
        same = np.flatnonzero(seq == seq[first])
        out["first_name"] = min((names[i] for i in same if names[i] is not None), default=None)
    if len(t):
        at, places = ts[timed], np.flatnonzero(timed)
        x = (at - ORIGIN_US) / HOUR_US
        out["tmean"], out["tm2"] = _moments(t)
        out["xmean"], out["xx"] = _moments(x)
        out["xy"] = float(((x - out["xmean"]) * (t - out["tmean"])).sum())
        out["xlo"], out["xhi"], out["tfirst_ts"] = float(x[0]), float(x[-1]), int(at[0])
        s = seq[timed]
        late = len(s) - 1 - int(s[::-1].argmax())
        out["tlast_seq"], out["tlast_value"] = int(s[late]), float(t[late])
        if names is not None:
            out["tfirst_name"] = names[int(places[0])]
    return out


def _changes(key: pa.Array) -> np.ndarray:
    """Places where a struct of keys differs from the row before, null as a value of its own."""
    differ = np.zeros(max(len(key) - 1, 0), bool)
    for field in key.flatten():
        a, b = field[:-1], field[1:]
        unlike = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        differ |= unlike | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
    return np.flatnonzero(differ) + 1


def _pack(names: bool, kinds: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slice_no = TaskContext.get().partitionId() << 32
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(KEY)
            starts = np.concatenate([[0], _changes(key)]).astype(np.int64)
            ends = np.append(starts[1:], batch.num_rows)
            value = batch.column("value").to_numpy(zero_copy_only=False).astype(float)
            keep = ~np.isnan(value)
            before = np.concatenate([[0], np.cumsum(keep)])
            kept = batch.filter(pa.array(keep))
            known_value = value[keep]
            ts = pc.fill_null(kept.column("ts"), 0).to_numpy()
            timed = kept.column("ts").is_valid().to_numpy(zero_copy_only=False)
            seq = pc.fill_null(kept.column("seq"), -(1 << 62)).to_numpy()
            name = kept.column("name").to_pylist() if names else None
            kind = batch.column("kind").to_pylist() if kinds else None
            kind_seq = pc.fill_null(batch.column("seq"), -(1 << 62)).to_pylist() if kinds else None
            summaries = []
            for a, b in zip(starts, ends):
                i, j = before[a], before[b]
                known = [k for k in range(a, b) if kind[k] is not None] if kinds else []
                summaries.append(_summary(
                    ts[i:j], timed[i:j], seq[i:j], known_value[i:j], name[i:j] if names else None,
                    [kind[k] for k in known], [kind_seq[k] for k in known],
                ))
            offsets = pa.array(np.append(before[starts], before[ends[-1]]).astype(np.int32))
            columns = [key.take(pa.array(starts)), pa.array(slice_no + np.arange(len(starts)))]
            slice_no += len(starts)
            labels = [KEY, SLICE]
            for c in ["ts", "seq", "value", *(["name"] if names else [])]:
                columns.append(pa.ListArray.from_arrays(offsets, kept.column(c)))
                labels.append(f"{c}s")
            columns.append(pa.StructArray.from_arrays(
                [pa.array([s[f] for s in summaries], ARROW[kind_of]) for f, kind_of in SUMMARY.items()], names=SUMMARY_COLUMNS
            ))
            yield pa.RecordBatch.from_arrays(columns, [*labels, "summary"])

    return run


ARROW = {
    "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "array<double>": pa.list_(pa.float64()), "array<int>": pa.list_(pa.int32()),
}


def packed(
    df: DataFrame, keys: Sequence[str], label: str, ts: str = "ts", seq: str = "seq", value: str = "value", name: str | None = None,
    kind: Column | None = None,
) -> DataFrame:
    """One row per slice: KEY (struct of the keys), SLICE (rising along a series), arrays tss (micros), seqs, values, names, and the summary.

    Rows are in the order of (ts, seq), those without a time first, those without a reading (null or NaN) left out of arrays and
    moments. ``name`` is a text column to carry along; of ``kind`` the first known one by seq is kept, over all rows.
    Rows without a key are a series of their own. Written to the shared folder, so later passes agree on the slices.
    """
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    rows = df.select(
        key.alias(KEY), F.unix_micros(ts).alias("ts"), F.col(seq).cast("bigint").alias("seq"), F.col(value).cast("double").alias("value"),
        *([F.col(name).alias("name")] if name else []), *([kind.alias("kind")] if kind is not None else []),
    )
    at = [F.col(KEY), F.col("ts").asc_nulls_first(), F.col("seq").asc_nulls_first()]
    dealt = rows.repartitionByRange(*at).sortWithinPartitions(*at)
    names = ", names array<string>" if name else ""
    summary = ", ".join(f"{n}: {t}" for n, t in SUMMARY.items())
    schema = f"{KEY} {rows.schema[KEY].dataType.simpleString()}, {SLICE} bigint, tss array<bigint>, seqs array<bigint>, values array<double>{names}, summary struct<{summary}>"
    return cut_lineage(dealt.mapInArrow(_pack(bool(name), kind is not None), schema), label)


def summaries(slices: DataFrame) -> DataFrame:
    """The summaries alone, a column each."""
    return slices.select(KEY, SLICE, "summary.*")


def merged(parts: DataFrame, by: Sequence[Column] | None = None) -> DataFrame:
    """Count, mean and squared deviation of the readings, all and with a time, and regression on hours, per group of slices.

    Slices are merged by the parallel rule in two aggregations, both combined on the map side: first the means, then
    the deviations around them.
    """
    group = [c.alias(f"_g{i}") for i, c in enumerate(by if by is not None else [F.col(KEY)])]
    at = [f"_g{i}" for i in range(len(group))]
    rows = parts.select(*group, "n", "mean", "m2", "tn", "tmean", "tm2", "xmean", "xx", "xy", "xlo", "xhi").where(F.col("n") > 0)
    weighted = lambda m, n: F.sum(F.col(m) * F.col(n)) / F.nullif(F.sum(n), F.lit(0))
    means = rows.groupBy(*at).agg(
        F.sum("n").alias("N"), weighted("mean", "n").alias("mu"), F.sum("tn").alias("TN"), weighted("tmean", "tn").alias("tmu"),
        weighted("xmean", "tn").alias("xmu"), F.min("xlo").alias("x0"), F.max("xhi").alias("x1"),
    )
    met = rows.join(means.select(*[F.col(c).alias(f"_{c}") for c in at], "mu", "tmu", "xmu"), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in at])
    dx, dy = F.col("xmean") - F.col("xmu"), F.col("tmean") - F.col("tmu")
    spread = met.groupBy(*at).agg(
        F.sum(F.col("m2") + F.col("n") * F.pow(F.col("mean") - F.col("mu"), F.lit(2))).alias("M2"),
        F.sum(F.col("tm2") + F.col("tn") * dy * dy).alias("TM2"),
        F.sum(F.col("xx") + F.col("tn") * dx * dx).alias("XX"),
        F.sum(F.col("xy") + F.col("tn") * dx * dy).alias("XY"),
    )
    both = means.join(spread.select(*[F.col(c).alias(f"_{c}") for c in at], "M2", "TM2", "XX", "XY"), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in at])
    return both.drop(*[f"_{c}" for c in at])


def slope() -> Column:
    """Least-squares slope per hour from merged sums; null where all times are equal."""
    return F.col("XY") / F.nullif(F.col("XX"), F.lit(0.0))


def tails_before(parts: DataFrame, tail: str, rows: int) -> DataFrame:
    """KEY, SLICE and ``halo``: the last ``rows`` readings of the series before the slice, across short slices."""
    if rows > TAIL:
        raise ValueError(f"a slice keeps {TAIL} readings for the next")
    w = Window.partitionBy(KEY).orderBy(SLICE).rowsBetween(-rows, -1)
    filled = parts.where(F.size(tail) > 0)
    joined = F.flatten(F.collect_list(tail).over(w))
    return filled.select(KEY, SLICE, F.slice(joined, F.greatest(F.size(joined) - rows + 1, F.lit(1)), F.lit(rows)).alias("halo"))


def digit_counts(parts: DataFrame, key: Column) -> DataFrame:
    """(KEY, _next, _c) for ``ordered.percentiles_of_digits``: how many readings of a group have each leading digit."""
    each = parts.select(key.alias(KEY), F.explode(F.arrays_zip("digits", "digit_counts")).alias("d"))
    return each.groupBy(KEY, F.col("d.digits").cast("bigint").alias("_next")).agg(F.sum("d.digit_counts").cast("bigint").alias("_c"))


def bits_within(value: np.ndarray, prefixes: Sequence[int] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leading digit, order bits and count of the distinct values that have one of the digits."""
    bits = order_bits_of(value)
    digit = bits >> (64 - DIGIT)
    bits, counts = np.unique(bits[np.isin(digit, np.array(prefixes or [], np.int64))], return_counts=True)
    return bits >> (64 - DIGIT), bits, counts.astype(np.int64)


def lagged_band(value: np.ndarray, halo: np.ndarray, window: int, lag: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, mean and sample deviation over the ``window`` readings up to ``lag`` rows before each."""
    line = np.concatenate([np.full(window + lag, np.nan), halo[len(halo) - min(len(halo), window + lag):] if len(halo) else halo, value])
    start = len(line) - len(value) - lag - window + 1
    frames = np.lib.stride_tricks.sliding_window_view(line, window)[start : start + len(value)]
    there = ~np.isnan(frames)
    count, upto = there.sum(axis=1), np.maximum(np.cumsum(there, axis=1), 1)
    total, mean, m2 = (np.zeros(len(frames)) for _ in range(3))
    for i in range(window):  # one reading of every frame at a time, so equal readings have no spread at all
        x, known = frames[:, i], there[:, i]
        step = np.where(known, x - mean, 0.0)
        total += np.where(known, x, 0.0)
        mean += step / upto[:, i]
        m2 += step * np.where(known, x - mean, 0.0)
    return count, total / np.maximum(count, 1), np.sqrt(m2 / np.maximum(count - 1, 1))


def climbs(value: np.ndarray, mu: float, sigma: float, slack: float, start: tuple[float, float] = (0.0, 0.0)) -> tuple[np.ndarray, ...]:
    """Two-sided cumulative sums S+ and S- along a slice from given starts, and both running totals."""
    z = (value - mu) / sigma
    out = []
    for side, s in ((z, start[0]), (-z, start[1])):
        total = np.cumsum(side - slack)
        out.append((np.maximum(s + total, total - np.minimum(0.0, np.minimum.accumulate(total))), total))
    return out[0][0], out[1][0], out[0][1], out[1][1]


def climb_starts(totals: DataFrame, *more: str) -> DataFrame:
    """Where S+ and S- stand when a slice begins, from each slice's totals and ends: (KEY, SLICE, *more, up_from, down_from).

    With W the total of a slice and E where its path from zero ends, the path ends at max(start + W, E); carried over all slices before,
    start = C - min(0, min(C_j - E_j)), with C the sum of totals. A window over slices, one row per slice.
    """
    w = Window.partitionBy(KEY).orderBy(SLICE)
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    sums = totals.withColumns({"_cu": F.sum("up_total").over(upto), "_cd": F.sum("down_total").over(upto)})
    start = lambda c, total, end: F.col(c) - F.col(total) - F.least(F.lit(0.0), F.coalesce(F.min(F.col(c) - F.col(end)).over(before), F.lit(0.0)))
    return sums.select(KEY, SLICE, *more, start("_cu", "up_total", "up_end").alias("up_from"), start("_cd", "down_total", "down_end").alias("down_from"))


def values_of_digits(group: str):
    """Arrow pass over (group, values, digits): group, _prefix, _bits and _c of the readings that have one of the digits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [bits_within(v.values.to_numpy(), d.as_py()) for v, d in zip(batch.column("values"), batch.column("digits"))]
            rows = np.repeat(np.arange(len(found)), [len(f[1]) for f in found])
            columns = [np.concatenate([f[i] for f in found]).astype(np.int64) if found else np.zeros(0, np.int64) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(group).take(pa.array(rows)), *map(pa.array, columns)], [group, "_prefix", "_bits", "_c"])

    return run
