"""Six radio-counter detectors over long facts (cell_id, ts, seq, metric, value).

Same names as the KPI detectors, different rules.  Calendar metrics are left out
unless ``calendar=True``, because a clock always trends.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from radiolake.catalogue import counters as C
from radiolake.functions import ordered as O
from radiolake.functions import series as S
from radiolake.functions.columns import hours, rnd, severity_rank
from radiolake.functions.ordered import KEY, SLICE
from radiolake.session import cut_lineage

THRESHOLD, PEER, TREND, IQR, CUSUM, BOLLINGER = (
    "Threshold", "Peer Comparison", "Trend", "IQR", "CUSUM", "Bollinger Bands"
)
COUNTER_DETECTOR_NAMES = [THRESHOLD, PEER, TREND, IQR, CUSUM, BOLLINGER]
KEYS = ["metric", "cell_id"]
COLUMNS = [
    "label", "category", "cell_id", "gnb_id", "value", "unit", "warning", "critical", "severity", "evidence",
    "recommendation", "detector", "score", "source",
]


def _facts(facts: DataFrame, calendar: bool) -> DataFrame:
    known = facts.where(F.col("value").isNotNull())
    return known if calendar else known.where(~F.col("metric").isin(list(C.CALENDAR)))


def _with_dim(df: DataFrame, dim: DataFrame | None) -> DataFrame:
    dim = dim if dim is not None else F.broadcast(C.counter_dim(df.sparkSession))
    return df.join(dim, "metric", "left").withColumns(
        {
            "desc": F.coalesce("desc", "metric"),
            "unit": F.coalesce("unit", F.lit("")),
            "worse_high": F.coalesce("worse_high", F.lit(False)),
        }
    )


def _emit(df: DataFrame, detector: str, score: Column, dim: DataFrame | None) -> DataFrame:
    j = _with_dim(df, dim) if "desc" not in df.columns else df
    return j.select(
        F.col("metric").alias("label"),
        F.col("desc").alias("category"),
        "cell_id",
        F.col("cell_id").alias("gnb_id"),
        rnd("value", 3).alias("value"),
        "unit",
        "warning",
        "critical",
        "severity",
        F.concat("metric", F.lit(f" {detector}: score="), F.format_string("%.2f", score), F.lit(" on cell "), "cell_id")
        .alias("evidence"),
        F.concat(F.lit("Investigate "), "desc", F.lit(" on cell "), "cell_id", F.lit(".")).alias("recommendation"),
        F.lit(detector).alias("detector"),
        score.alias("score"),
        F.lit("stats").alias("source"),
    )


def detect_threshold(facts: DataFrame, dim: DataFrame | None = None, calendar: bool = False) -> DataFrame:
    """Mean per (metric, cell) against the limits; score is the distance to the warning."""
    return _threshold_alarms(_facts(facts, calendar).groupBy("metric", "cell_id").agg(F.avg("value").alias("value")), dim)


def _threshold_alarms(means: DataFrame, dim: DataFrame | None = None) -> DataFrame:
    j = _with_dim(means, dim).where(F.col("warning").isNotNull())
    v, high = F.col("value"), F.col("worse_high")
    crit = F.when(high, v >= F.col("critical")).otherwise(v <= F.col("critical"))
    warn = F.when(high, v >= F.col("warning")).otherwise(v <= F.col("warning"))
    j = j.withColumn("severity", F.when(crit, "Critical").when(warn, "High")).where(F.col("severity").isNotNull())
    return _emit(j, THRESHOLD, F.abs(v - F.col("warning")), dim)


def detect_peers(facts: DataFrame, z_threshold: float = 2.0, z_high: float = 3.0, dim: DataFrame | None = None,
                 calendar: bool = False) -> DataFrame:
    """Cell means two or more sample deviations from the fleet, either side."""
    return _peer_alarms(_facts(facts, calendar).groupBy("metric", "cell_id").agg(F.avg("value").alias("value")), z_threshold, z_high, dim)


def _peer_alarms(means: DataFrame, z_threshold: float = 2.0, z_high: float = 3.0, dim: DataFrame | None = None) -> DataFrame:
    fleet = means.groupBy("metric").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s")).where(
        F.col("s") > 0
    )
    z = F.abs((F.col("value") - F.col("m")) / F.col("s"))
    out = means.join(fleet, "metric").withColumn("z", z).where(F.col("z") >= z_threshold)
    out = out.withColumn("severity", F.when(F.col("z") >= z_high, "High").otherwise("Medium"))
    return _emit(out, PEER, F.col("z"), dim)


def detect_trend(facts: DataFrame, slope_threshold: float = 0.3, slope_high: float = 1.0, min_points: int = 8,
                 dim: DataFrame | None = None, calendar: bool = False) -> DataFrame:
    """Slope per (metric, cell) in units per hour, either direction; value is the last reading."""
    rows = _facts(facts.where(F.col("ts").isNotNull()), calendar).withColumn("x", hours("ts"))
    fit = rows.groupBy("metric", "cell_id").agg(
        F.regr_slope("value", "x").alias("slope"),
        F.max_by("value", "seq").alias("value"),
        F.count(F.lit(1)).alias("n"),
    )
    return _trend_alarms(fit, slope_threshold, slope_high, min_points, dim)


def _trend_alarms(fit: DataFrame, slope_threshold: float = 0.3, slope_high: float = 1.0, min_points: int = 8, dim: DataFrame | None = None) -> DataFrame:
    fit = fit.where((F.col("n") >= min_points) & (F.abs("slope") >= slope_threshold))
    fit = fit.withColumn("severity", F.when(F.abs("slope") > slope_high, "High").otherwise("Medium"))
    return _emit(fit, TREND, F.abs("slope"), dim)


def detect_iqr(facts: DataFrame, k: float = 3.0, min_points: int = 10, pct_high: float = 5.0,
               dim: DataFrame | None = None, calendar: bool = False) -> DataFrame:
    """Fence per (metric, cell), both sides; score is the share of outliers in percent."""
    rows = _facts(facts, calendar)
    fence = _fences(O.exact_percentiles(rows, KEYS, "value", [0.25, 0.75]), k, min_points)
    # equal readings are counted first, so the join carries one row per distinct value
    counts = rows.groupBy(*KEYS, "value").agg(F.count(F.lit(1)).alias("c"))
    out = counts.join(fence, KEYS).where((F.col("value") < F.col("lo")) | (F.col("value") > F.col("hi")))
    return _iqr_alarms(out.groupBy(*KEYS, "n").agg(F.sum(F.col("value") * F.col("c")).alias("total"), F.sum("c").alias("outliers")), pct_high, dim)


def _fences(quartiles: DataFrame, k: float = 3.0, min_points: int = 10) -> DataFrame:
    return quartiles.where((F.col("n") >= min_points) & (F.col("p1") > F.col("p0"))).selectExpr(
        *KEYS, "n", f"p0 - {float(k)}D * (p1 - p0) AS lo", f"p1 + {float(k)}D * (p1 - p0) AS hi"
    )


def _iqr_alarms(sums: DataFrame, pct_high: float = 5.0, dim: DataFrame | None = None) -> DataFrame:
    """IQR alarms from the count and total of the readings outside, one row per (metric, cell)."""
    out = sums.withColumns({"value": F.col("total") / F.col("outliers"), "pct": F.col("outliers") / F.col("n") * 100.0})
    out = out.withColumn("severity", F.when(F.col("pct") > pct_high, "High").otherwise("Medium"))
    return _emit(out, IQR, F.col("pct"), dim)


def detect_cusum(facts: DataFrame, threshold: float = 4.0, slack: float = 0.5, min_points: int = 15,
                 dim: DataFrame | None = None, calendar: bool = False) -> DataFrame:
    """Largest excursion max(|z|) - slack; the running maximum of it is a plain aggregate."""
    agg = _facts(facts, calendar).groupBy("metric", "cell_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.stddev_samp("value").alias("s"),
        F.max("value").alias("hi"), F.min("value").alias("lo"), F.max_by("value", "seq").alias("value"),
    )
    return _cusum_alarms(agg, threshold, slack, min_points, dim)


def _cusum_alarms(agg: DataFrame, threshold: float = 4.0, slack: float = 0.5, min_points: int = 15, dim: DataFrame | None = None) -> DataFrame:
    agg = agg.where(F.col("n") >= min_points)
    s = F.when(F.col("s") == 0, 1.0).otherwise(F.col("s"))
    reach = F.greatest((F.col("hi") - F.col("m")) / s, (F.col("m") - F.col("lo")) / s) - slack
    out = agg.withColumn("reach", F.greatest(reach, F.lit(0.0))).where(F.col("reach") >= threshold)
    out = out.withColumn("severity", F.when(F.col("reach") > threshold * 1.5, "High").otherwise("Medium"))
    return _emit(out, CUSUM, F.col("reach"), dim)


def detect_bollinger(facts: DataFrame, window: int = 5, k: float = 2.5, min_pct: float = 3.0, pct_high: float = 8.0,
                     lagged: bool = False, dim: DataFrame | None = None, calendar: bool = False) -> DataFrame:
    """Share of readings outside the rolling band.

    The default frame includes the reading itself, which bounds its z-score
    below k for a window of 5; ``lagged=True`` uses the readings before it.
    """
    options = {"window": window, "k": k, "min_pct": min_pct, "pct_high": pct_high, "lagged": lagged, "dim": dim, "calendar": calendar}
    return detect_counters_each(facts, [BOLLINGER], {BOLLINGER: options})


def _bollinger_alarms(shares: DataFrame, min_pct: float = 3.0, pct_high: float = 8.0, dim: DataFrame | None = None) -> DataFrame:
    """Band alarms from the breaks and length of every series, with its last reading."""
    out = shares.withColumn("pct", F.col("breaks") / F.col("len") * 100.0).where((F.col("breaks") > 0) & (F.col("pct") >= min_pct))
    out = out.withColumn("severity", F.when(F.col("pct") > pct_high, "High").otherwise("Medium"))
    return _emit(out, BOLLINGER, F.col("pct"), dim)


def _tally(band: dict | None):
    """The pass over slices: band breaks, and count and total of the readings outside the fence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for values, lo, hi, halo in zip(*(batch.column(c) for c in ("values", "lo", "hi", "halo"))):
                v, breaks, outliers, total = values.values.to_numpy(), 0, 0, 0.0
                if band is not None and len(v):
                    window = band.get("window", 5)
                    before = halo.values.to_numpy() if halo.is_valid else np.zeros(0)
                    count, mean, sd = S.lagged_band(v, before, window, 1 if band.get("lagged") else 0)
                    breaks = int(((count == window) & (np.abs(v - mean) > band.get("k", 2.5) * sd)).sum())
                if lo.is_valid:
                    outside = v[(v < lo.as_py()) | (v > hi.as_py())]
                    outliers, total = len(outside), float(outside.sum())
                out.append((breaks, outliers, total))
            kinds = (pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(KEY), *[pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)]], [KEY, "breaks", "outliers", "total"])

    return run


def _values_in(slices: DataFrame):
    """For ``ordered.percentiles_of_digits``: readings whose leading digit is wanted, counted within slices."""

    def picked(wanted: DataFrame) -> DataFrame:
        digits = wanted.groupBy(KEY).agg(F.collect_set("_prefix").alias("digits"))
        rows = slices.select(KEY, "values").join(digits, KEY)
        return rows.mapInArrow(S.values_of_digits(KEY), f"{KEY} {slices.schema[KEY].dataType.simpleString()}, _prefix bigint, _bits bigint, _c bigint")

    return picked


COUNTER_DETECTORS = {
    THRESHOLD: detect_threshold,
    PEER: detect_peers,
    TREND: detect_trend,
    IQR: detect_iqr,
    CUSUM: detect_cusum,
    BOLLINGER: detect_bollinger,
}


def detect_counters_each(facts: DataFrame, detectors=None, options: dict[str, dict] | None = None) -> DataFrame:
    """Alarms of the chosen detectors (default: all six), each with its own; ``options`` are a detector's arguments by name.

    The readings are dealt and packed once (see ``functions.series``). Means, peers, trends and CUSUM come
    from the summaries of the slices, quartile fences from their digit counts, and one pass over
    the slices counts band breaks and readings outside the fences.
    """
    names = list(dict.fromkeys(detectors or COUNTER_DETECTORS))
    options = {n: dict((options or {}).get(n, {})) for n in names}
    if len(names) == 1 and names[0] != BOLLINGER:  # plain aggregates, no order needed
        return COUNTER_DETECTORS[names[0]](facts, **options[names[0]])
    with_calendar = any(o.get("calendar") for o in options.values())
    slices = S.packed(_facts(facts, with_calendar), KEYS, "counter-series")
    metric, cell = F.col(f"{KEY}.metric").alias("metric"), F.col(f"{KEY}.cell_id").alias("cell_id")
    parts = S.summaries(slices).where(F.col("n") > 0)
    merged = cut_lineage(S.merged(parts).join(
        parts.groupBy(KEY).agg(*[F.expr(e) for e in (
            "max(hi) AS hi", "min(lo) AS lo", "max_by(last_value, last_seq) AS last_value", f"max_by(end_value, {SLICE}) AS end_value",
            "max_by(tlast_value, tlast_seq) AS tlast_value",
        )]).withColumnRenamed(KEY, "_k"), F.col("_g0").eqNullSafe(F.col("_k"))
    ).select(F.col("_g0").alias(KEY), "N", "mu", "M2", "TN", S.slope().alias("slope"), "hi", "lo", "last_value", "end_value", "tlast_value"), "counter-merged")

    def of(name: str, *columns: str) -> DataFrame:
        rows = merged.select(metric, cell, *[F.expr(c) for c in columns])
        return rows if options[name].get("calendar") else rows.where(~F.col("metric").isin(list(C.CALENDAR)))

    tally = None
    if IQR in names or BOLLINGER in names:
        rows = slices.select(KEY, SLICE, "values")
        if IQR in names:
            o = options[IQR]
            quartiles = O.percentiles_of_digits(S.digit_counts(parts, F.col(KEY)), _values_in(slices), KEYS, [0.25, 0.75])
            fence = cut_lineage(_fences(quartiles, o.get("k", 3.0), o.get("min_points", 10)), "counter-fences")
            rows = rows.join(fence.select(F.struct(*KEYS).alias(KEY), "lo", "hi"), KEY, "left")
        else:
            rows = rows.selectExpr("*", "cast(null AS double) AS lo", "cast(null AS double) AS hi")
        if BOLLINGER in names:
            rows = rows.join(S.tails_before(parts, "tail", options[BOLLINGER].get("window", 5) + 1), [KEY, SLICE], "left")
        else:
            rows = rows.selectExpr("*", "cast(null AS array<double>) AS halo")
        kind = slices.schema[KEY].dataType.simpleString()
        counted = rows.mapInArrow(_tally(options.get(BOLLINGER)), f"{KEY} {kind}, breaks bigint, outliers bigint, total double")
        tally = cut_lineage(counted.groupBy(KEY).agg(*[F.expr(f"sum({c}) AS {c}") for c in ("breaks", "outliers", "total")]), "counter-tally")
        tally = tally.join(merged.select(KEY, "N", "end_value"), KEY).select(metric, cell, "breaks", "outliers", "total", "N", "end_value")
    out = []
    for n in names:
        o = {k: v for k, v in options[n].items() if k != "calendar"}
        mine = tally if tally is None or options[n].get("calendar") else tally.where(~F.col("metric").isin(list(C.CALENDAR)))
        if n == THRESHOLD:
            out.append(_threshold_alarms(of(n, "mu AS value"), **o))
        elif n == PEER:
            out.append(_peer_alarms(of(n, "mu AS value"), **o))
        elif n == TREND:
            out.append(_trend_alarms(of(n, "slope", "tlast_value AS value", "TN AS n"), **o))
        elif n == CUSUM:
            out.append(_cusum_alarms(of(n, "N AS n", "mu AS m", "sqrt(M2 / nullif(N - 1, 0)) AS s", "hi", "lo", "last_value AS value"), **o))
        elif n == IQR:
            hit = mine.where("outliers > 0").select(*KEYS, F.col("N").alias("n"), "total", "outliers")
            out.append(_iqr_alarms(hit, o.get("pct_high", 5.0), o.get("dim")))
        elif n == BOLLINGER:
            long = mine.where(F.col("N") >= o.get("window", 5) + 2).select(*KEYS, "breaks", F.col("N").alias("len"), F.col("end_value").alias("value"))
            out.append(_bollinger_alarms(long, o.get("min_pct", 3.0), o.get("pct_high", 8.0), o.get("dim")))
    return reduce(DataFrame.unionByName, out)


def detect_counters(facts: DataFrame, **kw) -> DataFrame:
    """Highest severity per (metric, cell); the earlier detector wins ties.  Sorted by severity, score."""
    every = detect_counters_each(facts, **kw)
    place = F.array_position(F.array(*[F.lit(d) for d in COUNTER_DETECTOR_NAMES]), F.col("detector"))
    pick = F.max_by(F.struct(*COLUMNS), F.struct(severity_rank(), -place))
    best = every.groupBy("label", "cell_id").agg(pick.alias("r")).select("r.*")
    return best.orderBy(severity_rank().desc(), F.col("score").desc())
