"""Six KPI anomaly detectors over long facts, all emitting one row shape.

Facts: cell_id, gnb_id, channel_type, ts, seq, kpi, value (+ prb_ul, the uplink
load of the same source row).  Limits and direction come from the catalogue;
``dim`` may be replaced to tune them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from radiolake.catalogue import kpi as K
from radiolake.functions import ordered as O
from radiolake.functions import series as S
from radiolake.functions.columns import hours, limit_severity, rnd, severity_rank
from radiolake.functions.ordered import KEY, SLICE
from radiolake.operators.derive import capacity_map, capacity_share
from radiolake.session import cut_lineage

THRESHOLD, PEER, TREND = "Threshold", "Peer Comparison", "Trend (linear regression)"
IQR, CUSUM, BOLLINGER = "IQR (Tukey fence)", "CUSUM", "Bollinger Bands"
KPI_DETECTOR_NAMES = [THRESHOLD, PEER, TREND, IQR, CUSUM, BOLLINGER]

COLUMNS = [
    "type", "severity", "score", "detector", "evidence", "kpi", "label", "category", "unit", "cell_id", "gnb_id",
    "ts", "value", "warning", "critical", "recommendation", "normalized_pct", "capacity_mbps", "prb_ul",
    "load_aware", "sustained_minutes", "peak_prb_dl", "seq",
]
OPTIONAL = {
    "normalized_pct": "double", "capacity_mbps": "double", "prb_ul": "double", "load_aware": "boolean",
    "sustained_minutes": "bigint", "peak_prb_dl": "double", "seq": "bigint",
}


def with_catalogue(facts: DataFrame, dim: DataFrame | None = None) -> DataFrame:
    """Join the catalogue (a given one is left to AQE); unknown KPIs are higher-better without limits."""
    dim = dim if dim is not None else F.broadcast(K.kpi_dim(facts.sparkSession))
    filled = {"label": "kpi", "category": "'Other'", "unit": "''", "direction": f"'{K.HIGHER}'", "advice": f"'{K.DEFAULT_ADVICE}'"}
    return facts.join(dim, "kpi", "left").withColumns({c: F.expr(f"coalesce({c}, {other})") for c, other in filled.items()})


def _worse_high() -> Column:
    return F.col("direction") == K.LOWER


def _num(c: Column | str, digits: int = 2) -> Column:
    """Fixed number of digits through a decimal, which stays in generated code."""
    if isinstance(c, str):
        scale = f"{10 ** digits}.0D"
        return F.expr(f"coalesce(cast(try_cast(rint(cast({c} AS double) * {scale}) / {scale} AS decimal(28,{digits})) AS string), cast({c} AS string))")
    return F.coalesce(rnd(c, digits).try_cast(f"decimal(28,{digits})").cast("string"), c.cast("string"))


def emit(df: DataFrame, detector: str, evidence: Column, **over: Column) -> DataFrame:
    """Common anomaly row: score and value are the rounded reading unless overridden."""
    have = set(df.columns)
    base: dict[str, Column | str] = {
        "type": "concat(label, ' anomaly on ', cell_id)",
        "score": "rint(cast(value AS double) * 1000.0D) / 1000.0D",
        "detector": f"'{detector}'",
        "evidence": evidence,
        "value": "rint(cast(value AS double) * 1000.0D) / 1000.0D",
        "recommendation": "advice",
        **{name: f"cast({name if name in have else 'null'} AS {kind})" for name, kind in OPTIONAL.items()},
        **over,
    }
    shown = [(base.get(c, c), c) for c in COLUMNS]
    return df.select(*[F.expr(f"{e} AS {c}") if isinstance(e, str) else e.alias(c) for e, c in shown])


# ---------------------------------------------------------------- threshold

def _limit_breach() -> Column:
    return limit_severity(F.col("value"), F.col("warning"), F.col("critical"), _worse_high())


def _limit_text() -> Column:
    critical = F.col("severity") == "Critical"
    return F.concat(
        "label", F.lit("="), _num("value"), "unit", F.when(_worse_high(), " > ").otherwise(" < "),
        F.when(critical, "critical").otherwise("warning"), F.lit(" threshold "),
        F.when(critical, F.col("critical")).otherwise(F.col("warning")).cast("string"), "unit",
    )


def limits_generic(facts: DataFrame, dim: DataFrame | None = None) -> DataFrame:
    """Every reading against its catalogue limits: a pure map over the rows."""
    j = with_catalogue(facts.where(F.col("value").isNotNull()), dim)
    return emit(j.withColumn("severity", _limit_breach()).where(F.col("severity").isNotNull()), THRESHOLD, _limit_text())


def dl_share_severity(pct: Column) -> Column:
    return F.when(pct <= K.DL_PCT_CRITICAL, "Critical").when(pct <= K.DL_PCT_WARNING, "High")


def ul_load_severity(pct: Column, prb: Column) -> Column:
    """Uplink share judged against the load of the same row; fixed floors when the load is unusable."""
    usable = prb.isNotNull() & ~F.isnan(prb) & prb.between(K.UL_MIN_PRB, K.UL_MAX_PRB)
    crit = F.when(usable, F.greatest(F.lit(K.UL_FLOOR_CRITICAL), prb * K.UL_SHARE_CRITICAL)).otherwise(
        K.UL_FLOOR_CRITICAL
    )
    warn = F.when(usable, F.greatest(F.lit(K.UL_FLOOR_WARNING), prb * K.UL_SHARE_WARNING)).otherwise(
        K.UL_FLOOR_WARNING
    )
    return F.when(pct <= crit, "Critical").when(pct <= warn, "High")


def throughput_limits(facts: DataFrame, capacities: DataFrame | None = None, dim: DataFrame | None = None,
                      directions=("dl", "ul")) -> DataFrame:
    """Throughput as share of cell capacity; cells of unknown capacity are judged in Mbps."""
    rows = facts.where(F.col("kpi").isin(list(K.THROUGHPUT_DIRECTION)) & F.col("value").isNotNull())
    caps = capacities if capacities is not None else capacity_map(facts)
    return _row_limits(capacity_share(rows, caps).where(F.col("dir").isin(list(directions))), dim)


def _row_limits(shared: DataFrame, dim: DataFrame | None) -> DataFrame:
    """Readings with their share of capacity against the limits: throughput by share where capacity is known, the rest as it is."""
    j = with_catalogue(shared, dim)
    pct, known, uplink = F.col("normalized_pct"), F.col("capacity_mbps").isNotNull(), F.col("dir") == "ul"
    by_share = F.when(uplink, ul_load_severity(pct, F.col("prb_ul"))).otherwise(dl_share_severity(pct))
    j = j.withColumn("severity", F.when(known, by_share).otherwise(_limit_breach())).where(F.col("severity").isNotNull())
    j = j.withColumns(
        {"load_aware": F.when(known & uplink, F.lit(True)), "prb_ul": F.when(known & uplink, F.col("prb_ul"))}
    )
    share = F.concat(
        "label", F.lit("="), _num("value"), F.lit(" Mbps ("), _num(pct, 1), F.lit("% of "), _num("capacity_mbps", 0),
        F.lit(" Mbps capacity)"),
        F.when(uplink, F.concat(F.lit("; PRB_UL="), F.coalesce(_num("prb_ul", 1), F.lit("N/A"))))
        .otherwise(F.lit(" below capacity limit")),
    )
    return emit(j, THRESHOLD, F.when(known, share).otherwise(_limit_text()))


RUN_ROWS = 5  # first rows of a run that are kept; the trigger is one of them


def sustained_load(facts: DataFrame, kpi: str = K.PRB_DL, gap_s: float = 90.0, min_warning: int = 5,
                   min_critical: int = 3, dim: DataFrame | None = None) -> DataFrame:
    """Load readings over the limit count only as a run: hits no further apart than ``gap_s``.

    A run with any critical hit fires at its ``min_critical``-th row, otherwise at its ``min_warning``-th.
    Slices give their runs; only a slice's first and last run can go on in another, so a run of any length is
    put together from pieces and never gathered.
    """
    options = {"kpi": kpi, "gap_s": gap_s, "min_warning": min_warning, "min_critical": min_critical, "dim": dim}
    slices = pack(facts.where(F.col("kpi") == kpi))
    return _run_alarms(_pass(slices, {THRESHOLD: options}), dim, min_warning, min_critical)


def _run_alarms(found: DataFrame, dim: DataFrame | None, min_warning: int = 5, min_critical: int = 3) -> DataFrame:
    """Alarms of the runs of a pass: pieces at slice edges joined, then one row per run that is long enough."""
    pieces = found.where("what = 'run'").select(KEY, SLICE, "place", "edge", "run.*")
    # a piece at an edge joins the piece before it if it is near enough; inner ones are whole
    w = Window.partitionBy(KEY).orderBy(SLICE, "place")
    edges = pieces.where("edge").withColumn("_last", F.lag("end_ts").over(w))
    starts = F.col("_last").isNull() | (F.col("begin_ts") - F.col("_last") > F.col("gap_us"))
    edges = edges.withColumn("run_no", F.sum(starts.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.slice(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(SLICE, "place", "first"))), lambda x: x["first"])), 1, RUN_ROWS)
    joined = edges.groupBy(KEY, "run_no").agg(
        F.sum("size").alias("size"), F.max("peak").alias("peak"), F.bool_or("any_critical").alias("any_critical"), F.max(F.struct(SLICE, "place")).alias("_at"),
    )
    # only the pieces that hold a run's first rows are gathered
    reach = edges.withColumn("_done", F.coalesce(F.sum("size").over(Window.partitionBy(KEY, "run_no").orderBy(SLICE, "place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    heads = reach.where(F.col("_done") < RUN_ROWS).groupBy(KEY, "run_no").agg(first.alias("first"))
    runs = joined.join(heads, [KEY, "run_no"]).select(KEY, "size", "peak", "any_critical", "first")
    runs = runs.unionByName(pieces.where("not edge").select(KEY, "size", "peak", "any_critical", "first"))
    critical = F.col("any_critical") & (F.col("size") >= min_critical)
    runs = runs.withColumn("severity", F.when(critical, "Critical").when(F.col("size") >= min_warning, "High")).where(F.col("severity").isNotNull())
    at = F.when(F.col("severity") == "Critical", F.get("first", F.lit(min_critical - 1))).otherwise(F.get("first", F.lit(min_warning - 1)))
    runs = runs.withColumn("r", at).select(
        F.col(f"{KEY}.kpi").alias("kpi"), F.col(f"{KEY}.cell_id").alias("cell_id"), "severity", F.col("size").cast("bigint").alias("sustained_minutes"), "peak",
        rnd("peak", 2).alias("peak_prb_dl"), F.col("r.name").alias("gnb_id"), F.timestamp_micros("r.ts").alias("ts"), "r.seq", "r.value",
    )
    runs = with_catalogue(runs, dim)
    limit = F.when(F.col("severity") == "Critical", F.col("critical")).otherwise(F.col("warning"))
    text = F.concat(
        "label", F.lit("="), _num("peak", 1), "unit", F.lit(" sustained > "), limit.cast("string"), "unit",
        F.lit(" for "), F.col("sustained_minutes").cast("string"), F.lit(" consecutive readings"),
    )
    return emit(runs, THRESHOLD, text)


def detect_threshold(facts: DataFrame, dim: DataFrame | None = None, capacities: DataFrame | None = None,
                     **run_options) -> DataFrame:
    """All threshold rules: sustained load, share of capacity, plain limits."""
    return detect_kpi(facts, [THRESHOLD], {THRESHOLD: {"dim": dim, "capacities": capacities, **run_options}})


# ---------------------------------------------------------------- peer

def detect_peers(facts: DataFrame, z_threshold: float = 2.0, z_high: float = 3.0,
                 dim: DataFrame | None = None) -> DataFrame:
    """Cells whose mean lies beyond 2 sample deviations of all cell means, on the bad side.

    Two aggregations: rows to cell means, then moments of the cell means.  The
    moments are one row per KPI and join back without a window over the fleet.
    """
    parts = facts.where(F.col("value").isNotNull()).groupBy("kpi", "cell_id", "gnb_id").agg(
        F.sum("value").alias("_sum"), F.count("value").alias("_n"), F.min("seq").alias("_at")
    )
    cells = parts.groupBy("kpi", "cell_id").agg(
        (F.sum("_sum") / F.sum("_n")).alias("value"), F.min_by("gnb_id", F.struct("_at", "gnb_id")).alias("gnb_id")
    )
    return _peer_alarms(cells, z_threshold, z_high, dim)


def _peer_alarms(cells: DataFrame, z_threshold: float = 2.0, z_high: float = 3.0, dim: DataFrame | None = None) -> DataFrame:
    """Peer alarms from one mean per (KPI, cell)."""
    fleet = cells.groupBy("kpi").agg(
        F.avg("value").alias("fleet_mean"), F.stddev_samp("value").alias("fleet_std")
    ).where(F.col("fleet_std") > 0)
    j = with_catalogue(cells.join(fleet, "kpi"), dim).withColumn(
        "z", (F.col("value") - F.col("fleet_mean")) / F.col("fleet_std")
    )
    bad = F.when(_worse_high(), F.col("z")).otherwise(-F.col("z"))
    j = j.withColumn("severity", F.when(bad > z_high, "High").when(bad > z_threshold, "Medium"))
    j = j.where(F.col("severity").isNotNull()).withColumn("ts", F.lit(None).cast("timestamp"))
    text = F.concat(
        "label", F.lit(" cell_mean="), _num("value"), "unit", F.lit(" vs fleet_mean="), _num("fleet_mean"), "unit",
        F.lit(" (z="), _num("z"), F.lit(")"),
    )
    return emit(j, PEER, text)


# ---------------------------------------------------------------- trend

def detect_trend(facts: DataFrame, slope_threshold: float = 0.5, slope_high: float = 2.0, min_points: int = 5,
                 dim: DataFrame | None = None) -> DataFrame:
    """Least-squares slope per KPI over all cells, in units per hour; only degrading slopes."""
    known = facts.where(F.col("ts").isNotNull() & F.col("value").isNotNull()).withColumn("x", hours("ts"))
    fit = known.groupBy("kpi").agg(
        F.regr_slope("value", "x").alias("slope"),
        F.regr_intercept("value", "x").alias("icept"),
        F.min("x").alias("x0"),
        F.max("x").alias("x1"),
        F.count(F.lit(1)).alias("n"),
    )
    return _trend_alarms(fit, slope_threshold, slope_high, min_points, dim)


def _trend_alarms(fit: DataFrame, slope_threshold: float = 0.5, slope_high: float = 2.0, min_points: int = 5, dim: DataFrame | None = None) -> DataFrame:
    """Trend alarms from one fitted line per KPI."""
    j = with_catalogue(fit.where(F.col("n") >= min_points), dim)
    bad = F.when(_worse_high(), F.col("slope")).otherwise(-F.col("slope"))
    j = j.where(bad > slope_threshold).withColumns(
        {
            "severity": F.when(F.abs("slope") > slope_high, "High").otherwise("Medium"),
            "value": F.col("slope"),
            "cell_id": F.lit("Fleet-wide"),
            "gnb_id": F.lit("All"),
            "ts": F.lit(None).cast("timestamp"),
            "start_est": F.col("icept") + F.col("slope") * F.col("x0"),
            "end_est": F.col("icept") + F.col("slope") * F.col("x1"),
        }
    )
    text = F.concat(
        "label", F.lit(": slope="), _num("slope", 3), "unit", F.lit("/hr over "), _num(F.col("x1") - F.col("x0"), 1), F.lit("hrs (est. "),
        _num("start_est"), F.lit("→"), _num("end_est"), "unit", F.lit(")"),
    )
    return emit(
        j, TREND, text,
        type=F.concat("label", F.lit(" degrading trend")),
        score=rnd(F.abs("slope"), 3),
        value=rnd("slope", 4),
    )


# ---------------------------------------------------------------- IQR

def detect_iqr(facts: DataFrame, k: float = 1.5, min_points: int = 4, dim: DataFrame | None = None) -> DataFrame:
    """Tukey fence per KPI over all cells; the worst violation per (KPI, cell), earliest on ties."""
    known = facts.where(F.col("value").isNotNull())
    fence = _fences(O.exact_percentiles(known, ["kpi"], "value", [0.25, 0.75]), k, min_points)
    return _iqr_alarms(known.join(fence, "kpi"), dim)


def _fences(quartiles: DataFrame, k: float = 1.5, min_points: int = 4) -> DataFrame:
    return (
        quartiles.where(F.col("n") >= min_points)
        .withColumn("iqr", F.col("p1") - F.col("p0"))
        .where(F.col("iqr") != 0)
        .select("kpi", "iqr", (F.col("p0") - k * F.col("iqr")).alias("lo"), (F.col("p1") + k * F.col("iqr")).alias("hi"))
    )


def _iqr_alarms(rows: DataFrame, dim: DataFrame | None = None) -> DataFrame:
    """IQR alarms from readings with the fence of their KPI."""
    j = with_catalogue(rows, dim)
    dev = F.when(_worse_high(), F.col("value") - F.col("hi")).otherwise(F.col("lo") - F.col("value"))
    out = j.withColumn("dev", dev).where(F.col("dev") > 0)
    return emit(_worst(out, F.col("dev") > F.col("iqr")), IQR, F.concat(
        "label", F.lit("="), _num("value"), "unit", F.lit(" outside fence by "), _num("dev"), "unit"))


def _worst(rows: DataFrame, high: Column, by_time: bool = False) -> DataFrame:
    """Largest deviation per (kpi, cell); the first row in the file, or in time, wins ties.  Map-side combined."""
    keep = ["gnb_id", "ts", "seq", "value", "dev", "label", "category", "unit", "warning", "critical", "advice"]
    row = F.struct(*keep, F.when(high, "High").otherwise("Medium").alias("severity"))
    best = F.max_by(row, F.struct("dev", -F.unix_micros("ts"), -F.col("seq")) if by_time else F.struct("dev", -F.col("seq")))
    return rows.groupBy("kpi", "cell_id").agg(best.alias("r")).select("kpi", "cell_id", "r.*")


# ---------------------------------------------------------------- CUSUM

def cusum_path(facts: DataFrame, k: float = 0.5, reference_window: int | None = None, min_points: int = 5,
               keys=("kpi", "cell_id")) -> DataFrame:
    """Two-sided cumulative sums S+ and S- for every reading with a time: keys, ts, seq, value, _mu, _sigma, s_pos, s_neg.

    There is no recursion: with W the running sum of (z - k), S = W - min(0, running minimum of W), and a slice
    hands on its total and where its own path ends, so no series is ever held by one task. Moments are those of the
    whole series or of its first ``reference_window`` readings. Series shorter than ``min_points`` or
    without spread have no path. Readings without a key are a series of their own.
    """
    slices = S.packed(facts.where(F.col("value").isNotNull() & F.col("ts").isNotNull()), keys, "cusum-series")
    rows = slices.select(KEY, SLICE, "tss", "seqs", "values").join(_begun(slices, k, reference_window, min_points), [KEY, SLICE])
    empty = F.array().cast("array<double>")
    row = F.explode(F.arrays_zip("tss", "seqs", "values", "ups", "downs")).alias("r")
    return rows.mapInArrow(_paths(k), rows.withColumns({"ups": empty, "downs": empty}).schema).select(KEY, "mu", "sigma", row).select(
        *[F.col(f"{KEY}.`{c}`").alias(c) for c in keys], F.timestamp_micros("r.tss").alias("ts"), F.col("r.seqs").alias("seq"), F.col("r.values").alias("value"),
        F.col("mu").alias("_mu"), F.col("sigma").alias("_sigma"), F.col("r.ups").alias("s_pos"), F.col("r.downs").alias("s_neg"),
    )


def _paths(slack: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ups, downs = [], []
            for values, mu, sigma, up, down in zip(*(batch.column(c) for c in ("values", "mu", "sigma", "up_from", "down_from"))):
                u, d, *_ = S.climbs(values.values.to_numpy(), mu.as_py(), sigma.as_py(), slack, (up.as_py(), down.as_py()))
                ups.append(u)
                downs.append(d)
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ups, kind), pa.array(downs, kind)], [*batch.schema.names, "ups", "downs"])

    return run


def _reference(slices: DataFrame, reference_window: int | None, min_points: int) -> DataFrame:
    """KEY, mu and sigma of every series that is long enough and varies."""
    parts = S.summaries(slices)
    whole = S.merged(parts).select(F.col("_g0").alias(KEY), "TN", F.col("tmu").alias("mu"), F.sqrt(F.col("TM2") / F.nullif("TN", F.lit(0))).alias("sigma"))
    if reference_window is not None:
        before = F.coalesce(F.sum("tn").over(Window.partitionBy(KEY).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        early = parts.select(KEY, SLICE, (F.lit(reference_window) - before).alias("left")).where("left > 0")
        met = slices.select(KEY, SLICE, "tss", "values").join(early, [KEY, SLICE])
        timed = F.transform(F.filter(F.arrays_zip("tss", "values"), lambda r: r["tss"].isNotNull()), lambda r: r["values"])
        first = met.select(KEY, F.explode(F.slice(timed, 1, F.col("left").cast("int"))).alias("v"))
        whole = whole.select(KEY, "TN").join(first.groupBy(KEY).agg(F.avg("v").alias("mu"), F.stddev_pop("v").alias("sigma")), KEY)
    return whole.where((F.col("TN") >= min_points) & (F.col("sigma") > 0)).select(KEY, "mu", "sigma")


def _begun(slices: DataFrame, k: float, reference_window: int | None, min_points: int = 5) -> DataFrame:
    """KEY, SLICE, mu, sigma and where both sums stand when the slice begins."""
    reference = _reference(slices, reference_window, min_points)
    totals = slices.select(KEY, SLICE, "tss", "values").join(reference, KEY).mapInArrow(
        _totals(k), slices.select(KEY, SLICE, *[F.lit(0.0).alias(c) for c in ("mu", "sigma", "up_total", "down_total", "up_end", "down_end")]).schema
    )
    return S.climb_starts(totals, "mu", "sigma")


def _totals(slack: float):
    """Per slice the totals of both sums and where its own paths end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for tss, values, mu, sigma in zip(*(batch.column(c) for c in ("tss", "values", "mu", "sigma"))):
                v = values.values.to_numpy()[tss.values.is_valid().to_numpy(zero_copy_only=False)]
                if len(v):
                    u, d, wu, wd = S.climbs(v, mu.as_py(), sigma.as_py(), slack)
                    rows.append((wu[-1], wd[-1], u[-1], d[-1]))
                else:
                    rows.append((0.0,) * 4)
            new = [pa.array([r[i] for r in rows], pa.float64()) for i in range(4)]
            kept = [batch.column(c) for c in (KEY, SLICE, "mu", "sigma")]
            yield pa.RecordBatch.from_arrays([*kept, *new], [KEY, SLICE, "mu", "sigma", "up_total", "down_total", "up_end", "down_end"])

    return run


def detect_cusum(facts: DataFrame, threshold: float = 5.0, k: float = 0.5, reference_window: int | None = None,
                 dim: DataFrame | None = None) -> DataFrame:
    """First alarm per (KPI, cell): the bad side above h, or either side above 2h."""
    return detect_kpi(facts, [CUSUM], {CUSUM: {"threshold": threshold, "k": k, "reference_window": reference_window, "dim": dim}})


def _cusum_alarms(found: DataFrame, gnbs: DataFrame, threshold: float = 5.0, dim: DataFrame | None = None) -> DataFrame:
    first = found.where("what = 'cusum'").groupBy(KEY).agg(F.min_by(F.struct(*ROW), SLICE).alias("r"))
    peak = F.greatest("s_pos", "s_neg")
    out = with_catalogue(_of_cell(first, gnbs), dim).withColumn("severity", F.when(peak > 2 * threshold, "High").otherwise("Medium"))
    return emit(out, CUSUM, F.concat(
        "label", F.lit(": CUSUM drift; S+="), _num("s_pos"), F.lit(", S-="), _num("s_neg"),
        F.lit(f" > h={threshold}; val="), _num("value"), "unit"))


# ---------------------------------------------------------------- Bollinger

def detect_bollinger(facts: DataFrame, window: int = 5, k: float = 2.0, floor: float = 0.5, min_prior: int = 3,
                     dim: DataFrame | None = None) -> DataFrame:
    """Band of the previous 5 readings; the worst break per (KPI, cell), reported with the cell's first gNB.

    The current reading never widens its own band.
    """
    options = {"window": window, "k": k, "floor": floor, "min_prior": min_prior, "dim": dim}
    return detect_kpi(facts, [BOLLINGER], {BOLLINGER: options})


def _bollinger_alarms(found: DataFrame, gnbs: DataFrame, dim: DataFrame | None = None) -> DataFrame:
    worst = found.where("what = 'band'").groupBy(KEY).agg(F.max_by(F.struct(*ROW), F.struct("dev", -F.col(SLICE))).alias("r"))
    out = with_catalogue(_of_cell(worst, gnbs), dim).withColumn("severity", F.when(F.col("dev") > F.col("sd"), "High").otherwise("Medium"))
    return emit(out, BOLLINGER, F.concat(
        "label", F.lit("="), _num("value"), "unit", F.lit(" outside rolling band by "), _num("dev"), "unit"))


# ---------------------------------------------------------------- one pass for all

ROW = ("ts", "seq", "value", "dev", "sd", "s_pos", "s_neg")
FOUND = (
    "what string, ts bigint, seq bigint, value double, dev double, sd double, s_pos double, s_neg double, place int, edge boolean, "
    "run struct<size: bigint, peak: double, any_critical: boolean, begin_ts: bigint, end_ts: bigint, gap_us: bigint, first: array<struct<ts: bigint, seq: bigint, name: string, value: double>>>"
)


def pack(facts: DataFrame) -> DataFrame:
    """Readings of every (KPI, cell) dealt and packed once (see ``functions.series``), with the cell's channel type."""
    kind = None
    if "channel_type" in facts.columns:
        channel = F.upper(F.trim(F.col("channel_type")))
        kind = F.when(channel.isin(sorted({c for c, _, _ in K.CAPACITY})) & (F.trim("cell_id") != ""), channel)
    return S.packed(facts, ["kpi", "cell_id"], "kpi-series", name="gnb_id", kind=kind)


def _of_cell(rows: DataFrame, gnbs: DataFrame) -> DataFrame:
    """One found row per series with its KPI, cell and first gNB."""
    return rows.join(gnbs, KEY).select(
        F.col(f"{KEY}.kpi").alias("kpi"), F.col(f"{KEY}.cell_id").alias("cell_id"), "gnb_id", F.timestamp_micros("r.ts").alias("ts"), *[f"r.{c}" for c in ROW[1:]]
    )


def _hits(value: np.ndarray, warning: float | None, critical: float | None, high: bool) -> tuple[np.ndarray, np.ndarray]:
    """Readings at or over the warning, and those at or over the critical limit; without both limits none."""
    if warning is None or critical is None:
        return np.zeros(len(value), bool), np.zeros(len(value), bool)
    over = value >= critical if high else value <= critical
    return over | (value >= warning if high else value <= warning), over


def _runs(ts, seq, value, names, hit, critical, gap_us: float) -> list[dict]:
    """Runs of hits of one slice, in order."""
    at = np.flatnonzero(hit)
    if not len(at):
        return []
    return [
        {
            "size": len(part), "peak": float(value[part].max()), "any_critical": bool(critical[part].any()),
            "begin_ts": int(ts[part[0]]), "end_ts": int(ts[part[-1]]), "gap_us": int(gap_us),
            "first": [{"ts": int(ts[i]), "seq": int(seq[i]), "name": names[int(i)].as_py(), "value": float(value[i])} for i in part[:RUN_ROWS]],
        }
        for part in np.split(at, np.flatnonzero(np.diff(ts[at]) > gap_us) + 1)
    ]


def _detect(options: dict[str, dict]):
    """The ordered pass: per slice its worst band break, its first CUSUM alarm and its load runs."""
    run_o, cusum_o, band_o = (options.get(n) for n in (THRESHOLD, CUSUM, BOLLINGER))

    def found(row: dict, ts, seq, value, names) -> Iterator[dict]:
        high = row["worse_high"]

        def at(i: int, **more) -> dict:
            return {"ts": int(ts[i]), "seq": int(seq[i]), "value": float(value[i]), **more}

        if run_o is not None and row["kpi"] == run_o.get("kpi", K.PRB_DL):
            runs = _runs(ts, seq, value, names, *_hits(value, row["warning"], row["critical"], high), run_o.get("gap_s", 90.0) * 1e6)
            for place, r in enumerate(runs):
                edge = place in (0, len(runs) - 1)
                if edge or r["size"] >= min(run_o.get("min_critical", 3), run_o.get("min_warning", 5)):
                    yield {"what": "run", "place": place, "edge": edge, "run": r}
        if cusum_o is not None and row["mu"] is not None:
            up, down, *_ = S.climbs(value, row["mu"], row["sigma"], cusum_o.get("k", 0.5), (row["up_from"], row["down_from"]))
            h = cusum_o.get("threshold", 5.0)
            alarm = np.flatnonzero(((up if high else down) > h) | (np.maximum(up, down) > 2 * h))
            if len(alarm):
                yield at(alarm[0], what="cusum", s_pos=float(up[alarm[0]]), s_neg=float(down[alarm[0]]))
        if band_o is not None and row["length"] is not None:
            width = band_o.get("k", 2.0)
            count, mean, sd = S.lagged_band(value, np.array(row["halo"] or [], float), band_o.get("window", 5), 1)
            sd = np.maximum(sd, band_o.get("floor", 0.5))
            dev = value - (mean + width * sd) if high else (mean - width * sd) - value
            dev = np.where(count >= max(band_o.get("min_prior", 3), 2), dev, -np.inf)
            worst = int(dev.argmax())
            if dev[worst] > 0:
                yield at(worst, what="band", dev=float(dev[worst]), sd=float(sd[worst]))

    fields = to_arrow_schema(T.StructType.fromDDL(FOUND))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = batch.select([c for c in batch.schema.names if c not in (KEY, "tss", "seqs", "values", "names")]).to_pylist()
            out, of = [], []
            for i, row in enumerate(told):
                ts = batch.column("tss")[i].values
                first = ts.null_count  # readings without a time come first and take no part
                if len(ts) == first:
                    continue
                seq, value, names = (batch.column(c)[i].values[first:] for c in ("seqs", "values", "names"))
                for f in found(row, ts[first:].to_numpy(), seq.fill_null(NO_SEQ).to_numpy(), value.to_numpy(), names):
                    out.append(f)
                    of.append(i)
            take = pa.array(of, pa.int64())
            columns = [pa.array([f.get(c.name) for f in out], c.type) for c in fields]
            yield pa.RecordBatch.from_arrays([batch.column(KEY).take(take), batch.column(SLICE).take(take), *columns], [KEY, SLICE, *fields.names])

    return run


NO_SEQ = -(1 << 62)


def _pass(slices: DataFrame, options: dict[str, dict]) -> DataFrame:
    """What the ordered detectors find in each slice: at most a few rows per slice, besides long load runs."""
    parts = S.summaries(slices)
    dim = next(iter(options.values())).get("dim")
    kpis = slices.select(F.col(f"{KEY}.kpi").alias("kpi")).distinct()
    limits = with_catalogue(kpis, dim).select(F.col("kpi").alias("_kpi"), _worse_high().alias("worse_high"), "warning", "critical")
    rows = slices.select(KEY, SLICE, "tss", "seqs", "values", "names", F.col(f"{KEY}.kpi").alias("kpi"))
    rows = rows.join(limits, F.col("kpi").eqNullSafe(F.col("_kpi")), "left").drop("_kpi")
    nothing = {"mu": "double", "sigma": "double", "up_from": "double", "down_from": "double", "halo": "array<double>", "length": "bigint"}
    if CUSUM in options:
        o = options[CUSUM]
        rows = rows.join(_begun(slices, o.get("k", 0.5), o.get("reference_window")), [KEY, SLICE], "left")
    if BOLLINGER in options:
        window = options[BOLLINGER].get("window", 5)
        lengths = parts.groupBy(KEY).agg(F.sum("tn").alias("length")).where(F.col("length") >= window + 1)
        rows = rows.join(S.tails_before(parts, "ttail", window), [KEY, SLICE], "left").join(lengths, KEY, "left")
    rows = rows.withColumns({c: F.lit(None).cast(t) for c, t in nothing.items() if c not in rows.columns})
    plain = {n: {k: v for k, v in o.items() if k != "dim"} for n, o in options.items()}
    kind = slices.schema[KEY].dataType.simpleString()
    found = rows.mapInArrow(_detect(plain), f"{KEY} {kind}, {SLICE} bigint, {FOUND}")
    return found if len(options) == 1 and THRESHOLD not in options else cut_lineage(found, "kpi-found")  # read once: not written


KPI_DETECTORS = {
    THRESHOLD: detect_threshold,
    PEER: detect_peers,
    TREND: detect_trend,
    IQR: detect_iqr,
    CUSUM: detect_cusum,
    BOLLINGER: detect_bollinger,
}
RUN_OPTIONS = ("kpi", "gap_s", "min_warning", "min_critical", "dim")


def detect_kpi(facts: DataFrame, detectors=None, options: dict[str, dict] | None = None) -> DataFrame:
    """Alarms of the chosen detectors (default: all six) in one row shape; ``options`` are a detector's own arguments by name.

    The readings are dealt and packed once. Slice summaries alone give peers, trends, quartile fences and
    the moments of CUSUM; one more ordered pass finds band breaks, drifts and load runs together; row limits are a map over
    the readings. Alarms are the same as those of each detector called alone.
    """
    names = list(dict.fromkeys(detectors or KPI_DETECTORS))
    options = {n: dict((options or {}).get(n, {})) for n in names}
    if names in ([PEER], [TREND], [IQR]):  # plain aggregates, no order needed
        return KPI_DETECTORS[names[0]](facts, **options[names[0]])
    slices = pack(facts)
    parts = S.summaries(slices)
    kpi, cell = F.col(f"{KEY}.kpi"), F.col(f"{KEY}.cell_id")
    ordered = {n: {k: v for k, v in options[n].items() if n != THRESHOLD or k in RUN_OPTIONS} for n in names if n in (THRESHOLD, CUSUM, BOLLINGER)}
    if ordered:
        dims = {id(o.get("dim")) for o in ordered.values()}  # one pass per catalogue
        found = reduce(DataFrame.unionByName, [_pass(slices, {n: o for n, o in ordered.items() if id(o.get("dim")) == d}) for d in dims])
        gnbs = parts.where(F.col("tn") > 0).groupBy(KEY).agg(F.min_by("tfirst_name", SLICE).alias("gnb_id"))
    out = []
    for n in names:
        o = options[n]
        if n == THRESHOLD:
            caps = o.get("capacities")
            if caps is None:
                seen = parts.where(F.col("kind").isNotNull()).select(cell.alias("cell_id"), F.col("kind").alias("channel_type"), F.col("kind_seq").alias("seq"))
                caps = capacity_map(seen)
            rows = facts.where(F.col("value").isNotNull() & (F.col("kpi") != o.get("kpi", K.PRB_DL)))
            out.append(_row_limits(capacity_share(rows, caps), o.get("dim")))
            out.append(_run_alarms(found, o.get("dim"), o.get("min_warning", 5), o.get("min_critical", 3)))
        elif n == PEER:
            cells = parts.where(F.col("n") > 0).groupBy(kpi.alias("kpi"), cell.alias("cell_id")).agg(
                (F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("value"), F.min_by("first_name", F.struct("first_seq", "first_name")).alias("gnb_id")
            )
            out.append(_peer_alarms(cells, **o))
        elif n == TREND:
            line = S.merged(parts.where(F.col("tn") > 0), [kpi])
            out.append(_trend_alarms(line.select(
                F.col("_g0").alias("kpi"), S.slope().alias("slope"), (F.col("tmu") - S.slope() * F.col("xmu")).alias("icept"), "x0", "x1", F.col("TN").alias("n")
            ), **o))
        elif n == IQR:
            counts = S.digit_counts(parts, F.struct(kpi.alias("kpi")))
            quartiles = O.percentiles_of_digits(counts, _values_in(slices), ["kpi"], [0.25, 0.75])
            out.append(_iqr_alarms(_fence_breaks(slices, _fences(quartiles, o.get("k", 1.5), o.get("min_points", 4))), o.get("dim")))
        elif n == CUSUM:
            out.append(_cusum_alarms(found, gnbs, o.get("threshold", 5.0), o.get("dim")))
        elif n == BOLLINGER:
            out.append(_bollinger_alarms(found, gnbs, o.get("dim")))
    return reduce(DataFrame.unionByName, out)


def _values_in(slices: DataFrame):
    """For ``ordered.percentiles_of_digits``: readings whose leading digit is wanted, counted within slices."""

    def picked(wanted: DataFrame) -> DataFrame:
        digits = wanted.groupBy(F.col(f"{KEY}.kpi").alias("kpi")).agg(F.collect_set("_prefix").alias("digits"))
        rows = slices.select(F.col(f"{KEY}.kpi").alias("kpi"), "values").join(digits, "kpi")
        out = rows.mapInArrow(S.values_of_digits("kpi"), "kpi string, _prefix bigint, _bits bigint, _c bigint")
        return out.select(F.struct("kpi").alias(KEY), "_prefix", "_bits", "_c")

    return picked


def _fence_breaks(slices: DataFrame, fence: DataFrame) -> DataFrame:
    """Readings outside their KPI's fence; slices wholly inside are not opened."""
    wanted = slices.select(F.col(f"{KEY}.kpi").alias("kpi"), F.col(f"{KEY}.cell_id").alias("cell_id"), "summary.lo", "summary.hi", "tss", "seqs", "values", "names")
    rows = wanted.withColumnsRenamed({"lo": "_lo", "hi": "_hi"}).join(fence, "kpi").where((F.col("_lo") < F.col("lo")) | (F.col("_hi") > F.col("hi")))
    each = F.filter(F.arrays_zip("tss", "seqs", "values", "names"), lambda r: (r["values"] < F.col("lo")) | (r["values"] > F.col("hi")))
    return rows.select("kpi", "cell_id", "iqr", "lo", "hi", F.explode(each).alias("r")).select(
        "kpi", "cell_id", "iqr", "lo", "hi", F.timestamp_micros("r.tss").alias("ts"), F.col("r.seqs").alias("seq"), F.col("r.values").alias("value"), F.col("r.names").alias("gnb_id")
    )


def ranked(anomalies: DataFrame) -> DataFrame:
    """Most severe first, then by score."""
    return anomalies.orderBy(severity_rank().desc(), F.col("score").desc_nulls_last())
