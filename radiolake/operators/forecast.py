"""Forecasts per (cell, metric) series and the anomalies they predict.

Series rows: cell_id, kpi, ts, seq, value.  Every method reduces a series to a
small state with mergeable aggregates, so series length is not limited by a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from radiolake.catalogue import counters as C
from radiolake.catalogue import kpi as K
from radiolake.functions import ordered as O
from radiolake.functions.columns import contains_any, hours, rnd
from radiolake.operators.derive import sampling_interval

KEYS = ["cell_id", "kpi"]
ORDER = ["ts", "seq"]
MIN_ROWS, HORIZON_H, LAST = 24, 4.0, 5
# Words that mark a metric as bad when high, when no direction is known.
HIGH_IS_BAD = ("bler", "prb", "nack", "latency", "loss", "drop")


def known(series: DataFrame) -> DataFrame:
    return series.where(F.col("value").isNotNull() & F.col("ts").isNotNull())


def horizon_periods(freq_s: Column, horizon_h: float = HORIZON_H) -> Column:
    return F.greatest(F.lit(1), F.floor(F.lit(horizon_h * 3600.0) / F.nullif(freq_s, F.lit(0).cast("double"))).cast("int"))


def with_horizon(df: DataFrame, freq: DataFrame, horizon_h: float = HORIZON_H) -> DataFrame:
    """Attach the sampling interval (a one-row frame, read as a scalar) and the number of periods ahead.

    Without a usable interval (none, or zero because times repeat) there is no forecast: no rows.
    """
    timed = df.withColumn("freq_s", F.nullif(freq.scalar(), F.lit(0).cast("double"))).where(F.col("freq_s") > 0)
    return timed.withColumn("h", horizon_periods(F.col("freq_s"), horizon_h))


# ---------------------------------------------------------------- trend with band

def forecast_trend(series: DataFrame, freq: DataFrame | None = None, horizon_h: float = HORIZON_H,
                   min_rows: int = MIN_ROWS) -> DataFrame:
    """Straight-line trend over time with a 95 % band from the residuals; one row per series."""
    rows = known(series)
    freq = freq if freq is not None else sampling_interval(series)
    fit = rows.withColumn("x", hours("ts")).groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope("value", "x").alias("slope"),
        F.regr_intercept("value", "x").alias("icept"),
        F.greatest(F.var_pop("value") - F.pow(F.covar_pop("value", "x"), F.lit(2.0)) / F.nullif(F.var_pop("x"), F.lit(0.0)), F.lit(0.0)).alias("_mse"),
        F.max("x").alias("x_last"),
        F.max("ts").alias("last_ts"),
    ).where(F.col("n") >= min_rows)
    out = with_horizon(fit, freq, horizon_h)
    middle = F.col("x_last") + F.col("freq_s") / 3600.0 * (F.col("h") + 1) / 2.0
    mean = F.col("icept") + F.col("slope") * middle
    band = 1.96 * F.sqrt(F.col("_mse") * F.col("n") / F.greatest(F.col("n") - 2, F.lit(1)))
    return out.withColumns({"forecast": mean, "forecast_high": mean + band}).drop("_mse")


PIECE = "struct<seg: int, n: double, su: double, suu: double, sv: double, suv: double, svv: double>"
PIECEWISE = "cell_id string, kpi string, n bigint, x_last double, last_us bigint, slope double, icept double, sse double, dof double, changes array<struct<x: double, change: double>>"


def hinge_fit(pieces: np.ndarray, knots: np.ndarray, prior: float, amplitude: float, rounds: int) -> tuple[np.ndarray, float, float]:
    """Coefficients (level, slope, slope changes), squared error and degrees of freedom of a penalised piecewise line on [0, 1].

    ``pieces`` are rows (segment, n, sum u, sum u*u, sum v, sum u*v, sum v*v); within a segment every hinge (u - knot)+ is a
    line, so these sums give the normal equations exactly. Slope changes are drawn to zero with the weight of
    the noise over ``(prior * amplitude)**2``; the noise is that of the last of ``rounds`` fits, first the straight line's.
    """
    size = len(knots) + 2
    gram, right = np.zeros((size, size)), np.zeros(size)
    for seg, n, su, suu, sv, suv, _ in pieces:
        lines = np.zeros((size, 2))
        lines[0], lines[1] = (1, 0), (0, 1)
        upto = int(seg)
        lines[2 : 2 + upto] = np.column_stack([-knots[:upto], np.ones(upto)])
        gram += lines @ np.array([[n, su], [su, suu]]) @ lines.T
        right += lines @ np.array([sv, suv])
    count, squares = pieces[:, 1].sum(), pieces[:, 6].sum()
    error = lambda b: max(float(squares - 2 * b @ right + b @ gram @ b), 0.0)
    straight = np.linalg.lstsq(gram[:2, :2], right[:2], rcond=None)[0]
    fit = np.concatenate([straight, np.zeros(len(knots))])
    dof = 2.0
    for _ in range(rounds if len(knots) else 0):
        weight = max(error(fit) / count / (prior * amplitude) ** 2 if amplitude else 0.0, 1e-9)
        held = gram + np.diag([0.0, 0.0] + [weight] * len(knots))
        new = np.linalg.lstsq(held, right, rcond=None)[0]
        dof = float(np.trace(np.linalg.lstsq(held, gram, rcond=None)[0]))
        settled = np.allclose(new, fit, rtol=1e-9, atol=1e-12)
        fit = new
        if settled:
            break
    return fit, error(fit), dof


def _piecewise_of(breaks: int, share: float, prior: float, rounds: int):
    knots = share * np.arange(1, breaks + 1) / max(breaks, 1)
    schema = to_arrow_schema(T.StructType.fromDDL(PIECEWISE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                pieces = np.array([[p[k] for k in ("seg", "n", "su", "suu", "sv", "suv", "svv")] for p in row["pieces"]], float)
                span = row["x1"] - row["x0"]
                fit, sse, dof = hinge_fit(pieces, knots, prior, row["amplitude"], rounds)
                slope = float(fit[1:].sum()) / span
                level = float(fit[0] + fit[1] + (fit[2:] * (1 - knots)).sum())
                out.append({
                    "cell_id": row["cell_id"], "kpi": row["kpi"], "n": int(pieces[:, 1].sum()), "x_last": row["x1"], "last_us": row["last_us"], "slope": slope,
                    "icept": level - slope * row["x1"], "sse": sse, "dof": dof,
                    "changes": [{"x": row["x0"] + float(k) * span, "change": float(d) / span} for k, d in zip(knots, fit[2:])],
                })
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def forecast_piecewise(series: DataFrame, freq: DataFrame | None = None, horizon_h: float = HORIZON_H, min_rows: int = MIN_ROWS,
                       breaks: int = 25, share: float = 0.8, prior: float = 0.1, rounds: int = 50) -> DataFrame:
    """Piecewise-linear trend with a 95 % band; one row per series, like ``forecast_trend``, with the slope changes found.

    ``breaks`` knots are set at equal steps over the first ``share`` of a series' time. Slopes may change at each, held back
    by a penalty: ``prior`` is how far, as a part of the largest reading, a change over the whole time may
    reach. The last slope goes on into the horizon. Without breaks it is the straight line of ``forecast_trend``.

    A series is reduced to sums per segment, combined on the map side, so at most ``breaks + 1`` rows of a
    series meet in one task, where a system of that size is solved. Series whose readings are all of one time have no trend.
    """
    rows = known(series).select(*KEYS, "ts", "value", hours("ts").alias("x"))
    freq = freq if freq is not None else sampling_interval(series)
    ends = rows.groupBy(*KEYS).agg(
        F.expr("count(1) AS rows"), F.expr("min(x) AS x0"), F.expr("max(x) AS x1"), F.expr("max(unix_micros(ts)) AS last_us"), F.expr("max(abs(value)) AS amplitude")
    ).where((F.col("rows") >= min_rows) & (F.col("x1") > F.col("x0")))
    placed = rows.join(ends, KEYS).withColumn("u", F.expr("(x - x0) / (x1 - x0)"))
    seg = F.expr(f"cast(least(floor(u * {breaks} / {float(share)}D + 1e-9D), {breaks}) AS int)") if breaks else F.lit(0)
    sums = placed.groupBy(*KEYS, "x0", "x1", "last_us", "amplitude", seg.alias("seg")).agg(*[F.expr(f"{e} AS {c}") for c, e in {
        "n": "cast(count(1) AS double)", "su": "sum(u)", "suu": "sum(u * u)", "sv": "sum(value)", "suv": "sum(u * value)", "svv": "sum(value * value)",
    }.items()])
    gathered = sums.groupBy(*KEYS).agg(
        *[F.expr(f"max({c}) AS {c}") for c in ("x0", "x1", "last_us", "amplitude")],
        F.array_sort(F.collect_list(F.struct("seg", "n", "su", "suu", "sv", "suv", "svv"))).alias("pieces"),
    )
    fit = gathered.mapInArrow(_piecewise_of(breaks, share, prior, rounds), PIECEWISE)
    out = with_horizon(fit.withColumn("last_ts", F.timestamp_micros("last_us")), freq, horizon_h)
    middle = F.col("x_last") + F.col("freq_s") / 3600.0 * (F.col("h") + 1) / 2.0
    mean = F.col("icept") + F.col("slope") * middle
    band = 1.96 * F.sqrt(F.col("sse") / F.greatest(F.col("n") - F.col("dof"), F.lit(1.0)))
    return out.withColumns({"forecast": mean, "forecast_high": mean + band}).drop("sse", "dof", "last_us")


def trend_path(fitted: DataFrame) -> DataFrame:
    """The single points ahead of a fitted trend."""
    step = F.explode(F.sequence(F.lit(1), F.col("h"))).alias("step")
    pts = fitted.select("*", step)
    return pts.select(
        *KEYS, "step",
        F.timestamp_micros((F.unix_micros("last_ts") + F.col("step") * F.col("freq_s") * 1e6).cast("bigint")).alias("ts"),
        (F.col("icept") + F.col("slope") * (F.col("x_last") + F.col("step") * F.col("freq_s") / 3600.0)).alias("yhat"),
    )


# ---------------------------------------------------------------- baselines

def baselines(series: DataFrame, freq: DataFrame | None = None, horizon_h: float = HORIZON_H,
              min_rows: int = MIN_ROWS) -> DataFrame:
    """Last value, drift and mean of the last five, averaged over the horizon."""
    rows = known(series)
    freq = freq if freq is not None else sampling_interval(series)
    ends = rows.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by("value", F.struct(*ORDER)).alias("first"),
        F.max_by("value", F.struct(*ORDER)).alias("last"),
    ).where(F.col("n") >= min_rows)
    newest = Window.partitionBy(*KEYS).orderBy(F.col("ts").desc(), F.col("seq").desc())
    last5 = (
        rows.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= LAST)
        .groupBy(*KEYS).agg(F.avg("value").alias("mean5"))
    )
    out = with_horizon(ends.join(last5, KEYS), freq, horizon_h)
    slope = (F.col("last") - F.col("first")) / (F.col("n") - 1)
    return out.select(*KEYS, "n", F.col("last").alias("naive"), (F.col("last") + slope * (F.col("h") + 1) / 2.0).alias("drift"), "mean5")


# ---------------------------------------------------------------- damped trend smoothing

GRID = [(a, b, p) for a in (0.1, 0.3, 0.5, 0.8) for b in (0.05, 0.3) for p in (0.80, 0.90, 0.98)]
STATE = ["p00", "p01", "p10", "p11", "q0", "q1", "a", "b0", "b1", "c00", "c01", "c11"]


def _fold_columns(y: np.ndarray, grid: Sequence[tuple]) -> list[np.ndarray]:
    """Effect of each column of readings on smoothing, for every parameter set at once.

    Smoothing is linear in its starting state (level, trend): the end state is
    P s + q and the squared one-step errors are a + 2 b.s + s'C s.  Shapes are
    (columns, sets, ...).
    """
    al, be, ph = (np.array(c) for c in zip(*grid))
    shape = (y.shape[1], len(grid))
    p = np.zeros((*shape, 2, 2))
    p[..., 0, 0] = p[..., 1, 1] = 1.0
    q = np.zeros((*shape, 2))
    a, b, c = np.zeros(shape), np.zeros((*shape, 2)), np.zeros((*shape, 2, 2))
    for row in y:
        ahead_p = p[..., 0, :] + ph[:, None] * p[..., 1, :]
        ahead_q = q[..., 0] + ph * q[..., 1]
        e = row[:, None] - ahead_q
        a += e * e
        b -= e[..., None] * ahead_p
        c += ahead_p[..., :, None] * ahead_p[..., None, :]
        p[..., 1, :] = ph[:, None] * p[..., 1, :] - (al * be)[:, None] * ahead_p
        q[..., 1] = ph * q[..., 1] + al * be * e
        p[..., 0, :] = ahead_p - al[:, None] * ahead_p
        q[..., 0] = ahead_q + al * e
    return [p, q, a, b, c]


def _then(first: list[np.ndarray], second: list[np.ndarray]) -> list[np.ndarray]:
    """Effect of two stretches, one after the other."""
    (p, q, a, b, c), (bp, bq, ba, bb, bc) = first, second
    cq = np.einsum("gij,gj->gi", bc, q)
    return [
        bp @ p,
        np.einsum("gij,gj->gi", bp, q) + bq,
        a + ba + 2 * (bb * q).sum(1) + (q * cq).sum(1),
        b + np.einsum("gji,gj->gi", p, bb + cq),
        c + np.einsum("gji,gjk,gkl->gil", p, bc, p),
    ]


def _fold(values: np.ndarray, grid: Sequence[tuple] = GRID) -> np.ndarray:
    """Fold a stretch of readings: equal pieces side by side, then joined in order."""
    size = max(1, int(np.sqrt(len(values))))
    whole = len(values) // size * size
    pieces = _fold_columns(values[:whole].reshape(-1, size).T, grid)
    out = [x[0] for x in pieces]
    for i in range(1, whole // size):
        out = _then(out, [x[i] for x in pieces])
    if whole < len(values):
        out = _then(out, [x[0] for x in _fold_columns(values[whole:, None], grid)])
    p, q, a, b, c = out
    return np.column_stack([p.reshape(len(grid), 4), q, a, b, c[:, 0, 0], c[:, 0, 1], c[:, 1, 1]])


def smoothing_blocks(numbered: DataFrame, keys: Sequence[str], block: Column, value: str = "value") -> DataFrame:
    """One summary row per (series, block, parameter set)."""
    keys = list(keys)
    rows = numbered.select(*keys, block.cast("bigint").alias("block"), "rn", F.col(value).alias("value"))
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + ["block bigint", "g int", "len bigint"] + [f"{s} double" for s in STATE])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn")
        out = pd.DataFrame(_fold(pdf["value"].to_numpy(dtype=float)), columns=STATE)
        for k in keys:
            out[k] = pdf[k].iloc[0]
        out["block"], out["g"], out["len"] = int(pdf["block"].iloc[0]), range(len(GRID)), len(pdf)
        return out[[*keys, "block", "g", "len", *STATE]]

    return rows.groupBy(*keys, "block").applyInPandas(fold, schema)


def smoothing_states(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Best smoothing after each block: parameters by least squared error, start state solved exactly.

    Works on block summaries: a group holds one row per block and parameter
    set, not the readings.
    """
    keys = list(keys)
    types = {f.name: f.dataType.simpleString() for f in blocks.schema.fields}
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + ["block bigint", "g int", "n bigint", "level double", "trend double", "sse double"])

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["block", "g"])
        g = pdf["g"].nunique()
        st = {c: pdf[c].to_numpy().reshape(-1, g) for c in STATE}
        blocks, lens = pdf["block"].to_numpy().reshape(-1, g)[:, 0], pdf["len"].to_numpy().reshape(-1, g)[:, 0]
        total = [np.tile(np.eye(2), (g, 1, 1)), np.zeros((g, 2)), np.zeros(g), np.zeros((g, 2)), np.zeros((g, 2, 2))]
        n, rows = 0, []
        for i, block in enumerate(blocks):
            s = {name: st[name][i] for name in STATE}
            total = _then(total, [
                np.stack([s["p00"], s["p01"], s["p10"], s["p11"]], axis=1).reshape(g, 2, 2),
                np.stack([s["q0"], s["q1"]], axis=1), s["a"], np.stack([s["b0"], s["b1"]], axis=1),
                np.stack([s["c00"], s["c01"], s["c01"], s["c11"]], axis=1).reshape(g, 2, 2),
            ])
            p, q, a, b, c = total
            n += int(lens[i])
            s0 = -np.einsum("gij,gj->gi", np.linalg.pinv(c, rcond=1e-10, hermitian=True), b)
            sse = a + 2 * (b * s0).sum(1) + np.einsum("gi,gij,gj->g", s0, c, s0)
            best = int(np.argmin(np.maximum(sse, 0.0)))
            end = p[best] @ s0[best] + q[best]
            rows.append((int(block), best, n, end[0], end[1], max(float(sse[best]), 0.0)))
        out = pd.DataFrame(rows, columns=["block", "g", "n", "level", "trend", "sse"])
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "block", "g", "n", "level", "trend", "sse"]]

    best = blocks.groupBy(*keys).applyInPandas(combine, schema)
    return best.withColumn("phi", F.get(F.array(*[F.lit(p) for _, _, p in GRID]), F.col("g")))


def damped_sum(phi: Column, steps: Column) -> Column:
    """phi + phi^2 + ... + phi^steps."""
    return phi * (1.0 - F.pow(phi, steps.cast("double"))) / (1.0 - phi)


def forecast_smoothing(series: DataFrame, freq: DataFrame | None = None, horizon_h: float = HORIZON_H,
                       min_rows: int = MIN_ROWS, seasonal_periods: int | None = None,
                       block: int = O.BLOCK) -> DataFrame:
    """Damped additive trend smoothing with optional additive seasonality; one row per series."""
    freq = freq if freq is not None else sampling_interval(series)
    rows = O.numbered(known(series), KEYS, ORDER).where(F.col("n") >= min_rows)
    value = "value"
    season = None
    if seasonal_periods:
        m = int(seasonal_periods)
        rows = rows.withColumn("_phase", F.pmod(F.col("rn") - 1, F.lit(m)))
        phase = rows.groupBy(*KEYS, "_phase", "n").agg(F.avg("value").alias("_pm"), F.count(F.lit(1)).alias("_pc"))
        w = Window.partitionBy(*KEYS)
        centre = F.sum(F.col("_pm") * F.col("_pc")).over(w) / F.sum("_pc").over(w)
        season = phase.select(*KEYS, "_phase", F.when(F.col("n") >= 2 * m, F.col("_pm") - centre).otherwise(0.0).alias("_s"))
        rows = rows.join(season, [*KEYS, "_phase"]).withColumn("_adj", F.col("value") - F.col("_s"))
        value = "_adj"
    states = smoothing_states(smoothing_blocks(rows, KEYS, F.floor((F.col("rn") - 1) / F.lit(block)), value), KEYS)
    last = states.groupBy(*KEYS).agg(F.max_by(F.struct("n", "level", "trend", "sse", "phi"), "block").alias("r")).select(*KEYS, "r.*")
    out = with_horizon(last, freq, horizon_h)
    steps = F.sequence(F.lit(1), F.col("h"))
    path = F.transform(steps, lambda i: F.col("level") + F.col("trend") * damped_sum(F.col("phi"), i))
    if season is not None:
        table = season.groupBy(*KEYS).agg(F.map_from_entries(F.collect_list(F.struct("_phase", "_s"))).alias("_sm"))
        m = int(seasonal_periods)
        at = lambda i: F.element_at("_sm", F.pmod(F.col("n") + i - 1, F.lit(m)))
        out = out.join(table, KEYS)
        path = F.transform(steps, lambda i: F.col("level") + F.col("trend") * damped_sum(F.col("phi"), i) + at(i))
    out = out.withColumn("path", path)
    total = F.aggregate("path", F.lit(0.0), lambda s, v: s + v)
    return out.withColumns({"forecast": total / F.col("h"), "forecast_high": F.array_max("path")}).select(
        *KEYS, "n", "level", "trend", "phi", "sse", "h", "path", "forecast", "forecast_high"
    )


# ---------------------------------------------------------------- user models

def forecast_each(series: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, context: int,
                  keys: Sequence[str] = KEYS) -> DataFrame:
    """Run a user model per series on the last ``context`` readings, the length the model reads."""
    newest = Window.partitionBy(*keys).orderBy(F.col("ts").desc(), F.col("seq").desc())
    rows = known(series).withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= context)
    return rows.drop("_r").groupBy(*keys).applyInPandas(lambda pdf: fn(pdf.sort_values(ORDER)), schema)


# ---------------------------------------------------------------- predicted anomalies

def limits_dim(spark) -> DataFrame:
    """Limits for any metric: counters that have a warning, then KPIs that have one."""
    words = lambda m: any(w in m.lower() for w in HIGH_IS_BAD)
    rows = {k[0]: (k[0], k[6], k[7], k[4] == K.LOWER) for k in K.KPIS if k[6] is not None}
    rows.update({m: (m, w, c, words(m)) for m, _, _, w, c in C.COUNTERS if w is not None})
    return spark.createDataFrame(list(rows.values()), "kpi string, warning double, critical double, worse_high boolean")


def forecast_severity(value: Column) -> Column:
    """Critical / High / Low of a forecast against joined limits; no limits means Low."""
    high = F.coalesce("worse_high", contains_any(F.lower("kpi"), HIGH_IS_BAD))
    crit = F.when(high, value >= F.col("critical")).otherwise(value <= F.col("critical"))
    warn = F.when(high, value >= F.col("warning")).otherwise(value <= F.col("warning"))
    return F.when(F.col("warning").isNull(), "Low").when(crit, "Critical").when(warn, "High").otherwise("Low")


def predicted_anomalies(forecasts: DataFrame, method: str, horizon_h: float = HORIZON_H, dim: DataFrame | None = None) -> DataFrame:
    """Forecasts that break a limit; Medium when only the upper value does."""
    dim = dim if dim is not None else F.broadcast(limits_dim(forecasts.sparkSession))
    j = forecasts.join(dim, "kpi", "left")
    own, high = forecast_severity(F.col("forecast")), forecast_severity(F.col("forecast_high"))
    j = j.withColumn("severity", F.when(own != "Low", own).when(high != "Low", "Medium")).where(F.col("severity").isNotNull())
    return j.select(
        F.col("kpi").alias("label"), F.col("kpi").alias("category"), "cell_id", F.col("cell_id").alias("gnb_id"),
        rnd("forecast", 3).alias("value"), F.lit("").alias("unit"), "severity",
        F.format_string(f"{method} forecast: %s will reach %.2f (upper=%.2f) in {horizon_h:g}h", F.col("kpi"), F.col("forecast"), F.col("forecast_high")).alias("evidence"),
        F.concat(F.lit("Predicted "), F.lower("severity"), F.lit(" anomaly in "), "kpi", F.lit(f" within {horizon_h:g}h. Take proactive action now before threshold breach.")).alias("recommendation"),
        F.lit(f"Prediction ({method})").alias("detector"), rnd(F.abs("forecast"), 3).alias("score"),
        F.lit("predicted").alias("state"), F.lit(float(horizon_h)).alias("lead_time_h"), F.lit("prediction").alias("source"),
    )


# ---------------------------------------------------------------- supervised windows

def supervised_windows(series: DataFrame, lookback: int = 12, horizon: int = 4, train_share: float = 0.8,
                       block: int = O.BLOCK) -> DataFrame:
    """Standardised (past ``lookback``, next ``horizon``) pairs with a time-ordered split."""
    rows = O.with_moments(O.numbered(known(series), KEYS, ORDER), KEYS, "value")
    rows = rows.withColumn("z", (F.col("value") - F.col("_mu")) / F.when(F.col("_sigma") > 0, F.col("_sigma")).otherwise(1.0))
    spread, w, own = O.blocked(rows, KEYS, before=lookback - 1, after=horizon, block=block)
    out = spread.withColumns(
        {
            "x": F.collect_list("z").over(w.rowsBetween(-(lookback - 1), 0)),
            "y": F.collect_list("z").over(w.rowsBetween(1, horizon)),
        }
    ).where(own & (F.size("x") == lookback) & (F.size("y") == horizon))
    windows = F.col("n") - (lookback + horizon) + 1
    place = F.col("rn") - lookback + 1
    return out.select(
        *KEYS, "rn", "ts", "x", "y", F.col("_mu").alias("mu"), F.col("_sigma").alias("sigma"),
        F.when(place <= F.floor(windows * train_share), "train").otherwise("test").alias("split"),
    )


def fit_window_model(windows: DataFrame, reg: float = 0.01):
    """Linear one-step learner on the training windows (MLlib, distributed)."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression

    data = windows.where(F.col("split") == "train").select(array_to_vector("x").alias("features"), F.get("y", F.lit(0)).alias("label"))
    return LinearRegression(regParam=reg, solver="normal").fit(data)


def score_windows(model, windows: DataFrame) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    out = model.transform(windows.withColumn("features", array_to_vector("x")))
    back = lambda c: c * F.when(F.col("sigma") > 0, F.col("sigma")).otherwise(1.0) + F.col("mu")
    return out.select(*KEYS, "rn", "split", back(F.col("prediction")).alias("yhat"), back(F.get("y", F.lit(0))).alias("actual"))
