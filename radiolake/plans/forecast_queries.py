"""Forecast and back-test queries on binding A."""

from __future__ import annotations

from pyspark.sql import functions as F

from radiolake.functions.columns import rnd
from radiolake.operators import evaluate as V
from radiolake.operators import forecast as P
from radiolake.plans.bindings import KPI_CTE, Tables, values_cte
from radiolake.plans.registry import query, r
from radiolake.catalogue import counters as C
from radiolake.catalogue import kpi as K

FREQ_CTE = f"""{KPI_CTE}, fd AS (SELECT cell_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY cell_id ORDER BY ts, seq))) / 1e6 AS g FROM kpi_long),
 fm AS (SELECT quantile_cont(g, 0.5) AS m FROM fd WHERE g IS NOT NULL GROUP BY cell_id),
 fq AS (SELECT quantile_cont(m, 0.5) AS freq, greatest(1, CAST(floor(4 * 3600.0 / quantile_cont(m, 0.5)) AS INTEGER)) AS h,
  greatest(1, CAST(floor(3600.0 / quantile_cont(m, 0.5)) AS INTEGER)) AS s FROM fm)"""
TREND_CTE = f"""{FREQ_CTE}, tx AS (SELECT *, (epoch_us(ts) - min(epoch_us(ts)) OVER ()) / 1e6 / 3600.0 AS x FROM kpi_long),
 tf AS (SELECT cell_id, kpi, count(*) AS n, regr_slope(value, x) AS slope, regr_intercept(value, x) AS icept,
  greatest(var_pop(value) - pow(covar_pop(value, x), 2) / var_pop(x), 0) AS mse, max(x) AS xl FROM tx GROUP BY ALL),
 tr AS (SELECT cell_id, kpi, n, h, icept + slope * (xl + freq / 3600.0 * (h + 1) / 2.0) AS fc, 1.96 * sqrt(mse * n / greatest(n - 2, 1)) AS band,
  icept, slope, xl, freq FROM tf, fq WHERE n >= 24)"""


@query("for2", f"WITH {TREND_CTE} SELECT cell_id, kpi, n, h, {r('fc', 3)} AS forecast, {r('fc + band', 3)} AS forecast_high FROM tr")
def for2(t: Tables):
    out = P.forecast_trend(t.kpi)
    return out.select("cell_id", "kpi", "n", "h", rnd("forecast", 3).alias("forecast"), rnd("forecast_high", 3).alias("forecast_high"))


@query("for2_path", f"WITH {TREND_CTE} SELECT cell_id, kpi, i AS step, {r('icept + slope * (xl + i * freq / 3600.0)', 3)} AS yhat FROM tr, range(1, 1000) t(i) WHERE i <= h")
def for2_path(t: Tables):
    return P.trend_path(P.forecast_trend(t.kpi)).select("cell_id", "kpi", F.col("step").cast("bigint").alias("step"), rnd("yhat", 3).alias("yhat"))


PIECEWISE_SQL = f"""WITH {FREQ_CTE}, hx AS (SELECT *, epoch_us(ts) / 1e6 / 3600.0 AS x FROM kpi_long),
 pe AS (SELECT cell_id, kpi, count(*) AS n, min(x) AS x0, max(x) AS x1, max(abs(value)) AS amp FROM hx GROUP BY ALL HAVING count(*) >= 24),
 pu AS (SELECT hx.cell_id, hx.kpi, value AS v, (x - x0) / (x1 - x0) AS u, greatest((x - x0) / (x1 - x0) - 0.8, 0) AS z FROM hx JOIN pe USING (cell_id, kpi)),
 ps AS (SELECT cell_id, kpi, count(*)::DOUBLE AS n, sum(u) AS su, sum(u * u) AS suu, sum(z) AS sz, sum(z * z) AS szz, sum(u * z) AS suz, sum(v) AS sv, sum(u * v) AS suv, sum(z * v) AS szv, sum(v * v) AS svv,
  greatest(var_pop(v) - pow(covar_pop(v, u), 2) / var_pop(u), 0) AS mse FROM pu GROUP BY ALL),
 pl AS (SELECT ps.*, x0, x1, szz + greatest(mse / pow(0.1 * amp, 2), 1e-9) AS s3 FROM ps JOIN pe USING (cell_id, kpi)),
 pd AS (SELECT *, n * (suu * s3 - suz * suz) - su * (su * s3 - suz * sz) + sz * (su * suz - suu * sz) AS det FROM pl),
 pc AS (SELECT *, (sv * (suu * s3 - suz * suz) - su * (suv * s3 - suz * szv) + sz * (suv * suz - suu * szv)) / det AS a,
  (n * (suv * s3 - suz * szv) - sv * (su * s3 - suz * sz) + sz * (su * szv - suv * sz)) / det AS b,
  (n * (suu * szv - suv * suz) - su * (su * szv - suv * sz) + sv * (su * suz - suu * sz)) / det AS d FROM pd)
 SELECT cell_id, kpi, n::BIGINT AS n, h, {r('a + b + 0.2 * d + (b + d) / (x1 - x0) * (freq / 3600.0 * (h + 1) / 2.0)', 3)} AS forecast, {r('d / (x1 - x0)', 5)} AS change FROM pc, fq"""


@query("for2_piecewise", PIECEWISE_SQL)
def for2_piecewise(t: Tables):
    """One knot and one round, which SQL can solve in closed form; the tests hold many knots against plain least squares."""
    out = P.forecast_piecewise(t.kpi, breaks=1, rounds=1)
    return out.select("cell_id", "kpi", "n", "h", rnd("forecast", 3).alias("forecast"), rnd(F.col("changes")[0]["change"], 5).alias("change"))


@query("for4", f"""WITH {FREQ_CTE}, e AS (SELECT cell_id, kpi, count(*) AS n, arg_min(value, (ts, seq)) AS f, arg_max(value, (ts, seq)) AS l FROM kpi_long GROUP BY ALL),
 m AS (SELECT cell_id, kpi, avg(value) AS mean5 FROM (SELECT *, row_number() OVER (PARTITION BY cell_id, kpi ORDER BY ts DESC, seq DESC) AS k FROM kpi_long) WHERE k <= 5 GROUP BY ALL)
 SELECT cell_id, kpi, n, l AS naive, {r('l + (l - f) / (n - 1) * (h + 1) / 2.0', 4)} AS drift, {r('mean5', 4)} AS mean5 FROM e JOIN m USING (cell_id, kpi), fq WHERE n >= 24""")
def for4(t: Tables):
    return P.baselines(t.kpi).select("cell_id", "kpi", "n", "naive", rnd("drift", 4).alias("drift"), rnd("mean5", 4).alias("mean5"))


@query("for1")
def for1(t: Tables):
    out = P.forecast_smoothing(t.kpi)
    return out.select("cell_id", "kpi", "n", "phi", rnd("forecast", 3).alias("forecast"), rnd("forecast_high", 3).alias("forecast_high"), rnd("sse", 2).alias("sse"))


@query("for1_seasonal")
def for1_seasonal(t: Tables):
    out = P.forecast_smoothing(t.kpi, seasonal_periods=6)
    return out.select("cell_id", "kpi", "n", rnd("forecast", 3).alias("forecast"), rnd("forecast_high", 3).alias("forecast_high"))


@query("for3", f"""WITH {KPI_CTE}, l AS (SELECT *, row_number() OVER (PARTITION BY cell_id, kpi ORDER BY ts DESC, seq DESC) AS k FROM kpi_long)
 SELECT cell_id, kpi, {r('median(value)', 4)} AS yhat FROM l WHERE k <= 32 GROUP BY ALL""")
def for3(t: Tables):
    import pandas as pd

    def median_model(pdf):
        return pd.DataFrame({"cell_id": [pdf["cell_id"].iloc[0]], "kpi": [pdf["kpi"].iloc[0]], "yhat": [float(pdf["value"].median())]})

    out = P.forecast_each(t.kpi, median_model, "cell_id string, kpi string, yhat double", context=32)
    return out.select("cell_id", "kpi", rnd("yhat", 4).alias("yhat"))


LIMITS = {k[0]: (k[0], k[6], k[7], k[4] == K.LOWER) for k in K.KPIS if k[6] is not None}
LIMITS.update({m: (m, w, c, any(x in m for x in P.HIGH_IS_BAD)) for m, _, _, w, c in C.COUNTERS if w is not None})
LIMITS_CTE = values_cte("lim", ["kpi", "warning", "critical", "worse_high"], list(LIMITS.values()))


def _sev(v: str) -> str:
    return f"""CASE WHEN warning IS NULL THEN 'Low' WHEN worse_high THEN CASE WHEN {v} >= critical THEN 'Critical' WHEN {v} >= warning THEN 'High' ELSE 'Low' END
 ELSE CASE WHEN {v} <= critical THEN 'Critical' WHEN {v} <= warning THEN 'High' ELSE 'Low' END END"""


@query("for5", f"""WITH {TREND_CTE}, {LIMITS_CTE}, s AS (SELECT cell_id, kpi, fc, {_sev('fc')} AS own, {_sev('fc + band')} AS hi FROM tr LEFT JOIN lim USING (kpi))
 SELECT cell_id, kpi AS label, {r('fc', 3)} AS value, CASE WHEN own <> 'Low' THEN own ELSE 'Medium' END AS severity, 4.0::DOUBLE AS lead_time_h, 'predicted' AS state FROM s WHERE own <> 'Low' OR hi <> 'Low'""")
def for5(t: Tables):
    p = P.predicted_anomalies(P.forecast_trend(t.kpi), "Trend")
    return p.select("cell_id", "label", "value", "severity", "lead_time_h", "state")


@query("for6", f"""WITH {KPI_CTE}, st AS (SELECT *, (value - avg(value) OVER p) / stddev_pop(value) OVER p AS z, count(*) OVER p AS n, row_number() OVER (PARTITION BY cell_id, kpi ORDER BY ts, seq) AS rn
 FROM kpi_long WINDOW p AS (PARTITION BY cell_id, kpi)), w AS (SELECT *, avg(z) OVER (PARTITION BY cell_id, kpi ORDER BY rn ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS mx,
 avg(z) OVER (PARTITION BY cell_id, kpi ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS my FROM st)
 SELECT cell_id, kpi, rn, {r('mx', 4)} AS mean_x, {r('my', 4)} AS mean_y, CASE WHEN rn - 11 <= floor((n - 15) * 0.8) THEN 'train' ELSE 'test' END AS split FROM w WHERE rn >= 12 AND rn <= n - 4""")
def for6(t: Tables):
    w = P.supervised_windows(t.kpi)
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v) / F.size(c)
    return w.select("cell_id", "kpi", "rn", rnd(mean("x"), 4).alias("mean_x"), rnd(mean("y"), 4).alias("mean_y"), "split")


@query("for6_model")
def for6_model(t: Tables):
    w = P.supervised_windows(t.kpi)
    out = P.score_windows(P.fit_window_model(w), w.where("split = 'test'"))
    return out.groupBy("kpi").agg(rnd(F.avg(F.abs(F.col("yhat") - F.col("actual"))), 2).alias("mae"), F.count(F.lit(1)).alias("n"))


BACKTEST = f"""WITH {FREQ_CTE}, b AS (SELECT k.*, row_number() OVER (PARTITION BY cell_id, kpi ORDER BY ts, seq) AS rn, count(*) OVER (PARTITION BY cell_id, kpi) AS n, h, s FROM kpi_long k, fq),
 o AS (SELECT DISTINCT cell_id, kpi, k, n - h - k * s AS origin, h FROM b, range(8) t(k) WHERE n - h - k * s >= 24),
 f AS (SELECT o.cell_id, o.kpi, o.k, origin, o.h, regr_slope(value, rn) AS sl, regr_intercept(value, rn) AS ic, max(CASE WHEN rn = origin THEN value END) AS l,
  max(CASE WHEN rn = 1 THEN value END) AS f1, avg(value) FILTER (WHERE rn > origin - 5) AS m5 FROM o JOIN b ON b.cell_id = o.cell_id AND b.kpi = o.kpi AND rn <= origin GROUP BY ALL),
 j AS (SELECT f.*, b.rn, b.value AS actual FROM f JOIN b ON b.cell_id = f.cell_id AND b.kpi = f.kpi AND b.rn > origin AND b.rn <= origin + f.h),
 e AS (SELECT 'naive' AS method, cell_id, kpi, k, actual, l - actual AS e FROM j UNION ALL SELECT 'drift', cell_id, kpi, k, actual, l + (rn - origin) * (l - f1) / (origin - 1) - actual FROM j
  UNION ALL SELECT 'mean5', cell_id, kpi, k, actual, m5 - actual FROM j UNION ALL SELECT 'trend', cell_id, kpi, k, actual, ic + sl * rn - actual FROM j),
 acc AS (SELECT method, cell_id, kpi, {r('avg(abs(e))', 7)} AS mae, {r('sqrt(avg(e * e))', 7)} AS rmse, {r('avg(abs(e / nullif(actual, 0))) * 100', 2)} AS mape, count(DISTINCT k) AS n_origins FROM e GROUP BY ALL)"""


@query("evl1", f"{BACKTEST} SELECT * FROM acc")
def evl1(t: Tables):
    return V.rolling_backtest(t.kpi, digits=7)


@query("evl1_smoothing")
def evl1_smoothing(t: Tables):
    out = V.rolling_backtest(t.kpi, smoothing=True)
    return out.where("method = 'holt_winters'")




def truth(t: Tables):
    """Faults: the largest reading of every (cell, KPI); hours from the start of data."""
    start = t.kpi.agg(F.min("ts")).scalar()
    hours = (F.unix_micros("ts") - F.unix_micros(start)) / 1e6 / 3600.0
    best = t.kpi.withColumn("x", hours).groupBy("cell_id", "kpi").agg(F.max_by("x", F.struct("value", F.col("seq"))).alias("x"))
    return best.select(
        F.concat_ws("|", "cell_id", "kpi").alias("truth_id"), "cell_id", "kpi", F.floor("x").cast("double").alias("start_h"),
        (F.floor("x") + 1).cast("double").alias("end_h"), F.lit("spike").alias("kind"),
    )


LEAD = f"""WITH {FREQ_CTE}, {LIMITS_CTE}, x AS (SELECT *, (epoch_us(ts) - min(epoch_us(ts)) OVER ()) / 1e6 / 3600.0 AS x FROM kpi_long),
 tr AS (SELECT cell_id || '|' || kpi AS truth_id, cell_id, kpi, floor(arg_max(x, (value, seq))) AS start_h FROM x GROUP BY cell_id, kpi),
 lc AS (SELECT truth_id, cell_id, kpi, start_h, start_h - j * 0.5 AS check_h, 'lead' AS part FROM tr, range(1, 2000) t(j) WHERE start_h - j * 0.5 >= 0),
 ca AS (SELECT truth_id, cell_id, kpi, start_h, 0.5 + i * 1.0 AS check_h, row_number() OVER (PARTITION BY truth_id ORDER BY i) AS k FROM tr, range(0, 1000) t(i)
  WHERE 0.5 + i * 1.0 < greatest(start_h - 4.0, 0.5) AND NOT (0.5 + i * 1.0 >= start_h - 4.0 AND 0.5 + i * 1.0 <= start_h + 1.0)),
 ck AS (SELECT * FROM lc UNION ALL SELECT truth_id, cell_id, kpi, start_h, check_h, 'clean' FROM ca WHERE k <= 6),
 st AS (SELECT ck.truth_id, ck.kpi, ck.part, ck.check_h, ck.start_h, count(*) AS c, regr_slope(value, x) AS sl, regr_intercept(value, x) AS ic, max(x) AS xm, arg_max(value, (ts, seq)) AS l
  FROM ck JOIN x ON x.cell_id = ck.cell_id AND x.kpi = ck.kpi AND x.x <= ck.check_h GROUP BY ALL HAVING count(*) >= 24),
 y AS (SELECT st.*, m AS method, CASE m WHEN 'naive' THEN l ELSE ic + sl * (xm + freq / 3600.0 * (h + 1) / 2.0) END AS yhat FROM st, fq, (VALUES ('trend'), ('naive')) v(m)),
 al AS (SELECT y.*, {_sev('yhat')} IN ('High', 'Critical') AS alarm FROM y LEFT JOIN lim USING (kpi)),
 fo AS (SELECT truth_id, method, min(CASE WHEN part = 'lead' AND alarm THEN start_h - check_h END) AS lt, sum((part = 'clean' AND alarm)::INT)::BIGINT AS fa FROM al GROUP BY ALL),
 ld AS (SELECT tr.truth_id, m AS method, cell_id, kpi, lt IS NOT NULL AS detected, {r('lt', 2)} AS lead_time_h, coalesce(fa, 0) AS false_alarms FROM tr CROSS JOIN (VALUES ('trend'), ('naive')) v(m)
  LEFT JOIN fo ON fo.truth_id = tr.truth_id AND fo.method = m)"""


@query("evl2", f"{LEAD} SELECT truth_id, method, detected, lead_time_h, false_alarms FROM ld")
def evl2(t: Tables):
    return V.lead_time(t.kpi, truth(t)).select("truth_id", "method", "detected", "lead_time_h", "false_alarms")


@query("evl3", f"""{BACKTEST}, {LEAD.split('WITH ' + FREQ_CTE + ', ')[1].replace(' tr AS', ' ltr AS').replace('FROM tr', 'FROM ltr').replace('tr.truth_id', 'ltr.truth_id').replace(' x AS', ' lx AS').replace('FROM x ', 'FROM lx ').replace('JOIN x ON', 'JOIN lx x ON').replace(' st AS', ' lst AS').replace('SELECT st.*', 'SELECT lst.*').replace('FROM st,', 'FROM lst,')},
 a AS (SELECT method, count(*) AS n_series, count(mape) AS n_mape, {r('avg(mae)', 4)} AS avg_mae, {r('avg(rmse)', 4)} AS avg_rmse, {r('avg(mape)', 2)} AS avg_mape FROM acc GROUP BY method),
 b2 AS (SELECT method, sum(detected::INT)::BIGINT AS lead_time_detected, count(*) AS lead_time_total, sum(false_alarms)::BIGINT AS total_false_alarms FROM ld GROUP BY method)
 SELECT * FROM a FULL JOIN b2 USING (method)""")
def evl3(t: Tables):
    return V.method_summary(V.rolling_backtest(t.kpi, digits=7), V.lead_time(t.kpi, truth(t)))
