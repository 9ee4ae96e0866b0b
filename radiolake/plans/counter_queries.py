"""Radio-counter detector queries on binding B."""

from __future__ import annotations

from pyspark.sql import functions as F

from radiolake.functions.columns import rnd
from radiolake.operators import counter_detectors as D
from radiolake.operators import kpi_detectors as KD
from radiolake.plans.bindings import COUNTER_DIM_CTE, COUNTERS_LONG_CTE, DIM_CTE, KPI_CTE, SEV, Tables
from radiolake.plans import kpi_queries  # noqa: F401  (its SQL is reused below)
from radiolake.plans.registry import SQL, query, r

COLS = ["label", "cell_id", "value", "severity", "score"]
MEANS = "m AS (SELECT metric, cell_id, avg(value) AS v FROM counters_long GROUP BY ALL)"


def _out(df):
    return df.select("label", "cell_id", "value", "severity", rnd("score", 4).alias("score"))


def _sel(src: str, where: str = "TRUE") -> str:
    return f"SELECT metric AS label, cell_id, {r('v', 3)} AS value, severity, {r('score', 4)} AS score FROM {src} WHERE {where}"


STH = f"""{MEANS}, th AS (SELECT metric, cell_id, v, abs(v - warning) AS score, CASE WHEN worse_high THEN CASE WHEN v >= critical THEN 'Critical' WHEN v >= warning THEN 'High' END
 ELSE CASE WHEN v <= critical THEN 'Critical' WHEN v <= warning THEN 'High' END END AS severity FROM m JOIN counter_dim USING (metric) WHERE warning IS NOT NULL)"""


@query("sth1", f"WITH {COUNTERS_LONG_CTE}, {COUNTER_DIM_CTE}, {STH} {_sel('th', 'severity IS NOT NULL')}")
def sth1(t: Tables):
    return _out(D.detect_threshold(t.counters_long))


def _peer(z: float) -> str:
    return f"""pz AS (SELECT metric, cell_id, v, abs((v - avg(v) OVER (PARTITION BY metric)) / stddev_samp(v) OVER (PARTITION BY metric)) AS score FROM m),
 pe AS (SELECT *, CASE WHEN score >= 3 THEN 'High' ELSE 'Medium' END AS severity FROM pz WHERE score >= {z})"""


@query("spe1", f"WITH {COUNTERS_LONG_CTE}, {MEANS}, {_peer(1.5)} {_sel('pe')}")
def spe1(t: Tables):
    return _out(D.detect_peers(t.counters_long, z_threshold=1.5))


TREND = """tx AS (SELECT *, (epoch_us(ts) - min(epoch_us(ts)) OVER ()) / 1e6 / 3600.0 AS x FROM counters_long),
 tf AS (SELECT metric, cell_id, regr_slope(value, x) AS s, arg_max(value, seq) AS v, count(*) AS n FROM tx GROUP BY ALL)"""


@query("str1", f"WITH {COUNTERS_LONG_CTE}, {TREND} SELECT metric AS label, cell_id, {r('v', 3)} AS value, 'Medium' AS severity, {r('abs(s)', 6)} AS score FROM tf WHERE n >= 8 AND abs(s) >= 1e-6")
def str1(t: Tables):
    return D.detect_trend(t.counters_long, slope_threshold=1e-6).select("label", "cell_id", "value", "severity", rnd("score", 6).alias("score"))


def _iqr(k: float) -> str:
    return f"""iq AS (SELECT metric, cell_id, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, count(*) AS n FROM counters_long GROUP BY ALL),
 io AS (SELECT c.metric, c.cell_id, avg(value) AS v, count(*) / max(n) * 100.0 AS score FROM counters_long c JOIN iq USING (metric, cell_id)
 WHERE n >= 10 AND q3 > q1 AND (value < q1 - {k} * (q3 - q1) OR value > q3 + {k} * (q3 - q1)) GROUP BY ALL),
 ir AS (SELECT *, CASE WHEN score > 5 THEN 'High' ELSE 'Medium' END AS severity FROM io)"""


@query("siq1", f"WITH {COUNTERS_LONG_CTE}, {_iqr(0.3)} {_sel('ir')}")
def siq1(t: Tables):
    return _out(D.detect_iqr(t.counters_long, k=0.3))


CUSUM = """ca AS (SELECT metric, cell_id, count(*) AS n, avg(value) AS m, stddev_samp(value) AS s, max(value) AS hi, min(value) AS lo, arg_max(value, seq) AS v FROM counters_long GROUP BY ALL),
 cb AS (SELECT metric, cell_id, v, greatest((hi - m) / s, (m - lo) / s) - 0.5 AS score FROM ca WHERE n >= 15),
 cu AS (SELECT *, CASE WHEN score > 1.2 * 1.5 THEN 'High' ELSE 'Medium' END AS severity FROM cb WHERE score >= 1.2)"""


@query("scu1", f"WITH {COUNTERS_LONG_CTE}, {CUSUM} {_sel('cu')}")
def scu1(t: Tables):
    return _out(D.detect_cusum(t.counters_long, threshold=1.2))


def _boll(frame: str) -> str:
    return f"""bb AS (SELECT *, avg(value) OVER w AS mid, stddev_samp(value) OVER w AS sd, count(value) OVER w AS c,
 count(*) OVER (PARTITION BY metric, cell_id) AS n FROM counters_long WINDOW w AS (PARTITION BY metric, cell_id ORDER BY ts, seq, value ROWS BETWEEN {frame})),
 bp AS (SELECT metric, cell_id, sum((c = 5 AND abs(value - mid) > 2.5 * sd)::INT) AS breaks, count(*) AS len, arg_max(value, (ts, seq)) AS v FROM bb WHERE n >= 7 GROUP BY ALL),
 bs AS (SELECT metric, cell_id, v, breaks / len * 100.0 AS score FROM bp WHERE breaks > 0),
 bo AS (SELECT *, CASE WHEN score > 8 THEN 'High' ELSE 'Medium' END AS severity FROM bs WHERE score >= 3)"""


@query("sbo1", f"WITH {COUNTERS_LONG_CTE}, {_boll('4 PRECEDING AND CURRENT ROW')} {_sel('bo')}")
def sbo1(t: Tables):
    return _out(D.detect_bollinger(t.counters_long))


@query("sbo1_lagged", f"WITH {COUNTERS_LONG_CTE}, {_boll('5 PRECEDING AND 1 PRECEDING')} {_sel('bo')}")
def sbo1_lagged(t: Tables):
    return _out(D.detect_bollinger(t.counters_long, lagged=True))


@query("smg1", f"""WITH {COUNTERS_LONG_CTE}, {COUNTER_DIM_CTE}, {STH}, {_peer(1.5)}, {_iqr(0.3)}, {TREND}, {CUSUM}, {_boll('5 PRECEDING AND 1 PRECEDING')},
 u AS (SELECT metric, cell_id, v, severity, score, 1 AS place, 'Threshold' AS detector FROM th WHERE severity IS NOT NULL
 UNION ALL SELECT metric, cell_id, v, severity, score, 2, 'Peer Comparison' FROM pe UNION ALL SELECT metric, cell_id, v, severity, score, 4, 'IQR' FROM ir
 UNION ALL SELECT metric, cell_id, v, 'Medium', abs(s), 3, 'Trend' FROM tf WHERE n >= 8 AND abs(s) >= 1e-6
 UNION ALL SELECT metric, cell_id, v, severity, score, 5, 'CUSUM' FROM cu UNION ALL SELECT metric, cell_id, v, severity, score, 6, 'Bollinger Bands' FROM bo)
 SELECT metric AS label, cell_id, {r('v', 3)} AS value, severity, {r('score', 4)} AS score, detector FROM u
 QUALIFY row_number() OVER (PARTITION BY metric, cell_id ORDER BY {SEV} DESC, place) = 1""")
def smg1(t: Tables):
    opts = {D.PEER: {"z_threshold": 1.5}, D.IQR: {"k": 0.3}, D.TREND: {"slope_threshold": 1e-6}, D.CUSUM: {"threshold": 1.2},
            D.BOLLINGER: {"lagged": True}}
    out = D.detect_counters(t.counters_long, options=opts)
    return out.select("label", "cell_id", "value", "severity", rnd("score", 4).alias("score"), "detector")


UL_FLOOR_SQL = f"""WITH {KPI_CTE}, p AS (SELECT *, {r("value / (CASE channel_type WHEN 'TDD' THEN 100.0 ELSE 50.0 END) * 100", 4)} AS pct FROM kpi_long WHERE kpi = 'UL_Throughput_Mbps')
 SELECT cell_id, ts, {r('value', 3)} AS value, CASE WHEN pct <= 2 THEN 'Critical' ELSE 'High' END AS severity FROM p WHERE pct <= 5"""
KMG_PARTS = [
    f"SELECT kpi, cell_id, ts, value, severity, 'Threshold' AS detector FROM ({SQL['kth1']}) WHERE kpi IN ('PRB_Utilization_UL_%', 'Latency_ms')",
    f"SELECT 'DL_Throughput_Mbps', cell_id, ts, value, severity, 'Threshold' FROM ({SQL['kth2']})",
    f"SELECT 'UL_Throughput_Mbps', cell_id, ts, value, severity, 'Threshold' FROM ({UL_FLOOR_SQL})",
    f"SELECT 'PRB_Utilization_DL_%', cell_id, ts, value, severity, 'Threshold' FROM ({SQL['kth4']})",
    f"SELECT kpi, cell_id, NULL, value, severity, 'Peer Comparison' FROM ({SQL['kpe1']})",
    f"SELECT kpi, 'Fleet-wide', NULL, value, severity, 'Trend (linear regression)' FROM ({SQL['ktr1']})",
    f"SELECT kpi, cell_id, ts, value, severity, 'IQR (Tukey fence)' FROM ({SQL['kiq1']})",
    f"SELECT kpi, cell_id, ts, value, severity, 'CUSUM' FROM ({SQL['kcu1']})",
    f"SELECT kpi, cell_id, ts, value, severity, 'Bollinger Bands' FROM ({SQL['kbo1']})",
]


@query("kmg1", " UNION ALL ".join(KMG_PARTS))
def kmg1(t: Tables):
    opts = {KD.PEER: {"z_threshold": 1.5}, KD.TREND: {"slope_threshold": 0.0005}, KD.THRESHOLD: {"gap_s": 129600.0}}
    out = KD.ranked(KD.detect_kpi(t.kpi, options=opts))
    return out.select("kpi", "cell_id", "ts", "value", "severity", "detector")
