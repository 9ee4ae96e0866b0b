"""Derivation, exploration and KPI-detector queries on binding A."""

from __future__ import annotations

from pyspark.sql import functions as F

from radiolake.catalogue import kpi as K
from radiolake.operators import kpi_detectors as D
from radiolake.plans.bindings import DIM_CTE, HOURLY_LONG_CTE, KPI_CTE, Tables
from radiolake.plans.registry import query, r
from radiolake.operators.normalise import q

OUT = ["kpi", "cell_id", "gnb_id", "ts", "value", "severity"]
SHORT = ["kpi", "cell_id", "value", "severity"]
LIMITS = """CASE WHEN direction = 'lower_better' THEN CASE WHEN value >= critical THEN 'Critical'
 WHEN value >= warning THEN 'High' END ELSE CASE WHEN value <= critical THEN 'Critical'
 WHEN value <= warning THEN 'High' END END"""


@query("kth1", f"""WITH {KPI_CTE}, {DIM_CTE}, j AS (SELECT kpi, cell_id, gnb_id, ts, value, {LIMITS} AS severity
 FROM kpi_long JOIN kpi_dim USING (kpi)) SELECT kpi, cell_id, gnb_id, ts, {r('value', 3)} AS value, severity FROM j
 WHERE severity IS NOT NULL""")
def kth1(t: Tables):
    return D.limits_generic(t.kpi).select(*OUT)


@query("kth2", f"""WITH {KPI_CTE}, p AS (SELECT *, {r("value / (CASE channel_type WHEN 'TDD' THEN 1400.0 ELSE 84.0 END) * 100", 4)} AS pct
 FROM kpi_long WHERE kpi = 'DL_Throughput_Mbps'), s AS (SELECT *, CASE WHEN pct <= 3.5714 THEN 'Critical'
 WHEN pct <= 7.1429 THEN 'High' END AS severity FROM p)
 SELECT cell_id, ts, {r('value', 3)} AS value, pct AS normalized_pct, severity FROM s WHERE severity IS NOT NULL""")
def kth2(t: Tables):
    return D.throughput_limits(t.kpi, directions=["dl"]).select("cell_id", "ts", "value", "normalized_pct", "severity")


@query("kth3", f"""WITH {HOURLY_LONG_CTE}, p AS (SELECT *, {r("value / (CASE channel_type WHEN 'TDD' THEN 100.0 ELSE 50.0 END) * 100", 4)} AS pct,
 prb_ul IS NOT NULL AND prb_ul BETWEEN 5 AND 200 AS usable FROM hourly_long WHERE kpi = 'UL_Throughput_Mbps'),
 s AS (SELECT *, CASE WHEN pct <= (CASE WHEN usable THEN greatest(2.0, prb_ul * 0.2) ELSE 2.0 END) THEN 'Critical'
 WHEN pct <= (CASE WHEN usable THEN greatest(5.0, prb_ul * 0.5) ELSE 5.0 END) THEN 'High' END AS severity FROM p)
 SELECT cell_id, ts, {r('value', 3)} AS value, pct AS normalized_pct, severity FROM s WHERE severity IS NOT NULL""")
def kth3(t: Tables):
    wide = t.kpi_hourly.withColumn("prb_ul", F.col(q(K.PRB_UL)))
    facts = wide.unpivot(
        ["cell_id", "gnb_id", "channel_type", "ts", "seq", "prb_ul"],
        [q(k) for k in (K.PRB_DL, K.PRB_UL, "DL_Throughput_Mbps", "UL_Throughput_Mbps", "Latency_ms")],
        "kpi", "value",
    )
    return D.throughput_limits(facts, directions=["ul"]).select("cell_id", "ts", "value", "normalized_pct", "severity")


@query("kth4", f"""WITH {KPI_CTE}, hits AS (SELECT cell_id, ts, seq, value, value >= 90 AS crit FROM kpi_long
 WHERE kpi = 'PRB_Utilization_DL_%' AND value >= 80), g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR
 epoch_us(ts) - epoch_us(lag(ts) OVER w) > 129600000000 THEN 1 ELSE 0 END AS brk FROM hits
 WINDOW w AS (PARTITION BY cell_id ORDER BY ts, seq)), i AS (SELECT *, sum(brk) OVER (PARTITION BY cell_id ORDER BY ts, seq) AS run
 FROM g), p AS (SELECT *, row_number() OVER (PARTITION BY cell_id, run ORDER BY ts, seq) AS pos FROM i),
 a AS (SELECT cell_id, run, count(*) AS n, max(value) AS peak, bool_or(crit) AS c, max(CASE WHEN pos = 3 THEN ts END) AS t3,
 max(CASE WHEN pos = 5 THEN ts END) AS t5, max(CASE WHEN pos = 3 THEN value END) AS v3,
 max(CASE WHEN pos = 5 THEN value END) AS v5 FROM p GROUP BY ALL), s AS (SELECT *, CASE WHEN c AND n >= 3 THEN 'Critical'
 WHEN n >= 5 THEN 'High' END AS severity FROM a)
 SELECT cell_id, CASE WHEN severity = 'Critical' THEN t3 ELSE t5 END AS ts,
 {r("CASE WHEN severity = 'Critical' THEN v3 ELSE v5 END", 3)} AS value, severity, n AS sustained_minutes,
 {r('peak', 2)} AS peak_prb_dl FROM s WHERE severity IS NOT NULL""")
def kth4(t: Tables):
    out = D.sustained_load(t.kpi, gap_s=129600.0)
    return out.select("cell_id", "ts", "value", "severity", "sustained_minutes", "peak_prb_dl")


PEER_SQL = f"""c AS (SELECT kpi, cell_id, avg(value) AS value FROM kpi_long GROUP BY ALL),
 f AS (SELECT kpi, avg(value) AS m, stddev_samp(value) AS s FROM c GROUP BY kpi), z AS (SELECT kpi, cell_id, value,
 CASE WHEN direction = 'lower_better' THEN (value - m) / s ELSE (m - value) / s END AS z FROM c JOIN f USING (kpi)
 JOIN kpi_dim USING (kpi) WHERE s > 0)"""


@query("kpe1", f"""WITH {KPI_CTE}, {DIM_CTE}, {PEER_SQL} SELECT kpi, cell_id, {r('value', 3)} AS value,
 CASE WHEN z > 3 THEN 'High' ELSE 'Medium' END AS severity FROM z WHERE z > 1.5""")
def kpe1(t: Tables):
    return D.detect_peers(t.kpi, z_threshold=1.5).select(*SHORT)


@query("ktr1", f"""WITH {KPI_CTE}, {DIM_CTE}, x AS (SELECT kpi, value, (epoch_us(ts) - min(epoch_us(ts)) OVER ()) / 1e6 / 3600.0 AS x
 FROM kpi_long), f AS (SELECT kpi, regr_slope(value, x) AS slope FROM x GROUP BY kpi)
 SELECT kpi, {r('slope', 4)} AS value, {r('abs(slope)', 3)} AS score, CASE WHEN abs(slope) > 2 THEN 'High' ELSE 'Medium' END AS severity
 FROM f JOIN kpi_dim USING (kpi) WHERE CASE WHEN direction = 'lower_better' THEN slope ELSE -slope END > 0.0005""")
def ktr1(t: Tables):
    return D.detect_trend(t.kpi, slope_threshold=0.0005).select("kpi", "value", "score", "severity")


@query("kiq1", f"""WITH {KPI_CTE}, {DIM_CTE}, f AS (SELECT kpi, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
 FROM kpi_long GROUP BY kpi), d AS (SELECT k.kpi, cell_id, ts, value, seq, q3 - q1 AS iqr, CASE WHEN direction = 'lower_better'
 THEN value - (q3 + 1.5 * (q3 - q1)) ELSE (q1 - 1.5 * (q3 - q1)) - value END AS dev FROM kpi_long k JOIN f USING (kpi) JOIN kpi_dim d ON d.kpi = k.kpi)
 SELECT kpi, cell_id, ts, {r('value', 3)} AS value, CASE WHEN dev > iqr THEN 'High' ELSE 'Medium' END AS severity FROM d
 WHERE dev > 0 QUALIFY row_number() OVER (PARTITION BY kpi, cell_id ORDER BY dev DESC, seq) = 1""")
def kiq1(t: Tables):
    return D.detect_iqr(t.kpi).select("kpi", "cell_id", "ts", "value", "severity")


CUSUM_SQL = """st AS (SELECT kpi, cell_id, avg(value) AS mu, stddev_pop(value) AS sd, count(*) AS n FROM kpi_long GROUP BY ALL),
 z AS (SELECT k.*, (value - mu) / sd AS z FROM kpi_long k JOIN st USING (kpi, cell_id) WHERE n >= 5 AND sd > 0),
 u AS (SELECT *, sum(z - 0.5) OVER w AS up, sum(-z - 0.5) OVER w AS dn FROM z
  WINDOW w AS (PARTITION BY kpi, cell_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
 s AS (SELECT *, up - least(0, min(up) OVER w) AS s_pos, dn - least(0, min(dn) OVER w) AS s_neg FROM u
  WINDOW w AS (PARTITION BY kpi, cell_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING))"""


@query("kcu1", f"""WITH {KPI_CTE}, {DIM_CTE}, {CUSUM_SQL}, a AS (SELECT s.*, greatest(s_pos, s_neg) AS peak FROM s JOIN kpi_dim USING (kpi)
 WHERE CASE WHEN direction = 'lower_better' THEN s_pos ELSE s_neg END > 5 OR greatest(s_pos, s_neg) > 10)
 SELECT kpi, cell_id, ts, {r('value', 3)} AS value, CASE WHEN peak > 10 THEN 'High' ELSE 'Medium' END AS severity FROM a
 QUALIFY row_number() OVER (PARTITION BY kpi, cell_id ORDER BY ts, seq) = 1""")
def kcu1(t: Tables):
    return D.detect_cusum(t.kpi).select("kpi", "cell_id", "ts", "value", "severity")


@query("kcu1_path", f"""WITH {KPI_CTE}, {CUSUM_SQL} SELECT seq, {r('s_pos', 4)} AS s_pos, {r('s_neg', 4)} AS s_neg FROM s""")
def kcu1_path(t: Tables):
    from radiolake.functions.columns import rnd

    return D.cusum_path(t.kpi).select("seq", rnd("s_pos", 4).alias("s_pos"), rnd("s_neg", 4).alias("s_neg"))


@query("kbo1", f"""WITH {KPI_CTE}, {DIM_CTE}, b AS (SELECT *, avg(value) OVER w AS mid, stddev_samp(value) OVER w AS sd,
 count(value) OVER w AS c, count(*) OVER (PARTITION BY kpi, cell_id) AS n FROM kpi_long
 WINDOW w AS (PARTITION BY kpi, cell_id ORDER BY ts, seq ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
 d AS (SELECT b.*, greatest(sd, 0.5) AS s, CASE WHEN direction = 'lower_better' THEN value - (mid + 2 * greatest(sd, 0.5))
 ELSE (mid - 2 * greatest(sd, 0.5)) - value END AS dev FROM b JOIN kpi_dim USING (kpi) WHERE c >= 3 AND n >= 6)
 SELECT kpi, cell_id, ts, {r('value', 3)} AS value, CASE WHEN dev > s THEN 'High' ELSE 'Medium' END AS severity FROM d WHERE dev > 0
 QUALIFY row_number() OVER (PARTITION BY kpi, cell_id ORDER BY dev DESC, ts, seq) = 1""")
def kbo1(t: Tables):
    return D.detect_bollinger(t.kpi).select("kpi", "cell_id", "ts", "value", "severity")
