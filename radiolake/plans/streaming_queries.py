"""Streaming forms run over the events table as a file stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from radiolake.functions.columns import rnd
from radiolake.operators import events as E
from radiolake.operators import feedback as B
from radiolake.plans.bindings import (
    CLASSED_CTE, DIM_CTE, EVENTS_CTE, KPI_CTE, Tables, anomalies_from_events, instants, kpi_from_events,
    messages_from_events,
)
from radiolake.plans.insight_queries import FBK3
from radiolake.plans.kpi_queries import LIMITS
from radiolake.plans.registry import query, r
from radiolake.session import fresh_path
from radiolake.streaming import jobs as J


def event_stream(t: Tables):
    schema = t.spark.read.parquet(f"{t.dir}/events.parquet").schema
    return instants(J.read_stream(t.spark, t.dir, schema, files="events.parquet"))


@query("stm1", f"""WITH {KPI_CTE}, {DIM_CTE}, j AS (SELECT kpi, cell_id, ts, value, {LIMITS} AS severity FROM kpi_long JOIN kpi_dim USING (kpi))
 SELECT kpi, cell_id, ts, {r('value', 3)} AS value, severity FROM j WHERE severity IS NOT NULL""")
def stm1(t: Tables):
    alarms = J.limit_alarms(kpi_from_events(event_stream(t)))
    return J.drain(alarms, "stm1").select("kpi", "cell_id", "ts", "value", "severity")


@query("stm2", f"WITH {CLASSED_CTE} SELECT tx_key, seq, outcome FROM outcomes WHERE outcome NOT IN ('answered', 'timeout')")
def stm2(t: Tables):
    out = J.pair_requests(messages_from_events(event_stream(t)), timeout_s=60 * 86400)
    return J.drain(out, "stm2").select("tx_key", "seq", "outcome")


STM2_JOIN = f"""WITH {CLASSED_CTE}, o AS (SELECT tx_key, seq, ts FROM classed WHERE class = 'open'), a AS (SELECT tx_key, seq AS answer_seq, ts AS answer_ts, class FROM classed WHERE class <> 'open'),
 m AS (SELECT o.tx_key, o.seq, class AS outcome, answer_seq FROM o JOIN a ON o.tx_key = a.tx_key AND answer_ts >= ts AND answer_ts <= ts + INTERVAL 30 MINUTE),
 w AS (SELECT least((SELECT max(ts) FROM o), (SELECT max(answer_ts) FROM a)) - INTERVAL 1 MINUTE AS upto)
 SELECT * FROM m UNION ALL SELECT tx_key, seq, 'timeout', NULL FROM o, w WHERE ts + INTERVAL 30 MINUTE <= upto AND (tx_key, seq) NOT IN (SELECT (tx_key, seq) FROM m)"""


@query("stm2_join", STM2_JOIN)
def stm2_join(t: Tables):
    """Messages arriving in four portions of time, one file and one micro-batch each; timeouts fire as event time goes on."""
    inbox = fresh_path(t.spark, "stm2-inbox")
    begin, end = (F.unix_micros(t.messages.agg(f("ts")).scalar()) for f in (F.min, F.max))
    dealt = t.messages.withColumn("_part", F.floor((F.unix_micros("ts") - begin) * 4 / (end - begin + 1)))
    for part in range(4):
        dealt.where(F.col("_part") == part).drop("_part").coalesce(1).write.mode("append").parquet(inbox)
    stream = J.read_stream(t.spark, inbox, t.messages.schema, files_per_trigger=1)
    return J.drain(J.match_requests(stream, timeout_s=1800), "stm2-join").select("tx_key", "seq", "outcome", "answer_seq")


@query("stm3", f"WITH {EVENTS_CTE} SELECT source, count(DISTINCT (cell_id, dedupe_name, dedupe_value, evidence, detector)) AS n FROM raw_events WHERE ts IS NOT NULL GROUP BY source")
def stm3(t: Tables):
    ev = E.to_events(anomalies_from_events(event_stream(t))).drop("raw").where(F.col("ts").isNotNull())
    return J.drain(J.dedupe_events(ev), "stm3").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("stm4", f"""WITH {EVENTS_CTE}, k AS (SELECT e.*, CASE WHEN cell_id <> '—' THEN cell_id WHEN lower(category) LIKE '%rrc%' THEN 'proc::rrc'
  WHEN lower(category) LIKE '%nas%' OR lower(category) LIKE '%pdu%' THEN 'proc::nas' WHEN lower(category) LIKE '%ngap%' OR lower(category) LIKE '%context%' OR lower(category) LIKE '%handover%' THEN 'proc::ngap'
  ELSE 'proc::' || substr(lower(category), 1, 20) END AS ck FROM raw_events e WHERE ts IS NOT NULL),
 w AS (SELECT ck, source, time_bucket(INTERVAL 5 MINUTE, ts) - i * INTERVAL 5 MINUTE AS s FROM k, range(0, 12) t(i)),
 g AS (SELECT ck, s, count(DISTINCT source) AS n_sources, count(*) AS events FROM w GROUP BY ALL)
 SELECT ck AS corr_key, s AS start_ts, n_sources, events FROM g WHERE n_sources >= 2 AND s + INTERVAL 1 HOUR <= (SELECT max(ts) FROM k) - INTERVAL 10 MINUTE""")
def stm4(t: Tables):
    ev = E.to_events(anomalies_from_events(event_stream(t))).drop("raw").where(F.col("ts").isNotNull())
    out = J.drain(J.correlate_windows(ev), "stm4")
    return out.select("corr_key", "start_ts", F.col("n_sources").cast("bigint").alias("n_sources"), "events")


@query("stm5", f"""WITH {KPI_CTE}, h AS (SELECT cell_id, ts, seq, value FROM kpi_long WHERE kpi = 'PRB_Utilization_DL_%' AND value >= 80),
 b AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts > lag(ts) OVER w + INTERVAL 36 HOUR THEN 1 ELSE 0 END AS brk FROM h WINDOW w AS (PARTITION BY cell_id ORDER BY ts, seq)),
 i AS (SELECT *, sum(brk) OVER (PARTITION BY cell_id ORDER BY ts, seq) AS run FROM b),
 a AS (SELECT cell_id, run, min(ts) AS start_ts, max(ts) AS last_ts, count(*) AS n, max(value) AS peak FROM i GROUP BY ALL)
 SELECT cell_id, start_ts, n, peak, CASE WHEN peak >= 90 AND n >= 3 THEN 'Critical' ELSE 'High' END AS severity FROM a WHERE ((peak >= 90 AND n >= 3) OR n >= 5)
 AND last_ts + INTERVAL 36 HOUR <= (SELECT max(ts) FROM h) - INTERVAL 1 MINUTE""")
def stm5(t: Tables):
    out = J.load_sessions(kpi_from_events(event_stream(t)), gap="36 hours")
    return J.drain(out, "stm5").select("cell_id", "start_ts", "n", "peak", "severity")


STM6 = f"""WITH {KPI_CTE}, {DIM_CTE}, n AS (SELECT *, row_number() OVER w AS rn FROM kpi_long WINDOW w AS (PARTITION BY kpi, cell_id ORDER BY ts, seq)),
 st AS (SELECT kpi, cell_id, avg(value) AS mu, stddev_pop(value) AS sd FROM n WHERE rn <= 12 GROUP BY ALL HAVING count(*) = 12),
 z AS (SELECT n.*, (value - mu) / sd AS z FROM n JOIN st USING (kpi, cell_id) WHERE sd > 0),
 u AS (SELECT *, sum(z - 0.5) OVER w AS up, sum(-z - 0.5) OVER w AS dn FROM z WINDOW w AS (PARTITION BY kpi, cell_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
 s AS (SELECT *, up - least(0, min(up) OVER w) AS s_pos, dn - least(0, min(dn) OVER w) AS s_neg FROM u WINDOW w AS (PARTITION BY kpi, cell_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING))
 SELECT kpi, cell_id, ts, {r('value', 3)} AS value, CASE WHEN greatest(s_pos, s_neg) > 10 THEN 'High' ELSE 'Medium' END AS severity FROM s JOIN kpi_dim USING (kpi)
 WHERE CASE WHEN direction = 'lower_better' THEN s_pos ELSE s_neg END > 5 OR greatest(s_pos, s_neg) > 10 QUALIFY row_number() OVER (PARTITION BY kpi, cell_id ORDER BY ts, seq) = 1"""


@query("stm6", STM6)
def stm6(t: Tables):
    out = J.online_cusum(kpi_from_events(event_stream(t)), reference_window=12)
    return J.drain(out, "stm6").select("kpi", "cell_id", "ts", rnd("value", 3).alias("value"), "severity")


@query("kcu1_reference", STM6)
def kcu1_reference(t: Tables):
    from radiolake.operators import kpi_detectors as D

    return D.detect_cusum(t.kpi, reference_window=12).select("kpi", "cell_id", "ts", "value", "severity")


@query("stm7", f"{FBK3} SELECT detector, param, w AS value FROM y")
def stm7(t: Tables):
    spark = t.spark
    inbox, store, params, state = (fresh_path(spark, f"stm7-{x}") for x in ("inbox", "store", "params", "state"))
    rows = t.feedback.select("feedback_id", "detector", "verdict", "source")
    rows.write.parquet(inbox)
    J.retrain_on_arrival(J.read_stream(spark, inbox, rows.schema), store, params, state)
    return B.current_params(spark, spark.read.schema("detector string, param string, value double").json(params))
