"""Event-log and correlation queries on binding D."""

from __future__ import annotations

from pyspark.sql import functions as F

from radiolake.operators import events as E
from radiolake.plans.bindings import EVENTS_CTE, SEV, Tables
from radiolake.plans.registry import query, r
from radiolake.sources import writers


def log(t: Tables, keep_raw: bool = False):
    return E.event_log([E.to_events(t.anomalies)], keep_raw)


def correlated(t: Tables):
    return E.correlate(log(t))


@query("evt1", f"WITH {EVENTS_CTE} SELECT seq, source, state, severity, category, metric, layer, value, cell_id FROM raw_events")
def evt1(t: Tables):
    return E.to_events(t.anomalies).select("seq", "source", "state", "severity", "category", "metric", "layer", "value", "cell_id")


@query("evt2", f"WITH {EVENTS_CTE} SELECT seq, source, category, cell_id FROM event_log")
def evt2(t: Tables):
    return log(t).select("seq", "source", "category", "cell_id")


@query("evt3", f"WITH {EVENTS_CTE} SELECT seq, ts FROM raw_events")
def evt3(t: Tables):
    text = t.anomalies.withColumn("timestamp", F.coalesce(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("fleet-avg"))).drop("ts")
    return text.select("seq", E.event_time(text).alias("ts"))


@query("evt4", f"WITH {EVENTS_CTE} SELECT corr_key, count(*) AS n FROM keyed GROUP BY corr_key")
def evt4(t: Tables):
    return log(t).groupBy(E.correlation_key().alias("corr_key")).agg(F.count(F.lit(1)).alias("n"))


@query("evt5", f"WITH {EVENTS_CTE} SELECT seq, corr_key, n_correlated, confidence FROM correlated")
def evt5(t: Tables):
    return correlated(t).select("seq", "corr_key", F.size("correlated_sources").cast("bigint").alias("n_correlated"),
                                F.col("correlation_confidence").alias("confidence"))


@query("evt6", f"WITH {EVENTS_CTE} SELECT seq, source, cell_id, category, severity, score, ts, n_correlated, confidence FROM correlated WHERE severity IN ('Critical', 'High')")
def evt6(t: Tables):
    out = E.prioritised(correlated(t), min_severity="High")
    return out.select("seq", "source", "cell_id", "category", "severity", "score", "ts",
                      F.size("correlated_sources").cast("bigint").alias("n_correlated"), F.col("correlation_confidence").alias("confidence"))


@query("evt7", f"WITH {EVENTS_CTE} SELECT seq, source, cell_id FROM correlated WHERE n_correlated >= 2")
def evt7(t: Tables):
    return E.correlated_only(correlated(t), 3).select("seq", "source", "cell_id")


@query("evt8", f"WITH {EVENTS_CTE} SELECT seq, severity FROM event_log WHERE cell_id = 'PCI_3'")
def evt8(t: Tables):
    return E.by_cell(log(t), "PCI_3").select("seq", "severity")


@query("evt9", f"""WITH {EVENTS_CTE} SELECT count(*) AS total, count(*) AS current, 0::BIGINT AS predicted, sum((n_correlated >= 1)::INT)::BIGINT AS correlated,
 count(DISTINCT CASE WHEN n_correlated >= 1 THEN cell_id END) AS correlated_unique_cells, {', '.join(f"count(*) FILTER (WHERE severity = '{s}') AS sev_{s.lower()}" for s in ('Critical', 'High', 'Medium', 'Low'))},
 {', '.join(f"count(*) FILTER (WHERE source = '{s}') AS src_{s}" for s in ('kpi', 'pcap', 'stats'))} FROM correlated""")
def evt9(t: Tables):
    return E.summary(correlated(t))


@query("evt9_cells", f"WITH {EVENTS_CTE} SELECT cell_id, count(*) AS n FROM event_log GROUP BY cell_id ORDER BY n DESC, cell_id LIMIT 5")
def evt9_cells(t: Tables):
    return E.top_cells(log(t))


@query("evt10", f"WITH {EVENTS_CTE} SELECT seq, 'predicted' AS state, 4.0::DOUBLE AS lead_time_h, category FROM event_log WHERE source = 'kpi'")
def evt10(t: Tables):
    p = E.predicted_events(t.anomalies.where("source = 'kpi'").drop("source"), "kpi", 4.0)
    return E.event_log([p]).select("seq", "state", "lead_time_h", "category")


@query("evt11", f"""WITH {EVENTS_CTE} SELECT e.seq, count(o.seq) AS related FROM event_log e LEFT JOIN event_log o ON o.cell_id = e.cell_id AND o.seq <> e.seq
 AND (e.ts IS NULL OR o.ts IS NULL OR abs(epoch_us(e.ts) - epoch_us(o.ts)) <= 3600000000) GROUP BY e.seq""")
def evt11(t: Tables):
    return E.related_counts(log(t)).select("seq", "related")


@query("evt11_pairs", f"""WITH {EVENTS_CTE}, f AS (SELECT * FROM event_log QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY score DESC, seq) = 1) SELECT f.seq AS focus_seq, o.seq FROM f JOIN event_log o ON o.cell_id = f.cell_id AND o.seq <> f.seq
 AND (f.ts IS NULL OR o.ts IS NULL OR abs(epoch_us(f.ts) - epoch_us(o.ts)) <= 3600000000)""")
def evt11_pairs(t: Tables):
    ev = log(t)
    worst = ev.groupBy("cell_id").agg(F.max_by(F.struct("event_id", "seq"), F.struct("score", -F.col("seq"))).alias("e")).select("e.*")
    near = E.related_events(ev, worst)
    names = worst.select(F.col("event_id").alias("focus_id"), F.col("seq").alias("focus_seq"))
    return near.join(names, "focus_id").select("focus_seq", "seq")


@query("evt12", f"WITH {EVENTS_CTE} SELECT seq, severity FROM event_log WHERE cell_id = 'PCI_5' AND source = 'stats' AND severity IN ('Critical', 'High', 'Medium', 'Low')")
def evt12(t: Tables):
    p = E.predicted_events(t.anomalies.where("source = 'stats'").drop("source"), "stats", 4.0)
    ev = E.event_log([p]).withColumn("correlated_sources", F.array().cast("array<string>"))
    return E.predictions_of(ev, "PCI_5").select("seq", "severity")


@query("evt13", f"WITH {EVENTS_CTE} SELECT seq, n_correlated FROM correlated WHERE n_correlated >= 1")
def evt13(t: Tables):
    jobs = t.anomalies.withColumn("job_id", F.concat(F.lit("job-"), (F.col("seq") % 3).cast("string")))
    out = E.correlated_only(E.combine_jobs(jobs, ["job-0", "job-1", "job-2"]))
    return out.select("seq", F.size("correlated_sources").cast("bigint").alias("n_correlated"))


@query("snk2", f"WITH {EVENTS_CTE} SELECT count(*) AS total_anomalies, count(*) FILTER (WHERE severity = 'Critical') AS critical, count(*) FILTER (WHERE severity = 'High') AS high, count(*) FILTER (WHERE severity = 'Medium') AS medium, count(*) FILTER (WHERE severity = 'Low') AS low, count(*) FILTER (WHERE source = 'kpi') AS predicted_anomalies FROM anomalies")
def snk2(t: Tables):
    return writers.report_header(t.anomalies, t.anomalies.where("source = 'kpi'"))


@query("snk2_table", f"WITH {EVENTS_CTE} SELECT severity, type, cell_id AS cell, detector, evidence FROM anomalies")
def snk2_table(t: Tables):
    return writers.anomaly_report(t.anomalies).select("severity", "type", "cell", "detector", "evidence")


@query("snk3", f"WITH {EVENTS_CTE} SELECT seq, source, severity, category FROM event_log")
def snk3(t: Tables):
    from radiolake.session import fresh_path

    path = fresh_path(t.spark, "result")
    writers.write_result(log(t, keep_raw=True).select("seq", "source", "severity", "category", "raw"), path)
    return t.spark.read.schema("seq bigint, source string, severity string, category string").json(path)
