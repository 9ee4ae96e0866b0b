"""Normalisation, derivation and exploration queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from radiolake.catalogue import kpi as K
from radiolake.functions.columns import rnd
from radiolake.operators import derive as V
from radiolake.operators import explore as X
from radiolake.operators import kpi_detectors as D
from radiolake.operators import normalise as N
from radiolake.plans.bindings import ANOMALIES_CTE, SEV, COUNTERS_CTE, COUNTERS_LONG_CTE, DIM_CTE, HOURLY_CTE, KPI_CTE, KPI_LIST, Tables
from radiolake.plans.registry import query, r
from radiolake.session import fresh_path
from radiolake.sources import readers, writers

PRB = "PRB_Utilization_DL_%"


# ------------------------------------------------------------ sources and routing

@query("src1", f"""WITH {KPI_CTE} SELECT count(*) AS "rows", count(DISTINCT cell_id) AS n_cells, {r('sum(value)', 2)} AS total FROM kpi_long""")
def src1(t: Tables):
    df = readers.read_table(t.spark, f"{t.dir}/events.parquet")
    from radiolake.plans.bindings import instants, kpi_from_events

    f = kpi_from_events(instants(df))
    return f.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("cell_id").alias("n_cells"), rnd(F.sum("value"), 2).alias("total"))


@query("src2", f"""WITH {COUNTERS_CTE} SELECT count(*) AS "rows", count(DISTINCT cell_id) AS n_cells,
 {r('avg(dl_prb_util)', 4)} AS prb, {r('avg(dl_bler)', 4)} AS bler FROM counters""")
def src2(t: Tables):
    """Counters written as a CSV export and read back by the reader."""
    from radiolake.plans.bindings import counters_from_lineitem, instants

    read = counters_from_lineitem(instants(readers.read_table(t.spark, f"{t.dir}/lineitem.parquet"))).drop("seq")
    path = fresh_path(t.spark, "counter-export")
    read.write.option("header", True).csv(path)
    return readers.read_table(t.spark, path, "csv", read.schema).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("cell_id").alias("n_cells"),
        rnd(F.avg("dl_prb_util"), 4).alias("prb"), rnd(F.avg("dl_bler"), 4).alias("bler"),
    )


@query("src4", """SELECT event_type AS Protocol, count(*) AS packets, sum(length(props))::BIGINT AS bytes,
 count(DISTINCT user_id) AS sources FROM events GROUP BY ALL""")
def src4(t: Tables):
    """Events exported as a packet list, read back by the reader."""
    path = fresh_path(t.spark, "packet-list")
    t.events.select(
        F.col("event_id").alias("No."), F.unix_micros("ts").cast("double").alias("Time"), F.col("user_id").cast("string").alias("Source"),
        F.lit("10.0.0.1").alias("Destination"), F.col("event_type").alias("Protocol"), F.length("props").alias("Length"), F.col("props").alias("Info"),
    ).write.option("header", True).csv(path)
    return readers.read_packet_list(t.spark, path).groupBy("Protocol").agg(
        F.count("packet_no").alias("packets"), F.sum("Length").alias("bytes"), F.count_distinct("Source").alias("sources")
    )


ROUTES = {"events": "stats", "kpi": "kpi", "payload": "pcap", "forced": "pcap", "workbook": "kpi", "capture": "pcap", "unknown": "stats"}


@query("src6", " UNION ALL ".join(f"SELECT '{n}' AS name, '{k}' AS route, count(*) AS n FROM events" for n, k in ROUTES.items())
       + " UNION ALL SELECT 'srsran', 'stats', count(*) FROM lineitem")
def src6(t: Tables):
    wide = t.kpi_hourly.columns
    cases = {
        "events": readers.route(t.events.columns, "x.parquet"), "kpi": readers.route(wide, "x.csv"), "payload": readers.route(["ts", "seq", "payload"]),
        "forced": readers.route(wide, "x.csv", forced="pcap"), "workbook": readers.route(["foo"], "x.XLSX"), "capture": readers.route(["foo"], "x.pcapng"),
        "unknown": readers.route(["foo", "bar"]),
    }

    def rows(df, found):
        named = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(k).alias("route")) for n, k in found.items()])
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.explode(named).alias("c"), "n").select("c.name", "c.route", "n")

    return rows(t.events, cases).unionByName(rows(t.table("lineitem"), {"srsran": readers.route(["pci", "dl_nof_ok", "dl_nof_nok"])}))


@query("snk1", """SELECT doc_id AS feedback_id, substr(text, 1, 200) AS evidence FROM documents JOIN labels USING (doc_id)""")
def snk1(t: Tables):
    return writers.feedback_rows(t.feedback).select(F.col("feedback_id").cast("bigint").alias("feedback_id"), "evidence")


@query("snk4", f"""WITH {KPI_CTE}, o AS (SELECT kpi AS method, {r('avg(value)', 3)} AS score FROM kpi_long GROUP BY kpi),
 n AS (SELECT kpi AS method, {r('max(value)', 3)} AS score FROM kpi_long WHERE value >= 100 AND channel_type = 'TDD' AND kpi LIKE 'PRB%' GROUP BY kpi)
 SELECT method, score FROM o WHERE method NOT IN (SELECT method FROM n) UNION ALL SELECT method, score FROM n""")
def snk4(t: Tables):
    old = t.kpi.groupBy(F.col("kpi").alias("method")).agg(rnd(F.avg("value"), 3).alias("score"))
    rerun = t.kpi.where((F.col("value") >= 100) & (F.col("channel_type") == "TDD") & F.col("kpi").startswith("PRB"))
    return writers.replace_by_key(old, rerun.groupBy(F.col("kpi").alias("method")).agg(rnd(F.max("value"), 3).alias("score")), ["method"])


# ------------------------------------------------------------ normalisation

@query("nrm1", f"""WITH {HOURLY_CTE} SELECT cell_id, ts, "{PRB}" AS "{PRB}", coalesce("Latency_ms", "UL_Throughput_Mbps") AS "Latency_ms" FROM kpi_hourly""")
def nrm1(t: Tables):
    raw = t.kpi_hourly.select(
        "cell_id", "ts", F.col(N.q(PRB)).alias("DL_PRB_Usage"), F.col("Latency_ms").alias("avg_latency"),
        F.col("UL_Throughput_Mbps").alias("latency"),
    )
    return N.resolve_columns(raw)


@query("nrm2", f"""WITH {HOURLY_CTE} SELECT 'ts' AS role, 'time' AS "name", count(*) AS n FROM kpi_hourly UNION ALL
 SELECT 'cell', 'Cell_ID', count(DISTINCT cell_id) FROM kpi_hourly UNION ALL SELECT 'gnb', 'gNB_ID', count(DISTINCT gnb_id) FROM kpi_hourly
 UNION ALL SELECT 'measure', 'Latency_ms', count("Latency_ms") FROM kpi_hourly""")
def nrm2(t: Tables):
    raw = t.kpi_hourly.select(
        F.col("ts").alias("time"), F.col("cell_id").alias("Cell_ID"), F.col("gnb_id").alias("gNB_ID"), "Latency_ms"
    )
    roles = N.column_roles(raw)
    agg = raw.agg(
        F.count(F.lit(1)).alias("a"), F.count_distinct(roles.cell).alias("b"), F.count_distinct(roles.gnb).alias("c"),
        F.count(roles.measures[0]).alias("d"),
    )
    names = [("ts", roles.ts, "a"), ("cell", roles.cell, "b"), ("gnb", roles.gnb, "c"), ("measure", roles.measures[0], "d")]
    rows = F.array(*[F.struct(F.lit(x).alias("role"), F.lit(y).alias("name"), F.col(z).alias("n")) for x, y, z in names])
    return agg.select(F.inline(rows))


@query("nrm3", """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE ts END AS ts FROM events""")
def nrm3(t: Tables):
    text = F.when(F.col("event_id") % 7 == 0, F.lit("fleet-avg")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    return t.events.select("event_id", N.parse_ts(text).alias("ts"))


@query("nrm4", f"""WITH {HOURLY_CTE} {' UNION ALL '.join(f'''SELECT cell_id, ts, '{k}' AS kpi, {r(f'"{k}"', 6)} AS value FROM kpi_hourly WHERE "{k}" IS NOT NULL''' for k in KPI_LIST)}""")
def nrm4(t: Tables):
    facts = N.kpi_facts(t.kpi_hourly.withColumnRenamed("ts", "timestamp"))
    return facts.where(F.col("value").isNotNull()).select("cell_id", "ts", "kpi", rnd("value", 6).alias("value"))


@query("nrm5", """SELECT CASE WHEN l_suppkey % 4 = 0 THEN 'srsran' WHEN l_suppkey % 4 = 1 THEN 'oai' WHEN l_suppkey % 4 = 2 THEN 'nist'
 ELSE 'generic' END AS shape, count(*) AS n FROM lineitem GROUP BY ALL""")
def nrm5(t: Tables):
    """A quarter of the rows under the column names of each vendor; the shape is found from the frame itself."""
    names = [("PCI", "dl_prb"), ("cell_id", "SNR"), ("Cell", "RSRP_dBm"), ("foo", "bar")]
    out = []
    for n, (cell, value) in enumerate(names):
        frame = t.table("lineitem").where(F.col("l_suppkey") % 4 == n).select(F.col("l_suppkey").alias(cell), F.col("l_quantity").alias(value))
        out.append(frame.agg(F.count(F.lit(1)).alias("n")).select(F.lit(N.detect_shape(frame.columns)).alias("shape"), "n"))
    return reduce(lambda a, b: a.unionByName(b), out)


@query("nrm6", f"""WITH m AS (SELECT max(l_quantity) AS top FROM lineitem) SELECT 'PCI_' || (l_suppkey % 16) AS cell_id, l_shipdate AS ts,
 CASE WHEN top <= 110 THEN {r('l_quantity / 106.0 * 100', 1)} ELSE l_quantity END AS dl_prb_util,
 {r("(l_suppkey % 5) / nullif((l_partkey % 7 + l_suppkey % 5)::DOUBLE, 0) * 100", 2)} AS dl_bler,
 {r("l_extendedprice / 1e6", 2)} AS dl_throughput_mbps, l_linenumber::DOUBLE AS nof_ue FROM lineitem, m""")
def nrm6(t: Tables):
    raw = t.table("lineitem").select(
        F.col("l_shipdate").alias("timestamp"), F.concat(F.lit("PCI_"), (F.col("l_suppkey") % 16).cast("string")).alias("pci"),
        F.col("l_quantity").alias("dl_prb"), (F.col("l_partkey") % 7).alias("dl_nof_ok"),
        (F.col("l_suppkey") % 5).alias("dl_nof_nok"), F.col("l_extendedprice").alias("dl_brate"),
        F.col("l_linenumber").alias("nof_ue"), F.col("l_orderkey").alias("seq"),
    )
    return N.normalise_counters(raw).select("cell_id", "ts", "dl_prb_util", "dl_bler", "dl_throughput_mbps", "nof_ue")


@query("nrm7", f"""SELECT 'c' || (l_suppkey % 16) AS cell_id, l_quantity AS dl_prb_util, l_discount * 100 AS dl_bler,
 {r("(l_suppkey % 5) / nullif((l_partkey % 7)::DOUBLE, 0) * 100", 2)} AS ul_bler, l_linenumber::DOUBLE AS dl_mcs, l_tax AS snr_db,
 {r("l_extendedprice / 1e6", 2)} AS ul_throughput_mbps FROM lineitem""")
def nrm7(t: Tables):
    raw = t.table("lineitem").select(
        F.col("l_shipdate").alias("timestamp"), F.concat(F.lit("c"), (F.col("l_suppkey") % 16).cast("string")).alias("cell_id"),
        F.col("l_quantity").alias("PRB_DL"), (F.col("l_discount") * 100).alias("DL_BLER"),
        (F.col("l_partkey") % 7).alias("ulsch_total"), (F.col("l_suppkey") % 5).alias("ulsch_errors"),
        F.col("l_linenumber").alias("DL_MCS1"), F.col("l_tax").alias("SNR"), F.col("l_extendedprice").alias("UL_bitrate"),
    )
    return N.normalise_counters(raw).select("cell_id", "dl_prb_util", "dl_bler", "ul_bler", "dl_mcs", "snr_db", "ul_throughput_mbps")


@query("nrm8", """SELECT 'c' || (l_suppkey % 16) AS cell_id, -l_quantity AS rsrp_dbm, l_discount AS dl_bler, l_tax AS ul_bler,
 l_quantity AS dl_prb_util, l_linenumber::DOUBLE AS dl_harq_nack, l_extendedprice AS dl_throughput_mbps FROM lineitem""")
def nrm8(t: Tables):
    raw = t.table("lineitem").select(
        F.col("l_shipdate").alias("Time"), F.concat(F.lit("c"), (F.col("l_suppkey") % 16).cast("string")).alias("Cell"),
        (-F.col("l_quantity")).alias("RSRP_dBm"), F.col("l_discount").alias("DL_BLER_pct"), F.col("l_tax").alias("UL_BLER_pct"),
        F.col("l_quantity").alias("PRB_Utilization_pct"), F.col("l_linenumber").alias("HARQ_NACK_DL"),
        F.col("l_extendedprice").alias("DL_Throughput_Mbps"),
    )
    return N.normalise_counters(raw).select("cell_id", "rsrp_dbm", "dl_bler", "ul_bler", "dl_prb_util", "dl_harq_nack", "dl_throughput_mbps")


@query("nrm9", """SELECT 'PCI_' || (l_suppkey % 16 + 1) AS cell_id, l_shipdate AS ts, 2.0::DOUBLE * l_quantity AS dl_prb_util FROM lineitem""")
def nrm9(t: Tables):
    return N.normalise_counters(t.counters.select("cell_id", F.col("ts").alias("date"), "seq", "dl_prb_util")).select(
        "cell_id", "ts", "dl_prb_util")


# ------------------------------------------------------------ derivations

@query("drv1", f"""WITH {COUNTERS_CTE}, g AS (SELECT cell_id, seq, CASE WHEN seq % 3 = 0 THEN dl_prb_util END AS v, dl_bler AS b,
 row_number() OVER (ORDER BY seq, ts, dl_prb_util) AS i FROM counters) SELECT seq, last_value(v IGNORE NULLS) OVER (PARTITION BY cell_id ORDER BY seq, b
 ROWS UNBOUNDED PRECEDING) AS dl_prb_util FROM g""")
def drv1(t: Tables):
    gappy = t.counters.withColumn("dl_prb_util", F.when(F.col("seq") % 3 == 0, F.col("dl_prb_util")))
    filled = V.forward_fill(gappy, ["dl_prb_util"], order=("seq", "dl_bler"))
    return filled.select("seq", "dl_prb_util")


@query("drv2", f"""WITH {COUNTERS_CTE}, b AS (SELECT seq, dl_prb_util AS v, dl_bler AS b, avg(dl_prb_util) OVER w AS m, avg(dl_bler) OVER w AS mb,
 count(*) OVER w AS c FROM counters WINDOW w AS (PARTITION BY cell_id ORDER BY ts, seq, dl_bler ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))
 SELECT seq, CASE WHEN c >= 5 THEN {r('v - m', 3)} END AS dl_prb_util_baseline_delta, CASE WHEN c >= 5 THEN {r('v - m', 3)} END AS prb_baseline_delta,
 CASE WHEN c >= 5 THEN {r('b - mb', 3)} END AS dl_bler_baseline_delta FROM b""")
def drv2(t: Tables):
    out = V.rolling_baseline(t.counters, ["dl_prb_util", "dl_bler"], order=("ts", "seq", "dl_bler"))
    return out.select("seq", "dl_prb_util_baseline_delta", "dl_bler_baseline_delta", "prb_baseline_delta")


@query("drv3", f"""WITH {COUNTERS_CTE} SELECT cell_id, sum(CASE WHEN dl_prb_util > 80 AND dl_bler > 5 THEN 1.0::DOUBLE ELSE 0.0 END) AS hits FROM counters GROUP BY ALL""")
def drv3(t: Tables):
    return V.congestion_score(t.counters).groupBy("cell_id").agg(F.sum("congestion_score").alias("hits"))


@query("drv4", """SELECT event_id, hour(ts)::DOUBLE AS hour_of_day, (isodow(ts) - 1)::DOUBLE AS day_of_week FROM events""")
def drv4(t: Tables):
    return V.calendar(t.events).select("event_id", "hour_of_day", "day_of_week")


@query("drv5", f"""WITH {KPI_CTE} SELECT cell_id, arg_min(channel_type, seq) AS channel_type,
 CASE WHEN arg_min(channel_type, seq) = 'TDD' THEN 1400.0::DOUBLE ELSE 84.0 END AS dl_mbps,
 CASE WHEN arg_min(channel_type, seq) = 'TDD' THEN 100.0::DOUBLE ELSE 50.0 END AS ul_mbps FROM kpi_long GROUP BY cell_id""")
def drv5(t: Tables):
    return V.capacity_map(t.kpi)


@query("drv6", f"""WITH {KPI_CTE} SELECT seq, CASE WHEN kpi LIKE 'DL_Th%' THEN {r("value / CASE WHEN channel_type = 'TDD' THEN 1400.0 ELSE 84.0 END * 100", 4)}
 WHEN kpi LIKE 'UL_Th%' THEN {r("value / CASE WHEN channel_type = 'TDD' THEN 100.0 ELSE 50.0 END * 100", 4)} END AS normalized_pct FROM kpi_long""")
def drv6(t: Tables):
    return V.capacity_share(t.kpi).select("seq", "normalized_pct")


@query("drv7", f"""WITH {KPI_CTE}, d AS (SELECT cell_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY cell_id ORDER BY ts, seq))) / 1e6 AS g FROM kpi_long),
 m AS (SELECT cell_id, quantile_cont(g, 0.5) AS m FROM d WHERE g IS NOT NULL GROUP BY cell_id) SELECT {r('quantile_cont(m, 0.5)', 3)} AS freq_s FROM m""")
def drv7(t: Tables):
    return V.sampling_interval(t.kpi).select(rnd("freq_s", 3).alias("freq_s"))


@query("drv8", """SELECT seq, CASE WHEN procedure LIKE 'NAS_Registration%' THEN 'Registration Failure' WHEN procedure LIKE 'NAS_Authentication%' THEN 'Authentication Failure'
 WHEN procedure LIKE 'NAS_PDUSession%' THEN 'Data Session Failure' WHEN procedure LIKE 'NAS_SecurityMode%' THEN 'Security Setup Failure'
 WHEN procedure LIKE 'NGAP_Initial%' THEN 'Initial Context Failure' WHEN procedure LIKE 'NGAP_PDU%' THEN 'PDU Session Failure'
 WHEN procedure = 'RRC_Setup' THEN 'Radio Connection Failure' WHEN procedure = 'RRC_Reconfiguration' THEN 'Reconfiguration Anomaly'
 WHEN procedure = 'F1AP_UEContextSetup' THEN 'UE Context Failure (DU-CU)' WHEN procedure LIKE 'E1AP_Bearer%' THEN 'Bearer Setup Failure'
 WHEN procedure LIKE 'XnAP_Handover%' THEN 'Handover Failure' ELSE 'F1ap Dlrrcmessagetransfer' END AS plain_type,
 CASE split_part(procedure, '_', 1) WHEN 'NAS' THEN 'Core (NAS)' WHEN 'NGAP' THEN 'Core (NGAP)' WHEN 'RRC' THEN 'Radio (RRC)' WHEN 'F1AP' THEN 'DU-CU (F1)'
 WHEN 'E1AP' THEN 'DU-CU (E1)' WHEN 'XnAP' THEN 'Inter-gNB (Xn)' END AS plain_layer,
 CASE WHEN lower(procedure) LIKE '%auth%' THEN 'Check UE subscription and AUSF/UDM' WHEN lower(procedure) LIKE '%handover%' OR lower(procedure) LIKE '%ho%' THEN
 'Check HO parameters and neighbor cell coverage' WHEN lower(procedure) LIKE '%bearer%' OR lower(procedure) LIKE '%pdu%' THEN 'Check UPF/SMF connectivity'
 ELSE 'Investigate and escalate to NOC' END AS "action" FROM (WITH """ + ANOMALIES_CTE + " SELECT * FROM anomalies)")
def drv8(t: Tables):
    layer = F.split_part("procedure", F.lit("_"), F.lit(1))
    return t.anomalies.select(
        "seq", V.plain_type(F.col("type")).alias("plain_type"), V.plain_layer(layer).alias("plain_layer"),
        V.short_action(F.col("evidence"), F.lit(None).cast("string"), F.col("type")).alias("action"),
    )


# ------------------------------------------------------------ exploration

def _summary_sql(src: str, by: str, d: int) -> str:
    return f"""SELECT {by}, {r('min(value)', d)} AS min, {r('max(value)', d)} AS max, {r('avg(value)', d)} AS mean, {r('stddev_samp(value)', d)} AS std,
 {r('quantile_cont(value, 0.1)', d)} AS p10, {r('quantile_cont(value, 0.9)', d)} AS p90 FROM {src} GROUP BY {by}"""


@query("agg1", f"WITH {KPI_CTE}, {DIM_CTE}, s AS ({_summary_sql('kpi_long', 'kpi', 4)}) SELECT s.*, label, category, unit, direction, target, warning, critical FROM s JOIN kpi_dim USING (kpi)")
def agg1(t: Tables):
    return X.kpi_summary(t.kpi)


@query("agg2", f"WITH {COUNTERS_LONG_CTE} {_summary_sql('counters_long', 'metric', 3)}")
def agg2(t: Tables):
    return X.summary(t.counters_long, "metric", 3)


@query("agg3", f'WITH {KPI_CTE} SELECT count(*) AS "rows", count(DISTINCT cell_id) AS n_cells, count(DISTINCT gnb_id) AS n_gnbs, min(ts) AS start_ts, max(ts) AS end_ts FROM kpi_long')
def agg3(t: Tables):
    return X.profile(t.kpi)


@query("agg4", f"""WITH {KPI_CTE}, {DIM_CTE}, s AS ({_summary_sql('kpi_long', 'kpi', 4)}) SELECT kpi, {r('mean', 2)} AS mean, p10, p90,
 CASE WHEN warning IS NULL THEN 'info' WHEN direction = 'lower_better' THEN CASE WHEN mean >= critical THEN 'red' WHEN mean >= warning THEN 'amber' ELSE 'green' END
 ELSE CASE WHEN mean <= critical THEN 'red' WHEN mean <= warning THEN 'amber' ELSE 'green' END END AS status FROM s JOIN kpi_dim USING (kpi)""")
def agg4(t: Tables):
    return X.health_table(t.kpi).select("kpi", "mean", "p10", "p90", "status")


@query("agg5", f"WITH {KPI_CTE} SELECT ts, {r('avg(value)', 4)} AS value FROM kpi_long WHERE kpi = '{PRB}' GROUP BY ts")
def agg5(t: Tables):
    return X.fleet_average(t.kpi, PRB)


@query("agg6", f"WITH {KPI_CTE} SELECT cell_id, {r('avg(value)', 4)} AS mean_value FROM kpi_long WHERE kpi = '{PRB}' GROUP BY cell_id")
def agg6(t: Tables):
    return X.cell_ranking(t.kpi, PRB)


@query("agg7", f"""WITH {KPI_CTE}, m AS (SELECT * FROM kpi_long WHERE kpi = '{PRB}'), top AS (SELECT cell_id, {r('avg(value)', 4)} AS v FROM m GROUP BY cell_id ORDER BY v DESC, cell_id LIMIT 6)
 SELECT cell_id AS series, ts, {r('avg(value)', 4)} AS value FROM m WHERE cell_id IN (SELECT cell_id FROM top) GROUP BY ALL
 UNION ALL SELECT 'Fleet average', ts, {r('avg(value)', 4)} FROM m GROUP BY ts""")
def agg7(t: Tables):
    return X.top_cells_with_fleet(t.kpi, PRB)


@query("agg8", f"""WITH {KPI_CTE} SELECT cell_id, gnb_id, {', '.join(f'''{r(f"avg(CASE WHEN kpi = '{k}' THEN value END)", 2)} AS "{k}"''' for k in KPI_LIST)} FROM kpi_long GROUP BY cell_id, gnb_id""")
def agg8(t: Tables):
    return X.mean_matrix(t.kpi, KPI_LIST)


THIN = """i AS (SELECT *, row_number() OVER ({p} ORDER BY ts) - 1 AS idx, count(*) OVER ({p}) AS n FROM pts)
 SELECT {cols} FROM i WHERE n <= {m} OR idx IN (SELECT CAST(floor(g * (n / {m}.0::DOUBLE)) AS BIGINT) FROM range({m}) t(g))"""


@query("agg9", f"""WITH {KPI_CTE}, pts AS (SELECT ts, {r("avg(CASE WHEN kpi = 'DL_Throughput_Mbps' THEN value END)", 2)} AS throughput_mbps, {r(f"avg(CASE WHEN kpi = '{PRB}' THEN value END)", 2)} AS prb_pct
 FROM kpi_long WHERE kpi IN ('DL_Throughput_Mbps', '{PRB}') GROUP BY ts), {THIN.format(p='', cols='ts, throughput_mbps, prb_pct', m=60)}""")
def agg9(t: Tables):
    return X.two_metric_trend(t.kpi, "DL_Throughput_Mbps", PRB)


@query("agg10", f"""WITH {KPI_CTE}, pts AS (SELECT kpi, cell_id, ts, {r('avg(value)', 4)} AS value FROM kpi_long WHERE gnb_id IN ('gNB-1', 'gNB-2') AND kpi IN ('{PRB}', 'Latency_ms') GROUP BY ALL),
 {THIN.format(p='PARTITION BY kpi, cell_id', cols='kpi, cell_id, ts, value', m=80)}""")
def agg10(t: Tables):
    return X.series(t.kpi, kpis=[PRB, "Latency_ms"], gnbs=["gNB-1", "gNB-2"])


@query("agg11", f"""WITH {KPI_CTE}, pts AS (SELECT cell_id, kpi, ts, seq FROM kpi_long), {THIN.format(p='PARTITION BY cell_id, kpi', cols='cell_id, kpi, ts, seq', m=37)}""")
def agg11(t: Tables):
    return X.downsample(t.kpi.select("cell_id", "kpi", "ts", "seq"), ["cell_id", "kpi"], ["ts"], 37)


@query("agg12", f"""WITH {KPI_CTE} SELECT DISTINCT 'gnb' AS kind, gnb_id AS value FROM kpi_long UNION ALL SELECT DISTINCT 'cell', cell_id FROM kpi_long UNION ALL SELECT DISTINCT 'kpi', kpi FROM kpi_long""")
def agg12(t: Tables):
    return X.picker_values(t.kpi)


@query("agg13", f"""WITH {KPI_CTE} SELECT seq, ts FROM kpi_long WHERE ts >= (SELECT max(ts) FROM kpi_long) - INTERVAL 48 HOUR""")
def agg13(t: Tables):
    return X.in_range(t.kpi, last_hours=48).select("seq", "ts")


@query("agg13_range", f"""WITH {KPI_CTE} SELECT kpi, count(*) AS n FROM kpi_long WHERE ts BETWEEN '2024-01-05' AND '2024-01-12' GROUP BY kpi""")
def agg13_range(t: Tables):
    return X.in_range(t.kpi, start="2024-01-12", end="2024-01-05").groupBy("kpi").agg(F.count(F.lit(1)).alias("n"))


@query("agg14", f"WITH {KPI_CTE} SELECT cell_id, count(*) AS n FROM kpi_long WHERE gnb_id IN ('gNB-1', 'gNB-3') GROUP BY cell_id")
def agg14(t: Tables):
    return X.selected(t.kpi, gnbs=["gNB-1", "gNB-3"]).groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"))


@query("agg15", f"""WITH {ANOMALIES_CTE}, c AS (SELECT 'cell' AS kind, cell_id AS value, count(*) AS n FROM anomalies GROUP BY cell_id ORDER BY n DESC, value LIMIT 10)
 SELECT 'severity' AS kind, severity AS value, count(*) AS n FROM anomalies GROUP BY severity UNION ALL SELECT 'detector', detector, count(*) FROM anomalies GROUP BY detector
 UNION ALL SELECT * FROM c""")
def agg15(t: Tables):
    return X.anomaly_distribution(t.anomalies)


@query("agg16", f"""WITH {ANOMALIES_CTE}, d AS (SELECT label, cell_id, source, max({SEV}) AS rk FROM anomalies GROUP BY ALL), n(rk, name) AS (VALUES (4, 'Critical'), (3, 'High'), (2, 'Medium'), (1, 'Low')),
 w AS (SELECT label, cell_id, max(CASE WHEN source = 'kpi' THEN rk END) AS k, max(CASE WHEN source = 'stats' THEN rk END) AS s, max(CASE WHEN source = 'pcap' THEN rk END) AS p FROM d GROUP BY ALL)
 SELECT label, cell_id, (SELECT name FROM n WHERE n.rk = k) AS kpi, (SELECT name FROM n WHERE n.rk = s) AS stats, (SELECT name FROM n WHERE n.rk = p) AS pcap,
 (k IS NOT NULL)::INT + (s IS NOT NULL)::INT + (p IS NOT NULL)::INT AS confirmed_by FROM w""")
def agg16(t: Tables):
    a = t.anomalies.withColumn("detector", F.col("source"))
    return X.method_matrix(a, ["kpi", "stats", "pcap"])
