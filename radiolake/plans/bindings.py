"""Driver tables seen as network facts, once in DataFrame and once in SQL form.

``events`` become KPI readings, signalling messages and anomalies; ``lineitem``
becomes radio counters; ``labels`` with ``documents`` become engineer verdicts;
``embeddings``, ``documents`` and ``benchmark`` serve retrieval.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from radiolake.catalogue import counters as C
from radiolake.catalogue import kpi as K
from radiolake.catalogue import protocol as P

EVENT_KPI = {
    "click": "PRB_Utilization_DL_%",
    "view": "PRB_Utilization_UL_%",
    "signup": "DL_Throughput_Mbps",
    "purchase": "UL_Throughput_Mbps",
    "error": "Latency_ms",
}
KPI_LIST = list(EVENT_KPI.values())
PROCS = [
    "NAS_Registration", "NAS_Authentication", "NAS_SecurityMode", "NAS_PDUSession_Establishment", "RRC_Setup",
    "RRC_Reconfiguration", "NGAP_InitialContextSetup", "NGAP_PDUSessionResourceSetup", "F1AP_UEContextSetup",
    "F1AP_DLRRCMessageTransfer", "E1AP_BearerContextSetup", "XnAP_HandoverRequest",
]
EVENT_ROLE = {"signup": "request", "view": "request", "click": "accept", "purchase": "complete", "error": "reject"}
FAIL_CAUSES = ["congestion", "auth-failure", "mac-failure", "user-inactivity", "unknown"]
EVENT_SOURCE = {"click": "kpi", "view": "stats", "error": "pcap"}


def lit_list(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def case_map(expr: str, mapping: dict) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {expr} {whens} END"


def pick(expr: str, values: list[str]) -> str:
    return f"list_extract([{lit_list(values)}], CAST(({expr}) AS INTEGER) + 1)"


def choose(col, mapping: dict):
    out = F
    for k, v in mapping.items():
        out = out.when(col == k, v)
    return out


def sql_value(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float)):
        return f"CAST({v!r} AS DOUBLE)"
    return "'" + str(v).replace("'", "''") + "'"


def values_cte(name: str, cols: list[str], rows) -> str:
    body = ", ".join("(" + ", ".join(sql_value(v) for v in row) + ")" for row in rows)
    return f"{name}({', '.join(cols)}) AS (VALUES {body})"


def instants(df: DataFrame) -> DataFrame:
    """Zone-less timestamps become instants (the session zone is UTC)."""
    casts = {
        f.name: F.col(f.name).cast("timestamp") for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)
    }
    return df.withColumns(casts) if casts else df


class Tables:
    """Lazily opened driver tables and the facts derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return instants(self.spark.read.parquet(f"{self.dir}/{name}.parquet"))

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events")

    @cached_property
    def kpi(self) -> DataFrame:
        """Binding A: one KPI reading per event."""
        return kpi_from_events(self.events)

    @cached_property
    def kpi_hourly(self) -> DataFrame:
        """Binding A2, wide: mean of each KPI per cell and hour."""
        hour = F.date_trunc("hour", "ts")
        wide = self.kpi.groupBy("cell_id", "gnb_id", "channel_type", hour.alias("ts")).pivot("kpi", KPI_LIST).agg(
            F.avg("value")
        )
        cell = F.split_part("cell_id", F.lit("_"), F.lit(2)).cast("bigint")
        gnb = F.split_part("gnb_id", F.lit("-"), F.lit(2)).cast("bigint")
        return wide.withColumn("seq", F.unix_seconds("ts") * 1000 + cell * 10 + gnb)

    @cached_property
    def counters(self) -> DataFrame:
        """Binding B, wide: lineitem rows as radio counters."""
        return counters_from_lineitem(self.table("lineitem"))

    @cached_property
    def counters_long(self) -> DataFrame:
        return self.counters.unpivot(
            ["cell_id", "ts", "seq"], ["dl_prb_util", "dl_bler", "ul_bler"], "metric", "value"
        )

    @cached_property
    def messages(self) -> DataFrame:
        """Binding C: events as signalling messages."""
        return messages_from_events(self.events)

    @cached_property
    def payloads(self) -> DataFrame:
        """Binding C2: the same messages as compact binary payloads."""
        return payloads_from_events(self.events)

    @cached_property
    def anomalies(self) -> DataFrame:
        """Binding D: click, view and error events as anomalies of three sources."""
        return anomalies_from_events(self.events)

    @cached_property
    def feedback(self) -> DataFrame:
        """Binding E: document labels as engineer verdicts."""
        from radiolake.operators.feedback import BASE_PARAMS

        detectors = [d for d, _, _ in BASE_PARAMS]
        j = self.table("labels").join(self.table("documents"), "doc_id")
        verdict = F.when(F.col("toxic") == 1, "uncertain").when(F.col("quality") == 1, "correct")
        return j.select(
            F.col("doc_id").alias("feedback_id"),
            verdict.otherwise("false_positive").alias("verdict"),
            F.get(F.array(*[F.lit(d) for d in detectors]), (F.col("doc_id") % len(detectors)).cast("int")).alias(
                "detector"
            ),
            F.col("lang").alias("source"),
            F.col("text").alias("evidence"),
        )


def counters_from_lineitem(li: DataFrame) -> DataFrame:
    return li.select(
        F.concat(F.lit("PCI_"), (F.col("l_suppkey") % 16 + 1).cast("string")).alias("cell_id"),
        F.col("l_shipdate").alias("ts"),
        ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1000003 + F.col("l_partkey")).alias("seq"),
        (F.lit(2.0) * F.col("l_quantity")).alias("dl_prb_util"),
        (F.lit(200.0) * F.col("l_discount")).alias("dl_bler"),
        (F.lit(200.0) * F.col("l_tax")).alias("ul_bler"),
    )


def kpi_from_events(ev: DataFrame) -> DataFrame:
    u = F.col("user_id")
    return ev.select(
        F.concat(F.lit("PCI_"), (u % 16 + 1).cast("string")).alias("cell_id"),
        F.concat(F.lit("gNB-"), (u % 4 + 1).cast("string")).alias("gnb_id"),
        F.when(u % 16 < 8, "TDD").otherwise("FDD").alias("channel_type"),
        "ts",
        F.col("event_id").alias("seq"),
        F.lit(None).cast("double").alias("prb_ul"),
        choose(F.col("event_type"), EVENT_KPI).alias("kpi"),
        "value",
    )


def messages_from_events(ev: DataFrame) -> DataFrame:
    u = F.col("user_id")
    k = F.from_json("props", "k int")["k"]
    proc = F.get(F.array(*[F.lit(p) for p in PROCS]), (u % 12).cast("int"))
    role = choose(F.col("event_type"), EVENT_ROLE)
    cause = F.get(F.array(*[F.lit(c) for c in FAIL_CAUSES]), k % 5)
    return ev.select(
        "ts",
        F.col("event_id").alias("seq"),
        F.split_part(proc, F.lit("_"), F.lit(1)).alias("layer"),
        proc.alias("procedure"),
        role.alias("role"),
        u.cast("string").alias("ue_id"),
        F.concat(F.lit("PCI_"), (u % 16 + 1).cast("string")).alias("cell_id"),
        F.when(role == "reject", cause).alias("cause"),
    )


# tag, code per procedure of PROCS; NAS codes are per role instead
PROC_TAGS = ["7E"] * 4 + ["2B", "2B", "3A", "3A", "1A", "1A", "1B", "1C"]
PROC_CODES = ["00"] * 4 + ["01", "03", "01", "02", "02", "05", "02", "02"]
NAS_OPEN, NAS_OK, NAS_FAIL = ["41", "56", "5C", "C1"], ["42", "57", "5D", "C2"], ["44", "58", "5E", "C3"]


def payloads_from_events(ev: DataFrame) -> DataFrame:
    i = (F.col("user_id") % 12).cast("int")
    at = lambda values: F.get(F.array(*[F.lit(v) for v in values]), i)
    kind = F.when(F.col("event_type").isin("signup", "view"), 0).when(F.col("event_type") == "error", 2).otherwise(1)
    nas = F.when(kind == 0, at(NAS_OPEN)).when(kind == 1, at(NAS_OK)).otherwise(at(NAS_FAIL))
    third = F.when(i < 4, nas).otherwise(F.lpad(kind.cast("string"), 2, "0"))
    ident = F.lpad(F.hex("user_id"), 8, "0")
    cause = F.lpad(F.hex(F.from_json("props", "k bigint")["k"] % 30), 2, "0")
    text = F.concat(at(PROC_TAGS), at(PROC_CODES), third, ident)
    text = F.when(F.col("event_id") % 50 == 0, F.substring(text, 1, 12)).when(F.col("event_id") % 10 == 0, text).otherwise(
        F.concat(text, cause)
    )
    return ev.select("ts", F.col("event_id").alias("seq"), F.unhex(text).alias("payload"))


def anomalies_from_events(ev: DataFrame) -> DataFrame:
    u, v = F.col("user_id"), F.col("value")
    return ev.where(F.col("event_type").isin(list(EVENT_SOURCE))).select(
        choose(F.col("event_type"), EVENT_SOURCE).alias("source"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_id") % 97 != 0, F.col("ts")).alias("ts"),
        F.when((F.col("event_type") == "error") & (u % 5 == 0), "—")
        .otherwise(F.concat(F.lit("PCI_"), (u % 16 + 1).cast("string"))).alias("cell_id"),
        F.when(v >= 120, "Critical").when(v >= 60, "High").when(v >= 20, "Medium").otherwise("Low").alias("severity"),
        v.alias("score"),
        F.get(F.array(*[F.lit(p) for p in PROCS]), (u % 12).cast("int")).alias("procedure"),
        F.concat(F.get(F.array(*[F.lit(p) for p in PROCS]), (u % 12).cast("int")), F.lit(" anomaly")).alias("type"),
        choose(F.col("event_type"), EVENT_KPI).alias("label"),
        F.when(F.col("event_type") == "click", "Capacity").when(F.col("event_type") == "view", "DL Block Error Rate")
        .alias("category"),
        F.rint(v).alias("value"),
        F.lit("%").alias("unit"),
        F.concat(F.lit("reading near "), F.rint(v).cast("int").cast("string")).alias("evidence"),
        F.lit("Threshold").alias("detector"),
    )


# ---------------------------------------------------------------- SQL twins

KPI_CTE = f"""kpi_long AS (
 SELECT 'PCI_' || (user_id % 16 + 1) AS cell_id, 'gNB-' || (user_id % 4 + 1) AS gnb_id,
  CASE WHEN user_id % 16 < 8 THEN 'TDD' ELSE 'FDD' END AS channel_type, ts, event_id AS seq,
  {case_map('event_type', EVENT_KPI)} AS kpi, value FROM events)"""
DIM_CTE = values_cte(
    "kpi_dim", ["kpi", "label", "category", "unit", "direction", "target", "warning", "critical"],
    [k[:8] for k in K.KPIS],
)
HOURLY_CTE = f"""{KPI_CTE}, kpi_hourly AS (
 SELECT cell_id, gnb_id, channel_type, date_trunc('hour', ts) AS ts,
  {', '.join(f"avg(CASE WHEN kpi = '{k}' THEN value END) AS {chr(34)}{k}{chr(34)}" for k in KPI_LIST)}
 FROM kpi_long GROUP BY ALL)"""
HOURLY_LONG_CTE = f"""{HOURLY_CTE}, hourly_long AS (
 {' UNION ALL '.join(f'''SELECT cell_id, gnb_id, channel_type, ts, "PRB_Utilization_UL_%" AS prb_ul, '{k}' AS kpi,
  "{k}" AS value FROM kpi_hourly WHERE "{k}" IS NOT NULL''' for k in KPI_LIST)})"""
COUNTERS_CTE = """counters AS (
 SELECT 'PCI_' || (l_suppkey % 16 + 1) AS cell_id, l_shipdate AS ts,
  (l_orderkey * 8 + l_linenumber) * 1000003 + l_partkey AS seq, 2.0::DOUBLE * l_quantity AS dl_prb_util,
  200.0::DOUBLE * l_discount AS dl_bler, 200.0::DOUBLE * l_tax AS ul_bler FROM lineitem)"""
COUNTERS_LONG_CTE = f"""{COUNTERS_CTE}, counters_long AS (
 SELECT cell_id, ts, seq, 'dl_prb_util' AS metric, dl_prb_util AS value FROM counters
 UNION ALL SELECT cell_id, ts, seq, 'dl_bler', dl_bler FROM counters
 UNION ALL SELECT cell_id, ts, seq, 'ul_bler', ul_bler FROM counters)"""
COUNTER_DIM_CTE = values_cte(
    "counter_dim", ["metric", "unit", "descr", "warning", "critical", "worse_high"],
    [(m, u, d, w, c, C.worse_when_high(d)) for m, u, d, w, c in C.COUNTERS],
)
MESSAGES_CTE = f"""messages AS (
 SELECT ts, event_id AS seq, split_part({pick('user_id % 12', PROCS)}, '_', 1) AS layer,
  {pick('user_id % 12', PROCS)} AS procedure, {case_map('event_type', EVENT_ROLE)} AS role,
  CAST(user_id AS VARCHAR) AS ue_id, 'PCI_' || (user_id % 16 + 1) AS cell_id,
  CASE WHEN event_type = 'error' THEN {pick("CAST(json_extract(props, '$.k') AS INTEGER) % 5", FAIL_CAUSES)} END AS cause
 FROM events)"""
CLASSED_CTE = f"""{MESSAGES_CTE}, classed AS (
 SELECT *, CASE WHEN role IN ({lit_list(P.OPENING)}) THEN 'open' WHEN role IN ({lit_list(P.COMPLETING)}) THEN 'success'
  WHEN role IN ({lit_list(P.FAILING)}) THEN 'failure' END AS class,
  lower(layer) || '_' || procedure || '_' || ue_id AS tx_key FROM messages),
paired AS (
 SELECT *, lag(class) OVER w AS prev_class, lag(ts) OVER w AS prev_ts, lead(class) OVER w AS next_class
 FROM classed WHERE class IS NOT NULL WINDOW w AS (PARTITION BY tx_key ORDER BY ts, seq)),
outcomes AS (
 SELECT ts, seq, layer, procedure, ue_id, cell_id, cause, tx_key,
  CASE WHEN class = 'open' AND next_class IS NULL THEN 'timeout'
       WHEN class = 'open' AND next_class = 'open' THEN 'superseded'
       WHEN class = 'open' THEN 'answered'
       WHEN prev_class = 'open' THEN class ELSE 'orphan' END AS outcome, class, prev_ts FROM paired)"""
ANOMALIES_CTE = f"""anomalies AS (
 SELECT {case_map('event_type', EVENT_SOURCE)} AS source, event_id AS seq,
  CASE WHEN event_id % 97 <> 0 THEN ts END AS ts,
  CASE WHEN event_type = 'error' AND user_id % 5 = 0 THEN '—' ELSE 'PCI_' || (user_id % 16 + 1) END AS cell_id,
  CASE WHEN value >= 120 THEN 'Critical' WHEN value >= 60 THEN 'High' WHEN value >= 20 THEN 'Medium' ELSE 'Low' END
   AS severity, value AS score, {pick('user_id % 12', PROCS)} AS procedure,
  {pick('user_id % 12', PROCS)} || ' anomaly' AS type, {case_map('event_type', EVENT_KPI)} AS label,
  CASE event_type WHEN 'click' THEN 'Capacity' WHEN 'view' THEN 'DL Block Error Rate' END AS category,
  round_even(value, 0) AS value, 'reading near ' || CAST(round_even(value, 0) AS INTEGER) AS evidence,
  'Threshold' AS detector
 FROM events WHERE event_type IN ({lit_list(EVENT_SOURCE)}))"""
SEV = "CASE severity WHEN 'Critical' THEN 4 WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 1 ELSE 0 END"
EVENTS_CTE = f"""{ANOMALIES_CTE}, raw_events AS (
 SELECT source, 'current' AS state, CAST(0.0 AS DOUBLE) AS lead_time_h, seq, ts, cell_id, severity, score, detector, evidence,
  CASE WHEN source = 'pcap' THEN type ELSE label END AS category,
  CASE WHEN source = 'pcap' THEN procedure ELSE category END AS metric,
  CASE WHEN source = 'pcap' THEN split_part(procedure, '_', 1) ELSE upper(source) END AS layer,
  CASE WHEN source = 'pcap' THEN NULL ELSE value END AS value,
  CASE WHEN source = 'pcap' THEN type ELSE category END AS dedupe_name, value AS dedupe_value
 FROM anomalies), event_log AS (
 SELECT * FROM raw_events QUALIFY row_number() OVER (PARTITION BY source, state, lead_time_h, cell_id, dedupe_name,
  dedupe_value, evidence, detector ORDER BY seq) = 1), keyed AS (
 SELECT *, CASE WHEN cell_id <> '' AND cell_id <> '—' THEN cell_id
  WHEN lower(category) LIKE '%rrc%' THEN 'proc::rrc'
  WHEN lower(category) LIKE '%nas%' OR lower(category) LIKE '%registration%' OR lower(category) LIKE '%auth%'
    OR lower(category) LIKE '%pdu%' THEN 'proc::nas'
  WHEN lower(category) LIKE '%ngap%' OR lower(category) LIKE '%context%' OR lower(category) LIKE '%handover%'
    THEN 'proc::ngap'
  ELSE 'proc::' || substr(lower(category), 1, 20) END AS corr_key FROM event_log), seen AS (
 SELECT e.seq, o.source AS other FROM keyed e JOIN keyed o ON e.corr_key = o.corr_key
  AND (e.ts IS NULL OR o.ts IS NULL OR abs(epoch_us(e.ts) - epoch_us(o.ts)) <= 3600000000)
 GROUP BY e.seq, o.source), sources AS (SELECT seq, count(*) AS n_src FROM seen GROUP BY seq), correlated AS (
 SELECT k.*, s.n_src - 1 AS n_correlated,
  CASE WHEN s.n_src >= 2 THEN {"round_even(s.n_src / 3.0 * 100.0, 0) / 100.0"} ELSE 0.0 END AS confidence
 FROM keyed k JOIN sources s USING (seq))"""


PAYLOAD_CTE = f"""payloads AS (
 SELECT ts, event_id AS seq, event_id, split_part({pick('user_id % 12', PROCS)}, '_', 1) AS layer,
  {pick('user_id % 12', PROCS)} AS procedure, user_id,
  CASE WHEN event_type IN ('signup', 'view') THEN 0 WHEN event_type = 'error' THEN 2 ELSE 1 END AS kind,
  CASE WHEN event_id % 10 <> 0 THEN CAST(json_extract(props, '$.k') AS INTEGER) % 30 END AS cause_code
 FROM events WHERE event_id % 50 <> 0)"""
CAUSE_CTE = values_cte(
    "cause_dim", ["layer", "cause_code", "cause_name"],
    [("NAS", c, n) for c, n in P.NAS_CAUSES.items()]
    + [(layer, c, n) for layer, names in P.CAUSES.items() for c, n in names.items()],
)
COUNTS_CTE = f"""{CLASSED_CTE}, cc AS (
 SELECT procedure, {{by}} CASE WHEN outcome = 'timeout' THEN 'timeout' WHEN outcome = 'failure' THEN coalesce(cause, 'unknown') END AS cause,
  sum((class = 'open')::INT) AS att, sum((outcome = 'success')::INT) AS ok, sum((outcome IN ('failure', 'timeout'))::INT) AS bad
 FROM outcomes WHERE outcome <> 'orphan' GROUP BY ALL), pc AS (
 SELECT procedure, {{by}} sum(att) AS attempts, sum(ok) AS success, sum(bad) AS failure,
  count(cause) AS n_causes, coalesce(max(CASE WHEN cause IS NOT NULL THEN bad END), 0) AS top_n,
  coalesce(max(CASE WHEN cause = 'timeout' THEN bad END), 0) AS timeouts,
  arg_min(cause, (-bad, cause)) FILTER (WHERE cause IS NOT NULL) AS top_cause,
  coalesce(string_agg(cause || '=' || CAST(bad AS BIGINT), ';' ORDER BY cause), '') AS causes,
  split_part(procedure, '_', 1) AS layer,
  CASE WHEN sum(att) = 0 THEN 0.0 ELSE round_even(sum(ok) / sum(att) * 100 * 100.0, 0) / 100.0 END AS success_rate
 FROM cc GROUP BY ALL)"""


def counts_cte(by: str = "") -> str:
    return COUNTS_CTE.replace("{by}", f"{by}," if by else "")
