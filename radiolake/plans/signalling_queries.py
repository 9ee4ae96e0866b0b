"""Signalling and procedure-detector queries on bindings C, C2 and G."""

from __future__ import annotations

from pyspark.sql import functions as F

from radiolake.catalogue import protocol as P
from radiolake.functions.columns import rnd
from radiolake.operators import procedure_detectors as D
from radiolake.operators import signalling as S
from radiolake.plans.bindings import CAUSE_CTE, CLASSED_CTE, MESSAGES_CTE, PAYLOAD_CTE, SEV, Tables, counts_cte, values_cte
from radiolake.plans.registry import query, r


def causes_text(col="failure_causes"):
    entries = F.array_sort(F.map_entries(col))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";")


@query("src5", f"WITH {PAYLOAD_CTE} SELECT layer, count(*) AS n FROM payloads GROUP BY layer")
def src5(t: Tables):
    from radiolake.sources.readers import payload_rows

    return S.decode(payload_rows(t.payloads)).groupBy("layer").agg(F.count(F.lit(1)).alias("n"))


@query("msg1", f"""WITH {PAYLOAD_CTE} SELECT seq, layer, CASE WHEN layer <> 'NAS' THEN kind END AS category, CAST(user_id AS VARCHAR) AS ue_id, cause_code FROM payloads""")
def msg1(t: Tables):
    return S.decode(t.payloads).select("seq", "layer", "category", "ue_id", "cause_code")


@query("msg2", f"""WITH {PAYLOAD_CTE}, {CAUSE_CTE} SELECT seq, p.layer, procedure, CASE WHEN kind <> 2 THEN NULL
 WHEN p.cause_code IS NULL OR (p.cause_code = 0 AND p.layer <> 'NAS') THEN 'unknown' ELSE coalesce(cause_name, 'unknown-0x' || lpad(lower(hex(p.cause_code)), 2, '0')) END AS cause
 FROM payloads p LEFT JOIN cause_dim c ON c.layer = p.layer AND c.cause_code = p.cause_code""")
def msg2(t: Tables):
    return S.name_codes(S.decode(t.payloads)).select("seq", "layer", "procedure", "cause")


@query("msg3", f"WITH {CLASSED_CTE} SELECT class, count(*) AS n FROM classed GROUP BY class")
def msg3(t: Tables):
    return t.messages.groupBy(S.role_class(F.col("role")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("msg4", f"WITH {CLASSED_CTE} SELECT seq, tx_key, outcome, CASE WHEN outcome IN ('success', 'failure') THEN prev_ts END AS open_ts FROM outcomes")
def msg4(t: Tables):
    return S.pair(t.messages).select("seq", "tx_key", "outcome", "open_ts")


LOG_CTE = f"""{CLASSED_CTE}, log AS (SELECT seq, ts, ts AS seen_ts, layer, procedure, 'request' AS role, ue_id, cell_id, CAST(NULL AS VARCHAR) AS cause FROM outcomes WHERE class = 'open'
 UNION ALL SELECT seq, prev_ts, ts, layer, procedure, CASE outcome WHEN 'success' THEN 'response' ELSE 'failure' END, ue_id, cell_id,
  CASE WHEN outcome = 'failure' THEN coalesce(cause, 'unknown') END FROM outcomes WHERE outcome IN ('success', 'failure')
 UNION ALL SELECT seq, ts, ts, layer, procedure, 'timeout', ue_id, cell_id, 'timeout' FROM outcomes WHERE outcome = 'timeout')"""


@query("msg5", f"WITH {LOG_CTE} SELECT seq, ts, layer, procedure, role, cause FROM log")
def msg5(t: Tables):
    return S.message_log(S.pair(t.messages)).select("seq", "ts", "layer", "procedure", "role", "cause")


IE_ROWS = [
    (f"{p}_{role}", name, presence)
    for p in ("NAS_Registration", "RRC_Setup", "F1AP_UEContextSetup")
    for role in ("request", "accept")
    for name, presence in (("k", "Mandatory"), ("ngKSI", "Mandatory"), ("Cause", "Optional"))
]


@query("msg6", f"""WITH {MESSAGES_CTE}, {values_cte('ie', ['message_type', 'name', 'presence'], IE_ROWS)}, x AS (SELECT message_type, count(*) AS e FROM ie GROUP BY ALL)
 SELECT seq, CAST(coalesce(e, 0) AS BIGINT) AS expected_ie_count, CASE WHEN seq % 2 = 0 THEN 1 ELSE 2 END AS observed_ie_count,
 CASE WHEN e IS NULL THEN '' WHEN seq % 2 = 0 THEN 'ngKSI' ELSE '' END AS mandatory_missing FROM messages m LEFT JOIN x ON x.message_type = procedure || '_' || role""")
def msg6(t: Tables):
    dim = t.spark.createDataFrame(IE_ROWS, "message_type string, name string, presence string")
    ies = F.when(F.col("seq") % 2 == 0, F.create_map(F.lit("k"), F.col("ue_id"))).otherwise(
        F.create_map(F.lit("k"), F.col("ue_id"), F.lit("ngKSI"), F.lit("1")))
    out = S.ie_conformance(t.messages.withColumn("ies", ies), dim)
    return out.select("seq", F.col("expected_ie_count").cast("bigint").alias("expected_ie_count"), "observed_ie_count",
                      F.array_join("mandatory_missing", ";").alias("mandatory_missing"))


@query("msg7", f"WITH {counts_cte()} SELECT procedure, CAST(attempts AS BIGINT) AS attempts, CAST(success AS BIGINT) AS success, CAST(failure AS BIGINT) AS failure, success_rate, causes, layer FROM pc")
def msg7(t: Tables):
    c = S.procedure_counters(S.pair(t.messages))
    return c.select("procedure", "attempts", "success", "failure", "success_rate", causes_text().alias("causes"), "layer")


@query("msg8", f"WITH {LOG_CTE} SELECT layer, count(*) AS events FROM log GROUP BY layer")
def msg8(t: Tables):
    return S.layer_counts(S.message_log(S.pair(t.messages)))


@query("msg9", f"WITH {counts_cte()} SELECT procedure, CAST(attempts AS BIGINT) AS attempts, CAST(success AS BIGINT) AS success, CAST(failure AS BIGINT) AS failure, coalesce(top_cause, '—') AS top_failure_cause FROM pc")
def msg9(t: Tables):
    return S.procedure_table(S.procedure_counters(S.pair(t.messages))).drop("success_rate_pct")


@query("msg9_causes", f"WITH {counts_cte()} SELECT procedure, cause, CAST(bad AS BIGINT) AS n FROM cc WHERE cause IS NOT NULL")
def msg9_causes(t: Tables):
    return S.cause_breakdown(S.procedure_counters(S.pair(t.messages)))


@query("msg10", f"WITH {LOG_CTE} SELECT seq, role, procedure FROM log WHERE layer IN ('NAS', 'RRC') ORDER BY seen_ts, seq, role LIMIT 200")
def msg10(t: Tables):
    return S.log_head(S.message_log(S.pair(t.messages)), ["NAS", "RRC"]).select("seq", "role", "procedure")


# ------------------------------------------------------------ procedure detectors, per cell

def _counters(t: Tables):
    return S.procedure_counters(S.pair(t.messages), by=("procedure", "cell_id"))


def _features(t: Tables):
    return D.features(_counters(t), scope=["cell_id"])


PC = counts_cte("cell_id")
FEAT_CTE = f"""{PC}, feat AS (SELECT procedure, cell_id, attempts, failure, success_rate, 100.0 - success_rate AS failure_rate,
 attempts / greatest(sum(attempts) OVER (PARTITION BY cell_id), 1) AS attempt_share, failure::DOUBLE AS failure_count, n_causes / greatest(failure, 1) AS cause_diversity,
 top_n / greatest(failure, 1) AS top_cause_concentration, timeouts / greatest(failure, 1) AS timeout_ratio, (failure > 0)::INT::DOUBLE AS has_any_failure FROM pc)"""


@query("prf1", f"WITH {FEAT_CTE} SELECT procedure, cell_id, {', '.join(f'{r(c, 4)} AS {c}' for c in D.FEATURES)} FROM feat")
def prf1(t: Tables):
    return _features(t).select("procedure", "cell_id", *[rnd(c, 4).alias(c) for c in D.FEATURES])


RULES_SQL = f"""b AS (SELECT *, CASE WHEN success_rate < 85 THEN 'High' WHEN success_rate < 95 THEN 'Medium' WHEN success_rate < 98 AND failure > 0 THEN 'Low' END AS band FROM pc),
 rules AS (SELECT procedure, cell_id, band AS severity, {r('1.0 - success_rate / 100.0', 3)} AS score, 'Statistical (threshold)' AS detector FROM b WHERE band IS NOT NULL
 UNION ALL SELECT procedure, cell_id, 'Low', {r('timeouts / greatest(failure, 1) * 0.5', 3)}, 'Statistical (timeout rule)' FROM b WHERE band IS NULL AND timeouts > 0
 UNION ALL SELECT procedure, cell_id, 'Low', {r('top_n / failure', 3)}, 'Statistical (cause concentration)' FROM b WHERE band IS NULL AND failure >= 2 AND top_n / failure >= 0.8)"""


@query("pst1", f"WITH {PC}, {RULES_SQL} SELECT * FROM rules")
def pst1(t: Tables):
    return D.detect_rules(_counters(t)).select("procedure", "cell_id", "severity", "score", "detector")


CASCADE_SQL = f"""cas AS (SELECT u.procedure, u.cell_id, 'Cascading failure: ' || u.procedure || ' → ' || d.procedure AS type, {r('u.failure / greatest(u.attempts, 1)', 3)} AS score
 FROM pc u JOIN chain c ON c.up = u.procedure JOIN pc d ON d.procedure = c.down {{same}} WHERE u.failure / greatest(u.attempts, 1) > 0.2 AND d.attempts > 0)"""


@query("pst2", f"WITH {counts_cte()}, {values_cte('chain', ['up', 'down'], P.CASCADES)}, {CASCADE_SQL.replace('{same}', '').replace('u.cell_id, ', '')} SELECT procedure, type, score FROM cas")
def pst2(t: Tables):
    return D.detect_cascades(S.procedure_counters(S.pair(t.messages))).select("procedure", "type", "score")


def _z(scope: str) -> str:
    p = f"(PARTITION BY {scope})" if scope else "()"
    return "z AS (SELECT *, count(*) OVER {p} AS sn, [{x}] AS x FROM feat)".format(
        p=p,
        x=", ".join(
            f"CASE WHEN stddev_pop({c}) OVER {p} > 1e-12 THEN ({c} - avg({c}) OVER {p}) / nullif(stddev_pop({c}) OVER {p}, 0) ELSE 0.0 END"
            for c in D.FEATURES
        ),
    )


HOURLY_FEAT = f"""{counts_cte('slot')}, feat AS (SELECT procedure, slot, attempts, failure, success_rate, 100.0 - success_rate AS failure_rate,
 attempts / greatest(sum(attempts) OVER (PARTITION BY slot), 1) AS attempt_share, failure::DOUBLE AS failure_count, n_causes / greatest(failure, 1) AS cause_diversity,
 top_n / greatest(failure, 1) AS top_cause_concentration, timeouts / greatest(failure, 1) AS timeout_ratio, (failure > 0)::INT::DOUBLE AS has_any_failure FROM pc)""".replace(
    "SELECT ts, seq, layer, procedure, ue_id, cell_id, cause, tx_key,", "SELECT CAST(hour(ts) AS INTEGER) AS slot, ts, seq, layer, procedure, ue_id, cell_id, cause, tx_key,")


def _slot_features(t: Tables):
    paired = S.pair(t.messages).withColumn("slot", F.hour("ts"))
    return D.features(S.procedure_counters(paired, by=("procedure", "slot")), scope=["slot"])


DIST = "sqrt(list_sum(list_transform(list_zip(a.x, b.x), lambda e: (e[1] - e[2]) * (e[1] - e[2]))))"
LOF_SQL = f"""WITH {HOURLY_FEAT}, {_z('slot')}, d AS (SELECT a.slot, a.procedure AS p, b.procedure AS q, {r(DIST, 9)} AS d FROM z a JOIN z b ON a.slot = b.slot AND a.procedure <> b.procedure WHERE a.sn >= 4),
 nn AS (SELECT *, row_number() OVER (PARTITION BY slot, p ORDER BY d, q) AS k FROM d QUALIFY k <= 5), kd AS (SELECT slot, p, max(d) AS kd FROM nn GROUP BY ALL),
 lrd AS (SELECT n.slot, n.p, 1.0 / (avg(greatest(n.d, kd.kd)) + 1e-10) AS lrd FROM nn n JOIN kd ON kd.slot = n.slot AND kd.p = n.q GROUP BY ALL),
 lof AS (SELECT n.slot, n.p AS procedure, avg(o.lrd) / max(l.lrd) AS lof FROM nn n JOIN lrd o ON o.slot = n.slot AND o.p = n.q JOIN lrd l ON l.slot = n.slot AND l.p = n.p GROUP BY ALL)"""


@query("plo1", f"{LOF_SQL} SELECT slot, procedure, {r('lof', 4)} AS lof FROM lof")
def plo1(t: Tables):
    return D.local_outlier_factor(_slot_features(t), ["slot"]).select("slot", "procedure", rnd("lof", 4).alias("lof"))


@query("plo1_flags", f"""{LOF_SQL}, c AS (SELECT slot, quantile_cont(lof, 0.85) AS cut, min(lof) AS lo, max(lof) AS hi FROM lof GROUP BY slot)
 SELECT slot, procedure, CASE WHEN (lof - lo) / (hi - lo + 1e-10) > 0.75 THEN 'High' WHEN (lof - lo) / (hi - lo + 1e-10) > 0.5 THEN 'Medium' ELSE 'Low' END AS severity FROM lof JOIN c USING (slot) WHERE lof > cut""")
def plo1_flags(t: Tables):
    return D.detect_lof(_slot_features(t), ["slot"]).select("slot", "procedure", "severity")


KDE_SQL = f"""WITH {HOURLY_FEAT}, {_z('slot')}, k AS (SELECT a.slot, a.procedure, 1.0 - sum(exp(-0.125 * pow({DIST}, 2))) / max(a.sn) AS isolation FROM z a JOIN z b USING (slot) WHERE a.sn >= 3 GROUP BY a.slot, a.procedure)"""


@query("poc1", f"{KDE_SQL} SELECT slot, procedure, {r('isolation', 4)} AS isolation FROM k")
def poc1(t: Tables):
    return D.kernel_isolation(_slot_features(t), ["slot"]).select("slot", "procedure", rnd("isolation", 4).alias("isolation"))


@query("poc1_flags", f"{KDE_SQL}, c AS (SELECT slot, quantile_cont(isolation, 0.85) AS cut FROM k GROUP BY slot) SELECT slot, procedure FROM k JOIN c USING (slot) WHERE isolation > cut")
def poc1_flags(t: Tables):
    return D.detect_kernel(_slot_features(t), ["slot"]).select("slot", "procedure")


@query("pif1")
def pif1(t: Tables):
    return D.detect_forest(_slot_features(t), key=("procedure", "slot")).select("procedure", "severity", "score", "detector")


@query("pee1")
def pee1(t: Tables):
    return D.detect_envelope(_slot_features(t)).select("procedure", "severity", "score", "detector")


@query("pmg1", f"""WITH {PC}, {RULES_SQL}, {values_cte('chain', ['up', 'down'], P.CASCADES)}, {CASCADE_SQL.replace('{same}', 'AND d.cell_id = u.cell_id')},
 u AS (SELECT procedure, procedure || ' anomaly' AS type, severity, score, detector, 2 AS place FROM rules UNION ALL SELECT procedure, type, 'Medium', score, 'Statistical (cascade rule)', 5 FROM cas),
 m AS (SELECT procedure, type, max({SEV}) AS rk, count(DISTINCT detector) AS confirmed_by FROM u GROUP BY ALL)
 SELECT procedure, type, CASE rk WHEN 3 THEN 'High' WHEN 2 THEN 'Medium' ELSE 'Low' END AS severity, confirmed_by FROM m""")
def pmg1(t: Tables):
    c = _counters(t)
    out = D.merge(D.detect_rules(c).unionByName(D.detect_cascades(c, scope=["cell_id"])))
    return out.select("procedure", "type", "severity", F.col("confirmed_by").cast("bigint").alias("confirmed_by"))


@query("prec", f"""WITH {counts_cte()}, {values_cte('ca', ['cause', 'txt'], P.CAUSE_ADVICE.items())}, {values_cte('la', ['layer', 'txt'], P.LAYER_ADVICE.items())}
 SELECT procedure, coalesce(ca.txt, la.txt, '{P.PROC_DEFAULT_ADVICE}') AS recommendation FROM pc LEFT JOIN ca ON ca.cause = top_cause LEFT JOIN la ON la.layer = pc.layer""")
def prec(t: Tables):
    c = S.procedure_counters(S.pair(t.messages))
    return c.select("procedure", D.recommendation(S.top_cause(F.col("failure_causes")), F.col("layer")).alias("recommendation"))


@query("psq1", f"""WITH {MESSAGES_CTE}, v AS (SELECT procedure, row_number() OVER (ORDER BY min((ts, seq)), procedure) - 1 AS pid, count(*) OVER () AS np FROM messages GROUP BY procedure),
 e AS (SELECT seq, {r("CASE m.layer WHEN 'NAS' THEN 0 WHEN 'NGAP' THEN 1 WHEN 'RRC' THEN 2 WHEN 'F1AP' THEN 3 WHEN 'E1AP' THEN 4 ELSE 5 END / 5.0", 4)} AS f_layer, {r('pid / np', 4)} AS f_proc,
 {r("CASE role WHEN 'request' THEN 0 WHEN 'reject' THEN 2 ELSE 1 END / 3.0", 4)} AS f_role,
 {r("least((epoch_us(ts) - epoch_us(coalesce(lag(ts) OVER (PARTITION BY cell_id ORDER BY ts, seq), ts))) / 1e6, 60.0) / 60.0", 4)} AS f_dt FROM messages m JOIN v USING (procedure)) SELECT * FROM e""")
def psq1(t: Tables):
    out = D.encode_sequence(t.messages, ["cell_id"])
    return out.select("seq", *[rnd(c, 4).alias(c) for c in ("f_layer", "f_proc", "f_role", "f_dt")])


@query("psq1_windows", f"""WITH {MESSAGES_CTE}, w AS (SELECT seq, row_number() OVER (PARTITION BY cell_id ORDER BY ts, seq) AS rn FROM messages) SELECT seq, rn - 10 AS start_idx, rn AS end_idx, 10 AS size FROM w WHERE rn >= 10""")
def psq1_windows(t: Tables):
    out = D.sequence_windows(t.messages, ["cell_id"])
    return out.select("seq", "start_idx", "end_idx", F.size("window").alias("size"))


SURPRISE = """st AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations), kn AS (SELECT * FROM st WHERE prev IS NOT NULL),
 pr AS (SELECT prev, role, count(*) AS c FROM kn GROUP BY ALL), tb AS (SELECT prev, role, -ln(c / sum(c) OVER (PARTITION BY prev)) AS s FROM pr),
 er AS (SELECT conv_id, turn, avg(s) OVER w AS error, count(*) OVER w AS k FROM kn JOIN tb USING (prev, role) WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
 sc AS (SELECT * FROM er WHERE k = 3)"""


def _surprise(t: Tables):
    conv = t.table("conversations").withColumns({"ts": F.timestamp_seconds("turn"), "seq": F.col("turn")})
    return D.transition_surprise(conv, ["conv_id"], F.col("role"), ["turn"], window=3)


@query("psq2", f"WITH {SURPRISE} SELECT conv_id, turn, {r('error', 4)} AS error FROM sc")
def psq2(t: Tables):
    return _surprise(t).select("conv_id", "turn", rnd("error", 4).alias("error"))


MSG_SURPRISE = f"""{MESSAGES_CTE}, st AS (SELECT *, procedure || ' ' || role AS tok, lag(procedure || ' ' || role) OVER (PARTITION BY cell_id ORDER BY ts, seq) AS prev FROM messages), kn AS (SELECT * FROM st WHERE prev IS NOT NULL),
 pr AS (SELECT prev, tok, count(*) AS c FROM kn GROUP BY ALL), tb AS (SELECT prev, tok, -ln(c / sum(c) OVER (PARTITION BY prev)) AS s FROM pr),
 er AS (SELECT seq, procedure, avg(s) OVER w AS error, count(*) OVER w AS k FROM kn JOIN tb USING (prev, tok) WINDOW w AS (PARTITION BY cell_id ORDER BY ts, seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
 sc AS (SELECT * FROM er WHERE k = 10)"""


@query("psq2_flags", f"""WITH {MSG_SURPRISE}, c AS (SELECT avg(error) + 2.0 * stddev_pop(error) AS cut FROM sc) SELECT seq, procedure,
 CASE WHEN {r('error / (cut + 1e-10)', 3)} > 2 THEN 'High' WHEN {r('error / (cut + 1e-10)', 3)} > 1.5 THEN 'Medium' ELSE 'Low' END AS severity FROM sc, c WHERE error > cut""")
def psq2_flags(t: Tables):
    token = F.concat_ws(" ", "procedure", "role")
    scored = D.transition_surprise(t.messages, ["cell_id"], token, ["ts", "seq"])
    return D.detect_sequences(scored).select("seq", "procedure", "severity")
