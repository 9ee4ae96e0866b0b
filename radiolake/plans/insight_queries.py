"""Evaluation, feedback, retrieval and root-cause queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from radiolake.catalogue import causal as R
from radiolake.functions.columns import rnd
from radiolake.operators import counter_detectors as CD
from radiolake.operators import evaluate as V
from radiolake.operators import events as E
from radiolake.operators import feedback as B
from radiolake.operators import kpi_detectors as D
from radiolake.operators import procedure_detectors as PD
from radiolake.operators import retrieval as T
from radiolake.operators import rootcause as C
from radiolake.operators import signalling as S
from radiolake.plans.bindings import (
    COUNTERS_LONG_CTE, COUNTER_DIM_CTE, DIM_CTE, EVENTS_CTE, KPI_CTE, SEV, Tables, counts_cte, lit_list, values_cte,
)
from radiolake.plans.counter_queries import CUSUM, STH, TREND, _boll, _iqr, _peer
from radiolake.plans.event_queries import correlated, log
from radiolake.plans.kpi_queries import LIMITS
from radiolake.plans.registry import SQL, query, r
from radiolake.plans.signalling_queries import RULES_SQL
from radiolake.session import cut_lineage

# ------------------------------------------------------------ detection quality

FAULT_CTE = "fault AS (SELECT cell_id FROM kpi_long WHERE kpi = 'Latency_ms' GROUP BY cell_id ORDER BY count(*) DESC, cell_id LIMIT 3)"
CELLS_CTE = "cells AS (SELECT DISTINCT cell_id FROM kpi_long)"
FENCE_CTE = f"""qf AS (SELECT kpi, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM kpi_long GROUP BY kpi),
 iqr AS (SELECT DISTINCT cell_id FROM kpi_long k JOIN qf USING (kpi) JOIN kpi_dim d ON d.kpi = k.kpi WHERE CASE WHEN direction = 'lower_better' THEN value > q3 + 6 * (q3 - q1) ELSE value < q1 - 6 * (q3 - q1) END)"""


def faults(t: Tables):
    """Cells with most error events stand for the faulty ones."""
    n = t.kpi.where("kpi = 'Latency_ms'").groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy(F.col("n").desc(), "cell_id").limit(3).select("cell_id")


OUTCOMES = "o AS (SELECT cell_id, cell_id IN (SELECT cell_id FROM iqr) AS d, cell_id IN (SELECT cell_id FROM fault) AS f FROM cells)"


def far_out(t: Tables):
    """Cells with readings far outside the fence, the faulty cells, and all cells."""
    return V.cells_of(D.detect_iqr(t.kpi, k=6.0)), faults(t), t.kpi.select("cell_id")


@query("evl4", f"""WITH {KPI_CTE}, {DIM_CTE}, {FAULT_CTE}, {CELLS_CTE}, {FENCE_CTE}, {OUTCOMES},
 n AS (SELECT sum((d AND f)::INT)::BIGINT AS tp, sum((d AND NOT f)::INT)::BIGINT AS fp, sum((f AND NOT d)::INT)::BIGINT AS fn, sum((NOT d AND NOT f)::INT)::BIGINT AS tn,
  coalesce(string_agg(CASE WHEN d AND f THEN cell_id END, ',' ORDER BY cell_id), '') AS detected_fault_cells, coalesce(string_agg(CASE WHEN f AND NOT d THEN cell_id END, ',' ORDER BY cell_id), '') AS missed_fault_cells,
  coalesce(string_agg(CASE WHEN d AND NOT f THEN cell_id END, ',' ORDER BY cell_id), '') AS false_positive_cells FROM o),
 pr AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS rc FROM n)
 SELECT tp, fp, fn, tn, {r('p', 4)} AS precision, {r('rc', 4)} AS recall, {r('coalesce(2 * p * rc / nullif(p + rc, 0), 0)', 4)} AS f1, detected_fault_cells, missed_fault_cells, false_positive_cells FROM pr""")
def evl4(t: Tables):
    m = V.scenario_metrics(*far_out(t))
    return m.withColumns({c: F.array_join(c, ",") for c in ("detected_fault_cells", "missed_fault_cells", "false_positive_cells")})


@query("evl4_cells", f"""WITH {KPI_CTE}, {DIM_CTE}, {FAULT_CTE}, {CELLS_CTE}, {FENCE_CTE}, {OUTCOMES}
 SELECT cell_id, CASE WHEN d AND f THEN 'TP' WHEN d THEN 'FP' WHEN f THEN 'FN' ELSE 'TN' END AS outcome FROM o""")
def evl4_cells(t: Tables):
    return V.marked(*far_out(t))


KPI_OPTIONS = {D.PEER: {"z_threshold": 1.5}, D.TREND: {"slope_threshold": 0.0005}, D.THRESHOLD: {"gap_s": 129600.0}}
COUNTER_OPTIONS = {CD.PEER: {"z_threshold": 1.5}, CD.IQR: {"k": 0.3}, CD.TREND: {"slope_threshold": 1e-6}, CD.CUSUM: {"threshold": 1.2}, CD.BOLLINGER: {"lagged": True}}
KPI_ALL = f"ka AS (SELECT * FROM ({SQL['kmg1']}))"
COUNTER_ALL = f"""{STH}, {_peer(1.5)}, {_iqr(0.3)}, {TREND}, {CUSUM}, {_boll('5 PRECEDING AND 1 PRECEDING')}, ca_all AS (SELECT cell_id FROM th WHERE severity IS NOT NULL
 UNION ALL SELECT cell_id FROM pe UNION ALL SELECT cell_id FROM ir UNION ALL SELECT cell_id FROM tf WHERE n >= 8 AND abs(s) >= 1e-6 UNION ALL SELECT cell_id FROM cu UNION ALL SELECT cell_id FROM bo)"""


def kpi_alarms(t: Tables):
    """Alarms of all six KPI detectors."""
    return D.detect_kpi(t.kpi, options=KPI_OPTIONS)


def counter_alarms(t: Tables):
    """Alarms of all six counter detectors."""
    return CD.detect_counters_each(t.counters_long, options=COUNTER_OPTIONS)


@query("evl5", f"""WITH {KPI_ALL}, {COUNTERS_LONG_CTE}, {COUNTER_DIM_CTE}, {COUNTER_ALL} SELECT DISTINCT 'threshold' AS method, cell_id FROM ka WHERE detector = '{D.THRESHOLD}'
 UNION ALL SELECT DISTINCT 'iqr', cell_id FROM ka WHERE detector = '{D.IQR}' UNION ALL SELECT 'any', cell_id FROM (SELECT cell_id FROM ka WHERE cell_id <> 'Fleet-wide' UNION SELECT cell_id FROM ca_all)""")
def evl5(t: Tables):
    """Cells found by one detector, and by any of the twelve."""
    found = cut_lineage(kpi_alarms(t).groupBy("cell_id", "detector").agg(F.count(F.lit(1)).alias("n")), "found-cells")
    tag = lambda df, m: df.select(F.lit(m).alias("method"), "cell_id")
    return tag(V.cells_of(found, D.THRESHOLD), "threshold").union(tag(V.cells_of(found, D.IQR), "iqr")).union(tag(V.any_of(found, counter_alarms(t)), "any"))


@query("evl5_correlated", f"WITH {EVENTS_CTE} SELECT DISTINCT cell_id FROM correlated WHERE n_correlated >= 2 AND cell_id <> '—'")
def evl5_correlated(t: Tables):
    return V.correlated_cells(correlated(t), 3)


@query("evl6", f"""WITH {COUNTERS_LONG_CTE}, {COUNTER_DIM_CTE}, {COUNTER_ALL}, c AS (SELECT cell_id, count(*) AS n FROM ca_all GROUP BY cell_id)
 SELECT cell_id FROM c WHERE n > (SELECT avg(n) + 1.0 * stddev_pop(n) FROM c)""")
def evl6(t: Tables):
    return V.count_outliers(counter_alarms(t), z=1.0)


@query("evl7", f"""WITH {EVENTS_CTE}, a AS (SELECT coalesce(source, 'all') AS source, count(*) AS total, count(*) FILTER (WHERE n_correlated >= 1) AS clustered,
 count(DISTINCT CASE WHEN n_correlated >= 1 THEN cell_id END) AS unique_cells FROM correlated GROUP BY ROLLUP (source))
 SELECT source, total, clustered, total - clustered AS single_source, unique_cells, {r('clustered / total * 100', 2)} AS rate_pct FROM a""")
def evl7(t: Tables):
    return V.assignment_rate(correlated(t))


@query("evl8", f"""WITH {KPI_CTE}, {KPI_ALL}, {FAULT_CTE}, ch AS (SELECT cell_id, min(channel_type) AS channel_type FROM kpi_long GROUP BY cell_id),
 a AS (SELECT detector, substr(kpi, 1, 3) AS kpi_group, channel_type, cell_id IN (SELECT cell_id FROM fault) AS f FROM ka JOIN ch USING (cell_id))
 SELECT detector, kpi_group, channel_type, sum(f::INT)::BIGINT AS tp, sum((NOT f)::INT)::BIGINT AS fp FROM a GROUP BY GROUPING SETS ((detector), (detector, kpi_group), (detector, channel_type), (detector, kpi_group, channel_type))""")
def evl8(t: Tables):
    """True and false alarms of all six KPI detectors; fleet-wide alarms are of no cell and so neither."""
    channel = t.kpi.groupBy("cell_id").agg(F.min("channel_type").alias("channel_type"))
    a = kpi_alarms(t).join(channel, "cell_id").withColumn("kpi_group", F.substring("kpi", 1, 3))
    return V.granular(a, faults(t)).drop("level")


@query("evl12", f"WITH {KPI_CTE}, {FAULT_CTE}, {CELLS_CTE} SELECT 'fault' AS kind, cell_id FROM fault UNION ALL SELECT 'normal', cell_id FROM cells WHERE cell_id NOT IN (SELECT cell_id FROM fault)")
def evl12(t: Tables):
    truth = faults(t)
    return V.fault_cells(truth).select(F.lit("fault").alias("kind"), "cell_id").union(
        V.normal_cells(truth, t.kpi).select(F.lit("normal").alias("kind"), "cell_id"))


@query("evl10", f"""WITH {EVENTS_CTE}, w AS (SELECT DISTINCT cell_id FROM event_log WHERE cell_id <> '—'), own AS (SELECT cell_id AS group_cell, seq, severity FROM event_log WHERE cell_id <> '—'
 QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY {SEV} DESC, seq) <= 5) SELECT group_cell, seq FROM own""")
def evl10(t: Tables):
    ev = log(t)
    return V.evidence_groups(ev, ev.where(F.col("cell_id") != "—").select("cell_id")).select("group_cell", "seq")


# ------------------------------------------------------------ root cause

def _like(expr: str, words) -> str:
    return "(" + " OR ".join(f"contains({expr}, '{w}')" for w in words) + ")"


RANK_SQL = f"""CASE WHEN upper(layer) IN ('STATS', 'KPI') THEN CASE WHEN {_like("lower(category || ' ' || metric)", R.PHY_WORDS)} THEN 0
 WHEN upper(layer) = 'KPI' AND NOT {_like("lower(category || ' ' || metric)", R.MAC_WORDS)} THEN 8 ELSE 1 END
 ELSE CASE upper(layer) {' '.join(f"WHEN '{k}' THEN {v}" for k, v in R.LAYER_RANK.items() if k not in ('STATS', 'KPI'))} ELSE 5 END END"""
TEXT_SQL = "lower(concat_ws(' ', category, evidence, metric, layer, source))"
RULE_SQL = "CASE " + " ".join(
    f"WHEN upper(layer) = '{root}' OR lrank = {R.LAYER_RANK[root]} OR {_like(TEXT_SQL, kws)} THEN '{name}'"
    for name, root, kws, *_ in sorted(R.RULES, key=lambda x: -x[3])
) + " END"
RANKED_CTE = f"{EVENTS_CTE}, lr AS (SELECT *, {RANK_SQL} AS lrank FROM correlated)"
RULES_CTE = values_cte("rule_dim", ["rule", "confidence", "descr", "advice"], [(x[0], x[3], x[4], x[5]) for x in R.RULES])


@query("rca1", f"WITH {RANKED_CTE} SELECT seq, lrank AS layer_rank FROM lr")
def rca1(t: Tables):
    return log(t).select("seq", C.layer_rank().alias("layer_rank"))


@query("rca2", f"WITH {RANKED_CTE} SELECT seq, {RULE_SQL} AS rule FROM lr")
def rca2(t: Tables):
    return C.matched_rules(log(t)).select("seq", "rule")


GROUP_CTE = f"""{RANKED_CTE}, gr AS (SELECT * FROM lr WHERE n_correlated >= 1), gn AS (SELECT corr_key, count(*) AS n_events FROM gr GROUP BY corr_key),
 roots AS (SELECT * FROM gr QUALIFY row_number() OVER (PARTITION BY corr_key ORDER BY lrank, ts NULLS FIRST, seq) = 1)"""


@query("rca3", f"""WITH {GROUP_CTE}, {RULES_CTE}, {values_cte('lab', ['lname', 'label'], R.LAYER_LABEL.items())}, x AS (SELECT roots.*, n_events, {RULE_SQL} AS rule FROM roots JOIN gn USING (corr_key))
 SELECT corr_key, seq AS root_seq, n_events, coalesce(confidence, 0.4) AS confidence FROM (SELECT x.*, d.confidence, d.descr FROM (SELECT * EXCLUDE (confidence) FROM x) x LEFT JOIN rule_dim d USING (rule))""")
def rca3(t: Tables):
    return C.root_causes(E.correlated_only(correlated(t))).select("corr_key", "root_seq", "n_events", "confidence")


@query("rca4", f"""WITH {KPI_CTE}, {GROUP_CTE}, {RULES_CTE}, {values_cte('lab', ['lname', 'label'], R.LAYER_LABEL.items())}, x AS (SELECT * EXCLUDE (confidence), {RULE_SQL} AS rule FROM roots JOIN gn USING (corr_key))
 SELECT corr_key, 'Root cause: ' || category || ' at ' || coalesce(label, upper(layer)) || ' on cell ' || cell_id || '. ' || coalesce(descr || ' ', '') || 'This appears to have propagated to ' || (n_events - 1) || ' downstream anomaly(ies).' AS root_cause,
 coalesce(advice, '{R.NO_RULE_ADVICE}') || CASE WHEN cell_id IN (SELECT cell_id FROM kpi_long) THEN '{R.FORECAST_NOTE}' ELSE '' END AS recommended_action FROM x LEFT JOIN rule_dim USING (rule) LEFT JOIN lab ON lname = upper(layer)""")
def rca4(t: Tables):
    ev = E.correlated_only(correlated(t))
    out = C.root_causes(ev, predictions=t.kpi.select("cell_id"))
    return out.select("corr_key", "root_cause", "recommended_action")


CHAIN_CTE = f"""{GROUP_CTE}, ch AS (SELECT gr.*, n_events, row_number() OVER (PARTITION BY corr_key ORDER BY gr.ts NULLS FIRST, lrank, gr.seq) AS position, r.seq AS root_seq
 FROM gr JOIN gn USING (corr_key) JOIN (SELECT corr_key, seq FROM roots) r USING (corr_key)),
 chain AS (SELECT *, CASE WHEN n_events > 2 AND position > 1 AND position < n_events THEN 'contributing_factor' WHEN seq = root_seq THEN 'trigger' ELSE 'symptom' END AS role FROM ch)"""


@query("rca3_chain", f"WITH {CHAIN_CTE} SELECT corr_key, position, seq, role FROM chain")
def rca3_chain(t: Tables):
    return C.causal_chain(E.correlated_only(correlated(t))).select("corr_key", "position", "seq", "role")


CHUNK_SQL = """chunks AS (SELECT row_number() OVER (ORDER BY layer, category, b) AS doc_id, layer AS spec, category AS section, category || ' ' || layer || ' reading near ' || b AS text
 FROM (SELECT DISTINCT layer, category, CAST(floor(score / 10) * 10 AS INTEGER) AS b FROM event_log))"""


def chunks(t: Tables):
    from pyspark.sql import Window

    b = (F.floor(F.col("score") / 10) * 10).cast("int")
    d = log(t).select("layer", "category", b.alias("b")).distinct()
    return d.select(
        F.row_number().over(Window.orderBy("layer", "category", "b")).cast("bigint").alias("doc_id"), F.col("layer").alias("spec"),
        F.col("category").alias("section"), F.concat_ws(" ", "category", "layer", F.lit("reading near"), F.col("b").cast("string")).alias("text"),
    )


def _bm25(queries: str, docs: str, k: int) -> str:
    words = lambda c: f"regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}]+')"
    return f"""bq AS MATERIALIZED (SELECT DISTINCT query_id, unnest({words('text')}) AS term FROM {queries}), bw AS MATERIALIZED (SELECT doc_id, {words('text')} AS w FROM {docs}),
 bd AS (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM bw), bn AS (SELECT count(*) AS n, avg(len(w)) AS al FROM bw),
 tf AS MATERIALIZED (SELECT doc_id, dl, term, count(*) AS tf FROM bd WHERE term IN (SELECT term FROM bq) GROUP BY ALL), dfq AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
 bs AS (SELECT query_id, doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1.0) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / al))) AS raw FROM bq JOIN tf USING (term) JOIN dfq USING (term), bn GROUP BY ALL),
 bm AS (SELECT query_id, doc_id, {r('raw', 4)} AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {r('raw', 6)} DESC, doc_id) AS INTEGER) AS rank FROM bs QUALIFY rank <= {k})"""


@query("rca5", f"""WITH {CHAIN_CTE}, {CHUNK_SQL}, hop AS (SELECT corr_key, position, seq, concat_ws(' ', category, evidence, layer) AS q FROM chain), qs AS (SELECT q, min(seq) AS query_id FROM hop GROUP BY q),
 qt AS (SELECT query_id, q AS text FROM qs), {_bm25('qt', 'chunks', 2)}, f AS (SELECT q, rank, spec, section, text FROM bm JOIN qs USING (query_id) JOIN chunks USING (doc_id)),
 c AS (SELECT corr_key, spec, section, arg_min(text, (position, rank)) AS text, min((position, rank)) AS pos FROM hop JOIN f USING (q) GROUP BY ALL),
 o AS (SELECT *, CAST(row_number() OVER (PARTITION BY corr_key ORDER BY pos, spec, section) AS INTEGER) AS n FROM c QUALIFY n <= 5) SELECT corr_key, n, spec, section, rtrim(substr(text, 1, 150), '.') || '.' AS quote FROM o""")
def rca5(t: Tables):
    return C.citations(C.causal_chain(E.correlated_only(correlated(t))), chunks(t))


@query("evl9", f"""WITH {GROUP_CTE}, {RULES_CTE}, x AS (SELECT * EXCLUDE (confidence), {RULE_SQL} AS rule FROM roots JOIN gn USING (corr_key)), tx AS (SELECT corr_key AS cell_id, lower(category || ' ' || coalesce(advice, '')) AS t FROM x LEFT JOIN rule_dim USING (rule))
 SELECT cell_id, contains(t, 'prb')::INT + contains(t, 'harq')::INT + contains(t, 'outage')::INT AS n_matched, {r("(contains(t, 'prb')::INT + contains(t, 'harq')::INT + contains(t, 'outage')::INT) / 3.0", 3)} AS hit_rate FROM tx""")
def evl9(t: Tables):
    ev = E.correlated_only(correlated(t))
    roots = C.root_causes(ev)
    cats = C.group_roots(ev).select("corr_key", "root.category")
    adv = roots.join(cats, "corr_key")
    adv = adv.withColumn("text", F.concat_ws(" ", "category", F.when(F.col("rule").isNotNull(), F.col("recommended_action"))))
    want = roots.select(F.col("corr_key").alias("cell_id"), F.array(*[F.lit(x) for x in ("PRB", "HARQ", "outage")]).alias("keywords"))
    hits = V.keyword_hits(adv.select(F.col("corr_key").alias("cell_id"), "text"), want)
    return hits.select("cell_id", F.size("matched").alias("n_matched"), "hit_rate")


# ------------------------------------------------------------ retrieval and explanation

def centroids(t: Tables):
    """Unit mean vector per label, over the whole table."""
    parts = t.table("embeddings").select(F.col("label").cast("bigint").alias("query_id"), F.posexplode("embedding").alias("p", "x"))
    means = parts.groupBy("query_id", "p").agg(F.avg("x").alias("x"))
    vec = means.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("p", "x"))).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, e: s + e["x"] * e["x"]))
    return vec.select("query_id", F.transform("v", lambda e: e["x"] / norm).alias("embedding"))


@query("ret1", f"""WITH e AS (SELECT label::BIGINT AS query_id, generate_subscripts(embedding, 1) AS p, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT query_id, p, avg(x) AS x FROM e GROUP BY ALL),
 q AS (SELECT query_id, list(x ORDER BY p) AS v, sqrt(sum(x * x)) AS norm FROM m GROUP BY query_id), s AS (SELECT query_id, vec_id,
 list_dot_product(list_transform(q.v, lambda x: x / norm), list_transform(c.embedding, lambda x: x::DOUBLE)) AS s FROM q, embeddings c)
 SELECT query_id, vec_id, {r('s', 4)} AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 5""")
def ret1(t: Tables):
    return T.cosine_topk(centroids(t), t.table("embeddings"), 5)


@query("ret1_rows", f"""WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, vec_id,
 list_dot_product(list_transform(q.e, lambda x: x::DOUBLE), list_transform(c.embedding, lambda x: x::DOUBLE)) AS s FROM q, embeddings c)
 SELECT query_id, vec_id, {r('s', 4)} AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 3""")
def ret1_rows(t: Tables):
    e = t.table("embeddings")
    return T.cosine_topk(e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e, 3)


@query("ret2", """SELECT true AS recall_reached, count(DISTINCT label) * 5 AS n, true AS rows_recall_reached,
 count(*) FILTER (WHERE vec_id % 50 = 0) * 5 AS n_rows FROM embeddings""")
def ret2(t: Tables):
    """The index asked for the centroid of every label and for every row whose id is divisible by 50, five answers each: whether it finds 0.9 of the exact ones, and that every query has its rows."""
    e = t.table("embeddings")
    asked = t.table("embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")

    def recall(queries, reached: str, n: str):
        near, exact = T.approx_topk(queries, e, 5), T.cosine_topk(queries, e, 5)
        due = exact.select("query_id", "vec_id", F.lit(1).alias("due"))
        both = near.select("query_id", "vec_id", F.lit(1).alias("hit")).join(due, ["query_id", "vec_id"], "full")
        return both.agg((F.sum(F.col("hit") * F.col("due")) >= 0.9 * F.count("due")).alias(reached), F.count("hit").alias(n))

    labels = recall(cut_lineage(centroids(t), "centroids"), "recall_reached", "n")
    return labels.crossJoin(recall(asked, "rows_recall_reached", "n_rows"))  # one row each


@query("ret3", f"WITH qs AS (SELECT item_id AS query_id, text FROM benchmark), {_bm25('qs', 'documents', 5)} SELECT query_id, doc_id, score, rank FROM bm")
def ret3(t: Tables):
    return T.bm25_topk(t.table("benchmark").select(F.col("item_id").alias("query_id"), "text"), t.table("documents"), 5)


@query("ret3_vectors", r"SELECT doc_id, (regexp_matches(text, '[\p{L}\p{N}]'))::INT::DOUBLE AS length FROM documents")
def ret3_vectors(t: Tables):
    """Every text with a word has a vector of length one."""
    vectors = T.tfidf_vectors(t.table("documents"))
    # entries of the sparse vector only; the dense form has 65 536
    squares = F.aggregate(F.unwrap_udt("vector")["values"], F.lit(0.0), lambda s, x: s + x * x)
    return vectors.select("doc_id", F.round(F.sqrt(squares), 6).alias("length"))


PROC_RULES_SQL = RULES_SQL.replace("cell_id, ", "").replace(", cell_id", "")


def proc_anomalies(t: Tables):
    return PD.detect_rules(S.procedure_counters(S.pair(t.messages))).withColumn("anomaly_id", F.col("procedure"))


@query("exp1", f"WITH {counts_cte()}, {PROC_RULES_SQL} SELECT procedure, procedure || ' anomaly ' || procedure || ' ' || layer || coalesce(' cause: ' || top_cause, '') AS query FROM pc JOIN rules USING (procedure)")
def exp1(t: Tables):
    a = proc_anomalies(t).drop("evidence")
    return a.select("procedure", C.query_text(a).alias("query"))


@query("exp2", f"""WITH {counts_cte()}, {PROC_RULES_SQL}, {values_cte('ch', ['cause', 'hint'], R.CAUSE_HINTS.items())}, {values_cte('lh', ['layer', 'a', 'b'], [(k, *v) for k, v in R.LAYER_HINTS.items()])}
 SELECT procedure AS anomaly_id, concat_ws('|', a, b, coalesce(hint, '{R.DEFAULT_CAUSE_HINT}'), '{R.CLOSING_HINT}') AS hints FROM pc JOIN (SELECT DISTINCT procedure FROM rules) USING (procedure) JOIN lh USING (layer) LEFT JOIN ch ON ch.cause = top_cause""")
def exp2(t: Tables):
    a = proc_anomalies(t).dropDuplicates(["procedure"])
    ids = a.select("anomaly_id", F.xxhash64("anomaly_id").alias("query_id"), C.query_text(a).alias("text"))
    docs = t.table("documents").select("doc_id", F.col("source").alias("spec"), F.col("lang").alias("section"), "text")
    hits = T.bm25_topk(ids.select("query_id", "text"), docs, 5).join(ids.select("query_id", "anomaly_id"), "query_id").join(docs, "doc_id")
    out = C.explain(a, hits.select("anomaly_id", "rank", "spec", "section", "text"))
    return out.select("anomaly_id", F.array_join("investigation_hints", "|").alias("hints"))


@query("exp3", f"WITH {EVENTS_CTE} SELECT seq, severity FROM event_log WHERE severity IN ('Critical', 'High') ORDER BY {SEV} DESC, score DESC, seq LIMIT 4")
def exp3(t: Tables):
    return C.chosen_for_explanation(log(t)).select("seq", "severity")


# ------------------------------------------------------------ feedback

DETECTORS = [d for d, _, _ in B.BASE_PARAMS]
FB_CTE = f"""fb AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'uncertain' WHEN quality = 1 THEN 'correct' ELSE 'false_positive' END AS verdict,
 list_extract([{lit_list(DETECTORS)}], CAST(doc_id % {len(DETECTORS)} AS INTEGER) + 1) AS detector, lang AS source FROM labels JOIN documents USING (doc_id))"""
FB_AGG = f"""count(*) AS total, count(*) FILTER (WHERE verdict = 'correct') AS correct, count(*) FILTER (WHERE verdict = 'false_positive') AS false_positive, count(*) FILTER (WHERE verdict = 'uncertain') AS uncertain,
 {r("count(*) FILTER (WHERE verdict = 'correct') / nullif(count(*) FILTER (WHERE verdict <> 'uncertain'), 0)", 3)} AS precision"""


@query("fbk1", f"""WITH {FB_CTE} SELECT CASE WHEN grouping(detector) = 0 THEN 'detector' WHEN grouping(source) = 0 THEN 'source' ELSE 'all' END AS kind, coalesce(detector, source) AS value, {FB_AGG} FROM fb GROUP BY GROUPING SETS ((), (detector), (source))""")
def fbk1(t: Tables):
    return B.feedback_stats(t.feedback)


@query("fbk2", f"WITH {FB_CTE} SELECT detector, {FB_AGG} FROM fb GROUP BY detector")
def fbk2(t: Tables):
    return B.detector_precision(t.feedback)[0]


@query("fbk2_last", f"WITH {FB_CTE} SELECT doc_id AS feedback_id, verdict FROM fb ORDER BY doc_id DESC LIMIT 50")
def fbk2_last(t: Tables):
    return B.detector_precision(t.feedback)[1].select("feedback_id", "verdict")


FBK3 = f"""WITH {FB_CTE}, {values_cte('pd', ['detector', 'param', 'v'], B.BASE_PARAMS)}, c AS (SELECT detector, count(*) FILTER (WHERE verdict = 'false_positive') AS fp, count(*) FILTER (WHERE verdict <> 'uncertain') AS n FROM fb GROUP BY detector),
 x AS (SELECT pd.*, fp / nullif(n, 0) AS fpr, n, 0.3 * (fp / nullif(n, 0) - 0.1) AS d FROM pd LEFT JOIN c USING (detector)),
 y AS (SELECT *, CASE WHEN coalesce(n, 0) < 2 THEN v ELSE {r("CASE WHEN param IN ('contamination', 'nu') THEN least(greatest(v - d, 0.02), 0.4) WHEN param IN ('sensitivity', 'threshold_multiplier') THEN least(greatest(v + d, 0.5), 2.0) ELSE least(greatest(v + d * v, v * 0.5), v * 2.0) END", 4)} END AS w FROM x)"""


@query("fbk3", f"{FBK3} SELECT detector, param, {r('fpr', 3)} AS fp_rate, v AS before, w AS after, v <> w AS changed FROM y")
def fbk3(t: Tables):
    return B.retrain(t.feedback).drop("status")


@query("fbk4", f"{FBK3} SELECT detector, param, w AS value FROM y")
def fbk4(t: Tables):
    saved = B.save_params(B.retrain(t.feedback), "", dry_run=True)
    return B.current_params(t.spark, saved)


@query("src3", f"WITH {FB_CTE} SELECT CAST(doc_id AS VARCHAR) AS feedback_id, verdict, detector FROM fb")
def src3(t: Tables):
    from radiolake.session import fresh_path
    from radiolake.sources import readers, writers

    path = fresh_path(t.spark, "feedback")
    writers.append_feedback(t.feedback.withColumn("timestamp", F.lit("2024-01-01T00:00:00")), path)
    return readers.read_feedback(t.spark, path).select("feedback_id", "verdict", "detector")
