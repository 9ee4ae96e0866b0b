"""Root cause of correlated groups by stack order and causal rules; explanations and citations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from radiolake.catalogue import causal as R
from radiolake.functions import ordered as O
from radiolake.functions.columns import contains_any, severity_rank
from radiolake.operators.events import NO_CELL, correlation_key
from radiolake.operators.retrieval import bm25_topk
from radiolake.operators.signalling import top_cause
from radiolake.session import cut_lineage

QUOTE_CHARS, MAX_CITATIONS, CHUNKS_PER_HOP = 150, 5, 2


def _layer() -> Column:
    return F.upper(F.when(F.coalesce("layer", F.lit("")) != "", F.col("layer")).otherwise(F.coalesce("source", F.lit("?"))))


def layer_rank() -> Column:
    """Depth in the protocol stack; counters and KPIs are placed by the words they carry."""
    layer = _layer()
    text = F.lower(F.concat_ws(" ", F.coalesce("category", F.lit("")), F.coalesce("metric", F.lit(""))))
    by_word = (
        F.when(contains_any(text, R.PHY_WORDS), R.LAYER_RANK["PHY"])
        .when((layer == "KPI") & ~contains_any(text, R.MAC_WORDS), R.LAYER_RANK["KPI"])
        .otherwise(R.LAYER_RANK["MAC"])
    )
    out = F.when(layer.isin("STATS", "KPI"), by_word)
    for name, rank in R.LAYER_RANK.items():
        if name not in ("STATS", "KPI"):
            out = out.when(layer == name, rank)
    return out.otherwise(R.LAYER_RANK["?"])


def layer_label() -> Column:
    layer = _layer()
    out = F
    for name, label in R.LAYER_LABEL.items():
        out = out.when(layer == name, label)
    return out.otherwise(layer)


def rule_text(events: DataFrame) -> Column:
    """All words a rule may match, including every failure cause of the underlying anomaly."""
    parts = [F.coalesce(c, F.lit("")) for c in ("category", "evidence", "metric", "layer", "source")]
    if "raw" in events.columns:
        causes = F.json_object_keys(F.get_json_object("raw", "$.failure_causes"))
        parts.append(F.coalesce(F.array_join(causes, " "), F.lit("")))
    return F.lower(F.concat_ws(" ", *parts))


def matched_rules(events: DataFrame) -> DataFrame:
    """Add ``rules``, the matching rule names by falling confidence, and ``rule``, the best one.

    Eight fixed rules are column expressions, so no row is multiplied.
    """
    by_confidence = sorted(R.RULES, key=lambda r: -r[3])
    rank, layer, text = F.col("_rank"), F.col("_layer"), F.col("_text")
    hits = []
    for name, root_layer, keywords, *_ in by_confidence:
        match = (layer == root_layer) | (rank == R.LAYER_RANK[root_layer]) | contains_any(text, keywords)
        hits.append(F.when(match, F.lit(name)))
    out = events.withColumns({"_rank": layer_rank(), "_layer": _layer(), "_text": rule_text(events)})
    out = out.withColumn("rules", F.array_compact(F.array(*hits))).drop("_layer", "_text")
    return out.withColumns({"layer_rank": F.col("_rank"), "rule": F.get("rules", F.lit(0))}).drop("_rank")


def _rule_value(position: int, default) -> Column:
    out = F
    for r in R.RULES:
        out = out.when(F.col("rule") == r[0], r[position])
    return out.otherwise(default)


def _stamped(events: DataFrame) -> DataFrame:
    ev = events if "corr_key" in events.columns else events.withColumn("corr_key", correlation_key())
    return ev.withColumn("layer_rank", layer_rank())


def _order(*lead: str) -> Column:
    """Nulls sort first inside a struct, as events without a time come first."""
    return F.struct(*lead, "ts", "layer_rank", "seq")


def group_roots(events: DataFrame) -> DataFrame:
    """One row per correlated group: its root event, its first and last event, its size."""
    keep = F.struct("event_id", "seq", "category", "cell_id", "layer", "source", "metric", "evidence", "raw", "layer_rank")
    return _stamped(events).groupBy("corr_key").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.min_by(keep, F.struct("layer_rank", "ts", "seq")).alias("root"),
        F.min(_order()).alias("first"),
        F.max(_order()).alias("last"),
    )


def root_causes(events: DataFrame, predictions: DataFrame | None = None) -> DataFrame:
    """Root cause, confidence and recommended action of every correlated group in one job."""
    g = group_roots(events).select("corr_key", "n_events", F.col("root.event_id").alias("root_event_id"), F.col("root.seq").alias("root_seq"),
                                   "root.category", "root.cell_id", "root.layer", "root.source", "root.metric", "root.evidence", "root.raw")
    g = matched_rules(g)
    text = F.concat(
        F.lit("Root cause: "), F.coalesce("category", F.lit("anomaly")), F.lit(" at "), layer_label(), F.lit(" on cell "), "cell_id", F.lit(". "),
        F.coalesce(F.concat(_rule_value(4, None), F.lit(" ")), F.lit("")),
        F.lit("This appears to have propagated to "), (F.col("n_events") - 1).cast("string"), F.lit(" downstream anomaly(ies)."),
    )
    advice = _rule_value(5, R.NO_RULE_ADVICE)
    if predictions is not None:
        cells = predictions.where(F.col("cell_id") != NO_CELL).select("cell_id").distinct().withColumn("_p", F.lit(True))
        g = g.join(cells, "cell_id", "left")
        advice = F.concat(advice, F.when(F.col("_p"), R.FORECAST_NOTE).otherwise(""))
    return g.select(
        "corr_key", "cell_id", "n_events", "root_event_id", "root_seq", "layer_rank", "rule", text.alias("root_cause"),
        _rule_value(3, R.NO_RULE_CONFIDENCE).alias("confidence"), advice.alias("recommended_action"),
        F.lit("rule-based").alias("source"),
    )


def causal_chain(events: DataFrame) -> DataFrame:
    """One row per event of a group with its position and role.

    The root triggers; everything strictly between the first and the last event
    contributes; the rest are symptoms.  Rows, not arrays: a group may be huge.
    """
    ev = _stamped(events)
    g = group_roots(ev).select("corr_key", "n_events", F.col("root.event_id").alias("_root"), "first", "last")
    chain = O.numbered(ev, ["corr_key"], ["ts", "layer_rank", "seq"], rn="position", total="_n").drop(O.SLICE, "_n")
    j = chain.join(g, "corr_key")
    inner = (F.col("n_events") > 2) & (_order() != F.col("first")) & (_order() != F.col("last"))
    role = F.when(inner, "contributing_factor").when(F.col("event_id") == F.col("_root"), "trigger").otherwise("symptom")
    text = F.concat(
        "category", F.lit(" on cell "), "cell_id", F.lit(" ("), layer_label(), F.lit(", severity="), "severity", F.lit("): "), "evidence"
    )
    return j.select("corr_key", "position", "event_id", "seq", role.alias("role"), text.alias("explanation"),
                    F.concat_ws(" ", "category", "evidence", "layer").alias("query"))


def citations(chain: DataFrame, chunks: DataFrame, per_hop: int = CHUNKS_PER_HOP, limit: int = MAX_CITATIONS) -> DataFrame:
    """Best text chunks per hop, distinct by (spec, section), the first five of a group.

    ``chunks``: doc_id, spec, section, text.  Hops asking the same thing are
    searched once.
    """
    chain = cut_lineage(chain.select("corr_key", "query", "position", "seq"), "citation-hops")
    asked = chain.groupBy("query").agg(F.min("seq").alias("query_id"))
    top = bm25_topk(asked.select("query_id", F.col("query").alias("text")), chunks.select("doc_id", "text"), per_hop)
    found = top.join(asked, "query_id").join(chunks, "doc_id").select("query", "rank", "spec", "section", "text")
    hops = chain.groupBy("corr_key", "query").agg(F.min("position").alias("position"))
    cited = hops.join(found, "query").where(F.coalesce("spec", F.lit("")) != "").groupBy("corr_key", "spec", "section").agg(
        F.min_by("text", F.struct("position", "rank")).alias("text"), F.min(F.struct("position", "rank")).alias("at")
    )
    w = Window.partitionBy("corr_key").orderBy("at", "spec", "section")
    return cited.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit).select(
        "corr_key", "n", "spec", "section", quote(F.col("text")).alias("quote")
    )


def quote(text: Column) -> Column:
    return F.concat(F.rtrim(F.substring(text, 1, QUOTE_CHARS), F.lit(".")), F.lit("."))


# ---------------------------------------------------------------- explanations

def query_text(anomalies: DataFrame) -> Column:
    """Words describing an anomaly, ending with its dominant cause."""
    have = set(anomalies.columns)
    parts = [F.when(F.col(c) != "", F.col(c)) for c in ("type", "procedure", "layer", "evidence") if c in have]
    if "failure_causes" in have:
        parts.append(F.concat(F.lit("cause: "), top_cause(F.col("failure_causes"))))
    return F.concat_ws(" ", *parts)


def _lookup(col: Column, table: dict, default: Column) -> Column:
    out = F
    for k, v in table.items():
        out = out.when(col == k, F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else v)
    return out.otherwise(default)


def explain(anomalies: DataFrame, hits: DataFrame, key: str = "anomaly_id") -> DataFrame:
    """Hypothesis, up to three citations and four hints per anomaly.

    ``hits``: the retrieved chunks (key, rank, spec, section, text).
    """
    per = hits.where(F.col("rank") <= 3).groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("rank", "spec", "section", "text"))).alias("_h")
    )
    j = anomalies.join(per, key, "left")
    h = F.coalesce("_h", F.array().cast("array<struct<rank:int,spec:string,section:string,text:string>>"))
    first = F.get(h, F.lit(0))
    cause = top_cause(F.col("failure_causes")) if "failure_causes" in anomalies.columns else F.lit(None).cast("string")
    meaning = _lookup(cause, R.CAUSE_MEANING, F.concat(
        F.lit("Investigate the "), F.coalesce(cause, F.lit("reported")), F.lit(" failure cause at the "), F.coalesce("layer", F.lit("")), F.lit(" layer.")))
    urgent = F.when(F.col("severity").isin("High", "Critical"), "immediate").otherwise("scheduled")
    hypothesis = F.concat(
        F.lit("The "), F.coalesce("procedure", F.lit("this procedure")), F.lit(" anomaly (severity="), "severity", F.lit(") shows "), "evidence",
        F.lit(". The dominant failure pattern is: "), meaning, F.lit(" Based on "), F.coalesce(first["spec"], F.lit("the 3GPP spec")), F.lit(", "),
        F.rtrim(F.substring(F.coalesce(first["text"], F.lit("")), 1, 200), F.lit(".")), F.lit(". This warrants "), urgent, F.lit(" investigation."),
    )
    hints = F.concat(
        _lookup(F.col("layer"), R.LAYER_HINTS, F.array(*[F.lit(x) for x in R.DEFAULT_LAYER_HINTS])),
        F.array(_lookup(cause, R.CAUSE_HINTS, F.lit(R.DEFAULT_CAUSE_HINT)), F.lit(R.CLOSING_HINT)),
    )
    cites = F.transform(
        F.filter(h, lambda c: F.coalesce(c["spec"], F.lit("")) != ""),
        lambda c: F.struct(c["spec"].alias("spec"), c["section"].alias("section"), quote(c["text"]).alias("quote")),
    )
    return j.select(key, "severity", hypothesis.alias("hypothesis"), cites.alias("citations"), hints.alias("investigation_hints"),
                    F.lit("rule-based").alias("source"))


def chosen_for_explanation(anomalies: DataFrame, severities: Sequence[str] = ("Critical", "High"), n: int = 4, fallback: int = 2) -> DataFrame:
    """The top ``n`` anomalies of the wanted severities; when there are none, the first ``fallback``."""
    wanted = F.col("severity").isin(list(severities))
    order = [severity_rank().desc(), F.col("score").desc(), F.col("seq")]
    top = anomalies.withColumn("_w", wanted).orderBy(F.col("_w").desc(), *order).limit(n)
    w = Window.orderBy(F.col("_w").desc(), *order)
    ranked = top.withColumns({"_r": F.row_number().over(w), "_any": F.bool_or("_w").over(Window.partitionBy())})
    return ranked.where(F.when(F.col("_any"), F.col("_w")).otherwise(F.col("_r") <= fallback)).drop("_w", "_r", "_any")
