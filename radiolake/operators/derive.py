"""Derived columns: gap fill, rolling baseline, calendar, capacity share, sampling interval, labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from radiolake.catalogue import counters as C
from radiolake.catalogue import kpi as K
from radiolake.functions import ordered as O
from radiolake.functions.columns import contains_any, rnd, seconds
from radiolake.session import cut_lineage

BASELINE_ROWS, BASELINE_MIN = 60, 5


def forward_fill(
    df: DataFrame, metrics: Sequence[str], keys=("cell_id",), order=("seq",), rows: int = O.BLOCK
) -> DataFrame:
    """Last known value per cell in file order (``seq``); leading gaps stay null."""
    filled = O.running(O.sliced(df, keys, order, rows), keys, order, {f"_f_{m}": ("last", F.col(m)) for m in metrics})
    return filled.select(*[F.col(f"_f_{c}").alias(c) if c in metrics else F.col(c) for c in df.columns])


def rolling_baseline(
    df: DataFrame,
    metrics: Sequence[str] | None = None,
    keys=("cell_id",),
    order=("ts", "seq"),
    block: int = O.BLOCK,
) -> DataFrame:
    """Mean of the last 60 rows (5 known values at least) and the distance to it, rounded to 3 digits."""
    metrics = [m for m in (metrics or C.DELTA_METRICS) if m in df.columns]
    rows, w, own = O.blocked(O.numbered(df, keys, order), keys, before=BASELINE_ROWS - 1, block=block)
    frame = w.rowsBetween(-(BASELINE_ROWS - 1), 0)
    deltas = {}
    for m in metrics:
        base = F.when(F.count(m).over(frame) >= BASELINE_MIN, F.avg(m).over(frame))
        deltas[f"{m}_baseline_delta"] = rnd(F.col(m) - base, 3)
    out = rows.select("*", *[c.alias(n) for n, c in deltas.items()]).where(own)
    out = out.select(*df.columns, *deltas)
    if "dl_prb_util" in metrics:
        out = out.withColumn("prb_baseline_delta", F.col("dl_prb_util_baseline_delta"))
    return out


def congestion_score(df: DataFrame) -> DataFrame:
    """1.0 when load and block errors are high in the same row; unknown inputs count as not high."""
    both = (F.col("dl_prb_util") > 80) & (F.col("dl_bler") > 5)
    return df.withColumn("congestion_score", F.coalesce(both, F.lit(False)).cast("double"))


def calendar(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Hour of day and day of week with Monday as 0."""
    return df.withColumns(
        {"hour_of_day": F.hour(ts).cast("double"), "day_of_week": F.weekday(ts).cast("double")}
    )


def enrich_counters(df: DataFrame, **kw) -> DataFrame:
    """Gap fill, baseline, congestion and calendar columns in one go."""
    metrics = [m for m, *_ in C.COUNTERS if m in df.columns]
    out = rolling_baseline(forward_fill(df, metrics), **kw)
    if {"dl_prb_util", "dl_bler"} <= set(out.columns):
        out = congestion_score(out)
    return calendar(out)


def capacity_map(df: DataFrame) -> DataFrame:
    """Per cell the first recognised channel type and its capacities; cells without one get no row."""
    spark = df.sparkSession
    kind = F.upper(F.trim(F.col("channel_type")))
    known = sorted({c for c, _, _ in K.CAPACITY})
    seen = df.where(kind.isin(known) & (F.trim("cell_id") != "")).groupBy("cell_id", kind.alias("k")).agg(
        F.min("seq").alias("_at")
    )
    first = seen.groupBy("cell_id").agg(F.min_by("k", F.struct("_at", "k")).alias("channel_type"))
    caps = K.capacity_dim(spark).groupBy("channel_type").agg(
        F.max(F.when(F.col("dir") == "dl", F.col("capacity_mbps"))).alias("dl_mbps"),
        F.max(F.when(F.col("dir") == "ul", F.col("capacity_mbps"))).alias("ul_mbps"),
    )
    return first.join(F.broadcast(caps), "channel_type").select("cell_id", "channel_type", "dl_mbps", "ul_mbps")


def throughput_direction(kpi: Column) -> Column:
    by_dir = {d: [k for k, v in K.THROUGHPUT_DIRECTION.items() if v == d] for d in ("dl", "ul")}
    return F.when(kpi.isin(by_dir["dl"]), "dl").when(kpi.isin(by_dir["ul"]), "ul")


def capacity_share(facts: DataFrame, capacities: DataFrame | None = None) -> DataFrame:
    """Add dir, capacity_mbps and normalized_pct; null unless a throughput KPI of a cell with known capacity."""
    caps = capacities if capacities is not None else capacity_map(facts)
    if not caps.isStreaming:  # written, its size is known: broadcast if small, else a join that can split hot cells
        caps = cut_lineage(caps, "capacities")
    joined = facts.join(caps.select("cell_id", "dl_mbps", "ul_mbps"), "cell_id", "left")
    mbps = F.when(F.col("dir") == "dl", F.col("dl_mbps")).when(F.col("dir") == "ul", F.col("ul_mbps"))
    return (
        joined.withColumn("dir", throughput_direction(F.col("kpi")))
        .withColumn("capacity_mbps", F.when(mbps > 0, mbps))
        .withColumn("normalized_pct", rnd(F.col("value") / F.col("capacity_mbps") * 100, 4))
        .drop("dl_mbps", "ul_mbps")
    )


def interval_by_cell(df: DataFrame) -> DataFrame:
    """Median step between consecutive timestamps per cell, in seconds."""
    keys, order = ["cell_id"], ["ts", "seq"]
    rows = O.sliced(df.where(F.col("ts").isNotNull()).select(*keys, *order), keys, order)
    steps = O.neighbours(rows, keys, order, prev={"_before": "ts"})
    gaps = steps.select("cell_id", (seconds("ts") - seconds("_before")).alias("gap_s"))
    return O.exact_percentiles(gaps, ["cell_id"], "gap_s", [0.5]).select("cell_id", F.col("p0").alias("median_s"))


def sampling_interval(df: DataFrame) -> DataFrame:
    """Median over cells of the per-cell median step (one row; one number per cell enters it)."""
    return interval_by_cell(df).agg(F.percentile("median_s", F.lit(0.5)).alias("freq_s"))


# Ordered (substring, plain text) rules for anomaly types, and layer names.
PLAIN_TYPES = [
    ("NAS Registration", "Registration Failure"),
    ("NAS Authentication", "Authentication Failure"),
    ("NAS PDUSession", "Data Session Failure"),
    ("NAS SecurityMode", "Security Setup Failure"),
    ("NGAP InitialContextSetup", "Initial Context Failure"),
    ("NGAP PDUSessionResource", "PDU Session Failure"),
    ("RRC Setup", "Radio Connection Failure"),
    ("RRC Reestablishment", "Radio Link Failure"),
    ("RRC Reconfiguration", "Reconfiguration Anomaly"),
    ("F1AP UEContextSetup", "UE Context Failure (DU-CU)"),
    ("E1AP BearerContext", "Bearer Setup Failure"),
    ("XnAP HandoverRequest", "Handover Failure"),
    ("Cascading failure", "Cascading Failure"),
    ("Anomalous message sequence", "Sequence Order Violation"),
]
PLAIN_LAYERS = {
    "NAS": "Core (NAS)", "NGAP": "Core (NGAP)", "RRC": "Radio (RRC)", "F1AP": "DU-CU (F1)",
    "E1AP": "DU-CU (E1)", "XnAP": "Inter-gNB (Xn)", "KPI": "KPI", "kpi": "KPI", "stats": "L1/L2 Stats",
}
# Fixed values: (field, words, action) tried in order when no recommendation is given.
ACTIONS = [
    ("evidence", ["radio-connection", "rlf"], "Check UE RF signal — possible coverage hole"),
    ("evidence", ["congestion", "cause 22", "#22"], "Check AMF load — possible network congestion"),
    ("evidence", ["timeout"], "Check network timer configuration"),
    ("type", ["auth"], "Check UE subscription and AUSF/UDM"),
    ("type", ["handover", "ho"], "Check HO parameters and neighbor cell coverage"),
    ("type", ["bearer", "pdu"], "Check UPF/SMF connectivity"),
    ("evidence", ["bler", "snr"], "Check antenna configuration and interference"),
    ("evidence", ["prb"], "Check PRB utilisation — possible capacity issue"),
]
DEFAULT_ACTION = "Investigate and escalate to NOC"


def plain_type(col: Column) -> Column:
    text = F.replace(F.replace(col, F.lit(" anomaly"), F.lit("")), F.lit("_"), F.lit(" "))
    out = F
    for word, label in PLAIN_TYPES:
        out = out.when(F.lower(text).contains(word.lower()), label)
    return out.otherwise(F.initcap(text))


def plain_layer(col: Column) -> Column:
    out = F
    for layer, label in PLAIN_LAYERS.items():
        out = out.when(col == layer, label)
    return out.otherwise(F.when(F.coalesce(col, F.lit("")) == "", "—").otherwise(col))


def short_action(evidence: Column, recommendation: Column, kind: Column) -> Column:
    rec = F.coalesce(recommendation, F.lit(""))
    out = F.when(rec != "", F.trim(F.split_part(rec, F.lit("."), F.lit(1))))
    fields = {"evidence": F.lower(F.coalesce(evidence, F.lit(""))), "type": F.lower(F.coalesce(kind, F.lit("")))}
    for field, words, action in ACTIONS:
        out = out.when(contains_any(fields[field], words), action)
    return out.otherwise(DEFAULT_ACTION)
