"""One event log for all sources: normalise, deduplicate, correlate, rank, summarise."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from radiolake.functions import ordered as O
from radiolake.functions.columns import SEVERITIES, contains_any, rnd, seconds, severity_rank, text_or

SOURCES = ("kpi", "pcap", "stats")
NO_CELL = "—"
EVENT = [
    "event_id", "source", "state", "lead_time_h", "severity", "category", "cell_id", "metric", "layer", "value",
    "unit", "evidence", "detector", "score", "ts", "seq", "raw",
]
# Bucket words for events without a cell, tried in this order.
BUCKETS = [
    ("proc::rrc", ["rrc"]),
    ("proc::nas", ["nas", "registration", "auth", "pdu"]),
    ("proc::ngap", ["ngap", "context", "handover"]),
]


def event_time(df: DataFrame, names: Sequence[str] = ("timestamp", "ts", "time")) -> Column:
    """Own time of the anomaly: the first of the columns with a value decides; markers like "trend" give null."""
    have = [n for n in names if n in df.columns]
    parsed = [
        F.col(n) if dict(df.dtypes)[n].startswith("timestamp") else F.try_to_timestamp(F.col(n).cast("string"))
        for n in have
    ]
    if not have:
        return F.lit(None).cast("timestamp")
    out = F
    for n, value in zip(have, parsed):
        blank = F.col(n).isNull() if dict(df.dtypes)[n].startswith("timestamp") else F.trim(F.coalesce(F.col(n).cast("string"), F.lit(""))) == ""
        out = out.when(~blank, value)
    return out.otherwise(F.lit(None).cast("timestamp"))


def to_events(anomalies: DataFrame, source: str | None = None, state: str = "current", lead_time_h: float = 0.0) -> DataFrame:
    """Anomalies of one source (or with a ``source`` column) in the common event shape."""
    have = set(anomalies.columns)

    def col(name: str, kind: str = "string", default=None) -> Column:
        base = F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)
        return base if default is None else F.coalesce(base, F.lit(default).cast(kind))

    src = F.lit(source) if source else F.col("source")
    pcap = src == "pcap"
    layer = F.when(pcap, F.coalesce(col("layer"), F.split_part(col("procedure"), F.lit("_"), F.lit(1)))).otherwise(F.upper(src))
    seq = F.col("seq") if "seq" in have else F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in anomalies.columns])))
    return anomalies.select(
        src.alias("source"),
        F.lit(state).alias("state") if "state" not in have else col("state", default=state).alias("state"),
        col("lead_time_h", "double", lead_time_h).alias("lead_time_h"),
        col("severity", default="Low").alias("severity"),
        F.when(pcap, F.coalesce(col("type"), col("label"), F.lit(""))).otherwise(F.coalesce(col("label"), col("type"), F.lit(""))).alias("category"),
        text_or("cell_id", NO_CELL).alias("cell_id") if "cell_id" in have else F.lit(NO_CELL).alias("cell_id"),
        F.when(pcap, col("procedure", default="")).otherwise(col("category", default="")).alias("metric"),
        F.coalesce(layer, F.lit("")).alias("layer"),
        F.when(~pcap, col("value", "double")).alias("value"),
        F.when(pcap, "").otherwise(col("unit", default="")).alias("unit"),
        col("evidence", default="").alias("evidence"),
        col("detector", default="unknown").alias("detector"),
        col("score", "double", 0.0).alias("score"),
        event_time(anomalies).alias("ts"),
        seq.cast("bigint").alias("seq"),
        F.coalesce(col("category"), col("type"), col("label"), F.lit("")).alias("_name"),
        col("value", "double").alias("_raw_value"),
        F.struct(*[F.col(f"`{c}`") for c in anomalies.columns]).alias("raw"),
    )


def dedupe(events: DataFrame) -> DataFrame:
    """First event of each content; time is not part of the content.

    An aggregate keeping the earliest row, so a content repeated in a third of
    the log is reduced before the shuffle.
    """
    key = ["source", "state", "lead_time_h", "cell_id", "_name", "_raw_value", "evidence", "detector"]
    rest = [c for c in events.columns if c not in key]
    first = F.min_by(F.struct(*rest), F.col("seq"))
    # the hash leads the key so that sorting compares one number, not eight strings
    out = events.groupBy(F.xxhash64(*key).alias("_h"), *key).agg(first.alias("r")).select("_h", *key, "r.*")
    ident = F.concat_ws("-", "source", "state", F.hex("_h"))
    return out.withColumn("event_id", ident).select(*EVENT)


def event_log(parts: Sequence[DataFrame], keep_raw: bool = True) -> DataFrame:
    """Union of event frames, deduplicated; without the source rows the shuffle is narrower."""
    parts = [p.withColumn("raw", F.to_json("raw") if keep_raw else F.lit(None).cast("string")) for p in parts]
    return dedupe(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts))


def correlation_key() -> Column:
    text = F.lower(F.coalesce("category", F.lit("")))
    out = F.when((F.coalesce("cell_id", F.lit("")) != "") & (F.col("cell_id") != NO_CELL), F.col("cell_id"))
    for name, words in BUCKETS:
        out = out.when(contains_any(text, words), name)
    return out.otherwise(F.concat(F.lit("proc::"), F.substring(text, 1, 20)))


def correlate(events: DataFrame, window_h: float = 1.0, sources: Sequence[str] = SOURCES, rows: int = O.BLOCK) -> DataFrame:
    """Which other sources report the same key within the window; a missing time matches any time.

    For each event only the nearest earlier and later time of every source
    matters, and those are running extremes: the work is linear, no pairs are
    formed and a hot cell is spread over its time slices.
    """
    window_s = window_h * 3600.0
    ev = events.withColumn("corr_key", correlation_key())
    flags = ev.groupBy("corr_key").agg(
        *[F.bool_or((F.col("source") == s) & F.col("ts").isNull()).alias(f"_t_{s}") for s in sources],
        *[F.bool_or(F.col("source") == s).alias(f"_any_{s}") for s in sources],
    )
    at = lambda s: F.when(F.col("source") == s, seconds("ts"))
    timed = O.sliced(ev.where(F.col("ts").isNotNull()), ["corr_key"], ["ts"], rows)
    timed = O.running(timed, ["corr_key"], ["ts"], {f"_p_{s}": ("max", at(s)) for s in sources}, peers=True)
    timed = O.running(timed, ["corr_key"], ["ts"], {f"_n_{s}": ("min", at(s)) for s in sources}, peers=True, reverse=True)
    timed = timed.drop(O.SLICE).join(flags, "corr_key")
    now = seconds("ts")
    near = {
        s: F.coalesce(now - F.col(f"_p_{s}") <= window_s, F.lit(False))
        | F.coalesce(F.col(f"_n_{s}") - now <= window_s, F.lit(False))
        | F.col(f"_t_{s}")
        for s in sources
    }
    untimed = ev.where(F.col("ts").isNull()).join(flags, "corr_key")
    found = lambda cond: F.array_compact(F.array(*[F.when(cond(s), F.lit(s)) for s in sources]))
    out = timed.select(*ev.columns, found(lambda s: near[s]).alias("_src")).unionByName(
        untimed.select(*ev.columns, found(lambda s: F.col(f"_any_{s}")).alias("_src"))
    )
    many = F.size("_src") >= 2
    return out.withColumns(
        {
            "correlated_sources": F.when(many, F.array_remove("_src", F.col("source"))).otherwise(F.array().cast("array<string>")),
            "correlation_confidence": F.when(many, rnd(F.size("_src") / 3.0, 2)).otherwise(0.0),
        }
    ).drop("_src")


def prioritised(events: DataFrame, source: str | None = None, state: str | None = None, min_severity: str = "Low") -> DataFrame:
    """Most severe first, then by number of agreeing sources, then by score."""
    floor = len(SEVERITIES) - SEVERITIES.index(min_severity)
    rows = events.where(severity_rank() >= floor)
    if source:
        rows = rows.where(F.col("source") == source)
    if state:
        rows = rows.where(F.col("state") == state)
    return rows.orderBy(severity_rank().desc(), F.size("correlated_sources").desc(), F.col("score").desc(), "seq")


def correlated_only(events: DataFrame, min_sources: int = 2) -> DataFrame:
    return events.where(F.size("correlated_sources") >= min_sources - 1)


def by_cell(events: DataFrame, cell_id: str) -> DataFrame:
    return events.where(F.col("cell_id") == cell_id).orderBy(severity_rank().desc(), "seq")


def summary(events: DataFrame) -> DataFrame:
    """Header counts in one aggregation."""
    corr = F.size("correlated_sources") >= 1
    return events.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("state") != "predicted").alias("current"),
        F.count_if(F.col("state") == "predicted").alias("predicted"),
        F.count_if(corr).alias("correlated"),
        F.count_distinct(F.when(corr, F.col("cell_id"))).alias("correlated_unique_cells"),
        *[F.count_if(F.col("severity") == s).alias(f"sev_{s.lower()}") for s in SEVERITIES],
        *[F.count_if(F.col("source") == s).alias(f"src_{s}") for s in SOURCES],
    )


def top_cells(events: DataFrame, k: int = 5) -> DataFrame:
    return events.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "cell_id").limit(k)


def predicted_events(predicted: DataFrame, source: str, lead_time_h: float) -> DataFrame:
    return to_events(predicted, source, "predicted", lead_time_h)


def related_events(events: DataFrame, wanted: DataFrame, window_h: float = 1.0) -> DataFrame:
    """Events on the same cell within the window of the wanted ids; a missing time on either side matches.

    ``wanted`` is a lookup list; the join is on (cell, time bucket), each wanted
    event reaching at most three buckets.
    """
    w = window_h * 3600.0
    bucket = lambda c: F.floor(seconds(c) / w)
    focus = events.join(wanted.select("event_id").distinct(), "event_id").select(
        F.col("event_id").alias("focus_id"), "cell_id", F.col("ts").alias("focus_ts")
    )
    keep = [c for c in events.columns if c != "cell_id"]
    timed = events.where(F.col("ts").isNotNull()).withColumn("_b", bucket("ts"))
    near = (
        focus.where(F.col("focus_ts").isNotNull())
        .withColumn("_b", F.explode(F.array(*[bucket("focus_ts") + d for d in (-1, 0, 1)])))
        .join(timed, ["cell_id", "_b"])
        .where(F.abs(seconds("ts") - seconds("focus_ts")) <= w)
        .select("focus_id", "cell_id", *keep)
    )
    cols = ["focus_id", "cell_id", *keep]
    open_focus = focus.where(F.col("focus_ts").isNull()).join(events.where(F.col("ts").isNotNull()), "cell_id").select(*cols)
    open_event = focus.join(events.where(F.col("ts").isNull()), "cell_id").select(*cols)
    both = near.unionByName(open_focus).unionByName(open_event)
    return both.where(F.col("focus_id") != F.col("event_id"))


def related_counts(events: DataFrame, window_h: float = 1.0, by: Sequence[str] = ("cell_id",)) -> DataFrame:
    """Number of related events for every event, without forming pairs.

    Each event is copied to its own and the two neighbouring time buckets; a
    range frame inside a bucket then sees everything within the window.
    """
    by = list(by)
    us = int(window_h * 3_600_000_000)
    t = F.unix_micros("ts")
    own = F.floor(t / F.lit(us))
    timed = events.where(F.col("ts").isNotNull()).withColumn("_t", t)
    spread = timed.withColumn("_b", F.explode(F.array(own - 1, own, own + 1)))
    frame = Window.partitionBy(*by, "_b").orderBy("_t").rangeBetween(-us, us)
    near = spread.withColumn("_near", F.count(F.lit(1)).over(frame)).where(F.col("_b") == own)
    totals = events.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_all"), F.count_if(F.col("ts").isNull()).alias("_untimed")
    )
    a = near.join(totals, by).select(*events.columns, (F.col("_near") + F.col("_untimed") - 1).alias("related"))
    b = events.where(F.col("ts").isNull()).join(totals, by).select(*events.columns, (F.col("_all") - 1).alias("related"))
    return a.unionByName(b)


def event_by_id(events: DataFrame, event_id: str) -> DataFrame:
    return events.where(F.col("event_id") == event_id)


def predictions_of(events: DataFrame, cell_id: str) -> DataFrame:
    return prioritised(events.where(F.col("cell_id") == cell_id), state="predicted")


def combine_jobs(jobs: DataFrame, job_ids: Sequence[str] | None = None, window_h: float = 1.0) -> DataFrame:
    """Anomaly rows kept per job (``job_id``, ``source``) into one correlated log."""
    rows = jobs if job_ids is None else jobs.where(F.col("job_id").isin(list(job_ids)))
    return correlate(event_log([to_events(rows)]), window_h)
