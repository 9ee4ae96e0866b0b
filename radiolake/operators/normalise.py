"""Vendor columns to facts.  Column work happens at plan time; no job is run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from radiolake.catalogue import counters as C
from radiolake.catalogue import kpi as K
from radiolake.functions.columns import no_nan, rnd, text_or

# Names that mark identifier columns.
ID_NAMES = {
    "timestamp", "cell_id", "gnb_id", "date", "time", "siteid", "site_id", "node_id", "nodeid", "enodebid",
    "gnbid", "cellid", "period", "granularityperiod",
}
TS_NAMES = {"timestamp", "date", "time", "datetime", "period", "granularityperiod"}
CELL_NAMES = {"cell_id", "cellid", "cell", "eutrancell", "nrcell", "nrcellid"}
GNB_NAMES = {"gnb_id", "gnbid", "gnb", "nodeb", "enodeb_id", "site_id", "siteid"}


def q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


@dataclass(frozen=True)
class Roles:
    ts: str
    cell: str
    gnb: str
    measures: list[str]


def resolve_columns(df: DataFrame) -> DataFrame:
    """Rename vendor spellings to canonical KPIs; two columns for one KPI are coalesced in file order."""
    names = K.alias_map()
    groups: dict[str, list[str]] = {}
    for c in df.columns:
        groups.setdefault(names.get(c.lower(), c), []).append(c)
    return df.select(*[F.coalesce(*[F.col(q(c)) for c in cs]).alias(name) for name, cs in groups.items()])


def column_roles(df: DataFrame) -> Roles:
    def first(names: set[str]) -> str:
        return next((c for c in df.columns if c.lower() in names), "")

    ts, cell, gnb = first(TS_NAMES), first(CELL_NAMES), first(GNB_NAMES)
    skip = {ts, cell, gnb, "seq"}
    measures = [
        f.name
        for f in df.schema.fields
        if f.name not in skip and f.name.lower() not in ID_NAMES and isinstance(f.dataType, T.NumericType)
    ]
    return Roles(ts, cell, gnb, measures)


def parse_ts(col: Column) -> Column:
    """Timestamp or null; text that is no time never fails the job."""
    return F.try_to_timestamp(col.cast("string"))


def as_ts(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    return F.col(q(name)) if isinstance(kind, T.TimestampType) else parse_ts(F.col(q(name)))


def kpi_wide(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Canonical wide frame: cell_id, gnb_id, channel_type, ts, seq + one double column per KPI."""
    df = resolve_columns(df)
    roles = column_roles(df)
    channel = next((c for c in df.columns if c.lower() == "channel_type"), None)
    out = df.select(
        (text_or(q(roles.cell), "?") if roles.cell else F.lit("?")).alias("cell_id"),
        (text_or(q(roles.gnb), "?") if roles.gnb else F.lit("?")).alias("gnb_id"),
        (F.col(q(channel)).cast("string") if channel else F.lit(None).cast("string")).alias("channel_type"),
        (as_ts(df, roles.ts) if roles.ts else F.lit(None).cast("timestamp")).alias("ts"),
        (F.col("seq").cast("bigint") if "seq" in df.columns else F.monotonically_increasing_id()).alias("seq"),
        *[no_nan(q(m)).alias(m) for m in roles.measures],
    )
    return out, roles.measures


def to_long(df: DataFrame, ids: list[str], measures: list[str], name: str = "kpi") -> DataFrame:
    """One row per measure; every id column is carried."""
    return df.unpivot([q(i) for i in ids], [q(m) for m in measures], name, "value")


def kpi_facts(df: DataFrame) -> DataFrame:
    """KPI table to long facts, carrying the uplink load of the same row as ``prb_ul``."""
    wide, measures = kpi_wide(df)
    load = F.col(q(K.PRB_UL)) if K.PRB_UL in measures else F.lit(None).cast("double")
    ids = ["cell_id", "gnb_id", "channel_type", "ts", "seq", "prb_ul"]
    return to_long(wide.withColumn("prb_ul", load), ids, measures)


def detect_shape(columns: list[str]) -> str:
    lower = {c.lower() for c in columns}
    return next((shape for shape, marks in C.FINGERPRINTS if marks & lower), "generic")


def normalise_counters(df: DataFrame, shape: str | None = None) -> DataFrame:
    """Vendor counters to canonical metric columns plus cell_id, ts and seq.

    Whether a PRB column holds counts or percent depends on its maximum; that is
    a scalar subquery, so the plan stays one plan.
    """
    shape = shape or detect_shape(df.columns)
    have = {c.lower(): c for c in df.columns}

    def src(*names: str) -> Column | None:
        hit = next((have[n] for n in names if n in have), None)
        return F.col(q(hit)).cast("double") if hit else None

    def first(names: list[str]) -> str | None:
        return next((have[n] for n in names if n in have), None)

    metrics: dict[str, Column] = {}
    for names, metric in C.RENAMES[shape]:
        col = src(*names)
        if col is not None:
            metrics.setdefault(metric, col)

    def error_rate(direction: str, bad: Column | None, total: Column | None) -> None:
        if bad is not None and total is not None:
            bler = rnd(bad / F.nullif(total, F.lit(0.0)) * 100, 2)
            metrics[f"{direction}_bler"] = bler
            metrics[f"{direction}_harq_nack_rate"] = bler

    for d in ("dl", "ul"):
        if shape == "srsran":
            prb = src(f"{d}_prb")
            if prb is not None:
                top = df.agg(F.max(F.col(q(have[f"{d}_prb"])).cast("double"))).scalar()
                share = rnd(prb / F.lit(float(C.PRB_PER_CARRIER)) * 100, 1)
                metrics[f"{d}_prb_util"] = F.when(top <= C.PRB_COUNT_LIMIT, share).otherwise(prb)
            ok, nok = src(f"{d}_nof_ok"), src(f"{d}_nof_nok")
            error_rate(d, nok, ok + nok if ok is not None and nok is not None else None)
            rate = src(f"{d}_brate")
        elif shape == "oai":
            direct = src(f"{d}_bler")
            if direct is not None:
                metrics[f"{d}_bler"] = direct
            else:
                error_rate(d, src(f"{d}sch_errors"), src(f"{d}sch_total"))
            rate = src(f"{d}_bitrate")
        else:
            rate = None
        if rate is not None:
            metrics[f"{d}_throughput_mbps"] = rnd(rate / F.lit(1e6), 2)
    if shape == "generic":
        for metric, *_ in C.COUNTERS:
            col = src(metric)
            if col is not None:
                metrics[metric] = col
    ts, cell = first(C.TIME_COLUMNS[shape]), first(C.CELL_COLUMNS[shape])
    order = [m for m, *_ in C.COUNTERS if m in metrics]
    return df.select(
        (text_or(q(cell), "?") if cell else F.lit("ALL")).alias("cell_id"),
        (as_ts(df, ts) if ts else F.lit(None).cast("timestamp")).alias("ts"),
        (F.col("seq").cast("bigint") if "seq" in df.columns else F.monotonically_increasing_id()).alias("seq"),
        *[no_nan(metrics[m]).alias(m) for m in order],
    )
