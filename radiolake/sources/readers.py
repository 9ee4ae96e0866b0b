"""Readers and routing: KPI and counter files, feedback lines, packet lists, payload tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from radiolake.catalogue import kpi as K
from radiolake.operators.normalise import detect_shape

FEEDBACK_SCHEMA = (
    "feedback_id string, timestamp string, session_id string, event_id string, source string, "
    "anomaly_type string, severity string, detector string, cell_id string, verdict string, "
    "comment string, evidence string"
)
PACKET_SCHEMA = (
    "`No.` bigint, Time double, Source string, Destination string, Protocol string, Length int, Info string"
)


def read_table(spark: SparkSession, path: str, fmt: str | None = None, schema: str | None = None) -> DataFrame:
    """CSV, Parquet, ORC or JSON by suffix or flag; folders and globs are fine.

    Adds ``seq``, because ties follow file order: for Parquet the row's number over all
    files by name, for text formats a number that rises with the position but is not without gaps.
    Without a schema CSV types are inferred; give one for large inputs.
    """
    kind = (fmt or path.rstrip("/").rsplit(".", 1)[-1]).lower()
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kind == "parquet":
        df = reader.parquet(path)
        return df if "seq" in df.columns else _numbered(df)
    if kind == "csv":
        df = reader.csv(path, header=True, inferSchema=schema is None)
    elif kind in ("json", "jsonl"):
        df = reader.json(path)
    elif kind == "orc":
        df = reader.orc(path)
    else:
        raise ValueError(f"unsupported format {kind!r}: use csv, parquet, json or orc")
    return df if "seq" in df.columns else df.withColumn("seq", F.monotonically_increasing_id())


def _numbered(df: DataFrame) -> DataFrame:
    """Row numbers from 0 over the files in order of their names; the sizes of the files are one small row each.

    Those go to the rows: dealt by file, a table of one file would be read by one task.
    """
    at = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    sizes = at.groupBy("_file").agg((F.max("_row") + 1).alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1))
    bases = sizes.select("_file", F.coalesce(before, F.lit(0)).alias("_base"))
    return at.join(F.broadcast(bases), "_file").select(*df.columns, (F.col("_base") + F.col("_row")).alias("seq"))


def read_feedback(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Verdict records, newest first; lines that are not JSON are skipped."""
    df = spark.read.schema(FEEDBACK_SCHEMA).option("mode", "DROPMALFORMED").json(path)
    df = df.orderBy(F.col("timestamp").desc(), F.col("feedback_id").desc())
    return df.limit(limit) if limit else df


def read_packet_list(spark: SparkSession, path: str) -> DataFrame:
    """Packet list export: one row per packet, no payload."""
    return spark.read.schema(PACKET_SCHEMA).csv(path, header=True).withColumnRenamed("No.", "packet_no")


def payload_rows(df: DataFrame, ts: str = "ts", seq: str = "seq", payload: str = "payload") -> DataFrame:
    """Any table or stream with a binary column as (ts, seq, payload)."""
    return df.select(F.col(ts).alias("ts"), F.col(seq).alias("seq"), F.col(payload).cast("binary").alias("payload"))


def route(columns: list[str], path: str = "", forced: str | None = None) -> str:
    """Which pipeline an input belongs to: ``kpi``, ``stats`` or ``pcap``.  Needs no job."""
    if forced:
        return forced
    suffix = path.rsplit(".", 1)[-1].lower() if "." in path else ""
    if suffix in ("xlsx", "xls"):
        return "kpi"
    lower = {c.lower() for c in columns}
    if "payload" in lower or suffix in ("pcap", "pcapng", "cap"):
        return "pcap"
    if detect_shape(columns) != "generic":
        return "stats"
    names = K.alias_map()
    return "kpi" if any(c in names for c in lower) else "stats"
