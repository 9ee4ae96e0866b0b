"""Writers: feedback lines, report tables, result JSON, replace-by-key merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from radiolake.functions.columns import SEVERITIES, text_or
from radiolake.sources.readers import FEEDBACK_SCHEMA

FEEDBACK_COLUMNS = [part.split()[0] for part in FEEDBACK_SCHEMA.split(", ")]
EVIDENCE_CHARS = 200


def feedback_rows(df: DataFrame) -> DataFrame:
    """Shape verdicts for the store: fixed columns, evidence cut to 200 characters."""
    have = set(df.columns)
    cols = [F.col(c).cast("string").alias(c) if c in have else F.lit("").alias(c) for c in FEEDBACK_COLUMNS]
    return df.select(*cols).withColumn("evidence", F.substring("evidence", 1, EVIDENCE_CHARS))


def append_feedback(df: DataFrame, path: str) -> None:
    feedback_rows(df).write.mode("append").json(path)


def anomaly_report(anomalies: DataFrame) -> DataFrame:
    """Report table of detected anomalies."""
    have = set(anomalies.columns)
    pick = lambda *names: F.coalesce(*[F.col(n).cast("string") for n in names if n in have], F.lit(""))
    return anomalies.select(
        pick("severity").alias("severity"),
        pick("type", "label", "category").alias("type"),
        text_or("cell_id", "—").alias("cell"),
        pick("layer").alias("layer"),
        pick("detector").alias("detector"),
        pick("evidence").alias("evidence"),
        pick("recommendation").alias("recommendation"),
    )


def prediction_report(predicted: DataFrame) -> DataFrame:
    return predicted.select(
        F.col("lead_time_h"),
        F.coalesce("label", "category").alias("metric"),
        text_or("cell_id", "—").alias("cell"),
        "severity",
        "detector",
        "evidence",
        "recommendation",
    )


def report_header(anomalies: DataFrame, predicted: DataFrame | None = None) -> DataFrame:
    """Header counts: total, one per severity, forecasts."""
    level = F.coalesce(F.col("severity"), F.lit("Low"))
    head = anomalies.agg(
        F.count(F.lit(1)).alias("total_anomalies"),
        *[F.count_if(level == s).alias(s.lower()) for s in SEVERITIES],
    )
    if predicted is None:
        return head.withColumn("predicted_anomalies", F.lit(0).cast("bigint"))
    return head.withColumn("predicted_anomalies", predicted.agg(F.count(F.lit(1))).scalar())


def write_report(df: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode)
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def write_result(df: DataFrame, path: str, drop: tuple[str, ...] = ("raw",), mode: str = "errorifexists") -> None:
    """Result rows as JSON without the raw payload columns."""
    df.drop(*drop).write.mode(mode).json(path)


def replace_by_key(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Keep old rows whose key was not produced again, then add the new rows."""
    redone = new.select(*keys).distinct()
    return old.join(redone, keys, "left_anti").unionByName(new, allowMissingColumns=True)
