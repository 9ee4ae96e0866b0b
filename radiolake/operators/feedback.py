"""Engineer verdicts: statistics and detector parameter updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from radiolake.functions.columns import rnd

# Detector, parameter, default
BASE_PARAMS = [
    ("Isolation Forest", "contamination", 0.15),
    ("One-Class SVM", "nu", 0.15),
    ("LOF", "contamination", 0.15),
    ("Elliptic Envelope", "contamination", 0.15),
    ("Statistical", "sensitivity", 1.0),
    ("LSTM Autoencoder", "threshold_multiplier", 1.0),
    ("Threshold", "sensitivity", 1.0),
    ("Peer Comparison", "z_threshold", 2.0),
    ("Trend", "slope_threshold", 0.5),
    ("IQR", "k", 3.0),
    ("CUSUM", "threshold", 4.0),
    ("Bollinger Bands", "k", 2.5),
]
TARGET_FP_RATE, STEP, MIN_FEEDBACK, MIN_RATED = 0.10, 0.30, 5, 2
SHARE_PARAMS, FACTOR_PARAMS = ("contamination", "nu"), ("sensitivity", "threshold_multiplier")


def base_params(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BASE_PARAMS, "detector string, param string, value double")


def _counts() -> list[Column]:
    v = F.col("verdict")
    return [
        F.count(F.lit(1)).alias("total"),
        F.count_if(v == "correct").alias("correct"),
        F.count_if(v == "false_positive").alias("false_positive"),
        F.count_if(v == "uncertain").alias("uncertain"),
    ]


def _precision() -> Column:
    rated = F.col("correct") + F.col("false_positive")
    return rnd(F.col("correct") / F.nullif(rated, F.lit(0)), 3)


def feedback_stats(feedback: DataFrame) -> DataFrame:
    """Verdict counts and precision overall, by detector and by source in one pass."""
    sets = feedback.groupingSets([[], ["detector"], ["source"]], "detector", "source").agg(
        F.grouping_id().alias("g"), *_counts()
    )
    return sets.select(
        F.when(F.col("g") == 3, "all").when(F.col("g") == 1, "detector").otherwise("source").alias("kind"),
        F.when(F.col("g") == 1, F.col("detector")).when(F.col("g") == 2, F.col("source")).alias("value"),
        "total", "correct", "false_positive", "uncertain",
        _precision().alias("precision"),
    )


def detector_precision(feedback: DataFrame, last: int = 50) -> tuple[DataFrame, DataFrame]:
    """Per-detector precision table, and the newest verdicts."""
    table = feedback.groupBy("detector").agg(*_counts()).withColumn("precision", _precision())
    return table, feedback.orderBy(F.col("feedback_id").desc()).limit(last)


def _clamp(v: Column, lo, hi) -> Column:
    return F.least(F.greatest(v, lo if isinstance(lo, Column) else F.lit(lo)), hi if isinstance(hi, Column) else F.lit(hi))


def retrain(feedback: DataFrame, params: DataFrame | None = None) -> DataFrame:
    """One row per detector parameter: before, after, changed.

    A detector needs two rated verdicts and the whole store five records; other
    parameters come back unchanged with a status that says why.
    """
    params = params if params is not None else base_params(feedback.sparkSession)
    rated = feedback.groupBy("detector").agg(*_counts())
    rated = rated.select("detector", "total", "correct", "false_positive",
                         F.sum("total").over(Window.partitionBy()).alias("all_records"))
    n = F.col("correct") + F.col("false_positive")
    j = params.join(rated, "detector", "left").withColumn(
        "fp_rate", F.col("false_positive") / F.nullif(n, F.lit(0))
    )
    delta = STEP * (F.col("fp_rate") - TARGET_FP_RATE)
    b = F.col("value")
    after = (
        F.when(F.col("param").isin(*SHARE_PARAMS), _clamp(b - delta, 0.02, 0.40))
        .when(F.col("param").isin(*FACTOR_PARAMS), _clamp(b + delta, 0.5, 2.0))
        .otherwise(_clamp(b + delta * b, b * 0.5, b * 2.0))
    )
    status = (
        F.when(F.coalesce(F.col("all_records"), F.lit(0)) < MIN_FEEDBACK, "skipped: too few records")
        .when(F.coalesce(n, F.lit(0)) < MIN_RATED, "skipped: too few rated")
        .otherwise("ok")
    )
    out = j.withColumn("status", status).withColumn(
        "after", F.when(F.col("status") == "ok", rnd(after, 4)).otherwise(b)
    )
    return out.select(
        "detector", "param", "status", rnd("fp_rate", 3).alias("fp_rate"), b.alias("before"), "after",
        (b != F.col("after")).alias("changed"),
    )


def save_params(updates: DataFrame, path: str, dry_run: bool = False) -> DataFrame:
    """New parameter table; written as JSON unless dry."""
    new = updates.select("detector", "param", F.col("after").alias("value"))
    if not dry_run:
        new.write.mode("overwrite").json(path)
    return new


def current_params(spark: SparkSession, saved: DataFrame | None = None) -> DataFrame:
    """Saved parameters over defaults."""
    base = base_params(spark)
    if saved is None:
        return base
    s = saved.select("detector", "param", F.col("value").alias("saved"))
    return base.join(s, ["detector", "param"], "left").select(
        "detector", "param", F.coalesce("saved", "value").alias("value")
    )
