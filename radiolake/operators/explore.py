"""Summaries and exploration queries over the long facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from radiolake.catalogue import kpi as K
from radiolake.functions import ordered as O
from radiolake.functions.columns import rnd, severity_name, severity_rank


def summary(facts: DataFrame, by: str = "kpi", digits: int = 4) -> DataFrame:
    """min, max, mean, sample deviation and the 10th / 90th percentile per measure."""
    known = facts.where(F.col("value").isNotNull())
    basic = known.groupBy(by).agg(
        rnd(F.min("value"), digits).alias("min"),
        rnd(F.max("value"), digits).alias("max"),
        rnd(F.avg("value"), digits).alias("mean"),
        rnd(F.stddev_samp("value"), digits).alias("std"),
    )
    tails = O.exact_percentiles(known, [by], "value", [0.10, 0.90]).select(
        by, rnd("p0", digits).alias("p10"), rnd("p1", digits).alias("p90")
    )
    return basic.join(tails, by)


def kpi_summary(facts: DataFrame) -> DataFrame:
    """Summary with catalogue attributes; unknown KPIs get neutral ones."""
    dim = K.kpi_dim(facts.sparkSession)
    return (
        summary(facts)
        .join(F.broadcast(dim.drop("advice")), "kpi", "left")
        .withColumns(
            {
                "label": F.coalesce("label", "kpi"),
                "category": F.coalesce("category", F.lit("Other")),
                "unit": F.coalesce("unit", F.lit("")),
                "direction": F.coalesce("direction", F.lit(K.HIGHER)),
            }
        )
    )


def health_table(facts: DataFrame) -> DataFrame:
    """Traffic light of the mean against the limits, worst first."""
    s = kpi_summary(facts)
    worse_high = F.col("direction") == K.LOWER
    red = F.when(worse_high, F.col("mean") >= F.col("critical")).otherwise(F.col("mean") <= F.col("critical"))
    amber = F.when(worse_high, F.col("mean") >= F.col("warning")).otherwise(F.col("mean") <= F.col("warning"))
    status = F.when(F.col("warning").isNull(), "info").when(red, "red").when(amber, "amber").otherwise("green")
    rank = F.when(F.col("status") == "red", 0).when(F.col("status") == "amber", 1).otherwise(2)
    out = s.withColumn("status", status).withColumn("mean", rnd("mean", 2))
    cols = ["status", "kpi", "label", "category", "unit", "min", "max", "mean", "p10", "p90", "warning", "critical"]
    return out.select(*cols).orderBy(rank, "kpi")


def profile(facts: DataFrame) -> DataFrame:
    """Row count, number of cells and gNBs, and time range."""
    return facts.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("cell_id").alias("n_cells"),
        F.count_distinct("gnb_id").alias("n_gnbs"),
        F.min("ts").alias("start_ts"),
        F.max("ts").alias("end_ts"),
    )


def picker_values(facts: DataFrame) -> DataFrame:
    """Distinct gNBs, cells and measures as (kind, value) rows."""
    kinds = F.array(
        *[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value"))
          for k, c in (("gnb", "gnb_id"), ("cell", "cell_id"), ("kpi", "kpi"))]
    )
    combos = facts.select("gnb_id", "cell_id", "kpi").distinct()
    return combos.select(F.inline(kinds)).where(F.col("value").isNotNull()).distinct()


def fleet_average(facts: DataFrame, kpi: str, digits: int = 4) -> DataFrame:
    return facts.where(F.col("kpi") == kpi).groupBy("ts").agg(rnd(F.avg("value"), digits).alias("value"))


def cell_ranking(facts: DataFrame, kpi: str, ascending: bool = False, digits: int = 4) -> DataFrame:
    means = facts.where(F.col("kpi") == kpi).groupBy("cell_id").agg(rnd(F.avg("value"), digits).alias("mean_value"))
    key = F.col("mean_value").asc() if ascending else F.col("mean_value").desc()
    return means.orderBy(key, "cell_id")


def top_cells_with_fleet(facts: DataFrame, kpi: str, k: int = 6) -> DataFrame:
    """Series of the k cells with the highest mean, plus the fleet average series."""
    top = cell_ranking(facts, kpi).limit(k)
    mine = facts.where(F.col("kpi") == kpi)
    per_cell = mine.join(top, "cell_id", "left_semi").groupBy(F.col("cell_id").alias("series"), "ts").agg(
        rnd(F.avg("value"), 4).alias("value")
    )
    return per_cell.unionByName(fleet_average(facts, kpi).select(F.lit("Fleet average").alias("series"), "ts", "value"))


def mean_matrix(facts: DataFrame, measures: Sequence[str], by=("cell_id", "gnb_id"), name: str = "kpi",
                digits: int = 2) -> DataFrame:
    """Cell by measure means.  The measure list is given, so no job looks for it."""
    wide = facts.groupBy(*by).pivot(name, list(measures)).agg(F.avg("value"))
    return wide.select(*by, *[rnd(F.col(f"`{m}`"), digits).alias(m) for m in measures])


def downsample(df: DataFrame, keys: Sequence[str], order: Sequence[str], max_points: int) -> DataFrame:
    """Keep the rows at index int(i * n / max) for i below max; shorter series stay whole.

    The index is kept in floating point so that picks agree with scripts doing the same.
    """
    rows = O.numbered(df, keys, order)
    step = F.col("n") / F.lit(float(max_points))
    at = (F.col("rn") - 1).cast("double")
    # the candidate i whose index can land on this row lies within one of at / step
    near = F.ceil(at / step)
    hits = [
        (near + d >= 0) & (near + d < max_points) & (F.floor((near + d).cast("double") * step) == at)
        for d in (-1, 0, 1)
    ]
    return rows.where((F.col("n") <= max_points) | hits[0] | hits[1] | hits[2]).select(*df.columns)


def two_metric_trend(facts: DataFrame, first: str, second: str, max_points: int = 60) -> DataFrame:
    """Mean of two measures per timestamp, thinned to at most ``max_points`` points."""
    mean = lambda k: rnd(F.avg(F.when(F.col("kpi") == k, F.col("value"))), 2)
    points = facts.where(F.col("kpi").isin(first, second) & F.col("ts").isNotNull()).groupBy("ts").agg(
        mean(first).alias("throughput_mbps"), mean(second).alias("prb_pct")
    )
    return downsample(points, [], ["ts"], max_points)


def in_range(facts: DataFrame, last_hours: float | None = None, start=None, end=None) -> DataFrame:
    """Last N hours before the newest row, or a closed range (swapped when given backwards)."""
    if last_hours is not None:
        newest = facts.agg(F.max("ts")).scalar()
        span = F.make_dt_interval(secs=F.lit(float(last_hours) * 3600))
        return facts.where(F.col("ts") >= newest - span)
    lo, hi = (start, end) if start <= end else (end, start)
    return facts.where(F.col("ts").between(F.lit(lo).cast("timestamp"), F.lit(hi).cast("timestamp")))


def selected(facts: DataFrame, kpis: Sequence[str] | None = None, cells: Sequence[str] | None = None,
             gnbs: Sequence[str] | None = None) -> DataFrame:
    for name, values in (("kpi", kpis), ("cell_id", cells), ("gnb_id", gnbs)):
        if values is not None:
            facts = facts.where(F.col(name).isin(list(values)))
    return facts


def series(facts: DataFrame, kpis=None, cells=None, gnbs=None, max_points: int = 80) -> DataFrame:
    """Mean per (measure, cell, timestamp) of the selection, thinned per series."""
    points = (
        selected(facts, kpis, cells, gnbs)
        .where(F.col("ts").isNotNull() & F.col("value").isNotNull())
        .groupBy("kpi", "cell_id", "ts")
        .agg(rnd(F.avg("value"), 4).alias("value"))
    )
    return downsample(points, ["kpi", "cell_id"], ["ts"], max_points)


def anomaly_distribution(anomalies: DataFrame, top_cells: int = 10) -> DataFrame:
    """Counts by severity, by detector and for the cells with most anomalies, from one pass."""
    sets = anomalies.groupingSets(
        [["severity"], ["detector"], ["cell_id"]], "severity", "detector", "cell_id"
    ).agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"))
    rows = sets.select(
        F.when(F.col("g") == 3, "severity").when(F.col("g") == 5, "detector").otherwise("cell").alias("kind"),
        F.when(F.col("g") == 3, F.col("severity")).when(F.col("g") == 5, F.col("detector"))
        .otherwise(F.col("cell_id")).alias("value"),
        "n",
    )
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.col("n").desc(), "value"))
    top = rows.where(F.col("kind") == "cell").withColumn("_r", rank).where(F.col("_r") <= top_cells).drop("_r")
    return rows.where(F.col("kind") != "cell").unionByName(top)


def method_matrix(anomalies: DataFrame, detectors: Sequence[str], by=("label", "cell_id")) -> DataFrame:
    """Highest severity per detector and how many detectors agree."""
    ranks = anomalies.groupBy(*by).pivot("detector", list(detectors)).agg(F.max(severity_rank()))
    cells = [F.col(f"`{d}`") for d in detectors]
    agree: Column = sum((c.isNotNull().cast("int") for c in cells), F.lit(0))
    return ranks.select(
        *by,
        *[severity_name(c).alias(d) for c, d in zip(cells, detectors)],
        agree.alias("confirmed_by"),
    ).where(F.col("confirmed_by") > 0)
