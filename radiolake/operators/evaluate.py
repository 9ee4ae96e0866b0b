"""Forecast back-tests, detection metrics and evaluation tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from radiolake.functions import ordered as O
from radiolake.functions.columns import rnd, seconds, severity_rank
from radiolake.operators import forecast as P
from radiolake.operators.derive import sampling_interval
from radiolake.operators.forecast import KEYS, ORDER

METHODS = ["naive", "drift", "mean5", "trend"]
# Cell names that mark "no single cell".
NOT_A_CELL = ["", "?", "Fleet-wide", "—", "nan"]


def rolling_backtest(series: DataFrame, freq: DataFrame | None = None, horizon_h: float = 4.0, n_origins: int = 8,
                     step_h: float = 1.0, min_train: int = 24, smoothing: bool = False, digits: int = 4,
                     block: int = O.BLOCK) -> DataFrame:
    """MAE, RMSE and MAPE per (method, cell, KPI) over sliding origins.

    Training sets of later origins contain those of earlier ones, so each row
    is counted once, in the segment between two origins, and segment sums are
    accumulated per series.  Only the few rows inside a test horizon repeat.
    """
    freq = freq if freq is not None else sampling_interval(series)
    rows = O.numbered(P.known(series), KEYS, ORDER).drop(O.SLICE)
    rows = P.with_horizon(rows, freq, horizon_h).withColumn(
        "s", F.greatest(F.lit(1), F.floor(F.lit(step_h * 3600.0) / F.nullif(F.col("freq_s"), F.lit(0).cast("double"))).cast("int"))
    )
    top = F.col("n") - F.col("h")  # newest origin
    rows = rows.withColumn("_top", top).where(F.col("_top") >= min_train)
    # the last origin whose training set still holds the row
    seg = F.least(F.floor((F.col("_top") - F.col("rn")) / F.col("s")), F.lit(n_origins - 1))
    train = rows.where(F.col("rn") <= F.col("_top")).withColumn("k", seg.cast("int"))
    x = F.col("rn").cast("double")
    sums = train.groupBy(*KEYS, "k", "n", "h", "s", "_top").agg(
        F.count(F.lit(1)).alias("c"), F.sum("value").alias("sy"), F.sum(x).alias("sx"), F.sum(x * x).alias("sxx"),
        F.sum(x * F.col("value")).alias("sxy"), F.max_by("value", "rn").alias("last"), F.min(F.struct("rn", "value")).alias("first"),
    )
    every = (
        train.select(*KEYS, "n", "h", "s", "_top").distinct()
        .withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n_origins - 1))))
        .withColumn("origin", F.col("_top") - F.col("k") * F.col("s"))
        .where(F.col("origin") >= min_train)
    )
    ids = [*KEYS, "k", "n", "h", "s", "_top"]
    older = Window.partitionBy(*KEYS).orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, 0)
    cum = lambda c: F.sum(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).over(older)
    # a segment may hold rows for an origin that is itself too short; keep them in the running sums
    fits = sums.join(every, ids, "full").select(
        *ids, "origin", cum("c").alias("c"), cum("sy").alias("sy"), cum("sx").alias("sx"), cum("sxx").alias("sxx"),
        cum("sxy").alias("sxy"), F.col("last"), F.min("first").over(older)["value"].alias("first"),
    ).where(F.col("origin").isNotNull())
    five = (
        train.withColumn("_hi", F.floor((F.col("_top") - F.col("rn")) / F.col("s")))
        .withColumn("_lo", F.greatest(F.lit(0), F.ceil((F.col("_top") - F.col("rn") - (P.LAST - 1)) / F.col("s"))))
        .where(F.col("_lo") <= F.least(F.col("_hi"), F.lit(n_origins - 1)))
        .withColumn("k", F.explode(F.sequence(F.col("_lo").cast("int"), F.least(F.col("_hi"), F.lit(n_origins - 1)).cast("int"))))
        .groupBy(*KEYS, "k").agg(F.avg("value").alias("mean5"))
    )
    slope = (F.col("c") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.nullif(F.col("c") * F.col("sxx") - F.col("sx") * F.col("sx"), F.lit(0.0))
    models = fits.join(five, [*KEYS, "k"]).withColumn("slope", slope).withColumn(
        "icept", (F.col("sy") - F.col("slope") * F.col("sx")) / F.col("c")
    )
    lo = F.greatest(F.lit(0), F.ceil((F.col("_top") + 1 - F.col("rn")) / F.col("s")))
    hi = F.least(F.floor((F.col("n") - F.col("rn")) / F.col("s")), F.lit(n_origins - 1))
    tests = (
        rows.where(lo <= hi).withColumn("k", F.explode(F.sequence(lo.cast("int"), hi.cast("int"))))
        .select(*KEYS, "k", "rn", F.col("value").alias("actual"))
    )
    j = tests.join(models, [*KEYS, "k"])
    i = F.col("rn") - F.col("origin")
    preds = {
        "naive": F.col("last"),
        "drift": F.col("last") + i * (F.col("last") - F.col("first")) / (F.col("origin") - 1),
        "mean5": F.col("mean5"),
        "trend": F.col("icept") + F.col("slope") * F.col("rn"),
    }
    if smoothing:
        marks = train.withColumn("_part", F.floor(F.col("rn") / F.lit(block)))
        order = (n_origins - 1 - F.col("k")) * F.lit(1 << 40) + F.col("_part")
        states = P.smoothing_states(P.smoothing_blocks(marks, KEYS, order), KEYS)
        states = states.withColumn("k", (n_origins - 1 - F.floor(F.col("block") / F.lit(1 << 40))).cast("int"))
        last = states.groupBy(*KEYS, "k").agg(F.max_by(F.struct("level", "trend", "phi"), "block").alias("st"))
        j = j.join(last, [*KEYS, "k"])
        preds["holt_winters"] = F.col("st.level") + F.col("st.trend") * P.damped_sum(F.col("st.phi"), i)
    table = F.array(*[F.struct(F.lit(m).alias("method"), p.alias("yhat")) for m, p in preds.items()])
    err = j.select(*KEYS, "k", "actual", F.inline(table)).withColumn("e", F.col("yhat") - F.col("actual"))
    return err.groupBy("method", *KEYS).agg(
        rnd(F.avg(F.abs("e")), digits).alias("mae"),
        rnd(F.sqrt(F.avg(F.col("e") * F.col("e"))), digits).alias("rmse"),
        rnd(F.avg(F.abs(F.col("e") / F.nullif(F.col("actual"), F.lit(0.0)))) * 100, 2).alias("mape"),
        F.count_distinct("k").alias("n_origins"),
    )


def _as_of(rows: DataFrame, checks: DataFrame) -> DataFrame:
    """Checks with the count, sums, newest time and last value of their series up to them.

    Readings and check instants are one ordered table, and running sums are carried to the checks over slices of
    bounded size: the work is linear in readings plus checks, and no reading meets a fault.
    """
    order = ["_at", "_kind", "ts", "seq"]
    read = rows.select(*KEYS, F.col("x").alias("_at"), F.lit(0).alias("_kind"), "ts", "seq", "x", "value")
    ask = checks.withColumns({"_at": F.col("check_h") + 1e-9, "_kind": F.lit(1)})
    line = O.sliced(read.unionByName(ask, allowMissingColumns=True), KEYS, order)
    sums = {"c": "if(_kind = 0, 1.0D, 0.0D)", "sx": "x", "sy": "value", "sxx": "x * x", "sxy": "x * value"}
    spec = {n: ("sum", F.expr(e)) for n, e in sums.items()} | {"xm": ("max", F.col("x")), "tail": ("last", F.col("value"))}
    return O.running(line, KEYS, order, spec).where("_kind = 1").select("truth_id", "part", "check_h", *spec)


def lead_time(series: DataFrame, truth: DataFrame, freq: DataFrame | None = None, horizon_h: float = 4.0,
              check_step_h: float = 0.5, min_rows: int = 24, max_clean: int = 6, dim: DataFrame | None = None) -> DataFrame:
    """How long before a known fault a forecast turns High or Critical, and how often it does without a fault.

    ``truth``: truth_id, cell_id, kpi, start_h, end_h, kind, hours from the first
    reading.  Methods: trend and last value.
    """
    spark = series.sparkSession
    dim = dim if dim is not None else F.broadcast(P.limits_dim(spark))
    freq = freq if freq is not None else sampling_interval(series)
    rows = P.known(series)
    start = rows.agg(F.min(seconds("ts"))).scalar()
    rows = rows.withColumn("x", (seconds("ts") - start) / 3600.0)
    eps = 1e-9
    # checks before the fault: start - j * step
    last = F.floor(F.col("start_h") / check_step_h + eps).cast("int")
    checks = truth.where(last >= 1).withColumn("slot", F.explode(F.sequence(F.lit(1), last))).select(
        "truth_id", *KEYS, F.lit("lead").alias("part"), (F.col("start_h") - F.col("slot") * check_step_h).alias("check_h")
    )
    # checks away from every fault of the same series
    stop = F.greatest(F.col("start_h") - horizon_h, F.lit(0.5))
    count = F.ceil((stop - 0.5) / (2 * check_step_h) - eps).cast("int")
    grid = truth.where(count >= 1).withColumn("slot", F.explode(F.sequence(F.lit(0), count - 1))).withColumn(
        "check_h", 0.5 + F.col("slot") * 2 * check_step_h
    )
    # a check is near a fault when some window that has begun by then has not ended: a running maximum of ends
    marks = grid.select(*KEYS, F.col("check_h").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("double").alias("_end"), "truth_id", "slot", "check_h")
    begun = truth.select(*KEYS, (F.col("start_h") - horizon_h).alias("_at"), F.lit(0).alias("_kind"), F.col("end_h").cast("double").alias("_end"))
    so_far = Window.partitionBy(*KEYS).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    grid = begun.unionByName(marks, allowMissingColumns=True).withColumn("_open", F.max("_end").over(so_far))
    grid = grid.where((F.col("_kind") == 1) & ~F.coalesce(F.col("_open") >= F.col("_at"), F.lit(False)))
    first = F.row_number().over(Window.partitionBy("truth_id").orderBy("slot"))
    grid = grid.withColumn("_r", first).where(F.col("_r") <= max_clean).select("truth_id", *KEYS, F.lit("clean").alias("part"), "check_h")
    both = _as_of(rows, checks.unionByName(grid)).where(F.col("c") >= min_rows)
    both = P.with_horizon(both.join(truth, "truth_id"), freq, horizon_h).join(dim, "kpi", "left")
    slope = (F.col("c") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.nullif(F.col("c") * F.col("sxx") - F.col("sx") * F.col("sx"), F.lit(0.0))
    ahead = F.col("xm") + F.col("freq_s") / 3600.0 * (F.col("h") + 1) / 2.0
    table = F.array(
        F.struct(F.lit("trend").alias("method"), (F.col("sy") / F.col("c") + slope * (ahead - F.col("sx") / F.col("c"))).alias("yhat")),
        F.struct(F.lit("naive").alias("method"), F.col("tail").alias("yhat")),
    )
    scored = both.select("*", F.inline(table)).withColumn("alarm", P.forecast_severity(F.col("yhat")).isin("High", "Critical"))
    found = scored.groupBy("truth_id", "method").agg(
        F.min(F.when((F.col("part") == "lead") & F.col("alarm"), F.col("start_h") - F.col("check_h"))).alias("lead_time_h"),
        F.count_if((F.col("part") == "clean") & F.col("alarm")).alias("false_alarms"),
    )
    frame = truth.withColumn("method", F.explode(F.array(F.lit("trend"), F.lit("naive"))))
    return frame.join(found, ["truth_id", "method"], "left").select(
        "truth_id", "method", F.col("kind").alias("injected_event"), *KEYS,
        F.col("lead_time_h").isNotNull().alias("detected"), rnd("lead_time_h", 2).alias("lead_time_h"),
        F.coalesce("false_alarms", F.lit(0)).alias("false_alarms"),
    )


def method_summary(accuracy: DataFrame, lead: DataFrame | None = None) -> DataFrame:
    """Average errors per method, each over the series that have it, with lead-time counts."""
    acc = accuracy.groupBy("method").agg(
        F.count(F.lit(1)).alias("n_series"), F.count("mape").alias("n_mape"), rnd(F.avg("mae"), 4).alias("avg_mae"),
        rnd(F.avg("rmse"), 4).alias("avg_rmse"), rnd(F.avg("mape"), 2).alias("avg_mape"),
    )
    if lead is None:
        return acc
    lt = lead.groupBy("method").agg(
        F.count_if("detected").alias("lead_time_detected"), F.count(F.lit(1)).alias("lead_time_total"),
        F.sum("false_alarms").alias("total_false_alarms"),
    )
    return acc.join(lt, "method", "full")


# ---------------------------------------------------------------- detection quality

def cells_of(anomalies: DataFrame, detector: str | None = None) -> DataFrame:
    """Distinct real cells with an anomaly, of one detector when named."""
    rows = anomalies if detector is None else anomalies.where(F.col("detector") == detector)
    cell = F.trim(F.coalesce(F.col("cell_id").cast("string"), F.lit("")))
    return rows.select(cell.alias("cell_id")).where(~F.col("cell_id").isin(NOT_A_CELL)).distinct()


def any_of(*frames: DataFrame) -> DataFrame:
    out = cells_of(frames[0])
    for f in frames[1:]:
        out = out.union(cells_of(f))
    return out.distinct()


def correlated_cells(events: DataFrame, min_sources: int = 2) -> DataFrame:
    return cells_of(events.where(F.size("correlated_sources") >= min_sources - 1))


def count_outliers(anomalies: DataFrame, z: float = 1.5) -> DataFrame:
    """Cells with more anomalies than mean + z * population deviation of the cells that have any."""
    cell = F.trim(F.coalesce(F.col("cell_id").cast("string"), F.lit("")))
    counts = anomalies.select(cell.alias("cell_id")).where(~F.col("cell_id").isin(NOT_A_CELL)).groupBy("cell_id").agg(
        F.count(F.lit(1)).alias("n")
    )
    cut = counts.agg(F.avg("n") + z * F.stddev_pop("n")).scalar()
    return counts.where(F.col("n") > cut).select("cell_id")


def marked(detected: DataFrame, fault: DataFrame, cells: DataFrame) -> DataFrame:
    """Every cell with its outcome: TP, FP, FN or TN."""
    d = detected.select("cell_id").distinct().withColumn("_d", F.lit(True))
    f = fault.select("cell_id").distinct().withColumn("_f", F.lit(True))
    c = cells.select("cell_id").distinct().withColumn("_c", F.lit(True))
    j = c.join(d, "cell_id", "full").join(f, "cell_id", "full")
    got, bad = F.coalesce("_d", F.lit(False)), F.coalesce("_f", F.lit(False))
    mark = F.when(got & bad, "TP").when(got, "FP").when(bad, "FN").otherwise("TN")
    return j.select("cell_id", mark.alias("outcome"))


def _share(num: Column, den: Column) -> Column:
    return F.coalesce(num / F.nullif(den, F.lit(0)), F.lit(0.0))


def scenario_metrics(detected: DataFrame, fault: DataFrame, cells: DataFrame) -> DataFrame:
    """Cell-level confusion counts, precision, recall, F1 (0 where undefined) and the cell lists.

    The lists are one row, as the report has them; a fleet too large for that has the same cells as the rows of ``marked``.
    """
    names = lambda o: F.sort_array(F.collect_list(F.when(F.col("outcome") == o, F.col("cell_id"))))
    a = marked(detected, fault, cells).agg(
        *[F.count_if(F.col("outcome") == o).alias(o.lower()) for o in ("TP", "FP", "FN", "TN")],
        names("TP").alias("detected_fault_cells"), names("FN").alias("missed_fault_cells"), names("FP").alias("false_positive_cells"),
    )
    p, r = _share(F.col("tp"), F.col("tp") + F.col("fp")), _share(F.col("tp"), F.col("tp") + F.col("fn"))
    scores = a.withColumns({"precision": rnd(p, 4), "recall": rnd(r, 4), "f1": rnd(_share(2 * p * r, p + r), 4)})
    return scores.select("tp", "fp", "fn", "tn", "precision", "recall", "f1", "detected_fault_cells", "missed_fault_cells", "false_positive_cells")


def assignment_rate(events: DataFrame) -> DataFrame:
    """Share of events that another source confirms: overall and per source in one roll-up."""
    corr = F.size("correlated_sources") >= 1
    roll = events.rollup("source").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(corr).alias("clustered"),
        F.count_distinct(F.when(corr, F.col("cell_id"))).alias("unique_cells"),
    )
    return roll.select(
        F.coalesce("source", F.lit("all")).alias("source"), "total", "clustered",
        (F.col("total") - F.col("clustered")).alias("single_source"), "unique_cells",
        rnd(F.col("clustered") / F.col("total") * 100, 2).alias("rate_pct"),
    )


def granular(anomalies: DataFrame, fault: DataFrame, groups: Sequence[str] = ("kpi_group", "channel_type")) -> DataFrame:
    """Anomalies on faulty and on other cells per detector, cubed over the groups."""
    f = fault.select("cell_id").distinct().withColumn("_f", F.lit(True))
    j = anomalies.join(f, "cell_id", "left")
    sets = [["detector", *s] for s in ([], [groups[0]], [groups[1]], list(groups))]
    return j.groupingSets(sets, "detector", *groups).agg(
        F.grouping_id().alias("level"), F.count_if(F.col("_f").isNotNull()).alias("tp"), F.count_if(F.col("_f").isNull()).alias("fp")
    )


def fault_cells(truth: DataFrame) -> DataFrame:
    return truth.select("cell_id").distinct()


def normal_cells(truth: DataFrame, cells: DataFrame) -> DataFrame:
    return cells.select("cell_id").distinct().join(fault_cells(truth), "cell_id", "left_anti")


def scenario_cell(truth: DataFrame, scenario_id: str) -> DataFrame:
    return truth.where(F.col("scenario_id") == scenario_id).select("cell_id")


def keyword_hits(results: DataFrame, expected: DataFrame) -> DataFrame:
    """Share of expected keywords found in the explanation text of a cell.

    ``results``: cell_id, text; ``expected``: cell_id, keywords array.
    """
    j = expected.join(results, "cell_id", "left")
    text = F.lower(F.coalesce("text", F.lit("")))
    hits = F.filter("keywords", lambda k: F.contains(text, F.lower(k)))
    return j.select(
        "cell_id", hits.alias("matched"), F.size("keywords").alias("total_expected"),
        rnd(F.coalesce(F.size(hits) / F.nullif(F.size("keywords"), F.lit(0)), F.lit(0.0)), 3).alias("hit_rate"),
        (F.size(hits) > 0).alias("any_match"),
    )


def evidence_groups(events: DataFrame, cells: DataFrame, size: int = 5, fleet: str = "Fleet-wide") -> DataFrame:
    """The most severe ``size`` events per wanted cell, topped up by fleet-wide ones where a cell has fewer.

    A rank limit is pushed below the shuffle, so a busy cell sends ``size`` rows per task.
    """
    order = [severity_rank().desc(), F.col("seq").asc()]
    wanted = cells.select("cell_id").distinct()
    own = events.join(wanted, "cell_id", "left_semi")
    rn = F.row_number().over(Window.partitionBy("cell_id").orderBy(*order))
    own = own.withColumn("_r", rn).where(F.col("_r") <= size).drop("_r").withColumn("group_cell", F.col("cell_id"))
    sparse = wanted.join(
        own.groupBy("cell_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= size), "cell_id", "left_anti"
    )
    shared = events.where(F.col("cell_id") == fleet).orderBy(*order).limit(size).agg(F.collect_list(F.struct(*events.columns))).scalar()
    extra = sparse.select(F.col("cell_id").alias("group_cell"), F.inline(shared))
    both = own.unionByName(extra)
    first = Window.partitionBy("group_cell").orderBy(severity_rank().desc(), (F.col("cell_id") == fleet).asc(), F.col("seq").asc())
    return both.withColumn("position", F.row_number().over(first)).where(F.col("position") <= size)
