"""Structured Streaming forms of the operators.

Stateless rules reuse the batch functions unchanged.  Stateful ones keep a small
record per key: an open request, a session, two running sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from radiolake.catalogue import kpi as K
from radiolake.functions.columns import limit_severity
from radiolake.operators import feedback as B
from radiolake.operators import kpi_detectors as D
from radiolake.operators.events import SOURCES, correlation_key
from radiolake.operators.signalling import role_class, transaction_key
from radiolake.session import cut_lineage, fresh_path


def read_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", files: str | None = None,
                files_per_trigger: int | None = None) -> DataFrame:
    """Files of a folder as a stream; ``files`` is a name pattern."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files:
        reader = reader.option("pathGlobFilter", files)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def drain(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Process everything available into a table in the shared folder and open that table."""
    spark = stream.sparkSession
    out, state = fresh_path(spark, label), fresh_path(spark, f"{label}-state")
    run = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", out)
        .option("checkpointLocation", state).trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def limit_alarms(kpi_stream: DataFrame, capacities: DataFrame | None = None) -> DataFrame:
    """Catalogue limits per reading; with capacities also the share-of-capacity rules.  Stateless."""
    throughput = F.col("kpi").isin(list(K.THROUGHPUT_DIRECTION))
    if capacities is None:
        return D.limits_generic(kpi_stream)
    plain = D.limits_generic(kpi_stream.where(~throughput))
    return plain.unionByName(D.throughput_limits(kpi_stream, capacities))


PAIR_OUT = "tx_key string, seq bigint, outcome string, open_ts timestamp, cause string"
PAIR_STATE = "seq bigint, open_us bigint"


def pair_requests(messages: DataFrame, timeout_s: int = 30, delay: str = "1 minute") -> DataFrame:
    """Request/response pairing with a real timeout.

    One open request per transaction is remembered; it ends by its outcome, by
    the next request, or when event time passes ``timeout_s``.  A step sees one
    transaction's messages of one micro-batch; bound that with files per trigger.
    """
    m = messages.withColumns({"class": role_class(F.col("role")), "tx_key": transaction_key()})
    m = m.where(F.col("class").isNotNull()).select("tx_key", "ts", "seq", "class", "cause").withWatermark("ts", delay)

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tx, out = key[0], []
        opened = state.get if state.exists else None  # (seq, open_us)
        if state.hasTimedOut:
            out.append((tx, opened[0], "timeout", pd.Timestamp(opened[1], unit="us"), "timeout"))
            state.remove()
            yield pd.DataFrame(out, columns=["tx_key", "seq", "outcome", "open_ts", "cause"])
            return
        rows = pd.concat(list(chunks)).sort_values(["ts", "seq"])
        for ts, seq, kind, cause in rows[["ts", "seq", "class", "cause"]].itertuples(index=False):
            now = int(pd.Timestamp(ts).value // 1000)
            if opened is not None and now - opened[1] > timeout_s * 1_000_000:
                out.append((tx, opened[0], "timeout", pd.Timestamp(opened[1], unit="us"), "timeout"))
                opened = None
            if kind == "open":
                if opened is not None:
                    out.append((tx, opened[0], "superseded", None, None))
                opened = (int(seq), now)
            elif opened is None:
                out.append((tx, int(seq), "orphan", None, None))
            else:
                failed = (cause or "unknown") if kind == "failure" else None
                out.append((tx, int(seq), kind, pd.Timestamp(opened[1], unit="us"), failed))
                opened = None
        if opened is None:
            if state.exists:
                state.remove()
        else:
            state.update(opened)
            due = opened[1] // 1000 + timeout_s * 1000 + 1
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["tx_key", "seq", "outcome", "open_ts", "cause"])

    return m.groupBy("tx_key").applyInPandasWithState(step, PAIR_OUT, PAIR_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def match_requests(messages: DataFrame, timeout_s: int = 30, delay: str = "1 minute") -> DataFrame:
    """Requests with the answers that follow within ``timeout_s``; a request without one comes out as a timeout.

    A left-outer join of two streams on the transaction and a time interval. Both sides have a watermark, so a
    request is kept no longer than an answer may still come, and its outer row appears once event time has passed
    it. A request with several answers has a row for each; rows later than the watermark take no part. Unlike
    ``pair_requests``, it does not end a request by the next one, and no step holds a transaction's batch.
    """
    m = messages.withColumns({"class": role_class(F.col("role")), "tx_key": transaction_key()}).where(F.col("class").isNotNull())
    asked = m.where("class = 'open'").select("tx_key", "seq", "ts").withWatermark("ts", delay)
    answers = m.where("class <> 'open'").select(
        F.col("tx_key").alias("_key"), F.col("seq").alias("answer_seq"), F.col("ts").alias("answer_ts"), F.col("class").alias("_class"), "cause"
    ).withWatermark("answer_ts", delay)
    near = F.expr(f"tx_key = _key AND answer_ts >= ts AND answer_ts <= ts + INTERVAL {int(timeout_s)} SECONDS")
    out = asked.join(answers, near, "leftOuter")
    return out.select(
        "tx_key", "seq", "ts", F.coalesce("_class", F.lit("timeout")).alias("outcome"), "answer_seq", "answer_ts",
        F.when(F.col("_class").isNull(), "timeout").when(F.col("_class") == "failure", F.coalesce("cause", F.lit("unknown"))).alias("cause"),
    )


def dedupe_events(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """First event of each content while the watermark remembers it."""
    key = ["source", "state", "lead_time_h", "cell_id", "_name", "_raw_value", "evidence", "detector"]
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(key)


def correlate_windows(events: DataFrame, length: str = "1 hour", slide: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Sources seen per key in sliding windows; at most one flag per source is kept."""
    ev = events.withColumn("corr_key", correlation_key()).withWatermark("ts", delay)
    seen = [F.max((F.col("source") == s).cast("int")).alias(s) for s in SOURCES]
    agg = ev.groupBy(F.window("ts", length, slide).alias("w"), "corr_key").agg(*seen, F.count(F.lit(1)).alias("events"))
    n = sum((F.col(s) for s in SOURCES), F.lit(0))
    return agg.select("corr_key", F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), n.alias("n_sources"), "events").where(
        F.col("n_sources") >= 2
    )


def load_sessions(kpi_stream: DataFrame, gap: str = "90 seconds", min_warning: int = 5, min_critical: int = 3, delay: str = "1 minute") -> DataFrame:
    """Sustained load as sessions of readings over the limit."""
    row = next(k for k in K.KPIS if k[0] == K.PRB_DL)
    sev = limit_severity(F.col("value"), F.lit(row[6]), F.lit(row[7]), F.lit(True))
    hits = kpi_stream.where(F.col("kpi") == K.PRB_DL).withColumn("sev", sev).where(F.col("sev").isNotNull())
    s = hits.withWatermark("ts", delay).groupBy("cell_id", F.session_window("ts", gap).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.max("value").alias("peak"), F.max((F.col("sev") == "Critical").cast("int")).alias("c")
    )
    level = F.when((F.col("c") == 1) & (F.col("n") >= min_critical), "Critical").when(F.col("n") >= min_warning, "High")
    return s.select("cell_id", F.col("w.start").alias("start_ts"), "n", "peak", level.alias("severity")).where(F.col("severity").isNotNull())


CUSUM_OUT = "kpi string, cell_id string, ts timestamp, seq bigint, value double, severity string"
CUSUM_STATE = "mu double, sigma double, s_pos double, s_neg double, done boolean, held array<double>, held_us array<bigint>, held_seq array<bigint>"


def online_cusum(kpi_stream: DataFrame, reference_window: int, threshold: float = 5.0, k: float = 0.5, delay: str = "1 minute") -> DataFrame:
    """First alarm per (KPI, cell) against a baseline frozen after ``reference_window`` readings.

    Readings are held only until the baseline is known; then two sums remain.
    """
    worse_high = {row[0]: row[4] == K.LOWER for row in K.KPIS}

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kpi, cell = key
        mu, sigma, sp, sn, done, held, held_us, held_seq = state.get if state.exists else (None, None, 0.0, 0.0, False, [], [], [])
        out = []
        rows = pd.concat(list(chunks)).sort_values(["ts", "seq"])
        if not done:
            us = [int(pd.Timestamp(t).value // 1000) for t in rows["ts"]]
            todo = list(zip(us, rows["seq"].tolist(), rows["value"].tolist()))
            if mu is None:
                todo = list(zip(held_us, held_seq, held)) + todo
                held, held_us, held_seq = [], [], []
                if len(todo) < reference_window:
                    held_us, held_seq, held = ([r[i] for r in todo] for i in (0, 1, 2))
                    todo = []
                else:
                    ref = pd.Series([v for _, _, v in todo[:reference_window]])
                    mu, sigma = float(ref.mean()), float(ref.std(ddof=0))
            for t, seq, v in todo:
                if not sigma:
                    break
                z = (v - mu) / sigma
                sp, sn = max(0.0, sp + z - k), max(0.0, sn - z - k)
                bad = sp if worse_high.get(kpi, False) else sn
                if bad > threshold or max(sp, sn) > 2 * threshold:
                    level = "High" if max(sp, sn) > 2 * threshold else "Medium"
                    out.append((kpi, cell, pd.Timestamp(t, unit="us"), int(seq), float(v), level))
                    done = True
                    break
        state.update((mu, sigma, sp, sn, done, list(held), list(held_us), list(held_seq)))
        yield pd.DataFrame(out, columns=["kpi", "cell_id", "ts", "seq", "value", "severity"])

    rows = kpi_stream.where(F.col("value").isNotNull()).select("kpi", "cell_id", "ts", "seq", "value").withWatermark("ts", delay)
    return rows.groupBy("kpi", "cell_id").applyInPandasWithState(step, CUSUM_OUT, CUSUM_STATE, "append", GroupStateTimeout.NoTimeout)


def retrain_on_arrival(feedback_stream: DataFrame, store: str, params_path: str, checkpoint: str,
                       after: Callable[[DataFrame], None] | None = None) -> None:
    """Add new verdict files to the store and move the saved parameters on; for a nightly run.

    The batch number names the written part, so a repeated batch replaces itself.
    """

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{store}/batch={number}")
        spark = df.sparkSession
        try:
            saved = spark.read.schema("detector string, param string, value double").json(params_path)
        except AnalysisException:  # the first night
            saved = None
        # the new table replaces the one that it is made from
        updates = cut_lineage(B.retrain(spark.read.parquet(store), B.current_params(spark, saved)), "retrained")
        B.save_params(updates, params_path)
        if after:
            after(updates)

    feedback_stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(
        availableNow=True
    ).start().awaitTermination()
