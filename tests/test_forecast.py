"""Forecasts and back-tests on made-up series; streaming jobs over several files."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from radiolake.operators import evaluate as EV
from radiolake.operators import forecast as P
from radiolake.operators import kpi_detectors as D
from radiolake.operators import retrieval as R
from radiolake.operators import signalling as S
from radiolake.streaming import jobs as J

T0 = dt.datetime(2026, 1, 1)
FACT = "cell_id string, kpi string, ts timestamp, seq bigint, value double"


def series(spark, values, kpi="dl_prb_util", cell="a", step=3600):
    return spark.createDataFrame([(cell, kpi, T0 + dt.timedelta(seconds=step * i), i, float(v)) for i, v in enumerate(values)], FACT)


def damped(y, l, b, a, be, ph):
    sse = 0.0
    for v in y:
        e = v - (l + ph * b)
        sse += e * e
        l, b = l + ph * b + a * e, ph * b + a * be * e
    return l, b, sse


@pytest.mark.parametrize("block", [7, 1000])
def test_smoothing_equals_recursion_with_best_start(spark, block):
    rng = np.random.default_rng(4)
    y = 50 + 0.4 * np.arange(60) + rng.normal(0, 2, 60)
    got = P.forecast_smoothing(series(spark, y), block=block).first()
    best = None
    for a, be, ph in P.GRID:
        # squared error is quadratic in the start state: three probes per axis give its minimum
        f = lambda s: damped(y, s[0], s[1], a, be, ph)[2]
        h = 1.0
        g = np.array([(f((h, 0)) - f((-h, 0))) / 2, (f((0, h)) - f((0, -h))) / 2])
        f0 = f((0, 0))
        hxx, hyy = f((h, 0)) + f((-h, 0)) - 2 * f0, f((0, h)) + f((0, -h)) - 2 * f0
        hxy = (f((h, h)) - f((h, -h)) - f((-h, h)) + f((-h, -h))) / 4
        s = -np.linalg.solve(np.array([[hxx, hxy], [hxy, hyy]]), g)
        l, b, sse = damped(y, s[0], s[1], a, be, ph)
        if best is None or sse < best[0] - 1e-9:
            best = (sse, l + b * sum(ph**i for i in range(1, 5)), l, b, ph)
    assert got["sse"] == pytest.approx(best[0], rel=1e-6)
    assert got["path"][-1] == pytest.approx(best[1], rel=1e-6)
    assert len(got["path"]) == 4 and got["path"][0] != got["path"][-1]


def test_short_series_give_nothing(spark):
    s = series(spark, range(23))
    assert P.forecast_smoothing(s).count() == 0 and P.forecast_trend(s).count() == 0 and P.baselines(s).count() == 0


def test_trend_predicts_ahead_and_raises(spark):
    s = series(spark, [40 + 1.3 * i for i in range(36)])
    f = P.forecast_trend(s).first()
    assert f["h"] == 4 and f["forecast"] == pytest.approx(40 + 1.3 * (35 + 2.5))
    a = P.predicted_anomalies(P.forecast_trend(s), "Trend").collect()
    assert [(r["label"], r["severity"], r["state"], r["lead_time_h"]) for r in a] == [("dl_prb_util", "High", "predicted", 4.0)]


def test_piecewise_without_breaks_is_the_straight_line(spark):
    s = series(spark, [float(v) for v in np.random.default_rng(1).normal(50, 9, 60)])
    line, none = P.forecast_trend(s).first(), P.forecast_piecewise(s, breaks=0).first()
    for c in ("forecast", "forecast_high", "slope", "h", "n"):
        assert none[c] == pytest.approx(line[c], rel=1e-7)
    assert none["changes"] == []


def test_piecewise_follows_planted_breaks(spark):
    """Level until hour 40, then rising: the straight line misses the end, the pieces do not."""
    rng = np.random.default_rng(2)
    y = [20 + max(0, i - 40) * 1.5 + rng.normal(0, 0.3) for i in range(100)]
    s = series(spark, y)
    f, line = P.forecast_piecewise(s).first(), P.forecast_trend(s).first()
    ahead = 20 + (99 + 2.5 - 40) * 1.5
    assert abs(f["forecast"] - ahead) < 2 < abs(line["forecast"] - ahead)
    assert f["slope"] == pytest.approx(1.5, abs=0.1) and len(f["changes"]) == 25
    start = f["changes"][0]["x"]
    near = [c["change"] for c in f["changes"] if 33 <= c["x"] - start + 99 * 0.8 / 25 <= 47]
    assert sum(near) == pytest.approx(1.5, abs=0.3) and f["forecast_high"] - f["forecast"] < line["forecast_high"] - line["forecast"]
    assert P.trend_path(P.forecast_piecewise(s)).count() == 4


@pytest.mark.parametrize("breaks", [1, 4, 25])
def test_hinge_fit_is_plain_ridge(breaks):
    rng = np.random.default_rng(breaks)
    u, v = np.sort(rng.random(300)), rng.normal(5, 2, 300)
    knots = 0.8 * np.arange(1, breaks + 1) / breaks
    seg = (u[:, None] >= knots[None, :]).sum(axis=1)
    pieces = np.array([[g, (m := seg == g).sum(), u[m].sum(), (u[m] ** 2).sum(), v[m].sum(), (u[m] * v[m]).sum(), (v[m] ** 2).sum()] for g in np.unique(seg)])
    fit, sse, dof = P.hinge_fit(pieces, knots, 0.1, np.abs(v).max(), 1)
    design = np.column_stack([np.ones(300), u, np.maximum(u[:, None] - knots[None, :], 0)])
    line = np.linalg.lstsq(design[:, :2], v, rcond=None)[0]
    weight = ((v - design[:, :2] @ line) ** 2).mean() / (0.1 * np.abs(v).max()) ** 2
    want = np.linalg.solve(design.T @ design + np.diag([0, 0] + [weight] * breaks), design.T @ v)
    np.testing.assert_allclose(fit, want, rtol=1e-6, atol=1e-9)
    assert sse == pytest.approx(((v - design @ want) ** 2).sum(), rel=1e-8) and 2 < dof < breaks + 2


def test_piecewise_of_odd_series(spark):
    assert P.forecast_piecewise(series(spark, range(23))).count() == 0
    flat = P.forecast_piecewise(series(spark, [0.0] * 30)).first()
    assert flat["forecast"] == pytest.approx(0, abs=1e-9)
    same = series(spark, [1.0] * 30).withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    assert P.forecast_piecewise(same).count() == 0


def test_seasonal_beats_plain_on_a_cycle(spark):
    y = [50 + 20 * (i % 6 == 0) for i in range(72)]
    s = series(spark, y)
    plain, seasonal = P.forecast_smoothing(s).first(), P.forecast_smoothing(s, seasonal_periods=6).first()
    actual = np.array([50 + 20 * ((72 + i) % 6 == 0) for i in range(4)])
    err = lambda r: np.abs(np.array(r["path"]) - actual).mean()
    assert err(seasonal) < 1.0 < err(plain)


def test_lead_time_finds_a_ramp_early(spark):
    rng = np.random.default_rng(0)
    s = series(spark, [40 + 1.3 * i + rng.normal(0, 0.3) for i in range(48)])
    truth = spark.createDataFrame([("t1", "a", "dl_prb_util", 39.0, 47.0, "ramp")], "truth_id string, cell_id string, kpi string, start_h double, end_h double, kind string")
    rows = {r["method"]: r for r in EV.lead_time(s, truth).collect()}
    # the check nearest to the fault already sees the limit broken
    assert rows["trend"]["detected"] and rows["trend"]["lead_time_h"] == 0.5
    assert rows["naive"]["detected"] and rows["trend"]["false_alarms"] == 0


def test_backtest_ignores_zero_actuals_in_mape(spark):
    acc = EV.rolling_backtest(series(spark, [0.0] * 40)).collect()
    assert {r["method"] for r in acc} == set(EV.METHODS) and all(r["mae"] == 0.0 and r["mape"] is None for r in acc)
    assert EV.rolling_backtest(series(spark, range(20))).count() == 0


def test_backtest_smoothing_matches_single_forecast(spark):
    rng = np.random.default_rng(8)
    y = list(np.round(30 + rng.normal(0, 3, 50), 2))
    acc = EV.rolling_backtest(series(spark, y), n_origins=1, smoothing=True, digits=9).where("method = 'holt_winters'").first()
    path = P.forecast_smoothing(series(spark, y[:46])).first()["path"]
    assert acc["mae"] == pytest.approx(np.abs(np.array(path) - np.array(y[46:])).mean(), rel=1e-6)


def test_user_model_sees_its_context(spark):
    import pandas as pd

    out = P.forecast_each(series(spark, range(100)), lambda p: pd.DataFrame({"cell_id": ["a"], "n": [len(p)], "first": [p["value"].iloc[0]]}), "cell_id string, n int, first double", context=10)
    assert tuple(out.first()) == ("a", 10, 90.0)


# ------------------------------------------------------------ retrieval

def test_cosine_more_than_n_and_ties(spark):
    e = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "vec_id bigint, embedding array<float>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id bigint, embedding array<float>")
    assert [r["vec_id"] for r in R.cosine_topk(q, e, 10).orderBy("rank").collect()] == [1, 2, 3]
    two = q.union(spark.createDataFrame([(8, [0.0, 1.0])], q.schema))
    assert [r["vec_id"] for r in R.cosine_topk(two, e, 1).orderBy("query_id").collect()] == [3, 1]


def test_both_text_rankings_agree(spark):
    rng = np.random.default_rng(6)
    words = ["alpha", "beta", "gamma", "delta", "the"]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words, 30))) for i in range(200)], "doc_id bigint, text string")
    q = spark.createDataFrame([(i, " ".join(rng.choice(words, 3))) for i in range(20)], "query_id bigint, text string")
    a = R.bm25_topk(q, docs, 4).orderBy("query_id", "rank").collect()
    b = R.bm25_topk(q.repartition(3), docs.repartition(3), 4).orderBy("query_id", "rank").collect()
    assert a == b and len(a) == 80


# ------------------------------------------------------------ streaming

def files(df, path, parts):
    for i in range(parts):
        df.where(F.col("_part") == i).drop("_part").coalesce(1).write.parquet(f"{path}/p{i}")


def stream_of(spark, tmp_path, df, parts):
    """The rows as several files, read one per micro-batch in time order."""
    import pathlib
    import shutil
    import time

    files(df, str(tmp_path / "parts"), parts)
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(parts):
        src = next(pathlib.Path(tmp_path / "parts" / f"p{i}").glob("*.parquet"))
        shutil.copy(src, folder / f"{i}.parquet")
        time.sleep(1.1)
    return J.read_stream(spark, str(folder), df.drop("_part").schema, files_per_trigger=1)


def test_stream_pairing_over_batches_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = [(T0 + dt.timedelta(minutes=i), i, "NAS", "P", str(rng.choice(["request", "accept", "reject"])), str(rng.integers(0, 6)), None, i * 3 // 300) for i in range(300)]
    m = spark.createDataFrame(rows, "ts timestamp, seq bigint, layer string, procedure string, role string, ue_id string, cause string, _part int")
    want = {(r["seq"], r["outcome"]) for r in S.pair(m.drop("_part")).where("outcome not in ('answered', 'timeout')").collect()}
    out = J.drain(J.pair_requests(stream_of(spark, tmp_path, m, 3), timeout_s=86400), "t-pair")
    assert {(r["seq"], r["outcome"]) for r in out.collect()} == want


def test_stream_timeout_fires_on_event_time(spark, tmp_path):
    rows = [(T0, 0, "request", "1", 0), (T0 + dt.timedelta(minutes=10), 1, "request", "2", 0), (T0 + dt.timedelta(minutes=20), 2, "request", "3", 1), (T0 + dt.timedelta(minutes=30), 3, "accept", "3", 1)]
    m = spark.createDataFrame([(a, b, "NAS", "P", c, d, None, e) for a, b, c, d, e in rows], "ts timestamp, seq bigint, layer string, procedure string, role string, ue_id string, cause string, _part int")
    out = J.drain(J.pair_requests(stream_of(spark, tmp_path, m, 2), timeout_s=30), "t-timeout").collect()
    assert {(r["seq"], r["outcome"]) for r in out} >= {(0, "timeout"), (1, "timeout"), (2, "timeout"), (3, "orphan")}


def test_stream_join_matches_and_times_out(spark, tmp_path):
    """Answers within 30 s in the same or a later micro-batch, several answers to one request, late ones, and other transactions."""
    at = lambda s: T0 + dt.timedelta(seconds=s)
    rows = [
        (0, 0, "request", "1", 0), (10, 1, "accept", "1", 0), (28, 2, "reject", "1", 0), (40, 3, "request", "2", 0), (69, 4, "accept", "2", 1), (71, 5, "accept", "2", 1),
        (90, 6, "request", "3", 1), (95, 7, "accept", "4", 1), (100, 8, "request", "4", 1), (131, 9, "accept", "4", 2), (3600, 10, "request", "9", 2), (7200, 11, "accept", "8", 3), (7300, 12, "request", "8", 3),
    ]
    m = spark.createDataFrame([(at(a), b, "NAS", "P", c, d, "why" if c == "reject" else None, e) for a, b, c, d, e in rows], "ts timestamp, seq bigint, layer string, procedure string, role string, ue_id string, cause string, _part int")
    out = J.drain(J.match_requests(stream_of(spark, tmp_path, m, 4), timeout_s=30), "t-join").collect()
    got = sorted((r["seq"], r["outcome"], r["answer_seq"], r["cause"]) for r in out)
    assert got == [(0, "failure", 2, "why"), (0, "success", 1, None), (3, "success", 4, None), (6, "timeout", None, "timeout"), (8, "timeout", None, "timeout"), (10, "timeout", None, "timeout")]


def test_stream_cusum_over_batches_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(10)
    vals = np.concatenate([rng.normal(50, 5, 60), rng.normal(75, 5, 60)])
    rows = [("Latency_ms", "a", "g", T0 + dt.timedelta(minutes=i), i, float(v), i * 4 // 120) for i, v in enumerate(vals)]
    f = spark.createDataFrame(rows, "kpi string, cell_id string, gnb_id string, ts timestamp, seq bigint, value double, _part int")
    want = D.detect_cusum(f.drop("_part"), reference_window=40).first()
    got = J.drain(J.online_cusum(stream_of(spark, tmp_path, f, 4), reference_window=40), "t-cusum").collect()
    assert [(r["ts"], r["severity"]) for r in got] == [(want["ts"], want["severity"])]


@pytest.mark.parametrize("gap, merged", [(90, 1), (91, 0)])
def test_stream_session_gap(spark, tmp_path, gap, merged):
    rows = [("a", "PRB_Utilization_DL_%", T0 + dt.timedelta(seconds=gap * i), 95.0, 0) for i in range(3)] + [("a", "PRB_Utilization_DL_%", T0 + dt.timedelta(days=2), 95.0, 1)]
    f = spark.createDataFrame(rows, "cell_id string, kpi string, ts timestamp, value double, _part int")
    assert J.drain(J.load_sessions(stream_of(spark, tmp_path, f, 2)), "t-session").count() == merged
