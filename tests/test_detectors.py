"""Detector rules on hand-made series."""

import datetime as dt

import numpy as np
import pytest

from radiolake.catalogue import kpi as K
from radiolake.operators import counter_detectors as CD
from radiolake.operators import derive as V
from radiolake.operators import kpi_detectors as D
from radiolake.operators import normalise as N

T0 = dt.datetime(2026, 6, 13, 10, 0, 0)
SCHEMA = "cell_id string, gnb_id string, channel_type string, ts timestamp, seq bigint, prb_ul double, kpi string, value double"


@pytest.fixture
def short_slices(spark):
    """Packed series in slices of at most seven rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    yield
    spark.conf.set(key, before)


def facts(spark, values, kpi=K.PRB_DL, cell="PCI_1", channel="TDD", step=60, prb_ul=None):
    return spark.createDataFrame(
        [(cell, "gNB-1", channel, T0 + dt.timedelta(seconds=step * i), i, prb_ul, kpi, v) for i, v in enumerate(values)], SCHEMA
    )


@pytest.mark.parametrize(
    "values, severity, trigger",
    [
        ([85.0] * 4, None, None),
        ([85.0] * 5, "High", 5),
        ([95.0] * 2, None, None),
        ([95.0] * 3, "Critical", 3),
        ([85.0] * 38, "High", 5),
        ([85.0, 60.0] * 10, None, None),
        ([85.0, 85.0, 95.0, 85.0], "Critical", 3),
    ],
)
def test_sustained_load(spark, values, severity, trigger):
    rows = D.sustained_load(facts(spark, values)).collect()
    if severity is None:
        assert rows == []
    else:
        assert len(rows) == 1 and rows[0]["severity"] == severity
        assert rows[0]["ts"] == T0 + dt.timedelta(minutes=trigger - 1)
        assert rows[0]["sustained_minutes"] == len(values)


def test_run_breaks_on_gap_and_crosses_slices(spark, short_slices):
    f = facts(spark, [85.0] * 6, step=91)
    assert D.sustained_load(f).count() == 0
    long = facts(spark, [85.0] * 300)
    rows = D.sustained_load(long).collect()
    assert len(rows) == 1 and rows[0]["sustained_minutes"] == 300


@pytest.mark.parametrize("channel, mbps, severity", [("TDD", 769.0, None), ("FDD", 51.0, None), ("TDD", 60.0, "High"), ("FDD", 2.0, "Critical"), ("XYZ", 60.0, "High")])
def test_dl_share_of_capacity(spark, channel, mbps, severity):
    rows = D.throughput_limits(facts(spark, [mbps], "DL_Throughput_Mbps", channel=channel), directions=["dl"]).collect()
    assert [r["severity"] for r in rows] == ([severity] if severity else [])


@pytest.mark.parametrize(
    "prb, mbps, severity",
    [(60.0, 35.0, None), (60.0, 25.0, "High"), (60.0, 10.0, "Critical"), (None, 10.0, None), (float("nan"), 4.0, "High"), (300.0, 1.0, "Critical"), (2.0, 10.0, None)],
)
def test_uplink_judged_by_load(spark, prb, mbps, severity):
    rows = D.throughput_limits(facts(spark, [mbps], "UL_Throughput_Mbps", prb_ul=prb), directions=["ul"]).collect()
    assert [r["severity"] for r in rows] == ([severity] if severity else [])


def test_capacity_map_first_known_type(spark):
    rows = [("a", "x", None, T0, 0), ("a", "x", " tdd ", T0, 1), ("a", "x", "FDD", T0, 2), ("b", "x", "LTE", T0, 3)]
    df = spark.createDataFrame(rows, "cell_id string, gnb_id string, channel_type string, ts timestamp, seq bigint")
    assert [(r["cell_id"], r["dl_mbps"]) for r in V.capacity_map(df).collect()] == [("a", 1400.0)]


def test_limits_direction_and_unknown_kpi(spark):
    f = facts(spark, [97.0, 94.0, 99.5], "Cell_Availability_%").unionByName(facts(spark, [1e9], "Something_Else"))
    got = {(r["value"], r["severity"]) for r in D.limits_generic(f).collect()}
    assert got == {(97.0, "High"), (94.0, "Critical")}


def reference_cusum(vals, k=0.5, ref=None):
    base = vals[:ref] if ref is not None and ref < len(vals) else vals
    mu, sd = base.mean(), base.std()
    up = dn = 0.0
    out = []
    for v in vals:
        z = (v - mu) / sd
        up, dn = max(0.0, up + z - k), max(0.0, dn - z - k)
        out.append((up, dn))
    return np.array(out)


@pytest.mark.parametrize("ref", [None, 20, 500])
def test_cusum_closed_form_equals_recursion(spark, short_slices, ref):
    rng = np.random.default_rng(3)
    vals = np.concatenate([rng.normal(50, 5, 120), rng.normal(60, 5, 80)])
    got = D.cusum_path(facts(spark, [float(v) for v in vals], "Latency_ms"), reference_window=ref).orderBy("seq").toPandas()
    np.testing.assert_allclose(got[["s_pos", "s_neg"]].to_numpy(), reference_cusum(vals, ref=ref), atol=1e-9)


def test_peer_needs_six_cells(spark):
    def fleet(n):
        out = None
        for i in range(n):
            f = facts(spark, [100.0 if i == 0 else 10.0 + 0.01 * i], "Latency_ms", cell=f"PCI_{i}")
            out = f if out is None else out.unionByName(f)
        return D.detect_peers(out).count()

    assert fleet(5) == 0 and fleet(8) == 1


def test_trend_is_fleet_wide(spark):
    rows = D.detect_trend(facts(spark, [10.0 + i for i in range(10)], "Latency_ms", step=3600)).collect()
    assert [(r["cell_id"], r["severity"], r["value"]) for r in rows] == [("Fleet-wide", "Medium", 1.0)]
    assert D.detect_trend(facts(spark, [10.0 - i for i in range(10)], "Latency_ms", step=3600)).count() == 0


def test_bollinger_lag_and_worst(spark):
    vals = [10.0, 11.0, 10.0, 11.0, 10.0, 40.0, 10.0, 10.0, 90.0]
    rows = D.detect_bollinger(facts(spark, vals, "Latency_ms")).collect()
    assert [(r["value"], r["severity"]) for r in rows] == [(90.0, "High")]
    assert D.detect_bollinger(facts(spark, vals[:5], "Latency_ms")).count() == 0


def test_iqr_flat_series_is_silent(spark):
    assert D.detect_iqr(facts(spark, [5.0] * 20, "Latency_ms")).count() == 0


def counters(spark, values, metric="dl_bler", cell="PCI_1"):
    return spark.createDataFrame(
        [(cell, T0 + dt.timedelta(minutes=i), i, metric, v) for i, v in enumerate(values)],
        "cell_id string, ts timestamp, seq bigint, metric string, value double",
    )


def test_counter_threshold_uses_mean(spark):
    assert CD.detect_threshold(counters(spark, [0.0, 0.0, 0.0, 25.0])).count() == 0
    assert [r["severity"] for r in CD.detect_threshold(counters(spark, [25.0, 21.0])).collect()] == ["Critical"]
    assert [r["severity"] for r in CD.detect_threshold(counters(spark, [5.5, 5.0], "dl_mcs")).collect()] == ["High"]


def test_counter_calendar_left_out_by_default(spark):
    clock = counters(spark, [float(i // 60) for i in range(240)], "hour_of_day")
    assert CD.detect_trend(clock).count() == 0
    assert CD.detect_trend(clock, calendar=True).count() == 1


def test_counter_merge_prefers_severity_then_order(spark):
    f = counters(spark, [25.0] * 30)
    rows = CD.detect_counters(f).collect()
    assert [(r["detector"], r["severity"]) for r in rows] == [("Threshold", "Critical")]


def test_counter_default_band_never_fires(spark):
    rng = np.random.default_rng(1)
    f = counters(spark, [float(v) for v in rng.standard_cauchy(400)])
    assert CD.detect_bollinger(f).count() == 0
    assert CD.detect_bollinger(f, lagged=True).count() == 1


def test_alias_clash_goes_to_the_later_kpi(spark):
    assert K.alias_map()["drb drop rate 5qi9 %"] == "DRB_Drop_Rate_5QI9_%"
    df = spark.createDataFrame([(1.0, None), (None, 2.0)], "`Latency` double, `avg_latency` double")
    assert [r[0] for r in N.resolve_columns(df).collect()] == [1.0, 2.0]


def test_prb_counts_or_percent(spark):
    low = spark.createDataFrame([("t", "1", 53.0), ("t", "1", 106.0)], "timestamp string, pci string, dl_prb double")
    high = spark.createDataFrame([("t", "1", 53.0), ("t", "1", 140.0)], "timestamp string, pci string, dl_prb double")
    assert [r["dl_prb_util"] for r in N.normalise_counters(low).collect()] == [50.0, 100.0]
    assert [r["dl_prb_util"] for r in N.normalise_counters(high).collect()] == [53.0, 140.0]


def test_zero_total_gives_null_bler(spark):
    df = spark.createDataFrame([("1", 0, 0), ("1", 3, 1)], "pci string, dl_nof_ok int, dl_nof_nok int")
    assert [r["dl_bler"] for r in N.normalise_counters(df).collect()] == [None, 25.0]


def test_nan_and_bad_time_become_null(spark):
    df = spark.createDataFrame([("fleet-avg", "a", float("nan")), ("2024-01-01T00:00:00", "a", 1.0)], "Timestamp string, Cell_ID string, Latency_ms double")
    rows = N.kpi_facts(df).orderBy("seq").collect()
    assert [(r["ts"] is None, r["value"]) for r in rows] == [(True, None), (False, 1.0)]


def test_forward_fill_keeps_leading_gap(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([None, 1.0, None, 3.0, None])], "cell_id string, seq bigint, m double")
    out = V.forward_fill(df, ["m"], rows=2).orderBy("seq").collect()
    assert [r["m"] for r in out] == [None, 1.0, 1.0, 3.0, 3.0]


def test_baseline_needs_five_and_looks_back_sixty(spark):
    rows = [("a", T0 + dt.timedelta(minutes=i), i, float(i)) for i in range(70)]
    df = spark.createDataFrame(rows, "cell_id string, ts timestamp, seq bigint, dl_prb_util double")
    out = V.rolling_baseline(df, block=64).orderBy("seq").collect()
    assert out[3]["dl_prb_util_baseline_delta"] is None and out[4]["dl_prb_util_baseline_delta"] == 2.0
    assert out[69]["dl_prb_util_baseline_delta"] == 29.5 == out[69]["prb_baseline_delta"]
