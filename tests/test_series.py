"""Packed series: plain pandas as the measure, odd rows, and one pass against each detector alone."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from radiolake.functions import ordered as O
from radiolake.functions import series as S
from radiolake.operators import counter_detectors as CD
from radiolake.operators import kpi_detectors as D

T0 = dt.datetime(2026, 6, 13, 10, 0, 0)
SCHEMA = "kpi string, cell_id string, gnb_id string, channel_type string, ts timestamp, seq bigint, prb_ul double, value double"


@pytest.fixture(scope="module", params=[5, 64])
def rows(spark, request):
    """Readings of three KPIs in seven cells (one without a name) with jumps, long loads, ties, gaps and nulls."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(request.param))
    rng = np.random.default_rng(11)
    out, seq = [], 0
    for kpi, mean in (("Latency_ms", 20.0), ("PRB_Utilization_DL_%", 78.0), ("DL_Throughput_Mbps", 300.0), ("Cell_Availability_%", 99.9)):
        for cell in ["a", "b", "c", "d", "e", "f", None]:
            level = mean * (1.6 if cell == "f" else 1.0)
            for i in range(90):
                level += mean * 0.2 if rng.random() < 0.03 else 0.0
                value = round(level + rng.normal(0, mean / 20), 2)
                when = None if rng.random() < 0.05 else T0 + dt.timedelta(seconds=60 * (i // 2))
                out.append((kpi, cell, f"g{i % 3}", "TDD" if cell != "e" else None, when, seq, None, None if rng.random() < 0.05 else value))
                seq += 1
    out += [(None, None, None, None, None, seq, None, 1.0), ("Latency_ms", "none", "g", "TDD", T0, seq + 1, None, None)]
    yield spark.createDataFrame(out, SCHEMA).repartition(5).cache(), pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])
    spark.conf.set(key, before)


def test_packing_keeps_every_reading_in_order(spark, rows):
    df, pdf = rows
    packed = D.pack(df)
    got = packed.select(f"{O.KEY}.*", O.SLICE, F.posexplode(F.arrays_zip("tss", "seqs", "values", "names"))).collect()
    assert packed.agg(F.max(F.size("values"))).first()[0] <= int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    want = pdf.dropna(subset=["value"])
    assert len(got) == len(want)
    for (kpi, cell), g in want.groupby(["kpi", "cell_id"], dropna=False):
        same = lambda a, b: a == b or (a is None and pd.isna(b))
        line = sorted((r[O.SLICE], r.pos, r.col.seqs) for r in got if same(r.kpi, kpi) and same(r.cell_id, cell))
        assert [x[2] for x in line] == list(g.sort_values(["ts", "seq"], na_position="first")["seq"])


def test_summaries_merge_to_the_whole(rows):
    df, pdf = rows
    out = {(r.kpi, r.cell_id): r for r in S.merged(S.summaries(D.pack(df))).select("_g0.*", "*").collect()}
    for (kpi, cell), g in pdf.dropna(subset=["value"]).groupby(["kpi", "cell_id"], dropna=False):
        r = out[(None if pd.isna(kpi) else kpi, None if pd.isna(cell) else cell)]
        v, t = g["value"], g.dropna(subset=["ts"])
        np.testing.assert_allclose([r.N, r.mu, r.M2], [len(v), v.mean(), ((v - v.mean()) ** 2).sum()], rtol=1e-9, atol=1e-9)
        assert r.TN == len(t)
        if len(t) > 1:
            x = (t["ts"] - pd.Timestamp(T0)).dt.total_seconds() / 3600
            np.testing.assert_allclose(r.XY / r.XX, np.polyfit(x, t["value"], 1)[0], rtol=1e-6)


def plain(row):
    return tuple(sorted((k, round(v, 6) if isinstance(v, float) else v) for k, v in row.asDict().items()))


def test_all_detectors_at_once_find_what_each_finds_alone(rows):
    df, _ = rows
    opts = {D.THRESHOLD: {"gap_s": 120.0}, D.PEER: {"z_threshold": 1.2}, D.TREND: {"slope_threshold": 0.1}, D.IQR: {"k": 1.0}}
    both = sorted(map(str, map(plain, D.detect_kpi(df, options=opts).collect())))
    each = sorted(str(plain(r)) for n in D.KPI_DETECTOR_NAMES for r in D.detect_kpi(df, [n], opts).collect())
    assert both == each
    assert {r for n in D.KPI_DETECTOR_NAMES for r in [n] if f"'{n}'" in str(both)} == set(D.KPI_DETECTOR_NAMES)


def test_counters_at_once_find_what_each_finds_alone(rows):
    df, _ = rows
    facts = df.select(F.col("kpi").alias("metric"), "cell_id", "ts", "seq", "value").unionByName(
        df.where("kpi = 'Latency_ms'").select(F.lit("dl_bler").alias("metric"), "cell_id", "ts", "seq", "value")
    ).where("metric is not null and cell_id is not null")
    opts = {CD.PEER: {"z_threshold": 1.0}, CD.IQR: {"k": 0.3}, CD.TREND: {"slope_threshold": 0.1}, CD.CUSUM: {"threshold": 1.2}, CD.BOLLINGER: {"lagged": True}}
    name = lambda r: (r.detector, r.label, r.cell_id, r.severity)
    both = {name(r): (r.value, r.score) for r in CD.detect_counters_each(facts, options=opts).collect()}
    each = {name(r): (r.value, r.score) for n in CD.COUNTER_DETECTOR_NAMES for r in CD.detect_counters_each(facts, [n], opts).collect()}
    assert set(both) == set(each) and {k[0] for k in both} == set(CD.COUNTER_DETECTOR_NAMES)
    for k in both:  # sums in another order may fall on the other side of a third digit
        np.testing.assert_allclose(both[k], each[k], atol=1.1e-3)


def test_cusum_and_bands_by_plain_loops(rows):
    df, pdf = rows
    path = {r.seq: r for r in D.cusum_path(df).collect()}
    bands = {(r.kpi, r.cell_id): r for r in D.detect_bollinger(df).collect()}
    timed = pdf.dropna(subset=["value", "ts"])
    named = 0
    for (kpi, cell), g in timed.groupby(["kpi", "cell_id"], dropna=False):
        g = g.sort_values(["ts", "seq"])
        v = g["value"].to_numpy()
        up = down = 0.0
        for s, z in zip(g["seq"], (v - v.mean()) / v.std()):
            up, down = max(0.0, up + z - 0.5), max(0.0, down - z - 0.5)
            np.testing.assert_allclose([path[s].s_pos, path[s].s_neg], [up, down], atol=1e-9)
            named += 1
        prior = pd.Series(v).shift(1).rolling(5, min_periods=3)
        sd = prior.std().clip(lower=0.5)
        high = kpi in ("Latency_ms", "PRB_Utilization_DL_%")
        dev = (v - (prior.mean() + 2 * sd)) if high else ((prior.mean() - 2 * sd) - v)
        found = bands.get((kpi, None if pd.isna(cell) else cell))
        if dev.max() > 0:
            at = int(dev.idxmax())
            assert found.seq == g["seq"].iloc[at] and found.severity == ("High" if dev[at] > sd[at] else "Medium")
        else:
            assert found is None
    assert named == len(path) == len(timed)


def test_rolling_band_counts():
    v = np.array([1.0, 2.0, 3.0, 4.0])
    count, mean, sd = S.lagged_band(v, np.array([9.0]), 3, 1)
    assert list(count) == [1, 2, 3, 3] and list(mean) == [9.0, 5.0, 4.0, 2.0]
    count, mean, sd = S.lagged_band(v, np.zeros(0), 2, 0)
    assert list(count) == [1, 2, 2, 2] and list(mean) == [1.0, 1.5, 2.5, 3.5] and sd[1] == pytest.approx(np.std([1, 2], ddof=1))
    assert (S.lagged_band(np.full(6, 0.1 + 0.2), np.zeros(0), 5, 1)[2] == 0).all()


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert D.detect_kpi(none).count() == 0 and D.cusum_path(none).count() == 0
    assert CD.detect_counters(none.select(F.col("kpi").alias("metric"), "cell_id", "ts", "seq", "value")).count() == 0
