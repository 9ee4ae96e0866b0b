"""The time-sliced building blocks against plain computation, with a hot key and tiny slices."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from radiolake.functions import ordered as O

KEYS, ORDER = ["k"], ["ts", "seq"]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    n = 3000
    k = np.where(rng.random(n) < 0.4, "hot", rng.choice(list("abcdefgh"), n))
    t = rng.integers(0, 20_000, n)
    v = np.round(rng.gamma(2, 10, n), 2)
    v = np.where(rng.random(n) < 0.1, np.nan, v)
    pdf = pd.DataFrame({"k": k, "t": t, "seq": np.arange(n), "v": v})
    return pdf.sort_values(["k", "t", "seq"]).reset_index(drop=True)


@pytest.fixture(scope="module")
def df(spark, data):
    rows = [(r.k, int(r.t), int(r.seq), None if np.isnan(r.v) else float(r.v)) for r in data.itertuples()]
    out = spark.createDataFrame(rows, "k string, t bigint, seq bigint, v double").withColumn("ts", F.timestamp_seconds("t"))
    return O.sliced(out, KEYS, ORDER, rows=64).cache()


def col(frame, name):
    return frame.select("seq", name).toPandas().set_index("seq")[name].sort_index()


def test_ordinal(df, data):
    out = O.ordinal(df, KEYS, ORDER)
    want = (data.groupby("k").cumcount() + 1).set_axis(data["seq"]).sort_index()
    assert (col(out, "rn") == want).all()
    total = data.groupby("k")["seq"].transform("size").set_axis(data["seq"]).sort_index()
    assert (col(out, "n") == total).all()


def test_neighbours(df, data):
    out = O.neighbours(df, KEYS, ORDER, prev={"p": "seq"}, nxt={"q": "seq"}, number=True)
    g = data.groupby("k")["seq"]
    for name, want in (("p", g.shift(1)), ("q", g.shift(-1)), ("rn", data.groupby("k").cumcount() + 1)):
        pd.testing.assert_series_equal(
            col(out, name).astype(float), want.set_axis(data["seq"]).sort_index().astype(float), check_names=False
        )


@pytest.mark.parametrize("how", ["sum", "min", "max", "last"])
def test_running(df, data, how):
    out = O.running(df, KEYS, ORDER, {"r": (how, F.col("v"))})
    g = data.groupby("k")["v"]
    want = {
        "sum": lambda: data["v"].fillna(0).groupby(data["k"]).cumsum(),
        "min": lambda: g.cummin().groupby(data["k"]).ffill(),
        "max": lambda: g.cummax().groupby(data["k"]).ffill(),
        "last": lambda: g.ffill(),
    }[how]()
    got = col(out, "r").astype(float)
    np.testing.assert_allclose(got.to_numpy(), want.set_axis(data["seq"]).sort_index().to_numpy(), rtol=1e-12)


def test_running_reverse(df, data):
    out = O.running(df, KEYS, ORDER, {"r": ("min", F.col("v"))}, reverse=True)
    rev = data.iloc[::-1]
    want = rev.groupby("k")["v"].cummin().groupby(rev["k"]).ffill().set_axis(rev["seq"]).sort_index()
    np.testing.assert_allclose(col(out, "r").astype(float).to_numpy(), want.to_numpy())


def test_blocks_give_exact_frames(df, data):
    rows = O.ordinal(df, KEYS, ORDER)
    spread, w, own = O.blocked(rows, KEYS, before=4, after=2, block=7)
    out = spread.select(
        "*", F.sum("seq").over(w.rowsBetween(-4, 0)).alias("back"), F.sum("seq").over(w.rowsBetween(1, 2)).alias("fwd")
    ).where(own)
    assert out.count() == len(data)
    back = data.groupby("k")["seq"].transform(lambda s: s.rolling(5, min_periods=1).sum())
    fwd = data.groupby("k")["seq"].transform(lambda s: s.shift(-1).fillna(0) + s.shift(-2).fillna(0))
    assert (col(out, "back") == back.set_axis(data["seq"]).sort_index()).all()
    assert (col(out, "fwd").fillna(0) == fwd.set_axis(data["seq"]).sort_index()).all()


def test_block_must_hold_frame(df):
    with pytest.raises(ValueError):
        O.blocked(df, KEYS, before=10, block=5)


def test_exact_percentiles(df, data):
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = O.exact_percentiles(df, KEYS, "v", probs).toPandas().set_index("k").sort_index()
    want = data.groupby("k")["v"].quantile(probs).unstack()
    np.testing.assert_allclose(got[[f"p{i}" for i in range(6)]].to_numpy(), want.to_numpy(), rtol=1e-12)


def test_percentiles_of_one_repeated_value(spark):
    one = spark.range(1000).select(F.lit("a").alias("k"), F.lit(5.0).alias("v"))
    row = O.exact_percentiles(one, KEYS, "v", [0.25, 0.75]).first()
    assert (row["n"], row["p0"], row["p1"]) == (1000, 5.0, 5.0)


ODD_VALUES = [0.0, -0.0, 1.0, -1.0, 1e300, -1e300, 5e-324, -5e-324, 2.2250738585072014e-308, 1.0000000000000002, 0.9999999999999999, -7.25, 3.0, 3.0, 3.0]


@pytest.mark.parametrize("copies", [1, 3])
def test_percentiles_of_extreme_values(spark, copies):
    """Neighbouring doubles, both zeros, subnormals and huge numbers, each as a wanted rank."""
    values = ODD_VALUES * copies
    probs = [i / (len(values) - 1) for i in range(len(values))]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = O.exact_percentiles(df, [], "v", probs).first()
    np.testing.assert_allclose([got[f"p{i}"] for i in range(len(values))], np.quantile(values, probs), rtol=1e-12)
    assert got.n == len(values)


def test_order_bits_keep_the_order(spark):
    df = spark.createDataFrame([(v,) for v in ODD_VALUES + [float("inf"), float("-inf")]], "v double")
    rows = df.select("v", O.order_bits("v").alias("b")).select("v", "b", O.of_order_bits("b").alias("back")).collect()
    assert all(r.v == r.back for r in rows)
    assert all((x.v < y.v) == (x.b < y.b) for x in rows for y in rows)


def test_percentile_plan_orders_no_values(df):
    """Windows see digit counts only: their input is an aggregate."""
    plan = O.exact_percentiles(df, KEYS, "v", [0.5])._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line]
    assert windows and all("_next" in line or "AS n#" in line for line in windows)


def test_moments(df, data):
    out = O.series_moments(df, KEYS, "v").select(f"{O.KEY}.k", "_n", "_mu", "_sigma").distinct()
    got = out.groupBy("k").agg(F.max("_n"), F.avg("_mu"), F.avg("_sigma")).toPandas().set_index("k").sort_index().to_numpy()
    g = data.groupby("k")["v"]
    want = pd.DataFrame({"n": g.count(), "mu": g.mean(), "sd": g.std(ddof=0)}).sort_index().to_numpy()
    np.testing.assert_allclose(got.astype(float), want.astype(float), rtol=1e-10)


def test_rows_without_time_are_kept(spark):
    d = spark.sql("select 'a' k, cast(null as timestamp) ts, 1L seq union all select 'a', timestamp'2024-01-01', 2L")
    out = O.numbered(d, KEYS, ORDER)
    assert [r["rn"] for r in out.orderBy("seq").collect()] == [1, 2]


def test_numbers_by_dealing(df, data):
    out = O.numbered(df.drop(O.SLICE), KEYS, ORDER)
    want = (data.groupby("k").cumcount() + 1).set_axis(data["seq"]).sort_index()
    assert (col(out, "rn") == want).all()
    total = data.groupby("k")["seq"].transform("size").set_axis(data["seq"]).sort_index()
    assert (col(out, "n") == total).all()


def test_slices_follow_the_rows_not_the_clock(spark):
    """Nine rows in ten are of one key and one day, some without a time: no slice holds more than its bound."""
    hot = F.col("id") % 10 != 0
    rows = spark.range(20_000).select(
        F.when(hot, "hot").when(F.col("id") % 20 == 0, F.lit(None)).otherwise("cold").alias("k"), "id",
        F.when(F.col("id") % 7 != 0, F.timestamp_seconds(F.lit(1_700_000_000) + F.when(hot, F.col("id") % 86_400).otherwise(F.col("id") * 86_400))).alias("ts"),
    )
    out = O.sliced(rows, ["k"], ["ts", "id"], rows=256)
    assert out.count() == 20_000
    assert out.groupBy("k", O.SLICE).count().agg(F.max("count")).first()[0] <= 256
    edges = out.groupBy("k", O.SLICE).agg(F.min(F.struct("ts", "id")).alias("a"), F.max(F.struct("ts", "id")).alias("b")).collect()
    for key in ("hot", "cold", None):
        spans = sorted((r._slice, r.a, r.b) for r in edges if r.k == key)
        assert all(x[2] < y[1] for x, y in zip(spans, spans[1:]) if x[2].ts is not None and y[1].ts is not None)
    with pytest.raises(ValueError):
        O.sliced(rows, ["k"], ["ts"], rows=100)


def test_hot_key_is_spread(df):
    """The busiest (key, slice) group holds a small part of the hot key."""
    sizes = df.groupBy("k", O.SLICE).count().agg(F.max("count")).first()[0]
    assert sizes < df.where("k = 'hot'").count() / 10


# ------------------------------------------------------------ rows without a key, time or number

def odd_rows(spark):
    rows = [(None, 1, 1.0), (None, 2, 3.0), ("a", 3, 5.0), ("a", None, 7.0), ("b", None, None)]
    return O.sliced(spark.createDataFrame(rows, "cell string, seq bigint, v double"), ["cell"], ["seq"], rows=1)


def test_null_keys_and_numbers_keep_their_rows(spark):
    df = odd_rows(spark)
    numbered = O.ordinal(df, ["cell"], ["seq"]).collect()
    assert sorted((r.cell or "", r.rn, r.n) for r in numbered) == [("", 1, 2), ("", 2, 2), ("a", 1, 2), ("a", 2, 2), ("b", 1, 1)]
    total = O.running(df, ["cell"], ["seq"], {"s": ("sum", F.col("v"))}).collect()
    assert sorted((r.cell or "", r.s) for r in total) == [("", 1.0), ("", 4.0), ("a", 7.0), ("a", 12.0), ("b", 0.0)]
    near = O.neighbours(df, ["cell"], ["seq"], prev={"before": "v"}).collect()
    assert sorted((r.cell or "", r.before or 0.0) for r in near) == [("", 0.0), ("", 1.0), ("a", 0.0), ("a", 7.0), ("b", 0.0)]


def test_percentiles_of_the_null_group(spark):
    out = O.exact_percentiles(odd_rows(spark), ["cell"], "v", [0.5]).collect()
    assert {r.cell: (r.n, r.p0) for r in out} == {None: (2, 2.0), "a": (2, 6.0)}
    assert [r.p0 for r in O.exact_percentiles(odd_rows(spark), [], "v", [0.5]).collect()] == [4.0]
