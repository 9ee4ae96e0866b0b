"""Procedure-level detectors: rules, cascades, isolation forest, local density, robust distance, sequences."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from radiolake.catalogue import protocol as P
from radiolake.functions import ordered as O
from radiolake.functions.columns import rnd, row_of, severity_rank
from radiolake.operators.signalling import TIMEOUT, top_cause
from radiolake.session import cut_lineage

FEATURES = [
    "success_rate", "failure_rate", "attempt_share", "failure_count", "cause_diversity", "top_cause_concentration",
    "timeout_ratio", "has_any_failure",
]
COLUMNS = [
    "type", "severity", "score", "detector", "evidence", "procedure", "layer", "cell_id", "failure_causes",
    "recommendation",
]
PROC_DETECTOR_NAMES = [
    "Isolation Forest", "Statistical (threshold)", "Statistical (timeout rule)", "Statistical (cause concentration)",
    "Statistical (cascade rule)", "One-Class SVM", "LOF", "Elliptic Envelope", "LSTM Autoencoder",
]


def features(counters: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Feature columns per procedure; attempt share is within the scope (all rows by default)."""
    scope = list(scope)
    n = F.greatest("failure", F.lit(1)).cast("double")
    counts = F.map_values("failure_causes")
    total = F.greatest(F.sum("attempts"), F.lit(1)).alias("_total")
    if scope:
        joined = counters.join(counters.groupBy(*scope).agg(total), scope)
    else:
        joined = counters.withColumn("_total", counters.agg(total).scalar())
    return joined.withColumns(
        {
            "failure_rate": 100.0 - F.col("success_rate"),
            "attempt_share": F.col("attempts") / F.col("_total"),
            "failure_count": F.col("failure").cast("double"),
            "cause_diversity": F.size("failure_causes") / n,
            "top_cause_concentration": F.coalesce(F.array_max(counts), F.lit(0)) / n,
            "timeout_ratio": F.coalesce(F.try_element_at("failure_causes", F.lit(TIMEOUT)), F.lit(0)) / n,
            "has_any_failure": (F.col("failure") > 0).cast("double"),
        }
    ).drop("_total")


def recommendation(cause: Column, layer: Column) -> Column:
    out = F
    for name, text in P.CAUSE_ADVICE.items():
        out = out.when(cause == name, text)
    for name, text in P.LAYER_ADVICE.items():
        out = out.when(layer == name, text)
    return out.otherwise(P.PROC_DEFAULT_ADVICE)


def _emit(df: DataFrame, detector: str, severity: Column, score: Column, evidence: Column, cause: Column | None = None,
          extra: Sequence[str] = ()) -> DataFrame:
    cause = cause if cause is not None else top_cause(F.col("failure_causes"))
    cell = F.col("cell_id") if "cell_id" in df.columns else F.lit("—")
    return df.select(
        F.concat("procedure", F.lit(" anomaly")).alias("type"),
        severity.alias("severity"), rnd(score, 3).alias("score"), F.lit(detector).alias("detector"),
        evidence.alias("evidence"), "procedure", "layer", cell.alias("cell_id"), "failure_causes",
        recommendation(cause, F.col("layer")).alias("recommendation"), *extra,
    ).where(F.col("severity").isNotNull())


def _band(sr: Column, failure: Column) -> Column:
    return F.when(sr < 85, "High").when(sr < 95, "Medium").when((sr < 98) & (failure > 0), "Low")


def detect_rules(counters: DataFrame) -> DataFrame:
    """Success-rate bands; where they are silent any timeout, and a cause holding 80 % of failures."""
    sr, fail = F.col("success_rate"), F.col("failure")
    causes = F.col("failure_causes")
    timeouts = F.coalesce(F.try_element_at(causes, F.lit(TIMEOUT)), F.lit(0))
    top = F.coalesce(F.array_max(F.map_values(causes)), F.lit(0))
    lead = F.coalesce(top_cause(causes), F.lit("unknown"))
    text = F.format_string("success_rate=%.1f%% (%d/%d failures)", sr, fail, F.col("attempts"))
    band = _emit(counters, "Statistical (threshold)", _band(sr, fail), 1.0 - sr / 100.0, text, lead)
    quiet = counters.where(_band(sr, fail).isNull())
    late = quiet.where(timeouts > 0)
    late = _emit(late, "Statistical (timeout rule)", F.lit("Low"), timeouts / F.greatest(fail, F.lit(1)) * 0.5,
                 F.format_string("%d timeout failure(s) detected", timeouts), F.lit(TIMEOUT))
    same = quiet.where((fail >= 2) & (top / F.nullif(fail, F.lit(0)) >= 0.80))
    same = _emit(same, "Statistical (cause concentration)", F.lit("Low"), top / F.nullif(fail, F.lit(0)),
                 F.format_string("%d/%d failures share one cause", top, fail), lead)
    return band.unionByName(late).unionByName(same)


def detect_cascades(counters: DataFrame, scope: Sequence[str] = (), max_rate: float = 0.20) -> DataFrame:
    """Upstream procedures failing above 20 % while the downstream one is still attempted."""
    scope = list(scope)
    chain = F.broadcast(counters.sparkSession.createDataFrame(P.CASCADES, "procedure string, downstream string"))
    down = counters.where(F.col("attempts") > 0).select(*scope, F.col("procedure").alias("downstream"), F.col("attempts").alias("down_attempts"))
    rate = F.col("failure") / F.greatest("attempts", F.lit(1))
    up = counters.join(chain, "procedure").withColumn("rate", rate).where(F.col("rate") > max_rate)
    j = up.join(down, [*scope, "downstream"])
    cell = F.col("cell_id") if "cell_id" in j.columns else F.lit("—")
    return j.select(
        F.concat(F.lit("Cascading failure: "), "procedure", F.lit(" → "), "downstream").alias("type"),
        F.lit("Medium").alias("severity"), rnd("rate", 3).alias("score"),
        F.lit("Statistical (cascade rule)").alias("detector"),
        F.format_string("%s failure_rate=%.0f%% while %s still has %d attempts", F.col("procedure"), F.col("rate") * 100,
                        F.col("downstream"), F.col("down_attempts")).alias("evidence"),
        "procedure", "layer", cell.alias("cell_id"), "failure_causes",
        F.concat(F.lit("Investigate "), "procedure", F.lit(" failures first; downstream "), "downstream",
                 F.lit(" may inherit the root cause.")).alias("recommendation"),
    )


# ---------------------------------------------------------------- scores over feature rows

def _scaled(cols: Sequence[str], mean, dev) -> Column:
    return F.array(
        *[F.when(dev(c) > 1e-12, (F.col(c) - mean(c)) / F.nullif(dev(c), F.lit(0.0))).otherwise(0.0) for c in cols]
    )


def standardised(feats: DataFrame, cols: Sequence[str] = FEATURES) -> DataFrame:
    """Zero mean, unit population deviation over all rows; constant features become 0.  Adds ``x``."""
    stats = row_of(feats.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(f"_m_{c}") for c in cols],
        *[F.stddev_pop(c).alias(f"_s_{c}") for c in cols],
    ))
    x = _scaled(cols, lambda c: F.col(f"_st._m_{c}"), lambda c: F.col(f"_st._s_{c}"))
    j = feats.withColumn("_st", stats)
    return j.withColumns({"x": x, "scope_n": F.col("_st.n")}).drop("_st")


def scope_vectors(feats: DataFrame, scope: Sequence[str] = (), cols: Sequence[str] = FEATURES) -> DataFrame:
    """Scaled vectors ``x`` and the list ``_all`` of the scope's vectors.

    A scope (a capture, a cell, an hour) has one row per procedure name, so its
    window is bounded by the number of names whatever the number of messages;
    scopes spread over the cluster and everything below needs this one shuffle.
    """
    w = Window.partitionBy(*scope)
    x = _scaled(cols, lambda c: F.avg(c).over(w), lambda c: F.stddev_pop(c).over(w))
    z = feats.withColumns({"x": x, "scope_n": F.count(F.lit(1)).over(w)})
    return z.withColumn("_all", F.sort_array(F.collect_list(F.struct("procedure", "x")).over(w)))


def _severity(norm: Column) -> Column:
    return F.when(norm > 0.75, "High").when(norm > 0.5, "Medium").otherwise("Low")


def _flagged(j: DataFrame, raw: str, detector: str, name: str, scope: Sequence[str] = ()) -> DataFrame:
    """Rows above the cut, min-max scaled for severity (columns _cut, _lo, _hi given)."""
    j = j.where(F.col(raw) > F.col("_cut")).withColumn(
        "_norm", (F.col(raw) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-10)
    )
    text = F.format_string(f"success_rate=%.1f%%; failures=%d; {name}=%.4f", F.col("success_rate"), F.col("failure"), F.col(raw))
    extra = [raw, *[s for s in scope if s not in COLUMNS]]
    return _emit(j, detector, _severity(F.col("_norm")), F.col("_norm"), text, extra=extra)


def _flag_scope(scored: DataFrame, raw: str, scope: Sequence[str], share: float, detector: str, name: str) -> DataFrame:
    w = Window.partitionBy(*scope)
    j = scored.withColumns(
        {
            "_cut": F.percentile(raw, F.lit(1.0 - share)).over(w),
            "_lo": F.min(raw).over(w),
            "_hi": F.max(raw).over(w),
        }
    )
    return _flagged(j, raw, detector, name, scope)


def _flag_all(scored: DataFrame, raw: str, share: float, detector: str, name: str) -> DataFrame:
    """Cut over any number of rows: exact rank search, no gathering."""
    cut = O.exact_percentiles(scored, (), raw, [1.0 - share]).select("p0").scalar()
    ends = row_of(scored.agg(F.min(raw).alias("lo"), F.max(raw).alias("hi")))
    j = scored.withColumns({"_cut": cut, "_ends": ends})
    return _flagged(j.withColumns({"_lo": F.col("_ends.lo"), "_hi": F.col("_ends.hi")}), raw, detector, name)


def _sqdist(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, d: s + d)


def local_outlier_factor(feats: DataFrame, scope: Sequence[str] = (), k: int = 5) -> DataFrame:
    """Ratio of the neighbours' local density to the own one, per procedure within its scope.

    Distances are kept to nine digits so that equal ones tie and fall back to the name.
    """
    w = Window.partitionBy(*scope)
    z = scope_vectors(feats, scope).where(F.col("scope_n") >= 4)
    others = F.filter("_all", lambda p: p["procedure"] != F.col("procedure"))
    dists = F.array_sort(
        F.transform(others, lambda p: F.struct(rnd(F.sqrt(_sqdist(F.col("x"), p["x"])), 9).alias("d"), p["procedure"].alias("q")))
    )
    kk = F.least(F.lit(k), F.col("scope_n").cast("int") - 1)
    z = z.withColumn("_nn", F.slice(dists, F.lit(1), kk)).withColumn("_kd", F.element_at("_nn", -1)["d"])
    as_map = lambda c: F.map_from_entries(F.collect_list(F.struct("procedure", c)).over(w))
    mean = lambda f: F.aggregate("_nn", F.lit(0.0), lambda s, n: s + f(n)) / F.size("_nn")
    z = z.withColumn("_kds", as_map("_kd"))
    z = z.withColumn("_lrd", 1.0 / (mean(lambda n: F.greatest(n["d"], F.element_at("_kds", n["q"]))) + 1e-10))
    z = z.withColumn("_lrds", as_map("_lrd"))
    z = z.withColumn("lof", mean(lambda n: F.element_at("_lrds", n["q"])) / F.col("_lrd"))
    return z.drop("_all", "_nn", "_kd", "_kds", "_lrd", "_lrds", "x", "scope_n")


def detect_lof(feats: DataFrame, scope: Sequence[str] = (), k: int = 5, contamination: float = 0.15) -> DataFrame:
    return _flag_scope(local_outlier_factor(feats, scope, k), "lof", scope, contamination, "LOF", "LOF")


def kernel_isolation(feats: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """One minus the mean RBF similarity to all procedures of the scope (gamma from the feature variance)."""
    z = scope_vectors(feats, scope).where(F.col("scope_n") >= 3)
    gamma = 1.0 / len(FEATURES)  # scaled features have unit variance
    total = F.aggregate("_all", F.lit(0.0), lambda s, p: s + F.exp(-gamma * _sqdist(F.col("x"), p["x"])))
    return z.withColumn("isolation", 1.0 - total / F.col("scope_n")).drop("_all", "x", "scope_n")


def detect_kernel(feats: DataFrame, scope: Sequence[str] = (), nu: float = 0.15) -> DataFrame:
    return _flag_scope(kernel_isolation(feats, scope), "isolation", scope, nu, "One-Class SVM", "isolation")


def robust_distance(feats: DataFrame, steps: int = 3, cols: Sequence[str] = FEATURES) -> DataFrame:
    """Squared Mahalanobis distance to a robust centre.

    Each step is one aggregation (means and cross products of 8 features: 44
    numbers reach the driver) and one exact rank cut keeping the closest rows.
    """
    p = len(cols)
    z = standardised(feats, cols)
    z = cut_lineage(z.select("*", *[F.get("x", F.lit(i)).alias(f"_z{i}") for i in range(p)]), "envelope")
    kept, share = z, 1.0
    for step in range(steps):
        moments = kept.agg(
            F.count(F.lit(1)).alias("n"),
            *[F.avg(f"_z{i}").alias(f"m{i}") for i in range(p)],
            *[F.covar_pop(f"_z{i}", f"_z{j}").alias(f"c{i}_{j}") for i in range(p) for j in range(i, p)],
        ).first()
        if not moments or moments["n"] < p + 2:
            return feats.withColumn("mahalanobis2", F.lit(None).cast("double")).where(F.lit(False))
        mu = [moments[f"m{i}"] for i in range(p)]
        cov = np.array([[moments[f"c{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
        inv = np.linalg.pinv(cov, rcond=1e-9, hermitian=True)
        d = [F.col(f"_z{i}") - float(mu[i]) for i in range(p)]
        terms = [float(inv[i, j] * (1 if i == j else 2)) * d[i] * d[j] for i in range(p) for j in range(i, p)]
        z = z.withColumn("mahalanobis2", reduce(lambda a, b: a + b, terms))
        if step < steps - 1:
            if step == 0:
                share = (moments["n"] + p + 1) / 2 / moments["n"]
            cut = O.exact_percentiles(z, (), "mahalanobis2", [min(share, 1.0)]).select("p0").scalar()
            kept = z.where(F.col("mahalanobis2") <= cut)
    return z.drop(*[f"_z{i}" for i in range(p)], "x", "scope_n")


def detect_envelope(feats: DataFrame, contamination: float = 0.10, steps: int = 3) -> DataFrame:
    return _flag_all(robust_distance(feats, steps), "mahalanobis2", contamination, "Elliptic Envelope", "Mahalanobis2")


# ---------------------------------------------------------------- isolation forest

def _path_norm(n) -> np.ndarray:
    """Expected path length of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=float)
    out = np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), 0.0)
    return np.where(n == 2, 1.0, out)


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """One random tree as (node, feature, split, left, right, depth + leaf correction) rows."""
    nodes: list[tuple] = []
    todo = [(0, x, 0)]
    fresh = 1
    while todo:
        node, rows, depth = todo.pop()
        spread = rows.max(axis=0) - rows.min(axis=0) if len(rows) else np.zeros(x.shape[1])
        usable = np.flatnonzero(spread > 0)
        if depth >= limit or len(rows) <= 1 or not len(usable):
            nodes.append((node, -1, 0.0, -1, -1, float(depth + _path_norm(len(rows)))))
            continue
        f = int(rng.choice(usable))
        cut = float(rng.uniform(rows[:, f].min(), rows[:, f].max()))
        left = rows[:, f] <= cut
        nodes.append((node, f, cut, fresh, fresh + 1, 0.0))
        todo += [(fresh, rows[left], depth + 1), (fresh + 1, rows[~left], depth + 1)]
        fresh += 2
    return nodes


NODE_SCHEMA = "tree int, node int, feature int, cut double, left int, right int, path double"
TREE_ROWS = 256


def fit_forest(z: DataFrame, key: Column, trees: int = 200, seed: int = 42) -> DataFrame:
    """Trees grown in parallel, one group per tree of at most 256 rows.

    A pool of at most trees * 256 rows is drawn by the order of a hash of key and features, so rows that
    share a key enter independently and another partitioning gives the same forest; pool row i goes to the trees whose stretch of the (circular) pool covers it.
    """
    pool_size = trees * TREE_ROWS
    pool = z.select("x", F.xxhash64(key, F.lit(seed), "x").alias("_h")).orderBy("_h").limit(pool_size)
    numbered = pool.select("x", "_h", (F.row_number().over(Window.orderBy("_h")) - 1).alias("_i"), F.count(F.lit(1)).over(Window.partitionBy()).alias("_m"))
    all_trees = F.sequence(F.lit(0), F.lit(trees - 1))
    take = F.least(F.lit(TREE_ROWS), F.col("_m"))
    mine = F.filter(all_trees, lambda t: F.pmod(F.col("_i") - t * take, F.col("_m")) < take)
    sample = numbered.select("x", F.col("_i"), F.explode(mine).alias("tree"))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        tree = int(pdf["tree"].iloc[0])
        x = np.array(pdf["x"].tolist(), dtype=float)
        limit = int(np.ceil(np.log2(max(len(x), 2))))
        rows = _grow(x, np.random.default_rng(seed + tree), limit)
        return pd.DataFrame([(tree, *r) for r in rows], columns=["tree", "node", "feature", "cut", "left", "right", "path"])

    return sample.groupBy("tree").applyInPandas(grow, NODE_SCHEMA)


def forest_scores(z: DataFrame, forest: DataFrame, trees: int = 200) -> DataFrame:
    """Anomaly score 2^(-mean path / norm).

    The fitted forest (at most trees * 511 nodes) is the broadcast model; rows
    stream through it in Arrow batches.
    """
    nodes = forest.toPandas()
    if len(nodes) > trees * (2 * TREE_ROWS):
        raise ValueError("forest larger than its bound")
    model = []
    for _, t in nodes.sort_values(["tree", "node"]).groupby("tree"):
        model.append({c: t[c].to_numpy() for c in ("feature", "cut", "left", "right", "path")})
    shared = z.sparkSession.sparkContext.broadcast(model)
    size = z.agg(F.least(F.count(F.lit(1)), F.lit(TREE_ROWS))).first()[0]
    norm = float(_path_norm(size)) or 1.0

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        rows = np.array(x.tolist(), dtype=float)
        total = np.zeros(len(rows))
        for t in shared.value:
            at = np.zeros(len(rows), dtype=int)
            while True:
                f = t["feature"][at]
                moving = f >= 0
                if not moving.any():
                    break
                v = rows[np.arange(len(rows)), np.maximum(f, 0)]
                nxt = np.where(v <= t["cut"][at], t["left"][at], t["right"][at])
                at = np.where(moving, nxt, at)
            total += t["path"][at]
        return pd.Series(np.power(2.0, -(total / max(len(shared.value), 1)) / norm))

    return z.withColumn("forest_score", score("x"))


def detect_forest(feats: DataFrame, key: Sequence[str] = ("procedure",), contamination: float = 0.15, trees: int = 200,
                  seed: int = 42) -> DataFrame:
    """Isolation forest over all feature rows; needs three rows."""
    z = cut_lineage(standardised(feats).where(F.col("scope_n") >= 3), "forest-rows")
    forest = fit_forest(z, F.concat_ws("|", *key), trees, seed)
    scored = cut_lineage(forest_scores(z, forest, trees).drop("x", "scope_n"), "forest-scores")
    return _flag_all(scored, "forest_score", contamination, "Isolation Forest", "forest_score")


# ---------------------------------------------------------------- sequences

# Numeric ids of layers and roles.
LAYER_IDS = {"NAS": 0, "NGAP": 1, "RRC": 2, "F1AP": 3, "E1AP": 4, "XnAP": 5}
ROLE_IDS = {
    "request": 0, "command": 0, "response": 1, "accept": 1, "complete": 1, "result": 1, "reject": 2, "failure": 2,
    "timeout": 3,
}
WINDOW = 10


def _ids(col: Column, table: dict[str, int]) -> Column:
    out = F
    for k, v in table.items():
        out = out.when(col == k, v)
    return out.otherwise(0)


def encode_sequence(log: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per message: layer, procedure, role and capped time step, each scaled to [0, 1].

    Procedure ids follow first appearance; the id table has one row per name.
    """
    keys = list(keys)
    order = ["ts", "seq"]
    first = log.groupBy("procedure").agg(F.min(F.struct(*order)).alias("_at"))
    vocab = first.select(
        "procedure",
        (F.row_number().over(Window.orderBy("_at", "procedure")) - 1).alias("_pid"),
        F.count(F.lit(1)).over(Window.partitionBy()).alias("_np"),
    )
    rows = O.neighbours(O.sliced(log, keys, order), keys, order, prev={"_before": "ts"})
    gap = (F.unix_micros("ts") - F.unix_micros(F.coalesce("_before", "ts"))) / 1e6
    return rows.join(F.broadcast(vocab), "procedure").withColumns(
        {
            "f_layer": _ids(F.col("layer"), LAYER_IDS) / 5.0,
            "f_proc": F.col("_pid") / F.col("_np"),
            "f_role": _ids(F.col("role"), ROLE_IDS) / 3.0,
            "f_dt": F.least(gap, F.lit(60.0)) / 60.0,
        }
    ).drop("_before", "_pid", "_np")


def sequence_windows(log: DataFrame, keys: Sequence[str] = (), window: int = WINDOW, block: int = O.BLOCK) -> DataFrame:
    """Sliding windows of encoded messages ending at each message, oldest first."""
    keys = list(keys)
    enc = O.ordinal(encode_sequence(log, keys), keys, ["ts", "seq"])
    rows, w, own = O.blocked(enc, keys, before=window - 1, block=block)
    frame = w.rowsBetween(-(window - 1), 0)
    vec = F.array("f_layer", "f_proc", "f_role", "f_dt")
    return (
        rows.withColumn("window", F.collect_list(vec).over(frame))
        .where(own & (F.col("rn") >= window))
        .withColumns({"start_idx": F.col("rn") - window, "end_idx": F.col("rn")})
        .drop("_block", O.SLICE)
    )


def transition_surprise(rows: DataFrame, keys: Sequence[str], token: Column, order: Sequence[str], window: int = WINDOW,
                        block: int = O.BLOCK) -> DataFrame:
    """Mean surprise (-log p of each transition) over the last ``window`` transitions.

    Transition counts are a (state, state) table, tiny beside the log.
    """
    keys = list(keys)
    steps = O.neighbours(O.sliced(rows.withColumn("_tok", token), keys, order), keys, order, prev={"_prev": "_tok"})
    known = steps.where(F.col("_prev").isNotNull())
    pairs = known.groupBy("_prev", "_tok").agg(F.count(F.lit(1)).alias("_c"))
    froms = pairs.groupBy("_prev").agg(F.sum("_c").alias("_t"))
    table = pairs.join(froms, "_prev").select("_prev", "_tok", (-F.log(F.col("_c") / F.col("_t"))).alias("surprise"))
    table = cut_lineage(table, "transitions")  # of known size: the log is not shuffled on its hottest pairs
    scored = O.ordinal(known.join(table, ["_prev", "_tok"]), keys, order)
    spread, w, own = O.blocked(scored, keys, before=window - 1, block=block)
    mean = F.avg("surprise").over(w.rowsBetween(-(window - 1), 0))
    return spread.withColumn("error", mean).where(own & (F.col("rn") >= window)).drop("_block", O.SLICE, "_prev")


def detect_sequences(scored: DataFrame, z_score: float = 2.0, min_windows: int = 5) -> DataFrame:
    """Windows whose error exceeds mean + z * population deviation of all windows."""
    cut = row_of(scored.agg(
        (F.avg("error") + z_score * F.stddev_pop("error")).alias("threshold"), F.count(F.lit(1)).alias("windows")
    ))
    j = scored.withColumn("_cut", cut).withColumns({"threshold": F.col("_cut.threshold"), "windows": F.col("_cut.windows")})
    j = j.drop("_cut").where((F.col("windows") >= min_windows) & (F.col("error") > F.col("threshold")))
    ratio = rnd(F.col("error") / (F.col("threshold") + 1e-10), 3)
    return j.withColumns(
        {
            "ratio": ratio,
            "severity": F.when(ratio > 2.0, "High").when(ratio > 1.5, "Medium").otherwise("Low"),
            "score": F.least(ratio, F.lit(1.0)),
            "detector": F.lit("LSTM Autoencoder"),
        }
    ).drop("windows")


def sequence_anomalies(flagged: DataFrame, counters: DataFrame) -> DataFrame:
    """Flagged windows in the common procedure-anomaly shape."""
    info = counters.groupBy("procedure").agg(F.max_by("failure_causes", "attempts").alias("failure_causes"))  # one row a procedure, however many cells
    j = flagged.join(info, "procedure", "left")
    default = "Review message sequence in context; check for unexpected procedure order."
    rec = F
    for name, text in P.LAYER_ADVICE.items():
        rec = rec.when(F.col("layer") == name, text)
    return j.select(
        F.concat(F.lit("Anomalous message sequence near "), "procedure").alias("type"), "severity", "score", "detector",
        F.format_string("window error=%.5f > threshold=%.5f", F.col("error"), F.col("threshold")).alias("evidence"),
        "procedure", "layer", "cell_id", "failure_causes", rec.otherwise(default).alias("recommendation"),
    )


# ---------------------------------------------------------------- merge

def merge(anomalies: DataFrame, detector_order: Sequence[str] = PROC_DETECTOR_NAMES, scope: Sequence[str] = ()) -> DataFrame:
    """One row per (procedure, type), and per ``scope`` such as a cell or hour: the most severe finding, the first on ties, and who agreed.

    Each detector is reduced to one row first, so the name list is bounded.
    """
    place = F.array_position(F.array(*[F.lit(d) for d in detector_order]), F.col("detector"))
    rank = severity_rank()
    keep = [c for c in ("severity", "score", "evidence", "layer", "cell_id", "failure_causes", "recommendation") if c not in scope]
    row = F.struct(*keep)
    per = anomalies.withColumns({"_place": place, "_rank": rank}).groupBy(*scope, "procedure", "type", "detector", "_place").agg(
        F.max_by(row, F.struct("_rank", "score")).alias("r"), F.max("_rank").alias("_rank")
    )
    best = per.groupBy(*scope, "procedure", "type").agg(
        F.max_by("r", F.struct("_rank", -F.col("_place"))).alias("r"),
        F.sort_array(F.collect_list(F.struct("_place", "detector"))).alias("d"),
    )
    names = F.transform("d", lambda e: e["detector"])
    out = best.select(*scope, "procedure", "type", "r.*", names.alias("detectors"))
    return out.withColumns(
        {"detector": F.array_join("detectors", " + "), "confirmed_by": F.size("detectors")}
    ).orderBy(severity_rank().desc(), F.col("score").desc())
