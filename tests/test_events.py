"""Event log, correlation, root cause, signalling, evaluation and feedback on small cases."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from radiolake.operators import evaluate as EV
from radiolake.operators import events as E
from radiolake.operators import feedback as B
from radiolake.operators import procedure_detectors as PD
from radiolake.operators import rootcause as RC
from radiolake.operators import signalling as S

T0 = dt.datetime(2026, 1, 1, 12)
A = "source string, seq bigint, ts timestamp, cell_id string, severity string, score double, type string, label string, category string, procedure string, layer string, value double, evidence string, detector string"


def anomaly(seq, source="kpi", minutes=0, cell="PCI_1", severity="High", **kw):
    base = dict(source=source, seq=seq, ts=None if minutes is None else T0 + dt.timedelta(minutes=minutes), cell_id=cell, severity=severity,
                score=1.0, type=None, label=None, category=None, procedure=None, layer=None, value=float(seq), evidence=f"e{seq}", detector="d")
    base.update(kw)
    return tuple(base[c.split()[0]] for c in A.split(", "))


def events(spark, rows):
    return E.correlate(E.event_log([E.to_events(spark.createDataFrame(rows, A))]))


@pytest.mark.parametrize("sources, confidence", [(["kpi"], 0.0), (["kpi", "stats"], 0.67), (["kpi", "stats", "pcap"], 1.0)])
def test_confidence(spark, sources, confidence):
    rows = events(spark, [anomaly(i, s) for i, s in enumerate(sources)]).collect()
    assert {r["correlation_confidence"] for r in rows} == {confidence}
    assert all(set(r["correlated_sources"]) == (set(sources) - {r["source"]} if len(sources) > 1 else set()) for r in rows)


@pytest.mark.parametrize("minutes, linked", [(59, True), (60, True), (61, False)])
def test_window_edges(spark, minutes, linked):
    rows = events(spark, [anomaly(0, "kpi", 0), anomaly(1, "stats", minutes)]).collect()
    assert all((len(r["correlated_sources"]) == 1) == linked for r in rows)


def test_missing_time_matches_any(spark):
    rows = events(spark, [anomaly(0, "kpi", 0), anomaly(1, "stats", None), anomaly(2, "kpi", 60 * 24 * 30)]).collect()
    assert all(len(r["correlated_sources"]) == 1 for r in rows)


def test_correlation_equals_brute_force(spark):
    rng = np.random.default_rng(11)
    rows = [
        anomaly(i, str(rng.choice(["kpi", "stats", "pcap"])), None if rng.random() < 0.02 else int(rng.integers(0, 6000)),
                "PCI_hot" if rng.random() < 0.4 else f"PCI_{rng.integers(0, 5)}")
        for i in range(400)
    ]
    ev = E.event_log([E.to_events(spark.createDataFrame(rows, A))])
    got = {r["seq"]: set(r["correlated_sources"]) for r in E.correlate(ev, rows=2).collect()}
    raw = [(r[1], r[0], r[2], r[3]) for r in rows]
    for seq, src, ts, cell in raw:
        near = {s for _, s, t, c in raw if c == cell and (t is None or ts is None or abs((t - ts).total_seconds()) <= 3600)}
        assert got[seq] == (near - {src} if len(near) > 1 else set())


def test_same_content_kept_once_whatever_the_time(spark):
    rows = [anomaly(5, minutes=0, value=1.0, evidence="x"), anomaly(2, minutes=300, value=1.0, evidence="x"), anomaly(3, value=2.0, evidence="x")]
    log = E.event_log([E.to_events(spark.createDataFrame(rows, A))])
    assert sorted(r["seq"] for r in log.collect()) == [2, 3]


def test_cellless_events_share_a_procedure_bucket(spark):
    rows = [anomaly(0, "pcap", None, "—", type="NAS_Registration anomaly"), anomaly(1, "pcap", None, "—", type="RRC_Setup anomaly"), anomaly(2, "pcap", None, None, type="Something odd here and long")]
    log = E.event_log([E.to_events(spark.createDataFrame(rows, A))]).withColumn("k", E.correlation_key())
    assert {r["seq"]: r["k"] for r in log.collect()} == {0: "proc::nas", 1: "proc::rrc", 2: "proc::something odd here a"}


def test_priority_and_filters(spark):
    rows = [anomaly(0, severity="Low"), anomaly(1, severity="Critical"), anomaly(2, severity="High", score=5.0), anomaly(3, severity="High", score=9.0)]
    ev = events(spark, rows)
    assert [r["seq"] for r in E.prioritised(ev).collect()] == [1, 3, 2, 0]
    assert [r["seq"] for r in E.prioritised(ev, min_severity="High").collect()] == [1, 3, 2]
    assert E.prioritised(ev, source="pcap").count() == 0


def test_empty_log(spark):
    ev = events(spark, [])
    row = E.summary(ev).first()
    assert row["total"] == 0 and row["correlated"] == 0
    assert RC.root_causes(ev).count() == 0


def test_related_pairs_equal_counts(spark):
    rng = np.random.default_rng(2)
    rows = [anomaly(i, "kpi", None if i % 17 == 0 else int(rng.integers(0, 600)), f"PCI_{rng.integers(0, 3)}") for i in range(120)]
    ev = E.event_log([E.to_events(spark.createDataFrame(rows, A))])
    pairs = E.related_events(ev, ev).groupBy("focus_id").count()
    counts = E.related_counts(ev).select("event_id", "related")
    j = counts.join(pairs, counts["event_id"] == pairs["focus_id"], "left").where(F.coalesce("count", F.lit(0)) != F.col("related"))
    assert j.count() == 0


def test_lowest_layer_is_root_and_roles(spark):
    rows = [
        anomaly(0, "kpi", 0, label="Handover Success", category="Mobility"),
        anomaly(1, "stats", 10, label="dl_bler", category="DL Block Error Rate"),
        anomaly(2, "pcap", 20, type="NGAP_NGSetup anomaly", procedure="NGAP_NGSetup", layer="NGAP"),
    ]
    ev = events(spark, rows)
    root = RC.root_causes(ev).first()
    assert root["root_seq"] == 1 and root["rule"] == "L1_radio_degradation" and root["confidence"] == 0.88 and root["n_events"] == 3
    chain = {r["seq"]: (r["position"], r["role"]) for r in RC.causal_chain(ev).collect()}
    assert chain == {0: (1, "symptom"), 1: (2, "contributing_factor"), 2: (3, "symptom")}


def test_failure_causes_reach_the_rules(spark):
    df = spark.createDataFrame([("pcap", "X_Y anomaly", "X_Y", "?", {"congestion": 3})], "source string, type string, procedure string, layer string, failure_causes map<string,bigint>")
    ev = E.event_log([E.to_events(df)])
    assert "NGAP_overload" in RC.matched_rules(ev).first()["rules"]


# ------------------------------------------------------------ signalling

M = "ts timestamp, seq bigint, layer string, procedure string, role string, ue_id string, cause string"


def messages(spark, roles, ue="1"):
    return spark.createDataFrame([(T0 + dt.timedelta(hours=9 * i), i, "NAS", "NAS_Registration", r, ue, None) for i, r in enumerate(roles)], M)


def test_pairing_case(spark):
    roles = ["request", "request", "accept", "accept", "request", "reject", "request"]
    p = S.pair(messages(spark, roles))
    assert [r["outcome"] for r in p.orderBy("seq").collect()] == ["superseded", "answered", "success", "orphan", "answered", "failure", "timeout"]
    c = S.procedure_counters(p).first()
    assert (c["attempts"], c["success"], c["failure"], c["success_rate"]) == (4, 1, 2, 25.0)
    assert c["failure_causes"] == {"unknown": 1, "timeout": 1} and c["cell_id"] == "—"
    assert [r["role"] for r in S.message_log(p).orderBy("seen_ts", "role").collect()].count("timeout") == 1


def test_payload_cases(spark):
    hexes = ["7E0041" "00000001", "7E0042" "00000001", "7E0044" "00000002" "16", "3A0100" "00000003", "3A01000000", "3A0102" "00000003" "00", "7E00FF" "00000001", "2B9901" "FFFFFFFF", "1A0102" "00000007" "7F"]
    df = spark.createDataFrame([(i, bytearray.fromhex(h)) for i, h in enumerate(hexes)], "seq bigint, payload binary")
    rows = {r["seq"]: (r["procedure"], r["role"], r["ue_id"], r["cause"]) for r in S.name_codes(S.decode(df)).collect()}
    assert rows == {
        0: ("NAS_Registration", "request", "1", None), 1: ("NAS_Registration", "accept", "1", None),
        2: ("NAS_Registration", "reject", "2", "congestion"), 3: ("NGAP_InitialContextSetup", "request", "3", None),
        5: ("NGAP_InitialContextSetup", "failure", "3", "unknown"), 7: ("RRC_Proc_99", "response", "4294967295", None),
        8: ("F1AP_F1Setup", "failure", "7", "unknown-0x7f"),
    }


def test_rules_fire_only_when_the_band_is_silent(spark):
    rows = [("a", 100, 99, 1, 99.0, {"timeout": 1}, "NAS"), ("b", 100, 80, 20, 80.0, {"timeout": 20}, "NAS"), ("c", 1000, 998, 2, 99.8, {"x": 2}, "RRC")]
    df = spark.createDataFrame(rows, "procedure string, attempts bigint, success bigint, failure bigint, success_rate double, failure_causes map<string,bigint>, layer string")
    got = {(r["procedure"], r["detector"], r["severity"]) for r in PD.detect_rules(df).collect()}
    assert got == {("a", "Statistical (timeout rule)", "Low"), ("b", "Statistical (threshold)", "High"), ("c", "Statistical (cause concentration)", "Low")}


def test_forest_finds_the_odd_row(spark):
    rng = np.random.default_rng(5)
    rows = [(f"p{i}", *[float(x) for x in (rng.normal(99, 0.2), 1.0, 0.1, rng.integers(0, 3), 0.1, 0.1, 0.0, 1.0)], 1, {"x": 1}, "NAS") for i in range(60)]
    rows.append(("odd", 20.0, 80.0, 0.1, 90.0, 0.9, 0.9, 0.9, 1.0, 90, {"x": 90}, "NAS"))
    df = spark.createDataFrame(rows, "procedure string, " + ", ".join(f"{c} double" for c in PD.FEATURES) + ", failure bigint, failure_causes map<string,bigint>, layer string")
    a = PD.detect_forest(df, trees=40).orderBy(F.col("score").desc()).collect()
    assert a[0]["procedure"] == "odd" and a[0]["severity"] == "High"
    b = PD.detect_envelope(df).orderBy(F.col("score").desc()).collect()
    assert b[0]["procedure"] == "odd"
    assert PD.detect_lof(df).orderBy(F.col("lof").desc()).first()["procedure"] == "odd"


# ------------------------------------------------------------ evaluation

def cells(spark, names):
    return spark.createDataFrame([(n,) for n in names], "cell_id string")


@pytest.mark.parametrize(
    "found, tp, fp, fn, tn, f1", [(["a", "b"], 2, 0, 0, 2, 1.0), ([], 0, 0, 2, 2, 0.0), (["a", "c"], 1, 1, 1, 1, 0.5), (["c", "d"], 0, 2, 2, 0, 0.0)]
)
def test_scenario_metrics(spark, found, tp, fp, fn, tn, f1):
    m = EV.scenario_metrics(cells(spark, found), cells(spark, ["a", "b"]), cells(spark, ["a", "b", "c", "d"])).first()
    assert (m["tp"], m["fp"], m["fn"], m["tn"], m["f1"]) == (tp, fp, fn, tn, f1)


def test_scenario_metrics_name_the_cells(spark):
    m = EV.scenario_metrics(cells(spark, ["a", "d", "c"]), cells(spark, ["a", "b"]), cells(spark, ["a", "b", "c", "d"])).first()
    assert (m["detected_fault_cells"], m["missed_fault_cells"], m["false_positive_cells"]) == (["a"], ["b"], ["c", "d"])


def test_fleet_events_top_up_sparse_cells(spark):
    rows = [anomaly(i, cell="busy") for i in range(8)] + [anomaly(20, cell="quiet")] + [anomaly(30 + i, cell="Fleet-wide", severity="Critical") for i in range(2)]
    ev = events(spark, rows)
    g = EV.evidence_groups(ev, cells(spark, ["busy", "quiet", "none"]))
    got = {r["group_cell"]: r["c"] for r in g.groupBy("group_cell").agg(F.collect_set("cell_id").alias("c")).collect()}
    assert set(got["busy"]) == {"busy"} and set(got["quiet"]) == {"quiet", "Fleet-wide"} and set(got["none"]) == {"Fleet-wide"}


# ------------------------------------------------------------ feedback

def verdicts(spark, n_fp, n_ok, detector="Isolation Forest"):
    rows = [(f"f{i}", detector, "kpi", "false_positive") for i in range(n_fp)] + [(f"c{i}", detector, "kpi", "correct") for i in range(n_ok)]
    return spark.createDataFrame(rows, "feedback_id string, detector string, source string, verdict string")


@pytest.mark.parametrize("fp, ok, after", [(8, 2, 0.02), (0, 10, 0.18), (1, 3, 0.15)])
def test_retrain(spark, fp, ok, after):
    row = B.retrain(verdicts(spark, fp, ok)).where("detector = 'Isolation Forest'").first()
    assert row["after"] == after
    assert row["status"].startswith("skipped") == (fp + ok < 5)


def test_thresholds_move_within_bounds(spark):
    rows = {r["detector"]: r["after"] for r in B.retrain(verdicts(spark, 10, 0, "Peer Comparison")).collect()}
    assert rows["Peer Comparison"] == 2.54 and rows["CUSUM"] == 4.0


def test_feedback_file_round_trip(spark, tmp_path):
    from radiolake.sources import readers, writers

    path = str(tmp_path / "fb")
    df = spark.createDataFrame([("1", "2024-01-01T00:00:00", "x" * 300), ("2", "2024-01-02T00:00:00", "y")], "feedback_id string, timestamp string, evidence string")
    writers.append_feedback(df, path)
    (tmp_path / "fb" / "bad.json").write_text("{not json\n")
    rows = readers.read_feedback(spark, path).collect()
    assert [r["feedback_id"] for r in rows] == ["2", "1"] and len(rows[1]["evidence"]) == 200
    assert readers.read_feedback(spark, path, limit=1).count() == 1
