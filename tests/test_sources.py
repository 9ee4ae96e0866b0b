"""Readers, routing and writers on small files."""

import pytest

from radiolake.operators import explore as X
from radiolake.operators import normalise as N
from radiolake.sources import readers, writers


def test_csv_kpi_file_to_facts(spark, tmp_path):
    path = tmp_path / "kpi.csv"
    path.write_text(
        "Timestamp,Cell_ID,gNB_ID,Channel_Type,DL PRB Utilization,Latency\n"
        "2026-06-13T10:00:00,PCI_1,gNB-1,TDD,85.5,12\n"
        "not a time,PCI_2,gNB-1,FDD,,7\n"
    )
    df = readers.read_table(spark, str(path))
    rows = {(r["cell_id"], r["kpi"]): (r["ts"], r["value"]) for r in N.kpi_facts(df).collect()}
    assert rows[("PCI_1", "PRB_Utilization_DL_%")][1] == 85.5 and rows[("PCI_1", "Latency_ms")][1] == 12.0
    assert rows[("PCI_2", "Latency_ms")] == (None, 7.0)
    assert readers.route(df.columns, str(path)) == "kpi"


def test_parquet_rows_keep_file_order(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(50).coalesce(1).write.parquet(path)
    df = readers.read_table(spark, path, fmt="parquet")
    assert df.where("id <> seq").count() == 0


def test_unknown_format(spark):
    with pytest.raises(ValueError):
        readers.read_table(spark, "/tmp/some.xlsx")


def test_packet_list(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text('No.,Time,Source,Destination,Protocol,Length,Info\n1,0.0,10.0.0.1,10.0.0.2,NGAP,120,"Setup, request"\n')
    row = readers.read_packet_list(spark, str(path)).first()
    assert (row["packet_no"], row["Protocol"], row["Length"], row["Info"]) == (1, "NGAP", 120, "Setup, request")


@pytest.mark.parametrize(
    "columns, path, forced, want",
    [(["pci", "dl_nof_ok"], "x.csv", None, "stats"), (["RSRP_dBm"], "x.csv", None, "stats"), (["a", "Latency_ms"], "x.csv", None, "kpi"),
     (["a", "b"], "x.csv", None, "stats"), ([], "x.pcap", None, "pcap"), (["pci"], "x.csv", "kpi", "kpi"), ([], "x.xlsx", None, "kpi")],
)
def test_routing(columns, path, forced, want):
    assert readers.route(columns, path, forced) == want


def test_report_and_merge(spark, tmp_path):
    a = spark.createDataFrame([("Critical", "t", "PCI_1"), ("Low", "u", None)], "severity string, type string, cell_id string")
    head = writers.report_header(a).first()
    assert (head["total_anomalies"], head["critical"], head["low"], head["predicted_anomalies"]) == (2, 1, 1, 0)
    writers.write_report(writers.anomaly_report(a), str(tmp_path / "r"))
    assert spark.read.csv(str(tmp_path / "r"), header=True).where("cell = '—'").count() == 1
    old = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2)], "method string, v int")
    new = spark.createDataFrame([("b", 9)], "method string, v int")
    assert sorted(tuple(r) for r in writers.replace_by_key(old, new, ["method"]).collect()) == [("a", 1), ("b", 9)]


@pytest.mark.parametrize("n, limit", [(10, 3), (7, 7), (100, 60), (61, 60), (5, 80), (997, 37)])
def test_downsample_index_rule(spark, n, limit):
    df = spark.range(n).selectExpr("'a' as k", "timestamp_seconds(id * 7000) as ts", "id as i")
    got = sorted(r["i"] for r in X.downsample(df, ["k"], ["ts"], limit).collect())
    want = list(range(n)) if n <= limit else [int(i * (n / limit)) for i in range(limit)]
    assert got == want


def test_row_numbers_run_over_all_files(spark, tmp_path):
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.parquet(f"{tmp_path}/in/part{k}")
    out = readers.read_table(spark, f"{tmp_path}/in/*", fmt="parquet").orderBy("seq").collect()
    assert [(r.seq, r.id) for r in out] == [(i, i) for i in range(30)]


def test_row_numbers_are_not_dealt_by_file(spark, tmp_path):
    """A large table of one file must not be shuffled into one task, whatever Spark makes of its size."""
    path, key = str(tmp_path / "t.parquet"), "spark.sql.autoBroadcastJoinThreshold"
    spark.range(50).repartition(3).write.parquet(path)
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        df = readers.read_table(spark, path, fmt="parquet")
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert sorted(r["seq"] for r in df.collect()) == list(range(50))
    finally:
        spark.conf.set(key, before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
