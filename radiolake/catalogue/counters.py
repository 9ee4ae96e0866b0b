"""Radio-counter catalogue and vendor column shapes (fixed values)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from radiolake.functions.columns import fixed_table

# Metric, unit, description, warning, critical
COUNTERS = [
    ("dl_prb_util", "%", "DL PRB Utilisation", 80.0, 90.0),
    ("ul_prb_util", "%", "UL PRB Utilisation", 80.0, 90.0),
    ("dl_bler", "%", "DL Block Error Rate", 10.0, 20.0),
    ("ul_bler", "%", "UL Block Error Rate", 10.0, 20.0),
    ("dl_mcs", "idx", "DL Modulation Coding Scheme", 6.0, 4.0),
    ("ul_mcs", "idx", "UL Modulation Coding Scheme", 6.0, 4.0),
    ("dl_harq_nack_rate", "%", "DL HARQ NACK Rate", 15.0, 25.0),
    ("ul_harq_nack_rate", "%", "UL HARQ NACK Rate", 15.0, 25.0),
    ("dl_throughput_mbps", "Mbps", "DL Throughput", None, None),
    ("ul_throughput_mbps", "Mbps", "UL Throughput", None, None),
    ("pusch_snr_db", "dB", "UL PUSCH SINR", 5.0, 0.0),
    ("pucch_snr_db", "dB", "UL PUCCH SINR", 5.0, 0.0),
    ("snr_db", "dB", "SNR", 5.0, 0.0),
    ("rsrp_dbm", "dBm", "Reference Signal Received Power", -105.0, -115.0),
    ("rsrq_db", "dB", "Reference Signal Received Quality", -14.0, -18.0),
    ("nof_ue", "count", "Active UE Count", None, None),
    ("dl_harq_nack", "count", "DL HARQ NACK count (raw)", None, None),
    ("ul_harq_nack", "count", "UL HARQ NACK count (raw)", None, None),
    ("dl_prb_util_baseline_delta", "%", "DL PRB delta from 60-row rolling mean", 15.0, 25.0),
    ("ul_prb_util_baseline_delta", "%", "UL PRB delta from 60-row rolling mean", 15.0, 25.0),
    ("dl_bler_baseline_delta", "%", "DL BLER delta from rolling mean", 5.0, 10.0),
    ("ul_bler_baseline_delta", "%", "UL BLER delta from rolling mean", 5.0, 10.0),
    ("prb_baseline_delta", "%", "DL PRB utilisation vs rolling baseline", 15.0, 25.0),
    ("congestion_score", "binary", "PRB>80% AND BLER>5% simultaneously", 0.5, 1.0),
    ("hour_of_day", "h", "Hour of day (0-23) — time context", None, None),
    ("day_of_week", "day", "Day of week (0=Mon, 6=Sun)", None, None),
]
CALENDAR = ("hour_of_day", "day_of_week")
DELTA_METRICS = (
    "dl_prb_util", "ul_prb_util", "dl_bler", "ul_bler",
    "dl_harq_nack_rate", "ul_harq_nack_rate", "pusch_snr_db", "snr_db",
)

# Column names that give a vendor shape away, tried in this order.
FINGERPRINTS = [
    ("srsran", {"dl_nof_ok", "dl_nof_nok", "ul_nof_ok", "ul_nof_nok", "pusch_snr_db", "dl_brate", "ul_brate", "pci"}),
    ("oai", {"dlsch_total", "dlsch_errors", "dl_mcs1", "prb_dl", "snr"}),
    ("nist", {"rsrp_dbm", "dl_bler_pct", "prb_utilization_pct", "harq_nack_dl"}),
]

# Per shape, candidate time and cell columns in order of preference.
TIME_COLUMNS = {
    "srsran": ["timestamp", "time", "t"],
    "oai": ["timestamp", "time"],
    "nist": ["time", "timestamp"],
    "generic": ["timestamp", "time", "date"],
}
CELL_COLUMNS = {
    "srsran": ["pci", "cell_id", "cell"],
    "oai": ["cell_id", "cell", "ue_id", "imsi"],
    "nist": ["cell", "cell_id", "imsi"],
    "generic": ["cell_id", "cell", "pci", "enb_id", "gnb_id"],
}

# Vendor column (first present wins) -> metric, for plain renames.
RENAMES = {
    "srsran": [
        (["dl_mcs"], "dl_mcs"), (["ul_mcs"], "ul_mcs"), (["pusch_snr_db"], "pusch_snr_db"),
        (["pucch_snr_db"], "pucch_snr_db"), (["nof_ue"], "nof_ue"),
    ],
    "oai": [
        (["prb_dl"], "dl_prb_util"), (["prb_ul"], "ul_prb_util"), (["dl_mcs1"], "dl_mcs"),
        (["ul_mcs1"], "ul_mcs"), (["snr"], "snr_db"),
    ],
    "nist": [
        (["rsrp_dbm", "rsrp"], "rsrp_dbm"), (["rsrq_db", "rsrq"], "rsrq_db"), (["snr_db", "snr"], "snr_db"),
        (["dl_bler_pct", "dl_bler"], "dl_bler"), (["ul_bler_pct", "ul_bler"], "ul_bler"),
        (["prb_utilization_pct", "prb_util"], "dl_prb_util"), (["dl_mcs"], "dl_mcs"), (["ul_mcs"], "ul_mcs"),
        (["dl_throughput_mbps", "dl_throughput"], "dl_throughput_mbps"),
        (["ul_throughput_mbps", "ul_throughput"], "ul_throughput_mbps"),
        (["harq_nack_dl"], "dl_harq_nack"), (["harq_nack_ul"], "ul_harq_nack"),
    ],
    "generic": [],
}
PRB_PER_CARRIER = 106
PRB_COUNT_LIMIT = 110


def worse_when_high(desc: str) -> bool:
    """Error, load and retransmission counters are bad when high; all others when low."""
    d = desc.lower()
    return any(word in d for word in ("bler", "prb", "nack", "block error rate"))


def counter_dim(spark: SparkSession) -> DataFrame:
    rows = tuple((m, u, d, w, c, worse_when_high(d)) for m, u, d, w, c in COUNTERS)
    return fixed_table(
        spark, rows, "metric string, unit string, desc string, warning double, critical double, worse_high boolean"
    )
