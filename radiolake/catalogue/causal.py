"""Causal rules, stack ranks and explanation texts (fixed values)."""

from __future__ import annotations

# Rank of a protocol layer, deepest first.
LAYER_RANK = {
    "PHY": 0, "L1": 0, "MAC": 1, "RLC": 1, "PDCP": 1, "L2": 1, "STATS": 1, "RRC": 2, "F1AP": 3,
    "E1AP": 4, "XNAP": 5, "NGAP": 6, "NAS": 7, "KPI": 8, "?": 5,
}
# Name shown for a layer.
LAYER_LABEL = {
    "PHY": "Physical Layer (RF)", "L1": "Physical Layer (RF)", "MAC": "MAC/RLC/PDCP (L2)",
    "RLC": "MAC/RLC/PDCP (L2)", "PDCP": "MAC/RLC/PDCP (L2)", "L2": "MAC/RLC/PDCP (L2)",
    "STATS": "DU/CU Statistics (L2)", "RRC": "RRC (TS 38.331)", "F1AP": "F1AP (TS 38.473)",
    "E1AP": "E1AP (TS 38.463)", "XNAP": "XnAP (TS 38.423)", "NGAP": "NGAP (TS 38.413)",
    "NAS": "NAS (TS 24.501)", "KPI": "KPI (aggregate)",
}
# Words that move an event down to the radio or the MAC layer.
PHY_WORDS = ("bler", "snr", "rsrp", "rsrq", "pusch", "pucch", "cqi")
MAC_WORDS = ("harq", "pdcp", "rlc", "prb", "sched", "buffer", "retrans")

# Rule, root layer, keywords, confidence, description, recommendation.
RULES = [
    ("L1_radio_degradation", "PHY", ["bler", "snr", "rsrp", "rsrq", "cqi", "radio", "rf", "signal"], 0.88,
     "RF/physical layer degradation causing RRC failures and cascading up.",
     "Check UE RF conditions: RSRP < -110 dBm or SINR < 0 dB indicates coverage hole. "
     "Review antenna tilt, TX power, and inter-cell interference (ICIC). "
     "Consider adding a relay or small cell."),
    ("L2_scheduling_issue", "MAC",
     ["harq", "pdcp", "rlc", "scheduling", "sched", "buffer", "retransmission", "drop"], 0.82,
     "MAC/HARQ/PDCP layer errors causing throughput degradation and KPI drops.",
     "Check HARQ retransmission rate (>10% indicates poor link quality). "
     "Review DL/UL scheduling algorithm and PRB utilisation. "
     "Inspect PDCP discard timer and buffer status reports."),
    ("RRC_setup_failure", "RRC", ["rrc", "setup", "reconfig", "release", "connection"], 0.80,
     "RRC connection setup failures causing NGAP and NAS procedure failures.",
     "Check RRC Setup Failure cause IE. Common causes: "
     "radio link failure (check BLER), resource unavailability (check PRB usage), "
     "or security failure (check RRC integrity keys). "
     "Review gNB RRC timer T300/T301 configuration."),
    ("F1AP_context_failure", "F1AP", ["f1ap", "ue context", "f1", "du", "cu"], 0.78,
     "F1AP DU<->CU-CP context setup failure causing NGAP failures.",
     "Check F1AP UE Context Setup Failure cause. "
     "Verify F1 interface connectivity (SCTP association). "
     "Inspect DU cell capacity and resource availability. "
     "Check gNB-DU software version compatibility with gNB-CU."),
    ("NGAP_overload", "NGAP",
     ["overload", "congestion", "amf", "ngap", "n2", "cause 22", "#22", "overload start"], 0.90,
     "AMF overload or N2 interface congestion causing NAS registration rejections.",
     "AMF is overloaded. Immediate actions: "
     "1. Check AMF CPU/memory utilisation. "
     "2. Enable AMF load balancing across instances. "
     "3. Review NGAP OVERLOAD_START restriction level. "
     "4. UEs will back off using T3502 (12 min) — monitor re-registration rate."),
    ("authentication_failure", "NAS",
     ["auth", "security mode", "authentication", "5gmm cause #20", "mac failure"], 0.85,
     "NAS authentication or security mode failures.",
     "Authentication failures indicate SIM/USIM or AMF key issues. "
     "Check: UE subscription in UDM/AUSF, NAS security algorithms, "
     "and AMF key generation. Replay attacks produce MAC failure (#20)."),
    ("handover_failure", "XNAP", ["handover", "xnap", "xn", "ho failure", "mobility", "a3 event"], 0.80,
     "XnAP/inter-gNB handover failure causing RRC release and NAS re-registration.",
     "Handover failure detected. Check: "
     "A3 event offset and TTT (too aggressive -> ping-pong, too conservative -> RLF). "
     "Xn interface SCTP connectivity. "
     "Target cell admission control configuration."),
    ("bearer_setup_failure", "E1AP", ["e1ap", "bearer", "pdu session", "cu-up", "cu-cp", "drb"], 0.78,
     "E1AP CU-CP<->CU-UP bearer or PDU session setup failure.",
     "E1AP bearer setup failed. Check: "
     "CU-UP resource availability (GTP tunnel quota). "
     "E1 interface SCTP association. "
     "QoS parameter mismatch between CU-CP and CU-UP."),
]
# Confidence and advice where no rule fits.
NO_RULE_CONFIDENCE = 0.4
NO_RULE_ADVICE = (
    "Investigate the lowest-layer anomaly in this correlated group first; "
    "it is the most likely root cause given standard 5G protocol-stack causality."
)
# Note on forecast roots.
FORECAST_NOTE = (
    " Note: a forecast also predicts continued/worsening anomalies on this "
    "cell within the prediction horizon — treat as higher priority."
)

# What a dominant cause means, and hints by layer and cause.
CAUSE_MEANING = {
    "congestion": "AMF or network overload (5GMM cause #22). Back-off T3502 applies.",
    "timeout": "No response received within timer window — likely N2/F1/E1 link latency or NF unavailability.",
    "auth-failure": "Authentication failed — check AUSF/UDM reachability and UE SIM/SUPI profile.",
    "semantically-incorrect-message": "Message encoding error — check 3GPP spec version compatibility between NFs.",
    "radio-connection-with-ue-lost": "Radio Link Failure (RLF) — check coverage, DRX, and handover thresholds.",
    "radio-resources-not-available": "Cell capacity exhausted — check PRB utilisation and scheduler configuration.",
    "procedure-cancelled": "Resource unavailable at target NF — check gNB-DU/CU-UP capacity and health.",
    "user-inactivity": "UE moved to idle — normal behaviour, verify inactivity timer config if excessive.",
    "ue-context-release": "Context released prematurely — check bearer lifecycle and UPF session anchor.",
}
# Hints by layer.
LAYER_HINTS = {
    "NAS": ["Check AMF process health and CPU/memory utilisation.",
            "Inspect NAS trace on the affected UE SUPI."],
    "NGAP": ["Check N2 SCTP association status between gNB and AMF.",
             "Review AMF capacity — active UE context count vs limit."],
    "RRC": ["Check DL RSRP and SINR for affected cells.",
            "Review gNB RRC log for reject causes and waiting times."],
    "F1AP": ["Verify F1 SCTP link between gNB-DU and gNB-CU-CP.",
             "Check gNB-DU hardware alarms and resource counters."],
    "E1AP": ["Check E1 SCTP link between gNB-CU-CP and gNB-CU-UP.",
             "Inspect gNB-CU-UP memory usage and GTP tunnel table."],
    "XnAP": ["Verify Xn SCTP association between the two gNBs.",
             "Check target gNB capacity — PRB and context count."],
}
# Hints where a layer has none.
DEFAULT_LAYER_HINTS = ["Enable detailed tracing on the affected network function.",
                       "Collect protocol logs covering the failure window."]
# Hints by cause.
CAUSE_HINTS = {
    "congestion": "Check AMF/SMF/UPF CPU and memory — scale out if > 80% sustained.",
    "timeout": "Capture N2/F1/E1 SCTP traffic — look for retransmissions or connection resets.",
    "auth-failure": "Verify HSS/AUSF responds within 2s — check AUSF latency KPI.",
    "radio-resources-not-available": "Review PRB utilisation trend — add capacity or activate load-balancing.",
    "procedure-cancelled": "Check gNB-DU/CU-UP process restart logs for crash indicators.",
}
# Hint where a cause has none, and the closing one.
DEFAULT_CAUSE_HINT = "Analyse failure cause distribution for patterns."
CLOSING_HINT = "Compare anomalous cell/procedure with healthy peer group."
