"""Signalling code points (fixed values from the public 3GPP specifications).

Layer tags, procedure codes, message types and cause codes as carried in the
compact payload layout.  Information-element schemas are not baked in: they are
a table the caller supplies (see ``operators.signalling.ie_conformance``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from radiolake.functions.columns import fixed_table

# First payload byte -> layer, and the layers in stack order.
LAYER_TAGS = {0x7E: "NAS", 0x3A: "NGAP", 0x2B: "RRC", 0x1A: "F1AP", 0x1B: "E1AP", 0x1C: "XnAP"}
LAYERS = ["NAS", "NGAP", "RRC", "F1AP", "E1AP", "XnAP"]

# NAS message type -> (procedure, role)
NAS_MESSAGES = {
    0x41: ("NAS_Registration", "request"), 0x42: ("NAS_Registration", "accept"),
    0x43: ("NAS_Registration", "complete"), 0x44: ("NAS_Registration", "reject"),
    0x45: ("NAS_Deregistration", "request"), 0x46: ("NAS_Deregistration", "accept"),
    0x47: ("NAS_Deregistration_Network", "command"), 0x48: ("NAS_Deregistration_Network", "complete"),
    0x56: ("NAS_Authentication", "request"), 0x57: ("NAS_Authentication", "response"),
    0x58: ("NAS_Authentication", "reject"), 0x59: ("NAS_Authentication", "failure"),
    0x5C: ("NAS_SecurityMode", "command"), 0x5D: ("NAS_SecurityMode", "complete"),
    0x5E: ("NAS_SecurityMode", "reject"),
    0x64: ("NAS_ServiceRequest", "request"), 0x65: ("NAS_ServiceRequest", "reject"),
    0x66: ("NAS_ServiceRequest", "accept"),
    0x68: ("NAS_ConfigUpdate", "command"), 0x69: ("NAS_ConfigUpdate", "complete"),
    0x6B: ("NAS_Identity", "request"), 0x6C: ("NAS_Identity", "response"),
    0xC1: ("NAS_PDUSession_Establishment", "request"), 0xC2: ("NAS_PDUSession_Establishment", "accept"),
    0xC3: ("NAS_PDUSession_Establishment", "reject"),
    0xC9: ("NAS_PDUSession_Modification", "command"), 0xCA: ("NAS_PDUSession_Modification", "complete"),
    0xCB: ("NAS_PDUSession_Modification", "reject"), 0xCC: ("NAS_PDUSession_Modification", "request"),
    0xD1: ("NAS_PDUSession_Release", "command"), 0xD2: ("NAS_PDUSession_Release", "request"),
    0xD3: ("NAS_PDUSession_Release", "reject"), 0xD4: ("NAS_PDUSession_Release", "complete"),
}

# Procedure code -> procedure, per layer.
PROCEDURES = {
    "NGAP": {
        1: "NGAP_InitialContextSetup", 2: "NGAP_PDUSessionResourceSetup", 3: "NGAP_PDUSessionResourceRelease",
        4: "NGAP_UEContextRelease", 5: "NGAP_HandoverPreparation", 6: "NGAP_NGSetup", 7: "NGAP_Paging",
        8: "NGAP_UEContextModification", 9: "NGAP_PathSwitchRequest",
    },
    "RRC": {
        1: "RRC_Setup", 2: "RRC_Reestablishment", 3: "RRC_Reconfiguration", 4: "RRC_Release", 5: "RRC_SecurityMode",
        6: "RRC_UECapabilityEnquiry",
    },
    "F1AP": {
        1: "F1AP_F1Setup", 2: "F1AP_UEContextSetup", 3: "F1AP_UEContextModification", 4: "F1AP_UEContextRelease",
        5: "F1AP_DLRRCMessageTransfer", 6: "F1AP_ULRRCMessageTransfer", 7: "F1AP_InitialULRRCMessageTransfer",
        8: "F1AP_Paging", 9: "F1AP_gNBDUConfigurationUpdate", 10: "F1AP_gNBCUConfigurationUpdate",
        11: "F1AP_UEContextModificationRequired", 12: "F1AP_ErrorIndication", 13: "F1AP_SRBSetup",
        14: "F1AP_DRBSetup",
    },
    "E1AP": {
        1: "E1AP_GNBCUUPSetup", 2: "E1AP_BearerContextSetup", 3: "E1AP_BearerContextModification",
        4: "E1AP_BearerContextRelease", 5: "E1AP_BearerContextStatusNotification", 6: "E1AP_DLDataNotification",
        7: "E1AP_GNBCUCPConfigurationUpdate", 8: "E1AP_GNBCUUPConfigurationUpdate", 9: "E1AP_ULDataNotification",
        10: "E1AP_DataUsageReport", 11: "E1AP_GNBCUUPCounterCheck", 12: "E1AP_ResourceStatusRequest",
        13: "E1AP_IABUPConfigurationUpdate", 14: "E1AP_ErrorIndication",
    },
    "XnAP": {
        1: "XnAP_XnSetup", 2: "XnAP_HandoverRequest", 3: "XnAP_XnUEContextRelease", 4: "XnAP_RANPaging",
        5: "XnAP_SecondaryNodeAddition", 6: "XnAP_SecondaryNodeModification", 7: "XnAP_SecondaryNodeRelease",
        8: "XnAP_CellActivation", 9: "XnAP_SONConfiguration", 10: "XnAP_RNL_InformationTransfer",
        11: "XnAP_RRCTransfer", 12: "XnAP_SNodeAdditionRequestAcknowledge", 13: "XnAP_SNodeReleaseRequest",
        14: "XnAP_ErrorIndication",
    },
}

# NAS cause code -> cause.
NAS_CAUSES = {
    0x02: "imsi-unknown-in-hss", 0x03: "illegal-ue", 0x06: "illegal-me", 0x07: "5gs-not-allowed",
    0x09: "ue-identity-not-derived", 0x0A: "implicitly-detached", 0x0B: "plmn-not-allowed",
    0x0C: "ta-not-allowed", 0x0F: "no-suitable-cells", 0x14: "mac-failure", 0x15: "auth-failure",
    0x16: "congestion", 0x1A: "semantically-incorrect-message", 0x5F: "protocol-error",
}
# Cause code -> cause, per layer.
CAUSES = {
    "NGAP": {
        1: "radio-network-unspecified", 2: "rl-failure-rlc", 3: "unknown-local-ue-ngap-id",
        4: "inconsistent-remote-ue-ngap-id", 5: "handover-desirable-for-radio-reason", 6: "time-critical-handover",
        7: "resource-optimisation-handover", 8: "reduce-load-in-serving-cell", 9: "user-inactivity",
        10: "radio-connection-with-ue-lost", 11: "radio-resources-not-available", 12: "invalid-qos-combination",
        13: "failure-in-radio-interface-procedure", 14: "interaction-with-other-procedure",
        15: "unknown-pdu-session-id", 16: "unknown-qos-flow-id", 17: "multiple-pdu-session-id-instances",
        18: "multiple-qos-flow-id-instances", 19: "encryption-integrity-keys-not-available",
    },
    "RRC": {
        1: "other-failure", 2: "handover-failure", 3: "other-radio-link-failure", 4: "rlf-report-available",
        5: "t310-expiry", 6: "random-access-problem", 7: "rlc-max-num-retx", 8: "t312-expiry",
    },
    "F1AP": {
        1: "radio-network-unspecified", 2: "rl-failure-rlc", 3: "unknown-or-already-allocated-gNBCU-UE-F1AP-ID",
        4: "unknown-or-already-allocated-gNBDU-UE-F1AP-ID", 5: "unknown-or-inconsistent-pair-of-UE-F1AP-ID",
        6: "interaction-with-other-procedure", 7: "not-supported-qci-value", 8: "action-desirable-for-radio-reasons",
        9: "no-radio-resources-available", 10: "procedure-cancelled", 11: "normal-release", 12: "cell-not-available",
        13: "rl-failure-others", 14: "ue-rejection", 15: "resources-not-available-for-the-slice",
        16: "amf-initiated-abnormal-release", 17: "release-due-to-pre-emption",
    },
    "E1AP": {
        1: "radio-network-unspecified", 2: "unknown-or-already-allocated-gNBCUCPUEE1APID",
        3: "unknown-or-already-allocated-gNBCUUPUEE1APID", 4: "unknown-or-inconsistent-pair-of-UE-E1AP-ID",
        5: "encryption-and-integrity-protection-algorithms-not-supported", 6: "UE-context-release",
        7: "UP-integrity-protection-not-possible", 8: "UP-confidentiality-protection-not-possible",
        9: "multiple-PDU-session-ID-instances", 10: "unknown-PDU-session-ID", 11: "multiple-QoS-flow-ID-instances",
        12: "unknown-QoS-flow-ID", 13: "multiple-DRB-ID-instances", 14: "unknown-DRB-ID",
        15: "invalid-QoS-combination", 16: "not-supported-5QI-value", 17: "NG-intra-system-handover-triggered",
        18: "NG-inter-system-handover-triggered", 19: "XN-handover-triggered", 20: "not-supported-QCI-value",
        21: "PDU-session-resource-released", 22: "CU-UP-PDCP-count-wrap-around", 23: "no-radio-resources-available",
        24: "resources-not-available-for-the-slice",
        25: "PDU-session-resources-flushed-due-to-exceedance-of-max-data-rate",
        26: "PDCP-sequence-number-not-available",
    },
    "XnAP": {
        1: "radio-network-unspecified", 2: "handover-desirable-for-radio-reasons", 3: "time-critical-handover",
        4: "resource-optimisation-handover", 5: "reduce-load-in-serving-cell", 6: "user-inactivity",
        7: "radio-connection-with-UE-lost", 8: "failure-in-radio-interface-procedure",
        9: "bearer-option-not-supported", 10: "MCG-mobility", 11: "SCG-mobility", 12: "count-reaches-max-value",
        13: "unknown-old-EN-DC-UE-X2AP-ID", 14: "pDCP-Change-with-PSCell-Change",
        15: "requested-item-not-supported-on-time", 16: "unknown-or-already-allocated-ng-ran-node-ue-xnap-id",
        17: "inconsistent-access-and-mobility-policy", 18: "inter-system-handover-triggered",
        19: "not-all-requested-PDU-sessions-can-be-forwarded", 20: "no-suitable-cells-in-target-cell-list",
    },
}

# Which message roles open, complete or fail a procedure.
OPENING = ("request", "command")
COMPLETING = ("accept", "response", "complete", "result")
FAILING = ("reject", "failure")
CATEGORY_ROLES = {0: "request", 1: "response", 2: "failure"}

# Procedures whose upstream failures should have stopped the downstream one.
CASCADES = [
    ("NAS_Registration", "NAS_Authentication"),
    ("NAS_Authentication", "NAS_SecurityMode"),
    ("NAS_SecurityMode", "NAS_PDUSession_Establishment"),
    ("RRC_Setup", "RRC_Reconfiguration"),
    ("NGAP_InitialContextSetup", "NGAP_PDUSessionResourceSetup"),
    ("F1AP_UEContextSetup", "F1AP_DLRRCMessageTransfer"),
]

# Advice by dominant cause, then by layer, then the default.
CAUSE_ADVICE = {
    "congestion": "Check AMF/UPF load; consider increasing capacity or load-balancing.",
    "timeout": "Investigate N2/F1/E1/Xn link latency; verify timer T3xx configuration.",
    "auth-failure": "Check HSS/AUSF reachability; verify UE SIM profile and SUPI.",
    "semantically-incorrect-message": "Inspect NAS message encoding; check AMF/SMF software version compatibility.",
    "radio-connection-with-ue-lost": "Analyse RF coverage; check DRX parameters and handover thresholds.",
    "user-inactivity": "Review inactivity timer configuration in AMF/gNB.",
    "radio-resources-not-available": "Check PRB utilisation; consider adding carriers or cells.",
    "procedure-cancelled": "Verify gNB-DU/CU interface stability; review F1AP trace.",
    "ue-context-release": "Check bearer lifecycle; verify UPF session anchor consistency.",
    "other-failure": "Collect RRC logs and UE traces for root cause analysis.",
    "rlf-report-available": "Review RLF reports; check A3/A5 measurement configuration.",
    "radio-connection-with-UE-lost": "Check Xn interface and handover configuration between gNBs.",
    "unknown": "Enable detailed tracing on the affected network function.",
}
LAYER_ADVICE = {
    "NAS": "Review AMF/SMF logs and NAS trace for affected UE.",
    "NGAP": "Check N2 interface and AMF capacity; review NGAP trace.",
    "RRC": "Analyse gNB RRC logs; check radio coverage and cell config.",
    "F1AP": "Inspect F1 interface; verify gNB-DU software and configuration.",
    "E1AP": "Inspect E1 interface; verify gNB-CU-UP reachability.",
    "XnAP": "Check Xn interface configuration between gNBs.",
}
PROC_DEFAULT_ADVICE = "Enable detailed tracing on the affected network function."


def code_dim(spark: SparkSession) -> DataFrame:
    """(layer, kind, code, name, role): NAS messages, procedures of the other layers, causes of all."""
    rows = [("NAS", "message", c, p, r) for c, (p, r) in NAS_MESSAGES.items()]
    rows += [(layer, "message", c, p, None) for layer, names in PROCEDURES.items() for c, p in names.items()]
    rows += [("NAS", "cause", c, n, None) for c, n in NAS_CAUSES.items()]
    rows += [(layer, "cause", c, n, None) for layer, names in CAUSES.items() for c, n in names.items()]
    return fixed_table(spark, tuple(rows), "layer string, kind string, code int, name string, role string")
