"""Signalling messages: payload decoding, request/response pairing, procedure counters.

Messages: ts, seq, layer, procedure, role, ue_id, cause (+ cell_id, ies).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from radiolake.catalogue import protocol as P
from radiolake.functions import ordered as O
from radiolake.functions.columns import rnd

MIN_PAYLOAD = 7
TIMEOUT = "timeout"


def _byte(i: int) -> Column:
    """Payload byte at 0-based position as integer; null past the end."""
    text = F.hex(F.substring("payload", i + 1, 1))
    return F.conv(F.when(text != "", text), 16, 10).cast("int")


def decode(payloads: DataFrame) -> DataFrame:
    """Fixed-layout payload bytes to layer, code, category, id and cause code; short or foreign payloads drop out."""
    tag = _byte(0)
    layer = F
    for code, name in P.LAYER_TAGS.items():
        layer = layer.when(tag == code, name)
    whole = payloads.where(F.length("payload") >= MIN_PAYLOAD)
    out = whole.select(
        *[c for c in payloads.columns if c != "payload"],
        layer.alias("layer"),
        F.when(tag == 0x7E, _byte(2)).otherwise(_byte(1)).alias("code"),
        F.when(tag != 0x7E, _byte(2)).alias("category"),
        F.conv(F.hex(F.substring("payload", 4, 4)), 16, 10).alias("ue_id"),
        _byte(7).alias("cause_code"),
    )
    return out.where(F.col("layer").isNotNull())


def name_codes(decoded: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """Code points to procedure, role and cause names through the fixed-size code table.

    Unknown NAS types drop out; other unknown procedures are named by their code.
    """
    hint = F.broadcast if codes is None else (lambda df: df)
    codes = codes if codes is not None else P.code_dim(decoded.sparkSession)
    msgs = hint(codes.where("kind = 'message'").select("layer", "code", F.col("name").alias("_proc"), F.col("role").alias("_role")))
    causes = hint(codes.where("kind = 'cause'").select("layer", F.col("code").alias("cause_code"), F.col("name").alias("_cause")))
    j = decoded.join(msgs, ["layer", "code"], "left").join(causes, ["layer", "cause_code"], "left")
    role = F
    for cat, name in P.CATEGORY_ROLES.items():
        role = role.when(F.col("category") == cat, name)
    j = j.withColumns(
        {
            "procedure": F.coalesce("_proc", F.concat("layer", F.lit("_Proc_"), F.lower(F.lpad(F.hex("code"), 2, "0")))),
            "role": F.when(F.col("layer") == "NAS", F.col("_role")).otherwise(role),
        }
    ).where((F.col("layer") != "NAS") | F.col("_proc").isNotNull())
    named = F.coalesce("_cause", F.concat(F.lit("unknown-0x"), F.lower(F.lpad(F.hex("cause_code"), 2, "0"))))
    # a zero cause byte is a value on NAS and means "absent" on the other layers
    absent = F.col("cause_code").isNull() | ((F.col("layer") != "NAS") & (F.col("cause_code") == 0))
    cause = F.when(role_class(F.col("role")) == "failure", F.when(absent, "unknown").otherwise(named))
    return j.withColumn("cause", cause).drop("_proc", "_role", "_cause")


def role_class(role: Column) -> Column:
    return (
        F.when(role.isin(*P.OPENING), "open")
        .when(role.isin(*P.COMPLETING), "success")
        .when(role.isin(*P.FAILING), "failure")
    )


def transaction_key() -> Column:
    return F.concat_ws("_", F.lower("layer"), "procedure", "ue_id")


def pair(messages: DataFrame) -> DataFrame:
    """Outcome of every message by looking one message back and ahead in its transaction.

    open -> answered / superseded (another request came first) / timeout (log ended);
    success, failure -> matched when a request is open, else orphan.
    ``open_ts`` is the time of the request a match closes.
    """
    m = messages.withColumns({"class": role_class(F.col("role")), "tx_key": transaction_key()})
    m = O.sliced(m.where(F.col("class").isNotNull()), ["tx_key"], ["ts", "seq"])
    m = O.neighbours(
        m, ["tx_key"], ["ts", "seq"], prev={"prev_class": "class", "prev_ts": "ts"}, nxt={"next_class": "class"}
    )
    outcome = (
        F.when(F.col("class") == "open",
               F.when(F.col("next_class").isNull(), "timeout")
               .when(F.col("next_class") == "open", "superseded")
               .otherwise("answered"))
        .when(F.col("prev_class") == "open", F.col("class"))
        .otherwise("orphan")
    )
    return m.withColumns(
        {"outcome": outcome, "open_ts": F.when(outcome.isin("success", "failure"), F.col("prev_ts"))}
    ).drop("prev_class", "prev_ts", "next_class", O.SLICE)


def message_log(paired: DataFrame) -> DataFrame:
    """One row per request, per matched outcome (at its request's time) and per timeout."""
    kinds = (
        F.when(F.col("outcome") == "timeout", F.array(F.lit("request"), F.lit(TIMEOUT)))
        .when(F.col("class") == "open", F.array(F.lit("request")))
        .when(F.col("outcome") == "success", F.array(F.lit("response")))
        .when(F.col("outcome") == "failure", F.array(F.lit("failure")))
    )
    rows = paired.withColumn("log_role", F.explode(kinds))
    cause = F.when(F.col("log_role") == TIMEOUT, TIMEOUT).when(
        F.col("log_role") == "failure", F.coalesce("cause", F.lit("unknown"))
    )
    keep = [c for c in ("cell_id", "ies") if c in paired.columns]
    return rows.select(
        F.when(F.col("log_role").isin("response", "failure"), F.col("open_ts")).otherwise(F.col("ts")).alias("ts"),
        F.col("ts").alias("seen_ts"), "seq", "layer", "procedure", F.col("log_role").alias("role"), "ue_id",
        F.concat_ws("_", "procedure", "log_role").alias("message_type"), cause.alias("cause"), *keep,
    )


def ie_conformance(messages: DataFrame, ie_dim: DataFrame) -> DataFrame:
    """Expected and observed element counts and the mandatory elements a message lacks.

    ``ie_dim(message_type, name, presence)`` is the caller's schema table; its
    rows are first folded to one row per message type.
    """
    per_type = ie_dim.groupBy("message_type").agg(
        F.count(F.lit(1)).alias("expected_ie_count"),
        F.sort_array(F.collect_set(F.when(F.col("presence") == "Mandatory", F.col("name")))).alias("_mandatory"),
    )
    m = messages
    if "message_type" not in m.columns:
        m = m.withColumn("message_type", F.concat_ws("_", "procedure", "role"))
    ies = F.coalesce("ies", F.create_map().cast("map<string,string>"))
    missing = F.array_except(F.coalesce("_mandatory", F.array().cast("array<string>")), F.map_keys(ies))
    return m.join(per_type, "message_type", "left").withColumns(
        {
            "expected_ie_count": F.coalesce("expected_ie_count", F.lit(0)),
            "observed_ie_count": F.cardinality(ies),
            "mandatory_missing": missing,
        }
    ).drop("_mandatory")


def procedure_counters(paired: DataFrame, by: Sequence[str] = ("procedure",)) -> DataFrame:
    """attempts, success, failure, success_rate, failure_causes map, layer and first cell per procedure.

    Causes are counted before the map is built, so a map holds one entry per cause name.
    """
    by = list(by)
    out = F.col("outcome")
    failed = out.isin("failure", "timeout")
    cause = F.when(out == "timeout", TIMEOUT).otherwise(F.coalesce("cause", F.lit("unknown")))
    cell = F.col("cell_id") if "cell_id" in paired.columns and "cell_id" not in by else F.lit(None).cast("string")
    started = paired.where((F.col("class") == "open") | (out != "orphan"))
    # all messages are counted by fixed-width hash aggregation; what follows sees one row per name combination
    counted = started.select(*by, "layer", cell.alias("_cell"), F.when(failed, cause).alias("_cause"), "class", "outcome", "ts", "seq").groupBy(
        *by, "layer", "_cell", "_cause"
    ).agg(
        F.count_if(F.col("class") == "open").alias("attempts"), F.count_if(out == "success").alias("success"),
        F.count_if(failed).alias("failure"), F.min("ts").alias("_ts"), F.min("seq").alias("_seq"),
    )
    at = F.struct("_ts", "_seq", "layer", "_cell")
    per_cause = counted.groupBy(*by, "_cause").agg(
        F.sum("attempts").alias("attempts"), F.sum("success").alias("success"), F.sum("failure").alias("failure"),
        F.min_by("layer", at).alias("layer"), F.min_by("_cell", F.when(F.col("_cell").isNotNull(), at)).alias("_cell"), F.min(at).alias("_at"),
    )
    entry = F.when(F.col("_cause").isNotNull(), F.struct(F.col("_cause").alias("key"), F.col("failure").alias("value")))
    agg = per_cause.groupBy(*by).agg(
        F.sum("attempts").alias("attempts"),
        F.sum("success").alias("success"),
        F.sum("failure").alias("failure"),
        F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("failure_causes"),
        F.min_by("layer", "_at").alias("layer"),
        F.coalesce(F.min_by("_cell", F.when(F.col("_cell").isNotNull(), F.col("_at"))), F.lit("—")).alias("_cell"),
    )
    rate = F.when(F.col("attempts") == 0, 0.0).otherwise(
        rnd(F.col("success") / F.nullif(F.col("attempts"), F.lit(0)) * 100, 2)
    )
    agg = agg.withColumn("success_rate", rate)
    return agg.drop("_cell") if "cell_id" in by else agg.withColumnRenamed("_cell", "cell_id")


def layer_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("layer").agg(F.count(F.lit(1)).alias("events"))


def top_cause(causes: Column) -> Column:
    """Most frequent cause of a map; the first name wins ties."""
    entries = F.map_entries(causes)
    best = F.aggregate(
        entries,
        F.struct(F.lit(None).cast("string").alias("key"), F.lit(0).cast("bigint").alias("value")),
        lambda acc, e: F.when(e["value"] > acc["value"], F.struct(e["key"].alias("key"), e["value"].alias("value"))).otherwise(acc),
    )
    return best["key"]


def procedure_table(counters: DataFrame) -> DataFrame:
    return counters.select(
        "procedure", "attempts", "success", "failure",
        F.format_string("%.1f%%", F.col("success_rate")).alias("success_rate_pct"),
        F.coalesce(top_cause(F.col("failure_causes")), F.lit("—")).alias("top_failure_cause"),
    )


def cause_breakdown(counters: DataFrame) -> DataFrame:
    return counters.select("procedure", F.explode("failure_causes").alias("cause", "n")).orderBy(
        "procedure", F.col("n").desc(), "cause"
    )


def log_head(log: DataFrame, layers: Sequence[str] | None = None, n: int = 200) -> DataFrame:
    rows = log if layers is None else log.where(F.col("layer").isin(list(layers)))
    return rows.orderBy("seen_ts", "seq", "role").limit(n)


