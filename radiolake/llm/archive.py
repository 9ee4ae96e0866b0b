"""WARC archives of captured payloads, each distinct large payload stored once."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from radiolake.session import cut_lineage, fresh_path

END = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _boundary(archive: str) -> str:
    """How every record of one archive begins. The archive's id is drawn after the payloads, so none contains it."""
    return f"WARC/1.1{END}WARC-Warcinfo-ID: <urn:uuid:{archive}>{END}"


def _header_value(col: Column) -> Column:
    """A value that cannot end its header line."""
    return F.replace(F.replace(col, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(END)), F.lit(""))


def _revisits(heads: DataFrame, min_bytes: int) -> DataFrame:
    """seq, digest, bytes, original: the captures that repeat the payload of a later one. Only headers are shuffled."""
    large = heads.where(F.col("bytes") >= min_bytes)
    originals = (
        large.groupBy("digest", "bytes").agg(F.max("seq").alias("original"), F.count(F.lit(1)).alias("n"))
        .where((F.col("n") > 1) & F.col("original").isNotNull()).drop("n")
    )
    return large.join(originals, ["digest", "bytes"]).where(~F.col("seq").eqNullSafe(F.col("original"))).distinct()


def archive_payloads(
    captures: DataFrame, seq: str = "seq", payload: str = "payload", uri: str = "uri", min_bytes: int = 1000,
) -> tuple[str, str]:
    """Write captured payloads as WARC/1.1 archives into the shared folder; returns the folder and the archive's id.

    Of captures with equal payloads of at least ``min_bytes``, the one with the
    largest seq becomes a response record and the others revisit records that
    refer to it; smaller payloads are responses. Captures are compared by SHA-1
    and length of the payload. Every record gets fresh headers.

    A null payload is an empty one. A capture without seq is a record without
    WARC-Capture-Seq; it revisits a numbered capture but is never referred to.
    Rows repeated with the same seq and payload are the same kind of record each.
    No rows in: archives without responses. Other columns are ignored.

    The files are written by Spark's text writer, whose final line feed closes
    each record, gzip for the whole file. Only the headers go through the shuffle by
    digest; revisits then meet the payloads by seq, as a broadcast if Spark finds
    their table small enough.
    """
    spark = captures.sparkSession
    body = F.coalesce(captures[payload].cast("binary"), F.lit(b""))
    rows = captures.select(
        captures[seq].alias("seq"), captures[uri].cast("string").alias("uri"), body.alias("payload"),
        F.sha1(body).alias("digest"), F.octet_length(body).cast("long").alias("bytes"),
    )
    revisits = cut_lineage(_revisits(rows.select("seq", "digest", "bytes"), min_bytes), "archive-revisits")
    r = revisits.select(F.col("seq").alias("r_seq"), F.col("digest").alias("r_digest"), F.col("bytes").alias("r_bytes"), "original")
    joined = rows.join(
        r,
        F.col("seq").eqNullSafe(F.col("r_seq")) & (F.col("digest") == F.col("r_digest")) & (F.col("bytes") == F.col("r_bytes")),
        "left",
    )
    archive, date = str(uuid.uuid4()), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    again = F.col("original").isNotNull()
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{END}Content-Type: application/octet-stream{END}Content-Length: "),
        F.col("bytes").cast("string"), F.lit(END + END),
    )
    content = F.when(again, http).otherwise(F.concat(http, F.col("payload").cast("string")))
    ident = lambda c: F.concat(F.lit("<urn:capture:"), c.cast("string"), F.lit(">"))
    record = F.concat(
        F.lit(_boundary(archive)),
        _line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        _line("WARC-Record-ID", F.coalesce(ident(F.col("seq")), F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")))),
        _line("WARC-Date", date),
        _line("WARC-Target-URI", _header_value(F.col("uri"))),
        _line("WARC-Capture-Seq", F.col("seq").cast("string")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _line("WARC-Refers-To", ident(F.col("original"))),
        _line("WARC-Profile", F.when(again, PROFILE)),
        F.lit(f"Content-Type: application/http;msgtype=response{END}"),
        _line("Content-Length", F.octet_length(content).cast("string")),
        F.lit(END), content, F.lit(END + "\r"),
    )
    info = f"software: radiolake{END}format: WARC File Format 1.1{END}"
    first = spark.range(1).select(
        F.concat(
            F.lit(_boundary(archive)), F.lit(f"WARC-Type: warcinfo{END}WARC-Record-ID: <urn:uuid:{archive}>{END}"),
            _line("WARC-Date", date),
            F.lit(f"Content-Type: application/warc-fields{END}Content-Length: {len(info)}{END}{END}{info}{END}\r"),
        ).alias("value")
    )
    folder = fresh_path(spark, "archive")
    first.union(joined.select(record.alias("value"))).write.option("compression", "gzip").text(folder)
    return folder, archive


def read_archives(spark: SparkSession, folder: str, archive: str) -> DataFrame:
    """Records of the archives: seq (as text), uri, record_type, refers_to (as text), payload_digest, payload_bytes, payload.

    A revisit has a null payload; its digest and size are those of the full
    payload. A record whose length or digest differs from its headers ends the read with an error.
    """
    raw = spark.read.option("lineSep", _boundary(archive)).text(folder).where(F.col("value") != "")
    head = F.substring_index("value", END + END, 1)
    rows = raw.select(head.alias("head"), F.expr("substring(value, char_length(substring_index(value, '\\r\\n\\r\\n', 1)) + 5)").alias("rest"))
    field = lambda name: F.nullif(F.regexp_extract("head", rf"(?m)^{name}: ([^\r\n]*)", 1), F.lit(""))
    rows = rows.select(
        "rest", field("WARC-Type").alias("record_type"), field("WARC-Capture-Seq").alias("seq"),
        field("WARC-Target-URI").alias("uri"), field("WARC-Refers-To").alias("refers"),
        F.substring_index(field("WARC-Payload-Digest"), ":", -1).alias("payload_digest"),
        field("Content-Length").cast("long").alias("length"),
    ).where(F.col("record_type").isin("response", "revisit"))
    http = F.substring_index("rest", END + END, 1)
    size = F.regexp_extract(http, r"Content-Length: (\d+)", 1).cast("long")
    rows = rows.select(
        "seq", "uri", "record_type", F.regexp_extract("refers", r"<urn:capture:(.*)>", 1).alias("refers_to"),
        "payload_digest", size.alias("payload_bytes"), (F.octet_length("rest") - 4 - F.col("length")).alias("excess"),
        F.when(
            F.col("record_type") == "response",
            F.expr("substring(rest, char_length(substring_index(rest, '\\r\\n\\r\\n', 1)) + 5)"),
        ).alias("body"),
    )
    payload = F.expr("substring(body, 1, char_length(body) - 4)").cast("binary")
    rows = rows.withColumn("payload", payload)
    sound = (F.col("excess") == 0) & (
        F.col("payload").isNull()
        | ((F.octet_length("payload") == F.col("payload_bytes")) & (F.sha1("payload") == F.col("payload_digest")))
    )
    return rows.select(
        "seq", "uri", F.when(sound, F.col("record_type")).otherwise(F.raise_error(F.lit("damaged WARC record"))).alias("record_type"),
        F.nullif("refers_to", F.lit("")).alias("refers_to"), "payload_digest", "payload_bytes", "payload",
    )
