"""Thin queries: the given tables handed to the corpus operators, and results back under the given names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radiolake.llm import archive, decontaminate, impact_search, language, licences, line_dedup, manifest, mixing, report_text, simhash, toxicity, url_filters, whitening
from radiolake.llm.sql import SQL  # noqa: F401
from radiolake.session import cut_lineage

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks_of(docs: DataFrame) -> DataFrame:
    """Documents seen as knowledge chunks: the source is the specification a chunk belongs to."""
    return docs.select(docs.doc_id.alias("chunk_id"), docs.source.alias("spec"), docs.text.alias("text"))


def comments_of(docs: DataFrame) -> DataFrame:
    """Documents seen as the comments of engineers' feedback records."""
    return docs.select(docs.doc_id.alias("feedback_id"), docs.text.alias("comment"), docs.lang.alias("lang"))


@query
def op1_line_dedup(spark, sf_dir):
    out = line_dedup.drop_repeated_lines(chunks_of(table(spark, sf_dir, "documents")))
    return out.select(F.col("chunk_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query
def op2_mix_sources(spark, sf_dir):
    out = mixing.mix_chunks(chunks_of(table(spark, sf_dir, "documents")))
    return out.select(F.col("chunk_id").alias("doc_id"), "size", "source_size", "target", "taken")


@query
def op10_warc_revisits(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    captures = pages.select(pages.page_id.alias("seq"), pages.url.alias("uri"), pages.html.cast("binary").alias("payload"))
    back = archive.read_archives(spark, *archive.archive_payloads(captures))
    return back.select(
        F.col("seq").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


@query
def op9_simhash(spark, sf_dir):
    out = simhash.near_duplicates(chunks_of(table(spark, sf_dir, "documents")))
    return out.select(F.col("chunk_id").alias("doc_id"), "fingerprint", "component_id")


def id_fold(col, folds: int):
    """Fold of a row: CRC-32 of its id as text."""
    return F.crc32(col.cast("string").cast("binary")) % folds


@query
def op4_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    comments = comments_of(docs)
    model = language.fit_languages(comments.where(id_fold(comments.feedback_id, 3) != 1))
    out = language.predict_languages(comments, model)
    held_out = F.coalesce(id_fold(F.col("feedback_id"), 3) == 1, F.lit(False))
    return out.select(F.col("feedback_id").alias("doc_id"), held_out.alias("held_out"), "lang_pred", "score")


@query
def op5_decontaminate(spark, sf_dir):
    scenarios = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("scenario_id"), F.col("text").alias("description"))
    out = decontaminate.scenario_leaks(chunks_of(table(spark, sf_dir, "documents")), scenarios)
    return out.select(F.col("chunk_id").alias("doc_id"), F.col("scenario_id").alias("item_id"), "edits", "begins", "ends")


@query
def op6_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    labels = labels.where(id_fold(labels.doc_id, 5) != 0).select(labels.doc_id.alias("feedback_id"), labels.toxic.alias("abusive"))
    comments = comments_of(docs)
    learn = comments.where(id_fold(comments.feedback_id, 5) != 0).drop("lang").join(labels.hint("merge"), "feedback_id")  # labels grow with the comments: never broadcast
    out = toxicity.score_comments(comments, toxicity.fit_abuse(learn))
    held_out = F.coalesce(id_fold(F.col("feedback_id"), 5) == 0, F.lit(False))
    return out.select(F.col("feedback_id").alias("doc_id"), held_out.alias("held_out"), "score", "predicted")


@query
def op8_impact_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    vectors = cut_lineage(impact_search.impacts(vectors.select(vectors.vec_id.alias("chunk_id"), "embedding")), "impacts")
    out = impact_search.top_chunks(vectors, vectors.where(F.col("chunk_id") % 50 == 0))
    return out.select("query_id", "rank", F.col("chunk_id").alias("vec_id"), "score")


@query
def op7_html_extraction(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    out = report_text.report_text(pages.select(pages.page_id.alias("report_id"), "url", "html"))
    return out.select(F.col("report_id").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query
def op3_license_scan(spark, sf_dir):
    out = licences.scan_licences(chunks_of(table(spark, sf_dir, "documents")), licences.fit_licences())
    return out.withColumnRenamed("chunk_id", "doc_id")


#: Fixed rules (host, path, verdict).
URL_RULES = "VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow') AS rules(host, path, verdict)"


@query
def op11_url_filters(spark, sf_dir):
    out = url_filters.judge_urls(table(spark, sf_dir, "pages"), spark.sql(f"SELECT * FROM {URL_RULES}"))
    return out.select("page_id", "host", "path", "rule", "verdict")


def records_of(docs: DataFrame) -> DataFrame:
    """Documents seen as feedback records: language as source, source as detector, text as evidence, length as score."""
    return docs.select(
        docs.doc_id.alias("feedback_id"), docs.source.alias("detector"), docs.lang.alias("source"), docs.n_chars.alias("score"),
        docs.text.alias("evidence"),
    )


@query
def op12_merkle_manifest(spark, sf_dir):
    records = records_of(table(spark, sf_dir, "documents"))
    tampered = F.when(id_fold(records.feedback_id, 7) == 0, records.score + 1).otherwise(records.score)
    fields = ["feedback_id", "detector", "source", "score", "evidence"]
    out = manifest.feedback_manifest(records, fields, claimed={"score": tampered})
    return out.withColumnRenamed("feedback_id", "doc_id")


@query
def op13_whitening(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return whitening.whiten_chunks(vectors.select(vectors.vec_id.alias("chunk_id"), "embedding")).withColumnRenamed("chunk_id", "vec_id")
