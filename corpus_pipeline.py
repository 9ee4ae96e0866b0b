"""From raw documents to a training mix: five stages, each written as Parquet and read again by the next.

Every stage is one operator of ``radiolake.llm`` with its production parameters; the
document is the knowledge chunk or comment, its source the specification.

All stages keep further columns as they are, whatever their names, and give no rows for an empty table. Null ids are
rows of their own. Repeated rows stay until the near-copy stage, which keeps one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radiolake.llm import decontaminate, language, line_dedup, mixing, near_text
from radiolake.llm.common import free_name
from radiolake.llm.queries import id_fold, table
from radiolake.session import cut_lineage


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents for which no language can be predicted: null texts and texts without a letter.

    The language itself is not a ground to reject, so a table without any labels loses the same documents.
    """
    model = language.fit_languages(docs.where(id_fold(docs.doc_id, 3) != 1), "text", "lang")
    return language.keep_known(docs, model, "text")


def shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines that three or more documents share; n_chars follows the shorter text. A null text comes back as the empty one it is."""
    out = line_dedup.clean_chunks(docs, "doc_id", "text")
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near copies (five-word Jaccard of 0.8 or more), that with the smallest id.

    SimHash links of five-word shingles are confirmed by that Jaccard; an exact join finds the pairs that are out of SimHash's reach.
    Texts without a word, which line dedup may leave, are one class.
    """
    return near_text.one_of_each_text(docs, "doc_id", "text")


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item. Null and empty texts contain none."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"), "text", "item_id", "text")


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, one row each with ``copies``, the times it is taken; documents not taken go.

    Null and empty texts have no words and come with their source's whole copies only. All columns come back as they are; if there is
    a column ``copies`` already, the new one is ``_copies``.
    """
    whole = docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("_row"))
    out = mixing.mix_chunks(whole, "doc_id", "source", "text").where(F.col("copies") > 0)
    return out.select("_row.*", F.col("copies").alias(free_name(docs, "copies")))


STAGES = [
    ("language", known_language),
    ("line dedup", shared_lines),
    ("near copies", near_copies),
    ("decontamination", benchmark_leaks),
    ("mix", target_mix),
]

#: A naive Bayes model and near-copy classes are more than SQL can express; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = cut_lineage(docs, "stage-" + name.replace(" ", "-"))
    return docs
