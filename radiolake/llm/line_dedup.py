"""Lines that many knowledge chunks share: page headers, notices, copied boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from radiolake.llm.common import BLANKS, ascii_lower, free_name, text_of
from radiolake.session import cut_lineage


def _lines(df: DataFrame, chunk_id: str, text: str, min_chars: int) -> DataFrame:
    """One row per line that is long enough to count: chunk, version of its text, position, two hashes of the key."""
    rows = df.where(df[chunk_id].isNotNull()).select(
        df[chunk_id].alias("c"), F.xxhash64(text_of(df, text)).alias("v"),
        F.posexplode(F.split(text_of(df, text), "\n", -1)).alias("pos", "line"),
    )
    keyed = rows.select("c", "v", "pos", F.btrim("line", F.lit(BLANKS)).alias("line")).where(
        F.char_length("line") >= min_chars
    )
    key = ascii_lower(F.col("line"))
    return keyed.select("c", "v", "pos", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


def _marked(df: DataFrame, chunk_id: str, text: str, min_chars: int, min_chunks: int) -> tuple[DataFrame, str]:
    """The frame with one more struct column (n_lines, n_dropped, text), and that column's name."""
    c, v, places, all_lines, dropped, out = (free_name(df, n) for n in ("_c", "_v", "_places", "_all_lines", "_dropped", "_line_dedup"))
    lines = _lines(df, chunk_id, text, min_chars)
    # (hash, chunk) is counted before hash alone, so a line that everyone has is spread over the tasks
    shared = (
        lines.groupBy("h1", "h2")
        .agg(F.count_distinct("c").alias("n"), F.max("c").alias("keeper"))
        .where(F.col("n") >= min_chunks)
        .drop("n")
    )
    shared = cut_lineage(shared, "shared-lines")  # read back, the join has a size to go by and can split a common line
    gone = (
        lines.join(shared, ["h1", "h2"])
        .where(F.col("c") != F.col("keeper"))
        .groupBy(F.col("c").alias(c), F.col("v").alias(v))
        .agg(F.collect_set("pos").alias(places))
    )
    joined = df.join(gone, (df[chunk_id] == F.col(c)) & (F.xxhash64(text_of(df, text)) == F.col(v)), "left")
    joined = joined.withColumns(
        {all_lines: F.split(text_of(df, text), "\n", -1), dropped: F.coalesce(places, F.array().cast("array<int>"))}
    )
    # positions left over come from one set difference, so a text of very many lines stays linear
    left = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col(dropped))
    kept: Column = F.when(F.size(dropped) == 0, text_of(df, text)).otherwise(
        F.array_join(F.transform(left, lambda p: F.get(F.col(all_lines), p)), "\n")
    )
    marked = joined.withColumn(
        out,
        F.struct(
            F.size(all_lines).cast("long").alias("n_lines"), F.size(dropped).cast("long").alias("n_dropped"),
            kept.alias("text"),
        ),
    )
    return marked.select(*[df[c] for c in df.columns], F.col(out)), out


def drop_repeated_lines(
    chunks: DataFrame, chunk_id: str = "chunk_id", text: str = "text", min_chars: int = 20, min_chunks: int = 3,
) -> DataFrame:
    """Knowledge chunks without the lines that several chunks share.

    Texts are split at line feeds. The key of a line is the line stripped of
    ASCII white space with A-Z lower-cased; keys of ``min_chars`` code points or
    more that ``min_chunks`` chunks hold lose all their lines except in the chunk
    with the largest id. Returns chunk_id, n_lines, n_dropped, text.

    A null or empty text is one empty line. Rows that share an id count as one
    chunk. Rows without an id keep their text and count for nothing. No rows in,
    no rows out; other columns are ignored.
    """
    marked, out = _marked(chunks.select(chunk_id, text), chunk_id, text, min_chars, min_chunks)
    return marked.select(marked[chunk_id].alias("chunk_id"), F.col(f"{out}.*"))


def clean_chunks(
    chunks: DataFrame, chunk_id: str = "chunk_id", text: str = "text", min_chars: int = 20, min_chunks: int = 3,
) -> DataFrame:
    """``drop_repeated_lines`` in place: all columns of the input, texts shortened (null texts become empty)."""
    marked, out = _marked(chunks, chunk_id, text, min_chars, min_chunks)
    return marked.select(*[F.col(f"{out}.text").alias(c) if c == text else marked[c] for c in chunks.columns])
