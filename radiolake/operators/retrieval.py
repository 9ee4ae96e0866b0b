"""Top-k retrieval: exact cosine, approximate cosine, BM25 text ranking."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from radiolake.functions.columns import rnd, row_of
from radiolake.session import cut_lineage

QUERY_ROWS = 8192
PART_ROWS = 8192
TILE = 128  # queries of a block that are scored against a part at a time
RESCORED = 1 << 16
TEXT_PART = 8 << 20
PAIRS = 1 << 20
MOST = 20_000  # parts
WORD = r"[\p{L}\p{N}]+"


def _sound(df: DataFrame) -> DataFrame:
    """Rows whose vector is given and all finite; no other has an inner product."""
    x = F.col("embedding")
    return df.where(x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))))


def _matrix(column: pa.ChunkedArray, kind: type = np.float64) -> np.ndarray:
    lists = pa.concat_arrays(column.chunks)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(lists), -1)


def _tile(q: np.ndarray, x: np.ndarray, ids: np.ndarray, allowed: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the k best rows of a part for each query, equal scores to the smaller id.

    The product picks the rows that may be among the best; its last digits depend on where a row lies, so
    those are scored again row by row, and equal vectors have equal scores.
    """
    s = q @ x.T
    if allowed is not None:
        s[~allowed] = -np.inf
    slack = 1e-9 * np.sqrt((q * q).sum(axis=1)) * np.sqrt((x * x).sum(axis=1).max(initial=0)) + 1e-12
    least = np.partition(s, len(x) - k, axis=1)[:, len(x) - k] if len(x) > k else np.full(len(q), -np.inf)
    of, at = np.nonzero((s >= (least - slack)[:, None]) & (s > -np.inf))
    score = np.concatenate([np.zeros(0)] + [(q[of[i : i + RESCORED]] * x[at[i : i + RESCORED]]).sum(axis=1) for i in range(0, len(of), RESCORED)])
    order = np.lexsort((ids[at], -score, of))
    of, at, score = of[order], at[order], score[order]
    place = np.arange(len(of)) - np.searchsorted(of, of)
    return of[place < k], at[place < k], score[place < k]


def _best(candidates: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = candidates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", "vec_id", rnd("score", 4).alias("score"), "rank")


RESULT = "query_id bigint, vec_id bigint, score double"


def _met(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """The k best rows for each query, of all rows or, where rows and queries carry ``h``, of those that share an entry of it at its place.

    Blocks of about ``QUERY_ROWS`` queries meet parts of about ``PART_ROWS`` rows in co-groups, a ``TILE`` of queries at a time, so a
    task holds one block, one part and the scores of a tile whatever the input, and each part gives back k rows per query.
    Rows are shuffled once per block and queries once per part; no pair is.
    """
    hashed = ["h"] if "h" in corpus.columns else []
    queries, corpus = _sound(queries), _sound(corpus)
    blocks = max(1, math.ceil(queries.count() / QUERY_ROWS))
    parts = max(1, math.ceil(corpus.count() / PART_ROWS))
    own = F.col("embedding").alias("embedding")  # queries and rows may be of one table
    q = queries.select("query_id", own, *hashed, F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("b"))
    q = q.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<bigint>")))
    c = corpus.select("vec_id", "embedding", *hashed, F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(parts)).alias("p"))
    c = c.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            asked, x = _matrix(left["embedding"]), _matrix(right["embedding"])
            hq, hx = (_matrix(t["h"], np.int32) if hashed else None for t in (left, right))
            ids = right["vec_id"].to_pandas().fillna(-(1 << 63)).to_numpy(np.int64)  # no id comes first, as in Spark
            for i in range(0, len(asked), TILE):
                allowed = None
                if hashed:
                    allowed = np.zeros((len(asked[i : i + TILE]), len(x)), bool)
                    for t in range(hx.shape[1]):
                        allowed |= hq[i : i + TILE, t][:, None] == hx[:, t]
                of, at, score = _tile(asked[i : i + TILE], x, ids, allowed, k)
                out.append(pa.table([left["query_id"].take(pa.array(of + i)), right["vec_id"].take(pa.array(at)), pa.array(score)], ["query_id", "vec_id", "score"]))
        kind = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        return pa.concat_tables([t.cast(kind) for t in out]) if out else kind.empty_table()

    return _best(q.groupBy("p", "b").cogroup(c.groupBy("p", "b")).applyInArrow(search, RESULT), k)


def cosine_topk(queries: DataFrame, corpus: DataFrame, k: int = 5) -> DataFrame:
    """Exact inner-product top-k of unit vectors (query_id, embedding) x (vec_id, embedding).

    Every row is scored for every query, in co-groups of bounded size (see ``_met``). The plan is the same for
    ten queries and for ten million. Vectors that are null or not finite take no part.
    """
    return _met(queries.select("query_id", "embedding"), corpus.select("vec_id", "embedding"), k)


def approx_topk(queries: DataFrame, corpus: DataFrame, k: int = 5, bucket: float = 0.25, tables: int = 12, seed: int = 42) -> DataFrame:
    """Approximate top-k by random-projection hashing (MLlib); candidates share a bucket in some table.

    ``bucket`` is about the spread of a unit vector of 64 components on a random line, so a
    table has several buckets. Every row carries its buckets, a number a table, and rows are held against the queries where they
    lie: a candidate pair is scored and forgotten, never written or shuffled. A query that
    meets fewer than k candidates is answered by ``cosine_topk`` instead.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    queries, corpus = _sound(queries), _sound(corpus)
    vec = lambda df, i: df.select(i, "embedding", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    lsh = BucketedRandomProjectionLSH(inputCol="v", outputCol="hashes", bucketLength=bucket, numHashTables=tables, seed=seed)
    model = lsh.fit(vec(corpus, "vec_id"))
    number = lambda h: F.unwrap_udt(h)["values"][0].cast("int")
    hashed = lambda df, i: model.transform(vec(df, i)).select(i, "embedding", F.transform("hashes", number).alias("h"))
    found = cut_lineage(_met(hashed(queries, "query_id"), hashed(corpus, "vec_id"), k), "near-vectors")
    full = found.where(F.col("rank") == k).select("query_id")
    return found.join(full, "query_id", "left_semi").unionByName(cosine_topk(queries.join(full, "query_id", "left_anti"), corpus, k))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _terms(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(F.array_distinct(words(F.col("text")))).alias("term"))


def _idf(n_docs: Column) -> Column:
    return F.log((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)


def bm25_topk(queries: DataFrame, docs: DataFrame, k: int = 5, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """BM25 ranking of whole documents (doc_id, text) for queries (query_id, text), all in joins and sums.

    One pass cuts the texts into words and keeps, per document, the counts of words
    that some query has; the empty word, which no text has, stands for the document
    itself and gives the number of documents and their mean length. Texts are dealt by document into
    parts of about ``TEXT_PART`` bytes, and postings into parts of about ``PAIRS`` (query, document) pairs, so a
    document is counted and scored in one task, tasks grow in number and not in size, and each part hands on k rows a query.
    Weights are one row per query and word.
    """
    terms = cut_lineage(_terms(queries), "query-terms")
    vocab = terms.select("term").union(docs.sparkSession.createDataFrame([("",)], "term string")).distinct()
    size, n_queries = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0, queries.count()
    whole = docs.select("doc_id", "text").repartition(max(1, min(MOST, math.ceil(size / TEXT_PART))), "doc_id")
    sized = whole.select("doc_id", words(F.col("text")).alias("w"))
    each = sized.select("doc_id", F.size("w").alias("len"), F.explode(F.array_append("w", F.lit(""))).alias("term"))
    each = each.join(cut_lineage(vocab, "query-words"), "term", "left_semi")
    tf = cut_lineage(each.groupBy("doc_id", "len", "term").agg(F.count(F.lit(1)).alias("tf")), "postings")
    held = tf.where("term = ''")
    stats = row_of(held.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len")))
    df = tf.where("term <> ''").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weights = terms.join(df, "term").withColumn("_st", stats)
    weights = cut_lineage(weights.select("query_id", "term", _idf(F.col("_st.n")).alias("idf"), F.col("_st.avg_len").alias("avg_len")), "query-weights")
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    tf = tf.where("term <> ''").repartition(max(1, min(MOST, math.ceil(held.count() * n_queries / PAIRS))), "doc_id")
    scores = tf.join(weights, "term").groupBy("query_id", "doc_id").agg(F.sum(part).alias("raw"))
    w = Window.partitionBy("query_id").orderBy(rnd("raw", 6).desc(), "doc_id")
    ranked = scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", "doc_id", rnd("raw", 4).alias("score"), "rank")


def tfidf_vectors(docs: DataFrame, buckets: int = 1 << 16) -> DataFrame:
    """Hashed TF-IDF vectors of unit length (MLlib)."""
    from pyspark.ml.feature import IDF, HashingTF, Normalizer

    tf = HashingTF(inputCol="w", outputCol="tf", numFeatures=buckets).transform(docs.select("doc_id", words(F.col("text")).alias("w")))
    scaled = IDF(inputCol="tf", outputCol="tfidf").fit(tf).transform(tf)
    return Normalizer(inputCol="tfidf", outputCol="vector").transform(scaled).select("doc_id", "vector")
