"""Retrieval in parts of bounded size: exact and hashed search, text ranking, and the queries on them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from radiolake.operators import retrieval as R

SF = "/root/testdata/sf0.001"


def vectors(spark, x, name):
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], f"{name} bigint, embedding array<float>")


def top(x, q, k):
    """(query, rank, row) by all products, equal scores to the smaller row."""
    s = np.array([[float((a.astype(float) * b.astype(float)).sum()) for b in x] for a in q])
    return sorted((i, n, int(j)) for i, r in enumerate(s) for n, j in enumerate(np.lexsort((np.arange(len(x)), -r))[:k], 1))


@pytest.fixture
def data():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(230, 16))
    x[40:90] = x[40]  # equal vectors: ties
    return (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)


def found(df):
    return sorted((r.query_id, r["rank"], r.vec_id) for r in df.collect())


def test_parts_and_tiles_give_all_products(spark, data, monkeypatch):
    for name, size in (("QUERY_ROWS", 9), ("PART_ROWS", 50), ("TILE", 4), ("RESCORED", 7)):
        monkeypatch.setattr(R, name, size)
    got = R.cosine_topk(vectors(spark, data[30:60], "query_id"), vectors(spark, data, "vec_id"), 3)
    assert found(got) == top(data, data[30:60], 3)


def test_a_part_gives_k_rows_a_query_on_ties(data):
    of, at, score = R._tile(data[40:42].astype(float), data.astype(float), np.arange(230), None, 3)
    assert of.tolist() == [0, 0, 0, 1, 1, 1] and at.tolist() == [40, 41, 42] * 2 and len(set(score)) == 1


def test_vectors_not_finite_take_no_part(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [0.5, 0.5]), (None, [0.9, 0.0])]
    e = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    q = e.select(F.col("vec_id").alias("query_id"), "embedding").where("vec_id < 5")
    for search in (R.cosine_topk, R.approx_topk):
        assert [(r.query_id, r.vec_id) for r in search(q, e, 5).orderBy("query_id", "rank").collect()] == [(1, 1), (1, None), (1, 5)]


def test_index_holds_rows_against_queries_in_place(spark, data, monkeypatch):
    """Candidates are scored in co-groups of bounded size; no table of pairs is written or shuffled."""
    kept, cut = [], R.cut_lineage
    monkeypatch.setattr(R, "cut_lineage", lambda df, label: kept.append(df._jdf.queryExecution().toString()) or cut(df, label))
    q, e = vectors(spark, data[:20], "query_id"), vectors(spark, data, "vec_id")
    assert found(R.approx_topk(q, e, 3)) == top(data, data[:20], 3)  # here every pair shares a bucket
    assert len(kept) == 1 and "CoGroupsInArrow" in kept[0] and "Join" not in kept[0]


def test_text_ranking_in_many_parts(spark, monkeypatch):
    rng = np.random.default_rng(6)
    words = ["alpha", "beta", "gamma", "delta", "the"]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words, 30))) for i in range(200)] + [(900, None), (901, "")], "doc_id bigint, text string")
    q = spark.createDataFrame([(i, " ".join(rng.choice(words, 3))) for i in range(20)], "query_id bigint, text string")
    rank = lambda: R.bm25_topk(q, docs, 4).orderBy("query_id", "rank").collect()
    whole = rank()
    monkeypatch.setattr(R, "TEXT_PART", 1000)
    monkeypatch.setattr(R, "PAIRS", 500)
    assert rank() == whole and len(whole) == 80


def test_lengths_from_sparse_entries(spark):
    plan = entry_points.queries()["ret3_vectors"](spark, SF)._jdf.queryExecution().toString()
    assert "unwrap_udt" in plan.lower() or "unwrapudt" in plan.lower()


def test_index_answers_labels_and_rows(spark):
    row = entry_points.queries()["ret2"](spark, SF).first()
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    labels, asked = e.select("label").distinct().count(), e.where("vec_id % 50 = 0").count()
    assert row.asDict() == {"recall_reached": True, "n": labels * 5, "rows_recall_reached": True, "n_rows": asked * 5}
