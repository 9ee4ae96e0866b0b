"""Near copies by word-shingle Jaccard: brute force over all pairs, pairs that four SimHash bits miss, shingles over batches."""

import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from radiolake.llm import near_text, simhash


def sets_of(text):
    words = (text or "").encode().lower().split()
    return frozenset(zip(*(words[i:] for i in range(5)))) or frozenset([tuple(words)])


def classes(texts):
    """Smallest id of each class, by all pairs."""
    root = {k: k for k in texts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    found = {k: sets_of(t) for k, t in texts.items()}
    pairs = [(a, b) for a in found for b in found if a < b and Fraction(len(found[a] & found[b]), len(found[a] | found[b])) >= Fraction(4, 5)]
    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return pairs, {k for k in texts if find(k) == k}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_stage_finds_every_pair_of_similarity_eight_tenths(spark):
    rng = random.Random(3)
    passage = [f"common{i}" for i in range(60)]
    texts = {1: None, 2: "", 3: "one two", 4: "One  TWO", 5: "three", 6: " ".join(passage)}
    for _ in range(40):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(6, 300))]
        for n in (0, 1, 2, 4, 7)[: rng.randint(1, 5)]:
            texts[len(texts) + 1] = edited(rng, base, n)
    for _ in range(30):  # a passage that many share, in texts that are alike or not
        texts[len(texts) + 1] = " ".join([*edited(rng, passage, 1).split(), *(f"own{rng.randrange(10**6)}" for _ in range(rng.choice([2, 8, 20])))])
    pairs, want = classes(texts)
    fp = {k: simhash.fingerprint(t or "") for k, t in texts.items()}
    assert sum((fp[a] ^ fp[b]).bit_count() > 4 for a, b in pairs) > 20  # what the four bits miss
    rows = [(k, t, "x") for k, t in texts.items()] + [(None, "one two", "x")] * 2
    out = corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), "").collect()
    assert {r.doc_id for r in out} == want | {None} and len(out) == len(want) + 2


def test_stage_recall_on_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pairs, want = classes({r.doc_id: r.text for r in docs.collect()})
    assert pairs and {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()} == want


def crossing_pairs(spark, monkeypatch, texts, part):
    """Classes of the texts, and how many pairs had to be confirmed beyond those with a shingle's first node."""
    counted, cut = [], near_text.cut_lineage

    def counting(df, label):
        out = cut(df, label)
        if label == "crossing-pairs":
            counted.append(out.count())
        return out

    monkeypatch.setattr(near_text, "cut_lineage", counting)
    monkeypatch.setattr(near_text, "PART", part)
    out = near_text.one_of_each_text(spark.createDataFrame(list(texts.items()), "chunk_id long, text string"))
    return {r.chunk_id for r in out.collect()}, counted[0]


@pytest.mark.parametrize("many", [300, 1200])
def test_a_shared_passage_makes_no_square(spark, monkeypatch, many):
    passage = " ".join(f"common{i}" for i in range(60))
    texts = {k: passage + " " + " ".join(f"own{k}x{i}" for i in range(10)) for k in range(many)}
    texts |= {many + k: texts[k] + " more" for k in range(20)}  # near copies among them
    kept, pairs = crossing_pairs(spark, monkeypatch, texts, 4096)
    assert kept == set(range(many)) and pairs <= 4 * len(texts)


def test_parts_of_a_shingle_lose_no_pair(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(80)]
    texts = {k: edited(rng, base, rng.randint(0, 9)) for k in range(120)}
    _, want = classes(texts)
    for part in (7, 4096):
        assert crossing_pairs(spark, monkeypatch, texts, part)[0] == want


def test_reach_is_safe():
    """Any two alike sets lie within each other's reach at the first shingle they share in a common order."""
    rng = random.Random(2)
    for _ in range(3000):
        n = rng.randint(1, 40)
        x = sorted(rng.sample(range(60), n))
        y = sorted(set(x) - set(rng.sample(x, rng.randint(0, n // 4))) | set(rng.sample(range(60), rng.randint(0, 3))))
        both = len(set(x) & set(y))
        if both and 5 * both >= 4 * (len(x) + len(y) - both):
            first = min(set(x) & set(y))
            assert len(x) + len(y) <= min(near_text.reach(len(x), x.index(first)), near_text.reach(len(y), y.index(first)))


def test_odd_rows_of_the_stage(spark):
    schema = "doc_id long, text string, node long, key string, root long, _stay_id long, s long, place int, part string"
    more = (1, "k", 2, 3, 4, 5, "p")
    rows = [(1, None), (2, ""), (3, " \n"), (4, "A b"), (5, "a  B"), (6, "x " * 200_000), (6, "x " * 200_000), (7, "x"), (None, "a b"), (None, None), (8, "alone here"), (8, "other text")]
    df = spark.createDataFrame([(*r, *more) for r in rows], schema)
    out = near_text.one_of_each_text(df, "doc_id", "text").collect()
    assert out[0].asDict().keys() == dict(zip(df.columns, df.columns)).keys()
    assert sorted((r.doc_id or 0, len(r.text or "")) for r in out) == [(0, 0), (0, 3), (1, 0), (4, 3), (6, 400_000), (7, 1), (8, 10), (8, 10)]
    assert near_text.one_of_each_text(df.limit(0), "doc_id", "text").count() == 0
    assert near_text.near_text_classes(df, "doc_id").count() == len(rows)


def test_shared_shingles_over_batches():
    rng = random.Random(5)
    rows = sorted((rng.randrange(12), rng.randrange(6), 1, 2) for _ in range(60)) + [(20, 1, 1, 0), (21, 1, 1, 0), (21, 1, 1, 0), (22, 3, 1, 1), (22, 4, 1, 0)]
    nodes = {s: sorted({b for a, b, *_ in rows if a == s}) for s in {r[0] for r in rows}}
    want = sorted((s, b, ns[0]) for s, ns in nodes.items() if len(ns) > 1 for b in ns)
    for size in (1, 2, 3, 7, 100):
        batches = [pa.RecordBatch.from_arrays([pa.array(np.array(x, np.int64)) for x in zip(*rows[k : k + size])], ["s", "node", "n", "place"]) for k in range(0, len(rows), size)]
        got = [(r["s"], r["node"], r["first"]) for b in near_text._shared(iter(batches)) for r in b.to_pylist()]
        assert sorted(got) == want


def test_simhash_links_are_among_the_pairs(spark, monkeypatch):
    """The stage asks the SimHash operator for links, and its links are held against the exact similarity."""
    base = [f"w{i}" for i in range(300)]
    texts = {1: " ".join(base), 2: " ".join([*base, "more"]), 3: " ".join(f"x{i}" for i in range(50))}
    asked, confirmed, links, cut = [], [], near_text.fingerprint_links, near_text.cut_lineage
    monkeypatch.setattr(near_text, "fingerprint_links", lambda df: asked.append(links(df)) or asked[0])

    def counting(df, label):
        out = cut(df, label)
        if label == "star-links":
            confirmed.extend(out.collect())
        return out

    monkeypatch.setattr(near_text, "cut_lineage", counting)
    monkeypatch.setattr(near_text, "_shared", lambda batches: (b.slice(0, 0).append_column("first", b["node"].slice(0, 0)) for b in batches))  # the join finds nothing
    kept = near_text.one_of_each_text(spark.createDataFrame(list(texts.items()), "chunk_id long, text string"))
    assert {r.chunk_id for r in kept.collect()} == {1, 3}
    fp = {k: simhash.fingerprint(t, 5) for k, t in texts.items()}
    assert (fp[1] ^ fp[2]).bit_count() <= 4 and asked and len(confirmed) == 1
