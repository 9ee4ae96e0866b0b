"""The pipeline: every stage against a plain version on its own input."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from radiolake.llm import decontaminate
from radiolake.session import cut_lineage

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of each stage, as rows by doc_id."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(900001, None, "en", "src1", 0), (900002, "123 ?!", "en", None, 6), (900003, "", None, "src2", 0), (900004, "the one and the other of them", None, None, 29)], docs.schema)
    docs = docs.union(odd)
    held = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        docs = cut_lineage(stage(spark, docs, SF), "stage-test")
        held.append(docs.collect())
    return held


def texts(rows):
    return {r.doc_id: r.text for r in rows}


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(zip(*(words[i:] for i in range(5)))) or frozenset([tuple(words)])


def test_language_keeps_all_with_a_letter(stages):
    want = {k: t for k, t in texts(stages[0]).items() if t and any(map(str.isalpha, t))}
    assert texts(stages[1]) == want and 900004 in want


def test_line_dedup_by_hand(stages):
    rows = texts(stages[1])
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(table)
    where = defaultdict(set)
    for k, t in rows.items():
        for line in t.split("\n"):
            if len(key(line)) >= 20:
                where[key(line)].add(k)
    gone = {x: max(ks) for x, ks in where.items() if len(ks) >= 3}
    want = {k: "\n".join(line for line in t.split("\n") if gone.get(key(line), k) == k) for k, t in rows.items()}
    assert texts(stages[2]) == want
    assert all(r.n_chars == len(r.text) for r in stages[2])


def test_near_copies_by_all_pairs(stages):
    """On the stage's own input: one text of each class of all pairs of five-word Jaccard 0.8 or more stays."""
    found = {k: shingle_set(t) for k, t in texts(stages[2]).items()}
    root = {k: k for k in found}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(found)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(found[a] & found[b])
            if 5 * both >= 4 * (len(found[a]) + len(found[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert set(texts(stages[3])) == {k for k in ids if find(k) == k}


def test_leaks_go_and_nothing_else(spark, stages):
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    plain = lambda t: " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split())
    before, after = texts(stages[3]), set(texts(stages[4]))
    bad = {k for k, t in before.items() if any(plain(i) in plain(t) for i in items)}
    near = {k for k in before if decontaminate.leaks_in([before[k]], decontaminate.Index.over(items))}
    assert bad <= near and after == set(before) - near


def test_mix_reaches_its_targets(stages):
    size = {r.doc_id: len(r.text.split()) for r in stages[4]}
    source = {r.doc_id: r.source for r in stages[4]}
    taken = Counter()
    for r in stages[5]:
        assert r.copies in (1, 2)
        taken[r.source] += r.copies * size[r.doc_id]
    total = sum(taken.values())
    largest = max(size.values())
    assert abs(total - 1.5 * sum(size.values())) <= largest * len(set(source.values()))


def test_columns_and_run(spark, stages):
    names = list(stages[0][0].asDict())
    assert all(list(rows[0].asDict()) == names for rows in stages[1:5]) and list(stages[5][0].asDict()) == [*names, "copies"]
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_stages_on_empty_and_clashing_tables(spark):
    """Every stage on no rows, and on rows without labels or benchmark hits, with columns named like the stages' own."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, size int, copies string, taken int, root long, key string, part string"
    more = (1, "c", 2, 3, "k", "p")
    rows = [(1, "Some words of a text", None, "a", 20, *more), (2, None, None, None, None, *more), (3, "12", None, "a", 2, *more), (4, "ein anderer Satz hier", None, None, 21, *more)]
    full = spark.createDataFrame(rows, schema)
    for docs in (full, full.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            docs = cut_lineage(stage(spark, docs, SF), "stage-odd")
            assert docs.columns[: len(full.columns)] == full.columns, name
        out = {r.doc_id: r for r in docs.collect()}
        assert set(out) <= {1, 4} and all((r["size"], r["copies"], r["taken"], r["root"], r["key"], r["part"]) == more for r in out.values())
        assert docs.columns[-1] == "_copies"
