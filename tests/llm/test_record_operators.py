"""Address rules, record manifests and whitening: brute force, odd rows, empty tables, clashing names."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from radiolake.llm import manifest, url_filters, whitening

# address rules

PAGES = "page_id long, url string, rule string, token string, n long"
RULES = "host string, path string, verdict string"


def judged(url, rules):
    found = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (found[1], found[2]) if found else ("", "")
    host = "".join(c.lower() if c.isascii() else c for c in host)
    best = None
    for h, p, v in rules:
        h, p = h or "", p or ""
        part = lambda t, star: ".*".join(map(re.escape, t.split("*"))) if star else re.escape(t)
        hosts = "[^/]*".join(map(re.escape, h.lower().split("*")))
        if re.match(rf"(?s)(?:[^/]*\.)?{hosts}(?![^/]){part(p, True)}", host + path):
            best = max(best or (-1, "", ""), (len(h + p), h.lower() + p, v))
    return host, path, best[1] if best else None, best[2] if best else "allow"


@pytest.mark.parametrize("broadcast_rules", [1000, 0])
def test_urls_are_judged_as_by_every_rule(spark, broadcast_rules):
    rng = random.Random(1)
    hosts = ["example.com", "a.example.com", "EXAMPLE.net", "ample.com", "net", "xnet", "a.b.net", "org", "ü.org", "", "a.example.com:80", "ads.de"]
    paths = ["", "/", "/en", "/en/", "/english/1", "/de/a/b", "/de/a?x=/en/", "/fr/#/de/", "/a.b*c/(d)/\\E[", "/\n/en/"]
    urls = [f"{rng.choice(['http', 'https', 'x://y'])}://{h}{p}" for h in hosts for p in paths] + [None, "", "nothing", "://", "a://b://c/d", "http://" + "q/" * 50_000]
    rules = [
        ("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("Example.com", "/en", "block"), ("com", "", "allow"),
        ("ads.*", "/*/1", "block"), ("*", "/a.b*c/", "block"), ("ü.org", None, "block"), ("example.com", "/a.b*c/(d)/\\E[", "block"), ("ample.com", "/en", "block"), ("ample.com", "/en", "allow"),
        ("*mple.com", "/english/", "block"), ("net", "/", "block"),
    ]
    rows = [(k, u, "x", "y", 1) for k, u in enumerate(urls)] + [(None, urls[3], "x", "y", 1), (3, urls[3], "x", "y", 1), (None, None, None, None, None)]
    out = url_filters.judge_urls(spark.createDataFrame(rows, PAGES).repartition(3), spark.createDataFrame(rules, RULES), broadcast_rules=broadcast_rules)
    assert out.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    got = sorted((r.page_id or -1, *(x or "" for x in r[2:])) for r in out.collect())
    want = sorted((k or -1, *(x or "" for x in judged(u, rules))) for k, u, *_ in rows)
    assert got == want


def test_urls_without_rules_or_rows(spark):
    none, pages = spark.createDataFrame([], RULES), spark.createDataFrame([(1, "http://a/b", None, None, 0)] * 2, PAGES)
    assert [tuple(r)[2:] for r in url_filters.judge_urls(pages, none).collect()] == [("a", "/b", None, "allow")] * 2
    assert url_filters.judge_urls(pages.limit(0), none).count() == 0


def test_rules_wait_under_their_rarest_token(spark):
    targets = spark.createDataFrame([("a.net/en/x",)] * 5 + [("b.net/de/rare/",)], "target string")
    rules = url_filters.compiled(spark.createDataFrame([("net", "/rare/", "block"), ("net", "/en/x", "block"), ("b.net", "/", "allow"), ("*", "/q", "block")], RULES))
    found = {r.rule: r.token for r in url_filters.rule_index(rules, targets, True).collect()}
    assert found == {"net/rare/": "rare", "net/en/x": "en", "b.net/": "b", "*/q": ""}


# manifests

def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def shown(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def way(tree, at, fanout):
    out = []
    for nodes in tree[:-1]:
        low = at - at % fanout
        out.append((nodes[low:at], nodes[at + 1 : low + fanout]))
        at //= fanout
    return out


def expected(rows, fields, claims, fanout):
    """Per row (in its sorted place): leaf, subroot, root, proof, folded."""
    leaf = lambda r: h(*[shown(r[f]) for f in fields])
    groups = {}
    for r in rows:
        said = {**r, **{f: c(r) for f, c in claims.items()}}
        groups.setdefault(r["source"], []).append((r["feedback_id"], leaf(r), leaf(said)))
    key = lambda x: (x is not None, x if x is not None else 0)
    for g in groups.values():
        g.sort(key=lambda x: (key(x[0]), x[1], x[2] if x[2] != x[1] else ""))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[1] for x in groups[s]], fanout) for s in names}
    top = levels([trees[s][-1][0] for s in names], fanout) if names else []
    out = []
    for k, s in enumerate(names):
        for i, (ident, true, said) in enumerate(groups[s]):
            path = way(trees[s], i, fanout) + way(top, k, fanout)
            node = said
            for left, right in path:
                node = h(*left, node, *right)
            out.append((ident, true, trees[s][-1][0], top[-1][0], h(*[d for a, b in path for d in a + b]), node, node == top[-1][0]))
    return out


SCHEMA = "feedback_id long, source string, verdict string, score long, part string, pos long, leaf string, root string"


@pytest.mark.parametrize("fanout,block", [(2, 4), (3, 9), (2, 1), (4, 64)])
def test_manifest_is_the_plain_tree(spark, fanout, block):
    rng = random.Random(fanout)
    rows = [(k, rng.choice(["kpi"] * 6 + ["stats", "pcap", None, "", "ü", "Z"]), rng.choice(["a", None, "", "long " * 3000]), rng.choice([1, None])) for k in range(90)]
    rows += [(5, "kpi", "again", 2), (5, "kpi", "again", 2), (None, "kpi", None, None), (None, None, None, None), (-7, "alone", "x", 1)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "p", 1, "l", "r") for r in rows], SCHEMA).repartition(5)
    fields = ["feedback_id", "source", "verdict", "score"]
    changed = F.when(df.feedback_id % 7 == 0, df.score + 1).otherwise(df.score)
    out = manifest.feedback_manifest(df, fields, claimed={"score": changed}, fanout=fanout, block=block)
    assert out.columns == ["feedback_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    plain = [dict(zip(["feedback_id", "source", "verdict", "score"], r)) for r in rows]
    claim = {"score": lambda r: r["score"] + 1 if r["score"] is not None and r["feedback_id"] is not None and r["feedback_id"] % 7 == 0 else r["score"]}
    want = expected(plain, fields, claim, fanout)
    order = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, out.collect()), key=order) == sorted(want, key=order)
    assert any(not r[-1] for r in want) and any(r[-1] for r in want)


@pytest.mark.parametrize("count", [0, 1, 2, 3, 5, 8, 9])
def test_manifest_of_few_records(spark, count):
    rows = [(k, "s", "v", 1, None, None, None, None) for k in range(count)]
    out = manifest.feedback_manifest(spark.createDataFrame(rows, SCHEMA), ["feedback_id", "verdict"], block=2)
    want = expected([{"feedback_id": k, "source": "s", "verdict": "v"} for k in range(count)], ["feedback_id", "verdict"], {}, 2)
    assert sorted(map(tuple, out.collect())) == sorted(want)


def test_feedback_store_records_and_other_order(spark):
    """The store's own twelve text fields; subtrees follow the source and ids are texts."""
    rows = [tuple(f"{f}{k}" if f != "source" else ["kpi", "stats"][k % 2] for f in manifest.FEEDBACK_FIELDS) for k in range(12)]
    df = spark.createDataFrame(rows, ", ".join(f"{f} string" for f in manifest.FEEDBACK_FIELDS))
    out = {r.feedback_id: r for r in manifest.feedback_manifest(df).collect()}
    assert len(out) == 12 and all(r.verified for r in out.values()) and len({r.subroot for r in out.values()}) == 2
    assert out["feedback_id3"].leaf == h(*map(shown, rows[3]))


# whitening

def pairs_of(rng, n):
    a = rng.standard_normal((n, n))
    q = np.linalg.qr(a)[0]
    yield a @ a.T
    yield np.diag(np.arange(n, 0, -1.0))
    yield np.zeros((n, n))
    yield q @ np.diag(np.repeat([3.0, 3.0 - 1e-12, 1.0], n)[:n]) @ q.T
    low = rng.standard_normal((n, max(1, n // 4)))
    yield low @ low.T * 1e9


@pytest.mark.parametrize("n", [1, 2, 3, 4, 17, 64])
def test_leading_pairs(n):
    rng = np.random.default_rng(n)
    for a in pairs_of(rng, n):
        a = (a + a.T) / 2
        values, vectors = whitening.leading_pairs(a, 16)
        want = np.linalg.eigvalsh(a)[::-1][:16]
        size = max(np.abs(want).max(), 1e-300)
        assert np.abs(values - want).max() <= 1e-13 * size and (np.diff(values) <= 1e-15 * size).all()
        assert np.abs(a @ vectors - vectors * values).max() <= 1e-13 * size
        assert np.abs(vectors.T @ vectors - np.eye(vectors.shape[1])).max() < 1e-12


def test_sturm_counts():
    rng = np.random.default_rng(3)
    diag, off = rng.standard_normal(30), rng.standard_normal(29)
    off[[4, 20]] = 0
    values = np.linalg.eigvalsh(np.diag(diag) + np.diag(off, 1) + np.diag(off, -1))
    at = np.concatenate([(values[1:] + values[:-1]) / 2, [-100, 100]])
    assert (whitening.below(diag, off, at) == [(values < x).sum() for x in at]).all()


VECTORS = "chunk_id string, embedding array<float>, x long, component int, id string"


def plainly(vectors):
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for v in vectors], np.int64)
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    centred = (n * fit - total) / n
    values, turn = np.linalg.eigh(centred.T @ centred / n)
    values, turn = values[::-1], turn[:, ::-1]
    return n, (n * x - total), values, turn


def test_whitening_by_plain_numpy(spark):
    rng = np.random.default_rng(5)
    mixed = rng.standard_normal((20, 20)) / 8
    vectors = [list(map(float, v)) for v in rng.standard_normal((300, 20)) @ mixed]
    rows = [(f"c{k}", v) for k, v in enumerate(vectors)] + [("c0", vectors[0])] * 3 + [(None, vectors[1])] + [(f"copy{k}", vectors[2]) for k in range(200)]
    bad = [("n", None), ("h", [None] + vectors[0][1:]), ("i", [float("inf")] + vectors[0][1:]), ("q", [float("nan")] + vectors[0][1:]), ("far", [1e30] + vectors[0][1:])]
    out = whitening.whiten_chunks(spark.createDataFrame([(*r, 1, 2, "z") for r in rows + bad], VECTORS).repartition(4))
    assert out.columns == ["chunk_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    n, off, values, turn = plainly([v for _, v in rows])
    got = out.collect()
    assert len(got) == len(rows) * 16 and {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-10
    z, deviation = off / n @ turn[:, :16] / np.sqrt(values[:16]), (off * off).sum(axis=1)
    place = {name: k for k, (name, _) in reversed(list(enumerate(rows)))}
    sign = {}
    for r in got:
        k, c = place[r.chunk_id], r.component - 1
        assert r.deviation == deviation[k] and abs(r.explained - values[c] / values.sum()) < 1e-12
        if abs(z[k, c]) > 0.5:
            assert sign.setdefault(c, np.sign(r.whitened * z[k, c])) == np.sign(r.whitened * z[k, c])
        assert abs(abs(r.whitened) - abs(z[k, c])) < 1e-9


def test_whitening_of_odd_tables(spark):
    def rows(vectors):
        return whitening.whiten_chunks(spark.createDataFrame([(str(k), v, 0, 0, "") for k, v in enumerate(vectors)], VECTORS)).collect()

    assert rows([]) == [] and rows([None]) == [] and rows([[1.0, 2.0]]) == [] and rows([[1.0, 2.0]] * 5) == [] and rows([[], []]) == []
    flat = rows([[0.0, 5.0], [1.0, 5.0], [2.0, 5.0]])  # one direction only
    assert {r.component for r in flat} == {1} and len(flat) == 3 and flat[0].explained == 1.0 and flat[0].identity_error < 1e-12
    ragged = rows([[1.0], [1.0, 0.0], [0.0, 1.0], [3.0, 2.0], []])  # filled with zeros: the first two are equal
    assert {r.n for r in ragged} == {4} and len(ragged) == 10
    first = [[r.whitened for r in ragged if r.chunk_id == k] for k in "01"]
    assert first[0] == first[1]
