"""Archives, report pages and exact search: round trips, brute force, odd cases."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from radiolake.llm import archive, impact_search, report_text

# archives

CAPTURE = "seq long, uri string, payload binary, digest string, bytes string, value string"


def captures(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x") for r in rows], CAPTURE)


def test_archives_round_trip(spark):
    big, small = b"PAYLOAD\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\n" * 40, b"tiny \xc3\xa9\x00\r\n\r\n"
    rows = [
        (1, "http://h/a", big), (2, "http://h/b", big), (9, "http://h/c\r\nWARC-Type: evil", big), (3, None, small), (4, "u", small), (5, "u", None), (6, "u", b""),
        (None, "u", big), (None, "u", None), (9, "http://h/c", big), (7, "u", b"z" * 1000), (8, "u", b"z" * 1000), (10, "u", b"y" * 999), (11, "u", b"y" * 999),
        (12, "u", b"L" * 3_000_000),
    ]
    folder, ident = archive.archive_payloads(captures(spark, rows).repartition(4))
    back = archive.read_archives(spark, folder, ident).collect()
    assert len(back) == len(rows)
    got = sorted((r.seq or "", r.record_type, r.refers_to or "", r.payload_bytes, r.payload_digest) for r in back)
    keeper = {big: 9, b"z" * 1000: 8}
    want = []
    for seq, _, p in rows:
        p = p or b""
        revisit = p in keeper and seq != keeper[p]
        want.append((str(seq or ""), "revisit" if revisit else "response", str(keeper[p]) if revisit else "", len(p), hashlib.sha1(p).hexdigest()))
    assert got == sorted(want)
    whole = {r.seq: bytes(r.payload) for r in back if r.payload is not None}
    assert whole["9"] == big and whole["3"] == small and whole["12"] == b"L" * 3_000_000 and whole["5"] == b""
    assert {r.uri for r in back if r.seq == "9"} == {"http://h/c", "http://h/c%0D%0AWARC-Type: evil"}


def test_archives_without_captures_and_without_numbers(spark):
    assert archive.read_archives(spark, *archive.archive_payloads(captures(spark, []))).count() == 0
    back = archive.read_archives(spark, *archive.archive_payloads(captures(spark, [(None, None, b"n" * 2000)] * 3))).collect()
    assert [(r.seq, r.record_type) for r in back] == [(None, "response")] * 3


def test_archive_files_are_warc(spark):
    folder, ident = archive.archive_payloads(captures(spark, [(1, "http://h/a", b"abc")]).coalesce(1))
    text = "".join(r.value for r in spark.read.option("lineSep", "\x01").text(folder).collect())
    records = [r for r in text.split("WARC/1.1\r\n") if r]
    assert len(records) == 2
    for r in records:
        head, _, rest = r.partition("\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.split("\r\n"))
        assert rest[int(fields["Content-Length"]) :] == "\r\n\r\n"


# report pages

PAGE = (
    "<html><head><title>T</title><style>p{{}}</style></head><body><header class='top'>Site</header><nav><ul><li>Home<li>Alarms</ul></nav>"
    "<div class='cookie-notice'>We use cookies</div><div id=content><div class=intro>Network report service</div><h2>{head}</h2><p>{one}<p>{two} &amp; more</div>"
    "<div class='comments'><p>nice</p></div><footer>&copy; x</footer></body></html>"
)
SCHEMA = "report_id long, url string, html string, host string, wrapper string, constant string"


def reports(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x") for r in rows], SCHEMA)


def test_constant_slots_are_template(spark):
    rows = [(k, f"http://ran.example/{k}", PAGE.format(head=f"Cell {k}", one=f"PRB at {k} %", two="  drop\n rate ")) for k in range(12)]
    out = {r.report_id: r.text for r in report_text.report_text(reports(spark, rows)).collect()}
    # the intro and the second paragraph are the same on all pages of the host
    assert out == {k: f"Cell {k} PRB at {k} %" for k in range(12)}


def test_copies_make_nothing_constant(spark):
    rows = [(k, "http://ran.example/", PAGE.format(head="Cell", one="PRB", two="drop")) for k in range(12)]
    out = {r.text for r in report_text.report_text(reports(spark, rows)).collect()}
    assert out == {"Network report service Cell PRB drop & more"}


def test_teaser_article_is_not_the_text(spark):
    page = (
        "<html><body><div class=top>Network report service, all regions, all cells, all counters of the week</div><div id=content><h2>Cell {0}</h2>"
        "<p>PRB use rose to {0} percent after the swap of sector {0}</p></div><article><p>See {0}</p></article></body></html>"
    )
    rows = [(k, f"http://teaser.example/{k}", page.format(k)) for k in range(12)]
    framed = "<html><body><div>Network report service, all regions, all cells, all counters</div><article><p>Cell {0} is up</p></article></body></html>"
    rows += [(100 + k, f"http://framed.example/{k}", framed.format(k)) for k in range(12)]
    out = {r.report_id: r.text for r in report_text.report_text(reports(spark, rows)).collect()}
    want = {k: f"Cell {k} PRB use rose to {k} percent after the swap of sector {k} See {k}" for k in range(12)}
    assert out == want | {100 + k: f"Cell {k} is up" for k in range(12)}  # the long line outside is template there


def test_template_of_each_layout_of_a_host(spark):
    one = "<html><body><div class=top>All regions</div><div class=main><p>Cell {0} report</p></div><div class=legal>Terms of use</div></body></html>"
    two = "<html><body><section class=lead>Weekly view</section><section class=body><h2>Site {0}</h2><p>Load of {0}</p></section><section class=end>Terms</section></body></html>"
    rows = [(k, f"http://two.example/{k}", (one if k % 2 else two).format(k)) for k in range(24)]
    out = {r.report_id: r.text for r in report_text.report_text(reports(spark, rows)).collect()}
    assert out == {k: f"Cell {k} report" if k % 2 else f"Site {k} Load of {k}" for k in range(24)}


def test_pages_odd_cases(spark):
    article = "<p>menu</p><article><header><h1>A&#233; <b>b</b>c</h1></header><p>x<br>y<script>if (a < b) '</p>'</script> z<aside>not</aside><p>end</article><p>tail"
    rows = [
        (1, None, None), (2, "", ""), (3, "odd url", "plain text &lt;b&gt;"), (4, "http://a/", article), (5, "http://a/", "<p>" * 3000 + "deep" + "<div>" * 3000 + "er"),
        (6, "http://a/", "<p>a<!-- c --> b<p title='>'>c <unclosed"), (None, "http://a/", "<p>n"), (7, "http://a/", "<p>" + "long " * 200_000), (7, "http://a/", "<p>twice"),
    ]
    out = sorted(((r.report_id or 0, r.text) for r in report_text.report_text(reports(spark, rows)).collect()), key=str)
    got = dict(out)
    assert len(out) == len(rows)
    assert got[0] == "n" and got[1] == got[2] == "" and got[3] == "plain text <b>"
    assert got[4] == "Aé bc x y z end"
    assert got[5] == "deep er" and got[6].startswith("a b c")
    assert len([t for k, t in out if k == 7]) == 2 and max(len(t) for _, t in out) == 200_000 * 5 - 1
    assert report_text.report_text(reports(spark, [])).count() == 0


def brute_match(a, b):
    """Simple tree matching by its recursion."""
    la, ca = report_text._tree(a)
    lb, cb = report_text._tree(b)

    def w(x, y):
        if la[x] != lb[y]:
            return 0
        m = [[0] * (len(cb[y]) + 1) for _ in range(len(ca[x]) + 1)]
        for i, p in enumerate(ca[x], 1):
            for j, q in enumerate(cb[y], 1):
                m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + w(p, q))
        return 1 + m[-1][-1]

    return w(0, 0)


def test_tree_matching_is_largest():
    rng = random.Random(4)

    def tree(depth):
        return [rng.choice("abc"), [tree(depth - 1) for _ in range(rng.randint(0, 3))] if depth else []]

    def lines(node, depth=0):
        return [f"{depth} {node[0]}", *(x for c in node[1] for x in lines(c, depth + 1))]

    for _ in range(80):
        a, b = ("\n".join(lines(["r", [tree(2) for _ in range(3)]])) for _ in range(2))
        match = report_text.simple_tree_matching(a, b)
        assert len(match) == brute_match(a, b)
        la, lb = report_text._tree(a)[0], report_text._tree(b)[0]
        assert all(la[x] == lb[y] for x, y in match.items()) and len(set(match.values())) == len(match)


# exact search


def brute_top(vectors, queries, k=5):
    out = []
    for q, v in queries.items():
        best = sorted((-int(np.dot(v, w)), c) for c, w in vectors.items() if c != q)[:k]
        out += [(q, n, c, -s) for n, (s, c) in enumerate(best, 1)]
    return sorted(out)


def test_search_equals_all_products(spark, monkeypatch):
    monkeypatch.setattr(impact_search, "BLOCK", 120)
    monkeypatch.setattr(impact_search, "ASKED", 7)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    x = np.concatenate([centres[rng.integers(0, 12, 300)] + rng.normal(size=(300, 16)) * s for s in (0.05, 1.0)])
    x[100:160] = x[100]  # many equal vectors: ties
    df = spark.createDataFrame([(k, v.tolist(), "x") for k, v in enumerate(x)], "chunk_id long, embedding array<double>, v string")
    vectors = impact_search.impacts(df)
    whole = {k: np.floor(256 * v).astype(int) for k, v in enumerate(x)}
    got = impact_search.top_chunks(vectors, vectors.where("chunk_id % 20 = 0")).collect()
    assert sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in got) == brute_top(whole, {k: v for k, v in whole.items() if k % 20 == 0})


def test_search_stops_early_where_it_can():
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(3000, 32)) * 40).astype(np.int64)
    q = x[:20].copy()
    near = np.concatenate([q + rng.integers(-3, 4, q.shape) for _ in range(8)])
    x = np.concatenate([x, near])
    index = impact_search.Index(x)
    used = []
    index.segments = [Counted(s, used) for s in index.segments]
    found = impact_search.search(index, np.arange(len(x)), q, np.arange(20), 5)
    assert {n: i.tolist() for n, i, _ in found} == {n: [c for _, _, c, _ in brute_top({k: v for k, v in enumerate(x)}, {n: q[n]})] for n in range(20)}
    assert len(used) < impact_search.LEVELS


def test_a_level_is_one_segment():
    """The levels between two tries are added in one product, not dimension by dimension."""
    x = np.array([[3, -160, 0], [160, 80, -5]])
    index = impact_search.Index(x)
    assert len(index.segments) == impact_search.LEVELS and all(len(s) == 1 for s in index.segments)
    known = sum(impact * sign for s in index.segments for impact, sign in s)
    assert np.allclose(np.sqrt(((x - known) ** 2).sum(axis=1)), index.residual[0]) and np.abs(x - known).max() <= index.step / 2


class Counted(list):
    def __init__(self, items, used):
        super().__init__(items)
        self.used = used

    def __iter__(self):
        self.used.append(1)
        return super().__iter__()


def test_search_odd_cases(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [0.5]), (5, [0.5]), (6, []), (None, [1.0, 1.0]), (7, [-0.001, 0.0])]
    vectors = impact_search.impacts(spark.createDataFrame(rows, "chunk_id long, embedding array<double>"))
    assert {r.chunk_id: r.v for r in vectors.collect()} == {0: [256, 512], 5: [128], 6: [], 7: [-1, 0]}
    got = impact_search.top_chunks(vectors, vectors.where("chunk_id = 0")).orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in got] == [(5, 32768), (6, 0), (7, -256)]
    assert impact_search.top_chunks(vectors.limit(0), vectors.limit(0)).count() == 0
