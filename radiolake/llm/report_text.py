"""Main text of HTML report pages by wrapper induction over the pages of a host."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from radiolake.session import cut_lineage

# Element names and words in class, id and role that mark what is not the report itself.
NOT_TEXT = {
    "script", "style", "noscript", "template", "head", "title", "nav", "footer", "aside", "form", "button", "select", "textarea",
    "iframe", "svg", "canvas", "object", "menu", "dialog",
}
NOT_TEXT_WORDS = {
    "nav", "navbar", "navigation", "menu", "header", "masthead", "banner", "footer", "contentinfo", "sidebar", "aside", "complementary",
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "cookie", "cookies", "consent",
    "gdpr", "notice", "notices", "alert", "popup", "modal", "dialog", "newsletter", "subscribe", "subscription", "signup", "login", "search",
    "comment", "comments", "disqus", "reply", "replies", "respond", "breadcrumb", "breadcrumbs", "share", "sharing", "social", "related", "recommended",
    "widget", "toolbar", "pagination", "pager", "skip",
}
REMARKS = {"comment", "comments", "disqus", "reply", "replies", "respond"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q",
    "ruby", "rt", "rp", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
EMPTY = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe"}
CLOSED_BY_LIKE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.S
)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
LETTERS = re.compile(r"[A-Za-z]+")
MAIN = re.compile(r"""\brole\s*=\s*["']?main\b""", re.I)

PAGES = 5
SHARE = 0.8


class Page:
    """The block elements of a page as a tree, and its texts: (element, text) in page order."""

    def __init__(self, html: str):
        self.label, self.parent, self.noise, self.main = ["#page"], [-1], [False], [False]
        self.texts: list[tuple[int, str]] = []
        self._read(html)

    def _read(self, html: str) -> None:
        stack, tags, buffer = [0], [""], []
        raw, at = "", 0

        def flush() -> None:
            if buffer:
                text = " ".join(entities.unescape("".join(buffer)).split())
                if text:
                    self.texts.append((stack[-1], text))
                buffer.clear()

        def close(upto: int) -> None:
            flush()
            del stack[upto:], tags[upto:]

        for m in TOKEN.finditer(html):
            closing, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            tag = (tag or "").lower()
            if raw:
                if not (closing and tag == raw):
                    continue  # markup inside a script is no markup
                raw, at = "", m.start()
            if m.start() > at:
                buffer.append(html[at : m.start()])
            at = m.end()
            if not tag or (tag in INLINE):
                continue
            if tag == "br":
                buffer.append(" ")
                continue
            if closing:
                if tag in tags:
                    close(len(tags) - 1 - tags[::-1].index(tag))
                else:
                    flush()
                continue
            flush()
            if "p" in tags and tag not in EMPTY:  # a block ends an open paragraph
                close(len(tags) - 1 - tags[::-1].index("p"))
            if tag in CLOSED_BY_LIKE and tag in tags:
                last = len(tags) - 1 - tags[::-1].index(tag)
                if not CLOSED_BY_LIKE[tag] & set(tags[last:]):
                    close(last)
            if tag in EMPTY:
                continue
            words = [w.lower() for n in NAMED.finditer(attrs or "") for w in LETTERS.findall(n[2])]
            up = stack[-1]
            main = self.main[up] or tag in ("main", "article") or bool(MAIN.search(attrs or ""))
            marked = any(w in NOT_TEXT_WORDS and (k == 0 or words[k - 1] not in ("no", "has", "with")) for k, w in enumerate(words))
            if tag in ("html", "body", "main"):
                noise = False
            elif tag == "article":
                noise = bool(REMARKS & set(words))
            else:
                noise = tag in NOT_TEXT or marked or (tag == "header" and not self.main[up])
            self.label.append(".".join([tag, *words[:3]]))
            self.parent.append(up)
            self.noise.append(noise)
            self.main.append(main)
            stack.append(len(self.label) - 1)
            tags.append(tag)
            if tag in RAW and not (attrs or "").rstrip().endswith("/"):
                raw = tag
        if not raw and at < len(html):
            buffer.append(html[at:])
        close(1)
        # what is named like a frame but holds the article is its frame
        holds = [False] * len(self.label)
        for n in range(len(self.label) - 1, 0, -1):
            own = self.label[n].split(".")[0] in ("main", "article") and not REMARKS & set(self.label[n].split("."))
            if holds[n] or own:
                holds[self.parent[n]] = True
        for n in range(1, len(self.label)):
            frame = holds[n] and self.label[n].split(".")[0] not in NOT_TEXT
            self.noise[n] = self.noise[self.parent[n]] or (self.noise[n] and not frame)

    def shape(self) -> tuple[str, list[int]]:
        """The tree with runs of like siblings as one, written in page order, and the place of each element in it."""
        children: list[list[int]] = [[] for _ in self.label]
        for n, up in enumerate(self.parent):
            if up >= 0:
                children[up].append(n)
        kinds: dict[tuple, int] = {}
        kind = [0] * len(self.label)
        for n in range(len(self.label) - 1, -1, -1):
            run: list[int] = []
            for c in children[n]:
                if not run or run[-1] != kind[c]:
                    run.append(kind[c])
            kind[n] = kinds.setdefault((self.label[n], *run), len(kinds))
        place, out = [0] * len(self.label), []
        todo = [(0, 0, -1)]
        while todo:
            n, depth, like = todo.pop()
            if like >= 0:  # one more of a run: the same places as the first of it
                pairs = [(n, like)]
                while pairs:
                    a, b = pairs.pop()
                    place[a] = place[b]
                    first = {kind[c]: c for c in reversed(children[b])}
                    pairs += [(c, first[kind[c]]) for c in children[a] if kind[c] in first]
                continue
            place[n] = len(out)
            out.append(f"{depth} {self.label[n]}")
            later = []
            previous = None
            for c in children[n]:
                if previous is not None and kind[previous] == kind[c]:
                    later.append((c, depth + 1, previous_first))
                else:
                    later.append((c, depth + 1, -1))
                    previous_first = c
                previous = c
            todo += reversed(later)
        return "\n".join(out), place


def _tree(shape: str) -> tuple[list[str], list[list[int]]]:
    labels, children, last = [], [], {}
    for n, line in enumerate(shape.split("\n")):
        depth, label = line.split(" ", 1)
        labels.append(label)
        children.append([])
        if int(depth):
            children[last[int(depth) - 1]].append(n)
        last[int(depth)] = n
    return labels, children


def simple_tree_matching(shape: str, other: str) -> dict[int, int]:
    """Places of the first tree matched with places of the second: the largest order-keeping match with like labels, top down.

    Iterative, so depth is no matter: pairs with like labels are listed from the roots down, scored from the
    leaves up, and read off from the roots.
    """
    if shape == other:
        return {n: n for n in range(shape.count("\n") + 1)}
    (la, ca), (lb, cb) = _tree(shape), _tree(other)
    pairs, k = [(0, 0)] if la[0] == lb[0] else [], 0
    seen = set(pairs)
    while k < len(pairs):
        a, b = pairs[k]
        k += 1
        for x in ca[a]:
            for y in cb[b]:
                if la[x] == lb[y] and (x, y) not in seen:
                    seen.add((x, y))
                    pairs.append((x, y))
    score: dict[tuple[int, int], int] = {}
    chosen: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for a, b in reversed(pairs):
        xs, ys = ca[a], cb[b]
        best = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
        for i in range(len(xs) - 1, -1, -1):
            for j in range(len(ys) - 1, -1, -1):
                best[i][j] = max(best[i + 1][j], best[i][j + 1], best[i + 1][j + 1] + score.get((xs[i], ys[j]), 0))
        i = j = 0
        took = []
        while i < len(xs) and j < len(ys):
            w = score.get((xs[i], ys[j]), 0)
            if w and best[i][j] == best[i + 1][j + 1] + w:
                took.append((xs[i], ys[j]))
                i, j = i + 1, j + 1
            elif best[i][j] == best[i + 1][j]:
                i += 1
            else:
                j += 1
        score[a, b], chosen[a, b] = 1 + best[0][0], took
    match, todo = {}, pairs[:1]
    while todo:
        a, b = todo.pop()
        match[a] = b
        todo += chosen[a, b]
    return match


def _slots(shape: str, wrapper: str, known: dict) -> list[int]:
    """A slot number for each place of a shape: that of the wrapper's place, or of its own where none matches."""
    if (shape, wrapper) not in known:
        if len(known) > 1000:
            known.clear()
        match = simple_tree_matching(shape, wrapper)
        lines = shape.split("\n")
        known[shape, wrapper] = [match[n] if n in match else xxhash.xxh64_intdigest(f"{n} {lines[n]}") >> 1 for n in range(len(lines))]
    return known[shape, wrapper]


def _entry(slot: int, text: int) -> int:
    return xxhash.xxh64_intdigest(f"{slot} {text}") - (1 << 63)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shapes, pages, places, texts = [], [], [], []
        for html in batch.column("html").to_pylist():
            page = Page(html)
            shape, place = page.shape()
            found = dict.fromkeys((place[n], xxhash.xxh64_intdigest(t) - (1 << 63)) for n, t in page.texts if not page.noise[n])
            shapes.append(shape)
            pages.append(xxhash.xxh64_intdigest(repr(list(found))) - (1 << 63))
            places.append([n for n, _ in found])
            texts.append([t for _, t in found])
        yield pa.RecordBatch.from_arrays(
            [batch.column("host"), pa.array(shapes, pa.string()), pa.array(pages, pa.int64()), pa.array(places, pa.list_(pa.int32())), pa.array(texts, pa.list_(pa.int64()))],
            ["host", "shape", "page", "places", "texts"],
        )


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict = {}
    for batch in batches:
        hosts, held, out = [], [], []
        for host, shape, wrapper, places, texts in zip(*(batch.column(c).to_pylist() for c in ("host", "shape", "wrapper", "places", "texts"))):
            slots = _slots(shape, wrapper, known)
            got = {(slots[n] - (1 << 63), _entry(slots[n], t)) for n, t in zip(places, texts)}
            got |= {(slot, None) for slot, _ in got}  # the page has the slot
            hosts += [host] * len(got)
            held += [slot for slot, _ in got]
            out += [entry for _, entry in got]
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(held, pa.int64()), pa.array(out, pa.int64())], ["host", "slot", "entry"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict = {}
    for batch in batches:
        out = []
        for html, wrapper, constant in zip(*(batch.column(c).to_pylist() for c in ("html", "wrapper", "constant"))):
            page = Page(html)
            blocks = [(n, t) for n, t in page.texts if not page.noise[n]]
            if constant:
                shape, place = page.shape()
                slots, gone = _slots(shape, wrapper, known), set(constant)
                blocks = [(n, t) for n, t in blocks if _entry(slots[place[n]], xxhash.xxh64_intdigest(t) - (1 << 63)) not in gone]
            inner = [t for n, t in blocks if page.main[n]]
            outer = sum(len(t) for n, t in blocks if not page.main[n])
            # an article is the text only if the content outside it is not the larger part: else it is a teaser
            out.append(" ".join(inner if sum(map(len, inner)) >= outer else [t for _, t in blocks]))
        yield pa.RecordBatch.from_arrays([batch.column("report_id"), batch.column("url"), pa.array(out, pa.string())], ["report_id", "url", "text"])


def _host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def wrappers(rows: DataFrame) -> DataFrame:
    """Per host its wrapper (the shape most of its distinct pages have) and the hashes of its constant slots' texts.

    ``rows`` has host and html. A text is constant if ``PAGES`` or more distinct pages of
    the host have it in the slot aligned with the same place of the wrapper, and ``SHARE`` of
    those that have the slot; places of other layouts are slots of their own. Counted over all pages of the host; only hashes are shuffled.
    """
    sketch = rows.mapInArrow(_sketch, "host string, shape string, page long, places array<int>, texts array<long>")
    sketch = cut_lineage(sketch.dropDuplicates(["host", "shape", "page"]), "page-sketches")
    shapes = sketch.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"))
    chosen = cut_lineage(shapes.groupBy("host").agg(F.max_by("shape", F.struct("n", "shape")).alias("wrapper")), "wrappers")
    filled = sketch.join(chosen, "host").mapInArrow(_filled, "host string, slot long, entry long")
    counts = cut_lineage(filled.groupBy("host", "slot", "entry").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= PAGES), "slot-counts")
    having = counts.where(F.col("entry").isNull()).select("host", "slot", F.col("n").alias("pages"))
    constant = (
        counts.where(F.col("entry").isNotNull()).join(having, ["host", "slot"]).where(F.col("n") >= SHARE * F.col("pages"))
        .groupBy("host").agg(F.collect_set("entry").alias("constant"))
    )
    return cut_lineage(chosen.join(constant, "host"), "constant-slots")


def report_text(reports: DataFrame, report_id: str = "report_id", url: str = "url", html: str = "html") -> DataFrame:
    """Main text of every report page: report_id, url, text.

    The block elements of a page form a tree in which runs of like siblings count as
    one. Pages of a host are aligned with the host's wrapper by simple tree matching; slots whose text is
    the same on nearly all its pages are template, the others content. Menus, headers,
    footers, side bars, notices, adverts, forms, scripts and remarks are left out by element
    name and by words in class, id and role. If an article or main element has at
    least half of the content left then, its content alone is the text; else all content is. Character references are decoded, white space in
    a block becomes one space, blocks are joined by one space in page order.

    A null page is an empty one; the text is empty if nothing is left. A null or
    odd url has the empty host. Identical pages of a host count once, so copies make
    nothing constant; rows repeated come back as often. No rows in, no rows out; other columns are ignored.

    The wrappers are one small row a host, which Spark broadcasts if the written table is small
    enough and joins otherwise.
    """
    rows = reports.select(
        reports[report_id].alias("report_id"), reports[url].cast("string").alias("url"), F.coalesce(reports[html].cast("string"), F.lit("")).alias("html")
    ).withColumn("host", _host(F.col("url")))
    found = wrappers(rows.select("host", "html"))
    joined = rows.join(found, "host", "left").select("report_id", "url", "html", "wrapper", "constant")
    return joined.mapInArrow(_extract, rows.select("report_id", "url", F.lit("").alias("text")).schema)
