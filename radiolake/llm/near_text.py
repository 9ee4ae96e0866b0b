"""Near copies by SimHash links, each confirmed by exact word-shingle Jaccard, and a prefix-filtered set join for the pairs out of SimHash's reach; components."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from radiolake.llm.common import free_name, text_of
from radiolake.llm.components import components
from radiolake.llm.simhash import fingerprint, fingerprint_links
from radiolake.session import cut_lineage

WORDS = 5
SIMILARITY = Fraction(4, 5)
CELLS = 1 << 18
PAIRS = 1 << 20
PART = 1 << 12  # nodes of a shingle that one group of the crossing join holds


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The set of 64-bit shingle hashes, ascending; fewer words are one shingle, none give none."""
    found = text.encode().lower().split()  # for bytes: A-Z only, ASCII white space only
    if not found:
        return np.zeros(0, np.uint64)
    if len(found) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), 1)], np.uint64)
    each = np.array([xxhash.xxh64_intdigest(w, 42) for w in found], np.uint64)
    n = len(each) - words + 1
    out = np.zeros(n, np.uint64)
    for i in range(words):
        out = (out ^ each[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def alike(x: np.ndarray, y: np.ndarray, similarity: Fraction = SIMILARITY) -> bool:
    """Whether two ascending sets have that Jaccard similarity or more, in whole numbers."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both * similarity.denominator >= similarity.numerator * (len(x) + len(y) - both)


def _cell(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(40)).astype(np.int64) % CELLS


def _counts_of(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(CELLS, np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                np.add.at(seen, _cell(shingles(text, words)), 1)
        cells = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(seen[cells])], ["cell", "n"])

    return run


def _sets_of(often, words: int, similarity: Fraction):
    """Per text: its SimHash; node, a hash of its whole set; the set's size; its prefix, the rarest shingles of which like sets share one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = often.value
        for batch in batches:
            prints, nodes, sizes, prefixes = [], [], [], []
            for text in batch.column("text").to_pylist():
                s = shingles(text, words)
                least = -(-similarity.numerator * len(s) // similarity.denominator)
                order = np.lexsort((s, count[_cell(s)]))[: len(s) - least + 1]
                prints.append(fingerprint(text, words))
                nodes.append(xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63))
                sizes.append(len(s))
                prefixes.append(s[order].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("chunk_id"), batch.column("key"), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(nodes, pa.int64()),
                    pa.array(sizes, pa.int32()), pa.array(prefixes, pa.list_(pa.int64())),
                ],
                ["chunk_id", "key", "fp", "node", "n", "prefix"],
            )

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (s, place, node): those of shingles that two or more nodes have, with the first node of the shingle.

    A shingle may go on over batches, so its last row and first node are carried; a shingle's rows are never held together.
    """
    held = None  # the first row of the open shingle, not yet known to be shared
    at = last = first = None
    for batch in batches:
        s, node, n, place = (batch.column(c).to_numpy() for c in ("s", "node", "n", "place"))
        if not len(s):
            continue
        new = np.concatenate([[at is None or s[0] != at], s[1:] != s[:-1]])
        again = np.concatenate([[at is not None and s[0] == at and node[0] == last], (s[1:] == s[:-1]) & (node[1:] == node[:-1])])
        begins = np.maximum.accumulate(np.where(new, np.arange(len(s)), -1))
        firsts = np.where(begins >= 0, node[begins], 0 if first is None else first)
        more = ~new & ~again  # a further node of its shingle
        heads = np.zeros(len(s), bool)
        heads[begins[more & (begins >= 0)]] = True
        take = more | heads
        out = [s[take], node[take], n[take], place[take], firsts[take]]
        if held is not None and (more & (begins < 0)).any():
            out = [np.concatenate([[h], o]).astype(o.dtype) for h, o in zip(held, out)]
            held = None
        if begins[-1] >= 0:
            b = begins[-1]
            held = None if heads[b] else (s[b], node[b], n[b], place[b], node[b])
        at, last, first = s[-1], node[-1], firsts[-1]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["s", "node", "n", "place", "first"])


def reach(n, place, similarity: Fraction = SIMILARITY):
    """The largest size together with which a node of size ``n`` can still be alike if ``place`` of its rarest shingles are not shared.

    Two sets of sizes a and b that are alike share t / (1 + t) of a + b shingles, t the similarity. At the first shingle they
    share, neither can share more than it has from there on; so a + b is at most (1 + t) / t times that.
    """
    num, den = similarity.numerator, similarity.denominator
    return (n - place) * (num + den) // num


def _crossing(similarity: Fraction):
    """Rows sorted by (g, n): pairs of nodes of a group that are in different components and can be alike by size and place.

    A group is a shingle, or two parts of a shingle that many nodes share; of two parts only pairs across are wanted.
    """
    num, den = similarity.numerator, similarity.denominator

    def pairs(node, n, place, root, part):
        if len(node) < 2 or (root == root[0]).all():
            return
        most = reach(n, place, similarity)
        upto = np.searchsorted(n, np.minimum(n * den // num, most - n), "right")  # n ascending
        many, k = np.maximum(upto - np.arange(len(n)) - 1, 0), 0
        split = (part != part[0]).any()
        while k < len(n):
            end = max(k + 1, int(np.searchsorted(np.cumsum(many[k:]), PAIRS, "right")) + k)
            of = np.repeat(np.arange(k, end), many[k:end])
            to = of + 1 + np.arange(len(of)) - np.repeat(np.cumsum(many[k:end]) - many[k:end], many[k:end])
            cross = (root[of] != root[to]) & (n[of] + n[to] <= most[to])
            if split:
                cross &= part[of] != part[to]
            a, b = node[of[cross]], node[to[cross]]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])
            k = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 6
        for batch in batches:
            g, *rest = [np.concatenate([h, batch.column(c).to_numpy().astype(np.int64)]) for h, c in zip(held, ("g", "node", "n", "place", "root", "part"))]
            cut = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            for i, j in zip(cut[:-1], cut[1:]):
                yield from pairs(*(x[i:j] for x in rest))
            held = [x[cut[-1] :] for x in (g, *rest)] if len(cut) else held
        yield from pairs(*held[1:])

    return run


def _in_parts(rooted: DataFrame, mixed: DataFrame) -> DataFrame:
    """Nodes of mixed shingles dealt to groups: all of a shingle, or every pair of parts of one that more than ``PART`` nodes share."""
    parts = F.ceil(F.col("nodes") / PART).cast("int")
    met = rooted.join(mixed.select("s", parts.alias("parts")), "s").withColumn("part", F.pmod(F.xxhash64("node", "s"), F.col("parts")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return met.select(F.xxhash64("s", F.least("part", "other"), F.greatest("part", "other")).alias("g"), "node", "n", "place", "root", "part")


def _confirmed(words: int, similarity: Fraction):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, centre = None, None
        for batch in batches:
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            good = np.zeros(len(a), bool)
            for k in range(len(a)):
                if b[k] != name:
                    name, centre = b[k], shingles(batch.column("text_b")[k].as_py(), words)
                good[k] = alike(shingles(batch.column("text_a")[k].as_py(), words), centre, similarity)
            yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good])], ["a", "b"])

    return run


def near_text_classes(
    chunks: DataFrame, chunk_id: str = "chunk_id", text: str = "text", words: int = WORDS, similarity: Fraction = SIMILARITY
) -> DataFrame:
    """chunk_id, key (XXH64 of the text) and root, the class of every text: components of all pairs with that Jaccard similarity.

    Texts are sets of ``words``-word shingles. Two sets that are alike share one of their rarest shingles if each
    shows all but the ``similarity`` share of its own, plus one; so the join on those misses no pair.
    Shingles are ordered by counts in ``CELLS`` cells, which bounds the broadcast; any order is right, that one is quick.

    First come the links of the SimHash operator (``simhash.fingerprint_links``) over fingerprints of the same shingles. SimHash misses
    pairs, so with them every node of a shingle is held against one node of it alone, that with the fewest rarer shingles, as the text that
    others are edits of has; the confirmed pairs are classes already. Then all other pairs of a shingle that join two classes are confirmed. A pair within a class could
    change nothing, so the classes are those of all pairs, and a large group of copies costs no square.
    Nor does a passage that unlike texts share: their own shingles are rarer and come first, so at the passage it is known that
    too few are left (see ``reach``). A shingle that very many nodes share is dealt out as pairs of parts.

    Null texts are empty ones. Texts without a word are one class, texts of fewer than ``words`` words are
    one shingle. Chunks with a null id take part. Repeated rows come back as often. No rows in, no rows out; other columns are
    ignored, whatever their names.
    """
    rows = chunks.select(chunks[chunk_id].alias("chunk_id"), text_of(chunks, text).alias("text")).withColumn("key", F.xxhash64("text"))
    spark = chunks.sparkSession
    cells = rows.select("text").mapInArrow(_counts_of(words), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    count = np.zeros(CELLS, np.int64)
    count[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    often = spark.sparkContext.broadcast(count)

    long = F.lit(0).cast("long")
    kind = rows.select("chunk_id", "key", long.alias("fp"), long.alias("node"), F.lit(0).alias("n"), F.array(long).alias("prefix")).schema
    sets = cut_lineage(rows.mapInArrow(_sets_of(often, words, similarity), kind), "shingle-sets")
    entries = sets.select("node", "n", F.posexplode("prefix").alias("place", "s")).select("s", "node", "n", "place")
    shared = cut_lineage(
        entries.repartition("s").sortWithinPartitions("s", "place", "node").mapInArrow(_shared, "s long, node long, n int, place int, first long"), "shared-shingles"
    )
    sizes = sets.groupBy("node").agg(F.min("n").alias("n"))

    def confirm(pairs: DataFrame, label: str) -> DataFrame:
        asked = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
        of = sets.select("chunk_id", "key", "node").join(asked, "node")
        of = of.groupBy("node").agg(F.min("key").alias("key")).select(F.col("node").alias("_node"), F.col("key").alias("_key"))
        # a text of each node: the key names it
        texts = rows.select("key", "text").join(of, F.col("key") == F.col("_key")).select("_node", "text").dropDuplicates(["_node"])
        texts = cut_lineage(texts, "candidate-texts")
        met = pairs.join(texts.select(F.col("_node").alias("a"), F.col("text").alias("text_a")), "a")
        met = met.join(texts.select(F.col("_node").alias("b"), F.col("text").alias("text_b")), "b")
        return cut_lineage(met.select("a", "b", "text_a", "text_b").mapInArrow(_confirmed(words, similarity), "a long, b long"), label)

    def near_in_size(pairs: DataFrame) -> DataFrame:
        met = pairs.join(sizes.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b")
        low, high = F.least("n", "nb") * similarity.denominator, F.greatest("n", "nb") * similarity.numerator
        return met.where(low >= high).select("a", "b")

    prints = cut_lineage(sets.groupBy("fp").agg(F.min("node").alias("of")), "distinct-fingerprints")
    linked = fingerprint_links(prints.select("fp")).join(prints.select(F.col("fp").alias("a"), F.col("of").alias("_a")), "a")
    linked = linked.join(prints.select(F.col("fp").alias("b"), F.col("of").alias("_b")), "b").select("_a", "_b")
    linked = linked.union(sets.select("fp", "node").distinct().join(prints, "fp").select("node", "of")).where("_a != _b")  # unlike sets of one fingerprint
    linked = linked.select(F.greatest("_a", "_b").alias("a"), F.least("_a", "_b").alias("b"))
    linked = linked.join(sizes.select(F.col("node").alias("a"), "n"), "a")
    stars = shared.where(F.col("node") != F.col("first")).select(F.col("node").alias("a"), F.col("first").alias("b"), "n")
    stars = cut_lineage(near_in_size(linked.select("a", "b", "n").union(stars).distinct()), "star-pairs")
    links = confirm(stars, "star-links")
    roots = cut_lineage(components(links), "star-roots")
    rooted = shared.join(roots, "node", "left").select("s", "node", "n", "place", F.coalesce("root", "node").alias("root"))
    mixed = rooted.groupBy("s").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("nodes")).where("lo != hi")
    crossing = _in_parts(rooted, mixed).repartition("g").sortWithinPartitions("g", "n").mapInArrow(_crossing(similarity), "a long, b long")
    crossing = cut_lineage(crossing.distinct().join(stars, ["a", "b"], "left_anti"), "crossing-pairs")
    roots = components(links.union(confirm(crossing, "crossing-links")))
    return sets.select("chunk_id", "key", "node").join(roots, "node", "left").select("chunk_id", "key", F.coalesce("root", "node").alias("root"))


def one_of_each_text(
    chunks: DataFrame, chunk_id: str = "chunk_id", text: str = "text", words: int = WORDS, similarity: Fraction = SIMILARITY
) -> DataFrame:
    """The chunks with the smallest id of their class (see ``near_text_classes``); rows of one id stay once a class.

    Chunks without an id cannot be named, so they stay and name no class. Texts without a word, null ones included, are
    one class, so of those with an id the one with the smallest stays. Of rows repeated under one id with like texts one stays, any of
    them; unlike texts under one id both stay. No rows in, no rows out. All columns come back as they are, whatever their names.
    """
    named = chunks.where(chunks[chunk_id].isNotNull())
    classes = cut_lineage(near_text_classes(named.select(chunk_id, text), chunk_id, text, words, similarity).distinct(), "near-text-classes")
    least = classes.groupBy("root").agg(F.min("chunk_id").alias("chunk_id"))
    stay_id, stay_key, stay_root = (free_name(chunks, w) for w in ("_stay_id", "_stay_key", "_stay_root"))
    stay = classes.join(least, ["root", "chunk_id"]).select(F.col("chunk_id").alias(stay_id), F.col("key").alias(stay_key), F.col("root").alias(stay_root))
    met = named.join(stay, (named[chunk_id] == F.col(stay_id)) & (F.xxhash64(text_of(named, text)) == F.col(stay_key)))
    rows = met.select(*[named[c] for c in chunks.columns], stay_root).dropDuplicates([chunk_id, stay_root]).drop(stay_root)
    return rows.unionByName(chunks.where(chunks[chunk_id].isNull()))
