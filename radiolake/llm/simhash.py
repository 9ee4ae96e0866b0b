"""Near-duplicate knowledge chunks: SimHash fingerprints joined with themselves through binary tries."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from radiolake.llm.common import free_name, text_of
from radiolake.llm.components import components
from radiolake.session import cut_lineage

BLOCKS = 6
SHARE = 2
GROUP = 2000
PORTION = 1000


# fingerprints


def fingerprint(text: str, words: int = 4) -> int:
    """SimHash of one text: a bit is set if it is set in more than half of the shingles' XXH64 values; 0 without words."""
    found = text.encode().lower().split()  # for bytes: A-Z only, ASCII white space only
    if not found:
        return 0
    shingles = [b" ".join(x) for x in zip(*(found[i:] for i in range(words)))] or [b" ".join(found)]
    seen = np.frombuffer(b"".join([xxhash.xxh64_digest(s, 42) for s in shingles]), np.uint8).reshape(-1, 8)
    if len(seen) < 256:
        ones = np.unpackbits(seen, axis=1).sum(axis=0)
    else:
        table = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)
        ones = np.concatenate([np.bincount(seen[:, i], minlength=256) @ table for i in range(8)])
    return int.from_bytes(np.packbits(2 * ones > len(seen)).tobytes(), "big")


def fingerprints(chunks: DataFrame, chunk_id: str = "chunk_id", text: str = "text", words: int = 4) -> DataFrame:
    """chunk_id and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, words) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("chunk_id"), pa.array(fps, pa.int64())], ["chunk_id", "fp"])

    rows = chunks.select(chunks[chunk_id].alias("chunk_id"), text_of(chunks, text).alias("text"))
    return rows.mapInArrow(run, rows.select("chunk_id", F.lit(0).cast("long").alias("fp")).schema)


# trie join


def _ones(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def trie_pairs(fp: np.ndarray, starts: np.ndarray, ends: np.ndarray, budget: int, width: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions whose fingerprints differ in at most ``budget`` bits.

    ``fp`` is sorted within each range [start, end), so a range is a binary trie and
    a node a shorter range. Node pairs go down together, bit by bit; where the two
    branches differ the pair has spent one more bit, and past the budget it is
    dropped with all below. Small node pairs are compared leaf by leaf. At most
    ``width`` node pairs are expanded at a time.
    """
    todo = [(63, starts, ends, starts, ends, np.zeros(len(starts), np.int8))]
    ones_at: dict[int, np.ndarray] = {}
    while todo:
        bit, al, ah, bl, bh, spent = todo.pop()
        same = (al == bl) & (ah == bh)
        keep = (ah > al) & (bh > bl) & (spent <= budget) & ~(same & (ah - al < 2))
        al, ah, bl, bh, spent, same = (x[keep] for x in (al, ah, bl, bh, spent, same))
        if len(al) > width:
            half = len(al) // 2
            todo += [(bit, al[:half], ah[:half], bl[:half], bh[:half], spent[:half]), (bit, al[half:], ah[half:], bl[half:], bh[half:], spent[half:])]
            continue
        small = (ah - al) * (bh - bl) <= 64
        if bit < 0:
            small[:] = True  # equal fingerprints: only leaves are left
        if small.any():
            n = (ah - al)[small] * (bh - bl)[small]
            of = np.repeat(np.arange(len(n)), n)
            k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            side = (bh - bl)[small][of]
            i, j = al[small][of] + k // side, bl[small][of] + k % side
            near = (_ones(fp[i] ^ fp[j]) <= budget) & (~same[small][of] | (i < j))
            if near.any():
                yield i[near], j[near]
        al, ah, bl, bh, spent, same = (x[~small] for x in (al, ah, bl, bh, spent, same))
        if not len(al):
            continue
        if bit not in ones_at:
            ones_at[bit] = np.concatenate([[0], np.cumsum((fp >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)])
        c = ones_at[bit]
        am, bm = ah - (c[ah] - c[al]), bh - (c[bh] - c[bl])
        todo.append((
            bit - 1,
            np.concatenate([al, am, al, am[~same]]), np.concatenate([am, ah, am, ah[~same]]),
            np.concatenate([bl, bm, bm, bl[~same]]), np.concatenate([bm, bh, bh, bm[~same]]),
            np.concatenate([spent, spent, spent + 1, spent[~same] + 1]),
        ))


def _forest(fp: np.ndarray, group: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the pairs within each group connect: each fingerprint and its component's first."""
    cut = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    root = np.arange(len(fp))
    for i, j in trie_pairs(fp, cut, np.append(cut[1:], len(fp)), budget):
        while True:
            a, b = root[i], root[j]
            open_ = a != b
            if not open_.any():
                break
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root = root[root]
    linked = np.flatnonzero(root != np.arange(len(fp)))
    return fp[linked], fp[root[linked]]


def _links_of(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer(fp, group):
            a, b = _forest(fp, group, budget)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        fp, group = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            fp = np.concatenate([fp, batch.column("u").to_numpy().view(np.uint64) ^ np.uint64(1 << 63)])
            group = np.concatenate([group, batch.column("g").to_numpy()])
            whole = int(np.searchsorted(group, group[-1])) if len(group) else 0  # the last group may go on
            if whole:
                yield answer(fp[:whole], group[:whole])
                fp, group = fp[whole:], group[whole:]
        if len(fp):
            yield answer(fp, group)

    return run


def _prefix(fp: Column, chosen: tuple[int, ...], blocks: int) -> Column:
    """The bits of the chosen blocks side by side."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    out = F.lit(0).cast("long")
    for b in chosen:
        size = edges[b + 1] - edges[b]
        out = F.shiftleft(out, size).bitwiseOR(F.shiftrightunsigned(fp, 64 - edges[b + 1]).bitwiseAND(F.lit((1 << size) - 1)))
    return out


def fingerprint_links(distinct: DataFrame, budget: int = 4, blocks: int = BLOCKS) -> DataFrame:
    """``(a, b)`` links whose components are those of all pairs of fingerprints within ``budget`` bits.

    ``distinct`` holds each fingerprint once as ``fp``. With the bits in ``blocks``
    blocks, of which ``budget`` can be hit by a difference, every pair agrees in
    ``blocks - budget`` whole blocks; for each choice of those, fingerprints
    with equal blocks form a trie of their own, and the tries are dealt out over the cluster.
    A trie of more than ``GROUP`` fingerprints is dealt out as pairs of parts of about ``PORTION``,
    so no task holds a whole one. No link is lost; links are handed on as a
    spanning forest, never as all pairs.
    """
    choices = list(combinations(range(blocks), blocks - budget))
    # the table's number stands above the prefix, so one long names the trie
    keys = F.array(*[_prefix(F.col("fp"), c, blocks).bitwiseOR(F.lit(n << 48)) for n, c in enumerate(choices)])
    rows = distinct.select("fp", F.explode(keys).alias("trie"))
    hot = cut_lineage(
        rows.groupBy("trie").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP)
        .select(F.col("trie").alias("hot"), F.ceil(F.col("n") / PORTION).cast("int").alias("parts")),
        "hot-tries",
    )
    met = rows.join(hot, F.col("trie") == F.col("hot"), "left")
    part = F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1))).cast("int")
    met = met.withColumn("part", part)
    others = F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    met = met.select("fp", "trie", "part", F.explode(others).alias("other"))
    group = F.xxhash64("trie", F.least("part", "other"), F.greatest("part", "other"))
    met = met.select(F.col("fp").bitwiseXOR(F.lit(-(1 << 63))).alias("u"), group.alias("g"))  # unsigned order
    return met.repartition("g").sortWithinPartitions("g", "u").mapInArrow(_links_of(budget), "a long, b long").distinct()


def near_duplicates(
    chunks: DataFrame, chunk_id: str = "chunk_id", text: str = "text", words: int = 4, budget: int = 4,
) -> DataFrame:
    """Each knowledge chunk with its SimHash fingerprint and the class of near copies it belongs to.

    Returns chunk_id, fingerprint (16 hex digits) and component_id, the smallest
    chunk_id that links reach; fingerprints link at ``budget`` or fewer differing
    bits. Words are cut at ASCII white space after lower-casing A-Z, shingles
    are ``words`` words with repeats; fewer words are one shingle, none give
    fingerprint zero, which links like any other (null and empty texts).

    Equal texts are one fingerprint before anything is joined, so a large group
    of copies costs no pairs. Rows without an id take part but name no class; a
    class without ids is null. Rows repeated come back as often. No rows in, no rows
    out; other columns are ignored.
    """
    found = cut_lineage(fingerprints(chunks, chunk_id, text, words), "fingerprints")
    distinct = cut_lineage(found.groupBy("fp").agg(F.min("chunk_id").alias("first")), "distinct-fingerprints")
    roots = components(fingerprint_links(distinct, budget))
    root = F.coalesce("root", "fp")
    rooted = cut_lineage(distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", root.alias("root")), "fingerprint-roots")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select(F.col("fp").alias("of"), "component_id")
    return found.join(named, F.col("fp") == F.col("of")).select(
        "chunk_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(chunks: DataFrame, chunk_id: str = "chunk_id", text: str = "text", words: int = 4, budget: int = 4) -> DataFrame:
    """The chunks with the smallest id of their class; rows repeated under that id stay once.

    Chunks without an id cannot be named, so they stay and name no class.
    """
    named = chunks.where(chunks[chunk_id].isNotNull())
    name = free_name(chunks, "_stay")
    classes = near_duplicates(named.select(chunk_id, text), chunk_id, text, words, budget)
    stay = classes.where(F.col("chunk_id") == F.col("component_id")).select(F.col("chunk_id").alias(name)).distinct()
    rows = named.join(stay, named[chunk_id] == F.col(name)).select(*[named[c] for c in chunks.columns])
    return rows.dropDuplicates([chunk_id]).unionByName(chunks.where(chunks[chunk_id].isNull()))
