"""Evaluation scenarios that leaked into the knowledge base: q-gram filtering in diagonal bands, then banded alignment."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from radiolake.llm.common import in_portions
from radiolake.llm.points import normalised

Q = 8  # a power of two
RATE = 0.1
BLOCK_CHARS = 1 << 20
PORTION = 1 << 20
FILTER_BITS = 22
AT_ONCE = 256
OUT = ("scenario_id", "edits", "begins", "ends")


def _grams(points: np.ndarray) -> np.ndarray:
    """Hash of the ``Q`` code points from each place on, built up from pairs, pairs of pairs and so on."""
    h, span = points.astype(np.uint64), 1
    while span < Q:
        h = h * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        h = h[: max(len(h) - span, 0)] * np.uint64(0xBF58476D1CE4E5B9) + h[span:]
        span *= 2
    return h * np.uint64(0x94D049BB133111EB)


def edit_budget(length: int, q: int = Q, rate: float = RATE) -> int:
    """Edits allowed for a scenario text: ``rate`` of its length, as far as the q-gram lemma still asks for one shared q-gram."""
    return max(0, min(int(length * rate), (length - q) // q))


@dataclass(frozen=True)
class Index:
    """Q-grams of a block of scenario texts: distinct hashes, where each one's entries (text, place) begin, and a bitmap."""

    texts: tuple[np.ndarray, ...]
    grams: np.ndarray
    first: np.ndarray
    of: np.ndarray
    at: np.ndarray
    seen: np.ndarray

    @classmethod
    def over(cls, texts: list[str]) -> Index:
        points = tuple(normalised(t)[0] for t in texts)
        grams = [_grams(p) for p in points]
        all_, of = np.concatenate([*grams, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        at = np.concatenate([*(np.arange(len(g)) for g in grams), np.zeros(0, np.int64)])
        order = np.argsort(all_, kind="stable")
        seen = np.zeros(1 << FILTER_BITS, bool)
        seen[all_ >> np.uint64(64 - FILTER_BITS)] = True
        distinct, first = np.unique(all_[order], return_index=True)
        return cls(points, distinct, np.append(first, len(all_)), of[order].astype(np.int64), at[order].astype(np.int64), seen)


def banded_alignment(patterns: list[np.ndarray], texts: list[np.ndarray], firsts: list[int], width: int) -> list[tuple[int, int, int]]:
    """Fewest edits that turn each pattern into a piece of its text, within a band of diagonals: (edits, begin, end).

    The piece may begin at any of the ``width`` diagonals from ``firsts`` on (place in
    the text less place in the pattern) and must not leave them. All pairs advance
    together, one place of the pattern at a time; costs follow from the row before and, for
    skipped text, from a running minimum.
    """
    n, longest = len(patterns), max(map(len, patterns))
    nothing = np.uint32(0xFFFFFFFF)
    pattern = np.full((n, longest), nothing - 1, np.uint32)
    text = np.full((n, longest + width), nothing, np.uint32)
    for row, (p, t, first) in enumerate(zip(patterns, texts, firsts)):
        pattern[row, : len(p)] = p
        piece = t[max(first, 0) : max(first + longest + width, 0)]
        text[row, max(-first, 0) : max(-first, 0) + len(piece)] = piece
    size = np.array([len(p) for p in patterns])
    column = np.arange(width, dtype=np.int32)
    cost, begin = np.zeros((n, width), np.int32), np.repeat(column[None], n, axis=0)
    out: list[tuple[int, int, int]] = [(0, 0, 0)] * n
    for i in range(longest + 1):
        for row in np.flatnonzero(size == i).tolist():
            d = int(cost[row].argmin())
            out[row] = (int(cost[row, d]), int(begin[row, d]) + firsts[row], d + i + firsts[row])
        if i == longest:
            return out
        new, origin = cost + (text[:, i : i + width] != pattern[:, i : i + 1]), begin
        left_out = cost[:, 1:] + 1  # a place of the pattern without one in the text
        better = left_out < new[:, :-1]
        new[:, :-1] = np.where(better, left_out, new[:, :-1])
        origin = np.concatenate([np.where(better, begin[:, 1:], origin[:, :-1]), origin[:, -1:]], axis=1)
        level = new - column
        low = np.minimum.accumulate(level, axis=1)
        source = np.maximum.accumulate(np.where(level == low, column, 0), axis=1)
        cost, begin = low + column, np.take_along_axis(origin, source, axis=1)
    return out


def _candidates(grams: np.ndarray, index: Index, need: np.ndarray, budget: np.ndarray, edges: np.ndarray):
    """Distinct (document, text, band) that share enough q-grams, with the band's first diagonal.

    ``edges`` are the starts of the documents in ``grams``. A band is ``2 * (budget + 1)``
    diagonals wide and starts every ``budget + 1`` diagonals, so any alignment within the budget lies in one.
    """
    if not len(index.grams):
        return (np.zeros(0, np.int64),) * 3
    maybe = np.flatnonzero(index.seen[grams >> np.uint64(64 - FILTER_BITS)])
    number = np.minimum(np.searchsorted(index.grams, grams[maybe]), len(index.grams) - 1)
    known = index.grams[number] == grams[maybe]
    maybe, number = maybe[known], number[known]
    lo, n = index.first[number], index.first[number + 1] - index.first[number]
    place = np.repeat(maybe, n)
    entry = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
    doc = np.searchsorted(edges, place, "right") - 1
    text = index.of[entry]
    step = budget[text] + 1
    diagonal = place - edges[doc] - index.at[entry]
    band = diagonal // step
    # every hit counts in the two bands that hold its diagonal; one number names document, text and band
    bands = int(len(grams) + len(index.of)) + 4
    low = int(len(index.of)) + 2
    key = (doc * len(need) + text) * bands + band + low
    key = np.concatenate([key, key - 1])
    name, count = np.unique(key, return_counts=True)
    name = name[count >= need[name // bands % len(need)]]
    # where that is enough, count each place of the text once
    where = np.searchsorted(name, key)
    inside = np.flatnonzero(name[np.minimum(where, len(name) - 1)] == key) if len(name) else np.zeros(0, np.int64)
    at = index.at[entry[inside % max(len(entry), 1)]]
    places = np.bincount(np.unique(where[inside] * (1 << 32) + at) >> 32, minlength=len(name))
    name = name[places >= need[name // bands % len(need)]]
    return name // bands // len(need), name // bands % len(need), name % bands - low


def leaks_in(texts: list[str], index: Index) -> list[tuple[int, int, int, int, int]]:
    """(document, text of the index, edits, begin, end) for each text of the index found in each document: its best place."""
    length = np.array([len(p) for p in index.texts], np.int64)
    budget = np.array([edit_budget(int(n)) for n in length], np.int64)
    need = length - Q + 1 - budget * Q
    forms = [normalised(t) for t in texts]
    grams = [_grams(p) for p, _ in forms]
    edges = np.concatenate([[0], np.cumsum([len(g) for g in grams])]).astype(np.int64)
    found: dict[tuple[int, int], tuple[int, int, int]] = {}

    def keep(d: int, t: int, edits: int, begin: int, end: int) -> None:
        places = forms[d][1]
        got = (edits, int(places[begin]), int(places[end - 1]) + 1)
        if (d, t) not in found or got < found[d, t]:
            found[d, t] = got

    hits = list(zip(*(x.tolist() for x in _candidates(np.concatenate([*grams, np.zeros(0, np.uint64)]), index, need, budget, edges[:-1]))))
    hits.sort(key=lambda x: length[x[1]])
    for part in (hits[i : i + AT_ONCE] for i in range(0, len(hits), AT_ONCE)):
        firsts = [band * (int(budget[t]) + 1) - int(budget[t]) for _, t, band in part]
        width = max(4 * (int(budget[t]) + 1) for _, t, _ in part)
        aligned = banded_alignment([index.texts[t] for _, t, _ in part], [forms[d][0] for d, _, _ in part], firsts, width)
        for (d, t, _), (edits, begin, end) in zip(part, aligned):
            begin, end = max(begin, 0), min(end, len(forms[d][0]))
            if edits <= budget[t] and end > begin:
                keep(d, t, edits, begin, end)
    # a text shorter than a q-gram allows no edit: whole words, letter by letter
    for t in np.flatnonzero((length < Q) & (length > 0)).tolist():
        word = " " + "".join(map(chr, index.texts[t])) + " "
        for d, (points, _) in enumerate(forms):
            if (at := (" " + "".join(map(chr, points)) + " ").find(word)) >= 0:
                keep(d, t, 0, at, at + int(length[t]))
    return [(d, t, *x) for (d, t), x in sorted(found.items())]


def _blocks(scenarios: DataFrame, scenario_id: str, description: str) -> Iterator[tuple[list, list[str]]]:
    """Scenario ids and texts in blocks of about ``BLOCK_CHARS`` characters, one block in memory at a time."""
    rows = scenarios.select(scenarios[scenario_id].alias("i"), scenarios[description].cast("string").alias("t")).where(F.length("t") > 0)
    for part in in_portions(((r.i, r.t) for r in rows.toLocalIterator()), BLOCK_CHARS):
        yield [i for i, _ in part], [t for _, t in part]


def scenario_leaks(
    chunks: DataFrame, scenarios: DataFrame, chunk_id: str = "chunk_id", text: str = "text",
    scenario_id: str = "scenario_id", description: str = "description",
) -> DataFrame:
    """Knowledge chunks that contain the description of an evaluation scenario, up to a tenth of its characters edited.

    Returns chunk_id, scenario_id, edits, begins, ends (code points of the text): one
    row per row of ``chunks`` and scenario, the place with the fewest edits, the
    first of equals. Case, punctuation and white space are no differences. A
    description shorter than ``Q`` characters must occur exactly, as whole words.

    By the q-gram lemma a piece within k edits of a description of m characters
    shares at least m - q + 1 - kq of its q-grams on neighbouring diagonals; bands with
    fewer are passed over, the others aligned. Null and empty texts and
    descriptions match nothing; empty tables give no rows; rows repeated are
    answered as often; other columns are ignored.

    Scenarios are read in blocks of ``BLOCK_CHARS`` characters, so what a task
    holds is bounded; each block is one pass over the chunks.
    """
    rows = chunks.select(chunks[chunk_id].alias("chunk_id"), chunks[text].cast("string").alias("text")).where(F.length("text") > 0)
    ids = scenarios.select(F.lit(None).cast(chunks.schema[chunk_id].dataType).alias("chunk_id"), scenarios[scenario_id].alias("scenario_id"))
    schema = ids.select("*", F.lit(0).alias("edits"), F.lit(0).cast("long").alias("begins"), F.lit(0).cast("long").alias("ends")).schema
    spark = chunks.sparkSession
    found = []
    for known, texts in _blocks(scenarios, scenario_id, description):
        shared = spark.sparkContext.broadcast((known, texts))
        found.append(rows.mapInArrow(_search(shared, schema["scenario_id"].dataType), schema))
    return reduce(DataFrame.union, found) if found else spark.createDataFrame([], schema)


def _search(shared, id_type):
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, texts = shared.value
        index = Index.over(texts)
        for batch in batches:
            keys = batch.column("chunk_id")
            for part in in_portions(enumerate(batch.column("text").to_pylist()), PORTION):
                hits = leaks_in([t for _, t in part], index)
                if hits:
                    d, t, edits, begins, ends = zip(*hits)
                    yield pa.RecordBatch.from_arrays(
                        [keys.take(pa.array([part[x][0] for x in d])), pa.array([known[x] for x in t], kind),
                         pa.array(edits, pa.int32()), pa.array(begins, pa.int64()), pa.array(ends, pa.int64())],
                        ["chunk_id", *OUT],
                    )

    return run


def without_leaks(chunks: DataFrame, scenarios: DataFrame, text: str = "text", scenario_id: str = "scenario_id", description: str = "description") -> DataFrame:
    """The rows, with all their columns, whose text contains no scenario; each row is judged by itself, so ids do not matter."""
    out = chunks
    for _, texts in _blocks(scenarios, scenario_id, description):
        out = out.mapInArrow(_clean(chunks.sparkSession.sparkContext.broadcast(texts), text), chunks.schema)
    return out


def _clean(shared, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index.over(shared.value)
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for part in in_portions(((n, t or "") for n, t in enumerate(batch.column(text).to_pylist())), PORTION):
                for d, *_ in leaks_in([t for _, t in part], index):
                    keep[part[d][0]] = False
            yield batch.filter(pa.array(keep))

    return run
