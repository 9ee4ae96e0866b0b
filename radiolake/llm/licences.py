"""Licence notices in knowledge chunks: a trained paragraph classifier, confirmed against the notices' own wording."""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from radiolake.llm.common import in_portions
from radiolake.llm.licence_texts import NOTICES

NONE, UNKNOWN = "none", "unknown"
TOKEN = re.compile(r"[^\W_]+|\n")
DIGITS = re.compile(r"\d+")
CUES = {"license", "licensed", "licence", "licenced", "copyright", "spdx"}
PORTION = 1 << 19
SAMPLES = 40
CONFIRMED = 0.6
PLAIN = (
    "the of and to in is that it for as with was on are by this be at from or not an have has which we they you one all can more "
    "about version 0 work works software source code file files use used copy copies project program terms library text license licensed "
    "released under public general notice free made available conditions changes person law form name author"
).split()


def tokens(text: str) -> list[str]:
    """Words and line feeds; every number is the word 0, so a version is none of a family's marks."""
    return TOKEN.findall(DIGITS.sub("0", text.lower()))


@dataclass(frozen=True)
class LicenceModel:
    """Vocabulary, the number of each known word pair (row by column, 0 for none), weights by feature and class, and each class's notices as word pairs."""

    words: dict[str, int]
    pairs: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    classes: tuple[str, ...]
    notices: dict[str, list[frozenset]]


def _samples(rng: random.Random) -> list[tuple[str, list[str]]]:
    """Training paragraphs: notices whole, cut, thinned and set in prose; notices of licences that do not exist; prose."""
    out = []

    def odd() -> str:
        return "".join(rng.choice("bcdfghklmnprstvw") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))

    def prose(n: int) -> list[str]:
        return [rng.choice(PLAIN) if rng.random() < 0.4 else odd() for _ in range(n)]

    for family, notices in NOTICES.items():
        for notice in notices:
            words = tokens(notice)
            out.append((family, words))
            for _ in range(SAMPLES // 4):
                kept = [w for w in words if rng.random() > 0.1]
                if len(words) > 12 and rng.random() < 0.5:
                    at = rng.randint(0, len(words) - 10)
                    kept = words[at : at + rng.randint(10, len(words) - at)]
                if rng.random() < 0.5:
                    kept = prose(rng.randint(0, 30)) + kept + prose(rng.randint(0, 30))
                out.append((family, kept))
    forms = ["licensed under the {} license version {}", "released under the {} license", "this work is licensed under the {} public license version {}",
             "licensed under {} {}", "spdx license identifier {} {}", "this program is licensed under the terms of the {} license"]
    for _ in range(SAMPLES * 5):
        words = rng.choice(forms).format(" ".join(odd() for _ in range(rng.randint(1, 3))), 0).split()
        out.append((UNKNOWN, (prose(rng.randint(0, 20)) if rng.random() < 0.3 else []) + words))
    out += [(NONE, prose(rng.randint(1, 80))) for _ in range(SAMPLES * 20)]
    return out


def _pairs(words: list[str]) -> frozenset:
    return frozenset(zip(words, words[1:])) or frozenset((w,) for w in words)


def fit_licences(seed: int = 7, steps: int = 200, rate: float = 2.0, ridge: float = 1e-4) -> LicenceModel:
    """Multinomial logistic regression over words and word pairs of the training paragraphs, made from the notices.

    The training set is fixed: the published notices with variations by a seeded
    generator, no corpus. A paragraph's features are present or not, so
    the prose around a notice does not thin it out. A fifth is kept apart to find the temperature
    at which the probabilities are calibrated.
    """
    rng = random.Random(seed)
    samples = _samples(rng)
    rng.shuffle(samples)
    seen = Counter(w for c, ws in samples if c != NONE for w in set(ws))
    words = {w: n for n, w in enumerate(sorted(w for w, k in seen.items() if k >= 5), 1)}
    known = Counter(p for c, ws in samples if c != NONE for p in {(words.get(a, 0), words.get(b, 0)) for a, b in zip(ws, ws[1:])} if all(p))
    table = np.zeros((len(words) + 1,) * 2, np.int32)
    chosen = sorted(p for p, k in known.items() if k >= 5)
    for n, (a, b) in enumerate(chosen, len(words) + 1):
        table[a, b] = n
    classes = (*NOTICES, UNKNOWN, NONE)
    x, y = np.zeros((len(samples), len(words) + len(chosen) + 1), np.float32), np.zeros(len(samples), int)
    for row, (c, ws) in enumerate(samples):
        ids = np.array([words.get(w, 0) for w in ws], int)
        x[row, ids] = 1
        x[row, table[ids[:-1], ids[1:]]] = 1
        y[row] = classes.index(c)
    x[:, 0] = 0
    cut = len(samples) * 4 // 5
    w, b = np.zeros((x.shape[1], len(classes)), np.float32), np.zeros(len(classes), np.float32)
    target = np.eye(len(classes), dtype=np.float32)[y]
    for _ in range(steps):
        p = _softmax(x[:cut] @ w + b)
        error = (p - target[:cut]) / cut
        w -= rate * (x[:cut].T @ error + ridge * w)
        b -= rate * error.sum(axis=0)
    logits = x[cut:] @ w + b
    scales = [0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0]
    loss = [-np.log(_softmax(logits * s)[np.arange(len(logits)), y[cut:]] + 1e-9).mean() for s in scales]
    scale = scales[int(np.argmin(loss))]
    return LicenceModel(words, table, w * scale, b * scale, classes, {c: [_pairs(tokens(n)) for n in ns] for c, ns in NOTICES.items()})


def _likeness(have: frozenset, notice: frozenset) -> float:
    """Share of the notice's word pairs that the paragraph has; of the paragraph's own if it is a good piece of the notice."""
    both = len(have & notice)
    return max(both / len(notice), both / len(have) if both >= 8 else 0.0)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def notices_in(model: LicenceModel, texts: list[str]) -> list[tuple[int, int, str, float, float]]:
    """(text, paragraph, family, probability, likeness) of the paragraphs that are notices, in order. Paragraphs are lines.

    A family must be the most likely class and hold at least ``CONFIRMED`` of the word
    pairs of one of its notices; what is like a notice but of no family, or not
    confirmed, is ``unknown``.
    """
    split = [tokens(t) for t in texts]
    ids = np.array([model.words.get(w, 0) if w != "\n" else -1 for ws in split for w in (*ws, "\n")], np.int64)
    if not len(ids):
        return []
    line = np.concatenate([[0], np.cumsum(ids[:-1] < 0)])
    ends = np.flatnonzero(ids < 0)
    single = np.flatnonzero(ids > 0)
    double = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
    pair = model.pairs[ids[double], ids[double + 1]]
    double, pair = double[pair > 0], pair[pair > 0]
    # a paragraph without a known pair of words says nothing
    maybe = np.zeros(len(ends), bool)
    maybe[line[double]] = True
    single = single[maybe[line[single]]]
    features = np.unique(np.concatenate([line[single] * (1 << 32) + ids[single], line[double] * (1 << 32) + pair]))
    if not len(features):
        return []
    at, first = np.unique(features >> 32, return_index=True)
    logits = np.add.reduceat(model.weights[features & ((1 << 32) - 1)], first, axis=0) + model.bias
    p = _softmax(logits)
    best = p.argmax(axis=1)
    starts = np.concatenate([[0], ends[:-1] + 1])
    of_text = np.repeat(np.arange(len(split)), [ws.count("\n") + 1 for ws in split])
    first_line = np.searchsorted(of_text, np.arange(len(split)))
    base = np.concatenate([[0], np.cumsum([len(ws) + 1 for ws in split])])
    out = []
    for k in np.flatnonzero(best != len(model.classes) - 1).tolist():
        n = int(at[k])
        t = int(of_text[n])
        words = split[t][starts[n] - base[t] : ends[n] - base[t]]
        family, share = model.classes[best[k]], float(p[k, best[k]])
        have = _pairs(words)
        likeness = max(_likeness(have, s) for c in ([family] if family != UNKNOWN else model.notices) for s in model.notices[c])
        if family != UNKNOWN and (likeness < CONFIRMED or share < 0.5):
            family = UNKNOWN
        if family == UNKNOWN and not CUES & set(words):
            continue
        out.append((t, n - int(first_line[t]), family, share, likeness))
    return out


def scan_licences(chunks: DataFrame, model: LicenceModel, chunk_id: str = "chunk_id", text: str = "text") -> DataFrame:
    """Licence families in every knowledge chunk: chunk_id, licence, families, n_notices, score.

    ``licence`` is the family of the surest notice, a known family before
    ``unknown``, the first of equals, ``none`` without a notice (null and empty texts,
    too); ``families`` all families found, sorted; ``score`` the probability of that
    notice, 0 without. Every paragraph of the whole text is classified. Rows
    repeated come back as often; no rows in, no rows out; other columns are ignored.
    """
    parts = (model.words, model.pairs, model.weights, model.bias, model.classes, model.notices)
    shared = chunks.sparkSession.sparkContext.broadcast(parts)
    rows = chunks.select(chunks[chunk_id].alias("chunk_id"), F.coalesce(chunks[text].cast("string"), F.lit("")).alias("text"))
    schema = rows.select(
        "chunk_id", F.lit("").alias("licence"), F.array(F.lit("")).alias("families"), F.lit(0).cast("long").alias("n_notices"), F.lit(0.0).alias("score")
    ).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = LicenceModel(*shared.value)
        for batch in batches:
            found: list[list] = []
            for part in in_portions(((None, t) for t in batch.column("text").to_pylist()), PORTION):
                own: list[list] = [[] for _ in part]
                for t, _, family, share, _ in notices_in(known, [t for _, t in part]):
                    own[t].append((family == UNKNOWN, -share, family))
                found += own
            best = [min(x, key=lambda n: n[:2]) if x else (False, 0.0, NONE) for x in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("chunk_id"), pa.array([b[2] for b in best], pa.string()), pa.array([sorted({n[2] for n in x}) for x in found], pa.list_(pa.string())),
                 pa.array([len(x) for x in found], pa.int64()), pa.array([0.0 - b[1] for b in best], pa.float64())],
                ["chunk_id", "licence", "families", "n_notices", "score"],
            )

    return rows.mapInArrow(run, schema)
