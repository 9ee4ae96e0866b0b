"""Language of feedback comments: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from radiolake.llm.common import in_portions

ORDERS = (1, 2, 3, 4)
BITS = 16
MOST_LANGUAGES = 500
PORTION = 1 << 20
UNKNOWN = "und"
PAD = max(ORDERS)


_FOLDED: list[np.ndarray] = []


def _folded() -> np.ndarray:
    """For every code point of the first plane: lower-cased if a letter, else a space. Made once in a task."""
    if not _FOLDED:
        chars = [chr(i) for i in range(1 << 16)]
        _FOLDED.append(np.array([(ord(c.lower()) if len(c.lower()) == 1 else ord(c)) if c.isalpha() else 32 for c in chars], np.uint64))
    return _FOLDED[0]


def _segments(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded code points of the texts, each followed by ``PAD`` spaces; where they begin and where their spaces begin."""
    joined = "".join(f" {t}{' ' * PAD}" for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) for t in texts]) + 1
    starts = np.concatenate([[0], np.cumsum(sizes + PAD)[:-1]]).astype(np.int64)
    low = points < (1 << 16)
    folded = np.where(low, _folded()[np.where(low, points, 0)], points.astype(np.uint64))
    return folded, starts, starts + sizes


def _buckets(points: np.ndarray, order: int) -> np.ndarray:
    """Hash bucket of the n-gram that begins at each position; the last positions of the array have none."""
    h = np.full(len(points) - order + 1, order, np.uint64)
    for k in range(order):
        h = h * np.uint64(0x9E3779B97F4A7C15) + points[k : len(points) - order + 1 + k]
        h ^= h >> np.uint64(29)
    return ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)).astype(np.int64)


def _rows(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(batch.column(key).to_pylist(), batch.column("comment").to_pylist())


@dataclass(frozen=True)
class LanguageModel:
    """Log probabilities, languages x buckets, less their mean over the languages; log share of each language."""

    languages: tuple[str, ...]
    log_prob: np.ndarray
    log_share: np.ndarray


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}

    def out():
        for lang, n in counts.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "bucket", "n"]
            )
        counts.clear()

    for rows in in_portions(_rows(batches, "lang"), PORTION):
        for lang in {x for x, _ in rows}:
            texts = [t for x, t in rows if x == lang]
            points, _, pads = _segments(texts)
            inside = np.ones(len(points), bool)
            for k in range(PAD):
                inside[pads + k] = False
            n = counts.setdefault(lang, np.zeros((1 << BITS) + 1, np.int64))
            for order in ORDERS:
                b = _buckets(points, order)
                n[:-1] += np.bincount(b[inside[: len(b)]], minlength=1 << BITS)
            n[-1] += len(texts)
        if len(counts) > 64:
            yield from out()
    yield from out()


def fit_languages(feedback: DataFrame, comment: str = "comment", lang: str = "lang", smoothing: float = 0.1) -> LanguageModel:
    """Naive Bayes over all comments that have a text and a language.

    Every task counts n-grams of 1 to 4 folded characters (letters lower-cased,
    all else a space) into 2**16 buckets a language; Spark sums the counts. The
    model is languages x 65 536 numbers whatever the input; more than
    ``MOST_LANGUAGES`` languages are an error, so what is broadcast has a bound.
    Without labelled comments the model knows no language.
    """
    rows = feedback.select(feedback[lang].cast("string").alias("lang"), feedback[comment].cast("string").alias("comment"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("comment").isNotNull())
    counts = rows.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counts.groupBy("lang").agg(F.collect_list("bucket").alias("bucket"), F.collect_list("n").alias("n"))
    models = found.orderBy("lang").limit(MOST_LANGUAGES + 1).collect()
    if len(models) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    table = np.zeros((len(models), (1 << BITS) + 1))
    for row, m in zip(table, models):
        row[np.array(m.bucket)] = m.n
    grams, docs = table[:, :-1] + smoothing, table[:, -1]
    log_prob = np.log(grams / grams.sum(axis=1, keepdims=True))
    if len(models):
        log_prob -= log_prob.mean(axis=0)
    return LanguageModel(tuple(m.lang for m in models), log_prob.astype(np.float32), np.log(docs / max(docs.sum(), 1)))


def posterior(model: LanguageModel, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Most likely language of each text and its posterior probability; ``und`` and 0 without a letter."""
    letters = [any(map(str.isalpha, t)) for t in texts]
    if not model.languages:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    points, starts, pads = _segments(texts)
    scores = np.repeat(model.log_share[:, None], len(texts), axis=1)
    for order in ORDERS:
        b = _buckets(points, order)
        for k, row in enumerate(model.log_prob):
            got = row[b]
            for p in range(PAD):
                got[np.minimum(pads + p, len(got) - 1)] = 0
            scores[k] += np.add.reduceat(got, starts, dtype=np.float64)
    best = scores.argmax(axis=0)
    share = 1 / np.exp(scores - scores.max(axis=0)).sum(axis=0)
    return (
        [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters)],
        np.where(letters, share, 0.0),
    )


def predict_languages(
    feedback: DataFrame, model: LanguageModel, feedback_id: str = "feedback_id", comment: str = "comment",
) -> DataFrame:
    """Language of every feedback comment, from the whole comment alone: feedback_id, lang_pred, score.

    ``score`` is the posterior probability. Null comments and comments without a
    letter (empty ones, too) are ``und`` with score 0, as are all if the model knows no
    language. Equal posteriors go to the language first in code-point order. Rows
    repeated come back as often; other columns are ignored.
    """
    shared = feedback.sparkSession.sparkContext.broadcast((model.languages, model.log_prob, model.log_share))
    rows = feedback.select(feedback[feedback_id].alias("feedback_id"), F.coalesce(feedback[comment].cast("string"), F.lit("")).alias("comment"))
    schema = rows.select("feedback_id", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for part in in_portions(((None, t) for t in batch.column("comment").to_pylist()), PORTION):
                a, b = posterior(LanguageModel(*shared.value), [t for _, t in part])
                langs += a
                scores.append(b)
            arrays = [batch.column("feedback_id"), pa.array(langs, pa.string()), pa.array(np.concatenate(scores or [np.zeros(0)]))]
            yield pa.RecordBatch.from_arrays(arrays, ["feedback_id", "lang_pred", "score"])

    return rows.mapInArrow(run, schema)


def keep_known(feedback: DataFrame, model: LanguageModel, comment: str = "comment") -> DataFrame:
    """The rows, with all their columns, whose comment has a predicted language; null comments and comments without a letter go.

    If the model knows no language, comments with a letter stay all the same.
    """
    shared = feedback.sparkSession.sparkContext.broadcast((model.languages, model.log_prob, model.log_share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep: list[bool] = []
            for part in in_portions(((None, t or "") for t in batch.column(comment).to_pylist()), PORTION):
                texts, known = [t for _, t in part], LanguageModel(*shared.value)
                keep += [lang != UNKNOWN for lang in posterior(known, texts)[0]] if len(known.languages) else [any(map(str.isalpha, t)) for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return feedback.mapInArrow(run, feedback.schema)
