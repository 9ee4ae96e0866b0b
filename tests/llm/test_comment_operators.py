"""Feedback-comment operators: held-out accuracy, plain recomputation, odd cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from radiolake.llm import language, toxicity
from radiolake.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
SCHEMA = "feedback_id long, comment string, lang string, abusive int, score string, lang_pred string"


def feedback(spark, rows):
    return spark.createDataFrame([(*r, "x", "x") for r in rows], SCHEMA)


# language


def test_language_held_out(spark):
    out = QUERIES["op4_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right, rows = out.where("held_out").select(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")), F.count(F.lit(1))).first()
    assert rows > 250 and right > 0.98


def test_language_scores_are_plain_naive_bayes(spark):
    rows = [(1, "der Funkturm ist ausgefallen", "de", 0), (2, "the cell is down again", "en", 0), (3, "die Zelle ist überlastet", "de", 0), (4, "no such fault", "en", 0)]
    model = language.fit_languages(feedback(spark, rows))
    assert model.languages == ("de", "en")
    text = "The Turm"
    grams = lambda t: [g for n in language.ORDERS for i in range(len(t) + 1) for g in [(" " + t + "    ").lower()[i : i + n]]]
    bucket = lambda g: int(language._buckets(np.array([ord(c) for c in g], np.uint64), len(g))[0])
    score = []
    for lang in model.languages:
        n = np.zeros(1 << language.BITS)
        for _, t, x, _ in rows:
            if x == lang:
                for g in grams(t):
                    n[bucket(g)] += 1
        p = np.log((n + 0.1) / (n + 0.1).sum())
        score.append(np.log(0.5) + sum(p[bucket(g)] for g in grams(text)))
    want = 1 / (1 + np.exp(min(score) - max(score)))
    lang, share = language.posterior(model, [text])
    assert lang == [model.languages[int(np.argmax(score))]] and share[0] == pytest.approx(want, rel=1e-3)


def test_language_odd_cases(spark):
    learn = feedback(spark, [(1, "the cell is down", "en", 0), (2, "la cellule est en panne", "fr", 0), (3, None, "fr", 0), (4, "x", None, 0)])
    model = language.fit_languages(learn)
    rows = [(1, None, None, None), (2, "", None, None), (3, "1234 !?", None, None), (None, "the cell", None, None), (5, "la panne " * 100_000, None, None), (5, "la panne", None, None), (6, "퟿\U0001f600 the", None, None)]
    out = language.predict_languages(feedback(spark, rows), model).collect()
    assert sorted((r.feedback_id or 0, r.lang_pred) for r in out) == [(0, "en"), (1, "und"), (2, "und"), (3, "und"), (5, "fr"), (5, "fr"), (6, "en")]
    assert all(r.score == 0 for r in out if r.lang_pred == "und") and all(0 <= r.score <= 1 for r in out)
    kept = language.keep_known(feedback(spark, rows), model)
    assert sorted(r.feedback_id or 0 for r in kept.collect()) == [0, 5, 5, 6] and kept.columns == SCHEMA.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
    nothing = language.fit_languages(learn.limit(0))
    assert {r.lang_pred for r in language.predict_languages(feedback(spark, rows), nothing).collect()} == {"und"}
    assert language.predict_languages(feedback(spark, []), model).count() == 0


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANGUAGES", 2)
    with pytest.raises(ValueError):
        language.fit_languages(feedback(spark, [(k, "text", f"l{k}", 0) for k in range(3)]))


# toxicity


def abuse_rows(n, seed):
    rng = random.Random(seed)
    plain = ["cell", "alarm", "false", "again", "throughput", "looks", "fine", "drop", "handover", "check", "the", "report"]
    out = []
    for k in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        bad = rng.random() < 0.3
        if bad:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "moron", "scumbag"]))
        out.append((k, " ".join(words), "en", int(bad)))
    return out


def test_abuse_is_found_in_unseen_comments(spark):
    model = toxicity.fit_abuse(feedback(spark, abuse_rows(800, 1)))
    rows = abuse_rows(300, 2)
    out = {r.feedback_id: r for r in toxicity.score_comments(feedback(spark, rows), model).collect()}
    right = sum(out[k].predicted == y for k, _, _, y in rows)
    assert right >= 295
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out.values())


def test_ratio_is_plain_kneser_ney(spark):
    rows = [(k, t, "en", y) for k, (t, y) in enumerate([("bad cell", 1), ("good cell good", 0), ("a bad bad day", 1), ("fine day", 0)])]
    share, rest = toxicity._tables(feedback(spark, rows).select("abusive", "comment"))
    order, pad = toxicity.ORDER, " " * (toxicity.ORDER - 1)
    grams = {y: [f"{pad}{t} "[i : i + order] for _, t, _, z in rows if z == y for i in range(len(t) + 1)] for y in (0, 1)}
    counts = {y: {} for y in (0, 1)}
    for y in (0, 1):
        top = {}
        for g in grams[y]:
            top[g] = top.get(g, 0) + 1
        counts[y][order] = top
    for n in range(order - 1, 0, -1):
        for y in (0, 1):
            level = {}
            for g in counts[y][n + 1]:
                level[g[1:]] = level.get(g[1:], 0) + 1
            counts[y][n] = level
    # endings are counted once for each longer one, whichever class has it
    for n in range(1, toxicity.SHARED + 1):
        both = {g: counts[0][n].get(g, 0) + counts[1][n].get(g, 0) for g in {*counts[0][n], *counts[1][n]}}
        counts[0][n] = counts[1][n] = both

    def cell(g, n):  # letters and contexts meet in hash buckets
        return int(toxicity._cells([np.array([ord(c)], np.uint64) for c in g.rjust(order)], n)[0])

    cells = {(y, n): {} for y in (0, 1) for n in range(1, order + 1)}
    for (y, n), table in cells.items():
        for g, c in counts[y][n].items():
            table[cell(g, n)] = table.get(cell(g, n), 0) + c

    def p(y, g):
        out = 1 / 64
        for n in range(1, order + 1):
            at = cell(g[-n:], n)
            h = {k: c for k, c in cells[y, n].items() if k >> toxicity.NEXT_BITS == at >> toxicity.NEXT_BITS}
            if h:
                total = sum(h.values())
                out = max(h.get(at, 0) - toxicity.DISCOUNT, 0) / total + toxicity.DISCOUNT * len(h) / total * out
        return out

    text = "bad day"
    want = sum(np.log(p(1, f"{pad}{text} "[i : i + order]) / p(0, f"{pad}{text} "[i : i + order])) for i in range(len(text) + 1)) / np.sqrt(len(text) + 1)
    assert toxicity.log_ratio(share, rest, [text])[0] == pytest.approx(want, rel=1e-3)


def test_abuse_odd_cases(spark):
    learn = abuse_rows(200, 3) + [(900, None, "en", 1), (901, "", "en", 0), (902, "idiot", "en", None), (903, "fine", "en", 5), (None, "scumbag", "en", 1)]
    model = toxicity.fit_abuse(feedback(spark, learn))
    rows = [(1, None, None, None), (2, "", None, None), (3, "?!", None, None), (None, "the cell", None, None), (5, "idiot moron " * 50_000, None, None), (5, "idiot moron", None, None)]
    out = toxicity.score_comments(feedback(spark, rows), model).collect()
    assert len(out) == 6 and len({r.score for r in out if r.feedback_id in (1, 2, 3)}) == 1
    assert all(r.predicted == 1 for r in out if r.feedback_id == 5) and all(r.predicted == 0 for r in out if r.feedback_id != 5)
    assert toxicity.score_comments(feedback(spark, []), model).count() == 0
    nothing = toxicity.fit_abuse(feedback(spark, []))
    assert {r.predicted for r in toxicity.score_comments(feedback(spark, rows), nothing).collect()} == {0}
