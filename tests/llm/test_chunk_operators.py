"""Knowledge-chunk operators on small tables: what the contract names, and the odd cases of the docstrings."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from radiolake.llm import components, decontaminate, licences, line_dedup, mixing, simhash

LONG = "The cell reported congestion on the downlink"
SCHEMA = "chunk_id long, spec string, text string, n string, size string, h1 string, _gone string, _plan string"


def chunks(spark, rows):
    """Chunks with further columns that are called like the operators' own."""
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], SCHEMA)


def by_id(df, key="chunk_id"):
    return {r[key]: r for r in df.collect()}


# lines


def test_lines_in_three_chunks_stay_in_the_last_one_only(spark):
    rows = [(1, "s", f"{LONG}\nown one"), (2, "s", f"  {LONG.upper()}\t\nown two"), (3, "s", f"own three\n{LONG}\n{LONG}"), (4, "s", "short\nshort")]
    out = by_id(line_dedup.drop_repeated_lines(chunks(spark, rows)))
    assert out[1].text == "own one" and out[2].text == "own two"
    assert out[3].text == rows[2][2] and out[3].n_dropped == 0 and out[3].n_lines == 3
    assert out[4].text == "short\nshort"


def test_lines_odd_cases(spark):
    rows = [(1, "s", None), (2, "s", ""), (None, "s", LONG), (None, "s", LONG), (5, "s", LONG), (6, "s", LONG), (6, "s", LONG), (7, None, "\n\n")]
    df = line_dedup.drop_repeated_lines(chunks(spark, rows))
    got = sorted(df.collect(), key=lambda r: (r.chunk_id or 0, r.text))
    assert len(got) == len(rows)
    # 5 and 6 are two chunks, the rows without an id none: nothing repeats three times
    assert all(r.n_dropped == 0 for r in got)
    assert [(r.n_lines, r.text) for r in got if r.chunk_id in (1, 2)] == [(1, ""), (1, "")]
    assert line_dedup.drop_repeated_lines(chunks(spark, [])).count() == 0


def test_lines_not_ascii_case_and_blanks_are_kept_apart(spark):
    a, b = "Ünïted ÉCLAIR line of twenty", "ünïted éclair line of twenty"
    rows = [(1, "s", a), (2, "s", a), (3, "s", b), (4, "s", " " + a), (5, "s", a.replace("line", "LINE"))]
    out = by_id(line_dedup.drop_repeated_lines(chunks(spark, rows)))
    assert [out[k].n_dropped for k in (1, 2, 3, 4, 5)] == [1, 1, 0, 0, 0]


def test_lines_of_a_very_long_chunk(spark):
    many = "\n".join(f"line number {i} of a very long chunk" for i in range(60_000))
    rows = [(1, "s", many), (2, "s", many), (3, "s", many)]
    out = by_id(line_dedup.drop_repeated_lines(chunks(spark, rows)))
    assert out[1].text == "" and out[2].n_dropped == 60_000 and out[3].text == many


def test_clean_chunks_keeps_all_columns(spark):
    df = chunks(spark, [(k, "s", f"{LONG}\nown {k}") for k in range(1, 5)])
    out = line_dedup.clean_chunks(df)
    assert out.columns == df.columns
    assert by_id(out)[1].text == "own 1" and by_id(out)[1].h1 == "x"


# mixing


def test_targets_fill_up(spark):
    rows = [(k, spec, "w " * 10) for k, spec in enumerate(["a"] * 10 + ["b"] * 40 + ["c"] * 50 + [None] * 20)]
    out = by_id(mixing.mix_chunks(chunks(spark, rows)))
    targets = {r.spec: r.target for r in out.values()}
    # 1 800 words by weights 3, 1, 2, 3: a stops at 200, null at 400, the rest 1 200 by 1 to 2 is 400 and 800
    assert targets == pytest.approx({"a": 200, "b": 400, "c": 800, None: 400})
    for spec, target in targets.items():
        taken = sum(r.taken for r in out.values() if r.spec == spec)
        assert abs(taken - target) <= 5
    assert all(r.taken in (0, 10, 20) for r in out.values())


def test_sizes_are_drawn_at_their_inclusion_probability(spark):
    """One spec, half of its words open: 2 000 chunks of 4 words (class 3) and 2 000 of 64 (class 7)."""
    out = by_id(mixing.mix_chunks(chunks(spark, [(k, "a", "w " * (4 if k % 2 else 64)) for k in range(4000)])))
    small, large = 8.0**0.5, 128.0**0.5
    level = 68_000 / (small * 8_000 + large * 128_000)
    for odd, rate in ((1, level * small), (0, level * large)):
        drawn = sum(r.copies == 2 for k, r in out.items() if k % 2 == odd)
        assert abs(drawn - 2000 * rate) < 4 * (2000 * rate * (1 - rate)) ** 0.5
    assert abs(sum(r.taken for r in out.values()) - 1.5 * 136_000) <= 32 and {r.copies for r in out.values()} == {1, 2}


def test_certain_sizes_come_first(spark):
    out = by_id(mixing.mix_chunks(chunks(spark, [(k, "a", "w " * (100 if k < 10 else 1)) for k in range(2010)])))
    assert all(out[k].copies == 2 for k in range(10))
    assert abs(sum(r.copies == 2 for k, r in out.items() if k >= 10) - 500) <= 1


def test_mix_reruns_agree_and_odd_cases(spark):
    rows = [(k, random.Random(k).choice(["a", "b", None]), " ".join(["w"] * (k % 7))) for k in range(300)] + [(None, "a", "x y"), (None, "a", None), (5, "a", "dup dup")]
    df = chunks(spark, rows)
    first, second = (sorted(map(str, mixing.mix_chunks(d).collect())) for d in (df, df.repartition(5)))
    assert first == second and len(first) == len(rows)
    empty = chunks(spark, [(1, "a", None), (2, "b", "")])
    assert [r.taken for r in mixing.mix_chunks(empty).collect()] == [0, 0]
    assert mixing.mix_chunks(chunks(spark, [])).count() == 0


# near copies


def brute_classes(fps, budget=4):
    root = {k: k for k in fps}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in combinations(sorted(fps), 2):
        if bin(fps[a] ^ fps[b]).count("1") <= budget:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {k: find(k) for k in fps}


def test_classes_are_those_of_all_pairs(spark):
    rng = random.Random(3)
    words = ["cell", "link", "beam", "core", "slice", "ue", "amf", "gnb", "prb", "rach"]
    base = [" ".join(rng.choice(words) for _ in range(rng.choice((0, 1, 3, 4, 60, 300)))) for _ in range(60)]
    texts = base + [" ".join(w if rng.random() > 0.01 else "odd" for w in t.split(" ")) for t in base for _ in range(3)]
    rows = [(k, "s", t) for k, t in enumerate(texts)]
    out = by_id(simhash.near_duplicates(chunks(spark, rows)))
    fps = {k: simhash.fingerprint(t) for k, t in enumerate(texts)}
    assert {k: int(r.fingerprint, 16) for k, r in out.items()} == fps
    assert {k: r.component_id for k, r in out.items()} == brute_classes(fps)


def test_trie_pairs_are_all_near_pairs():
    rng = np.random.default_rng(5)
    for spread in (3, 12, 64):
        centre = rng.integers(0, 1 << 63, dtype=np.uint64)
        fp = np.unique(centre ^ (rng.integers(0, 1 << 63, 400, dtype=np.uint64) & np.uint64((1 << spread) - 1)))
        near = np.bitwise_count(fp[:, None] ^ fp[None]) <= 4
        want = {(i, j) for i, j in zip(*np.nonzero(near)) if i < j}
        got = {tuple(sorted(map(int, p))) for a, b in simhash.trie_pairs(fp, np.array([0]), np.array([len(fp)]), 4, width=50) for p in zip(a, b)}
        assert got == want


def test_hot_tries_are_dealt_in_parts(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP", 20)
    monkeypatch.setattr(simhash, "PORTION", 10)
    fps = {k: int(x) for k, x in enumerate(np.unique(np.random.default_rng(1).integers(0, 1 << 9, 200)))}
    df = spark.createDataFrame([(v,) for v in fps.values()], "fp long")
    roots = {r.node: r.root for r in components.components(simhash.fingerprint_links(df)).collect()}
    want = brute_classes(fps)
    classes = {}
    for k, v in fps.items():
        classes.setdefault(roots.get(v, v), set()).add(want[k])
    assert all(len(x) == 1 for x in classes.values()) and len(classes) == len(set(want.values()))


def test_fingerprint_counts_repeats_and_large_texts():
    few, many = "a b c d e", " ".join(f"w{i % 700}" for i in range(3000))
    for t in (few, many):
        import xxhash

        w = t.split()
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]), 42) for i in range(len(w) - 3)]
        assert simhash.fingerprint(t) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash.fingerprint("") == 0 == simhash.fingerprint(" \n")
    assert simhash.fingerprint("A b") == simhash.fingerprint("a  B\n")


def test_near_copies_odd_cases(spark):
    rows = [(4, "s", None), (3, "s", ""), (9, "s", "one two"), (9, "s", "one two"), (None, "s", "one two"), (None, "s", "alone")]
    out = simhash.near_duplicates(chunks(spark, rows)).collect()
    assert sorted((r.chunk_id or 0, r.component_id or 0) for r in out) == [(0, 0), (0, 9), (3, 3), (4, 3), (9, 9), (9, 9)]
    stay = simhash.one_of_each(chunks(spark, rows))
    assert sorted((r.chunk_id or 0, r.text) for r in stay.collect()) == [(0, "alone"), (0, "one two"), (3, ""), (9, "one two")] and stay.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    assert simhash.near_duplicates(chunks(spark, [])).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.range(1, 200).select((F.col("id") * 7 % 199).alias("a"), ((F.col("id") + 1) * 7 % 199).alias("b"))
    assert {r.root for r in components.components(links).collect()} == {0}
    assert components.components(links.limit(0)).count() == 0


# leaks


def scenarios(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "scenario_id long, description string, chunk_id string")


def edit_distance_inside(p, t):
    last = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        row = [i]
        for j, b in enumerate(t, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (a != b)))
        last = row
    return min(last)


def test_leaks_are_those_of_full_alignment():
    rng = random.Random(11)
    make = lambda n: "".join(rng.choice("abcd ") for _ in range(n))
    for _ in range(60):
        items = [make(rng.randint(1, 60)) for _ in range(4)]
        texts = []
        for _ in range(5):
            cut = list(rng.choice(items))
            for _ in range(rng.randint(0, 1 + len(cut) // 8)):
                at = rng.randrange(len(cut) + 1)
                cut[at : at + rng.randint(0, 1)] = rng.choice(["a", "b", "", "cd"])
            texts.append(make(rng.randint(0, 100)) + "".join(cut) + make(rng.randint(0, 100)))
        got = {(d, t): e for d, t, e, _, _ in decontaminate.leaks_in(texts, decontaminate.Index.over(items))}
        forms = [["".join(map(chr, decontaminate.normalised(x)[0])) for x in xs] for xs in (texts, items)]
        for d, text in enumerate(forms[0]):
            for i, item in enumerate(forms[1]):
                if len(item) >= decontaminate.Q:
                    edits = edit_distance_inside(item, text)
                    want = edits if edits <= decontaminate.edit_budget(len(item)) else None
                else:
                    want = 0 if item and f" {item} " in f" {text} " else None
                assert got.get((d, i)) == want


def test_leaks_are_found_in_place(spark):
    item = "DL congestion on TDD cell PCI_3: PRB utilisation exceeds 90%, throughput and handover degrade."
    text = "Before. " + item.upper().replace(" ", "\n") + " After." + " pad" * 60_000
    rows = [(1, "s", text), (1, "s", text), (2, "s", item.replace("exceeds", "exceed")), (3, "s", None), (4, "s", ""), (None, "s", item), (5, "s", "clean " * 40)]
    found = decontaminate.scenario_leaks(chunks(spark, rows), scenarios(spark, [(7, item), (8, None), (9, ""), (10, "!?")])).collect()
    assert sorted((r.chunk_id or 0, r.scenario_id, r.edits) for r in found) == [(0, 7, 0), (1, 7, 0), (1, 7, 0), (2, 7, 1)]
    one = next(r for r in found if r.chunk_id == 1)
    assert text[one.begins : one.ends] == item.upper().replace(" ", "\n").rstrip(".")
    left = decontaminate.without_leaks(chunks(spark, rows), scenarios(spark, [(7, item)]))
    assert sorted(r.chunk_id for r in left.collect()) == [3, 4, 5] and left.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    assert decontaminate.without_leaks(chunks(spark, rows), scenarios(spark, [])).count() == len(rows)
    assert decontaminate.scenario_leaks(chunks(spark, rows), scenarios(spark, [])).count() == 0
    assert decontaminate.scenario_leaks(chunks(spark, []), scenarios(spark, [(7, item)])).count() == 0


def test_leaks_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 100)
    items = [(k, f"scenario {k} with a handover failure between cells {k * 31} and {k * 57} at night") for k in range(6)]
    df = chunks(spark, [(k, "s", f"noise {t} noise") for k, t in items])
    found = decontaminate.scenario_leaks(df, scenarios(spark, items)).where("edits = 0")
    assert sorted((r.chunk_id, r.scenario_id) for r in found.collect()) == [(k, k) for k, _ in items]


# licences


@pytest.fixture(scope="module")
def licence_model():
    return licences.fit_licences()


def test_licences_of_paragraphs(spark, licence_model):
    rows = [
        (1, "s", "Some prose.\nReleased under the MIT License.\nMore prose."),
        (2, "s", "This work is licensed under the GNU General Public License, version 2."),
        (3, "s", "Licensed under the Foobar Community License, version 9."),
        (4, "s", "The public was free to use the library under the terms of the agreement."),
        (5, "s", None), (6, "s", ""), (7, "s", "word " * 50_000 + "\nLicensed under CC BY-NC 4.0."), (None, "s", "SPDX-License-Identifier: LGPL-3.0-only"),
        (8, "s", "Licensed under CC BY-SA 3.0.\nLicensed under the Apache License, Version 2.0."), (8, "s", "x"),
    ]
    out = licences.scan_licences(chunks(spark, rows), licence_model).collect()
    got = {r.chunk_id: r.licence for r in out if r.chunk_id != 8}
    assert got == {1: "mit", 2: "gpl", 3: "unknown", 4: "none", 5: "none", 6: "none", 7: "cc-by-nc", None: "lgpl"}
    assert sorted(r.families for r in out if r.chunk_id == 8) == [[], ["apache", "cc-by-sa"]]
    assert licences.scan_licences(chunks(spark, []), licence_model).count() == 0


def test_licences_of_all_notices_and_held_out_prose(licence_model):
    for family, notices in licences.NOTICES.items():
        for n in notices:
            assert [f for _, _, f, _, _ in licences.notices_in(licence_model, [n])] == [family]
    rng = random.Random(99)
    prose = [" ".join(rng.choice(licences.PLAIN) for _ in range(30)) for _ in range(300)]
    wrong = {f for _, _, f, _, _ in licences.notices_in(licence_model, prose)} - {"unknown"}
    assert not wrong
