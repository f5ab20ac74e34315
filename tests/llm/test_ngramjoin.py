"""Operator 9 against all pairs."""

import random
import re

from corpusloom.llm import ngramjoin as N


def shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(texts):
    """Class of each id and links of each text to other texts."""
    sets = {i: shingles(t) for i, t in texts.items()}
    label = {i: i for i in sets}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                label[max(x, y)] = min(x, y)
    return {i: top(i) for i in sets}


def test_bands_reach_the_recall():
    bands, rows = N.bands_and_rows(0.8, 0.999, 128)
    assert bands * rows <= 128 and 1 - (1 - 0.8**rows) ** bands >= 0.999
    assert N.bands_and_rows(0.5, 0.9, 64) != (bands, rows)


def test_classes_equal_brute_force(docs, local_docs):
    got = {r.doc_id: r.class_id for r in N.classes(docs).collect()}
    assert got == brute({i: r.text for i, r in local_docs.items()})


def test_a_large_group_of_near_copies(spark):
    base = [f"w{i}" for i in range(200)]
    texts = {}
    for i in range(120):
        words = list(base)
        words[(i * 7) % 200] = f"x{i}"
        texts[i] = " ".join(words)
    texts |= {1000 + i: " ".join(f"o{i}_{j}" for j in range(30)) for i in range(20)}
    rows = N.classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in rows} == brute(texts)
    assert all(r.n_links > 0 for r in rows if r.doc_id < 120) and all(r.n_links == 0 for r in rows if r.doc_id >= 1000)


def test_links_of_families_above_the_small_bucket(spark, monkeypatch):
    """Every link counts, in one block or several, also of sets unlike the family's centre."""
    made = random.Random(5)
    texts = {}
    for i in range(90):
        words = [f"w{k}" for k in range(150)]
        for at in made.sample(range(150), 1 + i % 4):
            words[at] = f"x{i}_{at}"
        texts[i] = " ".join(words)
    texts |= {500 + i: " ".join([f"v{k}" for k in range(100)] + [f"y{i}"]) for i in range(40)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    sets = {i: shingles(t) for i, t in texts.items()}
    want = {a: sum(len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for b in sets if b != a) for a in sets}
    for block in (N.BLOCK_SETS, 16):
        monkeypatch.setattr(N, "BLOCK_SETS", block)
        rows = N.classes(frame).collect()
        assert {r.doc_id: r.n_links for r in rows} == want
        assert {r.doc_id: r.class_id for r in rows} == brute(texts)


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 130)]
    got = {r.v: r.label for r in N.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in [*range(41), 130]) and all(got[i] == 100 for i in range(100, 130))


def test_odd_rows(odd, none):
    rows = N.classes(odd).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == odd.count() and got[7].class_id == 6 and got[7].n_copies == 3
    assert all(got[i].class_id == i for i in (1, 2, 3, 4, 5, 8, 9))
    kept = sorted((r.doc_id or 0) for r in N.without_near_copies(odd).collect())
    assert kept == [0, 1, 2, 3, 4, 5, 6, 8, 9] and N.without_near_copies(odd).columns == odd.columns
    assert N.classes(none).count() == 0 and N.without_near_copies(none).count() == 0


def test_ids_that_are_null_or_shared(spark):
    """Only copies go: different texts stay, also under one id or none."""
    long = [" ".join(f"{x}{i}" for i in range(40)) for x in "abc"]
    near = long[0] + " more"
    for rows, want in (
        ([(None, long[0]), (None, long[1]), (3, long[2])], 3),
        ([(1, long[0]), (1, long[1]), (3, long[2])], 3),
        ([(None, long[0]), (None, long[0]), (None, near), (2, long[1]), (2, near)], 2),
        ([(1, long[0]), (1, long[0]), (1, near), (None, ""), (None, ""), (4, None)], 4),
    ):
        frame = spark.createDataFrame(rows, "doc_id long, text string")
        kept = N.without_near_copies(frame).collect()
        assert len(kept) == want
        shown = sorted(N.classes(frame).select("doc_id", "class_id", "n_links").collect(), key=str)
        assert len(shown) == len(rows)
    assert {r.class_id for r in N.classes(spark.createDataFrame([(None, long[0]), (7, near), (5, long[1])], "doc_id long, text string")).collect()} == {7, 5}
