"""Centroids, collocations and toxicity against plain versions and held-out labels."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from corpusloom.llm import centroids, collocations, oracles, toxicity


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


# --- centroids ---


def plain_clusters(rows, rounds=10):
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    c = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:8]]
    d = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for turn in range(rounds + 1):
        own = [min((d(v, x), j) for j, x in enumerate(c)) for _, v in kept]
        if turn < rounds:
            for j in range(len(c)):
                if mine := [v for (_, v), (_, k) in zip(kept, own) if k == j]:
                    c[j] = [sum(x) // len(mine) for x in zip(*mine)]
    sums = Counter()
    for dist, j in own:
        sums[j] += dist
    short = lambda x: x if x < 1 << 63 else None
    return sorted(((i, j, short(dist), short(sums[j]), short(sum(sums.values())), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (dist, j) in zip(kept, own)), key=repr)


def test_centroids_equal_sql(spark, sf_dir):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    told = []
    got = centroids.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), told=told)
    want = duck.execute(oracles.OP12)
    assert [x[0] for x in want.description] == got.columns
    assert rows_of(got) == sorted(want.fetchall(), key=repr)
    # The filter leaves fewer than all eight distances of a vector to compare.
    assert all(n <= c <= 8 * n for c, n in told) and sum(c for c, _ in told) < 6 * sum(n for _, n in told)


def test_centroids_of_odd_vectors(spark):
    rng = np.random.default_rng(1)
    good = [(i, [float(x) for x in rng.standard_normal(64)]) for i in range(30)]
    tied = [(100 + i, [float(i % 2)] * 64) for i in range(6)] + [(7, good[7][1]), (7, good[7][1])]
    bad = [(200, [1.0] * 63), (201, [1.0] * 65), (202, None), (203, [None] + [1.0] * 63), (204, [float("nan")] * 64), (205, [float("inf")] * 64), (206, [])]
    frame = lambda rows: spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster string")
    narrow = [(i, [float(np.float32(x)) for x in v]) for i, v in good + tied]
    assert rows_of(centroids.cluster(frame(good + tied + bad))) == plain_clusters(narrow)
    assert centroids.cluster(frame(bad)).count() == 0 and centroids.cluster(frame([])).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    few = good[:3] + [(None, good[4][1])]
    assert rows_of(centroids.cluster(frame(few))) == plain_clusters([(i, [float(np.float32(x)) for x in v]) for i, v in few])


def test_centroids_of_large_components(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(64) * 10.0 ** (i % 12)]) for i in range(24)]
    got = centroids.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert rows_of(got) == plain_clusters(rows)


def test_bounds_hold_the_distance():
    rng = np.random.default_rng(3)
    points = rng.integers(-2000, 2000, (300, 64))
    simplex = centroids.Simplex(points[:8])
    assert len(simplex.pivots) == 8
    a, b = (simplex.apexes(simplex.distances(points[i])) for i in (slice(8, 100), slice(100, 192)))
    true = np.sqrt(((points[8:100] - points[100:192]) ** 2).sum(1))
    flat = ((a[:, :-1] - b[:, :-1]) ** 2).sum(1)
    assert (np.sqrt(flat + (a[:, -1] - b[:, -1]) ** 2) <= true + 1e-6).all() and (true <= np.sqrt(flat + (a[:, -1] + b[:, -1]) ** 2) + 1e-6).all()
    # Above the pivots themselves both bounds are the distance.
    on = simplex.apexes(simplex.distances(points[:8]))
    assert np.allclose(np.sqrt(((a[:, None] - on[None]) ** 2).sum(2)), np.sqrt(((points[8:100, None] - points[None, :8]) ** 2).sum(2)))


# --- collocations ---


def plain_phrases(rows, top, least):
    by, out = {}, []
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^ \t]+", piece)
            by.setdefault("und" if lang is None else lang, Counter()).update(tuple(words[i : i + m]) for m in range(1, 6) for i in range(len(words) - m + 1))
    for lang, f in by.items():
        n = sum(a for p, a in f.items() if len(p) == 1)
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        alive = [p for p in found if not any(len(q) > len(p) and found[q] >= found[p] and inside(p, q) for q in found)]
        best = [(*min((1000 * found[p] * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))), p) for p in alive]
        order = sorted((-s, -found[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]) for s, k, p in best)
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(order[:top])]
    return sorted(out, key=repr)


def made(seed, n=400):
    rng = np.random.default_rng(seed)
    words = ["the", "of", "Alpha", "beta", "GAMMA", "delta", "é", "日本", "x1", "omega"]
    odds = np.array([8, 6, 3, 3, 2, 2, 1, 1, 1, 1]) / 28
    texts = []
    for i in range(n):
        w = list(rng.choice(words, rng.integers(0, 30), p=odds))
        if i % 5 == 0:
            w[3:3] = ["New", "York", "stock", "exchange", "opens", "today"]
        texts.append((["en", "en", "de", None][int(rng.integers(4))], "".join(x + str(rng.choice([" ", "  ", "\t", ", ", "\n", ". ", " \r"], p=[0.8, 0.04, 0.04, 0.04, 0.03, 0.03, 0.02])) for x in w)))
    return [*texts, ("en", None), ("en", ""), ("fr", " .,; \n"), ("und", "the of"), (None, "the of")]


@pytest.mark.parametrize(("seed", "top", "least"), [(1, 2000, 5), (2, 12, 5), (3, 5, 20), (4, 1, 3)])
def test_collocations_equal_plain_counts(spark, seed, top, least):
    rows = made(seed)
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, text string, phrase string, word int").repartition(3)
    assert rows_of(collocations.mine(frame, top, least)) == plain_phrases(rows, top, least)


def test_the_frontier_is_grown_in_parts(spark, monkeypatch):
    """Small parts of the frontier, bitmaps that often hit falsely and blocks of a few words change nothing."""
    rows = made(5)
    frame = spark.createDataFrame(rows, "lang string, text string").coalesce(2)
    monkeypatch.setattr(collocations, "FRONTIER", (0.1, 0.4, 1.0))
    assert rows_of(collocations.mine(frame, 3, 4)) == plain_phrases(rows, 3, 4)


def test_blocks_of_long_texts():
    data = (" ".join(f"w{i % 7}" if i % 11 else f"w{i % 7} ." for i in range(400))).encode().translate(collocations.SIGNS)
    for size in (1, 5, 17, 64):
        own, whole = Counter(), Counter()
        was, collocations.BLOCK = collocations.BLOCK, size
        try:
            parts = [collocations._Block(part, ["en"], [0], core) for part, core in collocations._cut(data)]
        finally:
            collocations.BLOCK = was
        for blocks, into in ((parts, own), ([collocations._Block(data, ["en"], [0])], whole)):
            for x in blocks:
                for m in range(1, 6):
                    before = np.concatenate([[False], x.joined(2)[:-1]])
                    into.update((x.text(i, m), x.text(i - 1, 1) if before[i] else None, x.text(i + m, 1) if x.joined(m + 1)[i] else None) for i in np.flatnonzero(x.core & x.joined(m)))
        assert own == whole


def test_collocations_of_odd_tables(spark, odd, none):
    assert collocations.mine(none).count() == 0
    found = {r.phrase: r.a for r in collocations.mine(odd, least=100).collect()}
    assert found and all(a >= 100 for a in found.values())


# --- toxicity ---


def test_toxic_texts_are_found(spark, sf_dir):
    """Trained on sf0.1's labels, the classifier finds held-out toxic texts and leaves others alone."""
    larger = sf_dir.replace("sf0.001", "sf0.1")
    docs, labels = (spark.read.parquet(f"{larger}/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.judge(docs, labels)
    assert found.count() == docs.count()
    rows = found.where("held_out").join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    english = [r for r in rows if r.lang == "en"]
    assert sum(r.predicted for r in english if r.toxic) >= 0.8 * sum(r.toxic for r in english)
    assert sum(r.predicted for r in rows if not r.toxic) <= 0.1 * sum(1 - r.toxic for r in rows)


def test_scores_ignore_everything_but_the_text(spark, odd, none):
    marked = [(i, f"{'you vile fool' if i % 3 == 0 else 'a calm day'} number {'abcdefgh'[i % 8]}", "en", "s") for i in range(300)]
    docs = spark.createDataFrame(marked, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(300)] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, labels)
    first = {r.text: r.score for r in toxicity.score(docs, model).join(docs, "doc_id").collect()}
    other = docs.selectExpr("doc_id + 1000 AS doc_id", "text", "'xx' AS lang", "null AS source", "1 AS score")
    again = {r.text: r.score for r in toxicity.score(other, model).join(other.drop("score"), "doc_id").collect()}
    assert first == again and all((s >= 0.5) == ("vile" in t) for t, s in first.items())
    assert toxicity.score(odd, model).count() == odd.count() and toxicity.score(none, model).count() == 0
    assert toxicity.learn(docs, labels.where("toxic = 1")) is None and {r.score for r in toxicity.judge(odd, labels.where("false")).collect()} == {0.0}


def test_whole_texts_in_pieces(monkeypatch):
    rng = np.random.default_rng(4)
    ids = [rng.integers(0, 50, n).astype(np.int32) for n in (0, 1, 2, 3, 40, 500)]
    model = toxicity._trained([ids[4], ids[5]] * 6, np.array([0, 1] * 6, np.float32))
    want = toxicity.pooled(model, model.tables(), ids)
    monkeypatch.setattr(toxicity, "PIECE", 7)
    assert np.allclose(toxicity.pooled(model, model.tables(), ids), want, atol=1e-6)
    text = "Ein Wort, dann é mehr\n" * 40
    whole = toxicity.buckets(text.encode())
    monkeypatch.setattr(toxicity, "BYTES", 5)
    assert (toxicity.buckets(text.encode()) == whole).all() and len(whole) == 200
