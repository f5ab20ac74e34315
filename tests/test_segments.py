"""Block postings and incremental segments against plain indexes; fuzzy runs and completion on them."""

import random
import re
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from corpusloom.operators import index, results, segments

WORD = re.compile(r"[^\W\d]\w*")


def plain(files):
    out = []
    for path, text in files:
        for i, line in enumerate((text or "").split("\n")):
            out += [(m[0], path, i + 1, 1 + len(line[: m.start()].encode())) for m in WORD.finditer(line)]
    return sorted(out)


def frame(spark, files):
    return spark.createDataFrame([("o", p, t) for p, t in files], "origin string, rel_path string, text string")


def held(spark, folder):
    return sorted((r.term, r.path, r.line, r.col) for r in segments.TermIndex(spark, folder).postings().collect())


def counts(rows):
    out = {}
    for r in rows:
        out[r[0]] = out.get(r[0], 0) + 1
    return out


def signs(told):
    return {r.sign: r.n for r in told.collect()}


def test_varints_and_places():
    rng = np.random.default_rng(1)
    n = np.concatenate([[0, 1, 127, 128, 16383, 16384, (1 << 62) + 5], rng.integers(0, 1 << 40, 500)])
    data, at = segments.varints(n)
    assert (segments.numbers_of(data) == n).all() and at[-1] == len(data)
    rows = sorted({(int(g), int(o), int(ln), int(c)) for g, o, ln, c in zip(*[rng.integers(0, k, 900) for k in (6, 5, 9, 200)])})
    g, o, ln, c = (np.array(x) for x in zip(*rows))
    data, at = segments.coded(g, o, ln, c)
    sizes = np.unique(g, return_counts=True)[1]
    assert (segments.decoded([data[a:b] for a, b in zip(at[:-1], at[1:])], sizes) == np.array(rows)[:, 1:]).all()
    assert len(data) < 4 * len(rows)


FIRST = [("a", "one two one\n\n two é日本 x1"), ("b", "one\r\ntwo"), ("c", ""), ("d", None), ("e/f", "gone soon one"), ("g", "same"), ("g", "same row"), ("h", "\U0001f600 wide é two\n" * 3)]
SECOND = [("a", "one two one\n\n two é日本 x1"), ("b", "one\r\nthree"), ("c", "now text"), ("d", None), ("g", "same"), ("g", "same row again"), ("h", "\U0001f600 wide é two\n" * 3), ("new", "one brand new")]


@pytest.mark.parametrize("block", [1, 3])
def test_edits_adds_and_deletes(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(segments, "BLOCK_FILES", block)
    monkeypatch.setattr(segments, "MOST_PLACES", 4)
    folder = str(tmp_path / "index")
    assert signs(segments.refresh(spark, folder, frame(spark, FIRST).repartition(2), parts=2)) == {"+": 7}
    assert held(spark, folder) == plain(FIRST)
    assert signs(segments.refresh(spark, folder, frame(spark, SECOND))) == {"+": 1, "~": 3, "_": 1}
    assert held(spark, folder) == plain(SECOND)
    found = segments.TermIndex(spark, folder)
    assert {r.term: r.n for r in found.terms().collect()} == counts(plain(SECOND))
    # Only what changed was taken in.
    assert sorted({r.path for r in segments._read(spark, folder, found.segments[1:], "files", segments.FILES).collect()}) == ["b", "c", "g", "new"]
    assert signs(segments.refresh(spark, folder, frame(spark, SECOND))) == {} and segments.manifest(spark, folder)[0] == 2
    segments.merge(spark, folder)
    assert segments.vacuum(spark, folder) == 2 and held(spark, folder) == plain(SECOND)
    merged = segments.TermIndex(spark, folder)
    assert len(merged.segments) == 1 and {r.term: r.n for r in merged.terms().collect()} == counts(plain(SECOND))
    assert signs(segments.refresh(spark, folder, frame(spark, FIRST))) == {"+": 1, "~": 3, "_": 1} and held(spark, folder) == plain(FIRST)
    assert signs(segments.refresh(spark, folder, frame(spark, FIRST[:0]))) == {"_": 7} and held(spark, folder) == []


def test_random_histories(spark, tmp_path):
    rng = random.Random(3)
    folder = str(tmp_path / "index")
    state = {}
    for _ in range(3):
        for p in rng.sample("abcdefghij", 5):
            state[p] = " ".join(rng.choice(["x", "yy", "z1", "é", "\n", "9"]) for _ in range(rng.randrange(12)))
        for p in rng.sample(sorted(state), 2):
            del state[p]
        segments.refresh(spark, folder, frame(spark, sorted(state.items())))
        assert held(spark, folder) == plain(state.items())


def test_a_refresh_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "index")
    segments.refresh(spark, folder, frame(spark, FIRST))
    monkeypatch.setattr(segments, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        segments.refresh(spark, folder, frame(spark, SECOND))
    monkeypatch.undo()
    assert held(spark, folder) == plain(FIRST)
    assert signs(segments.refresh(spark, folder, frame(spark, SECOND)))["+"] == 1 and held(spark, folder) == plain(SECOND)
    assert segments.vacuum(spark, folder) == 1 and held(spark, folder) == plain(SECOND)
    with pytest.raises(OSError):
        segments._publish(spark, folder, 2, [])


def test_stamps_spare_the_texts(spark, tmp_path):
    """With a stamp, a changed text under an old stamp isn't looked at, and one under a new stamp is."""
    folder = str(tmp_path / "index")
    files = frame(spark, FIRST[:3]).withColumn("mtime", F.lit(1))
    segments.refresh(spark, folder, files, stamp=F.col("mtime"))
    other = files.withColumn("text", F.lit("other"))
    assert signs(segments.refresh(spark, folder, other, stamp=F.col("mtime"))) == {}
    touched = other.withColumn("mtime", F.when(F.col("rel_path") == "b", 2).otherwise(1))
    assert signs(segments.refresh(spark, folder, touched, stamp=F.col("mtime"))) == {"~": 1}
    assert held(spark, folder) == plain([FIRST[0], ("b", "other"), FIRST[2]])


def test_reads_of_the_index(spark, tmp_path):
    folder = str(tmp_path / "index")
    segments.refresh(spark, folder, frame(spark, FIRST))
    found = segments.TermIndex(spark, folder)
    assert [(r.path, r.line, r.col) for r in found.of_term("two").orderBy("path", "line").collect()] == [(p, ln, c) for t, p, ln, c in plain(FIRST) if t == "two"]
    assert {r.path for r in found.of_paths(spark.createDataFrame([("a",), ("zz",)], "path string")).collect()} == {"a"}
    refs = index.indexed_references(found, frame(spark, FIRST), "one")
    assert sorted((r.path, r.line, r.text) for r in refs.collect()) == [("a", 1, "one two one"), ("b", 1, "one\r"), ("e/f", 1, "gone soon one")]
    plan = results.complete_prefix([found.terms()], "t", 5)
    assert [(r.term, r.freq) for r in plan.collect()] == [("two", 6)]
    shown = plan._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(term,t)" in shown and "postings" not in shown
    assert "EqualTo(term,two)" in found.of_term("two")._jdf.queryExecution().executedPlan().toString()


def test_fuzzy_runs(spark):
    rng = random.Random(4)
    rows = ["".join(rng.choice("aAbBcé.") for _ in range(rng.randrange(0, 14))) for _ in range(400)]
    df = spark.createDataFrame([(r,) for r in rows], "v string")
    for query in ("a", "ab", "aBc", "bb", "é.a", "", "abcab"):
        form = re.compile(".*?".join(re.escape(c) for c in query), re.I | re.A)
        want = [len(m[0]) if query and (m := form.search(r)) else None for r in rows]
        assert [r[0] for r in df.select(results.fuzzy_span(F.col("v"), query)).collect()] == want
    long = spark.createDataFrame([("li" * 500_000 + "cn",), ("li" * 500_000,)], "v string")
    long.count()
    began = time.time()
    assert [r.span for r in results.fuzzy_topk(long, "v", "licn", 5).collect()] == [1_000_002]
    assert time.time() - began < 20  # cubic time would take days


def test_places_of_many_texts_at_once():
    """Texts of a batch are searched as one run of bytes; none goes on in the next, whatever signs they end with."""
    rng = random.Random(8)
    signs = ["a", "Z", "_", "7", "é", "ß", "日", "\U0001d400", "\U0001f600", "٣", "\n", "\r", " ", "-", "́", " "]
    texts = ["", None, "ab", "cd", "9x", "é", "é", "\n", "日本", "", "x\n", "٣٣", *("".join(rng.choice(signs) for _ in range(rng.randrange(25))) for _ in range(800)), "end"]
    for rows in (texts, texts[3:7], [None], [""], []):
        for form in (pa.string(), pa.large_string()):
            array = pa.concat_arrays([pa.array(["left out"], form), pa.array(rows, form)]).slice(1)
            terms, of, lines, cols = segments.places_in(array)
            got = list(zip(of.tolist(), terms.to_pylist(), lines.tolist(), cols.tolist()))
            want = [(i, m[0], n, 1 + len(line[: m.start()].encode())) for i, t in enumerate(rows) for n, line in enumerate((t or "").split("\n"), 1) for m in regex.finditer(segments.IDENTIFIER, line)]
            assert got == want


def test_blocks_cost_little():
    """Four million characters take no Python string for each identifier."""
    words = " ".join(f"word{i % 5000} né" for i in range(350_000))
    batch = pa.RecordBatch.from_arrays([pa.array(["o"] * 100), pa.array([f"f{i}" for i in range(100)]), pa.array([words[i * 40_000 : (i + 1) * 40_000] for i in range(100)]), pa.array([1] * 100)], ["origin", "path", "text", "_part"])
    segments._kinds()
    tracemalloc.start()
    n = sum(r.column("n")[i].as_py() for r in segments._blocks([batch]) for i in range(r.num_rows) if r.column("kind")[i].as_py())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == sum(len(WORD.findall(t.as_py())) for t in batch.column("text")) and peak < 120 << 20


def test_only_lines_with_the_symbol_leave_a_file(spark, tmp_path):
    """The index names a file's lines, so the others are neither exploded nor joined; a file of very many such lines is cut once."""
    folder = str(tmp_path / "index")
    many = [*FIRST, ("big", "one more\nnone\n" * 60_000), ("g", "x\n\none\n"), (None, "one"), ("end", "one\n")]
    rows = frame(spark, many)
    segments.refresh(spark, folder, rows)
    found = index.indexed_references(segments.TermIndex(spark, folder), rows, "one")
    want = sorted((r.path, r.line, r.col, r.text) for r in index.references(rows, "one").collect())
    assert len(want) > 60_000 and sorted((r.path, r.line, r.col, r.text) for r in found.collect()) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" not in plan and "line#" not in " ".join(x for x in plan.splitlines() if "Join" in x)


def test_coded_rows_are_written_where_they_are_made(spark, tmp_path):
    """A refresh neither stages nor shuffles the coded rows: each file has the rows of one task, sorted by term, after those of its files; ``merge`` deals them by term."""
    folder = str(tmp_path / "index")
    files = [(f"f{i:02}", f"every word{i} é{i} z" * 3) for i in range(60)]
    for part in (files[:40], files):
        segments.refresh(spark, folder, frame(spark, part).repartition(3), parts=3)
    tasks = []
    for path in (tmp_path / "index").rglob("postings/*.parquet"):
        rows = spark.read.parquet(str(path)).coalesce(1).collect()
        terms = [(r.term is not None, (r.term or "").encode(), r.block) for r in rows]
        assert terms == sorted(terms)
        tasks += {r.block >> 20 for r in rows}
        assert len({r.block >> 20 for r in rows}) <= 1
    assert len(tasks) == len(set(tasks)) >= 4
    assert held(spark, folder) == plain(files)
    assert {r.term: r.n for r in segments.TermIndex(spark, folder).terms().collect()} == counts(plain(files))
    segments.merge(spark, folder)
    assert held(spark, folder) == plain(files) and spark.read.parquet(f"{folder}/segments/{segments.manifest(spark, folder)[1][0]}/postings").where("term is null").isEmpty()
