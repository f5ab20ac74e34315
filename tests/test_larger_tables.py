"""Faults that showed on larger tables, on small literals."""

import pyarrow as pa

from corpusloom.operators import index, many


def files(spark, *rows):
    return spark.createDataFrame([("project", "/project", p, t) for p, t in rows], "origin string, root string, rel_path string, text string")


def test_rows_of_one_path_are_one_file_for_references(spark):
    got = index.references(files(spark, ("a", "that one\nx"), ("a", "other\nthat"), ("b", "nothing")), "that").distinct().collect()
    assert sorted((r.path, r.line, r.col, r.text) for r in got) == [("a", 1, 1, "other"), ("a", 1, 1, "that one"), ("a", 2, 1, "that"), ("a", 2, 1, "x")]


def test_a_line_goes_on_once_whatever_it_meets(monkeypatch):
    monkeypatch.setattr(many, "MOST_CHARS", 1000)
    words = [f"w{i:03}" for i in range(300)]
    line = " ".join(words)
    batch = pa.RecordBatch.from_arrays([pa.array([line, "none", line, line])], ["text"])
    out = list(many._sieve({w: [i] for i, w in enumerate(words)}, [])([batch]))
    assert sum(b.num_rows for b in out) == 3 and max(b.num_rows for b in out) == 1
    assert all(x == list(range(300)) for b in out for x in b.column("ats").to_pylist())
    assert max(b.nbytes for b in out) < 2 * len(line) + 4 * 300


def test_identifiers_by_runs_are_those_of_the_pattern():
    import random

    import regex

    from corpusloom.operators import segments

    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("ab_1٣é日\U0001f600 -\n²") for _ in range(rng.randrange(40)))
        want = [(m[0], 1 + text.count("\n", 0, m.start()), 1 + len(text[text.rfind("\n", 0, m.start()) + 1 : m.start()].encode())) for m in regex.finditer(segments.IDENTIFIER, text)]
        terms, lines, cols = segments.places(text)
        assert list(zip(terms, lines.tolist(), cols.tolist())) == want


def test_held_rows_are_few_entries_of_the_state():
    from types import SimpleNamespace as N

    from corpusloom.streaming import streams

    entries, calls = [], []
    held = N(appendValue=lambda e: (calls.append(1), entries.append(e)), appendList=lambda es: (calls.append(1), entries.extend(es)), get=lambda: iter(list(entries)), put=lambda es: entries.__setitem__(slice(None), es), clear=entries.clear)
    value = N(exists=lambda: False, get=lambda: None, update=lambda s: None, clear=lambda: None)
    handle = N(getListState=lambda *_: held, getValueState=lambda *_: value, registerTimer=lambda ms: None)
    seen = []
    made = streams._ordered_processor(["k"], "long", "long", lambda state, rows, now: (None, None, seen.extend(rows) or []))
    made.init(handle)
    rows = [(5000 * ((i * 37) % 3000), i, i) for i in range(3000)]
    list(made.handleInputRows((1,), iter([N(us=u, tie=t, value=v) for u, t, v in rows]), None))
    assert len(calls) == 1 and len(entries) == 3
    list(made.handleExpiredTimer((1,), N(getCurrentWatermarkInMs=lambda: 5 * 1000), None))
    list(made.handleExpiredTimer((1,), N(getCurrentWatermarkInMs=lambda: 1 << 40), None))
    assert seen == sorted(rows) and not entries


def test_trigrams_of_a_block_come_once_over_batches(monkeypatch):
    from corpusloom.operators import trigrams

    batches = [pa.RecordBatch.from_arrays([pa.array([0, 0], pa.int32()), pa.array(["same text", "same text more"])], ["block", "text"])] * 50
    got = [x for b in trigrams._block_grams(iter(batches)) for x in b.column("gram").to_pylist()]
    assert len(got) == len(set(got)) == len(trigrams._grams("same text more"))


def test_word_at_by_near_terms(spark):
    postings = index.build_postings(files(spark, ("a", "ab cd ef"), ("b", "é_x")))
    at = lambda p, c: index.word_at(postings, spark.createDataFrame([(p, 1, c)], "path string, line int, at int")).first().term
    assert [at("a", 1), at("a", 3), at("a", 5), at("b", 4), at("b", 9)] == ["ab", None, "cd", "é_x", None]


def test_the_language_table_counts_every_row(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from corpusloom.llm import langid

    rows = spark.range(9000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "xyz").otherwise("abc").alias("text"), F.lit("en").alias("lang"))
    _, table = langid.learn(rows, "doc_id", "text", "lang")
    code = langid.trigram_codes(langid.words_only("xyz"))[1]
    assert abs(table[code, 0] - np.log(900.05 / (27000 + 0.05 * langid.BUCKETS))) < 1e-4


def test_a_pattern_of_a_table_is_tried_once_on_a_line(spark):
    from corpusloom.operators import grep

    corpus = files(spark, ("a", "word and words\nWORD\nno such"), ("b", "a word"))
    hits = many.grep_table(corpus, spark.createDataFrame([("word(?!s)",), ("wordy",), ("such$",)], "pattern string"))
    assert "RLIKE" not in hits._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((r.pattern, r.path, r.line, r.col, r.match, r.text) for r in hits.collect())
    want = sorted((p, r.path, r.line, r.col, r.match, r.text) for p in ("word(?!s)", "wordy", "such$") for r in grep.grep(corpus, p).collect())
    assert got == want and len(got) == 4
