"""Edge cases from literals, and properties of what SQL can't say."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import paths
from corpusloom.operators import catalog, grep, index, progress, resolve, results, rules
from corpusloom.sources import corpus
from corpusloom.sources.tables import drop_scratch, shared_dir, staged
from corpusloom.streaming import streams

FILE = "origin string, root string, rel_path string, text string"


def files(spark, *rows):
    return spark.createDataFrame([("project", "/p", path, text) for path, text in rows], FILE)


def one(spark, column, *values):
    return [r.x for r in spark.createDataFrame([(v,) for v in values], "v string").select(column(F.col("v")).alias("x")).collect()]


def test_code_suffixes(spark):
    names = ["a.cpp", "a.CPP", "a.cpp.bak", "a.usf", "dir.c/b", "x.inl", "c"]
    assert [r.rel_path for r in rules.code_files(files(spark, *[(n, "") for n in names])).collect()] == ["a.cpp", "x.inl"]


def test_rule_texts(spark):
    got = {(r.pattern, r.kind) for r in rules.parse_rules(spark, "project", "// p4\nSaved\nEngine\\Binaries\n\n\r\n").collect()}
    assert got == {("Saved", "name"), ("Engine/Binaries", "anchored")}


def test_ignore(spark):
    rows = files(spark, *[(p, "") for p in ("Saved/a", "x/Saved/b", "Saved2/c", "Engine/Binaries/d", "x/Engine/Binaries/e", "Engine/BinariesX/f", "g.tmp", "d/h.tmp", "a.b/i")])
    own = rules.parse_rules(spark, "project", "Saved\nEngine\\Binaries\n*.tmp\na/b")
    assert sorted(r.rel_path for r in rules.apply_ignore(rows, own).collect()) == ["Engine/BinariesX/f", "Saved2/c", "a.b/i", "x/Engine/Binaries/e"]
    assert rules.apply_ignore(rows, own.where("false")).count() == 9


def test_default_rules_only_where_there_are_none(spark):
    user, default = rules.parse_rules(spark, "project", "a"), rules.parse_rules(spark, "project", "b").unionByName(rules.parse_rules(spark, "engine", "c"))
    assert {(r.origin, r.pattern) for r in rules.effective_rules(user, default).collect()} == {("project", "a"), ("engine", "c")}


@pytest.mark.parametrize("glob, path, hit", [("**/Binaries/**", "a/Binaries/b", True), ("**/Binaries/**", "Binaries/b", True), ("**/Binaries/**", "aBinaries/b", False), (".git/*", ".git/x", True), (".git/*", ".git/x/y", False), ("a?.[c]", "ab.[c]", True)])
def test_globs(spark, glob, path, hit):
    assert rules.exclude_globs(files(spark, (path, "")), [glob]).count() == (0 if hit else 1)


def test_kv_lines(spark):
    got = one(spark, paths.parse_kv_line, "   {A-B}    REG_SZ    C:\\x y  ", "nothing here")
    assert tuple(got[0]) == ("{A-B}", "REG_SZ", "C:/x y") and got[1] is None


def test_small_forms(spark):
    assert one(spark, paths.is_braced_guid, "{A-B}", "5.3", "{A}{B}") == [True, False, False]
    assert one(spark, lambda c: paths.json_field(c, "EngineAssociation"), '{"EngineAssociation" : "{A-B}"}', "{}") == ["{A-B}", None]
    hit = one(spark, paths.parse_hit_line, "C:/a:b.h:12:x:y", "no hit")
    assert tuple(hit[0]) == ("C:/a:b.h", 12, 1, "x:y") and hit[1] is None
    assert one(spark, paths.group_of, "Git: x", "no label", "LSP : y") == ["Git", "General", "LSP"]
    assert one(spark, paths.norm_path, None, "a\\b") == ["", "a/b"]
    assert one(spark, paths.shorten_path, "abc/def/ghi.txt", "x") == ["a/d/ghi.txt", "x"]
    assert one(spark, paths.strip_trailing_blank_lines, "a\n\r\n\n", "a\n b") == ["a", "a\n b"]
    assert one(spark, paths.filetype_of, "a/b.usf", "c.h", "d") == ["hlsl", "h", ""]
    assert one(spark, lambda c: paths.catalog_line(F.lit("n"), c, F.lit("d")), "ab", "x" * 14) == ["- [n] ab           : d", f"- [n] {'x' * 14} : d"]


def test_managed_block(spark):
    put = lambda c: paths.upsert_block(c, "#>", "#<", "new")
    block = "#>\nnew\n#<\n"
    olds = ["", "a", "a\n", "#>\nx\n#<\na\n", "a\n#>\nx\n#<\nkept\n#>\ny\n#<"]
    got = one(spark, put, *olds)
    assert got == [block, "a\n" + block, "a\n" + block, "a\n" + block, "a\nkept\n" + block]
    assert one(spark, put, *got) == got


def test_smart_case():
    assert grep.smart_case("license") == "(?i)license" and grep.smart_case("License") == "License" and grep.smart_case(r"\S\W") == r"(?i)\S\W"


def test_grep_positions(spark):
    rows = files(spark, ("a", "ab ab\n\nÄÖ ab x\n"), ("b", None), ("c", ""))
    assert [(r.path, r.line, r.col, r.match) for r in grep.grep(rows, "ab").collect()] == [("a", 1, 1, "ab"), ("a", 1, 4, "ab"), ("a", 3, 6, "ab")]
    assert grep.grep(rows, "").count() == 0 and grep.grep(rows, "zzz").count() == 0
    assert [(r.line, r.col) for r in grep.grep(rows, "^ab").collect()] == [(1, 1)]
    with pytest.raises(Exception):
        grep.grep(rows, "a(")
    with pytest.raises(ValueError):
        grep.grep(rows, "x*")


def test_long_lines_have_all_positions(spark):
    got = [r.col for r in grep.grep(files(spark, ("a", "ab " * 700)), "ab").orderBy("col").collect()]
    assert got == [1 + 3 * i for i in range(700)]


def test_lines(spark):
    rows = files(spark, ("a", "x\r\n\r\ny\n"), ("b", "\n"), ("c", ""))
    assert [r.text for r in corpus.read_lines(rows).collect()] == ["x", "y"]
    assert [(r.path, r.line, r.text) for r in corpus.numbered_lines(rows).collect()] == [("a", 1, "x\r"), ("a", 2, "\r"), ("a", 3, "y"), ("b", 1, "")]
    assert [r.n_lines for r in progress.line_counts(rows).collect()] == [3, 1, 0]


def test_files_of_a_tree(spark, tmp_path):
    (tmp_path / "Source").mkdir()
    (tmp_path / "Source" / "a.cpp").write_text("int x;\n")
    (tmp_path / "b.txt").write_text("t")
    found = corpus.scan_files(spark, str(tmp_path))
    assert sorted((r.rel_path, r.text) for r in found.collect()) == [("Source/a.cpp", "int x;\n"), ("b.txt", "t")]
    assert corpus.restrict_paths(found, ["Source"]).count() == 1


def test_odd_files_and_folders(spark, tmp_path):
    """A folder whose name is a pattern, a file that is no UTF-8, a name with a space and a percent sign."""
    root = tmp_path / "t+x (1)"
    (root / "d").mkdir(parents=True)
    (root / "d" / "a 5%.txt").write_bytes("caf\u00e9".encode("latin-1"))
    (root / "b.txt").write_text("t")
    found = corpus.scan_files(spark, str(root))
    assert sorted((r.rel_path, r.text) for r in found.collect()) == [("b.txt", "t"), ("d/a 5%.txt", "caf\ufffd")]


def test_throttle_keeps_keys_as_they_are(spark):
    rows = spark.sql("SELECT k, i, timestamp_micros(ms * 1000) AS ts FROM VALUES (cast(null as bigint), 0, 0), (null, 1, 10), (null, 2, 600), (9007199254740993, 3, 0), (9007199254740993, 4, 20) t(k, i, ms)")
    assert sorted((r.i, r.k) for r in streams.throttle(rows, "k", "i", 500_000).collect()) == [(0, None), (2, None), (3, 9007199254740993)]


def test_references_with_and_without_an_index(spark, tmp_path):
    rows, folder = files(spark, ("a", "that x\nthatx\n9that a9that\nno"), ("b", "That")), str(tmp_path / "postings")
    index.write_postings(index.build_postings(rows), folder)
    for found in (index.references(rows, "that"), index.stored_references(spark, folder, rows, "that").distinct()):
        assert sorted((r.path, r.line) for r in found.collect()) == [("a", 1), ("a", 3)]


def test_refresh_builds_what_is_stale(spark, tmp_path):
    rows, folder = files(spark, ("a", "one two")), str(tmp_path / "postings")
    index.refresh_index(spark, rows, folder)
    stale = spark.createDataFrame([("project", True), ("engine", False)], "origin string, stale boolean")
    got = {r.origin: r.action for r in index.refresh_index(spark, rows, folder, freshness=stale).collect()}
    assert got == {"project": "built", "engine": "up to date"}
    assert spark.read.parquet(folder + "/project").count() == 2 and not corpus.index_exists(spark, folder + "/project.new")


def test_index_is_stored_read_and_dropped(spark, tmp_path):
    rows, folder = files(spark, ("a.cpp", "x"), ("b.txt", "y")), str(tmp_path / "index")
    calls = []
    scan = lambda: calls.append(1) or rows
    assert corpus.read_index_or_scan(spark, folder, scan).count() == 2 and calls
    corpus.write_index(rows, folder)
    assert corpus.read_index_or_scan(spark, folder, scan).count() == 2 and len(calls) == 1
    assert [r.path for r in corpus.read_list(spark, folder, "code_project").collect()] == ["a.cpp"]
    assert [(r.artefact, r.removed) for r in corpus.drop_index(spark, {"index": folder, "none": folder + "x"}).collect()] == [("index", True), ("none", False)]
    assert not corpus.index_exists(spark, folder)


def test_refresh_builds_what_is_missing_or_changed(spark, tmp_path):
    rows, folder = files(spark, ("a", "one two")), str(tmp_path / "postings")
    go = lambda changed=None: {r.origin: r.action for r in index.refresh_index(spark, rows, folder, changed).collect()}
    assert go() == {"project": "built", "engine": "built"}
    assert go() == {"project": "up to date", "engine": "up to date"}
    assert go(["engine"]) == {"project": "up to date", "engine": "built"}


def test_freshness_in_whole_seconds(spark):
    ts = lambda *c: [F.col(x).cast("timestamp").alias(x) if x.endswith("ts") else F.col(x) for x in c]
    sources = spark.createDataFrame([(k, "2024-01-01 00:00:05.9") for k in "abcd"], "k string, source_ts string").select(*ts("k", "source_ts"))
    parts = [("a", "2024-01-01 00:00:05.1"), ("b", "2024-01-01 00:00:04.9"), ("c", "2024-01-01 00:00:09"), ("c", None)]
    artifacts = spark.createDataFrame(parts, "k string, artifact_ts string").select(*ts("k", "artifact_ts"))
    assert {r.k: r.stale for r in index.stale_artifacts(sources, artifacts, "k").collect()} == {"a": False, "b": True, "c": True, "d": True}


def test_rename_whole_words_only(spark):
    rows = files(spark, ("a", "old olden old_ old\nold"), ("b", "older"))
    assert [r.text for r in index.rewrite_symbol(rows, "old", "n$w").collect()] == ["n$w olden old_ n$w\nn$w"]


def test_word_at(spark):
    postings = index.build_postings(files(spark, ("a", "ab  cd")))
    cursor = spark.createDataFrame([("a", 1, at) for at in (1, 2, 3, 5)], "path string, line int, at int")
    assert {r.at: r.term for r in index.word_at(postings, cursor).collect()} == {1: "ab", 2: "ab", 3: None, 5: "cd"}


def test_longest_root_wins_and_needs_a_separator(spark):
    rows = spark.createDataFrame([("/ue5/x",), ("/ue/y",), ("/ue5/deep/z",), ("/other",)], "path string")
    roots = spark.createDataFrame([("/ue",), ("/ue5",), ("/ue5/deep",)], "root string")
    assert {r.path: r.root for r in resolve.route_by_prefix(rows, roots).collect()} == {"/ue5/x": "/ue5", "/ue/y": "/ue", "/ue5/deep/z": "/ue5/deep", "/other": None}


def test_tiers_caps_and_ends(spark):
    rows = spark.createDataFrame([("q", 2, "b"), ("q", 3, "c"), ("r", 1, "a"), ("r", 2, "b")], "query string, tier int, path string")
    assert sorted((r.query, r.path) for r in results.first_nonempty_tier(rows).collect()) == [("q", "b"), ("r", "a")]
    assert results.cap_per_query(rows, "query", ["path"], 1).count() == 2
    ring = {r.path: (r.next, r.previous) for r in results.with_neighbours(rows.where("query = 'q'"), ["query"], ["path"], "path", wrap=True).collect()}
    assert ring == {"b": ("c", "c"), "c": ("b", "b")}
    flat = {r.path: (r.next, r.previous) for r in results.with_neighbours(rows.where("query = 'q'"), ["query"], ["path"], "path").collect()}
    assert flat == {"b": ("c", None), "c": (None, "b")}


def test_catalog_keeps_one_and_drops_empty(spark):
    rows = spark.createDataFrame([("n", "a", "Git: x"), ("n", "a", "Git: x"), ("n", "b", ""), ("n", "c", None), ("v", "d", "no label")], "mode string, lhs string, desc string")
    kept = catalog.dedupe_catalog(rows)
    assert kept.count() == 2 and {r.grp: r.n_entries for r in catalog.group_counts(kept).collect()} == {"Git": 1, "General": 1}


def test_progress_without_total_or_time(spark):
    rows = spark.sql("SELECT 1 AS job, timestamp'2024-01-01 00:00:00' AS ts")
    r = progress.progress(rows, "job", F.lit(1), "ts", F.lit(0)).first()
    assert (r.pct, r.rate, r.seconds) == (0, 1000.0, 0)
    lines = spark.createDataFrame([("[123] extracting tags of xxx",), ("extracting nothing",)], "text string")
    assert progress.count_marked_lines(lines, progress.DONE_MARKER).first().n_marked == 1


def test_throttle(spark):
    rows = spark.sql("SELECT 'k' AS k, i, timestamp_micros(ms * 1000) AS ts FROM VALUES (0, 0), (1, 499), (2, 500), (3, 999), (4, 1000) t(i, ms)")
    assert [r.i for r in streams.throttle(rows, "k", "i", 500_000).orderBy("i").collect()] == [0, 2, 4]


def test_stream_state_spans_batches(spark, tmp_path):
    data = str(tmp_path / "event")
    for n, ms in enumerate([(0, 499), (500, 999), (1000,)]):
        spark.sql("SELECT 'k' AS k, ms AS i, timestamp_micros(86400000000 + ms * 1000L) AS ts FROM VALUES " + ", ".join(f"({x})" for x in ms) + " t(ms)").coalesce(1).write.mode("append").parquet(data)
    stream = spark.readStream.schema(spark.read.parquet(data).schema).option("maxFilesPerTrigger", 1).parquet(data)
    assert sorted(r.i for r in streams.play_out(stream, lambda s: streams.throttle_stream(s, "k", "i", 500_000)).collect()) == [0, 500, 1000]


def test_scratch_lies_in_the_sessions_shared_folder_and_goes(spark):
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    assert shared_dir(spark) == f"{base}/{spark.sparkContext.applicationId}"
    kept = staged(spark.range(3), "t")
    assert kept.count() == 3
    assert drop_scratch(spark) and not drop_scratch(spark)
