"""Pattern tables, tiers in turn, definitions by suffix, counterparts and freshness on small literals."""

from pyspark.sql import functions as F

from corpusloom.operators import grep, index, many, progress, resolve, results


def files(spark, *rows):
    return spark.createDataFrame([("project", "/project", p, t) for p, t in rows], "origin string, root string, rel_path string, text string")


def test_a_thousand_patterns_in_one_pass(spark, monkeypatch):
    texts = [(f"f{i}", "\n".join(f"word{(i * 7 + j) % 1200}x and Word{j}y é\r" for j in range(20))) for i in range(12)]
    patterns = [f"word{i}[xy]" for i in range(990)] + ["Word1[0-9]y", "é$", "(?:and|or) w", r"word\d+(?!x)", "x.and", "[0-9]+x", "é\r", "no such", None, "", "and", "and"]
    corpus = files(spark, *texts, ("n", None), ("e", ""))
    table = spark.createDataFrame([(p,) for p in patterns], "pattern string")
    got = sorted((r.pattern, r.path, r.line, r.col, r.match) for r in many.grep_table(corpus, table).collect())
    few = ["word7[xy]", "word91[xy]", *[p for p in patterns[990:] if p]]
    want = {(p, r.path, r.line, r.col, r.match) for p in set(few) for r in grep.grep(corpus, p).collect()}
    assert {x for x in got if x[0] in few} == want and len(got) == len(set(got)) and len({x[0] for x in got}) > 90
    monkeypatch.setattr(many, "AT_ONCE", 4)
    again = many.grep_table(corpus, table.where(F.col("pattern").isin(few[:9])))
    assert {(r.pattern, r.path, r.line, r.col, r.match) for r in again.collect()} == {x for x in want if x[0] in few[:9]}
    assert many.grep_table(corpus, table.where("pattern = ''")).count() == 0


def test_anchors():
    of = lambda p: many.anchors(many.required(p)[0])
    assert of("abc.*longer") == ["longer"] and of("(?i)ABC|def") == ["abc", "def"] and of("abc|d+") is None and of("[a-z]+") is None


def test_tiers_stop_at_the_first_success(spark):
    asked = []

    def tier(rows):
        def search(pending):
            asked.append(sorted((r.query for r in pending.collect()), key=repr))
            return spark.createDataFrame(rows, "query string, hit int").join(pending, "query", "left_semi")

        return search

    queries = spark.createDataFrame([("a",), ("b",), ("c",), ("a",), (None,)], "query string")
    found = results.first_success(queries, [tier([("a", 1), ("a", 2), ("z", 9)]), tier([("a", 3), ("b", 4)]), tier([("b", 5)])])
    assert sorted((r.query, r.hit, r.tier) for r in found.collect()) == [("a", 1, 1), ("a", 2, 1), ("b", 4, 2)]
    assert asked == [["a", "b", "c", None], ["b", "c", None], ["c", None]]
    asked.clear()
    full = results.first_success(queries.where("query in ('a', 'b')"), [tier([("a", 1), ("b", 2)]), tier([("a", 3)])])
    assert full.count() == 2 and asked == [["a", "b"]]


def test_definitions_by_suffix(spark):
    code = "#define MAX 3\nclass API_API Foo final : public Bar {\nstruct Fwd;\nint Foo::run(int a) const {\n  return call(a);\n  call(b);\n}\nenum class Color {\r\nstatic void *helper(void)\n"
    rows = files(spark, ("a/x.cpp", code), ("m.py", "class A:\n    async def go(self): pass\nx = def_1"), ("l.lua", "local function f() end\nM.g = 1\nlocal h = function() end\nfunction M.sub:k() end"), ("p/q", '<title>Big one</title>\n<h2 class="x"> Head <b id="anc">'), ("t.txt", "Note: it\nnot one"), ("d.bin", "class A:"), ("n.md", "## Über uns\ntext"))
    got = sorted((r.path, r.line, r.kind, r.term) for r in index.definitions_by_suffix(rows).collect())
    assert got == sorted([("a/x.cpp", 1, "macro", "MAX"), ("a/x.cpp", 2, "type", "Foo"), ("a/x.cpp", 4, "function", "run"), ("a/x.cpp", 8, "type", "Color"), ("a/x.cpp", 9, "function", "helper"), ("m.py", 1, "type", "A"), ("m.py", 2, "function", "go"), ("l.lua", 1, "function", "f"), ("l.lua", 3, "function", "h"), ("l.lua", 4, "function", "k"), ("p/q", 1, "title", "Big"), ("p/q", 2, "heading", "Head"), ("t.txt", 1, "label", "Note"), ("n.md", 1, "heading", "Über")])


def test_counterparts_of_a_hot_stem(spark):
    left = spark.createDataFrame([(f"d{i}/main.c", "main") for i in range(40)] + [("z/one.c", "one")], "path string, stem string")
    right = spark.createDataFrame([(f"d{i}/main.h", "main") for i in range(1, 300)] + [("a/two.h", "two")], "path string, stem string")
    got = {r.left_path: r.right_path for r in resolve.counterpart(left, right, ["stem"]).collect()}
    assert len(got) == 41 and got["d7/main.c"] == "d7/main.h" and got["d0/main.c"] == "d1/main.h" and got["z/one.c"] is None


def test_freshness_needs_all_parts(spark):
    at = lambda rows, form: spark.createDataFrame(rows, form)
    lists = at([("a", 10.0), ("b", 10.0), ("c", 10.9), ("d", 10.0)], "k string, s double").selectExpr("k", "timestamp_micros(cast(s * 1e6 as long)) AS list_ts")
    built = at([("a", "x", 11.0), ("a", "y", 12.0), ("b", "x", 11.0), ("c", "x", 10.1), ("c", "y", 12.0), ("d", "x", 9.0), ("d", "x", 11.0), ("d", "y", 9.9), ("e", "x", 1.0)], "k string, part string, s double").selectExpr("k", "part", "timestamp_micros(cast(s * 1e6 as long)) AS artifact_ts")
    got = {r.k: (r.outcome, r.rebuild) for r in resolve.freshness(lists, built, "k", ["x", "y"]).collect()}
    assert got == {"a": (resolve.FRESH, False), "b": (resolve.PART_MISSING, True), "c": (resolve.FRESH, False), "d": (resolve.OLD, True), "e": (resolve.NO_LIST, True)}


def test_defaults_are_the_fixed_values(spark):
    rows = files(spark, ("a/Saved/x.txt", "find me"), (".git/config", "find me"), ("src/x.txt", "find me"))
    assert [r.path for r in grep.grep_excluding(rows, "find").collect()] == ["src/x.txt"]
    assert progress.count_marked_lines(spark.createDataFrame([("extracting tags of x",), ("x",)], "text string")).first().n_marked == 1
    status = spark.sql("SELECT 1 AS job, 'indexed' AS status, timestamp'2024-01-01 00:00:00' AS ts")
    shown = progress.status_intervals(status, "job", ["ts"], "ts").select(F.unix_millis("until") - F.unix_millis("ts")).first()
    assert shown[0] == 1500
