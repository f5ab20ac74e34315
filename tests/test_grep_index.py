"""Required literals, the trigram index, and lines that grep must not lose."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import paths
from corpusloom.operators import grep, trigrams
from corpusloom.operators.literals import required
from corpusloom.sources.corpus import numbered_lines


def files(spark, *rows):
    return spark.createDataFrame([("project", "/project", p, t) for p, t in rows], "origin string, root string, rel_path string, text string")


def holds(need, text, fold):
    if need is True:
        return True
    if isinstance(need, str):
        return need.lower() in text.lower() if fold else need in text
    return (all if need[0] == "and" else any)(holds(x, text, fold) for x in need[1:])


def made(rng, depth=0):
    """A random pattern of the common subset."""
    pick = rng.randrange(12 if depth < 3 else 5)
    if pick < 4:
        return "".join(rng.choice("abcAB") for _ in range(rng.randrange(1, 5)))
    if pick == 4:
        return rng.choice(["[ab]", "[^b]", "[a-c]", ".", r"\w", r"\b", r"\d?", "^", "$", r"\."])
    inner = made(rng, depth + 1)
    if pick < 7:
        return f"(?:{inner})" + rng.choice(["?", "*", "+", "{2}", "{0,2}", "{1}", "{1,3}", "+?", ""])
    if pick < 9:
        return f"(?:{inner}|{made(rng, depth + 1)})"
    if pick == 9:
        return rng.choice(["(?=", "(?!"]) + inner + ")"
    return inner + made(rng, depth + 1)


def test_required_literals_lose_nothing():
    rng = random.Random(5)
    asked = 0
    for _ in range(4000):
        pattern = ("(?i)" if rng.random() < 0.3 else "") + made(rng)
        need, fold = required(pattern)
        asked += need is not True
        found = re.compile(pattern, re.ASCII)
        for _ in range(12):
            text = "".join(rng.choice("abcABab. 1") for _ in range(rng.randrange(0, 12)))
            assert not found.search(text) or holds(need, text, fold), (pattern, text, need)
    assert asked > 400


@pytest.mark.parametrize(
    ("pattern", "need"),
    [("licen[sc]e", ("or", "licence", "license")), (r"foo(?!\s)", "foo"), ("abc|defg", ("or", "abc", "defg")), ("ab|cdef", True), ("(abc)+x?yz", "abc"), ("a{2}bcd", "bcd"), (r"(?<!x)hello", "hello"), ("(?i)straße", "straße"), (r"[]a]bcd", True), (r"\Qa.b\Ecd", "a.bcd"), ("(?x)a b c d", True), (r"(foo|bar)\d+end", ("and", ("or", "bar", "foo"), "end"))],
)
def test_required_literals(pattern, need):
    assert required(pattern)[0] == need


TEXTS = [("a.txt", "foo\nbar"), ("b.txt", "foo x"), ("c.txt", "Foo\r\nfoo\r"), ("d/e.txt", "the License here\nLICENSE"), ("d/f.txt", None), ("d/g.txt", ""), ("d/h.txt", "é日本語 license and licence\u0085end"), ("d/h.txt", "license again"), ("z.txt", "x" * 50)]
PATTERNS = [r"foo(?!\s)", r"(?<!the )licen[sc]e", "license", "License", "foo$", "^foo", "licence.end", "日本", r"\bfoo\b", "(foo|x{10,})", r"fo+(?=\r)", "no such text", r"[a-z]\w*r$"]


def plain(pattern):
    form = re.compile(grep.smart_case(pattern).replace(r"\b", r"\b"))
    out = []
    for path, text in TEXTS:
        if text:
            for i, line in enumerate(re.sub(r"\n\Z", "", text).split("\n")):
                # Java's $ under (?d) also stands before a last line feed, of which a line has none.
                out += [(path, i + 1, 1 + len(line[: m.start()].encode()), m[0]) for m in form.finditer(line)]
    return sorted(out)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("trigrams") / "index")
    trigrams.write_index(files(spark, *TEXTS).repartition(3), folder, block_bytes=16)
    return folder


@pytest.mark.parametrize("pattern", PATTERNS)
def test_grep_loses_no_line(spark, folder, pattern):
    got = lambda hits: sorted((r.path, r.line, r.col, r.match) for r in hits.collect())
    want = plain(pattern)
    rows = files(spark, *TEXTS)
    assert got(grep.grep(rows, pattern)) == want
    assert got(trigrams.grep(spark, folder, pattern)) == want
    assert [(r.path, r.line, r.col, r.match) for r in grep.grep_many(rows, [pattern, "zzz"]).orderBy("path", "line", "col").collect()] == want
    assert {(r.path, r.line) for r in grep.match_lines(numbered_lines(rows), pattern).collect()} == {x[:2] for x in want}


def test_only_named_blocks_are_read(spark, folder):
    named = lambda p: None if (b := trigrams.matching_blocks(spark, folder, p)) is None else b.count()
    all_blocks = trigrams.stored_files(spark, folder).select("block").distinct().count()
    assert all_blocks > 4 and named("no such text") == 0 and named("日本語") == 1 and named("[a-z]+") is None and 1 <= named("license") < all_blocks
    plan = trigrams.grep(spark, folder, "license")._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
    index = trigrams.matching_blocks(spark, folder, "license")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram" in index and "files" not in index


def test_index_of_nothing(spark, tmp_path):
    folder = str(tmp_path / "none")
    trigrams.write_index(files(spark, ("a", "b")).where("false"), folder)
    assert trigrams.grep(spark, folder, "abc").count() == 0 and trigrams.grep(spark, folder, "").count() == 0


def test_long_texts_and_overlaps(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(trigrams, "PIECE", 4)
    text = "abcdefghijklmnop\nqrs"
    found = next(trigrams._block_grams(iter(spark.createDataFrame([(0, text)], "block int, text string").toArrow().to_batches())))
    want = {text[i : i + 3] for i in range(len(text) - 2) if "\n" not in text[i : i + 3]}
    assert {chr(g >> 42) + chr(g >> 21 & 0x1FFFFF) + chr(g & 0x1FFFFF) for g in found.column("gram").to_pylist()} == want


def test_hit_lines_with_other_separators(spark):
    lines = ["a:1:x", "a:2:x\r", "a:3:x y", "a:4:x\u0085", "b\rc:5:", "no", "a:99999999999999:x"]
    got = [r.h and (r.h.path, r.h.line, r.h.text) for r in spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, x string").select("i", paths.parse_hit_line(F.col("x")).alias("h")).orderBy("i").collect()]
    assert got == [("a", 1, "x"), ("a", 2, "x\r"), ("a", 3, "x y"), ("a", 4, "x\u0085"), ("b\rc", 5, ""), None, None]
