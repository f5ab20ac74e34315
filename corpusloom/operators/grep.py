"""Search: a row for each match, with its line and byte column."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import rules
from corpusloom.operators.literals import required
from corpusloom.sources.corpus import numbered_lines


def smart_case(pattern: str) -> str:
    """The pattern, ignoring case unless an upper-case letter stands in it outside escapes."""
    bare, at = "", 0
    while at < len(pattern):
        if pattern[at] == "\\":
            at += 2
        else:
            bare += pattern[at]
            at += 1
    return pattern if bare.lower() != bare else "(?i)" + pattern


#: A line ends at a line feed alone: returns and other signs are part of it, for ``.`` and ``$`` too.
FEEDS = "(?d)"


def checked(spark: SparkSession, pattern: str) -> str:
    """The pattern in smart case. A bad one, or one that matches the empty text, is an error here and not in a task."""
    form = FEEDS + smart_case(pattern)
    if spark._jvm.java.util.regex.Pattern.compile(form).matcher("").find():
        raise ValueError(f"{pattern!r} matches the empty text")
    return form


def match_lines(lines: DataFrame, pattern: str, column: str = "text") -> DataFrame:
    """Lines in which the pattern is found, in smart case."""
    return lines.where(F.col(column).rlike(FEEDS + smart_case(pattern)))


def may_match(text: Column, pattern: str) -> Column:
    """Whether a text holds the literals that each match of the pattern holds. Texts with a matching line always do."""
    need, fold = required(pattern)

    def holds(n) -> Column:
        if isinstance(n, str) and fold:
            # Only the case of ASCII letters is ignored: they are sought in the lower-case text, what stands between them as it is.
            return reduce(lambda a, b: a & b, [F.contains(F.lower(text), F.lit(x.lower())) if x.isascii() else F.contains(text, F.lit(x)) for x in re.findall(r"[\x00-\x7f]+|[^\x00-\x7f]+", n)])
        if isinstance(n, str):
            return F.contains(text, F.lit(n))
        return reduce((lambda a, b: a & b) if n[0] == "and" else (lambda a, b: a | b), [holds(x) for x in n[1:]])

    return F.lit(True) if need is True else holds(need)


def readable_only(files: DataFrame) -> DataFrame:
    return files.where(F.col("text").isNotNull())


#: Matches that are put together at a time, so that long lines don't take quadratic time.
CHUNK = 64
PLACES = "array<struct<col:int,match:string>>"


def positions(text: Column, pattern: Column) -> Column:
    """All matches in a line as an array of (col, match), col the byte column from 1.

    The gaps between matches and the matches add up to the line, so running
    sums of their byte lengths are the columns: first within chunks, then over
    the chunks. A line without a match has none, and is not cut.
    """
    none = F.array().cast(PLACES)

    def add(a: Column, x: Column) -> Column:
        col = a["at"] + F.octet_length(x["gap"])
        return F.struct((col + F.coalesce(F.octet_length(x["match"]), F.lit(0))).alias("at"), F.when(x["match"].isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(F.struct(col.alias("col"), x["match"].alias("match"))))).alias("out"))

    def chunks(p: Column) -> Column:
        of = lambda i: F.aggregate(F.slice(p, i * CHUNK + 1, F.lit(CHUNK)), F.struct(F.lit(0).alias("at"), none.alias("out")), add)
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / CHUNK).cast("int")), of)

    def join(a: Column, c: Column) -> Column:
        moved = F.transform(c["out"], lambda x: F.struct((x["col"] + a["at"]).alias("col"), x["match"].alias("match")))
        return F.struct((a["at"] + c["at"]).alias("at"), F.concat(a["outs"], F.array(moved)).alias("outs"))

    # A transform over one element names what it holds, so that it is made once.
    def placed(found: Column) -> Column:
        made = F.transform(F.array(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("match"))), chunks)[0]
        return F.when(F.size(found) > 0, F.aggregate(made, F.struct(F.lit(1).alias("at"), F.array().cast(f"array<{PLACES}>").alias("outs")), join, lambda a: F.flatten(a["outs"]))).otherwise(none)

    return F.transform(F.array(F.regexp_extract_all(text, pattern, F.lit(0))), placed)[0]


def hits_in(lines: DataFrame, form: Column, *more: str) -> DataFrame:
    """The matches of ``form`` in lines; those that mostly have none are better left out before."""
    return lines.select("origin", "path", "line", F.explode(positions(F.col("text"), form)).alias("hit"), "text", *more).select("origin", "path", "line", F.col("hit.col").alias("col"), F.col("hit.match").alias("match"), "text", *more)


def grep(files: DataFrame, pattern: str) -> DataFrame:
    """(origin, path, line, col, match, text), one row a match; the empty pattern finds nothing.

    Whole files are sieved by literals that any match holds, lines by the
    pattern before positions are sought; all stages are narrow.
    """
    if not pattern:
        return hits_in(numbered_lines(files).where(F.lit(False)), F.lit("x"))
    form = checked(files.sparkSession, pattern)
    sieved = files.where(may_match(F.col("text"), form))
    return hits_in(numbered_lines(sieved).where(F.col("text").rlike(form)), F.lit(form))


def grep_many(files: DataFrame, patterns: list[str]) -> DataFrame:
    """The hits of several patterns in one pass, with the column pattern. A line goes on once for each pattern it has."""
    forms = {p: checked(files.sparkSession, p) for p in dict.fromkeys(patterns) if p}
    if not forms:
        return grep(files, "").withColumn("pattern", F.lit(""))
    # Files that may have any of them are cut into lines; each pattern is a constant, so it is compiled once.
    sieved = files.where(reduce(lambda a, b: a | b, [may_match(F.col("text"), f) for f in forms.values()]))
    lines = numbered_lines(sieved)
    found = F.array_compact(F.array(*[F.when(F.col("text").rlike(f), F.lit(p)) for p, f in forms.items()]))
    met = lines.select("*", F.explode(found).alias("pattern"))
    places = reduce(lambda a, p: a.when(F.col("pattern") == p[0], positions(F.col("text"), F.lit(p[1]))), list(forms.items())[1:], F.when(F.col("pattern") == next(iter(forms)), positions(F.col("text"), F.lit(forms[next(iter(forms))]))))
    return met.select("origin", "path", "line", F.explode(places).alias("hit"), "text", "pattern").select("origin", "path", "line", F.col("hit.col").alias("col"), F.col("hit.match").alias("match"), "text", "pattern")


def grep_indexed(files: DataFrame, index: DataFrame, pattern: str) -> DataFrame:
    """Hits in the files that the index lists."""
    return grep(files.join(index.select("origin", "rel_path").distinct(), ["origin", "rel_path"], "left_semi"), pattern)


def grep_excluding(files: DataFrame, pattern: str, globs=rules.SEARCH_EXCLUDES, rule_rows: DataFrame | None = None) -> DataFrame:
    """Hits in both roots, without what rules ignore and globs exclude; by default what a live search leaves out."""
    kept = files if rule_rows is None else rules.apply_ignore(files, rule_rows)
    return grep(rules.exclude_globs(kept, globs), pattern)


def hit_counts(hits: DataFrame, *by: str) -> DataFrame:
    return hits.groupBy(*by).agg(F.count("*").alias("n_hits"))


def titled(hits: DataFrame, kind: str, query: str) -> DataFrame:
    return hits.withColumn("title", F.concat(F.lit(kind), F.lit(": "), F.lit(query)))
