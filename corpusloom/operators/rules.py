"""Which files belong to the corpus: ignore rules, globs, suffixes."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import paths

#: Suffixes of code files; case matters.
CODE_SUFFIXES = ("c", "cc", "cpp", "cxx", "h", "hh", "hpp", "hxx", "inl", "ipp", "inc", "m", "mm")
#: Directories that a live search leaves out.
SEARCH_EXCLUDES = (".git/*", "**/Binaries/**", "**/Intermediate/**", "**/Saved/**", "**/DerivedDataCache/**", "**/Content/**")


def is_code(path: Column) -> Column:
    return paths.ext(path).isin(*CODE_SUFFIXES)


def code_files(files: DataFrame, column: str = "rel_path") -> DataFrame:
    return files.where(is_code(F.col(column)))


def parse_rules(spark: SparkSession, origin: str, text: str) -> DataFrame:
    """(origin, pattern, kind) of a rule text: ``//`` lines and blank ones are left out, backslashes become slashes.

    A pattern with a slash is anchored at the root, one without matches any
    component of a path; ``*`` stands for any characters but slashes.
    """
    rows = []
    for line in text.split("\n"):
        line = line.strip().replace("\\", "/").strip("/") if not line.strip().startswith("//") else ""
        if line:
            rows.append((origin, line, "anchored" if "/" in line else "name"))
    return spark.createDataFrame(rows, "origin string, pattern string, kind string")


def effective_rules(user: DataFrame, defaults: DataFrame) -> DataFrame:
    """The user's rules; an origin for which there are none gets the defaults."""
    return user.unionByName(defaults.join(user.select("origin").distinct(), "origin", "left_anti"))


def ignored(files: DataFrame, rules: DataFrame) -> DataFrame:
    """``files`` with the boolean column ignored.

    Rules become one row an origin; a file's components and ancestors are looked
    up in it within its own row, so a file is neither multiplied nor shuffled.
    """
    wild = F.contains("pattern", F.lit("*"))
    pick = lambda when: F.array_sort(F.collect_set(F.when(when, F.col("pattern"))))
    sets = rules.groupBy("origin").agg(pick((F.col("kind") == "name") & ~wild).alias("_names"), pick((F.col("kind") == "anchored") & ~wild).alias("_anchored"), pick((F.col("kind") == "name") & wild).alias("_wild_names"), pick((F.col("kind") == "anchored") & wild).alias("_wild_anchored"))
    path = paths.norm_path(F.col("rel_path"))
    form = lambda p: F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(p, r"([.+?()\[\]{}^$|])", r"\\$1"), r"\*", "[^/]*"))
    hit = (
        F.arrays_overlap(F.split(path, "/", -1), "_names")
        | F.arrays_overlap(F.array_append(paths.ancestors(path), path), "_anchored")
        | F.exists("_wild_names", lambda p: F.exists(F.split(path, "/", -1), lambda part: F.rlike(part, F.concat(form(p), F.lit("$")))))
        | F.exists("_wild_anchored", lambda p: F.rlike(path, F.concat(form(p), F.lit("(/|$)"))))
    )
    return files.join(sets, "origin", "left").withColumn("ignored", F.coalesce(hit, F.lit(False))).select(*files.columns, "ignored")


def apply_ignore(files: DataFrame, rules: DataFrame) -> DataFrame:
    return ignored(files, rules).where("not ignored").drop("ignored")


def without_ignored(listed: DataFrame, ignored_paths: DataFrame, column: str = "rel_path") -> DataFrame:
    """Listed minus ignored, by path; rows with one path all stay or all go."""
    return listed.join(ignored_paths.select(column).distinct(), column, "left_anti").select(listed.columns)


def glob_pattern(glob: str) -> str:
    """A glob as a regular expression: ``**/`` any directories, ``/**`` all below, ``*`` no slash, ``?`` one character."""
    out, at = "", 0
    for token, form in iter(lambda: _next(glob[at:]), None):
        out, at = out + form, at + len(token)
    return f"^{out}$"


def _next(rest: str):
    if not rest:
        return None
    for token, form in (("**/", "(?:.*/)?"), ("/**", "/.*"), ("**", ".*"), ("*", "[^/]*"), ("?", "[^/]")):
        if rest.startswith(token):
            return token, form
    return rest[0], re.escape(rest[0])


def exclude_globs(files: DataFrame, globs, column: str = "rel_path") -> DataFrame:
    """Files that no glob matches."""
    hit = reduce(lambda a, b: a | b, [F.col(column).rlike(glob_pattern(g)) for g in globs], F.lit(False))
    return files.where(~hit)


def drop_path_patterns(files: DataFrame, patterns: list[str], column: str = "rel_path") -> DataFrame:
    """Files whose path no pattern is found in."""
    return files.where(~F.col(column).rlike("|".join(f"(?:{p})" for p in patterns))) if patterns else files
