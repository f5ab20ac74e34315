"""Joins that find what a path or an id belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import paths


def route_by_prefix(rows: DataFrame, roots: DataFrame, path: str = "path") -> DataFrame:
    """``rows`` with root: the longest of ``roots`` (root) that is an ancestor of the path, null without one.

    The roots that apply are looked up among each path's ancestors with an
    equi-join on distinct directories, not by comparing every path with every root.
    """
    directories = rows.select(paths.ancestors(F.col(path)).alias("_up")).distinct()
    up = directories.select("_up", F.posexplode("_up").alias("_depth", "_dir"))
    known = roots.select(F.col("root").alias("_root")).distinct()
    best = up.join(known, F.col("_dir") == F.col("_root")).groupBy("_up").agg(F.max(F.struct("_depth", "_root")).alias("_best"))
    keyed = rows.withColumn("_own", paths.ancestors(F.col(path)))
    return keyed.join(best, F.col("_own") == F.col("_up"), "left").select(*rows.columns, F.col("_best._root").alias("root"))


def nearest_root(rows: DataFrame, markers: DataFrame, path: str = "path", strict: bool = False) -> DataFrame:
    """``rows`` with root: the nearest ancestor directory among ``markers`` (dir); strict: only the path's own directory."""
    if strict:
        known = markers.select(F.col("dir").alias("_dir")).distinct()
        return rows.join(known, paths.dirname(F.col(path)) == F.col("_dir"), "left").select(*rows.columns, F.col("_dir").alias("root"))
    return route_by_prefix(rows, markers.select(F.col("dir").alias("root")), path)


def pair_counterparts(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """(left_path, right_path) of files with one stem, given as the columns ``on``. All pairs: the output has as many rows as there are."""
    a = left.select(*on, F.col("path").alias("left_path"))
    b = right.select(*on, F.col("path").alias("right_path"))
    return a.join(b, on).select(*on, "left_path", "right_path")


def counterpart(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """(on, left_path, right_path): for each left file the counterpart that a switch opens, null without one.

    Of the right files with its stem it is the first by path, those in the left file's own directory before others. At
    most one row a left file, so a stem of very many files (``index``, ``main``) gives no pairs of all with all; the
    right files are reduced to one a stem, and one a stem and directory, before they meet the left ones.
    """
    b = right.select(*on, F.col("path").alias("_r"), paths.dirname(F.col("path")).alias("_dir"))
    near = b.groupBy(*on, "_dir").agg(F.min("_r").alias("_near"))
    far = near.groupBy(*on).agg(F.min("_near").alias("_far"))
    a = left.select(*on, F.col("path").alias("left_path"), paths.dirname(F.col("path")).alias("_dir"))
    return a.join(near, [*on, "_dir"], "left").join(far, on, "left").select(*on, "left_path", F.coalesce("_near", "_far").alias("right_path"))


def listed(files: DataFrame, index: DataFrame, on: list[str]) -> DataFrame:
    """The files that the index lists, each row once however often the index has it."""
    return files.join(index.select(*on).distinct(), on, "left_semi").select(files.columns)


#: What can come of comparing a list with what was built from it.
FRESH, NO_LIST, PART_MISSING, OLD = "fresh", "no list", "part missing", "older than the list"


def freshness(lists: DataFrame, artifacts: DataFrame, key: str, parts: list[str]) -> DataFrame:
    """(key, list_ts, oldest_ts, outcome, rebuild) of every key of either side.

    ``lists``: key, list_ts (the latest counts). ``artifacts``: key, part, artifact_ts, of which each of ``parts`` must
    be there; the latest of a part counts. Compared in whole seconds; equal is fresh. A null key is a key.
    """
    have = lists.groupBy(F.col(key).alias("_a")).agg(F.max("list_ts").alias("list_ts"))
    latest = artifacts.where(F.col("part").isin(parts)).groupBy(key, "part").agg(F.max("artifact_ts").alias("ts")).where("ts is not null")
    built = latest.groupBy(F.col(key).alias("_b")).agg(F.min("ts").alias("oldest_ts"), F.count("*").alias("_n"))
    both = have.join(built, F.col("_a").eqNullSafe(F.col("_b")), "full_outer")
    second = lambda c: F.date_trunc("second", c)
    outcome = F.when(F.col("list_ts").isNull(), NO_LIST).when(F.coalesce("_n", F.lit(0)) < len(set(parts)), PART_MISSING).when(second(F.col("oldest_ts")) < second(F.col("list_ts")), OLD).otherwise(FRESH)
    return both.select(F.coalesce("_a", "_b").alias(key), "list_ts", "oldest_ts", outcome.alias("outcome"), (outcome != FRESH).alias("rebuild"))


#: What can come of looking up a project's build.
OK, NO_PROJECT, NO_ID, NOT_BRACED, UNKNOWN = "ok", "no project", "no association", "not a braced id", "id not registered"


def resolve_refs(projects: DataFrame, builds: DataFrame) -> DataFrame:
    """(project, assoc, root, err): ``projects`` (project, found, assoc) led to ``builds`` (id, path)."""
    known = builds.groupBy(F.col("id").alias("_id")).agg(F.min("path").alias("_path"))
    rows = projects.join(known, F.col("assoc") == F.col("_id"), "left")
    braced: Column = paths.is_braced_guid(F.col("assoc"))
    err = F.when(~F.col("found"), NO_PROJECT).when(F.col("assoc").isNull(), NO_ID).when(~braced, NOT_BRACED).when(F.col("_path").isNull(), UNKNOWN).otherwise(OK)
    rows = rows.withColumn("err", err)
    return rows.select("project", "assoc", F.when(F.col("err") == OK, paths.trim_ws(paths.norm_path(F.col("_path")))).alias("root"), "err")
