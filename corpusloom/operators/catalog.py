"""The catalog report: entries once, sorted and grouped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import paths

KEY = ["mode", "lhs", "desc"]


def dedupe_catalog(rows: DataFrame) -> DataFrame:
    """Each (mode, lhs, desc) once; entries without a description are left out."""
    return rows.where("desc is not null and desc <> ''").dropDuplicates(KEY)


def group_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(paths.group_of(F.col("desc")).alias("grp")).agg(F.count("*").alias("n_entries"))


def sort_catalog(rows: DataFrame) -> DataFrame:
    """By group, lhs, mode, in byte order; the description settles ties."""
    return rows.withColumn("grp", paths.group_of(F.col("desc"))).orderBy("grp", "lhs", "mode", "desc")


def with_group_breaks(rows: DataFrame, by: str = "mode") -> DataFrame:
    """``rows`` with header: whether the group differs from that of the entry before, in the sorted list of each ``by``.

    In a sorted list that is the first entry of each group, found without ordering the list. Entries must be distinct.
    """
    rows = rows.withColumn("grp", paths.group_of(F.col("desc")))
    first = rows.groupBy(F.col(by).alias("_by"), F.col("grp").alias("_grp")).agg(F.min(F.struct("lhs", "desc")).alias("_first"))
    joined = rows.join(first, F.col(by).eqNullSafe(F.col("_by")) & (F.col("grp") == F.col("_grp")))
    return joined.select(*rows.columns, F.struct("lhs", "desc").eqNullSafe(F.col("_first")).alias("header"))


def catalog_report(rows: DataFrame) -> DataFrame:
    """(grp, line) of the report."""
    return sort_catalog(dedupe_catalog(rows)).select("grp", paths.catalog_line(F.col("mode"), F.col("lhs"), F.col("desc")).alias("line"))
