"""Lists of results: navigation, tiers, caps, ranking, completion, comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.operators.ordered import with_adjacent
from corpusloom.sources.tables import staged

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Fixed value: results and references of one query at most.
CAP = 200


def scope_results(hits: DataFrame, path: str | None = None) -> DataFrame:
    """The results of one file, or all."""
    return hits if path is None else hits.where(F.col("path") == path)


def with_neighbours(hits: DataFrame, by: list[str], order: list[str], value: str, wrap: bool = False) -> DataFrame:
    """``hits`` with next and previous ``value`` of the list ``by``; at its ends null, or with ``wrap`` the other end."""
    return with_adjacent(hits, by, order, value, wrap=wrap)


def first_nonempty_tier(hits: DataFrame, query: str = "query", tier: str = "tier") -> DataFrame:
    """All rows of the first tier that has any, for each query."""
    first = hits.groupBy(F.col(query).alias("_q")).agg(F.min(tier).alias("_first"))
    return hits.join(first, F.col(query).eqNullSafe(F.col("_q")) & (F.col(tier) == F.col("_first"))).select(hits.columns)


def first_success(queries: DataFrame, tiers: list, query: str = "query") -> DataFrame:
    """The rows of the first tier that has any, for each of ``queries`` (query), with the column tier from 1.

    Each tier is a function from the queries that no earlier tier has answered to rows with the column query; it is
    asked for these only, and not at all once none is left. A query that no tier answers has no rows.
    """
    pending, answers = staged(queries.select(query).distinct(), "pending"), []
    for i, tier in enumerate(tiers):
        found = staged(tier(pending).withColumn("tier", F.lit(i + 1)), "tier")
        answers.append(found)
        if i + 1 == len(tiers):
            break
        answered = found.select(F.col(query).alias("_q")).distinct()
        pending = staged(pending.join(answered, F.col(query).eqNullSafe(F.col("_q")), "left_anti"), "pending")
        if pending.isEmpty():
            break
    return reduce(lambda a, b: a.unionByName(b), answers)


def cap_per_query(hits: DataFrame, query: str, order: list[str], n: int = CAP) -> DataFrame:
    """The first ``n`` results of each query. Spark keeps at most ``n`` a task and query before the shuffle."""
    return hits.withColumn("rank", F.row_number().over(W.partitionBy(query).orderBy(*order))).where(F.col("rank") <= n)


def preselect(rows: DataFrame, by: str, order: list[Column]) -> DataFrame:
    """The first item of each list."""
    return rows.withColumn("_rank", F.row_number().over(W.partitionBy(by).orderBy(*order))).where("_rank = 1").drop("_rank")


def fuzzy_span(value: Column, query: str) -> Column:
    """The length of the run from the first fit of the query's characters in order, ASCII letters in any case; null if they aren't there.

    Each character is sought from the last one's place on, so a value of any length is read once. The first place of
    the first character is as good a start as any other: what fits after a later one fits after it too.
    """
    fold = lambda c: F.translate(c, UPPER, UPPER.lower())
    small = fold(value)
    chars = [fold(F.lit(c)) for c in query]
    if not chars:
        return F.lit(None).cast("int")
    begin = F.call_function("locate", chars[0], small, F.lit(1))
    end = F.aggregate(F.array(*chars[1:]).cast("array<string>"), begin, lambda at, c: F.when(at > 0, F.call_function("locate", c, small, at + 1)).otherwise(0))
    return F.when(end > 0, end - begin + 1)


def fuzzy_topk(rows: DataFrame, column: str, query: str, k: int) -> DataFrame:
    """The ``k`` best fits: shorter runs first, then shorter values, then by value. Only ``k`` rows a task are kept.

    A value must hold all letters of the query, which is tested first.
    """
    needed = reduce(lambda a, b: a & b, [F.contains(F.lower(column), F.lit(c.lower())) if c.isascii() else F.contains(F.col(column), F.lit(c)) for c in sorted(set(query))], F.lit(True))
    fits = rows.where(needed).withColumn("span", fuzzy_span(F.col(column), query)).where("span is not null")
    return fits.orderBy("span", F.length(column), column).limit(k)


def recent_files(access: DataFrame, by: str, item: str, ts: str, k: int) -> DataFrame:
    """The ``k`` items last used of each ``by``."""
    last = access.groupBy(by, item).agg(F.max(ts).alias("last_ts"))
    return last.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(F.col("last_ts").desc(), item))).where(F.col("rank") <= k)


def complete_prefix(sources: list[DataFrame], prefix: str, k: int) -> DataFrame:
    """(term, prio, freq) of the best ``k`` completions; earlier sources come first, then frequent terms.

    A source has a row for each occurrence (term), or rows with counts (term, n) as a term dictionary has, of which the
    prefix reads the files of its range only.
    """
    freq = lambda s: F.sum("n") if "n" in s.columns else F.count("*")
    each = [s.where(F.startswith("term", F.lit(prefix))).groupBy("term").agg(freq(s).alias("freq")).withColumn("prio", F.lit(i)) for i, s in enumerate(sources)]
    best = reduce(lambda a, b: a.unionByName(b), each).groupBy("term").agg(F.min(F.struct("prio", (-F.col("freq")).alias("less"))).alias("b"))
    return best.select("term", "b.prio", (-F.col("b.less")).alias("freq")).orderBy("prio", F.col("freq").desc(), "term").limit(k)


def concat_results(*lists: DataFrame) -> DataFrame:
    """All rows, without removing repeats, with the column part: which list a row is from."""
    return reduce(lambda a, b: a.unionByName(b), [x.withColumn("part", F.lit(i)) for i, x in enumerate(lists)])


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, sign): ``+`` only in new, ``_`` only in old, ``~`` in both but different in ``columns``; equal ones are left out."""
    a = old.select(F.col(key).alias("_a"), F.struct(*columns).alias("_old"))
    b = new.select(F.col(key).alias("_b"), F.struct(*columns).alias("_new"))
    both = a.join(b, F.col("_a") == F.col("_b"), "full_outer")
    sign = F.when(F.col("_a").isNull(), "+").when(F.col("_b").isNull(), "_").when(~F.col("_old").eqNullSafe(F.col("_new")), "~")
    return both.select(F.coalesce("_a", "_b").alias(key), sign.alias("sign")).where("sign is not null")
