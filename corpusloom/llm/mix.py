"""Mixing sources to target weights by Pareto order sampling (operator 7).

Each document of a source is due ``e = least(MOST_COPIES, c * size ** TILT)``
copies, so longer ones are due more, with the ``c`` at which the source's words
add up to its target. The whole copies ``floor(e)`` are certain. For the rest,
with the document's own inclusion probability ``p = e - floor(e)``, documents
are ranked by ``(u / (1 - u)) / (p / (1 - p))``, ``u`` a uniform number hashed
from the seed and the document, and those of the lowest rank are taken until
the next would go beyond what is missing: a sample of a fixed number of words
with unequal probabilities. What is then still missing is filled from the
documents that fit in it, in the same order, ``ROUNDS`` times in all, and at
last by the one document whose size comes nearest to it. So a source ends
within half a document of its target, mostly much nearer.

How it scales: texts are read once, to count words; what is shuffled afterwards
has a few small columns. The point in the order where a source's words are full
is found by partial sums in a fixed number of rank bins, twice, so no task ever
sorts a whole source, and a hot source is split over all tasks. One task sees
the distinct sizes of a source, and one the sources.

Cases: a null text has size 0; a null source is a source of its own, after all
others; sources of size 0 get the target 0; rows that are repeated have equal
ranks and stand next to each other in the order, each is counted and may be
taken. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.sources.tables import staged

#: The fixed separators of words: space, tab, line feed, vertical tab, form feed, return.
SPACES = r"[\x20\x09-\x0D]+"
#: Weights of the sources in order, repeated; copies of one document at most.
WEIGHTS, MOST_COPIES = (5, 2, 1), 3
#: The power of a document's size to which its expected copies are proportional; rounds of filling.
TILT, ROUNDS = 0.25, 3
#: Bins of the rank order, refined once by as many.
BINS = 4096


def n_words(text: Column) -> Column:
    """Words of a text, a null text having none: parts between separators, but for empty ones at the ends."""
    text = F.coalesce(text, F.lit(""))
    blank = lambda at: F.substring(text, at, 1).isin(*" \t\n\v\f\r").cast("int")
    return F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, SPACES, -1)) - blank(1) - blank(-1)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """(source, source_size, target): shares of all words by weight, none above ``most`` times its source.

    The level ``l`` is sought at which the sum of ``least(most * size, l * weight)``
    is the whole; in the order of ``most * size / weight`` the sources that stop
    come first, so running sums of one row a source give it directly. Only this
    table of one row a source is ordered as a whole.
    """
    every = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = ranked.withColumn("weight", F.element_at(every, (F.pmod(F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("top", F.lit(float(most)) * F.col("source_size"))
    before = W.orderBy(F.col("top") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("top").over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    found = ranked.withColumn("level", level)
    # The first source that the level doesn't fill fixes the level for all after it.
    fits = F.min(F.when(F.col("level") <= F.col("top") / F.col("weight"), F.struct(F.col("top") / F.col("weight"), F.col("level")))).over(whole)
    return found.select("source", "source_size", F.least("top", F.coalesce(fits["level"] * F.col("weight"), F.col("top"))).alias("target"))


def _with(rows: DataFrame, small: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``small``, a stored table of one row a source: where its size is small Spark broadcasts it."""
    return rows.join(small.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")


def levels(sizes: DataFrame, goal: DataFrame, most: float, tilt: float) -> DataFrame:
    """(source, c): the factor at which ``least(most, c * size ** tilt)`` copies of all documents have the target's words.

    In the order of size the documents that stop at ``most`` come first, so
    running sums over a source's distinct sizes give it directly.
    """
    weight = F.pow(F.col("size").cast("double"), F.lit(tilt))
    by_size = sizes.where("size > 0").groupBy("source", "size").agg(F.sum("size").alias("words"))
    rows = _with(by_size, goal).withColumn("weight", weight)
    order = W.partitionBy("source").orderBy(F.col("size").desc())
    before, on = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(W.currentRow, W.unboundedFollowing)
    c = (F.col("target") - F.lit(float(most)) * F.coalesce(F.sum("words").over(before), F.lit(0))) / F.sum(F.col("words") * F.col("weight")).over(on)
    fits = rows.withColumn("c", c).where(F.col("c") * F.col("weight") <= F.lit(most * (1 + 1e-9)))
    return fits.groupBy("source").agg(F.max_by("c", "size").alias("c"))


def _filled(rows: DataFrame) -> DataFrame:
    """``rows`` with take true for those first in rank whose sizes add up to at most the ``gap`` of their source."""
    def edges(part: DataFrame, bin_: str, held: str) -> DataFrame:
        """(source, bin, before): the bin in which the sum goes beyond the gap, and the sum before that bin."""
        sums = part.groupBy("source", bin_).agg(F.sum("size").alias("words"), F.first("gap").alias("gap"), F.first(held).alias("held"))
        sums = sums.withColumn("upto", F.col("held") + F.sum("words").over(W.partitionBy("source").orderBy(bin_)))
        first = F.min(F.struct(F.col(bin_).alias("bin"), (F.col("upto") - F.col("words")).alias("before")))
        return sums.where("upto > gap").groupBy("source").agg(first.alias("edge"))

    parted = rows.withColumn("_one", F.floor(F.col("rank") * BINS)).withColumn("_two", F.pmod(F.floor(F.col("rank") * BINS * BINS), F.lit(BINS))).withColumn("_zero", F.lit(0).cast("long"))
    first = staged(edges(parted, "_one", "_zero"), "mix-edges").select("source", F.col("edge.bin").alias("_at"), F.col("edge.before").alias("_before"))
    parted = _with(parted, first)
    inner = parted.where("_one = _at")
    second = staged(edges(inner, "_two", "_before"), "mix-edges").select("source", F.col("edge.bin").alias("_in"), F.col("edge.before").alias("_upto"))
    inner = _with(inner, second)
    upto = F.col("_upto") + F.sum("size").over(W.partitionBy("source").orderBy("rank", "doc_id", "h").rowsBetween(W.unboundedPreceding, W.currentRow))
    last = inner.where("_two = _in").withColumn("take", upto <= F.col("gap"))
    outer = parted.where("_at is null or _one <> _at").withColumn("take", F.coalesce(F.col("_one") < F.col("_at"), F.lit(True)))
    between = inner.where("_in is null or _two <> _in").withColumn("take", F.coalesce(F.col("_two") < F.col("_in"), F.lit(True)))
    plain = [c for c in rows.columns if c != "take"] + ["take"]
    return outer.select(plain).unionByName(between.select(plain)).unionByName(last.select(plain))


def mix(docs: DataFrame, weights=WEIGHTS, most: float = MOST_COPIES, seed: int = 7, key: str = "doc_id", text: str = "text", source: str = "source", tilt: float = TILT) -> DataFrame:
    """(doc_id, h, size, source, source_size, target, copies) of every row of ``docs``; h a hash of its text, copies how often the mix takes it."""
    body = F.coalesce(F.col(text), F.lit(""))
    sizes = staged(docs.select(F.col(key).alias("doc_id"), F.xxhash64(body).alias("h"), F.col(source).alias("source"), n_words(F.col(text)).alias("size")), "mix-sizes")
    goal = staged(targets(sizes, weights, most), "mix-targets")
    level = staged(levels(sizes, goal, most, tilt), "mix-levels")
    due = _with(_with(sizes, goal), level)
    expected = F.least(F.lit(float(most)), F.col("c") * F.pow(F.col("size").cast("double"), F.lit(tilt)))
    due = due.withColumn("e", F.when(F.col("size") > 0, F.coalesce(expected, F.lit(0.0))).otherwise(F.lit(0.0)))
    due = due.withColumn("whole", F.floor(F.col("e") + 1e-9)).withColumn("p", F.greatest(F.col("e") - F.col("whole"), F.lit(0.0)))
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("h")), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    p = F.least(F.greatest(F.col("p"), F.lit(1e-9)), F.lit(1 - 1e-9))
    odds = (u / (1 - u)) / (p / (1 - p))
    state = staged(due.withColumn("rank", odds / (1 + odds)).withColumn("open", F.col("p") > 1e-9).withColumn("take", F.lit(False)).drop("c", "e", "p"), "mix-due")

    def gaps() -> DataFrame:
        """What each source lacks: its target less the whole copies and what has been taken."""
        had = F.col("whole") + F.col("take").cast("long")
        return staged(state.groupBy("source").agg((F.first("target") - F.sum(had * F.col("size"))).alias("gap")), "mix-gaps")

    columns = state.columns
    for _ in range(ROUNDS):
        seen = _with(state, gaps())
        fits = F.col("open") & ~F.col("take") & (F.col("size") <= F.col("gap"))
        state = staged(seen.where(~fits).select(columns).unionByName(_filled(seen.where(fits)).select(columns)), "mix-due")
    seen = _with(state, gaps())
    far = F.abs(F.col("size") - F.col("gap"))
    nearest = seen.where(F.col("open") & ~F.col("take") & (far < F.col("gap"))).groupBy("source").agg(F.min(F.struct(far.alias("far"), "rank", "doc_id", "h")).alias("best"))
    seen = _with(state, staged(nearest, "mix-last"))
    is_best = F.coalesce(F.col("open") & ~F.col("take") & (F.col("h") == F.col("best.h")) & F.col("doc_id").eqNullSafe(F.col("best.doc_id")), F.lit(False))
    # Of repeated rows one is taken.
    one = seen.where(is_best).withColumn("take", F.row_number().over(W.partitionBy("source", "doc_id", "h").orderBy("rank")) == 1)
    done = seen.where(~is_best).select(columns).unionByName(one.select(columns))
    return done.select("doc_id", "h", "size", "source", "source_size", "target", (F.col("whole") + F.col("take").cast("long")).alias("copies"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; the columns stay as they are.

    Rows of one doc_id, source and text (repeated rows) share their copies in any order.
    """
    key, text, source = how.get("key", "doc_id"), how.get("text", "text"), how.get("source", "source")
    counts = mix(docs, **how).groupBy("doc_id", "source", "h").agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows")).where("_copies > 0")
    counts = counts.select(F.col("doc_id").alias("_key"), F.col("source").alias("_source"), F.col("h").alias("_h"), "_copies", "_rows")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).alias("id"), F.col(source).alias("of"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"))
    joined = rows.join(counts.hint("merge"), (F.col("h") == F.col("_h")) & F.col("id").eqNullSafe(F.col("_key")) & F.col("of").eqNullSafe(F.col("_source")))
    order = F.row_number().over(W.partitionBy("_h", "_key", "_source").orderBy("h"))
    times = F.floor(F.col("_copies") / F.col("_rows")) + (order <= F.pmod("_copies", "_rows")).cast("long")
    timed = joined.withColumn("times", times).where("times > 0")
    return timed.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("row.*")
