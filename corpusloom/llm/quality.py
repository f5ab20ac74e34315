"""Quality rules with risk-controlled thresholds (operator 6, native).

The base rules are fixed. Besides, each rule in ``RULES`` scores a document and
rejects it above a cutoff. Cutoffs come from labelled documents: for each
stratum (language) the whole set of rules is made stricter step by step, in an
order fixed in advance (``STEPS``: one rule's next cutoff at a time, the mildest
of all rules first). Each step is tested by the exact binomial tail: that ``k``
or fewer of the ``n`` good holdout documents of the stratum are rejected by any
rule must have probability at most ``delta`` divided by the number of strata if
the true rate were ``alpha`` (Bonferroni over strata; in a fixed order testing
stops at the first failure, so the steps cost no more). The cutoffs of the last
step before that hold; a rule without one rejects nothing in that stratum. So
with probability ``1 - delta`` all rules together falsely reject at most
``alpha`` of the good documents of every stratum. With four strata 42 good
documents of which none is rejected are enough for a cutoff.

All of it is DataFrame work: features are array functions over one text in one
row, without a shuffle; thresholds are aggregates over the labelled rows, one
row a (stratum, rule, cutoff).

Cases: a null text has no words and fails the base rules; a null language is a
stratum of its own; documents without labels are only judged; with an empty
label table no cutoff is set and the base rules alone decide. Labels of a
document that differ count as one each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.sources.tables import staged

SPACES, SYMBOLS = r"[\x20\x09-\x0D]+", "#*$%&|<>"
#: Base rules.
LEAST_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8
#: The false rejection allowed in each stratum, by all rules together; the error probability of all tests together.
ALPHA, DELTA = 0.1, 0.05
#: Cutoffs tried, from the mildest to the strictest, as numbers of the score.
RULES = {
    "symbols_per_word": (4.0, 3.0, 2.0, 1.5, 1.0, 0.7, 0.5, 0.3, 0.2, 0.1),
    "dup_line_share": (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2),
    "repeat_word_share": (0.28, 0.25, 0.2, 0.15, 0.1, 0.05),
    "long_words": (40.0, 30.0, 25.0, 20.0, 16.0, 13.0, 11.0),
    "short_words": (-1.5, -2.0, -2.5, -3.0, -3.5),
}
#: (rule, cutoff) in the order of the tests: each rule is as far through its own cutoffs as the others.
STEPS = sorted(((rule, cut) for rule, cuts in RULES.items() for cut in cuts), key=lambda x: (RULES[x[0]].index(x[1]) + 1) / len(RULES[x[0]]))


def _words(text: Column) -> Column:
    """The words of a text; separators at its ends leave empty parts, which are cut off."""
    blank = lambda at: F.substring(text, at, 1).isin(*" \t\n\v\f\r").cast("int")
    parts = F.split(text, SPACES, -1)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.slice(parts, 1 + blank(1), F.greatest(F.lit(0), F.size(parts) - blank(1) - blank(-1))))


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long); same-named columns are replaced.

    A repeated window is found by the equality of eight word hashes of 64 bits
    each, packed in one hash; the words it covers are counted from the sorted
    positions of such windows, each adding what the next one doesn't cover.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.withColumn("_text", body).withColumn("_words", _words(F.col("_text")))
    rows = rows.withColumn("n_words", F.size("_words").cast("long"))
    rows = rows.withColumn("word_chars", F.length(F.translate("_text", " \t\n\v\f\r", "")).cast("long"))
    rows = rows.withColumn("n_symbols", (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long"))
    lines = F.filter(F.split("_text", "\n", -1), lambda x: F.trim(F.translate(x, "\t\v\f\r", "    ")) != "")
    rows = rows.withColumn("_lines", lines).withColumn("n_lines", F.size("_lines").cast("long"))
    rows = rows.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    rows = rows.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    at = lambda i, j: F.get(F.col("_hashes"), i + j)
    windows = F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - WINDOW), lambda i: F.xxhash64(*[at(i, j) for j in range(WINDOW)]))
    rows = rows.withColumn("_windows", F.when(F.col("n_words") >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")))
    repeated = F.size("_windows") > F.size(F.array_distinct("_windows"))
    placed = F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("_placed", F.when(repeated, placed))
    same = lambda x, i, d: F.coalesce(F.get(F.col("_placed"), i + d)["h"] == x["h"], F.lit(False))
    hits = F.filter("_placed", lambda x, i: same(x, i, 1) | ((i > 0) & same(x, F.greatest(i, F.lit(1)), -1)))
    rows = rows.withColumn("_starts", F.array_sort(F.transform(hits, lambda x: x["i"])))
    covered = F.aggregate("_starts", F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")), lambda a, s: F.struct((a["n"] + F.least(F.lit(WINDOW), s - a["last"])).alias("n"), s.alias("last")), lambda a: a["n"])
    rows = rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    return rows.drop("_text", "_words", "_lines", "_hashes", "_windows", "_placed", "_starts")


def scores(rows: DataFrame) -> DataFrame:
    """``rows`` of ``features`` with a score for each of ``RULES``: the higher, the worse."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    mean = F.col("word_chars") / words
    return rows.withColumns({
        "symbols_per_word": F.col("n_symbols") / words,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_word_share": F.col("n_repeat_words") / words,
        "long_words": mean,
        "short_words": -mean,
    })


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(REPEAT_PERCENT) * F.col("n_words"))


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """P(at most ``k`` of ``n``) at ``rate``, summed exactly in logarithms from the first term on."""
    odds = F.log(F.lit(rate / (1 - rate)))
    first = n * F.log(F.lit(1 - rate))

    def add(a: Column, i: Column) -> Column:
        term = a["term"] + F.log((n - i + 1) / i) + odds
        top = F.greatest(a["sum"], term)
        return F.struct(term.alias("term"), (top + F.log(F.exp(a["sum"] - top) + F.exp(term - top))).alias("sum"))

    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, F.struct(first.alias("term"), first.alias("sum")), add, lambda a: F.least(F.lit(1.0), F.exp(a["sum"])))


def thresholds(good: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff): what ``good`` rows (stratum and the scores of ``RULES``) allow."""
    # A row is rejected from the first step on whose cutoff it passes; one pass counts the rows of each step.
    first = F.least(*[F.when(F.col(rule) > cut, F.lit(i)) for i, (rule, cut) in enumerate(STEPS)])
    counts = good.select("stratum", first.alias("first")).groupBy("stratum").agg(F.count("*").alias("n"), *[F.count_if(F.col("first") <= i).alias(f"k_{i}") for i in range(len(STEPS))])
    tested = counts.select("stratum", "n", F.inline(F.array(*[F.struct(F.lit(i).alias("step"), F.lit(rule).alias("rule"), F.lit(float(cut)).alias("cutoff"), F.col(f"k_{i}").alias("k")) for i, (rule, cut) in enumerate(STEPS)])))
    allowed = F.lit(delta) / F.count("*").over(W.partitionBy("step"))
    # Where k is over its share of n the tail is over a half or so: no need to sum it.
    passed = F.when(F.col("k") > F.lit(alpha) * F.col("n"), False).otherwise(binomial_tail(F.col("k"), F.col("n"), alpha) <= F.col("allowed"))
    so_far = W.partitionBy("stratum").orderBy("step").rowsBetween(W.unboundedPreceding, W.currentRow)
    tested = tested.withColumn("allowed", allowed).withColumn("passed", passed).withColumn("all_passed", F.min("passed").over(so_far))
    return tested.where("all_passed").groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))


def judge(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """(doc_id, stratum, the features, base_failed, rejected_by, kept) of every row of ``docs``.

    ``labels``: doc_id and quality (1 good). Cutoffs are learnt on good rows that pass the base rules.
    """
    rows = features(docs.select(F.col(key).alias("doc_id"), F.col(stratum).alias("stratum"), F.col(text).alias("text"))).drop("text").withColumn("base_failed", base_failed())
    rows = scores(staged(rows, "quality-features"))
    good = labels.where("quality = 1").select(F.col("doc_id").alias("_key"))
    cuts = thresholds(rows.where(~F.col("base_failed")).join(good, F.col("doc_id") == F.col("_key")), alpha, delta)
    wide = cuts.groupBy("stratum").agg(*[F.min(F.when(F.col("rule") == rule, F.col("cutoff"))).alias(f"cut_{rule}") for rule in RULES]).withColumnRenamed("stratum", "_stratum")
    judged = rows.join(wide, F.col("stratum").eqNullSafe(F.col("_stratum")), "left")
    by = F.filter(F.array(*[F.when(F.col(rule) > F.col(f"cut_{rule}"), F.lit(rule)) for rule in RULES]), lambda x: x.isNotNull())
    return judged.withColumn("rejected_by", by).withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0)).drop("_stratum", *[f"cut_{r}" for r in RULES], *RULES)
