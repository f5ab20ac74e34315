"""I-Match document fingerprints (operator 10, native).

The lexicon holds all terms within a band of inverse document frequency: those
found in at least one of ``RAREST`` documents, ``LEAST_DOCS`` at least, and in
at most ``MOST_SHARE`` of them. It is cut at random several times (``DEALS``),
each time into two to the power of so many subsets by some bits of the terms'
hashes: subsets of different deals overlap, those of one deal cover the
lexicon, and the few of a small deal hold half of it each. A document's
fingerprint has for each subset that it has terms of a hash of its sorted
distinct terms there. Large subsets tell equal texts apart from edited ones;
small ones make the fingerprint graded, as an edit leaves those without a
touched term. The likeness of two fingerprints is the share of equal hashes
among the subsets of which either document has a term. A document with no term
of the lexicon is known by a hash of its whole text, like only to equal ones.

Document frequencies are counted over all documents with partial counts before
the shuffle. As both ends of the band are shares of the documents, the lexicon
does not grow with their number: with ``d`` distinct terms in the mean document
at most ``d * RAREST`` terms are in it, each eight bytes. Up to ``MOST_SENT``
terms it goes to all tasks as a constant array of buckets, in which a term is
found at once; a larger one is met by a semi-join of exploded terms.

The next document is found without ordering all rows in one task: ids are cut
into ranges by the bounds of a range partitioning, neighbours are found within
a range, and the first row of each range is also dealt to the end of the range
before it. So texts are shuffled once, each with its fingerprint. What is
broadcast is one row of numbers for each of at most ``MOST_RANGES`` ranges.

Cases: a null text is empty; a text without lexicon terms is known by its own
hash; rows with one doc_id follow in the order of their texts' hashes; a table
of one row has itself as next; an empty table gives an empty result.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.sources.tables import staged

SPACES = r"[\x20\x09-\x0D]+"
#: The band of document frequency: one of so many documents at least, and this share at most.
LEAST_DOCS, RAREST, MOST_SHARE = 3, 5000, 0.2
#: Terms of a lexicon that goes to all tasks at most; its buckets, by the highest bits of a term.
MOST_SENT, BUCKET_BITS = 200_000, 15
#: Each number is a deal of the lexicon into two to its power subsets; the bits of all deals differ.
DEALS = (1, 1, 1, 6)
#: Rows in a range of ids, about, and ranges at most; bounds travel with the plan.
RANGE_ROWS, MOST_RANGES = 2000, 20_000
#: Null ids come before all others.
_LOWEST = -(1 << 63)


def terms(text: Column) -> Column:
    """Distinct 64-bit hashes of a text's lower-case words."""
    return F.array_distinct(F.transform(F.filter(F.split(F.lower(text), SPACES, -1), lambda w: w != ""), lambda w: F.xxhash64(w)))


def lexicon(rows: DataFrame, column: str = "terms") -> DataFrame:
    """(term): every term in the band, from the rows' distinct ``column``."""
    counted = rows.select(F.explode(column).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    n = rows.select(F.count("*").alias("n")).scalar()
    return counted.where((F.col("df") >= LEAST_DOCS) & (F.col("df") * RAREST >= n) & (F.col("df") <= F.lit(MOST_SHARE) * n)).select("term")


def _bucket(term: Column) -> Column:
    return F.shiftrightunsigned(term, 64 - BUCKET_BITS).cast("int")


def buckets(band: DataFrame) -> Column:
    """The terms of ``band`` by their highest bits, as a constant array of as many arrays as there are buckets."""
    lists = band.groupBy(_bucket(F.col("term")).alias("at")).agg(F.collect_list("term").alias("own")).collect()
    of = [[] for _ in range(1 << BUCKET_BITS)]
    for x in lists:
        of[x.at] = sorted(x.own)
    return F.from_json(F.lit(json.dumps(of, separators=(",", ":"))), "array<array<bigint>>")


def kept_to(rows: DataFrame, band: DataFrame, columns: list[str], most_sent: int = MOST_SENT) -> DataFrame:
    """``rows`` with each of ``columns``, arrays of distinct terms, kept to the terms in ``band``."""
    if band.count() <= most_sent:
        own = buckets(band)
        return rows.withColumns({c: F.filter(c, lambda t: F.array_contains(F.get(own, _bucket(t)), t)) for c in columns})
    numbered = staged(rows.withColumn("rid", F.monotonically_increasing_id()), "imatch-rows")
    met = met_terms(numbered, band, columns).withColumnRenamed("rid", "_rid")
    joined = numbered.drop(*columns).join(met.hint("merge"), F.col("rid") == F.col("_rid"), "left")
    return joined.withColumns({c: F.coalesce(c, _none()) for c in columns}).select(*rows.columns)


def met_terms(rows: DataFrame, band: DataFrame, columns: list[str]) -> DataFrame:
    """(rid, columns): of ``rows`` (unique rid, arrays of distinct terms) the terms in ``band`` (term); a row without any is left out."""
    def named(i: int, c: str) -> Column:
        return F.transform(c, lambda t: F.struct(F.lit(i).alias("of"), t.alias("term")))

    each = F.concat(*[named(i, c) for i, c in enumerate(columns)])
    met = rows.select("rid", F.explode(each).alias("x")).select("rid", "x.of", "x.term").join(band, "term", "left_semi")
    return met.groupBy("rid").agg(*[F.collect_list(F.when(F.col("of") == i, F.col("term"))).alias(c) for i, c in enumerate(columns)])


def hashes(met: Column, deals=DEALS) -> Column:
    """For each subset with some of the lexicon terms ``met`` its number and, in the low 32 bits, the hash of those terms sorted.

    For a deal the terms' bits are turned until its own are the highest, so a
    subset's terms lie together once they are sorted.
    """
    found, first, at = [], 0, 0
    for bits in deals:
        found.append(_deal(met, first, at, bits))
        first, at = first + (1 << bits), at + bits
    return F.concat(*found)


def _deal(met: Column, first: int, at: int, bits: int) -> Column:
    turned = F.sort_array(F.transform(met, lambda t: F.shiftleft(t, 64 - at - bits).bitwiseOR(F.shiftrightunsigned(t, at + bits))))
    subset = lambda t: F.shiftrightunsigned(t, 64 - bits)

    # A transform over one element names an array, so that it is made once.
    def cut(own: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(own) - 1), lambda i: (i == 0) | (subset(F.get(own, i)) != subset(F.get(own, i - 1))))

        def each(begins: Column) -> Column:
            def one(i: Column, k: Column) -> Column:
                hashed = F.hash(F.slice(own, i + 1, F.coalesce(F.get(begins, k + 1), F.size(own)) - i))
                return F.shiftleft(subset(F.get(own, i)) + F.lit(first).cast("long"), 32).bitwiseOR(hashed.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))

            return F.transform(begins, one)

        return F.when(F.size(own) > 0, F.transform(F.array(starts), each)[0]).otherwise(_none())

    return F.transform(F.array(turned), cut)[0]


def fingerprint(hashed: Column, whole: Column) -> Column:
    """The numbers and hashes as hexadecimal text joined by a minus; of a text without lexicon terms its ``whole`` hash."""
    return F.when(F.size(hashed) > 0, F.array_join(F.transform(hashed, lambda h: F.lower(F.hex(h))), "-")).otherwise(F.concat(F.lit("whole:"), F.lower(F.hex(whole))))


def likeness(a: Column, b: Column, whole_a: Column, whole_b: Column) -> Column:
    """Equal hashes as a share of the subsets of which either has one, 0 to 1; where none has, whether the whole hashes are equal."""
    number = lambda x: F.transform(x, lambda h: F.shiftrightunsigned(h, 32).cast("int"))
    some = (F.size(a) > 0) | (F.size(b) > 0)
    return F.when(some, F.size(F.array_intersect(a, b)) / F.size(F.array_union(number(a), number(b))).cast("double")).otherwise((whole_a == whole_b).cast("double"))


def _none() -> Column:
    return F.array().cast("array<bigint>")


def with_fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` with the column ``out``; the lexicon is that of ``docs`` itself."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(body).alias("whole"), terms(body).alias("terms"))
    rows = kept_to(rows, staged(lexicon(rows), "imatch-lexicon"), ["terms"]).select("row", "whole", hashes(F.col("terms")).alias("hashed"))
    return rows.select(F.col("row").withField(out, fingerprint(F.col("hashed"), F.col("whole"))).alias("row")).select("row.*")


def _ranges(docs: DataFrame, key: str) -> list[int]:
    """Sorted lower bounds of ranges of about RANGE_ROWS rows: one number a range goes to the driver."""
    ids = docs.select(F.col(key).alias("k")).where("k is not null")
    n = max(1, min(MOST_RANGES, ids.count() // RANGE_ROWS))
    firsts = ids.repartitionByRange(n, "k").groupBy(F.spark_partition_id().alias("p")).agg(F.min("k").alias("k"))
    return sorted(x.k for x in firsts.collect())[1:]


def _range_of(key: Column, bounds: list[int]) -> Column:
    """How many of ``bounds`` are not above ``key``, by bisection."""
    if not bounds:
        return F.lit(0)
    high = 1 << (len(bounds).bit_length() - 1)
    steps = F.array(*[F.lit(high >> i) for i in range(len(bounds).bit_length())])
    sorted_bounds = F.from_json(F.lit(str(bounds)), "array<bigint>")
    return F.coalesce(F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.coalesce(F.get(sorted_bounds, at + s - 1) <= key, F.lit(False)), at + s).otherwise(at)), F.lit(0))


def with_next(docs: DataFrame, key: str, text: str, more: list[str] | None = None) -> DataFrame:
    """(doc_id, text, ``more``, next_...) of all rows: the next by (doc_id, hash of the text); after the last comes the first."""
    carried = ["text", *(more or [])]
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *(more or []))
    rows = rows.withColumns({"range": _range_of(F.col("doc_id"), _ranges(docs, key)), "at": F.struct(F.coalesce("doc_id", F.lit(_LOWEST)).alias("id"), F.xxhash64("text").alias("h"))})
    # At most MOST_RANGES rows of four numbers: the first row of each range, and the range before it on the ring.
    heads = rows.groupBy("range").agg(F.min("at").alias("head"))
    ring = W.orderBy("range")
    heads = staged(heads.select(F.col("range").alias("_range"), "head", F.coalesce(F.lag("range").over(ring), F.max("range").over(W.partitionBy())).alias("previous")), "imatch-heads")
    rows = rows.join(F.broadcast(heads), F.col("range") == F.col("_range"))
    own = F.struct(F.lit(False).alias("guest"), F.col("range").alias("range"))
    guest = F.struct(F.lit(True).alias("guest"), F.col("previous").alias("range"))
    dealt = rows.select("doc_id", *carried, "at", F.explode(F.when(F.col("at") == F.col("head"), F.array(own, guest)).otherwise(F.array(own))).alias("x")).select("doc_id", *carried, "at", "x.guest", "x.range")
    order = W.partitionBy("range").orderBy("guest", "at")
    led = dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in carried})
    return led.where("not guest").select("doc_id", *carried, *[f"next_{c}" for c in carried])


def fingerprint_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of all rows.

    The edited text has its last floor(n_chars / 2) code points replaced by as
    many first ones of the next document, or by all of it if it is shorter.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    band = staged(lexicon(rows.select(terms(F.col("text")).alias("terms"))), "imatch-lexicon")
    rows = kept_to(rows.withColumn("terms", terms(F.col("text"))), band, ["terms"])
    rows = with_next(rows.select("doc_id", "text", hashes(F.col("terms")).alias("hashed")), "doc_id", "text", ["hashed"])
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring(F.col("next_text"), F.lit(1), half)))
    whole = {"whole": F.xxhash64("text"), "edited_whole": F.xxhash64("edited"), "next_whole": F.xxhash64("next_text")}
    rows = rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "hashed", "next_hashed", *[c.alias(name) for name, c in whole.items()], terms(F.col("edited")).alias("terms"))
    rows = kept_to(rows, band, ["terms"])
    rows = rows.select("doc_id", "n_chars", "edited_sha256", "hashed", "next_hashed", *whole, hashes(F.col("terms")).alias("edited_hashed"))
    c = F.col
    return rows.select("doc_id", "n_chars", "edited_sha256", fingerprint(c("hashed"), c("whole")).alias("fingerprint"), fingerprint(c("edited_hashed"), c("edited_whole")).alias("edited_fingerprint"), likeness(c("hashed"), c("edited_hashed"), c("whole"), c("edited_whole")).alias("near_edited"), likeness(c("hashed"), c("next_hashed"), c("whole"), c("next_whole")).alias("near_next"))
