"""Near-duplicate join on word n-grams: MinHash banding, then exact Jaccard (operator 9).

A text's set holds its distinct runs of five words (a shorter text: its one run
of all words), each as a 64-bit hash. Texts with equal sets are copies; one
representative a set goes on, so a group of copies of any size is one row.
Bands and rows are chosen for the target recall at the threshold. Sets meet on
band hashes:

* in a bucket of at most ``SMALL`` sets every two are a candidate pair;
* a larger bucket is cut into blocks of about ``BLOCK_SETS`` sets or ``BLOCK_WEIGHT``
  hashes, and every two blocks are compared whole in one group: all pairs of the
  bucket are verified, but what leaves a group is one row a set, with the number of
  its links and one set of its component, not the pairs. A pair that shares several
  large buckets is counted in the first band of them only, and not among the others.

Candidates are verified on the full sets. Verified links give classes by
connected components, with minimum labels and pointer jumping.

How it scales: what is shuffled for banding is one number a band and set; sets
of hashes are made only for representatives that have a candidate; counts are
partial before each shuffle; every join on a key that can be hot is an ordinary
equi-join, which Spark splits where it is skewed. A family of m different sets
costs m squared comparisons, dealt in block pairs; its rows grow by its blocks. Nothing is collected; rounds
of the components end by one count each.

A set is known by its own hash, not by a doc_id, so ids may be null or shared by
different texts. Cases: a null or blank text has an empty set, no links and a
class of its own; repeated rows have one class; class_id is the smallest doc_id
of the class, null if it has none; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.segments import slices
from corpusloom.sources.tables import staged

SPACES = r"[\x20\x09-\x0D]+"
WORDS, THRESHOLD, RECALL, MOST_HASHES = 5, 0.8, 0.999, 128
#: Sets in a bucket up to which all pairs are candidates.
SMALL = 12
#: Sets and hashes of a block of a larger bucket, about; columns of a matrix of them at a time.
BLOCK_SETS, BLOCK_WEIGHT, COLUMNS = 1024, 1 << 18, 4096
#: Rows whose signatures are made at a time.
SLICE = 500


def bands_and_rows(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """The most rows a band, and the bands they need, for ``recall`` of pairs at the threshold with at most ``most`` hashes."""
    best = (most, 1)
    for rows in range(1, 17):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def shingles(text: Column, words: int = WORDS) -> Column:
    """The distinct hashes of the runs of ``words`` words, empty for a text without words."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), SPACES, -1), lambda w: w != "")
    return shingles_of(F.transform(parts, lambda w: F.xxhash64(w)), words)


def shingles_of(hashed: Column, words: int) -> Column:
    """The same from the words' hashes. A transform over one element names the array, so it is made once."""
    def make(h: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(h) - words), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(words)]))
        return F.when(F.size(h) >= words, F.array_distinct(runs)).when(F.size(h) > 0, F.array(F.xxhash64(F.lit("short"), h))).otherwise(F.array().cast("array<bigint>"))

    return F.transform(F.array(hashed), make)[0]


def _mixed(seed: int, n: int):
    import numpy as np

    made = np.random.Generator(np.random.PCG64(seed))
    return made.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), made.integers(0, 1 << 63, n, dtype=np.uint64)


def band_hashes(rows: DataFrame, bands: int, per_band: int, seed: int = 3) -> DataFrame:
    """(doc_id, h, set_key, n, bands) of ``rows`` (doc_id, h, set_key, shingles): the hash of each band's minima, none for an empty set."""
    import numpy as np
    import pyarrow as pa

    out = T.StructType([rows.schema["doc_id"], T.StructField("h", T.LongType()), T.StructField("set_key", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches):
        times, plus = _mixed(seed, bands * per_band)
        for batch in slices(batches, SLICE):
            lists = batch.column(3)
            start = lists.offsets.to_numpy()
            values = lists.values.to_numpy().view(np.uint64)
            size = np.diff(start)
            full = np.flatnonzero(size)
            keys = np.zeros((batch.num_rows, bands), dtype=np.uint64)
            if len(full):
                at = start[:-1][full] - start[0]
                values = values[start[0] : start[-1]]
                for b in range(bands):
                    key = np.full(len(full), b + 1, dtype=np.uint64)
                    for k in range(b * per_band, (b + 1) * per_band):
                        # Multiply, fold, multiply: high bits decide the order, and all input bits reach them.
                        h = values * times[k] + plus[k]
                        h ^= h >> np.uint64(31)
                        h *= np.uint64(0x9E3779B97F4A7C15)
                        low = np.minimum.reduceat(h, at)
                        key = (key ^ low) * np.uint64(0xD6E8FEB86659FD93)
                        key ^= key >> np.uint64(32)
                    keys[full, b] = key
            offsets = np.concatenate([[0], np.cumsum(np.where(size > 0, bands, 0))]).astype(np.int32)
            flat = keys[full].reshape(-1).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(size.astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=out.names)

    return rows.select("doc_id", "h", "set_key", "shingles").mapInArrow(run, out)


def meetings(sets: DataFrame) -> DataFrame:
    """(rep, size, band, key, n, weight) of ``sets`` (rep, size, bands) in each bucket of n > 1 sets with ``weight`` hashes in all, staged."""
    spread = sets.select("rep", "size", F.posexplode("bands").alias("band", "key"))
    met = spread.groupBy("band", "key").agg(F.count("*").alias("n"), F.sum("size").alias("weight")).where("n > 1").select(F.col("band").alias("_band"), F.col("key").alias("_key"), "n", "weight")
    return staged(spread.join(met, (F.col("band") == F.col("_band")) & (F.col("key") == F.col("_key"))).drop("_band", "_key"), "ngram-buckets")


def large_bands(rows: DataFrame, bands: int, small: int = SMALL) -> DataFrame:
    """(rep, large) of the sets of ``rows`` (``meetings``) in a bucket above ``small``: its key for each band, null where the bucket is not."""
    of = rows.where(F.col("n") > small).groupBy("rep").agg(F.map_from_entries(F.collect_list(F.struct("band", "key"))).alias("of"))
    return of.select("rep", F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.try_element_at("of", b)).alias("large"))


def candidate_pairs(rows: DataFrame, large: DataFrame, small: int = SMALL) -> DataFrame:
    """Distinct (a, b), a < b, that share a bucket of at most ``small`` sets and no larger one."""
    few = rows.where(F.col("n") <= small).select("band", "key", "rep")
    other = few.select(F.col("band").alias("_band"), F.col("key").alias("_key"), F.col("rep").alias("_rep"))
    close = few.join(other, (F.col("band") == F.col("_band")) & (F.col("key") == F.col("_key")) & (F.col("rep") < F.col("_rep"))).select(F.col("rep").alias("a"), F.col("_rep").alias("b")).distinct()
    close = close.join(large.select(F.col("rep").alias("a"), F.col("large").alias("a_large")), "a", "left").join(large.select(F.col("rep").alias("b"), F.col("large").alias("b_large")), "b", "left")
    shared = F.exists(F.zip_with("a_large", "b_large", lambda x, y: x == y), lambda same: F.coalesce(same, F.lit(False)))
    return close.where(~F.coalesce(shared, F.lit(False))).select("a", "b")


def common_counts(a: tuple, b: tuple):
    """The matrix of how many hashes each set of ``a`` has in common with each of ``b``, both as (flat hashes, sizes)."""
    import numpy as np

    (left, n_left), (right, n_right) = a, b
    both = np.intersect1d(left, right)
    found = np.zeros((len(n_left), len(n_right)), dtype=np.float32)
    sides = []
    for flat, sizes in (a, b):
        at = np.searchsorted(both, flat)
        at[at == len(both)] = 0
        known = np.flatnonzero(both[at] == flat) if len(both) else np.zeros(0, dtype=np.int64)
        code, row = at[known], np.repeat(np.arange(len(sizes)), sizes)[known]
        order = np.argsort(code, kind="stable")
        sides.append((code[order], row[order], len(sizes)))
    for start in range(0, len(both), COLUMNS):
        made = []
        for code, row, n in sides:
            lo, hi = np.searchsorted(code, (start, start + COLUMNS))
            matrix = np.zeros((n, min(COLUMNS, len(both) - start)), dtype=np.float32)
            matrix[row[lo:hi], code[lo:hi] - start] = 1
            made.append(matrix)
        found += made[0] @ made[1].T
    return found


def component_of(linked):
    """For each vertex of a symmetric matrix one vertex of its component."""
    import numpy as np

    label = np.full(len(linked), -1)
    for start in range(len(linked)):
        if label[start] < 0:
            front = np.array([start])
            label[start] = start
            while len(front):
                front = np.flatnonzero(linked[front].any(axis=0) & (label < 0))
                label[front] = start
    return label


def block_links(rows: DataFrame, large: DataFrame, sets: DataFrame, threshold: float = THRESHOLD, small: int = SMALL) -> DataFrame:
    """(a, b, n): sets with n > 0 links counted in a pair of blocks of a bucket above ``small``, b one set of a's component there.

    Over all groups every two sets that share such a bucket are compared, and counted once.
    """
    import numpy as np
    import pyarrow as pa

    most = rows.where(F.col("n") > small).withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK_SETS), F.ceil(F.col("weight") / BLOCK_WEIGHT)).cast("int"))
    own = most.select("rep", "band", "key", "blocks", F.pmod(F.xxhash64(F.lit("block"), "rep"), F.col("blocks")).cast("int").alias("mine"))
    own = own.join(large, "rep").join(sets, "rep")
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    own = own.select("band", "key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "rep", "large", "shingles")
    out = T.StructType([T.StructField("a", rows.schema["rep"].dataType), T.StructField("b", rows.schema["rep"].dataType), T.StructField("n", T.LongType())])

    def run(key, group):
        band, _, i, j = (k.as_py() for k in key)
        group = group.combine_chunks()
        rep = group.column("rep").combine_chunks()
        mine = group.column("mine").to_numpy()
        shingles, bands = group.column("shingles").combine_chunks(), group.column("large").combine_chunks()
        keys = bands.flatten().fill_null(0).to_numpy(zero_copy_only=False).reshape(len(mine), -1)
        known = bands.flatten().is_valid().to_numpy(zero_copy_only=False).reshape(len(mine), -1)
        side = [np.flatnonzero(mine == k) for k in (i, j)]
        parts = [shingles.take(pa.array(at)) for at in side]
        flat = [(p.flatten().to_numpy(zero_copy_only=False), p.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)) for p in parts]
        both = common_counts(*flat).astype(np.float64)
        whole = flat[0][1][:, None] + flat[1][1][None, :] - both
        linked = both / whole >= threshold
        for k in range(band):  # counted in an earlier band
            linked &= ~((keys[side[0], k][:, None] == keys[side[1], k][None, :]) & known[side[0], k][:, None])
        every = np.zeros((len(mine), len(mine)), dtype=bool)
        every[np.ix_(*side)] = linked
        np.fill_diagonal(every, False)
        every |= every.T
        degree = every.sum(axis=1)
        at = np.flatnonzero(degree)
        return pa.table([rep.take(pa.array(at)), rep.take(pa.array(component_of(every)[at])), pa.array(degree[at].astype(np.int64))], names=out.names)

    return own.groupBy("band", "key", "i", "j").applyInArrow(run, out)


def verified(pairs: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, jaccard) of ``pairs`` at or above the threshold, on the full sets in ``sets`` (rep, shingles)."""
    one = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("a_set"))
    two = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("b_set"))
    rows = pairs.join(one, "a").join(two, "b")
    rows = rows.withColumn("both", F.size(F.array_intersect("a_set", "b_set")))
    rows = rows.select("a", "b", (F.col("both") / (F.size("a_set") + F.size("b_set") - F.col("both"))).alias("jaccard"))
    return rows.where(F.col("jaccard") >= threshold)


def components(links: DataFrame) -> DataFrame:
    """(v, label) for each end of ``links`` (a, b): the smallest vertex of its component.

    Each round every vertex, and the label it holds, takes the smallest label
    seen over a link, then labels jump to their labels' labels.
    """
    both = staged(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))), "links")
    labels = staged(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("label")).withColumnRenamed("u", "x"), "labels")
    while True:
        own = labels.select(F.col("x").alias("u"), F.col("label").alias("fu"))
        far = labels.select(F.col("x").alias("v"), F.col("label").alias("fv"))
        seen = both.join(own, "u").join(far, "v")
        offers = seen.where("fv < fu").select(F.explode(F.array("u", "fu")).alias("x"), F.col("fv").alias("label"))
        lower = labels.unionByName(offers).groupBy("x").agg(F.min("label").alias("label"))
        up = lower.select(F.col("x").alias("label"), F.col("label").alias("top"))
        jumped = staged(lower.join(up, "label", "left").select("x", F.least("label", F.coalesce("top", "label")).alias("label")), "labels")
        before = labels.select("x", F.col("label").alias("was"))
        changed = jumped.join(before, "x").where("label != was").limit(1).count()
        labels = jumped
        if not changed:
            return labels.select(F.col("x").alias("v"), "label")


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def families(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """The signature of every row (``band_hashes``), and (set_key, first, n_links, n_copies) of every set that isn't empty.

    ``first`` (no_id, id, h) is the row of the smallest id in the set's class, ``h`` a hash of its text.
    """
    bands, rows = bands_and_rows(threshold, recall)
    hashed = docs.select(F.col(key).alias("doc_id"), _text_hash(F.col(text)).alias("h"), shingles(F.col(text), words).alias("shingles"))
    # Two hashes of the sorted set, folded with its size: equal sets, equal keys.
    keyed = hashed.withColumn("set_key", F.xxhash64(F.array_sort("shingles"), F.size("shingles")))
    signed = staged(band_hashes(keyed, bands, rows), "ngram-signatures")
    holder = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), "h")
    reps = signed.where("n > 0").groupBy(F.col("set_key").alias("rep")).agg(F.min(holder).alias("holder"), F.count("*").alias("n_copies"), F.first("n").alias("size"), F.first("bands").alias("bands"))
    reps = staged(reps, "ngram-sets")
    met = meetings(reps)
    large = staged(large_bands(met, bands), "ngram-large")
    pairs = staged(candidate_pairs(met, large), "ngram-pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("rep")).unionByName(large.select("rep")).distinct()
    sets = hashed_sets(docs, key, text, reps.join(wanted.hint("merge"), "rep", "left_semi").select("rep", "holder.id", "holder.h"), words)
    links = staged(verified(pairs, sets, threshold), "ngram-links")
    more = staged(block_links(met, large, sets, threshold), "ngram-block-links")
    labels = components(links.select("a", "b").unionByName(more.where("a != b").select("a", "b").distinct()))
    degree = links.select(F.explode(F.array("a", "b")).alias("w"), F.lit(1).cast("long").alias("n")).unionByName(more.select(F.col("a").alias("w"), "n")).groupBy("w").agg(F.sum("n").alias("n_links"))
    found = reps.select("rep", "holder", "n_copies").join(labels, F.col("rep") == F.col("v"), "left").join(degree, F.col("rep") == F.col("w"), "left")
    found = staged(found.select("rep", "holder", "n_copies", "label", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "ngram-families")
    firsts = found.where("label is not null").groupBy(F.col("label").alias("_label")).agg(F.min("holder").alias("first"))
    found = found.join(firsts, F.col("label") == F.col("_label"), "left")
    return signed, found.select(F.col("rep").alias("set_key"), F.coalesce("first", "holder").alias("first"), "n_links", "n_copies")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, n_links, n_copies) of every row of ``docs``.

    n_links: verified links of the row's text to other texts; n_copies: rows with its set, itself included.
    """
    signed, known = families(docs, key, text, words, threshold, recall)
    known = known.select(F.col("set_key").alias("_key"), F.col("first.id").alias("class_id"), "n_links", "n_copies")
    joined = signed.select("doc_id", F.when(F.col("n") > 0, F.col("set_key")).alias("set_key")).join(known, F.col("set_key") == F.col("_key"), "left")
    return joined.select("doc_id", F.when(F.col("_key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"))


def _row_key(key: Column, text: Column) -> list[Column]:
    """What tells rows apart in joins: whether there is an id, the id, a hash of the text; none of them null."""
    return [key.isNull().alias("_no_id"), F.coalesce(key, F.lit(0)).alias("_id"), _text_hash(text).alias("_h")]


def hashed_sets(docs: DataFrame, key: str, text: str, wanted: DataFrame, words: int) -> DataFrame:
    """(rep, shingles) for ``wanted`` (rep, id, h), staged.

    The join is by merge at every size: ids grow with the documents, so they
    are never broadcast.
    """
    sought = wanted.select("rep", F.col("id").isNull().alias("_no_id"), F.coalesce("id", F.lit(0)).alias("_id"), F.col("h").alias("_h"))
    rows = docs.select(*_row_key(F.col(key), F.col(text)), F.col(text).alias("_t")).join(sought.hint("merge"), ["_no_id", "_id", "_h"])
    rows = rows.select("rep", shingles(F.col("_t"), words).alias("shingles")).where(F.size("shingles") > 0)
    return staged(rows.groupBy("rep").agg(F.first("shingles").alias("shingles")), "ngram-full-sets")


def without_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each class: that of the smallest id, a row without an id only if no other has one.

    Rows go only for a copy that stays: different texts with one id or with
    none are not copies. A row without words stays.
    """
    _, known = families(docs, key, text)
    kept = known.select("first.*").distinct().select(F.col("no_id").alias("_no_id"), F.coalesce("id", F.lit(0)).alias("_id"), F.col("h").alias("_h"))
    worded = F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    rows = docs.where(worded).select(F.struct(*docs.columns).alias("row"), *_row_key(F.col(key), F.col(text)))
    one = rows.join(kept.hint("merge"), ["_no_id", "_id", "_h"], "left_semi").dropDuplicates(["_no_id", "_id", "_h"]).select("row.*")
    return one.unionByName(docs.where(~worded))
