"""Phrase collocations of each language by best-first branch and bound (operator 13).

A phrase of 2 to 5 words with ``a`` occurrences is cut after its first ``k``
words into parts of ``l`` and ``r`` occurrences; its score is the least
``floor(1000 * a * n / (l * r))`` over the cuts. ``r >= a``, so no phrase that
begins with the word ``w`` scores more than ``floor(1000 * n / f(w))``: the
count of a prefix bounds all that grows from it. The frontier is the frequent
words, rarest (highest bound) first. A round grows the best part of it, level
by level, to whole subtrees; then the ``top``-th surviving score found so far,
from below, shows which words can still matter. The search of a language ends
when no word is left whose bound reaches that score, ties included.

How it scales: each round reads the texts twice. Tasks cut them into words with
numpy and aggregate blocks of a few MB before anything is shuffled. The first
reading counts pairs of words by a 64-bit digest (12 bytes a row), the second
counts phrases as text, only where pairs are frequent. What tasks must know
about all words (frequent, to be grown, grown) are bitmaps of a fixed number of
bits, ``CELLS``: a false hit costs work, never a result, as counts are exact
sums by text. A block's digests are checked by a second, independent one. No
language or word is gathered in one task: ranks keep ``top`` rows a task.

Cases: a null text is empty; a null language is ``und``, and joins rows that
say so; an empty table gives an empty result; equal scores go by count, then by
the phrase's bytes; repeated rows count as often as they stand there; a word or
piece of any length is whole. Very long texts are read in blocks that overlap,
so no phrase is lost or counted twice.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm.words import ONE, TWO, mixed, spans
from corpusloom.sources.tables import staged

#: Most words of a phrase, least occurrences, phrases reported for each language.
WORDS, LEAST, TOP = 5, 100, 2000
#: Of the occurrences of frequent words, the part that each round grows at most while no bound is known.
FRONTIER = (0.25, 1.0)
#: Bits of a bitmap, as a power of two: 4 MB.
CELLS = 25
#: Bytes of text that a task works on at a time.
BLOCK = 1 << 21
UND = "und"

#: A-Z become lower case, what ends a piece becomes a line feed, a tab a space.
SIGNS = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")


class _Block:
    """The words of a buffer: where they stand, in which piece, their language and two digests of language and word.

    Only words that begin in ``core`` begin phrases; the rest is context.
    """

    def __init__(self, data: bytes, langs: list[str], offsets: list[int], core: tuple[int, int] | None = None):
        self.data, self.langs = data, langs
        letters = np.frombuffer(data, np.uint8)
        feeds = letters == 10
        self.starts, self.ends = spans(~(feeds | (letters == 32)))
        self.n = len(self.starts)
        self.piece = np.cumsum(feeds)[self.starts] if self.n else np.zeros(0, np.int64)
        self.lang = np.searchsorted(np.array(offsets), self.starts, "right") - 1
        salts = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "big") for x in langs], np.uint64)
        salt = salts[self.lang] if self.n else np.zeros(0, np.uint64)
        self.one, self.two = (mixed(d.of(letters, self.starts, self.ends) + salt) for d in (ONE, TWO))
        self.core = np.ones(self.n, bool) if core is None else (self.starts >= core[0]) & (self.starts < core[1])

    def joined(self, m: int) -> np.ndarray:
        """Whether a word and the ``m - 1`` after it stand in one piece."""
        ok = np.zeros(self.n, bool)
        if self.n >= m:
            ok[: self.n - m + 1] = self.piece[m - 1 :] == self.piece[: self.n - m + 1]
        return ok

    def after(self, a: np.ndarray, by: int) -> np.ndarray:
        """``a`` moved, so that each word has what the ``by``-th word after it has."""
        return np.concatenate([a[by:], np.zeros(min(by, self.n), a.dtype)])

    def phrases(self, digests: np.ndarray, m: int) -> np.ndarray:
        """Digests of the ``m`` words from each word on, given those of the words."""
        out = digests
        for k in range(1, m):
            out = mixed(out * np.uint64(0xFF51AFD7ED558CCD) + self.after(digests, k))
        return out

    def text(self, i: int, m: int) -> str:
        return b" ".join(self.data[self.starts[i] : self.ends[i + m - 1]].split()).decode()


def _cut(data: bytes):
    """Parts of a text of any length, (part, core): cores adjoin between words, parts have the word before and WORDS after."""

    def word_end(at: int) -> int:
        """Where the next word from ``at`` on ends."""
        while at < len(data) and data[at] in b" \n":
            at += 1
        found = [x for x in (data.find(b" ", at), data.find(b"\n", at)) if x >= 0]
        return min(found, default=len(data))

    at = 0
    while at < len(data):
        end = word_end(at + BLOCK) if at + BLOCK < len(data) else len(data)
        low = at
        while low and data[low - 1] in b" \n":
            low -= 1
        low = max(data.rfind(b" ", 0, low), data.rfind(b"\n", 0, low)) + 1
        high = end
        for _ in range(WORDS):
            high = word_end(high)
        yield data[low:high], (at - low, end - low)
        at = end


def _blocks(batches):
    """Batches of (lang, text) as blocks of about BLOCK bytes."""
    held: list[bytes] = []
    langs: list[str] = []
    offsets: list[int] = []
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1)):
            data = (text.as_py() or "").encode("utf-8", "replace").translate(SIGNS)
            own = UND if (own := lang.as_py()) is None else own
            if len(data) > BLOCK:
                for part, core in _cut(data):
                    yield _Block(part, [own], [0], core)
                continue
            held.append(data)
            langs.append(own)
            offsets.append(size)
            size += len(data) + 1
            if size > BLOCK:
                yield _Block(b"\n".join(held), langs, offsets)
                held, langs, offsets, size = [], [], [], 0
    if held:
        yield _Block(b"\n".join(held), langs, offsets)


def _groups(one: np.ndarray, two: np.ndarray):
    """Equal digests together: (order, first of each group in it, sizes). Both digests count, so different words don't meet."""
    order = np.argsort(one)
    a, b = one[order], two[order]
    new = np.concatenate([[True], a[1:] != a[:-1]])
    if len(a) and (b[1:] != b[:-1])[~new[1:]].any():
        order = np.lexsort((two, one))
        a, b = one[order], two[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    first = np.flatnonzero(new[: len(a)])
    return order, first, np.diff(np.append(first, len(a)))


def _in(bitmap: np.ndarray, digests: np.ndarray) -> np.ndarray:
    cell = digests >> np.uint64(64 - CELLS)
    return (bitmap[(cell >> np.uint64(6)).astype(np.int64)] >> (cell & np.uint64(63))) & np.uint64(1) == 1


def _bitmap(rows: DataFrame, digest: str = "digest") -> np.ndarray:
    """A bit for each cell that a digest of ``rows`` falls in. At most 2^CELLS / 64 rows come to the driver, however many there are."""
    cell = F.shiftrightunsigned(digest, 64 - CELLS)
    found = rows.groupBy(F.shiftright(cell, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned({digest}, {64 - CELLS}) & 63 AS INT))")).alias("bits")).toArrow()
    out = np.zeros(1 << (CELLS - 6), np.uint64)
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def _counted_words(batches):
    for x in _blocks(batches):
        own = np.flatnonzero(x.core)
        order, first, sizes = _groups(x.one[own], x.two[own])
        at = own[order[first]]
        yield pa.RecordBatch.from_arrays([pa.array([x.langs[k] for k in x.lang[at]], pa.string()), pa.array([x.text(i, 1) for i in at], pa.string()), pa.array(x.one[at].view(np.int64)), pa.array(sizes, pa.int64())], ["lang", "word", "digest", "f"])


def _counted_pairs(frequent, active):
    def count(batches):
        for x in _blocks(batches):
            often = _in(frequent.value, x.one)
            at = np.flatnonzero(x.core & x.joined(2) & often & x.after(often, 1) & _in(active.value, x.one))
            pairs, sizes = np.unique(x.phrases(x.one, 2)[at], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs.view(np.int64)), pa.array(sizes, pa.int32())], ["digest", "f"])

    return count


def _counted_phrases(frequent, active, grown, heavy):
    """(lang, phrase, a, before, after) of each block's phrases that begin with an active word; before and after: the one word there, null if there are several or none."""

    def lone(words, exists, order, first):
        """Whether all members of a group have the same word there."""
        near = np.where(exists, words, np.uint64(0))[order]
        same = np.minimum.reduceat(near, first) == np.maximum.reduceat(near, first)
        return same & np.logical_and.reduceat(exists[order], first)

    def count(batches):
        for x in _blocks(batches):
            often = _in(frequent.value, x.one)
            pair = _in(heavy.value, x.phrases(x.one, 2))
            # A pair is known to be rare only if its first word has been grown.
            may = x.joined(2) & often & x.after(often, 1) & (pair | ~_in(grown.value, x.one))
            ok = x.core & may & pair & _in(active.value, x.one)
            back = np.concatenate([[False], x.joined(2)[:-1]]) if x.n else x.core
            for m in range(2, WORDS + 1):
                if m > 2:
                    ok = ok & x.after(may, m - 2)
                at = np.flatnonzero(ok)
                if not len(at):
                    break
                order, first, sizes = _groups(x.phrases(x.one, m)[at], x.phrases(x.two, m)[at])
                lead = at[order[first]]
                led = lone(x.two[at - 1], back[at], order, first)
                ahead = x.joined(m + 1)[at]
                followed = lone(x.after(x.two, m)[at], ahead, order, first)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x.langs[k] for k in x.lang[lead]], pa.string()), pa.array([x.text(i, m) for i in lead], pa.string()), pa.array(np.full(len(lead), m, np.int32)), pa.array(sizes, pa.int64()),
                        pa.array([x.text(i - 1, 1) if k else None for i, k in zip(lead, led)], pa.string()), pa.array([x.text(i + m, 1) if k else None for i, k in zip(lead, followed)], pa.string()),
                    ],
                    ["lang", "phrase", "m", "a", "before", "after"],
                )

    return count


def _counted_named(named):
    """(lang, phrase, a) of each block's phrases whose digest is in ``named``."""

    def count(batches):
        for x in _blocks(batches):
            for m in range(2, WORDS):
                one = x.phrases(x.one, m)
                at = np.flatnonzero(x.core & x.joined(m) & _in(named.value, one))
                order, first, sizes = _groups(one[at], x.phrases(x.two, m)[at])
                lead = at[order[first]]
                yield pa.RecordBatch.from_arrays([pa.array([x.langs[k] for k in x.lang[lead]], pa.string()), pa.array([x.text(i, m) for i in lead], pa.string()), pa.array(sizes, pa.int64())], ["lang", "phrase", "a"])

    return count


def _digests(batches):
    """(digest) of phrases (lang, phrase), as blocks have them."""
    for batch in batches:
        out = []
        for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x = _Block(phrase.encode(), [lang], [0])
            out.append(x.phrases(x.one, x.n)[0])
        yield pa.RecordBatch.from_arrays([pa.array(np.array(out, np.uint64).view(np.int64))], ["digest"])


def _score(a: str, n: str, left: str, right: str):
    """floor(1000 * a * n / (left * right)), exact beyond 64 bits."""
    return F.expr(f"(1000 * CAST({a} AS DECIMAL(16,0)) * CAST({n} AS DECIMAL(17,0))) div (CAST({left} AS DECIMAL(18,0)) * CAST({right} AS DECIMAL(18,0)))")


def _survivors(phrases: DataFrame) -> DataFrame:
    """Phrases that no longer one covers: one that always has the same word before or after it occurs as often with that word."""
    return phrases.where((F.col("m") == WORDS) | ~(F.col("led") | F.col("followed"))).select("lang", "phrase", "m", "a")


def _scored(alive: DataFrame, phrases: DataFrame, words: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, m, a, l, r, n, low, high, unknown) of phrases: scores from below and above, equal where all parts are counted.

    ``phrases``: (lang, phrase, a) of all parts counted so far. unknown: the other parts.
    """
    counts = phrases.select("lang", "phrase", "a").unionByName(words.select("lang", F.col("word").alias("phrase"), F.col("f").alias("a")))
    each = alive.withColumn("w", F.split("phrase", " ")).withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("m") - 1)))
    rest = F.array_join(F.slice("w", F.col("cut") + 1, F.size("w") - F.col("cut")), " ")
    each = each.select("lang", "phrase", "m", "a", "cut", F.array_join(F.slice("w", F.lit(1), F.col("cut")), " ").alias("first"), rest.alias("rest"), F.get("w", F.col("cut")).alias("word"))
    known = lambda name, count: counts.select("lang", F.col("phrase").alias(name), F.col("a").alias(count))
    each = each.join(known("first", "l"), ["lang", "first"]).join(known("rest", "r"), ["lang", "rest"], "left")
    # A part not counted yet occurs at least as often as the phrase and at most as often as its first word.
    each = each.join(words.select("lang", "word", F.col("f").alias("most")), ["lang", "word"]).join(totals, "lang")
    each = each.withColumns({"low": _score("a", "n", "l", "coalesce(r, most)"), "high": _score("a", "n", "l", "coalesce(r, a)")})
    best = F.min(F.struct("low", "cut", "l", "r")).alias("best")
    found = each.groupBy("lang", "phrase", "m", "a", "n").agg(best, F.min("high").alias("high"), F.collect_list(F.when(F.col("r").isNull(), F.col("rest"))).alias("unknown"))
    return found.select("lang", "phrase", "m", "a", "best.l", "best.r", "n", "best.low", "high", "unknown")


def _reached(scored: DataFrame, top: int) -> DataFrame:
    """(lang, reached): the ``top``-th score from below of each language that has so many."""
    at = F.row_number().over(W.partitionBy("lang").orderBy(F.col("low").desc()))
    return scored.select("lang", "low").withColumn("at", at).where(F.col("at") <= top).where(F.col("at") == top).select("lang", F.col("low").alias("reached"))


def mine(docs: DataFrame, top: int = TOP, least: int = LEAST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` surviving phrases of ``least`` occurrences."""
    context = docs.sparkSession.sparkContext
    sent = lambda rows: context.broadcast(_bitmap(rows))
    texts = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counted = texts.mapInArrow(_counted_words, "lang string, word string, digest long, f long").groupBy("lang", "word").agg(F.first("digest").alias("digest"), F.sum("f").alias("f"))
    # Rare words are one row a language, without a word.
    named = lambda c: F.when(F.col("f") >= least, F.col(c)).alias(c)
    counted = staged(counted.select("lang", named("word"), named("digest"), "f").groupBy("lang", "word", "digest").agg(F.sum("f").alias("f")), "collocation-words")
    words, totals = counted.where("word is not null"), counted.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = sent(words)

    # The frontier by classes of frequency, of which a language has a fixed number.
    graded = words.join(totals, "lang").withColumn("bound", F.expr("(1000 * cast(n as decimal(17,0))) div f")).withColumn("grade", F.floor(8 * F.log2("f")).cast("int"))
    share = F.sum("s").over(W.partitionBy("lang").orderBy("grade")) / F.sum("s").over(W.partitionBy("lang"))
    shares = graded.groupBy("lang", "grade").agg(F.sum("f").alias("s")).select("lang", "grade", share.alias("share"))
    graded = staged(graded.join(shares, ["lang", "grade"]).select("lang", "word", "digest", "bound", "share"), "collocation-frontier")

    grown, heavy, phrases = graded.select("lang", "word", "digest").where("false"), None, None
    for portion in FRONTIER:
        open_ = F.col("share") <= portion
        todo = graded
        if phrases is not None:
            # With a top-th score from below, the words whose bound reaches it are all that is left of a language.
            todo = todo.join(_reached(_scored(_survivors(phrases), phrases, words, totals), top), "lang", "left")
            open_ = F.when(F.col("reached").isNotNull(), F.col("bound") >= F.col("reached")).otherwise(open_)
        todo = staged(todo.where(open_).select("lang", "word", "digest").join(grown, ["lang", "word"], "left_anti").select("lang", "word", "digest"), "collocation-grow")
        if todo.isEmpty():
            continue
        active = sent(todo)
        pairs = texts.mapInArrow(_counted_pairs(frequent, active), "digest long, f int").groupBy("digest").agg(F.sum("f").alias("f")).where(F.col("f") >= least).select("digest")
        heavy = staged(pairs if heavy is None else pairs.unionByName(heavy), "collocation-pairs")
        grown = staged(grown.unionByName(todo), "collocation-grown")
        new = texts.mapInArrow(_counted_phrases(frequent, active, sent(grown), sent(heavy)), "lang string, phrase string, m int, a long, before string, after string")
        lone = lambda c: F.coalesce((F.min(c) == F.max(c)) & (F.count(c) == F.count("*")), F.lit(False))
        new = new.groupBy("lang", "phrase", "m").agg(F.sum("a").alias("a"), lone("before").alias("led"), lone("after").alias("followed")).where(F.col("a") >= least)
        # A false hit of a bitmap may have begun with a word of another round.
        new = new.withColumn("word", F.substring_index("phrase", " ", 1)).join(todo.select("lang", "word"), ["lang", "word"], "left_semi").drop("word")
        phrases = staged(new if phrases is None else phrases.unionByName(new), "collocation-phrases")
    if phrases is None:
        return docs.sparkSession.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")

    # What may still be among the first is scored exactly: parts that begin with words never grown are counted by name.
    scored = staged(_scored(_survivors(phrases), phrases, words, totals), "collocation-scores")
    may = scored.join(_reached(scored, top), "lang", "left").where("reached is null or high >= reached").select(scored.columns)
    missing = staged(may.select("lang", F.explode("unknown").alias("phrase")).distinct(), "collocation-parts")
    if not missing.isEmpty():
        found = texts.mapInArrow(_counted_named(sent(missing.mapInArrow(_digests, "digest long"))), "lang string, phrase string, a long")
        found = staged(found.groupBy("lang", "phrase").agg(F.sum("a").alias("a")).join(missing, ["lang", "phrase"], "left_semi"), "collocation-counts")
        may = _scored(may.select("lang", "phrase", "m", "a"), phrases.select("lang", "phrase", "a").unionByName(found), words, totals)
    order = W.partitionBy("lang").orderBy(F.col("low").desc(), F.col("a").desc(), "phrase")
    ranked = may.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("low").alias("score"))
