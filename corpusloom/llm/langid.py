"""Language of texts by Bayesian fusion of four kinds of evidence (operator 4).

* text: likelihoods of hashed byte trigrams of its words, one table row a bucket, learnt on
  all rows with a declared language; a further class ``und``
  with equal chances for all buckets stands for what is in no known language;
* markup: how likely each language is declared as the one the row declares;
* address: how likely each language has the row's address suffix;
* host: how likely each language is on the row's host, smoothed towards its
  domain and that towards all rows, the row's own text left out.

The last three are counted by grouped aggregation over the text posteriors of
all rows. The posterior is their product; a row is rejected if it has no text,
if ``und`` wins, or if the winner has less than ``LEAST`` probability.

How it scales: the texts are read once for the counts and once for their
likelihoods, of which a few numbers a row are kept; everything after that works
on them. A hot host is counted partially before the shuffle and joined as one
row of a small table. The model has a fixed number of buckets for each declared
language, 128 KB of them.

Cases: a text that is null or has no words is rejected; runs of ASCII characters
with digits or an at sign are left out of the evidence, not what stands around
them without a space; a missing declaration, suffix or host
is a value of its own; a table without any declared language has no classes but
``und``, so all rows are rejected; an empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.segments import slices
from corpusloom.sources.tables import staged

#: Hash buckets of trigrams.
BUCKETS = 1 << 15
#: Trigrams overlap, so each counts as a third of an independent one; the prior of ``und``; the least posterior.
TEMPER, UND_PRIOR, LEAST = 1 / 3, 1e-3, 0.5
#: Rows that a parent's distribution counts as, for hosts, domains and categories.
STRENGTH = 20.0
#: Rows whose texts a worker holds at a time.
SLICE = 1000
UND = "und"


#: Runs of ASCII characters with digits or an at sign (numbers, addresses, keys) say nothing about the language.
#: A run is read once from its start, so a text of any length takes linear time; letters of other scripts around it stay.
NOT_WORDS = re.compile(r"(?<![!-~])[!-/:-?A-~]*+[0-9@][!-~]*+")
#: ASCII signs other than letters separate words.
SIGNS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def words_only(text: str | None) -> bytes:
    """The words of a text in lower case, one space between them, as UTF-8; empty if there are none."""
    return b" ".join(NOT_WORDS.sub(" ", text or "").lower().encode().translate(SIGNS).split())


def trigram_codes(words: bytes):
    """The buckets of the byte trigrams of ``words_only``, a space before and after."""
    import numpy as np

    data = np.frombuffer(b" " + words + b" ", dtype=np.uint8).astype(np.uint32)
    code = data[:-2] | data[1:-1] << np.uint32(8) | data[2:] << np.uint32(16)
    return (code * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)


def learn(rows: DataFrame, key: str, text: str, declared: str):
    """(languages, table): log likelihoods by bucket and class, ``und`` last; a column for each declared language whose rows have words."""
    import numpy as np
    import pyarrow as pa

    out = T.StructType([T.StructField("lang", T.StringType()), T.StructField("code", T.IntegerType()), T.StructField("n", T.LongType())])

    def count(batches):
        held: dict = {}
        for batch in slices(batches, SLICE):
            for lang, body in zip(batch.column(0).to_pylist(), map(words_only, (x.as_py() for x in batch.column(1)))):
                if body:
                    held.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))[:] += np.bincount(trigram_codes(body), minlength=BUCKETS)
        for lang, n in held.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=out.names)

    # Every row with a declared language counts.
    told = rows.where(F.col(declared).isNotNull() & (F.col(declared) != "")).select(F.col(declared), F.col(text))
    found = told.mapInArrow(count, out).groupBy("lang", "code").agg(F.sum("n").alias("n"))
    packed = found.groupBy("lang").agg(F.collect_list("code").alias("codes"), F.collect_list("n").alias("ns")).collect()
    langs = sorted(x.lang for x in packed)
    table = np.full((BUCKETS, len(langs) + 1), -np.log(BUCKETS))
    for x in packed:
        n = np.zeros(BUCKETS)
        n[x.codes] = x.ns
        table[:, langs.index(x.lang)] = np.log((n + 0.05) / (n.sum() + 0.05 * BUCKETS))
    return langs, table.astype(np.float32)


def text_evidence(rows: DataFrame, model, text: str = "text") -> DataFrame:
    """``rows`` without ``text``, with loglik (a number for each class, tempered), text_p (the posterior by text alone) and blank."""
    import numpy as np
    import pyarrow as pa

    langs, table = model
    prior = np.log(np.array([*[(1 - UND_PRIOR) / max(1, len(langs))] * len(langs), UND_PRIOR]))
    shared = rows.sparkSession.sparkContext.broadcast(table)
    keep = [c for c in rows.columns if c != text]
    out = T.StructType([*[rows.schema[c] for c in keep], T.StructField("loglik", T.ArrayType(T.DoubleType())), T.StructField("text_p", T.ArrayType(T.DoubleType())), T.StructField("blank", T.BooleanType())])

    def score(batches):
        own = shared.value
        for batch in slices(batches, SLICE):
            logs, blank = [], []
            for body in map(words_only, (x.as_py() for x in batch.column(len(keep)))):
                blank.append(not body)
                logs.append(_total(own, trigram_codes(body)) if body else [0.0] * own.shape[1])
            by_text = _softmax(np.array(logs).reshape(-1, len(prior)) + prior).tolist() if logs else []
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(logs, pa.list_(pa.float64())), pa.array(by_text, pa.list_(pa.float64())), pa.array(blank, pa.bool_())], names=out.names)

    return rows.select(*keep, text).mapInArrow(score, out)


def _total(table, codes) -> list[float]:
    """The tempered sum of the rows of ``codes``, in pieces so that long texts need no more memory."""
    import numpy as np

    total = np.zeros(table.shape[1])
    for at in range(0, len(codes), 1 << 15):
        total += table[codes[at : at + (1 << 15)]].sum(axis=0, dtype=np.float64)
    return (total * TEMPER).tolist()


def _softmax(logs):
    import numpy as np

    raised = np.exp(logs - logs.max(axis=1, keepdims=True))
    return raised / raised.sum(axis=1, keepdims=True)


def _matrix(column, width: int):
    """A column of lists of ``width`` numbers as a matrix."""
    import numpy as np

    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, width)


def fuse(evidence: DataFrame, langs: list[str], declared: str, suffix: str, host: str, domain: str) -> DataFrame:
    """``evidence`` (see ``text_evidence``) with posterior, lang, confidence, text_lang and accepted.

    Counts are grouped aggregation and equi-joins; the products of a row are made by matrices a batch.
    """
    import numpy as np
    import pyarrow as pa

    names, width = [*langs, UND], len(langs) + 1
    sums = F.array(*[F.sum(F.when(F.col("blank"), 0.0).otherwise(F.get("text_p", F.lit(i)))) for i in range(width)])
    mass = F.sum(F.when(F.col("blank"), 0.0).otherwise(1.0))
    whole = evidence.agg(sums.alias("n"), mass.alias("all")).first()  # one row of as many numbers as classes
    total = max(1.0, whole["all"] or 0.0)
    shares = (np.array([x or 0.0 for x in whole["n"]]) + 1.0) / (total + width)
    rows = evidence
    keys = (declared, suffix, host, domain)
    for by in keys:
        counts = evidence.groupBy(F.col(by).alias(f"_{by}_k")).agg(sums.alias(f"_{by}_n"), mass.alias(f"_{by}_all"))
        rows = rows.join(counts, F.col(by).eqNullSafe(F.col(f"_{by}_k")), "left").drop(f"_{by}_k")
    keep = [c for c in evidence.columns if c not in ("loglik", "text_p", "blank", "posterior", "lang", "confidence", "text_lang", "accepted")]
    out = T.StructType([*[evidence.schema[c] for c in keep], T.StructField("posterior", T.ArrayType(T.DoubleType())), T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("text_lang", T.StringType()), T.StructField("accepted", T.BooleanType())])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            of = lambda name: batch.column(batch.schema.get_field_index(name))
            blank = of("blank").to_numpy(zero_copy_only=False)
            text_p = _matrix(of("text_p"), width)
            own = np.where(blank[:, None], 0.0, text_p)
            # What is counted without the row itself.
            n = {by: np.maximum(_matrix(of(f"_{by}_n"), width) - own, 0.0) for by in keys}
            every = {by: of(f"_{by}_all").to_numpy(zero_copy_only=False).astype(np.float64) for by in keys}
            others = {by: np.maximum(every[by] - ~blank, 0.0)[:, None] for by in keys}
            at_domain = (n[domain] + STRENGTH * shares) / (others[domain] + STRENGTH)
            at_host = (n[host] + STRENGTH * at_domain) / (others[host] + STRENGTH)
            logs = _matrix(of("loglik"), width) + np.log(at_host)
            for by in (declared, suffix):  # how likely a class has the value, smoothed by the value's share of all rows
                share = (every[by][:, None] + 1.0) / (total + 1.0)
                logs += np.log((n[by] + STRENGTH * share) / (total * shares + STRENGTH))
            posterior = _softmax(logs)
            best, sure, by_text = posterior.argmax(axis=1), posterior.max(axis=1), text_p.argmax(axis=1)
            ok = ~blank & (best < width - 1) & (sure >= LEAST)
            offsets = pa.array(np.arange(0, (len(best) + 1) * width, width, dtype=np.int32))
            texts = [None if empty else names[i] for i, empty in zip(by_text, blank)]
            yield pa.RecordBatch.from_arrays([*[of(c) for c in keep], pa.ListArray.from_arrays(offsets, pa.array(posterior.reshape(-1))), pa.array([names[i] for i in best], pa.string()), pa.array(sure), pa.array(texts, pa.string()), pa.array(ok)], names=out.names)

    return rows.mapInArrow(run, out)


def identify(rows: DataFrame, key: str, text: str, declared: Column, host: Column, suffix: Column | None = None, domain: Column | None = None) -> DataFrame:
    """(key, declared, suffix, host, domain, posterior, lang, confidence, text_lang, accepted) of every row of ``rows``."""
    empty = F.lit(None).cast("string")
    flat = rows.select(F.col(key), F.col(text).alias("text"), declared.alias("declared"), (empty if suffix is None else suffix).alias("suffix"), host.alias("host"), (empty if domain is None else domain).alias("domain"))
    model = learn(flat, key, "text", "declared")
    scored = staged(text_evidence(flat, model), "langid-evidence")
    return fuse(scored, model[0], "declared", "suffix", "host", "domain")


def identify_documents(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents: ``lang`` is what is declared, ``source`` the host."""
    return identify(docs, key, "text", F.lower(F.col("lang")), F.col("source"))


def identify_pages(pages: DataFrame) -> DataFrame:
    """Pages: the text outside tags, the html element's lang, the address's host, domain and last label."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>", " ")
    declared = F.lower(F.nullif(F.regexp_extract("html", r"(?i)<html[^>]*\blang\s*=\s*[\"']?([a-zA-Z]{2,3})", 1), F.lit("")))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    rows = pages.select("page_id", text.alias("text"), declared.alias("declared"), host.alias("host"))
    return identify(rows, "page_id", "text", F.col("declared"), F.col("host"), F.element_at(F.split("host", r"\."), -1), F.substring_index("host", ".", -2))


def accepted_documents(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose language is accepted; all columns stay as they are.

    A row is known by its id and by a hash of all that its decision rests on, so
    rows with one id or without one are judged apart.
    """
    mark = F.xxhash64("text", "lang", "source")
    gone = identify_documents(docs.select(F.struct(F.col(key).alias("id"), mark.alias("h")).alias("_row"), "text", "lang", "source"), "_row")
    gone = gone.where("not accepted").select(F.col("_row.id").alias("_gone"), F.col("_row.h").alias("_h")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).alias("id"), mark.alias("h"))
    return rows.join(gone, F.col("id").eqNullSafe(F.col("_gone")) & (F.col("h") == F.col("_h")), "left_anti").select("row.*")
