"""Personal data: candidate spans chosen by boosted trees (operator 1, native).

Generators of high recall propose spans, which may overlap: every match of the
four base forms, whether it passes its check or not, key and value pairs that
look like credentials, spelt-out addresses and loose runs of digits. A span's
format and context give ``FEATURES``; gradient boosted trees score it, and a
threshold calibrated on held-out candidates selects. Base spans are always
kept; the model adds those that overlap no base span.

The trees are learnt on the candidates of all documents, counted by label and
features, so what MLlib gets are the different ones with their numbers as
weights. No labelled spans exist, so labels come from evidence that
the features do not hold: a base form counts if its check passes (check sum,
ranges, number of digits, plus sign), a credential if its value has the exact
form of a key (``KEY``), a spelt-out address if it ends in a domain's suffix,
and a loose run of digits if it lies in a confirmed number, that is, if it is
one with its sign or its check withheld. All others are negative, and so are
words of the texts, each at a part of a candidate's weight, and the numbers of a few made-up texts with dates and
amounts (``COUNTER``), whose weight grows with the documents. What the trees accept is thus what has the format
and context of confirmed data, confirmed itself or not. They become a column
expression, so all documents are scored in their own rows by array functions:
no shuffle, no Python.

Cases: a null text is empty; offsets are code points; a text of any length with
any number of matches takes linear time, apart from sorting its spans; without
candidates of both kinds nothing is added to the base spans; the model is the same in reruns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.tables import staged

#: The kinds in order; the last is only proposed by the method.
BASE, KINDS = ("email", "ip", "card", "phone"), ("email", "ip", "card", "phone", "secret")
#: Trees, their depth; the false share allowed among added spans.
TREES, DEPTH, FALSE_SHARE = 10, 3, 0.01
SPAN = "array<struct<start:int,end:int,m:string,left:string,after:string>>"
#: Results of a scan that are put together at a time; characters of a block of text; characters of context.
CHUNK, BLOCK, CONTEXT = 64, 4096, 24

# The base forms. A match may begin where the one before ended or where no
# character of its first class stands before, which is where a leftmost match
# begins anyway; with possessive runs no text takes quadratic time.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Digits joined by single separators, which are first made this mark; fewer than 16 characters can't pass.
MARK = "\x01"
CARD = rf"(?<![0-9{MARK}])[0-9][0-9{MARK}]{{15,}}+"

CREDENTIAL = r"(?:(?i:password|passwd|pwd|secret|token|api[_-]?key)[\"']?\x20?[:=]\x20?[\"']?[^\s\"']{6,}+|\bAKIA[0-9A-Z]{12,}+)"
#: The exact forms of keys that confirm a credential in training.
KEY = r"(?:^|[:=\x20\"'])(?:[0-9a-f]{12,}|AKIA[0-9A-Z]{16}|gh[a-z]_[0-9A-Za-z]{20,}|sk-[0-9A-Za-z]{20,}|eyJ[0-9A-Za-z_.-]{20,})$"
SPELT = r"[A-Za-z0-9._%+-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]{1,63}){1,5}"
LOOSE = r"(?<![0-9A-Za-z])\(?[0-9][0-9().\x20/-]{6,28}[0-9](?![0-9A-Za-z])"
#: Words that are negative examples in training: those that begin a sentence, so many weighing as one candidate.
WORD, WORDS_AS_ONE = r"(?<=[.!?]\s)[^\s]{6,}+", 8
#: Texts with numbers that are not personal data, for training: dates, years, amounts, decimals, counts. They are taken once for so many documents.
COUNTER = ("it was on {y}-{m:02}-{d:02} that", "from {y} - {z} and", "about {d} {n:03} {k:03} of", "the value 3.{n:03}{k:03}{d:02} is", "on {d:02}.{m:02}.{y} they", "no. {y}{n:03}{k:03} was", "{m}/{d}/{y} - {d}/{m}/{z}", "some {d}00 000 000 in", "at {d:02}.{m:02} - {m:02}.{d:02} or", "pages {n:03} - {k:03}, see")
VARIANTS, MADE_FOR = 50, 8000
CUES = r"(?i)(?:mail|phone|tel|call|card|visa|ip|host|addr|passw|secret|key|token|contact)"


def _none() -> Column:
    return F.array().cast(SPAN)


def scan(items: Column, carry: Column, kind: str, step) -> Column:
    """``step(carry, item)`` gives the next carry and an array of results; all results in order, an array of type ``kind``.

    Results are put together in chunks, so that many don't take quadratic time.
    A transform over one element names an array, so that it is made once.
    """
    none = F.array().cast(kind)

    def add(a: Column, x: Column) -> Column:
        held, out = step(a["carry"], x)
        return F.struct(held.alias("carry"), F.concat(a["out"], out).alias("out"))

    def run(own: Column) -> Column:
        def chunk(a: Column, i: Column) -> Column:
            part = F.aggregate(F.slice(own, i * CHUNK + 1, F.lit(CHUNK)), F.struct(a["carry"].alias("carry"), none.alias("out")), add)
            return F.transform(F.array(part), lambda p: F.struct(p["carry"].alias("carry"), F.concat(a["outs"], F.array(p["out"])).alias("outs")))[0]

        chunks = F.sequence(F.lit(0), F.floor((F.size(own) - 1) / CHUNK).cast("int"))
        return F.when(F.size(own) > 0, F.aggregate(chunks, F.struct(carry.alias("carry"), F.array().cast(f"array<{kind}>").alias("outs")), chunk, lambda a: F.flatten(a["outs"]))).otherwise(none)

    return F.transform(F.array(items), run)[0]


def spans(text: Column, pattern: str, worth: Column) -> Column:
    """All matches as (start, end, m, left, after), offsets in code points; ``worth`` says cheaply whether there can be any.

    The gaps between matches and the matches themselves add up to the text, so
    their lengths give the offsets, and the gaps the context on both sides.
    """
    def step(at: Column, x: Column):
        start = at + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["m"]), F.lit(0))
        one = F.struct(start.alias("start"), end.alias("end"), x["m"].alias("m"), F.right(x["gap"], F.lit(CONTEXT)).alias("left"), F.left(F.coalesce(x["next"], F.lit("")), F.lit(1)).alias("after"))
        return end, F.when(x["m"].isNull(), _none()).otherwise(F.array(one))

    def found(gaps: Column) -> Column:
        parts = F.arrays_zip(gaps.alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.slice(gaps, F.lit(2), F.size(gaps)).alias("next"))
        return scan(parts, F.lit(0), SPAN, step)

    return F.when(worth, F.transform(F.array(F.split(text, pattern, -1)), found)[0]).otherwise(_none())


def unplaced(text: Column, pattern: str) -> Column:
    """The matches of ``spans`` without their offsets and what stands after them."""
    one = lambda x: F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), x["m"].alias("m"), F.right(x["gap"], F.lit(CONTEXT)).alias("left"), F.lit("").alias("after"))
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    return F.transform(F.filter(parts, lambda x: x["m"].isNotNull()), one).cast(SPAN)


def overlaps(own: Column, others: Column) -> Column:
    """For each span of ``own`` whether it overlaps one of ``others``: those before it by the furthest end so far, those after it by the nearest start."""
    named = lambda spans, mine: F.transform(spans, lambda x, i: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(mine).alias("mine"), i.alias("i")))
    kind = "array<struct<i:int,hit:boolean>>"

    def result(x: Column, hit: Column) -> Column:
        return F.when(x["mine"], F.array(F.struct(x["i"].alias("i"), hit.alias("hit")))).otherwise(F.array().cast(kind))

    def both(every: Column) -> Column:
        behind = scan(every, F.lit(-1), kind, lambda m, x: (F.when(x["mine"], m).otherwise(F.greatest(m, x["end"])), result(x, m > x["start"])))
        ahead = scan(F.reverse(every), F.lit((1 << 31) - 1), kind, lambda m, x: (F.when(x["mine"], m).otherwise(F.least(m, x["start"])), result(x, m < x["end"])))
        return F.zip_with(F.array_sort(behind), F.array_sort(ahead), lambda a, b: a["hit"] | b["hit"])

    return F.transform(F.array(F.array_sort(F.concat(named(own, True), named(others, False)))), both)[0]


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """Whether the digits of ``m`` pass the check: every second one from the right doubled, 9 taken off above 9."""
    from_right = F.reverse(F.split(_digits(m), ""))
    each = F.transform(F.filter(from_right, lambda d: d != ""), lambda d, i: (F.ascii(d) - 48) * F.when(i % 2 == 1, 2).otherwise(1))
    return F.pmod(F.aggregate(F.transform(each, lambda v: F.when(v > 9, v - 9).otherwise(v)), F.lit(0), lambda a, v: a + v), F.lit(10)) == 0


def octets(m: Column) -> Column:
    """Whether every part is at most 255, leading zeros allowed."""
    return m.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}(?<!\.)$")


def _n(column: Column) -> Column:
    return F.length(_digits(column))


CHECKS = {
    "email": lambda m: F.lit(True),
    "ip": octets,
    "card": lambda m: _n(m).between(16, 19) & luhn(m),
    "phone": lambda m: _n(m).between(8, 15),
}


def with_matches(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with _text, the raw matches of the base forms (_raw_kind) and those that pass (_kind)."""
    rows = docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    body = F.col("_text")
    # Card numbers are sought where separators between digits carry the mark; lengths stay the same.
    marked = F.regexp_replace(F.translate(body, MARK, "x"), r"(?<=[0-9])[\x20-](?=[0-9])", MARK)
    rows = rows.withColumns({
        "_raw_email": spans(body, EMAIL, F.contains(body, F.lit("@"))),
        "_raw_ip": spans(body, IP, body.rlike(r"[0-9]\.[0-9]")),
        "_raw_card": spans(marked, CARD, body.rlike(r"[0-9][0-9\x20-]{14}")),
        "_raw_phone": spans(body, PHONE, F.contains(body, F.lit("+"))),
    })
    passing = lambda k: F.filter(f"_raw_{k}", lambda x: CHECKS[k](x["m"]))
    return rows.withColumns({f"_{k}": passing(k) for k in BASE})


#: What the trees see of a candidate ``c`` = (kind, start, end, m, left, after): nothing of what confirms it in training.
FEATURES = {
    "length": lambda c: F.length(c["m"]),
    "digits": lambda c: _n(c["m"]),
    "capitals": lambda c: F.length(F.regexp_replace(c["m"], "[^A-Z]", "")),
    "separators": lambda c: F.length(F.regexp_replace(c["m"], rf"[^\x20().{MARK}/-]", "")),
    "dots": lambda c: F.length(F.regexp_replace(c["m"], r"[^.]", "")),
    "ats": lambda c: F.length(F.regexp_replace(c["m"], r"[^@\[(]", "")),
    "brackets": lambda c: F.length(F.regexp_replace(c["m"], r"[^()]", "")),
    "pair": lambda c: c["m"].rlike("[:=]").cast("int"),
    "variety": lambda c: F.size(F.array_distinct(F.split(F.left(c["m"], F.lit(200)), ""))),
    "before": lambda c: _class(F.right(c["left"], F.lit(1))),
    "after": lambda c: _class(c["after"]),
    "cue": lambda c: c["left"].rlike(CUES).cast("int"),
}


def _class(sign: Column) -> Column:
    """A neighbouring character: letter, digit, other; none, a blank or the sign of a number are 0."""
    return F.when(sign.rlike("[A-Za-z]"), 1).when(sign.rlike("[0-9]"), 2).when(sign.rlike(r"[^\s+]"), 3).otherwise(0)


#: The generators: where they put their spans, what kind these are.
GENERATORS = {**{f"_raw_{k}": k for k in BASE}, "_credential": "secret", "_spelt": "email", "_loose": "phone"}
CANDIDATE = "array<struct<kind:string,start:int,end:int,m:string,left:string,after:string>>"


def with_generated(rows: DataFrame) -> DataFrame:
    """``rows`` of ``with_matches`` with the spans of the other generators."""
    body = F.col("_text")
    return rows.withColumns({
        "_credential": spans(body, CREDENTIAL, body.rlike(r"(?i)passw|pwd|secret|token|api.?key|AKIA")),
        "_spelt": spans(body, SPELT, F.contains(body, F.lit("(at)")) | F.contains(body, F.lit("[at]"))),
        "_loose": spans(body, LOOSE, body.rlike(r"[0-9][0-9().\x20/-]{6}")),
    })


def _named_as(kind: str, column: str) -> Column:
    return F.transform(column, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["m"].alias("m"), x["left"].alias("left"), x["after"].alias("after"))).cast(CANDIDATE)


def with_candidates(rows: DataFrame) -> DataFrame:
    """``rows`` of ``with_matches`` with _candidates: all proposed spans with their context."""
    return with_generated(rows).withColumn("_candidates", F.concat(*[_named_as(kind, column) for column, kind in GENERATORS.items()])).drop("_credential", "_spelt", "_loose")


def with_labelled(rows: DataFrame) -> DataFrame:
    """``rows`` of ``with_matches`` with _labelled: (c, sure, word) for every candidate and for plain words, see above."""
    rows = with_generated(rows)
    base = F.concat(*[F.transform(f"_{k}", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))) for k in BASE])
    taken = F.concat(base, *[F.transform(c, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))) for c in GENERATORS])
    rows = rows.withColumns({"_base": base, "_taken": taken})
    # Where there is no other span, words need no offsets.
    rows = rows.withColumn("_words", F.when(F.size("_taken") > 0, spans(F.col("_text"), WORD, F.col("_text").rlike(WORD))).otherwise(unplaced(F.col("_text"), WORD)))
    passes = lambda k: F.transform(f"_raw_{k}", lambda x: CHECKS[k](x["m"]))
    sure = {
        **{f"_raw_{k}": passes(k) for k in BASE},
        "_credential": F.transform("_credential", lambda x: x["m"].rlike(KEY)),
        "_spelt": F.transform("_spelt", lambda x: x["m"].rlike(r"(?:\.|[\])]\x20?)[A-Za-z]{2,4}$")),
        "_loose": F.when(F.size("_loose") > 0, overlaps(F.col("_loose"), F.col("_base"))).otherwise(F.array().cast("array<boolean>")),
    }
    each = [F.zip_with(_named_as(kind, column), sure[column], lambda c, s: F.struct(c.alias("c"), s.alias("sure"), F.lit(False).alias("word"))) for column, kind in GENERATORS.items()]
    apart = F.filter(F.zip_with(_named_as("secret", "_words"), overlaps(F.col("_words"), F.col("_taken")), lambda c, hit: F.struct(c.alias("c"), hit.alias("hit"))), lambda x: ~x["hit"])["c"]
    plain = F.transform(F.when((F.size("_taken") > 0) & (F.size("_words") > 0), apart).otherwise(_named_as("secret", "_words")), lambda c: F.struct(c.alias("c"), F.lit(False).alias("sure"), F.lit(True).alias("word")))
    return rows.withColumn("_labelled", F.concat(*each, plain))


def _tree(node, c: dict[str, Column]) -> Column:
    """A learnt tree as nested conditions on the features."""
    if node.getClass().getSimpleName() == "LeafNode":
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(c[list(FEATURES)[split.featureIndex()]] <= float(split.threshold()), _tree(node.leftChild(), c)).otherwise(_tree(node.rightChild(), c))


class Model:
    """Learnt trees and the threshold that selects."""

    def __init__(self, trees, weights, threshold: float):
        self.trees, self.weights, self.threshold = trees, weights, threshold

    def score(self, f: dict[str, Column]) -> Column:
        margin = reduce(lambda a, b: a + b, [_tree(t, f) * F.lit(float(w)) for t, w in zip(self.trees, self.weights)])
        return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * margin))


def examples(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(label, held, word, made, features, n): how many candidates of all rows of ``docs`` have these features.

    Made-up texts are counted beside them (``made``). Rows with an id are held out, or not, as a whole.
    """
    own = docs.select(F.col(key).alias("_key"), F.col(text).alias("_own"), F.lit(False).alias("made"))
    shown = [(-1 - i, form.format(y=1900 + 7 * v % 130, z=1950 + 11 * v % 80, m=1 + v % 12, d=1 + v % 28, n=v * 37 % 1000, k=v * 101 % 1000), True) for i, (form, v) in enumerate((f, v) for f in COUNTER for v in range(VARIANTS))]
    counter = docs.sparkSession.createDataFrame(shown, "_key long, _own string, made boolean").withColumn("_key", F.col("_key").cast(own.schema["_key"].dataType))
    some = with_labelled(with_matches(own.unionByName(counter), "_own"))
    # Before an inner explode Spark asks whether there is anything, and finds all of it twice.
    one = some.select((F.pmod(F.xxhash64(F.lit(12), "_key"), F.lit(3)) == 0).alias("held"), "made", F.explode_outer("_labelled").alias("x")).where("x is not null")
    one = one.select("held", "made", F.col("x.sure").cast("double").alias("label"), F.col("x.word").alias("word"), *[f(F.col("x.c")).cast("double").alias(name) for name, f in FEATURES.items()])
    return one.groupBy("label", "held", "word", "made", *FEATURES).agg(F.count("*").alias("n"))


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Model | None:
    """Trees and threshold from all rows of ``docs``; None without candidates of both kinds."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    # Words and made-up texts weigh the same beside the candidates whatever the number of documents.
    share = max(1.0, docs.count() / MADE_FOR)
    weight = F.col("n") * F.when(F.col("made"), share).otherwise(1.0) / F.when(F.col("word"), float(WORDS_AS_ONE)).otherwise(1.0)
    columns = ["label", "held", "word", "made", *FEATURES]
    one = staged(examples(docs, key, text).withColumn("weight", weight).repartition(4).sortWithinPartitions(*columns), "pii-candidates")
    counts = {(x.label, x.held): x["count"] for x in one.groupBy("label", "held").count().collect()}
    if not all(counts.get((label, held)) for label in (0.0, 1.0) for held in (False, True)):
        return None
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(one.where("not held"))
    learnt = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=5, maxBins=32, weightCol="weight").fit(vectors)
    model = Model([t._java_obj.rootNode() for t in learnt.trees], learnt.treeWeights, 1.0)
    # The lowest threshold above which false ones are few enough among those held out; a hundred bins go to the driver.
    binned = one.where("held").select(F.floor(model.score({name: F.col(name) for name in FEATURES}) * 100).alias("bin"), "label", "weight").groupBy("bin").agg(F.sum(F.col("label") * F.col("weight")).alias("true"), F.sum("weight").alias("n"))
    true = false = 0
    for x in sorted(binned.collect(), key=lambda x: -x.bin):
        true, false = true + x.true, false + x.n - x.true
        if false + 1 > FALSE_SHARE * (true + false + 1) and false:
            break
        model.threshold = x.bin / 100
    return model


def detect(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with _text, the base spans _email, _ip, _card, _phone, and _found: all spans (kind, start, end) by kind, then start."""
    rows = with_matches(docs, text)
    of = lambda i, k: F.transform(f"_{k}", lambda x: F.struct(F.lit(i).alias("i"), x["start"].alias("start"), x["end"].alias("end")))
    rows = rows.withColumn("_base", F.concat(*[of(i, k) for i, k in enumerate(BASE)]))
    if model is None:
        return rows.withColumn("_found", F.array_sort("_base"))
    rows = with_candidates(rows)
    apart = F.filter(F.zip_with("_candidates", overlaps(F.col("_candidates"), F.col("_base")), lambda c, hit: F.struct(c.alias("c"), hit.alias("hit"))), lambda x: ~x["hit"])["c"]
    rows = rows.withColumn("_candidates", F.when(F.size("_candidates") > 0, apart).otherwise(F.col("_candidates")))
    # Features are made once a candidate, then scored.
    featured = F.transform("_candidates", lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), *[f(c).cast("double").alias(name) for name, f in FEATURES.items()]))
    rows = rows.withColumn("_featured", featured)
    chosen = F.filter("_featured", lambda c: model.score({name: c[name] for name in FEATURES}) >= model.threshold)
    rank = lambda c: reduce(lambda a, k: F.when(c["kind"] == k[1], k[0]).otherwise(a), enumerate(KINDS), F.lit(9))
    added = F.transform(chosen, lambda c: F.struct(rank(c).alias("i"), c["start"].alias("start"), c["end"].alias("end")))
    return rows.withColumn("_added", F.array_sort(F.array_distinct(added))).withColumn("_found", F.array_sort(F.concat("_base", "_added")))


def _named(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["i"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans, n_secret) of every row of ``docs``."""
    rows = detect(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), learn(docs, key, text))
    secrets = F.size(F.filter("_found", lambda x: x["i"] == KINDS.index("secret"))).cast("long")
    return rows.select("doc_id", *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in BASE], F.sha2(_named(F.array_sort("_base")), 256).alias("base_sha256"), _named(F.col("_found")).alias("spans"), F.size("_found").cast("long").alias("n_spans"), secrets.alias("n_secret"))


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every found span replaced by its kind in brackets; overlapping spans become the first one's. A null text stays null.

    The text is cut in blocks once, so that what stands between spans is found
    without counting from its start each time.
    """
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).alias("doc_id"), F.col(text).alias("text"))
    rows = detect(packed, learn(docs, key, text))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    by_start = F.array_sort(F.transform("_found", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["i"].alias("i"))))
    closed = F.array_append(by_start, F.struct(F.length("_text").alias("start"), F.length("_text").alias("end"), F.lit(-1).alias("i")))

    def put(blocks: Column) -> Column:
        def between(a: Column, b: Column) -> Column:
            i, j = F.floor(a / BLOCK).cast("int"), F.floor(b / BLOCK).cast("int")
            head = F.substring(F.get(blocks, i), F.pmod(a, F.lit(BLOCK)) + 1, F.when(i == j, b - a).otherwise(F.lit(BLOCK)))
            rest = F.concat(F.array_join(F.slice(blocks, i + 2, j - i - 1), ""), F.coalesce(F.substring(F.get(blocks, j), F.lit(1), F.pmod(b, F.lit(BLOCK))), F.lit("")))
            return F.when(b <= a, F.lit("")).when(i == j, head).otherwise(F.concat(head, rest))

        def step(at: Column, x: Column):
            apart = x["start"] >= at
            out = F.array(between(at, x["start"]), F.coalesce(F.get(names, x["i"]), F.lit("")))
            return F.greatest(at, x["end"]), F.when(apart, out).otherwise(F.array().cast("array<string>"))

        return F.array_join(scan(closed, F.lit(0), "array<string>", step), "")

    redacted = F.transform(F.array(F.regexp_extract_all("_text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))), put)[0]
    out = F.when(F.col("text").isNull(), F.lit(None).cast("string")).when(F.size("_found") == 0, F.col("_text")).otherwise(redacted)
    return rows.select(F.col("row").withField(text, out).alias("row")).select("row.*")
