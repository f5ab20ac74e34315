"""Operator 1 against a plain search."""

import hashlib
import re
import time

from pyspark.sql import functions as F

from corpusloom.llm import pii

FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def passes(kind, m):
    digits = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": all(int(x) <= 255 for x in m.split(".")) if kind == "ip" else True, "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]


def plain(text):
    return [(kind, m.start(), m.end()) for kind, form in FORMS.items() for m in re.finditer(form, text or "") if passes(kind, m[0])]


HARD = [
    "a@b.c_d@e.f g@h", "x.y%z+1-2@host-1.a.b.c. next", "1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.255 1.2.3.256", "4111 1111 1111 1111 and 4111-1111-1111-1112", "4111  1111 1111 1111", "1 " * 400 + "4111111111111111",
    "+1 (972) 555-8257 +12 3 +1234567890123456 ++49 30 1234567", "é\U0001f600 a@b.co é 10.0.0.1", "4111\x011111 4111111111111111\x01", "9" * 3000, "a" * 3000 + "@b.c", "@@ a@ @b.c a@b..c", None, "",
]


def check(rows, texts):
    for r in rows:
        want = plain(texts[r.doc_id])
        assert {k: getattr(r, f"n_{k}") for k in FORMS} == {k: sum(x[0] == k for x in want) for k in FORMS}, texts[r.doc_id]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        found = r.spans.split(",") if r.spans else []
        assert set(joined.split(",") if joined else []) <= set(found)
        order = [(pii.KINDS.index(x.split(":")[0]), int(x.split(":")[1])) for x in found]
        assert order == sorted(order)


def test_hard_texts(spark):
    texts = dict(enumerate(HARD))
    check(pii.report(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect(), texts)


def test_every_document(docs, local_docs):
    rows = pii.report(docs).collect()
    assert len(rows) == len(local_docs)
    check(rows, {i: r.text for i, r in local_docs.items()})


def test_model_adds_credentials_and_leaves_plain_words(spark, docs):
    model = pii.learn(docs)
    texts = [(1, "words password=29e5b7d2b3fc74d679 words"), (2, "the words of this text are plain and clean")]
    rows = {r.doc_id: r._found for r in pii.detect(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    assert rows[2] == []
    assert model is None or all(x.i == pii.KINDS.index("secret") for x in rows[1])


def test_words_without_evidence_are_left_alone(spark, docs):
    """A word behind a cue and a date are no secret and no number; a whole long key is one span."""
    model = pii.learn(docs)
    key = "0123456789abcdef" * 12
    texts = [(1, "the password = required here and 2023-10-11 there"), (2, f"token: {key} end")]
    rows = {r.doc_id: r._found for r in pii.detect(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    assert rows[1] == [] and all(x.end - x.start >= len(key) for x in rows[2])


def test_long_texts_with_many_spans(spark):
    """Megabytes of log lines, and of one run, in seconds; what stands between spans is kept."""
    line = "10.0.0.{} said a{}@b.example.com or +1 (415) 555-{:04d} at ä\U0001f600 once\n"
    log = "".join(line.format(i % 250, i, i % 10000) for i in range(4000))
    texts = [(1, log), (2, "語" * 400_000), (3, "x" * 400_000), (4, "7" * 400_000), (5, "1-" * 200_000)]
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    began = time.time()
    rows = pii.report(frame).collect()
    check([r for r in rows if r.doc_id == 1], dict(texts))
    assert not any(r.n_email + r.n_ip + r.n_card + r.n_phone for r in rows if r.doc_id > 1)
    got = {r.doc_id: r.text for r in pii.redact(frame).collect()}
    want = re.sub(FORMS["phone"], "[PHONE]", re.sub(FORMS["email"], "[EMAIL]", re.sub(FORMS["ip"], "[IP]", log)))
    assert got[1] == want and got[2] == texts[1][1] and time.time() - began < 240


def test_redaction(spark, odd, none):
    got = {r.doc_id: r for r in pii.redact(odd).collect()}
    assert got[5].text == "Mail [EMAIL] or [PHONE] now." and got[1].text is None and got[2].text == ""
    assert got[4]._text == "x" and got[4].row == "y" and pii.redact(odd).columns == odd.columns
    assert pii.redact(none).count() == 0 and pii.report(none).count() == 0


def test_the_trees_are_learnt_on_every_row(spark):
    """Keys stand in rows alone that a draw of about 8,000 of the 20,000 by their ids leaves out."""
    drawn = F.pmod(F.xxhash64(F.lit(11), F.col("doc_id")), F.lit(1 << 30)) < int(8000 / 20000 * (1 << 30))
    text = F.when(drawn, "some words here, no key: 2023-10-11 to 2024-10-11").otherwise(F.concat(F.lit("words password="), F.translate(F.left(F.sha2(F.col("doc_id").cast("string"), 256), F.lit(18)), "0123456789", "abcdefabcd"), F.lit(" words")))
    docs = spark.range(20000).select(F.col("id").alias("doc_id")).withColumn("text", text)
    model = pii.learn(docs)
    assert model is not None
    rows = pii.detect(docs, model).select(drawn.alias("drawn"), F.size("_found").alias("n")).groupBy("drawn", "n").count().collect()
    assert {(r.drawn, r.n) for r in rows} == {(True, 0), (False, 1)}
    assert pii.examples(docs).where("not made and label = 1").agg(F.sum("n")).first()[0] == docs.where(~drawn).count()
