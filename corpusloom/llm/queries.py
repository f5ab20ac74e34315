"""The numbered queries with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.tables import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import pii

    return pii.report(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from corpusloom.llm import bpe

    return bpe.token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import html

    return html.main_texts(table(spark, sf_dir, "pages"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import langid

    found = langid.identify_documents(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "lang", F.round("confidence", 6).alias("confidence"), "text_lang", "declared", "accepted")


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator with markup and address as evidence."""
    from corpusloom.llm import langid

    found = langid.identify_pages(table(spark, sf_dir, "pages"))
    return found.select("page_id", "lang", F.round("confidence", 6).alias("confidence"), "text_lang", "declared", "suffix", "host", "accepted")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import warc

    folder = warc.pages_to_warc(table(spark, sf_dir, "pages"))
    return warc.read_warc(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import quality

    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("rejected_by", ",").alias("rejected_by"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import mix

    mixed = mix.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from corpusloom.llm import tokencount

    return tokencount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import ngramjoin

    return ngramjoin.classes(table(spark, sf_dir, "documents"))


def op10_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import imatch

    return imatch.fingerprint_report(table(spark, sf_dir, "documents"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import toxicity

    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import centroids

    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import collocations

    return collocations.mine(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_pii, op2_byte_bpe, op3_html_main_text, op4_language_id, op5_warc, op6_quality_rules, op7_mix_sources, op8_token_counts, op9_ngram_jaccard, op10_imatch, op11_toxicity, op12_centroids, op13_collocations, language_id_pages)}


def oracle_sql() -> dict[str, str]:
    """The other queries rest on hashes, learnt models or vocabularies; tests hold them against plain versions."""
    from corpusloom.llm import oracles

    return {"op3_html_main_text": oracles.OP3, "op5_warc": oracles.OP5, "op6_quality_rules": oracles.OP6, "op9_ngram_jaccard": oracles.OP9, "op12_centroids": oracles.OP12, "op13_collocations": oracles.OP13}
