"""Search and the term index over the corpus."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusloom.operators import grep as G
from corpusloom.operators import index as I
from corpusloom.operators import many as M
from corpusloom.operators import results as R
from corpusloom.operators import segments as S
from corpusloom.operators import trigrams as T
from corpusloom.plans.corpus_queries import EXCLUDED, GLOBS, IGNORED, the_rules
from corpusloom.plans.registry import CORPUS, LINES, POSTINGS, hits, query
from corpusloom.sources import corpus as C
from corpusloom.sources.tables import shared_dir, staged, table

PATTERN, SENSITIVE = "licen[sc]e", "The[a-z]+"
HITS = LINES + ",\n" + hits("(?i)" + PATTERN)


def _corpus(spark, sf_dir):
    return C.scan_corpus(spark, sf_dir)


@query("f5_smart_case", rf"WITH {LINES} SELECT 'license' AS pattern, count(*) AS n FROM lines WHERE regexp_matches(text, '(?i)license') UNION ALL SELECT 'License', count(*) FROM lines WHERE regexp_matches(text, 'License') UNION ALL SELECT '\S+ing\W', count(*) FROM lines WHERE regexp_matches(text, '(?i)\S+ing\W')")
def f5(spark, sf_dir):
    lines = C.numbered_lines(_corpus(spark, sf_dir))
    count = lambda p: G.match_lines(lines, p).agg(F.count("*").alias("n")).select(F.lit(p).alias("pattern"), "n")
    # An upper-case letter that belongs to an escape doesn't count as one, so the third pattern ignores case.
    return count("license").unionByName(count("License")).unionByName(count(r"\S+ing\W"))


@query("f6_match_lines", f"WITH {LINES} SELECT * FROM lines WHERE regexp_matches(text, '(?i){PATTERN}')")
def f6(spark, sf_dir):
    return G.match_lines(C.numbered_lines(_corpus(spark, sf_dir)), PATTERN)


@query("f8_scope_results", f"WITH {HITS} SELECT 'one' AS scope, path, line, col FROM hits WHERE path = (SELECT min(path) FROM hits) UNION ALL SELECT 'all', path, line, col FROM hits")
def f8(spark, sf_dir):
    found = staged(G.grep(_corpus(spark, sf_dir), PATTERN).select("path", "line", "col"), "hits")
    first = found.select(F.min("path")).scalar()
    pick = lambda scope, path: R.scope_results(found, path).select(F.lit(scope).alias("scope"), "path", "line", "col")
    return pick("one", first).unionByName(pick("all", None))


@query("g1_grep", f"WITH {HITS} SELECT * FROM hits")
def g1(spark, sf_dir):
    return G.grep(_corpus(spark, sf_dir), PATTERN)


@query("g1_grep_multibyte", f"WITH {LINES},\n{hits(SENSITIVE)} SELECT * FROM hits")
def g1b(spark, sf_dir):
    return G.grep(_corpus(spark, sf_dir), SENSITIVE)


@query("g2_grep_many", f"WITH {LINES},\n{hits('(?i)' + PATTERN, name='a')},\n{hits(SENSITIVE, name='b')},\n{hits('(?i)[a-z]+@mail[0-9]', name='c')} SELECT *, '{PATTERN}' AS pattern FROM a UNION ALL SELECT *, '{SENSITIVE}' FROM b UNION ALL SELECT *, '[a-z]+@mail[0-9]' FROM c")
def g2(spark, sf_dir):
    return G.grep_many(_corpus(spark, sf_dir), [PATTERN, SENSITIVE, "[a-z]+@mail[0-9]", ""])


@query("g2_grep_table", rf"""WITH {LINES}, p AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{{6,}}')) AS w FROM benchmark),
m AS (SELECT l.*, w || '(?:[a-z]*|, )' AS pattern FROM lines l JOIN p ON contains(lower(l.text), w))
SELECT origin, path, line, unnest(list_transform(range(1, len(ms) + 1), lambda i: 1 + coalesce(list_sum(list_transform(gaps[1:i], lambda g: strlen(g))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda m: strlen(m))), 0)))::INT AS col, unnest(ms) AS match, text, pattern
FROM (SELECT *, string_split_regex(text, '(?i)' || pattern) AS gaps, regexp_extract_all(text, '(?i)' || pattern) AS ms FROM m WHERE regexp_matches(text, '(?i)' || pattern))""")
def g2b(spark, sf_dir):
    """Hundreds of patterns, one for each longer word of the benchmark's items."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0))).alias("w")).distinct()
    return M.grep_table(_corpus(spark, sf_dir), words.select(F.concat("w", F.lit("(?:[a-z]*|, )")).alias("pattern")))


INDEXED = f"WITH {CORPUS}, kept AS (SELECT * FROM corpus WHERE starts_with(rel_path, 'en/')), "


@query("g3_grep_indexed", f"WITH {HITS} SELECT * FROM hits WHERE starts_with(path, 'en/')")
def g3(spark, sf_dir):
    files = _corpus(spark, sf_dir)
    return G.grep_indexed(files, C.restrict_paths(files, ["en"]), PATTERN)


@query("g3_grep_trigram", f"WITH {HITS} SELECT * FROM hits")
def g3b(spark, sf_dir):
    folder = f"{shared_dir(spark)}/trigrams/{uuid.uuid4().hex}"
    T.write_index(_corpus(spark, sf_dir), folder)
    return T.grep(spark, folder, PATTERN)


@query("g3_grep_trigram_rare", f"WITH {LINES},\n{hits('(?i)(?:apache|mozilla(?: public)?) license, v')} SELECT * FROM hits")
def g3c(spark, sf_dir):
    folder = f"{shared_dir(spark)}/trigrams/{uuid.uuid4().hex}"
    T.write_index(_corpus(spark, sf_dir), folder)
    return T.grep(spark, folder, "(?:apache|mozilla(?: public)?) license, v")


@query("g4_grep_excluding", f"WITH {HITS}, ok AS (SELECT DISTINCT origin, rel_path FROM corpus WHERE NOT ({IGNORED}) AND NOT ({EXCLUDED})) SELECT h.* FROM hits h JOIN ok ON h.origin = ok.origin AND h.path = ok.rel_path")
def g4(spark, sf_dir):
    return G.grep_excluding(_corpus(spark, sf_dir), PATTERN, GLOBS, the_rules(spark))


@query("g5_hit_counts", f"WITH {LINES},\n{hits('(?i)the')} SELECT origin, path, count(*) AS n_hits FROM hits GROUP BY ALL")
def g5(spark, sf_dir):
    return G.hit_counts(G.grep(_corpus(spark, sf_dir), "the"), "origin", "path")


@query("grep_hit_counts", f"WITH {LINES},\n{hits('(?i)the')} SELECT origin, count(*) AS n_hits FROM hits GROUP BY ALL")
def flagship(spark, sf_dir):
    return G.hit_counts(G.grep(_corpus(spark, sf_dir), "the"), "origin")


@query("g6_titled", f"WITH {HITS} SELECT path, line, col, 'grep: {PATTERN}' AS title FROM hits")
def g6(spark, sf_dir):
    return G.titled(G.grep(_corpus(spark, sf_dir), PATTERN), "grep", PATTERN).select("path", "line", "col", "title")


def term_index(spark, files):
    """The segmented index of the files, built in the shared folder."""
    folder = f"{shared_dir(spark)}/terms/{uuid.uuid4().hex}"
    S.refresh(spark, folder, files)
    return S.TermIndex(spark, folder)


def _fuzzy_sql(source: str, column: str, query: str, k: int) -> str:
    form = "(?i)" + ".*?".join(query)
    return f"SELECT {column}, length(regexp_extract({column}, '{form}')) AS span FROM {source} WHERE regexp_extract({column}, '{form}') <> '' ORDER BY span, length({column}), {column} LIMIT {k}"


@query("g7_find_files", f"WITH {CORPUS}, ok AS (SELECT DISTINCT rel_path FROM corpus WHERE NOT ({IGNORED})) {_fuzzy_sql('ok', 'rel_path', 'esr12', 25)}")
def g7(spark, sf_dir):
    from corpusloom.operators.rules import apply_ignore

    files = apply_ignore(_corpus(spark, sf_dir).select("origin", "rel_path"), the_rules(spark)).select("rel_path").distinct()
    return R.fuzzy_topk(files, "rel_path", "esr12", 25)


@query("i1_build_postings", f"WITH {POSTINGS} SELECT * FROM postings")
def i1(spark, sf_dir):
    return I.build_postings(_corpus(spark, sf_dir))


@query("i1_block_postings", f"WITH {POSTINGS} SELECT * FROM postings")
def i1c(spark, sf_dir):
    return term_index(spark, _corpus(spark, sf_dir)).postings()


@query("i1_stored_postings", f"WITH {POSTINGS} SELECT term, count(*) AS n, min(path) AS first_path FROM postings GROUP BY term")
def i1b(spark, sf_dir):
    folder = f"{shared_dir(spark)}/postings/{uuid.uuid4().hex}"
    I.write_postings(I.build_postings(_corpus(spark, sf_dir)), folder)
    return spark.read.parquet(folder).groupBy("term").agg(F.count("*").alias("n"), F.min("path").alias("first_path"))


@query("i2_find_references", f"WITH {POSTINGS} SELECT DISTINCT l.origin, l.path, l.line, 1 AS col, l.text FROM lines l JOIN postings p ON l.origin = p.origin AND l.path = p.path AND l.line = p.line WHERE p.term = 'that'")
def i2(spark, sf_dir):
    return I.references(_corpus(spark, sf_dir), "that").distinct()


@query("i2_stored_references", f"WITH {POSTINGS} SELECT DISTINCT l.origin, l.path, l.line, 1 AS col, l.text FROM lines l JOIN postings p ON l.origin = p.origin AND l.path = p.path AND l.line = p.line WHERE p.term = 'that'")
def i2b(spark, sf_dir):
    files = _corpus(spark, sf_dir)
    return I.indexed_references(term_index(spark, files), files, "that").distinct()


DEF = rf"""WITH {LINES}, d AS (SELECT CASE WHEN regexp_extract(text, '<h1>\s*([\p{{L}}_][\p{{L}}\p{{N}}_]*)', 1) <> '' THEN 'heading' ELSE 'opening' END AS kind,
  CASE WHEN regexp_extract(text, '<h1>\s*([\p{{L}}_][\p{{L}}\p{{N}}_]*)', 1) <> '' THEN regexp_extract(text, '<h1>\s*([\p{{L}}_][\p{{L}}\p{{N}}_]*)', 1) ELSE regexp_extract(text, '^([\p{{L}}_][\p{{L}}\p{{N}}_]*)', 1) END AS term, origin, path, line FROM lines)
SELECT term, kind, origin, path, line FROM d WHERE term <> ''"""


@query("i3_definitions", DEF)
def i3(spark, sf_dir):
    return I.definitions(_corpus(spark, sf_dir))


@query("i3_find_definitions", DEF + " AND term = 'The'")
def i3b(spark, sf_dir):
    return I.find_definitions(_corpus(spark, sf_dir), "The")


SUFFIX = r"regexp_extract(path, '\.([^./]*)$', 1)"
BY_SUFFIX = rf"""WITH {LINES}, d AS (SELECT *, CASE WHEN {SUFFIX} = 'txt' THEN [{{'kind': 'label', 'term': regexp_extract(text, '^([\p{{L}}_][\p{{L}}\p{{N}}_]*):\s', 1)}}]
  WHEN {SUFFIX} IN ('html', 'htm', '') THEN [{{'kind': 'title', 'term': regexp_extract(text, '<title>\s*([\p{{L}}_][\p{{L}}\p{{N}}_]*)', 1)}}, {{'kind': 'heading', 'term': regexp_extract(text, '<h[1-6][^>]*>\s*([\p{{L}}_][\p{{L}}\p{{N}}_]*)', 1)}}, {{'kind': 'anchor', 'term': regexp_extract(text, '\sid="([\p{{L}}_][\p{{L}}\p{{N}}_]*)"', 1)}}] END AS ds FROM lines),
f AS (SELECT origin, path, line, list_filter(ds, lambda x: x.term <> '')[1] AS d FROM d WHERE ds IS NOT NULL)
SELECT d.term AS term, d.kind AS kind, origin, path, line FROM f WHERE d IS NOT NULL"""


@query("i3_definitions_by_suffix", BY_SUFFIX)
def i3c(spark, sf_dir):
    return I.definitions_by_suffix(_corpus(spark, sf_dir))


@query("i4_document_symbols", f"WITH {POSTINGS} SELECT origin, path, term, min(line) AS line FROM postings GROUP BY ALL")
def i4(spark, sf_dir):
    return term_index(spark, _corpus(spark, sf_dir)).symbols()


@query("i5_workspace_symbols", f"WITH {POSTINGS}, t AS (SELECT DISTINCT term FROM postings) {_fuzzy_sql('t', 'term', 'licn', 20)}")
def i5(spark, sf_dir):
    return I.workspace_symbols(term_index(spark, _corpus(spark, sf_dir)).terms(), "licn", 20)


@query("i6_path_dictionary", f"WITH {CORPUS} SELECT DISTINCT sha1(origin || ':' || rel_path) AS path_id, origin, rel_path AS path FROM corpus")
def i6(spark, sf_dir):
    return I.path_dictionary(_corpus(spark, sf_dir))


STALE = """SELECT user_id, max(ts) FILTER (event_type = 'view') AS source_ts, max(ts) FILTER (event_type = 'purchase') AS artifact_ts,
  (max(ts) FILTER (event_type = 'purchase') IS NULL OR date_trunc('second', max(ts) FILTER (event_type = 'purchase')) < date_trunc('second', max(ts) FILTER (event_type = 'view'))) AS stale
FROM events GROUP BY user_id HAVING max(ts) FILTER (event_type = 'view') IS NOT NULL"""


@query("i7_stale_artifacts", STALE)
def i7(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    last = lambda kind, name: events.where(F.col("event_type") == kind).groupBy("user_id").agg(F.max("ts").alias(name))
    rows = I.stale_artifacts(last("view", "source_ts"), last("purchase", "artifact_ts"), "user_id")
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("source_ts", "artifact_ts")})


@query("i8_refresh_index")
def i8(spark, sf_dir):
    folder = f"{shared_dir(spark)}/postings/{uuid.uuid4().hex}"
    files = _corpus(spark, sf_dir)
    first = I.refresh_index(spark, files, folder).withColumn("turn", F.lit(1))
    again = I.refresh_index(spark, files, folder, changed=["engine"]).withColumn("turn", F.lit(2))
    n = spark.read.option("recursiveFileLookup", True).parquet(folder).groupBy("origin").agg(F.count("*").alias("n_postings"))
    return first.unionByName(again).join(n, "origin", "left")


@query("i8_incremental_index", f"WITH {POSTINGS} SELECT * FROM postings")
def i8b(spark, sf_dir):
    """An index of an older state of the corpus brought up to date: files added, changed and gone, then the segments merged."""
    files, folder = _corpus(spark, sf_dir), f"{shared_dir(spark)}/terms/{uuid.uuid4().hex}"
    seven = F.pmod(F.xxhash64("rel_path"), F.lit(7))
    older = files.where(seven != 0).withColumn("text", F.when(seven == 1, F.concat(F.lit("older "), "text")).otherwise(F.col("text")))
    left = files.where(seven == 2).withColumn("rel_path", F.concat("rel_path", F.lit(".old")))
    S.refresh(spark, folder, older.unionByName(left))
    S.refresh(spark, folder, files)
    S.merge(spark, folder)
    return S.TermIndex(spark, folder).postings()


@query("i9_rewrite_symbol", rf"WITH {CORPUS} SELECT origin, rel_path, md5(regexp_replace(regexp_replace(text, '(^|[^\p{{L}}\p{{N}}_])that($|[^\p{{L}}\p{{N}}_])', '\1permit\2', 'g'), '(^|[^\p{{L}}\p{{N}}_])that($|[^\p{{L}}\p{{N}}_])', '\1permit\2', 'g')) AS digest FROM corpus WHERE regexp_matches(text, '(^|[^\p{{L}}\p{{N}}_])that($|[^\p{{L}}\p{{N}}_])')")
def i9(spark, sf_dir):
    return I.rewrite_symbol(_corpus(spark, sf_dir), "that", "permit").select("origin", "rel_path", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("c18_word_at", f"WITH {POSTINGS}, c AS (SELECT DISTINCT origin || ':' || path AS path, line, x::INT AS pos FROM lines, (SELECT unnest([1, 5, 12]) AS x) a) SELECT c.path, c.line, c.pos AS at, p.term FROM c LEFT JOIN (SELECT DISTINCT origin || ':' || path AS path, line, col, term FROM postings) p ON c.path = p.path AND c.line = p.line AND p.col <= c.pos AND c.pos < p.col + strlen(p.term)")
def c18(spark, sf_dir):
    files = _corpus(spark, sf_dir).withColumn("rel_path", F.concat_ws(":", "origin", "rel_path"))
    cursor = C.numbered_lines(files).select("path", "line").distinct().withColumn("at", F.explode(F.array(F.lit(1), F.lit(5), F.lit(12))))
    # The cursors are in all files, so all of the index is decoded; for few, of_paths decodes their blocks alone.
    return I.word_at(term_index(spark, files).postings().distinct(), cursor)
