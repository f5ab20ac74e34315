"""Scans, the stored index, ignore rules and path helpers over the corpus."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import paths
from corpusloom.operators import ordered_rules, rules
from corpusloom.plans.registry import CORPUS, EXT, IS_CODE, LINES, query
from corpusloom.sources import corpus as C
from corpusloom.sources import trees
from corpusloom.sources.tables import shared_dir, table

#: Files that the rules of the queries ignore; the engine's user rules are missing, so its defaults hold.
PROJECT_RULES = "// own\nsrc3\nen\\src1\n*r17\n\n"
ENGINE_RULES = "// defaults\nen\nthther.example.org\\fr\n"
GLOBS = ("**/src5/**", "de/*/1?.txt", "*.example.org/**")
DROPPED = ("/src1[0-2]/", "^blog\\.")


def the_rules(spark: SparkSession) -> DataFrame:
    user = rules.parse_rules(spark, C.PROJECT, PROJECT_RULES)
    defaults = rules.parse_rules(spark, C.ENGINE, ENGINE_RULES).unionByName(rules.parse_rules(spark, C.PROJECT, "src0"))
    return rules.effective_rules(user, defaults)


IGNORED = r"""CASE WHEN origin = 'project' THEN list_contains(string_split(rel_path, '/'), 'src3') OR rel_path = 'en/src1' OR starts_with(rel_path, 'en/src1/') OR len(list_filter(string_split(rel_path, '/'), lambda x: regexp_matches(x, '^[^/]*r17$'))) > 0
  ELSE list_contains(string_split(rel_path, '/'), 'en') OR rel_path = 'thther.example.org/fr' OR starts_with(rel_path, 'thther.example.org/fr/') END"""


@query("s1_scan_corpus", f"WITH {CORPUS} SELECT origin, root, rel_path, strlen(text)::INT AS n_bytes, md5(text) AS digest FROM corpus")
def s1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.scan_corpus(spark, sf_dir).select("origin", "root", "rel_path", F.octet_length("text").alias("n_bytes"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query("s2_restrict_paths", f"WITH {CORPUS} SELECT origin, rel_path FROM corpus WHERE starts_with(rel_path, 'en/src1/') OR starts_with(rel_path, 'fr/') OR starts_with(rel_path, 'thther.example.org/en/')")
def s2(spark, sf_dir):
    return C.restrict_paths(C.scan_corpus(spark, sf_dir), ["en/src1", "fr/", "thther.example.org/en"]).select("origin", "rel_path")


@query("s3_union_roots", f"WITH {CORPUS} SELECT origin, root, count(*) AS n FROM corpus GROUP BY ALL")
def s3(spark, sf_dir):
    return C.union_roots(C.project_files(spark, sf_dir), C.engine_files(spark, sf_dir)).groupBy("origin", "root").agg(F.count("*").alias("n"))


@query("s3_union_roots_fallback", "SELECT 'project' AS origin, count(*) AS n FROM documents")
def s3b(spark, sf_dir):
    project = C.project_files(spark, sf_dir)
    return C.union_roots(project, None, fallback=project).groupBy("origin").agg(F.count("*").alias("n"))


@query("s4_with_abs_path", f"WITH {CORPUS} SELECT origin, rel_path, root || '/' || replace(rel_path, '\\', '/') AS abs_path FROM corpus")
def s4(spark, sf_dir):
    return C.with_abs_path(C.scan_corpus(spark, sf_dir)).select("origin", "rel_path", "abs_path")


def _index(spark: SparkSession, sf_dir: str) -> str:
    folder = f"{shared_dir(spark)}/index/{uuid.uuid4().hex}"
    C.write_index(C.scan_corpus(spark, sf_dir), folder)
    return folder


@query("s5_index_lists", f"""WITH {CORPUS}, f AS (SELECT origin, rel_path, root || '/' || rel_path AS abs_path, {IS_CODE.format('rel_path')} AS is_code FROM corpus)
SELECT 'all' AS list, abs_path AS path FROM f UNION ALL SELECT 'project', abs_path FROM f WHERE origin = 'project' UNION ALL SELECT 'engine', abs_path FROM f WHERE origin = 'engine'
UNION ALL SELECT 'code_project', rel_path FROM f WHERE origin = 'project' AND is_code UNION ALL SELECT 'code_engine', rel_path FROM f WHERE origin = 'engine' AND is_code""")
def s5(spark, sf_dir):
    folder = _index(spark, sf_dir)
    lists = [C.read_list(spark, folder, name).select(F.lit(name).alias("list"), "path") for name in C.LISTS]
    out = lists[0]
    for x in lists[1:]:
        out = out.unionByName(x)
    return out


@query("s6_read_index_or_scan", f"WITH {CORPUS} SELECT 'scan' AS came, origin, count(*) AS n FROM corpus GROUP BY origin UNION ALL SELECT 'index', origin, count(*) FROM corpus GROUP BY origin")
def s6(spark, sf_dir):
    scan = lambda: C.scan_corpus(spark, sf_dir)
    fresh = C.read_index_or_scan(spark, f"{shared_dir(spark)}/index/{uuid.uuid4().hex}", scan)
    stored = C.read_index_or_scan(spark, _index(spark, sf_dir), scan)
    both = fresh.withColumn("came", F.lit("scan")).unionByName(stored.withColumn("came", F.lit("index")))
    return both.groupBy("came", "origin").agg(F.count("*").alias("n"))


@query("s7_effective_rules", f"""WITH {CORPUS}, r AS (SELECT 'project' AS origin, pattern, kind FROM (VALUES ('src3', 'name'), ('en/src1', 'anchored'), ('*r17', 'name')) t(pattern, kind) UNION ALL SELECT 'engine', pattern, kind FROM (VALUES ('en', 'name'), ('thther.example.org/fr', 'anchored')) t(pattern, kind)),
f AS (SELECT origin, count(*) AS n_files FROM corpus GROUP BY origin) SELECT r.origin, pattern, kind, n_files FROM r JOIN f ON r.origin = f.origin""")
def s7(spark, sf_dir):
    """The rules of each root that the corpus has, with the number of its files."""
    sizes = C.scan_corpus(spark, sf_dir).groupBy("origin").agg(F.count("*").alias("n_files"))
    return the_rules(spark).join(sizes, "origin").select("origin", "pattern", "kind", "n_files")


@query("s8_drop_index")
def s8(spark, sf_dir):
    folder = _index(spark, sf_dir)
    return C.drop_index(spark, {"index": folder, "symbols": folder + "-none"})


@query("s9_read_lines", rf"WITH {CORPUS}, l AS (SELECT origin, rel_path, unnest(string_split_regex(text, '[\r\n]+')) AS text FROM corpus) SELECT * FROM l WHERE text <> ''")
def s9(spark, sf_dir):
    return C.read_lines(C.scan_corpus(spark, sf_dir))


@query("s10_numbered_lines", f"WITH {LINES} SELECT * FROM lines")
def s10(spark, sf_dir):
    return C.numbered_lines(C.scan_corpus(spark, sf_dir))


@query("s1_scan_tree", "SELECT DISTINCT '.' || coalesce(lang, 'none') || '/_' || coalesce(source, 'none') || '/' || doc_id || '.txt' AS rel_path, md5(text) AS digest, strlen(text)::BIGINT AS length FROM documents")
def s1b(spark, sf_dir):
    """The documents as a tree of files below hidden directories, scanned again."""
    root = f"{shared_dir(spark)}/trees/{uuid.uuid4().hex}"
    none = lambda c: F.coalesce(c, F.lit("none"))
    path = F.concat(F.lit("."), none("lang"), F.lit("/_"), none("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    trees.write_tree(table(spark, sf_dir, "documents").select(path.alias("rel_path"), "text"), root).write.format("noop").mode("overwrite").save()
    return trees.scan_tree(spark, root).select("rel_path", F.md5(F.col("text").cast("binary")).alias("digest"), "length")


@query("f1_apply_ignore", f"WITH {CORPUS} SELECT origin, rel_path FROM corpus WHERE NOT ({IGNORED})")
def f1(spark, sf_dir):
    return rules.apply_ignore(C.scan_corpus(spark, sf_dir), the_rules(spark)).select("origin", "rel_path")


ORDERED = "src1?\n!src12\nen/*/1*.txt\n!en/src2/1*.txt\nfr/\n!fr/src3/"


@query("f1_ordered_rules", rf"""WITH {CORPUS}, p AS (SELECT origin, rel_path, string_split(rel_path, '/') AS x FROM corpus) SELECT origin, rel_path FROM p
WHERE origin = 'engine' OR NOT (x[1] = 'fr' OR (regexp_matches(x[2], '^src1.$') AND x[2] <> 'src12') OR (x[1] = 'en' AND regexp_matches(x[3], '^1.*\.txt$') AND x[2] <> 'src2'))""")
def f1b(spark, sf_dir):
    """Negated rules take entries back in, but not what lies in an ignored directory."""
    return ordered_rules.apply(C.scan_corpus(spark, sf_dir).select("origin", "rel_path"), ordered_rules.parse_rules(spark, "project", ORDERED))


EXCLUDED = r"regexp_matches(rel_path, '^(?:.*/)?src5/.*$') OR regexp_matches(rel_path, '^de/[^/]*/1[^/]\.txt$') OR regexp_matches(rel_path, '^[^/]*\.example\.org/.*$')"


@query("f2_exclude_globs", f"WITH {CORPUS} SELECT origin, rel_path FROM corpus WHERE NOT ({EXCLUDED})")
def f2(spark, sf_dir):
    return rules.exclude_globs(C.scan_corpus(spark, sf_dir), GLOBS).select("origin", "rel_path")


@query("f3_drop_path_patterns", rf"WITH {CORPUS} SELECT origin, rel_path FROM corpus WHERE NOT regexp_matches(rel_path, '(?:/src1[0-2]/)|(?:^blog\.)')")
def f3(spark, sf_dir):
    return rules.drop_path_patterns(C.scan_corpus(spark, sf_dir), list(DROPPED)).select("origin", "rel_path")


#: The corpus has no code suffixes, so a third of the files get one.
CODED = "CASE WHEN doc_id % 3 = 0 THEN 'cpp' WHEN doc_id % 3 = 1 THEN 'CPP' ELSE 'usf' END"


def _coded(spark, sf_dir):
    suffix = F.when(F.col("doc_id") % 3 == 0, "cpp").when(F.col("doc_id") % 3 == 1, "CPP").otherwise("usf")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit("."), suffix)).alias("rel_path"))


@query("f4_code_files", f"WITH f AS (SELECT lang || '/' || source || '/' || doc_id || '.' || {CODED} AS rel_path FROM documents) SELECT rel_path FROM f WHERE {IS_CODE.format('rel_path')}")
def f4(spark, sf_dir):
    return rules.code_files(_coded(spark, sf_dir)).select("rel_path")


@query("f7_readable_only", f"WITH {CORPUS} SELECT origin, rel_path FROM corpus WHERE text IS NOT NULL")
def f7(spark, sf_dir):
    from corpusloom.operators.grep import readable_only

    return readable_only(C.scan_corpus(spark, sf_dir)).select("origin", "rel_path")


@query("u3_without_ignored", f"WITH {CORPUS} SELECT origin, rel_path FROM corpus WHERE rel_path NOT IN (SELECT rel_path FROM corpus WHERE {IGNORED})")
def u3(spark, sf_dir):
    files = C.scan_corpus(spark, sf_dir).select("origin", "rel_path")
    gone = rules.ignored(files, the_rules(spark)).where("ignored")
    return rules.without_ignored(files, gone)


PATHS_SQL = rf"""WITH {CORPUS}, p AS (SELECT origin, replace(rel_path, '/', '\') AS raw, rel_path FROM corpus),
d AS (SELECT *, regexp_extract(rel_path, '^(.*)/[^/]*$', 1) AS dir, string_split(rel_path, '/')[-1] AS base FROM p)
SELECT origin, replace(raw, '\', '/') AS c1_norm, replace(rel_path, '/', '\') AS c2_back, dir AS c4_dir, base AS c4_base, regexp_replace(base, '\.[^.]*$', '') AS c4_stem, {EXT.format('rel_path')} AS c4_ext,
  CASE WHEN dir = '' THEN base ELSE base || chr(9) || dir END AS c10_first,
  array_to_string(list_transform(string_split(rel_path, '/'), lambda x, i: CASE WHEN i < len(string_split(rel_path, '/')) THEN x[1] ELSE x END), '/') AS c11_short,
  starts_with(rel_path, 'en/src1') AS c17_prefix FROM d"""


@query("c1_path_helpers", PATHS_SQL)
def c1(spark, sf_dir):
    p = F.col("rel_path")
    raw = paths.to_backslash(p)
    return C.scan_corpus(spark, sf_dir).select(
        "origin", paths.norm_path(raw).alias("c1_norm"), raw.alias("c2_back"), paths.dirname(p).alias("c4_dir"), paths.basename(p).alias("c4_base"), paths.stem(p).alias("c4_stem"), paths.ext(p).alias("c4_ext"),
        paths.filename_first(p).alias("c10_first"), paths.shorten_path(p).alias("c11_short"), paths.has_prefix(p, F.lit("en/src1")).alias("c17_prefix"),
    )


@query("c3_trim_ws", r"SELECT doc_id, regexp_replace(chr(9) || ' ' || text || chr(10) || ' ', '^\s+|\s+$', '', 'g') AS trimmed FROM documents")
def c3(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", paths.trim_ws(F.concat(F.lit("\t "), F.col("text"), F.lit("\n "))).alias("trimmed"))


@query("c5_json_field", r"""SELECT event_id, nullif(regexp_extract('{"id": 1, "EngineAssociation" : "{' || user_id || '}", ' || substr(props, 2), '"EngineAssociation"\s*:\s*"([^"]+)"', 1), '') AS assoc, json_extract_string(props, '$.k') AS k FROM events""")
def c5(spark, sf_dir):
    doc = F.concat(F.lit('{"id": 1, "EngineAssociation" : "{'), F.col("user_id").cast("string"), F.lit('}", '), F.substring(F.col("props"), F.lit(2), F.length("props")))
    return table(spark, sf_dir, "events").select("event_id", paths.json_field(doc, "EngineAssociation").alias("assoc"), F.get_json_object("props", "$.k").alias("k"))


@query("c6_is_braced_guid", r"SELECT c_custkey, regexp_matches(CASE c_custkey % 3 WHEN 0 THEN '{' || c_name || '}' WHEN 1 THEN c_name ELSE '{a}{b}' END, '^\{[^{}]*\}$') AS braced FROM customer")
def c6(spark, sf_dir):
    value = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("{"), F.col("c_name"), F.lit("}"))).when(F.col("c_custkey") % 3 == 1, F.col("c_name")).otherwise("{a}{b}")
    return table(spark, sf_dir, "customer").select("c_custkey", paths.is_braced_guid(value).alias("braced"))


@query("c7_parse_kv_line", r"""WITH l AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN c_name ELSE '   ' || replace(c_name, '#', '-') || '    REG_SZ    C:\' || c_mktsegment || '\x y  ' END AS line FROM customer)
SELECT c_custkey, regexp_extract(line, '^\s*(\S+)\s+(REG_\S+)\s+(.+?)\s*$', 1) AS name, regexp_extract(line, '^\s*(\S+)\s+(REG_\S+)\s+(.+?)\s*$', 2) AS type, replace(regexp_extract(line, '^\s*(\S+)\s+(REG_\S+)\s+(.+?)\s*$', 3), '\', '/') AS value FROM l WHERE regexp_matches(line, '^\s*(\S+)\s+(REG_\S+)\s+(.+?)\s*$')""")
def c7(spark, sf_dir):
    line = F.when(F.col("c_custkey") % 5 == 0, F.col("c_name")).otherwise(F.concat(F.lit("   "), F.translate("c_name", "#", "-"), F.lit("    REG_SZ    C:\\"), F.col("c_mktsegment"), F.lit("\\x y  ")))
    rows = table(spark, sf_dir, "customer").select("c_custkey", paths.parse_kv_line(line).alias("kv"))
    return rows.where("kv is not null").select("c_custkey", "kv.name", "kv.type", "kv.value")


@query("c8_parse_hit_line", rf"""WITH {LINES}, h AS (SELECT replace(path, '/', '\') || ':' || line || ':' || text AS hit FROM lines UNION ALL SELECT text FROM lines),
p AS (SELECT regexp_extract(hit, '^(.*?):(\d+):(.*)$', ['path', 'line', 'text']) AS x FROM h WHERE regexp_matches(hit, '^(.*?):(\d+):(.*)$'))
SELECT replace(x.path, '\', '/') AS path, x.line::INT AS line, 1 AS col, x.text AS text, replace(x.path, '\', '/') || ':' || x.line::INT || ':1:' || x.text AS formatted FROM p""")
def c8(spark, sf_dir):
    lines = C.numbered_lines(C.scan_corpus(spark, sf_dir))
    made = lines.select(F.concat(paths.to_backslash(F.col("path")), F.lit(":"), F.col("line").cast("string"), F.lit(":"), F.col("text")).alias("hit")).unionByName(lines.select(F.col("text").alias("hit")))
    rows = made.select(paths.parse_hit_line(F.col("hit")).alias("h")).where("h is not null").select("h.*")
    return rows.withColumn("formatted", paths.format_hit(F.col("path"), F.col("line"), F.col("text")))


@query("c12_filetype_of", f"WITH f AS (SELECT lang || '/' || source || '/' || doc_id || '.' || {CODED} AS rel_path FROM documents) SELECT rel_path, CASE WHEN {EXT.format('rel_path')} IN ('usf', 'ush') THEN 'hlsl' ELSE {EXT.format('rel_path')} END AS filetype FROM f")
def c12(spark, sf_dir):
    return _coded(spark, sf_dir).select("rel_path", paths.filetype_of(F.col("rel_path")).alias("filetype"))


BEGIN, END = "# >>> managed", "# <<< managed"


@query("c15_upsert_block", r"""WITH t AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN '# >>> managed' || chr(10) || 'old' || chr(10) || '# <<< managed' || chr(10) || text || chr(10) ELSE text || chr(10) || '# >>> managed' || chr(10) || 'a' || chr(10) || '# <<< managed' || chr(10) || 'between' || chr(10) || '# >>> managed' || chr(10) || 'b' || chr(10) || '# <<< managed' END AS text FROM documents),
b AS (SELECT doc_id, regexp_replace(text, '(?s)# >>> managed.*?# <<< managed\n?', '', 'g') AS bare FROM t)
SELECT doc_id, CASE WHEN bare = '' OR bare LIKE '%' || chr(10) THEN bare ELSE bare || chr(10) END || '# >>> managed' || chr(10) || 'new' || chr(10) || '# <<< managed' || chr(10) AS text FROM b""")
def c15(spark, sf_dir):
    old = lambda body: F.lit(f"{BEGIN}\n{body}\n{END}")
    text = F.when(F.col("doc_id") % 3 == 0, F.col("text")).when(F.col("doc_id") % 3 == 1, F.concat(old("old"), F.lit("\n"), F.col("text"), F.lit("\n"))).otherwise(F.concat(F.col("text"), F.lit("\n"), old("a"), F.lit("\nbetween\n"), old("b")))
    return table(spark, sf_dir, "documents").select("doc_id", paths.upsert_block(text, BEGIN, END, "new").alias("text"))


@query("c16_strip_trailing_blank_lines", r"SELECT doc_id, regexp_replace(text || repeat(chr(13) || chr(10), (doc_id % 4)::INT), '[\r\n]+$', '') AS text FROM documents")
def c16(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", paths.strip_trailing_blank_lines(F.concat(F.col("text"), F.repeat(F.lit("\r\n"), (F.col("doc_id") % 4).cast("int")))).alias("text"))
