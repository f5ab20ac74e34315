"""Joins, result lists, catalog, progress and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import paths
from corpusloom.operators import catalog as K
from corpusloom.operators import progress as P
from corpusloom.operators import resolve as J
from corpusloom.operators import results as R
from corpusloom.operators.grep import grep, grep_many
from corpusloom.plans.registry import CORPUS, LINES, POSTINGS, hits, query
from corpusloom.plans.search_queries import PATTERN, SENSITIVE, term_index
from corpusloom.sources import corpus as C
from corpusloom.sources.tables import table
from corpusloom.streaming import streams as X

HITS = LINES + ",\n" + hits("(?i)" + PATTERN)

# --- joins ---


@query("j1_semi_join", f"WITH {CORPUS} SELECT origin, rel_path FROM corpus WHERE rel_path IN (SELECT rel_path FROM corpus WHERE text LIKE '%that%')")
def j1(spark, sf_dir):
    files = C.scan_corpus(spark, sf_dir)
    listed = files.where(F.contains("text", F.lit("that"))).select("rel_path").distinct()
    return J.listed(files.select("origin", "rel_path"), listed, ["rel_path"])


@query("j2_anti_join", f"WITH {CORPUS} SELECT origin, rel_path FROM corpus WHERE rel_path NOT IN (SELECT rel_path FROM corpus WHERE text LIKE '%that%')")
def j2(spark, sf_dir):
    from corpusloom.operators.rules import without_ignored

    files = C.scan_corpus(spark, sf_dir)
    return without_ignored(files.select("origin", "rel_path"), files.where(F.contains("text", F.lit("that"))))


ROOTS = "roots AS (SELECT DISTINCT regexp_extract(rel_path, '^([^/]*)/', 1) AS root FROM corpus WHERE rel_path LIKE '%/%' UNION SELECT DISTINCT regexp_extract(rel_path, '^([^/]*/[^/]*)/', 1) FROM corpus WHERE regexp_matches(rel_path, '^(en|de)/[^/]*/'))"


@query("j3_route_by_prefix", f"WITH {CORPUS}, {ROOTS} SELECT origin, rel_path AS path, (SELECT max_by(root, length(root)) FROM roots WHERE starts_with(rel_path, root || '/')) AS root FROM corpus")
def j3(spark, sf_dir):
    files = C.scan_corpus(spark, sf_dir).select("origin", F.col("rel_path").alias("path"))
    one = files.select(F.regexp_extract("path", "^([^/]*)/", 1).alias("root")).where("root <> ''")
    two = files.where(F.col("path").rlike("^(en|de)/[^/]*/")).select(F.regexp_extract("path", "^([^/]*/[^/]*)/", 1).alias("root"))
    return J.route_by_prefix(files, one.unionByName(two).distinct())


@query("j4_nearest_root", f"WITH {CORPUS}, {ROOTS}, m AS (SELECT root AS dir FROM roots WHERE root NOT LIKE '%src1%') SELECT false AS strict, rel_path AS path, (SELECT max_by(dir, length(dir)) FROM m WHERE starts_with(rel_path, dir || '/')) AS root FROM corpus UNION ALL SELECT true, rel_path, (SELECT max(dir) FROM m WHERE dir = regexp_extract(rel_path, '^(.*)/[^/]*$', 1)) FROM corpus")
def j4(spark, sf_dir):
    files = C.scan_corpus(spark, sf_dir).select(F.col("rel_path").alias("path"))
    one = files.select(F.regexp_extract("path", "^([^/]*)/", 1).alias("dir")).where("dir <> ''")
    two = files.where(F.col("path").rlike("^(en|de)/[^/]*/")).select(F.regexp_extract("path", "^([^/]*/[^/]*)/", 1).alias("dir"))
    markers = one.unionByName(two).distinct().where(~F.contains("dir", F.lit("src1")))
    near = lambda strict: J.nearest_root(files, markers, strict=strict).select(F.lit(strict).alias("strict"), "path", "root")
    return near(False).unionByName(near(True))


@query("j5_pair_counterparts", rf"WITH {CORPUS}, a AS (SELECT rel_path, split_part(rel_path, '/', 1) AS lang, regexp_extract(rel_path, '/([0-9]+)\.txt$', 1) AS stem FROM corpus WHERE origin = 'project'), b AS (SELECT rel_path, split_part(rel_path, '/', 2) AS lang, regexp_extract(rel_path, '/([0-9]+)/?$', 1) AS stem FROM corpus WHERE origin = 'engine') SELECT a.lang, a.stem, a.rel_path AS left_path, b.rel_path AS right_path FROM a JOIN b ON a.lang = b.lang AND a.stem = b.stem")
def j5(spark, sf_dir):
    left = C.project_files(spark, sf_dir).select(F.col("rel_path").alias("path"), F.split_part("rel_path", F.lit("/"), F.lit(1)).alias("lang"), paths.stem(F.col("rel_path")).alias("stem"))
    right = C.engine_files(spark, sf_dir).select(F.col("rel_path").alias("path"), F.split_part("rel_path", F.lit("/"), F.lit(2)).alias("lang"), F.regexp_extract("rel_path", "/([0-9]+)/?$", 1).alias("stem"))
    return J.pair_counterparts(left, right, ["lang", "stem"])


@query("j5_counterpart", rf"WITH {CORPUS}, a AS (SELECT rel_path, split_part(rel_path, '/', 1) AS lang, regexp_extract(rel_path, '/([0-9]+)\.txt$', 1) AS stem FROM corpus WHERE origin = 'project'), b AS (SELECT rel_path, split_part(rel_path, '/', 2) AS lang, regexp_extract(rel_path, '/([0-9]+)/?$', 1) AS stem FROM corpus WHERE origin = 'engine') SELECT a.lang, a.stem, a.rel_path AS left_path, min(b.rel_path) AS right_path FROM a LEFT JOIN b ON a.lang = b.lang AND a.stem = b.stem GROUP BY ALL")
def j5b(spark, sf_dir):
    left = C.project_files(spark, sf_dir).select(F.col("rel_path").alias("path"), F.split_part("rel_path", F.lit("/"), F.lit(1)).alias("lang"), paths.stem(F.col("rel_path")).alias("stem")).distinct()
    right = C.engine_files(spark, sf_dir).select(F.col("rel_path").alias("path"), F.split_part("rel_path", F.lit("/"), F.lit(2)).alias("lang"), F.regexp_extract("rel_path", "/([0-9]+)/?$", 1).alias("stem"))
    return J.counterpart(left, right, ["lang", "stem"])


@query("j6_resolve_refs", r"""WITH p AS (SELECT o_orderkey AS project, o_orderkey % 11 <> 0 AS found, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN o_custkey::VARCHAR ELSE '{' || o_custkey || '}' END AS assoc FROM orders),
b AS (SELECT '{' || c_custkey || '}' AS id, ' C:/' || c_name || ' ' AS path FROM customer WHERE c_custkey % 13 <> 0),
j AS (SELECT project, assoc, path, CASE WHEN NOT found THEN 'no project' WHEN assoc IS NULL THEN 'no association' WHEN NOT regexp_matches(assoc, '^\{[^{}]*\}$') THEN 'not a braced id' WHEN path IS NULL THEN 'id not registered' ELSE 'ok' END AS err FROM p LEFT JOIN b ON assoc = id)
SELECT project, assoc, CASE WHEN err = 'ok' THEN trim(path) END AS root, err FROM j""")
def j6(spark, sf_dir):
    cust = F.col("o_custkey").cast("string")
    assoc = F.when(F.col("o_orderkey") % 7 == 0, F.lit(None).cast("string")).when(F.col("o_orderkey") % 5 == 0, cust).otherwise(F.concat(F.lit("{"), cust, F.lit("}")))
    projects = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("project"), (F.col("o_orderkey") % 11 != 0).alias("found"), assoc.alias("assoc"))
    builds = table(spark, sf_dir, "customer").where("c_custkey % 13 <> 0").select(F.concat(F.lit("{"), F.col("c_custkey").cast("string"), F.lit("}")).alias("id"), F.concat(F.lit(" C:\\"), F.col("c_name"), F.lit(" ")).alias("path"))
    return J.resolve_refs(projects, builds)


@query("j7_freshness_join", "SELECT s.user_id, s.n_views, a.n_purchases FROM (SELECT user_id, count(*) AS n_views FROM events WHERE event_type = 'view' GROUP BY 1) s LEFT JOIN (SELECT user_id, count(*) AS n_purchases FROM events WHERE event_type = 'purchase' GROUP BY 1) a ON s.user_id = a.user_id")
def j7(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    count = lambda kind, name: events.where(F.col("event_type") == kind).groupBy("user_id").agg(F.count("*").alias(name))
    return count("view", "n_views").join(count("purchase", "n_purchases"), "user_id", "left")


@query("j7_freshness", """WITH l AS (SELECT user_id, max(ts) AS list_ts FROM events WHERE event_type = 'view' GROUP BY 1),
a AS (SELECT user_id, min(ts) AS oldest_ts, count(*) AS n FROM (SELECT user_id, event_type, max(ts) AS ts FROM events WHERE event_type IN ('purchase', 'click', 'signup') GROUP BY 1, 2) GROUP BY 1),
o AS (SELECT coalesce(l.user_id, a.user_id) AS user_id, list_ts, oldest_ts, CASE WHEN list_ts IS NULL THEN 'no list' WHEN coalesce(n, 0) < 3 THEN 'part missing' WHEN date_trunc('second', oldest_ts) < date_trunc('second', list_ts) THEN 'older than the list' ELSE 'fresh' END AS outcome FROM l FULL JOIN a ON l.user_id = a.user_id)
SELECT *, outcome <> 'fresh' AS rebuild FROM o""")
def j7b(spark, sf_dir):
    """A user's last view is the list, the last purchase, click and signup are the three parts built from it."""
    events = table(spark, sf_dir, "events")
    lists = events.where("event_type = 'view'").select("user_id", F.col("ts").alias("list_ts"))
    built = events.select("user_id", F.col("event_type").alias("part"), F.col("ts").alias("artifact_ts"))
    found = J.freshness(lists, built, "user_id", ["purchase", "click", "signup"])
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("list_ts", "oldest_ts")})


# --- windows over results ---


@query("w1_with_neighbours", f"""WITH {HITS}, k AS (SELECT DISTINCT path, path || ':' || line || ':' || col AS place, line, col, origin FROM hits)
SELECT false AS wrap, origin, place, lead(place) OVER w AS next, lag(place) OVER w AS previous FROM k WINDOW w AS (PARTITION BY origin ORDER BY path, line, col)
UNION ALL SELECT true, origin, place, coalesce(lead(place) OVER w, first_value(place) OVER v), coalesce(lag(place) OVER w, last_value(place) OVER v) FROM k WINDOW w AS (PARTITION BY origin ORDER BY path, line, col), v AS (PARTITION BY origin ORDER BY path, line, col ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def w1(spark, sf_dir):
    at = F.concat_ws(":", "path", F.col("line").cast("string"), F.col("col").cast("string"))
    found = grep(C.scan_corpus(spark, sf_dir), PATTERN).select("origin", "path", "line", "col", at.alias("place")).distinct()
    go = lambda wrap: R.with_neighbours(found, ["origin"], ["path", "line", "col"], "place", wrap).select(F.lit(wrap).alias("wrap"), "origin", "place", "next", "previous")
    return go(False).unionByName(go(True))


TIERS = f"""WITH {LINES},
{hits('(?i)' + PATTERN, name='a')},
{hits(SENSITIVE, name='b')},
t AS (SELECT regexp_extract(path, '^([^/]*)/', 1) AS query, 1 AS tier, path, line, col FROM a UNION ALL SELECT regexp_extract(path, '^([^/]*)/', 1), 2, path, line, col FROM b)
SELECT * FROM t QUALIFY tier = min(tier) OVER (PARTITION BY query)"""


@query("w3_first_nonempty_tier", TIERS)
def w3(spark, sf_dir):
    files = C.scan_corpus(spark, sf_dir)
    tier = lambda p, n: grep(files, p).select(F.regexp_extract("path", "^([^/]*)/", 1).alias("query"), F.lit(n).alias("tier"), "path", "line", "col")
    return R.first_nonempty_tier(tier(PATTERN, 1).unionByName(tier(SENSITIVE, 2)))


@query("w3_first_success", TIERS)
def w3b(spark, sf_dir):
    """The second search runs only for directories without a hit of the first."""
    files = C.scan_corpus(spark, sf_dir).withColumn("query", F.regexp_extract("rel_path", "^([^/]*)/", 1))

    def tier(pattern):
        def search(pending):
            own = files.join(pending.select("query"), "query", "left_semi")
            return grep(own.select("origin", "root", "rel_path", "text"), pattern).select(F.regexp_extract("path", "^([^/]*)/", 1).alias("query"), "path", "line", "col")

        return search

    return R.first_success(files, [tier(PATTERN), tier(SENSITIVE)])


@query("t2_cap_per_query", f"""WITH {LINES},
{hits('(?i)' + PATTERN, name='a')},
{hits(SENSITIVE, name='b')},
t AS (SELECT DISTINCT '{PATTERN}' AS pattern, origin, path, line, col FROM a UNION ALL SELECT DISTINCT '{SENSITIVE}', origin, path, line, col FROM b)
SELECT pattern, origin, path, line, col, (row_number() OVER (PARTITION BY pattern ORDER BY path, line, col, origin))::INT AS rank FROM t QUALIFY rank <= 200""")
def t2(spark, sf_dir):
    found = grep_many(C.scan_corpus(spark, sf_dir), [PATTERN, SENSITIVE]).select("pattern", "origin", "path", "line", "col").distinct()
    return R.cap_per_query(found, "pattern", ["path", "line", "col", "origin"])


@query("t3_fuzzy_topk", f"WITH {CORPUS}, p AS (SELECT DISTINCT rel_path FROM corpus) SELECT rel_path, length(regexp_extract(rel_path, '(?i)e.*?x.*?4.*?2', 0)) AS span FROM p WHERE regexp_extract(rel_path, '(?i)e.*?x.*?4.*?2', 0) <> '' ORDER BY span, length(rel_path), rel_path LIMIT 50")
def t3(spark, sf_dir):
    return R.fuzzy_topk(C.scan_corpus(spark, sf_dir).select("rel_path").distinct(), "rel_path", "ex42", 50)


@query("t4_recent_files", "WITH l AS (SELECT user_id, event_type, max(ts) AS last_ts FROM events GROUP BY ALL) SELECT user_id, event_type, last_ts, (row_number() OVER (PARTITION BY user_id ORDER BY last_ts DESC, event_type))::INT AS rank FROM l QUALIFY rank <= 3")
def t4(spark, sf_dir):
    return R.recent_files(table(spark, sf_dir, "events"), "user_id", "event_type", "ts", 3)


@query("t5_complete_prefix", f"""WITH {POSTINGS}, s AS (SELECT 0 AS prio, term FROM postings WHERE starts_with(term, 'li') UNION ALL SELECT 1, string_split(rel_path, '/')[-1] FROM corpus WHERE starts_with(string_split(rel_path, '/')[-1], 'li') UNION ALL SELECT 2, w FROM (SELECT unnest(string_split_regex(text, '\\s+')) AS w FROM conversations) WHERE starts_with(w, 'li')),
c AS (SELECT term, prio, count(*) AS freq FROM s GROUP BY ALL), f AS (SELECT term, min(prio) AS prio, arg_min(freq, prio) AS freq FROM c GROUP BY term)
SELECT term, prio, freq FROM f ORDER BY prio, freq DESC, term LIMIT 100""".replace("\\\\s", "\\s"))
def t5(spark, sf_dir):
    files = C.scan_corpus(spark, sf_dir)
    names = files.select(paths.basename(F.col("rel_path")).alias("term"))
    words = table(spark, sf_dir, "conversations").select(F.explode(F.split("text", r"\s+")).alias("term"))
    return R.complete_prefix([term_index(spark, files).terms(), names, words], "li", 100)


@query("t6_preselect", f"WITH {HITS} SELECT origin, path, line, col FROM hits QUALIFY row_number() OVER (PARTITION BY path ORDER BY line, col, origin) = 1")
def t6(spark, sf_dir):
    found = grep(C.scan_corpus(spark, sf_dir), PATTERN)
    return R.preselect(found, "path", [F.col("line"), F.col("col"), F.col("origin")]).select("origin", "path", "line", "col")


@query("u1_concat_results", f"WITH {CORPUS} SELECT origin, rel_path, CASE origin WHEN 'project' THEN 0 ELSE 1 END AS part FROM corpus")
def u1(spark, sf_dir):
    pick = lambda x: x.select("origin", "rel_path")
    return R.concat_results(pick(C.project_files(spark, sf_dir)), pick(C.engine_files(spark, sf_dir)))


@query("u2_snapshot_diff", "WITH o AS (SELECT doc_id, lang, text FROM documents WHERE doc_id % 7 <> 0), n AS (SELECT doc_id, lang, CASE WHEN doc_id % 5 = 0 THEN upper(text) ELSE text END AS text FROM documents WHERE doc_id % 11 <> 0) SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN '+' WHEN n.doc_id IS NULL THEN '_' ELSE '~' END AS sign FROM o FULL JOIN n ON o.doc_id = n.doc_id WHERE o.doc_id IS NULL OR n.doc_id IS NULL OR o.text IS DISTINCT FROM n.text OR o.lang IS DISTINCT FROM n.lang")
def u2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    new = docs.where("doc_id % 11 <> 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.upper("text")).otherwise(F.col("text")))
    return R.snapshot_diff(docs.where("doc_id % 7 <> 0"), new, "doc_id", ["lang", "text"])


# --- catalog ---

ENTRIES = "e AS (SELECT p_brand AS mode, p_type AS lhs, CASE WHEN p_partkey % 9 = 0 THEN '' WHEN p_partkey % 10 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN split_part(p_name, ' ', 1) || ': ' || p_size ELSE p_mfgr END AS \"desc\" FROM parts), k AS (SELECT DISTINCT mode, lhs, \"desc\" FROM e WHERE \"desc\" <> ''), g AS (SELECT *, coalesce(nullif(regexp_extract(\"desc\", '^([A-Za-z0-9_]+)\\s*:', 1), ''), 'General') AS grp FROM k)"
ENTRIES = "parts AS (SELECT *, 'size ' || p_size % 5 AS p_mfgr FROM part), " + ENTRIES


def _entries(spark, sf_dir):
    desc = F.when(F.col("p_partkey") % 9 == 0, "").when(F.col("p_partkey") % 10 == 0, F.lit(None).cast("string")).when(F.col("p_partkey") % 3 == 0, F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(": "), F.col("p_size").cast("string"))).otherwise(F.concat(F.lit("size "), (F.col("p_size") % 5).cast("string")))
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("mode"), F.col("p_type").alias("lhs"), desc.alias("desc"))


@query("a6_dedupe_catalog", f'WITH {ENTRIES} SELECT mode, lhs, "desc" FROM k')
def a6(spark, sf_dir):
    return K.dedupe_catalog(_entries(spark, sf_dir))


@query("a7_group_counts", f"WITH {ENTRIES} SELECT grp, count(*) AS n_entries FROM g GROUP BY grp")
def a7(spark, sf_dir):
    return K.group_counts(K.dedupe_catalog(_entries(spark, sf_dir)))


@query("t1_sort_catalog", f'WITH {ENTRIES} SELECT mode, lhs, "desc", grp FROM g ORDER BY grp, lhs, mode, "desc"')
def t1(spark, sf_dir):
    return K.sort_catalog(K.dedupe_catalog(_entries(spark, sf_dir)))


@query("w2_with_group_breaks", f'WITH {ENTRIES} SELECT mode, lhs, "desc", grp, grp IS DISTINCT FROM lag(grp) OVER (PARTITION BY mode ORDER BY grp, lhs, "desc") AS header FROM g')
def w2(spark, sf_dir):
    return K.with_group_breaks(K.dedupe_catalog(_entries(spark, sf_dir)))


@query("c14_catalog_line", f"WITH {ENTRIES} SELECT grp, '- [' || mode || '] ' || CASE WHEN length(lhs) < 12 THEN rpad(lhs, 12, ' ') ELSE lhs END || ' : ' || \"desc\" AS line FROM g")
def c14(spark, sf_dir):
    return K.catalog_report(_entries(spark, sf_dir))


# --- progress ---


@query("a1_index_summary", f"WITH {CORPUS} SELECT origin, count(*) AS n_files, 'index generated (' || origin || '=' || count(*) || ')' AS message FROM corpus GROUP BY origin")
def a1(spark, sf_dir):
    return P.index_summary(C.scan_corpus(spark, sf_dir))


@query("a2_line_counts", f"WITH {CORPUS} SELECT origin, rel_path AS path, (CASE WHEN text = '' THEN 0 ELSE len(string_split(regexp_replace(text, '\\n$', ''), chr(10))) END)::BIGINT AS n_lines FROM corpus".replace("\\\\n", "\\n"))
def a2(spark, sf_dir):
    return P.line_counts(C.scan_corpus(spark, sf_dir))


PROGRESS = "p AS (SELECT user_id, count(*) FILTER (event_type IN ('view', 'click')) AS processed, count(*) AS total, greatest((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 0.001) AS sec FROM events GROUP BY user_id)"


@query("a3_progress", f"WITH {PROGRESS} SELECT user_id, processed::BIGINT AS processed, total::BIGINT AS total, CASE WHEN total > 0 THEN floor(processed * 100.0 / total) ELSE 0 END::BIGINT AS pct, round(processed / sec, 9) AS rate, floor(sec)::BIGINT AS seconds FROM p")
def a3(spark, sf_dir):
    rows = P.progress(table(spark, sf_dir, "events"), "user_id", F.col("event_type").isin("view", "click"), "ts", F.lit(1))
    return rows.withColumn("rate", F.round("rate", 9))


@query("a4_count_marked_lines", f"WITH {LINES} SELECT origin, sum(CASE WHEN contains(text, 'that') THEN 1 ELSE 0 END)::BIGINT AS n_marked FROM lines GROUP BY origin")
def a4(spark, sf_dir):
    return P.count_marked_lines(C.numbered_lines(C.scan_corpus(spark, sf_dir)), "that", "origin")


@query("a5_size_stats", f"WITH {CORPUS} SELECT origin, sum(coalesce(strlen(text), 0))::BIGINT AS n_bytes, max(coalesce(strlen(text), 0))::BIGINT AS most_bytes, count(*) AS n_files FROM corpus GROUP BY origin")
def a5(spark, sf_dir):
    return P.size_stats(C.scan_corpus(spark, sf_dir))


@query("w4_carry_last_nonzero", "WITH s AS (SELECT user_id, event_id, ts, CASE WHEN value < 100 THEN 0 ELSE value END AS value FROM events) SELECT *, last_value(nullif(value, 0) IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS shown FROM s")
def w4(spark, sf_dir):
    samples = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.when(F.col("value") < 100, F.lit(0.0)).otherwise(F.col("value")).alias("value"))
    return P.carry_last_nonzero(samples, "user_id", ["ts", "event_id"], "value")


@query("w5_status_intervals", "SELECT user_id, event_id, event_type, ts, least(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts + INTERVAL 6 HOUR) AS until FROM events")
def w5(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return P.status_intervals(rows, "user_id", ["ts", "event_id"], "ts", "6 HOUR")


@query("w6_current_status", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS ts FROM events GROUP BY user_id")
def w6(spark, sf_dir):
    return P.current_status(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", "event_type")


# --- streams ---


@query("x1_stream_progress", "SELECT user_id, count(*) AS n_events, max(ts) AS last_ts FROM events GROUP BY user_id")
def x1(spark, sf_dir):
    rows = X.run_to_end(X.stream_progress(X.event_stream(spark, sf_dir), "user_id"), "complete")
    return rows.withColumn("last_ts", F.col("last_ts").cast("timestamp_ntz"))


GAP_US = 6 * 3600 * 1_000_000
THROTTLED = """WITH RECURSIVE k AS (SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id, min(ts) AS ts FROM events GROUP BY user_id
  UNION ALL SELECT k.user_id, n.event_id, n.ts FROM k, LATERAL (SELECT e.event_id, e.ts FROM events e WHERE e.user_id = k.user_id AND e.ts >= k.ts + INTERVAL 6 HOUR ORDER BY e.ts, e.event_id LIMIT 1) n)
SELECT user_id, event_id, ts FROM k"""


@query("x2_throttle", THROTTLED)
def x2(spark, sf_dir):
    return X.throttle(table(spark, sf_dir, "events"), "user_id", "event_id", GAP_US)


@query("x2_throttle_stream", THROTTLED.replace("SELECT user_id, event_id, ts FROM k", "SELECT user_id, event_id, epoch_us(ts) AS us FROM k"))
def x2b(spark, sf_dir):
    # Any order of the stored files is allowed for, so nothing is judged before the end.
    return X.play_out(X.event_stream(spark, sf_dir), lambda events: X.throttle_stream(events, "user_id", "event_id", GAP_US, lateness="300 days"))


@query("x3_debounce", "WITH n AS (SELECT user_id, event_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events) SELECT user_id, event_id, ts FROM n WHERE nx IS NULL OR nx >= ts + INTERVAL 3 HOUR")
def x3(spark, sf_dir):
    return X.debounce(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), "user_id", "event_id", "3 HOUR")


@query("x4_sample_latest", "SELECT user_id, time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01') AS start, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL")
def x4(spark, sf_dir):
    return X.sample_latest(table(spark, sf_dir, "events"), "user_id", "value", "event_id", "12 hours")


@query("x5_stream_status", """WITH o AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS head FROM events),
b AS (SELECT *, sum(head) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM o)
SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, min(ts) AS shown_from, max(ts) + INTERVAL 6 HOUR AS shown_until FROM b GROUP BY user_id, burst""")
def x5(spark, sf_dir):
    found = X.play_out(X.event_stream(spark, sf_dir), lambda events: X.stream_status(events, "user_id", "event_type", "event_id", 6 * 3600 * 1_000_000, lateness="300 days"))
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("shown_from", "shown_until")})
