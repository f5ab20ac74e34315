"""DuckDB SQL for the numbered queries that SQL can express, by plainer ways than the operators'."""

from __future__ import annotations

from corpusloom.llm.quality import ALPHA, DELTA, RULES, STEPS

#: On these pages the main text is what the article element holds; titles may end in a cut-off reference.
OP3 = r"""WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|$)', 1) AS inner_html FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(inner_html, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS plain FROM a),
c AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(replace(replace(replace(plain, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text FROM b)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM c"""

_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, {10 * g + 1}, 10))::BIGINT >> {35 - 5 * j}) & 31) + 1)::BIGINT, 1)" for g in range(4) for j in range(8))

OP5 = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest, min(page_id) OVER (PARTITION BY body) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM f"""

_SCORES = {"symbols_per_word": "n_symbols / greatest(n_words, 1)", "dup_line_share": "n_dup_lines / greatest(n_lines, 1)", "repeat_word_share": "n_repeat_words / greatest(n_words, 1)", "long_words": "word_chars / greatest(n_words, 1)", "short_words": "-(word_chars / greatest(n_words, 1))"}
_TRIED = ", ".join(f"('{rule}', {i}, {cut}::DOUBLE)" for i, (rule, cut) in enumerate(STEPS))

OP6 = rf"""WITH d AS (SELECT doc_id, lang AS stratum, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
runs AS (SELECT doc_id, unnest(range(1, len(words) - 6)) AS i, words FROM w WHERE len(words) >= 8),
keyed AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS run FROM runs),
twice AS (SELECT doc_id, i FROM keyed QUALIFY count(*) OVER (PARTITION BY doc_id, run) > 1),
cover AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id),
f AS (SELECT w.doc_id, stratum, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN cover ON w.doc_id = cover.doc_id),
s AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed, {", ".join(f"({v})::DOUBLE AS {k}" for k, v in _SCORES.items())} FROM f),
long AS (SELECT doc_id, stratum, base_failed, rule, score FROM s UNPIVOT (score FOR rule IN ({", ".join(RULES)}))),
tried(rule, step, cutoff) AS (VALUES {_TRIED}),
good AS (SELECT l.doc_id, any_value(stratum) AS stratum, b.rowid AS label, min(step) FILTER (score > cutoff) AS first FROM long l JOIN (SELECT doc_id, row_number() OVER () AS rowid FROM labels WHERE quality = 1) b ON l.doc_id = b.doc_id JOIN tried t ON l.rule = t.rule WHERE NOT base_failed GROUP BY l.doc_id, b.rowid),
counts AS (SELECT stratum, rule, step, cutoff, count(*) AS n, count(*) FILTER (first <= step) AS k FROM good, tried GROUP BY ALL),
tails AS (SELECT *, list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({ALPHA}) + (n - i) * ln({1 - ALPHA})))) AS tail, {DELTA} / count(*) OVER (PARTITION BY step) AS allowed FROM counts),
passed AS (SELECT stratum, rule, cutoff FROM tails QUALIFY bool_and(k <= {ALPHA} * n AND tail <= allowed) OVER (PARTITION BY stratum ORDER BY step)),
cuts AS (SELECT stratum, rule, min(cutoff) AS cutoff FROM passed GROUP BY ALL),
hit AS (SELECT l.doc_id, string_agg(l.rule, ',' ORDER BY list_position([{", ".join(f"'{r}'" for r in RULES)}], l.rule)) AS rejected_by FROM long l JOIN cuts c ON l.stratum IS NOT DISTINCT FROM c.stratum AND l.rule = c.rule AND l.score > c.cutoff GROUP BY l.doc_id)
SELECT s.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rejected_by IS NULL AS kept, coalesce(rejected_by, '') AS rejected_by FROM s LEFT JOIN hit ON s.doc_id = hit.doc_id"""

OP9 = r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
g AS (SELECT doc_id, CASE WHEN len(words) >= 5 THEN list_sort(list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')))) WHEN len(words) > 0 THEN ['short ' || array_to_string(words, ' ')] ELSE [] END AS grams FROM w),
sets AS (SELECT md5(array_to_string(grams, chr(10))) AS k, any_value(grams) AS grams, min(doc_id) AS rep, count(*) AS n_copies FROM g WHERE len(grams) > 0 GROUP BY k),
one AS (SELECT rep, len(grams) AS n, unnest(grams) AS gram FROM sets),
pairs AS (SELECT a.rep AS a, b.rep AS b, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS j FROM one a JOIN one b ON a.gram = b.gram AND a.rep < b.rep GROUP BY a.rep, b.rep),
links AS (SELECT a, b FROM pairs WHERE j >= 0.8 UNION ALL SELECT b, a FROM pairs WHERE j >= 0.8),
reach(v, u) AS (SELECT a, b FROM links UNION SELECT r.v, l.b FROM reach r JOIN links l ON r.u = l.a),
label AS (SELECT v, least(v, min(u)) AS class_id FROM reach GROUP BY v),
degree AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT g.doc_id, coalesce(class_id, rep, g.doc_id) AS class_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(n_copies, 1)::BIGINT AS n_copies
FROM g LEFT JOIN sets ON len(g.grams) > 0 AND md5(array_to_string(g.grams, chr(10))) = sets.k LEFT JOIN label ON rep = v LEFT JOIN degree ON rep = a"""


def _rounds(size: int, k: int, rounds: int, seed: int) -> str:
    """Clustering as a chain of common table expressions, two a round."""
    near = """a{i} AS MATERIALIZED (SELECT p, vec_id, v, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM (
  SELECT v.p, v.vec_id, v.v, c.cluster, list_sum(list_transform(range(1, {n}), lambda j: (v.v[j] - c.v[j]) * (v.v[j] - c.v[j])))::BIGINT AS d FROM v, c{i} c) GROUP BY p, vec_id, v)"""
    move = """c{j} AS MATERIALIZED (SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN (SELECT cluster, list(x ORDER BY j) AS v FROM (
  SELECT cluster, j, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS x FROM (SELECT cluster, unnest(v) AS x, unnest(range(1, {n})) AS j FROM a{i}) GROUP BY cluster, j) GROUP BY cluster) m ON c.cluster = m.cluster)"""
    parts = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS p, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS cluster, v FROM v QUALIFY cluster < {k})",
    ]
    for i in range(rounds + 1):
        parts.append(near.format(i=i, n=size + 1))
        if i < rounds:
            parts.append(move.format(i=i, j=i + 1, n=size + 1))
    return "WITH " + ",\n".join(parts) + f"""
SELECT a.vec_id, a.cluster::INT AS cluster, a.distance, (sum(a.distance) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia, (sum(a.distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.cluster = c.cluster"""


OP12 = _rounds(64, 8, 10, 3)

OP13 = r"""WITH w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS a FROM (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS m)) GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT * FROM f WHERE m > 1 AND a >= 100),
s AS (SELECT c.lang, c.phrase, c.a, n.n, p.a AS l, q.a AS r, k, (1000::HUGEINT * c.a * n.n) // (p.a::HUGEINT * q.a) AS score
  FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, m)) AS k FROM c WHERE NOT EXISTS (SELECT 1 FROM c d WHERE d.lang = c.lang AND d.m > c.m AND 100 * d.a >= 100 * c.a AND contains(' ' || d.phrase || ' ', ' ' || c.phrase || ' '))) c
  JOIN n ON n.lang = c.lang JOIN f p ON p.lang = c.lang AND p.m = k AND p.phrase = array_to_string(c.w[1:k], ' ') JOIN f q ON q.lang = c.lang AND q.m = c.m - k AND q.phrase = array_to_string(c.w[k + 1:], ' ')),
b AS (SELECT lang, phrase, a, n, unnest(arg_min({'l': l, 'r': r, 'score': score}, (score, k))) FROM s GROUP BY lang, phrase, a, n)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM b QUALIFY rank <= 2000"""
