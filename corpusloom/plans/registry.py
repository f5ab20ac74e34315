"""Queries by name, each with its SQL, and the SQL of the common inputs."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame, and the SQL that gives the same rows."""
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


CORPUS = r"""corpus AS (
  SELECT 'project' AS origin, '/project' AS root, lang || '/' || source || '/' || doc_id || '.txt' AS rel_path, text FROM documents
  UNION ALL
  SELECT 'engine', '/engine', regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), html FROM pages)"""

LINES = (
    CORPUS
    + r""",
lines AS (
  SELECT origin, rel_path AS path, unnest(range(1, len(parts) + 1))::INT AS line, unnest(parts) AS text
  FROM (SELECT origin, rel_path, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS parts FROM corpus WHERE text <> ''))"""
)


def hits(pattern: str, source: str = "lines", name: str = "hits") -> str:
    """SQL of the matches of a pattern (RE2, with its flags) in ``source``."""
    p = pattern.replace("'", "''")
    return rf"""{name} AS (
  SELECT origin, path, line,
    unnest(list_transform(range(1, len(ms) + 1), lambda i: 1 + coalesce(list_sum(list_transform(gaps[1:i], lambda g: strlen(g))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda m: strlen(m))), 0)))::INT AS col,
    unnest(ms) AS match, text
  FROM (SELECT *, string_split_regex(text, '{p}') AS gaps, regexp_extract_all(text, '{p}') AS ms FROM {source} WHERE regexp_matches(text, '{p}')))"""


IDENT = r"[\p{L}_][\p{L}\p{N}_]*"
POSTINGS = LINES + ",\n" + hits(IDENT, name="found") + ",\npostings AS (SELECT match AS term, origin, path, line, col FROM found)"

EXT = r"regexp_extract({0}, '\.([^./]*)$', 1)"
IS_CODE = EXT + " IN ('c', 'cc', 'cpp', 'cxx', 'h', 'hh', 'hpp', 'hxx', 'inl', 'ipp', 'inc', 'm', 'mm')"
