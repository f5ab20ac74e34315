"""Column helpers for paths, parsed lines and managed text blocks."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File types that differ from the extension.
FILETYPES = {"usf": "hlsl", "ush": "hlsl"}
#: The group of an entry whose description names none.
GENERAL = "General"


def _or_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def norm_path(c: Column) -> Column:
    """Slashes for backslashes; null becomes empty."""
    return F.translate(F.coalesce(c, F.lit("")), "\\", "/")


def to_backslash(c: Column) -> Column:
    return F.translate(c, "/", "\\")


def trim_ws(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def dirname(c: Column) -> Column:
    """What stands before the last slash, empty without one."""
    return F.regexp_extract(c, r"^(.*)/[^/]*$", 1)


def basename(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def stem(c: Column) -> Column:
    return F.regexp_replace(basename(c), r"\.[^.]*$", "")


def ext(c: Column) -> Column:
    """The last suffix without its dot, empty without one; case stays."""
    return F.regexp_extract(c, r"\.([^./]*)$", 1)


def json_field(c: Column, name: str) -> Column:
    """The string value of the first field of that name, found by pattern; null without one."""
    return _or_null(F.regexp_extract(c, rf'"{re.escape(name)}"\s*:\s*"([^"]+)"', 1))


def is_braced_guid(c: Column) -> Column:
    """The whole value is one pair of braces, without braces inside."""
    return c.rlike(r"^\{[^{}]*\}$")


def parse_kv_line(c: Column) -> Column:
    """``name  REG_TYPE  value`` as a struct (name, type, value), the value with slashes and trimmed; null if the line isn't one."""
    form = r"(?s)^\s*(\S+)\s+(REG_\S+)\s+(.+?)\s*\z"
    part = lambda i: F.regexp_extract(c, form, i)
    return F.when(c.rlike(form), F.struct(part(1).alias("name"), part(2).alias("type"), F.translate(part(3), "\\", "/").alias("value")))


def parse_hit_line(c: Column) -> Column:
    """``path:line:text`` as a struct (path, line, col 1, text), the path as short as possible; null if the line isn't one.

    The text is whatever follows, returns and other separators included.
    """
    form = r"(?s)^(.*?):(\d{1,9}):(.*)\z"
    part = lambda i: F.regexp_extract(c, form, i)
    return F.when(c.rlike(form), F.struct(norm_path(part(1)).alias("path"), part(2).cast("int").alias("line"), F.lit(1).alias("col"), part(3).alias("text")))


def format_hit(path: Column, line: Column, text: Column) -> Column:
    return F.concat(path, F.lit(":"), line.cast("string"), F.lit(":1:"), F.coalesce(text, F.lit("")))


def filename_first(c: Column) -> Column:
    """The name, then the directory."""
    return F.concat_ws("\t", basename(c), _or_null(dirname(c)))


def shorten_path(c: Column) -> Column:
    """Each directory cut to its first character."""
    parts = F.split(c, "/", -1)
    return F.array_join(F.transform(parts, lambda p, i: F.when(i < F.size(parts) - 1, F.left(p, F.lit(1))).otherwise(p)), "/")


def filetype_of(c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in FILETYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, ext(c)), ext(c))


def group_of(desc: Column) -> Column:
    """The word before a colon at the start of a description."""
    return F.coalesce(_or_null(F.regexp_extract(desc, r"^([A-Za-z0-9_]+)\s*:", 1)), F.lit(GENERAL))


def catalog_line(mode: Column, lhs: Column, desc: Column) -> Column:
    """``- [mode] lhs : desc``, lhs padded to twelve characters and never cut."""
    return F.format_string("- [%s] %-12s : %s", mode, lhs, desc)


def upsert_block(c: Column, begin: str, end: str, body: str) -> Column:
    """The text with exactly one managed block, at its end; text between old blocks stays. Idempotent."""
    old = rf"(?s)\Q{begin}\E.*?\Q{end}\E\n?"
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), old, "")
    joined = F.when((bare == "") | bare.endswith("\n"), bare).otherwise(F.concat(bare, F.lit("\n")))
    return F.concat(joined, F.lit(f"{begin}\n{body}\n{end}\n"))


def strip_trailing_blank_lines(c: Column) -> Column:
    return F.regexp_replace(c, r"[\r\n]+\z", "")


def has_prefix(c: Column, prefix: Column) -> Column:
    """A plain prefix test, without regard to separators."""
    return F.startswith(c, prefix)


def ancestors(c: Column) -> Column:
    """All proper ancestor directories of a path, the shortest first."""
    parts = F.split(c, "/", -1)
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))
