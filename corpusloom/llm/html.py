"""Main text of web pages by wrappers learnt from pages of one host (operator 3).

A page is a stream of structural tags and texts. Pages of a host that are made
of the same elements and classes (a template) are aligned one after the other
into a wrapper, a regular expression without unions: runs of equal groups, of
any length, become repeated groups, what some pages lack becomes optional, texts
that differ become slots. The wrapper says under which element the varying text
stands, and which texts in it are the same on all pages. Of a page's text, what
is in that element is its main text, less those fixed texts and what stands in
elements that by their tag, class or id are menus, headers, footers, sidebars,
notices, adverts, forms or reader comments; inside the main element only tags
and words count that can't be part of an article's subject. A page without that element, or
without a wrapper, is extracted by those tags and classes alone.

How it scales: all pages are counted by host, template and digest, with partial
sums. The different pages of a template, all of them, are dealt by a hash into
parts of about ``PART_PAGES`` and aligned whole, a wrapper for each part, so that
a host with a third of all pages is small groups too. What the parts say is
joined by counts: a text is fixed if it is in all parts, one that is the same
within a part only varies, and an element's text is the sum over all parts. Every
page is then extracted in its own row, whole; what it gets from its wrapper is a
few short texts by an equi-join.

Cases: a null html gives an empty text; a null or odd url belongs to the host
''; repeated pages count once in a wrapper; a template seen on one page only has
none; tags without ends, ends without tags and cut-off pages are read as far as
they go. Other columns of the input are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import html
import re
from bisect import bisect_left
from collections import Counter
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.sources.tables import staged

#: Different pages of a template that are aligned at a time, about, and their characters; every page is in one such part.
PART_PAGES, PART_CHARS = 32, 1 << 22
#: Pages that must agree on a fixed text; its share of the main element at most, beyond which the pages are copies.
FIXED_PAGES, FIXED_SHARE = 3, 0.2

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|textarea|select|iframe|svg|title)\b.*?(?:</(?P=raw)\s*>|\Z)"""
    r"""|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*(?:>|\Z))|<[!?/][^>]*(?:>|\Z)|(?P<text>[^<]+|<)""",
    re.S | re.I,
)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
# Elements of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Their ends may be left out, so they only separate blocks.
LOOSE = frozenset("p li dt dd tr td th option thead tbody tfoot".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SIDE = frozenset("nav footer aside form button dialog head menu".split())
CENTRE = frozenset("article main".split())
#: Words of a class, id or role by which an element is not main text.
SIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget "
    "cookie cookies consent notice notices gdpr popup modal newsletter subscribe signup share sharing social comment comments disqus reply replies respond related recommended search login".split()
)
#: Those of them that mean no article's own text even inside the main element. The others may be part of what it is about:
#: a recipe's menu, a share price, search results, a notice board.
SIDE_WORDS_INSIDE = SIDE_WORDS - frozenset("banner nav navigation menu header widget notice notices promo share sharing social reply replies respond related recommended search login".split())


def _names(rest: str) -> list[str]:
    return [x for found in NAMED.findall(rest) for x in "".join(found).lower().split()]


def _is_side(name: str, names: list[str], words: frozenset = SIDE_WORDS) -> bool:
    return name in SIDE or any(w in words for n in names for w in re.split(r"[^a-z]+", n))


def tokens(page: str):
    """(kind, name, names, text): kind is open, close, block (a separator) or text; inline tags are left out."""
    for m in TOKEN.finditer(page):
        if m["text"] is not None:
            yield "text", "", (), m["text"]
        elif m["name"]:
            name = m["name"].lower()
            if name in INLINE:
                continue
            if name in VOID or name in LOOSE:
                yield "block", m["end"] + name, (), ""
            elif m["end"]:
                yield "close", name, (), ""
            else:
                names = _names(m["rest"])
                yield ("block" if m["rest"].endswith("/>") and name not in CENTRE else "open"), name, names, ""


def _mark(name: str, names) -> str:
    """An element as the wrapper names it: its tag and classes."""
    return name + "".join("." + n for n in sorted(names))


def _runs(page: str):
    """The tokens with the texts between two structural tags as one; the end of a loose element is a space in it."""
    held: list[str] = []
    for token in tokens(page):
        kind, name, _, text = token
        if kind == "text":
            held.append(text)
        elif kind == "block" and name.startswith("/"):
            held.append(" ")
        else:
            if held:
                yield "text", "", (), "".join(held)
                held = []
            yield token
    if held:
        yield "text", "", (), "".join(held)


def _plain(text: str) -> str:
    return " ".join(html.unescape(text).split())


# --- wrappers ---------------------------------------------------------------


def _stream(page: str) -> list[tuple[str, str]]:
    """A page as (shape, text) tokens: the mark of an element, / before its end, # for a text that is not empty."""
    out = []
    for kind, name, names, text in _runs(page):
        if kind != "text":
            out.append((("/" if kind == "close" else "") + _mark(name, names), ""))
        elif text := _plain(text):
            out.append(("#", text))
    return out


class _Level:
    """An open element while groups are sought: where its units start in the output, and a key of each unit."""

    def __init__(self, name: str, key: int, at: int):
        self.name, self.key, self.at, self.starts, self.keys, self.loose = name, key, at, [], [], False

    def add(self, at: int, key: int, loose: bool) -> None:
        """A new unit, or a further part of the loose one that is open (an li holds what follows it)."""
        if self.loose and not loose:
            self.keys[-1] = hash((self.keys[-1], key))
        else:
            self.starts.append(at)
            self.keys.append(key)
            self.loose = loose


def _fold(stream: list[tuple[str, str]], known: dict[int, set[tuple[int, int]]], once: bool) -> list[tuple[str, str]]:
    """The stream with each run of equal groups of units as one token, its shape (group)+ and its texts together.

    A unit is an element with all it holds, or a loose tag with what follows it.
    Runs found are noted in ``known`` by their first unit; with ``once`` a known
    group that stands alone is a run of one. The key of an element does not tell
    how often a group is repeated in it, so outer groups meet too.
    """
    out: list[tuple[str, str]] = []
    levels = [_Level("", 0, 0)]
    names: Counter = Counter()

    def close() -> None:
        level = levels.pop()
        names[level.name] -= 1
        collapsed = _fold_level(out, level, known, once)
        out.append(("/" + level.name, ""))
        parent = levels[-1]
        parent.add(level.at, hash((level.key, collapsed)), False)

    for shape, text in stream:
        name = shape.lstrip("/").split(".")[0]
        if shape == "#":
            levels[-1].add(len(out), 1, False)
            out.append((shape, text))
        elif name in LOOSE | VOID:
            levels[-1].add(len(out), hash(shape), True)
            out.append((shape, text))
        elif shape[0] != "/":
            levels.append(_Level(name, hash(shape), len(out)))
            names[name] += 1
            out.append((shape, text))
        elif names[name] > 0:
            while levels[-1].name != name:
                close()
            close()
    while len(levels) > 1:
        close()
    _fold_level(out, levels[0], known, once)
    return out


def _fold_level(out: list[tuple[str, str]], level: _Level, known: dict[int, set[tuple[int, int]]], once: bool) -> tuple[int, ...]:
    """Folds the units at the end of ``out`` in place; the keys that are left."""
    keys, ends = level.keys, [*level.starts[1:], len(out)]
    # Digests of prefixes tell in one step whether two groups are equal.
    prime, base = (1 << 61) - 1, 1_000_003
    digest, power = [0], [1]
    for key in keys:
        digest.append((digest[-1] * base + key) % prime)
        power.append(power[-1] * base % prime)
    part = lambda i, n: (digest[i + n] - digest[i] * power[n]) % prime
    runs = _repeats(keys, part)
    left, made, i = [], [], 0
    while i < len(keys):
        while runs and runs[0][0] < i:  # a run that began inside the one before goes on after it
            _, n, end = heappop(runs)
            if end - i >= n:
                heappush(runs, (i, n, end))
        n = runs[0][1] if runs and runs[0][0] == i else 0
        if n:
            known.setdefault(keys[i], set()).add((n, part(i, n)))
        elif once:
            n = max((m for m, group in known.get(keys[i], ()) if i + m <= len(keys) and part(i, m) == group), default=0)
        if n:
            first, j = i, i + n
            while j + n <= len(keys) and part(j, n) == part(first, n):
                j += n
            shape = "(" + " ".join(s for s, _ in out[level.starts[first] : ends[first + n - 1]]) + ")+"
            made.append((level.starts[first], ends[j - 1], shape))
            left += keys[first : first + n]
            i = j
        else:
            left.append(keys[i])
            i += 1
    if made:
        begin = made[0][0]
        new, at = [], begin
        for start, end, shape in made:
            new += out[at:start]
            new.append((shape, " ".join(t for _, t in out[start:end] if t)))
            at = end
        out[begin:] = new + out[at:]
    return tuple(left)


def _repeats(keys: list[int], part) -> list[tuple[int, int, int]]:
    """A heap of (i, n, end): group i .. i + n stands at least twice in a row, and up to ``end`` each key is that n places on.

    A group's length is how far on one of its keys stands next. How far the
    keys agree at that distance is found by halving, so N keys take N log N steps.
    """
    later: dict[int, int] = {}
    far: dict[int, int] = {}
    after = [0] * len(keys)
    for i in range(len(keys) - 1, -1, -1):
        after[i] = later.get(keys[i], i) - i
        later[keys[i]] = i

    def most(limit: int, agree) -> int:
        low = 0
        while low < limit:
            mid = (low + limit + 1) // 2
            low, limit = (mid, limit) if agree(mid) else (low, mid - 1)
        return low

    runs = []
    for j, n in enumerate(after):
        if n and j >= far.get(n, 0):
            end = j + most(len(keys) - j - n, lambda m: part(j, m) == part(j + n, m))
            i = j - most(j, lambda m: part(j - m, m) == part(j + n - m, m))
            far[n] = end
            if end - i >= n:
                runs.append((i, n, end))
    heapify(runs)
    return runs


def infer(pages: list[str]) -> list[dict]:
    """The wrapper of a template's pages: items with shape, optional, text (None for a slot), chars (of its text, over all pages)."""
    streams = [_stream(p) for p in pages]
    known: dict[int, set[tuple[int, int]]] = {}
    for stream in streams:
        _fold(stream, known, False)
    wrapper: list[dict] | None = None
    for stream in streams:
        folded = [{"shape": s, "optional": False, "text": t, "chars": len(t)} for s, t in _fold(stream, known, True)]
        wrapper = folded if wrapper is None else _align(wrapper, folded)
    return wrapper or []


def _align(wrapper: list[dict], page: list[dict]) -> list[dict]:
    """Resolves mismatches: tokens of one side only become optional, differing texts a slot.

    At a mismatch the nearer of the two tokens' next places on the other side is
    where both go on, so the time is linear (but for a search in sorted places).
    """
    places: tuple[dict, dict] = ({}, {})
    for side, found in zip((wrapper, page), places):
        for i, x in enumerate(side):
            found.setdefault(x["shape"], []).append(i)

    def ahead(found: dict, shape: str, at: int, size: int) -> int:
        where = found.get(shape, ())
        k = bisect_left(where, at)
        return where[k] - at if k < len(where) else size

    out: list[dict] = []
    i = j = 0
    while i < len(wrapper) and j < len(page):
        x, y = wrapper[i], page[j]
        if x["shape"] == y["shape"]:
            out.append({**x, "text": x["text"] if x["text"] == y["text"] else None, "chars": x["chars"] + y["chars"]})
            i, j = i + 1, j + 1
            continue
        skip_page, skip_wrapper = ahead(places[1], x["shape"], j, len(page) - j + 1), ahead(places[0], y["shape"], i, len(wrapper) - i + 1)
        far_page, far_wrapper = skip_page > len(page) - j, skip_wrapper > len(wrapper) - i
        if not far_page and (far_wrapper or skip_page <= skip_wrapper):
            out += [{**z, "optional": True} for z in page[j : j + skip_page]]
            j += skip_page
        elif not far_wrapper:
            out += [{**z, "optional": True} for z in wrapper[i : i + skip_wrapper]]
            i += skip_wrapper
        else:
            out += [{**x, "optional": True}, {**y, "optional": True}]
            i, j = i + 1, j + 1
    return out + [{**z, "optional": True} for z in wrapper[i:] + page[j:]]


def expression(wrapper: list[dict]) -> str:
    """The wrapper as text: groups as (...)+, optional parts as (...)?, slots as #, fixed texts quoted."""
    shown = [repr(x["text"])[:60] if x["shape"] == "#" and x["text"] is not None else x["shape"] for x in wrapper]
    return " ".join(f"({s})?" if x["optional"] else s for s, x in zip(shown, wrapper))


def _walk(wrapper: list[dict]):
    """(event, mark, item): elements are opened and closed in pairs, texts and groups come with the mark of the element around them."""
    stack: list[str] = []
    names: Counter = Counter()
    for x in wrapper:
        shape = x["shape"]
        name = shape.lstrip("/").split(".")[0]
        if shape == "#" or shape[0] == "(":
            yield "item", stack[-1] if stack else "", x
        elif shape[0] != "/":
            if name not in LOOSE | VOID:
                stack.append(shape)
                names[name] += 1
                yield "open", shape, None
        elif names[name] > 0:
            gone = ""
            while gone != name:
                mark = stack.pop()
                gone = mark.split(".")[0]
                names[gone] -= 1
                yield "close", mark, None
    while stack:
        yield "close", stack.pop(), None


def _digest(mark: str, x: dict) -> int:
    """A text with the element around it, as 64 bits."""
    return int.from_bytes(hashlib.blake2b(f"{mark} {x['shape']} {x['text']}".encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def _can_be_fixed(mark: str, x: dict) -> bool:
    return x["shape"] == "#" and x["text"] is not None and not x["optional"] and mark.split(".")[0] not in HEADINGS


def constants(wrapper: list[dict]) -> set[int]:
    """Digests of the texts that are the same on all pages of a wrapper."""
    return {_digest(mark, x) for event, mark, x in _walk(wrapper) if event == "item" and x["text"] is not None and not x["optional"]}


def weights(wrapper: list[dict], shared: set[int] | None = None) -> dict[str, list[int]]:
    """By element: characters of varying text outside elements at the side, of all text, of text that can be fixed, and its depth; '' is the whole page.

    ``shared``: digests of the texts that are the same in the wrappers of all parts; others vary (None: there are no other parts).
    """
    found: dict[str, list[int]] = {}
    sums, open_, side = [[0, 0, 0]], Counter(), 0
    for event, mark, x in _walk(wrapper):
        if event == "item":
            same = x["text"] is not None and (shared is None or x["optional"] or _digest(mark, x) in shared)
            sums[-1][0] += 0 if same or side else x["chars"]
            sums[-1][1] += x["chars"]
            sums[-1][2] += x["chars"] if same and _can_be_fixed(mark, x) else 0
            continue
        apart = _is_side(*_parts(mark))
        if event == "open":
            sums.append([0, 0, 0])
            open_[mark] += 1
            side += apart
        else:
            inside = sums.pop()
            sums[-1] = [a + b for a, b in zip(sums[-1], inside)]
            open_[mark] -= 1
            side -= apart
            if not open_[mark]:  # of equal marks in each other the outer one counts
                old = found.get(mark, [0, 0, 0, 0])
                found[mark] = [*(a + b for a, b in zip(old, inside)), max(old[3], len(sums))]
    found[""] = [*sums[0], 0]
    return found


def main_element(wrapper: list[dict]) -> str:
    """The element under which most of the slots' text stands, elements at the side left out; '' if there is none.

    An article or main element wins; else the innermost element that still holds
    nine tenths of the varying text.
    """
    found = weights(wrapper)
    total = found.pop("")[0]
    held = {mark: w[0] for mark, w in found.items() if w[0]}
    centre = [s for s in held if s.split(".")[0] in CENTRE and held[s] >= total / 2]
    wide = centre or [s for s in held if held[s] >= 0.9 * total and s.split(".")[0] not in ("html", "body")]
    # Of equal elements the inner one is taken.
    return min(wide, key=lambda s: (held[s], -found[s][3], s)) if wide and total else ""


def fixed_texts(wrapper: list[dict], element: str, n_pages: int) -> list[str]:
    """'mark text' of the texts in the main element that are the same on all of at least ``FIXED_PAGES`` pages.

    Headings stay. If more than ``FIXED_SHARE`` of the element's text is fixed, the
    pages are copies of each other rather than one template, and nothing is.
    """
    found, fixed, total, inside = set(), 0, 0, 0
    for event, mark, x in _walk(wrapper):
        if event != "item":
            inside += (mark == element) * (1 if event == "open" else -1)
        elif inside:
            total += x["chars"]
            if _can_be_fixed(mark, x):
                fixed += x["chars"]
                found.add(mark + " " + x["text"])
    return sorted(found) if n_pages >= FIXED_PAGES and fixed <= FIXED_SHARE * total else []


def _parts(mark: str) -> tuple[str, list[str]]:
    name, *names = mark.split(".")
    return name, names


# --- extraction -------------------------------------------------------------


def extract(page: str, element: str = "", fixed=()) -> str:
    """The main text of a page; its wrapper names the main element's mark and the fixed texts in it."""
    found = _collect(page, lambda mark, name: mark == element, frozenset(fixed)) if element else None
    if found is None:
        found = _collect(page, lambda mark, name: name in CENTRE)
    if found is None:
        found = _collect(page, None)
    return _plain("".join(found))


def _collect(page: str, is_main, fixed: frozenset = frozenset()) -> list[str] | None:
    """The texts inside main elements (``is_main`` None: everywhere), outside side elements and not ``fixed``, blocks apart; None without a main element."""
    out: list[str] = []
    stack: list[tuple[str, str, bool, bool]] = []  # name, mark, is main, is at the side
    names: Counter = Counter()
    main = side = 0
    met = is_main is None
    for kind, name, classes, text in _runs(page):
        if kind == "text":
            if not side and (main or is_main is None) and not (fixed and stack and f"{stack[-1][1]} {_plain(text)}" in fixed):
                out.append(text)
            continue
        # A reference may not go on over a border of blocks.
        out.append(" ")
        if kind == "open":
            mark = _mark(name, classes)
            here = is_main is not None and is_main(mark, name)
            # A page's header is at the side, that of an article is not.
            apart = not here and (_is_side(name, classes, SIDE_WORDS_INSIDE if main else SIDE_WORDS) or name == "header" and not any(names[c] > 0 for c in CENTRE))
            stack.append((name, mark, here, apart))
            names[name] += 1
            main, side, met = main + here, side + apart, met or here
        elif kind == "close" and names[name] > 0:
            gone = ""
            while gone != name:
                gone, _, here, apart = stack.pop()
                names[gone] -= 1
                main, side = main - here, side - apart
    return out if met else None


# --- Spark ------------------------------------------------------------------


def host_of(url):
    """The host of an address in lower case, '' if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))


def template_of(page):
    """A digest of the kinds of elements and of the classes a page is made of, digits left out."""
    kinds = "article|main|section|div|aside|nav|header|footer|table|form|ul|ol|dl"
    tags = F.transform(F.regexp_extract_all(page, F.lit(rf"(?i)<({kinds})\b"), F.lit(1)), F.lower)
    classes = F.transform(F.regexp_extract_all(page, F.lit(rf"""(?i)<(?:{kinds})\b[^<>]*?\bclass\s*=\s*["']?([^"'<>]*)"""), F.lit(1)), lambda c: F.regexp_replace(F.lower(c), r"\d+", ""))
    return F.xxhash64(F.array_sort(F.array_distinct(tags)), F.array_sort(F.array_distinct(classes)))


def _keyed(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"), template_of(F.col("html")).alias("template"))


_ITEM = "shape string, optional boolean, text string, chars long"
_PART = f"host string, template long, n_pages long, wrapper string, constants array<long>, items array<struct<{_ITEM.replace(' string', ': string').replace(' boolean', ': boolean').replace(' long', ': long')}>>"


def _met(rows: DataFrame, found: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``found`` by host and template."""
    keys = found.withColumnsRenamed({"host": "_host", "template": "_template"})
    return rows.join(keys, (F.col("host") == F.col("_host")) & (F.col("template") == F.col("_template")), how).drop("_host", "_template")


def part_wrappers(pages: DataFrame) -> DataFrame:
    """(host, template, n_pages, wrapper, constants, items) of each part of the different pages of a template, of those with two or more in ``pages`` (page_id, url, html).

    Every page is in one part. ``constants`` are digests of the texts that are the same on all pages of the part.
    """
    import pandas as pd
    import pyarrow as pa

    rows = _keyed(pages.where("html is not null")).select("host", "template", "html", F.xxhash64("html").alias("digest"))
    # Copies count once: how many parts a template has is settled on digests.
    every = rows.select("host", "template", "digest", F.length("html").alias("_chars")).groupBy("host", "template", "digest").agg(F.max("_chars").alias("_chars"))
    counts = every.groupBy("host", "template").agg(F.count("*").alias("_n"), F.sum("_chars").alias("_sum")).where("_n > 1")
    n_parts = F.greatest(F.ceil(F.col("_n") / F.lit(PART_PAGES)), F.ceil(F.col("_sum") / F.lit(PART_CHARS)), F.lit(1))
    counts = staged(counts.select("host", "template", n_parts.cast("long").alias("_parts")), "wrapper-templates")

    def once(batches):
        # A group of copies gets to its part once from each task.
        seen = set()
        for batch in batches:
            new = []
            for key in zip(batch.column("host").to_pylist(), batch.column("digest").to_pylist()):
                new.append(key not in seen)
                seen.add(key)
            yield batch.filter(pa.array(new, pa.bool_()))

    dealt = _met(rows, counts).withColumn("part", F.pmod(F.xxhash64(F.lit(31), "digest"), F.col("_parts"))).drop("_parts")
    dealt = dealt.mapInArrow(once, dealt.schema)

    def fit(group: "pd.DataFrame") -> "pd.DataFrame":
        group = group.drop_duplicates("digest").sort_values("digest")
        made = infer(list(group["html"]))
        # Of an optional text that is no slot only its length counts.
        items = [{k: "" if k == "text" and x["optional"] and x[k] is not None else x[k] for k in ("shape", "optional", "text", "chars")} for x in made]
        return pd.DataFrame({"host": [group["host"].iloc[0]], "template": [group["template"].iloc[0]], "n_pages": [len(group)], "wrapper": [expression(made)], "constants": [sorted(constants(made))], "items": [items]})

    return dealt.groupBy("host", "template", "part").applyInPandas(fit, _PART)


def _rows_of(batches, schema, of):
    """Rows that ``of`` makes of the items and the other cells of each part, as (host, template, …)."""
    import pyarrow as pa

    for batch in batches:
        for i in range(batch.num_rows):
            part = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
            made = of(part)
            if made:
                cells = list(zip(*[(part["host"], part["template"], *x) for x in made]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, schema.types)], schema.names)


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, template, element, fixed, n_pages) of each host and template with two different pages or more: what the wrappers of all its parts say together."""
    import pyarrow as pa

    parts = staged(part_wrappers(pages), "wrapper-parts")
    of_template = parts.groupBy("host", "template").agg(F.count("*").alias("_parts"), F.sum("n_pages").alias("n_pages"))
    # A text is fixed if it is constant in all parts: at most the constants of one part are left for a template.
    met = parts.select("host", "template", F.explode("constants").alias("digest")).groupBy("host", "template", "digest").agg(F.count("*").alias("_in"))
    shared = staged(_met(met, of_template).where("_in = _parts").groupBy("host", "template").agg(F.collect_set("digest").alias("shared")), "wrapper-shared")
    weighed = pa.schema([("host", pa.string()), ("template", pa.int64()), ("mark", pa.string()), *((c, pa.int64()) for c in ("held", "whole", "fixed", "depth"))])
    weigh = lambda part: [(mark, *w) for mark, w in weights(part["items"], set(part["shared"] or ())).items()]
    rows = _met(parts.select("host", "template", "items"), shared, "left").mapInArrow(lambda b: _rows_of(b, weighed, weigh), "host string, template long, mark string, held long, whole long, fixed long, depth long")
    sums = staged(rows.groupBy("host", "template", "mark").agg(*[F.sum(c).alias(c) for c in ("held", "whole", "fixed")], F.max("depth").alias("depth")), "wrapper-weights")
    total = sums.where("mark = '' AND held > 0").select("host", "template", F.col("held").alias("_total"))
    name = F.substring_index("mark", ".", 1)
    centre = name.isin(*CENTRE) & (F.col("held") >= F.col("_total") / 2)
    wide = (F.col("held") >= F.lit(0.9) * F.col("_total")) & ~name.isin("html", "body")
    able = _met(sums.where("mark <> '' AND held > 0"), total).where(centre | wide)
    # As in main_element; of equal elements the inner one is taken.
    best = able.groupBy("host", "template").agg(F.min(F.struct((~centre).alias("a"), "held", (-F.col("depth")).alias("d"), "mark", "whole", "fixed")).alias("b"))
    chosen = _met(of_template.select("host", "template", "n_pages"), best.select("host", "template", F.col("b.mark").alias("element"), F.col("b.whole").alias("_whole"), F.col("b.fixed").alias("_fixed")), "left")
    chosen = staged(chosen.withColumn("element", F.coalesce("element", F.lit(""))), "wrapper-elements")
    some = chosen.where((F.col("_fixed") > 0) & (F.col("n_pages") >= FIXED_PAGES) & (F.col("_fixed") <= F.lit(FIXED_SHARE) * F.col("_whole"))).select("host", "template", "element")
    texts = pa.schema([("host", pa.string()), ("template", pa.int64()), ("text", pa.string())])

    def held(part):
        keep, out, inside = set(part["shared"] or ()), set(), 0
        for event, mark, x in _walk(part["items"]):
            if event != "item":
                inside += (mark == part["element"]) * (1 if event == "open" else -1)
            elif inside and _can_be_fixed(mark, x) and _digest(mark, x) in keep:
                out.add((mark + " " + x["text"],))
        return sorted(out)

    named = _met(_met(parts.select("host", "template", "items"), some), shared).mapInArrow(lambda b: _rows_of(b, texts, held), "host string, template long, text string")
    fixed = named.groupBy("host", "template").agg(F.sort_array(F.collect_set("text")).alias("fixed"))
    return _met(chosen.select("host", "template", "element", "n_pages"), fixed, "left").select("host", "template", "element", F.coalesce("fixed", F.array().cast("array<string>")).alias("fixed"), "n_pages")


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``."""
    import pyarrow as pa

    found = staged(wrappers(pages), "wrappers").where("element <> ''").select(F.col("host").alias("_host"), F.col("template").alias("_template"), "element", "fixed")
    on = (F.col("host") == F.col("_host")) & (F.col("template") == F.col("_template"))
    rows = _keyed(pages).join(found, on, "left").select("page_id", "url", "html", "element", "fixed")
    out = T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for batch in batches:
            texts = [extract(h or "", e or "", f or ()) for h, e, f in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=out.names)

    return rows.mapInArrow(run, out)
