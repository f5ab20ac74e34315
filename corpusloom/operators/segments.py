"""The term index as immutable segments of block postings.

A segment holds, for the files that one refresh took in:

* ``postings``: a row for each term and block of files with all its places,
  delta-coded, so that a frequent term is as many rows as there are blocks. Each
  task of a refresh sorts the rows of its blocks by term and writes them where
  they stay, so that a term is a page or two of each of its files; ``merge``
  deals them by term. The files of the blocks are rows without a term before them;
* ``files``: (origin, path, stamp, block, ord) of each file;
* ``terms``: (term, n), sorted by term: how many occurrences the segment adds to
  each term, or takes away with the files it replaces;
* ``dead``: (block, ord) of files of earlier segments that are gone or replaced.

A manifest lists the segments that count. A refresh compares paths and stamps
with the live files, reads the texts of new and changed ones only, writes a
segment beside the others and then the next manifest under a name that must be
new. Until then readers see the old one, so a refresh that dies changes nothing.
``merge`` makes one segment of all and leaves out dead places.
"""

from __future__ import annotations

import json
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.results import snapshot_diff
from corpusloom.sources.tables import staged

#: Files and characters of a block at most (a longer file is a block of its own); an identifier.
BLOCK_FILES, BLOCK_CHARS = 1024, 1 << 22
#: Places that a task decodes at a time, about.
MOST_PLACES = 1 << 19
BEGINS, FOLLOWS = r"[\p{L}_]", r"[\p{L}\p{N}_]"
IDENTIFIER = f"{BEGINS}{FOLLOWS}*"
POSTINGS = "term string, block long, n long, places binary"
FILES = "origin string, path string, stamp long, block long, ord int"
TERMS, DEAD = "term string, n long", "block long, ord int"


# --- coding ---


def varints(numbers: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Numbers as bytes of seven bits, low ones first, and where each begins (with the end)."""
    most = int(numbers.max(initial=0))
    numbers = numbers.astype(np.uint32 if most < 1 << 32 else np.uint64)
    longer = [np.flatnonzero(numbers >= numbers.dtype.type(1 << (7 * k))) for k in range(1, 10) if most >= 1 << (7 * k)]
    size = np.ones(len(numbers), np.int8)
    for which in longer:
        size[which] += 1
    at = np.zeros(len(numbers) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    out = np.zeros(int(at[-1]), np.uint8)
    out[at[:-1]] = (numbers & numbers.dtype.type(127)).astype(np.uint8)
    for k, which in enumerate(longer):
        rest = numbers[which] >> numbers.dtype.type(7 * (k + 1))
        out[at[which] + k] |= np.uint8(128)
        out[at[which] + k + 1] = (rest & numbers.dtype.type(127)).astype(np.uint8)
    return out.tobytes(), at


def numbers_of(data: bytes) -> np.ndarray:
    """The numbers that ``varints`` made."""
    raw = np.frombuffer(data, np.uint8)
    last = raw < 128
    ends = np.flatnonzero(last)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((raw & 127).astype(np.uint64) << (7 * place).astype(np.uint64), starts).astype(np.int64) if len(raw) else np.zeros(0, np.int64)


def coded(groups: np.ndarray, ords: np.ndarray, lines: np.ndarray, cols: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Places sorted by (group, ord, line, col) as bytes, and where each group's begin: differences of ord, of line within a file, of col within a line."""
    new_group = np.concatenate([[True], groups[1:] != groups[:-1]])
    step = lambda a, fresh: np.where(fresh, a, a - np.concatenate([[0], a[:-1]]))
    d_ord = step(ords, new_group)
    new_file = new_group | (d_ord != 0)
    d_line = step(lines, new_file)
    d_col = step(cols, new_file | (d_line != 0))
    data, at = varints(np.stack([d_ord, d_line, d_col], 1).ravel())
    return data, np.append(at[3 * np.flatnonzero(new_group)], at[-1])


def _sums(a: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Running sums that begin anew where ``fresh``."""
    total = np.cumsum(a)
    first = np.flatnonzero(fresh)
    return total - np.repeat(total[first] - a[first], np.diff(np.append(first, len(a))))


def decoded(rows: list[bytes], counts: np.ndarray) -> np.ndarray:
    """The places (ord, line, col) of several rows, one after the other, given how many each has."""
    d = numbers_of(b"".join(rows)).reshape(-1, 3)
    if not len(d):
        return d
    fresh = np.zeros(len(d), bool)
    fresh[np.cumsum(counts) - counts] = True
    ords = _sums(d[:, 0], fresh)
    fresh |= d[:, 0] != 0
    lines = _sums(d[:, 1], fresh)
    fresh |= d[:, 1] != 0
    return np.stack([ords, lines, _sums(d[:, 2], fresh)], 1)


@lru_cache(1)
def _kinds() -> np.ndarray:
    """Of each code point: 1 if it can go on an identifier, 2 if it can also begin one, else 0."""
    import regex

    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else " " for c in range(0x110000))
    out = np.zeros(len(every), np.uint8)
    for kind, form in ((1, FOLLOWS), (2, BEGINS)):
        for m in regex.finditer(f"{form}+", every):
            out[m.start() : m.end()] = kind
    return out


@lru_cache(1)
def _byte_kinds() -> np.ndarray:
    """The same of each byte that is a sign by itself."""
    return np.append(_kinds()[:128], np.zeros(128, np.uint8))


def places_in(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, texts, lines, byte columns) of the identifiers of an array of texts, in order; texts from 0, the others from 1.

    All of it is done on the bytes as they come, so no text or term becomes a Python string.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, bounds, data = texts.buffers()
    bounds = np.frombuffer(bounds, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    kind = _byte_kinds()[raw]
    leads = np.flatnonzero(raw >= 0xC0)
    if len(leads):
        part = lambda k: raw.take(leads + k, mode="clip").astype(np.uint32) & 0x3F
        lead = raw[leads].astype(np.uint32)
        size = 2 + (lead >= 0xE0) + (lead >= 0xF0)
        code = np.select([size == 2, size == 3], [(lead & 0x1F) << 6 | part(1), (lead & 0xF) << 12 | part(1) << 6 | part(2)], (lead & 7) << 18 | part(1) << 12 | part(2) << 6 | part(3))
        own = _kinds()[np.minimum(code, 0x10FFFF)]
        kind[leads] = own
        # The other bytes of a sign go on what it goes on.
        for k in (1, 2, 3):
            some = np.flatnonzero((size > k) & (leads + k < len(raw)))
            kind[leads[some] + k] = np.minimum(own[some], 1)
    inside = kind > 0
    edges = bounds[(bounds > 0) & (bounds < len(raw))]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    # A run ends with its text.
    first[edges], last[edges - 1] = inside[edges], inside[edges - 1]
    at, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    # An identifier begins at the first sign of a run that can begin one, and takes the rest of the run.
    late = np.flatnonzero(kind[at] != 2)
    if len(late):
        begins = np.append(np.flatnonzero(kind == 2), len(raw))
        at[late] = begins[np.searchsorted(begins, at[late])]
        kept = at < ends
        at, ends = at[kept], ends[kept]
        step = np.zeros(len(raw) + 1, np.int8)
        step[at] += 1
        step[ends] -= 1
        inside = np.cumsum(step[:-1], dtype=np.int8) > 0
    cuts = np.zeros(len(at) + 1, np.int64)
    np.cumsum(ends - at, out=cuts[1:])
    terms = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(cuts), pa.py_buffer(raw[inside])])
    if cuts[-1] < 1 << 31:
        terms = terms.cast(pa.string())
    of = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(at, bounds)))
    feeds = np.flatnonzero(raw == 10)
    before = np.searchsorted(feeds, at)
    begin = np.maximum(np.append(0, feeds + 1)[before], bounds[of])
    return terms, of, before - np.searchsorted(feeds, bounds)[of] + 1, at - begin + 1


def places(text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(terms, lines, byte columns) of one text."""
    terms, _, lines, cols = places_in(pa.array([text.encode("utf-8", "replace").decode()]))
    return terms.to_pylist(), lines, cols


def _runs_of(batch, chars: int, most: int):
    """A batch in runs of neighbouring rows of at most ``most`` rows and ``chars`` characters (a longer row by itself)."""
    sizes = np.cumsum(pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
    i = 0
    while i < len(sizes):
        end = min(i + most, max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + chars, "right"))))
        yield batch.slice(i, end - i)
        i = end


def places_of_files(batches):
    """Files (origin, path, text) as (term, origin, path, line, col), a row for each identifier."""
    for batch in batches:
        for run in _runs_of(batch, MOST_PLACES, BLOCK_FILES):
            terms, of, lines, cols = places_in(run.column("text"))
            for i in range(0, len(terms), MOST_PLACES // 4):
                part = slice(i, i + MOST_PLACES // 4)
                take = pa.array(of[part])
                numbers = [pa.array(x[part].astype(np.int32)) for x in (lines, cols)]
                yield pa.RecordBatch.from_arrays([terms.slice(i, MOST_PLACES // 4).cast(pa.string()), run.column("origin").take(take), run.column("path").take(take), *numbers], ["term", "origin", "path", "line", "col"])


def _order(codes: np.ndarray, n: int) -> np.ndarray:
    """A stable order of codes below ``n``, by digits of 16 bits, which numpy sorts in linear time."""
    order = np.argsort((codes & 0xFFFF).astype(np.uint16), kind="stable")
    return order if n <= 1 << 16 else order[np.argsort((codes >> 16).astype(np.uint16)[order], kind="stable")]


def _blocks(batches):
    """Files (origin, path, text, _part) in blocks: each file's row, and one for each term of the block."""
    fields = ["kind", "term", "origin", "path", "block", "ord", "n", "places"]
    types = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
    number = -1
    files: list = []
    rows = chars = 0

    def row(size: int, **cells):
        return pa.RecordBatch.from_arrays([cells[f] if f in cells else pa.nulls(size, t) for f, t in zip(fields, types)], fields)

    def done():
        column = lambda c: pa.concat_arrays([x.column(c) for x in files])
        block = files[0].column("_part")[0].as_py() << 20 | number
        kind = lambda k, size: {"kind": pa.array(np.full(size, k, np.int32)), "block": pa.array(np.full(size, block, np.int64))}
        yield row(rows, **kind(0, rows), origin=column("origin"), path=column("path"), ord=pa.array(np.arange(rows, dtype=np.int32)))
        terms, of, lines, cols = places_in(column("text"))
        if len(terms):
            names = terms.dictionary_encode()
            # By term, so that the rows of a task are a run of sorted ones for each block.
            by_term = pc.sort_indices(names.dictionary)
            rank = np.empty(len(by_term), np.int32)
            rank[by_term.to_numpy()] = np.arange(len(by_term), dtype=np.int32)
            g = rank[names.indices.to_numpy()]
            order = _order(g, len(rank))
            g = g[order]
            data, at = coded(g, of[order], lines[order], cols[order])
            first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            found = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(data)])
            yield row(len(first), **kind(1, len(first)), term=names.dictionary.take(by_term).cast(pa.string()), n=pa.array(np.diff(np.append(first, len(g)))), places=found)

    for batch in batches:
        sizes = pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_pylist()
        begin = 0
        for i, size in enumerate(sizes):
            if rows and (rows == BLOCK_FILES or chars + size > BLOCK_CHARS):
                if i > begin:
                    files.append(batch.slice(begin, i - begin))
                yield from done()
                files, rows, chars, begin = [], 0, 0, i
            number += not rows
            rows, chars = rows + 1, chars + size
        if len(sizes) > begin:
            files.append(batch.slice(begin))
    if files:
        yield from done()


def _portions(n: np.ndarray, coded_rows):
    """Coded rows in portions of about MOST_PLACES places: (row of each place, places)."""
    bounds = np.cumsum(n)
    at = 0
    while at < len(n):
        end = max(at + 1, int(np.searchsorted(bounds, (bounds[at - 1] if at else 0) + MOST_PLACES, "right")))
        yield np.repeat(np.arange(at, end), n[at:end]), decoded(coded_rows.slice(at, end - at).to_pylist(), n[at:end])
        at = end


def _opened(batch):
    """The rows (term, block, n, places, gone) of a batch in portions: (row of each place, places, whether its file is in ``gone``)."""
    blocks, first, which = np.unique(batch.column("block").to_numpy(), return_index=True, return_inverse=True)
    lists = [x or [] for x in batch.column("gone").take(pa.array(first)).to_pylist()]
    width = 1 + max((max(x) for x in lists if x), default=-1)
    table = np.zeros((len(blocks), width + 1), bool)
    for k, x in enumerate(lists):
        table[k, x] = True
    for row, found in _portions(batch.column("n").to_numpy(), batch.column("places")):
        yield row, found, table[which[row], np.minimum(found[:, 0], width)]


def _lost(batches):
    """Rows (term, block, n, places, gone) as (term, n): minus the number of places in ``gone``."""
    for batch in batches:
        for row, _, gone in _opened(batch):
            which, n = np.unique(row[gone], return_counts=True)
            yield pa.RecordBatch.from_arrays([batch.column("term").take(pa.array(which)), pa.array(-n.astype(np.int64))], ["term", "n"])


def _located(emit, names: list[str]):
    """Rows (block, kind, ord, origin, path, term, n, places) by block, its files (kind 0) before its coded rows, to what ``emit`` makes of the places.

    ``emit(row, file, found)`` gets for each place its row and its file within the block, and returns which of them to put
    out. Places of files that aren't there are left out.
    """

    def run(batches):
        own, ords, names_of = None, [], []
        for batch in batches:
            blocks, kinds = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
            edge = np.flatnonzero((blocks[1:] != blocks[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for a, b in zip([0, *edge], [*edge, len(blocks)]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if blocks[a] != own:
                    own, ords, names_of, at_ord = blocks[a], [], [], None
                if kinds[a] == 0:
                    ords.append(part.column("ord").to_numpy())
                    names_of.append(part.select(["origin", "path"]))
                    at_ord = None
                    continue
                if not ords:
                    continue
                if at_ord is None:
                    known, every = np.concatenate(ords), pa.Table.from_batches(names_of).combine_chunks()
                    at_ord = np.full(int(known.max()) + 2, -1, np.int64)
                    at_ord[known] = np.arange(len(known))
                    pairs: dict = {}
                    path_of = np.array([pairs.setdefault(p, len(pairs)) for p in zip(*(every.column(c).to_pylist() for c in ("origin", "path")))])
                for row, found in _portions(part.column("n").to_numpy(), part.column("places")):
                    file = at_ord[np.minimum(found[:, 0], len(at_ord) - 1)]
                    live = np.flatnonzero(file >= 0)
                    live = live[emit(row[live], path_of[file[live]], found[live])]
                    for x in range(0, len(live), MOST_PLACES // 4):
                        some = live[x : x + MOST_PLACES // 4]
                        take = pa.array(file[some])
                        cells = {"term": part.column("term").take(pa.array(row[some])), "line": pa.array(found[some, 1].astype(np.int32)), "col": pa.array(found[some, 2].astype(np.int32))}
                        cells |= {c: every.column(c).chunk(0).take(take) for c in ("origin", "path")}
                        yield pa.RecordBatch.from_arrays([cells[c] for c in names], names)

    return run


def _all(row, path, found) -> np.ndarray:
    return np.arange(len(row))


def _first_lines(row, path, found) -> np.ndarray:
    """Of each term and path the place with the smallest line."""
    key = row * (int(path.max(initial=0)) + 1) + path
    order = np.lexsort((found[:, 1], key))
    return order[np.append(True, key[order][1:] != key[order][:-1])] if len(order) else order


def _kept(batches):
    """Rows (term, block, n, places, gone) coded again without the places of gone files; rows that have none left go."""
    schema = pa.schema([("term", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("places", pa.binary())])
    for batch in batches:
        for row, found, gone in _opened(batch):
            row, found = row[~gone], found[~gone]
            if not len(row):
                continue
            data, at = coded(row, *found.T)
            which, n = np.unique(row, return_counts=True)
            take = pa.array(which)
            yield pa.RecordBatch.from_arrays([batch.column("term").take(take), batch.column("block").take(take), pa.array(n), pa.array([data[x:y] for x, y in zip(at[:-1], at[1:])], pa.binary())], schema=schema)


# --- segments ---


def _fs(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(folder).getFileSystem(spark._jsc.hadoopConfiguration()), path


def manifest(spark: SparkSession, folder: str) -> tuple[int, list[str]]:
    """(version, segments) of the newest manifest; version 0 without one."""
    fs, path = _fs(spark, folder)
    there = path(f"{folder}/manifests")
    names = [s.getPath().getName() for s in fs.listStatus(there)] if fs.exists(there) else []
    versions = [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]
    if not versions:
        return 0, []
    text = spark.read.text(f"{folder}/manifests/{max(versions)}.json", wholetext=True).first()[0]
    return max(versions), json.loads(text)["segments"]


def _publish(spark: SparkSession, folder: str, version: int, segments: list[str]) -> None:
    """Put the manifest of ``version`` in place by one rename; an error if another one has come first."""
    fs, path = _fs(spark, folder)
    draft, final = path(f"{folder}/manifests/_{uuid.uuid4().hex}"), path(f"{folder}/manifests/{version}.json")
    out = fs.create(draft)
    out.write(bytearray(json.dumps({"segments": segments}).encode()))
    out.close()
    if fs.exists(final) or not fs.rename(draft, final):
        raise OSError(f"{folder} has been changed meanwhile")


def _none(spark: SparkSession, schema: str) -> DataFrame:
    """No rows, which the optimizer knows of."""
    return spark.range(0).select(*[F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in schema.split(", "))])


def _read(spark: SparkSession, folder: str, segments: list[str], part: str, schema: str) -> DataFrame:
    found = [f"{folder}/segments/{s}/{part}" for s in segments]
    return spark.read.schema(schema).parquet(*found) if found else _none(spark, schema)


def _coded_rows(spark: SparkSession, folder: str, segments: list[str]) -> DataFrame:
    return _read(spark, folder, segments, "postings", POSTINGS).where("term is not null")


def _gone(dead: DataFrame) -> DataFrame:
    """(block, gone): the dead files of each block, BLOCK_FILES at most."""
    return dead.groupBy("block").agg(F.collect_set("ord").alias("gone"))


def _named(rows: DataFrame, names: DataFrame, how: str) -> DataFrame:
    """``rows`` (origin, path, …) joined to ``names`` (origin, path, …), nulls being equal."""
    keys = names.withColumnsRenamed({"origin": "_origin", "path": "_path"})
    return rows.join(keys, F.col("origin").eqNullSafe(F.col("_origin")) & F.col("path").eqNullSafe(F.col("_path")), how).drop("_origin", "_path")


class TermIndex:
    """Reads what the newest manifest lists; made anew after a refresh."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.version, self.segments = manifest(spark, folder)

    def _part(self, part: str, schema: str) -> DataFrame:
        return _read(self.spark, self.folder, self.segments, part, schema)

    def files(self) -> DataFrame:
        """(origin, path, stamp, block, ord) of the live files."""
        return self._part("files", FILES).join(self._part("dead", DEAD), ["block", "ord"], "left_anti").select("origin", "path", "stamp", "block", "ord")

    def terms(self) -> DataFrame:
        """(term, n) of the terms of live files. A filter on term reads the files of its range only."""
        found = self._part("terms", TERMS)
        return found.groupBy("term").agg(F.sum("n").alias("n")).where("n > 0")

    def coded_rows(self) -> DataFrame:
        """(term, block, n, places) of all segments. A filter on term reads the pages that have it only."""
        return _coded_rows(self.spark, self.folder, self.segments)

    def rows(self) -> DataFrame:
        """(term, block, n, places, gone): the coded rows with the dead files of their block."""
        return self.coded_rows().join(_gone(self._part("dead", DEAD)), "block", "left")

    def _by_block(self, emit, columns: str, keep=lambda rows: rows, files: DataFrame | None = None) -> DataFrame:
        """The places of the coded rows that ``keep`` leaves, in the live files or in ``files``, as ``columns`` (see ``_located``).

        The coded rows are dealt by block, a twentieth of what the places take, and meet the files of their block there.
        """
        form = {"ord": "int", "origin": "string", "path": "string", "term": "string", "n": "long", "places": "binary"}
        laid = lambda df, kind: df.select("block", F.lit(kind).alias("kind"), *[F.col(c) if c in df.columns else F.lit(None).cast(k).alias(c) for c, k in form.items()])
        files = (self.files() if files is None else files).select("block", "ord", "origin", "path")
        both = laid(files, 0).unionByName(laid(keep(self.coded_rows()), 1))
        return both.repartition("block").sortWithinPartitions("block", "kind", "ord").mapInArrow(_located(emit, [c.split()[0] for c in columns.split(", ")]), columns)

    def postings(self, keep=lambda rows: rows) -> DataFrame:
        """(term, origin, path, line, col); ``keep`` chooses among the coded rows by term or block before they are decoded."""
        return self._by_block(_all, "term string, origin string, path string, line int, col int", keep)

    def symbols(self) -> DataFrame:
        """(origin, path, term, line): the terms of each file with the line each first stands in.

        That is settled within a block; only paths whose rows lie in several blocks are grouped again.
        """
        form = "origin string, path string, term string, line int"
        live = staged(self.files().select("origin", "path", "block", "ord"), "term-files")
        several = live.groupBy("origin", "path").agg(F.min("block").alias("_a"), F.max("block").alias("_b")).where("_a <> _b")
        several = staged(_named(live, several, "left_semi"), "term-files-several")
        whole = self._by_block(_first_lines, form, files=_named(live, several.select("origin", "path").distinct(), "left_anti"))
        parts = self._by_block(_first_lines, form, lambda rows: rows.join(several.select("block").distinct(), "block", "left_semi"), several)
        return whole.unionByName(parts.groupBy("origin", "path", "term").agg(F.min("line").alias("line")))

    def of_term(self, term: str) -> DataFrame:
        return self.postings(lambda rows: rows.where(F.col("term") == term))

    def of_paths(self, paths: DataFrame) -> DataFrame:
        """``postings`` of the files with ``paths`` (path): only the rows of their blocks are decoded."""
        files = self.files().join(paths.select("path").distinct(), "path", "left_semi")
        blocks = files.select("block").distinct()
        return self._by_block(_all, "term string, origin string, path string, line int, col int", lambda rows: rows.join(blocks, "block", "left_semi"), files)


def stamped(files: DataFrame, stamp=None) -> DataFrame:
    """(origin, path, stamp) a path: what tells whether a file has changed.

    ``stamp``: a column such as a time of change with the size; without one the texts are read and hashed. Rows of one
    path are one file whose stamp is the sum of theirs.
    """
    own = F.xxhash64("text") if stamp is None else F.xxhash64(stamp)
    total = F.sum(own.cast("decimal(20,0)"))
    return files.groupBy("origin", F.col("rel_path").alias("path")).agg(F.xxhash64(total, F.count("*")).alias("stamp"))


def refresh(spark: SparkSession, folder: str, files: DataFrame, stamp=None, parts: int | None = None) -> DataFrame:
    """Bring the index up to ``files`` (origin, rel_path, text): (origin, sign, n) of what was added (+), changed (~) and gone (_).

    Only texts of added and changed files are read (and hashed, if there is no ``stamp``). Nothing is written if nothing
    has changed.
    """
    index = TermIndex(spark, folder)
    named = lambda df: df.select(F.struct("origin", "path").alias("file"), "stamp")
    now = staged(stamped(files, stamp), "term-stamps")
    # The rows of a path have one stamp, so one stands for it.
    live = index.files().select("origin", "path", "stamp").distinct()
    diff = staged(snapshot_diff(named(live), named(now), "file", ["stamp"]).select("file.origin", "file.path", "sign"), "term-diff")
    told = diff.groupBy("origin", "sign").agg(F.count("*").alias("n"))
    if diff.isEmpty():
        return told
    segment = uuid.uuid4().hex
    base = f"{folder}/segments/{segment}"
    changed = files.select("origin", F.col("rel_path").alias("path"), "text")
    if index.segments:
        changed = _named(changed, diff.where("sign <> '_'").select("origin", "path"), "left_semi")
    # A path of very many rows is dealt to several tasks.
    order = ["origin", "path", "_spread"]
    ranged = changed.withColumn("_spread", F.pmod(F.monotonically_increasing_id(), F.lit(64)))
    ranged = (ranged.repartitionByRange(parts, *order) if parts else ranged.repartitionByRange(*order)).sortWithinPartitions(*order)
    form = "kind int, term string, origin string, path string, block long, ord int, n long, places binary"
    # Versions only rise, so the blocks of all segments differ: 23 bits of version, 20 of task, 20 of block.
    made = ranged.withColumn("_part", F.lit((index.version + 1) << 20) + F.spark_partition_id()).select("origin", "path", "text", "_part").mapInArrow(_blocks, form)
    # Coded rows stay where they are made: to deal them by term would write, shuffle and sort all of them once more.
    made.drop("kind").sortWithinPartitions("term", "block").write.parquet(f"{base}/postings")
    # The stamps meet the paths here, so that no text is shuffled for them.
    names = _read(spark, folder, [segment], "postings", "term string, origin string, path string, block long, ord int").where("term is null")
    stamps = _named(names.drop("term"), now, "inner")
    stamps.select("origin", "path", "stamp", "block", "ord").write.parquet(f"{base}/files")
    gone = _named(index.files(), diff.where("sign <> '+'").select("origin", "path"), "left_semi").select("block", "ord")
    dead = staged(gone, "term-dead")
    dead.write.parquet(f"{base}/dead")
    # What the dead files had is taken from the counts; of the older segments only their blocks are decoded.
    old = index.coded_rows().join(_gone(dead), "block")
    less = old.select("term", "block", "n", "places", "gone").mapInArrow(_lost, TERMS)
    # Each file of the postings has a term's blocks of its task together, which one partial sum takes in.
    counts = _coded_rows(spark, folder, [segment]).select("term", "n").unionByName(less).groupBy("term").agg(F.sum("n").alias("n"))
    counts.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{base}/terms")
    _publish(spark, folder, index.version + 1, [*index.segments, segment])
    return told


def merge(spark: SparkSession, folder: str) -> None:
    """All segments as one without dead files and places; the texts aren't read. Old segments stay until ``vacuum``."""
    index = TermIndex(spark, folder)
    segment = uuid.uuid4().hex
    base = f"{folder}/segments/{segment}"
    rows = index.rows().select("term", "block", "n", "places", "gone")
    # Rows of blocks without dead files stay as they are coded.
    kept = staged(rows.where("gone is null").drop("gone").unionByName(rows.where("gone is not null").mapInArrow(_kept, POSTINGS)), "term-kept")
    kept.repartitionByRange("term", "block").sortWithinPartitions("term", "block").write.parquet(f"{base}/postings")
    index.files().write.parquet(f"{base}/files")
    index.terms().repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{base}/terms")
    _none(spark, DEAD).write.parquet(f"{base}/dead")
    _publish(spark, folder, index.version + 1, [segment])


def vacuum(spark: SparkSession, folder: str) -> int:
    """Delete segments that the newest manifest doesn't list; how many. Not to be called while others read or refresh."""
    fs, path = _fs(spark, folder)
    keep = set(manifest(spark, folder)[1])
    there = path(f"{folder}/segments")
    old = [s.getPath() for s in fs.listStatus(there) if s.getPath().getName() not in keep] if fs.exists(there) else []
    return sum(bool(fs.delete(p, True)) for p in old)
