"""Trees of files as a data source: hidden names included, links followed, loops left out.

Spark's own file sources skip names that begin with a dot or an underscore.
Here the driver lists directories from the root on only until there are enough
of them; then each is walked by a task of its own, which also reads the files.
Files that the driver has met on its way are dealt out in portions. Paths are
those of any file system that Arrow opens by its address (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Directories that are enough for the driver to stop listing; files of a portion; bytes of a batch at most, but for a single larger file.
ENOUGH, PORTION, BATCH_BYTES = 256, 1000, 16 << 20
SCHEMA = "rel_path string, length long, mtime timestamp, content binary"


def opened(root: str):
    """(file system, path) of an address or a plain local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else "file://" + os.path.abspath(root).replace("%", "%25").replace(" ", "%20").replace("#", "%23").replace("?", "%3F"))


def _loops(system, path: str, at: str) -> bool:
    """Whether a directory is a link to itself or to a directory that it lies in."""
    if system.type_name != "local" or not os.path.islink(path):
        return False
    real, here = os.path.realpath(path), os.path.realpath(at)
    return here == real or here.startswith(real.rstrip("/") + "/")


def _listed(system, directory: str):
    """(files, directories) of a directory in order of their names; what can't be read is left out."""
    from pyarrow import fs

    try:
        found = sorted(system.get_file_info(fs.FileSelector(directory, recursive=False)), key=lambda i: i.path)
    except (OSError, PermissionError):
        return [], []
    return [i for i in found if i.type == fs.FileType.File], [i.path for i in found if i.type == fs.FileType.Directory and not _loops(system, i.path, directory)]


class Part(InputPartition):
    """Files to read, or a directory to walk."""

    def __init__(self, files: list[tuple], directory: str | None):
        self.files, self.directory = files, directory


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.root, self.texts = options["root"], options.get("content", "true") == "true"

    def partitions(self) -> list[Part]:
        system, root = opened(self.root)
        level, files = [root], []
        while level and len(level) < ENOUGH:
            below = []
            for directory in level:
                own, inner = _listed(system, directory)
                files += [(i.path, i.size, i.mtime_ns) for i in own]
                below += inner
            level = below
        found = [Part(files[i : i + PORTION], None) for i in range(0, len(files), PORTION)] + [Part([], d) for d in level]
        return found or [Part([], None)]

    def _walk(self, system, part: Part) -> Iterator[tuple]:
        yield from part.files
        todo = [part.directory] if part.directory else []
        while todo:
            own, inner = _listed(system, todo.pop())
            yield from ((i.path, i.size, i.mtime_ns) for i in own)
            todo += inner

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        system, root = opened(self.root)
        types = [pa.string(), pa.int64(), pa.timestamp("us", tz="UTC"), pa.binary()]
        rows, size = [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["rel_path", "length", "mtime", "content"])

        for path, length, mtime in self._walk(system, part):
            content = None
            if self.texts:
                try:
                    with system.open_input_stream(path) as stream:
                        content = stream.read()
                except OSError:  # gone meanwhile, or not to be read
                    continue
            rows.append((path[len(root.rstrip("/")) + 1 :], length, (mtime or 0) // 1000, content))
            size += len(content or b"") + 200
            if size > BATCH_BYTES:
                yield batch()
                rows, size = [], 0
        if rows:
            yield batch()


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "corpus_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def scan_tree(spark: SparkSession, root: str, origin: str = "project", content: bool = True) -> DataFrame:
    """(origin, root, rel_path, text, length, mtime) of every regular file below ``root``.

    Links are followed, so a file can come by several paths; a link to a directory that it lies in is not. Unreadable
    files and directories are left out. Without ``content`` files are listed only and text is null. Bytes that are no
    UTF-8 become replacement characters. An empty tree gives no rows.
    """
    spark.dataSource.register(TreeSource)
    found = spark.read.format("corpus_tree").option("root", root).option("content", str(content).lower()).load()
    return found.select(F.lit(origin).alias("origin"), F.lit(root).alias("root"), "rel_path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"), "length", "mtime")


def write_tree(files: DataFrame, root: str) -> DataFrame:
    """Write each of ``files`` (rel_path, text) below ``root`` and return (rel_path) of those written; run by whoever reads the result.

    A path that occurs again is written again; null texts and paths are left out.
    """

    def put(batches):
        system, base = opened(root)
        for b in batches:
            for path, text in zip(b.column("rel_path").to_pylist(), b.column("text").to_pylist()):
                target = f"{base}/{path}"
                system.create_dir(target.rpartition("/")[0], recursive=True)
                with system.open_output_stream(target) as out:
                    out.write(text.encode())
            yield b.select(["rel_path"])

    return files.where("rel_path is not null and text is not null").select("rel_path", "text").mapInArrow(put, "rel_path string")
