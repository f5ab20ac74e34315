"""The corpus: documents of two roots as one DataFrame, its lines and its stored index."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import paths
from corpusloom.operators.rules import is_code
from corpusloom.sources.tables import table

PROJECT, ENGINE = "project", "engine"
COLUMNS = ["origin", "root", "rel_path", "text"]


def project_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as files lang/source/doc_id.txt of the project root."""
    path = F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return table(spark, sf_dir, "documents").select(F.lit(PROJECT).alias("origin"), F.lit("/project").alias("root"), path.alias("rel_path"), "text")


def engine_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` as files of the engine root, by host and path of their address."""
    path = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", ""), r"[?#].*$", "")
    return table(spark, sf_dir, "pages").select(F.lit(ENGINE).alias("origin"), F.lit("/engine").alias("root"), path.alias("rel_path"), F.col("html").alias("text"))


def union_roots(project: DataFrame | None, engine: DataFrame | None, fallback: DataFrame | None = None) -> DataFrame:
    """Both roots as one corpus; where they can't be resolved, ``fallback`` alone."""
    if project is None or engine is None:
        if fallback is None:
            raise ValueError("no roots and nothing to fall back to")
        return fallback.select(COLUMNS)
    return project.select(COLUMNS).unionByName(engine.select(COLUMNS))


def scan_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(origin, root, rel_path, text) of all files of both roots."""
    return union_roots(project_files(spark, sf_dir), engine_files(spark, sf_dir))


def scan_files(spark: SparkSession, root: str, origin: str = PROJECT) -> DataFrame:
    """The same from a tree of files. Names that begin with a dot or an underscore are not seen: Spark's sources skip them.

    Bytes that are no UTF-8 become replacement characters, so one odd file doesn't stop the scan.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(_escaped(root))
    bare = lambda c: F.regexp_replace(c, "^[a-z][a-z0-9+.-]*:/*", "/")
    base = bare(F.lit(root.rstrip("/"))) if ":" in root else F.lit(root.rstrip("/"))
    path = F.regexp_replace(bare(F.col("path")), "%(?![0-9A-Fa-f]{2})", "%25")
    path = F.when(F.startswith(bare(F.col("path")), base), bare(F.col("path"))).otherwise(F.url_decode(F.regexp_replace(path, r"\+", "%2B")))
    rel = F.when(F.startswith(path, F.concat(base, F.lit("/"))), F.substring(path, F.length(base) + 2, F.length(path))).otherwise(path)
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return found.select(F.lit(origin).alias("origin"), F.lit(root).alias("root"), rel.alias("rel_path"), text.alias("text"), F.col("length"), F.col("modificationTime").alias("mtime"))


def _escaped(folder: str) -> str:
    """A folder's name as a path pattern that matches it alone."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", folder)


def restrict_paths(files: DataFrame, prefixes: list[str]) -> DataFrame:
    """Files within the given sub-trees."""
    return files.where(reduce(lambda a, b: a | b, [F.startswith("rel_path", F.lit(p.rstrip("/") + "/")) for p in prefixes], F.lit(False)))


def with_abs_path(files: DataFrame) -> DataFrame:
    return files.withColumn("abs_path", F.concat_ws("/", "root", paths.norm_path(F.col("rel_path"))))


def file_list(files: DataFrame) -> DataFrame:
    """The index: every file's paths, and whether it is code. Texts aren't read."""
    return with_abs_path(files).select("origin", "rel_path", "abs_path", is_code(F.col("rel_path")).alias("is_code"))


def write_index(files: DataFrame, folder: str) -> None:
    """Store the index by origin and is_code; the five lists are reads of some of these partitions."""
    file_list(files).write.mode("overwrite").partitionBy("origin", "is_code").parquet(folder)


LISTS = {
    "all": "true",
    "project": "origin = 'project'",
    "engine": "origin = 'engine'",
    "code_project": "origin = 'project' AND is_code",
    "code_engine": "origin = 'engine' AND is_code",
}


def read_list(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the five lists; only its partitions are read. Code lists have root-relative paths."""
    rows = spark.read.parquet(folder).where(LISTS[name])
    return rows.select("origin", F.col("rel_path" if name.startswith("code") else "abs_path").alias("path"))


def _filesystem(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def index_exists(spark: SparkSession, folder: str) -> bool:
    fs, path = _filesystem(spark, folder + "/_SUCCESS")
    return fs.exists(path)


def replace_folder(spark: SparkSession, new: str, old: str) -> None:
    """Put ``new`` in the place of ``old``, which is kept aside until then and goes last."""
    fs, path = _filesystem(spark, old)
    aside = _filesystem(spark, old + ".aside")[1]
    if fs.exists(path):
        fs.delete(aside, True)
        if not fs.rename(path, aside):
            raise OSError(f"{old} could not be put aside")
    if not fs.rename(_filesystem(spark, new)[1], path):
        raise OSError(f"{new} could not be renamed; what was there is in {aside}")
    fs.delete(aside, True)


def read_index_or_scan(spark: SparkSession, folder: str, scan) -> DataFrame:
    """The stored index if there is one, else the list of what ``scan()`` finds."""
    columns = ["origin", "rel_path", "abs_path", "is_code"]
    return (spark.read.parquet(folder) if index_exists(spark, folder) else file_list(scan())).select(columns)


def drop_index(spark: SparkSession, folders: dict[str, str]) -> DataFrame:
    """Delete derived artefacts, never sources: (artefact, removed)."""
    rows = []
    for name, folder in sorted(folders.items()):
        fs, path = _filesystem(spark, folder)
        rows.append((name, bool(fs.exists(path) and fs.delete(path, True))))
    return spark.createDataFrame(rows, "artefact string, removed boolean")


def read_lines(files: DataFrame) -> DataFrame:
    """Lines as framed by line feeds and returns, empty ones left out."""
    return files.select("origin", "rel_path", F.explode(F.split("text", r"[\r\n]+")).alias("text")).where("text <> ''")


def numbered_lines(files: DataFrame) -> DataFrame:
    """(origin, path, line, text): lines counted from 1, empty ones kept; a final line feed adds no line, an empty file has none."""
    body = F.regexp_replace("text", r"\n\z", "")
    return files.where("text <> ''").select("origin", F.col("rel_path").alias("path"), F.posexplode(F.split(body, "\n", -1)).alias("at", "text")).select("origin", "path", (F.col("at") + 1).alias("line"), "text")
