"""A stored index that answers grep: which blocks of files can hold a match, by the trigrams of their lines.

The files are stored in blocks of neighbouring paths, a partition each. For
every trigram of their lines, upper-case ASCII letters as lower-case ones, the
index has one row with the blocks that have it. A search turns its pattern into
literals that a match must hold, these into trigrams, reads the rows of these
trigrams only, combines their blocks by AND and OR, and greps the files of the
blocks that are left; a pattern that asks for nothing reads all blocks.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import grep as G
from corpusloom.operators.literals import Need, required
from corpusloom.sources.corpus import COLUMNS

#: Bytes of text in a block, about; fewest and most blocks. So a trigram's row has at most MOST_BLOCKS numbers.
BLOCK_BYTES, LEAST_BLOCKS, MOST_BLOCKS = 256 << 20, 64, 20_000
#: Characters that trigrams are made of at a time; trigrams that a search asks for at most, the first ones of its literals.
PIECE, MOST_GRAMS = 1 << 18, 96
#: Trigrams that a task holds at a time, about.
MOST_HELD = 1 << 20
FILES, GRAMS = "origin string, root string, rel_path string, text string, block int", "gram long, blocks array<int>"


def _grams(text: str) -> np.ndarray:
    """The distinct trigrams of a text's lines as numbers of 63 bits."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    points = np.where((points >= 65) & (points <= 90), points + 32, points)
    if len(points) < 3:
        return np.zeros(0, np.int64)
    a, b, c = points[:-2], points[1:-1], points[2:]
    return np.unique(((a << 42) | (b << 21) | c)[(a != 10) & (b != 10) & (c != 10)])


def _block_grams(batches):
    """(block, gram) of a task's texts; about MOST_HELD grams are held, so some pairs may come twice. Texts of any length in pieces that overlap."""
    own, held, size = None, [], 0

    def out(grams):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), own, np.int32)), pa.array(grams)], ["block", "gram"])

    for batch in batches:
        for block, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            if held and block != own:
                yield out(np.unique(np.concatenate(held)))
                held, size = [], 0
            own, text = block, text.as_py() or ""
            for at in range(0, len(text), PIECE):
                held.append(_grams(text[at : at + PIECE + 2]))
                size += len(held[-1])
                if size > MOST_HELD:
                    held = [np.unique(np.concatenate(held))]
                    if len(held[0]) > MOST_HELD // 2:
                        yield out(held[0])
                        held = []
                    size = sum(map(len, held))
    if held:
        yield out(np.unique(np.concatenate(held)))


def write_index(files: DataFrame, folder: str, block_bytes: int = BLOCK_BYTES) -> None:
    """Store ``files`` (origin, root, rel_path, text) in blocks below ``folder``, and the blocks of each trigram.

    Files with one path may be of several blocks, so no path makes a block large. Null texts are kept; they match nothing.
    """
    size = files.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = min(MOST_BLOCKS, max(LEAST_BLOCKS, -(-size // block_bytes)))
    spread = F.pmod(F.monotonically_increasing_id(), F.lit(1024))
    blocked = files.select(*COLUMNS, spread.alias("_spread")).repartitionByRange(n, "origin", "rel_path", "_spread").drop("_spread").withColumn("block", F.spark_partition_id())
    blocked.write.mode("overwrite").partitionBy("block").option("compression", "zstd").parquet(f"{folder}/files")
    grams = stored_files(files.sparkSession, folder).select("block", "text").mapInArrow(_block_grams, "block int, gram long")
    rows = grams.groupBy("gram").agg(F.array_sort(F.collect_set("block")).alias("blocks"))
    rows.repartitionByRange("gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{folder}/grams")


def _asked(need: Need, grams: list[int]) -> Need:
    """The need with each literal as the AND of its trigrams; ``grams`` gathers them. Those beyond MOST_GRAMS aren't asked for."""
    if need is True:
        return True
    if isinstance(need, str):
        own = [int(g) for g in _grams(need.replace("\n", "\0\0"))]
        for g in own:
            if g not in grams and len(grams) < MOST_GRAMS:
                grams.append(g)
        own = [g for g in own if g in grams]
        return ("and", *own) if own else True
    parts = [_asked(x, grams) for x in need[1:]]
    if need[0] == "or":
        return True if True in parts else ("or", *parts)
    kept = [p for p in parts if p is not True]
    return ("and", *kept) if kept else True


def _holds(need: Need, grams: Column) -> Column:
    if isinstance(need, int) and not isinstance(need, bool):
        return F.array_contains(grams, F.lit(need).cast("long"))
    return reduce((lambda a, b: a & b) if need[0] == "and" else (lambda a, b: a | b), [_holds(x, grams) for x in need[1:]])


def matching_blocks(spark: SparkSession, folder: str, pattern: str) -> DataFrame | None:
    """(block) of the blocks that can hold a match; None if the pattern asks for nothing.

    Only the rows of the pattern's trigrams are read: the filter on gram reaches the sorted files.
    """
    grams: list[int] = []
    need = _asked(required(G.checked(spark, pattern))[0], grams)
    if need is True:
        return None
    found = spark.read.schema(GRAMS).parquet(f"{folder}/grams").where(F.col("gram").isin(grams))
    each = found.select("gram", F.explode("blocks").alias("block")).groupBy("block").agg(F.collect_set("gram").alias("_grams"))
    return each.where(_holds(need, F.col("_grams"))).select("block")


def stored_files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(FILES).parquet(f"{folder}/files")


def grep(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """The hits of ``grep`` over the stored files. Of the files only the blocks named by the index are read.

    The blocks, at most MOST_BLOCKS numbers, are broadcast; Spark prunes the partitions by them.
    """
    files = stored_files(spark, folder)
    if pattern and (blocks := matching_blocks(spark, folder, pattern)) is not None:
        files = files.join(F.broadcast(blocks), "block", "left_semi")
    return G.grep(files.select(COLUMNS), pattern)
