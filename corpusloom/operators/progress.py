"""Progress and status of jobs, as batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.ordered import with_adjacent, with_last

#: Fixed value: a log line with this text counts as one file done.
DONE_MARKER = "extracting tags of "
#: How long a status is shown, in milliseconds.
STATUS_TTL_MS = {"skipped": 1200, "indexed": 1500, "built": 2000, "ended": 2500, "failed": 3000}


def index_summary(files: DataFrame) -> DataFrame:
    """(origin, n_files, message), a row an origin."""
    counts = files.groupBy("origin").agg(F.count("*").alias("n_files"))
    return counts.withColumn("message", F.format_string("index generated (%s=%d)", "origin", "n_files"))


def n_lines(text: Column) -> Column:
    """Lines of a text; a final line feed adds none, an empty or null text has none."""
    body = F.coalesce(text, F.lit(""))
    feeds = F.length(body) - F.length(F.translate(body, "\n", ""))
    return F.when(body == "", F.lit(0)).otherwise(feeds + (~body.endswith("\n")).cast("int")).cast("long")


def line_counts(files: DataFrame) -> DataFrame:
    return files.select("origin", F.col("rel_path").alias("path"), n_lines(F.col("text")).alias("n_lines"))


def progress(jobs: DataFrame, by: str, done: Column, ts: str, total: Column) -> DataFrame:
    """(by, processed, total, pct, rate, seconds) of each job: rounded down per cent, 0 without a total; at least a millisecond."""
    micros = F.unix_micros(F.max(F.col(ts).cast("timestamp"))) - F.unix_micros(F.min(F.col(ts).cast("timestamp")))
    sums = jobs.groupBy(by).agg(F.sum(done.cast("long")).alias("processed"), F.sum(total.cast("long")).alias("total"), micros.alias("_us"))
    sec = F.greatest(F.col("_us") / 1e6, F.lit(0.001))
    return sums.select(by, "processed", "total", F.when(F.col("total") > 0, F.floor(F.col("processed") * 100.0 / F.col("total"))).otherwise(F.lit(0)).cast("long").alias("pct"), (F.col("processed") / sec).alias("rate"), F.floor(sec).cast("long").alias("seconds"))


def count_marked_lines(lines: DataFrame, marker: str = DONE_MARKER, *by: str) -> DataFrame:
    """How many lines hold the literal marker."""
    return lines.groupBy(*by).agg(F.sum(F.contains("text", F.lit(marker)).cast("long")).alias("n_marked"))


def size_stats(files: DataFrame) -> DataFrame:
    """Bytes by origin; a missing text has none."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return files.groupBy("origin").agg(F.sum(size).alias("n_bytes"), F.max(size).alias("most_bytes"), F.count("*").alias("n_files"))


def carry_last_nonzero(samples: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """``samples`` with shown: the value, or where it is 0 the last one that wasn't."""
    return with_last(samples, [by], order, F.nullif(F.col(value), F.lit(0).cast("double")), "shown")


def status_intervals(status: DataFrame, by: str, order: list[str], ts: str, ttl: str = f"{STATUS_TTL_MS['indexed']} MILLISECONDS") -> DataFrame:
    """``status`` with until: the next status of the job, or the end of ``ttl`` (an interval as text), whichever is first."""
    led = with_adjacent(status, [by], order, ts, after="_next", before="_previous")
    return led.select(*status.columns, F.least(F.col("_next"), F.col(ts) + F.expr(f"INTERVAL {ttl}")).alias("until"))


def current_status(status: DataFrame, by: str, ts: str, tie: str, value: str) -> DataFrame:
    """The latest status of each job; of equal times the highest ``tie``."""
    return status.groupBy(by).agg(F.max_by(value, F.struct(ts, tie)).alias("status"), F.max(ts).alias("ts"))
