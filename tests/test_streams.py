"""Throttling within keys, and streams whose files overlap or come in any order, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.streaming import streams


def plain_throttle(rows, gap):
    last, out = {}, []
    for k, i, us in sorted(rows, key=lambda r: (r[2], r[1])):
        if k not in last or us - last[k] >= gap:
            out.append((k, i))
            last[k] = us
    return sorted(out, key=repr)


def plain_status(rows, ttl):
    out = []
    for k in {r[0] for r in rows}:
        burst = None
        for _, i, us in sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[1])):
            if burst and us >= burst[1] + ttl:
                out.append((k, *burst))
                burst = None
            burst = (burst[0] if burst else us, us, i)
        out.append((k, *burst))
    return sorted(((k, f"s{i}", a, b + ttl) for k, a, b, i in out), key=repr)


def frame(spark, rows):
    made = spark.createDataFrame(rows, "k string, i long, us long")
    return made.select("k", "i", F.timestamp_micros("us").alias("ts"), F.concat(F.lit("s"), "i").alias("status"))


def made(seed, n=600, span=20_000):
    rng = random.Random(seed)
    hot = lambda: rng.choice(["hot", "hot", "hot", "b", "c", None])
    return [(hot(), i, rng.randrange(span)) for i in range(n)]


@pytest.mark.parametrize(("seed", "gap", "block"), [(1, 1000, 7), (2, 50, 5), (3, 30_000, 4), (4, 1, 3), (5, 400, 2048), (6, 0, 16)])
def test_throttle_within_keys(spark, monkeypatch, seed, gap, block):
    """Keys are cut into blocks of a few rows over several ranges, so most emissions depend on what other tasks found."""
    monkeypatch.setattr(streams, "THROTTLE_BLOCK", block)
    rows = made(seed)
    got = streams.throttle(frame(spark, rows).repartition(5), "k", "i", gap).collect()
    assert sorted(((r.k, r.i) for r in got), key=repr) == plain_throttle(rows, gap)


def test_one_key_is_many_tasks(spark):
    """A table of one key: no task of the first stage has more than a share of its rows, and the steps gathered by key are few."""
    rng = random.Random(9)
    rows = [("k", i, rng.randrange(50_000_000)) for i in range(20_000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the table is small
    try:
        got = sorted(((r.k, r.i) for r in streams.throttle(frame(spark, rows), "k", "i", 3000).collect()), key=repr)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == plain_throttle(rows, 3000)
    base = streams.shared_dir(spark)
    blocks = spark.read.parquet(f"{base}/staged/throttle-blocks-*").where("_key = 'k'")
    found = blocks.groupBy("_part").agg(F.sum(F.size("us")).alias("n"), F.sum(F.size("exit")).alias("steps")).where("n > 100").collect()
    assert len(found) >= 4 and max(r.n for r in found) < 20_000 / 3 and sum(r.steps for r in found) < 200


def test_throttle_of_odd_keys(spark):
    nan = float("nan")
    rows = spark.createDataFrame([(nan, 1, 0), (nan, 2, 10), (None, 3, 0), (None, 4, 10), (1.5, 5, 0), (1.5, 6, 100), (1.5, 7, None)], "k double, i long, us long").select("k", "i", F.timestamp_micros("us").alias("ts"))
    assert sorted(r.i for r in streams.throttle(rows, "k", "i", 50).collect()) == [1, 3, 5, 6]
    nested = rows.select(F.struct("k").alias("k"), "i", "ts").where("k.k = 1.5")
    assert sorted(r.i for r in streams.throttle(nested, "k", "i", 50).collect()) == [5, 6]
    assert streams.throttle(rows.where("false"), "k", "i", 50).count() == 0


def stored(spark, tmp_path, parts):
    folder = str(tmp_path / "events")
    for part in parts:
        frame(spark, part).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.mark.parametrize("how", ["one file", "overlapping", "shuffled"])
def test_streams_equal_batch(spark, tmp_path, how):
    rows = made(11, n=150, span=40_000_000)
    ordered = sorted(rows, key=lambda r: r[2])
    parts = {"one file": [rows], "overlapping": [ordered[i : i + 60] for i in (0, 30, 90)], "shuffled": [rows[i::4] for i in range(4)]}[how]
    if how == "overlapping":
        parts = [ordered[0:40], ordered[30:100:2] + ordered[40:60], ordered[100:]]
    every = [r for p in parts for r in p]
    stream = stored(spark, tmp_path, parts)
    got = streams.play_out(stream, lambda s: streams.throttle_stream(s, "k", "i", 1_000_000, lateness="1 minute")).collect()
    assert sorted(((r.k, r.i) for r in got), key=repr) == plain_throttle(every, 1_000_000)
    shown = streams.play_out(stream, lambda s: streams.stream_status(s, "k", "status", "i", 700_000, lateness="1 minute"))
    micros = lambda c: F.unix_micros(c).alias(c)
    assert sorted((tuple(r) for r in shown.select("k", "status", micros("shown_from"), micros("shown_until")).collect()), key=repr) == plain_status(every, 700_000)


def test_a_timer_expires_a_status_while_the_stream_runs(spark, tmp_path):
    """A status is put out as soon as other rows move the watermark over its end, before the stream ends."""
    second = 1_000_000
    stream = stored(spark, tmp_path, [[("a", 1, 100 * second)], [("b", 2, 160 * second)], [("b", 3, 161 * second)]])
    found = streams.run_to_end(streams.stream_status(stream, "k", "status", "i", 5 * second, lateness="10 seconds"), "append").collect()
    assert [(r.k, r.status) for r in found] == [("a", "s1")]
