"""Live progress: running counts, throttling, debouncing, sampling, expiry."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.ordered import with_adjacent
from corpusloom.sources.tables import shared_dir, staged


def event_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    """``events`` as a stream, its times with a zone so that they can carry watermarks."""
    like = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{sf_dir}/event[s].parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def event_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def stream_progress(stream: DataFrame, by: str) -> DataFrame:
    """Running (by, n_events, last_ts), to be written in update or complete mode."""
    return stream.groupBy(by).agg(F.count("*").alias("n_events"), F.max("ts").alias("last_ts"))


def run_to_end(stream: DataFrame, mode: str, put=None) -> DataFrame:
    """Run a stream over what is there and return what it wrote, by a table in the shared folder.

    In complete mode each batch replaces the last, in append mode it adds a
    part of its own number, so a batch that is run again changes nothing.
    """
    spark = stream.sparkSession
    folder = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"

    def write(rows: DataFrame, batch: int) -> None:
        rows = put(rows) if put else rows
        target = f"{folder}/out" if mode == "complete" else f"{folder}/out/batch={batch}"
        rows.write.mode("overwrite").parquet(target)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    schema = put(spark.createDataFrame([], stream.schema)).schema if put else stream.schema
    found = spark.read.schema(schema).option("recursiveFileLookup", True)
    fs = spark._jvm.org.apache.hadoop.fs.Path(folder + "/out")
    there = fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs)
    return found.parquet(folder + "/out") if there else spark.createDataFrame([], schema)


#: Rows of a key that make one block of its throttling.
THROTTLE_BLOCK = 2048


def _step(times: np.ndarray, gap_us: int) -> np.ndarray:
    """For each row in order of time, the first row after it that may be emitted next; the number of rows if none."""
    return np.maximum(np.searchsorted(times, times + gap_us, "left"), np.arange(1, len(times) + 1))


def _exits(times: np.ndarray, gap_us: int) -> np.ndarray:
    """For each row, if it is emitted, the time of the last emission of its block."""
    after = _step(times, gap_us)
    last = np.where(after < len(times), after, np.arange(len(times)))
    while True:  # each turn doubles the steps, so a block takes a few
        moved = last[last]
        if (moved == last).all():
            return times[last]
        last = moved


def _same(a, b) -> bool:
    """Whether two keys are one: nulls are, and what is not a number."""
    return a == b or (a != a and b != b)


def _runs(column) -> list[tuple[int, int]]:
    """Starts and ends of runs of equal keys in an Arrow column."""
    import pyarrow as pa

    try:
        codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy()
        edge = np.flatnonzero(codes[1:] != codes[:-1]) + 1
    except (pa.ArrowNotImplementedError, pa.ArrowInvalid):  # nested keys
        keys = column.to_pylist()
        edge = [i for i in range(1, len(keys)) if not _same(keys[i], keys[i - 1])]
    return list(zip([0, *edge], [*edge, len(column)])) if len(column) else []


def _blocks(gap_us: int):
    """Sorted rows (key, tie, ts, us) as blocks of one key: the rows, and what the block does to the time of the last emission.

    ``upto`` and ``exit``: if nothing before ``upto`` may be emitted, ``exit`` is the last emission; a step for each different exit.
    """
    import pyarrow as pa

    def block(rows, number: int):
        cells = {c: rows.column(c).combine_chunks() for c in rows.column_names}
        cells = {c: x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for c, x in cells.items()}
        times = cells["us"].to_numpy()
        ends = _exits(times, gap_us)
        edge = np.flatnonzero(np.append(ends[1:] != ends[:-1], True))
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        lists = [one(cells[c]) for c in ("_tie", "_ts", "us")] + [one(pa.array(x)) for x in (times[edge], ends[edge])]
        return pa.RecordBatch.from_arrays([cells["_key"].slice(0, 1), pa.array([number], pa.int64()), *lists], ["_key", "_block", "ties", "times", "us", "upto", "exit"])

    def cut(batches):
        held, size, number, own = [], 0, 0, None
        for batch in batches:
            for start, end in _runs(batch.column("_key")):
                key = batch.column("_key")[start].as_py()
                if held and not _same(key, own):
                    yield block(pa.Table.from_batches(held), number)
                    held, size, number = [], 0, 0
                elif not _same(key, own):
                    number = 0
                own = key
                while start < end:
                    room = min(end - start, THROTTLE_BLOCK - size)
                    held.append(batch.slice(start, room))
                    size, start = size + room, start + room
                    if size == THROTTLE_BLOCK:
                        yield block(pa.Table.from_batches(held), number)
                        held, size, number = [], 0, number + 1
        if held:
            yield block(pa.Table.from_batches(held), number)

    return cut


def _entries(gap_us: int):
    """Sorted steps (key, part, block, upto, exit) to (key, part, block, entry): the time of the last emission before each block of a key but its first."""
    import pyarrow as pa

    def walk(batches):
        own = place = last = None
        done = True
        for batch in batches:
            out = []
            for i, k in enumerate(batch.column("_key").to_pylist()):
                here = (batch.column("_part")[i].as_py(), batch.column("_block")[i].as_py())
                if place is None or not _same(k, own):
                    own, place, last, done = k, None, None, True
                if here != place:
                    place, done = here, False
                    if last is not None:
                        out.append((i, last))
                if not done and (last is None or batch.column("upto")[i].as_py() >= last + gap_us):
                    last, done = batch.column("exit")[i].as_py(), True
            chosen = batch.select(["_key", "_part", "_block"]).take(pa.array([i for i, _ in out], pa.int64()))
            yield pa.RecordBatch.from_arrays([*chosen.columns, pa.array([t for _, t in out], pa.int64())], ["_key", "_part", "_block", "_entry"])

    return walk


def _emitted(gap_us: int):
    """Blocks with the last emission before them to the rows that they emit."""
    import pyarrow as pa

    def emit(batches):
        for batch in batches:
            for i in range(len(batch)):
                times = batch.column("us")[i].values.to_numpy()
                entry = batch.column("_entry")[i].as_py()
                after, chosen = _step(times, gap_us), []
                at = 0 if entry is None else int(np.searchsorted(times, entry + gap_us, "left"))
                while at < len(times):
                    chosen.append(at)
                    at = int(after[at])
                take = pa.array(chosen, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("_key").take(pa.array([i] * len(chosen), pa.int64())), *[batch.column(c)[i].values.take(take) for c in ("ties", "times")]], ["_key", "_tie", "_ts"])

    return emit


def throttle(rows: DataFrame, key: str, tie: str, gap_us: int) -> DataFrame:
    """(key, tie, ts): the rows emitted if after each the key is silent for ``gap_us`` microseconds; a key's first is emitted.

    No task sees a whole key. Rows are dealt in ranges of (key, time) and cut
    into blocks of one key; a block is a function from the last emission before
    it to the last one in it, a step function with as many steps as different
    exits, mostly few, as chains of emissions soon meet. Only these steps of
    keys with several blocks are gathered by key and walked in order; then each
    block emits its rows from its own entry. Rows of a key that all lie within
    ``gap_us`` have a step each, which is the worst case. A null key is a key;
    rows without a time are left out; of equal times the smallest ``tie`` comes
    first. Arrow keeps keys of any type as they are.
    """
    kinds = dict(rows.dtypes)
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    timed = rows.where("ts is not null").select(F.col(key).alias("_key"), F.col(tie).alias("_tie"), F.col("ts").alias("_ts"), us.alias("us"))
    dealt = timed.repartitionByRange("_key", "us", "_tie").sortWithinPartitions("_key", "us", "_tie")
    form = f"_key {kinds[key]}, _block long, ties array<{kinds[tie]}>, times array<{kinds['ts']}>, us array<long>, upto array<long>, exit array<long>"
    blocks = staged(dealt.mapInArrow(_blocks(gap_us), form).withColumn("_part", F.spark_partition_id()), "throttle-blocks")
    several = blocks.groupBy("_key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("_key").alias("_k"))
    steps = blocks.join(several, F.col("_key").eqNullSafe(F.col("_k")), "left_semi").select("_key", "_part", "_block", F.explode(F.arrays_zip("upto", "exit")).alias("s")).select("_key", "_part", "_block", "s.upto", "s.exit")
    place = ["_key", "_part", "_block"]
    entries = steps.repartition("_key").sortWithinPartitions(*place, "upto").mapInArrow(_entries(gap_us), f"_key {kinds[key]}, _part int, _block long, _entry long")
    entries = staged(entries.select(*[F.col(c).alias(f"{c}_e") for c in place], "_entry"), "throttle-entries")
    same = F.col("_key").eqNullSafe(F.col("_key_e")) & (F.col("_part") == F.col("_part_e")) & (F.col("_block") == F.col("_block_e"))
    met = blocks.join(entries, same, "left").select("_key", "ties", "times", "us", "_entry")
    found = met.mapInArrow(_emitted(gap_us), f"_key {kinds[key]}, _tie {kinds[tie]}, _ts {kinds['ts']}")
    return found.select(F.col("_key").alias(key), F.col("_tie").alias(tie), F.col("_ts").alias("ts"))


#: Rows of a key in one entry of its state.
HELD_AT_ONCE = 1024


def _ordered_processor(names: list[str], tie_kind: str, value_kind: str, policy):
    """A processor that holds rows until the watermark passes them and hands them to ``policy`` in order of (time, tie).

    ``policy(state, rows, watermark_us)`` gets the key's state (a tuple of three, or None), the rows (us, tie, value) that
    are due and the watermark, and returns the new state, when it wants to be called again, and the rows to put out. One
    timer a key is set: for the earliest row held or for what the policy asks. Rows are held as lists of up to
    ``HELD_AT_ONCE``, in order of arrival, so that the state is asked once for many rows.
    """
    from pyspark.sql import Row
    from pyspark.sql.streaming import StatefulProcessor

    make = Row(*names)

    def packed(rows):
        for at in range(0, len(rows), HELD_AT_ONCE):
            us, ties, values = (list(x) for x in zip(*rows[at : at + HELD_AT_ONCE]))
            yield min(us), us, ties, values

    class Ordered(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.held = handle.getListState("held", f"first long, us array<long>, ties array<{tie_kind}>, `values` array<{value_kind}>")
            self.state = handle.getValueState("state", f"a long, b long, tie {tie_kind}, value {value_kind}")

        def handleInputRows(self, key, rows, timerValues):
            new = [(r.us, r.tie, r.value) for r in rows]
            if new:
                entries = list(packed(new))
                if len(entries) == 1:
                    self.held.appendValue(entries[0])
                else:
                    self.held.appendList(entries)
                self.handle.registerTimer(min(e[0] for e in entries) // 1000 + 1)
            return iter([])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            now = timerValues.getCurrentWatermarkInMs() * 1000
            due, later, whole = [], [], []
            for first, us, ties, values in self.held.get():
                if first >= now:
                    whole.append((first, us, ties, values))
                    continue
                for r in zip(us, ties, values):
                    (due if r[0] < now else later).append(r)
            if due:
                kept = [*whole, *packed(later)]
                if kept:
                    self.held.put(kept)
                else:
                    self.held.clear()
            else:
                kept = whole
            due.sort(key=lambda r: (r[0], r[1] is not None, r[1]))
            state, again, out = policy(self.state.get() if self.state.exists() else None, due, now)
            if state is None:
                self.state.clear()
            else:
                self.state.update(state)
            for when in (min((e[0] for e in kept), default=None), again):
                if when is not None:
                    self.handle.registerTimer(when // 1000 + 1)
            return iter([make(*key, *r) for r in out])

        def close(self) -> None:
            pass

    return Ordered()


#: State of the ordered processors is kept by RocksDB, on the executors' disks and in the checkpoint.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ordered(stream: DataFrame, key: str, tie: str, value: str, lateness: str, out: dict[str, str], policy) -> DataFrame:
    """The rows that ``policy`` puts out for each key, with the columns ``out`` (names and types)."""
    kinds = dict(stream.dtypes)
    timed = stream.withWatermark("ts", lateness).select(F.col(key).alias("_key"), "ts", F.unix_micros("ts").alias("us"), F.col(tie).alias("tie"), F.col(value).alias("value"))
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return timed.groupBy("_key").transformWithState(statefulProcessor=_ordered_processor([key, *out], kinds[tie], kinds[value], policy), outputStructType=", ".join(f"`{n}` {k}" for n, k in {key: kinds[key], **out}.items()), outputMode="Append", timeMode="EventTime")


def throttle_stream(stream: DataFrame, key: str, tie: str, gap_us: int, lateness: str = "1 hour") -> DataFrame:
    """(key, tie, us): ``throttle`` of a stream, whatever the order of rows within ``lateness``.

    Rows wait in the state until the watermark has passed them and are then judged in order of time; what comes later
    than that is dropped by Spark, and so is what is not after 1970, where watermarks begin. A key's state is what waits and the time of its last emission.
    """

    def policy(state, rows, now):
        last, out = (state[0] if state else None), []
        for us, t, _ in rows:
            if last is None or us - last >= gap_us:
                out.append((t, us))
                last = us
        return (None if last is None else (last, last, None, None)), None, out

    return _ordered(stream, key, tie, tie, lateness, {tie: dict(stream.dtypes)[tie], "us": "long"}, policy)


def debounce(rows: DataFrame, key: str, tie: str, gap: str) -> DataFrame:
    """The last row of each burst: those after which the key is silent for the interval ``gap``."""
    led = with_adjacent(rows, [key], ["ts", tie], "ts", after="_next", before="_previous")
    return led.where(F.col("_next").isNull() | (F.col("_next") >= F.col("ts") + F.expr(f"INTERVAL {gap}"))).select(rows.columns)


def sample_latest(rows: DataFrame, key: str, value: str, tie: str, period: str) -> DataFrame:
    """(key, start, value): the latest value in each period of each key."""
    timed = rows.withColumn("_ts", F.col("ts").cast("timestamp"))
    found = timed.groupBy(key, F.window("_ts", period).alias("_w")).agg(F.max_by(value, F.struct("_ts", tie)).alias(value))
    return found.select(key, F.col("_w.start").cast("timestamp_ntz").alias("start"), value)


def stream_status(stream: DataFrame, by: str, value: str, tie: str, ttl_us: int, lateness: str = "1 hour") -> DataFrame:
    """(by, status, shown_from, shown_until) of status bursts, each put out by its own timer when nothing has come for ``ttl_us``.

    The timer clears a status only if it still is the one that the timer was set for: a later status moves the end, and
    the old timer finds nothing due. Of equal times the highest ``tie`` shows. Rows are taken in order of time as in
    ``throttle_stream``.
    """

    def policy(state, rows, now):
        out = []
        for us, t, v in rows:
            if state and us >= state[1] + ttl_us:
                out.append((state[3], state[0], state[1] + ttl_us))
                state = None
            state = (state[0] if state else us, us, t, v)
        if state and state[1] + ttl_us < now:
            out.append((state[3], state[0], state[1] + ttl_us))
            state = None
        return state, (state[1] + ttl_us if state else None), out

    found = _ordered(stream, by, tie, value, lateness, {"status": dict(stream.dtypes)[value], "_from": "long", "_until": "long"}, policy)
    return found.select(by, "status", F.timestamp_micros("_from").alias("shown_from"), F.timestamp_micros("_until").alias("shown_until"))


def play_out(events: DataFrame, make) -> DataFrame:
    """All that ``make(events)`` puts out over a stream that ends, as a table.

    When the events have been read, a mark far in the future, in a source of its own, moves the watermark over all
    rows and timers, as time does on a live stream. It is a row without a key that stays in the state itself.
    """
    spark = events.sparkSession
    base = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    none = spark.createDataFrame([], events.schema)
    none.coalesce(1).write.parquet(f"{base}/ends")
    made = make(events.where("ts is not null").unionByName(spark.readStream.schema(events.schema).parquet(f"{base}/ends")))

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{base}/out/batch={batch}")

    for turn in range(2):
        if turn:
            mark = spark.range(1).select(F.lit("9999-01-01").cast("timestamp").alias("ts"))
            none.unionByName(mark, allowMissingColumns=True).coalesce(1).write.mode("append").parquet(f"{base}/ends")
        made.writeStream.outputMode("append").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.schema(made.schema).option("recursiveFileLookup", True).parquet(f"{base}/out")
