"""Token counts of whole texts (operator 8).

An Arrow function gets record batches, takes their texts in windows of about
``WINDOW`` characters, cuts them at safe boundaries, lets the library encode
the window's distinct new parts in calls of about ``BATCH_BYTES`` each and
returns lengths only; ids never leave the Python worker. There is no shuffle.
Only lengths of parts of at most ``LONG`` characters are remembered.
A null text counts as empty: 0 bytes, 0 tokens. Columns of the input that are
not asked for are not read, so extra columns of any name do no harm.
"""

from __future__ import annotations

import os
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.segments import LONG, by_size, segments

#: UTF-8 bytes of one call of the library, about; characters of texts that are cut before it is called.
BATCH_BYTES, WINDOW = 1 << 18, 1 << 21
#: Parts whose lengths a worker remembers, a generation of two.
MEMO_PARTS = 200_000


def json_counter(path: str):
    """A function: list of distinct parts -> list of their token counts, for a .json file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda parts: [len(x) for x in tokenizer.encode_batch_fast(parts, add_special_tokens=False)]


def piece_counter(path: str):
    """The same for a .model file; its pieces may cross spaces, so give it whole texts."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]


def by_bytes(parts: list[str], most: int):
    """Lists of consecutive parts of about ``most`` bytes each; a longer part stands alone."""
    group, held = [], 0
    for part in parts:
        n = len(part.encode())
        if group and held + n > most:
            yield group
            group, held = [], 0
        group.append(part)
        held += n
    if group:
        yield group


class TextCounter:
    """Counts tokens of texts, remembering the counts of short parts seen before."""

    def __init__(self, encode, cut=segments, batch_bytes: int = BATCH_BYTES, memo_parts: int = MEMO_PARTS):
        self.encode, self.cut, self.batch_bytes, self.memo_parts = encode, cut, batch_bytes, memo_parts
        self.memo: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def counts(self, texts, window: int = WINDOW):
        """The number of tokens of each text; the new parts of a window of texts are encoded together."""
        for group in by_size(texts, window):
            parts = [self.cut(text) for text in group]
            known = self._known(dict.fromkeys(chain.from_iterable(parts)))
            yield from (sum(map(known.__getitem__, x)) for x in parts)

    def _known(self, parts: dict) -> dict[str, int]:
        new = []
        for part in parts:
            n = self.memo.get(part)
            if n is None:
                n = self.old.get(part)
            if n is None:
                new.append(part)
            parts[part] = n
        for group in by_bytes(new, self.batch_bytes):
            parts.update(zip(group, self.encode(group)))
        if len(self.memo) + len(new) > self.memo_parts:
            self.memo, self.old = {}, self.memo
        if len(new) <= self.memo_parts:
            self.memo.update((part, n) for part, n in parts.items() if len(part) <= LONG)
        return parts


_COUNTERS: dict[str, TextCounter] = {}


def _counter(path: str) -> TextCounter:
    """One counter a worker process and file: reused workers keep what they know."""
    if path not in _COUNTERS:
        _COUNTERS[path] = TextCounter(json_counter(path)) if path.endswith(".json") else TextCounter(piece_counter(path), cut=lambda text: [text] if text else [], memo_parts=0)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", limit: int = 512) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every row; ``vocabulary`` is a .json or .model file on all hosts."""
    import pyarrow as pa
    import pyarrow.compute as pc

    kind = docs.schema[key].dataType
    out = T.StructType([T.StructField(key, kind), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches):
        counter = _counter(vocabulary)
        for batch in batches:
            texts = batch.column(1)
            n_bytes = pc.binary_length(texts.cast(pa.binary())).cast(pa.int64())
            n_tokens = pa.array(counter.counts(x.as_py() for x in texts), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, n_tokens], names=[key, "n_bytes", "n_tokens"])

    counted = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias(text)).mapInArrow(run, out)
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
