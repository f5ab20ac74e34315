"""Byte-level BPE encoding and decoding by prefix dynamic programming (operator 2).

For every byte prefix of a piece exactly one token can stand last in a valid
encoding. It is stored for each prefix, so appending a byte looks only at the
tokens that end there, words with a common beginning share their work, and
after an edit only the prefixes behind it are made again. Two neighbouring
tokens are valid together when merging their joined bytes by rank gives just
these two; a sequence is the encoding of its bytes when all its neighbours are.

Words are remembered in caches of bounded size; a part of a text of over
``LONG`` characters is not. Texts: a null text is an empty one and has no tokens. Decoding joins the bytes
of the tokens, so it returns the text's UTF-8 exactly. No shuffle is needed.
"""

from __future__ import annotations

import base64
import hashlib
import re
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.segments import LONG, Memo, segments

#: Entries of a worker's caches, a generation: words and their pieces, token pairs.
MEMO_WORDS, MEMO_PAIRS = 400_000, 150_000
#: A word of Latin letters, a line feed before it and marks behind it: pieces under the split pattern, found without it.
PLAIN = re.compile("(\n?)( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-/:-@\\[-`{-~]*)").fullmatch
#: The beginning of the split patterns under which that holds.
PLAIN_UNDER = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"
#: The rank of a merge that never comes.
NEVER = 1 << 60


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks in a .tiktoken file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PrefixEncoder:
    """Encodes and decodes with one vocabulary of ranks and one split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, words: int = MEMO_WORDS):
        import ahocorasick
        import regex

        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        self.ends = ahocorasick.Automaton()  # all tokens that end at each byte; it takes text, so each byte is a character
        for token, rank in ranks.items():
            self.tokens[rank] = token
            self.ends.add_word(token.decode("latin-1"), (len(token), rank))
        self.longest = max(map(len, ranks))
        self.lengths = list(map(len, self.tokens))
        self.ends.make_automaton()
        self.digits = [str(rank) for rank in range(len(self.tokens))]
        self.pieces = regex.compile(pattern).findall
        self.plain = PLAIN if pattern.startswith(PLAIN_UNDER) else lambda part: None
        # By token, so bounded by the vocabulary: the parts at its right and left edge, each with the rank of the merge that takes it up.
        self.right_edge = Memo(lambda token: self._edge(token, 1), NEVER)
        self.left_edge = Memo(lambda token: self._edge(token, 0), NEVER)
        self.whole = Memo(lambda rank: len(self._merged(self.tokens[rank])) == 1, NEVER)
        self.pair_fits = Memo(self._pair_fits, MEMO_PAIRS)
        # A word comes with many marks behind it, so its pieces are remembered too, as words are.
        self.word = Memo(self._word, words, LONG)

    def _merged(self, data: bytes, to: int = 1) -> list[bytes]:
        """``data`` merged by rank from single bytes, lowest rank and leftmost first, down to ``to`` parts at least."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > to:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], NEVER))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _edge(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """Parts at one edge of ``token`` while it is merged, from the single byte on: (part, rank of its merge)."""
        if len(token) == 1:
            return [(token, NEVER)]
        part = self._merged(token, 2)[side]
        below = self.right_edge[part] if side else self.left_edge[part]
        return [*below[:-1], (part, self.ranks[token]), (token, NEVER)]

    def _pair_fits(self, pair: int) -> bool:
        """Whether no merge crosses the border of two tokens.

        Ranks grow along each edge, so time is followed by always lifting the
        edge whose next merge has the lower rank. A merge across the border
        comes first if its rank is below the left edge's and not above the
        right edge's next merge: of equal merges the leftmost goes first.
        """
        left, right, ranks = self.right_edge[self.tokens[pair >> 32]], self.left_edge[self.tokens[pair & 0xFFFFFFFF]], self.ranks
        i = j = 0
        while True:
            a, up_a = left[i]
            b, up_b = right[j]
            across = ranks.get(a + b, NEVER)
            if across < up_a and across <= up_b:
                return False
            if up_a == up_b == NEVER:
                return True
            if up_a <= up_b:
                i += 1
            else:
                j += 1

    def extend(self, last: list[int], data: bytes) -> list[int]:
        """``last`` has the last token of each prefix of ``data``, as far as it goes; it is carried on to the end.

        ``last[0]`` stands for the empty prefix. Appending bytes keeps what is
        there; after an edit, cut the list back to the first changed byte.
        """
        done = len(last) - 1
        back = max(0, done - self.longest)
        last += [-1] * (len(data) - done)
        fits, whole = self.pair_fits, self.whole
        for end, (length, rank) in self.ends.iter(data[back:].decode("latin-1")):
            end += back + 1
            if last[end] < 0 < end - done and (whole[rank] if length == end else fits[last[end - length] << 32 | rank]):
                last[end] = rank
        return last

    def _prefixes(self, data: str) -> list[int]:
        """The last token of each prefix of ``data``, a character for each byte; the same as ``extend`` from nothing."""
        last, fits, whole = [-1] * len(data), self.pair_fits, self.whole
        for end, (length, rank) in self.ends.iter(data):
            if last[end] < 0 and (fits[last[end - length] << 32 | rank] if length <= end else whole[rank]):
                last[end] = rank
        return last

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one piece: the last token, the last of what is before it, and so on."""
        rank = self.ranks.get(piece)
        if rank is not None:
            return (rank,)
        last, lengths = self._prefixes(piece.decode("latin-1")), self.lengths
        ids, end = [], len(piece) - 1
        while end >= 0:
            rank = last[end]
            ids.append(rank)
            end -= lengths[rank]
        return tuple(ids[::-1])

    def _word(self, part: str) -> tuple[tuple[int, ...], str, bytes]:
        """The ids of a part of a text, the same as text, and the bytes they decode to."""
        plain = self.plain(part)
        pieces = [x for x in plain.groups() if x] if plain else self.pieces(part)
        ids = self.encode_piece(part.encode()) if len(pieces) == 1 else tuple(x for piece in pieces for x in self.word[piece][0])
        return ids, ",".join(map(self.digits.__getitem__, ids)), self.decode(ids)

    def encode(self, text: str) -> list[int]:
        word = self.word
        return [x for part in segments(text) for x in word[part][0]]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of tokens, SHA-256 of the ids joined by commas, SHA-256 of the bytes that they decode to."""
        parts = segments(text)
        ids, shown, data = zip(*map(self.word.__getitem__, parts)) if parts else ((), (), ())
        return sum(map(len, ids)), hashlib.sha256(",".join(shown).encode()).hexdigest(), hashlib.sha256(b"".join(data)).hexdigest()


_ENCODERS: dict[tuple[str, str, int], PrefixEncoder] = {}


def encoder(path: str, pattern: str, words: int = MEMO_WORDS) -> PrefixEncoder:
    """One encoder a worker process, vocabulary, pattern and size of its cache."""
    if (path, pattern, words) not in _ENCODERS:
        _ENCODERS[path, pattern, words] = PrefixEncoder(read_ranks(path), pattern, words)
    return _ENCODERS[path, pattern, words]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the column ``out``: array of the token ids of each text. It replaces a column of that name."""
    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(texts):
        own = encoder(path, pattern)
        return texts.map(lambda x: own.encode(x or ""))

    return docs.withColumn(out, ids(F.coalesce(F.col(text), F.lit(""))))


def decode(docs: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the column ``out``: the bytes of the tokens in ``ids`` (null: no bytes)."""
    @F.pandas_udf(T.BinaryType())
    def data(lists):
        own = encoder(path, pattern)
        return lists.map(lambda x: own.decode(() if x is None else x))

    return docs.withColumn(out, data(F.col(ids)))


def token_digests(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): encodes every text, decodes the ids, returns digests only."""
    import pyarrow as pa

    out = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches):
        own = encoder(path, pattern)
        for batch in batches:
            n, ids, data = zip(*(own.digests(x.as_py()) for x in batch.column(1))) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(data, pa.string())], names=out.names)

    return docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias(text)).mapInArrow(run, out)


def encoded(docs: DataFrame, path: str, pattern: str, text: str = "text", words: int = MEMO_WORDS) -> DataFrame:
    """``docs`` without ``text``, with ids, n_tokens and decoded_sha256, the digest of the ids' decoded bytes. ``words``: entries of a worker's cache."""
    import pyarrow as pa

    keep = [c for c in docs.columns if c not in (text, "ids", "n_tokens", "decoded_sha256")]
    out = T.StructType([*[docs.schema[c] for c in keep], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches):
        own = encoder(path, pattern, words)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):  # ids of few texts are held at a time
                part = batch.slice(at, 500)
                ids = [own.encode(x.as_py()) for x in part.column(len(keep))]
                digests = [hashlib.sha256(own.decode(x)).hexdigest() for x in ids]
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(keep))], pa.array(ids, pa.list_(pa.int32())), pa.array([len(x) for x in ids], pa.int64()), pa.array(digests, pa.string())], names=out.names)

    return docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias(text)).mapInArrow(run, out)
