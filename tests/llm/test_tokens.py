"""Operators 2 and 8 against the libraries."""

import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from corpusloom.llm import bpe, tokencount
from corpusloom.llm.segments import segments

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def own():
    return bpe.encoder(RANKS, P.PATTERN)


def odd_texts(n, seed=1):
    draw = random.Random(seed)
    return ["".join(draw.choice("ab  \n\t's.é1日<|>😀  \x1cßÉ-") for _ in range(draw.randrange(60))) for _ in range(n)]


def test_segments_join_again():
    for text in odd_texts(500):
        assert "".join(segments(text)) == text


def test_encoding_equals_the_library(own, library):
    for text in [*odd_texts(1500), "x" * 5000, "日本語" * 300, "aaaa " * 200, "", " "]:
        assert own.encode(text) == library.encode_ordinary(text)
        assert own.decode(own.encode(text)) == text.encode()


def test_prefixes_are_carried_on_and_kept_after_edits(own):
    word = b"incomprehensibilities"
    whole = own.extend([bpe.NEVER], word)
    grown = own.extend([bpe.NEVER], word[:9])
    assert own.extend(grown, word) == whole
    edited = word[:12] + b"xyz" + word[15:]
    assert own.extend(whole[:13], edited) == own.extend([bpe.NEVER], edited)


def test_every_document(spark, docs, local_docs, library):
    got = {r.doc_id: r for r in bpe.token_digests(docs, RANKS, P.PATTERN).collect()}
    assert got.keys() == local_docs.keys()
    for i, r in local_docs.items():
        ids = library.encode_ordinary(r.text)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest())


def test_columns_round_trip(odd, library):
    rows = bpe.decode(bpe.encode(odd, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    for r in rows:
        assert r.ids == library.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()


def test_counts_equal_the_library(odd, docs, none):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    for frame in (odd, docs):
        want = sorted((r.doc_id or -1, len((r.text or "").encode()), len(lib.encode(r.text or "", add_special_tokens=False))) for r in frame.collect())
        got = tokencount.count_tokens(frame, path).collect()
        assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    assert tokencount.count_tokens(none, path).count() == 0
    assert bpe.token_digests(none, RANKS, P.PATTERN).count() == 0


def test_special_strings_and_odd_texts_in_counts():
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    count = tokencount.TextCounter(tokencount.json_counter(path), memo_parts=50)
    for text in [*odd_texts(400, 2), "日本語。テスト、「はい」" * 40 + "<|endoftext|>。", "x\ny \n z\n\nq", "a <|endoftext|> b<|endoftext|>"]:
        assert list(count.counts([text])) == [len(lib.encode(text, add_special_tokens=False))]


def test_pieces_of_a_model_file(docs):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    some = docs.limit(20)
    assert {r.doc_id: r.n_tokens for r in tokencount.count_tokens(some, path).collect()} == {r.doc_id: len(lib.encode(r.text)) for r in some.collect()}


def test_batches_hold_their_bytes():
    groups = list(tokencount.by_bytes(["a" * 10, "b" * 10, "c" * 50, "d"], 25))
    assert groups == [["a" * 10, "b" * 10], ["c" * 50], ["d"]]


def test_new_parts_of_many_texts_fill_calls():
    calls = []
    encode = lambda parts: calls.append(sum(map(len, parts))) or [1] * len(parts)
    counter = tokencount.TextCounter(encode, batch_bytes=2000)
    texts = [f"a{i} b{i} c{i}" for i in range(1000)]
    assert list(counter.counts(texts)) == [3] * 1000 and len(calls) < 20 and max(calls) <= 2000
    assert list(counter.counts(texts[::-1])) == [3] * 1000 and len(calls) < 20


def test_long_texts_without_spaces(own, library):
    """Marks are safe borders, so a text of letters and marks is many parts; what is long is not remembered."""
    text = "日本語のテキスト。漢字、かな。" * 20000
    parts = segments(text)
    assert "".join(parts) == text and len(parts) > 50000
    assert own.encode(text[:3000]) == library.encode_ordinary(text[:3000])
    own.encode("y" * 3000)
    assert "y" * 3000 not in own.word and "y" * 3000 not in own.word.old
