import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from larder.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    r = random.Random(3)
    letters = "abcdefghiABC é ß漢字😀\n\t 0123456789'.,;!?<|>_́​"
    made = ["".join(r.choices(letters, k=r.randint(0, 200))) for _ in range(200)]
    return made + ["", None, "<|endoftext|>", "   ", "x" * 40_000, "ab" * 20_000, "don't we'll", "\x00\x01\x7f", "😀" * 300, "a\r\n\r\n  b"]


def brute(rows):
    enc, out = library(), []
    for i, text in rows:
        ids = enc.encode_ordinary(text or "")
        out.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_round_trip_matches_the_library(spark):
    rows = [*enumerate(texts()), (None, "no id"), (7, "twice"), (7, "twice")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_tokens int")
    assert sorted([tuple(r) for r in bpe.round_trip(docs, PATH, PATTERN).collect()], key=str) == brute(rows)


def test_encode_then_decode_gives_the_bytes(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tokens = bpe.encode_documents(docs, PATH, PATTERN)
    enc = library()
    assert {r.doc_id: r.token_ids for r in tokens.collect()} == {i: enc.encode_ordinary(t or "") for i, t in rows}
    assert {r.doc_id: bytes(r.body).decode() for r in bpe.decode_documents(tokens, PATH).collect()} == {i: t or "" for i, t in rows}


def test_common_pre_tokens_outlive_a_full_cache(monkeypatch):
    """A word that comes back is merged once, however many rare ones come between."""
    monkeypatch.setattr(bpe, "CACHE_BYTES", 100_000)
    ranks, merged = bpe.read_ranks(PATH), []
    codec, enc = bpe.Codec(ranks, PATTERN), library()
    plain = codec.merged
    monkeypatch.setattr(codec, "merged", lambda raw: merged.append(raw) or plain(raw))
    for i in range(3000):
        text = f"qxzvjqkw r{i:x}zq{i * 7919:x}"
        assert codec.encode(text) == enc.encode_ordinary(text)
    assert merged.count(b"qxzvjqkw") == 1 and codec.older


def test_empty_table(spark):
    assert bpe.round_trip(spark.createDataFrame([], "doc_id long, text string"), PATH, PATTERN).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 1000])
def test_perfect_hash_is_minimal(n):
    keys = [f"k{i}".encode() for i in range(n)]
    made = bpe.PerfectHash(keys)
    assert sorted(made(k) for k in keys) == list(range(n))
