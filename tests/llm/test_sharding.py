import zlib

import numpy as np

from larder.llm import sharding


def test_shards_slots_and_growth(spark):
    rows = [(i, f"text {i} é" * (i % 50)) for i in range(3000)] + [(3, "text"), (3, "text"), (None, None), (4000, ""), (4001, "z" * 100_000)] + [(5000, "again")] * 200
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, shard int")
    got = sharding.shard_documents(docs, chunk_rows=32).collect()
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    for s in range(16):
        own = [r.slot for r in got if r.shard == s]
        assert sorted(own) == list(range(len(own))) and 100 < len(own) < 500
    assert all(r.law == "key" and r.grown_shard in (r.shard, 16) for r in got)
    assert 0.03 < sum(r.grown_shard == 16 for r in got) / len(got) < 0.09
    assert len({(r.doc_id, r.shard, r.grown_shard) for r in got}) == len({r.doc_id for r in got})


def plain(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash_matches_the_published_loop():
    keys = np.random.default_rng(1).integers(0, 2**64 - 1, 500, dtype=np.uint64)
    for n in (1, 2, 16, 17, 1000):
        assert sharding.jump_hash(keys, n).tolist() == [plain(int(k), n) for k in keys]


def test_empty_table(spark):
    assert sharding.shard_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
