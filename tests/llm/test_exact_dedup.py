import hashlib
import re

import pytest

from larder.llm import exact_dedup as ed


def brute(rows):
    groups = {}
    for i, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        groups.setdefault(body, []).append((-len(text or ""), i is None, i or 0))
    out = []
    for i, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        best = min(groups[body])
        keep = None if best[1] else best[2]
        out.append((i, keep, len(groups[body]), i == keep, hashlib.sha256(body.encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [(5, "a b"), (3, "ab"), (4, "a b"), (9, " ab  "), (1, None), (2, ""), (7, " \t\n"), (8, "é "), (10, "é"), (11, "x" * 200_000), (12, "x " * 200_000), (12, "x " * 200_000), (None, "only"), (None, "q"), (13, "q"), (-4, "ab"), (14, "😀"), (15, "😀 ")]


@pytest.mark.parametrize("options", [{}, {"capacity": 1}, {"capacity": 2, "hash_bits": 2}])
def test_matches_brute_force(spark, options):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in ROWS], "doc_id long, text string, h string, group_size int")
    got = sorted([tuple(r) for r in ed.exact_dedup(docs, **options).collect()], key=str)
    assert got == brute(ROWS)


def test_only_overfull_buckets_are_split(spark):
    high = lambda bits: int(bits.ljust(64, "0"), 2) - (1 << 64 if bits[0] == "1" else 0)
    hashes = [high("000"), high("0010"), high("0011"), high("01"), high("10"), high("11"), high("1101")]
    entries = spark.createDataFrame([(h,) for h in hashes], "h long")
    got = {r.h: (r.bucket, r.depth) for r in ed.split_buckets(entries, 1, capacity=2).collect()}
    assert {got[h] for h in hashes[:3]} == {(high("000"), 3), (high("001"), 3)} and got[hashes[3]] == (high("01"), 2)
    assert got[hashes[4]] == (high("10"), 2) and {got[h] for h in hashes[5:]} == {(high("11"), 2)}


def test_split_buckets_and_forced_collisions_decide_the_result(spark):
    texts = [f"text {i % 300}" for i in range(500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = ed.build_index(docs, capacity=2)
    sizes = {(r.bucket, r.depth): r["count"] for r in held.groupBy("bucket", "depth").count().collect()}
    assert sum(sizes.values()) == 300 and max(sizes.values()) <= 2 and len({d for _, d in sizes}) > 1
    # with four hash bits, some twenty texts share each hash: their bytes alone tell them apart
    index = ed.build_index(docs, capacity=16, hash_bits=4).collect()
    assert len({r.h for r in index}) == 16 and len(index) == 300
    for h in {r.h for r in index}:
        assert sorted(r.chain for r in index if r.h == h) == list(range(sum(r.h == h for r in index)))
    assert {r.sha: (r.group_size, r.keep_id) for r in index} == {sha: (n, keep) for _, keep, n, _, sha in brute(list(enumerate(texts)))}
    got = sorted([tuple(r) for r in ed.exact_dedup(docs, capacity=16, hash_bits=4).collect()], key=str)
    assert got == brute(list(enumerate(texts)))


def test_one_of_each_keeps_all_columns(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in ROWS], "doc_id long, text string, text_sha256 string")
    kept = ed.one_of_each(docs).collect()
    assert sorted([r.doc_id for r in kept], key=str) == sorted([r[0] for r in brute(ROWS) if r[3]], key=str)
    assert ed.exact_dedup(docs.limit(0)).collect() == [] and ed.one_of_each(docs.limit(0)).columns == docs.columns
