"""The registered queries over the smallest standard tables, against brute force."""

import math
import os
import zlib

import numpy as np
import pytest

import __spark_entry__
import test_bpe
import test_decontaminate
import test_exact_dedup
import test_fill_middle
import test_pii
import test_secrets
import test_sharding
import test_simhash
import test_spelling
import test_suffix_dedup
from larder.llm import quality

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no standard tables")


@pytest.fixture(scope="module")
def rows(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def asked(spark, name):
    return __spark_entry__.queries()[name](spark, SF)


def test_op1(spark, rows):
    assert sorted([tuple(r) for r in asked(spark, "op1_exact_dedup").collect()], key=str) == test_exact_dedup.brute(rows)


def test_op3(spark, rows):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id, r.distance) for r in asked(spark, "op3_decontaminate").collect()}
    # a copy within the budget keeps at least one piece; every document is searched for every piece
    normal, want = test_decontaminate.dc.normal, set()
    cut = [(k, normal(t or "")) for k, t in items]
    for i, text in rows:
        body = normal(text or "")
        for k, item in cut:
            budget = int(len(item) * test_decontaminate.dc.ERROR_RATE)
            if any(piece in body for _, piece in test_decontaminate.dc.pieces(item, budget)) and (n := least_edits(item, body)) <= budget:
                want.add((i, k, n))
    assert want and got == want


def least_edits(item, body):
    """Least edits between the item and any passage: the plain table, a column at a time."""
    letters = np.frombuffer(item.encode("utf-32-le"), np.uint32)
    place = np.arange(len(letters) + 1)
    row, best = place.copy(), len(letters)
    for c in body:
        step = np.minimum(row[1:] + 1, row[:-1] + (letters != ord(c)))
        row = np.minimum.accumulate(np.r_[0, step] - place) + place  # an edit in the item alone costs one more each
        best = min(best, int(row[-1]))
    return best


def test_op4(spark, rows):
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in asked(spark, "op4_simhash").collect()} == test_simhash.brute(rows)


def test_op5(spark, rows):
    got = asked(spark, "op5_pii").collect()
    terms = test_pii.brute_terms([(i, t or "") for i, t in rows])
    want = []
    for k, (i, text) in enumerate(rows):
        spans = [f"{kind}:{s}:{e}" for kind, s, e in test_pii.base(text)]
        base = test_pii.hashlib.sha256(",".join(spans).encode()).hexdigest()
        want.append((i, base, ",".join(spans + [f"term:{s}:{e}" for s, e, _ in sorted(terms[k])])))
    assert sorted(want, key=str) == sorted(((r.doc_id, r.base_sha256, r.spans) for r in got), key=str)


def test_op6(spark, rows):
    assert sorted([tuple(r) for r in asked(spark, "op6_bpe").collect()], key=str) == test_bpe.brute(rows)


def test_op7(spark, rows):
    got = asked(spark, "op7_sharding").collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got))) for s in range(16))
    keys = {r.doc_id: r.h % 2**64 for r in spark.createDataFrame([(i,) for i, _ in rows], "doc_id long").selectExpr("doc_id", "xxhash64(doc_id) AS h").collect()}
    assert all((r.shard, r.grown_shard) == (test_sharding.plain(keys[r.doc_id], 16), test_sharding.plain(keys[r.doc_id], 17)) for r in got)


def test_op8(spark, rows):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = {r.doc_id: r for r in asked(spark, "op8_quality").collect()}
    held = [r for r in got.values() if r.held_out and r.doc_id in labels]
    assert len(got) == len(rows) and sum(r.predicted == labels[r.doc_id] for r in held) >= 0.85 * len(held)
    model = quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    for i, text in rows:
        known = dict(zip(quality.NAMES, quality.text_statistics((text or "").encode()), strict=True))
        margin = model.intercept + sum(w for rule, w in model.weighted if all(low < known[name] <= high for name, low, high in rule.bounds))
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-margin))) and got[i].predicted == (got[i].score >= 0.5)
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)


def test_op9(spark, rows):
    got = {r.doc_id: r for r in asked(spark, "op9_secrets").collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    grammar = test_secrets.sc.grammar_of(docs)
    order = [*test_secrets.KINDS, "format"]
    for i, text in rows:
        base = test_secrets.base(text)
        line = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        every = sorted(base + test_secrets.formats(text, grammar), key=lambda x: (x[1], order.index(x[0])))
        assert got[i].spans == ",".join(f"{k}:{s}:{e}" for k, s, e in every)
        assert got[i].base_sha256 == test_secrets.hashlib.sha256(line.encode()).hexdigest()


def test_op10(spark, rows):
    assert test_suffix_dedup.digests(asked(spark, "op10_suffix_dedup")) == test_suffix_dedup.brute(rows)


def test_op11(spark, rows):
    assert sorted(tuple(r) for r in asked(spark, "op11_spelling").collect()) == test_spelling.brute(test_spelling.counted(rows))


def test_op12(spark):
    read = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    got, hit, want = asked(spark, "op12_neighbours").collect(), 0, 0
    ids = np.array(list(read))
    for q in (i for i in read if i % 20 == 0):
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        score = np.array([read[i] @ read[q] for i in ids])
        best = [i for _, i in sorted((-s, i) for s, i in zip(score, ids, strict=True) if i != q)[:20]]
        assert [r.rank for r in own] == list(range(1, len(best) + 1)) and [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        assert all(r.vec_id != q and r.score == pytest.approx(read[r.vec_id] @ read[q], abs=1e-12) for r in own)
        hit, want = hit + len({r.vec_id for r in own} & set(best)), want + len(best)
    assert len({r.query_id for r in got}) == sum(i % 20 == 0 for i in read) and hit >= 0.9 * want


def test_op13(spark, rows):
    assert sorted([tuple(r) for r in asked(spark, "op13_fill_middle").collect()], key=str) == test_fill_middle.brute(rows)
