import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from larder.llm import line_dedup as ld

WS = " \t\n\x0b\x0c\r"


def key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(WS))


def brute(rows):
    where = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 40:
                where[key(line)].add(i)
    out = {}
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(where.get(key(x), ())) >= 5 and i != max(where[key(x)]))]
        out[i] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def made_rows():
    r = random.Random(3)
    common = ["Common line number %d " % k + "é" * (20 + k) for k in range(12)]
    rows = [(i, "\n".join(r.choice([x, " " + x.upper().replace("É", "é") + "\t", x]) if r.random() < 0.5 else "own %d %s" % (r.random() * 1e9, "y" * 50) for x in r.choices(common, k=r.randint(0, 8)))) for i in range(80)]
    return rows + [(100, None), (101, ""), (102, "\n\n"), (103, common[5] + "\r\n" + common[5]), (104, "z" * 200_000 + "\n" + common[11])]


def digests(df):
    return {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in df.collect()}


@pytest.mark.parametrize("few", [False, True])
def test_matches_brute_force(spark, monkeypatch, few):
    if few:  # several shards, and several tasks for each
        monkeypatch.setattr(ld, "SHARD_LINES", 3)
        monkeypatch.setattr(ld, "ASKED_LINES", 20)
    rows = made_rows()
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, d1 int, body string")
    assert digests(ld.line_dedup(docs)) == brute(rows)
    kept = {r.doc_id: r for r in ld.line_dedup(docs, with_text=True).collect()}
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in kept.values())


def filtered(index):
    """The lines (d1) that the filters say they hold, of all that the counts have."""
    tables = {r.shard: ld.CuckooFilter(r.buckets, np.frombuffer(bytes(r.body), np.uint16).reshape(-1, ld.SLOTS)) for r in index.filters.collect()}
    return {r.d1 for r in index.counts.collect() if (t := tables.get(r.d2 % index.shards)) and t.may_hold(np.array([r.d1]).view(np.uint64))[0]}


def state(index):
    return {(r.d1, r.d2): (r.n_docs, r.last) for r in index.counts.collect()}


def test_insertions_and_deletions_change_counts_and_filters(spark):
    rows = made_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    first, late = docs.filter("doc_id < 20"), docs.filter("doc_id >= 20")
    start, whole = ld.build_index(first), ld.build_index(docs)
    index = ld.insert_documents(start, late)
    assert state(index) == state(whole) and filtered(index) == filtered(whole) > filtered(start)
    assert digests(ld.line_dedup(docs, index=index)) == brute(rows)
    back = ld.delete_documents(index, late)
    assert state(back) == state(start) and filtered(back) == filtered(start)
    assert digests(ld.line_dedup(first, index=back)) == brute([x for x in rows if x[0] < 20])
    assert state(ld.delete_documents(start, spark.createDataFrame([(999,), (None,)], "doc_id long"))) == state(start)


def test_filters_are_made_anew_when_they_overflow(spark, monkeypatch):
    monkeypatch.setattr(ld, "SHARD_LINES", 2)
    rows = made_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    start = ld.build_index(docs.filter("doc_id < 5"))
    index = ld.insert_documents(start, docs.filter("doc_id >= 5"))
    assert index.shards > start.shards and filtered(index) == {r.d1 for r in index.repeated.collect()}
    assert digests(ld.line_dedup(docs, index=index)) == brute(rows)


def test_null_ids_and_repeated_rows(spark):
    line = "L" * 50
    docs = spark.createDataFrame([(None, line), (1, line), (1, line), (2, line), (3, line), (4, line)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_dropped) for r in ld.line_dedup(docs).collect())
    assert got == [(0, 1), (1, 1), (1, 1), (2, 1), (3, 1), (4, 0)]
    assert ld.line_dedup(docs.limit(0)).collect() == []


def test_cuckoo_filter():
    keys = np.random.default_rng(1).integers(0, 2**64, 20_000, dtype=np.uint64)
    made = ld.CuckooFilter.for_keys(20_000)
    assert made.insert_all(keys[:12_000]) and made.insert_all(keys[12_000:])
    assert made.may_hold(keys).all()
    others = np.random.default_rng(2).integers(0, 2**64, 20_000, dtype=np.uint64)
    assert made.may_hold(others).mean() < 0.01
    assert all(made.delete(int(k)) for k in keys[:5000])
    assert made.may_hold(keys[5000:]).all() and made.may_hold(keys[:5000]).mean() < 0.01
    assert made.insert_all(keys[:5000]) and made.may_hold(keys).all()
    assert not ld.CuckooFilter.for_keys(100).insert_all(keys)
