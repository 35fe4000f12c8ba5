import random
import re

import numpy as np
import pytest
import xxhash

from larder.llm import simhash


def brute(rows):
    prints = {}
    for i, text in rows:
        t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        s = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in s]
        prints.setdefault(i, sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    ids = sorted(prints)
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3 and root(a) != root(b):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (f"{prints[i]:016x}", root(i)) for i in ids}


def made_rows():
    r = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(r.choices(words, k=r.randint(0, 60)))) for k in range(120)]
    base = r.choices(words, k=400)
    for k in range(200, 260):
        near = list(base)
        for _ in range(r.randint(0, 4)):
            near[r.randrange(400)] = r.choice(words)
        rows.append((k, "\t".join(near).upper() if k % 2 else "\n ".join(near)))
    return rows + [(300, ""), (301, None), (302, " \t\n"), (303, "one"), (304, "One two"), (305, "é É ẞ"), (306, "x " * 5000)]


def test_groups_match_brute_force(spark):
    rows = made_rows()
    docs = spark.createDataFrame([(i, t, "a", 1) for i, t in rows], "doc_id long, text string, fp string, component_id int")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_groups(docs).collect()}
    assert got == brute(rows)


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, "z z z")], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in simhash.simhash_groups(docs).collect())
    assert got == [(False, 1, 1), (False, 1, 1), (False, 2, 2), (True, 0, 1)]
    assert simhash.simhash_groups(docs.limit(0)).collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_bk_tree_finds_all_neighbours(seed):
    g = np.random.default_rng(seed)
    centre = g.integers(0, 2**63, 5, dtype=np.uint64)
    values = np.unique(np.concatenate([centre[g.integers(0, 5, 400)] ^ (np.uint64(1) << g.integers(0, 20, 400, dtype=np.uint64)) ^ (np.uint64(1) << g.integers(0, 64, 400, dtype=np.uint64)), g.integers(0, 2**63, 50, dtype=np.uint64)]))
    tree = simhash.BKTree(values)
    got = {(int(a), int(b)) for q, n in tree.within(values, 3) for a, b in zip(q, n)}
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 3
    assert got == {(int(a), int(b)) for a, b in zip(*np.nonzero(near))}


@pytest.mark.parametrize("most", [7, 1])
def test_overfull_shards_are_cut_again(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "SHARD_VALUES", most)
    monkeypatch.setattr(simhash, "FOREST_VALUES", 16)
    rows = made_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_groups(docs).collect()}
    assert got == brute(rows)


def test_one_of_each_keeps_one_document_of_a_group(spark):
    rows = made_rows()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string")
    left = simhash.one_of_each(docs)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == sorted({c for _, c in brute(rows).values()})


def near_brute(rows):
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sorted(sets):
        for b in sorted(sets):
            same = sets[a] == sets[b] or (sets[a] | sets[b]) and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
            if a < b and same and root(a) != root(b):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: root(i) for i in sets}


@pytest.mark.parametrize("part", [None, 1500])
def test_near_groups_match_exact_similarity(spark, monkeypatch, part):
    if part:  # shards in parts, and few rows together
        monkeypatch.setattr(simhash, "PART_GRAMS", part)
        monkeypatch.setattr(simhash, "FOREST_VALUES", 16)
    r = random.Random(8)
    words = [f"w{k}" for k in range(3000)]
    rows = made_rows()
    for family in range(12):  # one family's copies differ in up to 12 of 200 words, so some links hold and some don't
        base = r.choices(words, k=200)
        for k in range(20):
            near = list(base)
            for _ in range(r.randint(0, 12)):
                near[r.randrange(200)] = r.choice(words)
            rows.append((1000 + 100 * family + k, " ".join(near)))
    want = near_brute(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.doc_id: x.component_id for x in simhash.near_groups(docs).collect()} == want
    old = {x.doc_id: x.component_id for x in simhash.simhash_groups(docs).collect()}
    assert any(old[i] == i != want[i] for i in want)  # links that three bits don't find
    left = simhash.one_of_each(docs, groups=simhash.near_groups)
    assert sorted(x.doc_id for x in left.collect()) == sorted(set(want.values()))


def test_links_of_shards_join_what_is_similar(monkeypatch):
    monkeypatch.setattr(simhash, "PAIRS_TOGETHER", 50)
    monkeypatch.setattr(simhash, "GRAMS_TOGETHER", 300)
    g = np.random.default_rng(3)
    rows = []
    for shard in range(30):
        base = g.integers(-(2**62), 2**62, 40)
        for _ in range(g.integers(1, 25)):
            own = np.unique(np.r_[base[g.random(40) > g.choice([0, 0.1, 0.2])], g.integers(-(2**62), 2**62, g.integers(0, 6))])
            rows.append((shard, simhash.majority_bits(own.view(np.uint64)), own))
    rows.sort(key=lambda x: x[:2])
    shard, fp, size = np.array([x[0] for x in rows]), np.array([x[1] for x in rows]), np.array([len(x[2]) for x in rows])
    label = np.where(g.random(len(rows)) < 0.1, 10**6 + shard, np.arange(len(rows)))  # some are joined already
    up = {int(x): int(x) for x in label}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    def join(a, b):
        x, y = sorted((root(int(a)), root(int(b))))
        up[y] = x

    for i in range(len(rows)):
        for j in range(i):
            a, b = set(rows[i][2].tolist()), set(rows[j][2].tolist())
            if shard[i] == shard[j] and len(a & b) / len(a | b) >= 0.8:
                join(label[i], label[j])
    want = {x: root(x) for x in up}
    a, b = simhash.near_links(np.r_[True, shard[1:] != shard[:-1]], fp, label, np.r_[0, np.cumsum(size)], np.concatenate([x[2] for x in rows]), 64, 0.8)
    up.update({x: x for x in up})
    for x, y in zip(a, b):
        join(x, y)
    assert {x: root(x) for x in up} == want and len(set(want.values())) < len(want)


def test_near_groups_of_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (1, "A b c d"), (None, "a b c d"), (2, "z z z"), (3, ""), (4, None)], "doc_id long, text string")
    got = sorted((x.doc_id is None, x.doc_id or 0, x.component_id) for x in simhash.near_groups(docs).collect())
    assert got == [(False, 1, 1), (False, 1, 1), (False, 2, 2), (False, 3, 3), (False, 4, 3), (True, 0, 1)]
    assert simhash.near_groups(docs.limit(0)).collect() == []
