import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from larder.llm import suffix_dedup as sd


def brute(rows):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[s : s + 400] for _, b in texts for s in range(len(b) - 399))
    out = []
    for i, b in texts:
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - 399):
            if seen[b[s : s + 400]] > 1:
                gone[s : s + 400] = True
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = int((np.diff(np.r_[False, gone].astype(int)) == 1).sum())
        out.append((i, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def made_rows():
    r = random.Random(7)
    some = lambda n: "".join(r.choices("abcdé \n", k=n))
    passage, base = some(700), some(3000)
    rows = [(i, some(r.randint(0, 900)) + passage[r.randint(0, 150) : r.randint(500, 700)] + some(r.randint(0, 900))) for i in range(40)]
    for i in range(40, 70):
        near = list(base)
        for _ in range(r.randint(0, 5)):
            near[r.randrange(3000)] = r.choice("xyz")
        rows.append((i, "".join(near)[r.randint(0, 300) :]))
    same = some(399)
    rows += [(80, same), (81, same), (82, same + "!"), (83, "q" + same + "!"), (84, "ab" * 1000), (85, "z" * 5000), (86, None), (87, ""), (88, base), (88, base), (None, base)]
    return rows + [(90, passage + some(50) + passage), (91, "\0" * 600 + some(30) + "\0" * 450)]


def digests(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


@pytest.mark.parametrize("large_group", [sd.LARGE_GROUP, 3])
def test_matches_brute_force(spark, large_group):
    rows = made_rows()
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, row int")
    assert digests(sd.suffix_dedup(docs, large_group=large_group)) == brute(rows)


def test_over_chunk_borders(spark):
    r = random.Random(8)
    long = "".join(r.choices("abcdefgh", k=sd._CHUNK + 900))
    rows = [(1, long), (2, "x" + long[sd._CHUNK - 300 : sd._CHUNK + 500]), (3, "y" + long[100:700])]
    assert digests(sd.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_empty_table(spark):
    assert sd.suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_deep_shallow_order_and_prefixes():
    r = random.Random(2)
    deep = ["a" * 100 + "".join(r.choices("ab", k=r.randint(0, 9))) for _ in range(200)]
    strings = [x.encode() for x in deep + ["".join(r.choices("ab", k=r.randint(0, 150))) for _ in range(200)] + ["", "a", "a"]]
    group = np.array([r.randrange(3) for _ in strings])
    order, lcp = sd.deep_shallow(*sd._symbols(strings, 160), group)
    assert [(group[i], strings[i]) for i in order] == sorted((g, s) for g, s in zip(group, strings))
    for k in range(1, len(order)):
        a, b = strings[order[k - 1]], strings[order[k]]
        common = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert lcp[k] == (common if group[order[k - 1]] == group[order[k]] else -1)


def test_filter_lets_its_keys_pass_and_few_others(spark):
    g = np.random.default_rng(4)
    keys, others = g.integers(-(2**63), 2**63, (2, 5000))
    made = sd._Filter(spark.createDataFrame([(int(x),) for x in keys], "key long"))
    test = made.tester()
    assert test(keys).all() and test(others).mean() < 0.01
    assert not sd._Filter(spark.createDataFrame([], "key long")).tester()(keys).any()
