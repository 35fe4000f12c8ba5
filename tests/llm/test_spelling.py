import random
import re
import zlib
from collections import Counter

import pytest

from larder.llm import queries
from larder.llm import spelling as sp


def counted(rows):
    found = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            found[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def edited(w, letters):
    """All words one edit from ``w``."""
    near = {w[:i] + w[i + 1 :] for i in range(len(w))}
    near |= {w[:i] + c + w[i + k :] for i in range(len(w) + 1) for c in letters for k in (0, 1) if i + k <= len(w)}
    return near - {w}


def brute(count):
    letters, form, out = set("".join(count)), {}, []
    near = {w: [x for x in edited(w, letters) if x in count] for w in count}
    for w, own in near.items():
        best = min(own, key=lambda x: (-count[x], x), default=None)
        form[w] = best if best is not None and count[best] >= 10 * count[w] else None
    for w in count:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, count[w], len(near[w]), count[form[w]] if form[w] else None))
    return sorted(out)


def words(seed, k):
    """Many near words, also of a few hot beginnings and endings."""
    r, made = random.Random(seed), {}
    for _ in range(k):
        w = r.choice(["inter", "über", "", ""]) + "".join(r.choices("abé", k=r.randint(7, 9))) + r.choice(["ation", "", ""])
        made[w] = r.choice([2, 3, 30, 400, 5000])
    return made


@pytest.mark.parametrize("shard_words", [sp.SHARD_WORDS, 40])
def test_whole_results(spark, shard_words):
    count = words(2, 1500)
    rows = spark.createDataFrame([(w, n, "x", 1) for w, n in count.items()], "word string, n long, form string, route int")
    got = sorted(tuple(r) for r in sp.spelling_groups(rows, shard_words=shard_words).collect())
    want = brute(count)
    assert got == want and sum(r[2] != r[1] and r[1] is not None for r in want) > 0


def test_words_of_documents(spark):
    r = random.Random(8)
    pool = ["Hauptstadt", "hauptstdat", "información", "informacion", "INFORMATION", "naïveté", "wonderful", "wonderfull", "short", "a×÷bcdefg", "ÀÉÎabcd"]
    rows = [(i, " ".join(r.choices(pool, k=80)) + r.choice(["", ".", "-x", "\n"])) for i in range(120)]
    rows += [(None, "Wonderful wonderful"), (3, None), (4, ""), (5, "wonderful," * 300_000), (5, "wonderful " * 3), ("6", "x" * 2_500_000 + " Hauptstadt")]
    rows = [(None if i is None else int(i), t) for i, t in rows]
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, word int").repartition(7)
    count = counted(rows)
    assert {r.word: r.n for r in sp.word_counts(docs, read_as=queries.one_letter_less).collect()} == count
    assert sorted(tuple(r) for r in sp.spelling_groups(sp.word_counts(docs, read_as=queries.one_letter_less)).collect()) == brute(count)


def test_one_edit():
    for w in ("abcdefg", "aaaaaaa", "abababa"):
        near = edited(w, "abx")
        others = {x for y in near for x in edited(y, "abx")} - near - {w}
        assert all(sp.one_edit(w, x) and sp.one_edit(x, w) for x in near)
        assert not any(sp.one_edit(w, x) for x in others | {w})


def test_a_long_chain_and_ties(spark):
    chain = {"x" * 7 + "abcdefgh"[:k]: 10**k * 2 for k in range(9)}
    tied = {"tiedword": 2, "tiedwora": 50, "tiedworb": 50, "Tiedword": 50}
    rows = spark.createDataFrame([*(chain | tied).items(), (None, 5)], "word string, n long")
    got = {r.word: r for r in sp.spelling_groups(rows).collect()}
    assert set(got) == set(chain | tied) and got["x" * 7].root == "xxxxxxxabcdefgh" and got["tiedword"].form == "Tiedword"


def test_refused_and_empty(spark):
    none = spark.createDataFrame([], "word string, n long")
    assert sp.spelling_groups(none).collect() == []
    assert sp.word_counts(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    with pytest.raises(Exception, match="too short"):
        sp.spelling_groups(spark.createDataFrame([("short", 9)], "word string, n long")).collect()
    with pytest.raises(ValueError, match="twice"):
        sp.spelling_groups(none, times=1)
