import random

from larder.llm import decontaminate as dc


def nearest(pattern, text):
    """Least edits between the pattern and any passage of the text, by the plain table."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        last, row[0] = row[0], 0
        for i, p in enumerate(pattern, 1):
            last, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, last + (p != c))
        best = min(best, row[-1])
    return best


def brute(docs, items):
    out = set()
    for d, text in docs:
        for i, item in items:
            p = dc.normal(item or "")
            if len(p.replace(" ", "")) < dc.MIN_LETTERS:
                if p and f" {p} " in f" {dc.normal(text or '')} ":
                    out.add((d, i, 0))
                continue
            if (n := nearest(p, dc.normal(text or ""))) <= int(len(p) * dc.ERROR_RATE):
                out.add((d, i, n))
    return out


def made():
    r = random.Random(4)
    some = lambda n: " ".join("".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(n))
    items = [(i, some(14)) for i in range(12)] + [(12, "too short"), (13, None), (None, some(14))]
    items.append((14, items[0][1]))
    docs = [(i, some(60)) for i in range(30)] + [(30, None), (31, ""), (32, items[3][1]), (33, "It is Too-short!"), (34, "too shorts"), (35, "not too short, no"), (36, items[14][1]), (37, some(4000) + " " + items[5][1] + some(3000))]
    for k in range(40, 80):
        text = list(items[k % 12][1])
        for _ in range(r.randint(0, 9)):
            at = r.randrange(len(text))
            text[at : at + r.randint(0, 1)] = r.choice(["", "x", "q"])
        docs.append((k, f"{some(20)} {''.join(text).upper()}, {some(20)}"))
    return docs, items


def test_matches_brute_force(spark, monkeypatch):
    rows, items = made()
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, doc_id int")
    want = brute(rows, items)
    assert len(want) > 20
    assert {(r.doc_id, r.item_id, r.distance) for r in dc.find_leaks(docs, bench).collect()} == want
    monkeypatch.setattr(dc, "BLOCK_BYTES", 200)
    found = dc.find_leaks(docs, bench)
    assert {(r.doc_id, r.item_id, r.distance) for r in found.collect()} == want and found.count() == len(want)
    left = dc.without_leaks(docs, bench)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == sorted({i for i, _ in rows} - {x[0] for x in want})


def test_places_are_those_of_the_normal_form(spark):
    found = dc.Matcher([(1, "too short"), (2, "abcdefgh " * 6 + "end")], 0.07).find("too short and abcdefgh " + "abcdefgh " * 5 + "end too short")
    assert sorted(found) == [(1, 0, 0, 9), (2, 0, 14, 71)]
    assert dc.Matcher([(1, "too short")], 0.07).find("x too short") == [(1, 0, 2, 11)]


def test_repeated_rows_and_empty_tables(spark):
    rows, items = made()
    docs = spark.createDataFrame([(1, items[0][1]), (1, items[0][1]), (None, items[0][1])], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert sorted([(r.doc_id, r.item_id) for r in dc.find_leaks(docs, bench).collect()], key=str) == sorted([(i, k) for i in (1, 1, None) for k in (0, 14)], key=str)
    assert dc.find_leaks(docs.limit(0), bench).collect() == [] and dc.find_leaks(docs, bench.limit(0)).collect() == []
    assert dc.without_leaks(docs, bench.limit(0)).count() == 3


def test_myers_matches_the_table():
    r = random.Random(6)
    for _ in range(200):
        p, t = ("".join(r.choices("ab", k=r.randint(1, 90))) for _ in range(2))
        bits = {}
        for i, c in enumerate(p):
            bits[c] = bits.get(c, 0) | 1 << i
        assert min(dc.myers_search(bits, len(p), t, len(p))[0], len(p)) == nearest(p, t)
