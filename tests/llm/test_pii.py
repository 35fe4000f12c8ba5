import hashlib
import math
import random
import re
from collections import Counter

from larder.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, v):
    digits = [int(c) for c in v if c.isdigit()]
    if kind == "ip":
        return all(int(x) <= 255 for x in v.split("."))
    if kind == "card":
        twice = [d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(twice) % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def base(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid(k, m[0])]


TEXTS = [
    None, "", "no data here", "mail a.b@c.de_d@e.fr, x@y x@@y.z é😀 q@w.e.r.t.", "300.1.1.1.1 1.2.3.4.5.6.7.8 001.002.003.0255 1.2.3",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 79927398713 4111111111111111", "+1 (017) 555-7713 +49 30 1234 +1 +2345678901234567 call +123456789",
    "\x01a@b.cd\x02 \x03", "9" * 3000 + " " + "a" * 5000 + "@b.c", "1 2 3 4 5 6 7 8 9 0 1 2 3 4", "tab\t4111 1111\n1111 1111",
]


def test_base_spans_match_plain_regular_expressions(spark):
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(TEXTS)], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in pii.find_personal_data(docs).collect()}
    for i, text in enumerate(TEXTS):
        want = base(text)
        line = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert got[i].spans == line, text
        assert got[i].base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in PATTERNS] == [sum(x[0] == k for x in want) for k in PATTERNS]


def filler(r, n):
    return " ".join("".join(r.choices("abcdefghijklmnoprstuv", k=r.randint(3, 7))) for _ in range(n))


def corpus(seed, people, documents):
    """Documents of rare words; each person has a name beside an address in some, and once far from it."""
    r, rows, names = random.Random(seed), [], {}
    for p in range(people):
        name = f"Zq{'abcdefghijklmnopqrst'[p % 20]}x{'uvwxyz'[p // 20 % 6]}son"
        names[name.lower()] = f"w{p}.{r.randrange(99)}@mail{p % 9}.example.org"
        for _ in range(6):
            rows.append(f"{filler(r, 60)} {name} {filler(r, 2)} {names[name.lower()]} {filler(r, 60)}")
        rows.append(f"{filler(r, 40)} {name} {filler(r, 40)}")
    while len(rows) < documents:
        rows.append(filler(r, 30) + r.choice(["", f" x{len(rows)}@mail{r.randrange(9)}.example.org ", " 10.1.2.3 "]) + filler(r, 30))
    return list(enumerate(rows)), names


def test_planted_names_are_found_and_little_else(spark):
    """Recall and precision do not fall as the corpus grows."""
    for documents in (600, 3000):
        rows, names = corpus(3, 40, documents)
        found = {r.doc_id: [tuple(map(int, x.split(":")[1:])) for x in r.spans.split(",") if x.startswith("term")] for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
        words = Counter(rows[i][1][a:b].lower() for i, spans in found.items() for a, b in spans)
        right = sum(n for w, n in words.items() if w in names)
        assert right >= 0.9 * 40 * 7 and right >= 0.95 * sum(words.values()), (documents, words.most_common(5))


def test_copies_and_single_meetings_show_nothing(spark):
    r = random.Random(5)
    once = [f"{filler(r, 30)} Zanzibar bob@x.org {filler(r, 30)}"]
    rows = list(enumerate(once * 200 + [filler(r, 40) for _ in range(400)] + [f"{filler(r, 20)} Quux{i} a{i}@y{i}.org {filler(r, 20)}" for i in range(50)]))
    assert not any("term" in x.spans for x in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def near(text, start, end):
    """Words of three letters or more within 80 characters of a span, not cut and not in an address, in order."""
    taken = [(s, e) for k, s, e in base(text) if k == "email"]
    for m in re.finditer(r"[^\W\d_]{3,}", text):
        inside = start - 80 <= m.start() and m.end() <= start or end <= m.start() and m.end() <= end + 80
        if inside and not any(s < m.end() and m.start() < e for s, e in taken) and not any(m.end() == s or m.start() == e for s, e in taken):
            yield m[0].lower()


def discloses(both, term, entity, seen, places, n, pairs, doubt):
    left = -math.log2((both + entity / n) / (max(term, both) + 1))
    expected = places * max(term, both) / n
    return left <= doubt and seen >= 2 and seen > expected and seen * (1 + math.log(expected / seen)) - expected <= math.log(0.05 / pairs)


def brute_terms(rows, doubt=pii.DOUBT):
    """By row number: (start, end, put) of the terms that disclose, wherever they stand."""
    words = Counter(w for _, t in rows for w in {x.lower() for x in re.findall(r"[^\W\d_]{3,}", t)})
    both, seen, entity, places = {}, {}, {}, {}
    for k, (_, text) in enumerate(rows):
        for kind, s, e in base(text):
            v, around = text[s:e].lower(), tuple(near(text, s, e))
            group = {"email": v.split("@")[-1], "ip": ".".join(v.split(".")[:3])}.get(kind, re.sub("[^0-9]", "", v)[:6])
            for key in ((kind, v), (kind, "group", group)):
                entity.setdefault(key, set()).add(k)
                places.setdefault(key, set()).add(around)
                for w in around:
                    both.setdefault((w, key), set()).add(k)
                    seen.setdefault((w, key), set()).add(around)
    n, bad = len(rows), {}
    for (w, key), held in both.items():
        rule = lambda b, t, c, key=key: discloses(b, t, len(entity[key]), c, len(places[key]), n, len(both), doubt)
        if rule(len(held), words[w], len(seen[w, key])):
            put = ""
            for letters in (1, 3):
                same = [x for x, k in both if k == key and x[:letters] == w[:letters]]
                if len(w) > letters and not rule(sum(len(both[x, key]) for x in same), sum(c for x, c in words.items() if x[:letters] == w[:letters]), sum(len(seen[x, key]) for x in same)):
                    put = w[:letters] + "*"
            bad[w] = min(bad.get(w, put), put, key=lambda x: (len(x), x))
    out = {}
    for k, (_, text) in enumerate(rows):
        taken = [(s, e) for kind, s, e in base(text) if kind == "email"]
        out[k] = {(m.start(), m.end(), bad[m[0].lower()]) for m in re.finditer(r"[^\W\d_]{3,}", text) if m[0].lower() in bad and not any(s <= m.end() and m.start() <= e for s, e in taken)}
    return out


def test_terms_match_a_plain_count(spark):
    r = random.Random(4)
    common = ["line", "office", "open", "number", "please", "write", "café"]
    rows = []
    for i in range(900):
        body = [r.choice(common) for _ in range(r.randint(3, 9))] + filler(r, r.choice([0, 0, 30])).split()
        if i % 3 == 0:
            who = r.randrange(12)
            body.insert(r.randrange(len(body)), r.choice([f"w{who}@firm{who % 4}.org"] * 5 + [f"10.0.{who}.7", "+49 30 1234567"]))
            body.insert(r.randrange(len(body)), r.choice([f"name{'abcdefghijkl'[who]}son", f"{'abcdefghijkl'[who]}zq", "Rare" + "".join(r.choices("abcdef", k=4))]))
        rows.append((i // 2, r.choice([" ", "\n"]).join(body)))
    rows += [rows[0], (None, rows[3][1]), (9000, "x" * 1020 + " namea" + "son w0@firm0.org " + "y " * 700), (9001, "bob.nameason@firm0.org nameason@x nameason")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for doubt in (pii.DOUBT, 3.0):
        expected, seen = Counter(), Counter()
        for k, found in brute_terms(rows, doubt).items():
            line = ",".join(f"{kind}:{s}:{e}" for kind, s, e in base(rows[k][1]))
            expected[rows[k][0], hashlib.sha256(line.encode()).hexdigest(), tuple(sorted(found))] += 1
        for row in pii.find_personal_data(docs, doubt=doubt).collect():
            terms = tuple((int(a), int(b), put) for a, b, put in (x.split(":") for x in row.decisions.split(",") if x))
            assert [x for x in row.spans.split(",") if x.startswith("term")] == [f"term:{a}:{b}" for a, b, _ in terms]
            seen[row.doc_id, row.base_sha256, terms] += 1
        assert seen == expected and sum(len(x) for *_, x in seen) > 20


def test_a_term_becomes_the_longest_prefix_that_discloses_less(spark):
    r = random.Random(6)
    rows = [f"{filler(r, 3)} Zanzibar {filler(r, 2)} bob@x.org {filler(r, 9)}" for _ in range(9)] + [f"the zany zankey keeper zipped {filler(r, 5)}" for _ in range(900)] + ["to Zanzibar"]
    got = {x.doc_id: x for x in pii.find_personal_data(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    at = rows[0].index("Zanzibar")
    assert f"{at}:{at + 8}:zan*" in got[0].decisions.split(",") and got[909].decisions == "3:11:zan*" and got[20].decisions == ""
    clean = {x.doc_id: x.text for x in pii.sanitise(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert clean[909] == "to zan*" and "zan* " in clean[0] and "[EMAIL]" in clean[0] and clean[20] == rows[20]


def test_a_text_with_very_many_addresses(spark):
    """Work grows with the text, not with its square."""
    import time

    text = "\n".join(f"2024-01-01 GET /a user{i}@host{i % 7}.example.org from 10.{i % 200}.0.{i % 250} in {i} ms okay" for i in range(4000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.perf_counter()
    row = pii.find_personal_data(docs).first()
    line = ",".join(f"{k}:{s}:{e}" for k, s, e in base(text))
    assert row.base_sha256 == hashlib.sha256(line.encode()).hexdigest() and (row.n_email, row.n_ip) == (4000, 4000)
    assert time.perf_counter() - began < 60  # most of it is for starting jobs


def test_empty_table_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a@b.cd"), (1, "a@b.cd"), (None, "a@b.cd"), (1, "no")], "doc_id long, text string")
    assert sorted(r.spans for r in pii.find_personal_data(docs).collect()) == ["", "email:0:6", "email:0:6", "email:0:6"]
    assert pii.find_personal_data(docs.limit(0)).collect() == []
