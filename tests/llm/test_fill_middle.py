import hashlib
import random
import re

from larder.llm import fill_middle as fm

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def texts():
    r = random.Random(5)
    letters = "abc é漢😀\n\t\x0b\x0c\r\x1f .<>PSM"
    made = ["".join(r.choices(letters, k=r.randint(0, 60))) for _ in range(300)]
    return made + ["", None, " ", " \n ", "x", "a ", " a", "a <P> b", "<S>", "b<M", "<P <S <M " * 9, "one two\n" * 40_000, "y" * 300_000]


def brute(rows):
    out = []
    for i, text in rows:
        text = text or ""
        tokens = TOKEN.findall(text)
        h = [int(x, 16) for x in re.findall("." * 8, hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest())[:4]]
        n, sha = len(tokens), lambda s: hashlib.sha256(s.encode()).hexdigest()
        if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
            out.append((i, n, "plain", None, None, sha(text), sha(text)))
            continue
        low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        p, m, s = "".join(tokens[:low]), "".join(tokens[low:high]), "".join(tokens[high:])
        form = "spm" if h[3] % 100 < 80 else "psm"
        made = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
        out.append((i, n, form, len(p), len(m), sha(made), sha(text)))
    return sorted(out, key=str)


def test_whole_results(spark):
    rows = [*enumerate(texts()), (None, "no id here"), (4, "twice here"), (4, "twice here")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, output string, n int")
    got = sorted([tuple(r) for r in fm.round_trip(docs).collect()], key=str)
    assert got == brute(rows)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_restored_from_the_output_alone(spark):
    rows = list(enumerate(texts()))
    made = fm.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"))
    back = made.select("doc_id", fm.restored(made.output, made.form).alias("text"))
    assert {r.doc_id: r.text for r in back.collect()} == {i: t or "" for i, t in rows}


def test_bits_against_plain_loops():
    r = random.Random(1)
    for size in [*range(20), 64, 65, 999]:
        text = "".join(r.choices("ab \n", k=size)).encode()
        ends = [m.end() - 1 for m in TOKEN.finditer(text.decode())]
        bits = fm.token_ends(text)
        assert [i for i in range(size) if bits >> i & 1] == ends and bits.bit_count() == len(ends)
        assert [fm.select(bits, k + 1) for k in range(len(ends))] == ends


def test_another_seed_cuts_elsewhere():
    assert fm.draws(1, 42) != fm.draws(1, 43) and fm.draws(1, 42) == fm.draws(1, 42)


def test_empty_table(spark):
    assert fm.round_trip(spark.createDataFrame([], "doc_id long, text string")).collect() == []
