import random
import zlib

from larder.llm import quality


def made(n=600):
    r = random.Random(9)
    words = ["the", "river", "runs", "through", "a", "quiet", "town", "and", "people", "walk"]
    good = lambda: " ".join(r.choices(words, k=r.randint(20, 80))).capitalize() + "."
    bad = lambda: "".join(r.choices("!!!$$$ BUY 0123 |", k=r.randint(50, 300)))
    docs = [(i, good() if i % 2 else bad()) for i in range(n)] + [(n, None), (n + 1, ""), (None, "no id"), (1, "repeated row here"), (n + 2, "word " * 50_000)]
    return docs, [(i, i % 2) for i in range(n)] + [(None, 1), (5, None)]


def test_held_out_accuracy_and_columns(spark):
    rows, labels = made()
    docs = spark.createDataFrame([(i, t, 0.5, "x") for i, t in rows], "doc_id long, text string, score double, stats string")
    model = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert model.weighted
    got = quality.score_documents(docs, model).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    known = dict(labels[:600])
    asked = [r for r in got if r.held_out and r.doc_id in known]
    assert sum(r.predicted == known[r.doc_id] for r in asked) / len(asked) > 0.97
    kept = quality.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)


def test_one_label_none_and_empty_tables(spark):
    rows, _ = made(20)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for labels in ([], [(i, 1) for i in range(20)]):
        model = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        assert model.weighted == () and quality.score_documents(docs, model).count() == len(rows)
    assert quality.score_documents(docs.limit(0), model).collect() == []


def test_statistics_of_empty_text():
    assert not any(quality.text_statistics(b""))
    assert quality.text_statistics("É a A!".encode())[quality.NAMES.index("mean_word")] == 4 / 3


def test_a_sample_by_hash_is_that_of_the_whole_order(spark):
    from pyspark.sql import functions as F

    from larder.llm.common import least_by_hash

    rows = spark.range(20_000)
    want = [r.id for r in rows.orderBy(F.xxhash64("id"), "id").limit(500).collect()]
    assert [r.id for r in least_by_hash(rows, 500, "id").collect()] == want
    assert least_by_hash(rows.limit(7), 500, "id").count() == 7 and least_by_hash(rows.limit(0), 5, "id").collect() == []


def test_many_rows_of_one_labelled_document_stay_within_the_bound(spark):
    docs = spark.createDataFrame([(i % 3 + 2, f"text {i}", 1) for i in range(300)], "doc_id long, text string, stats int")
    labels = spark.createDataFrame([(2, 1), (3, 0), (4, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels, max_rows=50)
    left = quality.accepted(docs, model)
    assert left.columns == docs.columns and left.count() <= 300
