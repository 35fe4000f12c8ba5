"""The pipeline over the smallest standard tables, with near-duplicates by exact similarity."""

import os

import pytest

import __spark_entry__
import corpus_pipeline
import test_bpe
import test_exact_dedup
import test_simhash

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no standard tables")


def test_stages_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.good_quality(spark, docs, SF).collect()]
    kept = [(i, text[i]) for i, *_, stays, _ in test_exact_dedup.brute(kept) if stays]
    groups, bits = test_simhash.near_brute(kept), test_simhash.brute(kept)
    assert any(groups[i] != i == bits[i][1] for i, _ in kept)  # near copies that op4's three bits leave
    kept = [(i, t) for i, t in kept if groups[i] == i]
    leaked = {r.doc_id for r in __spark_entry__.queries()["op3_decontaminate"](spark, SF).collect()}
    assert sorted([tuple(r) for r in corpus_pipeline.run(spark, SF).collect()], key=str) == test_bpe.brute([x for x in kept if x[0] not in leaked])


LONG = " ".join(f"word{i} here" for i in range(40_000))
ROWS = [(1, None), (2, ""), (3, " \t"), (None, "some text of no one"), (4, "a b"), (5, "ab "), (5, "ab "), (6, "a\tb"), (7, LONG), (8, LONG + "."), (9, "unlike the others é")]
KINDS = "doc_id long, text string, lang string, stats int, component_id string, text_sha256 string, row long, node long"


def made(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, "x", "y", 2, 3) for i, t in rows], KINDS)


def ids(df):
    return sorted(str(r.doc_id) for r in df.collect())


def test_stages_of_odd_rows_and_clashing_columns(spark):
    docs = made(spark, ROWS)
    for name, stage in corpus_pipeline.STAGES:
        left = stage(spark, docs, SF)
        assert name == "bpe" or (left.columns == docs.columns and set(ids(left)) <= set(ids(docs)))
        empty = stage(spark, docs.limit(0), SF)
        assert empty.columns == left.columns and empty.collect() == []
    assert ids(corpus_pipeline.distinct(spark, docs, SF)) == sorted(["None", "3", "4", "7", "8", "9"])  # of texts of one length the smallest id
    assert ids(corpus_pipeline.not_near(spark, docs, SF)) == sorted(["None", "1", "4", "5", "5", "7", "9"])
    assert ids(corpus_pipeline.decontaminated(spark, docs, SF)) == ids(docs)
    assert sorted([tuple(r) for r in corpus_pipeline.encoded(spark, docs, SF).collect()], key=str) == test_bpe.brute(ROWS)


def test_decontamination_removes_all_rows_of_a_leaking_document(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").filter("length(text) > 100").first().text
    docs = made(spark, [(1, f"so {item.upper()} it is"), (1, "another text"), (2, "clean"), (None, item), (None, "fine")])
    assert ids(corpus_pipeline.decontaminated(spark, docs, SF)) == ["2"]
