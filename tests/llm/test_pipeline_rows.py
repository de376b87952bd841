"""Rows with null and repeated ids in each stage of the pipeline."""

import random

import pytest

pytest.importorskip("seqsieve.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_null_and_repeated_ids_in_quality(spark):
    words = "the river and a garden of old paper in the village was for music that people with water from this window".split()
    text = [" ".join(random.Random(k).choices(words, k=90)) for k in range(4)]
    rows = [(1, text[0], "en", "s", 0), (1, "x y z " * 60, "en", "s", 0), (None, text[1], "en", "s", 0), (None, "", "en", "s", 0), (2, text[2], None, "s", 0), (2, text[2], None, "s", 0), (3, None, None, None, None), (3, text[3], None, None, None)]
    kept = corpus_pipeline.quality_rules(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept) == sorted([("1", text[0]), ("None", text[1]), ("2", text[2]), ("2", text[2]), ("3", text[3])])


def test_null_and_repeated_ids_in_line_dedup(spark):
    rows = [(None, f"own line {k}\nwide line", "en", f"s{k}", 0) for k in range(9)] + [(5, "one text", "en", "s", 0), (5, "other text", "en", "s", 0)]
    done = corpus_pipeline.line_dedup(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    lines = [(str(r["doc_id"]), r["text"].split("\n")[0]) for r in done]
    assert sorted(lines) == sorted([("None", f"own line {k}") for k in range(9)] + [("5", "one text"), ("5", "other text")])


def test_null_and_repeated_ids_in_dedup(spark):
    text = {k: " ".join(f"v{random.Random(77 * k + i).randrange(5000)}" for i in range(70)) for k in range(5)}
    rows = [(None, text[0], "en", "s", 0), (None, text[1], "en", "s", 0), (7, text[2], "en", "s", 0), (7, text[3], "en", "s", 0), (None, text[3] + " end", "en", "s", 0), (9, text[4], "en", "s", 0), (9, text[4], "en", "s", 0)]
    kept = corpus_pipeline.simhash_dedup(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept) == sorted([("None", text[0]), ("None", text[1]), ("7", text[2]), ("7", text[3]), ("9", text[4])])
