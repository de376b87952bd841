"""The pipeline, stage by stage, against brute force on a small fixture."""

import random

import pytest

pytest.importorskip("seqsieve.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
from pyspark.sql import functions as F  # noqa: E402

from seqsieve.llm.quality import judge  # noqa: E402
from tests.llm.test_documents import brute_lines  # noqa: E402
from tests.llm.test_shingle_similarity import brute_pairs, brute_sets, groups  # noqa: E402


def test_stages(spark, tmp_path):
    words = "the river and a garden of old paper in the village was for music that people with water from this window".split()
    text = lambda k, n=90: " ".join(random.Random(k).choices(words, k=n))
    rows = [(k, text(k), "en", f"s{k % 12}", 0) for k in range(30)]
    rows += [(100 + k, text(1) + ("" if k % 2 else " end"), "en", f"s{k}", 0) for k in range(5)] + [(200 + k, f"shared header line\n{text(40 + k)}", "en", f"s{k}", 0) for k in range(10)]
    rows += [(300, "short", "en", "s1", 0), (301, None, "en", "s1", 0), (302, "", None, None, 0), (303, "x y z " * 60, "en", "s2", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    a = stages["quality_rules"](spark, docs, str(tmp_path))
    assert a.columns == docs.columns
    assert {r["doc_id"] for r in a.collect()} == {r["doc_id"] for r in judge(docs, min_words=1).where("kept").collect()} and 300 in {r["doc_id"] for r in a.collect()} and not {301, 302, 303} & {r["doc_id"] for r in a.collect()}
    held = [(r["doc_id"], r["text"], r["source"]) for r in a.collect()]
    b = stages["line_dedup"](spark, a, str(tmp_path))
    assert b.columns == docs.columns
    want = {i: t for i, _, n, t in brute_lines(held, 8) if not (n and not t.strip())}
    got = {str(r["doc_id"]): r["text"] for r in b.collect()}
    assert got == want and sum(t.startswith("shared header line") for t in got.values()) == 1
    c = stages["simhash_dedup"](spark, b, str(tmp_path))
    assert c.columns == docs.columns
    ids = sorted(int(i) for i in got)
    comp = {ids[k] for k in groups(len(ids), brute_pairs(brute_sets([got[str(i)] for i in ids])))}
    assert {r["doc_id"] for r in c.collect()} == comp and len(comp) < len(ids)
    d = stages["packing"](spark, c, str(tmp_path))
    assert {r["doc_id"] for r in d.collect()} == comp
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert run.select("doc_id", "start", "length", "ids_crc32").exceptAll(d.select("doc_id", "start", "length", "ids_crc32")).count() == 0
    none = docs.where(F.lit(False))
    assert all(stage(spark, none, "").count() == 0 for stage in stages.values())
    more = docs.withColumns({c: F.lit("clash") for c in ("key", "kept", "row_key", "window", "round", "fp", "n_lines", "lang_", "band", "n_words", "_key", "_n", "_flags", "__key", "KEY_", "n_removed", "doc_key", "gone", "line_key", "set_key", "first", "_rn", "rid")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain = lambda d: sorted(map(str, d.select(docs.columns).collect()))
        assert plain(stage(spark, more, "")) == plain(stage(spark, docs, "")), name
