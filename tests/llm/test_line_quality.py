"""The field over lines: messages against enumeration, features against counting, held-out accuracy."""

import zlib
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqsieve.llm import line_quality as lq
from seqsieve.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string"


def test_marginals_equal_enumeration():
    rnd = np.random.default_rng(5)
    counts = np.array([1, 4, 2, 7, 1])
    n = counts.sum()
    bins = rnd.integers(0, 3, (n, len(lq.FEATURES)))
    weights, ties = rnd.normal(0, 0.3, 3 * lq.SIZE + 2), rnd.normal(0, 1, (2, 2))
    chains = lq.Chains(bins, counts)
    unary = chains.potentials(weights)
    good, joint = chains.marginals(weights, ties)
    at = 0
    for c in counts:
        total, one, two = 0.0, np.zeros(c), np.zeros((c, 2, 2))
        for labels in product((0, 1), repeat=int(c)):
            p = np.exp(sum(unary[at + i] * x for i, x in enumerate(labels)) + sum(ties[a, b] for a, b in zip(labels, labels[1:])))
            total += p
            one += p * np.array(labels)
            for i in range(1, c):
                two[i, labels[i - 1], labels[i]] += p
        assert np.allclose(good[at : at + c], one / total)
        assert np.allclose(joint[at : at + c], two / total)
        at += c


def test_neighbours_give_features():
    lines = [b"One two.", b"!!", b"One two three"]
    bins = lq.line_features([lines, [b"alone"]])
    chains = lq.Chains(bins, np.array([3, 1]))
    assert bins.shape == (4, len(lq.FEATURES))
    name = {n: i for i, n in enumerate(lq.FEATURES)}
    assert bins[:, name["words"]].tolist() == [1, 1, 2, 1] and bins[:, name["first"]].tolist() == [1, 0, 0, 1] and bins[:, name["last"]].tolist() == [0, 0, 1, 1]
    assert (chains.places[3, len(lq.FEATURES) : 2 * len(lq.FEATURES)] == lq.NO_BEFORE).all()
    assert (chains.places[1, 2 * len(lq.FEATURES) :] == chains.places[2, : len(lq.FEATURES)] + 2 * lq.SIZE).all()


def test_long_chain_needs_few_rounds():
    n = 300_000
    chains = lq.Chains(np.zeros((n, len(lq.FEATURES)), np.int64), np.array([n]))
    good, _ = chains.marginals(np.zeros(3 * lq.SIZE + 2), np.array([[1.0, 0.0], [0.0, 1.0]]))
    assert np.allclose(good, 0.5)


def test_good_lines_of_bad_documents_are_found(spark):
    """A third of the documents hold two lines of junk somewhere; labels say so only for the whole."""
    rnd = np.random.default_rng(2)
    words = ["fox", "hill", "the", "over", "brown", "was", "quick", "gone", "rain", "and", "stone", "river"]
    clean = lambda: " ".join(rnd.choice(words, rnd.integers(4, 14))).capitalize() + "."
    junk = lambda: " ".join(w.upper() + "!!" for w in rnd.choice(words, rnd.integers(4, 14)))
    made = []
    for i in range(400):
        lines = [clean() for _ in range(rnd.integers(4, 12))]
        for at in rnd.integers(0, len(lines), 2) if i % 3 == 0 else []:
            lines[at] = junk()
        made.append(lines)
    docs = spark.createDataFrame([(i, "\n".join(lines), "en") for i, lines in enumerate(made)], SCHEMA)
    model = lq.fit(docs, spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(len(made))], "doc_id long, quality int"))
    lines = [[x.encode() for x in made[i]] for i in range(0, 400, 3)]
    good, _ = lq.Chains(lq.line_features(lines), np.array(list(map(len, lines)))).marginals(model.weights, model.ties)
    is_junk = np.array([b"!!" in x for some in lines for x in some])
    assert good[is_junk].max() < 0.5 and (good[~is_junk] > 0.5).mean() > 0.6


def test_rare_rows(spark):
    texts = [None, "", " \n\t\n", "word", "x" * 200_000, "a\n" * 50_000, "A fine line of text.\nAnd one more.", "!!! ### |||"]
    rows = [(i, t, None) for i, t in enumerate(texts)] + [(None, "null id", "en"), (3, "word", "de"), (3, "other text", "de")]
    rows += [(100 + i, "Some good text, as it is.\nMore of it." if i % 2 else "JUNK!! JUNK!! JUNK!!", "en") for i in range(80)]
    labels = [(100 + i, i % 2) for i in range(80)] + [(3, None), (None, 1), (101, 1), (999, 0)]
    docs, said = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int")
    more = docs
    for name in ("held_out", "score", "predicted", "quality", "label", "_id", "_label", "bins", "sizes"):
        more = more.withColumn(name, F.lit("x"))
    got = lq.score_documents(more, said).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[0]["score"] == by_id[1]["score"] == by_id[2]["score"]
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert all(by_id[100 + i]["predicted"] == i % 2 for i in range(80))
    # neither language nor id counts, and a score is of the text alone
    other = lq.score_documents(docs.withColumn("lang", F.lit("fr")), said).collect()
    assert sorted((str(r["doc_id"]), r["score"]) for r in got) == sorted((str(r["doc_id"]), r["score"]) for r in other)
    assert lq.score_documents(docs.limit(0), said).collect() == []
    assert {r["score"] for r in lq.score_documents(docs, said.limit(0)).collect()} == {0.5}


def test_held_out_labels_are_not_read(spark, data):
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    scores = [{r["doc_id"]: r["score"] for r in lq.score_documents(docs, x).collect()} for x in (labels, turned)]
    assert scores[0].keys() == scores[1].keys() and all(abs(scores[0][i] - scores[1][i]) < 1e-9 for i in scores[0])


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_held_out_accuracy(spark, folder):
    said = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    rows = QUERIES["op12_line_quality"](spark, folder).join(said, "doc_id").where("held_out").select("score", "predicted", "quality").toPandas()
    assert (rows["predicted"] == rows["quality"]).mean() > 0.98
    ranks = rows["score"].rank()
    good = rows["quality"] == 1
    auc = (ranks[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert auc > 0.995
