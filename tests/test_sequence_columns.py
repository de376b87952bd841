"""Feature columns against loops over the text, on odd sequences too; and how much work they do."""

import random

import pyarrow as pa
import pytest

from seqsieve.functions import sequence as S
from seqsieve.functions.constants import SITES, WILD_TYPE

ODD = [WILD_TYPE, "AAAA", "", "A", "ACACACA", "ééACGUé", "acgu", "A C,GU", WILD_TYPE[:60], WILD_TYPE + "AAAAA" * 40, None]


def _texts():
    rng = random.Random(5)
    return [*ODD, *("".join(rng.choice("ACGUN") for _ in range(rng.randrange(200))) for _ in range(40))]


def test_counts_equal_a_loop():
    texts = _texts()
    got = S.mer_counts(pa.array(texts), (1, 2, 3))
    names = [a for a in "ACGU"] + S.DIMERS + [a + d for a in "ACGU" for d in S.DIMERS]
    for row, s in zip(got, texts, strict=True):
        assert row.tolist() == [sum((s or "")[i : i + len(m)] == m for i in range(len(s or ""))) for m in names], s
    spans = [(max(1, p - 5), min(len(WILD_TYPE), p + 5)) for p in SITES]
    for row, s in zip(S.dimer_counts(pa.array(texts), spans), texts, strict=True):
        assert row.tolist() == [sum((s or "")[i - 1 : i + 1] == d for i in range(*span)) for span in spans for d in S.DIMERS], s
    sliced = pa.array(texts).slice(3, 6)
    assert (S.mer_counts(sliced, (2,)) == got[3:9, 4:20]).all()
    assert S.mer_counts(pa.array([], pa.string()), (1, 2)).shape == (0, 20)


def test_columns_of_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, WILD_TYPE)], "id int, s string")
    k, d = S.kmer_deltas(df["s"]), S.dimers_around(df["s"])
    rows = df.select("id", k["kmer_AA"].alias("k"), d["wd_p30_AA"].alias("d")).orderBy("id").collect()
    assert rows[0]["k"] == 0.0 and rows[0]["d"] is None and rows[1]["k"] == 0.0 and rows[1]["d"] is not None


def test_tokens_equal_a_loop(spark):
    texts = [" acgt ", *_texts()]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, s string")

    def loop(s):
        n = (s or "").upper().replace("T", "U").strip(" ")
        return [1, *(S.VOCABULARY.get(n[i : i + 3], 4) if set(n[i : i + 3]) <= set("ACGU") else 4 for i in range(len(n) - 2)), 2]

    for r in df.select("s", S.tokens(df["s"]).alias("t")).collect():
        assert r["t"] == loop(r["s"]), r["s"]


@pytest.mark.parametrize("view", ["variants", "dense_variants"])
def test_a_small_file_is_more_than_one_task(spark, data, view):
    from seqsieve.sources.views import view as made

    assert made(spark, data, view).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_a_row_is_counted_once_for_all_columns(spark):
    """One Python evaluation a row, however many columns are taken from it."""
    df = spark.createDataFrame([(WILD_TYPE,)], "s string")
    for columns in (S.kmer_deltas(df["s"]), S.dimers_around(df["s"])):
        plan = df.select(*[c.alias(n) for n, c in columns.items()])._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") <= 1 and plan.split("ArrowEvalPython")[1].split("\n")[0].count("<lambda>(") == 1
