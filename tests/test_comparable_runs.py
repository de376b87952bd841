"""Gaps of columns and unequal starts on small tables."""

from pyspark.sql import functions as F

from seqsieve.operators import metrics, screen


def test_column_gaps(spark):
    t = spark.createDataFrame([("a", 1.0, None, "x"), ("a", float("nan"), None, "x"), ("b", None, None, "x"), (None, 2.0, None, "x")], "k string, v double, w int, z string")
    got = {(r["k"], r["column_name"]): (r["n"], r["n_missing"], r["all_missing"]) for r in metrics.column_gaps(t, ["k"], ["v", "w", "z"]).collect()}
    assert got == {("a", "v"): (2, 1, False), ("b", "v"): (1, 1, False), ("a", "w"): (2, 2, True), ("b", "w"): (1, 1, True), (None, "w"): (1, 1, True)}
    assert metrics.column_gaps(t.limit(0), ["k"], ["v"]).count() == 0


def test_unequal_starts(spark):
    rows = [
        ("same", "s1", 1, "p", "m"), ("same", "s1", 2, "q", "m"), ("same", "s1", 3, "own", "m"), ("same", "s2", 1, "p", "m"), ("same", "s2", 2, "q", "m"),
        ("order", "s1", 1, "p", "m"), ("order", "s1", 2, "q", "m"), ("order", "s2", 1, "q", "m"), ("order", "s2", 2, "p", "m"),
        ("model", "s1", 1, "p", "m"), ("model", "s2", 1, "p", None), (None, "s1", 1, "p", "m"), (None, "s2", 2, "p", "m"),
    ]
    t = spark.createDataFrame(rows, "g string, s string, c int, k string, m string")
    got = {r["g"]: (r["n_searches"], r["n_unshared"], r["n_models"]) for r in metrics.unequal_starts(t, ["g"], "s", "c", "k", "m", F.col("c") <= 2).collect()}
    assert got == {"order": (2, 4, 1), "model": (2, 0, 2), None: (2, 2, 1)}
    assert metrics.unequal_starts(t.limit(0), ["g"], "s", "c", "k", "m", F.col("c") <= 2).count() == 0


def test_overlap(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "k string")
    b = spark.createDataFrame([("x",), ("x",), (None,), ("z",)], "k string")
    assert tuple(screen.overlap(a, b, "k").first()) == (4, 2, 1) and tuple(screen.overlap(a.limit(0), b, "k").first()) == (0, 0, 0)
