"""Greedy group folds against a loop; tails of the F distribution against exact sums."""

import random
from decimal import Decimal, getcontext
from math import log10

import pytest
from pyspark.sql import functions as F

from seqsieve.operators import screen, splits


def greedy(sizes, folds):
    loads, out = [0] * folds, {}
    for name, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        f = loads.index(min(loads))
        out[name] = (size, f)
        loads[f] += size
    return out


@pytest.mark.parametrize(("folds", "make"), [(3, lambda r: r.randint(1, 4)), (5, lambda r: int(r.paretovariate(1)) % 500 + 1), (4, lambda r: r.choice([1, 1, 1, 60]))])
def test_group_folds_equal_the_loop(spark, folds, make):
    r = random.Random(folds)
    sizes = {f"g{i:03d}": make(r) for i in range(120)}
    rows = spark.createDataFrame([(g,) for g, n in sizes.items() for _ in range(n)], "g string").repartition(3)
    got = {x["g"]: (x["size"], x["fold"]) for x in splits.group_folds(rows, "g", folds).collect()}
    assert got == greedy(sizes, folds)


def test_group_folds_of_few_rows(spark):
    rows = spark.createDataFrame([(None,), (None,), ("a",)], "g string")
    assert {(x["g"], x["size"], x["fold"]) for x in splits.group_folds(rows, "g", 4).collect()} == {(None, 2, 0), ("a", 1, 1)}
    assert splits.group_folds(rows.limit(0), "g", 4).collect() == []
    plan = splits.greedy_plan([(7, 10**12), (1, 10**12 + 1)], 3)  # the loop runs over sizes, not groups
    assert sum(k for s, _, k, _ in plan if s == 7) == 10**12 and sum(k for s, _, k, _ in plan if s == 1) == 10**12 + 1


def exact_log10_p(r2, freedom):
    """Two-sided tail for an even number of degrees: 1 - sqrt(r2) times a finite sum in 1 - r2."""
    getcontext().prec = 1500
    share, term, total = 1 - Decimal(r2), Decimal(1), Decimal(1)
    for k in range(1, freedom // 2):
        term = term * share * (2 * k - 1) / (2 * k)
        total += term
    return float((1 - Decimal(r2).sqrt() * total).log10())


def test_tails_equal_exact_sums(spark):
    cases = [(r2, f) for f in (2, 4, 10, 60, 400) for r2 in (1e-9, 1e-4, 0.01, 0.2, 0.5, 0.9, 0.999)]
    got = spark.createDataFrame([(r2, float(f)) for r2, f in cases], "r2 double, f double").select("r2", "f", (screen.f_tail_log(F.col("r2"), F.col("f"))).alias("p")).collect()
    for x in got:
        want = exact_log10_p(x["r2"], int(x["f"]))
        assert x["p"] / 2.302585092994046 == pytest.approx(want, rel=1e-11, abs=1e-13), x
    assert min(x["p"] for x in got) / 2.302585092994046 < -500  # far below the least double
    odd = spark.createDataFrame([(1.0, 5.0), (0.0, 5.0), (0.5, 0.0), (None, 5.0)], "r2 double, f double").select(screen.f_tail_log(F.col("r2"), F.col("f")).alias("p")).collect()
    assert [x["p"] for x in odd] == [float("-inf"), 0.0, None, None]


def test_scores_rank_below_the_least_double(spark):
    r = random.Random(1)
    rows = [(float(i), i + r.gauss(0, 20), i + r.gauss(0, 10), r.random(), 1.0) for i in range(4000)]
    got = {x["feature"]: x for x in screen.f_log_p(spark.createDataFrame(rows, "y double, a double, b double, c double, d double"), ["a", "b", "c", "d"], "y").collect()}
    assert got["b"]["score"] > got["a"]["score"] > 300 and got["c"]["score"] < 5 and got["d"]["score"] is None
    assert log10(got["b"]["f"]) > 0
