"""Model queries fit on the whole features table."""

import pytest

from pyspark.sql import functions as F

from seqsieve.operators import screen
from seqsieve.plans import model_queries as Q
from seqsieve.plans.catalogue import QUERIES


@pytest.mark.parametrize("name", ["m6_permutation", "m9_forward", "m16_out_of_fold"])
def test_fits_see_all_rows_and_features(spark, monkeypatch, name):
    from seqsieve.sources.views import view

    small = "/root/testdata/sf0.001"
    total, seen, fit = view(spark, small, "features").count(), [], screen.fit
    monkeypatch.setattr(screen, "fit", lambda df, features, *a, **b: seen.append((df.count(), tuple(features))) or fit(df, features, *a, **b))
    QUERIES[name](spark, small).collect()
    assert {c for _, cols in seen for c in cols} == set(Q.FEATURES)
    if name == "m16_out_of_fold":
        assert sum(n for n, _ in seen) == 2 * total  # three folds, each row in two fits
    elif name == "m9_forward":
        assert len({n for n, _ in seen}) == 1 and abs(seen[0][0] - 2 * total / 3) < 2  # the other folds; the held one scores
    else:
        assert {n for n, _ in seen} == {total}


def planted(spark):
    """y depends on a and b; c, d and e are noise."""
    h = lambda tag: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(tag), F.col("id").cast("string")).cast("binary")), 1, 6), 16, 10).cast("double") / 2**24
    return spark.range(600).select("id", *[h(c).alias(c) for c in "abcde"]).withColumn("y", 5 * F.col("a") - 3 * F.col("b") + 0.1 * F.col("c"))


def test_shadows_leave_the_planted_features(spark):
    assert sorted(screen.shadow_selection(planted(spark), list("abcde"), "y", "id")) == ["a", "b"]


def test_wrappers_find_the_planted_features(spark):
    d = planted(spark).withColumn("fold", (F.col("id") % 3).cast("int"))
    score = lambda names: screen.held_out_score(d, names, "y", "linear")
    assert screen.forward_selection(list("edcba"), 3, score) == ["a", "b", "c"]
    assert screen.backward_selection(list("edcba"), 2, score) == ["a", "b"]
    assert screen.recursive_elimination(d, list("edcba"), "y", 3) == ["a", "b", "c"] and screen.recursive_elimination(d, list("edcba"), "y", 2, "rf") == ["a", "b"]
    assert screen.held_out_score(d.where("fold <> 0"), ["a"], "y", "linear") == float("-inf")
