"""Wrappers by inner cross-validation against loops that refit every subset."""

import numpy as np
import pandas as pd
import pytest

from seqsieve.operators import wrappers

NAMES = ["a", "b", "c", "d", "e"]


@pytest.fixture(scope="module")
def table():
    r = np.random.default_rng(5)
    x = pd.DataFrame(r.normal(size=(240, 4)), columns=list("abcd"))
    x["c"] = (x["c"] * 2).round()
    x["e"] = 3.0  # no variance
    x["y"] = 100 + 2 * x["b"] - x["c"] + 0.5 * x["a"] ** 3 + r.normal(size=240)
    return x.assign(fold=np.arange(240) % 3)


@pytest.fixture(scope="module")
def moments(spark, table):
    odd = pd.DataFrame([[None, 1, 1, 1, 1, 1, 0], [1, 1, 1, 1, 1, float("nan"), 0], [1, 1, 1, 1, 1, 1, None]], columns=table.columns)
    return wrappers.fold_moments(spark.createDataFrame(pd.concat([table, odd])), NAMES, "y")


def refit(t, names):
    """Mean held-out rank correlation of least squares fitted anew for every fold."""
    out = []
    for k in range(3):
        train, test = t[t.fold != k], t[t.fold == k]
        design = lambda d: np.column_stack([np.ones(len(d)), d[names].to_numpy()])
        w = np.linalg.lstsq(design(train), train["y"].to_numpy(), rcond=None)[0]
        pred = pd.Series(design(test) @ w).round(9)
        out.append(0.0 if pred.nunique() < 2 else pred.rank().corr(test["y"].reset_index(drop=True).rank()))
    return sum(out) / 3


def test_scores_equal_refits(moments, table):
    subsets = [["a"], ["e"], ["c"], ["a", "b"], ["b", "c", "e"], NAMES]
    assert wrappers.cv_spearman(moments, subsets) == pytest.approx([refit(table, s) for s in subsets], abs=1e-9)


def test_forward_equals_loop(moments, table):
    want, best = [], float("-inf")
    while len(want) < 4:
        rest = [f for f in NAMES if f not in want]
        scores = [refit(table, [*want, f]) for f in rest]
        i = int(np.argmax(scores))
        if scores[i] - best < 0.002:
            break
        want.append(rest[i])
        best = scores[i]
    got = wrappers.forward(moments, 4)
    assert [f for f, _ in got] == want and got[-1][1] == pytest.approx(best, abs=1e-9)
    assert len(wrappers.forward(moments, 1)) == 1
    assert [f for f, _ in wrappers.forward(moments, 9, least_gain=0.5)] == want[:1]


def test_backward_equals_loop(moments, table):
    left, want = list(NAMES), []
    while len(left) > 2:
        scores = [round(refit(table, [x for x in left if x != f]), 9) for f in left]
        want.append(left.pop(int(np.argmax(scores))))
    assert [f for f, _ in wrappers.backward(moments, 2)] == want


def test_elimination_equals_loop(moments, table):
    left, want = list(NAMES), []
    z = (table[NAMES] - table[NAMES].mean()) / table[NAMES].std(ddof=0).replace(0, np.inf)
    while len(left) > 1:
        w = np.linalg.lstsq(np.column_stack([np.ones(len(z)), z[left]]), table["y"].to_numpy(), rcond=None)[0][1:]
        want.append(left.pop(int(np.argmin(np.abs(w)))))
    assert [f for f, _ in wrappers.elimination(moments, 1)] == want


def test_empty_table(spark):
    none = wrappers.fold_moments(spark.createDataFrame([], "a double, b double, y double, fold int"), ["b", "a"], "y")
    assert wrappers.forward(none, 2, 0.0) == [("a", 0.0)] and [f for f, _ in wrappers.elimination(none, 1)] == ["b"]
