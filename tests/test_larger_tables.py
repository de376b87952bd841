"""Steps whose cost must not grow faster than the table: results against loops, and what their plans may not hold."""

import hashlib
import random
from itertools import combinations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from seqsieve.functions import structure
from seqsieve.operators import generate, geometry, metrics, ranking, screen, space, splits, wrappers


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _patterns(n, seed=3):
    rng = random.Random(seed)
    base = "ACGUACGUACGUA"
    return ["".join(rng.choice("ACGU") if rng.random() < 0.15 else c for c in base) for _ in range(n)]


def _differ(a, b):
    return sum(x != y for x, y in zip(a, b, strict=True))


def test_similar_pairs_stand_once_and_are_never_broadcast(spark):
    """the masked keys are 78 times the patterns, which Spark took for a few bytes and broadcast."""
    some = sorted(set(_patterns(150)))
    df = spark.createDataFrame([(p,) for p in some * 2], "pattern string")
    for once in (True, False):
        found = geometry.similar_patterns(df, df, 2, once=once)
        want = [(a, b, _differ(a, b)) for a in some for b in some if _differ(a, b) <= 2 and (a < b or not once)]
        assert sorted(map(tuple, found.collect())) == sorted(want)
        assert "Broadcast" not in _plan(found)


def test_defects_broadcast_no_exploded_rows(spark):
    """F2."""
    df = spark.createDataFrame([(i, "((..))") for i in range(5)], "id long, s string")
    p = df.select("id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("i")).withColumn("j", 5 - F.col("i")).withColumn("p", F.lit(0.5))
    out = structure.ensemble_defect(structure.partners(df, "id", "s"), p, "id")
    assert "Broadcast" not in _plan(out)
    assert {tuple(r) for r in out.collect()} == {(i, 6, 4.0) for i in range(5)}


def test_local_mutants_shuffle_nothing(spark):
    """draws end when a parent has its mutants, without a sort of all draws."""
    df = spark.createDataFrame(list(enumerate(_patterns(20))), "cand_id long, pattern string")
    out = generate.local_mutants(df, 1, 39, 3)  # all there are, as far as 118 draws find them
    assert "Exchange" not in _plan(out)
    parents = {r["cand_id"]: r["pattern"] for r in df.collect()}
    rows = [(r["cand_id"], r["pattern"]) for r in out.collect()]
    assert len(rows) == len(set(rows)) > 20 * 30 and all(_differ(p, parents[k]) == 1 for k, p in rows)


def test_masking_hashes_each_token_once(spark):
    """one hash a plain token and two more for targets, as a loop takes them."""
    tokens = [1, *[5 + i % 64 for i in range(60)], 2]
    df = spark.createDataFrame([(k, tokens) for k in range(20)], "k long, t array<int>")
    out = generate.masked_tokens(df, "t", "k", 5, 69, 3, 5)
    share = lambda k, i, what: int(hashlib.md5(f"5|{k}|{i}|{what}".encode()).hexdigest()[:6], 16)
    for r in out.collect():
        want = []
        for i, t in enumerate(tokens):
            if t < 5 or share(r["k"], i, "t") / 16**6 >= 0.15:
                want.append((t, -100))
            else:
                kept = share(r["k"], i, "k") / 16**6
                want.append((3 if kept < 0.8 else 5 + share(r["k"], i, "r") % 64 if kept < 0.9 else t, t))
        assert list(zip(r["input"], r["label"], strict=True)) == want
    assert _plan(out).split("+-")[-2].count("md5(") + _plan(out).count("md5(") <= 10


def test_weights_end_where_asked(spark):
    """the SQL of k15 ends at 6."""
    df = spark.range(400_000).select(F.col("id").alias("k"), F.lit(1).alias("seed"))
    most = lambda **given: splits.bagged(df, "k", 3, **given).agg(F.max("weight")).first()[0]
    assert most() > 6 and most(most=6) == 6


def test_neighbours_of_copies_equal_a_loop(spark):
    """found by pattern, so neither copies nor rows are multiplied by neighbours."""
    pats = _patterns(80)
    rows = [(i, pats[i % 80] if i % 3 else pats[0], float(i % 17)) for i in range(160)]
    df = spark.createDataFrame(rows, "cand_id long, pattern string, y double")
    got = {}
    for r in geometry.neighbours(df, 5, 2).collect():
        got.setdefault(r["cand_id"], []).append((r["rn"], r["distance"], r["other"], r["value"]))
    for i, p, _ in rows:
        near = sorted((_differ(p, q), j, v) for j, q, v in rows if j != i and _differ(p, q) <= 2)[:5]
        assert sorted(got.get(i, [])) == [(n, *x) for n, x in enumerate(near, 1)]


def test_two_hops_are_cut_where_they_are_made(spark):
    """no window over 702 rows a parent."""
    df = spark.createDataFrame([(p,) for p in sorted(set(_patterns(5)))], "pattern string")
    out = generate.two_hop(df, 40, 4)
    assert "Window" not in _plan(out) and "Sort" not in _plan(out)
    for parent in [r["pattern"] for r in df.collect()]:
        made = {parent[:i] + b + parent[i + 1 : j] + c + parent[j + 1 :] for i, j in combinations(range(13), 2) for b in "ACGU" for c in "ACGU" if parent[i] != b and parent[j] != c}
        want = sorted(made, key=lambda x: (hashlib.md5(f"4:{x}".encode()).hexdigest(), x))[:40]
        assert sorted(r["pattern"] for r in out.where(F.col("parent") == parent).collect()) == sorted(want)


def test_the_last_patterns_of_a_stratum_are_found(spark):
    """draws seldom hit what little is left; the stratum itself has it."""
    every = generate.whole_stratum(spark, 2)
    assert every.distinct().count() == every.count() == 702
    known = every.orderBy("pattern").limit(700)
    assert generate.stratum_rooms(known, [2]) == {2: 2}
    made = generate.stratified_candidates(spark, {2: 2}, known, 11, rounds=1)
    assert {r["pattern"] for r in made.collect()} == {r["pattern"] for r in every.orderBy(F.desc("pattern")).limit(2).collect()}
    with pytest.raises(ValueError, match="not met"):
        generate.stratified_candidates(spark, {2: 3}, known, 11)


def test_no_window_holds_a_seed(spark, data):
    """only the 20 best of a group are ranked by a window, each task cutting its own first."""
    from seqsieve.plans.catalogue import QUERIES

    plan = _plan(QUERIES["a15_prefilter"](spark, data))
    assert "WindowGroupLimit" in plan and not any("AS rb#" in line for line in plan.split("\n") if "Window [" in line)


def test_rank_correlation_joins_no_rows_to_few_predictions(spark, monkeypatch):
    """a prediction of few values made one task of all rows that have it; F28: so did ranks of such values."""
    rng = random.Random(8)
    rows = [(g, rng.choice([None, *range(40)]), rng.choice([1.0, 1.0, 2.0, None])) for g in ("a", None) for _ in range(300)]
    df = spark.createDataFrame(rows, "g string, x int, y double")
    joined = []
    real = ranking.join_null_safe
    for module in (ranking, metrics):
        monkeypatch.setattr(module, "join_null_safe", lambda left, right, keys, how="inner": (joined.append((tuple(keys), right._jdf.queryExecution().logical().toString())), real(left, right, keys, how))[1])
    got = {r["g"]: r["spearman"] for r in metrics.spearman(df, ["g"], "x", "y").collect()}
    assert joined and all("_y" not in keys for keys, _ in joined)
    assert any("ResolvedHint (strategy=broadcast)" in plan or "broadcast" in plan.lower() for keys, plan in joined if "_x" in keys)
    for g in ("a", None):
        some = pd.DataFrame([(-1 if x is None else x, -1 if y is None else y) for k, x, y in rows if k == g])
        assert got[g] == pytest.approx(some[0].rank().corr(some[1].rank()), abs=1e-12)
    ranked = sorted((r["g"] or "", r["x"] or -1, r["rank"]) for r in ranking.average_ranks(df, "x", ["g"]).collect())
    assert len(ranked) == 600 and ranked[0][2] > 1


def test_permuted_copies_hold_every_value(spark):
    """A copy takes one shuffle in all, not two sorts and a join of the table each."""
    df = spark.createDataFrame([(i, i, float(i % 7), i * 2.0) for i in range(500)], "id long, a long, b double, y double")
    for block in (64, 1 << 15):
        rows = [r.asDict() for r in screen.permuted(df, ["a", "b"], ["y"], "id", 2, block).collect()]
        assert len(rows) == 500 and all(r["y"] == 2 * r["a"] and r["b"] == r["a"] % 7 for r in rows)
        for i, f in enumerate("ab"):
            for r in range(2):
                assert sorted(x[f"p{r}_{i}"] for x in rows) == sorted(x[f] for x in rows)
                assert sum(x[f"p{r}_{i}"] != x[f] for x in rows) > 350
        again = {r["a"]: r for r in screen.permuted(df.repartition(7), ["a", "b"], ["y"], "id", 2, block).collect()}
        assert all(again[r["a"]].asDict() == r for r in rows)
    found = {r["feature"]: r["score"] for r in screen.permutation_importance(df, ["a", "b"], "y", "linear", 2, "id").collect()}
    assert found["a"] > 1000 and abs(found["b"]) < 1


def test_trees_are_fitted_in_small_tasks(spark, monkeypatch):
    """a task held as many rows as came from one file."""
    monkeypatch.setattr(screen, "FIT_ROWS", 100)
    df = spark.createDataFrame([(i, float(i)) for i in range(1000)], "id long, y double").coalesce(1)
    made = screen._for_trees(df, ["id", "y"])
    sizes = [len(p) for p in made.rdd.glom().collect()]
    assert len(sizes) == 10 and max(sizes) < 200 and sum(sizes) == 1000


def test_held_out_scores_come_from_sums(spark):
    """every subset was a fit and a pass of its own."""
    rng = random.Random(2)
    rows = [(i, rng.random(), rng.random(), i % 3) for i in range(300)]
    df = spark.createDataFrame([(i, a, b, 3 * a - b + rng.random(), k) for i, a, b, k in rows], "id long, a double, b double, y double, fold int")
    moments = wrappers.fold_moments(df, ["a", "b"], "y")
    for names in (["a"], ["b"], ["b", "a"]):
        assert wrappers.held_out_r2(moments, names) == pytest.approx(screen.held_out_score(df, names, "y", "linear"), abs=1e-8)
    assert wrappers.held_out_r2(moments, ["a"], held=9) == float("-inf")


def test_neighbours_are_sought_for_different_points(spark, monkeypatch):
    """F8: all rows were standardised, written and sorted, however often their point comes."""
    seen = []
    real = space.counts_below
    monkeypatch.setattr(space, "counts_below", lambda values, asked, groups: (seen.append(values.count()), real(values, asked, groups))[1])
    rows = [("f", float(i % 5), float(i % 3)) for i in range(600)]
    got = space.neighbour_information(spark.createDataFrame(rows, "feature string, x double, y double")).collect()
    assert seen == [30] and got[0]["score"] is not None
