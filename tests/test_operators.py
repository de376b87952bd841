"""Edge cases and invariants of the library's operators on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from seqsieve.functions import sequence as S
from seqsieve.functions.constants import SITES, WILD_TYPE
from seqsieve.operators import contracts, generate, geometry, ledger, metrics, ranking, selection, space, splits
from seqsieve.operators.components import connected_components


def patterns(spark, n=60, seed=1):
    r = random.Random(seed)
    rows = [(i, "".join(r.choice("ACGU") if r.random() < 0.3 else b for b in S.WILD_PATTERN), float(r.randint(0, 20))) for i in range(n)]
    return spark.createDataFrame(rows, "cand_id long, pattern string, y double")


def distance(a, b):
    return sum(x != y for x, y in zip(a, b, strict=True))


def test_wild_type_features_are_zero(spark):
    assert len(WILD_TYPE) == 141 and len(SITES) == 13
    df = spark.createDataFrame([(WILD_TYPE,)], "sequence string")
    s = F.col("sequence")
    one = df.select(*[c.alias(n) for n, c in {**S.summary(s), **S.kmer_deltas(s)}.items()]).first().asDict()
    assert all(abs(v) < 1e-12 for k, v in one.items() if k != "gc_share")
    assert len(S.one_hot(s)) == 52 and len(S.dimers_around(s)) == 208 and len(S.structure(s)) == 43
    assert df.select(S.contract_reason(s)).first()[0] is None


def test_components_against_union_find(spark):
    r = random.Random(4)
    edges = [(r.randint(0, 80), r.randint(0, 80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 130)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {x["id"]: x["component"] for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_clusters_against_all_pairs(spark):
    df = patterns(spark)
    rows = df.collect()
    want = {x["cand_id"]: x["cand_id"] for x in rows}
    names = {x["cand_id"]: x["pattern"] for x in rows}
    changed = True
    while changed:
        changed = False
        for a in names:
            for b in names:
                if distance(names[a], names[b]) <= 2 and want[a] != want[b]:
                    want[a] = want[b] = min(want[a], want[b])
                    changed = True
    groups = {}
    for x in geometry.clusters(df, 2).collect():
        groups.setdefault(x["cluster"], set()).add(x["cand_id"])
    expected = {}
    for a, c in want.items():
        expected.setdefault(c, set()).add(a)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


@pytest.mark.parametrize("n", [1, 8, 200])
def test_order_does_not_depend_on_partitions(spark, n):
    df = patterns(spark).repartition(n)
    got = [x["cand_id"] for x in selection.random_batch(df, 10, 3).orderBy("pick").collect()]
    assert got == [x["cand_id"] for x in selection.random_batch(patterns(spark), 10, 3).orderBy("pick").collect()]
    assert [x["rn"] for x in ranking.numbered(df, ["y", "cand_id"]).orderBy("y", "cand_id").collect()] == list(range(1, 61))


def test_nearest_and_leave_one_out(spark):
    df, ref = patterns(spark), patterns(spark, 20, 9)
    known = [x["pattern"] for x in ref.collect()]
    for x in geometry.nearest_distance(df, ref).collect():
        assert x["distance"] == min(distance(x["pattern"], k) for k in known)
    rows = df.collect()
    for x in geometry.leave_one_out(df).collect():
        me = next(r for r in rows if r["cand_id"] == x["cand_id"])
        assert x["distance"] == min(distance(me["pattern"], r["pattern"]) for r in rows if r["cand_id"] != x["cand_id"])
    assert geometry.leave_one_out(df.limit(1)).first()["distance"] is None
    assert geometry.nearest_distance(df, ref.limit(0)).first()["distance"] is None


def test_two_nearest_against_loop(spark):
    df, ref = patterns(spark, 40, 5), patterns(spark, 30, 9)
    known = {x["pattern"] for x in ref.collect()}
    for x in geometry.two_nearest(df, ref).collect():
        assert [x["nearest"], x["second"]] == sorted(distance(x["pattern"], k) for k in known)[:2]
    far = spark.createDataFrame([("ACGUACGUACGUA",), ("UGCAUGCAUGCAU",)], "pattern string")
    assert [tuple(x) for x in geometry.two_nearest(far, far.limit(1)).orderBy("pattern").collect()] == [("ACGUACGUACGUA", 0, None), ("UGCAUGCAUGCAU", 13, None)]


def test_numbers_in_groups(spark):
    df = spark.range(200).selectExpr("id", "nullif(id % 3, 2) AS g", "id % 7 AS v").repartition(9)
    got = {}
    for x in ranking.numbered(df, ["v", "id"], "rn", ["g"]).collect():
        got.setdefault(x["g"], []).append((x["rn"], x["v"], x["id"]))
    for rows in got.values():
        assert [r[0] for r in sorted(rows)] == list(range(1, len(rows) + 1)) and [r[1:] for r in sorted(rows)] == sorted(r[1:] for r in rows)
    assert len(got) == 3


def test_nearest_in_space_against_loop(spark):
    import random

    r = random.Random(4)
    left = [(i, r.choice([0.0, r.gauss(0, 1), 50.0]), r.random()) for i in range(80)]
    right = [(i, r.gauss(0, 1), r.random()) for i in range(60)] + [(99, 0.0, 0.0)] * 5
    table = lambda rows: spark.createDataFrame(rows, "id long, a double, b double")
    got = {x["id"]: x["distance"] for x in space.nearest_in_space(table(left), table(right), ["a", "b"], "id").collect()}
    both = left + right
    mean = [sum(x[i] for x in both) / len(both) for i in (1, 2)]
    dev = [(sum((x[i] - mean[i - 1]) ** 2 for x in both) / len(both)) ** 0.5 for i in (1, 2)]
    for i, a, b in left:
        assert abs(got[i] - min((((a - x) / dev[0]) ** 2 + ((b - y) / dev[1]) ** 2) ** 0.5 for _, x, y in right)) < 1e-9
    assert space.nearest_in_space(table(left), table(right).limit(0), ["a", "b"], "id").where("distance IS NOT NULL").count() == 0


def test_space_batch_equals_a_loop(spark):
    r = random.Random(9)
    rows = [(i, r.gauss(0, 1), r.choice([0.0, r.random(), 1e6]), r.random(), r.choice([1.0, 2.0, r.random()])) for i in range(120)]
    pool = spark.createDataFrame(rows, "cand_id long, a double, b double, mu double, sigma double")
    known = pool.where("cand_id % 4 = 0")
    rest = pool.where("cand_id % 4 <> 0")
    novelty = {x["cand_id"]: round(x["distance"], 9) for x in space.nearest_in_space(rest, known, ["a", "b"], "cand_id").collect()}
    left = [x for x in rows if x[0] % 4]
    want = []
    assert selection.rounded_quotas(selection.SPACE_PARTS, 33, "random") == {"uncertainty": 15, "coverage": 8, "promising": 7, "random": 3}
    for role, n, order in (("uncertainty", 15, lambda x: (-x[4], x[0])), ("coverage", 8, lambda x: (-novelty[x[0]], x[0])), ("promising", 7, lambda x: (x[3], x[0]))):
        got = sorted(left, key=order)[:n]
        want += [(x[0], role, i) for i, x in enumerate(got, 1)]
        left = [x for x in left if x not in got]
    batch = {(x["cand_id"], x["role"], x["pick"]) for x in selection.space_batch(rest, known, 33, ["a", "b"], "mu", "sigma", 1).collect()}
    assert len(batch) == 33 and set(want) <= batch and sum(x[1] == "random" for x in batch) == 3
    short = selection.space_batch(rest.limit(20), known, 33, ["a", "b"], "mu", "sigma", 1, parts={"uncertainty": 4, "random": 1}).collect()
    assert len({x["cand_id"] for x in short}) == 20
    filled = selection.space_batch(rest, known, 10, ["a", "b"], "mu", "sigma", 1, parts={"coverage": 4, "promising": 6, "random": 0}, maximise=True).collect()
    assert [x["cand_id"] for x in sorted(filled, key=lambda x: x["pick"]) if x["role"] == "coverage"] == [x for x in sorted(novelty, key=lambda i: (-novelty[i], i))][:4]


def test_written_tables_go_with_their_scope(spark):
    from seqsieve.plans.materialise import materialise, scope

    with scope(spark):
        at = materialise(spark.range(3)).inputFiles()[0]
        assert spark.read.parquet(at).count() > 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(at)


def test_mixed_batch_quotas_and_fill(spark):
    df = patterns(spark).withColumn("sigma", F.col("cand_id") % 7)
    got = selection.mixed_batch(df, patterns(spark, 5, 2), 20, {"uncertainty": 0.45, "coverage": 0.25, "promising": 0.2, "random": 0.1, "none": 0.0}, "y", "sigma", 1).collect()
    roles = {}
    for x in got:
        roles[x["role"]] = roles.get(x["role"], 0) + 1
    assert len({x["cand_id"] for x in got}) == 20 and roles == {"uncertainty": 9, "coverage": 5, "promising": 4, "random": 2}
    few = selection.mixed_batch(df.limit(3), patterns(spark, 5, 2), 20, {"promising": 1.0}, "y", "sigma", 1)
    assert few.count() == 3
    with pytest.raises(ValueError):
        selection.scaled_quotas({"a": -1.0}, 3)


def test_survivors_against_loop(spark):
    df = patterns(spark).dropDuplicates(["pattern"]).select((F.col("cand_id") % 2).alias("s"), "pattern", F.col("y").alias("pred"))
    got = {}
    for x in generate.survive(df, "s", 5, 4).collect():
        got.setdefault(x["s"], set()).add(x["pattern"])
    for s in (0, 1):
        head = sorted((x["pred"], x["pattern"]) for x in df.collect() if x["s"] == s)[:20]
        kept = []
        for _, p in head:
            if len(kept) < 5 and all(distance(p, k) >= 4 for k in kept):
                kept.append(p)
        kept += [p for _, p in head if p not in kept][: 5 - len(kept)]
        assert got[s] == set(kept)


def test_initial_seeds_keep_distance(spark):
    got = [x for x in generate.spread_best(patterns(spark), "y", 4, 3, 60).orderBy("pick").collect()]
    assert [x["y"] for x in got] == sorted(x["y"] for x in got)
    assert all(distance(a["pattern"], b["pattern"]) >= 3 for i, a in enumerate(got) for b in got[:i])


def test_masking_shares(spark):
    df = patterns(spark, 300).select("cand_id", S.tokens(generate.sequence_of(F.col("pattern"))).alias("t"))
    out = generate.masked_tokens(df, "t", "cand_id", 5, len(S.VOCABULARY), 3, 5)
    pairs = [(a, b) for x in out.collect() for a, b in zip(x["input"], x["label"], strict=True)]
    share = sum(b != -100 for _, b in pairs) / len(pairs)
    masked = sum(a == 3 for a, b in pairs if b != -100) / sum(b != -100 for _, b in pairs)
    assert 0.13 < share < 0.16 and 0.77 < masked < 0.83
    assert all(b != 1 and b != 2 for _, b in pairs)


def test_training_alone_sets_bounds(spark):
    df = splits.train_test(splits.with_seeds(patterns(spark), [1]), "cand_id", 0.3)
    a = splits.winsorise(df, "y").where("role = 'train'").select("cand_id", "clipped")
    shifted = df.withColumn("y", F.when(F.col("role") == "test", F.col("y") * 1000).otherwise(F.col("y")))
    assert a.exceptAll(splits.winsorise(shifted, "y").where("role = 'train'").select("cand_id", "clipped")).count() == 0


def test_bootstrap_holds_the_mean(spark):
    df = patterns(spark).withColumn("g", F.lit("a")).unionByName(patterns(spark).limit(1).withColumn("g", F.lit("one")))
    got = {x["g"]: x for x in metrics.bootstrap_ci(df, ["g"], "y", 500).collect()}
    assert got["a"]["ci_low"] < got["a"]["mean"] < got["a"]["ci_high"] and got["one"]["ci_low"] == got["one"]["ci_high"] == got["one"]["mean"]
    again = {x["g"]: x for x in metrics.bootstrap_ci(df.repartition(7), ["g"], "y", 500).collect()}
    assert again["a"] == got["a"]


def test_bootstrap_equals_a_loop(spark):
    """Both ways against plain loops over the same draws, and with the interval that the normal law gives."""
    import numpy as np

    r = np.random.default_rng(2)
    values = np.sort(r.exponential(size=700))
    df = spark.createDataFrame([("g", float(v)) for v in values] + [("h", 1.0), ("h", float("nan")), ("none", None)], "g string, v double")
    n, b, seed = len(values), 300, 11
    draws = metrics._draws(seed, np.arange(n), np.arange(b))
    whole = np.percentile([np.mean([values[int(d) % n] for d in row]) for row in draws], [2.5, 97.5])
    got = {x["g"]: x for x in metrics.bootstrap_ci(df, ["g"], "v", b, seed).collect()}
    assert [got["g"]["ci_low"], got["g"]["ci_high"]] == pytest.approx(list(whole)) and set(got) == {"g", "h"}
    draws = metrics._draws(seed, np.arange(1, n + 1), np.arange(b))
    weights = [[sum(u >= c for c in metrics.POISSON) for u in (row >> np.uint64(11)) * 2.0**-53] for row in draws]
    parts = np.percentile([np.dot(w, values) / sum(w) for w in weights], [2.5, 97.5])
    large = {x["g"]: x for x in metrics.bootstrap_ci(df.repartition(6), ["g"], "v", b, seed, packed=10).collect()}
    assert [large["g"]["ci_low"], large["g"]["ci_high"]] == pytest.approx(list(parts)) and large["h"]["n"] == 1
    error = values.std() / n**0.5
    fine = metrics.bootstrap_ci(df.where("g = 'g'").select("v"), [], "v", 5000, packed=10).first()
    assert [fine["ci_low"], fine["ci_high"]] == pytest.approx([values.mean() - 1.96 * error, values.mean() + 1.96 * error], abs=0.15 * error)


def test_weighted_sums_are_those_of_the_draws_in_less_time():
    from time import process_time

    import numpy as np

    r, b = np.random.default_rng(3), 2000
    values, places = r.random(2500), np.arange(7, 2507)

    def plain():
        u = (metrics._draws(5, places, np.arange(b)) >> np.uint64(11)) * 2.0**-53
        w = np.searchsorted(metrics.POISSON, u, side="right").astype(np.float64)
        return w @ values, w.sum(axis=1)

    def seconds(f):
        start = process_time()
        f()
        return process_time() - start

    sums, weights = metrics._weighted_sums(values, places, b, 5)
    want = plain()
    assert weights.tolist() == want[1].tolist() and sums == pytest.approx(want[0], rel=1e-12)
    assert min(seconds(lambda: metrics._weighted_sums(values, places, b, 5)) for _ in range(3)) < 0.6 * min(seconds(plain) for _ in range(3))


def test_intervals_of_deltas_and_gates(spark):
    r = random.Random(4)
    rows = [(s, m, "x", {"base": 0.0, "good": -1.0, "bad": 1.0, "same": 0.0}[m] + r.gauss(0, 0.5)) for s in range(80) for m in ("base", "good", "bad", "same")]
    deltas = metrics.paired_deltas(spark.createDataFrame(rows, "seed int, method string, model string, value double"), ["seed", "model"], "method", "base")
    got = {x["method"]: x for x in metrics.gates(metrics.paired_summary(deltas, ["method"], resamples=2000), 0.3, 0.5).collect()}
    plain = {x["method"]: x for x in metrics.paired_summary(deltas, ["method"]).collect()}
    for m, x in got.items():
        assert x["ci_low"] < x["mean_delta"] < x["ci_high"] and x["mean_delta"] == plain[m]["mean_delta"]
    assert [got[m][c] for m in ("good", "bad", "same") for c in ("better", "worse", "holds", "quiet")] == [True, False, True, False, False, True, False, False, False, False, True, True]


def test_degenerate_groups(spark):
    df = spark.createDataFrame([("a", 1, 1.0, 2.0), ("a", 2, 1.0, 3.0), ("b", 1, 5.0, 5.0)], "g string, id long, truth double, pred double")
    got = {x["g"]: x["spearman"] for x in metrics.spearman(df, ["g"]).collect()}
    assert got == {"a": None, "b": None}
    assert {x["g"]: x["spearman"] for x in metrics.spearman(df, ["g"], degenerate=0.0).collect()} == {"a": 0.0, "b": 0.0}
    assert {x["g"]: x["kendall"] for x in metrics.kendall(df, ["g"]).collect()} == {"a": None, "b": None}


def test_contract_of_odd_values(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,)], "v double")
    assert contracts.finite_contract(df, ["v"]).first()["n_bad"] == 3
    keys = contracts.key_contract(spark.createDataFrame([("a",), ("a",), (None,)], "k string"), ["k"]).first()
    assert (keys["n_rows"], keys["n_missing"], keys["n_repeated"]) == (3, 1, 1)
    with pytest.raises(ValueError):
        contracts.allowed_columns(["label"], forbidden=["label"])


def test_replayed_returns_are_duplicates(spark):
    batches = spark.createDataFrame([("b1", "c1"), ("b1", "c2")], "batch_id string, candidate_id string")
    rows = [(1, "b1", "c1", "s", 1.0, "pass", "p1"), (2, "b1", "c1", "s", 1.0, "pass", "p1"), (3, "b1", "c1", "s", 2.0, "pass", "p1"), (4, "b1", "c2", "s", None, "pass", "p1"), (5, "b1", "c2", "s", None, "fail", "p1"), (6, "b9", "c2", "s", 1.0, "pass", "p1")]
    r = spark.createDataFrame(rows, "ord long, batch_id string, candidate_id string, sequence string, measured double, status string, protocol_id string")
    none = spark.createDataFrame([], "candidate_id string, measured double")
    first = {x["ord"]: x["reason"] or x["outcome"] for x in ledger.judge_returns(r, batches, none, F.col("candidate_id"), "p1").collect()}
    assert first == {1: "accepted", 2: "duplicate_in_file", 3: "conflict_in_file", 4: "not_finite", 5: "failed", 6: "unknown_batch"}
    known = spark.createDataFrame([("c1", 1.0)], "candidate_id string, measured double")
    again = {x["ord"]: x["reason"] or x["outcome"] for x in ledger.judge_returns(r, batches, known, F.col("candidate_id"), "p1").collect()}
    assert again[1] == "duplicate" and again[3] == "conflict"


def test_inverse_normal():
    import statistics

    pytest.importorskip("pyspark")
    from pyspark.sql import SparkSession

    s = SparkSession.getActiveSession()
    if s is None:
        pytest.skip("no session")
    for p in (1e-4, 0.01, 0.3, 0.5, 0.9, 0.9999):
        got = s.range(1).select(ranking.inverse_normal(F.lit(p))).first()[0]
        assert abs(got - statistics.NormalDist().inv_cdf(p)) < 1e-6


def rank_rows(spark, n=400, seed=5):
    """Groups of different sizes, one of them null, many ties and nulls."""
    r = random.Random(seed)
    rows = [(r.choice(["a", "a", "a", "b", None]), r.choice([None, *map(float, range(12))]), r.choice([None, 1.0, 1.0, 1.0, 2.0, 3.0, 7.0])) for _ in range(n)]
    return rows, spark.createDataFrame(rows, "g string, truth double, pred double")


@pytest.mark.parametrize("block,blocks", [(1 << 17, 1024), (4, 1024), (4, 3), (1, 1024)])
def test_kendall_in_blocks_equals_pairs(spark, block, blocks):
    rows, df = rank_rows(spark)
    got = {x["g"]: x["kendall"] for x in metrics.kendall(df, ["g"], block=block, blocks=blocks).collect()}
    assert set(got) == {"a", "b", None}
    for g in got:
        points = [(t, p) for h, t, p in rows if h == g and t is not None and p is not None]
        sign = lambda x: (x > 0) - (x < 0)
        pairs = [(sign(a[0] - b[0]), sign(a[1] - b[1])) for i, a in enumerate(points) for b in points[:i]]
        want = sum(x * y for x, y in pairs) / (sum(x * x for x, _ in pairs) * sum(y * y for _, y in pairs)) ** 0.5
        assert got[g] == pytest.approx(want, abs=1e-12)


def test_kendall_and_ranks_of_empty_tables(spark):
    df = spark.createDataFrame([], "g string, truth double, pred double")
    assert metrics.kendall(df, ["g"]).count() == metrics.spearman(df, ["g"]).count() == metrics.bootstrap_ci(df, ["g"], "truth", 10).count() == ranking.average_ranks(df, "truth", ["g"]).count() == 0


def test_average_ranks_equal_windows(spark):
    _, df = rank_rows(spark)
    want = df.selectExpr("g", "truth", "rank() OVER (PARTITION BY g ORDER BY truth) + (count(*) OVER (PARTITION BY g, truth) - 1) / 2D AS rank")
    got = ranking.average_ranks(df, "truth", ["g"]).select("g", "truth", "rank")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    both = df.where("truth IS NOT NULL AND pred IS NOT NULL")
    pdf = both.toPandas()
    found = {x["g"]: x["spearman"] for x in metrics.spearman(both, ["g"]).collect()}
    for g, part in pdf.groupby(pdf["g"].fillna("none")):
        assert found[None if g == "none" else g] == pytest.approx(part["truth"].rank().corr(part["pred"].rank()), abs=1e-12)


def test_ranks_with_firsts_and_totals_equal_windows(spark):
    _, df = rank_rows(spark)
    got = ranking.with_ranks(df, {"_t": "truth", "_p": "pred"}, ["g"], first="_least", total="_n").select("g", "truth", "pred", "_t", "_least_t", "_least_p", "_n")
    want = df.selectExpr("g", "truth", "pred", "rank() OVER (PARTITION BY g ORDER BY truth) + (count(*) OVER (PARTITION BY g, truth) - 1) / 2D", "rank() OVER (PARTITION BY g ORDER BY truth)", "rank() OVER (PARTITION BY g ORDER BY pred)", "count(*) OVER (PARTITION BY g)")
    assert sorted(str(tuple(x)) for x in got.collect()) == sorted(str(tuple(x)) for x in want.collect())


def test_quantiles_equal_percentiles(spark):
    _, df = rank_rows(spark)
    shares = {"low": 0.0, "a": 0.05, "third": 1 / 3, "middle": 0.5, "high": 0.95, "top": 1.0}
    for groups in ([], ["g"]):
        want = df.where("truth IS NOT NULL").groupBy(*groups).agg(*[F.percentile("truth", s).alias(n) for n, s in shares.items()])
        got = {x["g"] if groups else 0: x for x in ranking.quantiles(df, "truth", shares, groups).collect()}
        for x in want.collect():
            assert tuple(got[x["g"] if groups else 0][n] for n in shares) == pytest.approx(tuple(x[n] for n in shares), abs=1e-12)
    same = spark.createDataFrame([("a", 3)] * 5 + [("b", None)], "g string, truth int")
    assert [tuple(x) for x in ranking.quantiles(same, "truth", shares, ["g"]).collect()] == [("a",) + (3.0,) * 6]
    assert ranking.quantiles(same.limit(0), "truth", shares).collect()[0]["middle"] is None
    assert {x["g"]: (x["n"], x["median"]) for x in metrics.distribution(same, ["g"], "truth").collect()} == {"a": (5, 3.0), "b": (1, None)}


def test_metrics_of_groups_equal_loops(spark):
    rows = [(g, i, (i * 7919) % 31 / 3, (i * 104729) % 37 / 5, (i * 31) % 11 / 2) for g, size in (("a", 41), ("b", 7), (None, 1)) for i in range(size)]
    df = spark.createDataFrame(rows, "g string, id long, truth double, pred double, delta double")
    recall = {x["g"]: (x["k"], x["recall"]) for x in metrics.top_k_recall(df, ["g"], 0.3).collect()}
    tails = {x["g"]: x for x in metrics.tail_stats(df, ["g"], "id", 0.2).collect()}
    bins = {(x["g"], x["decile"]): x["n"] for x in metrics.error_by_decile(df, ["g"], "pred", F.abs("delta"), "id").collect()}
    for g in ("a", "b", None):
        part = [r for r in rows if r[0] == g]
        k = max(1, round(0.3 * len(part)))
        best = [{r[1] for r in sorted(part, key=lambda r: (r[c], r[1]))[:k]} for c in (2, 3)]  # noqa: B023
        assert recall[g] == (k, pytest.approx(len(best[0] & best[1]) / k))
        k, by = max(1, round(0.2 * len(part))), [r[4] for r in sorted(part, key=lambda r: (r[4], r[1]))]
        assert tails[g]["k"] == k and tails[g]["best_mean"] == pytest.approx(sum(by[:k]) / k) and tails[g]["worst_mean"] == pytest.approx(sum(by[-k:]) / k)
        for d in range(10):
            assert bins.get((g, d), 0) == (d + 1) * len(part) // 10 - d * len(part) // 10


def test_bootstrap_keeps_null_groups(spark):
    rows, df = rank_rows(spark)
    got = {x["g"]: x for x in metrics.bootstrap_ci(df, ["g"], "truth", 400).collect()}
    by_weights = {x["g"]: x for x in metrics.bootstrap_ci(df, ["g"], "truth", 4000, packed=100).collect()}  # the larger group by weighted sums
    for g, x in by_weights.items():
        assert tuple(x)[:3] == pytest.approx(tuple(got[g])[:3]) if g is not None else x["n"] == got[g]["n"]
        assert [x["ci_low"], x["ci_high"]] == pytest.approx([got[g]["ci_low"], got[g]["ci_high"]], abs=0.3 * (got[g]["ci_high"] - got[g]["ci_low"]) + 1e-9)
    for g in ("a", "b", None):
        values = [t for h, t, _ in rows if h == g and t is not None]
        mean = sum(values) / len(values)
        error = (sum((v - mean) ** 2 for v in values) / len(values) ** 2) ** 0.5
        assert got[g]["n"] == len(values) and got[g]["mean"] == pytest.approx(mean)
        assert got[g]["ci_low"] == pytest.approx(mean - 1.96 * error, abs=error / 2) and got[g]["ci_high"] == pytest.approx(mean + 1.96 * error, abs=error / 2)


@pytest.mark.parametrize("head_rows", [1, 3, 17, 4096])
def test_farthest_first_of_any_head_equals_a_loop(spark, head_rows):
    pool, known = patterns(spark, 70, 3), patterns(spark, 4, 9)
    got = [r["cand_id"] for r in selection.farthest_first(pool, known, 12, [F.col("y")], head_rows=head_rows).orderBy("pick").collect()]
    left, chosen, want = pool.collect(), [r["pattern"] for r in known.collect()], []
    for _ in range(12):
        best = min(left, key=lambda r: (-min(distance(r["pattern"], p) for p in chosen), r["y"], r["cand_id"]))
        left.remove(best)
        chosen.append(best["pattern"])
        want.append(best["cand_id"])
    assert got == want
