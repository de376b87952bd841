"""Queries of generation (C), screening and fusion (M), sources (S), and the features that need joins."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from itertools import combinations, product
from math import exp, factorial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqsieve.functions import sequence as S
from seqsieve.functions import structure as T
from seqsieve.operators import generate as C
from seqsieve.operators import metrics as A
from seqsieve.operators import screen as M
from seqsieve.operators import search as B
from seqsieve.operators import splits as K
from seqsieve.operators import wrappers
from seqsieve.operators.ranking import top_k, with_ranks
from seqsieve.operators.space import neighbour_information
from seqsieve.plans.materialise import materialise, shared_dir
from seqsieve.plans.metric_queries import rounded
from seqsieve.plans.registry import query
from seqsieve.sources import io

# candidate generation

PREFERENCE = "CAST(concat('0x', substr(md5(concat('m', {0})), 1, 6)) AS BIGINT)"


def score(c: str = "pattern"):
    """A scorer that any engine reproduces."""
    return F.conv(F.substring(F.md5(F.concat(F.lit("m"), F.col(c)).cast("binary")), 1, 6), 16, 10).cast("long")


@query("c1_waterfill", "patterned", oracle=f"""
WITH RECURSIVE h AS (SELECT hamming(pattern, '{S.WILD_PATTERN}') AS k, count(*) AS known FROM (SELECT DISTINCT pattern FROM patterned) q GROUP BY 1),
s AS (SELECT v.k, v.capacity, coalesce(h.known, 0) AS known FROM (VALUES (1, 39), (2, 702), (3, 7722), (4, 57915), (5, 312741)) v(k, capacity) LEFT JOIN h ON v.k = h.k),
r AS (SELECT list(capacity - known ORDER BY k)::BIGINT[] AS room, list(0 ORDER BY k)::BIGINT[] AS plan, 3000::BIGINT AS total FROM s
 UNION ALL SELECT room, new, total - list_sum(new)::BIGINT + list_sum(plan)::BIGINT FROM (
  SELECT *, list_transform(plan, lambda x, i: x + CASE WHEN free[i] = 0 THEN 0 WHEN total >= list_sum(free) THEN least(total // list_sum(free), room[i] - x) WHEN list_sum(free[1:i]) <= total THEN 1 ELSE 0 END)::BIGINT[] AS new FROM (
   SELECT *, list_transform(plan, lambda x, i: (x < room[i])::INT) AS free FROM r WHERE total > 0)))
SELECT s.k, s.capacity::BIGINT AS capacity, s.known::BIGINT AS known, plan[s.k] AS quota FROM s, r WHERE r.total = 0""")
def c1(v):
    return C.stratum_plan(v, [1, 2, 3, 4, 5], 3000)


@query("c2_stratified", "patterned", oracle="SELECT * FROM (VALUES (2, 200::BIGINT, 200::BIGINT, true), (3, 300, 300, true), (4, 300, 300, true)) v(n_changed, n, n_distinct, fine)")
def c2(v):
    """Of a stratum that has less room than its quota, all that is left: on six times sf0.1 the table holds each of the 702 patterns with two changes, so there is no new one, and the SQL's fixed counts can't be met."""
    wanted = {2: 200, 3: 300, 4: 300}
    rooms = C.stratum_rooms(v, list(wanted))
    made = C.stratified_candidates(v.sparkSession, {k: min(n, rooms[k]) for k, n in wanted.items() if rooms[k]}, v.select("pattern").distinct(), 11)
    excluded = v.select("pattern").distinct().withColumn("bad", F.lit(True))
    x = made.join(excluded, "pattern", "left")
    fine = F.bool_and(F.col("bad").isNull() & (S.changed_count(F.col("sequence")) == F.col("n_changed")) & S.contract_reason(F.col("sequence")).isNull())
    return x.groupBy("n_changed").agg(F.count("*").alias("n"), F.countDistinct("pattern").alias("n_distinct"), fine.alias("fine"))


@query("c3_local_mutants", "labelled", oracle="SELECT cand_id, 5::BIGINT AS n, true AS fine FROM labelled")
def c3(known):
    parents = known.select("cand_id", "pattern")
    made = C.local_mutants(parents, 2, 5, 3)
    x = made.join(parents.select("cand_id", F.col("pattern").alias("parent")), "cand_id")
    return x.groupBy("cand_id").agg(F.count("*").alias("n"), F.bool_and(S.hamming(F.col("pattern"), F.col("parent")) == 2).alias("fine"))


HOPS = f"""f AS (SELECT DISTINCT pattern AS parent FROM labelled), h AS (SELECT parent, concat(substr(parent, 1, i - 1), b, substr(parent, i + 1, 13)) AS pattern FROM f, range(1, 14) r(i), (VALUES ('A'), ('C'), ('G'), ('U')) x(b) WHERE substr(parent, i, 1) <> b),
hops AS (SELECT * FROM h WHERE hamming(pattern, '{S.WILD_PATTERN}') BETWEEN 1 AND 5)"""


def _frontier(known):
    return known.select("pattern").distinct()


@query("c4_one_hop", "labelled", oracle=f"WITH {HOPS} SELECT parent, pattern FROM hops")
def c4(known):
    return C.one_hop(_frontier(known), 1, 5)


@query("c5_two_hop", "labelled", oracle="""
WITH f AS (SELECT DISTINCT pattern AS parent FROM labelled), b AS (SELECT unnest(['A', 'C', 'G', 'U']) AS b),
h AS (SELECT parent, concat(substr(parent, 1, i - 1), x.b, substr(parent, i + 1, j - i - 1), y.b, substr(parent, j + 1, 13)) AS pattern FROM f, range(1, 14) r(i), range(1, 14) q(j), b x, b y WHERE i < j AND substr(parent, i, 1) <> x.b AND substr(parent, j, 1) <> y.b),
n AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY md5(concat('4:', pattern)), pattern) AS rn FROM h) SELECT parent, pattern FROM n WHERE rn <= 40""")
def c5(known):
    return C.two_hop(known.select("pattern").distinct(), 40, 4)


@query("c6_initial_seeds", "labelled")
def c6(known):
    """Greedy at a distance; tests hold order and distances."""
    return C.spread_best(known, "y", 6, 3, 200).select("cand_id", "pattern", "pick")


@query("c6_all_seeds", "labelled")
def c6_all(known):
    """The measured seeds and random ones; tests hold both."""
    return C.initial_seeds(known, "y", 6, 3, 10, 5)


@query("c7_score_new", "pool", "labelled", oracle=f"""
WITH w AS (SELECT DISTINCT pattern FROM pool), c AS (SELECT DISTINCT pattern FROM labelled), o AS (SELECT pattern, {PREFERENCE.format('pattern')} AS pred, true AS cached FROM w SEMI JOIN c USING (pattern)),
n AS (SELECT pattern, {PREFERENCE.format('pattern')} AS pred, false AS cached FROM w ANTI JOIN c USING (pattern)) SELECT * FROM o UNION ALL SELECT * FROM n""")
def c7(p, known):
    cache = known.select("pattern").distinct().withColumn("pred", score()).withColumn("snapshot", F.lit("s1"))
    return C.score_new(p, cache, 4 ** len(S.WILD_PATTERN), score(), "s1").select("pattern", "pred", "cached")


def _searches(known):
    return known.select((F.col("cand_id") % 3).alias("search_id"), "pattern").distinct()


SEARCH_HOPS = HOPS.replace("SELECT DISTINCT pattern AS parent FROM labelled", "SELECT DISTINCT cand_id % 3 AS search_id, pattern AS parent FROM labelled").replace("SELECT parent, concat", "SELECT search_id, parent, concat")


@query("c9_survive", "labelled")
def c9(known):
    """Greedy survivors of each search; tests hold them against a plain loop."""
    scored = _searches(known).withColumn("pred", score())
    return C.survive(scored, "search_id", 8, 3)


@query("c10_generation", "labelled", oracle=f"WITH {SEARCH_HOPS.replace('BETWEEN 1 AND 5', 'BETWEEN 0 AND 13')}, v AS (SELECT DISTINCT cand_id % 3 AS search_id, pattern FROM labelled) SELECT search_id, pattern, min(parent) AS parent, {PREFERENCE.format('pattern')} AS pred FROM hops ANTI JOIN v USING (search_id, pattern) GROUP BY 1, 2")
def c10(known):
    f = _searches(known)
    scored, _ = C.generation(f, f, "search_id", score(), 8, 2)
    return scored.select("search_id", "pattern", "parent", "pred")


@query("c10_search", "labelled")
def c10_search(known):
    """Three whole searches of many generations, all that they scored; tests hold them against a loop over each search."""
    seeds = known.select((F.col("cand_id") % 3).alias("search"), "pattern")
    rules = B.Rules(width=8, offspring=24, max_generations=6, max_stagnant=3, budget=100_000, seed=5, elites=1)
    return B.run(seeds, score(), rules, forbidden=known.where("y > 1500")).archive.withColumnRenamed("search", "search_id")


@query("c11_best_neighbour", "labelled", oracle=f"""
WITH {SEARCH_HOPS.replace('BETWEEN 1 AND 5', 'BETWEEN 0 AND 13')}, s AS (SELECT search_id, parent, arg_min(pattern, ({PREFERENCE.format('pattern')}, pattern)) AS best, min({PREFERENCE.format('pattern')}) AS pred FROM hops GROUP BY 1, 2)
SELECT search_id, parent AS from_pattern, CASE WHEN pred < {PREFERENCE.format('parent')} THEN best ELSE parent END AS pattern, least(pred, {PREFERENCE.format('parent')}) AS pred, pred >= {PREFERENCE.format('parent')} AS ended FROM s""")
def c11(known):
    walks = _searches(known).withColumn("pred", score())
    return C.best_neighbour(C.one_hop(walks, carry=["search_id"]).withColumn("pred", score()), walks, "search_id")


@query("c12_uniform_frontier", "labelled", oracle=f"WITH {HOPS}, r AS (SELECT pattern, row_number() OVER (ORDER BY md5(concat('8:', pattern)), pattern) AS rn FROM (SELECT DISTINCT pattern FROM hops)) SELECT pattern FROM r WHERE rn <= 100")
def c12(known):
    from seqsieve.operators.ranking import seeded_order

    new = C.one_hop(_frontier(known), 1, 5).select("pattern").distinct()
    return new.orderBy(seeded_order(F.lit(8), F.col("pattern")), "pattern").limit(100)


@query("c13_groups", "labelled", oracle=f"""
WITH x AS (SELECT DISTINCT cand_id % 3 AS search_id, pattern, {PREFERENCE.format('pattern')} AS pred FROM labelled), r AS (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY pred, pattern) AS rn FROM x), a AS (SELECT search_id, pattern AS p1 FROM r WHERE rn = 1),
b AS (SELECT r.search_id, arg_min(pattern, (pred, pattern)) AS p2 FROM r JOIN a ON r.search_id = a.search_id WHERE rn <= 40 AND hamming(pattern, p1) >= 5 GROUP BY 1)
SELECT r.search_id, pattern, CASE WHEN p2 IS NOT NULL AND hamming(pattern, p2) < hamming(pattern, p1) THEN 2 ELSE 1 END AS "group" FROM r JOIN a ON r.search_id = a.search_id LEFT JOIN b ON r.search_id = b.search_id""")
def c13(known):
    x = known.select((F.col("cand_id") % 3).alias("search_id"), "pattern").distinct().withColumn("pred", score())
    return C.prototype_groups(x, "search_id", 40, 5).select("search_id", "pattern", "group")


@query("c13_group_distances", "labelled", oracle=f"""
WITH x AS (SELECT DISTINCT cand_id % 3 AS search_id, pattern, {PREFERENCE.format('pattern')} AS pred FROM labelled), r AS (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY pred, pattern) AS rn FROM x), a AS (SELECT search_id, pattern AS p1 FROM r WHERE rn = 1),
b AS (SELECT r.search_id, arg_min(pattern, (pred, pattern)) AS p2 FROM r JOIN a ON r.search_id = a.search_id WHERE rn <= 40 AND hamming(pattern, p1) >= 5 GROUP BY 1),
d AS (SELECT r.search_id, hamming(pattern, p1) AS d1, CASE WHEN p2 IS NOT NULL THEN hamming(pattern, p2) ELSE 99 END AS d2 FROM r JOIN a ON r.search_id = a.search_id LEFT JOIN b ON r.search_id = b.search_id)
SELECT search_id, CASE WHEN d2 < d1 THEN 2 ELSE 1 END AS "group", count(*) AS n, min(least(d1, d2)) AS min_distance, round(avg(least(d1, d2)), 6) AS mean_distance, max(least(d1, d2)) AS max_distance FROM d GROUP BY 1, 2""")
def c13_distances(known):
    x = known.select((F.col("cand_id") % 3).alias("search_id"), "pattern").distinct().withColumn("pred", score())
    return rounded(C.group_distances(C.prototype_groups(x, "search_id", 40, 5), "search_id"))


@query("c14_allotment", "pool", oracle="""
WITH g AS (SELECT cand_id, cand_id % 10 = 0 AS small, y FROM pool), n AS (SELECT count(*) FILTER (small) AS a FROM g), r AS (SELECT *, row_number() OVER (PARTITION BY small ORDER BY y, cand_id) AS rn FROM g)
SELECT cand_id FROM r, n WHERE CASE WHEN small THEN rn <= least(a, 150) ELSE rn <= 300 - least(a, 150) END""")
def c14(p):
    from seqsieve.operators.selection import grouped_batch

    g = p.withColumn("grp", F.when(F.col("cand_id") % 10 == 0, "small").otherwise("zlarge"))
    return grouped_batch(g, "grp", 300, "y").select("cand_id")


@query("k16_corpus", "labelled", oracle="SELECT 500::BIGINT AS n, 500::BIGINT AS n_distinct, true AS fine")
def k16(known):
    made = C.variant_corpus(known, known.select("pattern").distinct(), 500, 9)
    held = known.select("pattern").distinct().withColumn("bad", F.lit(True))
    return made.join(held, "pattern", "left").agg(F.count("*").alias("n"), F.countDistinct("pattern").alias("n_distinct"), F.bool_and(F.col("bad").isNull() & S.contract_reason(F.col("sequence")).isNull()).alias("fine"))


@query("k17_masking", "patterned")
def k17(v):
    """Masked tokens; tests hold shares and reproducibility."""
    coded = v.select("cand_id", S.tokens(F.col("sequence")).alias("t"))
    out = C.masked_tokens(coded, "t", "cand_id", 5, len(S.VOCABULARY), S.VOCABULARY["[MASK]"], len(S.SPECIAL_TOKENS))
    return out.select("cand_id", F.array_join(F.col("input").cast("array<string>"), ",").alias("input"), F.array_join(F.col("label").cast("array<string>"), ",").alias("label"))


# structures and scores

FOLD = "CASE WHEN p_partkey % 3 = 0 THEN '((..))' WHEN p_partkey % 3 = 1 THEN '(.)(.)' ELSE '((.)..' END"


@query("f19_partners", "part", oracle="""
WITH t AS (SELECT * FROM (VALUES (0, 0, 5), (0, 1, 4), (0, 2, -1), (0, 3, -1), (0, 4, 1), (0, 5, 0), (1, 0, 2), (1, 1, -1), (1, 2, 0), (1, 3, 5), (1, 4, -1), (1, 5, 3), (2, 0, -1), (2, 1, 3), (2, 2, -1), (2, 3, 1), (2, 4, -1), (2, 5, -1)) v(k, i, j)) SELECT p_partkey, i, j FROM part JOIN t ON p_partkey % 3 = k""")
def f19(p):
    return T.partners(p.select("p_partkey", F.expr(FOLD).alias("s")), "p_partkey", "s")


@query("f20_defect", "part", oracle="""
WITH t AS (SELECT * FROM (VALUES (0, 0, 5), (0, 1, 4), (0, 2, 2), (0, 3, 3), (0, 4, 1), (0, 5, 0), (1, 0, 2), (1, 1, 1), (1, 2, 0), (1, 3, 5), (1, 4, 4), (1, 5, 3), (2, 0, 0), (2, 1, 3), (2, 2, 2), (2, 3, 1), (2, 4, 4), (2, 5, 5)) v(k, i, j))
SELECT p_partkey, count(*) AS n, round(6 - sum(least(1.0, greatest(0.0, CASE WHEN (i + j) % 3 = 0 THEN NULL ELSE (p_partkey % 7 + i + j) / 12.0 - 0.1 END))) - 0.0, 6) AS defect FROM part JOIN t ON p_partkey % 3 = k GROUP BY 1""")
def f20(p):
    p = p.repartition(2 * p.sparkSession.sparkContext.defaultParallelism, "p_partkey")  # a small file would make one task; the windows and joins by key stay where they are
    target = T.partners(p.select("p_partkey", F.expr(FOLD).alias("s")), "p_partkey", "s")
    at = F.sequence(F.lit(0), F.lit(5))
    grid = p.select("p_partkey", F.explode(at).alias("i")).select("*", F.explode(at).alias("j")).where("(i + j) % 3 <> 0")
    return rounded(T.ensemble_defect(target, grid.withColumn("p", (F.col("p_partkey") % 7 + F.col("i") + F.col("j")) / 12.0 - 0.1), "p_partkey"))


@query("f21_hybrid", "scores", oracle="SELECT seed, id, round(0.961 * a + 0.039 * b, 6) AS hybrid FROM scores")
def f21(s):
    return rounded(s.select("seed", "id", T.hybrid(F.col("a"), F.col("b")).alias("hybrid")))


@query("f22_lower_bound", "scores", oracle="SELECT seed, id, beta::DOUBLE AS beta, round(b - beta * a, 4) AS bound FROM scores, (VALUES (0.5), (1.0), (2.0)) v(beta)")
def f22(s):
    x = s.withColumn("beta", F.explode(F.array(F.lit(0.5), F.lit(1.0), F.lit(2.0))))
    return rounded(x.select("seed", "id", "beta", T.lower_bound(F.col("b"), F.col("a"), F.col("beta")).alias("bound")), 4)


FEATURES = ["f_quantity", "f_discount", "f_tax", "f_line", "f_supplier"]


@query("f23_standardised", "features", oracle="WITH m AS (SELECT avg(f_quantity) AS m, stddev_pop(f_quantity) AS s FROM features WHERE id % 5 > 0) SELECT id, round((f_quantity - m) / s, 6) AS z FROM features, m")
def f23(f):
    stats = f.where("id % 5 > 0").agg(F.avg("f_quantity").alias("m"), F.stddev_pop("f_quantity").alias("s"))
    return rounded(f.join(F.broadcast(stats)).select("id", ((F.col("f_quantity") - F.col("m")) / F.col("s")).alias("z")))


@query("f24_valid", "events_long", oracle="SELECT count(*) AS n, count(*) FILTER (value IS NOT NULL AND value - 20 >= 0) AS n_valid FROM events_long")
def f24(e):
    return e.agg(F.count("*").alias("n"), F.count_if(T.valid_prediction(F.col("value"), F.col("value") - 20)).alias("n_valid"))


# screening and fusion


@query("m1_variance", "features", oracle="SELECT * FROM (UNPIVOT (SELECT round(var_samp(f_quantity), 6) AS f_quantity, round(var_samp(f_discount), 6) AS f_discount, round(var_samp(f_tax), 6) AS f_tax, round(var_samp(f_line), 6) AS f_line, round(var_samp(f_supplier), 6) AS f_supplier FROM features) ON COLUMNS(*) INTO NAME feature VALUE score)")
def m1(f):
    return rounded(M.variances(f, FEATURES))


@query("m2_f_statistic", "features", oracle="SELECT feature, round(score, 3) AS score FROM (UNPIVOT (SELECT " + ", ".join(f"(count(*) - 2) * corr({c}, y) * corr({c}, y) / (1 - corr({c}, y) * corr({c}, y)) AS {c}" for c in FEATURES) + " FROM features) ON COLUMNS(*) INTO NAME feature VALUE score) ORDER BY score DESC LIMIT 3")
def m2(f):
    return M.top_features(M.f_scores(f, FEATURES, "y"), 3).select("feature", F.round("score", 3).alias("score"))


LONG = "long AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS v, y FROM features" for c in FEATURES) + ")"


@query("m2_log_p", "features", oracle="WITH fs AS (SELECT feature, score FROM (UNPIVOT (SELECT " + ", ".join(f"(count(*) - 2) * corr({c}, y) * corr({c}, y) / (1 - corr({c}, y) * corr({c}, y)) AS {c}" for c in FEATURES) + " FROM features) ON COLUMNS(*) INTO NAME feature VALUE score)) SELECT feature, round(score, 4) AS f, row_number() OVER (ORDER BY score DESC, feature)::INTEGER AS rank FROM fs")
def m2_log_p(f):
    """Ranked by -log10 p, whose values tests hold against exact sums."""
    scores = M.f_log_p(f, FEATURES, "y")
    return rounded(top_k(scores, len(FEATURES), [F.desc("score"), F.col("feature")]).select("feature", "f", "rank"), 4)


@query("m3_spearman_filter", "features", oracle=f"WITH {LONG}, r AS (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2.0 AS a, rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2.0 AS b FROM long) SELECT feature, round(abs(corr(a, b)), 6) AS score FROM r GROUP BY 1")
def m3(f):
    return rounded(M.spearman_scores(f, FEATURES, "y"))


@query("m4_information", "features", oracle=f"""
WITH {LONG}, c AS (SELECT feature, floor((rank() OVER (PARTITION BY feature ORDER BY v) - 1) * 8 / count(*) OVER (PARTITION BY feature)::DOUBLE) AS x, floor((rank() OVER (PARTITION BY feature ORDER BY y) - 1) * 8 / count(*) OVER (PARTITION BY feature)::DOUBLE) AS z FROM long),
n AS (SELECT feature, x, z, count(*) AS n FROM c GROUP BY 1, 2, 3), t AS (SELECT feature, n / sum(n) OVER (PARTITION BY feature) * ln(n * sum(n) OVER (PARTITION BY feature) / (sum(n) OVER (PARTITION BY feature, x) * sum(n) OVER (PARTITION BY feature, z))) AS t FROM n) SELECT feature, round(sum(t), 6) AS score FROM t GROUP BY 1""")
def m4(f):
    return rounded(M.information_scores(f, FEATURES, "y"))


@query("m4_neighbours", "features")
def m4_neighbours(f):
    """Distances of all pairs have no SQL that ends on the whole table; tests hold the score against a loop."""
    long = M.unpivot(f, FEATURES, ["y"])
    return rounded(neighbour_information(long.select("feature", "value", "y"), axes=("value", "y")))


F_SCORES = "fs AS (SELECT feature, score FROM (UNPIVOT (SELECT " + ", ".join(f"(count(*) - 2) * corr({c}, y) * corr({c}, y) / (1 - corr({c}, y) * corr({c}, y)) AS {c}" for c in FEATURES) + " FROM features) ON COLUMNS(*) INTO NAME feature VALUE score))"
#: The feature that explains most by itself. It explains nearly all of y, so any sound screen must put it first.
STRONGEST = f"WITH {F_SCORES} SELECT feature FROM fs ORDER BY score DESC, feature LIMIT 1"


def residuals(source: str, features, name: str = "res") -> str:
    """CTEs that end with name(g, id, w, y, r, ...): least squares with weights w in each group g of source(g, id, w, y, features), as r = y - prediction for all rows, w = 0 included.

    Columns are centred by the weighted means and then made orthogonal one after another; what is left of y at last is its residual.
    """
    features = list(features)
    mean = lambda c: f"{c} - sum(w * {c}) OVER (PARTITION BY g) / sum(w) OVER (PARTITION BY g) AS {c}"
    ctes = [f"{name}0 AS (SELECT g, id, w, y, y AS r, {', '.join(features)} FROM {source})", f"{name}00 AS (SELECT g, id, w, y, {', '.join(map(mean, ['r', *features]))} FROM {name}0)"]
    last = f"{name}00"
    for i, f in enumerate(features):
        rest = features[i + 1 :]
        less = lambda c: f"{c} - {f} * sum(w * {f} * {c}) OVER (PARTITION BY g) / sum(w * {f} * {f}) OVER (PARTITION BY g) AS {c}"  # noqa: B023,E731
        now = name if not rest else f"{name}{i + 1}"
        ctes.append(f"{now} AS (SELECT g, id, w, y, {', '.join(map(less, ['r', *rest]))} FROM {last})")
        last = now
    return ", ".join(ctes)


R2 = "round(1 - avg(r * r) / var_pop(y), 6) AS r2"
FOLDED = "fo AS (SELECT *, ((row_number() OVER (ORDER BY md5(concat('1:', id)), id) - 1) % 3)::INTEGER AS fold FROM features)"
OTHER_FOLDS = f"{FOLDED}, src AS (SELECT k.g, (fold <> k.g)::INTEGER AS w, fo.* FROM fo, (VALUES (0), (1), (2)) k(g))"
SPLIT = "o AS (SELECT v.*, s.g, row_number() OVER (PARTITION BY s.g ORDER BY md5(concat(s.g, ':', v.id)), v.id) AS rn, count(*) OVER (PARTITION BY s.g) AS n FROM features v, (VALUES (1), (2)) s(g)), src AS (SELECT *, (rn > ceil(n * 0.3))::INTEGER AS w FROM o)"


@query("m5_tree_screen", "features", oracle=STRONGEST)
def m5(f):
    return M.top_features(M.tree_importance(f, FEATURES, "y"), 1).select("feature")


@query("m6_permutation", "features", oracle=STRONGEST)
def m6(f):
    found = M.permutation_importance(f, FEATURES, "y", "linear", 1, "id")
    return M.top_features(found, 1).select("feature")


@query("m7_lasso", "features", oracle=STRONGEST)
def m7(f):
    return M.top_features(M.lasso_selection(f, FEATURES, "y"), 1).select("feature")


@query("m8_shadow", "features")
def m8(f):
    """All features that the shadows leave; tests hold it on a table with two planted features."""
    chosen = M.shadow_selection(f, FEATURES, "y", "id")
    return f.sparkSession.createDataFrame([(c,) for c in chosen], "feature string")


def _subset_scores(sizes) -> str:
    """CTEs that end with sc(names, r2): the held-out score on fold 0 of least squares of the other folds, for every subset of FEATURES of the given sizes."""
    subsets = [c for n in sizes for c in combinations(sorted(FEATURES), n)]
    parts = [f"SELECT '{'|'.join(c)}' AS names, (WITH {residuals('one', c, 'q')} SELECT 1 - avg(r * r) / var_pop(y) FROM q WHERE w = 0) AS r2" for c in subsets]
    return f"{FOLDED}, one AS (SELECT 0 AS g, (fold <> 0)::INTEGER AS w, * FROM fo), sc AS ({' UNION ALL '.join(parts)})"


def _scored(f):
    moments = _moments(f)
    return lambda names: wrappers.held_out_r2(moments, names)


def _listed(f, names):
    return f.sparkSession.createDataFrame(list(enumerate(names, 1)), "place int, feature string")


@query("m9_forward", "features", oracle=f"""
WITH {_subset_scores((1, 2))}, a AS (SELECT names FROM sc WHERE NOT contains(names, '|') ORDER BY r2 DESC, names LIMIT 1), b AS (SELECT string_split(sc.names, '|') AS x FROM sc, a WHERE contains(sc.names, '|') AND list_contains(string_split(sc.names, '|'), a.names) ORDER BY r2 DESC, sc.names LIMIT 1)
SELECT 1 AS place, names AS feature FROM a UNION ALL SELECT 2, CASE WHEN x[1] = names THEN x[2] ELSE x[1] END FROM a, b""")
def m9(f):
    return _listed(f, M.forward_selection(FEATURES, 2, _scored(f)))


@query("m9_backward", "features", oracle=f"""
WITH {_subset_scores((4, 3))}, a AS (SELECT string_split(names, '|') AS x FROM sc WHERE len(string_split(names, '|')) = 4 ORDER BY r2 DESC, names DESC LIMIT 1), b AS (SELECT string_split(names, '|') AS z FROM sc, a WHERE len(string_split(names, '|')) = 3 AND list_has_all(x, string_split(names, '|')) ORDER BY r2 DESC, names DESC LIMIT 1)
SELECT i::INTEGER AS place, z[i] AS feature FROM b, range(1, 4) t(i)""")
def m9_backward(f):
    return _listed(f, M.backward_selection(FEATURES, 3, _scored(f)))


@query("m9_rfe", "features", oracle=STRONGEST)
def m9_rfe(f):
    d = materialise(f)
    return _listed(f, M.recursive_elimination(d, FEATURES, "y", 1)).select("feature")


def _subset_ranks(sizes) -> str:
    """CTEs that end with sc(names, score): the mean over three folds of the rank correlation of the held-out target with least squares of the other folds, for every subset of FEATURES of the given sizes."""
    subsets = [c for n in sizes for c in combinations(sorted(FEATURES), n)]
    part = lambda c: f"SELECT '{'|'.join(c)}' AS names, (WITH {residuals('src', c, 'q')}, p AS (SELECT g, y, round(y - r, 6) AS p FROM q WHERE w = 0), k AS (SELECT g, rank() OVER (PARTITION BY g ORDER BY y) + (count(*) OVER (PARTITION BY g, y) - 1) / 2.0 AS a, rank() OVER (PARTITION BY g ORDER BY p) + (count(*) OVER (PARTITION BY g, p) - 1) / 2.0 AS b FROM p), s AS (SELECT g, CASE WHEN min(b) < max(b) THEN corr(a, b) ELSE 0 END AS s FROM k GROUP BY 1) SELECT round(avg(s), 9) FROM s) AS score"
    return f"{OTHER_FOLDS}, sc AS ({' UNION ALL '.join(map(part, subsets))})"


def _stepwise(f, steps):
    return rounded(f.sparkSession.createDataFrame([(i, *s) for i, s in enumerate(steps, 1)], "place int, feature string, score double"), 6)


def _moments(f):
    return wrappers.fold_moments(materialise(_folds(f)), FEATURES, "y")


@query("m9_forward_ranked", "features", oracle=f"""
WITH {_subset_ranks((1, 2))}, a AS (SELECT names, score FROM sc WHERE NOT contains(names, '|') ORDER BY score DESC, names LIMIT 1), b AS (SELECT sc.names AS x, sc.score FROM sc, a WHERE contains(sc.names, '|') AND list_contains(string_split(sc.names, '|'), a.names) ORDER BY sc.score DESC, sc.names LIMIT 1)
SELECT 1 AS place, names AS feature, round(score, 6) AS score FROM a UNION ALL SELECT 2, CASE WHEN split_part(x, '|', 1) = names THEN split_part(x, '|', 2) ELSE split_part(x, '|', 1) END, round(b.score, 6) FROM a, b WHERE b.score > a.score""")
def m9_forward_ranked(f):
    """By the rank correlation of inner folds, each round's subsets ranked together."""
    return _stepwise(f, wrappers.forward(_moments(f), 2, 0.0))


@query("m9_backward_ranked", "features", oracle=f"""
WITH {_subset_ranks((4, 3))}, every AS (SELECT {sorted(FEATURES)} AS v), a AS (SELECT string_split(names, '|') AS x, score FROM sc WHERE len(string_split(names, '|')) = 4 ORDER BY score DESC, names DESC LIMIT 1), b AS (SELECT string_split(names, '|') AS z, sc.score FROM sc, a WHERE len(string_split(names, '|')) = 3 AND list_has_all(x, string_split(names, '|')) ORDER BY sc.score DESC, names DESC LIMIT 1)
SELECT 1 AS place, list_filter(v, lambda e: NOT list_contains(x, e))[1] AS feature, round(score, 6) AS score FROM every, a UNION ALL SELECT 2, list_filter(x, lambda e: NOT list_contains(z, e))[1], round(b.score, 6) FROM a, b""")
def m9_backward_ranked(f):
    """The two that go, in order, and how the others then score."""
    return _stepwise(f, wrappers.backward(_moments(f), 3))


@query("m9_elimination", "features")
def m9_elimination(f):
    """All but the last feature in the order of leaving, with the size of the coefficient; tests hold it against a loop that refits."""
    return _stepwise(f, wrappers.elimination(_moments(f), 1))


@query("m10_force_keep", "features", oracle=f"WITH {F_SCORES} SELECT 'f_tax' AS feature UNION ALL (SELECT feature FROM fs WHERE feature <> 'f_tax' ORDER BY score DESC, feature LIMIT 1)")
def m10(f):
    return M.top_features(M.f_scores(f, FEATURES, "y"), 2, forced=["f_tax"]).select("feature")


@query("m11_stability", "selected", oracle="SELECT method, feature, count(DISTINCT seed % 5) AS n_folds FROM selected GROUP BY 1, 2 HAVING count(DISTINCT seed % 5) >= 3")
def m11(s):
    folded = s.withColumn("fold", F.col("seed") % 5)
    return M.stable_features(folded, 5, 0.6, ["method"])


@query("m12_refine", "features", oracle=STRONGEST)
def m12(f):
    """Screen by trees, refine what is left by F."""
    screened = M.top_features(M.tree_importance(f, FEATURES, "y"), 3).select("feature")
    return M.top_features(M.f_scores(f, FEATURES, "y").join(F.broadcast(screened), "feature", "left_semi"), 1).select("feature")


def _folds(f, k: int = 3):
    return K.k_fold(f.withColumn("seed", F.lit(1)), "id", k)


@query("m13_grid", "features", oracle=f"WITH {SPLIT}, {residuals('src', FEATURES)}, l AS (SELECT g AS seed, count(*) AS n, {R2}, round(avg(abs(r)), 4) AS mae FROM res WHERE w = 0 GROUP BY 1) SELECT seed, m.model, n, CASE WHEN m.model = 'linear' THEN r2 END AS r2, CASE WHEN m.model = 'linear' THEN mae END AS mae, r2 > 0.5 AS learned FROM l, (VALUES ('gbt'), ('linear'), ('rf')) m(model)")
def m13(f):
    """Seeds by models: the training rows of both seeds are merged in one pass, which is all that the fits read; each seed's test rows are read once for all models. Only least squares has numbers that SQL can repeat; the trees say whether they learned."""
    d = K.train_test(K.with_seeds(materialise(f), [1, 2]), "id", 0.3)
    train = materialise(M.merged(d.where("role = 'train'"), FEATURES, "y", keys=["seed"]))
    names = ("rf", "gbt", "linear")

    def scored(seed):
        out = d.where((F.col("seed") == seed) & (F.col("role") == "test"))
        for name in names:
            out = M.predict(M.fit(train.where(F.col("seed") == seed), FEATURES, "y", name, weight="weight"), out, FEATURES, f"p_{name}")
        return out.select("seed", F.col("y").alias("truth"), F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.col(f"p_{n}").alias("pred")) for n in names])).alias("_p")).select("seed", "truth", "_p.*")

    with ThreadPoolExecutor(2) as pool:
        parts = list(pool.map(scored, (1, 2)))
    found = reduce(DataFrame.unionByName, parts).groupBy("seed", "model").agg(*A.error_metrics())
    exact = lambda c, digits: F.when(F.col("model") == "linear", F.round(c, digits))
    return found.select("seed", "model", "n", exact("r2", 6).alias("r2"), exact("mae", 4).alias("mae"), (F.col("r2") > 0.5).alias("learned"))


BAG = "bag AS (SELECT m.g, f.*, CAST(concat('0x', substr(md5(concat('1-', m.g, ':', f.id)), 1, 8)) AS BIGINT) / 4294967296.0 AS u FROM features f, (VALUES (0), (1), (2)) m(g)), src AS (SELECT *, " + " + ".join(f"(u >= {sum(exp(-0.8) * 0.8**j / factorial(j) for j in range(i + 1))!r})::INTEGER" for i in range(8)) + " AS w FROM bag)"


@query("m14_bagged", "features", oracle=f"WITH {BAG}, {residuals('src', FEATURES)}, p AS (SELECT id, min(y) AS y, avg(y - r) AS mean, stddev_pop(y - r) AS sigma FROM res GROUP BY 1) SELECT count(*) AS n, round(1 - avg((y - mean) * (y - mean)) / var_pop(y), 6) AS r2, round(avg(sigma), 3) AS mean_sigma, round(max(sigma), 3) AS max_sigma FROM p")
def m14(f):
    d = materialise(f.withColumn("seed", F.lit(1)))
    bag = materialise(K.bagged(d, "id", 3))
    spread = M.ensemble_spread(M.bagged_models(bag, FEATURES, "y", "linear", 3), d, FEATURES, "mean", "sigma")
    e = F.col("y") - F.col("mean")
    return spread.agg(F.count("*").alias("n"), F.round(1 - F.avg(e * e) / F.var_pop("y"), 6).alias("r2"), F.round(F.avg("sigma"), 3).alias("mean_sigma"), F.round(F.max("sigma"), 3).alias("max_sigma"))


@query("m14_boosted_spread", "features")
def m14_boosted(f):
    """Boosted members on bagged rows: mean and spread of each row; tests hold both against the members one by one."""
    d = materialise(f.withColumn("seed", F.lit(1)))
    models = M.bagged_models(K.bagged(d, "id", 3), FEATURES, "y", "gbt", 3)
    return rounded(M.ensemble_spread(models, d, FEATURES).select("id", "pred", "sigma"), 3)


@query("m14_forest_spread", "features")
def m14_forest(f):
    """A forest's prediction and the spread of its trees for each row; tests hold both against the forest and a loop over trees."""
    return rounded(M.forest_spread(M.fit(f, FEATURES, "y", "rf"), f, FEATURES).select("id", "pred", "sigma"), 3)


@query("m15_mean_fusion", "features", oracle=f"WITH src AS (SELECT 0 AS g, 1 AS w, * FROM features), {residuals('src', FEATURES)} SELECT count(*) AS n, {R2}, true AS between FROM res")
def m15(f):
    """The mean of three learners' predictions lies between their least and largest; r2 is that of least squares."""
    d = materialise(f)
    out = d
    for name in ("rf", "gbt", "linear"):
        out = M.predict(M.fit(d, FEATURES, "y", name), out, FEATURES, f"p_{name}")
    each = ["p_rf", "p_gbt", "p_linear"]
    fused = M.mean_fusion(each)
    e = F.col("y") - F.col("p_linear")
    good = (fused >= F.least(*each) - 1e-6) & (fused <= F.greatest(*each) + 1e-6)
    x = F.avg((F.col("y") - fused) * (F.col("y") - fused)) <= F.greatest(*[F.avg((F.col("y") - F.col(c)) * (F.col("y") - F.col(c))) for c in each])
    return out.agg(F.count("*").alias("n"), F.round(1 - F.avg(e * e) / F.var_pop("y"), 6).alias("r2"), (F.bool_and(good) & x).alias("between"))


@query("m16_out_of_fold", "features", oracle=f"WITH {OTHER_FOLDS}, {residuals('src', FEATURES)} SELECT g AS fold, count(*) AS n, count(DISTINCT id) AS n_ids, {R2}, round(avg(abs(r)), 4) AS mae FROM res WHERE w = 0 GROUP BY 1")
def m16(f):
    d = materialise(_folds(f))
    p = M.out_of_fold(d, FEATURES, "y", "linear", 3, ["id", "y", "fold"])
    e = F.col("y") - F.col("pred")
    return p.groupBy("fold").agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_ids"), F.round(1 - F.avg(e * e) / F.var_pop("y"), 6).alias("r2"), F.round(F.avg(F.abs(e)), 4).alias("mae"))


@query("m17_rank_fusion", "scores", oracle="""
SELECT seed, id, (rank() OVER (PARTITION BY seed ORDER BY a) + (count(*) OVER (PARTITION BY seed, a) - 1) / 2.0 + rank() OVER (PARTITION BY seed ORDER BY b) + (count(*) OVER (PARTITION BY seed, b) - 1) / 2.0) / 2 AS fused FROM scores""")
def m17(s):
    return M.rank_fusion(s, ["seed"], ["a", "b"]).select("seed", "id", "fused")


@query("m18_fusion_weights", "scores", oracle="""
WITH r AS (SELECT seed, id, b, rank() OVER (PARTITION BY seed ORDER BY a) + (count(*) OVER (PARTITION BY seed, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY seed ORDER BY c) + (count(*) OVER (PARTITION BY seed, c) - 1) / 2.0 AS rc, rank() OVER (PARTITION BY seed ORDER BY b) + (count(*) OVER (PARTITION BY seed, b) - 1) / 2.0 AS rb FROM scores),
g AS (SELECT r.*, w, w * ra + (1 - w) * rc AS fused FROM r, (VALUES (0.0), (0.25), (0.5), (0.75), (1.0)) v(w)), f AS (SELECT seed, w, rb, rank() OVER (PARTITION BY seed, w ORDER BY fused) + (count(*) OVER (PARTITION BY seed, w, fused) - 1) / 2.0 AS rf FROM g),
s AS (SELECT seed, w, corr(rb, rf) AS sp FROM f GROUP BY 1, 2) SELECT seed, arg_min(w, (round(-sp + 0.05 * (w * w + (1 - w) * (1 - w)), 9), w))::DOUBLE AS weight_a FROM s GROUP BY 1""")
def m18(s):
    return M.fusion_weights(s, ["seed"], ["a", "c"], "b").select("seed", F.get("weights", 0).alias("weight_a"))


@query("m19_residual", "scores", oracle="""
WITH x AS (SELECT seed, a AS s, b - 1500 * a AS r FROM scores), m AS (SELECT seed, count(*) AS n, sum(s) AS sx, sum(r) AS sr, sum(s * r) AS sxr, sum(s * s) AS sxx FROM x GROUP BY 1)
SELECT seed, round((sxr - sx * sr / n) / (sxx - sx * sx / n + 100), 4) AS slope, round(sr / n - (sxr - sx * sr / n) / (sxx - sx * sx / n + 100) * sx / n, 2) AS intercept FROM m""")
def m19(s):
    out = M.residual_ridge(s.withColumn("base", 1500 * F.col("a")), ["seed"], "base", "a", "b")
    return out.select("seed", F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"))


@query("m20_rank_sum", "scores", oracle="""
WITH r AS (SELECT seed, id, rank() OVER (PARTITION BY seed ORDER BY a) + (count(*) OVER (PARTITION BY seed, a) - 1) / 2.0 + rank() OVER (PARTITION BY seed ORDER BY b) + (count(*) OVER (PARTITION BY seed, b) - 1) / 2.0 + rank() OVER (PARTITION BY seed ORDER BY c) + (count(*) OVER (PARTITION BY seed, c) - 1) / 2.0 AS total FROM scores), t AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY total, id) AS rank FROM r)
SELECT seed, id, total, rank::INTEGER AS rank FROM t WHERE rank <= 200""")
def m20(s):
    ranked = with_ranks(s, {"_a": "a", "_b": "b", "_c": "c"}, ["seed"])
    return top_k(ranked.select("seed", "id", F.expr("_a + _b + _c").alias("total")), 200, [F.col("total"), F.col("id")], ["seed"])


@query("m20_overlap", "pool", "labelled", oracle="SELECT count(*) AS n, count(DISTINCT pattern) AS n_distinct, count(DISTINCT pattern) FILTER (pattern IN (SELECT pattern FROM labelled)) AS n_shared FROM pool")
def m20_overlap(pool, labelled):
    """How far the candidates that are ranked overlap with the training rows."""
    return M.overlap(pool, labelled, "pattern")


BASE, BLOCK = ["f_tax", "f_line"], ["f_tax", "f_line", "f_quantity"]


@query("m21_block_gain", "features", oracle=f"WITH {SPLIT}, {residuals('src', BASE, 'ra')}, {residuals('src', BLOCK, 'rb')}, a AS (SELECT g, avg(abs(r)) AS v FROM ra WHERE w = 0 GROUP BY 1), b AS (SELECT g, avg(abs(r)) AS v FROM rb WHERE w = 0 GROUP BY 1) SELECT a.g AS seed, round(b.v - a.v, 4) AS delta FROM a JOIN b ON a.g = b.g")
def m21(f):
    d = K.train_test(K.with_seeds(materialise(f.select("id", *BLOCK, "y")), [1, 2]), "id", 0.3)
    train = materialise(M.merged(d.where("role = 'train'"), BLOCK, "y", keys=["seed"]))
    parts = []
    for seed in (1, 2):
        out = d.where((F.col("seed") == seed) & (F.col("role") == "test"))
        for name, cols in (("base", BASE), ("block", BLOCK)):
            out = M.predict(M.fit(train.where(F.col("seed") == seed), cols, "y", "linear", weight="weight"), out, cols, f"p_{name}")
        error = lambda name: F.struct(F.lit(name).alias("method"), F.abs(F.col("y") - F.col(f"p_{name}")).alias("e"))
        parts.append(out.select("seed", F.lit("linear").alias("model"), F.explode(F.array(error("base"), error("block"))).alias("_e")).select("seed", "model", "_e.*"))
    table = reduce(DataFrame.unionByName, parts).groupBy("seed", "method", "model").agg(F.avg("e").alias("value"))
    return A.paired_deltas(table, ["seed", "model"], "method", "base").select("seed", F.round("delta", 4).alias("delta"))


@query("m22_arms", "metrics", oracle="SELECT model, count(*) AS n, round(avg(a.value - n.value), 6) AS mean_delta FROM metrics a JOIN (SELECT seed AS s, model AS m, value FROM metrics WHERE method = 'N') n ON a.seed = n.s AND a.model = n.m WHERE a.method = 'R' GROUP BY model")
def m22(m):
    d = A.paired_deltas(m.where("method IN ('R', 'N')"), ["seed", "model"], "method", "N")
    return rounded(d.groupBy("model").agg(F.count("*").alias("n"), F.avg("delta").alias("mean_delta")))


@query("m23_forced_slots", "features", oracle=f"WITH {F_SCORES} SELECT unnest(['f_line', 'f_supplier']) AS feature UNION ALL (SELECT feature FROM fs WHERE feature NOT IN ('f_line', 'f_supplier') ORDER BY score DESC, feature LIMIT 1)")
def m23(f):
    return M.top_features(M.f_scores(f, FEATURES, "y"), 3, forced=["f_line", "f_supplier"]).select("feature")


@query("m24_presence", "selected", oracle="SELECT feature, count(DISTINCT seed) AS n_seeds FROM selected WHERE feature IN (2, 5) GROUP BY 1")
def m24(s):
    packed = s.groupBy("seed").agg(F.collect_set("feature").alias("features"))  # a seed's few features
    return packed.select("seed", F.explode("features").alias("feature")).where("feature IN (2, 5)").groupBy("feature").agg(F.countDistinct("seed").alias("n_seeds"))


GROUPED = "gs AS (SELECT f_supplier AS grp, count(*) AS size FROM features GROUP BY 1), gp AS (SELECT *, row_number() OVER (ORDER BY size DESC, grp) - 1 AS i FROM gs), gf AS (SELECT grp, CASE WHEN (i // 3) % 2 = 0 THEN i % 3 ELSE 2 - i % 3 END AS fold FROM gp), fo AS (SELECT f.*, gf.fold FROM features f JOIN gf ON f.f_supplier = gf.grp), src AS (SELECT k.g, (fold <> k.g)::INTEGER AS w, fo.* FROM fo, (VALUES (0), (1), (2)) k(g))"


@query("m25_group_folds", "features", oracle=f"WITH {GROUPED}, {residuals('src', FEATURES[:4])}, h AS (SELECT id, f_supplier FROM features) SELECT g AS fold, count(*) AS n, count(DISTINCT f_supplier) AS n_groups, {R2} FROM res JOIN h ON res.id = h.id WHERE w = 0 GROUP BY 1")
def m25(f):
    """Folds by supplier, which therefore is no feature."""
    d = f.withColumn("grp", F.col("f_supplier"))
    d = materialise(d.join(K.serpentine_folds(d, "grp", 3).select("grp", "fold"), "grp"))
    p = M.out_of_fold(d, FEATURES[:4], "y", "linear", 3, ["id", "y", "grp", "fold"])
    e = F.col("y") - F.col("pred")
    return p.groupBy("fold").agg(F.count("*").alias("n"), F.countDistinct("grp").alias("n_groups"), F.round(1 - F.avg(e * e) / F.var_pop("y"), 6).alias("r2"))


# sources and sinks: each writes rows of a given table and reads them again


def _place(df) -> str:
    return f"{shared_dir(df.sparkSession)}/io/{uuid.uuid4().hex}"


@query("s1_csv", "part", oracle="SELECT p_partkey, p_name, CAST(p_retailprice AS DOUBLE) AS p_retailprice FROM part")
def s1(p):
    at = _place(p)
    io.write_csv(p.select("p_partkey", "p_name", F.col("p_retailprice").cast("double")), at)
    return io.read_csv(p.sparkSession, at, "p_partkey long, p_name string, p_retailprice double")


@query("s2_many_files", "part", oracle="SELECT p_partkey, p_name FROM part")
def s2(p):
    at = _place(p)
    for i in (1, 2):
        io.write_csv(p.where(F.col("p_partkey") % 3 != i).select("p_partkey", "p_name"), f"{at}/batch_{i}")
    return io.read_many(p.sparkSession, f"{at}/batch_*", "p_partkey long, p_name string", ["p_partkey"], ["p_name"])


@query("s3_json_lines", "archive", oracle="SELECT search_id, call_no, pred FROM archive")
def s3(a):
    at = _place(a)
    rows = a.select("search_id", F.col("call_no").cast("long").alias("call_no"), "pred")
    for i in (0, 1):
        io.append_json(rows.where(F.col("call_no") % 2 == i), at)
    return io.read_json(a.sparkSession, at, "search_id long, call_no long, pred double")


@query("s4_nested_json", "runs", oracle="SELECT seed, strategy, round, best FROM runs")
def s4(r):
    at = _place(r)
    r.groupBy("seed").agg(F.collect_list(F.struct("seed", "strategy", "round", "best")).alias("rows")).write.json(at)
    return r.sparkSession.read.schema("rows array<struct<seed:long,strategy:string,round:int,best:double>>").json(at).select(F.explode("rows").alias("r")).select("r.*")


@query("s5_corpus", "benchmark", oracle="""
WITH u AS (SELECT item_id, replace(upper(replace(trim(text), 'ß', 'ss')), 'T', 'U') AS t FROM benchmark), t AS (SELECT * FROM u WHERE length(t) BETWEEN 1 AND 400), c AS (SELECT item_id, i, substr(t, i + 1, 1) AS c FROM t, range(0, 400) r(i) WHERE i < length(t))
SELECT item_id, string_agg(CASE WHEN c IN ('A', 'C', 'G', 'U') THEN c ELSE substr('ACGU', CAST(concat('0x', substr(md5(concat(item_id, ':', i, ':5')), 1, 2)) AS INTEGER) % 4 + 1, 1) END, '' ORDER BY i) AS sequence FROM c GROUP BY item_id""")
def s5(b):
    return io.load_corpus(b, "text", "item_id", 5, 400)


@query("s6_csv_append", "metrics", oracle="SELECT seed, method, model, value FROM metrics")
def s6(m):
    at = _place(m)
    for x in "ANR":
        io.write_csv(m.where(F.col("method") == x), at, "append")
    return io.read_csv(m.sparkSession, at, "seed long, method string, model string, value double")


@query("s7_publish", "runs", oracle="SELECT seed, strategy, round, best FROM runs WHERE seed % 2 = 0")
def s7(r):
    at = _place(r)
    io.publish(r, at, 1)
    io.publish(r.where("seed % 2 = 0"), at, 2)
    return io.read_published(r.sparkSession, at)


@query("s8_manifest", "part", oracle="SELECT count(*) > 0 AS found, true AS hashed FROM part")
def s8(p):
    at = _place(p)
    p.write.parquet(at)
    m = io.file_manifest(p.sparkSession, at, F.when(F.col("path").endswith(".parquet"), "table").otherwise("other"))
    return m.where("category = 'table'").agg((F.count("*") > 0).alias("found"), F.bool_and(F.length("sha256") == 64).alias("hashed"))


@query("s9_harvest", "runs", oracle="SELECT strategy, CAST(seed % 3 AS VARCHAR) AS run, count(*) AS n, round(min(best), 4) AS best FROM runs GROUP BY 1, 2")
def s9(r):
    at = _place(r)
    for k in range(3):
        r.where(F.col("seed") % 3 == k).select("strategy", "best").write.parquet(f"{at}/run_{k}/metrics")
    found = io.harvest(r.sparkSession, at, "strategy string, best double", r"/run_(\d+)/", ["run"])
    return rounded(found.groupBy("strategy", "run").agg(F.count("*").alias("n"), F.min("best").alias("best")), 4)


