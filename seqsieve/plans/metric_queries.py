"""Queries of contracts (P, A1-A2, A37), metrics (A), windows (W), set operations (O) and table joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from seqsieve.functions import sequence as S
from seqsieve.functions.constants import SITES, WILD_TYPE
from seqsieve.operators import contracts as C
from seqsieve.operators import metrics as M
from seqsieve.operators import ranking as R
from seqsieve.plans.materialise import materialise
from seqsieve.plans.registry import query


def rounded(df, digits: int = 6, keep=()):
    """Doubles to a fixed number of digits, so that the order of sums doesn't show."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


RANKS = """ranked AS (SELECT *, rank() OVER (PARTITION BY seed, model ORDER BY truth) + (count(*) OVER (PARTITION BY seed, model, truth) - 1) / 2.0 AS rt,
 rank() OVER (PARTITION BY seed, model ORDER BY pred) + (count(*) OVER (PARTITION BY seed, model, pred) - 1) / 2.0 AS rp FROM preds)"""

# contracts


@query("p3_allowed_columns", "lineitem", oracle="SELECT l_quantity, l_discount, l_extendedprice FROM lineitem")
def p3(li):
    names = C.allowed_columns([c for c in li.columns if c in ("l_quantity", "l_discount", "l_extendedprice", "l_orderkey")], required=["l_quantity"], forbidden=["label"], prefixes=["l_quant", "l_disc", "l_ext"])
    return li.select(*names)


BLOCKS = [("price", r"price$|discount$|tax$"), ("count", r"quantity$|number$"), ("date", r"date$"), ("key", r"key$")]


@query("p4_column_blocks", "lineitem", oracle="""
SELECT CASE WHEN regexp_matches(column_name, 'price$|discount$|tax$') THEN 'price' WHEN regexp_matches(column_name, 'quantity$|number$') THEN 'count' WHEN regexp_matches(column_name, 'date$') THEN 'date' WHEN regexp_matches(column_name, 'key$') THEN 'key' ELSE '_unassigned' END AS block,
 count(*) AS n_columns, sum(n_values)::BIGINT AS n_values
FROM (UNPIVOT (SELECT count(COLUMNS(*)) FROM lineitem) ON COLUMNS(*) INTO NAME column_name VALUE n_values) GROUP BY 1""")
def p4(li):
    block = C.column_blocks(li.columns, BLOCKS)
    counts = li.agg(*[F.count(c).alias(c) for c in li.columns])
    rows = counts.select(F.explode(F.array(*[F.struct(F.lit(block[c]).alias("block"), F.col(c).alias("n")) for c in li.columns])).alias("r")).select("r.*")
    return rows.groupBy("block").agg(F.count("*").alias("n_columns"), F.sum("n").alias("n_values"))


@query("p5_key_contract", "variants", oracle="SELECT count(*) AS n_rows, count(*) FILTER (sequence IS NULL) AS n_missing, count(sequence) - count(DISTINCT sequence) AS n_repeated FROM variants")
def p5(v):
    return C.key_contract(v, ["sequence"])


@query("p6_finite", "events_long", oracle="SELECT 'value' AS \"column\", count(*) FILTER (value IS NULL OR isnan(value) OR isinf(value)) AS n_bad FROM events_long UNION ALL SELECT 'user_id', count(*) FILTER (user_id IS NULL) FROM events_long")
def p6(e):
    return C.finite_contract(e.withColumn("user_id", F.col("user_id").cast("double")), ["value", "user_id"])


@query("p7_formula", "lineitem", oracle="""
WITH x AS (SELECT CAST(l_extendedprice AS DOUBLE) * (1 - CAST(l_discount AS DOUBLE)) AS a, CAST(l_extendedprice AS DOUBLE) * 0.96 AS b FROM lineitem)
SELECT bool_and(abs(a - b) <= 2000 + 1e-5 * abs(b)) AS agrees, round(max(abs(a - b)), 4) AS max_abs_diff, count(*) FILTER (abs(a - b) > 2000 + 1e-5 * abs(b)) AS n_off, round(min(a), 4) AS min_left, round(max(a), 4) AS max_left FROM x""")
def p7(li):
    price, discount = F.col("l_extendedprice").cast("double"), F.col("l_discount").cast("double")
    return rounded(C.formula_check(li, price * (1 - discount), price * 0.96, 2000.0), 4)


@query("p8_content_hash", "variants", oracle="""
SELECT count(*) AS n_rows, sum(CAST(concat('0x', substr(md5(concat_ws('|', 'v' || cand_id, 'v' || sequence)), 1, 8)) AS BIGINT))::BIGINT AS content FROM variants""")
def p8(v):
    return C.content_hash(v, ["cand_id", "sequence"])


@query("p9_set_digest", "variants", oracle="""
WITH d AS (SELECT DISTINCT sequence AS v FROM variants), b AS (SELECT substr(md5(v), 1, 3) AS b, sha256(string_agg(v, chr(10) ORDER BY v)) AS d FROM d GROUP BY 1)
SELECT sha256(string_agg(d, chr(10) ORDER BY b)) AS digest FROM b""")
def p9(v):
    return C.set_digest(v, "sequence")


@query("p11_classify", "manifest", oracle="""
SELECT CASE WHEN size_bytes < 100 THEN 'tiny' WHEN path LIKE 'src1%' AND lang = 'en' THEN 'main' WHEN lang <> 'en' THEN 'foreign' WHEN size_bytes > 5000 THEN 'large' ELSE 'other' END AS category, count(*) AS n FROM manifest GROUP BY 1""")
def p11(m):
    size, path, lang = F.col("size_bytes"), F.col("path"), F.col("lang")
    label = C.first_match([(size < 100, "tiny"), (path.startswith("src1") & (lang == "en"), "main"), (lang != "en", "foreign"), (size > 5000, "large")], "other")
    return m.select(label.alias("category")).groupBy("category").agg(F.count("*").alias("n"))


@query("p12_exportable", "archive", oracle="SELECT search_id, count(*) AS n FROM archive WHERE NOT (parent IS NULL AND pred > 10) GROUP BY search_id")
def p12(a):
    return a.where(~(F.col("parent").isNull() & (F.col("pred") > 10))).groupBy("search_id").agg(F.count("*").alias("n"))


@query("p13_filter_proposals", "pool", "labelled", oracle="""
WITH p AS (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY cand_id) AS seen FROM pool), known AS (SELECT DISTINCT pattern FROM labelled)
SELECT CASE WHEN p.cand_id % 11 = 0 THEN 'forbidden' WHEN k.pattern IS NOT NULL OR seen > 1 THEN 'duplicate' WHEN substr(p.pattern, 1, 1) = 'A' THEN 'constraint' ELSE 'kept' END AS reason, count(*) AS n
FROM p LEFT JOIN known k ON p.pattern = k.pattern GROUP BY 1""")
def p13(pool, labelled):
    first = pool.groupBy("pattern").agg(F.min("cand_id").alias("first_id"))  # a pattern may hold most rows, so its rows aren't brought together
    p = R.join_null_safe(pool, first, ["pattern"]).join(labelled.select("pattern").distinct().withColumn("known", F.lit(True)), "pattern", "left")
    reason = C.first_match([(F.col("cand_id") % 11 == 0, "forbidden"), (F.col("known").isNotNull() | (F.col("cand_id") > F.col("first_id")), "duplicate"), (F.col("pattern").startswith("A"), "constraint")], "kept")
    return p.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("p14_implausible", "events_long", oracle="SELECT count(*) FILTER (abs(value) > 50) AS n_implausible, round(var_pop(0.039 * value) / var_pop(0.039 * value + event_id % 10), 6) AS share FROM events_long")
def p14(e):
    term = F.col("value") * 0.039
    return rounded(e.agg(F.count_if(F.abs("value") > 50).alias("n_implausible"), (F.var_pop(term) / F.var_pop(term + F.col("event_id") % 10)).alias("share")))


@query("p15_run_acceptance", "runs", oracle="SELECT seed, CASE WHEN count(*) >= 21 THEN 'DONE' WHEN count(*) >= 18 THEN 'PARKED' ELSE 'FAILED' END AS status FROM runs GROUP BY seed")
def p15(r):
    n = F.count("*")
    return r.groupBy("seed").agg(C.first_match([(n >= 21, "DONE"), (n >= 18, "PARKED")], "FAILED").alias("status"))


# aggregates


@query("a1_profile", "part", oracle="""
SELECT 'p_retailprice' AS "column", count(*) AS n, count(*) - count(p_retailprice) AS missing, count(DISTINCT p_retailprice) AS n_distinct, min(p_retailprice)::DOUBLE AS low, max(p_retailprice)::DOUBLE AS high, round(avg(p_retailprice::DOUBLE), 4) AS mean, round(stddev_samp(p_retailprice::DOUBLE), 4) AS std FROM part
UNION ALL SELECT 'p_partkey', count(*), count(*) - count(p_partkey), count(DISTINCT p_partkey), min(p_partkey)::DOUBLE, max(p_partkey)::DOUBLE, round(avg(p_partkey), 4), round(stddev_samp(p_partkey), 4) FROM part
UNION ALL SELECT 'p_name', count(*), count(*) - count(p_name), count(DISTINCT p_name), min(length(p_name))::DOUBLE, max(length(p_name))::DOUBLE, round(avg(length(p_name)), 4), round(stddev_samp(length(p_name)), 4) FROM part""")
def a1(p):
    return rounded(C.profile(p, ["p_retailprice", "p_partkey"], ["p_name"]), 4)


@query("a2_duplicates", "patterned", oracle="SELECT count(*) AS n, count(DISTINCT sequence) AS n_sequences, count(DISTINCT pattern) AS n_patterns FROM patterned")
def a2(v):
    return v.agg(F.count("*").alias("n"), F.countDistinct("sequence").alias("n_sequences"), F.countDistinct("pattern").alias("n_patterns"))


@query("a3_distribution", "preds", oracle="""
SELECT seed, model, count(*) AS n, min(truth) AS low, round(quantile_cont(truth, 0.05), 7) AS p05, round(quantile_cont(truth, 0.5), 7) AS median, round(avg(truth), 7) AS mean, round(quantile_cont(truth, 0.95), 7) AS p95, max(truth) AS high FROM preds GROUP BY seed, model""")
def a3(p):
    return rounded(M.distribution(p, ["seed", "model"], "truth"), 7, keep=("low", "high"))


@query("a4_histogram", "patterned", oracle=f"SELECT ({' + '.join(f"CAST(substr(sequence, {p}, 1) <> '{WILD_TYPE[p - 1]}' AS INTEGER)" for p in SITES)}) AS n_changed, count(*) AS n FROM patterned GROUP BY 1")
def a4(v):
    return M.histogram(v.withColumn("n_changed", S.changed_count(F.col("sequence"))), "n_changed")


@query("a5_coverage", "patterned", oracle=" UNION ALL ".join(f"SELECT {p} AS site, count(*) FILTER (substr(sequence, {p}, 1) <> '{WILD_TYPE[p - 1]}') AS n FROM patterned" for p in SITES))
def a5(v):
    return S.site_coverage(v)


@query("a6_group_stats", "metrics", oracle="SELECT method, model, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, count(value) AS n FROM metrics GROUP BY method, model")
def a6(m):
    return rounded(m.groupBy("method", "model").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count("value").alias("n")))


@query("a7_pivot", "metrics", oracle="SELECT method, round(avg(value) FILTER (model = 'O'), 6) AS \"O\", round(avg(value) FILTER (model = 'F'), 6) AS \"F\" FROM metrics GROUP BY method")
def a7(m):
    return rounded(m.groupBy("method").pivot("model", ["O", "F"]).agg(F.avg("value")))


@query("a8_best_of_columns", "metrics", oracle="SELECT seed, greatest(max(value) FILTER (method = 'A'), max(value) FILTER (method = 'N'), max(value) FILTER (method = 'R')) AS best FROM metrics GROUP BY seed")
def a8(m):
    wide = m.groupBy("seed").pivot("method", ["A", "N", "R"]).agg(F.max("value"))
    return wide.select("seed", F.greatest("A", "N", "R").alias("best"))


@query("a9_errors", "preds", oracle="""
SELECT seed, model, count(*) AS n, round(corr(truth, pred), 6) AS pearson, round(1 - sum((truth - pred) * (truth - pred)) / (count(*) * var_pop(truth)), 6) AS r2, round(avg(abs(truth - pred)), 7) AS mae, round(sqrt(avg((truth - pred) * (truth - pred))), 7) AS rmse FROM preds GROUP BY seed, model""")
def a9(p):
    out = p.groupBy("seed", "model").agg(*M.error_metrics())
    return out.select("seed", "model", "n", F.round("pearson", 6).alias("pearson"), F.round("r2", 6).alias("r2"), F.round("mae", 7).alias("mae"), F.round("rmse", 7).alias("rmse"))  # seven digits, as means of prices meet exact ties at four


@query("a10_spearman", "preds", oracle=f"WITH {RANKS} SELECT seed, model, round(corr(rt, rp), 6) AS spearman FROM ranked GROUP BY seed, model")
def a10(p):
    return rounded(M.spearman(p, ["seed", "model"]))


@query("a11_kendall", "runs", oracle="""
WITH r AS (SELECT seed, strategy, round, floor(best / 20000) AS t, round % 4 AS p FROM runs),
pairs AS (SELECT a.seed, a.strategy, sign(a.t - b.t) * sign(a.p - b.p) AS s, (a.t <> b.t)::INT AS dt, (a.p <> b.p)::INT AS dp FROM r a JOIN r b ON a.seed = b.seed AND a.strategy = b.strategy AND a.round < b.round)
SELECT seed, strategy, round(CASE WHEN sum(dt) * sum(dp) > 0 THEN sum(s) / sqrt(sum(dt)::DOUBLE * sum(dp)) END, 6) AS kendall FROM pairs GROUP BY seed, strategy""")
def a11(r):
    rows = r.select("seed", "strategy", F.floor(F.col("best") / 20000).alias("truth"), (F.col("round") % 4).alias("pred"))
    return rounded(M.kendall(rows, ["seed", "strategy"]))


@query("a12_top_k_recall", "preds", oracle="""
WITH x AS (SELECT *, greatest(1, round_even(count(*) OVER (PARTITION BY seed, model) * 0.05, 0))::BIGINT AS k, row_number() OVER (PARTITION BY seed, model ORDER BY truth, id) AS t, row_number() OVER (PARTITION BY seed, model ORDER BY pred, id) AS p FROM preds)
SELECT seed, model, max(k) AS k, round(count(*) FILTER (t <= k AND p <= k) / max(k)::DOUBLE, 6) AS recall FROM x GROUP BY seed, model""")
def a12(p):
    return rounded(M.top_k_recall(p, ["seed", "model"], 0.05))


@query("a13_regret", "runs", oracle="""
SELECT seed, strategy, round, round(min(best) OVER (PARTITION BY seed, strategy ORDER BY round) - min(best) OVER (PARTITION BY seed), 4) AS regret FROM runs""")
def a13(r):
    upto = Window.partitionBy("seed", "strategy").orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    return rounded(r.select("seed", "strategy", "round", (F.min("best").over(upto) - F.min("best").over(Window.partitionBy("seed"))).alias("regret")), 4)


@query("a13_top5_median", "runs", oracle="""
WITH x AS (SELECT *, row_number() OVER (PARTITION BY seed, strategy ORDER BY best, round) AS rn FROM runs)
SELECT seed, strategy, round(median(best), 4) AS top5_median FROM x WHERE rn <= 5 GROUP BY seed, strategy""")
def a13b(r):
    best = R.top_k(r, 5, [F.col("best"), F.col("round")], ["seed", "strategy"])
    return rounded(best.groupBy("seed", "strategy").agg(F.percentile("best", 0.5).alias("top5_median")), 4)


@query("a14_best_of_top", "preds", oracle="WITH x AS (SELECT *, row_number() OVER (PARTITION BY seed, model ORDER BY pred, id) AS rn FROM preds) SELECT seed, model, min(truth) AS best FROM x WHERE rn <= 20 GROUP BY seed, model")
def a14(p):
    return R.top_k(p, 20, [F.col("pred"), F.col("id")], ["seed", "model"]).groupBy("seed", "model").agg(F.min("truth").alias("best"))


@query("a15_prefilter", "scores", oracle="""
WITH f AS (SELECT s.*, fr.fraction FROM scores s, (VALUES (0.25), (0.5), (0.75)) fr(fraction)),
k AS (SELECT *, row_number() OVER (PARTITION BY seed, fraction ORDER BY b, id) AS rb, count(*) OVER (PARTITION BY seed, fraction) AS n FROM f),
t AS (SELECT *, row_number() OVER (PARTITION BY seed, fraction ORDER BY a, id) AS ra FROM k WHERE rb <= round_even(n * fraction, 0))
SELECT seed, fraction::DOUBLE AS fraction, min(c) AS best_c, count(*) AS n_top FROM t WHERE ra <= 20 GROUP BY seed, fraction""")
def a15(sc):
    """Rows are numbered once a seed by a range shuffle, and meet the fractions only then; of each group 20 rows are ranked."""
    placed = R.numbered(sc.select("seed", "id", "a", "b", "c"), ["b", "id"], "rb", ["seed"], total="n")
    cut = placed.withColumn("fraction", F.explode(F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))))
    kept = cut.where(F.col("rb") <= F.bround(F.col("n") * F.col("fraction"), 0))
    top = R.top_k(kept, 20, [F.col("a"), F.col("id")], ["seed", "fraction"])
    return top.groupBy("seed", "fraction").agg(F.min("c").alias("best_c"), F.count("*").alias("n_top"))


@query("a16_deciles", "preds", oracle="""
WITH x AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY pred, id, model) AS rn, count(*) OVER (PARTITION BY seed) AS n FROM preds)
SELECT seed, floor((10 * rn - 1) / n::DOUBLE)::INTEGER AS decile, count(*) AS n, round(avg(abs(truth - pred)), 7) AS error FROM x GROUP BY 1, 2""")
def a16(p):
    keyed = p.withColumn("key", F.struct("id", "model"))
    return rounded(M.error_by_decile(keyed, ["seed"], "pred", F.abs(F.col("truth") - F.col("pred")), "key"), 7)


@query("a17_bootstrap", "metrics")
def a17(m):
    """Resampled: held against the mean and against normal intervals in tests."""
    return M.bootstrap_ci(m, ["method", "model"], "value", 10_000)


@query("a17_large_groups", "preds")
def a17_large(p):
    """Groups too large for one task: held against small groups' intervals and a loop in tests."""
    return M.bootstrap_ci(p.withColumn("error", F.abs(F.col("truth") - 1000 * F.col("pred"))), ["model"], "error", 2000)


DELTAS = "deltas AS (SELECT m.seed, m.method, m.model, m.value - c.value AS delta FROM metrics m JOIN metrics c ON m.seed = c.seed AND m.model = c.model AND c.method = 'N' WHERE m.method <> 'N')"


def _deltas(m):
    return M.paired_deltas(m, ["seed", "model"], "method", "N")


@query("j5_control_join", "metrics", oracle=f"WITH {DELTAS} SELECT seed, method, model, round(delta, 6) AS delta FROM deltas")
def j5(m):
    return rounded(_deltas(m).select("seed", "method", "model", "delta"))


@query("a18_paired_summary", "metrics", oracle=f"""
WITH {DELTAS} SELECT method, model, count(*) AS n, round(avg(delta), 6) AS mean_delta, round(quantile_cont(delta, 0.5), 6) AS median_delta, round(quantile_cont(delta, 0.25), 6) AS q25, round(quantile_cont(delta, 0.75), 6) AS q75,
 count(*) FILTER (delta < -1e-12) AS wins, count(*) FILTER (abs(delta) <= 1e-12) AS ties, count(*) FILTER (delta > 1e-12) AS losses FROM deltas GROUP BY method, model""")
def a18(m):
    return rounded(M.paired_summary(_deltas(m), ["method", "model"]))


@query("a18_intervals", "metrics")
def a18_intervals(m):
    """The summary with bootstrap intervals of the mean deltas: held against a loop in tests."""
    return M.paired_summary(_deltas(m), ["method", "model"], resamples=10_000, seed=1)


@query("a19_tails", "metrics", oracle=f"""
WITH {DELTAS}, x AS (SELECT *, greatest(1, round_even(count(*) OVER (PARTITION BY method, model) * 0.1, 0))::BIGINT AS k, row_number() OVER (PARTITION BY method, model ORDER BY delta, seed) AS up, row_number() OVER (PARTITION BY method, model ORDER BY delta DESC, seed DESC) AS down FROM deltas)
SELECT method, model, max(k) AS k, round(avg(delta) FILTER (up <= k), 6) AS best_mean, round(avg(delta) FILTER (down <= k), 6) AS worst_mean, round(sum(delta) FILTER (up <= k) / sum(delta), 3) AS best_share, round(sum(delta) FILTER (down <= k) / sum(delta), 3) AS worst_share FROM x GROUP BY method, model""")
def a19(m):
    out = M.tail_stats(_deltas(m), ["method", "model"], "seed")
    return out.select("method", "model", "k", F.round("best_mean", 6).alias("best_mean"), F.round("worst_mean", 6).alias("worst_mean"), F.round("best_share", 3).alias("best_share"), F.round("worst_share", 3).alias("worst_share"))


@query("a20_aligned", "archive", oracle="""
WITH g AS (SELECT *, search_id % 5 AS grp FROM archive), n AS (SELECT grp, search_id, max(call_no) AS c FROM g GROUP BY 1, 2), m AS (SELECT grp, min(c) AS common_calls FROM n GROUP BY 1)
SELECT g.grp, g.search_id, max(common_calls) AS common_calls, min(pred) AS best, arg_min(call_no, (pred, call_no)) AS best_call FROM g JOIN m ON g.grp = m.grp WHERE call_no <= common_calls GROUP BY g.grp, g.search_id""")
def a20(a):
    return M.aligned_best(a.withColumn("grp", F.col("search_id") % 5), ["grp"], "search_id", "call_no", "pred")


@query("a20_starts", "archive", oracle="""
WITH g AS (SELECT *, search_id % 5 AS grp, id % 3 AS key, CASE WHEN search_id % 5 < 3 THEN 1 ELSE search_id % 2 END AS model FROM archive), z AS (SELECT grp, count(DISTINCT search_id) AS n_searches, count(DISTINCT model) AS n_models FROM g GROUP BY 1),
s AS (SELECT grp, call_no, key, count(DISTINCT search_id) AS c FROM g WHERE call_no <= 3 GROUP BY 1, 2, 3) SELECT z.grp, n_searches, count(*) FILTER (c < n_searches) AS n_unshared, n_models FROM z JOIN s ON z.grp = s.grp GROUP BY z.grp, n_searches, n_models HAVING count(*) FILTER (c < n_searches) > 0 OR n_models <> 1""")
def a20_starts(a):
    """Groups whose searches start from other rows or used other models; the first three calls count as starts."""
    model = F.when(F.col("search_id") % 5 < 3, 1).otherwise(F.col("search_id") % 2)
    d = a.withColumns({"grp": F.col("search_id") % 5, "key": F.col("id") % 3, "model": model})
    return M.unequal_starts(d, ["grp"], "search_id", "call_no", "key", "model", F.col("call_no") <= 3)


@query("a21_diversity", "patterned", oracle="""
WITH t AS (SELECT *, cand_id % 4 AS grp, row_number() OVER (PARTITION BY cand_id % 4 ORDER BY y, cand_id) AS rn FROM patterned), top AS (SELECT * FROM t WHERE rn <= 50)
SELECT a.grp, round(sum(hamming(a.pattern, b.pattern)) / (50 * 49)::DOUBLE, 6) AS diversity FROM top a JOIN top b ON a.grp = b.grp AND a.cand_id <> b.cand_id GROUP BY a.grp""")
def a21(v):
    top = R.top_k(v.withColumn("grp", F.col("cand_id") % 4), 50, [F.col("y"), F.col("cand_id")], ["grp"])
    return rounded(M.diversity(top, ["grp"], "pattern", 13))


@query("a22_jaccard", "selected", oracle="""
WITH f AS (SELECT seed, feature, max((method = 'A')::INT) AS l, max((method = 'R')::INT) AS r FROM selected WHERE method IN ('A', 'R') GROUP BY 1, 2)
SELECT seed, round(sum(l * r) / count(*)::DOUBLE, 6) AS jaccard FROM f GROUP BY seed""")
def a22(s):
    return rounded(M.jaccard(s, ["seed"], "method", "A", "R", "feature"))


@query("a23_completeness", "metrics", oracle="""
WITH o AS (SELECT * FROM metrics WHERE NOT (seed % 13 = 0 AND method = 'A')), e AS (SELECT * FROM (SELECT DISTINCT seed FROM o) a, (VALUES ('A'), ('N'), ('X')) b(method), (VALUES ('O'), ('F')) c(model)),
n AS (SELECT seed, method, model, count(*) AS n FROM o GROUP BY 1, 2, 3)
SELECT e.seed, e.method, e.model, 'missing' AS problem, 0 AS n FROM e ANTI JOIN n USING (seed, method, model)
UNION ALL SELECT n.seed, n.method, n.model, 'extra', n.n FROM n ANTI JOIN e USING (seed, method, model)
UNION ALL SELECT seed, method, model, 'repeated', n FROM n WHERE n > 1""")
def a23(m):
    seen = m.where(~((F.col("seed") % 13 == 0) & (F.col("method") == "A")))
    one = lambda name, values: m.sparkSession.createDataFrame([(v,) for v in values], f"{name} string")
    return M.completeness(seen, [seen.select("seed").distinct(), one("method", "ANX"), one("model", "OF")], ["seed", "method", "model"])


GAPS = ["sequence", "measured", "status", "protocol_id", "note"]


@query("a23_gaps", "returns", oracle="WITH r AS (SELECT *, CAST(NULL AS VARCHAR) AS note FROM returns), l AS (" + " UNION ALL ".join(f"SELECT batch_id, '{c}' AS column_name, count(*) AS n, count(*) - count({c}) AS n_missing FROM r GROUP BY 1" for c in GAPS) + """), w AS (SELECT column_name, sum(n) = sum(n_missing) AS all_missing FROM l GROUP BY 1)
SELECT l.batch_id, l.column_name, l.n, l.n_missing, w.all_missing FROM l JOIN w ON l.column_name = w.column_name WHERE n_missing > 0""")
def a23_gaps(r):
    """A column that nobody fills stands beside those with gaps."""
    return M.column_gaps(r.withColumn("note", F.lit(None).cast("string")), ["batch_id"], GAPS)


@query("a24_stability", "selected", oracle="WITH s AS (SELECT count(DISTINCT seed) AS n FROM selected) SELECT method, feature, round(count(DISTINCT seed) / max(n)::DOUBLE, 6) AS frequency, count(DISTINCT seed) / max(n)::DOUBLE >= 0.5 AS stable FROM selected, s GROUP BY method, feature")
def a24(s):
    seeds = s.agg(F.countDistinct("seed").alias("n"))
    share = F.countDistinct("seed") / F.max("n")
    return s.join(F.broadcast(seeds)).groupBy("method", "feature").agg(F.round(share, 6).alias("frequency"), (share >= 0.5).alias("stable"))


@query("a27_duplicate_groups", "manifest", oracle="SELECT digest, size_bytes, count(*) AS copies, (sum(size_bytes) - max(size_bytes))::BIGINT AS reclaimable, string_agg(path, '|' ORDER BY path) AS paths FROM manifest GROUP BY digest, size_bytes HAVING count(*) > 1")
def a27(m):
    return m.groupBy("digest", "size_bytes").agg(F.count("*").alias("copies"), (F.sum("size_bytes") - F.max("size_bytes")).alias("reclaimable"), F.array_join(F.array_sort(F.collect_list("path")), "|").alias("paths")).where("copies > 1")


KEEP = "CASE WHEN lang = 'en' THEN 0 ELSE 1 END"


@query("a28_keep_one", "manifest", oracle=f"""
WITH r AS (SELECT *, count(*) OVER (PARTITION BY digest) AS copies, row_number() OVER (PARTITION BY digest ORDER BY {KEEP}, length(path), path) AS rn, first_value(path) OVER (PARTITION BY digest ORDER BY {KEEP}, length(path), path) AS kept FROM manifest)
SELECT path, kept, CASE WHEN rn = 1 THEN 'keep' ELSE 'move' END AS action FROM r WHERE copies > 1""")
def a28(m):
    best = F.min_by("path", F.struct(F.expr(KEEP), F.length("path"), "path"))
    groups = m.groupBy("digest").agg(F.count("*").alias("copies"), best.alias("kept")).where("copies > 1")
    return R.join_null_safe(m, groups, ["digest"]).select("path", "kept", F.when(F.col("path") == F.col("kept"), "keep").otherwise("move").alias("action"))


@query("a29_categories", "manifest", oracle="SELECT root_name, count(*) AS n, sum(size_bytes)::BIGINT AS n_bytes FROM manifest GROUP BY root_name")
def a29(m):
    return m.groupBy("root_name").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("n_bytes"))


@query("a30_status_counts", "orders", oracle="SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def a30(o):
    return o.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("a31_replica_agreement", "measurements", oracle="""
WITH p AS (SELECT a.key_id, a.value AS x, b.value AS y FROM measurements a JOIN measurements b ON a.key_id = b.key_id AND a.replica_id = 1 AND b.replica_id = 2),
r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM p)
SELECT count(*) AS n, round(corr(rx, ry), 6) AS spearman FROM r""")
def a31(m):
    pair = m.where("replica_id = 1").select("key_id", F.col("value").alias("x")).join(m.where("replica_id = 2").select("key_id", F.col("value").alias("y")), "key_id")
    ranked = R.average_ranks(R.average_ranks(pair, "x", name="rx"), "y", name="ry")
    return rounded(ranked.agg(F.count("*").alias("n"), M.correlation("rx", "ry").alias("spearman")))


@query("a32_running_mean", "measurements", oracle="""
WITH old AS (SELECT key_id, count(*) AS c, avg(value) AS m FROM measurements WHERE replica_id <= 3 GROUP BY 1), new AS (SELECT key_id, count(*) AS k, sum(value) AS s FROM measurements WHERE replica_id > 3 GROUP BY 1)
SELECT old.key_id, c + coalesce(k, 0) AS n, round((c * m + coalesce(s, 0)) / (c + coalesce(k, 0)), 4) AS mean FROM old LEFT JOIN new ON old.key_id = new.key_id""")
def a32(m):
    return rounded(m.groupBy("key_id").agg(F.count("*").alias("n"), (F.sum("value") / F.count("*")).alias("mean")), 4)


@query("a33_ensemble", "ensemble", oracle="""
SELECT id, round(avg(pred), 4) AS mean, round(stddev_pop(pred), 4) AS spread_0, round(stddev_samp(pred), 4) AS spread_1, round(quantile_cont(pred, 0.1), 4) AS low, round(quantile_cont(pred, 0.9), 4) AS high FROM ensemble GROUP BY id""")
def a33(e):
    cut = F.percentile("pred", F.array(F.lit(0.1), F.lit(0.9)))
    return rounded(e.groupBy("id").agg(F.avg("pred").alias("mean"), F.stddev_pop("pred").alias("spread_0"), F.stddev_samp("pred").alias("spread_1"), F.get(cut, 0).alias("low"), F.get(cut, 1).alias("high")), 4)


@query("a35_disagreement", "preds", oracle=f"""
WITH {RANKS}, g AS (SELECT *, abs(rt - rp) / count(*) OVER (PARTITION BY seed, model) AS gap FROM ranked), c AS (SELECT seed, model, quantile_cont(gap, 0.85) AS cut FROM g GROUP BY 1, 2)
SELECT g.seed, g.model, count(*) AS n, round(corr(rt, rp), 6) AS pearson_of_ranks FROM g JOIN c ON g.seed = c.seed AND g.model = c.model WHERE gap <= cut + 1e-12 GROUP BY 1, 2""")
def a35(p):
    keys = ["seed", "model"]
    ranked = R.with_ranks(p, {"rt": "truth", "rp": "pred"}, keys, total="n")
    g = materialise(ranked.select(*keys, "rt", "rp", (F.abs(F.col("rt") - F.col("rp")) / F.col("n")).alias("gap")))
    return rounded(g.join(R.quantiles(g, "gap", {"cut": 0.85}, keys), keys).where("gap <= cut + 1e-12").groupBy(*keys).agg(F.count("*").alias("n"), M.correlation("rt", "rp").alias("pearson_of_ranks")))


@query("a36_gates", "metrics", oracle=f"WITH {DELTAS} SELECT method, model, avg(delta) >= -0.01 AS holds, avg(delta) + 2 * stddev_samp(delta) / sqrt(count(*)) < 0 AS better FROM deltas GROUP BY method, model")
def a36(m):
    mean = F.avg("delta")
    return _deltas(m).groupBy("method", "model").agg((mean >= -0.01).alias("holds"), (mean + 2 * F.stddev_samp("delta") / F.sqrt(F.count("*")) < 0).alias("better"))


@query("a36_interval_gates", "metrics")
def a36_intervals(m):
    """Gates by the bootstrap intervals of A18."""
    summary = M.paired_summary(_deltas(m), ["method", "model"], resamples=10_000, seed=1)
    return M.gates(summary, 0.01, 0.1).select("method", "model", "n", "better", "worse", "holds", "quiet")


@query("a37_partition", "labelled", "pool", "patterned", oracle="""
WITH parts AS (SELECT cand_id, 'labelled' AS split FROM labelled UNION ALL SELECT cand_id, 'pool' FROM pool), n AS (SELECT cand_id, count(DISTINCT split) AS splits FROM parts GROUP BY 1)
SELECT count(*) FILTER (n.splits > 1) AS n_overlapping, count(*) FILTER (n.cand_id IS NULL) AS n_uncovered, count(*) FILTER (p.cand_id IS NULL) AS n_foreign FROM n FULL JOIN (SELECT DISTINCT cand_id FROM patterned) p ON n.cand_id = p.cand_id""")
def a37(a, b, full):
    parts = a.select("cand_id", F.lit("labelled").alias("split")).unionByName(b.select("cand_id", F.lit("pool").alias("split")))
    return C.partition_check(parts, full, "cand_id", "split")


@query("a38_top_metric", "preds", oracle="""
WITH t AS (SELECT *, row_number() OVER (PARTITION BY seed, model ORDER BY truth, id) AS rn FROM preds), s AS (SELECT * FROM t WHERE rn <= 100),
r AS (SELECT seed, model, rank() OVER (PARTITION BY seed, model ORDER BY truth) + (count(*) OVER (PARTITION BY seed, model, truth) - 1) / 2.0 AS rt, rank() OVER (PARTITION BY seed, model ORDER BY pred) + (count(*) OVER (PARTITION BY seed, model, pred) - 1) / 2.0 AS rp FROM s)
SELECT seed, model, round(corr(rt, rp), 6) AS spearman FROM r GROUP BY 1, 2""")
def a38(p):
    return rounded(M.spearman(R.top_k(p, 100, [F.col("truth"), F.col("id")], ["seed", "model"]), ["seed", "model"]))


@query("a39_cohorts", "metrics", oracle="""
WITH c AS (SELECT *, CASE WHEN seed % 2 = 0 THEN 'even' ELSE 'odd' END AS cohort FROM metrics), k AS (SELECT seed, count(DISTINCT cohort) AS cohorts, count(*) AS n FROM c GROUP BY 1)
SELECT cohorts, n, count(*) AS n_seeds FROM k GROUP BY 1, 2""")
def a39(m):
    even, odd = m.where("seed % 2 = 0").withColumn("cohort", F.lit("even")), m.where("seed % 2 <> 0").withColumn("cohort", F.lit("odd"))
    both = even.unionByName(odd)
    return both.groupBy("seed").agg(F.countDistinct("cohort").alias("cohorts"), F.count("*").alias("n")).groupBy("cohorts", "n").agg(F.count("*").alias("n_seeds"))


# windows, ranks, set operations


@query("w1_average_rank", "preds", oracle=f"WITH {RANKS} SELECT seed, model, id, rp AS rank FROM ranked")
def w1(p):
    return R.average_ranks(p, "pred", ["seed", "model"]).select("seed", "model", "id", "rank")


@query("w1_rank_of_table", "scores", oracle="SELECT seed, id, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rank FROM scores")
def w1b(s):
    return R.average_ranks(s, "b").select("seed", "id", "rank")


@query("w2_rank_normal", "preds", oracle=f"WITH {RANKS} SELECT seed, model, count(*) AS n, round(min((rp - 0.5) / n2), 6) AS low_p, round(sum(CASE WHEN (rp - 0.5) / n2 < 0.5 THEN 1 ELSE 0 END), 0)::BIGINT AS n_negative FROM (SELECT *, count(*) OVER (PARTITION BY seed, model) AS n2 FROM ranked) GROUP BY seed, model")
def w2(p):
    keys = ["seed", "model"]
    ranked = R.average_ranks(p, "pred", keys, total="_n")
    z = ranked.withColumn("p", (F.col("rank") - 0.5) / F.col("_n")).withColumn("z", R.inverse_normal(F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), F.col("p")))))
    return z.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.min("p"), 6).alias("low_p"), F.sum((F.col("z") < -1e-9).cast("int")).alias("n_negative"))


@query("w3_relevance", "preds", oracle=f"WITH {RANKS} SELECT seed, model, id, floor(rt * 30 / count(*) OVER (PARTITION BY seed, model))::BIGINT AS grade FROM ranked")
def w3(p):
    keys = ["seed", "model"]
    return R.average_ranks(p, "truth", keys, total="_n").select(*keys, "id", F.floor(F.col("rank") * 30 / F.col("_n")).alias("grade"))


@query("w4_top_k", "preds", oracle="SELECT seed, model, id, pred, row_number() OVER (ORDER BY pred DESC, id, model, seed) AS rank FROM preds ORDER BY pred DESC, id, model, seed LIMIT 50")
def w4(p):
    return R.top_k(p.select("seed", "model", "id", "pred"), 50, [F.desc("pred"), F.col("id"), F.col("model"), F.col("seed")])


@query("w4_top_k_grouped", "preds", oracle="SELECT seed, model, id FROM (SELECT *, row_number() OVER (PARTITION BY seed, model ORDER BY pred DESC, id) AS rn FROM preds) WHERE rn <= 10")
def w4b(p):
    return R.top_k(p, 10, [F.desc("pred"), F.col("id")], ["seed", "model"]).select("seed", "model", "id")


@query("w5_arg_best", "preds", oracle="SELECT seed, model, arg_min(id, (pred, id)) AS id FROM preds GROUP BY seed, model")
def w5(p):
    return p.groupBy("seed", "model").agg(F.min(F.struct("pred", "id"))["id"].alias("id"))


@query("w6_running", "archive", oracle="SELECT search_id, call_no, min(pred) OVER (PARTITION BY search_id ORDER BY call_no) AS best, count(*) OVER (PARTITION BY search_id ORDER BY call_no) AS n FROM archive")
def w6(a):
    upto = Window.partitionBy("search_id").orderBy("call_no").rowsBetween(Window.unboundedPreceding, 0)
    return a.select("search_id", "call_no", F.min("pred").over(upto).alias("best"), F.count("*").over(upto).alias("n"))


@query("w7_value_bins", "scores", oracle="""
WITH q AS (SELECT seed, unnest([quantile_cont(a, 0.1), quantile_cont(a, 0.2), quantile_cont(a, 0.3), quantile_cont(a, 0.4), quantile_cont(a, 0.5), quantile_cont(a, 0.6), quantile_cont(a, 0.7), quantile_cont(a, 0.8), quantile_cont(a, 0.9)]) AS v, min(a) AS low, max(a) AS high FROM scores GROUP BY seed),
e AS (SELECT DISTINCT seed, v FROM q WHERE v > low AND v < high),
x AS (SELECT s.seed, s.id, count(e.v) AS bin FROM scores s LEFT JOIN e ON s.seed = e.seed AND e.v < s.a GROUP BY 1, 2) SELECT seed, bin, count(*) AS n FROM x GROUP BY 1, 2""")
def w7(s):
    cuts = R.quantiles(s, "a", {f"q{q}": q / 10 for q in range(11)}, ["seed"])
    return s.join(cuts.select("seed", F.array(*[f"q{q}" for q in range(11)]).alias("edges")), "seed").groupBy("seed", R.quantile_bin(F.col("a"), F.col("edges")).alias("bin")).agg(F.count("*").alias("n"))


@query("w8_tertiles", "runs", oracle="""
WITH c AS (SELECT quantile_cont(best, 1 / 3.0::DOUBLE) AS a, quantile_cont(best, 2 / 3.0::DOUBLE) AS b FROM runs) SELECT CASE WHEN best <= a THEN 0 WHEN best <= b THEN 1 ELSE 2 END AS stratum, count(*) AS n FROM runs, c GROUP BY 1""")
def w8(r):
    cut = R.quantiles(r, "best", {"low": 1 / 3, "high": 2 / 3})
    label = F.when(F.col("best") <= F.col("low"), 0).when(F.col("best") <= F.col("high"), 1).otherwise(2)
    return r.join(F.broadcast(cut)).groupBy(label.alias("stratum")).agg(F.count("*").alias("n"))


@query("w9_sort", "metrics", oracle="SELECT seed, method, model, value FROM metrics ORDER BY method, value DESC, seed, model")
def w9(m):
    return m.select("seed", "method", "model", "value").orderBy("method", F.desc("value"), "seed", "model")


@query("w10_first_seen", "variants", oracle="SELECT min(cand_id) AS cand_id, sequence FROM variants GROUP BY sequence")
def w10(v):
    return v.groupBy("sequence").agg(F.min("cand_id").alias("cand_id")).select("cand_id", "sequence")


@query("o1_union", "labelled", "pool", oracle="SELECT cand_id, pattern FROM patterned")
def o1(a, b):
    return a.unionByName(b).select("cand_id", "pattern")


@query("o2_intersect", "labelled", "pool", oracle="SELECT pattern FROM labelled INTERSECT SELECT pattern FROM pool")
def o2(a, b):
    return a.select("pattern").intersect(b.select("pattern"))


@query("o2_in_many_batches", "batches", oracle="SELECT candidate_id, count(DISTINCT batch_id) AS n FROM batches GROUP BY 1 HAVING count(DISTINCT batch_id) > 1")
def o2b(b):
    return b.groupBy("candidate_id").agg(F.countDistinct("batch_id").alias("n")).where("n > 1")


@query("o3_difference", "labelled", "pool", oracle="SELECT pattern FROM labelled EXCEPT SELECT pattern FROM pool")
def o3(a, b):
    return a.select("pattern").subtract(b.select("pattern"))


@query("o4_known_set", "labelled", "batches", "pool", oracle="SELECT sequence FROM labelled UNION SELECT sequence FROM batches UNION SELECT sequence FROM pool WHERE cand_id % 9 = 0")
def o4(a, b, c):
    return a.select("sequence").unionByName(b.select("sequence")).unionByName(c.where("cand_id % 9 = 0").select("sequence")).distinct()


# joins


@query("j1_feature_join", "variants", "part", oracle="SELECT v.cand_id, v.sequence, p.p_size FROM variants v JOIN part p ON v.cand_id = p.p_partkey")
def j1(v, p):
    return v.select("cand_id", "sequence").join(p.select(F.col("p_partkey").alias("cand_id"), "p_size"), "cand_id")


@query("j2_coverage", "labelled", "pool", oracle="""
WITH l AS (SELECT DISTINCT pattern FROM labelled), p AS (SELECT DISTINCT pattern FROM pool)
SELECT (SELECT count(*) FROM l SEMI JOIN p USING (pattern)) AS n_both, (SELECT count(*) FROM l ANTI JOIN p USING (pattern)) AS n_missing, (SELECT count(*) FROM p ANTI JOIN l USING (pattern)) AS n_extra""")
def j2(a, b):
    return C.coverage(a, b, "pattern")


@query("j3_membership", "pool", "labelled", oracle="SELECT cand_id FROM pool WHERE pattern IN (SELECT pattern FROM labelled)")
def j3(p, known):
    return p.join(known.select("pattern"), "pattern", "left_semi").select("cand_id")


@query("j4_anti", "pool", "labelled", oracle="SELECT cand_id FROM pool WHERE pattern NOT IN (SELECT pattern FROM labelled)")
def j4(p, known):
    return p.join(known.select("pattern"), "pattern", "left_anti").select("cand_id")


@query("j6_reconcile", "metrics", oracle="""
WITH a AS (SELECT * FROM metrics WHERE seed % 5 > 0), b AS (SELECT seed, method, model, value + 0.001 * (seed % 3) AS value FROM metrics WHERE seed % 7 > 0)
SELECT count(*) FILTER (a.seed IS NOT NULL AND b.seed IS NOT NULL) AS n_both, round(max(abs(a.value - b.value)), 6) AS max_abs_diff, count(*) FILTER (b.seed IS NULL) AS n_left_only, count(*) FILTER (a.seed IS NULL) AS n_right_only
FROM a FULL JOIN b ON a.seed = b.seed AND a.method = b.method AND a.model = b.model""")
def j6(m):
    b = m.where("seed % 7 > 0").withColumn("value", F.col("value") + 0.001 * (F.col("seed") % 3))
    return rounded(C.reconcile(m.where("seed % 5 > 0"), b, ["seed", "method", "model"], "value"))


@query("j7_lineage", "archive", oracle="""
WITH x AS (SELECT a.search_id, a.parent, p.id AS pid, a.call_no, p.call_no AS pcall FROM archive a LEFT JOIN archive p ON a.search_id = p.search_id AND a.parent = p.id AND p.call_no % 10 > 0)
SELECT search_id, count(*) FILTER (parent IS NULL) AS n_roots, count(*) FILTER (parent IS NOT NULL AND pid IS NULL) AS n_orphans, count(*) FILTER (pcall >= call_no) AS n_early FROM x GROUP BY search_id""")
def j7(a):
    parents = a.where("call_no % 10 > 0").select("search_id", F.col("id").alias("parent"), F.col("call_no").alias("parent_call"))
    x = a.join(parents, ["search_id", "parent"], "left")
    return x.groupBy("search_id").agg(F.count_if(F.col("parent").isNull()).alias("n_roots"), F.count_if(F.col("parent").isNotNull() & F.col("parent_call").isNull()).alias("n_orphans"), F.count_if(F.col("parent_call") >= F.col("call_no")).alias("n_early"))


@query("j8_differences", "batches", oracle="""
WITH a AS (SELECT batch_id, candidate_id FROM batches), b AS (SELECT batch_id, candidate_id FROM batches WHERE batch_id <> 'b3')
SELECT 'left' AS side, * FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'right', * FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def j8(b):
    two = b.select("batch_id", "candidate_id")
    return C.differences(two, two.where("batch_id <> 'b3'"))


@query("j14_expected_keys", "metrics", oracle="SELECT s.seed, m.method FROM (SELECT DISTINCT seed FROM metrics) s, (SELECT DISTINCT method FROM metrics) m")
def j14(m):
    return m.select("seed").distinct().crossJoin(m.select("method").distinct())
