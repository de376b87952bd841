"""Queries of batch selection (B) and of the label hand-off (L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqsieve.functions import sequence as S
from seqsieve.operators import ledger as L
from seqsieve.operators import metrics as M
from seqsieve.operators import selection as B

from seqsieve.plans.materialise import materialise, shared_dir
from seqsieve.plans.metric_queries import rounded
from seqsieve.plans.registry import QUERIES, query
from seqsieve.sources.views import view


@query("b1_random", "pool", oracle="SELECT cand_id, row_number() OVER (ORDER BY md5(concat('5:', cand_id)), cand_id)::INTEGER AS pick FROM pool ORDER BY pick LIMIT 50")
def b1(p):
    return B.random_batch(p, 50, 5).select("cand_id", "pick")


@query("b2_greedy", "pool", oracle="SELECT cand_id, row_number() OVER (ORDER BY y, cand_id)::INTEGER AS pick FROM pool ORDER BY pick LIMIT 50")
def b2(p):
    return B.greedy_batch(p, 50, "y").select("cand_id", "pick")


@query("b2_greedy_maximise", "pool", oracle="SELECT cand_id, row_number() OVER (ORDER BY y DESC, cand_id)::INTEGER AS pick FROM pool ORDER BY pick LIMIT 50")
def b2b(p):
    return B.greedy_batch(p, 50, "y", maximise=True).select("cand_id", "pick")


def _farthest_sql(rows: str, budget: int, order: str) -> str:
    """Farthest-first in a recursive query: the state is the list of picks."""
    return f"""
WITH RECURSIVE rows_ AS ({rows}), base AS (SELECT r.cand_id, r.pattern, r.y, min(hamming(r.pattern, l.pattern)) AS d FROM rows_ r, (SELECT DISTINCT pattern FROM labelled) l GROUP BY 1, 2, 3),
step(i, ids, pats) AS (SELECT 0, []::BIGINT[], []::VARCHAR[] UNION ALL
 SELECT i + 1, list_append(ids, (b.p).cand_id), list_append(pats, (b.p).pattern) FROM step, LATERAL (SELECT first({{'cand_id': cand_id, 'pattern': pattern}} ORDER BY least(d, coalesce(list_min([hamming(pattern, q) FOR q IN pats]), 100)) DESC, {order}) AS p FROM base WHERE NOT list_contains(ids, cand_id)) b WHERE i < {budget})
SELECT unnest(ids) AS cand_id, unnest(range(1, {budget + 1}))::INTEGER AS pick FROM step WHERE i = {budget}"""


@query("b3_greedy_diverse", "pool", "labelled", oracle=_farthest_sql("SELECT * FROM (SELECT * FROM pool ORDER BY y, cand_id LIMIT 50) q", 10, "y, cand_id"))
def b3(p, known):
    return B.greedy_diverse(p, known, 10, "y").select("cand_id", "pick")


@query("b4_coverage", "pool", "labelled", oracle=_farthest_sql("SELECT * FROM pool", 10, "cand_id"))
def b4(p, known):
    return B.farthest_first(p, known, 10, []).select("cand_id", "pick")


SIGMA = "CAST(concat('0x', substr(md5(concat('s', cand_id)), 1, 6)) AS BIGINT)"


def _sigma(p):
    return p.withColumn("sigma", F.conv(F.substring(F.md5(F.concat(F.lit("s"), F.col("cand_id").cast("string")).cast("binary")), 1, 6), 16, 10).cast("long"))


@query("b5_mixed", "pool", "labelled")
def b5(p, known):
    """Sequential roles; tests hold the quotas, the roles' rules and disjointness."""
    return B.mixed_batch(_sigma(p), known, 20, {"uncertainty": 0.45, "coverage": 0.25, "promising": 0.2, "random": 0.1}, "y", "sigma", 3).select("cand_id", "role", "pick")


@query("b6_space_batch", "scores", oracle="""
WITH l AS (SELECT * FROM scores WHERE seed <> 1), p AS (SELECT * FROM scores WHERE seed = 1), u AS (SELECT a, c FROM l UNION ALL SELECT a, c FROM p),
m AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(c) AS mc, stddev_pop(c) AS sc FROM u),
d AS (SELECT p.id, round(min(sqrt(((p.a - l.a) / sa) * ((p.a - l.a) / sa) + ((p.c - l.c) / sc) * ((p.c - l.c) / sc))), 6) AS novelty FROM p, l, m GROUP BY p.id)
SELECT id, novelty FROM d ORDER BY novelty DESC, id LIMIT 30""")
def b6(s):
    from seqsieve.operators.space import nearest_in_space

    near = rounded(nearest_in_space(s.where("seed = 1"), s.where("seed <> 1"), ["a", "c"], "id"))
    return near.withColumnRenamed("distance", "novelty").orderBy(F.desc("novelty"), "id").limit(30)


@query("b6_mixed_space_batch", "scores", oracle="""
WITH l AS (SELECT * FROM scores WHERE seed <> 1), p AS (SELECT * FROM scores WHERE seed = 1), t AS (SELECT a, c FROM l UNION ALL SELECT a, c FROM p),
m AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(c) AS mc, stddev_pop(c) AS sc FROM t),
n AS (SELECT p.id, p.b, p.d, round(min(sqrt(((p.a - l.a) / sa) * ((p.a - l.a) / sa) + ((p.c - l.c) / sc) * ((p.c - l.c) / sc))), 9) AS novelty FROM p, l, m GROUP BY p.id, p.b, p.d),
r1 AS (SELECT id, novelty, 'uncertainty' AS role, row_number() OVER (ORDER BY d DESC, id) AS pick FROM n ORDER BY pick LIMIT 67),
r2 AS (SELECT id, novelty, 'coverage' AS role, row_number() OVER (ORDER BY novelty DESC, id) AS pick FROM n WHERE id NOT IN (SELECT id FROM r1) ORDER BY pick LIMIT 37),
r3 AS (SELECT id, novelty, 'promising' AS role, row_number() OVER (ORDER BY b, id) AS pick FROM n WHERE id NOT IN (SELECT id FROM r1 UNION ALL SELECT id FROM r2) ORDER BY pick LIMIT 30),
r4 AS (SELECT id, novelty, 'random' AS role, row_number() OVER (ORDER BY md5(concat('7:', id)), id) AS pick FROM n WHERE id NOT IN (SELECT id FROM r1 UNION ALL SELECT id FROM r2 UNION ALL SELECT id FROM r3) ORDER BY pick LIMIT 15),
r AS (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3 UNION ALL SELECT * FROM r4)
SELECT id, role, pick::INTEGER AS pick, round(novelty, 6) AS novelty FROM r""")
def b6_mixed(s):
    return rounded(B.space_batch(s.where("seed = 1"), s.where("seed <> 1"), 149, ["a", "c"], "b", "d", 7, key="id"))


@query("b7_grouped", "pool", oracle="""
WITH g AS (SELECT cand_id, y, CASE WHEN cand_id % 10 = 0 THEN 'g1' ELSE 'g2' END AS grp FROM pool), n AS (SELECT count(*) FILTER (grp = 'g1') AS a, count(*) FILTER (grp = 'g2') AS b FROM g),
q AS (SELECT least(a, greatest(200, 400 - b)) AS qa, least(b, greatest(200, 400 - a)) AS qb FROM n), r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY y, cand_id) AS pick FROM g)
SELECT cand_id, grp, pick::INTEGER AS pick FROM r, q WHERE pick <= CASE WHEN grp = 'g1' THEN qa ELSE qb END""")
def b7(p):
    g = p.withColumn("grp", F.when(F.col("cand_id") % 10 == 0, "g1").otherwise("g2"))
    return B.grouped_batch(g, "grp", 400, "y").select("cand_id", "grp", "pick")


@query("b8_uncertainty", "pool", oracle=f"SELECT cand_id, row_number() OVER (ORDER BY {SIGMA} DESC, cand_id)::INTEGER AS pick FROM pool ORDER BY pick LIMIT 40")
def b8(p):
    return B.uncertainty_batch(_sigma(p), 40, "sigma").select("cand_id", "pick")


@query("b9_effective_budget", "pool", oracle="SELECT least(count(*), 100000) AS budget, count(*) < 100000 AS short FROM pool")
def b9(p):
    return p.agg(F.least(F.count("*"), F.lit(100000)).alias("budget"), (F.count("*") < 100000).alias("short"))


@query("b10_replicas", "labelled", oracle=f"""
WITH h AS (SELECT cand_id, y, {SIGMA} AS v FROM labelled), p AS (SELECT *, v / sum(v) OVER () * 500 AS part FROM h), w AS (SELECT *, floor(part) AS w, part - floor(part) AS f FROM p),
r AS (SELECT *, row_number() OVER (ORDER BY f DESC, cand_id) AS i, 500 - sum(w) OVER () AS rest, row_number() OVER (ORDER BY y, cand_id) AS t FROM w)
SELECT cand_id, (t <= 500)::INTEGER AS top, (w + (i <= rest)::INTEGER)::BIGINT AS weighted FROM r""")
def b10(known):
    return B.replica_allocation(_sigma(known), "y", "sigma", 500).select("cand_id", "top", "weighted")


# label hand-off

EXPORTED = "s AS (SELECT cand_id % 4 AS round, 'greedy' AS strategy, substr(sha256(sequence), 1, 16) AS candidate_id FROM labelled), b AS (SELECT round, strategy, substr(sha256(concat_ws('|', round, strategy, string_agg(candidate_id, '|' ORDER BY candidate_id))), 1, 12) AS batch_id FROM s GROUP BY 1, 2)"


@query("l1_export", "labelled", oracle=f"WITH {EXPORTED} SELECT b.batch_id, s.round, s.strategy, s.candidate_id FROM s JOIN b ON s.round = b.round WHERE s.round <> 2")
def l1(known):
    s = known.select((F.col("cand_id") % 4).alias("round"), F.lit("greedy").alias("strategy"), S.candidate_id(F.col("sequence")).alias("candidate_id"))
    done = L.export_batches(s.where("round = 2"), s.select(F.lit("none").alias("batch_id")).limit(1))
    return L.export_batches(s, done)


JUDGED = """ok AS (SELECT DISTINCT batch_id FROM batches), mem AS (SELECT DISTINCT batch_id, candidate_id FROM batches),
e AS (SELECT r.*, CASE WHEN r.sequence IS NULL OR r.sequence = '' THEN 'missing_sequence' WHEN ok.batch_id IS NULL THEN 'unknown_batch' WHEN r.candidate_id <> substr(md5(r.sequence), 1, 16) THEN 'id_mismatch' WHEN mem.batch_id IS NULL THEN 'not_in_batch'
 WHEN protocol_id IS NULL THEN 'missing_protocol' WHEN protocol_id <> 'p1' THEN 'unapproved_protocol' WHEN status IS NULL OR status NOT IN ('pass', 'fail', 'pending') THEN 'bad_status' WHEN status = 'pass' AND measured IS NULL THEN 'not_finite' END AS early
 FROM returns r LEFT JOIN ok ON r.batch_id = ok.batch_id LEFT JOIN mem ON r.batch_id = mem.batch_id AND r.candidate_id = mem.candidate_id),
w AS (SELECT *, row_number() OVER (PARTITION BY candidate_id, early IS NULL AND status = 'pass' ORDER BY ord) AS rn, first_value(measured) OVER (PARTITION BY candidate_id, early IS NULL AND status = 'pass' ORDER BY ord) AS fv FROM e),
j AS (SELECT *, CASE WHEN early IS NOT NULL THEN early WHEN status = 'pass' AND rn > 1 THEN CASE WHEN abs(measured - fv) > 1e-9 THEN 'conflict_in_file' ELSE 'duplicate_in_file' END END AS reason FROM w),
judged AS (SELECT *, CASE WHEN reason = 'duplicate_in_file' THEN 'duplicate' WHEN reason IS NOT NULL THEN 'rejected' WHEN status = 'fail' THEN 'failed' WHEN status = 'pending' THEN 'pending' ELSE 'accepted' END AS outcome FROM j)"""


def _judged(r, b):
    none = b.select("candidate_id", F.lit(0.0).alias("measured")).where("false")
    return L.judge_returns(r, b, none, F.substring(F.md5(F.col("sequence").cast("binary")), 1, 16), "p1")


@query("l2_ingest", "returns", "batches", oracle=f"WITH {JUDGED} SELECT ord, outcome, reason FROM judged")
def l2(r, b):
    return _judged(r, b).select("ord", "outcome", "reason")


@query("l2_reasons", "returns", "batches", oracle=f"WITH {JUDGED} SELECT coalesce(reason, outcome) AS reason, count(*) AS n FROM judged GROUP BY 1")
def l2b(r, b):
    return _judged(r, b).groupBy(F.coalesce("reason", "outcome").alias("reason")).agg(F.count("*").alias("n"))


def l3_stream(spark, sf_dir):
    """The same returns as arriving files: halves by order, one micro-batch each; the result is judged across files."""
    import uuid

    from seqsieve.streaming.ingest import ingest, read_judged

    at = f"{shared_dir(spark)}/stream/{uuid.uuid4().hex}"
    r, b = view(spark, sf_dir, "returns"), materialise(view(spark, sf_dir, "batches"))
    r = materialise(r.select(F.col("ord").cast("long").alias("ord"), "batch_id", "candidate_id", "sequence", F.col("measured").cast("double").alias("measured"), "status", "protocol_id"))
    cut = r.agg(F.percentile_approx("ord", 0.5)).first()[0] or 0
    for part in (r.where(F.col("ord") <= cut), r.where(F.col("ord") > cut)):
        part.write.mode("append").parquet(f"{at}/in")
        run = ingest(spark, f"{at}/in", b, f"{at}/out", f"{at}/checkpoint", "p1")
        run.awaitTermination()
        if run.exception():
            raise run.exception()
    return read_judged(spark, f"{at}/out").where("outcome = 'accepted'").select("candidate_id").distinct()


def l3_keyed_state(spark, sf_dir):
    """The same halves judged by state keyed by candidate, the outcome of every row; nobody waits long enough to be told."""
    import uuid

    from seqsieve.streaming.keyed import ingest_keyed

    at = f"{shared_dir(spark)}/stream/{uuid.uuid4().hex}"
    r, b = view(spark, sf_dir, "returns"), view(spark, sf_dir, "batches")
    b.select("batch_id", "candidate_id").write.parquet(f"{at}/batches")
    r = materialise(r.select(F.col("ord").cast("long").alias("ord"), "batch_id", "candidate_id", "sequence", F.col("measured").cast("double").alias("measured"), "status", "protocol_id"))
    cut = r.agg(F.percentile_approx("ord", 0.5)).first()[0] or 0
    for part in (r.where(F.col("ord") <= cut), r.where(F.col("ord") > cut)):
        part.write.mode("append").parquet(f"{at}/in")
        run = ingest_keyed(spark, f"{at}/in", f"{at}/batches", f"{at}/out", f"{at}/checkpoint", "p1", 10**12)
        run.awaitTermination()
        if run.exception():
            raise run.exception()
    return spark.read.schema("ord long, outcome string").parquet(f"{at}/out")


QUERIES["l3_stream"] = l3_stream
QUERIES["l3_keyed_state"] = l3_keyed_state
from seqsieve.plans.registry import ORACLES  # noqa: E402
from seqsieve.sources.views import with_views  # noqa: E402

ORACLES["l3_stream"] = with_views(f"WITH {JUDGED} SELECT DISTINCT candidate_id FROM judged WHERE outcome = 'accepted'")
ORACLES["l3_keyed_state"] = with_views(f"WITH {JUDGED} SELECT ord, outcome FROM judged")

LEDGER = f"""{JUDGED}, best AS (SELECT batch_id, candidate_id, max(measured) FILTER (outcome = 'accepted') AS measured, max((outcome = 'accepted')::INT) AS k FROM judged WHERE outcome IN ('accepted', 'failed') GROUP BY 1, 2),
ledger AS (SELECT m.batch_id, m.candidate_id, best.measured, CASE WHEN k = 1 THEN 'labelled' WHEN k = 0 THEN 'failed' ELSE 'awaiting' END AS state FROM mem m LEFT JOIN best ON m.batch_id = best.batch_id AND m.candidate_id = best.candidate_id)"""


def _ledger(r, b):
    return L.absorb(b.select("batch_id", "candidate_id").distinct(), _judged(r, b))


@query("l4_absorb", "returns", "batches", oracle=f"WITH {LEDGER} SELECT batch_id, candidate_id, measured, state FROM ledger")
def l4(r, b):
    return _ledger(r, b).select("batch_id", "candidate_id", "measured", "state")


STATUS = f"{LEDGER}, st AS (SELECT batch_id, count(*) AS n, count(*) FILTER (state = 'labelled') AS n_labelled, count(*) FILTER (state = 'failed') AS n_failed, count(*) FILTER (state = 'awaiting') AS n_awaiting FROM ledger GROUP BY 1)"


@query("l4_batch_status", "returns", "batches", oracle=f"WITH {STATUS} SELECT *, CASE WHEN n_awaiting = n THEN 'awaiting_labels' WHEN n_awaiting > 0 THEN 'partially_labeled' WHEN n_labelled = 0 THEN 'failed' ELSE 'labeled' END AS status FROM st")
def l4b(r, b):
    return L.batch_status(_ledger(r, b))


@query("l5_reveal", "pool", "labelled", oracle="SELECT cand_id FROM pool WHERE cand_id % 2 = 0 AND cand_id % 5 <> 0 AND cand_id % 7 <> 0")
def l5(p, known):
    everything = p.select("cand_id").unionByName(known.select("cand_id"))
    pick = lambda c: everything.where(c)
    return L.reveal(pick("cand_id % 2 = 0"), p, pick("cand_id % 5 = 0"), pick("cand_id % 7 = 0"), "cand_id").select("cand_id")


@query("l6_ledger_rows", "pool", "scores", oracle="""
WITH t AS (SELECT cand_id, sequence, y, row_number() OVER (ORDER BY y, cand_id) AS pick FROM pool ORDER BY y, cand_id LIMIT 50), p AS (SELECT id, max(a) AS pred FROM scores GROUP BY 1)
SELECT t.cand_id, t.pick::INTEGER AS pick, p.pred FROM t LEFT JOIN p ON p.id = t.cand_id * 8 + 1""")
def l6(p, s):
    pred = s.groupBy("id").agg(F.max("a").alias("pred"))
    t = B.greedy_batch(p, 50, "y").withColumn("id", F.col("cand_id") * 8 + 1)
    return t.join(pred, "id", "left").select("cand_id", "pick", "pred")


@query("l7_round_summary", "runs", oracle="SELECT round, strategy, count(*) AS n_runs, round(min(best), 4) AS best, round(avg(best), 4) AS mean_best FROM runs GROUP BY 1, 2")
def l7(r):
    return rounded(r.groupBy("round", "strategy").agg(F.count("*").alias("n_runs"), F.min("best").alias("best"), F.avg("best").alias("mean_best")), 4)


@query("l8_round_violations", "batches", oracle="""
WITH l AS (SELECT CAST(substr(batch_id, 2, 5) AS BIGINT) AS round, candidate_id FROM batches), z AS (SELECT round, count(*) AS size FROM l GROUP BY 1),
rounds AS (SELECT round, size + (round % 2) AS budget, 100 * round AS labeled_before, 100 * round + size AS labeled_after, size - (CASE WHEN round = 3 THEN 4 ELSE 0 END) AS n_new FROM z)
SELECT r.round, 'size' AS problem, z.size AS n FROM rounds r JOIN z ON r.round = z.round WHERE size <> budget
UNION ALL SELECT round, 'repeated', count(*) FROM (SELECT round, candidate_id FROM l GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1
UNION ALL SELECT round, 'seen', count(*) FROM (SELECT round, min(round) OVER (PARTITION BY candidate_id) AS f FROM l) WHERE f < round GROUP BY 1
UNION ALL SELECT round, 'growth', labeled_after - labeled_before - n_new FROM rounds WHERE labeled_after - labeled_before <> n_new""")
def l8(b):
    ledger = b.select(F.substring("batch_id", 2, 5).cast("long").alias("round"), "candidate_id")
    n = ledger.groupBy("round").agg(F.count("*").alias("size"))
    rounds = n.select("round", (F.col("size") + F.col("round") % 2).alias("budget"), (100 * F.col("round")).alias("labeled_before"), (100 * F.col("round") + F.col("size")).alias("labeled_after"), (F.col("size") - F.when(F.col("round") == 3, 4).otherwise(0)).alias("n_new"))
    return L.round_violations(ledger, rounds)


@query("l9_reconcile", "archive", oracle="WITH k AS (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY call_no) AS rn FROM archive) SELECT search_id, count(*) AS n_log, count(*) FILTER (id % 3 = 0) AS n_cache FROM k WHERE rn <= 5 + search_id % 4 GROUP BY 1")
def l9(a):
    state = a.select("search_id").distinct().withColumn("committed", 5 + F.col("search_id") % 4)
    log, cache = L.committed_rows(a, state, a.where("id % 3 = 0"), "search_id", "call_no", "id")
    kept = cache.select("search_id", "id", F.lit(1).alias("c"))
    return log.join(kept, ["search_id", "id"], "left").groupBy("search_id").agg(F.count("*").alias("n_log"), F.count("c").alias("n_cache"))


@query("l10_archive_audit", "archive", oracle="""
WITH c AS (SELECT search_id, id, pred + CASE WHEN id % 50 = 0 THEN 1 ELSE 0 END AS cached FROM archive WHERE id % 17 <> 0)
SELECT a.search_id, count(*) AS n_evaluated, count(c.id) AS n_cached, count(*) - count(c.id) AS n_uncached, count(*) FILTER (abs(pred - cached) > 1e-12) AS n_score_differs, 0 AS n_repeated FROM archive a LEFT JOIN c ON a.search_id = c.search_id AND a.id = c.id GROUP BY 1""")
def l10(a):
    cache = a.where("id % 17 <> 0").withColumn("pred", F.col("pred") + F.when(F.col("id") % 50 == 0, 1).otherwise(0))
    return L.archive_violations(a, cache, "search_id", "id", "pred")


@query("l11_fingerprint", "manifest", oracle="SELECT path AS key, CASE WHEN size_bytes % 7 <> 0 THEN digest END AS old, CASE WHEN size_bytes % 5 <> 0 THEN digest END AS new FROM manifest WHERE NOT (size_bytes % 7 <> 0 AND size_bytes % 5 <> 0) AND NOT (size_bytes % 7 = 0 AND size_bytes % 5 = 0) AND path NOT LIKE 'src1/%'")
def l11(m):
    kv = m.select(F.col("path").alias("key"), F.col("digest").alias("value"), "size_bytes")
    return L.fingerprint_diff(kv.where("size_bytes % 7 <> 0"), kv.where("size_bytes % 5 <> 0"), ("src1/",))


@query("l12_verify_metrics", "preds", oracle="SELECT seed, model, seed % 4 <> 0 AS agrees FROM preds GROUP BY seed, model")
def l12(p):
    fresh = p.groupBy("seed", "model").agg(*M.error_metrics())
    stored = fresh.withColumn("mae", F.col("mae") + F.when(F.col("seed") % 4 == 0, 0.5).otherwise(0.0))
    return L.verify_metrics(fresh, stored, ["seed", "model"], "mae", 1e-6).select("seed", "model", "agrees")


@query("l13_recompute_summary", "metrics", oracle="SELECT method, round(avg(value), 6) AS mean, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS median FROM metrics GROUP BY method")
def l13(m):
    return rounded(M.distribution(m, ["method"], "value").select("method", "mean", "n", "median"))


@query("l14_artefact", "scores", oracle="""
WITH r AS (SELECT seed, id, a, b, c, rank() OVER (PARTITION BY seed ORDER BY a) + (count(*) OVER (PARTITION BY seed, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY seed ORDER BY b) + (count(*) OVER (PARTITION BY seed, b) - 1) / 2.0 AS rb FROM scores)
SELECT seed, id, a, b, c AS truth, (ra + rb) / 2 AS fused FROM r""")
def l14(s):
    from seqsieve.operators.screen import rank_fusion

    return rank_fusion(s, ["seed"], ["a", "b"]).select("seed", "id", "a", "b", F.col("c").alias("truth"), "fused")


@query("l15_pin_protocol", "returns", "batches", oracle=f"""
WITH {STATUS}, ret AS (SELECT * FROM returns WHERE batch_id IN ('b1', 'b2')), op AS (SELECT batch_id FROM st WHERE n_labelled + n_failed = 0 UNION ALL SELECT 'b2')
SELECT ord, CASE WHEN batch_id IN (SELECT batch_id FROM op) THEN 'p2' ELSE protocol_id END AS protocol_id FROM ret""")
def l15(r, b):
    status = L.batch_status(_ledger(r, b)).withColumn("n_labelled", F.when(F.col("batch_id") == "b2", 0).otherwise(F.col("n_labelled"))).withColumn("n_failed", F.when(F.col("batch_id") == "b2", 0).otherwise(F.col("n_failed")))
    rows, _ = L.pin_protocol(r.where("batch_id IN ('b1', 'b2')"), status, "p2")
    return rows.select("ord", "protocol_id")


