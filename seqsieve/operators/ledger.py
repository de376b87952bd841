"""Label hand-off: batches, returned labels with ordered reasons, ledger states, and their audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ("pass", "fail", "pending")
CONFLICT = 1e-9


def batch_id(round_no: Column, strategy: Column, ids: Column) -> Column:
    """First 12 hex digits of the sha256 of round, strategy and the sorted ids, joined by |."""
    return F.substring(F.sha2(F.concat_ws("|", round_no.cast("string"), strategy, F.array_join(F.array_sort(ids), "|")), 256), 1, 12)


def export_batches(selected: DataFrame, exported: DataFrame) -> DataFrame:
    """Rows (batch_id, round, strategy, candidate_id) of new batches; a batch that exists is never written again. A batch's ids are bounded by its budget."""
    ids = selected.groupBy("round", "strategy").agg(F.collect_list("candidate_id").alias("_ids"))
    named = ids.withColumn("batch_id", batch_id(F.col("round"), F.col("strategy"), F.col("_ids")))
    return named.join(exported.select("batch_id").distinct(), "batch_id", "left_anti").select("batch_id", "round", "strategy", F.explode(F.array_sort("_ids")).alias("candidate_id"))


def judge_returns(returns: DataFrame, batches: DataFrame, accepted: DataFrame, expected_id: Column, protocol: str) -> DataFrame:
    """returns (ord, batch_id, candidate_id, sequence, measured, status, protocol_id) with outcome and reason.

    Reasons are tried in order: missing_sequence, unknown_batch, id_mismatch, not_in_batch,
    missing_protocol, unapproved_protocol, bad_status, not_finite, conflict (with an accepted
    value), duplicate (of one), conflict_in_file, duplicate_in_file. The first valid row of a
    candidate in file order stands. outcome is accepted, failed, pending, duplicate or rejected.
    """
    known = batches.select("batch_id").distinct().withColumn("_batch", F.lit(True))
    member = batches.select("batch_id", "candidate_id").distinct().withColumn("_member", F.lit(True))
    before = accepted.select("candidate_id", F.col("measured").alias("_old")).withColumn("_has", F.lit(True))
    x = returns.join(known, "batch_id", "left").join(member, ["batch_id", "candidate_id"], "left").join(before, "candidate_id", "left")
    value = F.col("measured")
    odd = value.isNull() | F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    same = F.abs(value - F.col("_old")) <= CONFLICT
    early = (
        F.when(F.col("sequence").isNull() | (F.col("sequence") == ""), "missing_sequence").when(F.col("_batch").isNull(), "unknown_batch")
        .when(~F.col("candidate_id").eqNullSafe(expected_id), "id_mismatch").when(F.col("_member").isNull(), "not_in_batch")
        .when(F.col("protocol_id").isNull(), "missing_protocol").when(F.col("protocol_id") != protocol, "unapproved_protocol")
        .when(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), "bad_status").when((F.col("status") == "pass") & odd, "not_finite")
        .when((F.col("status") == "pass") & F.col("_has").isNotNull() & ~F.coalesce(same, F.lit(False)), "conflict").when((F.col("status") == "pass") & F.col("_has").isNotNull(), "duplicate")
    )
    x = x.withColumn("_early", early)
    valid = F.col("_early").isNull() & (F.col("status") == "pass")
    by = Window.partitionBy("candidate_id", valid).orderBy("ord")
    x = x.withColumn("_rn", F.row_number().over(by)).withColumn("_first", F.first("measured").over(by))
    late = F.when(valid & (F.col("_rn") > 1), F.when(F.abs(value - F.col("_first")) > CONFLICT, "conflict_in_file").otherwise("duplicate_in_file"))
    x = x.withColumn("reason", F.coalesce("_early", late))
    outcome = F.when(F.col("reason").isin("duplicate", "duplicate_in_file"), "duplicate").when(F.col("reason").isNotNull(), "rejected").when(F.col("status") == "fail", "failed").when(F.col("status") == "pending", "pending").otherwise("accepted")
    return x.withColumn("outcome", outcome).select("ord", "batch_id", "candidate_id", "sequence", "measured", "status", "protocol_id", "outcome", "reason")


def absorb(ledger: DataFrame, judged: DataFrame) -> DataFrame:
    """ledger (batch_id, candidate_id) with state: labelled, failed or awaiting, and the measured value."""
    best = judged.where("outcome IN ('accepted', 'failed')").groupBy("batch_id", "candidate_id").agg(F.max(F.when(F.col("outcome") == "accepted", F.col("measured"))).alias("measured"), F.max((F.col("outcome") == "accepted").cast("int")).alias("_ok"))
    joined = ledger.join(best, ["batch_id", "candidate_id"], "left")
    return joined.withColumn("state", F.when(F.col("_ok") == 1, "labelled").when(F.col("_ok") == 0, "failed").otherwise("awaiting")).drop("_ok")


def batch_status(ledger: DataFrame) -> DataFrame:
    """(batch_id, n, n_labelled, n_failed, n_awaiting, status)."""
    n = lambda s: F.count_if(F.col("state") == s)
    counts = ledger.groupBy("batch_id").agg(F.count("*").alias("n"), n("labelled").alias("n_labelled"), n("failed").alias("n_failed"), n("awaiting").alias("n_awaiting"))
    return counts.withColumn("status", F.when(F.col("n_awaiting") == F.col("n"), "awaiting_labels").when(F.col("n_awaiting") > 0, "partially_labeled").when(F.col("n_labelled") == 0, "failed").otherwise("labeled"))


def reveal(wanted: DataFrame, pool: DataFrame, holdout: DataFrame, revealed: DataFrame, key: str) -> DataFrame:
    """Pool rows that are wanted, neither held out nor revealed before."""
    return pool.join(wanted.select(key), key, "left_semi").join(holdout.select(key), key, "left_anti").join(revealed.select(key), key, "left_anti")


def committed_rows(log: DataFrame, state: DataFrame, cache: DataFrame, group: str, order: str, key: str) -> tuple[DataFrame, DataFrame]:
    """After a crash: the first state.committed rows of each group's log, and the cache rows among them."""
    numbered = log.withColumn("_rn", F.row_number().over(Window.partitionBy(group).orderBy(order)))
    kept = numbered.join(state.select(group, "committed"), group).where(F.col("_rn") <= F.col("committed")).drop("_rn", "committed")
    return kept, cache.join(kept.select(group, key), [group, key], "left_semi")


def round_violations(ledger: DataFrame, rounds: DataFrame) -> DataFrame:
    """(round, problem, n): batch size other than the effective budget, repeated candidates, candidates of an earlier round, growth other than new labels."""
    sizes = ledger.groupBy("round").agg(F.count("*").alias("_size"))
    size = rounds.join(sizes, "round", "left").where(F.coalesce("_size", F.lit(0)) != F.col("budget")).select("round", F.lit("size").alias("problem"), F.coalesce("_size", F.lit(0)).alias("n"))
    again = ledger.groupBy("round", "candidate_id").agg(F.count("*").alias("_c")).where("_c > 1").groupBy("round").agg(F.count("*").alias("n")).select("round", F.lit("repeated").alias("problem"), "n")
    first = ledger.withColumn("_first", F.min("round").over(Window.partitionBy("candidate_id"))).where("_first < round").groupBy("round").agg(F.count("*").alias("n")).select("round", F.lit("seen").alias("problem"), "n")
    growth = rounds.where("labeled_after - labeled_before <> n_new").select("round", F.lit("growth").alias("problem"), (F.col("labeled_after") - F.col("labeled_before") - F.col("n_new")).alias("n"))
    return size.unionByName(again).unionByName(first).unionByName(growth)


def fingerprint_diff(old: DataFrame, new: DataFrame, inactive: tuple[str, ...] = ()) -> DataFrame:
    """(key, old, new) of entries (key, value) that differ, but for keys with an inactive prefix."""
    a, b = old.select("key", F.col("value").alias("old")), new.select("key", F.col("value").alias("new"))
    both = a.join(b, "key", "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    for p in inactive:
        both = both.where(~F.col("key").startswith(p))
    return both


def verify_metrics(recomputed: DataFrame, stored: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """(keys, stored, recomputed, agrees): stored metrics against those recomputed from predictions; missing on either side doesn't agree."""
    a, b = stored.select(*keys, F.col(value).alias("stored")), recomputed.select(*keys, F.col(value).alias("recomputed"))
    return a.join(b, keys, "full_outer").withColumn("agrees", F.coalesce(F.abs(F.col("stored") - F.col("recomputed")) <= tolerance, F.lit(False)))


def pin_protocol(rows: DataFrame, status: DataFrame, protocol: str) -> tuple[DataFrame, DataFrame]:
    """(rows with the protocol set in batches without any returned label, audit rows of the changes)."""
    open_ = status.where((F.col("n_labelled") == 0) & (F.col("n_failed") == 0)).select("batch_id").withColumn("_open", F.lit(True))
    joined = rows.join(open_, "batch_id", "left")
    changes = F.col("_open").isNotNull() & ~F.col("protocol_id").eqNullSafe(F.lit(protocol))
    audit = joined.where(changes).groupBy("batch_id").agg(F.count("*").alias("n_changed"), F.lit(protocol).alias("protocol_id"))
    return joined.withColumn("protocol_id", F.when(changes, protocol).otherwise(F.col("protocol_id"))).drop("_open"), audit


def archive_violations(archive: DataFrame, cache: DataFrame, group: str, key: str, pred: str) -> DataFrame:
    """(group, n_evaluated, n_cached, n_uncached, n_score_differs, n_repeated) per search."""
    held = cache.select(group, key, F.col(pred).alias("_cached")).withColumn("_in", F.lit(1))
    x = archive.join(held, [group, key], "left")
    sizes = cache.groupBy(group).agg(F.count("*").alias("n_cached"))
    times = archive.groupBy(group, key).agg(F.count("*").alias("_t")).groupBy(group).agg(F.count_if(F.col("_t") > 1).alias("n_repeated"))
    counts = x.groupBy(group).agg(F.count("*").alias("n_evaluated"), F.count_if(F.col("_in").isNull()).alias("n_uncached"), F.count_if(F.abs(F.col(pred) - F.col("_cached")) > 1e-12).alias("n_score_differs"))
    return counts.join(sizes, group, "left").join(times, group).select(group, "n_evaluated", F.coalesce("n_cached", F.lit(0)).alias("n_cached"), "n_uncached", "n_score_differs", "n_repeated")
