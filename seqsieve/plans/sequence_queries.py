"""Queries of sequence predicates (P) and feature columns (F)."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from seqsieve.functions import sequence as S
from seqsieve.functions.constants import BASES, CLUSTERS, PAIRS, PROPERTIES, ROLES, SITES, STACKING, WILD_TYPE
from seqsieve.plans.registry import query




def _at(p: int) -> str:
    return f"substr(sequence, {p}, 1)"


def _changed(p: int) -> str:
    return f"CAST({_at(p)} <> '{WILD_TYPE[p - 1]}' AS INTEGER)"


def _named(columns: dict[str, str]) -> str:
    return "SELECT cand_id, " + ", ".join(f"{sql} AS {name}" for name, sql in columns.items()) + " FROM variants"


def _select(df, columns):
    return df.select("cand_id", *[c.alias(n) for n, c in columns.items()])


MESSY = "concat('  ', lower(replace(sequence, 'U', 'T')), ' ')"
BROKEN = """CASE WHEN cand_id % 7 = 0 THEN substr(sequence, 1, 140) WHEN cand_id % 7 = 1 THEN concat('N', substr(sequence, 2, 140)) WHEN cand_id % 7 = 2 THEN concat('C', substr(sequence, 2, 140)) WHEN cand_id % 7 = 3 THEN NULL ELSE sequence END"""
FIXED = "concat(substr({0}, 1, 29), substr({0}, 34, 55), substr({0}, 93, 34), substr({0}, 132, 10000))"


@query("p1_normalise", "variants", oracle="SELECT cand_id, sequence AS norm FROM variants")
def p1(v):
    return v.select("cand_id", S.normalise(F.expr(MESSY)).alias("norm"))


@query("p2_contract", "variants", oracle=f"""
WITH x AS (SELECT {BROKEN} AS q FROM variants), r AS (
  SELECT CASE WHEN q IS NULL OR q = '' THEN 'missing' WHEN length(q) <> {len(WILD_TYPE)} THEN 'length' WHEN NOT regexp_matches(q, '^[ACGU]+$') THEN 'alphabet' WHEN {FIXED.format('q')} <> '{S.WILD_FIXED}' THEN 'scaffold' END AS reason FROM x)
SELECT coalesce(reason, 'ok') AS reason, count(*) AS n FROM r GROUP BY 1""")
def p2(v):
    return v.select(F.coalesce(S.contract_reason(F.expr(BROKEN)), F.lit("ok")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("p10_candidate_id", "variants", oracle="SELECT cand_id, substr(sha256(sequence), 1, 16) AS candidate_id FROM variants")
def p10(v):
    return v.select("cand_id", S.candidate_id(F.expr(MESSY)).alias("candidate_id"))


@query("f1_pattern", "variants", oracle=f"SELECT cand_id, concat({', '.join(_at(p) for p in SITES)}) AS pattern FROM variants")
def f1(v):
    return v.select("cand_id", S.pattern(F.col("sequence")).alias("pattern"))


@query("f2_hamming", "labelled", "pool", oracle="""
SELECT a.cand_id AS a_id, b.cand_id AS b_id, hamming(a.pattern, b.pattern) AS distance
FROM labelled a JOIN pool b ON a.cand_id + 1 = b.cand_id""")
def f2(a, b):
    x, y = a.select(F.col("cand_id").alias("a_id"), F.col("pattern").alias("p")), b.select(F.col("cand_id").alias("b_id"), F.col("pattern").alias("q"))
    return x.join(y, F.col("a_id") + 1 == F.col("b_id")).select("a_id", "b_id", S.hamming(F.col("p"), F.col("q")).alias("distance"))


@query("f3_changed_sites", "variants", oracle=f"""
SELECT cand_id, {' + '.join(_changed(p) for p in SITES)} AS n_changed,
 array_to_string(list_filter([{', '.join(f"CASE WHEN {_at(p)} <> '{WILD_TYPE[p - 1]}' THEN '{p}' END" for p in SITES)}], lambda x: x IS NOT NULL), ',') AS sites FROM variants""")
def f3(v):
    return v.select("cand_id", S.changed_count(F.col("sequence")).alias("n_changed"), F.array_join(S.changed_sites(F.col("sequence")).cast("array<string>"), ",").alias("sites"))


@query("f4_one_hot", "variants", oracle=_named({f"mut_p{p}_{b}": f"CAST({_at(p)} = '{b}' AS INTEGER)" for p in SITES for b in BASES}))
def f4(v):
    return _select(v, S.one_hot(F.col("sequence")))


@query("f15_first_order", "variants", oracle=f"SELECT cand_id, concat_ws(' ', {', '.join(f"CASE WHEN {_at(p)} <> '{WILD_TYPE[p - 1]}' THEN concat('mut_p{p}_', {_at(p)}) END" for p in SITES)}) AS names FROM variants")
def f15(v):
    """Names of the first-order features that a row has, those of its changed sites."""
    return v.select("cand_id", F.array_join(S.first_order_names(F.col("sequence")), " ").alias("names"))


def _dimer_sql() -> dict[str, str]:
    out = {}
    for p in SITES:
        first, last = max(1, p - 5), min(len(WILD_TYPE), p + 5)
        for d in S.DIMERS:
            out[f"wd_p{p}_{d}"] = f"round(len(list_filter(range({first}, {last}), lambda i: substr(sequence, i, 2) = '{d}')) / {float(last - first)}, 6)"
    return out


@query("f5_dimers", "variants", oracle=_named(_dimer_sql()))
def f5(v):
    return _select(v, {n: F.round(c, 6) for n, c in S.dimers_around(F.col("sequence")).items()})


def _structure_sql() -> dict[str, str]:
    out = {}
    for p in SITES:
        out[f"struct_p{p}_is_stem"] = str(int(ROLES[p] == "stem"))
        out[f"struct_p{p}_is_loop"] = str(int(ROLES[p] == "loop"))
        out[f"struct_p{p}_mut_in_stem"] = _changed(p) if ROLES[p] == "stem" else "0"
    total = lambda role: " + ".join(_changed(p) for p in SITES if role in (None, ROLES[p]))
    out |= {"struct_total_mut": total(None), "struct_stem_mut": total("stem"), "struct_loop_mut": total("loop")}
    out["struct_broken_pairs"] = " + ".join(f"{_changed(p)} * (1 - {_changed(q)})" for p, q in PAIRS.items())
    return out


@query("f6_structure", "variants", oracle=_named(_structure_sql()))
def f6(v):
    return _select(v, S.structure(F.col("sequence")))


def _stack_sql() -> dict[str, str]:
    look = lambda a: "CASE " + " ".join(f"WHEN substr(sequence, {a}, 2) = '{d}' THEN {e}" for d, e in STACKING.items()) + " ELSE 0 END"
    out = {}
    for p in SITES:
        out[f"stack_p{p}_5"], out[f"stack_p{p}_3"] = f"round({look(p - 1)}, 4)", f"round({look(p)}, 4)"
        out[f"stack_p{p}_d5"] = f"round({look(p - 1)} - ({STACKING[WILD_TYPE[p - 2 : p]]}), 4)"
        out[f"stack_p{p}_d3"] = f"round({look(p)} - ({STACKING[WILD_TYPE[p - 1 : p + 1]]}), 4)"
    return {k: f"CAST({v} AS DOUBLE) + 0.0" for k, v in out.items()}


@query("f7_stacking", "variants", oracle=_named(_stack_sql()))
def f7(v):
    return _select(v, {n: F.round(c, 4) + 0.0 for n, c in S.stacking(F.col("sequence")).items()})


@query("f8_properties", "variants", oracle="SELECT cand_id, array_to_string(list_concat(" + ", ".join("CASE " + " ".join(f"WHEN {_at(p)} = '{b}' THEN {list(v)}" for b, v in PROPERTIES.items()) + " ELSE [0,0,0,0,0,0] END" for p in SITES) + "), '') AS properties FROM variants")
def f8(v):
    return v.select("cand_id", F.array_join(S.properties(F.col("sequence")).cast("array<string>"), "").alias("properties"))


def _cluster_sql() -> dict[str, str]:
    out = {}
    for k, sites in enumerate(CLUSTERS):
        part = f"substr(sequence, {sites[0]}, {len(sites)})"
        out |= {f"cluster{k}_{b}": f"length({part}) - length(replace({part}, '{b}', ''))" for b in BASES}
        out[f"cluster{k}_gc"] = f"round(len(list_filter(string_split({part}, ''), lambda x: x IN ('G', 'C'))) / {float(len(sites))}, 6)"
    return out


@query("f9_clusters", "variants", oracle=_named(_cluster_sql()))
def f9(v):
    return _select(v, {n: F.round(c, 6) if n.endswith("gc") else c for n, c in S.cluster_composition(F.col("sequence")).items()})


def _local_sql() -> dict[str, str]:
    out = {}
    for p in SITES:
        for reach in (3, 5):
            first, last = max(1, p - reach), min(len(WILD_TYPE), p + reach)
            for name, kind in (("gc", "('G', 'C')"), ("au", "('A', 'U')")):
                out[f"local_p{p}_{name}{reach}"] = f"round(len(list_filter(range({first}, {last + 1}), lambda i: substr(sequence, i, 1) IN {kind})) / {float(last - first + 1)}, 6)"
    return out


@query("f10_local_windows", "variants", oracle=_named(_local_sql()))
def f10(v):
    return _select(v, {n: F.round(c, 6) for n, c in S.local_windows(F.col("sequence")).items()})


def _kmer_sql() -> dict[str, str]:
    out = {}
    for name in [f"kmer_{m}" for k in (1, 2, 3) for m in _mers(k)]:
        m = name[5:]
        k, n = len(m), len(WILD_TYPE) - len(m) + 1
        wild = sum(WILD_TYPE[i : i + k] == m for i in range(n))
        here = f"len(list_filter(range(1, {n + 1}), lambda i: substr(sequence, i, {k}) = '{m}'))"
        out[name] = f"CASE WHEN {here} > 0 THEN round({here} / {float(n)} - {wild / n!r}, 6) + 0.0 ELSE 0.0 END" if wild else "CAST(0 AS DOUBLE)"
    return out


def _mers(k: int) -> list[str]:
    out = [""]
    for _ in range(k):
        out = [x + b for x in out for b in BASES]
    return out


@query("f11_kmer_deltas", "variants", oracle=_named(_kmer_sql()))
def f11(v):
    return _select(v, {n: F.round(c, 6) + 0.0 for n, c in S.kmer_deltas(F.col("sequence")).items()})


@query("f12_pairs", "variants", oracle="SELECT cand_id, array_to_string([" + ", ".join(f"{16 * i} + (strpos('ACGU', {_at(a)}) - 1) * 4 + strpos('ACGU', {_at(b)}) - 1" for i, (a, b) in enumerate(combinations(SITES, 2))) + "], ',') AS active FROM variants")
def f12(v):
    return v.select("cand_id", F.array_join(S.pair_indices(F.col("sequence")).cast("array<string>"), ",").alias("active"))


def _summary_sql() -> dict[str, str]:
    counts = [" + ".join(_changed(p) for p in c) for c in CLUSTERS]
    total = " + ".join(_changed(p) for p in SITES)
    swap = {"A": "G", "G": "A", "C": "U", "U": "C"}
    trans = " + ".join(f"CAST({_at(p)} = '{swap[WILD_TYPE[p - 1]]}' AS INTEGER)" for p in SITES)

    def classes(was: bool, now: bool) -> str:
        return " + ".join(f"CAST({_at(p)} <> '{WILD_TYPE[p - 1]}' AND {_at(p)} {'' if now else 'NOT '}IN ('A', 'G') AS INTEGER)" for p in SITES if (WILD_TYPE[p - 1] in "AG") == was) or "0"

    gc = " + ".join(f"CAST({_at(p)} IN ('G', 'C') AS INTEGER)" for p in SITES)
    wild = sum(b in "GC" for b in S.WILD_PATTERN)
    return {
        "n_changed": total, "changed_c0": counts[0], "changed_c1": counts[1], "changed_c2": counts[2], "transitions": trans, "transversions": f"({total}) - ({trans})",
        "pur_pyr": classes(True, False), "pyr_pur": classes(False, True), "pur_pur": classes(True, True), "pyr_pyr": classes(False, False),
        "max_cluster": f"greatest({', '.join(counts)})", "all_hit": "CAST(" + " AND ".join(f"({c}) > 0" for c in counts) + " AS INTEGER)",
        "gc_share": f"round(({gc}) / 13.0, 6)", "gc_delta": f"round(({gc} - {wild}) / 13.0, 6) + 0.0",
    }


@query("f13_summary", "variants", oracle=_named(_summary_sql()))
def f13(v):
    return _select(v, {n: F.round(c, 6) + 0.0 if n.startswith("gc") else c for n, c in S.summary(F.col("sequence")).items()})


@query("f14_identity", "variants", oracle="SELECT cand_id, array_to_string([" + ", ".join(f"CAST({_at(a)} = {_at(b)} AS INTEGER)" for a in SITES for b in SITES) + "], '') AS same FROM variants")
def f14(v):
    return v.select("cand_id", F.array_join(S.identity_matrix(F.col("sequence")).cast("array<string>"), "").alias("same"))


@query("f16_tokens", "variants", oracle="SELECT cand_id, concat('1,', array_to_string(list_transform(range(1, length(sequence) - 1), lambda i: (strpos('ACGU', substr(sequence, i, 1)) - 1) * 16 + (strpos('ACGU', substr(sequence, i + 1, 1)) - 1) * 4 + strpos('ACGU', substr(sequence, i + 2, 1)) - 1 + 5), ','), ',2') AS tokens FROM variants")
def f16(v):
    return v.select("cand_id", F.array_join(S.tokens(F.col("sequence")).cast("array<string>"), ",").alias("tokens"))


WILD_GC = sum(b in "GC" for b in WILD_TYPE) / len(WILD_TYPE)


@query("f17_gc_shift", "variants", oracle=f"SELECT cand_id, round(len(list_filter(string_split(sequence, ''), lambda x: x IN ('G', 'C'))) / 141.0, 6) AS gc, round(abs(len(list_filter(string_split(sequence, ''), lambda x: x IN ('G', 'C'))) / 141.0 - {WILD_GC!r}), 6) AS shift FROM variants")
def f17(v):
    return v.select("cand_id", F.round(S.gc_share(F.col("sequence")), 6).alias("gc"), F.round(S.gc_shift(F.col("sequence")), 6).alias("shift"))
