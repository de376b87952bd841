"""Whole searches against a loop over each search, and taken up from a written generation."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from seqsieve.functions.sequence import WILD_PATTERN
from seqsieve.operators import generate, search

BASES = "ACGU"


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def pred(p):
    return int(md5("m" + p)[:6], 16)


def scorer():
    return F.conv(F.substring(F.md5(F.concat(F.lit("m"), F.col("pattern")).cast("binary")), 1, 6), 16, 10).cast("long")


def apart(a, b):
    return sum(x != y for x, y in zip(a, b, strict=True))


def hops(p, n, low, high):
    out = [p]
    for _ in range(n):
        out = {q[:i] + b + q[i + 1 :] for q in out for i in range(13) for b in BASES}
    return [q for q in out if apart(p, q) == n and low <= apart(q, WILD_PATTERN) <= high]


def survive(cands, r):
    order = sorted(cands, key=lambda p: (pred(p), p))
    head, kept = order[: r.width * r.factor], []
    for p in head:
        if len(kept) < r.width and all(apart(p, k) >= r.distance for k in kept):
            kept.append(p)
    kept += [p for p in head if p not in kept][: r.width - len(kept)]
    return (order[: r.elites] + [p for p in kept if p not in order[: r.elites]])[: r.width]


def loop(name, seeds, r, forbidden):
    """({(generation, pattern, parent, operator)}, counters) of one search."""
    archive = {p: (0, p, None, "seed") for p in seeds}
    parents, best = survive(seeds, r), min(seeds, key=lambda p: (pred(p), p))
    g = stagnant = 0
    while True:
        if len(archive) >= r.budget:
            stop = "budget_exhausted"
            break
        if g >= r.max_generations:
            stop = "max_generations"
            break
        slots = min(r.budget - len(archive), len(parents) * r.offspring)
        restarts = round(slots * r.restart_share)
        base, extra = divmod(slots - restarts, len(parents))
        tried = []
        order = lambda q: (md5(f"{r.seed}:{name}:{g}:{q}"), q)  # noqa: B023,E731
        for i, p in enumerate(parents):
            quota = base + (i < extra)
            ones = sorted(hops(p, 1, r.low, r.high), key=order)[: round(quota * r.one_hop_share)]
            twos = sorted(hops(p, 2, r.low, r.high), key=order)[: quota - len(ones)]
            tried += [(q, p, "one_hop") for q in ones] + [(q, p, "two_hop") for q in twos]
        drawn = []
        for j in range(2 * restarts + 8 if restarts else 0):
            h = md5(f"{r.seed}:{name}:{g}:restart:{j}")
            q = "".join(BASES[int(h[i], 16) % 4] for i in range(13))
            if q not in archive and q not in forbidden and q not in drawn:
                drawn.append(q)
        tried += [(q, None, "restart") for q in drawn[:restarts]]
        kids = {}
        for q, p, how in tried:
            if q not in archive and q not in forbidden:
                kids.setdefault(q, (g + 1, q, p, how))
        archive |= kids
        new = min(kids, key=lambda p: (pred(p), p), default=None)
        if new is not None and pred(new) < pred(best):
            best, stagnant = new, 0
        else:
            stagnant += 1
        parents, g = survive([*parents, *kids], r), g + 1
        stop = "stagnation" if stagnant >= r.max_stagnant else "neighbours_exhausted" if not kids else None
        if stop:
            break
    return set(archive.values()), (g, pred(best), best, stagnant, len(archive), stop)


def start(spark, n=12):
    r = random.Random(3)
    some = lambda: "".join(r.choice(BASES) if r.random() < 0.3 else c for c in WILD_PATTERN)
    seeds = {name: sorted({some() for _ in range(n)}) for name in ("a", "b")} | {"few": [WILD_PATTERN]}
    forbidden = {p for s in seeds.values() for q in s for p in hops(q, 1, 0, 13)[::3]}
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    return seeds, forbidden, table([(n, p) for n, s in seeds.items() for p in s], "search string, pattern string"), table([(p,) for p in sorted(forbidden)], "pattern string")


def results(state):
    archive = {}
    for x in state.archive.collect():
        archive.setdefault(x["search"], []).append((x["generation"], x["pattern"], x["parent"], x["operator"]))
    assert all(len(v) == len(set(v)) for v in archive.values())
    counters = {x["search"]: (x["generation"], x["best_pred"], x["best_pattern"], x["stagnant"], x["used"], x["stop"]) for x in state.counters.collect()}
    return {k: set(v) for k, v in archive.items()}, counters


@pytest.mark.parametrize("rules", [search.Rules(width=4, offspring=9, max_generations=3, seed=2), search.Rules(width=3, offspring=7, one_hop_share=0.5, restart_share=0.25, elites=2, distance=5, low=1, high=4, budget=60, max_stagnant=2, seed=8)])
def test_equals_a_loop(spark, rules):
    seeds, forbidden, rows, banned = start(spark)
    archive, counters = results(search.run(rows, scorer(), rules, banned))
    for name, own in seeds.items():
        want = loop(name, own, rules, forbidden)
        assert archive[name] == want[0] and counters[name] == want[1], name


def test_goes_on_from_a_written_generation(spark, tmp_path):
    rules = search.Rules(width=3, offspring=6, max_generations=3, seed=4)
    _, _, rows, banned = start(spark, 4)
    whole = results(search.run(rows, scorer(), rules, banned))
    folder = f"file://{tmp_path}/searches"
    assert search.load(spark, folder) == (None, -1)
    search.run(rows, scorer(), rules, banned, folder, generations=2)
    for part in (tmp_path / "searches" / "generation=2" / "counters").iterdir():  # as if it had been lost while it was written
        part.unlink()
    assert search.load(spark, folder)[1] == 1
    assert results(search.run(rows, scorer(), rules, banned, folder)) == whole


def test_limits_are_errors(spark):
    _, _, rows, _ = start(spark, 4)
    with pytest.raises(ValueError, match="seeds"):
        search.begin(rows, scorer(), search.Rules(budget=2))
    with pytest.raises(ValueError, match="elites"):
        search.Rules(width=2, elites=3)
    cache = rows.limit(1).select("pattern", F.lit(1).cast("long").alias("pred"), F.lit("s").alias("snapshot"))
    n = rows.select("pattern").distinct().count()
    assert generate.score_new(rows, cache, n - 1, scorer(), "s").count() == n
    with pytest.raises(ValueError, match="budget"):
        generate.score_new(rows, cache, n - 2, scorer(), "s")
    with pytest.raises(ValueError, match="variants"):
        generate.variant_corpus(rows, spark.createDataFrame([(p,) for p in [WILD_PATTERN]], "pattern string").where("false"), 5, 1, oversample=0)
    assert search.run(rows.limit(0), scorer(), search.Rules()).counters.count() == 0


def test_seeds_and_groups(spark):
    seeds, _, rows, _ = start(spark)
    measured = rows.select(F.monotonically_increasing_id().alias("cand_id"), "pattern").dropDuplicates(["pattern"]).withColumn("y", scorer())
    got = generate.initial_seeds(measured, "y", 3, 4, 5, 9).orderBy("pick").collect()
    known = {p for s in seeds.values() for p in s}
    kept = []
    for p in sorted(known, key=lambda p: (pred(p), p)):
        if len(kept) < 3 and all(apart(p, k) >= 4 for k in kept):
            kept.append(p)
    assert [x["pattern"] for x in got if x["evidence"] == "measured"] == kept
    random_ones = [x["pattern"] for x in got if x["evidence"] == "none"]
    assert len(set(random_ones)) == 5 and not set(random_ones) & known and [x["pick"] for x in got] == list(range(1, len(kept) + 6))
    grouped = generate.prototype_groups(rows.withColumn("pred", scorer()), "search", 6, 4)
    report = {(x["search"], x["group"]): x for x in generate.group_distances(grouped, "search").collect()}
    for name, own in seeds.items():
        order = sorted(own, key=lambda p: (pred(p), p))
        second = next((p for p in order[:6] if apart(p, order[0]) >= 4), None)
        mine = {1: [], 2: []}
        for p in own:
            d1, d2 = apart(p, order[0]), apart(p, second) if second else 99
            mine[2 if d2 < d1 else 1].append(min(d1, d2))
        for g, ds in mine.items():
            assert (name, g) not in report if not ds else [report[name, g][c] for c in ("n", "min_distance", "max_distance")] == [len(ds), min(ds), max(ds)] and abs(report[name, g]["mean_distance"] - sum(ds) / len(ds)) < 1e-9
