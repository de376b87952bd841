"""Beam searches of many generations, all searches together, on state tables that are written each generation.

A state is three tables: the frontier (search, place, pattern, pred), whose places from 0 on
are the order in which parents get what is left over; the archive of all that was scored
(search, generation, pattern, parent, operator, pred); and one row of counters per search
(search, generation, best_pred, best_pattern, stagnant, used, stop). The driver reads only how
many searches are open. Draws are md5 of seed, search, generation and pattern, so a search
that is taken up from a written generation goes on as if it had never stopped.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqsieve.functions.constants import BASES, SITES
from seqsieve.operators.generate import hex_number, one_hop, survivors, two_hops
from seqsieve.plans.materialise import materialise

ONE_HOP, TWO_HOP, RESTART = "one_hop", "two_hop", "restart"
#: Place of proposals without a parent: after all others.
LAST_PLACE = 2**31 - 1


@dataclass(frozen=True)
class Rules:
    """Width of the beam, offspring for each parent, shares of one-hop proposals and of restarts, the survivors' distance, the rows looked at for each survivor, elites that always survive, limits of generations, of generations without a better best, and of scores for each search, changes from the wild type, and the seed."""

    width: int = 8
    offspring: int = 16
    one_hop_share: float = 0.7
    restart_share: float = 0.1
    distance: int = 2
    factor: int = 4
    elites: int = 0
    max_generations: int = 20
    max_stagnant: int = 4
    budget: int = 10_000
    low: int = 0
    high: int = len(SITES)
    seed: int = 0

    def __post_init__(self) -> None:
        if not (0 <= self.one_hop_share <= 1 and 0 <= self.restart_share <= 1):
            raise ValueError("shares lie within 0 and 1")
        if self.width < 1 or self.offspring < 1 or not 0 <= self.elites <= self.width:
            raise ValueError("a beam holds a parent at least, which has offspring, and no more elites than it is wide")


@dataclass(frozen=True)
class State:
    frontier: DataFrame
    archive: DataFrame
    counters: DataFrame


def _name(rules: Rules) -> Column:
    """What the draws of a search in a generation begin with."""
    return F.concat_ws(":", F.lit(str(rules.seed)), F.col("search").cast("string"), F.col("generation").cast("string"))


def _drawn(rows: DataFrame, most: str, rules: Rules) -> DataFrame:
    """Of each parent's neighbours (at most some hundreds) the first most by hash."""
    order = F.md5(F.concat_ws(":", _name(rules), F.col("pattern")).cast("binary"))
    place = F.row_number().over(Window.partitionBy("search", "place").orderBy(order, "pattern"))
    return rows.withColumn("_rn", place).where(F.col("_rn") <= F.col(most)).drop("_rn")


def random_patterns(rows: DataFrame, n: str, name: Column) -> DataFrame:
    """rows with draw and pattern: twice n and eight more patterns, drawn by hashes of a name and the draw."""
    drawn = rows.where(F.col(n) > 0).withColumn("draw", F.explode(F.sequence(F.lit(0), 2 * F.col(n) + 7)))
    h = F.md5(F.concat_ws(":", name, F.lit(RESTART), F.col("draw").cast("string")).cast("binary"))
    bases = [F.substring(F.lit(BASES), hex_number(F.col("_h"), i + 1, 1) % 4 + 1, F.lit(1)) for i in range(len(SITES))]
    return drawn.withColumn("_h", h).withColumn("pattern", F.concat(*bases)).drop("_h")


def _proposals(state: State, live: DataFrame, rules: Rules, forbidden: DataFrame | None) -> DataFrame:
    """(search, generation, pattern, parent, operator): new patterns of each open search, each once, by its first parent."""
    sizes = state.frontier.groupBy("search").agg(F.count("*").alias("parents"))
    slots = F.least(F.lit(rules.budget) - F.col("used"), F.col("parents") * rules.offspring)
    plan = live.join(sizes, "search").withColumn("slots", slots).withColumn("restarts", F.bround(F.col("slots") * rules.restart_share).cast("long"))
    plan = materialise(plan.withColumn("off", F.col("slots") - F.col("restarts")).select("search", "generation", "parents", "restarts", "off"))
    quota = F.floor(F.col("off") / F.col("parents")) + (F.col("place") < F.col("off") % F.col("parents")).cast("long")
    parents = state.frontier.join(plan, "search").select("search", "generation", "place", "pattern", quota.alias("quota")).where("quota > 0")
    parents = materialise(parents.withColumn("ones", F.bround(F.col("quota") * rules.one_hop_share).cast("long")))
    carry = ["search", "generation", "place", "quota", "ones"]
    ones = materialise(_drawn(one_hop(parents, rules.low, rules.high, carry), "ones", rules))
    taken = ones.groupBy("search", "place").agg(F.count("*").alias("taken"))
    rest = parents.join(taken, ["search", "place"], "left").withColumn("need", F.col("quota") - F.coalesce("taken", F.lit(0))).where("need > 0")
    twos = _drawn(two_hops(rest, rules.low, rules.high, ["search", "generation", "place", "need"]), "need", rules)
    tried = lambda df, operator, rank: df.select("search", "generation", "pattern", F.struct("place", F.lit(rank).alias("rank"), F.lit(operator).alias("operator"), "parent").alias("by"))
    hops = tried(ones, ONE_HOP, 1).unionByName(tried(twos, TWO_HOP, 2))

    def new(df: DataFrame) -> DataFrame:
        df = df.join(state.archive.select("search", "pattern"), ["search", "pattern"], "left_anti")
        return df.join(forbidden.select("pattern").distinct(), "pattern", "left_anti") if forbidden is not None else df

    drawn = new(random_patterns(plan, "restarts", _name(rules)).groupBy("search", "generation", "restarts", "pattern").agg(F.min("draw").alias("draw")))
    place = F.row_number().over(Window.partitionBy("search").orderBy("draw"))
    drawn = drawn.withColumn("_rn", place).where(F.col("_rn") <= F.col("restarts")).withColumn("place", F.lit(LAST_PLACE)).withColumn("parent", F.lit(None).cast("string"))
    every = new(hops).unionByName(tried(drawn, RESTART, 3))
    return every.groupBy("search", "generation", "pattern").agg(F.min("by").alias("by")).select("search", "generation", "pattern", "by.parent", "by.operator")


def begin(seeds: DataFrame, scorer: Column, rules: Rules, write: Callable[[DataFrame, str], DataFrame] | None = None) -> State:
    """The state of generation 0: seeds (search, pattern) scored by a column over pattern, the beam chosen among them. More different seeds than a search's budget are an error, none is left out."""
    write = write or (lambda df, _: materialise(df))
    scored = seeds.select("search", "pattern").distinct().withColumn("pred", scorer)
    archive = write(scored.select("search", F.lit(0).alias("generation"), "pattern", F.lit(None).cast("string").alias("parent"), F.lit("seed").alias("operator"), "pred"), "scored")
    frontier = write(survivors(archive, "search", rules.width, rules.distance, rules.factor, rules.elites), "frontier")
    best = archive.groupBy("search").agg(F.min(F.struct("pred", "pattern")).alias("b"), F.count("*").alias("used"))
    most = best.agg(F.max("used")).first()[0] or 0
    if most > rules.budget:
        raise ValueError(f"a search has {most} seeds and may score {rules.budget}")
    counters = best.select("search", F.lit(0).alias("generation"), F.col("b.pred").alias("best_pred"), F.col("b.pattern").alias("best_pattern"), F.lit(0).alias("stagnant"), "used", F.lit(None).cast("string").alias("stop"))
    return State(frontier, archive, write(_stopped(counters, rules), "counters"))


def _stopped(counters: DataFrame, rules: Rules) -> DataFrame:
    """counters with the stops that need no further generation."""
    at = F.coalesce("stop", F.when(F.col("used") >= rules.budget, "budget_exhausted").when(F.col("generation") >= rules.max_generations, "max_generations"))
    return counters.withColumn("stop", at)


def step(state: State, scorer: Column, rules: Rules, forbidden: DataFrame | None = None, write: Callable[[DataFrame, str], DataFrame] | None = None) -> State:
    """The state after one more generation of all open searches."""
    write = write or (lambda df, _: materialise(df))
    live = state.counters.where("stop IS NULL")
    made = _proposals(state, live, rules, forbidden).withColumn("pred", scorer)
    kids = write(made.select("search", (F.col("generation") + 1).alias("generation"), "pattern", "parent", "operator", "pred"), "scored")
    archive = state.archive.unionByName(kids)
    running = state.frontier.join(live.select("search"), "search", "left_semi").select("search", "pattern", "pred").unionByName(kids.select("search", "pattern", "pred"))
    ended = state.frontier.join(live.select("search"), "search", "left_anti")
    frontier = write(survivors(running, "search", rules.width, rules.distance, rules.factor, rules.elites).unionByName(ended), "frontier")
    best = kids.groupBy("search").agg(F.min(F.struct("pred", "pattern")).alias("b"), F.count("*").alias("n"))
    better = F.coalesce(F.col("b.pred") < F.col("best_pred"), F.lit(False))
    moved = state.counters.join(best, "search", "left").withColumn("open", F.col("stop").isNull())
    moved = moved.select(
        "search",
        F.when(F.col("open"), F.col("generation") + 1).otherwise(F.col("generation")).alias("generation"),
        F.when(better, F.col("b.pred")).otherwise(F.col("best_pred")).alias("best_pred"),
        F.when(better, F.col("b.pattern")).otherwise(F.col("best_pattern")).alias("best_pattern"),
        F.when(~F.col("open"), F.col("stagnant")).when(better, 0).otherwise(F.col("stagnant") + 1).alias("stagnant"),
        (F.col("used") + F.coalesce("n", F.lit(0))).alias("used"),
        F.when(~F.col("open"), F.col("stop")).when(~better & (F.col("stagnant") + 1 >= rules.max_stagnant), "stagnation").when(F.coalesce("n", F.lit(0)) == 0, "neighbours_exhausted").alias("stop"),
    )
    return State(frontier, archive, write(_stopped(moved, rules), "counters"))


def _writer(folder: str, generation: int) -> Callable[[DataFrame, str], DataFrame]:
    """Writes a generation's tables into a folder that all executors share; counters come last, so a generation that has them is whole."""

    def write(df: DataFrame, name: str) -> DataFrame:
        at = f"{folder}/generation={generation}/{name}"
        df.write.mode("overwrite").parquet(at)
        return df.sparkSession.read.schema(df.schema).parquet(at)

    return write


def _written(spark: SparkSession, folder: str, generation: int) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/generation={generation}/counters/_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def load(spark: SparkSession, folder: str) -> tuple[State | None, int]:
    """(state, generation) of the last whole generation in a folder; (None, -1) if there is none."""
    last = -1
    while _written(spark, folder, last + 1):
        last += 1
    if last < 0:
        return None, last
    read = lambda g, name: spark.read.parquet(f"{folder}/generation={g}/{name}")
    archive = read(0, "scored")
    for g in range(1, last + 1):
        archive = archive.unionByName(read(g, "scored"))
    return State(read(last, "frontier"), archive, read(last, "counters")), last


def run(seeds: DataFrame, scorer: Column, rules: Rules, forbidden: DataFrame | None = None, folder: str | None = None, generations: int | None = None) -> State:
    """Searches from seeds (search, pattern), smaller scores being better, until each has a stop: budget_exhausted, max_generations, stagnation or neighbours_exhausted.

    In a generation a search has slots: what its budget leaves, at most offspring for each
    parent. A rounded share of them (halves to even) are restarts, random patterns without a
    parent; the others go to the parents evenly, what is over to the first ones. Of a parent's
    quota a rounded share are one-hop neighbours, the rest two-hop ones, drawn by hash.
    Proposals that the search has scored, or that are forbidden, are dropped, repeated ones
    count once; what is left is scored. A generation that scores nothing ends a search, and so
    do max_stagnant generations without a better best. With a folder, generations are written
    there, and a run finds the last whole one and goes on from it; generations then limits how
    many this run adds. An empty table of seeds gives an empty state.
    """
    spark = seeds.sparkSession
    state, done = load(spark, folder) if folder else (None, -1)
    writer = (lambda g: _writer(folder, g)) if folder else (lambda g: None)
    if state is None:
        state, done = begin(seeds, scorer, rules, writer(0)), 0
    added = 0
    while (generations is None or added < generations) and not state.counters.where("stop IS NULL").isEmpty():
        done, added = done + 1, added + 1
        state = step(state, scorer, rules, forbidden, writer(done))
    return state
