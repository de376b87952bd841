"""Feature importances of random forests over binned features, all forests a level at a time in one pass over the rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins of a feature, trees of a forest and levels of a tree, as in screen.estimator's forest.
BINS, TREES, DEPTH = 32, 30, 6
#: Rows that a task takes on at once; what it makes of them stays in a core's cache.
ROWS = 1 << 14


def bin_edges(df: DataFrame, features: Sequence[str]) -> dict[str, list[float]]:
    """At most BINS - 1 ascending edges of each feature: its values but the last if they are few, else quantiles. A row's bin is the number of edges below its value."""
    shares = [i / BINS for i in range(1, BINS)]
    one = df.agg(*[x for f in features for x in (F.approx_count_distinct(f), F.percentile_approx(F.col(f).cast("double"), shares))]).first()
    edges = {}
    for i, f in enumerate(features):
        few = one[2 * i] <= 2 * BINS and sorted(r[0] for r in df.select(F.col(f).cast("double")).distinct().limit(BINS + 1).collect() if r[0] is not None)
        edges[f] = few[:-1] if few and len(few) <= BINS else sorted(set(one[2 * i + 1] or ()))
    return edges


def binned(df: DataFrame, edges: Mapping[str, Sequence[float]], names: Mapping[str, str], keep: str) -> DataFrame:
    """df's columns of the schema keep, and for each feature its bin as a byte by a new name; null for null and NaN."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = batch.select([c for c in batch.schema.names if c not in names])
            for f, name in names.items():
                v = batch[f].to_numpy(zero_copy_only=False)
                made = made.append_column(name, pa.array(np.searchsorted(edges[f], v, "left").astype(np.int8), mask=np.isnan(v)))
            yield made

    rest = [c for c in df.columns if c not in names]
    return df.select(*rest, *[F.col(f).cast("double").alias(f) for f in names]).mapInArrow(run, keep + "".join(f", {n} byte" for n in names.values()))


def _poisson_table() -> np.ndarray:
    """A Poisson(1) number for each value of a hash's highest 16 bits."""
    upto = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    return np.searchsorted(upto, (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


def _histograms(inputs: Sequence[Sequence[str]], trees: list[dict], level: int, target: str, row: str, centre: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(tree, node, sums): for each node of the level the weights and weighted targets by bin of each of its features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draws = _poisson_table()
        first, width = 2**level - 1, 2**level
        made = [np.zeros((t["subsets"].shape[1], 2, width * BINS)) for t in trees]

        def take(held: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(held)
            if any(table[c].null_count for c in table.column_names):
                raise ValueError("a feature or the target has a null or NaN")
            y, u = table[target].to_numpy() - centre, table[row].to_numpy().view(np.uint64)
            n, now, flat = len(y), None, None
            for t, sums in zip(trees, made, strict=True):
                if not t["open"]:
                    continue
                if t["forest"] != now:
                    now = t["forest"]
                    flat = np.concatenate([table[c].to_numpy() for c in inputs[now]]).astype(np.int16)
                w = draws.take((((u ^ t["mask"]) * t["factor"]) >> np.uint64(48)).view(np.int64))
                at = np.flatnonzero(w)
                feature, cut = t["feature"] * n, t["bin"]
                node = np.zeros(len(at), dtype=np.int64)
                for i in range(level):
                    right = (flat.take(feature.take(node) + at) > cut.take(node)) if i else flat[feature[0] : feature[0] + n].take(at) > cut[0]
                    node = 2 * node + 1 + right
                node -= first
                if not t["alive"].all():
                    alive = t["alive"].take(node)
                    at, node = at[alive], node[alive]
                weight = w.take(at).astype(np.float64)
                both = weight * y.take(at)
                base = node * BINS
                for j in range(sums.shape[0]):
                    column = t["subsets"][:, j] * n
                    key = base + flat.take(column.take(node) + at) if level else flat[column[0] : column[0] + n].take(at)
                    sums[j, 0] += np.bincount(key, weight, width * BINS)
                    sums[j, 1] += np.bincount(key, both, width * BINS)

        held, n = [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                held.append(batch.slice(i, ROWS))
                n += held[-1].num_rows
                if n >= ROWS:
                    take(held)
                    held, n = [], 0
        if n:
            take(held)
        for i, (t, sums) in enumerate(zip(trees, made, strict=True)):
            nodes = np.flatnonzero(t["alive"]) if t["open"] else []
            if len(nodes):
                cut = sums.reshape(sums.shape[0], 2, width, BINS)
                yield pa.RecordBatch.from_pydict({"tree": pa.array([i] * len(nodes), pa.int32()), "node": pa.array(nodes, pa.int32()), "sums": pa.array([cut[:, :, k].tobytes() for k in nodes], pa.binary())})

    return run


def _best(table: pa.Table) -> pa.Table:
    """The split of a node that lowers the squared error most: the feature's place, the bin up to which rows go left, the gain; no row if none does."""
    sums = np.sum([np.frombuffer(b.as_py()) for b in table["sums"]], axis=0).reshape(-1, 2, BINS)
    left = np.cumsum(sums, axis=2)[:, :, :-1]
    total = sums.sum(axis=2, keepdims=True)
    right = total - left
    fair = (left[:, 0] > 0.5) & (right[:, 0] > 0.5)
    share = lambda s: s[:, 1] ** 2 / np.where(s[:, 0] > 0.5, s[:, 0], 1.0)
    gain = np.where(fair, share(left) + share(right) - share(total), 0.0)
    j, b = np.unravel_index(np.argmax(gain), gain.shape)
    found = [(table["tree"][0].as_py(), table["node"][0].as_py(), int(j), int(b), float(gain[j, b]))]
    if not gain[j, b] > 1e-9 * share(total)[j, 0]:
        found = []
    kinds = {"tree": pa.int32(), "node": pa.int32(), "place": pa.int32(), "bin": pa.int32(), "gain": pa.float64()}
    return pa.table({c: pa.array([f[i] for f in found], kind) for i, (c, kind) in enumerate(kinds.items())})


def forest_importances(rows: DataFrame, inputs: Sequence[Sequence[str]], target: str, row: str, seed: int = 0) -> list[np.ndarray]:
    """For each list of inputs, columns of bins in a written table, the importances of a forest: TREES trees of DEPTH levels, each on a Poisson(1) number of every row by its hash row, each node on a third of the inputs.

    A level of all trees of all forests is one pass over all rows; a task sends its sums for each
    node, whose split is found where they meet, and the driver takes in a row for each split.
    An importance is the fall of the squared error by a feature's splits, as a share of the tree's, on average over trees.
    """
    centre = rows.agg(F.avg(target)).first()[0] or 0.0
    trees = []
    for f, columns in enumerate(inputs):
        for t in range(TREES):
            rng = np.random.default_rng([seed, f, t])
            mask, factor = (np.uint64(x) for x in rng.integers(0, 1 << 63, 2))
            trees.append({"forest": f, "rng": rng, "mask": mask, "factor": factor * np.uint64(2) + np.uint64(1), "open": True, "feature": np.zeros(2**DEPTH, np.int64), "bin": np.full(2**DEPTH, BINS, np.int64), "alive": np.ones(1, bool), "gains": np.zeros(len(columns))})
    for level in range(DEPTH):
        for t in trees:
            n = len(inputs[t["forest"]])
            t["subsets"] = np.stack([t["rng"].permutation(n)[: -(-n // 3)] for _ in range(2**level)])
        sent = [{k: v for k, v in t.items() if k not in ("rng", "gains")} for t in trees]
        sums = rows.mapInArrow(_histograms(inputs, sent, level, target, row, centre), "tree int, node int, sums binary")
        splits = sums.groupBy("tree", "node").applyInArrow(_best, "tree int, node int, place int, bin int, gain double").collect()  # at most 2**level a tree
        alive = [np.zeros(2 ** (level + 1), bool) for _ in trees]
        for s in splits:
            t, at = trees[s["tree"]], s["node"] + 2**level - 1
            feature = t["subsets"][s["node"], s["place"]]
            t["feature"][at], t["bin"][at] = feature, s["bin"]
            t["gains"][feature] += s["gain"]
            alive[s["tree"]][2 * s["node"] : 2 * s["node"] + 2] = True
        for t, a in zip(trees, alive, strict=True):
            t["alive"], t["open"] = a, bool(a.any())
    found = []
    for f in range(len(inputs)):
        shares = [t["gains"] / t["gains"].sum() for t in trees if t["forest"] == f and t["gains"].sum() > 0]
        total = np.sum(shares, axis=0) if shares else np.zeros(len(inputs[f]))
        found.append(total / total.sum() if total.sum() > 0 else total)
    return found
