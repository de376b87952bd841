"""Document quality by a linear-chain conditional random field over lines.

Every line with a word is good or bad. Its potential comes from features of its own and of
the lines before and behind it, and neighbouring labels are tied by transition potentials;
forward and backward messages give each line's exact marginal. A document's quality is the
mean of its lines' marginals, weighted by their lengths, and a logistic curve turns that into
the probability of label 1.

Labels are of documents, not lines. So the field is first fitted with every line labelled as
its document, then again with the lines of bad documents labelled by their own marginals (the
worst line of each stays bad), as a bad document may hold good lines.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqsieve.plans.workers import release_memory

#: Labelled documents that the fit reads at most, those with the least md5 of their id, and lines that each of them may have.
MAX_LABELLED, MAX_LINES = 3000, 1000
#: Upper edges of the bins of shares; counts have one bin for each power of two.
EDGES = np.array([0.001, 0.01, 0.03, 0.1, 0.2, 0.35, 0.6, 0.9])
BINS = 16
FEATURES = ("chars", "words", "upper", "digit", "symbol", "bar", "shout", "stop", "wide", "mark", "marked", "repeats", "adjacent", "mean", "closed", "capital", "again", "shared", "first", "last")
SIZE = len(FEATURES) * BINS
#: Places of a missing neighbour before and behind.
NO_BEFORE, NO_BEHIND = 3 * SIZE, 3 * SIZE + 1


def _marked(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


CLASSES = {"upper": bytes(range(65, 91)), "digit": b"0123456789", "symbol": b"#*$%&<>", "bar": b"|", "shout": b"!?", "stop": b".,;:", "wide": bytes(range(192, 256)), "mark": b"\"'()+-/=@[\\]^_`{}~"}
TABLES = {name: _marked(chars) for name, chars in CLASSES.items()}
MARKS = _marked(bytes(b for b in range(33, 127) if not chr(b).isalnum()))
BLANKS = _marked(b" \t\n\v\f\r")


def lines_of(text: str | None) -> list[bytes]:
    """The lines that have a word, without outer white space."""
    return [line for line in (x.strip() for x in (text or "").encode("utf-8", "surrogatepass").split(b"\n")) if line]


def _powers(values: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(values.astype(np.float64) + 1).astype(np.int64), BINS - 1)


def _shares(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.searchsorted(EDGES, part / np.maximum(whole, 1), side="left")


def line_features(docs: Sequence[Sequence[bytes]]) -> np.ndarray:
    """(lines, FEATURES) bins of all lines of some documents, one document after the other."""
    flat = [line for lines in docs for line in lines]
    n = len(flat)
    out = np.zeros((n, len(FEATURES)), np.int64)
    if not n:
        return out
    at = {name: i for i, name in enumerate(FEATURES)}
    size = np.array(list(map(len, flat)), np.int64)
    raw = np.frombuffer(b"\n".join([*flat, b""]), np.uint8)  # a line break ends each
    starts = np.cumsum(size + 1) - size - 1
    for name, table in TABLES.items():
        out[:, at[name]] = _shares(np.add.reduceat(table[raw], starts, dtype=np.int64), size)
    marked = np.add.reduceat(np.append(MARKS[raw[:-1]] & BLANKS[raw[1:]], False), starts, dtype=np.int64)
    words, distinct, adjacent, shared, again = (np.zeros(n, np.int64) for _ in range(5))
    k = 0
    for lines in docs:
        seen: set[bytes] = set()
        before: set[bytes] = set()
        for line in lines:
            own = line.split()
            kinds = set(own)
            words[k], distinct[k] = len(own), len(kinds)
            adjacent[k] = sum(map(eq, own, own[1:]))
            shared[k] = len(kinds & before)
            again[k] = line in seen
            seen.add(line)
            before = kinds
            k += 1
    ends = raw[starts + size - 1]
    out[:, at["chars"]], out[:, at["words"]] = _powers(size), _powers(words)
    out[:, at["marked"]] = _shares(marked, words)
    out[:, at["repeats"]] = _shares(words - distinct, words)
    out[:, at["adjacent"]] = _shares(adjacent, words)
    out[:, at["mean"]] = np.minimum(size // np.maximum(words, 1), BINS - 1)
    out[:, at["closed"]] = (ends == 46) | (ends == 33) | (ends == 63)
    out[:, at["capital"]] = TABLES["upper"][raw[starts]] | (raw[starts] >= 192)
    out[:, at["again"]] = again
    out[:, at["shared"]] = _shares(shared, distinct)
    counts = np.array(list(map(len, docs)), np.int64)
    counts = counts[counts > 0]
    out[np.cumsum(counts) - counts, at["first"]] = 1
    out[np.cumsum(counts) - 1, at["last"]] = 1
    return out


class Chains:
    """Lines of several documents, as chains."""

    def __init__(self, bins: np.ndarray, counts: np.ndarray) -> None:
        """counts: the lines of each document, none of them 0."""
        places = bins + np.arange(len(FEATURES)) * BINS
        n = len(bins)
        first = np.repeat(np.cumsum(counts) - counts, counts)
        self.place = np.arange(n) - first
        self.rest = np.repeat(counts, counts) - 1 - self.place
        self.begins, self.ends = self.place == 0, self.rest == 0
        before, behind = np.roll(places, 1, axis=0) + SIZE, np.roll(places, -1, axis=0) + 2 * SIZE
        before[self.begins], behind[self.ends] = NO_BEFORE, NO_BEHIND
        self.places = np.concatenate([places, before, behind], axis=1)

    def potentials(self, weights: np.ndarray) -> np.ndarray:
        """Log potential of good against bad of each line."""
        return weights[self.places].sum(axis=1)

    def messages(self, unary: np.ndarray, ties: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(forward, backward) log messages of each line and label, up to a constant a line.

        ties[a, b] is the log potential of label a before label b. Products of the lines' 2 x 2
        matrices over ever longer stretches, so the rounds grow with the logarithm of the
        longest chain.
        """
        own = np.stack([np.zeros(len(unary)), unary], axis=1)
        ahead = ties[None] + own[:, None, :]
        ahead[self.begins] = own[self.begins][:, None, :]
        back = np.zeros_like(ahead)
        back[:-1] = ties[None] + own[1:, None, :]
        back[self.ends] = np.array([[0.0, -np.inf], [0.0, -np.inf]])
        step = 1
        while (live := np.flatnonzero(self.place >= step)).size:
            ahead[live] = _chain(ahead[live - step], ahead[live])
            step *= 2
        step = 1
        while (live := np.flatnonzero(self.rest >= step)).size:
            back[live] = _chain(back[live], back[live + step])
            step *= 2
        return ahead[:, 0, :], np.logaddexp(back[:, :, 0], back[:, :, 1])

    def marginals(self, weights: np.ndarray, ties: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(marginal of good, joint marginal [line, label before, own label], zero where a chain begins) of each line."""
        unary = self.potentials(weights)
        ahead, back = self.messages(unary, ties)
        belief = ahead + back
        good = 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500)))
        own = np.stack([np.zeros(len(unary)), unary], axis=1) + back
        joint = np.roll(ahead, 1, axis=0)[:, :, None] + ties[None] + own[:, None, :]
        joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        joint[self.begins] = 0
        return good, joint


def _chain(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of 2 x 2 matrices of logarithms, each scaled to a largest entry of 0."""
    out = np.logaddexp(a[:, :, :1] + b[:, :1, :], a[:, :, 1:] + b[:, 1:, :])
    return out - out.max(axis=(1, 2), keepdims=True)


@dataclass(frozen=True)
class LineModel:
    """weights and ties of the field, the curve (offset, slope) from a document's quality to a probability, and the share of label 1 in training, which is the score of a text without a word."""

    weights: np.ndarray
    ties: np.ndarray
    curve: tuple[float, float]
    prior: float

    def scores(self, docs: Sequence[Sequence[bytes]], bins: np.ndarray | None = None) -> np.ndarray:
        """The probability of label 1 of each document."""
        counts = np.array(list(map(len, docs)), np.int64)
        out = np.full(len(docs), self.prior)
        if counts.any():
            chains = Chains(line_features(docs) if bins is None else bins, counts[counts > 0])
            good, _ = chains.marginals(self.weights, self.ties)
            size = np.array([len(line) for lines in docs for line in lines], np.float64)
            out[counts > 0] = self.probability(quality(good, size, counts[counts > 0]))
        return out

    def probability(self, good: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] - self.curve[1] * np.log(1 - good + FLOOR), -500, 500)))


#: Share of bad text below which documents are alike.
FLOOR = 1e-3


def quality(good: np.ndarray, size: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The mean of the marginals of each document's lines, weighted by their lengths."""
    starts = np.cumsum(counts) - counts
    return np.clip(np.add.reduceat(good * size, starts) / np.add.reduceat(size, starts), 0, 1)


def fit_field(chains: Chains, y: np.ndarray, weight: np.ndarray, weights: np.ndarray, ties: np.ndarray, rounds: int, rate: float, penalty: float, tied: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(weights, ties) that raise the labels' likelihood, by momentum over the gradient: observed minus expected statistics, a line counted by its weight. Unless tied, a line counts by itself: only the weights of its own features move."""
    inner = np.flatnonzero(~chains.begins)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[inner - 1], y[inner]), weight[inner])
    total, columns = weight.sum(), chains.places.shape[1]
    first_w, first_t = np.zeros_like(weights), np.zeros_like(ties)
    second_w, second_t = np.zeros_like(weights), np.zeros_like(ties)
    for k in range(1, rounds + 1):
        good, joint = chains.marginals(weights, ties)
        push = (y - good) * weight / total
        slope_w = np.bincount(chains.places.ravel(), np.repeat(push, columns), len(weights)) - penalty * weights
        if not tied:
            slope_w[SIZE:] = 0
        slope_t = (seen - (joint * weight[:, None, None]).sum(axis=0)) / total - penalty * ties
        first_w, first_t = 0.9 * first_w + 0.1 * slope_w, 0.9 * first_t + 0.1 * slope_t
        second_w, second_t = 0.99 * second_w + 0.01 * slope_w**2, 0.99 * second_t + 0.01 * slope_t**2
        scale, grown = rate / (1 - 0.9**k), 1 - 0.99**k
        weights = weights + scale * first_w / (np.sqrt(second_w / grown) + 1e-6)
        if tied:
            ties = ties + scale * first_t / (np.sqrt(second_t / grown) + 1e-6)
    return weights, ties


def fit_curve(x: np.ndarray, y: np.ndarray, rounds: int = 30) -> tuple[float, float]:
    """(offset, slope) of a logistic curve offset - slope * x, by Newton's method with a slight penalty; the slope is not negative."""
    rows, beta = np.stack([np.ones_like(x), -x], axis=1), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(rows @ beta, -30, 30)))
        slope = rows.T @ (y - p) - 1e-2 * beta
        bend = (rows * (p * (1 - p))[:, None]).T @ rows + 1e-2 * np.eye(2)
        beta = beta + np.linalg.solve(bend, slope)
    return float(beta[0]), max(0.0, float(beta[1]))


def train(bins: np.ndarray, counts: np.ndarray, size: np.ndarray, labels: np.ndarray, *, rounds: int = 50, passes: int = 3, rate: float = 0.15, penalty: float = 1e-5) -> LineModel:
    """The model of labelled documents: bins and sizes of all lines, the lines of each document (none 0), the documents' labels.

    The passes after the first label the lines of bad documents by their own marginals. Lines
    of the rarer label count for more, so both weigh the same. With one label only, or without
    documents, every text gets the share of label 1, or one half.
    """
    labels = np.asarray(labels, np.int64)
    prior = float(labels.mean()) if len(labels) else 0.5
    weights, ties = np.zeros(3 * SIZE + 2), np.zeros((2, 2))
    if not len(labels) or labels.min() == labels.max():
        return LineModel(weights, ties, (float(np.log(max(prior, 1e-3) / max(1 - prior, 1e-3))), 0.0), prior)
    chains, doc = Chains(bins, counts), np.repeat(np.arange(len(counts)), counts)
    y = labels[doc]
    for turn in range(passes):
        if turn:
            good, _ = chains.marginals(weights, ties)
            worst = np.minimum.reduceat(good, np.cumsum(counts) - counts)
            y = np.where(labels[doc] == 1, 1, ((good > 0.5) & (good > worst[doc])).astype(np.int64))
        share = np.bincount(y, minlength=2) / len(y)
        weight = 0.5 / np.maximum(share, 1e-9)[y]
        weights, ties = fit_field(chains, y, weight, weights, ties, rounds, rate, penalty, turn > 0)
    good, _ = chains.marginals(weights, ties)
    curve = fit_curve(np.log(1 - quality(good, size, counts) + FLOOR), labels.astype(np.float64))
    return LineModel(weights, ties, curve, prior)


def fit(docs: DataFrame, labels: DataFrame, *, max_labelled: int = MAX_LABELLED, max_lines: int = MAX_LINES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> LineModel:
    """The model of the documents that labels (id, 0 or 1) names.

    The max_labelled ids with the least md5 are read, and of these the documents of 1 to
    max_lines lines; so what comes to the driver is bounded whatever the tables, and it is the
    bins of lines, not texts. A null label doesn't count; of several labels of an id the mean
    does, from one half on as 1; rows that repeat an id are documents each.
    """
    said = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label")).where("_id IS NOT NULL AND _label IS NOT NULL")
    said = said.groupBy("_id").agg(F.when(F.avg("_label") >= 0.5, 1).otherwise(0).alias("label"))
    some = said.orderBy(F.md5(F.col("_id").cast("string").cast("binary")), "_id").limit(max_labelled)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, text, label in zip(pdf["_id"], pdf["text"], pdf["label"], strict=True):
                lines = lines_of(text)
                if 0 < len(lines) <= max_lines:
                    rows.append((str(i), label, line_features([lines]).astype(np.uint8).tobytes(), np.array(list(map(len, lines)), "<i4").tobytes()))
            yield pd.DataFrame(rows, columns=["id", "label", "bins", "sizes"])

    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(some), "_id")
    found = texts.mapInPandas(run, "id string, label int, bins binary, sizes binary").toPandas()
    found = found.sort_values(["id", "bins"], kind="stable")
    bins = np.frombuffer(b"".join(found["bins"]), np.uint8).reshape(-1, len(FEATURES)).astype(np.int64)
    sizes = [np.frombuffer(x, "<i4") for x in found["sizes"]]
    size = np.concatenate([np.zeros(0), *sizes])
    return train(bins, np.array(list(map(len, sizes)), np.int64), size, found["label"].to_numpy())


def score_documents(docs: DataFrame, labels: DataFrame, *, folds: int = 3, held_fold: int = 1, batch_chars: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Labels are learned from the rows whose CRC-32 of the id, as text, leaves another remainder
    by folds than held_fold; held_out marks the others. A score is of the whole text alone,
    however long: 0 to 1, higher for label 1; a null text, or one without a word, gets the
    share of label 1 in training. A null id is not held out and teaches nothing; repeated rows
    get a row and, with equal texts, a score each; other columns are ignored, whatever their
    names. Without labels every score is one half; an empty table gives an empty result.
    """
    fold = F.crc32(F.col(id_col).cast("string")) % folds
    model = fit(docs.where(fold != held_fold), labels.where(fold != held_fold), id_col=id_col, text_col=text_col, **options)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, part in pdf.groupby(pdf["text"].str.len().fillna(0).cumsum() // batch_chars, sort=False):
                scores = model.scores([lines_of(t) for t in part["text"]])
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "held_out": part["held_out"], "score": scores, "predicted": (scores >= 0.5).astype(np.int32)})
        release_memory()

    held = F.coalesce(fold == held_fold, F.lit(False)).alias("held_out")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held, F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int")
