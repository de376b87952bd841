"""Quality rules: Jensen-Shannon distance of a document's histograms to language references.

Two histograms describe a document: one of character classes, one of common (function)
words against all others. A language's references are the means over its documents that pass
the base rules, taken twice: the second time without the documents that the first ones would
reject, so junk doesn't shift them. A document far from the references of its language is
rejected, unless it is so short that its histograms say little.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqsieve.plans.materialise import materialise
from seqsieve.plans.workers import release_memory

# Frequent function words of four languages.
COMMON_WORDS = {
    "en": "the of and to in a is that it for was on are as with be by this from or an at not have but you all can had",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass",
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec ou son",
    "es": "de la que el en y a los del se las por un para con no una su al lo como más o pero sus le ha me",
}
#: Classes of characters, by byte of the UTF-8 text: lower, upper, digit, space, newline, stop, other mark, symbol, lead byte of a longer character.
CLASSES = ("lower", "upper", "digit", "space", "line", "stop", "mark", "symbol", "wide")
SYMBOLS = b"#*$%&|<>"
BASE_MIN_WORDS = 50


def _class_table() -> np.ndarray:
    table = np.full(256, CLASSES.index("mark"), np.intp)
    for name, chars in (("lower", range(97, 123)), ("upper", range(65, 91)), ("digit", range(48, 58)), ("space", b" \t\r\v\f"), ("line", b"\n"), ("stop", b".,;:!?'\"()-"), ("symbol", b"#*$%&|<>=+~^_\\/@[]{}"), ("wide", range(192, 256))):
        table[list(chars)] = CLASSES.index(name)
    table[128:192] = len(CLASSES)  # the rest of a longer character counts with its first byte
    return table


VOCABULARY = sorted({w.encode() for words in COMMON_WORDS.values() for w in words.split()})
STATS = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, classes array<double>, words array<double>"


def repeated(words: list[bytes], size: int = 3) -> int:
    """Words that lie in a window of size words found twice or more."""
    if len(words) <= size:
        return 0
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
    _, windows = np.unique(ids, return_inverse=True)
    for step in range(1, size):
        # number the windows of step + 1 words: each from its first step words and the next word
        windows = np.unique(windows[:-1] * len(names) + ids[step:], return_inverse=True)[1]
    twice = np.bincount(windows)[windows] > 1
    covered = np.zeros(len(words), bool)
    for step in range(size):
        covered[step : step + len(twice)] |= twice
    return int(covered.sum())


def text_stats(text: str | None) -> tuple[int, int, int, int, int, list, list]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the two histograms (as shares; empty without a word) of a whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    seen: set[bytes] = set()
    doubles = 0
    for line in raw.split(b"\n"):
        if line in seen:
            doubles += 1
        elif line and not line.isspace():
            seen.add(line)
    classes = np.zeros(len(CLASSES) + 1, np.int64)
    table, view = _TABLE, np.frombuffer(raw, np.uint8)
    counts = np.bincount(view, minlength=256)
    np.add.at(classes, table, counts)
    common = np.zeros(len(VOCABULARY) + 1, np.int64)
    index, other = _INDEX.get, len(VOCABULARY)
    trimmed = raw.lower().translate(None, b".,;:!?").split() if raw else []
    if trimmed:
        common = np.bincount(np.fromiter((index(w, other) for w in trimmed), np.intp, len(trimmed)), minlength=other + 1)
    return (len(words), sum(map(len, words)) - int(counts[128:192].sum()), int(counts[list(SYMBOLS)].sum()), doubles, repeated(words), _shares(classes[:-1]), _shares(common))


def _shares(counts: np.ndarray) -> list[float]:
    total = counts.sum()
    return (counts / total).tolist() if total else []


_TABLE = _class_table()
_INDEX = {w: i for i, w in enumerate(VOCABULARY)}


def document_stats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", key_col: str | None = None) -> DataFrame:
    """One row of counts and histograms per row of docs, with its binary row_key if there is a key_col; no word and empty histograms for a null or empty text."""
    keyed = key_col is not None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in STATS.split(", ")]
        for pdf in batches:
            rows = [(i, lang, *text_stats(t)) for i, lang, t in zip(pdf["doc_id"].astype("Int64"), pdf["lang"], pdf["text"], strict=True)]
            out = pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})
            yield out.assign(row_key=pdf["row_key"]) if keyed else out
        release_memory()

    key = [F.col(key_col).alias("row_key")] if keyed else []
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), *key)
    return rows.mapInPandas(run, STATS + (", row_key binary" if keyed else ""))


def known_language(lang: Column) -> Column:
    """lang if there is a word list for it, else a common rest; so references are few at any size."""
    return F.when(lang.isin(*COMMON_WORDS), lang).otherwise(F.lit("other"))


def references(stats: DataFrame) -> DataFrame:
    """One row per language (at most one more than word lists): class_ref and word_ref, shares over the documents of stats.

    Each document adds its own shares, so no very long document stands for its language.
    """
    def shares(name: str, size: int) -> list[Column]:
        return [F.avg(F.get(name, i)) for i in range(size)]

    return stats.groupBy(known_language(F.col("lang")).alias("known")).agg(F.array(*shares("classes", len(CLASSES))).alias("class_ref"), F.array(*shares("words", len(VOCABULARY) + 1)).alias("word_ref"))


def distances(stats: DataFrame, refs: DataFrame) -> DataFrame:
    """stats with known, class_distance and word_distance to refs, which are one row per language."""
    known = stats.withColumn("known", known_language(F.col("lang"))).join(F.broadcast(refs), "known", "left")
    return known.withColumn("class_distance", js_distance("classes", "class_ref")).withColumn("word_distance", js_distance("words", "word_ref")).drop("class_ref", "word_ref")


def is_far(max_distance: float, slack: float) -> Column:
    """Whether the sum of the distances passes the limit for the number of words; false for null distances."""
    return F.coalesce(F.col("class_distance") + F.col("word_distance") > max_distance + slack / F.sqrt(F.greatest(F.col("n_words"), F.lit(1))), F.lit(False))


def js_distance(shares: str, reference: str) -> Column:
    """Jensen-Shannon distance, 0 to 1, of two arrays of shares; null if either is empty or null."""

    def half(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    terms = F.zip_with(shares, reference, lambda p, q: half(p, (p + q) / 2) + half(q, (p + q) / 2))
    return F.when((F.size(shares) > 0) & F.get(reference, 0).isNotNull(), F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2)))


def judge(docs: DataFrame, *, min_words: int = BASE_MIN_WORDS, max_distance: float = 0.38, slack: float = 1.0, guard_words: int = 20, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", key_col: str | None = None) -> DataFrame:
    """One row per row of docs: the base counts, base_failed, class_distance, word_distance, kept; and row_key if there is a key_col.

    A document is rejected if the base rules fail it (fewer than min_words words, or over half
    its words in repeated 3-word windows), or if it has guard_words words and the sum of its two
    distances passes max_distance + slack / sqrt(n_words): histograms of few words are noisy, so
    short documents need clearer evidence, and those below the guard are left to the base rules.
    The guard decides only for a min_words below it. The distances of a text without words are
    null and reject nothing; a language of which no document passes the base rules is not held
    against references. Languages without a word list, and null, share one reference. Whole
    texts count, however long; null ids stay null; repeated rows get a row each; other columns
    are ignored, whatever their names; an empty table gives an empty result.
    """
    stats = materialise(document_stats(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, key_col=key_col))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    good, far = stats.where(~failed & (F.col("n_words") >= guard_words)), is_far(max_distance, slack)
    refs = references(distances(good, references(good)).where(~far))  # at most len(COMMON_WORDS) + 1 rows
    scored = distances(stats, refs).withColumn("base_failed", failed)
    odd = (F.col("n_words") >= guard_words) & far
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~odd).alias("kept"), "class_distance", "word_distance", *(["row_key"] if key_col else []))
