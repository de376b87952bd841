"""Sequence predicates and feature columns. Every function gives pure column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqsieve.functions.constants import BASES, CLUSTERS, PAIRS, PROPERTIES, ROLES, RUNS, SITES, STACKING, WILD_TYPE

DIMERS = [a + b for a in BASES for b in BASES]


def normalise(c: Column) -> Column:
    """Upper case, T as U, outer blanks gone, in this order."""
    return F.trim(F.translate(F.upper(c), "T", "U"))


def base_at(s: Column, site: int) -> Column:
    return F.substring(s, site, 1)


def pattern(s: Column) -> Column:
    """The 13 bases at the sites."""
    return F.concat(*[F.substring(s, at, n) for at, n in RUNS])


WILD_PATTERN = "".join(WILD_TYPE[p - 1] for p in SITES)


def fixed_part(s: Column) -> Column:
    """Everything but the sites."""
    return F.concat(F.substring(s, 1, 29), F.substring(s, 34, 55), F.substring(s, 93, 34), F.substring(s, 132, 10_000))


WILD_FIXED = WILD_TYPE[:29] + WILD_TYPE[33:88] + WILD_TYPE[92:126] + WILD_TYPE[131:]


def contract_reason(s: Column) -> Column:
    """Why a sequence breaks its contract: missing, length, alphabet or scaffold; null if it doesn't."""
    return (
        F.when(s.isNull() | (s == ""), "missing").when(F.length(s) != len(WILD_TYPE), "length")
        .when(~s.rlike("^[ACGU]+$"), "alphabet").when(fixed_part(s) != WILD_FIXED, "scaffold")
    )


def candidate_id(s: Column) -> Column:
    """First 16 hex digits of the sha256 of the normalised sequence."""
    return F.substring(F.sha2(normalise(s), 256), 1, 16)


def hamming(a: Column, b: Column, length: int = len(SITES)) -> Column:
    """Differing positions of two strings of the given length."""
    return sum((F.substring(a, i, 1) != F.substring(b, i, 1)).cast("int") for i in range(1, length + 1))


def changed_count(s: Column) -> Column:
    return sum((base_at(s, p) != WILD_TYPE[p - 1]).cast("int") for p in SITES)


def changed_sites(s: Column) -> Column:
    """Sites that differ from the wild type, ascending."""
    return F.array_compact(F.array(*[F.when(base_at(s, p) != WILD_TYPE[p - 1], F.lit(p)) for p in SITES]))


def count_of(s: Column, chars: str) -> Column:
    """How many of the characters of s are among chars."""
    return F.length(s) - F.length(F.translate(s, chars, ""))


def one_hot(s: Column) -> dict[str, Column]:
    """52 columns mut_p<site>_<base>."""
    return {f"mut_p{p}_{b}": (base_at(s, p) == b).cast("int") for p in SITES for b in BASES}


def first_order_names(s: Column) -> Column:
    """Names of the one-hot columns of the changed sites, in order of sites."""
    return F.array_compact(F.array(*[F.when(base_at(s, p) != WILD_TYPE[p - 1], F.concat(F.lit(f"mut_p{p}_"), base_at(s, p))) for p in SITES]))


def site_coverage(df: DataFrame, sequence: str = "sequence") -> DataFrame:
    """(site, n): rows whose sequence is changed at each of the 13 sites, sites without any included."""
    counts = df.agg(*[F.count_if(base_at(F.col(sequence), p) != WILD_TYPE[p - 1]).alias(str(p)) for p in SITES])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(p).alias("site"), F.col(f"`{p}`").alias("n")) for p in SITES])))


def window_at(s: Column, site: int, reach: int) -> tuple[Column, int]:
    """The substring from reach before to reach after a site, cut at the sequence's ends, and its length for a full sequence."""
    first, last = max(1, site - reach), min(len(WILD_TYPE), site + reach)
    return F.substring(s, first, last - first + 1), last - first + 1


def dimers_around(s: Column, reach: int = 5) -> dict[str, Column]:
    """208 columns wd_p<site>_<dimer>: share of each dimer among the overlapping dimers around a site. A row's dimers are counted once for all columns."""
    spans = [(max(1, p - reach), min(len(WILD_TYPE), p + reach)) for p in SITES]
    counts = F.arrow_udf(lambda texts: _lists(texts, dimer_counts(texts, spans)), "array<int>")(s)
    columns = [(p, span, d) for p, span in zip(SITES, spans, strict=True) for d in DIMERS]
    return {f"wd_p{p}_{d}": F.get(counts, i) / F.lit(float(max(1, last - first))) for i, (p, (first, last), d) in enumerate(columns)}


def structure(s: Column) -> dict[str, Column]:
    """43 columns of roles: stem, loop and changed-in-stem of each site, and four totals."""
    changed = {p: (base_at(s, p) != WILD_TYPE[p - 1]).cast("int") for p in SITES}
    out = {}
    for p in SITES:
        out[f"struct_p{p}_is_stem"] = F.lit(int(ROLES[p] == "stem"))
        out[f"struct_p{p}_is_loop"] = F.lit(int(ROLES[p] == "loop"))
        out[f"struct_p{p}_mut_in_stem"] = changed[p] if ROLES[p] == "stem" else F.lit(0)
    out["struct_total_mut"] = sum(changed.values())
    out["struct_stem_mut"] = sum(changed[p] for p in SITES if ROLES[p] == "stem")
    out["struct_loop_mut"] = sum(changed[p] for p in SITES if ROLES[p] == "loop")
    out["struct_broken_pairs"] = sum(changed[p] * (1 - changed[q]) for p, q in PAIRS.items())
    return out


def _lookup(key: Column, table: dict[str, float]) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(0.0))


def stacking(s: Column) -> dict[str, Column]:
    """52 columns: energies of each site with the base before and after, and their differences from the wild type."""
    out = {}
    for p in SITES:
        left, right = _lookup(F.substring(s, p - 1, 2), STACKING), _lookup(F.substring(s, p, 2), STACKING)
        out[f"stack_p{p}_5"], out[f"stack_p{p}_3"] = left, right
        out[f"stack_p{p}_d5"] = left - STACKING[WILD_TYPE[p - 2 : p]]
        out[f"stack_p{p}_d3"] = right - STACKING[WILD_TYPE[p - 1 : p + 1]]
    return out


def properties(s: Column) -> Column:
    """78 chemical classes, six of each site; zeros for an unknown base."""
    table = F.create_map(*[x for b, v in PROPERTIES.items() for x in (F.lit(b), F.array(*map(F.lit, v)))])
    none = F.array(*[F.lit(0)] * 6)
    return F.flatten(F.array(*[F.coalesce(F.try_element_at(table, base_at(s, p)), none) for p in SITES]))


def cluster_composition(s: Column) -> dict[str, Column]:
    """15 columns: the counts of the four bases and the share of G and C in each cluster of sites."""
    out = {}
    for k, sites in enumerate(CLUSTERS):
        part = F.substring(s, sites[0], len(sites))
        out |= {f"cluster{k}_{b}": count_of(part, b) for b in BASES}
        out[f"cluster{k}_gc"] = count_of(part, "GC") / F.lit(float(len(sites)))
    return out


def local_windows(s: Column) -> dict[str, Column]:
    """52 columns: shares of GC and AU within 3 and within 5 bases of each site."""
    out = {}
    for p in SITES:
        for reach in (3, 5):
            w, n = window_at(s, p, reach)
            out[f"local_p{p}_gc{reach}"] = count_of(w, "GC") / F.lit(float(n))
            out[f"local_p{p}_au{reach}"] = count_of(w, "AU") / F.lit(float(n))
    return out


def kmer_deltas(s: Column, sizes: tuple[int, ...] = (1, 2, 3)) -> dict[str, Column]:
    """84 columns: share of each k-mer less its share in the wild type; 0 for k-mers that either sequence lacks. A row's k-mers are counted once for all columns."""
    counts, out = F.arrow_udf(lambda texts: _lists(texts, mer_counts(texts, sizes)), "array<int>")(s), {}
    for k in sizes:
        n = len(WILD_TYPE) - k + 1
        for m in map("".join, product(BASES, repeat=k)):
            wild = sum(WILD_TYPE[i : i + k] == m for i in range(n))
            here = F.get(counts, len(out))
            out[f"kmer_{m}"] = F.when(here > 0, here / F.lit(float(n)) - wild / n).otherwise(F.lit(0.0)) if wild else F.lit(0.0)
    return out


def _letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(codes, starts): the places in BASES of all texts' characters one after another, 4 for another character; and where each text starts, the end included. A null is an empty text."""
    whole = texts.cast(pa.large_string())
    if whole.null_count:
        whole = whole.fill_null("")
    _, offsets, data = whole.buffers()
    starts = np.frombuffer(offsets, np.int64)[whole.offset : whole.offset + len(whole) + 1] if len(whole) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[starts[0] : starts[-1]] if data is not None else np.zeros(0, np.uint8)
    first = (raw & 0xC0) != 0x80  # the first byte of a character
    table = np.full(256, len(BASES), np.uint8)
    table[list(BASES.encode())] = np.arange(len(BASES))
    return table[raw[first]], np.concatenate([[0], np.cumsum(first)])[starts - starts[0]]


def mer_counts(texts: pa.Array, sizes: Sequence[int]) -> np.ndarray:
    """Overlapping occurrences of every k-mer of the sizes in each text, by rows; k-mers in the order of BASES."""
    codes, starts = _letters(texts)
    row, out = np.repeat(np.arange(len(texts)), np.diff(starts)), []
    for k in sizes:
        ends, total = max(0, len(codes) - k + 1), len(BASES) ** k
        number, fine = np.zeros(ends, np.int64), row[:ends] == row[k - 1 :][:ends]
        for i in range(k):
            number, fine = number * len(BASES) + codes[i : i + ends], fine & (codes[i : i + ends] < len(BASES))
        out.append(np.bincount(row[:ends][fine] * total + number[fine], minlength=len(texts) * total).reshape(len(texts), total))
    return np.hstack(out)


def dimer_counts(texts: pa.Array, spans: Sequence[tuple[int, int]]) -> np.ndarray:
    """Occurrences of every dimer at the places from first to before last (from 1) of each span in each text, by rows."""
    codes, starts = _letters(texts)
    width = max(last for _, last in spans)
    at = starts[:-1, None] + np.arange(width)
    padded = np.append(codes, np.uint8(len(BASES)))
    letters = padded[np.where(at < starts[1:, None], at, len(codes))].astype(np.int16)
    known = (letters[:, :-1] < len(BASES)) & (letters[:, 1:] < len(BASES))
    dimers = np.where(known, letters[:, :-1] * len(BASES) + letters[:, 1:], -1)
    return np.hstack([np.stack([(dimers[:, first - 1 : last - 1] == d).sum(axis=1) for d in range(len(DIMERS))], axis=1) for first, last in spans])


def _lists(texts: pa.Array, counts: np.ndarray) -> pa.Array:
    """A list of the counts of each text, null for a null."""
    n, each = counts.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * each, pa.int32()), pa.array(counts.ravel(), pa.int32()), mask=texts.is_null())


def pair_indices(s: Column) -> Column:
    """The 78 active positions among 1248 pair indicators: 16 for each pair of sites."""
    code = {p: F.instr(F.lit(BASES), base_at(s, p)) - 1 for p in SITES}
    return F.array(*[(F.lit(16 * i) + code[a] * 4 + code[b]).cast("int") for i, (a, b) in enumerate(combinations(SITES, 2))])


def summary(s: Column) -> dict[str, Column]:
    """14 summary features of the changes."""
    changed = {p: base_at(s, p) != WILD_TYPE[p - 1] for p in SITES}
    one = lambda c: c.cast("int")
    counts = [sum(one(changed[p]) for p in c) for c in CLUSTERS]
    swap = {"A": "G", "G": "A", "C": "U", "U": "C"}
    transitions = sum(one(base_at(s, p) == swap[WILD_TYPE[p - 1]]) for p in SITES)
    total = sum(one(c) for c in changed.values())

    def classes(was: bool, now: bool) -> Column:
        hits = [one(changed[p] & (base_at(s, p).isin("A", "G") if now else ~base_at(s, p).isin("A", "G"))) for p in SITES if (WILD_TYPE[p - 1] in "AG") == was]
        return sum(hits)

    gc = count_of(pattern(s), "GC")
    wild_gc = sum(b in "GC" for b in WILD_PATTERN)
    return {
        "n_changed": total, "changed_c0": counts[0], "changed_c1": counts[1], "changed_c2": counts[2],
        "transitions": transitions, "transversions": total - transitions,
        "pur_pyr": classes(True, False), "pyr_pur": classes(False, True), "pur_pur": classes(True, True), "pyr_pyr": classes(False, False),
        "max_cluster": F.greatest(*counts), "all_hit": one((counts[0] > 0) & (counts[1] > 0) & (counts[2] > 0)),
        "gc_share": gc / F.lit(13.0), "gc_delta": (gc - wild_gc) / F.lit(13.0),
    }


def identity_matrix(s: Column) -> Column:
    """169 indicators, by rows: the bases at two sites are the same."""
    return F.array(*[(base_at(s, a) == base_at(s, b)).cast("int") for a in SITES for b in SITES])


# Special tokens, then the 64 three-letter words in order of A, C, G, U.
SPECIAL_TOKENS = ("[PAD]", "[CLS]", "[SEP]", "[MASK]", "[UNK]")
VOCABULARY = {t: i for i, t in enumerate([*SPECIAL_TOKENS, *[a + b + c for a in BASES for b in BASES for c in BASES]])}


#: The 64 words, each with a comma after it, so that a word's place tells its number.
_WORDS = "".join(a + b + c + "," for a in BASES for b in BASES for c in BASES)


def tokens(s: Column, special: bool = True) -> Column:
    """Ids of the overlapping 3-mers of the normalised sequence, between [CLS] and [SEP]."""

    def words(n: Column) -> Column:
        at = F.transform(F.sequence(F.lit(1), F.length(n) - 2), lambda i: F.instr(F.lit(_WORDS), F.substring(n, i, F.lit(3))))
        ids = F.transform(at, lambda a: F.when(a % 4 == 1, (a / 4).cast("int") + len(SPECIAL_TOKENS)).otherwise(VOCABULARY["[UNK]"]))
        return F.when(F.length(n) >= 3, ids).otherwise(F.array().cast("array<int>"))

    ids = F.get(F.transform(F.array(normalise(s)), words), 0)  # an argument of a lambda is normalised once, not at each place
    return F.concat(F.array(F.lit(VOCABULARY["[CLS]"])), ids, F.array(F.lit(VOCABULARY["[SEP]"]))) if special else ids


def gc_share(s: Column) -> Column:
    return count_of(s, "GC") / F.length(s).cast("double")


def gc_shift(s: Column) -> Column:
    """Difference of the GC share from the wild type's, without sign."""
    return F.abs(gc_share(s) - sum(b in "GC" for b in WILD_TYPE) / len(WILD_TYPE))
