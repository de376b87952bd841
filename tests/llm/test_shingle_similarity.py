"""Near-duplicates of the pipeline against brute force over shingle sets."""

import random
from collections import defaultdict

import numpy as np
import pytest

pytest.importorskip("seqsieve.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from seqsieve.llm import shingle_similarity as S  # noqa: E402
from seqsieve.llm.simhash_golay import fuzzy_keys  # noqa: E402
from tests.llm.test_documents import brute_fingerprint  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_sets(texts):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def brute_pairs(sets):
    """Pairs with a Jaccard similarity of 0.8 or more, by all shared shingles."""
    where, both = defaultdict(list), defaultdict(int)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    for m in where.values():
        for k, a in enumerate(m):
            for b in m[k + 1 :]:
                both[a, b] += 1
    return [(a, b) for (a, b), n in both.items() if 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n)]


def groups(n, pairs):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        up[max(top(a), top(b))] = min(top(a), top(b))
    return [top(i) for i in range(n)]


def edited(seed, base, edits):
    r, w = random.Random(seed), base.split()
    for i in r.sample(range(len(w)), edits):
        w[i] = f"edit{r.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("bucket", [2, 16])
def test_stage_takes_edited_copies(spark, monkeypatch, bucket):
    monkeypatch.setattr(S.similar_links, "__defaults__", (bucket,))
    base = {k: " ".join(f"w{random.Random(1000 * k + i).randrange(5000)}" for i in range(90)) for k in range(6)}
    texts = [edited(31 * k + e, base[k], e % 4) for k in base for e in range(12)] + [" ".join(base[0].split()[:45] + base[1].split()[45:])]
    sets = brute_sets(texts)
    pairs = brute_pairs(sets)
    far = [(a, b) for a, b in pairs if (brute_fingerprint(texts[a]) ^ brute_fingerprint(texts[b])).bit_count() > 2]
    assert len(far) > 20
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    kept = corpus_pipeline.simhash_dedup(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(groups(len(texts), pairs)))


def test_many_near_copies_in_few_keys(spark, monkeypatch):
    """1,000 distinct near-copies of a template that share most bands, in blocks far smaller than they are."""
    monkeypatch.setattr(S.block_links, "__defaults__", (32,))
    base = " ".join(f"w{random.Random(i).randrange(5000)}" for i in range(200))
    texts = [edited(17 * e, base, 1 + e % 4) for e in range(1000)] + [edited(5 * e, base, 60) for e in range(30)]
    sets = brute_sets(texts)
    want = set(groups(len(texts), brute_pairs(sets)))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    kept = {r["doc_id"] for r in corpus_pipeline.simhash_dedup(spark, docs, "").collect()}
    assert len(want) < 40 and kept == want


def test_golay_pairs_of_a_dense_key(spark):
    """A fingerprint, all its one-bit neighbours, and others far away: all pairs within 2 bits are candidates, though most share no key of 16 or fewer."""
    one = 0x123456789ABCDEF
    fps = [one, *(one ^ (1 << i) for i in range(63)), one ^ 0b111, 0x7FFF0000FFFF0000 & (2**63 - 1)]
    rows = [(bytes([i]) * 16, 1, f) for i, f in enumerate(fps)] + [(bytes([250 + i]) * 16, 1, one) for i in range(3)]
    got = {(r["a"], r["b"]) for r in S.golay_pairs(spark.createDataFrame(rows, "set_key binary, size int, fp long")).collect()}
    want = {(bytes([a]) * 16, bytes([b]) * 16) for a in range(len(fps)) for b in range(a + 1, len(fps)) if (fps[a] ^ fps[b]).bit_count() <= 2}
    assert got == want | {(bytes(16), bytes([250 + i]) * 16) for i in range(3)}


def test_recall_of_golay_keys_and_bands():
    """Of pairs at a similarity of 0.8 to 0.85 bands find nearly all; Golay keys those at 2 or fewer bits, all of them, which is another set."""
    base = [f"w{random.Random(i).randrange(5000)}" for i in range(300)]
    kept, near, both = 0, 0, 0
    for k in range(200):
        a, b = S.shingle_set(" ".join(base)), S.shingle_set(edited(k, " ".join(base), 6))
        assert 0.78 < len(set(a) & set(b)) / len(set(a) | set(b)) < 0.88
        kept += bool((S.band_keys(a) == S.band_keys(b)).any())
        close = (S.majority(a) ^ S.majority(b)).bit_count() <= 2
        near += close
        both += close and any(set(x) & set(y) for x, y in [[fuzzy_keys(np.array([S.majority(v)], np.uint64))[0].tolist() for v in (a, b)]])
    assert kept >= 198 and both == near


def test_recall_on_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    pairs = brute_pairs(brute_sets([t for _, t in rows]))
    kept = {r["doc_id"] for r in corpus_pipeline.simhash_dedup(spark, docs, "").collect()}
    want = {rows[i][0] for i in groups(len(rows), pairs)}
    assert pairs and kept == want


def test_links_of_large_bands_between_blocks(spark, monkeypatch):
    """150 texts near a centre, each with a text near it alone, in bands of many blocks: no link between blocks is lost, whatever stands for a component."""
    monkeypatch.setattr(S.similar_links, "__defaults__", (2,))
    monkeypatch.setattr(S.block_links, "__defaults__", (16,))
    monkeypatch.setattr(S.cross_links, "__defaults__", (8,))
    base = " ".join(f"w{random.Random(i).randrange(5000)}" for i in range(200))
    near = [edited(7 * e + 1, base, 3) for e in range(150)]
    texts = [base, *near, *(edited(7 * e + 2, t, 3) for e, t in enumerate(near))]
    want = set(groups(len(texts), brute_pairs(brute_sets(texts))))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    kept = {r["doc_id"] for r in corpus_pipeline.simhash_dedup(spark, docs, "").collect()}
    assert kept == want
