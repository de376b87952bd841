"""PPM scores against a textbook recursion over counts of bytes, from end to end."""

import math
import tracemalloc
import random
import zlib
from collections import Counter

import pytest

pytest.importorskip("seqsieve.llm")

import numpy as np  # noqa: E402
import pyarrow as pa  # noqa: E402

from seqsieve.llm import ppm  # noqa: E402


def brute(rows, order):
    """log10 probability of each (id, text) by counts of contexts of 0 to order bytes, method C with exclusion."""
    plain = lambda t: b" ".join((t or "").encode().lower().split()) + b"\n"
    nodes = {}
    for i, t in rows:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2:
            x = b"\n" * order + plain(t)
            for at in range(order, len(x)):
                for k in range(order + 1):
                    nodes.setdefault(x[at - k : at], Counter())[x[at]] += 1

    def p(context, byte):
        out, gone = 1.0, set()
        for k in range(order, -1, -1):
            left = {b: n for b, n in nodes.get(context[order - k :], {}).items() if b not in gone}
            total, kinds = sum(left.values()), len(left) if len(left) + len(gone) < 256 else 0
            if byte in left:
                return out * left[byte] / (total + kinds)
            if kinds:
                out *= kinds / (total + kinds)
            gone |= set(left)
        return out / (256 - len(gone))

    scores = []
    for _, t in rows:
        x = b"\n" * order + plain(t)
        scores.append(sum(math.log10(p(x[at - order : at], x[at])) for at in range(order, len(x))))
    return scores, p


def documents():
    r = random.Random(3)
    words = "the river of old paper a garden in village Ünïcödé 日本語 x2 é-- THE River".split()
    rows = [(i, " ".join(r.choices(words, k=r.randrange(0, 60)))) for i in range(60)]
    return rows + [(1, None), (2, ""), (2, " \n\t "), (None, "no id"), (3, "q" * 3000), (4, "never seen zzz ŧŧŧ \u0001"), (4, "never seen zzz ŧŧŧ \u0001"), (5, "it\ncut\tby  blanks")]


@pytest.mark.parametrize(("order", "block", "part"), [(5, 1 << 20, 1 << 18), (5, 500, 100), (2, 2000, 2000), (6, 700, 200), (1, 300, 300)])
def test_score_against_recursion(spark, order, block, part):
    rows = documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("block", docs_column()).withColumn("held", docs_column()).withColumn("run", docs_column()).repartition(3)
    got = sorted((str(r["doc_id"]), round(r["score"], 6)) for r in ppm.score_documents(docs, order=order, block_bytes=block, slice_bytes=part).collect())
    want = sorted((str(i), round(s, 6)) for (i, _), s in zip(rows, brute(rows, order)[0], strict=True))
    assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([s for _, s in got], [s for _, s in want], rtol=1e-7, atol=2e-6)


def docs_column():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_every_distribution_sums_to_one(spark):
    _, p = brute(documents(), 3)
    for context in (b"the", b"\n\n\n", b"zzz", b"qqq", b"n o"):
        assert abs(sum(p(context, b) for b in range(256)) - 1) < 1e-9


def test_table_and_sort_give_the_same_runs(monkeypatch):
    raw = np.random.default_rng(4).integers(0, 256, 20_000).astype(np.uint8)
    index, code = ppm.runs(raw, 5)
    monkeypatch.setattr(ppm, "TABLE_CELLS", 10)
    other, same = ppm.runs(raw, 5)
    assert (index == other).all() and (code == same).all() and len(index) == len(raw) - 5
    assert all(int.from_bytes(raw[i : i + 6].tobytes(), "big") == code[index[i]] for i in range(0, 19_000, 997))


def test_no_training_text(spark):
    held = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 7 == 2)
    got = ppm.score_documents(spark.createDataFrame([(held, "ab")], "doc_id long, text string")).collect()
    assert len(got) == 1 and got[0]["train_tokens"] == 0 and abs(got[0]["score"] + 3 * math.log10(256)) < 1e-9


def test_words_that_share_a_number_get_new_ones(monkeypatch):
    real, seeds = ppm.xxhash.xxh3_64_intdigest, []
    monkeypatch.setattr(ppm.xxhash, "xxh3_64_intdigest", lambda w, seed: (seeds.append(seed), 12 if seed == 0 else real(w, seed))[1])
    block = ppm.Block(0)
    part = ppm.Slice([ppm.normal(b"one two three")], 2)
    block.add(part, np.ones(1, bool))
    keys = [k for b in block.vocabulary() for k in b["key"].to_pylist()]
    assert block.seed == 1 and len(set(keys)) == len(keys)


def test_order_of_known_words_matters(spark):
    words = "alpha beta gamma delta epsilon zeta".split()
    rows = [(k, " ".join(words)) for k in range(40)] + [(1000, " ".join(words)), (1001, "gamma alpha zeta beta epsilon delta")]
    got = {r["doc_id"]: r for r in ppm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1000]["n_known"] == got[1001]["n_known"] == 7 and got[1000]["score"] - got[1001]["score"] > 1


def test_places_of_a_large_table_take_two_bytes_a_cell_at_most(monkeypatch):
    """op8 of round 3: a whole table of places took five."""
    monkeypatch.setattr(ppm, "PLACE_CELLS", 10)
    cell = np.random.default_rng(1).integers(0, 1 << 22, 5_000).astype(np.int32)
    tracemalloc.start()
    found, index = ppm.places(cell, 1 << 22)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 << 22 and (found == np.unique(cell)).all() and (found[index] == cell).all()


def test_blocks_are_scored_as_their_rows_come():
    """op8 of round 3: a task holds one block's keys and values, however its rows fall into batches."""
    blocks = []
    for name, text in ((3, b"one two one"), (8, b"three three")):
        block, part = ppm.Block(name), ppm.Slice([ppm.normal(text)], 2)
        block.add(part, np.ones(1, bool))
        keys = sorted(k for b in block.vocabulary() for k in b["key"].to_pylist())
        pack = {"n": block.seed, "meta": np.array([(name, 0, len(text) + 1)], np.int64).tobytes(), "texts": ppm.zstandard.compress(ppm.normal(text))}
        blocks += [*[(name, k, -1.0 if k >= 0 else 2.0, None) for k in keys[::-1]], (name, None, None, pack)]
    kinds = pa.schema([("block", pa.int64()), ("key", pa.int64()), ("value", pa.float64()), ("pack", pa.struct([("n", pa.int64()), ("meta", pa.binary()), ("texts", pa.binary())]))])
    for size in (1, 4, 100):
        batches = [pa.RecordBatch.from_pylist([dict(zip(kinds.names, r, strict=True)) for r in blocks[i : i + size]], kinds) for i in range(0, len(blocks), size)]
        got = [r for b in ppm.block_scores(2, iter(batches)) for r in b.to_pylist()]
        assert [(r["doc_id"], r["n_tokens"], r["n_known"], r["score"], r["v_part"]) for r in got] == [(3, 4, 4, -12.0, 3), (8, 3, 3, -12.0, 2)]
