"""Document operators against brute force, with nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

pytest.importorskip("seqsieve.llm")
from seqsieve.llm import exact_dedup, licenses, line_dedup, packing, ppm, quality, sentencepiece_sa, simhash_golay  # noqa: E402

WORD = re.compile("[^\x20\x09-\x0d]+")
LONG = " ".join(f"word{i % 977} is" for i in range(30_000))
TEXTS = [
    (1, "The mit license\nSame line of boilerplate", "a"), (2, "the MIT license\nSame line of boilerplate", "b"), (3, None, "a"), (4, "", None), (5, "  \n\t ", "c"),
    (6, LONG, "d"), (7, LONG + " x", "d"), (8, "Ünïcödé ÀÉ 日本語 texts, with \u00a0 odd\u2003spaces", "e"), (9, "one", "f"), (10, "one two", "f"), (11, "one two", "g"),
    (12, "a b a b a b a b a b", "g"), (13, "Same line of boilerplate\n\nother " * 3, "h"), (13, "Same line of boilerplate\n\nother " * 3, "h"), (None, "Same line of boilerplate", "i"),
    (15, "GNU  General-Public\nLicense cc\tby. Apache License, Version 2.0; SPDX-License-Identifier: MIT", "j"), (16, "x" * 200_000, "k"), (17, "\x01mit\x02license", "k"),
]
SCHEMA = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, SCHEMA).withColumn("lang", F.lit("en")).withColumn("n_chars", F.length("text").cast("long")).withColumn("kept", F.lit(1)).withColumn("keep_id", F.lit("x")).withColumn("fp", F.lit(0)).withColumn("n_words", F.lit(0)).withColumn("key", F.lit(0)).withColumn("block", F.lit(0)).withColumn("window", F.lit("w")).withColumn("sites", F.lit(3))


@pytest.fixture(scope="module")
def many(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


def lower(text):
    return (text or "").encode().lower()


def rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.mark.parametrize("limit", [64 << 20, 1000])
def test_exact_owners(docs, limit):
    got = rows(exact_dedup.exact_owners(docs, trie_bytes=limit))
    groups = {}
    for i, t, _ in TEXTS:
        groups.setdefault(lower(t), []).append(i)
    want = sorted((str(i), max((x for x in groups[lower(t)] if x is not None), default=None), len(groups[lower(t)]), hashlib.sha256(lower(t)).hexdigest()) for i, t, _ in TEXTS)
    assert sorted((str(r["doc_id"]), r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) or r["keep_id"] is None for r in got)


def test_trie_against_dict():
    rng = np.random.default_rng(3)
    trie, want = exact_dedup.RadixTrie(max), {}
    for i in range(3000):
        key = bytes(rng.integers(97, 100, rng.integers(0, 8)).tolist())
        trie.insert(key, i, 1)
        o, n = want.get(key, (-1, 0))
        want[key] = (max(o, i), n + 1)
    assert {k: (o, n) for k, o, n in trie.spill()} == want and not list(trie.spill())


def brute_fingerprint(text):
    words = lower(text).split()
    if not words:
        return 0
    grams = [words] if len(words) < 3 else [words[i : i + 3] for i in range(len(words) - 2)]
    ones = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(b" ".join(g), 42)
        for k in range(64):
            ones[k] += h >> k & 1
    return sum(1 << k for k in range(64) if 2 * ones[k] > len(grams))


def components(ids, fps):
    label = list(range(len(fps)))
    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 2 and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for i, x in zip(ids, label, strict=True):
        least[x] = i if least.get(x) is None else least[x] if i is None else min(i, least[x])
    return [least[x] for x in label]


def test_simhash_small(docs):
    got = rows(simhash_golay.near_duplicates(docs))
    fps = [brute_fingerprint(t) for _, t, _ in TEXTS]
    want = sorted((str(i), f"{f:016x}", c) for (i, _, _), f, c in zip(TEXTS, fps, components([i for i, _, _ in TEXTS], fps), strict=True))
    assert sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in got) == want


def test_golay_keys_meet():
    rng = np.random.default_rng(5)
    for _ in range(300):
        a = int(rng.integers(0, 1 << 63))
        b = a
        for bit in rng.choice(64, rng.integers(1, 3), replace=False):
            b ^= 1 << int(bit)
        x, y = simhash_golay.fuzzy_keys(np.array([a, b], np.uint64))
        assert set(x) & set(y) and len(x) <= 18
    words = np.arange(1 << 16)
    index = simhash_golay.decode(words)
    assert index.min() >= 0 and index.max() < 4096


@pytest.mark.parametrize("bucket", [1, 16])
def test_large_buckets_take_the_linear_way(spark, bucket):
    rng = np.random.default_rng(2)
    base = int(rng.integers(0, 1 << 62))
    fps = {base}
    while len(fps) < 80:
        x = base
        for bit in rng.choice(62, rng.integers(0, 5), replace=False):
            x ^= 1 << int(bit)
        fps.add(x)
    fps |= {int(x) for x in rng.integers(0, 1 << 62, 40)}
    fps = sorted(fps)
    df = spark.createDataFrame([(np.uint64(x).astype(np.int64).item(),) for x in fps], "fp long")
    from seqsieve.operators.components import connected_components

    found = {r["id"]: r["component"] for r in connected_components(simhash_golay.near_links(df, bucket)).collect()}
    want = components(fps, fps)
    by_label = {}
    for x, c in zip(fps, want, strict=True):
        by_label.setdefault(c, set()).add(x)
    got = {}
    for x in fps:
        got.setdefault(found.get(x, x), set()).add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, by_label.values()))


def test_quality_counts(docs):
    got = rows(quality.judge(docs))
    want = []
    for i, t, _ in TEXTS:
        w = WORD.findall(t or "")
        grams = list(zip(w, w[1:], w[2:], strict=False))
        times, covered = Counter(grams), set()
        for k, g in enumerate(grams):
            if times[g] > 1:
                covered |= {k, k + 1, k + 2}
        seen, doubles = set(), 0
        for line in (t or "").split("\n"):
            if WORD.search(line):
                doubles += line in seen
                seen.add(line)
        want.append((str(i), len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), doubles, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)))
    assert sorted((str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == sorted(want)
    assert all(not r["kept"] for r in got if r["base_failed"])


def test_quality_keeps_good_and_rejects_junk(spark, many, data):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    got = quality.judge(many).where("NOT base_failed").join(labels, "doc_id")
    share = {r["quality"]: r["k"] for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert share[1] > 0.99 and share[0] < 0.2


def brute_lines(records, least):
    spread, first = {}, {}
    strip = " \t\n\x0b\x0c\r"
    for i, t, s in records:
        for k, line in enumerate((t or "").split("\n") if t is not None else []):
            x = line.strip(strip)
            if x:
                spread.setdefault(x, set()).add(s or "")
                place = (i is not None, i or 0, k)
                first[x] = min(first.get(x, place), place)
    out = []
    for i, t, _ in records:
        if t is None:
            out.append((str(i), 0, 0, None))
            continue
        lines = t.split("\n")
        gone = {k for k, line in enumerate(lines) if len(spread.get(line.strip(strip), ())) >= least and first[line.strip(strip)] != (i is not None, i or 0, k)}
        out.append((str(i), len(lines), len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [2, 3, 5])
def test_line_dedup(docs, least):
    got = line_dedup.remove_boilerplate(docs, min_sites=least)
    assert set(docs.columns) <= set(got.columns)
    assert sorted(((str(r["doc_id"]), r["n_lines"], r["n_removed"], r["text"]) for r in got.collect()), key=str) == brute_lines(TEXTS, least)


def test_line_sketches_beyond_the_band(spark):
    data = [(i * 1000 + s, f"line of {i}\nown {i} {s}", f"site{s}") for i, n in enumerate([3, 95, 99, 100, 101, 105, 140]) for s in range(n)]
    got = line_dedup.remove_boilerplate(spark.createDataFrame(data, SCHEMA), min_sites=100)
    assert sorted(((str(r["doc_id"]), r["n_lines"], r["n_removed"], r["text"]) for r in got.collect()), key=str) == brute_lines(data, 100)


def check_pieces(pieces, ids, sequence, full=True):
    for (i, pos), p in pieces.items():
        at = 0
        for r in sorted(p, key=lambda r: r["start"]):
            part = ids[i][r["start"] : r["start"] + r["length"]]
            assert r["start"] == at and r["length"] == len(part) > 0 and r["doc_tokens"] == len(ids[i])
            assert r["ids_crc32"] == zlib.crc32(part.astype("<u4").tobytes())
            assert (packing.piece_ids(r["ids"], r["id_bytes"]) == part).all()
            at += r["length"]
        assert at == len(ids[i])
    del pos
    by = {}
    for p in pieces.values():
        for r in p:
            by.setdefault(r["sequence_id"], []).append(r)
    for s, p in by.items():
        at = 0
        for r in sorted(p, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == sequence or (s == max(by) and at < sequence)
    assert sorted(by) == list(range(len(by)))


@pytest.mark.parametrize("sequence", [64, 4096])
def test_packing(docs, sequence):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    one = docs.dropDuplicates(["doc_id", "text"])
    ids = {i: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2]) for i, t, _ in TEXTS}
    pieces = {}
    for r in rows(packing.pack(one, path, sequence=sequence, window=4 * sequence)):
        pieces.setdefault((r["doc_id"], 0), []).append(r)
    assert len(pieces) == len({i for i, _, _ in TEXTS})
    check_pieces(pieces, ids, sequence)


def test_packing_holds_targets_in_written_sequences(spark):
    public = pytest.importorskip("public_tokenizers")
    data = [(i, f"word{i} " * (20 + i % 60), "abc"[i % 7 // 3]) for i in range(1500)]
    got = packing.pack(spark.createDataFrame(data, SCHEMA), public.path("word_bpe_49k.json"), sequence=256, window=16, targets={"a": 0.2, "b": 0.3})
    share = {}
    for r in got.groupBy(F.floor(F.col("sequence_id") / 16).alias("w"), "source").agg(F.sum("length").alias("n")).collect():
        share.setdefault(r["w"], {})[r["source"]] = r["n"]
    live = lambda w: {s for s in "abc" if any(share[v].get(s) for v in share if v > w)}
    kinds = set()
    for w in sorted(share):
        if len(share[w]) == len(live(w)) > 1:
            target = {s: {"a": 0.2, "b": 0.3, "c": 0.5}[s] for s in live(w)}
            kinds.add(len(target))
            for s in target:
                assert abs(share[w].get(s, 0) / sum(share[w].values()) - target[s] / sum(target.values())) < 0.12, (w, share[w])
    assert kinds == {2, 3}  # with all sources, and after one has run dry
    with pytest.raises(ValueError, match="shares"):
        packing.pack(spark.createDataFrame(data[:3], SCHEMA), public.path("word_bpe_49k.json"), targets={"a": 0.8, "b": 0.3})


def test_packing_repeated_rows_and_added_tokens(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    odd = ["hello <|endoftext|> world", "<|StartOfText|>x", "a<|startoftext|><|endoftext|>B. C,", thue_morse(4096, "a", "b") + " " + thue_morse(4096, "b", "a")]
    data = [(i, t, "s") for i, t in enumerate(odd)] + [(9, "same row, twice", "s")] * 3 + [(10, None, None)] * 2
    got = packing.pack(spark.createDataFrame(data, SCHEMA), path, sequence=64)
    want = sorted((i, len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1) for i, t, _ in data)
    assert sorted((r["doc_id"], r["n"]) for r in got.groupBy("doc_id").agg((F.sum("length")).alias("n")).collect()) == sorted({i: n * sum(x[0] == i for x in data) for i, n in want}.items())
    for r in got.where("doc_id < 4").collect():
        ids = np.array(tokenizer.encode(odd[r["doc_id"]], add_special_tokens=False).ids + [2])
        assert (packing.piece_ids(r["ids"], r["id_bytes"]) == ids[r["start"] : r["start"] + r["length"]]).all()


def thue_morse(n, a, b):
    return "".join((a, b)[i.bit_count() % 2] for i in range(n))


@pytest.mark.parametrize("texts", [["a"], ["one"], ["q"], [None], [""], ["x", "x", "x"], [thue_morse(4096, "a", "b") + " " + thue_morse(4096, "b", "a")]])
def test_sentencepiece_on_small_tables(spark, texts):
    public, library = pytest.importorskip("public_tokenizers"), pytest.importorskip("sentencepiece")
    path = public.path("piece_bpe_32k.model")
    model = library.SentencePieceProcessor(model_file=path)
    df = spark.createDataFrame([(1, t) for t in texts], "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("n_ids", F.lit("clash"))
    got = [r["ids"] for r in sentencepiece_sa.encode_documents(df, path).collect()]
    assert got == [None if t is None else model.encode(t) for t in texts]
    assert [r["n_ids"] for r in sentencepiece_sa.digest(df, path).collect()] == [len(model.encode(t or "")) for t in texts]


def test_a_second_batch_with_one_new_unit():
    public, library = pytest.importorskip("public_tokenizers"), pytest.importorskip("sentencepiece")
    path = public.path("piece_bpe_32k.model")
    encoder, model = sentencepiece_sa.Encoder(sentencepiece_sa.pieces_of(path)), library.SentencePieceProcessor(model_file=path)
    for t in ("the river and the town", "the q", "q", "the river zq"):
        assert encoder.encode([t])[0].tolist() == model.encode(t)


def test_line_removal_takes_time_in_proportion(spark):
    import time

    def seconds(n):
        rows = [(i, "\n".join(["shared line"] + [f"line {i} {k} of its own" if k % 3 else f"wide line {k}" for k in range(n)]), f"s{i}") for i in range(12)]
        df = spark.createDataFrame(rows, SCHEMA).cache()
        df.count()
        line_dedup.remove_boilerplate(df).write.format("noop").mode("overwrite").save()
        began = time.time()
        line_dedup.remove_boilerplate(df).write.format("noop").mode("overwrite").save()
        return time.time() - began

    assert seconds(16_000) < 2.5 * seconds(8_000) + 1


def test_quality_distances_against_loop(spark):
    import random

    words = "the of and to in a river market garden window".split()
    rows = [(i, " ".join(random.Random(i).choices(words, k=80)) + ".", "en") for i in range(40)] + [(50 + i, " ".join(f"{w}%%% $$$" for w in random.Random(i).choices(words, k=60)), "en") for i in range(3)] + [(60, "in of", "en"), (61, None, None), (62, "", "xx"), (63, " ".join(random.Random(3).choices(words, k=90)), None)]
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    stats = {i: quality.text_stats(t) for i, t, _ in rows}
    lang = {i: x if x in quality.COMMON_WORDS else "other" for i, _, x in rows}

    def distance(p, q):
        half = lambda x, m: sum(a * math.log2(a / b) for a, b in zip(x, m, strict=True) if a > 0)
        m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
        return math.sqrt(max(0.0, (half(p, m) + half(q, m)) / 2))

    base = {i: s[0] < 50 or 100 * s[4] > 50 * s[0] for i, s in stats.items()}
    refs, members = {}, {i for i in stats if not base[i]}
    for _ in range(2):
        refs = {k: [np.mean([stats[i][at] for i in members if lang[i] == k], axis=0) for at in (5, 6)] for k in {lang[i] for i in members}}
        dist = {i: tuple(distance(stats[i][at], refs[lang[i]][at - 5]) for at in (5, 6)) for i in stats if stats[i][5] and lang[i] in refs}
        far = {i: i in dist and sum(dist[i]) > 0.38 + 1 / math.sqrt(max(1, stats[i][0])) for i in stats}
        members = {i for i in members if not far[i]}
    for i in stats:
        assert got[i]["base_failed"] == base[i] and got[i]["kept"] == (not base[i] and not (stats[i][0] >= 20 and far[i])), i
        assert (got[i]["class_distance"] is None) == (i not in dist) and (i not in dist or abs(got[i]["class_distance"] + got[i]["word_distance"] - sum(dist[i])) < 1e-9)
    assert not any(got[50 + i]["kept"] for i in range(3)) and all(got[i]["kept"] for i in range(40))


def test_ppm_base_and_probabilities(docs):
    got = rows(ppm.score_documents(docs, block_bytes=50_000))
    counts = Counter()
    for i, t, _ in TEXTS:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2:
            counts.update([*lower(t).split(), None])
    n, v = sum(counts.values()), len(counts)
    want = {}
    for i, t, _ in TEXTS:
        w = [*lower(t).split(), None]
        want[str(i)] = (len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w))
    assert len(got) == len(TEXTS)
    for r in got:
        a, b, c, d = want[str(r["doc_id"])]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (a, b, c) and abs(r["base_score"] - d) < 1e-6 * abs(d) + 1e-9
        assert r["score"] < 0 and math.isfinite(r["score"])


def test_sentencepiece_equals_library(spark, many):
    public, library = pytest.importorskip("public_tokenizers"), pytest.importorskip("sentencepiece")
    path = public.path("piece_bpe_32k.model")
    model = library.SentencePieceProcessor(model_file=path)
    texts = [t for _, t, _ in TEXTS if t is not None and len(t) < 10**6] + ["x▁y", "\0a\0", "   lead", "----====", "aaaaaaaaaaaaaaaa"] + [r["text"] for r in many.limit(60).collect()]
    df = spark.createDataFrame(list(enumerate([*texts, None])), "doc_id long, text string")
    coded = sentencepiece_sa.encode_documents(df, path)
    got = {r["doc_id"]: r["ids"] for r in coded.collect()}
    for i, t in enumerate(texts):
        assert got[i] == model.encode(t), t[:80]
    assert got[len(texts)] is None
    back = {r["doc_id"]: r["text"] for r in sentencepiece_sa.decode_documents(coded, path).collect()}
    for i, t in enumerate(texts):
        assert back[i] == t.replace("▁", " ")
    assert all(r["round_trip"] for r in sentencepiece_sa.digest(df, path).collect())


def test_licenses(docs):
    got = rows(licenses.scan(docs))
    want = []
    for i, t, _ in TEXTS:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t).decode())
        places, labels = [], set()
        for phrase, label in licenses.BASE_PHRASES.items():
            p = phrase.split()
            here = [k for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
            places += here
            labels |= {label} if here else set()
        want.append((str(i), len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))))
    assert sorted(map(str, ((str(r["doc_id"]), r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got))) == sorted(map(str, want))
    assert all(0 <= r["score"] <= 1 and set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) for r in got)
    labels = {r["doc_id"]: r["labels"] for r in got}
    assert labels[15] == "apache,cc-by,gpl,mit" and labels[9] == ""


def test_contained_matches_are_suppressed(spark):
    found = spark.createDataFrame([(1, "a", 1, 0.5, 0, 20), (1, "b", 2, 0.5, 5, 10), (1, "c", 1, 0.5, 6, 9), (1, "d", 1, 0.5, 15, 25), (1, "e", 1, 0.5, 0, 20)], "key int, label string, priority int, weight double, start int, stop int")
    assert sorted(r["label"] for r in licenses.suppress(found).collect()) == ["a", "b", "d"]


def test_empty_tables(spark, docs):
    none = docs.where("false")
    public = pytest.importorskip("public_tokenizers")
    for df in (exact_dedup.exact_owners(none), simhash_golay.near_duplicates(none), quality.judge(none), line_dedup.remove_boilerplate(none), licenses.scan(none), ppm.score_documents(none), packing.pack(none, public.path("word_bpe_49k.json")), sentencepiece_sa.digest(none, public.path("piece_bpe_32k.model"))):
        assert df.count() == 0
