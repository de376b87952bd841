"""Token alignment against the tokenizers' own output on whole texts."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from seqsieve.llm.alignment import HOT_PAIRS, align_documents, byte_level_table, link_measures, pair_counts
from seqsieve.llm.queries import QUERIES, tokenizer_path

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
BITS = [" ", "  ", "\n", " \n", "\t", " ", " ", "　", "\x00", "\x1c", "\x85", "a", "don't", "The", "the", "hello", ".", ",", "!!", "123", "é", "ß", "日本", "😀", "<|endoftext|>", "<s>", "<unk>", "<0x41>", "▁", "é", "ﬁ", "½", "​", "عربى", "https://x.y/z?a=b", "&&", "�", "\U0010ffff"]


@pytest.fixture(scope="module")
def brute():
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(tokenizer_path(A))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(B))
    letters = byte_level_table()
    raw_a = {i: bytes(letters[c] for c in p) for p, i in first.get_vocab().items() if all(c in letters for c in p)}
    raw_b = [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in range(second.vocab_size())]

    def one(text):
        """(ids a, ids b, groups as written, links) of a text, or None."""
        if not text:
            return None
        a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
        whole = (" " + text).encode()
        if b"".join(raw_a.get(i, b"?") for i in a) != whole or b"".join(raw_b[i] for i in b) != whole:
            return None
        groups, links, x, y = [], [], [], []
        i = j = at_a = at_b = 0
        while i < len(a) or j < len(b):
            if at_a <= at_b:
                at_a, i, x = at_a + len(raw_a[a[i]]), i + 1, [*x, a[i]]
            else:
                at_b, j, y = at_b + len(raw_b[b[j]]), j + 1, [*y, b[j]]
            if at_a == at_b:
                groups.append(",".join(map(str, x)) + "|" + ",".join(map(str, y)))
                links.append((x[-1], y[-1]))
                x, y = [], []
        return a, b, ";".join(groups), links

    def run(rows):
        found = {t: one(t) for t in {t for _, t in rows}}
        counts = Counter(k for _, t in rows if found[t] for k in found[t][3])
        most = Counter()
        for (_, b), n in counts.items():
            most[b] = max(most[b], n)
        out = []
        for i, t in rows:
            if found[t]:
                a, b, said, links = found[t]
                out.append((i, len(a), len(b), len(links), len(links), sum(counts[k] == most[k[1]] for k in links), sum(counts[k] for k in links), hashlib.sha256(said.encode()).hexdigest()))
            else:
                out.append((i, 0, 0, 0, 0, 0, 0, ""))
        return sorted(map(str, out))

    return run


def test_rare_texts(spark, brute):
    rnd = random.Random(3)
    rows = [(i, "".join(rnd.choice(BITS) for _ in range(rnd.randint(1, 20)))) for i in range(1500)]
    rows += [(None, "the null id"), (None, None), (7, "the null id"), (8, ""), (9, " "), (10, "  "), (11, "word " * 40_000), (12, "x" * 30_000)] + [(100 + i, "copied text, the same") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    more = docs
    for name in ("sha", "n", "a", "b", "times", "count", "best", "hot", "n_best", "rows"):
        more = more.withColumn(name, F.lit("x"))
    got = align_documents(more.repartition(5), tokenizer_path(A), tokenizer_path(B)).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows)
    assert align_documents(docs.limit(0), tokenizer_path(A), tokenizer_path(B)).collect() == []


def test_rare_and_frequent_pairs_add_up(spark):
    """Most rows are of one pair; the others are below the share that is broadcast."""
    n = 2 * HOT_PAIRS
    rare = spark.range(n).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("sha"), F.lit(1).cast("long").alias("n"), F.array(F.col("id").cast("int"), F.lit(-1)).alias("a"), F.array((F.col("id") % 7).cast("int"), F.lit(-1)).alias("b"), F.array(F.lit(1), F.lit(2)).alias("times"))
    sums = link_measures(rare, pair_counts(rare)).agg(F.count("*"), F.sum("n_best"), F.sum("count_sum")).first()
    assert tuple(sums) == (n, 3 * n, n + 2 * n * 2 * n)  # every pair of a b occurs once, so all are best


def test_query_equals_the_libraries(spark, brute):
    small = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op13_alignment"](spark, small).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows)
