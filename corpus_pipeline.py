"""Corpus pipeline: quality rules, line deduplication, SimHash near-deduplication, packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqsieve.llm.line_dedup import remove_boilerplate
from seqsieve.llm.packing import pack
from seqsieve.llm.quality import judge
from seqsieve.llm.queries import tokenizer_path
from seqsieve.llm.shingle_similarity import first_of_similar
from seqsieve.plans.materialise import digest_key, free_name, materialise


def row_key(docs: DataFrame) -> Column:
    """A key of all columns, the text last: equal for rows that are alike in everything, whatever their ids."""
    return digest_key(*[F.col(c) for c in docs.columns if c != "text"], F.col("text"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, each row by its own verdict: null and repeated ids stay apart, equal rows share one.

    Short clean documents stay: those below the operator's length guard have too few words to be
    held against references, so the least number of words is one. Null and empty texts go. An
    empty table gives an empty result; columns other than those of docs never appear, and those
    of docs may have any names.
    """
    key = free_name(docs, "key")
    keyed = docs.withColumn(key, row_key(docs))
    kept = judge(keyed, min_words=1, key_col=key).where("kept").select(F.col("row_key").alias(key)).distinct()
    return keyed.join(kept, key, "left_semi").select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without boilerplate lines; those of which nothing is left go, as all their lines stand elsewhere.

    A null text stays null; rows that repeat an id with another text stay apart; columns of docs
    may have any names. An empty table gives an empty result.
    """
    own = [c for c in docs.columns if c in ("n_lines", "n_removed")]  # columns that the operator would replace
    kept = {c: free_name(docs, c) for c in own}
    done = remove_boilerplate(docs.withColumnsRenamed(kept))
    left = done.where(~((F.col("n_removed") > 0) & (F.trim(F.translate("text", "\t\r\n\v\f", "     ")) == "")))
    changed = left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")))
    return changed.select([F.col(kept.get(c, c)).alias(c) for c in docs.columns])


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each group of near-duplicates: five-word shingles of a Jaccard similarity of 0.8 or more, verified on the whole sets.

    Candidates are those of operator 7 (Golay keys of SimHash fingerprints), which reach 2 bits
    of 64, and MinHash bands, as texts of that similarity differ in some 10 bits.

    A null id comes last; of equal ids the smaller row key stays. So rows with null or repeated
    ids go only as duplicates of a row that stays. Rows that are alike in all columns are one.
    Columns of docs may have any names. An empty table gives an empty result.
    """
    key = free_name(docs, "key")
    keyed = docs.withColumn(key, row_key(docs))
    first = first_of_similar(keyed, key_col=key).withColumnRenamed("key", key)
    return keyed.join(first, key, "left_semi").dropDuplicates([key]).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences, of every row, whatever its id; a null text is an end id alone. Columns of docs may have any names. An empty table gives no pieces."""
    packed = pack(docs, tokenizer_path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", "window")


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("simhash_dedup", simhash_dedup), ("packing", packing)]

#: Hashes of shingles, tokenizers and learned references have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
