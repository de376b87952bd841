"""Returned labels as they arrive: a file stream whose micro-batches run the ledger's checks, once each."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seqsieve.operators.ledger import judge_returns

#: Folders by candidate in which accepted rows stand.
BUCKETS = 64
RETURNS = "ord long, batch_id string, candidate_id string, sequence string, measured double, status string, protocol_id string"
JUDGED = f"{RETURNS}, outcome string, reason string"


def read_judged(spark: SparkSession, at: str) -> DataFrame:
    """All judged rows written so far; an empty table before the first."""
    try:
        return spark.read.schema(f"{JUDGED}, micro_batch long").parquet(at)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], f"{JUDGED}, micro_batch long")


def ingest(spark: SparkSession, files: str, batches: DataFrame, out: str, checkpoint: str, protocol: str, *, file_format: str = "parquet", files_per_trigger: int = 1000) -> StreamingQuery:
    """Judge arriving files of returned labels against the batches and all rows accepted before.

    Each micro-batch writes its own directory micro_batch=N and overwrites it if the batch is
    replayed, reading as accepted only what earlier micro-batches wrote; so a replay after a
    crash gives the same rows and nothing twice. State is keyed by candidate, not time: what a
    micro-batch accepts is also written apart, in a folder by a hash of the candidate, so a
    later one reads two columns of accepted rows in the hash folders that its own candidates
    fall into, not all judged rows.
    """
    bucket = F.pmod(F.xxhash64("candidate_id"), F.lit(BUCKETS)).cast("int")

    def one(df: DataFrame, number: int) -> None:
        wanted = [r["bucket"] for r in df.select(bucket.alias("bucket")).distinct().collect() if r["bucket"] is not None]  # BUCKETS at most
        try:
            before = spark.read.schema("candidate_id string, measured double, bucket int, micro_batch long").parquet(f"{out}_accepted")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            before = spark.createDataFrame([], "candidate_id string, measured double, bucket int, micro_batch long")
        accepted = before.where((F.col("micro_batch") < number) & F.col("bucket").isin(wanted)).select("candidate_id", "measured")
        judged = judge_returns(df, batches, accepted, F.substring(F.md5(F.col("sequence").cast("binary")), 1, 16), protocol)
        judged.write.mode("overwrite").parquet(f"{out}/micro_batch={number}")
        kept = spark.read.schema(JUDGED).parquet(f"{out}/micro_batch={number}").where("outcome = 'accepted'")
        kept.select("candidate_id", "measured", bucket.alias("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{out}_accepted/micro_batch={number}")

    stream = spark.readStream.schema(RETURNS).format(file_format).option("maxFilesPerTrigger", files_per_trigger).load(files)
    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
