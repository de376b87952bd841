"""Sources and sinks: CSV, JSON lines, text corpora, versioned tables, file manifests, per-run outputs."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqsieve.functions.constants import BASES


def read_csv(spark: SparkSession, at: str, schema: str) -> DataFrame:
    """A CSV table with a header and a given schema; empty fields and NaN both become null."""
    df = spark.read.schema(schema).option("header", True).option("nullValue", "").option("nanValue", "NaN").csv(at)
    return df.select(*[F.nanvl(c, F.lit(None).cast(t)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def write_csv(df: DataFrame, at: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(at)


def read_many(spark: SparkSession, glob: str, schema: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """All files of a pattern, one row per key: the first by file name and then by order."""
    df = spark.read.schema(schema).option("header", True).csv(glob).withColumn("_file", F.input_file_name())
    rows = df.select(*keys, F.struct("_file", *order, F.struct(*[c for c in df.columns if c != "_file"]).alias("_row")).alias("_ordered"))
    first = rows.groupBy(*keys).agg(F.min("_ordered").alias("_ordered"))  # partial sums: copies of a hot key don't meet in one task
    return first.select("_ordered._row.*")


def append_json(df: DataFrame, at: str) -> None:
    df.write.mode("append").json(at)


def read_json(spark: SparkSession, at: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(at)


def flatten_results(spark: SparkSession, at: str, schema: str, field: str) -> DataFrame:
    """One row per element of an array field of nested JSON documents."""
    return spark.read.schema(schema).option("multiLine", True).json(at).select(F.explode(field).alias("r")).select("r.*")


def publish(df: DataFrame, at: str, version: int) -> None:
    """Write a version of a table and commit it by a row written last, which names its folder. Each call has a folder of its own, so readers never see half a version, not even of one that is published again."""
    name = f"{at}/data/version={version}-{uuid.uuid4().hex}"
    df.write.parquet(name)
    df.sparkSession.range(1).select(F.lit(version).cast("long").alias("version"), F.lit(name).alias("name"), F.current_timestamp().alias("at")).write.mode("append").parquet(f"{at}/commits")


def read_published(spark: SparkSession, at: str) -> DataFrame:
    """The latest committed version, as last published."""
    name = spark.read.parquet(f"{at}/commits").agg(F.max_by("name", F.struct("version", "at"))).first()[0]
    return spark.read.parquet(name)


def file_manifest(spark: SparkSession, at: str, category: Column) -> DataFrame:
    """(path, size_bytes, sha256, category) of all files under a folder, by their contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(at)
    return files.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), category.alias("category"))


def harvest(spark: SparkSession, at: str, schema: str, pattern: str, keys: Sequence[str]) -> DataFrame:
    """All sub-runs' tables with keys taken from their paths by the groups of a regex."""
    df = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(at)
    path = F.input_file_name()
    return df.withColumns({k: F.regexp_extract(path, pattern, i) for i, k in enumerate(keys, 1)})


def load_corpus(lines: DataFrame, text: str, key: str, seed: int, max_length: int, limit: int | None = None) -> DataFrame:
    """(key, sequence): upper-cased lines with T as U, at most max_length long, not empty; a character that is no base becomes one chosen by md5 of (key, position, seed)."""
    clean = F.translate(F.upper(F.trim(text)), "T", "U")

    def base(c: Column, i: Column) -> Column:
        h = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), i.cast("string"), F.lit(str(seed))).cast("binary")), 1, 2), 16, 10).cast("int")
        return F.when(F.instr(F.lit(BASES), c) > 0, c).otherwise(F.substring(F.lit(BASES), h % 4 + 1, F.lit(1)))

    rows = lines.select(key, clean.alias("_t")).where((F.length("_t") > 0) & (F.length("_t") <= max_length))
    out = rows.select(key, F.array_join(F.transform(F.split("_t", ""), base), "").alias("sequence"))
    return out if limit is None else out.orderBy(key).limit(limit)
