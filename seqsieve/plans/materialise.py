"""Lineage cuts and skew-safe joins shared by the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with more than 1 / HOT_SHARE of all rows counts as hot; so there are fewer than HOT_SHARE hot keys.
HOT_SHARE = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only a local session, whose executors are the driver itself, may leave it unset: a temporary
    folder takes its place. On a cluster that is an error, as each machine would write to its own disk.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="seqsieve-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


#: Folders of tables written inside the innermost scopes.
_scopes: list[list[str]] = []


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables that materialise writes inside are deleted on exit, so results must be written or collected before."""
    _scopes.append([])
    try:
        yield
    finally:
        for at in _scopes.pop():
            path = spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and return the written table: its lineage ends there. Within a scope the table goes with it; else it stays until the folder is cleared."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/seqsieve/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    if _scopes:
        _scopes[-1].append(at)
    return spark.read.schema(df.schema).parquet(at)


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of many rows to one group row per key, where groups.<size> is the number of rows of the key.

    Groups of more than total / HOT_SHARE rows number fewer than HOT_SHARE, whatever the
    data, so they are broadcast and their rows stay where they are; all other groups are
    small and take the ordinary shuffle join. rows should be a written table: it is read twice.
    """
    bar = total / HOT_SHARE
    hot, cold = groups.where(F.col(size) > bar), groups.where(F.col(size) <= bar)
    names = F.broadcast(hot.select(key))
    return (
        rows.join(F.broadcast(hot), key)
        .unionByName(rows.join(names, key, "left_anti").join(cold, key))
    )


def digest_key(*cols: Column) -> Column:
    """A 128-bit key of the columns' values; nulls differ from any text."""
    parts = [F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit("n")) for c in cols]
    return F.unhex(F.md5(F.concat_ws("\u0001", *parts)))


def free_name(df: DataFrame, name: str) -> str:
    """A column name, led by underscores, that df doesn't have in any case."""
    known = {c.lower() for c in df.columns}
    while name.lower() in known or not name.startswith("_"):
        name = f"_{name}"
    return name
