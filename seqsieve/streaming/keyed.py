"""Returned labels judged by state that is keyed by candidate: its batches, its accepted value, and a timer while it waits."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from seqsieve.operators.ledger import CONFLICT, STATUSES
from seqsieve.streaming.ingest import JUDGED, RETURNS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows whose reason needs no state are spread over so many keys.
SPREAD = 1024


def stateless_reasons(expected_id: Column, protocol: str) -> tuple[Column, Column]:
    """(reasons that come before membership, reasons that come after it) of returned rows that have _known, whether the batch exists."""
    value = F.col("measured")
    odd = value.isNull() | F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    before = (
        F.when(F.col("sequence").isNull() | (F.col("sequence") == ""), "missing_sequence").when(F.col("_known").isNull(), "unknown_batch")
        .when(~F.col("candidate_id").eqNullSafe(expected_id), "id_mismatch")
    )
    after = (
        F.when(F.col("protocol_id").isNull(), "missing_protocol").when(F.col("protocol_id") != protocol, "unapproved_protocol")
        .when(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), "bad_status").when((F.col("status") == "pass") & odd, "not_finite")
    )
    return before, after


class Waiting(StatefulProcessor):
    """State of a candidate: the batches it was exported in, the value that stands, and when its patience ends.

    Rows of a micro-batch are taken in file order, exported members first, so what is judged does
    not depend on how they are split over tasks. The rows of one candidate in one micro-batch
    are held together; files_per_trigger bounds them.
    """

    def __init__(self, patience_ms: int):
        self.patience_ms = patience_ms

    # Names of columns that reach a task must not begin with an underscore.

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.batches = handle.getMapState("batches", "batch_id string", "since long")
        self.value = handle.getValueState("value", "measured double")
        self.due = handle.getValueState("due", "at long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = pd.concat(list(rows), ignore_index=True)
        now = timerValues.getCurrentProcessingTimeInMs()
        for name in held.loc[held["is_member"], "batch_id"].dropna().unique():
            if not self.batches.containsKey((name,)):
                self.batches.updateValue((name,), (now,))
        returned = held[~held["is_member"]].sort_values("ord", kind="stable")
        old = self.value.get()[0] if self.value.exists() else None
        known = {n: self.batches.containsKey((n,)) for n in returned["batch_id"].dropna().unique()}
        first, found = None, []
        for batch, before, after, status, measured in zip(returned["batch_id"], returned["early_reason"], returned["late_reason"], returned["status"], returned["measured"], strict=True):
            reason = before if isinstance(before, str) else "not_in_batch" if not known.get(batch, False) else after if isinstance(after, str) else None
            if reason is None and status == "pass":
                if old is not None:
                    reason = "duplicate" if abs(measured - old) <= CONFLICT else "conflict"
                elif first is not None:
                    reason = "duplicate_in_file" if abs(measured - first) <= CONFLICT else "conflict_in_file"
                else:
                    first = float(measured)
            found.append(reason)
        if first is not None:
            self.value.update((first,))
        self._wait(old is not None or first is not None, bool(held["is_member"].any()), now)
        if len(returned):
            yield self._rows(returned.assign(reason=pd.Series(found, index=returned.index, dtype=object)))

    def _wait(self, labelled: bool, exported: bool, now: int) -> None:
        """A timer runs while a member has no value; exporting it again starts it anew."""
        if (labelled or exported) and self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
            self.due.clear()
        if exported and not labelled:
            self.due.update((now + self.patience_ms,))
            self.handle.registerTimer(now + self.patience_ms)

    def _rows(self, judged: pd.DataFrame) -> pd.DataFrame:
        status, reason = judged["status"], judged["reason"]
        outcome = status.map({"pass": "accepted", "fail": "failed", "pending": "pending"})
        outcome = outcome.where(reason.isna(), reason.isin(["duplicate", "duplicate_in_file"]).map({True: "duplicate", False: "rejected"}))
        return judged.assign(outcome=outcome)[["ord", "batch_id", "candidate_id", "sequence", "measured", "status", "protocol_id", "outcome", "reason"]]

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.due.clear()
        names = sorted(k[0] for k in self.batches.keys()) if not self.value.exists() else []
        if names:
            blank = [None] * len(names)
            yield pd.DataFrame({"ord": pd.array(blank, dtype="Int64"), "batch_id": names, "candidate_id": [key[0]] * len(names), "sequence": blank, "measured": pd.array(blank, dtype="Float64"), "status": blank, "protocol_id": blank, "outcome": ["overdue"] * len(names), "reason": ["no_label"] * len(names)})

    def close(self) -> None:
        pass


def ingest_keyed(spark: SparkSession, files: str, exported: str, out: str, checkpoint: str, protocol: str, patience_ms: int, *, file_format: str = "parquet", files_per_trigger: int = 1000) -> StreamingQuery:
    """Judge arriving files of returned labels as judge_returns does, and tell which candidates have waited too long.

    files has returned rows; exported has rows (batch_id, candidate_id) of exported batches, which
    may arrive while the query runs or between its runs, but a batch's rows not after its labels.
    out gets judged rows, and for each batch of a candidate that has no accepted value patience_ms
    after its last export a row with outcome overdue, reason no_label and no ord; a label that
    comes later is judged as any other. Both are written once each: the sink's log and the
    state's checkpoint bring a restarted query back to the last finished micro-batch. State
    grows with the candidates, never with the rows. A timer rings in the first micro-batch with
    data after its time. Rows that fail without any state, such as a third of all rows without an id, are
    spread over SPREAD keys.
    """
    read = lambda schema, at: spark.readStream.schema(schema).format(file_format).option("maxFilesPerTrigger", files_per_trigger).load(at)
    names = spark.read.schema("batch_id string, candidate_id string").format(file_format).load(exported).select("batch_id").distinct().withColumn("_known", F.lit(True))
    before, after = stateless_reasons(F.substring(F.md5(F.col("sequence").cast("binary")), 1, 16), protocol)
    returned = read(RETURNS, files).join(names, "batch_id", "left").withColumns({"early_reason": before, "late_reason": after, "is_member": F.lit(False)}).drop("_known")
    members = read("batch_id string, candidate_id string", exported).where("candidate_id IS NOT NULL").withColumns({"early_reason": F.lit(None).cast("string"), "late_reason": F.lit(None).cast("string"), "is_member": F.lit(True)})
    both = returned.unionByName(members, allowMissingColumns=True)
    key = F.when(F.col("early_reason").isNotNull(), F.concat(F.lit("!"), F.pmod(F.xxhash64("ord"), F.lit(SPREAD)).cast("string"))).otherwise(F.col("candidate_id"))
    # A query with processing time would run batches without data for ever, and so never be done with what is available.
    needed = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before_start = {k: spark.conf.get(k) for k in needed}
    for k, v in needed.items():
        spark.conf.set(k, v)
    try:
        judged = both.withColumn("state_key", key).groupBy("state_key").transformWithStateInPandas(Waiting(patience_ms), StructType.fromDDL(JUDGED), "Append", "ProcessingTime")
        return judged.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for k, v in before_start.items():
            spark.conf.set(k, v)
