"""Feeds the events table through a streaming operator and returns the sink's rows.

Used by the registered streaming queries only.  Sinks: ``foreachBatch`` writing each
micro-batch to ``<out>/batch=<id>`` with overwrite (idempotent on replay); checkpoints
live below the session's shared checkpoint folder.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import _exists, checkpoint_dir
from ledgerlens.sources.tables import read_table
from ledgerlens.streaming.stream import EVENTS_SCHEMA, txn_stream


@contextmanager
def settings(spark: SparkSession, conf: dict[str, str]):
    """``conf`` holds inside the block; what was set before holds again after it."""
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


class StreamRun:
    """Feeds the events table into a file-stream folder, then two events far in the future,
    of an account that the table does not have, so that the watermark passes every real event
    and all windows and timers flush; returns the sink folder without that account."""

    def __init__(self, spark: SparkSession, sf_dir: str, name: str):
        self.spark = spark
        self.root = os.path.join(checkpoint_dir(spark), "ledgerlens-stream", f"{name}-{uuid.uuid4().hex[:8]}")
        self.inp, self.out, self.ckpt = (os.path.join(self.root, p) for p in ("in", "out", "ckpt"))
        self.events = read_table(spark, sf_dir, "events")
        self.account = (self.events.agg(F.min("user_id")).first()[0] or 0) - 1

    def _sentinel(self, days: int) -> None:
        """An event that every operator's filter lets through: late at night, near a threshold."""
        mx = self.events.agg(F.max("ts").alias("m"))
        late = F.date_trunc("DAY", F.col("m")) + F.expr(f"INTERVAL {days * 10} DAYS") + F.expr("INTERVAL 1410 MINUTES")
        s = mx.select(F.lit(-days).cast("long").alias("event_id"), late.cast("timestamp_ntz").alias("ts"),
                      F.lit(self.account).cast("long").alias("user_id"), F.lit("view").alias("event_type"),
                      F.lit(95.0).alias("value"), F.lit('{"k": 0}').alias("props"))
        s.write.mode("append").parquet(self.inp)

    def run(self, build: Callable[[DataFrame], DataFrame], output_mode: str = "append",
            per_batch: Callable[[DataFrame, int], DataFrame] | None = None,
            conf: dict[str, str] | None = None) -> DataFrame:
        """``per_batch`` maps each micro-batch and its number to the rows that the sink writes;
        ``conf`` holds settings that the streaming query starts with (it keeps its own copy)."""
        self.events.write.mode("append").parquet(self.inp)
        src = (self.spark.readStream.schema(EVENTS_SCHEMA).option("maxFilesPerTrigger", 1000).parquet(self.inp))
        out_df = build(txn_stream(src))
        out = self.out

        def sink(batch: DataFrame, batch_id: int) -> None:
            rows = per_batch(batch, batch_id) if per_batch else batch
            rows.write.mode("overwrite").parquet(os.path.join(out, f"batch={batch_id}"))
        with settings(self.spark, conf or {}):
            q = (out_df.writeStream.outputMode(output_mode).foreachBatch(sink)
                 .option("checkpointLocation", self.ckpt).start())
        try:
            q.processAllAvailable()
            self._sentinel(1)
            q.processAllAvailable()
            self._sentinel(2)
            q.processAllAvailable()
        finally:
            q.stop()
        if not _exists(self.spark, out):          # no batch came with rows
            return self.spark.createDataFrame([], out_df.schema)
        res = self.spark.read.parquet(out)
        if "account_id" in res.columns:
            res = res.where(F.col("account_id") != self.account)
        return res.drop("batch")
