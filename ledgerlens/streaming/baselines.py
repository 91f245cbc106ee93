"""Rules on a stream that need an account's past: versioned baseline tables joined per micro-batch.

A scheduled batch job publishes a version: medians per (account, channel), and per account the
median day, the number of days and the 95th percentile of the amounts.  A version is two Parquet
folders and a marker that is written last, so a reader sees a version whole or not at all; a
published version never changes.  Each micro-batch takes the newest version at its first run and
notes it beside the stream's output before anything is written; the replay of a batch, after a lost
driver too, takes the version noted.  Rows of accounts or channels that a version does not know
raise no flag.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.config import Config
from ledgerlens.functions import columns as C
from ledgerlens.operators import rules as R
from ledgerlens.operators.features import amount_stats, clean_money, large_flag, row_features

ACC = "account_id"


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the ``version=`` folders below ``folder`` that were written to their end."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = []
    for entry in fs.listStatus(path):
        name = entry.getPath().getName()
        done = spark._jvm.org.apache.hadoop.fs.Path(entry.getPath(), "_SUCCESS")
        if name.startswith("version=") and fs.exists(done):
            found.append(int(name.removeprefix("version=")))
    return sorted(found)


def channel_baseline(df: DataFrame, cfg: Config = Config()) -> DataFrame:
    """(account, channel, channel_median)."""
    return R.channel_medians(df.withColumn("channel", C.channel()), cfg)


def account_baseline(df: DataFrame, cfg: Config = Config()) -> DataFrame:
    """(account, n_days, median_day, amount_p95); accounts without a dated row have no days."""
    days = R.daily_stats(R.prepare(df, cfg), cfg).groupBy(ACC).agg(
        F.max("n_days").alias("n_days"), F.max("median_day").alias("median_day"))
    p95 = amount_stats(row_features(df, cfg), cfg, (ACC,)).select(ACC, "amount_p95")
    return p95.join(days, ACC, "left")


@dataclass(frozen=True)
class Baselines:
    """The published versions below one shared folder."""
    spark: SparkSession
    folder: str
    cfg: Config = field(default_factory=Config)

    def _path(self, table: str, version: int) -> str:
        return f"{self.folder.rstrip('/')}/{table}/version={version}"

    def published(self) -> list[int]:
        return _versions(self.spark, f"{self.folder.rstrip('/')}/published")

    def publish(self, df: DataFrame, version: int) -> int:
        """Writes ``version`` from the transactions ``df``; what an earlier attempt left unfinished
        is written over, a published version raises."""
        if version in self.published():
            raise ValueError(f"baseline version {version} is published and does not change")
        channel_baseline(df, self.cfg).write.mode("overwrite").parquet(self._path("channel", version))
        account_baseline(df, self.cfg).write.mode("overwrite").parquet(self._path("account", version))
        self.spark.range(1).write.mode("overwrite").parquet(self._path("published", version))
        return version

    def read(self, table: str, version: int) -> DataFrame:
        return self.spark.read.parquet(self._path(table, version))

    def of_batch(self, log: str, batch_id: int) -> int:
        """The version of a micro-batch: the one noted in ``log``, else the newest, noted now."""
        where = f"{log.rstrip('/')}/batch={batch_id}"
        noted = _versions(self.spark, where)
        if noted:
            return noted[0]
        published = self.published()
        if not published:
            raise ValueError(f"no baseline version is published in {self.folder}")
        self.spark.range(1).write.mode("overwrite").parquet(f"{where}/version={published[-1]}")
        return published[-1]


def _known(batch: DataFrame, base: DataFrame, keys: list[str]) -> DataFrame:
    """``batch`` with the columns of ``base``.  The baseline is cut to the batch's keys first: the
    batch's few keys are the small side, which the runtime broadcasts once measured, so that the
    baseline itself is not shuffled for every micro-batch."""
    return batch.join(base.join(batch.select(*keys).distinct(), keys, "left_semi"), keys, "left")


def score_rows(batch: DataFrame, baselines: Baselines, version: int) -> DataFrame:
    """Rows over their channel's median (``r_high_value``) or the account's 95th percentile
    (``is_large_amount``), with the version that judged them."""
    cfg = baselines.cfg
    d = batch.withColumns({"channel": C.channel(), "amount_f": clean_money(F.col("amount"), cfg.compat)})
    d = _known(d, baselines.read("channel", version), [ACC, "channel"])
    d = _known(d, baselines.read("account", version).select(ACC, "amount_p95"), [ACC])
    d = d.withColumns({"r_high_value": R.high_value_flag(cfg), "is_large_amount": large_flag(),
                       "version": F.lit(version).cast("long")})
    return d.where(F.col("r_high_value") | (F.col("is_large_amount") == 1)).select(
        ACC, "seq", "amount", "channel", "channel_median", "r_high_value", "is_large_amount", "version")


def score_days(days: DataFrame, baselines: Baselines, version: int) -> DataFrame:
    """Spike days among closed day totals (account_id, date, total_amount): far over the account's median day."""
    cfg = baselines.cfg
    d = _known(days, baselines.read("account", version).select(ACC, "n_days", "median_day"), [ACC])
    total = F.coalesce(F.col("total_amount"), F.lit(0))
    spike = ((F.col("n_days") >= cfg.spike_min_days) & (total > F.lit(cfg.spike_multiplier) * F.col("median_day"))
             & (total > F.lit(cfg.spike_floor)))
    return d.where(spike).select(ACC, "date", total.alias("day_total"), "median_day", F.lit(version).cast("long").alias("version"))
