"""The request log as a table, and the counters of each prefix kept beside it.

The log is append-only Parquet. The counters are versions of one small table: a batch is folded into the last version and
written as the next, named by the batch, so a batch that is run again replaces its own version and counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import exists

LOG = "event_id long, prefix string, model string, input_tokens long, output_tokens long, cached_tokens long"
COUNTERS = "prefix string, first_seen long, last_hit long, hit_count long, miss_count long"


class RequestLog:
    """Log and counters under ``path``, which executors must share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self) -> DataFrame:
        return self.spark.read.schema(f"{COUNTERS}, version long").parquet(f"{self.path}/counters")

    def _last(self, before: int | None = None) -> int | None:
        if not exists(self.spark, f"{self.path}/counters"):
            return None
        v = self._versions().select("version")
        return (v if before is None else v.where(F.col("version") < before)).agg(F.max("version")).first()[0]

    def log(self) -> DataFrame:
        """All requests, of all batches."""
        if not exists(self.spark, f"{self.path}/log"):
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(f"{LOG}, batch long").parquet(f"{self.path}/log").drop("batch")

    def counters(self, version: int | None = None) -> DataFrame:
        """First and last hit, hits and misses of each prefix, as of a batch (the last one unless it is named)."""
        last = self._last() if version is None else version
        return self.spark.createDataFrame([], COUNTERS) if last is None else self._versions().where(F.col("version") == last).drop("version")

    def record(self, requests: DataFrame, batch: int) -> None:
        """Append a batch of requests (the log's columns) and merge it into the counters.

        A hit moves a prefix's ``last_hit``, a miss does not; a new prefix starts with its first request either way. Made for
        ``foreachBatch``: a batch that is run again changes nothing more.
        """
        rows = requests.selectExpr(*(f"CAST({c.split()[0]} AS {c.split()[1]}) AS {c.split()[0]}" for c in LOG.split(", ")))
        rows.write.mode("overwrite").parquet(f"{self.path}/log/batch={batch}")
        rows = self.spark.read.schema(LOG).parquet(f"{self.path}/log/batch={batch}")
        hit = F.col("cached_tokens") > 0
        new = rows.groupBy("prefix").agg(
            F.min("event_id").alias("first_seen"), F.max(F.when(hit, F.col("event_id"))).alias("last_hit"), F.count_if(hit).alias("hit_count"), F.count_if(~hit).alias("miss_count")
        )
        before = self._last(before=batch)
        old = self.counters(before) if before is not None else self.spark.createDataFrame([], COUNTERS)
        both = old.unionByName(new).groupBy("prefix").agg(
            F.min("first_seen").alias("first_seen"), F.max("last_hit").alias("last_hit"), F.sum("hit_count").alias("hit_count"), F.sum("miss_count").alias("miss_count")
        )
        both.withColumn("last_hit", F.coalesce("last_hit", "first_seen")).write.mode("overwrite").parquet(f"{self.path}/counters/version={batch}")
