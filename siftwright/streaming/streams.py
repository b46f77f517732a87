"""Incremental forms: prefix counters, de-duplication of requests, a recall store with expiry, learning state.

Each takes a streaming (or plain) DataFrame and returns one; sinks and triggers are the caller's. Windowed costs are
an extension of this engine.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.costs import Breaker
from ..operators.recall import TTL
from ..sources.scratch import new_path


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    df = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").option("recursiveFileLookup", "false").parquet(f"{sf_dir}/")
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def as_calls(events: DataFrame) -> DataFrame:
    """Events as request-log rows."""
    v = F.col("value")
    return events.select(
        "event_id", "ts", "user_id", F.concat(F.lit("p"), F.col("user_id") % 20).alias("prefix"), F.floor(v * 10).cast("long").alias("input_tokens"),
        F.when(F.col("event_id") % 3 == 0, F.floor(v * 4)).otherwise(0).cast("long").alias("cached_tokens"), (F.col("event_type") != "error").alias("ok"),
    )


def prefix_hits(calls: DataFrame) -> DataFrame:
    """Running hit and miss counters of each prefix (update or complete mode)."""
    return calls.groupBy("prefix").agg(F.count_if(F.col("cached_tokens") > 0).alias("hit_count"), F.count_if(F.col("cached_tokens") == 0).alias("miss_count"))


def distinct_requests(calls: DataFrame, keys: list[str], lateness: str = "1 hour") -> DataFrame:
    """First request of each key; state is dropped once the watermark is past it."""
    return calls.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(keys)


def windowed_costs(calls: DataFrame, window: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    return calls.withWatermark("ts", lateness).groupBy(F.window("ts", window).alias("w")).agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens")).select(F.col("w.start").alias("start"), "calls", "input_tokens")


def recall_state(requests: DataFrame, ttl: int = TTL) -> DataFrame:
    """For each request (hash_key, ts) whether its key was stored within the last ``ttl`` seconds; each request stores it again.

    State is one time (in microseconds) per key and ends with event time, so it is bounded by the keys of ``ttl`` seconds and the lateness.
    """

    def step(key: tuple, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        # a key's rows come in several Arrow batches; only all of them together can be put in order
        rows = pd.concat([b[["event_id", "ts"]] for b in batches]).sort_values(["ts", "event_id"])
        hits = []
        for now in rows["ts"].to_numpy("datetime64[us]").astype("int64").tolist():
            hits.append(last is not None and now - last <= ttl * 1_000_000)
            last = now if last is None else max(last, now)
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + ttl * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"event_id": rows["event_id"].to_numpy(), "hash_key": key[0], "hit": hits})

    marked = requests.withWatermark("ts", "1 hour")
    return marked.groupBy("hash_key").applyInPandasWithState(step, "event_id long, hash_key string, hit boolean", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def learning_state(calls: DataFrame) -> DataFrame:
    """Running attempts, successes and failures in a row of each prefix, one row per key and batch."""

    def step(key: tuple, batches, state: GroupState):
        n, ok, run = state.get if state.exists else (0, 0, 0)
        rows = pd.concat(list(batches)).sort_values("event_id")
        for good in rows["ok"]:
            n, ok, run = n + 1, ok + bool(good), 0 if good else run + 1
        state.update((n, ok, run))
        yield pd.DataFrame({"prefix": [key[0]], "attempts": [n], "successes": [ok], "consecutive_failures": [run]})

    return calls.groupBy("prefix").applyInPandasWithState(step, "prefix string, attempts long, successes long, consecutive_failures long", "n long, ok long, run long", "update", GroupStateTimeout.NoTimeout)


def breaker_state(calls: DataFrame, most: int = 2, cooldown: int = 20) -> DataFrame:
    """Each call (user_id, event_id, ok) with whether a circuit breaker blocks it; a user's breaker is three numbers of state.

    Calls are taken in order of events within a batch; those of a later batch come later.
    """

    def step(key: tuple, batches, state: GroupState):
        breaker = Breaker(most, cooldown, *(state.get if state.exists else ()))
        rows = pd.concat(list(batches)).sort_values("event_id", kind="stable")
        blocked = [breaker.blocks(bool(ok)) for ok in rows["ok"]]
        state.update((breaker.call, breaker.failures, breaker.until))
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"].to_numpy(), "blocked": blocked})

    return calls.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, blocked boolean", "call long, failures long, until long", "append", GroupStateTimeout.NoTimeout)


def with_results(requests: DataFrame, results: DataFrame, key: str = "hash_key") -> DataFrame:
    """Requests joined with a table of finished background results by key (stream with static table)."""
    return requests.join(results, key, "left")


def run_once(df: DataFrame, mode: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Run a streaming query over what there is now, and return its rows as a table in the shared folder.

    Every batch is a folder of its own, written again if it is run again. ``complete`` keeps the last batch; ``update``
    the last row of each of ``keys``; ``append`` all rows.
    """
    spark = df.sparkSession
    path, schema = new_path(spark, "stream"), df.schema

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    q = df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    spark.createDataFrame([], schema).write.mode("append").parquet(f"{path}/rows/batch=-1")  # also where there was no batch
    rows = spark.read.schema(schema.add("batch", "long")).parquet(f"{path}/rows")
    if mode == "complete":
        last = rows.agg(F.max("batch")).first()[0]
        return rows.where(F.col("batch") == F.lit(last)).drop("batch")
    if mode == "update" and keys:
        names = [c for c in rows.columns if c != "batch"]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*names), "batch").alias("x")).select("x.*")
    return rows.drop("batch")
