"""Rows and names that were once left out."""

import datetime

from siftwright.operators import lookups
from siftwright.streaming import streams


def test_non_text_models(spark):
    names = ["my-asr", "x-stt-1", "voice-2", "speech-hd", "qwen-vision", "a-tts", "plain", "gpt-4o"]
    kept = lookups.text_models(spark.createDataFrame([(n,) for n in names], "model string")).collect()
    assert sorted(r.model for r in kept) == ["gpt-4o", "plain"]


def test_recall_orders_a_key_over_all_its_batches(spark, tmp_path):
    """A key's rows, latest first, in Arrow batches of two: hits are those of the whole key in order of time."""
    at = lambda s: datetime.datetime(2026, 1, 1, tzinfo=datetime.UTC) + datetime.timedelta(seconds=s)
    times = [20000, 16399, 12799, 9000, 5400, 1800, 0]
    rows = spark.createDataFrame([(i, at(t), "k") for i, t in enumerate(times)], "event_id long, ts timestamp, hash_key string")
    rows.coalesce(1).write.parquet(str(tmp_path / "calls"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "calls"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = {r.event_id: r.hit for r in streams.run_once(streams.recall_state(stream, 3600), "append").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {i: i + 1 < len(times) and t - times[i + 1] <= 3600 for i, t in enumerate(times)}
