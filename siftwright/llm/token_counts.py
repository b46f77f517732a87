"""Token counts from an exact histogram of encoded lengths and its suffix sums."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: The vocabulary's file (ranks of byte pairs) and the split into pieces that it was made for.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Lengths of one bucket; sums run over buckets first, then inside each.
BUCKET = 1024


def encoder(ranks: bytes) -> tiktoken.Encoding:
    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def _lengths(ranks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(ranks.value)
        for b in batches:
            n = [len(e.encode_ordinary(t)) if t else 0 for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], ["length"])

    return run


def histogram(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(length, docs) of the whole texts of ``docs`` in tokens; a null or empty text has length 0.

    Reads ``text`` alone. The vocabulary is read on the driver and sent to the workers once; its size is fixed.
    An empty table gives an empty histogram.
    """
    with open(vocabulary, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    lengths = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_lengths(ranks), "length long")
    return lengths.groupBy("length").agg(F.count("*").alias("docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """The histogram with, per length: tokens, docs_at_least and tokens_at_least (of that length or more),
    docs_at_most, and truncated_tokens: all tokens when documents are cut to that many.

    Buckets are summed first, so a window spans one bucket or the buckets' totals.
    """
    h = hist.select("length", "docs", (F.col("length") * F.col("docs")).alias("tokens"), F.expr(f"length div {BUCKET}").alias("bucket"))
    totals = h.groupBy("bucket").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    above = Window.orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("bucket", F.coalesce(F.sum("d").over(above), F.lit(0)).alias("d_above"), F.coalesce(F.sum("t").over(above), F.lit(0)).alias("t_above"), F.sum("d").over(Window.partitionBy()).alias("all_d"), F.sum("t").over(Window.partitionBy()).alias("all_t"))
    inside = Window.partitionBy("bucket").orderBy(F.col("length").desc())
    x = h.join(totals, "bucket").select(
        "length", "docs", "tokens", "all_d", "all_t",
        (F.col("d_above") + F.sum("docs").over(inside)).alias("docs_at_least"),
        (F.col("t_above") + F.sum("tokens").over(inside)).alias("tokens_at_least"),
    )
    return x.select(
        "length", "docs", "tokens", "docs_at_least", "tokens_at_least",
        (F.col("all_d") - F.col("docs_at_least") + F.col("docs")).alias("docs_at_most"),
        (F.col("all_t") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least")).alias("truncated_tokens"),
    )


def truncated_total(sums: DataFrame, limit: int) -> int:
    """All tokens when every document is cut to ``limit``: shorter ones whole, ``limit`` of each other one."""
    r = sums.where(F.col("length") > limit).agg(F.max("docs_at_least").alias("n"), F.max("tokens_at_least").alias("t")).first()
    total = sums.agg(F.max("tokens_at_least")).first()[0] or 0
    return total - (r.t or 0) + limit * (r.n or 0)


def quantile(sums: DataFrame, q: float) -> int | None:
    """The smallest length that at least a share ``q`` of the documents don't exceed; None without documents."""
    n = sums.agg(F.max("docs_at_least")).first()[0]
    return None if n is None else sums.where(F.col("docs_at_most") >= F.lit(q) * n).agg(F.min("length")).first()[0]


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Suffix sums over the exact histogram of encoded lengths: one row for each length that occurs.

    The histogram is written once, so every text is encoded once. Repeated rows count each; other columns are ignored.
    """
    return suffix_sums(materialise(histogram(docs, vocabulary), "lengths"))
