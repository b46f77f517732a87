"""Line deduplication by overlapping windows of consecutive lines, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

LINES = 3


def line_dedup(docs: DataFrame, lines: int = LINES, with_text: bool = False) -> DataFrame:
    """Remove lines covered by a window of ``lines`` lines that occurred earlier.

    Takes doc_id and text of ``docs`` (other columns are ignored); returns doc_id, n_lines, n_removed, kept_sha256
    (of the kept lines joined by line feeds) and, with ``with_text``, kept_text. Lines are the parts between line
    feeds, compared as they are. Of equal windows the first by doc_id (null first), text hash and place stays;
    windows are judged on the input. A null text has no lines, an empty one has one; a text of fewer than
    ``lines`` lines has no window. Rows alike in doc_id and text count as one document and get the same result.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    d = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("th"))
    split = F.split("text", "\n", -1)
    h = d.where("text is not null").select(
        "doc_id", "th", F.transform(split, lambda x: F.xxhash64(x)).alias("a"), F.transform(split, lambda x: F.xxhash64(F.lit(1), x)).alias("b")
    )
    a, b = (", ".join(f"{c}[i + {j}]" for j in range(lines)) for c in "ab")
    h = h.where(F.size("a") >= lines).select("doc_id", "th", F.explode(F.expr(f"transform(sequence(0, size(a) - {lines}), i -> named_struct('i', i, 'h', xxhash64({a}), 'g', xxhash64({b})))")).alias("x"))
    w = materialise(h.select("doc_id", "th", "x.*"), "windows")
    first = w.groupBy("h", "g").agg(F.min(F.struct("doc_id", "th", "i")).alias("first"), F.count("*").alias("n")).where("n > 1").select("h", "g", "first")
    first = materialise(first, "repeated")
    later = w.join(first, ["h", "g"]).where(F.struct("doc_id", "th", "i") > F.col("first"))
    starts = later.groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).agg(F.collect_set("i").alias("starts"))
    starts = materialise(starts, "starts")
    out = d.join(starts.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left")
    gone = f"flatten(transform(starts, s -> sequence(s, s + {lines - 1})))"
    parts = F.when(F.col("text").isNull(), F.array().cast("array<string>")).otherwise(split)
    out = out.select("doc_id", parts.alias("lines"), "starts")
    kept = F.when(F.col("starts").isNull(), F.col("lines")).otherwise(F.expr(f"transform(array_except(sequence(0, size(lines) - 1), {gone}), p -> lines[p])"))
    out = out.select("doc_id", F.size("lines").cast("long").alias("n_lines"), kept.alias("kept"))
    out = out.select("doc_id", "n_lines", F.size("kept").alias("k"), F.array_join("kept", "\n").alias("kept_text"))
    out = out.select("doc_id", "n_lines", (F.col("n_lines") - F.col("k")).cast("long").alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"), "kept_text")
    return out if with_text else out.drop("kept_text")
