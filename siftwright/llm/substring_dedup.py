"""Substring deduplication by level-wise doubling of repeated word windows.

Level one takes short windows of ``base`` words. Of the short windows inside each long window of ``window`` words only
the one with the smallest hash stands for it, so two equal long windows always share theirs, and a fifth of all
positions are enough. Windows found in one text alone are dropped, and with them the long windows they stand for; those
found in two texts or more are extended to twice their length inside their long window, hashed and compared again, and
so on until none survive or the long windows themselves have been compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, blocks, drop_tables, materialise, signed, text_key, texts_of, windows

WINDOW, BASE = 13, 4
_SECOND = np.uint64(0xD6E8FEB86659FD93)


def lengths(window: int, base: int) -> list[int]:
    """Of the levels' windows: ``base`` doubled until it reaches ``window``."""
    out = [base]
    while out[-1] < window:
        out.append(min(2 * out[-1], window))
    return out


def _places(words: Words, window: int, levels: list[int]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Starts of the long windows that lie in one text, and where each one's stand-in starts on each level.

    Both depend on the long window's words alone, so equal ones have theirs at the same distance.
    """
    n = len(words.hashes) - window + 1
    if n <= 0:
        return np.empty(0, np.int64), [np.empty(0, np.int64) for _ in levels]
    short = windows(words.hashes, levels[0])
    best, shift = short[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, window - levels[0] + 1):
        c = short[j : j + n]
        less = c < best
        best[less] = c[less]
        shift[less] = j
    ends = np.repeat(np.cumsum(words.counts), words.counts)
    starts = np.flatnonzero(np.arange(n) + window <= ends[:n])
    at = [starts + shift[starts]]
    for k in levels[1:]:
        at.append(np.minimum(at[-1], starts + window - k))
    return starts, at


def _level(window: int, levels: list[int]):
    """Per text the windows of the last of ``levels`` that stand for a long window alive on the one before: (h, th, pos)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words in blocks(batches):
            first = np.cumsum(words.counts) - words.counts
            _, places = _places(words, window, levels)
            at = places[-1]
            if len(levels) > 1:
                at = at[_alive(part, words, first)[places[-2]]]
            at = np.unique(at)
            doc = np.repeat(np.arange(len(words.counts)), words.counts)[at]
            th = part.column(part.schema.get_field_index("th")).take(pa.array(doc))
            yield pa.RecordBatch.from_arrays([pa.array(signed(windows(words.hashes, levels[-1])[at])), th, pa.array((at - first[doc]).astype(np.int32))], ["h", "th", "pos"])

    return run


def _alive(part: pa.RecordBatch, words: Words, first: np.ndarray) -> np.ndarray:
    """Whether a window of the level before survived, by its place among all words of the block."""
    out = np.zeros(len(words.hashes) + 1, bool)
    for f, n, pos in zip(first, words.counts, part.column(part.schema.get_field_index("alive"))):
        p = np.asarray(pos.values, np.int64)
        out[f + p[p < n]] = True
    return out


def _last_level(window: int, levels: list[int]):
    """The long windows that are alive, by 96 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words in blocks(batches):
            first = np.cumsum(words.counts) - words.counts
            starts, places = _places(words, window, levels)
            if len(levels) > 1:
                starts = starts[_alive(part, words, first)[places[-2]]]
            doc = np.repeat(np.arange(len(words.counts)), words.counts)[starts]
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(signed(windows(words.hashes, window)[starts])),
                    pa.array((windows(words.hashes, window, _SECOND)[starts] >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                    *(part.column(part.schema.get_field_index(k)).take(take) for k in ("doc_id", "t")),
                    pa.array((starts - first[doc]).astype(np.int32)),
                ],
                ["h", "g", "doc_id", "t", "start"],
            )

    return run


def _cut(window: int, with_text: bool):
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {k: batch.column(batch.schema.get_field_index(k)) for k in ("doc_id", "starts", "copy")}
            out: list[tuple] = []
            for text, starts, copy in zip(texts_of(batch), col["starts"], col["copy"].to_pylist()):
                words = [] if text is None else text.split()
                n, kept = len(words), words
                if copy and n >= window:
                    kept = []
                elif starts.is_valid:
                    edge = np.zeros(n + 1, np.int32)
                    s = np.asarray(starts.values, np.int64)
                    np.add.at(edge, s, 1)
                    np.add.at(edge, s + window, -1)
                    kept = list(compress(words, (np.cumsum(edge[:n]) == 0).tolist()))
                joined = b" ".join(kept)
                out.append((n, n - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode() if with_text else None))
            cols = list(zip(*out)) or [(), (), (), ()]
            arrays = [col["doc_id"], pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(cols[3], pa.string())] * with_text, names)

    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW, base: int = BASE, with_text: bool = False) -> DataFrame:
    """Remove each word covered by a ``window``-word window that also starts in a document with a smaller doc_id.

    Takes ``doc_id`` and ``text`` of ``docs`` (other columns are ignored) and returns doc_id, n_words, n_removed,
    kept_sha256 and, with ``with_text``, kept_text: the kept words joined by one space. Windows are judged on the
    input. A null or empty text has no words. A row with a null doc_id has no order: nothing is removed from it
    and nothing because of it. Rows that repeat a doc_id are judged each by its own text, never against each
    other. Equal texts are judged once: of them the smallest doc_id is the first, the others lose every word.
    An empty table gives an empty result.

    ``base`` is the first level's length; each level doubles it, the last has ``window``.
    """
    if not 0 < base <= window:
        raise ValueError("base must be at least 1 and at most window")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *text_key(F.col("text")))
    real = d.where("doc_id is not null and text is not null")
    # a text's rows are known below by its first doc_id and a part of its hash, which is short to shuffle
    first = real.groupBy("th", "tl").agg(F.min("doc_id").alias("doc_id")).withColumn("t", F.shiftright("th", 32).cast("int"))
    first = materialise(first, "firsts")

    levels, texts, alive, done = lengths(window, base), real, None, False
    for k in range(1, len(levels)):
        # windows of this level in two texts or more, and who has them
        told = materialise(texts.mapInArrow(_level(window, levels[:k]), "h long, th long, pos int"), "level")
        again = told.groupBy("h").agg(F.min("th").alias("a"), F.max("th").alias("b")).where("a < b").select("h")
        again = materialise(again, "repeated")
        old, alive = alive, told.join(again, "h").groupBy("th").agg(F.sort_array(F.collect_set("pos")).alias("alive"))
        alive = materialise(alive, "alive")
        drop_tables(told, again, *[old] * (old is not None))
        if done := alive.isEmpty():
            break
        # one document for each text goes on
        texts = real.join(first.join(alive, "th").hint("shuffle_hash"), ["th", "tl", "doc_id"])
    if len(levels) == 1:
        texts = real.join(first.hint("shuffle_hash"), ["th", "tl", "doc_id"])

    spans = first.withColumn("starts", F.lit(None).cast("array<int>"))
    if not done:
        two = materialise(texts.mapInArrow(_last_level(window, levels), "h long, g int, doc_id long, t int, start int"), "long")
        least = two.groupBy("h", "g").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("h", "g", "a")
        least = materialise(least, "least")  # so that the join below can split a window with very many rows
        later = two.join(least, ["h", "g"]).where("a < doc_id")
        found = materialise(later.groupBy("doc_id", "t").agg(F.collect_set("start").alias("starts")), "starts")
        drop_tables(two, least)
        spans = first.join(found, ["doc_id", "t"], "left")
    spans = spans.select("th", "tl", F.col("doc_id").alias("first_id"), "starts")

    out = d.join(spans.hint("shuffle_hash"), ["th", "tl"], "left").select("doc_id", "text", "starts", F.coalesce(F.expr("doc_id > first_id"), F.lit(False)).alias("copy"))
    # a row without an id is neither first nor later
    out = out.withColumn("starts", F.when(F.col("doc_id").isNotNull(), F.col("starts")))
    return out.mapInArrow(_cut(window, with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
