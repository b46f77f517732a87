"""Shared pieces: scratch tables in the cluster's shared folder, and word hashing for Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import drop_tables, exists, materialise, shared_dir

__all__ = ["Words", "blocks", "components", "drop_tables", "exists", "groups", "materialise", "mix", "shared_dir", "signed", "text_key", "texts_of", "windows"]

#: Bytes of text taken together by the vectorised passes; bounds a worker's memory.
BLOCK_BYTES = 2_000_000
#: Bytes whose powers are kept, and the longest word that is hashed with them.
CHUNK, LONG_WORD = 1 << 18, 1024
#: Edges up to which the driver finds components (16 bytes each); more are joined on the cluster.
EDGES = 100_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWER = 0x9E3779B97F4A7C17


def text_key(text: Column) -> list[Column]:
    """Identity of a text: a 64-bit hash and the byte length. Null texts have null keys."""
    return [
        F.when(text.isNotNull(), F.xxhash64(text)).alias("th"),
        F.octet_length(text).alias("tl"),
    ]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(words: np.ndarray, k: int, base: np.uint64 = _BASE) -> np.ndarray:
    """Hashes of all windows of ``k`` consecutive words; empty if there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = words[:n].copy()
    for j in range(1, k):
        acc = acc * base + words[j : j + n]
    return mix(acc)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\v\f\r")] = True
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_LOWERED = _BYTE[[b + 32 if 65 <= b <= 90 else b for b in range(256)]]


def _powers(base: int) -> np.ndarray:
    out = np.full(CHUNK + LONG_WORD + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_UP, _DOWN = _powers(_POWER), _powers(pow(_POWER, -1, 1 << 64))


class Words(NamedTuple):
    """Words of some rows one after another: 64-bit hashes, where each starts and ends in ``data``, and how many each row has."""

    data: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    counts: np.ndarray


def _hash_words(data: np.ndarray, offsets: np.ndarray, lower: bool) -> Words:
    space = _SPACE[data]
    first, last = ~space, ~space
    first[1:] &= space[:-1]
    last[:-1] &= space[1:]
    if len(data):
        filled = np.diff(offsets) > 0
        at, end = offsets[:-1][filled], offsets[1:][filled] - 1
        first[at], last[end] = ~space[at], ~space[end]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes, table = np.empty(len(starts), np.uint64), _LOWERED if lower else _BYTE
    # a word is a polynomial in its bytes: a difference of running sums, moved to its start
    cuts = np.searchsorted(starts, np.arange(0, len(data) + CHUNK, CHUNK))
    for c, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])):
        part = data[c * CHUNK : (c + 1) * CHUNK + LONG_WORD]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(table[part] * _UP[: len(part)], out=sums[1:])
        s, e = starts[i:j] - c * CHUNK, np.minimum(ends[i:j] - c * CHUNK, len(part))
        hashes[i:j] = mix((sums[e] - sums[s]) * _DOWN[s])
    for i in np.flatnonzero(ends - starts > LONG_WORD):
        word = data[starts[i] : ends[i]].tobytes()
        hashes[i] = xxhash.xxh3_64_intdigest(word.lower() if lower else word)
    return Words(data, hashes, starts, ends, np.diff(np.searchsorted(starts, offsets)))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def blocks(batches: Iterator[pa.RecordBatch], lower: bool = False) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """Slices of the batches of about BLOCK_BYTES of text, one row at least, with the words of their rows (none for null).

    Words are runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage return; with
    ``lower`` the letters A to Z count as lower case.
    """
    for batch in batches:
        text = batch.column(batch.schema.get_field_index("text")).cast(pa.large_binary())
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
        data = np.frombuffer(text.buffers()[2], np.uint8) if len(text) and text.buffers()[2] is not None else np.empty(0, np.uint8)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES, "right")) - 1)
            own = offsets[at : to + 1]
            yield batch.slice(at, to - at), _hash_words(data[own[0] : own[-1]], own - own[0], lower)
            at = to
    # a worker outlives its task, and what Arrow holds for the next one counts as the executor's
    pa.default_memory_pool().release_unused()


def groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Whole groups of rows that come sorted by ``keys``, also where one lies across batches. Holds one batch and one group."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(b.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        if held:
            last = held[-1].slice(held[-1].num_rows - 1)
            new[0] = any(last.column(last.schema.get_field_index(k))[0].as_py() != c[0] for k, c in zip(keys, cols))
        at = 0
        for cut in np.flatnonzero(new).tolist():
            if cut > at:
                held.append(b.slice(at, cut - at))
            if held:
                yield pa.Table.from_batches(held)
                held = []
            at = cut
        held.append(b.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def smallest_nodes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (a, b) that aren't the smallest of their component, and that smallest node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, two, up = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        low, high = np.minimum(up[one], up[two]), np.maximum(up[one], up[two])
        if (low == high).all():
            inner = np.flatnonzero(up != np.arange(len(up)))
            return nodes[inner], nodes[up[inner]]
        np.minimum.at(up, high, low)
        while (up[up] != up).any():
            up = up[up]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a long, b long) as (node, component), component its smallest node; smallest nodes have no row.

    Up to EDGES edges are joined by the driver: each query it runs instead leaves plans, threads and figures of tasks
    with it that take more memory than these edges. More are joined by alternating large-star and small-star steps:
    each step joins neighbours to their smallest one through plain aggregations, so no component is ever held by one
    task. Ends when all nodes are joined to their smallest.
    """
    edges = edges.where("a <> b")
    if edges.count() <= EDGES:
        few = edges.toArrow()
        found = smallest_nodes(*(few.column(c).to_numpy() for c in "ab"))
        rows = pa.table([pa.array(x, pa.int64()) for x in found], ["node", "component"])
        return materialise(edges.sparkSession.createDataFrame(rows, "node long, component long").coalesce(1), "components")

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.union(e.select("b", "a"))
        else:
            both = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = both.join(low, "a")
        if large:
            out = out.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = out.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    before = None
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    while True:
        e = materialise(star(star(e, True), False), "stars")
        if before is not None:
            drop_tables(before)
        before = e
        # done when every node has one neighbour, which has none itself
        ends = e.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("b", F.lit(0), F.lit(1)))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 AND up > 0").isEmpty():
            return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
