"""Mixing sources to target weights by Pfair scheduling, DataFrame functions only.

A source's documents form blocks. With weight w of a total W, its k-th block is released at floor(k W / w) and due
at ceil((k + 1) W / w); in each slot the released block with the earliest deadline goes next, so at any time each
source is less than one block from its target. With whole weights the schedule repeats after W slots, so one
period of each phase is planned (its size depends on the weights alone) and every block finds its slot by itself.
When a source has no more blocks, a new phase shares its weight among the others in proportion. The plan goes to the
cluster as two tables: a row for each source and phase, and the slots of a phase's period, a row for each block.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable
from itertools import islice

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise

BLOCK_DOCS = 16
#: Buckets by which a source's documents are counted off, so that no task holds a whole source.
BUCKETS = 4096
#: Largest sum of weights: the slots of one period.
PERIOD = 100_000
#: Columns of the mix.
MADE = ("block", "slot", "release", "deadline", "phase", "position")
#: Rows of the plan up to which it may be broadcast; a row has seven or three numbers and a source's name.
BROADCAST_ROWS = 100_000
#: Rows of the plan that go to the cluster in one piece.
PIECE = 100_000

_PHASES = "_source string, _phase int, _done long, _blocks long, _w long, _total long, _start long"
_SLOTS = "_source2 string, _phase2 int, _r long, _at long"


def period(weights: dict[str | None, int]) -> dict[str | None, list[int]]:
    """Slots of each source's blocks in one period, by earliest deadline first among the released blocks."""
    total = sum(weights.values())
    names = sorted(weights, key=lambda s: (s is None, s or ""))
    waiting = [(0, i, 0) for i, s in enumerate(names) if weights[s] > 0]  # release, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    out: dict[str | None, list[int]] = {s: [] for s in names}
    for t in range(total):
        while waiting and waiting[0][0] <= t:
            _, i, k = heapq.heappop(waiting)
            w = weights[names[i]]
            heapq.heappush(ready, (-(-(k + 1) * total // w), i, k))
        _, i, k = heapq.heappop(ready)
        out[names[i]].append(t)
        w = weights[names[i]]
        if k + 1 < w:
            heapq.heappush(waiting, ((k + 1) * total // w, i, k + 1))
    return out


def plan(weights: dict[str | None, int], blocks: dict[str | None, int]) -> list[dict]:
    """Phases: for each source in it, the blocks it placed before, those in the phase, and its slots of a period."""
    done, start, rows, phase = dict.fromkeys(blocks, 0), 0, [], 0
    while active := {s: weights[s] for s in blocks if done[s] < blocks[s]}:
        total, at = sum(active.values()), period(active)
        left = {s: blocks[s] - done[s] for s in active}
        last = min((left[s] - 1) // w * total + at[s][(left[s] - 1) % w] for s, w in active.items())
        for s, w in active.items():
            n = (last + 1) // total * w + sum(1 for x in at[s] if x <= last % total and (last + 1) % total)
            rows.append({"source": s, "phase": phase, "done": done[s], "blocks": n, "w": w, "total": total, "start": start, "at": at[s]})
            done[s] += n
        start += last + 1
        phase += 1
    return rows


def _table(spark: SparkSession, rows: Iterable[tuple], schema: str, name: str) -> DataFrame:
    """``rows`` as a table in the shared folder, sent piece by piece; a hint to broadcast it if it is small."""
    rows, out, n = iter(rows), None, 0
    while piece := list(islice(rows, PIECE)):
        part = materialise(spark.createDataFrame(piece, schema).coalesce(1), name)
        out, n = part if out is None else out.union(part), n + len(piece)
    out = spark.createDataFrame([], schema) if out is None else out
    return F.broadcast(out) if n <= BROADCAST_ROWS else out


def mix(docs: DataFrame, weights: dict[str, int], default: int = 1, block_docs: int = BLOCK_DOCS, carry: bool = False) -> DataFrame:
    """Each document's block, its slot in the mix with release and deadline, and its position.

    Reads ``doc_id`` and ``source`` of ``docs``; returns doc_id, source, block (of its source, from 0), slot,
    release and deadline (slots: the block has release <= slot < deadline), phase and position, by which the mix
    is read; with ``carry`` all columns of ``docs`` come first but those of these names, which give way. All rows are placed, in an order within their
    source that depends on ids alone (with ``carry``, on their texts where ids repeat). Sources without a weight have ``default``; a null source is a source of
    its own. Null ids and repeated rows are rows like any other. The last block of a source may be smaller than
    ``block_docs``, so positions rise but may have gaps. An empty table gives an empty result.
    """
    if default < 1 or any(w < 1 for w in weights.values()):
        raise ValueError("weights are whole numbers of at least 1")
    spark = docs.sparkSession
    made = list(MADE)
    d = (docs.drop(*made) if carry else docs.select("doc_id", "source")).withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "source"), F.lit(BUCKETS)))
    d = d.withColumn("_text", F.xxhash64("text") if carry and "text" in docs.columns else F.lit(0).cast("long"))
    counts = d.groupBy("source", "_bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("_bucket")) - F.col("n")
    counts = counts.select(F.col("source").alias("_s"), F.col("_bucket").alias("_b"), "n", before.alias("_before"))
    sizes = {r["_s"]: r.n for r in counts.groupBy("_s").agg(F.sum("n").alias("n")).collect()}  # one row a source
    own = {s: weights.get(s, default) for s in sizes}
    if sum(own.values()) > PERIOD:
        raise ValueError(f"the weights add up to more than {PERIOD}")
    rows = plan(own, {s: -(-n // block_docs) for s, n in sizes.items()})
    phases = _table(spark, ((r["source"], r["phase"], r["done"], r["blocks"], r["w"], r["total"], r["start"]) for r in rows), _PHASES, "phases")
    # of a period only the blocks that the phase has
    slots = _table(spark, ((r["source"], r["phase"], k, t) for r in rows for k, t in enumerate(r["at"][: r["blocks"]])), _SLOTS, "slots")

    place = F.row_number().over(Window.partitionBy("source", "_bucket").orderBy(F.xxhash64("doc_id"), "doc_id", "_text"))
    d = d.withColumn("_place", place).join(counts.drop("n"), F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    d = d.withColumn("_rank", F.col("_before") + F.col("_place") - 1).withColumn("block", F.expr(f"_rank div {block_docs}"))
    inside = (F.col("block") >= F.col("_done")) & (F.col("block") < F.col("_done") + F.col("_blocks"))
    d = d.join(phases, F.col("source").eqNullSafe(F.col("_source")) & inside).withColumn("_k", F.col("block") - F.col("_done"))
    d = d.join(slots, F.col("source").eqNullSafe(F.col("_source2")) & (F.col("_phase") == F.col("_phase2")) & (F.expr("_k % _w") == F.col("_r")))
    d = d.withColumns(
        {
            "slot": F.expr("_start + _k div _w * _total + _at"),
            "release": F.expr("_start + _k * _total div _w"),
            "deadline": F.expr("_start + ((_k + 1) * _total + _w - 1) div _w"),
            "phase": F.col("_phase"),
        }
    ).withColumn("position", F.col("slot") * block_docs + F.col("_rank") % block_docs)
    kept = [c for c in docs.columns if c not in made] if carry else ["doc_id", "source"]
    return d.select(*kept, *made)


def in_order(docs: DataFrame, weights: dict[str, int], default: int = 1, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """The columns of ``docs``, whatever their names, in the order of the mix: partitions are ranges of positions, sorted within."""
    own = {c: f"_own_{c}" for c in MADE if c in docs.columns}
    mixed = mix(docs.withColumnsRenamed(own), weights, default, block_docs, carry=True)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return mixed.repartitionByRange(n, "position").sortWithinPartitions("position").select(*(F.col(own.get(c, c)).alias(c) for c in docs.columns))


def positions(docs: DataFrame, weights: dict[str, int], default: int = 1, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """``docs`` (without a ``position`` of its own) with its rows' positions in the mix."""
    own = {c: f"_own_{c}" for c in MADE if c in docs.columns}
    mixed = mix(docs.withColumnsRenamed(own), weights, default, block_docs, carry=True)
    return mixed.select(*(F.col(own.get(c, c)).alias(c) for c in docs.columns), "position")
