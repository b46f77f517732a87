"""N-gram Jaccard self-join with prefix trees.

A document is its set of word n-grams. Which documents can be linked at all is decided by prefixes, twice:

* Of each set the n-grams of the lowest hashes are taken, some more than a prefix filter needs, so that two sets over
  the threshold share not one but a known number of them. They are counted over the whole corpus, exactly. A document
  with fewer shared ones than that number has no partner.
* Of the shared ones the commonest, all but one of that number, can be left out again: what is left, rare n-grams
  first by their exact count, still has one in common with every partner's.

Documents with an n-gram in common there form a branch; branches of the same documents are one. Bounds by size and by
bucket counts leave out pairs that can't reach the threshold; a pair left is tried in one branch. Their whole sets, in one order
(commonest n-grams of the branch first), are stored in a radix tree, and all probes of the branch walk it together:
a node adds its overlap with every probe once for all sets below it, and a probe leaves a subtree as soon as what
remains can't reach the threshold. Large branches are cut into blocks of their documents, each probed by the same few
leaders; what the leaders don't connect comes back in the next round with others.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, components, drop_tables, groups, materialise, signed, windows

#: Hundredths of a set by which its prefix is longer than it must be.
EXTRA = 10
#: Members of a set for each bucket of its signature, which bounds the overlap of two sets from above; least buckets.
BUCKET, LEAST = 2, 64
#: Branches of up to so many documents and n-grams are compared in one go; larger ones by leaders against blocks of that size.
SMALL, TOKENS = 512, 16_000_000
#: Leaders of a large branch in the first rounds, and in each later one.
LEADERS = (8, 64, 512)


def _need(a, b, percent: int):
    """Least overlap of sets of these sizes for 100 * intersection >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    """Each row's set of n-gram hashes, sorted."""
    for part, words in blocks(batches, lower=True):
        grams, at = windows(words.hashes, n), 0
        for i, k in enumerate(words.counts.tolist()):
            s = np.sort(grams[at : at + k - n + 1] if k >= n else windows(words.hashes[at : at + k], max(k, 1)))
            at += k
            yield part, i, s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) > 1 else s


def _prefix(size: int, percent: int) -> int:
    need = -(-size * percent // 100)
    return min(size, size - need + 1 + size * EXTRA // 100)


#: How many n-grams of their prefixes any two linked documents share at least, by the size of one.
_SHARED = f"(1 + ((size * {{percent}} + 99) div 100 * {EXTRA}) div 100)"


def _describe(n: int, percent: int):
    """Per document its set's size, 128-bit key and prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        heads: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            doc, size, s1, s2 = (pa.array(c, pa.int64()) for c in zip(*rows))
            ends = np.concatenate(([0], np.cumsum([len(h) for h in heads]))).astype(np.int32)
            pre = pa.ListArray.from_arrays(pa.array(ends), pa.array(signed(np.concatenate(heads))))
            rows.clear()
            heads.clear()
            return pa.RecordBatch.from_arrays([doc, size, s1, s2, pre], ["doc_id", "size", "s1", "s2", "prefix"])

        for part, i, s in _sets(batches, n):
            d = xxhash.xxh3_128_digest(s.tobytes())
            rows.append((part.column(0)[i].as_py(), len(s), int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)))
            heads.append(s[: _prefix(len(s), percent)])
            held += len(heads[-1])
            if held >= 500_000 or len(rows) >= 5000:
                yield flush()
                held = 0
        if rows:
            yield flush()

    return run


def _signature(s: np.ndarray) -> bytes:
    """Counts of the set's members in each of a power of two of buckets, by the upper bits; 255 stands for any larger count."""
    bits = max(LEAST, len(s) // BUCKET).bit_length() - 1
    return np.minimum(np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


class Signatures:
    """Signatures of some sets, compared at the shorter one's number of buckets (one of twice as many is folded)."""

    def __init__(self, found: list[bytes]):
        self.width = np.array([len(x) for x in found])
        self.at: dict[int, np.ndarray] = {}
        self.rows: dict[int, np.ndarray] = {}
        for w in np.unique(self.width).tolist():
            who = np.flatnonzero((self.width == w) | (self.width == 2 * w))
            rows = [np.frombuffer(found[i], np.uint8) for i in who]
            folded = [r if len(r) == w else np.where((r[::2] == 255) | (r[1::2] == 255), 255, np.minimum(r[::2].astype(np.uint16) + r[1::2], 255)).astype(np.uint8) for r in rows]
            place = np.full(len(found), -1)
            place[who] = np.arange(len(who))
            self.at[w], self.rows[w] = place, np.stack(folded)

    def most(self, i: int, others: np.ndarray) -> np.ndarray:
        """Overlaps with set i that the others can have at most."""
        out = np.full(len(others), np.iinfo(np.int64).max)
        for w in {int(self.width[i]), int(self.width[i]) // 2} & set(self.rows):
            level = self.width[others] == w if w < self.width[i] else self.width[others] >= w
            level &= self.at[w][others] >= 0
            if level.any():
                least = np.minimum(self.rows[w][self.at[w][i]], self.rows[w][self.at[w][others[level]]])
                most = least.sum(axis=1, dtype=np.int64)
                most[(least == 255).any(axis=1)] = np.iinfo(np.int64).max
                out[level] = most
        return out


def _whole(n: int):
    """Whole sets and signatures of the rows whose key is the wanted one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            cols = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))]
            rows.clear()
            return pa.RecordBatch.from_arrays(cols, ["sid", "size", "sig", "grams"])

        for part, i, s in _sets(batches, n):
            if int.from_bytes(xxhash.xxh3_128_digest(s.tobytes())[:8], "big", signed=True) != part.column(part.schema.get_field_index("s1"))[i].as_py():
                continue  # another text of a repeated doc_id
            rows.append((part.column(part.schema.get_field_index("sid"))[i].as_py(), len(s), _signature(s), s.tobytes()))
            held += len(s)
            if held >= 500_000 or len(rows) >= 5000:
                yield flush()
                held = 0
        if rows:
            yield flush()

    return run


def _screen(percent: int):
    """Of each block's pairs those that sizes and signatures allow, with a leader in each; two leaders meet in the first block alone.

    A pair that shares several branches is given in the first of them only (``own`` lists a document's branches).
    """
    names = ["tok", "block", "a", "b", "ca", "cb", "la", "lb"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, "tok", "block"):
            sid, size, comp, lead = (g.column(c).to_numpy(zero_copy_only=False) for c in ("sid", "size", "comp", "lead"))
            sig = Signatures(g.column("sig").to_pylist())
            tok, block = (g.column(c)[0].as_py() for c in ("tok", "block"))
            before = [frozenset(t for t in own if t < tok) for own in g.column("own").to_pylist()]
            left, right = [], []
            for i in np.flatnonzero(lead):
                others = np.flatnonzero((comp != comp[i]) & (~lead | ((block == 0) & (np.arange(len(lead)) > i))))
                need = _need(int(size[i]), size[others], percent)
                fit = np.minimum(size[i], size[others]) >= need
                others, need = others[fit], need[fit]
                found = [j for j in others[sig.most(i, others) >= need].tolist() if before[i].isdisjoint(before[j])]
                left += [i] * len(found)
                right += found
            if left:
                i, j = np.array(left), np.array(right)
                cols = [np.full(len(i), tok), np.full(len(i), block), sid[i], sid[j], comp[i], comp[j], lead[i], lead[j]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    return run


class _Node:
    __slots__ = ("run", "below", "ends", "least", "most")

    def __init__(self, run: np.ndarray, least: int, most: int):
        self.run, self.below, self.ends, self.least, self.most = run, {}, [], least, most


class PrefixTree:
    """Sets of numbers, each sorted, as a radix tree; a node knows the least and the largest size of the sets below it."""

    def __init__(self, sets: list[np.ndarray]):
        self.root = _Node(np.empty(0, np.int64), 1 << 60, 0)
        for who, s in enumerate(sets):
            self._insert(s, who)

    def _insert(self, s: np.ndarray, who: int) -> None:
        node, at = self.root, 0
        while True:
            node.least, node.most = min(node.least, len(s)), max(node.most, len(s))
            if at == len(s):
                node.ends.append(who)
                return
            child = node.below.get(s[at])
            if child is None:
                node.below[s[at]] = new = _Node(s[at:], len(s), len(s))
                new.ends.append(who)
                return
            m = min(len(child.run), len(s) - at)
            differ = np.flatnonzero(child.run[:m] != s[at : at + m])
            k = int(differ[0]) if len(differ) else m
            if k < len(child.run):  # part the branch
                upper = _Node(child.run[:k], child.least, child.most)
                child.run = child.run[k:]
                upper.below[child.run[0]] = child
                node.below[s[at]] = child = upper
            node, at = child, at + k

    def linked(self, probes: list[np.ndarray], width: int, percent: int) -> Iterator[tuple[np.ndarray, int]]:
        """(probes, stored set) that reach the threshold: one walk for all probes. Numbers are below ``width``."""
        size = np.array([len(p) for p in probes], np.int64)
        # which probes have a number
        numbers = np.concatenate(probes)
        order = np.argsort(numbers, kind="stable")
        having = np.repeat(np.arange(len(probes)), size)[order]
        at = np.searchsorted(numbers[order], np.arange(width + 1))
        todo = [(self.root, 0, np.arange(len(probes)), np.zeros(len(probes), np.int64))]
        while todo:
            node, depth, who, overlap = todo.pop()
            if len(node.run):
                start, count = at[node.run], at[node.run + 1] - at[node.run]
                places = np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())
                overlap = overlap + np.bincount(having[places], minlength=len(probes))[who]
                depth += len(node.run)
            if node.ends:
                reach = who[overlap >= _need(size[who], depth, percent)]
                if len(reach):
                    yield from ((reach, e) for e in node.ends)
            for child in node.below.values():
                most = overlap + np.minimum(child.most - depth, size[who] - overlap)
                on = most >= _need(size[who], child.least, percent)
                if on.any():
                    todo.append((child, depth, who[on], overlap[on]))


def tree_links(sets: list[np.ndarray], probes: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs (probe, other) of these sets over the threshold, by one tree of them all."""
    numbers, own, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.empty(len(numbers), np.int64)
    place[np.argsort(-count, kind="stable")] = np.arange(len(numbers))  # commonest first
    cuts = np.cumsum([len(s) for s in sets])[:-1]
    ordered = [np.sort(x) for x in np.split(place[own], cuts)]
    for reach, other in PrefixTree(ordered).linked([ordered[i] for i in probes], len(numbers), percent):
        yield from ((int(i), other) for i in probes[reach] if i != other)


def _walk(percent: int):
    """Links of components within each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, "tok", "block"):
            comp, lead = (g.column(c).to_numpy(zero_copy_only=False) for c in ("comp", "lead"))
            probes = np.flatnonzero(lead)
            if not len(probes):
                continue
            sets = [np.frombuffer(x, np.uint64) for x in g.column("grams").to_pylist()]
            found = {(min(comp[i], comp[j]), max(comp[i], comp[j])) for i, j in tree_links(sets, probes, percent) if comp[i] != comp[j]}
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*found)], ["a", "b"])

    return run


def _round(live: DataFrame, own: DataFrame, whole: DataFrame, leaders: int, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """Links (a, b) of components by the branches ``live`` (tok, sid, size, comp), and the (tok, sid) still to be tried, if any.

    ``own`` has each document's branches (sid, own): of those that two documents share, the first tries the pair.

    Every pair of two components has a member outside the branch's largest one. Where those are few they are the leaders,
    and the branch is done; else some rows lead, which are done with, and what they connect leaves fewer outside.
    """
    parts = live.groupBy("tok", "comp").agg(F.count("*").alias("c"), F.sum("size").alias("g"))
    span = parts.groupBy("tok").agg(F.sum("c").alias("n"), F.sum("g").alias("grams"), F.count("*").alias("comps"), F.max(F.struct("c", "comp")).alias("main")).where("comps > 1")
    cut = F.greatest(F.ceil(F.col("n") / SMALL), F.ceil(F.col("grams") / TOKENS)).cast("int")
    span = span.select("tok", "n", cut.alias("blocks"), F.col("main.comp").alias("main"), ((cut > 1) & (F.col("n") - F.col("main.c") > SMALL)).alias("many"))
    rows = materialise(live.join(span, "tok").withColumn("lead", ~F.col("many") & (F.col("comp") != F.col("main"))), "rows")
    large = rows.where("many")
    if some_large := not large.isEmpty():
        # (the limit on the place is applied in each task before the shuffle)
        place = F.row_number().over(Window.partitionBy("tok").orderBy(F.xxhash64("sid"), "sid"))
        first = large.select("tok", "sid").withColumn("place", place).where(F.col("place") <= leaders).select("tok", "sid", F.lit(True).alias("first"))
        large = materialise(large.join(first, ["tok", "sid"], "left").withColumn("lead", F.coalesce("first", F.lit(False))).drop("first"), "large")
    alone = F.array(F.pmod(F.xxhash64("sid", F.lit(1)), F.col("blocks")).cast("int"))
    block = F.when(F.col("lead"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(alone)
    dealt = large.unionByName(rows.where("NOT many")).select("tok", "n", "sid", "size", "comp", "lead", F.explode(block).alias("block"))
    by = ["tok", "block"]
    dealt = dealt.join(whole.select("sid", "sig"), "sid").join(own, "sid").repartition(*by).sortWithinPartitions(*by, "sid")
    pairs = materialise(dealt.mapInArrow(_screen(percent), "tok long, block int, a long, b long, ca long, cb long, la boolean, lb boolean"), "pairs")
    sides = (pairs.select(*by, F.col(s).alias("sid"), F.col(f"c{s}").alias("comp"), F.col(f"l{s}").alias("lead")) for s in "ab")
    kept = reduce(DataFrame.union, sides).distinct()
    full = kept.join(whole.select("sid", "grams"), "sid").repartition(*by).sortWithinPartitions(*by, "sid")
    links = materialise(full.mapInArrow(_walk(percent), "a long, b long").distinct(), "links")
    drop_tables(pairs, rows)
    return links, large.where("NOT lead").select("tok", "sid") if some_large else None


def _merged(label: DataFrame, links: DataFrame) -> DataFrame:
    """``label`` (sid, size, comp) with the components that ``links`` (a, b) of components make."""
    if links.isEmpty():
        return label
    new = components(links)
    return materialise(label.join(new, label["comp"] == new["node"], "left").select("sid", "size", F.coalesce("component", "comp").alias("comp")), "labels")


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Components of the links between documents whose n-gram sets reach ``percent`` hundredths of Jaccard.

    Takes ``doc_id`` and ``text`` of ``docs`` (other columns are ignored) and returns doc_id, n_shingles and
    component_id, the smallest doc_id that links reach. Words are lower-cased (A-Z only) and separated by ASCII
    white space; a text of fewer than ``n`` words has its whole sequence as its one n-gram; a null or empty text
    has the empty set and is linked with nothing. Rows that repeat a doc_id are one node, linked by any of its
    texts; n_shingles is each row's own. A row with a null doc_id is linked with nothing and its component_id is
    null. Empty tables give empty results.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    read = materialise(d.mapInArrow(_describe(n, percent), "doc_id long, size long, s1 long, s2 long, prefix array<long>"), "sets")

    # one class for each set; its smallest doc_id stands for it
    real = read.where("size > 0 AND doc_id IS NOT NULL")
    heads = real.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.any_value("size").alias("size"), F.any_value("prefix").alias("prefix"))
    heads = materialise(heads.withColumn("sid", F.monotonically_increasing_id()), "heads")  # (fixed once it is written)
    told, classes = materialise(read.drop("prefix"), "documents"), materialise(heads.drop("prefix"), "classes")
    drop_tables(read)

    # exact counts of the prefixes' n-grams; what only one class has is of no use
    each = heads.select("sid", F.expr(_SHARED.format(percent=percent)).cast("int").alias("k"), F.explode("prefix").alias("tok"))
    counts = materialise(each.groupBy("tok").agg(F.count("*").alias("df")).where("df > 1"), "counts")
    mine = each.join(counts.hint("shuffle_hash"), "tok").groupBy("sid", "k").agg(F.array_sort(F.collect_list(F.struct("df", "tok"))).alias("t"))
    mine = mine.where("size(t) >= k").select("sid", F.explode(F.expr("slice(t, 1, size(t) - k + 1)")).alias("t"))
    rare = materialise(mine.select("sid", F.col("t.tok").alias("tok")), "rare")
    drop_tables(counts, heads)
    # branches with the same documents are one: told by their number and by two hashes of the set
    marks = [F.bit_xor(F.xxhash64("sid", F.lit(i))).alias(f"x{i}") for i in (0, 1)]
    same = rare.groupBy("tok").agg(F.count("*").alias("n"), *marks).where("n > 1").groupBy("n", "x0", "x1").agg(F.min("tok").alias("tok"))
    branch = materialise(rare.join(same.select("tok", "n"), "tok"), "branches")

    # whole sets of the documents that are left
    used = materialise(classes.join(branch.select("sid").distinct(), "sid").select("sid", "size", "s1", "rep"), "used")
    texts = d.where("text IS NOT NULL").join(used.select("sid", "s1", F.col("rep").alias("doc_id")).hint("shuffle_hash"), "doc_id")
    whole = texts.select("sid", "s1", "text").mapInArrow(_whole(n), "sid long, size long, sig binary, grams binary").dropDuplicates(["sid"])
    whole = materialise(whole, "whole")
    drop_tables(rare)

    # first each document in its largest branch, where copies of many meet; then in all of them
    label = used.select("sid", "size", F.col("rep").alias("comp"))
    largest = branch.groupBy("sid").agg(F.max(F.struct("n", "tok")).alias("x")).select(F.col("x.tok").alias("tok"), "sid")
    links, _ = _round(largest.join(label, "sid"), largest.select("sid", F.array("tok").alias("own")), whole, LEADERS[0], percent)
    label = _merged(label, links)
    left, turn = branch.select("tok", "sid"), 0
    own = materialise(branch.groupBy("sid").agg(F.collect_list("tok").alias("own")), "own")
    while left is not None:
        links, left = _round(left.join(label, "sid"), own, whole, LEADERS[min(turn, len(LEADERS) - 1)], percent)
        label, turn = _merged(label, links), turn + 1

    comps = classes.select("s1", "s2", "sid", "rep").join(label.select("sid", "comp"), "sid", "left").select("s1", "s2", F.coalesce("comp", "rep").alias("comp"))
    out = told.select("doc_id", F.col("size").alias("n_shingles"), "s1", "s2").join(comps, ["s1", "s2"], "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("comp")).alias("comp"))
    # a repeated doc_id ties the components of its texts together
    ids = out.where("comp IS NOT NULL").groupBy("doc_id").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
    ties = materialise(out.join(ids.select("doc_id", "lo"), "doc_id").where("comp > lo").select(F.col("lo").alias("a"), F.col("comp").alias("b")).distinct(), "ties")
    if not ties.isEmpty():
        new = components(ties)
        out = out.join(new, out["comp"] == new["node"], "left").select("doc_id", "n_shingles", F.coalesce("component", "comp").alias("comp"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id")).alias("component_id"))
