"""Benchmark decontamination: prefix-filtered containment join, DataFrame functions only.

Windows of benchmark items are sets of positioned shingles (runs of up to three words). Containment asks for all
of a window's shingles, so the prefix that any holder must have is one shingle: the one that is rarest in the
corpus. Documents are scanned once for the benchmark's shingles; their hits are joined with the windows on that
one, windows that would reach over either end of the document's words or past its run of hits are left out by
length and position, and the rest is verified word position by word position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_key

WINDOW = 10
SHINGLE = 3
#: Distinct benchmark shingles up to which they are a literal set inside the scan; beyond it, a shuffle join.
LITERALS = 50_000
#: Rows of windows, or of their items, up to which a join may broadcast them.
BROADCAST_WINDOWS = 100_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words of digits, ASCII letters (lower-cased) and all characters beyond ASCII; none for null."""
    # lower() is the same on ASCII, and much faster than translate()
    low = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(F.coalesce(low, F.lit("")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def shingles_of(hashes: str, k: int) -> Column:
    """Hashes of all runs of k words, from the column of word hashes."""
    parts = ", ".join(f"{hashes}[i + {j}]" for j in range(k))
    return F.expr(f"CASE WHEN size({hashes}) >= {k} THEN transform(sequence(0, size({hashes}) - {k}), i -> xxhash64({k}, {parts})) ELSE array() END")


def _hits(k: int, own: str) -> Column:
    """Structs (k, i, h) of the document's shingles of k words that are among the literals ``own``."""
    parts = ", ".join(f"wh[i + {j}]" for j in range(k))
    each = f"transform(sequence(0, size(wh) - {k}), i -> named_struct('k', {k}, 'i', i, 'h', xxhash64({k}, {parts})))"
    none = "CAST(array() AS array<struct<k:int,i:int,h:bigint>>)"
    return F.expr(f"CASE WHEN size(wh) >= {k} THEN filter({each}, x -> x.h IN ({own})) ELSE {none} END")


def _windows(bench: DataFrame, window: int) -> DataFrame:
    """Distinct (item_id, k, sh): a window as its shingles of k words in order."""
    w = bench.select("item_id", words_of(F.col("text").cast("string")).alias("w")).where("size(w) > 0")
    w = w.select("item_id", F.transform("w", lambda x: F.xxhash64(x)).alias("wh"))
    w = w.select("item_id", F.expr(f"least(size(wh), {window})").alias("len"), "wh")
    w = w.select("item_id", "len", F.explode(F.expr("transform(sequence(1, size(wh) - len + 1), p -> slice(wh, p, len))")).alias("wh"))
    w = w.select("item_id", "len", "wh", F.expr(f"least(len, {SHINGLE})").alias("k"))
    sh = F.lit(None)
    for k in range(1, SHINGLE + 1):
        sh = F.when(F.col("k") == k, shingles_of("wh", k)).otherwise(sh)
    return w.select("item_id", "len", "k", sh.alias("sh")).distinct()


def decontaminate(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """Overlap of each document with the benchmark's windows of ``window`` consecutive words.

    Takes doc_id and text of ``docs``, item_id and text of ``bench`` (other columns are ignored). Returns per
    document doc_id, th and tl (its text's key), n_words, n_hit (words inside any occurrence of a window),
    n_items, items_sha256 and contaminated. An item of fewer words is one window; an item or document without
    words, null or empty, has none. Equal texts are judged once. A null item_id counts as no item in n_items,
    though its windows are hit. Repeated items, and empty tables on either side, change nothing else.
    """
    d = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    wins = materialise(_windows(bench, window), "windows")
    ks = sorted(r.k for r in wins.select("k").distinct().collect())  # at most SHINGLE
    wanted = wins.select("k", F.explode("sh").alias("h")).distinct()
    few = wanted.limit(LITERALS + 1).collect()

    base = d.select("doc_id", *text_key(F.col("text")), words_of(F.col("text")).alias("w"))
    base = base.select("doc_id", "th", "tl", F.size("w").cast("long").alias("n_words"), F.transform("w", lambda x: F.xxhash64(x)).alias("wh"))
    if len(few) <= LITERALS:
        # one pass: per document its hits (k, position, shingle) in order
        hits = []
        for k in ks:
            own = ", ".join(f"{r.h}L" for r in few if r.k == k)
            hits.append(_hits(k, own))
        found = F.concat(*hits) if hits else F.expr("CAST(array() AS array<struct<k:int,i:int,h:bigint>>)")
        told = materialise(base.select("doc_id", "th", "tl", "n_words", found.alias("hits")), "hits")
        rows = told.where("size(hits) > 0 and th is not null").dropDuplicates(["th", "tl"])
    else:
        told = materialise(base.select("doc_id", "th", "tl", "n_words"), "hits")
        one = base.where("th is not null").dropDuplicates(["th", "tl"])
        spread = None
        for k in ks:
            part = one.select("th", "tl", "n_words", F.lit(k).alias("k"), F.posexplode(shingles_of("wh", k)).alias("i", "h"))
            spread = part if spread is None else spread.union(part)
        rows = spread.join(wanted, ["k", "h"]).groupBy("th", "tl", "n_words").agg(F.sort_array(F.collect_list(F.struct("k", "i", "h"))).alias("hits"))
    rows = materialise(rows, "texts")

    # the rarest shingle of each window, by the corpus
    each = rows.select("th", "tl", "n_words", F.posexplode("hits").alias("at", "x"), "hits").select("th", "tl", "n_words", "at", "x.*", "hits")
    often = rows.select(F.explode("hits").alias("x")).select("x.k", "x.h").groupBy("k", "h").agg(F.count("*").alias("n"))
    wins = wins.withColumn("w", F.xxhash64("k", "sh"))
    terms = wins.select("k", "w", "sh").distinct().select("k", "w", F.size("sh").alias("m"), F.posexplode("sh").alias("j", "h"))
    prefix = terms.join(often, ["k", "h"], "left").groupBy("k", "w").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "j")).alias("x"), F.count("*").alias("m"))
    # a window with a shingle that no document has occurs nowhere
    prefix = prefix.where("x.n > 0").select("k", "w", F.col("x.h").alias("h"), F.col("x.j").alias("j"))
    prefix = prefix.join(wins.select("k", "w", "len", "sh").distinct(), ["k", "w"])
    prefix = materialise(prefix, "prefix")
    # (windows that occur are few, their items may be many, so each side is counted by itself)
    items = materialise(wins.select("w", F.col("item_id").cast("string").alias("item")).distinct(), "items")
    prefix, items = (F.broadcast(x) if x.count() <= BROADCAST_WINDOWS else x for x in (prefix, items))

    # what a window can need around a hit, cut out before any shuffle
    context = F.slice("hits", F.greatest(F.col("at") + 2 - window, F.lit(1)), F.lit(2 * window))
    each = each.select("th", "tl", "n_words", "k", "h", "i", F.least(F.col("at"), F.lit(window - 1)).alias("c"), context.alias("ctx"))
    pairs = each.join(prefix, ["k", "h"])
    # position and length bounds: the window lies within the document, and its run within the hits
    pairs = pairs.where("i >= j AND c >= j AND i - j + len <= n_words AND size(ctx) >= c - j + size(sh)")
    # (the bounds above are not sure to be looked at first)
    run = F.slice("ctx", F.greatest(F.col("c") - F.col("j") + 1, F.lit(1)), F.size("sh"))
    pairs = pairs.withColumn("run", run).where("get(run, size(sh) - 1).i = i - j + size(sh) - 1 AND get(run, 0).i = i - j AND get(run, 0).k = k AND get(run, size(sh) - 1).k = k AND transform(run, x -> x.h) = sh")
    occur = pairs.select("th", "tl", "n_words", "w", (F.col("i") - F.col("j")).alias("p"), "len")

    # per text: covered words from the merged spans, and the items of its windows
    spans = occur.groupBy("th", "tl").agg(F.sort_array(F.collect_set(F.struct("p", "len"))).alias("spans"))
    covered = F.expr("aggregate(spans, named_struct('end', 0, 'n', 0L), (s, x) -> named_struct('end', greatest(s.end, x.p + x.len), 'n', s.n + greatest(0, x.p + x.len - greatest(s.end, x.p)))).n")
    named = occur.select("th", "tl", "w").distinct().join(items, "w").groupBy("th", "tl").agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = spans.select("th", "tl", covered.alias("n_hit")).join(named, ["th", "tl"])
    out = told.select("doc_id", "th", "tl", "n_words").join(found, ["th", "tl"], "left")
    return out.select(
        "doc_id",
        "th",
        "tl",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
