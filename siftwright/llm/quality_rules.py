"""Quality rules by weak supervision, DataFrame functions only.

Each rule votes for (1), votes against (-1) or abstains (0). A document's votes are a pattern; there are at most
3^rules of them, whatever the corpus, so expectation-maximisation runs over counted patterns: a rule has one
accuracy on good and one on bad documents, abstaining tells nothing, and a pattern's posterior probability of
good decides. EM trusts rules that others bear out, so what matters is seen by more than one rule (symbols by their number,
by the share of letters and by the words' endings); a lone vote of a rule that is often alone is overruled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

WINDOW = 8
ROUNDS = 60
THRESHOLD = 0.5
#: Where EM starts, and how many votes that is worth: share of good documents, accuracy on good and on bad ones.
START = (0.8, 0.995, 0.3)
PRIOR = 20.0

_SPACE = r"[\x20\x09-\x0D]+"


def _rule(against: str, for_: str) -> str:
    return f"CASE WHEN {against} THEN -1 WHEN {for_} THEN 1 ELSE 0 END"


#: Votes over the features below; integers throughout.
RULES: dict[str, str] = {
    "length": _rule("n_words < 20", "n_words >= 50"),
    "repeats": _rule("100 * n_repeat_words > 20 * n_words", "100 * n_repeat_words <= 5 * n_words"),
    "symbols": _rule("10 * n_symbols > n_words", "100 * n_symbols <= n_words"),
    "lines": _rule("10 * n_dup_lines > 3 * n_lines", "n_dup_lines = 0 AND n_lines > 1"),
    "word_length": _rule("word_chars < 2 * n_words OR word_chars > 15 * n_words", "word_chars >= 3 * n_words AND word_chars <= 10 * n_words"),
    "shouting": _rule("10 * n_marks > 3 * n_words", "20 * n_marks <= n_words"),
    "capitals": _rule("2 * n_upper > word_chars", "10 * n_upper <= word_chars"),
    "letters": _rule("100 * n_letters < 85 * word_chars", "100 * n_letters >= 93 * word_chars"),
    "endings": _rule("10 * n_endings > n_words", "100 * n_endings <= n_words"),
}


def _count(chars: str) -> Column:
    return F.length(F.regexp_replace("text", f"[^{chars}]+", "")).cast("long")


def features(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id and the integers the rules read, from whole texts; a null text has no words and no lines."""
    parts = ", ".join(f"wh[i + {j}]" for j in range(window))
    d = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    d = d.select(
        "doc_id",
        F.array_remove(F.split("text", _SPACE), "").alias("w"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        _count("#*$%&|<>").alias("n_symbols"),
        _count("!").alias("n_marks"),
        _count("A-Z").alias("n_upper"),
        F.length(F.regexp_replace("text", r"[^\p{L}\p{N}]+", "")).cast("long").alias("n_letters"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>](?=[\x20\x09-\x0D]|\z)")).cast("long").alias("n_endings"),
    )
    d = d.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_marks",
        "n_upper",
        "n_letters",
        "n_endings",
        F.transform("w", lambda x: F.xxhash64(x)).alias("wh"),
    )
    hashes = f"CASE WHEN size(wh) >= {window} THEN transform(sequence(0, size(wh) - {window}), i -> xxhash64({parts})) ELSE CAST(array() AS array<bigint>) END"
    d = d.select("*", F.expr(hashes).alias("h")).drop("wh")
    # only texts with some repeated window sort theirs; equal ones are then neighbours
    d = d.select("*", F.expr("CASE WHEN size(array_distinct(h)) < size(h) THEN sort_array(transform(h, (x, i) -> named_struct('h', x, 'i', i))) END").alias("s")).drop("h")
    again = "sort_array(transform(filter(s, (x, i) -> x.h <=> get(s, i - 1).h OR x.h <=> get(s, i + 1).h), x -> x.i))"
    merged = f"aggregate({again}, named_struct('end', 0, 'n', 0L), (z, p) -> named_struct('end', p + {window}, 'n', z.n + p + {window} - greatest(z.end, p)), z -> z.n)"
    return d.select("*", F.expr(f"CASE WHEN s IS NULL THEN 0L ELSE {merged} END").alias("n_repeat_words")).drop("s")


def posteriors(patterns: DataFrame, rules: int, rounds: int = ROUNDS) -> DataFrame:
    """(votes, posterior, good_accuracy, bad_accuracy) from (votes array<int>, n): EM in one expression over one row.

    The row holds at most 3^rules patterns. Without any pattern there is no row.
    """
    pi, a, b = START
    init = f"named_struct('pi', {pi}D, 'a', array_repeat({a}D, {rules}), 'b', array_repeat({b}D, {rules}))"

    def expect(s: str) -> str:
        vote = "CASE x.v[r] WHEN 1 THEN {0} WHEN -1 THEN {1} ELSE 1D END"
        return (
            f"aggregate(sequence(0, {rules - 1}), named_struct('g', {s}.pi, 'b', 1D - {s}.pi), (z, r) -> named_struct("
            f"'g', z.g * {vote.format(f'{s}.a[r]', f'1D - {s}.a[r]')}, 'b', z.b * {vote.format(f'1D - {s}.b[r]', f'{s}.b[r]')}), z -> z.g / (z.g + z.b))"
        )

    def total(what: str, when: str) -> str:
        return f"aggregate(w, 0D, (t, x) -> t + CASE WHEN {when} THEN {what} ELSE 0D END)"

    weighed = f"transform(ps, x -> named_struct('v', x.v, 'n', x.n, 'p', {expect('s')}))"
    share = f"({total('x.n * x.p', 'true')} + {PRIOR * pi}D) / ({total('x.n', 'true')} + {PRIOR}D)"
    good = f"transform(sequence(0, {rules - 1}), r -> ({total('x.n * x.p', 'x.v[r] = 1')} + {PRIOR * a}D) / ({total('x.n * x.p', 'x.v[r] <> 0')} + {PRIOR}D))"
    bad = f"transform(sequence(0, {rules - 1}), r -> ({total('x.n * (1D - x.p)', 'x.v[r] = -1')} + {PRIOR * b}D) / ({total('x.n * (1D - x.p)', 'x.v[r] <> 0')} + {PRIOR}D))"
    step = f"transform(array({weighed}), w -> named_struct('pi', {share}, 'a', {good}, 'b', {bad}))[0]"
    one = patterns.agg(F.sort_array(F.collect_list(F.struct(F.col("votes").alias("v"), F.col("n").cast("double").alias("n")))).alias("ps"))
    one = one.select("ps", F.expr(f"aggregate(sequence(1, {rounds}), {init}, (s, t) -> {step})").alias("m"))
    one = one.select("m", F.explode("ps").alias("x"))
    return one.select(F.col("x.v").alias("votes"), F.expr(expect("m")).alias("posterior"), F.col("m.a").alias("good_accuracy"), F.col("m.b").alias("bad_accuracy"))


def quality_rules(docs: DataFrame, rules: dict[str, str] = RULES, threshold: float = THRESHOLD, rounds: int = ROUNDS) -> DataFrame:
    """Features, votes, posterior and verdict of each document.

    Takes doc_id and text (other columns are ignored). Returns doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, kept, posterior and votes (in the rules' order). A document of
    fewer than 20 words (so a null or empty one), or with more than 30 in 100 words inside repeated windows,
    fails the base and isn't kept; else its posterior decides. Repeated rows each get their own row, with the
    same verdict; null ids are kept as they are. An empty table gives an empty result.
    """
    told = materialise(features(docs).select("*", F.array(*(F.expr(x) for x in rules.values())).alias("votes")), "features")
    patterns = told.groupBy("votes").agg(F.count("*").alias("n"))
    post = posteriors(patterns, len(rules), rounds).select("votes", "posterior")
    out = told.join(F.broadcast(post), "votes", "left")  # at most 3^rules rows
    failed = F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words")
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (F.col("posterior") >= threshold)).alias("kept"), "posterior", "votes",
    )
