"""Operators over whole conversations: token sums, profiles, policies, pairwise comparisons, windows."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rules, signals, tokens

# Keyword lists of the risk policy.
HIGH_RISK = (
    "```", "traceback", "exception", "error", "api_key", "token", "password", "http://", "https://", "file:", "/app/", "/users/", "def ", "class ",
    "import ", "select ", "insert ", "update ", "delete ", "金融", "股票", "投资", "法律", "合同", "医疗", "诊断", "药", "价格", "成本", "$", "¥", "%",
)
LOW_RISK = (
    "谢谢", "你好", "好的", "不客气", "顺便", "就是说", "其实", "反正", "当然可以", "希望", "大概", "简单说", "总结", "历史", "背景", "metadata",
    "trace_id", "log_id", "status", "encoding", "file_size",
)
RATIOS = {"short": 0.95, "medium": 0.75, "long": 0.60, "very_long": 0.50}


def beside(a: DataFrame, b: DataFrame, on: str | list[str] = "conv_id", how: str = "inner") -> DataFrame:
    """``a`` joined with ``b`` by conversation, merged and never broadcast.

    Texts made of columns are far larger than a planner takes them for, and what it broadcasts goes through the driver.
    """
    return a.join(b.hint("merge"), on, how)


def conv_tokens(messages: DataFrame) -> DataFrame:
    """Per conversation: the multilingual sum with 4 for each message and its role, and the plugin's sum."""
    c, r = F.coalesce("content", F.lit("")), F.coalesce("role", F.lit(""))
    return messages.groupBy("conv_id").agg(
        F.sum(4 + tokens.multilingual(r) + tokens.multilingual(c)).alias("tokens"), F.sum(4 + tokens.plugin(c)).alias("plugin_tokens"), F.count("*").alias("messages")
    )


def block_tokens(blocks: Column) -> Column:
    """The plugin's estimate of a message whose content is a list of blocks (type, text): 4, and that of each block with text."""
    texts = F.filter(F.transform(blocks, lambda b: b["text"]), lambda t: t.isNotNull() & (t != ""))
    return 4 + F.aggregate(F.transform(texts, tokens.plugin), F.lit(0).cast("long"), lambda n, t: n + t.cast("long"))


def risk_policy(messages: DataFrame) -> DataFrame:
    """Per conversation: distinct risk and noise keywords, share of tool and assistant text, and the policy.

    A keyword is looked for in each message (none of them spans a line break between two), so sums need no joined text.
    """
    c = F.coalesce("content", F.lit(""))
    # (one bit a keyword: as many aggregates as keywords make code too long to be compiled, and lower each text again)
    bits = lambda low, words: sum((F.when(F.contains(low, F.lit(w)), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, w in enumerate(words)), F.lit(0).cast("long"))
    found = rules.let(F.lower(c), lambda low: F.struct(bits(low, HIGH_RISK).alias("risk"), bits(low, LOW_RISK).alias("noise")))
    n = F.length(c)
    g = messages.withColumn("_found", found).groupBy("conv_id").agg(
        F.bit_count(F.bit_or("_found.risk")).alias("risk_score"),
        F.bit_count(F.bit_or("_found.noise")).alias("noise_score"),
        F.sum(F.when(F.col("role").isin("tool", "assistant"), n).otherwise(0)).alias("other_chars"),
        F.greatest(F.lit(1), F.sum(n)).alias("chars"),
    )
    protected = F.col("risk_score") >= 2
    extreme = (F.col("noise_score") >= 3) | (F.col("other_chars") / F.col("chars") > 0.55)
    return g.select(
        "conv_id", "risk_score", "noise_score",
        F.when(protected, "protected").when(extreme, "extreme").otherwise("safe").alias("policy"),
        F.when(protected, 0.45).when(extreme, 0.22).otherwise(0.30).alias("target_ratio"),
    )


def char_ngrams(text: Column, n: int, short_whole: bool = False) -> Column:
    """Distinct runs of n characters; of a shorter text none, or itself."""
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(n))))
    return F.when(F.length(text) >= n, grams).otherwise(F.array(text) if short_whole else F.array().cast("array<string>"))


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    empty = (F.size(a) == 0) | (F.size(b) == 0)
    both = (F.size(a) == 0) & (F.size(b) == 0)
    return F.when(both, both_empty).when(empty, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def duplicate_ratio(messages: DataFrame, most: int = 30) -> DataFrame:
    """Share of similar pairs among the first ``most`` messages of each conversation; short ones count as pairs.

    Similar: the trigrams in common are more than six tenths of all. They are compared as 64-bit hashes, and only in pairs
    whose numbers of trigrams allow it.
    """
    w = Window.partitionBy("conv_id").orderBy("turn")
    m = messages.withColumn("i", F.row_number().over(w)).where(F.col("i") <= most)
    # (by characters: a substring of a text is looked for from its start)
    hashed = lambda c: F.transform(F.sequence(F.lit(0), F.length("content") - 3), lambda i: F.xxhash64(*(F.get(c, i + k) for k in range(3))))
    grams = F.array_distinct(rules.let(F.split("content", ""), hashed))
    # (bound once: the size is that of the same array)
    one = F.when(F.length("content") >= 20, F.transform(F.array(grams), lambda g: F.struct(F.col("i").alias("i"), F.size(g).alias("n"), g.alias("g")))[0])
    # the bounded list of a conversation is compared inside its own row
    lists = m.groupBy("conv_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(one)).alias("m"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    similar = F.expr(
        "aggregate(m, 0, (t, a) -> t + size(filter(m, b -> b.i > a.i AND 5 * least(a.n, b.n) > 3 * greatest(a.n, b.n)"
        " AND 8 * size(array_intersect(a.g, b.g)) > 3 * (a.n + b.n))))"
    )
    return lists.select("conv_id", pairs.cast("long").alias("pairs"), similar.cast("long").alias("similar"), (similar / F.greatest(pairs, F.lit(1))).alias("duplicate_ratio"))


def content_profile(messages: DataFrame) -> DataFrame:
    """Totals, roles, share of JSON, duplicates, length bucket, urgency and content flags of each conversation."""
    c = F.coalesce("content", F.lit(""))
    t = tokens.profile(c)
    g = messages.groupBy("conv_id").agg(
        F.sum(t).alias("total_tokens"),
        F.count("*").alias("message_count"),
        *(F.count_if(F.col("role") == r).alias(f"{r}_messages") for r in ("system", "user", "assistant", "tool")),
        F.sum(F.when(signals.json_marks(c) > F.length(c) * 0.05, t).otherwise(0)).alias("json_tokens"),
        F.sum(signals.specs_score(c)).alias("specs"),
        F.sum(signals.code_score(c)).alias("code"),
        F.sum(F.length(c)).alias("chars"),
    )
    g = beside(g, duplicate_ratio(messages).select("conv_id", "duplicate_ratio"))
    total, json_ratio = F.col("total_tokens"), F.col("json_tokens") / F.greatest(F.col("total_tokens"), F.lit(1))
    urgency = (
        F.when(total > 8000, 0.4).when(total > 4000, 0.3).when(total > 1500, 0.2).otherwise(0.0)
        + F.when(F.col("message_count") > 30, 0.2).otherwise(0.0) + F.when(F.col("duplicate_ratio") > 0.3, 0.2).otherwise(0.0) + F.when(json_ratio > 0.5, 0.1).otherwise(0.0)
    )
    return g.select(
        "conv_id", "total_tokens", "message_count", "system_messages", "user_messages", "assistant_messages", "tool_messages",
        F.when(total < 400, "short").when(total < 1500, "medium").when(total < 4000, "long").otherwise("very_long").alias("length_bucket"),
        json_ratio.alias("json_ratio"), (json_ratio > 0.1).alias("has_json"), "duplicate_ratio", F.least(urgency, F.lit(1.0)).alias("urgency"),
        ((F.col("specs") > F.col("chars") * 0.15) & (F.col("chars") > 100)).alias("is_specs"),
        ((F.col("code") > F.col("chars") * 0.1) & (F.col("chars") > 100)).alias("is_code"),
    )


def ratio_policy(profiles: DataFrame, override: float | None = None) -> DataFrame:
    """Keep ratio and method of each profile: an override, JSON, specs, code, else by length and duplicates."""
    base = F.lit(None).cast("double")
    for k, v in RATIOS.items():
        base = F.when(F.col("length_bucket") == k, v).otherwise(base)
    less = F.when(F.col("duplicate_ratio") > 0.3, 0.10).when(F.col("duplicate_ratio") > 0.1, 0.05).otherwise(0.0)
    as_json = F.col("json_ratio") > 0.3
    by_json = F.when(F.col("length_bucket") == "short", 0.70).when(F.col("length_bucket") == "medium", 0.60).otherwise(0.50)
    ratio = F.when(as_json, by_json).when(F.col("is_specs") | F.col("is_code"), 0.75).otherwise(F.round(F.greatest(base - less, F.lit(0.20)), 2))
    method = F.when(as_json, "json-first").when(F.col("is_specs"), "specs").when(F.col("is_code"), "code").otherwise("adaptive")
    if override is not None:
        ratio, method = F.lit(override), F.lit("user_override")
    return profiles.select(
        "conv_id", ratio.alias("keep_ratio"), method.alias("method"),
        F.when(as_json, True).when(F.lit(override is not None), False).otherwise(F.col("has_json")).alias("json_aware"),
        (F.col("duplicate_ratio") > 0.1).alias("near_dedup"),
    )


def split_recent(messages: DataFrame, keep: int = 3, skip_system: bool = False) -> DataFrame:
    """Messages with ``recent``: among the last ``keep`` of their conversation (system ones left out of the count if asked)."""
    part = ["conv_id", (F.col("role") == "system").alias("s")] if skip_system else ["conv_id"]
    place = F.row_number().over(Window.partitionBy(*part).orderBy(F.col("turn").desc()))
    return messages.withColumn("recent", place <= keep)


def last_user_first_system(messages: DataFrame) -> DataFrame:
    user, system = (F.when(F.col("role") == r, F.col("turn")) for r in ("user", "system"))
    return messages.groupBy("conv_id").agg(F.max_by("content", user).alias("last_user"), F.min_by("content", system).alias("first_system"))


# Compounds looked for first, and what no chunk may contain.
COMPOUNDS = ("项目上下文", "上下文", "长内容", "核心代码", "快速排序", "排序函数", "历史背景", "错误信息", "测试用例", "边界条件", "压缩", "总结", "代码")
NO_CHUNK = ("谢谢", "你好", "就是", "大概", "请帮", "请压", "不需要解释")
MOST_KEYWORDS = 12


def _with_cjk(text: str, found: list[str]) -> list[str]:
    """ASCII keywords, then compounds, then chunks of four, three and two characters from the start of each CJK run."""
    out, seen = list(found), {x.lower() for x in found}
    runs = re.findall("[一-鿿]{2,}", text)
    chunks = (r[i : i + n] for r in (run[:24] for run in runs) for n in (4, 3, 2) for i in range(0, max(1, len(r) - n + 1), n))
    usable = (c for c in chunks if len(c) > 1 and c not in signals.STOPWORDS and not any(x in c for x in NO_CHUNK))
    for word in (*(c for c in COMPOUNDS if c in text), *usable):
        if len(out) >= MOST_KEYWORDS:
            break
        if word not in seen:
            seen.add(word)
            out.append(word)
    return out[:MOST_KEYWORDS]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _cjk_keywords(text: pd.Series, found: pd.Series) -> pd.Series:
    return pd.Series([_with_cjk(t, list(f)) for t, f in zip(text, found)])


def latest_keywords(messages: DataFrame, cjk: bool = True) -> DataFrame:
    """Keywords of each conversation's last user message, twelve at most; Python only sees texts with CJK."""
    last = last_user_first_system(messages).select("conv_id", F.col("last_user").alias("t"))
    last = last.withColumn("keywords", F.coalesce(signals.ascii_keywords(F.col("t")), F.array().cast("array<string>")))
    if not cjk:
        return last.drop("t")
    has = F.coalesce(F.col("t").rlike("[一-鿿]{2}"), F.lit(False))
    more = last.where(has).select("conv_id", _cjk_keywords("t", "keywords").alias("keywords"))
    return last.where(~has).drop("t").unionByName(more)


def may_instruct(role: Column, text: Column) -> Column:
    """Whether a message can have an instruction: one of the user's, with two CJK characters (their key keeps runs of two)."""
    return (role == "user") & text.rlike("[一-鿿][^一-鿿]*+[一-鿿]")


def repeated_instructions(messages: DataFrame, percent: int = 60) -> DataFrame:
    """User messages whose instruction a later one of the conversation repeats: equal, contained, or alike by bigrams.

    Alike: the bigrams in common are more than ``percent`` hundredths of all. Equal instructions are compared once. Of two
    that are alike or contained, the shorter one's rarest bigrams in the conversation meet the other's in an equi-join: a
    set that shares so many must share one of its first few.
    """
    k = messages.where(may_instruct(F.col("role"), F.col("content"))).select("conv_id", "turn", F.explode(F.array(rules.instruction_key(F.col("content")))).alias("key")).where("key <> ''")
    # only a conversation with two instructions can repeat one; this is also the one shuffle that all steps below read
    k = k.withColumn("_n", F.count("*").over(Window.partitionBy("conv_id"))).where("_n > 1").select("conv_id", "turn", "key")
    last = k.groupBy("conv_id", "key").agg(F.max("turn").alias("last"))
    # instructions have two characters at least, so each has a bigram
    grams = last.select("conv_id", "key", F.explode(char_ngrams(F.col("key"), 2)).alias("gram"))
    often = grams.groupBy("conv_id", "gram").agg(F.count("*").alias("n"))
    ranked = grams.join(often, ["conv_id", "gram"]).groupBy("conv_id", "key").agg(F.array_sort(F.collect_list(F.struct("n", "gram"))).alias("g"))
    few = F.expr(f"slice(g, 1, size(g) - (size(g) * {percent} + 99) div 100 + 1)")
    heads = ranked.select("conv_id", F.col("key").alias("short"), F.explode(F.transform(few, lambda x: x["gram"])).alias("gram"))
    pairs = heads.join(grams, ["conv_id", "gram"]).where("short <> key").select("conv_id", "short", "key").distinct()
    a, b = (char_ngrams(F.col(c), 2) for c in ("short", "key"))
    both = F.size(F.array_intersect(a, b))
    pairs = pairs.where(F.contains("key", "short") | (100 * both > percent * (F.size(a) + F.size(b) - both)))
    sides = pairs.union(pairs.select("conv_id", "key", "short")).join(last, ["conv_id", "key"]).select("conv_id", F.col("short").alias("key"), "last")
    latest = last.union(sides).groupBy("conv_id", "key").agg(F.max("last").alias("last"))
    return k.join(latest, ["conv_id", "key"]).where("turn < last").select("conv_id", "turn", "key")


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)[\w一-鿿]+"), F.lit(0)))


def is_echo(role: Column, text: Column, system: Column, threshold: float = 0.8) -> Column:
    """Whether a short user or assistant text only repeats the words of a system text; never null."""
    return F.coalesce(role.isin("user", "assistant") & (F.length(text) < 200) & (jaccard(_words(system), _words(text)) > threshold), F.lit(False))


def without_echoes(messages: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Messages without short user and assistant ones that only repeat the words of the conversation's first system text."""
    system = last_user_first_system(messages).select("conv_id", F.col("first_system").alias("_s"))
    return beside(messages, system, how="left").where(~is_echo(F.col("role"), F.col("content"), F.col("_s"), threshold)).drop("_s")


def code_runs(lines: DataFrame) -> DataFrame:
    """Adjacent code lines of (id, pos, line) merged into one chunk with double density; other lines one by one."""
    w = Window.partitionBy("id").orderBy("pos")
    x = lines.withColumn("code", signals.looks_like_code(F.col("line")))
    start = F.when(F.col("code") & F.coalesce(F.lag("code").over(w), F.lit(False)), 0).otherwise(1)
    x = x.withColumn("_start", start).withColumn("run", F.sum("_start").over(w))
    g = x.groupBy("id", "run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda s: s["line"]), "\n").alias("chunk"), F.any_value("code").alias("code"))
    return g.select("id", "run", "chunk", "code", (signals.density_score(F.col("chunk")) * F.when(F.col("code"), 2.0).otherwise(1.0)).alias("score"))


def code_blocks(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Share of code lines of each text, and whether it is more than 0.4."""
    lines = texts.select(key, F.explode(F.split(text, "\n")).alias("line"))
    return lines.groupBy(key).agg(F.count("*").alias("lines"), F.count_if(signals.looks_like_code(F.col("line"))).alias("code_lines")).select(key, "lines", "code_lines", (F.col("code_lines") / F.col("lines") > 0.4).alias("is_code"))


def valid_reductions(original: DataFrame, reduced: DataFrame) -> DataFrame:
    """Per conversation whether a reduced one may be used: not longer, system kept, with a user message."""

    def facts(m: DataFrame, p: str) -> DataFrame:
        t = 4 + tokens.multilingual(F.coalesce("role", F.lit(""))) + tokens.multilingual(F.coalesce("content", F.lit("")))
        return m.groupBy("conv_id").agg(F.sum(t).alias(f"{p}_tokens"), F.bool_or(F.col("role") == "system").alias(f"{p}_system"), F.bool_or(F.col("role") == "user").alias(f"{p}_user"))

    x = beside(facts(original, "o"), facts(reduced, "r"), how="left")
    ok = (F.col("r_tokens") <= F.col("o_tokens")) & (~F.col("o_system") | F.col("r_system")) & F.col("r_user")
    return x.select("conv_id", F.col("o_tokens").alias("tokens_before"), F.col("r_tokens").alias("tokens_after"), F.coalesce(ok, F.lit(False)).alias("valid"))


def segments(messages: DataFrame) -> DataFrame:
    """Classified segments of each message, from one expression a message."""
    out = messages.select("conv_id", "turn", "role", F.inline(rules.segments(F.col("content"))))
    kind = F.when(F.col("reason").isin(rules.NOISE), "noise").otherwise("signal")
    return out.withColumns({"kind": kind, "confidence": rules.confidence(F.col("reason")), "tokens": tokens.len3(F.col("text"))})
