"""Lookups of models: routes, profiles, prices, context windows. Dimension sides have a dozen rows and are broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tokens
from ..plans import dims


def _all_of(name: Column, *parts: str) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | name.contains(p)
    return out


def find_route(models: DataFrame, model: str = "model") -> DataFrame:
    """The first route, in the table's order, whose pattern the model's name contains; null columns without one.

    The join runs on distinct names, so its work follows the number of models, not of rows.
    """
    routes = F.broadcast(dims.table(models.sparkSession, dims.ROUTES_SQL))
    names = models.select(model).distinct()
    hit = names.join(routes, F.contains(F.lower(F.trim(F.col(model))), F.col("pattern")), "left")
    cols = ["pattern", "main_in", "main_out", "cheap", "cheap_in", "cheap_out", "max_context"]
    first = hit.groupBy(model).agg(F.min_by(F.struct(*cols), "pos").alias("r")).select(model, "r.*")
    return models.join(first, model, "left")


def find_profile(models: DataFrame, model: str = "model", strict: bool = False) -> DataFrame:
    """Profile by name, else by alias, else the first one whose name contains the model's or is contained in it.

    Without any: null columns, or an error if ``strict``.
    """
    spark = models.sparkSession
    profiles = F.broadcast(dims.table(spark, dims.PROFILES_SQL).withColumnsRenamed({"name": "profile"}))
    aliases = F.broadcast(dims.table(spark, dims.ALIASES_SQL).withColumnsRenamed({"name": "aliased"}))
    key = F.replace(F.lower(F.trim(F.col(model))), F.lit(" "), F.lit("-"))
    names = models.select(model).distinct().withColumn("key", key).join(aliases, F.col("key") == F.col("alias"), "left")
    exact = F.col("key") == F.col("profile")
    by_alias = F.col("aliased") == F.col("profile")
    part = F.contains(F.col("key"), F.col("profile")) | F.contains(F.col("profile"), F.col("key"))
    rank = F.when(exact, 0).when(by_alias, 1).otherwise(2)
    cols = ["profile", "price_in", "price_out", "price_cache", "price_write"]
    hit = names.join(profiles, exact | by_alias | part, "left")
    first = hit.groupBy(model).agg(F.min_by(F.struct(*cols), F.struct(rank, "pos")).alias("r")).select(model, "r.*")
    if strict:
        first = first.withColumn("profile", F.when(F.col("profile").isNull(), F.raise_error(F.concat(F.lit("Unknown model "), F.col(model)))).otherwise(F.col("profile")))
    return models.join(first, model, "left")


def looks_cheap(name: Column) -> Column:
    return _all_of(F.lower(name), *dims.CHEAP)


def infer_provider(base_url: Column, model: Column) -> Column:
    text = F.lower(F.concat_ws(" ", base_url, model))
    low = F.lower(model)
    out = F.when(low.rlike("^(?:gpt-|o1|o3|o4)"), "openai").when(low.startswith("claude-"), "anthropic").otherwise("unknown")
    for p, name in reversed(dims.PROVIDERS):
        out = F.when(text.contains(p), name).otherwise(out)
    return out


def compatible(provider: Column, main: Column, candidate: Column) -> Column:
    return (provider == "unknown") | F.contains(F.lower(candidate), provider) | F.contains(F.lower(main), provider) | provider.isin("openai", "anthropic")


def price_hint(models: DataFrame, model: str = "model") -> DataFrame:
    """Known prices, else a guess for cheap-looking names, else one for main models."""
    hints = F.broadcast(dims.table(models.sparkSession, dims.HINTS_SQL).withColumnsRenamed({"id": "_id", "price_in": "_in", "price_out": "_out", "max_context": "_context"}))
    out = models.join(hints, F.lower(F.col(model)) == F.col("_id"), "left")
    cheap = looks_cheap(F.col(model))
    return out.select(
        *models.columns,
        F.col("_id").isNotNull().alias("known"),
        F.coalesce("_in", F.when(cheap, 0.20).otherwise(1.00)).alias("hint_in"),
        F.coalesce("_out", F.when(cheap, 0.60).otherwise(3.00)).alias("hint_out"),
        F.coalesce("_context", F.lit(128_000)).cast("long").alias("hint_context"),
    )


def model_tier(models: DataFrame, model: str = "model") -> DataFrame:
    """Input price and tier (1 cheap to 3 dear): known prices, else by the name."""
    prices = F.broadcast(dims.table(models.sparkSession, dims.PLUGIN_PRICES_SQL))
    low = F.lower(F.col(model))
    cheap, mid = _all_of(low, "free", "flash", "lite", "mini", "nano", "tiny"), _all_of(low, "turbo", "fast", "rapid")
    dear = _all_of(low, "pro", "max", "ultra", "opus", "sonnet", "o1", "o3")
    out = models.join(prices, F.col(model) == F.col("id"), "left")
    known = F.when(F.col("price_in") <= 0.30, 1).when(F.col("price_in") <= 1.0, 2).otherwise(3)
    return out.select(
        *models.columns,
        F.coalesce("price_in", F.when(cheap, 0.10).when(mid, 0.40).when(dear, 1.00).otherwise(0.14)).alias("tier_price"),
        F.when(F.col("price_in").isNotNull(), known).otherwise(F.when(cheap, 1).when(mid, 2).when(dear, 3).otherwise(1)).cast("int").alias("tier"),
    )


def context_tier(models: DataFrame, model: str = "model") -> DataFrame:
    """Context window, label and keep ratio of a target model."""
    contexts = F.broadcast(dims.table(models.sparkSession, dims.CONTEXTS_SQL).withColumnRenamed("context", "known_context"))
    low = F.lower(F.col(model))
    guess = F.when(_all_of(low, "claude", "gpt-5", "gpt-4o", "qwen-plus"), 128000).when(_all_of(low, "deepseek", "qwen"), 65536).otherwise(32768)
    out = models.join(contexts, low == F.col("id"), "left").withColumn("context", F.coalesce("known_context", guess).cast("long"))
    big, mid = F.col("context") >= 128000, F.col("context") >= 64000
    return out.select(*models.columns, "context", F.when(big, "large").when(mid, "mid").otherwise("small").alias("context_label"), F.when(big, 0.60).when(mid, 0.40).otherwise(0.30).alias("context_ratio"))


def text_models(models: DataFrame, model: str = "model") -> DataFrame:
    """Models that produce text."""
    return models.where(~F.lower(F.col(model)).rlike("tts|asr|stt|voice|audio|speech|embedding|rerank|image|vision|whisper|dall-e"))


def _name_words(name: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(name), F.lit(r"[a-z]+|\d+(?:\.\d+)?"), F.lit(0)))


def _own_score() -> Column:
    """The part of a candidate's score that doesn't depend on the main model: known prices, a large context, the price."""
    return F.when(F.col("known"), 3.0).otherwise(0.0) + F.when(F.col("hint_context") >= 128_000, 1.0).otherwise(0.0) - F.col("hint_in")


def candidate_pairs(mains: DataFrame, listed: DataFrame, limit: int = 5) -> DataFrame:
    """(main, provider, model, pos) pairs of ``mains`` (main, provider) with ``listed`` models (model, pos) that can be among the best ``limit``.

    No cross join: a pair either shares a word of its names, or the candidate is among the best of a provider's by its own
    score (one more than ``limit``, as a model is no candidate of itself). A dozen providers make that second list short.
    """
    cheap = price_hint(listed.where(looks_cheap(F.col("model"))))
    shared = mains.withColumn("_w", F.explode(_name_words(F.col("main")))).join(cheap.select("model", "pos", F.explode(_name_words(F.col("model"))).alias("_w")), "_w")
    names = sorted({name for _, name in dims.PROVIDERS})
    of = F.concat(F.array(F.lit("")), F.array_compact(F.array(*(F.when(F.contains(F.lower("model"), F.lit(n)), F.lit(n)) for n in names))))
    place = F.row_number().over(Window.partitionBy("_class").orderBy(F.col("_score").desc(), "pos"))
    best = cheap.select("model", "pos", _own_score().alias("_score"), F.explode(of).alias("_class")).withColumn("_place", place).where(F.col("_place") <= limit + 1)
    anyone = F.col("provider").isin("unknown", "openai", "anthropic") | F.contains(F.lower("main"), F.col("provider"))
    others = mains.withColumn("_class", F.when(anyone, "").otherwise(F.col("provider"))).join(best, "_class")
    return shared.select("main", "provider", "model", "pos").union(others.select("main", "provider", "model", "pos")).distinct()


def rank_candidates(candidates: DataFrame, limit: int = 5) -> DataFrame:
    """Cheap candidates of each main model (main, provider, model, pos), best first, ``limit`` at most.

    The score is the number of shared name tokens, 3 for known prices, 1 for a large context, less the input price.
    """
    rows = candidates.where(F.lower("model") != F.lower("main")).where(looks_cheap(F.col("model"))).where(compatible(F.col("provider"), F.col("main"), F.col("model")))
    rows = price_hint(rows)
    shared = F.size(F.array_intersect(_name_words(F.col("main")), _name_words(F.col("model"))))
    place = F.row_number().over(Window.partitionBy("main").orderBy(F.col("score").desc(), "pos"))
    return rows.withColumn("score", shared + _own_score()).withColumn("place", place.cast("int")).where(F.col("place") <= limit).select("main", "model", "score", "place", "hint_in", "hint_out", "hint_context")


def route_from_probe(mains: DataFrame, listed: DataFrame) -> DataFrame:
    """Per main model (main, base_url) its best candidate among the listed models (model, pos), else its static route's."""
    m = mains.withColumn("provider", infer_provider(F.col("base_url"), F.col("main")))
    best = rank_candidates(candidate_pairs(m.select("main", "provider"), listed)).where("place = 1").select("main", F.col("model").alias("listed"), F.col("hint_in").alias("listed_in"), F.col("hint_out").alias("listed_out"))
    out = price_hint(find_route(m.join(best, "main", "left"), "main"), "main")
    chosen = F.coalesce("listed", "cheap")
    return out.select(
        "main", "provider", chosen.alias("candidate"), chosen.isNotNull().alias("available"),
        F.when(F.col("listed").isNotNull(), "models_inventory").when(F.col("cheap").isNotNull(), "static_route").alias("source"),
        F.coalesce("main_in", "hint_in").alias("main_price_in"), F.coalesce("listed_in", "cheap_in").alias("candidate_price_in"),
    )


def select_candidate(rows: DataFrame, margin: float = 0.05) -> DataFrame:
    """The candidate with the largest savings of each request, the earlier on ties, among those that fit and pay.

    Takes id, rule_tokens, ratio (of the policy), pos, cheap, cheap_in, cheap_out, max_context, main_in, main_out and
    optionally avg_ratio (learned), protected and blocked.
    """
    for name, default in (("avg_ratio", F.lit(None).cast("double")), ("protected", F.lit(False)), ("blocked", F.lit(False))):
        if name not in rows.columns:
            rows = rows.withColumn(name, default)
    # (least and greatest skip nulls)
    learned = F.when(F.col("avg_ratio").isNotNull(), F.least(F.lit(0.95), F.greatest(F.lit(0.05), F.col("avg_ratio") * 1.10)))
    ratio = F.when(learned.isNull(), F.col("ratio")).when(F.col("protected"), F.greatest("ratio", learned)).otherwise(F.least("ratio", learned))
    rows = rows.withColumn("smart_tokens", F.greatest(F.lit(1), F.floor(F.col("rule_tokens") * ratio)).cast("long"))
    rows = rows.withColumns(tokens.route_profit(*(F.col(c) for c in ("rule_tokens", "smart_tokens", "main_in", "main_out", "cheap_in", "cheap_out"))))
    fit = rows.where(~F.col("blocked") & (F.col("rule_tokens") <= F.col("max_context")) & F.col("profitable") & (F.col("savings_pct") >= margin * 100))
    # an aggregate picks the best row without a sort of each request's candidates
    best = fit.groupBy("id").agg(F.max_by(F.struct("cheap", "smart_tokens", "savings", "savings_pct"), F.struct("savings", -F.col("pos"))).alias("r"))
    return best.select("id", F.col("r.cheap").alias("candidate"), "r.smart_tokens", "r.savings", "r.savings_pct")


def tier_race(outcomes: DataFrame, batch: int = 4) -> DataFrame:
    """Winner of a race in tiers: by tier and price in batches, the fastest success of the first batch that has one.

    Takes id, model, tier, price, latency, ok.
    """
    place = F.row_number().over(Window.partitionBy("id", "tier").orderBy("price", "model")) - 1
    rows = outcomes.withColumn("batch", F.floor(place / batch).cast("int")).where("ok")
    return rows.groupBy("id").agg(F.min_by(F.struct("model", "tier", "batch"), F.struct("tier", "batch", "latency", "model")).alias("r")).select("id", "r.*")
