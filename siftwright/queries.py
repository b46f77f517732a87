"""The registered queries of everything but the training-data operators, and the SQL that states the same result.

The SQL is for another engine and is written by hand from the rules, not generated from the Spark plans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import rules, signals, tokens
from .operators import cases, costs, dedup, groups, jsonx, lookups, pack, prompts, recall
from .plans import dims, pipelines
from .sources import tables
from .sources.request_log import RequestLog
from .sources.scratch import new_path
from .sources.tables import CALLS, CHAT, CJK, TOOL, calls, chat, cjk, load, messages, tool
from .streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


_CHAT = f"WITH chat AS ({CHAT}) "
_TOOL = f"WITH tool AS ({TOOL}) "
_CALLS = f"WITH calls AS ({CALLS}) "
_MULTI = (
    "CASE WHEN length(X) = 0 THEN 0 ELSE greatest(1, floor(length(regexp_replace(X, '[^\\x00-\\x7F]', '', 'g')) / 4.0"
    " + length(regexp_replace(X, '[^\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}]', '', 'g')) / 1.7"
    " + length(regexp_replace(X, '[\\x00-\\x7F\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}]', '', 'g')) / 2.5))::BIGINT END"
)
_PLUGIN_REST = "regexp_replace(X, '[\\x{4E00}-\\x{9FFF}\\x{3000}-\\x{303F}\\x{FF00}-\\x{FFEF}]', '', 'g')"
_PLUGIN = (
    f"CASE WHEN length(X) = 0 THEN 0 ELSE floor(((length(X) - length({_PLUGIN_REST})) * 1.8::DOUBLE + len(regexp_extract_all({_PLUGIN_REST}, '[^\\s\\x{{A0}}]+')) * 1.3::DOUBLE)"
    f" * (1.0::DOUBLE + least((length({_PLUGIN_REST}) - length(translate({_PLUGIN_REST}, '{{`', ''))) * 0.05::DOUBLE, 0.4::DOUBLE)))::BIGINT END"
)


def _of(expr: str, x: str) -> str:
    return expr.replace("X", x)


# --- token and cost scalars -------------------------------------------------------------------------------------


@query("SELECT doc_id, greatest(1, length(text) // 3)::BIGINT AS tokens FROM documents")
def tok_len3(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", tokens.len3(F.col("text")).alias("tokens"))


@query(f"WITH m AS (SELECT doc_id AS id, text AS x FROM documents UNION ALL SELECT -turn - 1, content FROM ({CJK})) SELECT id, {_of(_MULTI, 'x')} AS tokens FROM m")
def tok_multilingual(spark: SparkSession, sf: str) -> DataFrame:
    both = load(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("x")).union(cjk(spark, sf).select(-F.col("turn") - 1, "content"))
    return both.select("id", tokens.multilingual(F.col("x")).alias("tokens"))


@query("SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, round_even(length(text) / 4.0, 0)) END::BIGINT AS tokens FROM documents")
def tok_api(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", tokens.api(F.col("text")).alias("tokens"))


@query("SELECT conv_id, turn, (length(text) // 4)::BIGINT AS tokens FROM conversations")
def tok_profile(spark: SparkSession, sf: str) -> DataFrame:
    return messages(spark, sf).select("conv_id", "turn", tokens.profile(F.col("content")).alias("tokens"))


@query(f"WITH m AS (SELECT event_id AS id, content AS x FROM ({TOOL}) UNION ALL SELECT -turn - 1, content FROM ({CJK})) SELECT id, {_of(_PLUGIN, 'x')} AS tokens FROM m")
def tok_plugin(spark: SparkSession, sf: str) -> DataFrame:
    both = tool(spark, sf).select(F.col("event_id").alias("id"), F.col("content").alias("x")).union(cjk(spark, sf).select(-F.col("turn") - 1, "content"))
    return both.select("id", tokens.plugin(F.col("x")).alias("tokens"))


@query(
    _CHAT + f"SELECT conv_id, sum(4 + {_of(_MULTI, 'role')} + {_of(_MULTI, 'content')})::BIGINT AS tokens,"
    f" sum(4 + {_of(_PLUGIN, 'content')})::BIGINT AS plugin_tokens, count(*) AS messages FROM chat GROUP BY conv_id"
)
def conv_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return groups.conv_tokens(chat(spark, sf))


@query(f"SELECT event_id, (4 + {_of(_PLUGIN, 'props')} + {_of(_PLUGIN, 'event_type')})::BIGINT AS tokens FROM events")
def block_tokens(spark: SparkSession, sf: str) -> DataFrame:
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.cast("string").alias("text"))
    blocks = F.array(part("text", F.col("props")), part("image", F.lit(None)), part("text", F.col("event_type")), part("text", F.lit("")))
    return load(spark, sf, "events").select("event_id", groups.block_tokens(blocks).alias("tokens"))


@query(
    "WITH d AS (SELECT doc_id, greatest(1, round_even(length(text) / 4.0, 0)) AS t,"
    " CASE doc_id % 3 WHEN 0 THEN 'safe' WHEN 1 THEN 'balanced' ELSE 'aggressive' END AS mode FROM documents WHERE length(text) > 0)"
    " SELECT doc_id, mode, least(CASE mode WHEN 'safe' THEN 0.95 WHEN 'balanced' THEN 0.75 ELSE 0.5 END::DOUBLE, least(1.0::DOUBLE, greatest(0.05::DOUBLE, 200 / t))) AS keep_ratio,"
    " concat_ws('|', CASE WHEN mode = 'aggressive' THEN 'aggressive mode used with high-risk preservation requirements' END, CASE WHEN mode <> 'safe' THEN 'safe mode is recommended when preserving critical facts' END) AS warnings FROM d"
)
def keep_ratio_budget(spark: SparkSession, sf: str) -> DataFrame:
    d = load(spark, sf, "documents").where("length(text) > 0")
    mode = F.when(F.col("doc_id") % 3 == 0, "safe").when(F.col("doc_id") % 3 == 1, "balanced").otherwise("aggressive")
    warn = tokens.risk_warnings(F.col("mode"), F.lit("dialog"), F.array(F.lit("Numbers")))
    return d.select("doc_id", mode.alias("mode"), tokens.api(F.col("text")).alias("t")).select("doc_id", "mode", tokens.keep_ratio(F.col("mode"), F.lit(200), F.col("t")).alias("keep_ratio"), F.array_join(warn, "|").alias("warnings"))


@query(
    _CALLS + f", d AS ({dims.ROUTES_SQL}), m AS (SELECT DISTINCT event_id, input_tokens, output_tokens FROM calls)"
    " SELECT event_id, pattern, round((input_tokens / 1000000 * main_in + output_tokens / 1000000 * main_out) * 1e9)::BIGINT AS nano_cost FROM m CROSS JOIN d"
)
def call_cost(spark: SparkSession, sf: str) -> DataFrame:
    d = F.broadcast(dims.table(spark, dims.ROUTES_SQL))
    cost = tokens.call_cost(*(F.col(c) for c in ("input_tokens", "output_tokens", "main_in", "main_out")))
    return calls(spark, sf).join(d).select("event_id", "pattern", F.round(cost * 1e9).cast("long").alias("nano_cost"))


@query(
    "SELECT event_id, (user_id + 100 + event_id % 50 + 7)::BIGINT AS input_tokens, floor((event_id % 1000) * 0.3::DOUBLE)::BIGINT AS reasoning_tokens,"
    " (event_id % 1000 - floor((event_id % 1000) * 0.3::DOUBLE))::BIGINT AS actual_output_tokens FROM events"
)
def token_split(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events")
    i = F.col("event_id")
    return e.select("event_id", *(c.cast("long").alias(k) for k, c in tokens.token_split(F.lit(100), F.lit(7), i % 50, F.col("user_id"), i % 1000).items()))


@query(
    """SELECT event_id, (event_id % 500)::BIGINT AS prompt_tokens, CASE WHEN event_id % 4 = 0 THEN 0 ELSE event_id % 90 END::BIGINT AS completion_tokens,
    CASE WHEN event_id % 3 = 0 AND event_id % 40 > 0 THEN event_id % 40 END::BIGINT AS reasoning_tokens FROM events"""
)
def reply_usage(spark: SparkSession, sf: str) -> DataFrame:
    reply = F.expr(
        """concat('{"usage":{"prompt_tokens":', event_id % 500, CASE WHEN event_id % 4 = 0 THEN '' ELSE concat(',"completion_tokens":', event_id % 90) END,
        CASE WHEN event_id % 3 = 0 THEN concat(',"completion_tokens_details":{"reasoning_tokens":', event_id % 40, '}') ELSE '' END, '}}')"""
    )
    return costs.reply_usage(load(spark, sf, "events").select("event_id", reply.alias("reply"))).drop("reply")


# --- lookups ----------------------------------------------------------------------------------------------------

_NAMES = "SELECT event_id, concat(CASE event_id % 8 WHEN 0 THEN 'mimo-v2.5-pro' WHEN 1 THEN 'MiMo-V2.5' WHEN 2 THEN 'org/gpt-4o-mini' WHEN 3 THEN 'claude-3-opus' WHEN 4 THEN 'deepseek-v4-flash' WHEN 5 THEN 'qwen-plus' WHEN 6 THEN 'llama-small' ELSE 'o3-max' END, CASE WHEN event_id % 5 = 0 THEN '-latest' ELSE '' END) AS model FROM events"


def _names(spark: SparkSession, sf: str) -> DataFrame:
    load(spark, sf, "events").createOrReplaceTempView("siftwright_names_events")
    return spark.sql(_NAMES.replace("FROM events", "FROM siftwright_names_events"))


@query(
    f"WITH m AS ({_NAMES}), d AS ({dims.ROUTES_SQL}), x AS (SELECT model, arg_min(pattern, pos) AS pattern, arg_min(cheap, pos) AS cheap FROM (SELECT DISTINCT model FROM m) JOIN d ON contains(lower(trim(model)), pattern) GROUP BY model)"
    " SELECT event_id, model, pattern, cheap FROM m LEFT JOIN x USING (model)"
)
def route_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return lookups.find_route(_names(spark, sf)).select("event_id", "model", "pattern", "cheap")


@query(
    f"WITH m AS (SELECT DISTINCT model FROM ({CALLS}) UNION SELECT DISTINCT model FROM ({_NAMES})), k AS (SELECT model, replace(lower(trim(model)), ' ', '-') AS key FROM m),"
    f" p AS ({dims.PROFILES_SQL}), a AS ({dims.ALIASES_SQL}),"
    " x AS (SELECT model, p.name, CASE WHEN key = p.name THEN 0 WHEN a.name = p.name THEN 1 ELSE 2 END AS r, pos FROM k LEFT JOIN a ON key = alias JOIN p ON key = p.name OR a.name = p.name OR contains(key, p.name) OR contains(p.name, key))"
    " SELECT model, x.name AS profile FROM m LEFT JOIN (SELECT model, arg_min(name, r * 100 + pos) AS name FROM x GROUP BY model) x USING (model)"
)
def profile_lookup(spark: SparkSession, sf: str) -> DataFrame:
    m = calls(spark, sf).select("model").union(_names(spark, sf).select("model")).distinct()
    return lookups.find_profile(m).select("model", "profile")


_CHEAP = "regexp_matches(lower(model), 'flash|mini|turbo|lite|haiku|small|compress')"


@query(
    f"WITH m AS (SELECT DISTINCT model FROM ({_NAMES})), h AS ({dims.HINTS_SQL}) SELECT model, id IS NOT NULL AS known, coalesce(price_in, CASE WHEN {_CHEAP} THEN 0.20 ELSE 1.00 END) AS hint_in,"
    f" coalesce(price_out, CASE WHEN {_CHEAP} THEN 0.60 ELSE 3.00 END) AS hint_out, coalesce(max_context, 128000)::BIGINT AS hint_context FROM m LEFT JOIN h ON lower(model) = id"
)
def price_hint(spark: SparkSession, sf: str) -> DataFrame:
    return lookups.price_hint(_names(spark, sf).select("model").distinct())


@query(
    f"WITH m AS (SELECT DISTINCT model FROM ({_NAMES})), h AS ({dims.PLUGIN_PRICES_SQL}), n AS (SELECT model, price_in, CASE WHEN regexp_matches(lower(model), 'free|flash|lite|mini|nano|tiny') THEN 1 WHEN regexp_matches(lower(model), 'turbo|fast|rapid') THEN 2"
    " WHEN regexp_matches(lower(model), 'pro|max|ultra|opus|sonnet|o1|o3') THEN 3 ELSE 4 END AS g FROM m LEFT JOIN h ON model = id)"
    " SELECT model, coalesce(price_in, [0.10, 0.40, 1.00, 0.14][g])::DOUBLE AS tier_price, CASE WHEN price_in IS NULL THEN [1, 2, 3, 1][g] WHEN price_in <= 0.3 THEN 1 WHEN price_in <= 1 THEN 2 ELSE 3 END::INTEGER AS tier FROM n"
)
def model_tier(spark: SparkSession, sf: str) -> DataFrame:
    return lookups.model_tier(_names(spark, sf).select("model").distinct())


@query(
    f"WITH m AS (SELECT DISTINCT model FROM ({_NAMES})), h AS ({dims.CONTEXTS_SQL}), n AS (SELECT model, coalesce(context, CASE WHEN regexp_matches(lower(model), 'claude|gpt-5|gpt-4o|qwen-plus') THEN 128000 WHEN regexp_matches(lower(model), 'deepseek|qwen') THEN 65536 ELSE 32768 END)::BIGINT AS context FROM m LEFT JOIN h ON lower(model) = id)"
    " SELECT model, context, CASE WHEN context >= 128000 THEN 'large' WHEN context >= 64000 THEN 'mid' ELSE 'small' END AS context_label, CASE WHEN context >= 128000 THEN 0.6 WHEN context >= 64000 THEN 0.4 ELSE 0.3 END::DOUBLE AS context_ratio FROM n"
)
def context_tier(spark: SparkSession, sf: str) -> DataFrame:
    return lookups.context_tier(_names(spark, sf).select("model").distinct())


@query(
    f"WITH m AS (SELECT DISTINCT model FROM ({_NAMES})), n AS (SELECT model, CASE WHEN contains(lower(model), 'mimo') THEN 'mimo' WHEN contains(lower(model), 'deepseek') THEN 'deepseek' WHEN contains(lower(model), 'qwen') THEN 'qwen'"
    " WHEN regexp_matches(lower(model), '^(gpt-|o1|o3|o4)') THEN 'openai' WHEN starts_with(lower(model), 'claude-') THEN 'anthropic' ELSE 'unknown' END AS provider FROM m)"
    f" SELECT model, provider, {_CHEAP} AS cheap, NOT regexp_matches(lower(model), 'tts|embedding') AS text_model FROM n"
)
def provider_models(spark: SparkSession, sf: str) -> DataFrame:
    m = _names(spark, sf).select("model").distinct()
    kept = lookups.text_models(m).select("model", F.lit(True).alias("text_model"))
    m = m.join(kept, "model", "left").withColumn("text_model", F.coalesce("text_model", F.lit(False)))
    return m.select("model", lookups.infer_provider(F.lit(""), F.col("model")).alias("provider"), lookups.looks_cheap(F.col("model")).alias("cheap"), "text_model")


@query("SELECT event_id, concat('m-', event_id) AS model FROM events WHERE event_id % 4 <> 3 UNION ALL SELECT event_id, 'plain' FROM events WHERE event_id % 4 < 2")
def inventory(spark: SparkSession, sf: str) -> DataFrame:
    payload = F.expr(
        """CASE event_id % 4 WHEN 0 THEN concat('{"data":[{"id":" m-', event_id, ' "},"plain",{"id":""}]}') WHEN 1 THEN concat('["plain",{"name":"m-', event_id, '"}]')
        WHEN 2 THEN concat('[{"model":"m-', event_id, '"}, 7]') ELSE 'not json' END"""
    )
    return tables.inventory(load(spark, sf, "events").select("event_id", payload.alias("payload"))).select("event_id", "model")


@query(
    "SELECT event_id, CASE WHEN event_id % 4 < 2 THEN list_sort([concat('m-', event_id), 'plain']) WHEN event_id % 4 = 2 THEN [concat('m-', event_id)] ELSE [] END AS models, CASE event_id % 4 WHEN 3 THEN 'probe_failure' ELSE 'models_inventory' END AS source,"
    " CASE WHEN event_id % 8 = 3 THEN '/models listed no model' WHEN event_id % 4 = 3 THEN concat('/models probe failed: timeout ', event_id) END AS failure_reason FROM events"
)
def probe_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    payload = F.expr(
        """CASE event_id % 8 WHEN 0 THEN concat('{"data":[{"id":" m-', event_id, ' "},"plain",{"id":""}]}') WHEN 4 THEN concat('["m-', event_id, '","plain"]') WHEN 1 THEN concat('["plain",{"name":"m-', event_id, '"}]')
        WHEN 5 THEN concat('["plain",{"name":"m-', event_id, '"}]') WHEN 2 THEN concat('[{"model":"m-', event_id, '"}, 7]') WHEN 6 THEN concat('["m-', event_id, '"]') WHEN 3 THEN 'not json' END"""
    )
    return tables.probe(load(spark, sf, "events").select("event_id", payload.alias("payload"), F.concat(F.lit("timeout "), "event_id").alias("error")))


@query(
    "SELECT DISTINCT user_id AS provider, concat('m', value::BIGINT % 9) AS model FROM events WHERE user_id % 3 = 0 AND event_type <> 'view' UNION SELECT DISTINCT user_id, concat('m', value::BIGINT % 9) FROM events WHERE user_id % 3 = 1 AND event_type <> 'view' AND value::BIGINT % 9 IN (1, 2, 3)"
    " UNION SELECT user_id, unnest(['m1', 'm2', 'm3']) FROM events WHERE user_id % 3 = 2 OR (user_id % 3 = 1 AND user_id NOT IN (SELECT user_id FROM events WHERE event_type <> 'view'))"
)
def provider_config_models(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events")
    p = F.col("user_id")
    providers = e.select(p.alias("provider"), F.when(p % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("m1"), F.lit("m2"), F.lit("m3"))).alias("models")).distinct()
    listed = e.where("event_type <> 'view' AND user_id % 3 <> 2").select(p.alias("provider"), F.concat(F.lit("m"), F.bround("value").cast("long") % 9).alias("model"))
    return tables.configured_models(providers, listed)


def _listed(spark: SparkSession, sf: str) -> DataFrame:
    n = _names(spark, sf).groupBy("model").agg(F.min("event_id").alias("pos"))
    return n


_RANKED = (
    f"WITH l AS (SELECT model, min(event_id) AS pos FROM ({_NAMES}) GROUP BY model), h AS ({dims.HINTS_SQL}),"
    " m AS (SELECT model AS main, list_distinct(regexp_extract_all(lower(model), '[a-z]+|\\d+(?:\\.\\d+)?')) AS w, CASE WHEN contains(lower(model), 'mimo') THEN 'mimo' WHEN contains(lower(model), 'deepseek') THEN 'deepseek' WHEN contains(lower(model), 'qwen') THEN 'qwen'"
    " WHEN regexp_matches(lower(model), '^(gpt-|o1|o3|o4)') THEN 'openai' WHEN starts_with(lower(model), 'claude-') THEN 'anthropic' ELSE 'unknown' END AS provider FROM l),"
    f" c AS (SELECT model, pos, list_distinct(regexp_extract_all(lower(model), '[a-z]+|\\d+(?:\\.\\d+)?')) AS w, id IS NOT NULL AS known, coalesce(price_in, 0.20)::DOUBLE AS hint_in, coalesce(price_out, 0.60)::DOUBLE AS hint_out, coalesce(max_context, 128000)::BIGINT AS hint_context FROM l LEFT JOIN h ON lower(model) = id WHERE {_CHEAP}),"
    " s AS (SELECT main, model, pos, hint_in, hint_out, hint_context, len(list_intersect(m.w, c.w)) + (CASE WHEN known THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN hint_context >= 128000 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END - hint_in) AS score"
    " FROM m, c WHERE lower(main) <> lower(model) AND (provider IN ('unknown', 'openai', 'anthropic') OR contains(lower(model), provider) OR contains(lower(main), provider))),"
    " r AS (SELECT *, row_number() OVER (PARTITION BY main ORDER BY score DESC, pos)::INTEGER AS place FROM s)"
)


@query(_RANKED + " SELECT main, model, score, place, hint_in, hint_out, hint_context FROM r WHERE place <= 5")
def candidate_rank(spark: SparkSession, sf: str) -> DataFrame:
    n = _listed(spark, sf)
    mains = n.select(F.col("model").alias("main"), lookups.infer_provider(F.lit(""), F.col("model")).alias("provider"))
    return lookups.rank_candidates(lookups.candidate_pairs(mains, n))


@query(
    _RANKED + f", d AS ({dims.ROUTES_SQL}), f AS (SELECT main, arg_min(cheap, pos) AS cheap, arg_min(main_in, pos) AS main_in, arg_min(cheap_in, pos) AS cheap_in FROM m JOIN d ON contains(lower(trim(main)), pattern) GROUP BY main)"
    f" SELECT m.main, provider, coalesce(r.model, cheap) AS candidate, coalesce(r.model, cheap) IS NOT NULL AS available, CASE WHEN r.model IS NOT NULL THEN 'models_inventory' WHEN cheap IS NOT NULL THEN 'static_route' END AS source,"
    f" coalesce(main_in, h.price_in, CASE WHEN {_CHEAP.replace('model', 'm.main')} THEN 0.20 ELSE 1.00 END)::DOUBLE AS main_price_in, coalesce(r.hint_in, cheap_in) AS candidate_price_in"
    " FROM m LEFT JOIN r ON m.main = r.main AND place = 1 LEFT JOIN f ON m.main = f.main LEFT JOIN h ON lower(m.main) = h.id"
)
def route_probe(spark: SparkSession, sf: str) -> DataFrame:
    n = _listed(spark, sf)
    return lookups.route_from_probe(n.select(F.col("model").alias("main"), F.lit("").alias("base_url")), n)


# a small grid of learned ratios, so that every branch of the projection is taken
@query(
    _CHAT + f", t AS (SELECT conv_id, sum(greatest(1, length(content) // 3)) AS n FROM chat GROUP BY conv_id), d AS ({dims.ROUTES_SQL}),"
    " r AS (SELECT conv_id, n, CASE WHEN conv_id % 3 = 0 THEN 0.45 WHEN conv_id % 3 = 1 THEN 0.22 ELSE 0.3 END::DOUBLE AS base, conv_id % 3 = 0 AS prot, CASE WHEN conv_id % 2 = 0 THEN (0.2 + (conv_id % 7) * 0.1)::DOUBLE END AS avg, main_in, main_out, cheap, cheap_in, cheap_out, max_context FROM t JOIN d ON pos = conv_id % 11),"
    " l AS (SELECT *, CASE WHEN avg IS NOT NULL THEN least(0.95::DOUBLE, greatest(0.05::DOUBLE, avg * 1.10::DOUBLE)) END AS learned FROM r),"
    " s AS (SELECT *, greatest(1, floor(n * CASE WHEN learned IS NULL THEN base WHEN prot THEN greatest(base, learned) ELSE least(base, learned) END))::BIGINT AS smart_tokens FROM l),"
    " p AS (SELECT *, (n / 1000000 * main_in + floor(n * 0.2::DOUBLE) / 1000000 * main_out) AS rule_cost, n / 1000000 * cheap_in + smart_tokens / 1000000 * cheap_out + smart_tokens / 1000000 * main_in + floor(smart_tokens * 0.2::DOUBLE) / 1000000 * main_out AS smart_cost FROM s)"
    " SELECT conv_id AS id, cheap AS candidate, smart_tokens, round((rule_cost - smart_cost) * 1e9)::BIGINT AS nano_savings FROM p WHERE n <= max_context AND rule_cost > smart_cost AND (rule_cost - smart_cost) / rule_cost * 100 >= 5.0"
)
def candidate_select(spark: SparkSession, sf: str) -> DataFrame:
    t = chat(spark, sf).groupBy(F.col("conv_id").alias("id")).agg(F.sum(tokens.len3(F.col("content"))).alias("rule_tokens"))
    i = F.col("id")
    t = t.withColumns(
        {
            "ratio": F.when(i % 3 == 0, 0.45).when(i % 3 == 1, 0.22).otherwise(0.30),
            "protected": i % 3 == 0,
            "avg_ratio": F.when(i % 2 == 0, F.expr("CAST(0.2 + (id % 7) * 0.1 AS DOUBLE)")),
            "route": i % 11,
        }
    )
    rows = t.join(F.broadcast(dims.table(spark, dims.ROUTES_SQL)), F.col("route") == F.col("pos"))
    return lookups.select_candidate(rows).select("id", "candidate", "smart_tokens", F.round(F.col("savings") * 1e9).cast("long").alias("nano_savings"))


@query(
    "WITH o AS (SELECT user_id AS id, concat('m', event_id % 7) AS model, event_id % 3 AS tier, value AS price, event_id AS latency, event_type <> 'error' AS ok FROM events),"
    " b AS (SELECT *, (row_number() OVER (PARTITION BY id, tier ORDER BY price, model) - 1) // 4 AS batch FROM o),"
    " w AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tier, batch, latency, model) AS r FROM b WHERE ok) SELECT id, model, tier, batch::INTEGER AS batch FROM w WHERE r = 1"
)
def tier_race(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events")
    o = e.select(F.col("user_id").alias("id"), F.concat(F.lit("m"), F.col("event_id") % 7).alias("model"), (F.col("event_id") % 3).alias("tier"), F.col("value").alias("price"), F.col("event_id").alias("latency"), (F.col("event_type") != "error").alias("ok"))
    return lookups.tier_race(o)


# --- request log ------------------------------------------------------------------------------------------------

_COSTS = (
    _CALLS + f", p AS ({dims.PROFILES_SQL}), c AS (SELECT calls.*, name AS profile, input_tokens / 1000000 * price_in AS raw,"
    " (input_tokens - cached_tokens) / 1000000 * price_in + cached_tokens / 1000000 * price_cache AS actual, output_tokens / 1000000 * price_out AS out"
    " FROM calls JOIN p ON name = CASE model WHEN 'deepseek-pro' THEN 'deepseek-v4-pro' WHEN 'MiMo Flash' THEN 'mimo-v2-flash' WHEN 'mimo' THEN 'mimo-v2.5' ELSE model END)"
)


@query(_COSTS + " SELECT event_id, profile, round((actual + out) * 1e9)::BIGINT AS nano_total, round((raw - actual) * 1e9)::BIGINT AS nano_savings, cached_tokens > 0 AS cache_hit FROM c")
def request_cost(spark: SparkSession, sf: str) -> DataFrame:
    c = costs.request_costs(calls(spark, sf))
    return c.select("event_id", "profile", F.round(F.col("total_cost") * 1e9).cast("long").alias("nano_total"), F.round(F.col("savings") * 1e9).cast("long").alias("nano_savings"), "cache_hit")


@query(
    _CALLS + f", p AS ({dims.PROFILES_SQL}) SELECT prefix, name, round(n / 1000000 * price_in * 1e9)::BIGINT AS raw_nano, round(n / 1000000 * price_cache * 1e9)::BIGINT AS cached_nano, round((1 - price_cache / price_in) * 100, 1) AS savings_pct"
    " FROM (SELECT prefix, max(input_tokens) AS n FROM calls GROUP BY prefix) CROSS JOIN p"
)
def cache_savings(spark: SparkSession, sf: str) -> DataFrame:
    n = calls(spark, sf).groupBy("prefix").agg(F.max("input_tokens").alias("n")).join(F.broadcast(dims.table(spark, dims.PROFILES_SQL)))
    s = tokens.cache_savings(F.col("n"), F.col("price_in"), F.col("price_cache"), F.col("price_write"))
    return n.select("prefix", "name", F.round(s["raw_cost"] * 1e9).cast("long").alias("raw_nano"), F.round(s["cached_cost"] * 1e9).cast("long").alias("cached_nano"), F.round(s["savings_pct"], 1).alias("savings_pct"))


@query(
    _COSTS + " SELECT profile, count(*) AS requests, count_if(cached_tokens > 0) AS cache_hits, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(cached_tokens)::BIGINT AS cached_tokens,"
    " round(sum(raw + out), 6) AS raw_cost, round(sum(actual + out), 6) AS actual_cost FROM c GROUP BY profile"
)
def cost_summary(spark: SparkSession, sf: str) -> DataFrame:
    return costs.cost_summary(costs.request_costs(calls(spark, sf))).select("profile", "requests", "cache_hits", "input_tokens", "output_tokens", "cached_tokens", "raw_cost", "actual_cost")


@query(
    _COSTS + " SELECT profile, concat(profile, ': ', count(*), ' requests (', count_if(cached_tokens > 0), ' cache hits), ', sum(input_tokens), ' tokens in, ', sum(output_tokens), ' out') AS report FROM c GROUP BY profile"
)
def cost_report(spark: SparkSession, sf: str) -> DataFrame:
    return costs.summary_text(costs.cost_summary(costs.request_costs(calls(spark, sf))))


@query(
    _COSTS + " SELECT count(*) AS requests, count_if(cached_tokens > 0) AS hits, count_if(cached_tokens = 0) AS misses, round(count_if(cached_tokens > 0) / count(*) * 100, 1) AS hit_rate, sum(input_tokens)::BIGINT AS input_tokens,"
    " sum(output_tokens)::BIGINT AS output_tokens, sum(cached_tokens)::BIGINT AS cached_tokens, min(event_id) AS first_request, max(event_id) AS last_request FROM c"
)
def cache_stats(spark: SparkSession, sf: str) -> DataFrame:
    return costs.cache_stats(costs.request_costs(calls(spark, sf)))


@query(
    _CALLS + " SELECT prefix, min(event_id) AS first_seen, coalesce(max(event_id) FILTER (cached_tokens > 0), min(event_id)) AS last_hit, count_if(cached_tokens > 0) AS hit_count, count_if(cached_tokens = 0) AS miss_count FROM calls GROUP BY prefix"
)
def prefix_stats(spark: SparkSession, sf: str) -> DataFrame:
    return costs.prefix_stats(costs.request_costs(calls(spark, sf))).drop("hit_rate")


@query(
    "SELECT user_id, event_id, h AS prefix_hash, coalesce(h = lag(h) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) AS stable FROM (SELECT *, substr(sha256(concat('p', (event_id // 40)::VARCHAR)), 1, 16) AS h FROM events)"
)
def prefix_stability(spark: SparkSession, sf: str) -> DataFrame:
    h = F.substring(F.sha2(F.concat(F.lit("p"), F.expr("event_id div 40")), 256), 1, 16)
    return prompts.prefix_stability(load(spark, sf, "events").withColumn("prefix_hash", h)).select("user_id", "event_id", "prefix_hash", "stable")


_MODEL_OK = _CALLS + ", o AS (SELECT model, event_id, ok, output_tokens / greatest(1, input_tokens) AS ratio FROM calls)"


@query(
    _MODEL_OK + ", l AS (SELECT model, coalesce(max(event_id) FILTER (ok = 1), -1) AS last FROM o GROUP BY model) SELECT model, count(*) AS attempts, count_if(ok = 1) AS successes, count_if(ok = 0) AS failures, count_if(event_id > last) AS consecutive_failures,"
    " round(avg(ratio) FILTER (ok = 1), 6) AS avg_ratio FROM o JOIN l USING (model) GROUP BY model"
)
def learning_stats(spark: SparkSession, sf: str) -> DataFrame:
    o = calls(spark, sf).select("model", "event_id", "ok", (F.col("output_tokens") / F.greatest(F.lit(1), F.col("input_tokens"))).alias("ratio"))
    return costs.learning_stats(o)


@query(
    _CALLS + ", r AS (SELECT user_id, event_id, ok, count(*) OVER w AS calls, (sum(1 - ok) OVER w)::BIGINT AS errors FROM calls WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))"
    " SELECT user_id, event_id, calls, errors, ok = 0 AND calls >= 10 AND errors / calls > 0.3 AS trips FROM r"
)
def error_trips(spark: SparkSession, sf: str) -> DataFrame:
    return costs.error_trips(calls(spark, sf))


@query()
def breaker_replay(spark: SparkSession, sf: str) -> DataFrame:
    return costs.replay_breaker(calls(spark, sf))


_LOGGED = "WITH l AS (SELECT event_id, concat('p', user_id % 20) AS prefix, CASE WHEN event_id % 3 = 0 THEN 5 ELSE 0 END AS cached_tokens FROM events)"


@query(_LOGGED + " SELECT prefix, min(event_id) AS first_seen, coalesce(max(event_id) FILTER (cached_tokens > 0), min(event_id)) AS last_hit, count_if(cached_tokens > 0) AS hit_count, count_if(cached_tokens = 0) AS miss_count FROM l GROUP BY prefix")
def request_log(spark: SparkSession, sf: str) -> DataFrame:
    """The log in three batches, one of them run twice."""
    e = load(spark, sf, "events").select("event_id", F.concat(F.lit("p"), F.col("user_id") % 20).alias("prefix"), F.lit("m").alias("model"), F.lit(10).alias("input_tokens"), F.lit(1).alias("output_tokens"), F.when(F.col("event_id") % 3 == 0, 5).otherwise(0).alias("cached_tokens"))
    log = RequestLog(spark, new_path(spark, "log"))
    for batch in (0, 1, 1, 2):
        log.record(e.where(F.col("event_id") % 3 == batch), batch)
    return log.counters()


@query()
def classic_call(spark: SparkSession, sf: str) -> DataFrame:
    c = chat(spark, sf)
    usage = F.expr("""concat('{"usage":{"prompt_tokens":', 100 + conv_id % 50, ',"completion_tokens":', conv_id % 30, ',"prompt_tokens_details":{"cached_tokens":', conv_id % 20, '}}}')""")
    _, rows = pipelines.classic_call(c, c.where("turn = 0").select("conv_id", usage.alias("reply")), "deepseek-v4-pro")
    return costs.request_costs(rows)


# --- noise rules ------------------------------------------------------------------------------------------------


@query(
    "SELECT event_id, concat('a', props, 'c') AS cleaned, 2 AS tags FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, concat('a [SYSTEM]x ', event_type), 0 FROM events WHERE event_id % 2 = 1"
)
def system_tags(spark: SparkSession, sf: str) -> DataFrame:
    t = F.expr("CASE WHEN event_id % 2 = 0 THEN concat('a<SYSTEM>', event_type, chr(10), 'b</system>', props, '<attribution>', user_id, '</attribution>c') ELSE concat('a [SYSTEM]x ', event_type) END")
    return load(spark, sf, "events").select("event_id", rules.without_tags(t).alias("cleaned"), F.size(rules.system_tags(t)).alias("tags"))


@query(
    _TOOL + ", l AS (SELECT event_id, trim(unnest(string_split(content, chr(10)))) AS line FROM tool) SELECT event_id, count_if(regexp_matches(line, '(?i)^HTTP/[0-9.]+\\s+[0-9]+|^Content-Type:\\s*|^request_id:\\s*[a-z0-9_-]+$|^latency:\\s*[0-9.]+\\s*ms$')) AS noise_lines, count(*) AS lines FROM l GROUP BY event_id"
)
def tool_noise_lines(spark: SparkSession, sf: str) -> DataFrame:
    x = tool(spark, sf).select("event_id", F.split("content", "\n").alias("l"))
    noise = F.filter("l", lambda s: rules.is_tool_noise(rules.strip(s)))
    return x.select("event_id", F.size(noise).cast("long").alias("noise_lines"), F.size("l").cast("long").alias("lines"))


@query(
    _TOOL + ", l AS (SELECT event_id, generate_subscripts(x, 1) AS i, trim(unnest(x)) AS line FROM (SELECT event_id, string_split(content, chr(10)) AS x FROM tool)),"
    " m AS (SELECT *, line <> '' AND regexp_matches(line, '(?i)^HTTP/[0-9.]+\\s+[0-9]+|^Content-Type:\\s*|^request_id:\\s*[a-z0-9_-]+$|^latency:\\s*[0-9.]+\\s*ms$') AS meta FROM l),"
    " b AS (SELECT *, last_value(CASE WHEN line <> '' THEN meta END IGNORE NULLS) OVER (PARTITION BY event_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS inside FROM m)"
    " SELECT event_id, string_agg(line, chr(10) ORDER BY i) AS cleaned FROM b WHERE NOT meta AND NOT (line = '' AND coalesce(inside, false)) GROUP BY event_id"
)
def tool_clean(spark: SparkSession, sf: str) -> DataFrame:
    return tool(spark, sf).select("event_id", rules.clean_tool(F.col("content")).alias("cleaned"))


@query(
    _TOOL + ", l AS (SELECT event_id, generate_subscripts(x, 1) AS i, unnest(x) AS line FROM (SELECT event_id, string_split(content, chr(10)) AS x FROM tool))"
    " SELECT event_id, string_agg(line, chr(10) ORDER BY i) AS reduced FROM l WHERE trim(line) <> '' AND NOT regexp_matches(trim(line), '(?i)^HTTP/[0-9.]+\\s+[0-9]+|^Content-Type:\\s*|^request_id:\\s*[a-z0-9_-]+$|^latency:\\s*[0-9.]+\\s*ms$') GROUP BY event_id"
)
def old_tool_reduce(spark: SparkSession, sf: str) -> DataFrame:
    return tool(spark, sf).select("event_id", rules.reduce_tool(F.col("content")).alias("reduced"))


@query(
    _CHAT + ", l AS (SELECT conv_id, generate_subscripts(x, 1) AS i, unnest(x) AS line FROM (SELECT conv_id, string_split(content, chr(10)) AS x FROM chat WHERE role = 'assistant'))"
    " SELECT conv_id, string_agg(line, chr(10) ORDER BY i) AS reduced FROM l WHERE length(trim(line)) < 80 OR regexp_matches(line, 'Error|TODO') GROUP BY conv_id"
)
def assistant_reduce(spark: SparkSession, sf: str) -> DataFrame:
    return chat(spark, sf).where("role = 'assistant'").select("conv_id", rules.reduce_assistant(F.col("content")).alias("reduced"))


@query(
    _CHAT + ", f AS (SELECT conv_id, turn, trim(unnest(regexp_split_to_array(replace(content, chr(10), ','), '[,;:]\\s*'))) AS f FROM chat WHERE role IN ('user', 'assistant')) SELECT conv_id, turn, count(*) AS fragments, sum(length(f))::BIGINT AS chars FROM f WHERE f <> '' GROUP BY conv_id, turn"
)
def fragments(spark: SparkSession, sf: str) -> DataFrame:
    m = chat(spark, sf).where("role IN ('user', 'assistant')")
    f = m.select("conv_id", "turn", F.explode(F.flatten(F.transform(F.split("content", "\n"), rules.fragments))).alias("f"))
    return f.groupBy("conv_id", "turn").agg(F.count("*").alias("fragments"), F.sum(F.length("f")).cast("long").alias("chars"))


@query(
    f"WITH c AS ({CJK}) SELECT turn, concat('查询用户', conv_id, '的', string_split(string_split(content, '的')[2], '记录')[1], '记录，', CASE WHEN turn % 3 = 0 THEN '写报告' WHEN turn % 3 = 1 THEN '删除旧的数据文件' ELSE '' END, '！') AS cleaned FROM c"
)
def filler_strip(spark: SparkSession, sf: str) -> DataFrame:
    return cjk(spark, sf).select("turn", rules.strip_fillers(F.col("content")).alias("cleaned"))


@query()
def removed_text(spark: SparkSession, sf: str) -> DataFrame:
    return cjk(spark, sf).select("turn", rules.removed_text(F.col("content"), rules.strip_fillers(F.col("content"))).alias("removed"))


@query(
    _CHAT + ", f AS (SELECT trim(unnest(regexp_split_to_array(replace(content, chr(10), ','), '[,;:]\\s*'))) AS t FROM chat WHERE role <> 'system' UNION ALL SELECT concat('a ', event_type, ' const value') FROM events UNION ALL SELECT concat('```', event_type) FROM events UNION ALL SELECT event_id::VARCHAR FROM events UNION ALL SELECT concat('is it ', event_type, '?') FROM events)"
    " SELECT t, count(*) AS n, CASE WHEN starts_with(t, '```') THEN 'code_block' WHEN regexp_matches(t, 'Error|Exception|Traceback|File \"|raise |assert ') THEN 'error_trace' WHEN regexp_matches(t, 'https?://\\S+') THEN 'url'"
    " WHEN regexp_matches(t, '(?i)\\b(write|create|delete|modify|run|execute|search|analyze|implement|optimize|refactor|debug|fix|install|deploy|configure|test|compare|recommend|explain|translate|summarize|generate|download|upload|merge|check|verify|help|add|remove|update|set|get|find|show|list|open|close|enable|disable)\\b') THEN 'command_en'"
    " WHEN contains(t, '?') THEN 'question' WHEN regexp_matches(t, '\\b(Python|TypeScript|JavaScript|function|class|import|return|async|await|const|let|var|def |class |if |else|for |while )\\b') THEN 'technical'"
    " WHEN regexp_matches(t, '^\\d+[\\d.,]*$') THEN 'numeric' WHEN NOT contains(t, '!') THEN 'residual_fragment' ELSE 'default_signal' END AS reason FROM f WHERE t <> '' GROUP BY t"
)
def fragment_classes(spark: SparkSession, sf: str) -> DataFrame:
    talk = chat(spark, sf).where("role <> 'system'").select(F.explode(F.flatten(F.transform(F.split("content", "\n"), rules.fragments))).alias("t"))
    more = F.array(F.concat(F.lit("a "), "event_type", F.lit(" const value")), F.concat(F.lit("```"), "event_type"), F.col("event_id").cast("string"), F.concat(F.lit("is it "), "event_type", F.lit("?")))
    g = talk.union(load(spark, sf, "events").select(F.explode(more))).groupBy("t").agg(F.count("*").alias("n"))
    return g.withColumn("reason", rules.fragment_reason(F.col("t")))


@query()
def segments(spark: SparkSession, sf: str) -> DataFrame:
    return groups.segments(chat(spark, sf).unionByName(cjk(spark, sf)))


@query()
def segment_histogram(spark: SparkSession, sf: str) -> DataFrame:
    s = groups.segments(chat(spark, sf).unionByName(cjk(spark, sf)))
    return s.groupBy("role", "reason", "kind").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


@query(
    """SELECT event_id, concat('a', chr(10), chr(10), 'b', chr(10), chr(10), props, '  end [long_url]') AS ruled FROM events"""
)
def plugin_rules(spark: SparkSession, sf: str) -> DataFrame:
    t = F.expr("concat('a', repeat(chr(10), 3 + CAST(event_id % 3 AS INT)), chr(27), '[31mb', chr(10), 'DEBUG: ', event_type, chr(10), props, repeat(' ', 3 + CAST(event_id % 4 AS INT)), 'end https://x.y/', repeat('z', 200))")
    return load(spark, sf, "events").select("event_id", rules.plugin_rules(t).alias("ruled"))


# --- predicates over texts --------------------------------------------------------------------------------------

_NUM = "len(regexp_extract_all(content, '[$]?[0-9][0-9,.]*[KkMm%]?'))"


_FACT_UNITS = "len(regexp_extract_all(content, '(?i)\\b\\d[\\d,.]*\\s*(?:%|ms|s|sec|req/sec|GB|MB|KB|TB|vCPU|CPU|RAM|SSD|NVMe|K|M|mo|month|day|week|DAGs?|connections?|instances?|nodes?|brokers?)\\b'))"


@query(
    _CHAT + f", n AS (SELECT *, {_NUM}::BIGINT AS numbers, {_NUM} + {_FACT_UNITS} * 2.5::DOUBLE + len(regexp_extract_all(content, '[A-Za-z_][\\w\\s/-]{{0,40}}[:=]\\s*\\S')) * 2.0::DOUBLE + len(regexp_extract_all(content, '(?m)^\\s*[-*]\\s+\\S')) * 1.5::DOUBLE"
    " + len(regexp_extract_all(content, '->')) * 2.0::DOUBLE AS score FROM chat WHERE role = 'user')"
    " SELECT conv_id, turn, numbers, length(trim(content)) >= 20 AND ((length(content) < 500 AND numbers >= 3) OR score > greatest(length(content) * 0.045::DOUBLE, 6.0::DOUBLE)) AS short_dense FROM n"
)
def fact_dense(spark: SparkSession, sf: str) -> DataFrame:
    m = chat(spark, sf).where("role = 'user'")
    return m.select("conv_id", "turn", signals.count(F.col("content"), signals.NUMBER).cast("long").alias("numbers"), signals.is_fact_dense(F.col("content")).alias("short_dense"))


@query("WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) SELECT doc_id, len(l)::BIGINT AS lines, len(list_filter(l, lambda x: regexp_matches(x, '^(def |class |if |elif |else:|for |while |return |import |from |try|except|raise |with )|[{}]|->|=>|```')))::BIGINT AS code_lines FROM t")
def code_lines(spark: SparkSession, sf: str) -> DataFrame:
    return groups.code_blocks(load(spark, sf, "documents"), "doc_id", "text").select("doc_id", "lines", "code_lines")


@query()
def code_runs(spark: SparkSession, sf: str) -> DataFrame:
    lines = tool(spark, sf).select(F.col("event_id").alias("id"), F.posexplode(F.split("content", "\n")).alias("pos", "line"))
    return groups.code_runs(lines)


@query("SELECT event_id, 'short' AS kind FROM events WHERE event_id % 4 = 0 UNION ALL SELECT event_id, 'json' FROM events WHERE event_id % 4 IN (1, 2) UNION ALL SELECT event_id, 'mixed' FROM events WHERE event_id % 4 = 3")
def content_type(spark: SparkSession, sf: str) -> DataFrame:
    t = F.expr(
        """CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN concat('{"event_name": "', event_type, '", "user_number": ', user_id, '}') WHEN 2 THEN concat(repeat('some words ', 10), props, '{"a": "b", "c": "d"}', props)
        ELSE concat(repeat('"quoted" words ', 10), event_type) END"""
    )
    t2 = F.expr("""CASE WHEN event_id % 4 = 2 THEN concat(repeat('some words ', 9), '{"a": "b", "c": "d", "e": "', event_type, '"} tail') ELSE '' END""")
    e = load(spark, sf, "events")
    return e.select("event_id", signals.content_type(F.when(F.col("event_id") % 4 == 2, t2).otherwise(t)).alias("kind"))


@query(
    _CHAT + "SELECT conv_id, count_if(role = 'tool') AS tools, bool_or(contains(lower(content), '$')) AND bool_or(contains(lower(content), 'https://')) AS protected FROM chat GROUP BY conv_id"
)
def risk_policy(spark: SparkSession, sf: str) -> DataFrame:
    c = chat(spark, sf)
    p = groups.risk_policy(c)
    return p.join(c.groupBy("conv_id").agg(F.count_if(F.col("role") == "tool").alias("tools")), "conv_id").select("conv_id", "tools", (F.col("policy") == "protected").alias("protected"))


@query(
    "SELECT conv_id, 0::BIGINT AS risk_score, CASE WHEN sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) / greatest(1, sum(length(text))) > 0.55 THEN 'extreme' ELSE 'safe' END AS policy,"
    " CASE WHEN sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) / greatest(1, sum(length(text))) > 0.55 THEN 0.22 ELSE 0.3 END::DOUBLE AS target_ratio FROM conversations GROUP BY conv_id"
)
def risk_policy_raw(spark: SparkSession, sf: str) -> DataFrame:
    return groups.risk_policy(messages(spark, sf)).select("conv_id", F.col("risk_score").cast("long").alias("risk_score"), "policy", "target_ratio")


@query("SELECT conv_id, NOT bool_or(role = 'system' AND turn = 0) OR bool_or(turn = 0) AS has_first, count_if(turn > 0 AND role = 'user') > 0 AND NOT bool_or(role = 'system') AS valid FROM conversations GROUP BY conv_id")
def validity(spark: SparkSession, sf: str) -> DataFrame:
    m = messages(spark, sf)
    v = groups.valid_reductions(m, m.where("turn > 0 AND role <> 'system'"))
    first = m.groupBy("conv_id").agg((~F.bool_or((F.col("role") == "system") & (F.col("turn") == 0)) | F.bool_or(F.col("turn") == 0)).alias("has_first"))
    return v.join(first, "conv_id").select("conv_id", "has_first", "valid")


# --- conversations ----------------------------------------------------------------------------------------------


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3 AS recent FROM conversations")
def recent_split(spark: SparkSession, sf: str) -> DataFrame:
    return groups.split_recent(messages(spark, sf)).select("conv_id", "turn", "recent")


@query("SELECT conv_id, arg_max(text, turn) FILTER (role = 'user') AS last_user, arg_min(text, turn) FILTER (role = 'system') AS first_system FROM conversations GROUP BY conv_id")
def last_user(spark: SparkSession, sf: str) -> DataFrame:
    return groups.last_user_first_system(messages(spark, sf))


@query(
    "WITH u AS (SELECT conv_id, arg_max(text, turn) FILTER (role = 'user') AS t FROM conversations GROUP BY conv_id), w AS (SELECT conv_id, regexp_extract_all(t, '[A-Za-z][A-Za-z0-9_\\-]{3,}') AS w FROM u),"
    " f AS (SELECT conv_id, list_filter(w, lambda x: lower(x) NOT IN ('with', 'this', 'that')) AS w FROM w),"
    " g AS (SELECT conv_id, list_filter(w, lambda x, i: list_position(list_transform(w, lambda y: lower(y)), lower(x)) = i) AS w FROM f) SELECT conv_id, coalesce(array_to_string(w[1:12], ' '), '') AS keywords FROM g"
)
def latest_keywords(spark: SparkSession, sf: str) -> DataFrame:
    return groups.latest_keywords(messages(spark, sf)).select("conv_id", F.array_join("keywords", " ").alias("keywords"))


_GRAMS = "list_distinct([substr(content, i, 3) FOR i IN range(1, length(content) - 1)])"


@query(
    _CHAT + f", g AS (SELECT conv_id, turn, length(content) AS n, {_GRAMS} AS g FROM chat), p AS (SELECT a.conv_id, a.n >= 20 AND b.n >= 20 AND len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))) > 0.6 AS s FROM g a JOIN g b ON a.conv_id = b.conv_id AND a.turn < b.turn)"
    " SELECT conv_id, count(*) AS pairs, count_if(s) AS similar, count_if(s) / count(*) AS duplicate_ratio FROM p GROUP BY conv_id"
)
def duplicate_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return groups.duplicate_ratio(chat(spark, sf))


@query(
    "WITH t AS (SELECT conv_id, sum(length(text) // 4)::BIGINT AS total_tokens, count(*) AS message_count, count_if(role = 'system') AS system_messages, count_if(role = 'user') AS user_messages, count_if(role = 'assistant') AS assistant_messages FROM conversations GROUP BY conv_id)"
    " SELECT *, CASE WHEN total_tokens < 400 THEN 'short' WHEN total_tokens < 1500 THEN 'medium' WHEN total_tokens < 4000 THEN 'long' ELSE 'very_long' END AS length_bucket FROM t"
)
def content_profile(spark: SparkSession, sf: str) -> DataFrame:
    return groups.content_profile(messages(spark, sf)).select("conv_id", "total_tokens", "message_count", "system_messages", "user_messages", "assistant_messages", "length_bucket")


@query(
    "WITH t AS (SELECT conv_id, sum(length(text) // 4) AS n FROM conversations GROUP BY conv_id) SELECT conv_id, CASE WHEN n < 400 THEN 0.95 WHEN n < 1500 THEN 0.75 WHEN n < 4000 THEN 0.6 ELSE 0.5 END::DOUBLE AS keep_ratio, 'adaptive' AS method FROM t"
)
def ratio_policy(spark: SparkSession, sf: str) -> DataFrame:
    return groups.ratio_policy(groups.content_profile(messages(spark, sf))).select("conv_id", "keep_ratio", "method")


@query()
def ratio_policy_chat(spark: SparkSession, sf: str) -> DataFrame:
    return groups.ratio_policy(groups.content_profile(chat(spark, sf)))


_KEY = "concat('查询用户记录', CASE WHEN turn % 3 = 0 THEN '写报告' WHEN turn % 3 = 1 THEN '删除旧的数据文件' ELSE '' END)"


@query(f"WITH k AS (SELECT conv_id, turn, {_KEY} AS key FROM ({CJK})) SELECT conv_id, turn, key FROM k a WHERE EXISTS (SELECT 1 FROM k b WHERE b.conv_id = a.conv_id AND b.turn > a.turn AND (a.key = b.key OR contains(a.key, b.key) OR contains(b.key, a.key)))")
def repeated_instructions(spark: SparkSession, sf: str) -> DataFrame:
    return groups.repeated_instructions(cjk(spark, sf))


@query(
    "WITH s AS (SELECT conv_id, arg_min(text, turn) FILTER (role = 'system') AS s FROM conversations GROUP BY conv_id), w AS (SELECT c.*, list_distinct(regexp_extract_all(lower(s), '[\\w\\p{L}]+')) AS a, list_distinct(regexp_extract_all(lower(text), '[\\w\\p{L}]+')) AS b FROM conversations c JOIN s USING (conv_id))"
    " SELECT conv_id, turn FROM w WHERE NOT coalesce(role IN ('user', 'assistant') AND length(text) < 200 AND len(a) > 0 AND len(b) > 0 AND len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) > 0.8, false)"
)
def echo_removal(spark: SparkSession, sf: str) -> DataFrame:
    return groups.without_echoes(messages(spark, sf)).select("conv_id", "turn")


@query()
def near_dup_window(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.near_dedup(chat(spark, sf), 0.7)


@query()
def near_dup_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.near_dedup_simhash(chat(spark, sf))


@query(
    "WITH t AS (SELECT conv_id * 100 + turn AS id, text FROM conversations), g AS (SELECT id, substr(md5(substr(text, i, 3)), 1, 16) AS h FROM (SELECT id, text, unnest(range(1, greatest(length(text) - 1, 2))) AS i FROM t)),"
    " n AS (SELECT id, ('0x' || h)::UBIGINT AS h, count(*) AS c FROM g GROUP BY ALL), b AS (SELECT id, k, sum(c * (2 * ((h >> k) & 1)::BIGINT - 1)) AS s FROM n, range(0, 64) r(k) GROUP BY id, k)"
    " SELECT id, sum(CASE WHEN s > 0 THEN (1::HUGEINT << k::INTEGER) ELSE 0 END)::UBIGINT::VARCHAR AS fingerprint FROM b GROUP BY id"
)
def simhash_fp(spark: SparkSession, sf: str) -> DataFrame:
    t = messages(spark, sf).select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "content")
    # as an unsigned number in text, since the engines' signed types differ
    return dedup.fingerprints(t, "id", "content").select("id", F.conv(F.hex("fingerprint"), 16, 10).alias("fingerprint"))


# --- facts and quality ------------------------------------------------------------------------------------------


@query(
    _CHAT + "SELECT conv_id, turn, array_to_string(list_distinct(regexp_extract_all(content, 'https?://[^\\s]+')), ' ') AS urls, array_to_string(list_distinct(regexp_extract_all(content, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')), ' ') AS emails FROM chat"
)
def signals_extract(spark: SparkSession, sf: str) -> DataFrame:
    m = chat(spark, sf)
    return m.select("conv_id", "turn", *(F.array_join(signals.matches(F.col("content"), k), " ").alias(k) for k in ("urls", "emails")))


@query()
def protected_spans(spark: SparkSession, sf: str) -> DataFrame:
    return pipelines.protected_spans(chat(spark, sf))


@query()
def span_prompt(spark: SparkSession, sf: str) -> DataFrame:
    return pipelines.span_prompt(pipelines.protected_spans(chat(spark, sf)))


@query()
def fidelity(spark: SparkSession, sf: str) -> DataFrame:
    c = chat(spark, sf)
    return pipelines.fidelity(c, c.where("turn <> 1"))


@query(
    _CHAT + ", x AS (SELECT conv_id, turn, content AS o, substr(content, 1, 90) AS c FROM chat), e AS (SELECT conv_id, turn, o, c, list_distinct(regexp_extract_all(o, '\\b[A-Z][a-zA-Z]+\\b|\\b\\d[\\d,.]*\\b|\\b[a-zA-Z]+\\d+\\b')) AS eo, list_distinct(regexp_extract_all(c, '\\b[A-Z][a-zA-Z]+\\b|\\b\\d[\\d,.]*\\b|\\b[a-zA-Z]+\\d+\\b')) AS ec,"
    " list_distinct(regexp_extract_all(o, '\\b\\d[\\d,.]*\\b')) AS no, list_distinct(regexp_extract_all(c, '\\b\\d[\\d,.]*\\b')) AS nc FROM x)"
    " SELECT conv_id, turn, CASE WHEN len(eo) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(eo, ec)) / len(eo) END AS entity_recall, CASE WHEN len(no) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(no, nc)) / len(no) END AS number_precision,"
    " CASE WHEN len(eo) = 0 THEN 0 ELSE round_even((1 - len(list_intersect(eo, ec)) / len(eo)) * 100, 0) END::BIGINT AS entity_loss FROM e"
)
def evaluator(spark: SparkSession, sf: str) -> DataFrame:
    m = chat(spark, sf)
    e = signals.evaluate(F.col("content"), F.substring("content", 1, 90))
    return m.select("conv_id", "turn", *(e[k].alias(k) for k in ("entity_recall", "number_precision", "entity_loss")))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS structure FROM events")
def structure_score(spark: SparkSession, sf: str) -> DataFrame:
    short = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.regexp_replace("props", "[}:]", ""))
    # braces and the key mark: one of two kinds lost, or none
    return load(spark, sf, "events").select("event_id", F.round(signals.structure(F.regexp_replace("props", '":', '"'), F.regexp_replace(short, '":', '"')), 6).alias("structure"))


@query()
def density_score(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", F.round(signals.density_score(F.col("text")), 6).alias("score"))


@query()
def fact_score(spark: SparkSession, sf: str) -> DataFrame:
    return chat(spark, sf).select("conv_id", "turn", F.round(signals.fact_score(F.col("content")), 6).alias("score"))


@query("SELECT event_id, concat('DB pool of ', event_type, ' 5 srv, 2 inst at Total cost ', props) AS compact FROM events")
def fact_compact(spark: SparkSession, sf: str) -> DataFrame:
    t = F.expr("concat('  -  DB connection pool of ', event_type, chr(10), ' 5 servers, 2 instances   at Total monthly cost ', props, ' ')")
    return load(spark, sf, "events").select("event_id", signals.compact_fact(t).alias("compact"))


@query("SELECT event_id, 5 AS n, concat('- item ', event_type, '. Kept whole|key: ', event_id, '. Kept too|One.|Two!|Three') AS chunks FROM events")
def fact_chunks(spark: SparkSession, sf: str) -> DataFrame:
    t = F.expr("concat('- item ', event_type, '. Kept whole', chr(10), chr(10), 'key: ', event_id, '. Kept too', chr(10), 'One. Two! Three')")
    return load(spark, sf, "events").select("event_id", F.size(signals.fact_chunks(t)).alias("n"), F.array_join(signals.fact_chunks(t), "|").alias("chunks"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_id WHEN 1 THEN 2500 WHEN 2 THEN 700 WHEN 3 THEN 14 END::DOUBLE AS n FROM events")
def number_values(spark: SparkSession, sf: str) -> DataFrame:
    t = F.expr("CASE event_id % 5 WHEN 0 THEN concat('$', event_id, 'ms') WHEN 1 THEN '2,500 %' WHEN 2 THEN 'Seven Hundred' WHEN 3 THEN '14' ELSE concat('x', event_id) END")
    return load(spark, sf, "events").select("event_id", signals.number_of(t).alias("n"))


@query()
def pack_facts(spark: SparkSession, sf: str) -> DataFrame:
    m = chat(spark, sf)
    return pack.packed(m, "packed", "content", F.floor(F.length("content") * 0.6), F.lit(True)).select("conv_id", "turn", "packed")


@query()
def pack_density(spark: SparkSession, sf: str) -> DataFrame:
    d = load(spark, sf, "documents").where("text IS NOT NULL")
    return pack.packed(d, "packed", "text", F.floor(F.length("text") * 0.5), F.lit(False)).select("doc_id", "packed")


# --- prompts ----------------------------------------------------------------------------------------------------


@query(
    _CHAT + "SELECT conv_id, 'iso_date' AS name, 0 AS place, regexp_extract(content, '\\d{4}-\\d{2}-\\d{2}') AS value FROM chat WHERE role = 'system' UNION ALL SELECT conv_id, 'session', 0, regexp_extract(content, 'session_[a-z0-9]{8,}') FROM chat WHERE role = 'system' AND regexp_matches(content, 'session_[a-z0-9]{8,}')"
)
def dynamic_fields(spark: SparkSession, sf: str) -> DataFrame:
    return prompts.dynamic_fields(chat(spark, sf).where("role = 'system'"), "conv_id", "content")


@query(_CHAT + "SELECT conv_id, regexp_replace(regexp_replace(content, '\\d{4}-\\d{2}-\\d{2}', '{iso_date_0}'), 'session_[a-z0-9]{8,}', '{session_0}') AS template, content AS restored FROM chat WHERE role = 'system'")
def template_prefix(spark: SparkSession, sf: str) -> DataFrame:
    m = chat(spark, sf).where("role = 'system'").withColumn("x", prompts.extract_dynamic("content"))
    return m.select("conv_id", "x.template", prompts.inject(F.col("x.template"), F.col("x.fields")).alias("restored"))


_STABLE = "regexp_replace(regexp_replace(content, '\\d{4}-\\d{2}-\\d{2}', '{iso_date_0}'), 'session_[a-z0-9]{8,}', '{session_0}')"


@query(
    _CHAT + f"SELECT conv_id, turn, role, CASE WHEN role = 'system' THEN {_STABLE} ELSE content END AS content, false AS dynamic_tail FROM chat UNION ALL SELECT conv_id, 6, 'system',"
    " concat('[DYNAMIC_CONTEXT]', chr(10), 'iso_date_0=', regexp_extract(content, '\\d{4}-\\d{2}-\\d{2}'), CASE WHEN regexp_matches(content, 'session_[a-z0-9]{8,}') THEN concat(chr(10), 'session_0=', regexp_extract(content, 'session_[a-z0-9]{8,}')) ELSE '' END, chr(10), '[/DYNAMIC_CONTEXT]'), true FROM chat WHERE role = 'system'"
)
def dynamic_tail(spark: SparkSession, sf: str) -> DataFrame:
    return prompts.move_dynamic_to_tail(chat(spark, sf))


@query(_CHAT + "SELECT conv_id, turn, CASE WHEN role = 'system' THEN regexp_replace(regexp_replace(content, '\\d{4}-\\d{2}-\\d{2}', '{iso_date}'), 'session_[a-z0-9]{8,}', '{session}') ELSE trim(content, concat(' ', chr(10))) END AS content FROM chat")
def attribute_strip(spark: SparkSession, sf: str) -> DataFrame:
    return prompts.clean_attributes(chat(spark, sf).withColumn("trace_id", F.lit("x"))).select("conv_id", "turn", "content")


@query(
    "WITH m AS (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS l FROM conversations), j AS (SELECT conv_id, count(*) AS messages, string_agg(concat('{\"content\":', to_json(text), ',\"role\":', to_json(role), '}'), ',' ORDER BY turn) FILTER (turn < l OR turn = 0) AS j FROM m GROUP BY conv_id)"
    " SELECT conv_id, messages, substr(sha256(concat('[', j, ']')), 1, 16) AS prefix_hash FROM j"
)
def prefix_hash(spark: SparkSession, sf: str) -> DataFrame:
    return prompts.prefix_hash(messages(spark, sf))


@query(
    _CHAT + ", u AS (SELECT conv_id, max(turn) FILTER (role = 'user') AS u FROM chat GROUP BY conv_id) SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN role = 'system' THEN 0 WHEN role = 'tool' THEN 2 WHEN turn = u THEN 3 ELSE 1 END, turn) - 1)::INTEGER AS place FROM chat JOIN u USING (conv_id)"
)
def reorder(spark: SparkSession, sf: str) -> DataFrame:
    return prompts.reorder(chat(spark, sf)).select("conv_id", "turn", "place")


@query(_CHAT + "SELECT conv_id, 1.0::DOUBLE AS stability FROM chat WHERE turn = 0")
def stability_scores(spark: SparkSession, sf: str) -> DataFrame:
    c = chat(spark, sf)
    other = c.withColumn("content", F.regexp_replace("content", r"\d{4}-\d{2}-\d{2}", "2030-01-01"))
    return prompts.stability_scores(c, other)


@query("SELECT event_id, concat('{\"function\":{}}|{\"function\":{\"name\":\"a', event_type, '\"}}|{\"function\":{\"name\":\"z\"}}') AS tools FROM events")
def tool_sort(spark: SparkSession, sf: str) -> DataFrame:
    t = F.expr("""array('{"function":{"name":"z"}}', concat('{"function":{"name":"a', event_type, '"}}'), '{"function":{}}')""")
    return load(spark, sf, "events").select("event_id", F.array_join(prompts.sort_tools(t), "|").alias("tools"))


# --- recall -----------------------------------------------------------------------------------------------------


@query("SELECT conv_id, turn, substr(sha256(text), 1, 12) AS recall_key, substr(md5(text), 1, 6) AS ref FROM conversations")
def recall_keys(spark: SparkSession, sf: str) -> DataFrame:
    return messages(spark, sf).select("conv_id", "turn", recall.recall_key(F.col("content")).alias("recall_key"), dedup.ref_hash(F.col("content")).alias("ref"))


@query("SELECT conv_id, md5(concat('large', chr(10), string_agg(concat(role, ':', text), chr(10) ORDER BY turn))) AS cache_key FROM conversations GROUP BY conv_id")
def cache_keys(spark: SparkSession, sf: str) -> DataFrame:
    return recall.cache_key(messages(spark, sf), "large")


@query(
    "WITH o AS (SELECT conv_id, turn AS pos, substr(text, 1, 80) AS s, substr(sha256(text), 1, 12) AS h FROM conversations WHERE length(text) > 50), r AS (SELECT conv_id, turn, substr(text, 1, 70) AS c FROM conversations),"
    " f AS (SELECT r.conv_id, turn, arg_min(h, pos) AS h FROM r JOIN o ON r.conv_id = o.conv_id AND length(c) >= 10 AND (substr(c, 1, 80) = s OR contains(s, substr(c, 1, 60))) GROUP BY ALL)"
    " SELECT conv_id, turn, concat(c, CASE WHEN h IS NULL THEN '' ELSE concat(' [TO:retrieve hash=', h, ']') END) AS content FROM r LEFT JOIN f USING (conv_id, turn)"
)
def recall_annotate(spark: SparkSession, sf: str) -> DataFrame:
    m = messages(spark, sf)
    o = m.where("length(content) > 50").select("conv_id", F.col("turn").alias("pos"), F.col("content").alias("original"))
    return recall.annotate(m.select("conv_id", "turn", F.substring("content", 1, 70).alias("content")), o).select("conv_id", "turn", "content")


@query(
    "WITH e AS (SELECT substr(sha256(text), 1, 12) AS h, any_value(text) AS original FROM conversations WHERE length(text) > 50 GROUP BY 1) SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN substr(sha256(text), 1, 12) END AS hash_key, CASE WHEN turn % 2 = 0 THEN original END AS original, 'short' AS cleaned FROM conversations LEFT JOIN e ON substr(sha256(text), 1, 12) = h"
)
def recall_resolve(spark: SparkSession, sf: str) -> DataFrame:
    m = messages(spark, sf)
    entries = recall.store(m.withColumn("at", F.col("turn")))
    t = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("short [TO:retrieve hash="), recall.recall_key(F.col("content")), F.lit("]"))).otherwise("short")
    return recall.resolve(m.select("conv_id", "turn", t.alias("content")), entries).select("conv_id", "turn", "hash_key", "original", "cleaned")


@query(
    "WITH e AS (SELECT substr(sha256(props), 1, 12) AS hash_key, max(event_id) AS last_access FROM events WHERE length(props) > 3 GROUP BY 1) SELECT hash_key, last_access FROM e WHERE (SELECT max(event_id) FROM events) - last_access <= 300 ORDER BY last_access DESC, hash_key LIMIT 50"
)
def lru_evict(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events")
    entries = recall.store(e.select(F.col("props").alias("content"), F.col("event_id").alias("at")), 3)
    now = e.agg(F.max("event_id").alias("now"))
    return recall.evict(entries.join(F.broadcast(now)), F.col("now")).select("hash_key", "last_access")


@query("SELECT count_if(event_id % 3 = 0) AS hits, count_if(event_id % 3 <> 0) AS misses, count_if(event_id % 3 = 0) / count(*) AS hit_rate FROM events")
def recall_hit_rate(spark: SparkSession, sf: str) -> DataFrame:
    return recall.hit_rate(load(spark, sf, "events").select((F.col("event_id") % 3 == 0).alias("hit")))


@query(
    "WITH r AS (SELECT event_id AS id, props AS cache_key, row_number() OVER (PARTITION BY props ORDER BY ts, event_id) = 1 AS first FROM events), s AS (SELECT DISTINCT props AS cache_key FROM events WHERE event_type = 'click') SELECT id, first, NOT first AND s.cache_key IS NOT NULL AS served FROM r LEFT JOIN s USING (cache_key)"
)
def background_results(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events")
    results = e.where("event_type = 'click'").select(F.col("props").alias("cache_key"), F.lit("x").alias("result")).distinct()
    return recall.merge_background(e.select(F.col("event_id").alias("id"), F.col("props").alias("cache_key"), F.col("ts").alias("at")), results).select("id", "first", "served")


# --- JSON -------------------------------------------------------------------------------------------------------

_NESTED = """concat('{"order_identifier": ', event_id, ', "details": [{"customer_name": "', event_type, '", "amount": ', CAST(event_id % 100 AS INT), '.12345}], "k": ', props, '}')"""


@query(
    """SELECT event_id, concat('{"a3":', event_id, ',"a2":[{"a1":"', event_type, '","a0":', event_id % 100, '.12}],"k":', replace(props, ' ', ''), '}') AS compressed, 5::BIGINT AS total_keys FROM events"""
)
def json_alias(spark: SparkSession, sf: str) -> DataFrame:
    x = load(spark, sf, "events").withColumn("x", jsonx.alias_keys(F.expr(_NESTED)))
    return x.select("event_id", "x.compressed", "x.total_keys")


@query()
def json_restore(spark: SparkSession, sf: str) -> DataFrame:
    x = load(spark, sf, "events").withColumn("x", jsonx.alias_keys(F.expr(_NESTED)))
    return x.select("event_id", jsonx.restore_keys("x.compressed", "x.names").alias("restored"))


@query("SELECT DISTINCT unnest(json_keys(props)) AS key FROM events")
def key_union(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").select(F.explode(jsonx.top_keys(F.col("props"))).alias("key")).distinct()


@query("SELECT unnest(['order_identifier', 'details', 'customer_name', 'amount', 'k']) AS key UNION SELECT unnest(json_keys(props)) FROM events")
def key_union_deep(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").select(F.explode(jsonx.all_keys(F.expr(_NESTED))).alias("key")).distinct()


@query("SELECT user_id, CASE WHEN n <= 4 THEN array_to_string(v, ',') ELSE concat(v[1], ',', v[2], ',...(', n - 4, ' omitted)...,', v[n - 1], ',', v[n]) END AS ends FROM (SELECT user_id, count(*) AS n, list(event_id::VARCHAR ORDER BY event_id) AS v FROM events GROUP BY user_id)")
def array_ends(spark: SparkSession, sf: str) -> DataFrame:
    v = F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string"))
    return load(spark, sf, "events").groupBy("user_id").agg(v.alias("v")).select("user_id", F.array_join(jsonx.array_ends(F.col("v")), ",").alias("ends"))


_FIELDS = {
    "event_type": "event_type", "event_id": "CAST(event_id AS {s})", "user_bucket": "CAST(event_id % 7 * 20 AS {s})", "day": "concat('2024-01-', CAST(10 + event_id % 20 AS {s}))", "flag": "CAST(event_id % 2 AS {s})",
    "word": "CASE WHEN event_id % 2 = 0 THEN 'alpha' ELSE 'beta' END", "share": "concat(CAST(event_id % 90 AS {s}), '%')", "user": "concat('u', CAST(user_id AS {s}))", "bool": "CASE WHEN event_id % 2 = 0 THEN 'yes' ELSE 'no' END",
}
_LONG = " UNION ALL ".join(f"SELECT '{k}' AS field, event_id AS pos, {x.format(s='VARCHAR')} AS value FROM events" for k, x in _FIELDS.items())


@query(
    f"WITH l AS ({_LONG}), r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY pos) AS r, try_cast(value AS DOUBLE) AS num FROM l),"
    " g AS (SELECT field, count(*) AS n, count(DISTINCT value) AS u, bool_or(regexp_matches(lower(value), 'error|exception|traceback|fatal|critical|panic|failure|crash|segfault|oom|timeout|refused|denied|forbidden|unauthorized|not found|500|502|503|404|401|403')) AS bad,"
    " count(num) AS nums, min(num) AS lo, max(num) AS hi, avg(num) AS mean, stddev_samp(num) AS sd, bool_or(contains(value, '%')) AS pct, bool_and(lower(trim(value)) IN ('true', 'false', '1', '0', 'yes', 'no')) AS bools, count_if(r <= 20) AS head,"
    " count_if(r <= 20 AND regexp_matches(value, '\\d{4}-\\d{2}-\\d{2}|\\d{4}/\\d{2}/\\d{2}|\\d{2}:\\d{2}:\\d{2}|\\d{10,13}|(?i:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)')) AS times,"
    " bool_or(r <= 10 AND regexp_matches(value, '(?i)\\b(score|rating|confidence|accuracy|precision|recall|f1|auc)\\s*[:=]\\s*[\\d.]+|\\b\\d+(\\.\\d+)?%')) AS scored FROM r GROUP BY field),"
    " k AS (SELECT *, CASE WHEN bad THEN 'error' WHEN u / n > 0.9 AND n > 3 THEN 'id' WHEN nums > n * 0.7 AND nums >= 2 AND lo >= 0 AND hi <= 100 AND (pct OR scored OR hi <= 1) THEN 'score' WHEN nums > n * 0.7 THEN 'numeric' WHEN times >= head * 0.3 THEN 'temporal' WHEN bools THEN 'boolean' ELSE 'text' END AS kind FROM g)"
    " SELECT field, n AS \"values\", u AS distinct_values, kind, kind = 'numeric' AND coalesce(sd > 0 AND (hi - mean > 2 * sd OR mean - lo > 2 * sd), false) AS is_anomaly, kind = 'error' AS is_protected FROM k"
)
def field_typing(spark: SparkSession, sf: str) -> DataFrame:
    fields = F.create_map(*(x for k, c in _FIELDS.items() for x in (F.lit(k), F.expr(c.format(s="STRING")))))
    return jsonx.field_types(load(spark, sf, "events").select(F.col("event_id").alias("pos"), F.explode(fields).alias("field", "value")))


@query("SELECT 'event_type' AS field, 'error_content_never_discard' AS hint WHERE EXISTS (SELECT 1 FROM events WHERE event_type = 'error') UNION ALL SELECT 'amount', CASE WHEN max(value) - avg(value) > 2 * stddev_samp(value) OR avg(value) - min(value) > 2 * stddev_samp(value) THEN 'numeric_standard_compress_has_anomaly' END FROM (SELECT (value::BIGINT % 40)::DOUBLE + 200 * (event_id % 50 = 0)::INTEGER + 101 AS value FROM events) HAVING max(value) - avg(value) > 2 * stddev_samp(value) OR avg(value) - min(value) > 2 * stddev_samp(value)")
def protected_values(spark: SparkSession, sf: str) -> DataFrame:
    amount = F.expr("CAST(CAST(bround(value) AS BIGINT) % 40 AS DOUBLE) + CASE WHEN event_id % 50 = 0 THEN 200 ELSE 0 END + 101")
    pairs = F.create_map(F.lit("event_type"), F.col("event_type"), F.lit("amount"), amount.cast("string"), F.lit("word"), F.lit("alpha"))
    return jsonx.protected_values(jsonx.field_types(load(spark, sf, "events").select(F.col("event_id").alias("pos"), F.explode(pairs).alias("field", "value"))))


@query()
def csv_schema(spark: SparkSession, sf: str) -> DataFrame:
    rec = F.concat(F.lit('{"event_identifier": '), F.col("event_id"), F.lit(', "event_category": "'), F.col("event_type"), F.lit('"}'))
    g = load(spark, sf, "events").groupBy("user_id").agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(rec)), ","), F.lit("]")).alias("t"))
    return g.withColumn("x", jsonx.csv_schema("t")).select("user_id", "x.*")


@query()
def json_analysis(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").withColumn("x", jsonx.analyse_block(F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.col("event_type")))).select("event_id", "x.*")


@query("SELECT event_id, concat(event_type, '|b') AS values FROM events")
def ordered_unique(spark: SparkSession, sf: str) -> DataFrame:
    v = F.array(F.col("event_type"), F.concat(F.upper("event_type"), F.lit(".")), F.lit(" b; "), F.lit("B"), F.lit(" , "))
    return load(spark, sf, "events").select("event_id", F.array_join(signals.ordered_unique(v), "|").alias("values"))


# --- pipelines --------------------------------------------------------------------------------------------------


@query()
def rule_compress(spark: SparkSession, sf: str) -> DataFrame:
    return pipelines.rule_compress(chat(spark, sf))


@query()
def rule_compress_raw(spark: SparkSession, sf: str) -> DataFrame:
    return pipelines.rule_compress(messages(spark, sf), echoes=True)


@query()
def history_compress(spark: SparkSession, sf: str) -> DataFrame:
    return pipelines.compress_history(chat(spark, sf))


@query()
def adaptive_compress(spark: SparkSession, sf: str) -> DataFrame:
    return pipelines.adaptive_compress(messages(spark, sf), 0.75)


@query()
def compress_text(spark: SparkSession, sf: str) -> DataFrame:
    return pipelines.compress_text(load(spark, sf, "documents"), "doc_id", "text")


_SHADOW = (
    "WITH t AS (SELECT conv_id, sum(CASE WHEN trim(text) <> '' THEN greatest(1, length(text) // 3) ELSE 0 END)::BIGINT AS n, CASE WHEN sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) / greatest(1, sum(length(text))) > 0.55 THEN 'extreme' ELSE 'safe' END AS policy FROM conversations GROUP BY conv_id),"
    " s AS (SELECT *, CASE WHEN policy = 'extreme' THEN 0.22 ELSE 0.3 END::DOUBLE AS r, greatest(1, floor(n * CASE WHEN policy = 'extreme' THEN 0.22 ELSE 0.3 END::DOUBLE))::BIGINT AS k FROM t),"
    " p AS (SELECT *, n / 1000000 * 1.0::DOUBLE + floor(n * 0.2::DOUBLE) / 1000000 * 3.0::DOUBLE AS rc, n / 1000000 * 0.1::DOUBLE + k / 1000000 * 0.3::DOUBLE + k / 1000000 * 1.0::DOUBLE + floor(k * 0.2::DOUBLE) / 1000000 * 3.0::DOUBLE AS sc FROM s)"
    " SELECT conv_id, n AS original_tokens, policy, r AS target_ratio, rc > sc AND (rc - sc) / rc * 100 >= 5.0 AS would_call_smart, CASE WHEN rc > sc AND (rc - sc) / rc * 100 >= 5.0 THEN 'mimo-v2-flash' END AS candidate, CASE WHEN rc > sc AND (rc - sc) / rc * 100 >= 5.0 THEN k END AS smart_tokens FROM p"
)


@query(_SHADOW)
def shadow_projection(spark: SparkSession, sf: str) -> DataFrame:
    m = messages(spark, sf)
    return pipelines.shadow(m, "mimo-v2.5-pro", ruled=m).select("conv_id", "original_tokens", "policy", "target_ratio", "would_call_smart", "candidate", "smart_tokens")


@query()
def shadow_telemetry(spark: SparkSession, sf: str) -> DataFrame:
    return pipelines.shadow(messages(spark, sf), "mimo-v2.5-pro")


@query(
    "WITH e AS (SELECT event_id, event_id % 5 <> 0 AS would, CASE WHEN event_id % 10 = 0 THEN 'profit_guard' END AS fallback, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 60 END AS saved, CASE WHEN event_id % 3 = 0 THEN 'protected' ELSE 'safe' END AS policy, event_id % 90 AS spans FROM events),"
    " r AS (SELECT event_id, CASE WHEN NOT would THEN coalesce(fallback, 'shadow_not_profitable') WHEN saved IS NULL OR saved < 20 THEN 'estimated_savings_below_threshold' WHEN policy = 'protected' THEN 'protected_policy_disabled' WHEN spans > 64 THEN 'too_many_protected_spans' ELSE 'auto_gate_passed' END AS reason FROM e)"
    " SELECT event_id, reason, reason = 'auto_gate_passed' AS enabled FROM r"
)
def gate_rules(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    t = load(spark, sf, "events").select(
        "event_id", (i % 5 != 0).alias("would_call_smart"), F.when(i % 10 == 0, "profit_guard").alias("fallback_reason"), F.when(i % 7 != 0, (i % 60).cast("double")).alias("savings_pct"),
        F.when(i % 3 == 0, "protected").otherwise("safe").alias("policy"), (i % 90).alias("protected_span_count"),
    )
    return pipelines.rollout_gate(t, allow_protected=False).select("event_id", "reason", "enabled")


@query()
def rollout_gate(spark: SparkSession, sf: str) -> DataFrame:
    m = messages(spark, sf)
    spans = pipelines.protected_spans(m).groupBy("conv_id").agg(F.count("*").alias("protected_span_count"))
    plan = pipelines.shadow(m, "qwen-max").join(spans, "conv_id", "left")
    return pipelines.rollout_gate(plan.withColumn("protected_span_count", F.coalesce("protected_span_count", F.lit(0).cast("long"))))


def _replies(m: DataFrame) -> DataFrame:
    """Stand-in replies of a compressor: the conversation without its replies and tools; some are fenced, some broken."""
    kept = m.where("role IN ('system', 'user')")
    items = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    r = kept.groupBy("conv_id").agg(F.to_json(items).alias("j"))
    i = F.col("conv_id") % 3
    return r.select("conv_id", F.when(i == 0, F.col("j")).when(i == 1, F.concat(F.lit("```json\n"), F.col("j"), F.lit("\n```"))).otherwise("no list").alias("reply"))


@query(_CHAT + "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, role, content FROM chat WHERE role IN ('system', 'user') AND conv_id % 3 < 2")
def parse_replies(spark: SparkSession, sf: str) -> DataFrame:
    return pipelines.parse_replies(_replies(chat(spark, sf)))


@query()
def smart_compress(spark: SparkSession, sf: str) -> DataFrame:
    c = chat(spark, sf)
    return pipelines.smart_compress(c, _replies(c), "qwen-max")


@query()
def production_call(spark: SparkSession, sf: str) -> DataFrame:
    c = chat(spark, sf)
    return pipelines.production(c, "qwen-max", _replies(c))


@query()
def plugin_compress(spark: SparkSession, sf: str) -> DataFrame:
    return pipelines.plugin_compress(messages(spark, sf), "deepseek-v4-pro", least=100, least_llm=200)


def _cases(spark: SparkSession, sf: str) -> DataFrame:
    """Each order's chat as a case with three assertions."""
    m = chat(spark, sf).where("role IN ('system', 'user', 'assistant')")
    items = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    g = m.groupBy("conv_id").agg(items.alias("messages"))
    own = F.expr("""concat('["{\\\\"type\\\\":\\\\"present\\\\",\\\\"value\\\\":\\\\"order ', conv_id, '\\\\"}","{\\\\"type\\\\":\\\\"all_of\\\\",\\\\"values\\\\":[\\\\"30 days\\\\",\\\\"250 ms\\\\"]}","{\\\\"type\\\\":\\\\"any_of\\\\",\\\\"values\\\\":[\\\\"seven\\\\",\\\\"unicorn\\\\"]}"]')""")
    groups_ = F.array(F.array(F.concat(F.lit("invoice "), F.col("conv_id")), F.lit("bill")), F.array(F.lit("3 retries"), F.lit("three retries")))
    odd = F.col("conv_id") % 2 == 1
    return g.select(F.col("conv_id").cast("string").alias("id"), "messages", F.when(~odd, groups_).alias("qa_groups"), F.when(odd, own).alias("qa_assertions"))


@query()
def assertion_eval(spark: SparkSession, sf: str) -> DataFrame:
    c = _cases(spark, sf)
    text = F.array_join(F.transform("messages", lambda x: x["content"]), "\n")
    a = cases.assertions(c).join(c.select("id", text.alias("text")), "id")
    return cases.checked(a).select("id", "pos", "assertion", "found", "missing", "miss")


@query()
def keyword_recall(spark: SparkSession, sf: str) -> DataFrame:
    m = chat(spark, sf)
    k = F.array(F.lit("30 days"), F.lit("0.25 s"), F.lit("250 ms"), F.lit("Invoice"), F.lit("unicorn"))
    # the keywords are the same for every message
    asked = spark.range(1).select(cases.grouped(k).alias("asked"))
    return m.crossJoin(F.broadcast(asked)).select("conv_id", "turn", cases.unstated(F.col("content"), F.col("asked")).alias("missing"))


@query()
def benchmark_quality(spark: SparkSession, sf: str) -> DataFrame:
    return pipelines.benchmark_quality(_cases(spark, sf))


@query()
def benchmark_fixed(spark: SparkSession, sf: str) -> DataFrame:
    return pipelines.benchmark_quality(_cases(spark, sf), 0.4)


@query()
def benchmark_cases(spark: SparkSession, sf: str) -> DataFrame:
    c = _cases(spark, sf)
    out = pipelines.benchmark(c)
    return cases.case_results(cases.checked(groups.beside(cases.assertions(c), out.select("id", "text"), "id")).select("id", "found", "miss"))


@query("SELECT count(*) AS total_cases, sum(1 + event_id % 3)::BIGINT AS total_qa, sum((1 + event_id % 3) - (event_id % 5 = 0)::INTEGER)::BIGINT AS passed_qa, count_if(event_id % 5 <> 0) AS perfect_cases, sum((1 + event_id % 3) - (event_id % 5 = 0)::INTEGER) / sum(1 + event_id % 3) AS qa_rate, string_agg(event_id::VARCHAR, ',' ORDER BY event_id::VARCHAR) FILTER (event_id % 5 = 0) AS failed FROM events")
def bench_summary(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    r = load(spark, sf, "events").select(i.cast("string").alias("id"), (1 + i % 3).alias("qa_total"), (1 + i % 3 - F.when(i % 5 == 0, 1).otherwise(0)).alias("qa_passed"))
    return cases.run_summary(r).withColumn("failed", F.array_join("failed", ","))


@query("SELECT event_type AS id, count_if(event_id % 2 = 0) AS qa_passed, count(*) AS qa_total, count_if(event_id % 2 = 1 AND event_id % 3 = 0) AS alias_gap, count_if(event_id % 2 = 1 AND event_id % 3 <> 0) AS true_loss, 0::BIGINT AS assertion_gap FROM events GROUP BY event_type")
def miss_summary(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    return cases.case_results(load(spark, sf, "events").select(F.col("event_type").alias("id"), (i % 2 == 0).alias("found"), F.when(i % 3 == 0, "alias_gap").otherwise("true_loss").alias("miss")))


# --- streams ----------------------------------------------------------------------------------------------------

_STREAM = "WITH c AS (SELECT event_id, ts, user_id, concat('p', user_id % 20) AS prefix, CASE WHEN event_id % 3 = 0 THEN floor(value * 4) ELSE 0 END AS cached, floor(value * 10)::BIGINT AS input_tokens, event_type <> 'error' AS ok FROM events)"


@query(_STREAM + " SELECT prefix, count_if(cached > 0) AS hit_count, count_if(cached = 0) AS miss_count FROM c GROUP BY prefix")
def stream_prefix_hits(spark: SparkSession, sf: str) -> DataFrame:
    return streams.run_once(streams.prefix_hits(streams.as_calls(streams.read_events(spark, sf))), "complete")


@query("SELECT DISTINCT props AS hash_key, user_id FROM events")
def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    requests = streams.read_events(spark, sf).select(F.col("props").alias("hash_key"), "user_id", "ts")
    return streams.run_once(streams.distinct_requests(requests, ["hash_key", "user_id"], "10000 hours"), "append").select("hash_key", "user_id")


@query("SELECT event_id, props AS hash_key, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY props ORDER BY ts, event_id)) <= 3600000000, false) AS hit FROM events")
def stream_recall_ttl(spark: SparkSession, sf: str) -> DataFrame:
    e = streams.read_events(spark, sf).select("event_id", "ts", F.col("props").alias("hash_key"))
    return streams.run_once(streams.recall_state(e, 3600), "append")


@query(_STREAM + ", l AS (SELECT prefix, coalesce(max(event_id) FILTER (ok), -1) AS last FROM c GROUP BY prefix) SELECT prefix, count(*) AS attempts, count_if(ok) AS successes, count_if(event_id > last) AS consecutive_failures FROM c JOIN l USING (prefix) GROUP BY prefix")
def stream_learning(spark: SparkSession, sf: str) -> DataFrame:
    return streams.run_once(streams.learning_state(streams.as_calls(streams.read_events(spark, sf))), "update", ("prefix",))


@query(_STREAM + ", w AS (SELECT epoch(date_trunc('hour', ts))::BIGINT AS start_s, count(*) AS calls, sum(input_tokens)::BIGINT AS input_tokens FROM c GROUP BY 1) SELECT * FROM w WHERE start_s + 3600 <= (SELECT epoch(max(ts)) - 7200 FROM c)")
def stream_windowed_costs(spark: SparkSession, sf: str) -> DataFrame:
    w = streams.run_once(streams.windowed_costs(streams.as_calls(streams.read_events(spark, sf))), "append")
    return w.select(F.unix_timestamp("start").alias("start_s"), "calls", "input_tokens")


@query("WITH s AS (SELECT DISTINCT props AS hash_key FROM events WHERE event_type = 'click') SELECT event_id, e.props AS hash_key, s.hash_key IS NOT NULL AS served FROM events e LEFT JOIN s ON e.props = s.hash_key")
def stream_background(spark: SparkSession, sf: str) -> DataFrame:
    results = load(spark, sf, "events").where("event_type = 'click'").select(F.col("props").alias("hash_key"), F.lit("x").alias("result")).distinct()
    requests = streams.read_events(spark, sf).select("event_id", F.col("props").alias("hash_key"))
    return streams.run_once(streams.with_results(requests, results), "append").select("event_id", "hash_key", F.col("result").isNotNull().alias("served"))


@query()
def stream_breaker(spark: SparkSession, sf: str) -> DataFrame:
    return streams.run_once(streams.breaker_state(streams.as_calls(streams.read_events(spark, sf))), "append")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Shadow telemetry of each conversation: tokens, policy, route, projected savings."""
    return pipelines.shadow(messages(spark, sf), "mimo-v2.5-pro")
