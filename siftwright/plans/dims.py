"""Dimension tables: routes, profiles, price hints, context windows. A few rows each, so they are broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values (USD per million tokens; the order of routes decides).
ROUTES = (
    ("mimo-v2.5-pro", 1.00, 3.00, "mimo-v2-flash", 0.10, 0.30, 256_000),
    ("mimo-v2.5", 0.14, 0.28, "mimo-v2-flash", 0.10, 0.30, 256_000),
    ("mimo-pro", 1.00, 3.00, "mimo-v2-flash", 0.10, 0.30, 256_000),
    ("deepseek-v4-pro", 0.435, 0.87, "deepseek-v4-flash", 0.14, 0.28, 1_000_000),
    ("deepseek-pro", 0.435, 0.87, "deepseek-v4-flash", 0.14, 0.28, 1_000_000),
    ("qwen-max", 2.40, 9.60, "qwen-turbo", 0.05, 0.20, 1_000_000),
    ("qwen-plus", 0.40, 1.20, "qwen-turbo", 0.05, 0.20, 1_000_000),
    ("gpt-4o", 2.50, 10.00, "gpt-4o-mini", 0.15, 0.60, 1_000_000),
    ("gpt-4-turbo", 10.00, 30.00, "gpt-4o-mini", 0.15, 0.60, 1_000_000),
    ("claude-3-opus", 15.00, 75.00, "claude-3-haiku", 0.25, 1.25, 1_000_000),
    ("claude-3.5-sonnet", 3.00, 15.00, "claude-3-haiku", 0.25, 1.25, 1_000_000),
)
PROFILES = (
    ("deepseek-v4-flash", 0.14, 0.28, 0.0028, 0.0),
    ("deepseek-v4-pro", 0.435, 0.87, 0.003625, 0.0),
    ("mimo-v2-flash", 0.10, 0.30, 0.01, 0.0),
    ("mimo-v2.5", 0.14, 0.28, 0.0028, 0.0),
    ("mimo-v2.5-pro", 1.00, 3.00, 0.20, 0.0),
)
ALIASES = (
    ("deepseek-v4", "deepseek-v4-flash"),
    ("deepseek-flash", "deepseek-v4-flash"),
    ("deepseek-pro", "deepseek-v4-pro"),
    ("mimo-flash", "mimo-v2-flash"),
    ("mimo-v2-flash", "mimo-v2-flash"),
    ("mimo-pro", "mimo-v2.5-pro"),
    ("mimo-v2.5-pro", "mimo-v2.5-pro"),
    ("mimo-v2.5", "mimo-v2.5"),
    ("mimo", "mimo-v2.5"),
)
HINTS = (
    ("mimo-v2-flash", 0.10, 0.30, 256_000),
    ("mimo-v2.5", 0.14, 0.28, 1_000_000),
    ("mimo-v2.5-pro", 1.00, 3.00, 1_000_000),
    ("deepseek-v4-flash", 0.14, 0.28, 1_000_000),
    ("deepseek-v4-pro", 0.435, 0.87, 1_000_000),
    ("qwen-turbo", 0.05, 0.20, 1_000_000),
    ("qwen-plus", 0.40, 1.20, 1_000_000),
    ("qwen-max", 2.40, 9.60, 1_000_000),
    ("gpt-4o-mini", 0.15, 0.60, 128_000),
    ("gpt-4o", 2.50, 10.00, 128_000),
    ("claude-3-haiku", 0.25, 1.25, 200_000),
    ("claude-3-opus", 15.00, 75.00, 200_000),
    ("claude-3.5-sonnet", 3.00, 15.00, 200_000),
)
CONTEXTS = (
    ("gpt-5.5", 128000),
    ("gpt-4o", 128000),
    ("gpt-4o-mini", 128000),
    ("claude-sonnet-4-20250514", 200000),
    ("claude-3-5-sonnet", 200000),
    ("deepseek-v4-pro", 65536),
    ("deepseek-v4-flash", 65536),
    ("qwen-plus", 131072),
    ("mimo-v2.5-pro", 32768),
    ("mimo-v2.5", 32768),
    ("mimo-v2.5-free", 32768),
    ("mimo-v2-omni", 32768),
    ("mimo-v2-pro", 32768),
)
PLUGIN_PRICES = (
    ("mimo-v2.5", 0.14),
    ("mimo-v2", 0.14),
    ("mimo-v2-omni", 0.14),
    ("qwen-turbo", 0.30),
    ("deepseek-v4-flash", 0.27),
    ("deepseek-v4-flash-free", 0.0),
    ("glm-4-flash", 0.0),
    ("mimo-v2.5-pro", 1.00),
    ("mimo-v2-pro", 1.00),
    ("deepseek-v4-pro", 0.50),
    ("qwen-plus", 0.80),
    ("gpt-4o-mini", 0.15),
    ("gpt-4o", 2.50),
    ("claude-sonnet-4-20250514", 3.00),
    ("claude-3-5-sonnet", 3.00),
)
CHEAP = ("flash", "mini", "turbo", "lite", "haiku", "small", "compress")
PROVIDERS = (("mimo", "mimo"), ("xiaomimimo", "mimo"), ("deepseek", "deepseek"), ("qwen", "qwen"), ("dashscope", "qwen"), ("openai", "openai"), ("anthropic", "anthropic"))


def values_sql(rows, columns: str, ranked: bool = False) -> str:
    """A table of literals in SQL, with the row's place as ``pos`` if ``ranked``."""

    def lit(x) -> str:
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else f"CAST({x!r} AS DOUBLE)" if isinstance(x, float) else f"CAST({x} AS BIGINT)"

    body = ", ".join("(" + ", ".join(lit(x) for x in ((*r, i) if ranked else r)) + ")" for i, r in enumerate(rows))
    return f"SELECT * FROM (VALUES {body}) AS t({columns}{', pos' if ranked else ''})"


ROUTES_SQL = values_sql(ROUTES, "pattern, main_in, main_out, cheap, cheap_in, cheap_out, max_context", True)
PROFILES_SQL = values_sql(PROFILES, "name, price_in, price_out, price_cache, price_write", True)
ALIASES_SQL = values_sql(ALIASES, "alias, name")
HINTS_SQL = values_sql(HINTS, "id, price_in, price_out, max_context")
CONTEXTS_SQL = values_sql(CONTEXTS, "id, context")
PLUGIN_PRICES_SQL = values_sql(PLUGIN_PRICES, "id, price_in")


def table(spark: SparkSession, sql: str) -> DataFrame:
    return spark.sql(sql)
