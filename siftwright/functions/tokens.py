"""Token estimators and cost arithmetic. The estimators differ on purpose; they aren't interchangeable."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PER_MILLION = 1_000_000
OUTPUT_RATIO = 0.20
#: Share of the text kept by mode.
KEEP = {"safe": 0.95, "balanced": 0.75, "aggressive": 0.50}
RISKY_PRESERVE = ["numbers", "dates", "negations", "identifiers", "latest_values"]
RISKY_CONTENT = ["code", "json", "financial", "legal", "medical", "memory"]

_CJK = "一-鿿㐀-䶿"
_CJK_WIDE = "一-鿿　-〿＀-￯"


def _without(text: Column, chars: str) -> Column:
    return F.regexp_replace(text, f"[{chars}]+", "")


def len3(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 3)).cast("long")


def multilingual(text: Column) -> Column:
    """ASCII / 4 + CJK / 1.7 + others / 2.5, cut, at least 1; 0 for empty text."""
    n = F.length(text)
    ascii_ = n - F.length(_without(text, r"\x00-\x7f"))
    cjk = n - F.length(_without(text, _CJK))
    tokens = F.floor(ascii_ / 4.0 + cjk / 1.7 + (n - ascii_ - cjk) / 2.5)
    return F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), tokens)).cast("long")


def api(text: Column) -> Column:
    """A quarter of the characters, rounded half to even, at least 1; 0 for empty text."""
    n = F.length(text)
    return F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.bround(n / 4))).cast("long")


def profile(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long")


def plugin(text: Column) -> Column:
    """CJK characters * 1.8 + other words * 1.3, up to 40 % more for braces and backticks; 0 for empty text."""
    rest = _without(text, _CJK_WIDE)
    cjk = F.length(text) - F.length(rest)
    words = F.size(F.array_remove(F.split(rest, r"(?U)\s+"), ""))
    marks = F.length(rest) - F.length(F.translate(rest, "{`", ""))
    boost = 1.0 + F.least(marks * 0.05, F.lit(0.4))
    return F.when(F.length(text) == 0, F.lit(0)).otherwise(F.floor((cjk * 1.8 + words * 1.3) * boost)).cast("long")


def call_cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    return tokens_in / PER_MILLION * price_in + tokens_out / PER_MILLION * price_out


def route_profit(rule: Column, smart: Column, main_in: Column, main_out: Column, cheap_in: Column, cheap_out: Column) -> dict[str, Column]:
    """Cost of rule compression alone against a cheap compressor before the main model, per call."""
    rule_cost = call_cost(rule, F.floor(rule * OUTPUT_RATIO), main_in, main_out)
    compressor = call_cost(rule, smart, cheap_in, cheap_out)
    after = call_cost(smart, F.floor(smart * OUTPUT_RATIO), main_in, main_out)
    savings = rule_cost - (compressor + after)
    return {
        "rule_cost": rule_cost,
        "compressor_cost": compressor,
        "main_after_cost": after,
        "smart_total_cost": compressor + after,
        "savings": savings,
        "savings_pct": F.when(rule_cost > 0, savings / rule_cost * 100).otherwise(0.0),
        "profitable": savings > 0,
    }


def keep_ratio(mode: Column, budget: Column, tokens: Column) -> Column:
    """The mode's share, or less if a budget asks for it. An unknown mode or a budget of 0 or less raises."""
    base = F.lit(None).cast("double")
    for m, r in KEEP.items():
        base = F.when(mode == m, F.lit(r)).otherwise(base)
    base = F.when(base.isNull(), F.raise_error(F.lit("mode must be one of: safe, balanced, aggressive"))).otherwise(base)
    asked = F.when(budget <= 0, F.raise_error(F.lit("budget_tokens must be positive"))).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.05), F.try_divide(budget, tokens))))
    return F.when(budget.isNotNull() & (tokens > 0), F.least(base, asked)).otherwise(base)


def risk_warnings(mode: Column, content_type: Column, preserve: Column) -> Column:
    risky = F.arrays_overlap(F.transform(preserve, lambda x: F.lower(x)), F.array(*map(F.lit, RISKY_PRESERVE)))
    return F.array_compact(
        F.array(
            F.when((mode == "aggressive") & (risky | content_type.isin(RISKY_CONTENT)), F.lit("aggressive mode used with high-risk preservation requirements")),
            F.when((mode != "safe") & risky, F.lit("safe mode is recommended when preserving critical facts")),
        )
    )


def cache_savings(tokens: Column, price_in: Column, price_cache: Column, price_write: Column) -> dict[str, Column]:
    raw, cached = tokens / PER_MILLION * price_in, tokens / PER_MILLION * price_cache
    return {
        "raw_cost": raw,
        "cached_cost": cached,
        "savings": raw - cached,
        "savings_pct": F.when(raw > 0, (raw - cached) / raw * 100).otherwise(0.0),
        "write_cost": tokens / PER_MILLION * price_write,
    }


def token_split(system: Column, tools: Column, history: Column, user: Column, output: Column) -> dict[str, Column]:
    reasoning = F.floor(output * 0.3).cast("long")
    return {"input_tokens": system + tools + history + user, "reasoning_tokens": reasoning, "actual_output_tokens": output - reasoning}
