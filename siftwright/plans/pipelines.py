"""Composite pipelines over message tables. One shuffle by conversation serves the grouped steps of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules, signals, tokens
from ..operators import cases, costs, dedup, groups, lookups, pack, prompts, recall
from ..sources.scratch import materialise
from . import dims


def clean_by_signal(messages: DataFrame) -> DataFrame:
    """Messages of their signal segments only, joined by spaces; those without any stay as they are."""
    return messages.withColumn("content", rules.signal_text(F.col("content")))


def _again(messages: DataFrame) -> DataFrame:
    """(conv_id, again): the turns of each conversation whose instruction a later one repeats."""
    return groups.repeated_instructions(messages).groupBy("conv_id").agg(F.collect_set("turn").alias("again"))


def _reduced(role: Column, c: Column, again: Column) -> Column:
    """An old message by its role: lines worth keeping, without metadata, a summary of a repeated instruction, or its signal."""
    return (
        F.when(~rules.not_blank(c), c)
        .when(role == "assistant", rules.reduce_assistant(c))
        .when(role == "tool", rules.reduce_tool(c))
        .when((role == "user") & again, rules.summarise_instruction(c))
        .when(role == "user", rules.signal_text(c))
        .otherwise(c)
    )


def compress_history(messages: DataFrame, keep: int = 3) -> DataFrame:
    """Old messages reduced by role, the last ``keep`` of each conversation whole; repeated instructions summarised.

    Old messages of other roles stay. Conversations of at most ``keep`` messages stay whole.
    """
    old = groups.split_recent(messages, keep)
    m = groups.beside(old, _again(old.where("NOT recent")), how="left")
    again = F.coalesce(F.array_contains("again", F.col("turn")), F.lit(False))
    return m.withColumn("content", F.when(F.col("recent"), F.col("content")).otherwise(_reduced(F.col("role"), F.col("content"), again))).drop("again", "recent")


def rule_compress(messages: DataFrame, echoes: bool = False, least: float = 0.30) -> DataFrame:
    """Rule compression: tool replies cleaned, user and assistant text reduced to signal, old turns reduced.

    System messages stay. Where less than ``least`` of a conversation would be left, its original comes back. One shuffle
    by conversation carries all of it but the comparison of instructions, which joins on the same key.
    """
    c, role = F.col("content"), F.col("role")
    clean = F.when(role == "system", c).when(role == "tool", rules.clean_tool(c)).otherwise(rules.signal_text(c))
    by = Window.partitionBy("conv_id")
    m = messages.select("conv_id", "turn", "role", "content").withColumn("_n", F.count("*").over(by))
    m = m.withColumn("_old", (F.col("_n") > 4) & (F.row_number().over(by.orderBy(F.col("turn").desc())) > 3))
    # (what is cleaned has only characters of what it was, so only these messages can have an instruction)
    old = m.where(F.col("_old") & groups.may_instruct(role, c)).select("conv_id", "turn", "role", clean.alias("content"))
    m = groups.beside(m, _again(old), how="left").withColumn("_clean", clean)
    again = F.coalesce(F.array_contains("again", F.col("turn")), F.lit(False))
    m = m.withColumn("_new", F.when(F.col("_old"), _reduced(role, F.col("_clean"), again)).otherwise(F.col("_clean")))
    if echoes:
        first = F.min_by("_new", F.when(role == "system", F.col("turn"))).over(by)
        m = m.withColumn("_new", F.when(~groups.is_echo(role, F.col("_new"), first), F.col("_new")))
    said = rules.not_blank(c)
    before = F.sum(F.when(said, tokens.len3(c)).otherwise(0)).over(by)
    after = F.sum(F.coalesce(tokens.len3(F.col("_new")), F.lit(0))).over(by)
    talk = F.bool_or(role.isin("user", "assistant") & said).over(by)
    m = m.withColumn("_back", talk & (after / F.greatest(F.lit(1), before) < least))
    return m.where("_back OR _new IS NOT NULL").select("conv_id", "turn", "role", F.when(F.col("_back"), c).otherwise(F.col("_new")).alias("content"))


def token_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per conversation the segment estimate before and after."""
    t = lambda m, n: m.groupBy("conv_id").agg(F.sum(F.when(rules.not_blank(F.col("content")), tokens.len3(F.col("content"))).otherwise(0)).alias(n))
    return groups.beside(t(before, "original_tokens"), t(after, "rule_tokens"))


def _kinds(texts: DataFrame, text: str) -> DataFrame:
    """Whether a text is code or dense in facts, or so short and full of facts that it stays at its ``_ratio``."""
    t, lines = F.col(text), F.split(text, "\n")
    code = (F.size(lines) > 3) & (F.size(F.filter(lines, signals.looks_like_code)) / F.size(lines) > 0.4)
    x = texts.withColumns({"_code": code, "_dense": signals.is_fact_dense(t)})
    facts = F.col("_dense") | (signals.count(t, signals.NUMBER) >= 6) | (signals.count(t, signals.IDENTIFIER) >= 1)
    return x.withColumn("_same", ~F.col("_code") & (F.length(t) < 1200) & (F.col("_ratio") >= 0.90) & facts)


def _packed(m: DataFrame) -> DataFrame:
    """The content of each row within its ratio of it; what stays whole gets its own length."""
    c, n = F.col("content"), F.length("content")
    facts = (F.col("_dense") & ~F.col("_code")) | signals.is_fact_dense(c)
    target = F.when(F.col("_same"), n).otherwise(F.greatest(F.lit(1), F.floor(n * F.col("_ratio"))))
    done = pack.packed(m, "content", "content", target, facts)
    return done.withColumn("keep_ratio", F.when(F.col("_same"), 1.0).otherwise(F.col("_ratio")))


def adaptive_compress(messages: DataFrame, ratio: Column | float = 0.5) -> DataFrame:
    """Each message packed into ``ratio`` of its length; code and fact-dense conversations skip the rules, short facts stay whole."""
    ratio = F.lit(ratio) if isinstance(ratio, float) else ratio
    m = messages.select("conv_id", "turn", "role", "content", ratio.alias("_ratio"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("content", F.lit("")).alias("c")))), lambda x: x["c"]), "\n")
    flags = _kinds(m.groupBy("conv_id").agg(whole.alias("t"), F.any_value("_ratio").alias("_ratio")), "t").select("conv_id", "_code", "_dense", "_same")
    # written once each: the rules and the packing read them more than once
    m = materialise(groups.beside(m, flags), "flagged")
    ruled = rule_compress(m.where("NOT _code AND NOT _dense AND NOT _same").select("conv_id", "turn", "role", "content"))
    m = groups.beside(m, ruled.select("conv_id", "turn", F.col("content").alias("_new")), ["conv_id", "turn"], "left").withColumn("content", F.coalesce("_new", "content")).drop("_new")
    return _packed(m).select("conv_id", "turn", "role", "content", "keep_ratio")


def _ruled(c: Column, least: float = 0.30) -> Column:
    """Rule compression of a conversation that is one user message: nothing old, no other message to weigh it with."""
    return rules.let(rules.signal_text(c), lambda new: F.when(rules.not_blank(c) & (tokens.len3(new) / tokens.len3(c) < least), c).otherwise(new))


def compress_text(texts: DataFrame, key: str, text: str, mode: str = "balanced", budget: int | None = None) -> DataFrame:
    """The public text call: type, ratio, compression and quality of each text.

    What :func:`adaptive_compress` does to a conversation of that one message, row by row: nothing is grouped or joined.
    """
    t, c = F.col("_text"), F.col("compressed")
    m = texts.select(F.col(key).alias("_id"), F.col(text).alias("_text")).withColumn("_whole", F.coalesce(t, F.lit("")))
    m = _kinds(m.withColumn("_ratio", tokens.keep_ratio(F.lit(mode), F.lit(budget).cast("double"), tokens.api(t))), "_whole").drop("_whole")
    m = m.withColumn("content", F.when(F.col("_code") | F.col("_dense") | F.col("_same"), t).otherwise(_ruled(t)))
    x = _packed(m).withColumnRenamed("content", "compressed")
    # worked out once each, then weighed
    found = {k: (f"_{k}", v) for k, v in signals.recalls(t, c).items()}
    x = x.withColumns(dict(found.values()) | {"_kind": signals.content_type(t)})
    kind, scores = F.col("_kind"), signals.verdict({k: F.col(v) for k, (v, _) in found.items()})
    return x.select(
        F.col("_id").alias(key), "compressed", tokens.api(t).alias("original_tokens"), tokens.api(c).alias("compressed_tokens"), "keep_ratio", kind.alias("content_type"),
        tokens.risk_warnings(F.lit(mode), kind, F.array().cast("array<string>")).alias("warnings"), *(v.alias(k) for k, v in scores.items()),
    )


def protected_spans(messages: DataFrame, limit: int = 64) -> DataFrame:
    """Spans of each conversation that must survive, kind by kind: (conv_id, place, kind, value, occurrences)."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "content"))), lambda x: x["content"]), "\n")
    g = messages.where("content IS NOT NULL").groupBy("conv_id").agg(text.alias("t"))

    def of_kind(kind: str) -> Column:
        return F.transform(signals.matches(F.col("t"), kind), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    spans = F.concat(*map(of_kind, signals.SPAN_ORDER))
    x = g.select("conv_id", F.lower("t").alias("low"), F.posexplode(F.slice(spans, 1, limit)).alias("place", "s"))
    v = F.lower("s.value")
    n = (F.length("low") - F.length(F.replace(F.col("low"), v, F.lit("")))) / F.length(v)
    return x.select("conv_id", "place", "s.kind", "s.value", F.greatest(F.lit(1), n).cast("long").alias("occurrences"))


def span_prompt(spans: DataFrame) -> DataFrame:
    lines = F.transform(F.array_sort(F.collect_list(F.struct("place", F.format_string("- [%s] %s", "kind", "value").alias("l")))), lambda x: x["l"])
    return spans.groupBy("conv_id").agg(F.concat(F.lit("PROTECTED_SPANS:\n"), F.array_join(lines, "\n")).alias("prompt"))


def fidelity(original: DataFrame, reduced: DataFrame) -> DataFrame:
    """Weighted share of each conversation's signals that its reduced text still has, with the threshold it must reach."""
    text = lambda n: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "content"))), lambda x: x["content"]), "\n").alias(n)
    a = groups.beside(original.groupBy("conv_id").agg(text("t")), groups.latest_keywords(original))
    x = groups.beside(groups.beside(a, reduced.groupBy("conv_id").agg(text("r")), how="left"), groups.risk_policy(original).select("conv_id", "policy"))
    low = F.lower(F.coalesce("r", F.lit("")))
    # found once each, then counted
    x = x.withColumns({"low": low} | {f"_{k}": signals.matches(F.col("t"), k) for k in signals.SIGNALS} | {"_latest_user_keywords": F.col("keywords")})
    score, weight, hard = F.lit(0.0), F.lit(0.0), F.lit(0)
    for k, w in signals.WEIGHTS.items():
        values = F.col(f"_{k}")
        n, kept = F.size(values), F.size(F.filter(values, lambda v: F.contains(F.col("low"), F.lower(v))))
        cover = F.least(F.lit(1.0), kept / F.greatest(F.lit(1), F.least(F.lit(3), n))) if k == "latest_user_keywords" else kept / n
        score = score + F.when(n > 0, F.coalesce(F.try_divide(kept, n) if k != "latest_user_keywords" else cover, F.lit(0.0)) * w).otherwise(0.0)
        weight = weight + F.when(n > 0, w).otherwise(0.0)
        if k in ("numbers", "paths", "urls", "emails", "code_symbols"):
            hard = hard + n
    total = F.when(weight > 0, score / F.when(weight > 0, weight)).otherwise(1.0)
    threshold = F.when(F.col("policy") == "protected", 0.88).when(hard == 0, 0.55).otherwise(0.78)
    return x.select("conv_id", F.round(total, 4).alias("score"), threshold.alias("threshold"), (total >= threshold).alias("passed"), hard.cast("long").alias("hard_signals"))


def shadow(messages: DataFrame, model: str, least_tokens: int = 0, ruled: DataFrame | None = None, learned: DataFrame | None = None) -> DataFrame:
    """What smart compression would do and save, per conversation, without doing it.

    ``ruled`` are the rule-compressed messages, made here by default; ``learned`` has (cheap, avg_ratio, blocked).
    """
    ruled = rule_compress(messages) if ruled is None else ruled
    t = groups.beside(token_change(messages, ruled), groups.risk_policy(ruled)).withColumn("model", F.lit(model))
    t = lookups.find_route(t).withColumn("pos", F.lit(0))
    if learned is not None:
        t = t.join(F.broadcast(learned), "cheap", "left").withColumn("blocked", F.coalesce("blocked", F.lit(False)))
    rows = t.withColumnsRenamed({"conv_id": "id", "target_ratio": "ratio"}).withColumn("protected", F.col("policy") == "protected")
    best = lookups.select_candidate(rows.where(F.col("cheap").isNotNull() & (F.col("rule_tokens") >= least_tokens)))
    x = groups.beside(rows, best, "id", "left")
    out = F.floor(F.col("original_tokens") * tokens.OUTPUT_RATIO)
    raw = tokens.call_cost(F.col("original_tokens"), out, F.col("main_in"), F.col("main_out"))
    rule = tokens.call_cost(F.col("rule_tokens"), F.floor(F.col("rule_tokens") * tokens.OUTPUT_RATIO), F.col("main_in"), F.col("main_out"))
    reason = F.when(F.col("cheap").isNull(), "missing_route").when(F.col("rule_tokens") < least_tokens, "short_input_profit_guard").when(F.col("rule_tokens") > F.col("max_context"), "context_guard")
    if learned is not None:
        reason = reason.when(F.col("blocked"), "circuit_breaker")
    reason = reason.when(F.col("candidate").isNull(), "profit_guard")
    return x.select(
        F.col("id").alias("conv_id"), "original_tokens", "rule_tokens", "policy", F.col("ratio").alias("target_ratio"), F.round(raw, 8).alias("raw_cost"), F.round(rule, 8).alias("rule_cost"),
        F.col("candidate").isNotNull().alias("would_call_smart"), reason.alias("fallback_reason"), "candidate", "smart_tokens", F.round("savings_pct", 2).alias("savings_pct"),
    )


def rollout_gate(telemetry: DataFrame, mode: str = "auto", least_savings: float = 20.0, allow_protected: bool = True, most_spans: int = 64) -> DataFrame:
    """Whether smart compression is on for each conversation, and why."""
    reason = (
        F.when(F.lit(mode) == "off", "rollout_mode_off").when(F.lit(mode) == "shadow", "rollout_mode_shadow").when(F.lit(mode) == "on", "rollout_mode_on")
        .when(~F.col("would_call_smart"), F.coalesce("fallback_reason", F.lit("shadow_not_profitable")))
        .when(F.col("savings_pct").isNull() | (F.col("savings_pct") < least_savings), "estimated_savings_below_threshold")
        .when(F.lit(not allow_protected) & (F.col("policy") == "protected"), "protected_policy_disabled")
        .when(F.coalesce("protected_span_count", F.lit(0)) > most_spans, "too_many_protected_spans").otherwise("auto_gate_passed")
    )
    return telemetry.withColumn("reason", reason).withColumn("enabled", F.col("reason").isin("rollout_mode_on", "auto_gate_passed"))


def parse_replies(replies: DataFrame, column: str = "reply") -> DataFrame:
    """Compressor replies (JSON, maybe fenced) as messages: (conv_id, turn, role, content); unusable ones give no rows."""
    cut = F.regexp_replace(F.regexp_replace(rules.strip(F.col(column)), "^```(?:json)?", ""), "```$", "")
    items = F.from_json(rules.strip(cut), "array<struct<role:string,content:string>>")
    ok = (F.size(items) > 0) & F.forall(items, lambda x: x["role"].isNotNull() & x["content"].isNotNull())
    return replies.select("conv_id", F.posexplode(F.when(ok, items)).alias("turn", "m")).select("conv_id", F.col("turn").cast("long").alias("turn"), "m.*")


#: Mode of a conversation that smart compression leaves to the rules, by the shadow evaluation's reason.
FALLBACKS = {
    "missing_route": "rule_only", "short_input_profit_guard": "rule_only_profit_guard", "context_guard": "rule_only_context_guard",
    "circuit_breaker": "rule_only_self_repair", "profit_guard": "rule_only_profit_guard",
}


def smart_modes(messages: DataFrame, got: DataFrame, plan: DataFrame, model: str, margin: float = 0.05) -> DataFrame:
    """(conv_id, mode, final_tokens): ``smart`` where the plan calls for it and the parsed reply ``got`` is valid, keeps the facts and pays.

    A reply that is missing, longer than the original, or without its system or a user message falls back; so does one
    under the fidelity threshold, and one whose real size saves less than ``margin``.
    """
    x = plan.select("conv_id", "rule_tokens", "would_call_smart", "fallback_reason").withColumn("model", F.lit(model))
    x = groups.beside(lookups.find_route(x), groups.valid_reductions(messages, got).select("conv_id", "valid"), how="left")
    x = groups.beside(x, fidelity(messages, got).select("conv_id", "passed"), how="left")
    x = groups.beside(x, groups.conv_tokens(got).select("conv_id", F.col("tokens").alias("final_tokens")), how="left")
    profit = tokens.route_profit(*(F.col(c) for c in ("rule_tokens", "final_tokens", "main_in", "main_out", "cheap_in", "cheap_out")))
    pays = profit["profitable"] & (profit["savings_pct"] >= margin * 100)
    named = F.lit(None).cast("string")
    for reason, mode in FALLBACKS.items():
        named = F.when(F.col("fallback_reason") == reason, mode).otherwise(named)
    mode = (
        F.when(~F.col("would_call_smart"), named).when(~F.coalesce("valid", F.lit(False)), "rule_only_fallback")
        .when(~F.coalesce("passed", F.lit(False)), "rule_only_fidelity_guard").when(~F.coalesce(pays, F.lit(False)), "rule_only_profit_guard").otherwise("smart")
    )
    return x.select("conv_id", mode.alias("mode"), F.when(mode == "smart", F.col("final_tokens")).alias("final_tokens"))


def smart_compress(messages: DataFrame, replies: DataFrame, model: str, least_tokens: int = 0, learned: DataFrame | None = None) -> DataFrame:
    """Messages after smart compression, given the compressor's replies: the reply where every guard lets it through, else the rules' result.

    Each message has its conversation's ``mode``. The rules' result and the modes are written once and read again.
    """
    ruled = materialise(rule_compress(messages), "ruled")
    plan = materialise(shadow(messages, model, least_tokens, ruled, learned), "plan")
    got = materialise(parse_replies(groups.beside(replies, plan.where("would_call_smart").select("conv_id"), how="left_semi")), "replies")
    modes = materialise(smart_modes(messages, got, plan, model), "modes").select("conv_id", "mode")
    return groups.beside(got, modes.where("mode = 'smart'")).unionByName(groups.beside(ruled, modes.where("mode <> 'smart'"))).select("conv_id", "turn", "role", "content", "mode")


def production(messages: DataFrame, model: str, replies: DataFrame | None = None, rollout: str = "auto") -> DataFrame:
    """The production call without its network part: attributes cleaned, gate, smart compression where it is on, else the rules; recall
    markers, cache order, prefix hash, savings.

    ``replies`` are the compressor's (none: every conversation falls back to the rules). Only conversations with the
    gate open store originals and get markers.
    """
    m = prompts.clean_attributes(messages)
    ruled = materialise(rule_compress(m), "ruled")
    plan = materialise(shadow(m, model, ruled=ruled), "plan")
    spans = protected_spans(m).groupBy("conv_id").agg(F.count("*").alias("protected_span_count"))
    gate = materialise(rollout_gate(groups.beside(plan, spans, how="left"), rollout).select("conv_id", "enabled", "reason"), "gate")
    asked = gate.where("enabled").select("conv_id")
    if replies is None:
        replies = asked.withColumn("reply", F.lit(None).cast("string")).where("false")
    got = materialise(parse_replies(groups.beside(replies, asked, how="left_semi")), "replies")
    modes = smart_modes(m, got, plan, model).select("conv_id", F.col("mode").alias("smart_mode"))
    gate = materialise(groups.beside(gate, modes).select("conv_id", "enabled", "reason", F.when(F.col("enabled"), F.col("smart_mode")).otherwise("rule_only").alias("mode")), "modes")

    of = lambda m_, cond: groups.beside(m_, gate.where(cond).select("conv_id"), how="left_semi")
    done = of(got, "mode = 'smart'").unionByName(of(ruled, "mode <> 'smart'"))
    originals = groups.beside(m.where(F.length("content") > 50), asked, how="left_semi").select("conv_id", F.col("turn").alias("pos"), F.col("content").alias("original"))
    placed = prompts.reorder(recall.annotate(done, originals).drop("hash_key")).select("conv_id", F.col("place").cast("long").alias("turn"), "role", "content")
    placed = materialise(placed, "placed")
    before, after = (groups.conv_tokens(x).select("conv_id", F.col("tokens").alias(n)) for x, n in ((messages, "original_tokens"), (placed, "optimized_tokens")))
    saved = F.round((F.col("original_tokens") - F.col("optimized_tokens")) / F.col("original_tokens") * 100, 2)
    facts = groups.beside(groups.beside(groups.beside(gate, prompts.prefix_hash(placed).select("conv_id", "prefix_hash")), before), after).withColumn("saved_pct", saved)
    return groups.beside(placed, facts)


def classic_call(messages: DataFrame, replies: DataFrame, model: str) -> tuple[DataFrame, DataFrame]:
    """The plain client call without its network part: the messages it sends, in cache order, and its rows for the request log.

    ``replies`` has (conv_id, reply), the model's JSON. A log row has event_id (the conversation), prefix, model, tokens and
    cached_tokens (those of the reply's usage, else 0); a conversation without a reply has none.
    """
    sent = materialise(prompts.reorder(rule_compress(prompts.clean_attributes(messages))).select("conv_id", F.col("place").cast("long").alias("turn"), "role", "content"), "sent")
    cached = F.coalesce(F.get_json_object("reply", "$.usage.prompt_tokens_details.cached_tokens").try_cast("long"), F.lit(0))
    usage = costs.reply_usage(replies.withColumn("cached_tokens", cached))
    log = prompts.prefix_hash(sent).join(usage, "conv_id").join(groups.conv_tokens(sent).select("conv_id", "tokens"), "conv_id")
    return sent, log.select(
        F.col("conv_id").alias("event_id"), F.col("prefix_hash").alias("prefix"), F.lit(model).alias("model"), F.when(F.col("prompt_tokens") > 0, F.col("prompt_tokens")).otherwise(F.col("tokens")).alias("input_tokens"),
        F.col("completion_tokens").alias("output_tokens"), "cached_tokens",
    )


def plugin_compress(messages: DataFrame, model: str, least: int = 1000, keep: int = 4, price: float | None = 0.10, smart_models: tuple[str, ...] = (), least_llm: int = 1500, cached: DataFrame | None = None) -> DataFrame:
    """Per conversation what the plugin's cascade does: why it skips, or its mode, with token counts before and after its rules."""
    m = groups.split_recent(messages, keep, skip_system=True).withColumn("old", (F.col("role") != "system") & ~F.col("recent"))
    c = F.coalesce("content", F.lit(""))
    t, r = tokens.plugin(c) + 4, tokens.plugin(rules.plugin_rules(c)) + 4
    g = m.groupBy("conv_id").agg(
        F.sum(t).alias("input_tokens"), F.sum(F.when(F.col("old"), r).otherwise(0)).alias("after_rule"), F.sum(F.when(F.col("old"), r).otherwise(t)).alias("rule_output"),
        F.count_if(F.col("role") != "system").alias("turns"), F.count_if("old").alias("old_messages"),
    )
    g = lookups.context_tier(g.withColumn("model", F.lit(model)))
    keys = recall.cache_key(m.where("old"), "")
    g = g.join(keys, "conv_id", "left")
    hit = F.lit(False)
    if cached is not None:
        g = g.join(cached.select("cache_key", F.lit(True).alias("_hit")).distinct(), "cache_key", "left")
        hit = F.coalesce("_hit", F.lit(False))
    saved = F.floor(F.col("after_rule") * (1 - F.col("context_ratio"))) / 1e6
    cost = F.col("after_rule") / 1e6 * (price or 0.0) + F.floor(F.col("after_rule") * F.col("context_ratio")) / 1e6 * (price or 0.0) * 2
    mode = (
        F.when(F.col("input_tokens") < least, "skip_below_threshold").when(F.col("turns") <= keep, "skip_too_few_turns").when(hit, "rule+cheap_model_cached")
        .when(F.lit(price is None), "rule_only").when(cost >= saved, "rule_only_unprofitable")
        .when(F.lit(bool(smart_models) and bool(model) and model not in smart_models), "rule_only_not_whitelisted").when(F.col("after_rule") < least_llm, "rule_only_short").otherwise("rule+bg_pending")
    )
    skipped = F.col("mode").startswith("skip")
    return g.withColumn("mode", mode).select(
        "conv_id", "input_tokens", "mode", "context_label", F.when(~skipped, F.col("after_rule")).alias("after_rule_tokens"), F.when(~skipped, F.col("rule_output")).otherwise(F.col("input_tokens")).alias("output_tokens")
    )


def _joined_text(name: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "content"))), lambda x: x["content"]), "\n").alias(name)


def benchmark(cases_: DataFrame, threshold: float = 0.7, ratio: float | None = None) -> DataFrame:
    """Reduced text of each case (id, messages): near duplicates out, ratio by profile, adaptive compression.

    With ``ratio`` every case is packed into that share, without a look at its profile or duplicates. The original text
    comes along.
    """
    ids = cases_.select("id").withColumn("conv_id", F.xxhash64("id"))
    whole = cases_.select(F.xxhash64("id").alias("conv_id"), F.posexplode("messages").alias("turn", "m")).select("conv_id", F.col("turn").cast("long").alias("turn"), "m.role", "m.content")
    if ratio is None:
        m = materialise(dedup.near_dedup(whole, threshold).drop("ref"), "deduplicated")
        plan = groups.ratio_policy(groups.content_profile(m)).select("conv_id", F.col("keep_ratio").alias("_k"), "method")
    else:
        m = whole
        plan = ids.select("conv_id", F.lit(ratio).alias("_k"), F.lit("fixed").alias("method"))
    out = materialise(adaptive_compress(groups.beside(m, plan.drop("method")), F.col("_k")), "packed")
    texts = groups.beside(out.groupBy("conv_id").agg(_joined_text("text")), whole.groupBy("conv_id").agg(_joined_text("original")))
    return groups.beside(groups.beside(texts, ids), plan).select("id", "text", "original", F.col("_k").alias("keep_ratio"), "method")


def benchmark_quality(cases_: DataFrame, ratio: float | None = None) -> DataFrame:
    """Per case the answers kept and one blended score: answers .35, entities .30, numbers .20, structure .15."""
    out = benchmark(cases_, ratio=ratio)
    checked = cases.checked(groups.beside(cases.assertions(cases_), out.select("id", "text"), "id"))
    qa = cases.case_results(checked.select("id", "found", "miss")).select("id", "qa_passed", "qa_total", F.coalesce(F.try_divide("qa_passed", "qa_total"), F.lit(1.0)).alias("qa"))
    e = signals.evaluate(F.col("original"), F.col("text"))
    x = groups.beside(out, qa, "id").withColumns({k: e[k] for k in ("entity_recall", "number_precision", "structural_preservation")})
    return x.select("id", "keep_ratio", "method", "qa_passed", "qa_total", F.round(cases.blended_quality("qa", "entity_recall", "number_precision", "structural_preservation"), 4).alias("quality"))
