"""Composite pipelines and operators without SQL, against results worked out by hand or by an independent statement of the rules."""

import csv
import datetime
import io
import json
import random
import re
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from siftwright import queries
from siftwright.functions import rules, signals
from siftwright.operators import costs, groups, jsonx, lookups, recall
from siftwright.plans import config, pipelines
from siftwright.sources import tables
from siftwright.streaming import streams

MESSAGE = "conv_id long, turn long, role string, content string"


@pytest.fixture(scope="module")
def chats(spark, tmp_path_factory):
    """The chats of three orders, as rows."""
    path = str(tmp_path_factory.mktemp("orders"))
    orders = "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate date, o_orderstatus string, o_orderpriority string"
    spark.createDataFrame([(k, 5 + k, 99.5 * k, datetime.date(2026, 1, k), "O", "1-URGENT") for k in (2, 3, 4)], orders).write.parquet(f"{path}/orders.parquet")
    return path, tables.chat(spark, path)


def test_chat_views_agree(spark, chats):
    path, chat = chats
    spark.read.parquet(f"{path}/orders.parquet").createOrReplaceTempView("orders")
    assert sorted(map(tuple, spark.sql(tables.CHAT).collect())) == sorted(map(tuple, chat.collect()))


def test_segments_in_order(spark):
    text = "<system>x</system>请帮我写一个报告！！\n\nHTTP/1.1 200 OK\nok, why not?"
    got = [(r.line, r.pos, r.text, r.reason) for r in groups.segments(spark.createDataFrame([(1, 0, "user", text), (2, 0, "user", " "), (3, 0, "user", None)], MESSAGE)).collect()]
    assert got == [
        (-1, 0, "<system>x</system>", "system_tag"), (0, 0, "写报告！", "cleaned_from_filler"), (0, 1, "请帮我一个！", "inline_filler"), (1, 0, "", "empty_line"),
        (2, 0, "HTTP/1.1 200 OK", "tool_metadata"), (3, 0, "ok", "filler_only"), (3, 2, "why not?", "question"),
    ]


def test_removed_text_of_long_fragments(spark):
    rnd = random.Random(4)
    rows = []
    for n in (0, 1, 63, 64, 65, 200, 700):
        old = "".join(rnd.choice("abcd ") for _ in range(n))
        rows.append((old, "".join(c for c in old if rnd.random() < 0.6)))
    for r, (old, new) in zip(spark.createDataFrame(rows, "o string, n string").select(rules.removed_text(F.col("o"), F.col("n"))).collect(), rows):
        at, out = 0, ""
        for c in old:
            if at < len(new) and new[at] == c:
                at += 1
            else:
                out += c
        assert r[0] == out.strip()


TALK = [
    ("system", "You help."), ("user", "请帮我写一个报告！！谢谢"), ("tool", 'HTTP/1.1 200 OK\n\n{"a": 1}\nlatency: 5 ms\n'), ("assistant", "ok\nTODO: check it"),
    ("user", "请帮我写一个报告！！"), ("assistant", "The order 7 is done"), ("user", "why not compare prices?"),
]


def test_rule_compress_by_hand(spark):
    rows = [(1, i, r, t) for i, (r, t) in enumerate(TALK)] + [(2, 0, "user", "谢谢谢谢谢谢谢谢谢谢谢谢谢谢谢谢，ok"), (2, 1, "assistant", None)]
    got = {(r.conv_id, r.turn): r.content for r in pipelines.rule_compress(spark.createDataFrame(rows, MESSAGE)).collect()}
    assert [got[1, i] for i in range(7)] == ["You help.", "写报告！", '{"a": 1}', "check it", "写报告！", "The order 7 is done", "why not compare prices?"]
    assert got[2, 0] == rows[7][3]  # without any signal a message stays
    assert pipelines.rule_compress(spark.createDataFrame([], MESSAGE)).collect() == []


def test_history_summarises_repeats(spark):
    again = "请帮我查询用户记录，删除旧的数据文件！"
    rows = [(1, 0, "user", again), (1, 1, "user", again), (1, 2, "assistant", "fine"), (1, 3, "user", "x"), (1, 4, "user", "y"), (1, 5, "user", "z")]
    got = {r.turn: r.content for r in pipelines.compress_history(spark.createDataFrame(rows, MESSAGE)).collect()}
    assert got[0] == rules_first(spark, again) and len(got[0]) <= 20 and got[1] != got[0] and [got[i] for i in (3, 4, 5)] == ["x", "y", "z"]


def rules_first(spark, text):
    return re.split("[。！!？?\n]", spark.range(1).select(rules.strip_fillers(F.lit(text))).first()[0])[0][:20].strip()


def test_repeats_are_found_without_all_pairs(spark):
    rnd = random.Random(2)
    parts = ["查询用户", "删除旧的数据", "写报告", "合并文件", "检查订单状态", "翻译文章"]
    keys = ["".join(rnd.sample(parts, rnd.randrange(1, 4)))[: rnd.randrange(4, 20)] for _ in range(60)]
    rows = [(i % 2, i, "user", k) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, MESSAGE)
    keyed = [tuple(r) for r in df.select("conv_id", "turn", rules.instruction_key(F.col("content"))).collect()]
    grams = lambda s: {s[i : i + 2] for i in range(len(s) - 1)}
    alike = lambda a, b: a in b or b in a or len(grams(a) & grams(b)) / len(grams(a) | grams(b)) > 0.6
    want = {(c, t) for c, t, k in keyed if k and any(c == c2 and t2 > t and k2 and alike(k, k2) for c2, t2, k2 in keyed)}
    assert {(r.conv_id, r.turn) for r in groups.repeated_instructions(df).collect()} == want and 0 < len(want) < len(rows)


FACTS = "Pay $1200 by 2026-01-02 to a@b.co, see https://x.example/z and /var/data/x.json, you must not delete it"


def test_smart_modes(spark):
    long = FACTS + " and so on" * 60
    talk = {k: [("system", "You help."), ("user", long)] for k in range(1, 8)}
    reply = {1: FACTS, 3: "nothing much", 4: FACTS + " and so on" * 58, 5: FACTS}
    messages = spark.createDataFrame([(k, i, r, t) for k, m in talk.items() for i, (r, t) in enumerate(m)], MESSAGE)
    got = spark.createDataFrame([(k, i, r, t) for k, x in reply.items() for i, (r, t) in enumerate([("system", "You help."), ("user", x)])], MESSAGE)
    why = {5: "context_guard", 6: "missing_route", 7: "circuit_breaker"}
    plan = spark.createDataFrame([(k, 150 if k == 4 else 230, k not in why, why.get(k)) for k in talk], "conv_id long, rule_tokens long, would_call_smart boolean, fallback_reason string")
    modes = {r.conv_id: r.mode for r in pipelines.smart_modes(messages, got, plan, "qwen-max").collect()}
    assert modes == {
        1: "smart", 2: "rule_only_fallback", 3: "rule_only_fidelity_guard", 4: "rule_only_profit_guard", 5: "rule_only_context_guard", 6: "rule_only", 7: "rule_only_self_repair",
    }
    # a reply that lost the system message, or grew, is not valid
    bad = spark.createDataFrame([(1, 0, "user", FACTS), (2, 0, "system", "You help."), (2, 1, "user", long + long)], MESSAGE)
    assert {r.conv_id: r.mode for r in pipelines.smart_modes(messages, bad, plan, "qwen-max").collect() if r.conv_id < 3} == {1: "rule_only_fallback", 2: "rule_only_fallback"}


def test_smart_compress_and_production(spark):
    long = FACTS + " and so on" * 200
    talk = [("system", "You help."), ("user", long)]
    messages = spark.createDataFrame([(k, i, r, t) for k in (1, 2) for i, (r, t) in enumerate(talk)], MESSAGE)
    replies = spark.createDataFrame([(1, "```json\n" + json.dumps([{"role": "system", "content": "You help."}, {"role": "user", "content": FACTS}]) + "\n```"), (2, "no list")], "conv_id long, reply string")
    got = {(r.conv_id, r.role): (r.content, r.mode) for r in pipelines.smart_compress(messages, replies, "qwen-max").collect()}
    assert got[1, "user"] == (FACTS, "smart") and got[2, "user"][1] == "rule_only_fallback" and got[2, "user"][0] != FACTS
    out = {(r.conv_id, r.role): r for r in pipelines.production(messages, "qwen-max", replies).collect()}
    assert out[1, "user"].mode == "smart" and out[1, "user"].enabled and FACTS in out[1, "user"].content and "[TO:retrieve hash=" in out[1, "user"].content
    assert out[2, "user"].mode == "rule_only_fallback" and out[1, "user"].saved_pct > 50 > out[2, "user"].saved_pct
    shut = {(r.conv_id, r.role): r for r in pipelines.production(messages, "qwen-max", replies, rollout="off").collect()}
    assert shut[1, "user"].mode == "rule_only" and shut[1, "user"].reason == "rollout_mode_off" and "[TO:" not in shut[1, "user"].content
    assert {r.mode for r in pipelines.production(messages, "qwen-max").collect()} == {"rule_only_fallback"}


def test_plugin_cascade(spark):
    def run(n, **kw):
        rows = [(1, i, "user" if i % 2 else "assistant", "word " * 50) for i in range(n)]
        return pipelines.plugin_compress(spark.createDataFrame(rows, MESSAGE), "deepseek-v4-pro", **kw).first().mode

    assert run(6, least=10_000) == "skip_below_threshold" and run(3, least=10) == "skip_too_few_turns" and run(9, least=10, price=None) == "rule_only"
    assert run(9, least=10, price=5.0) == "rule_only_unprofitable" and run(9, least=10, smart_models=("other",)) == "rule_only_not_whitelisted"
    assert run(9, least=10) == "rule_only_short" and run(9, least=10, least_llm=10) == "rule+bg_pending"
    rows = [(1, i, "user", "word " * 50) for i in range(9)]
    m = spark.createDataFrame(rows, MESSAGE)
    key = recall.cache_key(m.where("turn < 5"), "").select("cache_key")
    assert pipelines.plugin_compress(m, "deepseek-v4-pro", least=10, cached=key).first().mode == "rule+cheap_model_cached"


def _scores(text, weights, head, power, critical=()):
    t = text.strip()
    if not t:
        return 0.0
    s = sum(w * len(re.findall(p, t, re.I if p.startswith("(?i") else 0)) for p, w in weights) + head(t)
    return s / max(len(t) ** power, 1.0)


def test_density_and_fact_scores(spark, chats):
    flags = lambda p: ("(?i)" if p.startswith("(?i") else "") + re.sub(r"^\(\?[a-zA-Z]+\)", "", p)
    unit, number, pair, name = (flags(p) for p in (signals.FACT_UNIT, signals.NUMBER, signals.KEY_VALUE, signals.IDENTIFIER))
    dense = [(r"\b\d[\d,.]*\b", 3.0), (r"\d+[%％]", 2.0), (r"[$€¥£]\d", 2.0), (r"\b[A-Z][a-zA-Z]{2,}\b", 1.5), (r"\w+[:：=→]", 2.0), (unit, 5.0)]
    fact = [(unit, 10.0), (number, 5.0), (pair, 8.0), (name, 7.0), (signals.COMPARE, 4.0), (r"\b[A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*\b", 2.0), (r"\b[A-Z]{2,}\b", 2.0)]
    texts = [r.content for r in chats[1].collect()] + ["", "  ", "thanks!", "P99 latency: 250 ms => total budget $5,000 for 3 nodes"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", signals.density_score(F.col("t")).alias("d"), signals.fact_score(F.col("t")).alias("f")).collect()
    for r in got:
        marks = any(x in r.t for x in ("{", "}", "()", "=>", "->", "```"))
        ack = re.match(r"(?i)(?:ok|okay|sure|好的|收到|了解|noted|i see|got it|understood|i'm ready|ready|准备好了|thanks|thank you|谢谢)\s*[.!?。！？]?\s*$", r.t.strip())
        assert r.d == pytest.approx(_scores(r.t, dense, lambda t: 3.0 * marks - 5.0 * bool(ack) + min(len(t) / 50, 3.0), 0.3), abs=1e-9)  # noqa: B023
        assert r.f == pytest.approx(_scores(r.t, fact, lambda t: 4.0 * sum(w in t.lower() for w in signals.CRITICAL), 0.25), abs=1e-9)


def test_protected_spans_and_prompt(chats):
    spans = pipelines.protected_spans(chats[1])
    got = {}
    for r in spans.orderBy("conv_id", "place").collect():
        got.setdefault(r.conv_id, []).append((r.kind, r.value, r.occurrences))
    texts = {}
    for r in chats[1].orderBy("conv_id", "turn").collect():
        texts.setdefault(r.conv_id, []).append(r.content)
    for k, parts in texts.items():
        text, want = "\n".join(parts), []
        for kind in signals.SPAN_ORDER:
            seen = set()
            for m in re.finditer(signals.SIGNALS[kind], text, re.I):
                v = re.sub(f"^[{signals.PUNCTUATION}]+|[{signals.PUNCTUATION}]+$", "", m.group().strip()).strip()
                if v and v.lower() not in seen and len(seen) < 32:
                    seen.add(v.lower())
                    if kind != "constraints" or (v not in signals.GENERIC and len(v) > 2):
                        want.append((kind, v, max(1, text.lower().count(v.lower()))))
        assert got[k] == want[:64]
    prompts = {r.conv_id: r.prompt for r in pipelines.span_prompt(spans).collect()}
    assert prompts == {k: "PROTECTED_SPANS:\n" + "\n".join(f"- [{a}] {b}" for a, b, _ in v) for k, v in got.items()}


def test_fidelity_counts_what_is_left(spark):
    whole = spark.createDataFrame([(1, 0, "user", FACTS), (2, 0, "user", FACTS), (3, 0, "user", "hello there friend")], MESSAGE)
    cut = spark.createDataFrame([(1, 0, "user", FACTS), (2, 0, "user", "nothing")], MESSAGE)
    got = {r.conv_id: r for r in pipelines.fidelity(whole, cut).collect()}
    assert got[1].score == 1.0 and got[1].passed and got[2].score == 0.0 and not got[2].passed and got[1].hard_signals > 4 and got[3].threshold == 0.55 and not got[3].passed


def test_code_runs(spark):
    lines = ["import os", "x = 1", "some plain words here.", "def f():", "more plain words.", "more plain words."]
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "id long, pos int, line string")
    code = [r[0] for r in rows.orderBy("pos").select(signals.looks_like_code(F.col("line"))).collect()]
    want = []
    for k, g in groupby(zip(code, lines), key=lambda x: x[0]):
        g = [x for _, x in g]
        want += [("\n".join(g), True)] if k else [(x, False) for x in g]
    assert [(r.chunk, r.code) for r in groups.code_runs(rows).orderBy("run").collect()] == want and [c for _, c in want] == [True, False, True, False, False]


def test_csv_schema_round_trip(spark):
    data = [{"identifier_of_event": i, "category_of_event": f"c,{i % 3}"} for i in range(30)]
    x = spark.createDataFrame([(json.dumps(data),), ('{"a": 1}',), ("[1]",), ("no",)], "t string").select(jsonx.csv_schema("t").alias("x")).select("x.*").collect()
    schema, body = x[0].csv.split("\n", 1)
    rows = list(csv.DictReader(io.StringIO(body)))
    assert x[0].accepted and schema.startswith("SCHEMA[category_of_event:") and [{k: str(v) for k, v in r.items()} for r in data] == rows
    assert [r.accepted for r in x[1:]] == [False, False, False]
    kinds = spark.createDataFrame([('{"when": "2026-01-02", "tags": [1], "ok": true}',), ("plain",), ("an error came",)], "t string").select(jsonx.analyse_block("t")["kinds"]).collect()
    assert [r[0] for r in kinds] == [["temporal", "list", "boolean"], ["text"], ["error"]]


def test_adaptive_and_public_text_call(spark):
    short = "Total budget: $5,000. Owner: Ann. P99 250 ms, 3 nodes, 2 regions."
    prose = " ".join(f"Sentence {i} tells about topic number {i} at length." for i in range(60))
    df = spark.createDataFrame([(1, short), (2, prose), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in pipelines.compress_text(df, "doc_id", "text", "safe").collect()}
    assert got[1].compressed == short and got[1].keep_ratio == 1.0 and got[1].overall_score == 1.0 and got[3].compressed == ""
    tight = {r.doc_id: r for r in pipelines.compress_text(df, "doc_id", "text", "aggressive", 100).collect()}
    assert len(tight[2].compressed) <= len(prose) * tight[2].keep_ratio + 1 and 0 < tight[2].entity_recall < 1


def test_candidates_without_a_cross_join(spark):
    rnd = random.Random(1)
    words = ["mimo", "qwen", "deepseek", "gpt-", "claude-", "flash", "mini", "turbo", "pro", "v2", "lite", "max", "x"]
    names = sorted({"-".join(rnd.sample(words, rnd.randrange(1, 4))) for _ in range(80)} | {"gpt-4o-mini", "qwen-turbo", "mimo-v2-flash"})
    n = spark.createDataFrame([(x, i) for i, x in enumerate(names)], "model string, pos int")
    mains = n.select(F.col("model").alias("main"), lookups.infer_provider(F.lit(""), F.col("model")).alias("provider"))
    want = sorted(map(tuple, lookups.rank_candidates(mains.crossJoin(n)).collect()))
    assert sorted(map(tuple, lookups.rank_candidates(lookups.candidate_pairs(mains, n)).collect())) == want and len(want) > 100


def test_markers_without_all_pairs(spark):
    rnd = random.Random(9)
    text = lambda n: "".join(rnd.choice("ab ") for _ in range(n))
    originals = [(c, i, text(rnd.randrange(12, 140))) for c in (1, 2) for i in range(8)]
    cut = []
    for i in range(40):
        c, _, t = rnd.choice(originals)
        at = rnd.choice((0, 0, 3, 30))
        cut.append((c, i, t[at : at + rnd.randrange(5, 100)]))
    o, r = spark.createDataFrame(originals, "conv_id long, pos long, original string"), spark.createDataFrame(cut, "conv_id long, turn long, content string")
    got = {x.turn: x.hash_key for x in recall.annotate(r, o).collect()}
    keys = {(x.conv_id, x.pos): x.k for x in o.select("conv_id", "pos", recall.recall_key(F.col("original")).alias("k")).collect()}
    for c, i, t in cut:
        hits = [pos for oc, pos, full in originals if oc == c and len(t) >= 10 and (t[:80] == full[:80] or t[:60] in full[:80])]
        assert got[i] == (keys[c, min(hits)] if hits else None)


def test_streamed_breaker_is_the_replayed_one(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(i, rnd.randrange(4), rnd.random() < 0.5) for i in range(200)]
    calls = spark.createDataFrame(rows, "event_id long, user_id long, ok boolean")
    calls.write.parquet(str(tmp_path / "calls"))
    stream = spark.readStream.schema(calls.schema).option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "calls"))
    got = sorted((r.user_id, r.event_id, r.blocked) for r in streams.run_once(streams.breaker_state(stream), "append").collect())
    assert got == sorted((r.user_id, r.event_id, r.blocked) for r in costs.replay_breaker(calls).collect()) and any(b for *_, b in got)


def test_config(spark):
    assert config.EngineConfig().base_url == "https://api.deepseek.com/v1" and config.EngineConfig().is_deepseek
    assert config.EngineConfig("MiMo-x").is_mimo and config.EngineConfig("gpt-4o").base_url == config.DEFAULT_URL and config.EngineConfig(base_url="http://own").base_url == "http://own"
    spark.conf.set("spark.siftwright.model", "mimo-v2.5")
    spark.conf.set("spark.siftwright.track_costs", "false")
    spark.conf.set("spark.siftwright.max_retries", "5")
    try:
        c = config.EngineConfig.of_session(spark)
    finally:
        for k in ("model", "track_costs", "max_retries"):
            spark.conf.unset(f"spark.siftwright.{k}")
    assert (c.model, c.track_costs, c.max_retries, c.base_url) == ("mimo-v2.5", False, 5, "https://api.xiaomimimo.com/v1")
    assert config.ProductionConfig.of(c).model == "mimo-v2.5" and config.ProductionConfig().rollout.mode == "auto"
    with pytest.raises(ValueError, match="mode must be one of"):
        config.Rollout("sometimes")


def test_gate_reasons(spark):
    rows = [(True, 30.0, "safe", 1, None), (True, 5.0, "safe", 1, None), (False, None, "safe", 1, "profit_guard"), (True, 30.0, "protected", 1, None), (True, 30.0, "safe", 99, None)]
    t = spark.createDataFrame(rows, "would_call_smart boolean, savings_pct double, policy string, protected_span_count long, fallback_reason string")
    assert [r.reason for r in config.Rollout(allow_protected=False).decide(t).collect()] == ["auto_gate_passed", "estimated_savings_below_threshold", "profit_guard", "protected_policy_disabled", "too_many_protected_spans"]
    assert {r.enabled for r in config.Rollout("on").decide(t).collect()} == {True} and {r.reason for r in config.Rollout("shadow").decide(t).collect()} == {"rollout_mode_shadow"}


def test_benchmark_runs(spark, chats):
    cases_ = queries._cases(spark, chats[0])
    adaptive = {r.id: r for r in pipelines.benchmark_quality(cases_).collect()}
    fixed = {r.id: r for r in pipelines.benchmark_quality(cases_, 0.2).collect()}
    assert set(adaptive) == set(fixed) == {"2", "3", "4"} and all(r.method == "fixed" and r.keep_ratio == 0.2 for r in fixed.values())
    assert all(0 <= fixed[k].quality <= adaptive[k].quality <= 1 for k in fixed)
