"""Rules against independent statements of them, on small inputs."""

import json

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftwright.functions import rules, signals, tokens
from siftwright.operators import cases, costs, dedup, groups, jsonx, lookups, pack, recall


def one(spark, expr, text="x"):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t"))).first()[0]


def test_token_estimates(spark):
    assert [one(spark, f, "") for f in (tokens.multilingual, tokens.api, tokens.plugin)] == [0, 0, 0]
    assert one(spark, tokens.api, "x" * 10) == 2  # 2.5 to even
    assert one(spark, tokens.multilingual, "中文ab") == 1
    assert one(spark, tokens.plugin, "a b {中") == 5


def test_keep_ratio_refuses(spark):
    with pytest.raises(Exception, match="mode must be one of"):
        spark.range(1).select(tokens.keep_ratio(F.lit("wild"), F.lit(None).cast("double"), F.lit(3))).collect()


def test_fillers(spark):
    assert one(spark, rules.strip_fillers, "请帮我写一个报告！！") == "写报告！"
    assert one(spark, rules.strip_fillers, "嗯嗯 Thank you, this token") == ", ts ten"
    assert one(spark, rules.strip_fillers, "") == ""


def test_grouped_fillers_equal_the_plain_alternation(spark):
    import re

    plain = re.compile("|".join(f"(?:{p})" for p in (*rules.FILLERS_CN, *rules.FILLERS_EN)), re.I)
    for t in ("就是说，那么好的 了 吧", "知道了收到 okay alright hi", "你帮我顺便说一下其实简单来说一个完整的", "可以加 麻烦你 请处理 thanks thank you also", "嗯嗯嗯 哦 噢噢 是的对的好"):
        assert one(spark, lambda c: F.regexp_replace(c, rules.FILLER, ""), t) == plain.sub("", t)


def test_removed_text(spark):
    assert one(spark, lambda c: rules.removed_text(c, F.lit("bd")), "abcd") == "ac"


@pytest.mark.parametrize(("text", "dense"), [("a 1 b 2 c 3 and some more", True), ("short 1 2 3", False), ("no numbers at all in this text", False)])
def test_fact_dense(spark, text, dense):
    assert one(spark, signals.is_fact_dense, text) is dense


def test_evaluator(spark):
    e = signals.evaluate(F.lit("Alice met Bob 42"), F.lit("Alice 42"))
    r = spark.range(1).select(*(c.alias(k) for k, c in e.items())).first()
    assert r.entity_recall == 2 / 3 and r.number_precision == 1.0 and r.entity_loss == 33 and r.passed is True
    blank = signals.evaluate(F.lit("  "), F.lit("x"))
    assert spark.range(1).select(blank["passed"]).first()[0] is None


def test_near_dedup_uses_kept_messages_only(spark):
    base = "the quick brown fox jumps over the lazy dog"
    rows = [(1, 0, "user", base), (1, 1, "user", base + "!"), (1, 2, "user", "short"), (1, 3, "user", None), (2, 0, "user", base)]
    got = {(r.conv_id, r.turn): r.content for r in dedup.near_dedup(spark.createDataFrame(rows, "conv_id long, turn long, role string, content string"), 0.7).collect()}
    assert got[1, 1].startswith("[REF:") and got[1, 0] == base and got[1, 2] == "short" and got[1, 3] is None and got[2, 0] == base


def test_simhash_forms_agree(spark):
    texts = ["hello world, this is a text", "ab", "the quick brown fox jumps over the lazy dog"]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    got = {r.k: r.fingerprint % 2**64 for r in dedup.fingerprints(df, "k", "t").collect()}
    assert got == {i: dedup.simhash(t) for i, t in enumerate(texts)}


def _units(texts, scores, code=()):
    return [pack.Unit(i, t, s, i in code) for i, (t, s) in enumerate(zip(texts, scores))]


def test_pack_skips_what_does_not_fit():
    kept = lambda *a: sorted(u.place for u in pack.fold(*a))
    assert kept(_units(["aaaa", "bbbbbb", "cc"], [3.0, 2.0, 1.0]), 7, pack.by_score) == [0, 2]
    assert kept(_units(["aaaa", "bb"], [0.0, 1.0]), 7, pack.facts_first) == [0, 1]
    assert kept(_units(["aaaa"], [1.0]), 2, pack.facts_first) == []


@given(st.lists(st.tuples(st.text("ab\n", max_size=9), st.floats(-2, 9), st.booleans()), max_size=12), st.integers(0, 60))
def test_pack_properties(rows, room):
    units = [pack.Unit(i, t, s, c) for i, (t, s, c) in enumerate(rows)]
    for order in (pack.by_score, pack.facts_first):
        kept = pack.fold(units, room, order)
        total = sum(len(u.text) for u in kept) + max(0, len(kept) - 1)
        assert total <= room or not kept
        # nothing that was left out would still fit
        assert all(u in kept or total + len(u.text) + bool(kept) > room for u in units)
        ranked = sorted(units, key=order)
        assert not ranked or len(ranked[0].text) > room or ranked[0] in kept
    over = pack.fold(units, room, pack.by_score, room // 2)
    assert all(u in over for u in units if u.code and len(u.text) <= room // 2)


def test_dense_packing_repeats_lines_and_keeps_runs_whole(spark):
    lines = ["key: 12 ms", "ok", "key: 12 ms", "thanks"]
    text = "\n".join(lines)
    df = spark.createDataFrame([(text,), ("x = 1\ny = 2\nplain words here and there",), ("one line only",)], "t string")
    got = [r.packed for r in pack.packed(df, "packed", "t", F.lit(22), F.lit(False)).collect()]
    assert got[0] == "key: 12 ms\nkey: 12 ms" and got[1].startswith("x = 1\ny = 2") and len(got[1]) <= 22 and got[2] == "one line only"


def missing(spark, text, *lists):
    rows = spark.createDataFrame([(i, text, k) for i, k in enumerate(lists)], "i int, t string, k array<string>")
    return [r.m for r in rows.select("i", cases.missing_facts(F.col("t"), F.col("k")).alias("m")).orderBy("i").collect()]


def test_keyword_aliases(spark):
    assert missing(spark, "we pay 20% in 200 ms", ["0.20", "20%"], ["200 ms"], ["20 %", "gone"]) == [[], [], ["gone"]]
    assert missing(spark, "nothing", ["OAuth2", "compliance"], [], None) == [["OAuth2", "compliance"], [], []]
    assert missing(spark, "OAuth2 only", ["OAuth2", "compliance"]) == [["compliance"]]
    assert missing(spark, None, ["a"]) == [["a"]]
    # number words and digits are one fact, as are counts of the same thing; counts of others are not
    budget = "Token Optimizer gets {} USD. The combined budget is 4.5k dollars."
    assert missing(spark, budget.format("nine hundred"), ["nine hundred", "900"]) == [[]] and missing(spark, budget.format("900"), ["nine hundred", "900"]) == [[]]
    for n in ("30 real-world cases", "30 cases"):
        assert missing(spark, f"Need at least {n} before claiming production readiness.", ["30 real-world cases", "30 cases"], ["30 real-world cases", "OAuth2"])[0] == []
    assert missing(spark, "Need at least 30 real-world cases before.", ["30 real-world cases", "OAuth2"]) == [["OAuth2"]]
    assert missing(spark, "Budget includes 30 credits for the pilot.", ["30 credits", "30 cases"]) == [["30 cases"]]
    assert missing(spark, "go southeast", ["SE"], ["se", "southeast"]) == [["SE"], []]
    # a group forms around its first member: c is an alias of b, not of a
    assert missing(spark, "zz", ["abc", "abcd", "bcd", "abc1"]) == [["abc", "abcd", "abc1", "bcd"]]


def test_number_forms(spark):
    assert [one(spark, signals.number_of, t) for t in ("seven hundred", "$5K", "x", "1,200 ms", "nine")] == [700, 5000, None, 1200, 9]


def test_assertions(spark):
    asked = [
        ("a b", {"type": "all_of", "values": ["a", "z"]}), ("a", {"type": "any_of", "values": ["q", "z"]}), ("a", {"type": "odd"}), ("now 7", {"type": "latest_value", "current": "7"}),
        ("Friday", {"type": "present", "value": "Friday"}), ("x", {"type": "present", "values": ["x", "y"]}), ("x", {"values": ["y"]}), ("7 days", {"type": "all_of", "values": ["7 days", "8 days"]}),
    ]
    df = spark.createDataFrame([(i, t, json.dumps(a)) for i, (t, a) in enumerate(asked)], "i int, text string, assertion string")
    got = [(r.found, r.missing, r.miss) for r in cases.checked(df).orderBy("i").collect()]
    assert got[0] == (False, ["z"], "true_loss") and got[1][2] == "alias_gap" and got[2] == (False, ["unsupported assertion type: odd"], "assertion_gap") and got[3][0]
    assert got[4][0] and got[5][1] == ["y"] and got[6] == (False, ["y"], "true_loss") and got[7][1] == ["8 days"]


def test_json_alias_round_trip(spark):
    text = json.dumps({"long_key_name": [{"another_key": 1.234, "k": None}], "k": "ü"}, ensure_ascii=False)
    df = spark.createDataFrame([(text,), ("not json",)], "t string").withColumn("x", jsonx.alias_keys("t"))
    a, b = df.select("x.*", jsonx.restore_keys("x.compressed", "x.names").alias("back")).collect()
    assert json.loads(a.back) == {"long_key_name": [{"another_key": 1.23, "k": None}], "k": "ü"} and a.total_keys == 3
    assert b.compressed == "not json" and not b.valid


def test_breaker(spark):
    rows = [(1, i, 0) for i in range(4)] + [(1, i, 1) for i in range(4, 30)]
    got = [r.blocked for r in costs.replay_breaker(spark.createDataFrame(rows, "user_id long, event_id long, ok int")).orderBy("event_id").collect()]
    assert got[:2] == [False, False] and all(got[2:21]) and not any(got[21:])


def test_unknown_model_raises(spark):
    df = spark.createDataFrame([("no-such-model",)], "model string")
    assert lookups.find_profile(df).first().profile is None
    with pytest.raises(Exception, match="Unknown model"):
        lookups.find_profile(df, strict=True).collect()


def test_recall_keys_do_not_overwrite(spark):
    long = "x" * 90
    originals = spark.createDataFrame([(1, 0, long + "a"), (1, 1, long + "b")], "conv_id long, pos long, original string")
    reduced = spark.createDataFrame([(1, 0, long[:70]), (1, 1, "tiny")], "conv_id long, turn long, content string")
    got = {r.turn: r.content for r in recall.annotate(reduced, originals).collect()}
    assert got[0].count("[TO:retrieve") == 1 and got[1] == "tiny"


def test_latest_keywords(spark):
    rows = [(1, 0, "user", "old words here"), (1, 1, "user", "Check OrderService 项目上下文很长内容"), (2, 0, "system", "only system"), (3, 0, "user", "please Review this Review")]
    got = {r.conv_id: r.keywords for r in groups.latest_keywords(spark.createDataFrame(rows, "conv_id long, turn long, role string, content string")).collect()}
    assert got[1][:5] == ["Check", "OrderService", "项目上下文", "上下文", "长内容"] and "项目上下" in got[1] and len(got[1]) <= 12
    assert got[2] == [] and got[3] == ["please", "Review"]


def test_empty_tables(spark):
    m = spark.createDataFrame([], "conv_id long, turn long, role string, content string")
    for f in (groups.conv_tokens, groups.risk_policy, groups.content_profile, groups.segments, groups.latest_keywords, dedup.near_dedup):
        assert f(m).collect() == []


def test_case_files_and_summary(spark, tmp_path):
    from siftwright.sources import tables

    (tmp_path / "in").mkdir()
    case = {"id": "c1", "category": "x", "messages": [{"role": "user", "content": "Pay 30 by Friday"}], "qa_groups": [["Friday", "friday"], ["gone"]], "notes": "unused"}
    (tmp_path / "in/a.json").write_text(json.dumps(case, indent=1))
    other = {"id": "c2", "category": "x", "messages": [], "qa_assertions": [{"type": "present", "value": "Friday"}]}
    (tmp_path / "in/b.json").write_text(json.dumps(other))
    c = tables.load_cases(spark, str(tmp_path / "in"))
    text = F.array_join(F.transform("messages", lambda m: m["content"]), "\n")
    a = cases.checked(cases.assertions(c).join(c.select("id", text.alias("text")), "id"))
    res = cases.case_results(a.select("id", "found", "miss"))
    assert {tuple(r)[:3] for r in res.collect()} == {("c1", 1, 2), ("c2", 0, 1)}
    tables.write_summary(cases.run_summary(res), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().total_qa == 3
