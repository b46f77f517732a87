"""Expressions over texts work each value out once, and say the same as a plain statement of the rule."""

import hashlib
import random
import time

from pyspark.sql import functions as F

from siftwright import queries
from siftwright.functions import rules, signals
from siftwright.operators import dedup, groups
from siftwright.plans import pipelines

MESSAGE = "conv_id long, turn long, role string, content string"


def test_filler_that_opens_with_an_optional_word(spark):
    rows = [("帮我查询记录", "查询记录"), ("你帮我查询记录", "查询记录"), ("token broken", "ten bren")]
    got = spark.createDataFrame(rows, "t string, want string").select("want", rules.strip_fillers(F.col("t")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_strip_and_pieces_read_their_text_once():
    c = F.col("the_text")
    for f in (signals.fact_score, signals.density_score, signals.number_of):
        assert str(f(c)).count("the_text") == 1
    assert "regexp" not in str(rules.strip(c))


def test_strip_takes_all_white_space(spark):
    texts = [f"{chr(a)}a{chr(a)}b{chr(a)}\n" for a in (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, 0x2003, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)] + ["​a﻿"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", rules.strip(F.col("t")).alias("s")).collect()
    assert all(r.s == r.t.strip() for r in got)


def test_spans_of_a_long_text_in_linear_time(spark):
    n = 4000
    t = " ".join(f"{i}.5 AB{i}()" for i in range(n))
    began = time.time()
    found = spark.createDataFrame([(t,)], "t string").select(F.size(signals.ordered_unique(F.split("t", " "))).alias("n")).first().n
    assert found == 2 * n and time.time() - began < 20


def test_simhash_looks_each_trigram_up_once(monkeypatch):
    asked, md5 = [], hashlib.md5
    monkeypatch.setattr(dedup.hashlib, "md5", lambda b: asked.append(b) or md5(b))
    rnd = random.Random(3)
    for n in (1, 2, 3, 40, 400):
        t = "".join(rnd.choice("abé中😀 ") for _ in range(n))
        grams = [t[i : i + 3] for i in range(max(len(t) - 2, 1))]
        sums = [sum(int.from_bytes(md5(g.encode()).digest()[:8]) >> k & 1 for g in grams) for k in range(64)]
        want = sum(1 << k for k in range(64) if 2 * sums[k] > len(grams))
        assert dedup.simhash(t) == want
        asked.clear()
        assert dedup.simhash(t) == want and not asked


def test_keywords_of_a_query_are_prepared_once(spark, tmp_path):
    spark.createDataFrame([(1, 5, 99.5, "2026-01-01", "O", "1-URGENT")], "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate string, o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    plan = queries.QUERIES["keyword_recall"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "unicorn" not in plan.split("Join")[0] and "unicorn" in plan


def test_signal_text_works_out_no_noise(spark):
    """The signal among a message's segments, joined, without walking through what the fillers left out."""
    rnd = random.Random(5)
    parts = ["请帮我", "写一个", "报告", "文", "件", "了", "嗯嗯", "ok", "token", "this", "Hi", "thanKs", "ſure", "İ think", "Error", "class ", "check", "checks", "writé", "12.5", "?", "！！", "。。", " ", "  ", "　", "\t", "\r", ",", "，", "：", ":", "\n", "status: 200", "took: 5s", "server", "HTTP/1.1 200", "<system>x</system>", "[", "```"]
    texts = ["".join(rnd.choice(parts) + rnd.choice(("", " ", "\n")) for _ in range(rnd.randrange(12))) for _ in range(3000)] + [None, "", " \n"]
    c = F.col("t")
    x = spark.createDataFrame([(t,) for t in texts], "t string").select("t", rules.segments(c).alias("s"), rules.signal_text(c).alias("got"), rules.instruction_key(c).alias("key"), groups.may_instruct(F.lit("user"), c).alias("may")).collect()
    for r in x:
        signal = [p.text for p in r.s or [] if p.reason not in rules.NOISE]
        assert r.got == (" ".join(signal) if signal else r.t) and (r.may or not r.key)
    assert "aggregate" not in str(rules.signal_text(c)) and len({r.got for r in x}) > 1000


def test_messages_without_instructions_are_not_shuffled(spark):
    rows = [(c, t, "user", f"please check order {c} of {t}") for c in range(40) for t in range(5)] + [(99, 0, "user", "写报告"), (99, 1, "user", "写报告"), (98, 0, "user", "写报告")]
    found = groups.repeated_instructions(spark.createDataFrame(rows, MESSAGE))
    assert [tuple(r) for r in found.collect()] == [(99, 0, "写报告")]
    # every read of the messages asks for two CJK characters before it works out an instruction
    filters = [x for x in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "= user)" in x]
    assert filters and all("RLIKE(content" in x for x in filters)


def test_text_call_looks_for_entities_once_in_each_text(spark):
    df = spark.createDataFrame([(1, "Invoice 12 of ACME3 is due. It was sent on May 3, and Ann paid 40 of it. " * 3), (2, " \n"), (3, None)], "doc_id long, text string")
    out = pipelines.compress_text(df, "doc_id", "text", "aggressive")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(signals.ENTITY) == 2 and not any(x in plan for x in ("Join", "Aggregate", "Window"))
    got = {r.doc_id: r for r in out.collect()}
    want = df.join(out.select("doc_id", "compressed"), "doc_id").select("doc_id", *(c.alias(k) for k, c in signals.evaluate(F.col("text"), F.col("compressed")).items()))
    assert all(got[r.doc_id][k] == v for r in want.collect() for k, v in r.asDict().items()) and got[1].entity_recall < 1 and got[2].passed is None


def test_words_and_marks_of_a_text(spark):
    """Entities, numbers and marks as their plain patterns say, by the scores' own counts."""
    rnd = random.Random(11)
    parts = ["Ann", "Bob2", "x", "x1", "_A", "Éa", "1", "1.5", "٣", "３", "$", "¥", "%", "％", "ms", "GB", ":", "：", "=", "→", "->", "{", "()", " ", "\n", "é", "a_b", "ok", "ſ", "中", "-", ".", ","]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(14))) for _ in range(4000)]
    entity, number = r"(?U)\b[A-Z][a-zA-Z]+\b|\b\d[\d,.]*\b|\b[a-zA-Z]+\d+\b", r"(?U)\b\d[\d,.]*\b"
    c, n = F.trim("t"), lambda p: F.regexp_count(F.trim("t"), F.lit(p))
    found = lambda p: F.regexp_extract_all("t", F.lit(p), F.lit(0))
    score = (
        n(number) * 3.0 + n(r"(?U)\d+[%％]") * 2.0 + n(r"(?U)[$€¥£]\d") * 2.0 + n(r"(?U)\b[A-Z][a-zA-Z]{2,}\b") * 1.5 + n(r"(?U)[\w]+[:：=→]") * 2.0 + n(signals.FACT_UNIT) * 5.0
        + F.when(c.rlike(r"[{}]|\(\)|=>|->|```"), 3.0).otherwise(0.0) - F.when(c.rlike(signals.ACK), 5.0).otherwise(0.0) + F.least(F.length(c) / 50, F.lit(3.0))
    )
    want = F.when(F.length(c) == 0, 0.0).otherwise(score / F.greatest(F.pow(F.length(c).cast("double"), F.lit(0.3)), F.lit(1.0)))
    x = spark.createDataFrame([(t,) for t in texts if t == t.strip()], "t string")
    bad = x.where((found(entity) != found(signals.ENTITY)) | (found(number) != found(signals.PLAIN_NUMBER)) | (signals.density_score(F.col("t")) != want) | (signals.occurrences(F.col("t"), "→") != n("→")))
    assert bad.collect() == [] and x.count() > 2000


def test_text_call_is_the_adaptive_one_of_a_message(spark):
    rnd = random.Random(2)
    parts = ["Please note that the budget is 5,000 and P99 is 250 ms.", "def f(x):", "    return x", "ok thanks", "请帮我写一个报告", "Total: $5", "Nothing of note was said about it at all by anyone.", "status: 200", "a_b = 1"]
    rows = [(i, rnd.choice((" ", "\n")).join(rnd.choices(parts, k=rnd.randrange(1, 9)))) for i in range(150)] + [(900, ""), (901, " "), (902, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for mode, ratio in (("safe", 0.95), ("aggressive", 0.5)):
        m = df.select(F.col("doc_id").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.col("text").alias("content"))
        want = {r.conv_id: (r.content, r.keep_ratio) for r in pipelines.adaptive_compress(m, ratio).collect()}
        assert {r.doc_id: (r.compressed, r.keep_ratio) for r in pipelines.compress_text(df, "doc_id", "text", mode).collect()} == want and len(want) == len(rows)
