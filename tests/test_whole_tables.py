"""Registered queries use every row of their tables, against brute force on small tables."""

import datetime
import re

from pyspark.sql import functions as F

from siftwright import queries
from siftwright.functions import rules
from siftwright.plans import pipelines
from siftwright.sources import tables


def test_repeated_instructions_beyond_2000_ids(spark, tmp_path):
    kinds = ("click", "view", "error")
    rows = [(i, i % 4, kinds[i // 4 % 3], "{}", 1.0, "2026-01-01 00:00:00") for i in (*range(0, 20), *range(1990, 2040))]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, props string, value double, ts string").write.parquet(f"{tmp_path}/events.parquet")
    keyed = [tuple(r) for r in tables.cjk(spark, str(tmp_path)).select("conv_id", "turn", rules.instruction_key(F.col("content"))).collect()]
    grams = lambda s: {s[i : i + 2] for i in range(len(s) - 1)}

    def same(a, b):
        x, y = grams(a), grams(b)
        return a in b or b in a or len(x & y) / max(1, len(x | y)) > 0.6

    want = sorted(r for r in keyed if r[2] and any(o[0] == r[0] and o[1] > r[1] and o[2] and same(r[2], o[2]) for o in keyed))
    assert sorted(map(tuple, queries.QUERIES["repeated_instructions"](spark, str(tmp_path)).collect())) == want
    assert any(r[1] > 2000 for r in want)


def test_shadow_runs_the_rules(spark, tmp_path):
    talk = [("user", "嗯嗯 就是说，麻烦你 请帮我写一个报告！！谢谢谢谢，好的好的收到"), ("assistant", "ok\nThe report of order 7 is at https://a.example/r/7 and costs $1200"), ("user", "请帮我写一个报告！！谢谢")]
    rows = [(79, i, r, t) for i, (r, t) in enumerate(talk)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    m = tables.messages(spark, str(tmp_path))
    want = pipelines.token_change(m, pipelines.rule_compress(m)).first()
    got = pipelines.shadow(m, "mimo-v2.5-pro").first()
    assert got.rule_tokens == want.rule_tokens < got.original_tokens and got.rule_cost < got.raw_cost
    gate = queries.QUERIES["rollout_gate"](spark, str(tmp_path)).first()
    assert gate.protected_span_count == pipelines.protected_spans(m).count() < 64 and gate.reason != "too_many_protected_spans"


def test_every_chat_message_has_a_row(spark, tmp_path):
    orders = "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate date, o_orderstatus string, o_orderpriority string"
    spark.createDataFrame([(k, 5, 99.5, datetime.date(2026, 1, k), "O", "1-URGENT") for k in (2, 3)], orders).write.parquet(f"{tmp_path}/orders.parquet")
    texts = {(r.conv_id, r.turn): (r.role, r.content) for r in tables.chat(spark, str(tmp_path)).collect()}
    got = {n: {(r.conv_id, r.turn): r for r in queries.QUERIES[n](spark, str(tmp_path)).collect()} for n in ("fact_dense", "signals_extract", "evaluator", "keyword_recall", "pack_facts")}
    users = {k for k, (role, _) in texts.items() if role == "user"}
    assert set(got["fact_dense"]) == users and all(set(got[n]) == set(texts) for n in set(got) - {"fact_dense"})
    for k, (_, t) in texts.items():
        assert got["signals_extract"][k].emails == " ".join(dict.fromkeys(re.findall(r"[\w.%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", t)))
        assert len(got["pack_facts"][k].packed) <= len(t)
        assert "unicorn" in got["keyword_recall"][k].missing and ("Invoice" in got["keyword_recall"][k].missing) == ("invoice" not in t.lower())
    assert all(got["fact_dense"][k].numbers == len(re.findall(r"[$]?[0-9][0-9,.]*[KkMm%]?", texts[k][1])) for k in users)
