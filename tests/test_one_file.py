"""Texts made of a small file are worked on by all tasks, and no text goes through the driver."""

import pytest
from conftest import SF
from pyspark.sql import functions as F

from siftwright import queries
from siftwright.functions import signals
from siftwright.operators import groups
from siftwright.sources import tables


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_chat_of_one_file_is_dealt_out_once(spark):
    c = tables.chat(spark, SF)
    used = c.select(F.spark_partition_id().alias("p")).distinct().count()
    assert used == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert _plan(groups.conv_tokens(c)).count("Exchange ") == 1


@pytest.mark.parametrize("name", ["fact_score", "pack_facts", "segments", "protected_spans"])
def test_texts_are_made_after_the_rows_are_dealt_out(spark, name):
    assert "Exchange hashpartitioning(o_orderkey" in _plan(queries.QUERIES[name](spark, SF))


def test_fidelity_broadcasts_no_texts(spark):
    assert "Broadcast" not in _plan(queries.QUERIES["fidelity"](spark, SF))


def test_conversations_are_never_broadcast(spark):
    a, b = (spark.range(9).withColumnRenamed("id", "conv_id") for _ in range(2))
    assert "Broadcast" in _plan(a.join(b, "conv_id")) and "Broadcast" not in _plan(groups.beside(a, b))


def test_patterns_that_skip_places_find_the_same(spark):
    rows = [
        ("emails", "x@y.com1@z.org a+b@c.de", ["x@y.com", "1@z.org", "a+b@c.de"]), ("paths", "/var/data/1.json a.py.md ..py", ["/var/data/1.json", "a.py.md", "..py"]),
        ("code_symbols", "1abc(x) ab1cd() ſELECT from", ["abc(", "ab1cd()", "ſELECT", "from"]), ("numbers", "٣ 5ms $7 a8 9", ["٣", "5ms", "$7", "9"]),
    ]
    for kind, text, want in rows:
        assert spark.sql("SELECT 1").select(F.regexp_extract_all(F.lit(text), F.lit(f"(?iU){signals.QUICK[kind]}"), F.lit(0)).alias("v")).first().v == want, kind


def test_key_values_after_runs_without_a_mark(spark):
    rows = [("a:b:c", 1), ("a: bcd, and more words. key = v", 2), ("a: ", 0), ("x" * 60 + ":y", 1), ("1:2", 0), ("no mark after words; k→v", 1)]
    got = spark.createDataFrame(rows, "t string, want int").select("t", "want", signals.key_values(F.col("t")).alias("n")).collect()
    assert [(r.t, r.n) for r in got] == [(r.t, r.want) for r in got]


def test_keywords_of_a_text_in_one_pass(spark):
    assert str(signals.ascii_keywords(F.col("the_text"))).count("the_text") == 1
    got = spark.sql("SELECT 'Order order Check this CHECK status' AS t").select(signals.ascii_keywords(F.col("t")).alias("k")).first().k
    assert got == ["Order", "Check", "status"]


def test_risk_policy_reads_each_text_once(spark):
    rows = [(1, 0, "user", "ERROR " + "".join(groups.HIGH_RISK)), (1, 1, "tool", "".join(groups.LOW_RISK)), (2, 0, "user", "a Token"), (2, 1, "user", "token token 100%"), (3, 0, "tool", None), (3, 1, "user", None)]
    got = groups.risk_policy(spark.createDataFrame(rows, "conv_id long, turn long, role string, content string"))
    low = ["".join(t.lower() for c, _, _, t in rows if c == k and t) for k in (1, 2, 3)]
    want = {k: (sum(w in t for w in groups.HIGH_RISK), sum(w in t for w in groups.LOW_RISK)) for k, t in zip((1, 2, 3), low)}
    assert {r.conv_id: (r.risk_score, r.noise_score) for r in got.collect()} == want
    assert _plan(got).count("lower(") <= 4
