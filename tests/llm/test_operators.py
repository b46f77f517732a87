"""Each operator against SQL or an independent brute force, and on odd rows: nulls, empty and long texts, ties, extra columns."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from oracle import compare
from pyspark.sql import functions as F

from siftwright.llm import common, compression_quality, decontaminate, jaccard_join, line_dedup, mixing, queries, quality_rules, sharding, substring_dedup, token_counts, toxicity
from siftwright.llm.common import components
from siftwright.llm.fitting import fit_logistic

DOCS = "doc_id long, text string, source string, size string, score string, block string"
LONG = " ".join(f"w{i % 977}" for i in range(5000))
ODD = [
    (1, "a b c d e f g h i j k l m n o", "s", "x", "x", "x"),
    (2, "a b c d e f g h i j k l m n o", "s", "x", "x", "x"),
    (2, "a b c d e f g h i j k l m n o", "s", "x", "x", "x"),
    (3, None, None, None, None, None),
    (4, "", "t", "x", "x", "x"),
    (5, " \t\n ", "t", "x", "x", "x"),
    (None, "a b c d e f g h i j k l m n o", "u", "x", "x", "x"),
    (6, LONG, "u", "x", "x", "x"),
    (7, "Only Three words", "u", "x", "x", "x"),
    (8, "x\nx\nx\nx\nx\ny", "u", "x", "x", "x"),
]
OPERATORS = {
    "mix": lambda d: mixing.mix(d, {"s": 3, "t": 1}),
    "mix_carry": lambda d: mixing.mix(d, {"s": 3, "t": 1}, carry=True),
    "in_order": lambda d: mixing.in_order(d, {"s": 3}),
    "shard": lambda d: sharding.shard_documents(d, 3),
    "shard_carry": lambda d: sharding.shard_documents(d, 3, carry=True),
    "lines": line_dedup.line_dedup,
    "rules": quality_rules.quality_rules,
    "jaccard": lambda d: jaccard_join.jaccard_components(d, 4, 85),
    "substring": substring_dedup.substring_dedup,
}


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, name):
    compare(queries.QUERIES[name](spark, SF), queries.ORACLE_SQL[name], SF)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows_all_come_back(odd, name):
    assert OPERATORS[name](odd).count() == len(ODD)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], DOCS)).collect() == []


def test_decontaminate_odd_and_empty(spark, odd):
    bench = spark.createDataFrame([(1, "only three"), (1, "only three"), (2, None), (None, "f g h i j k l m n o"), (3, "")], "item_id long, text string")
    got = {(r.doc_id, r.n_words): r for r in decontaminate.decontaminate(odd, bench).collect()}
    assert got[7, 3].n_hit == 2 and got[7, 3].n_items == 1 and got[1, 15].n_hit == 10 and got[1, 15].n_items == 0 and got[1, 15].contaminated
    assert not got[3, 0].contaminated
    none = decontaminate.decontaminate(odd, bench.where("false"))
    assert none.where("contaminated").count() == 0 and none.count() == len(ODD)
    assert decontaminate.decontaminate(odd.where("false"), bench).collect() == []


def test_decontaminate_beyond_the_literals(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = sorted(map(tuple, decontaminate.decontaminate(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "LITERALS", 10)
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 10)
    assert sorted(map(tuple, decontaminate.decontaminate(docs, bench).collect())) == want


def test_substring_defined_cases(odd):
    got = {(r.doc_id, r.n_words): r for r in substring_dedup.substring_dedup(odd, with_text=True).collect()}
    assert got[1, 15].n_removed == 0 and got[2, 15].n_removed == 15 and got[None, 15].n_removed == 0
    assert got[2, 15].kept_sha256 == hashlib.sha256(b"").hexdigest() and got[7, 3].kept_text == "Only Three words"


def test_jaccard_brute_force(spark):
    rnd = random.Random(5)
    base = [[rnd.choice("abcdefghij") + str(rnd.randrange(30)) for _ in range(60)] for _ in range(6)]
    texts = []
    for b in base:
        for _ in range(12):  # chains of edits: links between copies, not all with the first
            b = list(b)
            for _ in range(rnd.randrange(3)):
                b[rnd.randrange(len(b))] = f"new{rnd.randrange(1000)}"
            texts.append(" ".join(b))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(t.split()[i : i + 4]) for i in range(len(t.split()) - 3)} for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    for small in (32, 2):  # by pairs, and by leaders
        jaccard_join.SMALL = small
        got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs, 4, 85).collect()}
        assert got == {i: find(i) for i in range(len(texts))}
    jaccard_join.SMALL = 32


def test_prefix_tree_finds_all_pairs():
    rng = np.random.default_rng(1)
    whole = np.sort(rng.permutation(5000)[:200]).astype(np.uint64)
    sets = [np.array([x for x in whole if rng.random() < p] + [9000 + i for i in range(k)], np.uint64) for p in (1, 0.97, 0.9, 0.5) for k in (0, 10, 60)] + [whole, whole[:1]]
    as_sets = [set(s.tolist()) for s in sets]
    probes = np.array([0, 3, 4, 12])
    want = {(int(i), j) for i in probes for j in range(len(sets)) if i != j and 100 * len(as_sets[i] & as_sets[j]) >= 80 * len(as_sets[i] | as_sets[j])}
    assert set(jaccard_join.tree_links(sets, probes, 80)) == want and len(want) > 10


def test_words_of_blocks(monkeypatch):
    texts = ["a  b\tc", "", None, " ", "Ab aB", "x" * 3000 + " y", "ends ", " b\x0b\x0cé a\u00a0b", "z" * 1023 + "\n" + "z" * 1024]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    monkeypatch.setattr(common, "BLOCK_BYTES", 40)
    for lower in (False, True):
        seen: dict[int, bytes] = {}
        rows = 0
        for part, words in common.blocks(iter([batch.slice(0, 4), batch.slice(4)]), lower):
            at = 0
            for i, n in zip(part.column(0).to_pylist(), words.counts):
                t = (texts[i] or "").encode()
                want = (t.lower() if lower else t).split()
                assert n == len(want)
                for w, h in zip(want, words.hashes[at : at + n].tolist()):
                    assert seen.setdefault(h, w) == w
                at, rows = at + n, rows + 1
        assert rows == len(texts) and len(set(seen.values())) == len(seen)


def test_groups_across_batches():
    t = pa.table({"k": [1, 1, 2, 2, 2, 3], "b": [0, 1, 0, 0, 0, 0], "v": range(6)})
    for size in (1, 2, 4, 6):
        got = [g.column("v").to_pylist() for g in common.groups(iter(t.to_batches(size)), "k", "b")]
        assert got == [[0], [1], [2, 3, 4], [5]]


def test_levels_double():
    assert substring_dedup.lengths(13, 4) == [4, 8, 13] and substring_dedup.lengths(13, 13) == [13] and substring_dedup.lengths(50, 3) == [3, 6, 12, 24, 48, 50]


def test_substring_levels_agree(spark):
    rnd = random.Random(8)
    shared = [[rnd.choice("abcdefgh") for _ in range(rnd.randrange(5, 30))] for _ in range(12)]
    texts = [" ".join(w for _ in range(4) for w in [*rnd.choice(shared), *(rnd.choice("xyzuvw") for _ in range(3))]) for _ in range(40)]
    docs = spark.createDataFrame([*enumerate(texts), (99, texts[3]), (100, None)], "doc_id long, text string")
    words = {i: t.split() for i, t in [*enumerate(texts), (99, texts[3])]}
    first = {}
    for i in sorted(words):
        for j in range(len(words[i]) - 6):
            first.setdefault(tuple(words[i][j : j + 7]), i)
    want = {100: ""}
    for i, w in words.items():
        gone = {j + k for j in range(len(w) - 6) if first[tuple(w[j : j + 7])] < i for k in range(7)}
        want[i] = " ".join(x for j, x in enumerate(w) if j not in gone)
    for base in (2, 7):
        assert {r.doc_id: r.kept_text for r in substring_dedup.substring_dedup(docs, 7, base, with_text=True).collect()} == want
    alone = spark.createDataFrame([(1, "a b c d e f g h"), (2, "i j k l m n o p")], "doc_id long, text string")
    assert all(r.n_removed == 0 for r in substring_dedup.substring_dedup(alone, 7, 2).collect())


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (20, 21), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert {n: got.get(n, n) for n in (3, 4, 5, 7, 9, 20, 21)} == {3: 3, 4: 3, 5: 3, 7: 7, 9: 3, 20: 20, 21: 20}


def test_line_windows_defined_cases(odd):
    got = {(r.doc_id, r.n_lines): r for r in line_dedup.line_dedup(odd, with_text=True).collect()}
    assert got[3, 0].n_removed == 0 and got[8, 6].n_removed == 4 and got[8, 6].kept_text == "x\ny"


def test_period_is_pfair():
    for w in ({"a": 5, "b": 3, "c": 1, "d": 1}, {"a": 1}, {"a": 97, "b": 2, "c": 13}):
        at, total = mixing.period(w), sum(w.values())
        assert sorted(t for ts in at.values() for t in ts) == list(range(total))
        for s, ts in at.items():
            assert all(k * total // w[s] <= t < -(-(k + 1) * total // w[s]) for k, t in enumerate(ts))
            placed = 0
            for t in range(total + 1):
                placed = sum(1 for x in ts if x < t)
                assert abs(placed * total - w[s] * t) < total


def test_mix_brute_force(spark):
    sizes, weights = {"a": 50, "b": 7, "c": 23, None: 4}, {"a": 2, "b": 2, "c": 1}
    rows = [(i * 10 + j, s) for j, (s, n) in enumerate(sizes.items()) for i in range(n)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), weights, block_docs=2).collect()
    # the scheduler block by block, with a new phase whenever a source ends
    left = {s: -(-n // 2) for s, n in sizes.items()}
    w = {s: weights.get(s, 1) for s in sizes}
    order, k = [], None
    while any(left.values()):
        live = [s for s in left if left[s]]
        if k is None or set(k) != set(live):
            k, t0 = dict.fromkeys(live, 0), len(order)
        total, t = sum(w[s] for s in live), len(order) - t0
        ready = [s for s in live if k[s] * total // w[s] <= t]
        s = min(ready, key=lambda s: (-(-(k[s] + 1) * total // w[s]), s is None, s or ""))
        order.append(s)
        k[s] += 1
        left[s] -= 1
    assert {r.slot: r.source for r in got} == dict(enumerate(order))
    assert all(r.release <= r.slot < r.deadline for r in got)
    assert max(Counter(r.slot for r in got).values()) == 2 and len({r.position for r in got}) == len(rows)


def test_shards_are_even_and_gapless(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sharding.shard_documents(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    by = {}
    for r in rows:
        assert r.size == len(texts[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        by.setdefault(r.shard, []).append(r)
    assert all(sorted(r.slot for r in rs) == list(range(len(rs))) for rs in by.values())
    total = [sum(r.size for r in by.get(s, [])) for s in range(24)]
    assert max(total) - min(total) <= max(r.size for r in rows)


def test_slot_map_versions(spark, tmp_path):
    rnd = random.Random(3)
    loads = [rnd.randrange(1000) for _ in range(sharding.SLOTS)]
    one = sharding.first_map(loads, 8)
    two = sharding.rebalanced(one, loads, 9)
    moved = [i for i in range(len(loads)) if one.shard[i] != two.shard[i]]
    assert {two.shard[i] for i in moved} == {8} and two.version == 2
    total = [sum(x for x, s in zip(loads, two.shard) if s == k) for k in range(9)]
    assert max(total) - min(total) < 0.05 * sum(loads) / 9
    for m in (one, two):
        m.save(spark, str(tmp_path / "map"))
    assert sharding.SlotMap.load(spark, str(tmp_path / "map")) == two and sharding.SlotMap.load(spark, str(tmp_path / "map"), 1) == one


def test_rule_features_brute_force(spark):
    texts = ["a b c d e f g h a b c d e f g h", "Hi!! # $ |\nHi!! # $ |\n\n \nx", "", "ü " * 30]
    got = {r.doc_id: r for r in quality_rules.features(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        w = t.split()
        wins = [tuple(w[j : j + 8]) for j in range(len(w) - 7)]
        hit = {j + k for j, x in enumerate(wins) if wins.count(x) > 1 for k in range(8)}
        lines = [x for x in t.split("\n") if x.strip()]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want


def test_posteriors_match_plain_em(spark):
    pats = [([1, 1, 0], 700), ([1, -1, 1], 60), ([-1, 1, -1], 40), ([0, -1, -1], 30), ([1, 1, 1], 500)]
    got = {tuple(r.votes): r.posterior for r in quality_rules.posteriors(spark.createDataFrame(pats, "votes array<int>, n long"), 3, 25).collect()}
    pi, a, b = quality_rules.START[0], [quality_rules.START[1]] * 3, [quality_rules.START[2]] * 3
    pr, (p0, a0, b0) = quality_rules.PRIOR, quality_rules.START

    def post(v):
        g, h = pi, 1 - pi
        for r, x in enumerate(v):
            g *= {1: a[r], -1: 1 - a[r], 0: 1}[x]
            h *= {1: 1 - b[r], -1: b[r], 0: 1}[x]
        return g / (g + h)

    for _ in range(25):
        q = [(v, n, post(v)) for v, n in pats]
        pi = (sum(n * p for _, n, p in q) + pr * p0) / (sum(n for _, n, _ in q) + pr)
        a = [(sum(n * p for v, n, p in q if v[r] == 1) + pr * a0) / (sum(n * p for v, n, p in q if v[r]) + pr) for r in range(3)]
        b = [(sum(n * (1 - p) for v, n, p in q if v[r] == -1) + pr * b0) / (sum(n * (1 - p) for v, n, p in q if v[r]) + pr) for r in range(3)]
    assert got == pytest.approx({tuple(v): post(v) for v, _ in pats}, abs=1e-9)


BASE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
hit AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
pos AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM hit, range(0, 8) t(k) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(l.n, 0)::BIGINT AS n_dup_lines,
       coalesce(pos.n, 0)::BIGINT AS n_repeat_words, len(w) < 20 OR 100 * coalesce(pos.n, 0) > 30 * len(w) AS base_failed
FROM d LEFT JOIN l USING (doc_id) LEFT JOIN pos USING (doc_id)
"""


def test_rules_base_columns_match_sql(spark):
    compare(queries.QUERIES["op5_quality_rules"](spark, SF).drop("kept", "posterior", "votes"), BASE_SQL, SF)


def test_rules_verdict_is_not_a_veto(spark):
    sf = "/root/testdata/sf0.01"
    r = queries.QUERIES["op5_quality_rules"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality"), "doc_id", "left").where("NOT base_failed").collect()
    veto = [all(v >= 0 for v in x.votes) for x in r]
    assert any(x.kept != v for x, v in zip(r, veto)) and any(not x.kept for x in r)
    wrong = lambda said: sum(k != (x.quality == 1) for x, k in zip(r, said) if x.quality is not None)
    assert wrong([x.kept for x in r]) <= wrong(veto) < 0.05 * len(r)
    assert all(x.kept for x in r if x.quality == 1 and min(x.votes) >= 0)


def test_histogram_answers(spark):
    texts = ["", None, "one two three", "one", "a much longer text of some more words " * 40]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    with open(token_counts.VOCABULARY, "rb") as f:
        e = token_counts.encoder(f.read())
    n = sorted(len(e.encode_ordinary(t or "")) for t in texts)
    sums = token_counts.token_counts(df).cache()
    for limit in (0, 1, 2, 3, 100, 10**6):
        assert token_counts.truncated_total(sums, limit) == sum(min(x, limit) for x in n)
    for r in sums.collect():
        assert r.docs_at_least == sum(x >= r.length for x in n) and r.tokens_at_least == sum(x for x in n if x >= r.length)
        assert r.truncated_tokens == sum(min(x, r.length) for x in n) and r.docs_at_most == sum(x <= r.length for x in n)
    assert [token_counts.quantile(sums, q) for q in (0.2, 0.5, 1.0)] == [n[0], n[2], n[-1]]
    assert token_counts.token_counts(df.where("false")).collect() == []


def test_logistic():
    x = np.array([[1, -2], [1, -1], [1, 1], [1, 2.0]])
    w = fit_logistic(x, np.array([0, 0, 1, 1.0]), {0: 2, 1: 2})
    assert w[1] > 0
    assert fit_logistic(np.empty((0, 2)), np.empty(0), {}) == [0.0, 0.0]


def _accuracy(spark, name, label):
    r = queries.QUERIES[name](spark, "/root/testdata/sf0.01")
    x = r.where("held_out").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").select("predicted", F.col(label).alias("y")).collect()
    return sum(a.predicted == a.y for a in x) / len(x), r


def test_quality_on_held_out_rows(spark):
    acc, r = _accuracy(spark, "op4_compression_quality", "quality")
    assert acc > 0.9 and r.where("score < 0 OR score > 1 OR score IS NULL").count() == 0


def test_toxicity_on_held_out_rows(spark):
    acc, r = _accuracy(spark, "op9_toxicity_grammar", "toxic")
    assert acc > 0.9 and r.where("score < 0 OR score > 1 OR score IS NULL").count() == 0


def test_scores_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (6, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for f in (compression_quality.quality_scores, toxicity.toxicity_scores):
        assert f(odd, labels).where("score BETWEEN 0 AND 1").count() == len(ODD)
        assert f(odd, labels.where("false")).count() == len(ODD)
        assert f(odd.where("false"), labels).collect() == []
    assert "size" in compression_quality.score(odd, compression_quality.Model(b"", b"", [0.0])).columns


def test_grammar_weighs_clauses():
    g = toxicity.Grammar({"idi": 5.0, "idiom": -3.0, "kind$": -1.0})
    score = lambda t: sum(g.clauses(t)[0])
    plain, target, negated, said = (score(t) for t in ("an idiot came.", "you are an idiot.", "not an idiot.", "they said idiot."))
    assert target > plain > said > negated > 0
    assert g.clauses("an idiom. you? kind")[0] == [] and g.clauses("")[0] == []
    assert score("I don't think you are an idiot") < plain and score("not clever but an idiot") == plain and score("he said so. an idiot") == plain
    threat = score("I will kill you")
    assert threat > plain and score("they said I will kill you") < threat and score("I will not kill you") < threat and score("kill yourself") == score("ich werde dich töten") == score("je vais te tuer") == threat
    assert not any(map(score, ("to kill time", "we beat you at chess", "you burn calories", "the fire will destroy houses. you left", "")))


def test_each_transducer_changes_decisions():
    """A small corpus in which only the grammar tells clean from toxic: with any part of it left out some decisions are others."""
    lexicon, fill = {"idiot": 4.0}, "some words of a longer text follow here and there."
    toxic = ["you are an idiot", "you know what an idiot", "I will kill you", "we shall hurt all of you"]
    clean = ["an idiot came", "nobody is an idiot", "you are not an idiot", "they said you are an idiot", "we beat you at chess", "I will not kill you", "he wrote I will kill you"]
    full = toxicity.Grammar(lexicon)
    top = lambda g, t: max(g.clauses(f"{t}. {fill}")[0], default=0.0)
    bar = 5.0
    assert all(top(full, t) > bar for t in toxic) and all(top(full, t) <= bar for t in clean)
    for k in range(len(toxicity.PARTS)):
        less = toxicity.Grammar(lexicon, tuple(p for i, p in enumerate(toxicity.PARTS) if i != k))
        assert any((top(less, t) > bar) != (t in toxic) for t in toxic + clean), k


def test_disagreeing_and_repeated_labels(spark):
    from siftwright.llm import fitting

    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (2, 1), (4, 0)], "doc_id long, quality int")
    assert {(r.id, r.label) for r in fitting.marked(labels, "quality", 97, 96).collect()} == {(2, 1), (4, 0)}
    docs = spark.createDataFrame([(2, "a"), (2, "b"), (2, "a"), (4, None)], "doc_id long, text string")
    assert fitting.texts_of_sample(docs, spark.createDataFrame([(2, 1), (4, 0)], "id long, label int"), "t").count() == 1
