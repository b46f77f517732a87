"""The pipeline's stages: which rows go, odd rows, empty tables, clashing names, and what the mix and the stored map change."""

import corpus_pipeline as p
import pytest
from conftest import SF
from pyspark.sql import functions as F

from siftwright.llm import mixing, sharding
from siftwright.llm.common import shared_dir

CLASH = "doc_id long, text string, source string, lang string, " + ", ".join(f"{c} string" for c in ("block", "position", "size", "shard", "slot", "score", "th", "start"))
WORDS = " ".join(f"w{i}" for i in range(60))
ROWS = [
    (1, WORDS, "a", "en", *"mpshlcto"), (2, WORDS + " more", "a", "en", *"mpshlcto"), (3, None, None, None, *"mpshlcto"), (4, "", "b", "en", *"mpshlcto"), (None, WORDS, "b", "en", *"mpshlcto"),
    (5, " ".join(f"x{i}" for i in range(4000)), "b", "de", *"mpshlcto"), (6, "one two three four five six seven eight nine ten eleven " + WORDS[::-1], "c", "en", *"mpshlcto"),
    (1, WORDS, "a", "en", *"mpshlcto"), (7, "y" * 50_000, "c", "en", *"mpshlcto"),
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, 1, 0) for i in (1, 2, 5, 6)] + [(99, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.createDataFrame([r[:12] for r in ROWS], CLASH)
    docs.write.parquet(f"{sf}/documents.parquet")
    return sf, docs


@pytest.mark.parametrize(("name", "stage"), p.STAGES[:-1])
def test_stages_on_odd_rows(spark, odd, name, stage):
    sf, docs = odd
    out = stage(spark, docs, sf)
    assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
    rows, left = [tuple(r) for r in docs.collect()], [tuple(r) for r in out.collect()]
    assert all(left.count(r) <= rows.count(r) for r in left)
    ids = [r[0] for r in left]
    if name == "near_duplicates":  # of the near copies the first stays, once; a row without an id is no one's copy
        assert sorted(x or 0 for x in ids) == [0, 1, 3, 4, 5, 6, 7]
    if name == "decontamination":
        assert sorted(x or 0 for x in ids) == sorted((r[0] or 0) for r in rows if r[0] != 6)
    if name == "mixing":
        assert sorted(map(repr, left)) == sorted(map(repr, rows))
    assert stage(spark, docs.where("false"), sf).collect() == []


def test_last_stage_keeps_rows_and_names(spark, odd):
    sf, docs = odd
    out = p.sharded(spark, docs, sf)
    assert out.count() == len(ROWS) and {"own_size", "own_shard", "own_slot", "position", "block"} <= set(out.columns)
    assert {(r.position, r.own_size, r.block) for r in out.collect()} == {("p", "s", "m")}
    assert p.sharded(spark, docs.where("false"), sf).collect() == []
    assert p.run(spark, sf).count() <= len(ROWS)


def test_repeated_id_keeps_both_texts(spark):
    one, two = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    docs = spark.createDataFrame([(1, one), (1, two), (1, one), (2, one)], "doc_id long, text string")
    assert sorted(map(tuple, p.near_duplicates(spark, docs, "").collect())) == [(1, one), (1, two)]


def test_near_copies_and_benchmark_passages_go(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    base = docs.where("length(text) > 600 AND length(text) < 3000").orderBy("doc_id").first()
    words = base.text.split()
    near = " ".join(words[:-3])
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 100").first().text
    extra = [(10**6, near), (10**6 + 1, base.text), (10**6 + 2, " ".join(words[::-1])), (10**6 + 3, " ".join(words[:20]) + " " + item + " " + " ".join(words[20:60][::-1]))]
    more = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string").withColumns({c: F.lit(base[c]) for c in docs.columns if c not in ("doc_id", "text")}))
    kept = {r.doc_id for r in p.near_duplicates(spark, more, SF).collect()}
    assert not {10**6, 10**6 + 1} & kept and 10**6 + 2 in kept
    clean = {r.doc_id for r in p.decontaminated(spark, more, SF).collect()}
    assert 10**6 + 3 not in clean and 10**6 + 2 in clean


def test_weights_change_the_places(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = {r.doc_id: r.slot for r in p.sharded(spark, docs, SF).collect()}
    monkeypatch.setattr(p, "WEIGHTS", {"src0": 1, "src1": 50})
    assert {r.doc_id: r.slot for r in p.sharded(spark, docs, SF).collect()} != one


def test_stored_map_is_edited(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    path = str(tmp_path / "map")
    some = docs.where("doc_id % 3 > 0")
    one = {r.doc_id: (r.shard, r.map_version) for r in sharding.shard_documents(some, 8, path).collect()}
    assert {r.doc_id: (r.shard, r.map_version) for r in sharding.shard_documents(some, 8, path).collect()} == one and {v for _, v in one.values()} == {1}
    rows = sharding.shard_documents(docs, 8, path).collect()
    moved = sum(one[r.doc_id][0] != r.shard for r in rows if r.doc_id in one)
    assert {r.map_version for r in rows} == {2} and 0 < moved < 0.5 * len(one) and len(rows) == docs.count()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in by.values())
    total = [sum(r.size for r in x) for x in by.values()]
    assert max(total) - min(total) <= max(r.size for r in rows) + 0.02 * sum(total) / 8
    assert sharding.map_path(spark, "a", "x") != sharding.map_path(spark, "b", "x") and sharding.map_path(spark, "a", "x").startswith(shared_dir(spark))


def test_in_order_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(i, f"s{i % 3}", "mine", "p1", "ph", i) for i in range(100)], "doc_id long, source string, block string, position string, phase string, start int")
    out = mixing.in_order(docs, {"s0": 3}).collect()
    assert {(r.block, r.position, r.phase) for r in out} == {("mine", "p1", "ph")} and all(r.start == r.doc_id for r in out) and len(out) == 100
