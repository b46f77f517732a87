"""The order of the mix decides the places in the shards of the pipeline."""

import corpus_pipeline

from siftwright.llm import mixing

DOCS = "doc_id long, text string, source string"


def test_weights_change_the_places(spark, tmp_path, monkeypatch):
    rows = [(i, f"text {i}", "ab"[i % 2]) for i in range(1500)] + [(7, f"other {i}", "b") for i in range(40)]
    docs = spark.createDataFrame(rows, DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[-2:])
    places = {}
    for w in (1, 5):
        monkeypatch.setattr(corpus_pipeline, "WEIGHTS", {"a": w, "b": 1})
        got = corpus_pipeline.run(spark, str(tmp_path)).collect()
        at = {(r.doc_id, r.text): r.position for r in mixing.mix(docs, {"a": w, "b": 1}, carry=True).collect()}
        shards = {}
        for r in got:
            shards.setdefault(r.shard, []).append((r.slot, at[r.doc_id, r.text]))
        for s in shards.values():
            assert [x for x, _ in sorted(s)] == list(range(len(s))) and [p for _, p in sorted(s)] == sorted(p for _, p in s)
        assert len(got) == len(rows)
        places[w] = {(r.doc_id, r.text): (r.shard, r.slot) for r in got}
    assert places[1] != places[5] and {k: v[0] for k, v in places[1].items()} == {k: v[0] for k, v in places[5].items()}
