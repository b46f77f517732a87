"""A training-data pipeline over ``documents``: each stage calls one operator and works on all the stage before kept.

quality classifier, near-duplicate removal, benchmark decontamination, mixing to target weights, sharding.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.llm import compression_quality, decontaminate, jaccard_join, mixing, sharding
from siftwright.llm.common import materialise, shared_dir, text_key
from siftwright.llm.queries import WEIGHTS


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold."""
    model = compression_quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = compression_quality.score(docs.withColumnRenamed("score", "_own_score"), model).where(F.col("score") >= compression_quality.THRESHOLD)
    return kept.drop("score").withColumnRenamed("_own_score", "score").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (word shingles of five, similarity of 0.8 or more) the smallest doc_id.

    Documents without words are linked with nothing and stay; so do rows without a doc_id. Of rows that repeat
    the smallest doc_id one stays for each text.
    """
    found = jaccard_join.jaccard_components(docs.select("doc_id", "text"), n=5, percent=80)
    keep = found.where("doc_id = component_id").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(keep.hint("shuffle_hash"), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return named.union(docs.where("doc_id is null")).select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    found = decontaminate.decontaminate(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = materialise(found.where("contaminated").select(F.col("th").alias("_bad_th"), F.col("tl").alias("_bad_tl")).distinct(), "contaminated")
    th, tl = text_key(docs["text"])
    keyed = docs.withColumns({"_own_th": th, "_own_tl": tl})
    return keyed.join(bad, (F.col("_own_th") == F.col("_bad_th")) & (F.col("_own_tl") == F.col("_bad_tl")), "left_anti").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix of their sources."""
    return mixing.in_order(docs, WEIGHTS)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and place, by the stored map of this table's shards, which is edited when they have grown.

    The places of a shard follow the mix, worked out again as files keep no order.
    """
    known = sharding.map_path(spark, sf_dir, "pipeline")
    return sharding.shard_documents(docs, known=known, carry=True, order=lambda d: mixing.positions(d, WEIGHTS))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: The quality classifier is a trained compressor, which SQL can't express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/siftwright/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
