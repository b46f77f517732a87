"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    compression_quality,
    decontaminate,
    jaccard_join,
    line_dedup,
    mixing,
    quality_rules,
    sharding,
    substring_dedup,
    token_counts,
    toxicity,
)


#: Target weights of the sources, in hundredths: eight common ones, the others share alike.
WEIGHTS = {"src0": 20, "src1": 10, "src2": 10, "src3": 8, "src4": 8, "src5": 6, "src6": 5, "src7": 5} | {f"src{i}": 2 for i in range(8, 20)}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), WEIGHTS)


def op2_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), known=sharding.map_path(spark, sf_dir, "op2"))


def op3_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(_table(spark, sf_dir, "documents"))


def op4_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"), n=4, percent=85)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("th", "tl")


def op9_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pfair_mixing": op1_pfair_mixing,
    "op2_virtual_slots": op2_virtual_slots,
    "op3_line_windows": op3_line_windows,
    "op4_compression_quality": op4_compression_quality,
    "op5_quality_rules": op5_quality_rules,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_token_counts": op7_token_counts,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_toxicity_grammar": op9_toxicity_grammar,
    "op10_substring_dedup": op10_substring_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op3_line_windows": r"""
WITH d AS (SELECT doc_id, coalesce(string_split(text, chr(10)), []) AS l FROM documents),
win AS (SELECT doc_id, i, array_to_string(l[i:i + 2], chr(10)) AS g
        FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM d WHERE len(l) >= 3)),
later AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
gone AS (SELECT doc_id, list(DISTINCT i + k) AS ps FROM later, range(0, 3) t(k) GROUP BY doc_id),
kept AS (SELECT doc_id, len(l) AS n, CASE WHEN ps IS NULL THEN l
                ELSE list_filter(l, lambda x, i: NOT list_contains(ps, i)) END AS k
         FROM d LEFT JOIN gone USING (doc_id))
SELECT doc_id, n::BIGINT AS n_lines, (n - len(k))::BIGINT AS n_removed, sha256(array_to_string(k, chr(10))) AS kept_sha256
FROM kept
""",
    "op6_ngram_jaccard_join": r"""
WITH RECURSIVE d AS (
    SELECT doc_id, coalesce(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
    FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s
       FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
sz AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM sh x JOIN sh y USING (s) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sz p ON a = p.doc_id JOIN sz q ON b = q.doc_id WHERE 100 * i >= 85 * (p.n + q.n - i)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(sz.n, 0)::BIGINT AS n_shingles, m AS component_id
FROM d LEFT JOIN sz USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a) USING (doc_id)
""",
    "op8_benchmark_decontamination": r"""
WITH d AS (
    SELECT doc_id, coalesce(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
    FROM documents),
b AS (
    SELECT item_id, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS g
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
dwin AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
         FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, i, n FROM dwin JOIN win USING (n, g)),
pos AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hit, range(0, 10) t(k) WHERE k < n GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS x
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(x, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN ids USING (doc_id)
""",
    "op10_substring_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
firsts AS (SELECT g, min(doc_id) AS a FROM win GROUP BY g),
hit AS (SELECT doc_id, i FROM win JOIN firsts USING (g) WHERE a < doc_id),
pos AS (SELECT DISTINCT doc_id, i + k AS p FROM hit, range(0, 13) t(k)),
gone AS (SELECT doc_id, list(p) AS ps FROM pos GROUP BY doc_id),
kept AS (SELECT doc_id, len(w) AS n, CASE WHEN ps IS NULL THEN w
                ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END AS k
         FROM d LEFT JOIN gone USING (doc_id))
SELECT doc_id, n::BIGINT AS n_words, (n - len(k))::BIGINT AS n_removed,
       sha256(array_to_string(k, ' ')) AS kept_sha256
FROM kept
""",
}
