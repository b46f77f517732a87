"""Tables as message views.

A message is a row (conv_id, turn, role, content); ``turn`` carries the order. Besides the raw tables there are
views with richer text, built from columns by plain SQL that Spark and other engines read alike: ``chat`` has six
turns for each order, ``tool`` an HTTP reply and ``cjk`` a Chinese request for each event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

INVOICE = (
    "concat('Invoice ', o_orderkey, ' total $', CAST(floor(o_totalprice) AS BIGINT), ' due in 30 days for user', o_custkey,"
    " '@example.com see https://shop.example.com/orders/', o_orderkey, ' and /var/data/orders/', o_orderkey,"
    " '.json status ', o_orderstatus, '. You must not delete it, max 3 retries in 250ms. Please call update_order(id) thanks')"
)

#: The six turns of an order's chat: role and text.
TURNS = (
    ("system", "concat('You are an order assistant. Today is ', CAST(CAST(o_orderdate AS DATE) AS STRING), ', session_abc', o_custkey, 'xyz0. Never share account data.')"),
    ("user", INVOICE),
    (
        "tool",
        "concat('HTTP/1.1 200 OK', chr(10), 'Content-Type: application/json', chr(10), chr(10), 'request_id: r-', o_orderkey, chr(10),"
        " '{\"order\": ', o_orderkey, ', \"priority\": \"', o_orderpriority, '\", \"items\": [1, 2]}', chr(10), 'latency: ', o_custkey % 90, ' ms', chr(10))",
    ),
    (
        "assistant",
        "concat('ok', chr(10), 'TODO: verify order ', o_orderkey, chr(10), 'The order was placed by customer ', o_custkey,"
        " ' and its current state is ', o_orderstatus, ' which means that nothing has to be done before the next review of it.', chr(10),"
        " CASE WHEN o_orderkey % 3 = 0 THEN 'Error: stock check failed' ELSE 'No problem was found' END)",
    ),
    (
        "user",
        f"concat({INVOICE}, CASE WHEN o_orderkey % 2 = 0 THEN ' again' ELSE ' and then write a long summary of every line item, compare prices and list what changed since last week, or tell me why not' END)",
    ),
    ("user", "concat('Can you check order ', o_orderkey, ' status?!! maybe compare 2 prices, ok')"),
)
#: The same as a table in SQL, a branch for each turn.
CHAT = " UNION ALL ".join(f"SELECT o_orderkey AS conv_id, CAST({i} AS BIGINT) AS turn, '{role}' AS role, {text} AS content FROM orders" for i, (role, text) in enumerate(TURNS))

TOOL = """
SELECT event_id, concat('HTTP/1.1 ', CASE WHEN event_type = 'error' THEN '500 Internal Error' ELSE '200 OK' END, chr(10), 'Content-Type: application/json', chr(10),
       'request_id: r-', event_id, chr(10), chr(10), props, chr(10), 'latency: ', user_id, ' ms', chr(10), chr(10), 'done ', event_type) AS content FROM events
"""

CJK = """
SELECT user_id AS conv_id, event_id AS turn, 'user' AS role,
       concat('请帮我查询用户', user_id, '的', event_type, '记录，其实', CASE WHEN event_id % 3 = 0 THEN '写一个完整的报告' WHEN event_id % 3 = 1 THEN '删除旧的数据文件' ELSE '好的' END, '！！谢谢') AS content FROM events
"""

CALLS = """
SELECT event_id, ts, user_id, concat('p', user_id % 20) AS prefix,
       CASE WHEN event_type = 'click' THEN 'mimo-v2.5-pro' WHEN event_type = 'view' THEN 'deepseek-pro' WHEN event_type = 'signup' THEN 'MiMo Flash'
            WHEN event_type = 'purchase' THEN 'deepseek-v4-flash' ELSE 'mimo' END AS model,
       CAST(floor(value * 10) AS BIGINT) AS input_tokens, CAST(floor(value) AS BIGINT) AS output_tokens,
       CASE WHEN event_id % 3 = 0 THEN CAST(floor(value * 4) AS BIGINT) ELSE CAST(0 AS BIGINT) END AS cached_tokens,
       CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS ok
FROM events
"""


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # event times are in UTC; watermarks need a time zone
    return df.withColumn("ts", F.col("ts").cast("timestamp")) if name == "events" else df


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "conversations").withColumnRenamed("text", "content")


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt out by key, so that work on its rows isn't bound to the few tasks of a small file.

    To be used on narrow rows, before texts are made of them. What is grouped by this key later isn't shuffled again.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _view(spark: SparkSession, sf_dir: str, sql: str, table: str, key: str | None = None) -> DataFrame:
    return spark.sql(sql.replace(f"FROM {table}", f"FROM {_named(spark, sf_dir, table, key)}"))


def _named(spark: SparkSession, sf_dir: str, table: str, key: str | None = None) -> str:
    name = f"siftwright_{table}_{key or ''}_{abs(hash(sf_dir)) % 10**9}"
    rows = load(spark, sf_dir, table)
    (spread(rows, key) if key else rows).createOrReplaceTempView(name)
    return name


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's chat; one scan gives its six messages. It is dealt out by conversation."""
    turns = F.array(*(F.struct(F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), F.expr(text).alias("content")) for i, (role, text) in enumerate(TURNS)))
    return spread(load(spark, sf_dir, "orders"), "o_orderkey").select(F.col("o_orderkey").alias("conv_id"), F.inline(turns))


def tool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, TOOL, "events")


def cjk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, CJK, "events", "event_id")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a request log: one model call each."""
    return _view(spark, sf_dir, CALLS, "events")


CASE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("attack", T.StringType()),
        T.StructField("messages", T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))),
        T.StructField("qa_groups", T.ArrayType(T.ArrayType(T.StringType()))),
        T.StructField("qa_assertions", T.StringType()),
    ]
)


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark cases from a folder of JSON files, with the file each came from; ``qa_assertions`` stays JSON text."""
    return spark.read.schema(CASE_SCHEMA).option("multiLine", True).json(path).withColumn("_path", F.col("_metadata.file_path"))


def write_summary(df: DataFrame, path: str) -> None:
    """One row per line of JSON, nested columns kept."""
    df.write.mode("overwrite").json(path)


def probe(payloads: DataFrame, column: str = "payload", error: str = "error") -> DataFrame:
    """Each probe's models, or why there are none: ``payloads`` with ``models`` (an array), ``source`` and ``failure_reason``.

    A null payload is a failed request (``error`` says how); one that lists nothing is a failure too, never an exception.
    """
    keys = [c for c in payloads.columns if c not in (column, error)]
    listed = inventory(payloads.drop(error), column).groupBy(*keys).agg(F.array_sort(F.collect_set("model")).alias("models"))
    out = payloads.join(listed, keys, "left").withColumn("models", F.coalesce("models", F.array().cast("array<string>")))
    why = F.when(F.col(column).isNull(), F.concat(F.lit("/models probe failed: "), F.substring(F.coalesce(F.col(error), F.lit("no reply")), 1, 200))).when(F.size("models") == 0, "/models listed no model")
    return out.withColumns({"failure_reason": why, "source": F.when(why.isNull(), "models_inventory").otherwise("probe_failure")}).drop(column, error)


def configured_models(providers: DataFrame, listed: DataFrame) -> DataFrame:
    """(provider, model) that both a provider's configuration and its inventory name, text models only.

    ``providers`` has (provider, models array): an empty one admits all that are listed. A provider without an inventory keeps
    its configured models.
    """
    wanted = providers.select("provider", F.explode("models").alias("model")).distinct()
    has = listed.select("provider").distinct()
    both = wanted.join(listed.select("provider", "model").distinct(), ["provider", "model"], "left_semi").union(wanted.join(has, "provider", "left_anti"))
    return both.union(listed.select("provider", "model").distinct().join(providers.where("size(models) = 0").select("provider"), "provider", "left_semi"))


def inventory(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Model ids of listing replies: ``{"data": [...]}`` or a plain list, of strings or of objects with id, name or model."""
    v = F.expr(f"try_parse_json({column})")
    items = F.coalesce(F.expr(f"try_variant_get(try_parse_json({column}), '$.data', 'array<variant>')"), F.expr(f"try_variant_get(try_parse_json({column}), '$', 'array<variant>')"))
    rows = payloads.withColumn("_v", v).select(*[c for c in payloads.columns if c != column], F.posexplode(items).alias("pos", "item"))
    text = F.coalesce(*(F.expr(f"nullif(try_variant_get(item, '$.{k}', 'string'), '')") for k in ("id", "name", "model")), F.expr("CASE WHEN schema_of_variant(item) = 'STRING' THEN try_variant_get(item, '$', 'string') END"))
    return rows.withColumn("model", F.trim(text)).where("length(model) > 0").drop("item")
