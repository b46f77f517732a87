"""JSON text: key aliases and their inverse, key unions, CSV with a schema, field typing."""

from __future__ import annotations

import csv
import io
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that make a column one of errors, and time patterns.
ERROR_WORDS = (
    "error", "exception", "traceback", "fatal", "critical", "panic", "failure", "crash", "segfault", "oom", "timeout", "refused", "denied", "forbidden",
    "unauthorized", "not found", "500", "502", "503", "404", "401", "403", "错误", "异常", "失败", "崩溃", "超时", "拒绝", "未找到", "权限",
)
TEMPORAL = r"\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}:\d{2}:\d{2}|\d{10,13}|(?i:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
SCORE = r"(?i)\b(?:score|rating|confidence|accuracy|precision|recall|f1|auc)\s*[:=]\s*[\d.]+|\b\d+(?:\.\d+)?%"
BOOLEANS = ["true", "false", "1", "0", "yes", "no", "是", "否"]


def _keys(x, found: set) -> set:
    if isinstance(x, dict):
        found.update(x)
    for y in x.values() if isinstance(x, dict) else x if isinstance(x, list) else ():
        _keys(y, found)
    return found


def alias(n: int) -> str:
    return f"{chr(ord('a') + n // 10)}{n % 10}" if n < 260 else f"x{n}"


def _renamed(x, names: dict, digits: int | None):
    if isinstance(x, dict):
        return {names.get(k, k): _renamed(v, names, digits) for k, v in x.items()}
    if isinstance(x, list):
        return [_renamed(y, names, digits) for y in x]
    return round(x, digits) if isinstance(x, float) and digits is not None else x


def _parsed(text: str):
    try:
        return True, json.loads(text)
    except (ValueError, TypeError):
        return False, None


@F.pandas_udf(T.StructType([T.StructField("compressed", T.StringType()), T.StructField("names", T.MapType(T.StringType(), T.StringType())), T.StructField("total_keys", T.LongType()), T.StructField("valid", T.BooleanType())]))
def alias_keys(text: pd.Series) -> pd.DataFrame:
    """Keys of more than five characters get short names by rank, floats two digits, no spaces; other text stays."""
    rows = []
    for t in text:
        ok, x = _parsed(t)
        keys = _keys(x, set()) if ok else set()
        names = {k: alias(i) for i, k in enumerate(sorted(k for k in keys if len(k) > 5))}
        rows.append((json.dumps(_renamed(x, names, 2), ensure_ascii=False, separators=(",", ":")) if ok else t, names, len(keys), ok))
    return pd.DataFrame(rows, columns=["compressed", "names", "total_keys", "valid"])


@F.pandas_udf(T.StringType())
def restore_keys(text: pd.Series, names: pd.Series) -> pd.Series:
    """The inverse of :func:`alias_keys` for keys; numbers stay rounded."""
    out = []
    for t, n in zip(text, names):
        ok, x = _parsed(t)
        back = {v: k for k, v in (dict(n) if n is not None else {}).items()}
        out.append(json.dumps(_renamed(x, back, None), ensure_ascii=False, indent=2) if ok else t)
    return pd.Series(out)


def top_keys(text: Column) -> Column:
    """Keys of a JSON object's first level, sorted."""
    return F.array_sort(F.json_object_keys(text))


@F.pandas_udf(T.ArrayType(T.StringType()))
def all_keys(text: pd.Series) -> pd.Series:
    """Keys on every level of a JSON text, sorted; none of other text. (Nesting has no bound, so no column expression.)"""
    return pd.Series([sorted(_keys(x, set())) if ok else [] for ok, x in map(_parsed, text)])


def array_ends(values: Column) -> Column:
    """First two and last two of more than four strings, with what was left out between them."""
    n = F.size(values)
    return F.when(n <= 4, values).otherwise(F.concat(F.slice(values, 1, 2), F.array(F.concat(F.lit("...("), n - 4, F.lit(" omitted)..."))), F.slice(values, -2, 2)))


def field_types(values: DataFrame) -> DataFrame:
    """Type of each field from all its values: (field, pos, value string) gives one row a field.

    In this order: errors by word, ids by uniqueness, scores and numbers, times in the first twenty, booleans, text.
    """
    v = values.withColumn("num", F.col("value").try_cast("double"))
    early = values.withColumn("r", F.row_number().over(Window.partitionBy("field").orderBy("pos"))).where("r <= 20")
    head = early.groupBy("field").agg(
        F.count_if(F.col("value").rlike(TEMPORAL)).alias("times"), F.count("*").alias("head"),
        F.max(F.when(F.col("r") <= 10, F.col("value").rlike(SCORE)).otherwise(False)).alias("scored"),
    )
    bad = F.lit(False)
    for w in ERROR_WORDS:
        bad = bad | F.contains(F.lower("value"), F.lit(w))
    g = v.groupBy("field").agg(
        F.count("*").alias("n"), F.count_distinct("value").alias("u"), F.bool_or(bad).alias("bad"), F.count("num").alias("nums"), F.min("num").alias("lo"),
        F.max("num").alias("hi"), F.avg("num").alias("mean"), F.stddev_samp("num").alias("sd"), F.bool_or(F.contains("value", F.lit("%"))).alias("pct"),
        F.bool_and(F.lower(F.trim("value")).isin(BOOLEANS)).alias("bools"),
    )
    g = g.join(head, "field")
    far = (F.col("sd") > 0) & ((F.col("hi") - F.col("mean") > 2 * F.col("sd")) | (F.col("mean") - F.col("lo") > 2 * F.col("sd")))
    unique = F.col("u") / F.col("n")
    numeric = F.col("nums") > F.col("n") * 0.7
    score = (F.col("nums") >= 2) & (F.col("lo") >= 0) & (F.col("hi") <= 100) & (F.col("pct") | F.col("scored") | (F.col("hi") <= 1))
    kind = (
        F.when(F.col("bad"), "error").when((unique > 0.9) & (F.col("n") > 3), "id").when(numeric & score, "score").when(numeric, "numeric")
        .when(F.col("times") >= F.col("head") * 0.3, "temporal").when(F.col("bools"), "boolean").otherwise("text")
    )
    return g.select("field", F.col("n").alias("values"), F.col("u").alias("distinct_values"), kind.alias("kind"), (F.coalesce(far, F.lit(False)) & (kind == "numeric")).alias("is_anomaly"), (kind == "error").alias("is_protected"))


# What may be done with a field of each kind; an anomaly adds to a numeric field's.
HINTS = {
    "error": "error_content_never_discard", "id": "id_field_compress_format", "temporal": "temporal_can_normalize", "boolean": "boolean_compress_to_short",
    "text": "text_standard_compress", "score": "score_field_round_or_compress", "numeric": "numeric_standard_compress",
}
ANOMALY = "_has_anomaly"


def protected_values(types: DataFrame) -> DataFrame:
    """(field, hint) of the fields of :func:`field_types` that must be protected: errors and those with an anomaly."""
    hint = F.create_map(*(F.lit(x) for kv in HINTS.items() for x in kv))[F.col("kind")]
    return types.where("is_protected OR is_anomaly").select("field", F.concat(hint, F.when(F.col("is_anomaly"), ANOMALY).otherwise("")).alias("hint"))


def _kind(values: list[str]) -> str:
    """The same typing for the few values of one record list."""
    if not values:
        return "unknown"
    low = [v.lower() for v in values]
    if any(w in v for v in low for w in ERROR_WORDS):
        return "error"
    if len(set(values)) > 0.9 * len(values) and len(values) > 3:
        return "id"
    nums = pd.to_numeric(pd.Series(values), errors="coerce").dropna()
    if len(nums) > 0.7 * len(values):
        head = " ".join(values[:10])
        inside = len(nums) >= 2 and nums.min() >= 0 and nums.max() <= 100
        return "score" if inside and ("%" in "".join(values) or pd.Series([head]).str.contains(SCORE).iloc[0] or nums.max() <= 1) else "numeric"
    if pd.Series(values[:20]).str.contains(TEMPORAL).sum() >= 0.3 * len(values[:20]):
        return "temporal"
    return "boolean" if all(v.strip() in BOOLEANS for v in low) else "text"


@F.pandas_udf(T.StructType([T.StructField("csv", T.StringType()), T.StructField("schema", T.StringType()), T.StructField("original_size", T.LongType()), T.StructField("compressed_size", T.LongType()), T.StructField("accepted", T.BooleanType())]))
def csv_schema(text: pd.Series) -> pd.DataFrame:
    """A JSON list of objects as a schema line and CSV; accepted if that saves 30 in 100 characters."""
    rows = []
    for t in text:
        ok, x = _parsed(t)
        if not ok or not isinstance(x, list) or not x or not all(isinstance(r, dict) for r in x) or not any(x[:50]):
            rows.append((None, None, 0, 0, False))
            continue
        keys = sorted({k for r in x[:50] for k in r})
        out = io.StringIO()
        w = csv.writer(out)
        w.writerow(keys)
        w.writerows([r.get(k, "") for k in keys] for r in x)
        schema = "SCHEMA[" + "|".join(f"{k}:{_kind([str(r.get(k, '')) for r in x[:10]])}" for k in keys) + "]"
        whole = f"{schema}\n{out.getvalue()}"
        before = sum(len(json.dumps(r, ensure_ascii=False)) for r in x)
        fits = before > 0 and 1 - len(whole) / before >= 0.30
        rows.append((whole if fits else None, schema, before, len(whole), fits))
    return pd.DataFrame(rows, columns=["csv", "schema", "original_size", "compressed_size", "accepted"])


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("kinds", T.ArrayType(T.StringType()))]))
def analyse_block(text: pd.Series) -> pd.DataFrame:
    """A text block by its shape: record lists as CSV where that pays, objects field by field, else plain text."""
    rows = []
    for t, c in zip(text, csv_schema.func(text)["csv"]):
        ok, x = _parsed(t)
        if not ok:
            rows.append((t, [_kind([t])]))
        elif c is not None:
            rows.append((c, [_kind([str(r[k]) for r in x if k in r]) for k in sorted(x[0])]))
        elif isinstance(x, dict):
            rows.append((t, ["list" if isinstance(v, list) else _kind([str(v)]) for v in x.values()]))
        else:
            rows.append((t, []))
    return pd.DataFrame(rows, columns=["text", "kinds"])
