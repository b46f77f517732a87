"""Facts, spans, densities and quality scores as column expressions."""

from __future__ import annotations

from string import digits as DIGITS

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import ALNUM, let, not_blank, other_ascii, replace_all, strip

# Patterns of critical signals and their weights.
SIGNALS = {
    "numbers": r"(?<![\w.])(?:\d+(?:\.\d+)?%?|[$¥]\s*\d+(?:\.\d+)?|\d+(?:\.\d+)?\s*(?:ms|s|kg|mb|gb|k|m|万|亿))(?![\w.])",
    "paths": r"(?:/[\w.\-一-鿿]+){2,}|[A-Za-z]:\\(?:[^\\\s]+\\?)+|[\w.\-]+\.(?:py|js|ts|tsx|jsx|json|md|yaml|yml|txt|csv|xlsx|pdf)",
    "urls": r"https?://[^\s)\]}>\"，。；：、]+",
    "emails": r"[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "code_symbols": r"\b(?:def|class|import|from|return|async|await|function|const|let|var|SELECT|INSERT|UPDATE|DELETE)\b|[A-Za-z_][A-Za-z0-9_]{2,}+\(\)?",
    "constraints": r"(?=[一-鿿mnorf])(?:必须|不能|不要|禁止|一定|只允许|至少|最多|保留|完整|优先|不得|must|never|only|required|forbidden)",
}
# The same, quicker to search for. Where no match begins, one look-up of a character says so; a run of word
# characters without what must follow it is walked from its start only, or from where the last match ended (\G).
QUICK = {
    "numbers": rf"(?-i:{other_ascii(DIGITS + '$')})" r"(?<![\w.])(?:\d+(?:\.\d+)?%?|[$¥]\s*\d+(?:\.\d+)?|\d+(?:\.\d+)?\s*(?:ms|s|kg|mb|gb|k|m|万|亿))(?![\w.])",
    "paths": rf"(?-i:{other_ascii('/_.-' + ALNUM)})"
    r"(?:(?:/[\w.\-一-鿿]+){2,}|[A-Za-z]:\\(?:[^\\\s]+\\?)+|(?:(?<![\w.\-])|\G)[\w.\-]+\.(?:py|js|ts|tsx|jsx|json|md|yaml|yml|txt|csv|xlsx|pdf))",
    "urls": r"(?=[h])https?://[^\s)\]}>\"，。；：、]+",
    "emails": rf"(?-i:{other_ascii('._%+-' + ALNUM)})" r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "code_symbols": rf"(?-i:{other_ascii('_' + ALNUM)})"
    r"(?:(?=[acdfilrsuv])\b(?:def|class|import|from|return|async|await|function|const|let|var|SELECT|INSERT|UPDATE|DELETE)\b|(?<![A-Za-z_])[A-Za-z_][A-Za-z0-9_]{2,}+\(\)?)",
    "constraints": rf"(?-i:{other_ascii('mnorfMNORF')})" r"(?=[一-鿿mnorf])(?:必须|不能|不要|禁止|一定|只允许|至少|最多|保留|完整|优先|不得|must|never|only|required|forbidden)",
}
WEIGHTS = {"numbers": 0.20, "paths": 0.20, "urls": 0.12, "emails": 0.12, "code_symbols": 0.20, "constraints": 0.18, "latest_user_keywords": 0.10}
GENERIC = ["必须", "不能", "不要", "禁止", "一定", "保留", "完整", "优先", "不得"]
SPAN_ORDER = ("urls", "emails", "paths", "code_symbols", "numbers", "constraints")
STOPWORDS = [
    "the", "and", "for", "with", "this", "that", "请", "帮我", "一个", "这个", "那个", "就是", "可以", "需要", "进行", "我们", "你", "我",
    "谢谢", "你好", "好的", "就是说", "大概", "一下", "请只", "不需要", "解释", "保留", "核心", "代码",
]
PUNCTUATION = ".,;:，。；："

# Fact and structure patterns.
FACT_UNIT = rf"(?iU)(?-i:{other_ascii(DIGITS)})" r"(?=\d)\b\d[\d,.]*\s*(?:%|％|ms|s|sec|req/sec|GB|MB|KB|TB|vCPU|CPU|RAM|SSD|NVMe|K|M|mo|month|day|week|DAGs?|connections?|instances?|nodes?|brokers?)\b"
NUMBER = "(?U)" + other_ascii(f"{DIGITS}$") + r"[$¥€£]?\d[\d,.]*(?:[KkMm]|%|％)?"
KEY_VALUE = r"(?U)[A-Za-z_][\w\s/-]{0,40}+[:：=→]\s*\S"
#: A whole run of what keys are made of, without a mark after it.
NO_KEY = rf"{other_ascii(ALNUM + '_/-' + chr(9) + chr(10) + chr(11) + chr(12) + chr(13) + ' ')}" r"(?U)(?<![\w\s/-])\s*+[\w/-][\w\s/-]*+(?![:：=→])"
IDENTIFIER = r"(?U)(?=[a-zA-Z])\b[a-zA-Z][a-zA-Z0-9]*+_[a-zA-Z0-9_]+\b"
COMPARE = "[<>]=?|[=!]==?"
BULLET = r"(?mU)^\s*[-•*]\s+\S"
CRITICAL = (
    "throughput", "latency", "p99", "connection", "pool", "cost", "total", "budget", "total budget", "owner", "due", "status", "from", "to", "migrate",
    "risk", "delay", "delayed", "eta", "compliance", "review", "critical path", "combined", "completion", "weighted average", "roughly", "invoice",
    "invoice_id", "customer", "region", "alert_threshold", "estimated_cost", "temperature", "humidity", "rain", "wind", "discount", "validation",
)
COMPACT = (
    (" instances", " inst"), (" instance", " inst"), (" servers", " srv"), (" server", " srv"), (" monthly cost", " cost"), ("Total monthly cost", "Cost"),
    ("Peak throughput", "Throughput"), ("latency target", "latency"), ("DB connection pool", "DB pool"), ("per web server", "/web"),
)
# (each starts a word: not after an ASCII word character)
ENTITY = other_ascii(ALNUM) + r"(?<![A-Za-z0-9_])(?U:\b(?:[A-Z][a-zA-Z]+\b|\d[\d,.]*\b|[a-zA-Z]+\d+\b))"
PLAIN_NUMBER = "(?U)" + other_ascii(DIGITS) + r"(?=\d)\b\d[\d,.]*\b"
DIGIT = other_ascii(DIGITS) + r"(?U:\d)"
MARKERS = ("{", "}", "[", "]", '":', "':")
ACK = r"(?iU)^(?:ok|okay|sure|好的|收到|了解|noted|i see|got it|understood|i'm ready|ready|准备好了|thanks|thank you|谢谢)\s*[.!?。！？]?\s*$"

# Dynamic fields of a prompt, by name.
DYNAMIC = (
    ("iso_date", r"\b\d{4}-\d{2}-\d{2}\b"), ("slash_date", r"\b\d{4}/\d{2}/\d{2}\b"), ("us_date", r"\b\d{2}/\d{2}/\d{4}\b"),
    ("textual_date", r"\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2},?\s+\d{4}\b"), ("cn_date", r"\b\d{4}年\d{1,2}月\d{1,2}日?\b"),
    ("weekday_date", r"\b(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*,?\s+\d{4}-\d{2}-\d{2}\b"), ("cn_weekday_date", r"周[一二三四五六日天]\s*\d{4}-\d{2}-\d{2}"),
    ("uuid", r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"),
    ("session", r"\bsession[_-][A-Za-z0-9_-]{8,}"), ("session", r"\bsid[_-][A-Za-z0-9_-]{8,}"), ("session", r"\breq[_-][A-Za-z0-9_-]{8,}"),
    ("session", r"\btrace[_-][A-Za-z0-9_-]{8,}"), ("session", r"\bconv[_-][A-Za-z0-9_-]{8,}"), ("session", r"\bconv_id[_-][A-Za-z0-9_-]{6,}"),
    ("session", r"\brequest[_-]id[_-][A-Za-z0-9_-]{6,}"), ("timestamp", r"\b[12]\d{9}(?:\.\d{1,6})?\b"), ("timestamp", r"\b[12]\d{12}\b"),
    ("timestamp", r"\b\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?\b"),
)


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def occurrences(text: Column, literal: str) -> Column:
    # (in bytes, whose number is known)
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(literal), F.lit("")))) / len(literal.encode())


def has_any(text: Column, *literals: str) -> Column:
    out = F.lit(False)
    for x in literals:
        out = out | text.contains(x)
    return out


def key_values(text: Column) -> Column:
    """Number of key-value pairs; only texts with one of their marks are searched, and of these no run of words that no mark follows."""
    return F.when(has_any(text, ":", "：", "=", "→"), count(F.regexp_replace(text, NO_KEY, "."), KEY_VALUE)).otherwise(0)


def first_spellings(values: Column) -> Column:
    """Of values (worked out already) that differ in case the first, in order."""
    return let(F.transform(values, lambda x: F.lower(x)), lambda low: F.filter(values, lambda x, i: F.array_position(low, F.get(low, i)) == i + 1))


def ordered_unique(values: Column) -> Column:
    """Values without punctuation at their ends; of spellings that differ in case the first, in order."""
    ends = F.lit(PUNCTUATION)
    cut = F.filter(F.transform(values, lambda x: strip(F.btrim(strip(x), ends))), lambda x: x != "")
    return let(cut, first_spellings)


def matches(text: Column, kind: str) -> Column:
    found = F.slice(ordered_unique(F.regexp_extract_all(text, F.lit(f"(?iU){QUICK[kind]}"), F.lit(0))), 1, 32)
    return F.filter(found, lambda x: ~x.isin(GENERIC) & (F.length(x) > 2)) if kind == "constraints" else found


def ascii_keywords(text: Column) -> Column:
    """Distinct ASCII words of four characters or more, without stopwords, twelve at most."""
    found = F.filter(F.regexp_extract_all(text, F.lit(r"[A-Za-z][A-Za-z0-9_\-]{3,}"), F.lit(0)), lambda x: ~F.lower(x).isin(STOPWORDS))
    # (not bound by let: the keywords are an argument of a Python function, which Spark then fails to take out of the projection)
    first = lambda out, x: F.when(F.exists(out, lambda y: F.lower(y) == F.lower(x)), out).otherwise(F.array_append(out, x))
    return F.slice(F.aggregate(found, F.array().cast("array<string>"), first), 1, 12)


def looks_like_code(line: Column) -> Column:
    def of(s: Column) -> Column:
        return (s != "") & (
            s.rlike("^(?:def |class |if |elif |else:|for |while |return |import |from |try|except|raise |with )")
            | (s.rlike(r"(?U)^[a-zA-Z_]\w*\s*[+\-*/]?=") & ~s.rlike(r"[.!?]$"))
            | s.rlike(r"(?U)^[a-zA-Z_]\w*\(")
            | has_any(s, "{", "}", "->", "=>", "```")
            | (line.startswith("    ") & s.rlike(r"(?U)[a-zA-Z_]\w*\s*[(=]"))
        )

    return let(strip(line), of)


def is_fact_dense(text: Column) -> Column:
    numbers = count(text, NUMBER)
    score = numbers + count(text, FACT_UNIT) * 2.5 + key_values(text) * 2.0 + count(text, BULLET) * 1.5 + (occurrences(text, "→") + occurrences(text, "->")) * 2.0
    return (((F.length(text) < 500) & (numbers >= 3)) | (score > F.greatest(F.length(text) * 0.045, F.lit(6.0)))) & (F.length(strip(text)) >= 20)


def density_score(chunk: Column) -> Column:
    def of(t: Column) -> Column:
        n = F.length(t)
        # all but a few chunks of prose have no digit and no mark
        counted = count(t, PLAIN_NUMBER) * 3.0 + count(t, r"(?U)\d+[%％]") * 2.0 + count(t, r"(?U)[$€¥£]\d") * 2.0
        score = (
            F.when(t.rlike(DIGIT), counted).otherwise(0.0)
            + count(t, r"(?U)(?=[A-Z])\b[A-Z][a-zA-Z]{2,}\b") * 1.5
            + F.when(has_any(t, ":", "：", "=", "→"), count(t, r"(?U)[\w]++[:：=→]")).otherwise(0) * 2.0
            + F.when(t.rlike(DIGIT), count(t, FACT_UNIT)).otherwise(0) * 5.0
            + F.when(has_any(t, "{", "}", "()", "=>", "->", "```"), 3.0).otherwise(0.0)
            - F.when(t.rlike(ACK), 5.0).otherwise(0.0)
            + F.least(n / 50, F.lit(3.0))
        )
        return F.when(n == 0, 0.0).otherwise(score / F.greatest(F.pow(n.cast("double"), F.lit(0.3)), F.lit(1.0)))

    return let(strip(chunk), of)


def fact_score(chunk: Column) -> Column:
    def of(t: Column) -> Column:
        critical = let(F.lower(t), lambda low: F.size(F.filter(F.array(*map(F.lit, CRITICAL)), lambda w: F.contains(low, w))))
        score = (
            count(t, FACT_UNIT) * 10.0 + count(t, NUMBER) * 5.0 + key_values(t) * 8.0 + count(t, IDENTIFIER) * 7.0 + count(t, COMPARE) * 4.0
            + count(t, r"(?U)(?=[A-Z])\b[A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*\b") * 2.0 + count(t, r"(?U)(?=[A-Z])\b[A-Z]{2,}\b") * 2.0 + critical * 4.0
        )
        return F.when(F.length(t) == 0, 0.0).otherwise(score / F.greatest(F.pow(F.length(t).cast("double"), F.lit(0.25)), F.lit(1.0)))

    return let(strip(chunk), of)


def compact_fact(chunk: Column) -> Column:
    s = F.regexp_replace(strip(chunk), r"(?U)^\s*[-•*]\s+", "")
    for a, b in COMPACT:
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.regexp_replace(s, r"(?U)\s+", " ")


def fact_chunks(text: Column) -> Column:
    """Bullet and key-value lines whole, other lines by sentence."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")
    whole = lambda x: x.rlike(r"(?U)^\s*[-•*]\s+\S") | (has_any(x, ":", "：", "=", "→") & x.rlike(KEY_VALUE))
    parts = lambda x: F.filter(F.transform(F.split(x, r"(?U)(?<=[.!?。！？])\s+"), strip), lambda y: y != "")
    return F.flatten(F.transform(lines, lambda x: F.when(whole(x), F.array(x)).otherwise(parts(x))))


def specs_score(text: Column) -> Column:
    return (
        count(text, r"(?U)[\w]+[:：=]\s*\S") * 2 + count(text, BULLET) * 1.5 + count(text, PLAIN_NUMBER)
        + count(text, r"(?iU)\b\d+\s*(?:GB|MB|ms|vCPU|req|min|sec|hour|day|month)\b") * 3
    )


def code_score(text: Column) -> Column:
    return (
        occurrences(text, "```") * 50 + count(text, r"(?U)\b(?:def |class |function |const |let |var |import )") * 10
        + count(text, r"[{}\[\]();]") * 2 + count(text, r"(?mU)^    \S") * 3
    )


def json_marks(text: Column) -> Column:
    return sum((occurrences(text, x) for x in ("{", "}", "[", "]", '":', "null", "true", "false")), F.lit(0.0))


def is_json(text: Column) -> Column:
    """Whether a parser takes the text (it refuses repeated keys and NaN, and stops at the first value's end)."""
    return F.try_parse_json(text).isNotNull()


def content_type(text: Column) -> Column:
    s = strip(text)
    n = F.length(s)
    quotes = occurrences(s, '"') + occurrences(s, "'")

    def inner(a: str, b: str) -> Column:
        start, end = F.instr(s, a), n - F.instr(F.reverse(s), b) + 1
        return (start > 0) & (F.instr(s, b) > 0) & (end > start) & is_json(F.substring(s, start, end - start + 1))

    return (
        F.when(n < 30, "short")
        .when(F.substring(s, 1, 1).isin("{", "[") & is_json(s), "json")
        .when((n > 100) & (quotes / n > 0.02), F.when(inner("{", "}") | inner("[", "]"), "json").otherwise("mixed"))
        .otherwise("dialog")
    )


def _recall(a: Column, b: Column, pattern: str) -> Column:
    x, y = (F.array_distinct(F.regexp_extract_all(t, F.lit(pattern), F.lit(0))) for t in (a, b))
    return let(x, lambda x: F.when(F.size(x) == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(x)))


def entity_recall(original: Column, compressed: Column) -> Column:
    return _recall(original, compressed, ENTITY)


def number_precision(original: Column, compressed: Column) -> Column:
    return _recall(original, compressed, PLAIN_NUMBER)


def structure(original: Column, compressed: Column) -> Column:
    """Mean share of each bracket and key mark that is still there."""
    shares = F.array_compact(F.array(*(F.when(original.contains(m), F.least(occurrences(compressed, m), occurrences(original, m)) / occurrences(original, m)) for m in MARKERS)))
    return F.when(F.size(shares) == 0, 1.0).otherwise(F.aggregate(shares, F.lit(0.0), lambda t, x: t + x) / F.size(shares))


def recalls(original: Column, compressed: Column) -> dict[str, Column]:
    """The shares that an evaluation weighs (1 for a blank original), and whether the original is blank."""
    blank = ~not_blank(original)
    parts = {"entity_recall": entity_recall, "number_precision": number_precision, "structural_preservation": structure}
    return {"blank": blank} | {k: F.when(blank, 1.0).otherwise(f(original, compressed)) for k, f in parts.items()}


def verdict(found: dict[str, Column], threshold: float = 0.70) -> dict[str, Column]:
    """Scores, verdict (null for a blank original) and losses in hundredths, halves to even, of :func:`recalls`."""
    blank, er, np_, sp = found.values()
    overall = F.when(blank, 1.0).otherwise(0.40 * er + 0.35 * np_ + 0.25 * sp)
    losses = {k: F.bround((1 - v) * 100).cast("long") for k, v in zip(("entity_loss", "number_loss", "structure_loss"), (er, np_, sp))}
    scores = {k: v for k, v in found.items() if k != "blank"}
    return scores | {"overall_score": overall, "passed": F.when(~blank, overall >= threshold)} | losses


def evaluate(original: Column, compressed: Column, threshold: float = 0.70) -> dict[str, Column]:
    """:func:`verdict` of a text; where rows are many, its recalls are better made columns first."""
    return verdict(recalls(original, compressed), threshold)


def dynamic_fields(text: Column) -> Column:
    """(name, value) of each dynamic field, pattern by pattern, in order of place."""

    def found(name: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(f"(?U){pattern}"), F.lit(0)), lambda v: F.struct(F.lit(name).alias("name"), v.alias("value")))

    return F.concat(*(found(*x) for x in DYNAMIC))


def canonical(text: Column) -> Column:
    """The text with each dynamic field replaced by its name in braces."""
    return replace_all(text, *((f"(?U){p}", f"{{{n}}}") for n, p in DYNAMIC))


def _without_units(text: Column) -> Column:
    s = strip(text)
    for a, b in ((",", ""), ("$", ""), ("EUR", ""), ("%", ""), ("ms", ""), ("GB", ""), ("KB", ""), ("K", "000"), ("k", "000"), ("M", "000000"), ("t", "")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return strip(s)


def number_of(text: Column) -> Column:
    """The number a phrase stands for: units and separators dropped, K and M expanded, number words; null if none."""
    words = ("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen").split()
    values = {w: float(i) for i, w in enumerate(words)} | {w: 10.0 * (i + 2) for i, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split())}
    table = F.create_map(*(F.lit(x) for kv in values.items() for x in kv))

    def of(s: Column) -> Column:
        def worded(low: Column) -> Column:
            hundred = F.try_element_at(table, F.regexp_replace(low, " hundred$", "")) * 100
            return F.coalesce(F.try_element_at(table, low), F.when(low.endswith(" hundred"), hundred), s.try_cast("double"))

        return let(strip(F.regexp_replace(F.lower(s), r"(?U)[-\s]+", " ")), worded)

    return let(_without_units(text), of)
