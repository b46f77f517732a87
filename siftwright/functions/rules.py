"""Noise rules as column expressions: fillers, tool metadata, fragments and line filters."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from string import ascii_letters, digits

from pyspark.sql import Column
from pyspark.sql import functions as F

# Discourse fillers, matched anywhere and in this order, without regard to case.
FILLERS_CN = (
    "那么[，,]?", "顺便(?:说一下|提一下|加一下)?", "能加", "可以加", "能不能加", "就是说[，,]?", "就是[，,]?", "其实[，,]?", "反正[，,]?",
    "基本上[，,]?", "怎么说呢[，,]?", "怎么说[，,]?", "就是就是", "那个[，,]?", "这个[，,]?", "那种[，,]?", "那种的[，,]?", "这种[，,]?",
    "这个东西[，,]?", "那个东西[，,]?", "这些东西[，,]?", "那些东西[，,]?", "具体来说[，,]?", "严格来说[，,]?", "简单来说[，,]?", "总的来说[，,]?",
    "总之[，,]?", "我觉得[，,]?", "我认为[，,]?", "我想[，,]?", "依我看[，,]?", "按理说[，,]?", "老实说[，,]?", "说实在的[，,]?",
    "请(?:帮我|协助|做|实现|处理)?", "麻烦(?:你)?", "(?:你)?帮我", "麻烦你", "劳驾", "很好[，,]?", "太好了[，,]?", "太棒了[，,]?", "不错[，,]?",
    "好的?[，,]?", "接下来", "然后", "顺便说一下", "顺便提一下", "对了[，,]?", "另外[，,]?", "补充一下", "话说回来", "说到这个", "这样吧",
    "一个完整的", "完整的", "功能齐全的", "功能完善的", "一个完善的", "完善的", "详细的", "一个详细的", "一个强大的", "强大的", "高效的",
    "一个高效的", "简单易用的", "简单的", "一个好的",
    *(rf"(?:^|(?<=\s)){c}(?:$|(?=\s|[，,。.！!？?]))" for c in "了吧呢啊呀嘛"),
    "不好意思", "抱歉", "对不起", "辛苦了?", "如果可以的话", "要是可以的话", "若可以", "如果方便的话", "在方便的时候", "有空的话", "行", "嗯+",
    "哦+", "噢+", "了解", "明白", "知道了?", "收到", "确实", "的确", "确实如此", "没错", "是的?", "对的?", "谢谢", "感谢", "多谢", "thank you", "thanks",
)
FILLERS_EN = (
    "please", "could you", "would you", "can you", "would it be possible", "if you don't mind", "when you get a chance", "at your convenience",
    "thanks", "thank you", "thx", "cheers", "ok", "okay", "sure", "alright", "got it", "understood", "by the way", "also", "additionally",
    "furthermore", "moreover", "I think", "I believe", "I feel like", "it seems like", "maybe", "perhaps", "probably", "hi", "hello", "hey", "greetings",
)
# Lines of tool metadata, system tags, verbs.
TOOL_LINES = (
    r"^HTTP/[\d.]+\s+\d+",
    r"^(?:Content-Type|Content-Length|Authorization|Accept|User-Agent|Referer):\s*",
    r"^(?:GET|POST|PUT|DELETE|PATCH|OPTIONS|HEAD)\s+",
    r"^\s*(?:status|status_code|statusCode|Status|code):\s*\d+\s*$",
    r"^\s*(?:request_id|requestId|request-id|trace_id|traceId|trace-id|x-request-id|x-trace|x-trace-id|x-b3-traceid):\s*[a-zA-Z0-9_-]+\s*$",
    r"^\s*(?:latency|duration|elapsed|response_time|took|timing):\s*[\d.]+\s*(?:ms|s|seconds|msec)?\s*$",
    r"^\s*(?:x-ratelimit|rate.?limit|retry.?after)[^\n]*$",
    r"^\s*(?:connection|keep-alive|transfer-encoding|cache-control|etag|x-powered-by|x-frame-options)[^\n]*$",
    r"^\s*(?:server|date|x-request-id|x-trace-id|x-b3-traceid|x-envoy-upstream-service-time|x-ratelimit-limit|x-ratelimit-remaining|x-ratelimit-reset)[^\n]*$",
)
SYSTEM_TAGS = (r"<system_hint>.*?</system_hint>", r"<attribution>.*?</attribution>", r"<antm:[^>]*>.*?</antm:[^>]*>", r"<system>.*?</system>", r"\[SYSTEM\].*?\[/SYSTEM\]")
ATTRIBUTION = (r"<antm:[^>]*>.*?</antm:[^>]*>", r"<attribution>.*?</attribution>", r"<system_hint>.*?</system_hint>")
VERBS_CN = "写|创建|删除|修改|运行|执行|查询|搜索|分析|实现|优化|重构|调试|修复|安装|部署|配置|测试|比较|推荐|解释|说明|翻译|总结|生成|下载|上传|合并|检查|验证"
VERBS_EN = (
    "write|create|delete|modify|run|execute|search|analyze|implement|optimize|refactor|debug|fix|install|deploy|configure|test|compare|recommend|explain|"
    "translate|summarize|generate|download|upload|merge|check|verify|help|add|remove|update|set|get|find|show|list|open|close|enable|disable"
)
ERRORS = r'(?=[ETFraAVKI])(?:Error|Exception|Traceback|File "|raise |assert |AttributeError|TypeError|ValueError|KeyError|IndexError|ImportError)'
TECHNICAL = r"\b(?:Python|TypeScript|JavaScript|function|class|import|return|async|await|const|let|var|def |class |if |else|for |while )\b"
COUNTED = "(?=[一-鿿])(写|创建|做|实现|生成|建|搭|加|添加|增加|插入|构建|构造|新建)(?:一个|个|一下)"
ACKNOWLEDGED = "^(?:好的?|行|嗯|确实|另外|对了|补充|还有|顺便|很好|太好了|不错)"
KEPT_NOTES = "(?:TODO|FIXME|NOTE|WARNING|HACK|关键|核心|结论)"



ALNUM = ascii_letters + digits
#: What (?iu) takes for a letter besides its two cases.
_ALSO = {"i": "İı", "k": "\u212a", "s": "ſ"}


def _cases(letter: str) -> str:
    return letter.lower() + letter.upper() + _ALSO.get(letter.lower(), "") if letter.isalpha() else letter


def _unless(ruled_out: str) -> str:
    """No match starts at one of these ASCII characters: a look-up in a table, made for single characters, not for ranges."""
    return f"(?![{''.join(f'{chr(92)}x{ord(x):02x}' for x in ruled_out)}])"


def other_ascii(firsts: str) -> str:
    """Where no ASCII character but these can open a match."""
    return _unless("".join(x for x in map(chr, range(128)) if x not in firsts))


def _by_first(patterns: tuple[str, ...]) -> str:
    """The alternation grouped by first character: two patterns can only meet at one place if they share it.

    Within a group the order stays, so the same alternative wins; others are ruled out by one character.
    """
    return "|".join(f"{re.escape(k)}(?:{'|'.join(x[1:] for x in v)})" if k else "|".join(v) for k, v in _groups(patterns).items())


def _groups(patterns: tuple[str, ...]) -> dict[str, list[str]]:
    found: dict[str, list[str]] = {}
    for p in patterns:
        found.setdefault(p[0].lower() if p[0] not in "(\\" else "", []).append(p)
    return found


def _by_two(patterns: tuple[str, ...]) -> str:
    """Like :func:`_by_first`, for Latin words in any case; others are ruled out by two characters, looked for in a few steps."""
    one = [(k, f"[{_cases(k)}](?=[{''.join(map(_cases, sorted({x[1].lower() for x in v})))}])(?iu:{'|'.join(x[1:] for x in v)})") for k, v in sorted(_groups(patterns).items())]
    parts = [one[i : i + 4] for i in range(0, len(one), 4)]
    return "|".join(f"(?=[{''.join(_cases(k) for k, _ in part)}])(?:{'|'.join(x for _, x in part)})" for part in parts)


# two patterns that end in a repeat of their first character stay whole
_WHOLE = tuple(p for p in FILLERS_CN if len(p) == 2 and p[1] == "+")
_PLAIN = tuple(p for p in (*FILLERS_CN, *FILLERS_EN) if p not in _WHOLE)
#: A place is ruled out by its first character: Latin fillers by their letters, the others by the CJK block (which has no cases).
_LATIN = tuple(p for p in _PLAIN if p[0].isascii() and p[0].isalpha())
_FIRSTS = "".join(map(_cases, sorted({p[0].lower() for p in _LATIN})))
_CJK = tuple(p for p in _PLAIN if p not in _LATIN)
FILLER = f"{other_ascii(_FIRSTS)}(?:{_by_two(_LATIN)}|(?=[一-鿿])(?:{_by_first(_CJK)}|{'|'.join(_WHOLE)}))"
#: Searched anywhere in the line, or anchored at its start.
TOOL_LINE = "(?imu)^(?:" + "|".join(f"(?:{p[1:]})" for p in TOOL_LINES) + ")"
TOOL_LINE_START = "(?iu)^(?:" + "|".join(f"(?:{p})" for p in TOOL_LINES) + ")"
#: Unicode white space, as in ``(?U)\\s``.
WHITE = "".join(map(chr, (*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Found in every text with a metadata line, whose stripped lines alone decide: starts of lines, without what must follow them.
_MAY_HAVE_TOOL_LINE = rf"(?imu)^[{WHITE}]*+(?:" + "|".join(f"(?:{p[1:].removesuffix('$').removesuffix('[^' + chr(92) + 'n]*').removesuffix(chr(92) + 's*')})" for p in TOOL_LINES) + ")"
_BETWEEN = ",，、；;：:"
_BLANK = WHITE.replace("\n", "")
#: Ends of lines and fragments with the white space around them; white space that isn't one space.
_CUT = f"{other_ascii(_BETWEEN + WHITE)}[{_BLANK}]*+[\n{_BETWEEN}][{WHITE}{_BETWEEN}]*+"
_WIDE = f"{other_ascii(_BLANK)}(?! [!-~])(?:[{_BLANK}]{{2,}}|[{_BLANK.replace(' ', '')}])"


def strip(text: Column) -> Column:
    """Trim all Unicode white space, not just spaces."""
    return F.btrim(text, F.lit(WHITE))


def not_blank(text: Column) -> Column:
    """Whether a text has more than white space, without trimming it."""
    return text.rlike(f"[^{WHITE}]")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def replace_all(text: Column, *pairs: tuple[str, str]) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, *p), pairs, text)


def system_tags(text: Column) -> Column:
    """Tag blocks taken out by each pattern in turn."""
    found, rest = [], text
    for p in SYSTEM_TAGS:
        found.append(F.regexp_extract_all(rest, F.lit(f"(?is){p}"), F.lit(0)))
        rest = F.regexp_replace(rest, f"(?is){p}", "")
    return F.concat(*found)


def without_tags(text: Column) -> Column:
    return replace_all(text, *((f"(?is){p}", "") for p in SYSTEM_TAGS))


def without_attribution(text: Column) -> Column:
    return strip(replace_all(text, *((f"(?s){p}", "") for p in ATTRIBUTION)))


def is_tool_noise(line: Column) -> Column:
    return line.rlike(TOOL_LINE)


def normal_punctuation(text: Column) -> Column:
    return replace_all(text, (r"([！!？?。])\1+", "$1"), (r"(?U)[，,]\s*$", ""))


def strip_fillers(text: Column) -> Column:
    """One pass over all fillers, then counted verbs, punctuation and white space."""
    out = F.regexp_replace(F.regexp_replace(text, FILLER, ""), COUNTED, "$1")
    return strip(F.regexp_replace(normal_punctuation(out), r"(?U)\s+", " "))


def fragments(line: Column) -> Column:
    """Pieces of a line between commas, semicolons and colons, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(line, f"[{_BETWEEN}]"), strip), lambda x: x != "")


def fragment_reason(text: Column) -> Column:
    """First rule of the cascade that a cleaned fragment meets."""
    short = (F.regexp_count(text, F.lit("[一-鿿]")) <= 3) & ~text.rlike("[？?！!]")
    return (
        F.when(text == "", "empty")
        .when(text.startswith("```"), "code_block")
        .when(text.rlike(ERRORS), "error_trace")
        .when(text.rlike(r"(?U)https?://\S+"), "url")
        .when(text.rlike(f"(?=[一-鿿])(?:{VERBS_CN})"), "command_cn")
        .when(text.rlike(rf"(?iU)\b(?:{VERBS_EN})\b"), "command_en")
        .when(text.rlike("[？?]"), "question")
        .when(text.rlike(f"(?U){TECHNICAL}"), "technical")
        .when(text.rlike(r"(?U)^\d+[\d.,]*$"), "numeric")
        .when(short, "residual_fragment")
        .otherwise("default_signal")
    )


#: Confidence of each reason; all but these three are signal.
CONFIDENCE = {
    "system_tag": 1.0, "empty_line": 1.0, "tool_metadata": 0.95, "filler_only": 0.85, "cleaned_from_filler": 0.9, "inline_filler": 0.85, "empty": 1.0,
    "code_block": 1.0, "error_trace": 1.0, "url": 0.95, "command_cn": 0.9, "command_en": 0.9, "question": 0.9, "technical": 0.85, "numeric": 0.8,
    "residual_fragment": 0.75, "default_signal": 0.7,
}
NOISE = ["system_tag", "empty_line", "tool_metadata", "filler_only", "inline_filler", "empty", "residual_fragment"]


def confidence(reason: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in CONFIDENCE.items() for x in kv))[reason]


#: Characters of one step of the walk below: a step that both texts share is passed at once, and what another leaves out is put together before it joins the rest.
STEP = 16


def removed_text(original: Column, cleaned: Column) -> Column:
    """What a greedy walk along both texts leaves out of the cleaned one, trimmed."""

    def walk(both: Column) -> Column:
        old, new = both["old"], both["new"]

        def char(s: Column, c: Column) -> Column:
            same = F.get(new, s["at"]) == c
            return F.struct((s["at"] + F.when(same, 1).otherwise(0)).alias("at"), F.when(same, s["out"]).otherwise(F.concat(s["out"], c)).alias("out"))

        def step(s: Column, i: Column) -> Column:
            part = lambda old_: F.aggregate(old_, F.struct(s["at"].alias("at"), F.lit("").alias("out")), char)
            walked = lambda old_: let(part(old_), lambda p: F.struct(p["at"].alias("at"), F.concat(s["out"], p["out"]).alias("out")))
            same = lambda old_: F.slice(new, s["at"] + 1, STEP) == old_
            passed = lambda old_: F.struct((s["at"] + F.size(old_)).alias("at"), s["out"].alias("out"))
            return let(F.slice(old, i * STEP + 1, STEP), lambda old_: F.when(same(old_), passed(old_)).otherwise(walked(old_)))

        steps = F.sequence(F.lit(0), F.floor((F.size(old) - 1) / STEP).cast("int"))
        return F.aggregate(steps, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda s: s["out"])

    texts = F.struct(F.split(original, "").alias("old"), F.split(cleaned, "").alias("new"))
    return strip(F.transform(F.array(texts), walk)[0])


def segments(content: Column) -> Column:
    """A message's classified segments in order, one expression: system tags, blank and metadata lines, fragments with and without fillers.

    An array of (line, pos, text, reason); of a blank message an empty one.
    """

    def piece(line: Column, pos: Column, text: Column, reason: Column) -> Column:
        return F.struct(line.cast("int").alias("line"), pos.cast("int").alias("pos"), text.alias("text"), reason.alias("reason"))

    def of_fragment(line: Column, frag: Column, p: Column) -> Column:
        def both(clean: Column) -> Column:
            same = F.array(piece(line, p * 2, frag, F.when(clean == "", "filler_only").otherwise(fragment_reason(clean))))
            kept = piece(line, p * 2, clean, F.lit("cleaned_from_filler"))
            gone = piece(line, p * 2 + 1, removed_text(frag, clean), F.lit("inline_filler"))
            return F.when((clean == "") | (clean == frag), same).otherwise(F.filter(F.array(kept, gone), lambda x: x["text"] != ""))

        return F.transform(F.array(strip_fillers(frag)), both)[0]

    def of_line(text: Column, i: Column) -> Column:
        def whole(s: Column) -> Column:
            pieces = F.flatten(F.transform(fragments(text), lambda f, p: of_fragment(i, f, p)))
            return F.when(s == "", F.array(piece(i, F.lit(0), text, F.lit("empty_line")))).when(is_tool_noise(s), F.array(piece(i, F.lit(0), text, F.lit("tool_metadata")))).otherwise(pieces)

        return F.transform(F.array(strip(text)), whole)[0]

    tags = F.transform(system_tags(content), lambda t, i: piece(F.lit(-1), i, t, F.lit("system_tag")))
    lines = F.flatten(F.transform(F.split(without_tags(content), "\n"), of_line))
    return F.when(not_blank(content), F.concat(tags, lines)).otherwise(F.filter(tags, lambda x: F.lit(False)))


#: Whether a fragment without fillers is signal (:func:`fragment_reason`; links have a colon, at which lines are cut).
_SIGNAL = (
    rf"{other_ascii('?!`' + ALNUM)}(?:[？?！!]|(?=[a-zA-Zİıſ])(?:(?=[ETFAVKI]|ra|as){ERRORS}"
    rf"|(?<![A-Za-z0-9_])(?U:\b)(?:(?:{_by_two(tuple(VERBS_EN.split('|')))})(?U:\b)|(?=[PTJfciralvdew])(?U:{TECHNICAL})))"
    rf"|(?=[一-鿿])(?:(?:{VERBS_CN})|(?:[一-鿿][^一-鿿]*+){{4}})|^```|(?U:^\d+[\d.,]*$))"
)


def signal_text(content: Column) -> Column:
    """A message's signal segments joined by spaces; without any, the message as it is.

    The same as the signal among :func:`segments`, without working out the noise: all fragments stand in one text, a line
    each, so every rule is one pass over the message.
    """

    def piece(frag: Column, cleaned: Column) -> Column:
        return let(F.trim(cleaned), lambda c: F.when((c != "") & ((c != frag) | c.rlike(_SIGNAL)), c))

    def kept(frags: Column) -> Column:
        cleaned = F.regexp_replace(F.regexp_replace(frags, FILLER, ""), COUNTED, "$1")
        cleaned = replace_all(cleaned, (r"([！!？?。])\1+", "$1"), (_WIDE, " "))
        return F.array_join(F.zip_with(F.split(frags, "\n"), F.split(cleaned, "\n"), piece), " ")

    def of_text(text: Column) -> Column:
        lines = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~is_tool_noise(strip(x))), "\n")
        lines = F.when(text.rlike(_MAY_HAVE_TOOL_LINE), lines).otherwise(text)
        return let(strip(F.regexp_replace(lines, _CUT, "\n")), kept)

    tagged = content.contains("<") | content.contains("[")
    return let(let(F.when(tagged, without_tags(content)).otherwise(content), of_text), lambda t: F.when(t != "", t).otherwise(content))


def plugin_rules(text: Column) -> Column:
    """Blank runs, debug lines, terminal colours, very long links, runs of spaces."""
    return replace_all(
        text, (r"\n{3,}", "\n\n"), (r"(?mU)^(?:DEBUG|TRACE|VERBOSE)\s*:.*$", ""), (r"\x1b\[[0-9;]*m", ""), (r"(?U)https?://\S{200,}", "[long_url]"), (" {3,}", "  ")
    )


def _joined(lines: Column, otherwise: Column) -> Column:
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise(otherwise)


def reduce_assistant(text: Column) -> Column:
    """Lines of an old reply worth keeping, or its first 80 characters."""

    def keep(s: Column) -> Column:
        return (s != "") & (s.startswith("```") | s.rlike(ERRORS) | ((F.length(s) < 80) & ~s.rlike(ACKNOWLEDGED)) | s.rlike(KEPT_NOTES))

    kept = F.filter(F.split(text, "\n"), lambda x: let(strip(x), keep))
    return let(kept, lambda lines: _joined(lines, F.concat(F.substring(text, 1, 80), F.lit("..."))))


def reduce_tool(text: Column) -> Column:
    """Lines of an old tool reply without blank ones and metadata; all of it if nothing else is left."""
    kept = lambda x: let(strip(x), lambda s: (s != "") & ~s.rlike(TOOL_LINE_START))
    return let(F.filter(F.split(text, "\n"), kept), lambda lines: _joined(lines, text))


def clean_tool(text: Column) -> Column:
    """A tool reply without metadata lines, and without blank lines that follow one."""
    state = F.aggregate(
        F.split(text, "\n"),
        F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("out")),
        lambda s, x: F.when(
            strip(x) == "", F.struct(s["inside"].alias("inside"), F.when(s["inside"], s["out"]).otherwise(F.array_append(s["out"], x)).alias("out"))
        )
        .when(strip(x).rlike(TOOL_LINE_START), F.struct(F.lit(True).alias("inside"), s["out"].alias("out")))
        .otherwise(F.struct(F.lit(False).alias("inside"), F.array_append(s["out"], x).alias("out"))),
        lambda s: s["out"],
    )
    return F.array_join(state, "\n")


def summarise_instruction(text: Column) -> Column:
    """The first sentence of a repeated instruction, 20 characters at most."""
    first = strip(F.substring(F.split(strip_fillers(text), "[。！!？?\n]")[0], 1, 20))
    return F.when(first == "", F.lit("...")).otherwise(first)


def instruction_key(text: Column) -> Column:
    """The CJK runs of two characters or more of an instruction without its fillers."""
    return F.array_join(F.filter(F.regexp_extract_all(strip_fillers(text), F.lit("[一-鿿]+"), F.lit(0)), lambda x: F.length(x) >= 2), "")
