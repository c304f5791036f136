"""Text functions on columns: tokens, facts, query rewriting, routing words and upload checks."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words, aliases and patterns that results depend on. All are defaults of parameters.
STOP_BIGRAMS = ("如何", "怎么", "应该", "办理", "申请", "什么", "哪里", "可以")
POLITE_PREFIXES = ("请问", "麻烦问一下", "我想知道", "能不能告诉我")
ALIASES = (
    ("一卡通", "校园卡"),
    ("饭卡", "校园卡"),
    ("不见了", "遗失"),
    ("弄丢了", "遗失"),
    ("丢掉了", "遗失"),
    ("重新办理", "补办"),
    ("重新办", "补办"),
    ("重办", "补办"),
    ("换一张", "补办"),
    ("坏了", "异常"),
)
FACT_RULES = (
    ("费用或金额", r"多少钱|多少元|收费|费用|金额|罚款|价格", r"(?:\d+(?:\.\d+)?\s*(?:元|万元))|免费|不收费"),
    ("开放或服务时间", r"几点|开门|关门|开放时间|营业时间|服务时间", r"(?:[01]?\d|2[0-3]):[0-5]\d"),
    ("联系电话", r"联系电话|电话号码|电话是多少|联系方式", r"(?:0\d{2,3}[- ]?)?\d{7,11}"),
    ("办理或审核时长", r"多久|几天|多少天|几日|多少日|几个工作日|几小时|多少小时|几分钟|多少分钟|多长时间", r"\d+(?:\.\d+)?\s*(?:天|日|工作日|小时|分钟)"),
    ("数量或次数", r"多少本|几本|几次|多少次|多少份|几份|最多.*(?:本|次|份)", r"\d+\s*(?:本|册|次|份)"),
    ("赔偿倍数", r"几倍|多少倍|赔偿倍数", r"\d+(?:\.\d+)?\s*倍"),
    ("分数或门槛", r"绩点|多少分|最低.*分|信用分", r"\d+(?:\.\d+)?\s*(?:分|绩点)?"),
    ("截止日期", r"截止日期|截止到哪|哪一天截止|什么时候截止", r"(?:\d{4}[-年/.])?\d{1,2}[-月/.]\d{1,2}日?"),
    ("具体楼栋或房间号", r"房间号|楼栋|具体地址|哪些房间|具体有哪些房间", r"(?:[A-Za-z]?\d{2,4}\s*室)|(?:\d+\s*号?楼)"),
)
WEEKDAYS = (
    ("周一", "周一"),
    ("星期一", "周一"),
    ("monday", "周一"),
    ("周二", "周二"),
    ("星期二", "周二"),
    ("tuesday", "周二"),
    ("周三", "周三"),
    ("星期三", "周三"),
    ("wednesday", "周三"),
    ("周四", "周四"),
    ("星期四", "周四"),
    ("thursday", "周四"),
    ("周五", "周五"),
    ("星期五", "周五"),
    ("friday", "周五"),
    ("周六", "周六"),
    ("星期六", "周六"),
    ("saturday", "周六"),
    ("周日", "周日"),
    ("星期日", "周日"),
    ("星期天", "周日"),
    ("sunday", "周日"),
)
SERVICES = (
    ("校园卡服务中心", "campus_card"),
    ("校园卡", "campus_card"),
    ("一卡通", "campus_card"),
    ("饭卡", "campus_card"),
    ("教务服务中心", "registrar"),
    ("教务处", "registrar"),
    ("教务", "registrar"),
    ("图书馆服务台", "library"),
    ("图书馆", "library"),
    ("学生事务中心", "student_affairs"),
    ("学生事务", "student_affairs"),
    ("学生处", "student_affairs"),
)
CAMPUSES = (("泰山", "east"), ("东区", "east"), ("启林", "west"), ("西区", "west"))
LIVE_WORDS = ("现在", "当前", "今天", "开门", "营业", "开放吗", "排队", "忙不忙", "还能办", "窗口状态")
ABSTENTION_MARKERS = ("暂未找到", "没有提供", "无法确认", "无法从", "证据不足", "为避免编造")
RESERVED_NAMES = ("CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10)))
CONTENT_TYPES = {
    "md": ("text/markdown", "text/plain", "application/octet-stream"),
    "txt": ("text/plain", "application/octet-stream"),
    "pdf": ("application/pdf", "application/octet-stream"),
}
IDENTIFIER = r"(?iuU)\b(?=[A-Z0-9_-]*[A-Z])(?=[A-Z0-9_-]*\d)[A-Z0-9]+(?:[-_][A-Z0-9]+)*\b"
CLOCK = r"(?U)\b(?:[01]?\d|2[0-3]):[0-5]\d\b"
CLAIM = r"(?U)\b[A-Z]{2,}(?:-[A-Z0-9]+)+\b|\b\d{1,2}:\d{2}\b|\b\d+(?:\.\d+)?\s*(?:元|万元|%|天|日|小时|分钟)"


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """Whether ``text`` contains one of ``words``."""
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def first_of(text: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """The value of the first key, in order, that ``text`` contains; null if none."""
    return F.coalesce(*(F.when(text.contains(k), F.lit(v)) for k, v in pairs))


def strip(text: Column) -> Column:
    """Without white space of any script at the ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def casefold(text: Column) -> Column:
    """Lower case for comparison; sharp s counts as ss."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def tokenize(text: Column) -> Column:
    """Lower-case ASCII words as they are; of each CJK run all characters, then all pairs of neighbours."""

    def parts(p: Column) -> Column:
        at = lambda n, width: F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(p, i, F.lit(width)))
        size = F.length(p)
        pairs = F.when(size > 1, at(size - 1, 2)).otherwise(F.array().cast("array<string>"))
        return F.when(p.rlike("^[a-z0-9_]"), F.array(p)).otherwise(F.concat(at(size, 1), pairs))

    runs = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9_]+|[\\x{4e00}-\\x{9fff}]+)"), F.lit(1))
    # runs of a text without CJK characters are its tokens: opening each one takes ten times as long
    return F.when(text.rlike("[\\x{4e00}-\\x{9fff}]"), F.flatten(F.transform(runs, parts))).otherwise(runs)


def python_tokens(text: str) -> list[str]:
    """:func:`tokenize` for helpers that run inside Python."""
    out = []
    for run in re.findall("[a-z0-9_]+|[\u4e00-\u9fff]+", text.lower()):
        out += [run] if run.isascii() else [*run, *map("".join, zip(run, run[1:]))]
    return out


def is_informative(token: Column, stop: Sequence[str] = STOP_BIGRAMS) -> Column:
    """ASCII tokens of two characters or more, and pairs of characters that are not stop words."""
    ascii_word = token.rlike("^[a-z0-9_]+$")
    return (ascii_word & (F.length(token) >= 2)) | (~ascii_word & (F.length(token) == 2) & ~token.isin(*stop))


def informative_terms(tokens: Column, stop: Sequence[str] = STOP_BIGRAMS) -> Column:
    return F.array_distinct(F.filter(tokens, lambda t: is_informative(t, stop)))


def exact_facts(text: Column) -> Column:
    """Distinct identifiers of letters and digits, and clock times, in lower case and sorted."""
    found = F.concat(F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0)), F.regexp_extract_all(text, F.lit(CLOCK), F.lit(0)))
    return F.array_sort(F.array_distinct(F.transform(found, F.lower)))


def rewrite_query(query: Column, prefixes: Sequence[str] = POLITE_PREFIXES, aliases: Sequence[tuple[str, str]] = ALIASES) -> Column:
    """Struct (query, changed, reason): polite openings dropped, aliases replaced in order, blanks collapsed."""
    start = strip(query)
    text = start
    for p in prefixes:
        text = F.when(text.startswith(p), F.regexp_replace(F.substring(text, F.lit(len(p) + 1), F.length(text)), "^[，,：: ]+", "")).otherwise(text)
    used = []
    for old, new in aliases:
        used.append(F.when(text.contains(old), F.lit(f"{old}→{new}")))
        text = F.replace(text, F.lit(old), F.lit(new))
    text = strip(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))
    reason = F.array_join(F.array_compact(F.array(*used)), "；")
    return F.struct(
        F.when(text == "", start).otherwise(text).alias("query"),
        ((text != "") & (text != start)).alias("changed"),
        F.when(reason == "", F.lit("没有可安全替换的别名")).otherwise(reason).alias("reason"),
    )


def missing_precise_fact(query: Column, evidence: Column, rules: Sequence[tuple[str, str, str]] = FACT_RULES) -> Column:
    """Label of the first kind of fact that the query asks for and the evidence lacks; null if none."""
    return F.coalesce(*(F.when(query.rlike(f"(?s){q}" if ".*" not in q else q) & ~evidence.rlike(f"(?U){e}"), F.lit(label)) for label, q, e in rules))


def extract_claims(answer: Column) -> Column:
    """Distinct codes, times and amounts of an answer, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(answer, F.lit(CLAIM), F.lit(0))))


def normalize_weekday(text: Column, weekdays: Sequence[tuple[str, str]] = WEEKDAYS) -> Column:
    """The weekday that an alias stands for; null if it is none."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in weekdays for x in pair)), F.lower(strip(text)))


def extract_weekday(text: Column, weekdays: Sequence[tuple[str, str]] = WEEKDAYS) -> Column:
    """The weekday whose alias a text contains; longer aliases first."""
    return first_of(F.lower(text), sorted(weekdays, key=lambda pair: -len(pair[0])))


def extract_service_code(text: Column, services: Sequence[tuple[str, str]] = SERVICES) -> Column:
    return first_of(text, services)


def extract_campus(text: Column, campuses: Sequence[tuple[str, str]] = CAMPUSES, default: str = "main") -> Column:
    return F.coalesce(first_of(text, campuses), F.lit(default))


def static_clauses(query: Column, live: Sequence[str] = LIVE_WORDS) -> Column:
    """The clauses that do not ask for a live status; the whole query if none is left."""
    clauses = F.filter(F.transform(F.split(query, "[，,。；;！？?!]+"), strip), lambda c: (c != "") & ~contains_any(c, live))
    return F.when(F.size(clauses) > 0, F.array_join(clauses, "，")).otherwise(query)


def is_safe_abstention(answer: Column, forbidden: Column, markers: Sequence[str] = ABSTENTION_MARKERS) -> Column:
    """Has an abstention marker and none of the forbidden facts."""
    return contains_any(answer, markers) & ~F.exists(forbidden, lambda f: casefold(answer).contains(casefold(f)))


def nfc(text: Column) -> Column:
    """Unicode normal form C, for which Spark has no function."""

    @F.pandas_udf("string")
    def normalize(values: pd.Series) -> pd.Series:
        return values.str.normalize("NFC")

    return normalize(text)


def extension(name: Column) -> Column:
    """The lower-case suffix without its dot; empty without one, or for a name that only starts with a dot."""
    return F.lower(F.regexp_extract(name, r"(?s)^.+\.([^.]+)$", 1))


def display_name_error(name: Column) -> Column:
    """Why a display name (in form C, stripped) is refused; null if it is fine. The first of the rules in order."""
    stem = F.regexp_replace(name, r"(?s)(.)\.[^.]*$", "$1")
    inner = F.exists(F.slice(F.split(name, r"\."), F.lit(2), F.greatest(F.size(F.split(name, r"\.")) - 2, F.lit(0))), lambda p: F.lower(p).isin(*CONTENT_TYPES))
    return (
        F.when((name == "") | (F.length(name) > 120), "name_length")
        .when(name.rlike(r"[. ]$"), "name_end")
        .when(name.rlike(r'[/\\:<>"|?*]'), "name_illegal")
        .when(name.rlike(r"\p{C}"), "name_control")
        .when(~extension(name).isin(*CONTENT_TYPES), "unsupported_type")
        .when(inner, "double_extension")
        .when(F.upper(stem).isin(*RESERVED_NAMES), "reserved_name")
    )


def content_type_error(ext: Column, content_type: Column) -> Column:
    """Why a declared content type does not fit an extension; null if it does."""
    kind = F.lower(strip(F.split_part(F.coalesce(content_type, F.lit("")), F.lit(";"), F.lit(1))))
    kind = F.when(kind == "", "application/octet-stream").otherwise(kind)
    fits = F.lit(False)
    for e, kinds in CONTENT_TYPES.items():
        fits = fits | ((ext == e) & kind.isin(*kinds))
    return F.when(~fits, "content_type_mismatch")


def metadata_value_error(value: Column) -> Column:
    return F.when(~strip(value).rlike(r"\A[A-Za-z0-9][A-Za-z0-9_.-]{0,63}\z"), "bad_metadata")


def text_error(text: Column, most_chars: int = 1_000_000) -> Column:
    return (
        F.when(strip(text) == "", "empty_text")
        .when(F.length(text) > most_chars, "text_too_long")
        .when(text.rlike(r"[\p{Cc}&&[^\n\r\t]]"), "control_characters")
    )


def decode_bytes(data: Column, ext: Column, title: Column) -> Column:
    """Struct (text, error) of bytes: UTF-8 with an optional mark, a first heading added where there is none; null bytes give neither.

    What the text says, and how long it is, is :func:`text_error`'s to judge.
    """
    raw = F.try_validate_utf8(data.cast("string"))
    error = (
        F.when(ext == "pdf", "pdf_unsupported")
        .when((F.hex(F.substring(data, 1, 5)) == "255044462D") | (F.instr(F.hex(data), "00") > 0) & F.hex(data).rlike("^(?:..)*?00"), "binary_content")
        .when(data.isNotNull() & raw.isNull(), "not_utf8")
    )
    clean = strip(F.regexp_replace(raw, "^\\x{feff}", ""))
    titled = F.when((ext == "txt") | ~clean.rlike(r"(?m)^#\s+"), F.concat(F.lit("# "), title, F.lit("\n\n"), clean)).otherwise(clean)
    return F.struct(F.when(error.isNull(), titled).alias("text"), error.alias("error"))


def decode_text(data: Column, ext: Column, title: Column) -> Column:
    """:func:`decode_bytes` of an upload, whose text must keep the rules of :func:`text_error` as well."""
    decoded = decode_bytes(data, ext, title)
    text = F.regexp_replace(data.cast("string"), "^\\x{feff}", "")
    error = F.coalesce(decoded["error"], F.when(data.isNull(), "not_utf8"), text_error(text))
    return F.struct(F.when(error.isNull(), decoded["text"]).alias("text"), error.alias("error"))
