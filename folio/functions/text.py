"""Text functions: each takes and returns columns, and stays in the JVM.

Offsets are code points. White space is one class everywhere (``WS``): ASCII white space,
space separators, line and paragraph separators and the byte order mark.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\s\p{Zs}\x{2028}\x{2029}\x{FEFF}]"
_WS_CHARS = " \t\n\r\x0b\x0c\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
NOT_WS = r"[^\s\p{Zs}\x{2028}\x{2029}\x{FEFF}]"


def _chain(text: Column, steps: list[tuple[str, str]]) -> Column:
    return reduce(lambda c, s: F.regexp_replace(c, s[0], s[1]), steps, text)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once for all its uses in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _where_any(text: Column, needed: str, steps: list[tuple[str, str]]) -> Column:
    """The steps, for texts that have something of ``needed``; others, which no step would change, are looked through once."""
    return let(text, lambda t: F.when(t.rlike(needed), _chain(t, steps)).otherwise(t))


def strip(text: Column) -> Column:
    """Trim all white space, not spaces only; null stays null."""
    return F.btrim(text, F.lit(_WS_CHARS))


def compact(text: Column) -> Column:
    """Runs of white space become one space; the ends are trimmed."""
    return strip(_where_any(text, f"[{WS}&&[^ ]]|  ", [(f"{WS}+", " ")]))


def identity_value(text: Column) -> Column:
    """Compact lower-case form by which names are held equal; null is empty."""
    return F.lower(compact(F.coalesce(text, F.lit(""))))


#: Fixed patterns, in the order in which they apply.
_PROMPT_NOISE = [
    (r"(?i)data:image/[a-zA-Z0-9.+-]+;base64,[a-zA-Z0-9+/=\s]+", " "),
    (r"(?i)idb://[a-zA-Z0-9._-]+", " "),
    (r"(?i)<img\b[^>]*>", " "),
    (r"(?i)!\[[^\]]*\]\((data:image[^)]+|idb://[^)]+)\)", " "),
    (r"(?i)\[(?:image|img|media|图片|图像)[：:][^\]]*\]", " "),
    (WS + r"+\n", "\n"),
    (r"\n" + WS + "+", "\n"),
    (r"\n{3,}", "\n\n"),
]


def sanitize(text: Column) -> Column:
    """Take embedded images and internal references out of text meant for a prompt."""
    # Each of the first five patterns needs one of these signs, and no step brings one in.
    has = lambda t: t.contains("<") | t.contains("[") | t.contains("://") | t.contains(":") & t.contains(";")
    bare = let(F.coalesce(text, F.lit("")), lambda t: F.when(has(t), _chain(t, _PROMPT_NOISE[:5])).otherwise(t))
    return strip(_where_any(bare, f"{WS}\n|\n{WS}", _PROMPT_NOISE[5:]))


#: Fixed patterns for quotes and spaces beside Latin letters.
_TYPOGRAPHY = [
    (r"\x{FF02}", '"'),
    (r"\x{FF07}", "'"),
    (r"([A-Za-z0-9])[\x{2018}\x{2019}\x{02BC}]([A-Za-z0-9])", "$1'$2"),
    (r"(^|[\s\p{Zs}(\[{<])[\x{201C}\x{201D}]([A-Za-z0-9])", '$1"$2'),
    (r"([A-Za-z0-9])[\x{201C}\x{201D}](?=($|[\s\p{Zs})\]}>.,!?;:]))", '$1"'),
    (r"([A-Za-z0-9][A-Za-z0-9'\"-]*[.,!?;:])[\x{201C}\x{201D}](?=($|[\s\p{Zs})\]}>]))", '$1"'),
    (r"([A-Za-z0-9])[\x{3000}\x{00A0}]+([A-Za-z0-9])", "$1 $2"),
]

_BLOCK_SPACE = [
    (r"\r\n", "\n"),
    (r"\r", "\n"),
    (r"\x{00A0}", " "),
    (r"[ \t]+\n", "\n"),
    (r"\n[ \t]+", "\n"),
    (r"[ \t]{2,}", " "),
    (r"\n{3,}", "\n\n"),
]


#: Each pattern of _TYPOGRAPHY needs one of these.
_TYPOGRAPHIC = "\uff02\uff07\u2018\u2019\u02bc\u201c\u201d\u3000\u00a0"


def fix_typography(text: Column) -> Column:
    some = lambda t: reduce(lambda a, b: a | b, [F.contains(t, F.lit(c)) for c in _TYPOGRAPHIC])
    return let(text, lambda t: F.when(some(t), _chain(t, _TYPOGRAPHY)).otherwise(t))


def normalize_block(text: Column) -> Column:
    return strip(_where_any(fix_typography(text), r"[\r\x{00A0}]|[ \t][ \t\n]|\n[ \t]|\n\n\n", _BLOCK_SPACE))


def paragraphs(text: Column) -> Column:
    """The non-blank lines of a text, trimmed, as an array."""
    lines = _where_any(fix_typography(text), r"[\r\x{2028}\x{2029}\x{0085}]", [(r"\r\n?", "\n"), (r"[\x{2028}\x{2029}\x{0085}]", "\n")])
    return F.filter(F.transform(F.split(lines, r"\n+"), strip), lambda p: p != "")


def strip_markdown(text: Column) -> Column:
    marks = [
        (r"(?m)^#{1,6}\s+", ""),
        (r"(?m)^\d+\.\s+", ""),
        (r"(?m)^[-*+]\s+", ""),
        (r"\*\*(.+?)\*\*", "$1"),
        (r"\*(.+?)\*", "$1"),
        (r"__(.+?)__", "$1"),
        (r"_(.+?)_", "$1"),
        (r"\n{3,}", "\n\n"),
    ]
    return strip(_chain(F.coalesce(text, F.lit("")), marks))


def conversation_key(book: Column, persona: Column, character: Column) -> Column:
    part = lambda c: F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit("none"))
    return F.concat(F.lit("book:"), part(book), F.lit("::persona:"), part(persona), F.lit("::character:"), part(character))


_KEY = r"^book:(.+?)::persona:(.+?)::character:(.+)$"


def parse_key(key: Column) -> Column:
    """Struct of book, persona and character; ``none`` and text of another shape give null."""
    part = lambda i: F.nullif(F.nullif(F.regexp_extract(key, _KEY, i), F.lit("none")), F.lit(""))
    return F.struct(part(1).alias("book_id"), part(2).alias("persona_id"), part(3).alias("character_id"))


def minute_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm")


def day_key(ts: Column, tz: str = "UTC") -> Column:
    """The local day of an instant as text."""
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit(tz), ts.cast("timestamp_ntz")), "yyyy-MM-dd")


def prompt_record(name: Column, ts: Column, text: Column, quote: tuple[Column, Column, Column] | None = None) -> Column:
    """Sender, minute and compacted text; behind it the ``quote`` (sender, time, content), where its content is not null."""
    record = F.concat(F.format_string("[发送者:%s][%s] ", name, minute_stamp(ts)), compact(F.coalesce(text, F.lit(""))))
    if quote is None:
        return record
    sender, at, content = quote
    quoted = F.concat(F.lit(" [引用:发送者="), F.coalesce(sender, F.lit("")), F.lit(";时间="), F.coalesce(minute_stamp(at), F.lit("")), F.lit(";内容="), compact(content), F.lit("]"))
    return F.concat(record, F.coalesce(quoted, F.lit("")))


def migrate_prompt_record(record: Column) -> Column:
    """A record of old in today's form: compacted, without the role in front, the time without its label."""
    bare = F.regexp_replace(compact(F.coalesce(record, F.lit(""))), r"^\[(?:用户消息|角色消息)\]", "")
    return F.regexp_replace(bare, r"\[时间:([^\]]+)\]", "[$1]")


def sender_name(record: Column) -> Column:
    """The sender of a record, or null."""
    return F.nullif(strip(F.regexp_extract(record, r"^\[发送者:([^\]]+)\]\[[^\]]+\]", 1)), F.lit(""))


def fill_placeholders(text: Column, char: Column, user: Column) -> Column:
    """Put names in for {{char}} and {{user}} in any case; names are taken as they are."""
    def put(c: Column, name: str, value: Column) -> Column:
        parts = F.split(c, r"(?i)\{\{" + name + r"\}\}", -1)
        return F.concat_ws("", F.flatten(F.transform(parts, lambda p, i: F.when(i == 0, F.array(p)).otherwise(F.array(value, p)))))

    return put(put(text, "char", char), "user", user)


#: Fixed character class: Chinese, Japanese and Korean letters, each a token of its own.
CJK = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]"


def token_estimate(text: Column) -> Column:
    """Tokens by rule: one for each CJK letter, one for four other characters; 0 for blank text."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), f"{WS}+", "")
    other = F.length(F.regexp_replace(bare, CJK, ""))
    count = F.length(bare) - other + F.ceil(other / F.lit(4.0))
    return F.when(F.length(bare) == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), count)).cast("long")


def fnv1a32(text: Column) -> Column:
    """FNV-1a over UTF-16 units as 8 hexadecimal digits."""
    return F.lpad(F.lower(F.hex(fnv1a32_value(text))), 8, "0")


def _units(text: Column) -> Column:
    """UTF-16 code units of a text."""
    at = lambda raw: F.when(F.octet_length(raw) > 0, F.sequence(F.lit(0), (F.octet_length(raw) / 2).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    # Encoded once a text, not once a unit.
    return let(F.encode(text, "UTF-16BE"), lambda raw: F.transform(at(raw), lambda i: F.conv(F.hex(F.substring(raw, i * 2 + 1, F.lit(2))), 16, 10).cast("long")))


def fnv1a32_value(text: Column) -> Column:
    mask = F.lit(0xFFFFFFFF)
    return F.aggregate(_units(text), F.lit(0x811C9DC5).cast("long"), lambda h, u: (h.bitwiseXOR(u) * F.lit(16777619)).bitwiseAND(mask))


def hash31(text: Column) -> Column:
    """31-multiplier hash in 32 signed bits: ``h`` and its absolute value in base 36."""
    mask = F.lit(0xFFFFFFFF)
    raw = F.aggregate(_units(text), F.lit(0).cast("long"), lambda h, u: (h * 31 + u).bitwiseAND(mask))
    signed = F.when(raw >= 1 << 31, raw - (1 << 32)).otherwise(raw)
    return F.concat(F.lit("h"), F.lower(F.conv(F.abs(signed).cast("string"), 10, 36)))


def relative_time(ts: Column, now: Column) -> Column:
    ms = F.greatest(F.lit(0), F.unix_millis(now) - F.unix_millis(ts))
    minutes = F.floor(ms / 60000)
    hours = F.floor(minutes / 60)
    return (
        F.when(minutes < 60, F.concat(F.greatest(F.lit(1), minutes).cast("string"), F.lit("分钟前")))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit("小时前")))
        .otherwise(minute_stamp(ts))
    )


def format_bytes(n: Column) -> Column:
    x = n.cast("double")
    unit = F.when(x < 1024, 0).when(x < 1024**2, 1).when(x < 1024**3, 2).otherwise(3)
    value = x / F.pow(F.lit(1024.0), unit)
    name = F.element_at(F.array(*map(F.lit, ("B", "KB", "MB", "GB"))), unit + 1)
    digits = F.when((unit == 0) | (value >= 100), 0).when(value >= 10, 1).otherwise(2)
    shown = F.when(digits == 0, F.format_string("%.0f", value)).when(digits == 1, F.format_string("%.1f", value)).otherwise(F.format_string("%.2f", value))
    return F.when(x.isNull() | F.isnan(x) | (x <= 0), F.lit("0 B")).otherwise(F.concat(shown, F.lit(" "), name))


def safe_file_name(text: Column, fallback: Column | None = None) -> Column:
    """A name of 96 characters at most; where nothing is left the fallback, or without one an empty name, and null stays null."""
    clean = F.regexp_replace(text if fallback is None else F.coalesce(text, F.lit("")), r'[<>:"/\\|?*\x00-\x1F]', "_")
    clean = F.regexp_replace(compact(clean), r"[. ]+$", "")
    return F.substring(clean if fallback is None else F.when(clean == "", fallback).otherwise(clean), 1, 96)


def chapter_number(index: Column) -> Column:
    n = (index + 1).cast("string")
    return F.when(F.length(n) >= 3, n).otherwise(F.lpad(n, 3, "0"))


def query_terms(query: Column) -> Column:
    """Distinct terms in order, 12 at most: Han runs and ASCII words of two or more."""
    found = F.regexp_extract_all(F.lower(sanitize(query)), F.lit(r"(\p{IsHan}{2,}|[a-z0-9]{2,})"), F.lit(1))
    return F.slice(F.array_distinct(found), 1, 12)


def keyword_boost(text: Column, terms: Column) -> Column:
    weight = lambda t: F.when(F.length(t) >= 6, 1.2).when(F.length(t) >= 4, 1.0).otherwise(0.7)
    boost = lambda hay: F.aggregate(terms, F.lit(0.0), lambda s, t: s + F.when(F.contains(hay, t), weight(t)).otherwise(0.0))
    # The text is lowered once a row, not once a term.
    return F.element_at(F.transform(F.array(F.lower(F.coalesce(text, F.lit("")))), boost), 1)


def cosine(a: Column, b: Column) -> Column:
    """Dot product of unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def image_mime(content: Column) -> Column:
    """Image type by the first bytes; null if unknown."""
    h = F.hex(F.substring(content, 1, 12))
    return (
        F.when(h.startswith("89504E47"), "image/png")
        .when(h.startswith("FFD8FF"), "image/jpeg")
        .when(h.startswith("47494638"), "image/gif")
        .when(h.startswith("52494646") & (F.substring(h, 17, 8) == "57454250"), "image/webp")
        .when(h.startswith("424D"), "image/bmp")
    )


# ---- headings that say the same ------------------------------------------------------------------

#: Number words, Roman letters and Chinese numerals.
_WORDS = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())} | {
    w: 10 * i for i, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)
}
_SCALES = {"hundred": 100, "thousand": 1000}
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
_HAN_DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
_HAN_UNITS = {"十": 10, "百": 100, "千": 1000}
_HAN_SCALES = {"万": 10**4, "亿": 10**8}
_HAN = "零〇一二两三四五六七八九十百千万亿0-9"


def _lookup(key: Column, table: dict[str, int]) -> Column:
    """The value of ``key`` or null, by a chain of comparisons that stays in generated code."""
    found = None
    for k, v in table.items():
        found = F.when(key == k, F.lit(v).cast("long")) if found is None else found.when(key == k, F.lit(v).cast("long"))
    return found


def _han_value(text: Column) -> Column:
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    start = F.struct(zero.alias("total"), zero.alias("part"), none.alias("digit"))

    def step(s: Column, c: Column) -> Column:
        digit, unit, scale = (_lookup(c, t) for t in (_HAN_DIGITS, _HAN_UNITS, _HAN_SCALES))
        whole = s["part"] + F.coalesce(s["digit"], zero)
        scaled = F.when(whole == 0, F.lit(1).cast("long")).otherwise(whole) * scale
        return (
            F.when(digit.isNotNull(), F.struct(s["total"].alias("total"), s["part"].alias("part"), digit.alias("digit")))
            .when(unit.isNotNull(), F.struct(s["total"].alias("total"), (s["part"] + F.coalesce(s["digit"], F.lit(1).cast("long")) * unit).alias("part"), none.alias("digit")))
            .otherwise(F.struct((s["total"] + F.coalesce(scaled, zero)).alias("total"), zero.alias("part"), none.alias("digit")))
        )

    folded = F.aggregate(F.split(text, ""), start, step, lambda s: s["total"] + s["part"] + F.coalesce(s["digit"], zero))
    plain = text.rlike("^[0-9]+$")
    # Digits mixed with numerals are not a number.
    return F.when(plain, text.try_cast("long")).when(text.rlike(f"^[{_HAN.replace('0-9', '')}]+$"), folded)


def _han_token(t: Column) -> Column:
    number, unit = f"([{_HAN}]+)", "([章节回卷部篇集幕])"
    prefixed, suffixed = f"^第{number}{unit}?$", f"^{number}{unit}$"
    a, b, c = _han_value(F.regexp_extract(t, prefixed, 1)), _han_value(F.regexp_extract(t, suffixed, 1)), _han_value(t)
    return (
        F.when(t.rlike(prefixed) & a.isNotNull(), F.concat(F.lit("第"), a.cast("string"), F.regexp_extract(t, prefixed, 2)))
        .when(t.rlike(suffixed) & b.isNotNull(), F.concat(b.cast("string"), F.regexp_extract(t, suffixed, 2)))
        .when(c.isNotNull(), c.cast("string"))
        .otherwise(t)
    )


def _roman_token(t: Column) -> Column:
    valid = t.rlike("^(?=.)m{0,4}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$")
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("last"))

    def step(s: Column, c: Column) -> Column:  # from the right: smaller than the one after it counts down
        v = F.coalesce(_lookup(c, _ROMAN), F.lit(0).cast("long"))
        return F.struct((s["sum"] + F.when(v < s["last"], -v).otherwise(v)).alias("sum"), v.alias("last"))

    value = F.aggregate(F.reverse(F.split(t, "")), start, step, lambda s: s["sum"])
    return F.when(valid, value.cast("string")).otherwise(t)


def heading_key(text: Column) -> Column:
    """A form of a heading in which numbers in words, Roman and Chinese numerals are digits.

    ``and`` inside a number goes, on its own it stays; ``hundred`` on its own is 100.
    """
    return heading_key_of(heading_plain(text))


def heading_plain(text: Column) -> Column:
    """A heading in lower case, without signs, words one space apart; its key is empty if this is."""
    plain = F.regexp_replace(F.lower(F.regexp_replace(text, r"^\x{FEFF}", "")), r"[\x{2010}-\x{2015}\x{3000}]", " ")
    return compact(F.regexp_replace(plain, r"""[()\[\]{},.;:!?`~"'\x{2018}\x{2019}\\/|<>+=*^%$#@&_-]+""", " "))


def heading_rest(plain: Column) -> Column:
    """The words of ``heading_plain`` that ``heading_key`` leaves as they are. What it changes becomes no such word, so headings with one key have one rest."""
    numbers = "|".join([*_WORDS, *_SCALES, "and", "[ivxlcdm]+", f"第?[{_HAN}]+[章节回卷部篇集幕]?"])
    return F.trim(F.regexp_replace(plain, rf"(?<![^ ])(?:{numbers})\x{{85}}?(?: |\z)", ""))


def heading_key_of(plain: Column) -> Column:
    """``heading_key`` of a ``heading_plain``."""
    tokens = F.transform(F.filter(F.split(plain, " "), lambda t: t != ""), lambda t: _roman_token(_han_token(t)))
    zero = F.lit(0).cast("long")
    words = F.array().cast("array<string>")

    def state(out: Column, now: Column, total: Column, has: Column, ands: Column) -> Column:
        return F.struct(out.alias("out"), now.alias("now"), total.alias("total"), has.alias("has"), ands.alias("ands"))

    def flush(s: Column) -> Column:
        return F.concat(s["out"], F.when(s["has"], F.array((s["total"] + s["now"]).cast("string"))).otherwise(F.array_repeat(F.lit("and"), s["ands"])))

    def step(s: Column, t: Column) -> Column:
        value, scale = _lookup(t, _WORDS), _lookup(t, _SCALES)
        scaled = F.when(s["now"] == 0, F.lit(1).cast("long")).otherwise(s["now"]) * scale
        return (
            F.when(t == "and", state(s["out"], s["now"], s["total"], s["has"], s["ands"] + 1))
            .when(value.isNotNull(), state(s["out"], s["now"] + value, s["total"], F.lit(True), s["ands"]))
            .when(scale == 100, state(s["out"], scaled, s["total"], F.lit(True), s["ands"]))
            .when(scale == 1000, state(s["out"], zero, s["total"] + scaled, F.lit(True), s["ands"]))
            .otherwise(state(F.concat(flush(s), F.array(t)), zero, zero, F.lit(False), F.lit(0)))
        )

    return F.array_join(F.aggregate(tokens, state(words, zero, zero, F.lit(False), F.lit(0)), step, flush), " ")
