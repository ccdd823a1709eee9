"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import COST, NUMERIC, PREFIX, SEVERITY, WEIGHTS
from .dialect import WS, trimmed


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]", "")


def normalize_key(type_: Column, value: Column) -> Column:
    """What makes two values the same: digits for numbers, else lower case without blanks around."""
    return F.when(type_.isin(*NUMERIC), digits(value)).otherwise(trimmed(F.lower(value)))


def luhn(value: Column) -> Column:
    """13 to 19 digits with a right check digit, not all the same."""
    d = digits(value)
    return F.char_length(d).between(13, 19) & ~d.rlike(r"\A(\d)\1+\z") & F.call_function("luhn_check", d)


def aba(value: Column) -> Column:
    """Nine digits with a right routing check sum, not all zero."""
    at = lambda i: F.substring(value, i + 1, 1).cast("int")
    total = 3 * (at(0) + at(3) + at(6)) + 7 * (at(1) + at(4) + at(7)) + at(2) + at(5) + at(8)
    return F.when(value.rlike(r"\A\d{9}\z") & ~value.rlike(r"\A0+\z"), total % 10 == 0).otherwise(False)


def shannon_entropy(value: Column) -> Column:
    """Bits a character."""
    chars = F.split(value, "")
    n = F.char_length(value)
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda h, c: h - share(c) * F.log2(share(c)))


def last_after(value: Column, mark: str) -> Column:
    return F.substring_index(value, mark, -1)


def mask_value(type_: Column, value: Column) -> Column:
    """The value with all but a hint hidden."""
    d = F.right(digits(value), F.lit(4))
    dots = lambda n: "•" * n
    first = F.substring(value, 1, 1)
    return (
        F.when(type_ == "EMAIL", F.concat(first, F.lit(dots(6) + "@"), last_after(value, "@")))
        .when(type_ == "PHONE", F.concat(F.lit(f"{dots(3)}-{dots(3)}-"), d))
        .when(type_ == "SSN", F.concat(F.lit(f"{dots(3)}-{dots(2)}-"), d))
        .when(type_ == "CREDIT_CARD", F.concat(F.lit(f"{dots(4)} "), d))
        .when(type_ == "BANK", F.concat(F.lit(dots(5)), d))
        .when(type_ == "API_KEY", F.when(F.char_length(value) > 7, F.concat(F.substring(value, 1, 3), F.lit(dots(4)), F.right(value, F.lit(4)))).otherwise(dots(8)))
        .when(type_ == "PASSWORD", dots(8))
        .when(type_ == "ADDRESS", F.trim(F.concat(F.regexp_extract(value, r"\A\d+", 0), F.lit(f" {dots(5)}"))))
        .when(type_ == "DATE_OF_BIRTH", f"{dots(2)}/{dots(2)}/{dots(4)}")
        .when(type_ == "IP_ADDRESS", F.concat(F.lit(f"{dots(3)}.{dots(3)}.{dots(3)}."), last_after(value, ".")))
        .otherwise(F.concat(first, F.lit(dots(6))))
    )


def looked_up(type_: Column, values: dict) -> Column:
    """The value of a small fixed dimension."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), type_)


def severity_of(type_: Column) -> Column:
    return looked_up(type_, SEVERITY)


def weight_of(severity: Column) -> Column:
    return looked_up(severity, WEIGHTS)


def cost_of(type_: Column) -> Column:
    return looked_up(type_, COST)


def prefix_of(type_: Column) -> Column:
    return looked_up(type_, PREFIX)


def normalize_prompt(text: Column) -> Column:
    return trimmed(F.regexp_replace(text, f"[{WS}]+", " "))


def json_string(c: Column) -> Column:
    """A string as JSON writes it."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r'(?s)\A\{"x":(.*)\}\z', 1)


def conversation_hash(site: Column, conversation: Column) -> Column:
    return F.sha2(F.concat(F.lit("["), json_string(site), F.lit(","), json_string(conversation), F.lit("]")), 256)


def message_hash(conversation: Column, text: Column, occurrence: Column) -> Column:
    """The id of a sent message: of its hashed conversation, its normal text and how often that came before."""
    return F.sha2(F.concat(F.lit("["), json_string(conversation), F.lit(","), json_string(normalize_prompt(text)), F.lit(","), occurrence.cast("string"), F.lit("]")), 256)


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over UTF-16 units, as hex digits without leading zeros."""
    units = F.filter(F.split(F.regexp_replace(F.hex(F.encode(text, "UTF-16BE")), "(.{4})", "$1,"), ","), lambda x: x != "")
    code = lambda x: F.conv(x, 16, 10).cast("bigint")
    mask = F.lit(0xFFFFFFFF)
    n = F.aggregate(units, F.lit(2166136261).cast("bigint"), lambda n, x: (n.bitwiseXOR(code(x)) * F.lit(16777619)).bitwiseAND(mask))
    return F.lower(F.hex(n))


def url_component(c: Column) -> Column:
    """Percent-encoded as browsers encode a part of a URL."""
    out = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    for mark, code in (("!", "%21"), ("'", "%27"), ("(", "%28"), (")", "%29"), ("~", "%7E")):
        out = F.replace(out, F.lit(code), F.lit(mark))
    return out


def iso_time(c: Column) -> Column:
    """A timestamp, or null where it is no time after 1970."""
    t = F.try_to_timestamp(c)
    return F.when(t > F.timestamp_millis(F.lit(0)), t)


def epoch_time(seconds: Column) -> Column:
    """From seconds since 1970; null unless within 0 and the largest time of the format."""
    ms = seconds.cast("double") * 1000
    return F.when((ms > 0) & (ms <= 8.64e15) & ~F.isnan(ms), F.timestamp_millis(F.floor(ms).cast("bigint")))


def relative_time(then: Column, now: Column) -> Column:
    """How long ago, in words: the largest of minutes, hours and days."""
    minutes = F.greatest(F.lit(0), F.floor((F.unix_millis(now) - F.unix_millis(then)) / 60000))
    said = lambda n, unit: F.concat(F.floor(n).cast("string"), F.lit(f" {unit} ago"))
    days = F.when(minutes < 2880, said(minutes / 1440, "day")).otherwise(said(minutes / 1440, "days"))
    return F.when(minutes < 1, "Just now").when(minutes < 60, said(minutes, "min")).when(minutes < 1440, said(minutes / 60, "hr")).otherwise(days)


def rounded(c: Column) -> Column:
    """To the nearest whole number, halves up."""
    return F.floor(c + 0.5)


def to_utf16_offset(text: Column, offset: Column) -> Column:
    """An offset in code points as one in UTF-16 units: characters beyond the first plane count twice."""
    beyond = F.regexp_replace(F.substring(text, F.lit(1), offset), "[^\U00010000-\U0010ffff]", "")
    return (offset + F.char_length(beyond)).cast("int")
