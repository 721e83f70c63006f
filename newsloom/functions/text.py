"""Scalar text functions as Column expressions, so that they stay in the JVM and next to the scan.

JavaScript's idea of white space is wider than Java's `\\s`; `WS` spells it out. Lengths and cuts count
code points. `\\z` stands for the very end of a text, where Java's `$` would also stop before a final
line break. Null gives null unless a function says otherwise.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, as characters of a class and as a class.
WS_CHARS = r"\s\x0b   -     　﻿"
WS = f"[{WS_CHARS}]"
UNKNOWN_DATE = "1900-01-01"


def trim(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{WS}+|{WS}+\z", "")


def squeeze(text: Column) -> Column:
    """White space collapsed to single blanks, none at the ends; null is empty."""
    return trim(F.regexp_replace(F.coalesce(text, F.lit("")), f"{WS}+", " "))


# What Markdown pages hold beside their prose, in the order in which it is taken out.
MARKUP = (
    (r"<!--[\s\S]*?-->", " "),
    (r"!\[[^\]]*\]\((?:[^()]|\([^()]*\))*\)", " "),
    (r"\[([^\]]+)\]\((?:[^()]|\([^()]*\))*\)", "$1"),
    (r"!\[[^\]]*\]\([^)]+\)", " "),
    (r"\[([^\]]+)\]\([^)]+\)", "$1"),
    (r"<[^>]+>", " "),
    (rf"https?://[^{WS_CHARS}]+", " "),
    (rf"\]\({WS}*", " "),
    (rf"(?m)^{WS}*\{{[^}}]+\}}{WS}*$", " "),
    (r"[#>*_`~|]", " "),
)


def clean_text(text: Column) -> Column:
    """Prose of a Markdown text, on one line; null is empty (F1)."""
    out = F.coalesce(text, F.lit(""))
    for pattern, replacement in MARKUP:
        out = F.regexp_replace(out, pattern, replacement)
    return squeeze(out)


def normalize_identifier(text: Column) -> Column:
    """A label for identity: no white space, quotes, brackets, `_` or `-`, in lower case."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), rf"[{WS_CHARS}《》“”\"'（）()_\-]", ""))


def first_sentence(text: Column) -> Column:
    """What stands before the first sentence end, trimmed."""
    return trim(F.split(text, "[。！？!?；;]", 2)[0])


def paragraphs(body: Column) -> Column:
    """Cleaned paragraphs: a paragraph ends at a line without text."""
    return F.transform(F.split(body, rf"\n{WS}*\n"), clean_text)


def meaningful_paragraph(body: Column, media: str, greeting: str | None = None) -> Column:
    """The first cleaned paragraph of 30 characters that doesn't start with a media word, nor, if there is
    such a one and a greeting is given, with a greeting; else the whole cleaned body (F7, F8)."""
    fit = F.filter(paragraphs(body), lambda p: (F.length(p) >= 30) & ~p.rlike(f"(?i)^(?:{media})"))
    if greeting:  # those that greet come last
        fit = F.concat(F.filter(fit, lambda p: ~p.rlike(f"^(?:{greeting})")), F.slice(fit, 1, 1))
    return F.coalesce(F.get(fit, F.lit(0)), clean_text(body))


def count_occurrences(text: Column, keyword: Column) -> Column:
    """Occurrences that don't overlap; none of an empty keyword."""
    n = F.length(keyword)
    return F.when(n > 0, ((F.length(text) - F.length(F.replace(text, keyword, F.lit("")))) / n).cast("int")).otherwise(F.lit(0))


# Trigrams that say nothing about a topic.
STOP_TRIGRAMS = "这件事 这一次 为什么 怎么办 你觉得 你认为 怎么看 新闻里 消息说 我们看 接下来".split()


def han_trigrams(text: Column, stop: tuple[str, ...] = ()) -> Column:
    """Distinct trigrams of the text's Han characters, letters and digits, without the stop trigrams and an
    archive's own ones (F21)."""
    only = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{IsHan}A-Za-z0-9]", "")
    grams = F.when(
        F.length(only) >= 3, F.transform(F.sequence(F.lit(1), F.greatest(F.length(only) - 2, F.lit(1))), lambda i: F.substring(only, i, F.lit(3)))
    ).otherwise(F.array().cast("array<string>"))
    return F.array_except(F.array_distinct(grams), F.array(*[F.lit(t) for t in (*STOP_TRIGRAMS, *stop)]))


# dates


def pad2(digits: Column) -> Column:
    """At least two digits; longer ones stay whole."""
    return F.lpad(digits, F.greatest(F.length(digits), F.lit(2)), F.lit("0"))


def iso_date(text: Column) -> Column:
    """The first YYYY-MM-DD between other characters than digits, or null."""
    return F.nullif(F.regexp_extract(text, r"(?:^|[^\d])(\d{4}-\d{2}-\d{2})(?:[^\d]|\z)", 1), F.lit(""))


def explicit_date(text: Column) -> Column:
    """(date, precision) that a text names: day in Chinese, day in ISO form, or a year; else null."""
    year = "((?:18|19|20)\\d{2})"
    zh = rf"{year}{WS}*年{WS}*(\d{{1,2}}){WS}*月{WS}*(\d{{1,2}}){WS}*日"
    iso = rf"{year}-(\d{{1,2}})-(\d{{1,2}})"
    only = rf"{year}{WS}*年"

    def day(pattern: str) -> Column:
        part = [F.regexp_extract(text, pattern, i) for i in (1, 2, 3)]
        return F.when(part[0] != "", F.struct(F.concat_ws("-", part[0], pad2(part[1]), pad2(part[2])).alias("date"), F.lit("day").alias("precision")))

    found = F.regexp_extract(text, only, 1)
    return F.coalesce(day(zh), day(iso), F.when(found != "", F.struct(F.concat(found, F.lit("-01-01")).alias("date"), F.lit("year").alias("precision"))))


def date_precision(date: Column) -> Column:
    """`year` for the first of January, which stands for a year alone, else `day`."""
    return F.when(date.endswith("-01-01"), F.lit("year")).otherwise(F.lit("day"))


def day_number(date: Column) -> Column:
    """Days since 1970-01-01 of an ISO date; null if there is no such day."""
    return F.unix_date(F.try_to_date(date, "yyyy-MM-dd"))


def iso_of_day(day: Column) -> Column:
    return F.date_format(F.date_from_unix_date(day.cast("int")), "yyyy-MM-dd")


def round_half_up(x: Column) -> Column:
    """Nearest whole number, halves towards plus infinity."""
    return F.floor(x + F.lit(0.5))


def format_event_date(date: Column, precision: Column) -> Column:
    """A date as people read it, by its precision; what is no date stays as it is."""
    d = F.try_to_date(date, "yyyy-MM-dd")
    return F.coalesce(
        F.when(precision == "year", F.substring(date, 1, 4)).when(precision == "month", F.date_format(d, "yyyy 年 M 月")).otherwise(F.date_format(d, "yyyy年M月d日")),
        date,
    )


# identity


def short_hash(text: Column) -> Column:
    return F.substring(F.sha1(text), 1, 12)


def page_id(path: Column) -> Column:
    return F.concat(F.lit("page-"), short_hash(path))


def news_id(path: Column, strategy: Column, marker: Column) -> Column:
    """Stable when a section is inserted: the ordinal is no part of it."""
    return F.concat(F.lit("news-"), short_hash(F.concat_ws("\u0000", path, strategy, marker)))


def event_id(news: Column) -> Column:
    return F.concat(F.lit("event-"), short_hash(news))


def entity_key(kind: Column, label: Column) -> Column:
    return F.concat(kind, F.lit(":"), normalize_identifier(label))


def entity_id(kind: Column, label: Column) -> Column:
    return F.concat(F.lit("entity-"), kind, F.lit("-"), short_hash(entity_key(kind, label)))


def relation_id(start: Column, end: Column, kind: str = "precedes") -> Column:
    return F.concat(F.lit("relation-"), short_hash(F.concat_ws(":", start, end, F.lit(kind))))


# display


def shorten(text: Column, most: int) -> Column:
    """At most `most` characters and an ellipsis."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("…"))).otherwise(text)


def overflow(items: Column, most: int) -> Column:
    """(shown, more): the first `most` items and how many others there are."""
    return F.struct(F.slice(items, 1, most).alias("shown"), F.greatest(F.size(items) - most, F.lit(0)).alias("more"))


def percentage(part: Column, whole: Column) -> Column:
    """100 * part / whole to two decimals, 0 of nothing."""
    return F.coalesce(F.round(F.try_divide(part * F.lit(100.0), whole.cast("double")), 2), F.lit(0.0))


# search


def normalize_search_value(text: str | None) -> str:
    """NFKD without marks, lower case, without punctuation, symbols and white space."""
    import unicodedata

    if not text:
        return ""
    if text.isascii():
        return "".join(c for c in text.lower() if c.isalnum())
    folded = "".join(c for c in unicodedata.normalize("NFKD", text) if unicodedata.category(c)[0] != "M").lower()
    return "".join(c for c in folded if unicodedata.category(c)[0] not in "PS" and not c.isspace() and c not in "﻿")


def normalize_search(text: Column) -> Column:
    """F5 on a column. Unicode decomposition has no built-in, so this one crosses to Python, in Arrow batches."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(normalize_search_value, na_action=None)

    return run(text)
