import pytest
from pyspark.sql import functions as F

from newsloom.functions import text as T


def one(spark, column, **values):
    kinds = {str: "string", int: "int", type(None): "string"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("# A [b](c(d)e) ![i](j) <b>x</b>", "A b x"),
        ("x <!-- no\nno --> y https://a.b/c?d e", "x y e"),
        ("{.tabset}\nz", "z"),
        ("a　 \n b", "a b"),
        ("| a | *b* _c_ `d` ~e~ > f |", "a b c d e f"),
        ("", ""),
        (None, ""),
    ],
)
def test_clean_text(spark, raw, clean):
    assert one(spark, T.clean_text(F.col("a")), a=raw) == clean


def test_identifiers_and_ids(spark):
    assert one(spark, T.normalize_identifier(F.col("a")), a="《A b-C》（d）_'\"“”") == "abcd"
    assert one(spark, T.news_id(F.col("a"), F.lit("s"), F.lit("m")), a="p").startswith("news-")
    import hashlib

    assert one(spark, T.news_id(F.col("a"), F.lit("s"), F.lit("m")), a="p") == "news-" + hashlib.sha1(b"p\0s\0m").hexdigest()[:12]
    assert one(spark, T.entity_id(F.lit("place"), F.col("a")), a="A b") == "entity-place-" + hashlib.sha1(b"place:ab").hexdigest()[:12]


def test_sentences_and_occurrences(spark):
    assert one(spark, T.first_sentence(F.col("a")), a=" 一。二！") == "一"
    assert one(spark, T.count_occurrences(F.col("a"), F.lit("aa")), a="aaaaa") == 2
    assert one(spark, T.count_occurrences(F.col("a"), F.lit("")), a="aaaaa") == 0
    assert one(spark, T.han_trigrams(F.col("a")), a="ab，c d") == ["abc", "bcd"]
    assert one(spark, T.han_trigrams(F.col("a")), a="ab") == []
    assert one(spark, T.han_trigrams(F.col("a")), a="为什么") == []


@pytest.mark.parametrize(
    ("text", "date", "precision"),
    [("于2019年7月2日。又2020-01-01", "2019-07-02", "day"), ("at 2020-1-9", "2020-01-09", "day"), ("在 1998 年", "1998-01-01", "year")],
)
def test_explicit_dates(spark, text, date, precision):
    found = one(spark, T.explicit_date(F.col("a")), a=text)
    assert tuple(found) == (date, precision)
    assert one(spark, T.explicit_date(F.col("a")), a="none") is None


def test_dates_and_rounding(spark):
    assert one(spark, T.day_number(F.col("a")), a="1970-01-11") == 10
    assert one(spark, T.day_number(F.col("a")), a="2019-02-31") is None
    assert one(spark, T.round_half_up(F.lit(-2.5)), a=1) == -2
    assert one(spark, T.format_event_date(F.col("a"), F.lit("month")), a="2020-03-04") == "2020 年 3 月"
    assert one(spark, T.percentage(F.lit(1), F.lit(3)), a=1) == 33.33
    assert one(spark, T.percentage(F.lit(1), F.lit(0)), a=1) == 0.0


def test_search_normalisation(spark):
    assert T.normalize_search_value(" ＧＰＴ‑4 / Café ") == "gpt4cafe"
    assert one(spark, T.normalize_search(F.col("a")), a=" ＧＰＴ‑4 / Café ") == "gpt4cafe"
    assert one(spark, T.normalize_search(F.col("a")), a=None) == ""
