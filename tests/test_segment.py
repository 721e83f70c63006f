import pytest
from conftest import rows
from pyspark.sql import functions as F

from newsloom.operators import segment as S
from newsloom.operators.segment import OVERRIDES

BODY = "这是一段足够长的正文，用来说明这一条新闻的来龙去脉，并且超过四十个字，以免被当作空白而丢掉，后面还有一些补充。"


def parse(spark, path, raw, override=None):
    over = spark.createDataFrame([(path, *override)], OVERRIDES) if override else None
    parsed = S.parse_pages(spark.createDataFrame([(path, raw)], "path string, raw string"), over)
    pages, news = S.pages_of(parsed).collect(), S.news_of(parsed).orderBy("fragment.ordinal").collect()
    return (pages[0] if pages else None), news


def test_numbered_headings_and_fragments(spark):
    raw = f"---\ntitle: \"【每日简讯7】今天\"\npublished: true\ndateCreated: 2026-07-24\n---\n\n## 1、第一条\n{BODY}\n\n## 2. 第二条\n{BODY}{BODY}\n"
    page, news = parse(spark, "daily/2026/07/23.md", raw)
    assert (page.publishedAt, page.dateProvenance.source, page.segmentation.strategy) == ("2026-07-23", "repository_path", "daily_numbered_heading")
    assert [n.title for n in news] == ["第一条", "第二条"]
    assert [(n.fragment.startLine, n.fragment.endLine) for n in news] == [(7, 9), (10, 12)]
    rows_again = S.news_of(S.parse_pages(spark.createDataFrame([("daily/2026/07/23.md", raw)], "path string, raw string"))).drop("fragmentText")
    again = S.read_fragments(
        rows_again, spark.createDataFrame([(page.id, raw)], "pageId string, raw string"), strict=False
    ).collect()
    assert all(r.intact for r in again)
    assert all(n.fragmentText in raw for n in news)


def test_short_headings_make_the_page_disappear_and_none_fall_back(spark):
    assert parse(spark, "daily/a.md", "## 1、短\nx")[0] is None
    page, news = parse(spark, "daily/a.md", BODY)
    assert (page.segmentation.strategy, page.segmentation.confidence, page.segmentation.reviewReasons) == ("page_fallback", 0.45, ["numbered_news_headings_not_found"])
    assert len(news) == 1 and page.segmentation.needsReview


def test_reference_description(spark):
    raw = "---\ntitle: t\ndescription: '第一句话说了很多事情。 第二句话也说了很多事情！短。'\n---\n# Tabs\n"
    page, news = parse(spark, "reference/501-600/t.md", raw)
    assert page.segmentation.strategy == "reference_description_sentence"
    line = raw.split("\n")[2]
    assert [line[n.fragment.startColumn - 1 : n.fragment.endColumn] for n in news] == ["第一句话说了很多事情。", "第二句话也说了很多事情！"]
    assert [n.title for n in news] == ["第一句话说了很多事情", "第二句话也说了很多事情"]


def test_interviews_compare_with_the_last_boundary(spark):
    prompt = lambda t: f"<font color=indigo>{t}</font>\n{BODY}\n"
    raw = "---\ntitle: 【晚谈 12】对话\n---\n" + prompt("7月1日，钢铁公司宣布停产") + prompt("为什么会这样？") + prompt("接下来看国际新闻，某国总统辞职") + prompt("7月2日，钢铁公司又宣布复产")
    page, news = parse(spark, "main/1-100/12.md", raw)
    assert page.segmentation.strategy == "main_interview_topic" and page.episode.number == 12.0
    assert [n.fragment.marker for n in news] == ["7月1日，钢铁公司宣布停产", "接下来看国际新闻，某国总统辞职", "7月2日，钢铁公司又宣布复产"]
    assert "为什么会这样" in news[0].fragmentText


def test_horizontal_rules_and_series_prefix(spark):
    block = BODY * 3
    page, news = parse(spark, "main/1-100/13.md", f"---\ntitle: 【晚谈 13】总标题\n---\n\n## 甲事件的经过\n{block}\n\n---\n\n## 乙事件的经过\n{block}\n")
    assert page.segmentation.strategy == "horizontal_rule" and page.title.startswith("【晚谈 13】")
    assert [n.title for n in news] == ["甲事件的经过", "乙事件的经过"]


def test_overrides(spark):
    raw = f"---\ntitle: t\n---\n甲 开头的一行\n{BODY}\n乙 开头的一行\n{BODY}\n"
    assert parse(spark, "main/a.md", raw, (True, None, None, None))[0] is None
    assert parse(spark, "main/a.md", raw, (None, True, None, None))[0].segmentation.strategy == "manual_single"
    page, news = parse(spark, "main/a.md", raw, (None, None, ["乙 开头", "甲 开头"], None))
    assert page.segmentation.strategy == "manual_markers" and [n.title for n in news] == ["甲 开头的一行", "乙 开头的一行"]
    _, news = parse(spark, "main/a.md", raw, (None, None, ["乙 开头", "甲 开头"], ["甲 开头的一行"]))
    assert [n.title for n in news] == ["乙 开头的一行"]
    for bad in ((None, None, ["丙"], None), (None, None, None, ["丙"])):
        with pytest.raises(Exception, match="not found"):
            parse(spark, "main/a.md", raw, bad)


def test_filters_and_odd_input(spark):
    links = "\n".join(f"- [a{i}](b{i}.md)" for i in range(6))
    pages = [("main/n.md", links), ("main/u.md", "---\npublished: FALSE\n---\nx"), ("main/e.md", ""), ("main/null.md", None), (None, "x"), ("main/open.md", "---\ntitle: t\nno end")]
    parsed = S.parse_pages(spark.createDataFrame(pages, "path string, raw string"))
    assert rows(S.pages_of(parsed), "repositoryPath", "title") == [("main/e.md", "e"), ("main/null.md", "null"), ("main/open.md", "open")]
    assert S.parse_pages(spark.createDataFrame([], "path string, raw string")).count() == 0


def test_dates_and_episodes(spark):
    c = S.DEFAULT
    page, _ = parse(spark, "main/x.md", "---\ntitle: 【晚谈 13.5】x\ndateCreated: 2023-01-01\n---\n晚谈：19/7/12 开始")
    assert (page.publishedAt, page.dateProvenance.source, page.episode.number) == ("2019-07-12", "episode_preamble", 13.5)
    page, _ = parse(spark, "main/x.md", "---\ntitle: 【晚谈 2023 特别】x\ndateCreated: 2023-01-05T00:00\n---\nx")
    assert (page.publishedAt, page.dateProvenance.source, page.episode) == ("2023-01-05", "frontmatter", None)
    page, news = parse(spark, "main/x.md", "在2011年，" + BODY)
    assert (page.publishedAt, news[0].date, news[0].datePrecision) == ("1900-01-01", "2011-01-01", "year")
    assert c.series_title


def test_the_plan_has_no_shuffle(spark):
    parsed = S.parse_pages(spark.createDataFrame([("main/a.md", BODY)], "path string, raw string"))
    plan = S.news_of(parsed)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert F is not None
