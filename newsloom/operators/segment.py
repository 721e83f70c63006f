"""Markdown pages to pages and news: front matter, dates, episodes, and the segmentation strategies.

Everything is local to a page: arrays of lines, higher-order functions and one final explode. There is no
shuffle between the scan and the news rows, whatever the number of pages. Strategies are columns of
their own, guarded so that a page pays for its own root's strategy alone; a stateful scan (a prompt is
compared with the last accepted boundary) is a fold over the prompts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.functions.conventions import DEFAULT, Conventions, alternatives
from newsloom.functions.text import UNKNOWN_DATE, WS

# Numbered headings, coloured interview prompts, rules between blocks, link items.
NUMBERED = rf"^#{{1,3}}{WS}+(?:\[?{WS}*\d+{WS}*[.、．)]{WS}*\]?{WS}*)(.+)\z"
PROMPT = r"(?i)<font\b[^>]*\bcolor\s*=\s*[\"']?\s*indigo\s*[\"']?[^>]*>([\s\S]*?)</font>"
RULE = rf"^{WS}*---{WS}*\z"
LINK_ITEM = rf"(?m)^{WS}*-{WS}+\[[^\]]+\]\([^)]+\.md\)"

OVERRIDES = "path string, exclude boolean, single_news boolean, boundary_markers array<string>, exclude_titles array<string>"
#: A section of a page before its texts are worked out: lines first to last (from 0, last excluded) or, of a
#: sentence of the front matter, its text and columns; title and marker where the strategy gives them; the
#: cleaned text where the strategy had to look at it.
SECTION = "struct<first:int,last:int,title:string,marker:string,prose:string,text:string,startColumn:int,endColumn:int>"
NO_SECTIONS = f"CAST(array() AS array<{SECTION}>)"
STARTS = "array<struct<at:int,title:string,marker:string>>"


def front_matter(pages: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds `lines` (of the body), `body`, `body_line` (its first line's number) and `attributes`
    (key -> value, line, column). Without a closed `---` block the whole text is body. The last of
    several equal keys counts. Null text is empty text."""
    text = F.coalesce(F.col(raw), F.lit(""))
    pages = pages.withColumn("_all", F.split(text, r"\r?\n", -1))
    # the place of the closing fence, 0 if there is none
    fences = F.filter(F.sequence(F.lit(2), F.greatest(F.size("_all"), F.lit(2))), lambda i: T.trim(F.get("_all", i - 1)) == "---")
    pages = pages.withColumn("_close", F.when(T.trim(F.col("_all")[0]) == "---", F.coalesce(F.get(fences, F.lit(0)), F.lit(0))).otherwise(0))
    head = F.when(F.col("_close") > 2, F.slice("_all", F.lit(2), F.col("_close") - 2)).otherwise(F.array().cast("array<string>"))

    def attribute(line: Column, i: Column) -> Column:
        colon = F.instr(line, ":")
        value = F.substring(line, colon + 1, F.length(line))
        trimmed = T.trim(value)
        lead = F.length(value) - F.length(F.regexp_replace(value, f"^{WS}+", ""))
        quote = trimmed.rlike("^['\"]").cast("int")
        return F.struct(
            T.trim(F.substring(line, F.lit(1), colon - 1)).alias("key"),
            F.regexp_replace(trimmed, r"^['\"]|['\"]\z", "").alias("value"),
            (i + 2).alias("line"),
            (colon + 1 + lead + quote).alias("column"),
        )

    entries = F.filter(F.transform(head, lambda x, i: F.when(F.instr(x, ":") > 0, attribute(x, i))), lambda e: e.isNotNull())
    return pages.withColumns(
        {
            "attributes": entries,
            "lines": F.slice("_all", F.col("_close") + 1, F.greatest(F.size("_all") - F.col("_close"), F.lit(0))),
            "body_line": F.when(F.col("_close") > 0, F.col("_close") + 1).otherwise(1),
        }
    ).withColumn("body", F.when(F.col("_close") > 0, F.array_join("lines", "\n")).otherwise(text)).drop("_all", "_close")


def attribute(name: str) -> Column:
    """The entry of a front matter key, the last one if it comes twice, or null."""
    return F.element_at(F.concat(F.array(F.lit(None).cast("struct<key:string,value:string,line:int,column:int>")), F.filter("attributes", lambda e: e["key"] == name)), -1)


def is_navigation(body: Column) -> Column:
    """At least five links to pages and no line of prose of 80 characters."""
    links = F.size(F.regexp_extract_all(body, F.lit(LINK_ITEM), F.lit(0)))
    prose = F.exists(
        F.split(body, r"\r?\n"),
        lambda line: (F.length(T.trim(line)) >= 80) & ~T.trim(line).rlike(r"^[-#<{\[]") & ~T.trim(line).rlike(r"^\[[^\]]+\]\([^)]+\)\z"),
    )
    return (links >= 5) & ~prose


def edition_date(body: Column, c: Conventions) -> Column:
    """The date that an edition states within its first 5,000 characters."""
    head = F.substring(body, 1, 5000)
    compact = rf"{c.series_title}{WS}*[：:]{WS}*(\d{{2,4}}){WS}*[/.年\-]{WS}*(\d{{1,2}}){WS}*[/.月\-]{WS}*(\d{{1,2}}){WS}*日?"
    spoken = rf"大家好[，,\s　]*(?:今天是)?{WS}*((?:19|20)\d{{2}}){WS}*年{WS}*(\d{{1,2}}){WS}*月{WS}*(\d{{1,2}}){WS}*日"
    y, m, d = (F.regexp_extract(head, compact, i) for i in (1, 2, 3))
    # two digits mean 1970 to 2069
    number = F.try_to_number(F.nullif(y, F.lit("")), F.lit("9999")).cast("int")
    year = F.when(F.length(y) == 2, F.when(number >= 70, number + 1900).otherwise(number + 2000)).otherwise(number)
    first = F.when(y != "", F.concat_ws("-", year.cast("string"), T.pad2(m), T.pad2(d)))
    y2, m2, d2 = (F.regexp_extract(head, spoken, i) for i in (1, 2, 3))
    return F.coalesce(first, F.when(y2 != "", F.concat_ws("-", y2, T.pad2(m2), T.pad2(d2))))


def observed_date(path: Column, body: Column, c: Conventions) -> Column:
    """(date, source): of the path, the preamble, the title or the front matter, in this order."""
    parts = [F.regexp_extract(path, r"(?:^|/)(\d{4})/(\d{2})/(\d{2})\.md\z", i) for i in (1, 2, 3)]
    created = F.nullif(F.col("_dateCreated.value"), F.lit(""))
    choices = [
        (F.when(parts[0] != "", F.concat_ws("-", *parts)), "repository_path"),
        (edition_date(body, c), "episode_preamble"),
        (T.iso_date(F.col("_title.value")), "page_title"),
        (T.iso_date(F.coalesce(created, F.col("_date.value"))), "frontmatter"),
        (F.lit(UNKNOWN_DATE), "unknown"),
    ]
    return F.coalesce(*[F.when(d.isNotNull(), F.struct(d.alias("date"), F.lit(s).alias("source"))) for d, s in choices])


def episode(title: Column, c: Conventions) -> Column:
    """(series, number) of a title with a plain number, which may have decimals; else null (F16)."""
    number = F.regexp_extract(title, rf"【{WS}*{c.series_title}{WS}*(\d+(?:\.\d+)?){WS}*】", 1)
    return F.when(number != "", F.struct(F.lit(c.series_id).alias("series"), number.try_cast("double").alias("number")))


def independent_title(text: Column, c: Conventions) -> Column:
    """A title without the page's series; as it is if nothing else would be left (F2)."""
    cleaned = T.clean_text(text)
    bare = F.regexp_replace(cleaned, rf"^【(?:{alternatives(c.series_labels)})[^】]*】{WS}*", "")
    return F.coalesce(F.nullif(bare, F.lit("")), cleaned)


def page_kind(path: Column) -> Column:
    root = F.split_part(path, F.lit("/"), F.lit(1))
    return F.when(root == "main", F.lit("episode")).otherwise(root)


def archive_url(path: Column, c: Conventions) -> Column:
    return F.concat(F.lit(c.archive_base), F.regexp_replace(path, r"\.md\z", ""))


def is_media(text: Column, c: Conventions) -> Column:
    """Only media words and white space."""
    words = "|".join(w for w in c.media.split("|") if w != "Tabs")
    return text.rlike(rf"(?i)^(?:Tabs{WS}*)?(?:{words}|{WS})*\z")


def section_title(block: Column, c: Conventions) -> Column:
    """A block's own title: its prompt, its first heading that is no media word, or a paragraph; the first
    sentence of it, 90 characters at most (F9)."""
    prompt = F.nullif(F.regexp_extract(block, PROMPT, 1), F.lit(""))
    headings = F.transform(
        F.regexp_extract_all(block, F.lit(r"(?m)^#{1,3}[ \t]+(.+)$"), F.lit(1)), lambda h: T.trim(F.regexp_replace(T.clean_text(h), rf"{WS}*\{{[^}}]+\}}{WS}*\z", ""))
    )
    heading = F.get(F.filter(headings, lambda h: (h != "") & ~h.rlike(rf"(?i)^(?:{c.media})\z")), F.lit(0))
    best = F.coalesce(prompt, heading, T.meaningful_paragraph(block, c.media_lead, c.greeting))
    return F.left(T.first_sentence(T.clean_text(best)), F.lit(90))


def prompt_title(text: Column, source_title: Column, c: Conventions) -> Column:
    """A prompt without its lead and the host's name; its first sentence if that says enough."""
    bare = F.regexp_replace(F.regexp_replace(text, f"^{c.prompt_lead}", ""), rf"^(?:{'|'.join(c.hosts) or '(?!)'})[，,：:\s　]*", "")
    sentence = T.first_sentence(bare)
    return F.left(F.when(F.length(sentence) >= 8, sentence).otherwise(F.coalesce(F.nullif(bare, F.lit("")), source_title)), F.lit(160))


def introduction_score(text: Column, current: Column, c: Conventions) -> Column:
    """How much a prompt looks like the introduction of another topic."""
    points = [
        (text.rlike(f"^(?:{c.transition})"), 5), (text.rlike(f"^{c.date_lead}"), 4), (text.rlike(f"(?:{c.reporting})"), 2), (F.length(text) >= 55, 1),
        (text.rlike(f"^(?:{'|'.join((c.follow_up, *c.hosts))})"), -5), (F.arrays_overlap(T.han_trigrams(text, c.stop_trigrams), T.han_trigrams(current, c.stop_trigrams)), -4),
    ]
    total = F.lit(0)
    for condition, value in points:
        total = total + F.when(condition, F.lit(value)).otherwise(0)
    return total


def _section(first, last, title=None, marker=None, prose=None, text=None, start=None, end=None) -> Column:
    given = {"first": first, "last": last, "title": title, "marker": marker, "prose": prose, "text": text, "startColumn": start, "endColumn": end}
    kinds = dict(f.split(":") for f in SECTION[7:-1].split(","))
    return F.struct(*[(F.lit(None) if v is None else v).cast(kinds[k]).alias(k) for k, v in given.items()])


def _block(first: Column, last: Column) -> Column:
    """Lines first to last (from 0, last excluded) as text."""
    return F.array_join(F.slice("lines", first + 1, F.greatest(last - first, F.lit(0))), "\n")


def _from_starts(starts: Column) -> Column:
    """Sections from starts (at, title, marker) in order: each ends where the next begins."""
    end = lambda i: F.coalesce(F.get(starts, i + 1)["at"], F.size("lines"))
    return F.transform(starts, lambda s, i: _section(s["at"], end(i), s["title"], s["marker"], T.clean_text(_block(s["at"], end(i)))))


def _numbered_starts(c: Conventions) -> Column:
    """Numbered headings that are no media words."""
    every = F.transform(
        F.filter(F.transform("lines", lambda line, i: F.struct(i.alias("at"), line.alias("line"))), lambda x: x["line"].rlike(NUMBERED)),
        lambda x: F.struct(x["at"].alias("at"), T.clean_text(F.regexp_extract(x["line"], NUMBERED, 1)).alias("title"), T.clean_text(x["line"]).alias("marker")),
    )
    return F.filter(every, lambda s: ~s["title"].rlike(rf"(?i)^(?:{c.media})\z"))


def _prompts(c: Conventions) -> Column:
    coloured = F.filter(F.transform("lines", lambda line, i: F.struct(i.alias("at"), F.regexp_extract(line, PROMPT, 1).alias("title"))), lambda p: p["title"] != "")
    every = F.transform(coloured, lambda p: F.struct(p["at"].alias("at"), T.clean_text(p["title"]).alias("title")))
    return F.filter(every, lambda p: (p["title"] != "") & ~p["title"].rlike(rf"(?i)^(?:{c.media})\z"))


def _topic_starts(prompts: Column, c: Conventions) -> Column:
    """Prompts that open a topic: the first, and those that look like an introduction beside the boundary
    accepted last, which is why this is a fold and no lag (X7, W9)."""
    return F.aggregate(
        prompts,
        F.array().cast("array<struct<at:int,title:string>>"),
        lambda kept, p: F.when(
            (F.size(kept) == 0) | (introduction_score(p["title"], F.get(kept, F.size(kept) - 1)["title"], c) >= 4), F.concat(kept, F.array(p))
        ).otherwise(kept),
    )


def _ruled() -> Column:
    """Blocks between `---` lines, with their prose; none without such a line."""
    rules = F.filter(F.transform("lines", lambda line, i: F.when(line.rlike(RULE), i)), lambda i: i.isNotNull())
    bounds = F.concat(F.array(F.lit(-1)), rules, F.array(F.size("lines")))
    ranges = F.transform(F.slice(bounds, F.lit(1), F.size(bounds) - 1), lambda b, i: F.struct((b + 1).alias("a"), F.get(bounds, i + 1).alias("b")))
    return F.transform(ranges, lambda r: _section(r["a"], r["b"], prose=T.clean_text(_block(r["a"], r["b"]))))


def _sentences() -> Column:
    """Sentences of the front matter's description, of 8 characters or more, with their columns."""
    value, column = F.coalesce(F.col("_description.value"), F.lit("")), F.col("_description.column")
    found = F.regexp_extract_all(value, F.lit("[^。！？!?]+[。！？!?]?"), F.lit(0))
    # the pattern leaves out no character but leading sentence ends, so lengths add up to places
    lead = F.length(value) - F.length(F.regexp_replace(value, "^[。！？!?]+", ""))
    placed = F.aggregate(
        found,
        F.struct(lead.alias("next"), F.array().cast("array<struct<at:int,text:string>>").alias("done")),
        lambda acc, s: F.struct(
            (acc["next"] + F.length(s) + F.length(F.regexp_extract(F.substring(value, acc["next"] + F.length(s) + 1, F.length(value)), "^[。！？!?]+", 0))).alias("next"),
            F.concat(acc["done"], F.array(F.struct((acc["next"] + F.length(s) - F.length(F.regexp_replace(s, f"^{WS}+", ""))).alias("at"), T.trim(s).alias("text")))).alias("done"),
        ),
        lambda acc: acc["done"],
    )
    return F.transform(
        F.filter(placed, lambda s: F.length(s["text"]) >= 8),
        lambda s: _section(
            F.lit(0), F.lit(0), F.left(F.regexp_replace(s["text"], r"[。！？!?]+\z", ""), F.lit(160)), s["text"], None, s["text"], column + s["at"], column + s["at"] + F.length(s["text"]) - 1
        ),
    )


def _whole() -> Column:
    return F.array(_section(F.lit(0), F.size("lines"), F.col("title"), F.lit("page")))


def _marked_starts() -> Column:
    """The first line that has each marker, in order of lines; a marker that no line has fails the job."""
    cleaned = F.transform("lines", T.clean_text)
    found = F.transform(
        "boundary_markers",
        lambda m: F.struct(
            F.coalesce(
                F.get(F.filter(F.transform(cleaned, lambda line, i: F.when(F.contains(line, m), i)), lambda i: i.isNotNull()), F.lit(0)),
                F.raise_error(F.concat(F.lit("Manual news boundary marker not found in "), F.col("title"), F.lit(": "), m)).cast("int"),
            ).alias("at"),
            m.alias("marker"),
        ),
    )
    return F.transform(F.array_sort(found), lambda s: F.struct(s["at"].alias("at"), F.get(cleaned, s["at"]).alias("title"), s["marker"].alias("marker")))


def parse_pages(raw_pages: DataFrame, overrides: DataFrame | None = None, conventions: Conventions = DEFAULT, path: str = "path", raw: str = "raw") -> DataFrame:
    """One row per accepted page with its `segmentation` and `sections`.

    Dropped: pages with `published: false`, navigation pages, excluded pages, and pages of which no
    section is left. Null raw text is an empty page; null paths are dropped. `overrides` (OVERRIDES) is a
    small reviewed table, joined by path. Extra columns don't pass through.
    """
    c = conventions
    pages = raw_pages.where(F.col(path).isNotNull()).select(F.col(path).alias("repositoryPath"), F.col(raw).alias("raw"))
    if overrides is None:
        nulls = {"exclude": "boolean", "single_news": "boolean", "boundary_markers": "array<string>", "exclude_titles": "array<string>"}
        pages = pages.withColumns({k: F.lit(None).cast(v) for k, v in nulls.items()})
    else:
        pages = pages.join(overrides.withColumnRenamed("path", "repositoryPath").dropDuplicates(["repositoryPath"]), "repositoryPath", "left")
    pages = front_matter(pages)
    pages = pages.withColumns({f"_{k}": attribute(k) for k in ("published", "title", "description", "dateCreated", "date")})
    published = F.lower(F.coalesce(F.col("_published.value"), F.lit("")))
    pages = pages.where((published != "false") & ~is_navigation(F.col("body")))
    heading = F.nullif(F.regexp_extract("body", r"(?m)^#{1,3}[ \t]+(.+)$", 1), F.lit(""))
    name = F.regexp_replace(F.element_at(F.split("repositoryPath", "/"), -1), r"\.md\z", "")
    root = F.split_part("repositoryPath", F.lit("/"), F.lit(1))
    excluded, single = F.coalesce("exclude", F.lit(False)), F.coalesce("single_news", F.lit(False))
    manual = excluded | single | F.col("boundary_markers").isNotNull()
    pages = pages.withColumns({"title": F.coalesce(F.nullif(F.col("_title.value"), F.lit("")), heading, name), "_root": F.when(manual, F.lit("")).otherwise(root)})
    none = F.array().cast(STARTS)
    pages = pages.withColumns(
        {
            "_numbered": F.when(F.col("_root").isin("daily", "reference"), _numbered_starts(c)).otherwise(none),
            "_prompts": F.when(F.col("_root") == "main", _prompts(c)).otherwise(F.array().cast("array<struct<at:int,title:string>>")),
        }
    )
    pages = pages.withColumn("_topics", F.when(F.size("_prompts") > 0, _topic_starts(F.col("_prompts"), c)).otherwise(F.col("_prompts")))
    topics = F.transform("_topics", lambda p: F.struct(p["at"].alias("at"), prompt_title(p["title"], F.col("title"), c).alias("title"), p["title"].alias("marker")))
    starts = (
        F.when(F.col("boundary_markers").isNotNull() & ~excluded & ~single, _marked_starts()).when(F.col("_root") == "main", topics).otherwise(F.col("_numbered"))
    )
    pages = pages.withColumn("_starts", starts)
    long_enough = lambda s: F.length(s["prose"]) >= 40  # noqa: E731  (shorter ones are dropped, and not merged into a neighbour: X11)
    ruled = ~F.col("_root").isin("daily", "reference", "")
    pages = pages.withColumns({"_started": F.filter(_from_starts(F.col("_starts")), long_enough), "_ruled": F.when(ruled, _ruled()).otherwise(F.expr(NO_SECTIONS))})
    pages = pages.withColumns(
        {
            "_blocks": F.filter("_ruled", lambda r: (F.length(r["prose"]) >= 100) & ~is_media(r["prose"], c)),
            "_sentences": F.when((F.col("_root") == "reference") & (F.size("_numbered") == 0), _sentences()).otherwise(F.expr(NO_SECTIONS)),
        }
    )
    page_strategy = (
        F.when(excluded, F.lit("excluded"))
        .when(single, F.lit("manual_single"))
        .when(F.col("boundary_markers").isNotNull(), F.lit("manual_markers"))
        .when((F.col("_root") == "daily") & (F.size("_numbered") > 0), F.lit("daily_numbered_heading"))
        .when((F.col("_root") == "reference") & (F.size("_numbered") > 0), F.lit("reference_numbered_heading"))
        .when(F.size("_sentences") > 1, F.lit("reference_description_sentence"))
        .when((F.col("_root") == "main") & (F.size("_started") > 1), F.lit("main_interview_topic"))
        .when((F.size("_ruled") > 1) & (F.size("_blocks") > 1), F.lit("horizontal_rule"))
        .otherwise(F.lit("page_fallback"))
    )
    pages = pages.withColumn("_strategy", page_strategy)
    strategy = F.col("_strategy")
    by_start = strategy.isin("manual_markers", "daily_numbered_heading", "reference_numbered_heading", "main_interview_topic")
    sections = (
        F.when(strategy == "excluded", F.expr(NO_SECTIONS)).when(by_start, F.col("_started")).when(strategy == "reference_description_sentence", F.col("_sentences"))
        .when(strategy == "horizontal_rule", F.col("_blocks")).otherwise(_whole())
    )
    strict = (strategy == "page_fallback") & F.col("_root").isin("daily", "reference")
    interview = (strategy == "page_fallback") & (F.col("_root") == "main")
    confidence = (
        F.when(strategy.isin("excluded", "manual_single", "manual_markers", "daily_numbered_heading", "reference_numbered_heading"), 1.0)
        .when(strategy == "reference_description_sentence", 0.76).when(strategy == "main_interview_topic", 0.88).when(strategy == "horizontal_rule", 0.82)
        .when(strict, 0.45).when(interview, 0.55).otherwise(0.8)
    )
    boundaries = (
        F.when(strategy == "manual_markers", F.size("boundary_markers")).when(strategy == "main_interview_topic", F.size("_prompts")).when(by_start, F.size("_numbered"))
        .when(strategy == "reference_description_sentence", F.size("_sentences")).when(strategy == "horizontal_rule", F.size("_ruled") - 1).otherwise(0)
    )
    long_page = F.when(interview & F.contains("title", F.lit(c.series_title)), F.length(T.clean_text(F.array_join("lines", "\n"))) >= 4000)
    reasons = F.filter(
        F.array(
            F.when(strategy == "reference_description_sentence", F.lit("metadata_only_news_segmentation")),
            F.when(strict, F.lit("numbered_news_headings_not_found")),
            F.when(long_page, F.lit("long_main_page_without_confident_boundaries")),
            F.when(interview & (F.size("_prompts") >= 4), F.lit("interview_prompts_found_but_grouped_as_one_news")),
        ),
        lambda r: r.isNotNull(),
    )
    pages = pages.withColumns({"sections": sections, "_confidence": confidence, "_boundaries": boundaries.cast("int"), "_reasons": reasons})
    # only pages of which titles are to be left out work out titles here
    own_title = lambda x: T.clean_text(F.when(strategy == "horizontal_rule", section_title(_block(x["first"], x["last"]), c)).otherwise(x["title"]))
    wanted = F.array_distinct(F.transform("exclude_titles", T.clean_text))
    missing = F.array_except(wanted, F.transform("sections", own_title))
    error = F.raise_error(F.concat(F.lit("Manual excluded news title not found in "), F.col("repositoryPath"), F.lit(": "), F.array_join(missing, ", ")))
    kept = F.when(F.col("exclude_titles").isNull(), F.col("sections")).when(F.size(missing) > 0, error.cast(f"array<{SECTION}>")).otherwise(
        F.filter("sections", lambda x: ~F.array_contains(wanted, own_title(x)))
    )
    # the row number keeps the optimizer from moving the filter, and all that it is made of, below
    pages = pages.withColumns({"sections": kept, "_row": F.monotonically_increasing_id()}).where((F.size("sections") > 0) & (F.col("_row") >= 0))
    return pages.withColumn("_seen", observed_date(F.col("repositoryPath"), F.col("body"), c)).select(
        T.page_id(F.col("repositoryPath")).alias("id"),
        "title",
        archive_url(F.col("repositoryPath"), c).alias("archiveUrl"),
        "repositoryPath",
        F.col("_seen.date").alias("publishedAt"),
        F.struct(F.col("_seen.date").alias("observedAt"), F.col("_seen.source").alias("source"), F.lit("observed").alias("resolution")).alias("dateProvenance"),
        episode(F.col("title"), c).alias("episode"),
        page_kind(F.col("repositoryPath")).alias("kind"),
        F.sha2(F.coalesce("raw", F.lit("")), 256).alias("contentHash"),
        F.struct(
            strategy.alias("strategy"), F.col("_confidence").alias("confidence"), F.size("sections").alias("newsCount"), F.col("_boundaries").alias("candidateBoundaryCount"),
            (F.size("_reasons") > 0).alias("needsReview"), F.col("_reasons").alias("reviewReasons"),
        ).alias("segmentation"),
        "lines",
        "body_line",
        F.col("_description").alias("description"),
        "sections",
    )


PAGE_COLUMNS = "id title archiveUrl repositoryPath publishedAt dateProvenance episode kind contentHash segmentation".split()


def pages_of(parsed: DataFrame) -> DataFrame:
    return parsed.select(*PAGE_COLUMNS)


def news_of(parsed: DataFrame, conventions: Conventions = DEFAULT) -> DataFrame:
    """News rows of parsed pages, each with the fragment it came from and that fragment's text."""
    c = conventions
    rows = parsed.select(
        "id", "title", "repositoryPath", "publishedAt", "segmentation.strategy", "lines", "body_line", "description", F.size("sections").alias("n"), F.posexplode("sections").alias("ordinal", "s")
    )
    quoted = F.col("s.text").isNotNull()
    rows = rows.withColumn("text", F.when(quoted, F.col("s.text")).otherwise(_block(F.col("s.first"), F.col("s.last"))))
    ruled, whole = F.col("strategy") == "horizontal_rule", F.col("strategy").isin("page_fallback", "manual_single")
    rows = rows.withColumns({"stated": T.explicit_date(F.col("text")), "headline": F.when(ruled, F.nullif(section_title(F.col("text"), c), F.lit("")))})
    known = F.col("publishedAt") != UNKNOWN_DATE
    page_title = independent_title(F.col("title"), c)
    counted = F.concat(page_title, F.lit(" · "), (F.col("ordinal") + 1).cast("string"))
    given = F.when(ruled, F.coalesce("headline", counted)).otherwise(F.col("s.title"))
    own = F.nullif(F.left(independent_title(given, c), F.lit(160)), F.lit(""))
    rows = rows.withColumn("news_title", F.coalesce(own, F.when(F.col("n") == 1, page_title).otherwise(counted)))
    # a page without numbered headings keeps to its text, other whole pages to their description
    described = F.when(whole & ~((F.col("strategy") == "page_fallback") & F.split_part("repositoryPath", F.lit("/"), F.lit(1)).isin("daily", "reference")), F.nullif(F.col("description.value"), F.lit("")))
    summary = F.when(quoted, F.col("s.text")).otherwise(F.coalesce(described, T.meaningful_paragraph(F.col("text"), c.media_lead)))
    marker = F.when(ruled, F.coalesce("headline", T.first_sentence(F.col("s.prose")))).otherwise(F.col("s.marker"))
    marker = F.left(T.clean_text(F.coalesce(F.nullif(marker, F.lit("")), F.col("news_title"))), F.lit(220))
    rows = rows.withColumns({"date": F.when(known, F.col("publishedAt")).otherwise(F.coalesce("stated.date", F.lit(UNKNOWN_DATE))), "marker": marker})
    first = F.when(quoted, F.col("description.line")).otherwise(F.col("body_line") + F.col("s.first"))
    last = F.when(quoted, F.col("description.line")).otherwise(F.col("body_line") + F.col("s.last") - 1)
    return rows.select(
        T.news_id(F.col("repositoryPath"), F.col("strategy"), F.col("marker")).alias("id"),
        F.col("news_title").alias("title"),
        "date",
        F.when(known, T.date_precision(F.col("date"))).otherwise(F.coalesce("stated.precision", T.date_precision(F.col("date")))).alias("datePrecision"),
        F.left(T.clean_text(summary), F.lit(420)).alias("summary"),
        F.col("id").alias("pageId"),
        F.struct(
            F.col("strategy"), (F.col("ordinal") + 1).alias("ordinal"), F.when(quoted, F.lit("frontmatter.description")).otherwise(F.lit("body")).alias("sourceField"),
            first.alias("startLine"), last.alias("endLine"), F.col("s.startColumn").alias("startColumn"), F.col("s.endColumn").alias("endColumn"), F.col("marker").alias("marker"),
            F.sha2("text", 256).alias("contentHash"),
        ).alias("fragment"),
        F.col("text").alias("fragmentText"),
    )


def read_fragments(news: DataFrame, raw_pages: DataFrame, strict: bool = True) -> DataFrame:
    """Adds `fragmentText`, cut from the page again by lines or columns, and checks its hash (F27). With
    `strict` a wrong hash fails the job; else `intact` says so. `raw_pages` has (pageId, raw)."""
    rows = news.join(raw_pages.select("pageId", "raw"), "pageId", "left")
    lines = F.split(F.coalesce("raw", F.lit("")), r"\r?\n", -1)
    line = F.get(lines, F.col("fragment.startLine") - 1)
    cut = F.when(
        F.col("fragment.sourceField") == "body", F.array_join(F.slice(lines, F.col("fragment.startLine"), F.greatest(F.col("fragment.endLine") - F.col("fragment.startLine") + 1, F.lit(0))), "\n")
    ).otherwise(F.substring(line, F.col("fragment.startColumn"), F.col("fragment.endColumn") - F.col("fragment.startColumn") + 1))
    rows = rows.withColumn("fragmentText", cut).drop("raw").withColumn("intact", F.coalesce(F.sha2("fragmentText", 256) == F.col("fragment.contentHash"), F.lit(False)))
    if not strict:
        return rows
    bad = F.raise_error(F.concat(F.lit("Fragment hash mismatch: "), F.col("id"))).cast("string")
    return rows.withColumn("fragmentText", F.when(F.col("intact"), F.col("fragmentText")).otherwise(bad)).drop("intact")
