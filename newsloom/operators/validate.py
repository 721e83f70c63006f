"""Constraint queries: each check gives (level, path, message) rows, and no rows is a valid dataset."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.functions.text import UNKNOWN_DATE
from newsloom.operators.segment import read_fragments

ISO = r"^\d{4}-\d{2}-\d{2}\z"
# Where a date can come from, how it came about, how exact it is.
DATE_SOURCES = ("repository_path", "episode_preamble", "page_title", "frontmatter", "unknown")
RESOLUTIONS = ("observed", "interpolated", "corrected_sequence_outlier", "extrapolated")
PRECISIONS = ("day", "month", "year")
SCHEMA = "level string, path string, message string"


def issue(rows: DataFrame, path, message, level: str = "error") -> DataFrame:
    """One issue a row; `path` and `message` are columns or texts."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return rows.select(F.lit(level).alias("level"), as_column(path).alias("path"), as_column(message).alias("message"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _at(collection: str, what: str = "") -> Column:
    return F.concat(F.lit(f"{collection}."), F.coalesce(F.col("id"), F.lit("?")), F.lit(f".{what}" if what else ""))


def missing_ids(rows: DataFrame, collection: str) -> DataFrame:
    return issue(rows.where(F.coalesce(F.col("id"), F.lit("")) == ""), f"{collection}.id", "missing ID")


def duplicate_ids(rows: DataFrame, collection: str, key: str = "id", what: str = "duplicate ID ") -> DataFrame:
    """An issue for each occurrence after the first (A14). Counted, not numbered: a hot id is one state a task."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    again = counts.select("k", F.explode(F.sequence(F.lit(2), F.col("n"))).alias("occurrence"))
    return issue(again, f"{collection}.{key}", F.concat(F.lit(what), F.col("k").cast("string")))


def dangling(rows: DataFrame, reference: Column, targets: DataFrame, collection: str, what: str, message: str) -> DataFrame:
    """References to ids that don't exist."""
    refs = rows.select("id", reference.alias("ref")).where("ref IS NOT NULL")
    return issue(refs.join(targets.select(F.col("id").alias("ref")), "ref", "left_anti"), _at(collection, what), F.concat(F.lit(message), F.col("ref")))


def falling(rows: DataFrame, partition: list[Column], order: list[Column], value: str, collection: str, what: str) -> DataFrame:
    """Rows whose value is below the one before them."""
    before = F.lag(value).over(W.partitionBy(*partition).orderBy(*order))
    found = rows.withColumn("_before", before).where(F.col("_before") > F.col(value))
    return issue(found, _at(collection, what), F.concat(F.col(value), F.lit(" comes after "), F.col("_before")))


def validate_news(pages: DataFrame, news: DataFrame) -> DataFrame:
    """Issues of a news dataset (V1)."""
    bad = lambda c: ~F.coalesce(c, F.lit(False))
    p, n = F.col, F.col
    parts = [missing_ids(pages, "pages"), duplicate_ids(pages, "pages"), missing_ids(news, "news"), duplicate_ids(news, "news")]
    prov = "dateProvenance."
    parts += [
        issue(pages.where(bad(p("publishedAt").rlike(ISO))), _at("pages", "publishedAt"), "invalid date"),
        issue(pages.where(bad(p(prov + "observedAt").rlike(ISO))), _at("pages", "dateProvenance.observedAt"), "invalid date"),
        issue(pages.where(bad(p(prov + "source").isin(*DATE_SOURCES))), _at("pages", "dateProvenance.source"), "unknown date source"),
        issue(pages.where(bad(p(prov + "resolution").isin(*RESOLUTIONS))), _at("pages", "dateProvenance.resolution"), "unknown date resolution"),
        issue(
            pages.where((p(prov + "resolution") == "observed") & (p("publishedAt") != p(prov + "observedAt"))), _at("pages", "publishedAt"), "observed date differs from publishedAt"
        ),
    ]
    episodes = pages.where("episode IS NOT NULL")
    numbers = episodes.groupBy("episode.series", "episode.number").agg(F.count(F.lit(1)).alias("n")).where("n > 1 AND number IS NOT NULL")
    parts += [
        issue(episodes.where(bad(F.length(p("episode.series")) > 0)), _at("pages", "episode.series"), "missing series"),
        issue(episodes.where(bad(p("episode.number") > 0)), _at("pages", "episode.number"), "episode number must be positive"),
        issue(numbers, "pages.episode.number", F.concat(F.lit("duplicate episode "), F.col("number").cast("string"))),
        falling(episodes, [p("episode.series")], [p("episode.number"), p("repositoryPath")], "publishedAt", "pages", "publishedAt"),
    ]
    owned = news.join(pages.select(F.col("id").alias("pageId"), F.col("publishedAt").alias("_page_date"), "episode"), "pageId", "left")
    frag = "fragment."
    lines = (n(frag + "startLine") >= 1) & (n(frag + "endLine") >= n(frag + "startLine"))
    columns = n(frag + "startColumn").isNull() | ((n(frag + "startColumn") >= 1) & (n(frag + "endColumn") >= n(frag + "startColumn")))
    same = news.groupBy("pageId", frag + "sourceField", frag + "startLine", frag + "endLine", frag + "startColumn", frag + "endColumn").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    parts += [
        dangling(news, F.col("pageId"), pages, "news", "pageId", "missing page "),
        issue(news.where(bad(F.length(F.trim(n("title"))) > 0)), _at("news", "title"), "empty title"),
        issue(news.where(bad(n("date").rlike(ISO))), _at("news", "date"), "invalid date"),
        issue(news.where(bad(n("datePrecision").isin(*PRECISIONS))), _at("news", "datePrecision"), "unknown date precision"),
        issue(owned.where("episode IS NOT NULL AND date <> _page_date"), _at("news", "date"), "episode news date differs from its page"),
        issue(news.where(bad(lines)), _at("news", "fragment"), "invalid line range"),
        issue(news.where(bad(columns)), _at("news", "fragment"), "invalid column range"),
        issue(news.where(bad(n(frag + "contentHash").rlike(r"^[0-9a-f]{64}\z"))), _at("news", "fragment.contentHash"), "invalid sha256"),
        issue(same.where("n > 1"), _at("news", "fragment"), "duplicate fragment"),
    ]
    return union(parts)


def validate_fragments(news: DataFrame, pages: DataFrame, raw_pages: DataFrame) -> DataFrame:
    """Pages and fragments whose text has another hash than recorded (V3). `raw_pages` has (pageId, raw)."""
    raw = raw_pages.select("pageId", "raw")
    kept = pages.join(raw.withColumnRenamed("pageId", "id"), "id", "left")
    parts = [
        issue(kept.where("raw IS NULL"), _at("pages"), "page text is missing"),
        issue(kept.where("raw IS NOT NULL AND NOT (sha2(raw, 256) <=> contentHash)"), _at("pages", "contentHash"), "page hash differs"),
        issue(read_fragments(news, raw, strict=False).where("NOT intact"), _at("news", "fragment"), "fragment hash differs"),
    ]
    return union(parts)


def projection_diff(news: DataFrame, events: DataFrame, fields: dict[str, str] | None = None) -> DataFrame:
    """(news_id, field, news_value, event_value): where events don't mirror their news, null-safely; a missing
    side is the field `missing` (J16)."""
    fields = fields or {"title": "title", "date": "date", "datePrecision": "datePrecision", "summary": "summary"}
    left = news.select(F.col("id").alias("news_id"), F.struct(*[F.col(a).cast("string").alias(a) for a in fields]).alias("l"))
    right = events.select(F.col("newsId").alias("news_id"), F.struct(*[F.col(b).cast("string").alias(a) for a, b in fields.items()]).alias("r"))
    both = left.join(right, "news_id", "full")
    cells = [F.struct(F.lit(a).alias("field"), F.col(f"l.{a}").alias("news_value"), F.col(f"r.{a}").alias("event_value")) for a in fields]
    gone = F.struct(F.lit("missing").alias("field"), F.col("l").isNotNull().cast("string").alias("news_value"), F.col("r").isNotNull().cast("string").alias("event_value"))
    rows = both.select("news_id", F.explode(F.when(F.col("l").isNull() | F.col("r").isNull(), F.array(gone)).otherwise(F.array(*cells))).alias("x")).select("news_id", "x.*")
    return rows.where((F.col("field") == "missing") | ~F.col("news_value").eqNullSafe(F.col("event_value")))


def validate_projection(news: DataFrame, events: DataFrame, pages: DataFrame, sources: DataFrame) -> DataFrame:
    """Issues of a graph that should mirror its news dataset (V2)."""
    diff = projection_diff(news, events)
    hashes = pages.select("id", F.col("contentHash").alias("a")).join(sources.select("id", F.col("contentHash").alias("b")), "id", "left").where("NOT (a <=> b)")
    return union(
        [
            duplicate_ids(events, "events", "newsId", "duplicate news projection "),
            issue(diff, F.concat(F.lit("events."), F.col("news_id"), F.lit("."), F.col("field")), "event differs from its news"),
            issue(hashes, _at("sources", "contentHash"), "source differs from its page"),
        ]
    )


@dataclass(frozen=True)
class Ontology:
    """The ontology as typed values; a row for each type, so it lives on the driver."""

    version: str
    record_unit: str
    minimum_entities: int
    facets: tuple[dict, ...]
    roles: tuple[dict, ...]
    entity_types: tuple[dict, ...]
    event_types: tuple[dict, ...]
    relation_types: tuple[dict, ...]

    @staticmethod
    def from_json(value: dict) -> Ontology:
        take = lambda k: tuple(value.get(k) or ())
        return Ontology(
            value.get("version", ""), (value.get("recordUnit") or {}).get("id", ""), (value.get("eventEntityConstraint") or {}).get("minimumEntities", 0),
            take("facets"), take("eventEntityRoles"), take("entityTypes"), take("eventTypes"), take("relationTypes"),
        )

    def table(self, spark, what: str) -> DataFrame:
        """(id, label, description) of a collection."""
        rows = [(x["id"], x.get("label", x["id"]), x.get("description", "")) for x in getattr(self, what)]
        return spark.createDataFrame(rows, "id string, label string, description string")


def ontology_issues(o: Ontology) -> list[tuple[str, str, str]]:
    """Issues of the ontology itself (V4, A15, V5): units, ids, the partition of types by roles, facets that
    repeat their role, relations with domain and range, texts and colours."""
    out: list[tuple[str, str, str]] = []
    error = lambda path, message, level="error": out.append((level, path, message))
    if o.record_unit != "news":
        error("ontology.recordUnit.id", "the record unit must be news")
    if o.minimum_entities != 1:
        error("ontology.eventEntityConstraint.minimumEntities", "an event must have at least one entity")
    collections = {"entityTypes": o.entity_types, "eventTypes": o.event_types, "relationTypes": o.relation_types, "facets": o.facets, "eventEntityRoles": o.roles}
    for name, rows in collections.items():
        ids = [r.get("id") for r in rows]
        out += [("error", f"ontology.{name}.{i}.id", "missing ID" if not x else f"duplicate ID {x}") for i, x in enumerate(ids) if not x or x in ids[:i]]
        for i, r in enumerate(rows):
            if name != "facets" and not (r.get("label") or "").strip():
                error(f"ontology.{name}.{i}.label", "empty label")
            color = r.get("color")
            if color is not None and not (len(color) == 7 and color[0] == "#" and all(c in "0123456789abcdefABCDEF" for c in color[1:])):
                error(f"ontology.{name}.{i}.color", "invalid colour")
    types = {t["id"] for t in o.entity_types}
    member = [t for r in o.roles for t in r.get("entityTypes") or ()]
    for i, r in enumerate(o.roles):
        if not (r.get("description") or "").strip():
            error(f"ontology.eventEntityRoles.{i}.description", "a role must say what it means")
        out += [("error", f"ontology.eventEntityRoles.{i}.entityTypes", f"unknown entity type {t}") for t in r.get("entityTypes") or () if t not in types]
    out += [("error", "ontology.eventEntityRoles", f"entity type {t} must belong to one role") for t in sorted(types) if member.count(t) != 1]
    by_id = {r["id"]: r for r in o.roles}
    for i, f in enumerate(o.facets):
        out += [("error", f"ontology.facets.{i}.entityTypes", f"unknown entity type {t}") for t in f.get("entityTypes") or () if t not in types]
        if f.get("entityTypes") and list(by_id.get(f["id"], {}).get("entityTypes") or ()) != list(f["entityTypes"]):
            error(f"ontology.facets.{i}", "a facet must have a role of the same types")
    for i, r in enumerate(o.relation_types):
        if not r.get("from") or not r.get("to"):
            error(f"ontology.relationTypes.{i}", "a relation must have domain and range")
        out += [("error", f"ontology.relationTypes.{i}", f"unknown end {t}") for t in (*(r.get("from") or ()), *(r.get("to") or ())) if t != "event" and t not in types]
        if not (r.get("description") or "").strip():
            error(f"ontology.relationTypes.{i}.description", "no description", "warning")
    return out


def validate_graph(entities: DataFrame, events: DataFrame, relations: DataFrame, sources: DataFrame, ontology: Ontology) -> DataFrame:
    """Issues of a graph under its ontology (V4), and warnings for empty descriptions (V5)."""
    spark = entities.sparkSession
    types = [t["id"] for t in ontology.entity_types]
    event_types = [t["id"] for t in ontology.event_types]
    known = {r["id"]: r for r in ontology.relation_types}
    bad = lambda c: ~F.coalesce(c, F.lit(False))
    n_entities = F.coalesce(F.size("entityIds"), F.lit(0))
    n_entities = F.when(F.col("entityIds").isNull(), 0).otherwise(n_entities)
    n_sources = F.when(F.col("sourceIds").isNull(), 0).otherwise(F.size("sourceIds"))
    has_ends = [r for r in known if "event" in (known[r].get("from") or ()) and "event" in (known[r].get("to") or ())]
    parts = [
        spark.createDataFrame(ontology_issues(ontology), SCHEMA),
        missing_ids(entities, "entities"), duplicate_ids(entities, "entities"), missing_ids(events, "events"), duplicate_ids(events, "events"),
        missing_ids(sources, "sources"), duplicate_ids(sources, "sources"), missing_ids(relations, "eventRelations"), duplicate_ids(relations, "eventRelations"),
        issue(entities.where(bad(F.col("type").isin(*types))), _at("entities", "type"), "unknown entity type"),
        issue(entities.where(bad(F.length(F.trim("description")) > 0)), _at("entities", "description"), "no description", "warning"),
        issue(events.where(bad(F.col("newsId").startswith("news-"))), _at("events", "newsId"), "an event must refer to news"),
        duplicate_ids(events.where(F.col("newsId").startswith("news-")), "events", "newsId", "duplicate news projection "),
        issue(events.where(bad(F.col("type").isin(*event_types))), _at("events", "type"), "unknown event type"),
        issue(events.where(bad(F.col("date").rlike(ISO))), _at("events", "date"), "invalid date"),
        issue(events.where(n_entities < ontology.minimum_entities), _at("events", "entityIds"), "too few entities"),
        dangling(events, F.explode("entityIds"), entities, "events", "entityIds", "missing entity "),
        dangling(events, F.explode("sourceIds"), sources, "events", "sourceIds", "missing source "),
        issue(events.where(n_sources != 1), _at("events", "sourceIds"), "an event must have one source"),
        issue(relations.where(bad(F.col("type").isin(*known))), _at("eventRelations", "type"), "unknown relation type"),
        issue(relations.where(F.col("type").isin(*known) & ~F.col("type").isin(*has_ends)), _at("eventRelations"), "ends outside domain or range"),
        dangling(relations, F.col("from"), events, "eventRelations", "from", "missing event "),
        dangling(relations, F.col("to"), events, "eventRelations", "to", "missing event "),
        issue(relations.where(bad(F.length(F.trim("evidence")) > 0)), _at("eventRelations", "evidence"), "no evidence"),
        dangling(relations, F.coalesce("sourceId", F.lit("")), sources, "eventRelations", "sourceId", "missing source "),
    ]
    return union(parts)


def unresolved_dates(pages: DataFrame) -> DataFrame:
    return pages.where(F.col("publishedAt") == UNKNOWN_DATE)
