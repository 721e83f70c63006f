"""Keyword search with synonyms and ranking, faceted filters, and pickers.

A query is parsed on the driver into an AND of ORs and becomes one Column expression over search documents
that are built once and can be stored; ranking and top-k run beside the scan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.functions.text import normalize_search_value
from newsloom.operators.graph import event_entities

# Words that are searched for together, and endings of administrative names.
SYNONYMS = (
    ("ai", "人工智能", "机器智能"), ("大模型", "大型语言模型", "llm"), ("新冠", "新型冠状病毒", "疫情", "防疫", "covid", "covid19"), ("世界卫生组织", "世卫组织", "who"),
    ("北约", "nato"), ("欧盟", "欧洲联盟", "eu"), ("联合国", "un"), ("一带一路", "丝绸之路经济带"),
)
SUFFIXES = ("特别行政区", "维吾尔自治区", "壮族自治区", "回族自治区", "自治区", "自治州", "自治县", "省", "市", "区", "县")
_TERM = re.compile(r"\"([^\"]+)\"|“([^”]+)”|'([^']+)'|(\S+)")


def expand_term(term: str, synonyms=SYNONYMS, suffixes=SUFFIXES) -> list[str]:
    """The forms under which a term is looked for: itself, its synonyms, and without the first administrative
    ending that fits, if two characters are left (Q2)."""
    own = normalize_search_value(term)
    if not own:
        return []
    forms = dict.fromkeys([own])
    for group in synonyms:
        members = [normalize_search_value(m) for m in group]
        if own in members:
            forms |= dict.fromkeys(members)
    ending = next((e for e in map(normalize_search_value, suffixes) if own.endswith(e) and len(own) > len(e) + 1), None)
    if ending:
        forms[own[: -len(ending)]] = None
    return list(forms)


def parse_query(text: str | None, synonyms=SYNONYMS, suffixes=SUFFIXES) -> list[list[str]]:
    """AND of ORs: quoted phrases and words, each with its forms; empty ones are dropped (Q1)."""
    terms = (next(g for g in m.groups() if g is not None) for m in _TERM.finditer(text or ""))
    terms = (re.sub(r"^[\"“']|[\"”']$", "", t) for t in terms)
    return [forms for t in terms if (forms := expand_term(t, synonyms, suffixes))]


def matches(query: list[list[str]], text: Column) -> Column:
    """Every term in one of its forms; an empty query matches all (Q5)."""
    return reduce(lambda a, b: a & b, (reduce(lambda a, b: a | b, (F.contains(text, F.lit(f)) for f in forms)) for forms in query), F.lit(True))


def _rank(query: str, main: Column, others: list[tuple[Column, int]]) -> Column:
    phrase = normalize_search_value(query)
    if not phrase:
        return F.lit(0)
    score = F.when(main == phrase, 100).when(F.contains(main, F.lit(phrase)), 40).otherwise(0)
    for column, weight in others:
        score = score + F.when(F.contains(column, F.lit(phrase)), weight).otherwise(0)
    return score


def rank_events(query: str) -> Column:
    """The whole query as one phrase, without synonyms: in the title 100 or 40, summary 16, entities 12, types
    6, source 3 (Q6)."""
    f = lambda n: F.col(f"fields.{n}")
    return _rank(query, f("title"), [(f("summary"), 16), (f("entities"), 12), (f("types"), 6), (f("source"), 3)])


def rank_entities(query: str) -> Column:
    f = lambda n: F.col(f"fields.{n}")
    return _rank(query, f("label"), [(f("aliases"), 24), (f("type"), 8), (f("description"), 3)])


EVENT_FIELDS = ("title", "summary", "significance", "entities", "types", "source", "date")
ENTITY_FIELDS = ("label", "aliases", "description", "type")


def _documents(rows: DataFrame, fields: tuple[str, ...], keep: list[str]) -> DataFrame:
    normal = rows.withColumns({f"_{f}": T.normalize_search(F.col(f"_{f}")) for f in fields})
    made = normal.withColumns({"fields": F.struct(*[F.col(f"_{f}").alias(f) for f in fields]), "text": F.concat(*[F.col(f"_{f}") for f in fields])})
    return made.select(*keep, "fields", "text")


def event_documents(events: DataFrame, entities: DataFrame, sources: DataFrame, event_types: DataFrame, entity_types: DataFrame) -> DataFrame:
    """Search documents of events: normalised fields and their text without separators.

    The type tables (id, label, description) are the ontology's, a row for each type. Unknown types,
    sources and entities add nothing.
    """
    full = event_entities(events, entities)
    labels = event_types.select(F.col("id").alias("type"), F.concat_ws(" ", "label", "description").alias("_type_text"))
    of_kind = entity_types.agg(F.map_from_entries(F.collect_list(F.struct("id", F.concat_ws(" ", "label", "description")))).alias("_kinds"))
    rows = full.join(labels, "type", "left").join(F.broadcast(of_kind))
    src = sources.select(F.col("id").alias("_source_id"), F.concat_ws(" ", F.col("title"), "kind", "repositoryPath").alias("_source")).dropDuplicates(["_source_id"])
    rows = rows.withColumn("_source_id", F.get("sourceIds", F.lit(0))).join(src, "_source_id", "left")
    node_text = F.transform("entities", lambda n: F.concat_ws(" ", n["label"], F.array_join(F.coalesce(n["aliases"], F.array().cast("array<string>")), " "), n["description"]))
    node_kinds = F.array_distinct(F.transform("entities", lambda n: F.concat_ws(" ", n["type"], F.element_at("_kinds", F.coalesce(n["type"], F.lit(""))))))
    rows = rows.withColumns(
        {
            "_title": F.col("title"), "_summary": F.col("summary"), "_significance": F.col("significance"), "_entities": F.array_join(node_text, " "),
            "_types": F.concat_ws(" ", "type", "_type_text", F.array_join(node_kinds, " ")), "_date": F.col("date"),
        }
    )
    return _documents(rows, EVENT_FIELDS, ["id", "title", "date", "type", "entityIds"])


def entity_documents(entities: DataFrame) -> DataFrame:
    """Search documents of entities (Q4)."""
    rows = entities.withColumns(
        {"_label": F.col("label"), "_aliases": F.array_join(F.coalesce("aliases", F.array().cast("array<string>")), " "), "_description": F.col("description"), "_type": F.col("type")}
    )
    return _documents(rows, ENTITY_FIELDS, ["id", "label", "type", F.coalesce("extraction.eventCount", F.lit(0)).alias("eventCount")])


def search_events(documents: DataFrame, query: str, most: int | None = 60) -> DataFrame:
    """The best events of a keyword query: by rank, then newest, title in Chinese collation, id (O3)."""
    found = documents.where(matches(parse_query(query), F.col("text"))).withColumn("rank", rank_events(query))
    ordered = found.orderBy(F.desc("rank"), F.desc("date"), F.collate("title", "zh"), "id")
    return ordered.limit(most) if most else ordered


def search_entities(documents: DataFrame, query: str, most: int | None = 12) -> DataFrame:
    """The best entities: by rank, count of events, label in Chinese collation, id."""
    found = documents.where(matches(parse_query(query), F.col("text"))).withColumn("rank", rank_entities(query))
    ordered = found.orderBy(F.desc("rank"), F.desc("eventCount"), F.collate("label", "zh"), "id")
    return ordered.limit(most) if most else ordered


@dataclass(frozen=True)
class Facets:
    """Conjunctive filters; an empty one takes everything."""

    event_type: str = ""
    entities: tuple[str, ...] = ()
    start_year: str = ""
    end_year: str = ""

    def condition(self) -> Column:
        year = F.substring("date", 1, 4)
        parts = [F.col("type") == self.event_type] if self.event_type else []
        parts += [F.array_contains("entityIds", e) for e in self.entities if e]
        start, end = year_text(self.start_year), year_text(self.end_year)
        parts += ([year >= start.zfill(4)] if start else []) + ([year <= end.zfill(4)] if end else [])
        return reduce(lambda a, b: a & b, parts, F.lit(True))


def year_text(text: str) -> str:
    """Digits of a typed year, four at most."""
    return re.sub(r"[^0-9]", "", text or "")[:4]


def facet_filter(events: DataFrame, facets: Facets, most: int | None = 60) -> DataFrame:
    """Events that meet all facets, newest first."""
    ordered = events.where(facets.condition()).orderBy(F.desc("date"), F.collate("title", "zh"), "id")
    return ordered.limit(most) if most else ordered


@dataclass
class Result:
    """What one submission gives: counts before the limits, and the best of each (Q8)."""

    total: DataFrame
    events: DataFrame
    total_entities: DataFrame
    entities: DataFrame
    mode: str = field(default="keyword")


def run_search(event_docs: DataFrame, entity_docs: DataFrame, query: str = "", facets: Facets | None = None, most_events: int = 60, most_entities: int = 12) -> Result:
    """Keyword mode with a query, filter mode with facets: there the chosen entities are shown by their counts."""
    one = F.count(F.lit(1)).alias("n")
    if query.strip():
        events, entities = search_events(event_docs, query, None), search_entities(entity_docs, query, None)
        return Result(events.agg(one), events.limit(most_events), entities.agg(one), entities.limit(most_entities))
    facets = facets or Facets()
    events = facet_filter(event_docs, facets, None)
    chosen = entity_docs.where(F.col("id").isin(*[e for e in facets.entities if e]) if any(facets.entities) else F.lit(False))
    chosen = chosen.orderBy(F.desc("eventCount"), F.collate("label", "zh"), "id")
    return Result(events.agg(one), events.limit(most_events), chosen.agg(one), chosen.limit(most_entities), "filter")


def ranked_entities(entities: DataFrame) -> DataFrame:
    """Entities by count of events and label; the first is the default selection."""
    return entities.orderBy(F.desc(F.coalesce("extraction.eventCount", F.lit(0))), F.collate("label", "zh"), "id")


def pick_entities(entities: DataFrame, kind: str = "", text: str = "", current: str | None = None, most: int | None = 24) -> DataFrame:
    """The picker: entities of a type whose label, aliases or description have the text, best first; the
    current one comes first if it fits and would be cut (P10, O7). An unknown type is no filter, None no limit."""
    hay = F.lower(F.concat_ws(" ", "label", F.array_join(F.coalesce("aliases", F.array().cast("array<string>")), " "), "description"))
    fits = entities.where((F.col("type") == kind) if kind else F.lit(True)).where(F.contains(hay, F.lit(text.strip().lower())))
    count = F.coalesce("extraction.eventCount", F.lit(0))
    best = fits.orderBy(F.desc(count), F.collate("label", "zh"), "id")
    best = best if most is None else best.limit(most)
    if current is None or most is None:
        return best
    own = fits.where(F.col("id") == current).withColumn("_own", F.lit(0))
    # at most `most` + 1 rows meet here
    both = best.withColumn("_own", F.lit(1)).unionByName(own.join(best.select("id"), "id", "left_anti"))
    first = W.orderBy("_own", F.desc(count), F.collate("label", "zh"), "id")
    return both.withColumn("_place", F.row_number().over(first)).where(F.col("_place") <= most).drop("_own", "_place")
