"""From pages to the graph: two plans over tables, each cut where several later stages read the same rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.functions.conventions import DEFAULT, Conventions
from newsloom.operators import extract as X
from newsloom.operators import graph as G
from newsloom.operators import segment as S
from newsloom.operators import timeline as L
from newsloom.session import durable


@dataclass
class NewsData:
    """Pages and news with repaired dates; `fragments` has (news_id, text)."""

    pages: DataFrame
    news: DataFrame
    fragments: DataFrame


def build_news(raw_pages: DataFrame, overrides: DataFrame | None = None, conventions: Conventions = DEFAULT) -> NewsData:
    """Pages (path, raw) to news: parse, segment, repair the dates of episodes, push them down.

    Segmentation runs once: its rows are written to the shared folder, from where pages, news and
    fragments are read.
    """
    parsed = durable(S.parse_pages(raw_pages, overrides, conventions), "parsed")
    rows = durable(S.news_of(parsed, conventions), "news")
    pages = L.reconcile_episode_dates(S.pages_of(parsed))
    news = L.push_dates(rows.drop("fragmentText"), pages)
    return NewsData(pages, news, rows.select(F.col("id").alias("news_id"), F.col("fragmentText").alias("text")))


@dataclass
class GraphData:
    entities: DataFrame
    events: DataFrame
    relations: DataFrame
    mentions: DataFrame
    sources: DataFrame


def require_owned(news: DataFrame, pages: DataFrame) -> DataFrame:
    """News joined to their pages; one without a page fails the job."""
    known = pages.select(F.col("id").alias("pageId"), F.lit(True).alias("_known"))
    rows = news.join(known, "pageId", "left")
    error = F.raise_error(F.concat(F.col("id"), F.lit(" references missing page "), F.coalesce("pageId", F.lit("null")))).cast("string")
    return rows.withColumn("id", F.when(F.col("_known"), F.col("id")).otherwise(error)).drop("_known")


def build_graph(data: NewsData, rules: X.Rules, regions: list[str] = ()) -> GraphData:
    """News to entities, events and relations in three passes: candidates of each event; support over all
    events; names that were kept, looked up in all texts again. Counts that are published come from the
    third pass, support from the second. Candidates are written once and read twice.
    """
    news = require_owned(data.news, data.pages).withColumn("event_id", T.event_id(F.col("id")))
    headline = F.concat_ws("\n", "title", "summary")
    texts = news.join(data.fragments.withColumnRenamed("news_id", "id"), "id", "left")
    texts = durable(texts.select("event_id", F.col("id").alias("news_id"), headline.alias("headline"), F.concat_ws("\n", headline, "text").alias("text")), "texts")
    candidates = durable(X.extract_candidates(texts, rules, regions), "candidates")
    paths = data.pages.select(F.col("id").alias("pageId"), "repositoryPath")
    ingested = news.join(paths, "pageId").select("event_id", F.struct("repositoryPath", "fragment.ordinal").alias("seq"))
    stats = G.candidate_stats(candidates, ingested).where(G.should_keep(F.col("type"), F.col("method"), F.col("eventCount"), F.col("prominent")))
    provisional = durable(G.materialize_entities(stats), "entities")
    kept = candidates.join(provisional.select("key", F.col("id").alias("entity_id")), "key").select("event_id", "ord", "entity_id")
    own = kept.groupBy("event_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "entity_id"))), lambda x: x["entity_id"]).alias("entityIds"))
    typed = X.classify_events(texts, rules).select("event_id", "class")
    events = news.join(own, "event_id", "left").join(typed, "event_id", "left").select(
        F.col("event_id").alias("id"), F.col("id").alias("newsId"), "title", "date", "datePrecision", F.coalesce("class", F.lit("other")).alias("type"), "summary", "entityIds",
        F.array("pageId").alias("sourceIds"), F.lit("").alias("significance"),
    )
    named = provisional.where(F.col("type").isin("person", "organization", "facility"))
    names = named.select(F.col("id").alias("entity_id"), "type", F.explode(F.concat(F.array("label"), "aliases")).alias("value"))
    names = names.where((F.col("type") != "person") | (F.length("value") >= 3)).select("entity_id", "value")
    found = G.rematch(texts.select("event_id", T.clean_text(F.col("text")).alias("text")), names)
    events = durable(G.with_rematched(events, found), "events")
    mentions = G.mention_rows(events)
    entities = G.with_event_counts(provisional.drop("key"), mentions)
    dated = mentions.join(events.select(F.col("id").alias("event_id"), "date", F.get("sourceIds", F.lit(0)).alias("source_id")), "event_id")
    relations = L.precedes(dated, L.entity_rank(provisional.select("id", "label", "type")))
    return GraphData(entities, events, relations, mentions, data.pages)
