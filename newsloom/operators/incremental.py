"""Append-only updates: what changed between an accepted and a current manifest, and merges that touch
nothing that was accepted."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators.graph import mention_rows, with_event_counts


def archive_changes(accepted: DataFrame, current: DataFrame) -> DataFrame:
    """(bucket, path, hash, old_hash, paths): the changes of two manifests (path, hash).

    `modified` and `deleted` paths; of new paths `possible_rename` (its content was deleted elsewhere; paths
    lists where), `duplicate` (its content is accepted elsewhere), else `added`. A rename is deleted too.
    Null paths are left out; of repeated paths the least hash counts. One join by path and one by hash.
    """
    a = accepted.where("path IS NOT NULL").groupBy("path").agg(F.min("hash").alias("old_hash"))
    c = current.where("path IS NOT NULL").groupBy("path").agg(F.min("hash").alias("hash"))
    both = a.withColumn("in_a", F.lit(True)).join(c.withColumn("in_c", F.lit(True)), "path", "full")
    no_paths = F.lit(None).cast("array<string>")
    modified = both.where("in_a AND in_c AND NOT (hash <=> old_hash)").select(F.lit("modified").alias("bucket"), "path", "hash", "old_hash", no_paths.alias("paths"))
    deleted = both.where("in_a AND in_c IS NULL").select(F.lit("deleted").alias("bucket"), "path", "hash", "old_hash", no_paths.alias("paths"))
    fresh = both.where("in_c AND in_a IS NULL").select("path", "hash")
    # only hashes of new paths are looked up, so a content that a third of all paths share is listed once
    wanted = fresh.select("hash").where("hash IS NOT NULL").distinct()
    gone = both.where("in_a").select(F.col("path").alias("at"), F.col("old_hash").alias("hash"), F.col("in_c").isNull().alias("gone"))
    places = gone.join(wanted, "hash", "left_semi").groupBy("hash").agg(
        F.sort_array(F.collect_list(F.when(F.col("gone"), F.col("at")))).alias("deleted_at"), F.sort_array(F.collect_list("at")).alias("known_at")
    )
    fresh = fresh.join(places, "hash", "left")
    bucket = F.when(F.size("deleted_at") > 0, F.lit("possible_rename")).when(F.size("known_at") > 0, F.lit("duplicate")).otherwise(F.lit("added"))
    listed = F.when(F.size("deleted_at") > 0, F.col("deleted_at")).when(F.size("known_at") > 0, F.col("known_at"))
    added = fresh.select(bucket.alias("bucket"), "path", "hash", F.lit(None).cast("string").alias("old_hash"), listed.alias("paths"))
    return modified.unionByName(deleted).unionByName(added)


@dataclass
class Graph:
    """The collections of a knowledge graph."""

    entities: DataFrame
    events: DataFrame
    relations: DataFrame
    sources: DataFrame


def append_graph(existing: Graph, candidate: Graph, added_paths: DataFrame) -> tuple[Graph, Graph]:
    """(merged, appended): the candidate's records of newly added pages (`path`) beside what exists.

    Sources of added paths with new ids; their events; entities that these name; relations that touch a new
    event and have both ends. Accepted rows stay as they are, but for entities' counts of events. Two
    consequences hold on purpose: accepted relations are not re-linked around a new event, and an entity
    that only now has enough support is not filled into old events.
    """
    sources = candidate.sources.join(added_paths.select(F.col("path").alias("repositoryPath")).distinct(), "repositoryPath", "left_semi")
    sources = sources.join(existing.sources.select("id"), "id", "left_anti")
    of_source = candidate.events.select("id", F.explode("sourceIds").alias("source")).join(sources.select(F.col("id").alias("source")), "source", "left_semi")
    events = candidate.events.join(of_source.select("id").distinct(), "id", "left_semi").join(existing.events.select("id"), "id", "left_anti")
    named = mention_rows(events).select(F.col("entity_id").alias("id")).distinct()
    entities = candidate.entities.join(named, "id", "left_semi").join(existing.entities.select("id"), "id", "left_anti")
    new = events.select("id")
    every = existing.events.select("id").unionByName(new)
    at = lambda ids, end: ids.select(F.col("id").alias(end))
    touching = candidate.relations.join(at(new, "from"), "from", "left_semi").unionByName(candidate.relations.join(at(new, "to"), "to", "left_semi"))
    relations = candidate.relations.join(touching.select("id").distinct(), "id", "left_semi")
    relations = relations.join(at(every, "from"), "from", "left_semi").join(at(every, "to"), "to", "left_semi").join(existing.relations.select("id"), "id", "left_anti")
    order = lambda like, rows: rows.select(*like.columns)
    merged_events = existing.events.unionByName(order(existing.events, events))
    merged_entities = with_event_counts(existing.entities.unionByName(order(existing.entities, entities)), mention_rows(merged_events))
    appended = merged_entities.join(entities.select("id"), "id", "left_semi").select(*merged_entities.columns)
    merged = Graph(
        merged_entities, merged_events, existing.relations.unionByName(order(existing.relations, relations)), existing.sources.unionByName(order(existing.sources, sources))
    )
    return merged, Graph(appended, events, relations, sources)


def append_news(existing: tuple[DataFrame, DataFrame], candidate: tuple[DataFrame, DataFrame], added_paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages, news) with the candidate's pages of added paths and their news appended."""
    pages = candidate[0].join(added_paths.select(F.col("path").alias("repositoryPath")).distinct(), "repositoryPath", "left_semi").join(existing[0].select("id"), "id", "left_anti")
    news = candidate[1].join(pages.select(F.col("id").alias("pageId")), "pageId", "left_semi").join(existing[1].select("id"), "id", "left_anti")
    return existing[0].unionByName(pages.select(*existing[0].columns)), existing[1].unionByName(news.select(*existing[1].columns))
