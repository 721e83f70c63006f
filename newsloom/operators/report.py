"""Coverage and review reports: counts over whole collections, zero-filled from the ontology."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.functions.text import percentage


def type_counts(rows: DataFrame, types: DataFrame, column: str = "type") -> DataFrame:
    """(id, n): rows of each type of the ontology (`id`), zero for none."""
    counts = rows.groupBy(F.col(column).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return types.select("id").join(counts, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


def relation_counts(relation_types: DataFrame, *relations: DataFrame) -> DataFrame:
    """(id, n) over all relation collections."""
    every = relations[0].select("type")
    for more in relations[1:]:
        every = every.unionByName(more.select("type"))
    return type_counts(every, relation_types)


def _metric(name: str, covered: Column, total: Column) -> Column:
    return F.struct(F.lit(name).alias("metric"), covered.cast("bigint").alias("covered"), total.cast("bigint").alias("total"), percentage(covered, total).alias("percent"))


def required_coverage(events: DataFrame, sources: DataFrame) -> DataFrame:
    """(metric, covered, total, percent) of semantic entities, specific types, traceability and searchability
    (A10). A missing array counts as empty."""
    n = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c))
    known = sources.select(F.col("id").alias("_source")).where("_source IS NOT NULL").distinct().withColumn("_known", F.lit(True))
    rows = events.withColumn("_source", F.when(n("sourceIds") == 1, F.get("sourceIds", F.lit(0)))).join(known, "_source", "left")
    text = lambda c: F.length(F.trim(F.coalesce(c, F.lit("")))) > 0
    total = F.count(F.lit(1))
    counted = rows.agg(
        total.alias("total"), F.count_if(n("entityIds") > 0).alias("entity"), F.count_if(~F.coalesce(F.col("type") == "other", F.lit(False))).alias("type"),
        F.count_if("_known").alias("trace"), F.count_if(text("title") | text("summary") | (n("entityIds") > 0)).alias("search"),
    )
    whole = F.col("total")
    metrics = [("semanticEntity", "entity"), ("specificEventType", "type"), ("sourceTraceability", "trace"), ("searchability", "search")]
    return counted.select(F.explode(F.array(*[_metric(m, F.col(c), whole) for m, c in metrics])).alias("m")).select("m.*")


def facet_presence(events: DataFrame, mentions: DataFrame, entities: DataFrame, facet_types: DataFrame) -> DataFrame:
    """(facet, news, percent): events with an entity of the facet's types; `facet_types` has (facet, type)."""
    typed = mentions.join(entities.select(F.col("id").alias("entity_id"), "type"), "entity_id").join(facet_types, "type")
    found = typed.select("facet", "event_id").distinct().groupBy("facet").agg(F.count(F.lit(1)).alias("news"))
    total = events.agg(F.count(F.lit(1)).alias("total"))
    facets = facet_types.select("facet").distinct().join(found, "facet", "left").withColumn("news", F.coalesce("news", F.lit(0)))
    return facets.join(F.broadcast(total)).select("facet", "news", percentage(F.col("news"), F.col("total")).alias("percent"))


def mean_entities(events: DataFrame) -> DataFrame:
    """One row: the mean number of entities of an event to two decimals, 0 without events."""
    n = F.when(F.col("entityIds").isNull(), 0).otherwise(F.size("entityIds"))
    return events.agg(F.round(F.coalesce(F.sum(n), F.lit(0)) / F.greatest(F.count(F.lit(1)), F.lit(1)), 2).alias("mean"))


def segmentation_report(pages: DataFrame) -> dict[str, DataFrame]:
    """Pages by strategy, episode pages by date resolution, pages with several news or to review, and the list
    to review (V7, A5, A6)."""
    s = "segmentation."
    return {
        "by_strategy": pages.groupBy(F.col(s + "strategy").alias("strategy")).agg(F.count(F.lit(1)).alias("n")),
        "by_resolution": pages.where("episode IS NOT NULL").groupBy(F.col("dateProvenance.resolution").alias("resolution")).agg(F.count(F.lit(1)).alias("n")),
        "totals": pages.agg(
            F.count(F.lit(1)).alias("pages"), F.coalesce(F.sum(s + "newsCount"), F.lit(0)).alias("news"), F.count_if(F.col(s + "newsCount") > 1).alias("multiNewsPages"),
            F.count_if(F.col(s + "needsReview")).alias("reviewPages"), F.count_if(F.col("dateProvenance.resolution") != "observed").alias("adjustedPages"),
        ),
        "review": pages.where(F.col(s + "needsReview")).select("id", "title", "repositoryPath", s + "strategy", s + "confidence", s + "newsCount", s + "candidateBoundaryCount", s + "reviewReasons"),
    }


def review_sample(events: DataFrame, gaps: bool = False, most: int = 100) -> DataFrame:
    """The first events without a specific type, or without entities, to be reviewed."""
    n = F.when(F.col("entityIds").isNull(), 0).otherwise(F.size("entityIds"))
    wanted = (n == 0) if gaps else (F.col("type") == "other")
    return events.where(wanted).select("id", "newsId", "title", F.get("sourceIds", F.lit(0)).alias("pageId")).orderBy("id").limit(most)


def upstream_report(changes: DataFrame) -> DataFrame:
    """(bucket, n, paths): how many paths each bucket of an archive diff has, and the first 30."""
    counts = changes.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    first = changes.withColumn("_n", F.row_number().over(W.partitionBy("bucket").orderBy("path"))).where("_n <= 30")
    shown = first.groupBy("bucket").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    return counts.join(shown, "bucket")


def counts_map(counts: DataFrame, key: str = "id", value: str = "n") -> DataFrame:
    """One row with a map of counts in the order of their keys (O14); for the few rows of a report."""
    return counts.where(F.col(key).isNotNull()).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias("counts"))
