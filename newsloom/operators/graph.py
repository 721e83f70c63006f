"""The knowledge graph: candidates to entities, events and mentions, and queries over the graph."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.operators.timeline import uniform_sample
from newsloom.session import durable, scratch

# What an entity's description says, by the method that found it; # stands for its count.
DESCRIPTIONS = {
    "controlled_vocabulary": "受控主题词；由 # 条独立新闻的关键词规则命中。",
    "gazetteer": "标准地名；在 # 条独立新闻中出现。",
    "administrative_suffix": "由行政区划后缀规则识别的地点；在 # 条独立新闻中出现。",
    "organization_suffix": "由组织名称后缀规则识别的主体；在 # 条独立新闻中出现。",
    "facility_suffix": "由设施名称后缀规则识别的命名对象；在 # 条独立新闻中出现。",
    "document_title": "由书名号与文件类型后缀识别的政策文件；在 # 条独立新闻中出现。",
    "named_document": "由书名号与文献类型后缀识别的报告或文献；在 # 条独立新闻中出现。",
    "role_after": "由职务后的姓名上下文识别的人物；在 # 条独立新闻中出现。",
    "role_before": "由姓名后的职务上下文识别的人物；在 # 条独立新闻中出现。",
    "reviewed_news_link": "经人工审查与独立新闻建立的实体关联；关联 # 条独立新闻。",
}
OTHER_DESCRIPTION = "由确定性规则从存档中识别。"


def candidate_stats(candidates: DataFrame, ingested: DataFrame | None = None) -> DataFrame:
    """One row per key of candidates (event_id, ord, key, type, label, aliases, method, confidence, prominent):
    label of the first, method of the first of highest confidence, all aliases, distinct events (A1).

    "First" is in the order of `ingested` (event_id, seq), such as a page's path and the place in it, or of ids if
    it isn't given; `ord` orders the candidates of one event. Every state but the aliases has a fixed size; aliases are
    distinct before they are gathered, and come from rules, not from texts.
    """
    order = F.struct(*(["seq"] if ingested is not None else []), "event_id", "ord")
    first = F.min_by("label", order)
    best = F.min_by("method", F.struct(-F.col("confidence"), order))
    facts = candidates.groupBy("key", "event_id").agg(
        F.first("type").alias("type"), F.min("ord").alias("ord"), F.min_by("label", "ord").alias("label"), F.max("confidence").alias("confidence"),
        F.min_by("method", F.struct(-F.col("confidence"), F.col("ord"))).alias("method"), F.bool_or("prominent").alias("prominent"),
    )
    if ingested is not None:
        facts = facts.join(ingested.select("event_id", "seq"), "event_id", "left")
    stats = facts.groupBy("key").agg(
        F.first("type").alias("type"), first.alias("label"), best.alias("method"), F.max("confidence").alias("confidence"),
        F.bool_or("prominent").alias("prominent"), F.count(F.lit(1)).alias("eventCount"),
    )
    aliases = candidates.select("key", F.explode("aliases").alias("alias")).where("alias <> ''").distinct().groupBy("key").agg(F.sort_array(F.collect_list("alias")).alias("aliases"))
    return stats.join(aliases, "key", "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))


def should_keep(kind: Column, method: Column, events: Column, prominent: Column) -> Column:
    """Support: vocabularies, places, reviewed links and titled documents stay; persons, organisations and
    facilities need two events; others two, or prominence (E12)."""
    sure = method.isin("controlled_vocabulary", "gazetteer", "reviewed_news_link", "document_title", "named_document")
    named = kind.isin("person", "organization", "facility")
    return F.when(sure, F.lit(True)).when(named, events >= 2).otherwise(F.coalesce(prominent, F.lit(False)) | (events >= 2))


def describe(method: Column, count: Column) -> Column:
    known = F.create_map(*[x for m, d in DESCRIPTIONS.items() for x in (F.lit(m), F.lit(d))])
    return F.coalesce(F.replace(known[method], F.lit("#"), count.cast("string")), F.lit(OTHER_DESCRIPTION))


def materialize_entities(stats: DataFrame) -> DataFrame:
    """Entities of kept statistics: stable id, aliases without the label, description."""
    return stats.select(
        T.entity_id(F.col("type"), F.col("label")).alias("id"),
        "label",
        "type",
        F.array_distinct(F.filter("aliases", lambda a: (a != "") & (a != F.col("label")))).alias("aliases"),
        describe(F.col("method"), F.col("eventCount")).alias("description"),
        F.struct("method", F.col("confidence").cast("double").alias("confidence"), F.col("eventCount").cast("bigint").alias("eventCount")).alias("extraction"),
        "key",
    )


#: Names of one automaton, on average: what is broadcast has this bound, and more names are scanned for in
#: further blocks.
BLOCK_NAMES = 100_000


def rematch(texts: DataFrame, names: DataFrame, text: str = "text", key: str = "event_id") -> DataFrame:
    """(key, entity_id): events whose text contains a name (J4). `names` has (entity_id, value).

    A substring join without a nested loop: an Aho-Corasick automaton of the names reads each text once, in
    Arrow batches beside the scan; texts don't shuffle. Null texts and empty names match nothing.
    """
    values = names.where("value <> '' AND entity_id IS NOT NULL").select("entity_id", "value").distinct()
    blocks = max(1, -(-values.count() // BLOCK_NAMES))
    rows = texts.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = dict(rows.dtypes)["k"]
    found = None
    for b in range(blocks):
        block = values if blocks == 1 else values.where(F.pmod(F.xxhash64("value"), F.lit(blocks)) == b)
        # bounded: BLOCK_NAMES rows on average
        shared = texts.sparkSession.sparkContext.broadcast([tuple(r) for r in block.toLocalIterator()])

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            import ahocorasick

            owners: dict[str, list[str]] = {}
            for entity, value in shared.value:
                owners.setdefault(value, []).append(entity)
            automaton = ahocorasick.Automaton()
            for value, ids in owners.items():
                automaton.add_word(value, ids)
            automaton.make_automaton()
            for batch in batches:
                hits = [(k, e) for k, t in zip(batch["k"], batch["t"]) if owners for e in {e for _, ids in automaton.iter(t) for e in ids}]
                yield pd.DataFrame(hits, columns=["k", "entity_id"])

        part = rows.mapInPandas(scan, f"k {kind}, entity_id string")
        found = part if found is None else found.unionByName(part)
    return found.distinct().select(F.col("k").alias(key), "entity_id")


def with_rematched(events: DataFrame, found: DataFrame) -> DataFrame:
    """Events with the ids of `found` (event_id, entity_id) appended to their own, first seen first."""
    more = found.groupBy("event_id").agg(F.sort_array(F.collect_set("entity_id")).alias("_more"))
    none = F.array().cast("array<string>")
    joined = events.join(more, F.col("id") == F.col("event_id"), "left")
    return joined.withColumn("entityIds", F.array_distinct(F.concat(F.coalesce("entityIds", none), F.coalesce("_more", none)))).drop("event_id", "_more")


def mention_rows(events: DataFrame) -> DataFrame:
    """(event_id, entity_id, pos): an event's entities in order, each once."""
    return events.select(F.col("id").alias("event_id"), F.posexplode(F.array_distinct("entityIds")).alias("pos", "entity_id")).where("entity_id IS NOT NULL")


def with_event_counts(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """Entities with their count of events and a description that says so; zero for none (A3, A4). A wrong
    count is refreshed, everything else stays."""
    counts = mentions.groupBy("entity_id").agg(F.countDistinct("event_id").alias("_n"))
    rows = entities.join(counts, F.col("id") == F.col("entity_id"), "left").withColumn("_n", F.coalesce("_n", F.lit(0)).cast("bigint"))
    stale = F.col("extraction").isNotNull() & ~F.col("extraction.eventCount").eqNullSafe(F.col("_n"))
    rows = rows.withColumns(
        {
            "description": F.when(stale, describe(F.col("extraction.method"), F.col("_n"))).otherwise(F.col("description")),
            "extraction": F.when(stale, F.col("extraction").withField("eventCount", F.col("_n"))).otherwise(F.col("extraction")),
        }
    )
    return rows.select(*entities.columns)


# queries over the graph


def event_entities(events: DataFrame, entities: DataFrame) -> DataFrame:
    """Events with `entities`, the resolved nodes in the event's order; unknown ids are dropped."""
    nodes = mention_rows(events).join(entities.select(F.col("id").alias("entity_id"), F.struct("id", "label", "type", "aliases", "description").alias("node")), "entity_id")
    lists = nodes.groupBy("event_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node"))), lambda x: x["node"]).alias("entities"))
    joined = events.join(lists, F.col("id") == F.col("event_id"), "left").drop("event_id")
    empty = F.filter("entities", lambda x: F.lit(False))
    return joined.withColumn("entities", F.coalesce("entities", empty))


def facet_options(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """(id, label, type, n): entities with events, to be ordered by n and label."""
    counts = mentions.groupBy("entity_id").agg(F.countDistinct("event_id").alias("n"))
    return entities.join(counts, F.col("id") == F.col("entity_id")).select("id", "label", "type", "n")


def comentions(mentions: DataFrame, selected: str, among: DataFrame | None = None) -> DataFrame:
    """(entity_id, n): events that an entity shares with the selected one (A17). The selected entity's events
    come first, so the join is a semi join against one key's rows."""
    own = mentions.where(F.col("entity_id") == selected).select("event_id").distinct()
    if among is not None:
        own = own.join(among.select(F.col("id").alias("event_id")), "event_id", "left_semi")
    others = mentions.where(F.col("entity_id") != selected).join(own, "event_id", "left_semi").select("event_id", "entity_id").distinct()
    return others.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))


def neighbor_relations(relations: DataFrame, node: str) -> DataFrame:
    """Relations that touch a node, in either direction (G1)."""
    return relations.where((F.col("from") == node) | (F.col("to") == node))


def event_path(relations: DataFrame, start: str, end: str) -> DataFrame:
    """(step, id): the relations of a shortest undirected path, step by step; no rows if start and end are the
    same or not connected (G2). Of equal paths, every node is reached by the least relation id.

    Breadth first over tables: a round joins the frontier with the edges and drops what was visited, until the
    end or nothing new is reached. Only counts reach the driver.
    """
    spark = relations.sparkSession
    edges = relations.select("id", F.col("from").alias("a"), F.col("to").alias("b")).unionByName(relations.select("id", F.col("to").alias("a"), F.col("from").alias("b")))
    empty = spark.createDataFrame([], "step int, id string")
    if start == end:
        return empty
    schema = "node string, via string, parent string, depth int"
    # a part for each round, read as one table: plans don't grow with the path
    root, parts, depth = scratch(spark, "visited"), [], 0
    step = spark.createDataFrame([(start, None, None, 0)], schema)
    while True:
        parts.append(f"{root}/{depth:06d}")
        step.write.parquet(parts[-1])
        frontier, visited = spark.read.schema(schema).parquet(parts[-1]), spark.read.schema(schema).parquet(*parts)
        if frontier.isEmpty():
            return empty
        if not frontier.where(F.col("node") == end).isEmpty():
            break
        depth += 1
        reached = frontier.select(F.col("node").alias("a")).join(edges, "a").join(visited.select(F.col("node").alias("b")), "b", "left_anti")
        step = reached.groupBy("b").agg(F.min(F.struct(F.col("id"), F.col("a"))).alias("r")).select(
            F.col("b").alias("node"), F.col("r.id").alias("via"), F.col("r.a").alias("parent"), F.lit(depth).alias("depth")
        )
    # back along the parents: a row a step
    path, node = [], end
    for at in range(depth, 0, -1):
        row = visited.where((F.col("node") == node) & (F.col("depth") == at)).first()
        path.append((at, row.via))
        node = row.parent
    return spark.createDataFrame(path[::-1], "step int, id string")


def ego_subgraph(events: DataFrame, entities: DataFrame, relations: DataFrame, selected: str, event: str | None = None, most_events: int = 18, most_entities: int = 8) -> dict[str, DataFrame]:
    """An entity's surroundings: a sample of its events, the entities named with it most often there, and the
    relations among the sampled events (G3, J19, O9)."""
    mentions = mention_rows(events)
    own = events.join(mentions.where(F.col("entity_id") == selected).select(F.col("event_id").alias("id")), "id", "left_semi")
    sample = uniform_sample(own, most_events, event)
    shared = comentions(mentions, selected, sample).join(entities.select(F.col("id").alias("entity_id"), "label"), "entity_id")
    top = shared.orderBy(F.desc("n"), F.collate("label", "zh"), "entity_id").limit(most_entities)
    inside = relations.join(sample.select(F.col("id").alias("from")), "from", "left_semi").join(sample.select(F.col("id").alias("to")), "to", "left_semi")
    return {"events": sample, "entities": top.select("entity_id", "n"), "relations": inside}


def ego_edges(events: DataFrame, ego: dict[str, DataFrame], selected: str) -> DataFrame:
    """(source, target, kind): mentions of the visible entities, and relations of the sampled events."""
    seen = mention_rows(events).join(ego["events"].select(F.col("id").alias("event_id")), "event_id", "left_semi")
    shown = ego["entities"].select("entity_id").unionByName(events.sparkSession.createDataFrame([(selected,)], "entity_id string"))
    mention = seen.join(shown, "entity_id", "left_semi").select(F.col("entity_id").alias("source"), F.col("event_id").alias("target"), F.lit("mention").alias("kind"))
    return mention.unionByName(ego["relations"].select(F.col("from").alias("source"), F.col("to").alias("target"), F.lit("relation").alias("kind")))


def radial_layout(nodes: DataFrame, width: float, height: float, order: str = "rank") -> DataFrame:
    """Nodes (id, rank, ring) with places on ellipses around the centre, evenly by rank within a ring."""
    ring = W.partitionBy("ring")
    turn = 2 * F.pi() * (F.row_number().over(ring.orderBy(order, "id")) - 1) / F.count(F.lit(1)).over(ring) - F.pi() / 2
    radius = F.col("ring") / 2.2
    return nodes.withColumns({"x": F.round(width / 2 + F.cos(turn) * radius * width / 2, 3), "y": F.round(height / 2 + F.sin(turn) * radius * height / 2, 3)})


def hit_test(placed: DataFrame, x: float, y: float, reach: float = 7.0) -> DataFrame:
    """The nearest node whose circle, widened by `reach`, holds the point; no row if none does."""
    distance = F.sqrt(F.pow(F.col("x") - x, 2) + F.pow(F.col("y") - y, 2))
    return placed.withColumn("distance", distance).where(F.col("distance") <= F.col("radius") + reach).orderBy("distance", "id").limit(1)


def entity_detail(events: DataFrame, sources: DataFrame, selected: str, event: str | None = None, most: int = 80) -> DataFrame:
    """An entity's timeline, newest first, with each event's source and which one is selected: the given event,
    or the newest (G6, O8)."""
    own = events.where(F.array_contains("entityIds", selected))
    top = own.orderBy(F.desc("date"), F.collate("title", "zh"), "id").limit(most)
    joined = top.withColumn("source_id", F.get("sourceIds", F.lit(0))).join(sources.select(F.col("id").alias("source_id"), F.col("title").alias("source_title"), "repositoryPath"), "source_id", "left")
    newest = F.row_number().over(W.orderBy(F.desc("date"), F.collate("title", "zh"), "id")) == 1
    chosen = newest if event is None else (F.col("id") == event)
    return joined.withColumn("selected", chosen).select("id", "title", "date", "source_id", "source_title", "repositoryPath", "selected")



def entity_events(events: DataFrame, selected: str) -> DataFrame:
    """An entity's events, oldest first."""
    return events.where(F.array_contains("entityIds", selected)).orderBy("date", "id")


def with_labels(rows: DataFrame, types: DataFrame, column: str = "type", output: str = "typeLabel") -> DataFrame:
    """Adds a type's label, or its id if the ontology (`id`, `label`) doesn't know it."""
    known = types.select(F.col("id").alias(column), F.col("label").alias(output)).dropDuplicates([column])
    return rows.drop(output).join(known, column, "left").withColumn(output, F.coalesce(output, column))
