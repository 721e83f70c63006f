"""Bootstrap, rebuild, update and validation of a published graph, with the guards that keep it append-only."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators.incremental import Graph, append_graph, append_news, archive_changes
from newsloom.operators.report import upstream_report
from newsloom.plans.pipeline import GraphData, NewsData
from newsloom.session import drop_path, scratch
from newsloom.sources.archive import write_table


class LifecycleError(RuntimeError):
    """A mode that must not run on the state as it is."""


@dataclass(frozen=True)
class Versions:
    """What a state was made with; an update refuses any drift (I4)."""

    dataset: str = "1.1.0"
    segmentation: str = "1.3.0"
    rules: str = "0"
    ontology: str = "0"
    overrides: str = "0"
    roots: tuple[str, ...] = field(default=())


def _join(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}"


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def read_state(spark: SparkSession, state: str) -> Versions | None:
    """The versions of a state, or None if there is none yet."""
    if not exists(spark, _join(state, "versions")):
        return None
    value = json.loads(spark.read.text(_join(state, "versions")).first()[0])
    return Versions(**{**value, "roots": tuple(value["roots"])})


def save_changed(spark: SparkSession, tables: dict[str, DataFrame], state: str) -> list[str]:
    """Writes those tables whose rows differ from what is there, and names them (I5). All new rows go to the
    shared folder first, as any of them may be made from any old table."""
    fresh = {name: scratch(spark, f"fresh-{name}") for name in tables}
    for name, rows in tables.items():
        rows.write.parquet(fresh[name])
    written = []
    for name in tables:
        new, path = spark.read.parquet(fresh[name]), _join(state, name)
        if exists(spark, path):
            old = spark.read.parquet(path)
            if old.schema.simpleString() == new.schema.simpleString() and _digest(old) == _digest(new):
                continue
        write_table(new, path)
        written.append(name)
    for path in fresh.values():
        drop_path(spark, path)
    return written


def _digest(rows: DataFrame) -> tuple:
    """Count and order-free digest of a table: one row of fixed size."""
    text = F.xxhash64(F.to_json(F.struct(*rows.columns)))
    return tuple(rows.agg(F.count(F.lit(1)), F.sum(text.cast("decimal(38,0)")), F.bit_xor(text)).first())


TABLES = ("pages", "news", "entities", "events", "relations")


def _tables(news: NewsData, graph: GraphData) -> dict[str, DataFrame]:
    return {"pages": news.pages, "news": news.news, "entities": graph.entities, "events": graph.events, "relations": graph.relations}


def _save(spark: SparkSession, state: str, tables: dict[str, DataFrame], manifest: DataFrame, versions: Versions) -> list[str]:
    written = save_changed(spark, {**tables, "manifest": manifest}, state)
    row = spark.createDataFrame([(json.dumps(asdict(versions)),)], "value string")
    if read_state(spark, state) != versions:
        row.coalesce(1).write.mode("overwrite").text(_join(state, "versions"))
        written.append("versions")
    return written


def bootstrap(spark: SparkSession, state: str, news: NewsData, graph: GraphData, manifest: DataFrame, versions: Versions) -> list[str]:
    """The first state; refuses to overwrite one."""
    if read_state(spark, state) is not None:
        raise LifecycleError("a state exists; use rebuild or update")
    return _save(spark, state, _tables(news, graph), manifest, versions)


def unresolved(changes: DataFrame) -> DataFrame:
    """Changes that an append can't take up: anything but added pages."""
    return changes.where(F.col("bucket") != "added")


def rebuild(spark: SparkSession, state: str, news: NewsData, graph: GraphData, manifest: DataFrame, versions: Versions, accept: bool = False) -> list[str]:
    """A whole new state. Refuses while the archive has modified, deleted, renamed or duplicated pages that
    nobody accepted."""
    if read_state(spark, state) is not None and not accept:
        pending = unresolved(archive_changes(spark.read.parquet(_join(state, "manifest")), manifest))
        if not pending.isEmpty():
            raise LifecycleError("unresolved upstream changes; review them first")
    return _save(spark, state, _tables(news, graph), manifest, versions)


def update(spark: SparkSession, state: str, news: NewsData, graph: GraphData, manifest: DataFrame, versions: Versions) -> tuple[list[str], DataFrame]:
    """Appends the pages that were added, and reports all other changes without applying them. Refuses on any
    drift of versions or roots. Returns what was written, and the changes by bucket."""
    old = read_state(spark, state)
    if old is None:
        raise LifecycleError("no state yet; use bootstrap")
    if old != versions:
        raise LifecycleError(f"versions changed from {old} to {versions}; a rebuild is needed")
    accepted = spark.read.parquet(_join(state, "manifest"))
    changes = archive_changes(accepted, manifest)
    added = changes.where("bucket = 'added'").select("path", "hash")
    have = {n: spark.read.parquet(_join(state, n)) for n in TABLES}
    merged, _ = append_graph(
        Graph(have["entities"], have["events"], have["relations"], have["pages"]), Graph(graph.entities, graph.events, graph.relations, news.pages), added.select("path")
    )
    pages, all_news = append_news((have["pages"], have["news"]), (news.pages, news.news), added.select("path"))
    tables = {"pages": pages, "news": all_news, "entities": merged.entities, "events": merged.events, "relations": merged.relations}
    report = upstream_report(changes)
    kept = scratch(spark, "upstream")
    report.write.parquet(kept)
    return _save(spark, state, tables, accepted.unionByName(added), versions), spark.read.parquet(kept)
