import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from newsloom.operators import incremental as I
from newsloom.operators import validate as V
from newsloom.operators.report import upstream_report
from newsloom.plans import lifecycle as C
from newsloom.plans import pipeline as P
from newsloom.sources import archive as A
from newsloom.streaming import archive_stream as ST
from test_graph import RULES

MANIFEST = "path string, hash string"
BODY = "这是一段足够长的正文，记者王小明在清风大学报道风电的情况，用来说明这一条新闻的来龙去脉，并且超过四十个字，以免被丢掉。"


def test_archive_changes(spark):
    old = spark.createDataFrame([("main/1", "h1"), ("main/2", "h2"), ("main/3", "h3"), ("main/5", None), ("main/6", "h6")], MANIFEST)
    new = spark.createDataFrame([("main/1", "x"), ("main/3r", "h3"), ("main/4", "h4"), ("main/5", None), ("main/6", "h6"), ("main/6b", "h6"), ("main/7", None), (None, "h")], MANIFEST)
    assert rows(I.archive_changes(old, new), "bucket", "path", "paths") == [
        ("added", "main/4", None), ("added", "main/7", None), ("deleted", "main/2", None), ("deleted", "main/3", None), ("duplicate", "main/6b", ["main/6"]), ("modified", "main/1", None),
        ("possible_rename", "main/3r", ["main/3"]),
    ]
    assert I.archive_changes(old.limit(0), new.limit(0)).count() == 0
    assert rows(upstream_report(I.archive_changes(old, new)), "bucket", "n")[:2] == [("added", 2), ("deleted", 2)]


def write(root, name, text):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as out:
        out.write(text)


def page(n, extra=""):
    return f"---\ntitle: 第{n}页\n---\n## 1、第{n}页的甲\n{BODY}{extra}\n\n## 2、第{n}页的乙\n{BODY}爆炸\n"


def make_archive(root):
    for n in (1, 2):
        write(root, f"daily/2020/01/0{n}.md", page(n))
    write(root, "daily/.hidden/x.md", page(9))
    write(root, "daily/notes.txt", "x")
    write(root, "elsewhere/x.md", page(8))
    return root


@pytest.fixture
def archive(tmp_path):
    return make_archive(str(tmp_path / "archive"))


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    """News, graph, manifest and pages of the archive, made once."""
    root = make_archive(str(tmp_path_factory.mktemp("shared") / "archive"))
    return (*build(spark, root), A.read_pages(spark, root))


def build(spark, root):
    news = P.build_news(A.read_pages(spark, root))
    return news, P.build_graph(news, RULES), A.file_manifest(spark, root)


def test_sources(spark, archive, tmp_path):
    assert rows(A.read_pages(spark, archive), "path") == [("daily/2020/01/01.md",), ("daily/2020/01/02.md",)]
    assert rows(A.read_pages(spark, archive, limit=1), "path") == [("daily/2020/01/01.md",)]
    import hashlib

    assert rows(A.file_manifest(spark, archive))[0] == ("daily/2020/01/01.md", hashlib.sha256(page(1).encode()).hexdigest())
    assert A.read_pages(spark, str(tmp_path / "nowhere")).count() == 0
    with pytest.raises(FileNotFoundError):
        A.require_pages(A.read_pages(spark, str(tmp_path / "nowhere")), "nowhere")
    write(str(tmp_path), "r.json", '{"a": 1,\n "b": ["x"]}')
    assert rows(A.read_json(spark, str(tmp_path / "r.json"), "a int, b array<string>")) == [(1, ["x"])]
    assert A.read_json(spark, str(tmp_path / "no.json"), required=False) is None
    assert A.to_json_rows(spark.createDataFrame([(1, None)], "a int, b string")).first().value == '{"a":1,"b":null}'
    assert A.archive_version(str(tmp_path)) == ("", "")
    args = A.arguments(["update", "--archive=x", "--state", "y", "--roots", "daily,main"])
    assert (args.mode, args.archive, args.roots) == ("update", "x", ("daily", "main"))


def test_json_document(spark, tmp_path):
    import json

    rows_ = spark.createDataFrame([("b", None, ["x"]), ("a", 1, [])], "id string, n int, l array<string>")
    path = str(tmp_path / "graph.json")
    for _ in range(2):  # written again in place
        A.write_json_document(rows_, path, ["id"])
    text = (tmp_path / "graph.json").read_text()
    assert json.loads(text) == [{"id": "a", "n": 1, "l": []}, {"id": "b", "n": None, "l": ["x"]}] and text.startswith('[\n  {\n    "id": "a",')
    A.write_json_document(rows_.limit(0), path, ["id"])
    assert (tmp_path / "graph.json").read_text() == "[]\n"


def test_lifecycle_is_append_only(spark, archive, built, tmp_path):
    state, versions = str(tmp_path / "state"), C.Versions(rules="1", roots=("daily",))
    first = built[:3]
    with pytest.raises(C.LifecycleError):
        C.update(spark, state, *first, versions)
    C.bootstrap(spark, state, *first, versions)
    with pytest.raises(C.LifecycleError):
        C.bootstrap(spark, state, *first, versions)
    before = A.published(spark, state, ("events", "pages"))
    old_events, old_pages = rows(before["events"]), rows(before["pages"], "repositoryPath", "contentHash")
    write(archive, "daily/2020/01/03.md", page(3))
    write(archive, "daily/2020/01/01.md", page(1, "改动"))
    os.remove(os.path.join(archive, "daily/2020/01/02.md"))
    second = build(spark, archive)
    with pytest.raises(C.LifecycleError):
        C.update(spark, state, *second, C.Versions(rules="2", roots=("daily",)))
    with pytest.raises(C.LifecycleError):
        C.rebuild(spark, state, *second, versions)
    written, changes = C.update(spark, state, *second, versions)
    assert rows(changes, "bucket", "n") == [("added", 1), ("deleted", 1), ("modified", 1)]
    assert {"pages", "events", "manifest"} <= set(written) and "versions" not in written
    after = A.published(spark, state, ("events", "pages", "entities"))
    assert set(map(repr, old_events)) < set(map(repr, rows(after["events"]))) and after["events"].count() == 6
    assert set(old_pages) < set(rows(after["pages"], "repositoryPath", "contentHash"))
    counted = after["events"].select(F.explode("entityIds").alias("id")).groupBy("id").count()
    assert after["entities"].join(counted, "id", "left").where("coalesce(count, 0) <> extraction.eventCount").count() == 0
    # nothing changes when nothing is new
    same = {"events": spark.read.parquet(f"{state}/events")}
    assert C.save_changed(spark, same, state) == []


ONTOLOGY = V.Ontology.from_json(
    {
        "version": "1", "recordUnit": {"id": "news"}, "eventEntityConstraint": {"minimumEntities": 0},
        "facets": [{"id": "subject", "entityTypes": ["person", "organization"]}],
        "eventEntityRoles": [{"id": "subject", "label": "s", "description": "d", "entityTypes": ["person", "organization"]}, {"id": "rest", "label": "r", "description": "d", "entityTypes": ["place", "facility", "policy", "document", "topic"]}],
        "entityTypes": [{"id": t, "label": t, "color": "#aabbcc"} for t in ("person", "organization", "place", "facility", "policy", "document", "topic")],
        "eventTypes": [{"id": t, "label": t} for t in ("accident", "law", "energy", "other")],
        "relationTypes": [{"id": "precedes", "label": "p", "description": "d", "from": ["event"], "to": ["event"]}],
    }
)


def test_built_data_is_valid_and_damage_is_found(built):
    news, graph, _, pages = built
    assert rows(V.validate_news(news.pages, news.news)) == []
    raw = pages.join(news.pages.select(F.col("repositoryPath").alias("path"), F.col("id").alias("pageId")), "path")
    assert rows(V.validate_fragments(news.news, news.pages, raw)) == []
    assert rows(V.validate_projection(news.news, graph.events, news.pages, graph.sources)) == []
    found = V.validate_graph(graph.entities, graph.events, graph.relations, graph.sources, ONTOLOGY)
    assert rows(found, "level", "message") == [("error", "an event must have at least one entity")]
    assert graph.relations.count() > 0 and graph.relations.where(~F.col("id").startswith("relation-")).count() == 0
    broken = graph.events.withColumn("entityIds", F.array(F.lit("nobody"))).withColumn("date", F.lit("20-1-1")).unionByName(graph.events.limit(1))
    messages = {r.message for r in V.validate_graph(graph.entities, broken, graph.relations, graph.sources.limit(0), ONTOLOGY).collect()}
    assert {"missing entity nobody", "invalid date"} <= messages and any(m.startswith("duplicate ID event-") for m in messages) and any(m.startswith("missing source page-") for m in messages)
    damaged = raw.withColumn("raw", F.concat("raw", F.lit("x")))
    assert {r.message for r in V.validate_fragments(news.news, news.pages, damaged).collect()} >= {"page hash differs"}


def test_a_missing_page_fails_the_job(built):
    news = built[0]
    with pytest.raises(Exception, match="references missing page"):
        P.require_owned(news.news, news.pages.limit(0)).collect()


def test_stream_appends_new_pages(spark, tmp_path):
    folder, store, check = (str(tmp_path / n) for n in ("in", "store", "check"))
    put = lambda data, n: spark.createDataFrame(data, ST.RAW).coalesce(1).write.mode("append").parquet(folder)
    put([("daily/1.md", page(1)), ("daily/2.md", page(2))], 1)
    ST.append_batches(ST.read_page_stream(spark, folder), store, check).awaitTermination()
    assert spark.read.parquet(f"{store}/news").count() == 4
    put([("daily/1.md", page(1, "改")), ("daily/3.md", page(3)), ("daily/4.md", page(2))], 2)
    ST.append_batches(ST.read_page_stream(spark, folder), store, check).awaitTermination()
    assert spark.read.parquet(f"{store}/news").count() == 6
    review = spark.read.parquet(f"{store}/review")
    assert rows(review, "bucket", "path") == [("duplicate", "daily/4.md"), ("modified", "daily/1.md")]
    assert ST.news_stream(ST.read_page_stream(spark, folder)).isStreaming


def test_command_line(spark, archive, tmp_path, capsys):
    from newsloom.plans import cli

    state = str(tmp_path / "state")
    assert cli.main(["bootstrap", "--archive", archive, f"--state={state}"], spark) == 0
    assert cli.main(["bootstrap", "--archive", archive, f"--state={state}"], spark) == 1
    assert cli.main(["validate", "--archive", archive, f"--state={state}"], spark) == 0
    write(archive, "daily/2020/01/01.md", page(1, "改动"))
    assert cli.main(["validate", "--archive", archive, f"--state={state}"], spark) == 1
    assert "page hash differs" in capsys.readouterr().out
