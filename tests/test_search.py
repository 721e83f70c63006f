import pytest
from conftest import rows

from newsloom.operators import search as Q

EVENTS = "id string, title string, summary string, significance string, type string, date string, entityIds array<string>, sourceIds array<string>"
ENTITIES = "id string, label string, type string, aliases array<string>, description string, extraction struct<method:string,confidence:double,eventCount:bigint>"


@pytest.fixture(scope="module")
def docs(spark):
    events = spark.createDataFrame(
        [
            ("e1", "世卫组织通报疫情", "摘要", "", "health", "2020-01-02", ["p1"], ["s1"]), ("e2", "关于ＡＩ的报道", "提到世卫组织", "", "tech", "2021-05-01", ["p1", "p2", "p1", "zz"], ["s1"]),
            ("e3", "ai", None, None, None, "2022-01-01", None, None), ("e4", "北京市新闻", "", "", "tech", "1900-01-01", [], ["none"]),
        ],
        EVENTS,
    )
    entities = spark.createDataFrame([("p1", "北京", "place", ["京城"], "首都", ("gazetteer", 1.0, 9)), ("p2", "李雷", "person", None, None, None)], ENTITIES)
    sources = spark.createDataFrame([("s1", "第一页", "episode", "book/1.md")], "id string, title string, kind string, repositoryPath string")
    types = spark.createDataFrame([("health", "卫生", "公共卫生")], "id string, label string, description string")
    kinds = spark.createDataFrame([("place", "地点", "国家或城市")], "id string, label string, description string")
    return events, entities, Q.event_documents(events, entities, sources, types, kinds), Q.entity_documents(entities)


def test_queries():
    assert Q.parse_query('"a b" c') == [["ab"], ["c"]]
    assert Q.parse_query("ＷＨＯ") == [["who", "世界卫生组织", "世卫组织"]]
    assert Q.parse_query("朝阳区") == [["朝阳区", "朝阳"]] and Q.parse_query("市") == [["市"]]
    assert Q.parse_query("！ ？") == [] and Q.parse_query(None) == []


def test_keyword_search(docs):
    *_, ev, _ = docs
    assert rows(Q.search_events(ev, "世卫组织"), "id", "rank") == [("e1", 40), ("e2", 16)]
    assert [r.id for r in Q.search_events(ev, "人工智能").collect()] == ["e3", "e2"]
    assert [r.id for r in Q.search_events(ev, "ai").collect()] == ["e3", "e2"]
    # metadata: entities, their types, source, event type
    assert rows(Q.search_events(ev, "京城 世卫组织"), "id") == [("e1",), ("e2",)]
    assert rows(Q.search_events(ev, "公共卫生"), "id", "rank") == [("e1", 6)]
    assert rows(Q.search_events(ev, "第一页"), "id", "rank") == [("e1", 3), ("e2", 3)]
    # an empty query takes everything, newest first
    assert [r.id for r in Q.search_events(ev, "").collect()] == ["e3", "e2", "e1", "e4"]
    assert Q.search_events(ev.limit(0), "x").count() == 0


def test_entity_search_and_result(docs):
    _, _, ev, en = docs
    assert rows(Q.search_entities(en, "北京"), "id", "rank") == [("p1", 100)]
    assert rows(Q.search_entities(en, "京城"), "id", "rank") == [("p1", 24)]
    found = Q.run_search(ev, en, "世卫组织", most_events=1)
    assert (found.total.first().n, found.events.count(), found.mode) == (2, 1, "keyword")
    found = Q.run_search(ev, en, " ", Q.Facets(entities=("p1",)))
    assert (found.total.first().n, rows(found.entities, "id"), found.mode) == (2, [("p1",)], "filter")


def test_facets(docs):
    events = docs[0]
    assert rows(Q.facet_filter(events, Q.Facets("tech", start_year="2021年", end_year="2021")), "id") == [("e2",)]
    assert rows(Q.facet_filter(events, Q.Facets(entities=("p1", "p2"))), "id") == [("e2",)]
    assert Q.facet_filter(events, Q.Facets()).count() == 4
    assert Q.year_text("20a21x9") == "2021"


def test_picker(docs):
    entities = docs[1]
    assert [r.id for r in Q.pick_entities(entities).collect()] == ["p1", "p2"]
    assert rows(Q.pick_entities(entities, "person", "李"), "id") == [("p2",)]
    assert [r.id for r in Q.pick_entities(entities, current="p2", most=1).collect()] == ["p2"]
    assert Q.ranked_entities(entities).first().id == "p1"


def test_picker_without_a_limit(spark):
    many = spark.range(30).selectExpr("concat('p', id) AS id", "concat('L', id) AS label", "'person' AS type", "array('a') AS aliases", "'d' AS description", "named_struct('eventCount', id) AS extraction")
    assert Q.pick_entities(many).count() == 24 and Q.pick_entities(many, most=None).count() == Q.pick_entities(many, current="p3", most=None).count() == 30
