from conftest import rows
from pyspark.sql import functions as F

from newsloom.operators import extract as X
from newsloom.operators import graph as G

RULES = X.Rules(
    topics=({"id": "t1", "label": "能源", "keywords": ["风电", "核电"]},),
    event_classes=({"id": "accident", "keywords": ["爆炸", "事故"]}, {"id": "law", "keywords": ["法院"]}),
    topic_classes={"t1": "energy"},
    places=({"label": "中国", "aliases": ["我国", "国"]}, {"label": "美国", "aliases": ["美方"]}),
    organization_suffixes=("研究院", "大学", "公司"),
    organization_aliases=({"label": "北京大学", "aliases": ["北方大学"]},),
    facility_suffixes=("大桥",),
    person_roles=("部长", "记者"),
    reviewed_links={"news-1": [{"type": "organization", "label": "华光"}]},
)


def candidates(spark, headline, text=None, news="news-9"):
    df = spark.createDataFrame([("e1", news, headline, text or headline)], "event_id string, news_id string, headline string, text string")
    return {(r.type, r.label): r for r in X.extract_candidates(df, RULES).collect()}


def test_extraction_of_every_kind(spark):
    found = candidates(spark, "我国外交部长王小明在清风大学宣布《数据安全条例》，《海洋年鉴》，在长江大桥与风电")
    assert set(found) == {("place", "中国"), ("person", "王小明"), ("organization", "清风大学"), ("policy", "《数据安全条例》"), ("document", "《海洋年鉴》"), ("facility", "长江大桥"), ("topic", "能源")}
    assert found["topic", "能源"].aliases == ["风电", "核电"] and found["place", "中国"].prominent


def test_named_parts_are_read_in_the_headline_only(spark):
    found = candidates(spark, "标题", "标题 清风大学 我国")
    assert set(found) == {("place", "中国")} and not found["place", "中国"].prominent
    assert set(candidates(spark, "", "清风大学")) == {("organization", "清风大学")}


def test_reviewed_links_aliases_and_empty(spark):
    assert ("organization", "华光") in candidates(spark, "无", news="news-1")
    assert ("organization", "北京大学") in candidates(spark, "记者：北方大学开学")
    assert candidates(spark, "") == {}
    df = spark.createDataFrame([("e1", None, None, None)], "event_id string, news_id string, headline string, text string")
    assert X.extract_candidates(df, RULES).count() == 0


def test_label_cleaners():
    # the later listed word counts where two breakers begin at one place, then the right-most place
    assert X.clean_named("比如说清风大学", 24) == "清风大学"
    assert X.clean_named("2019年3家由清风大学", 24) == "清风大学"
    assert X.clean_named("甲在乙和清风大学", 24) == "清风大学"
    assert X.clean_named("“" + "长" * 30 + "大学”", 24) == "长" * 22 + "大学"
    assert X.clean_person("前王小明表示") == "王小明"
    assert X.clean_person("安娜·李") == "安娜·李" and X.clean_person("John Smith") == "John Smith"
    assert X.clean_person("某某公司") == "" and X.clean_person("王") == ""
    assert not X.useful_organization("各地大学", RULES) and not X.useful_organization("大学", RULES) and X.useful_facility("长江大桥", RULES)


def test_classification(spark):
    cases = [("法院 法院", "", "law"), ("爆炸 法院", "", "accident"), ("核电", "", "energy"), ("无", "法院", "law"), ("无", "", "other"), (None, None, "other")]
    df = spark.createDataFrame([(i, h, t) for i, (h, t, _) in enumerate(cases)], "i int, headline string, text string")
    assert [r["class"] for r in X.classify_events(df, RULES).orderBy("i").collect()] == [c for *_, c in cases]


CANDIDATES = [
    ("k1", "e1", 5, "person", "甲", ["a"], "role_after", 0.86, False), ("k1", "e2", 1, "person", "甲甲", ["b", "a"], "reviewed_news_link", 1.0, True),
    ("k2", "e1", 7, "facility", "桥", [], "facility_suffix", 0.84, True), ("k3", "e1", 9, "policy", "《法》", [], "document_title", 0.98, False),
]


def test_statistics_and_support(spark):
    stats = G.candidate_stats(spark.createDataFrame(CANDIDATES, X.CANDIDATES))
    assert rows(stats, "key", "label", "method", "confidence", "prominent", "eventCount", "aliases")[0] == ("k1", "甲", "reviewed_news_link", 1.0, True, 2, ["a", "b"])
    # the event that was ingested first, whatever its id
    ingested = spark.createDataFrame([("e1", "b.md"), ("e2", "a.md")], "event_id string, seq string")
    later = G.candidate_stats(spark.createDataFrame(CANDIDATES, X.CANDIDATES), ingested)
    assert rows(later, "key", "label")[0] == ("k1", "甲甲") and later.count() == 3
    kept = stats.where(G.should_keep(F.col("type"), F.col("method"), F.col("eventCount"), F.col("prominent")))
    assert rows(kept, "key") == [("k1",), ("k3",)]
    made = G.materialize_entities(kept)
    assert "2 条" in made.where("label = '甲'").first().description
    assert G.candidate_stats(spark.createDataFrame([], X.CANDIDATES)).count() == 0


def test_fixed_lists_are_the_default(spark):
    rules = X.Rules.from_json(
        """{"topics": [{"id": "topic-energy", "label": "能源", "keywords": ["光伏组件"]}], "organizationSuffixes": ["政府", "商务部"], "personRoles": ["记者", "官员"],
        "facilitySuffixes": ["铁路"], "isoRegionCodes": "FR XX"}"""
    )
    text = "省级政府在这条铁路旁说，记者采访。双林市政府回应。"
    found = X.extract_candidates(spark.createDataFrame([("e", "n", text, text)], "event_id string, news_id string, headline string, text string"), rules)
    assert {r.label for r in found.collect()} == {"双林市政府"}
    texts = spark.createDataFrame([("光伏组件降价", "")], "headline string, text string")
    assert X.classify_events(texts, rules).first()["class"] == "environment_energy"
    assert X.region_names(spark, rules.region_codes) == ["法国"]


EVENTS = "id string, date string, title string, entityIds array<string>, sourceIds array<string>"


def test_rematch_and_counts(spark):
    texts = spark.createDataFrame([("e1", "清风大学与长江大桥"), ("e2", None), ("e3", ""), ("e4", "x" * 200_000 + "长江大桥")], "event_id string, text string")
    names = spark.createDataFrame([("b", "长江大桥"), ("u", "清风大学"), ("u", "清风大学"), ("z", ""), ("y", None)], "entity_id string, value string")
    found = G.rematch(texts, names)
    assert rows(found) == [("e1", "b"), ("e1", "u"), ("e4", "b")]
    assert G.rematch(texts, names.limit(0)).count() == 0
    events = spark.createDataFrame([("e1", "d", "t", ["u", "x"], ["p"]), ("e2", "d", "t", None, ["p"])], EVENTS)
    assert rows(G.with_rematched(events, found), "id", "entityIds") == [("e1", ["u", "x", "b"]), ("e2", [])]
    ents = spark.createDataFrame([("u", "U", ("role_after", 0.86, 7), "old"), ("n", "N", ("gazetteer", 1.0, 0), "old")], "id string, label string, extraction struct<method:string,confidence:double,eventCount:bigint>, description string")
    counted = G.with_event_counts(ents, G.mention_rows(events)).orderBy("id").collect()
    assert [(r.id, r.extraction.eventCount, r.description[:3]) for r in counted] == [("n", 0, "old"), ("u", 1, "由职务")]


RELATIONS = [("r1", "a", "b"), ("r2", "c", "b"), ("r3", "c", "d"), ("r4", "a", "e"), ("r5", "e", "d"), ("r6", "x", "y")]


def test_paths_and_neighbours(spark):
    rel = spark.createDataFrame(RELATIONS, "id string, from string, to string")
    assert rows(G.event_path(rel, "a", "d")) == [(1, "r4"), (2, "r5")]
    assert rows(G.event_path(rel, "b", "e")) == [(1, "r1"), (2, "r4")]
    assert rows(G.event_path(rel, "a", "y")) == [] and rows(G.event_path(rel, "a", "a")) == []
    assert rows(G.neighbor_relations(rel, "b"), "id") == [("r1",), ("r2",)]


def test_a_path_of_any_length(spark):
    chain = [(f"r{i:02}", f"e{i:02}", f"e{i + 1:02}") for i in range(66)]
    rel = spark.createDataFrame(chain, "id string, from string, to string").coalesce(1).cache()
    assert sorted(map(tuple, G.event_path(rel, "e00", "e66").collect())) == [(i + 1, f"r{i:02}") for i in range(66)]


def test_ego_subgraph(spark):
    events = spark.createDataFrame([("a", "2020-01-01", "t", ["h", "x"], ["p"]), ("b", "2020-01-02", "t", ["h", "x", "y"], ["p"]), ("c", "2020-01-03", "t", ["y"], ["p"])], EVENTS)
    ents = spark.createDataFrame([("h", "H"), ("x", "X"), ("y", "Y")], "id string, label string")
    rel = spark.createDataFrame([("r1", "a", "b"), ("r2", "b", "c")], "id string, from string, to string")
    ego = G.ego_subgraph(events, ents, rel, "h")
    assert rows(ego["entities"]) == [("x", 2), ("y", 1)] and rows(ego["relations"], "id") == [("r1",)]
    assert ("h", "a", "mention") in rows(G.ego_edges(events, ego, "h")) and ("a", "b", "relation") in rows(G.ego_edges(events, ego, "h"))
    placed = G.radial_layout(spark.createDataFrame([("a", 1, 1), ("b", 2, 1)], "id string, rank int, ring int"), 100, 100).withColumn("radius", F.lit(5.0))
    a = placed.where("id = 'a'").first()
    assert G.hit_test(placed, a.x + 1, a.y).first().id == "a" and G.hit_test(placed, 1e6, 0).count() == 0


def test_labels_and_timelines(spark):
    events = spark.createDataFrame([("b", "2020-01-02", "t", ["x"], ["p"]), ("a", "2020-01-01", "t", ["x", "y"], ["p"]), ("c", "2019-01-01", "t", ["y"], ["p"])], EVENTS)
    assert [r.id for r in G.entity_events(events, "x").collect()] == ["a", "b"]
    types = spark.createDataFrame([("t", "标签")], "id string, label string")
    assert rows(G.with_labels(spark.createDataFrame([("t",), ("u",), (None,)], "type string"), types)) == [("t", "标签"), ("u", "u"), (None, None)]
