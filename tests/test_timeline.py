from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from newsloom.operators import timeline as L


def slow(values):
    n = len(values)
    if not n:
        return []
    length, before, best = [1] * n, [-1] * n, 0
    for i in range(n):
        for c in range(i):
            if values[c] <= values[i] and length[c] + 1 > length[i]:
                length[i], before[i] = length[c] + 1, c
        if length[i] >= length[best]:
            best = i
    out = []
    while best >= 0:
        out.append(best)
        best = before[best]
    return out[::-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=14))
def test_longest_sequence_against_brute_force(values):
    assert L.retained_positions(values) == slow(values)


PAGES = "id string, repositoryPath string, publishedAt string, dateProvenance struct<observedAt:string,source:string,resolution:string>, episode struct<series:string,number:double>, extra int"


def page(i, number, date, source):
    return (f"p{i}", f"main/{i}.md", date, (date, source, "observed"), ("s", float(number)) if number is not None else None, i)


def test_reconcile(spark):
    data = [
        page(1, 1, "2019-07-12", "episode_preamble"), page(2, 2, "2023-01-24", "frontmatter"), page(3, 3, "2019-07-18", "episode_preamble"),
        page(4, 4, "2018-01-01", "episode_preamble"), page(5, 5, "2019-07-24", "page_title"), page(6, 7, "1900-01-01", "unknown"), page(7, None, "2020-01-01", "frontmatter"),
    ]
    found = {r.id: (r.publishedAt, r.dateProvenance.resolution, r.dateProvenance.observedAt) for r in L.reconcile_episode_dates(spark.createDataFrame(data, PAGES)).collect()}
    assert found["p2"] == ("2019-07-15", "interpolated", "2023-01-24")
    assert found["p4"] == ("2019-07-21", "corrected_sequence_outlier", "2018-01-01")
    # three days an episode
    assert found["p6"] == ("2019-07-30", "extrapolated", "1900-01-01")
    assert found["p7"][:2] == ("2020-01-01", "observed") and found["p1"][:2] == ("2019-07-12", "observed")


def test_reconcile_without_anchors_and_empty(spark):
    lone = L.reconcile_episode_dates(spark.createDataFrame([page(1, 1, "2020-01-01", "frontmatter")], PAGES)).collect()
    assert [(r.publishedAt, r.dateProvenance.resolution, r.extra) for r in lone] == [("2020-01-01", "observed", 1)]
    assert L.reconcile_episode_dates(spark.createDataFrame([], PAGES)).count() == 0


def test_anchors_are_strict_about_places(spark):
    data = [("s", 1.0, 10, True), ("s", 2.0, 20, True), ("s", 2.0, 0, False), ("s", 3.0, 0, False)]
    df = spark.createDataFrame(data, "series string, n double, day int, anchor boolean")
    found = L.nearest_anchors(df, ["series"], "n", F.col("anchor"), "day")
    assert rows(found, "n", "day", "prev_at", "next_at") == [(1.0, 10, None, 2.0), (2.0, 0, 1.0, None), (2.0, 20, 1.0, None), (3.0, 0, 2.0, None)]


def test_median_interval(spark):
    df = spark.createDataFrame([("s", float(n), d) for n, d in ((1, 0), (2, 3), (3, 5), (4, 60), (5, 60))], "series string, n double, day int")
    assert rows(L.median_interval(df, ["series"], "n", "day")) == [("s", 2.5)]
    assert rows(L.median_interval(df.where("n = 1"), ["series"], "n", "day")) == [("s", 2.0)]


def test_precedes(spark):
    mentions = [("e1", "a", "2020-01-01"), ("e2", "a", "2020-01-01"), ("e3", "a", "2020-01-02"), ("e1", "b", "2020-01-01"), ("e3", "b", "2020-01-02"), ("e4", "b", "1900-01-01"), ("e1", "t", "2020-01-01"), ("e3", "t", "2020-01-02")]
    m = spark.createDataFrame([(e, x, d, f"p-{e}") for e, x, d in mentions], "event_id string, entity_id string, date string, source_id string")
    ents = spark.createDataFrame([("a", "A", "person", 2), ("b", "B", "place", 1), ("t", "T", "topic", 0)], "id string, label string, type string, rank int")
    found = L.precedes(m, ents)
    assert rows(found, "from", "to", "viaEntityId", "sourceId") == [("e1", "e3", "b", "p-e3"), ("e2", "e3", "a", "p-e3")]
    # the cap counts mentions before unknown dates are dropped
    assert rows(L.precedes(m, ents, {"place": 2}), "from", "viaEntityId") == [("e2", "a")]
    assert L.precedes(m.limit(0), ents).count() == 0


def test_uniform_sample(spark):
    df = spark.createDataFrame([(f"e{i:03}", f"2020-01-{i % 28 + 1:02}") for i in range(100)], "id string, date string")
    sample = L.uniform_sample(df)
    order = [r.id for r in df.orderBy("date", "id").collect()]
    want = {order[int(i * 99 / 17 + 0.5)] for i in range(18)}
    assert {r.id for r in sample.collect()} == want
    missed = next(i for i in order if i not in want)
    chosen = {r.id for r in L.uniform_sample(df, selected=missed).collect()}
    assert missed in chosen and len(chosen) == 18
    assert L.uniform_sample(df.limit(5)).count() == 5
    assert L.uniform_sample(df.limit(0)).count() == 0
