from conftest import rows

from newsloom.operators import hotkeys as H

EVENTS = "id string, entityIds array<string>, mentions int, total int"


def test_mentions_are_distinct_pairs(spark):
    events = spark.createDataFrame(
        [("a", ["x", "x", None, "y"], 1, 1), ("a", ["x"], 2, 2), ("b", [], 0, 0), ("c", None, 0, 0), (None, ["x"], 0, 0), ("d", ["x"], 0, 0)], EVENTS
    )
    assert rows(H.mentions(events)) == [("a", "x"), ("a", "y"), ("d", "x")]


def test_counts_without_pairs(spark, monkeypatch):
    """Events of one row are counted where they are read, those of several rows by distinct pairs."""
    events = spark.createDataFrame(
        [("a", ["x", "x", None, "y"], 1, 1), ("a", ["x", "z"], 2, 2), ("b", [], 0, 0), ("c", None, 0, 0), (None, ["x"], 0, 0), (None, ["x"], 0, 0), ("d", ["x", "x"], 0, 0)]
        + [(f"e{i}", ["hot", f"k{i}"], 0, 0) for i in range(50)] + [("hot", ["hot"], 0, 0)] * 40, EVENTS,
    )
    want = rows(H.key_counts(H.mentions(events)))
    assert rows(H.mention_counts(events)) == want and ("hot", 51) in want and ("x", 2) in want
    monkeypatch.setattr(H, "BROADCAST_ROWS", 0)
    assert rows(H.mention_counts(events)) == want
    assert H.mention_counts(events.limit(0)).count() == 0


def test_heavy_keys_include_the_exact_share_and_ties(spark):
    pairs = spark.createDataFrame([(str(i), "hot") for i in range(50)] + [(str(i), f"k{i // 25}") for i in range(50)], "event_id string, entity_id string")
    assert rows(H.heavy_keys(pairs, share=0.25)) == [("hot", 50, 100), ("k0", 25, 100), ("k1", 25, 100)]
    assert rows(H.heavy_keys(pairs, share=0.26), "entity_id") == [("hot",)]


def test_a_third_of_all_rows_under_one_key(spark):
    pairs = spark.range(30_000).selectExpr("CAST(id AS STRING) AS event_id", "IF(id % 3 = 0, 'hot', CONCAT('k', id % 997)) AS entity_id")
    assert rows(H.heavy_keys(pairs), "entity_id", "mentions") == [("hot", 10_000)]
    assert H.key_counts(pairs).agg({"mentions": "sum"}).first()[0] == 30_000


def test_empty_table(spark):
    empty = spark.createDataFrame([], EVENTS)
    assert rows(H.heavy_keys(H.mentions(empty))) == []


def test_long_arrays(spark):
    events = spark.createDataFrame([("a", [str(i % 5000) for i in range(20_000)], 0, 0)], EVENTS)
    assert H.mentions(events).count() == 5000
