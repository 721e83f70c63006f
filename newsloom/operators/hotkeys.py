"""Per-key results under heavy skew: algebraic states are combined on the map side, so what
shuffles is bounded by (keys x map tasks), however many rows a hot key has.

Spark's hash aggregate is the bounded per-partition hash table: it spills to a sort when full and
emits one mergeable state per key and task. Nothing here groups raw rows of a key into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.session import durable

#: Hashes that are broadcast at most, about 4 MB.
BROADCAST_ROWS = 200_000


def mentions(events: DataFrame, event_id: str = "id", items: str = "entityIds") -> DataFrame:
    """Distinct pairs (event_id, entity_id) of an array column.

    Null or empty arrays and null elements give no pair; an id that repeats within an event, or in
    a second row of the same event, gives one; an event without id can't be told apart and gives
    none. Pairs are spread by both columns, so neither a hot entity nor an event that comes in a
    third of all rows lands in one task.
    """
    per_row = events.select(
        F.col(event_id).alias("event_id"),
        F.explode(F.array_distinct(F.col(items))).alias("entity_id"),
    )
    return per_row.where(F.col("event_id").isNotNull() & F.col("entity_id").isNotNull()).distinct()


def combine_by_key(rows: DataFrame, key: str, **aggregates: Column) -> DataFrame:
    """`groupBy(key)` limited to algebraic aggregates (count, sum, min, max, avg, ...): their
    partial states have a fixed size. Null keys form one group of their own."""
    return rows.groupBy(key).agg(*[a.alias(name) for name, a in aggregates.items()])


def key_counts(pairs: DataFrame, key: str = "entity_id", name: str = "mentions") -> DataFrame:
    """Rows of each key."""
    return combine_by_key(pairs, key, **{name: F.count(F.lit(1))})


def mention_counts(events: DataFrame, event_id: str = "id", items: str = "entityIds") -> DataFrame:
    """(entity_id, mentions): the counts of mentions(), without sending a pair for each of them.

    An event that has one row needs no comparison with others: its pairs are counted where they are read,
    and one state for each key and task shuffles. Only hashes of ids go through a shuffle of their own, to
    find events with several rows; only the pairs of these are made distinct. Two ids with one hash
    only take the longer way.
    """
    hashed = events.where(F.col(event_id).isNotNull()).select(F.col(event_id).alias("id"), F.col(items).alias("items"), F.xxhash64(event_id).alias("h"))
    again = durable(hashed.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "again")
    few = again.count() <= BROADCAST_ROWS
    marked = F.broadcast(again) if few else again
    once = hashed.join(marked, "h", "left_anti").select(F.explode(F.array_distinct("items")).alias("entity_id")).where("entity_id IS NOT NULL")
    more = mentions(hashed.join(marked, "h", "left_semi"), "id", "items")
    states = key_counts(once).unionByName(key_counts(more))
    return combine_by_key(states, "entity_id", mentions=F.sum("mentions"))


def heavy_keys(pairs: DataFrame, key: str = "entity_id", share: float = 0.01) -> DataFrame:
    """heavy_counts() of rows that are counted here."""
    return heavy_counts(key_counts(pairs, key), key, share)


def heavy_counts(counts: DataFrame, key: str = "entity_id", share: float = 0.01) -> DataFrame:
    """Of counts (key, mentions), keys that hold at least `share` of all, with their counts and the total.

    The total is the sum of the compact per-key counts, not a second pass over the rows; it joins
    back as one broadcast row. An empty input gives no rows.
    """
    # one row, whatever the input: the broadcast has a fixed size
    total = counts.agg(F.sum("mentions").alias("total"))
    return counts.join(F.broadcast(total), F.col("mentions") >= F.col("total") * F.lit(share)).select(
        key, "mentions", "total"
    )
