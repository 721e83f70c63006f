"""Dates along sequences: repair of episode dates, nearest anchors, adjacency of an entity's events, and
uniform samples of a timeline."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.functions.text import UNKNOWN_DATE
from newsloom.session import durable


def retained_positions(values: list) -> list[int]:
    """Positions of a longest non-decreasing subsequence. Of several, the one that ends last; going back,
    each element follows the earliest one that a longest run to it can have (W2).

    Patience piles find every element's run length in O(n log n); an element's predecessor is the first
    one with a run shorter by one and a value not above its own.
    """
    tails: list = []
    by_length: list[list[int]] = []
    length = []
    for at, value in enumerate(values):
        pile = bisect_right(tails, value)
        if pile == len(tails):
            tails.append(value)
            by_length.append([])
        else:
            tails[pile] = value
        by_length[pile].append(at)
        length.append(pile)
    if not values:
        return []
    kept = [by_length[-1][-1]]
    while length[kept[-1]]:
        last = kept[-1]
        # within a run length values fall from place to place: those that fit are the last ones of the pile
        pile = by_length[length[last] - 1]
        kept.append(pile[bisect_left(pile, True, key=lambda at: values[at] <= values[last])])
    return kept[::-1]


def retained_anchors(pages: DataFrame, series: str, order: list[str], value: str, key: str) -> DataFrame:
    """(series, key) of the rows whose values form the longest non-decreasing subsequence of their series.

    A series is one ordered sequence (the episodes of a programme: thousands of rows), so it is one group;
    its rows carry a key and a value only.
    """

    def keep(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order, kind="stable")
        return group.iloc[retained_positions(group[value].tolist())][[series, key]]

    kinds = dict(pages.dtypes)
    rows = pages.select(series, key, *[c for c in (*order, value) if c not in (series, key)])
    return rows.groupBy(series).applyInPandas(keep, f"`{series}` {kinds[series]}, `{key}` {kinds[key]}")


def nearest_anchors(rows: DataFrame, partition: list[str], at: str, anchor: Column, value: str) -> DataFrame:
    """As-of join in both directions: adds `prev_at`, `prev_value`, `next_at`, `next_value` of the nearest
    anchor strictly before and after (J14, W3). Rows of one place see the same anchors: the frames go by
    value, not by row."""
    point = F.when(anchor, F.struct(F.col(at).alias("at"), F.col(value).alias("value")))
    order = W.partitionBy(*partition).orderBy(at)
    # one row a place, so that a row frame is strict about places
    places = rows.groupBy(*partition, at).agg(F.max(point).alias("latest"), F.min(point).alias("earliest"))
    before = F.last("latest", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    after = F.first("earliest", ignorenulls=True).over(order.rowsBetween(1, W.unboundedFollowing))
    found = places.select(*partition, at, before.alias("b"), after.alias("a"))
    found = found.select(
        *partition, at, F.col("b.at").alias("prev_at"), F.col("b.value").alias("prev_value"), F.col("a.at").alias("next_at"), F.col("a.value").alias("next_value")
    )
    return rows.join(found, [*partition, at], "left")


def median_interval(anchors: DataFrame, partition: list[str], at: str, day: str, most: float = 14.0, default: float = 2.0) -> DataFrame:
    """(partition, days): the median of days per step between consecutive anchors, of steps over 0 and up to
    `most` days; `default` if there is none (A13, W6)."""
    order = W.partitionBy(*partition).orderBy(at, day)
    step = F.try_divide((F.col(day) - F.lag(day).over(order)).cast("double"), F.col(at) - F.lag(at).over(order))
    steps = anchors.select(*partition, step.alias("step"))
    good = F.when((F.col("step") > 0) & (F.col("step") <= most), F.col("step"))
    return steps.groupBy(*partition).agg(F.coalesce(F.median(good), F.lit(default)).alias("days"))


def interpolate(prev_at: Column, prev_day: Column, next_at: Column, next_day: Column, at: Column) -> Column:
    """The day at a place between two anchors, in proportion."""
    return prev_day + T.round_half_up(F.try_divide((next_day - prev_day) * (at - prev_at), next_at - prev_at))


def extrapolate(anchor_at: Column, anchor_day: Column, at: Column, days: Column) -> Column:
    """The day at a place beyond the anchors, by days per step."""
    return anchor_day + T.round_half_up((at - anchor_at) * days)


def reconcile_episode_dates(pages: DataFrame) -> DataFrame:
    """Pages with their dates repaired along the episode sequence.

    Trusted dates (neither of the front matter nor unknown) that fit the sequence are anchors and stay;
    all other episodes are interpolated between anchors or, at the ends, extrapolated. `dateProvenance`
    keeps the observed date and says how the date came about. Pages without an episode, null dates and
    series without anchors stay as they are; extra columns pass through.
    """
    source = F.col("dateProvenance.source")
    keyed = pages.withColumns({"_series": F.col("episode.series"), "_number": F.col("episode.number"), "_day": T.day_number(F.col("publishedAt"))})
    episodes = keyed.where(F.col("_series").isNotNull() & F.col("_number").isNotNull())
    rest = keyed.where(F.col("_series").isNull() | F.col("_number").isNull())
    trusted = ~source.isin("frontmatter", "unknown") & (F.col("publishedAt") != UNKNOWN_DATE) & F.col("_day").isNotNull()
    kept = retained_anchors(episodes.where(trusted), "_series", ["_number", "repositoryPath"], "publishedAt", "id")
    rows = episodes.join(kept.withColumn("_anchor", F.lit(True)).distinct(), ["_series", "id"], "left").withColumn("_anchor", F.coalesce("_anchor", F.lit(False)))
    rows = nearest_anchors(rows, ["_series"], "_number", F.col("_anchor"), "_day")
    days = median_interval(rows.where("_anchor").select("_series", "_number", "_day"), ["_series"], "_number", "_day")
    rows = rows.join(days, "_series", "left")
    both = F.col("prev_at").isNotNull() & F.col("next_at").isNotNull()
    day = (
        F.when(F.col("_anchor"), F.lit(None))
        .when(both, interpolate(F.col("prev_at"), F.col("prev_value"), F.col("next_at"), F.col("next_value"), F.col("_number")))
        .when(F.col("prev_at").isNotNull(), extrapolate(F.col("prev_at"), F.col("prev_value"), F.col("_number"), F.coalesce("days", F.lit(2.0))))
        .when(F.col("next_at").isNotNull(), extrapolate(F.col("next_at"), F.col("next_value"), F.col("_number"), F.coalesce("days", F.lit(2.0))))
    )
    how = (
        F.when(F.col("_anchor") | (F.col("prev_at").isNull() & F.col("next_at").isNull()), F.lit("observed"))
        .when(both & source.isin("frontmatter", "unknown"), F.lit("interpolated"))
        .when(both, F.lit("corrected_sequence_outlier"))
        .otherwise(F.lit("extrapolated"))
    )
    rows = rows.withColumns({"publishedAt": F.coalesce(T.iso_of_day(day), F.col("publishedAt")), "dateProvenance": F.col("dateProvenance").withField("resolution", how)})
    return rows.select(*pages.columns).unionByName(rest.select(*pages.columns))


def push_dates(news: DataFrame, pages: DataFrame) -> DataFrame:
    """News of episode pages take their page's date, and its precision (J15); other news stay."""
    dates = pages.where("episode IS NOT NULL").select(F.col("id").alias("pageId"), F.col("publishedAt").alias("_date"))
    rows = news.join(dates, "pageId", "left")
    rows = rows.withColumns(
        {
            "date": F.coalesce("_date", "date"),
            "datePrecision": F.when(F.col("_date").isNotNull(), T.date_precision(F.col("_date"))).otherwise(F.col("datePrecision")),
        }
    )
    return rows.select(*news.columns)


def precedes(
    mentions: DataFrame, entities: DataFrame, caps: dict[str, int] | None = None, default_cap: int = 250, skip: tuple[str, ...] = ("topic",)
) -> DataFrame:
    """Chronology: (id, from, to, type, viaEntityId, confidence, evidence, sourceId) between consecutive events
    of an entity (W1).

    `mentions` has (event_id, entity_id, date, source_id); `entities` (id, label, type, rank), rank being the
    order in which entities claim a pair. An entity takes part with 2 up to its type's cap of mentions,
    counted before unknown dates are dropped; the cap is part of the meaning, and it bounds every window
    below to that many rows, so the hubs that would skew them are gone before the sort. Events of one day
    are not linked, nor bridged. A pair is emitted once.
    """
    caps = {"place": 90} if caps is None else caps
    counts = mentions.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    cap = F.lit(default_cap)
    for kind, value in caps.items():
        cap = F.when(F.col("type") == kind, F.lit(value)).otherwise(cap)
    chosen = entities.where(~F.coalesce("type", F.lit("")).isin(*skip)).withColumn("_cap", cap)
    chosen = chosen.join(counts, F.col("id") == F.col("entity_id")).where((F.col("n") >= 2) & (F.col("n") <= F.col("_cap"))).select("entity_id", "label", "rank")
    rows = mentions.where(F.col("date") != UNKNOWN_DATE).join(chosen, "entity_id")
    order = W.partitionBy("entity_id").orderBy("date", "event_id")
    rows = rows.withColumns({"_from": F.lag("event_id").over(order), "_before": F.lag("date").over(order)}).where(F.col("_before") != F.col("date"))
    claim = W.partitionBy("_from", "event_id").orderBy("rank", "entity_id")
    first = rows.withColumn("_claim", F.row_number().over(claim)).where("_claim = 1")
    return first.select(
        T.relation_id(F.col("_from"), F.col("event_id")).alias("id"),
        F.col("_from").alias("from"),
        F.col("event_id").alias("to"),
        F.lit("precedes").alias("type"),
        F.col("entity_id").alias("viaEntityId"),
        F.lit(1.0).alias("confidence"),
        F.concat(F.lit("两条新闻均明确涉及“"), F.col("label"), F.lit("”，且日期可确认先后；此关系只表达时间顺序，不表达因果。")).alias("evidence"),
        F.col("source_id").alias("sourceId"),
    )


def entity_rank(entities: DataFrame) -> DataFrame:
    """Adds `rank`, the order by type and label in Chinese collation, then id (O2): a sort key, not a number
    of rows, so no row goes through one task."""
    return entities.withColumn("rank", F.struct(F.coalesce("type", F.lit("")).alias("type"), F.collate(F.coalesce("label", F.lit("")), "zh").alias("label"), F.col("id").alias("id")))


def uniform_sample(events: DataFrame, size: int = 18, selected: str | None = None) -> DataFrame:
    """At most `size` (id, date) rows of a timeline, at even distances in its order, first and last included;
    a selected event that was missed takes the last but one place (W11).

    `events` is one entity's timeline, which may hold a tenth of all rows: it is sorted in ranges, and a row's
    position is its place in its range behind the sizes of the ranges before, of which there are few.
    """
    ranges = events.select("id", "date").repartitionByRange("date", "id").sortWithinPartitions("date", "id")
    # the upper bits of these numbers are the range, the lower 33 bits the place in it
    placed = durable(ranges.withColumn("_m", F.monotonically_increasing_id()), "timeline")
    placed = placed.select("id", "date", F.shiftright("_m", 33).alias("_range"), F.col("_m").bitwiseAND((1 << 33) - 1).alias("_place"))
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = F.coalesce(F.sum("_size").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    numbered = placed.join(F.broadcast(sizes.select("_range", before.alias("_before"))), "_range").select("id", "date", (F.col("_before") + F.col("_place")).alias("_at"))
    total = numbered.agg(F.count(F.lit(1)).alias("n"))
    slots = total.select("n", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("slot"))
    place = T.round_half_up(F.col("slot") * (F.col("n") - 1) / F.lit(float(size - 1)))
    slots = slots.select("slot", F.when(F.col("n") <= size, F.col("slot")).otherwise(place).cast("int").alias("_at")).where("_at >= 0")
    found = numbered.join(F.broadcast(slots), "_at").select("slot", "id", "date")
    if selected is not None:
        missed = numbered.where(F.col("id") == selected).join(found.select("id"), "id", "left_anti").select(F.lit(size - 2).alias("slot"), "id", "date")
        found = found.join(missed.select("slot"), "slot", "left_anti").unionByName(missed)
    return found.select("id", "date").distinct()
