"""The core's registered queries and, where SQL can say the same, their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.operators import extract as X
from newsloom.operators import graph as G
from newsloom.operators import hotkeys, snapshots
from newsloom.operators import incremental as I
from newsloom.operators import report as R
from newsloom.operators import search as Q
from newsloom.operators import segment as S
from newsloom.operators import timeline as L
from newsloom.operators import validate as V
from newsloom.plans import pipeline as P
from newsloom.session import durable, spread, table


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    counts = hotkeys.mention_counts(table(spark, root, "kg_events"))
    return hotkeys.heavy_counts(counts).select(F.col("entity_id").alias("entityId"))


P3_PAIRS = """(SELECT DISTINCT id, e FROM (SELECT id, unnest(entityIds) AS e FROM kg_events) WHERE id IS NOT NULL AND e IS NOT NULL)"""
P3_FOUND_SQL = f"""
SELECT e AS entityId FROM {P3_PAIRS} GROUP BY e HAVING count(*) >= 0.01 * (SELECT count(*) FROM {P3_PAIRS})"""


def p3_counts(spark: SparkSession, root: str) -> DataFrame:
    return hotkeys.mention_counts(table(spark, root, "kg_events")).select(F.col("entity_id").alias("entityId"), "mentions")


P3_COUNTS_SQL = f"SELECT e AS entityId, CAST(count(*) AS BIGINT) AS mentions FROM {P3_PAIRS} GROUP BY e"


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return snapshots.changes(
        table(spark, root, "source_snapshots"),
        key=snapshots.canonical_path(F.col("repositoryPath")),
        value=snapshots.canonical_hash(F.col("contentHash")),
    )


P4_FOUND_SQL = r"""
WITH r AS (
  SELECT DISTINCT snapshotNo AS no,
    regexp_replace(regexp_replace(regexp_replace(trim(repositoryPath), '[\\/]+', '/', 'g'), '^(/|\./)+', ''), '/(\./)+', '/', 'g') AS k,
    nullif(lower(regexp_replace(trim(contentHash), '^[sS][hH][aA]-?256[:=]\s*', '')), '') AS v
  FROM source_snapshots WHERE snapshotNo IS NOT NULL),
n AS (SELECT no, lead(no) OVER (ORDER BY no) AS nxt FROM (SELECT DISTINCT no FROM r)),
g AS (SELECT no, k, list_sort(list(coalesce(v, '-'))) AS vs FROM r WHERE k IS NOT NULL GROUP BY no, k),
o AS (SELECT n.nxt AS no, k, vs FROM g JOIN n USING (no) WHERE n.nxt IS NOT NULL),
c AS (SELECT * FROM g WHERE no > (SELECT min(no) FROM r))
SELECT coalesce(c.no, o.no) AS snapshotNo, coalesce(c.k, o.k) AS repositoryPath,
  CASE WHEN o.k IS NULL THEN 'added' WHEN c.k IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM c FULL JOIN o ON c.no = o.no AND c.k = o.k
WHERE o.k IS NULL OR c.k IS NULL OR c.vs <> o.vs"""

# --- the archive's graph as the tables hold it: rows that come twice are one record, the one ingested last


def latest(rows: DataFrame, order: str) -> DataFrame:
    """One row per id: the last by `order`."""
    return rows.where("id IS NOT NULL").groupBy("id").agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


def kg_events(spark: SparkSession, root: str) -> DataFrame:
    return latest(table(spark, root, "kg_events"), "ingestedAt")


def kg_sources(spark: SparkSession, root: str) -> DataFrame:
    return latest(table(spark, root, "sources"), "ingestedAt")


def kg_entities(spark: SparkSession, root: str) -> DataFrame:
    """One row per id, with the type that the id states; of repeated rows, the least."""
    rows = table(spark, root, "entities").withColumn("type", F.regexp_extract("id", "^entity-([a-z]+)-", 1))
    return rows.where("id IS NOT NULL").groupBy("id").agg(F.min(F.struct("label", "type", "aliases", "description", "extraction")).alias("r")).select("id", "r.*")


EVENTS = "(SELECT * FROM kg_events QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingestedAt DESC) = 1)"
SOURCES = "(SELECT * FROM sources QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingestedAt DESC) = 1)"
ENTITIES = "(SELECT id, min(label) AS label, regexp_extract(id, '^entity-([a-z]+)-', 1) AS type FROM entities GROUP BY id)"
MENTIONS = f"(SELECT DISTINCT id AS event_id, unnest(entityIds) AS entity_id FROM {EVENTS})"


def kg_labels(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "entities").groupBy("id").agg(F.min("label").alias("label"))
    return rows.withColumn("type", F.regexp_extract("id", "^entity-([a-z]+)-", 1))


def sql_text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def sql_replace(column: str, pattern: str, replacement: str = "") -> str:
    return f"regexp_replace({column}, {sql_text(pattern)}, {sql_text(replacement.replace('$1', chr(92) + '1'))}, 'g')"


def sql_trim(column: str) -> str:
    return sql_replace(column, rf"^{T.WS}+|{T.WS}+\z")


def sql_squeeze(column: str) -> str:
    return sql_trim(sql_replace(f"coalesce({column}, '')", f"{T.WS}+", " "))


def sql_clean(column: str) -> str:
    out = f"coalesce({column}, '')"
    for pattern, replacement in T.MARKUP:
        out = sql_replace(out, pattern, replacement)
    return sql_squeeze(out)


QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if there is one."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


query(P3_FOUND_SQL)(p3_found)
query(P3_COUNTS_SQL)(p3_counts)
query(P4_FOUND_SQL)(p4_found)

# --- text and identity


@query(f"SELECT id, {sql_clean('raw')} AS text FROM raw_pages")
def clean_text_pages(spark, root):
    return table(spark, root, "raw_pages").select("id", T.clean_text(F.col("raw")).alias("text"))


@query(
    f"""SELECT id, coalesce({sql_trim("string_split_regex(x, '[。！？!?；;]')[1]")}, x) AS first FROM
    (SELECT DISTINCT id, {sql_squeeze('summary')} AS x FROM kg_events)"""
)
def first_sentences(spark, root):
    return table(spark, root, "kg_events").select("id", T.first_sentence(T.squeeze(F.col("summary"))).alias("first")).distinct()


@query(rf"""SELECT DISTINCT id, lower({sql_replace("coalesce(label, '')", rf'[{T.WS_CHARS}《》“”"' + chr(39) + r'（）()_\-]')}) AS identifier FROM entities""")
def identifiers(spark, root):
    return table(spark, root, "entities").select("id", T.normalize_identifier(F.col("label")).alias("identifier")).distinct()


@query(
    """SELECT DISTINCT repositoryPath AS path, 'page-' || left(sha1(repositoryPath), 12) AS page,
    'news-' || left(sha1(repositoryPath || chr(0) || segmentation.strategy || chr(0) || coalesce(title, '')), 12) AS news,
    'relation-' || left(sha1(id || ':' || kind || ':precedes'), 12) AS relation FROM sources"""
)
def stable_ids(spark, root):
    s = table(spark, root, "sources")
    return s.select(
        F.col("repositoryPath").alias("path"), T.page_id(F.col("repositoryPath")).alias("page"),
        T.news_id(F.col("repositoryPath"), F.col("segmentation.strategy"), F.coalesce("title", F.lit(""))).alias("news"), T.relation_id(F.col("id"), F.col("kind")).alias("relation"),
    ).distinct()


@query("SELECT id, sha256(raw) AS hash FROM raw_pages")
def content_hashes(spark, root):
    return table(spark, root, "raw_pages").select("id", F.sha2("raw", 256).alias("hash"))


_Y = "((?:18|19|20)\\d{2})"
_ZH = rf"{_Y}{T.WS}*年{T.WS}*(\d{{1,2}}){T.WS}*月{T.WS}*(\d{{1,2}}){T.WS}*日"
_ISO = rf"{_Y}-(\d{{1,2}})-(\d{{1,2}})"


def _sql_day(pattern: str) -> str:
    part = [f"regexp_extract(raw, {sql_text(pattern)}, {i})" for i in (1, 2, 3)]
    return f"CASE WHEN {part[0]} <> '' THEN {part[0]} || '-' || lpad({part[1]}, 2, '0') || '-' || lpad({part[2]}, 2, '0') END"


@query(
    f"""SELECT id, coalesce({_sql_day(_ZH)}, {_sql_day(_ISO)}, nullif(regexp_extract(raw, {sql_text(_Y + T.WS + '*年')}, 1), '') || '-01-01') AS date,
    CASE WHEN coalesce({_sql_day(_ZH)}, {_sql_day(_ISO)}) IS NOT NULL THEN 'day' WHEN regexp_extract(raw, {sql_text(_Y + T.WS + '*年')}, 1) <> '' THEN 'year' END AS precision FROM raw_pages"""
)
def explicit_dates(spark, root):
    return table(spark, root, "raw_pages").select("id", T.explicit_date(F.col("raw")).alias("d")).select("id", "d.date", "d.precision")


@query(
    rf"""SELECT id, CAST(len(list_filter(list_distinct(CASE WHEN length(x) >= 3 THEN [substring(x, i, 3) FOR i IN range(1, length(x) - 1)] ELSE [] END),
    lambda g: g NOT IN ({', '.join(sql_text(t) for t in T.STOP_TRIGRAMS)}))) AS INTEGER) AS trigrams
    FROM (SELECT DISTINCT id, regexp_replace(coalesce(title, ''), '[^\p{{Han}}A-Za-z0-9]', '', 'g') AS x FROM news)"""
)
def title_trigrams(spark, root):
    return table(spark, root, "news").select("id", F.size(T.han_trigrams(F.col("title"))).alias("trigrams")).distinct()


@query(
    f"""SELECT id, CASE WHEN datePrecision = 'year' THEN left(date, 4) WHEN datePrecision = 'month' THEN strftime(CAST(date AS DATE), '%Y 年 %-m 月')
    ELSE strftime(CAST(date AS DATE), '%Y年%-m月%-d日') END AS shown, CASE WHEN length(title) > 11 THEN left(title, 11) || '…' ELSE title END AS short FROM {EVENTS}"""
)
def event_labels(spark, root):
    e = kg_events(spark, root)
    return e.select("id", T.format_event_date(F.col("date"), F.col("datePrecision")).alias("shown"), T.shorten(F.col("title"), 11).alias("short"))


@query()
def normalized_titles(spark, root):
    return table(spark, root, "kg_events").select("id", T.normalize_search(F.col("title")).alias("text")).distinct()


# --- pages and news


@query()
def segment_pages(spark, root):
    return S.pages_of(S.parse_pages(spread(table(spark, root, "raw_pages"))))


@query()
def segment_news(spark, root):
    return S.news_of(S.parse_pages(spread(table(spark, root, "raw_pages")))).drop("fragmentText")


def latest_pages(spark, root):
    """(path, raw): of each path the text that was accepted last; of equal times the one with the larger id."""
    times = table(spark, root, "sources").groupBy("id").agg(F.min("ingestedAt").alias("at"))
    times = times.unionByName(table(spark, root, "source_batches").groupBy("id").agg(F.min("arrivedAt").alias("at")))
    raw = table(spark, root, "raw_pages").where("path IS NOT NULL AND raw IS NOT NULL").join(times.groupBy("id").agg(F.min("at").alias("at")), "id", "left")
    return raw.groupBy("path").agg(F.max_by("raw", F.struct("at", "id")).alias("raw"))


@query()
def news_fragments(spark, root):
    pages = durable(latest_pages(spark, root), "pages")
    parsed = S.parse_pages(spread(pages))
    raw = pages.select(T.page_id(F.col("path")).alias("pageId"), "raw")
    rows = S.read_fragments(S.news_of(parsed).drop("fragmentText"), raw, strict=False)
    return rows.select("id", "pageId", "intact", F.length("fragmentText").alias("length"))


@query(
    f"""SELECT id, len(list_filter(string_split_regex(coalesce(raw, ''), '\\r?\\n'), lambda x: regexp_matches(x, {sql_text(S.NUMBERED)}))) AS headings,
    len(list_filter(string_split_regex(coalesce(raw, ''), '\\r?\\n'), lambda x: regexp_matches(x, {sql_text(S.RULE)}))) AS rules FROM raw_pages""".replace("\\\\r", "\\r").replace("\\\\n", "\\n")
)
def page_boundaries(spark, root):
    lines = F.split(F.coalesce("raw", F.lit("")), r"\r?\n", -1)
    count = lambda p: F.size(F.filter(lines, lambda x: x.rlike(p))).cast("bigint")
    return table(spark, root, "raw_pages").select("id", count(S.NUMBERED).alias("headings"), count(S.RULE).alias("rules"))


_LONGEST = f"""
WITH RECURSIVE p AS MATERIALIZED (SELECT id, episode.series AS series, episode.number AS n, repositoryPath AS path, publishedAt AS date, dateProvenance.source AS source, dateProvenance.resolution AS resolution,
    date_diff('day', DATE '1970-01-01', TRY_CAST(publishedAt AS DATE)) AS day, episode IS NOT NULL AND episode.series IS NOT NULL AND episode.number IS NOT NULL AS counted FROM {SOURCES}),
t AS MATERIALIZED (SELECT id, series, n, date, day, row_number() OVER (PARTITION BY series ORDER BY n, path) AS i FROM p WHERE counted AND source NOT IN ('frontmatter', 'unknown') AND date <> '1900-01-01' AND day IS NOT NULL),
v AS MATERIALIZED (SELECT series, list(date ORDER BY i) AS dates, count(*) AS size FROM t GROUP BY series),
runs AS (SELECT series, dates, size, 1 AS i, [1] AS lens FROM v UNION ALL
    SELECT series, dates, size, i + 1, list_append(lens, 1 + coalesce(list_max([CASE WHEN dates[j] <= dates[i + 1] THEN lens[j] ELSE 0 END FOR j IN range(1, i + 1)]), 0)) FROM runs WHERE i < size),
run AS MATERIALIZED (SELECT series, unnest(lens) AS len, generate_subscripts(lens, 1) AS i FROM runs WHERE i = size),
x AS MATERIALIZED (SELECT t.*, run.len FROM t JOIN run USING (series, i)),
kept AS (SELECT series, max(i) AS i, max(len) AS len FROM x WHERE len = (SELECT max(y.len) FROM x y WHERE y.series = x.series) GROUP BY series UNION ALL
    SELECT k.series, (SELECT min(y.i) FROM x y JOIN x z ON z.series = k.series AND z.i = k.i WHERE y.series = k.series AND y.len = k.len - 1 AND y.i < k.i AND y.date <= z.date), k.len - 1 FROM kept k WHERE k.len > 1),
a AS MATERIALIZED (SELECT x.id, x.series, x.n, x.day FROM x JOIN kept USING (series, i)),
steps AS (SELECT series, (day - lag(day) OVER w) / nullif(n - lag(n) OVER w, 0) AS step FROM a WINDOW w AS (PARTITION BY series ORDER BY n, day)),
pace AS (SELECT series, coalesce(median(step) FILTER (step > 0 AND step <= 14), 2.0) AS days FROM steps GROUP BY series),
hi AS (SELECT series, n, max(day) AS hi, min(day) AS lo FROM a GROUP BY series, n),
near AS (SELECT p.*, a.id IS NOT NULL AS anchor, (SELECT max(n) FROM hi WHERE hi.series = p.series AND hi.n < p.n) AS pn, (SELECT min(n) FROM hi WHERE hi.series = p.series AND hi.n > p.n) AS nn FROM p LEFT JOIN a USING (id) WHERE counted),
d AS (SELECT near.*, b.hi AS pd, c.lo AS nd, coalesce(pace.days, 2.0) AS days FROM near LEFT JOIN hi b ON b.series = near.series AND b.n = pn LEFT JOIN hi c ON c.series = near.series AND c.n = nn LEFT JOIN pace ON pace.series = near.series),
e AS (SELECT *, CASE WHEN anchor THEN NULL WHEN pn IS NOT NULL AND nn IS NOT NULL THEN pd + floor((nd - pd) * (n - pn) / (nn - pn) + 0.5) WHEN pn IS NOT NULL THEN pd + floor((n - pn) * days + 0.5) WHEN nn IS NOT NULL THEN nd + floor((n - nn) * days + 0.5) END AS moved FROM d)
SELECT id, coalesce(strftime(DATE '1970-01-01' + CAST(moved AS INTEGER), '%Y-%m-%d'), date) AS publishedAt,
  CASE WHEN anchor OR (pn IS NULL AND nn IS NULL) THEN 'observed' WHEN pn IS NOT NULL AND nn IS NOT NULL THEN CASE WHEN source IN ('frontmatter', 'unknown') THEN 'interpolated' ELSE 'corrected_sequence_outlier' END ELSE 'extrapolated' END AS resolution FROM e
UNION ALL SELECT id, date, resolution FROM p WHERE NOT counted"""


@query(_LONGEST)
def reconciled_dates(spark, root):
    return L.reconcile_episode_dates(kg_sources(spark, root)).select("id", "publishedAt", "dateProvenance.resolution")


_EPISODES = f"(SELECT id, episode.number AS n, date_diff('day', DATE '1970-01-01', TRY_CAST(publishedAt AS DATE)) AS day, dateProvenance.source NOT IN ('frontmatter', 'unknown') AND publishedAt <> '1900-01-01' AS anchor FROM {SOURCES} WHERE episode IS NOT NULL AND episode.number IS NOT NULL)"


def _episodes(spark, root):
    s = kg_sources(spark, root).where("episode IS NOT NULL AND episode.number IS NOT NULL")
    anchor = ~F.col("dateProvenance.source").isin("frontmatter", "unknown") & (F.col("publishedAt") != "1900-01-01")
    return s.select("id", F.col("episode.series").alias("series"), F.col("episode.number").alias("n"), T.day_number(F.col("publishedAt")).alias("day"), anchor.alias("anchor"))


@query(
    f"""WITH e AS {_EPISODES}, p AS (SELECT n, max(CASE WHEN anchor THEN day END) AS hi, min(CASE WHEN anchor THEN day END) AS lo FROM e GROUP BY n)
    SELECT e.id, b.n AS prev_at, CAST(b.hi AS INTEGER) AS prev_value, a.n AS next_at, CAST(a.lo AS INTEGER) AS next_value FROM e
    LEFT JOIN p AS b ON b.n = (SELECT max(n) FROM p WHERE hi IS NOT NULL AND p.n < e.n) LEFT JOIN p AS a ON a.n = (SELECT min(n) FROM p WHERE lo IS NOT NULL AND p.n > e.n)"""
)
def nearest_anchors(spark, root):
    rows = L.nearest_anchors(_episodes(spark, root), ["series"], "n", F.col("anchor"), "day")
    return rows.select("id", "prev_at", "prev_value", "next_at", "next_value")


@query(
    f"""WITH e AS {_EPISODES}, s AS (SELECT (day - lag(day) OVER w) / nullif(n - lag(n) OVER w, 0) AS step FROM e WHERE anchor WINDOW w AS (ORDER BY n, day))
    SELECT round(coalesce(median(step) FILTER (step > 0 AND step <= 14), 2.0), 6) AS days FROM s"""
)
def median_interval(spark, root):
    e = _episodes(spark, root).where("anchor").withColumn("one", F.lit(1))
    return L.median_interval(e.select("one", "n", "day"), ["one"], "n", "day").select(F.round("days", 6).alias("days"))


# --- graph


def _dated_mentions(events):
    return G.mention_rows(events).join(events.select(F.col("id").alias("event_id"), "date", F.get("sourceIds", F.lit(0)).alias("source_id")), "event_id")


_PRECEDES = f"""
WITH m AS (SELECT x.event_id, x.entity_id, e.date, e.sourceIds[1] AS source_id FROM {MENTIONS} x JOIN {EVENTS} e ON e.id = x.event_id WHERE x.entity_id IS NOT NULL),
n AS (SELECT entity_id, count(*) AS n FROM m GROUP BY 1),
c AS (SELECT t.id, t.label, t.type FROM {ENTITIES} t JOIN n ON n.entity_id = t.id WHERE t.type <> 'topic' AND n.n >= 2 AND n.n <= CASE WHEN t.type = 'place' THEN 90 ELSE 250 END),
s AS (SELECT m.*, c.type, lag(event_id) OVER w AS f, lag(date) OVER w AS d FROM m JOIN c ON c.id = m.entity_id WHERE date <> '1900-01-01' WINDOW w AS (PARTITION BY entity_id ORDER BY date, event_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY f, event_id ORDER BY type, entity_id) AS k FROM s WHERE f IS NOT NULL AND d <> date)
"""


def _relations(spark, root):
    events = kg_events(spark, root)
    entities = kg_labels(spark, root).withColumn("rank", F.struct("type", "id"))
    return L.precedes(_dated_mentions(events), entities)


@query(
    _PRECEDES
    + """SELECT 'relation-' || left(sha1(f || ':' || event_id || ':precedes'), 12) AS id, f AS "from", event_id AS "to", 'precedes' AS type, entity_id AS viaEntityId,
    CAST(1.0 AS DOUBLE) AS confidence, source_id AS sourceId FROM r WHERE k = 1"""
)
def chronology(spark, root):
    return _relations(spark, root).drop("evidence")


@query(
    """WITH m AS (SELECT DISTINCT l_orderkey AS e, l_partkey AS p, CAST(o_orderdate AS DATE) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    n AS (SELECT p FROM m GROUP BY p HAVING count(*) BETWEEN 2 AND 30), s AS (SELECT m.*, lag(e) OVER w AS f, lag(d) OVER w AS b FROM m JOIN n USING (p) WINDOW w AS (PARTITION BY p ORDER BY d, e)),
    r AS (SELECT *, row_number() OVER (PARTITION BY f, e ORDER BY p) AS k FROM s WHERE b <> d) SELECT CAST(f AS VARCHAR) AS "from", CAST(e AS VARCHAR) AS "to", CAST(p AS VARCHAR) AS via FROM r WHERE k = 1"""
)
def chronology_parts(spark, root):
    o = table(spark, root, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"))
    m = table(spark, root, "lineitem").select("l_orderkey", "l_partkey").distinct().join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    # numbers in digits of one length order like numbers
    key = lambda c: F.lpad(F.col(c).cast("string"), 12, "0")
    m = m.select(key("l_orderkey").alias("event_id"), key("l_partkey").alias("entity_id"), F.col("date").cast("string").alias("date"), F.lit("").alias("source_id"))
    parts = table(spark, root, "part").select(key("p_partkey").alias("id"), F.lit("part").alias("label"), F.lit("part").alias("type"), key("p_partkey").alias("rank"))
    plain = lambda c: F.col(c).cast("bigint").cast("string")
    return L.precedes(m, parts, {}, 30).select(plain("from").alias("from"), plain("to").alias("to"), plain("viaEntityId").alias("via"))


@query(f"SELECT t.id, CAST(count(DISTINCT m.event_id) AS BIGINT) AS n FROM {ENTITIES} t LEFT JOIN {MENTIONS} m ON m.entity_id = t.id GROUP BY t.id")
def entity_event_counts(spark, root):
    counted = G.with_event_counts(kg_entities(spark, root).withColumn("extraction", F.coalesce("extraction", F.struct(F.lit("x").alias("method"), F.lit(0.0).alias("confidence"), F.lit(-1).cast("bigint").alias("eventCount")))), G.mention_rows(kg_events(spark, root)))
    return counted.select("id", F.col("extraction.eventCount").alias("n"))


@query(f"SELECT t.id, t.label, t.type, CAST(count(DISTINCT m.event_id) AS BIGINT) AS n FROM {ENTITIES} t JOIN {MENTIONS} m ON m.entity_id = t.id GROUP BY ALL")
def facet_options(spark, root):
    return G.facet_options(kg_labels(spark, root), G.mention_rows(kg_events(spark, root)))


@query(
    f"""SELECT m.event_id AS id, string_agg(m.entity_id, ',' ORDER BY m.pos) AS entities FROM
    (SELECT id AS event_id, e AS entity_id, min(pos) AS pos FROM (SELECT id, unnest(entityIds) AS e, generate_subscripts(entityIds, 1) AS pos FROM {EVENTS}) GROUP BY ALL) m
    JOIN {ENTITIES} t ON t.id = m.entity_id GROUP BY 1"""
)
def resolved_entities(spark, root):
    rows = G.event_entities(kg_events(spark, root), kg_entities(spark, root)).where(F.size("entities") > 0)
    return rows.select("id", F.array_join(F.transform("entities", lambda n: n["id"]), ",").alias("entities"))


def _hub(spark, root, kind: str) -> str:
    """The entity of a type with the most mentions: one row."""
    m = G.mention_rows(kg_events(spark, root)).where(F.col("entity_id").startswith(f"entity-{kind}-"))
    row = m.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "entity_id").first()
    return row[0] if row else ""


_HUB = f"(SELECT entity_id FROM {MENTIONS} WHERE entity_id LIKE 'entity-person-%' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


@query(f"SELECT entity_id, CAST(count(*) AS BIGINT) AS n FROM {MENTIONS} WHERE event_id IN (SELECT event_id FROM {MENTIONS} WHERE entity_id = {_HUB}) AND entity_id <> {_HUB} GROUP BY 1")
def comentions(spark, root):
    return G.comentions(G.mention_rows(kg_events(spark, root)), _hub(spark, root, "person"))


@query(
    f"""WITH e AS (SELECT id, date, row_number() OVER (ORDER BY date, id) - 1 AS pos, count(*) OVER () AS n FROM {EVENTS} WHERE list_contains(entityIds, {_HUB})),
    s AS (SELECT DISTINCT CASE WHEN n <= 18 THEN i ELSE CAST(floor(i * (n - 1) / 17.0 + 0.5) AS BIGINT) END AS pos FROM (SELECT DISTINCT n FROM e), range(18) t(i))
    SELECT id, date FROM e SEMI JOIN s USING (pos)"""
)
def timeline_sample(spark, root):
    hub = _hub(spark, root, "person")
    return L.uniform_sample(kg_events(spark, root).where(F.array_contains("entityIds", hub)))


_SAMPLE = f"""e AS (SELECT id, row_number() OVER (ORDER BY date, id) - 1 AS pos, count(*) OVER () AS n FROM {EVENTS} WHERE list_contains(entityIds, {_HUB})),
    p AS (SELECT DISTINCT CASE WHEN n <= 18 THEN i ELSE CAST(floor(i * (n - 1) / 17.0 + 0.5) AS BIGINT) END AS pos FROM (SELECT DISTINCT n FROM e), range(18) t(i)), sample AS (SELECT id FROM e SEMI JOIN p USING (pos))"""


@query(
    f"""{_PRECEDES}, {_SAMPLE}, own AS (SELECT DISTINCT entity_id, event_id FROM {MENTIONS} WHERE event_id IN (SELECT id FROM sample) AND entity_id IS NOT NULL),
    top AS (SELECT o.entity_id, count(*) AS n FROM own o JOIN {ENTITIES} t ON t.id = o.entity_id WHERE o.entity_id <> {_HUB} GROUP BY o.entity_id, t.label ORDER BY n DESC, t.label COLLATE zh, o.entity_id LIMIT 8)
    SELECT entity_id AS source, event_id AS target, 'mention' AS kind FROM own WHERE entity_id IN (SELECT entity_id FROM top) OR entity_id = {_HUB}
    UNION ALL SELECT f, event_id, 'relation' FROM r WHERE k = 1 AND f IN (SELECT id FROM sample) AND event_id IN (SELECT id FROM sample)"""
)
def ego_edges(spark, root):
    events, hub = durable(kg_events(spark, root), "events"), _hub(spark, root, "person")
    ego = G.ego_subgraph(events, kg_labels(spark, root), _relations(spark, root), hub)
    return G.ego_edges(events, ego, hub)


@query(f"{_PRECEDES} SELECT f AS \"from\", event_id AS \"to\" FROM r WHERE k = 1 AND (SELECT min(event_id) FROM r WHERE k = 1) IN (f, event_id)")
def neighbor_relations(spark, root):
    relations = durable(_relations(spark, root), "relations")
    node = relations.agg(F.min("to")).first()[0]
    return G.neighbor_relations(relations, node or "").select("from", "to")


_REACHED = 64  # the paths between these ends have far fewer steps


@query(
    _PRECEDES.replace("WITH m AS", "WITH RECURSIVE m AS", 1)
    + f""", l AS (SELECT 'relation-' || left(sha1(f || ':' || event_id || ':precedes'), 12) AS id, f AS a, event_id AS b FROM r WHERE k = 1), g AS MATERIALIZED (SELECT id, a, b FROM l UNION ALL SELECT id, b, a FROM l),
    ends AS (SELECT min(a) AS first, max(b) AS last FROM l),
    walk AS (SELECT first AS node, 0 AS depth FROM ends UNION SELECT g.b, w.depth + 1 FROM walk w JOIN g ON g.a = w.node WHERE w.depth < {_REACHED}),
    near AS MATERIALIZED (SELECT node, min(depth) AS depth FROM walk GROUP BY node),
    into_ AS MATERIALIZED (SELECT b AS node, depth, arg_min(id, (id, a)) AS via, arg_min(a, (id, a)) AS parent FROM (SELECT g.b, g.id, g.a, y.depth FROM g JOIN near x ON x.node = g.a JOIN near y ON y.node = g.b AND y.depth = x.depth + 1) GROUP BY b, depth),
    back AS (SELECT i.* FROM into_ i JOIN ends ON i.node = ends.last UNION ALL SELECT i.* FROM back JOIN into_ i ON i.node = back.parent)
    SELECT CAST(depth AS INTEGER) AS step, via AS id FROM back"""
)
def event_path(spark, root):
    relations = durable(_relations(spark, root), "relations")
    ends = relations.agg(F.min("from"), F.max("to")).first()
    return G.event_path(relations, ends[0] or "", ends[1] or "")


@query(
    f"""WITH t AS (SELECT id, title, date, sourceIds[1] AS source_id FROM {EVENTS} WHERE list_contains(entityIds, {_HUB}) ORDER BY date DESC, title COLLATE zh, id LIMIT 80)
    SELECT t.id, t.title, t.date, t.source_id, s.title AS source_title, s.repositoryPath, t.id = (SELECT id FROM t ORDER BY date DESC, title COLLATE zh, id LIMIT 1) AS selected
    FROM t LEFT JOIN {SOURCES} s ON s.id = t.source_id"""
)
def entity_timeline(spark, root):
    return G.entity_detail(kg_events(spark, root), kg_sources(spark, root), _hub(spark, root, "person"))


# --- rules: a small set of our own

RULES = X.Rules(
    version="demo",
    topics=(
        {"id": "topic-health", "label": "公共卫生", "keywords": ["疫苗接种", "核酸筛查", "发热门诊", "耐药菌"]},
        {"id": "topic-law", "label": "司法", "keywords": ["庭审直播", "刑期认定", "再审申请"]},
        {"id": "topic-energy", "label": "能源", "keywords": ["风电场", "光伏组件", "碳配额"]},
    ),
    event_classes=(
        {"id": "disaster_accident", "keywords": ["山体滑坡", "森林火灾", "余震", "转移群众"]},
        {"id": "public_health", "keywords": ["疫苗接种", "扩大接种范围", "追踪密接者"]},
        {"id": "law_justice", "keywords": ["一审宣判", "当庭认罪", "庭审直播"]},
    ),
    topic_classes={"topic-energy": "environment_energy", "topic-law": "law_justice"},
    places=({"label": "双林县", "aliases": ["双林"]}, {"label": "云川市", "aliases": ["云川"]}, {"label": "松口", "aliases": []}),
    organization_suffixes=("股份有限公司", "研究院", "基金会", "管理委员会"),
    facility_suffixes=("高速公路", "大桥", "水库"),
    person_roles=("记者", "局长"),
)


def _sql_score(words: list[str]) -> str:
    return " + ".join(f"(length(x) - length(replace(x, {sql_text(w)}, '')))" for w in words)


_SCORES = ", ".join(f"{_sql_score(c['keywords'])} AS s{i}" for i, c in enumerate(RULES.event_classes))
_HAS = lambda i: "(" + " OR ".join(f"contains(x, {sql_text(w)})" for w in RULES.topics[i]["keywords"]) + ")"


@query(
    f"""SELECT id, CASE WHEN greatest(s0, s1, s2) = 0 THEN CASE WHEN {_HAS(1)} THEN 'law_justice' WHEN {_HAS(2)} THEN 'environment_energy' ELSE 'other' END
    WHEN s0 >= greatest(s1, s2) THEN 'disaster_accident' WHEN s1 >= s2 THEN 'public_health' ELSE 'law_justice' END AS class
    FROM (SELECT *, {_SCORES} FROM (SELECT id, {sql_squeeze("coalesce(title, '') || chr(10) || coalesce(summary, '')")} AS x FROM {EVENTS}))"""
)
def classify_events(spark, root):
    e = kg_events(spark, root).select("id", F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit(""))).alias("headline"), F.lit("").alias("text"))
    return X.classify_events(e, RULES).select("id", "class")


def _candidates(spark, root):
    e = kg_events(spark, root)
    head = F.concat_ws("\n", "title", "summary")
    return X.extract_candidates(e.select(F.col("id").alias("event_id"), F.col("newsId").alias("news_id"), head.alias("headline"), head.alias("text")), RULES)


_TOPIC_ROWS = " UNION ALL ".join(f"SELECT id, {sql_text(t['label'])} AS label FROM h WHERE {_HAS(i)}" for i, t in enumerate(RULES.topics))
_HEADS = f"(SELECT id, {sql_squeeze("concat_ws(chr(10), title, summary)")} AS x FROM {EVENTS})"


@query(f"WITH h AS (SELECT * FROM {_HEADS}) SELECT label, CAST(count(*) AS BIGINT) AS n FROM ({_TOPIC_ROWS}) GROUP BY 1")
def topic_candidates(spark, root):
    c = _candidates(spark, root).where("type = 'topic'")
    return c.groupBy("label").agg(F.countDistinct("event_id").alias("n"))


@query(
    f"""SELECT CASE WHEN p IN ('双林县', '双林') THEN '双林县' WHEN p IN ('云川市', '云川') THEN '云川市' ELSE p END AS label, CAST(count(DISTINCT id) AS BIGINT) AS n
    FROM (SELECT id, unnest(regexp_extract_all(x, '双林县|云川市|双林|云川|松口')) AS p FROM {_HEADS}) GROUP BY 1"""
)
def place_candidates(spark, root):
    c = _candidates(spark, root).where("type = 'place'")
    return c.groupBy("label").agg(F.countDistinct("event_id").alias("n"))


@query()
def supported_entities(spark, root):
    stats = G.candidate_stats(durable(_candidates(spark, root), "candidates"))
    kept = stats.where(G.should_keep(F.col("type"), F.col("method"), F.col("eventCount"), F.col("prominent")))
    return G.materialize_entities(kept).drop("key")


@query(
    f"""WITH v AS (SELECT DISTINCT id AS entity_id, label AS value FROM entities WHERE id LIKE 'entity-person-%' AND label <> ''),
    t AS (SELECT id AS event_id, concat_ws(chr(10), title, summary) AS x FROM {EVENTS}) SELECT DISTINCT t.event_id, v.entity_id FROM t JOIN v ON contains(t.x, v.value)"""
)
def rematch_persons(spark, root):
    names = table(spark, root, "entities").where("id LIKE 'entity-person-%'").select(F.col("id").alias("entity_id"), F.col("label").alias("value"))
    texts = kg_events(spark, root).select(F.col("id").alias("event_id"), F.concat_ws("\n", "title", "summary").alias("text"))
    return G.rematch(texts, names)


@query()
def pipeline_events(spark, root):
    return P.build_graph(P.build_news(latest_pages(spark, root)), RULES).events


@query()
def pipeline_relations(spark, root):
    return P.build_graph(P.build_news(latest_pages(spark, root)), RULES).relations


# --- search


def _types(spark):
    return spark.createDataFrame([("public_health", "公共卫生", ""), ("law_justice", "司法", "")], "id string, label string, description string")


def _event_documents(spark, root):
    return Q.event_documents(kg_events(spark, root), kg_entities(spark, root), kg_sources(spark, root), _types(spark), _types(spark))


def _one_to_one() -> tuple[str, str]:
    """Characters of the basic plane that compatibility decomposition takes to one other character, and those."""
    import unicodedata

    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c))) for c in range(0xA0, 0xFFFF) if not 0xD800 <= c < 0xE000]
    pairs = [(a, b) for a, b in pairs if len(b) == 1 and a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def sql_search_form(column: str) -> str:
    """F5 in SQL, but for characters that decompose to several ones without being accented letters."""
    plain = f"lower(translate(strip_accents(coalesce({column}, '')), {', '.join(map(sql_text, _one_to_one()))}))"
    return f"regexp_replace({plain}, '[\\p{{M}}\\p{{P}}\\p{{S}}\\p{{Z}}\\s\x1c-\x1f\x85\ufeff]', '', 'g')"


_TYPE_TEXTS = "(VALUES ('public_health', 'public_health 公共卫生 '), ('law_justice', 'law_justice 司法 '))"
_EVENT_DOCS = f"""e AS (SELECT * FROM {EVENTS}), kinds(id, text) AS (SELECT * FROM {_TYPE_TEXTS}),
    m AS (SELECT id AS event_id, x AS entity_id, min(pos) AS pos FROM (SELECT id, unnest(entityIds) AS x, generate_subscripts(entityIds, 1) AS pos FROM e) GROUP BY ALL),
    n AS (SELECT event_id, string_agg(concat_ws(' ', t.label, array_to_string(t.aliases, ' '), t.description), ' ' ORDER BY pos) AS entities, string_agg(DISTINCT concat_ws(' ', t.type, k.text), ' ') AS kinds
        FROM m JOIN {{entities}} t ON t.id = m.entity_id LEFT JOIN kinds k ON k.id = t.type GROUP BY 1),
    docs AS (SELECT e.id, e.title AS title_, e.date AS date_, {sql_search_form('e.title')} AS title, {sql_search_form('e.summary')} AS summary, {sql_search_form('e.significance')} AS significance, {sql_search_form('n.entities')} AS entities,
        {sql_search_form("concat_ws(' ', e.type, k.text, n.kinds)")} AS types, {sql_search_form("concat_ws(' ', s.title, s.kind, s.repositoryPath)")} AS source, {sql_search_form('e.date')} AS date
        FROM e LEFT JOIN n ON n.event_id = e.id LEFT JOIN kinds k ON k.id = e.type LEFT JOIN {SOURCES} s ON s.id = e.sourceIds[1])"""


@query(
    "WITH " + _EVENT_DOCS.replace("{entities}", "(SELECT id, r[1] AS label, regexp_extract(id, '^entity-([a-z]+)-', 1) AS type, r[2] AS aliases, r[3] AS description FROM (SELECT id, min((label, aliases, description)) AS r FROM entities GROUP BY id))")
    + """, hit AS (SELECT *, concat(title, summary, significance, entities, types, source, date) AS text FROM docs), q AS (SELECT '疫苗接种扩大接种范围' AS phrase)
    SELECT id, title_ AS title, date_ AS date, CAST(CASE WHEN title = phrase THEN 100 WHEN contains(title, phrase) THEN 40 ELSE 0 END + CASE WHEN contains(summary, phrase) THEN 16 ELSE 0 END
      + CASE WHEN contains(entities, phrase) THEN 12 ELSE 0 END + CASE WHEN contains(types, phrase) THEN 6 ELSE 0 END + CASE WHEN contains(source, phrase) THEN 3 ELSE 0 END AS INTEGER) AS rank
    FROM hit, q WHERE contains(text, '疫苗接种') AND contains(text, '扩大接种范围') ORDER BY rank DESC, date_ DESC, title_ COLLATE zh, id LIMIT 60"""
)
def keyword_events(spark, root):
    return Q.search_events(_event_documents(spark, root), "疫苗接种 “扩大接种范围”").select("id", "title", "date", "rank")


@query(
    f"""WITH t AS (SELECT id, r[1] AS label_, r[2] AS aliases, r[3] AS description, r[4].eventCount AS n FROM (SELECT id, min((label, aliases, description, extraction)) AS r FROM entities GROUP BY id)),
    d AS (SELECT *, {sql_search_form('label_')} AS label, {sql_search_form("array_to_string(aliases, ' ')")} AS others, {sql_search_form('description')} AS about, {sql_search_form("regexp_extract(id, '^entity-([a-z]+)-', 1)")} AS type FROM t)
    SELECT id, label_ AS label, CAST(coalesce(n, 0) AS BIGINT) AS eventCount, CAST(CASE WHEN label = '研究院' THEN 100 WHEN contains(label, '研究院') THEN 40 ELSE 0 END + CASE WHEN contains(others, '研究院') THEN 24 ELSE 0 END
      + CASE WHEN contains(type, '研究院') THEN 8 ELSE 0 END + CASE WHEN contains(about, '研究院') THEN 3 ELSE 0 END AS INTEGER) AS rank
    FROM d WHERE contains(concat(label, others, about, type), '研究院') ORDER BY rank DESC, eventCount DESC, label_ COLLATE zh, id LIMIT 12"""
)
def keyword_entities(spark, root):
    return Q.search_entities(Q.entity_documents(kg_entities(spark, root)), "研究院").select("id", "label", "eventCount", "rank")


@query(f"SELECT id, date FROM {EVENTS} WHERE type = 'public_health' AND list_contains(entityIds, {_HUB.replace('person', 'topic')}) AND left(date, 4) BETWEEN '2020' AND '2023'")
def facet_filter(spark, root):
    facets = Q.Facets("public_health", (_hub(spark, root, "topic"),), "2020年", "2023")
    return Q.facet_filter(kg_events(spark, root), facets, None).select("id", "date")


@query("""SELECT id FROM (SELECT id, min((label, aliases, description)) AS r FROM entities GROUP BY id) WHERE regexp_extract(id, '^entity-([a-z]+)-', 1) = 'organization'
    AND contains(lower(concat_ws(' ', r[1], array_to_string(r[2], ' '), r[3])), 'institute')""")
def picker(spark, root):
    # all that fits, without the picker's limit
    return Q.pick_entities(kg_entities(spark, root), "organization", " Institute ", None, None).select("id")


# --- incremental


def _manifests(spark, root):
    s = table(spark, root, "source_snapshots").select(
        F.col("snapshotNo").alias("no"), snapshots.canonical_path(F.col("repositoryPath")).alias("path"), snapshots.canonical_hash(F.col("contentHash")).alias("hash")
    )
    ends = s.agg(F.min("no").alias("lo"), F.max("no").alias("hi"))
    rows = s.join(F.broadcast(ends))
    return rows.where("no = lo").select("path", "hash"), rows.where("no = hi").select("path", "hash")


_SNAP = r"""s AS (SELECT snapshotNo AS no, regexp_replace(regexp_replace(regexp_replace(trim(repositoryPath), '[\\/]+', '/', 'g'), '^(/|\./)+', ''), '/(\./)+', '/', 'g') AS path,
    nullif(lower(regexp_replace(trim(contentHash), '^[sS][hH][aA]-?256[:=]\s*', '')), '') AS hash FROM source_snapshots),
    a AS (SELECT path, min(hash) AS hash FROM s WHERE no = (SELECT min(no) FROM s) GROUP BY 1), c AS (SELECT path, min(hash) AS hash FROM s WHERE no = (SELECT max(no) FROM s) GROUP BY 1),
    gone AS (SELECT * FROM a WHERE path NOT IN (SELECT path FROM c)), fresh AS (SELECT * FROM c WHERE path NOT IN (SELECT path FROM a)),
    x AS (SELECT 'modified' AS bucket, c.path FROM a JOIN c USING (path) WHERE a.hash IS DISTINCT FROM c.hash UNION ALL SELECT 'deleted', path FROM gone
      UNION ALL SELECT CASE WHEN hash IN (SELECT hash FROM gone WHERE hash IS NOT NULL) THEN 'possible_rename' WHEN hash IN (SELECT hash FROM a WHERE hash IS NOT NULL) THEN 'duplicate' ELSE 'added' END, path FROM fresh)"""


@query(f"WITH {_SNAP} SELECT bucket, path FROM x")
def archive_changes(spark, root):
    return I.archive_changes(*_manifests(spark, root)).select("bucket", "path")


@query(f"WITH {_SNAP} SELECT bucket, CAST(count(*) AS BIGINT) AS n FROM x GROUP BY 1")
def upstream_report(spark, root):
    return R.upstream_report(I.archive_changes(*_manifests(spark, root))).select("bucket", "n")


_OLD = f"(SELECT * FROM {SOURCES} WHERE publishedAt < '2022-01-01')"


@query(f"SELECT e.id FROM {EVENTS} e WHERE e.sourceIds[1] IN (SELECT id FROM {SOURCES} WHERE repositoryPath IS NOT NULL)")
def append_events(spark, root):
    events, sources, entities = durable(kg_events(spark, root), "events"), kg_sources(spark, root), kg_entities(spark, root)
    relations = durable(_relations(spark, root), "relations")
    old = sources.where("publishedAt < '2022-01-01'")
    known = events.join(old.select(F.col("id").alias("s")), F.get("sourceIds", F.lit(0)) == F.col("s"), "left_semi")
    existing = I.Graph(entities, known, relations.limit(0), old)
    merged, _ = I.append_graph(existing, I.Graph(entities, events, relations, sources), sources.select(F.col("repositoryPath").alias("path")))
    return merged.events.select("id")


# --- constraints and reports


@query("SELECT id, CAST(n - 1 AS BIGINT) AS again FROM (SELECT id, count(*) AS n FROM kg_events WHERE id IS NOT NULL GROUP BY 1) WHERE n > 1")
def duplicate_ids(spark, root):
    issues = V.duplicate_ids(table(spark, root, "kg_events"), "events")
    return issues.groupBy(F.regexp_replace("message", "^duplicate ID ", "").alias("id")).agg(F.count(F.lit(1)).alias("again"))


@query("SELECT id, path AS ref FROM raw_pages WHERE id NOT IN (SELECT id FROM sources WHERE id IS NOT NULL)")
def dangling_pages(spark, root):
    pages = table(spark, root, "raw_pages")
    issues = V.dangling(pages, F.col("id"), table(spark, root, "sources"), "pages", "id", "missing source ")
    found = issues.select(F.regexp_replace("message", "^missing source ", "").alias("id"))
    return pages.join(found, "id", "left_semi").select("id", F.col("path").alias("ref"))


@query(f"SELECT id FROM (SELECT id, publishedAt AS d, lag(publishedAt) OVER (ORDER BY episode.number, repositoryPath) AS b FROM {SOURCES} WHERE episode IS NOT NULL) WHERE b > d")
def falling_dates(spark, root):
    rows = kg_sources(spark, root).where("episode IS NOT NULL")
    issues = V.falling(rows, [F.col("episode.series")], [F.col("episode.number"), F.col("repositoryPath")], "publishedAt", "pages", "publishedAt")
    return issues.select(F.regexp_extract("path", r"^pages\.(.*)\.publishedAt\z", 1).alias("id"))


@query(
    f"""WITH n AS (SELECT DISTINCT id, title, date, summary FROM news), e AS (SELECT newsId, left(title, 20) AS title, date, summary FROM {EVENTS} WHERE type <> 'other'),
    b AS (SELECT coalesce(n.id, e.newsId) AS news_id, n.id AS i, e.newsId AS j, n.title AS t, e.title AS u, n.date AS d, e.date AS f, n.summary AS s, e.summary AS r FROM n FULL JOIN e ON n.id = e.newsId)
    SELECT news_id, 'missing' AS field FROM b WHERE i IS NULL OR j IS NULL UNION ALL SELECT news_id, 'title' FROM b WHERE i IS NOT NULL AND j IS NOT NULL AND t IS DISTINCT FROM u
    UNION ALL SELECT news_id, 'date' FROM b WHERE i IS NOT NULL AND j IS NOT NULL AND d IS DISTINCT FROM f UNION ALL SELECT news_id, 'summary' FROM b WHERE i IS NOT NULL AND j IS NOT NULL AND s IS DISTINCT FROM r"""
)
def projection_diff(spark, root):
    news = table(spark, root, "news").select("id", "title", "date", "summary").distinct()
    events = kg_events(spark, root).where("type <> 'other'").withColumn("title", F.left("title", F.lit(20)))
    return V.projection_diff(news, events, {"title": "title", "date": "date", "summary": "summary"}).select("news_id", "field")


def _sql_issue(rows: str, condition: str, path: str, message: str) -> str:
    return f"SELECT 'error' AS level, {path} AS path, {message} AS message FROM {rows} WHERE {condition}"


_NEWS_FIELDS = "id, title, date, datePrecision, summary, pageId, fragment"
_ISSUES = [
    ("p", "coalesce(id, '') = ''", "'pages.id'", "'missing ID'"), ("n", "coalesce(id, '') = ''", "'news.id'", "'missing ID'"),
    *[("p", f"NOT coalesce(regexp_full_match({c}, '\\d{{4}}-\\d{{2}}-\\d{{2}}'), false)", f"'pages.' || id || '.{c}'", "'invalid date'") for c in ("publishedAt", "dateProvenance.observedAt")],
    ("p", f"NOT coalesce(dateProvenance.source IN {V.DATE_SOURCES}, false)", "'pages.' || id || '.dateProvenance.source'", "'unknown date source'"),
    ("p", f"NOT coalesce(dateProvenance.resolution IN {V.RESOLUTIONS}, false)", "'pages.' || id || '.dateProvenance.resolution'", "'unknown date resolution'"),
    ("p", "dateProvenance.resolution = 'observed' AND publishedAt <> dateProvenance.observedAt", "'pages.' || id || '.publishedAt'", "'observed date differs from publishedAt'"),
    ("p", "episode IS NOT NULL AND NOT coalesce(length(episode.series) > 0, false)", "'pages.' || id || '.episode.series'", "'missing series'"),
    ("p", "episode IS NOT NULL AND NOT coalesce(episode.number > 0, false)", "'pages.' || id || '.episode.number'", "'episode number must be positive'"),
    ("(SELECT episode.number AS number FROM p WHERE episode IS NOT NULL GROUP BY episode.series, episode.number HAVING count(*) > 1)", "number IS NOT NULL", "'pages.episode.number'", "'duplicate episode ' || number"),
    ("(SELECT id, publishedAt, lag(publishedAt) OVER (PARTITION BY episode.series ORDER BY episode.number, repositoryPath) AS b FROM p WHERE episode IS NOT NULL)", "b > publishedAt", "'pages.' || id || '.publishedAt'", "publishedAt || ' comes after ' || b"),
    ("n", "pageId IS NOT NULL AND pageId NOT IN (SELECT id FROM p)", "'news.' || id || '.pageId'", "'missing page ' || pageId"),
    ("n", "trim(coalesce(title, ''), ' ') = ''", "'news.' || id || '.title'", "'empty title'"),
    ("n", "NOT coalesce(regexp_full_match(date, '\\d{4}-\\d{2}-\\d{2}'), false)", "'news.' || id || '.date'", "'invalid date'"),
    ("n", f"NOT coalesce(datePrecision IN {V.PRECISIONS}, false)", "'news.' || id || '.datePrecision'", "'unknown date precision'"),
    ("(SELECT n.id, n.date, p.publishedAt AS d FROM n JOIN p ON p.id = n.pageId WHERE p.episode IS NOT NULL)", "date <> d", "'news.' || id || '.date'", "'episode news date differs from its page'"),
    ("n", "NOT coalesce(fragment.startLine >= 1 AND fragment.endLine >= fragment.startLine, false)", "'news.' || id || '.fragment'", "'invalid line range'"),
    ("n", "NOT coalesce(fragment.startColumn IS NULL OR (fragment.startColumn >= 1 AND fragment.endColumn >= fragment.startColumn), false)", "'news.' || id || '.fragment'", "'invalid column range'"),
    ("n", "NOT coalesce(regexp_full_match(fragment.contentHash, '[0-9a-f]{64}'), false)", "'news.' || id || '.fragment.contentHash'", "'invalid sha256'"),
    ("(SELECT min(id) AS id FROM n GROUP BY pageId, fragment.sourceField, fragment.startLine, fragment.endLine, fragment.startColumn, fragment.endColumn HAVING count(*) > 1)", "true", "'news.' || id || '.fragment'", "'duplicate fragment'"),
]


@query(
    f"WITH p AS (SELECT * FROM {SOURCES}), n AS (SELECT id, min(({_NEWS_FIELDS})) AS r FROM news GROUP BY id), ".replace("n AS (", "n0 AS (")
    + f"n AS (SELECT id, {', '.join(f'r[{i}] AS {c}' for i, c in enumerate(_NEWS_FIELDS.split(', '), 1) if c != 'id')} FROM n0) "
    + " UNION ALL ".join(_sql_issue(*i) for i in _ISSUES)
)
def validate_news(spark, root):
    news = table(spark, root, "news").groupBy("id").agg(F.min(F.struct(*_NEWS_FIELDS.split(", "))).alias("r")).select("r.*")
    return V.validate_news(kg_sources(spark, root), news)


_TYPES = ("public_health", "law_justice", "other", "never_used")


@query(f"SELECT t.id, CAST(count(e.id) AS BIGINT) AS n FROM (VALUES {', '.join(f'({sql_text(t)})' for t in _TYPES)}) t(id) LEFT JOIN {EVENTS} e ON e.type = t.id GROUP BY 1")
def type_counts(spark, root):
    types = spark.createDataFrame([(t,) for t in _TYPES], "id string")
    return R.type_counts(kg_events(spark, root), types)


def _sql_metric(name: str, condition: str) -> str:
    return f"SELECT '{name}' AS metric, CAST(count(*) FILTER ({condition}) AS BIGINT) AS covered, CAST(count(*) AS BIGINT) AS total, round(100.0 * count(*) FILTER ({condition}) / count(*), 2) AS percent FROM {EVENTS}"


@query(
    " UNION ALL ".join(
        [
            _sql_metric("semanticEntity", "len(entityIds) > 0"), _sql_metric("specificEventType", "type IS DISTINCT FROM 'other'"),
            _sql_metric("sourceTraceability", "len(sourceIds) = 1 AND sourceIds[1] IN (SELECT id FROM sources WHERE id IS NOT NULL)"),
            _sql_metric("searchability", "trim(coalesce(title, '')) <> '' OR trim(coalesce(summary, '')) <> '' OR len(entityIds) > 0"),
        ]
    )
)
def required_coverage(spark, root):
    return R.required_coverage(kg_events(spark, root), kg_sources(spark, root))


_FACETS = (("subject", "person"), ("subject", "organization"), ("place", "place"), ("topic", "topic"), ("named_object", "facility"), ("named_object", "policy"), ("named_object", "document"), ("empty", "none"))


@query(
    f"""WITH f AS (SELECT * FROM (VALUES {', '.join(f"('{a}', '{b}')" for a, b in _FACETS)}) f(facet, type)),
    h AS (SELECT f.facet, count(DISTINCT m.event_id) AS n FROM {MENTIONS} m JOIN {ENTITIES} t ON t.id = m.entity_id JOIN f ON f.type = t.type GROUP BY 1)
    SELECT d.facet, CAST(coalesce(h.n, 0) AS BIGINT) AS news, round(100.0 * coalesce(h.n, 0) / (SELECT count(*) FROM {EVENTS}), 2) AS percent FROM (SELECT DISTINCT facet FROM f) d LEFT JOIN h USING (facet)"""
)
def facet_presence(spark, root):
    events = kg_events(spark, root)
    return R.facet_presence(events, G.mention_rows(events), kg_labels(spark, root), spark.createDataFrame(list(_FACETS), "facet string, type string"))


@query(f"SELECT round(sum(coalesce(len(entityIds), 0)) / greatest(count(*), 1), 2) AS mean FROM {EVENTS}")
def mean_entities(spark, root):
    return R.mean_entities(kg_events(spark, root))


@query(f"SELECT segmentation.strategy AS strategy, CAST(count(*) AS BIGINT) AS n FROM {SOURCES} GROUP BY 1")
def strategies(spark, root):
    return R.segmentation_report(kg_sources(spark, root))["by_strategy"]


@query(
    f"""SELECT CAST(count(*) AS BIGINT) AS pages, CAST(sum(segmentation.newsCount) AS BIGINT) AS news, CAST(count(*) FILTER (segmentation.newsCount > 1) AS BIGINT) AS multiNewsPages,
    CAST(count(*) FILTER (segmentation.needsReview) AS BIGINT) AS reviewPages, CAST(count(*) FILTER (dateProvenance.resolution <> 'observed') AS BIGINT) AS adjustedPages FROM {SOURCES}"""
)
def segmentation_totals(spark, root):
    return R.segmentation_report(kg_sources(spark, root))["totals"]


@query(f"SELECT id, newsId, title, sourceIds[1] AS pageId FROM {EVENTS} WHERE type = 'other' ORDER BY id LIMIT 100")
def review_sample(spark, root):
    return R.review_sample(kg_events(spark, root))


# --- orders, limits and small operators


@query(f"SELECT id FROM {EVENTS} WHERE type = 'public_health' ORDER BY date DESC, title COLLATE zh, id LIMIT 60")
def facet_newest(spark, root):
    return Q.facet_filter(kg_events(spark, root), Q.Facets("public_health")).select("id")


_ENTITY_ROWS = "(SELECT id, r[1] AS label, regexp_extract(id, '^entity-([a-z]+)-', 1) AS type, r[2] AS aliases, r[3] AS description, r[4] AS extraction FROM (SELECT id, min((label, regexp_extract(id, '^entity-([a-z]+)-', 1), aliases, description, extraction)) AS r0, min((label, aliases, description, extraction)) AS r FROM entities GROUP BY id))"


@query(f"SELECT id, label FROM {_ENTITY_ROWS} ORDER BY coalesce(extraction.eventCount, 0) DESC, label COLLATE zh, id LIMIT 200")
def entities_by_count(spark, root):
    return Q.ranked_entities(kg_entities(spark, root)).select("id", "label").limit(200)


@query(
    f"""SELECT id FROM {_ENTITY_ROWS} WHERE type = 'organization' AND contains(lower(concat_ws(' ', label, array_to_string(aliases, ' '), description)), 'institute')
    ORDER BY coalesce(extraction.eventCount, 0) DESC, label COLLATE zh, id LIMIT 24"""
)
def picker_best(spark, root):
    return Q.pick_entities(kg_entities(spark, root), "organization", "institute").select("id")


@query(f"SELECT id, date FROM {EVENTS} WHERE list_contains(entityIds, {_HUB}) ORDER BY date, id")
def hub_events(spark, root):
    return G.entity_events(kg_events(spark, root), _hub(spark, root, "person")).select("id", "date")


@query("SELECT DISTINCT id, regexp_extract(id, '^entity-([a-z]+)-', 1) || ':' || lower(" + sql_replace("coalesce(label, '')", rf"[{T.WS_CHARS}《》“”\"'（）()_\-]") + ") AS key FROM entities WHERE id IS NOT NULL")
def entity_keys(spark, root):
    e = table(spark, root, "entities").where("id IS NOT NULL")
    return e.select("id", T.entity_key(F.regexp_extract("id", "^entity-([a-z]+)-", 1), F.col("label")).alias("key")).distinct()


@query(
    f"""WITH p AS (SELECT id, publishedAt AS d FROM {SOURCES} WHERE episode IS NOT NULL), n AS (SELECT DISTINCT id, pageId, date, datePrecision FROM news)
    SELECT n.id, coalesce(p.d, n.date) AS date, CASE WHEN p.d IS NULL THEN n.datePrecision WHEN p.d LIKE '%-01-01' THEN 'year' ELSE 'day' END AS datePrecision FROM n LEFT JOIN p ON p.id = n.pageId"""
)
def pushed_dates(spark, root):
    news = table(spark, root, "news").select("id", "pageId", "date", "datePrecision").distinct()
    return L.push_dates(news, kg_sources(spark, root)).select("id", "date", "datePrecision")


_LABELS = (("public_health", "公共卫生"), ("law_justice", "司法"))


@query(f"SELECT e.id, coalesce(l.label, e.type) AS typeLabel FROM {EVENTS} e LEFT JOIN (VALUES {', '.join(f'({sql_text(a)}, {sql_text(b)})' for a, b in _LABELS)}) l(id, label) ON l.id = e.type")
def type_labels(spark, root):
    return G.with_labels(kg_events(spark, root), spark.createDataFrame(list(_LABELS), "id string, label string")).select("id", "typeLabel")


@query(f"{_PRECEDES} SELECT t.id, CAST(count(r.event_id) AS BIGINT) AS n FROM (VALUES ('precedes'), ('causes')) t(id) LEFT JOIN (SELECT event_id FROM r WHERE k = 1) r ON t.id = 'precedes' GROUP BY 1")
def relation_type_counts(spark, root):
    return R.relation_counts(spark.createDataFrame([("precedes",), ("causes",)], "id string"), _relations(spark, root))
