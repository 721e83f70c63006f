"""The queries p1, p2 and p5 to p9, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import batches, bpe, leaks, lookalike, names, residue, subjects
from newsloom.operators.snapshots import canonical_hash
from newsloom.session import spread, table


def p1_strings(spark: SparkSession, root: str) -> DataFrame:
    """(field, id, raw): every title, label and alias."""
    titles = table(spark, root, "kg_events").select(F.lit("title").alias("field"), "id", F.col("title").alias("raw"))
    entities = table(spark, root, "entities")
    labels = entities.select(F.lit("label").alias("field"), "id", F.col("label").alias("raw"))
    aliases = entities.select(F.lit("aliases").alias("field"), "id", F.explode("aliases").alias("raw"))
    return titles.unionByName(labels).unionByName(aliases)


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return lookalike.look_alike_pairs(p1_strings(spark, root))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    found = batches.repeated_deliveries(
        table(spark, root, "sources"), table(spark, root, "source_batches"), table(spark, root, "raw_pages"), digest=canonical_hash
    )
    return found.select(F.least("id", "earliest").alias("id_a"), F.greatest("id", "earliest").alias("id_b"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return names.variant_pairs(table(spark, root, "entities"))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return subjects.subjects(spread(table(spark, root, "kg_events").select("id", "title", "summary", "ingestedAt")), table(spark, root, "subject_labels"))


def p7_ids(spark: SparkSession, root: str) -> DataFrame:
    return bpe.encode_column(spread(table(spark, root, "documents").select("doc_id", "text")), "text", "ids").select("doc_id", "ids")


def p8_spans(spark: SparkSession, root: str) -> DataFrame:
    return leaks.leaks(spread(table(spark, root, "documents").select("doc_id", "text")), table(spark, root, "eval_items"))


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return p8_spans(spark, root).select("doc_id", "item_id")


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    return residue.residue(spread(table(spark, root, "documents").select("doc_id", "text")))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p5_found": p5_found, "p6_found": p6_found, "p7_ids": p7_ids, "p8_found": p8_found, "p8_spans": p8_spans, "p9_found": p9_found}
P1_SQL = f"""
WITH s AS (SELECT 'title' AS field, id, title AS raw FROM kg_events UNION ALL SELECT 'label', id, label FROM entities UNION ALL SELECT 'aliases', id, unnest(aliases) FROM entities),
k AS (SELECT DISTINCT field, id, raw, {lookalike.look_sql('raw')} AS look FROM s WHERE id IS NOT NULL AND raw IS NOT NULL)
SELECT DISTINCT a.field, a.id AS id_a, b.id AS id_b FROM k a JOIN k b ON a.field = b.field AND a.look = b.look AND a.id < b.id AND a.raw <> b.raw WHERE a.look <> ''"""
ORACLES: dict[str, str] = {"p1_found": P1_SQL}
