"""What changed between consecutive full snapshots of a table.

EXCEPT ALL in both directions removes what two snapshots share, with multiplicity and without
sorting either; only the residues are joined in full by key, and a pair of residues with one key is a
change. All consecutive pairs go through one plan: a snapshot is the newer side under its own rank and
the older side under the next rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.session import durable


def canonical_path(path: Column) -> Column:
    """A path as relative, with single forward slashes and without `.` steps or outer blanks;
    null stays null."""
    p = F.regexp_replace(F.trim(path), r"[\\/]+", "/")
    p = F.regexp_replace(p, r"^(?:/|\./)+", "")
    return F.regexp_replace(p, r"(?:(?<=/)\./)+", "")


def canonical_hash(digest: Column) -> Column:
    """A content hash in lower case without an algorithm prefix or outer blanks; null and empty
    are null."""
    h = F.lower(F.regexp_replace(F.trim(digest), r"(?i)^sha-?256[:=]\s*", ""))
    return F.nullif(h, F.lit(""))


def changes(
    snapshots: DataFrame,
    number: str = "snapshotNo",
    key: Column | None = None,
    value: Column | None = None,
    key_name: str = "repositoryPath",
) -> DataFrame:
    """Rows (number, key_name, change) with change added, removed or changed.

    `number` orders the snapshots and may have gaps: a snapshot is compared with the one delivered
    before it. Repeated rows of a snapshot count once. A value that becomes or stops being null is a
    change. Rows with a null key can't be followed and are left out. If a key has several values in
    one snapshot, it is unchanged only if the sets of values are equal. The first snapshot, and an
    empty table, give no rows.
    """
    key = F.col(key_name) if key is None else key
    value = F.col("contentHash") if value is None else value
    every = snapshots.select(F.col(number).alias("no"), key.alias("k"), value.alias("v")).where(F.col("no").isNotNull())
    rows = every.where(F.col("k").isNotNull()).distinct()
    # a row for each snapshot, not for each record: ranked in one task; Spark broadcasts it if it is small
    order = every.select("no").distinct().withColumn("next_no", F.lead("no").over(Window.orderBy("no")))
    first = every.agg(F.min("no").alias("first_no"))
    new = rows.join(F.broadcast(first), F.col("no") > F.col("first_no")).select("no", "k", "v")
    old = rows.join(order.where("next_no IS NOT NULL"), "no").select(F.col("next_no").alias("no"), "k", "v")
    # a key with several values leaves several residues; they meet as one row a side
    gone = old.exceptAll(new).groupBy("no", "k").agg(F.lit(True).alias("gone"))
    come = new.exceptAll(old).groupBy("no", "k").agg(F.lit(True).alias("come"))
    # both residues are worked out once and are small beside the snapshots
    found = durable(gone.join(come, ["no", "k"], "full"), "residues")
    # a residue of one side alone may belong to a key that the other side has with another set of values
    lone = found.where("gone IS NULL OR come IS NULL").select("no", "k")
    both = new.select("no", "k").join(lone, ["no", "k"], "left_semi").join(old.select("no", "k"), ["no", "k"], "left_semi")
    found = found.join(both.distinct().withColumn("both", F.lit(True)), ["no", "k"], "left")
    label = (
        F.when(F.col("both"), F.lit("changed")).when(F.col("gone").isNull(), F.lit("added")).when(F.col("come").isNull(), F.lit("removed")).otherwise(F.lit("changed"))
    )
    return found.select(F.col("no").alias(number), F.col("k").alias(key_name), label.alias("change"))
