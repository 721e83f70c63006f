"""Pages as a stream: new files of an archive become news rows micro-batch by micro-batch, and accepted
manifests grow by `foreachBatch`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.conventions import DEFAULT, Conventions
from newsloom.operators.incremental import archive_changes
from newsloom.operators.segment import news_of, parse_pages

RAW = "path string, raw string"


def read_page_stream(spark: SparkSession, folder: str, fmt: str = "parquet", files_per_trigger: int = 16) -> DataFrame:
    """A stream of (path, raw) rows from files that appear in a folder."""
    return spark.readStream.schema(RAW).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(folder)


def news_stream(pages: DataFrame, conventions: Conventions = DEFAULT) -> DataFrame:
    """News of a stream of pages. Parsing is local to a page, so it needs no state and no watermark; episode
    dates, which need the whole sequence, are repaired where the rows are stored."""
    return news_of(parse_pages(pages, None, conventions), conventions).drop("fragmentText")


def append_batches(pages: DataFrame, store: str, checkpoint: str, conventions: Conventions = DEFAULT, available_now: bool = True):
    """Starts a query that appends the news of new pages to `store`. A page is taken if its path and content are
    new: modified, renamed and duplicated pages go to `store/review` instead. A batch that runs again
    after a failure writes the same folder again."""

    def accept(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        # of several texts of one path in a batch the one with the least hash, so that a batch run again gives the same
        batch = batch.where("path IS NOT NULL").withColumn("hash", F.sha2("raw", 256))
        batch = batch.groupBy("path").agg(F.min(F.struct("hash", "raw")).alias("r")).select("path", "r.hash", "r.raw")
        manifest = _manifest(spark, store, number)
        # pages that this batch doesn't bring are still there
        current = manifest.join(batch.select("path"), "path", "left_anti").unionByName(batch.select("path", "hash"))
        changes = archive_changes(manifest, current)
        added = changes.where("bucket = 'added'").select("path")
        fresh = batch.join(added, "path", "left_semi")
        news_of(parse_pages(fresh.select("path", "raw"), None, conventions), conventions).drop("fragmentText").write.mode("overwrite").parquet(f"{store}/news/batch={number}")
        changes.where("bucket <> 'added'").write.mode("overwrite").parquet(f"{store}/review/batch={number}")
        fresh.select("path", "hash").write.mode("overwrite").parquet(f"{store}/manifest/batch={number}")

    writer = pages.writeStream.foreachBatch(accept).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")).start()


def _manifest(spark: SparkSession, store: str, before: int) -> DataFrame:
    """Accepted paths and hashes of all batches before this one."""
    empty = spark.createDataFrame([], "path string, hash string")
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/manifest")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return empty
    return spark.read.schema("path string, hash string, batch int").parquet(f"{store}/manifest").where(F.col("batch") < before).select("path", "hash")
