"""Session helpers: sessions for local runs, table readers, and durable cuts of lineage."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, app: str = "newsloom") -> SparkSession:
    """A single-JVM session for tests and the bench; a cluster brings its own."""
    return ship(
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the Python workers, once a context; executors then need no install."""
    context = spark.sparkContext
    if getattr(context, "_newsloom_shipped", False):
        return spark
    home = os.path.dirname(os.path.abspath(__file__))
    fd, path = tempfile.mkstemp(prefix="newsloom-", suffix=".zip")
    with os.fdopen(fd, "wb") as out, zipfile.ZipFile(out, "w") as z:
        for folder, _, files in os.walk(home):
            for name in sorted(files):
                if name.endswith((".py", ".json")):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("newsloom", os.path.relpath(full, home)))
    context.addPyFile(path)
    atexit.register(lambda: os.path.exists(path) and os.remove(path))  # executors may fetch it until then
    context._newsloom_shipped = True
    return spark


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One table of a data directory, as `root/name.parquet` (a file or a folder of files)."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A table scan in at least as many parts as there are cores. Small tables of one row group come in one
    part; only these are dealt out again, large ones stay as they are read."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan._jdf.queryExecution().toRdd().getNumPartitions() >= cores else scan.repartition(cores)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: `spark.checkpoint.dir` if the cluster names one,
    else, only then, a temporary folder of this machine (local mode and tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return re.sub(r"/[0-9a-f-]{36}/?$", "", current.get())
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="newsloom-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def scratch(spark: SparkSession, what: str, folder: str | None = None) -> str:
    """A new path under the shared folder, or under `folder`; nothing is created yet."""
    return f"{folder or shared_dir(spark) + '/newsloom'}/{what}-{uuid.uuid4().hex[:12]}"


def durable(df: DataFrame, what: str) -> DataFrame:
    """Writes `df` to the shared folder and reads it again: cuts the lineage, survives lost
    executors, and lets several consumers share one computation. The table goes with the application."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.parquet(path)
    files, place = _files(spark, path)
    files.deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def _files(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path for it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a path of the shared folder, whatever file system it lies on."""
    files, place = _files(spark, path)
    files.delete(place, True)


def list_paths(spark: SparkSession, folder: str) -> list[str]:
    """The files and folders in a folder, in order of their names; none if it isn't there."""
    files, place = _files(spark, folder)
    return sorted(x.getPath().toString() for x in files.listStatus(place)) if files.exists(place) else []


def write_text(spark: SparkSession, path: str, texts: str | Iterable[str]) -> None:
    """One file, of a text or of pieces that come one by one; there as a whole or not at all."""
    files, place = _files(spark, path)
    part = place.suffix(".part")
    out = files.create(part, True)
    for text in [texts] if isinstance(texts, str) else texts:
        out.write(bytearray(text.encode()))
    out.close()
    if files.exists(place):
        files.delete(place, False)
    files.rename(part, place)
