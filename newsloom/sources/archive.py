"""Sources and sinks: Markdown folders, manifests, JSON and tables, and the archive's version."""

from __future__ import annotations

import argparse
import json
import os
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.session import write_text

#: Folders of an archive that hold pages.
ROOTS = ("daily", "main", "reference", "business", "commercial", "opinion", "book", "livestream")


def _files(spark: SparkSession, root: str, pattern: str, kind: str) -> DataFrame | None:
    """The files under a folder, dot entries left out; None if the folder isn't there or has no such file."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    return reader.text(root, wholetext=True) if kind == "text" else reader.format("binaryFile").load(root)


def _relative(root: str):
    """A file's path below the root, with percent escapes decoded."""
    plain = F.regexp_replace(F.col("_metadata.file_path"), r"^[a-z]+:/*", "/")
    decoded = F.try_url_decode(F.regexp_replace(plain, r"\+", "%2B"))
    return F.substring(decoded, len(os.path.abspath(root).rstrip("/")) + 2, 4096)


EMPTY_PAGES = "path string, raw string"


def read_pages(spark: SparkSession, root: str, roots: tuple[str, ...] = ROOTS, limit: int | None = None, pattern: str = "*.md") -> DataFrame:
    """(path, raw) of the Markdown files below the archive's roots, in order of paths if limited.

    Files and folders whose names begin with a dot are left out, missing roots are empty. One row a file;
    a file is read whole, by one task.
    """
    found = _files(spark, root, pattern, "text")
    if found is None:
        return spark.createDataFrame([], EMPTY_PAGES)
    rows = found.select(_relative(root).alias("path"), F.col("value").alias("raw"))
    rows = rows.where(~F.col("path").rlike(r"(^|/)\.") & F.split_part("path", F.lit("/"), F.lit(1)).isin(*roots))
    return rows.orderBy("path").limit(limit) if limit else rows


def require_pages(pages: DataFrame, root: str) -> DataFrame:
    """The pages, or an error if there are none."""
    if pages.isEmpty():
        raise FileNotFoundError(f"no Markdown pages under {root}")
    return pages


def file_manifest(spark: SparkSession, root: str, roots: tuple[str, ...] = ROOTS, pattern: str = "*.md") -> DataFrame:
    """(path, hash): the sha256 of every file's bytes."""
    found = _files(spark, root, pattern, "binary")
    if found is None:
        return spark.createDataFrame([], "path string, hash string")
    rows = found.select(_relative(root).alias("path"), F.sha2("content", 256).alias("hash"))
    return rows.where(~F.col("path").rlike(r"(^|/)\.") & F.split_part("path", F.lit("/"), F.lit(1)).isin(*roots))


def read_json(spark: SparkSession, path: str, schema: str | None = None, required: bool = True) -> DataFrame | None:
    """Rows of a JSON file or folder of files (S7); None, or an error, if it is missing."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        if required:
            raise FileNotFoundError(f"missing {path}")
        return None
    reader = spark.read.option("multiLine", "true")
    return (reader.schema(schema) if schema else reader).json(path)


def write_table(rows: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by: tuple[str, ...] = ()) -> None:
    """A table as parquet, orc, csv or JSON lines."""
    rows.write.mode(mode).format(fmt).partitionBy(*partition_by).save(path)


def write_json_document(rows: DataFrame, path: str, order: list[str], indent: int = 2) -> None:
    """All rows as one indented JSON array in one file, in the given order (S8): for a published graph that
    people read. Parts of the table come one by one, so the driver holds one part at a time; there as a whole
    or not at all. An empty table is an empty array. For tables of any size use write_table()."""

    def texts():
        between = "[\n"
        for row in to_json_rows(rows.orderBy(*order)).toLocalIterator():
            shown = json.dumps(json.loads(row.value), ensure_ascii=False, indent=indent)
            yield between + "\n".join(" " * indent + line for line in shown.split("\n"))
            between = ",\n"
        yield "[]\n" if between == "[\n" else "\n]\n"

    write_text(rows.sparkSession, path, texts())


def to_json_rows(rows: DataFrame) -> DataFrame:
    """(value): each row as a JSON object, for exports (S10). Null fields are kept."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))


def published(spark: SparkSession, root: str, names: tuple[str, ...] = ("entities", "events", "relations", "sources")) -> dict[str, DataFrame]:
    """The tables of a published graph."""
    return {n: spark.read.parquet(f"{root}/{n}") for n in names}


def archive_version(root: str) -> tuple[str, str]:
    """(commit, time) of the archive's git checkout; empty texts without one."""
    try:
        out = subprocess.run(["git", "-C", root, "log", "-1", "--format=%H%n%cI"], capture_output=True, text=True, check=True, timeout=30)
        commit, time = out.stdout.split("\n")[:2]
        return commit, time
    except (OSError, subprocess.SubprocessError, ValueError):
        return "", ""


def arguments(argv: list[str]) -> argparse.Namespace:
    """Options of the command line: `--key value`, `--key=value`, and flags."""
    parser = argparse.ArgumentParser(description="Build or update the news graph.")
    parser.add_argument("mode", choices=("bootstrap", "rebuild", "update", "validate"))
    parser.add_argument("--archive", required=True)
    parser.add_argument("--state", required=True)
    parser.add_argument("--rules")
    parser.add_argument("--ontology")
    parser.add_argument("--overrides")
    parser.add_argument("--limit", type=int)
    parser.add_argument("--roots", default=",".join(ROOTS), type=lambda v: tuple(v.split(",")))
    return parser.parse_args(argv)
