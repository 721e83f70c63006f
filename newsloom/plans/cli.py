"""The command line: bootstrap, rebuild, update or validate a published graph."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators import validate as V
from newsloom.operators.extract import Rules, region_names
from newsloom.operators.segment import OVERRIDES
from newsloom.plans import lifecycle as C
from newsloom.plans.pipeline import build_graph, build_news
from newsloom.session import ship
from newsloom.sources import archive as A

#: Issues that are printed at most.
SHOWN = 30


def text_of(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def all_issues(spark: SparkSession, state: str, archive: str, roots: tuple[str, ...], ontology: V.Ontology | None) -> DataFrame:
    """Every issue of a published state: dataset, graph, projection and fragments (V6)."""
    t = A.published(spark, state, C.TABLES)
    pages = A.read_pages(spark, archive, roots).select(F.col("path").alias("repositoryPath"), "raw")
    raw = t["pages"].select(F.col("id").alias("pageId"), "repositoryPath").join(pages, "repositoryPath").select("pageId", "raw")
    parts = [V.validate_news(t["pages"], t["news"]), V.validate_projection(t["news"], t["events"], t["pages"], t["pages"]), V.validate_fragments(t["news"], t["pages"], raw)]
    if ontology:
        parts.append(V.validate_graph(t["entities"], t["events"], t["relations"], t["pages"], ontology))
    return V.union(parts)


def main(argv: list[str], spark: SparkSession | None = None) -> int:
    """Runs one mode; 0 if it went well, 1 if there are errors or a guard refused."""
    args = A.arguments(argv)
    spark = ship(spark or SparkSession.builder.getOrCreate())
    import json

    ontology = V.Ontology.from_json(json.loads(text_of(spark, args.ontology))) if args.ontology else None
    if args.mode == "validate":
        issues = all_issues(spark, args.state, args.archive, args.roots, ontology)
        for row in issues.orderBy("level", "path", "message").limit(SHOWN).collect():
            print(f"[{row.level}] {row.path}: {row.message}")
        return int(not issues.where("level = 'error'").isEmpty())
    rules = Rules.from_json(text_of(spark, args.rules)) if args.rules else Rules()
    overrides = A.read_json(spark, args.overrides, OVERRIDES) if args.overrides else None
    pages = A.require_pages(A.read_pages(spark, args.archive, args.roots, args.limit), args.archive)
    news = build_news(pages, overrides)
    graph = build_graph(news, rules, region_names(spark, rules.region_codes))
    versions = C.Versions(rules=rules.version, ontology=ontology.version if ontology else "0", roots=args.roots)
    run = {"bootstrap": C.bootstrap, "rebuild": C.rebuild, "update": C.update}[args.mode]
    try:
        done = run(spark, args.state, news, graph, A.file_manifest(spark, args.archive, args.roots), versions)
    except C.LifecycleError as e:
        print(f"refused: {e}", file=sys.stderr)
        return 1
    written = done[0] if isinstance(done, tuple) else done
    print(f"archive {A.archive_version(args.archive)[0] or 'without version'}: wrote {', '.join(written) or 'nothing'}")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
