from conftest import rows
from pyspark.sql import functions as F

from newsloom.operators import snapshots as S

SNAPS = "snapshotNo int, repositoryPath string, contentHash string, no int, k string, change string"


def run(spark, data):
    df = spark.createDataFrame([(*d, 9, "k", "x") for d in data], SNAPS)
    return rows(S.changes(df, key=S.canonical_path(F.col("repositoryPath")), value=S.canonical_hash(F.col("contentHash"))))


def test_added_removed_changed_over_gaps(spark):
    data = [
        (1, "a/x.md", "AA"), (1, "./a//y.md", "bb"), (1, "a/y.md", "sha256:BB"), (1, "a/z.md", None), (1, "a/w.md", "cc"),
        (4, "a\\x.md", "sha256:aa"), (4, "a/y.md", None), (4, "a/z.md", "dd"), (4, "a/v.md", "cc"), (4, "a/v.md", "cc"),
        (9, "a/x.md", "aa"), (9, "a/y.md", ""), (9, "a/z.md", "dd"), (9, "a/v.md", "cc"), (9, None, "cc"),
    ]
    assert run(spark, data) == [(4, "a/v.md", "added"), (4, "a/w.md", "removed"), (4, "a/y.md", "changed"), (4, "a/z.md", "changed")]


def test_one_or_no_snapshot_gives_nothing(spark):
    assert run(spark, [(1, "a", "x"), (1, "b", "y")]) == []
    assert run(spark, []) == []


def test_several_values_of_one_key(spark):
    same = [(n, "a", h) for n in (1, 2) for h in ("x", "y")]
    assert run(spark, same) == []
    assert run(spark, [*same, (3, "a", "x")]) == [(3, "a", "changed")]


def test_everything_goes_and_comes_back(spark):
    data = [(1, "a", "x"), (2, "b", "x"), (3, "a", "x")]
    assert run(spark, data) == [(2, "a", "removed"), (2, "b", "added"), (3, "a", "added"), (3, "b", "removed")]


def test_long_paths(spark):
    path = "d/" * 5000 + "x.md"
    assert run(spark, [(1, path, "a"), (2, path.replace("/", "//"), "b")]) == [(2, path, "changed")]
