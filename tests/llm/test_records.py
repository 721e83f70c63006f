import random
from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from newsloom.llm import batches, names
from newsloom.operators.snapshots import canonical_hash

T0 = datetime(2020, 1, 1)
SOURCES = "id string, repositoryPath string, contentHash string, ingestedAt timestamp_ntz, ord string"
BATCHES = "batchNo int, arrivedAt timestamp_ntz, id string, repositoryPath string, contentHash string, low string"


def text(seed, n=120):
    r = random.Random(seed)
    return "".join(chr(r.randint(0x4E00, 0x9000)) for _ in range(n))


def edit(t, k=3):
    r = random.Random(len(t))
    for _ in range(k):
        i = r.randint(5, len(t) - 5)
        t = t[:i] + "改" + t[i + 1 :]
    return t


def test_page_paths(spark):
    same = ["main/1-100/3.md", "./main//1-100/3.md", "main\\1-100\\3.md", "/main/1-100/3.md ", "main/1-100/../1-100/3.md", "main/1-100/%33.md", "Main/1-100/3.MD", "main/1-100/3 (1).md"]
    other = ["main/1-100/4.md", "main/1-100/3-qa.md", "a+b%.md", None, "", "../x.md"]
    found = spark.createDataFrame([(p,) for p in same + other], "p string").select("p", batches.page_path(F.col("p")).alias("q")).collect()
    assert {r.q for r in found if r.p in same} == {"main/1-100/3.md"}
    assert {r.p: r.q for r in found if r.p in other} == {"main/1-100/4.md": "main/1-100/4.md", "main/1-100/3-qa.md": "main/1-100/3-qa.md", "a+b%.md": "a+b%.md", None: None, "": None, "../x.md": "x.md"}


def tables(spark, sources, coming, raw):
    s = spark.createDataFrame([(i, p, h, T0 + timedelta(seconds=n), "x") for n, (i, p, h) in enumerate(sources)], SOURCES)
    b = spark.createDataFrame([(no, T0 + timedelta(days=no, seconds=n), i, p, h, "x") for n, (no, i, p, h) in enumerate(coming)], BATCHES)
    return s, b, spark.createDataFrame(raw, "id string, raw string")


def test_deliveries_find_the_earliest_page(spark):
    sources = [("s1", "main/1.md", "aa"), ("s2", "main/2.md", None), ("s1", "main/1.md", "aa"), ("s3", "main/3.md", "cc")]
    coming = [
        (1, "b1", "./main/1.md", None), (1, "b2", "new/1.md", "sha256:AA"), (1, "b3", "new/2.md", None), (1, "b4", "new/3.md", None), (2, "b5", "new/4.md", None), (2, "b6", "new/3.md ", None), (2, "b7", None, None),
        (2, "b8", "new/8.md", None), (2, "b9", "new/9.md", None),
    ]
    raw = [
        ("s1", text(1)), ("s2", "---\ntitle: x\n---\n" + text(2)), ("s3", None), ("b1", None), ("b2", None), ("b3", "---\ntitle: y\n---\n" + edit(text(2))), ("b4", text(4)), ("b5", edit(text(4))), ("b6", text(6)), ("b7", ""),
        # shares a passage, no more
        ("b8", text(2)[:40] + text(8)), ("b9", text(9, 60_000)),
    ]
    want = [("b1", "s1"), ("b2", "s1"), ("b3", "s2"), ("b5", "b4"), ("b6", "b4")]
    for steps in (1, 2, None):
        assert rows(batches.repeated_deliveries(*tables(spark, sources, coming, raw), canonical_hash, admissions=steps)) == want


def test_records_of_one_time_or_none_stay_apart(spark):
    """4,000 pages share a time or have none: more than any 11 bits of a hash tell apart."""
    n = 2000
    s = spark.createDataFrame([(f"s{i:04}", f"p/{i}.md", f"{i:x}", None, "x") for i in range(n)], SOURCES)
    # a third repeat a page by its path, a third the delivery before them by its hash, a third nothing
    path = [f"p/{i}.md" if i % 3 == 0 else f"q/{i}.md" for i in range(n)]
    digest = [f"ff{i - i % 3 // 2:x}" for i in range(n)]
    b = spark.createDataFrame([(1 + i // 500, None, f"b{i:04}", path[i], digest[i], "x") for i in range(n)], BATCHES)
    raw = spark.createDataFrame([], "id string, raw string")
    want = sorted([(f"b{i:04}", f"s{i:04}") for i in range(0, n, 3)] + [(f"b{i:04}", f"b{i - 1:04}") for i in range(2, n, 3)])
    for time in (None, T0):
        once = F.lit(time).cast("timestamp_ntz")
        found = batches.repeated_deliveries(s.withColumn("ingestedAt", once), b.withColumn("arrivedAt", once), raw, canonical_hash)
        assert rows(found) == want


def test_empty_tables(spark):
    assert batches.repeated_deliveries(*tables(spark, [], [], []), canonical_hash).count() == 0
    one = tables(spark, [("s1", "a.md", None)], [(1, "b1", "a.md", None)], [])
    assert rows(batches.repeated_deliveries(*one, canonical_hash)) == [("b1", "s1")]


@pytest.mark.parametrize("direct", [batches.DIRECT, 0])
def test_a_third_of_all_pages_alike(spark, monkeypatch, direct):
    """A hot group of different edits of one page, beyond the first block of a stretch, and of exact copies, at once
    and block by block."""
    monkeypatch.setattr(batches, "DIRECT", direct)
    base = text(50, 300)
    sources = [(f"s{i:03}", f"x/{i}.md", None) for i in range(80)]
    raw = [(f"s{i:03}", base[:-1] + chr(0x5000 + i) if i % 2 else text(i)) for i in range(80)]
    coming = [(1 + i % 3, f"b{i:02}", f"y/{i}.md", None) for i in range(12)]
    raw += [(f"b{i:02}", base if i % 3 else base + "完") for i in range(12)]
    found = rows(batches.repeated_deliveries(*tables(spark, sources, coming, raw), canonical_hash))
    assert found == [(f"b{i:02}", "s001") for i in range(12)]


def test_a_match_of_a_later_run_does_not_end_the_search(spark, tmp_path):
    """The new records' like in the history lies behind 40 records that share a band and little more, and the
    two new ones are alike."""
    import numpy as np

    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 16, (batches.BANDS, batches.BAND_VALUES), dtype=np.uint16)
    lows = {}
    for i in range(120):
        lows[i] = r.integers(0, 1 << 16, base.shape, dtype=np.uint16)
        lows[i][i % 3 :: 3] = base[i % 3 :: 3]
    lows |= {200: base, 300: base, 301: base}
    pages = spark.createDataFrame([(o, None, None, o, bytearray(low.tobytes())) for o, low in lows.items()], batches.FEATURES)
    index = batches.NeighbourhoodIndex(spark, str(tmp_path / "index"))
    index.admit(pages.where("ord < 300"), match=False)
    assert {(300, 200), (301, 200)} <= set(rows(index.admit(pages.where("ord >= 300")), "new_ord", "ord"))


def test_recall_at_the_declared_similarity(spark):
    """Short pages with an edit per dozen tokens, of similarity 0.5 to 0.6, against brute force."""
    import numpy as np

    pages = []
    for i in range(600):
        a, r = text(1000 + i), random.Random(i)
        b = list(a)
        for at in r.sample(range(len(b)), 7 + i % 3):
            b[at] = chr(r.randint(0x9001, 0x9FFF))
        x, y = batches.shingles(a), batches.shingles("".join(b))
        if 0.5 <= len(np.intersect1d(x, y)) / len(np.union1d(x, y)) <= 0.6:
            pages.append((i, a, "".join(b)))
    raw = [(f"s{i}", a) for i, a, _ in pages] + [(f"b{i}", b) for i, _, b in pages]
    given = tables(spark, [(f"s{i}", f"x/{i}.md", None) for i, *_ in pages], [(1, f"b{i}", f"y/{i}.md", None) for i, *_ in pages], raw)
    found, want = set(rows(batches.repeated_deliveries(*given, canonical_hash))), {(f"b{i}", f"s{i}") for i, *_ in pages}
    assert len(want) > 300 and found <= want and len(found) >= 0.98 * len(want)


def test_compaction_keeps_the_result(spark, tmp_path):
    index = batches.NeighbourhoodIndex(spark, str(tmp_path / "index"))
    texts = batches.text_features(spark.createDataFrame([(f"p{i}", text(i % 9)) for i in range(30)], "id string, raw string"))
    pages = spark.createDataFrame([(f"p{i}", i, f"q/{i}", None) for i in range(30)], "id string, ord bigint, path string, digest string")
    found = []
    for n in range(10):
        part = index.admit(batches.page_features(pages.where(F.floor(F.col("ord") / 3) == n), texts), match=n > 0)
        if part is not None:
            found += rows(part.where("exact"), "new_ord", "ord")
    assert len(index.runs) <= batches.MOST_RUNS + 1
    assert sorted(found) == [(i, i % 9) for i in range(9, 30)]


def pages_of(spark, first, n, at=0):
    """FEATURES of n pages with texts of their own."""
    raw = [(f"p{i}", text(i)) for i in range(first, first + n)]
    texts = batches.text_features(spark.createDataFrame(raw, "id string, raw string"))
    pages = spark.createDataFrame([(f"p{i}", at + i, f"q/{i}", None) for i in range(first, first + n)], "id string, ord bigint, path string, digest string")
    return batches.page_features(pages, texts)


def test_an_index_is_opened_again(spark, tmp_path):
    root = str(tmp_path / "index")
    first = batches.NeighbourhoodIndex(spark, root)
    first.admit(pages_of(spark, 0, 20), match=False)
    first.admit(pages_of(spark, 20, 5))
    first.close()
    # a batch that did not come to its end leaves rows that no manifest names
    lost = batches.NeighbourhoodIndex(spark, root)
    lost._write(lost.records([1]).drop("batch"), lost._records, 9, "ord")
    lost.close()
    again = batches.NeighbourhoodIndex(spark, root)
    found = again.admit(pages_of(spark, 3, 20, at=100))
    assert [r for r in rows(found.where("exact"), "new_ord", "ord")] == [(100 + i, i) for i in range(3, 23)]
    assert again.spark.table(again._records).count() == 45
    again.close(delete=True)
    assert not (tmp_path / "index").exists()


def test_only_touched_ranges_are_read(spark, tmp_path):
    """What a batch reads grows with the ranges that it has keys in, not with the history; nothing but the batch
    shuffles on the way to its ranges."""
    import os

    index = batches.NeighbourhoodIndex(spark, str(tmp_path / "index"), ranges=32)
    schema = batches.FEATURES
    one = lambda a, b: spark.createDataFrame([(o, o % 2000, None, None, None) for o in range(a, b)], schema)
    index.admit(one(0, 2000), match=False)
    found = index.admit(one(4007, 4009))
    assert rows(found, "new_ord", "ord") == [(4007, 7), (4008, 8)]
    files = index.touched(index.batches[-1])
    history = sum(os.path.getsize(f.removeprefix("file://")) for f in spark.table(index._runs).where("run = 1").inputFiles())
    read = sum(os.path.getsize(f.removeprefix("file://")) for f in files if "run=1" in f)
    assert 0 < read <= history / 8
    index.admit(one(5000, 6000))
    assert index.touched(index.batches[-1]) is None
    # most ranges: both sides stay where they are
    live = spark.table(index._runs)
    mine = live.where("run = 3 AND kind < 4").selectExpr("key", "kind", "ord AS mine").hint("merge")
    joined = mine.join(live.where("kind < 4 AND place < 32").selectExpr("key", "kind AS of", "ord"), "key").where("kind <= of AND kind >= of")
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    index.close()


def test_copies_in_a_batch_share_what_the_first_one_meets(spark):
    """A copy of a delivery has the delivery's near duplicate as its earliest page, even where its path is new, and
    the delivery itself repeats a later page by its path."""
    base = text(70, 200)
    sources = [("s1", "a/1.md", None), ("s2", "a/2.md", None)]
    coming = [(1, "b1", "a/2.md", None), (1, "b2", "c/2.md", None), (2, "b3", "c/3.md", None)]
    raw = [("s1", edit(base)), ("s2", text(71)), *((f"b{i}", base) for i in (1, 2, 3))]
    for steps in (1, None):
        found = batches.repeated_deliveries(*tables(spark, sources, coming, raw), canonical_hash, admissions=steps)
        assert rows(found) == [("b1", "s1"), ("b2", "s1"), ("b3", "s1")]


def test_the_query_compacts(spark, monkeypatch):
    """One admission for each of eight batches: runs of batches are merged on the way."""
    merged = []
    compact = batches.NeighbourhoodIndex.compact
    monkeypatch.setattr(batches.NeighbourhoodIndex, "compact", lambda self, *a: merged.append(len(self.runs)) or compact(self, *a))
    sources = [(f"s{i}", f"x/{i}.md", None) for i in range(8)]
    coming = [(no, f"b{no}{i}", f"y/{no}/{i}.md", None) for no in range(1, 9) for i in range(3)]
    raw = [(f"s{i}", text(i)) for i in range(8)] + [(f"b{no}{i}", edit(text(no - 1)) if i == 0 else text(100 + no // 2) if i == 1 else None) for no in range(1, 9) for i in range(3)]
    found = rows(batches.repeated_deliveries(*tables(spark, sources, coming, raw), canonical_hash))
    assert merged and found == sorted([(f"b{no}0", f"s{no - 1}") for no in range(1, 9)] + [(f"b{no}1", f"b{no - 1}1") for no in (3, 5, 7)])


def test_similarity_estimate():
    import numpy as np

    a, b = text(1, 600), edit(text(1, 600), 9)
    x, y = batches.shingles(a), batches.shingles(b)
    exact = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    estimate = np.mean(batches.min_hashes(x).astype(np.uint16) == batches.min_hashes(y).astype(np.uint16))
    assert abs(exact - estimate) < 0.15
    assert len(batches.shingles("")) == 0 and len(batches.shingles("one two")) == 1 and list(batches.shingles("ＡＢ c")) == list(batches.shingles("ab C"))


ENTITIES = "id string, label string, type string, aliases array<string>, root string"


def linked(spark, data):
    df = spark.createDataFrame([(f"entity-{i}", label, None, aliases, "x") for i, label, aliases in data], ENTITIES)
    return [tuple(x.removeprefix("entity-") for x in r) for r in rows(names.variant_pairs(df))]


def test_persons(spark):
    data = [
        ("person-1", "威廉·波达沃洛", ["William Podavolo"]), ("person-2", "比尔·波达沃洛", None), ("person-3", "波达沃洛 威廉", []), ("person-4", "W·波达沃洛", []), ("person-5", "PODAVOLO, William", []),
        ("person-6", "William Podavloo", []), ("person-7", "威廉·波答沃洛", []), ("person-8", "罗伯特·波达沃洛", []), ("person-9", "波达沃洛女士", ["威廉·波达沃洛"]), ("person-a", "波达沃洛先生", []),
        ("organization-1", "威廉·波达沃洛", []), ("place-1", "威廉·波达沃洛", []), ("person-b", None, None), ("person-c", "", [None, ""]), ("person-1", "威廉·波达沃洛", ["William Podavolo"]),
    ]
    found = linked(spark, data)
    group = [f"person-{c}" for c in "1234567"] + ["person-9"]
    assert found == sorted(((a, b) for i, a in enumerate(group) for b in group[i + 1 :]), key=repr)


def test_bodies(spark):
    data = [
        ("organization-1", "弗穆诺米生物制药股份有限公司", ["Fumunomi Biological Medicine Corporation"]), ("organization-2", "Fumunomi BMC", ["弗穆诺米生物制药股份有限公司"]), ("organization-3", "Corporation of Fumunomi Biological Medicine", None),
        ("organization-4", "弗穆诺米生药公司", []), ("organization-5", "生物制药股份有限公司（弗穆诺米）", []), ("organization-6", "弗穆诺米航运基金会", []), ("organization-7", "弗穆诺米生物制药第一分院", []), ("organization-8", "弗穆诺米生物制药第二分院", []),
        ("organization-9", "弗姆诺米生物制药股份有限公司", []), ("organization-a", "The Fumunomi Biomed Corp.", []),
    ]
    group = [f"organization-{c}" for c in "123459a"]
    assert linked(spark, data) == sorted(((a, b) for i, a in enumerate(group) for b in group[i + 1 :]), key=repr)
    assert linked(spark, []) == []


def test_typo_pairs_against_brute_force(spark):
    r = random.Random(3)
    words = sorted({"".join(r.choice("abcd") for _ in range(r.randint(3, 6))) for _ in range(150)})
    found = rows(names.typo_pairs(spark.createDataFrame([("c", w) for w in words], "class string, core string"), ["class"]), "core_a", "core_b")
    assert found == sorted((a, b) for a in words for b in words if a < b and names.one_edit(a, b))


def test_components_of_a_chain_and_a_star(spark):
    chain = [(f"n{i:02}", f"n{i + 1:02}") for i in range(40)]
    star = [("a", f"s{i}") for i in range(50)]
    found = names.components(spark.createDataFrame(chain + star + [("q", "q")], "a string, b string"))
    assert {(r.node, r.root) for r in found.collect()} == {(f"n{i:02}", "n00") for i in range(1, 41)} | {(f"s{i}", "a") for i in range(50)}


def test_components_that_do_not_settle_raise(spark):
    import pytest

    with pytest.raises(RuntimeError):
        names.components(spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}") for i in range(40)], "a string, b string"), rounds=1)
