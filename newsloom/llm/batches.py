"""Duplicates of new batches against everything accepted, without reading the history's texts again.

Multi-key sorted neighbourhoods over persisted runs. A record has several sort keys: its canonical
path, its content hash, its text, and bands of min-hash values of its five-token shingles, so that
records that share most of their text share a band and lie side by side in sorted order. All runs lie in
one table of fixed key ranges (buckets of the hashed key), each sorted by (key, ord). A new batch is
sorted into the same ranges as a run of its own: only the batch shuffles, then ranges are merged side by
side and the windows before its records compared, the stretches of equal keys. Ranges that a batch
has no key in are not read. Runs of batches are compacted into one every few batches. A manifest names
the live runs, so an index is opened again where the last batch left it.

Windows have no fixed width. The first BLOCK records of a key in a run are its front. What lies behind the
fronts is searched only for records that have met nothing earlier alike, from the earliest on, in blocks
that grow fourfold. A match ends a record's search only for records accepted after the match. A stretch
that holds a third of all rows has a front like any other; the rest of it is spread over all ranges.
"""

from __future__ import annotations

import json
import re
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.llm.leaks import _fold
from newsloom.session import drop_path, durable, list_paths, scratch, write_text

#: Min-hash bands and values of a band: a pair of similarity s shares a band with probability
#: 1 - (1 - s^3)^32, which is 0.986 at the declared bound of 0.5, 0.997 at 0.55 and 0.9996 at 0.6.
BANDS, BAND_VALUES = 32, 3
#: Tokens of a shingle. TESTDATA asks for light edits that keep most of the text: more than half of all
#: shingles of both texts are common.
SHINGLE, LEAST_SIMILARITY = 5, 0.5
#: The min-hash values also estimate a pair's similarity, with a standard error of 0.05 at most. Pairs
#: below the first bound are dropped, pairs above the second end the search of a stretch; all that are
#: left are compared exactly.
MAYBE, SURELY = 0.33, 0.67
#: Records of a key that are the front of its stretch in a run; a new record is compared with these at first.
BLOCK = 32
#: Runs of batches before they are compacted into one; the history's run stays apart.
MOST_RUNS = 4
#: Records of the history in a key range on average; with fewer, there is a range for each core.
RANGE_RECORDS = 200_000
#: Pairs with records behind the fronts that a batch takes up at once; more go block by block, with the same result.
DIRECT = 1_000_000
#: Rows (id, number) that are broadcast at most, about 30 MB.
BROADCAST_ROWS = 500_000

_FRONT = re.compile(r"\A\s*---[ \t]*\r?\n.*?\r?\n---[ \t]*(?:\r?\n|\Z)", re.S)
_RANDOM = np.random.default_rng(20240607)
_MULTIPLY = (_RANDOM.integers(0, 1 << 32, BANDS * BAND_VALUES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_PLACES = (_RANDOM.integers(0, 1 << 32, SHINGLE, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_ADD = _RANDOM.integers(0, 1 << 32, BANDS * BAND_VALUES, dtype=np.uint64).astype(np.uint32)


class _Words(dict):
    """A translation table that fills itself: one form of width and case, a blank for what is neither
    letter nor digit."""

    def __missing__(self, cp: int) -> str:
        self[cp] = _fold[cp] or ("" if unicodedata.category(chr(cp)) == "Cf" else " ")
        return self[cp]


_words = _Words()


def page_path(path: Column) -> Column:
    """One spelling of a page's path: percent escapes decoded, single forward slashes, relative, `.`
    and `..` steps taken, lower case, no outer blanks, no copy number before the extension."""
    # `+` is a plus sign in a path, and a lone percent sign is itself
    p = F.regexp_replace(F.regexp_replace(path, r"\+", "%2B"), r"%(?![0-9A-Fa-f]{2})", "%25")
    p = F.lower(F.regexp_replace(F.trim(F.coalesce(F.try_url_decode(p), path)), r"[\\/]+", "/"))
    p = F.regexp_replace(p, r"[\s 　]+$|^[\s 　]+", "")
    steps = F.filter(F.split(p, "/"), lambda s: (s != "") & (s != "."))
    taken = F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda done, s: F.when((s == "..") & (F.size(done) > 0), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .when(s == "..", done)
        .otherwise(F.concat(done, F.array(s))),
    )
    p = F.regexp_replace(F.array_join(taken, "/"), r"\s*\(\d{1,3}\)(?=\.[a-z0-9]+$)", "")
    return F.nullif(p, F.lit(""))


def page_body(raw: str) -> str:
    """The page without its front matter, which says when and not what."""
    return raw[m.end() :] if (m := _FRONT.match(raw)) else raw


def token_hashes(text: str) -> np.ndarray:
    """A 32-bit hash of each token: a Han character or a word, in one form of width and case."""
    cp = np.frombuffer(text.translate(_words).encode("utf-32-le", "replace"), dtype=np.uint32)
    if not len(cp):
        return cp
    han = ((cp >= 0x3400) & (cp <= 0x9FFF)) | (cp >= 0x20000)
    blank = cp == 32
    word = ~(han | blank)
    # a token starts at each Han character and where a word begins
    start = han.copy()
    start[0] |= word[0]
    start[1:] |= word[1:] & ~word[:-1]
    at = np.flatnonzero(start)
    if not len(at):
        return np.empty(0, np.uint32)
    # a character's part depends on its place in the token, blanks have none
    own = np.arange(len(cp), dtype=np.uint32) - np.repeat(at, np.diff(np.append(at, len(cp)))).astype(np.uint32) if at[0] == 0 else None
    if own is None:
        cp, han, blank = cp[at[0] :], han[at[0] :], blank[at[0] :]
        at = at - at[0]
        own = np.arange(len(cp), dtype=np.uint32) - np.repeat(at, np.diff(np.append(at, len(cp)))).astype(np.uint32)
    part = cp * (own * np.uint32(0x9E3779B1) + np.uint32(0x85EBCA77))
    part = (part ^ (part >> np.uint32(15))) * np.uint32(0xC2B2AE3D)
    part[blank] = 0
    return np.add.reduceat(part, at, dtype=np.uint32)


def shingles(text: str) -> np.ndarray:
    """Distinct 32-bit hashes of the text's five-token shingles. A shorter text is one shingle; a text
    without tokens has none."""
    codes = token_hashes(text)
    if not len(codes):
        return codes
    k = min(SHINGLE, len(codes))
    n = len(codes) - k + 1
    mixed = codes[:n] * _PLACES[0]
    for i in range(1, k):
        mixed += codes[i : i + n] * _PLACES[i]
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    mixed ^= mixed >> np.uint32(12)
    return np.unique(mixed)


def min_hashes(hashes: np.ndarray) -> np.ndarray:
    """The least value of the hashes under each of BANDS * BAND_VALUES permutations."""
    low = np.full(len(_MULTIPLY), np.iinfo(np.uint32).max, dtype=np.uint32)
    for at in range(0, len(hashes), 1024):  # bounds the memory of very long texts
        # the hashes are mixed well, so a multiplication and an addition permute them well enough
        v = hashes[at : at + 1024] * _MULTIPLY[:, None]
        v += _ADD[:, None]
        np.minimum(low, v.min(axis=1), out=low)
    # the low bits, which are kept, of a product depend on low bits alone: mix them
    low ^= low >> np.uint32(16)
    low *= np.uint32(0x85EBCA6B)
    return low ^ (low >> np.uint32(13))


def bands(lows: np.ndarray) -> np.ndarray:
    """One value for each band of min-hash values (rows of 16-bit values), a row for each record."""
    values = lows.astype(np.uint64)
    band = np.zeros((len(values), BANDS), dtype=np.uint64)
    for i in range(BAND_VALUES):
        band = (band ^ values[:, i::BAND_VALUES]) * np.uint64(0xC2B2AE3D27D4EB4F)
        band ^= band >> np.uint64(29)
    band ^= np.arange(BANDS, dtype=np.uint64)
    band *= np.uint64(0x9E3779B97F4A7C15)  # spreads the bands of one value over all ranges
    return (band ^ (band >> np.uint64(32))).view(np.int64)


FEATURES = "ord bigint, path bigint, digest bigint, text bigint, low binary"
TEXTS = "id string, text bigint, low binary"


def text_features(raw_pages: DataFrame) -> DataFrame:
    """TEXTS of pages (id, raw): a 64-bit key of the text and 16 bits of each min-hash value. Null or empty
    text has neither. Each text is read once, next to the scan; only these few bytes travel."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for batch in batches:
            text, low = [], []
            for raw in batch["raw"]:
                body = page_body(raw).strip() if raw else ""
                hashes = shingles(body)
                text.append(xxhash.xxh64_intdigest(" ".join(body.split()).encode("utf-8", "replace")) - (1 << 63) if body else None)
                low.append(min_hashes(hashes).astype(np.uint16).tobytes() if len(hashes) else None)
            yield pd.DataFrame({"id": batch["id"], "text": pd.array(text, "Int64"), "low": low})

    return raw_pages.select("id", "raw").where("id IS NOT NULL").mapInPandas(run, TEXTS)


def page_features(pages: DataFrame, texts: DataFrame) -> DataFrame:
    """FEATURES of pages (id, ord, path, digest) and their TEXTS, and the id. Keys of different kinds differ."""
    joined = pages.select("id", "ord", "path", "digest").join(texts, "id", "left")
    keys = [F.when(F.col(c).isNotNull(), F.xxhash64(F.lit(i), F.col(c))).alias(c) for i, c in enumerate(EXACT)]
    return joined.select("ord", *keys, "low", "id")


#: The exact keys, by kind. Kind 3 are the bands; kind 4 are bands behind the front, whose range is any.
EXACT = ("path", "digest", "text")
BAND, BEHIND = 3, 4
RUN = "key bigint, kind tinyint, ord bigint, place int, band bigint"
RECORDS = "ord bigint, id string, path bigint, digest bigint, text bigint, low binary"
HITS = "batch int, kind tinyint, key bigint, mine bigint, ord bigint"


def _keys_of(batch: pa.RecordBatch, known: dict[int, np.ndarray], crowded: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Keys, kinds, ords and whether they lie behind the front, of records sorted by ord; and the bands that
    are crowded from now on. Of an exact key only the first record counts, and only the first of each text
    has bands: `known` has the exact keys that came more than once."""
    ords = batch.column("ord").to_numpy(zero_copy_only=False)
    keys, kinds, whose, first_text = [], [], [], np.zeros(len(ords), dtype=bool)
    for kind, name in enumerate(EXACT):
        column = batch.column(name)
        at = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
        value, first, count = np.unique(column.drop_null().to_numpy(zero_copy_only=False), return_index=True, return_counts=True)
        fresh = ~np.isin(value, known[kind])
        known[kind] = np.union1d(known[kind], value[count > 1])
        keys.append(value[fresh])
        whose.append(at[first[fresh]])
        kinds.append(np.full(fresh.sum(), kind, dtype=np.int8))
        if name == "text":
            first_text[whose[-1]] = True
    low = batch.column("low")
    at = np.flatnonzero(first_text & low.is_valid().to_numpy(zero_copy_only=False))
    exact = sum(map(len, keys))
    if len(at):
        lows = np.frombuffer(b"".join(low.take(pa.array(at)).to_pylist()), dtype=np.uint16).reshape(len(at), -1)
        band = bands(lows).ravel()
        keys.append(band)
        whose.append(np.repeat(at, BANDS))
        kinds.append(np.full(len(band), BAND, dtype=np.int8))
    key, kind, owner = (np.concatenate(x) for x in (keys, kinds, whose))
    late = np.zeros(len(key), dtype=bool)
    if len(key) > exact:
        band = key[exact:]
        order = np.argsort(band, kind="stable")
        edge = np.flatnonzero(np.append(True, band[order][1:] != band[order][:-1]))
        size = np.diff(np.append(edge, len(band)))
        behind = np.empty(len(band), dtype=bool)
        behind[order] = np.arange(len(band)) - np.repeat(edge, size) >= BLOCK
        late[exact:] = behind | np.isin(band, crowded)
        crowded = np.union1d(crowded, band[order][edge[size >= BLOCK]])
    return [key, kind, ords[owner], late], crowded


def record_keys(records: DataFrame) -> DataFrame:
    """(key, kind, ord, late) of RECORDS. A task combines its records' keys: a key or a text that a third of
    all rows have sends a row or a front for each Arrow batch at most; what else a crowded band has is `late`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, dtype=np.int64)
        known, crowded = dict.fromkeys(range(len(EXACT)), none), none
        for batch in batches:
            columns, crowded = _keys_of(batch, known, crowded)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "kind", "ord", "late"])

    rows = records.select("ord", *EXACT, "low").sortWithinPartitions("ord")
    return rows.mapInArrow(run, "key bigint, kind tinyint, ord bigint, late boolean")


def estimated(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """(new_ord, ord, alike): the share of equal min-hash values. Records lie in ranges of ord: pairs go to
    them, they stay."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            mine, theirs = (np.frombuffer(b"".join(b[c]), np.uint16).reshape(len(b), -1) for c in ("mine", "theirs"))
            yield pd.DataFrame({"new_ord": b["new_ord"], "ord": b["ord"], "alike": (mine == theirs).mean(axis=1) if len(b) else []})

    low = records.where("low IS NOT NULL")
    both = pairs.join(low.select(F.col("ord").alias("new_ord"), F.col("low").alias("mine")), "new_ord")
    both = both.join(low.select("ord", F.col("low").alias("theirs")), "ord")
    return both.select("new_ord", "ord", "mine", "theirs").mapInPandas(run, "new_ord bigint, ord bigint, alike double")


def _bucket(path: str) -> int:
    """The key range of a run's file, which its name tells."""
    return int(re.search(r"_(\d+)(?:\.c\d+)?\.[^/]*$", path).group(1))


class NeighbourhoodIndex:
    """Accepted records as sorted runs under `root`, a folder that all executors share.

    `admit()` takes one batch, merges it in and gives the accepted records that its records may repeat.
    `ord` numbers all records in order of acceptance. The state is what the last manifest under `root` says:
    `NeighbourhoodIndex(spark, root)` starts or goes on, and what a batch left that didn't come to its
    end is taken away.
    """

    def __init__(self, spark: SparkSession, root: str, ranges: int | None = None):
        self.spark, self.root = spark, root
        self.runs: list[int] = []  # all live runs
        self.base: list[int] = []  # those of the history
        self.batches: list[int] = []  # all admissions
        self.ranges, self.counter, self.deep, self.next, self.version = ranges, 0, False, 0, 0
        name = uuid.uuid4().hex[:12]
        self._runs, self._records = f"newsloom_runs_{name}", f"newsloom_records_{name}"
        found = sorted(p for p in list_paths(spark, root) if re.search(r"/manifest-\d+\.json$", p))
        if found:
            state = json.loads(spark.read.text(found[-1], wholetext=True).first()[0])
            self.__dict__.update(state)
        if self.ranges:
            self._open()

    def _open(self) -> None:
        """Tables over the folders of runs and records; both keep their rows in `ranges` buckets."""
        for table, folder, schema, part, key, order, live in (
            (self._runs, "runs", RUN, "run", "key", "key, ord", self.runs), (self._records, "records", RECORDS, "batch", "ord", "ord", self.batches),
        ):
            there = list_paths(self.spark, f"{self.root}/{folder}")
            for path in there:
                if (m := re.search(rf"/{part}=(\d+)$", path)) and int(m.group(1)) not in live:
                    drop_path(self.spark, path)
            self.spark.sql(
                f"CREATE TABLE {table} ({schema}, {part} INT) USING parquet PARTITIONED BY ({part}) CLUSTERED BY ({key}) SORTED BY ({order}) INTO {self.ranges} BUCKETS LOCATION '{self.root}/{folder}'"
            )
            if there:
                self.spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")

    def close(self, delete: bool = False) -> None:
        """Forgets the tables; their files stay unless `delete` is set."""
        if self.ranges:
            for table in (self._runs, self._records):
                self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        if delete:
            drop_path(self.spark, self.root)

    def _commit(self) -> None:
        """A new manifest in one step; until it is there, the one before holds."""
        self.version += 1
        kept = ("runs", "base", "batches", "ranges", "counter", "deep", "next", "version")
        write_text(self.spark, f"{self.root}/manifest-{self.version:08d}.json", json.dumps({k: getattr(self, k) for k in kept}))

    def _write(self, rows: DataFrame, table: str, number: int, key: str) -> None:
        rows.repartition(self.ranges, key).withColumn("number", F.lit(number)).write.insertInto(table)

    def records(self, batches: list[int] | None = None) -> DataFrame:
        """RECORDS and batch of the given batches, or of all."""
        return self.spark.table(self._records).where(F.col("batch").isin(self.batches if batches is None else batches))

    def admit(self, pages: DataFrame, match: bool = True) -> DataFrame | None:
        """Merges a batch of FEATURES in, perhaps with an id, and gives its windows(). With match=False the batch
        is history and is only merged in."""
        number = self.add(pages, match)
        return self.windows([number]) if match else None

    def add(self, pages: DataFrame, match: bool = True) -> int:
        """admit(), which gives the number of the batch instead."""
        if not self.ranges:
            cores = self.spark.sparkContext.defaultParallelism
            self.ranges = min(max(cores, -(-pages.count() // RANGE_RECORDS)), 100_000)
            self._open()
        self.counter += 1
        number = self.counter
        rows = pages if "id" in pages.columns else pages.withColumn("id", F.lit(None).cast("string"))
        self._write(rows.select(*[c.split()[0] for c in RECORDS.split(", ")]), self._records, number, "ord")
        self._write_run(record_keys(self.spark.table(self._records).where(F.col("batch") == number)), number)
        self.runs.append(number)
        self.batches.append(number)
        if match:
            self._search(number)
        else:
            self.base.append(number)
        if len(self.runs) - len(self.base) > MOST_RUNS:
            self.compact()
        self._commit()
        return number

    def _write_run(self, keys: DataFrame, number: int) -> None:
        """A run of (key, kind, ord, late): fronts in their key's range, what is behind them in any."""
        spread_out = F.col("late")
        rows = keys.select(
            F.when(spread_out, F.xxhash64("key", "ord")).otherwise(F.col("key")).alias("key"),
            F.when(spread_out, F.lit(BEHIND)).otherwise(F.col("kind")).cast("tinyint").alias("kind"),
            "ord",
            F.when(spread_out, F.col("key")).alias("band"),
        )
        place = F.row_number().over(Window.partitionBy("key").orderBy("ord")) - 1
        placed = rows.repartition(self.ranges, "key").withColumn("place", place).where(f"kind >= {BAND} OR place = 0")
        placed.select("key", "kind", "ord", "place", "band", F.lit(number)).write.insertInto(self._runs)
        # the footers tell
        here = self.spark.table(self._runs).where(F.col("run") == number)
        self.deep = self.deep or not here.where(f"kind = {BEHIND} OR place >= {BLOCK}").isEmpty()

    def compact(self, everything: bool = False) -> None:
        """Merges the runs of batches into one sorted run; the history's joins them only when `everything` is
        set. What was behind a front stays there, as what came before it does."""
        old = [r for r in self.runs if everything or r not in self.base]
        self.counter += 1
        rows = self.spark.table(self._runs).where(F.col("run").isin(old))
        exact = rows.where(f"kind < {BAND}").groupBy("key", "kind").agg(F.min("ord").alias("ord"))
        behind = rows.where(f"kind = {BEHIND} OR place >= {BLOCK}").select(F.coalesce("band", "key").alias("key"), F.lit(BAND).cast("tinyint").alias("kind"), "ord", F.lit(True).alias("late"))
        front = rows.where(f"kind = {BAND} AND place < {BLOCK}").select("key", "kind", "ord").unionByName(exact).withColumn("late", F.lit(False))
        self._write_run(front.unionByName(behind), self.counter)
        self.runs = [*[r for r in self.runs if r not in old], self.counter]
        if everything:
            self.base = [self.counter]
        self._commit()
        for run in old:
            self.spark.sql(f"ALTER TABLE {self._runs} DROP IF EXISTS PARTITION (run = {run})")
            drop_path(self.spark, f"{self.root}/runs/run={run}")

    def touched(self, number: int) -> list[str] | None:
        """The files of live runs in the key ranges that a run has rows in; None if these are most ranges."""
        live = self.spark.table(self._runs)
        ranges = {_bucket(f) for f in live.where(F.col("run") == number).inputFiles()}
        if 2 * len(ranges) > self.ranges:
            return None
        return [f for f in live.where(F.col("run").isin(self.runs)).inputFiles() if _bucket(f) in ranges]

    def _search(self, number: int) -> None:
        """Writes the HITS of a batch: of its keys the accepted records with the same one."""
        own = self.spark.table(self._runs).where(F.col("run") == number)
        files = self.touched(number)
        every = self.spark.table(self._runs).where(F.col("run").isin(self.runs))
        if files:
            every = self.spark.read.schema(RUN).parquet(*files)
        fronts = every.where(f"kind < {BEHIND} AND place < {BLOCK}").select("key", F.col("kind").alias("of"), "ord")
        mine = own.where(f"kind < {BEHIND}").select("key", "kind", F.col("ord").alias("mine"))
        # kinds are compared apart from the join's key, so that both sides stay in their ranges
        hits = mine.join(fronts, "key").where("ord < mine AND kind <= of AND kind >= of").select("kind", "key", "mine", "ord")
        self._add_hits(hits, number)
        if self.deep:
            self._search_behind(number, own, fronts)

    def _add_hits(self, hits: DataFrame, number: int) -> DataFrame:
        """Writes hits, those of bands once for all bands, and gives them back."""
        path = scratch(self.spark, "hits", f"{self.root}/hits/{number}")
        exact = F.col("kind") < BAND
        hits.select(F.lit(number).alias("batch"), "kind", F.when(exact, F.col("key")).alias("key"), "mine", "ord").distinct().write.parquet(path)
        return self.spark.read.schema(HITS).parquet(path)

    def _hits(self, batches: list[int]) -> DataFrame:
        return self.spark.read.option("recursiveFileLookup", "true").schema(HITS).parquet(*[f"{self.root}/hits/{b}" for b in batches])

    def _search_behind(self, number: int, own: DataFrame, fronts: DataFrame) -> None:
        """The rest of long stretches, in blocks, for records that may have something earlier there."""
        live = self.spark.table(self._runs).where(F.col("run").isin(self.runs))
        tails = live.where(f"kind = {BEHIND} OR kind = {BAND} AND place >= {BLOCK}").select(F.coalesce("band", "key").alias("key"), "ord")
        open_ = own.where(f"kind >= {BAND}").select(F.coalesce("band", "key").alias("key"), F.col("ord").alias("mine"), "kind")
        sizes = open_.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == BEHIND).alias("late"))
        size = sizes.join(tails.groupBy("key").agg(F.count(F.lit(1)).alias("m")), "key").agg(F.sum(F.col("n") * F.col("m")).alias("pairs"), F.sum("late").alias("late")).first()
        if not size.pairs:
            return
        band = F.lit(BAND).cast("tinyint").alias("kind")
        if size.pairs <= DIRECT and not size.late:
            # so few that blocks would spare nothing
            self._add_hits(open_.join(tails, "key").where("ord < mine").select(band, "key", "mine", "ord"), number)
            return
        late = open_.where(f"kind = {BEHIND}").join(fronts.where(f"of = {BAND}").select("key", "ord"), "key").where("ord < mine")
        self._add_hits(late.select(band, "key", "mine", "ord"), number)
        found = self._hits([number])
        # a record with the same text, or one that is surely alike, ends a search for what came after it
        bound = found.where("kind = 2").select(F.col("mine"), F.col("ord").alias("known"))
        going = tails.join(open_.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.min("ord").alias("least"))
        here = found.where(f"kind = {BAND}").select(F.col("mine").alias("new_ord"), "ord").distinct()
        here = here.join(open_.join(going, "key").where("least < mine").select(F.col("mine").alias("new_ord")).distinct(), "new_ord", "left_semi")

        def widened(bound: DataFrame, pairs: DataFrame) -> DataFrame:
            met = estimated(pairs, self.records()).where(F.col("alike") >= SURELY).select(F.col("new_ord").alias("mine"), F.col("ord").alias("known"))
            return durable(bound.unionByName(met).groupBy("mine").agg(F.min("known").alias("known")), "bound")

        def still(open_: DataFrame, going: DataFrame, bound: DataFrame) -> DataFrame:
            rest = open_.select("key", "mine").join(going, "key").join(bound, "mine", "left")
            return durable(rest.where("least < mine AND (known IS NULL OR least < known)").select("key", "mine"), "open")

        bound = widened(bound, here)
        open_ = still(open_, going, bound)
        ranked = durable(_ranked(tails.join(open_.select("key").distinct(), "key", "left_semi")), "ranked")
        longest = ranked.agg(F.max("place")).first()[0]
        lo, hi = 0, BLOCK
        while longest is not None and lo <= longest:
            block = ranked.where((F.col("place") >= lo) & (F.col("place") < hi)).select("key", "ord")
            window = open_.join(block, "key").where("ord < mine").join(bound, "mine", "left").where("known IS NULL OR ord < known")
            window = self._add_hits(window.select(band, "key", "mine", "ord"), number)
            if hi <= longest:
                going = ranked.where(F.col("place") >= hi).groupBy("key").agg(F.min("ord").alias("least"))
                bound = widened(bound, window.select(F.col("mine").alias("new_ord"), "ord"))
                open_ = still(open_, going, bound)
            lo, hi = hi, hi * 4

    def exact_and_copies(self, batches: list[int]) -> tuple[DataFrame, DataFrame]:
        """(new_ord, ord): each record's earliest with the same path, hash or text; (new_ord, mine): records
        whose text came earlier in their batch, and the first one with it, whose windows are theirs."""
        each = F.posexplode(F.array(*EXACT)).alias("kind", "key")
        keys = self.records(batches).select("batch", F.col("ord").alias("new_ord"), each).where("key IS NOT NULL")
        first = keys.groupBy("batch", "key").agg(F.min("new_ord").alias("mine"))
        before = self._hits(batches).where(f"kind < {BAND}").groupBy("batch", "key").agg(F.min("ord").alias("ord"))
        met = durable(keys.join(first.join(before, ["batch", "key"], "left"), ["batch", "key"]).select("new_ord", "kind", "mine", "ord"), "met")
        exact = met.select("new_ord", F.least("ord", "mine").alias("ord")).where("ord < new_ord").groupBy("new_ord").agg(F.min("ord").alias("ord"))
        return exact, met.where("kind = 2 AND mine < new_ord").select("new_ord", "mine")

    def windows(self, batches: list[int]) -> DataFrame:
        """(new_ord, ord, exact) of admitted batches: the earliest record with the same path, hash or text (exact),
        and the records that share a band. Of records with one text, the batch's first stands for all."""
        exact, _ = self.exact_and_copies(batches)
        near = self._hits(batches).where(f"kind = {BAND}").select(F.col("mine").alias("new_ord"), "ord").distinct()
        return exact.withColumn("exact", F.lit(True)).unionByName(near.withColumn("exact", F.lit(False)))

    def repeats(self, batches: list[int], raw: DataFrame) -> DataFrame:
        """(id, earliest) of admitted batches: each record that repeats an earlier one, and the earliest it
        repeats. Texts are read of pairs alone, from `raw` (id, raw)."""
        exact, copies = self.exact_and_copies(batches)
        near = self._hits(batches).where(f"kind = {BAND}").select(F.col("mine").alias("new_ord"), "ord").distinct()
        # what all records of one text know already ends the comparisons of the one that stands for them
        others = copies.join(exact, "new_ord").groupBy("mine").agg(F.max("ord").alias("others")).withColumnRenamed("mine", "new_ord")
        known = exact.withColumnRenamed("ord", "known").join(others, "new_ord", "left").select("new_ord", F.greatest("known", "others").alias("known"))
        near = near.join(known, "new_ord", "left").where("known IS NULL OR ord < known").select("new_ord", "ord")
        maybe = durable(estimated(near, self.records()).where(F.col("alike") >= MAYBE).select("new_ord", "ord"), "maybe")
        alike = exact_similarity(maybe, self.records().select("ord", "id"), raw).where(F.col("alike") >= LEAST_SIMILARITY)
        alike = durable(alike.groupBy("new_ord").agg(F.min("ord").alias("ord")), "alike")
        theirs = copies.join(alike.withColumnRenamed("new_ord", "mine"), "mine").select("new_ord", "ord")
        first = exact.unionByName(alike).unionByName(theirs).groupBy("new_ord").agg(F.min("ord").alias("ord"))
        ids = self.records(batches).select(F.col("ord").alias("new_ord"), "id")
        return first.join(ids, "new_ord").join(self.records().select("ord", F.col("id").alias("earliest")), "ord").select("id", "earliest")


def _ranked(rows: DataFrame) -> DataFrame:
    """Adds `place` to (key, ord): its rank within its key, in one part of a range-partitioned sort, of which
    a crowded key has several."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, seen = None, 0
        for batch in batches:
            if not len(batch):
                continue
            key = batch["key"].to_numpy()
            new = np.ones(len(batch), dtype=bool)
            new[1:] = key[1:] != key[:-1]
            new[0] = key[0] != last
            at = np.arange(len(batch))
            batch["place"] = (at - np.maximum.accumulate(np.where(new, at, -seen))).astype(np.int32)
            last, seen = key[-1], int(batch["place"].iloc[-1]) + 1
            yield batch

    return rows.repartitionByRange("key", "ord").sortWithinPartitions("key", "ord").mapInPandas(place, "key bigint, ord bigint, place int")


def in_order(pages: DataFrame, time: str, *ties: str, base: int = 0) -> DataFrame:
    """Pages of distinct ids with `ord` instead of time and ties, a number of its own for each, from `base` on: by
    time, null first, then by the ties and the id. The numbers rise along a range-partitioned sort, so
    none of its parts needs to know the others."""
    number = F.monotonically_increasing_id() + F.lit(base)
    kept = [c for c in pages.columns if c not in (time, *ties)]
    # the number belongs to this one sort: it is written before anything else reads it
    return durable(pages.orderBy(time, *ties, "id").select(*kept, number.alias("ord")), "ordered")


#: Where the history's numbers begin: all deliveries come after it.
HISTORY = -(1 << 62)


def exact_similarity(pairs: DataFrame, names: DataFrame, raw: DataFrame) -> DataFrame:
    """Adds `alike`, the share of common shingles, to pairs (new_ord, ord). Only texts of the pairs are
    read: shingles are made once a text, then joined to its pairs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"ord": b["ord"], "shingles": [shingles(page_body(x).strip()).view(np.int32) for x in b["raw"]]})

    wanted = durable(names.join(pairs.select(F.explode(F.array("new_ord", "ord")).alias("ord")).distinct(), "ord", "left_semi"), "wanted")
    # ids and numbers only, and counted: texts then stay where they are read; beyond the bound they shuffle
    few = wanted.count() <= BROADCAST_ROWS
    texts = raw.where("raw IS NOT NULL").join(F.broadcast(wanted) if few else wanted, "id").select("ord", "raw")
    made = texts.mapInPandas(run, "ord bigint, shingles array<int>")
    both = pairs.join(made.select(F.col("ord").alias("new_ord"), F.col("shingles").alias("mine")), "new_ord")
    both = both.join(made.select("ord", F.col("shingles").alias("theirs")), "ord")
    common = F.size(F.array_intersect("mine", "theirs"))
    return both.select("new_ord", "ord", (common / (F.size("mine") + F.size("theirs") - common)).alias("alike"))


def one_text(raw_pages: DataFrame) -> DataFrame:
    """TEXTS of pages, one for each id: of an id with several texts the least one."""
    texts = durable(text_features(raw_pages), "texts")
    if not texts.groupBy("id").count().where("count > 1").isEmpty():
        texts = texts.groupBy("id").agg(F.min(F.struct("text", "low")).alias("t")).select("id", "t.*")
    return texts


def _page(digest) -> list[Column]:
    return [page_path(F.col("repositoryPath")).alias("path"), digest(F.col("contentHash")).alias("digest")]


def accept_history(index: NeighbourhoodIndex, sources: DataFrame, texts: DataFrame, digest) -> None:
    """Fills a new index with `sources`; a page that comes twice counts from its first ingestion."""
    history = sources.where("id IS NOT NULL").select("id", *_page(digest), F.unix_micros(F.col("ingestedAt").cast("timestamp")).alias("time"))
    history = history.groupBy("id").agg(F.min(F.struct("time", "path", "digest")).alias("r")).select("id", "r.*")
    index.admit(page_features(in_order(history, "time", base=HISTORY), texts), match=False)


def take(index: NeighbourhoodIndex, deliveries: DataFrame, texts: DataFrame, digest, admissions: int | None = None) -> list[int]:
    """Admits deliveries batch by batch, in `admissions` steps or one for each batch, and gives the numbers of
    the steps. A step has all deliveries up to the next batch's first, also where batches overlap in time."""
    coming = deliveries.where("id IS NOT NULL").select("id", *_page(digest), F.unix_micros(F.col("arrivedAt").cast("timestamp")).alias("time"), "batchNo")
    coming = coming.groupBy("id").agg(F.min(F.struct("time", "batchNo", "path", "digest")).alias("r")).select("id", "r.*")
    coming = in_order(coming.withColumn("batch", F.col("batchNo")), "time", "batchNo", base=index.next)
    # a row for each batch
    rows = coming.groupBy("batch").agg(F.min("ord").alias("lo"), F.max("ord").alias("hi")).collect()
    firsts = sorted(r.lo for r in rows)
    index.next = max([index.next, *[r.hi + 1 for r in rows]])
    starts, steps = firsts[:: -(-len(firsts) // max(1, admissions or len(firsts))) or 1], []
    for start, end in zip(starts, [*starts[1:], None]):
        those = F.col("ord") >= start if end is None else (F.col("ord") >= start) & (F.col("ord") < end)
        steps.append(index.add(page_features(coming.where(those), texts)))
    return steps


def repeated_deliveries(sources: DataFrame, deliveries: DataFrame, raw_pages: DataFrame, digest, admissions: int | None = None) -> DataFrame:
    """(id, earliest): every delivery that repeats a page accepted before it, and the earliest such page.

    History is `sources` (a page that comes twice counts from its first ingestion), then all earlier
    deliveries by `arrivedAt`. A page repeats another if the path or the hash is the same in any
    spelling, or the text is the same or keeps most of it (LEAST_SIMILARITY). Null paths, hashes, texts
    match nothing; a page without a time comes first of its kind; at one time, batches then ids decide; empty
    tables give no rows. Batches are admitted one by one, or in `admissions` steps with the same result.
    The index made here is taken away again; to keep one, use accept_history(), take() and repeats().
    """
    spark = sources.sparkSession
    texts = one_text(raw_pages)
    index = NeighbourhoodIndex(spark, scratch(spark, "index"))
    accept_history(index, sources, texts, digest)
    steps = take(index, deliveries, texts, digest, admissions)
    if not steps:
        found = spark.createDataFrame([], "id string, earliest string")
    else:
        found = durable(index.repeats(steps, raw_pages.select("id", "raw")), "repeated")
    index.close(delete=True)
    return found
