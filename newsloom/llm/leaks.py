"""Held-out test passages inside corpus documents, fully or partly, with small changes.

One Aho-Corasick automaton holds pieces of every normalised test text. A document is normalised the
same way and scanned once; hits of one item that keep their distance form a stretch, and a local
alignment of that stretch alone measures how much of the passage stands there. Offsets are mapped
back to the original text.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.lookalike import translation

#: Characters of a piece: of Latin script and of Han script, where a character says more.
PIECE_LATIN, PIECE_HAN = 10, 5
#: Items of one automaton; more items are scanned in further blocks, each over the whole corpus.
BLOCK_ITEMS = 20_000
#: Part of a passage that must stand in a document as one stretch.
LEAST_SHARE = 0.5
#: A stretch goes to alignment when its exact pieces cover this part of the passage.
SEED_SHARE = 0.12
#: Scores of the alignment: one wrong character costs what this many right ones earn.
WRONG = 2
#: Passage characters between two pieces of one stretch.
GAP = 48


class _Fold(dict):
    """A translation table that fills itself: width and look-alike forms to one, lower case, and
    nothing for what is neither letter nor digit."""

    def __init__(self):
        super().__init__()
        self.same = dict(zip(*translation()))

    def __missing__(self, cp: int) -> str:
        ch = self.same.get(chr(cp), chr(cp))
        ch = unicodedata.normalize("NFKC", ch).casefold()
        ch = "".join(c for c in unicodedata.normalize("NFD", ch) if c.isalnum())
        self[cp] = ch
        return ch


_fold = _Fold()


def fold(text: str) -> str:
    return text.translate(_fold)


def fold_offsets(text: str) -> np.ndarray:
    """For each character of fold(text), its place in the text; one more at the end."""
    lengths = np.fromiter((len(_fold[ord(c)]) for c in text), dtype=np.int64, count=len(text))
    return np.append(np.repeat(np.arange(len(text)), lengths), len(text))


def piece_length(folded: str) -> int:
    han = sum("㐀" <= c <= "鿿" for c in folded)
    return PIECE_HAN if han * 2 > len(folded) else PIECE_LATIN


class Matcher:
    """Finds stretches of the items' passages. `items`: (item_id, passage, question). A question adds
    pieces of its own, so that it is recognised, but alone it makes no case."""

    def __init__(self, items: list[tuple[int, str, str]]):
        import ahocorasick

        self.passages: dict[int, str] = {}
        pieces: dict[str, list[tuple[int | None, int]]] = defaultdict(list)
        for item, passage, question in items:
            for kind, text in ((0, fold(passage or "")), (1, fold(question or ""))):
                k = piece_length(text)
                if kind == 0:
                    self.passages[item] = text
                if 0 < len(text) < k:
                    k = len(text)
                for at in range(len(text) - k + 1):
                    pieces[text[at : at + k]].append((item if kind == 0 else None, at))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.empty = not pieces
        if pieces:
            self.automaton.make_automaton()

    def scan(self, text: str) -> list[tuple[int, int, int, float]]:
        """(item, start, end, share) of every passage of which at least half stands in the text."""
        if self.empty or not text:
            return []
        folded = fold(text)
        hits: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for end, (k, places) in self.automaton.iter(folded):
            for item, at in places:
                if item is not None:
                    hits[item].append((end - k + 1, at, k))
        found, offsets = [], None
        for item, places in hits.items():
            passage = self.passages[item]
            best = (0.0, 0, 0)
            for lo, hi in self._stretches(places, len(passage)):
                pad = len(passage) // 2 + GAP
                a, b = max(0, lo - pad), min(len(folded), hi + pad)
                share, start, end = align(passage, folded[a:b])
                if share > best[0]:
                    best = (share, a + start, a + end)
            if best[0] >= LEAST_SHARE:
                if offsets is None:
                    offsets = fold_offsets(text)
                found.append((item, int(offsets[best[1]]), int(offsets[best[2] - 1]) + 1, round(best[0], 4)))
        return found

    @staticmethod
    def _stretches(places: list[tuple[int, int, int]], length: int) -> Iterator[tuple[int, int]]:
        """Spans of the document where pieces lie in the passage's order, close together, and cover
        enough of it to be aligned."""
        places.sort()
        open_: list[list[int]] = []  # start, end, last place in the passage, covered
        done = []
        for pos, at, k in places:
            for s in open_:
                doc_gap, own_gap = pos - s[1], at - s[2]
                if -k < doc_gap <= GAP and -k < own_gap <= GAP and abs(doc_gap - own_gap) <= 8:
                    s[3] += min(k, max(0, at + k - s[2]))
                    s[1], s[2] = max(s[1], pos + k), max(s[2], at + k)
                    break
            else:
                open_.append([pos, pos + k, at + k, k])
            if len(open_) > 64:
                done += [s for s in open_ if s[1] + GAP < pos]
                open_ = [s for s in open_ if s[1] + GAP >= pos]
        for s in done + open_:
            if s[3] >= SEED_SHARE * length:
                yield s[0], s[1]


def align(passage: str, text: str) -> tuple[float, int, int]:
    """The best local alignment: (part of the passage it spans, start and end in the text). A right
    character scores 1, a wrong, missing or additional one -WRONG, so the aligned stretch is nearly
    the passage's own. A row per passage character, vectorised along the text."""
    p = np.frombuffer(passage.encode("utf-32-le"), dtype=np.uint32)
    t = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    if not len(p) or not len(t):
        return 0.0, 0, 0
    n = len(t)
    column = np.arange(n + 1, dtype=np.int64) * WRONG
    score = np.zeros(n + 1, dtype=np.int64)
    # where the alignment that ends here began: in the passage, and in the text
    from_p, from_t = np.zeros(n + 1, dtype=np.int64), np.arange(n + 1, dtype=np.int64)
    best = (0, 0, 0, 0, 0)
    for i in range(len(p)):
        diagonal = np.empty(n + 1, dtype=np.int64)
        diagonal[0] = 0
        diagonal[1:] = score[:-1] + np.where(t == p[i], 1, -WRONG)
        up = score - WRONG
        take = diagonal >= up
        new = np.where(take, diagonal, up)
        fp = np.where(take, np.append(i, from_p[:-1]), from_p)
        ft = np.where(take, np.append(0, from_t[:-1]), from_t)
        # characters added in the text: the best cell to the left, less WRONG a step
        level = np.maximum(new, 0) + column
        source = np.maximum.accumulate(np.where(level == np.maximum.accumulate(level), np.arange(n + 1), 0))
        moved = level[source] - column
        fp, ft = np.where(moved > new, fp[source], fp), np.where(moved > new, ft[source], ft)
        new = np.maximum(moved, new)
        dead = new <= 0
        score = np.where(dead, 0, new)
        from_p = np.where(dead, i + 1, fp)
        from_t = np.where(dead, np.arange(n + 1), ft)
        at = int(score.argmax())
        if score[at] > best[0]:
            best = (int(score[at]), int(from_p[at]), i + 1, int(from_t[at]), at)
    return (best[2] - best[1]) / len(p), best[3], best[4]


SPANS = "doc_id bigint, item_id bigint, start int, end int, share double"


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, end, share): the documents that hold a connected stretch of at least
    half of an item's passage, its place in the original text and the part of the passage.

    Null, empty and blank texts and passages give nothing; a repeated row of the corpus gives its
    row again only if its doc_id differs; of an item_id with several passages the least one is looked for; whole texts are scanned. The items go to the executors in
    blocks of BLOCK_ITEMS at most, so what is broadcast has a bound and no item is left out.
    """
    wanted = items.select("item_id", "passage", "question").where("item_id IS NOT NULL AND passage IS NOT NULL")
    wanted = wanted.groupBy("item_id").agg(F.min(F.struct("passage", "question")).alias("r")).select("item_id", "r.*")
    blocks = max(1, -(-wanted.count() // BLOCK_ITEMS))
    out = None
    for b in range(blocks):
        block = wanted if blocks == 1 else wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        # bounded: BLOCK_ITEMS rows on average
        rows = [(r.item_id, r.passage, r.question) for r in block.toLocalIterator()]
        shared = documents.sparkSession.sparkContext.broadcast(rows)

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            matcher = Matcher(shared.value)
            for batch in batches:
                found = [(d, *x) for d, t in zip(batch["doc_id"], batch["text"]) if t for x in matcher.scan(t)]
                yield pd.DataFrame(found, columns=["doc_id", "item_id", "start", "end", "share"])

        part = documents.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL").mapInPandas(scan, SPANS)
        out = part if out is None else out.unionByName(part)
    # of several texts of one doc_id the largest part counts, of equal ones the first place
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("share", (-F.col("start")).alias("s"), (-F.col("end")).alias("e"))).alias("r"))
    return best.select("doc_id", "item_id", (-F.col("r.s")).alias("start"), (-F.col("r.e")).alias("end"), F.col("r.share").alias("share"))
