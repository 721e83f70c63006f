"""Token ids of whole texts under a public byte-level BPE vocabulary, without running merges.

Every text is cut by the vocabulary's pre-token pattern; a pre-token's bytes are read as Latin-1, so
that an Aho-Corasick automaton over the vocabulary (pyahocorasick) walks them as characters. The
automaton's leftmost longest matches are a first encoding. It is the exact one if no two neighbours
would have merged across their border, which a memo of adjacent-token compatibility answers; else
the encoder backtracks from longest matches to shorter prefixes. Work is linear in the text, as a
border that failed once is never tried again.
"""

import base64
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The pre-token pattern and the file of the vocabulary byte_bpe_50k.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Entries of the pre-token cache and of the memo before they are emptied; only speed depends on them.
CACHE_ENTRIES = 200_000
MEMO_ENTRIES = 2_000_000


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a .tiktoken file, by rank."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens = [b""] * len(pairs)
    for text, rank in pairs:
        tokens[int(rank)] = base64.b64decode(text)
    return tokens


def last_merges(tokens: list[bytes]) -> tuple[array, array]:
    """For each token the two tokens whose merge makes it; a single byte has itself twice.

    Tokens are visited by rank, so a token's parts are known before it: its own encoding with all
    lower ranks is what the merge of its rank joins.
    """
    rank = {t: i for i, t in enumerate(tokens)}
    left, right = array("i", range(len(tokens))), array("i", range(len(tokens)))
    for i, whole in enumerate(tokens):
        if len(whole) < 2:
            continue
        parts = [bytes([b]) for b in whole]
        while len(parts) > 2:
            best, at = min((rank.get(parts[k] + parts[k + 1], i), k) for k in range(len(parts) - 1))
            if best >= i:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            left[i], right[i] = rank[parts[0]], rank[parts[1]]
    return left, right


class Encoder:
    """Exact ids of texts for one vocabulary. `tokens` by rank, `left` and `right` of last_merges()."""

    def __init__(self, tokens: list[bytes], left: array, right: array, pattern: str = PATTERN):
        import ahocorasick
        import regex

        self.tokens, self.left, self.right = tokens, left, right
        self.ids = {t.decode("latin-1"): i for i, t in enumerate(tokens)}
        self.merged = {(left[i], right[i]): i for i, t in enumerate(tokens) if left[i] != i}
        self.longest = max(map(len, tokens))
        self.automaton = ahocorasick.Automaton()
        for text, i in self.ids.items():
            self.automaton.add_word(text, i)
        self.automaton.make_automaton()
        self.find = regex.compile(pattern).findall
        self.cache: dict[str, tuple[int, ...]] = {}
        self.memo: dict[int, bool] = {}

    def fits(self, a: int, b: int) -> bool:
        """Whether tokens a and b can stand side by side: no merge crosses their border before both
        are complete. The later-made of the two is undone step by step towards the border."""
        key = a << 20 | b
        known = self.memo.get(key)
        if known is not None:
            return known
        if len(self.memo) >= MEMO_ENTRIES:
            self.memo.clear()
        self.memo[key] = found = self._fits(a, b)
        return found

    def _fits(self, a: int, b: int) -> bool:
        merged, left, right = self.merged, self.left, self.right
        # a merge made of the parts at the border wins if it comes before the step that was undone last
        undone = len(self.tokens)
        while True:
            joint = merged.get((a, b))
            if joint is not None and joint < undone:
                return False
            split_a, split_b = right[a] != a, left[b] != b
            if split_a and (a > b or not split_b):
                undone, a = a, right[a]
            elif split_b:
                undone, b = b + 1, left[b]
            else:
                return True

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        cache, ids = self.cache, self.ids
        for piece in self.find(text):
            known = cache.get(piece)
            if known is None:
                known = self._piece(piece.encode("utf-8").decode("latin-1"))
                if len(piece) <= 48:
                    if len(cache) >= CACHE_ENTRIES:
                        cache.clear()
                    cache[piece] = known
            out.extend(known)
        return out

    def _piece(self, text: str) -> tuple[int, ...]:
        whole = self.ids.get(text)
        if whole is not None:
            return (whole,)
        greedy = [i for _, i in self.automaton.iter_long(text)]
        memo, a = self.memo, greedy[0]
        for b in greedy[1:]:
            ok = memo.get(a << 20 | b)
            if ok is None:
                ok = self.fits(a, b)
            if not ok:
                return self._backtrack(text)
            a = b
        return tuple(greedy)

    def _match(self, text: str, pos: int) -> int:
        """The longest token that starts at pos."""
        near = text[pos : pos + self.longest]
        for n in range(self.automaton.longest_prefix(near), 0, -1):
            found = self.ids.get(near[:n])
            if found is not None:
                return found
        raise ValueError("the vocabulary lacks a byte")

    def _shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of this one, or -1."""
        text = self.tokens[token].decode("latin-1")
        for n in range(len(text) - 1, 0, -1):
            found = self.ids.get(text[:n])
            if found is not None:
                return found
        return -1

    def _backtrack(self, text: str) -> tuple[int, ...]:
        end, out, pos = len(text), [], 0
        open_border = bytearray(b"\1") * (end + 1)
        token = self._match(text, 0)
        while True:
            last = out[-1] if out else -1
            while token >= 0:
                to = pos + len(self.tokens[token])
                if open_border[to] and (last < 0 or self.fits(last, token)):
                    break
                token = self._shorter(token)
            if token < 0:  # no token leads on from here: this border is closed for good
                open_border[pos] = 0
                token = out.pop()
                pos -= len(self.tokens[token])
                continue
            out.append(token)
            pos = to
            if pos == end:
                return tuple(out)
            token = self._match(text, pos)


_encoders: dict[str, Encoder] = {}


def encode_column(texts: DataFrame, text: str, output: str, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """Adds `output`, the ids of `text` without special tokens.

    Null and empty text give an empty list; strings that spell a special token are ordinary text.
    Whole texts are encoded, however long; repeated rows are encoded one by one. Other columns pass
    through; one that has the output's name is replaced. The vocabulary is read by the driver and
    broadcast: a fixed file (50,256 tokens, about 1 MB with its merges).
    """
    tokens = read_ranks(vocabulary)
    shared = texts.sparkSession.sparkContext.broadcast((tokens, *last_merges(tokens)))
    name = f"{vocabulary}\0{pattern}"

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoders.get(name)
        if encoder is None:
            encoder = _encoders[name] = Encoder(*shared.value, pattern=pattern)
        for batch in batches:
            yield pd.Series([encoder.encode(t) if t else [] for t in batch])

    return texts.withColumn(output, ids(F.col(text)))
