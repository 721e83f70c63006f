"""Template residue, filler, error pages and script notices in place of an article.

A naive Bayes model is learned from positive and unlabelled data by expectation-maximization: passages that
a short list of patterns marks as error or placeholder text are trusted, all others start as unlabelled.
Every round is one pass over whole texts that emits mergeable expected counts of fixed size. The model
has three parts: hashed character n-grams of a passage; the form of its record, which is how much its
n-grams repeat at its length; and, for a slot, whether it stands in quotation marks and whether its passage
reports on such marks. While learning, n-grams and form teach each other, so that filler of unknown words
is found by its form first and by its words afterwards. Passages are then scored and record decisions
aggregated: a record is residue if nearly all its own content is, or if one of its slots is left open.
Patterns decide nothing by themselves: they say what is trusted and where a slot is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hash buckets of the model; its broadcast has this many floats (1 MB), whatever the corpus.
BUCKETS = 1 << 17
#: Passes of learning; with one more, the records found change by less than one in a thousand.
ROUNDS = 2
#: Prior odds that a passage is residue; pull of a class towards the whole corpus, as a part of its
#: own counts; how many n-grams of evidence count.
PRIOR, PULL, EVIDENCE = 0.02, 0.1, 24.0
#: Part of a record's own content that must be residue.
RECORD_SHARE = 0.7
#: Forms of a record: 2 scripts times 8 sizes from 16 words on, doubling, times 5 parts of distinct words with these
#: bounds; one for smaller records. Words are Latin words and pairs of Han characters.
PARTS = (0.35, 0.5, 0.65, 0.8)
FORMS = 16 * (len(PARTS) + 1) + 1
#: Form teaches n-grams only where it is this sure.
SURE_FORM = 0.9
#: Kinds of slots: in quotation marks or not, in a passage that reports on such marks or not.
SLOTS = 4
WIDTH = BUCKETS + FORMS + SLOTS + 1

# The ways a template marks a slot.
SLOT = re.compile(
    r"\{\{[^{}\n]*\}\}|\$\{[^{}\n]*\}|#\{[^{}\n]*\}|<%[^%\n]*%>|\{%[^%\n]*%\}|%\(\w+\)[sd]|@@\w+@@|<<\s*\w+\s*>>|«\s*\w+\s*»"
    r"|(?<![A-Za-z0-9_])__[A-Z_]+__(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])_{4,}(?![A-Za-z0-9_])|\$[A-Z][A-Z_]+\$|\{\d+\}|\{[一-鿿]{1,8}\}|\[(?:请输入|待补|待填|此处)[^\[\]\n]*\]|\[(?:INSERT|insert|your|YOUR|enter|ENTER)\b[^\[\]\n]*\]"
    r"|\[[^\[\]\n]*goes here\]|【(?:此处|请填|请输入|待补|待填)[^【】\n]*】|〔(?:标题|正文|作者|日期|摘要|地点|姓名|编辑|栏目|图注)[^〔〕\n]*〕|（[^（）\n]*(?:请补充|待补充|待填)[^（）\n]*）"
    r"|[XＸ]月[XＸ]日|(?<![A-Za-z0-9XＸ×])[XＸ×]{2,}(?=[一-鿿，。：]|$)|(?<=[一-鿿])[XＸ×]{2,}(?![A-Za-z0-9XＸ×])|\bTK\b(?=\s+\w)|\b(?:TODO|TBD|FIXME)\b"
)
# Trusted error, notice and filler texts. A match makes a passage a trusted positive.
TRUSTED = re.compile(
    r"(?i)^(?:error[: ]*)?[45][0-9][0-9]\b.{0,40}$|internal server error|bad gateway|service (?:temporarily )?unavailable|gateway time-?out|(?:page|file|resource|record)\b.{0,20}\bnot found|access denied|error establishing|not found on this server|^\w+(?:Error|Exception): |you are looking for (?:has|was|does|could|is|no)|no longer (?:available|exists)|scripts? to (?:continue|view|read|load)|^(?:nan|null|undefined|none|\[object object\])$"
    r"|(?:you do not|don't) have permission|session (?:has )?expired|too many requests|enable javascript (?:to|and)|javascript (?:is|has been|must be) (?:disabled|switched off|turned off|required|enabled)"
    r"|\b(?:scripts?|scripting|js|cookies) (?:is|are) (?:switched|turned) off|\ballow javascript to|^traceback \(|^file [\"“].*[\"”], line \d|^at [\w.$]+\([\w.]+:\d+\)$|^(?:\w+\.)+\w+(?:error|exception)\b|^warning: undefined|down for maintenance|lorem ipsum dolor|(?:sample|placeholder|dummy|filler) (?:text|copy|paragraph)\b.{0,60}(?:replace|here|layout)"
    r"|(?:需要|请先?)(?:启用|允许|打开|开启)(?:javascript|js|脚本)|系统繁忙|正在为您跳转|已下线，|服务器内部错误|页面不存在|内容不存在|无法找到|找不到(?:页面|资源|文件)|网关超时|数据库连接失败|加载失败|参数错误|会话已过期|没有权限(?:查看|访问)|访问过于频繁|请稍后(?:再试|重试)|出错了"
    r"|(?:禁用|关闭|不支持|未启用)了?(?:javascript|脚本|JS)|(?:启用|打开|开启|允许)(?:javascript|JS)与|脚本被关闭|占位(?:文本|段落|内容|文字)，|示例(?:段落|文字|内容|文本)，用来占据|请勿发布|工程师正在抢修|仅供排版"
)
# Every match of TRUSTED within a line has one of these in lower case (but for status lines).
ANCHORS = (
    "server error gateway unavailable found denied permission expired requests script cookies lorem sample placeholder dummy filler looking "
    "longer establishing error exception traceback warning maintenance nan null undefined none object (most .py .java 系统繁忙 跳转 下线 服务器 不存在 "
    "找 超时 连接失败 加载失败 参数错误 会话 权限 频繁 稍后 出错 抢修 禁用 关闭 不支持 未启用 js 脚本 占位 示例 请勿发布 排版"
).split()
#: A record of this many words or more that has this many different ones at most, each at least twice on average, is
#: trusted to be filler.
FILLER_WORDS, FILLER_DISTINCT = 16, 30
_DIGITS = re.compile(r"\d+")
_SLOT_START = re.compile(r"[{$#<%@«_\[【〔（XＸ×]|TK|T[OB]D|FIX")
# Site navigation and footers, which are no content.
NAVIGATION = re.compile(
    r"(?i)^(?:©.*|如问题持续.*|如有疑问.*|请求编号[\s:：].*|错误代码[:：].*|追踪编号.*|request (?:id|no|number)\b.*|(?:reference|ref|trace|incident)(?: id)?\s*[#:].*|if (?:the|this) (?:problem|issue|error) (?:persists|continues).*|(?:nginx|apache|gateway|cloudflare)/?[\d.]*|copyright\b.*|all rights reserved.*|menu|skip to (?:main )?content|返回(?:首页|顶部)|上一[篇页].*|下一[篇页].*|版权所有.*|(?:[\w一-鿿]{1,12}\s*[|>›»/·]\s*)+[\w一-鿿]{1,12}"
    r"|(?:首页|登录|注册|搜索|导航|联系我们|关于我们|订阅|home|news|contact|about|login|sign ?in|register|search|subscribe)(?:[\s|>/·]+(?:首页|登录|注册|搜索|导航|联系我们|关于我们|订阅|栏目|正文|home|news|contact|about|login|sign ?in|register|search|subscribe))*)$"
)
# Words with which a text reports on, quotes or explains such marks.
REPORTED = re.compile(r"(?i)\b(?:such as|called|named|tags?|placeholders?|template|variable|written|reads?|joke|typed)\b|表示待替换|写着|所谓|变量|占位符|模板|原文|示例中|讲义|字样")
QUOTES = re.compile(r"“[^”\n]*”|‘[^’\n]*’|\"[^\"\n]*\"|「[^」\n]*」|『[^』\n]*』|`[^`\n]+`")
FENCE = re.compile(r"```.*?(?:```|\Z)|(?m:^(?: {4}|\t).*$)", re.S)
_FENCE_START = re.compile(r"```|(?m:^(?: {4}|\t))")
BREAK = re.compile(r"(?<=[。！？])|(?<=[.!?])\s+|\n")


@cache
def _powers() -> tuple[int, int, int]:
    return 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9  # odd 64-bit multipliers


def features(parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, passage) of every character trigram of the passages, of bigrams of Han script and runs of five of
    other scripts, which say less in a character; and (hash, passage) of their words, all in one go. Slots are dropped and digits become one digit, so that a form counts and not its
    filling."""
    text = "\n".join(SLOT.sub("", p) if _SLOT_START.search(p) else p for p in parts) + "\n\n"
    cp = np.frombuffer(_DIGITS.sub("0", text.lower() + "\n\n\n").encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
    end = cp == 10
    owner = np.cumsum(end)
    a, b, c = (np.uint64(x) for x in _powers())
    with np.errstate(over="ignore"):
        two = cp[:-4] * a + cp[1:-3] * b
        three = two * c + cp[2:-2]
        five = (three * a + cp[3:-1]) * c + cp[4:]
        han = (cp >= 0x3400) & (cp <= 0x9FFF)
        other = cp < 0x2E80
        keep = [han[:-4] & han[1:-3], ~(end[:-4] | end[1:-3] | end[2:-2])]
        keep.append(keep[1] & other[:-4] & other[1:-3] & other[2:-2] & other[3:-1] & other[4:] & ~(end[3:-1] | end[4:]))
        mixed = np.concatenate([x[k] for x, k in zip((two, three, five), keep)])
        mixed ^= mixed >> np.uint64(31)
        mixed *= a
    owners = np.concatenate([owner[:-4][k] for k in keep])
    pair = keep[0]
    latin = (cp >= 97) & (cp <= 122)
    start = np.flatnonzero(latin & ~np.append(False, latin[:-1]))
    words, whose = two[pair], owner[:-4][pair]
    if len(start):
        step = np.arange(len(cp) - start[0]) - np.repeat(start - start[0], np.diff(np.append(start, len(cp))))
        with np.errstate(over="ignore"):
            letters = np.where(latin, cp, np.uint64(0))[start[0] :] * (step.astype(np.uint64) * b + c)
            sums = np.add.reduceat(letters, start - start[0])
        words, whose = np.append(words, sums), np.append(whose, owner[start])
    # the last bit says the script
    words = (words * a) >> np.uint64(25) << np.uint64(1) | (np.arange(len(words)) < pair.sum()).astype(np.uint64)
    return (mixed >> np.uint64(47)).astype(np.int64) % BUCKETS, owners, words, whose


def passages(text: str) -> list[str]:
    """The record's own content in passages: lines and sentences without code, quotations, navigation
    and footers."""
    own = FENCE.sub("\n", text) if _FENCE_START.search(text) else text
    parts = (p.strip() for line in own.split("\n") for p in BREAK.split(QUOTES.sub("“”", line)))
    return [p for p in parts if p and not NAVIGATION.match(p)]


def slots_of(text: str, parts: list[str]) -> tuple[list[int], list[int]]:
    """The slots of a record by SLOTS: the passage of each, or -1 for one in quotation marks, and its kind."""
    if not _SLOT_START.search(text) or not SLOT.search(text):
        return [], []
    place, kind = [], []
    for at, part in enumerate(parts):
        if _SLOT_START.search(part) and (found := len(SLOT.findall(part))):
            # two slots side by side are not reported on
            reported = found < 2 and bool(REPORTED.search(part))
            place += [at] * found
            kind += [int(reported)] * found
    own = FENCE.sub("\n", text) if _FENCE_START.search(text) else text
    for line in own.split("\n"):
        quoted = sum(len(SLOT.findall(q)) for q in QUOTES.findall(line))
        place += [-1] * quoted
        kind += [2 + bool(REPORTED.search(line))] * quoted
    return place, kind


@cache
def _anchors():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for word in ANCHORS:
        automaton.add_word(word, word)
    automaton.make_automaton()
    return automaton


def trusted(passage: str) -> bool:
    """Whether a passage, apart from its slots, is known to be residue."""
    return (passage[0] in "45" or next(_anchors().iter(passage.lower()), None) is not None) and bool(TRUSTED.search(passage))


def _sure(parts: list[str], place: list[int]) -> list[bool]:
    """Which passages are trusted: those that match or have two slots, if they make up half of the record's
    content; one such sentence of a longer article is not trusted."""
    flags = [trusted(p) for p in parts]
    for at in {p for p in place if p >= 0 and place.count(p) >= 2}:
        flags[at] = True
    if not any(flags):
        return flags
    share = sum(len(p) for p, f in zip(parts, flags) if f)
    return flags if 2 * share >= sum(map(len, parts)) else [False] * len(parts)


class Model:
    """Log-odds of n-gram buckets, of forms, and of slots with their prior."""

    def __init__(self, table: np.ndarray):
        """`table` has the expected counts of both classes, of each kind of thing side by side."""
        gram, form, slot = table[:, :BUCKETS], table[:, BUCKETS : BUCKETS + FORMS], table[:, BUCKETS + FORMS : -1]
        self.gram = _log_odds(gram)
        # among records of one script and size, so that a short record is no sign in itself
        self.form = np.append(np.concatenate([_log_odds(x) for x in np.split(form[:, :-1], 16, axis=1)]), 0.0)
        # quoted or not and reported or not are told apart on their own; half a slot more of each
        both = slot.reshape(2, 2, 2) + 0.125
        odds = lambda x: np.log(x[1]) - np.log(x[0])
        prior, quoted, reported = odds(both.sum(axis=(1, 2))), both.sum(axis=2), both.sum(axis=1)
        odd_q, odd_r = (odds(x / x.sum(axis=1, keepdims=True)) for x in (quoted, reported))
        self.slot = np.array([prior + odd_q[k >> 1] + odd_r[k & 1] for k in range(SLOTS)])


def _log_odds(counts: np.ndarray) -> np.ndarray:
    """Either class is pulled towards the corpus as a whole, so that what is rare says no more for the small
    class than what is frequent does."""
    corpus = counts.sum(axis=0) / max(1.0, counts.sum())
    size = np.maximum(counts.sum(axis=1, keepdims=True), 1.0)
    chance = (counts + PULL * size * corpus) / (size * (1 + PULL))
    odds = np.zeros(counts.shape[1])
    seen = corpus > 0
    odds[seen] = np.log(chance[1, seen]) - np.log(chance[0, seen])
    return odds


def _chance(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


class Chunk:
    """Some whole records as passages, their n-grams, forms and slots."""

    def __init__(self, texts: list[str]):
        self.parts: list[str] = []
        self.sure: list[bool] = []
        slot_part, slot_kind, slot_record, record = [], [], [], []
        for at, text in enumerate(texts):
            own = passages(text)
            place, kind = slots_of(text, own)
            slot_part += [len(self.parts) + p if p >= 0 else -1 for p in place]
            slot_kind += kind
            slot_record += [at] * len(kind)
            record += [at] * len(own)
            self.parts += own
            self.sure += _sure(own, place)
        self.records = len(texts)
        self.record = np.array(record, dtype=np.int64)
        self.slot_part, self.slot_kind, self.slot_record = (np.array(x, dtype=np.int64) for x in (slot_part, slot_kind, slot_record))
        self.size = np.fromiter(map(len, self.parts), dtype=np.int64, count=len(self.parts))
        none = np.empty(0, np.int64)
        self.bucket, self.owner, words, whose = features(self.parts) if self.parts else (none, none, none.view(np.uint64), none)
        # of each record, how many words it has and how many different ones
        whose = self.record[whose].astype(np.uint64)
        pairs = np.sort((whose << np.uint64(40)) | (words & np.uint64((1 << 40) - 1)))
        first = pairs[np.append(True, pairs[1:] != pairs[:-1])] if len(pairs) else pairs
        total, distinct = (np.bincount((x >> np.uint64(40)).astype(np.int64), minlength=self.records) for x in (pairs, first))
        han = np.bincount((pairs[pairs & np.uint64(1) == 1] >> np.uint64(40)).astype(np.int64), minlength=self.records)
        length = np.clip(np.log2(np.maximum(total, 1)).astype(np.int64) - 4, 0, 7) + 8 * (2 * han > total)
        part = np.searchsorted(PARTS, distinct / np.maximum(total, 1), side="right")
        filler = (total >= FILLER_WORDS) & (distinct <= FILLER_DISTINCT) & (2 * distinct <= total)
        self.sure = np.array(self.sure, dtype=bool) | filler[self.record]
        self.form = np.where(total < 16, FORMS - 1, length * (len(PARTS) + 1) + part)

    def grams(self, model: Model) -> np.ndarray:
        """Evidence of each passage's n-grams. Overlapping ones are not independent: long passages count as
        EVIDENCE n-grams at most."""
        n = len(self.parts)
        size = np.bincount(self.owner, minlength=n)[:n]
        total = np.bincount(self.owner, weights=model.gram[self.bucket], minlength=n)[:n]
        return total * np.minimum(1.0, EVIDENCE / np.maximum(size, 1))

    def add_to(self, table: np.ndarray, model: Model | None) -> None:
        """Adds the expected counts of both classes. What is trusted stays so; of n-grams and form, the surer
        one counts."""
        if not self.parts:
            return
        sure, prior = self.sure, np.log(PRIOR / (1 - PRIOR))
        y, z = np.zeros(len(self.parts)), np.zeros(len(self.slot_kind))
        if model is not None:
            form = _chance(prior + model.form[self.form[self.record]])
            y = np.maximum(_chance(prior + self.grams(model)), np.where(form >= SURE_FORM, form, 0.0))
            z = _chance(model.slot[self.slot_kind])
        y[sure] = 1.0
        z[(self.slot_part >= 0) & sure[self.slot_part]] = 1.0
        # a record's form counts by the share of its content that is residue
        size = np.maximum(np.bincount(self.record, weights=self.size, minlength=self.records), 1)
        share = np.bincount(self.record, weights=self.size * y, minlength=self.records) / size
        some = np.bincount(self.record, minlength=self.records) > 0
        for row, of_part, of_record, of_slot in ((1, y, share, z), (0, 1 - y, 1 - share, 1 - z)):
            table[row, :BUCKETS] += np.bincount(self.bucket, weights=of_part[self.owner], minlength=BUCKETS)
            table[row, BUCKETS : BUCKETS + FORMS] += np.bincount(self.form[some], weights=of_record[some], minlength=FORMS)
            table[row, BUCKETS + FORMS : -1] += np.bincount(self.slot_kind, weights=of_slot, minlength=SLOTS)
            table[row, -1] += of_part.sum()

    def judge(self, model: Model) -> tuple[np.ndarray, np.ndarray]:
        """Of each record the part of its content that is residue, by n-grams and form together, and its open slots."""
        if not self.parts:
            return np.zeros(self.records), np.zeros(self.records, dtype=np.int32)
        bad = np.log(PRIOR / (1 - PRIOR)) + self.grams(model) + model.form[self.form[self.record]] >= 0
        size = np.maximum(np.bincount(self.record, weights=self.size, minlength=self.records), 1)
        open_ = model.slot[self.slot_kind] >= 0
        return np.bincount(self.record, weights=self.size * bad, minlength=self.records) / size, np.bincount(self.slot_record[open_], minlength=self.records).astype(np.int32)


#: Records that are worked on at once.
CHUNK = 128


def fit(texts: DataFrame, rounds: int = ROUNDS):
    """The broadcast model after `rounds` passes over all texts. A pass gives one fixed-size state per task; only
    states shuffle, and WIDTH rows at most reach the driver."""
    context, model = texts.sparkSession.sparkContext, None
    for _ in range(rounds):

        def count(batches: Iterator[pd.DataFrame], model=model) -> Iterator[pd.DataFrame]:
            table = np.zeros((2, WIDTH))
            for batch in batches:
                texts = batch["text"].tolist()
                for at in range(0, len(texts), CHUNK):
                    Chunk(texts[at : at + CHUNK]).add_to(table, model and model.value)
            kept = np.flatnonzero(table.sum(axis=0))
            yield pd.DataFrame({"bucket": kept, "other": table[0, kept], "residue": table[1, kept]})

        states = texts.mapInPandas(count, "bucket bigint, other double, residue double")
        rows = states.groupBy("bucket").agg(F.sum("other").alias("other"), F.sum("residue").alias("residue")).toPandas()
        table = np.zeros((2, WIDTH))
        table[0, rows["bucket"]], table[1, rows["bucket"]] = rows["other"], rows["residue"]
        model = context.broadcast(Model(table))
    return model


def scores(documents: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, share, slots) of every record with text. See residue() for the decision."""
    texts = documents.select("doc_id", "text").where("doc_id IS NOT NULL AND trim(text) <> ''")
    model = fit(texts, rounds)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), CHUNK):
                part = batch.iloc[at : at + CHUNK]
                share, slots = Chunk(part["text"].tolist()).judge(model.value)
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "share": share, "slots": slots})

    return texts.mapInPandas(run, "doc_id bigint, share double, slots int")


def residue(documents: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id) of the records to exclude, each once.

    Null, empty and blank texts are no cases, nor are texts of navigation only. Whole texts are read.
    Repeated rows of a record give one row.
    """
    return scores(documents, rounds).where(f"share >= {RECORD_SHARE} OR slots > 0").select("doc_id").distinct()
