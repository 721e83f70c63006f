"""Subject areas of documents by distributed latent Dirichlet topic models.

A model has one topic for each subject and some background topics. The subjects' topics start from a
bounded sample of labelled texts, which fixes what each of them means; variational passes over the
whole corpus then move the topics to the corpus's own words, of which the labels cover a part. A pass
is one E-step in Arrow batches; its sufficient statistics have a fixed size (topics x buckets), are
combined per task and summed. A document's subjects are read from its topic proportions.

Topics are mapped to subjects through their top terms: `top_buckets` are those a topic has much more of than
the others, `top_terms` reads them back from the corpus for inspection, and `topic_subjects` gives a topic
the subject that the labelled texts use its top terms for; a topic whose terms tell of no subject is
background. Moved topics are thus named by what they have become, not by where they started.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.lookalike import translation
from newsloom.llm.names import FIELDS, KINDS

# The subjects, in the order of the topics.
SUBJECTS = (
    "policy_governance", "economy_business", "infrastructure_transport", "science_technology", "law_justice", "conflict_security",
    "disaster_accident", "public_health", "environment_energy", "education_culture", "society_livelihood", "international_relations",
)
#: Topics for what all subjects share: phrases, places and names.
BACKGROUND = 3
TOPICS = len(SUBJECTS) + BACKGROUND
#: Hash buckets of the n-grams: the model has TOPICS x BUCKETS floats (4 MB), whatever the corpus.
BUCKETS = 1 << 16
#: Variational passes over the corpus and the Dirichlet prior of a document. More passes drift away from the
#: labels: on held-out labels precision and recall are 0.980 and 0.990 after one, 0.970 and 0.985 after two.
PASSES, ALPHA = 1, 0.1
#: A document's inner steps end when no proportion moves by more than this.
SETTLED = 1e-3
#: N-grams whose inner steps are taken together, filled up to the longest document (1 MB of weights), and documents
#: that are read at once.
CELLS, ROWS = 1 << 14, 2048
#: Prior occurrences of an n-gram, spread over the topics by their size: a rare one, such as part of a
#: name, says little.
ETA = 2.0
#: An n-gram that no topic favours this much over the average is left out of a document's inner steps.
TELLS = 1.6
#: Weight of the labelled sample's counts beside the corpus's own, as a share of the corpus.
ANCHOR = 0.2
#: Labelled rows that are used at most; the rest adds nothing to a prior.
LABELLED = 20_000
#: Top terms of a topic, and the part of their labelled uses that one subject must have.
TOP, TELLING_PART = 200, 0.4
#: A second subject needs this part of the first one's proportion: of the whole, of a title or summary
#: that stands alone, and of title and summary each.
SECOND, SECOND_ALONE, SECOND_PART = 0.25, 0.4, 0.2

# Sentences that only say what a text is not about.
MENTIONED = re.compile(r"至于[^。！？\n]*不在[^。！？\n]*之列|不在本[条文]讨论|与本[条文]无关|本[条文]不[谈涉]|(?i:nothing was said about|not (?:discussed|covered) here|is not the subject)")
_SENTENCE = re.compile(r"(?<=[。！？])|(?<=[.!?])\s+|\n")
_FORMAT = re.compile("[\u00ad\u200b-\u200f\u2060-\u206f\ufe00-\ufe0f\ufeff]")
_DROP = re.compile(r"[\d０-９]+")


# What ends the name of a body, after which a name is not read for subjects.
_BODY = re.compile(
    r"(?:(?<=[，；：:;,。！？\s谈])|^)[^，；：:;,。！？\s谈]{2,24}?(?:股份有限公司|有限公司|公司|集团|管理委员会|管委会|委员会|行业协会|协会|基金会|研究院|第.分院)"
    r"|\b(?:[A-Z][\w.'-]+,? (?:of )?){2,}(?:[A-Z][\w.'-]+)|\b[A-Z][\w'-]+ [A-Z][\w.'-]*(?=[:,])"
)
# What a text with the name of a body holds, in lower case, to look for before names.
_NAMES = re.compile("公司|集团|委员会|管委会|协会|基金会|研究院|研究所|分院|company|corp|group|committee|association|foundation|institute|limited")


def _bodies() -> re.Pattern:
    """Names of bodies in running text. A name has no mark where it begins there: it is taken from its field
    on, or from four characters before its kind at most, so that the rest of the clause stays."""
    inside = r"[^\s，；：:;,。！？、“”\"'‘’（）()谈的了在与和由对向为被从将及等是把给]"
    kind = "股份有限公司|集团有限公司|有限公司|集团公司|公司|集团|管理委员会|管委会|委员会|行业协会|协会|基金会|研究院|研究所|第.分院"
    long = "|".join(f[0] for f in FIELDS.values() if len(f[0]) > 2)
    fields = "|".join(sorted({x for f in FIELDS.values() for x in (f[2], *f[3].split())}, key=len, reverse=True))
    kinds = "|".join(sorted({*(k[2] for k in KINDS.values()), "company limited", "company", "group", "committee", "association", "institute", "corp"}, key=len, reverse=True))
    capital, titled = r"[A-Z][\w.'-]*", kinds.title()
    return re.compile(
        rf"(?:(?:{long}){inside}{{0,6}}?|[（(][^）)\n]{{1,8}}[）)]|{inside}{{2,4}})(?:{kind})"
        rf"|\b(?:{capital},? (?:of |and )?){{1,6}}?(?:{titled})\b(?: of {capital}(?: {capital}){{0,4}})?|\b(?:{titled}) of {capital}(?: {capital}){{0,4}}"
        rf"|(?i:\b(?:{fields})\s+(?:{kinds})\b)"
    )


_NAMED = _bodies()
# what ngrams() counts, as texts
_TERMS = [re.compile(p) for p in ("(?=([\u3400-\u9fff]{2}))", "(?=([\u3400-\u9fff]{3}))", "(?=([a-z \u00c0-\u024f]{5}))")]
_PLAIN = re.compile(r"[^\x00-\x7f一-鿿。，、；：？！“”‘’（）《》·…—％]")


@cache
def _forms() -> dict:
    return str.maketrans(*translation())


def _may_mention(text: str, low: str) -> bool:
    """Whether a text has a part that every match of MENTIONED has; the search itself is slow."""
    return "至于" in text or "本条" in text or "本文" in text or " about" in low or " here" in low or "not the " in low


def relevant(text: str | None, title: bool = True) -> str:
    """A text in one form and lower case, without sentences that only mention a subject in passing and without
    names of bodies; null is empty."""
    text = text or ""
    if _PLAIN.search(text):
        text = unicodedata.normalize("NFC", _FORMAT.sub("", text).translate(_forms()))
    low = text.lower()
    if _may_mention(text, low) and MENTIONED.search(text):
        text = "\n".join(s for s in _SENTENCE.split(text) if not MENTIONED.search(s))
        low = text.lower()
    if title:
        low = _BODY.sub(" ", text).lower()
    elif _NAMES.search(low):  # few summaries have one
        low = _NAMED.sub(" ", text).lower()
    return _DROP.sub("0", low).replace("\0", " ")


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of all n-grams: 2 and 3 Han characters, 5 characters of other letters."""
    joined = "\0".join(texts) + "\0"
    cp = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32)
    owner = np.cumsum(cp == 0).astype(np.int32)
    han = (cp >= 0x3400) & (cp <= 0x9FFF)
    latin = ((cp >= 97) & (cp <= 122)) | (cp == 32) | ((cp >= 0xC0) & (cp < 0x250))
    h = cp.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    found, whose = [], []
    with np.errstate(over="ignore"):
        rolling = h.copy()
        ok_han, ok_latin = han.copy(), latin.copy()
        for n in range(2, 6):
            rolling = rolling[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[n - 1 :]
            ok_han, ok_latin = ok_han[:-1] & han[n - 1 :], ok_latin[:-1] & latin[n - 1 :]
            keep = ok_han if n < 4 else ok_latin if n == 5 else None
            if keep is not None:
                v = rolling[keep]
                v = (v ^ (v >> np.uint64(29))) * np.uint64(0x165667B19E3779F9)
                found.append((v >> np.uint64(48)).astype(np.int64) % BUCKETS)
                whose.append(owner[: len(keep)][keep])
    return np.concatenate(found), np.concatenate(whose)


def telling(weights: np.ndarray) -> np.ndarray:
    """Buckets that some topic favours; the others don't move a document's proportions."""
    return weights.max(axis=1) > TELLS * weights.mean(axis=1)


def infer(
    texts: list[str], weights: np.ndarray, statistics: np.ndarray | None = None, tells: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Topic proportions and expected n-grams by topic of each document under exp(E[log beta]) =
    `weights` (buckets x topics). `texts` has title and summary of every document in turn; the second
    result has a row for each of them. With `statistics`, the expected counts are added to it, by bucket,
    and the second result is left at zero. Documents without n-grams are uniform.

    Documents of nearly one length are taken together, as products of small matrices that stay in a core's cache
    while they settle; one of more than `CELLS` n-grams is taken alone."""
    bucket, part = ngrams(texts)
    # 16-bit keys are sorted by counting
    order = np.argsort(part.astype(np.uint16) if len(texts) < 1 << 16 else part, kind="stable")
    bucket, part = bucket[order], part[order]
    topics = weights.shape[1]
    theta = np.full((len(texts) // 2, topics), 1 / topics, dtype=np.float32)
    mass = np.zeros((len(texts), topics), dtype=np.float32)
    place = np.flatnonzero((telling(weights) if tells is None else tells)[bucket])
    told = bucket[place]
    parts = np.bincount(part[place], minlength=len(texts)).reshape(-1, 2)
    count = parts.sum(axis=1)
    start = np.cumsum(count) - count
    scale = np.zeros(len(bucket), dtype=np.float32)  # of each n-gram, 1 / (weights . theta)
    ranked = np.argsort(count, kind="stable")
    ranked = ranked[count[ranked] > 0]
    while len(ranked):
        longest = count[ranked[-1]]
        ranked, group = np.split(ranked, [-max(1, CELLS // longest)]) if CELLS // longest < len(ranked) else (ranked[:0], ranked)
        slot = np.arange(longest)
        real = slot < count[group][:, None]
        at = np.where(real, start[group][:, None] + slot, 0)
        own = weights.take(told[at], axis=0)
        own[~real] = 0
        whole = own = np.ascontiguousarray(own.transpose(0, 2, 1))
        active, found = np.arange(len(group)), theta[group]
        while len(active):
            old = found[active]
            gamma = old * (own @ _inverse(old, own)[:, :, None])[:, :, 0] + np.float32(ALPHA)
            found[active] = gamma = gamma / gamma.sum(axis=1, keepdims=True)
            moves = np.abs(gamma - old).max(axis=1) > SETTLED
            if 4 * moves.sum() <= len(active):  # settled documents leave, once they are worth a copy
                own, active = own[moves], active[moves]
        theta[group] = found
        inverse = _inverse(found, whole)
        if statistics is not None:
            scale[place[at[real]]] = inverse[real]
        else:
            title = slot < parts[group, :1]
            share = whole @ np.stack([inverse * title, inverse * ~title], axis=2)
            mass[2 * group], mass[2 * group + 1] = found * share[:, :, 0], found * share[:, :, 1]
    if statistics is not None and len(bucket):
        rest = np.ones(len(bucket), dtype=bool)
        rest[place] = False
        rest = np.flatnonzero(rest)
        scale[rest] = 1 / np.einsum("ij,ij->i", weights[bucket[rest]], theta[part[rest] >> 1])
        each = np.bincount(part >> 1, minlength=len(theta))
        for k in range(topics):
            statistics[:, k] += weights[:, k] * np.bincount(bucket, np.repeat(theta[:, k], each) * scale, len(weights))
    return theta, mass


def _inverse(theta: np.ndarray, own: np.ndarray) -> np.ndarray:
    """1 / (weights . theta) of the n-grams of documents; what only fills a row up has no weights."""
    return 1 / np.maximum((theta[:, None, :] @ own)[:, 0], np.float32(1e-30))


def topic_weights(counts: np.ndarray) -> np.ndarray:
    """The topics' n-gram weights, exp(E[log beta]) up to a factor per topic, of expected counts (buckets x
    topics). The prior is large enough for exp(digamma(x)) to be x - 1/2 where counts matter."""
    size = counts.sum(axis=0)
    prior = ETA * size / max(size.sum(), 1e-9)
    return ((counts + prior) / np.maximum(size + prior * len(counts), 1e-9)).astype(np.float32) + np.float32(1e-12)


def seed(labelled: list[tuple[str, str, list[str]]]) -> np.ndarray:
    """Expected counts of the labelled texts (buckets x topics). A text of several subjects counts for
    each in parts; what n-grams say of no subject, being spread over all, goes to the background."""
    counts = np.zeros((BUCKETS, TOPICS))
    if not labelled:
        return counts
    bucket, part = ngrams([x for t, s, _ in labelled for x in (t, s)])
    owner = part >> 1
    for at, (_, _, names) in enumerate(labelled):
        own = bucket[owner == at]
        for name in names:
            if name in SUBJECTS:
                np.add.at(counts[:, SUBJECTS.index(name)], own, 1 / len(names))
    subject = counts[:, : len(SUBJECTS)]
    total = subject.sum(axis=1)
    share = subject / np.maximum(total, 1e-9)[:, None]
    # how far from even an n-gram's subjects are, 0 to 1, less what chance gives a rare one
    peak = np.clip((share.max(axis=1) - 2 / len(SUBJECTS)) / (1 - 2 / len(SUBJECTS)), 0, 1)
    trust = peak * np.minimum(1.0, total / 2)
    counts[:, len(SUBJECTS) :] = (total * (1 - trust) / BACKGROUND)[:, None]
    counts[:, : len(SUBJECTS)] = subject * trust[:, None]
    return counts


def top_buckets(weights: np.ndarray, most: int = TOP) -> np.ndarray:
    """(topics x most): of each topic the buckets with the largest weight times log lift over the other topics."""
    share = weights / weights.sum(axis=1, keepdims=True)
    score = weights * np.log(np.maximum(share * weights.shape[1], 1e-9))
    return np.argsort(-score, axis=0, kind="stable")[:most].T


def topic_subjects(weights: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The subject of each topic, or -1 for background, through its top terms. `labels` has what n-grams of
    labelled texts say of the subjects (buckets x subjects)."""
    uses = np.stack([labels[top].sum(axis=0) for top in top_buckets(weights)])
    best = uses.argmax(axis=1)
    part = uses[np.arange(len(uses)), best] / np.maximum(uses.sum(axis=1), 1e-9)
    return np.where(part >= TELLING_PART, best, -1)


def top_terms(documents: DataFrame, weights: np.ndarray, most: int = 20) -> DataFrame:
    """(topic, rank, term, uses): the n-grams that stand for each topic's top buckets in the corpus, the most
    frequent one of each bucket, to be inspected. Only n-grams of these few buckets are counted."""
    top = top_buckets(weights, most)
    inside = documents.sparkSession.sparkContext.broadcast(set(np.unique(top).tolist()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            uses: Counter = Counter()
            for title, summary in zip(batch["title"], batch["summary"]):
                for text in (relevant(title), relevant(summary, False)):
                    for pattern in _TERMS:
                        uses.update(pattern.findall(text))
            rows = [(int(ngrams([t])[0][-1]), t, n) for t, n in uses.items()]
            yield pd.DataFrame([r for r in rows if r[0] in inside.value], columns=["bucket", "term", "uses"])

    counted = documents.mapInPandas(run, "bucket int, term string, uses bigint").groupBy("bucket", "term").agg(F.sum("uses").alias("uses"))
    best = counted.groupBy("bucket").agg(F.max(F.struct("uses", "term")).alias("r")).select("bucket", "r.uses", "r.term")
    places = documents.sparkSession.createDataFrame([(int(k), int(r) + 1, int(b)) for k, row in enumerate(top) for r, b in enumerate(row)], "topic int, rank int, bucket int")
    return best.join(F.broadcast(places), "bucket").select("topic", "rank", "term", "uses")


def decide(theta: np.ndarray, mass: np.ndarray, subject: np.ndarray) -> list[list[str]]:
    """The subject of the largest proportion, and a second one that comes near it, in the document as a whole
    and in both its title and its summary, if it has both; `subject` is that of each topic. A document
    without n-grams has no subject."""
    n = len(SUBJECTS)
    into = np.zeros((len(subject), n), dtype=theta.dtype)
    into[np.flatnonzero(subject >= 0), subject[subject >= 0]] = 1
    theta, mass = theta @ into, mass @ into
    rank = np.argsort(-theta, axis=1, kind="stable")
    row = np.arange(len(theta))
    first, second = rank[:, 0], rank[:, 1]
    some = mass[0::2].sum(axis=1) + mass[1::2].sum(axis=1) > 0
    two = theta[row, second] >= SECOND * theta[row, first]
    alone = np.zeros(len(theta), dtype=bool)
    for at in (0, 1):
        part = mass[at::2]
        silent = part[row, first] + part[row, second] < 1
        two &= (part[row, second] >= SECOND_PART * part[row, first]) | silent
        alone |= silent
    two &= ~alone | (theta[row, second] >= SECOND_ALONE * theta[row, first])
    return [([SUBJECTS[a], SUBJECTS[b]] if t else [SUBJECTS[a]]) if s else [] for a, b, t, s in zip(first, second, two, some)]


def _texts(batch: pd.DataFrame) -> list[str]:
    return [x for title, summary in zip(batch["title"], batch["summary"]) for x in (relevant(title), relevant(summary, False))]


def sufficient(batches: Iterator[pd.DataFrame], weights: np.ndarray) -> Iterator[pd.DataFrame]:
    """One state a task: the expected counts of its documents, as a row for each bucket that occurs."""
    statistics, tells = np.zeros(weights.shape, order="F"), telling(weights)
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            infer(_texts(batch.iloc[at : at + ROWS]), weights, statistics, tells)
    kept = np.flatnonzero(statistics.any(axis=1))
    yield pd.DataFrame({"bucket": kept.astype(np.int32), "n": list(statistics[kept].astype(np.float32))})


def fit(documents: DataFrame, labelled: DataFrame, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray]:
    """Topic weights (buckets x topics) of the documents (title, summary), and each topic's subject. `labelled` has sample_id, title,
    summary and subject; of more than LABELLED rows, those of the least hashes are used."""
    rows = labelled.where("subject IS NOT NULL").groupBy("sample_id").agg(
        F.min("title").alias("title"), F.min("summary").alias("summary"), F.sort_array(F.collect_set("subject")).alias("subjects")
    )
    sample = rows.orderBy(F.xxhash64("sample_id"), "sample_id").limit(LABELLED).collect()
    anchor = seed([(relevant(r.title), relevant(r.summary, False), list(r.subjects)) for r in sorted(sample, key=lambda r: r.sample_id)])
    counts = anchor.copy()
    context = documents.sparkSession.sparkContext
    for _ in range(passes):
        shared = context.broadcast(topic_weights(counts))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            return sufficient(batches, shared.value)

        states = documents.mapInPandas(run, "bucket int, n array<float>")
        summed = states.select("bucket", *[F.col("n")[k].alias(f"n{k}") for k in range(TOPICS)]).groupBy("bucket").agg(
            *[F.sum(f"n{k}").alias(f"n{k}") for k in range(TOPICS)]
        )
        # BUCKETS rows at most, whatever the corpus
        found = summed.toPandas()
        corpus = np.zeros((BUCKETS, TOPICS))
        corpus[found["bucket"].to_numpy()] = found[[f"n{k}" for k in range(TOPICS)]].to_numpy()
        shared.unpersist()
        if corpus.sum() > 0:
            counts = corpus + anchor * (ANCHOR * corpus.sum() / max(anchor.sum(), 1e-9))
    weights = topic_weights(counts)
    return weights, topic_subjects(weights, anchor[:, : len(SUBJECTS)])


def subjects(events: DataFrame, labelled: DataFrame, passes: int = PASSES) -> DataFrame:
    """(id, subject): one or two subjects of each event, by its title and summary.

    Null and empty titles and summaries count as empty; an event with neither has no subject. Rows that come twice with one id are one record: the one ingested last counts. Whole texts are
    read. Events without id give nothing; empty tables give no rows.
    """
    model = events.sparkSession.sparkContext.broadcast(fit(events.select("title", "summary"), labelled, passes))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, subject = model.value
        tells = telling(weights)
        for batch in batches:
            names = []
            for at in range(0, len(batch), ROWS):
                names += decide(*infer(_texts(batch.iloc[at : at + ROWS]), weights, tells=tells), subject)
            yield pd.DataFrame({"id": batch["id"], "ingestedAt": batch["ingestedAt"], "subjects": names})

    rows = events.where("id IS NOT NULL").select("id", F.unix_micros(F.col("ingestedAt").cast("timestamp")).alias("ingestedAt"), "title", "summary")
    each = rows.mapInPandas(run, "id string, ingestedAt bigint, subjects array<string>")
    # only ids and names of subjects shuffle
    last = each.groupBy("id").agg(F.max(F.struct("ingestedAt", "subjects")).alias("r"))
    return last.select("id", F.explode("r.subjects").alias("subject"))
