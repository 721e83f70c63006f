"""Rule-driven extraction of entity candidates and classification of events.

Rules are data (a JSON object, `Rules`); patterns are built from them when a plan is built and run as
built-in regular expressions. Cleaning a matched label needs the last of many breakers with its own tie
rules, which no built-in says; these cleaners run on distinct matches in Arrow batches, not on texts.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.functions.conventions import alternatives

# Endings of titled documents.
POLICY_ENDINGS = "法|条例|办法|规定|规划|方案|通知|意见|纲要|决定|公约|协议"
DOCUMENT_ENDINGS = "报告|白皮书|年鉴|标准"
# Words behind which a matched name begins. Of equal places the later word counts.
BREAKERS = (
    "报道称 发布消息 消息称 调查显示 研究显示 宣布 表示 认为 指出 要求 允许 禁止 投资 收购 成立 未经 发生 遭到 遭 加入 担任 收到 送到 送往 拉到 回击 举报 列入 设立 召开 移交 毕业于 考入 报考 支持 "
    "比如说 比如 之前 说 把 包括 以及 其中 记者 根据 目前 已经 将由 被 由 向 从 在 对 与 和 及 为 是 的"
).split()
# Words cut from the end of a person's name, one after the other.
TRAILING = "主持例行 签署 宣布 表示 指出 认为 提问 邀请 注意到 了解到 证实 发现 选举 称 说 将 在 于 已 与 和 的".split()
AFTER_NAME = "在|于|向|与|和|将|已|曾|的|表示|指出|认为|宣布|强调|称|说|访问|会见|出席|主持|签署|邀请|抵达|离开"
# What a label of each kind doesn't begin with or hold.
NAMED_START = re.compile("^(?:相关|有关|当地|某个|一家|多家|各地|全国|本地)")
NAMED_HOLDS = re.compile("表示|宣布|认为|指出|接受|负责|成为|已经|目前|希望|可能|应该")
ORG_START = re.compile(
    "^(?:地方|当地|相关|有关|各级|各地|各个|公立|私立|外资|外商|全球主要|多家|一家|会不会|能不能|是否|为什么|如何|建立|抓紧|请问|送往|按照|按|保护|帮助|包含|绑架|办公室|比全世界|本级|本省|之前|取消)"
)
ORG_HOLDS = re.compile(r"[《》“”\"]|(?:\d{1,4}年|\d{1,2}月|\d{1,2}日|\d+名|\d+家|\d+所|\d+人|\d+岁)|(?:发生|爆炸|回升|回击|举报|遭|送到|移交|召开|毕业于|考入|报考|列入|设立|支持|解决)")
ORG_PREFIX = re.compile("^(?:主要|有关|相关|当地|地方)$")
FACILITY_START = re.compile(
    "^(?:全国|国内|现有|部分|多个|多地|几条|一条|一座|几座|第二条|建设|新建|修建|乘坐|抵达|飞往|途经|关于|通过|恢复|调整|投入|规划|用于|敌方|俄方|中方|美方|政府|公司|董事长|股东|但是|不过|直到|没有|保护|标志|称|当前|当晚|第一|调查|多位|避免|反思|否|国家|都给|把)"
)
FACILITY_END = re.compile("(?:几条|多条|一座|几座|部分|现有|这座|另一条|全国|国内)$")
FACILITY_PREFIX = re.compile(r"\d+(?:条|座|个|年|公里|兆瓦|城市)$")
PERSON_START = re.compile("^(?:的|等|各|该|本|农业|教育|项目|职务|会议)")
PERSON_END = re.compile("(?:公司|集团|政府|大学|学院|银行|委员会|项目|产业|农业|教育)$")
PERSON_HOLDS = re.compile(
    "被查|被抓|被捕|被判|免职|辞职|下台|访华|访美|访问|会面|会晤|握手|建议|回应|发文|落马|去世|出席|调研|投票|签署|宣布|表示|指出|认为|主持|参加|获胜|当选|任命|受贿|起诉|公诉|通缉|绑架|弹劾|取消|敦促|祝贺|介绍|指导|工作|活动|项目|职务"
)
# Labels too general to be an entity.
GENERIC = frozenset(
    "中国 我国 国内 公司 集团 政府 当地政府 有关部门 相关部门 委员会 大学 学院 医院 研究院 研究所 银行 基金会 交易所 协会 合作社 电视台 通讯社 报社 工作室 中心 管理局 开发区 工业园 产业园 铁路 高铁 公路 "
    "大桥 机场 港口 地铁 多地法院 改革委员会 集团有限公司 既得利益集团 急救中心 加沙医院 全球最大医院 三甲医院 商业银行 社区卫生服务中心 送往医院 新任国防部 中小银行 另一个犯罪集团 城际铁路 第二条城际高速铁路 "
    "黑海港口 英国铁路 这个水库 中国国家铁路 中国铁路 重载铁路 此基础上授权基层政府 代表政府 国际非政府 近年来政府 审议国务院关于政府 省级政府 团队去了瑞金医院 未得到政府 我国政府 一些大学 县人民医院 上市银行 "
    "控股集团 数据中心 研发中心 月子中心 执行法院 农村委员会 发展委员会 顾问委员会 联合政府 联邦政府 方舱医院 疾控中心 标准轨铁路 广州撞大桥 上游水电站 这条铁路 中远海运港口 阿临时政府 野党共同民主党 中国作协会 "
    "中美商务部 湖北全省各大医院 美国大学 市大数据中心 宪法法院 最高法院 自治区政府 中央政府 特区政府 美国法院 国内首所空天信息大学 时间银行".split()
)
# What looks like a person's name and is none.
PERSON_STOP = frozenset(
    "国家 中国 美国 俄罗斯 韩国 日本 法国 德国 英国 政府 记者 提问 职务 会议 国家安全 外交部 国防部 商务部 财政部 国务院 委员会 公司 集团 宝座 被打 被双开 常委 大家好 当地时间 董事长兼 访谈 候选人 会简史 会上 将于 "
    "据报道 了解到 梳理发现 选举 选举结果 邀请 证实 助理 注意到 梳理 从西藏林芝市 董事长 级会议 日前 提出 采访 大选 调查 国务委员 会见 级官员 近日 跨栏进北大 区长 上月初 时期 首次 受审 投诉 团队 性骚扰 最近".split()
)
# The class of an event by its first topic, where no class has a keyword in it.
TOPIC_CLASSES = {
    "topic-macroeconomy": "economy_business", "topic-public-finance": "policy_governance", "topic-finance": "economy_business", "topic-housing": "society_livelihood", "topic-manufacturing": "economy_business",
    "topic-digital-economy": "science_technology", "topic-ai": "science_technology", "topic-semiconductor": "science_technology", "topic-energy": "environment_energy", "topic-environment": "environment_energy",
    "topic-transport": "infrastructure_transport", "topic-agriculture": "society_livelihood", "topic-healthcare": "society_livelihood", "topic-public-health": "public_health", "topic-education": "education_culture",
    "topic-science": "science_technology", "topic-population": "society_livelihood", "topic-labor": "society_livelihood", "topic-social-security": "society_livelihood", "topic-governance": "policy_governance",
    "topic-law": "law_justice", "topic-public-safety": "disaster_accident", "topic-international": "international_relations", "topic-defense": "conflict_security", "topic-culture": "education_culture",
    "topic-consumption": "economy_business", "topic-sports": "education_culture",
}
#: Kinds of candidates in the order in which they follow each other in an event.
KINDS = ("place", "organization", "facility", "policy", "document", "person", "topic", "link")
CONFIDENCE = {"place": 1.0, "organization": 0.84, "facility": 0.84, "policy": 0.98, "document": 0.98, "person": 0.86, "topic": 1.0, "link": 1.0}
METHOD = {
    "place": "gazetteer", "organization": "organization_suffix", "facility": "facility_suffix", "policy": "document_title", "document": "named_document",
    "person": "role_after", "topic": "controlled_vocabulary", "link": "reviewed_news_link",
}


@dataclass(frozen=True)
class Rules:
    """Extraction rules. `generic` are labels never taken, `person_stop` names that are no persons."""

    version: str = "0"
    topics: tuple[dict, ...] = ()
    event_classes: tuple[dict, ...] = ()
    topic_classes: dict = field(default_factory=dict)
    places: tuple[dict, ...] = ()
    organization_suffixes: tuple[str, ...] = ()
    organization_aliases: tuple[dict, ...] = ()
    facility_suffixes: tuple[str, ...] = ()
    person_roles: tuple[str, ...] = ()
    reviewed_links: dict = field(default_factory=dict)
    region_codes: tuple[str, ...] = ()
    generic: frozenset = frozenset()
    person_stop: frozenset = frozenset()

    @staticmethod
    def from_json(text: str, generic=GENERIC, person_stop=PERSON_STOP, topic_classes=None) -> Rules:
        """Rules of a JSON object with the archive's field names, and the fixed lists beside them."""
        r = json.loads(text)
        return Rules(
            version=r.get("version", "0"), topics=tuple(r.get("topics", ())), event_classes=tuple(r.get("eventClassification", ())), topic_classes=dict(TOPIC_CLASSES if topic_classes is None else topic_classes),
            places=tuple(r.get("placeAliases", ())), organization_suffixes=tuple(r.get("organizationSuffixes", ())), organization_aliases=tuple(r.get("organizationAliases", ())),
            facility_suffixes=tuple(r.get("facilitySuffixes", ())), person_roles=tuple(r.get("personRoles", ())), reviewed_links=dict(r.get("reviewedNewsEntityLinks", {})),
            region_codes=tuple(r.get("isoRegionCodes", "").split()), generic=frozenset(generic), person_stop=frozenset(person_stop),
        )


def region_names(spark, codes, language: str = "zh", country: str = "CN") -> list[str]:
    """Names of ISO regions as the JVM's locale data has them; codes without a name are left out. They depend
    on the Java version: keep the list with the rules to hold results still (E2)."""
    locale = spark._jvm.java.util.Locale
    target = locale(language, country)
    names = ((c, locale("", c).getDisplayCountry(target)) for c in codes if c not in ("CN", "HK", "MO", "TW"))
    return [n for c, n in names if n and n != c]


def gazetteer(rules: Rules, regions: list[str] = ()) -> dict[str, dict]:
    """Place by alias, of two characters and more; the first place that has an alias keeps it."""
    places = {p["label"]: {"label": p["label"], "aliases": [a for a in dict.fromkeys(p.get("aliases") or ()) if a]} for p in rules.places}
    for name in regions:
        places.setdefault(name, {"label": name, "aliases": []})
    owner: dict[str, dict] = {}
    for place in places.values():
        for alias in (place["label"], *place["aliases"]):
            if len(alias) >= 2:
                owner.setdefault(alias, place)
    return owner


_EDGE = re.compile("^[《》“”\"'(（)）]+|[《》“”\"'(（)）]+$")
_AMOUNT = re.compile("^(?:(?:18|19|20)?\\d{1,4}(?:年|月|日|时|分|个|家|所|名|亿元|万元|岁|届|条|艘|人|—|-|\\.|、)?)+")
_FUNCTION = re.compile("^(?:据|由|被|向|从|在|对|与|和|及|为|是|该|这家|一家|多家|当地|相关|有关)+")


def clean_named(label: str, most: int) -> str:
    """A matched name without quotes, amounts and function words in front, from behind the right-most breaker
    on, its last `most` characters (E14)."""
    label = _FUNCTION.sub("", _AMOUNT.sub("", _EDGE.sub("", " ".join(label.split()))))
    # a breaker at the very end breaks nothing; the right-most place counts, and the later word of equal ones
    at, _, end = max(((label.rfind(b), i, label.rfind(b) + len(b)) for i, b in enumerate(BREAKERS) if label.rfind(b) >= 0 and label.rfind(b) + len(b) < len(label)), default=(-1, 0, 0))
    if at >= 0:
        label = label[end:]
    return _EDGE.sub("", label)[-most:].strip()


_HAN = "㐀-鿿豈-﫿𠀀-𯨟"


def clean_person(label: str) -> str:
    """A matched person's name, or an empty text for what is none."""
    label = re.sub("^[《“\"'（(]+|[》”\"'）)]+$", "", " ".join(label.split())).strip()
    for word in TRAILING:
        if label.endswith(word) and len(label) > len(word) + 1:
            label = label[: -len(word)]
    label = re.sub("^(?:前|原|现任|时任|候任)+", "", label)
    if PERSON_START.search(label) or PERSON_END.search(label) or PERSON_HOLDS.search(label):
        return ""
    if "·" in label:
        return label if re.fullmatch(f"[{_HAN}A-Za-z·]{{3,24}}", label) else ""
    if re.fullmatch(r"[A-Z][A-Za-z .'-]{1,36}", label):
        return label.strip()
    return label if re.fullmatch(f"[{_HAN}]{{2,6}}", label) else ""


def useful_named(label: str, generic: frozenset) -> bool:
    return len(label) >= 3 and label not in generic and not NAMED_START.search(label) and not NAMED_HOLDS.search(label)


def _prefix(label: str, suffixes) -> str | None:
    ending = next((s for s in sorted(suffixes, key=len, reverse=True) if label.endswith(s)), None)
    return None if ending is None else label[: -len(ending)]


def useful_organization(label: str, rules: Rules) -> bool:
    prefix = _prefix(label, rules.organization_suffixes)
    return bool(
        useful_named(label, rules.generic) and not ORG_START.search(label) and not ORG_HOLDS.search(label) and prefix is not None and len(prefix) >= 2 and not ORG_PREFIX.search(prefix)
    )


def useful_facility(label: str, rules: Rules) -> bool:
    prefix = _prefix(label, rules.facility_suffixes)
    return bool(
        useful_named(label, rules.generic) and not FACILITY_START.search(label) and not FACILITY_END.search(label) and prefix is not None and len(prefix) >= 2 and not FACILITY_PREFIX.search(prefix)
    )


def useful_title(label: str) -> bool:
    return len(label) <= 52 and not re.search(r"[\[\]#<>]|(?:^|[^a-z])https?://", label, re.I) and not re.search(r"\s{2,}", label)


def matched_patterns(rules: Rules, places) -> dict[str, tuple[str, bool]]:
    """Kind to (pattern with one group, whether the whole text is read or title and summary alone)."""
    han = r"\p{IsHan}"
    roles = alternatives(rules.person_roles)
    found = {
        "policy": (rf"《([^》\n]{{2,48}}(?:{POLICY_ENDINGS}))》", True),
        "document": (rf"《([^》\n]{{2,48}}(?:{DOCUMENT_ENDINGS}))》", True),
    }
    if places:
        found["place"] = (f"({alternatives(places)})", True)
    if rules.organization_suffixes:
        found["organization"] = (rf"([{han}A-Za-z0-9·&（）()《》“”_\-]{{2,32}}(?:{alternatives(rules.organization_suffixes)}))", False)
    if rules.facility_suffixes:
        found["facility"] = (rf"([{han}A-Za-z0-9·（）()_\-]{{2,28}}(?:{alternatives(rules.facility_suffixes)}))", False)
    if rules.person_roles:
        found["person"] = (
            rf"(?:{roles})[：:、，,\s　“”]{{0,3}}([{han}·]{{2,12}}?|[A-Z][A-Za-z .·'\-]{{1,36}}?)(?={AFTER_NAME}|[，。；：、,;\s　]|\z)",
            False,
        )
    return found


CANDIDATES = "key string, event_id string, ord int, type string, label string, aliases array<string>, method string, confidence double, prominent boolean"


def extract_candidates(texts: DataFrame, rules: Rules, regions: list[str] = ()) -> DataFrame:
    """CANDIDATES of texts (event_id, news_id, headline, text): one row per event and key.

    `headline` is title and summary, `text` these and the fragment. Null or empty texts give nothing, but
    for reviewed links. Of several candidates of one key in one event the most confident counts, of equal
    ones the first; it is prominent if its label or an alias stands in the headline.
    """
    places = gazetteer(rules, regions)
    bodies = {a: o for o in rules.organization_aliases for a in (o["label"], *(o.get("aliases") or ()))}
    rows = texts.select("event_id", "news_id", T.squeeze(F.col("headline")).alias("headline"), T.squeeze(F.col("text")).alias("text"))
    named = F.when(F.col("headline") == "", F.col("text")).otherwise(F.col("headline"))
    matches = []
    for kind, (pattern, everywhere) in matched_patterns(rules, places).items():
        found = F.regexp_extract_all(F.col("text") if everywhere else named, F.lit(pattern), F.lit(1))
        matches.append(F.transform(found, lambda m, i: F.struct(F.lit(KINDS.index(kind)).alias("k"), i.alias("i"), m.alias("m"))))
    topics = [(t, list(dict.fromkeys(t["keywords"]))) for t in rules.topics]
    for i, (topic, words) in enumerate(topics):
        hit = F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains("text", w)) if words else F.lit(False)
        matches.append(F.when(hit, F.array(F.struct(F.lit(KINDS.index("topic")).alias("k"), F.lit(i).alias("i"), F.lit(topic["label"]).alias("m")))).otherwise(F.expr("CAST(array() AS array<struct<k:int,i:int,m:string>>)")))
    for i, (news, links) in enumerate(sorted(rules.reviewed_links.items())):
        own = F.array(*[F.struct(F.lit(KINDS.index("link")).alias("k"), F.lit(j).alias("i"), F.lit(f"{x['type']}\t{x['label']}").alias("m")) for j, x in enumerate(links)])
        matches.append(F.when(F.col("news_id") == news, own).otherwise(F.expr("CAST(array() AS array<struct<k:int,i:int,m:string>>)")))
    if not matches:
        return texts.sparkSession.createDataFrame([], CANDIDATES)
    hits = rows.select("event_id", "headline", F.explode(F.concat(*matches)).alias("x")).select("event_id", "headline", "x.k", "x.i", "x.m")
    by_label = {t["label"]: w for t, w in topics}

    def resolve(kind: str, match: str) -> tuple[str, str, list[str]] | None:
        if kind == "place":
            place = places[match]
            return "place", place["label"], place["aliases"]
        if kind == "organization":
            label = clean_named(match, 24)
            known = bodies.get(label)
            return ("organization", known["label"] if known else label, list(known.get("aliases") or ()) if known else []) if useful_organization(label, rules) else None
        if kind == "facility":
            label = clean_named(match, 22)
            return ("facility", label, []) if useful_facility(label, rules) else None
        if kind in ("policy", "document"):
            label = f"《{' '.join(match.split())}》"
            return (kind, label, []) if useful_title(label) else None
        if kind == "person":
            label = clean_person(match)
            bad = not label or label in places or label in rules.person_stop or any(r in label for r in rules.person_roles)
            return None if bad else ("person", label, [])
        if kind == "topic":
            return "topic", match, by_label[match]
        of_type, label = match.split("\t")
        known = bodies.get(label) if of_type == "organization" else None
        return of_type, known["label"] if known else label, list(known.get("aliases") or ()) if known else []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[tuple[str, str], tuple | None] = {}
        for batch in batches:
            out = []
            for event, headline, k, i, m in batch.itertuples(index=False):
                kind = KINDS[k]
                if (kind, m) not in cache:
                    if len(cache) > 100_000:
                        cache.clear()
                    cache[kind, m] = resolve(kind, m)
                found = cache[kind, m]
                if found and found[1] not in rules.generic:
                    of_type, label, aliases = found
                    prominent = kind == "link" or any(a in headline for a in (label, *aliases))
                    out.append((event, k * 1_000_000 + i, of_type, label, aliases, METHOD[kind], CONFIDENCE[kind], prominent))
            yield pd.DataFrame(out, columns=["event_id", "ord", "type", "label", "aliases", "method", "confidence", "prominent"])

    raw = hits.mapInPandas(run, "event_id string, ord int, type string, label string, aliases array<string>, method string, confidence double, prominent boolean")
    raw = raw.withColumn("key", T.entity_key(F.col("type"), F.col("label")))
    best = W.partitionBy("event_id", "key").orderBy(F.desc("confidence"), "ord")
    same = W.partitionBy("event_id", "key")
    merged = raw.withColumns({"_n": F.row_number().over(best), "prominent": F.bool_or("prominent").over(same), "ord": F.min("ord").over(same)}).where("_n = 1")
    return merged.select(*[f.split()[0] for f in CANDIDATES.split(", ")])


def class_scores(text: Column, classes) -> list[Column]:
    """Score of each class: occurrences of its keywords times their lengths, which is the number of characters
    that taking them out would take away (E18, F20). A fold over each class's words keeps the plan small."""
    out = []
    for c in classes:
        words = [w for w in c["keywords"] if w]
        score = F.aggregate(
            F.array(*[F.lit(w) for w in words]), F.lit(0), lambda n, w: n + F.length(text) - F.length(F.replace(text, w, F.lit("")))
        )
        out.append(score if words else F.lit(0))
    return out


def classify_text(text: Column, rules: Rules) -> Column:
    """The class of the highest score, of equal ones the first; without any, that of the first topic with a
    keyword; else `other`. `text` should be a column of its own, squeezed: it is read many times."""
    scores = class_scores(text, rules.event_classes)
    topics = [t for t in rules.topics if t["id"] in rules.topic_classes and t["keywords"]]
    hits = [F.when(F.exists(F.array(*[F.lit(w) for w in t["keywords"]]), lambda w: F.contains(text, w)), F.lit(rules.topic_classes[t["id"]])) for t in topics]
    best = F.coalesce(*hits, F.lit("other"))
    if not scores:
        return best
    ranked = F.array(*[F.struct(s.alias("s"), F.lit(-i).alias("i"), F.lit(c["id"]).alias("id")) for i, (s, c) in enumerate(zip(scores, rules.event_classes))])
    top = F.array_max(ranked)
    return F.when(top["s"] > 0, top["id"]).otherwise(best)


def classify_events(texts: DataFrame, rules: Rules, headline: str = "headline", context: str = "text", output: str = "class") -> DataFrame:
    """Adds the class by title and summary; only if that is `other`, by the fragment too (E17). Null texts are
    empty."""
    rows = texts.withColumns({"_head": T.squeeze(F.col(headline)), "_more": T.squeeze(F.col(context))})
    rows = rows.withColumn("_first", classify_text(F.col("_head"), rules))
    later = F.when((F.col("_first") == "other") & (F.col("_more") != ""), classify_text(F.col("_more"), rules)).otherwise(F.col("_first"))
    return rows.withColumn(output, later).drop("_head", "_more", "_first")
