"""Variant spellings of the names of persons and organisations, linked to one entity.

A name is parsed into a class (given name; or field and kind of a body) and a core (family name; proper
name), whatever their order, so that abbreviations, nicknames, reordered parts and titles fall into one
form. Cores of one class are joined with one typing error allowed: pigeonhole, a core cut into two
segments keeps one of them whole under one edit, so equal segments at shifted positions in an inverted
index give the candidates (swapped neighbours, which touch both segments, have the same letters sorted),
and a banded edit distance decides. Aliases carry links between scripts. Names that leave a part out
(an initial, a title alone, no kind of body) join an entity only if all that fit them are one.

Links make components by alternating large and small stars over tables; nothing is collected.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.lookalike import translation
from newsloom.session import durable

# Given names, with their short forms, as they are written in either script.
GIVEN = {
    "alexander": "alex sandy 亚历山大 亚历克斯", "andrew": "andy drew 安德鲁 安迪", "anthony": "tony 安东尼 托尼", "benjamin": "ben benny 本杰明 本",
    "charles": "charlie chuck 查尔斯 查理", "christopher": "chris 克里斯托弗 克里斯", "daniel": "dan danny 丹尼尔 丹", "david": "dave 大卫 戴夫",
    "edward": "ted ed eddie 爱德华 泰德", "elizabeth": "liz beth betty 伊丽莎白 莉兹", "george": "乔治", "gregory": "greg 格雷戈里 格雷格",
    "henry": "harry 亨利 哈里", "james": "jim jimmy 詹姆斯 吉姆", "jennifer": "jen jenny 珍妮弗 珍", "john": "jack johnny 约翰 杰克",
    "joseph": "joe 约瑟夫 乔", "katherine": "kate kathy 凯瑟琳 凯特", "margaret": "peggy maggie 玛格丽特 佩吉", "mary": "玛丽", "michael": "mike 迈克尔 迈克",
    "nicholas": "nick 尼古拉斯 尼克", "patricia": "pat patty 帕特里夏 帕特", "peter": "pete 彼得", "richard": "dick rick 理查德 迪克",
    "robert": "bob rob bobby 罗伯特 鲍勃", "samuel": "sam 塞缪尔 山姆", "susan": "sue susie 苏珊 苏", "theresa": "tess terry 特雷莎 苔丝",
    "thomas": "tom tommy 托马斯 汤姆", "victoria": "vicky 维多利亚 维姬", "william": "bill will billy 威廉 比尔",
}
# Titles that stand for a given name.
TITLES = "先生 女士 小姐 太太 教授 博士 主任 院长 mr mrs ms miss dr prof professor sir".split()
# Fields of bodies: full form, short forms in Chinese; full form, short forms in English.
FIELDS = {
    "power": ("电力", "", "electric power", "power"), "water": ("水务", "", "water supply", "water"), "rail": ("铁路工程", "铁工 铁路", "railway engineering", "rail railway"),
    "shipping": ("航运", "", "shipping lines", "shipping"), "environment": ("环境监测", "环监", "environmental monitoring", "envimon"),
    "it": ("信息技术", "信技 信息", "information technology", "infotech"), "medicine": ("生物制药", "生药 制药", "biological medicine", "biomed"),
    "materials": ("建筑材料", "建材", "building materials", "materials"), "instruments": ("精密仪器", "精仪 仪器", "precision instruments", "instruments"),
    "agriculture": ("农业科技", "农科", "agricultural science", "agrisci agri agritech"), "fishery": ("海洋渔业", "海渔 渔业", "marine fishery", "fishery"),
    "dairy": ("乳业", "", "dairy products", "dairy"),
}
# Kinds of bodies, in the same way.
KINDS = {
    "corporation": ("股份有限公司", "公司 股份 股份公司", "corporation", "corp"), "group": ("集团有限公司", "集团 集团公司", "group company limited", "group"),
    "committee": ("管理委员会", "管委会 委员会", "administrative committee", "committee"), "association": ("行业协会", "协会", "trade association", "assoc association"),
    "foundation": ("基金会", "基金", "foundation", "fdn fund"), "institute": ("研究院", "院 研究所", "research institute", "institute inst"),
}

NAMES = "id string, label boolean, kind string, script string, class string, part string, core string"

_HAN = re.compile(r"[㐀-鿿]")
_INVISIBLE = re.compile("[\u00ad\u034f\u061c\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff]")
_FORMS = str.maketrans(*translation())


def _alternatives(table: dict, at: int) -> tuple[dict[str, str], re.Pattern]:
    known = {}
    for name, forms in table.items():
        for form in (forms[at], *forms[at + 1].split()):
            known[form] = name
    return known, re.compile("|".join(sorted(map(re.escape, known), key=len, reverse=True)))


_GIVEN = {form: name for name, forms in GIVEN.items() for form in (name, *forms.split())}
_GIVEN_HAN = sorted((f for f in _GIVEN if _HAN.match(f) and len(f) > 1), key=len, reverse=True)
_FIELD_HAN, _FIELD_HAN_RE = _alternatives({k: v[:2] for k, v in FIELDS.items()}, 0)
_KIND_HAN, _KIND_HAN_RE = _alternatives({k: v[:2] for k, v in KINDS.items()}, 0)
_BRANCH = re.compile(r"第([一二三四五六七八九十\d]+)分(院|会|公司|部|所|社)")


def _initials(words: str) -> str:
    return "".join(w[0] for w in words.split())


_FIELD_EN = {f: k for k, v in FIELDS.items() for f in (v[2], *v[3].split())}
_KIND_EN = {f: k for k, v in KINDS.items() for f in (v[2], *v[3].split())}
_ACRONYMS: dict[str, set[tuple[str, str]]] = {}
for _f, _v in FIELDS.items():
    _ACRONYMS.setdefault(_initials(_v[2]), set()).add((_f, ""))
    for _k, _w in KINDS.items():
        _ACRONYMS.setdefault(_initials(_v[2]) + _initials(_w[2]), set()).add((_f, _k))


def clean(text: str) -> str:
    """A name in one form of characters: width, look-alikes, blanks, no invisible characters."""
    return re.sub(r"\s+", " ", unicodedata.normalize("NFC", _INVISIBLE.sub("", text).translate(_FORMS))).strip()


def plain(text: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


def one_edit(a: str, b: str) -> bool:
    """Whether two words are one edit apart: a letter more, less or other, or two neighbours swapped."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    if len(a) != len(b):
        short, long = sorted((a, b), key=len)
        return short[at:] == long[at + 1 :]
    return a[at + 1 :] == b[at + 1 :] or a[at : at + 2] == b[at : at + 2][::-1] and a[at + 2 :] == b[at + 2 :]


def given_name(token: str) -> str | None:
    """The given name that a word means: a known form, or a mistyped full form."""
    if token in _GIVEN or len(token) < 3:
        return _GIVEN.get(token)
    near = {g for form, g in _GIVEN.items() if len(form) >= (3 if _HAN.match(form) else 5) and one_edit(token, form)}
    return near.pop() if len(near) == 1 else None


def person(text: str) -> list[tuple[str, str, str]]:
    """[(given, part, family)]: `given` is a known given name with part "full", an initial with part
    "initial", or "" with part "title". Names without a known part are kept whole."""
    name = plain(clean(text))
    if _HAN.search(name):
        tokens = [t for t in re.split(r"[·\s,()•]+", name) if t]
        if len(tokens) == 1:
            one = tokens[0]
            for title in TITLES:
                if one.endswith(title) and len(one) > len(title) + 1:
                    return [("", "title", one[: -len(title)])]
            for form in _GIVEN_HAN:
                if one.startswith(form) and len(one) > len(form) + 1:
                    return [(_GIVEN[form], "full", one[len(form) :])]
                if one.endswith(form) and len(one) > len(form) + 1:
                    return [(_GIVEN[form], "full", one[: -len(form)])]
            return [("", "whole", one)]
    else:
        tokens = [t for t in re.split(r"[\s,.()·]+", name) if t]
        tokens = [t for t in tokens if t not in TITLES] or tokens
        # a middle initial says nothing beside a given name
        if len(tokens) > 2 and any(t in _GIVEN for t in tokens):
            tokens = [t for t in tokens if len(t) > 1]
        if len(tokens) == 1:
            return [("", "title" if re.match(r"(?i)\s*(mr|mrs|ms|dr|prof)\b", text) else "whole", tokens[0])]
    known = [_GIVEN.get(t) for t in tokens]
    if not any(known) and not any(len(t) == 1 or t in TITLES for t in tokens):
        known = [given_name(t) for t in tokens]
    out = []
    for at, token in enumerate(tokens):
        rest = "".join(tokens[:at] + tokens[at + 1 :])
        if len(rest) < 2:
            continue
        if token in TITLES:
            return [("", "title", rest)]
        if known[at]:
            out.append((known[at], "full", rest))
        # one letter or one Han character may be an initial, besides a short form
        if len(token) == 1:
            out.append((token, "initial", rest))
    if any(p == "full" for _, p, _ in out) and not any(p == "initial" for _, p, _ in out):
        return [o for o in out if o[1] == "full"][:1]
    return out or [("", "whole", "".join(sorted(tokens)))]


def initials(given: str) -> list[str]:
    """What a given name may be cut to: its first letter, and the first character of its Han form."""
    return sorted({given[0], *(f[0] for f in GIVEN.get(given, "").split() if _HAN.match(f))})


def body(text: str) -> list[tuple[str, str, str]]:
    """[(field|kind, part, core)]: part is "full" if field and kind are known and "open" if one is missing;
    a branch's number is part of its kind."""
    name = plain(clean(text))
    if _HAN.search(name):
        name = re.sub(r"[\s()·,]+", "", name)
        if m := _BRANCH.search(name):
            kind, name = f"branch {m.group(1)}{m.group(2)}", name[: m.start()] + name[m.end() :]
        else:
            kind = ""
            ends = [m for m in _KIND_HAN_RE.finditer(name) if m.group() != "院" or m.end() == len(name)]
            if ends:
                m = ends[-1]
                kind, name = _KIND_HAN[m.group()], name[: m.start()] + name[m.end() :]
        field = ""
        if fields := sorted(_FIELD_HAN_RE.finditer(name), key=lambda m: -len(m.group())):
            m = fields[0]
            field, name = _FIELD_HAN[m.group()], name[: m.start()] + name[m.end() :]
        return [(f"{field}|{kind}", "full" if field and kind else "open", name)] if len(name) > 1 else []
    words = re.sub(r"[.()]+", " ", name)
    words = re.sub(r"\b(?:of|the)\b", " ", words)
    words = " ".join(re.sub(r",", " ", words).split())
    spaced = f" {words} "
    kind = field = ""
    for form in sorted(_KIND_EN, key=len, reverse=True):
        if f" {form} " in spaced:
            kind, spaced = _KIND_EN[form], spaced.replace(f" {form} ", " ", 1)
            break
    for form in sorted(_FIELD_EN, key=len, reverse=True):
        if f" {form} " in spaced:
            field, spaced = _FIELD_EN[form], spaced.replace(f" {form} ", " ", 1)
            break
    rest = spaced.split()
    if len(rest) > 1 and not field:
        for w in rest:
            if w in _ACRONYMS:
                core = "".join(x for x in rest if x != w)
                return [(f"{f}|{k or kind}", "full" if k or kind else "open", core) for f, k in sorted(_ACRONYMS[w]) if not (k and kind)]
    if not kind and not field and len(rest) == 1:
        # all words may be run together
        for form in sorted(_KIND_EN, key=len, reverse=True):
            tight = form.replace(" ", "")
            if len(tight) > 5 and rest[0].endswith(tight):
                kind, rest = _KIND_EN[form], [rest[0][: -len(tight)]]
                break
        for form in sorted(_FIELD_EN, key=len, reverse=True):
            tight = form.replace(" ", "")
            if len(tight) > 5 and rest[0].endswith(tight):
                field, rest = _FIELD_EN[form], [rest[0][: -len(tight)]]
                break
    core = "".join(rest)
    return [(f"{field}|{kind}", "full" if field and kind else "open", core)] if len(core) > 1 else []


def parse(entity: str, label: bool, text: str) -> list[tuple]:
    kind = "person" if entity.startswith("entity-person-") else "body"
    script = "han" if _HAN.search(text) else "latin"
    return [(entity, label, kind, script, c, p, core) for c, p, core in (person(text) if kind == "person" else body(text)) if core]


def names(entities: DataFrame) -> DataFrame:
    """NAMES of all labels and aliases of persons and organisations, by the type in the id."""
    rows = entities.where("id LIKE 'entity-person-%' OR id LIKE 'entity-organization-%'").select("id", "label", "aliases")
    both = rows.select("id", F.lit(True).alias("l"), F.col("label").alias("name")).unionByName(
        rows.select("id", F.lit(False).alias("l"), F.explode("aliases").alias("name"))
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in NAMES.split(", ")]
        for batch in batches:
            found = [x for i, l, n in zip(batch["id"], batch["l"], batch["name"]) for x in parse(i, l, n)]
            yield pd.DataFrame(found, columns=columns)

    return both.where("trim(name) <> ''").distinct().mapInPandas(run, NAMES).distinct()


def typo_pairs(cores: DataFrame, on: list[str], others: DataFrame | None = None) -> DataFrame:
    """(on, core_a, core_b), core_a < core_b: different cores that agree in `on` and are one edit apart:
    a character more, less or other, or two neighbours swapped. Cores of under three characters have no
    neighbours. `cores` has distinct rows of `on` and core; with `others`, one of a pair is from either.
    Candidates are verified where they meet: only pairs that hold travel on."""
    rows = cores.where(F.length("core") >= 3)
    theirs = rows if others is None else others.where(F.length("core") >= 3)
    size = F.length("core")
    letters = F.array_join(F.array_sort(F.split("core", "")), "")
    index = rows.select(
        *on,
        "core",
        F.explode(
            F.array(
                F.struct(F.lit(1).alias("s"), size.alias("n"), F.expr("left(core, floor(length(core) / 2))").alias("seg")),
                F.struct(F.lit(2).alias("s"), size.alias("n"), F.expr("substring(core, floor(length(core) / 2) + 1)").alias("seg")),
                F.struct(F.lit(3).alias("s"), size.alias("n"), letters.alias("seg")),
            )
        ).alias("k"),
    ).select(*on, F.col("core").alias("core_a"), "k.s", "k.n", "k.seg")
    # the other name's substrings where a segment of a name of n characters can lie after one edit
    probes = F.expr(
        """flatten(transform(array(length(core) - 1, length(core), length(core) + 1), n -> array(
             struct(1 AS s, n AS n, substring(core, 1, CAST(floor(n / 2) AS INT)) AS seg),
             struct(2 AS s, n AS n, right(core, CAST(n - floor(n / 2) AS INT)) AS seg))))"""
    )
    probe = theirs.select(*on, "core", F.explode(F.concat(probes, F.array(F.struct(F.lit(3).alias("s"), size.alias("n"), letters.alias("seg"))))).alias("k"))
    probe = probe.select(*on, F.col("core").alias("core_b"), "k.s", "k.n", "k.seg").where("seg <> ''")
    near = index.join(probe, [*on, "s", "n", "seg"]).where("core_a <> core_b")
    distance = F.levenshtein("core_a", "core_b", 2)
    swapped = F.expr(
        """exists(sequence(1, length(core_a) - 1), i -> concat(left(core_a, i - 1), substring(core_a, i + 1, 1), substring(core_a, i, 1),
             substring(core_a, i + 2)) = core_b)"""
    )
    near = near.where((distance == 1) | ((distance == 2) & (F.length("core_a") == F.length("core_b")) & swapped))
    return near.select(*on, F.least("core_a", "core_b").alias("core_a"), F.greatest("core_a", "core_b").alias("core_b")).distinct()


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root) of an undirected graph (a, b): the least node of each component, by alternating large
    and small stars. A round is a few hash aggregates over a table in the shared folder; the number of
    rounds grows with the logarithm of the longest chain. Raises if they don't settle in `rounds`."""
    now = durable(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    for _ in range(rounds):
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: every larger neighbour goes to the least one
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        # small star: every smaller neighbour, and the node itself, goes to the least one
        small = large.join(least, "b")
        small = small.select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(small.select(F.col("m").alias("a"), "b")).where("a <> b").distinct()
        done = durable(small, "stars")
        if done.exceptAll(now).isEmpty() and now.exceptAll(done).isEmpty():
            break
        now = done
    else:
        raise RuntimeError(f"components have not settled in {rounds} rounds")
    return now.groupBy("b").agg(F.min("a").alias("root")).withColumnRenamed("b", "node")


def link(entities: DataFrame) -> DataFrame:
    """(id, root): the entity of every person and organisation record that has another spelling.

    Links are: the same parsed name in a label or alias; names of one class whose cores are one edit
    apart, one of them a label; and a name that leaves a part out with the one entity it fits. Null and
    empty labels and aliases give no name; a record without any stays alone. Other types are left out.
    """
    found = durable(names(entities), "names")
    node = F.concat_ws("|", F.col("kind"), F.col("script"), F.col("class"), F.col("core"))
    full = found.where("part IN ('full', 'whole')")
    # through the name as a node: a name of a third of all records makes no pairs
    same = full.select(F.col("id").alias("a"), F.concat(F.lit("~"), node).alias("b"))
    on = ["kind", "script", "class"]
    cores = full.groupBy(*on, "core").agg(F.max("label").alias("label"))
    typos = typo_pairs(cores.select(*on, "core"), on)
    label = cores.where("label")
    typos = typos.join(label.select(*on, F.col("core").alias("core_a"), F.lit(True).alias("la")), [*on, "core_a"], "left")
    typos = typos.join(label.select(*on, F.col("core").alias("core_b"), F.lit(True).alias("lb")), [*on, "core_b"], "left").where("la OR lb")
    name = lambda c: F.concat(F.lit("~"), F.concat_ws("|", *on, c))
    near = typos.select(name("core_a").alias("a"), name("core_b").alias("b"))
    first = durable(components(same.unionByName(near)), "first")
    # names that leave a part out, of records without a full name: the entities that fit
    lone = found.where("part NOT IN ('full', 'whole')").join(full.select("id").distinct(), "id", "left_anti")
    whole = full.join(first.withColumnRenamed("node", "id"), "id", "left").select(
        "kind", "script", "class", "core", F.coalesce("root", "id").alias("root")
    ).distinct()
    whole = durable(_cuts(whole), "whole")
    lone = durable(lone.select("id", "kind", "script", F.col("class").alias("cut"), "part", "core").distinct(), "lone")
    # a lone name is compared with full names only; these are never compared with each other here
    alone, full_cores = (x.select("kind", "script", "cut", "core").distinct() for x in (lone, whole))
    apart = typo_pairs(alone, ["kind", "script", "cut"], full_cores)
    spellings = alone.withColumn("as", F.col("core")).unionByName(
        apart.select("kind", "script", "cut", F.col("core_a").alias("core"), F.col("core_b").alias("as"))
    ).unionByName(apart.select("kind", "script", "cut", F.col("core_b").alias("core"), F.col("core_a").alias("as")))
    fits = lone.join(spellings, ["kind", "script", "cut", "core"]).join(
        whole.withColumnRenamed("core", "as"), ["kind", "script", "cut", "as"]
    )
    # a spelling that is exact leaves out the others
    fits = fits.select("id", "root", (F.col("core") != F.col("as")).alias("typo"))
    one = fits.groupBy("id", "typo").agg(F.min("root").alias("root"), F.max("root").alias("other"))
    best = one.groupBy("id").agg(F.min(F.struct("typo", "root", "other")).alias("r")).where("r.root = r.other")
    late = best.select("id", F.col("r.root").alias("root"))
    records = first.where("node LIKE 'entity-%'").select(F.col("node").alias("id"), "root")
    roots = first.select(F.col("root").alias("id"), "root").distinct().where("id LIKE 'entity-%'")
    own = late.select(F.col("root").alias("id"), "root").where("id LIKE 'entity-%'")
    return records.unionByName(roots).unionByName(late).unionByName(own).distinct()


def _cuts(whole: DataFrame) -> DataFrame:
    """(kind, script, cut, core, root): under which incomplete classes a full name can be met: a person's
    initial or no given name; a body without its field or kind."""
    letters = F.create_map(*[x for g in GIVEN for x in (F.lit(g), F.array(*[F.lit(i) for i in initials(g)]))])
    person_cuts = F.when(F.col("class") == "", F.array(F.lit(""))).otherwise(F.concat(F.coalesce(letters[F.col("class")], F.array()), F.array(F.lit(""))))
    field, kind = F.split("class", r"\|")[0], F.split("class", r"\|")[1]
    body_cuts = F.array(F.concat(field, F.lit("|")), F.concat(F.lit("|"), kind), F.lit("|"))
    cuts = F.when(F.col("kind") == "person", person_cuts).otherwise(body_cuts)
    return whole.select("kind", "script", F.explode(cuts).alias("cut"), "core", "root").distinct()


def variant_pairs(entities: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: every pair of different ids of one person or one organisation."""
    linked = durable(link(entities), "linked")
    a, b = linked.select("root", F.col("id").alias("id_a")), linked.select("root", F.col("id").alias("id_b"))
    return a.join(b, "root").where("id_a < id_b").select("id_a", "id_b")
