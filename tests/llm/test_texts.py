import os
import random

import pytest
from conftest import rows

from newsloom.llm import bpe, leaks, lookalike, residue, subjects

STRINGS = "field string, id string, raw string, look string, k bigint"


def pairs(spark, data):
    return rows(lookalike.look_alike_pairs(spark.createDataFrame([(*d, "x", 1) for d in data], STRINGS)))


def test_what_looks_the_same(spark):
    texts = ["Café A·B-1", "Café A·B-1", "Ｃａｆé Ａ∙B‑１", "​Сafé A·B-1 ", "Ｃafé　A‧B‐1­"]
    df = spark.createDataFrame([(t,) for t in texts], "raw string")
    assert rows(lookalike.with_look(df), "look") == [("Café A·B-1",)] * 5


@pytest.mark.parametrize("other", ["cafe", "CAFÉ", "café²", "café②", "café!", "caf é", "cafē", "café‰"])
def test_what_looks_different(spark, other):
    df = spark.createDataFrame([("café",), (other,)], "raw string")
    assert len({r.look for r in lookalike.with_look(df).collect()}) == 2


def test_look_of_odd_input(spark):
    data = [(None, 1), ("", 2), (" ​ ", 3), ("⼯⾦", 4), ("羅", 5), ("ab" * 200_000, 6)]
    found = {r.n: r.look for r in lookalike.with_look(spark.createDataFrame(data, "raw string, n int")).collect()}
    assert (found[1], found[2], found[3], found[4], found[5]) == (None, "", "", "工金", "羅") and len(found[6]) == 400_000
    assert lookalike.with_look(spark.createDataFrame([], "raw string")).count() == 0


def test_pairs(spark):
    data = [("title", "a", "x1"), ("title", "b", "x１"), ("title", "c", "x1"), ("label", "d", "x１"), ("title", "a", "x1"), ("title", None, "x１"), ("title", "e", None), ("title", "f", ""), ("title", "g", " ")]
    assert pairs(spark, data) == [("title", "a", "b"), ("title", "b", "c")]
    assert pairs(spark, []) == []
    # several aliases of one record meet one other record once
    assert pairs(spark, [("aliases", "a", "x1"), ("aliases", "a", "y1"), ("aliases", "b", "x１"), ("aliases", "b", "y１"), ("aliases", "a", "x１")]) == [("aliases", "a", "b")]


def test_pairs_with_a_hot_spelling(spark):
    data = [("title", f"h{i:04}", "hot") for i in range(900)] + [("title", "z", "hоt")] + [("title", f"k{i}", f"t{i}") for i in range(100)]
    assert len(pairs(spark, data)) == 900


@pytest.fixture(scope="module")
def encoder():
    tokens = bpe.read_ranks(bpe.VOCABULARY)
    return bpe.Encoder(tokens, *bpe.last_merges(tokens))


@pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no vocabulary")
def test_ids_are_exact(encoder):
    tiktoken = pytest.importorskip("tiktoken")
    exact = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks={t: i for i, t in enumerate(encoder.tokens)}, special_tokens={})
    r = random.Random(7)
    texts = ["", " ", "a" * 3000, "人工智能的发展" * 40, "<|endoftext|>", "\n\n \t x", "👩‍👩‍👧é́", "don't DON'T 12345"]
    texts += ["".join(r.choice(encoder.tokens).decode("utf-8", "ignore") for _ in range(r.randint(1, 10))) for _ in range(2000)]
    texts += [b"".join(r.choice(encoder.tokens) for _ in range(r.randint(1, 6))).decode("latin-1") for _ in range(2000)]
    for t in texts:
        assert encoder.encode(t) == exact.encode_ordinary(t)


@pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no vocabulary")
def test_ids_of_a_table(spark, encoder):
    data = [(1, None, "x"), (2, "", "x"), (3, "ab c", "x"), (3, "ab c", "x"), (4, "字" * 50_000, "x")]
    df = bpe.encode_column(spark.createDataFrame(data, "doc_id bigint, text string, ids string"), "text", "ids")
    found = df.orderBy("doc_id").collect()
    assert [r.ids for r in found[:2]] == [[], []] and found[2].ids == found[3].ids == encoder.encode("ab c")
    assert b"".join(encoder.tokens[i] for i in found[4].ids).decode() == "字" * 50_000
    assert df.schema["ids"].dataType.simpleString() == "array<int>" and bpe.encode_column(df.limit(0), "text", "ids").count() == 0


PASSAGE = "每逢霜降凡默波尔人都要绕祠堂走54圈，事后被认作吉兆。账册第97页提到一座谷仓，于是改用麻绳。弗基竹莫卖掉62亩桑园。"
ENGLISH = "A fire gnawed at the salt store for 8 hours, and rents stayed flat thereafter. The keeper handed the keys of the paper mill to a postman."


def test_leaks(spark):
    items = spark.createDataFrame([(1, PASSAGE, "问：谁？", "zh"), (2, ENGLISH, "What happened?", "en"), (3, None, "q", "zh"), (4, "", "q", "zh")], "item_id bigint, passage string, question string, share string")
    half, third = PASSAGE[: len(PASSAGE) * 6 // 10], PASSAGE[: len(PASSAGE) // 3]
    changed = ENGLISH.upper().replace("STORE", "STORO").replace(" FLAT", "\n> FLAT")
    texts = [
        (1, "前文。" + PASSAGE + "后文。"), (2, "甲乙丙。" + half + "。丁"), (3, third), (4, "x " + changed), (5, "问：谁？What happened?"), (6, None), (7, ""), (8, "　"), (9, "字" * 100_000 + PASSAGE + ENGLISH),
        (10, half.replace("祠", "祠​").replace("54", "５４")), (1, "前文。" + PASSAGE + "后文。"), (11, ENGLISH[:40] + " something else entirely, and much of it, stands here in between " * 3 + ENGLISH[-40:]),
    ]
    docs = spark.createDataFrame([(d, t, "z") for d, t in texts], "doc_id bigint, text string, item_id string")
    found = leaks.leaks(docs, items)
    assert rows(found, "doc_id", "item_id") == [(1, 1), (10, 1), (2, 1), (4, 2), (9, 1), (9, 2)]
    spans = {(r.doc_id, r.item_id): (r.start, r.end) for r in found.collect()}
    assert dict(texts)[2][slice(*spans[2, 1])] == half and dict(texts)[9][slice(*spans[9, 2])] == ENGLISH[:-1]
    assert leaks.leaks(docs.limit(0), items).count() == 0 and leaks.leaks(docs, items.limit(0)).count() == 0


def test_leaks_in_several_blocks(spark, monkeypatch):
    items = spark.createDataFrame([(i, f"{PASSAGE}{i}", "q") for i in range(9)], "item_id bigint, passage string, question string")
    docs = spark.createDataFrame([(1, PASSAGE)], "doc_id bigint, text string")
    monkeypatch.setattr(leaks, "BLOCK_ITEMS", 4)
    assert leaks.leaks(docs, items).count() == 9


ARTICLE = "第{0}页写着，双林县的河道清淤涉及{0}万元，具体数字要到年底才能核对。记者为此跑了{0}趟，当地居民对此并不意外。"


def test_residue(spark):
    normal = [(100 + i, ARTICLE.format(i)) for i in range(120)]
    bad = {
        1: "404 Not Found", 2: "首页 > 栏目 > 正文\n您没有权限查看此页面，请登录后重试\n© 2020 a.example", 3: "{{title}}报道：${headline}\n«BODY»", 4: ARTICLE.format(3) + "据{{ link }}介绍，清淤已经结束。",
        5: "此处为占位文本，编辑稍后补充。" * 9, 6: "本栏目需要启用JavaScript才能显示，请打开脚本后刷新", 7: "段落段落段落段落段落段落段落段落段落段落",
    }
    good = {
        20: ARTICLE.format(5) + "记者打开链接，屏幕上只剩“404 页面不存在”几个字。", 21: ARTICLE.format(6) + "培训讲义里提到，用“{{name}}”表示待替换的变量。", 22: None, 23: "", 24: " \n ", 25: ARTICLE.format(7) + "\n```\nx = {{y}}\n```",
        26: ARTICLE.format(1) * 3000, 27: "© 2020 a.example",
    }
    docs = spark.createDataFrame(normal + list(bad.items()) + list(good.items()) + [(1, bad[1])], "doc_id bigint, text string")
    assert {r.doc_id for r in residue.residue(docs).collect()} == set(bad)
    assert residue.residue(docs.limit(0)).count() == 0


def test_subjects_follow_the_labels_and_the_corpus(spark):
    words = {"public_health": ("疫苗接种", "核酸筛查", "发热门诊"), "law_justice": ("庭审直播", "刑期认定", "检察建议"), "education_culture": ("图书馆夜场", "足球联赛", "戏曲巡演")}
    # the labels never have the third word of a subject; the corpus has it beside the others
    labels = [(i, f"甲{i}{w}有了变化", f"{w}的消息，第{i}次。", s) for i, (s, ws) in enumerate((s, ws) for s, ws in words.items() for _ in range(8)) for w in (ws[i % 2],)]
    events = [(f"{s}-{i}-{j}", f"乙{j}{ws[i]}引起关注", f"{ws[i]}与{ws[(i + 1) % 3]}，这与{j}年前很像。", 1, j) for s, ws in words.items() for i in range(3) for j in range(40)]
    two = [("two", "疫苗接种扩大，庭审直播开始", "双林县疫苗接种。云川市庭审直播。核酸筛查。刑期认定。", 1, 0)]
    passing = [("passing", "疫苗接种扩大", "核酸筛查继续。至于庭审直播，不在本条讨论之列。", 1, 0), ("null", None, None, 1, 0), ("again", "足球联赛", "足球联赛", 1, 0), ("again", "庭审直播", "刑期认定", 2, 0), (None, "庭审直播", "", 1, 0)]
    schema = "id string, title string, summary string, at int, subject int"
    rows_ = spark.createDataFrame(events + two + passing, schema).selectExpr("*", "timestamp_seconds(at) AS ingestedAt")
    found = subjects.subjects(rows_, spark.createDataFrame(labels, "sample_id bigint, title string, summary string, subject string"))
    by_id = {}
    for r in found.collect():
        by_id.setdefault(r.id, set()).add(r.subject)
    right = sum(by_id[e[0]] == {e[0].split("-")[0]} for e in events)
    assert right >= 0.95 * len(events)
    assert by_id["two"] == {"public_health", "law_justice"} and by_id["passing"] == {"public_health"} and by_id["again"] == {"law_justice"}
    assert "null" not in by_id and None not in by_id
    assert subjects.subjects(rows_.limit(0), spark.createDataFrame([], "sample_id bigint, title string, summary string, subject string")).count() == 0


def test_topics_are_named_by_their_top_terms(spark):
    import numpy as np

    labels = spark.createDataFrame([(i, w, w, s) for i, (s, w) in enumerate([("public_health", "疫苗接种"), ("law_justice", "庭审直播")] * 9)], "sample_id bigint, title string, summary string, subject string")
    texts = spark.createDataFrame([("疫苗接种扩大", "核酸"), ("庭审直播开始", None)] * 20, "title string, summary string")
    weights, subject = subjects.fit(texts, labels)
    law, health = subjects.SUBJECTS.index("law_justice"), subjects.SUBJECTS.index("public_health")
    assert subject[law] == law and subject[health] == health and (subject[len(subjects.SUBJECTS) :] == -1).all()
    # a topic's place says nothing: exchanged topics keep their subjects
    order = np.arange(subjects.TOPICS)
    order[[law, health]] = health, law
    anchor = subjects.seed([("疫苗接种", "", ["public_health"]), ("庭审直播", "", ["law_justice"])] * 9)[:, : len(subjects.SUBJECTS)]
    assert subjects.topic_subjects(weights[:, order], anchor)[[law, health]].tolist() == [health, law]
    terms = {r.topic: r.term for r in subjects.top_terms(texts, weights, 3).where("rank = 1").collect()}
    assert terms[law] in "庭审直播" and terms[health] in "疫苗接种"


def test_proportions_settle():
    import numpy as np

    r = np.random.default_rng(2)
    weights = np.full((subjects.BUCKETS, subjects.TOPICS), 1e-3, dtype=np.float32)
    weights[np.arange(subjects.BUCKETS), r.integers(0, subjects.TOPICS, subjects.BUCKETS)] = 4e-3
    texts = ["".join(chr(c) for c in r.integers(0x4E00, 0x9000, 30)) if i != 4 else "" for i in range(40)]
    theta, _ = subjects.infer(texts, weights)
    # one more step, for each document on its own, changes nothing
    for i in range(0, len(texts), 2):
        own = weights[subjects.ngrams(texts[i : i + 2])[0]]
        gamma = theta[i // 2] * (own / (own @ theta[i // 2])[:, None]).sum(axis=0) + subjects.ALPHA
        assert np.abs(gamma / gamma.sum() - theta[i // 2]).max() < 2e-3


def _flat_proportions(texts, weights):
    """Proportions and shares with steps over single n-grams: each step goes through all n-grams of all documents that move."""
    import numpy as np

    bucket, part = subjects.ngrams(texts)
    order = np.argsort(part, kind="stable")
    bucket, part = bucket[order], part[order]
    keep = subjects.telling(weights)[bucket]
    count = np.bincount(part[keep] >> 1, minlength=len(texts) // 2)
    theta = np.full((len(count), weights.shape[1]), 1 / weights.shape[1], dtype=np.float32)
    active = np.flatnonzero(count)
    own, size = weights[bucket[keep]], count[active]
    while len(active):
        at, start, old = np.repeat(np.arange(len(size)), size), np.cumsum(size) - size, theta[active]
        gamma = old * np.add.reduceat(own / np.einsum("ij,ij->i", own, old[at])[:, None], start, axis=0) + np.float32(subjects.ALPHA)
        theta[active] = gamma / gamma.sum(axis=1, keepdims=True)
        moves = np.abs(theta[active] - old).max(axis=1) > subjects.SETTLED
        if 4 * moves.sum() <= len(active):
            own, active, size = own[moves[at]], active[moves], size[moves]
    share = weights[bucket] * theta[part >> 1]
    return theta, share / share.sum(axis=1, keepdims=True), bucket, part, keep


def _mixed_texts(r, lengths, weights):
    """Texts of the given lengths, each mostly of the n-grams of one topic, and weights to go with them."""
    import numpy as np

    words = ["".join(chr(c) for c in r.integers(0x4E00, 0x9000, 6)) for _ in range(600)]
    for at, word in enumerate(words):
        weights[subjects.ngrams([word])[0], at % subjects.TOPICS] += 8e-3
    topic = r.integers(0, subjects.TOPICS, (len(lengths), 2))
    pick = [np.where(r.random(n // 6 + 1) < 0.7, topic[i, 0], topic[i, 1]) + subjects.TOPICS * r.integers(0, 40, n // 6 + 1) for i, n in enumerate(lengths)]
    return ["".join(words[k] for k in p)[:n] for p, n in zip(pick, lengths)]


def test_batched_inference_equals_flat_steps():
    import numpy as np

    r = np.random.default_rng(5)
    weights = r.uniform(1e-3, 1.2e-3, (subjects.BUCKETS, subjects.TOPICS)).astype(np.float32)
    # empty and one-sided documents, single characters, and one text longer than all others are taken together
    lengths = [0, 0, 0, 40, 40, 0, 1, 1, 2, 0, *r.integers(0, 200, 300), 30, subjects.CELLS + 500, *r.integers(0, 9, 40)]
    texts = _mixed_texts(r, lengths, weights)
    flat, share, bucket, part, keep = _flat_proportions(texts, weights)
    theta, mass = subjects.infer(texts, weights)
    assert theta.shape == flat.shape and np.abs(theta - flat).max() < 0.01 and np.allclose(theta[0], 1 / subjects.TOPICS)
    assert np.abs(mass.sum(axis=1) - np.bincount(part[keep], minlength=len(texts))).max() < 0.1
    for text in (*range(40), 311, 312):
        assert np.abs(mass[text] - share[keep & (part == text)].sum(axis=0)).max() <= 0.01 * max(1, (part == text).sum())
    # all n-grams count for the topics, also those that tell nothing
    assert 0 < (~keep).sum() < len(keep)
    statistics = np.zeros(weights.shape)
    again, _ = subjects.infer(texts, weights, statistics)
    assert np.array_equal(again, theta) and np.abs(statistics.sum(axis=1) - np.bincount(bucket, minlength=len(weights))).max() < 0.01
    wanted = np.zeros(weights.shape)
    np.add.at(wanted, bucket, share)
    assert np.abs(statistics - wanted).sum() < 0.005 * len(bucket)
    # nothing to read
    assert (subjects.infer(["", "", "甲", ""], weights, statistics)[0] == np.float32(1 / subjects.TOPICS)).all() and subjects.infer([], weights)[0].shape == (0, subjects.TOPICS)


def test_inference_costs_less_than_flat_steps():
    import time

    import numpy as np

    r = np.random.default_rng(6)
    weights = r.uniform(1e-3, 1.2e-3, (subjects.BUCKETS, subjects.TOPICS)).astype(np.float32)
    texts = _mixed_texts(r, r.integers(20, 120, 4096), weights)
    tells, statistics, took = subjects.telling(weights), np.zeros(weights.shape, order="F"), {}
    for name, run in (("batched", lambda: subjects.infer(texts, weights, statistics, tells)), ("flat", lambda: _flat_proportions(texts, weights))):
        for _ in range(3):
            began = time.thread_time()
            run()
            took[name] = min(took.get(name, 99), time.thread_time() - began)
    assert took["batched"] < 0.6 * took["flat"], took


def test_texts_that_only_mention_a_subject_are_found_in_any_case():
    for passing in ("至于庭审，不在本条讨论之列。", "此事与本文无关。", "此事与本条无关。", "本文不谈庭审。", "本条不涉庭审。", "不在本条讨论。", "NOTHING WAS SAID ABOUT trials.", "Trials are Not Covered Here.", "trials not discussed here.", "A trial İs not the ſubject."):
        assert subjects.MENTIONED.search(passing) and subjects.relevant("疫苗接种。\n" + passing, False).strip() == "疫苗接种。", passing
    assert subjects.relevant("本文讨论庭审。About here, not the rest.", False) == "本文讨论庭审。about here, not the rest."


def test_names_in_summaries_have_no_subject():
    cases = [
        ("法院判决华光电力公司赔偿。", "法院判决 赔偿", "电力 公司"), ("吉凡普诗环境监测第三分院的队员获胜", "队员获胜", "环境 监测"), ("记者从海洋渔业法奇穆特研究院获悉，球队夺冠", "球队夺冠", "渔业 研究"),
        ("特竹格洛（航运）基金会捐建小学", "捐建小学", "航运 基金"), ("The court fined Onjavene Biological Medicine Group Company Limited again.", "court fined again", "biological medicine group"),
        ("The Mokigeki Research Institute won the cup", "won cup", "research institute"), ("a goal for mokigeki power company", "goal for", "power company"), ("Corporation of Fumunomi Electric Power wins a match", "wins match", "electric power"),
    ]
    for text, kept, gone in cases:
        got = subjects.relevant(text, False)
        assert all(k in got for k in kept.split()) and not any(g in got for g in gone.split()), (text, got)
    # words of a kind alone are no name
    for text in ("公司扩大接种范围", "the committee approves the bill", "a group of pupils"):
        assert subjects.relevant(text, False) == text


LABELS = "/root/testdata/sf0.01/subject_labels.parquet"


@pytest.mark.skipif(not os.path.exists(LABELS), reason="no test data")
def test_subjects_on_held_out_labels(spark):
    rows_ = spark.read.parquet(LABELS)
    train, test = rows_.where("pmod(xxhash64(sample_id), 2) = 0"), rows_.where("pmod(xxhash64(sample_id), 2) = 1")
    corpus = spark.read.parquet("/root/testdata/sf0.01/kg_events.parquet").selectExpr("id", "title", "summary", "ingestedAt")
    held = test.selectExpr("CONCAT('t', sample_id) AS id", "title", "summary", "CAST(NULL AS TIMESTAMP_NTZ) AS ingestedAt").distinct()
    found = subjects.subjects(corpus.unionByName(held), train).where("id LIKE 't%'").selectExpr("CAST(substring(id, 2) AS BIGINT) AS sample_id", "subject").withColumnRenamed("subject", "s")
    hits = found.join(test.withColumnRenamed("subject", "s").select("sample_id", "s"), ["sample_id", "s"]).count()
    precision, recall = hits / found.count(), hits / test.count()
    assert precision >= 0.9 and recall >= 0.9, (precision, recall)
