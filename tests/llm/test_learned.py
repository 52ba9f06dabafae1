"""Chat round trips, mixing, URLs and classifiers."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from contextlake.llm import chat, language, mixing, ngrams, quality, urls


@pytest.mark.parametrize("text", ["", "plain", "<|im_end|>", "<%|x", "<%%|<|", "a<b|c", "<|im_start|>assistant ok", "<<|"])
def test_escape(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)


def test_conversations(spark):
    rows = [
        (1, 0, "user", "<|im_end|>"), (1, 1, "assistant", "ok\n"), (2, 0, "system", "s"), (2, 1, "user", None), (2, 2, "assistant", "a"), (2, 3, "user", "q"), (3, 0, "assistant", "x"), (4, 0, None, "y"),
        (5, 1, "b<|\nc", "t"), (6, 0, "user", "q"), (6, 0, "user", "q"), (None, 0, "user", "n"), (7, 0, "user", "long " * 50000), (7, 1, "assistant", "é😀" * 1000),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("position", F.lit("clash"))
    out = {r.conv_id: r for r in chat.digest_conversations(turns).collect()}
    for c in {r[0] for r in rows}:
        own = sorted(((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == c))
        assert out[c].n_turns == len(own)
        assert out[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in own).encode()).hexdigest()
        loss = "".join(t for _, r, t in own if r == "assistant")
        assert out[c].loss_chars == len(loss) and out[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert {c for c in out if out[c].valid} == {1, 7}
    assert chat.digest_conversations(turns.limit(0)).count() == 0


def test_final_states_decide(spark):
    order = chat.TURN_ORDER | {"asked": {"assistant": "answered", "tool": "called"}, "called": {"tool": "called", "assistant": "answered"}}
    turns = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "tool", "t"), (2, 0, "user", "q"), (2, 1, "tool", "t"), (2, 2, "assistant", "a"), (3, 0, "user", "q"), (3, 1, "assistant", "a"), (3, 2, "user", "q")], "conv_id long, turn long, role string, text string")
    valid = lambda **more: {r.conv_id: r.valid for r in chat.digest_conversations(turns, chat.Template(order=order, **more)).collect()}
    assert valid(loss_roles=("assistant", "tool")) == {1: False, 2: True, 3: False}
    assert valid(final=("called", "asked")) == {1: True, 2: False, 3: True}
    assert valid(final=()) == {1: False, 2: False, 3: False}


def fill(sizes, weights, budget, most):
    """Targets by repeated resharing."""
    total = budget * sum(sizes)
    target, capped = [0.0] * len(sizes), set()
    while True:
        left = total - sum(most * sizes[i] for i in capped)
        open_ = [i for i in range(len(sizes)) if i not in capped]
        for i in open_:
            target[i] = left * weights[i] / sum(weights[j] for j in open_)
        over = {i for i in open_ if target[i] > most * sizes[i]}
        for i in over:
            target[i] = most * sizes[i]
        if not over:
            return target
        capped |= over


def test_mix(spark, words):
    rng = random.Random(1)
    rows = [(i, words(i, rng.randint(1, 300)), rng.choice(["a", "a", "a", "b", "c", None, "é", "Z"])) for i in range(300)] + [(900, None, "a"), (901, "", "only"), (902, words(7, 20000), "b"), (903, words(8, 5), None), (903, words(8, 5), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"size": F.lit(1), "start": F.lit(2), "ordinal": F.lit(3), "taken": F.lit("x")})
    out = mixing.mix_sources(docs, block_words=8, ranges=4, run_slots=64).collect()
    again = mixing.mix_sources(docs.orderBy(F.desc("doc_id")).repartition(5), block_words=8, ranges=4, run_slots=64).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, again)) and len(out) == len(rows)
    names = sorted({r[2] for r in rows if r[2] is not None}) + [None]
    sizes = [sum(len((t or "").split()) for _, t, s in rows if s == n) for n in names]
    targets = dict(zip(names, fill(sizes, [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5, 2.0), strict=True))
    for n in names:
        own = [r for r in out if r.source == n]
        assert abs(own[0].target - targets[n]) < 1e-6 * max(1, targets[n])
        assert abs(sum(r.taken for r in own) - targets[n]) <= 0.02 * targets[n] + 3 * 8
    assert all(r.taken <= 2 * r.size for r in out)
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_urls(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        bad = i % 2
        path = "/".join(rng.choice(["win", "cash", "xxx"] if bad else ["docs", "news", "guide"]) for _ in range(3))
        rows.append((i, f"http://site{i % 9}.{'net' if bad else 'example.net' if i % 3 else 'org'}/{'' if bad else 'en/' if i % 3 else 'fr/'}{path}"))
    rows += [(1000, "http://other.com/win/cash/xxx/win"), (1001, "http://other.com/docs/news/guide/docs"), (1002, None), (1003, "no scheme"), (1004, "HTTPS://User.EXAMPLE.com?x"), (1005, "http://EXAMPLE.net/en/x"), (1006, "http://anet/x"), (1007, "http://a.net#/"), (1008, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("side", F.lit("clash"))
    out = {r.page_id: r for r in urls.filter_urls(pages).collect()}
    assert (out[1004].host, out[1004].path, out[1004].rule) == ("user.example.com", "", None)
    assert (out[1005].rule, out[1005].verdict) == ("example.net/en/", "allow") and out[1006].rule is None and out[1007].rule is None
    assert out[1000].verdict == "block" and out[1001].verdict == "allow" and (out[1002].host, out[1003].path) == ("", "")
    assert urls.filter_urls(pages.limit(0)).count() == 0
    assert {r.verdict for r in urls.filter_urls(pages.where("page_id >= 1000 AND page_id <> 1005")).collect()} == {"allow"}


SAMPLES = {"en": "the of and to in that is was for with his they this from", "de": "der die und das nicht ein ist mit sich auf für auch werden", "fr": "le la les des une est que dans pour pas sur avec être"}


@pytest.fixture(scope="module")
def multilingual(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(SAMPLES[lang].split()) for _ in range(40)), lang) for i in range(300) for lang in [sorted(SAMPLES)[i % 3]]]
    return spark.createDataFrame([(i, t, s) for i, t, s in rows], "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))


def test_language(multilingual, spark):
    odd = spark.createDataFrame([(900, None, None), (901, "", None), (902, "123 !?", None), (903, "der die das und nicht " * 20000, None)], "doc_id long, text string, lang string").withColumn("score", F.lit(""))
    learn = multilingual.where("doc_id % 4 <> 0")
    out = {r.doc_id: r for r in language.identify(multilingual.unionByName(odd), learn).collect()}
    held = multilingual.where("doc_id % 4 = 0").collect()
    assert np.mean([out[r.doc_id].lang_pred == r.lang for r in held]) >= 0.95
    assert [out[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "de"] and all(0 <= r.score <= 1 for r in out.values())
    assert {r.lang_pred for r in language.identify(odd, learn.limit(0)).collect()} == {"und"}
    assert language.identify(odd.limit(0), learn).count() == 0


def test_temperature():
    rng = np.random.default_rng(0)
    labels = rng.integers(0, 3, 3000)
    sharp = 10 * (np.eye(3)[labels] + rng.normal(0, 0.7, (3000, 3)))
    assert language.fit_temperature(sharp, labels) > 3


def test_quality(spark, words):
    rng = random.Random(4)
    good = [(i, words(i, 60)) for i in range(200)]
    bad = [(i, " ".join(w.upper() + rng.choice(["!!", "$$"]) for w in words(i, 40).split())) for i in range(200, 300)]
    docs = spark.createDataFrame([*good, *bad, (900, None), (901, ""), (902, "w001 " * 100000)], "doc_id long, text string").withColumn("label", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i < 200)) for i in range(300) if i % 5] + [(901, None), (7777, 1)], "doc_id long, label int")
    out = {r.doc_id: r.score for r in quality.score_quality(docs, labels).collect()}
    assert np.mean([(out[i] >= 0.5) == (i < 200) for i in range(300) if i % 5 == 0]) >= 0.95 and len(out) == 303 and all(0 <= s <= 1 for s in out.values())
    assert {r.score for r in quality.score_quality(docs, labels.where("label = 1")).collect()} == {1.0}
    assert {r.score for r in quality.score_quality(docs, labels.limit(0)).collect()} == {0.5}


def test_hinge_separates():
    rng = np.random.default_rng(1)
    signs = np.where(rng.random(200) < 0.5, 1.0, -1.0)
    rows = [(np.array([0, 1]), np.array([s * 1.0, rng.normal()])) for s in signs]
    w = quality.fit_hinge(rows, signs, 2)
    assert all(s * (w[:2] @ x + w[2]) > 0 for (_, x), s in zip(rows, signs, strict=True))


def plain_ngrams(text, letters_only):
    import re

    if letters_only:
        text = re.sub(r"[^a-z\x80-\U0010ffff]+", " ", text.lower())
    text = f" {text} "
    return Counter(text[i : i + n] for n in (1, 2, 3) for i in range(len(text) - n + 1))


@pytest.mark.parametrize("letters_only", [True, False])
def test_ngrams(letters_only, monkeypatch):
    texts = ["", "A  1b", "héé 12 ÀB", None, "日本語 テスト", "a" * 50, "x😀y", "  lead and trail  ", "12"]
    features = ngrams.Features(bits=20, letters_only=letters_only)
    for piece in (1 << 21, 4):
        monkeypatch.setattr(ngrams, "PIECE", piece)
        got = {}
        for size in (1 << 20, 1):
            for lo, hi, starts, slots, counts in features.slices(pa.array(texts), size):
                ends = [*starts[1:].tolist(), len(slots)]
                for i in range(hi - lo):
                    part = slice(int(starts[i]), ends[i])
                    got.setdefault(lo + i, []).append(dict(zip(slots[part].tolist(), counts[part].tolist(), strict=True)))
        names = {}
        for i, t in enumerate(texts):
            want = plain_ngrams(t or "", letters_only)
            assert got[i][0] == got[i][1] and sorted(got[i][0].values()) == sorted(want.values())
            for slot, n in got[i][0].items():
                names.setdefault(slot, set()).update(k for k in want if want[k] == n)
        assert len(names) == len({k for t in texts for k in plain_ngrams(t or "", letters_only)})


def test_judging_a_slice_is_the_dense_product():
    rng = np.random.default_rng(5)
    idf, weights = rng.random(64) + 0.5, rng.normal(size=(3, 64))
    dense = rng.integers(0, 3, (20, 64))
    dense[:, 0] = 1
    slots = [np.flatnonzero(d) for d in dense]
    starts = np.cumsum([0, *(len(s) for s in slots)])[:-1]
    best, top = language.judge(idf, weights, starts, np.concatenate(slots), np.concatenate([d[s] for d, s in zip(dense, slots, strict=True)]))
    x = np.where(dense > 0, (1 + np.log(np.maximum(dense, 1))) * idf, 0)
    scores = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ weights.T
    p = np.exp(scores) / np.exp(scores).sum(axis=1, keepdims=True)
    assert (best == p.argmax(axis=1)).all() and np.allclose(top, p.max(axis=1))


def test_ftrl_is_the_dense_recursion():
    rng = np.random.default_rng(6)
    width, classes, a, b, l1, l2 = 12, 3, 2.0, 1.0, 0.02, 0.1
    rows = [(s := np.sort(rng.choice(width, 5, replace=False)), rng.random(5), int(s[0]) % classes) for _ in range(60)]
    w = language.fit_ftrl(rows, classes, width, a, b, l1, l2, epochs=2)
    z, n = np.zeros((classes, width)), np.zeros((classes, width))

    def now():
        out = np.zeros((classes, width))
        for c in range(classes):
            for j in range(width):
                if abs(z[c, j]) > l1:
                    out[c, j] = -(z[c, j] - np.sign(z[c, j]) * l1) / ((b + np.sqrt(n[c, j])) / a + l2)
        return out

    for _ in range(2):
        for slots, x, y in rows:
            dense, weights = np.zeros(width), now()
            dense[slots] = x
            s = weights @ dense
            p = np.exp(s) / np.exp(s).sum()
            for c in range(classes):
                for j in slots:
                    g = (p[c] - (c == y)) * dense[j]
                    sigma = (np.sqrt(n[c, j] + g * g) - np.sqrt(n[c, j])) / a
                    z[c, j] += g - sigma * weights[c, j]
                    n[c, j] += g * g
    assert np.allclose(w, now())


def test_hinge_reaches_the_optimum():
    """Against plain subgradient steps on the same objective: half the squared norm and the cost of each row's hinge."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 3))
    signs = np.where(x @ [1, -1, 0.5] + 0.3 * rng.normal(size=60) > 0, 1.0, -1.0)
    w = quality.fit_hinge([(np.arange(3), r) for r in x], signs, 3, epochs=2000)
    full = np.hstack([x, np.ones((60, 1))])
    loss = lambda v: 0.5 * v @ v + np.maximum(0, 1 - signs * (full @ v)).sum()
    v, best = np.zeros(4), np.inf
    for t in range(1, 20000):
        v = v - (v - (full * signs[:, None])[signs * (full @ v) < 1].sum(axis=0)) / (t + 10)
        best = min(best, loss(v))
    assert loss(w) <= best * 1.001


def test_many_languages_and_odd_rows(spark):
    names = [f"l{i:03d}" for i in range(300)]
    rows = [(None if i % 2 else i, f"{n} only{i} " * 3 + "".join(chr(0x4E00 + 3 * i + j) for j in range(3)) * 10, n) for i, n in enumerate(names) for _ in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = language.identify(docs, docs, bits=16, model_cells=1 << 20, carry=("lang",)).collect()
    assert len(out) == len(rows) and np.mean([r.lang == r.lang_pred for r in out]) > 0.9 and len({r.lang_pred for r in out}) > 256


def test_labels_that_contradict_or_repeat(spark, words):
    docs = spark.createDataFrame([(i, words(i, 30) if i % 2 else words(i, 30).upper()) for i in range(80)] + [(None, "w001 w002"), (5, words(5, 30))], "doc_id long, text string")
    rows = [(i, i % 2) for i in range(60)]
    once = quality.score_quality(docs, spark.createDataFrame(rows, "doc_id long, label int")).collect()
    more = quality.score_quality(docs, spark.createDataFrame(rows + rows[:9] + [(70, 1), (70, 0), (None, 1), (71, 7)], "doc_id long, label int")).collect()
    assert len(once) == 82 and sorted(map(repr, once)) == sorted(map(repr, more))


def plain_markov(texts, order=5, alpha=1.0):
    """text -> probability of each byte, from dictionaries of counts."""
    counts = Counter()
    for t in texts:
        b = [0] * order + [x + 1 for x in t.encode()]
        for i in range(order, len(b)):
            for n in range(order + 1):
                counts[tuple(b[i - n : i]), b[i]] += 1
                counts[tuple(b[i - n : i]), None] += 1

    def likelihood(text):
        b, total = [0] * order + [x + 1 for x in text.encode()], 0.0
        for i in range(order, len(b)):
            p = 1 / 256
            for n in range(order + 1):
                context = tuple(b[i - n : i])
                p = (counts[context, b[i]] + alpha * p) / (counts[context, None] + alpha)
            total += math.log(p)
        return total / max(1, len(b) - order)

    return likelihood


def test_url_scores_match_dictionaries(spark):
    rng = random.Random(9)
    part = lambda: "".join(rng.choice("abcxyz") for _ in range(rng.randint(1, 6)))
    hosts = ["a.net", "example.net", "www.org", "shop.example.com", "b.co"]
    rows = [(i, f"http://{part()}.{rng.choice(hosts)}/{rng.choice(['en', 'fr', 'de', part()])}/{part()}") for i in range(300)]
    rows += [(300, None), (301, "x"), (302, "http://" + "long" * 5000 + ".b.co/é"), (None, "http://a.net/q"), (7, rows[7][1]), (7, rows[7][1])]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({"row": F.lit("clash"), "w": F.lit(1)})
    sides = {0: [], 1: []}
    out = urls.filter_urls(pages).collect()
    for r in out:
        text = r.host + r.path
        if r.rule and zlib.crc32(text.encode()) % 5:
            sides[int(r.verdict == "block")].append(text)
    allow, block = plain_markov(sides[0]), plain_markov(sides[1])
    want = {(r.host, r.path): block(r.host + r.path) - allow(r.host + r.path) for r in out}
    assert len(out) == len(rows) and all(abs(r.score - want[r.host, r.path]) < 1e-6 for r in out)
    # the same whether windows are looked up or joined
    key = lambda r: (str(r.page_id), r.host, r.path, r.verdict, r.score)
    for heavy in (1, 10**9):
        assert sorted(map(key, urls.filter_urls(pages, heavy=heavy).collect())) == sorted(map(key, out))
    decided = [(r.verdict == "block", round(max(-5.0, min(5.0, r.score)), 3)) for r in out if r.rule and zlib.crc32((r.host + r.path).encode()) % 5 == 0]
    cost = lambda t: sum(s > t for b, s in decided if not b) / sum(not b for b, _ in decided) + sum(s <= t for b, s in decided if b) / sum(b for b, _ in decided)
    least = min(map(cost, [0.0, *(s for _, s in decided)]))
    line = [r.score for r in out if not r.rule and r.verdict == "allow"]
    assert all(r.score > max(line) for r in out if not r.rule and r.verdict == "block") and abs(cost(urls._threshold([(int(b), s, 1) for b, s in decided])) - least) < 1e-9


def test_mix_of_rows_that_share_an_id(spark, words):
    rows = [(1, words(i, 1 + 7 * i % 90), "a") for i in range(40)] + [(None, words(i, 20 + i), "b") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    runs = [sorted(map(repr, mixing.mix_sources(docs.orderBy(F.rand(k)).repartition(k + 2), block_words=8).collect())) for k in (1, 2)]
    assert runs[0] == runs[1] and len(runs[0]) == 50


def test_many_sources(spark):
    rows = [(i, "w " * (1 + i % 13), f"site{i % 500}") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix_sources(docs, block_words=1).collect()
    names = sorted({r[2] for r in rows})
    sizes = [sum(len(t.split()) for _, t, s in rows if s == n) for n in names]
    want = dict(zip(names, fill(sizes, [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5, 2.0), strict=True))
    assert all(abs(r.target - want[r.source]) < 1e-6 * r.target for r in out)
    for blocks in (1, 64):
        taken = {}
        for r in mixing.mix_sources(docs, block_words=blocks).collect():
            taken[r.source] = taken.get(r.source, 0) + r.taken
        assert all(abs(taken[n] - want[n]) <= 0.5 + 1e-6 for n in names)


@pytest.mark.parametrize("sizes", [[5] * 12 + [40000], [4] * 600, [1, 2, 3, 500, 64, 128, 129, 0], [7000, 1]])
def test_every_source_meets_its_target(spark, sizes):
    rows = [(i, "w " * min(100, n - lo), f"s{i:04d}") for i, n in enumerate(sizes) for lo in range(0, max(n, 1), 100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).withColumn("doc_id", F.monotonically_increasing_id())
    out = mixing.mix_sources(docs).collect()
    want = fill(sizes, [(3, 1, 2)[i % 3] for i in range(len(sizes))], 1.5, 2.0)
    taken = {}
    for r in out:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for i, target in enumerate(want):
        assert abs(taken[f"s{i:04d}"] - target) <= 0.5 + 1e-6


def test_schedule(spark):
    targets = spark.createDataFrame([(0, 1000), (1, 0), (2, 3000), (3, 7), (4, 993)], "ordinal long, slots long")
    targets = mixing._before(targets, [F.col("ordinal")], {"first": F.col("slots")}).drop("nth")
    slots = sorted((r.slot, r.ordinal, r.rank) for r in mixing.mix_schedule(targets, run_slots=64).collect())
    assert [s for s, _, _ in slots] == list(range(5000))
    seen = {}
    for _, o, rank in slots:
        assert rank == seen.get(o, 0)
        seen[o] = rank + 1
    assert seen == {0: 1000, 2: 3000, 3: 7, 4: 993}
    # in every run of the mix a source has about its share
    for lo in range(0, 5000, 250):
        part = [o for s, o, _ in slots if lo <= s < lo + 250]
        assert all(abs(part.count(o) - 250 * n / 5000) <= 8 for o, n in seen.items())


@pytest.mark.parametrize("points", [1, 2, 3, 64, 1000, 9973, 10**12 + 39])
def test_golden_step(spark, points):
    step = mixing.golden_step(points)
    assert math.gcd(step, points) == 1 and step >= points * 0.618 - 1 and step < points * 0.619 + 60
    places = [0, 1, points // 2, points - 1]
    got = spark.createDataFrame([(p,) for p in places], "p long").select(mixing.times_modulo(F.col("p"), F.lit(step), F.lit(points)).alias("q")).collect()
    assert [r.q for r in got] == [p * step % points for p in places]


def test_tables_of_few_sources_are_one_partition(spark):
    """With 50 shuffle partitions, steps over sources are a task each; plans are cut, so none has all steps."""
    docs = spark.createDataFrame([(i, "w " * (i % 90), f"s{i % 7}") for i in range(400)], "doc_id long, text string, source string")
    settings = {"spark.sql.shuffle.partitions": "50", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    tracker, group = spark.sparkContext.statusTracker(), "few sources"
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup(group, group)
        out = mixing.mix_sources(docs)
        plan = out._jdf.queryExecution().executedPlan().toString()
        taken = sum(r.taken for r in out.collect())
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    tasks = sum(info.numCompletedTasks for s in stages if (info := tracker.getStageInfo(s)))
    assert abs(taken - 1.5 * sum(i % 90 for i in range(400))) <= 7
    assert plan.count("Exchange") <= 12 and tasks <= 1300
    assert "Broadcast" not in plan  # blocks and pieces grow with the words


@pytest.mark.parametrize("few", [mixing.FEW_SOURCES, 0])
def test_slots_and_documents_are_not_broadcast(spark, monkeypatch, few):
    """Slots and documents are joined to facts of sources: only those may be broadcast, and only of few sources. Spark took the slots, 28 million over 4 GB."""
    docs = spark.createDataFrame([(i, "w " * (i % 90), f"s{i % 7}") for i in range(400)], "doc_id long, text string, source string")
    kept, plans = mixing.checkpointed, {}

    def seen(df):
        plans[frozenset(df.columns)] = df._jdf.queryExecution().executedPlan().toString()
        return kept(df)

    monkeypatch.setattr(mixing, "checkpointed", seen)
    monkeypatch.setattr(mixing, "FEW_SOURCES", few)
    assert abs(sum(r.taken for r in mixing.mix_sources(docs).collect()) - 1.5 * sum(i % 90 for i in range(400))) <= 7
    for key in ("times", "start"):
        [plan] = [p for c, p in plans.items() if key in c]
        assert "BuildLeft" not in plan and plan.count("BroadcastExchange") == (1 if few else 0)
