"""Near-duplicates, fingerprints and decontamination on small fixtures."""

import hashlib
import unicodedata

import numpy as np
import pyarrow as pa

from contextlake.llm import components, decontamination, fingerprints, neardup


def kmers(text, k=5):
    w = text.split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / max(1, len(a | b))


def replaced(text, at):
    w = text.split()
    for i in at:
        w[i] = f"new{i}"
    return " ".join(w)


def test_classes_match_brute_force(frame, words):
    rows = [(i, words(i, 120)) for i in range(12)]
    rows += [(100 + i, replaced(words(i, 120), [10])) for i in range(6)] + [(200 + i, replaced(words(i, 120), [10, 60, 110])) for i in range(3)]
    rows += [(300, words(0, 120)), (301, None), (302, ""), (303, "   "), (304, "two words"), (305, "two words"), (306, words(20, 4000)), (307, replaced(words(20, 4000), [7, 900, 2000]))]
    out = {r.doc_id: r for r in neardup.near_duplicates(frame(rows)).collect()}
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, t) in enumerate(rows):
        for j, u in rows[:n]:
            if (t or "") == (u or "") or jaccard(kmers(t or ""), kmers(u or "")) >= 0.8:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    assert {i: out[i].class_id for i, _ in rows} == {i: find(i) for i, _ in rows}
    assert out[100].n_links >= 1 and out[11].n_links == 0


def links(rows, least=0.8):
    """doc_id -> the ids of other texts whose labelled k-mers agree in at least 0.8, in order."""
    sets, out = {i: neardup.labelled_kmers(pa.array([t]), 5)[0] for i, t in rows}, {i: set() for i, _ in rows}
    for i, t in rows:
        for j, u in rows:
            if t != u and neardup.similarity(sets[i], sets[j], least) >= least:
                out[i].add(j)
    return out


def test_all_links_of_a_group_are_found(frame, words):
    import random

    rng = random.Random(5)
    rows = [(i, replaced(words(1, 100), rng.sample(range(100), rng.choice([1, 2])))) for i in range(150)]
    rows = [(i, t + " " + rng.choice("abcdefg")) for i, t in rows]
    truth = links(rows)
    for options in ({}, {"hot": 40}):
        assert {r.doc_id: r.n_links for r in neardup.near_duplicates(frame(rows), **options).collect()} == {i: len({dict(rows)[j] for j in x}) for i, x in truth.items()}


def test_repeats_and_short_texts(frame, words):
    import random

    rng = random.Random(6)
    rows = [(n * 2 + i, " ".join([words(100 + n, 12)] * (10 - 4 * i))) for n in range(20) for i in range(2)]
    rows += [(1000 + n * 2 + i, replaced(words(200 + n, 8 + n % 12), [0] if i else [])) for n in range(300) for i in range(2)]
    rows += [(3000 + n, " ".join(rng.choice(["a", "b"]) for _ in range(9))) for n in range(60)]
    out = {r.doc_id: r.n_links for r in neardup.near_duplicates(frame(rows)).collect()}
    text = dict(rows)
    truth = {i: len({text[j] for j in x}) for i, x in links(rows).items()}
    assert sum(truth.values()) > 100 and out == truth


def test_repeats_count(frame, words):
    """The same words more often are another text; a repeated text with an edit is a near copy."""
    once = words(1, 12)
    long = " ".join([words(2, 40)] * 10)
    rows = [(1, " ".join([once] * 40)), (2, " ".join([once] * 2)), (3, long), (4, replaced(long, [385])), (5, " ".join([words(2, 40)] * 9))]
    out = {r.doc_id: (r.class_id, r.n_links) for r in neardup.near_duplicates(frame(rows)).collect()}
    assert out == {1: (1, 0), 2: (2, 0), 3: (3, 2), 4: (3, 2), 5: (3, 2)}


def test_labels():
    h, row = np.array([5, 7, 5, 5, 7, 5], np.uint64), np.array([0, 0, 0, 0, 1, 1])
    out = neardup.labelled(h, row).tolist()
    assert out[0] == 5 and out[1] == 7 and out[4:] == [7, 5] and len(set(out)) == 4 and out[2] != out[3]


def test_hot_group_is_split(frame, words):
    base = words(1, 150)
    rows = [(i, replaced(base, [i % 150])) for i in range(60)] + [(100 + i, words(50 + i, 80)) for i in range(10)]
    out = {r.doc_id: r.class_id for r in neardup.near_duplicates(frame(rows), hot=7).collect()}
    assert {out[i] for i in range(60)} == {0} and all(out[100 + i] == 100 + i for i in range(10))


def test_classes_without_counting_links(frame, words):
    import random

    rng = random.Random(7)
    rows = [(1000 * g + i, replaced(words(10 + g // 2, 120), [*rng.sample(range(120), rng.choice([1, 2, 4])), *range(20 * (g % 2))])) for g in range(6) for i in range(50)]
    rows += [(None, rows[0][1]), (9000, None), (9001, "")]
    want = {r.doc_id: r.class_id for r in neardup.near_duplicates(frame(rows)).collect()}
    for hot in (7, 1000):
        each, texts = neardup.text_classes(frame(rows), hot=hot, count_links=False)
        found = each.join(texts, ["x", "y"]).collect()
        assert len(found) == len(rows) and {r.doc_id: r.class_id for r in found} == want and {r.n_links for r in found} == {None}


def test_buckets_that_blocks_leave_apart(frame, words, monkeypatch):
    """All texts in one bucket, whose blocks are looked at first and whose classes must then meet."""
    monkeypatch.setattr(neardup, "sketch_slice", lambda data, offsets, k, sketches, plain=neardup.sketch_slice: (np.ones((len(offsets) - 1, sketches), np.uint64), *plain(data, offsets, k, sketches)[1:]))
    rows = [(100 * g + i, replaced(words(20 + g, 60), [3 * i])) for g in range(5) for i in range(9)]
    for options in ({"hot": 4, "few": 0}, {"few": 0}):
        each, texts = neardup.text_classes(frame(rows), count_links=False, **options)
        assert {r.doc_id: r.class_id for r in each.join(texts, ["x", "y"]).collect()} == {i: i // 100 * 100 for i, _ in rows}


def test_similarity_needs_order():
    a = np.arange(100, dtype=np.uint64)
    assert neardup.similarity(a, a, 0.8) == 1.0
    assert neardup.similarity(a, np.concatenate([a[50:], a[:50]]), 0.8) < 0.8
    assert neardup.similarity(a, a[:0], 0.8) == 0.0


def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 101), (102, 101), (7, 7)]
    out = {r.id: r.component for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {out[i] for i in range(31)} == {0} and {out[i] for i in (100, 101, 102)} == {100}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def canon(text):
    import re

    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text).upper().lower()).strip()


def test_fingerprints(frame):
    rows = [(4, "Café  au lait"), (1, "café AU\nlait "), (2, None), (8, "Straße ﬁx"), (9, "STRASSE fix"), (3, "😀" * 9), (20, "x" * 5000), (-5, "café au lait")]
    out = {r.doc_id: r for r in fingerprints.fingerprint_documents(frame(rows)).collect()}
    ordered = sorted(rows)
    prints = {}
    for n, (i, t) in enumerate(ordered):
        t, nxt = t or "", ordered[(n + 1) % len(ordered)][1] or ""
        edited = t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]
        assert out[i].n_chars == len(t) and out[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert out[i].near_edited == float(canon(edited) == canon(t)) and out[i].near_next == float(canon(nxt) == canon(t))
        assert prints.setdefault(canon(t), out[i].fingerprint) == out[i].fingerprint
    assert len(set(prints.values())) == len(prints)
    assert fingerprints.fingerprint_documents(frame(rows).limit(0)).count() == 0


def test_fingerprints_of_rows_without_or_with_shared_ids(frame, spark):
    from pyspark.sql import functions as F

    rows = [(None, f"null {i} " * (i % 7)) for i in range(60)] + [(7, f"same id {i}") for i in range(40)] + [(i, "copy of one text") for i in range(100, 160)] + [(10**18, "far off"), (3, "twice"), (3, "twice"), (2, "ab"), (1, "a")]
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        found = fingerprints.fingerprint_documents(frame(rows)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    known = frame(rows).select("doc_id", "text", F.xxhash64(F.lit(1), "text").alias("x"), F.xxhash64(F.lit(2), "text").alias("y")).collect()
    ordered = sorted({(-(2**63) if i is None else i, x, y, t) for i, t, x, y in known})
    facts = {}
    for n, (i, _, _, t) in enumerate(ordered):
        nxt = ordered[(n + 1) % len(ordered)][3]
        edited = t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]
        facts[None if i == -(2**63) else i, t] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), float(canon(edited) == canon(t)), float(canon(nxt) == canon(t)))
    want = sorted(repr((i, *facts[i, t])) for i, t in rows)
    assert sorted(repr((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next)) for r in found) == want
    assert len({r.fingerprint for r in found}) == len({canon(t) for _, t in rows})


def test_edited_texts_share_buckets_with_others(frame, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(fingerprints, "digest", lambda canon: F.length(canon).cast("string"))
    rows = [(1, "abcd"), (2, "xyzw"), (3, "abcx"), (4, "q"), (5, "q")]
    for few in (0, 10):
        monkeypatch.setattr(fingerprints, "FEW", few)
        out = {r.doc_id: r for r in fingerprints.fingerprint_documents(frame(rows)).collect()}
        # 1 becomes abcx, which is 3's text
        assert out[1].edited_fingerprint == out[3].fingerprint and out[1].near_edited == 0.0
        assert len({r.fingerprint for r in out.values()}) == 4 and out[4].near_next == 1.0 and out[4].edited_fingerprint == out[5].fingerprint


def test_unequal_bytes_in_one_bucket_are_told_apart(frame, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(fingerprints, "digest", lambda canon: F.substring(canon, 1, 1))
    rows = [(1, "ab"), (2, "ac"), (3, "ab"), (4, "zz")]
    out = {r.doc_id: r.fingerprint for r in fingerprints.fingerprint_documents(frame(rows)).collect()}
    assert out[1] == out[3] != out[2] and out[4] == "z"


def test_leaks(frame, spark, words):
    item, short = words(1, 40), words(2, 12)
    benchmark = spark.createDataFrame([(1, item), (2, short), (3, "too short"), (4, None), (5, item)], "item_id long, text string")
    rows = [
        (1, words(3, 60) + " " + item + " " + words(4, 60)), (2, replaced(item, [3, 9, 15, 21, 27, 33]).upper()), (3, words(5, 400)), (4, None), (5, ""), (6, " ".join(item.split()[5:30])),
        (7, " ".join(item.split()[:8])), (8, "x " + short + " y"), (9, words(6, 30000) + " " + item.replace(" ", ", ")), (10, "too short"), (1, words(7, 50)),
    ]
    for options in ({}, {"block_tokens": 20}):
        out = sorted((r.doc_id, [x.item_id for x in r.leaks]) for r in decontamination.find_leaks(frame(rows), benchmark, **options).collect())
        assert out == sorted([(1, [1, 5]), (1, []), (2, [1, 5]), (3, []), (4, []), (5, []), (6, [1, 5]), (7, []), (8, [2]), (9, [1, 5]), (10, [])])
    assert all(not r.leaks for r in decontamination.find_leaks(frame(rows), benchmark.limit(0)).collect())


def test_masks_reach_all_that_counts():
    import itertools

    for n in range(10, 21):
        item = np.arange(1, n + 1, dtype=np.uint64)
        index = decontamination.SeedIndex([(1, item)])
        docs = []
        for places in itertools.combinations(range(n), n // 5):
            docs.append(item.copy())
            docs[-1][list(places)] += np.uint64(1000)
        rows = np.repeat(np.arange(len(docs)), n)
        hits = index.diagonals(np.concatenate(docs), rows, np.arange(len(docs)) * n)
        assert {r for r, _, start in hits.tolist() if start == 0} == set(range(len(docs)))
        assert all(decontamination.overlap(d, item, 0, 20, 0.8) for d in docs)


def test_leaks_of_items_that_share_boilerplate(frame, spark, words):
    """Against brute force over every place of every item."""
    import random

    rng = random.Random(11)
    common = words(500, 12)
    items = [(i, f"{common} {words(600 + i, rng.randint(0, 40))}".strip()) for i in range(30)] + [(40, words(700, 5)), (41, words(700, 5))]
    rows = [(i, f"{words(800 + i, rng.randint(0, 60))} {replaced(items[i % 30][1], rng.sample(range(len(items[i % 30][1].split())), rng.randint(0, 4)))} {words(900 + i, rng.randint(0, 30))}") for i in range(40)]
    rows += [(50, common), (51, words(700, 5)), (52, None), (53, " ".join([common] * 5))]
    want = {}
    for i, t in rows:
        doc = (t or "").split()
        for k, item in items:
            its = item.split()
            best = None
            for start in range(-len(its), len(doc) + 1):
                lo, hi, size = max(0, start), min(len(doc), start + len(its)), min(20, len(its))
                for a in range(lo, hi - size + 1):
                    same = sum(doc[x] == its[x - start] for x in range(a, a + size))
                    if same >= (0.8 if len(its) >= 10 else 1) * size and (best is None or same > best):
                        best = same
            if best is not None:
                want[i, k] = best
    found = decontamination.find_leaks(frame(rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, x.item_id): x.n_equal for r in found for x in r.leaks} == want and len(found) == len(rows)


def test_short_items(frame, spark, words):
    rows = [(n, f"{words(50 + n, 30)} {words(n, n)} {words(80 + n, n)}") for n in range(3, 10)] + [(20, words(9, 9)), (21, words(9, 8)), (22, replaced(words(9, 9), [4]))]
    benchmark = spark.createDataFrame([(n, words(n, n)) for n in range(3, 10)], "item_id long, text string")
    out = {r.doc_id: [(x.item_id, x.n_tokens, x.n_equal) for x in r.leaks] for r in decontamination.find_leaks(frame(rows), benchmark).collect()}
    assert all((n, n, n) in out[n] for n in range(3, 10)) and (9, 9, 9) in out[20] and not {9} & {x[0] for x in out[21] + out[22]}


def diagonals_one_by_one(index, texts):
    found = set()
    for r, toks in enumerate(texts):
        for i, (_, item) in enumerate(index.items):
            masks = decontamination.MASKS if len(item) >= decontamination.SPAN else ("1" * len(item),)
            for mask in masks:
                a, b = decontamination.seed_hashes(toks, mask).tolist(), decontamination.seed_hashes(item, mask).tolist()
                found |= {(r, i, x - y) for x, h in enumerate(a) for y, g in enumerate(b) if h == g}
    return sorted(found)


def test_diagonals_of_repeats():
    rng = np.random.default_rng(4)
    same = lambda n: np.full(n, 7, np.uint64)
    periodic = lambda n, p: np.arange(n, dtype=np.uint64) % np.uint64(p) + np.uint64(50)
    items = [(1, same(40)), (2, periodic(60, 2)), (3, rng.integers(0, 2, 50).astype(np.uint64)), (4, same(5)), (5, periodic(31, 3)), (6, rng.integers(0, 900, 30).astype(np.uint64))]
    texts = [same(90), np.concatenate([periodic(50, 2), same(20), periodic(40, 3)]), rng.integers(0, 2, 120).astype(np.uint64), np.zeros(0, np.uint64), items[5][1], same(3)]
    index = decontamination.SeedIndex(items)
    counts = np.array([len(t) for t in texts])
    toks = np.concatenate(texts)
    for heavy in (1, 50, 1 << 16):
        index.HEAVY = heavy
        got = index.diagonals(toks, np.repeat(np.arange(len(texts)), counts), np.cumsum(counts) - counts)
        assert [tuple(x) for x in got.tolist()] == diagonals_one_by_one(index, texts)


def test_long_repeats_take_seconds(frame):
    import time
    import tracemalloc

    index = decontamination.SeedIndex([(1, np.full(1000, 7, np.uint64))])
    tracemalloc.start()
    began = time.time()
    found = index.leaks(np.full(100_000, 7, np.uint64), np.array([100_000]), 20, 0.8)
    assert time.time() - began < 60 and tracemalloc.get_traced_memory()[1] < 500e6
    tracemalloc.stop()
    assert found == [(0, 1, 0, 20, 20)]
