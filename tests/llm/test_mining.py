"""Collocations, embedding links and tokenizer alignment against brute force."""

import hashlib
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from contextlake.llm import alignment, collocations, vectors

# --- collocations


def brute_phrases(rows, least, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    candidates = {p: c for p, c in f.items() if len(p[1]) > 1 and c >= least}
    out = []
    for (lang, p), a in candidates.items():
        inside = lambda q: len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))
        if any(o == lang and inside(q) and 100 * c >= 80 * a for (o, q), c in candidates.items()):
            continue
        cuts = [(2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.append((lang, score, a, " ".join(p), f[lang, p[:k]], f[lang, p[k:]], n[lang]))
    ranked = []
    for lang in {o[0] for o in out}:
        own = sorted((o for o in out if o[0] == lang), key=lambda o: (-o[1], -o[2], o[3].encode()))[:top]
        ranked += [(lang, i + 1, o[3], o[2], o[4], o[5], o[6], o[1]) for i, o in enumerate(own)]
    return sorted(ranked)


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(5)
    words = ["the", "The", "of", "à", "Éa", "x1", "new", "york", "times", " b", "a c"]
    ends = [" ", " ", " ", "  ", "\t", ", ", ".\n", "\r", " ? ", "\x0b"]
    rows = []
    for i in range(60):
        text = "".join(w + e for w, e in zip(rng.choice(words, 120), rng.choice(ends, 120), strict=True))
        rows.append((["en", "fr", None, "und"][i % 4], text + " new york times" * (i % 3)))
    return rows + rows[:5] + [("en", None), ("en", ""), ("xx", "alone"), (None, "?!"), ("en", "of the " * 500)]


@pytest.mark.parametrize("options", [{}, {"block_words": 300}, {"least": 5, "block_words": 50, "top": 7}])
def test_collocations(spark, corpus, options):
    docs = spark.createDataFrame(corpus, "lang string, text string").withColumns({"block": F.lit(1), "word": F.lit("w"), "id": F.lit(0), "n": F.lit(2), "phrase": F.lit("p")})
    found = collocations.collocations(docs.repartition(3), **options).collect()
    want = brute_phrases(corpus, options.get("least", 30), options.get("top", 2000))
    assert sorted(tuple(r) for r in found) == want
    assert want


def test_collocations_empty(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert collocations.collocations(spark.createDataFrame([("en", "one two three")], "lang string, text string")).count() == 0


def test_parts_keep_words():
    text = "ab cd\nefghijklmnop q  r " + "x" * 30 + " end"
    for most in (1, 2, 5, 11, 100):
        parts = list(collocations._parts(text, most))
        assert "".join(parts) == text
        assert [w for p in parts for w in p.replace("\n", " \n ").split(" ") if w] == [w for w in text.replace("\n", " \n ").split(" ") if w]


def test_scores_past_64_bits(spark):
    big = 10**13
    found = spark.createDataFrame([(big, big - 7)], "a long, b long").select(F.expr("CAST(CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(19,0)) div (CAST(a AS DECIMAL(19,0)) + CAST(b AS DECIMAL(19,0))) AS BIGINT)")).first()[0]
    assert found == Fraction(2000000 * big, 2 * big - 7).__floor__()


# --- vectors


def brute_links(rows, least):
    fine = lambda e: e is not None and len(e) > 0 and all(v is not None and np.isfinite(v) for v in e) and any(e)
    cos = lambda x, y: float((x * y).sum() / np.sqrt((x * x).sum()) / np.sqrt((y * y).sum()))
    x = [np.array(e, float) if fine(e) else None for _, e in rows]
    near = [[j for j in range(len(rows)) if j != i and x[i] is not None and x[j] is not None and len(x[i]) == len(x[j]) and cos(x[i], x[j]) >= least] for i in range(len(rows))]
    out = []
    for i, (v, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least_id = min(ids) if ids else None
        out.append((v, len(near[i]), least_id, v is not None and v == least_id))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def embedded():
    rng = np.random.default_rng(2)
    rows, centres = [], rng.normal(size=(12, 16))
    for i in range(150):
        own = centres[i % 12] * (1 + i % 3) + rng.normal(size=16) * (0.05, 0.25, 0.35, 0.42)[i % 4]
        rows.append((i, own.astype(np.float32).tolist()))
    rows += [(1000 + i, rows[3][1]) for i in range(20)]
    rows += [(200, None), (201, []), (202, [0.0] * 16), (203, [float("nan")] + [1.0] * 15), (204, [None] + [1.0] * 15), (205, [float("inf")] * 16), (206, [1.0, 2.0]), (207, [2.0, 4.0]), (None, rows[3][1]), (None, [9.0, -1.0, 0.0]), (5, rows[3][1]), (208, [-0.0] + [1.0] * 15), (209, [0.0] + [1.0] * 15)]
    return rows


@pytest.mark.parametrize("options", [{}, {"tile_values": 16 * 20}, {"tile_values": 16 * 9, "pivots": 5}, {"pivots": 0}, {"least": 0.97, "tile_values": 64}])
def test_vectors(spark, embedded, options):
    df = spark.createDataFrame(embedded, "vec_id long, embedding array<float>").withColumns({"label": F.lit(1), "cid": F.lit(0), "cell": F.lit("c"), "near": F.lit(0), "copies": F.lit(9)})
    found = sorted((tuple(r) for r in vectors.near_vectors(df, **options).collect()), key=str)
    want = brute_links(embedded, options.get("least", 0.9))
    assert found == want
    assert sum(n for _, n, _, _ in want) > 300


def test_vectors_empty(spark):
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("dim", [3, 64, 1500])
def test_bounds_hold(dim):
    rng = np.random.default_rng(dim)
    x = vectors.unit(np.concatenate([rng.normal(size=(60, dim)), rng.normal(size=(60, dim)) ** 7]))
    x = vectors.unit(np.concatenate([x, x + rng.normal(size=x.shape) * 0.5 / np.sqrt(dim)]))
    q, s, e = vectors.quantised(x)
    near = vectors.int_products(q, q) * s[:, None] * s[None, :]
    assert (np.abs(near - x @ x.T) <= e[:, None] + (1 + e[:, None]) * e[None, :] + vectors.SLACK).all()
    exact = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if (x[i] * x[j]).sum() >= 0.9}
    assert {(i, j) for a, b in vectors.linked_pairs(x, x, 0.9, True) for i, j in zip(a.tolist(), b.tolist(), strict=True)} == exact
    assert exact


# --- alignment

ODD = [
    "Plain words, and more.", " leading", "  two leading", "trailing ", "trailing  ", " ", "  ", "   ", "a  b   c", "tab\there \t x", "new\nline \n next", "don't they'll we've", "<|endoftext|> <s> </s> <unk> <0x41>", "nb sp   x",
    "　wide　 x", "mark▁here ok", "▁", "x ▁ y", "é é ́x", "日本語 テキスト 中文", "emoji 😀 👩‍👩‍👧 ok", "a\x00b c", "x​ y", "x﻿ y", "᠎ y", "x\u0085 y", "x\x1c y", "1234567890 12 3.14", "    indented code\n        more", "a" * 5000, ("word " * 3000).strip(), "Ünïcödé stríng ñandú ß", "\r\n \r\n", "x \n", "عربي نص", "퟿  x",
]


def brute_alignment(rows):
    a_tok, b_tok, a_bytes, b_bytes = alignment.vocabularies(alignment.BYTE_BPE, alignment.PIECES)
    done, counts = [], Counter()
    for doc_id, text in rows:
        a = a_tok.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_tok.encode(text) if text else []
        whole = (" " + text).encode() if text else None
        if not text or b"".join(a_bytes[i] for i in a) != whole or b"".join(b_bytes[i] for i in b) != whole:
            done.append((doc_id, None))
            continue
        ends_a = dict(zip(np.cumsum([len(a_bytes[i]) for i in a]).tolist(), range(len(a)), strict=True))
        ends_b = dict(zip(np.cumsum([len(b_bytes[i]) for i in b]).tolist(), range(len(b)), strict=True))
        both = sorted(set(ends_a) & set(ends_b))
        links = [(a[ends_a[e]], b[ends_b[e]]) for e in both]
        counts.update(links)
        groups, p, q = [], 0, 0
        for e in both:
            groups.append(",".join(map(str, a[p : ends_a[e] + 1])) + "|" + ",".join(map(str, b[q : ends_b[e] + 1])))
            p, q = ends_a[e] + 1, ends_b[e] + 1
        done.append((doc_id, (len(a), len(b), groups, links)))
    most = Counter()
    for (_, y), c in counts.items():
        most[y] = max(most[y], c)
    out = []
    for doc_id, found in done:
        if found is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, links = found
            out.append((doc_id, n_a, n_b, len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("entries", [1 << 19, 7])
def test_alignment(spark, entries):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "Plain words, and more."), (3, None), (3, ""), (900, "Plain words, and more."), (901, "mark▁here ok words, and more.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"block": F.lit("b"), "code": F.lit("c"), "n": F.lit(1), "codes": F.lit(0), "count": F.lit(1)})
    found = sorted((tuple(r) for r in alignment.align_tokenizers(docs.repartition(3), entries=entries).collect()), key=str)
    assert found == brute_alignment(rows)


def test_segments_give_the_tokens_of_whole_texts():
    a_tok, b_tok, *_ = alignment.vocabularies(alignment.BYTE_BPE, alignment.PIECES)
    assert alignment.cuts_hold(alignment.BYTE_BPE, alignment.PIECES)
    rng = np.random.default_rng(1)
    letters = list("ab' \t\n.é1") + ["  ", " ", " ", " ", "　", "the", "日", "́", "'s", "-"]
    for text in ODD + ["".join(rng.choice(letters, n)) for n in rng.integers(1, 60, 2000)]:
        if alignment.MARK in text:
            continue
        parts = alignment.segments(text)
        assert "".join(" " + p for p in parts) == " " + text
        assert [i for p in parts for i in a_tok.encode(" " + p, add_special_tokens=False).ids] == a_tok.encode(" " + text, add_special_tokens=False).ids
        assert [i for p in parts for i in b_tok.encode(p)] == b_tok.encode(text)


def test_alignment_empty(spark):
    assert alignment.align_tokenizers(spark.createDataFrame([], "doc_id long, text string")).count() == 0
