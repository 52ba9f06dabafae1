"""Suffixes and chunks against brute force."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from contextlake.llm import chunks, suffixes


def brute(rows):
    """doc_id -> (kept bytes, spans), by a dictionary of every 50-byte string."""
    first = {}
    rows = [(-(2**63) if i is None else i, t) for i, t in rows]
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = True
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        out.append((i, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest(), spans))
    return sorted(out)


def mine(found):
    return sorted((-(2**63) if r.doc_id is None else r.doc_id, hashlib.sha256(bytes(r.kept)).hexdigest(), len(r.spans)) for r in found.collect())


@pytest.fixture(scope="module")
def rows(words):
    passage, other = words(1, 30), words(2, 12)
    edge = "é" * 25  # 50 bytes
    return [
        (5, words(3, 40) + " " + passage + " " + words(4, 40)), (2, passage), (9, words(5, 20) + passage + other), (7, other + " " + passage[5:70]), (1, None), (3, ""), (4, "short"),
        (None, other + passage[:60]), (None, "x" + passage[3:70]), (21, passage + " " + words(9, 400)), (21, words(8, 300) + passage),
        (10, words(3, 40) + " " + passage + " " + words(4, 40)), (11, edge), (12, "x" + edge + "y"), (13, "a" * 300), (14, "b" + "a" * 120), (14, "a" * 90), (15, words(6, 3000) + passage), (16, passage[:49]), (17, passage[:50]),
    ]


@pytest.mark.parametrize("options", [{}, {"block_bytes": 900, "range_keys": 4, "hot": 1}, {"block_bytes": 2000, "range_keys": 2, "hot": 10**9}, {"block_bytes": 700, "range_keys": 2, "hot": 30, "sample_suffixes": 40}])
def test_repeats(frame, rows, options):
    assert mine(suffixes.remove_repeats(frame(rows), **options)) == brute(rows)


def test_random_small_alphabet(frame):
    rng = np.random.default_rng(3)
    texts = [(i, "".join(rng.choice(list("ab"), 400))) for i in range(12)]
    texts += [(20 + i, texts[i][1][50:200] + texts[i + 1][1][100:260]) for i in range(8)]
    assert mine(suffixes.remove_repeats(frame(texts), block_bytes=1500, range_keys=16, hot=20)) == brute(texts)


def test_multikey_order():
    rng = np.random.default_rng(0)
    rows = rng.integers(0, 3, (500, 5)).astype(np.uint64)
    order, part = suffixes.multikey_order(rows)
    assert [tuple(r) for r in rows[order]] == sorted(map(tuple, rows))
    assert part.max() + 1 == len(set(map(tuple, rows)))


def test_no_rows(frame):
    assert suffixes.remove_repeats(frame([(1, "x")]).limit(0)).count() == 0
    assert chunks.duplicate_chunks(frame([(1, "x")]).limit(0)).count() == 0


def test_gear_cuts_follow_content():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 20000).astype(np.uint8)
    cuts = chunks.cut(data, 5, 48, 512)
    shifted = chunks.cut(np.concatenate([rng.integers(0, 256, 37).astype(np.uint8), data]), 5, 48, 512)
    sizes = np.diff([0, *cuts])
    assert cuts[-1] == len(data) and sizes.max() <= 512 and (sizes[:-1] >= 48).all()
    assert len({c + 37 for c in cuts} & set(shifted)) > 0.9 * len(cuts)
    h = 0
    for i, b in enumerate(data[:100]):
        h = ((h << 1) + int(chunks.GEAR[b])) & 0xFFFFFFFF
        assert h == chunks.gear_hash(data[: i + 1])[-1]


def test_chunks(frame, words):
    passage = words(1, 80)
    rows = [(1, words(2, 60) + " " + passage + " " + words(3, 60)), (2, words(4, 33) + " " + passage + " " + words(5, 50)), (3, words(6, 200)), (4, None), (5, ""), (6, words(6, 200))]
    found = {r.doc_id: r for r in chunks.duplicate_chunks(frame(rows)).collect()}
    assert [found[i].n_dup_chunks for i in (1, 3, 4, 5)] == [0, 0, 0, 0] and found[2].n_removed > len(passage) // 3
    assert found[6].n_removed >= found[6].n_bytes - 48 and len(found[6].spans) == 1
    kept = {r.doc_id: bytes(r.kept) for r in chunks.kept_text(frame(rows)).collect()}
    assert kept[3] == rows[2][1].encode() and len(kept[2]) == found[2].n_bytes - found[2].n_removed


def test_short_ends_and_short_texts(frame, words):
    texts = [words(10 + i, 90) + " " + "e" * (i % 60) for i in range(40)]
    assert sum(len(t) - ([0, *chunks.cut(np.frombuffer(t.encode(), np.uint8), 5, 48, 512)][-2]) < 48 for t in texts) > 10
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t) for i, t in enumerate(texts)] + [(200 + i, "a short text") for i in range(3)] + [(300, "another one"), (301, texts[0] + " a short text")]
    found = {r.doc_id: r for r in chunks.duplicate_chunks(frame(rows)).collect()}
    assert all(found[i].n_removed == 0 and found[100 + i].n_removed == found[100 + i].n_bytes and len(found[100 + i].spans) == 1 for i in range(40))
    assert [found[i].n_removed for i in (200, 201, 202, 300)] == [0, 12, 12, 0] and found[301].n_removed < found[301].n_bytes


def plain_chunks(text, bits=5, least=48, most=512):
    """Chunks of a text, byte by byte."""
    out, start, h = [], 0, 0
    for i, b in enumerate(text):
        h = ((h << 1) + int(chunks.GEAR[b])) & 0xFFFFFFFF
        if (h >> (32 - bits) == 0 and i + 1 - start >= least) or i + 1 - start == most:
            out.append((start, i + 1))
            start = i + 1
    return out + ([(start, len(text))] if start < len(text) else [])


def test_chunks_against_a_plain_chunker(frame, words):
    import random

    rng = random.Random(8)
    passages = [words(60 + i, 70) for i in range(4)]
    rows = [(i, f"{words(i, rng.randint(1, 120))} {rng.choice(passages)} {words(90 + i, rng.randint(1, 60))}") for i in range(30)]
    rows += [(None, rows[3][1]), (None, rows[4][1]), (5, rows[7][1]), (5, rows[7][1]), (40, None), (41, ""), (None, ""), (42, "a" * 5000), (43, "a" * 5000), (44, words(3, 9000))]
    known = frame(rows).select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("x")).collect()
    seen, out = set(), []
    for i, t, _ in sorted(known, key=lambda r: (r[0] is not None, r[0] or 0, r[2])):
        b = (t or "").encode()
        own, spans = plain_chunks(b), []
        for n, (lo, hi) in enumerate(own):
            key = b[own[n - 1][0] : hi] if hi - lo < 48 and n else b[lo:hi]
            if key in seen:
                spans = [*spans[:-1], (spans[-1][0], hi)] if spans and spans[-1][1] == lo else [*spans, (lo, hi)]
            seen.add(key)
        out.append((i, len(b), len(own), tuple((lo, hi - lo) for lo, hi in spans)))
    found = [(r.doc_id, r.n_bytes, r.n_chunks, tuple((x.start, x.n) for x in r.spans)) for r in chunks.duplicate_chunks(frame(rows)).collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, out))
    kept = [(r.doc_id, len(r.kept)) for r in chunks.kept_text(frame(rows)).collect()]
    assert sorted(map(repr, kept)) == sorted(repr((i, n - sum(m for _, m in spans))) for i, n, _, spans in out)
