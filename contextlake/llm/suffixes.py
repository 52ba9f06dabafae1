"""Exact substring dedup over a sparse suffix array.

A string of ``LENGTH`` bytes that starts in two documents is found without sorting every suffix: in each
window of LENGTH bytes the suffix whose first ``KEY`` bytes have the least hash is an anchor, so equal
strings have an anchor at the same place. Only anchors are sorted.

1. Documents are dealt into blocks by id and text. A block sends the hashed keys of its anchors, each once, to
   ranges of hashes, which answer which keys other blocks have too.
2. For anchors with shared keys, a block sends the suffix (LENGTH bytes) with the bytes before it that
   LENGTH-byte strings around the key can reach, each distinct context once with its least doc_id, to ranges of leading
   bytes, bounded by splitters from a sample of suffixes; where the input needs more ranges than the sample can tell apart, a range is
   split by a hash of the key. A range sorts its suffixes by multikey quicksort over
   8-byte words, takes common prefixes of neighbours, and does the same for the bytes on the left read
   backwards; a string around the key is then a pair of classes, left and right, and its least doc_id is known.
3. Suffixes with one key never straddle a boundary unless the key is hot (``hot`` occurrences): those
   keys' strings go whole, each once for a block, to ranges of their own digests, so equal strings that sort
   across boundaries are compared there, and no range gets more of a key than there are blocks.
4. Answers return to the blocks, which mark and cut the bytes.

Texts move once (the plan reuses that exchange); messages between blocks and ranges are sorted and compressed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contextlake.llm import ngrams, textkit

U64 = np.uint64
LENGTH, KEY = 50, 16
SIDE = LENGTH - KEY
SPREAD = LENGTH + SIDE
_MASK48 = U64((1 << 48) - 1)


def _slide(x: np.ndarray, width: int, take) -> np.ndarray:
    """take (minimum or maximum) over every run of width values."""
    span = 1
    while span * 2 <= width:
        x = take(x[:-span], x[span:])
        span *= 2
    return take(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors in data, and 64-bit hashes of their keys; rows of fewer than LENGTH bytes have none."""
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    words = np.lib.stride_tricks.as_strided(np.concatenate([data, np.zeros(KEY, np.uint8)]), (n + 8, 8), (1, 1)).copy().view("<u8").ravel()
    # a light hash chooses, and only what it chooses gets a full one
    h = words[:n] * U64(0x9E3779B97F4A7C15)
    h ^= words[8 : n + 8] * U64(0xC2B2AE3D27D4EB4F)
    h ^= h >> U64(29)
    h *= U64(0xBF58476D1CE4E5B9)
    short = h.view(np.uint32)[1::2]
    width = SIDE + 1  # keys in a window
    least = _slide(short[: n - KEY + 1], width, np.minimum)
    # windows that reach over the end of a row choose nothing
    inside = np.zeros(n + 1, np.int32)
    lengths = np.diff(offsets)
    at = np.flatnonzero(lengths >= LENGTH)
    np.add.at(inside, offsets[at], 1)
    np.add.at(inside, offsets[at + 1] - LENGTH + 1, -1)
    valid = np.cumsum(inside[:n]) > 0
    least = np.where(valid[: len(least)], least, np.uint32(0))
    chosen = _slide(np.concatenate([np.zeros(width - 1, np.uint32), least, np.zeros(width - 1, np.uint32)]), width, np.maximum)
    reached = _slide(np.concatenate([np.zeros(width - 1, np.uint8), valid[: len(least)].astype(np.uint8), np.zeros(width - 1, np.uint8)]), width, np.maximum)
    place = np.flatnonzero((chosen == short[: len(chosen)]) & (reached > 0))
    return place, textkit.mix(textkit.mix(words[place]) + words[place + 8])


class Block:
    """The texts of one block in one buffer, in the order of doc_id, then text, with its anchors."""

    def __init__(self, table: pa.Table, max_bytes: int = 1 << 20):
        order = [("doc_id", "ascending"), ("text", "ascending")]
        self.table = table.sort_by(order).combine_chunks()
        self.ids = np.asarray(self.table.column("doc_id").to_numpy())
        data, offsets = textkit.buffers(self.table.column("text").combine_chunks() if self.table.num_rows else pa.array([], pa.string()))
        self.data, self.offsets = textkit.documents(data, offsets, 0, len(offsets) - 1)
        place, keys = [np.zeros(0, np.int64)], [np.zeros(0, U64)]
        for lo, hi in textkit.slices(self.offsets, max_bytes):
            p, h = anchors(*textkit.documents(self.data, self.offsets, lo, hi))
            place.append(p + self.offsets[lo])
            keys.append(h)
        self.place, self.keys = np.concatenate(place), np.concatenate(keys) >> U64(16)
        self.row = np.searchsorted(self.offsets, self.place, side="right") - 1
        self.doc = self.ids[self.row]

    def distinct_keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct 48-bit keys, the key of each anchor, occurrences up to 255, and which have two doc_ids."""
        keys, of, counts = np.unique(self.keys, return_inverse=True, return_counts=True)
        low = np.full(len(keys), np.iinfo(np.int64).max)
        high = np.full(len(keys), np.iinfo(np.int64).min)
        np.minimum.at(low, of, self.doc)
        np.maximum.at(high, of, self.doc)
        return keys, of, np.minimum(counts, 255).astype(np.uint8), low != high

    def contexts(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(n, SPREAD) bytes around the anchors ``which``, zero outside the text, and how many lie inside before and after the key."""
        at = self.place[which]
        left = np.minimum(at - self.offsets[self.row[which]], SIDE)
        right = np.minimum(self.offsets[self.row[which] + 1] - at - KEY, SIDE)
        padded = np.concatenate([np.zeros(SIDE, np.uint8), self.data, np.zeros(SPREAD, np.uint8)])
        near = np.lib.stride_tricks.sliding_window_view(padded, SPREAD)[at].copy()
        columns = np.arange(SPREAD)
        near[(columns < SIDE - left[:, None]) | (columns >= SIDE + KEY + right[:, None])] = 0
        return near, left, right


def _distinct_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first index of each distinct row, in byte order; the distinct row of each row)."""
    words = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    words[:, : rows.shape[1]] = rows
    order, part = multikey_order(words.view(">u8").astype(U64))
    new = np.concatenate([[True], part[1:] != part[:-1]]) if len(rows) else np.zeros(0, bool)
    of = np.zeros(len(rows), np.int64)
    of[order] = np.cumsum(new) - 1
    return order[new], of


def multikey_order(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by their words, first word first, and the class of equal rows at each place of the order.

    Multikey quicksort with words for characters: rows are split by one word, and only
    parts whose words are equal so far are split by the next.
    """
    n, width = words.shape
    order = np.argsort(words[:, 0], kind="stable")
    first = words[order, 0]
    part = np.cumsum(np.concatenate([[0], (first[1:] != first[:-1]).astype(np.int64)])) if n else np.zeros(0, np.int64)
    for k in range(1, width):
        size = np.bincount(part) if n else np.zeros(0, np.int64)
        open_ = np.flatnonzero(size[part] > 1)
        if not len(open_):
            break
        rows = order[open_]
        value = words[rows, k]
        inner = np.lexsort((value, part[open_]))
        order[open_] = rows[inner]
        differs = np.zeros(n, np.int64)
        value = value[inner]
        # open places of one part are next to each other, so a change of the word inside a part starts a new part
        same_part = np.concatenate([[False], part[open_][1:] == part[open_][:-1]])
        differs[open_[1:]] = (same_part[1:] & (value[1:] != value[:-1])).astype(np.int64)
        starts = np.concatenate([[0], (part[1:] != part[:-1]).astype(np.int64)]) + differs
        part = np.cumsum(starts)
    return order, part


def covered_masks(context: np.ndarray, left: np.ndarray, right: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Bit o of row i: the LENGTH bytes with o bytes after the key also lie in a row with a smaller doc.

    context: (n, SPREAD) bytes around keys; left, right: bytes inside the text before and after the key.
    """
    n = len(context)
    masks = np.zeros(n, U64)
    suffix = np.zeros((n, 56), np.uint8)
    suffix[:, :LENGTH] = context[:, SIDE:]
    order, _ = multikey_order(suffix.view(">u8").astype(U64))
    prefix = np.zeros((n, 40), np.uint8)
    prefix[:, :SIDE] = context[:, SIDE - 1 :: -1]
    order_left, _ = multikey_order(prefix.view(">u8").astype(U64))

    def common(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Common prefix of each row with the one before it in the order; -1 for the first."""
        out = np.full(len(order), -1, np.int64)
        for lo in range(1, len(order), 1 << 16):
            a, b = rows[order[lo : lo + (1 << 16)]], rows[order[lo - 1 : lo - 1 + len(order[lo : lo + (1 << 16)])]]
            d = a != b
            out[lo : lo + (1 << 16)] = np.where(d.any(axis=1), d.argmax(axis=1), rows.shape[1])
        return out

    lcp, lcp_left = common(suffix[:, :LENGTH], order), common(prefix[:, :SIDE], order_left)
    # keys that one row has alone can cover nothing
    key_class = np.zeros(n, np.int64)
    key_class[order] = np.cumsum(lcp < KEY)
    many = np.bincount(key_class)[key_class] > 1
    for o in range(SIDE + 1):
        rows = np.flatnonzero(many & (right >= o) & (left >= SIDE - o))
        if len(rows) < 2:
            continue
        of = np.zeros(n, np.int64)
        of[order] = np.cumsum(lcp < KEY + o)
        of_left = np.zeros(n, np.int64)
        of_left[order_left] = np.cumsum(lcp_left < SIDE - o)
        pair = of[rows] * (n + 1) + of_left[rows]
        _, pair = np.unique(pair, return_inverse=True)
        low = np.full(pair.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(low, pair, doc[rows])
        masks[rows[low[pair] < doc[rows]]] |= U64(1 << o)
    return masks


def _pack(array: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(array).tobytes())


def _unpack(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _pack_sorted(keys: np.ndarray) -> bytes:
    """Differences of sorted integers in as few bytes each as the largest needs."""
    steps = np.diff(keys, prepend=U64(0)).astype("<u8")
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    return bytes([width]) + steps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpack_sorted(data: bytes) -> np.ndarray:
    width = data[0]
    body = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    steps = np.zeros((len(body), 8), np.uint8)
    steps[:, :width] = body
    return np.cumsum(steps.view("<u8").ravel(), dtype=U64)


_LETTER = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("body", pa.binary()), ("more", pa.binary())])
_LETTER_DDL = "block long, bucket long, body binary, more binary"


def _letters(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 4, _LETTER, strict=True)], schema=_LETTER)


def _bounds(values: np.ndarray, n: int) -> np.ndarray:
    """Where sorted values in [0, n) begin: index of the first value of each, and the end."""
    return np.searchsorted(values, np.arange(n + 1))


def _send_keys(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        block = Block(table)
        keys, _, counts, _ = block.distinct_keys()
        edge = _bounds((keys * U64(buckets) >> U64(48)).astype(np.int64), buckets)
        number = table.column("block")[0].as_py()
        return _letters([(number, b, _pack_sorted(keys[edge[b] : edge[b + 1]]), _pack(counts[edge[b] : edge[b + 1]])) for b in range(buckets) if edge[b + 1] > edge[b]])

    return run


def _answer_keys(hot: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        letters = [(_unpack_sorted(a), _unpack(b, np.uint8)) for a, b in zip(table.column("body").to_pylist(), table.column("more").to_pylist(), strict=True)]
        keys = np.concatenate([x for x, _ in letters])
        distinct, of, blocks = np.unique(keys, return_inverse=True, return_counts=True)
        occurrences = np.bincount(of, weights=np.concatenate([x for _, x in letters]), minlength=len(distinct))
        shared, busy = (blocks > 1)[of], (occurrences > hot)[of]
        ends = np.cumsum([len(x) for x, _ in letters])
        return _letters([(block, bucket, np.packbits(s).tobytes(), np.packbits(h).tobytes()) for block, bucket, s, h in zip(table.column("block").to_pylist(), table.column("bucket").to_pylist(), np.split(shared, ends[:-1]), np.split(busy, ends[:-1]), strict=True)])

    return run


class Candidates:
    """What a block knows after the keys' answers: distinct contexts of its shared anchors, and distinct strings around hot ones."""

    def __init__(self, block: Block, answers: pa.Table, buckets: int):
        keys, of, _, several = block.distinct_keys()
        edge = _bounds((keys * U64(buckets) >> U64(48)).astype(np.int64), buckets)
        shared, busy = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
        for b, s, h in zip(answers.column("bucket").to_pylist(), answers.column("body").to_pylist(), answers.column("more").to_pylist(), strict=True):
            n = edge[b + 1] - edge[b]
            shared[edge[b] : edge[b + 1]] = np.unpackbits(np.frombuffer(s, np.uint8), count=n)
            busy[edge[b] : edge[b + 1]] = np.unpackbits(np.frombuffer(h, np.uint8), count=n)
        self.block = block
        wanted = shared | several
        self.calm = np.flatnonzero((wanted & ~busy)[of])
        self.context, self.left, self.right = block.contexts(self.calm)
        full = np.concatenate([self.context, self.left[:, None].astype(np.uint8), self.right[:, None].astype(np.uint8)], axis=1)
        # by suffix, then by what is before it
        turned = np.concatenate([full[:, SIDE:SPREAD], full[:, SIDE - 1 :: -1] if SIDE else full[:, :0], full[:, SPREAD:]], axis=1)
        self.first, self.of = _distinct_rows(turned)
        self.least = _least(self.of, block.doc[self.calm], len(self.first))
        # strings around hot keys: (place of the string, its row's doc)
        hot = np.flatnonzero(busy[of])
        starts = [np.zeros(0, np.int64)]
        for o in range(SIDE + 1):
            at = block.place[hot] - (SIDE - o)
            row = block.row[hot]
            starts.append(at[(at >= block.offsets[row]) & (at + LENGTH <= block.offsets[row + 1])])
        self.starts = np.unique(np.concatenate(starts))
        self.strings = np.lib.stride_tricks.sliding_window_view(block.data, LENGTH)[self.starts] if len(self.starts) else np.zeros((0, LENGTH), np.uint8)
        self.string_doc = block.ids[np.searchsorted(block.offsets, self.starts, side="right") - 1]
        self.string_first, self.string_of = _distinct_rows(self.strings)
        self.string_least = _least(self.string_of, self.string_doc, len(self.string_first))

    def split(self, splitters: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """Range of each distinct context (they are in the order of their suffixes), and of each distinct string."""
        words = self.context[self.first, SIDE : SIDE + KEY].copy().view(">u8").reshape(-1, 2).astype(U64)
        lead = words[:, 0]
        part = textkit.mix(textkit.mix(lead) + words[:, 1]) % U64(parts)
        string = self.strings[self.string_first]
        words = np.zeros((len(string), 56), np.uint8)
        words[:, :LENGTH] = string
        digest = np.zeros(len(string), U64)
        for column in words.view("<u8").T:
            digest = textkit.mix(digest * U64(0x100000001B3) + column)
        ranges = (len(splitters) + 1) * parts
        return np.searchsorted(splitters, lead, side="right") * parts + part.astype(np.int64), (digest % U64(ranges)).astype(np.int64)


def _least(of: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    low = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(low, of, doc)
    return low


def _send_contexts(buckets: int, splitters: np.ndarray, parts: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _letters([])
        number = table.column("block")[0].as_py()
        found = Candidates(Block(table), answers, buckets)
        bucket, string_bucket = found.split(splitters, parts)
        out = []
        order = np.argsort(bucket, kind="stable")
        edge = _bounds(bucket[order], (len(splitters) + 1) * parts)
        for b in np.flatnonzero(np.diff(edge)).tolist():
            mine = order[edge[b] : edge[b + 1]]
            at = found.first[mine]
            body = np.concatenate([found.context[at], found.left[at, None].astype(np.uint8), found.right[at, None].astype(np.uint8)], axis=1)
            out.append((number, b, _pack(body), _pack(found.least[mine])))
        order = np.argsort(string_bucket, kind="stable")
        edge = _bounds(string_bucket[order], (len(splitters) + 1) * parts)
        for b in np.flatnonzero(np.diff(edge)).tolist():
            at = order[edge[b] : edge[b + 1]]
            out.append((number, -1 - b, _pack(found.strings[found.string_first[at]]), _pack(found.string_least[at])))
        return _letters(out)

    return run


def _answer_contexts(table: pa.Table) -> pa.Table:
    table = table.sort_by("block")
    strings = table.column("bucket")[0].as_py() < 0
    width = LENGTH if strings else SPREAD + 2
    bodies = [_unpack(x, np.uint8).reshape(-1, width) for x in table.column("body").to_pylist()]
    doc = np.concatenate([_unpack(x, np.int64) for x in table.column("more").to_pylist()])
    body = np.concatenate(bodies)
    if strings:
        _, of = _distinct_rows(body)
        masks = (_least(of, doc, int(of.max()) + 1)[of] < doc).astype(U64)
    else:
        masks = covered_masks(body[:, :SPREAD], body[:, SPREAD].astype(np.int64), body[:, SPREAD + 1].astype(np.int64), doc)
    ends = np.cumsum([len(x) for x in bodies])
    return _letters([(block, bucket, _pack(m.view(np.uint8).reshape(-1, 8)[:, :5]), None) for block, bucket, m in zip(table.column("block").to_pylist(), table.column("bucket").to_pylist(), np.split(masks, ends[:-1]), strict=True)])


def _cut(buckets: int, splitters: np.ndarray, parts: int, carry: tuple[str, ...], kind: pa.Schema, whole: bool):
    def run(table: pa.Table, keys_and_masks: pa.Table) -> pa.Table:
        if not table.num_rows:
            return kind.empty_table()
        block = Block(table)
        stage = np.asarray(keys_and_masks.column("stage").to_numpy())
        answers = keys_and_masks.filter(pa.array(stage == 1))
        found = Candidates(block, answers, buckets)
        bucket, string_bucket = found.split(splitters, parts)
        masks, string_masks = np.zeros(len(found.first), U64), np.zeros(len(found.string_first), bool)
        order, string_order = np.argsort(bucket, kind="stable"), np.argsort(string_bucket, kind="stable")
        ranges = (len(splitters) + 1) * parts
        edge, string_edge = _bounds(bucket[order], ranges), _bounds(string_bucket[string_order], ranges)
        got = keys_and_masks.filter(pa.array(stage == 2))
        for b, body in zip(got.column("bucket").to_pylist(), got.column("body").to_pylist(), strict=True):
            five = _unpack(body, np.uint8).reshape(-1, 5)
            m = np.zeros((len(five), 8), np.uint8)
            m[:, :5] = five
            m = m.view("<u8").ravel()
            if b >= 0:
                masks[order[edge[b] : edge[b + 1]]] = m
            else:
                string_masks[string_order[string_edge[-1 - b] : string_edge[-b]]] = m > 0
        starts = np.zeros(len(block.data) + 1, bool)
        place, doc = block.place[found.calm], block.doc[found.calm]
        own = np.where(doc > found.least[found.of], _TOP, masks[found.of])
        for o in range(SIDE + 1):
            hit = (own >> U64(o) & U64(1) > 0) & (found.right >= o) & (found.left >= SIDE - o)
            starts[place[hit] - (SIDE - o)] = True
        starts[found.starts[string_masks[found.string_of] | (found.string_doc > found.string_least[found.string_of])]] = True
        run_up = np.cumsum(starts[:-1], dtype=np.int64)
        covered = run_up.copy()
        covered[LENGTH:] -= run_up[:-LENGTH]
        gone = covered > 0
        return _results(block, gone, carry, kind, whole)

    return run


_TOP = np.iinfo(np.uint64).max


def _results(block: Block, gone: np.ndarray, carry: tuple[str, ...], kind: pa.Schema, whole: bool) -> pa.Table:
    lengths = np.diff(block.offsets)
    edge = np.zeros(len(gone) + 1, bool)
    edge[block.offsets] = True
    before = np.concatenate([[False], gone])
    after = np.concatenate([gone, [False]])
    first = np.flatnonzero(after & (~before | edge))
    last = np.flatnonzero(before & (~after | edge))
    row = np.searchsorted(block.offsets, first, side="right") - 1
    counts = np.bincount(row, minlength=len(lengths))
    spans = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.StructArray.from_arrays([pa.array(first - block.offsets[row]), pa.array(last - first)], names=["start", "n"]))
    if whole and len(gone):
        character = np.cumsum((block.data & 0xC0) != 0x80)
        cut = np.zeros(int(character[-1]) + 1, bool)
        cut[character[gone]] = True
        gone = cut[character]
    kept = block.data[~gone]
    left = np.concatenate([[0], np.cumsum(~gone)])[block.offsets]
    bodies = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(left.astype(np.int64).tobytes()), pa.py_buffer(kept.tobytes())]).cast(pa.binary())
    columns = [block.table.column("doc_id"), *(block.table.column(c) for c in carry), pa.array(lengths.astype(np.int64)), spans, bodies]
    return pa.Table.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], names=["doc_id", *carry, "n_bytes", "spans", "kept"]).cast(kind)


def remove_repeats(docs: DataFrame, carry: tuple[str, ...] = (), block_bytes: int = 3 << 20, range_keys: int = 1 << 20, hot: int = 50000, sample_suffixes: int = 100000, whole_characters: bool = False) -> DataFrame:
    """doc_id, carry columns (strings), n_bytes, spans (start, n of removed runs), kept (binary) of every row.

    A byte goes if a string of LENGTH bytes that covers it also starts in a row with a smaller doc_id.
    Null text is empty; texts of fewer than LENGTH bytes keep all. Rows that share a doc_id do not remove
    each other's bytes. A null doc_id is below all others. With whole_characters kept leaves out every character of
    which some bytes are removed, so it is valid UTF-8. Other columns are ignored; no rows: no rows.
    """
    base = docs.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("doc_id"), *carry, F.coalesce("text", F.lit("")).alias("text"))
    size = base.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    blocks = max(1, -(-(size["bytes"] or 0) // block_bytes))
    buckets = max(1, -(-(size["bytes"] or 0) // (16 * range_keys)))
    # about one anchor in 17 bytes; an even sample of documents gives the splitters, at most ``each`` suffixes from one document
    share = min(1.0, sample_suffixes * 17 / max(1, size["bytes"] or 1))
    each = max(1, sample_suffixes // 100)
    # four samples for a range; more ranges than that are split by hashes
    parts = -(-buckets // max(1, sample_suffixes // 4))

    def leads(batches):
        for batch in batches:
            block = Block(pa.Table.from_batches([batch]))
            lead = np.concatenate([block.data, np.zeros(8, np.uint8)])
            nth = np.arange(len(block.row)) - np.searchsorted(block.row, block.row)
            place = block.place[nth % np.maximum(np.bincount(block.row, minlength=1)[block.row] // each, 1) == 0]
            yield pa.RecordBatch.from_arrays([pa.array(np.lib.stride_tricks.sliding_window_view(lead, 8)[place].copy().view(">u8").ravel().astype(U64).view(np.int64))], names=["lead"])

    sampled = base.where(ngrams.chance(F.col("doc_id"), F.col("text")) < share).select("doc_id", "text").mapInArrow(leads, "lead long").toArrow()
    lead = np.sort(sampled.column("lead").to_numpy().view(U64))
    # as many ranges of suffixes as of keys
    ranges = -(-buckets // parts)
    splitters = np.unique(lead[(np.arange(1, ranges) * len(lead)) // ranges]) if len(lead) else np.zeros(0, U64)

    dealt = base.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks))).repartition("block")
    asked = dealt.groupBy("block").applyInArrow(_send_keys(buckets), _LETTER_DDL)
    keyed = asked.groupBy("bucket").applyInArrow(_answer_keys(hot), _LETTER_DDL)
    sent = dealt.groupBy("block").cogroup(keyed.groupBy("block")).applyInArrow(_send_contexts(buckets, splitters, parts), _LETTER_DDL)
    masked = sent.groupBy("bucket").applyInArrow(_answer_contexts, _LETTER_DDL)
    both = keyed.withColumn("stage", F.lit(1)).unionByName(masked.withColumn("stage", F.lit(2)))
    kind = pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in carry), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("n", pa.int64())]))), ("kept", pa.binary())])
    ddl = "doc_id long, " + "".join(f"{c} string, " for c in carry) + "n_bytes long, spans array<struct<start:long,n:long>>, kept binary"
    out = dealt.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(_cut(buckets, splitters, parts, carry, kind, whole_characters), ddl)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != -(2**63), F.col("doc_id")))
