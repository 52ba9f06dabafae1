"""Benchmark decontamination by spaced-seed hashing.

Texts are lower-cased and cut into tokens (runs of ASCII letters and digits and of other letters).
Each mask keeps some positions of a span of tokens and ignores the others; the hash of the kept
tokens still meets the benchmark's when an ignored token was substituted. A hit gives a diagonal (where an item
would start in the document); there the tokens are compared one by one, and the overlap counts if
some window of ``window`` tokens (the whole item if it is shorter) agrees in at least ``least`` of them.
By enumeration the masks together hit every pattern of substitutions that leaves 80 % of 10 to 20 tokens. Items of 3 to 9
tokens have one seed of all their tokens, so they match where they are equal.

The hashes are joined on the map side: the benchmark's are broadcast in blocks of at most
``block_tokens`` tokens, so what is sent has a fixed bound; a larger benchmark means more blocks, each met by all documents.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from contextlake.llm import textkit

U64 = np.uint64
MASKS = ("1101011001", "1110100011", "1011001101", "1111110000", "1110111", "110010111", "10111011")
#: items of at least SPAN tokens are met by masks, shorter ones of at least SHORTEST only as a whole
SPAN, SHORTEST = 10, 3
_SEPARATORS = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def tokens(column: pa.Array, max_bytes: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, token hashes, tokens of each row) for slices of a text column."""
    data, offsets = textkit.buffers(pc.utf8_lower(column.fill_null("")))
    for lo, hi in textkit.slices(offsets, max_bytes):
        part, offs = textkit.documents(data, offsets, lo, hi)
        starts, ends, rows = textkit.word_spans(part, offs, _SEPARATORS)
        yield lo, hi, textkit.span_hashes(part, starts, ends), np.bincount(rows, minlength=hi - lo)


def seed_hashes(toks: np.ndarray, mask: str) -> np.ndarray:
    """The hash of the mask's tokens at every place where the span fits into toks."""
    n = len(toks) - len(mask) + 1
    out = np.full(max(n, 0), int(mask, 2), U64)
    for j, kept in enumerate(mask):
        if kept == "1" and n > 0:
            out = textkit.mix(out * U64(0x100000001B3) + toks[j : j + n])
    return out


def differences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The distinct values of x - y over all x in a and y in b, by one convolution of the two sets where pairs are many."""
    low, high = int(a.min()), int(b.max())
    span = int(a.max()) - low + high - int(b.min()) + 1
    if len(a) * len(b) <= 32 * span:
        return np.unique(a[:, None] - b[None, :])
    size = 1 << span.bit_length()
    x, y = np.zeros(size), np.zeros(size)
    x[a - low] = 1
    y[high - b] = 1
    # counts are whole numbers of at most len(a), so rounding cannot turn none into one
    pairs = np.fft.irfft(np.fft.rfft(x) * np.fft.rfft(y), size)[:span]
    return np.flatnonzero(pairs > 0.5) + (low - high)


class SeedIndex:
    """Sorted seed hashes of some items, with a bit table in front."""

    TABLE = 22
    #: hits of one hash in one text, from which on their diagonals are not written out one by one
    HEAVY = 1 << 14

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        hashes, item, place = [], [], []
        for i, (_, toks) in enumerate(items):
            for mask in MASKS if len(toks) >= SPAN else ("1" * len(toks),):
                h = seed_hashes(toks, mask)
                hashes.append(h)
                item.append(np.full(len(h), i))
                place.append(np.arange(len(h)))
        h = np.concatenate(hashes) if hashes else np.zeros(0, U64)
        order = np.argsort(h, kind="stable")
        self.items = items
        self.ids = [i for i, _ in items]
        self.sizes = np.array([len(toks) for _, toks in items], np.int64)
        self.offsets = np.cumsum(self.sizes) - self.sizes
        self.tokens = np.concatenate([np.zeros(0, U64), *(toks for _, toks in items)])
        self.masks = (*MASKS, *("1" * n for n in sorted({len(toks) for _, toks in items if len(toks) < SPAN})))
        self.hashes = h[order]
        self.item = np.concatenate(item)[order] if item else np.zeros(0, int)
        self.place = np.concatenate(place)[order] if place else np.zeros(0, int)
        self.table = np.zeros(1 << self.TABLE, bool)
        self.table[h >> U64(64 - self.TABLE)] = True

    def diagonals(self, toks: np.ndarray, row_of: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Distinct (row, item, start of the item in the row's tokens) of all hits of a slice's tokens."""
        found = []
        for mask in self.masks:
            h = seed_hashes(toks, mask)
            at = np.flatnonzero(self.table[h >> U64(64 - self.TABLE)])
            at = at[row_of[at] == row_of[at + len(mask) - 1]]
            lo, hi = np.searchsorted(self.hashes, h[at], "left"), np.searchsorted(self.hashes, h[at], "right")
            at, lo, n = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            # a hash that a text and the items repeat has as many hits as the product, but no more diagonals than the sum of their lengths
            order = np.lexsort((at, lo, row_of[at]))
            heads = np.flatnonzero(np.concatenate([[True], (np.diff(row_of[at][order]) != 0) | (np.diff(lo[order]) != 0)])) if len(at) else np.zeros(0, np.int64)
            times = np.diff(np.concatenate([heads, [len(at)]]))
            heavy = times * n[order][heads] > self.HEAVY
            for head, count in zip(heads[heavy].tolist(), times[heavy].tolist(), strict=True):
                one = order[head]
                places = at[order[head : head + count]] - first[row_of[at[one]]]
                for i, own in self._places(int(lo[one]), int(n[one])):
                    starts = differences(places, own)
                    found.append(np.stack([np.full(len(starts), row_of[at[one]]), np.full(len(starts), i), starts], axis=1))
            light = order[~np.repeat(heavy, times)] if len(at) else order
            at, lo, n = at[light], lo[light], n[light]
            entry = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = np.repeat(at, n)
            found.append(np.stack([row_of[at], self.item[entry], at - first[row_of[at]] - self.place[entry]], axis=1))
        return np.unique(np.concatenate(found), axis=0)

    def _places(self, lo: int, n: int) -> Iterator[tuple[int, np.ndarray]]:
        """(item, places) of the n entries from lo, which have one hash."""
        item, place = self.item[lo : lo + n], self.place[lo : lo + n]
        order = np.argsort(item, kind="stable")
        edges = np.flatnonzero(np.diff(item[order])) + 1
        for own in np.split(order, edges):
            yield int(item[own[0]]), place[own]

    def leaks(self, toks: np.ndarray, counts: np.ndarray, window: int, least: float, most: int = 1 << 20) -> list[tuple[int, int, int, int, int]]:
        """(row, item_id, first token, tokens, equal ones) of the best overlap of each row and item that counts, by row and item.

        All diagonals are compared at once, in lots of about ``most`` tokens, so items that share boilerplate cost their tokens and no more.
        """
        first = np.cumsum(counts) - counts
        row, item, start = self.diagonals(toks, np.repeat(np.arange(len(counts)), counts), first).T
        size = np.minimum(window, self.sizes[item])
        lo, hi = np.maximum(0, start), np.minimum(counts[row], start + self.sizes[item])
        fits = np.flatnonzero(hi - lo >= size)
        found = []
        lots = np.searchsorted(np.cumsum((hi - lo)[fits]), np.arange(1, int((hi - lo)[fits].sum()) // most + 1) * most)
        for part in np.split(fits, np.unique(lots)):
            if not len(part):
                continue
            n, s = (hi - lo)[part], size[part]
            of = np.repeat(np.arange(len(part)), n)
            begin = np.cumsum(n) - n
            at = np.arange(len(of)) - begin[of] + lo[part][of]
            same = np.concatenate([[0], np.cumsum(toks[first[row[part]][of] + at] == self.tokens[self.offsets[item[part]][of] + at - start[part][of]])])
            # a window begins wherever it ends before its diagonal does
            opens = np.flatnonzero(np.arange(len(of)) - begin[of] <= (n - s)[of])
            equal = same[opens + s[of[opens]]] - same[opens]
            heads = np.flatnonzero(np.concatenate([[True], of[opens][1:] != of[opens][:-1]]))
            best = np.maximum.reduceat(equal, heads)
            top = np.flatnonzero(equal == np.repeat(best, np.diff(np.concatenate([heads, [len(opens)]]))))
            top = top[np.concatenate([[True], of[opens[top]][1:] != of[opens[top]][:-1]])]
            ok = best >= least * s
            found.append(np.stack([row[part], item[part], at[opens[top]], s, best], axis=1)[ok])
        hits = np.concatenate([np.zeros((0, 5), np.int64), *found])
        # of one row and item the greatest, the first of equals
        hits = hits[np.lexsort((np.arange(len(hits)), -hits[:, 4], hits[:, 1], hits[:, 0]))]
        new = np.ones(len(hits), bool)
        new[1:] = (hits[1:, :2] != hits[:-1, :2]).any(axis=1)
        return [(r, self.ids[i], a, s, e) for r, i, a, s, e in hits[new].tolist()]


def overlap(doc: np.ndarray, item: np.ndarray, start: int, window: int, least: float) -> tuple[int, int, int] | None:
    """(first token in doc, tokens, equal ones) of the best window of item laid at start over doc, if it counts."""
    size = min(window, len(item))
    lo, hi = max(0, start), min(len(doc), start + len(item))
    if hi - lo < size:
        return None
    same = np.concatenate([[0], np.cumsum(doc[lo:hi] == item[lo - start : hi - start])])
    inside = same[size:] - same[:-size]
    best = int(inside.argmax())
    return (lo + best, size, int(inside[best])) if inside[best] >= least * size else None


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = 20, least: float = 0.8, block_tokens: int = 1 << 20, carry: tuple[str, ...] = (), keep_text: bool = False, max_bytes: int = 1 << 21) -> DataFrame:
    """doc_id, carry columns, text (with keep_text), leaks array<struct<item_id, start, n_tokens, n_equal>> of every row of docs.

    Items of 3 to 9 tokens match where all their tokens are equal; those of fewer, null or empty ones cannot be told
    from chance and match nothing. Null text is empty. Equal items each give a leak; equal rows have equal
    leaks. An empty benchmark or no documents: empty arrays, or no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    items = benchmark.select("item_id", "text").where("text IS NOT NULL")
    # as many blocks of whole items, by digest, as hold block_tokens each; a token has a byte and a separator at least
    total = items.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    blocks = range(max(1, -(-total // (2 * block_tokens))) if total else 0)
    sized = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(len(blocks) or 1)))
    base = docs.select("doc_id", *carry, "text")
    spans = base
    for k, block in enumerate(blocks):
        got = sized.where(F.col("block") == block).select("item_id", "text").orderBy("item_id", "text").toArrow().combine_chunks()
        parts = []
        for lo, hi, toks, counts in tokens(got.column("text").combine_chunks(), 1 << 22):
            ends = np.cumsum(counts)
            parts += [(got.column("item_id")[i].as_py(), toks[ends[i - lo] - counts[i - lo] : ends[i - lo]]) for i in range(lo, hi) if counts[i - lo] >= SHORTEST]
        index = spark.sparkContext.broadcast(SeedIndex(parts))
        spans = _met(spans, index, f"leaks_{k}", window, least, max_bytes, keep_text or block + 1 < len(blocks))
    leaks = F.array_sort(F.concat(F.array().cast("array<struct<item_id:long,start:long,n_tokens:long,n_equal:long>>"), *[F.col(f"leaks_{k}") for k in range(len(blocks))]))
    return spans.select("doc_id", *carry, *(["text"] if keep_text else []), leaks.alias("leaks"))


def spark_leaks(name: str) -> list:
    return StructType.fromDDL(f"`{name}` array<struct<item_id:long,start:long,n_tokens:long,n_equal:long>>").fields


def _met(docs: DataFrame, index, name: str, window: int, least: float, max_bytes: int, keep_text: bool) -> DataFrame:
    kind = pa.list_(pa.struct([(k, pa.int64()) for k in ("item_id", "start", "n_tokens", "n_equal")]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = index.value
        for batch in batches:
            leaks: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for lo, _, toks, counts in tokens(batch.column(batch.schema.get_field_index("text")), max_bytes):
                if len(toks) < SHORTEST:
                    continue
                for row, item_id, at, size, same in seeds.leaks(toks, counts, window, least):
                    leaks[lo + row].append({"item_id": item_id, "start": at, "n_tokens": size, "n_equal": same})
            passed = [c for c in batch.schema.names if keep_text or c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in passed), pa.array(leaks, kind)], names=[*passed, name])
        textkit.give_back()

    out = StructType([f for f in docs.schema.fields if keep_text or f.name != "text"] + spark_leaks(name))
    return docs.mapInArrow(run, out)
