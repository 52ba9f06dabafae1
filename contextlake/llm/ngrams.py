"""Hashed character n-gram features of whole texts, and the pass that gathers them from all rows.

Features are made for a slice of an Arrow batch at a time: code points of all its rows lie in one array, n-grams
are hashed at every place that does not cross a row's end, and one sort of (row, slot) counts them. A text
of more than ``PIECE`` characters is hashed in overlapping pieces whose counts are added, so memory follows the piece.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contextlake.llm import textkit
from contextlake.llm.store import checkpointed

U64 = np.uint64
_BLANK = np.array([not (65 <= i <= 90 or 97 <= i <= 122) for i in range(128)])
PIECE = 1 << 21


@dataclass(frozen=True)
class Features:
    """n-grams of code points of these orders, in 2**bits slots; with letters_only, other ASCII is one blank and case is folded."""

    orders: tuple[int, ...] = (1, 2, 3)
    bits: int = 16
    letters_only: bool = True

    def slices(self, column: pa.Array, max_bytes: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(first row, last row, starts, slots, counts) of slices of a text column; the entries of a row begin at its start, and every row has some."""
        data, offsets = textkit.buffers(pc.utf8_lower(column.fill_null("")) if self.letters_only else column)
        for lo, hi in textkit.slices(offsets, max_bytes):
            yield lo, hi, *self.of_slice(*textkit.documents(data, offsets, lo, hi))

    def of_slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
        heads = (data & 0xC0) != 0x80
        ends = np.concatenate([[0], np.cumsum(heads)])[offsets]
        rows = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint32), np.diff(ends))
        if self.letters_only:
            blank = (points < 128) & _BLANK[np.minimum(points, 127)]
            again = blank & np.concatenate([[False], blank[:-1] & (rows[1:] == rows[:-1])])
            points, rows = np.where(blank, np.uint32(32), points)[~again], rows[~again]
        # a blank before and after each row
        at = np.arange(len(points)) + 2 * rows.astype(np.int64) + 1
        sizes = np.bincount(rows, minlength=len(offsets) - 1) + 2
        padded = np.full(int(sizes.sum()), 32, np.uint32)
        padded[at] = points
        if len(padded) > 2 * PIECE and len(sizes) == 1:
            return self._pieces(padded)
        row = np.repeat(np.arange(len(sizes), dtype=np.uint32), sizes)
        wide = np.uint32 if (len(sizes) << self.bits) <= 1 << 32 else np.uint64
        keys = []
        for n in self.orders:
            same = row[: len(row) - n + 1] == row[n - 1 :] if len(row) >= n else np.zeros(0, bool)
            slot = self._slots(padded, n)[same]
            keys.append((row[: len(row) - n + 1][same].astype(wide) << wide(self.bits)) | slot.astype(wide))
        keys = np.sort(np.concatenate(keys))
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        counts = np.diff(np.concatenate([first, [len(keys)]]))
        keys = keys[first]
        starts = np.searchsorted(keys >> wide(self.bits), np.arange(len(sizes), dtype=wide))
        return starts, (keys & wide((1 << self.bits) - 1)).astype(np.int64), counts

    def _slots(self, points: np.ndarray, n: int) -> np.ndarray:
        """The slot of the n-gram at every place of points."""
        size = max(0, len(points) - n + 1)
        h = np.full(size, n * 0x9E3779B97F4A7C15 & (2**64 - 1), U64)
        for j in range(n):
            h = (h ^ points[j : size + j]) * U64(0x100000001B3)
            h ^= h >> U64(29)
        return (h * U64(0xC2B2AE3D27D4EB4F)) >> U64(64 - self.bits)

    def _pieces(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sums = np.zeros(1 << self.bits, np.int64)
        for n in self.orders:
            for lo in range(0, len(points) - n + 1, PIECE):
                sums += np.bincount(self._slots(points[lo : lo + PIECE + n - 1], n).astype(np.int64), minlength=1 << self.bits)
        slots = np.flatnonzero(sums)
        return np.zeros(1, np.int64), slots, sums[slots]


def chance(*columns: Column) -> Column:
    """A number in [0, 1) from a hash of the columns; the same on every run and partitioning."""
    return F.pmod(F.xxhash64(F.lit(0x5A17), *columns), F.lit(1 << 32)).cast("double") / F.lit(2.0**32)


def gather(rows: DataFrame, features: Features, groups: int, share: Column, most: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
    """One pass over rows (doc_id, g, label, text): document frequencies of all of them by g (from 0), and a sample's features.

    Returns (rows of each g with each slot, rows of each g, [(label, slots, counts)] of the sample in
    the order of a hash). ``share`` of the rows are sampled, by a hash of doc_id and text; the caller chooses it so that
    about half of ``most`` rows come, and repeated rows that are drawn together are cut at ``most``. Each task sums its
    rows; at most groups * (width + 1) sums reach the driver.
    """
    width = 1 << features.bits
    at = chance(F.col("doc_id"), F.col("text"))
    asked = rows.select("g", "label", at.alias("at"), (at < share).alias("sampled"), F.coalesce("text", F.lit("")).alias("text"))
    ints = pa.list_(pa.int32())
    names = ["g", "slot", "n", "at", "slots", "counts"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((groups, width + 1), np.int64)
        for batch in batches:
            g, label, place = (np.asarray(batch.column(i).to_numpy(zero_copy_only=False)) for i in range(3))
            sampled = np.asarray(batch.column(3).to_numpy(zero_copy_only=False)).astype(bool)
            for lo, hi, starts, slots, counts in features.slices(batch.column(4)):
                sizes = np.diff(np.concatenate([starts, [len(slots)]]))
                sums += np.bincount(np.repeat(g[lo:hi].astype(np.int64), sizes) * (width + 1) + slots, minlength=groups * (width + 1)).reshape(groups, -1)
                sums[:, width] += np.bincount(g[lo:hi], minlength=groups)
                chosen = np.flatnonzero(sampled[lo:hi])
                if len(chosen):
                    some = np.repeat(sampled[lo:hi], sizes)
                    ends = pa.array(np.concatenate([[0], np.cumsum(sizes[chosen])]).astype(np.int32))
                    lists = [pa.ListArray.from_arrays(ends, pa.array(x[some].astype(np.int32))) for x in (slots, counts)]
                    none = pa.nulls(len(chosen), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(label[lo:hi][chosen].astype(np.int32)), none, none.cast(pa.int64()), pa.array(place[lo:hi][chosen]), *lists], names=names)
        g, slot = np.nonzero(sums)
        for lo in range(0, len(g), 1 << 16):
            a, b = g[lo : lo + (1 << 16)], slot[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(sums[a, b]), pa.nulls(len(a), pa.float64()), pa.nulls(len(a), ints), pa.nulls(len(a), ints)], names=names)
        textkit.give_back()

    passed = checkpointed(asked.mapInArrow(run, "g int, slot int, n long, at double, slots array<int>, counts array<int>"))
    total = passed.where("at IS NULL").groupBy("g", "slot").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros((groups, width + 1), np.int64)
    df[total.column(0).to_numpy(), total.column(1).to_numpy()] = total.column(2).to_numpy()
    got = passed.where("at IS NOT NULL").select("at", "g", "slots", "counts").orderBy("at", "g", "slots").limit(most).toArrow()
    sample = [(g, np.asarray(slots.values), np.asarray(counts.values)) for g, slots, counts in zip(got.column("g").to_pylist(), got.column("slots"), got.column("counts"), strict=True)]
    return df[:, :width], df[:, width], sample
