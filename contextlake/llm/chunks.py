"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes; a chunk may end where its top bits are zero, which depends on the 32
bytes before only. After an insertion the cuts fall on the same places again as soon as one of them does, since the
least and greatest length are counted from the last cut. A chunk whose 128-bit xxhash digest occurs in an
earlier chunk (by doc_id, then place) is a duplicate and is removed; the first stays.
The end of a text can be shorter than the least chunk. Alone it would meet unlike texts by chance, so its digest is that
of the chunk before and itself; a text that is shorter as a whole has its own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from contextlake.llm import textkit
from contextlake.llm.store import checkpointed

U64 = np.uint64
GEAR = (textkit.mix(np.arange(1, 257, dtype=U64)) >> U64(32)).astype(np.uint32)


def gear_hash(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of GEAR[data[i - j]] << j for j from 0 to 31, modulo 2**32."""
    h = GEAR[data]
    for j in (1, 2, 4, 8, 16):
        if len(h) > j:
            h = np.concatenate([h[:j], h[j:] + (h[:-j] << np.uint32(j))])
    return h


def cut(data: np.ndarray, bits: int, least: int, most: int) -> list[int]:
    """Ends of the chunks of one text: after a byte whose gear hash has ``bits`` zero top bits, at least ``least`` and at most ``most`` bytes on."""
    n, last, out = len(data), 0, []
    for i in (np.flatnonzero(gear_hash(data) >> np.uint32(32 - bits) == 0) + 1).tolist():
        while i - last > most:
            last += most
            out.append(last)
        if i - last >= least:
            last = i
            out.append(last)
    while n - last > most:
        last += most
        out.append(last)
    if last < n:
        out.append(n)
    return out


def _chunk_rows(bits: int, least: int, most: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textkit.buffers(batch.column(1))
            for lo, hi in textkit.slices(offsets, 1 << 21):
                part, offs = textkit.documents(data, offsets, lo, hi)
                ends, rows = [], []
                for i in range(hi - lo):
                    own = cut(part[offs[i] : offs[i + 1]], bits, least, most)
                    # an empty text has one chunk of no bytes, so that its row is known
                    ends += [offs[i] + e for e in own or [0]]
                    rows += [i] * max(1, len(own))
                ends, rows = np.array(ends), np.array(rows)
                starts = np.concatenate([[0], ends[:-1]])
                starts = np.where(np.concatenate([[True], rows[1:] != rows[:-1]]), offs[rows], starts)
                # a short end is known by the chunk before it and itself
                end = np.flatnonzero((ends - starts < least) & (starts > offs[rows]))
                known = starts.copy()
                known[end] = starts[end - 1]
                view = memoryview(np.ascontiguousarray(part))
                digests = np.frombuffer(b"".join([xxh3_128_digest(view[a:b]) for a, b in zip(known.tolist(), ends.tolist(), strict=True)]), "<i8").reshape(-1, 2)
                row = pa.array(rows + lo)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy()), *(batch.column(c).take(row) for c in (0, 2, 3)), pa.array((starts - offs[rows]).astype(np.int64)), pa.array((ends - starts).astype(np.int32)), pa.array((ends - known).astype(np.int32))],
                    names=["a", "b", "doc_id", "x", "row", "start", "n", "m"],
                )

    return run


def duplicate_chunks(docs: DataFrame, bits: int = 5, least: int = 48, most: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_chunks, n_dup_chunks, n_removed, spans (start, n of what goes; runs joined) of every row.

    A chunk shorter than ``least`` bytes (the end of a text) is a duplicate if the chunk before it and itself occur earlier
    in the same way, or if it is a whole text that occurred as one. Null text is empty and has no
    chunks. A null doc_id is before all others; rows that share a doc_id go by a hash of their texts, and of
    equal rows one stays. Other columns are ignored; no rows: no rows.
    """
    return _found(docs, bits, least, most).drop("row", "x")


def _found(docs: DataFrame, bits: int, least: int, most: int) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("x"), F.monotonically_increasing_id().alias("row"))
    # rows are numbered in the same pass that is written here
    pieces = checkpointed(rows.mapInArrow(_chunk_rows(bits, least, most), "a long, b long, doc_id long, x long, row long, start long, n int, m int"))
    place = F.struct(F.isnotnull("doc_id").alias("named"), "doc_id", "x", "row", "start")
    firsts = pieces.where("n > 0").groupBy("a", "b", "m").agg(F.min(place).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    later = pieces.join(firsts, ["a", "b", "m"]).where(place > F.col("first")).select("row", "start", "n")
    spans = later.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "n"))).alias("gone"), F.sum("n").alias("n_removed"), F.count("*").alias("n_dup_chunks"))
    counts = pieces.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("x").alias("x"), F.count_if(F.col("n") > 0).alias("n_chunks"), F.sum("n").alias("n_bytes"))
    # a run starts where the span before does not end, and ends where the next does not start
    starts = F.expr("filter(gone, (s, i) -> i = 0 OR get(gone, i - 1).start + get(gone, i - 1).n <> s.start)")
    ends = F.expr("filter(gone, (s, i) -> i = size(gone) - 1 OR get(gone, i + 1).start <> s.start + s.n)")
    joined = F.zip_with(starts, ends, lambda s, e: F.struct(s["start"].alias("start"), (e["start"] + e["n"] - s["start"]).alias("n")))
    out = counts.join(spans, "row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", "x", "row", zero("n_bytes"), zero("n_chunks"), zero("n_dup_chunks"), zero("n_removed"), F.coalesce(joined, F.expr("CAST(array() AS array<struct<start:bigint,n:bigint>>)")).alias("spans"))


def kept_text(docs: DataFrame, bits: int = 5, least: int = 48, most: int = 512) -> DataFrame:
    """doc_id and the bytes of every row without the spans of duplicate_chunks(). Rows of equal id and text change places at most."""
    nth = lambda order: F.row_number().over(Window.partitionBy("doc_id", "x").orderBy(order))
    text = F.coalesce("text", F.lit(""))
    whole = docs.select("doc_id", F.xxhash64(text).alias("x"), F.encode(text, "UTF-8").alias("bytes")).withColumn("nth", nth("doc_id"))
    found = _found(docs, bits, least, most).withColumn("nth", nth("row"))
    found = found.select(F.col("doc_id").alias("id"), F.col("x").alias("fx"), F.col("nth").alias("fn"), "spans")
    both = whole.join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("x") == F.col("fx")) & (F.col("nth") == F.col("fn")))
    ends = F.expr("transform(array_append(spans, named_struct('start', CAST(octet_length(bytes) AS bigint), 'n', 0L)), (x, i) -> substring(bytes, CAST(CASE WHEN i = 0 THEN 1 ELSE spans[i - 1].start + spans[i - 1].n + 1 END AS INT), CAST(x.start - CASE WHEN i = 0 THEN 0 ELSE spans[i - 1].start + spans[i - 1].n END AS INT)))")
    return both.withColumn("parts", ends).select("doc_id", F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, p)).alias("kept"))
