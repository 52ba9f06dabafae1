"""Near-duplicate documents by Order MinHash and banded alignment.

Words are runs without ASCII white space; a k-mer is ``k`` successive words (all of a shorter text). Sketches and
verification both look at a text's k-mers with the number of their occurrence (the second "a b c d e" is another k-mer than the first), in the order
of the text: for each hash function the two least k-mers are kept in that order, so a sketch agrees when content and order agree. Texts
that agree in ``rows`` sketches of a band meet in a bucket. Texts of at most ``few`` k-mers also meet in
the buckets of their rarest k-mers, as many as a pair of similarity ``least`` cannot avoid to share (a prefix
filter), so among them no pair is left to chance.

In a bucket every pair is verified (or, where only classes are wanted, every pair whose class is not known yet), each pair in the first bucket that it shares: similarity is the number of
k-mers that stay in order in the best alignment, over the number of k-mers of both together, with
the alignment kept in the band that a pair of that similarity cannot leave. A bucket of more than ``hot`` members (or
``hot_bytes`` of text) is cut into blocks, and each pair of blocks is a task's group of its own. A group gives
the number of links of each member and a spanning forest of them, so the work grows with the pairs of
a bucket but the rows do not. Spanning links make classes by connected components.

Equal texts are one node from the start, so only links between different texts are looked for.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contextlake.llm import textkit
from contextlake.llm.components import connected_components
from contextlake.llm.store import checkpointed

U64 = np.uint64
_TOP = np.iinfo(np.uint64).max


def labelled(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The hashes of (k-mer, occurrence) from those of the k-mers of each row in order; a first occurrence keeps its hash."""
    order = np.argsort(textkit.mix(h + row.astype(U64) * U64(0x9E3779B97F4A7C15)), kind="stable")
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
    heads = np.flatnonzero(new)
    nth = np.empty(len(h), U64)
    nth[order] = np.arange(len(h)) - np.repeat(heads, np.diff(np.concatenate([heads, [len(h)]])))
    return np.where(nth == 0, h, textkit.mix(h + nth * U64(0xD6E8FEB86659FD93)))


def sketch_slice(data: np.ndarray, offsets: np.ndarray, k: int, sketches: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """uint64 sketches (rows, sketches) of one slice, zeros for rows without words; and the labelled k-mers and their rows."""
    starts, ends, rows = textkit.word_spans(data, offsets)
    counts = np.bincount(rows, minlength=len(offsets) - 1)
    h, row, _ = textkit.shingle_hashes(textkit.span_hashes(data, starts, ends), counts, k)
    out = np.zeros((len(offsets) - 1, sketches), U64)
    if not len(h):
        return out, h, row
    found = labelled(h, row)
    h = textkit.mix(found)
    heads = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    lengths = np.diff(np.concatenate([heads, [len(h)]]))
    # the place takes 24 bits, more in a slice of one longer text
    low = U64((1 << max(24, int(lengths.max()).bit_length())) - 1)
    place = (np.arange(len(h)) - np.repeat(heads, lengths)).astype(U64) & low
    for i in range(sketches):
        factor = U64((int(textkit.mix(np.array([i + 1], U64))[0]) | 1))
        v = ((h * factor) & ~low) | place
        first = np.minimum.reduceat(v, heads)
        v[v == np.repeat(first, lengths)] = _TOP
        second = np.minimum.reduceat(v, heads)
        p, q = (first & low).astype(np.int64), (second & low).astype(np.int64)
        q = np.where(lengths > 1, q, p)
        before, after = h[heads + np.minimum(p, q)], h[heads + np.maximum(p, q)]
        out[row[heads], i] = textkit.mix(before * U64(0xC2B2AE3D27D4EB4F) + after + U64(i))
    return out, found, row


def _sketch_rows(k: int, bands: int, rows: int, few: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textkit.buffers(batch.column(4))
            s, short, sizes = [np.zeros((0, bands * rows), U64)], [np.zeros(0, U64)], [np.zeros(0, np.int64)]
            for lo, hi in textkit.slices(offsets, 1 << 21):
                found, h, row = sketch_slice(*textkit.documents(data, offsets, lo, hi), k, bands * rows)
                n = np.bincount(row, minlength=hi - lo)
                s.append(found)
                short.append(textkit.mix(h[n[row] <= few] + U64(0x5851F42D4C957F2D)))
                sizes.append(np.where(n <= few, n, 0))
            s = np.concatenate(s)
            keys = []
            for band in range(bands):
                key = np.full(len(s), band + 1, U64)
                for r in range(rows):
                    key = textkit.mix(key * U64(0x100000001B3) + s[:, band * rows + r])
                keys.append(key.view(np.int64))
            some = s.any(axis=1)
            found_keys = np.stack(keys, axis=1)[some].ravel()
            each = np.concatenate([[0], np.cumsum(some * bands)]).astype(np.int32)
            own = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(4)), pa.ListArray.from_arrays(pa.array(each), pa.array(found_keys)), pa.ListArray.from_arrays(pa.array(own), pa.array(np.concatenate(short).view(np.int64)))],
                names=["doc_id", "x", "y", "bytes", "bands", "few"],
            )
        textkit.give_back()

    return run


def met_before(key: int, bands: np.ndarray, rare: list[np.ndarray]) -> np.ndarray:
    """Which pairs of a bucket's members share an earlier bucket: an earlier band, or (for a k-mer's bucket) any band or a lesser k-mer."""
    n = len(bands)
    band = np.flatnonzero(bands[0] == key)
    met = np.zeros((n, n), bool)
    for t in range(int(band[0]) if len(band) else bands.shape[1]):
        met |= bands[:, t][:, None] == bands[:, t][None, :]
    if not len(band):
        less = [np.unique(r[r < key]) for r in rare]
        member = np.repeat(np.arange(n), [len(r) for r in less])
        value = np.concatenate(less)
        order = np.argsort(value, kind="stable")
        for same in np.split(member[order], np.flatnonzero(np.diff(value[order])) + 1):
            if len(same) > 1:
                met[np.ix_(same, same)] = True
    return met


def in_order(places: np.ndarray, at: np.ndarray, band: int) -> int:
    """How many common k-mers, at ``at`` in one text and at ``places`` in the other, stay in order within the band."""
    places = places[np.abs(places - at) <= band]
    if (places[1:] > places[:-1]).all():
        return len(places)
    tails: list[int] = []
    for x in places.tolist():
        p = bisect_left(tails, x)
        tails[p : p + 1] = [x]
    return len(tails)


def band_of(all_of, least: float):
    return np.ceil(all_of * (1 - least) / (1 + least)).astype(np.int64) + 1


def linked(kmers: list[np.ndarray], wanted: np.ndarray, least: float, label: np.ndarray, every: bool) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(spanning links, links of each text) of the wanted pairs (i, j; a matrix) whose similarity is least or more.

    Each text is given by its labelled k-mers in order. Texts of one label are known to be of one class; without ``every`` pairs whose
    class is known already are left out, so a group of near copies costs one comparison a member.
    """
    sizes = np.array([len(x) for x in kmers])
    offs = np.concatenate([[0], np.cumsum(sizes)])
    _, ids = np.unique(np.concatenate(kmers), return_inverse=True)
    place = np.full(len(ids) + 1, -1)
    _, part = np.unique(label, return_inverse=True)
    degree, out = np.zeros(len(kmers), np.int64), []
    for i in np.flatnonzero(wanted.any(axis=1)).tolist():
        js = np.flatnonzero(wanted[i] if every else wanted[i] & (part != part[i]))
        if not len(js):
            continue
        own = ids[offs[i] : offs[i + 1]]
        place[own] = np.arange(len(own))
        before = np.cumsum(sizes[js]) - sizes[js]
        at = np.repeat(offs[js] - before, sizes[js]) + np.arange(int(sizes[js].sum()))
        p = place[ids[at]]
        place[own] = -1
        of = np.repeat(np.arange(len(js)), sizes[js])
        hit = np.flatnonzero(p >= 0)
        p, of, at = p[hit], of[hit], at[hit] - offs[js][of[hit]]
        common = np.bincount(of, minlength=len(js))
        all_of = sizes[i] + sizes[js]
        enough = common / np.maximum(all_of - common, 1) >= least
        # common k-mers in the same order and near the diagonal: no alignment is needed
        turned = np.bincount(of[1:][(of[1:] == of[:-1]) & (p[1:] <= p[:-1])], minlength=len(js)) > 0
        far = np.bincount(of[np.abs(p - at) > band_of(all_of, least)[of]], minlength=len(js)) > 0
        ok = enough & ~turned & ~far
        ends = np.searchsorted(of, np.arange(len(js) + 1))
        for k in np.flatnonzero(enough & (turned | far)).tolist():
            n = in_order(p[ends[k] : ends[k + 1]], at[ends[k] : ends[k + 1]], int(band_of(all_of[k], least)))
            ok[k] = n / max(all_of[k] - n, 1) >= least
        found = js[ok]
        degree[found] += 1
        degree[i] += len(found)
        for j in found.tolist():
            if part[i] != part[j]:
                part[part == part[j]] = part[i]
                out.append((i, j))
    return out, degree


def _verify_rows(k: int, least: float, every: bool):
    """Task function over (key, one, two, block, node, label, bands, rare, text) sorted by key, one and two: (a, b, null) of spanning links and, with every pair wanted, (a, null, links of a)."""

    def lists(column: pa.ChunkedArray) -> list[np.ndarray]:
        return [np.array(x, np.int64) for x in column.to_pylist()]

    def groups(table: pa.Table) -> pa.RecordBatch:
        key, one, two, block, node, label = (table.column(i).to_numpy() for i in range(6))
        edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1]), [True]]))
        a, b, n = [], [], []
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if hi - lo < 2:
                continue
            own = table.slice(lo, hi - lo)
            wanted = np.triu(~met_before(key[lo], np.array(lists(own.column(6))), lists(own.column(7))), 1)
            if one[lo] != two[lo]:
                wanted &= block[lo:hi][:, None] != block[lo:hi][None, :]
            if not wanted.any():
                continue
            pairs, degree = linked(labelled_kmers(own.column(8), k), wanted, least, label[lo:hi], every)
            for i, j in pairs:
                a.append(node[lo + i])
                b.append(node[lo + j])
                n.append(None)
            for i in np.flatnonzero(degree).tolist() if every else ():
                a.append(node[lo + i])
                b.append(None)
                n.append(int(degree[i]))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, n)], names=["a", "b", "n"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            places = [batch.column(i).to_numpy() for i in range(3)]
            last = np.flatnonzero(np.logical_or.reduce([p != p[-1] for p in places]))
            before = held and any(held[-1].column(i)[held[-1].num_rows - 1].as_py() != p[0] for i, p in enumerate(places))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut or before:
                yield groups(pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks())
                held = []
            held.append(batch.slice(cut))
        if held:
            yield groups(pa.Table.from_batches(held).combine_chunks())
        held.clear()
        textkit.give_back()

    return run


def similarity(first: np.ndarray, second: np.ndarray, least: float) -> float:
    """Ordered similarity of two texts' labelled k-mer hashes in order; 0 where it is surely below least."""
    if not len(first) or not len(second):
        return 0.0
    all_of = len(first) + len(second)
    common, i, j = np.intersect1d(first, second, assume_unique=True, return_indices=True)
    if len(common) < least * (all_of - len(common)):
        return 0.0
    order = np.argsort(i)
    n = in_order(j[order], i[order], int(band_of(np.float64(all_of), least)))
    return n / (all_of - n)


def labelled_kmers(column: pa.Array, k: int) -> list[np.ndarray]:
    """Each text's hashes of (k-mer, occurrence), in order."""
    data, offsets = textkit.buffers(column)
    out = []
    for lo, hi in textkit.slices(offsets, 1 << 21):
        part, offs = textkit.documents(data, offsets, lo, hi)
        starts, ends, rows = textkit.word_spans(part, offs)
        h, row, _ = textkit.shingle_hashes(textkit.span_hashes(part, starts, ends), np.bincount(rows, minlength=hi - lo), k)
        out += np.split(labelled(h, row), np.searchsorted(row, np.arange(1, hi - lo)))
    return out


def text_classes(docs: DataFrame, k: int = 5, least: float = 0.8, bands: int = 20, rows: int = 2, few: int = 20, hot: int = 1000, hot_bytes: int = 1 << 24, count_links: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, texts): doc_id, x, y of every row; and x, y (digest), rep (least doc_id of the text), component, class_id, n_links of every text.

    Links are counted over every pair of a bucket. Without count_links (n_links is then null) only classes are wanted: pairs of
    one class are left out, the blocks of a large bucket are looked at alone first, and only what they leave apart meets again.
    """
    whole = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    whole = whole.select("doc_id", F.xxhash64(F.lit(1), "text").alias("x"), F.xxhash64(F.lit(2), "text").alias("y"), F.octet_length("text").cast("long").alias("bytes"), "text")
    sketched = checkpointed(whole.mapInArrow(_sketch_rows(k, bands, rows, few), "doc_id long, x long, y long, bytes long, bands array<long>, few array<long>"))
    texts = sketched.groupBy("x", "y", "bytes", "bands", "few").agg(F.min("doc_id").alias("rep"))  # one row for each text
    texts = checkpointed(texts.withColumn("node", F.monotonically_increasing_id()))

    # the rarest k-mers of short texts, as many as do not fit beside the least number of common ones
    short = texts.select("node", F.size("few").alias("n"), F.explode("few").alias("h"))
    often = short.groupBy("h").agg(F.count("*").alias("often"))
    rarest = short.join(often, "h").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("often", "h"))).alias("all"))
    rarest = rarest.select("node", F.slice("all.h", F.lit(1), (F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).cast("int")).alias("rare"))
    placed = checkpointed(texts.join(rarest, "node", "left").select("node", "x", "y", "rep", "bytes", "bands", F.coalesce("rare", F.array().cast("array<long>")).alias("rare")))

    keyed = placed.select(F.explode(F.concat("bands", "rare")).alias("key"), "node", "bytes")
    blocks = F.greatest(F.ceil(F.count("*") / hot), F.ceil(F.sum("bytes") / hot_bytes)).cast("int")
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), blocks.alias("blocks")).where("n > 1")
    # other blocks in other buckets, so that blocks alone join most of a class
    block = F.pmod(F.xxhash64("node") if count_links else F.xxhash64("node", "key"), F.col("blocks")).cast("int")
    members = checkpointed(keyed.join(shared, "key").select("key", "node", "bytes", "blocks", block.alias("block"), F.col("node").alias("label")))
    # texts go to members of shared buckets only; one row for each text, whatever ids it has
    same = ["x", "y", "id", "unnamed"]
    held = whole.select("x", "y", F.coalesce("doc_id", F.lit(0)).alias("id"), F.isnull("doc_id").alias("unnamed"), "text")

    def verified(members: DataFrame, others: Column) -> DataFrame:
        wanted = placed.join(members.select("node").distinct(), "node").select("x", "y", F.coalesce("rep", F.lit(0)).alias("id"), F.isnull("rep").alias("unnamed"), "node", "bands", "rare")
        found = held.join(wanted, same).dropDuplicates(same).select("node", "bands", "rare", "text")
        laid = members.withColumn("other", F.explode(others))
        laid = laid.select("key", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "node", "label").join(found, "node")
        laid = laid.select("key", "one", "two", "block", "node", "label", "bands", "rare", "text").repartition("key", "one", "two").sortWithinPartitions("key", "one", "two")
        return checkpointed(laid.mapInArrow(_verify_rows(k, least, count_links), "a long, b long, n long"))

    if count_links:
        met = verified(members, F.sequence(F.lit(0), F.col("blocks") - 1))
        classes = connected_components(met.where("b IS NOT NULL").select("a", "b")).withColumnRenamed("id", "node")
    else:
        met = verified(members, F.array("block"))
        classes = connected_components(met.select("a", "b")).withColumnRenamed("id", "node")
        apart = _left_apart(members.where("blocks > 1"), classes, hot, hot_bytes)
        if apart.head(1):
            more = verified(apart, F.when(F.col("block") < F.col("blocks"), F.sequence(F.col("blocks"), F.col("all_blocks") - 1)).otherwise(F.sequence(F.lit(0), F.col("all_blocks") - 1)))
            # known classes are stars, which take fewer rounds than the links that made them
            stars = classes.select(F.col("node").alias("a"), F.col("component").alias("b"))
            classes = connected_components(stars.unionByName(more.select("a", "b"))).withColumnRenamed("id", "node")
    named = classes.join(placed.select("node", "rep"), "node")
    named = classes.join(named.groupBy("component").agg(F.min("rep").alias("class_id")), "component")
    degree = met.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n_links"))
    links = F.coalesce("n_links", F.lit(0)) if count_links else F.lit(None)
    out = placed.select("node", "x", "y", "rep").join(named, "node", "left").join(degree, "node", "left")
    class_id = F.when(F.isnull("component"), F.col("rep")).otherwise(F.col("class_id"))
    return sketched.select("doc_id", "x", "y"), out.select("x", "y", "rep", F.coalesce("component", "node").alias("component"), class_id.alias("class_id"), links.cast("long").alias("n_links"))


def _left_apart(members: DataFrame, classes: DataFrame, hot: int, hot_bytes: int) -> DataFrame:
    """Members of buckets in which more than one class is left, with the class as label; all but the bucket's largest class get blocks of their own.

    The largest class needs no comparison within itself, so its blocks (below ``blocks``) meet the others' blocks (from ``blocks`` to ``all_blocks``) only.
    """
    named = members.join(classes, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    parts = named.groupBy("key", "label").agg(F.count("*").alias("n"), F.sum("bytes").alias("size"))
    largest = parts.groupBy("key").agg(F.count("*").alias("classes"), F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("n"), F.sum("size").alias("size")).where("classes > 1")
    blocks = F.greatest(F.ceil((F.col("n") - F.col("top.n")) / hot), F.ceil(F.col("size") / hot_bytes)).cast("int")
    apart = named.join(largest.select("key", F.col("top.label").alias("main"), blocks.alias("own_blocks")), "key")
    block = F.when(F.col("label") == F.col("main"), F.col("block")).otherwise(F.col("blocks") + F.pmod(F.xxhash64("node"), F.col("own_blocks")).cast("int"))
    return checkpointed(apart.select("key", "node", "bytes", "blocks", (F.col("blocks") + F.col("own_blocks")).alias("all_blocks"), block.alias("block"), "label"))


def near_duplicates(docs: DataFrame, k: int = 5, least: float = 0.8, bands: int = 20, rows: int = 2, few: int = 20, hot: int = 1000) -> DataFrame:
    """doc_id, class_id (least doc_id of the class), n_links (verified links of its text to other texts) of every row.

    Null text is empty; a text of any length is compared whole. Texts without words are linked to equal texts only. Classes are of texts: rows that share
    a doc_id or have none are told apart by their texts, and a class without any doc_id has a null class_id. Ties do
    not arise: classes are components. Other columns are ignored; no rows: no rows.
    """
    each, texts = text_classes(docs, k, least, bands, rows, few, hot)
    return each.join(texts, ["x", "y"]).select("doc_id", "class_id", "n_links")
