"""Near-duplicate embeddings by products of int8 tiles with exact error bounds.

Equal vectors are one class from the start. A class's vector is scaled to length 1 and quantised to whole numbers of 8 bits with
a scale of its own; the length of what the quantisation lost is kept, so for each pair the distance between the integer product
and the cosine has a proven bound. Tiles of vectors are multiplied in whole numbers; pairs whose bound leaves the threshold
open are computed again in double precision, pairs that lie surely above it are links as they are.

Which tiles meet: vectors belong to the nearest of ``pivots`` vectors, and a vector can have links in another pivot's cell only if it is
no further from the plane between both than a linked pair may be apart. It is sent to the tiles of such cells only. Pivots decide
how much work is done, never what is found.

A pair of tiles gives the number of links of each vector and one row to join it to its component, so rows do not grow with
the pairs of a group of near copies.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contextlake.llm import textkit
from contextlake.llm.components import connected_components
from contextlake.llm.store import written

#: rounding of float32 estimates and of norms, far above what they can be off
SLACK = 1e-5
#: a product of so many components of 8 bits is exact in float32
EXACT = 1024


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 components, scale, length of the error) of unit rows."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    lost = x - q * scale[:, None]
    return q, scale, np.sqrt((lost * lost).sum(axis=1))


def int_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 rows, by float32 products of at most EXACT components."""
    out = np.zeros((len(a), len(b)), np.float32 if a.shape[1] <= EXACT else np.float64)
    for lo in range(0, a.shape[1], EXACT):
        out += a[:, lo : lo + EXACT].astype(np.float32) @ b[:, lo : lo + EXACT].astype(np.float32).T
    return out


def linked_pairs(a: np.ndarray, b: np.ndarray, least: float, same: bool, rows: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of a, rows of b) with a cosine of least or more; of one tile with itself (same) each pair once."""
    qa, sa, ea = quantised(a)
    qb, sb, eb = (qa, sa, ea) if same else quantised(b)
    for lo in range(0, len(a), rows):
        part = slice(lo, lo + rows)
        first = lo if same else 0
        near = int_products(qa[part], qb[first:])
        near *= sa[part, None].astype(np.float32)
        near *= sb[None, first:].astype(np.float32)
        # |cos - near| <= |lost a| |b| + |kept a| |lost b|
        reach = ea[part] + (1 + ea[part]) * eb[first:].max() + SLACK
        i, j = np.nonzero(near >= (least - reach)[:, None].astype(np.float32))
        value = near[i, j].astype(np.float64)
        i, j = i + lo, j + first
        bound = ea[i] + (1 + ea[i]) * eb[j] + SLACK
        open_ = np.abs(value - least) <= bound
        ok = value > least
        again = np.flatnonzero(open_)
        for p in range(0, len(again), 1 << 15):
            some = again[p : p + (1 << 15)]
            ok[some] = (a[i[some]] * b[j[some]]).sum(axis=1) >= least
        if same:
            ok &= i < j
        yield i[ok], j[ok]


def join_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Makes label (the least index that each node is joined to) hold for the new links (i, j) too."""
    while True:
        x, y = label[i], label[j]
        apart = x != y
        if not apart.any():
            return
        i, j, x, y = i[apart], j[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            further = label[label]
            if (further == label).all():
                break
            label[:] = further


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return unit(column.flatten().to_numpy().astype(np.float64).reshape(-1, dim))


def _tile_links(least: float):
    def run(rows: pa.Table) -> pa.Table:
        dim, same = rows["dim"][0].as_py(), rows["one"][0] == rows["two"][0]
        second = rows["second"].to_numpy(zero_copy_only=False)
        order = np.argsort(second, kind="stable")
        rows = rows.take(order)
        cut = len(second) - int(second.sum())
        x, cid, copies = _matrix(rows["embedding"], dim), rows["cid"].to_numpy(), rows["copies"].to_numpy()
        links, label = np.zeros(len(x), np.int64), np.arange(len(x))
        # a tile's vectors may have been sent where none of the other's was
        if same or 0 < cut < len(x):
            for i, j in linked_pairs(x[:cut], x[:cut] if same else x[cut:], least, same):
                j = j if same else j + cut
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                join_labels(label, i, j)
        some, joined = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(x)))
        none = pa.nulls(len(some), pa.int64()), pa.nulls(len(joined), pa.int64())
        return pa.table({"a": np.concatenate([cid[some], cid[joined]]), "b": pa.chunked_array([none[0], pa.array(cid[label[joined]])]), "links": pa.chunked_array([pa.array(links[some]), none[1]])})

    return run


def _cells(pivots: np.ndarray, reach: float):
    """Adds the nearest pivot (cell) and the cells (near) in which a linked vector can lie."""
    apart = np.sqrt(np.maximum(((pivots[:, None] - pivots[None]) ** 2).sum(axis=2), 0)) if len(pivots) else np.zeros((0, 0))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(3).to_numpy()
            cell, near = np.zeros(len(dims), np.int32), [[0]] * len(dims)
            own = np.flatnonzero(dims == pivots.shape[1]) if len(pivots) else np.zeros(0, np.int64)
            if len(own):
                at = _matrix(batch.column(1).take(pa.array(own)), pivots.shape[1]) @ pivots.T
                nearest = at.argmax(axis=1)
                # x·(p - q) <= |x - y| |p - q| for every y of q's cell
                meets = at.max(axis=1)[:, None] - at <= reach * apart[nearest] + SLACK
                cell[own] = nearest
                for k, m in zip(own.tolist(), meets, strict=True):
                    near[k] = np.flatnonzero(m).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(near, pa.list_(pa.int32()))], names=[*batch.schema.names, "cell", "near"])
        textkit.give_back()

    return run


def near_vectors(rows: DataFrame, least: float = 0.9, tile_values: int = 1 << 19, pivots: int = 64) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of (vec_id, embedding).

    Vectors that are null, empty, zero or hold null, NaN or infinite components have no links; vectors of unlike lengths have none with each
    other. Equal vectors are linked. component_id is the least vec_id that links reach, a null one only if all are null; kept is
    vec_id = component_id, false for a null vec_id. Rows that share a vec_id are vectors of their own. Other columns (also a clashing
    ``cell`` or ``cid``) are ignored; no rows: no rows. ``tile_values`` components make
    a tile; at most ``pivots`` vectors, and no more than tiles, are collected as pivots.
    """
    numbers = F.col("embedding").cast("array<double>")
    fine = F.coalesce((F.size(numbers) > 0) & F.forall(numbers, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(numbers, lambda v: v != 0), F.lit(False))
    base = rows.select("vec_id", F.when(fine, F.col("embedding")).alias("embedding"))
    classes = base.where("embedding IS NOT NULL").groupBy("embedding").agg(F.count("*").alias("copies"), F.min("vec_id").alias("rep"))
    classes = written(classes.withColumns({"cid": F.monotonically_increasing_id(), "dim": F.size("embedding")}), "vectors-classes")
    # no more cells than tiles, so a vector is sent to about as many tiles as there are
    values = classes.agg(F.sum(F.col("dim").cast("long"))).first()[0] or 0
    pivots = min(pivots, -(-values // tile_values))
    sample = [np.array(r.embedding, float)[None] for r in classes.orderBy(F.xxhash64("embedding"), "cid").limit(pivots).select("embedding").collect()]
    dims = [x.shape[1] for x in sample]
    dim = max(set(dims), key=lambda d: (dims.count(d), d), default=1)
    centres = np.concatenate([unit(x) for x in sample if x.shape[1] == dim] or [np.zeros((0, dim))])
    kind = dict(classes.dtypes)["embedding"]
    placed = classes.select("cid", "embedding", "copies", "dim").mapInArrow(_cells(centres, float(np.sqrt(max(0.0, 2 - 2 * least)))), f"cid long, embedding {kind}, copies long, dim int, cell int, near array<int>")
    placed = written(placed, "vectors-cells")
    tiles = placed.groupBy("dim", "cell").agg(F.ceil(F.count("*") * F.col("dim") / F.lit(tile_values)).cast("int").alias("tiles"))
    own = placed.join(tiles, ["dim", "cell"]).withColumn("tile", F.pmod(F.xxhash64("cid"), F.col("tiles")).cast("int")).drop("tiles")
    other = tiles.select("dim", F.col("cell").alias("to"), "tiles")
    sent = own.withColumn("to", F.explode("near")).drop("near").join(other, ["dim", "to"]).withColumn("to_tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    mine, theirs = F.struct(F.col("cell").alias("c"), F.col("tile").alias("t")), F.struct(F.col("to").alias("c"), F.col("to_tile").alias("t"))
    met = sent.select("dim", F.least(mine, theirs).alias("one"), F.greatest(mine, theirs).alias("two"), (mine > theirs).alias("second"), "cid", "copies", "embedding")
    found = written(met.groupBy("dim", "one", "two").applyInArrow(_tile_links(least), "a long, b long, links long"), "vectors-links")
    links = found.where("links IS NOT NULL").groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    joined = connected_components(found.where("b IS NOT NULL").select("a", "b")).select(F.col("id").alias("cid"), "component")
    of = classes.join(links, "cid", "left").join(joined, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least_id = of.groupBy("component").agg(F.min("rep").alias("component_id"))
    facts = of.join(least_id, "component").select("embedding", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id", F.lit(True).alias("known"))
    out = base.join(facts, "embedding", "left")
    component = F.when(F.col("known"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
