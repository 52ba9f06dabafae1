"""URL filters: host and path rules, and two Markov models of URLs for what no rule decides.

The models are smoothed variable-order Markov chains over the bytes of ``host + path``: one of the
URLs that rules allow, one of those that rules block. The probability of a byte after a context of n
bytes is ``(count + alpha * p_shorter) / (total + alpha)``, from no context up to ``order`` bytes, so
a context that was never seen leaves the shorter one's probability. A URL's score is the difference of the two
log-likelihoods for each byte. Decided URLs held out of the counts set the threshold at which the two kinds of mistakes weigh least.

Counts are exact and grow with the input: a window is a byte with the ``order`` bytes before it, packed into a long, and
windows are counted by Spark. The log-likelihood difference of a window follows from the counts of the windows that share
its last bytes; it is worked out once for each distinct window, in groups that share the two bytes before. Windows that make
up more than one in ``heavy`` of all (so at most ``heavy`` of them) are looked up in the tasks, all others are joined.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contextlake.llm import textkit
from contextlake.llm.store import checkpointed

U64 = np.uint64


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, with A-Z in lower case; without :// or null: empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1), _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def apply_rules(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds rule and rule_verdict: of the longest rule that fits (then by name), else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((F.col("host") == r.host) | F.endswith("host", F.lit("." + r.host))) & F.startswith("path", F.lit(r.path))
        rule, verdict = F.when(fits, r.name).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return pages.withColumn("rule", rule).withColumn("rule_verdict", verdict)


BITS = U64(9)
#: fixed point of sums, so that their order does not matter
ONE = 1 << 32


def windows(data: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """At every byte: it and the ``order`` bytes before it in its row, 9 bits each, the byte itself lowest; 0 stands before a row's start."""
    at = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    now = data.astype(U64) + U64(1)
    out = now.copy()
    for j in range(1, order + 1):
        before = np.zeros(len(data), U64)
        before[j:] = now[:-j]
        before[at < j] = 0
        out |= before << (BITS * U64(j))
    return out


def _last(window: np.ndarray, n: int) -> np.ndarray:
    return window & ((U64(1) << (BITS * U64(n))) - U64(1))


def _count(order: int, max_bytes: int):
    """Task function: (side, text) batches to (window, m, n0, n1): how often, and how often in learned texts of side 0 and 1 (side 2 is not learned)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            side = np.asarray(batch.column(0).to_numpy(zero_copy_only=False)).astype(np.int64)
            data, offsets = textkit.buffers(batch.column(1))
            for lo, hi in textkit.slices(offsets, max_bytes):
                part, offs = textkit.documents(data, offsets, lo, hi)
                of = np.repeat(side[lo:hi], np.diff(offs))
                found, at = np.unique(windows(part, offs, order), return_inverse=True)
                sums = [np.bincount(at[of == s], minlength=len(found)) for s in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(np.bincount(at, minlength=len(found))), *map(pa.array, sums)], names=["w", "m", "n0", "n1"])

    return run


def _sums(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, sums of the columns of n)."""
    found, at = np.unique(keys, return_inverse=True)
    return found, np.stack([np.bincount(at, weights=column, minlength=len(found)) for column in n])


def chances(w: np.ndarray, n: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], order: int, alpha: float) -> np.ndarray:
    """(2, len(w)) probabilities of the windows' last bytes after the bytes before, on both sides.

    w has all windows that share the two bytes before the last one, n their counts (2, len(w)); pairs are the keys and counts of the
    last two bytes of all windows.
    """
    p = np.full((2, len(w)), 1 / 256)
    for size in range(order + 1):
        gram = _last(w, size + 1)
        keys, counts = _sums(_last(pairs[0], size + 1), pairs[1]) if size < 2 else _sums(gram, n)
        context, totals = _sums(keys >> BITS, counts)
        count = counts[:, np.searchsorted(keys, gram)]
        total = totals[:, np.searchsorted(context, gram >> BITS)]
        p = (count + alpha * p) / (total + alpha)
    return p


def _differences(pairs: tuple[np.ndarray, np.ndarray], order: int, alpha: float):
    """Task function: (before, w, m, n0, n1) batches sorted by before, the two bytes before the last, to (w, m, d), in fixed point."""

    def judged(table: pa.Table) -> Iterator[pa.RecordBatch]:
        before, w, m, n0, n1 = (np.asarray(table.column(i).to_numpy()) for i in range(5))
        edge = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1], [True]]))
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            p = chances(w[lo:hi].view(U64), np.stack([n0[lo:hi], n1[lo:hi]]), pairs, order, alpha)
            d = np.rint((np.log(p[1]) - np.log(p[0])) * ONE).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(w[lo:hi]), pa.array(m[lo:hi]), pa.array(d)], names=["w", "m", "d"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            before = batch.column(0).to_numpy()
            changes = np.flatnonzero(before != before[-1])
            cut = int(changes[-1]) + 1 if len(changes) else 0
            if held and (cut or held[-1].column(0)[0].as_py() != before[0]):
                yield from judged(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            elif cut:
                yield from judged(pa.Table.from_batches([batch.slice(0, cut)]))
            held.append(batch.slice(cut))
        if held:
            yield from judged(pa.Table.from_batches(held))

    return run


def _look_up(known: tuple[np.ndarray, np.ndarray], order: int, max_bytes: int):
    """Task function: (row, text) batches to (row, bytes, d, rest): the sum over the known windows and the others, each with its count."""
    rest_type = pa.list_(pa.struct([("w", pa.int64()), ("n", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = known
        for batch in batches:
            data, offsets = textkit.buffers(batch.column(1))
            for lo, hi in textkit.slices(offsets, max_bytes):
                part, offs = textkit.documents(data, offsets, lo, hi)
                w = windows(part, offs, order)
                row = np.repeat(np.arange(hi - lo), np.diff(offs))
                at = np.minimum(np.searchsorted(keys, w), max(0, len(keys) - 1))
                hit = keys[at] == w if len(keys) else np.zeros(len(w), bool)
                # sums of longs by differences of running sums
                run_up = np.concatenate([[0], np.cumsum(np.where(hit, values[at], 0) if len(keys) else np.zeros(len(w), np.int64))])
                order_of = np.lexsort((w[~hit], row[~hit]))
                r, v = row[~hit][order_of], w[~hit][order_of]
                first = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (v[1:] != v[:-1])])) if len(r) else np.zeros(0, np.int64)
                n = np.diff(np.concatenate([first, [len(r)]]))
                ends = np.concatenate([[0], np.cumsum(np.bincount(r[first], minlength=hi - lo))]).astype(np.int32)
                rest = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(v[first].view(np.int64)), pa.array(n.astype(np.int64))], names=["w", "n"]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(offs)), pa.array(run_up[offs[1:]] - run_up[offs[:-1]]), rest.cast(rest_type)], names=["row", "bytes", "d", "rest"])

    return run


def score_texts(texts: DataFrame, order: int, alpha: float, heavy: int, max_bytes: int) -> tuple[DataFrame, bool]:
    """(row, score) of texts (row, side, text), and whether both sides were learned from."""
    counted = texts.select("side", "text").mapInArrow(_count(order, max_bytes), "w long, m long, n0 long, n1 long")
    counted = checkpointed(counted.groupBy("w").agg(*[F.sum(c).alias(c) for c in ("m", "n0", "n1")]))
    two = F.col("w").bitwiseAND(F.lit((1 << 18) - 1))
    # at most 257**2 rows
    got = counted.groupBy(two.alias("w")).agg(F.sum("m"), F.sum("n0"), F.sum("n1")).orderBy("w").toArrow()
    pairs = (got.column(0).to_numpy().view(U64), np.stack([got.column(i).to_numpy() for i in (2, 3)]))
    total = int(got.column(1).to_numpy().sum())
    before = F.shiftright("w", 9).bitwiseAND(F.lit((1 << 18) - 1))
    dealt = counted.select(before.alias("before"), "w", "m", "n0", "n1").repartition("before").sortWithinPartitions("before")
    judged = checkpointed(dealt.mapInArrow(_differences(pairs, order, alpha), "w long, m long, d long"))
    # the counts m sum up to total, so at most ``heavy`` windows have so much of it
    many = judged.where(F.col("m") * heavy > total).select("w", "d").orderBy("w").toArrow()
    known = (many.column(0).to_numpy().view(U64), many.column(1).to_numpy())
    looked = checkpointed(texts.select("row", "text").mapInArrow(_look_up(known, order, max_bytes), "row long, bytes long, d long, rest array<struct<w:long,n:long>>"))
    rest = looked.select("row", F.explode("rest").alias("x")).select("row", "x.w", "x.n").join(judged.where(F.col("m") * heavy <= total).select("w", "d"), "w")
    rest = rest.groupBy("row").agg(F.sum(F.col("n") * F.col("d")).alias("more"))
    score = (F.col("d") + F.coalesce("more", F.lit(0))).cast("double") / F.lit(float(ONE)) / F.greatest("bytes", F.lit(1))
    return looked.join(rest, "row", "left").select("row", score.alias("score")), bool((pairs[1].sum(axis=1) > 0).all()) if total else False


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, order: int = 5, alpha: float = 1.0, heavy: int = 1 << 16, max_bytes: int = 1 << 20) -> DataFrame:
    """page_id, host, path, rule, verdict, score (block likelier above the threshold) of every page.

    Null URLs and URLs without :// have empty host and path; they get the verdict of score 0. If the
    rules decide no URL of one side, what they leave open is allowed. Rows are judged one by one, so repeated rows
    and ties get equal verdicts, and a null page_id is a value like others. order is 6 at most. Other columns are ignored; no rows: no rows.
    """
    judged = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = checkpointed(apply_rules(judged, rules).withColumn("row", F.monotonically_increasing_id()))
    text = F.concat("host", "path")
    held_out = F.pmod(F.crc32(text), F.lit(5)) == 0
    side = F.when(F.col("rule").isNull() | held_out, 2).when(F.col("rule_verdict") == "block", 1).otherwise(0)
    scores, known = score_texts(judged.select("row", side.alias("side"), text.alias("text")), order, alpha, heavy, max_bytes)
    scored = checkpointed(judged.join(scores, "row"))
    threshold = 0.0
    if known:
        of = F.when(F.col("rule_verdict") == "block", 1).otherwise(0)
        at = F.round(F.greatest(F.least("score", F.lit(5.0)), F.lit(-5.0)), 3)
        # at most 2 x 10,001 rows
        bins = scored.where("rule IS NOT NULL").where(held_out).groupBy(of.alias("side"), at.alias("at")).agg(F.count("*").alias("n")).collect()
        threshold = _threshold([(r.side, r.at, r.n) for r in bins])
    own = F.when((F.col("score") > threshold) & F.lit(known), "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", own).alias("verdict"), "score")


def _threshold(bins: list[tuple[int, float, int]]) -> float:
    """The score with the least sum of both sides' shares of mistakes; nearest 0 among equals."""
    at = np.array(sorted({0.0, *(v for _, v, _ in bins)}))
    sides = np.zeros((2, len(at)))
    for s, v, n in bins:
        sides[s, np.searchsorted(at, v)] += n
    totals = sides.sum(axis=1)
    if not totals.all():
        return 0.0
    cost = np.round(1 - np.cumsum(sides[0]) / totals[0] + np.cumsum(sides[1]) / totals[1], 12)
    return float(min(at[cost == cost.min()], key=abs))
