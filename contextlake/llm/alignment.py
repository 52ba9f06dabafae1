"""Alignment of two tokenizers, each distinct segment of text once.

A text is cut before runs of spaces. That is right where no entry of either vocabulary has a space behind another character
(``cuts_hold`` looks at all of them; otherwise texts stay whole) and where the character before the run is neither a space of any kind nor the mark
that the second vocabulary writes for a space: then no merge can cross the cut, and both tokenizers give the tokens of the
whole text one segment after the other.

1. Texts are written as numbers of segments, with a dictionary for each block of texts.
2. Dictionary entries of all blocks are sorted by segment; each distinct segment is tokenised and aligned once, and the alignment
   goes to the entries of all blocks, which are gathered into few rows for each block.
3. Links of a pair of ids are summed within blocks and then over the corpus, and go back to the blocks that have the pair.
4. Each block composes its texts from its dictionary: sums, and a digest of the segments' groups in order.

No text and no token of a text is shuffled, only dictionary entries and numbers; memory follows one block.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from contextlake.llm import textkit
from contextlake.llm.store import written

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
#: the second vocabulary's mark for a space
MARK = "▁"
#: characters that one engine or another takes for white space, besides those of str.isspace
_DOUBTFUL = frozenset(MARK + "\u180e\u200b\u200c\u200d\u2060\ufeff\ufffd")


def _byte_of() -> dict[str, int]:
    """The byte of each character in which byte-level vocabularies are written: printable ones stand for themselves, the others follow from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=4)
def vocabularies(byte_bpe: str, pieces: str) -> tuple[Tokenizer, sentencepiece.SentencePieceProcessor, list[bytes], list[bytes]]:
    """Both tokenizers and the bytes of each of their ids; loaded once a process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel ones
    a = Tokenizer.from_file(byte_bpe)
    a.encode_special_tokens = True
    byte_of = _byte_of()
    vocab = a.get_vocab(with_added_tokens=True)
    a_bytes = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        a_bytes[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
    b = sentencepiece.SentencePieceProcessor(model_file=pieces)
    b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in range(b.get_piece_size()))]
    return a, b, a_bytes, b_bytes


def ends_safely(part: str) -> bool:
    """Whether a cut behind this part of a text, before a space, is one that no merge crosses."""
    return part != "" and not part[-1].isspace() and part[-1] not in _DOUBTFUL


@lru_cache(maxsize=4)
def cuts_hold(byte_bpe: str, pieces: str) -> bool:
    """No entry of either vocabulary has a space behind a character after which texts are cut."""
    _, _, *both = vocabularies(byte_bpe, pieces)
    entries = {x.decode("utf-8", "replace") for own in both for x in own if b" " in x[1:]}
    return not any(x[i] == " " and ends_safely(x[:i]) for x in entries for i in range(1, len(x)))


def segments(text: str, cuts: bool = True) -> list[str]:
    """The segments of " " + text, each without its first space. An empty text has none."""
    if not text:
        return []
    if not cuts:
        return [text]
    parts = text.split(" ")
    if all(map(ends_safely, parts)):
        return parts
    out, held = [], [parts[0]]
    for before, part in zip(parts, parts[1:], strict=False):
        if ends_safely(before):
            out.append(" ".join(held))
            held = [part]
        else:
            held.append(part)
    last = " ".join(held)
    # a lone space at the end would be an empty text to the second tokenizer
    if last or not out:
        out.append(last)
    else:
        out[-1] += " "
    return out


def _packed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor().compress(data)


def _unpacked(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


class _Codes(dict):
    def __missing__(self, segment: str) -> int:
        self[segment] = n = len(self)
        return n


#: texts of a block, many to a row: their ids, numbers of segments and packed segments; and the block's dictionary
_CODED = pa.schema({"block": pa.int64(), "doc_ids": pa.list_(pa.int64()), "sizes": pa.list_(pa.int32()), "codes": pa.binary(), "code": pa.int32(), "segment": pa.string(), "n": pa.int64()})


def _coded_rows(byte_bpe: str, pieces: str, entries: int):
    def filled(rows: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(rows, f.type)) for f in _CODED], schema=_CODED)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = cuts_hold(byte_bpe, pieces)
        block = TaskContext.get().partitionId() << 32
        codes, seen = _Codes(), np.zeros(0, np.int64)

        def dictionary() -> Iterator[pa.RecordBatch]:
            words = list(codes)
            for lo in range(0, len(words), 1 << 15):
                part = words[lo : lo + (1 << 15)]
                size = len(part)
                yield filled(size, block=pa.array(np.full(size, block)), code=pa.array(np.arange(lo, lo + size, dtype=np.int32)), segment=pa.array(part, pa.string()), n=pa.array(seen[lo : lo + size]))

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                own = []
                for text in some.column(1).to_pylist():
                    found = segments(text, cuts)
                    own.append(np.fromiter(map(codes.__getitem__, found), np.int32, len(found)))
                flat = np.concatenate(own)
                counts = np.bincount(flat, minlength=len(codes))
                counts[: len(seen)] += seen
                seen = counts
                one = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
                yield filled(1, block=pa.array([block]), doc_ids=one(some.column(0)), sizes=one(pa.array([len(x) for x in own], pa.int32())), codes=pa.array([_packed(flat.tobytes())]))
                if len(codes) >= entries:
                    yield from dictionary()
                    codes, seen, block = _Codes(), np.zeros(0, np.int64), block + 1
        yield from dictionary()
        textkit.give_back()

    return run


def align(segment: str, a: list[int], b: list[int], a_bytes: list[bytes], b_bytes: list[bytes]) -> tuple[str, list[int], list[int]] | None:
    """(groups as text, last id of a and of b in each group), or None where either's bytes are not those of " " + segment."""
    xs, ys = [a_bytes[i] for i in a], [b_bytes[i] for i in b]
    whole = b" " + segment.encode()
    if b"".join(xs) != whole or b"".join(ys) != whole:
        return None
    if len(a) == 1 or len(b) == 1:  # one group, and nothing to find
        return f"{','.join(map(str, a))}|{','.join(map(str, b))}", [a[-1]], [b[-1]]
    groups, last_a, last_b = [], [], []
    i = j = x = y = from_i = from_j = 0
    while i < len(a):
        x += len(xs[i])
        i += 1
        while y < x:
            y += len(ys[j])
            j += 1
        if x == y:
            groups.append(f"{','.join(map(str, a[from_i:i]))}|{','.join(map(str, b[from_j:j]))}")
            last_a.append(a[i - 1])
            last_b.append(b[j - 1])
            from_i, from_j = i, j
    return ";".join(groups), last_a, last_b


#: entries of one block's dictionary: lists of one length, groups joined by line feeds and packed, la and lb with n_links[i] ids for codes[i]
_ENTRIES = {"codes": pa.int32(), "ok": pa.bool_(), "n": pa.int64(), "n_a": pa.int32(), "n_b": pa.int32(), "n_links": pa.int32()}
_ALIGNED = "block long, wrong boolean, codes array<int>, ok array<boolean>, n array<long>, n_a array<int>, n_b array<int>, n_links array<int>, la array<int>, lb array<int>, groups binary"


def _by_block(held: list[pa.Table]) -> pa.RecordBatch:
    """One row for each block of what is held."""
    every = pa.concat_tables(held)
    every = every.take(pa.array(np.argsort(every["block"].to_numpy(), kind="stable"))).combine_chunks()
    block = every["block"].to_numpy()
    heads = np.flatnonzero(np.diff(block, prepend=-1))
    offsets = np.concatenate([heads, [len(block)]])
    lists = lambda at, column: pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), column)
    column = {c: every[c].combine_chunks() for c in every.column_names}
    column["n_links"] = pc.list_value_length(column["la"])
    upto = np.concatenate([[0], np.cumsum(column["n_links"].to_numpy(zero_copy_only=False))])[offsets]
    ok = column["ok"].to_numpy(zero_copy_only=False)
    out = {"block": pa.array(block[heads]), "wrong": pa.array(~np.logical_and.reduceat(ok, heads))}
    out |= {c: lists(offsets, column[c]) for c in _ENTRIES} | {c: lists(upto, column[c].flatten()) for c in ("la", "lb")}
    out["groups"] = pa.array([_packed(g.encode()) for g in pc.binary_join(lists(offsets, column["groups"]), "\n").to_pylist()], pa.binary())
    return pa.RecordBatch.from_pydict(out)


def _aligned_rows(byte_bpe: str, pieces: str, most: int = 1 << 19):
    """Over (block, code, n, segment) sorted by segment."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_tok, b_tok, a_bytes, b_bytes = vocabularies(byte_bpe, pieces)
        kinds = {"ok": pa.bool_(), "n_a": pa.int32(), "n_b": pa.int32(), "groups": pa.string(), "la": pa.list_(pa.int32()), "lb": pa.list_(pa.int32())}
        kept: dict[str, tuple] = {}
        held, weight = [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                some = batch.slice(lo, 2048)
                coded = some.column(3).dictionary_encode()
                names = coded.dictionary.to_pylist()
                new = [s for s in names if s not in kept]
                a = [e.ids for e in a_tok.encode_batch([" " + s for s in new], add_special_tokens=False)]
                b = b_tok.encode(new, num_threads=1)
                for s, x, y in zip(new, a, b, strict=True):
                    found = align(s, x, y, a_bytes, b_bytes)
                    kept[s] = (False, 0, 0, "", [], []) if found is None else (True, len(x), len(y), *found)
                rows = [kept[s] for s in names]
                own = {"block": some.column(0), "codes": some.column(1), "n": some.column(2)}
                own |= {c: pa.array([r[k] for r in rows], kind).take(coded.indices) for k, (c, kind) in enumerate(kinds.items())}
                held.append(pa.table(own))
                weight += some.num_rows + len(own["la"].flatten())
                if weight >= most:
                    yield _by_block(held)
                    held, weight = [], 0
                # rows are sorted: only the last segment can go on
                kept = {names[-1]: kept[names[-1]]} if names else {}
        if held:
            yield _by_block(held)
        textkit.give_back()

    return run


def _flat(rows: pa.Table, name: str) -> np.ndarray:
    return rows[name].combine_chunks().flatten().to_numpy(zero_copy_only=False)


def _key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.int64) << 32) | b.astype(np.int64)


def _pair_rows(rows: pa.Table, n: np.ndarray) -> pa.Table:
    """(block, pa, pb, n) of a block's entries that occur n times each."""
    links = np.repeat(n, _flat(rows, "n_links"))
    keys, place = np.unique(_key(_flat(rows, "la"), _flat(rows, "lb")), return_inverse=True)
    counts = np.zeros(len(keys), np.int64)
    np.add.at(counts, place, links)
    block = np.full(len(keys), rows["block"][0].as_py() if rows.num_rows else 0)
    return pa.table({"block": block, "pa": (keys >> 32).astype(np.int32), "pb": (keys & 0xFFFFFFFF).astype(np.int32), "n": counts})


def _texts(docs: pa.Table) -> Iterator[np.ndarray]:
    """The segments of each text, in the order of doc_ids."""
    for sizes, codes in zip(docs["sizes"].to_pylist(), docs["codes"].to_pylist(), strict=True):
        yield from np.split(np.frombuffer(_unpacked(codes), np.int32), np.cumsum(sizes)[:-1])


def _void(docs: pa.Table, rows: pa.Table) -> pa.Table:
    """What the texts of a block that have no tokens would have added to its pairs, below zero."""
    codes = _flat(rows, "codes")
    ok = np.ones(int(codes.max(initial=-1)) + 1, bool)
    ok[codes] = _flat(rows, "ok")
    less = np.zeros(len(ok), np.int64)
    for own in _texts(docs):
        if not ok[own].all():
            less += np.bincount(own, minlength=len(ok))
    return _pair_rows(rows, -less[codes])


def _composed(docs: pa.Table, facts: pa.Table) -> pa.Table:
    """The texts of one block from its dictionary (rows with codes) and its pairs of ids (rows with a pair)."""
    words, pairs = facts.filter(pc.is_valid(facts["codes"])), facts.filter(pc.is_null(facts["codes"]))
    known = _key(pairs["pa"].to_numpy(), pairs["pb"].to_numpy())
    order = np.argsort(known)
    # a pair that only texts without tokens have is in no table
    known, count = np.concatenate([known[order], [-1]]), np.concatenate([pairs["count"].to_numpy()[order], [0]])
    best = np.concatenate([pairs["best"].to_numpy(zero_copy_only=False)[order].astype(np.int64), [0]])
    links = _key(_flat(words, "la"), _flat(words, "lb"))
    at = np.searchsorted(known[:-1], links)
    at = np.where(known[at] == links, at, len(known) - 1)
    codes, n_links = _flat(words, "codes"), _flat(words, "n_links").astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(n_links)])
    summed = lambda v: np.diff(np.concatenate([[0], np.cumsum(v[at])])[ends])
    # every code has one entry
    placed = np.empty(len(codes), np.int64)
    placed[codes] = np.arange(len(codes))
    columns = {"n_a": _flat(words, "n_a").astype(np.int64), "n_b": _flat(words, "n_b").astype(np.int64), "n_groups": n_links, "n_links": n_links, "n_best": summed(best), "count_sum": summed(count)}
    columns, ok = {c: v[placed] for c, v in columns.items()}, _flat(words, "ok").astype(bool)[placed]
    entries = [g for part in words["groups"].to_pylist() for g in _unpacked(part).decode().split("\n")]
    groups = [entries[i] for i in placed.tolist()]
    out: dict[str, list] = {c: [] for c in columns} | {"groups_sha256": []}
    for own in _texts(docs):
        good = len(own) > 0 and bool(ok[own].all())
        for c, v in columns.items():
            out[c].append(int(v[own].sum()) if good else 0)
        digest = hashlib.sha256()
        for p in range(0, len(own) if good else 0, 1 << 16):
            digest.update(((";" if p else "") + ";".join([groups[c] for c in own[p : p + (1 << 16)].tolist()])).encode())
        out["groups_sha256"].append(digest.hexdigest() if good else "")
    return pa.table({"doc_id": docs["doc_ids"].combine_chunks().flatten()} | {c: pa.array(v, pa.string() if c == "groups_sha256" else pa.int64()) for c, v in out.items()})


def align_tokenizers(docs: DataFrame, byte_bpe: str = BYTE_BPE, pieces: str = PIECES, entries: int = 1 << 20) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of docs (doc_id, text).

    A text that is null or empty, or that either tokenizer does not give back byte by byte, has no tokens: zeros and an empty
    digest column, and none of its links count. Repeated rows are texts of their own, whatever their doc_id, also a null one. A text of any
    length is one block's at most; a segment without spaces is tokenised whole. Other columns are ignored; no rows: no rows. The files of both
    vocabularies lie under the same path on every executor; a block ends after ``entries`` distinct segments.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    coded = written(base.mapInArrow(_coded_rows(byte_bpe, pieces, entries), "block long, doc_ids array<long>, sizes array<int>, codes binary, code int, segment string, n long"), "alignment-coded")
    texts, words = coded.where("code IS NULL").select("block", "doc_ids", "sizes", "codes"), coded.where("code IS NOT NULL").select("block", "code", "n", "segment")
    # equal segments stand together, and each goes through the tokenizers once
    aligned = words.repartition("segment").sortWithinPartitions("segment").mapInArrow(_aligned_rows(byte_bpe, pieces), _ALIGNED)
    aligned = written(aligned, "alignment-segments")
    pair = "block long, pa int, pb int, n long"
    own = aligned.select("block", "n", "n_links", "la", "lb").groupBy("block").applyInArrow(lambda rows: _pair_rows(rows, _flat(rows, "n")), pair)
    wrong = aligned.where("wrong").select("block").distinct()
    if not wrong.isEmpty():
        # links of texts without tokens do not count
        void = texts.join(wrong, "block", "left_semi").groupBy("block").cogroup(aligned.drop("groups").join(wrong, "block", "left_semi").groupBy("block")).applyInArrow(_void, pair)
        own = own.unionByName(void).groupBy("block", "pa", "pb").agg(F.sum("n").alias("n")).where("n > 0")
    own = written(own, "alignment-pairs")
    totals = own.groupBy("pa", "pb").agg(F.sum("n").alias("count"))
    most = totals.groupBy("pb").agg(F.max("count").alias("most"))
    totals = totals.join(most, "pb").select("pa", "pb", "count", (F.col("count") == F.col("most")).alias("best"))
    known = own.join(totals, ["pa", "pb"]).select("block", "pa", "pb", "count", "best")
    facts = aligned.drop("n", "wrong").unionByName(known, allowMissingColumns=True)
    out = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return texts.groupBy("block").cogroup(facts.groupBy("block")).applyInArrow(_composed, out)
