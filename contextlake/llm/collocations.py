"""Phrases whose words occur together, by vertical positional inverted lists.

Texts are cut into blocks of about ``block_words`` words of one language. Within a block every word has the list of the places
where it stands; a piece's end takes a place of its own, so no phrase runs over it. Phrases grow by one word at a time: the
places of a frequent phrase of k words are merge-joined with the postings of the words k places on, and of what comes out only
phrases whose last k words are frequent too are looked at. The lengths of a phrase's lists, summed over all blocks, are its
exact frequency.

Between blocks only keys (prefix, word) and lengths are summed; the frequent ones get numbers and go back to the blocks that
have them, gathered into few rows. A block's lists meet those keys in one task, whose memory follows ``block_words`` and not a
phrase's frequency.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contextlake.llm import textkit
from contextlake.llm.store import written

#: A-Z in lower case, piece ends as line feeds, tabs as spaces
_FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)} | dict.fromkeys(".,;:!?\x0b\x0c\r", "\n") | {"\t": " "})


class _Codes(dict):
    """A number for each word in order of arrival; 0 is no word, 1 the end of a piece."""

    def __init__(self) -> None:
        super().__init__({"": 0, "\n": 1})

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _parts(text: str, most: int = 1 << 20) -> Iterator[str]:
    """text in parts of about ``most`` characters that end behind a space or a line feed."""
    at = 0
    while at < len(text):
        end = at + most
        if end < len(text):
            inside = max(text.rfind(" ", at, end), text.rfind("\n", at, end))
            if inside < 0:
                inside = min((p for p in (text.find(" ", end), text.find("\n", end)) if p >= 0), default=len(text) - 1)
            end = inside + 1
        yield text[at:end]
        at = end


def word_places(text: str, codes: _Codes) -> Iterator[np.ndarray]:
    """The codes of a text's words and piece ends in order, part by part."""
    for part in _parts(text.translate(_FOLD)):
        words = part.replace("\n", " \n ").split(" ")
        found = np.fromiter(map(codes.__getitem__, words), np.int32, len(words))
        yield found[found > 0]
    yield np.ones(1, np.int32)


_INDEX = pa.schema({"lang": pa.string(), "block": pa.int64(), "code": pa.int64(), "word": pa.string(), "n": pa.int64(), "sizes": pa.list_(pa.int32()), "gaps": pa.list_(pa.int32())})


def _lists(lang: str, block: int, codes: _Codes, parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(lang, block, code, word, n) of each word of a block, and (block, sizes, gaps) with the lists of all: the first place and then the distances between places."""
    flat = np.concatenate(parts)
    sizes = np.bincount(flat, minlength=len(codes))
    places = np.argsort(flat, kind="stable")[sizes[1] :]
    sizes = sizes[2:]
    gaps = np.diff(places, prepend=0)
    heads = np.cumsum(sizes) - sizes
    gaps[heads] = places[heads]
    words = list(codes)[2:]
    filled = lambda rows, **columns: pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(rows, f.type)) for f in _INDEX], schema=_INDEX)
    one = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v.astype(np.int32)))
    yield filled(1, block=pa.array([block]), sizes=one(sizes), gaps=one(gaps))
    for lo in range(0, len(words), 1 << 15):
        hi = min(len(words), lo + (1 << 15))
        n = hi - lo
        yield filled(n, lang=pa.repeat(pa.scalar(lang), n), block=pa.array(np.full(n, block)), code=pa.array(np.arange(lo, hi)), word=pa.array(words[lo:hi], pa.string()), n=pa.array(sizes[lo:hi]))


def _block_rows(block_words: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[_Codes, list[np.ndarray]]] = {}
        sizes: dict[str, int] = {}
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                for lang, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    codes, parts = held.setdefault(lang, (_Codes(), []))
                    for part in word_places(text, codes):
                        parts.append(part)
                        sizes[lang] = sizes.get(lang, 0) + len(part)
                    # the languages of a task share the bound, so many small ones cannot pass it either
                    while sizes[lang] >= block_words or sum(sizes.values()) >= 2 * block_words:
                        full = max(sizes, key=sizes.__getitem__)
                        yield from _lists(full, block, *held.pop(full))
                        del sizes[full]
                        block += 1
                        if full == lang:
                            break
        for lang, own in held.items():
            yield from _lists(lang, block, *own)
            block += 1
        textkit.give_back()

    return run


def _flat(rows: pa.Table, name: str) -> np.ndarray:
    return rows[name].combine_chunks().flatten().to_numpy()


def _postings(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(frequent words' ids in order, places of such words in order, index of the word at each place) of a block's lists."""
    lists, known = rows.filter(pc.equal(rows["level"], 0)), rows.filter(pc.equal(rows["level"], 1))
    sizes, flat = _flat(lists, "sizes").astype(np.int64), _flat(lists, "gaps").astype(np.int64)
    ids, codes = _flat(known, "ids"), _flat(known, "words")
    by_id = np.argsort(ids)
    rank = np.full(len(sizes), -1)
    rank[codes[by_id]] = np.arange(len(ids))
    upto = np.cumsum(flat)
    heads = np.cumsum(sizes) - sizes
    word = np.repeat(rank, sizes)
    some = np.flatnonzero(word >= 0)
    places = (upto - np.repeat(upto[heads] - flat[heads], sizes))[some]
    order = np.argsort(places)
    return ids[by_id], places[order], word[some[order]]


def _merged(of: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which values of ``of`` stand in the ordered list ``at``, where)."""
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    where = np.searchsorted(at, of)
    hit = np.flatnonzero(at[np.minimum(where, len(at) - 1)] == of)
    return hit, where[hit]


def _extend(level: int) -> Callable[[pa.Table], pa.Table]:
    """Of one block: its lists (level 0), frequent words (1) and frequent phrases (2 to level - 1) to the keys and list lengths of ``level``."""

    def run(rows: pa.Table) -> pa.Table:
        words, places, word_at = _postings(rows)
        phrases, at, phrase_at = words, places, word_at
        for k in range(2, level + 1):
            hit, where = _merged(at + (k - 1), places)
            starts, prefix, word = at[hit], phrase_at[hit], word_at[where]
            if k > 2:  # the phrase without its first word is frequent as well
                hit, _ = _merged(starts + 1, at)
                starts, prefix, word = starts[hit], prefix[hit], word[hit]
            keys = prefix * max(len(words), 1) + word
            if k == level:
                break
            own = rows.filter(pc.equal(rows["level"], k))
            ids = _flat(own, "ids")
            by_id = np.argsort(ids)
            known = (np.searchsorted(phrases, _flat(own, "prefixes")) * max(len(words), 1) + np.searchsorted(words, _flat(own, "words")))[by_id]
            order = np.argsort(known)
            hit, where = _merged(keys, known[order])
            phrases, at, phrase_at = ids[by_id], starts[hit], order[where]
        keys, n = np.unique(keys, return_counts=True)
        block = np.full(len(keys), rows["block"][0].as_py())
        return pa.table({"block": block, "prefix": phrases[keys // max(len(words), 1)], "word": words[keys % max(len(words), 1)], "n": n})

    return run


def _numbered(batches: Iterable[pa.RecordBatch], a: str, b: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(batch, number of each row's key (a, b), rows that are the first of their key), where equal keys follow each other."""
    number, last = TaskContext.get().partitionId() << 40, None
    for batch in batches:
        if batch.num_rows:
            one, two = batch.column(a), batch.column(b)
            new = np.ones(batch.num_rows, bool)
            new[0] = last != (one[0], two[0])
            new[1:] = pc.or_(pc.not_equal(one[1:], one[:-1]), pc.not_equal(two[1:], two[:-1])).to_numpy(zero_copy_only=False)
            last = one[-1], two[-1]
            ids = number + np.cumsum(new)
            number = int(ids[-1])
            yield batch, ids, np.flatnonzero(new)


#: what goes back to a block (lists of one length; of single words their code in the block), and the frequent keys
_PACKED = "block long, ids array<long>, prefixes array<long>, words array<long>, lang string, text string, prefix long, word long, f long, id long"
_LISTS = ("ids", "prefixes", "words")
_KEYS = {"lang": pa.string(), "text": pa.string(), "prefix": pa.int64(), "word": pa.int64(), "f": pa.int64(), "id": pa.int64()}
_SCHEMA = pa.schema({"block": pa.int64()} | {c: pa.list_(pa.int64()) for c in _LISTS} | _KEYS)


def _batch(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in _SCHEMA], schema=_SCHEMA)


def _by_block(held: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
    """One row for each block of what is held."""
    block = np.concatenate([h["block"] for h in held])
    order = np.argsort(block, kind="stable")
    heads = np.flatnonzero(np.diff(block[order], prepend=-1))
    offsets = pa.array(np.concatenate([heads, [len(block)]]).astype(np.int32))
    return _batch({"block": pa.array(block[order][heads])} | {c: pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([h[c] for h in held])[order])) for c in _LISTS if c in held[0]})


def _pack(level: int, most: int = 1 << 21):
    """Gives each frequent key of a partition a number of its own (rows with an id) and gathers what goes back to each block (rows with a block)."""
    keys = {"lang": "lang", "text": "word"} if level == 1 else {"prefix": "prefix", "word": "word"}
    lists = {"words": "code"} if level == 1 else {"prefixes": "prefix", "words": "word"}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, weight = [], 0
        for batch, ids, firsts in _numbered(batches, *keys.values()):
            at = pa.array(firsts)
            yield _batch({to: batch.column(c).take(at) for to, c in keys.items()} | {"f": batch.column("f").take(at), "id": pa.array(ids[firsts])})
            held.append({"block": batch.column("block").to_numpy(), "ids": ids} | {to: batch.column(c).to_numpy() for to, c in lists.items()})
            weight += len(ids)
            if weight >= most:
                yield _by_block(held)
                held, weight = [], 0
        if held:
            yield _by_block(held)
        textkit.give_back()

    return run


def frequent_phrases(docs: DataFrame, least: int = 30, longest: int = 4, block_words: int = 1 << 21) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, words long, f) of every phrase of 1 to ``longest`` words with f >= least; (lang, n) with the words of each language)."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    index = written(texts.mapInArrow(_block_rows(block_words), "lang string, block long, code long, word string, n long, sizes array<int>, gaps array<int>"), "collocations-lists")
    words = index.where("word IS NOT NULL").select("lang", "block", "code", "word", "n")

    def survivors(keys: DataFrame, by: list[str], level: int) -> DataFrame:
        summed = keys.withColumn("f", F.sum("n").over(Window.partitionBy(*by))).where(F.col("f") >= least).drop("n")
        return written(summed.mapInArrow(_pack(level), _PACKED).withColumn("level", F.lit(level)), "collocations-frequent")

    back = ["block", "level", "ids", "prefixes", "words"]
    found = survivors(words, ["lang", "word"], 1)
    known = found.where("id IS NOT NULL").select("lang", "id", F.col("text").alias("phrase"), "f")
    lists = index.where("word IS NULL").select("block", F.lit(0).alias("level"), "sizes", "gaps")
    state = lists.unionByName(found.where("block IS NOT NULL").select(*back), allowMissingColumns=True)
    levels = [known.withColumn("words", F.lit(1).cast("long"))]
    for k in range(2, longest + 1):
        keys = state.groupBy("block").applyInArrow(_extend(k), "block long, prefix long, word long, n long")
        if k < longest:
            found = survivors(keys, ["prefix", "word"], k)
            state = state.unionByName(found.where("block IS NOT NULL").select(*back), allowMissingColumns=True)
            found = found.where("id IS NOT NULL").select("prefix", "word", "f", "id")
        else:
            found = keys.groupBy("prefix", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least).withColumn("id", F.lit(None).cast("long"))
        first = levels[-1].select("lang", F.col("id").alias("prefix"), F.col("phrase").alias("first"))
        last = known.select(F.col("id").alias("word"), F.col("phrase").alias("last"))
        named = found.join(first, "prefix").join(last, "word")
        levels.append(written(named.select("lang", "id", F.concat_ws(" ", "first", "last").alias("phrase"), "f", F.lit(k).cast("long").alias("words")), "collocations-named"))
    every = levels[0]
    for own in levels[1:]:
        every = every.unionByName(own)
    return every.drop("id"), words.groupBy("lang").agg(F.sum("n").alias("n"))


def _exact(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(19,0)")


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, top: int = 2000, inside_percent: int = 80, block_words: int = 1 << 21) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each language.

    Words are runs without spaces and tabs, A-Z in lower case, in pieces that end at .,;:!? and at line ends. A null language
    is ``und``, a null or empty text has no words. Repeated rows count as often as they occur, a text of any length in full (it is
    worked on in parts, and is a block of its own if it is longer than one). Phrases of equal score and frequency go by
    their bytes. Other columns are ignored; no rows or no frequent phrase: no rows.
    """
    every, totals = frequent_phrases(docs, least, longest, block_words)
    phrases = every.where("words > 1").withColumn("parts", F.split("phrase", " "))
    join = lambda lo, n: F.array_join(F.slice("parts", lo, n), " ")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words").cast("int") - 1)))
    cuts = cuts.select("lang", "phrase", "f", "k", join(F.lit(1), F.col("k")).alias("left"), join(F.col("k") + 1, F.col("words").cast("int") - F.col("k")).alias("right"))
    part = lambda name, f: every.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    cuts = cuts.withColumns({"a": _exact("f"), "b": _exact("l") + _exact("r")}).withColumn("score", F.expr("CAST(CAST(2000000 AS DECIMAL(7,0)) * a div b AS BIGINT)"))
    lowest = cuts.groupBy("lang", "phrase").agg(F.first("f").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # every phrase of two words or more inside a longer one, with the greatest frequency of such
    subs = F.expr("flatten(transform(sequence(2, CAST(words AS INT) - 1), m -> transform(sequence(1, CAST(words AS INT) - m + 1), s -> array_join(slice(parts, s, m), ' '))))")
    inside = phrases.where("words > 2").select("lang", "f", F.explode(F.array_distinct(subs)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    covered = _exact("longer") * F.lit(100).cast("decimal(3,0)") >= _exact("a") * F.lit(inside_percent).cast("decimal(3,0)")
    kept = lowest.join(inside, ["lang", "phrase"], "left").where(F.isnull("longer") | ~covered)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase"))
    best = kept.withColumn("rank", rank).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
