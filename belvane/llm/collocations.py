"""Operator 11: phrases of two to four words that occur far more together than apart.

The counts of all phrases that occur ``least`` times or more are kept as two streams, one sorted by the words from the left
(prefix order), one by the words from the right (suffix order). In prefix order a phrase follows its beginnings, in suffix
order its ends, so merge joins of sorted streams bring together a phrase's count, those of its left and right parts, and
the greatest count among the phrases that are longer by a word on either side. No hash table is built for a join.

A phrase that is frequent has frequent parts only. So before phrases are counted as text, they are counted by a hash of 48
bits: first words and pairs of words, then phrases of three and four whose pairs all were frequent. Hashes that are counted
``least`` times are set in two tables of 2 ** 27 bits, by their first bits, and only what is set is counted as text. Hashes
decide nothing else: what the tables let through in excess is counted by its words and dropped then. Where a table is full
it drops less, and the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from belvane.llm._common import materialise

#: A to Z become small letters, a tab a space, and what ends a piece the byte 0xFF, which no UTF-8 text has.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 9 else 255 if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))
_STEP, _MIX, _FAR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(32)
#: Hashes are cut to HASH bits: the first RANGES name a range, which one task counts, the rest lies in it; the first TABLE
#: are the place in the table.
RANGES, HASH, TABLE = 16, 48, 27
#: Words that a task counts before it passes its counts on, which bounds its memory.
FLUSH = 1 << 21
MOST = 4


class _Words(dict):
    """Numbers of the words of one language in the order in which they come; words of two languages have two numbers."""

    def __init__(self, lang: str, words: list[bytes], hashes: list[int]):
        super().__init__()
        self.words, self.hashes, self.seed = words, hashes, xxhash.xxh64_intdigest(lang.encode("utf-8"))

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.words)
        self.words.append(word)
        self.hashes.append(xxhash.xxh64_intdigest(word, self.seed))
        return n


class _Stretch:
    """Texts read one behind the other: the numbers of their words, the ends of pieces among them."""

    def __init__(self):
        self.words, self.hashes, self.of_lang, self.ids, self.size = [b"\xff"], [0], {}, [], 0

    def add(self, lang: str, text: bytes) -> None:
        if lang not in self.of_lang:
            self.of_lang[lang] = _Words(lang, self.words, self.hashes)
            self.of_lang[lang][b"\xff"] = 0
        words = text.translate(_TABLE).replace(b"\xff", b" \xff ").split(b" ")
        words.append(b"\xff")
        numbers = self.of_lang[lang]
        numbers[b""] = -1  # between two spaces
        ids = np.fromiter(map(numbers.__getitem__, words), dtype=np.int64, count=len(words))
        ids = ids[ids >= 0]
        self.ids.append(ids)
        self.size += len(ids)

    def read(self) -> tuple[np.ndarray, np.ndarray]:
        """The numbers, and the hashes of the words. The last is an end."""
        ids = np.concatenate(self.ids)
        return ids, np.array(self.hashes, dtype=np.uint64)[ids]


def _hash(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The hashes, of ``HASH`` bits, of the k words from each of the places ``at``."""
    out = np.full(len(at), k, dtype=np.uint64)
    for j in range(k):
        x = h[at + j]
        out = out * _STEP + (x ^ x >> _FAR) * _MIX
    return (out ^ out >> _FAR) * _STEP >> np.uint64(64 - HASH)


def _is_set(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = (hashes >> np.uint64(HASH - TABLE)).astype(np.int64)
    return table[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1 > 0


def _places(ids: np.ndarray, h: np.ndarray, table: np.ndarray | None) -> dict[int, np.ndarray]:
    """Where phrases of one to four words begin; with a table of words and pairs, those of which it has all."""
    one = np.flatnonzero(ids > 0)
    two = one[ids[one + 1] > 0]
    if table is None:
        return {1: one, 2: two}
    one, two = one[_is_set(table, _hash(h, one, 1))], two[_is_set(table, _hash(h, two, 2))]
    pair = np.zeros(len(ids) + 2, dtype=bool)
    pair[two] = True
    three = two[pair[two + 1]]
    return {1: one, 2: two, 3: three, 4: three[pair[three + 2]]}


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[_Stretch]:
    """Whole texts, ``FLUSH`` words or more at a time, and then the rest."""
    s = _Stretch()
    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").cast(pa.binary()), strict=True):
            s.add(lang, text.as_py())
            if s.size >= FLUSH:
                yield s
                s = _Stretch()
    if s.size:
        yield s


def _hash_counts(batches: Iterator[pa.RecordBatch], bits) -> Iterator[pa.RecordBatch]:
    """The hashes of words and pairs, or with their table those of longer phrases, sorted, with their counts (255 at most): a
    row for each range of hashes."""
    for s in _stretches(batches):
        ids, h = s.read()
        at = _places(ids, h, bits.value if bits else None)
        found, times = np.unique(np.concatenate([_hash(h, at[k], k) for k in ((3, 4) if bits else (1, 2))]), return_counts=True)
        if not len(found):
            continue
        times = np.minimum(times, 255).astype(np.uint8)
        rest = (found & np.uint64((1 << HASH - RANGES) - 1)).astype(np.uint32)
        ranges, start = np.unique((found >> np.uint64(HASH - RANGES)).astype(np.int32), return_index=True)
        ends = np.append(start, len(found)).astype(np.int32)
        packed = lambda x: pa.Array.from_buffers(pa.binary(), len(ranges), [None, pa.py_buffer((ends * x.itemsize).tobytes()), pa.py_buffer(x.tobytes())])
        yield pa.RecordBatch.from_arrays([pa.array(ranges), packed(rest), packed(times)], ["part", "hashes", "times"])


def _set_bits(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by range; of each range, the bits of the table whose hashes are counted ``least`` times."""
    width = 1 << TABLE - RANGES
    part, hashes, times = None, [], []

    def flush() -> list[tuple[int, bytes]]:
        if part is None:
            return []
        h = np.frombuffer(b"".join(hashes), dtype=np.uint32)
        n = np.frombuffer(b"".join(times), dtype=np.uint8)
        found, which = np.unique(h, return_inverse=True)
        bits = np.zeros(width, dtype=np.uint8)
        bits[found[np.bincount(which, weights=n) >= min(least, 255)] >> np.uint32(HASH - TABLE)] = 1
        return [(part, np.packbits(bits).tobytes())] if bits.any() else []

    def batch(out: list[tuple[int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], ["part", "bits"])

    for b in batches:
        out = []
        for k, h, n in zip(b.column("part").to_pylist(), b.column("hashes").to_pylist(), b.column("times").to_pylist(), strict=True):
            if k != part:
                out += flush()
                part, hashes, times = k, [], []
            hashes.append(h)
            times.append(n)
        yield batch(out)
    yield batch(flush())


def frequent(texts: DataFrame, least: int, bits=None) -> np.ndarray:
    """The table of words and pairs, or with it (``bits``) that of longer phrases: 2 ** 27 bits, 16 MB whatever the input. A
    task sums the counts of a range of hashes."""
    counted = texts.mapInArrow(partial(_hash_counts, bits=bits), "part int, hashes binary, times binary")
    found = counted.repartition("part").sortWithinPartitions("part").mapInArrow(partial(_set_bits, least=least), "part int, bits binary")
    table = np.zeros((1 << RANGES, 1 << TABLE - RANGES - 3), dtype=np.uint8)
    for b in found.toArrow().to_batches():  # one row a range at most, 2 ** 27 bits in all
        for k, row in zip(b.column("part").to_pylist(), b.column("bits").to_pylist(), strict=True):
            table[k] = np.frombuffer(row, dtype=np.uint8)
    return table.reshape(-1)


def _phrase_counts(batches: Iterator[pa.RecordBatch], bits, more) -> Iterator[pa.RecordBatch]:
    """lang, k, phrase, f: of a stretch, the counts of what the tables let through, phrases of k words; k = 0 counts all
    words of a language."""
    for s in _stretches(batches):
        ids, h = s.read()
        words = ["", *[x.decode("utf-8") for x in s.words[1:]]]
        langs = list(s.of_lang)
        lang_of = np.zeros(len(words), dtype=np.int64)
        for k, lang in enumerate(langs):
            lang_of[[n for n in s.of_lang[lang].values() if n > 0]] = k
        out = [(langs[k], 0, "", n) for k, n in enumerate(np.bincount(lang_of[ids[ids > 0]], minlength=len(langs)).tolist())]
        at = _places(ids, h, bits.value)
        name = np.zeros(len(ids), dtype=np.int64)  # the number of the phrase that begins here, 0 where none does
        for k in range(1, MOST + 1):
            p = at[k] if k < 3 else at[k][_is_set(more.value, _hash(h, at[k], k))]
            p = p[(name[p] > 0) & (name[p + 1] > 0)] if k > 1 else p  # both parts were let through too
            _, first, number, times = np.unique(name[p] * len(words) + ids[p + k - 1], return_index=True, return_inverse=True, return_counts=True)
            name[:] = 0
            name[p] = number + 1
            for place, n in zip(p[first].tolist(), times.tolist(), strict=True):
                own = ids[place : place + k].tolist()
                out.append((langs[lang_of[own[0]]], k, " ".join([words[x] for x in own]), n))
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], t) for j, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.int64()))], ["lang", "k", "phrase", "f"])


def counts(docs: DataFrame, *, least: int = 30) -> DataFrame:
    """lang, k, phrase, f: every phrase of one to four words within a piece that occurs ``least`` times or more, and the
    number of all words of each language (k = 0, phrase empty)."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    spark = docs.sparkSession.sparkContext
    bits = spark.broadcast(frequent(texts, least))  # 16 MB
    more = spark.broadcast(frequent(texts, least, bits))  # 16 MB
    found = texts.mapInArrow(partial(_phrase_counts, bits=bits, more=more), "lang string, k int, phrase string, f long")
    return materialise(found.groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= F.when(F.col("k") > 0, least).otherwise(1)))


def _cut(k: int, words: Column) -> Column:
    """left and right: the parts of a phrase of ``words`` that is cut after its first k."""
    return F.struct(F.lit(k).alias("cut"), F.array_join(F.slice(words, 1, k), " ").alias("left"), F.array_join(F.slice(words, k + 1, MOST), " ").alias("right"))


def collocations(docs: DataFrame, *, least: int = 30, longer: int = 80, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: of each language the first ``top`` phrases by score, count and bytes.

    Texts are lower-cased (A to Z) and split into pieces at ``.,;:!?`` and line ends, pieces into words at spaces and tabs. a
    is how often the phrase occurs, l and r how often its two parts do, for the cut with the lowest score, floor(2000000 a /
    (l + r)), and of those the first; n is the number of words of the language. A phrase goes if it lies in one longer by a
    word that occurs ``least`` times or more, and ``longer`` hundredths as often as it or more; phrases longer by more words
    occur no more often.

    A null text is empty, a null lang is ``und``, as that value itself is. A text of any length is read whole, in one
    task. Repeated rows each count. Ties of score and count are ordered by the phrase's bytes, so ranks are unique. Other
    columns are not read. Without phrases, or in an empty table, there are no rows.
    """
    all_ = counts(docs, least=least)
    parts = all_.where("k > 0").select("lang", "phrase", "f")
    phrases = all_.where("k > 1").select("lang", "k", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    # prefix order: the left parts of every cut; suffix order: the right ones
    cuts = phrases.select("lang", "phrase", "a", F.inline(F.filter(F.array(*[_cut(k, F.col("w")) for k in range(1, MOST)]), lambda c: c["right"] != "")))
    prefixes = parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")).hint("merge")
    suffixes = parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")).hint("merge")
    both = cuts.join(prefixes, ["lang", "left"]).join(suffixes, ["lang", "right"])
    # whole numbers that may pass 64 bits
    score = F.expr("cast((cast(2000000 as decimal(7, 0)) * cast(a as decimal(19, 0))) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0))) as bigint)")
    lowest = both.select("lang", "phrase", "a", F.struct(score.alias("score"), "cut", "l", "r").alias("c")).groupBy("lang", "phrase", "a").agg(F.min("c").alias("c"))
    # a phrase's extensions: in prefix order those by a word on the right, in suffix order those on the left
    more = phrases.where("k > 2")
    ends = more.select("lang", F.array_join(F.slice("w", 1, F.col("k") - 1), " ").alias("phrase"), "a").unionByName(more.select("lang", F.array_join(F.slice("w", 2, MOST), " ").alias("phrase"), "a"))
    extended = ends.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = lowest.join(extended.hint("merge"), ["lang", "phrase"], "left").where(F.expr(f"most is null or cast(100 as decimal(3, 0)) * cast(most as decimal(19, 0)) < cast({longer} as decimal(3, 0)) * cast(a as decimal(19, 0))"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    # Spark keeps ``top`` rows of a language in each task before they meet
    ranked = kept.select("lang", "phrase", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), F.col("c.score").alias("score")).withColumn("rank", rank).where(F.col("rank") <= top)
    n = all_.where("k = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
