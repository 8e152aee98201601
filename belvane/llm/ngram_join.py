"""Operator 12: an exact join of texts by the Jaccard index of their sets of n-word shingles.

The shingles of a text are put in one order for all texts, the rare first. Two sets that overlap enough share one of the
first shingles of each, its prefix; only there are they joined, and only where their sizes (length filter), the places of
the shared shingle (positional filter) and the numbers of shingles in each range of hashes (suffix filter, with fixed cuts)
leave the index within reach. Each pair that passes is verified once, by its whole sets.

Rarity is read from a table of fixed size that counts the shingles of all texts by a range of their hash: any order that is
the same for all texts gives all links, a good one gives few candidates.

Equal sets are one node. The texts of a shingle are not paired each with each: their rows are ranked by shingle and size,
and round by round compared with the rows 1, then up to 8, 32, 128, ... places away, for as long as a shingle has texts in
more than one component; the rows of a shingle's largest component only meet the others'. So a group of near copies costs
about as much as its members, and a pair is left out only if links already connect it or a filter excludes it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from belvane.llm._common import in_small_batches, materialise, with_row_id
from belvane.llm.components import components

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bytes that are part of a word are 1.
_INSIDE = bytes(0 if b == 32 or 9 <= b <= 13 else 1 for b in range(256))
#: Of eight bytes, the first so many.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(30), np.uint64(27), np.uint64(31))
#: Ranges of hashes whose shingles are counted for the order, and those that the suffix filter compares.
BINS, CUTS = 1 << 20, 64
#: Texts whose shingles a task holds at a time.
ROWS = 512
#: Bytes of text whose words are hashed at once, but for a text that has more by itself.
BYTES = 1 << 19
#: Bytes of a word that are hashed eight at a time, for all words at once.
LONG = 64
#: Counts of the order travel in rows of so many.
_PART = 1 << 12


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> _MIX[2]) * _MIX[0]
    x = (x ^ x >> _MIX[3]) * _MIX[1]
    return x ^ x >> _MIX[4]


def _word_hashes(text: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each word ``text[start:end]``, a function of its bytes: eight of them at a time, all words at once."""
    size = ends - starts
    eights = np.ndarray(len(text) - 7, dtype="<u8", buffer=text, strides=(1,))
    out = _mixed(size.astype(np.uint64) * _STEP ^ eights[starts] & _FIRST[np.minimum(size, 8)])
    rest = np.flatnonzero(size > 8)
    for at in range(8, LONG, 8):
        if not len(rest):
            break
        part = eights[starts[rest] + at] & _FIRST[np.minimum(size[rest] - at, 8)]
        out[rest] = _mixed(out[rest] * _STEP + part)
        rest = rest[size[rest] > at + 8]
    for k in rest.tolist():
        out[k] = xxhash.xxh64_intdigest(text[starts[k] : ends[k]], 42)
    return out


def _rolled(h: np.ndarray, size: int) -> np.ndarray:
    """The hashes of ``size`` words from each place, of their hashes ``h``."""
    n = len(h) - size + 1
    out = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        out = out * _STEP + h[k : k + n]
    return _mixed(out)


def shingles(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """For each text the hashes of its shingles of ``size`` words, repeats included, A to Z taken as small letters; a shorter
    text is one shingle, one without words has none. Texts are hashed together, ``BYTES`` at a time."""
    texts = column.cast(pa.binary()).fill_null(b"")
    _, places, data = texts.buffers()
    if not len(texts):
        return
    places = np.frombuffer(places, dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(places, int(places[at]) + BYTES, "right")) - 1)
        bounds = (places[at : end + 1] - places[at]).astype(np.int64)
        text = (data[int(places[at]) : int(places[end])].to_pybytes() if data is not None else b"").translate(_LOWER)
        # a word begins or ends at a text's bounds, too
        inside = np.frombuffer(text.translate(_INSIDE), dtype=bool)
        edge = np.zeros(len(text) + 1, dtype=bool)
        edge[bounds] = True
        starts = inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]]))
        ends = inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))
        starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        h = _word_hashes(text + bytes(8), starts, ends)
        whole = _rolled(h, size) if len(h) >= size else h[:0]
        words = np.searchsorted(starts, bounds).tolist()
        for a, b in zip(words, words[1:], strict=False):
            yield whole[a : b - size + 1] if b - a >= size else _rolled(h[a:b], b - a) if b > a else h[:0]
        at = end


def _distinct(found: np.ndarray) -> np.ndarray:
    found = np.sort(found)
    return found[np.concatenate([[True], found[1:] != found[:-1]])] if len(found) else found


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows, ``ROWS`` at a time: a batch of Spark's has ten thousand texts, whose shingles take some 100 MB of each task."""
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


def _count(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """How many shingles of a task's texts lie in each bin, ``_PART`` bins a row."""
    counts = np.zeros(BINS, dtype=np.int64)
    for b in _few(batches):
        found = list(shingles(b.column("text"), size))
        if found:
            counts += np.bincount((np.concatenate(found) >> np.uint64(44)).astype(np.int64), minlength=BINS)
    if counts.any():
        small = counts.astype(np.uint32)  # a task reads far fewer than 2 ** 32 words
        yield pa.RecordBatch.from_arrays([pa.array(range(BINS // _PART), pa.int32()), pa.array([x.tobytes() for x in small.reshape(-1, _PART)], pa.binary())], ["part", "counts"])


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for part, counts in zip(b.column("part").to_pylist(), b.column("counts").to_pylist(), strict=True):
            sums[part] = sums.get(part, 0) + np.frombuffer(counts, dtype=np.uint32).astype(np.uint64)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["part", "counts"])


def rarity(docs: DataFrame, size: int) -> np.ndarray:
    """The number of shingles in each of ``BINS`` ranges of hashes, over all texts: 8 MB, whatever the input."""
    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(partial(_count, size=size), "part int, counts binary")
    summed = counted.repartition("part").mapInArrow(_sum, "part int, counts binary")
    table = np.zeros((BINS // _PART, _PART), dtype=np.uint64)
    for r in summed.collect():  # BINS numbers in all
        table[r["part"]] = np.frombuffer(r["counts"], dtype=np.uint64)
    return table.reshape(-1)

def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(rows) if rows else [], kind))


def _head(found: np.ndarray, rare: np.ndarray, size: int) -> np.ndarray:
    """The first ``size`` of ``found`` in the order: by rarity, then by hash."""
    if 0 < size < len(found) // 2:
        near = np.flatnonzero(rare <= np.partition(rare, size - 1)[size - 1])
        found, rare = found[near], rare[near]
    return found[np.lexsort((found, rare))][:size]


def _names(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """``same`` names a text's set of shingles, ``n`` counts it."""
    for b in _few(batches):
        found = [_distinct(x) for x in shingles(b.column("text"), size)]
        kept = [(f.name, c) for c, f in zip(b.columns, b.schema, strict=True) if f.name != "text"]
        same = np.array([xxhash.xxh64_intdigest(x.tobytes(), 7) for x in found], dtype=np.uint64).view(np.int64)
        made = [("same", pa.array(same)), ("n", pa.array([len(x) for x in found], pa.int64()))]
        yield pa.RecordBatch.from_arrays([c for _, c in kept + made], [k for k, _ in kept + made])


def _prefixes(batches: Iterator[pa.RecordBatch], size: int, percent: int, order) -> Iterator[pa.RecordBatch]:
    """``prefix`` holds the first shingles of a text's set in the order, ``cuts`` how many lie in each range that the suffix
    filter compares."""
    table = order.value
    for b in _few(batches):
        prefix, cuts = [], []
        for x in shingles(b.column("text"), size):
            found = _distinct(x)
            rare = table[(found >> np.uint64(44)).astype(np.int64)]
            prefix.append(_head(found, rare, len(found) - -(-percent * len(found) // 100) + 1 if len(found) else 0).view(np.int64))
            cuts.append(np.bincount((found >> np.uint64(58)).astype(np.int64), minlength=CUTS))
        yield pa.RecordBatch.from_arrays([b.column("file"), b.column("at"), _lists(prefix, pa.int64()), _lists(cuts, pa.int32())], ["file", "at", "prefix", "cuts"])


def _verify(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    for b in _few(batches):
        good = []
        for x, y in zip(shingles(b.column("x"), size), shingles(b.column("y"), size), strict=True):
            p, q = _distinct(x), _distinct(y)
            both = len(np.intersect1d(p, q, assume_unique=True))
            good.append(100 * both >= percent * (len(p) + len(q) - both))
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(good, pa.bool_())], ["a", "b", "good"])


def _in_reach(percent: int) -> Column:
    """The length and positional filters, on the rows (n, place) and (n2, place2) of one shingle. A pair may fail at a
    shingle and pass at the first one that it shares, where the positional filter's bound holds."""
    return F.expr(f"100 * least(n, n2) >= {percent} * greatest(n, n2) and (1 + least(n - 1 - place, n2 - 1 - place2)) * {100 + percent} >= {percent} * (n + n2)")


def _partnered(rows: DataFrame, percent: int) -> DataFrame:
    """The ``rows`` (token, x, n, place, c) that the length and positional filters leave a partner within their shingle.

    At its place a row reaches sets of ``most`` shingles at most, and two rows may link if each reaches the other's size. So one
    of them reaches its own size, the other one may be of any place; rows far down in their prefixes, as most of a group's
    that differ too much are, have no partner. Told by the least and greatest sizes and reaches of a shingle."""
    rows = rows.withColumn("most", F.expr(f"(100 * n - {100 + percent} * place) div {percent}"))
    own = F.col("most") >= F.col("n")
    spans = rows.groupBy("token").agg(
        F.min(F.when(own, F.col("n"))).alias("least"),
        F.max(F.when(own, F.col("most"))).alias("reach"),
        F.min(F.when(own, F.col("c"))).alias("lo"),
        F.max(F.when(own, F.col("c"))).alias("hi"),
        F.min(F.when(~own, F.col("n"))).alias("other_least"),
        F.max(F.when(~own, F.col("most"))).alias("other_reach"),
    )
    spans = spans.where("lo < hi or other_reach >= least and other_least <= reach").select("token", "least", "reach")
    return rows.join(spans, "token").where("most >= n or most >= least and n <= reach").select("token", "x", "n", "place", "c")


def _shared(distinct: DataFrame, found: DataFrame | None, part: int | None = None, *, percent: int = 80) -> DataFrame:
    """rank, token, x, n, place, c: the rows of the shingles that prefixes of two components or more hold and that may have a
    partner, ranked by shingle and x without gaps; ``part`` takes one shingle in so many. The order is cut into ranges; a row
    for each range, not more, tells how many come before."""
    sets = distinct.select(F.col("same").alias("x"), "n", "prefix")
    sets = sets.withColumn("c", F.col("x")) if found is None else sets.join(found, "x", "left").withColumn("c", F.coalesce("c", "x"))
    tokens = sets.select("x", "n", "c", F.posexplode("prefix").alias("place", "token"))
    if part:
        tokens = tokens.where(F.pmod(F.xxhash64("token"), F.lit(part)) == 0)
    twice = tokens.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("token")
    rows = materialise(tokens.join(twice, "token").select("token", "x", "n", "place", "c"))
    rows = materialise(_partnered(rows, percent))
    ranged = rows.repartitionByRange("token", "x").sortWithinPartitions("token", "x").withColumn("id", F.monotonically_increasing_id())
    ranged = materialise(ranged.withColumns({"part": F.shiftright("id", 33), "id": F.col("id").bitwiseAND((1 << 33) - 1)}))
    before = F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("rows")).select("part", before.alias("before"))
    return ranged.join(F.broadcast(starts), "part").select((F.col("before") + F.col("id")).alias("rank"), "token", "x", "n", "place", "c")


def _open(rows: DataFrame) -> DataFrame:
    """token, main, first, last: the shingles whose rows lie in more than one component, the one with most rows, and the
    range of their ranks. Summed by component first, so that no task holds a shingle's rows."""
    by = rows.groupBy("token", "c").agg(F.count(F.lit(1)).alias("m"), F.min("rank").alias("lo"), F.max("rank").alias("hi"))
    whole = by.groupBy("token").agg(F.count(F.lit(1)).alias("kinds"), F.max(F.struct("m", "c")).alias("main"), F.min("lo").alias("first"), F.max("hi").alias("last"))
    return whole.where("kinds > 1").select("token", F.col("main.c").alias("main"), "first", "last")


def _pairs(rows: DataFrame, near: int, far: int, percent: int) -> DataFrame:
    """a, b: pairs of ``rows`` (with main, first, last) of one shingle, ``near`` to ``far`` - 1 ranks apart, in two
    components, that the filters leave. The rows of a shingle's main component wait for the others to come to them; of
    neighbours, each row asks the next."""
    asked = rows.select(F.col("rank").alias("to"), F.col("x").alias("x2"), F.col("n").alias("n2"), F.col("place").alias("place2"), F.col("c").alias("c2"))
    if far == near + 1:
        asking = rows.where(F.col("rank") + near <= F.col("last")).select("x", "n", "place", "c", (F.col("rank") + near).alias("to"))
    else:
        after = F.sequence(F.col("rank") + near, F.least(F.col("last"), F.col("rank") + far - 1))
        before = F.sequence(F.greatest(F.col("first"), F.col("rank") - far + 1), F.col("rank") - near)
        none = F.array().cast("array<long>")
        to = F.concat(F.when(F.col("rank") + near <= F.col("last"), after).otherwise(none), F.when(F.col("rank") - near >= F.col("first"), before).otherwise(none))
        asking = rows.where("c <> main").select("x", "n", "place", "c", F.explode(to).alias("to"))
    met = asking.join(asked, "to").where(_in_reach(percent) & (F.col("c") != F.col("c2")))
    return met.select(F.least("x", "x2").alias("a"), F.greatest("x", "x2").alias("b")).distinct()


class _Walk:
    """The search: what links so far (``found``: x, c), which pairs don't (``failed``), and the ``texts`` that it has read."""

    def __init__(self, small: DataFrame, read: DataFrame, size: int, percent: int):
        self.small, self.read, self.size, self.percent = small, read, size, percent
        self.found = self.failed = self.texts = None

    def over(self, rows: DataFrame, longest: int | None = None) -> None:
        """Meets the rows (rank, token, x, n, place, c) of each shingle, 1 rank apart, up to 8, 32, ... apart, or up to
        ``longest``, while they lie in more than one component."""
        near, far = 1, 2
        while longest is None or near < longest:
            # a shingle whose rows have all met is through
            still = materialise(_open(rows).where(F.col("last") - F.col("first") >= near))
            if still.isEmpty():
                return
            rows = materialise(rows.select("rank", "token", "x", "n", "place", "c").join(still, "token"))
            moved = self._verify(_pairs(rows, near, far, self.percent))
            if moved is not None:
                # a component's new name, for the rows of its members
                rows = rows.join(moved.select(F.col("node").alias("c"), "component"), "c", "left").withColumn("c", F.coalesce("component", "c"))
            near, far = far, max(8, 4 * far)

    def _verify(self, pairs: DataFrame) -> DataFrame | None:
        """Verifies ``pairs`` (a, b) that were not before; the components that got another name, or None."""
        percent = self.percent
        if self.failed is not None:
            pairs = pairs.join(self.failed, ["a", "b"], "left_anti")
        for end in ("a", "b"):
            pairs = pairs.join(self.small.select(F.col("same").alias(end), F.col("n").alias(f"n{end}"), F.col("cuts").alias(f"cuts{end}")), end)
        apart = F.aggregate(F.zip_with("cutsa", "cutsb", lambda p, q: F.abs(p - q)), F.lit(0), lambda s, d: s + d)
        pairs = pairs.withColumn("reach", (100 + percent) * (F.col("na") + F.col("nb") - apart) >= 2 * percent * (F.col("na") + F.col("nb")))
        pairs = materialise(pairs.select("a", "b", "reach"))
        if pairs.isEmpty():
            return None
        self.texts = _with_texts(self.texts, pairs.where("reach"), self.small, self.read)
        both = pairs.where("reach").join(self.texts.select(F.col("same").alias("a"), F.col("text").alias("x")), "a").join(self.texts.select(F.col("same").alias("b"), F.col("text").alias("y")), "b")
        checked = materialise(both.select("a", "b", "x", "y").mapInArrow(partial(_verify, size=self.size, percent=percent), "a long, b long, good boolean"))
        out = pairs.where("not reach").select("a", "b").unionByName(checked.where("not good").select("a", "b"))
        self.failed = out if self.failed is None else self.failed.unionByName(out)
        self.found, moved = _joined(self.found, checked.where("good").select("a", "b"))
        return moved


def links(distinct: DataFrame, read: DataFrame, *, size: int = 5, percent: int = 80) -> DataFrame:
    """x, c: the component c of each set x of ``distinct`` (same, n, prefix, cuts, and the file and at of one of its rows)
    that has a link; ``read`` (file, at, text) has the texts. Only what a pair needs is compared, see the top of this file.

    Near copies share many shingles of their prefixes. So an eighth of the shingles goes first, and only with near
    neighbours: most groups are one component then, and their other shingles need not be ranked or met at all."""
    walk = _Walk(distinct.select("same", "n", "cuts", "file", "at"), read, size, percent)
    walk.over(_shared(distinct, None, part=8, percent=percent), longest=8)
    walk.over(_shared(distinct, walk.found, percent=percent))
    return walk.found if walk.found is not None else distinct.select(F.col("same").alias("x"), F.col("same").alias("c")).where("false")


def _with_texts(texts: DataFrame | None, pairs: DataFrame, small: DataFrame, read: DataFrame) -> DataFrame:
    """``texts`` (same, text) with those of the ends of ``pairs`` that it lacks. Near copies alone are written again, not all
    texts; each text once."""
    ends = pairs.select(F.col("a").alias("same")).unionByName(pairs.select(F.col("b").alias("same"))).distinct()
    if texts is not None:
        ends = ends.join(texts.select("same"), "same", "left_anti")
    # Spark broadcasts the places if their measured size is small
    places = materialise(small.select("same", "file", "at").join(ends, "same"))
    if texts is not None and places.isEmpty():
        return texts
    new = materialise(read.select("file", "at", "text").join(places, ["file", "at"]).select("same", "text"))
    return new if texts is None else texts.unionByName(new)


def _joined(found: DataFrame | None, new: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """The components ``found`` (x, c) with the links ``new`` (a, b), and the components that got another name."""
    if found is not None:
        for end in ("a", "b"):
            new = new.join(found.select(F.col("x").alias(end), F.col("c").alias(f"c{end}")), end, "left").withColumn(end, F.coalesce(f"c{end}", end)).drop(f"c{end}")
    new = materialise(new.distinct())
    if new.isEmpty():
        return found, None
    moved = materialise(components(new))
    singles = moved.select(F.col("node").alias("x"), F.col("component").alias("c"))
    if found is None:
        return singles, moved
    kept = found.join(moved.select(F.col("node").alias("c"), "component"), "c", "left").select("x", F.coalesce("component", "c").alias("c"))
    return materialise(kept.unionByName(singles.join(found, "x", "left_anti"))), moved


def classes(docs: DataFrame, *, size: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows of ``docs`` (row, file, at as in ``with_row_id``), what is known of each (file, at, doc_id, same, n), and the
    distinct sets (same, n, first, c): the first row by doc_id (null last), file and place, and the component, null where
    nothing links."""
    named = with_row_id(in_small_batches(docs))
    read = named.select("file", "at", F.col("row.doc_id").alias("doc_id"), F.col("row.text").cast("string").alias("text"))
    order = docs.sparkSession.sparkContext.broadcast(rarity(read, size))  # BINS numbers
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in read.select("file", "at", "doc_id").schema)
    marked = materialise(read.mapInArrow(partial(_names, size=size), f"{kinds}, same long, n long"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("file"), F.col("at")))
    sets = materialise(marked.groupBy("same").agg(first.alias("first"), F.first("n").alias("n")))
    places = sets.where("n > 0").select("same", "n", F.col("first.file").alias("file"), F.col("first.at").alias("at"))
    prefixes = read.select("file", "at", "text").mapInArrow(partial(_prefixes, size=size, percent=percent, order=order), "file long, at long, prefix array<long>, cuts array<int>")
    found = links(materialise(prefixes.join(places, ["file", "at"])), read, size=size, percent=percent)
    named_sets = sets.join(found.select(F.col("x").alias("same"), "c"), "same", "left").select("same", "n", "first", "c")
    return named, marked, materialise(named_sets)


def join(docs: DataFrame, *, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles (distinct shingles of ``size`` words, A to Z taken as small letters) and component_id (the smallest
    doc_id that links lead to, itself included) for every row. Two texts link where their sets have a Jaccard index of
    ``percent`` hundredths or more.

    A text of fewer words is one shingle. A null text, or one without words, links with nothing, not with its like either. A
    null doc_id takes part but is never the smallest, unless its component has no other. Rows of one doc_id are texts of
    their own. A text of any length is read whole, in one task. Sets are compared by 64-bit hashes of their shingles. Other
    columns are not read. An empty table gives no rows.
    """
    _, rows, sets = classes(docs, size=size, percent=percent)
    ids = sets.select("same", F.coalesce("c", "same").alias("c"), F.col("first.doc_id").alias("least"))
    least = ids.groupBy("c").agg(F.min("least").alias("least"))
    named = materialise(ids.select("same", "c").join(least, "c").select("same", "least"))
    # Spark splits the rows of a set that many texts have
    return rows.join(named, "same").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, *, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component of the links, the row with the smallest doc_id stays
    (among equal ids the one that is read first), with all its columns, whatever their names. A null doc_id comes after all
    others. Null, empty and blank texts make one group; a text of any length is read whole; an empty table gives no rows."""
    named, _, sets = classes(docs, size=size, percent=percent)
    first = sets.groupBy(F.coalesce("c", "same").alias("c")).agg(F.min("first").alias("first"))
    kept = first.select(F.col("first.file").alias("file"), F.col("first.at").alias("at"))
    return named.join(kept, ["file", "at"], "left_semi").select("row.*")
