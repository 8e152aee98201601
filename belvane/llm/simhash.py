"""Operator 3: near-duplicates by SimHash, linked with BK-trees.

Fingerprints of 64 bits link at a Hamming distance of at most ``radius``. They are cut into ``radius + 2`` blocks of bits:
two that link agree in two of the blocks at least, so each pair of blocks, with its bits, names a shard in which to
look. In each shard the fingerprints make a BK-tree, whose children are keyed by their distance to the parent; a search
follows only the edges within the radius. A shard too large for one tree is cut into several, and each of these meets
each of the others. Links become components on the cluster.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from belvane.llm._common import in_small_batches, materialise, with_row_id
from belvane.llm.components import components

_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Fingerprints in one tree.
TREE = 1024


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The SimHash of a text: a bit is 1 if it is set in over half the hashes of its shingles; 0 for a text without words."""
    words = _WORDS.findall((text or "").encode("utf-8", "replace").translate(_LOWER))
    if not words:
        return 0
    line = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) <= shingle:
        hashes = digest(line, 42)
        n = 1
    else:
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
        n = len(words) - shingle + 1
        hashes = b"".join([digest(line[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)])
    rows = np.frombuffer(hashes, dtype=np.uint8).reshape(n, 8)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 8192):
        ones += np.unpackbits(rows[at : at + 8192], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [_signed(fingerprint(x.as_py(), shingle)) for x in b.column("text")]
        yield pa.RecordBatch.from_arrays([*[c for c, f in zip(b.columns, b.schema, strict=True) if f.name != "text"], pa.array(found, pa.int64())], [*[f.name for f in b.schema if f.name != "text"], "fp"])


def fingerprints(docs: DataFrame, keys: list[str], *, shingle: int = 3) -> DataFrame:
    """``keys`` of every row and ``fp``, its text's fingerprint as a signed long."""
    kept = in_small_batches(docs).select(*keys, "text")
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "text"], "fp long"])
    return kept.mapInArrow(partial(_fingerprints, shingle=shingle), schema)


class Tree:
    """A BK-tree: each node's children are keyed by their distance to it."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, x: int) -> None:
        if not self.values:
            self.values.append(x)
            self.children.append({})
            return
        at = 0
        while True:
            d = (self.values[at] ^ x).bit_count()
            if d == 0:
                return
            below = self.children[at].get(d)
            if below is None:
                self.children[at][d] = len(self.values)
                self.values.append(x)
                self.children.append({})
                return
            at = below

    def near(self, x: int, radius: int) -> list[int]:
        """The values within the radius of ``x``."""
        found, todo = [], [0] if self.values else []
        values, children = self.values, self.children
        while todo:
            at = todo.pop()
            d = (values[at] ^ x).bit_count()
            if d <= radius:
                found.append(values[at])
            below = children[at]
            if below:
                if len(below) <= 2 * radius + 1:
                    todo += [c for k, c in below.items() if -radius <= k - d <= radius]
                else:
                    todo += [below[k] for k in range(d - radius, d + radius + 1) if k in below]
        return found


def tree_links(tree: list[int], search: list[int] | None, radius: int) -> list[tuple[int, int]]:
    """Links between the values of a tree and those searched for (or its own, if None): enough of them to connect all
    that the full list would connect, so one fewer than the values at most."""
    t, root = Tree(), {}

    def top(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    if search is not None:
        for x in tree:
            t.add(x)
    for x in tree if search is None else search:
        for y in t.near(x, radius):
            a, b = top(x), top(y)
            if a != b:
                root[a] = b
                out.append((x, y))
        if search is None:
            t.add(x)
    return out


def _search(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by shard, tree, search; side 0 is the tree's, side 1 is searched for."""
    mask = (1 << 64) - 1
    shard, sides = None, ([], [])

    def flush() -> list[tuple[int, int]]:
        a, b, own = sides[0], sides[1], shard[2] == shard[3]
        return tree_links(a, None if own else b, radius) if len(a) > 1 or (not own and a and b) else []

    for r in batches:
        out = []
        keys = np.stack([r.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("pair", "bits", "tree", "other")])
        fp, side = r.column("fp").to_numpy(), r.column("side").to_numpy()
        cut = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), r.num_rows], strict=True):
            key = tuple(keys[:, a].tolist())
            if key != shard:
                if shard is not None:
                    out += flush()
                shard, sides = key, ([], [])
            for x, s in zip(fp[a:b].tolist(), side[a:b].tolist(), strict=True):
                sides[s].append(x & mask)
        yield _links(out)
    if shard is not None:
        yield _links(flush())


def _links(out: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([_signed(x[0]) for x in out], pa.int64()), pa.array([_signed(x[1]) for x in out], pa.int64())], ["a", "b"])


def links(distinct: DataFrame, *, radius: int = 3, tree_size: int = TREE) -> DataFrame:
    """a, b: links between the fingerprints of ``distinct`` (fp: no value twice), enough to connect all that link.

    A fingerprint goes to one shard for each pair of blocks, whatever the data. The shards that hold more than
    ``tree_size`` are found by counting, and cut into trees by a hash; each row of these goes to as many searches as its
    shard has trees, which is the number of pairs of trees, not of rows.
    """
    n = radius + 2
    ends = [64 * k // n for k in range(n + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(ends, ends[1:], strict=False)]
    shards = F.array(*[F.struct(F.lit(k).alias("pair"), F.col("fp").bitwiseAND(F.lit(_signed(masks[i] | masks[j]))).alias("bits")) for k, (i, j) in enumerate(combinations(range(n), 2))])
    rows = distinct.select("fp", F.explode(shards).alias("s")).select("fp", "s.pair", "s.bits")
    # a shard of one has no links; the count is a sum of partial counts
    sizes = materialise(rows.groupBy("pair", "bits").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    trees = F.ceil(F.col("size") / tree_size)
    shared = rows.join(sizes, ["pair", "bits"]).withColumns({"trees": trees, "own": F.pmod(F.xxhash64("fp", F.lit(5)), trees)})
    small = shared.where("trees = 1").select("pair", "bits", "fp", F.lit(0).alias("tree"), F.lit(0).alias("other"), F.lit(0).alias("side"))
    # the row belongs to tree "own"; it is searched for in the trees before it, and holds a place for those behind it
    large = shared.where("trees > 1").select("pair", "bits", "fp", "own", F.explode(F.sequence(F.lit(0), (F.col("trees") - 1).cast("int"))).alias("k"))
    large = large.select("pair", "bits", "fp", F.least("own", "k").cast("int").alias("tree"), F.greatest("own", "k").cast("int").alias("other"), F.when(F.col("own") <= F.col("k"), 0).otherwise(1).alias("side"))
    dealt = small.unionByName(large).repartition("pair", "bits", "tree", "other").sortWithinPartitions("pair", "bits", "tree", "other", "side", "fp")
    return dealt.mapInArrow(partial(_search, radius=radius), "a long, b long")


def groups(marked: DataFrame, *, radius: int = 3, tree_size: int = TREE) -> DataFrame:
    """fp, component: for each distinct fingerprint of ``marked`` (fp), the smallest one that links lead to."""
    distinct = materialise(marked.select("fp").distinct())
    found = components(links(distinct, radius=radius, tree_size=tree_size))
    return distinct.join(found, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame, *, radius: int = 3, shingle: int = 3, tree_size: int = TREE) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id (the smallest doc_id of the group) for every row.

    Null, empty and blank texts have fingerprint zero and link like any other. A null doc_id takes part but is never the
    smallest, unless its group has no other. A bit set in exactly half the hashes is 0. A text of any length is read whole;
    its hashes are one array of a task. Repeated rows each come back; other columns are not read. An empty table gives no
    rows.
    """
    marked = materialise(fingerprints(docs, ["doc_id"], shingle=shingle))
    found = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("least")).join(groups(marked, radius=radius, tree_size=tree_size), "fp"))
    ids = found.groupBy("component").agg(F.min("least").alias("component_id"))
    named = found.join(ids, "component").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, *, radius: int = 3, shingle: int = 3, tree_size: int = TREE) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the row with the smallest doc_id stays (among equal
    ids the one that is read first), with all its columns, whatever their names. A null doc_id comes after all others; null,
    empty and blank texts make one group; an empty table gives no rows."""
    named = with_row_id(docs)
    read = named.select(F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"), "file", "at")
    marked = materialise(fingerprints(read, ["doc_id", "file", "at"], shingle=shingle))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("file"), F.col("at")))
    least = marked.groupBy("fp").agg(first.alias("first"))
    kept = least.join(groups(marked, radius=radius, tree_size=tree_size), "fp").groupBy("component").agg(F.min("first").alias("first"))
    kept = kept.select(F.col("first.file").alias("file"), F.col("first.at").alias("at"))
    return named.join(kept, ["file", "at"], "left_semi").select("row.*")
