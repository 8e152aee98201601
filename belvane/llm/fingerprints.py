"""Operator 7: document fingerprints by invertible Bloom lookup sketches, with DataFrame functions only.

A text's paragraphs (its lines, long ones cut every ``PARAGRAPH`` words) are hashed, and each hash is put into one cell
of each of three rows of cells; a cell has a count, the exclusive or of its hashes, and that of their checks. Subtracted
from each other, the sketches of two versions leave what differs; peeling cells that hold a single hash recovers the
digests of the paragraphs that only one has. The small sketch, written in hexadecimal, is the fingerprint. Where two of
them differ in more than they can tell, peeling gets stuck, and for that pair alone larger sketches are made and peeled,
until all is recovered. A pair's cells stay in its row, so nothing is shuffled for it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from belvane.llm._common import bound, scan

PARAGRAPH = 12
#: Cells in a row of the fingerprint: a power of two.
SMALL = 4
#: Turns of peeling, after which a larger sketch is made; the three rows take turns.
TURNS = 96
#: Larger sketches that are made before two sets of hashes are compared one by one.
RETRIES = 2

_CELLS = "array<struct<code:bigint,n:bigint,x:bigint,c:bigint>>"
_KEYS = "array<struct<x:bigint,n:bigint>>"
_ROW = 1 << 40


def digests(text: Column) -> Column:
    """The hashes of a text's paragraphs. Equal paragraphs are told apart by how many came before, so none cancels out."""
    lines = F.split(text, "\n", -1)
    cut = F.flatten(F.transform(lines, lambda x: F.regexp_extract_all(x, F.lit(rf"(?:[^ ]*+ ?+){{1,{PARAGRAPH}}}"), F.lit(0))))
    return F.transform(F.filter(cut, lambda x: x != ""), lambda x: F.xxhash64(x))


def numbered(keys: Column) -> Column:
    """Hashes, the second of two equal ones changed, the third again, and so on."""
    kind = "struct<k:bigint,n:int>"

    def over(all_: Column) -> Column:
        start = F.struct(F.lit(None).cast("long").alias("k"), F.lit(0).alias("n"))
        told = scan(F.sort_array(all_), start, lambda last, k: F.struct(k.alias("k"), F.when(last["k"] == k, last["n"] + 1).otherwise(F.lit(0)).alias("n")), kind)
        return F.transform(told, lambda x: F.when(x["n"] > 0, F.xxhash64(x["k"], x["n"])).otherwise(x["k"]))

    return bound(keys, lambda all_: F.when(F.size(F.array_distinct(all_)) == F.size(all_), all_).otherwise(over(all_)))


def check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(7)).bitwiseAND((1 << 32) - 1)


def place(key: Column, row: int, bits: Column, tries: int) -> Column:
    """The cell of a hash in a row. The first two sketches take it from bits of the hash that no other row uses, later ones
    from a hash of their own."""
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
    return (F.shiftrightunsigned(key, 21 * row) if tries < 2 else F.xxhash64(key, F.lit(tries), F.lit(row))).bitwiseAND(mask)


def _entries(keys: Column, n: Column, bits: Column, tries: int) -> Column:
    """A cell for each hash and row."""
    cell = lambda x, c, r: F.struct((place(x, r, bits, tries) + r * _ROW).alias("code"), n.alias("n"), x.alias("x"), c.alias("c"))
    return F.flatten(F.transform(keys, lambda x: bound(check(x), lambda c: F.array(*[cell(x, c, r) for r in range(3)])))).cast(_CELLS)


def _merge(a: Column, b: Column) -> Column:
    return F.struct(a["code"].alias("code"), (a["n"] + b["n"]).alias("n"), a["x"].bitwiseXOR(b["x"]).alias("x"), a["c"].bitwiseXOR(b["c"]).alias("c"))


def _gather(cells: Column) -> Column:
    """Cells of one code added up, in order; empty ones go. Sorted, those of a code lie side by side, and each run is
    summed by itself."""

    def over(s: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["code"] != F.get(s, i - 1)["code"]))

        def runs(h: Column) -> Column:
            def run(i: Column, j: Column) -> Column:
                n = F.coalesce(F.get(h, j + 1), F.size(s)) - i
                return F.when(n == 1, F.get(s, i)).otherwise(F.aggregate(F.slice(s, i + 2, n - 1), F.get(s, i), _merge))

            return F.transform(h, run)

        return bound(heads, runs)

    made = bound(F.sort_array(cells), lambda s: F.when(F.size(s) > 0, over(s)).otherwise(s))
    return F.filter(made, lambda c: (c["n"] != 0) | (c["x"] != 0)).cast(_CELLS)


def sketch(keys: Column) -> Column:
    """The small sketch of some hashes: its cells that aren't empty, in order."""
    return _gather(_entries(keys, F.lit(1).cast("long"), F.lit(SMALL), 0))


def said(cells: Column) -> Column:
    """A small sketch in hexadecimal: each cell's count (4 digits, beyond them modulo 65536), hashes (16) and checks (8)."""
    text = lambda c: F.concat(F.lpad(F.hex(c["n"].bitwiseAND(65535)), 4, "0"), F.lpad(F.hex(c["x"]), 16, "0"), F.lpad(F.hex(c["c"]), 8, "0"))
    codes = F.lit([r * _ROW + k for r in range(3) for k in range(1 << SMALL)]).cast("array<bigint>")
    told = F.map_from_arrays(F.transform(cells, lambda c: c["code"]), F.transform(cells, text))
    return F.lower(bound(told, lambda m: F.array_join(F.transform(codes, lambda k: F.coalesce(F.element_at(m, k), F.lit("0" * 28))), "")))


def subtract(a: Column, b: Column) -> Column:
    return _gather(F.concat(a, F.transform(b, lambda c: F.struct(c["code"].alias("code"), (-c["n"]).alias("n"), c["x"].alias("x"), c["c"].alias("c"))).cast(_CELLS)))


def peel(cells: Column, bits: Column, tries: int) -> Column:
    """found (x, n: 1 if the first version has it, -1 if the second) and left, the cells that no turn could empty.

    A turn takes the hashes that are alone in a cell of one row out of all three. A hash has one cell in a row, so none is
    taken twice. Three turns without any, and nothing more comes."""
    zero = F.struct(cells.alias("left"), F.array().cast(_KEYS).alias("found"), F.lit(0).alias("idle"))

    def turn(acc: Column, t: Column) -> Column:
        alone = F.filter(acc["left"], lambda c: (F.abs(c["n"]) == 1) & (F.shiftright(c["code"], 40) == t % 3) & (c["c"] == check(c["x"])))

        def taken(p: Column) -> Column:
            out = F.flatten(F.transform(p, lambda c: F.array(*[F.struct((place(c["x"], r, bits, tries) + r * _ROW).alias("code"), (-c["n"]).alias("n"), c["x"].alias("x"), c["c"].alias("c")) for r in range(3)])))
            more = F.transform(p, lambda c: F.struct(c["x"].alias("x"), c["n"].alias("n"))).cast(_KEYS)
            return F.when(F.size(p) == 0, F.struct(acc["left"].alias("left"), acc["found"].alias("found"), (acc["idle"] + 1).alias("idle"))).otherwise(
                F.struct(_gather(F.concat(acc["left"], out.cast(_CELLS))).alias("left"), F.concat(acc["found"], more).alias("found"), F.lit(0).alias("idle")))

        return F.when((F.size(acc["left"]) == 0) | (acc["idle"] > 2), acc).otherwise(bound(alone, taken))

    return F.aggregate(F.sequence(F.lit(0), F.lit(TURNS - 1)), zero, turn, lambda acc: F.struct(acc["found"].alias("found"), acc["left"].alias("left")))


def differing(rows: DataFrame, pairs: dict[str, tuple[str, str, str, str]]) -> DataFrame:
    """``rows`` with a column for each of ``pairs`` (two columns of hashes, and those of their small sketches): found (the
    hashes x that only one has, with n 1 or -1) and tries (how many sketches it took).

    Where peeling the small sketches gets stuck, larger ones are made of the same hashes, the first with four cells of each
    row for each hash, the next with four times as many and other places; as empty cells aren't stored, more of them cost
    nothing and save turns. Should none do, the two are compared hash by hash."""
    plus, minus = F.lit(1).cast("long"), F.lit(-1).cast("long")
    only = lambda x, y, n: F.transform(F.array_except(x, y), lambda k: F.struct(k.alias("x"), n.alias("n")))
    for name, (a, b, cells_a, cells_b) in pairs.items():
        rows = rows.withColumn(f"__{name}0", peel(subtract(F.col(cells_a), F.col(cells_b)), F.lit(SMALL), 0))
        rows = rows.withColumn(f"__{name}_bits", F.greatest(F.ceil(F.log2((F.size(a) + F.size(b)).cast("double"))).cast("int") + 2, F.lit(SMALL + 2)))
        for tries in range(1, RETRIES + 1):
            bits = F.col(f"__{name}_bits") + 2 * (tries - 1)
            stuck = F.size(F.col(f"__{name}{tries - 1}.left")) > 0
            # a step for the cells and one for peeling, so that each is made once
            rows = rows.withColumn(f"__{name}_cells", F.when(stuck, _gather(F.concat(_entries(F.col(a), plus, bits, tries), _entries(F.col(b), minus, bits, tries)))))
            rows = rows.withColumn(f"__{name}{tries}", F.when(F.col(f"__{name}_cells").isNotNull(), peel(F.col(f"__{name}_cells"), bits, tries)))
        done = [F.when(F.size(F.col(f"__{name}{t}.left")) == 0, F.struct(F.col(f"__{name}{t}.found").alias("found"), F.lit(t + 1).alias("tries"))) for t in range(RETRIES + 1)]
        exact = F.struct(F.concat(only(F.col(a), F.col(b), plus), only(F.col(b), F.col(a), minus)).cast(_KEYS).alias("found"), F.lit(RETRIES + 2).alias("tries"))
        rows = rows.withColumn(name, F.coalesce(*done, exact)).drop(f"__{name}_bits", f"__{name}_cells", *[f"__{name}{t}" for t in range(RETRIES + 1)])
    return rows


def likeness(a: Column, b: Column, differing: Column) -> Column:
    """Shared paragraphs of all, from the numbers of both and of those that differ; 1 for two texts without any."""
    total, d = (a + b).cast("double"), F.coalesce(differing, F.lit(0)).cast("double")
    return F.when(total == 0, 1.0).otherwise(F.greatest(total - d, F.lit(0.0)) / (total + d))


def _range_of(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` are below ``key``: first among every 32nd, then among the 32 that follow."""
    if not bounds:
        return F.lit(0)
    below = lambda b: b < key
    coarse = F.size(F.filter(F.lit(bounds[31::32]).cast("array<bigint>"), below)) * 32 if len(bounds) > 31 else F.lit(0)
    return coarse + F.size(F.filter(F.slice(F.lit(bounds).cast("array<bigint>"), coarse + 1, F.lit(32)), below))


def with_next(docs: DataFrame, columns: list[str], ranges: int, derived: list[tuple[str, Callable[[], Column]]]) -> DataFrame:
    """doc_id, ``columns`` and what is ``derived`` from them (in turn) of every row, and as ``next_`` those of the next in
    falling order of doc_id (after the last: the first). Ties in doc_id are ordered by text; a null id comes last.

    Ids are dealt to ``ranges``, whose first rows also go, as guests, to the range before; then each range finds its rows'
    next alone. Only the ranges' bounds and first ids come to the driver. Rows of one id are in one range.
    """
    least = -(1 << 63)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(least))
    bounds = docs.agg(F.percentile_approx(key, [k / ranges for k in range(1, ranges)] or [0.5], 10_000)).first()[0] or []
    bounds = sorted(set(bounds))
    part = _range_of(key, bounds)
    heads = dict(docs.select(part.alias("p"), key.alias("k")).groupBy("p").agg(F.max("k")).collect())
    used = sorted(heads)
    above = {p: used[(k + 1) % len(used)] for k, p in enumerate(used)}
    of = lambda told, p: F.get(F.lit([told.get(x, least) for x in range(len(bounds) + 1)]).cast("array<bigint>"), p)
    rows = docs.select("doc_id", *columns, key.alias("__key"), part.cast("int").alias("__own"))
    guest = F.struct(of(above, F.col("__own")).cast("int").alias("part"), F.lit(True).alias("__guest"))
    host = F.struct(F.col("__own").alias("part"), F.lit(False).alias("__guest"))
    first = F.col("__key") == of(heads, F.col("__own"))
    dealt = rows.select("doc_id", *columns, F.inline(F.when(first, F.array(host, guest)).otherwise(F.array(host))))
    by = Window.partitionBy("part").orderBy("__guest", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    dealt = dealt.where(F.col("part").isNotNull()).repartition(ranges, "part")
    # texts alone are shuffled; what is derived from them is made where they arrive
    for name, made in derived:
        dealt = dealt.withColumn(name, made())
    all_ = [*columns, *[name for name, _ in derived]]
    return dealt.select("doc_id", *all_, *[F.lead(c).over(by).alias(f"next_{c}") for c in all_], "__guest").where("not __guest").drop("__guest")


def compare(docs: DataFrame, *, ranges: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next for every row, and
    differ_edited, differ_next (how many paragraphs were recovered that only one of the two has) and tries_edited,
    tries_next (how many sketches that took: 1 where the printed ones do).

    The edited text has its last third replaced by as much of the beginning of the next document, in falling order of
    doc_id. A null text is taken as empty; a text of any length is read whole. Texts without a paragraph are alike (1.0).
    Repeated rows each come back and are each other's next; other columns are not read. An empty table gives no rows.
    ``ranges``: into how many ranges of ids the work is cut, 8 for each shuffle partition if not given.
    """
    ranges = ranges or 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    own = [("raw", lambda: digests(F.col("text"))), ("own", lambda: numbered(F.col("raw"))), ("cells", lambda: sketch(F.col("own")))]
    rows = with_next(texts, ["text"], ranges, own).withColumnRenamed("next_own", "next")
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substr(F.col("text"), F.lit(1), n - third), F.substr(F.col("next_text"), F.lit(1), third))
    # one step after the other, so that each is made once
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("__text"), "own", "next", "cells", "next_cells")
    rows = rows.withColumn("__raw", digests(F.col("__text"))).withColumn("edited", numbered(F.col("__raw"))).withColumn("edited_cells", sketch(F.col("edited")))
    rows = differing(rows, {f"to_{name}": ("own", name, "cells", f"{name}_cells") for name in ("edited", "next")})
    d = {name: F.size(f"to_{name}.found") for name in ("edited", "next")}
    return rows.select(
        "doc_id", "n_chars", F.sha2("__text", 256).alias("edited_sha256"), said(F.col("cells")).alias("fingerprint"), said(F.col("edited_cells")).alias("edited_fingerprint"),
        *[likeness(F.size("own"), F.size(name), d[name]).alias(f"near_{name}") for name in d],
        *[d[name].cast("long").alias(f"differ_{name}") for name in d],
        *[F.col(f"to_{name}.tries").cast("long").alias(f"tries_{name}") for name in d],
    )


def recovered(versions: DataFrame) -> DataFrame:
    """id, only_old, only_new (the digests of the paragraphs that only one of two versions has, as peeling recovers them)
    and tries, for rows (id, old, new). A paragraph that a version has twice counts twice: the second digest is another.

    Null texts are empty; equal texts leave nothing; repeated rows each come back; an empty table gives no rows.
    """
    rows = versions.select("id", *[numbered(digests(F.coalesce(F.col(c), F.lit("")))).alias(c) for c in ("old", "new")])
    rows = rows.withColumns({"__a": sketch(F.col("old")), "__b": sketch(F.col("new"))})
    rows = differing(rows, {"__d": ("old", "new", "__a", "__b")})
    only = lambda n: F.transform(F.filter("__d.found", lambda k: k["n"] == n), lambda k: k["x"])
    return rows.select("id", only(1).alias("only_old"), only(-1).alias("only_new"), F.col("__d.tries").alias("tries"))
