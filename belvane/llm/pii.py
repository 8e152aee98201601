"""Operator 2: personal data by weak supervision, with DataFrame functions only.

Patterns propose spans. Labellers vote on each: the strict pattern with its checks, a gazetteer, the words before the
span, its borders and its shape. Expectation-maximisation over the counts of vote patterns estimates how reliable each
labeller is; the posteriors are the labels on which a final span classifier is trained, a naive Bayes scorer over
features of the span. Spans that the strict patterns find always stay; the classifier adds others: spelled-out addresses,
local telephone numbers, identity numbers, card-like numbers and secrets such as tokens and keys.
"""

from __future__ import annotations

import json
import math
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from belvane.llm._common import bound, materialise, scan

KINDS = ("email", "ip", "card", "phone", "id", "secret")
# The base patterns. Each starts where a leftmost match can start only, and takes no step back, so that long runs of
# letters or digits cost no more than their length; their matches are those of the plain patterns.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Patterns that only propose.
SPELLED = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]{1,63}+(?: ?[\[(](?:dot|DOT)[\])] ?[A-Za-z0-9-]{1,63}+)++"
LOCAL = r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
ID = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
SECRET = r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}+={0,2}+"
#: Words that stand before personal data, and top-level names that addresses end in: fixed values.
BEFORE = {
    "email": "mail|contact|write to|reach",
    "ip": "ip|host|server|address|login",
    "card": "card|visa|credit|debit|payment|account",
    "phone": "phone|call|tel|mobile|fax|cell|dial",
    "id": "ssn|social security|identity|passport|tax",
    "secret": "token|secret|passwo?r?d|api.?key|access.?key|private.?key|credential|bearer|auth",
}
TOP_NAMES = "com|org|net|edu|gov|io|info|biz|de|fr|es|uk|eu|it|nl|us|ca"
LABELLERS = ("strict", "gazetteer", "before", "borders", "shape")

_SPANS = "array<struct<k:int,s:int,e:int,base:boolean,votes:string,feats:array<string>>>"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    at = F.sequence(F.lit(1), F.length(digits))
    back = F.reverse(digits)

    def part(k: Column) -> Column:
        d = F.substr(back, k, F.lit(1)).cast("int")
        return F.when(k % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(at, F.lit(0), lambda a, k: a + part(k)) % 10 == 0


def _strict(kind: int, hit: Column, digits: Column) -> Column:
    byte = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
    n = F.length(digits)
    return [
        F.lit(True),
        hit.rlike(rf"^(?:{byte}\.){{3}}{byte}$"),
        F.when(n.between(16, 19), luhn(digits)).otherwise(False),
        n.between(8, 15),
    ][kind]


def _vote(good: Column, bad: Column) -> Column:
    return F.when(good, F.lit("1")).when(bad, F.lit("0")).otherwise(F.lit("-"))


def _span(kind: int, base: bool, hit: Column, left: Column, right: Column, end: Column) -> Column:
    """A proposed span with its votes and features, or null; ``left`` and ``right`` are the texts around the hit."""
    name = KINDS[kind]
    tail = F.lower(F.right(left, F.lit(32)))
    parts = F.struct(
        hit.alias("hit"), F.regexp_replace(hit, "[^0-9]", "").alias("digits"), F.length(hit).alias("size"),
        F.length(F.regexp_replace(hit, "[^A-Za-z]", "")).alias("letters"), tail.rlike(rf"\b(?:{BEFORE[name]})").alias("before"),
        F.concat(F.right(left, F.lit(1)), F.left(right, F.lit(1))).rlike(r"[\p{L}\p{N}]").alias("flanked"), end.alias("end"),
    )

    def judged(c: Column) -> Column:
        hit, digits, size, letters, flanked = c["hit"], c["digits"], c["size"], c["letters"], c["flanked"]
        n = F.length(digits)
        gazetteer = [
            F.lower(hit).rlike(rf"(?:\.|dot[\])] ?)(?:{TOP_NAMES})$"),
            hit.rlike(r"^(?!(?:0|127|255)\.).*(?<!\.0)$"),
            hit.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)"),
            digits.rlike("^(?:1|3[0-9]|4[0-9]|5[0-9])"),
            ~hit.rlike("^(?:000|666|9)"),
            hit.rlike("^(?:(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9A-F]{32,64})$|sk-|gh[ps]_|AKIA|xox|eyJ)"),
        ][kind]
        shape = [
            (size.between(6, 80), size > 254),
            (size.between(7, 15), size > 15),
            (n == 16, n > 19),
            (n.between(10, 13), n.between(0, 7) | (n > 15)),
            (n == 9, n != 9),
            ((n >= 6) & (letters >= 6) & size.between(24, 128), (size > 200) | (n * 12 < size)),
        ][kind]
        strict = _strict(kind, hit, digits) if base else F.lit(False)

        def told(t: Column) -> Column:
            # kinds that no strict pattern tells have no strict vote
            first = _vote(t["strict"], ~t["strict"]) if base else F.lit("-")
            votes = F.concat(first, _vote(t["gazetteer"], ~t["gazetteer"]), _vote(c["before"], F.lit(False)), _vote(~flanked, flanked), _vote(*shape))
            feats = F.array(
                F.lit(f"kind={name}"),
                F.concat(F.lit(f"{name} digits="), F.least(F.floor(n / 8) if kind == 5 else n, F.lit(20)).cast("string")),
                F.concat(F.lit(f"{name} length="), F.least(F.floor(size / 4), F.lit(20)).cast("string")),
                F.concat(F.lit(f"{name} marks="), F.least(size - n - letters, F.lit(8)).cast("string")),
                F.concat(F.lit(f"{name} strict="), t["strict"].cast("string")),
                F.concat(F.lit(f"{name} flanked="), flanked.cast("string")),
                F.concat(F.lit(f"{name} before="), c["before"].cast("string")),
            )
            return F.struct(F.lit(kind).alias("k"), (c["end"] - size).alias("s"), c["end"].alias("e"), t["strict"].alias("base"), votes.alias("votes"), feats.alias("feats"))

        made = lambda: bound(F.struct(strict.alias("strict"), gazetteer.alias("gazetteer")), told)
        if kind == 2:
            return bound(F.struct(strict.alias("strict"), gazetteer.alias("gazetteer")), lambda t: F.when(t["strict"] | n.between(13, 19), told(t)))
        return F.when((n >= 3) & (letters >= 3), made()) if kind == 5 else made()

    return bound(parts, judged)


def _spans(text: Column, kind: int, pattern: str, here: Column, base: bool) -> Column:
    """The spans of a pattern. A text is split by it once; running sums of the lengths of parts and hits tell the places."""
    cut = F.struct(F.split(text, pattern, -1).alias("parts"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))

    def placed(c: Column) -> Column:
        sizes = F.transform(c["hits"], lambda h, k: F.length(F.get(c["parts"], k)) + F.length(h))
        ends = scan(sizes, F.lit(0), lambda at, n: at + n, "int")

        def of(e: Column) -> Column:
            made = F.transform(c["hits"], lambda h, k: _span(kind, base, h, F.get(c["parts"], k), F.get(c["parts"], k + 1), F.get(e, k)))
            return F.filter(made, lambda x: x.isNotNull()).cast(_SPANS)

        return bound(ends, of)

    return F.when(here, bound(cut, placed)).otherwise(F.array().cast(_SPANS))


def proposals(docs: DataFrame, keys: list, name: str = "cands") -> DataFrame:
    """``keys`` of every row and ``name``, the spans that the patterns propose."""
    text = F.coalesce(F.col("text"), F.lit(""))
    digit = text.rlike("[0-9]")
    found = [
        _spans(text, 0, EMAIL, text.contains("@"), True),
        _spans(text, 1, IP, digit & text.contains("."), True),
        _spans(text, 2, CARD, digit, True),
        _spans(text, 3, PHONE, digit & text.contains("+"), True),
        _spans(text, 0, SPELLED, text.rlike("(?i)[\\[(]at[\\])]"), False),
        _spans(text, 3, LOCAL, digit, False),
        _spans(text, 4, ID, digit & text.contains("-"), False),
        _spans(text, 5, SECRET, digit & text.rlike(SECRET), False),
    ]
    return docs.select(*keys, F.concat(*found).alias(name))


_NUMBER = {"1": 1.0, "0": 0.0, "-": np.nan}


def reliabilities(counts: dict[tuple[int, str], int], rounds: int = 60) -> dict[tuple[int, str], float]:
    """The chance, for each kind and vote pattern, that the span is personal data. Each kind has a share of its own, a
    labeller's reliability is one for all kinds."""
    keys = list(counts)
    kind, n = np.array([k for k, _ in keys]), np.array([counts[k] for k in keys], dtype=float)
    v = np.array([[_NUMBER[c] for c in p] for _, p in keys])
    yes, no, cast = np.nan_to_num(v), np.nan_to_num(1 - v), ~np.isnan(v)
    share, hit, miss = np.full(len(KINDS), 0.5), np.full(len(LABELLERS), 0.85), np.full(len(LABELLERS), 0.75)
    p = np.zeros(len(keys))
    for _ in range(rounds):
        up = np.log(share[kind]) + yes @ np.log(hit) + no @ np.log(1 - hit)
        down = np.log(1 - share[kind]) + yes @ np.log(1 - miss) + no @ np.log(miss)
        p = 1 / (1 + np.exp(np.clip(down - up, -60, 60)))
        share = np.array([((n * p)[kind == k].sum() + 1) / (n[kind == k].sum() + 2) for k in range(len(KINDS))])
        hit = ((n * p) @ yes + 17) / ((n * p) @ cast + 20)
        miss = ((n * (1 - p)) @ no + 15) / ((n * (1 - p)) @ cast + 20)
    return {k: float(x) for k, x in zip(keys, p, strict=True)}


def _lookup(known: dict[str, float], key: Column) -> Column:
    return F.coalesce(F.element_at(F.from_json(F.lit(json.dumps(known)), "map<string,double>"), key), F.lit(0.0))


def train(found: DataFrame) -> dict[str, float]:
    """Weights of the span classifier; the empty name has the bias. Only counts come to the driver: at most
    3 ** len(LABELLERS) vote patterns of each kind, and one row for each feature of a span."""
    spans = found.select(F.explode("cands").alias("c"))
    counts = {(r["k"], r["votes"]): r["n"] for r in spans.groupBy("c.k", "c.votes").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}
    chance = {f"{k} {v}": p for (k, v), p in reliabilities(counts).items()}
    p = _lookup(chance, F.concat_ws(" ", F.col("c.k").cast("string"), F.col("c.votes")))
    sums = spans.select(p.alias("p"), F.explode("c.feats").alias("feat")).groupBy("feat").agg(F.sum("p").alias("p"), F.count(F.lit(1)).alias("n")).collect()
    good = sum(counts[k] * chance[f"{k[0]} {k[1]}"] for k in counts)
    bad = sum(counts.values()) - good
    weights = {r["feat"]: math.log((r["p"] + 1) / (good + 2)) - math.log((r["n"] - r["p"] + 1) / (bad + 2)) for r in sums}
    return weights | {"": math.log((good + 1) / (bad + 1))}


_PLACE = "struct<s:int,e:int,k:int,base:boolean>"


def _apart(spans: Column) -> Column:
    """``spans`` (in order of s and e) less those that aren't base and touch one that is: one pass each way over the
    furthest end of a base span so far, and the nearest start of one to come."""
    far = scan(spans, F.lit(-1), lambda at, x: F.greatest(at, F.when(x["base"], x["e"]).otherwise(at)), "int")
    near = scan(F.reverse(spans), F.lit((1 << 31) - 1), lambda at, x: F.least(at, F.when(x["base"], x["s"]).otherwise(at)), "int")
    told = F.struct(far.alias("far"), F.reverse(near).alias("near"))
    return bound(told, lambda t: F.filter(spans, lambda x, i: x["base"] | ((F.get(t["far"], i) <= x["s"]) & (F.get(t["near"], i) >= x["e"]))))


def accept(cands: Column, weights: dict[str, float], least: float) -> Column:
    """The spans that stay, in order: those of the strict patterns, and those that the classifier takes and that touch none
    of them."""
    table = F.from_json(F.lit(json.dumps(weights)), "map<string,double>")
    limit = math.log(least / (1 - least)) - weights.get("", 0.0)
    taken = F.filter(cands, lambda c: c["base"] | (F.aggregate(c["feats"], F.lit(0.0), lambda a, f: a + F.coalesce(F.element_at(table, f), F.lit(0.0))) > limit))
    placed = F.sort_array(F.transform(taken, lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), c["k"].alias("k"), c["base"].alias("base"))))
    once = bound(placed, lambda p: F.filter(p, lambda x, i: (i == 0) | (x != F.get(p, i - 1))))
    mixed = lambda p: F.exists(p, lambda x: ~x["base"]) & F.exists(p, lambda x: x["base"])
    return bound(once, lambda p: F.when(mixed(p), _apart(p)).otherwise(p))


def _in_order(spans: Column) -> Column:
    """k, s, e by kind, then place."""
    return F.sort_array(F.transform(spans, lambda c: F.struct(c["k"].alias("k"), c["s"].alias("s"), c["e"].alias("e"))))


def _said(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", F.get(name, c["k"]), c["s"].cast("string"), c["e"].cast("string"))), ",")


def _count(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda c: c["k"] == kind))


def find(docs: DataFrame, *, least: float = 0.9) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone and base_sha256 (of the strict patterns' spans), n_secret, n_added and
    n_found (all spans), and spans (all of them as kind:start:end by kind and start, in code points, end exclusive).

    A null text is taken as empty and has no spans. A text of any length is read whole, in time that grows with its length
    and its spans. Spans of different kinds may overlap, but an added one touches no strict one; equal ones count once.
    Repeated rows each count and come back; other columns are not read; an empty table gives no rows. ``least``: the chance
    from which the classifier adds a span.
    """
    found = materialise(proposals(docs, ["doc_id"]))
    weights = train(found)
    known = found.select("doc_id", _in_order(F.filter("cands", lambda c: c["base"])).alias("strict"), _in_order(accept(F.col("cands"), weights, least)).alias("all"))
    return known.select(
        "doc_id",
        *[_count(F.col("strict"), k).cast("long").alias(f"n_{KINDS[k]}") for k in range(4)],
        F.sha2(_said(F.col("strict")), 256).alias("base_sha256"),
        _count(F.col("all"), 5).cast("long").alias("n_secret"),
        (F.size("all") - F.size("strict")).cast("long").alias("n_added"),
        F.size("all").cast("long").alias("n_found"),
        _said(F.col("all")).alias("spans"),
    )


#: Code points in a block of a text that is put together anew.
BLOCK = 4096


def _replaced(text: Column, spans: Column) -> Column:
    """``text`` with each of ``spans`` (s, e, name; in order, none overlapping) replaced by its name. The text is cut into
    blocks first, so that what lies between two spans is found without a walk from its beginning."""
    blocks = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0))

    def part(b: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / BLOCK).cast("int")
        few = F.array_join(F.slice(b, first + 1, F.floor(end / BLOCK).cast("int") - first + 1), "")
        return F.substr(few, start - first * BLOCK + 1, end - start)

    def joined(c: Column) -> Column:
        gaps = F.transform(c["spans"], lambda x, i: F.concat(part(c["blocks"], F.when(i == 0, F.lit(0)).otherwise(F.get(c["spans"], i - 1)["e"]), x["s"]), x["name"]))
        return F.concat(F.array_join(gaps, ""), part(c["blocks"], F.element_at(c["spans"], -1)["e"], F.length(text)))

    return bound(F.struct(blocks.alias("blocks"), spans.alias("spans")), joined)


def merged(spans: Column) -> Column:
    """s, e, name of ``spans`` (s, e, k; in order), those that overlap taken together, under the name of the first."""
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    ends = scan(spans, F.lit(-1), lambda at, x: F.greatest(at, x["e"]), "int")

    def heads(t: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(t["spans"]) - 1), lambda i: (i == 0) | (F.get(t["spans"], i)["s"] >= F.get(t["ends"], i - 1)))
        return bound(first, lambda h: F.transform(h, lambda i, j: F.struct(
            F.get(t["spans"], i)["s"].alias("s"), F.get(t["ends"], F.coalesce(F.get(h, j + 1), F.size(t["spans"])) - 1).alias("e"), F.get(names, F.get(t["spans"], i)["k"]).alias("name"))))

    return bound(F.struct(spans.alias("spans"), ends.alias("ends")), heads)


def redact(docs: DataFrame, *, least: float = 0.9) -> DataFrame:
    """``docs`` with each span of its texts replaced by the span's kind in angle brackets, such as <email>, and n_chars,
    where it is a column, set to the new length. Spans that overlap are replaced together, by the kind of the first.

    A null text stays null, an empty one empty; a text of any length is read whole. Columns whatever their names stay as
    they are. Repeated rows come back alike; an empty table gives no rows.
    """
    weights = train(materialise(proposals(docs, [])))
    # all columns are one, so that no name clashes
    read = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    found = proposals(read, ["row", "text"]).withColumn("spans", accept(F.col("cands"), weights, least))
    text = F.when(F.col("text").isNull() | (F.size("spans") == 0), F.col("text")).otherwise(_replaced(F.col("text"), merged(F.col("spans"))))
    found = found.select("row", text.alias("text"))
    new = {"text": F.col("text")} | ({"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return found.select(*[(new[c] if c in new else F.col("row").getField(c)).alias(c) for c in docs.columns])


#: The base patterns as they are stated, for tests.
STATED = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
