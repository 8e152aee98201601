"""Hash-chained logs: building, checking, lifecycles and reports."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GENESIS = "0" * 64


def sequence(events: DataFrame, key: str, order: list[str], payload: list[str]) -> DataFrame:
    """``events`` with seq (0, 1, ... by ``order``) and line, the joined ``payload``, without hashes."""
    rows = events.select(key, *order, F.concat_ws("|", *[F.col(c).cast("string") for c in payload]).alias("line"))
    seq = F.row_number().over(Window.partitionBy(key).orderBy(*order, "line")) - 1
    return rows.select(key, seq.cast("long").alias("seq"), *order, "line")


def _chained(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key and place; only the last hash goes from a batch to the next."""
    began, now, seq, last = False, None, 0, GENESIS
    for b in batches:
        seqs, hashes = [], [last]
        previous = []
        for k, line in zip(b.column(key).to_pylist(), b.column("line").cast(pa.binary()).to_pylist(), strict=True):
            if not began or k != now:
                began, now, seq, last = True, k, 0, GENESIS
            seqs.append(seq)
            previous.append(last)
            last = hashlib.sha256(last.encode() + b"|" + line).hexdigest()
            hashes.append(last)
            seq += 1
        rest = [n for n in b.schema.names if n != key]
        columns = [b.column(key), pa.array(seqs, pa.int64()), *[b.column(n) for n in rest], pa.array(previous, pa.string()), pa.array(hashes[1:], pa.string())]
        yield pa.RecordBatch.from_arrays(columns, [key, "seq", *rest, "previous_hash", "event_hash"])


def chain(events: DataFrame, key: str, order: list[str], payload: list[str]) -> DataFrame:
    """``events`` with seq (0, 1, ...), previous_hash and event_hash. A key's events go through one task, since each hash
    needs the one before, batch by batch and sorted on disk where need be; checking (:func:`validate`) needs no chain."""
    rows = events.select(key, *order, F.concat_ws("|", *[F.col(c).cast("string") for c in payload]).alias("line"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([f"`{key}` {kinds[key]}", "seq long", *[f"`{c}` {kinds[c]}" for c in order], "line string, previous_hash string, event_hash string"])
    dealt = rows.repartition(key).sortWithinPartitions(key, *order, "line")
    return dealt.mapInArrow(partial(_chained, key=key), schema)


def validate(log: DataFrame, key: str) -> DataFrame:
    """``key``, events, gaps, broken_links, bad_hashes and valid. Each row is checked against the one before alone."""
    w = Window.partitionBy(key).orderBy("seq")
    checked = log.select(
        key,
        (F.col("seq") != F.coalesce(F.lag("seq").over(w) + 1, F.lit(0))).alias("gap"),
        (F.col("previous_hash") != F.coalesce(F.lag("event_hash").over(w), F.lit(GENESIS))).alias("broken"),
        (F.col("event_hash") != F.sha2(F.concat_ws("|", "previous_hash", "line"), 256)).alias("bad"),
    )
    found = checked.groupBy(key).agg(F.count(F.lit(1)).alias("events"), *[F.sum(F.col(c).cast("long")).alias(n) for c, n in (("gap", "gaps"), ("broken", "broken_links"), ("bad", "bad_hashes"))])
    return found.withColumn("valid", (F.col("gaps") + F.col("broken_links") + F.col("bad_hashes")) == 0)


def illegal_steps(log: DataFrame, key: str, order: list[str], state: str, allowed: list[tuple[str | None, str]]) -> DataFrame:
    """Rows whose change of ``state`` isn't among ``allowed`` (before, after), with ``before``; None is the beginning."""
    before = F.lag(state).over(Window.partitionBy(key).orderBy(*order))
    ok = F.lit(False)
    for a, b in allowed:
        ok = ok | (F.col("before").eqNullSafe(F.lit(a)) & (F.col(state) == b))
    return log.withColumn("before", before).where(~ok)


def timeline(log: DataFrame, key: str, first: int = 5, last: int = 45) -> DataFrame:
    """The first and last events of each key, and how many are left out between (a report)."""
    up, down = Window.partitionBy(key).orderBy("seq"), Window.partitionBy(key).orderBy(F.desc("seq"))
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    marked = log.withColumns({"__up": F.row_number().over(up), "__down": F.row_number().over(down), "elided": F.greatest(n - first - last, F.lit(0))})
    return marked.where((F.col("__up") <= first) | (F.col("__down") <= last)).drop("__up", "__down")


def acceptance(checks: DataFrame, receipts: DataFrame) -> DataFrame:
    """case_id, violated, unresolved, uncovered, outcome from ``checks`` (case_id, check_id, verdict) and ``receipts``
    (check_id, passed): REJECT, then NEEDS_EVIDENCE for what is unresolved or uncovered, then ACCEPT."""
    covered = receipts.where("passed").select("check_id").distinct().withColumn("covered", F.lit(True))
    found = checks.join(covered, "check_id", "left").groupBy("case_id").agg(
        F.count(F.when(F.col("verdict") == "VIOLATED", 1)).alias("violated"),
        F.count(F.when(F.col("verdict") == "UNRESOLVED", 1)).alias("unresolved"),
        F.count(F.when((F.col("verdict") == "SATISFIED") & F.col("covered").isNull(), 1)).alias("uncovered"),
    )
    return found.withColumn("outcome", F.when(F.col("violated") > 0, "REJECT").when(F.col("unresolved") + F.col("uncovered") > 0, "NEEDS_EVIDENCE").otherwise("ACCEPT"))


def admit(requests: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """``requests`` (key, head) with ``accepted`` and ``reason``: one that names another head than its log's last is stale."""
    last = log.groupBy(key).agg(F.max_by("event_hash", "seq").alias("__last"))
    fresh = F.col("head").eqNullSafe(F.coalesce("__last", F.lit(GENESIS)))
    return requests.join(last, key, "left").withColumns({"accepted": fresh, "reason": F.when(~fresh, "STALE_HEAD").otherwise("FRESH")}).drop("__last")


def regression(expected: DataFrame, measured: DataFrame) -> DataFrame:
    """subject, fact, expected, measured for facts (subject, fact, value) that differ or that only one side has."""
    e, m = expected.select("subject", "fact", F.col("value").alias("expected")), measured.select("subject", "fact", F.col("value").alias("measured"))
    return e.join(m, ["subject", "fact"], "full").where(~F.col("expected").eqNullSafe(F.col("measured")))


def unauthorised(actions: DataFrame) -> DataFrame:
    """``actions`` (status, authorization_ref) in a state that needs an authorisation which they don't name."""
    return actions.where(F.col("status").isin("AUTHORIZED", "STARTED", "COMPLETED", "FAILED") & F.col("authorization_ref").isNull())


def attested(receipts: DataFrame, log: DataFrame, fields: list[str]) -> DataFrame:
    """``receipts`` with ``attested``: whether exactly one event of ``log`` has the receipt's event_hash and all its
    ``fields``; null fields match null ones."""
    theirs = log.groupBy("event_hash").agg(F.count(F.lit(1)).alias("__n"), *[F.first(c).alias(f"__{c}") for c in fields])
    same = F.col("__n") == 1
    for c in fields:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return receipts.join(theirs, "event_hash", "left").withColumn("attested", F.coalesce(same, F.lit(False))).drop("__n", *[f"__{c}" for c in fields])


def committed(results: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """``results`` (key, digest, seq) whose digest a later event of the same log (key, digest, seq) names.

    Only the last event of each digest is compared, so a digest that is named often isn't multiplied."""
    last = log.groupBy(key, "digest").agg(F.max("seq").alias("__last"))
    return results.join(last, [key, "digest"]).where(F.col("__last") > F.col("seq")).drop("__last")


def shape_faults(events: DataFrame, needs: dict[str, list[str]], rules: dict[str, Column]) -> DataFrame:
    """``events`` (kind, ...) with a ``fault``, null where an event has the shape of its kind: UNKNOWN_KIND, MISSING (a column
    that the kind ``needs`` is null) or RULE (a kind's own rule doesn't hold, or can't be told)."""
    fault = F.when(~F.coalesce(F.col("kind").isin(list(needs)), F.lit(False)), "UNKNOWN_KIND")
    for kind, columns in needs.items():
        for c in columns:
            fault = fault.when((F.col("kind") == kind) & F.col(c).isNull(), "MISSING")
    for kind, rule in rules.items():
        fault = fault.when((F.col("kind") == kind) & ~F.coalesce(rule, F.lit(False)), "RULE")
    return events.withColumn("fault", fault)


def normalised_checks(clearances: DataFrame, minima: DataFrame, differences: DataFrame) -> DataFrame:
    """kind, check_id, p_lower, p_upper, verdict of checks of three kinds: a clearance (check_id, p_lower, p_upper, verdict) has
    bounds, a minimum or a difference (check_id, p, verdict) one chance, which is both."""
    one = lambda df, kind: df.select(F.lit(kind).alias("kind"), "check_id", F.col("p").alias("p_lower"), F.col("p").alias("p_upper"), "verdict")
    return clearances.select(F.lit("clearance").alias("kind"), "check_id", "p_lower", "p_upper", "verdict").unionByName(one(minima, "minimum")).unionByName(one(differences, "difference"))


def evidence_requests(plans: DataFrame) -> DataFrame:
    """request_id, case_id, check_id, subject, place: what is to be read for each case, by falling gain, from ``plans``
    (case_id, check_id, disposition, subject, gain); the id is the digest of what is asked."""
    asked = plans.where("disposition = 'OBSERVE'")
    place = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("gain"), "check_id"))
    line = F.concat_ws("|", *[F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")) for c in ("case_id", "check_id", "subject")])
    return asked.select(F.sha2(line, 256).alias("request_id"), "case_id", "check_id", "subject", place.alias("place"))


def bound_manifests(manifests: DataFrame, log: DataFrame, checks: dict[str, tuple[str, str]]) -> DataFrame:
    """``manifests`` (ledger, seq, ...) with a boolean for each of ``checks`` (name: a column of the manifest, and the one of
    the event that it must equal), ``found`` (exactly one event of that ledger and place) and ``bound`` (all of them)."""
    theirs = log.groupBy("ledger", "seq").agg(F.count(F.lit(1)).alias("__n"), *[F.first(b).alias(f"__{b}") for _, b in checks.values()])
    joined = manifests.join(theirs, ["ledger", "seq"], "left").withColumn("found", F.coalesce(F.col("__n") == 1, F.lit(False)))
    joined = joined.withColumns({name: F.col("found") & F.coalesce(F.col(a) == F.col(f"__{b}"), F.lit(False)) for name, (a, b) in checks.items()})
    every = F.col("found")
    for name in checks:
        every = every & F.col(name)
    return joined.withColumn("bound", every).drop("__n", *{f"__{b}" for _, b in checks.values()})


def operations(events: DataFrame, fields: dict[str, list[str]]) -> DataFrame:
    """``events`` (body: JSON) with op, args (name to text) and a fault, null where the operation is of a known kind and has
    exactly the fields of its kind: NOT_JSON, UNKNOWN_OP or FIELDS. An observation's noise variance must be above 0 (NOISE)."""
    told = F.from_json("body", "map<string,string>")
    found = events.withColumns({"args": F.map_filter(told, lambda k, _: k != "op"), "op": told["op"], "__keys": F.array_sort(F.json_object_keys("body"))})
    fault = F.when(F.col("__keys").isNull(), "NOT_JSON").when(~F.coalesce(F.col("op").isin(list(fields)), F.lit(False)), "UNKNOWN_OP")
    for op, names in fields.items():
        fault = fault.when((F.col("op") == op) & (F.col("__keys") != F.array(*[F.lit(n) for n in sorted([*names, "op"])])), "FIELDS")
    fault = fault.when((F.col("op") == "observe") & ~F.coalesce(F.expr("try_cast(args['r'] as double)") > 0, F.lit(False)), "NOISE")
    return found.withColumn("fault", fault).drop("__keys")


def encoded_operations(rows: DataFrame, op: str, fields: list[str]) -> DataFrame:
    """``rows`` with body: the operation ``op`` with ``fields`` as JSON, which :func:`operations` reads back."""
    return rows.withColumn("body", F.to_json(F.struct(F.lit(op).alias("op"), *[F.col(f).cast("string").alias(f) for f in fields])))


def composed(steps: DataFrame, keys: list[str], counts: list[str] | None = None, *, run: int = 4096) -> DataFrame:
    """``keys``, a, b and the sums of ``counts``: the map x -> a x + b that ``steps`` (keys, seq, op, value) make in order of
    seq. ``set`` puts the value, ``shift`` adds it, ``scale`` multiplies; any other operation, or none, changes nothing.

    Such maps compose, so runs of ``run`` sequence numbers fold apart and their maps are folded then: a long log is no one
    task's. Steps that tie in seq are taken by their maps' order; no step, no row."""
    counts = counts or []
    a = F.when(F.col("op") == "set", 0.0).when(F.col("op") == "scale", F.col("value")).otherwise(1.0)
    b = F.when(F.col("op").isin("set", "shift"), F.col("value")).otherwise(0.0)
    rows = steps.select(*keys, "seq", F.floor(F.col("seq") / run).alias("__run"), a.alias("a"), b.alias("b"), *counts)

    def fold(df: DataFrame, by: list[str], order: str) -> DataFrame:
        ops = F.array_sort(F.collect_list(F.struct(F.col(order), "a", "b")))
        zero = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
        done = F.aggregate("ops", zero, lambda m, x: F.struct((x["a"] * m["a"]).alias("a"), (x["a"] * m["b"] + x["b"]).alias("b")))
        sums = [F.sum(c).alias(c) for c in counts]
        return df.groupBy(*by).agg(ops.alias("ops"), *sums).select(*by, done.alias("m"), *counts).select(*by, "m.a", "m.b", *counts)

    return fold(fold(rows, [*keys, "__run"], "seq"), keys, "__run")


def replayed(events: DataFrame, start: dict[str, float]) -> DataFrame:
    """model, accepted, rejected, other, mu: a scalar state after its accepted operations in order: ``events`` (model, seq,
    status, op, value), by :func:`composed`. What is rejected or no operation is counted and changes nothing."""
    state = (F.col("status") == "accepted") & F.coalesce(F.col("op").isin("set", "shift", "scale"), F.lit(False))
    refused = F.col("status") == "rejected"
    told = events.select("model", "seq", "value", F.when(state, F.col("op")).alias("op"), state.cast("long").alias("accepted"), refused.cast("long").alias("rejected"), (~state & ~refused).cast("long").alias("other"))
    done = composed(told, ["model"], ["accepted", "rejected", "other"])
    return done.select("model", "accepted", "rejected", "other", (F.col("a") * start.get("mu", 0.0) + F.col("b")).alias("mu"))
