"""Operator 1: host-level quality rules.

Each document is tested by rules; a host (``source``) gets, for every rule, the rate of its documents that fail,
shrunk towards the rate of all hosts by a beta prior whose parameters are fitted to the hosts by moments. A host is
rejected where its posterior rate is surely over the limit of a rule, and that verdict is joined back to its documents.
The limit lies above what the fitted prior takes to be common among hosts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from belvane.llm._common import materialise

_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[str]) -> int:
    """Words that lie in a three-word window which occurs twice or more."""
    if len(words) < 4:
        return 0
    ids = pd.factorize(np.array(words, dtype=object))[0].astype(np.int64)
    pairs = np.unique(ids[:-1] * (int(ids.max()) + 1) + ids[1:], return_inverse=True)[1]
    windows = pairs[:-1].astype(np.int64) * (int(ids.max()) + 1) + ids[2:]
    _, which, times = np.unique(windows, return_inverse=True, return_counts=True)
    again = times[which] > 1
    covered = np.zeros(len(words), dtype=bool)
    for k in range(3):
        covered[k : k + len(again)] |= again
    return int(covered.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_lines (lines with a word), n_dup_lines, n_repeat_words of a text."""
    text = text or ""
    words = _WORDS.findall(text)
    lines = [x for x in text.split("\n") if _WORDS.search(x)]
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeated_words(words)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = np.array([measure(x) for x in b.column("text").to_pylist()], dtype=np.int64).reshape(-1, len(COUNTS))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), *[pa.array(found[:, k]) for k in range(len(COUNTS))]], ["doc_id", "source", *COUNTS])


def rules(min_words: int, max_symbol_share: float, max_dup_share: float, max_repeat_share: float) -> dict[str, Column]:
    """The rules, each true where a document fails it."""
    return {
        "fails_length": F.col("n_words") < min_words,
        "fails_repeats": 100 * F.col("n_repeat_words") > 100 * max_repeat_share * F.col("n_words"),
        "fails_symbols": F.col("n_symbols") > max_symbol_share * F.col("n_words"),
        "fails_lines": F.col("n_dup_lines") > max_dup_share * F.col("n_lines"),
    }


def shrunk(failed: Column, n: Column, mean: Column, strength: Column) -> Column:
    """The posterior mean of a rate under a beta prior with this mean and strength (the sum of its parameters)."""
    return (failed + mean * strength) / (n + strength)


def limit_of(mean: Column, strength: Column, spread: float, most: float) -> Column:
    """A rate that few hosts have by the prior: ``spread`` standard deviations over its mean, ``most`` if that is lower."""
    return F.least(mean + spread * F.sqrt(mean * (1 - mean) / (strength + 1)), F.lit(most))


def judge_hosts(
    docs: DataFrame, *, min_words: int = 50, max_symbol_share: float = 0.25, max_dup_share: float = 0.5, max_repeat_share: float = 0.5,
    spread: float = 2.0, sure: float = 2.0, max_host_rate: float = 0.7,
) -> DataFrame:
    """doc_id, source, the counts, a column for each rule, ``base_failed``, ``host_rate`` (the host's shrunk rate of the
    rule by which it comes nearest to its limit), ``host_excess`` (by how much that rate, less ``sure`` standard
    deviations of its posterior, is over the limit), ``host_rejected`` (that is above 0) and ``kept``: not
    ``base_failed``, and the host isn't rejected.

    A null text has no words and fails by length; a text of any length is read whole. A null source is a host of its own.
    Repeated rows each count and come back; a host at its limit exactly is kept. With one host, or hosts all alike, the
    prior is as strong as 1000 documents. Other columns of ``docs`` are not read. An empty table gives no rows.
    """
    tests = rules(min_words, max_symbol_share, max_dup_share, max_repeat_share)
    read = docs.select("doc_id", "source", "text")
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in read.schema if f.name != "text"]
    measured = read.mapInArrow(_measure, ", ".join([*kinds, *[f"{c} long" for c in COUNTS]]))
    found = materialise(measured.withColumns(tests))
    hosts = found.groupBy("source").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(c).cast("double")).alias(c) for c in tests])
    # moments over hosts: mean and variance of the raw rates, and the variance that sampling alone would give; one row
    moments = hosts.agg(
        *[F.avg(F.col(c) / F.col("n")).alias(f"mean_{c}") for c in tests],
        *[F.coalesce(F.var_samp(F.col(c) / F.col("n")), F.lit(0.0)).alias(f"var_{c}") for c in tests],
        F.avg(1 / F.col("n")).alias("inverse"),
    )

    def judged(c: str) -> Column:
        mean, own = F.col(f"mean_{c}"), F.col(f"mean_{c}") * (1 - F.col(f"mean_{c}"))
        between = F.greatest(F.col(f"var_{c}") - own * F.col("inverse"), F.lit(1e-9))
        strength = F.least(F.greatest(own / between - 1, F.lit(2.0)), F.lit(1000.0))
        rate = shrunk(F.col(c), F.col("n"), mean, strength)
        low = rate - sure * F.sqrt(rate * (1 - rate) / (F.col("n") + strength + 1))
        return F.struct((low - limit_of(mean, strength, spread, max_host_rate)).alias("excess"), rate.alias("rate"))

    worst = F.greatest(*[judged(c) for c in tests])
    verdicts = hosts.join(F.broadcast(moments)).select(F.col("source").alias("__host"), worst.alias("__worst"))
    verdicts = verdicts.select("__host", F.col("__worst.rate").alias("host_rate"), F.col("__worst.excess").alias("host_excess"))
    base = F.col("fails_length") | F.col("fails_repeats")
    # Spark broadcasts the verdicts if their measured size is small, and else splits the rows of a large host
    return found.join(verdicts, F.col("source").eqNullSafe(F.col("__host")), "left").select(
        "doc_id", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *tests,
        base.alias("base_failed"), "host_rate", "host_excess",
        (F.col("host_excess") > 0).alias("host_rejected"),
        (~base & (F.col("host_excess") <= 0)).alias("kept"),
    )
