"""Operator 4: a quality classifier from weak labels.

Overlapping heuristic labellers vote on each document (1 good, 0 bad, abstain). A bad document has one fault or another,
and no labeller sees them all; so a document is of one of several latent classes, the good one or one for each labeller's
fault, and expectation-maximisation over the counts of vote patterns estimates how often each labeller votes against the
documents of each class: its false alarms on good ones, and its hits on each fault. The posterior of the good class is a
document's label; those labels train a linear scorer on hashed features, which then scores every document.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from belvane.llm._common import in_small_batches

BINS = 2048
LABELLERS = ("length", "symbols", "capitals", "line_repeats", "cells", "word_length", "exclaims", "variety")
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_NEUTRAL = "-"
_VOTES = {"1": 1.0, "0": 0.0, _NEUTRAL: np.nan}


def votes(text: str | None) -> str:
    """One character per labeller: 1 good, 0 bad, - abstains."""
    text = text or ""
    words = _WORDS.findall(text)
    n, chars = len(words), max(1, len(text))
    if not n:
        return "0" + _NEUTRAL * (len(LABELLERS) - 1)
    lines = [x for x in text.split("\n") if x.strip()]
    letters = sum(map(len, words))
    upper = sum(w.isupper() and len(w) > 1 for w in words) / n

    def vote(x: float, good: float, bad: float) -> str:
        return "1" if x <= good else "0" if x > bad else _NEUTRAL

    return "".join(
        (
            "0" if n < 5 else "1" if n >= 50 else _NEUTRAL,
            vote(sum(map(text.count, "#*$%&<>^~")) / n, 0.05, 0.3),
            vote(upper, 0.1, 0.4),
            vote(1 - len(set(lines)) / max(1, len(lines)), 0.1, 0.3) if len(lines) > 2 else _NEUTRAL,
            vote(text.count("|") / n, 0.02, 0.2),
            vote(abs(letters / n - 5.5), 2.5, 4.5),
            vote(text.count("!") / n, 0.05, 0.3),
            vote(1 - len(set(words)) / min(n, 2000), 0.7, 0.85) if n >= 50 else _NEUTRAL,
        )
    )


def _classes() -> np.ndarray:
    """A class for each byte: space, newline, lower case, capital, digit, byte above ASCII, or a punctuation mark."""
    kind = np.zeros(256, dtype=np.uint32)
    for b in range(256):
        c = chr(b)
        kind[b] = 0 if c == " " else 1 if c == "\n" else 2 if c.islower() and b < 128 else 3 if c.isupper() and b < 128 else 4 if c.isdigit() and b < 128 else 5 if b >= 128 else 6 + b % 26
    return kind


_CLASS = _classes()


def hashed(text: str | None) -> np.ndarray:
    """Frequencies of hashed runs of three byte classes: a unit vector of BINS parts, or zero for short texts."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), dtype=np.uint8)
    if len(raw) < 3:
        return np.zeros(BINS, dtype=np.float32)
    k = _CLASS[raw]
    key = k[:-2] * np.uint32(1024) + k[1:-1] * np.uint32(32) + k[2:]
    at = (key * np.uint32(2654435761)) >> np.uint32(21)
    x = np.sqrt(np.bincount(at, minlength=BINS).astype(np.float32))
    return x / np.linalg.norm(x)


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = Counter(votes(x) for x in b.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["pattern", "n"])


def _parsed(patterns: list[str]) -> np.ndarray:
    return np.array([[_VOTES[c] for c in k] for k in patterns])


def accuracies(patterns: dict[str, int], rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """The share of each class, the good one first, and by class each labeller's chance to vote against a document when it
    votes at all; for the good class that is its false alarms, 1 less its accuracy there.

    Expectation-maximisation with labellers taken as independent given the class. It begins from the guess that a labeller
    votes against nine in ten documents with its own fault, one in ten with another's and one in fifty good ones; all of
    these are estimated. A class is known by its own labeller, who is taken to be better than chance on it (0.5 at least),
    so that no class of faults turns into a second good one. A labeller that never votes keeps the guess of 0.1.
    """
    v, n = _parsed(list(patterns)), np.array(list(patterns.values()), dtype=float)
    faults = v.shape[1]
    against, cast = np.nan_to_num(1 - v), (~np.isnan(v)).astype(float)
    share, fires = np.r_[0.8, np.full(faults, 0.2 / faults)], np.full((faults + 1, faults), 0.1)
    fires[0], fires[np.arange(1, faults + 1), np.arange(faults)] = 0.02, 0.9
    for _ in range(rounds):
        p = _posterior(v, share, fires) * n[:, None]
        share = (p.sum(axis=0) + 1) / (n.sum() + faults + 1)
        fires = np.clip((p.T @ against + 0.05) / (p.T @ cast + 0.5), 1e-4, 1 - 1e-4)
        fires[np.arange(1, faults + 1), np.arange(faults)] = np.maximum(np.diag(fires[1:]), 0.5)
    return share, fires


def _posterior(v: np.ndarray, share: np.ndarray, fires: np.ndarray) -> np.ndarray:
    """The chance of each class (columns) for each row of votes."""
    against, cast = np.nan_to_num(1 - v), ~np.isnan(v)
    z = np.log(share) + against @ np.log(fires).T + (cast - against) @ np.log(1 - fires).T
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def posterior(pattern: str, model: tuple[np.ndarray, np.ndarray]) -> float:
    """The chance that a document with these votes is good."""
    return float(_posterior(_parsed([pattern]), *model)[0, 0])


def _train_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column("text").to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([votes(x) for x in texts], pa.string()), pa.array([hashed(x).tobytes() for x in texts], pa.binary())], ["pattern", "x"])


def train(x: np.ndarray, y: np.ndarray, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias by logistic loss on chances ``y``, both classes weighing the same."""
    weight = np.where(y > 0.5, 0.5 / max(1e-9, (y > 0.5).mean()), 0.5 / max(1e-9, (y <= 0.5).mean())).clip(0, 5)
    w, b, seen_w, seen_b = np.zeros(BINS), 0.0, np.full(BINS, 1e-6), 1e-6
    for _ in range(steps):  # logistic loss, adaptive steps
        err = weight * (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y)
        gw, gb = x.T @ err / len(y) + 1e-4 * w, err.mean()
        seen_w, seen_b = seen_w + gw * gw, seen_b + gb * gb
        w, b = w - 0.5 * gw / np.sqrt(seen_w), b - 0.5 * gb / np.sqrt(seen_b)
    return w.astype(np.float32), float(b)


def fit(docs: DataFrame, *, max_rows: int = 3000) -> tuple[np.ndarray, float]:
    """Weights and bias of the scorer. Vote patterns are counted over all of ``docs``; the scorer is trained on at most
    ``max_rows`` documents, those with the smallest hashes of their ids and texts."""
    texts = in_small_batches(docs).select("text")
    counts = texts.mapInArrow(_vote, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    found = {r["pattern"]: r["n"] for r in counts.collect()}  # at most 3 ** len(LABELLERS) rows
    if not found:
        return np.zeros(BINS, dtype=np.float32), 0.0
    model = accuracies(found)
    key = F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(17))
    # the bound is found from keys alone, so that only the texts below it, about max_rows in all, meet in one task
    last = docs.select(key.alias("k")).orderBy("k").limit(max_rows).agg(F.max("k")).first()[0]
    picked = docs.select(key.alias("k"), "text").where(F.col("k") <= last).orderBy("k").limit(max_rows)
    rows = picked.select("text").mapInArrow(_train_rows, "pattern string, x binary").collect()  # at most max_rows, 8 KB each
    x = np.stack([np.frombuffer(r["x"], dtype=np.float32) for r in rows])
    y = np.array([posterior(r["pattern"], model) for r in rows])
    return train(x, y)


def _scores(texts: list[str | None], w: np.ndarray, b: float) -> np.ndarray:
    z = np.array([float(hashed(x) @ w) + b if x else -30.0 for x in texts], dtype=float)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _score(batches: Iterator[pa.RecordBatch], w: np.ndarray, b: float, limit: float) -> Iterator[pa.RecordBatch]:
    for r in batches:
        texts = r.column("text").to_pylist()
        p = _scores(texts, w, b)
        yield pa.RecordBatch.from_arrays([r.column("doc_id"), pa.array([votes(x) for x in texts], pa.string()), pa.array(p), pa.array(p >= limit)], ["doc_id", "votes", "score", "kept"])


def _keep(batches: Iterator[pa.RecordBatch], w: np.ndarray, b: float, limit: float) -> Iterator[pa.RecordBatch]:
    for r in batches:
        yield r.select(["row"]).filter(pa.array(_scores(r.column("text").to_pylist(), w, b) >= limit))


def score(docs: DataFrame, *, limit: float = 0.4, max_rows: int = 3000) -> DataFrame:
    """doc_id, votes (one character per labeller), score (0 to 1) and kept (score >= limit) for every row.

    Null and empty texts score near 0 and are rejected; a text of any length is read whole. A score equal to ``limit`` is
    kept. Repeated rows each come back, with the same score; other columns are not read. An empty table gives no rows.
    """
    w, b = fit(docs, max_rows=max_rows)
    return docs.select("doc_id", "text").mapInArrow(partial(_score, w=w, b=b, limit=limit), "doc_id long, votes string, score double, kept boolean")


def keep_good(docs: DataFrame, *, limit: float = 0.4, max_rows: int = 3000) -> DataFrame:
    """The rows of ``docs`` that :func:`score` keeps, with all their columns, whatever their names. Rows with a null or empty
    text go; a text of any length is read whole; a score equal to ``limit`` is kept; repeated rows are kept or go together. An
    empty table gives no rows."""
    w, b = fit(docs, max_rows=max_rows)
    read = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    return read.mapInArrow(partial(_keep, w=w, b=b, limit=limit), read.select("row").schema).select("row.*")
