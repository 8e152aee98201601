"""Operator 10: language identification by rank-order profiles.

A profile is the list of the most frequent letter n-grams (1 to 3 letters, words padded by a blank) of a language, in
falling order. A document's own list is compared with each: every n-gram adds the distance of its two places, or the
most that is possible if the profile lacks it. The language with the least sum wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from belvane.llm._common import materialise

#: n-grams are counted by hash, in this many bins.
BINS = 1 << 16
PROFILE = 400
DOCUMENT = 300


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def grams(text: str | None) -> np.ndarray | None:
    """Bins of the n-grams of a text, or None if it has no letter."""
    if not text:
        return None
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    c = np.where(_letters()[c], c, 0).astype(np.uint64)
    if not c.any():
        return None
    c = np.concatenate(([0], c, [0])).astype(np.uint64)
    one, two, three = c[1:-1], (c[:-1] << np.uint64(21)) | c[1:], (c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:]
    keep = [one[one > 0], two[(c[:-1] > 0) | (c[1:] > 0)] | np.uint64(1 << 63), three[c[1:-1] > 0]]
    return ((np.concatenate(keep) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)


def ranked(bins: np.ndarray, most: int = DOCUMENT) -> np.ndarray:
    """The most frequent bins in falling order, equals by bin."""
    n = np.bincount(bins, minlength=BINS)
    seen = np.flatnonzero(n)
    if len(seen) > 4 * most:
        least = np.partition(n[seen], len(seen) - most)[len(seen) - most]
        seen = seen[n[seen] >= least]
    return seen[np.lexsort((seen, -n[seen]))][:most]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for b in batches:
        for text, lang in zip(b.column("text"), b.column("lang"), strict=True):
            found = grams(text.as_py())
            if found is not None:
                n = sums.get(lang.as_py())
                if n is None:
                    if len(sums) >= 200:
                        yield from _flush(sums)
                        sums = {}
                    n = sums[lang.as_py()] = np.zeros(BINS, dtype=np.int64)
                n += np.bincount(found, minlength=BINS)
    yield from _flush(sums)


def _flush(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for lang, n in sums.items():
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array(seen, pa.int64()), pa.array(n[seen], pa.int64())], ["lang", "bin", "n"])


def learn(docs: DataFrame, *, max_languages: int = 500) -> tuple[list[str], np.ndarray]:
    """The languages, sorted, and each one's place for every bin (PROFILE where the profile lacks it).

    All rows with a text and a language count. More than ``max_languages`` values are an error, as the profiles go to
    every task (128 KB a language).
    """
    counts = docs.select("text", "lang").where("text is not null and lang is not null").mapInArrow(_count, "lang string, bin long, n long")
    sums = counts.groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    # one language has at most BINS bins
    best = materialise(sums.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "bin")) - 1).where(F.col("place") < PROFILE))
    if best.select("lang").distinct().count() > max_languages:
        raise ValueError(f"lang has more than {max_languages} values")
    rows = best.select("lang", "bin", "place").collect()  # at most PROFILE rows a language
    langs = sorted({r["lang"] for r in rows})
    places = np.full((len(langs), BINS), PROFILE, dtype=np.int16)
    at = {x: k for k, x in enumerate(langs)}
    for r in rows:
        places[at[r["lang"]], r["bin"]] = r["place"]
    return langs, places


def nearest(text: str | None, langs: list[str], places: np.ndarray) -> tuple[str, float]:
    """The language of a text and a score: how much of the largest possible distance its profile avoids."""
    found = grams(text)
    if found is None or not langs:
        return "und", 0.0
    own = ranked(found)
    theirs = places[:, own].astype(np.int64)
    far = np.where(theirs == PROFILE, PROFILE, np.abs(theirs - np.arange(len(own)))).sum(axis=1)
    k = int(far.argmin())
    return langs[k], float(1 - far[k] / (PROFILE * len(own)))


def _predict(batches: Iterator[pa.RecordBatch], langs: list[str], profile) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    places = profile.value
    for b in batches:
        found = [nearest(x.as_py(), langs, places) for x in b.column("text")]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])


def held_out(doc_id: Column) -> Column:
    """The quarter of the ids that nothing is learned from; a null id is not of it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, *, max_languages: int = 500) -> DataFrame:
    """doc_id, held_out, lang_pred and score (0 to 1) for every row, with profiles learned from the other three quarters.

    A text that is null or has no letter is ``und`` with score 0, as is every text when nothing could be learned.
    Equal distances go to the first language in order. A text of any length is read whole. Repeated rows each count and come
    back; a null doc_id is not held out; other columns are not read; an empty table gives no rows.
    """
    langs, places = learn(docs.where(~held_out(F.col("doc_id"))), max_languages=max_languages)
    profile = docs.sparkSession.sparkContext.broadcast(places)  # at most max_languages * 128 KB
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(partial(_predict, langs=langs, profile=profile), "doc_id long, held_out boolean, lang_pred string, score double")
