"""Operator 9: license scans.

Texts and templates are cut into overlapping windows of five-word shingles. MinHash bands over the windows retrieve
templates; the bands are set so that a window as similar as the best aligned window of a true match must be collides
with a chance over 0.999. Each retrieved template is then verified by the exact share of its shingles that the text
holds around the window.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SHINGLE = 5
CONTAINED = 0.8
#: Rows of a band, and the chance with which a true match must be retrieved.
ROWS, SURE = 2, 0.999
#: Bytes of text that are scanned at once.
CHUNK = 500_000

#: Notices and clauses of common licences: fixed values.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "BSD-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


_GOLD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_BASE = 0xD6E8FEB86659FD93
_UP, _DOWN = _powers(1 << 16, _BASE), _powers(1 << 16, pow(_BASE, -1, 1 << 64))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _UP, _DOWN  # noqa: PLW0603
    if len(_UP) <= n:
        _UP, _DOWN = _powers(2 * n, _BASE), _powers(2 * n, pow(_BASE, -1, 1 << 64))
    return _UP, _DOWN


def shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The five-word shingles of some texts, one after the other, as 64-bit numbers; the text that each is of; and its
    first word's number in that text. Letters count in lower case."""
    raw = [(x or "").lower().encode("utf-8", "replace") for x in texts]
    of = np.repeat(np.arange(len(raw)), [len(x) + 1 for x in raw])
    line = np.frombuffer(b"\n".join([*raw, b""]), dtype=np.uint8)
    up, down = _tables(len(line))
    solid = (line != 32) & ((line < 9) | (line > 13))
    edge = np.diff(solid.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((line.astype(np.uint64) + np.uint64(1)) * up[: len(line)], dtype=np.uint64)))
    word = (sums[end] - sums[start]) * down[start]
    word ^= word >> np.uint64(32)
    doc = of[start]
    n = len(word) - SHINGLE + 1
    if n <= 0:
        return (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 2)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(SHINGLE):
        out = (out ^ word[k : k + n]) * _GOLD
        out ^= out >> np.uint64(29)
    whole = doc[:n] == doc[SHINGLE - 1 :]
    first = np.arange(len(word)) - np.searchsorted(doc, doc)
    return out[whole], doc[:n][whole], first[:n][whole]


def layout(size: int) -> tuple[int, int]:
    """Stride of the windows of ``size`` shingles, and bands that retrieve a match with a chance of SURE.

    A match holds 0.8 of the template's shingles, and some window starts within half a stride of it; the least Jaccard
    similarity that leaves gives the number of bands.
    """
    stride = max(1, size // 8)
    shared = int(np.ceil(CONTAINED * size - 1e-9)) - (stride + 1) // 2 * (stride > 1)
    alike = shared / (2 * size - shared)
    return stride, 1 if alike >= 1 else int(np.ceil(np.log(1 - SURE) / np.log(1 - alike**ROWS)))


def _seeds(n: int = 256) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20)
    return r.integers(1, 1 << 32, n, dtype=np.uint64).astype(np.uint32) | np.uint32(1), r.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)


_A, _B = _seeds()


def band_keys(s: np.ndarray, sizes: dict[int, tuple[int, int]]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """size, band, starts of the windows, and their keys. Minima of blocks of the stride are taken once and combined."""
    low = ((s * _MIX) >> np.uint64(32)).astype(np.uint32)
    for b in range(max(n for _, n in sizes.values())):
        rows = []
        for k in range(b * ROWS, (b + 1) * ROWS):
            v = low * _A[k] + _B[k]
            rows.append(v ^ (v >> np.uint32(15)))
        for size, (stride, bands) in sizes.items():
            if b >= bands:
                continue
            starts = np.arange(0, max(1, len(s) - size + stride), stride)
            key = np.zeros(len(starts), dtype=np.uint64)
            for v in rows:
                least = v if stride == 1 else np.minimum.reduceat(v, np.arange(0, len(v), stride))
                done, want = 1, -(-size // stride)
                while done < want:  # the least of so many blocks, from half as many
                    step = min(done, want - done)
                    least = np.concatenate((np.minimum(least[:-step], least[step:]), least[-step:]))
                    done += step
                key = (key ^ least[: len(starts)].astype(np.uint64)) * _MIX
                key ^= key >> np.uint64(31)
            yield size, b, starts, key


class Templates:
    """Templates by size of window, with the keys of their bands."""

    def __init__(self, texts: dict[str, str]) -> None:
        self.names = sorted(texts)
        of = {x: shingles([texts[x]])[0] for x in self.names}
        if short := [x for x in self.names if not len(of[x])]:
            raise ValueError(f"templates of fewer than {SHINGLE} words: {', '.join(short)}")
        self.own = {x: np.unique(of[x]) for x in self.names}
        self.sizes = {n: layout(n) for n in sorted({len(x) for x in of.values()})}
        #: By size and band: the sorted keys, and the templates that have them.
        self.keys: dict[tuple[int, int], tuple[np.ndarray, list[str]]] = {}
        found: dict[tuple[int, int], list[tuple[int, str]]] = {}
        for x in self.names:
            n = len(of[x])
            for size, b, _, key in band_keys(of[x], {n: (n, self.sizes[n][1])}):
                found.setdefault((size, b), []).append((int(key[0]), x))
        for at, pairs in found.items():
            pairs.sort()
            self.keys[at] = np.array([k for k, _ in pairs], dtype=np.uint64), [x for _, x in pairs]

    def scan(self, texts: list[str | None]) -> list[dict[str, tuple[int, int, float]]]:
        """For each text, by template: first word, last word (exclusive) and contained share of its best match."""
        best: list[dict[str, tuple[int, int, float]]] = [{} for _ in texts]
        s, doc, word = shingles(texts)
        if not len(s):
            return best
        tried: set[tuple[str, int, int]] = set()
        for size, b, starts, keys in band_keys(s, self.sizes):
            known, names = self.keys[size, b]
            at = np.searchsorted(known, keys)
            for w in np.flatnonzero(known[np.minimum(at, len(known) - 1)] == keys).tolist():
                for k in range(int(at[w]), len(known)):
                    if known[k] != keys[w]:
                        break
                    stride, start = self.sizes[size][0], int(starts[w])
                    a, z = max(0, start - stride), min(len(s), start + size + stride)
                    for d in np.unique(doc[a:z]).tolist():  # a window may reach over a text's end
                        if (names[k], start, d) not in tried:
                            tried.add((names[k], start, d))
                            self._verify(names[k], s[a:z], doc[a:z] == d, word[a:z], best[d])
        return best

    def _verify(self, name: str, s: np.ndarray, here: np.ndarray, word: np.ndarray, best: dict[str, tuple[int, int, float]]) -> None:
        share = float(np.isin(self.own[name], s[here]).mean())
        if share >= CONTAINED and share > best.get(name, (0, 0, 0.0))[2]:
            at = word[here & np.isin(s, self.own[name])]
            best[name] = (int(at[0]), int(at[-1]) + SHINGLE, share)


def _parts(texts: list[str | None]) -> Iterator[list[str | None]]:
    part, size = [], 0
    for x in texts:
        part.append(x)
        size += len(x or "") + 1
        if size >= CHUNK:
            yield part
            part, size = [], 0
    if part:
        yield part


def _scan(batches: Iterator[pa.RecordBatch], texts: dict[str, str]) -> Iterator[pa.RecordBatch]:
    t = Templates(texts)
    for b in batches:
        found = [x for part in _parts(b.column("text").to_pylist()) for x in t.scan(part)]
        yield pa.RecordBatch.from_arrays(
            [
                b.column("doc_id"),
                pa.array([len(x) for x in found], pa.int64()),
                pa.array([",".join(sorted(x)) for x in found], pa.string()),
                pa.array([",".join(f"{k}:{x[k][0]}:{x[k][1]}" for k in sorted(x)) for x in found], pa.string()),
                pa.array([max((y[2] for y in x.values()), default=0.0) for x in found], pa.float64()),
            ],
            ["doc_id", "n_licenses", "licenses", "places", "contained"],
        )


def scan(docs: DataFrame, *, templates: dict[str, str] | None = None, max_templates: int = 2000) -> DataFrame:
    """doc_id, n_licenses, licenses (names of the templates found, sorted, joined by commas), places (name:first word:
    last word, exclusive) and contained (the largest share of a template's shingles found) for every row.

    A template is found where a window holds at least 0.8 of its shingles. Templates go to every task, so more than
    ``max_templates`` are an error. Texts that are null or shorter than five words match none; a text of any length is read
    whole. Of a template's windows the one that holds most of it counts. Repeated rows each come back; other columns are not
    read; an empty table gives no rows.
    """
    texts = TEMPLATES if templates is None else templates
    if len(texts) > max_templates:
        raise ValueError(f"more than {max_templates} templates")
    return docs.select("doc_id", "text").mapInArrow(partial(_scan, texts=texts), "doc_id long, n_licenses long, licenses string, places string, contained double")
