"""Operators 11 to 13 against brute force: on the small documents, on odd rows, and on made rows with hot groups."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from belvane.llm import collocations, ngram_join, runs
from belvane.llm.queries import OPERATORS

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
NEW = ("op11_collocations", "op12_ngram_join", "op13_periodic_runs")


def tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: [str(x) for x in r])


def sorted_(rows):
    return sorted(rows, key=lambda r: [str(x) for x in r])


@pytest.mark.parametrize("name", NEW)
def test_empty_table(name, empty):
    assert OPERATORS[name](empty).count() == 0


@pytest.mark.parametrize("name", NEW)
def test_clashing_columns_change_nothing(name, odd, clashing):
    assert tuples(OPERATORS[name](clashing)) == tuples(OPERATORS[name](odd))


# 11 -----------------------------------------------------------------------------------------------------------------
def slow_collocations(rows, least=30, longer=80, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(ASCII)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        gone = {p[i : i + k] for p, a in found.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= longer * c[p[i : i + k]]}
        ranked = []
        for p, a in found.items():
            if p not in gone:
                s, k = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                ranked.append((s, a, " ".join(p), c[p[:k]], c[p[k:]]))
        ranked.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i + 1, p, a, l, r, n[lang], s) for i, (s, a, p, l, r) in enumerate(ranked[:top])]
    return sorted_(out)


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_collocations_by_brute_force(table, request):
    df = request.getfixturevalue(table)
    for least in (30, 3):
        assert tuples(collocations.collocations(df, least=least)) == slow_collocations(df.select("text", "lang").collect(), least)


def test_collocations_with_ties_cuts_and_a_hot_language(spark, monkeypatch):
    r = random.Random(2)
    words = ["a", "b", "B", "é", "C", " ", "x\x00", "zz", "q"]
    rows = [(k, "".join(r.choice(words) + r.choice([" ", " ", "\t", ", ", "\n", "  "]) for _ in range(r.randrange(60))), r.choice(["en", "en", "en", None, "und", "de"])) for k in range(400)]
    rows += [(1000, None, "en"), (1001, "", None), (1002, "one two. " * 40, "fr"), (1003, "one two. " * 40, "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    for least, top in ((30, 2000), (5, 7), (300, 2000)):
        assert tuples(collocations.collocations(df, least=least, top=top)) == slow_collocations([x[1:] for x in rows], least, top=top)


def test_counts_of_a_stretch_that_is_cut(docs):
    """Counts are passed on every few thousand words and sum to the same."""
    whole = docs.select("lang", "text").toArrow().to_batches()
    once = Counter()
    for b in collocations._hash_counts(iter(whole), None):
        once.update({k: len(x) // 4 for k, x in zip(b.column("part").to_pylist(), b.column("hashes").to_pylist(), strict=True)})
    size, collocations.FLUSH = collocations.FLUSH, 3000
    try:
        assert len(list(collocations._hash_counts(iter(whole), None))) > 5
    finally:
        collocations.FLUSH = size
    assert once


# 12 -----------------------------------------------------------------------------------------------------------------
def shingles(text):
    w = WORD.findall((text or "").translate(ASCII))
    return frozenset(" ".join(w[k : k + 5]) for k in range(max(len(w) - 4, 1))) if w else frozenset()


def slow_join(rows):
    sets = [shingles(text) for _, text in rows]
    by, shared = defaultdict(list), Counter()
    for k, s in enumerate(sets):
        for x in s:
            by[x].append(k)
    for ks in by.values():
        shared.update((a, b) for n, a in enumerate(ks) for b in ks[n + 1 :])
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((top(a), top(b)))
            root[b] = a
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[top(k)] = min(d, least.get(top(k), d))
    return sorted_((d, len(sets[k]), least.get(top(k))) for k, (d, _) in enumerate(rows))


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_ngram_join_by_brute_force(table, request):
    df = request.getfixturevalue(table)
    assert tuples(ngram_join.join(df)) == slow_join([(r["doc_id"], r["text"]) for r in df.collect()])


def made_groups(seed, groups, members):
    """Copies with some words changed, on either side of the limit, beside texts that share passages only."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(5000)}"
    rows, common = [], [word() for _ in range(40)]
    for _ in range(groups):
        base = [word() for _ in range(r.choice((12, 60, 200)))]
        for _ in range(members):
            text = list(base)
            for _ in range(r.choice((0, 1, 2, 3, 8, 14)) * len(base) // 200):
                text[r.randrange(len(text))] = word()
            text = text[: len(text) - r.choice((0, 0, 5, 20)) * len(base) // 200] + (common if r.random() < 0.1 else [])
            rows.append((len(rows) * 7 % 1009, " ".join(text)))
    return rows + [(5000 + k, " ".join(common + [word() for _ in range(50)])) for k in range(60)]


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join_in_large_groups(spark, seed):
    rows = made_groups(seed, 4, 150)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert tuples(ngram_join.join(df)) == slow_join(rows)


def test_ngram_join_makes_no_pairs_of_a_group_of_near_copies(spark, monkeypatch):
    """Of 500 near copies that all link, the pairs that are met grow as the copies, not as their square."""
    r = random.Random(9)
    base = [f"w{k}" for k in range(100)]
    rows = []
    for k in range(500):
        text = list(base)
        text[r.randrange(100)] = f"own{k}"
        rows.append((k, " ".join(text)))
    met, pairs = [], ngram_join._pairs

    def counted(*args):
        found = pairs(*args)
        met.append(found.count())
        return found

    monkeypatch.setattr(ngram_join, "_pairs", counted)
    found = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {x["component_id"] for x in found.collect()} == {0}
    assert sum(met) < 20 * 500


def test_ngram_join_meets_only_rows_that_may_link(spark):
    """Of a shingle's rows those stay that the filters leave a partner, and no pair that passes is lost."""
    r = random.Random(4)
    sets = [(k, n, [f % 40 for f in r.sample(range(400), n - -(-80 * n // 100) + 1)]) for k in range(300) for n in [r.choice((20, 30, 45, 90))]]
    sets = [(k, n, list(dict.fromkeys(p))) for k, n, p in sets]
    # so far down, sets of one size have too little left to share
    sets += [(1000 + k, 100, [10**6 + 100 * k + j for j in range(15)] + [99]) for k in range(50)]
    rows = [(t, x, n, place) for x, n, prefix in sets for place, t in enumerate(prefix)]

    def passing(rows):
        by = defaultdict(list)
        for t, *row in rows:
            by[t].append(row)
        pairs = ((t, *sorted((a, b))) for t, some in by.items() for k, a in enumerate(some) for b in some[k + 1 :])
        near = lambda a, b: 100 * min(a[1], b[1]) >= 80 * max(a[1], b[1])
        return {(t, a[0], b[0]) for t, a, b in pairs if near(a, b) and 180 * (1 + min(a[1] - 1 - a[2], b[1] - 1 - b[2])) >= 80 * (a[1] + b[1])}

    kept = ngram_join._shared(spark.createDataFrame(sets, "same long, n long, prefix array<long>"), None).collect()
    assert sorted(x["rank"] for x in kept) == list(range(len(kept)))
    kept = {(x["token"], x["x"], x["n"], x["place"]) for x in kept}
    assert passing(kept) == passing(rows) and passing(rows)
    assert not any(t == 99 for t, *_ in kept) and len(kept) < len([x for x in rows if x[0] < 99])


def test_shingles_of_many_texts_are_hashed_at_once(monkeypatch):
    """Equal shingles, and only they, have equal hashes, wherever texts are cut; only words of over 64 bytes are hashed one by one."""
    r = random.Random(3)
    parts = ["a", "B", "b", "é", " ", "  ", "\t", "\n", "\x0b\x0c", "\r", "\x1c", "\x85", "\x00", "Word", *["x" * n for n in (7, 8, 9, 16, 17, 63, 64)]]
    texts = [None, "", *["".join(r.choice(parts[:14] if r.random() < 0.9 else parts) for _ in range(r.randrange(50))) for _ in range(600)], None, "z " * 5000]
    texts = [t if t is None or max(map(len, t.encode().split()), default=0) <= 64 else None for t in texts]

    def met(texts, size):
        tokens, hashes = {}, {}
        found = list(ngram_join.shingles(pa.array(["skipped", *texts])[1:], size))
        assert len(found) == len(texts)
        for text, hs in zip(texts, found, strict=True):
            w = (text or "").translate(ASCII).encode().split()
            own = [tuple(w[k : k + size]) for k in range(max(len(w) - size + 1, 1))] if w else []
            assert len(own) == len(hs)
            for token, h in zip(own, hs.tolist(), strict=True):
                assert tokens.setdefault(token, h) == h and hashes.setdefault(h, token) == token
        return len(tokens)

    assert met(["q" * 65, "q" * 66 + " R", "q" * 65, "Q" * 65 + "\tr", "q" * 5000], 5) == 4
    monkeypatch.setattr(ngram_join.xxhash, "xxh64_intdigest", None)
    for most in (ngram_join.BYTES, 100, 1):
        monkeypatch.setattr(ngram_join, "BYTES", most)
        assert met(texts, 5) > 1000 and met(texts, 1) > 50


# 13 -----------------------------------------------------------------------------------------------------------------
def slow_runs(w, least=12):
    n, out = len(w), {}
    for q in range(1, n // 2 + 1):
        x = q
        while x < n:
            if w[x] != w[x - q]:
                x += 1
                continue
            first = x
            while x < n and w[x] == w[x - q]:
                x += 1
            if x - first >= q and x - first + q >= least:
                out.setdefault((first - q, x - first + q), q)
    return sorted((*k, q) for k, q in out.items())


def test_runs_by_brute_force_in_any_number_of_steps():
    r = random.Random(1)
    for k in range(400):
        n, a, w = r.randrange(160), r.choice([1, 2, 3, 5]), []
        while len(w) < n:
            part = [r.randrange(a + k % 2) for _ in range(r.randrange(1, 30))]
            w += part * r.choice([1, 1, 2, 3, 5] if k % 3 else [1])
        w = [b"%d" % x for x in w[:n]]
        least = r.choice([12, 12, 5, 20])
        want = slow_runs(w, least)
        assert runs.runs_of(w, least) == runs.runs_of(w, least, r.randrange(1, 60)) == want
        if k % 8 == 0:
            assert runs.runs_of(w, least, 1) == want


def test_runs_of_long_texts():
    assert runs.runs_of([b"a"] * 100_000) == [(0, 100_000, 1)]
    r = random.Random(4)
    part = [b"%d" % r.randrange(3000) for _ in range(7000)]
    assert runs.runs_of([b"x", *part * 3, *part[:100], b"y"]) == [(1, 21_100, 7000)]


def slow_digests(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = slow_runs(w) if len(set(w)) > 1 else [(0, n, 1)] if n >= 12 else []
    drop = {i for s, k, q in found for i in range(s + q, s + k)}
    best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4), sha("".join(f"{s},{k},{q}\n" for s, k, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_run_digests_by_brute_force(table, request):
    df = request.getfixturevalue(table)
    if table == "docs":
        df = df.where("n_chars < 8000")  # brute force is quadratic
    assert tuples(runs.digests(df)) == sorted_(slow_digests(r["doc_id"], r["text"]) for r in df.collect())
