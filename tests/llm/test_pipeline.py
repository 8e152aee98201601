"""The pipeline's own stages against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from belvane.llm import bpe, mixing, ngram_join, quality_classifier

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(ASCII))
    return frozenset(" ".join(w[k : k + 5]) for k in range(max(len(w) - 4, 1))) if w else frozenset()


def slow_links(sets):
    """Pairs of an index of 0.8 or more, over all pairs that share a shingle."""
    by = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            by[x].append(k)
    shared = defaultdict(int)
    for ks in by.values():
        for n, a in enumerate(ks):
            for b in ks[n + 1 :]:
                shared[a, b] += 1
    none = [k for k, s in enumerate(sets) if not s]
    links = {p for p, n in shared.items() if n >= 0.8 * (len(sets[p[0]]) + len(sets[p[1]]) - n)}
    return links | {(none[0], k) for k in none[1:]}


def slow_kept(rows):
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in slow_links([shingles(r["text"]) for r in rows]):
        a, b = sorted((top(a), top(b)))
        root[b] = a
    least = defaultdict(list)
    for k, r in enumerate(rows):
        least[top(k)].append((r["doc_id"] is None, r["doc_id"] or 0))
    return sorted(map(min, least.values()))


def kept(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in df.collect())


def test_near_duplicates_of_the_pipeline(spark, docs, odd):
    for df in (docs, odd, spark.read.parquet("/root/testdata/sf0.01/documents.parquet")):
        found = corpus_pipeline.drop_near_duplicates(spark, df, "")
        assert found.columns == df.columns
        assert kept(found) == slow_kept(df.collect())


def test_near_duplicates_in_a_large_group(spark):
    """Copies with some words changed, on either side of the limit."""
    r = random.Random(3)
    word = lambda: f"w{r.randrange(5000)}"
    rows = []
    for _ in range(3):
        base = [word() for _ in range(200)]
        for _ in range(120):
            text = list(base)
            for _ in range(r.choice((0, 1, 2, 3, 8, 14))):
                text[r.randrange(200)] = word()
            rows.append((len(rows), " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert kept(ngram_join.keep_one(df)) == slow_kept(df.collect())


def test_near_duplicates_of_an_empty_table(spark, empty):
    assert corpus_pipeline.drop_near_duplicates(spark, empty, "").count() == 0


def row_key(r):
    return tuple(repr(x) for x in r)


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_columns_whatever_their_names(spark, odd, clashing, k):
    """The columns that clash with helpers come through, each with its own values, and the rows are those without them."""
    stage = corpus_pipeline.STAGES[k][1]
    got, plain = stage(spark, clashing, ""), stage(spark, odd, "")
    assert got.columns == clashing.columns and plain.columns == odd.columns
    rows = [r.asDict() for r in got.collect()]
    assert sorted(map(row_key, ([r[c] for c in odd.columns] for r in rows))) == sorted(map(row_key, plain.collect()))
    assert all(r[c] == r["doc_id"] for r in rows for c in clashing.columns[len(odd.columns) :])


@pytest.mark.parametrize("k", range(4))
def test_stages_on_an_empty_table(spark, empty, k):
    found = corpus_pipeline.STAGES[k][1](spark, empty, "")
    assert found.columns == empty.columns and found.count() == 0


def test_mixing_stage_by_brute_force(spark, docs, odd):
    """Each row comes back as often as the mix takes its words, rounded half up; ``mix`` itself is held against brute
    force among the operators."""
    for df in (docs, odd.where("doc_id is not null").dropDuplicates(["doc_id"])):
        taken = {r["doc_id"]: (r["taken"], r["size"]) for r in mixing.mix(df).collect()}
        want = Counter({d: int(t / n + 0.5) for d, (t, n) in taken.items() if n and int(t / n + 0.5)})
        assert Counter(r["doc_id"] for r in corpus_pipeline.mix_sources(spark, df, "").collect()) == want


def test_classifier_stage_keeps_what_it_scores_as_good(spark, docs, odd):
    for df in (docs, odd):
        want = Counter(r["doc_id"] for r in quality_classifier.score(df).collect() if r["kept"])
        assert Counter(r["doc_id"] for r in corpus_pipeline.reject_low_quality(spark, df, "").collect()) == want


def test_encode_stage_by_the_library(spark, docs, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe._default_path())
    t.no_truncation()
    t.no_padding()
    for df in (docs, odd.where("length(text) < 1000 or text is null")):
        want = Counter()
        for r in df.collect():
            ids = t.encode(r["text"] or "", add_special_tokens=False).ids
            want[r["doc_id"], tuple(ids), t.decode(ids, skip_special_tokens=False)] += 1
        assert Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in corpus_pipeline.encode(spark, df, "").collect()) == want


def test_the_whole_pipeline(spark, odd, clashing, tmp_path):
    """``run`` over a folder gives what its stages give one after the other, with nothing written between them."""
    for name, df in (("odd", odd), ("clashing", clashing), ("none", odd.where("false"))):
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        want = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES:
            want = stage(spark, want, str(tmp_path))
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert got.columns == want.columns
        assert sorted(map(row_key, got.collect())) == sorted(map(row_key, want.collect()))
