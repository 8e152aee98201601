"""The near-duplicate stage goes through SimHash; the exact join follows."""

from __future__ import annotations

import corpus_pipeline


def test_near_duplicates_by_either(spark):
    # 1 and 2 have the same SimHash, as one shingle has the majority, and hardly a five-word shingle in common; 3 and 4 link by these
    long = [f"w{k}" for k in range(60)]
    rows = [(1, "w " * 60 + "a b c d e"), (2, "w " * 60 + "p q r s t"), (3, " ".join(long)), (4, " ".join([*long[:-1], "end"])), (5, "quite another text of a few words")]
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 5]
