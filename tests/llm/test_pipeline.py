"""The pipeline's stages, each against what it should keep of its own input."""

import re

import numpy as np
import pytest

import corpus_pipeline
from tallyhound.llm import best_fit, probminhash, queries
from test_dedup import CLASHING, near_brute, suffix_brute


def fast(a, b):
    """The exact similarity of two shingle counts by the operator's own formula, which test_dedup checks."""
    if a.keys().isdisjoint(b):
        return 0.0
    ids = {x: k for k, x in enumerate(a.keys() | b.keys())}
    sides = [sorted((ids[x], n) for x, n in c.items()) for c in (a, b)]
    return probminhash.probability_jaccard(*((np.array([k for k, _ in s]), np.array([n for _, n in s])) for s in sides))


def test_stages(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    schema, before = rows.schema, rows
    results = {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, sf).persist()
        results[name] = (before, after)
        if name != "packing":
            assert after.columns == schema.names
        before = after
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in results["quality"][1].collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in good) >= 0.97 * len(good)
    a, b = results["exact"]
    first = {}
    for r in a.orderBy("doc_id").collect():
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r.doc_id)
    assert {r.doc_id for r in b.collect()} == set(first.values())
    a, b = results["near"]
    texts = {r.doc_id: r.text for r in a.collect()}
    assert {r.doc_id for r in b.collect()} == set(near_brute(sorted(texts.items()), similar=fast).values())
    a, b = results["repeats"]
    want = suffix_brute([(r.doc_id, r.text) for r in a.collect()], 200)
    for r in b.collect():
        assert r.n_chars == len(r.text) and (want[r.doc_id][1] > 0 or len(r.text.encode()) == want[r.doc_id][0])
    a, b = results["packing"]
    whole = best_fit.tokenised_pieces(a, queries.tokenizer_path(queries.PACK_TOKENIZER))
    assert sorted(tuple(r)[:5] for r in b.collect()) == sorted(tuple(r) for r in whole.collect())
    assert corpus_pipeline.run(spark, sf).count() == b.count()


@pytest.mark.parametrize("rows", [[], CLASHING, [(None, "one text"), (None, "one text"), (None, None), (7, "one text"), (7, "another text of seven words or so")]])
def test_run_over_odd_tables(spark, tmp_path, rows):
    """Null and repeated ids, null texts and no rows at all, and a table without the columns that only some have."""
    spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, key string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # what is left: one row of each text and near class, then nothing of their texts that two of them share
    kept = {re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows}
    roots = set(near_brute(list(enumerate(sorted(kept)))).values())
    assert len({(r.doc_id, r.sequence_id, r.offset) for r in got}) == len(got) and sum(r.start == 0 for r in got) == len(roots)
