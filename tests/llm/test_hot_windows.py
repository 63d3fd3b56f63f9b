"""Hot anchors on both sides of a chunk's border."""

import random

from tallyhound.llm import repeats, suffix_dedup


def test_windows_at_a_border_count_once(spark):
    rng = random.Random(1)
    letters = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    passage = letters(199)  # its anchors repeat, no string of 200 bytes does
    rows = [(1, letters(repeats.CHUNK - 100) + passage + letters(400)), (2, letters(300) + passage + letters(300))]
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 200, hot_least=1).collect()
    assert {r.doc_id: r.n_removed for r in got} == {1: 0, 2: 0}
