"""Exact, near, suffix-array and substring dedup against brute force, and their odd cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallyhound.llm import components, exact_dedup, probminhash, repeats, substring_dedup, suffix_dedup

#: Extra columns whose names clash with what the operators use inside.
SCHEMA = "doc_id long, text string, key string, b int, t string, kept string, digest string, root long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "k", 1, "t", "x", "d", 2) for i, t in rows], SCHEMA)


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6)))
    passage = " ".join(word() for _ in range(70))
    rows = []
    for i in range(n):
        t = " ".join(word() for _ in range(rng.randint(0, 150)))
        kind = rng.random()
        if kind < 0.25:
            t += " " + passage + " " + word()
        elif kind < 0.4 and rows:
            t = rng.choice(rows)[1]
        elif kind < 0.5 and rows:
            w = (rng.choice(rows)[1] or "").split()
            t = " ".join(word() if rng.random() < 0.02 else x for x in w)
        elif kind < 0.55:
            t = "la la\tla \n" * rng.randint(1, 60)
        rows.append((i, t))
    return rows


ODD = [(100, None), (101, ""), (102, " \t\n "), (None, "lone text"), (None, "lone text"), (103, "x" * 3000), (103, "x" * 3000), (104, "é" * 400), (105, None)]


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_exact_classes(spark):
    rows = corpus(1) + [(i, t) for i, t in ODD if i is not None and i != 103]
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in rows}
    groups = defaultdict(list)
    for i, t in norm.items():
        groups[t].append(i)
    got = {r.id: r for r in exact_dedup.exact_classes(docs(spark, rows), hot_least=3).collect()}
    assert len(got) == len(rows)
    for i, t in norm.items():
        assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].digest) == (min(groups[t]), len(groups[t]), min(groups[t]) == i, sha(t.encode()))


def test_exact_survives_digest_collisions(spark):
    rows = corpus(2)
    weak = lambda c: F.pmod(F.crc32(c), F.lit(3)).cast("string")
    a = {r.id: (r.keep_id, r.group_size) for r in exact_dedup.exact_classes(docs(spark, rows), digest=weak, hot_least=3).collect()}
    b = {r.id: (r.keep_id, r.group_size) for r in exact_dedup.exact_classes(docs(spark, rows)).collect()}
    assert a == b


def test_exact_null_ids_and_filter(spark):
    got = exact_dedup.exact_classes(docs(spark, ODD)).collect()
    assert len(got) == len(ODD) and [r.kept for r in got if r.id is None] == [True, True]
    kept = exact_dedup.exact_dedup(docs(spark, corpus(3)))
    assert kept.columns == docs(spark, []).columns
    texts = [re.sub(r"\s+", " ", r.text or "") for r in kept.collect()]
    assert len(texts) == len(set(texts))
    assert exact_dedup.exact_classes(docs(spark, [])).count() == 0


def test_exact_dedup_decides_on_rows(spark):
    rows = [(0, "c  d"), (1, "a b"), (1, "c d"), (5, "z"), (5, "z"), (None, "n"), (None, "n"), (None, "z"), (7, None), (8, "")]
    kept = exact_dedup.exact_dedup(docs(spark, rows)).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted([(0, "c  d"), (1, "a b"), (5, "z"), (None, "n"), (7, None)], key=repr)
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0


def suffix_brute_rows(rows, n):
    """(id, bytes, removed, spans, sha) of every row, rows in their order."""
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(b[k : k + n] for b in raw for k in range(len(b) - n + 1))
    out = []
    for (i, _), b in zip(rows, raw, strict=True):
        gone = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if seen[b[k : k + n]] > 1:
                gone[k : k + n] = b"\1" * n
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return out


def suffix_brute(rows, n):
    return {r[0]: r[1:] for r in suffix_brute_rows(rows, n)}


@pytest.mark.parametrize(("seed", "bucket", "hot"), [(1, 9, 20_000), (2, None, 20_000), (3, 9, 1)])
def test_suffix_dedup(spark, seed, bucket, hot):
    rows = corpus(seed) + [r for r in ODD if r[0] is not None and r[0] != 103]
    got = suffix_dedup.suffix_dedup(docs(spark, rows), 200, buckets=bucket, hot_least=hot).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == suffix_brute(rows, 200)


def test_suffix_hot_anchors(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BUNDLE_BYTES", 3000)
    rows = corpus(4)
    got = suffix_dedup.suffix_dedup(docs(spark, rows), 200, buckets=5, hot_least=1).collect()
    assert {r.doc_id: r.kept_sha256 for r in got} == {i: x[3] for i, x in suffix_brute(rows, 200).items()}


def test_column_wise_rounds(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    blocks = rng.integers(97, 99, (40, 30), dtype="uint8")
    got = suffix_dedup.column_wise(blocks, 6)
    for k in range(25):
        same = Counter(blocks[i, k : k + 6].tobytes() for i in range(40))
        assert [same[blocks[i, k : k + 6].tobytes()] > 1 for i in range(40)] == got[:, k].tolist()


def test_long_texts_are_cut_at_chunks(spark, monkeypatch):
    rng = random.Random(7)
    letters = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = letters(900)
    rows = [(1, letters(1_200_000) + shared + letters(300)), (2, letters(700_000) + shared)]
    got = {r.doc_id: r.n_removed for r in suffix_dedup.suffix_dedup(docs(spark, rows)).collect()}
    assert got == {1: 900, 2: 900}


def substring_brute_rows(rows, n):
    """(id, words, removed, sha) of every row; null ids come first, rows that share an id in their order."""
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            x = tuple(w[k : k + n])
            if x in seen:
                gone[k : k + n] = [True] * n
            seen.add(x)
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode())))
    return out


def substring_brute(rows, n):
    return {r[0]: r[1:] for r in substring_brute_rows(rows, n)}


@pytest.mark.parametrize(("seed", "window", "bucket"), [(1, 20, 9), (2, 20, None), (3, 13, 9)])
def test_substring_dedup(spark, seed, window, bucket):
    rows = corpus(seed) + [r for r in ODD if r[0] is not None and r[0] != 103] + [(200, "a\x1cb c\x85d " * 30), (201, "a\x1cb c\x85d " * 30)]
    got = substring_dedup.substring_dedup(docs(spark, rows), window, buckets=bucket).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == substring_brute(rows, window)


def words(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))


#: Ids that repeat with the same, a shorter and a longer text; null ids with and without copies; long rows.
CLASHING = [(1, words(1, 90)), (2, words(2, 120) + " " + words(1, 60)), (2, "short"), (2, words(3, 400)), (3, words(4, 150)), (3, words(4, 150)), (None, words(5, 80)), (None, words(5, 80)), (None, words(6, 80)), (4, None), (4, ""), (5, words(1, 90) + " " + words(7, 5)), (3, words(4, 150))]


@pytest.mark.parametrize("bundle", [1, 2000, 8 << 20])
def test_repeats_of_clashing_ids(spark, monkeypatch, bundle):
    monkeypatch.setattr(repeats, "BUNDLE_BYTES", bundle)
    frame = docs(spark, CLASHING).coalesce(1)
    got = suffix_dedup.suffix_dedup(frame).collect()
    assert sorted(map(repr, ((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got))) == sorted(map(repr, suffix_brute_rows(CLASHING, 200)))
    got = substring_dedup.substring_dedup(frame).collect()
    assert sorted(map(repr, ((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got))) == sorted(map(repr, substring_brute_rows(CLASHING, 20)))
    kept = [(r.doc_id, sha((r.text or "").encode())) for r in suffix_dedup.cut_repeats(frame).collect()]
    assert sorted(map(repr, kept)) == sorted(repr((r[0], r[4])) for r in suffix_brute_rows(CLASHING, 200))


def test_repeats_odd_rows(spark):
    for f in (suffix_dedup.suffix_dedup, substring_dedup.substring_dedup):
        got = f(docs(spark, ODD)).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i is None, i or 0) for i, _ in ODD)
        assert f(docs(spark, [])).count() == 0
    twice = [(1, " ".join(str(k) for k in range(99)))] * 2
    assert {r.n_removed for r in suffix_dedup.suffix_dedup(docs(spark, twice)).collect()} == {len(twice[0][1])}
    with pytest.raises(ValueError, match="13"):
        substring_dedup.WordWindows(12)


@pytest.mark.parametrize("level", ["sf0.001", "sf0.01"])
def test_repeats_of_whole_tables(spark, level):
    table = spark.read.parquet(f"/root/testdata/{level}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in table.collect()]
    got = suffix_dedup.suffix_dedup(table).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == suffix_brute(rows, 200)
    got = substring_dedup.substring_dedup(table).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == substring_brute(rows, 20)


def test_cut_repeats_keeps_columns(spark):
    rows = corpus(5) + ODD
    out = suffix_dedup.cut_repeats(docs(spark, rows))
    assert out.columns == docs(spark, []).columns and out.count() == len(rows)


def test_components(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(50)] + [(100, 101), (103, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components.components(e, "a", "b").collect()}
    assert got == {k: 0 for k in range(1, 51)} | {101: 100, 103: 100}


def shingles(t):
    w = (t or "").split()
    return Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def brute_jp(a, b):
    return sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in set(a) | set(b)) for d in set(a) & set(b))


def near_brute(rows, least=0.8, similar=brute_jp):
    s = {i: shingles(t) for i, t in rows}
    root = {i: i for i in s}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in s:
        for j in s:
            if i < j and (s[i] == s[j] or similar(s[i], s[j]) >= least - 1e-9):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in s}


def near_rows(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    bases = [[word() for _ in range(120)] for _ in range(6)]
    rows = []
    for i in range(80):
        w = [word() if rng.random() < rng.choice([0, 0.01, 0.03]) else x for x in rng.choice(bases)]
        rows.append((i, " ".join(w + w[:10] * rng.choice([0, 0, 3]))))
    return rows + [(900, None), (901, ""), (902, "one two"), (903, "one  two"), (904, "two one")]


@pytest.mark.parametrize("options", [{}, {"most_docs": 1, "pivots": 3}, {"most_bytes": 10}])
def test_near_classes(spark, options):
    rows = near_rows(1)
    got = {r.doc_id: r.class_id for r in probminhash.near_classes(docs(spark, rows), **options).collect()}
    assert got == near_brute(rows)


def test_large_components_take_one_pass(spark, monkeypatch):
    """Not one pass for every so many unlinked members of the largest bucket."""
    rows, names, stage = near_rows(1), [], probminhash.stage
    monkeypatch.setattr(probminhash, "stage", lambda df, name: (names.append(name), stage(df, name))[1])
    got = {r.doc_id: r.class_id for r in probminhash.near_classes(docs(spark, rows), most_docs=4, pivots=1).collect()}
    assert got == near_brute(rows) and names.count("hard-links") == 1


def test_near_odd_rows(spark):
    assert probminhash.near_classes(docs(spark, [])).count() == 0
    got = probminhash.near_classes(docs(spark, ODD)).collect()
    assert len(got) == len(ODD)
    assert {r.class_id for r in got if r.doc_id in (100, 101, 102, 105)} == {100}
    kept = probminhash.near_dedup(docs(spark, near_rows(2)))
    assert kept.columns == docs(spark, []).columns and kept.count() == len(set(near_brute(near_rows(2)).values()))


def test_probability_jaccard_and_its_estimate():
    import numpy as np

    rng = random.Random(3)
    for _ in range(30):
        a, b = (Counter(rng.choices(range(12), k=rng.randint(1, 30))) for _ in range(2))
        x, y = ((np.array(sorted(c), "uint64"), np.array([c[k] for k in sorted(c)])) for c in (a, b))
        assert probminhash.probability_jaccard(x, y) == pytest.approx(brute_jp(a, b))
    h = np.arange(300, dtype="uint64") * probminhash.GOLD
    doc = np.r_[np.zeros(200, "int64"), np.ones(200, "int64")]
    s = probminhash.signatures(doc, np.r_[h[:200], h[50:250]], np.ones(400), 2, 2000)
    assert (s[0] == s[1]).mean() == pytest.approx(150 / 250, abs=0.04)


def test_stages_leave_columns_of_any_name_alone(spark):
    names = ["__row", "__ROW_", "row", "key", "g", "n", "t", "digest", "win", "salt"]
    rows = [(k, t, *(70 + k for _ in names)) for k, t in enumerate(["a b c d e f"] * 3 + ["one two three four five six seven", None, ""])]
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{x}` long" for x in names))
        for stage in (exact_dedup.exact_dedup, probminhash.near_dedup):
            got = stage(docs).collect()
            assert len(got) in (3, 4) and all(r[x] == 70 + r.doc_id for r in got for x in names)
    finally:
        spark.conf.unset("spark.sql.caseSensitive")
