"""Ranked search, token files and vector codes against brute force, the tokenizer and exact arithmetic."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyhound.llm import exponion, queries, tiered_search, token_files

WEIRD = ["", None, "a b", "  lead", "trail  ", "a  b\n\nc \t d", "it 's don't 'll x's", "<|endoftext|> hi <|endoftext|>  b", "日本語 テスト。 한국", "a  b   c", "\x01 a \x01b", "x\x0b\x0c y", "q́ é ½", "z" * 5000, " \r\n ", "　a"]


def brute_search(docs, items, k):
    apart = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = [(d, Counter(apart.findall((t or "").translate(lower)))) for d, t in docs]
    found = [(d, c, sum(c.values())) for d, c in found if c]
    n, length, df = len(found), sum(x[2] for x in found), Counter(t for _, c, _ in found for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c, size in found:
            m = 100 - 50 + (50 * size * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(apart.findall((text or "").translate(lower))) if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(item, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def prose_like(rng, count, words, fewest=0, most=60):
    return [" ".join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=rng.randint(fewest, most))) for _ in range(count)]


@pytest.mark.parametrize("seed,k,block", [(0, 5, 200_000), (1, 3, 20), (2, 1, 200_000)])
def test_search_is_exact(spark, monkeypatch, seed, k, block):
    monkeypatch.setattr(tiered_search, "BLOCK_TERMS", block)
    rng = random.Random(seed)
    words = ["the", "Of", "AND", "x1", "été", "Ünï", "don't", "a_b", "İ"] + [f"w{j}" for j in range(60)]
    texts = prose_like(rng, 300, words) + ["", None, "...", "same same", "same same", "THE the the"]
    docs = [(j if j % 50 else None, t) for j, t in enumerate(texts)] + [(7, texts[7])]
    items = [(j, t) for j, t in enumerate(prose_like(rng, 12, words, 1, 12) + ["same", "", None, "nowhere else", "the"])] + [(3, "w3 w4"), (None, "w5")]
    frame = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, term string").repartition(5)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, row int")
    used = {}
    got = sorted((tuple(r) for r in tiered_search.search(frame, asked, k, tiers_used=used).collect()), key=repr)
    assert got == brute_search(docs, items, k)
    assert sum(used.values()) <= len(items)


def test_upper_tiers_answer_where_they_prove_it(spark):
    """A few documents hold rare terms often: their scores are out of reach for what common terms add."""
    rng = random.Random(5)
    common = [f"c{j}" for j in range(30)]
    docs = [(j, " ".join(rng.choices(common, k=200))) for j in range(400)] + [(1000 + j, "gold silver " * (9 - j)) for j in range(6)]
    items = [(1, "gold silver"), (2, "gold c1"), (3, "c1 c2 c3 c4")]
    used = {}
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = tiered_search.search(frame, spark.createDataFrame(items, "item_id long, text string"), 4, tiers_used=used)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_search(docs, items, 4)
    assert used[0] >= 1 and sum(used.values()) == 3


def test_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert tiered_search.search(docs, items).count() == 0
    assert tiered_search.search(spark.createDataFrame([(1, "a")], docs.schema), items.limit(0)).count() == 0


def test_very_large_sums_are_exact():
    keys, values = np.array([0, 0, 1]), np.array([2**61, 1, 2**53 + 1])
    assert tiered_search.exact_sums(keys, values, 2).tolist() == [2**61 + 1, 2**53 + 1]


def library_rows(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path(queries.FILE_TOKENIZER))
    start, out = 0, []
    for d, text in docs:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_files_hold_the_library_s_ids(spark):
    rng = random.Random(3)
    letters = "ab eé \n\t'’.,1½日 ́  s"
    texts = WEIRD + ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(2000)] + ["word " * 40_000]
    docs = [(None if k % 500 == 1 else k // 2 if k % 9 == 0 else 3 * k, t) for k, t in enumerate(texts)]
    frame = spark.createDataFrame([(d, t, k) for k, (d, t) in enumerate(docs)], "doc_id long, text string, start int").coalesce(1)
    read = token_files.round_trip(frame, queries.tokenizer_path(queries.FILE_TOKENIZER))
    got = read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("c")).orderBy("start").collect()
    want = library_rows(sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0)))
    assert [tuple(r) for r in got] == want
    none = token_files.round_trip(frame.limit(0), queries.tokenizer_path(queries.FILE_TOKENIZER))
    assert none.count() == 0


def test_token_files_are_flat_and_partitions_follow_each_other(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(7)
    folder = f"file://{tmp_path}/ids"
    token_files.write_token_files(docs, queries.tokenizer_path(queries.FILE_TOKENIZER), folder, files=4)
    parts = spark.read.parquet(f"{folder}/manifest").orderBy("part").collect()
    assert len(parts) > 1 and parts[0].first_token == 0 and all(a.first_token + a.tokens == b.first_token and a.first_doc + a.docs == b.first_doc for a, b in zip(parts, parts[1:], strict=False))
    flat = np.concatenate([np.memmap(tmp_path / "ids" / f"{p.name}.bin", "<u2") for p in parts]).astype("<u4")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    want = library_rows(rows)
    assert [zlib.crc32(flat[s : s + n].tobytes()) for _, s, n, _ in want] == [x[3] for x in want] and len(flat) == want[-1][1] + want[-1][2]
    (tmp_path / "ids" / f"{parts[0].name}.bin").write_bytes(b"xx")
    with pytest.raises(Exception, match="damaged"):
        token_files.read_token_files(spark, folder).count()


def test_op12_over_the_whole_table(spark, sf):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert sorted(tuple(r) for r in queries.op12_token_files(spark, sf).collect()) == sorted(library_rows(rows))


def brute_codes(rows, parts, entries, rounds, scale=256):
    """rows: (id, vector, label), all vectors of one length; exact integers throughout."""
    whole = [(i, [int(x) * scale if abs(x) >= 2.0**53 else math.floor(x * scale) for x in v], label) for i, v, label in rows]
    width = -(-len(whole[0][1]) // parts)
    cut = [[(v + [0] * (width * parts - len(v)))[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in whole]
    first = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, rows[k][1]))[:entries]
    books = [[cut[k][p] for k in first] for p in range(parts)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda: [[min((apart(c[p], e), j) for j, e in enumerate(books[p])) for p in range(parts)] for c in cut]
    for _ in range(rounds):
        found = nearest()
        for p in range(parts):
            for j in range(len(books[p])):
                mine = [cut[k][p] for k in range(len(rows)) if found[k][p][1] == j]
                if mine:
                    books[p][j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    found = nearest()
    errors, by_label = [sum(d for d, _ in f) for f in found], Counter()
    for (_, _, label), e in zip(rows, errors, strict=True):
        by_label[label] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    top = exponion.LARGEST
    return sorted(((i, "".join(f"{j:02x}" for _, j in f), min(e, top), min(by_label[label], top), sha) for (i, _, label), f, e in zip(rows, found, errors, strict=True)), key=repr)


@pytest.mark.parametrize("kind", ["normal", "lattice", "huge", "few", "odd"])
def test_codes_are_exact(spark, kind):
    rng = np.random.default_rng(len(kind))
    size, count = {"few": (8, 5), "odd": (10, 150)}.get(kind, (8, 300))
    x = rng.standard_normal((count, size)) if kind != "lattice" else rng.integers(-1, 2, (count, size)) / 256
    if kind == "huge":
        x[::7] *= 1e200
        x[1::7] *= 1e9
    rows = [(None if k % 40 == 39 else k - k % 2 if k < 20 else k, x[k].tolist(), [None, 1, 1, 2][k % 4]) for k in range(count)]
    bad = [(900, None, 1), (901, [None] * size, 1), (902, [math.nan] * size, 1), (903, [math.inf] + [0.0] * (size - 1), None), (904, [1.0], 1), (905, [], 2)]
    frame = spark.createDataFrame([(*r, "c", 5) for r in rows + bad], "vec_id long, embedding array<double>, label int, code string, n int").repartition(6)
    got = exponion.vector_codes(frame, parts=4, entries=16)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_codes(rows, 4, 16, 2)
    assert exponion.vector_codes(frame.limit(0)).count() == 0


def test_scan_is_a_prefix_of_the_neighbour_list():
    """The radius leaves entries out, and what it leaves out is never the answer."""
    rng = np.random.default_rng(0)
    book = exponion.Book(rng.integers(-500, 500, (64, 4)))
    x, start = rng.integers(-500, 500, (4000, 4)), rng.integers(0, 64, 4000)
    entry, d = book.nearest(x, start)
    full = exponion.squared(x[:, None], book.entries[None])
    assert (full.argmin(axis=1) == entry).all() and (full.min(axis=1) == d).all()
    again, _ = book.nearest(x, entry)
    scanned = (book.apart[entry] <= 4 * d[:, None]).sum()
    assert (again == entry).all() and scanned < 0.5 * len(x) * 64


def test_lists_of_no_rows():
    assert exponion.lists_of(pa.array([], pa.list_(pa.float64()))).to_pylist() == []
