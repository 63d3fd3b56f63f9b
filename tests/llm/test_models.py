"""Packing, tokenisation, quality, language, search and WARC against brute force, round trips and held-out rows."""

import gzip
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import oracle
from tallyhound.llm import best_fit, language_id, piece_transducer, qalsh, quality_ftrl, queries, warc_revisit

WEIRD = ["", None, "a b", "Σας ΣΑΣ. x", "İstanbul, été!", "<|endoftext|> hi<|startoftext|>", "don't 'll x's ''' a'b 12 3.4", "\x01 a \x01b", "日本語 テスト。 한국", "²³ ½ x²", "a\x1cb", "q z", "́ abc ́", "x" * 5000, "\n\n a\t\tb"]
SCHEMA = "doc_id long, text string, piece int, ids string, score string, g int"


def docs(spark, texts):
    return spark.createDataFrame([(k if k % 7 else None, t, 1, "i", "s", 2) for k, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def prose(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_sql_of_queries(spark, sf):
    db = oracle.views(sf)
    for name, sql in queries.oracle_sql().items():
        assert not oracle.difference(queries.queries()[name](spark, sf), sql, db), name


def test_pieces_and_packing(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path(queries.PACK_TOKENIZER)
    t = Tokenizer.from_file(path)
    texts = WEIRD + ["word " * n for n in (1, 40, 63, 64, 200)]
    rows = best_fit.pack_documents(docs(spark, texts), path, 64).collect()
    want = []
    for k, x in enumerate(texts):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(k if k % 7 else None, j // 64, j, len(ids[j : j + 64]), zlib.crc32(ids[j : j + 64].tobytes())) for j in range(0, len(ids), 64)]
    assert sorted((repr(tuple(r)[:5]) for r in rows)) == sorted(map(repr, want))
    used = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used.get(r.sequence_id, 0)
        used[r.sequence_id] = r.offset + r.length
    assert max(used.values()) <= 64
    assert best_fit.pack_documents(docs(spark, []), path).count() == 0


def test_best_two_fit_places_all_and_beats_greedy():
    rng = random.Random(0)
    for _ in range(50):
        lengths = [rng.randint(1, 100) for _ in range(rng.randint(0, 200))]
        bins = best_fit.best_two_fit(lengths, 100)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
        assert all(sum(lengths[i] for i in b) <= 100 for b in bins)
        assert len(bins) <= -(-sum(lengths) // 100) * 1.12 + 2
    # greedy puts 6 with 3 and leaves a gap; 6 with 2 and 2 has none
    assert sorted(sorted(b) for b in best_fit.best_two_fit([6, 3, 2, 2], 10)) == [[0, 2, 3], [1]]


def test_quality_held_out(spark, sf):
    d, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    weights = quality_ftrl.fit(d, labels)
    got = quality_ftrl.score(d, weights).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) / len(got) >= 0.9
    assert {r.predicted for r in got if r.quality == 1} == {1}
    kept = quality_ftrl.keep_good(d, weights)
    assert kept.columns == d.columns and kept.count() == quality_ftrl.score(d, weights).filter("predicted = 1").count()


def test_ftrl_matches_a_plain_one():
    """The same updates over dense vectors, one coordinate at a time."""
    rng, bits = random.Random(2), 4
    rows = []
    for _ in range(40):
        slots = sorted(rng.sample(range(16), rng.randint(0, 6)))
        rows.append((np.array(slots, "int64"), np.array([rng.random() for _ in slots], "float32"), rng.randint(0, 1)))
    alpha, beta, l1, l2 = 0.5, 1.0, 0.02, 1e-4
    z, n = [0.0] * 17, [0.0] * 17

    def weight(k):
        if abs(z[k]) <= l1:
            return 0.0
        return -(z[k] - (l1 if z[k] > 0 else -l1)) / ((beta + n[k] ** 0.5) / alpha + l2)

    for epoch in range(3):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            x = [0.0] * 16 + [1.0]
            for s, v in zip(rows[k][0], rows[k][1], strict=True):
                x[s] = float(v)
            p = 1 / (1 + np.exp(-sum(weight(j) * x[j] for j in range(17))))
            steps = []
            for j in range(17):
                g = (p - rows[k][2]) * x[j]
                steps.append((j, g, ((n[j] + g * g) ** 0.5 - n[j] ** 0.5) / alpha, weight(j)))
            for j, g, sigma, w in steps:
                z[j] += g - sigma * w
                n[j] += g * g
    assert np.allclose(quality_ftrl.train_ftrl(rows, bits, epochs=3), [weight(k) for k in range(17)], atol=1e-5)


def test_mixture_matches_a_plain_one():
    """The same growth of the set, with a long expectation-maximisation for every possible next language."""
    rng = np.random.default_rng(4)
    likelihood = rng.dirichlet(np.full(30, 0.2), 4) + 1e-4
    likelihood /= likelihood.sum(axis=1, keepdims=True)
    for shares in ([1, 0, 0, 0], [0.5, 0.5, 0, 0], [0.4, 0.3, 0.3, 0], [0, 0, 0.8, 0.2]):
        counts = rng.multinomial(3000, np.array(shares) @ likelihood).astype("float64")
        got = language_id.mixture(np.log(likelihood), counts, rounds=200)
        best, price = None, 4.0 * np.log(counts.sum() + 1)
        chosen: list[int] = []
        while len(chosen) < 4:
            tried = []
            for k in set(range(4)) - set(chosen):
                some, pi = likelihood[[*chosen, k]], np.full(len(chosen) + 1, 1 / (len(chosen) + 1))
                for _ in range(500):
                    joint = pi[:, None] * some
                    pi = (joint / joint.sum(axis=0)) @ counts / counts.sum()
                tried.append((float(np.log(pi @ some) @ counts), k, pi))
            value, k, pi = max(tried, key=lambda x: x[0])
            if best is not None and value - best[0] <= price:
                break
            chosen.append(k)
            best = (value, dict(zip(chosen, pi.tolist(), strict=True)))
        assert set(got) == set(best[1]) and all(got[k] == pytest.approx(v, abs=0.01) for k, v in best[1].items())
        assert {k for k, v in enumerate(shares) if v} == set(got)


def test_quality_odd_rows(spark):
    none = spark.createDataFrame([(1, None)], "doc_id long, quality int")
    weights = quality_ftrl.fit(docs(spark, WEIRD), none)
    got = quality_ftrl.score(docs(spark, WEIRD), weights).collect()
    assert len(got) == len(WEIRD) and {r.score for r in got} == {0.5} and {r.held_out for r in got if r.doc_id is None} == {False}
    assert quality_ftrl.score(docs(spark, []), weights).count() == 0


def test_language_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.predict(d, *language_id.fit(d)).join(d.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in got) / len(got) >= 0.98


def test_language_mixture_and_odd_rows(spark, prose):
    langs, logs = language_id.fit(prose)
    texts = {lang: prose.filter(f"lang = '{lang}'").orderBy("doc_id").first().text[:800] for lang in langs[:2]}
    rows = spark.createDataFrame([(0, " ".join(texts.values()), "x"), (1, None, "x"), (2, " 12 ! ½ ² ①", "x"), (None, texts[langs[0]], "x")], "doc_id long, text string, lang_pred string")
    got = {r.doc_id: r for r in language_id.predict(rows, langs, logs).collect()}
    assert {x.split(":")[0] for x in got[0].languages.split(",")} == set(langs[:2])
    assert got[1].lang_pred == got[2].lang_pred == "und" and got[None].lang_pred == langs[0]
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language_id.predict(rows, *language_id.fit(empty)).filter("lang_pred <> 'und'").count() == 0


def test_piece_transducer_matches_the_library(spark, prose):
    import sentencepiece

    path = queries.tokenizer_path(queries.PIECE_MODEL)
    t, sp = piece_transducer.PieceTransducer(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(0)
    pieces = list(t.ids)
    texts = [x or "" for x in WEIRD] + ["".join(rng.choice(pieces) for _ in range(9)).replace("▁", " ") for _ in range(1500)] + ["".join(rng.choice("abcdeinrst .,") for _ in range(30)) for _ in range(1500)] + ["  a  b ", " ", "▁x ▁", "𝄞"]
    texts += [r.text for r in prose.limit(60).collect()]
    for x in texts:
        ids = t.encode(x)
        assert ids.tolist() == sp.encode(x), x
        assert t.decode(ids) == sp.decode(sp.encode(x))
    assert [x.tolist() for x in t.ids_of(pa.array(texts))] == sp.encode(texts)
    coded = piece_transducer.encode_documents(docs(spark, texts[:40]), path)
    assert {r.text for r in piece_transducer.decode_ids(coded, path).collect()} == {x.replace("▁", " ") for x in texts[:40]}
    got = piece_transducer.round_trip(docs(spark, WEIRD), path).collect()
    assert len(got) == len(WEIRD) and all(r.same for r in got)


def message(*fields):
    """A protocol buffer message of (number, value): texts, bytes, floats and whole numbers."""

    def number(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    out = b""
    for key, value in fields:
        if isinstance(value, float):
            out += number(key << 3 | 5) + struct.pack("<f", value)
        elif isinstance(value, int):
            out += number(key << 3) + number(value)
        else:
            raw = value.encode() if isinstance(value, str) else value
            out += number(key << 3 | 2) + number(len(raw)) + raw
    return out


def character_map(rules):
    """A double array of the rules' keys, each node's children where they all fit."""
    texts, places = b"", {}
    for value in rules.values():
        places[value] = len(texts)
        texts += value.encode() + b"\0"
    trie = {}
    for key, value in rules.items():
        node = trie
        for b in key.encode():
            node = node.setdefault(b, {})
        node[-1] = places[value]
    units, used = [0] * 4096, {0}

    def place(node, at):
        labels = [0 if b == -1 else b for b in node]
        base = next(k for k in range(1, 4000) if all(k ^ b not in used and k ^ b < 4096 for b in labels) and k ^ at)
        used.update(base ^ b for b in labels)
        units[at] |= (base ^ at) << 10 | (256 if -1 in node else 0)
        for b, child in node.items():
            if b == -1:
                units[base] = child | 1 << 31
            else:
                units[base ^ b] = b
                place(child, base ^ b)

    place(trie, 0)
    raw = struct.pack("<4096I", *units)
    return struct.pack("<I", len(raw)) + raw + texts


def unigram_model(rules, bytes_too, trims):
    rng = random.Random(5)
    texts = ["▁", "▁a", "▁ab", "a", "b", "c", "ab", "ba", "abc", "bca", "▁c", "cab", "é", "fi", "aa", "ca"]
    pieces = [message((1, "<unk>"), (2, 0.0), (3, 2)), message((1, "<s>"), (2, 0.0), (3, 3)), message((1, "</s>"), (2, 0.0), (3, 3))]
    pieces += [message((1, f"<0x{k:02X}>"), (2, 0.0), (3, 6)) for k in range(256)] if bytes_too else []
    pieces += [message((1, "<give>"), (2, 0.0), (3, 4))]
    pieces += [message((1, t), (2, -1.0 - 9 * rng.random()), (3, 1)) for t in texts]
    trainer = message((3, 1), (35, int(bytes_too)), (40, 0), (41, 1), (42, 2))
    normal = message((1, "own"), (2, character_map(rules) if rules else b""), (3, 1), (4, int(trims)), (5, 1))
    return b"".join(message((1, p)) for p in pieces) + message((2, trainer), (3, normal))


@pytest.mark.parametrize(("rules", "bytes_too", "trims"), [({}, True, False), ({}, False, True), ({"A": "a", "ﬁ": "fi", "e\u0301": "é", "\t": " ", "B": "b", "\u00a0": " ", "x": ""}, True, True), ({"AB": "abc", "A": "a"}, False, True)])
def test_unigram_models_and_normalisers_match_the_library(rules, bytes_too, trims):
    import sentencepiece

    model = unigram_model(rules, bytes_too, trims)
    t, sp = piece_transducer.PieceTransducer(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    rng = random.Random(1)
    texts = ["", " ", "abcab", "  ab  c ", "ABab", "a<give>b", "zz a", "ﬁe\u0301x"] + ["".join(rng.choices("abcABx é\t\u00a0zﬁ", k=rng.randint(1, 25))) for _ in range(600)]
    for x in texts:
        assert t.encode(x).tolist() == sp.encode(x), x
        assert t.decode(t.encode(x)) == sp.decode(sp.encode(x)), x


def test_nearest_recall_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(3000, 16)) + rng.integers(0, 4, (3000, 1)) * 2).astype("float32")
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(3100, None, 0), (3200, [0.0] * 16, 0), (3300, [float("nan")] * 16, 0), (3400, [None] * 16, 0), (None, [1.0] * 16, 0), (3500, [1.0, 2.0], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = qalsh.nearest(frame, block_rows=700).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == {k for k in range(0, 3000, 100)}
    hits = 0
    for q, found in by.items():
        d = np.sqrt(((x.astype("float64") - x[q].astype("float64")) ** 2).sum(axis=1))
        d[q] = np.inf
        best = np.lexsort((np.arange(3000), d))[:10]
        hits += len(set(best.tolist()) & {r.vec_id for r in found})
        assert [r.rank for r in found] == list(range(1, 11)) and all(r.score == pytest.approx(d[r.vec_id]) for r in found)
    assert hits / (10 * len(by)) >= 0.9
    few = spark.createDataFrame([(0, [1.0], 0), (1, [3.0], 0), (2, [3.0], 0)], "vec_id long, embedding array<float>, rank int")
    few = few.withColumn("embedding", few.embedding)
    assert [(r.rank, r.vec_id, r.score) for r in qalsh.nearest(few).orderBy("rank").collect()] == [(1, 1, 2.0), (2, 2, 2.0)]
    assert qalsh.nearest(few.filter("vec_id < 0")).count() == 0


def test_nearest_of_whole_table(spark):
    """Recall against brute force, distances as the contract has them, over slices and several cells."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    ids, x = map(np.array, zip(*[(r.vec_id, r.embedding) for r in table.collect()], strict=True))
    x = x.astype("float64")
    got = qalsh.nearest(table, block_rows=600, slice_rows=20).collect()
    hits = 0
    for q in ids[ids % 100 == 0].tolist():
        d = np.sqrt(np.square(x - x[ids == q]).sum(axis=1))
        d[ids == q] = np.inf
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 11)) and mine == sorted(mine, key=lambda r: (r.score, r.vec_id))
        assert all(r.score == pytest.approx(d[ids == r.vec_id][0], abs=1e-12) for r in mine)
        hits += len({r.vec_id for r in mine} & set(ids[np.lexsort((ids, d))[:10]].tolist()))
    assert hits >= 9.3 * (ids % 100 == 0).sum()


def warc(kind, uri, date, status, headers, body=b""):
    http = f"HTTP/1.1 {status} X\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in headers.items()).encode() + b"\r\n" + body
    profile = "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/server-not-modified\r\n" if kind == "revisit" else ""
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {uri}\r\nWARC-Date: {date}\r\nWARC-Record-ID: <{date}>\r\n{profile}Content-Type: application/http\r\nContent-Length: {len(http)}\r\n\r\n"
    return head.encode() + http + b"\r\n\r\n"


def test_warc_files_and_revisits(spark, tmp_path):
    a = warc("response", "http://www.Ex.org:80/p/?b=2&a=1&utm_x=3#f", "2024-01-01T00:00:00Z", 200, {"ETag": '"v1"', "Content-Type": "text/html", "Set-Cookie": "s"}, b"<p>one")
    b = warc("revisit", "https://ex.org/p?a=1&b=2", "2024-01-02T00:00:00Z", 304, {"ETag": 'W/"v1"', "Cache-Control": "max-age=1", "Content-Type": "no", "Set-Cookie": "t"})
    c = warc("revisit", "https://ex.org/p?a=1&b=2", "2024-01-03T00:00:00Z", 304, {"ETag": '"v2"'})
    d = warc("revisit", "https://other.org/", "2024-01-04T00:00:00Z", 304, {})
    (tmp_path / "x.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in (a, b)))
    (tmp_path / "y.warc").write_bytes(c + d)
    records = warc_revisit.read_warc(spark, str(tmp_path))
    got = {r.id: r for r in warc_revisit.resolve_revisits(warc_revisit.captures_of(records), range_rows=1).collect()}
    one, two = got["<2024-01-01T00:00:00Z>"], got["<2024-01-02T00:00:00Z>"]
    assert one.canonical_url == two.canonical_url == "ex.org/p?a=1&b=2" and two.resolved_id == one.id and two.resolved_digest == one.resolved_digest
    assert two.merged_headers == {"etag": 'W/"v1"', "cache-control": "max-age=1", "content-type": "text/html", "set-cookie": "s"}
    assert sorted(r.status for r in got.values()) == ["mismatch", "orphan", "resolved", "response"]


def test_broken_warc_files(spark, tmp_path):
    good = warc("response", "http://a.org/", "2024-01-01T00:00:00Z", 200, {"Transfer-Encoding": "chunked"}, b"3\r\nabc\r\n2;x\r\nde\r\n0\r\n\r\n")
    bad = good.replace(b"Content-Length: ", b"Content-Length: abc")
    part, moved = warc("response", "http://b.org/", "2024-01-02T00:00:00Z", 206, {}, b"x"), warc("response", "http://b.org/", "2024-01-03T00:00:00Z", 503, {}, b"x")
    (tmp_path / "a.warc").write_bytes(bad + good + part + moved)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(good) + gzip.compress(good)[:-40])
    (tmp_path / "c.warc").write_bytes(good + good[:-30])
    (tmp_path / "d.warc").write_bytes(b"")
    records = warc_revisit.read_warc(spark, str(tmp_path)).collect()
    assert sorted(r.file[-6:] for r in records) == ["a.warc", "a.warc", "a.warc", "arc.gz", "c.warc"]
    assert {r.payload for r in records if r.uri == "http://a.org/"} == {b"abcde"}
    captures = warc_revisit.captures_of(warc_revisit.read_warc(spark, str(tmp_path)))
    assert {r.url for r in captures.collect()} == {"http://a.org/"}


def test_packing_of_null_and_repeated_ids_is_dealt(spark):
    rows = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), (F.col("id") % 50 + 1).alias("length"), F.lit(1).cast("long").alias("ids_crc32"))
    groups = [r["n"] for r in best_fit.pack(rows, 64, group_rows=500).groupBy(F.shiftright("sequence_id", 32)).agg(F.count("*").alias("n")).collect()]
    assert sum(groups) == 3000 and len(groups) == 6 and max(groups) < 800


def test_warc_odd_rows(spark):
    schema = "id long, url string, ts timestamp, is_revisit boolean, etag string, modified string, digest string, headers map<string,string>, status string, range int"
    rows = [(1, None, None, False, None, None, None, None, "s", 1), (2, None, None, True, None, None, None, None, "s", 1), (3, "", None, None, None, None, "d", {}, "s", 1), (4, "", None, True, None, None, None, {}, "s", 1), (4, "", None, True, None, None, None, {}, "s", 1)]
    got = warc_revisit.resolve_revisits(spark.createDataFrame(rows, schema)).orderBy("id").collect()
    assert [(r.id, r.status) for r in got] == [(1, "response"), (2, "orphan"), (3, "response"), (4, "unchecked"), (4, "unchecked")] and got[3].resolved_id == 3
    assert warc_revisit.resolve_revisits(spark.createDataFrame([], schema)).count() == 0


def test_packed_ids_of_every_letter_before_every_kind_of_mark():
    """Letters that change under normalisation too, in the middle of a word and at its end, and words at random."""
    import unicodedata

    from tokenizers import Tokenizer

    path = queries.tokenizer_path(queries.PACK_TOKENIZER)
    t, rng = Tokenizer.from_file(path), random.Random(4)
    letters = [c for c in map(chr, range(0x30000)) if unicodedata.category(c)[0] == "L"]
    marks = [".", "'s", "́", "̇.", "!?", "1", "’", "-x"]
    texts = [" ".join(f"{c}{m} a{c}{m}" for c in letters[k : k + 500]) for m in marks for k in range(0, len(letters), 500)]
    every = "aZéİßıŉǰΣςσक़ড়̧̇́.,'!-’ \n1²½日"
    texts += ["".join(rng.choices(every, k=rng.randint(1, 40))) for _ in range(10_000)] + ["Dr. İ. Yılmaz", "İ.", "x" * 300_000 + "İ. " + "ab. " * 100_000]
    words = best_fit.WordEncoder(path)
    want = t.encode_batch_fast(texts, add_special_tokens=False)
    got = [ids for some in best_fit.runs_of(pa.array(texts)) for ids in words.ids(some)]
    bad = [x for x, g, w in zip(texts, got, want, strict=True) if g != np.asarray(w.ids, "<u4").tobytes()]
    assert not bad, bad[:3]


def test_nearest_of_equal_vectors_over_many_blocks(spark):
    """300 equal vectors in blocks of 64: the smallest ids win. Others further off, equal too, fill up what is left."""
    rng = np.random.default_rng(7)
    one, two = rng.standard_normal((2, 48))
    rows = [(k, one.tolist()) for k in range(300)] + [(k, two.tolist()) for k in range(1000, 1004)] + [(k, (two + 1e-9).tolist()) for k in range(1004, 1300)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(9)
    got = {}
    for r in qalsh.nearest(frame, block_rows=64).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert [i for i, _ in got[200]] == list(range(10)) and [i for i, _ in got[0]] == list(range(1, 11)) and {d for _, d in got[100]} == {0.0}
    assert [i for i, _ in got[1000]] == [1001, 1002, 1003, *range(1004, 1011)]


def test_nearest_of_repeated_ids_and_extreme_values(spark):
    rows = [(0, [1.0, 0.0]), (0, [5.0, 0.0]), (7, [1.5, 0.0]), (7, [4.5, 0.0])]
    got = [tuple(r) for r in qalsh.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=2).orderBy("score", "query_id", "rank").collect()]
    assert got == [(0, 1, 7, 0.5), (0, 1, 7, 0.5), (0, 2, 7, 3.5), (0, 2, 7, 3.5)]
    rows = [(0, [1e200, 0.0]), (1, [3e200, 0.0]), (2, [1e200, 1e190]), (100, [1e-200, 0.0]), (101, [4e-200, 0.0])]
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in qalsh.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=2).collect()}
    assert got[0, 1] == (2, pytest.approx(1e190)) and got[0, 2][1] == pytest.approx(1e200)
    got = [tuple(r) for r in qalsh.nearest(spark.createDataFrame(rows[3:], "vec_id long, embedding array<double>"), k=2).collect()]
    assert got == [(100, 1, 101, pytest.approx(3e-200))]


def test_blocks_are_copied_only_for_slices_of_visitors(spark):
    rng = np.random.default_rng(1)
    rows = [(k * 100, rng.standard_normal(8).tolist()) for k in range(400)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    few, many = (sorted(map(tuple, qalsh.nearest(frame, block_rows=50, slice_rows=s, threshold=0.0).collect())) for s in (32_768, 30))
    x = np.array([v for _, v in rows])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    want = sorted((100 * i, r, 100 * int(j)) for i in range(400) for r, j in enumerate(np.argsort(d[i], kind="stable")[:10], 1))
    assert [t[:3] for t in few] == [t[:3] for t in many] == want


def test_labels_that_repeat_or_differ(spark):
    """The order of labels doesn't matter, and a labelled id that many rows share sends no more than the sample to training."""
    text = lambda k: " ".join(f"w{(k * j) % 17}" for j in range(1, 30))
    docs = spark.createDataFrame([(k, text(k)) for k in range(40)] + [(3, text(100 + k)) for k in range(200)], "doc_id long, text string")
    labels = [(k, k % 2) for k in range(40)] + [(5, 0), (5, 0), (6, 1), (7, None), (None, 1)]
    fits = [quality_ftrl.fit(docs, spark.createDataFrame(x, "doc_id long, quality int").coalesce(1), sample=60) for x in (labels, labels[::-1])]
    assert (fits[0] == fits[1]).all() and fits[0].any()


def test_languages_of_null_and_repeated_ids_are_learnt(spark):
    french = [(None, "fr", f"le chat numero {k} est noir et le chien dort") for k in range(50)] + [(1, "de", "der Hund und die Katze schlafen")] * 50
    docs = spark.createDataFrame(french + [(k, "en", f"the cat {k} is black and the dog sleeps") for k in range(50)], "doc_id long, lang string, text string")
    langs, _ = language_id.fit(docs, per_lang=10)
    assert langs == ["de", "en", "fr"]
    long = docs.limit(1).selectExpr("doc_id", "lang", "repeat(text, 20000) AS text")
    assert language_id.predict(long, *language_id.fit(docs)).first().lang_pred == "fr"
