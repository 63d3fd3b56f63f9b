"""Near-dedup by ProbMinHash.

A text's ``shingle``-word shingles are weighted by how often they occur. Each shingle runs a Poisson process
whose rate is its weight and whose randomness is its hash; an arrival falls on one of the signature's
registers, which keep their earliest arrival. A shingle stops as soon as its next arrival is later than all
registers' (early termination). Two texts' registers agree with the probability Jaccard similarity of their
weighted shingles. Registers are banded; texts that share a band's bucket are candidates, and a link is
verified by the exact probability Jaccard similarity.

Links, without making a group's pairs:
1. Texts with the same weighted shingles (128 bits) are one representative.
2. Each bucket compares its members to one pivot. 1 - similarity is a metric, so a bucket is done where no
   member is left unlinked; otherwise the unlinked stay open together with those members that can still be
   within reach of one of them.
3. What is open falls into components. A component of at most ``most_docs`` documents and ``most_bytes`` of
   text is linked exactly in one task; larger ones are cut into slices, every two of which are linked exactly in
   a task, over the component or over each of its buckets, whichever has fewer pairs.
Classes are the connected components of the links. A pivot's members are dealt in slices of about ``SLICE``, and its
text travels once a slice.

Cases: a null text is empty, texts without words are one class; a text below ``shingle`` words is one shingle; every
row is a document of its own, known by a number it gets when read, so ids may be null or repeat: a class is named by its
smallest id, one without any id by a negative number; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhound.llm.components import components
from tallyhound.llm.staging import free_name, numbered, stage, trim, with_class
from tallyhound.llm.substring_dedup import BASES, WordWindows

SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 24, 5
SLICE, HOT_CLASSES = 256, 1024
#: About so many documents, at most, are linked in one task where a component is too large for one.
SLICED_DOCS = 1000
GOLD = np.uint64(0x9E3779B97F4A7C15)


def mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def weighted_shingles(texts: list[str], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document number, hash (ascending within a document) and weight of all texts' shingles."""
    codes, offsets = WordWindows(13)._hashed(texts)
    n = np.diff(offsets)
    doc = np.repeat(np.arange(len(texts)), n)
    h = WordWindows._rolled(codes[:, 0], size, BASES[0])
    at = np.flatnonzero(np.arange(len(codes)) + size <= offsets[doc + 1]) if len(codes) else np.zeros(0, "int64")
    short = np.flatnonzero((n > 0) & (n < size))
    whole = [WordWindows._rolled(codes[offsets[i] : offsets[i + 1], 0], int(n[i]), BASES[0])[0] ^ np.uint64(n[i]) for i in short]
    doc, h = np.r_[doc[at], short], np.r_[h[at], np.array(whole, "uint64")]
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])][: len(h)])
    return doc[new], h[new], np.diff(np.r_[new, len(h)])


def signatures(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, docs: int, registers: int) -> np.ndarray:
    """docs x registers: the hash of the shingle that holds each register."""
    time, holder = np.full(docs * registers, np.inf), np.zeros(docs * registers, "uint64")
    t, turn, seed = np.zeros(len(h)), 0, mixed(h)
    while len(h):
        turn += 1
        z = mixed(seed + np.uint64(turn * int(GOLD) & (1 << 64) - 1))
        t = t - np.log(((z >> np.uint64(11)).astype("float64") + 0.5) * 2.0**-53) / weight
        slot = doc * registers + ((z & np.uint64(2047)) * np.uint64(registers) >> np.uint64(11)).astype("int64")
        np.minimum.at(time, slot, t)
        won = time[slot] == t
        holder[slot[won]] = h[won]
        live = t < time.reshape(docs, registers).max(axis=1)[doc]
        doc, h, weight, t, seed = doc[live], h[live], weight[live], t[live], seed[live]
    return holder.reshape(docs, registers)


def probability_jaccard(a: tuple, b: tuple) -> float:
    """Exact, of two (hashes ascending, weights)."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(both):
        return 1.0 if not len(a[0]) and not len(b[0]) else 0.0
    x, y = a[1].astype("float64"), b[1].astype("float64")
    if x.min() == x.max() and y.min() == y.max():
        return len(both) / (len(x) + len(y) - len(both))
    only_x, only_y = x.sum() - x[i].sum(), y.sum() - y[j].sum()
    x, y = x[i], y[j]
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    # sum over all others of the larger of their ratios to this one: x's for those at or above, y's below
    above, below = x[::-1].cumsum()[::-1], y.cumsum() - y
    return float((1 / ((above + only_x) / x + (below + only_y) / y)).sum())


def signed(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """key, doc_id, f1, f2 (of the weighted shingles), bands."""
    schema = "key long, doc_id long, f1 long, f2 long, bands array<long>"

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and size < 2 << 20:
                    size += len(texts[to])
                    to += 1
                some, m = texts[at:to], to - at
                doc, h, weight = weighted_shingles(some)
                with np.errstate(over="ignore"):
                    prints = [np.zeros(m, "uint64"), np.zeros(m, "uint64")]
                    for k, p in enumerate(prints):
                        np.add.at(p, doc, mixed(h * np.uint64(2 * k + 3) + weight.astype("uint64") * GOLD))
                    held = signatures(doc, h, weight, m, bands * rows).reshape(m, bands, rows)
                    code = np.zeros((m, bands), "uint64")
                    for k in range(rows):
                        code = mixed(code * GOLD + held[:, :, k] + np.uint64(1))
                    code = mixed(code + np.arange(bands, dtype="uint64") * GOLD)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype="int32") * bands), pa.array(code.ravel().view("int64")))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, m), batch.column(1).slice(at, m), pa.array(prints[0].view("int64")), pa.array(prints[1].view("int64")), lists], names=["key", "doc_id", "f1", "f2", "bands"])
                at = to
            trim()

    return docs.select("key", "doc_id", "text").mapInArrow(sign, schema)


def distances(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """key, p, d of the distinct pairs; m: about how many members p has."""
    t = texts.select("key", "text")
    dealt = pairs.groupBy("key", "p").agg(F.max("m").alias("m"))
    dealt = dealt.withColumn("s", F.pmod(F.xxhash64("key"), F.ceil(F.col("m") / SLICE)))
    # what is joined with texts grows with the corpus, so it is never broadcast
    dealt = dealt.hint("merge")
    members = dealt.join(t, "key").select("p", "s", "key", "text")
    pivots = dealt.select(F.col("p").alias("pivot"), F.col("s").alias("slice")).distinct().hint("merge").join(t.select(F.col("key").alias("pivot"), F.col("text").alias("pivot_text")), "pivot")

    def measure(left: pa.Table, right: pa.Table) -> pa.Table:
        """left: a pivot's text, right: a slice of its members."""
        pivot, d = weighted_shingles(left.column("pivot_text").to_pylist()[:1])[1:], []
        texts = right.column("text").to_pylist()
        for at in range(0, len(texts), SLICE):
            some = texts[at : at + SLICE]
            doc, h, w = weighted_shingles(some)
            ends = np.searchsorted(doc, np.arange(len(some) + 1))
            d += [1 - probability_jaccard(pivot, (h[i:j], w[i:j])) for i, j in zip(ends, ends[1:], strict=False)]
        trim()
        return pa.table({"key": right.column("key"), "p": right.column("p"), "d": pa.array(d, pa.float64())})

    return pivots.groupBy("pivot", "slice").cogroup(members.groupBy("p", "s")).applyInArrow(measure, "key long, p long, d double")


def linked_exactly(texts: list[str], least: float, groups: list | None = None) -> list[tuple[int, int]]:
    """Links that join what is linked among a bounded list of texts; equal ``groups`` are joined already."""
    m = len(texts)
    doc, h, w = weighted_shingles(texts)
    ends = np.searchsorted(doc, np.arange(m + 1))
    n, mass, alone, own_n = np.diff(ends).astype("float64"), np.zeros(m), np.zeros(m), np.zeros(m)
    _, code, counts = np.unique(h, return_inverse=True, return_counts=True)
    # shingles that no other text has bound what can be shared
    own = counts[code] == 1
    np.add.at(mass, doc, w)
    np.add.at(alone, doc[own], w[own] / mass[doc[own]])
    np.add.at(own_n, doc[own], 1)
    plain = np.array([j > i and w[i:j].min() == w[i:j].max() for i, j in zip(ends, ends[1:], strict=False)], bool)
    root = list(range(m))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    first: dict = {}
    for i, g in enumerate(groups or []):
        if g is not None:
            root[find(i)] = find(first.setdefault(g, i))
    links, shared, slack = [], n - own_n, 1e-9
    for i in range(m - 1):
        if alone[i] > 1 - least + slack:
            continue
        rest = slice(i + 1, m)
        most = np.minimum(shared[i], shared[rest])
        may = (alone[rest] <= 1 - least + slack) & (~(plain[i] & plain[rest]) | (most >= least * (n[i] + n[rest] - most) - slack))
        for j in (np.flatnonzero(may) + i + 1).tolist():
            if find(i) != find(j) and probability_jaccard((h[ends[i] : ends[i + 1]], w[ends[i] : ends[i + 1]]), (h[ends[j] : ends[j + 1]], w[ends[j] : ends[j + 1]])) >= least - slack:
                root[find(j)] = find(i)
                links.append((i, j))
    return links


def _exact_links(rows: DataFrame, similarity: float) -> DataFrame:
    """Links inside each ``root``: rows of root, key, pivot (that the key is linked to, or null), text."""

    def link(group: pa.Table) -> pa.Table:
        group = group.sort_by("key")
        keys = group.column("key").to_pylist()
        found = linked_exactly(group.column("text").to_pylist(), similarity, group.column("pivot").to_pylist())
        return pa.table({"a": pa.array([keys[j] for _, j in found], pa.int64()), "b": pa.array([keys[i] for i, _ in found], pa.int64())})

    return rows.groupBy("root").applyInArrow(link, "a long, b long")


def _sliced_links(hard: DataFrame, texts: DataFrame, similarity: float, most_docs: int, most_bytes: int) -> DataFrame:
    """Links inside components too large for one task: root, docs (of the root), bucket, key, pivot.

    A component is one set of documents if that has fewer pairs than its buckets have together, else each bucket is a set. Sets
    are cut into slices of half a task's documents or bytes, and every two slices are linked exactly in a task of their own."""
    per = hard.groupBy("root", "docs", "bucket").agg(F.count("*").alias("m")).groupBy("root", "docs").agg(F.sum(F.col("m") * F.col("m")).alias("pairs"))
    whole = per.select("root", (F.col("docs") * F.col("docs") <= F.col("pairs")).alias("whole"))
    named = F.struct("root", "whole", F.when(F.col("whole"), F.lit(0).cast("long")).otherwise(F.col("bucket")).alias("bucket")).alias("set")
    sets = hard.join(whole, "root").select(named, "key", "pivot").groupBy("set", "key").agg(F.min("pivot").alias("pivot"))
    sets = stage(sets.hint("merge").join(texts.select("key", F.octet_length("text").alias("bytes")), "key"), "hard-sets")
    half = lambda total, most: F.ceil(2 * total / F.lit(most))
    slices = sets.groupBy("set").agg(F.least(F.count("*"), F.greatest(half(F.count("*"), most_docs), half(F.sum("bytes"), most_bytes))).alias("slices"))
    dealt = sets.join(slices, "set").withColumn("s", F.pmod(F.xxhash64("key"), F.col("slices")))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1), lambda t: (t != F.col("s")) | (F.col("slices") == 1))
    pairs = dealt.withColumn("t", F.explode(others)).select("key", "pivot", F.struct("set", F.least("s", "t").alias("s"), F.greatest("s", "t").alias("t")).alias("root"))
    return _exact_links(pairs.hint("merge").join(texts, "key").select("root", "key", "pivot", "text"), similarity)


def near_links(reps: DataFrame, docs: DataFrame, similarity: float, most_docs: int, most_bytes: int) -> DataFrame:
    """a, b: links that join what is linked. reps: key, bands of one row each; docs: key, text."""
    reach = 1 - similarity + 1e-9
    entries = reps.select("key", F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.min("key").alias("p"), F.count("*").alias("m")).filter("m > 1")
    members = stage(entries.join(shared, "bucket").select("bucket", "key", "p", "m"), "buckets")
    texts = stage(docs.join(members.select("key").distinct().hint("merge"), "key", "left_semi").select("key", "text"), "candidates")

    pairs = members.filter("key <> p")
    d = stage(distances(pairs, texts), "distances")
    links = d.filter(F.col("d") <= reach).select(F.col("key").alias("a"), F.col("p").alias("b"))

    # open: who is beyond the pivot's reach, and who may be within reach of one of those (triangle inequality)
    compared = stage(pairs.drop("m").join(d, ["key", "p"]), "compared")
    far = compared.filter(F.col("d") > reach).groupBy("bucket").agg(F.min("d").alias("least"), F.min("key").alias("head"))
    left = compared.join(far, "bucket").filter((F.col("d") > reach) | (F.col("d") >= F.col("least") - reach))
    left = stage(left.select("bucket", "key", "head", (F.col("d") > reach).alias("unlinked"), F.when(F.col("d") <= reach, F.col("p")).alias("pivot")), "open")
    if left.isEmpty():
        return links
    found = components(left.select("key", "head"), "key", "head")
    rooted = left.join(found.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    whole = rooted.groupBy("root", "key").agg(F.min("pivot").alias("pivot")).hint("merge").join(texts, "key")
    sizes = whole.groupBy("root").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    sizes = stage(sizes, "open-sizes")
    small = sizes.filter((F.col("n") > 1) & (F.col("n") <= most_docs) & (F.col("bytes") <= most_bytes)).select("root")
    links = links.unionByName(stage(_exact_links(whole.join(small, "root").select("root", "key", "pivot", "text"), similarity), "exact-links"))

    large = sizes.filter((F.col("n") > most_docs) | (F.col("bytes") > most_bytes)).select("root", F.col("n").alias("docs"))
    if not large.isEmpty():
        hard = stage(rooted.join(large, "root").select("root", "docs", "bucket", "key", "pivot"), "hard")
        links = links.unionByName(stage(_sliced_links(hard, texts, similarity, min(most_docs, SLICED_DOCS), most_bytes), "hard-links"))
    return links


def near_classes(
    docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, pivots: int | None = None, most_docs: int = 5000, most_bytes: int = 32 << 20,
    id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None,
) -> DataFrame:
    """key (a number of the row), doc_id, class_id (the smallest doc_id of the class), class_size, kept (one row of each class).
    ``pivots`` is taken but no longer used."""
    named = [F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")]
    docs = docs.select(F.col(row_col).alias("key"), *named) if row_col else numbered(docs.select(named), "near-rows", "key")
    prints = stage(signed(docs, bands, rows), "signatures")
    same = prints.groupBy("f1", "f2").agg(F.min("key").alias("rep"), F.count("*").alias("n"))
    least = max(1000, prints.count() // HOT_CLASSES)
    prints = stage(with_class(prints.withColumn("f", F.struct("f1", "f2")), stage(same.select(F.struct("f1", "f2").alias("f"), "rep", "n"), "equal-prints"), "f", "n", least).select("key", "doc_id", "rep", "bands"), "representatives")
    links = near_links(prints.filter("key = rep"), docs, similarity, most_docs, most_bytes)
    # only representatives have links; a row's class is its representative's
    roots = stage(components(links, "a", "b").withColumnRenamed("node", "rep"), "roots")
    classed = stage(prints.select("key", "doc_id", "rep").join(roots, "rep", "left").select("key", "doc_id", F.coalesce("root", "rep").alias("root")), "classes")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    sizes = stage(classed.groupBy("root").agg(first.alias("first"), F.count("*").alias("class_size")), "class-sizes")
    found = with_class(classed, sizes, "root", "class_size", least)
    return found.select("key", "doc_id", F.coalesce("first.doc_id", -1 - F.col("first.key")).alias("class_id"), "class_size", (F.col("key") == F.col("first.key")).alias("kept"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, one of each class, all their columns untouched."""
    row = free_name(docs)
    rows = numbered(docs, "near-rows", row)
    keep = near_classes(rows, id_col=id_col, text_col=text_col, row_col=row, **options).filter("kept").select(F.col("key").alias(row))
    return rows.join(keep, row, "left_semi").select(docs.columns)
