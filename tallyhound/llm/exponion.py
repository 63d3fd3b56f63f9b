"""Vector codes: each vector is cut into equal parts, and a part is stored as the index of its nearest codebook entry.

Codebooks start as the parts of the vectors of the smallest ids; a round assigns all parts and replaces each entry by the floored mean of its
parts. All arithmetic is on integers, floor(scale * x), exact at any size.

Exponion search: a part starts at its entry of the round before (the first entry in the first round), at distance r. An entry
nearer than that, or as near, lies within 2r of the entry started from, so only a prefix of that entry's list of neighbours, sorted by
distance, is scanned; ties go to the lower index.

A pass is one scan: a task goes through the codebooks of all rounds so far, each round's entry being the start of the next,
and sends one row an entry, its count and sums. So vectors are never shuffled or written, and a lost task is simply run
again; codebooks, ``parts`` x ``entries`` rows, are all that the driver sees.

Cases: vectors that are null, empty or hold null or non-finite components take no part, nor do those of another length than that of the smallest
kept id; a length that ``parts`` does not divide is filled up with zeros; null ids come last, equal ones in the order of their vectors, and all
such rows are coded; fewer vectors than ``entries`` make fewer entries; unused entries stay; errors beyond 64 bits are the
largest 64-bit number; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhound.llm.qalsh import lists_of
from tallyhound.llm.staging import stage

#: Components below this give distances, and sums within a task, that fit in 64 bits.
SMALL = 1 << 24
LARGEST = (1 << 63) - 1
#: Parts that are searched at once.
AT_ONCE = 8192


def integers(x: np.ndarray, scale: int = 256) -> np.ndarray:
    """floor(scale * x), in 64 bits where all are small, else as Python's integers."""
    if x.size == 0 or np.abs(x).max() * scale < SMALL:
        return np.floor(x * scale).astype("int64")
    exact = [int(v) * scale if abs(v) >= 2.0**53 else math.floor(v * scale) for v in x.ravel().tolist()]
    return np.array(exact, object).reshape(x.shape)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.square(x - y).sum(axis=-1)


class Book:
    """The entries of one part, and each entry's neighbours sorted by distance."""

    def __init__(self, entries: np.ndarray):
        if entries.dtype == object and max(map(abs, entries.ravel().tolist()), default=0) < SMALL:
            entries = entries.astype("int64")
        self.entries = entries
        between = squared(entries[:, None], entries[None])
        self.order = np.argsort(between, axis=1, kind="stable")
        self.apart = np.take_along_axis(between, self.order, axis=1)

    def nearest(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row of ``x`` and its squared distance."""
        own = squared(x, self.entries[start])
        by_start = np.argsort(start, kind="stable")
        groups = np.searchsorted(start[by_start], np.arange(len(self.entries) + 1))
        many = np.zeros(len(x), "int64")
        for e, (a, b) in enumerate(zip(groups[:-1], groups[1:], strict=True)):
            mine = by_start[a:b]
            many[mine] = np.searchsorted(self.apart[e], 4 * own[mine], "right")
        first = np.cumsum(many) - many
        row = np.repeat(np.arange(len(x)), many)
        entry = self.order[start[row], np.arange(len(row)) - first[row]]
        d = squared(x[row], self.entries[entry])
        least = np.minimum.reduceat(d, first)
        return np.minimum.reduceat(np.where(d == least[row], entry, len(self.entries)), first), least


def walk(x: np.ndarray, rounds: list[list[Book]]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, squared distances), rows by parts, after all ``rounds`` of codebooks. ``x``: rows, parts, positions."""
    codes, error = np.zeros(x.shape[:2], "int64"), np.zeros(x.shape[:2], x.dtype)
    for at in range(0, len(x), AT_ONCE):
        some = slice(at, at + AT_ONCE)
        for p in range(x.shape[1]):
            part = x[some, p]
            for books in rounds:
                codes[some, p], distance = books[p].nearest(part, codes[some, p])
            error = error.astype(object) if distance.dtype == object else error
            error[some, p] = distance
    return codes, error


class Codebooks:
    """What ``fit`` learns: the codebooks of every round, each parts x entries x positions of integers."""

    def __init__(self, size: int, parts: int, scale: int, rounds: list[np.ndarray]):
        self.size, self.parts, self.scale, self.rounds = size, parts, scale, rounds

    def books(self) -> list[list[Book]]:
        return [[Book(b) for b in each] for each in self.rounds]

    def cut(self, lists: pa.ListArray) -> np.ndarray:
        return cut(integers(lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, self.size), self.scale), self.parts)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.rounds[-1].ravel().tolist())).encode()).hexdigest()


def cut(x: np.ndarray, parts: int) -> np.ndarray:
    """Rows as parts of equal width, filled up with zeros."""
    width = -(-x.shape[1] // parts)
    padded = np.zeros((len(x), parts * width), x.dtype)
    padded[:, : x.shape[1]] = x
    return padded.reshape(len(x), parts, width)


def kept_vectors(rows: DataFrame, id_col: str, vector_col: str, label_col: str | None) -> DataFrame:
    v = F.col("v")
    label = F.col(label_col) if label_col else F.lit(None).cast("string")
    rows = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), label.alias("label"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.filter(v.isNotNull() & (F.size("v") > 0) & fine)


def fit(kept: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> Codebooks | None:
    """Codebooks of the rows (id, v) of ``kept_vectors``; None where there are none."""
    smallest = lambda rows: rows.select("id", "v").orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    first = smallest(kept)
    if not first:
        return None
    size = len(first[0].v)
    if any(len(r.v) != size for r in first):
        first = smallest(kept.filter(F.size("v") == size))
    start = cut(integers(np.array([r.v for r in first]), scale), parts).swapaxes(0, 1)
    found = Codebooks(size, parts, scale, [start])
    vectors = kept.filter(F.size("v") == size).select("v")
    for _ in range(rounds):
        found.rounds.append(means(vectors, found))
    return found


def means(vectors: DataFrame, found: Codebooks) -> np.ndarray:
    """Each entry's floored mean over the parts assigned to it."""
    old = found.rounds[-1]
    parts, entries, width = old.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, count, sums = found.books(), np.zeros(parts * entries, "int64"), np.zeros((parts * entries, width), object)
        for batch in batches:
            x = found.cut(lists_of(batch.column(0)))
            slot = (walk(x, books)[0] + np.arange(parts) * entries).ravel()
            count += np.bincount(slot, minlength=parts * entries)
            here = np.zeros((parts * entries, width), x.dtype)
            np.add.at(here, slot, x.reshape(-1, width))
            sums += here
        used = np.flatnonzero(count)
        yield rows_of(used, count[used], sums[used])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[int]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                old_sums = sums.get(r["slot"], [0] * (width + 1))
                sums[r["slot"]] = [a + b for a, b in zip(old_sums, [r["n"], *map(int, r["sums"])], strict=True)]
        yield rows_of(list(sums), [x[0] for x in sums.values()], [x[1:] for x in sums.values()])

    def rows_of(slots, counts, sums) -> pa.RecordBatch:
        columns = [pa.array(slots, pa.int32()), pa.array(counts, pa.int64()), pa.array([[str(v) for v in s] for s in sums], pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(columns, names=["slot", "n", "sums"])

    shape = "slot int, n long, sums array<string>"
    new = old.astype(object)
    for r in vectors.mapInArrow(partial, shape).repartition("slot").mapInArrow(total, shape).collect():
        new[divmod(r.slot, entries)] = [int(s) // r.n for s in r.sums]
    return new


def encode(kept: DataFrame, found: Codebooks) -> DataFrame:
    """id, label, code (two hex digits a part), error."""
    schema = f"id {kept.schema['id'].dataType.simpleString()}, label {kept.schema['label'].dataType.simpleString()}, code string, error long"

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = found.books()
        for batch in batches:
            codes, error = walk(found.cut(lists_of(batch.column(1))), books)
            text = [bytes(c).hex() for c in codes.astype("u1")]
            errors = [min(int(e), LARGEST) for e in error.sum(axis=1).tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(text, pa.string()), pa.array(errors, pa.int64())], names=["id", "label", "code", "error"])

    return kept.filter(F.size("v") == found.size).select("id", "v", "label").mapInArrow(code, schema)


def vector_codes(
    rows: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """vec_id, code, error, label_error (summed over equal labels, nulls together), codebooks_sha256."""
    if not 1 <= entries <= 256:
        raise ValueError("from 1 to 256 entries: two hex digits a part")
    kept = kept_vectors(rows, id_col, vector_col, label_col)
    found = fit(kept, parts, entries, rounds, scale)
    if found is None:
        return kept.select(F.col("id").alias(id_col), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256")).limit(0)
    coded = stage(encode(kept, found), "codes")
    least = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST).cast("decimal(38,0)")).cast("long")
    sums = stage(coded.groupBy("label").agg(least.alias("label_error"), F.count("*").alias("n")), "label-errors")
    # a label of more than a 1024th of the rows is hot; there are at most 1024, and their sums are broadcast
    n = coded.count()
    hot = F.broadcast(sums.filter(F.col("n") * 1024 > n).select(F.col("label").alias("hot_label"), F.col("label_error").alias("hot_error")))
    often = coded.join(hot, F.col("label").eqNullSafe(F.col("hot_label")), "left")
    rest = sums.filter(F.col("n") * 1024 <= n).select(F.col("label").alias("its_label"), "label_error")
    by_hot = often.filter("hot_error IS NOT NULL").select("id", "code", "error", F.col("hot_error").alias("label_error"))
    by_rest = often.filter("hot_error IS NULL").join(rest, F.col("label").eqNullSafe(F.col("its_label"))).select("id", "code", "error", "label_error")
    return by_hot.unionByName(by_rest).select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(found.sha256()).alias("codebooks_sha256"))
