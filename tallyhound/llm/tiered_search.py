"""Ranked lexical search over a tiered index of whole texts, with all scores in 64-bit integers.

Index: a row a document, so scores are summed where the document is and no posting is ever shuffled. Terms that few
documents hold, the weightiest, are all in the first tier. Postings of the common terms (the ``MOST_COMMON`` most frequent, each
held by more than 1/256 of the documents) are dealt to three tiers by impact, weight times saturated frequency; the cuts leave an eighth and a half
of them above. A tier is a pair of columns, so a search that stops early never reads the others. Each common term has
a residual bound for each tier, the greatest impact below it, and each document the greatest impact of its own below it.

Search: items go in blocks of about ``BLOCK_TERMS`` terms, each a list that tasks hold. A document's partial score plus the
smaller of both bounds over the terms not yet seen is the most it can reach. An item is answered by the upper tiers if nothing that is not
exact could reach its last place; the others fall through to the next tier, and the last one is exact for all.

Cases: null and termless texts are no documents; an item without a term that a document holds has no rows; rows that repeat an
id, of documents or items, count one by one (and each such item is ranked on its own); a null doc_id loses ties; empty tables give no
rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyhound.llm.best_fit import runs_of
from tallyhound.llm.staging import discard, stage, trim

#: What stands between terms.
APART = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
MOST_COMMON = 65_536
BLOCK_TERMS = 200_000
TIERS = 3
#: Shares of the common postings above the cuts between tiers.
SHARES = (1 / 8, 1 / 2)
#: Pairs of documents and items, or expanded postings, that a task scores at once.
AT_ONCE = 1_000_000
FORWARD = "doc_id long, n long, terms array<string>, tf array<long>"
INDEX = "doc_id long, rare array<string>, rare_s array<long>, " + ", ".join(f"c{j} array<int>, s{j} array<long>" for j in range(TIERS)) + ", below array<long>"
FOUND = "item int, doc_id long, score long, bound long"


def term_counts(texts: pa.StringArray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Of each text's distinct terms: the text's place, the term and how often it is there."""
    lists = pc.split_pattern_regex(texts, pattern=APART)
    owner = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy())
    words = lists.flatten()
    real = pc.not_equal(words, "")
    words = pc.dictionary_encode(pc.filter(words, real))
    lower = pc.dictionary_encode(pc.ascii_lower(words.dictionary))
    size = max(1, len(lower.dictionary))
    codes = lower.indices.to_numpy()[words.indices.to_numpy()]
    keys, tf = np.unique(owner[real.to_numpy(zero_copy_only=False)] * size + codes, return_counts=True)
    return keys // size, lower.dictionary.take(pa.array(keys % size)), tf.astype("int64")


def lists_by(owner: np.ndarray, count: int, *columns: pa.Array) -> list[pa.ListArray]:
    """Each column as one list an owner; ``owner`` ascends."""
    offsets = pa.array(np.searchsorted(owner, np.arange(count + 1)), pa.int32())
    return [pa.ListArray.from_arrays(offsets, c) for c in columns]


def flat(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The row of each element, and the elements."""
    return np.repeat(np.arange(len(column)), column.value_lengths().to_numpy()), column.flatten()


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def batch_of(columns: list[pa.Array], schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")])


def forward(docs: DataFrame) -> DataFrame:
    """Each document's terms and their frequencies; those without a term are left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in runs_of(batch.column(1), 4 << 20):
                owner, terms, tf = term_counts(texts)
                n = np.bincount(owner, weights=tf, minlength=len(texts)).astype("int64")
                lists = lists_by(owner, len(texts), terms, pa.array(tf))
                some = pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(n), *lists], names=["doc_id", "n", "terms", "tf"])
                yield some.filter(pa.array(n > 0))
                at += len(texts)
            trim()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, FORWARD)


class Index:
    """A built index: its rows, the frequencies of all terms, and the common terms."""

    def __init__(self, docs: DataFrame):
        rows = stage(forward(docs), "forward")
        self.documents, self.length = (x or 0 for x in rows.agg(F.count("*"), F.sum("n")).first())

        def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                counts = pc.value_counts(batch.column(0).flatten())
                yield pa.RecordBatch.from_arrays([counts.field(0), counts.field(1)], names=["term", "df"])

        self.df = stage(rows.select("terms").mapInArrow(held, "term string, df long").groupBy("term").agg(F.sum("df").alias("df")), "df")
        often = self.df.filter(F.col("df") * 256 > self.documents).orderBy(F.desc("df"), "term").limit(MOST_COMMON).collect()
        self.common = {r.term: k for k, r in enumerate(often)}
        self.weights = np.array([weight(self.documents, r.df) for r in often], "int64")
        self.rows = self._tiers(rows)
        discard(rows)
        self.residual = self._residuals()

    def _impacts(self):
        """A function from a batch of the forward table to its postings: row, term, place in the common terms or -1, s."""
        documents, length, common = self.documents, self.length, pa.array(list(self.common), pa.string())

        def impacts(batch: pa.RecordBatch) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
            owner, terms = flat(batch.column("terms"))
            tf = batch.column("tf").flatten().to_numpy()
            m = 50 + 50 * batch.column("n").to_numpy() * documents // length
            place = pc.fill_null(pc.index_in(terms, value_set=common), -1).to_numpy()
            return owner, terms, place, 1_000_000_000 * tf // (1000 * tf + 20 * m[owner])

        return impacts

    def _cuts(self, rows: DataFrame) -> list[int]:
        """The impacts that part the tiers, from a histogram of the common terms' impacts in eighths of powers of two."""
        impacts, weights = self._impacts(), self.weights

        def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(512, "int64")
            for batch in batches:
                _, _, place, s = impacts(batch)
                value = (weights[place[place >= 0]] * s[place >= 0]) if len(weights) else np.zeros(0, "int64")
                total += np.bincount((8 * np.log2(value[value > 0])).astype(int), minlength=512)
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], names=["bin", "n"])

        found = sorted(((r.bin, r.n) for r in rows.mapInArrow(bins, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()), reverse=True)
        every, cuts, above = sum(n for _, n in found), [], 0
        for b, n in found:
            above += n
            while len(cuts) < len(SHARES) and above >= every * SHARES[len(cuts)]:
                cuts.append(math.ceil(2 ** (b / 8)))
        return cuts + [1] * (len(SHARES) - len(cuts))

    def _tiers(self, rows: DataFrame) -> DataFrame:
        impacts, weights, cuts = self._impacts(), self.weights, np.array(self._cuts(rows))

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 1024):
                    batch = whole.slice(at, 1024)
                    owner, terms, place, s = impacts(batch)
                    rare = place < 0
                    columns = [batch.column("doc_id"), *lists_by(owner[rare], batch.num_rows, terms.filter(pa.array(rare)), pa.array(s[rare]))]
                    value = np.where(rare, 0, (weights if len(weights) else np.zeros(1, "int64"))[place] * s)
                    tier = (value[:, None] < cuts).sum(axis=1)
                    below = np.zeros((batch.num_rows, TIERS), "int64")
                    for j in range(TIERS):
                        mine = (tier == j) & (value > 0)  # a term that all documents hold weighs nothing
                        columns += lists_by(owner[mine], batch.num_rows, pa.array(place[mine].astype("int32")), pa.array(s[mine]))
                        for above in range(j):
                            np.maximum.at(below[:, above], owner[mine], value[mine])
                    columns.append(pa.FixedSizeListArray.from_arrays(pa.array(below.ravel()), TIERS).cast(pa.list_(pa.int64())))
                    yield batch_of(columns, INDEX)

        return stage(rows.mapInArrow(split, INDEX), "tiers")

    def _residuals(self) -> np.ndarray:
        """Common terms by tiers: the greatest impact of a term in the tiers below; at most ``MOST_COMMON`` rows a tier."""
        weights, size = self.weights, len(self.weights)

        def greatest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            top = np.zeros((TIERS, size), "int64")
            for batch in batches:
                for j in range(1, TIERS):
                    code, s = (batch.column(f"{x}{j}").flatten().to_numpy() for x in "cs")
                    np.maximum.at(top[j], code, weights[code] * s)
            tier, code = np.nonzero(top)
            yield pa.RecordBatch.from_arrays([pa.array(tier), pa.array(code), pa.array(top[tier, code])], names=["tier", "code", "top"])

        out = np.zeros((TIERS, size), "int64")
        lower = self.rows.select(*[f"{x}{j}" for j in range(1, TIERS) for x in "cs"])
        for r in lower.mapInArrow(greatest, "tier long, code long, top long").groupBy("tier", "code").agg(F.max("top").alias("top")).collect():
            for above in range(r.tier):
                out[above, r.code] = max(out[above, r.code], r.top)
        return out


class Block:
    """The terms of a block of items, by slot: weight, residual bound, and the items that hold it."""

    def __init__(self, items: dict[int, list[tuple[str, int]]], index: Index):
        self.items = sorted(items)
        holders, self.df = defaultdict(list), {}
        for k, item in enumerate(self.items):
            for term, df in items[item]:
                holders[term].append(k)
                self.df[term] = df
        self.rare = [t for t in holders if t not in index.common]
        common = [t for t in holders if t in index.common]
        every = self.rare + common
        self.weights = np.array([weight(index.documents, self.df[t]) for t in every], "int64")
        self.fan = np.array([len(holders[t]) for t in every], "int64")
        self.start = np.cumsum(self.fan) - self.fan
        self.holder = np.array([k for t in every for k in holders[t]], "int64")
        self.slot = np.full(len(index.common), -1)
        codes = [index.common[t] for t in common]
        self.slot[codes] = np.arange(len(self.rare), len(every))
        self.residual = np.zeros((TIERS, len(every)), "int64")
        self.residual[:, len(self.rare) :] = index.residual[:, codes]


def exact_sums(keys: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of whole numbers by key; both halves stay whole in doubles."""
    low, high = values & 0xFFFFF, values >> 20
    return np.bincount(keys, low, size).astype("int64") + (np.bincount(keys, high, size).astype("int64") << 20)


class Best:
    """The ``k`` best documents of each item so far, and the most that any other that is not exact can reach."""

    def __init__(self, items: int, k: int):
        self.k, self.last, self.rest = k, np.ones(items, "int64"), np.zeros(items, "int64")
        self.kept: list[np.ndarray] = []
        self.size = 0

    def add(self, doc: np.ndarray, score: np.ndarray, bound: np.ndarray) -> None:
        """Documents by items; ``doc`` sorts as its ids do."""
        open_ = (score >= self.last) & (score > 0)
        self.rest = np.maximum(self.rest, np.where(open_ | (bound == score), 0, bound).max(axis=0, initial=0))
        row, item = np.nonzero(open_)
        self.kept.append(np.stack([item, doc[row], score[row, item], bound[row, item]]))
        self.size += len(row)
        if self.size > 4 * self.k * len(self.last):
            self.settle()

    def settle(self) -> np.ndarray:
        every = np.concatenate([np.zeros((4, 0), "int64"), *self.kept], axis=1)
        every = every[:, np.lexsort((every[1], -every[2], every[0]))]
        place = np.arange(every.shape[1]) - np.searchsorted(every[0], every[0])
        gone = every[:, place >= self.k]
        np.maximum.at(self.rest, gone[0], np.where(gone[3] > gone[2], gone[3], 0))
        ends = every[:, place == self.k - 1]
        self.last[ends[0]] = ends[2]
        every = every[:, place < self.k]
        self.kept, self.size = [every], every.shape[1]
        return every


def search_block(index: Index, block: Block, tier: int, k: int) -> DataFrame:
    """item (its place in the block), doc_id, score, bound: each task's best, and with score -1 its greatest open bound."""
    rare, items = pa.array(block.rare, pa.string()), len(block.items)
    weights, fan, start, holder, slots = block.weights, block.fan, block.start, block.holder, block.slot
    residual, is_common = block.residual[tier], np.arange(len(fan)) >= len(block.rare)
    codes = np.repeat(np.arange(len(fan)), fan)
    whole, many = exact_sums(holder, residual[codes], items), np.bincount(holder, is_common[codes], items).astype("int64")
    last = tier == TIERS - 1
    none = np.iinfo("int64").max  # a null id sorts behind all others

    def postings(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        owner, terms = flat(batch.column("rare"))
        slot = pc.fill_null(pc.index_in(terms, value_set=rare), -1).to_numpy()
        found = [(owner, slot, batch.column("rare_s").flatten().to_numpy())]
        for j in range(tier + 1 if len(slots) else 0):
            owner, code = flat(batch.column(f"c{j}"))
            found.append((owner, slots[code.to_numpy()], batch.column(f"s{j}").flatten().to_numpy()))
        owner, slot, s = (np.concatenate(x) for x in zip(*found, strict=True))
        real = np.flatnonzero(slot >= 0)
        real = real[np.argsort(owner[real], kind="stable")]
        return owner[real], slot[real], s[real]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(items, k)
        for batch in batches:
            owner, slot, s = postings(batch)
            ids = pc.fill_null(batch.column("doc_id"), none).to_numpy()
            below = batch.column("below").flatten().to_numpy().reshape(-1, TIERS)[:, tier] if batch.num_rows else np.zeros(0, "int64")
            work = np.cumsum(np.bincount(owner, fan[slot], batch.num_rows) + items)
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + AT_ONCE, "right")))
                a, b = np.searchsorted(owner, [at, to])
                times = fan[slot[a:b]]
                each = np.repeat(np.arange(a, b), times)
                item = holder[start[slot[each]] + np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)]
                key, size = (owner[each] - at) * items + item, (to - at) * items
                sums = exact_sums(key, weights[slot[each]] * s[each], size).reshape(-1, items)
                most = sums
                if not last:
                    open_ = whole - exact_sums(key, residual[slot[each]], size).reshape(-1, items)
                    unseen = many - np.bincount(key, is_common[slot[each]], size).astype("int64").reshape(-1, items)
                    most = sums + np.minimum(open_, unseen * below[at:to, None])
                best.add(ids[at:to], sums, most)
                at = to
        top = best.settle()
        rest = np.flatnonzero(best.rest)
        columns = [np.concatenate(x) for x in zip(top, (rest, np.full(len(rest), none), np.full(len(rest), -1), best.rest[rest]), strict=True)]
        doc = pa.array(columns[1], mask=columns[1] == none)
        yield batch_of([pa.array(columns[0].astype("int32")), doc, pa.array(columns[2]), pa.array(columns[3])], FOUND)

    wanted = ["doc_id", "rare", "rare_s", *[f"{x}{j}" for j in range(tier + 1) for x in "cs"], "below"]
    return index.rows.select(*wanted).mapInArrow(score, FOUND)


def ranked(found: DataFrame, k: int, by: str = "item") -> DataFrame:
    """The ``k`` best rows an item, with their rank; lists of tasks are merged in two levels."""
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    within = Window.partitionBy(by, "salt").orderBy(*order)
    some = found.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64))).withColumn("rank", F.row_number().over(within)).filter(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= k).drop("salt")


def search(docs: DataFrame, items: DataFrame, k: int = 50, item_col: str = "item_id", text_col: str = "text", tiers_used: dict | None = None) -> DataFrame:
    """item_id, rank, doc_id, score. ``tiers_used`` takes, by tier, how many items it answered."""
    index = Index(docs)
    spark = docs.sparkSession
    item_type = items.schema[item_col].dataType.simpleString()

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in runs_of(batch.column(2), 4 << 20):
                owner, term, _ = term_counts(texts)
                rows = pa.array(owner + at)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), term], names=["row", "item_id", "term"])
                at += len(texts)

    asked = items.select(F.monotonically_increasing_id().alias("row"), F.col(item_col).alias("item_id"), F.col(text_col).alias("text"))
    asked = stage(asked.mapInArrow(terms, f"row long, item_id {item_type}, term string").join(index.df, "term"), "items")
    blocks = max(1, -(-asked.count() // BLOCK_TERMS))
    answers = [spark.createDataFrame([], f"item_id {item_type}, rank int, doc_id long, score long")]
    for b in range(blocks):
        by_row, names = defaultdict(list), {}
        for r in asked.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).orderBy("row", "term").toLocalIterator():
            by_row[r.row].append((r.term, r.df))
            names[r.row] = r.item_id
        for tier in range(TIERS):
            if not by_row:
                break
            block = Block(by_row, index)
            found = stage(search_block(index, block, tier, k), "found")
            best = stage(ranked(found.filter("score > 0"), k), "best")
            # at most one row an item of the block
            ends = best.groupBy("item").agg(F.when(F.count("*") == k, F.min("score")).otherwise(1).alias("least"))
            threat = found.join(F.broadcast(ends), "item", "left").filter((F.col("bound") > F.col("score")) & (F.col("bound") >= F.coalesce("least", F.lit(1))))
            unproven = {r.item for r in threat.select("item").distinct().collect()}
            proven = [(i, names[row]) for i, row in enumerate(block.items) if i not in unproven]
            if proven:
                named = spark.createDataFrame(proven, f"item int, item_id {item_type}")
                answers.append(best.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score"))
            if tiers_used is not None:
                tiers_used[tier] = tiers_used.get(tier, 0) + len(proven)
            by_row = {row: by_row[row] for i, row in enumerate(block.items) if i in unproven}
    out = answers[0]
    for more in answers[1:]:
        out = out.unionByName(more)
    return out
