"""Quality classifier: hashed word n-gram logistic regression trained by follow-the-regularised-leader.

A word is a run of word characters or a run of other visible characters. Features of a text are its word
uni- and bigrams and the uni- to trigrams of its words' shapes (capitals, lower case, digits, or the
marks themselves) and the bigrams of a word and itself, all as one, hashed to 2**``bits`` slots with value log(1 + count), scaled to unit length. A score is
the sigmoid of a sparse dot product with the weights.

Training reads at most ``sample`` labelled rows (those with the smallest id hash, so at every size the
same bound), hashes them where they are and runs per-coordinate FTRL-proximal updates in one task; the weights, 2**bits floats, are
broadcast. Scoring reads every whole text in one pass without a shuffle.

Cases: null and empty texts have the bias alone as their score; labels that are null are not learnt
from; without any label every score is 0.5; repeated rows are scored each; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhound.llm.staging import held_out

SAMPLE = 6000
BITS = 18
WORD = re.compile(r"\w+|[^\w\s]+")
CACHE_WORDS = 150_000
ECHO = np.uint64(5)
MIX = np.uint64(0x9E3779B97F4A7C15)


def shape(word: str) -> str:
    if word.isalpha():
        return "A" if word.isupper() and len(word) > 1 else "a" if word.islower() else "C" if word[1:].islower() or len(word) == 1 else "M"
    return "0" if word.isdigit() else "w" if word[0].isalnum() or word[0] == "_" else word[:3]


class Hasher:
    """Sparse features of a text: slots and values, the bias slot excluded."""

    def __init__(self, bits: int = BITS):
        self.shift = np.uint64(64 - bits)
        self.cache: dict[str, tuple[int, int]] = {}

    def _codes(self, word: str) -> tuple[int, int]:
        return (zlib.crc32(word.encode()) << 7 | 1, zlib.crc32(shape(word).encode()) << 9 | 3)

    def features(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words = WORD.findall(text)
        if not words:
            return np.zeros(0, "int64"), np.zeros(0, "float32")
        get = self.cache.get
        pairs = [get(w) for w in words]
        if None in pairs:
            if len(self.cache) > CACHE_WORDS:
                self.cache.clear()
            for i, p in enumerate(pairs):
                if p is None:
                    pairs[i] = self.cache.setdefault(words[i], self._codes(words[i]))
        codes = np.array(pairs, dtype="uint64")
        w, s = codes[:, 0], codes[:, 1]
        with np.errstate(over="ignore"):
            two, s2 = w[:-1] * np.uint64(31) + w[1:], s[:-1] * np.uint64(37) + s[1:]
            echoes = np.full(int((w[1:] == w[:-1]).sum()), ECHO)
            grams = np.concatenate([w, two, s, s2, s2[:-1] * np.uint64(41) + s[2:], echoes])
            slots = ((grams ^ (grams >> np.uint64(29))) * MIX) >> self.shift
        slots, counts = np.unique(slots, return_counts=True)
        values = np.log1p(counts.astype("float32"))
        return slots.astype("int64"), values / np.sqrt(np.square(values).sum())


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, epochs: int | None = None, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 1e-4) -> np.ndarray:
    """Weights with the bias last, from (slots, values, label). epochs: by default so many that about 20,000 updates are
    made, 3 to 12."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    data = [(np.append(slots, size - 1), np.append(values, np.float32(1)).astype("float64"), float(label)) for slots, values, label in rows]

    def weights(zz: np.ndarray, nn: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(nn)) / alpha + l2))

    for epoch in range(epochs or max(3, min(12, 20_000 // max(1, len(data))))):
        for k in np.random.default_rng(epoch).permutation(len(data)):
            slots, values, label = data[k]
            zz, nn = z[slots], n[slots]
            w = weights(zz, nn)
            g = (1 / (1 + np.exp(-np.clip(w @ values, -30, 30))) - label) * values
            sigma = (np.sqrt(nn + g * g) - np.sqrt(nn)) / alpha
            z[slots], n[slots] = zz + g - sigma * w, nn + g * g
    return weights(z, n).astype("float32")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, bits: int = BITS) -> np.ndarray:
    """Learns from rows that are not held out; at most ``sample`` labels, and as many rows where ids repeat. Of several labels of an id the
    mean counts, 1 from a half on."""
    chosen = labels.select(F.col("doc_id"), F.col("quality").cast("int").alias("quality")).dropna().filter(~held_out(F.col("doc_id")))
    chosen = chosen.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(bits)
        for batch in batches:
            found = [hasher.features(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([x.astype("<i4").tobytes() for x, _ in found], pa.binary()), pa.array([x.astype("<f4").tobytes() for _, x in found], pa.binary())], names=["doc_id", "quality", "slots", "v"])

    def learn(group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("slots", "ascending")])
        data = [(np.frombuffer(s, "<i4").astype("int64"), np.frombuffer(v, "<f4"), q) for s, v, q in zip(*(group.column(c).to_pylist() for c in ("slots", "v", "quality")), strict=True)]
        return pa.table({"w": pa.array([train_ftrl(data, bits).tobytes()], pa.binary())})

    # what one task gets: of each text its distinct features, 2**bits at most
    features = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "quality").mapInArrow(hashed, "doc_id long, quality int, slots binary, v binary")
    features = features.orderBy(F.xxhash64("doc_id", "slots"), "doc_id").limit(sample)
    found = features.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(learn, "w binary").collect()
    return np.frombuffer(found[0].w, "float32") if found else np.zeros((1 << bits) + 1, "float32")


def score(docs: DataFrame, weights: np.ndarray, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    model = docs.sparkSession.sparkContext.broadcast(weights)
    bits = (len(weights) - 1).bit_length() - 1

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, w = Hasher(bits), model.value
        for batch in batches:
            margins = np.empty(batch.num_rows)
            for i, text in enumerate(batch.column(1)):
                slots, values = hasher.features(text.as_py() or "")
                margins[i] = w[-1] + float(w[slots] @ values)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(margins, -30, 30))))], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scored, "doc_id long, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, weights: np.ndarray, threshold: float = 0.3) -> DataFrame:
    """The rows that the classifier accepts, columns untouched; scored in place, so nothing is joined."""
    model = docs.sparkSession.sparkContext.broadcast(weights)
    bits = (len(weights) - 1).bit_length() - 1
    at = docs.columns.index("text")

    def accepted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, w, least = Hasher(bits), model.value, np.log(threshold / (1 - threshold))
        for batch in batches:
            keep = []
            for text in batch.column(at):
                slots, values = hasher.features(text.as_py() or "")
                keep.append(bool(w[-1] + float(w[slots] @ values) >= least))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(accepted, docs.schema)
