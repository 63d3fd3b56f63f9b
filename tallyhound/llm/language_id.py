"""Language identification by multilingual mixture inference.

A text's letters (Unicode category L, lower case, words padded by a space) give hashed character trigrams. Each language has
a smoothed trigram distribution, learnt from at most about ``per_lang`` labelled documents of it. A
document is a mixture of languages: expectation-maximisation estimates the proportions. The language set
grows one at a time, while the log-likelihood gained exceeds ``penalty`` * log(number of trigrams) per
language; the prediction is the set's language with the largest proportion, the score that proportion.

Cases: a null text, or one without a letter, is ``und`` with score 0; a null ``lang`` is not learnt from;
with no learnt language everything is ``und``; ties go to the first language in alphabetical order;
repeated rows are predicted each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhound.llm.staging import held_out

PER_LANG = 2000
BITS = 16
LETTERS = regex.compile(r"\p{L}+")


def trigrams(text: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Slots and counts; empty where there is no letter."""
    words = LETTERS.findall(text.lower())
    if not words:
        return np.zeros(0, "int64"), np.zeros(0)
    c = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le"), "<u4").astype("uint64")
    with np.errstate(over="ignore"):
        h = (c[:-2] * np.uint64(0x9E3779B97F4A7C15) + c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + c[2:] * np.uint64(0x165667B19E3779F9)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - bits)
    counts = np.bincount(h.astype("int64"), minlength=0)
    slots = np.flatnonzero(counts)
    return slots, counts[slots].astype("float64")


def fit(docs: DataFrame, per_lang: int = PER_LANG, bits: int = BITS) -> tuple[list[str], np.ndarray]:
    """Languages in alphabetical order and their log probabilities, one row each."""
    rows = docs.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select("lang", "text", F.xxhash64("doc_id", "text").alias("hash"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("count"), F.min("hash").alias("least")).select("lang", F.greatest(F.lit(1), F.col("count") / per_lang).cast("long").alias("step"), "least")
    # one row a language: bounded by the number of languages; each has the row of its smallest hash at least
    chosen = rows.join(F.broadcast(sizes), "lang").filter((F.pmod("hash", "step") == 0) | (F.col("hash") == F.col("least")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                slots, counts = trigrams(text.as_py() or "", bits)
                total.setdefault(lang, np.zeros(1 << bits, "int64"))[slots] += counts.astype("int64")
        for lang, counts in total.items():
            slots = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(slots), pa.string()), pa.array(slots.astype("int32")), pa.array(counts[slots])], names=["lang", "slot", "n"])

    counted = chosen.select("lang", "text").mapInArrow(count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    # at most 2**bits rows a language
    found = counted.toPandas()
    langs = sorted(found["lang"].unique())
    table = np.full((len(langs), 1 << bits), 0.5)
    table[found["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy("int64"), found["slot"].to_numpy("int64")] += found["n"].to_numpy("float64")
    return langs, np.log(table / table.sum(axis=1, keepdims=True)).astype("float32")


def mixture(logs: np.ndarray, counts: np.ndarray, penalty: float = 4.0, rounds: int = 12) -> dict[int, float]:
    """The chosen languages' proportions. logs: languages x trigrams, counts: of the trigrams."""
    price = penalty * np.log(counts.sum() + 1)
    alone = logs @ counts
    chosen, best = [int(np.argmax(alone))], float(alone.max())
    share = np.ones(1)
    likelihood = np.exp(logs)
    while len(chosen) < len(logs):
        # what each further language could gain at most tells which one to try
        now = share @ likelihood[chosen]
        gain = np.maximum(0, np.log(np.maximum(likelihood, now) / now)) @ counts
        gain[chosen] = -1
        if gain.max() <= price:
            break
        trial = [*chosen, int(np.argmax(gain))]
        pi, p = np.full(len(trial), 1 / len(trial)), likelihood[trial]
        for _ in range(rounds):
            joint = pi[:, None] * p
            pi = (joint / joint.sum(axis=0)) @ counts / counts.sum()
        value = float(np.log(pi @ p) @ counts)
        if value - best <= price:
            break
        chosen, share, best = trial, pi, value
    return dict(zip(chosen, share.tolist(), strict=True))


def predict(docs: DataFrame, langs: list[str], logs: np.ndarray, penalty: float = 4.0) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages (the chosen set and its proportions)."""
    model = docs.sparkSession.sparkContext.broadcast((langs, logs))
    bits = (logs.shape[1] - 1).bit_length()

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = model.value
        for batch in batches:
            lang, score, sets = [], [], []
            for text in batch.column(1):
                slots, counts = trigrams(text.as_py() or "", bits)
                shares = mixture(table[:, slots], counts, penalty) if len(slots) and names else {}
                best = min(shares, key=lambda k: (-shares[k], k), default=None)
                lang.append("und" if best is None else names[best])
                score.append(0.0 if best is None else min(1.0, shares[best]))
                sets.append(",".join(f"{names[k]}:{shares[k]:.3f}" for k in sorted(shares, key=lambda k: (-shares[k], k))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.string())], names=["doc_id", "lang_pred", "score", "languages"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(predicted, "doc_id long, lang_pred string, score double, languages string")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "languages")
