"""Substring dedup by difference-cover anchors.

A window is ``window`` consecutive words. Positions whose remainder modulo the period 13 is in {0, 1, 3, 9}
(every remainder is a difference of two of them) carry a hash of the next 8 words. For equal windows
starting at i and j there is a shift below 13 that brings both to cover positions, so they share an aligned
anchor of 8 words that lies inside them (12 + 8 = 20). Windows that hold a repeated anchor are extended to
their whole length and compared by 128 bits of their word sequence's hash; of equal ones all but the earliest
are removed. The rest of the frame is in ``repeats``.

Cases: a null text has no words; every row is a document of its own; documents are in the order of their ids, null
ids before all others, and those that share an id in the order in which they were read; texts below a window lose
nothing; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame

from tallyhound.llm.repeats import packed, removed, unpacked

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
BASES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], "uint64")
PERIOD, COVER = 13, (0, 1, 3, 9)
ENTRY = ("<u8", "<u8", "<i8", "<i4", "<i4")
NO_ID = -(1 << 63)


def words_of(text: str) -> list[str]:
    return WORD.findall(text) if ODD.search(text) else text.split()


def runs(p: np.ndarray, *whose: np.ndarray) -> tuple[np.ndarray, ...]:
    """Maximal runs of consecutive positions of a document: its keys, first and last."""
    order = np.lexsort((p, *whose[::-1]))
    p, whose = p[order], [w[order] for w in whose]
    new = np.r_[True, p[1:] > p[:-1] + 1][: len(p)]
    for w in whose:
        new[1:] |= w[1:] != w[:-1]
    starts = np.flatnonzero(new)
    return *(w[starts] for w in whose), p[starts], p[np.r_[starts[1:], len(p)][: len(starts)] - 1]


class WordWindows:
    splits_hot = False
    chunk = 2 << 20

    def __init__(self, window: int = 20):
        self.window, self.anchor = window, window - PERIOD + 1
        if self.anchor < 1:
            raise ValueError(f"a window has at least {PERIOD} words")

    def _hashed(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of each word, and where the texts' words start."""
        lists = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        flat, offsets = lists.flatten(), lists.offsets.to_numpy()
        real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
        offsets = np.r_[0, np.cumsum(real)][offsets]
        words = pc.dictionary_encode(flat.filter(pa.array(real)))
        codes = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words.dictionary.to_pylist())), "<u8").reshape(-1, 2)
        return codes[words.indices.to_numpy()], offsets

    @staticmethod
    def _rolled(codes: np.ndarray, size: int, base: np.uint64) -> np.ndarray:
        n = max(0, len(codes) - size + 1)
        h = np.zeros(n, "uint64")
        for j in range(size):
            h *= base
            h += codes[j : j + n]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))

    def _chunks(self, texts: list[str]):
        """Where each chunk of texts starts, and its texts."""
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size < self.chunk):
                size += len(texts[to])
                to += 1
            yield at, texts[at:to]
            at = to

    def anchors(self, texts: pa.Array) -> tuple:
        """Hash, place and position of the texts' anchors."""
        out = [(np.zeros(0, "uint64"), np.zeros(0, "int32"), np.zeros(0, "int32"))]
        for at, some in self._chunks(texts.to_pylist()):
            codes, offsets = self._hashed(some)
            sizes = np.diff(offsets)
            doc = np.repeat(np.arange(len(some)), sizes)
            pos = np.arange(len(codes)) - offsets[doc]
            chosen = np.isin(pos % PERIOD, COVER) & (pos + self.anchor <= sizes[doc]) & (sizes[doc] >= self.window)
            here = np.flatnonzero(chosen)
            h = self._rolled(codes[:, 0], self.anchor, BASES[0])[here]
            out.append((h, (doc[here] + at).astype("int32"), pos[here].astype("int32")))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    def expand(self, bundle: int, work: list, ids, buckets: int, hot: np.ndarray) -> tuple:
        """Payloads of windows by bucket, the earliest of each; and the ranges of the others: place, first, last."""
        entries: list[list[np.ndarray]] = [[np.zeros(0, t)] for t in ENTRY]
        texts = [t.as_py() for _, t, _ in work]
        for begin, some in self._chunks(texts):
            codes, offsets = self._hashed(some)
            marks = np.zeros(len(codes) + 1, "int32")
            places = np.array([w[0] for w in work[begin : begin + len(some)]])
            for (_, _, pos), a, b in zip(work[begin : begin + len(some)], offsets[:-1], offsets[1:], strict=True):
                pos = pos.astype("int64")
                np.add.at(marks, a + np.maximum(0, pos - (PERIOD - 1)), 1)
                np.add.at(marks, a + np.minimum(pos, b - a - self.window) + 1, -1)
            at = np.flatnonzero(np.cumsum(marks)[:-1] > 0)
            doc = np.searchsorted(offsets, at, "right") - 1
            h, c = (self._rolled(codes[:, i], self.window, BASES[i])[at] for i in (0, 1))
            own = ids.take(pa.array(places)).combine_chunks().fill_null(NO_ID).to_numpy()
            for column, x in zip(entries, (h, c, own[doc], places[doc], at - offsets[doc]), strict=True):
                column.append(x.astype(column[0].dtype))
        h, c, i, d, p = (np.concatenate(x) for x in entries)
        first = self._first(h, c, p, d, i)
        to = (h[first] % np.uint64(buckets)).astype("int64")
        return packed(to, h[first], c[first], i[first], d[first], p[first], bundle=bundle), runs(p[~first], d[~first])

    @staticmethod
    def _first(h: np.ndarray, c: np.ndarray, *order_by: np.ndarray) -> np.ndarray:
        """Whether an entry is the first of its (h, c) in the order of the last, then the ones before."""
        order = np.lexsort((*order_by, c, h))
        s, t = h[order], c[order]
        first = np.zeros(len(h), bool)
        first[order] = np.r_[True, (s[1:] != s[:-1]) | (t[1:] != t[:-1])][: len(h)]
        return first

    def resolve(self, payloads: list[bytes]) -> tuple:
        bundle, h, c, i, d, p = unpacked(payloads, *ENTRY)
        later = ~self._first(h, c, p, d, bundle, i)
        return runs(p[later], bundle[later], d[later])

    def cut(self, text: pa.Scalar, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> tuple[int, int, int, bytes]:
        """Words, words removed, maximal runs removed, and what is left."""
        words = words_of(text.as_py())
        if lo is None:
            return len(words), 0, 0, " ".join(words).encode()
        marks = np.zeros(len(words) + 1, "int64")
        np.add.at(marks, lo, 1)
        np.add.at(marks, hi.astype("int64") + self.window, -1)
        gone = np.cumsum(marks[:-1]) > 0
        kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
        return len(words), int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum()), " ".join(kept).encode()


def substring_dedup(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_words, n_removed, n_spans, kept_sha256."""
    return removed(docs, WordWindows(window), id_col, text_col, **options).withColumnRenamed("n", "n_words")
