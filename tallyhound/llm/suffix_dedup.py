"""Suffix-array dedup by column-wise multi-document construction.

Which bytes are covered by a ``length``-byte string that also starts elsewhere is decided on collections of
aligned blocks. The construction takes one symbol of every block each round, column by column, and updates the
blocks' order by what they have read so far (one column of the collection's Burrows-Wheeler transform: a stable
sort of the symbols in the order before) together with the length of what neighbours have in common. Neighbours
that share ``length`` bytes hold a repeated string there. A round costs time and memory in proportion to the blocks;
pairs are never compared. The sequential external files are the staged tables of blocks, read once and in whole
groups of about ``BATCH`` blocks.

The classical form of the method orders all suffixes of all documents and takes one round for each symbol of
the longest document, reading all that is built each time: work grows with total size times longest length,
out of reach for long documents. So blocks are found first. The minimum of the hashes of the 64-byte strings
inside a window of ``length`` bytes (leftmost if tied) is the same for equal windows, so their minima repeat
at the same place in them. A block reaches from where the first such window can start to where the last can
end, and only blocks whose minimum repeats are built. Blocks whose bytes are equal are merged where they are
before they move. Around an anchor so frequent that its blocks might not fit a task, single strings of
``length`` bytes that repeat by their hash are the blocks; equal ones are merged too. Every removal thus comes
from bytes compared, never from hashes alone. The rest of the frame is in ``repeats``.

Cases: a null text is empty; every row is a document of its own, whatever its id, so a row given twice repeats
itself; texts below ``length`` bytes lose nothing; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyhound.llm.repeats import CHUNK, groups_of, of_group, packed, removed, unpacked, without_repeats

PAD = 0xFF  # never a byte of UTF-8
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
BATCH = 50_000


class Rolling:
    """Hashes of all strings of a byte array from prefix sums modulo 2**64; one a process."""

    made: dict[int, Rolling] = {}

    def __init__(self, base: int):
        inverse = pow(base, -1, 1 << 64)
        self.codes = np.random.default_rng(base).integers(0, 1 << 64, 256, dtype="uint64")
        n = 2 * CHUNK + 4096
        self.power, self.inverse = (np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, b, "uint64")]) for b in (np.uint64(base), np.uint64(inverse)))

    @classmethod
    def of(cls, base: int) -> Rolling:
        if base not in cls.made:
            cls.made[base] = cls(base)
        return cls.made[base]

    def sums(self, data: np.ndarray) -> np.ndarray:
        return np.r_[np.uint64(0), np.cumsum(self.codes[data] * self.power[: len(data)], dtype="uint64")]

    def hashes(self, sums: np.ndarray, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        h = (sums[end] - sums[start]) * self.inverse[start]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))


def column_wise(blocks: np.ndarray, length: int) -> np.ndarray:
    """For aligned blocks (rows of bytes): whether the ``length``-byte string from each column is also in
    another row at that column. A pad in it makes the answer meaningless."""
    m, width = blocks.shape
    found = np.zeros((m, width - length + 1), bool)
    if m < 2:
        return found
    order, common = np.arange(m, dtype="int32"), np.zeros(m + 1, "int32")
    for k, column in enumerate(np.ascontiguousarray(blocks.T)):
        symbols = column[order]
        turn = np.argsort(symbols, kind="stable")
        symbols = symbols[turn]
        before, now = turn[:-1], turn[1:]
        same = symbols[1:] == symbols[:-1]
        fresh = np.zeros(m + 1, "int32")
        next_to = same & (now == before + 1)
        fresh[1:m][next_to] = common[now[next_to]] + 1
        apart = np.flatnonzero(same & ~next_to)
        if len(apart):
            ranges = np.empty(2 * len(apart), "int64")
            ranges[::2], ranges[1::2] = before[apart] + 1, now[apart] + 1
            fresh[1:m][apart] = np.minimum.reduceat(common, ranges)[::2] + 1
        order, common = order[turn], fresh
        if k + 1 >= length:
            shared = np.flatnonzero(common[:m] >= length)
            found[order[shared], k + 1 - length] = True
            found[order[shared - 1], k + 1 - length] = True
    return found


class ByteWindows:
    splits_hot = True

    def __init__(self, length: int = 200, gram: int = 64):
        gram = min(gram, max(1, length // 2))
        self.length, self.gram, self.reach = length, gram, length - gram
        self.width = self.reach + length

    def _pieces(self, data: np.ndarray):
        """(offset, bytes) of at most CHUNK window starts each."""
        for a in range(0, max(1, len(data) - self.length + 1), CHUNK):
            yield a, data[a : a + CHUNK + self.length - 1]

    def anchors(self, texts: pa.Array) -> tuple:
        """Hash, place and position of the texts' minima."""
        out, some, size = [], [], 0
        for place, text in enumerate(texts.cast(pa.binary())):
            data = np.frombuffer(text.as_py(), "uint8")
            if len(data) < self.length:
                continue
            for at, piece in self._pieces(data):
                if size and size + len(piece) > CHUNK:
                    out.append(self._minima(some))
                    some, size = [], 0
                some.append((place, at, piece))
                size += len(piece)
        out.append(self._minima(some))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    def _minima(self, some: list) -> tuple:
        if not some:
            return np.zeros(0, "uint64"), np.zeros(0, "int32"), np.zeros(0, "int32")
        data = np.concatenate([x[2] for x in some])
        sizes = np.array([len(x[2]) for x in some])
        offsets = np.cumsum(sizes) - sizes
        roll, n, w = Rolling.of(BASES[0]), len(data) - self.gram + 1, self.reach + 1
        sums = roll.sums(data)
        h = roll.hashes(sums, slice(0, n), slice(self.gram, self.gram + n))
        low = np.uint64((1 << 22) - 1)
        value = np.full(-(-(n + w) // w) * w, np.uint64(0xFFFFFFFFFFFFFFFF))
        value[:n] = (h & ~low) | np.arange(n, dtype="uint64")
        # minima of all runs of w: of what is left of a row of w and what is used of the next
        rows = value.reshape(-1, w)
        up = np.minimum.accumulate(rows, axis=1).ravel()
        down = np.ascontiguousarray(np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1]).ravel()
        least = np.minimum(down[:n], up[w - 1 : w - 1 + n])
        inside = np.zeros(n, bool)
        for a, size in zip(offsets.tolist(), sizes.tolist(), strict=True):
            inside[a : a + size - self.length + 1] = True
        chosen = np.zeros(n, bool)
        chosen[(least[inside] & low).astype("int64")] = True
        at = np.flatnonzero(chosen)
        doc = np.searchsorted(offsets, at, "right") - 1
        return h[at], np.array([x[0] for x in some], "int32")[doc], (at - offsets[doc] + np.array([x[1] for x in some])[doc]).astype("int32")

    def _around(self, data: np.ndarray, positions: np.ndarray):
        """Chunk by chunk: where a piece starts, its two hashes' sums, and the positions whose surroundings it holds."""
        for a in range(0, len(data), CHUNK):
            p = positions[(positions >= a) & (positions < a + CHUNK)].astype("int64")
            if len(p):
                base = max(0, a - self.reach)
                piece = data[base : a + CHUNK + self.length]
                yield base, Rolling.of(BASES[0]).sums(piece), Rolling.of(BASES[1]).sums(piece), p

    def _hot(self, base: int, sums: np.ndarray, p: np.ndarray, hot: np.ndarray) -> np.ndarray:
        return np.isin(Rolling.of(BASES[0]).hashes(sums, p - base, p - base + self.gram), hot)

    def hot_strings(self, work: list, hot: np.ndarray) -> tuple[tuple, pa.Table]:
        """Hash, place and position of all strings of ``length`` bytes around hot anchors, as anchors of their own; and
        the regions (place, start, bytes) that hold them."""
        out, regions = [(np.zeros(0, "uint64"), np.zeros(0, "int32"), np.zeros(0, "int32"))], ([], [], [])
        for place, text, positions in work:
            data = np.frombuffer(text.as_buffer() or b"", "uint8")
            last, done = len(data) - self.length, -1
            for base, sums, _, p in self._around(data, positions):
                p = p[self._hot(base, sums, p, hot)]
                if not len(p):
                    continue
                lo, hi = np.maximum(0, p - self.reach), np.minimum(p, last)
                marks = np.zeros(len(sums) + 1, "int32")
                np.add.at(marks, lo - base, 1)
                np.add.at(marks, hi - base + 1, -1)
                at = np.flatnonzero(np.cumsum(marks) > 0)
                at = at[at + base > done]  # the chunk before may have reached over the border
                done = max(done, int(hi.max()))
                out.append((Rolling.of(BASES[0]).hashes(sums, at, at + self.length), np.full(len(at), place, "int32"), (at + base).astype("int32")))
                edges = np.flatnonzero(np.diff(at) > 1)
                for i, j in zip(at[np.r_[0, edges + 1]].tolist() if len(at) else [], at[np.r_[edges, -1]].tolist() if len(at) else [], strict=True):
                    for column, x in zip(regions, (place, base + i, data[base + i : base + j + self.length].tobytes()), strict=True):
                        column.append(x)
        table = pa.table({"place": pa.array(regions[0], pa.int32()), "start": pa.array(regions[1], pa.int32()), "bytes": pa.array(regions[2], pa.binary())})
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)), table

    def strings(self, bundle: int, regions: pa.Table, positions: dict[int, np.ndarray], buckets: int) -> tuple:
        """Blocks of the single strings at the positions given, whose start stands for the anchor's."""
        blocks, texts = self._no_blocks(), []
        for place, start, raw in zip(*(regions.column(c).to_pylist() for c in ("place", "start", "bytes")), strict=True):
            data = np.frombuffer(raw, "uint8")
            mine = positions.get(place, np.zeros(0, "int32"))
            mine = mine[(mine >= start) & (mine <= start + len(data) - self.length)] - start
            texts.append((start, data))
            for base, s1, s2, p in self._around(data, mine):
                h = Rolling.of(BASES[0]).hashes(s1, p - base, p - base + self.length)
                self._add(blocks, h, Rolling.of(BASES[0]), Rolling.of(BASES[1]), s1, s2, base, place, p, p, p, start, len(texts) - 1)
        return self._merged(bundle, blocks, texts, buckets, b"w")

    def expand(self, bundle: int, work: list, ids, buckets: int, hot: np.ndarray) -> tuple:
        """Payloads of blocks by bucket, and the ranges of windows known to repeat: place, first, last."""
        blocks, texts = self._no_blocks(), []
        for place, text, positions in work:
            data = np.frombuffer(text.as_buffer() or b"", "uint8")
            texts.append((0, data))
            for base, s1, s2, p in self._around(data, positions):
                p = p[~self._hot(base, s1, p, hot)]
                h, lo, hi = Rolling.of(BASES[0]).hashes(s1, p - base, p - base + self.gram), np.maximum(0, p - self.reach), np.minimum(p, len(data) - self.length)
                self._add(blocks, h, Rolling.of(BASES[0]), Rolling.of(BASES[1]), s1, s2, base, place, p, lo, hi, 0, len(texts) - 1)
        return self._merged(bundle, blocks, texts, buckets, b"b")

    @staticmethod
    def _no_blocks() -> list:
        return [[np.zeros(0, t)] for t in ("<u8", "<u8", "<u8", "<i4", "<i4", "<i4", "<i4", "<i4")]

    def _add(self, blocks, h, one, two, s1, s2, base, place, p, lo, hi, start, text) -> None:
        """Adds blocks around p whose windows start from lo to hi; ``start`` is where ``text`` starts in its document."""
        i, j = lo - base, hi - base + self.length
        size = ((p - lo) * 1000 + (hi - lo)).astype("uint64")
        found = (h, one.hashes(s1, i, j) + size, two.hashes(s2, i, j), np.full(len(p), place), p + start, lo + start, hi + start, np.full(len(p), text))
        for column, x in zip(blocks, found, strict=True):
            column.append(x.astype(column[0].dtype))

    def _merged(self, bundle: int, blocks: list, texts: list, buckets: int, tag: bytes) -> tuple:
        """Equal blocks become one, compared by their bytes."""
        h, b1, b2, d, p, lo, hi, text = (np.concatenate(x) for x in blocks)

        def raw(k: int) -> np.ndarray:
            start, data = texts[text[k]]
            return data[lo[k] - start : hi[k] - start + self.length]

        order = np.lexsort((b2, b1))
        new = np.r_[True, (b1[order][1:] != b1[order][:-1]) | (b2[order][1:] != b2[order][:-1])][: len(h)]
        leader = order[np.flatnonzero(new)][np.cumsum(new) - 1] if len(h) else order
        alone, merged = np.ones(len(h), bool), np.zeros(len(h), bool)
        for i, j in zip(order[~new].tolist(), leader[~new].tolist(), strict=True):
            if p[i] - lo[i] == p[j] - lo[j] and np.array_equal(raw(i), raw(j)):
                alone[i] = alone[j] = False
                merged[i] = True
        first, again = np.flatnonzero(~merged), np.flatnonzero(~alone)
        sent = []
        for k in range(0, len(first), BATCH):
            some = first[k : k + BATCH]
            rows = np.full((len(some), self.width), PAD, "uint8")
            for row, i in zip(rows, some.tolist(), strict=True):
                row[lo[i] - p[i] + self.reach : hi[i] - p[i] + self.width] = raw(i)
            to = (h[some] % np.uint64(buckets)).astype("int64")
            sent += [(g, tag + x) for g, x in packed(to, h[some], d[some], p[some], lo[some], hi[some], rows, bundle=bundle)]
        return sent, (d[again], lo[again], hi[again])

    def resolve(self, payloads: list[bytes]) -> tuple:
        out = [(np.zeros(0, "int64"),) * 4]
        for tag in (b"b", b"w"):
            bundle, h, d, p, lo, hi, rows = unpacked([x[1:] for x in payloads if x[:1] == tag], "<u8", "<i4", "<i4", "<i4", "<i4", ("u1", self.width))
            order, starts = groups_of(h)
            order = order[of_group(starts, np.diff(np.r_[starts, len(h)]) > 1, len(h))]
            k = 0
            while k < len(order):  # whole groups, about BATCH blocks at once
                end = min(len(order), k + BATCH)
                while end < len(order) and h[order[end]] == h[order[end - 1]]:
                    end += 1
                some = order[k:end]
                found = column_wise(rows[some], self.length)
                at = (p[some] - self.reach)[:, None] + np.arange(self.reach + 1)
                found &= (at >= lo[some][:, None]) & (at <= hi[some][:, None])
                edges = np.diff(np.pad(found, ((0, 0), (1, 1))).astype("int8"), axis=1)
                (row, a), (_, b) = np.nonzero(edges == 1), np.nonzero(edges == -1)
                out.append((bundle[some][row], d[some][row], p[some][row] - self.reach + a, p[some][row] - self.reach + b - 1))
                k = end
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    def cut(self, text: pa.Scalar, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> tuple[int, int, int, bytes]:
        """Bytes, bytes removed, maximal runs removed, and what is left."""
        raw = bytes(text.as_buffer() or b"")
        if lo is None:
            return len(raw), 0, 0, raw
        data = np.frombuffer(raw, "uint8")
        marks = np.zeros(len(data) + 1, "int64")
        np.add.at(marks, lo, 1)
        np.add.at(marks, hi.astype("int64") + self.length, -1)
        gone = np.cumsum(marks[:-1]) > 0
        return len(data), int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum()), data[~gone].tobytes()


def suffix_dedup(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return removed(docs, ByteWindows(length), id_col, text_col, **options).withColumnRenamed("n", "n_bytes")


def cut_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """``docs`` with texts cut; a character that lost a part of its bytes is dropped."""
    return without_repeats(docs, ByteWindows(length))
