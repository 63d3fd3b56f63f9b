"""Best-two-fit packing of tokenised documents into fixed-length sequences.

Tokenisation: a word's ids do not depend on its neighbours (the tokenizer drops white space), so each
distinct white-space-separated word is encoded once while its worker remembers it, and texts are joined
from cached id bytes.
Texts holding white space or controls beyond ASCII's six are encoded whole.

Packing: pieces are dealt evenly by a number of their own (whatever their ids) to groups of about ``group_rows`` pieces, so memory is bounded
and a group's one open end costs under 0.02 % of its sequences. In a group, a bin takes the longest
unpacked pieces that fit, then its smallest piece is replaced by the two unpacked pieces whose sum fits
the expanded gap most tightly. Lengths are small integers, so "longest that fits" and "tightest pair"
are operations on bit sets of the lengths left.

Cases: a null or empty text is the separator alone; a null id stays null; repeated rows are packed each;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhound.llm.staging import stage, trim

ODD_SPACE = r"[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
#: Latin, Greek and Cyrillic letters that a normaliser leaves letters (dotted capital I becomes a letter and a mark) and that
#: all versions of Unicode's classes have; a word of others is not cut.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f\u0391-\u03a1\u03a3-\u03c9\u0400-\u04ff"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"
CACHE_WORDS = 250_000


class WordEncoder:
    """Little-endian uint32 id bytes of whole texts.

    The words of a batch are made distinct by Arrow. A word of ``LETTERS`` and then ASCII marks is split there, as
    the tokenizer does. Parts not seen yet are encoded together in one text; two generations of about
    ``CACHE_WORDS`` parts are remembered, so frequent ones stay and memory is bounded.
    """

    MARK = "\x01"
    PARTS = rf"^(?P<core>[{LETTERS}]+)(?P<marks>[!-/:-@\[-`{{-~]*)$"

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.word_end, self.is_mark = np.zeros((2, max(vocabulary.values()) + 1), bool)
        self.word_end[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.is_mark[np.frombuffer(self._whole(self.MARK), "<u4")[0]] = True

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, parts: list[str], apart: str, last: np.ndarray, gap: int) -> None:
        """Encodes runs of parts with ``apart`` after each; ``last`` tells the ids that end a part, of which
        the last ``gap`` are not its own."""
        runs = [parts[k : k + 4000] for k in range(0, len(parts), 4000)]
        for run, found in zip(runs, self.tokenizer.encode_batch_fast([apart.join([*r, ""]) for r in runs], add_special_tokens=False), strict=True):
            ids = np.asarray(found.ids, dtype="<u4")
            ends = (np.flatnonzero(last[ids]) * 4 + 4).tolist()
            if len(ends) != len(run):
                self.known |= {p: self._whole(p) for p in run}
                continue
            raw = ids.tobytes()
            self.known.update(zip(run, (raw[i : j - 4 * gap] for i, j in zip([0, *ends], ends, strict=False)), strict=True))

    def _ids_of(self, parts: list[str], letters: bool) -> list[bytes]:
        found = list(map(self.known.get, parts))
        holes = [i for i, v in enumerate(found) if v is None]
        older = [(parts[i], self.older.get(parts[i])) for i in holes]
        self.known.update(x for x in older if x[1] is not None)
        fresh = [p for p, v in older if v is None]
        self._learn(fresh, *((" ", self.word_end, 0) if letters else (f" {self.MARK} ", self.is_mark, 1)))
        for i in holes:
            found[i] = self.known[parts[i]]
        return found

    def _distinct(self, words: pa.StringArray) -> tuple[list[bytes], np.ndarray]:
        """Ids of parts, the first empty, and each word's two parts."""
        cut = pc.extract_regex(words, self.PARTS)
        split = cut.is_valid()
        core, marks = (pc.dictionary_encode(pc.filter(pc.struct_field(cut, k), split)) for k in (0, 1))
        raw = [b"", *self._ids_of(core.dictionary.to_pylist(), True)]
        parts, split = np.zeros((len(words), 2), "int64"), split.to_numpy(zero_copy_only=False)
        parts[split, 0] = core.indices.to_numpy() + 1
        parts[split, 1] = marks.indices.to_numpy() + len(raw)
        raw += self._ids_of(marks.dictionary.to_pylist(), False)
        parts[~split, 0] = np.arange(len(raw), len(raw) + int((~split).sum()))
        raw += self._ids_of(pc.filter(words, pa.array(~split)).to_pylist(), False)
        return raw, parts

    def ids(self, texts: pa.StringArray) -> Iterator[bytes]:
        if len(self.known) > CACHE_WORDS:
            self.older, self.known = self.known, {}
        odd = pc.or_(pc.match_substring_regex(texts, ODD_SPACE), pc.match_substring(texts, self.MARK))
        lists = pc.ascii_split_whitespace(pc.if_else(odd, "", texts))
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        words = pc.dictionary_encode(lists.flatten())
        raw, parts = self._distinct(words.dictionary)
        data = np.frombuffer(b"".join(raw), "<u4")
        lengths = np.fromiter(map(len, raw), "int64", len(raw)) // 4
        starts = np.cumsum(lengths) - lengths
        index = words.indices.to_numpy()
        for i, strange in enumerate(odd.to_pylist()):
            if strange:
                yield self._whole(texts[i].as_py())
            else:
                mine = parts[index[offsets[i] : offsets[i + 1]]].ravel()
                n = lengths[mine]
                ends = np.cumsum(n)
                yield data[np.repeat(starts[mine] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)].tobytes()


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(tokenizer_file: str) -> WordEncoder:
    """One a process: Python workers serve many tasks."""
    if tokenizer_file not in _ENCODERS:
        _ENCODERS[tokenizer_file] = WordEncoder(tokenizer_file)
    return _ENCODERS[tokenizer_file]


def runs_of(texts: pa.Array, size: int = 8 << 20) -> Iterator[pa.StringArray]:
    """Slices of about ``size`` bytes of texts, nulls as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy())
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield texts.slice(at, to - at).cast(pa.string())
        at = to


def tokenised_pieces(docs: DataFrame, tokenizer_file: str, length: int = 2048, separator: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document's ids and the separator, cut at ``length``."""
    end = int(separator).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer_file)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            encoded = (ids for some in runs_of(batch.column(1)) for ids in words.ids(some))
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoded, strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at : at + 4 * length]
                    for column, value in zip(out, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
            trim()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def best_two_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins as lists of indices into ``lengths`` (each from 1 to ``capacity``)."""
    left: dict[int, list[int]] = defaultdict(list)
    for i in range(len(lengths) - 1, -1, -1):
        left[lengths[i]].append(i)
    have = sum(1 << size for size in left)
    mirrored = sum(1 << (capacity - size) for size in left)

    def take(size: int) -> int:
        nonlocal have, mirrored
        i = left[size].pop()
        if not left[size]:
            have ^= 1 << size
            mirrored ^= 1 << (capacity - size)
        return i

    def put(size: int, i: int) -> None:
        nonlocal have, mirrored
        left[size].append(i)
        have |= 1 << size
        mirrored |= 1 << (capacity - size)

    bins = []
    while have:
        gap, members = capacity, []
        while fits := have & ((1 << (gap + 1)) - 1):
            size = fits.bit_length() - 1
            members.append((size, take(size)))
            gap -= size
        if gap:
            size, i = members[-1]  # the longest that fits comes first, so the last is the smallest
            for total in range(gap + size, size, -1):
                pairs = have & (mirrored >> (capacity - total))
                if total % 2 == 0 and len(left.get(total // 2, ())) == 1:
                    pairs &= ~(1 << (total // 2))  # a length that is there once can't pair with itself
                if pairs:
                    a = pairs.bit_length() - 1
                    members[-1:] = [(a, take(a)), (total - a, take(total - a))]
                    put(size, i)
                    break
        bins.append([i for _, i in members])
    return bins


def pack(pieces: DataFrame, length: int = 2048, group_rows: int = 16_384) -> DataFrame:
    """Adds sequence_id and offset to the pieces."""
    pieces = stage(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-pieces.count() // group_rows))

    def packed(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        lengths = rows.column("length").to_pylist()
        sequence, offset = np.zeros(len(lengths), "int64"), np.zeros(len(lengths), "int64")
        for k, members in enumerate(best_two_fit(lengths, length)):
            at = 0
            for i in members:
                sequence[i], offset[i] = (key[0].as_py() << 32) + k, at
                at += lengths[i]
        rows = rows.drop_columns(["g", "row"])
        return rows.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    dealt = pieces.withColumn("g", F.pmod(F.xxhash64("row"), F.lit(groups)))
    return dealt.groupBy("g").applyInArrow(packed, PACKED)


def pack_documents(docs: DataFrame, tokenizer_file: str, length: int = 2048, separator: int = 0) -> DataFrame:
    return pack(tokenised_pieces(docs, tokenizer_file, length, separator), length)
