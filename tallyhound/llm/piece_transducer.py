"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Compiled from a model file: a normaliser, arcs for the pieces, and byte fallback.

- The normaliser reads the longest key of the model's character map (a double array) or one character, and writes what
  it maps to; then spaces are trimmed, escaped and prefixed as the model says.
- A piece is an arc that reads its text, writes its id and weighs its negative score. A character without a piece has an
  arc that writes its bytes (or the unknown id) and weighs more than any piece.
- A merge-trained model's encoding is not the segmentation of the best score but the one in which every two neighbouring
  pieces, encoded together, give themselves. Its states therefore remember the last piece, and the weight of the arc to
  the next is 0 if that holds and infinite if not.

Composition with an input gives an acyclic lattice, made on the fly; its shortest path in the tropical semiring (weights
add along a path, the least of paths counts) is found by relaxing states in the order of the input.

Where no piece holds an escaped space behind other characters, an input falls apart before each word; each distinct word
of a batch is composed once, and remembered by its worker.

Cases: a null or empty text has no ids; repeated rows are encoded each; an empty table gives no rows; extra
columns are ignored. Models that are neither unigram nor merge-trained, or put spaces behind words, are refused.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhound.llm.best_fit import runs_of
from tallyhound.llm.staging import trim

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, GIVEN, UNUSED, BYTE = range(1, 7)
UNIGRAM, MERGE = 1, 2
CACHE_WORDS, CACHE_LINKS = 150_000, 300_000
#: Fixed value: how much more an unknown character weighs than the worst piece.
PENALTY = 10.0
#: Fixed value: what an unknown id is decoded to.
UNKNOWN_TEXT = " \u2047 "


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field number and value of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        else:
            size = number() if tag & 7 == 2 else {1: 8, 5: 4}[tag & 7]
            yield tag >> 3, raw[at : at + size]
            at += size


class CharacterMap:
    """A model's precompiled normalisation: a double array of UTF-8 keys and the texts they map to."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.texts = blob[4 + size :]

    def longest(self, raw: bytes, at: int) -> tuple[int, str] | None:
        """How many bytes the longest key at ``at`` has, and its text."""
        if not self.units:
            return None
        step = lambda unit: (unit >> 10) << ((unit & 512) >> 6)
        node, found = step(self.units[0]), None
        for k in range(at, len(raw)):
            node ^= raw[k]
            if node >= len(self.units) or self.units[node] & 0x800000FF != raw[k]:
                break
            unit = self.units[node]
            node ^= step(unit)
            if unit >> 8 & 1:
                found = k + 1 - at, self.units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.texts[found[1] : self.texts.index(b"\0", found[1])].decode()


class PieceTransducer:
    def __init__(self, model_file: str | bytes):
        if isinstance(model_file, str):
            with open(model_file, "rb") as f:
                model_file = f.read()
        message = list(_fields(model_file))
        pieces = [dict(_fields(v)) for k, v in message if k == 1]
        trainer, rules = (dict(_fields(next((v for k, v in message if k == n), b""))) for n in (2, 3))
        self.kind, self.fallback = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0))
        if self.kind not in (UNIGRAM, MERGE) or trainer.get(24, 0):
            raise ValueError("only unigram and merge models that put spaces before words")
        self.prefix, self.trims, self.escapes = (bool(rules.get(n, 1)) for n in (3, 4, 5))
        self.map = CharacterMap(rules.get(2, b""))
        self.texts = [p[1].decode() for p in pieces]
        self.kinds = [p.get(3, NORMAL) for p in pieces]
        score = [struct.unpack("<f", p[2])[0] if 2 in p else 0.0 for p in pieces]
        normal = [i for i, k in enumerate(self.kinds) if k == NORMAL]
        low, high = (min(score[i] for i in normal), max(score[i] for i in normal)) if normal else (0.0, 0.0)
        self.unknown = next((i for i, k in enumerate(self.kinds) if k == UNKNOWN), 0)
        self.ids = {self.texts[i]: i for i in normal}
        self.given = {t: i for i, t in enumerate(self.texts) if self.kinds[i] == GIVEN}
        self.score = {t: score[i] for t, i in self.ids.items()}
        #: text: (id, weight)
        self.arcs = {t: (i, np.float32(-score[i])) for t, i in self.ids.items()}
        self.arcs |= {t: (i, np.float32(0.1 - len(t.encode()) * high)) for t, i in self.given.items()}
        self.lone_weight = np.float32(PENALTY - low)
        self.bytes = {int(self.texts[i][3:5], 16): i for i, k in enumerate(self.kinds) if k == BYTE}
        self.longest = max(map(len, self.arcs), default=1)
        self.beside = {t[k : k + 2] for t in self.arcs for k in range(len(t) - 1)}
        # sums of scores are composed whole, so that ties fall as they do in one sum over the text
        self.falls_apart = self.kind == MERGE and self.fallback and not any(SPACE in t.lstrip(SPACE) for t in self.arcs)
        self.plain = not self.map.units and not self.trims and self.prefix and self.escapes and not self.given and self.falls_apart
        self.links: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def normalised(self, text: str) -> str:
        """What the normaliser writes for an input."""
        out, raw, at, spaced = [], text.encode(), 0, self.trims
        while at < len(raw):
            given = max((g for g in self.given if raw.startswith(g.encode(), at)), key=len, default=None)
            found = self.map.longest(raw, at) if given is None else (len(given.encode()), given)
            if found is None:
                size = 1 if raw[at] < 0x80 else 2 if raw[at] < 0xE0 else 3 if raw[at] < 0xF0 else 4
                found = size, raw[at : at + size].decode("utf-8", "replace")
            at, written = at + found[0], found[1]
            if spaced:
                written = written.lstrip(" ")
            if written:
                out.append(written)
                spaced = self.trims and written.endswith(" ")
        joined = "".join(out)
        if self.trims:
            joined = joined.rstrip(" ")
        if joined and self.prefix:
            joined = " " + joined
        return joined.replace(" ", SPACE) if self.escapes else joined

    def _merged(self, text: str) -> list[str]:
        """Merges of the best score first, leftmost if tied; for compiling links only."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((self.score[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.score), default=None)
            if best is None:
                break
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _linked(self, a: int, b: int) -> bool:
        """Whether the arc from piece a to b weighs nothing; from or to what is no normal piece it does."""
        if a < 0 or b < 0 or self.kinds[a] != NORMAL or self.kinds[b] != NORMAL:
            return True
        key = a << 32 | b
        found = self.links.get(key)
        if found is None:
            if len(self.links) >= CACHE_LINKS:
                self.links.clear()
            x, y = self.texts[a], self.texts[b]
            found = self.links[key] = self._merged(x + y) == [x, y]
        return found

    def compose(self, text: str, at: int) -> Iterator[tuple[int, int, np.float32]]:
        """The lattice's arcs from a position: end, id (negative for a character without a piece), weight."""
        single = False
        for end in range(at + 1, min(len(text), at + self.longest) + 1):
            arc = self.arcs.get(text[at:end])
            if arc is not None:
                single = single or end == at + 1
                yield end, *arc
        if not single:
            yield at + 1, -1, self.lone_weight

    def shortest(self, text: str) -> list[tuple[int, int]]:
        """(start, id) of the arcs of the shortest path."""
        if self.kind == MERGE:
            return self._reaching(text)
        # by position: weight, where from, arc
        best: list[tuple | None] = [None] * (len(text) + 1)
        best[0] = (np.float32(0), 0, -1)
        for at in range(len(text)):
            for end, piece, weight in self.compose(text, at):
                total, held = best[at][0] + weight, best[end]
                if held is None or total < held[0]:
                    best[end] = (total, at, piece)
        path, at = [], len(text)
        while at:
            _, start, piece = best[at]
            path.append((start, piece))
            at = start
        return path[::-1]

    def _reaching(self, text: str) -> list[tuple[int, int]]:
        """The path of weight 0: a state is a position and the piece before it."""
        arcs, n, longest, kinds, links = self.arcs, len(text), self.longest, self.kinds, self.links
        path: list[tuple[int, int]] = []
        reached: set[int] = set()
        # of each open state: its piece, its position, and the end of the next arc to try
        stack = [[-1, 0, min(n, longest)]]
        while True:
            last, at, end = top = stack[-1]
            while end > at:
                arc = arcs.get(text[at:end])
                end -= 1
                piece = -1 if arc is None and end == at and text[at] not in arcs else None if arc is None else arc[0]
                if piece is None:
                    continue
                state = end + 1 << 32 | piece & 0xFFFFFFFF
                if state in reached:
                    continue
                if last >= 0 and piece >= 0 and kinds[last] == NORMAL and kinds[piece] == NORMAL:
                    linked = links.get(last << 32 | piece)
                    if not (self._linked(last, piece) if linked is None else linked):
                        continue
                reached.add(state)
                top[2] = end
                path.append((at, piece))
                if end + 1 == n:
                    return path
                stack.append([piece, end + 1, min(n, end + 1 + longest)])
                break
            else:
                stack.pop()
                path.pop()

    def _word(self, text: str) -> bytes:
        """Ids of a part that starts at a border."""
        if not text:
            return b""
        if self.kind == MERGE:
            cuts = [k for k in range(1, len(text)) if text[k - 1 : k + 1] not in self.beside]
            if cuts:
                return b"".join(self._words([text[i:j] for i, j in zip([0, *cuts], [*cuts, len(text)], strict=True)]))
        out: list[int] = []
        for start, piece in self.shortest(text):
            if piece >= 0:
                out.append(piece)
            elif self.fallback:
                out += [self.bytes[b] for b in text[start].encode()]
            elif not out or out[-1] != self.unknown:  # a run of unknown characters is one
                out.append(self.unknown)
        return np.array(out, "<u4").tobytes()

    def _words(self, words: list[str]) -> list[bytes]:
        found = list(map(self.known.get, words))
        for i, ids in enumerate(found):
            if ids is None:
                ids = self.known.get(words[i])
                if ids is None:
                    ids = self.older.get(words[i])
                found[i] = self.known[words[i]] = self._word(words[i]) if ids is None else ids
        return found

    def _parts(self, text: str) -> list[str]:
        """Where a normalised text falls apart: before each run of escaped spaces."""
        return re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+$", text) if self.falls_apart else [text] if text else []

    def ids_of(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text. Words of texts that only need a space escaped are made distinct by Arrow."""
        if len(self.known) > CACHE_WORDS:
            self.older, self.known = self.known, {}
        odd = pc.match_substring_regex(texts, f"  |^ | $|{SPACE}|^$") if self.plain else pa.array(np.ones(len(texts), bool))
        lists = pc.split_pattern(pc.if_else(odd, "", texts), " ")
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        words = pc.dictionary_encode(lists.flatten())
        raw = self._words([SPACE + w if w else "" for w in words.dictionary.to_pylist()])
        lengths = np.fromiter(map(len, raw), "int64", len(raw)) // 4
        data, starts, index = np.frombuffer(b"".join(raw), "<u4"), np.cumsum(lengths) - lengths, words.indices.to_numpy()
        for i, strange in enumerate(odd.to_pylist()):
            if strange:
                yield self.encode(texts[i].as_py())
            else:
                mine = index[offsets[i] : offsets[i + 1]]
                n = lengths[mine]
                ends = np.cumsum(n)
                yield data[np.repeat(starts[mine] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]

    def encode(self, text: str) -> np.ndarray:
        """uint32 ids."""
        if self.plain:
            text = SPACE + text.replace(" ", SPACE) if text else ""
        else:
            text = self.normalised(text)
        return np.frombuffer(b"".join(self._words(self._parts(text))), "<u4")

    def surface(self, i: int) -> bytes:
        kind = self.kinds[i]
        if kind == BYTE:
            return bytes([int(self.texts[i][3:5], 16)])
        return b"" if kind == CONTROL else UNKNOWN_TEXT.encode() if kind == UNKNOWN else self.texts[i].replace(SPACE, " ").encode()

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.surface, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


_MADE: dict[str, PieceTransducer] = {}


def transducer(model_file: str) -> PieceTransducer:
    """One a process: Python workers serve many tasks."""
    if model_file not in _MADE:
        _MADE[model_file] = PieceTransducer(model_file)
    return _MADE[model_file]


def encode_documents(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, ids (array<int>)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(model_file)
        for batch in batches:
            raw = [ids for some in runs_of(batch.column(1)) for ids in t.ids_of(some)]
            ends = np.cumsum([0, *map(len, raw)]).astype("int32")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, "<u4"), *raw]).astype("<i4")))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, "doc_id long, ids array<int>")


def decode_ids(rows: DataFrame, model_file: str) -> DataFrame:
    """doc_id, text from doc_id, ids."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(model_file)
        for batch in batches:
            texts = [t.decode(np.asarray(x, "<u4")) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(decode, "doc_id long, text string")


def round_trip(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_ids, n_byte_ids, ids_crc32, decoded_sha256, same (decoding gives what the normaliser wrote)."""
    schema = "doc_id long, n_ids long, n_byte_ids long, ids_crc32 long, decoded_sha256 string, same boolean"

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(model_file)
        pieces = [t.surface(i) for i in range(len(t.texts))]
        lengths, data = np.array([len(p) for p in pieces]), np.frombuffer(b"".join(pieces), "uint8")
        starts, is_byte = np.cumsum(lengths) - lengths, np.array([k == BYTE for k in t.kinds])
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            encoded = ((text, ids) for some in runs_of(batch.column(1)) for text, ids in zip(some, t.ids_of(some), strict=True))
            for text, ids in encoded:
                n = lengths[ids]
                ends = np.cumsum(n)
                decoded = data[np.repeat(starts[ids] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
                decoded = decoded[1:] if t.prefix and decoded[:1] == b" " else decoded
                if t.plain:
                    wanted = bytes(text.as_buffer()).replace(SPACE.encode(), b" ")
                else:
                    wanted = t.normalised(text.as_py()).replace(SPACE, " ").encode()[int(t.prefix) :]
                for column, x in zip(out, (len(ids), int(is_byte[ids].sum()), zlib.crc32(ids.tobytes()), hashlib.sha256(decoded).hexdigest(), decoded == wanted), strict=True):
                    column.append(x)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, x) for c, x in zip(out, types, strict=True))], names=["doc_id", "n_ids", "n_byte_ids", "ids_crc32", "decoded_sha256", "same"])
            trim()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(both, schema)
