"""Token ids as flat unsigned integer files with 64-bit document offsets.

Documents are dealt by ranges of ``doc_id`` and sorted in their range; each task encodes its range and writes two files below one
shared folder: ``<name>.bin``, all ids one after the other in little-endian unsigned integers (16 bits where the vocabulary fits,
else 32), and ``<name>.idx``, a header, the documents' offsets, counted in ids, in 64 bits, their doc_ids, and a byte each that is
1 for a null id. Names are new for each attempt of a task and only those of
attempts that Spark commits get into ``manifest``, a Parquet table with one row a file, so lost executors leave no wrong
file behind. The first document and id of each file are prefix sums over that table. Readers map both files into memory.

A word with the white space before it is encoded the same wherever it stands, so each distinct one is
encoded once while a worker remembers it. Texts with white space or controls beyond ASCII's four are encoded whole.

Cases: null and empty texts are the end id alone; null ids come first; rows that repeat an id stand in the order in which they are
read; an empty table gives no file and no rows; extra columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhound.llm.best_fit import CACHE_WORDS, LETTERS, ODD_SPACE, runs_of
from tallyhound.llm.staging import SMALL_PAGES, shared_dir, trim

MAGIC = b"TOKENIDX"
HEADER, BEHIND = "<8sQQ", 24  # magic, bytes an id, documents
MANIFEST = "part int, name string, docs long, tokens long, width int"
READ = "doc_id long, start long, n_tokens long, ids binary"


class Memory:
    """Ids of strings that were encoded before: two generations of about ``CACHE_WORDS``, so frequent ones stay."""

    def __init__(self, learn):
        self.learn, self.known, self.older = learn, {}, {}

    def ids_of(self, strings: list[str]) -> list[bytes]:
        if len(self.known) > CACHE_WORDS:
            self.older, self.known = self.known, {}
        found = list(map(self.known.get, strings))
        holes = [i for i, v in enumerate(found) if v is None]
        older = [(strings[i], self.older.get(strings[i])) for i in holes]
        self.known.update(x for x in older if x[1] is not None)
        fresh = [s for s, v in older if v is None]
        for at in range(0, len(fresh), 4000):
            some = fresh[at : at + 4000]
            self.known.update(zip(some, self.learn(some), strict=True))
        for i in holes:
            found[i] = self.known[strings[i]]
        return found


class ChunkEncoder:
    """Ids of whole texts for a byte-level tokenizer without a normaliser.

    Texts are cut before each space. Where a space stands between white space, or after some at the end, the runs of white space
    matter: such texts are cut before each run instead. A word of letters and then ASCII marks is cut there once more, as the tokenizer does;
    words are encoded in runs, in which the ids that begin with a space tell them apart.
    """

    CUT = "\x01"
    ODD = rf"{ODD_SPACE}|[\x0b\x0c{CUT}]"
    RUNS = r"[ \t\n\r] ([ \t\n\r]|$)"
    WORD = rf"^(?P<core>[{LETTERS}]+)(?P<marks>[!-/:-@\[-`{{-~]*)$"

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        self.begins = np.zeros(self.size, bool)
        self.begins[[i for piece, i in vocabulary.items() if piece.startswith("\u0120")]] = True
        self.words, self.others = Memory(self._learn_words), Memory(self._whole)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_words(self, words: list[str]) -> list[bytes]:
        """Each word behind a space."""
        raw = self._whole([" " + " ".join(words)])[0]
        at = (np.flatnonzero(self.begins[np.frombuffer(raw, "<u4")]) * 4).tolist()
        return [raw[a:b] for a, b in zip(at, [*at[1:], len(raw)], strict=True)] if len(at) == len(words) else self._whole([" " + w for w in words])

    def _listed(self, lists: pa.ListArray, space: str) -> Iterator[np.ndarray]:
        """Ids of each list of chunks; behind its first one, ``space`` stands before each."""
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        flat = lists.flatten()
        chunks, firsts = pc.dictionary_encode(flat), pc.dictionary_encode(flat.take(pa.array(offsets[:-1])))
        cut = pc.extract_regex(chunks.dictionary, self.WORD) if space else pa.nulls(len(chunks.dictionary), pa.struct([("core", pa.string()), ("marks", pa.string())]))
        split = cut.is_valid()
        core, marks = (pc.dictionary_encode(pc.filter(pc.struct_field(cut, k), split)) for k in (0, 1))
        raw = [b"", *self.words.ids_of(core.dictionary.to_pylist())]
        split, parts = split.to_numpy(zero_copy_only=False), np.zeros((len(chunks.dictionary) + len(firsts.dictionary), 2), "int64")
        place = np.flatnonzero(split)
        parts[place, 0] = core.indices.to_numpy() + 1
        parts[place, 1] = marks.indices.to_numpy() + len(raw)
        raw += self.others.ids_of(marks.dictionary.to_pylist())
        rest = [space + c for c in chunks.dictionary.filter(pa.array(~split)).to_pylist()] + firsts.dictionary.to_pylist()
        parts[np.r_[np.flatnonzero(~split), len(split) : len(parts)], 0] = np.arange(len(raw), len(raw) + len(rest))
        raw += self.others.ids_of(rest)
        index = chunks.indices.to_numpy().astype("int64")
        index[offsets[:-1]] = firsts.indices.to_numpy() + len(split)
        data, lengths = np.frombuffer(b"".join(raw), "<u4"), np.fromiter(map(len, raw), "int64", len(raw)) // 4
        starts = np.cumsum(lengths) - lengths
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            mine = parts[index[a:b]].ravel()
            n = lengths[mine]
            ends = np.cumsum(n)
            yield data[np.repeat(starts[mine] - ends + n, n) + np.arange(ends[-1])]

    def ids(self, texts: pa.StringArray) -> Iterator[np.ndarray]:
        odd = pc.match_substring_regex(texts, self.ODD)
        runs = pc.and_not(pc.match_substring_regex(texts, self.RUNS), odd)
        even = pc.invert(pc.or_(odd, runs))
        marked = pc.replace_substring_regex(texts.filter(runs), r"([^\t\n\r ])([\t\n\r ])", f"\\1{self.CUT}\\2")
        by_space, by_run = self._listed(pc.split_pattern(texts.filter(even), " "), " "), self._listed(pc.split_pattern(marked, self.CUT), "")
        for i, (strange, run) in enumerate(zip(odd.to_pylist(), runs.to_pylist(), strict=True)):
            yield np.frombuffer(self._whole([texts[i].as_py()])[0], "<u4") if strange else next(by_run if run else by_space)


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(tokenizer_file: str) -> ChunkEncoder:
    """One a process: Python workers serve many tasks."""
    if tokenizer_file not in _ENCODERS:
        _ENCODERS[tokenizer_file] = ChunkEncoder(tokenizer_file)
    return _ENCODERS[tokenizer_file]


def store(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a folder and its path there: any that Arrow reaches."""
    return pyarrow.fs.FileSystem.from_uri("/" + uri[5:].lstrip("/") if uri.startswith("file:") else uri)


def contents(files: pyarrow.fs.FileSystem, path: str) -> pa.Buffer:
    """A file, mapped into memory where it lies on a mounted file system."""
    if isinstance(files, pyarrow.fs.LocalFileSystem):
        return pa.memory_map(path).read_buffer()
    with files.open_input_file(path) as f:
        return f.read_buffer()


def write_token_files(docs: DataFrame, tokenizer_file: str, folder: str, end: int = 0, files: int | None = None) -> None:
    """Writes the files of ``docs`` (doc_id, text) and their manifest below ``folder``; about ``files`` pairs of them, by default as Spark
    deals the rows."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, (target, base) = encoder(tokenizer_file), store(folder)
        width = 2 if max(words.size, end + 1) <= 1 << 16 else 4
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        lengths, doc_ids, out = [], [], None
        for batch in batches:
            if batch.num_rows and out is None:
                target.create_dir(base, recursive=True)
                out = target.open_output_stream(f"{base}/{name}.bin")
            for texts in runs_of(batch.column(1)):
                for ids in words.ids(texts):
                    out.write(np.append(ids, np.uint32(end)).astype(f"<u{width}").tobytes())
                    lengths.append(len(ids) + 1)
            doc_ids.append(batch.column(0))
            trim()
        if out is None:
            return
        out.close()
        ids = pa.chunked_array(doc_ids)
        with target.open_output_stream(f"{base}/{name}.idx") as idx:
            idx.write(struct.pack(HEADER, MAGIC, width, len(ids)))
            idx.write(np.cumsum([0, *lengths]).astype("<u8").tobytes())
            idx.write(pc.fill_null(ids, 0).to_numpy().astype("<i8").tobytes())
            idx.write(ids.is_null().to_numpy().astype("u1").tobytes())
        row = [TaskContext.get().partitionId(), name, len(ids), int(sum(lengths)), width]
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["part", "name", "docs", "tokens", "width"])

    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("row"))
    dealt = rows.repartitionByRange(*([files] if files else []), "doc_id", "row").sortWithinPartitions("doc_id", "row").select("doc_id", "text")
    dealt.mapInArrow(write, MANIFEST).write.options(**SMALL_PAGES).parquet(f"{folder}/parts")
    # one row a file: the bases are prefix sums in the order of the ranges
    parts = sorted(spark.read.schema(MANIFEST).parquet(f"{folder}/parts").collect())
    bases = zip(accumulate((p.docs for p in parts), initial=0), accumulate((p.tokens for p in parts), initial=0), strict=True)
    manifest = spark.createDataFrame([(*p, *b) for p, b in zip(parts, bases, strict=False)], MANIFEST + ", first_doc long, first_token long")
    manifest.write.parquet(f"{folder}/manifest")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids (little-endian unsigned 32-bit) of each document."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = store(folder)
        for batch in batches:
            for part in batch.to_pylist():
                index, data = (contents(files, f"{base}/{part['name']}.{x}") for x in ("idx", "bin"))
                magic, width, n = struct.unpack_from(HEADER, index)
                at = np.frombuffer(index, "<u8", n + 1, BEHIND).astype("int64")
                doc_id = np.frombuffer(index, "<i8", n, BEHIND + 8 * (n + 1))
                null = np.frombuffer(index, "u1", n, BEHIND + 8 * (2 * n + 1)).astype(bool)
                if magic != MAGIC or (n, at[-1]) != (part["docs"], part["tokens"]) or data.size != width * at[-1]:
                    raise ValueError(f"{part['name']}: damaged files")
                tokens, a = np.frombuffer(data, f"<u{width}"), 0
                while a < n:
                    b = max(a + 1, int(np.searchsorted(at, at[a] + (1 << 20), "right")) - 1)
                    some = tokens[at[a] : at[b]].astype("<u4").tobytes()
                    cuts = (at[a : b + 1] - at[a]) * 4
                    ids = pa.array([some[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(doc_id[a:b], mask=null[a:b]), pa.array(part["first_token"] + at[a:b]), pa.array(np.diff(at[a : b + 1])), ids], names=["doc_id", "start", "n_tokens", "ids"])
                    a = b

    manifest = spark.read.parquet(f"{folder}/manifest")
    return manifest.repartition(max(1, manifest.count())).mapInArrow(read, READ)


def round_trip(docs: DataFrame, tokenizer_file: str, end: int = 0) -> DataFrame:
    """``docs`` written to new files in the shared folder, and read back."""
    folder = f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_token_files(docs, tokenizer_file, folder, end)
    return read_token_files(docs.sparkSession, folder)
