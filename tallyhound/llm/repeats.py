"""The frame shared by the two operators that remove repeated passages.

1. Rows are bound into bundles of about ``BUNDLE_BYTES`` of text, written once; a row's identity is its bundle and
   its place there, so null, repeated or clashing ids are documents of their own. A bundle gives (hash, place,
   position) anchors such that two equal passages share an aligned one. It first combines its own: an anchor seen
   twice there is known to repeat, and one of its occurrences stands for it. These are dealt by hash to buckets.
2. A bucket finds the anchors that occur twice or more; their positions go back to their bundles.
3. Bundles expand their documents around such positions to what must be compared exactly, again combined where
   they are and dealt by hash.
4. A bucket resolves the ranges to remove; 5. bundles cut their documents.

A bundle is a bounded piece of input and a bucket about ``BUCKET_BYTES`` of it, whatever the input's size; no key of
the data is a group. No pairs are made, and what repeats is combined before it moves. An anchor with more than
``HOT_LEAST`` occurrences is *hot*: the ``HOT_MOST`` most frequent of those (8 MB, broadcast) are expanded to single
strings instead of surroundings. Step 2 finds those that repeat; the regions around hot anchors, cut out in step 3,
give their bytes. All others, and hot ones beyond that number, take the common way.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tallyhound.llm.staging import discard, stage, trim

BUNDLE_BYTES = 4 << 20
BUCKET_BYTES = 32 << 20
HOT_LEAST, HOT_MOST = 20_000, 1_000_000
CHUNK = 1 << 19
NO_HASHES = np.zeros(0, "uint64")
BUNDLES = pa.schema([("bundle", pa.int64()), ("payload", pa.binary())])
BOUND = pa.schema([("kind", pa.int32()), ("bundle", pa.int64()), ("g", pa.int32()), ("payload", pa.binary())])
PLACES = pa.schema([("bundle", pa.int64()), ("payload", pa.binary()), ("h", pa.int64()), ("n", pa.int64())])
ANCHORS, KNOWN, STRINGS, STRINGS_KNOWN, REGIONS = range(5)


def ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} { {'int32': 'int', 'int64': 'long', 'binary': 'binary'}[str(f.type)]}" for f in schema)


def table_of(schema: pa.Schema, rows: int, **columns) -> pa.RecordBatch:
    """The columns named, nulls for all others."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in schema], schema=schema)


def by_key(keys: np.ndarray, *values: np.ndarray) -> dict[int, tuple]:
    """Each key's values."""
    if not len(keys):
        return {}
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], [v[order] for v in values]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return {k: tuple(v[i:j] for v in values) for k, i, j in zip(keys[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=True)}


def planes(column: np.ndarray) -> bytes:
    """A column's first bytes, then its second bytes and so on, which compress well; rows of bytes as they are."""
    if column.ndim > 1:
        return column.tobytes()
    return np.ascontiguousarray(column.view("uint8").reshape(-1, column.itemsize).T).tobytes()


def packed(to: np.ndarray, *columns: np.ndarray, bundle: int = 0) -> list[tuple[int, bytes]]:
    """(target, bytes) for each target that gets entries: their count and bundle, the first column plain, the others
    compressed."""
    order = np.argsort(to, kind="stable")
    keys, starts = np.unique(to[order], return_index=True)
    out = []
    for key, a, b in zip(keys.tolist(), starts.tolist(), [*starts[1:].tolist(), len(to)], strict=False):
        i = order[a:b]
        rest = b"".join(planes(c[i]) for c in columns[1:])
        out.append((key, np.array([b - a, bundle], "<i8").tobytes() + columns[0][i].tobytes() + zlib.compress(rest, 1)))
    return out


def unpacked(payloads: list[bytes], *dtypes: str) -> list[np.ndarray]:
    """The bundle of each entry, then the columns. A dtype may be an array of bytes as ``(u1, width)``."""
    types = [np.dtype(d) for d in dtypes]
    columns: list[list[np.ndarray]] = [[np.zeros(0, "int64")], *([np.zeros((0, *d.shape), d.base)] for d in types)]
    for b in payloads:
        n, bundle = np.frombuffer(b, "<i8", 2).tolist()
        columns[0].append(np.full(n, bundle))
        columns[1].append(np.frombuffer(b, types[0], n, 16))
        rest, at = zlib.decompress(b[16 + n * types[0].itemsize :]), 0
        for column, dtype in zip(columns[2:], types[1:], strict=True):
            raw = np.frombuffer(rest, "uint8", n * dtype.itemsize, at)
            at += n * dtype.itemsize
            column.append(raw.reshape(n, -1) if dtype.subdtype else np.ascontiguousarray(raw.reshape(dtype.itemsize, n).T).view(dtype).ravel())
    return [np.concatenate(c) for c in columns]


def groups_of(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by h and where its groups start in that order."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    return order, np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, "int64")


def of_group(starts: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    return np.repeat(values, np.diff(np.r_[starts, rows]))


def sealed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def opened(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(payload)).read_all().combine_chunks()


def texts_of(rows: pa.Table) -> pa.Array:
    """A bundle's texts, null as empty."""
    column = rows.column("text")
    return (column.chunk(0) if column.num_chunks else pa.array([], pa.string())).fill_null("")


def combined(bundle: int, found: tuple, buckets: int) -> tuple[list[tuple[int, bytes]], list[tuple[int, bytes]]]:
    """A bundle's anchors (hash, place, position): one of each hash for the buckets, and those known to repeat."""
    h, d, p = found
    order, starts = groups_of(h)
    counts = np.diff(np.r_[starts, len(h)])
    first = order[starts]
    again = order[of_group(starts, counts > 1, len(h))]
    known = packed(np.zeros(len(again), "int64"), d[again], p[again], bundle=bundle)
    return packed((h[first] % np.uint64(buckets)).astype("int64"), h[first], d[first], p[first], counts.astype("int32"), bundle=bundle), known


def bound_rows(bundle: int, dealt: list[tuple[int, list[tuple[int, bytes]]]]) -> pa.RecordBatch:
    """Rows of a bundle from (kind, [(bucket, payload)])."""
    kinds = [kind for kind, some in dealt for _ in some]
    return table_of(BOUND, len(kinds), kind=kinds, bundle=[bundle] * len(kinds), g=[g for _, some in dealt for g, _ in some], payload=[b for _, some in dealt for _, b in some])


def bound(rows: DataFrame) -> DataFrame:
    """Bundles of rows (id, text and what else they hold)."""

    def bind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        size = 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal held, size, number
            if held:
                payload = sealed(pa.Table.from_batches(held).combine_chunks())
                held, size = [], 0
                yield table_of(BUNDLES, 1, bundle=[number], payload=[payload])
                number += 1
                trim()

        for batch in batches:
            lengths = pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False)
            ends, at = np.cumsum(lengths), 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, BUNDLE_BYTES - size + (ends[at - 1] if at else 0), "right")))
                part = int(ends[to - 1] - (ends[at - 1] if at else 0))
                if held and size + part > BUNDLE_BYTES:
                    yield from close()
                    continue
                held.append(batch.slice(at, to - at))
                size, at = size + part, to
        yield from close()

    return rows.mapInArrow(bind, ddl(BUNDLES))


def anchored(bundles: DataFrame, matcher, buckets: int) -> DataFrame:
    """The bundles' anchors; those known to repeat are dealt anywhere."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bundle, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                some, known = combined(bundle, matcher.anchors(texts_of(opened(payload.as_py()))), buckets)
                yield bound_rows(bundle, [(ANCHORS, some), (KNOWN, [(bundle % buckets, x) for _, x in known])])
            trim()

    return bundles.mapInArrow(find, ddl(BOUND))


def met(anchors: DataFrame, hot_least: int) -> DataFrame:
    """bundle, payload: where anchors that occur again are; and h, n of those that may be hot."""

    def meet(group: pa.Table) -> pa.Table:
        of_kind = [group.filter(pc.equal(pc.is_in(group.column("kind"), pa.array([KNOWN, STRINGS_KNOWN], pa.int32())), known)) for known in (False, True)]
        bundle, h, d, p, c = unpacked(of_kind[0].column("payload").to_pylist(), "<u8", "<i4", "<i4", "<i4")
        order, starts = groups_of(h)
        members, total = np.diff(np.r_[starts, len(h)]), np.add.reduceat(c[order].astype("int64"), starts) if len(h) else starts
        here = order[of_group(starts, members > 1, len(h))]
        here = here[c[here] == 1]
        back, many = packed(bundle[here], d[here], p[here]), total > hot_least
        hots = h[order[starts[many]]].view("int64")
        known = of_kind[1].select(["bundle", "payload"])
        out = [table_of(PLACES, len(back), bundle=[b for b, _ in back], payload=[x for _, x in back]), table_of(PLACES, len(hots), h=hots, n=total[many])]
        out.append(table_of(PLACES, known.num_rows, bundle=known.column("bundle").to_pylist(), payload=known.column("payload").to_pylist()))
        trim()
        return pa.Table.from_batches(out)

    return anchors.groupBy("g").applyInArrow(meet, ddl(PLACES))


def range_payload(known: tuple) -> list[tuple[int, bytes]]:
    d, lo, hi = (x.astype("int32") for x in known)
    return packed(np.zeros(len(d), "int64"), d, lo, hi)


def digest(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def cut_rows(docs: DataFrame, matcher, id_col: str, text_col: str, with_rows: bool, hot_least: int, bundle_buckets: int | None) -> DataFrame:
    """id, n, n_removed, n_spans, kept_sha256 of every row; ``with_rows``: text (kept; bytes that are no longer UTF-8
    are dropped) and row, a struct of the other columns."""
    spark = docs.sparkSession
    others = [c for c in docs.columns if c != text_col]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *([F.struct(*others).alias("row")] if with_rows and others else []))
    size = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    buckets = bundle_buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    least = hot_least

    bundles = stage(bound(rows), "bundles")
    places = stage(met(anchored(bundles, matcher, buckets), least), "places")
    hot = None
    if matcher.splits_hot:
        # at most HOT_MOST hashes of 8 bytes
        found = places.filter(F.col("n") > least).orderBy(F.desc("n"), "h").limit(HOT_MOST).select("h").collect()
        hot = spark.sparkContext.broadcast(np.sort(np.array([r.h for r in found], "int64").view("uint64"))) if found else None

    def positions(right: pa.Table) -> dict[int, np.ndarray]:
        return {d: np.unique(p) for d, (p,) in by_key(*unpacked(right.column("payload").to_pylist(), "<i4", "<i4")[1:]).items()}

    def expand(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """left: a bundle, right: the positions of its anchors that repeat."""
        if not left.num_rows or not right.num_rows:
            return BOUND.empty_table()
        bundle, table = key[0].as_py(), opened(left.column("payload")[0].as_py())
        texts = texts_of(table)
        work = [(d, texts[d], p) for d, p in sorted(positions(right).items())]
        some, known = matcher.expand(bundle, work, table.column("id"), buckets, hot.value if hot else NO_HASHES)
        dealt = [(ANCHORS, some), (KNOWN, range_payload(known))]
        if hot:
            found, regions = matcher.hot_strings(work, hot.value)
            first, again = combined(bundle, found, buckets)
            dealt += [(STRINGS, first), (STRINGS_KNOWN, [(bundle % buckets, x) for _, x in again]), (REGIONS, [(0, sealed(regions))] if regions.num_rows else [])]
        out = bound_rows(bundle, dealt)
        del table, texts, work
        trim()
        return pa.Table.from_batches([out])

    where = places.filter(F.col("bundle").isNotNull()).select("bundle", "payload")
    expanded = stage(bundles.groupBy("bundle").cogroup(where.groupBy("bundle")).applyInArrow(expand, ddl(BOUND)), "expanded")
    discard(places)
    resolvable = expanded.filter(F.col("kind").isin(ANCHORS, KNOWN))
    if hot:

        def single(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            """left: a bundle's regions around hot anchors, right: the strings in them that repeat."""
            if not left.num_rows or not right.num_rows:
                return BOUND.empty_table()
            some, known = matcher.strings(key[0].as_py(), opened(left.column("payload")[0].as_py()), positions(right), buckets)
            trim()
            return pa.Table.from_batches([bound_rows(key[0].as_py(), [(ANCHORS, some), (KNOWN, range_payload(known))])])

        strings = met(expanded.filter(F.col("kind").isin(STRINGS, STRINGS_KNOWN)), 1 << 62).filter(F.col("bundle").isNotNull()).select("bundle", "payload")
        regions = expanded.filter(F.col("kind") == REGIONS).select("bundle", "payload")
        single_strings = stage(regions.groupBy("bundle").cogroup(strings.groupBy("bundle")).applyInArrow(single, ddl(BOUND)), "hot-strings")
        resolvable = resolvable.unionByName(single_strings)
    def resolve(group: pa.Table) -> pa.Table:
        bundle, d, lo, hi = matcher.resolve(group.column("payload").to_pylist())
        back = packed(bundle, d.astype("int32"), lo.astype("int32"), hi.astype("int32"))
        trim()
        return pa.Table.from_batches([table_of(BUNDLES, len(back), bundle=[b for b, _ in back], payload=[x for _, x in back])])

    ranges = resolvable.filter(F.col("kind") == ANCHORS).select("g", "payload").groupBy("g").applyInArrow(resolve, ddl(BUNDLES))
    ranges = stage(ranges.unionByName(resolvable.filter(F.col("kind") == KNOWN).select("bundle", "payload")), "ranges")
    for staged in (expanded, *([single_strings] if hot else [])):
        discard(staged)
    numbers = ["n", "n_removed", "n_spans"]
    names = ["text", "row"] if with_rows else ["id", *numbers, "kept_sha256"]
    fields = [StructField("id", LongType()), *(StructField(c, LongType()) for c in numbers), StructField("kept_sha256", StringType()), StructField("text", StringType()), *([rows.schema["row"]] if "row" in rows.columns else [])]
    schema = StructType([f for f in fields if f.name in names])

    def cut(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        table = opened(left.column("payload")[0].as_py())
        at = by_key(*unpacked(right.column("payload").to_pylist(), "<i4", "<i4", "<i4")[1:])
        kept, out = [], []
        for i, t in enumerate(texts_of(table)):
            n, gone, spans, left_over = matcher.cut(t, *at.get(i, ()))
            if with_rows:
                kept.append(left_over.decode("utf-8", "ignore") if gone else table.column("text")[i].as_py())
            else:
                out.append((n, gone, spans, digest(left_over)))
        if with_rows:
            columns = [pa.array(kept, pa.string())] + ([table.column("row")] if "row" in table.column_names else [])
        else:
            columns = [table.column("id"), *(pa.array([r[k] for r in out], pa.int64()) for k in range(3)), pa.array([r[3] for r in out], pa.string())]
        result = pa.table(columns, names=[f.name for f in schema])
        trim()
        return result

    return bundles.groupBy("bundle").cogroup(ranges.groupBy("bundle")).applyInArrow(cut, schema)


def removed(docs: DataFrame, matcher, id_col: str = "doc_id", text_col: str = "text", hot_least: int = HOT_LEAST, buckets: int | None = None) -> DataFrame:
    """doc_id, n, n_removed, n_spans, kept_sha256 of every row."""
    return cut_rows(docs, matcher, id_col, text_col, False, hot_least, buckets).withColumnRenamed("id", "doc_id")


def without_repeats(docs: DataFrame, matcher, id_col: str = "doc_id", text_col: str = "text", hot_least: int = HOT_LEAST) -> DataFrame:
    """``docs`` with the repeated passages cut from their texts; all other columns as they are."""
    found = cut_rows(docs, matcher, id_col, text_col, True, hot_least, None)
    return found.select([F.col("text").alias(text_col) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
