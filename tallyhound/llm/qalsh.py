"""Approximate nearest neighbours by collision counting over query-aware single projections.

Every row is indexed. ``projections`` random directions give one sorted array each; a query opens a window of width
``width`` * R around its own projection in every array, virtual rehashing widens R by ``ratio`` without building anything
anew, and only what a window newly takes in is counted. A vector that has collided in ``threshold`` of the arrays is
verified by its exact distance; nothing caps the candidates.

The arrays are cut into blocks of rows, each with its part of all arrays, so that collisions are counted where the rows
are. A global array a projection would send them instead: on the check's vectors a window takes in about 0.6 of all rows,
so a query would send 0.6 * projections numbers for each row of the table.

1. A tree of medians, fitted on at most ``sample`` rows, deals rows to cells of like projections, and a cell's rows by number to
   blocks of about ``block_rows``. A cell keeps its size and the range of each projection (at most ``CELLS`` cells: the broadcast).
2. A query is searched in its own block: queries travel, blocks stay single. The distance of its k-th nearest there bounds the global one.
3. It then visits only cells whose ranges meet its windows at that bound in ``threshold`` of the projections (in no other
   can a vector collide often enough), and no window grows beyond the bound. A block is copied only where more than ``slice_rows`` queries visit
   its cell, once for each such slice of them, and answers are merged by query.

Windows are wider by a bound of the rounding of projections, so equal vectors collide in all of them wherever they are. Very large
components are scaled by a power of two first, which leaves distances exact.

Cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, as queries or candidates;
a null id takes no part; rows that repeat an id are queries and candidates one by one; vectors of different lengths are never
compared; ties go to the smaller id; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyhound.llm.staging import stage

CELLS = 256
FOUND = "query_row long, query_id long, vec_id long, score double"
#: Components above this are scaled down to it, so that squares and projections stay finite.
LARGE = 2.0**400


def lines(size: int, count: int) -> np.ndarray:
    return np.random.default_rng(size).standard_normal((size, count))


def slack(vectors: np.ndarray, count: int, *norms: np.ndarray | float) -> np.ndarray:
    """What two projections of one vector may differ by, whatever the order of their sums: bounded by length, norms and lines."""
    size = vectors.shape[1]
    lengths = np.sqrt(np.square(lines(size, count)).sum(axis=0))
    return 4 * size * np.finfo(float).eps * lengths * sum(norms)


def distances(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean; where squares would vanish they are taken of scaled differences."""
    apart = vectors - query
    d = np.sqrt(np.square(apart).sum(axis=1))
    tiny = np.flatnonzero(d < 2.0**-450)
    if len(tiny):
        most = np.abs(apart[tiny]).max(axis=1)
        unit = np.where(most > 0, most, 1.0)
        d[tiny] = unit * np.sqrt(np.square(apart[tiny] / unit[:, None]).sum(axis=1)) * (most > 0)
    return d


def norms_of(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt(np.square(vectors).sum(axis=1))


class Projections:
    """The sorted arrays of one block."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, count: int, width: float, threshold: float):
        self.rows, self.ids, self.vectors, self.width, self.count = rows, ids, vectors, width, count
        self.least, self.lines = int(np.ceil(threshold * count)), lines(vectors.shape[1], count)
        self.norm = float(norms_of(vectors).max())
        projected = (vectors @ self.lines).T
        self.order = np.argsort(projected, axis=1, kind="stable").astype("int32")
        self.values = np.take_along_axis(projected, self.order, axis=1)
        self.spread = float(np.sqrt(2 * vectors.var(axis=0).sum())) or 1.0

    def nearest(self, query_row: int, query: np.ndarray, k: int, ratio: float, bound: float) -> tuple[np.ndarray, np.ndarray]:
        """(distances, ids) of the k nearest found, nearest first; beyond ``bound`` none is looked for."""
        n = len(self.ids)
        collisions, verified = np.zeros(n, "int16"), self.rows == query_row
        found_d, found_i = np.zeros(0), np.zeros(0, "int64")
        at = query @ self.lines
        low = high = [int(np.searchsorted(v, x)) for v, x in zip(self.values, at, strict=True)]
        reach = bound if np.isfinite(bound) else 0.25 * self.spread
        loose = slack(self.vectors, self.count, self.norm, float(np.sqrt(np.square(query).sum())))
        while True:
            half = self.width * reach / 2 + loose
            new_low = [int(np.searchsorted(v, x)) for v, x in zip(self.values, at - half, strict=True)]
            new_high = [int(np.searchsorted(v, x, "right")) for v, x in zip(self.values, at + half, strict=True)]
            taken = [o[a:b] for o, a, b in zip(self.order, new_low, low, strict=True)] + [o[a:b] for o, a, b in zip(self.order, high, new_high, strict=True)]
            low, high = new_low, new_high
            collisions += np.bincount(np.concatenate(taken), minlength=n).astype("int16")
            fresh = np.flatnonzero((collisions >= self.least) & ~verified)
            verified[fresh] = True
            d = distances(self.vectors[fresh], query)
            found_d, found_i = np.r_[found_d, d], np.r_[found_i, self.ids[fresh]]
            best = np.lexsort((found_i, found_d))[:k]
            found_d, found_i = found_d[best], found_i[best]
            if len(found_d) == k and found_d[-1] <= reach or reach >= bound or verified.all():
                return found_d, found_i
            reach = min(reach * ratio, bound)


def split(projected: np.ndarray, depth: int) -> tuple | None:
    """A tree of (projection, median, left, right), each node split where its rows are spread most."""
    if not depth or len(projected) < 2:
        return None
    axis = int(projected.var(axis=0).argmax())
    middle = float(np.median(projected[:, axis]))
    left = projected[:, axis] < middle
    if not left.any():
        return None
    return axis, middle, split(projected[left], depth - 1), split(projected[~left], depth - 1)


def cell_of(tree: tuple | None, projected: np.ndarray) -> np.ndarray:
    """Each row's leaf: the path to it in bits behind a leading 1."""
    out = np.ones(len(projected), "int64")

    def go(node: tuple | None, rows: np.ndarray) -> None:
        if node and len(rows):
            right = projected[rows, node[0]] >= node[1]
            out[rows] = out[rows] * 2 + right
            go(node[2], rows[~right])
            go(node[3], rows[right])

    go(tree, np.arange(len(projected)))
    return out


def by_length(lists: pa.ListArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, vectors) for each vector length."""
    lengths = lists.value_lengths().to_numpy()
    return [(mine, lists.take(pa.array(mine)).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)) for size in np.unique(lengths) if len(mine := np.flatnonzero(lengths == size))]


def lists_of(column) -> pa.ListArray:
    chunk = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return chunk if isinstance(chunk, pa.ListArray) else pa.concat_arrays(chunk.chunks) if chunk.num_chunks else pa.array([], pa.list_(pa.float64()))


def nearest(
    rows: DataFrame, every: int = 100, k: int = 10, projections: int = 64, width: float = 2.2, threshold: float = 0.62, ratio: float = 1.25, block_rows: int = 8192,
    slice_rows: int = 32_768, sample: int = 16_384, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id is divisible by ``every``."""
    v, is_query = F.col("v"), F.col("id") % every == 0
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.filter(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0))
    n, most = rows.agg(F.count("*"), F.max(F.array_max(F.transform(v, F.abs)))).first()
    scale = 1.0 if not most or most <= LARGE else 2.0 ** -np.ceil(np.log2(most) - np.log2(LARGE))
    if scale != 1.0:
        rows = rows.withColumn("v", F.transform(v, lambda x: x * scale))
    least = int(np.ceil(threshold * projections))
    depth = max(0, int(np.log2(max(1, min(CELLS, n / block_rows)))))
    # at most ``sample`` rows, of any lengths, chosen by their ids' hashes
    fitted = rows.orderBy(F.xxhash64("id")).limit(sample if depth else 0).toArrow()
    trees = {x.shape[1]: split(x @ lines(x.shape[1], projections), depth) for _, x in by_length(lists_of(fitted.column("v")))} if fitted.num_rows else {}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.ones(batch.num_rows, "int64")
            for mine, x in by_length(lists_of(batch.column(2))):
                cell[mine] = cell_of(trees.get(x.shape[1]), x @ lines(x.shape[1], projections))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=["row", "id", "v", "cell"])

    dealt = stage(rows.select(F.monotonically_increasing_id().alias("row"), "id", "v").mapInArrow(deal, "row long, id long, v array<double>, cell long"), "blocks")

    def extent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sizes, norms and ranges of a partition's projections by cell and vector length."""
        low: dict[tuple, np.ndarray] = {}
        high: dict[tuple, np.ndarray] = {}
        many: dict[tuple, int] = {}
        norm: dict[tuple, float] = {}
        for batch in batches:
            cell = batch.column(1).to_numpy()
            for mine, x in by_length(lists_of(batch.column(0))):
                p = x @ lines(x.shape[1], projections)
                for c in np.unique(cell[mine]).tolist():
                    here, key = cell[mine] == c, (c, x.shape[1])
                    low[key] = np.minimum(low.get(key, np.inf), p[here].min(axis=0))
                    high[key] = np.maximum(high.get(key, -np.inf), p[here].max(axis=0))
                    many[key] = many.get(key, 0) + int(here.sum())
                    norm[key] = max(norm.get(key, 0.0), float(norms_of(x[here]).max()))
        columns = [pa.array([c for c, _ in low], pa.int64()), pa.array([z for _, z in low], pa.int32()), pa.array(list(many.values()), pa.int64()), pa.array(list(norm.values()), pa.float64())]
        columns += [pa.array([x.tolist() for x in d.values()], pa.list_(pa.float64())) for d in (low, high)]
        yield pa.RecordBatch.from_arrays(columns, names=["cell", "size", "n", "norm", "low", "high"])

    parts = dealt.select("v", "cell").mapInArrow(extent, "cell long, size int, n long, norm double, low array<double>, high array<double>")
    sides = (f(F.col(c)[j]).alias(f"{c}{j}") for c, f in (("low", F.min), ("high", F.max)) for j in range(projections))
    each = parts.groupBy("cell", "size").agg(F.sum("n").alias("n"), F.max("norm").alias("norm"), *sides)
    # one row a cell and vector length
    ranges, blocks = {}, {}
    for r in each.collect():
        ranges[r[0], r[1]] = (r.norm, np.array(r[4 : 4 + projections]), np.array(r[4 + projections :]))
        blocks[r[0]] = blocks.get(r[0], 0) + r.n
    blocks = {c: max(1, -(-m // block_rows)) for c, m in blocks.items()}
    of_cell = lambda numbers, c: F.element_at(F.create_map(*[F.lit(int(x)) for kv in numbers.items() for x in kv]), F.col(c)) if numbers else F.lit(1)
    dealt = dealt.withColumn("sub", F.pmod(F.xxhash64("row"), of_cell(blocks, "cell").cast("long")))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        """left: a block, right: a slice of the queries that visit it, with their bounds."""
        out = [(np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0))]
        rows, ids = left.column("row").to_numpy(), left.column("id").to_numpy()
        own, named, bounds = (right.column(c).to_numpy() for c in ("query_row", "query_id", "bound"))
        index = {x.shape[1]: Projections(rows[mine], ids[mine], x, projections, width, threshold) for mine, x in by_length(lists_of(left.column("v")))} if len(own) else {}
        for mine, x in by_length(lists_of(right.column("q"))):
            if x.shape[1] in index:
                for i, q in zip(mine.tolist(), x, strict=True):
                    d, near = index[x.shape[1]].nearest(int(own[i]), q, k, ratio, float(bounds[i]))
                    out.append((np.full(len(d), own[i]), np.full(len(d), named[i]), near, d))
        return pa.table(dict(zip(("query_row", "query_id", "vec_id", "score"), (pa.array(np.concatenate(c)) for c in zip(*out, strict=True)), strict=True)))

    def visited(sent: DataFrame, slices: dict[int, int]) -> DataFrame:
        """Answers of the blocks (cell, sub) that queries are sent to; ``slices``: into how many a cell's queries are cut."""
        parts = F.coalesce(of_cell(slices, "cell"), F.lit(1))
        copies = dealt.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), (parts - 1).cast("long"))))
        sent = sent.withColumn("part", F.pmod(F.xxhash64("query_row"), F.coalesce(of_cell(slices, "to"), F.lit(1)).cast("long")))
        return copies.groupBy("cell", "sub", "slice").cogroup(sent.groupBy("to", "to_sub", "part")).applyInArrow(search, FOUND)

    asked = dealt.filter(is_query).select(F.col("row").alias("query_row"), F.col("id").alias("query_id"), F.col("v").alias("q"), F.col("cell").alias("home"), F.col("sub").alias("home_sub"))
    home = asked.select("query_row", "query_id", "q", F.lit(float("inf")).alias("bound"), F.col("home").alias("to"), F.col("home_sub").alias("to_sub"))
    near = stage(visited(home, {}), "home")
    bounds = near.groupBy(F.col("query_row").alias("row")).agg(F.when(F.count("*") >= k, F.max("score")).otherwise(float("inf")).alias("bound"))
    bound = asked.join(bounds, asked.query_row == F.col("row"), "left").select("query_row", "query_id", "q", F.coalesce("bound", F.lit(float("inf"))).alias("bound"), "home", "home_sub")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The cells that a query visits."""
        for batch in batches:
            widths, who, to = batch.column(3).to_numpy() * width / 2, [], []
            for mine, x in by_length(lists_of(batch.column(2))):
                p, norms = x @ lines(x.shape[1], projections), norms_of(x)
                for (cell, size), (norm, low, high) in ranges.items():
                    if size == x.shape[1]:
                        half = widths[mine][:, None] + np.outer(norms + norm, slack(x, projections, 1.0))
                        meets = mine[((p + half >= low) & (p - half <= high)).sum(axis=1) >= least]
                        who.append(meets)
                        to.append(np.full(len(meets), cell))
            some = batch.take(pa.array(np.concatenate([np.zeros(0, "int64"), *who])))
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(np.concatenate([np.zeros(0, "int64"), *to]))], names=[*some.schema.names, "to"])

    routed = stage(bound.mapInArrow(route, "query_row long, query_id long, q array<double>, bound double, home long, home_sub long, to long"), "routed")
    visits = {r.to: max(1, -(-r.n // slice_rows)) for r in routed.groupBy("to").agg(F.count("*").alias("n")).collect()}
    routed = routed.withColumn("to_sub", F.explode(F.sequence(F.lit(0).cast("long"), (of_cell(blocks, "to") - 1).cast("long")))).filter("to <> home OR to_sub <> home_sub")
    found = near.unionByName(visited(routed.select("query_row", "query_id", "q", "bound", "to", "to_sub"), visits))
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", (F.col("score") / scale).alias("score"))
