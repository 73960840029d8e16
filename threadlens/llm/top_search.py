"""Exact top-k search by integer inner product, over vectors in falling order of length.

Vectors become integers, ``floor(scale * x)``, and are numbered by falling length, apart for each
number of dimensions; blocks of them meet blocks of queries. The first block, the longest vectors,
gives each query k scores and so a threshold t. By Cauchy-Schwarz no vector shorter than
t / length(query) can do better, so queries are then dealt by that length, and a vector goes only to the
blocks of queries that it is long enough for, a query only to the blocks that are long enough for it.

Within a pair of blocks vectors pass in falling order in small chunks, while thresholds rise. A query
leaves when the next vector is too short. Vectors and queries are rotated by the right singular vectors
of a sample, which gathers most of the inner product in the first coordinates: partial sums over a
quarter and a half of them, plus the product of the residual lengths, bound the score from above, and
only pairs whose bound reaches the threshold get their exact score, in integers or in doubles where
these are exact. The rotation (fitted on ``SAMPLE`` vectors at most, numbered by hash) only
sharpens bounds; the result is exact for any.

Every query meets every vector that its threshold leaves, so work grows with queries times vectors;
the number of rows shuffled, with vectors times blocks of queries.

Vectors that are null or empty, hold null or non-finite numbers, or whose squared integer length reaches
2^62 (scores could leave 64 bits) take no part. Vectors of other lengths are no candidates. A row is no
candidate of its own; a repeated row is, and repeated query ids are queries of their own. Rows with a
null id are no queries, and as candidates lose ties. Ties go to the smaller id. An empty table gives an
empty table; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlens.llm.blocks import offsets_of
from threadlens.llm.ordering import placed
from threadlens.operators.joins import small_table
from threadlens.session import materialise

K = 10
SCALE = 1024
BLOCK = 8192  # vectors
QUERY_BLOCK = 1024
CHUNK = 512  # vectors that are compared at once
SAMPLE = 2048
LEVELS = 32  # length classes for each doubling of the squared length
LIMIT = 2.0**62
LOWEST = -(2**63)
NO_ID = 2**63 - 1  # sorts behind all ids
FOUND = "at long, query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``vec_id, dims, square, ints`` of the vectors that take part."""

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            flat = lists.flatten()
            values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
            with np.errstate(over="ignore", invalid="ignore"):
                values = np.floor(values * scale)
                squares = values * values
            sizes = np.where(lists.is_null().to_numpy(zero_copy_only=False), 0,
                             lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
            bounds = offsets_of(sizes)
            for size in np.unique(sizes[sizes > 0]).tolist():
                mine = np.flatnonzero(sizes == size)
                at = bounds[mine][:, None] + np.arange(size)
                with np.errstate(over="ignore", invalid="ignore"):
                    mine = mine[squares[at].sum(axis=1) < LIMIT]  # not true of NaN
                whole = values[bounds[mine][:, None] + np.arange(size)].astype(np.int64)
                small = (np.abs(whole) < 2**31).all(axis=1) if len(whole) else []
                ints = [row.astype("<i4" if s else "<i8").tobytes() for row, s in zip(whole, small)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id").take(pa.array(mine)), pa.array(np.full(len(mine), size, np.int32)),
                     pa.array((whole * whole).sum(axis=1), pa.int64()), pa.array(ints, pa.binary())],
                    ["vec_id", "dims", "square", "ints"])

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"),
                          F.col(vector_col).cast("array<double>").alias("vector"))
    return rows.mapInArrow(quantise, "vec_id long, dims int, square long, ints binary")


def unpacked(rows: list[bytes], dims: int) -> np.ndarray:
    if all(len(r) == 4 * dims for r in rows):
        return np.frombuffer(b"".join(rows), "<i4").reshape(-1, dims).astype(np.int64)
    return np.stack([np.frombuffer(r, "<i4" if len(r) == 4 * dims else "<i8").astype(np.int64) for r in rows])


def rotations(rows: list[tuple[int, bytes]]) -> dict[int, np.ndarray]:
    """Right singular vectors of the sampled vectors, by dimensions."""
    found = {}
    for dims in {d for d, _ in rows}:
        mine = unpacked([r for d, r in rows if d == dims], dims).astype(np.float64)
        mine /= max(1.0, np.abs(mine).max())
        found[dims] = np.linalg.svd(mine.T @ mine)[0]  # that of the vectors, on the smaller matrix
    return found


class Queries:
    """A block of queries with their best scores so far."""

    def __init__(self, at: list[int], ids: list[int], ints: np.ndarray, bars: list[int], turn: np.ndarray | None, k: int) -> None:
        self.at, self.ids, self.k, self.ints = np.array(at, np.int64), ids, k, ints
        dims = ints.shape[1]
        self.plain = ints.astype(np.float64)
        self.lengths = np.sqrt((self.plain**2).sum(axis=1))
        self.turn = np.eye(dims) if turn is None else turn
        self.turned = self.plain @ self.turn
        self.cuts = sorted({max(1, dims // 4), max(1, dims // 2)})
        self.rests = [np.sqrt((self.turned[:, c:] ** 2).sum(axis=1)) for c in self.cuts]
        self.bars = np.array(bars, np.int64)  # scores below cannot count
        self.scores = np.full((len(at), k), LOWEST, np.int64)
        self.names = np.full((len(at), k), NO_ID, np.int64)

    def compare(self, at: np.ndarray, names: np.ndarray, ints: np.ndarray, lengths: np.ndarray) -> bool:
        """Take in vectors in falling order of length; False once they are too short for all queries."""
        bars = self.bars.astype(np.float64)
        reach = self.lengths * lengths[0]
        mine = np.flatnonzero(reach * (1 + 1e-9) + 1 >= bars)
        if not len(mine):
            return False
        slack = 1e-9 * reach[mine][:, None] + 1
        other = ints.astype(np.float64)
        turned = other @ self.turn
        open_pairs = np.ones((len(mine), len(at)), bool)
        sums, before = 0.0, 0
        for cut, rests in zip(self.cuts, self.rests):
            rows = np.flatnonzero(open_pairs.any(axis=1))
            if not len(rows):
                return True
            sums = sums + self.turned[mine][:, before:cut] @ turned[:, before:cut].T
            rest = np.sqrt((turned[:, cut:] ** 2).sum(axis=1))
            open_pairs &= sums + rests[mine][:, None] * rest + slack >= bars[mine][:, None]
            before = cut
        open_pairs &= self.at[mine][:, None] != at
        i, j = np.nonzero(open_pairs)
        scores = self._exact(mine, i, j, ints, other, lengths[0])
        good = scores >= self.bars[mine][i]
        self._merge(mine[i[good]], names[j[good]], scores[good])
        return True

    def _exact(self, mine, i, j, ints, other, length) -> np.ndarray:
        exact = float(self.lengths.max()) * float(length) < 2.0**53  # all partial sums are whole doubles then
        if exact and len(i) * 16 > len(mine) * len(ints):
            return (self.plain[mine] @ other.T)[i, j].astype(np.int64)
        out = np.empty(len(i), np.int64)
        for a in range(0, len(i), 1 << 15):
            p, q = mine[i[a : a + (1 << 15)]], j[a : a + (1 << 15)]
            out[a : a + len(p)] = np.einsum("nd,nd->n", self.ints[p], ints[q])
        return out

    def _merge(self, rows: np.ndarray, names: np.ndarray, scores: np.ndarray) -> None:
        order = np.lexsort((names, ~scores, rows))
        rows, names, scores = rows[order], names[order], scores[order]
        hit, first, count = np.unique(rows, return_index=True, return_counts=True)
        for row, a, n in zip(hit.tolist(), first.tolist(), count.tolist()):
            n = min(n, self.k)
            both = np.concatenate([self.scores[row], scores[a : a + n]])
            named = np.concatenate([self.names[row], names[a : a + n]])
            best = np.lexsort((named, ~both))[: self.k]
            self.scores[row], self.names[row] = both[best], named[best]
        self.bars[hit] = np.maximum(self.bars[hit], self.scores[hit, -1])

    def result(self) -> pa.RecordBatch:
        row, column = np.nonzero(self.scores != LOWEST)
        names = self.names[row, column]
        return pa.RecordBatch.from_arrays(
            [pa.array(self.at[row]), pa.array([self.ids[r] for r in row.tolist()], pa.int64()),
             pa.array(names, mask=names == NO_ID), pa.array(self.scores[row, column])],
            ["at", "query_id", "vec_id", "score"])


def compared(units: DataFrame, turns: dict[int, np.ndarray], k: int, parts: int) -> DataFrame:
    """Best ``k`` of each query in each pair of blocks.

    ``units`` holds ``dims, qb, cb``, the pair's key, queries (``is_query``, with their threshold ``bar``)
    and vectors, each with ``at``, its number.
    """
    key = ["dims", "qb", "cb"]
    columns = [*key, "is_query", "at", "vec_id", "square", "ints", "bar"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, asked, queries, going = None, [], None, True
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in [*key, "is_query"]])
            change = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for a, b in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows]):
                if a == b:
                    continue
                here, rows = tuple(keys[:3, a].tolist()), batch.slice(a, b - a)
                if here != unit:
                    if queries is not None:
                        yield queries.result()
                    unit, asked, queries, going = here, [], None, True
                if keys[3, a]:
                    asked.append(rows.select(["at", "vec_id", "ints", "bar"]))
                    continue
                if queries is None and asked:
                    t = pa.Table.from_batches(asked)
                    queries = Queries(t["at"].to_pylist(), t["vec_id"].to_pylist(), unpacked(t["ints"].to_pylist(), here[0]),
                                      t["bar"].to_pylist(), turns.get(here[0]), k)
                for c in range(0, rows.num_rows if queries is not None else 0, CHUNK):
                    if not going:
                        break
                    part = rows.slice(c, CHUNK)
                    names = part.column("vec_id").fill_null(NO_ID).to_numpy()
                    going = queries.compare(part.column("at").to_numpy(), names, unpacked(part.column("ints").to_pylist(), here[0]),
                                            np.sqrt(part.column("square").to_numpy().astype(np.float64)))
        if queries is not None:
            yield queries.result()

    dealt = units.select(*columns).repartition(parts, *key).sortWithinPartitions(*key, F.desc("is_query"), "at")
    return dealt.mapInArrow(compare, FOUND)


def _level(square: Column) -> Column:
    return F.floor(F.log2(square + 1.0) * LEVELS).cast("int")


def _running(rows: list, falling: bool) -> list[tuple[int, int, int]]:
    """``dims, level, most`` with the largest number of a block at this level or beyond, for all levels."""
    best: dict[int, dict[int, int]] = {}
    for dims, level, n in rows:
        best.setdefault(dims, {})[level] = n
    out = []
    for dims, by_level in best.items():
        most = -1
        for level in sorted(range(-1, 62 * LEVELS + 2), reverse=falling):
            most = max(most, by_level.get(level, -1))
            out.append((dims, level, most))
    return out


def top_k(
    vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, block: int = BLOCK,
    query_block: int = QUERY_BLOCK, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best rows of each query, a condition on ``vec_id``."""
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    usable = quantised(vectors, id_col, vector_col, scale).withColumn("row", F.monotonically_increasing_id())
    every = placed(materialise(usable, "vectors"), F.asc("dims"), F.desc("square"), F.asc_nulls_last("vec_id"), F.asc("row"), out="at")
    starts = every.groupBy("dims").agg(F.min("at").alias("first")).collect()  # a row for each number of dimensions
    firsts = small_table(spark, [tuple(r) for r in starts], "dims int, first long")
    every = every.join(firsts, "dims").select(
        "dims", "at", "vec_id", "square", "ints", F.floor((F.col("at") - F.col("first")) / block).alias("cb"),
        _level(F.col("square")).alias("level"))
    sample = every.select("dims", "ints").orderBy(F.xxhash64("at")).limit(SAMPLE)
    turns = rotations([(r.dims, bytes(r.ints)) for r in sample.collect()])
    asked = every.filter(F.coalesce(is_query, F.lit(False))).select("dims", "at", "vec_id", "square", "ints")

    def united(queries: DataFrame, rows: DataFrame) -> DataFrame:
        shape = ["dims", "qb", "cb", "is_query", "at", "vec_id", "square", "ints", "bar"]
        return queries.withColumn("is_query", F.lit(True)).select(shape).unionByName(
            rows.withColumns({"is_query": F.lit(False), "bar": F.lit(LOWEST)}).select(shape))

    # the longest vectors against all queries
    blocked = placed(asked, F.asc("dims"), F.asc("at"), out="n").withColumn("qb", F.floor(F.col("n") / query_block))
    ranges = blocked.groupBy("dims").agg(F.min("qb").alias("low"), F.max("qb").alias("high")).collect()
    span = small_table(spark, [tuple(r) for r in ranges], "dims int, low long, high long")
    longest = every.filter("cb = 0").join(span, "dims").withColumn("qb", F.explode(F.sequence("low", "high")))
    head = materialise(compared(united(
        blocked.withColumns({"cb": F.lit(0).cast("long"), "bar": F.lit(LOWEST)}), longest), turns, k, parts), "head")
    # the rest, for as long as it can reach a query's threshold
    bars = head.groupBy("at").agg(F.when(F.count("*") >= k, F.min("score")).alias("bar"))
    bar = F.coalesce("bar", F.lit(LOWEST))
    least = F.when((F.col("bar") > 0) & (F.col("square") > 0), F.pow(F.col("bar").cast("double"), 2) / F.col("square"))
    level = F.when(least.isNull(), F.lit(-1)).otherwise(_level(F.least(least, F.lit(LIMIT))) - 1)
    waiting = asked.join(bars, "at", "left").withColumn("bar", bar).withColumn("level", level)
    dealt = placed(waiting, F.asc("dims"), F.asc("level"), F.asc("at"), out="n").withColumn(
        "qb", F.floor(F.col("n") / query_block))
    for_rows = _running(dealt.groupBy("dims", "level").agg(F.max("qb")).collect(), falling=False)
    for_queries = _running(every.groupBy("dims", "level").agg(F.max("cb")).collect(), falling=True)
    lows = small_table(spark, [tuple(r) for r in dealt.groupBy("dims").agg(F.min("qb")).collect()], "dims int, low long")
    schema = "dims int, level int, most long"
    rows = (
        every.filter("cb > 0").join(small_table(spark, for_rows, schema), ["dims", "level"]).join(lows, "dims")
        .filter("most >= low").withColumn("qb", F.explode(F.sequence("low", "most"))))
    queries = dealt.join(small_table(spark, for_queries, schema), ["dims", "level"]).filter("most >= 1").withColumn(
        "cb", F.explode(F.sequence(F.lit(1).cast("long"), F.col("most"))))
    rest = compared(united(queries, rows), turns, k, parts)
    best = Window.partitionBy("at").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return (
        head.unionByName(rest).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score"))
