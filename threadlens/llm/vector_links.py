"""Near-duplicate vectors by spherical-cap filters with structured random product codes.

Equal vectors of a label form a class, which a stored number names; ids come in only at the end. Class vectors are scaled to length 1 and turned by a
fixed random rotation. A filter direction is a pair of code words, one for each half of the
coordinates; a vector is decoded to all directions whose inner product with it reaches the
cap's height, by sorting the scores of one half and searching in them for each word of the
other. Classes of a label that share a filter are compared in double precision.

The code grows with the square root of the number of classes and the cap's height follows
from it, so that a vector of no special place has about ``filters`` filters at every size
and a bucket stays small; with 24 a pair at cosine 0.93 shares about eight. A vector whose
place gives it fewer than ``least`` filters has its cap lowered to its nearest ones. Buckets of more than ``block`` classes are cut into
blocks that are compared in pairs, in as many tasks. A pair that shares several filters
counts in the first of them alone. Tasks return counts per class and at most one link less
than they hold classes, never pairs.

Vectors that are null, zero, hold null or non-finite numbers, or have a null label link with
nothing, and so do vectors of different lengths. Repeated rows are copies and link with each
other; rows that repeat an id with another vector or label are vectors of their own. Rows with a null id have
no name in components but count as links of others; a component without any id has none, and its rows are not kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.llm.blocks import held
from threadlens.llm.components import connected
from threadlens.operators.joins import lookup_join
from threadlens.session import materialise

COSINE = 0.93
FILTERS = 24
LEAST = 12  # a vector with fewer filters in its cap takes its nearest ones
MIN_WORDS = 64
BLOCK = 1024
SEED = 11
DECODED = "class long, label string, mult long, vector binary, filters binary"


def unit_vectors(raw: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, first by their largest number, which keeps squares within range."""
    scaled = raw / np.abs(raw).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def packed_rows(raw: np.ndarray) -> list[bytes]:
    """Each row's numbers, in single precision where that holds them exactly."""
    with np.errstate(over="ignore"):
        single = raw.astype("<f4")
    exact = (single == raw).all(axis=1)
    return [s.tobytes() if e else r.tobytes() for e, s, r in zip(exact, single, raw.astype("<f8"))]


def unpacked_rows(rows: list[bytes], dims: int) -> np.ndarray:
    if all(len(r) == 4 * dims for r in rows):
        return np.frombuffer(b"".join(rows), "<f4").reshape(-1, dims).astype(np.float64)
    return np.stack([np.frombuffer(r, "<f4" if len(r) == 4 * dims else "<f8").astype(np.float64) for r in rows])


def cap_height(dims: int, share: float) -> float:
    """The height whose cap holds ``share`` of the unit sphere."""
    u = np.linspace(-1, 1, 400_001)
    density = np.power(np.clip(1 - u * u, 0, None), max(0.0, (dims - 3) / 2))
    above = np.cumsum(density[::-1])[::-1] / density.sum()
    return float(u[np.searchsorted(-above, -share)])


class ProductCode:
    """Filter directions as pairs of code words, and the filters of a vector."""

    def __init__(self, dims: int, words: int, filters: float, least: int) -> None:
        rng = np.random.default_rng([SEED, dims, words])
        self.turn = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
        self.half, self.words, self.least = dims // 2, words, min(least, words)
        halves = [rng.standard_normal((words, n)) for n in (self.half, dims - self.half)]
        self.codes = [c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12) for c in halves]
        self.height = cap_height(dims, min(1.0, filters / words**2)) * np.sqrt(2) if dims > 1 else -2.0

    def decode(self, vectors: np.ndarray) -> list[np.ndarray]:
        """For each unit vector the sorted numbers of all filters it exceeds."""
        turned = vectors @ self.turn
        first, second = turned[:, : self.half] @ self.codes[0].T, turned[:, self.half :] @ self.codes[1].T
        return [self._list(a, b) for a, b in zip(first, second, strict=True)]

    def _list(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        order = np.argsort(-b, kind="stable")
        falling, height = -b[order], self.height
        while True:
            able = np.flatnonzero(a + b[order[0]] >= height)
            counts = np.searchsorted(falling, a[able] - height, side="right")
            if counts.sum() >= self.least:
                break
            height -= 0.02
        return np.sort(np.concatenate([i * self.words + order[:n] for i, n in zip(able, counts)]).astype(np.int64))


def _classes(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``class, label, vector, mult, low`` of the vectors that can link; ``class`` has to be stored before it is used."""
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"),
        F.col(vector_col).cast("array<double>").alias("vector"))
    fit = (
        F.col("label").isNotNull() & F.col("vector").isNotNull()
        & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists("vector", lambda x: x != 0)
    )
    rows = rows.filter(F.coalesce(fit, F.lit(False)))
    return rows.groupBy("label", "vector").agg(F.min("id").alias("low"), F.count("*").alias("mult")).withColumn(
        "class", F.monotonically_increasing_id())


def _number_kind(words: int) -> str:
    """The type that holds the numbers of all filters."""
    return "<i4" if words * words < 2**31 else "<i8"


def _decoded(classes: DataFrame, words: int, filters: float, least: int) -> DataFrame:
    kind = _number_kind(words)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            sizes = lists.value_lengths().to_numpy()
            for dims in np.unique(sizes):
                at = pa.array(np.flatnonzero(sizes == dims))
                mine = batch.take(at)
                raw = mine.column("vector").flatten().to_numpy().reshape(-1, dims)
                unit = unit_vectors(raw)
                code = held(("product code", int(dims), words, filters, least),
                            lambda: ProductCode(int(dims), words, filters, least))
                labels = pa.array([f"{dims}:{x}" for x in mine.column("label").to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [mine.column("class"), labels, mine.column("mult"), pa.array(packed_rows(raw), pa.binary()),
                     pa.array([f.astype(kind).tobytes() for f in code.decode(unit)], pa.binary())],
                    ["class", "label", "mult", "vector", "filters"])

    return classes.select("class", "label", "mult", "vector").mapInArrow(decode, DECODED)


def _bucket_rows(decoded: DataFrame, block: int, words: int) -> DataFrame:
    """A row for each class and filter that others share, once for each pair of blocks it takes part in."""
    kind = _number_kind(words)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.frombuffer(x, kind).astype(np.int64) for x in batch.column("filters").to_pylist()]
            at = pa.array(np.repeat(np.arange(len(lists)), [len(x) for x in lists]))
            numbers = pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([*batch.take(at).columns, numbers], [*batch.schema.names, "filter"])

    rows = decoded.mapInArrow(explode, DECODED + ", filter long")
    sizes = rows.groupBy("label", "filter").agg(F.count("*").alias("m")).filter("m > 1")
    rows = rows.join(sizes, ["label", "filter"]).withColumn("g", F.ceil(F.col("m") / block).cast("int"))
    own = F.pmod(F.xxhash64("class"), F.col("g")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    return rows.select("class", "label", "mult", "vector", "filters", "filter", "own",
                       F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))


def _compared(rows: DataFrame, cosine: float, parts: int, words: int) -> DataFrame:
    """``class, n, to``: links of a class in a pair of blocks (weighed by copies), or a link to ``to``."""
    key, kind = ["label", "filter", "lo", "hi"], _number_kind(words)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("class", pa.int64()), ("n", pa.int64()), ("to", pa.int64())])

        def bucket(t: pa.RecordBatch) -> list[list]:
            """Columns of what the classes of a bucket give: counts first, then links."""
            dims = int(t.column("label")[0].as_py().partition(":")[0])
            vectors = unit_vectors(unpacked_rows(t.column("vector").to_pylist(), dims))
            like = vectors @ vectors.T >= cosine
            if t.column("lo")[0].as_py() != t.column("hi")[0].as_py():
                blocks = t.column("own").to_numpy()
                like &= blocks[:, None] != blocks[None, :]  # pairs within a block are its own task's
            i, j = np.nonzero(np.triu(like, 1))
            if not len(i):
                return [[], [], []]
            here, mult, names = t.column("filter")[0].as_py(), t.column("mult").to_numpy(), t.column("class").to_numpy()
            lists, used = t.column("filters").to_pylist(), np.unique(np.concatenate([i, j]))
            lower = {}  # filters before this one, which would have seen the pair first
            for k in used.tolist():
                numbers = np.frombuffer(lists[k], kind)
                lower[k] = set(numbers[: np.searchsorted(numbers, here)].tolist())
            first = np.array([lower[x].isdisjoint(lower[y]) for x, y in zip(i.tolist(), j.tolist())], bool)
            i, j = i[first], j[first]
            n = np.bincount(i, mult[j], t.num_rows) + np.bincount(j, mult[i], t.num_rows)
            some = np.flatnonzero(n)
            root, links = list(range(t.num_rows)), []

            def find(k: int) -> int:
                while root[k] != k:
                    root[k] = root[root[k]]
                    k = root[k]
                return k

            for x, y in zip(i.tolist(), j.tolist()):
                p, q = find(x), find(y)
                if p != q:
                    root[p] = q
                    links.append((int(names[x]), int(names[y])))
            return [names[some].tolist() + [x for x, _ in links], n[some].astype(int).tolist() + [0] * len(links),
                    [None] * len(some) + [y for _, y in links]]

        def ends(t: pa.RecordBatch) -> np.ndarray:
            """Where the key changes."""
            change = np.zeros(t.num_rows - 1, bool)
            for k in key:
                c = t.column(k)
                c = c.dictionary_encode().indices.to_numpy() if k == "label" else c.to_numpy()
                change |= c[1:] != c[:-1]
            return np.flatnonzero(change) + 1

        rest = None
        for batch in batches:
            if rest is not None:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            out: list[list] = [[], [], []]
            start = 0
            for stop in ends(batch).tolist() if batch.num_rows else []:
                if stop - start > 1:
                    for column, found in zip(out, bucket(batch.slice(start, stop - start)), strict=True):
                        column.extend(found)
                start = stop
            rest = batch.slice(start)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], schema=schema)
        if rest is not None and rest.num_rows > 1:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in bucket(rest)], schema=schema)

    dealt = rows.repartition(parts, *key).sortWithinPartitions(*key)
    return dealt.mapInArrow(compare, "class long, n long, to long")


def link_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    cosine: float = COSINE, filters: float = FILTERS, least: int = LEAST,
    block: int = BLOCK,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of each row."""
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    classes = materialise(_classes(vectors, id_col, vector_col, label_col), "classes")
    words = max(MIN_WORDS, int(np.ceil(np.sqrt(classes.count()))))
    decoded = materialise(_decoded(classes, words, filters, least), "decoded")
    found = materialise(_compared(_bucket_rows(decoded, block, words), cosine, parts, words), "compared")
    sums = found.groupBy("class").agg(F.sum("n").alias("n"))
    components = materialise(connected(
        found.filter(F.col("to").isNotNull()).select(F.col("class").alias("a"), F.col("to").alias("b"))
    ).select(F.col("node").alias("class"), "component"), "components")
    own = classes.select("class", "low")
    lowest = components.join(own, "class").groupBy("component").agg(F.min("low").alias("lowest"))
    # one component may hold most classes, so its rows are spread
    named = lookup_join(components, lowest, ["component"], spread_by=["class"])
    facts = (
        classes.join(sums, "class", "left").join(named.select("class", "lowest"), "class", "left")
        .select("label", "vector", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"),
                F.coalesce("lowest", "low").alias("component_id"))
    )
    rows = vectors.select(
        F.col(id_col).cast("long").alias(id_col), F.col(label_col).cast("string").alias("label"),
        F.col(vector_col).cast("array<double>").alias("vector"))
    own = F.coalesce("component_id", F.col(id_col))
    return rows.join(facts, ["label", "vector"], "left").select(
        id_col, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"),
        F.coalesce(own == F.col(id_col), F.lit(False)).alias("kept"))
