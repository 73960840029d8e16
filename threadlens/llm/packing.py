"""Packing of token pieces into windows by multiway differencing.

A document is cut into pieces of ``capacity`` tokens; a full piece is a window by itself
and goes into no group. What is left over is cut once more at ``piece_limit``. These pieces are dealt to groups of
about ``group_pieces`` by a hash, so that a task's work is bounded at every size, and each
group is packed by itself: every piece starts as a partial partition of k windows, one
holding it and k-1 empty. The two partitions with the largest differences between their
fullest and emptiest windows are merged, the fullest windows of one onto the emptiest of
the other, until one partition is left. k starts at the least that can hold the group and
rises whenever a window is over capacity.

Null and empty texts are documents of the end id alone; texts are encoded whole, however long.
Each row is a document of its own, also where ids repeat or are null. An empty table gives an
empty table. Further columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.llm.blocks import filled, held, slices
from threadlens.llm.codecs import Codec
from threadlens.session import materialise

CAPACITY = 4096
PIECE_LIMIT = 1024
GROUP_PIECES = 1024
FULL_WINDOWS = 1 << 62  # above the numbers of all groups' windows
PIECE_SCHEMA = "doc_id long, row long, start long, length long, ids_crc32 long, doc_tokens long"


def difference(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window (0 to k-1) of each piece after multiway differencing."""
    n = len(sizes)
    if k == 1 or n <= 1:
        return np.zeros(n, np.int64)
    order = np.argsort(-sizes, kind="stable")
    # A partition: loads of its windows, largest first, less the smallest, and for each window a node.
    # Node -1 is empty, 0..n-1 a piece, and above that the union of two nodes.
    left, right = [], []
    heap: list = []
    for turn, i in enumerate(order):
        heap.append((-int(sizes[i]), turn, np.array([sizes[i]], np.int64), np.array([i], np.int64)))
    heapq.heapify(heap)
    turn, nodes = n, n
    while len(heap) > 1:
        _, _, a, an = heapq.heappop(heap)
        _, _, b, bn = heapq.heappop(heap)
        # Windows beyond the stored ones are empty: only those with a load are kept until they fill k.
        width = min(k, len(a) + len(b))
        load, node = np.zeros(width, np.int64), np.full(width, -1, np.int64)
        load[: len(a)], node[: len(a)] = a, an
        other = slice(width - len(b), width)
        load[other] += b[::-1]
        joined, met = node[other].copy(), bn[::-1]
        both = (joined >= 0) & (met >= 0)
        joined[joined < 0] = met[joined < 0]
        count = int(both.sum())
        if count:
            left.append(node[other][both])
            right.append(met[both])
            joined[both] = nodes + np.arange(count)
            nodes += count
        node[other] = joined
        rank = np.argsort(-load, kind="stable")
        load, node = load[rank], node[rank]
        if width == k:
            load = load - load[-1]
        turn += 1
        spread = int(load[0] - load[-1]) if width == k else int(load[0])
        heapq.heappush(heap, (-spread, turn, load, node))
    final = heap[0][3]
    window = np.full(nodes, -1, np.int64)
    window[final[final >= 0]] = np.flatnonzero(final >= 0)
    ls = np.concatenate(left) if left else np.zeros(0, np.int64)
    rs = np.concatenate(right) if right else np.zeros(0, np.int64)
    for u in range(nodes - 1, n - 1, -1):
        window[ls[u - n]] = window[rs[u - n]] = window[u]
    return window[:n]


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each piece, with no window over ``capacity``."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    if sizes.max() > capacity:
        raise ValueError("a piece is longer than a window")
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window = difference(sizes, k)
        if np.bincount(window, sizes).max() <= capacity:
            return window
        k += 1  # ends at a window for each piece at the latest


def token_pieces(
    docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
    capacity: int = CAPACITY, piece_limit: int = PIECE_LIMIT,
) -> DataFrame:
    """The pieces of each document with the checksum of their ids; texts are encoded where they are read."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = held(("codec", tokenizer), lambda: Codec(tokenizer))
        for batch in slices(batches, "text"):
            ids, offsets = codec.encode(filled(batch.column("text")))
            names, rows = batch.column("doc_id").to_pylist(), batch.column("row").to_pylist()
            out: list[list] = [[], [], [], [], [], []]
            for name, row, a, b in zip(names, rows, offsets[:-1], offsets[1:], strict=True):
                whole = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                full = len(whole) - len(whole) % capacity
                starts = [*range(0, full, capacity), *range(full, len(whole), piece_limit)]
                for s, e in zip(starts, [*starts[1:], len(whole)], strict=True):
                    for column, x in zip(out, (name, row, s, e - s, zlib.crc32(whole[s:e]), len(whole)), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in out],
                ["doc_id", "row", "start", "length", "ids_crc32", "doc_tokens"])
        codec.rest()

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"),
        F.col(text_col).alias("text"),
    )
    return rows.mapInArrow(cut, PIECE_SCHEMA)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces. ``pieces`` is read twice, so give a written table."""
    small = F.col("length") < capacity
    groups = max(1, -(-pieces.filter(small).count() // group_pieces))

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("row", "ascending"), ("start", "ascending")])
        sizes, group = table["length"].to_numpy(), table["group"][0].as_py()
        window = pack(sizes, capacity)
        order = np.argsort(window, kind="stable")
        table, window = table.take(pa.array(order)), window[order]
        sizes = sizes[order]
        before = np.cumsum(sizes) - sizes
        first = np.concatenate([[True], window[1:] != window[:-1]])
        offset = before - np.maximum.accumulate(np.where(first, before, 0))
        return table.drop_columns(["group", "row"]).append_column(
            "sequence_id", pa.array(group * (1 << 32) + window)).append_column("offset", pa.array(offset))

    group = F.pmod(F.xxhash64("doc_id", "row", "start"), F.lit(groups)).alias("group")
    schema = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    placed = pieces.filter(small).select("*", group).groupBy("group").applyInArrow(place, schema)
    own = (F.lit(FULL_WINDOWS) + F.monotonically_increasing_id()).alias("sequence_id")
    full = pieces.filter(~small).drop("row").select("*", own, F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(full)


def pack_documents(
    docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
    capacity: int = CAPACITY, piece_limit: int = PIECE_LIMIT, group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """One row per piece with its window (``sequence_id``) and its place there (``offset``)."""
    pieces = materialise(token_pieces(docs, tokenizer, end_id, id_col, text_col, capacity, piece_limit), "pieces")
    return pack_pieces(pieces, capacity, group_pieces)
