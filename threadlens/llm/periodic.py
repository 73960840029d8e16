"""Runs of repeated word sequences, and texts without the repetitions.

A run is a stretch of words with smallest period q, at least ``min_exponent`` periods and
``min_words`` words long, that cannot be extended keeping its period. The words of each text get a
suffix array by prefix doubling, all texts of a slice at once; texts without a repeat as long as a
run must bring are left out on the way, which loses none. For the rest the array is enhanced by its
inverse and the LCP array. Each border of an LCP interval of depth d parts it in two; every suffix
i of the smaller part looks, through the inverse, for i + d and i - d in the other part: these are
just the squares of period d whose next word breaks the period. Interval borders come from one stack
over the LCP array, no tree is built, and smaller parts sum up to O(n log n).

Such a square is the last one of its stretch. It is rotated to the left word by word (in growing
strides) as far as the period holds, and squares that end together merge into the run of the smallest
period, which divides the others.

Null, empty and blank texts have no words and no run. Texts are read whole, whatever their length;
memory grows with the longest one. Rows are independent: repeated or null ids and ties between rows
change nothing. An empty table gives an empty table. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.llm.blocks import filled, offsets_of, ragged_positions, slices

MIN_WORDS = 24
MIN_EXPONENT = 3
SLICE = 4 << 20
CHUNK = 1 << 20  # suffixes looked up at once
RUN = "struct<start: long, length: long, period: long>"
FOUND = f"id long, n_words long, runs array<{RUN}>, collapsed string"


def coded_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of all texts, a number for each distinct one, and the word offsets of the texts."""
    lists = pc.ascii_split_whitespace(filled(texts))
    parts = lists.flatten()
    real = pc.binary_length(parts).to_numpy() > 0
    words = parts.filter(pa.array(real))
    codes = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    return words, codes, offsets_of(real)[lists.offsets.to_numpy()]


def sorted_suffixes(codes: np.ndarray, bounds: np.ndarray, repeat: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix arrays of the texts, one after the other, and which texts repeat a sequence of ``repeat`` words.

    The text's number leads a suffix's key, so texts keep
    apart, and a suffix that reaches the end of its text differs there from all others.
    """
    n = len(codes)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    key = doc * (int(codes.max(initial=0)) + 1) + codes
    order = np.argsort(key, kind="stable")
    alive = np.arange(n)  # places in ``order`` that share their rank with others
    rank, known, gated = np.empty(n, np.int64), 1, None
    key = key[order]
    while True:
        fresh = np.ones(len(key), bool)
        fresh[1:] = key[1:] != key[:-1]
        heads = np.flatnonzero(fresh)
        sizes = np.diff(np.append(heads, len(key)))
        rank[order[alive]] = np.repeat(alive[heads], sizes)
        alive = alive[np.repeat(sizes > 1, sizes)]
        if gated is None and known * 2 > repeat:
            gated = np.zeros(len(bounds) - 1, bool)
            gated[doc[order[alive]]] = True
        if not len(alive):
            return order, gated if gated is not None else np.zeros(len(bounds) - 1, bool)
        suffix = order[alive]
        after = suffix + known
        key = rank[suffix] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        turn = np.argsort(key, kind="stable")
        order[alive], key = suffix[turn], key[turn]
        known *= 2


def common_prefixes(words: list[int], suffixes: list[int], places: list[int]) -> list[int]:
    """Length of the common prefix of each suffix with the one before it in order."""
    n, found, h = len(words), [0] * len(words), 0
    for i in range(n):
        place = places[i]
        if not place:
            h = 0
            continue
        j = suffixes[place - 1]
        most = n - (i if i > j else j)
        while h < most and words[i + h] == words[j + h]:
            h += 1
        found[place] = h
        if h:
            h -= 1
    return found


def interval_parts(prefixes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For each border x: where its interval's left part begins, and where its right part ends (exclusive)."""
    n = len(prefixes)
    left, right, stack = [0] * n, [n] * n, [0]
    for x in range(1, n):
        depth = prefixes[x]
        while stack and prefixes[stack[-1]] >= depth:
            right[stack.pop()] = x
        if depth:
            left[x] = stack[-1]
            stack.append(x)
        else:
            stack = [x]
    return np.array(left, np.int64), np.array(right, np.int64)


def last_squares(suffixes: np.ndarray, places: np.ndarray, prefixes: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Starts and periods of all squares that the next word breaks, in chunks."""
    left, right = interval_parts(prefixes)
    depth, n = np.array(prefixes, np.int64), len(suffixes)
    border = np.flatnonzero(depth > 0)
    a, b = left[border], right[border]
    lesser = border - a <= b - border
    start, size = np.where(lesser, a, border), np.where(lesser, border - a, b - border)
    low, high = np.where(lesser, border, a), np.where(lesser, b, border)  # the other part
    cuts = np.searchsorted(np.cumsum(size), np.arange(CHUNK, int(size.sum()) + CHUNK, CHUNK), side="left") + 1
    for x, y in zip([0, *cuts[:-1].tolist()], cuts.tolist()):
        mine = slice(x, y)
        i = suffixes[ragged_positions(start[mine], size[mine])]
        d, lo, hi = (np.repeat(v[mine], size[mine]) for v in (depth[border], low, high))
        for other in (i + d, i - d):
            valid = (other >= 0) & (other < n)
            place = places[np.where(valid, other, 0)]
            hit = valid & (place >= lo) & (place < hi)
            yield np.minimum(i, other)[hit], d[hit]


def runs_of(codes: np.ndarray, suffixes: np.ndarray, min_words: int, min_exponent: int) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs of one text, by start, then period."""
    n = len(codes)
    places = np.empty(n, np.int64)
    places[suffixes] = np.arange(n)
    prefixes = common_prefixes(codes.tolist(), suffixes.tolist(), places.tolist())
    starts, periods = [], []
    for s, d in last_squares(suffixes, places, prefixes):
        # how far a run must reach back before its last square; most squares fail at one of three words there
        reach = np.maximum(np.maximum(min_words, min_exponent * d) - 2 * d, 0)
        able = s >= reach
        for step in (reach, reach // 2, np.minimum(reach, 1)):
            at = np.maximum(s - step, 0)
            able &= codes[at] == codes[at + d]
        starts.append(s[able])
        periods.append(d[able])
    if not starts:
        return []
    s, d = np.concatenate(starts), np.concatenate(periods)
    order = np.lexsort((d, s + 2 * d))
    runs, ended, last = [], [], -1  # ``ended``: start and period of the runs with the present end
    for at, q in zip(s[order].tolist(), d[order].tolist()):
        end = at + 2 * q
        if end != last:
            ended, last = [], end
        if any(q % period == 0 and start <= at for start, period in ended):
            continue
        start = rotated(codes, at, q)
        if end - start >= max(min_words, min_exponent * q):
            ended.append((start, q))
            runs.append((start, end - start, q))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def rotated(codes: np.ndarray, start: int, period: int) -> int:
    """How far to the left the period holds."""
    stride = 64
    while start > 0:
        low = max(0, start - stride)
        breaks = np.flatnonzero(codes[low:start] != codes[low + period : start + period])
        if len(breaks):
            return low + int(breaks[-1]) + 1
        start, stride = low, min(2 * stride, 1 << 16)
    return 0


def collapse_runs(
    docs: DataFrame, min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of each row.

    ``runs`` lists start, length and period in words, by start, then period. ``collapsed`` holds the
    words one space apart, without those that any run holds after its first period.
    """
    if min_exponent < 2 or min_words < 2:
        raise ValueError("a run has at least two periods and two words")
    # a run and its shift by one period share this many words at least
    repeat = -(-min_words * (min_exponent - 1) // min_exponent)

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in slices(batches, "text", SLICE):
            words, codes, bounds = coded_words(batch.column("text"))
            suffixes, able = sorted_suffixes(codes, bounds, repeat)
            cover = np.zeros(len(codes) + 1, np.int64)
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for k in np.flatnonzero(able).tolist():
                a, b = int(bounds[k]), int(bounds[k + 1])
                for start, length, period in runs_of(codes[a:b], suffixes[a:b] - a, min_words, min_exponent):
                    found[k].append({"start": start, "length": length, "period": period})
                    cover[a + start + period] += 1
                    cover[a + start + length] -= 1
            kept = np.cumsum(cover)[:-1] == 0
            lists = pa.ListArray.from_arrays(
                pa.array(offsets_of(kept)[bounds], pa.int32()), words.filter(pa.array(kept)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(np.diff(bounds), pa.int64()), pa.array(found, kind),
                 pc.binary_join(lists, " ")],
                ["id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(collapse, FOUND).withColumnRenamed("id", id_col)
