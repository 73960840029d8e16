"""Documents drawn to look like a target: array-scored weights, noise, and the highest scores.

Words of a text, and runs of up to ``max_run`` of them, fall into ``buckets`` by their CRC-32.
Bucket counts of all documents and of all target texts give each bucket a gain, the scaled
logarithm of its smoothed target share over its share here; an array of all gains, one number
a bucket, goes to the tasks, and a document's weight is the floored mean of the gains of its
features. Texts are cut once: bucket numbers are stored and both counted and scored from there.

Noise from a hash of the id is added, and the highest ``percent`` of the documents with enough
words are drawn (draws without replacement in proportion to exp(weight / 1000)). The lowest
score drawn is found in a bracket: a mergeable quantile sketch of all scores proposes it,
exact counts outside confirm it or widen it, and only the rows inside are sorted. A sketch
thus decides how much is sorted and never what is drawn.

Null and empty texts have no features and weight 0. Each row is a document of its own, also where
ids repeat or are null; a null id draws its noise from the empty name and loses ties. Rows that tie
in score and id are drawn in any order, and their values are equal. Empty tables give empty tables,
and an empty target gives gains from the smoothing alone. Further columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.llm.blocks import filled, offsets_of, ragged_positions, slices
from threadlens.llm.ordering import placed
from threadlens.session import materialise

BUCKETS = 10_000
MAX_RUN = 1
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
SKETCH_SIZE = 800
LONG = 64  # longer features are hashed one by one


def _folded() -> np.ndarray:
    """Bytes of words with A-Z lower-cased, 0 for all others."""
    table = np.zeros(256, np.uint8)
    for span in (range(ord("0"), ord("9") + 1), range(ord("a"), ord("z") + 1), range(128, 256)):
        table[list(span)] = list(span)
    table[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
    return table


def _crc_table() -> np.ndarray:
    """What each byte does to a CRC-32 (polynomial 0xEDB88320)."""
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, crc >> 1 ^ np.uint32(0xEDB88320), crc >> 1)
    return crc


FOLDED, CRC_TABLE = _folded(), _crc_table()


def crc32_of(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of each stretch of ``data``, one byte of all stretches at a time."""
    capped = np.minimum(lengths, LONG + 1).astype(np.int16)
    order = np.argsort(-capped, kind="stable")
    at, sizes, falling = starts[order], lengths[order], -capped[order]
    crc = np.full(len(at), 0xFFFFFFFF, np.uint32)
    for j in range(LONG):
        n = int(np.searchsorted(falling, -j))  # so many are longer than j
        if not n:
            break
        crc[:n] = CRC_TABLE[(crc[:n] ^ data[at[:n] + j]) & 0xFF] ^ crc[:n] >> 8
    crc = ~crc
    for i in np.flatnonzero(sizes > LONG).tolist():
        crc[i] = zlib.crc32(data[at[i] : at[i] + sizes[i]])
    out = np.empty_like(crc)
    out[order] = crc
    return out


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes of all texts, starts and lengths of their words, and the word offsets of the texts."""
    texts = filled(texts)
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[: len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = FOLDED[np.frombuffer(raw, np.uint8)[: bounds[-1]]] if raw is not None else np.zeros(0, np.uint8)
    inside = data != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    borders = bounds[(bounds > 0) & (bounds < len(data))]
    first[borders] |= inside[borders]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[borders - 1] |= inside[borders - 1]
    starts = np.flatnonzero(first)
    return data, starts, np.flatnonzero(last) + 1 - starts, np.searchsorted(starts, bounds)


def features_of(texts: pa.Array, max_run: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket numbers of the features of all texts, their offsets, and the word offsets of the texts."""
    data, starts, lengths, words = words_of(texts)
    if max_run == 1:
        return crc32_of(data, starts, lengths) % np.uint32(buckets), words, words
    # words one space apart, so that a run of words is one stretch
    joined = np.full(int((lengths + 1).sum()), ord(" "), np.uint8)
    new = np.cumsum(lengths + 1) - lengths - 1
    joined[ragged_positions(new, lengths)] = data[ragged_positions(starts, lengths)]
    ends = new + lengths
    doc = np.repeat(np.arange(len(words) - 1), np.diff(words))
    numbers, owners = [], []
    for size in range(1, max_run + 1):
        head = np.arange(max(0, len(new) - size + 1))
        head = head[doc[head] == doc[head + size - 1]]
        numbers.append(crc32_of(joined, new[head], ends[head + size - 1] - new[head]) % np.uint32(buckets))
        owners.append(doc[head])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(numbers)[order], offsets_of(np.bincount(owner, minlength=len(words) - 1)), words


def bucketed(rows: DataFrame, max_run: int, buckets: int) -> DataFrame:
    """``id, row, n_words, n_features, features`` of rows with ``id, row, text``; features as packed bucket numbers."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            numbers, offsets, words = features_of(batch.column("text"), max_run, buckets)
            packed = numbers.astype(kind)
            parts = [packed[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("row"), pa.array(np.diff(words), pa.int64()),
                 pa.array(np.diff(offsets), pa.int64()), pa.array(parts, pa.binary())],
                ["id", "row", "n_words", "n_features", "features"])

    return rows.select("id", "row", "text").mapInArrow(
        cut, "id long, row long, n_words long, n_features long, features binary")


def bucket_counts(features: DataFrame, buckets: int) -> list[int]:
    """How often each bucket is hit; tasks add up arrays of ``buckets`` numbers, and so many rows come back."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches, "features"):
            total += np.bincount(np.frombuffer(b"".join(batch.column("features").to_pylist()), kind), minlength=buckets)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(total[hit])], ["bucket", "n"])

    sums = features.select("features").mapInArrow(add, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = [0] * buckets
    for bucket, n in sums.collect():
        counts[bucket] = n
    return counts


def bucket_gains(here: list[int], target: list[int]) -> list[int]:
    """``floor(1000 * ln(...))`` of the smoothed target share over the share here, in doubles."""
    size = len(here)
    all_here, all_target = float(sum(here) + size), float(sum(target) + size)
    return [math.floor(1000 * math.log((t + 1.0) * all_here / ((s + 1.0) * all_target))) for s, t in zip(here, target)]


def scored(features: DataFrame, gains: list[int], buckets: int, seed: int) -> DataFrame:
    """``id, row, n_words, n_features, weight, score``."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    draw = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.array(gains, np.int64)
        for batch in slices(batches, "features"):
            n = batch.column("n_features").to_numpy()
            values = table[np.frombuffer(b"".join(batch.column("features").to_pylist()), kind)]
            sums = offsets_of(values)[offsets_of(n)]
            weight = (sums[1:] - sums[:-1]) // np.maximum(n, 1)
            share = (batch.column("draw").to_numpy() + 0.5) / 4294967296
            noise = np.floor(-1000 * np.log(-np.log(share))).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("row"), batch.column("n_words"), batch.column("n_features"),
                 pa.array(weight), pa.array(weight + noise)],
                ["id", "row", "n_words", "n_features", "weight", "score"])

    return features.withColumn("draw", draw).select("id", "row", "n_words", "n_features", "features", "draw").mapInArrow(
        score, "id long, row long, n_words long, n_features long, weight long, score long")


def _order() -> list[Column]:
    return [F.desc("score"), F.asc_nulls_last("id"), F.asc("row")]


def cutoff(able: DataFrame, share: float, wanted: int, total: int, sketch: bytes, size: int, margin: float | None = None):
    """The row ``(score, id, row)`` at place ``wanted`` of ``able`` in falling order of scores.

    ``sketch`` summarises the scores of all ``total`` rows; ``margin`` is the share of rows on each
    side of the cut that the first bracket takes in, by default the sketch's usual error.
    """
    spark = able.sparkSession
    # the usual error of a sketch of this size, as its authors measured it
    margin = 2.296 / size**0.9021 if margin is None else margin
    summary = spark.createDataFrame([(sketch,)], "sketch binary")
    while True:
        low, high = share - margin, share + margin
        quantile = lambda q: F.kll_sketch_get_quantile_bigint("sketch", F.lit(q)) if 0 < q < 1 else F.lit(None)
        low, high = summary.select(quantile(low).cast("long"), quantile(high).cast("long")).first()
        over = F.lit(False) if high is None else F.col("score") > high
        within = F.lit(True) if low is None else F.col("score") >= low
        above, reached = able.agg(F.count_if(over), F.count_if(within)).first()
        if above < wanted <= reached:
            break
        margin = margin * 4 + 1 / total
    inside = placed(able.filter(within & ~over).select("score", "id", "row"), *_order())
    return inside.filter(F.col("place") == wanted - above - 1).select("score", "id", "row").first()


def _drawn(cut) -> Column:
    """Whether a row comes at or before the row ``cut``."""
    if cut.id is None:
        earlier = F.col("id").isNotNull() | (F.col("row") <= cut.row)
    else:
        earlier = F.coalesce((F.col("id") < cut.id) | ((F.col("id") == cut.id) & (F.col("row") <= cut.row)), F.lit(False))
    return (F.col("score") > cut.score) | ((F.col("score") == cut.score) & earlier)


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, max_run: int = MAX_RUN,
    buckets: int = BUCKETS, seed: int = SEED, sketch_size: int = SKETCH_SIZE, margin: float | None = None,
    id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row; ``rank`` is null where a row is not drawn."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"),
                       F.col(text_col).alias("text"))
    features = materialise(bucketed(rows, max_run, buckets), "features")
    aim = target.select(F.lit(None).cast("long").alias("id"), F.lit(0).cast("long").alias("row"),
                        F.col(target_col).alias("text"))
    gains = bucket_gains(bucket_counts(features, buckets), bucket_counts(bucketed(aim, max_run, buckets), buckets))
    scores = materialise(scored(features, gains, buckets, seed), "scores")
    able = scores.filter(F.col("n_words") >= least_words)
    total, sketch = able.agg(F.count("*"), F.kll_sketch_agg_bigint("score", F.lit(sketch_size))).first()
    wanted = percent * total // 100
    out = [F.col("id").alias(id_col), "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if not wanted:
        return scores.select(*out, none)
    drawn = (F.col("n_words") >= least_words) & _drawn(
        cutoff(able, 1 - wanted / total, wanted, total, bytes(sketch), sketch_size, margin))
    ranked = placed(scores.filter(drawn), *_order())
    return ranked.select(*out, (F.col("place") + 1).alias("rank")).unionByName(
        scores.filter(~drawn).select(*out, none))
