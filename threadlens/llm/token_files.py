"""Token ids of a corpus as directly addressable files, in ascending document order.

A file is a Parquet table written and committed by Spark: one row per segment with its
place (``part``, ``part_start``), its documents and their lengths, and the encoded ids
(see ``dac``). Parts ascend with the ids of the documents, segments ascend in their part,
and a segment holds whole documents, about ``segment_tokens`` tokens or one document.

Null and empty texts get the end id alone; a text of any length is one document of one segment.
Null ids come first, and rows that repeat an id lie side by side (all rows of one id are written by
one task, a segment at a time). An empty table gives files without a segment, which read as an empty
table. Further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadlens.llm import dac
from threadlens.llm.blocks import filled, held, offsets_of, slices
from threadlens.llm.codecs import Codec

SEGMENT_TOKENS = 1 << 20
FILE_SCHEMA = "part int, part_start long, doc_ids array<long>, lengths array<long>, n_tokens long, payload binary"
ROW_SCHEMA = "doc_id long, part int, in_part long, n_tokens long, ids_crc32 long"


def encode_segments(
    docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
    segment_tokens: int = SEGMENT_TOKENS,
) -> DataFrame:
    """The rows of a token file. Texts are dealt by id ranges, so each is shuffled and encoded once."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = held(("codec", tokenizer), lambda: Codec(tokenizer))
        schema = pa.schema([("part", pa.int32()), ("part_start", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                            ("lengths", pa.list_(pa.int64())), ("n_tokens", pa.int64()), ("payload", pa.binary())])
        part, done = TaskContext.get().partitionId(), 0
        waiting_docs, waiting_sizes, waiting_ids, tokens = [], [], [], 0

        def segment() -> pa.RecordBatch:
            sizes = np.concatenate(waiting_sizes)
            names = pa.chunked_array(waiting_docs).combine_chunks()
            row = [pa.array([part], pa.int32()), pa.array([done], pa.int64()),
                   pa.ListArray.from_arrays([0, len(names)], names), pa.ListArray.from_arrays([0, len(sizes)], sizes),
                   pa.array([tokens], pa.int64()), pa.array([dac.encode(np.concatenate(waiting_ids))], pa.binary())]
            return pa.RecordBatch.from_arrays(row, schema=schema)

        for batch in slices(batches, "text"):
            ids, offsets = codec.encode(filled(batch.column("text")))
            sizes = np.diff(offsets) + 1
            whole = np.empty(len(ids) + len(sizes), np.uint32)
            ends = np.cumsum(sizes) - 1
            keep = np.ones(len(whole), bool)
            keep[ends] = False
            whole[keep], whole[ends] = ids, end_id
            waiting_docs.append(batch.column("doc_id"))
            waiting_sizes.append(sizes)
            waiting_ids.append(whole)
            tokens += len(whole)
            if tokens >= segment_tokens:
                yield segment()
                done += tokens
                waiting_docs, waiting_sizes, waiting_ids, tokens = [], [], [], 0
        codec.rest()
        if tokens:
            yield segment()

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dealt = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    return dealt.mapInArrow(encode, FILE_SCHEMA)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, **options) -> None:
    """Write the token file of ``docs`` to ``path``."""
    encode_segments(docs, tokenizer, end_id, **options).write.mode("errorifexists").parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of a token file: its place, length and the checksum of its ids."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                names = batch.column("doc_ids")[i].values
                sizes = batch.column("lengths")[i].values.to_numpy()
                segment = dac.Segment(batch.column("payload")[i].as_py())
                places = offsets_of(sizes)
                ids = segment.read(0, len(segment)).astype("<u4")
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(places[:-1], places[1:])]
                part, start = batch.column("part")[i].as_py(), batch.column("part_start")[i].as_py()
                yield pa.RecordBatch.from_arrays(
                    [names, pa.array(np.full(len(sizes), part, np.int32)), pa.array(places[:-1] + start),
                     pa.array(sizes), pa.array(crc, pa.int64())],
                    ["doc_id", "part", "in_part", "n_tokens", "ids_crc32"])

    return spark.read.schema(FILE_SCHEMA).parquet(path).mapInArrow(decode, ROW_SCHEMA)


def part_starts(spark: SparkSession, path: str) -> DataFrame:
    """Tokens before each part; one row per part of the file, whatever the number of documents."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = spark.read.schema(FILE_SCHEMA).parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    return sizes.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("before"))


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of a token file; ``start`` counts the ids of all documents before."""
    rows = read_documents(spark, path).join(part_starts(spark, path), "part")
    return rows.select("doc_id", (F.col("before") + F.col("in_part")).alias("start"), "n_tokens", "ids_crc32")


def read_tokens(spark: SparkSession, path: str, doc_ids: DataFrame) -> DataFrame:
    """Ids of the documents named in ``doc_ids.doc_id``, by direct access to their ranges."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                segment = dac.Segment(batch.column("payload")[i].as_py())
                a, n = batch.column("first")[i].as_py(), batch.column("length")[i].as_py()
                ids = pa.array([segment.read(a, a + n).astype(np.int64)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, 1), ids], ["doc_id", "ids"])

    segments = spark.read.schema(FILE_SCHEMA).parquet(path)
    before = F.expr("aggregate(slice(lengths, 1, pos), 0L, (a, x) -> a + x)")
    places = segments.select("part", "part_start", "lengths", F.posexplode("doc_ids").alias("pos", "doc_id"))
    places = places.join(doc_ids.select("doc_id").distinct(), "doc_id").select(
        "part", "part_start", "doc_id", before.alias("first"), F.expr("lengths[pos]").alias("length"))
    wanted = places.join(segments.select("part", "part_start", "payload"), ["part", "part_start"])
    return wanted.select("doc_id", "first", "length", "payload").mapInArrow(decode, "doc_id long, ids array<long>")
