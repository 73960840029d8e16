"""Token counts without ids: each distinct pre-token is counted once and joined to its frequencies.

Texts are cut into pre-tokens where they are read. A task groups its rows into blocks and
sends, for each block and each of P parts of the pre-tokens, the distinct pre-tokens with
the documents (as numbers in the block) and frequencies they have there. A part counts the
pieces of each of its distinct pre-tokens once, with the tokenizer's model, multiplies,
and returns to each block the sums of its documents; a block adds up what its parts return.
Each block also sends one head with the ids and sizes of its documents, which takes the same way:
texts are read once, and no numbering of rows has to agree between two readings.

A pre-token that many documents of a block have is dealt to a part by itself and its block
rather than by itself alone, so that no part has to take in the rows of a hot one; it is
then counted once in each of those parts.

A part holds its distinct pre-tokens and one row of a block at a time, a block what its few
megabytes of text return, whatever the size of the table. Where a lost task may see its rows in
another order when it is run again (a table behind a shuffle), give a written table.

Null and empty texts are documents with no token, and one of any length is a block of its own.
Each row is a document of its own, also where ids repeat or are null. An empty table gives an
empty table. Further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.llm.blocks import binary_lengths, filled, held, offsets_of, ragged_positions, slices
from threadlens.llm.codecs import Codec

HOT_SHARE = 8  # a pre-token in more than one of so many documents of a block is dealt by block
SPECIAL = "\x00"  # before the text of an added token, which counts as one
MAPPED = "\x02"  # before a pre-token that is in the model's alphabet already
# A head has the documents' ids (with a byte for each that tells nulls), and sizes in place of entries.
BLOCK_SCHEMA = (
    "part int, block long, names binary, words array<string>, entries binary, docs binary, freqs binary"
)
SUM_SCHEMA = "block long, names binary, sums binary, nulls binary"
COUNT_SCHEMA = "doc_id long, n_bytes long, n_tokens long"


class PreTokens:
    """Cuts texts into pre-tokens and counts the pieces of one."""

    def __init__(self, path: str) -> None:
        self.codec = Codec(path)
        self.library = self.codec.library

    def _whole(self, text: str) -> list[str]:
        """Pre-tokens by the library's own steps."""
        out, at = [], 0
        for hit in [*self.codec.special.finditer(text), None]:
            plain = text[at : hit.start()] if hit else text[at:]
            if self.library.normalizer is not None:
                plain = self.library.normalizer.normalize_str(plain)
            out += [MAPPED + p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(plain)] if plain else []
            if hit:
                out.append(SPECIAL + hit.group())
                at = hit.end()
        return out

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
        """Pre-token numbers of all texts, the distinct pre-tokens, and the offsets of the texts."""
        which, words, bounds = self.codec.split(texts)
        numbers: dict[str, int] = {}
        cuts = [self._whole(c) if type(c) is str else c for c in self.codec.cuts(words)]
        odd = np.array([c is None for c in cuts], bool)
        flat = np.array([numbers.setdefault(p, len(numbers)) for c in cuts if c for p in c], np.int64)
        sizes = np.array([len(c) if c else 0 for c in cuts], np.int64)
        starts = np.cumsum(sizes) - sizes
        out = flat[ragged_positions(starts[which], sizes[which])] if len(flat) else flat
        offsets = offsets_of(sizes[which])[bounds]
        if odd.any():
            bad = np.flatnonzero(np.diff(offsets_of(odd[which])[bounds]) > 0)
            parts = [out[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
            for i in bad:
                found = self._whole(texts[int(i)].as_py())
                parts[i] = np.array([numbers.setdefault(p, len(numbers)) for p in found], np.int64)
            out, offsets = np.concatenate(parts), offsets_of(np.array([len(p) for p in parts], np.int64))
        return out, list(numbers), offsets

    def pieces(self, pre_token: str) -> int:
        head = pre_token[:1]
        if head == SPECIAL:
            return 1
        return len(self.codec.model.tokenize(pre_token[1:] if head == MAPPED else self.codec.mapped(pre_token)))


def _whole_texts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """For files without pre-tokens of their own (sentencepiece models): the library counts each text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer.endswith(".model"):
            import sentencepiece

            library = held(("sentencepiece", tokenizer),
                           lambda: sentencepiece.SentencePieceProcessor(model_file=tokenizer))
            of = lambda texts: [len(x) for x in library.encode(texts)]
        else:
            codec = held(("codec", tokenizer), lambda: Codec(tokenizer))
            of = lambda texts: [len(x) // 4 for x in codec._whole(texts)]
        for batch in slices(batches, "text"):
            texts = batch.column("text")
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(binary_lengths(texts)), pa.array(of(filled(texts).to_pylist()), pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"])

    return docs.mapInArrow(count, COUNT_SCHEMA)


def _blocks(docs: DataFrame, tokenizer: str, parts: int) -> DataFrame:
    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = held(("pretokens", tokenizer), lambda: PreTokens(tokenizer))
        schema = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("names", pa.binary()), ("words", pa.list_(pa.string())),
                            ("entries", pa.binary()), ("docs", pa.binary()), ("freqs", pa.binary())])

        def sent(*row) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

        first = TaskContext.get().partitionId() << 32
        for number, batch in enumerate(slices(batches, "text"), first):
            ids, sizes = batch.column("doc_id"), binary_lengths(batch.column("text"))
            salt = zlib.crc32(number.to_bytes(8, "little"))
            yield sent(salt % parts, number, ids.fill_null(0).to_numpy().astype("<i8").tobytes(), None, sizes.astype("<i8").tobytes(),
                       ids.is_null().to_numpy(zero_copy_only=False).tobytes(), None)
            which, words, offsets = cutter.texts(filled(batch.column("text")))
            if not words:
                continue
            n, width = batch.num_rows, len(words)
            doc = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
            # pairs of pre-token and document in order, with their frequencies
            pairs, freq = np.unique(which * n + doc, return_counts=True)
            word, doc = pairs // n, pairs % n
            entries = np.bincount(word, minlength=width)
            keys = np.array([zlib.crc32(w.encode()) for w in words], np.int64)
            hot = entries * HOT_SHARE > n + 8 * HOT_SHARE
            part = np.where(hot, (keys ^ salt) * 40503 % 4294967291, keys) % parts
            order = np.argsort(part, kind="stable")
            starts = np.cumsum(entries) - entries
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            for p in range(parts):
                mine = order[cuts[p] : cuts[p + 1]]
                if not len(mine):
                    continue
                at = ragged_positions(starts[mine], entries[mine])
                found, where = np.unique(doc[at], return_inverse=True)
                yield sent(p, number, found.astype("<u4").tobytes(), [words[i] for i in mine], entries[mine].astype("<u4").tobytes(),
                           where.astype("<u4" if n > 65536 else "<u2").tobytes(), _small(freq[at]))

    return docs.mapInArrow(block, BLOCK_SCHEMA)


def _small(freq: np.ndarray) -> bytes:
    """Frequencies as bytes; those of 255 and more follow as 32-bit numbers."""
    large = freq >= 255
    return np.where(large, 255, freq).astype(np.uint8).tobytes() + freq[large].astype("<u4").tobytes()


def _large(data: bytes, n: int) -> np.ndarray:
    freq = np.frombuffer(data, np.uint8, n).astype(np.int64)
    freq[freq == 255] = np.frombuffer(data, "<u4", offset=n)
    return freq


def _part_sums(blocks: DataFrame, tokenizer: str) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = held(("pretokens", tokenizer), lambda: PreTokens(tokenizer))
        counts: dict[str, int] = {}  # of the distinct pre-tokens of this task's parts
        for batch in batches:
            for i in range(batch.num_rows):
                block, names = batch.column("block").slice(i, 1), batch.column("names").slice(i, 1)
                raw, nulls = batch.column("docs")[i].as_py(), None
                if not batch.column("words")[i].is_valid:  # a head goes on as it is
                    sums, nulls = batch.column("entries")[i].as_py(), raw
                else:
                    words = batch.column("words")[i].values.to_pylist()
                    for w in words:
                        if w not in counts:
                            counts[w] = cutter.pieces(w)
                    entries = np.frombuffer(batch.column("entries")[i].as_py(), "<u4")
                    total = int(entries.sum())
                    doc = np.frombuffer(raw, "<u2" if len(raw) == 2 * total else "<u4")
                    freq = _large(batch.column("freqs")[i].as_py(), total)
                    each = np.repeat(np.array([counts[w] for w in words], np.int64), entries) * freq
                    sums = np.bincount(doc, each, minlength=len(names[0].as_py()) // 4).astype("<i8").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [block, names, pa.array([sums], pa.binary()), pa.array([nulls], pa.binary())],
                    ["block", "names", "sums", "nulls"])

    return blocks.mapInArrow(count, SUM_SCHEMA)


def _block_sums(sums: DataFrame) -> DataFrame:
    """The counts of each block's documents: what the parts return to it, added up."""

    def add(table: pa.Table) -> pa.Table:
        heads = table["nulls"].is_valid().to_numpy()
        head = table.slice(int(np.flatnonzero(heads)[0]), 1).to_pylist()[0]
        parts = table.filter(pa.array(~heads))
        ids, nulls = np.frombuffer(head["names"], "<i8"), np.frombuffer(head["nulls"], bool)
        read = lambda name, kind: np.frombuffer(b"".join(parts[name].to_pylist()), kind)
        n = np.bincount(read("names", "<u4"), read("sums", "<i8"), minlength=len(ids)).astype(np.int64)
        return pa.table({"doc_id": pa.array(ids, mask=nulls), "n_bytes": np.frombuffer(head["sums"], "<i8"), "n_tokens": n})

    return sums.groupBy("block").applyInArrow(add, COUNT_SCHEMA)


def count_tokens(
    docs: DataFrame, tokenizer: str, limit: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of each row, without added or special tokens of the call."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if tokenizer.endswith(".model") or Codec(tokenizer).family == "whole":
        counts = _whole_texts(rows, tokenizer)
    else:
        counts = _block_sums(_part_sums(_blocks(rows, tokenizer, parts).repartition(parts, "part"), tokenizer))
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
