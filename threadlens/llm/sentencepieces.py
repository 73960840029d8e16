"""SentencePiece encoding and decoding with the tokenizers library.

The model file is parsed here, field by field, and rebuilt as a tokenizer of that library:
normaliser (character map, extra spaces, marker for spaces, leading marker), a unigram model
from the pieces' scores or a merge model whose merges are ranked by them, byte fallback for
what no piece covers, and the decoder that undoes all of it.

Texts are cut at single spaces and line ends, where a model without pieces across them
always cuts as well; the distinct words of a slice go through the library as one batch, on
``threads`` threads, and ids are gathered back. Texts with other white space are encoded
whole. Each distinct word and each such text is also encoded by the sentencepiece library:
``parity`` says whether both agree on all of a text, and where they do not, the result has
the ids of the sentencepiece library.

Null and empty texts have no ids; texts of any length are encoded whole. Each row is a document
of its own, also where ids repeat or are null. An empty table gives an empty table. Further
columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.llm.blocks import Recent, filled, held, offsets_of, ragged_positions, slices

SPACE_MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
THREADS = 2
WORDS_KEPT = 150_000
FIRST = "\x01"
ROW_SCHEMA = "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean, parity boolean"


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Number and raw value of each field of a protobuf message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        else:
            if kind == 2:
                size, at = varint(at)
            else:
                size = {1: 8, 5: 4}[kind]
            value, at = data[at : at + size], at + size
        yield key >> 3, value


@dataclass
class Model:
    """What a model file says."""

    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    spaces_after: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    trim_spaces: bool = True
    mark_spaces: bool = True

    @property
    def unk_id(self) -> int:
        return self.kinds.index(UNKNOWN)


def parse(data: bytes) -> Model:
    model = Model()
    for number, value in fields(data):
        if number == 1:
            piece = dict(fields(value))
            model.pieces.append(piece[1].decode())
            model.scores.append(struct.unpack("<f", piece.get(2, bytes(4)))[0])
            model.kinds.append(piece.get(3, NORMAL))
        elif number == 2:
            trainer = dict(fields(value))
            model.model_type = trainer.get(3, UNIGRAM)
            model.spaces_after = bool(trainer.get(24, 0))
            model.byte_fallback = bool(trainer.get(35, 0))
        elif number == 3:
            spec = dict(fields(value))
            model.charsmap = spec.get(2, b"")
            model.dummy_prefix, model.trim_spaces = bool(spec.get(3, 1)), bool(spec.get(4, 1))
            model.mark_spaces = bool(spec.get(5, 1))
    if model.model_type not in (UNIGRAM, BPE):
        raise ValueError("only unigram and merge models are known")
    if model.spaces_after:
        raise ValueError("models that put the marker after a word are not known")
    return model


def merges_of(model: Model) -> list[tuple[str, str]]:
    """All ways to put a piece together from two others, the best-scored piece first."""
    ids = {p: i for i, p in enumerate(model.pieces)}
    usable = {p for p, k in zip(model.pieces, model.kinds, strict=True) if k in (NORMAL, USER_DEFINED, UNUSED)}
    found = []
    for piece in usable:
        for cut in range(1, len(piece)):
            left, right = piece[:cut], piece[cut:]
            if left in usable and right in usable:
                found.append((-model.scores[ids[piece]], ids[piece], ids[left], ids[right], left, right))
    return [(left, right) for *_, left, right in sorted(found)]


def build(model: Model):
    """The tokenizer that does what the model file says."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    unk = model.pieces[model.unk_id]
    if model.model_type == UNIGRAM:
        core = models.Unigram(list(zip(model.pieces, model.scores, strict=True)), model.unk_id, model.byte_fallback)
    else:
        core = models.BPE(
            vocab={p: i for i, p in enumerate(model.pieces)}, merges=merges_of(model), unk_token=unk, fuse_unk=True,
            byte_fallback=model.byte_fallback)
    out = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.trim_spaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(SPACE_MARK if model.mark_spaces else " "))
    if model.mark_spaces:
        steps.append(normalizers.Replace(" ", SPACE_MARK))
    if steps:
        out.normalizer = normalizers.Sequence(steps)
    back = [decoders.Replace(SPACE_MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    out.decoder = decoders.Sequence(back + ([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []))
    own = [p for p, k in zip(model.pieces, model.kinds, strict=True) if k == USER_DEFINED]
    if own:
        out.add_tokens([AddedToken(p, normalized=False) for p in own])
    return out


class PieceCodec:
    """Encodes and decodes texts by a model file, and checks itself against the sentencepiece library."""

    def __init__(self, path: str, threads: int = THREADS) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        with open(path, "rb") as file:
            data = file.read()
        self.model = parse(data)
        self.library = build(self.model)
        self.words = Tokenizer(self.library.model)  # for words that bear their marker already
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.known = Recent(WORDS_KEPT)
        self.threads = threads
        own = USER_DEFINED in self.model.kinds
        across = any(SPACE_MARK in p.lstrip(SPACE_MARK) or ("\n" in p and len(p) > 1) for p in self.model.pieces)
        plain = not self.model.charsmap and not self.model.trim_spaces
        self.cuts = plain and not own and not across and self.model.dummy_prefix and self.model.mark_spaces
        self.mark_id = self.model.pieces.index(SPACE_MARK) if SPACE_MARK in self.model.pieces else None
        self.cuts = self.cuts and self.mark_id is not None
        blobs = []
        for piece, kind in zip(self.model.pieces, self.model.kinds, strict=True):
            if kind == BYTE:
                blobs.append(bytes([int(piece[3:5], 16)]))
            elif kind == CONTROL:
                blobs.append(b"")
            elif kind == UNKNOWN:
                blobs.append(" ⁇ ".encode())
            else:
                blobs.append(piece.replace(SPACE_MARK, " ").encode())
        self.sizes = np.array([len(b) for b in blobs], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(blobs), np.uint8)

    def _whole(self, texts: list[str]) -> list[tuple[bytes, bool]]:
        ours = self.library.encode_batch_fast(texts, add_special_tokens=False)
        theirs = self.reference.encode(texts, num_threads=self.threads)
        out = []
        for text, a, b in zip(texts, ours, theirs, strict=True):
            ids = a.ids if text else []
            out.append((np.array(b, "<u4").tobytes(), ids == b))
        return out

    def _text(self, word: str) -> str | None:
        """What a word is encoded as; None if it makes its text irregular."""
        if word[:1] == "\n":
            body, marked = word[1:], word
        else:
            body = word[1:] if word[:1] == FIRST else word
            marked = SPACE_MARK + body
            if not body:
                return None
        return None if SPACE_MARK in body or FIRST in body or "\x00" in body else marked

    def _learn(self, words: list[str]) -> None:
        """Ids and parity of new words, by both libraries, a batch each."""
        texts = [self._text(w) for w in words]
        able = [i for i, t in enumerate(texts) if t is not None]
        for i, t in enumerate(texts):
            if t is None:
                self.known.new[words[i]] = (b"", False, True)
        ours = self.words.encode_batch_fast([texts[i] for i in able], add_special_tokens=False)
        theirs = self.reference.encode(
            [texts[i] if texts[i][0] == "\n" else texts[i][1:] for i in able], num_threads=self.threads)
        for i, a, b in zip(able, ours, theirs, strict=True):
            if texts[i][0] == "\n":  # the library put a marker first, which cannot join the line end
                b = b[1:] if b[:1] == [self.mark_id] else b
            self.known.new[words[i]] = (np.array(b, "<u4").tobytes(), a.ids == b, False)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids, the offsets of the texts, and whether both libraries agree on each."""
        if not self.cuts:
            got = self._whole(texts.to_pylist())
            return (np.frombuffer(b"".join(b for b, _ in got), "<u4"), offsets_of(np.array([len(b) // 4 for b, _ in got], np.int64)),
                    np.array([same for _, same in got], bool))
        marked = pc.binary_join_element_wise(pa.scalar(FIRST), pc.replace_substring(texts, "\n", " \n"), pa.scalar(""))
        lists = pc.split_pattern(marked, " ")
        coded = lists.flatten().dictionary_encode()
        which, bounds = coded.indices.to_numpy(), lists.offsets.to_numpy().astype(np.int64)
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.known.trim()
        fresh = [w for w in words if w not in self.known.new and self.known.again(w) is None]
        self._learn(fresh)
        found = [self.known.new[w] for w in words]
        sizes = np.array([len(b) // 4 for b, _, _ in found], np.int64)
        same = np.array([s for _, s, _ in found], bool)
        odd = np.array([o for _, _, o in found], bool)
        starts = np.cumsum(sizes) - sizes
        ids = np.frombuffer(b"".join(b for b, _, _ in found), "<u4")[ragged_positions(starts[which], sizes[which])]
        offsets = offsets_of(sizes[which])[bounds]
        agrees = np.diff(offsets_of(~same[which])[bounds]) == 0
        if odd.any():
            bad = np.flatnonzero(np.diff(offsets_of(odd[which])[bounds]) > 0)
            parts = [ids[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
            for i, (blob, equal) in zip(bad, self._whole(texts.take(pa.array(bad)).to_pylist()), strict=True):
                parts[i], agrees[i] = np.frombuffer(blob, "<u4"), equal
            ids, offsets = np.concatenate(parts), offsets_of(np.array([len(p) for p in parts], np.int64))
        return ids, offsets, agrees

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The UTF-8 text of each run of ids, without the leading marker's space."""
        sizes = self.sizes[ids]
        flat = self.bytes[ragged_positions(self.starts[ids], sizes)].tobytes()
        ends = offsets_of(sizes)[offsets].tolist()
        skip = self.model.dummy_prefix
        return [flat[a + (skip and flat[a : a + 1] == b" " and b > a) : b] for a, b in zip(ends[:-1], ends[1:])]


def encode_documents(
    docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", threads: int = THREADS
) -> DataFrame:
    """``doc_id, ids, parity`` of each row."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = held(("pieces", model, threads), lambda: PieceCodec(model, threads))
        for batch in slices(batches, "text"):
            ids, offsets, same = codec.encode(filled(batch.column("text")))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(same)], ["doc_id", "ids", "parity"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(encode, "doc_id long, ids array<int>, parity boolean")


def decode_documents(rows: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` of rows with ids; null ids give a null text, bytes that are no UTF-8 the replacement sign."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = held(("pieces", model, THREADS), lambda: PieceCodec(model))
        for batch in batches:
            lists = batch.column("ids")
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            texts = codec.decode(lists.flatten().to_numpy(zero_copy_only=False), offsets_of(sizes))
            out = [t.decode("utf-8", "replace") if v else None for t, v in zip(texts, lists.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return rows.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(
        decode, "doc_id long, text string")


def check_documents(
    docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", threads: int = THREADS
) -> DataFrame:
    """Per row: number and checksum of its ids, digest of the text decoded from them, whether that is the
    text itself, and whether both libraries agree; encoded and decoded in one pass."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = held(("pieces", model, threads), lambda: PieceCodec(model, threads))
        for batch in slices(batches, "text"):
            texts = filled(batch.column("text"))
            ids, offsets, same = codec.encode(texts)
            ids = ids.astype("<u4")
            decoded = codec.decode(ids, offsets)
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
            equal = [d == t for d, t in zip(decoded, texts.cast(pa.binary()).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(crc, pa.int64()),
                 pa.array([hashlib.sha256(d).hexdigest() for d in decoded]), pa.array(equal), pa.array(same)],
                ["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "round_trip", "parity"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(check, ROW_SCHEMA)
