"""Token files, packing, counts and pieces against the libraries on whole texts."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from threadlens.llm import dac, packing, queries, sentencepieces, token_counts, token_files
from threadlens.llm.codecs import Codec
from threadlens.session import new_path

BYTES, WORDS, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
CODECS = {p: Codec(p) for p in (BYTES, WORDS)}
PIECE_CODEC = sentencepieces.PieceCodec(PIECES, threads=1)
TEXTS = st.lists(st.text(
    st.one_of(st.sampled_from(list(" \n\t.,'!-_aAbBsStT19éÉßñ▁")), st.characters(exclude_categories=["Cs"])), max_size=30), max_size=6)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def pieces_of(rows):
    """Documents and sequences of packed rows, checked for gaps."""
    docs, sequences = {}, {}
    for r in rows:
        docs.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    return docs, sequences


@pytest.mark.parametrize("path", [BYTES, WORDS])
@settings(max_examples=150, deadline=None)
@given(texts=TEXTS)
def test_codec_is_the_library(path, texts):
    codec = CODECS[path]
    assert codec.family != "whole"
    texts = [*texts, "x <|endoftext|>y", "don't  stop\n\n'S"]
    ids, offsets = codec.encode(pa.array(texts, pa.string()))
    want = [e.ids for e in codec.library.encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == want


@settings(max_examples=150, deadline=None)
@given(texts=TEXTS)
def test_pieces_are_the_library(texts):
    texts = [t.replace("\x00", "") for t in texts] + ["", "a  b", " x \n"]
    ids, offsets, parity = PIECE_CODEC.encode(pa.array(texts, pa.string()))
    want = PIECE_CODEC.reference.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == want
    assert parity.all()
    decoded = [t.decode("utf-8", "replace") for t in PIECE_CODEC.decode(ids, offsets)]
    assert decoded == PIECE_CODEC.reference.decode(want) == PIECE_CODEC.library.decode_batch(want)
    assert decoded == [t.replace("▁", " ") for t in texts]


def _field(number, kind, data):
    head = bytes([number << 3 | kind])
    return head + (bytes([len(data)]) + data if kind == 2 else data)


def test_unigram_model_file():
    import struct

    pieces = [("<unk>", 0.0, 2), ("▁", -2.0, 1), ("▁ab", -3.0, 1), ("a", -4.0, 1), ("b", -4.0, 1), ("ab", -3.5, 1), ("c", -5.0, 1)]
    data = b"".join(
        _field(1, 2, _field(1, 2, p.encode()) + _field(2, 5, struct.pack("<f", s)) + _field(3, 0, bytes([k])))
        for p, s, k in pieces)
    data += _field(2, 2, _field(3, 0, b"\x01")) + _field(3, 2, _field(3, 0, b"\x01") + _field(4, 0, b"\x01"))
    model = sentencepieces.parse(data)
    assert (model.model_type, model.trim_spaces, model.unk_id) == (sentencepieces.UNIGRAM, True, 0)
    library, reference = sentencepieces.build(model), sentencepiece.SentencePieceProcessor(model_proto=data)
    for text in ["ab", "  ab   abc ", "cab", "b a", "abab"]:
        assert library.encode(text, add_special_tokens=False).ids == reference.encode(text), text
    with pytest.raises(ValueError):
        sentencepieces.parse(_field(2, 2, _field(3, 0, b"\x03")))


@settings(max_examples=100, deadline=None)
@given(ids=st.lists(st.one_of(st.integers(0, 20), st.integers(0, 2**32 - 1)), max_size=300), data=st.data())
def test_dac_round_trip(ids, data):
    segment = dac.Segment(dac.encode(np.array(ids, np.uint32)))
    assert len(segment) == len(ids) and segment.read(0, len(ids)).tolist() == ids
    a = data.draw(st.integers(0, len(ids)))
    b = data.draw(st.integers(a, len(ids)))
    assert segment.read(a, b).tolist() == ids[a:b]
    assert [segment[i] for i in range(a, b)] == ids[a:b]


def test_dac_rank_over_blocks():
    ids = np.arange(70_000, dtype=np.uint32) * 7 % 50_257
    segment = dac.Segment(dac.encode(ids))
    for i in (0, 1, 511, 512, 513, 4095, 4096, 65_535, 69_999):
        assert segment[i] == ids[i]
    assert (segment.read(513, 60_001) == ids[513:60_001]).all()
    with pytest.raises(IndexError):
        segment[70_000]


def test_token_files(spark, sf):
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    library, start = Tokenizer.from_file(BYTES), 0
    got = {r.doc_id: r for r in queries.PLANS["op5_token_files"](spark, sf).collect()}
    for doc, text in docs:
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        assert (got[doc].start, got[doc].n_tokens, got[doc].ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)
    assert len(got) == len(docs)


def test_token_files_odd(spark, clashing, no_docs):
    path = new_path(spark, "tokens")
    token_files.write_tokens(clashing, path, BYTES, 2, segment_tokens=1000)
    rows = token_files.token_index(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, *range(1, 13), 12]
    assert sum(r.n_tokens for r in rows[:-1]) == rows[-1].start
    some = spark.createDataFrame([(9,), (4,), (99,)], "doc_id long")
    got = {r.doc_id: r.ids for r in token_files.read_tokens(spark, path, some).collect()}
    library = Tokenizer.from_file(BYTES)
    texts = {r.doc_id: r.text for r in clashing.collect()}
    assert got == {d: [*library.encode(texts[d], add_special_tokens=False).ids, 2] for d in (9, 4)}
    empty = new_path(spark, "tokens")
    token_files.write_tokens(no_docs, empty, BYTES, 2)
    assert token_files.token_index(spark, empty).count() == 0


def plain_differencing(sizes, k):
    """Multiway differencing with whole lists of windows."""
    heap = [(-int(s), t, [(int(s), [i])] + [(0, [])] * (k - 1))
            for t, (i, s) in enumerate(sorted(enumerate(sizes), key=lambda x: -x[1]))]
    turn = len(heap)
    while len(heap) > 1:
        (_, _, a), (_, _, b) = heap.pop(heap.index(min(heap))), heap.pop(heap.index(min(heap)))
        met = sorted(((x + y, m + n) for (x, m), (y, n) in zip(a, reversed(b))), key=lambda w: -w[0])
        met = [(x - met[-1][0], m) for x, m in met]
        turn += 1
        heap.append((-met[0][0], turn, met))
    return [sum(int(sizes[i]) for i in members) for _, members in heap[0][2]]


@pytest.mark.parametrize("k", [1, 2, 5, 40])
@pytest.mark.parametrize("seed", [3, 4])
def test_difference_is_plain_differencing(k, seed):
    sizes = np.random.default_rng(seed).integers(1, 1000, 200)
    window = packing.difference(sizes, k)
    loads = np.bincount(window, sizes, minlength=k)
    assert len(window) == 200 and sorted(loads) == sorted(plain_differencing(sizes, k))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60))
def test_pack_holds_capacity(sizes):
    window = packing.pack(np.array(sizes, np.int64), 100)
    assert len(window) == len(sizes) and (not sizes or np.bincount(window, sizes).max() <= 100)


def test_pack_raises_the_window_count():
    assert len(set(packing.pack(np.array([60] * 5), 100).tolist())) == 5  # three windows would hold the sum
    with pytest.raises(ValueError):
        packing.pack(np.array([101]), 100)


def test_packing(spark, sf):
    library = Tokenizer.from_file(WORDS)
    docs, sequences = pieces_of(queries.PLANS["op7_packing"](spark, sf).collect())
    source = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {d for d, _ in docs} == set(source)
    for (doc, n), parts in docs.items():
        ids, at = [*library.encode(source[doc], add_special_tokens=False).ids, 2], 0
        assert n == len(ids)
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == crc(ids[at : at + r.length])
            at += r.length
        assert at == n
    filled = sum(n for p in sequences.values() for _, n in p)
    assert filled / (len(sequences) * packing.CAPACITY) > 0.95


def test_packing_odd(clashing, no_docs):
    rows = packing.pack_documents(clashing, WORDS, 2).collect()
    docs, _ = pieces_of(rows)
    library = Tokenizer.from_file(WORDS)
    want = sum(len(library.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in clashing.collect())
    assert sum(r.length for r in rows) == want and docs[(1, 1)] and docs[(2, 1)]
    assert packing.pack_documents(no_docs, WORDS, 2).count() == 0


@pytest.mark.parametrize("path", [WORDS, BYTES, PIECES])
def test_token_counts(clashing, no_docs, path):
    if path == PIECES:
        count = lambda t: len(PIECE_CODEC.reference.encode(t))
    else:
        count = lambda t: len(CODECS[path].library.encode(t, add_special_tokens=False).ids)
    got = token_counts.count_tokens(clashing, path, 5).collect()
    want = [(r.doc_id, len((r.text or "").encode()), count(r.text or "")) for r in clashing.collect()]
    order = lambda rows: sorted(rows, key=str)
    assert order((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == order(want)
    assert all(r.over_limit == (r.n_tokens > 5) for r in got)
    assert token_counts.count_tokens(no_docs, path, 5).count() == 0


def test_token_counts_whole_table(spark, sf):
    library = Tokenizer.from_file(WORDS)
    got = {r.doc_id: r.n_tokens for r in queries.PLANS["op8_token_counts"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert got == {r.doc_id: len(library.encode(r.text or "", add_special_tokens=False).ids) for r in docs}


def test_hot_pre_tokens_are_dealt_by_block(spark):
    docs = spark.createDataFrame([(i, "the " * (i % 300) + f"w{i}") for i in range(400)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, WORDS, 9).collect()}
    library = Tokenizer.from_file(WORDS)
    assert got == {r.doc_id: len(library.encode(r.text, add_special_tokens=False).ids) for r in docs.collect()}


def test_sentencepiece_query(spark, sf):
    source = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.PLANS["op4_sentencepiece"](spark, sf).collect()
    assert len(rows) == len(source) and all(r.parity and r.round_trip for r in rows)
    for r in rows:
        ids = PIECE_CODEC.reference.encode(source[r.doc_id])
        assert (r.n_tokens, r.ids_crc32) == (len(ids), crc(ids))


def test_sentencepiece_odd(spark, clashing, no_docs):
    rows = sentencepieces.encode_documents(clashing, PIECES).collect()
    texts = [r.text or "" for r in clashing.collect()]
    assert sorted(map(tuple, (r.ids for r in rows))) == sorted(map(tuple, PIECE_CODEC.reference.encode(texts)))
    ids = spark.createDataFrame([(1, [], "x"), (2, None, "y"), (3, PIECE_CODEC.reference.encode("é x"), "z")],
                                "doc_id long, ids array<int>, text string")
    got = {r.doc_id: r.text for r in sentencepieces.decode_documents(ids, PIECES).collect()}
    assert got == {1: "", 2: None, 3: "é x"}
    assert sentencepieces.check_documents(no_docs, PIECES).count() == 0
    assert sentencepieces.check_documents(clashing, PIECES).filter(F.col("n_tokens") == 0).count() == 2


def test_token_counts_behind_any_plan(spark, sf):
    """Counts do not depend on rows being read twice in one order."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    library = Tokenizer.from_file(WORDS)
    want = sorted((r.doc_id, len(r.text.encode()), len(library.encode(r.text, add_special_tokens=False).ids)) for r in docs.collect())
    keys = docs.select("doc_id").filter("doc_id % 2 = 0")
    odd = docs.join(keys, "doc_id", "left_anti")
    tables = {
        "groupBy": docs.groupBy("doc_id").agg(F.first("text").alias("text")), "repartition": docs.repartition(7),
        "sort": docs.orderBy(F.xxhash64("text")), "join": docs.join(keys, "doc_id").unionByName(odd),
    }
    for name, table in tables.items():
        rows = token_counts.count_tokens(table, WORDS, limit=2048).collect()
        assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in rows) == want, name
        assert all(r.over_limit == (r.n_tokens > 2048) for r in rows)


def test_full_pieces_take_no_group(spark):
    rows = [(i, i, s * 4096, 4096, 0, 40960) for i in range(50) for s in range(10)] + [(i, i, 0, 700, 0, 700) for i in range(50, 60)]
    pieces = spark.createDataFrame(rows, packing.PIECE_SCHEMA)
    placed = packing.pack_pieces(pieces, group_pieces=4)
    got = placed.collect()
    docs, sequences = pieces_of(got)
    assert len(got) == len(rows) and len(docs) == 60
    full = [r for r in got if r.length == 4096]
    assert len({r.sequence_id for r in full}) == 500 and all(r.offset == 0 for r in full)
