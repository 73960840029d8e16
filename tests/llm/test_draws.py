"""Resampling towards a target against a plain version."""

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadlens.llm import queries, resampling
from threadlens.llm.ordering import placed


def plain_features(text, max_run=1):
    low = {c: c + 32 for c in range(65, 91)}
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(low))
    return [" ".join(words[i : i + n]) for n in range(1, max_run + 1) for i in range(len(words) - n + 1)], len(words)


def plain_draw(docs, target, percent=10, least=20, buckets=10_000, seed=2024, max_run=1):
    """``(id, n_features, weight, score, rank)`` in any order."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    cut = [plain_features(t, max_run) for _, t in docs]
    here, there = [0] * buckets, [0] * buckets
    for counts, texts in ((here, [f for f, _ in cut]), (there, [plain_features(t, max_run)[0] for t in target])):
        for f in [f for fs in texts for f in fs]:
            counts[bucket(f)] += 1
    s, t = sum(here), sum(there)
    gain = [math.floor(1000 * math.log((t_ + 1) * (s + buckets) / ((s_ + 1) * (t + buckets)))) for s_, t_ in zip(here, there)]
    rows = []
    for (name, _), (features, words) in zip(docs, cut):
        weight = sum(gain[bucket(f)] for f in features) // len(features) if features else 0
        h = int(hashlib.sha256(f"{seed}:{'' if name is None else name}".encode()).hexdigest()[:8], 16)
        noise = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((name, len(features), weight, weight + noise, words >= least))
    able = sorted([i for i, r in enumerate(rows) if r[4]], key=lambda i: (-rows[i][3], rows[i][0] is None, rows[i][0] or 0))
    rank = {i: n + 1 for n, i in enumerate(able[: percent * len(able) // 100])}
    return sorted(((*r[:4], rank.get(i)) for i, r in enumerate(rows)), key=str)


def drawn(docs, target, **options):
    return sorted((tuple(r) for r in resampling.resample(docs, target, **options).collect()), key=str)


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = queries.PLANS["op11_importance_resampling"](spark, sf)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_draw(docs, target)


@pytest.mark.parametrize("options", [{}, {"max_run": 3, "buckets": 97, "percent": 60, "least": 1}, {"percent": 100, "least": 0}])
def test_odd_rows(spark, odd_docs, clashing, no_docs, options):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    target = spark.createDataFrame([("shared line",), (None,), ("",)], "text string")
    named = {("least_words" if k == "least" else k): v for k, v in options.items()}
    want = plain_draw(rows, ["shared line", None, ""], **options)
    for docs in (odd_docs, clashing, odd_docs.repartition(3)):
        assert drawn(docs, target, **named) == want
    assert drawn(no_docs, target, **named) == []
    assert drawn(odd_docs, target.limit(0), **named) == plain_draw(rows, [], **options)


@pytest.mark.parametrize(("margin", "percent"), [(None, 10), (0.0, 30), (1e-6, 50), (2.0, 99), (None, 1)])
def test_bracket_never_decides(spark, margin, percent):
    """Many ties, a small sketch, and brackets that miss at first: the draw is the same."""
    rows = [(i % 1500, " ".join(f"w{(i * j) % 7}" for j in range(i % 9))) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    target = spark.createDataFrame([("w1 w2 w3 w3",)], "text string")
    got = drawn(docs, target, percent=percent, least_words=2, sketch_size=8, margin=margin)
    assert got == plain_draw(rows, ["w1 w2 w3 w3"], percent=percent, least=2)


@settings(max_examples=100, deadline=None)
@given(texts=st.lists(st.text(max_size=40), max_size=5), max_run=st.integers(1, 3))
def test_features(texts, max_run):
    texts = [*texts, "aé" * 60 + " " + "b" * 64 + " c" * 3, ""]
    numbers, offsets, words = resampling.features_of(pa.array(texts, pa.string()), max_run, 10_007)
    for text, a, b, n in zip(texts, offsets[:-1], offsets[1:], np.diff(words)):
        features, count = plain_features(text, max_run)
        assert sorted(numbers[a:b].tolist()) == sorted(zlib.crc32(f.encode()) % 10_007 for f in features)
        assert n == count


def test_places(spark):
    rows = [(i * 7919 % 1000 // 3, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "x long, row long").repartition(7)
    got = {r.row: r.place for r in placed(df, F.desc("x"), F.asc("row")).collect()}
    order = sorted(rows, key=lambda r: (-r[0], r[1]))
    assert [got[row] for _, row in order] == list(range(1000))
    assert placed(df.limit(0), F.asc("x")).count() == 0
