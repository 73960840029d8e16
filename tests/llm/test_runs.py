"""Runs of repeated words against all periods tried in turn."""

import hashlib
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from threadlens.llm import periodic, queries


def plain_runs(words, min_words=24, min_exponent=3):
    """``(start, length, period)``: the smallest period first, so a stretch keeps that."""
    names, found = {}, {}
    codes = np.array([names.setdefault(w, len(names)) for w in words], np.int64)
    for q in range(1, len(codes) // min_exponent + 1):
        same = np.diff(np.concatenate([[0], (codes[:-q] == codes[q:]).astype(np.int8), [0]]))
        for a, b in zip(np.flatnonzero(same == 1).tolist(), np.flatnonzero(same == -1).tolist()):
            if b - a + q >= max(min_words, min_exponent * q):
                found.setdefault((a, b - a + q), q)
    return sorted((a, n, q) for (a, n), q in found.items())


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def collapsed(words, runs):
    drop = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in drop)


def planted(doc_id, words):
    """One text in ten gets a tail that repeats a sequence."""
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query(spark, sf):
    want = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        words = planted(r.doc_id, split(r.text))
        runs = plain_runs(words)
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=(None,) * 3)
        want.append((r.doc_id, len(runs), *best, runs and 1000 * best[1] // best[2] or None,
                     sha("".join(f"{a},{n},{q}\n" for a, n, q in runs)), sha(collapsed(words, runs))))
    got = queries.PLANS["op12_periodic_runs"](spark, sf)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert sum(w[1] for w in want) > 5


def test_odd_rows(spark, odd_docs, clashing, no_docs):
    want = sorted(((r.doc_id, len(split(r.text)), plain_runs(split(r.text)),
                    collapsed(split(r.text), plain_runs(split(r.text)))) for r in odd_docs.collect()), key=str)
    for docs in (odd_docs, clashing, odd_docs.repartition(3)):
        rows = periodic.collapse_runs(docs).collect()
        assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in rows), key=str) == want
    assert periodic.collapse_runs(no_docs).count() == 0


def runs_in(texts, min_words, min_exponent):
    """The steps of a task on word lists."""
    codes = [periodic.np.array([ord(c) for c in t], periodic.np.int64) for t in texts]
    flat = np.concatenate([*codes, np.zeros(0, np.int64)])
    bounds = periodic.offsets_of(np.array([len(t) for t in texts], np.int64))
    repeat = -(-min_words * (min_exponent - 1) // min_exponent)
    order, able = periodic.sorted_suffixes(flat, bounds, repeat)
    for a, b in zip(bounds[:-1], bounds[1:]):
        assert sorted(order[a:b].tolist()) == list(range(a, b))  # texts keep apart
    return [periodic.runs_of(flat[a:b], order[a:b] - a, min_words, min_exponent) if able[k] else []
            for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:]))]


WORDS = st.lists(st.sampled_from("abc"), max_size=8).map("".join)
TEXTS = st.lists(st.tuples(st.text("abcd", max_size=30), WORDS, st.integers(0, 12), st.text("ab", max_size=40)).map(
    lambda t: t[0] + t[1] * t[2] + t[3]), max_size=4)


@settings(max_examples=400, deadline=None)
@given(texts=TEXTS, min_words=st.sampled_from([2, 4, 7, 24]), min_exponent=st.integers(2, 4))
def test_runs(texts, min_words, min_exponent):
    assert runs_in(texts, min_words, min_exponent) == [plain_runs(list(t), min_words, min_exponent) for t in texts]


def test_hard_texts():
    """One word only, Fibonacci words, de-facto aperiodic words, and long periods."""
    a, b = "a", "ab"
    while len(b) < 3000:
        a, b = b, b + a
    thue = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    texts = ["a" * 5000, b, thue, (b[:700] + "c") * 4, "ab" * 40 + "ba" * 40, ""]
    for min_words, exponent in ((24, 3), (2, 2)):
        assert runs_in(texts, min_words, exponent) == [plain_runs(list(t), min_words, exponent) for t in texts]
