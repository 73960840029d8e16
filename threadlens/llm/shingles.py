"""Sets of hashed word shingles, a slice of texts at a time.

Words are runs without ASCII white space, A-Z lower-cased. A text's set holds a 64-bit hash
of each distinct run of ``size`` words; a shorter text has its whole sequence as its one
shingle, a text without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from threadlens.llm.blocks import filled, offsets_of

SHINGLE = 5
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of all texts, and the word offsets of the texts."""
    from xxhash import xxh3_64_intdigest

    lists = pc.ascii_split_whitespace(pc.ascii_lower(filled(texts)))
    words = lists.flatten()
    coded = words.dictionary_encode()
    names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    hashes = np.fromiter((xxh3_64_intdigest(w) for w in names), np.uint64, len(names))[coded.indices.to_numpy()]
    real = pc.binary_length(words).to_numpy() > 0
    offsets = offsets_of(real)[lists.offsets.to_numpy()]
    return hashes[real], offsets


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, offsets = word_hashes(texts)
    n = len(hashes)
    runs = np.zeros(max(0, n - size + 1), np.uint64)
    for j in range(size):
        runs = runs * _STEP + hashes[j : j + len(runs)]
    runs = mix(runs)
    for a, b in zip(offsets[:-1], offsets[1:]):
        if b - a >= size:
            yield np.unique(runs[a : b - size + 1])
        elif b > a:
            one = np.array([b - a], np.uint64)
            for i in range(a, b):
                one = one * _STEP + hashes[i : i + 1]
            yield mix(one)
        else:
            yield np.zeros(0, np.uint64)


def fingerprint(shingles: np.ndarray) -> int:
    """A signed 64-bit number that stands for the set."""
    total = np.array([len(shingles), np.add.reduce(mix(shingles + _STEP), dtype=np.uint64)], np.uint64)
    return int(mix(mix(total[:1]) + total[1:]).astype(np.int64)[0])
