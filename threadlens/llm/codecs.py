"""Token ids of whole texts, with the library called once per distinct word of a slice.

A tokenizers file of one of two families is cut at single spaces and line ends, where its
pre-tokenizer always cuts too: byte-level files whose words carry their leading space, and
files that drop white space. Any other file, and any text whose white space is irregular
for a byte-level file, is encoded by the library as a whole. Ids are always the library's.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from threadlens.llm.blocks import Recent, offsets_of, ragged_positions

PIECES_KEPT = 150_000
# Words of these characters alone take the short way; case and composition are settled for them.
LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
MARKS = re.escape(".,!?;:)")
FIRST = "\x01"  # marks the first word of a text, which has no space before it


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    shifted = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(shifted)) for b in range(256)]


def byte_table() -> dict[int, str]:
    """For str.translate: the characters of the short way as byte-level text."""
    names = byte_alphabet()
    points = [9, 10, *range(32, 127), *range(0xC0, 0x100)]
    return {p: "".join(names[b] for b in chr(p).encode()) for p in points}


class Codec:
    """Encodes Arrow string arrays; ``encode`` gives flat ids and the offsets of the texts."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        with open(path, encoding="utf-8") as file:
            self.spec = json.load(file)
        self.model = self.library.model
        self.table = byte_table()
        self.added = [t["content"] for t in self.spec["added_tokens"]]
        self.pieces, self.last = Recent(PIECES_KEPT), {}
        self.family = self._family()
        guard = "|".join(map(re.escape, self.added)) or r"(?!)"
        self.special = re.compile(guard)
        self.simple = re.compile(rf"([{LATIN}]+)([{MARKS}])?")
        if self.family == "bytes":
            self.plain = re.compile(rf"[ \n\t!-~{LATIN}]+")
            self.cut = re.compile(
                rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN}]+| ?[0-9]+| ?[^\s{LATIN}0-9]+|\s+(?!\S)|\s+"
            )
        elif self.family == "dropped":
            self.plain = re.compile(rf"[!-~{LATIN}]+")
            self.cut = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LATIN}]+|[0-9]|[^\s{LATIN}0-9]+")

    def _family(self) -> str:
        spec = self.spec
        pre, norm, post = spec["pre_tokenizer"], spec["normalizer"], spec["post_processor"]
        loose = any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or re.search(r"\s", t["content"])
                    for t in spec["added_tokens"])
        if loose or spec["model"]["type"] != "BPE":
            return "whole"
        if norm is None and post is None and pre == {
            "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": pre.get("trim_offsets"), "use_regex": True,
        }:
            return "bytes"
        drops = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        kinds = [n["type"] for n in (norm or {}).get("normalizers", [])]
        parts = (pre or {}).get("pretokenizers", [])
        if kinds == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in parts] == ["Split", "ByteLevel"]:
            if parts[0]["pattern"] == {"Regex": drops} and parts[0]["invert"] and not parts[1]["use_regex"]:
                return "dropped"
        return "whole"

    # Words of a slice

    def split(self, texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
        """Word numbers of all texts, the distinct words, and the word offsets of the texts."""
        if self.family == "bytes":
            marked = pc.replace_substring(texts, "\n", " \n")
            marked = pc.binary_join_element_wise(pa.scalar(FIRST), marked, pa.scalar(""))
        else:
            marked = pc.replace_substring(texts, "\n", " ")
        lists = pc.split_pattern(marked, " ")
        coded = lists.flatten().dictionary_encode()
        return coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist(), lists.offsets.to_numpy().astype(np.int64)

    def _text(self, word: str) -> str | None:
        """The text that a word stands for; None if it makes its text irregular."""
        if self.family != "bytes":
            return word
        head = word[:1]
        body = word[1:] if head in (FIRST, "\n") else word
        if not body or body[0].isspace() or body[-1].isspace() or FIRST in body:
            return None
        return body if head == FIRST else word if head == "\n" else " " + word

    def _whole(self, texts: list[str]) -> list[bytes]:
        got = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, np.uint32).tobytes() for e in got]

    def cuts(self, words: list[str]) -> list[list[str] | tuple[str, ...] | str | None]:
        """Each word's pre-tokens; the text itself where only the library can cut it; None if irregular.

        Letters alone, or letters and one mark, which most words are, need no further pattern.
        """
        out: list = []
        add, simple, plain, special, cut = (
            out.append, self.simple.fullmatch, self.plain.fullmatch, self.special.search, self.cut.findall)
        spaced, lower = self.family == "bytes", self.family == "dropped"
        for word in words:
            if word.isascii() and word.isalpha():
                add((" " + word,) if spaced else (word.lower(),))
                continue
            found = simple(word)
            if found is not None:
                if found.lastindex == 1:
                    add((" " + word,) if spaced else (word.lower(),))
                else:
                    stem, mark = found.groups()
                    add((" " + stem, mark) if spaced else (stem.lower(), mark))
                continue
            text = self._text(word)
            if not text:
                add(None if text is None else ())
            elif plain(text) and not special(text):
                add(cut(text.lower() if lower else text))
            else:
                add(text)
        return out

    def word_ids(self, words: list[str]) -> list[bytes | None]:
        """Ids of distinct words as bytes; None for words that make their text irregular."""
        last, pieces = self.last, self.pieces
        pieces.trim()
        out = list(map(last.get, words))
        fresh = [i for i, ids in enumerate(out) if ids is None]
        known, again, piece = pieces.new.get, pieces.again, self._piece
        hard, places = [], []
        for i, found in zip(fresh, self.cuts([words[i] for i in fresh]), strict=True):
            if found is None:
                continue
            if type(found) is str:
                hard.append(found)
                places.append(i)
            elif len(found) == 1:
                p = found[0]
                out[i] = known(p) or again(p) or piece(p)
            else:
                out[i] = b"".join([known(p) or again(p) or piece(p) for p in found])
        for i, ids in zip(places, self._whole(hard), strict=True):
            out[i] = ids
        self.last = dict(zip(words, out))  # those of the slice before: most frequent words come again
        return out

    def rest(self) -> None:
        """Give up what only helps from slice to slice."""
        self.last = {}

    def mapped(self, piece: str) -> str:
        """A pre-token in the alphabet of the model."""
        if piece.isascii() and piece[1:].isalpha():
            return "\u0120" + piece[1:] if piece[0] == " " else piece
        return piece.translate(self.table)

    def _piece(self, piece: str) -> bytes:
        ids = array("I", [t.id for t in self.model.tokenize(self.mapped(piece))]).tobytes()
        self.pieces.new[piece] = ids
        return ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text starts (one more at the end)."""
        if self.family == "whole":
            blobs = self._whole(texts.to_pylist())
            return np.frombuffer(b"".join(blobs), np.uint32), offsets_of(np.array([len(b) // 4 for b in blobs], np.int64))
        which, words, bounds = self.split(texts)
        blobs = self.word_ids(words)
        odd = np.array([b is None for b in blobs], bool)
        blobs = [b or b"" for b in blobs]
        sizes = np.array([len(b) // 4 for b in blobs], np.int64)
        starts = np.cumsum(sizes) - sizes
        ids = np.frombuffer(b"".join(blobs), np.uint32)[ragged_positions(starts[which], sizes[which])]
        ends = offsets_of(sizes[which])
        offsets = ends[bounds]
        if odd.any():
            bad = np.flatnonzero(np.diff(offsets_of(odd[which])[bounds]) > 0)
            parts = [ids[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
            whole = self._whole(texts.take(pa.array(bad)).to_pylist())
            for i, blob in zip(bad, whole, strict=True):
                parts[i] = np.frombuffer(blob, np.uint32)
            ids, offsets = np.concatenate(parts), offsets_of(np.array([len(p) for p in parts], np.int64))
        return ids, offsets
