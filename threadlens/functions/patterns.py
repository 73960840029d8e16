"""Lexicon compiler: named stem lists -> boolean, first-match and multi-label columns.

``matches`` tests one list of stems. ``flag_columns`` answers for all lists of a lexicon at once: its
stems become one expression, a trie, that is searched once; what it finds tells all flags.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadlens.functions.text import WORD_START, fold_case, fold_word

_REGEX_SIGNS = frozenset("\\.^$*+?{}[]|()")


def _as_list(stems: str | Iterable[str]) -> list[str]:
    parts = [stems] if isinstance(stems, str) else list(stems)
    if not parts:
        raise ValueError("a lexicon entry needs at least one pattern")
    return parts


def _is_plain(stem: str) -> bool:
    return bool(stem) and not _REGEX_SIGNS.intersection(stem)


def alternation(stems: str | Iterable[str], at_word_start: bool = False) -> str:
    """One case-insensitive regex that matches any of the given patterns."""
    return "(?iu)" + (WORD_START if at_word_start else "") + "(?:" + "|".join(_as_list(stems)) + ")"


def matches(
    text: Column, stems: str | Iterable[str], at_word_start: bool = False, folded: bool = False
) -> Column:
    """True where the text holds a pattern, ignoring case; false, not null, on null text.

    Plain stems are searched as substrings of the folded text, which all flags of one
    projection share; stems with regex signs go into one alternation. A word-start
    condition is only tested on texts that hold the stem at all. ``folded`` tells that
    ``text`` went through ``fold_case`` already.
    """
    parts = _as_list(stems)
    plain = [fold_word(p) for p in parts if _is_plain(p)]
    regexes = [p for p in parts if not _is_plain(p)]
    key = text if folded else fold_case(text)
    tests = [key.contains(p) for p in plain]
    if plain and at_word_start:
        tests = [reduce(or_, tests) & key.rlike(WORD_START + "(?:" + "|".join(plain) + ")")]
    if regexes:
        tests.append(text.rlike(alternation(regexes, at_word_start)))
    return F.coalesce(reduce(or_, tests), F.lit(False))


def match_sql(column: str, stems: str | Iterable[str], at_word_start: bool = False) -> str:
    """``matches`` as SQL text, by regex alone."""
    return f"coalesce(rlike({column}, r'{alternation(stems, at_word_start)}'), false)"


def first_match(
    text: Column,
    choices: Iterable[tuple[str, str | Iterable[str]]],
    at_word_start: bool = False,
    folded: bool = False,
) -> Column:
    """Name of the first choice that matches, else null; put longer stems before their prefixes."""
    chain = None
    for name, stems in choices:
        test = matches(text, stems, at_word_start, folded)
        chain = F.when(test, F.lit(name)) if chain is None else chain.when(test, F.lit(name))
    if chain is None:
        raise ValueError("no choices")
    return chain


def trie_pattern(words: Iterable[str]) -> str:
    """One expression for all ``words`` that takes the longest of them at a place.

    Words share their beginnings, so a place is left at the first letter that continues none of them:
    the time for a text hardly depends on how many words there are.
    """
    root: dict = {}
    for word in words:
        node = root
        for letter in word:
            node = node.setdefault(letter, {})
        node[""] = {}
    # from the leaves up, without recursion: a stem may be long
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [child for letter, child in node.items() if letter]
    done: dict[int, str] = {}
    for node in reversed(order):
        ends = "" in node
        leaves = [x for x in sorted(node) if x and set(node[x]) <= {""}]
        parts = [re.escape(x) + done[id(node[x])] for x in sorted(node) if x and x not in leaves]
        if leaves:
            parts.append(re.escape(leaves[0]) if len(leaves) == 1 else "[" + "".join(map(re.escape, leaves)) + "]")
        joined = parts[0] if len(parts) == 1 and not ends else "(?:" + "|".join(parts) + ")" if parts else ""
        done[id(node)] = joined + "?" if parts and ends else joined
    return done[id(root)]


def stem_hits(folded: Column, stems: Iterable[str], at_word_start: bool = False) -> Column:
    """The distinct plain stems in a folded text: at each place the longest one, also where stems overlap.

    Most places are left after a look at two letters.
    """
    words = sorted({fold_word(s) for s in stems})
    start = WORD_START if at_word_start else ""
    depth = min(2, *map(len, words))
    guard = "".join("[" + "".join(re.escape(x) for x in sorted({w[i] for w in words})) + "]" for i in range(depth))
    pattern = f"{start}(?={guard})(?=({trie_pattern(words)}))"
    return F.array_distinct(F.regexp_extract_all(F.coalesce(folded, F.lit("")), F.lit(pattern), F.lit(1)))


def flag_columns(
    hits: Column, folded: Column, lexicon: Mapping[str, str | Iterable[str]], at_word_start: bool = False
) -> dict[str, Column]:
    """A boolean for each name of the lexicon, given the ``stem_hits`` of all its plain stems.

    A hit also stands for the stems it begins with. Stems with regex signs are searched one list at a time.
    """
    parts = {name: _as_list(stems) for name, stems in lexicon.items()}
    words = sorted({fold_word(p) for stems in parts.values() for p in stems if _is_plain(p)})
    flags = {}
    for name, stems in parts.items():
        own = tuple(fold_word(p) for p in stems if _is_plain(p))
        regexes = [p for p in stems if not _is_plain(p)]
        tests = [F.arrays_overlap(hits, F.array(*[F.lit(w) for w in words if w.startswith(own)]))] if own else []
        if regexes:
            tests.append(F.coalesce(folded.rlike(alternation(regexes, at_word_start)), F.lit(False)))
        flags[name] = reduce(or_, tests)
    return flags


def plain_stems(lexicon: Mapping[str, str | Iterable[str]]) -> list[str]:
    """All stems of a lexicon without regex signs."""
    return [p for stems in lexicon.values() for p in _as_list(stems) if _is_plain(p)]


def all_matches(text: Column, lexicon: Mapping[str, str | Iterable[str]], folded: bool = False) -> Column:
    """Array of every lexicon name that matches, in lexicon order."""
    found = [F.when(matches(text, stems, folded=folded), F.lit(name)) for name, stems in lexicon.items()]
    return F.array_compact(F.array(*found))
