"""String functions: trimming, tokens, title words, slugs, snippets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters, numbers and underscore of any script.
WORD_CLASS = r"[\p{L}\p{N}_]"
WORD = WORD_CLASS + "+"
# Position that no word character precedes, for any script.
WORD_START = rf"(?<!{WORD_CLASS})"
# The characters that count as white space around a text.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
    "\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Letters kept in title words and in slugs.
TITLE_LETTERS = "a-zçğıöşüİĞÜŞÖÇ"
SLUG_LETTERS = "a-zA-Z0-9ğüşöçıİĞÜŞÖÇ"
SLUG_LENGTH = 180
SNIPPET_LENGTH = 150


def strip_blank(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def blank_to_null(text: Column) -> Column:
    stripped = strip_blank(text)
    return F.when(F.length(stripped) > 0, stripped)


# Letters that match an ``i`` or ``s`` of any case and that lower-casing alone leaves apart.
_CASE_PAIRS = (("İ", "i"), ("ı", "i"), ("ſ", "s"))


def fold_case(text: Column) -> Column:
    """Key under which texts that differ only in case are equal, dotted and dotless i included."""
    for letter, plain in _CASE_PAIRS:
        text = F.replace(text, F.lit(letter), F.lit(plain))
    return F.lower(text)


def fold_word(word: str) -> str:
    """``fold_case`` of a driver-side string."""
    for letter, plain in _CASE_PAIRS:
        word = word.replace(letter, plain)
    return word.lower()


def lower_key(text: Column) -> Column:
    return F.lower(text)


def char_length(text: Column) -> Column:
    return F.length(text)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def token_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def title_words(title: Column) -> Column:
    """Lower-cased words made of title letters only."""
    return F.regexp_extract_all(F.lower(F.coalesce(title, F.lit(""))), F.lit(f"[{TITLE_LETTERS}]+"), F.lit(0))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def bigrams(words: Column) -> Column:
    """Neighbouring pairs of one word array; empty for fewer than two words."""

    def pairs(w: Column) -> Column:
        n = F.greatest(F.size(w) - 1, F.lit(0))
        return F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))

    return bind(words, pairs)


def slug(title: Column) -> Column:
    joined = F.btrim(F.regexp_replace(title, f"[^{SLUG_LETTERS}]+", "_"), F.lit("_"))
    return F.left(F.when(joined == "", F.lit("untitled")).otherwise(joined), F.lit(SLUG_LENGTH))


def strip_trailing_count(line: Column) -> Column:
    """Drop a result count such as ``1,234b`` from the end of a line."""
    bare = F.rtrim(line, F.lit(BLANKS))
    return F.regexp_replace(bare, r"\s*\p{Nd}{1,3}(?:,\p{Nd}{3})*b?$", "")


def strip_pair_suffix(stem: Column) -> Column:
    """Key that an annotation file shares with its data file."""
    return F.regexp_replace(stem, "_(?:annotations|annotated)$", "")


def snippet(content: Column, topics: Column | None = None, length: int = SNIPPET_LENGTH) -> Column:
    cut = F.when(F.length(content) > length, F.concat(F.left(content, F.lit(length)), F.lit("..."))).otherwise(content)
    if topics is None:
        return cut
    listed = F.array_join(topics, ", ")
    return F.when(F.coalesce(listed, F.lit("")) != "", F.concat(cut, F.lit(" ("), listed, F.lit(")"))).otherwise(cut)


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)
