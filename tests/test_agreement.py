"""Column functions against plain Python on random texts rich in awkward characters."""

import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from threadlens import config
from threadlens.functions import dates, patterns, text

ALPHABET = "iıİIsſSgğĞGcçÇuüÜoöÖşŞkKaAhHeEnNrRyYmMlLvVtT _-'.,;~:0123456789\t\n\u00a0\u2003\u212a½x\u0307😀"


def _texts(n, seed, words=()):
    rng = random.Random(seed)
    out = ["", " ", "\n"]
    for _ in range(n):
        parts = ["".join(rng.choices(ALPHABET, k=rng.randrange(0, 8))) for _ in range(rng.randrange(1, 6))]
        if words and rng.random() < 0.6:
            word = rng.choice(words)
            shown = "".join(rng.choice([c, c.upper(), c.lower()]) for c in word)
            parts.insert(rng.randrange(len(parts) + 1), shown)
        out.append(rng.choice(["", " ", "_"]).join(parts))
    return out


def test_tokens_strip_and_words(column):
    samples = _texts(1500, 1)
    assert column(samples, text.token_count) == [len(re.findall(r"\w+", s)) for s in samples]
    assert column(samples, text.strip_blank) == [s.strip() for s in samples]
    assert column(samples, text.char_length) == [len(s) for s in samples]
    letters = f"[^{text.TITLE_LETTERS}\\s]"
    want = [re.sub(letters, " ", s.lower()).split() for s in samples]
    assert column(samples, text.title_words) == want
    assert column(samples, lambda c: text.bigrams(text.title_words(c))) == [
        [" ".join(p) for p in zip(w, w[1:])] for w in want
    ]


@pytest.mark.parametrize("raw, slug", [
    ("", "untitled"), ("  ", "untitled"), ("a b", "a_b"), (" a--b! ", "a_b"), ("x" * 200, "x" * 180), ("çok güzel", "çok_güzel"),
    ("...", "untitled"), ("1/2", "1_2"),
])
def test_slugs(column, raw, slug):
    assert column([raw], text.slug) == [slug]


@pytest.mark.parametrize("name", [*config.SUBGROUP_STEMS, "gender", "crime"])
def test_lexicons_ignore_case_like_python(column, name):
    stems = config.FRAMES.get(name) or [config.SUBGROUP_STEMS[name]]
    samples = _texts(1500, name, stems)
    rule = re.compile("|".join(stems), re.IGNORECASE)
    got = column(samples, lambda c: patterns.matches(c, stems))
    wrong = [s for s, g in zip(samples, got) if g != bool(rule.search(s))]
    assert not wrong and any(got) and not all(got)


def test_mentions_like_python(column):
    samples = _texts(2000, 5, ["suri", "suriyeli"])
    rules = [(n, re.compile(r"\b" + s, re.IGNORECASE)) for n, s in config.MENTION_STEMS]
    want = [next((n for n, r in rules if r.search(s)), None) for s in samples]
    got = column(samples, lambda c: patterns.first_match(c, config.MENTION_STEMS, at_word_start=True))
    assert [(s, g, w) for s, g, w in zip(samples, got, want) if g != w] == []


# raw text; the stamp found anywhere in it; the value under one of the three layouts for the whole text
DATES = [
    ("05.03.2023 04:10", "2023-03-05T04:10:00", "2023-03-05T04:10:00"),
    ("18.06.2016 15:07 ~ 15:09", "2016-06-18T15:07:00", None),
    ("18.06.2016 15:07 ~ 19.06.2016 08:00", "2016-06-18T15:07:00", None),
    ("18.06.2016", None, "2016-06-18T00:00:00"),
    ("2016-06-18", None, "2016-06-18T00:00:00"),
    ("31.02.2020 10:00", None, None),
    ("29.02.2020 10:00", "2020-02-29T10:00:00", "2020-02-29T10:00:00"),
    ("29.02.2019", None, None),
    ("05.03.2023 24:00", None, None),
    ("05.03.2023 23:59", "2023-03-05T23:59:00", "2023-03-05T23:59:00"),
    ("xx 01.01.2001  00:00 yy", "2001-01-01T00:00:00", None),
    ("00.01.2001 00:00", None, None),
    ("15:07", None, None),
    ("", None, None),
]


@pytest.mark.parametrize("raw, first, multi", DATES)
def test_dates(column, raw, first, multi):
    assert column([raw], lambda c: dates.iso_text(dates.first_stamp(c))) == [first]
    assert column([raw], lambda c: dates.iso_text(dates.multi_format(c))) == [multi]


def test_every_day_and_minute_reads_back(column):
    """Property: a stamp written by Python is read as the same moment, wherever it stands."""
    rng = random.Random(9)
    moments = [datetime(rng.randrange(1999, 2030), rng.randrange(1, 13), rng.randrange(1, 29), rng.randrange(24), rng.randrange(60))
               for _ in range(500)]
    samples = [m.strftime("%d.%m.%Y %H:%M") for m in moments]
    want = [m.isoformat() for m in moments]
    assert column(samples, lambda c: dates.iso_text(dates.multi_format(c))) == want
    assert column([f"<{s}> ~ 11:11" for s in samples], lambda c: dates.iso_text(dates.first_stamp(c))) == want


@pytest.mark.parametrize("raw, rest", [
    ("ab", "ab"), ("ab 1", "ab"), ("ab 12b", "ab"), ("ab 1,234b", "ab"), ("ab 9 12,345,678 ", "ab 9"), ("ab 1,23", "ab 1,"),
    ("ab1234", "ab1"), ("ab b", "ab b"), ("7", ""), ("", ""), ("ab 123\t", "ab"),
])
def test_trailing_counts(column, raw, rest):
    assert column([raw], text.strip_trailing_count) == [rest]


def test_snippet_length(column):
    assert column(["a"], lambda c: F.length(text.snippet(F.repeat(c, 151)))) == [153]
