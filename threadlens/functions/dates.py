"""Raw date stamps -> wall-clock ``timestamp_ntz``; anything invalid is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The whole-string layouts.
DAY_TIME = r"^(\d{1,2})\.(\d{1,2})\.(\d{4})\s+(\d{1,2}):(\d{1,2})\z"
DAY = r"^(\d{1,2})\.(\d{1,2})\.(\d{4})\z"
ISO_DAY = r"^\d{4}-\d{1,2}-\d{1,2}\z"
EXACT = r"^\d{2}\.\d{2}\.\d{4} \d{2}:\d{2}\z"

# The stamp anywhere in a text, and the whole-string layouts, to year first. Year 0 is
# left as it is, which no cast accepts.
_ANYWHERE = r"(?s)^.*?(\d{2})\.(\d{2})\.(?!0000)(\d{4})\s+(\d{2}:\d{2}).*$"
_WHOLE = r"^(\d+)\.(\d+)\.(?!0000)(\d+)(?:\s+(\d+:\d+))?\z"
_YEAR_FIRST = "$3-$2-$1 $4"


def first_stamp(raw: Column) -> Column:
    """First ``dd.MM.yyyy HH:mm`` anywhere in the text: the creation time, edited or not.

    One regex finds and turns the stamp; a text that it leaves unchanged has none.
    """
    return F.nullif(F.regexp_replace(raw, _ANYWHERE, _YEAR_FIRST), raw).try_cast("timestamp_ntz")


def _wall_clock(stamp: Column) -> Column:
    return F.regexp_replace(stamp, _WHOLE, _YEAR_FIRST).try_cast("timestamp_ntz")


def multi_format(raw: Column) -> Column:
    """Whole-string parse; the first of three layouts that fits."""
    known = raw.rlike(f"{DAY_TIME}|{DAY}|{ISO_DAY}") & ~raw.startswith("0000")
    return F.when(known, _wall_clock(raw))


def strict_stamp(raw: Column) -> Column:
    """Whole-string ``dd.MM.yyyy HH:mm`` only."""
    return F.when(raw.rlike(EXACT), _wall_clock(raw))


def first_stamp_sql(raw: str) -> str:
    """``first_stamp`` as SQL text."""
    turned = f"regexp_replace({raw}, r'{_ANYWHERE}', '{_YEAR_FIRST}')"
    return f"try_cast(nullif({turned}, {raw}) AS TIMESTAMP_NTZ)"


PARSERS = {"first": first_stamp, "multi": multi_format, "strict": strict_stamp}


def parse_stamp(raw: Column, mode: str = "first") -> Column:
    return PARSERS[mode](raw)


def iso_text(ts: Column) -> Column:
    """ISO text of a wall-clock time; no time zone takes part."""
    return F.replace(ts.cast("timestamp_ntz").cast("string"), F.lit(" "), F.lit("T"))
