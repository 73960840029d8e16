"""Word tables as literals: a hash look-up inside an expression, without a join or a shuffle."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def word_table(rows: Mapping[str, Mapping[str, object]], fields: str) -> Callable[[Column], Column]:
    """A function from a word to its row (a struct of ``fields``), or null.

    Words lie in slots by their CRC-32, twice as many slots as words at least, so a look-up reads one
    slot and compares the one or two words there, however long the table is. The table is driver-side
    data of the size of a lexicon and goes with the plan.
    """
    slots = 1
    while slots < 2 * len(rows):
        slots *= 2
    table: list[list[dict]] = [[] for _ in range(slots)]
    for word, row in rows.items():
        table[zlib.crc32(word.encode()) & (slots - 1)].append({"w": word, "r": dict(row)})
    literal = F.from_json(F.lit(json.dumps(table)), f"array<array<struct<w: string, r: struct<{fields}>>>>")

    def look(word: Column) -> Column:
        slot = F.crc32(word.cast("binary")).bitwiseAND(slots - 1).cast("int")
        return F.get(F.filter(F.get(literal, slot), lambda x: x["w"] == word), F.lit(0))["r"]

    return look
