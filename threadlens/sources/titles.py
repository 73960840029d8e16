"""Title lists: text files with one title per line."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from threadlens.functions.text import strip_blank
from threadlens.operators.shape import keep_found

# Encodings in the order they are tried.
ENCODINGS = ("utf-8", "utf-16", "latin-1")


@F.pandas_udf(StringType())
def decode_bytes(raw: pd.Series) -> pd.Series:
    """Text of a file that is no UTF-8, in the first encoding that fits (Spark's own decode raises instead of falling through)."""

    def one(data):
        for name in ENCODINGS[1:]:
            try:
                return bytes(data).decode(name)
            except UnicodeDecodeError:
                pass
        return None

    return raw.map(one, na_action="ignore")


def clean_line(line: Column) -> Column:
    """The trimmed line, or null for blanks and ``#`` comments."""
    text = strip_blank(line)
    return F.when((text != "") & ~text.startswith("#"), text)


def clean_titles(lines: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` holds a title, trimmed."""
    return keep_found(lines, column, clean_line(F.col(column)))


def read_title_lists(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(path, pos, title)`` of every title; each file is one small list."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    plain = files.filter(F.is_valid_utf8(F.col("content").cast("string"))).select("path", F.col("content").cast("string").alias("text"))
    other = files.filter(~F.is_valid_utf8(F.col("content").cast("string"))).select("path", decode_bytes("content").alias("text"))
    files = plain.unionByName(other)
    lines = files.select("path", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("pos", "title"))
    return clean_titles(lines, "title")
