"""Reader schemas and the typed entry table.

JSON leaves are read as strings, and lists as variants, so that one badly typed value never
makes a whole thread unreadable; the typed projection casts them afterwards.
"""

from __future__ import annotations

from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


def _struct(*names: str, **nested: T.DataType) -> T.StructType:
    fields = [T.StructField(n, T.StringType()) for n in names]
    return T.StructType(fields + [T.StructField(n, t) for n, t in nested.items()])


# Fields whose kind varies from file to file are read as variants.
ANY = T.VariantType()

ENTRY = _struct(
    "title",
    "entry_id",
    "author",
    "date",
    "content",
    "has_external_url",
    "sentiment_numeric",
    categories=ANY,
    referenced_content=ANY,
    referenced_entry_ids=ANY,
)

SCRAPE_INFO = _struct(
    "timestamp",
    "total_entries",
    "input",
    "time_filter",
    "filter_external_urls",
    filters=ANY,
)

# ``offset`` is the position of the first entry where a file holds a later part of a thread.
THREAD = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("offset", T.StringType()),
        T.StructField("scrape_info", SCRAPE_INFO),
        T.StructField("entries", T.ArrayType(ENTRY)),
        T.StructField(CORRUPT, T.StringType()),
    ]
)

# A root that is an object with ``entries`` or a bare list of entries.
POLYMORPHIC = T.StructType(
    [
        T.StructField("entries", T.ArrayType(_struct("entry_id", "id", "content"))),
        T.StructField("entry_id", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField(CORRUPT, T.StringType()),
    ]
)

ANNOTATION = T.StructType(
    [
        T.StructField("entry_id", T.StringType()),
        T.StructField("sentiment_numeric", T.StringType()),
        T.StructField("categories", ANY),
        T.StructField("entries", T.StringType()),
        T.StructField(CORRUPT, T.StringType()),
    ]
)

TYPED_ENTRY = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("entry_id", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("date_raw", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("has_external_url", T.BooleanType()),
        T.StructField("sentiment", T.ByteType()),
        T.StructField("topics", T.ArrayType(T.StringType())),
    ]
)
