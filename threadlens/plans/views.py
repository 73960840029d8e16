"""The benchmark tables seen as the corpus: entries, labels, threads, dated posts, scored events.

Each view exists twice, as a DataFrame and as the SQL text the checks use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.operators import timelines
from threadlens.sinks.threads import nest_entries, thread_json
from threadlens.sources.tables import read_table

# Lexicons over words that occur in the benchmark texts.
FRAMES = {
    "nominal": ["tion", "ment", "heit"],
    "article": ["the", "der", "las"],
    "verbal": ["ing", "elle", "ment"],
    "german": ["sch", "keit", "ung"],
    "spanish": ["ción", "dad", "los"],
    "french": ["eau", "oi", "queé"],
}
FRAME_NAMES = list(FRAMES)
SUBGROUPS = {"tion": ["tion", "ción"], "ver": ["ver"], "en": ["en"]}
SUBGROUP_NAMES = list(SUBGROUPS)
MENTIONS = (("ther", "ther"), ("the", "the"))
TITLE_CATEGORIES = (("tion", "tion"), ("eau", "eau"), ("sch", "sch"))
CATALOGUE = {"alpha": ["the", "and"], "beta": ["que", "eau"], "gamma": ["sch"], "delta": ["ción", "ía"]}
LABELS = {"en": "English", "fr": "French", "de": "German"}
SUBGROUP_LABELS = {"tion": "Nominal", "ver": "Verb", "en": "French"}
VALENCE = {
    "the": 0.5, "of": -0.25, "der": -1.5, "la": 0.75, "que": -1.25, "und": 0.25, "los": 2.0,
    "avec": 1.5, "nicht": -2.5, "with": 1.0, "not": -1.0, "para": 0.5,
}
FIRST, LAST = 1996, 2000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf}/{name}.parquet")


def entries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("entry_id"),
        "doc_id",
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("content"),
        F.col("lang").alias("category"),
        F.col("source").alias("origin"),
    )


V_ENTRIES = """
v_entries AS (
  SELECT cast(doc_id AS varchar) AS entry_id, doc_id, split_part(text, chr(10), 1) AS title,
         text AS content, lang AS category, source AS origin
  FROM documents)"""


def labels(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "labels")
    bad, good = F.col("toxic") == 1, F.col("quality") == 1
    topics = F.array_compact(
        F.array(F.when(bad, F.lit("HATE")), F.when(good, F.lit("HUMAN")), F.when(~bad & ~good, F.lit("NEUTRAL")))
    )
    return raw.select(
        F.col("doc_id").cast("string").alias("entry_id"),
        (1 + 2 * F.col("quality") + (1 - F.col("toxic"))).cast("int").alias("sentiment"),
        topics.alias("topics"),
    )


V_LABELS = """
v_labels AS (
  SELECT cast(doc_id AS varchar) AS entry_id, cast(1 + 2 * quality + (1 - toxic) AS integer) AS sentiment,
         list_filter([CASE WHEN toxic = 1 THEN 'HATE' END, CASE WHEN quality = 1 THEN 'HUMAN' END,
                      CASE WHEN toxic = 0 AND quality = 0 THEN 'NEUTRAL' END], lambda x: x IS NOT NULL) AS topics
  FROM labels)"""


def dated(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    edit = (
        F.when(key % 7 == 0, F.lit(" ~ 11:20")).when(key % 11 == 0, F.lit(" ~ 31.12.2001 09:00")).otherwise(F.lit(""))
    )
    return table(spark, sf, "orders").select(
        key.cast("string").alias("entry_id"),
        F.col("o_custkey").cast("string").alias("author"),
        F.col("o_orderpriority").alias("category"),
        F.concat(F.date_format("o_orderdate", "dd.MM.yyyy"), F.lit(" 10:15"), edit).alias("date_raw"),
    )


V_DATED = r"""
v_raw_dated AS (
  SELECT cast(o_orderkey AS varchar) AS entry_id, o_orderkey AS k, cast(o_custkey AS varchar) AS author,
         o_orderpriority AS category,
         strftime(o_orderdate, '%d.%m.%Y') || ' 10:15' ||
         CASE WHEN o_orderkey % 7 = 0 THEN ' ~ 11:20' WHEN o_orderkey % 11 = 0 THEN ' ~ 31.12.2001 09:00'
              ELSE '' END AS date_raw
  FROM orders),
v_dated AS (
  SELECT *, cast(year(ts) AS integer) AS year FROM (
    SELECT *, try_strptime(regexp_extract(date_raw, '\d{2}\.\d{2}\.\d{4}\s+\d{2}:\d{2}'), '%d.%m.%Y %H:%M') AS ts
    FROM v_raw_dated))"""


def posts(spark: SparkSession, sf: str, rows: DataFrame | None = None) -> DataFrame:
    """Entries with the author and date of the order of the same number.

    ``rows`` are entries already reduced to what is needed, so that texts stay out of the joins.
    """
    when = timelines.dated(dated(spark, sf).drop("category"))
    return (entries(spark, sf) if rows is None else rows).join(when, "entry_id")


def labelled_posts(spark: SparkSession, sf: str, rows: DataFrame | None = None) -> DataFrame:
    return posts(spark, sf, rows).join(labels(spark, sf), "entry_id", "left")


V_POSTS = V_ENTRIES + "," + V_LABELS + "," + V_DATED + """,
v_posts AS (
  SELECT e.*, d.author, d.date_raw, d.ts, d.year, l.sentiment, l.topics
  FROM v_entries e JOIN v_dated d ON e.entry_id = d.entry_id LEFT JOIN v_labels l ON e.entry_id = l.entry_id)"""


def threads(spark: SparkSession, sf: str) -> DataFrame:
    conv, turn = F.col("conv_id"), F.col("turn")
    return table(spark, sf, "conversations").select(
        "conv_id",
        turn.alias("pos"),
        F.concat(F.lit("thread "), conv.cast("string")).alias("title"),
        (conv * 100 + turn).cast("string").alias("entry_id"),
        F.col("role").alias("author"),
        F.concat(
            F.lpad((turn % 28 + 1).cast("string"), 2, "0"),
            F.lit(".03.2021 10:"),
            F.lpad((conv % 60).cast("string"), 2, "0"),
        ).alias("date_raw"),
        F.col("text").alias("content"),
        F.element_at(F.array(F.lit("red"), F.lit("green"), F.lit("blue")), (conv % 3 + 1).cast("int")).alias("folder"),
    )


V_THREADS = """
v_threads AS (
  SELECT conv_id, turn AS pos, 'thread ' || conv_id AS title, cast(conv_id * 100 + turn AS varchar) AS entry_id,
         role AS author,
         lpad(cast(turn % 28 + 1 AS varchar), 2, '0') || '.03.2021 10:' ||
         lpad(cast(conv_id % 60 AS varchar), 2, '0') AS date_raw,
         text AS content, ['red', 'green', 'blue'][conv_id % 3 + 1] AS folder
  FROM conversations)"""

# The same rows by thread, that is by file.
V_FILES = V_THREADS + """,
v_files AS (
  SELECT conv_id, any_value(folder) AS folder, any_value(title) AS title, 'thread_' || conv_id AS stem,
         count(*) AS n_entries
  FROM v_threads GROUP BY conv_id)"""

# Entries per stored part in the queries: most threads come in several parts, which no result may show.
STORED_PART = 3


def thread_files(spark: SparkSession, sf: str, title: Column | None = None, author: Column | None = None,
                 entry_id: Column | None = None) -> DataFrame:
    """Thread JSON texts with a path, as ``write_threads`` stores them: a row for each part of a thread.

    Columns passed in replace the fields of that name inside the entries.
    """
    rows = threads(spark, sf).select(
        "conv_id",
        "pos",
        "folder",
        F.col("title").alias("input"),
        (F.col("title") if title is None else title).alias("title"),
        (F.col("entry_id") if entry_id is None else entry_id).alias("entry_id"),
        (F.col("author") if author is None else author).alias("author"),
        F.col("date_raw").alias("date"),
        "content",
    )
    nested = nest_entries(
        rows, ["conv_id"], ["title", "entry_id", "author", "date", "content"], carried=["folder", "input"],
        part_size=STORED_PART,
    )
    stem = F.concat(F.lit("thread_"), F.col("conv_id").cast("string"))
    return (
        thread_json(nested, F.struct("input"), "json")
        .withColumn("stem", stem)
        .withColumn("path", F.concat(F.lit("/corpus/"), F.col("folder"), F.lit("/"), F.col("stem"), F.lit(".json")))
        .select("conv_id", "part", "folder", "stem", "path", "json")
    )


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id",
        F.col("user_id").cast("string").alias("author"),
        F.col("event_type").alias("category"),
        F.year("ts").alias("year"),
        F.col("value").alias("score"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


V_EVENTS = """
v_events AS (
  SELECT event_id, cast(user_id AS varchar) AS author, event_type AS category, cast(year(ts) AS integer) AS year,
         value AS score, cast(json_extract_string(props, '$.k') AS integer) AS k
  FROM events)"""


def sql_any(column: str, stems) -> str:
    """SQL test for any of the stems, ignoring case."""
    return f"regexp_matches({column}, '(?i)({'|'.join(stems)})')"


def sql_flags(column: str, lexicon, prefix: str = "") -> str:
    return ", ".join(f"{sql_any(column, stems)} AS {prefix}{name}" for name, stems in lexicon.items())


def sql_case(column: str, choices, at_word_start: bool = False) -> str:
    start = r"(^|[^\p{L}\p{N}_])" if at_word_start else ""
    whens = " ".join(f"WHEN regexp_matches({column}, '(?i){start}({stem})') THEN '{name}'" for name, stem in choices)
    return f"CASE {whens} END"


def sql_label(column: str, mapping) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + " END"


WORDS = r"[\p{L}\p{N}_]+"
TITLE_WORD = "[a-zçğıöşüİĞÜŞÖÇ]+"
SQL_ISO = "'%Y-%m-%dT%H:%M:%S'"
