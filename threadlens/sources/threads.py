"""Thread JSON -> one row per thread, then one row per entry.

A thread file is an object with ``scrape_info`` and ``entries``. Files that cannot
be read as that are set aside with a reason; the others go on. A long thread may
be stored as several consecutive parts (see ``sinks.threads``).
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.config import MISSING_SENTIMENT
from threadlens.functions.dates import iso_text, parse_stamp
from threadlens.functions.labels import topic_values, truthy_flag
from threadlens.functions.text import strip_blank, token_count
from threadlens.schema import CORRUPT, POLYMORPHIC, THREAD, TYPED_ENTRY
from threadlens.session import materialise


def read_threads(spark: SparkSession, paths: str | list[str], lines: bool = False, schema=THREAD) -> DataFrame:
    """One row per file (or per line when ``lines``), with ``path`` and the corrupt-record text."""
    return (
        spark.read.schema(schema)
        .option("multiLine", not lines)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(paths)
        .withColumn("path", F.col("_metadata.file_path"))
    )


def parse_threads(df: DataFrame, text: str, schema=THREAD) -> DataFrame:
    """Same shape from a column that holds the JSON text, which is parsed once whatever is filtered later."""
    parsed = F.from_json(F.col(text), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    rest = [c for c in df.columns if c != text]
    return df.select(*rest, F.col(text).alias("_text"), F.explode(F.array(parsed)).alias("_t")).select(
        *rest, *[F.col("_t")[f.name].alias(f.name) for f in schema.fields if f.name != CORRUPT],
        F.coalesce(F.col("_t")[CORRUPT], F.when(F.col("_t").isNull(), F.col("_text"))).alias(CORRUPT),
    )


def read_problem() -> Column:
    """Why a thread row is unusable, or null.

    The reader flags broken text, ``entries`` that is no list, and a field of the wrong
    kind deeper down alike; they are told apart by parsing the flagged text again.
    """
    flagged = F.col(CORRUPT).isNotNull()
    return (
        F.when(flagged & F.try_parse_json(F.col(CORRUPT)).isNull(), F.lit("InvalidDataJSON"))
        .when(flagged & F.col("entries").isNull(), F.lit("EntriesNotList"))
        .when(flagged, F.lit("MalformedField"))
    )


def split_readable(threads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(readable threads, quarantine with a reason); both narrow."""
    tagged = threads.withColumn("problem", read_problem())
    good = tagged.filter(F.col("problem").isNull()).drop("problem")
    return good, tagged.filter(F.col("problem").isNotNull())


def load_threads(
    spark: SparkSession, paths: Iterable[str], stored: bool = False, large: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(readable threads, quarantine) of thread files, or of tables that ``sinks.threads.write_threads`` wrote.

    The files are parsed once, into the shared folder, whatever is made of them afterwards. With ``large``
    a file is read by as many tasks as it has splits (``sources.large``), and its thread comes in parts.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if stored:
        rows = parse_threads(spark.read.parquet(*paths).select("path", "json"), "json")
    elif large:
        from threadlens.sources.large import split_thread_files

        rows = parse_threads(split_thread_files(spark, paths).select("path", "json"), "json")
    else:
        rows = read_threads(spark, paths)
    return split_readable(materialise(rows, "threads"))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def folder_name(path: Column) -> Column:
    return F.try_element_at(F.split(path, "/"), F.lit(-2))


def _thread_pos() -> Column:
    """Position in the whole thread of an entry exploded as ``_at``."""
    return (F.col("_at") + F.coalesce(F.col("offset").try_cast("bigint"), F.lit(0))).alias("pos")


def explode_entries(threads: DataFrame, keep: Iterable[str] = ("path",)) -> DataFrame:
    """One row per entry; ``pos`` is its position in the thread."""
    rows = threads.select(*keep, "scrape_info", "offset", F.posexplode("entries").alias("_at", "entry"))
    return rows.select(*keep, "scrape_info", _thread_pos(), "entry")


def scan_entries(
    threads: DataFrame,
    category: str | Column,
    labelled: bool | Column,
    keep: Iterable[str] = ("path",),
    date_mode: str = "first",
) -> DataFrame:
    """Typed entries with per-key defaults. Labels are nulled where the source has none.

    A missing title falls back to the thread's; sentiment stays null until export.
    """
    cat = F.lit(category) if isinstance(category, str) else category
    has_labels = F.lit(labelled) if isinstance(labelled, bool) else labelled
    e = F.col("entry")
    raw = F.coalesce(e["date"], F.lit(""))
    return explode_entries(threads, keep).select(
        *keep,
        "pos",
        F.coalesce(e["title"], F.col("scrape_info.input"), F.lit("")).alias("title"),
        F.coalesce(e["entry_id"], F.lit("")).alias("entry_id"),
        F.coalesce(e["author"], F.lit("")).alias("author"),
        raw.alias("date_raw"),
        parse_stamp(raw, date_mode).alias("date"),
        F.coalesce(e["content"], F.lit("")).alias("content"),
        cat.alias("category"),
        truthy_flag(e["has_external_url"]).alias("has_external_url"),
        F.when(has_labels, e["sentiment_numeric"].try_cast("tinyint")).alias("sentiment"),
        F.when(has_labels, topic_values(e["categories"])).otherwise(F.array().cast("array<string>")).alias("topics"),
    )


def union_sources(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_corpus(spark: SparkSession, root: str, sources, date_mode: str = "first") -> tuple[DataFrame, DataFrame]:
    """(typed entries of all configured sources, quarantine), both tagged with their category.

    A source whose pattern does not end in ``.json`` is a table written by ``write_threads``.
    """
    parts, unreadable = [], []
    for category, pattern, labelled in sources:
        good, bad = load_threads(spark, f"{root.rstrip('/')}/{pattern}", stored=not pattern.endswith(".json"))
        parts.append(scan_entries(good, category, labelled, date_mode=date_mode))
        unreadable.append(quarantine(bad).withColumn("category", F.lit(category)))
    return union_sources(parts), union_sources(unreadable)


def quarantine(bad: DataFrame) -> DataFrame:
    """``path, problem`` of the threads that could not be read."""
    return bad.select("path", "problem")


def part_of_thread() -> Column:
    """Place of a stored part in its thread; 0 for whole threads."""
    return F.coalesce(F.col("offset").try_cast("bigint"), F.lit(0))


def scan_folders(threads: DataFrame, title_from: str = "thread", keep: Iterable[str] = ("path",)) -> DataFrame:
    """Entries tagged with the folder they lie in and the lower-cased title.

    ``title_from="file"`` uses the root title or else the file name; ``"thread"``
    uses the searched title, then the first entry's, then the file name.
    """
    name = file_name(F.col("path"))
    first = F.get(F.col("entries"), F.lit(0))["title"]
    title = (
        F.coalesce(F.col("title"), name)
        if title_from == "file"
        else F.coalesce(F.col("title"), F.nullif(F.col("scrape_info.input"), F.lit("")), first, name)
    )
    keep = list(keep)
    return (
        threads.select(
            *keep,
            folder_name(F.col("path")).alias("origin_folder"),
            F.lower(title).alias("title"),
            "offset",
            F.posexplode("entries").alias("_at", "e"),
        )
        .select(
            *keep,
            "origin_folder",
            "title",
            _thread_pos(),
            F.col("e.date").alias("date_raw"),
            F.col("e.content").alias("content"),
            F.col("e.entry_id").alias("entry_id"),
        )
    )


def summarise_threads(threads: DataFrame, keep: Iterable[str]) -> DataFrame:
    """Title, first entry's date, entry and token counts per thread row; no explode, no shuffle."""
    first = F.get(F.col("entries"), F.lit(0))
    sizes = F.transform(F.col("entries"), lambda e: token_count(e["content"]))
    title = F.coalesce(F.nullif(F.col("scrape_info.input"), F.lit("")), first["title"], F.lit(""))
    return threads.select(
        *keep,
        title.alias("title"),
        F.coalesce(first["date"], F.lit("")).alias("date"),
        F.coalesce(F.size("entries"), F.lit(0)).cast("bigint").alias("num_entries"),
        token_count(title).alias("title_token_count"),
        F.coalesce(F.aggregate(sizes, F.lit(0).cast("bigint"), lambda a, n: a + n), F.lit(0).cast("bigint")).alias(
            "entry_token_count"
        ),
    )


def join_parts(summary: DataFrame, keys: Iterable[str], part: str = "part") -> DataFrame:
    """Summary rows of a thread's parts -> one row per thread."""
    head = lambda c: F.min_by(c, part).alias(c)
    return summary.groupBy(*keys).agg(
        head("title"),
        head("date"),
        F.sum("num_entries").alias("num_entries"),
        head("title_token_count"),
        F.sum("entry_token_count").alias("entry_token_count"),
    )


def polymorphic_entries(parsed: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Distinct ``(id, content)`` per thread from either root form (schema ``POLYMORPHIC``).

    A bare list reaches us as one row per element, numbered by ``pos``. A repeated id
    keeps its first position and takes its last text.
    """
    keys = list(keys)
    bare = F.struct("entry_id", "id", "content")
    rows = parsed.select(
        *keys,
        F.col("pos").alias("_row"),
        F.posexplode(F.coalesce(F.col("entries"), F.array(bare))).alias("_at", "e"),
    )
    picked = rows.select(
        *keys,
        (F.col("_row") + F.col("_at")).cast("bigint").alias("pos"),
        strip_blank(F.coalesce(F.nullif(F.col("e.entry_id"), F.lit("")), F.col("e.id"), F.lit(""))).alias("entry_id"),
        F.coalesce(F.col("e.content"), F.lit("")).alias("content"),
    ).filter(F.col("entry_id") != "")
    return picked.groupBy(*keys, "entry_id").agg(
        F.min("pos").alias("pos"),
        F.max_by("content", "pos").alias("content"),
    )


def read_polymorphic(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Entries of thread files whose root is an object or a bare list."""
    rows = read_threads(spark, paths, schema=POLYMORPHIC).filter(F.col(CORRUPT).isNull())
    numbered = rows.withColumn("pos", F.monotonically_increasing_id())
    return polymorphic_entries(numbered, ["path"])


def export_shape(entries: DataFrame) -> DataFrame:
    """The ten typed columns with ISO dates and the -1 sentinel for missing sentiment."""
    shaped = entries.withColumn("date", iso_text(F.col("date"))).withColumn(
        "sentiment", F.coalesce(F.col("sentiment"), F.lit(MISSING_SENTIMENT))
    )
    return shaped.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TYPED_ENTRY.fields])


def read_typed(spark: SparkSession, path: str) -> DataFrame:
    """The typed table, as saved; a filter on ``category`` prunes folders."""
    return spark.read.schema(TYPED_ENTRY).parquet(path).select(*TYPED_ENTRY.fieldNames())
