"""Sources, sinks, defaults and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlens.functions.dates import iso_text
from threadlens.functions.labels import display_label, truthy_flag
from threadlens.functions.patterns import matches
from threadlens.functions.text import blank_to_null, thousands
from threadlens.operators import frames, mentions, summaries, timelines
from threadlens.operators.joins import number_rows
from threadlens.operators.shape import keep_found
from threadlens.plans import views as v
from threadlens.plans.catalog import query
from threadlens.schema import POLYMORPHIC
from threadlens.session import new_path
from threadlens.sinks.files import write_thread_files
from threadlens.sinks.tables import annotation_rows, read_csv, write_annotations, write_csv, write_typed
from threadlens.sinks.threads import nest_entries
from threadlens.sources import threads as th
from threadlens.sources.annotations import latest_annotations, read_written_annotations
from threadlens.sources.titles import clean_titles

CLOCK = f"strftime(try_strptime(date_raw, '%d.%m.%Y %H:%M'), {v.SQL_ISO})"


@query(
    "thread_scan",
    f"""
    SELECT conv_id, pos, title, entry_id, CASE WHEN pos % 3 = 2 THEN '' ELSE author END AS author, date_raw,
           {CLOCK} AS date, md5(content) AS content_md5, 'forum' AS category, false AS has_external_url
    FROM v_threads""",
    [v.V_THREADS],
)
def thread_scan(spark, sf):
    """Thread JSON -> entries; every second title and some authors are left out of the JSON."""
    files = v.thread_files(
        spark,
        sf,
        title=F.when(F.col("pos") % 2 == 0, F.col("title")),
        author=F.when(F.col("pos") % 3 != 2, F.col("author")),
    )
    parsed = th.parse_threads(files, "json")
    rows = th.scan_entries(parsed, "forum", False, keep=["conv_id"])
    return rows.select(
        "conv_id", "pos", "title", "entry_id", "author", "date_raw", iso_text(F.col("date")).alias("date"),
        F.md5("content").alias("content_md5"), "category", "has_external_url",
    )


LABELLED_SOURCES = ("en", "fr")


@query(
    "source_union",
    """
    SELECT e.entry_id, e.category, CASE WHEN e.category IN ('en', 'fr') THEN l.sentiment END AS sentiment,
           CASE WHEN e.category IN ('en', 'fr') THEN coalesce(array_to_string(l.topics, ','), '') ELSE '' END AS topics
    FROM v_entries e LEFT JOIN v_labels l ON e.entry_id = l.entry_id""",
    [v.V_ENTRIES, v.V_LABELS],
)
def source_union(spark, sf):
    """All sources under one schema, two of them with labels: one scan, one label join."""
    rows = v.entries(spark, sf).select("entry_id", "category").join(v.labels(spark, sf), "entry_id", "left")
    has_labels = F.coalesce(F.col("category").isin(*LABELLED_SOURCES), F.lit(False))
    topics = F.when(has_labels, F.array_join("topics", ","))
    return rows.select(
        "entry_id", "category", F.when(has_labels, F.col("sentiment")).alias("sentiment"),
        F.coalesce(topics, F.lit("")).alias("topics"),
    )


@query(
    "folder_scan",
    """
    SELECT t.folder AS origin_folder, f.stem || '.json' AS title, t.pos, t.entry_id, t.date_raw
    FROM v_threads t JOIN v_files f ON t.conv_id = f.conv_id""",
    [v.V_FILES],
)
def folder_scan(spark, sf):
    parsed = th.parse_threads(v.thread_files(spark, sf), "json")
    rows = th.scan_folders(parsed, title_from="file")
    return rows.select("origin_folder", "title", "pos", "entry_id", "date_raw")


@query(
    "corrupt_quarantine",
    """
    SELECT conv_id,
           CASE conv_id % 10 WHEN 0 THEN 'InvalidDataJSON' WHEN 5 THEN 'EntriesNotList' ELSE 'ok' END AS status,
           CASE WHEN conv_id % 10 IN (0, 5) THEN 0 ELSE n_entries END AS n_entries,
           CASE WHEN conv_id % 10 = 3 THEN 'HATE' ELSE '' END AS topics
    FROM v_files""",
    [v.V_FILES],
)
def corrupt_quarantine(spark, sf):
    """Some files cut in half, some with an object for entries; the rest still reads, badly typed topics included."""
    kind = F.col("conv_id") % 10
    odd = F.regexp_replace("json", r'\{"title":', '{"categories":"HATE","referenced_content":7,"title":')
    broken = (
        F.when(kind == 0, F.left("json", F.floor(F.length("json") / 2).cast("int")))
        .when(kind == 5, F.lit('{"scrape_info": {"input": "x"}, "entries": {"a": 1}}'))
        .when(kind == 3, odd)
        .otherwise(F.col("json"))
    )
    files = v.thread_files(spark, sf).withColumn("json", broken)
    good, bad = th.split_readable(th.parse_threads(files, "json"))
    read = th.scan_entries(good, "forum", True, keep=["conv_id"]).groupBy("conv_id").agg(
        F.lit("ok").alias("status"), F.count("*").alias("n_entries"),
        F.array_join(F.sort_array(F.collect_set(F.array_join("topics", ","))), ";").alias("topics"))
    return read.unionByName(bad.select(
        "conv_id", F.col("problem").alias("status"), F.lit(0).cast("bigint").alias("n_entries"), F.lit("").alias("topics")
    ).distinct())


def _summary(spark, sf):
    parsed = th.parse_threads(v.thread_files(spark, sf), "json")
    return th.join_parts(th.summarise_threads(parsed, ["conv_id", "folder", "part"]), ["conv_id", "folder"])


SQL_SUMMARY = rf"""
v_summary AS (
  SELECT conv_id, folder, any_value(title) AS title, min_by(date_raw, pos) AS date, count(*) AS num_entries,
         cast(any_value(len(regexp_extract_all(title, '{v.WORDS}'))) AS bigint) AS title_token_count,
         cast(sum(len(regexp_extract_all(content, '{v.WORDS}'))) AS bigint) AS entry_token_count
  FROM v_threads GROUP BY conv_id, folder)"""


@query("thread_summary", "SELECT * FROM v_summary", [v.V_THREADS, SQL_SUMMARY])
def thread_summary(spark, sf):
    return _summary(spark, sf)


@query("thread_summary_csv", "SELECT * FROM v_summary", [v.V_THREADS, SQL_SUMMARY])
def thread_summary_csv(spark, sf):
    """The per-thread table through its CSV export and back."""
    table = _summary(spark, sf)
    path = new_path(spark, "summary-csv")
    write_csv(table, path)
    return read_csv(spark, path, table.schema)


@query(
    "corpus_stats",
    """
    SELECT 'category' AS level, folder AS category, count(DISTINCT title) AS num_titles,
           cast(sum(num_entries) AS bigint) AS num_entries, cast(sum(title_token_count) AS bigint) AS title_token_count,
           cast(sum(entry_token_count) AS bigint) AS entry_token_count,
           cast(sum(title_token_count) + sum(entry_token_count) AS bigint) AS total_tokens
    FROM v_summary GROUP BY folder
    UNION ALL
    SELECT 'overall', 'ALL', count(*), cast(sum(num_entries) AS bigint), cast(sum(title_token_count) AS bigint),
           cast(sum(entry_token_count) AS bigint), cast(sum(title_token_count) + sum(entry_token_count) AS bigint)
    FROM v_summary""",
    [v.V_THREADS, SQL_SUMMARY],
)
def corpus_stats(spark, sf):
    return summaries.ordered_stats(summaries.corpus_stats(_summary(spark, sf), "folder"))


@query(
    "folder_summary",
    """
    x AS (SELECT CASE folder WHEN 'red' THEN 'Red' WHEN 'green' THEN 'Green' END AS label,
                 CASE WHEN conv_id % 10 = 0 THEN 0 ELSE n_entries END AS n FROM v_files)
    SELECT coalesce(label, 'Total') AS label, count(*) AS titles, cast(sum(n) AS bigint) AS entries
    FROM x WHERE label IS NOT NULL GROUP BY ROLLUP (label)""",
    [v.V_FILES],
)
def folder_summary(spark, sf):
    """Every tenth file is unreadable: a title, but no entries; one folder has no label."""
    broken = F.when(F.col("conv_id") % 10 == 0, F.lit("{")).otherwise(F.col("json"))
    parsed = th.parse_threads(v.thread_files(spark, sf).withColumn("json", broken), "json")
    parts = parsed.select("conv_id", "folder", F.when(F.col("entries").isNotNull(), F.size("entries")).alias("n_entries"))
    files = parts.groupBy("conv_id", "folder").agg(F.sum("n_entries").alias("n_entries"))
    return summaries.folder_summary(files, "folder", {"red": "Red", "green": "Green"})


def annotation_log(spark, sf):
    """Each label, a revision of every fourth one, and records without an id."""
    raw = v.table(spark, sf, "labels")
    base = raw.select(F.col("doc_id").cast("string").alias("entry_id"), F.col("doc_id").alias("pos"), "quality")
    later = base.filter(F.col("pos") % 4 == 0).select(
        "entry_id", (F.col("pos") + 1_000_000_000_000).alias("pos"), (1 - F.col("quality")).alias("quality")
    )
    lost = base.select(F.lit(None).cast("string").alias("entry_id"), "pos", "quality")
    return base.unionByName(later).unionByName(lost)


@query(
    "annotation_latest",
    """
    SELECT cast(doc_id AS varchar) AS entry_id, CASE WHEN doc_id % 4 = 0 THEN 1 - quality ELSE quality END AS quality
    FROM labels""",
)
def annotation_latest(spark, sf):
    return latest_annotations(annotation_log(spark, sf))


@query(
    "title_list_clean",
    """
    SELECT page_id, url AS title FROM pages WHERE page_id % 5 <> 0 AND page_id % 7 <> 0""",
)
def title_list_clean(spark, sf):
    """Lines with blanks around, comments and empty lines."""
    k = F.col("page_id")
    line = (
        F.when(k % 5 == 0, F.concat(F.lit(" # "), F.col("url")))
        .when(k % 7 == 0, F.lit(" \t "))
        .otherwise(F.concat(F.lit("  "), F.col("url"), F.lit("\t\r")))
    )
    return clean_titles(v.table(spark, sf, "pages").select("page_id", line.alias("title")), "title")


def _typed_source(spark, sf):
    return v.labelled_posts(spark, sf).select(
        "title", "entry_id", "author", "date_raw", "date", "content", "category",
        F.col("content").contains("http").alias("has_external_url"), "sentiment",
        F.coalesce("topics", F.array().cast("array<string>")).alias("topics"),
    )


def _typed_view(df):
    return df.select(
        "title", "entry_id", "author", "date_raw", "date", F.md5("content").alias("content_md5"), "category",
        "has_external_url", F.col("sentiment").cast("int").alias("sentiment"),
        F.array_join("topics", ",").alias("topics"),
    )


SQL_TYPED = f"""
    SELECT title, entry_id, author, date_raw, strftime(ts, {v.SQL_ISO}) AS date, md5(content) AS content_md5, category,
           contains(content, 'http') AS has_external_url, coalesce(sentiment, -1) AS sentiment,
           coalesce(array_to_string(topics, ','), '') AS topics
    FROM v_posts"""


@query("typed_table_export", SQL_TYPED, [v.V_POSTS])
def typed_table_export(spark, sf):
    return _typed_view(th.export_shape(_typed_source(spark, sf)))


@query("typed_table_load", SQL_TYPED, [v.V_POSTS])
def typed_table_load(spark, sf):
    """The typed table written by category and read back."""
    path = new_path(spark, "typed")
    write_typed(_typed_source(spark, sf), path)
    return _typed_view(th.read_typed(spark, path))


@query(
    "polymorphic_root",
    """
    SELECT conv_id, cast(conv_id * 100 + pos // 2 AS varchar) AS entry_id, min(pos) AS pos,
           md5(max_by(content, pos)) AS content_md5
    FROM v_threads GROUP BY conv_id, pos // 2""",
    [v.V_THREADS],
)
def polymorphic_root(spark, sf):
    """Even threads are objects with entries, odd ones bare lists; every id comes twice, once as ``id``."""
    rows = v.threads(spark, sf).select(
        "conv_id",
        "pos",
        (F.col("conv_id") * 100 + F.floor(F.col("pos") / 2)).cast("string").alias("key"),
        "content",
    )
    named = rows.select(
        "conv_id",
        "pos",
        F.when(F.col("pos") % 2 == 0, F.col("key")).alias("entry_id"),
        F.when(F.col("pos") % 2 == 1, F.col("key")).alias("id"),
        "content",
    )
    even = nest_entries(named.filter(F.col("conv_id") % 2 == 0), ["conv_id"], ["entry_id", "id", "content"])
    objects = even.select(
        "conv_id", F.coalesce("offset", F.lit(0)).alias("pos"), F.to_json(F.struct("entries")).alias("json")
    )
    elements = named.filter(F.col("conv_id") % 2 == 1).select(
        "conv_id", "pos", F.to_json(F.struct("entry_id", "id", "content")).alias("json")
    )
    parsed = th.parse_threads(objects.unionByName(elements), "json", POLYMORPHIC)
    found = th.polymorphic_entries(parsed, ["conv_id"])
    return found.select("conv_id", "entry_id", "pos", F.md5("content").alias("content_md5"))


@query(
    "nested_rebuild",
    """
    SELECT conv_id, pos // 4 AS part, count(*) AS n_entries, md5(string_agg(entry_id, ',' ORDER BY pos)) AS ids_md5,
           md5(string_agg(content, '|' ORDER BY pos)) AS text_md5
    FROM v_threads GROUP BY conv_id, pos // 4""",
    [v.V_THREADS],
)
def nested_rebuild(spark, sf):
    """Threads rebuilt from their entries, here in parts of four."""
    nested = nest_entries(v.threads(spark, sf), ["conv_id"], ["entry_id", "content"], part_size=4)
    return nested.select(
        "conv_id",
        "part",
        F.size("entries").cast("bigint").alias("n_entries"),
        F.md5(F.array_join("entries.entry_id", ",")).alias("ids_md5"),
        F.md5(F.array_join("entries.content", "|")).alias("text_md5"),
    )


@query(
    "large_file_scan",
    """
    SELECT folder AS category, row_number() OVER (PARTITION BY folder ORDER BY conv_id, pos) - 1 AS pos, entry_id,
           coalesce(author, '') AS author, md5(content) AS content_md5
    FROM v_threads""",
    [v.V_THREADS],
)
def large_file_scan(spark, sf):
    """All threads of a folder as one file, written in parts, and read back by splits of the file."""
    rows = v.threads(spark, sf).withColumn("order", F.col("conv_id") * 100_000 + F.col("pos"))
    rows = number_rows(rows.drop("pos"), ["folder"], "order").withColumn("pos", F.col("rn") - 1)
    nested = nest_entries(rows, ["folder"], ["entry_id", "author", "content"], part_size=500)
    path = new_path(spark, "folder-files")
    write_thread_files(nested, F.concat("folder", F.lit("/all.json")), F.struct(F.col("folder").alias("input")), path)
    good, _ = th.load_threads(spark, [f"{path}/*/*.json"], large=True)
    read = th.scan_entries(good, th.folder_name(F.col("path")), False, keep=["path"])
    return read.select("category", "pos", "entry_id", "author", F.md5("content").alias("content_md5"))


@query(
    "annotation_only",
    """
    SELECT e.origin || '_annotations.json' AS annotation_file, e.entry_id, l.sentiment AS sentiment_numeric,
           array_to_string(l.topics, ',') AS categories
    FROM v_entries e JOIN v_labels l ON e.entry_id = l.entry_id""",
    [v.V_ENTRIES, v.V_LABELS],
)
def annotation_only(spark, sf):
    rows = (
        v.entries(spark, sf)
        .select("entry_id", "origin")
        .join(v.labels(spark, sf), "entry_id")
        .withColumnsRenamed({"sentiment": "sentiment_numeric", "topics": "categories"})
    )
    return annotation_rows(rows, "origin").withColumn("categories", F.array_join("categories", ","))


@query(
    "annotation_files",
    """
    SELECT e.origin || '_annotations.json' AS annotation_file, e.entry_id, l.sentiment AS sentiment_numeric,
           array_to_string(l.topics, ',') AS categories
    FROM v_entries e JOIN v_labels l ON e.entry_id = l.entry_id""",
    [v.V_ENTRIES, v.V_LABELS],
)
def annotation_files(spark, sf):
    """The same records written to a folder per target file and read back."""
    rows = (
        v.entries(spark, sf)
        .select("entry_id", "origin")
        .join(v.labels(spark, sf), "entry_id")
        .withColumnsRenamed({"sentiment": "sentiment_numeric", "topics": "categories"})
    )
    path = new_path(spark, "annotations")
    write_annotations(rows, "origin", path)
    back = read_written_annotations(spark, path)
    return back.withColumn("categories", F.array_join("categories", ","))


@query(
    "default_fill",
    """
    SELECT cast(doc_id AS varchar) AS entry_id, CASE WHEN doc_id % 3 = 0 THEN source ELSE title END AS title,
           doc_id % 5 IN (0, 2) AS has_external_url
    FROM (SELECT *, split_part(text, chr(10), 1) AS title FROM documents)""",
)
def default_fill(spark, sf):
    k = F.col("doc_id")
    flag = F.element_at(
        F.array(F.lit("true"), F.lit("false"), F.lit("1"), F.lit("0"), F.lit(None).cast("string")),
        (k % 5 + 1).cast("int"),
    )
    raw = v.entries(spark, sf).select("doc_id", F.when(k % 3 != 0, F.col("title")).alias("title"), "origin",
                                      flag.alias("url"))
    return raw.select(
        F.coalesce(k.cast("string"), F.lit("")).alias("entry_id"),
        F.coalesce("title", "origin", F.lit("")).alias("title"),
        truthy_flag(F.col("url")).alias("has_external_url"),
    )


@query(
    "label_lookup",
    f"SELECT entry_id, {v.sql_label('category', v.LABELS)} AS label FROM v_entries",
    [v.V_ENTRIES],
)
def label_lookup(spark, sf):
    return v.entries(spark, sf).select("entry_id", display_label(F.col("category"), v.LABELS).alias("label"))


@query("distinct_titles", "SELECT DISTINCT category, title, year FROM v_posts", [v.V_POSTS])
def distinct_titles(spark, sf):
    return frames.distinct_titles(v.posts(spark, sf), "category")


@query(
    "dated_only",
    f"SELECT entry_id, {CLOCK} AS date, year FROM v_dated WHERE try_strptime(date_raw, '%d.%m.%Y %H:%M') IS NOT NULL",
    [v.V_DATED],
)
def dated_only(spark, sf):
    kept = timelines.dated(v.dated(spark, sf), mode="strict")
    return kept.select("entry_id", iso_text(F.col("date")).alias("date"), "year")


@query(
    "nonempty_content",
    """
    SELECT entry_id, length(content) AS n_chars, md5(content) AS content_md5
    FROM (SELECT entry_id, doc_id, regexp_replace(content, '^[\\s]+|[\\s]+$', '', 'g') AS content FROM v_entries)
    WHERE doc_id % 9 <> 0 AND content <> ''""".replace("\\\\", "\\"),
    [v.V_ENTRIES],
)
def nonempty_content(spark, sf):
    """Texts padded with white space, every ninth one blank."""
    padded = F.when(F.col("doc_id") % 9 == 0, F.lit(" \t\n ")).otherwise(
        F.concat(F.lit("\t "), F.col("content"), F.lit(" \n"))
    )
    kept = keep_found(v.entries(spark, sf), "content", blank_to_null(padded))
    return kept.select(
        "entry_id", F.length("content").cast("bigint").alias("n_chars"), F.md5("content").alias("content_md5")
    )


@query(
    "year_range",
    f"SELECT entry_id, year FROM v_dated WHERE year BETWEEN {v.FIRST} AND {v.LAST}",
    [v.V_DATED],
)
def year_range(spark, sf):
    return timelines.in_years(timelines.dated(v.dated(spark, sf)), v.FIRST, v.LAST).select("entry_id", "year")


@query(
    "stem_filter",
    f"SELECT entry_id, title FROM v_entries WHERE {v.sql_any('title', v.CATALOGUE['alpha'])}",
    [v.V_ENTRIES],
)
def stem_filter(spark, sf):
    return v.entries(spark, sf).filter(matches(F.col("title"), v.CATALOGUE["alpha"])).select("entry_id", "title")


SQL_MARKER = v.sql_case("content", v.MENTIONS, at_word_start=True)


@query(
    "mention_only",
    f"SELECT entry_id, marker FROM (SELECT entry_id, {SQL_MARKER} AS marker FROM v_entries) WHERE marker IS NOT NULL",
    [v.V_ENTRIES],
)
def mention_only(spark, sf):
    return mentions.with_mention(v.entries(spark, sf), stems=v.MENTIONS).select("entry_id", "marker")


@query(
    "group_subset",
    f"SELECT entry_id FROM v_entries WHERE category = 'fr' AND {v.sql_any('title', v.SUBGROUPS['en'])}",
    [v.V_ENTRIES],
)
def group_subset(spark, sf):
    rows = v.entries(spark, sf).filter(F.col("category") == "fr")
    return rows.filter(matches(F.col("title"), v.SUBGROUPS["en"])).select("entry_id")


@query(
    "format_counts",
    "SELECT category, format('{:,}', count(*)) AS n_text FROM v_dated GROUP BY category",
    [v.V_DATED],
)
def format_counts(spark, sf):
    counted = summaries.entries_per_group(v.dated(spark, sf), "category")
    return counted.select("category", thousands(F.col("n")).alias("n_text"))


@query(
    "label_coverage",
    """
    SELECT cast(count(sentiment) AS bigint) AS with_sentiment,
           cast(count(*) - count(sentiment) AS bigint) AS without_sentiment,
           string_agg(DISTINCT category, ',' ORDER BY category) AS categories
    FROM v_entries e LEFT JOIN v_labels l ON e.entry_id = l.entry_id""",
    [v.V_ENTRIES, v.V_LABELS],
)
def label_coverage(spark, sf):
    rows = v.entries(spark, sf).select("entry_id", "category").join(v.labels(spark, sf), "entry_id", "left")
    return summaries.label_coverage(rows).withColumn("categories", F.array_join("categories", ","))


