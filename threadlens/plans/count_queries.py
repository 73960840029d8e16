"""Counts over groups and years, descriptive tables, rankings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.functions.labels import half_even
from threadlens.functions.text import snippet
from threadlens.operators import frames, frequent, ranking, rollups, shape, summaries, timelines
from threadlens.plans import views as v
from threadlens.plans.catalog import query

PRIORITIES = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium", "5-LOW": "low"}


def _dated(spark, sf):
    return timelines.dated(v.dated(spark, sf))


@query("entries_per_group", "SELECT category, count(*) AS n FROM v_dated GROUP BY category", [v.V_DATED])
def entries_per_group(spark, sf):
    return summaries.entries_per_group(v.dated(spark, sf), "category").orderBy(F.desc("n"), "category")


@query("titles_per_group", "SELECT category, count(DISTINCT title) AS n_titles FROM v_entries GROUP BY category",
       [v.V_ENTRIES])
def titles_per_group(spark, sf):
    return summaries.titles_per_group(v.entries(spark, sf), "category")


@query(
    "mean_length_per_group",
    "SELECT category, round_even(avg(length(content)), 1) AS mean_length FROM v_entries GROUP BY category",
    [v.V_ENTRIES],
)
def mean_length_per_group(spark, sf):
    return summaries.mean_length_per_group(v.entries(spark, sf), "category")


@query("rounded_means", """
    SELECT category, round_even(avg(k), 1) AS mean_1, round_even(avg(score), 3) AS mean_3
    FROM v_events GROUP BY category""", [v.V_EVENTS])
def rounded_means(spark, sf):
    return v.events(spark, sf).groupBy("category").agg(
        half_even(F.avg("k"), 1).alias("mean_1"), half_even(F.avg("score"), 3).alias("mean_3")
    )


@query(
    "length_boxstats",
    """
    l AS (SELECT category, length(content) AS len FROM v_entries),
    q AS (SELECT category, count(*) AS total, quantile_cont(len, 0.25) AS q1, quantile_cont(len, 0.5) AS median,
                 quantile_cont(len, 0.75) AS q3 FROM l GROUP BY category)
    SELECT category, any_value(total) AS total, any_value(q1) AS q1, any_value(median) AS median, any_value(q3) AS q3,
           min(len) FILTER (len BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low,
           max(len) FILTER (len BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high,
           count(*) FILTER (NOT len BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers
    FROM l JOIN q USING (category) GROUP BY category""",
    [v.V_ENTRIES],
)
def length_boxstats(spark, sf):
    return summaries.length_boxstats(v.entries(spark, sf), "category")


@query("timeline", "SELECT category, year, count(*) AS entries FROM v_dated GROUP BY category, year", [v.V_DATED])
def timeline(spark, sf):
    return timelines.timeline(_dated(spark, sf), "category")


def _batches(rows):
    """Three ingests of different sizes."""
    dealt = F.pmod(F.xxhash64("entry_id"), F.lit(10))
    return [rows.filter(dealt < 1), rows.filter((dealt >= 1) & (dealt < 4)), rows.filter(dealt >= 4)]


@query("rolled_timeline", "SELECT category, year, count(*) AS entries FROM v_dated GROUP BY category, year", [v.V_DATED])
def rolled_timeline(spark, sf):
    """The timeline from what three batches left of themselves."""
    parts = [rollups.year_counts(b, "category") for b in _batches(_dated(spark, sf))]
    return rollups.rolled_timeline(reduce(DataFrame.unionByName, parts), "category")


@query(
    "rolled_titles",
    "SELECT category, count(DISTINCT title) AS n_titles, true AS within_error FROM v_entries GROUP BY category",
    [v.V_ENTRIES],
)
def rolled_titles(spark, sf):
    """Distinct titles beside the estimate of three batches' sketches, which is to lie within four standard errors."""
    rows = v.entries(spark, sf)
    sketches = reduce(DataFrame.unionByName, [rollups.title_sketches(b, "category") for b in _batches(rows)])
    both = summaries.titles_per_group(rows, "category").join(
        rollups.rolled_titles(sketches, "category").withColumnRenamed("n_titles", "estimate"), "category")
    error = F.abs(F.col("estimate") - F.col("n_titles")) <= 4 * rollups.TITLE_ERROR * F.col("n_titles") + 1
    return both.select("category", "n_titles", error.alias("within_error"))


def _cells(spark, sf):
    counted = timelines.labelled_timeline(_dated(spark, sf), "category", PRIORITIES, "label")
    return counted


SQL_CELLS = f"""
v_cells AS (
  SELECT label, year, count(*) AS entries
  FROM (SELECT {v.sql_label('category', PRIORITIES)} AS label, year FROM v_dated)
  WHERE label IS NOT NULL GROUP BY label, year)"""


@query(
    "timeline_dense",
    f"""
    SELECT y.year, g.label, coalesce(c.entries, 0) AS entries
    FROM (SELECT DISTINCT label FROM v_cells WHERE year BETWEEN 1992 AND 2000) g
    CROSS JOIN (SELECT cast(unnest(range(1992, 2001)) AS integer) AS year) y
    LEFT JOIN v_cells c ON c.label = g.label AND c.year = y.year""",
    [v.V_DATED, SQL_CELLS],
)
def timeline_dense(spark, sf):
    """Entries per (group, year) with zeros; one priority has no label and drops out."""
    return shape.dense_grid(_cells(spark, sf), "label", "entries", 1992, 2000)


@query(
    "timeline_wide",
    "SELECT year, "
    + ", ".join(f"coalesce(avg(entries) FILTER (label = '{n}'), 0.0::double) AS {n}" for n in PRIORITIES.values())
    + " FROM v_cells GROUP BY year",
    [v.V_DATED, SQL_CELLS],
)
def timeline_wide(spark, sf):
    return shape.to_wide(_cells(spark, sf), "year", "label", "entries", list(PRIORITIES.values()))


def _flagged_posts(spark, sf):
    rows = v.entries(spark, sf).select("entry_id", "category", "title")
    return v.posts(spark, sf, shape.add_flags(rows, "title", v.SUBGROUPS))


SQL_SUBGROUP_TIMELINE = "v_subgroup_timeline AS (" + " UNION ALL ".join(
    f"SELECT '{name}' AS subgroup, year, count(*) AS entries FROM v_posts WHERE {v.sql_any('title', stems)} GROUP BY year"
    for name, stems in v.SUBGROUPS.items()
) + ")"


@query("subgroup_timeline", "SELECT * FROM v_subgroup_timeline", [v.V_POSTS, SQL_SUBGROUP_TIMELINE])
def subgroup_timeline(spark, sf):
    return timelines.subgroup_timeline(_flagged_posts(spark, sf), v.SUBGROUP_NAMES)


@query(
    "combined_timeline",
    f"""
    cells AS (
      SELECT {v.sql_label('category', v.LABELS)} AS label, year, count(*) AS entries FROM v_posts GROUP BY ALL
      UNION ALL SELECT {v.sql_label('subgroup', v.SUBGROUP_LABELS)}, year, entries FROM v_subgroup_timeline),
    c AS (SELECT label, year, avg(entries) AS entries FROM cells
          WHERE label IS NOT NULL AND year BETWEEN {v.FIRST} AND {v.LAST} GROUP BY label, year)
    SELECT y.year, g.label, coalesce(c.entries, 0) AS entries
    FROM (SELECT DISTINCT label FROM c) g
    CROSS JOIN (SELECT cast(unnest(range({v.FIRST}, {v.LAST + 1})) AS integer) AS year) y
    LEFT JOIN c ON c.label = g.label AND c.year = y.year""",
    [v.V_POSTS, SQL_SUBGROUP_TIMELINE],
)
def combined_timeline(spark, sf):
    """Groups and subgroups on one grid; one subgroup shares a group's label, so those cells average."""
    return timelines.side_by_side_timeline(
        _flagged_posts(spark, sf), "category", v.LABELS, v.SUBGROUP_NAMES, v.SUBGROUP_LABELS, v.FIRST, v.LAST)


@query(
    "melt_flags",
    " UNION ALL ".join(
        f"SELECT entry_id, '{name}' AS subgroup, {v.sql_any('title', stems)} AS present FROM v_entries"
        for name, stems in v.SUBGROUPS.items()
    ),
    [v.V_ENTRIES],
)
def melt_flags(spark, sf):
    rows = shape.add_flags(v.entries(spark, sf).select("entry_id", "title"), "title", v.SUBGROUPS)
    return shape.melt_flags(rows, ["entry_id"], v.SUBGROUP_NAMES, "subgroup")


SQL_TOP = """
    SELECT {group}, {item}, n, cast(rank AS integer) AS rank
    FROM (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY n DESC, {item}) AS rank
          FROM (SELECT {group}, {item}, count(*) AS n FROM {source} GROUP BY ALL)) WHERE rank <= {n}"""


@query("top_titles", SQL_TOP.format(group="category", item="title", source="v_entries", n=10), [v.V_ENTRIES])
def top_titles(spark, sf):
    return ranking.top_titles(v.entries(spark, sf), "category").orderBy("category", F.desc("n"), "title")


@query(
    "top_authors",
    "SELECT author, count(*) AS n FROM v_dated GROUP BY author ORDER BY n DESC, author LIMIT 10",
    [v.V_DATED],
)
def top_authors(spark, sf):
    return ranking.top_authors(v.dated(spark, sf))


@query(
    "author_samples",
    """
    top AS (SELECT author FROM v_dated GROUP BY author ORDER BY count(*) DESC, author LIMIT 10),
    d AS (SELECT author, entry_id, date_raw,
                 row_number() OVER (PARTITION BY author ORDER BY md5('0:' || entry_id), entry_id) AS rank
          FROM v_dated WHERE author IN (SELECT author FROM top))
    SELECT author, entry_id, date_raw AS snippet, cast(rank AS integer) AS rank FROM d WHERE rank <= 3""",
    [v.V_DATED],
)
def author_samples(spark, sf):
    rows = v.dated(spark, sf)
    drawn = ranking.author_samples(rows, ranking.top_authors(rows), F.col("entry_id"))
    return drawn.select("author", "entry_id", snippet(F.col("date_raw")).alias("snippet"), "rank")


SQL_TITLES = "v_titles AS (SELECT DISTINCT category, title, year FROM v_posts)"


def _titles(spark, sf):
    return frames.distinct_titles(v.posts(spark, sf), "category")


SQL_WORDS = f"""
v_words AS (SELECT category, regexp_extract_all(lower(title), '{v.TITLE_WORD}') AS w FROM v_titles),
v_word AS (SELECT category, unnest(w) AS word FROM v_words),
v_bigram AS (SELECT category, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS bigram FROM v_words)"""


@query("top_words", SQL_TOP.format(group="category", item="word", source="v_word", n=15),
       [v.V_POSTS, SQL_TITLES, SQL_WORDS])
def top_words(spark, sf):
    return ranking.top_words(_titles(spark, sf), "category")


@query("top_words_bounded", SQL_TOP.format(group="category", item="word", source="v_word", n=15),
       [v.V_POSTS, SQL_TITLES, SQL_WORDS])
def top_words_bounded(spark, sf):
    """The same words by summaries and a proof, with a shuffle that the number of distinct words does not bear on."""
    return ranking.top_words(_titles(spark, sf), "category", tracked=frequent.TRACKED)


@query("top_bigrams", SQL_TOP.format(group="category", item="bigram", source="v_bigram", n=10),
       [v.V_POSTS, SQL_TITLES, SQL_WORDS])
def top_bigrams(spark, sf):
    return ranking.top_bigrams(_titles(spark, sf), "category")


@query(
    "extreme_examples",
    """
    r AS (SELECT category, event_id, score,
                 row_number() OVER (PARTITION BY category ORDER BY score, event_id) AS lo,
                 row_number() OVER (PARTITION BY category ORDER BY score DESC, event_id) AS hi FROM v_events)
    SELECT category, event_id, score, 'negative' AS side, cast(lo AS integer) AS rank FROM r WHERE lo <= 20
    UNION ALL SELECT category, event_id, score, 'positive', cast(hi AS integer) FROM r WHERE hi <= 20""",
    [v.V_EVENTS],
)
def extreme_examples(spark, sf):
    rows = v.events(spark, sf).select("category", "event_id", "score")
    found = ranking.extremes(rows, "category", "score", "event_id")
    return found.select("category", "event_id", "score", "side", "rank")


@query(
    "source_overlap",
    """
    SELECT md5(content) AS key, count(*) AS n_rows, count(DISTINCT origin) AS n_sources,
           string_agg(DISTINCT origin, ',' ORDER BY origin) AS sources
    FROM v_entries GROUP BY md5(content) HAVING count(*) > 1""",
    [v.V_ENTRIES],
)
def source_overlap(spark, sf):
    found = summaries.source_overlap(v.entries(spark, sf), F.md5("content"), "origin")
    return found.withColumn("sources", F.array_join("sources", ","))


@query(
    "sentiment_distribution",
    """
    SELECT category, sentiment, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY category) AS share
    FROM v_entries e JOIN v_labels l ON e.entry_id = l.entry_id GROUP BY category, sentiment""",
    [v.V_ENTRIES, v.V_LABELS],
)
def sentiment_distribution(spark, sf):
    return summaries.distribution(_labelled(spark, sf), "category", "sentiment")


def _labelled(spark, sf):
    return v.entries(spark, sf).select("entry_id", "category").join(v.labels(spark, sf), "entry_id")


@query(
    "topic_distribution",
    """
    t AS (SELECT category, unnest(topics) AS topic FROM v_entries e JOIN v_labels l ON e.entry_id = l.entry_id)
    SELECT category, topic, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY category) AS share
    FROM t GROUP BY category, topic""",
    [v.V_ENTRIES, v.V_LABELS],
)
def topic_distribution(spark, sf):
    return summaries.topic_distribution(_labelled(spark, sf), "category")
