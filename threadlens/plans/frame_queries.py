"""Title frames over groups, subgroups and years."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlens.operators import frames
from threadlens.plans import views as v
from threadlens.plans.catalog import query

SQL_FRAMED = f"""
v_titles AS (SELECT DISTINCT category, title, year FROM v_posts),
v_framed AS (SELECT *, {v.sql_flags('title', v.FRAMES)} FROM v_titles),
v_sub AS (""" + " UNION ALL ".join(
    f"SELECT *, '{name}' AS subgroup FROM v_framed WHERE {v.sql_any('title', stems)}"
    for name, stems in v.SUBGROUPS.items()
) + ")"
VIEWS = [v.V_POSTS, SQL_FRAMED]
SQL_COUNTS = ", ".join(f"count(*) FILTER ({f}) AS {f}" for f in v.FRAME_NAMES)


def _framed(spark, sf):
    return frames.frame_titles(frames.distinct_titles(v.posts(spark, sf), "category"), v.FRAMES)


def _melted(source: str, keys: str) -> str:
    return " UNION ALL ".join(f"SELECT {keys}, '{f}' AS frame FROM {source} WHERE {f}" for f in v.FRAME_NAMES)


@query("frame_counts", f"SELECT category, {SQL_COUNTS} FROM v_framed GROUP BY category", VIEWS)
def frame_counts(spark, sf):
    return frames.frame_counts(_framed(spark, sf), "category", v.FRAME_NAMES)


@query("frame_counts_subgroup", f"SELECT subgroup, {SQL_COUNTS} FROM v_sub GROUP BY subgroup", VIEWS)
def frame_counts_subgroup(spark, sf):
    return frames.frame_counts_by_subgroup(_framed(spark, sf), v.SUBGROUPS, v.FRAME_NAMES)


@query(
    "frame_counts_combined",
    f"""
    SELECT {v.sql_label('category', v.LABELS)} AS label, {SQL_COUNTS} FROM v_framed GROUP BY category
    UNION ALL
    SELECT {v.sql_label('subgroup', v.SUBGROUP_LABELS)}, {SQL_COUNTS} FROM v_sub GROUP BY subgroup""",
    VIEWS,
)
def frame_counts_combined(spark, sf):
    return frames.frame_counts_side_by_side(
        _framed(spark, sf), "category", v.LABELS, v.SUBGROUPS, v.SUBGROUP_LABELS, v.FRAME_NAMES)


SQL_TOTAL = " + ".join(v.FRAME_NAMES)


@query(
    "frame_share",
    f"""
    c AS (SELECT subgroup, {SQL_COUNTS} FROM v_sub GROUP BY subgroup)
    SELECT subgroup, {', '.join(f'{f} / nullif({SQL_TOTAL}, 0) AS {f}' for f in v.FRAME_NAMES)} FROM c""",
    VIEWS,
)
def frame_share(spark, sf):
    counts = frames.frame_counts_by_subgroup(_framed(spark, sf), v.SUBGROUPS, v.FRAME_NAMES)
    return frames.frame_shares(counts, "subgroup", v.FRAME_NAMES)


@query(
    "frame_trend",
    f"""
    m AS ({_melted('v_framed', 'category, year')})
    SELECT category, year, frame, count(*) AS n FROM m GROUP BY category, year, frame""",
    VIEWS,
)
def frame_trend(spark, sf):
    return frames.frame_trend(_framed(spark, sf), v.FRAME_NAMES, ["category"])


@query(
    "frame_trend_subset",
    f"""
    m AS ({_melted("(SELECT * FROM v_framed WHERE category = 'en')", 'year')})
    SELECT year, frame, count(*) AS n FROM m GROUP BY year, frame""",
    VIEWS,
)
def frame_trend_subset(spark, sf):
    """The trend of one group; the filter reaches the scan."""
    rows = v.posts(spark, sf).filter(F.col("category") == "en")
    framed = frames.frame_titles(frames.distinct_titles(rows, "category"), v.FRAMES)
    return frames.frame_trend(framed, v.FRAME_NAMES)


@query(
    "frame_ratio",
    f"""
    s AS (SELECT * FROM v_sub WHERE year BETWEEN {v.FIRST} AND {v.LAST}),
    m AS ({_melted('s', 'subgroup, year')}),
    t AS (SELECT subgroup, year, count(*) AS total FROM s GROUP BY subgroup, year),
    c AS (SELECT subgroup, year, frame, count(*) AS n FROM m GROUP BY subgroup, year, frame)
    SELECT subgroup, year, frame, n, total, n / total AS ratio FROM c JOIN t USING (subgroup, year)""",
    VIEWS,
)
def frame_ratio(spark, sf):
    return frames.frame_ratio(_framed(spark, sf), v.SUBGROUPS, v.FRAME_NAMES, v.FIRST, v.LAST)


@query(
    "frame_ratio_by_year",
    f"""
    m AS ({_melted('v_framed', 'year')}),
    t AS (SELECT year, count(*) AS total FROM v_framed GROUP BY year),
    c AS (SELECT year, frame, count(*) AS n FROM m GROUP BY year, frame)
    SELECT year, frame, n, total, n / total AS ratio FROM c JOIN t USING (year)""",
    VIEWS,
)
def frame_ratio_by_year(spark, sf):
    return frames.frame_ratio_by_year(_framed(spark, sf), v.FRAME_NAMES)


SQL_TITLE_FLAGS = f"v_flags AS (SELECT DISTINCT title, {v.sql_flags('title', v.SUBGROUPS)} FROM v_posts)"


@query(
    "title_subgroups",
    f"SELECT t.*, {', '.join(v.SUBGROUP_NAMES)} FROM v_titles t LEFT JOIN v_flags f ON t.title = f.title",
    [*VIEWS, SQL_TITLE_FLAGS],
)
def title_subgroups(spark, sf):
    return frames.title_subgroups(frames.distinct_titles(v.posts(spark, sf), "category"), v.SUBGROUPS)


@query(
    "title_subgroups_fanout",
    f"""
    j AS (SELECT t.category, t.title, t.year, f.* EXCLUDE (title)
          FROM v_titles t LEFT JOIN (SELECT title, {v.sql_flags('title', v.SUBGROUPS)} FROM v_posts) f
          ON t.title = f.title)
    SELECT category, title, year, {', '.join(v.SUBGROUP_NAMES)}, count(*) AS n_rows FROM j GROUP BY ALL""",
    VIEWS,
)
def title_subgroups_fanout(spark, sf):
    """The join to flags kept per entry, as row multiplicities."""
    return frames.title_subgroups_fanned(v.posts(spark, sf), v.SUBGROUPS, "category")


@query(
    "title_years",
    """
    SELECT t.title, y.year FROM (SELECT DISTINCT title FROM v_titles) t
    LEFT JOIN (SELECT DISTINCT title, year FROM v_posts) y ON t.title = y.title""",
    VIEWS,
)
def title_years(spark, sf):
    return frames.title_years(v.posts(spark, sf))


SQL_FANNED = f"""
v_fanned AS (
  SELECT t.*, {', '.join(f'f.s_{n}' for n in v.SUBGROUP_NAMES)}
  FROM v_framed t
  JOIN (SELECT title, {v.sql_flags('title', v.SUBGROUPS, 's_')} FROM v_posts) f ON t.title = f.title),
v_fanned_sub AS (
  {' UNION ALL '.join(f"SELECT '{n}' AS subgroup, * FROM v_fanned WHERE s_{n}" for n in v.SUBGROUP_NAMES)})"""


def _fanned(spark, sf):
    posts = v.posts(spark, sf)
    fanned = frames.title_subgroups_fanned(posts, v.SUBGROUPS, "category").drop(*v.SUBGROUP_NAMES)
    return frames.frame_titles(fanned, v.FRAMES)


@query(
    "frame_counts_subgroup_fanout",
    f"SELECT subgroup, {SQL_COUNTS} FROM v_fanned_sub GROUP BY subgroup",
    [*VIEWS, SQL_FANNED],
)
def frame_counts_subgroup_fanout(spark, sf):
    """Frame counts over the rows of the many-to-many join, by their multiplicities."""
    return frames.frame_counts_by_subgroup(_fanned(spark, sf), v.SUBGROUPS, v.FRAME_NAMES, weight="n_rows")


@query(
    "frame_ratio_fanout",
    f"""
    s AS (SELECT * FROM v_fanned_sub WHERE year BETWEEN {v.FIRST} AND {v.LAST}),
    m AS ({_melted('s', 'subgroup, year')}),
    t AS (SELECT subgroup, year, count(*) AS total FROM s GROUP BY subgroup, year),
    c AS (SELECT subgroup, year, frame, count(*) AS n FROM m GROUP BY subgroup, year, frame)
    SELECT subgroup, year, frame, n, total, n / total AS ratio FROM c JOIN t USING (subgroup, year)""",
    [*VIEWS, SQL_FANNED],
)
def frame_ratio_fanout(spark, sf):
    """Frame ratios over the rows of the many-to-many join."""
    return frames.frame_ratio(_fanned(spark, sf), v.SUBGROUPS, v.FRAME_NAMES, v.FIRST, v.LAST, weight="n_rows")
