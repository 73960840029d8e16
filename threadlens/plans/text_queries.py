"""Dates, strings, regex flags, bins: one output row per input row."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlens.functions import dates, labels, patterns, text
from threadlens.functions.register import register_functions
from threadlens.operators.shape import add_flags
from threadlens.plans import views as v
from threadlens.plans.catalog import query


def _mixed_dates(spark, sf):
    """Stamps in every layout met: edited, bare, ISO, impossible, inside other text."""
    k = F.col("entry_id").cast("bigint") % 6
    day = F.left("date_raw", F.lit(10))
    iso = F.concat(F.substring(day, 7, 4), F.lit("-"), F.substring(day, 4, 2), F.lit("-"), F.left(day, F.lit(2)))
    raw = (
        F.when(k == 1, day)
        .when(k == 2, iso)
        .when(k == 3, F.concat(F.lit("31.02."), F.substring(day, 7, 4), F.lit(" 10:00")))
        .when(k == 4, F.concat(F.lit("xx "), F.col("date_raw"), F.lit(" yy")))
        .otherwise(F.col("date_raw"))
    )
    return v.dated(spark, sf).select("entry_id", raw.alias("date_raw"))


SQL_MIXED = """
v_mixed AS (
  SELECT entry_id, CASE k % 6 WHEN 1 THEN left(date_raw, 10)
    WHEN 2 THEN date_raw[7:10] || '-' || date_raw[4:5] || '-' || date_raw[1:2]
    WHEN 3 THEN '31.02.' || date_raw[7:10] || ' 10:00'
    WHEN 4 THEN 'xx ' || date_raw || ' yy' ELSE date_raw END AS date_raw
  FROM v_raw_dated)"""


def _date_query(name, mode, sql):
    @query(name, f"SELECT entry_id, strftime({sql}, {v.SQL_ISO}) AS date FROM v_mixed", [v.V_DATED, SQL_MIXED])
    def plan(spark, sf):
        parsed = dates.parse_stamp(F.col("date_raw"), mode)
        return _mixed_dates(spark, sf).select("entry_id", dates.iso_text(parsed).alias("date"))


_date_query(
    "parse_first_stamp",
    "first",
    r"try_strptime(regexp_extract(date_raw, '\d{2}\.\d{2}\.\d{4}\s+\d{2}:\d{2}'), '%d.%m.%Y %H:%M')",
)
_date_query(
    "parse_multi_format", "multi", "try_strptime(date_raw, ['%d.%m.%Y %H:%M', '%d.%m.%Y', '%Y-%m-%d'])"
)
_date_query("parse_strict", "strict", "try_strptime(date_raw, '%d.%m.%Y %H:%M')")


@query("date_drop_rate", """
    SELECT count(*) AS n, count(ts) AS first_kept, count(strict_ts) AS strict_kept,
           (count(*) - count(strict_ts)) / count(*) AS strict_drop_rate
    FROM (SELECT ts, try_strptime(date_raw, '%d.%m.%Y %H:%M') AS strict_ts FROM v_dated)""", [v.V_DATED])
def date_drop_rate(spark, sf):
    """What the strict parser loses: every entry that was edited."""
    raw = F.col("date_raw")
    kept = F.count(dates.strict_stamp(raw))
    return v.dated(spark, sf).agg(
        F.count("*").alias("n"),
        F.count(dates.first_stamp(raw)).alias("first_kept"),
        kept.alias("strict_kept"),
        labels.share(F.count("*") - kept, F.count("*")).alias("strict_drop_rate"),
    )


@query("year_extract", "SELECT entry_id, year FROM v_dated", [v.V_DATED])
def year_extract(spark, sf):
    return v.dated(spark, sf).select("entry_id", F.year(dates.first_stamp(F.col("date_raw"))).alias("year"))


@query("lower_key", "SELECT entry_id, lower(title) AS title_key, md5(lower(content)) AS content_md5 FROM v_entries",
       [v.V_ENTRIES])
def lower_key(spark, sf):
    return v.entries(spark, sf).select(
        "entry_id",
        text.lower_key(F.col("title")).alias("title_key"),
        F.md5(text.lower_key(F.col("content"))).alias("content_md5"),
    )


@query("char_length", "SELECT entry_id, length(content) AS n_chars FROM v_entries", [v.V_ENTRIES])
def char_length(spark, sf):
    return v.entries(spark, sf).select(
        "entry_id", text.char_length(F.col("content")).cast("bigint").alias("n_chars")
    )


@query(
    "token_count",
    f"SELECT entry_id, cast(len(regexp_extract_all(content, '{v.WORDS}')) AS bigint) AS n_tokens FROM v_entries",
    [v.V_ENTRIES],
)
def token_count(spark, sf):
    return v.entries(spark, sf).select("entry_id", text.token_count(F.col("content")).alias("n_tokens"))


SQL_TITLE_WORDS = f"regexp_extract_all(lower(title), '{v.TITLE_WORD}')"


@query(
    "title_words",
    f"""SELECT entry_id, len({SQL_TITLE_WORDS}) AS n_words, array_to_string({SQL_TITLE_WORDS}, ' ') AS words
    FROM v_entries""",
    [v.V_ENTRIES],
)
def title_words(spark, sf):
    words = text.title_words(F.col("title"))
    return v.entries(spark, sf).select(
        "entry_id", F.size(words).cast("bigint").alias("n_words"), F.array_join(words, " ").alias("words")
    )


@query(
    "title_bigrams",
    f"""
    w AS (SELECT entry_id, {SQL_TITLE_WORDS} AS w FROM v_entries),
    b AS (SELECT entry_id, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] AS b FROM w)
    SELECT entry_id, len(b) AS n_bigrams, array_to_string(b, '|') AS bigrams FROM b""",
    [v.V_ENTRIES],
)
def title_bigrams(spark, sf):
    pairs = text.bigrams(text.title_words(F.col("title")))
    return v.entries(spark, sf).select(
        "entry_id", F.size(pairs).cast("bigint").alias("n_bigrams"), F.array_join(pairs, "|").alias("bigrams")
    )


@query(
    "slug",
    """
    SELECT page_id, left(CASE WHEN s = '' THEN 'untitled' ELSE s END, 180) AS slug
    FROM (SELECT page_id, trim(regexp_replace(url, '[^a-zA-Z0-9ğüşöçıİĞÜŞÖÇ]+', '_', 'g'), '_') AS s FROM pages)""",
)
def slug(spark, sf):
    return v.table(spark, sf, "pages").select("page_id", text.slug(F.col("url")).alias("slug"))


@query(
    "strip_trailing_count",
    r"""
    SELECT page_id, regexp_replace(rtrim(line), '\s*[0-9]{1,3}(?:,[0-9]{3})*b?$', '') AS line
    FROM (SELECT page_id, url || CASE page_id % 4 WHEN 0 THEN ' 12,345b  ' WHEN 1 THEN ' 123' WHEN 2 THEN ' 1.234'
                                 ELSE '' END AS line FROM pages)""",
)
def strip_trailing_count(spark, sf):
    k = F.col("page_id") % 4
    tail = F.when(k == 0, " 12,345b  ").when(k == 1, " 123").when(k == 2, " 1.234").otherwise("")
    return v.table(spark, sf, "pages").select(
        "page_id", text.strip_trailing_count(F.concat(F.col("url"), tail)).alias("line")
    )


@query(
    "strip_suffix",
    """
    SELECT page_id, CASE WHEN page_id % 3 IN (0, 1) THEN url ELSE url || '_notes' END AS stem FROM pages""",
)
def strip_suffix(spark, sf):
    k = F.col("page_id") % 3
    tail = F.when(k == 0, "_annotations").when(k == 1, "_annotated").otherwise("_notes")
    return v.table(spark, sf, "pages").select(
        "page_id", text.strip_pair_suffix(F.concat(F.col("url"), tail)).alias("stem")
    )


@query(
    "snippet",
    """
    SELECT e.entry_id, CASE WHEN length(content) > 150 THEN left(content, 150) || '...' ELSE content END ||
           CASE WHEN len(topics) > 0 THEN ' (' || array_to_string(topics, ', ') || ')' ELSE '' END AS snippet
    FROM v_entries e LEFT JOIN v_labels l ON e.entry_id = l.entry_id""",
    [v.V_ENTRIES, v.V_LABELS],
)
def snippet(spark, sf):
    cut = v.entries(spark, sf).select("entry_id", text.snippet(F.col("content")).alias("cut"))
    rows = cut.join(v.labels(spark, sf), "entry_id", "left")
    return rows.select("entry_id", text.snippet(F.col("cut"), F.col("topics"), length=1_000).alias("snippet"))


@query("subgroup_flags", f"SELECT entry_id, {v.sql_flags('title', v.SUBGROUPS)} FROM v_entries", [v.V_ENTRIES])
def subgroup_flags(spark, sf):
    return add_flags(v.entries(spark, sf).select("entry_id", "title"), "title", v.SUBGROUPS).drop("title")


@query("frame_flags", f"SELECT entry_id, {v.sql_flags('title', v.FRAMES)} FROM v_entries", [v.V_ENTRIES])
def frame_flags(spark, sf):
    return add_flags(v.entries(spark, sf).select("entry_id", "title"), "title", v.FRAMES).drop("title")


@query("one_pass_flags", f"SELECT entry_id, {v.sql_flags('content', {**v.FRAMES, **v.CATALOGUE})} FROM v_entries", [v.V_ENTRIES])
def one_pass_flags(spark, sf):
    """All flags of whole texts from one search of the text for all stems."""
    lexicon = {**v.FRAMES, **v.CATALOGUE}
    return add_flags(v.entries(spark, sf).select("entry_id", "content"), "content", lexicon, one_pass=True).drop("content")


@query(
    "entry_title_flags",
    f"""SELECT entry_id, {v.sql_flags('content', v.FRAMES, 'entry_')}, {v.sql_flags('title', v.FRAMES, 'title_')},
               {v.sql_flags('content', v.CATALOGUE, 'group_')} FROM v_entries""",
    [v.V_ENTRIES],
)
def entry_title_flags(spark, sf):
    """Lexicon flags on whole texts and on titles, and group flags on texts."""
    rows = v.entries(spark, sf).select("entry_id", "title", "content")
    on_texts = {"entry_" + n: s for n, s in v.FRAMES.items()} | {"group_" + n: s for n, s in v.CATALOGUE.items()}
    flagged = add_flags(rows, "content", on_texts).drop("content")
    return add_flags(flagged, "title", v.FRAMES, "title_").drop("title")


@query(
    "first_match_category",
    f"SELECT entry_id, {v.sql_case('title', v.TITLE_CATEGORIES)} AS title_category FROM v_entries",
    [v.V_ENTRIES],
)
def first_match_category(spark, sf):
    return v.entries(spark, sf).select(
        "entry_id", patterns.first_match(F.col("title"), v.TITLE_CATEGORIES).alias("title_category")
    )


@query(
    "mention_group",
    f"SELECT entry_id, {v.sql_case('content', v.MENTIONS, True)} AS marker FROM v_entries",
    [v.V_ENTRIES],
)
def mention_group(spark, sf):
    marker = patterns.first_match(F.col("content"), v.MENTIONS, at_word_start=True)
    return v.entries(spark, sf).select("entry_id", marker.alias("marker"))


@query(
    "stem_catalogue",
    " UNION ALL ".join(
        f"SELECT entry_id, '{name}' AS stem_group FROM v_entries WHERE {v.sql_any('title', stems)}"
        for name, stems in v.CATALOGUE.items()
    ),
    [v.V_ENTRIES],
)
def stem_catalogue(spark, sf):
    found = patterns.all_matches(F.col("title"), v.CATALOGUE)
    return v.entries(spark, sf).select("entry_id", F.explode(found).alias("stem_group"))


@query(
    "sentiment_bins",
    """
    SELECT event_id, CASE WHEN s > -1 AND s <= -0.05 THEN 'Negative' WHEN s > -0.05 AND s <= 0.05 THEN 'Neutral'
                          WHEN s > 0.05 AND s <= 1 THEN 'Positive' END AS bin
    FROM (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN -1.0::double ELSE score / 20 - 1 END AS s FROM v_events)""",
    [v.V_EVENTS],
)
def sentiment_bins(spark, sf):
    s = F.when(F.col("event_id") % 10 == 0, F.lit(-1.0)).otherwise(F.col("score") / 20 - 1)
    return v.events(spark, sf).select("event_id", labels.sentiment_bin(s).alias("bin"))


SQL_RAW_TOPICS = """
v_raw_topics AS (
  SELECT doc_id, [CASE WHEN toxic = 1 THEN ' HATE ' ELSE '' END, CASE WHEN quality = 1 THEN 'HUMAN' ELSE 'OTHER' END,
                  CASE WHEN doc_id % 2 = 0 THEN 'ECON' ELSE 'econ' END, CASE WHEN doc_id % 3 = 0 THEN 'ECON' ELSE 'X' END,
                  CASE WHEN doc_id % 5 = 0 THEN chr(9) || 'POLICY' ELSE ' ' END] AS topics
  FROM labels)"""


def _raw_topics(spark, sf):
    k = F.col("doc_id")
    return v.table(spark, sf, "labels").select(
        "doc_id",
        F.array(
            F.when(F.col("toxic") == 1, " HATE ").otherwise(""),
            F.when(F.col("quality") == 1, "HUMAN").otherwise("OTHER"),
            F.when(k % 2 == 0, "ECON").otherwise("econ"),
            F.when(k % 3 == 0, "ECON").otherwise("X"),
            F.when(k % 5 == 0, "\tPOLICY").otherwise(" "),
        ).alias("topics"),
    )


@query(
    "clean_topics",
    r"""
    k AS (SELECT doc_id, list_filter(list_transform(topics, lambda t: regexp_replace(t, '^\s+|\s+$', '', 'g')),
                 lambda t: t IN ('HATE', 'HUMAN', 'ECON', 'POLICY')) AS kept FROM v_raw_topics)
    SELECT doc_id, CASE WHEN len(kept) = 0 THEN 'NEUTRAL' ELSE array_to_string(kept[1:3], ',') END AS topics FROM k""",
    [SQL_RAW_TOPICS],
)
def clean_topics(spark, sf):
    rows = _raw_topics(spark, sf)
    return rows.select("doc_id", F.array_join(labels.clean_topics(F.col("topics")), ",").alias("topics"))


@query(
    "sql_functions",
    rf"""
    SELECT entry_id, strftime(ts, {v.SQL_ISO}) AS date,
           left(coalesce(nullif(trim(regexp_replace(title, '[^a-zA-Z0-9ğüşöçıİĞÜŞÖÇ]+', '_', 'g'), '_'), ''),
                'untitled'), 180) AS slug,
           {v.sql_case('content', v.MENTIONS, True)} AS marker,
           coalesce(array_to_string(topics, ','), 'NEUTRAL') AS topics
    FROM v_posts""",
    [v.V_POSTS],
)
def sql_functions(spark, sf):
    """The registered SQL functions used from SQL text."""
    register_functions(spark, mention_stems=v.MENTIONS)
    return spark.sql(
        """
        SELECT entry_id, replace(cast(parse_first_stamp(date_raw) AS string), ' ', 'T') AS date,
               slug(title) AS slug, mention_group(content) AS marker,
               array_join(clean_topics(coalesce(topics, array())), ',') AS topics
        FROM {posts}""",
        posts=v.labelled_posts(spark, sf),
    )
