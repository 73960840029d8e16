"""Mentions, sentiment scores and the model of negativity."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlens.functions.patterns import first_match
from threadlens.operators import mentions, regression, scoring, summaries
from threadlens.operators.score_store import stored_scores
from threadlens.operators.shape import add_flags, keep_found
from threadlens.plans import views as v
from threadlens.plans.catalog import query
from threadlens.session import new_path

SQL_MARKER = v.sql_case("content", v.MENTIONS, at_word_start=True)
SQL_MARKED = f"v_marked AS (SELECT *, {SQL_MARKER} AS marker, sentiment - 3 AS signed FROM v_posts)"


def _marked(spark, sf, lexicon=None):
    """Entries with a mention, dated and labelled; texts are read before the joins and left behind."""
    rows = mentions.with_mention(v.entries(spark, sf), stems=v.MENTIONS).select("entry_id", "marker", "content")
    rows = add_flags(rows, "content", lexicon or {}).drop("content")
    return v.labelled_posts(spark, sf, rows).withColumn("signed", F.col("sentiment") - 3)


@query("mean_score_group", """
    SELECT category, round_even(avg(score), 3) AS mean_score, round_even(avg(k), 3) AS mean_k
    FROM v_events GROUP BY category""", [v.V_EVENTS])
def mean_score_group(spark, sf):
    return summaries.mean_scores(v.events(spark, sf), ["category"], ["score", "k"], 3)


@query(
    "mean_score_timeline",
    "SELECT category, year, avg(sentiment) AS mean_sentiment FROM v_posts GROUP BY category, year",
    [v.V_POSTS],
)
def mean_score_timeline(spark, sf):
    return summaries.mean_scores(v.labelled_posts(spark, sf), ["category", "year"], ["sentiment"])


SQL_TITLE_CATEGORY = v.sql_case("title", v.TITLE_CATEGORIES)
CATEGORY_NAMES = [name for name, _ in v.TITLE_CATEGORIES]


@query(
    "mention_crosstab",
    f"""
    m AS (SELECT {SQL_MARKER} AS marker, {SQL_TITLE_CATEGORY} AS c FROM v_entries)
    SELECT marker, {', '.join(f"count(*) FILTER (c = '{n}') AS {n}" for n in CATEGORY_NAMES)}
    FROM m WHERE marker IS NOT NULL AND c IS NOT NULL GROUP BY marker""",
    [v.V_ENTRIES],
)
def mention_crosstab(spark, sf):
    rows = mentions.with_mention(v.entries(spark, sf), stems=v.MENTIONS)
    sorted_titles = keep_found(rows, "title_category", first_match(F.col("title"), v.TITLE_CATEGORIES))
    return summaries.crosstab(sorted_titles, "marker", "title_category", CATEGORY_NAMES)


@query(
    "mention_descriptives",
    """
    SELECT marker, count(*) AS n, avg(signed) AS mean_sent,
           count(*) FILTER (signed < 0) / nullif(count(signed), 0) AS prop_neg,
           count(*) FILTER (signed > 0) / nullif(count(signed), 0) AS prop_pos
    FROM v_marked WHERE marker IS NOT NULL GROUP BY marker""",
    [v.V_POSTS, SQL_MARKED],
)
def mention_descriptives(spark, sf):
    return mentions.mention_descriptives(_marked(spark, sf))


@query(
    "propneg_by_year",
    """
    SELECT marker, year, count(*) FILTER (signed < 0) / nullif(count(signed), 0) AS prop_neg, count(*) AS n
    FROM v_marked WHERE marker IS NOT NULL GROUP BY marker, year""",
    [v.V_POSTS, SQL_MARKED],
)
def propneg_by_year(spark, sf):
    return mentions.negative_share_by_year(_marked(spark, sf))


@query(
    "title_creation",
    """
    t AS (SELECT category, title, min(ts) AS first, avg(sentiment) AS s FROM v_posts GROUP BY category, title)
    SELECT category, cast(year(first) AS integer) AS year_created, count(*) AS n_titles,
           round(avg(s), 6) AS mean_title_sent
    FROM t GROUP BY category, year(first)""",
    [v.V_POSTS],
)
def title_creation(spark, sf):
    table = mentions.title_creation(v.labelled_posts(spark, sf), "category", "sentiment")
    return table.withColumn("mean_title_sent", F.round("mean_title_sent", 6))


@query(
    "sentiment_timeline",
    " UNION ALL ".join(
        f"""SELECT '{name}' AS "group", year, avg(sentiment) AS mean_sent, count(*) AS n
        FROM v_posts WHERE {v.sql_any('content', stems)} GROUP BY year"""
        for name, stems in v.CATALOGUE.items()
    ),
    [v.V_POSTS],
)
def sentiment_timeline(spark, sf):
    flags = add_flags(v.entries(spark, sf).select("entry_id", "content"), "content", v.CATALOGUE)
    flagged = v.labelled_posts(spark, sf, flags.drop("content"))
    return mentions.sentiment_timeline(flagged, list(v.CATALOGUE), "sentiment")


SQL_VALENCE = ", ".join(f"('{w}', {x}::double)" for w, x in v.VALENCE.items())


@query(
    "lexicon_sentiment",
    rf"""
    lex(word, valence) AS (VALUES {SQL_VALENCE}),
    w AS (SELECT entry_id, unnest(regexp_extract_all(lower(content), '{v.WORDS}')) AS word FROM v_entries),
    s AS (SELECT entry_id, sum(valence) AS s FROM w JOIN lex USING (word) GROUP BY entry_id)
    SELECT e.entry_id, round(coalesce(s / sqrt(s * s + 15), 0), 6) AS compound
    FROM v_entries e LEFT JOIN s ON e.entry_id = s.entry_id""",
    [v.V_ENTRIES],
)
def lexicon_sentiment(spark, sf):
    scored = scoring.lexicon_scores(v.entries(spark, sf), ["entry_id"], v.VALENCE)
    return scored.withColumn("compound", F.round("compound", 6))


# Frequent words of the invented texts stand in for boosters, negations and contrasts.
CONTEXT = scoring.ContextRules(
    boosters={"is": 0.293, "en": 0.293, "die": 0.293, "was": -0.293, "de": -0.293},
    negations=frozenset({"to", "den", "des"}), contrasts=frozenset({"that", "das", "pas"}))


def _context_values() -> str:
    words = sorted({*v.VALENCE, *CONTEXT.boosters, *CONTEXT.negations, *CONTEXT.contrasts})
    cell = lambda x: "NULL" if x is None else str(x)
    return ", ".join(
        f"('{w}', {cell(v.VALENCE.get(w))}::double, {cell(CONTEXT.boosters.get(w))}::double, "
        f"{w in CONTEXT.negations}, {w in CONTEXT.contrasts})" for w in words)


@query(
    "context_sentiment",
    rf"""
    lex(word, v, b, n, c) AS (VALUES {_context_values()}),
    words AS (SELECT entry_id, content, regexp_extract_all(content, '{v.WORDS}') AS l FROM v_entries),
    tok AS (SELECT entry_id, content, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM words),
    hit AS (SELECT t.*, x.* FROM tok t JOIN lex x ON lower(t.w) = x.word),
    turn AS (SELECT entry_id, min(i) AS place FROM hit WHERE c GROUP BY entry_id),
    s0 AS (
      SELECT h.entry_id, h.i, h.v + CASE WHEN upper(h.w) = h.w AND lower(h.w) <> h.w AND upper(h.content) <> h.content
                                    THEN sign(h.v) * 0.733 ELSE 0 END AS s,
             p.b AS b1, p.n AS n1, q.b AS b2, q.n AS n2, r.b AS b3, r.n AS n3
      FROM hit h
      LEFT JOIN hit p ON p.entry_id = h.entry_id AND p.i = h.i - 1 AND p.v IS NULL
      LEFT JOIN hit q ON q.entry_id = h.entry_id AND q.i = h.i - 2 AND q.v IS NULL
      LEFT JOIN hit r ON r.entry_id = h.entry_id AND r.i = h.i - 3 AND r.v IS NULL
      WHERE h.v IS NOT NULL),
    s1 AS (SELECT *, (s + sign(s) * coalesce(b1, 0)) * CASE WHEN n1 THEN -0.74 ELSE 1 END AS t1 FROM s0),
    s2 AS (SELECT *, (t1 + sign(t1) * coalesce(b2, 0) * 0.95) * CASE WHEN n2 THEN -0.74 ELSE 1 END AS t2 FROM s1),
    s3 AS (SELECT *, (t2 + sign(t2) * coalesce(b3, 0) * 0.9) * CASE WHEN n3 THEN -0.74 ELSE 1 END AS t3 FROM s2),
    total AS (
      SELECT s.entry_id, sum(t3 * CASE WHEN place IS NULL THEN 1 WHEN s.i <= place THEN 0.5 ELSE 1.5 END) AS x
      FROM s3 s LEFT JOIN turn t ON t.entry_id = s.entry_id GROUP BY s.entry_id),
    marks AS (
      SELECT entry_id, least(length(content) - length(replace(content, '!', '')), 4) * 0.292 AS cried,
             length(content) - length(replace(content, '?', '')) AS asked FROM v_entries),
    strong AS (
      SELECT m.entry_id, x + sign(x) * (cried + CASE WHEN asked > 3 THEN 0.96 WHEN asked > 1 THEN asked * 0.18 ELSE 0 END) AS y
      FROM marks m JOIN total t ON t.entry_id = m.entry_id)
    SELECT e.entry_id, round(coalesce(y / sqrt(y * y + 15), 0), 6) + 0 AS compound
    FROM v_entries e LEFT JOIN strong s ON s.entry_id = e.entry_id""",
    [v.V_ENTRIES],
)
def context_sentiment(spark, sf):
    """Lexicon words read in their context: boosters, negations, contrasts, capitals and marks."""
    scored = scoring.with_context_score(v.entries(spark, sf).select("entry_id", "content"), v.VALENCE, CONTEXT)
    return scored.select("entry_id", (F.round("compound", 6) + F.lit(0.0)).alias("compound"))  # no minus zero


def load_vowel_scorer():
    """Deterministic stand-in for a model: weighs ``e`` against ``a``; fails on texts with neither."""

    def score(texts):
        out = []
        for t in texts:
            e, a = t.count("e"), t.count("a")
            out.append(("negative" if a > e else "positive", abs(e - a) / (e + a)))
        return out

    return score


def load_length_scorer():
    def score(texts):
        return [("positive" if len(t) % 2 else "negative", len(t) / 512) for t in texts]

    return score


def load_absent_scorer():
    raise OSError("model is not available here")


SQL_COUNTED = """
v_counted AS (SELECT entry_id, category, length(t) AS n, length(t) - length(replace(t, 'e', '')) AS e,
                     length(t) - length(replace(t, 'a', '')) AS a
              FROM (SELECT entry_id, category, left(content, 512) AS t FROM v_entries))"""


@query(
    "model_score",
    """
    SELECT entry_id, CASE WHEN e + a = 0 THEN NULL WHEN a > e THEN 'negative' ELSE 'positive' END AS model_label,
           abs(e - a) / nullif(e + a, 0) AS model_score
    FROM v_counted""",
    [v.V_ENTRIES, SQL_COUNTED],
)
def model_score(spark, sf):
    rows = v.entries(spark, sf).select("entry_id", "content")
    scored = scoring.model_scores(rows, load_vowel_scorer, max_chars=scoring.MODEL_TEXT_LENGTH)
    return scored.drop("content", "model_status")


@query(
    "stored_model_score",
    """
    SELECT entry_id, CASE WHEN e + a = 0 THEN NULL WHEN a > e THEN 'negative' ELSE 'positive' END AS model_label,
           abs(e - a) / nullif(e + a, 0) AS model_score
    FROM v_counted""",
    [v.V_ENTRIES, SQL_COUNTED],
)
def stored_model_score(spark, sf):
    """Scores by way of the store: one category is scored first, then all of them, of which it is known already."""
    store = new_path(spark, "scores")
    rows = v.entries(spark, sf).select("entry_id", "category", "content")
    options = {"load": load_vowel_scorer, "store": store, "version": "vowels-1", "max_chars": scoring.MODEL_TEXT_LENGTH}
    stored_scores(rows.filter("category = 'en'"), **options)
    return stored_scores(rows, **options).drop("content", "category")


@query(
    "multi_model_score",
    """
    SELECT entry_id, CASE WHEN e + a = 0 THEN NULL WHEN a > e THEN 'negative' ELSE 'positive' END AS vowels_label,
           abs(e - a) / nullif(e + a, 0) AS vowels_score,
           CASE WHEN n % 2 = 1 THEN 'positive' ELSE 'negative' END AS length_label, n / 512 AS length_score
    FROM v_counted""",
    [v.V_ENTRIES, SQL_COUNTED],
)
def multi_model_score(spark, sf):
    """Two stand-in models side by side; a third cannot be loaded and has no scores."""
    rows = v.entries(spark, sf).select("entry_id", "content")
    loaders = {"vowels": load_vowel_scorer, "absent": load_absent_scorer, "length": load_length_scorer}
    scored = scoring.multi_model_scores(rows, loaders, max_chars=scoring.MODEL_TEXT_LENGTH)
    return scored.select("entry_id", "vowels_label", "vowels_score", "length_label", "length_score")


LOGIT_LEXICON = {"entry_verbal": v.FRAMES["verbal"], "entry_german": v.FRAMES["german"]}
LOGIT_FLAGS = ["is_ther", *LOGIT_LEXICON]


def coded_mentions(spark, sf):
    """Labelled mentions with what the model of negativity needs: the outcome, the year and three flags."""
    rows = _marked(spark, sf, LOGIT_LEXICON).filter(F.col("sentiment").isNotNull())
    return rows.select(
        (F.col("signed") < 0).cast("int").alias("negative"),
        "year",
        (F.col("marker") == "ther").cast("int").alias("is_ther"),
        *[F.col(name).cast("int").alias(name) for name in LOGIT_LEXICON],
    )


@query("negativity_logit")
def negativity_logit(spark, sf):
    """Negativity of labelled mentions on marker, centred year and two lexicon flags."""
    return regression.negativity_logit(coded_mentions(spark, sf), "negative", LOGIT_FLAGS)


SQL_CODED = ", ".join(
    f"CAST({v.sql_any('content', stems)} AS INT) AS {name}" for name, stems in LOGIT_LEXICON.items())
SQL_TERMS = " UNION ALL ".join(
    f"SELECT '{t}' AS term, sum({x} * negative) AS observed, min({x}) < max({x}) OR '{t}' = 'intercept' AS varies FROM c"
    for t, x in [*((f, f) for f in LOGIT_FLAGS), ("year_c", "year_c"), ("intercept", "1")])


@query(
    "negativity_logit_balance",
    f"""
    r AS (SELECT CAST(signed < 0 AS INT) AS negative, year, CAST(marker = 'ther' AS INT) AS is_ther, {SQL_CODED}
          FROM v_marked WHERE marker IS NOT NULL AND sentiment IS NOT NULL AND year IS NOT NULL),
    c AS (SELECT *, year - (SELECT avg(year) FROM r) AS year_c FROM r),
    t AS ({SQL_TERMS})
    SELECT term, round(observed, 4) AS observed, round(observed, 4) AS fitted FROM t WHERE varies""",
    [v.V_POSTS, SQL_MARKED],
)
def negativity_logit_balance(spark, sf):
    """The score equations of ``negativity_logit``: at the estimates, and nowhere else, fitted sums are the observed ones."""
    balance = regression.score_balance(coded_mentions(spark, sf), "negative", LOGIT_FLAGS)
    return balance.select("term", *[F.round(c, 4).alias(c) for c in ("observed", "fitted")])


SQL_ODDS = f"""
v_odds AS (
  SELECT count(*) FILTER (y AND x) AS a, count(*) FILTER (NOT y AND x) AS b,
         count(*) FILTER (y AND NOT x) AS c, count(*) FILTER (NOT y AND NOT x) AS d
  FROM (SELECT score < 50 AS y, k % 2 = 0 AS x FROM v_events WHERE score IS NOT NULL AND k IS NOT NULL))"""


@query(
    "logit_one_flag",
    """
    t AS (
      SELECT 'even' AS term, ln(a * d / (b * c)) AS e, sqrt(1 / a + 1 / b + 1 / c + 1 / d) AS s FROM v_odds
      UNION ALL SELECT 'intercept', ln(c / d), sqrt(1 / c + 1 / d) FROM v_odds)
    SELECT term, round(e, 5) AS estimate, round(e - 1.96 * s, 5) AS conf_low, round(e + 1.96 * s, 5) AS conf_high FROM t""",
    [v.V_EVENTS, SQL_ODDS],
)
def logit_one_flag(spark, sf):
    """The regression on one flag alone, whose estimates and errors have a closed form: log odds and their ratio."""
    rows = v.events(spark, sf).filter("score IS NOT NULL AND k IS NOT NULL").select(
        (F.col("score") < 50).cast("int").alias("low"), (F.col("k") % 2 == 0).cast("int").alias("even"),
        F.lit(2000).alias("year"))
    fit = regression.negativity_logit(rows, "low", ["even"])
    return fit.select("term", *[F.round(c, 5).alias(c) for c in ("estimate", "conf_low", "conf_high")])
