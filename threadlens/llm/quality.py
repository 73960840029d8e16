"""Quality rules whose limits follow the data, with DataFrame functions alone.

Each text is measured once. Measures of the texts that pass the fixed base rules go into KLL
sketches per language and source, and sketches merge: those of a language's sources into
the language's, those into that of all rows. A group's limits come from its own sketch if
it has seen at least ``min_group`` texts, else from its language's, else from that of all.
A limit lies ``reach`` times the distance between the quartiles beyond the outer one, so that
junk moves it only where it is a quarter of a group. It keeps a least distance from the
median, so that a group of like texts does not reject its ordinary members. Limits are
rounded outwards, for sketches differ a little between runs. They are joined back by group:
a few numbers for each pair of language and source. ``rejections`` counts what each rule rejects.

A null or empty text has no words and fails the base rules. Rows with null language or
source form groups of their own. Each row counts, also where ids repeat. Columns of the
input stay as they are, but for those named like a measure, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.llm.blocks import renamed
from threadlens.session import materialise

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS, MAX_REPEAT = 20, 30
SKETCH_K = 400
MIN_GROUP = 200
REACH = 3.0
STEP = 0.05  # limits are rounded outwards to a multiple
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
# measure, side, least distance of the limit from the median
RULES = (
    ("mean_word", "low", 2.0),
    ("mean_word", "high", 2.0),
    ("symbol_share", "high", 0.15),
    ("dup_line_share", "high", 0.4),
)
MEASURES = ("mean_word", "symbol_share", "dup_line_share")


def one(column: Column) -> Column:
    """A generator of one row, which keeps Spark from computing ``column`` anew for each use."""
    return F.explode(F.array(column))


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the counts of each text, and its number of lines with a word."""
    kept = [c for c in docs.columns if c not in (*COUNTS, "_used")]
    rows = renamed(docs.select(*kept))
    own = rows.columns
    t = F.coalesce(F.col(own[kept.index(text_col)]), F.lit(""))
    words = F.filter(F.split(F.translate(t, SPACE, " " * len(SPACE)), " ", -1), lambda w: w != "")
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    rows = rows.select(
        *own,
        F.length(F.translate(t, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        one(lines).alias("_l"),
    ).select(
        *own, "word_chars", "n_symbols", F.size("_l").cast("long").alias("_used"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        one(words).alias("_w"),
    )
    # A hash for each window of words. A text whose hashes all differ repeats no window.
    places = F.sequence(F.lit(1), F.size("_w") - (WINDOW - 1))
    windows = F.when(
        F.size("_w") > WINDOW, F.transform(places, lambda i: F.xxhash64(F.slice("_w", i, WINDOW))))
    rows = rows.select(
        *[c for c in rows.columns if c != "_w"], F.size("_w").cast("long").alias("n_words"), one(windows).alias("_h"))
    ranked = F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    ranked = F.when(F.size(F.array_distinct("_h")) < F.size("_h"), ranked)
    rows = rows.select(*[c for c in rows.columns if c != "_h"], one(ranked).alias("_s"))
    like = lambda x, k: F.coalesce(F.get("_s", k)["h"] == x["h"], F.lit(False))
    again = F.transform(F.filter("_s", lambda x, k: like(x, k - 1) | like(x, k + 1)), lambda x: x["i"])
    rows = rows.select(*[c for c in rows.columns if c != "_s"], one(F.array_sort(again)).alias("_p"))
    covered = F.aggregate(
        "_p", F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("at")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["at"])).alias("n"), i.alias("at")),
        lambda a: a["n"],
    )
    return rows.select(
        *[F.col(k).alias(c) for c, k in zip(kept, own)], "_used", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def base_failed(min_words: int = MIN_WORDS, max_repeat: int = MAX_REPEAT) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))


def shares() -> dict[str, Column]:
    def over(a: str, b: str) -> Column:
        return F.col(a) / F.greatest(F.col(b), F.lit(1)).cast("double")

    return {
        "mean_word": over("word_chars", "n_words"),
        "symbol_share": over("n_symbols", "word_chars"),
        "dup_line_share": over("n_dup_lines", "_used"),
    }


def limits(sound: DataFrame, lang: str, source: str, min_group: int, reach: float, k: int) -> DataFrame:
    """The limits of each pair of ``lang`` and ``source`` in ``sound``, by merged sketches."""
    groups = sound.select(F.col(lang).alias("_lang"), F.col(source).alias("_source"), *[
        c.alias(m) for m, c in shares().items()
    ]).groupBy("_lang", "_source").agg(
        F.count("*").alias("_n"), *[F.kll_sketch_agg_double(m, k).alias(m) for m in MEASURES])

    def merged(frame: DataFrame, by: list[str]) -> DataFrame:
        return frame.groupBy(*by).agg(
            F.sum("_n").alias("_n"), *[F.kll_merge_agg_double(m, k).alias(m) for m in MEASURES])

    def lines(frame: DataFrame, by: list[str], tag: str) -> DataFrame:
        out = []
        for i, (m, side, least) in enumerate(RULES):
            # An empty sketch has no quantiles.
            low, mid, high = (F.when(F.col("_n") > 0, F.kll_sketch_get_quantile_double(F.col(m), F.lit(x)))
                              for x in (0.25, 0.5, 0.75))
            far = reach * (high - low)
            limit = (F.ceil(F.greatest(high + far, mid + least) / STEP) * STEP if side == "high"
                     else F.floor(F.least(low - far, mid - least) / STEP) * STEP)
            out.append(F.when(F.col("_n") > 0, limit).alias(f"{tag}{i}"))
        return frame.select(*by, F.col("_n").alias(f"{tag}n"), *out)

    languages = merged(groups, ["_lang"])
    per_language = lines(languages, ["_lang"], "l").withColumnRenamed("_lang", "_of")
    own = lines(groups, ["_lang", "_source"], "g")
    joined = own.join(per_language, F.col("_lang").eqNullSafe(F.col("_of"))).drop("_of")
    every = lines(merged(languages, []), [], "a").first()  # one row, whatever the input
    picked = [
        F.when(F.col("gn") >= min_group, F.col(f"g{i}")).when(F.col("ln") >= min_group, F.col(f"l{i}"))
        .otherwise(F.lit(every[f"a{i}"]).cast("double")).alias(f"_limit{i}")
        for i in range(len(RULES))
    ]
    return joined.select("_lang", "_source", *picked)


def failed() -> list[Column]:
    """For each of ``RULES``, whether a row with its limits fails it."""
    out = []
    for i, (m, side, _) in enumerate(RULES):
        limit = F.col(f"_limit{i}")
        out.append(F.coalesce(shares()[m] > limit if side == "high" else shares()[m] < limit, F.lit(False)))
    return out


def with_limits(
    docs: DataFrame, text_col: str = "text", lang: str = "lang", source: str = "source",
    min_words: int = MIN_WORDS, max_repeat: int = MAX_REPEAT, min_group: int = MIN_GROUP, reach: float = REACH,
    sketch_k: int = SKETCH_K, keep_text: bool = True,
) -> DataFrame:
    """``docs`` with the counts, ``base_failed`` and the limits of each row's group.

    The measured rows are written to the shared folder once, so that sketches and verdicts
    come from one reading of the texts.
    """
    rows = measure(docs, text_col).withColumn("base_failed", base_failed(min_words, max_repeat))
    rows = materialise(rows if keep_text else rows.drop(text_col), "measured")
    found = limits(rows.filter(~F.col("base_failed")), lang, source, min_group, reach, sketch_k)
    same = F.col(lang).eqNullSafe(F.col("_lang")) & F.col(source).eqNullSafe(F.col("_source"))
    return rows.join(found, same, "left").drop("_lang", "_source")


def judge(docs: DataFrame, *args, **options) -> DataFrame:
    """``docs`` with the counts, ``base_failed`` and ``kept``, by the parameters of ``with_limits``."""
    fails = F.lit(False)
    for one_failed in failed():
        fails = fails | one_failed
    judged = with_limits(docs, *args, **options).withColumn("kept", ~F.col("base_failed") & ~fails)
    return judged.drop("_used", *[f"_limit{i}" for i in range(len(RULES))])


def rejections(docs: DataFrame, by: str, **options) -> DataFrame:
    """Per value of the column ``by``: rows, those the base rules reject, those each limit rejects beyond these, and kept ones."""
    base, flags = F.col("base_failed"), failed()
    beyond = [F.count_if(~base & f).alias(f"{m}_{side}") for f, (m, side, _) in zip(flags, RULES)]
    whole = ~base
    for f in flags:
        whole = whole & ~f
    return with_limits(docs, keep_text=False, **options).groupBy(by).agg(
        F.count("*").alias("n"), F.count_if(base).alias("base"), *beyond, F.count_if(whole).alias("kept"))
