"""Sentiment scores: words of a lexicon, alone or in their context, and models given by the caller."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.functions.lookup import word_table
from threadlens.functions.text import tokens

# Normalisation constant of the compound score, text length given to models.
ALPHA = 15.0
MODEL_TEXT_LENGTH = 512
# Fixed values of the published context rules: what capitals add, what a negation makes of a valence, how boosters fade with
# their distance, the weights before and after a contrast, and what marks add.
LOUD, NEGATED = 0.733, -0.74
DISTANCE_WEIGHTS = (1.0, 0.95, 0.9)
CONTRAST_WEIGHTS = (0.5, 1.5)
EXCLAMATION, EXCLAMATIONS = 0.292, 4
QUESTION, QUESTIONS, QUESTIONED = 0.18, 3, 0.96
MODEL_BATCH = 32

# A scorer is built once per task by a loader and maps a list of texts to
# ``(label, score)`` pairs.
Scorer = Callable[[Sequence[str]], Sequence[tuple[str, float]]]
Loader = Callable[[], Scorer]


def with_lexicon_score(entries: DataFrame, valence: Mapping[str, float], out: str = "compound") -> DataFrame:
    """Adds the compound score in [-1, 1]: summed valences of the text's words, normalised; 0 without a hit.

    Each word is looked up in a hash table that is part of the plan, so the score is made in
    place: no row per word, no join, no shuffle.
    """
    look = word_table({w: {"v": float(x)} for w, x in valence.items()}, "v: double")
    total = F.aggregate(tokens(F.lower("content")), F.lit(0.0), lambda s, w: s + F.coalesce(look(w)["v"], F.lit(0.0)))
    staged = entries.withColumn("_s", F.explode(F.array(F.coalesce(total, F.lit(0.0)))))
    return staged.withColumn(out, compound(F.col("_s"))).drop("_s")


def compound(total: Column) -> Column:
    """A sum of valences brought into [-1, 1]."""
    return total / F.sqrt(total * total + ALPHA)


@dataclass(frozen=True)
class ContextRules:
    """Words that change the valence of words near them; all lower-cased."""

    boosters: Mapping[str, float]  # what a booster adds to the strength of a valence word after it; negative dampens
    negations: frozenset[str]
    contrasts: frozenset[str]  # what comes after the first of these weighs more, what comes before it less


def _context_table(valence: Mapping[str, float], rules: ContextRules):
    words: dict[str, dict] = {}
    for word, x in valence.items():
        words.setdefault(word, {})["v"] = float(x)
    for word, x in rules.boosters.items():
        words.setdefault(word, {})["b"] = float(x)
    for word in rules.negations:
        words.setdefault(word, {})["n"] = True
    for word in rules.contrasts:
        words.setdefault(word, {})["c"] = True
    return word_table(words, "v: double, b: double, n: boolean, c: boolean")


def with_context_score(
    entries: DataFrame, valence: Mapping[str, float], rules: ContextRules, out: str = "compound", text: str = "content"
) -> DataFrame:
    """Adds the compound score of a text whose valence words are read in their context.

    Of the three words before a valence word, from the nearest on, a booster adds to its strength (less
    from further away) and a negation turns it round; words with a valence of their own do neither.
    A word in capitals among others counts for more. Past the first contrast valences weigh more, before it
    less. Exclamation marks, and several question marks, strengthen the sum. A row is scored in one pass over
    its words and one over those of the table; null texts and texts without a valence word score 0.
    """
    look = _context_table(valence, rules)
    whole = F.coalesce(F.col(text), F.lit(""))
    found = F.filter(
        F.transform(tokens(F.col(text)), lambda w, i: F.struct(i.alias("i"), w.alias("w"), look(F.lower(w)).alias("m"))),
        lambda x: x["m"].isNotNull())
    lone = F.struct(*[F.lit(None).cast(t).alias(n) for n, t in (("i", "int"), ("v", "double"), ("b", "double"), ("n", "boolean"))])
    state = "struct<before: double, after: double, seen: boolean, last: array<struct<i: int, v: double, b: double, n: boolean>>>"
    start = F.struct(F.lit(0.0).alias("before"), F.lit(0.0).alias("after"), F.lit(False).alias("seen"),
                     F.filter(F.array(lone), lambda x: x["i"].isNotNull()).alias("last")).cast(state)

    def in_context(x: Column, last: Column) -> Column:
        v = x["m"]["v"]
        loud = (F.upper(x["w"]) == x["w"]) & (F.lower(x["w"]) != x["w"]) & (F.upper(whole) != whole)
        own = v + F.when(loud, F.signum(v) * LOUD).otherwise(F.lit(0.0))
        fades = F.array(*[F.lit(d) for d in DISTANCE_WEIGHTS])

        def touched(s: Column, p: Column) -> Column:
            distance = x["i"] - p["i"]
            boosted = s + F.signum(s) * F.coalesce(p["b"], F.lit(0.0)) * F.get(fades, distance - 1)
            turned = boosted * F.when(p["n"], F.lit(NEGATED)).otherwise(F.lit(1.0))
            return F.when((distance <= len(DISTANCE_WEIGHTS)) & p["v"].isNull(), turned).otherwise(s)

        return F.when(v.isNull(), F.lit(0.0)).otherwise(F.aggregate(last, own, touched))

    def step(a: Column, x: Column) -> Column:
        score = in_context(x, a["last"])
        here = F.struct(x["i"].alias("i"), x["m"]["v"].alias("v"), x["m"]["b"].alias("b"), x["m"]["n"].alias("n"))
        return F.struct(
            F.when(a["seen"], a["before"]).otherwise(a["before"] + score).alias("before"),
            F.when(a["seen"], a["after"] + score).otherwise(a["after"]).alias("after"),
            (a["seen"] | F.coalesce(x["m"]["c"], F.lit(False))).alias("seen"),
            F.slice(F.concat(F.array(here), a["last"]), 1, len(DISTANCE_WEIGHTS)).alias("last")).cast(state)

    before, after = CONTRAST_WEIGHTS
    total = F.aggregate(found, start, step, lambda a: F.when(
        a["seen"], a["before"] * before + a["after"] * after).otherwise(a["before"]))
    many = lambda mark: F.length(whole) - F.length(F.replace(whole, F.lit(mark), F.lit("")))
    asked = F.when(many("?") > QUESTIONS, F.lit(QUESTIONED)).when(many("?") > 1, many("?") * QUESTION).otherwise(F.lit(0.0))
    force = F.least(many("!"), F.lit(EXCLAMATIONS)) * EXCLAMATION + asked
    staged = entries.withColumn("_s", F.explode(F.array(total)))
    strong = F.col("_s") + F.signum("_s") * force
    return staged.withColumn("_s", F.when(F.col("_s") == 0, F.lit(0.0)).otherwise(strong)).withColumn(
        out, compound(F.col("_s"))).drop("_s")


def lexicon_scores(entries: DataFrame, keys: Sequence[str], valence: Mapping[str, float]) -> DataFrame:
    """``keys`` and the compound score of each row."""
    return with_lexicon_score(entries.select(*keys, "content"), valence).select(*keys, "compound")


def _score_batch(scorer: Scorer, texts: list[str]) -> list[tuple[str | None, float | None]]:
    """Scores of a batch; if it fails, of each text alone, with nulls where that fails too."""
    try:
        return list(scorer(texts))
    except Exception:
        if len(texts) == 1:
            return [(None, None)]
        return [_score_batch(scorer, [t])[0] for t in texts]


def model_scores(
    entries: DataFrame, load: Loader, text: str = "content", prefix: str = "model", tasks: int | None = None,
    max_chars: int | None = None,
) -> DataFrame:
    """Add ``<prefix>_label``, ``<prefix>_score`` and ``<prefix>_status``; the model is loaded once per task.

    A model that cannot be loaded where a task runs gives null scores and the error as the
    status of its rows, not a failed job. ``max_chars`` cuts texts to what a model reads
    before they leave the JVM. ``tasks`` spreads the rows evenly first, where one input file
    holds much of the work.
    """

    @F.pandas_udf("label string, score double, status string")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer, status = None, None
        for batch in batches:
            if status is None:  # a task without rows loads no model
                try:
                    scorer, status = load(), "ok"
                except Exception as error:
                    scorer, status = None, f"{type(error).__name__}: {error}"
            values = batch.tolist()
            out: list[tuple[str | None, float | None]] = []
            for i in range(0, len(values), MODEL_BATCH):
                part = values[i : i + MODEL_BATCH]
                out.extend([(None, None)] * len(part) if scorer is None else _score_batch(scorer, part))
            yield pd.DataFrame([(*pair, status) for pair in out], columns=["label", "score", "status"])

    rows = entries.repartition(tasks) if tasks else entries
    whole = F.coalesce(F.col(text), F.lit(""))
    scored = rows.withColumn("_s", score(whole if max_chars is None else F.left(whole, F.lit(max_chars))))
    return scored.withColumns({f"{prefix}_{f}": F.col(f"_s.{f}") for f in ("label", "score", "status")}).drop("_s")


def multi_model_scores(
    entries: DataFrame, loaders: Mapping[str, Loader], text: str = "content", max_chars: int | None = None
) -> DataFrame:
    """Scores and status of every model, side by side."""
    scored = entries
    for name, load in loaders.items():
        scored = model_scores(scored, load, text, prefix=name, max_chars=max_chars)
    return scored


def model_status(scored: DataFrame, names: Sequence[str]) -> DataFrame:
    """``model, status, n``: how many rows each model scored, or why it did not."""
    return scored.select(*[F.col(f"{n}_status").alias(n) for n in names]).unpivot(
        [], list(names), "model", "status").groupBy("model", "status").agg(F.count("*").alias("n"))
