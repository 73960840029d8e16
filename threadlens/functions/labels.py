"""Scalars on labels and scores: topic cleaning, sentiment coding, bins, ratios, lookups."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadlens import config
from threadlens.functions.text import bind, strip_blank


def clean_topics(
    topics: Column,
    allowed: Iterable[str] = config.TOPIC_CODES,
    most: int = config.MAX_TOPICS,
    default: str = config.DEFAULT_TOPIC,
) -> Column:
    """Trim, keep allowed codes in order, the first ``most`` of them; ``[default]`` if none is left."""
    allowed = list(allowed)
    kept = F.filter(
        F.transform(F.coalesce(topics, F.array().cast("array<string>")), strip_blank),
        lambda c: c.isin(allowed),
    )
    return bind(kept, lambda k: F.when(F.size(k) > 0, F.slice(k, 1, most)).otherwise(F.array(F.lit(default))))


def topic_values(value: Column) -> Column:
    """Topics given as a variant: a list, or one value taken as a list of one."""
    as_list = F.try_variant_get(value, "$", "array<string>")
    return F.coalesce(as_list, F.array_compact(F.array(F.try_variant_get(value, "$", "string"))))


def sentiment_code(value: Column) -> Column:
    """Sentiment given as a variant: numbers are truncated, whole-number strings read.

    Anything else, and anything off the scale, becomes the neutral code.
    """
    number = F.try_variant_get(value, "$", "double")
    whole = F.try_variant_get(value, "$", "string").rlike(r"^\s*[+-]?\d+\s*$")
    usable = (F.schema_of_variant(value) != "STRING") | whole
    on_scale = (number >= config.SENTIMENT_MIN) & (number < config.SENTIMENT_MAX + 1)
    return F.when(usable & on_scale, number.cast("int")).otherwise(F.lit(config.SENTIMENT_DEFAULT))


def sentiment_bin(score: Column, band: float = config.NEUTRAL_BAND) -> Column:
    """(-1, -band] Negative, (-band, band] Neutral, (band, 1] Positive; anything else null."""
    return (
        F.when((score > -1) & (score <= -band), F.lit("Negative"))
        .when((score > -band) & (score <= band), F.lit("Neutral"))
        .when((score > band) & (score <= 1), F.lit("Positive"))
    )


def half_even(x: Column, places: int) -> Column:
    return F.bround(x, places)


def share(part: Column, total: Column) -> Column:
    """part / total, null when the total is zero."""
    return F.try_divide(part.cast("double"), total)


def display_label(key: Column, labels: Mapping[str, str]) -> Column:
    """Label of a key; null for keys without one."""
    return F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])[key]


def truthy_flag(text: Column) -> Column:
    """Boolean from a JSON leaf read as text: ``true`` or a number other than zero."""
    number = text.try_cast("double")
    return F.coalesce(F.lower(text) == "true", F.lit(False)) | F.coalesce(number != 0, F.lit(False))
