"""The scalar functions by name in SQL, as SQL functions that Catalyst inlines."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession

from threadlens import config
from threadlens.functions.dates import first_stamp_sql
from threadlens.functions.patterns import match_sql
from threadlens.functions.text import BLANKS, SLUG_LENGTH, SLUG_LETTERS


def register_functions(
    spark: SparkSession,
    mention_stems: Iterable = config.MENTION_STEMS,
    topics: Iterable[str] = config.TOPIC_CODES,
) -> list[str]:
    """Create ``parse_first_stamp``, ``slug``, ``clean_topics`` and ``mention_group`` for this session."""
    codes = ", ".join(f"'{t}'" for t in topics)
    whens = " ".join(
        f"WHEN {match_sql('content', stems, at_word_start=True)} THEN '{name}'"
        for name, stems in mention_stems
    )
    blanks = "".join(f"\\u{ord(b):04x}" for b in BLANKS)
    kept = f"filter(transform(topics, t -> trim(BOTH '{blanks}' FROM t)), t -> t IN ({codes}))"
    bodies = {
        "parse_first_stamp": ("raw STRING", "TIMESTAMP_NTZ", first_stamp_sql("raw")),
        "slug": ("title STRING", "STRING",
                 f"left(coalesce(nullif(trim(BOTH '_' FROM regexp_replace(title, '[^{SLUG_LETTERS}]+', '_')), ''),"
                 f" 'untitled'), {SLUG_LENGTH})"),
        "clean_topics": ("topics ARRAY<STRING>", "ARRAY<STRING>",
                         f"CASE WHEN size({kept}) > 0 THEN slice({kept}, 1, {config.MAX_TOPICS})"
                         f" ELSE array('{config.DEFAULT_TOPIC}') END"),
        "mention_group": ("content STRING", "STRING", f"CASE {whens} END"),
    }
    for name, (args, kind, body) in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    return list(bodies)
