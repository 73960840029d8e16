"""Annotation: batches for a labeller, its responses, and the audited merge of labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens import config
from threadlens.functions.labels import clean_topics, display_label, sentiment_code, topic_values
from threadlens.functions.text import strip_blank, strip_pair_suffix
from threadlens.operators.joins import lookup_join, number_rows

PREAMBLE = "Label every entry below. Topic codes to choose from: " + ", ".join(config.TOPIC_CODES)


def pack_batches(
    entries: DataFrame, thread: str, size: int = config.BATCH_SIZE, preamble: str = PREAMBLE, dense: bool = False
) -> DataFrame:
    """Entries of a thread in order, ``size`` per batch, with one prompt text per batch.

    Entries must be distinct by id within a thread. Ranks come from ``number_rows``, so
    the largest group held anywhere is one range of positions. With ``dense`` the caller
    vouches that ``pos`` counts usable entries from 0 without gaps; texts are then
    shuffled once, straight to their batch.
    """
    kept = entries.filter(F.col("entry_id") != "")
    ranked = kept.withColumn("rn", F.col("pos") + 1) if dense else number_rows(kept, [thread], "pos", "rn")
    batch = F.floor((F.col("rn") - 1) / size).cast("bigint").alias("batch")
    block = F.concat(
        F.lit(config.PROMPT_ID), F.col("entry_id"), F.lit("\n" + config.PROMPT_TEXT), F.col("content")
    )
    packed = F.sort_array(F.collect_list(F.struct("rn", F.col("entry_id").alias("id"), block.alias("block"))))
    return (
        ranked.select("*", batch)
        .groupBy(thread, "batch")
        .agg(packed.alias("items"))
        .select(
            thread,
            "batch",
            F.size("items").cast("bigint").alias("n_entries"),
            F.transform("items", lambda x: x["id"]).alias("entry_ids"),
            F.concat(F.lit(preamble), F.lit("\n\n"), F.array_join(F.transform("items", lambda x: x["block"]), "\n\n"))
            .alias("prompt"),
        )
    )


def _once(value: Column) -> Column:
    """``value`` as a generated column, so that the steps after it share one evaluation."""
    return F.explode(F.array(value))


def recovered_json(response: Column) -> Column:
    """The response as a variant; failing that, the text from the first ``{`` to the last ``}``."""
    inner = F.regexp_extract(response, r"(?s)\{.*\}", 0)
    return F.coalesce(F.try_parse_json(response), F.try_parse_json(inner))


def _entry_id(label: Column) -> Column:
    return strip_blank(F.coalesce(F.try_variant_get(label, "$.entry_id", "string"), F.lit("")))


def parse_responses(responses: DataFrame, response: str) -> DataFrame:
    """Add ``labels`` (array of variants) and ``status``: ok, invalid_json, no_labels or empty_labels.

    A bad response is a row with a status, never a failed job. Labels without any id count as empty.
    """
    with_id = F.exists("labels", lambda x: _entry_id(x) != "")
    labels = F.try_variant_get(F.col("_json"), "$.labels", "array<variant>")
    return (
        responses.withColumn("_json", _once(recovered_json(F.col(response))))
        .withColumn("labels", labels)
        .withColumn(
            "status",
            F.when(F.col("_json").isNull(), "invalid_json")
            .when(F.col("labels").isNull(), "no_labels")
            .when(~with_id, "empty_labels")
            .otherwise("ok"),
        )
        .drop("_json")
    )


def normalise_labels(parsed: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One clean ``(entry_id, sentiment_numeric, categories)`` row per usable label."""
    x = F.col("x")
    rows = parsed.select(*keep, F.posexplode("labels").alias("pos", "x"))
    return rows.select(
        *keep,
        "pos",
        _entry_id(x).alias("entry_id"),
        sentiment_code(F.try_variant_get(x, "$.sentiment_numeric", "variant")).alias("sentiment_numeric"),
        clean_topics(topic_values(F.try_variant_get(x, "$.categories", "variant"))).alias("categories"),
    ).filter(F.col("entry_id") != "")


def audit_ids(expected: DataFrame, returned: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ids of a batch that came back other than exactly once: missing, duplicate or unknown.

    One aggregate over both sides instead of a full outer join.
    """
    sides = expected.select(*keys, "entry_id", F.lit(1).alias("e"), F.lit(0).alias("r")).unionByName(
        returned.select(*keys, "entry_id", F.lit(0).alias("e"), F.lit(1).alias("r"))
    )
    counted = sides.groupBy(*keys, "entry_id").agg(F.max("e").alias("e"), F.sum("r").alias("r"))
    problem = (
        F.when(F.col("e") == 0, "unknown").when(F.col("r") == 0, "missing").when(F.col("r") > 1, "duplicate")
    )
    return counted.select(*keys, "entry_id", problem.alias("problem")).filter(F.col("problem").isNotNull())


def merge_labels(
    entries: DataFrame,
    latest: DataFrame,
    keys: Sequence[str] = ("entry_id",),
    spread_by: Sequence[str] | None = None,
    probe: bool = True,
) -> DataFrame:
    """Entries left-joined to their latest annotation; label fields overwrite, unmatched rows stay.

    ``latest`` is unique by ``keys``; ``merged`` tells whether an annotation was found.
    ``probe`` looks for hot keys first, which reads the key columns of ``entries`` once more.
    """
    fields = [c for c in latest.columns if c not in keys]
    right = latest.select(*keys, *[F.col(c).alias("_new_" + c) for c in fields], F.lit(True).alias("_found"))
    spread = list(spread_by or [c for c in entries.columns if c not in ("content", *keys)])
    joined = lookup_join(entries, right, keys, spread, probe=probe)
    found = F.coalesce(F.col("_found"), F.lit(False))
    overwritten = [
        (F.when(found, F.col("_new_" + c)).otherwise(F.col(c)) if c in entries.columns else F.col("_new_" + c)).alias(c)
        for c in fields
    ]
    untouched = [c for c in entries.columns if c not in fields]
    return joined.select(*untouched, *overwritten, found.alias("merged"))


def merge_audit(merged: DataFrame, by: Sequence[str]) -> DataFrame:
    """Merged and missing counts per pair; entries without an id count as neither."""
    has_id = F.col("entry_id").isNotNull()
    return merged.groupBy(*by).agg(
        F.count_if(F.col("merged")).alias("n_merged"),
        F.count_if(~F.col("merged") & has_id).alias("n_missing"),
    )


def pair_key(name: Column, folder: Column | None = None) -> Column:
    """What an annotation file and its data file share: the base name without its suffixes, below ``folder``."""
    stem = strip_pair_suffix(F.regexp_replace(name, r"\.json$", ""))
    return stem if folder is None else F.when(folder == "", stem).otherwise(F.concat(folder, F.lit("/"), stem))


def inspect_annotations(files: DataFrame, name: str, text: str, folder: str | None = None) -> DataFrame:
    """``(key, annotation_file, ann_state)`` per annotation file; narrow, the text is dropped."""
    value = F.col("_json")
    listed = F.try_variant_get(value, "$", "array<variant>")
    state = F.when(value.isNull(), "InvalidAnnotationJSON").when(listed.isNull(), "AnnotationsNotList").otherwise("ok")
    key = pair_key(F.col(name), None if folder is None else F.col(folder))
    return files.select(F.col(name).alias("_name"), key.alias("key"), _once(F.try_parse_json(F.col(text))).alias("_json")).select(
        "key", F.col("_name").alias("annotation_file"), state.alias("ann_state")
    )


def inspect_data(files: DataFrame, name: str, text: str, folder: str | None = None) -> DataFrame:
    """``(key, data_file, data_state, n_without_id)`` per data file; narrow, the text is dropped."""
    value = F.col("_json")
    root_is_list = F.try_variant_get(value, "$", "array<variant>").isNotNull()
    entries = F.try_variant_get(value, "$.entries", "variant")
    listed = F.try_variant_get(value, "$.entries", "array<variant>")
    state = (
        F.when(value.isNull(), "InvalidDataJSON")
        .when(root_is_list | (entries.isNotNull() & listed.isNull()), "EntriesNotList")
        .otherwise("ok")
    )
    without = F.size(F.filter(listed, lambda e: F.try_variant_get(e, "$.entry_id", "string").isNull()))
    stem = F.regexp_replace(F.col(name), r"\.json$", "")
    key = stem if folder is None else F.when(F.col(folder) == "", stem).otherwise(F.concat(folder, F.lit("/"), stem))
    rows = files.select(F.col(name).alias("_name"), key.alias("key"), _once(F.try_parse_json(F.col(text))).alias("_json")).select(
        "key",
        F.col("_name").alias("data_file"),
        state.alias("data_state"),
        F.when(state == "ok", F.greatest(F.coalesce(without, F.lit(0)), F.lit(0))).otherwise(0).alias("n_without_id"),
    )
    # A thread may be stored in parts: one row per file, with the state of its worst part.
    worst = F.max(F.struct((F.col("data_state") != "ok").alias("bad"), "data_state"))["data_state"]
    return rows.groupBy("key", "data_file").agg(
        worst.alias("data_state"),
        F.sum("n_without_id").alias("n_without_id"),
    ).withColumn("n_without_id", F.when(F.col("data_state") == "ok", F.col("n_without_id")).otherwise(0).cast("int"))


def annotation_elements(files: DataFrame, keep: Sequence[str], text: str) -> DataFrame:
    """``keep, pos, entry_id, sentiment_numeric, categories`` of each element of annotation lists given as text."""
    listed = F.try_variant_get(F.try_parse_json(F.col(text)), "$", "array<variant>")
    rows = files.select(*keep, F.posexplode(listed).alias("pos", "x"))
    categories = F.try_variant_get(F.col("x"), "$.categories", "variant")
    return rows.select(
        *keep, "pos",
        F.try_variant_get(F.col("x"), "$.entry_id", "string").alias("entry_id"),
        F.try_variant_get(F.col("x"), "$.sentiment_numeric", "string").alias("sentiment_numeric"),
        F.when(categories.isNotNull(), topic_values(categories)).alias("categories"),
    )


def sound_pairs(annotations: DataFrame, data: DataFrame) -> DataFrame:
    """``key`` of the pairs whose files are both usable: the only ones that a merge may touch."""
    pair = annotations.filter(F.col("ann_state") == "ok").select("key").distinct()
    return data.filter(F.col("data_state") == "ok").select("key").distinct().join(pair, "key")


def match_pairs(annotations: DataFrame, data: DataFrame) -> DataFrame:
    """Annotation files with their data file, by shared key."""
    return annotations.join(data, "key")


def unmatched(annotations: DataFrame, data: DataFrame) -> DataFrame:
    """Annotation files without a data file."""
    return annotations.join(data, "key", "left_anti")


def merge_errors(annotations: DataFrame, data: DataFrame, with_key: bool = False) -> DataFrame:
    """Error table ``(annotation_file, data_file, error_type, error_message)`` of all pairs, with their ``key`` if asked for.

    The first failing check of a pair is reported; a sound pair reports every entry
    without an id. Only file names and states are joined, no texts.
    """
    pair = annotations.join(data, "key", "left")
    missing = F.col("data_file").isNull()
    kind = (
        F.when(missing, "MissingDataFile")
        .when(F.col("ann_state") == "InvalidAnnotationJSON", F.col("ann_state"))
        .when(F.col("data_state") == "InvalidDataJSON", F.col("data_state"))
        .when(F.col("ann_state") == "AnnotationsNotList", F.col("ann_state"))
        .when(F.col("data_state") == "EntriesNotList", F.col("data_state"))
        .when(F.col("n_without_id") > 0, "MissingEntryID")
    )
    text = display_label(F.col("error_type"), config.MERGE_ERRORS)
    message = F.when(missing, F.concat(text, F.col("annotation_file"))).otherwise(text)
    copies = F.when(F.col("error_type") == "MissingEntryID", F.col("n_without_id")).otherwise(1)
    return (
        pair.withColumn("error_type", kind)
        .filter(F.col("error_type").isNotNull())
        .select(
            *["key"] * with_key,
            "annotation_file",
            F.coalesce("data_file", F.concat("key", F.lit(".json"))).alias("data_file"),
            "error_type",
            message.alias("error_message"),
            F.explode(F.array_repeat(F.lit(1), copies)).alias("_copy"),
        )
        .drop("_copy")
    )


def new_titles(titles: DataFrame, collected: DataFrame, fold_case: bool = True) -> DataFrame:
    """Titles not collected yet: first spelling per (case-folded) title, in list order by ``pos``."""
    fold = (lambda c: F.lower(c)) if fold_case else (lambda c: c)
    first = (
        titles.groupBy(fold(F.col("title")).alias("key"))
        .agg(F.min_by("title", "pos").alias("title"), F.min("pos").alias("pos"))
    )
    done = collected.select(fold(F.col("title")).alias("key")).distinct()
    return first.join(done, "key", "left_anti").drop("key")
