"""Whole analyses over a corpus folder: each returns its result tables by name, all lazy.

These are the entry points for a user with thread files on disk. The typed table is
meant to be written once (``sinks.tables.write_typed``) and the analyses run on it.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens import config
from threadlens.functions.labels import display_label, sentiment_bin
from threadlens.functions.patterns import first_match
from threadlens.functions.text import blank_to_null, snippet, thousands
from threadlens.operators import frames, labels, mentions, ranking, scoring, shape, summaries, timelines
from threadlens.session import materialise
from threadlens.sinks.files import write_thread_files
from threadlens.sinks.threads import PART_SIZE, entry_fields, nest_entries, thread_info, thread_json
from threadlens.sources import threads as th
from threadlens.sources.annotations import latest_annotations
from threadlens.sources.titles import read_title_lists

Tables = dict[str, DataFrame]


def typed_tables(spark: SparkSession, root: str, sources: Sequence = config.SOURCES) -> Tables:
    """The typed entry table of all configured sources, before export, and the threads that could not be read."""
    entries, unreadable = th.read_corpus(spark, root, sources)
    return {"entries": entries, "unreadable": unreadable}


def typed_entries(spark: SparkSession, root: str, sources: Sequence = config.SOURCES) -> DataFrame:
    """The entries of ``typed_tables`` alone."""
    return typed_tables(spark, root, sources)["entries"]


def folder_tables(
    spark: SparkSession, paths: Sequence[str], title_from: str = "thread", stored: bool = False, large: bool = False
) -> Tables:
    """Entries of thread folders, tagged with the folder name, and the threads that could not be read."""
    good, bad = th.load_threads(spark, paths, stored, large)
    return {"entries": th.scan_folders(good, title_from), "unreadable": th.quarantine(bad)}


def folder_entries(spark: SparkSession, paths: Sequence[str], title_from: str = "thread", stored: bool = False) -> DataFrame:
    """The entries of ``folder_tables`` alone."""
    return folder_tables(spark, paths, title_from, stored)["entries"]


def count_tables(spark: SparkSession, paths: Sequence[str], stored: bool = False, large: bool = False) -> Tables:
    """Per-thread summary, corpus statistics and the unreadable files."""
    good, bad = th.load_threads(spark, paths, stored, large)
    category = F.regexp_replace(th.folder_name(F.col("path")), "_titles_data$", "")
    parts = good.withColumns({"category": category, "part": th.part_of_thread()})
    summary = th.join_parts(th.summarise_threads(parts, ["path", "category", "part"]), ["path", "category"]).drop("path")
    return {
        "summary": summary,
        "stats": summaries.ordered_stats(summaries.corpus_stats(summary)),
        "unreadable": th.quarantine(bad),
    }


def folder_table(
    spark: SparkSession, paths: Sequence[str], names: Mapping[str, str] = config.SUMMARY_LABELS, stored: bool = False,
    large: bool = False,
) -> DataFrame:
    """Titles and entries per labelled folder with a total row and printable counts; unreadable files are titles."""
    good, bad = th.load_threads(spark, paths, stored, large)
    threads = good.select("path", F.size("entries").alias("n")).unionByName(bad.select("path", F.lit(None).cast("int").alias("n")))
    files = threads.groupBy("path").agg(F.sum("n").alias("n_entries")).select(
        th.folder_name(F.col("path")).alias("folder"), "n_entries")
    table = summaries.folder_summary(files, "folder", names)
    return table.select(
        "*", thousands(F.col("titles")).alias("titles_text"), thousands(F.col("entries")).alias("entries_text")
    )


def descriptive_tables(entries: DataFrame, date_mode: str = "strict") -> Tables:
    """Entries, titles, lengths, timeline and top titles per folder."""
    rows = timelines.dated(entries, mode=date_mode)
    group = "origin_folder"
    return {
        "entries": summaries.entries_per_group(rows, group),
        "titles": summaries.titles_per_group(rows, group),
        "mean_length": summaries.mean_length_per_group(rows, group),
        "length_boxes": summaries.length_boxstats(rows, group),
        "timeline": timelines.timeline(rows, group),
        "top_titles": ranking.top_titles(rows, group).orderBy(group, F.desc("n"), "title"),
    }


def frame_tables(
    entries: DataFrame,
    date_mode: str = "multi",
    group_labels: Mapping[str, str] = config.GROUP_LABELS,
    lexicon: Mapping[str, Sequence[str]] = config.FRAMES,
    subgroups: Mapping[str, str] = config.SUBGROUP_STEMS,
    subgroup_labels: Mapping[str, str] = config.SUBGROUP_LABELS,
    block: str = config.MIGRANT_FOLDER,
    first: int = config.FIRST_YEAR,
    last: int = config.LAST_YEAR,
    store: bool = False,
) -> Tables:
    """Timelines, title frames, their trends and ratios, frequent words and bigrams.

    With ``store`` the dated rows and the framed titles, which a dozen tables share, are
    written once to the shared folder, so the threads are parsed a single time.
    """
    group, names = "origin_folder", list(lexicon)
    rows = timelines.dated(entries, mode=date_mode).select(group, "title", "year")
    if store:
        rows = materialise(rows, "dated-titles")
    main = timelines.in_years(timelines.labelled_timeline(rows, group, group_labels), first, last)
    flagged = shape.add_flags(rows.filter(F.col(group) == block).select("title", "year"), "title", subgroups)
    sub = timelines.subgroup_timeline(flagged, list(subgroups))
    titles = frames.distinct_titles(rows, group)
    framed = frames.frame_titles(titles, lexicon)
    if store:
        framed = materialise(framed, "framed-titles")
        titles = framed.select(*titles.columns)
    in_block = framed.filter(F.col(group) == block)
    counts = frames.frame_counts(framed, group, names)
    by_sub = frames.frame_counts_by_subgroup(in_block, subgroups, names)
    base = counts.filter(F.col(group) != block)
    return {
        "timeline": shape.dense_grid(main, "label", "entries", first, last),
        "subgroup_timeline": sub,
        "combined_timeline": timelines.combined_timeline(main, sub, subgroup_labels, first, last),
        "frame_counts": counts.withColumn("label", display_label(F.col(group), group_labels)),
        "frame_counts_by_subgroup": by_sub,
        "frame_counts_combined": frames.frame_counts_combined(
            base, by_sub, group, group_labels, subgroup_labels, names
        ),
        "frame_shares": frames.frame_shares(by_sub, "subgroup", names),
        "frame_ratio": frames.frame_ratio(in_block, subgroups, names, first, last),
        "frame_ratio_by_year": frames.frame_ratio_by_year(in_block, names),
        "frame_trend": frames.frame_trend(framed, names, [group]),
        "top_words": ranking.top_words(titles, group),
        "top_bigrams": ranking.top_bigrams(titles, group),
    }


def mention_tables(
    entries: DataFrame, valence: Mapping[str, float], load: scoring.Loader, date_mode: str = "strict",
    tasks: int | None = None, max_chars: int | None = None, rules: scoring.ContextRules | None = None,
) -> Tables:
    """Entries that mention a group, scored by a lexicon and a model, and their summaries.

    With ``rules`` the lexicon's words are read in their context. The model reads whole texts unless
    ``max_chars`` is given.

    The scored rows are written to the shared folder once: the model, the dearest step of
    all, reads each text a single time, on ``tasks`` even shares of the rows if given, and
    every table is made from its results.
    """
    text = blank_to_null(F.col("content"))
    rows = shape.keep_found(timelines.dated(entries, mode=date_mode), "content", text)
    marked = mentions.with_mention(rows)
    stems = [(name, stem) for name, stem in config.SUBGROUP_STEMS.items()]
    marked = marked.withColumn("title_category", first_match(F.col("title"), stems))
    scored = scoring.model_scores(marked, load, tasks=tasks, max_chars=max_chars)
    scored = scoring.with_context_score(scored, valence, rules) if rules else scoring.with_lexicon_score(scored, valence)
    scored = materialise(scored.withColumn("bin", sentiment_bin(F.col("compound"))), "scored")
    return {
        "scored": scored,
        "mentions": scored.groupBy("marker").agg(F.count("*").alias("n")).orderBy(F.desc("n")),
        "means": summaries.mean_scores(scored, ["marker"], ["compound", "model_score"], 3),
        "crosstab": summaries.crosstab(scored, "marker", "title_category", list(config.SUBGROUP_STEMS)),
        "entries_per_year": timelines.timeline(scored, "marker"),
        "scores_per_year": summaries.mean_scores(scored, ["marker", "year"], ["compound", "model_score"]),
    }


def author_tables(typed: DataFrame, authors: int = 10, samples: int = 3, seed: int = 0) -> Tables:
    """Most active authors and a few of their entries."""
    top = ranking.top_authors(typed, authors)
    drawn = ranking.author_samples(typed, top, F.col("entry_id"), samples, seed)
    return {
        "authors": top,
        "samples": drawn.select("author", "date_raw", snippet(F.col("content"), F.col("topics")).alias("snippet")),
    }


def _texts(spark: SparkSession, paths: str) -> DataFrame:
    """``path, folder, json`` of each file, opened once; ``folder`` is the place below the fixed part of ``paths``."""
    files = spark.read.text(paths, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("json"))
    plain = F.regexp_replace(F.try_url_decode(F.regexp_replace("path", r"\+", "%2B")), r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    fixed = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", paths if "://" in paths else os.path.abspath(paths))
    root = re.split(r"[*?\[{]", fixed)[0]
    root = root if fixed == root and not fixed.endswith(".json") else root.rpartition("/")[0]
    below = F.substr(plain, F.lit(len(root.rstrip("/")) + 2))
    folder = F.when(F.contains(below, F.lit("/")), F.regexp_replace(below, "/[^/]*$", "")).otherwise(F.lit(""))
    return materialise(files.withColumn("folder", folder), "texts")


def merge_tables(spark: SparkSession, data: str, annotations: str) -> Tables:
    """``merge_texts`` of the files under two paths. A pair shares its place below them and its base name."""
    return merge_texts(_texts(spark, data), _texts(spark, annotations))


def merge_texts(data: DataFrame, annotations: DataFrame) -> Tables:
    """Labels merged into threads, file pair by file pair.

    Both sides have ``path, folder, json``; threads may come in parts of the same path.
    Only pairs whose two files are sound are merged: ``merged`` has their entries, ``audit``
    the counts per pair, ``threads`` the merged threads for ``sinks.threads.write_threads``,
    which the build reads back. ``errors`` tells of the other pairs, ``unreadable`` of
    threads that could not be read.
    """
    name = th.file_name(F.col("path")).alias("name")
    notes, files = (df.select("path", "folder", "json", name) for df in (annotations, data))
    note_states = labels.inspect_annotations(notes, "name", "json", "folder")
    file_states = labels.inspect_data(files, "name", "json", "folder")
    sound = labels.sound_pairs(note_states, file_states)
    key = labels.pair_key(F.col("name"), F.col("folder")).alias("key")
    stem = F.regexp_replace("name", r"\.json$", "")
    own = F.when(F.col("folder") == "", stem).otherwise(F.concat("folder", F.lit("/"), stem)).alias("key")
    good, bad = th.split_readable(th.parse_threads(files.select("path", own, "json").join(sound, "key", "left_semi"), "json"))
    entries = th.explode_entries(good, ["path", "key"]).select("path", "key", "scrape_info", "pos", "entry.*")
    # Of several annotation files of one pair the last by name has the last word.
    records = labels.annotation_elements(notes.select("name", key, "json"), ["key", "name"], "json")
    records = records.withColumn("pos", F.struct("name", "pos")).drop("name")
    latest = latest_annotations(records, ["key", "entry_id"])
    latest = latest.withColumn("categories", F.to_variant_object("categories"))
    # An id hardly repeats within its own file, so hot keys are not worth a second parse of the JSON.
    merged = materialise(labels.merge_labels(entries, latest, ["key", "entry_id"], ["path", "pos"], probe=False), "merged")
    nested = nest_entries(merged, ["path"], entry_fields(), carried=["scrape_info"])
    return {
        "merged": merged,
        "audit": labels.merge_audit(merged, ["key"]),
        "errors": labels.merge_errors(note_states, file_states),
        "threads": thread_json(nested, thread_info()).select("path", "part", "json"),
        "unreadable": th.quarantine(bad),
    }


def write_merged_files(tables: Tables, path: str, suffix: str = "_merged", part_size: int = PART_SIZE, overwrite: bool = False) -> None:
    """The merged threads of ``merge_texts`` as one JSON file each, at the place of their pair: ``path/FOLDER/NAME_merged.json``."""
    nested = nest_entries(tables["merged"], ["path"], entry_fields(), carried=["scrape_info", "key"], part_size=part_size)
    write_thread_files(nested, F.concat("key", F.lit(f"{suffix}.json")), thread_info(), path, overwrite)


def annotation_tables(
    entries: DataFrame, respond: Callable[[DataFrame], DataFrame], thread: str = "path", size: int = config.BATCH_SIZE
) -> Tables:
    """Entries to annotation lists around a labeller.

    ``respond`` takes the batches (``thread, batch, n_entries, entry_ids, prompt``) and returns
    them with a ``response`` text. They are stored once; ``annotations`` has the clean labels
    under the name of their thread for ``sinks.tables.write_annotations``, ``batches`` the
    state of each response, ``ids`` the ids that came back other than once.
    """
    distinct = entries.filter(F.col("entry_id") != "").groupBy(thread, "entry_id").agg(
        F.min("pos").alias("pos"), F.min_by("content", "pos").alias("content"))
    batches = labels.pack_batches(distinct, thread, size)
    answered = materialise(respond(batches).select(thread, "batch", "entry_ids", "response"), "responses")
    parsed = labels.parse_responses(answered, "response")
    found = labels.normalise_labels(parsed.filter("status = 'ok'"), [thread, "batch"])
    expected = answered.select(thread, "batch", F.explode("entry_ids").alias("entry_id"))
    name = F.regexp_replace(th.file_name(F.col(thread)), r"\.json$", "").alias("name")
    return {
        "annotations": found.select(name, "entry_id", "sentiment_numeric", "categories"),
        "batches": parsed.select(thread, "batch", "status"),
        "ids": labels.audit_ids(expected, found, [thread, "batch"]),
    }


def title_table(spark: SparkSession, lists: Sequence[str], collected: DataFrame | None = None) -> DataFrame:
    """Titles of the given lists that are not among ``collected`` (a column ``title``) yet, in list order."""
    titles = read_title_lists(spark, list(lists)).select("title", "pos")
    done = titles.limit(0).select("title") if collected is None else collected.select("title")
    return labels.new_titles(titles, done).orderBy("pos")
