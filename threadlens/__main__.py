"""The analyses as jobs: ``spark-submit`` this file or ``python -m threadlens <job> ...``.

    build        --root DIR --out DIR                typed table of all configured sources
    counts       --threads PATH... --out DIR         per-thread summary and corpus statistics
    folders      --threads PATH... --out DIR         titles and entries per folder
    descriptives --threads PATH... --out DIR         entries, titles, lengths, top titles
    frames       --threads PATH... --out DIR         timelines, frames, words, bigrams
    mentions     --threads PATH... --lexicon CSV --scorer MODULE:LOADER --out DIR   scored mentions and their tables
    merge        --data PATH --annotations PATH [--files] --out DIR   label merge with audit
    annotate     --threads PATH... --responder MODULE:FUNCTION --out DIR   batches, responses, annotation lists
    titles       --lists PATH... [--collected DIR] --out DIR   titles not collected yet
    authors      --typed DIR --out DIR               most active authors and samples

``--stored`` says that ``--threads`` are tables written by the merge (``OUT/threads``), ``--large`` that their files
are to be read by splits. With ``--files`` the merge writes one JSON file per thread below ``OUT/files`` as well. Every
job that reads threads also writes those it could not read, as ``OUT/unreadable``.
"""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from threadlens.plans import reports
from threadlens.session import JOB_SETTINGS, clear_paths
from threadlens.sinks.tables import write_annotations, write_csv, write_typed
from threadlens.sinks.threads import write_threads
from threadlens.sources.threads import read_typed

# Tables with nested columns or one row per entry are stored as parquet, the others as CSV.
PARQUET = {"merged", "scored"}


def save(tables: reports.Tables, out: str) -> None:
    for name, table in tables.items():
        path = f"{out.rstrip('/')}/{name}"
        if name == "threads":
            write_threads(table, path)
        elif name == "annotations":
            write_annotations(table, "name", path)
        elif name in PARQUET:
            table.write.mode("overwrite").parquet(path)
        else:
            write_csv(table, path)


def named(place: str):
    """The object that ``module:name`` stands for."""
    module, _, name = place.partition(":")
    return getattr(importlib.import_module(module), name)


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    stored, large = getattr(args, "stored", False), getattr(args, "large", False)
    if args.job == "build":
        tables = reports.typed_tables(spark, args.root)
        write_typed(tables["entries"], f"{args.out.rstrip('/')}/entries")
        save({"unreadable": tables["unreadable"]}, args.out)
    elif args.job == "counts":
        save(reports.count_tables(spark, args.threads, stored, large), args.out)
    elif args.job == "folders":
        save({"folders": reports.folder_table(spark, args.threads, stored=stored, large=large)}, args.out)
    elif args.job in ("descriptives", "frames", "mentions"):
        read = reports.folder_tables(spark, args.threads, stored=stored, large=large)
        if args.job == "descriptives":
            made = reports.descriptive_tables(read["entries"])
        elif args.job == "frames":
            made = reports.frame_tables(read["entries"], store=True)
        else:
            rows = spark.read.option("header", True).schema("word string, valence double").csv(args.lexicon)
            lexicon = {r.word: r.valence for r in rows.collect()}  # a word list, not data
            made = reports.mention_tables(read["entries"], lexicon, named(args.scorer))
        save({**made, "unreadable": read["unreadable"]}, args.out)
    elif args.job == "merge":
        tables = reports.merge_tables(spark, args.data, args.annotations)
        save(tables, args.out)
        if args.files:
            reports.write_merged_files(tables, f"{args.out.rstrip('/')}/files", overwrite=True)
    elif args.job == "annotate":
        read = reports.folder_tables(spark, args.threads, stored=stored, large=large)
        made = reports.annotation_tables(read["entries"], named(args.responder))
        save({**made, "unreadable": read["unreadable"]}, args.out)
    elif args.job == "titles":
        collected = read_typed(spark, args.collected).select(F.col("title")) if args.collected else None
        save({"titles": reports.title_table(spark, args.lists, collected)}, args.out)
    else:
        save(reports.author_tables(read_typed(spark, args.typed)), args.out)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="threadlens")
    jobs = top.add_subparsers(dest="job", required=True)
    for name, options in {
        "build": ["root"], "counts": ["threads"], "folders": ["threads"], "descriptives": ["threads"],
        "frames": ["threads"], "mentions": ["threads", "lexicon", "scorer"], "merge": ["data", "annotations"],
        "annotate": ["threads", "responder"], "titles": ["lists"], "authors": ["typed"],
    }.items():
        job = jobs.add_parser(name)
        for option in [*options, "out"]:
            job.add_argument(f"--{option}", required=True, nargs="+" if option in ("threads", "lists") else None)
        if "threads" in options:
            job.add_argument("--stored", action="store_true")
            job.add_argument("--large", action="store_true")
        if name == "merge":
            job.add_argument("--files", action="store_true")
        if name == "titles":
            job.add_argument("--collected")
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    builder = SparkSession.builder.appName(f"threadlens-{args.job}")
    for key, value in JOB_SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    try:
        run(spark, args)
    finally:
        clear_paths(spark)


if __name__ == "__main__":
    main()
