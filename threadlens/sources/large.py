"""Large thread files over many tasks.

A thread file is one JSON object, which a reader takes whole. Here files are read as text that is cut at
every ``}``, so that Spark splits them like any text file, and the structure is found again by
counting. A piece between two cuts flips the state inside or outside a string or leaves it, and
changes the depth of brackets by one number if it begins outside a string, by another if inside. Both
compose, so running sums within each block of a file, and over its few blocks, give the depth
everywhere. Pieces that bring it back to that of the ``entries`` list end an entry. Entries are put
together again and dealt into parts of bounded size, which are threads with an ``offset`` as the library
stores them.

Files of another shape (broken, without entries, with other lists of objects at the root, with entries
that are no objects) are put together whole, as the plain reader would, and judged by the parser; of
one over ``WHOLE_LIMIT`` only the beginning stays, which makes it unreadable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadlens.session import materialise
from threadlens.sinks.threads import PART_SIZE

CUT = "}"
WHOLE_LIMIT = 1 << 30
ENTRY_DEPTH = 2  # root object, entries list
HEAD = r'(?s)^(.*?"entries"\s*:\s*\[\s*)(\{.*)$'


def _count(text: Column, letters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, letters, ""))


def _joined(pieces: Column) -> Column:
    """Texts of pieces in file order, with the cuts between them."""
    return F.array_join(F.transform(F.array_sort(pieces), lambda p: p["value"]), CUT)


def _depth(text: Column) -> Column:
    """Brackets that a text, which begins outside strings, leaves open."""
    outside = F.array_join(F.filter(F.split(F.regexp_replace(text, r"(?s)\\.", ""), '"', -1), lambda x, i: i % 2 == 0), "")
    return _count(outside, "{[") - _count(outside, "}]")


def file_pieces(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Pieces of all files with their place and what they do to state and depth, running within their block.

    ``run0`` and ``run1`` are the depth's changes up to the piece's end if its block begins outside or
    inside a string; ``end0`` is 1 where the piece ends inside a string, in the former case.
    """
    read = spark.read.option("lineSep", CUT).text(paths)
    plain = F.regexp_replace("value", r"(?s)\\.", "")  # escapes occur in strings only and end none
    rows = read.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), F.col("_metadata.file_size").alias("file_size"), "value",
        F.explode(F.array(F.split(plain, '"', -1))).alias("_s"))
    outside = F.array_join(F.filter("_s", lambda x, i: i % 2 == 0), "")
    inside = F.array_join(F.filter("_s", lambda x, i: i % 2 == 1), "")
    change = lambda text: _count(text, "{[") - _count(text, "]")
    rows = rows.select("path", "block", "at", "file_size", "value", ((F.size("_s") - 1) % 2).alias("flip"),
                       change(outside).alias("d0"), change(inside).alias("d1"))
    upto = Window.partitionBy("path", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end0", F.sum("flip").over(upto) % 2)
    begins = F.pmod(F.col("end0") - F.col("flip"), F.lit(2))
    step = lambda even, odd, end: F.when(begins == 0, F.col(even)).otherwise(F.col(odd)) - F.when(
        F.col("end0") == end, 1).otherwise(0)
    rows = rows.withColumns({"l0": step("d0", "d1", 0), "l1": step("d1", "d0", 1)})
    rows = rows.withColumns({"run0": F.sum("l0").over(upto), "run1": F.sum("l1").over(upto)})
    return rows.select("path", "block", "at", "file_size", "value", "flip", "end0", "l0", "l1", "run0", "run1")


def _chained(blocks: DataFrame) -> DataFrame:
    """State and depth at the beginning of each block of a file."""
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    states = blocks.withColumn("state", F.coalesce(F.sum("flips").over(before), F.lit(0)) % 2)
    change = F.when(F.col("state") == 0, F.col("total0")).otherwise(F.col("total1"))
    return states.withColumn("change", change).withColumn("depth", F.coalesce(F.sum("change").over(before), F.lit(0)))


def split_thread_files(spark: SparkSession, paths: str | list[str], part_size: int = PART_SIZE) -> DataFrame:
    """``path, part, json`` of thread files: their threads in parts of at most ``part_size`` entries."""
    pieces = materialise(file_pieces(spark, paths), "pieces")
    blocks = pieces.groupBy("path", "block").agg(
        F.sum("flip").alias("flips"), F.sum("l0").alias("total0"), F.sum("l1").alias("total1"), F.count("*").alias("n"),
        F.sum(F.octet_length("value").cast("long")).alias("bytes"), F.first("file_size").alias("file_size"))
    chained = materialise(_chained(blocks), "blocks")
    # A last piece with no cut behind it is given one that is not there.
    files = chained.groupBy("path").agg(
        F.sum("change").alias("end_depth"), F.first("file_size").alias("file_size"),
        (F.sum("bytes") + F.sum("n") - F.first("file_size")).alias("uncut"), F.max("block").alias("last_block"))
    own = chained.select("path", "block", "state", "depth")
    placed = pieces.join(own, ["path", "block"])
    outside = F.when(F.col("state") == 0, F.col("end0") == 0).otherwise(F.col("end0") == 1)
    depth = F.col("depth") + F.when(F.col("state") == 0, F.col("run0")).otherwise(F.col("run1"))
    placed = placed.withColumn("ends", (outside & (depth == ENTRY_DEPTH)).cast("int"))
    ends = placed.groupBy("path", "block").agg(F.sum("ends").alias("ends"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ends.select("path", "block", F.coalesce(F.sum("ends").over(earlier), F.lit(0)).alias("ends_before"))
    inside = Window.partitionBy("path", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    numbered = placed.withColumn("before", F.coalesce(F.sum("ends").over(inside), F.lit(0))).join(offsets, ["path", "block"])
    element = F.col("ends_before") + F.col("before")
    texts = numbered.groupBy("path", element.alias("pos")).agg(
        _joined(F.collect_list(F.struct("block", "at", "value"))).alias("text"), F.max("ends").alias("ended"))
    texts = materialise(texts, "entry-texts")
    shape = texts.groupBy("path").agg(
        F.max("pos").alias("n"), F.max_by("ended", "pos").alias("last_ends"),
        F.bool_and((F.col("pos") == 0) | (F.col("ended") == 0) | F.col("text").rlike(r"^\s*,\s*\{")).alias("listed"),
        F.max(F.when(F.col("pos") == 0, F.regexp_extract("text", HEAD, 1))).alias("head"),
        F.max_by(F.when(F.col("ended") == 0, F.col("text")), "pos").alias("tail"))
    facts = files.join(shape, "path")
    whole = (F.col("end_depth") == -F.col("uncut")) & F.col("listed") & (F.col("n") > 0) & (_depth(F.col("head")) == ENTRY_DEPTH) & (
        F.col("last_ends") == 0) & F.col("tail").rlike(r"^\s*\]")
    close = F.when(F.col("uncut") == 1, F.lit("")).otherwise(F.lit(CUT))
    facts = facts.select("path", F.coalesce(whole, F.lit(False)).alias("whole"), "head", F.concat("tail", close).alias("tail"),
                         "n", "file_size", close.alias("close"))
    found = texts.join(facts, "path")
    # Entries of well-shaped files, in parts.
    entry = F.when(F.col("pos") == 0, F.regexp_extract("text", HEAD, 2)).otherwise(F.regexp_replace("text", r"^\s*,\s*", ""))
    part = F.floor(F.col("pos") / part_size).alias("part")
    listed = found.filter(F.col("whole") & (F.col("ended") == 1)).select(
        "path", part, F.struct("pos", F.concat(entry, F.lit(CUT)).alias("text")).alias("e"), "head", "tail")
    parts = listed.groupBy("path", "part").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["text"]), ",").alias("entries"),
        F.any_value("head").alias("head"), F.any_value("tail").alias("tail"))
    start = F.concat(F.lit('{"offset": '), (F.col("part") * part_size).cast("string"), F.lit(", "))
    head = F.when(F.col("part") == 0, F.col("head")).otherwise(
        F.concat(start, F.regexp_replace("head", r"^[^{]*\{", "")))
    split = parts.select("path", F.col("part").cast("long").alias("part"), F.concat(head, "entries", "tail").alias("json"))
    # The others as they are.
    rest = found.filter(~F.col("whole") & ((F.col("file_size") <= WHOLE_LIMIT) | (F.col("pos") == 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda p: p["text"]), CUT)
    plain = rest.groupBy("path").agg(text.alias("text"), F.any_value("close").alias("close"), F.any_value("file_size").alias("size"))
    plain = plain.select("path", F.lit(0).cast("long").alias("part"), F.when(
        F.col("size") <= WHOLE_LIMIT, F.concat("text", "close")).otherwise(F.left("text", F.lit(1000))).alias("json"))
    return split.unionByName(plain)
