"""Removal of lines that many documents share, with DataFrame functions alone.

Lines are normalised to keys, exploded once per document and key, and hashed; the distinct
documents per hash are counted with map-side partial sums, so a line that a third of all
documents hold is a few partial counts per task. Only the hashes over the threshold are
joined back to the lines' hashes, which gives the positions that each document loses:
texts are shuffled once, to these positions, and reassembled from the rest in order. Hashes with a
thousandth or more of all shared lines (so a thousand at most, which is what the broadcast is) have
their rows spread over slots in that join.

Keys are compared by 96 bits of hash. A null or empty text is one empty line. Rows with a
null id hold no document: they neither count nor lose lines. Further columns stay as they
are, but for ``n_lines`` and ``n_dropped``, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.llm.blocks import renamed
from threadlens.operators.joins import lookup_join
from threadlens.session import materialise

SPACE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS = 20
MIN_DOCS = 3
HOT_SHARE = 1000  # a key with one in so many shared lines is hot


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def key_hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("a"), F.hash(key).alias("b"))


def line_hashes(text: Column, min_chars: int) -> Column:
    """A hash per line by position; null for lines that are too short to count."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    return F.transform(
        F.transform(lines, line_key), lambda k: F.when(F.length(k) >= min_chars, key_hash(k))
    )


def shared_keys(rows: DataFrame, min_docs: int, unique_ids: bool) -> DataFrame:
    """``_h, _keeper, _n`` of the keys in at least ``min_docs`` documents; ``rows`` has ``_id, _hashes``."""
    found = rows.select("_id", F.explode(F.array_distinct(F.array_compact("_hashes"))).alias("_h"))
    if not unique_ids:
        found = found.distinct()
    counted = found.groupBy("_h").agg(F.count("*").alias("_n"), F.max("_id").alias("_keeper"))
    return counted.filter(F.col("_n") >= min_docs)


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS, unique_ids: bool = False,
) -> DataFrame:
    """``docs`` with cut texts, and ``n_lines`` and ``n_dropped`` at the end.

    A key of at least ``min_chars`` code points found in at least ``min_docs`` documents
    stays in the document with the largest id only. Rows that repeat an id count as one
    document. A caller who knows that none does may say so by ``unique_ids``, which saves a
    shuffle of hashes; each row then counts.
    """
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    own = renamed(docs.select(*columns))
    kept_columns, at_text = own.columns, F.col(f"_c{columns.index(text_col)}")
    own = own.withColumns({"_id": F.col(f"_c{columns.index(id_col)}"), "_mark": F.xxhash64(at_text)})
    text = F.coalesce(at_text, F.lit(""))
    hashed = docs.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_mark"),
        line_hashes(F.col(text_col), min_chars).alias("_hashes"),
    )
    shared = materialise(shared_keys(hashed, min_docs, unique_ids), "shared-lines")
    most = shared.agg(F.sum("_n")).first()[0] or 0
    hot = F.broadcast(shared.filter(F.col("_n") * HOT_SHARE >= most).select("_h"))
    # Rows with the same id are told apart by their texts; those with the same text lose the same lines.
    lines = hashed.select("_id", "_mark", F.posexplode("_hashes").alias("_pos", "_h")).filter(F.col("_h").isNotNull())
    lost = (
        lookup_join(lines, shared.select("_h", "_keeper"), ["_h"], spread_by=["_id", "_pos"], probe=hot)
        .filter(F.col("_id") != F.col("_keeper"))
        .groupBy("_id", "_mark")
        .agg(F.collect_list("_pos").alias("_drop"))
    )
    # A generator keeps Spark from splitting a text once per use of its lines.
    cut = own.join(lost, ["_id", "_mark"], "left").select(
        *kept_columns, "_drop", F.explode(F.array(F.split(text, "\n", -1))).alias("_lines"))
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_drop")
    kept = F.when(F.col("_drop").isNull(), F.col("_lines")).otherwise(F.transform(left, lambda i: F.get("_lines", i)))
    done = cut.select(*kept_columns, F.size("_lines").cast("long").alias("n_lines"), F.explode(F.array(kept)).alias("_kept"))
    texts = [(F.array_join("_kept", "\n") if c == text_col else F.col(k)).alias(c) for c, k in zip(columns, kept_columns)]
    return done.select(*texts, "n_lines", (F.col("n_lines") - F.size("_kept")).alias("n_dropped"))
