"""The registered queries of the operators, each beside its SQL check where SQL can express it."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.llm import (
    line_dedup, ngram_join, packing, periodic, quality, resampling, secrets, sentencepieces, token_counts, token_files,
    top_search, url_filter, vector_links,
)
from threadlens.session import new_path

PLANS, CHECKS = {}, {}
END_ID = 2


def query(name: str, sql: str | None = None):
    def add(plan):
        PLANS[name] = plan
        if sql is not None:
            CHECKS[name] = sql
        return plan

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op1_secret_scan")
def secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.secret_table(table(spark, sf, "documents"))


NEAR_SQL = r"""
WITH RECURSIVE word AS (
  SELECT doc_id, list_filter(
    string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[\x20\x09-\x0D]+'), lambda x: x <> '') AS l
  FROM documents),
gram AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(l) >= 5 THEN list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i:i + 4], ' '))
    WHEN len(l) > 0 THEN [array_to_string(l, ' ')] ELSE [] END) AS g
  FROM word),
n AS (SELECT doc_id, count(*) AS n FROM gram GROUP BY doc_id),
pair AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o
  FROM gram a JOIN gram b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (
  SELECT x, y FROM pair JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 80 * (a.n + b.n - o)),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.y) AS component_id
FROM documents d JOIN reach r ON r.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id"""


@query("op2_ngram_join", NEAR_SQL)
def near_duplicate_table(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf, "documents"))


@query("op3_url_filter")
def url_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf, "pages"))


@query("op4_sentencepiece")
def sentencepiece_check(spark: SparkSession, sf: str) -> DataFrame:
    return sentencepieces.check_documents(table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op5_token_files")
def token_file_index(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "tokens")
    token_files.write_tokens(table(spark, sf, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), END_ID)
    return token_files.token_index(spark, path)


LINES_SQL = """
WITH line AS (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM line),
shared AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT k.*, s.key IS NOT NULL AND k.doc_id <> s.keeper AS dropped
  FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""


@query("op6_line_dedup", LINES_SQL)
def deduplicated_lines(spark: SparkSession, sf: str) -> DataFrame:
    cut = line_dedup.dedup_lines(table(spark, sf, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op7_packing")
def packed_documents(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"), END_ID)


@query("op8_token_counts")
def token_count_table(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.count_tokens(
        table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


@query("op9_vector_links")
def vector_link_table(spark: SparkSession, sf: str) -> DataFrame:
    return vector_links.link_vectors(table(spark, sf, "embeddings"))


@query("op10_quality_rules")
def quality_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    judged = quality.judge(table(spark, sf, "documents").select("doc_id", "text", "lang", "source"), keep_text=False)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept")


@query("op11_importance_resampling")
def resampled_documents(spark: SparkSession, sf: str) -> DataFrame:
    return resampling.resample(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """``doc_id, text``; one text in ten, by a hash of its id, becomes its words with a tail that repeats a sequence."""
    draw = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(draw % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)")))
    g, n = F.col("g"), F.size("words")
    chosen = docs.select("doc_id", "text", F.floor(draw / 10).alias("g"), words.alias("words"))
    placed = chosen.withColumn("a", F.when(n > 0, g % n))
    period = placed.withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + g % 8)))
    source = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    turned = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("words", source(i).cast("int")))
    return period.select("doc_id", F.when(n > 0, F.array_join(turned, " ")).otherwise(F.col("text")).alias("text"))


@query("op12_periodic_runs")
def periodic_run_table(spark: SparkSession, sf: str) -> DataFrame:
    found = periodic.collapse_runs(with_planted_periods(table(spark, sf, "documents")))
    better = lambda best, run: best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"])
    best = F.reduce("runs", F.lit(None).cast(periodic.RUN), lambda best, run: F.when(better(best, run), run).otherwise(best))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


TOP_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pair AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
best AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pair)
SELECT query_id, rank, vec_id, score FROM best WHERE rank <= 10"""


@query("op13_top_search", TOP_SQL)
def best_matches(spark: SparkSession, sf: str) -> DataFrame:
    return top_search.top_k(table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0)


PLANS["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    CHECKS["pipeline"] = corpus_pipeline.ORACLE_SQL
