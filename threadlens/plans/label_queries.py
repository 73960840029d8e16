"""Annotation batches, responses, merges and their audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlens.operators import labels as lb
from threadlens.plans import reports
from threadlens.plans import views as v
from threadlens.plans.catalog import query
from threadlens.plans.scan_queries import annotation_log
from threadlens.session import new_path
from threadlens.sinks.threads import write_threads
from threadlens.sources import threads as th
from threadlens.sources.annotations import latest_annotations


def _responses(spark, sf):
    """Labeller responses of every sort, one per labelled document."""
    i = F.col("doc_id").cast("string")
    k = F.col("doc_id") % 7

    def text(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    good = text('{"labels":[{"entry_id":"', i, '","sentiment_numeric":4,"categories":["HATE","XENO"]}]}')
    prose = text(
        'Sure, here: {"labels":[{"entry_id":"', i, '","sentiment_numeric":"2","categories":"CRIME"}]} done'
    )
    mixed = text(
        '{"labels":[{"entry_id":" ', i, ' ","sentiment_numeric":3.7,',
        '"categories":["ECON","BAD","ECON"," POLICY ","HUMAN"]},{"entry_id":"","sentiment_numeric":1}]}',
    )
    odd = text(
        '{"labels":[{"entry_id":', i, ',"sentiment_numeric":"3.7","categories":[]},',
        '{"entry_id":"', i, 'b","sentiment_numeric":9},{"entry_id":"', i, '","sentiment_numeric":null}]}',
    )
    response = (
        F.when(k == 0, good)
        .when(k == 1, prose)
        .when(k == 2, F.lit('{"labels": "none"}'))
        .when(k == 3, F.lit("no json at all"))
        .when(k == 4, F.lit('{"labels": []}'))
        .when(k == 5, mixed)
        .otherwise(odd)
    )
    return v.table(spark, sf, "labels").select("doc_id", response.alias("response"))


SQL_RESPONSES = r"""
v_responses AS (
  SELECT doc_id, CASE doc_id % 7
    WHEN 0 THEN '{"labels":[{"entry_id":"' || doc_id || '","sentiment_numeric":4,"categories":["HATE","XENO"]}]}'
    WHEN 1 THEN 'Sure, here: {"labels":[{"entry_id":"' || doc_id || '","sentiment_numeric":"2","categories":"CRIME"}]} done'
    WHEN 2 THEN '{"labels": "none"}'
    WHEN 3 THEN 'no json at all'
    WHEN 4 THEN '{"labels": []}'
    WHEN 5 THEN '{"labels":[{"entry_id":" ' || doc_id || ' ","sentiment_numeric":3.7,' ||
                '"categories":["ECON","BAD","ECON"," POLICY ","HUMAN"]},{"entry_id":"","sentiment_numeric":1}]}'
    ELSE '{"labels":[{"entry_id":' || doc_id || ',"sentiment_numeric":"3.7","categories":[]},' ||
         '{"entry_id":"' || doc_id || 'b","sentiment_numeric":9},{"entry_id":"' || doc_id || '","sentiment_numeric":null}]}'
    END AS response
  FROM labels),
v_json AS (
  SELECT doc_id, CASE WHEN json_valid(response) THEN response
                      WHEN json_valid(regexp_extract(response, '(?s)\{.*\}')) THEN regexp_extract(response, '(?s)\{.*\}')
                 END AS js
  FROM v_responses),
v_parsed AS (
  SELECT doc_id, js, CASE WHEN js IS NULL THEN 'invalid_json'
                          WHEN json_type(js, '$.labels') IS DISTINCT FROM 'ARRAY' THEN 'no_labels'
                          WHEN json_array_length(js, '$.labels') = 0 THEN 'empty_labels' ELSE 'ok' END AS status
  FROM v_json),
v_label AS (
  SELECT doc_id, cast(i AS integer) AS pos, json_extract(js, '$.labels[' || i || ']') AS x
  FROM (SELECT doc_id, js, unnest(range(cast(json_array_length(js, '$.labels') AS bigint))) AS i
        FROM v_parsed WHERE status = 'ok')),
v_clean AS (
  SELECT doc_id, pos, trim(json_extract_string(x, '$.entry_id')) AS entry_id,
         CASE json_type(x, '$.sentiment_numeric')
           WHEN 'VARCHAR' THEN CASE WHEN regexp_full_match(trim(json_extract_string(x, '$.sentiment_numeric')), '[+-]?\d{1,9}')
                               THEN cast(json_extract_string(x, '$.sentiment_numeric') AS integer) END
           WHEN 'DOUBLE' THEN cast(trunc(cast(json_extract_string(x, '$.sentiment_numeric') AS double)) AS integer)
           WHEN 'UBIGINT' THEN cast(json_extract_string(x, '$.sentiment_numeric') AS integer) END AS s,
         list_filter(list_transform(CASE json_type(x, '$.categories') WHEN 'ARRAY' THEN
             cast(json_extract(x, '$.categories') AS varchar[]) WHEN 'VARCHAR' THEN
             [json_extract_string(x, '$.categories')] ELSE [] END, lambda c: trim(c)),
           lambda c: c IN ('HATE', 'XENO', 'CRIME', 'ECON', 'POLICY', 'HUMAN')) AS kept
  FROM v_label)"""


@query(
    "label_response_parse",
    """
    SELECT doc_id, status, CASE WHEN status IN ('ok', 'empty_labels') THEN
           cast(json_array_length(js, '$.labels') AS bigint) ELSE 0 END AS n_labels FROM v_parsed""",
    [SQL_RESPONSES],
)
def label_response_parse(spark, sf):
    parsed = lb.parse_responses(_responses(spark, sf), "response")
    return parsed.select(
        "doc_id", "status", F.coalesce(F.size("labels"), F.lit(0)).cast("bigint").alias("n_labels")
    )


@query(
    "normalise_labels",
    """
    SELECT doc_id, pos, entry_id, CASE WHEN s BETWEEN 1 AND 5 THEN s ELSE 3 END AS sentiment_numeric,
           CASE WHEN len(kept) = 0 THEN 'NEUTRAL' ELSE array_to_string(kept[1:3], ',') END AS categories
    FROM v_clean WHERE entry_id <> ''""",
    [SQL_RESPONSES],
)
def normalise_labels(spark, sf):
    parsed = lb.parse_responses(_responses(spark, sf), "response")
    return lb.normalise_labels(parsed, ["doc_id"]).withColumn("categories", F.array_join("categories", ","))


@query(
    "response_id_audit",
    """
    e AS (SELECT doc_id, cast(doc_id AS varchar) AS entry_id FROM labels),
    r AS (SELECT doc_id, entry_id, count(*) AS n FROM v_clean WHERE entry_id <> '' GROUP BY doc_id, entry_id)
    SELECT coalesce(e.doc_id, r.doc_id) AS doc_id, coalesce(e.entry_id, r.entry_id) AS entry_id,
           CASE WHEN e.entry_id IS NULL THEN 'unknown' WHEN r.n IS NULL THEN 'missing' ELSE 'duplicate' END AS problem
    FROM e FULL JOIN r ON e.doc_id = r.doc_id AND e.entry_id = r.entry_id
    WHERE e.entry_id IS NULL OR r.n IS NULL OR r.n > 1""",
    [SQL_RESPONSES],
)
def response_id_audit(spark, sf):
    """Ids asked for against ids returned, per response."""
    asked = v.table(spark, sf, "labels").select("doc_id", F.col("doc_id").cast("string").alias("entry_id"))
    parsed = lb.parse_responses(_responses(spark, sf), "response")
    return lb.audit_ids(asked, lb.normalise_labels(parsed, ["doc_id"]), ["doc_id"])


@query(
    "batch_pack",
    """
    r AS (SELECT origin, entry_id, content, row_number() OVER (PARTITION BY origin ORDER BY doc_id) AS rn FROM v_entries)
    SELECT origin, (rn - 1) // 40 AS batch, count(*) AS n_entries,
           md5(string_agg(entry_id, ',' ORDER BY rn)) AS ids_md5,
           md5('Label' || chr(10) || chr(10) ||
               string_agg('ENTRY_ID: ' || entry_id || chr(10) || 'TEXT: ' || content, chr(10) || chr(10) ORDER BY rn))
             AS prompt_md5
    FROM r GROUP BY origin, (rn - 1) // 40""",
    [v.V_ENTRIES],
)
def batch_pack(spark, sf):
    rows = v.entries(spark, sf).select("origin", "entry_id", F.col("doc_id").alias("pos"), "content")
    packed = lb.pack_batches(rows, "origin", preamble="Label")
    return packed.select(
        "origin", "batch", "n_entries",
        F.md5(F.array_join("entry_ids", ",")).alias("ids_md5"), F.md5("prompt").alias("prompt_md5"),
    )


SQL_MERGED = """
v_merged AS (
  SELECT e.entry_id, e.origin, l.quality AS sentiment_numeric, l.doc_id IS NOT NULL AS merged
  FROM v_entries e LEFT JOIN (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 1 - quality ELSE quality END AS quality
                              FROM labels) l ON e.doc_id = l.doc_id)"""


def _merged(spark, sf):
    latest = latest_annotations(annotation_log(spark, sf)).withColumnRenamed("quality", "sentiment_numeric")
    rows = v.entries(spark, sf).select("entry_id", "origin", "doc_id")
    return lb.merge_labels(rows, latest, spread_by=["doc_id"], probe=False)


@query("label_merge", "SELECT entry_id, origin, sentiment_numeric, merged FROM v_merged", [v.V_ENTRIES, SQL_MERGED])
def label_merge(spark, sf):
    return _merged(spark, sf).select("entry_id", "origin", "sentiment_numeric", "merged")


@query(
    "merge_audit",
    """
    SELECT origin, count(*) FILTER (merged) AS n_merged, count(*) FILTER (NOT merged) AS n_missing
    FROM v_merged GROUP BY origin""",
    [v.V_ENTRIES, SQL_MERGED],
)
def merge_audit(spark, sf):
    return lb.merge_audit(_merged(spark, sf), ["origin"])


def _pair_sides(spark, sf):
    """Annotation and data files of every thread, with each sort of defect in some of them.

    Some data files bear another name, so their annotations find no partner.
    """
    kind = F.col("conv_id") % 10
    entry_id = F.when((kind == 5) & (F.col("pos") % 2 == 1), F.lit(None)).otherwise(
        (F.col("conv_id") * 100 + F.col("pos")).cast("string")
    )
    files = v.thread_files(spark, sf, entry_id=entry_id)
    ann_name = F.concat(
        F.col("stem"), F.when(F.col("conv_id") % 2 == 0, "_annotations").otherwise("_annotated"), F.lit(".json")
    )
    ann_text = (
        F.when(kind == 1, '[{"entry_id": ')
        .when(kind == 2, '{"entry_id": "1"}')
        .otherwise('[{"entry_id": "1", "sentiment_numeric": 2}]')
    )
    annotations = files.filter("part = 0").select(ann_name.alias("name"), ann_text.alias("json"))
    data_text = (
        F.when(kind == 3, F.left("json", F.lit(20)))
        .when(kind == 4, F.lit('{"entries": {"a": 1}}'))
        .otherwise(F.col("json"))
    )
    elsewhere = F.when(F.col("conv_id") % 17 == 0, F.lit("lost_")).otherwise(F.lit(""))
    data = files.select(F.concat(elsewhere, F.col("stem"), F.lit(".json")).alias("name"), data_text.alias("json"))
    return lb.inspect_annotations(annotations, "name", "json"), lb.inspect_data(data, "name", "json")


SQL_PAIRS = """
v_pairs AS (
  SELECT f.conv_id, f.stem, f.conv_id % 10 AS kind, f.conv_id % 17 = 0 AS lost,
         f.stem || CASE WHEN f.conv_id % 2 = 0 THEN '_annotations' ELSE '_annotated' END || '.json' AS annotation_file,
         f.stem || '.json' AS data_file
  FROM v_files f)"""


@query("pair_match", "SELECT stem AS key, annotation_file, data_file FROM v_pairs WHERE NOT lost",
       [v.V_FILES, SQL_PAIRS])
def pair_match(spark, sf):
    return lb.match_pairs(*_pair_sides(spark, sf)).select("key", "annotation_file", "data_file")


@query("pair_missing", "SELECT stem AS key, annotation_file FROM v_pairs WHERE lost", [v.V_FILES, SQL_PAIRS])
def pair_missing(spark, sf):
    return lb.unmatched(*_pair_sides(spark, sf)).select("key", "annotation_file")


@query(
    "merge_errors",
    """
    e AS (SELECT annotation_file, data_file, 'MissingDataFile' AS error_type,
                 'Data file not found for ' || annotation_file AS error_message FROM v_pairs WHERE lost
          UNION ALL SELECT annotation_file, data_file, 'InvalidAnnotationJSON', 'Annotation file is not valid JSON'
          FROM v_pairs WHERE NOT lost AND kind = 1
          UNION ALL SELECT annotation_file, data_file, 'InvalidDataJSON', 'Data file is not valid JSON'
          FROM v_pairs WHERE NOT lost AND kind = 3
          UNION ALL SELECT annotation_file, data_file, 'AnnotationsNotList', 'Annotation file is not a list'
          FROM v_pairs WHERE NOT lost AND kind = 2
          UNION ALL SELECT annotation_file, data_file, 'EntriesNotList', 'entries field is not a list'
          FROM v_pairs WHERE NOT lost AND kind = 4
          UNION ALL SELECT p.annotation_file, p.data_file, 'MissingEntryID', 'Entry without entry_id'
          FROM v_pairs p JOIN v_threads t ON p.conv_id = t.conv_id
          WHERE NOT lost AND kind = 5 AND t.pos % 2 = 1)
    SELECT * FROM e""",
    [v.V_FILES, SQL_PAIRS],
)
def merge_errors(spark, sf):
    return lb.merge_errors(*_pair_sides(spark, sf))


@query(
    "incremental_titles",
    """
    f AS (SELECT lower(title) AS k, min_by(title, doc_id) AS title, min(doc_id) AS pos FROM v_entries GROUP BY lower(title))
    SELECT title, pos FROM f WHERE k NOT IN (SELECT lower(title) FROM v_entries WHERE origin IN ('src1', 'src2'))""",
    [v.V_ENTRIES],
)
def incremental_titles(spark, sf):
    """Titles seen first outside what two sources already collected."""
    rows = v.entries(spark, sf).select("title", F.col("doc_id").alias("pos"), "origin")
    collected = rows.filter(F.col("origin").isin("src1", "src2")).select("title")
    return lb.new_titles(rows.drop("origin"), collected)


def _chain_texts(spark, sf):
    """Thread files (in parts) of several folders that share file names, and an annotation file for most of them.

    Every seventh annotation file is an object and every eleventh cut off: their pairs must not be merged.
    """
    k = F.col("conv_id")
    place = F.concat(F.col("folder"), F.lit("/t"), F.floor(k / 3).cast("string"))  # the same name in each folder
    data = v.thread_files(spark, sf).select(
        F.concat(F.lit("/data/"), place, F.lit(".json")).alias("path"), "folder", "json")
    notes = v.threads(spark, sf).filter((k % 5 != 4) & (F.col("pos") % 2 == 0)).groupBy("conv_id", "folder").agg(
        F.collect_list(F.struct(
            "entry_id", (F.col("pos") % 5 + 1).alias("sentiment_numeric"),
            F.when(F.col("pos") % 4 == 0, F.lit("HATE")).otherwise(F.lit("HUMAN")).alias("categories"))).alias("x"))
    text = F.to_json("x")
    text = F.when(k % 7 == 0, F.lit('{"entry_id": "1"}')).when(k % 11 == 0, F.left(text, F.lit(9))).otherwise(text)
    annotations = notes.select(
        F.concat(F.lit("/notes/"), place, F.lit("_annotations.json")).alias("path"), "folder", text.alias("json"))
    return data, annotations


@query(
    "merged_chain",
    """
    SELECT 't' || (conv_id // 3) || '.json' AS file, folder AS category, entry_id, pos,
           CASE WHEN pos % 2 = 0 THEN pos % 5 + 1 END AS sentiment,
           CASE WHEN pos % 4 = 0 THEN 'HATE' WHEN pos % 2 = 0 THEN 'HUMAN' ELSE '' END AS topics,
           md5(content) AS content_md5
    FROM v_threads WHERE conv_id % 5 <> 4 AND conv_id % 7 <> 0 AND conv_id % 11 <> 0""",
    [v.V_THREADS],
)
def merged_chain(spark, sf):
    """Merge, the written threads, and the build that reads them: every entry of every sound pair, with its labels."""
    tables = reports.merge_texts(*_chain_texts(spark, sf))
    path = new_path(spark, "merged-threads")
    write_threads(tables["threads"], path)
    good, _ = th.load_threads(spark, [path], stored=True)
    rows = th.scan_entries(good, th.folder_name(F.col("path")), True, keep=["path"])
    return rows.select(
        th.file_name(F.col("path")).alias("file"), "category", "entry_id", "pos",
        F.col("sentiment").cast("bigint").alias("sentiment"), F.array_join("topics", ",").alias("topics"),
        F.md5("content").alias("content_md5"))


@query(
    "merged_chain_files",
    """
    SELECT 't' || (conv_id // 3) || '_merged.json' AS file, folder AS category, entry_id, pos,
           CASE WHEN pos % 2 = 0 THEN pos % 5 + 1 END AS sentiment,
           CASE WHEN pos % 4 = 0 THEN 'HATE' WHEN pos % 2 = 0 THEN 'HUMAN' ELSE '' END AS topics,
           md5(content) AS content_md5
    FROM v_threads WHERE conv_id % 5 <> 4 AND conv_id % 7 <> 0 AND conv_id % 11 <> 0""",
    [v.V_THREADS],
)
def merged_chain_files(spark, sf):
    """The same chain over one JSON file per thread, streamed from parts of three entries and read by folder."""
    tables = reports.merge_texts(*_chain_texts(spark, sf))
    path = new_path(spark, "merged-files")
    reports.write_merged_files(tables, path, part_size=3)
    good, _ = th.load_threads(spark, [f"{path}/*/*.json"])
    rows = th.scan_entries(good, th.folder_name(F.col("path")), True, keep=["path"])
    return rows.select(
        th.file_name(F.col("path")).alias("file"), "category", "entry_id", "pos",
        F.col("sentiment").cast("bigint").alias("sentiment"), F.array_join("topics", ",").alias("topics"),
        F.md5("content").alias("content_md5"))


@query(
    "merged_chain_errors",
    """
    SELECT folder, 't' || (conv_id // 3) || '_annotations.json' AS annotation_file,
           CASE WHEN conv_id % 7 = 0 THEN 'AnnotationsNotList' ELSE 'InvalidAnnotationJSON' END AS error_type
    FROM (SELECT DISTINCT conv_id, folder FROM v_threads)
    WHERE conv_id % 5 <> 4 AND (conv_id % 7 = 0 OR conv_id % 11 = 0)""",
    [v.V_THREADS],
)
def merged_chain_errors(spark, sf):
    data, notes = _chain_texts(spark, sf)
    name = th.file_name(F.col("path")).alias("name")
    states = lb.inspect_annotations(notes.select(name, "folder", "json"), "name", "json", "folder")
    files = lb.inspect_data(data.select(name, "folder", "json"), "name", "json", "folder")
    return lb.merge_errors(states, files, with_key=True).select(
        F.substring_index("key", "/", 1).alias("folder"), "annotation_file", "error_type")
