import json

import pytest
from pyspark.sql import functions as F

from threadlens.schema import TYPED_ENTRY
from threadlens.sinks.tables import annotation_rows, read_csv, write_annotations, write_csv, write_typed
from threadlens.plans import reports
from threadlens.sinks.threads import nest_entries, thread_json, write_thread_lines, write_threads
from threadlens.sources import threads as th
from threadlens.sources.annotations import latest_annotations, read_annotations, read_written_annotations
from threadlens.sources.titles import read_title_lists
from threadlens.streaming.ingest import ingest_new, read_rollups


def _entry(i, **over):
    base = {
        "title": "t", "entry_id": str(i), "author": f"a{i}", "date": "18.06.2016 15:07 ~ 15:09",
        "content": f"metin {i}", "has_external_url": i % 2 == 0, "sentiment_numeric": 2, "categories": ["XENO"],
    }
    base.update(over)
    return {k: x for k, x in base.items() if x is not ...}


def _write(folder, name, data):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(data if isinstance(data, str) else json.dumps(data, ensure_ascii=False), encoding="utf-8")


@pytest.fixture
def corpus(tmp_path):
    folder = tmp_path / "kuzey_titles_data"
    _write(folder, "good.json", {"scrape_info": {"input": "Başlık Bir", "total_entries": 2, "filters": []},
                                 "entries": [_entry(1), _entry(2, title=..., author=..., content=..., date=...,
                                                               has_external_url=..., sentiment_numeric=...,
                                                               categories=...)]})
    _write(folder, "number.json", {"scrape_info": {"input": "iki"}, "entries": [_entry(3, entry_id=33)]})
    _write(folder, "empty.json", {"scrape_info": {"input": "boş"}, "entries": []})
    _write(folder, "none.json", {"scrape_info": {"input": "yok"}})
    _write(folder, "object.json", {"scrape_info": {"input": "x"}, "entries": {"a": 1}})
    _write(folder, "cut.json", '{"scrape_info": {"input": "y"}, "entries": [{"title"')
    return folder


def test_scan_fills_defaults_and_quarantines(spark, corpus):
    good, bad = th.split_readable(th.read_threads(spark, f"{corpus}/*.json"))
    problems = {r.path.rsplit("/", 1)[1]: r.problem for r in bad.select("path", "problem").collect()}
    assert problems == {"object.json": "EntriesNotList", "cut.json": "InvalidDataJSON"}
    rows = {r.entry_id: r for r in th.scan_entries(good, "kuzey", True).collect()}
    assert set(rows) == {"1", "2", "33"}
    assert rows["2"].title == "Başlık Bir" and rows["2"].author == "" and rows["2"].content == ""
    assert rows["2"].date is None and rows["2"].sentiment is None and rows["2"].topics == []
    assert rows["1"].sentiment == 2 and rows["1"].topics == ["XENO"] and rows["1"].date.minute == 7
    assert [rows[k].has_external_url for k in ("1", "2", "33")] == [False, False, False]
    bare = {r.entry_id: r for r in th.scan_entries(good, "kuzey", False).collect()}
    assert bare["1"].sentiment is None and bare["1"].topics == []


def test_text_and_file_reading_agree(spark, corpus):
    texts = spark.read.text(f"{corpus}/*.json", wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    a = th.parse_threads(texts, "value")
    b = th.read_threads(spark, f"{corpus}/*.json")

    def view(df):
        good, bad = th.split_readable(df)
        entries = th.scan_entries(good, "k", True).drop("path")
        return sorted(map(str, entries.collect())), sorted(r.problem for r in bad.collect())

    assert view(a) == view(b)


def test_folder_scan_titles(spark, corpus):
    good, _ = th.split_readable(th.read_threads(spark, f"{corpus}/*.json"))
    by_file = {(r.origin_folder, r.title) for r in th.scan_folders(good, "file").collect()}
    assert by_file == {("kuzey_titles_data", "good.json"), ("kuzey_titles_data", "number.json")}
    by_thread = {r.title for r in th.scan_folders(good).collect()}
    assert by_thread == {"başlık bir", "iki"}


def test_thread_summary(spark, corpus):
    good, _ = th.split_readable(th.read_threads(spark, f"{corpus}/*.json"))
    rows = {r.title: r for r in th.summarise_threads(good, ["path"]).collect()}
    assert set(rows) == {"Başlık Bir", "iki", "boş", "yok"}
    one = rows["Başlık Bir"]
    assert (one.date, one.num_entries, one.title_token_count, one.entry_token_count) == (
        "18.06.2016 15:07 ~ 15:09", 2, 2, 2,
    )
    assert rows["yok"].num_entries == 0 and rows["boş"].date == ""


def test_polymorphic_root(spark, tmp_path):
    _write(tmp_path / "p", "object.json", {"entries": [{"entry_id": "1", "content": "a"}, {"id": 2, "content": "b"},
                                                       {"entry_id": "1", "content": "c"}, {"content": "lost"}]})
    _write(tmp_path / "p", "list.json", [{"entry_id": " 7 ", "content": "x"}, {"entry_id": "", "id": "8", "content": "y"}])
    rows = th.read_polymorphic(spark, f"{tmp_path}/p/*.json").collect()
    got = {r.path.rsplit("/", 1)[1][:1] + r.entry_id: r.content for r in rows}
    assert got == {"o1": "c", "o2": "b", "l7": "x", "l8": "y"}
    first = {r.entry_id: r.pos for r in rows if "object" in r.path}
    assert first["1"] < first["2"]


def test_annotations_last_wins(spark, tmp_path):
    _write(tmp_path / "a", "x_annotations.json", [
        {"entry_id": "1", "sentiment_numeric": 1, "categories": ["HATE"]}, {"sentiment_numeric": 5},
        {"entry_id": 1, "sentiment_numeric": 4, "categories": ["HUMAN"]}, {"entry_id": "2", "sentiment_numeric": 3}])
    latest = latest_annotations(read_annotations(spark, f"{tmp_path}/a/*.json"), ["path", "entry_id"])
    assert {r.entry_id: (r.sentiment_numeric, r.categories) for r in latest.collect()} == {
        "1": ("4", ["HUMAN"]), "2": ("3", None),
    }


@pytest.mark.parametrize("encoding", ["utf-8", "utf-16", "latin-1"])
def test_title_list_encodings(spark, tmp_path, encoding):
    words = ["çok güzel", "# not this", "", "  iki  ", "ölü"] if encoding != "latin-1" else ["çok güzel", "ölü ü"]
    (tmp_path / "list.txt").write_bytes("\n".join(words).encode(encoding))
    titles = read_title_lists(spark, str(tmp_path / "list.txt")).orderBy("pos").collect()
    assert [r.title for r in titles] == [w.strip() for w in words if w.strip() and not w.startswith("#")]


def test_typed_table_round_trip(spark, corpus, tmp_path):
    good, _ = th.split_readable(th.read_threads(spark, f"{corpus}/*.json"))
    entries = th.scan_entries(good, "kuzey", True)
    write_typed(entries, f"{tmp_path}/typed")
    back = th.read_typed(spark, f"{tmp_path}/typed")
    assert back.schema.fieldNames() == TYPED_ENTRY.fieldNames()
    rows = {r.entry_id: r for r in back.collect()}
    assert rows["2"].sentiment == -1 and rows["1"].sentiment == 2
    assert rows["1"].date == "2016-06-18T15:07:00" and rows["2"].date is None
    plan = back.filter("category = 'kuzey'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(category" in plan


def test_csv_round_trip_keeps_quotes_and_breaks(spark, tmp_path):
    df = spark.createDataFrame([("a \"q\", b", "line\nbreak"), ("c\\", "d")], "x string, y string")
    write_csv(df, f"{tmp_path}/csv")
    assert sorted(read_csv(spark, f"{tmp_path}/csv", df.schema).collect()) == sorted(df.collect())


def test_rebuild_and_rescan(spark, tmp_path):
    """scan(rebuild(scan(x))) = scan(x), with threads longer than one part."""
    rows = [(t, p, f"id{t}-{p}", f"içerik {p}", "18.06.2016 15:07") for t in range(3) for p in range(t * 4 + 1)]
    df = spark.createDataFrame(rows, "input string, pos bigint, entry_id string, content string, date string")
    nested = nest_entries(df, ["input"], ["entry_id", "content", "date"], part_size=4)
    assert nested.agg(F.max(F.size("entries"))).first()[0] == 4
    write_thread_lines(thread_json(nested, F.struct("input")), f"{tmp_path}/lines")
    back, bad = th.split_readable(th.read_threads(spark, f"{tmp_path}/lines", lines=True))
    assert bad.count() == 0
    again = th.scan_entries(back, "x", False).select(F.col("title").alias("input"), "pos", "entry_id", "content")
    assert sorted(map(tuple, again.collect())) == sorted((str(t), p, i, c) for t, p, i, c, _ in rows)


def test_optional_fields_survive_the_rebuild(spark, tmp_path):
    quoted = {"type": "quote", "title": "q", "entry_id": "9", "author": "z", "date": "", "content": "c"}
    _write(tmp_path / "r", "a.json", {"scrape_info": {"input": "a"}, "entries": [
        _entry(1, referenced_content=[quoted], referenced_entry_ids=["9"]), _entry(2)]})
    rows = th.explode_entries(th.read_threads(spark, f"{tmp_path}/r/*.json"))
    flat = rows.select("path", "scrape_info", "pos", "entry.*")
    fields = [c for c in flat.columns if c not in ("path", "scrape_info", "pos")]
    nested = nest_entries(flat, ["path"], fields, carried=["scrape_info"])
    out = json.loads(thread_json(nested, F.col("scrape_info")).first().json)
    assert out["entries"][0]["referenced_content"][0]["entry_id"] == "9"
    assert "referenced_content" not in out["entries"][1] and out["scrape_info"]["input"] == "a"


def test_annotation_output(spark, tmp_path):
    df = spark.createDataFrame([("f", "1", 2, ["HATE"])], "name string, entry_id string, sentiment_numeric int, categories array<string>")
    assert annotation_rows(df, "name").first().annotation_file == "f_annotations.json"
    more = df.unionByName(spark.createDataFrame([("g", str(i), 3, ["HUMAN", "ECON"]) for i in range(17)], df.schema))
    write_annotations(more, "name", f"{tmp_path}/ann")
    back = read_written_annotations(spark, f"{tmp_path}/ann").collect()
    assert sorted((r.annotation_file, r.entry_id, r.sentiment_numeric, tuple(r.categories)) for r in back) == sorted(
        (r.name + "_annotations.json", r.entry_id, r.sentiment_numeric, tuple(r.categories)) for r in more.collect())


def test_one_badly_typed_field_costs_that_field(spark, tmp_path):
    _write(tmp_path / "x", "a.json", {"scrape_info": {"input": "a", "filters": 7}, "entries": [
        _entry(1, categories="HATE"), _entry(2, categories={"a": 1}, referenced_content="q"), _entry(3, categories=None)]})
    good, bad = th.load_threads(spark, f"{tmp_path}/x/*.json")
    assert bad.count() == 0
    topics = {r.entry_id: r.topics for r in th.scan_entries(good, "k", True).collect()}
    assert topics["1"] == ["HATE"] and topics["3"] == [] and len(topics) == 3


def test_long_threads_count_once(spark, tmp_path):
    """A thread in several stored parts is one title wherever it is counted, under its file name."""
    rows = [("file:/c/red/long.json", p, f"i{p}", "x y", "18.06.2016 15:07", "Long") for p in range(23)]
    rows += [("file:/c/red/short.json", 0, "s", "x", "18.06.2016 15:07", "Short")]
    df = spark.createDataFrame(rows, "path string, pos bigint, entry_id string, content string, date string, title string")
    nested = nest_entries(df, ["path"], ["entry_id", "content", "date", "title"], part_size=5)
    assert nested.count() == 6
    write_threads(thread_json(nested, F.struct(F.lit("q").alias("input"))), f"{tmp_path}/t")
    stats = {(r.level, r.category): (r.num_titles, r.num_entries)
             for r in reports.count_tables(spark, [f"{tmp_path}/t"], stored=True)["stats"].collect()}
    assert stats[("overall", "ALL")] == (2, 24) and stats[("category", "red")][1] == 24
    folders = reports.folder_table(spark, [f"{tmp_path}/t"], {"red": "Red"}, stored=True).collect()
    assert {(r.label, r.titles, r.entries) for r in folders} == {("Red", 2, 24), ("Total", 2, 24)}
    entries = reports.folder_entries(spark, [f"{tmp_path}/t"], "file", stored=True)
    assert {(r.title, r.pos) for r in entries.collect()} == {("long.json", p) for p in range(23)} | {("short.json", 0)}


def test_ingest_reads_each_file_once(spark, corpus, tmp_path):
    target, place = f"{tmp_path}/table", f"{tmp_path}/progress"

    def run(source=corpus, to=target):
        ingest_new(spark, str(source), "kuzey", True, to, place).awaitTermination()
        return spark.read.parquet(f"{to}/entries").count()

    assert run() == 3
    assert run() == 3
    _write(corpus, "later.json", {"scrape_info": {"input": "z"}, "entries": [_entry(50)]})
    assert run() == 4
    # What the batches left gives the same tables as all entries, after each of them.
    for name in ("even_later.json", "last.json"):
        _write(corpus, name, {"scrape_info": {"input": name}, "entries": [_entry(len(name)), _entry(90 + len(name))]})
        run()
        rolled = read_rollups(spark, target)
        entries = spark.read.parquet(f"{target}/entries")
        dated = entries.filter("date IS NOT NULL").withColumn("year", F.year(F.to_timestamp("date")))
        want = {tuple(r) for r in dated.groupBy("category", "year").count().collect()}
        assert {tuple(r) for r in rolled["timeline"].collect()} == want
        assert {tuple(r) for r in rolled["titles"].collect()} == {
            tuple(r) for r in entries.groupBy("category").agg(F.count_distinct("title")).collect()}
    assert run() == 8
    bad = spark.read.parquet(f"{target}/unreadable").collect()
    assert sorted(r.problem for r in bad) == ["EntriesNotList", "InvalidDataJSON"]
    # The same progress folder serves other targets and sources.
    assert run(to=f"{tmp_path}/second") == 8
    _write(tmp_path / "other", "one.json", {"scrape_info": {"input": "o"}, "entries": [_entry(60)]})
    assert run(source=tmp_path / "other") == 9
