"""Large thread files in splits, and one file per thread, against the plain reader."""

import json
import os

import pytest
from pyspark.sql import functions as F

from threadlens.plans import reports
from threadlens.sinks.files import write_thread_files
from threadlens.sinks.threads import entry_fields, nest_entries, thread_info
from threadlens.sources import threads as th
from threadlens.sources.large import file_pieces, split_thread_files


def entry(i, text):
    return {"entry_id": str(i), "content": text, "author": "a{b}", "date": "01.02.2015 10:00", "categories": ["X", "Y"]}


TEXTS = ["plain", 'q"uo"te', "br{a}ce [s] }{", "back\\slash\\", 'end\\"', "tab\tnew\nline", "çğ 👍🏽 }", "", '"entries": [{"a": 1}]', "\\\\\"}"]


@pytest.fixture
def corpus(tmp_path):
    folder = tmp_path / "data" / "some folder"
    folder.mkdir(parents=True)
    info = {"input": "a title }", "total_entries": 3, "filters": [{"k": "v"}, {"k": ["w"]}]}
    thread = {"scrape_info": info, "entries": [entry(i, TEXTS[i % len(TEXTS)] * (1 + i % 3)) for i in range(57)]}
    write = lambda name, text: (folder / f"{name}.json").write_text(text, encoding="utf-8")
    write("compact", json.dumps(thread, separators=(",", ":")))
    write("pretty", json.dumps(thread, indent=2, ensure_ascii=False) + "\n")
    write("ascii", json.dumps(thread))
    write("entries_first", json.dumps({"entries": thread["entries"], "title": "t", "scrape_info": info}))
    write("one", json.dumps({"scrape_info": {"input": "x"}, "entries": [entry(0, "only")]}) + " \n\n")
    write("none", json.dumps({"scrape_info": info, "entries": []}))
    write("no_entries", json.dumps({"scrape_info": info}))
    write("other_list", json.dumps({"log": [{"a": 1}, {"b": 2}], "entries": thread["entries"][:3]}))
    write("list_behind", json.dumps({"entries": thread["entries"][:3], "log": [{"a": 1}]}))
    write("nested", json.dumps({"x": {"entries": [{"entry_id": "no"}]}, "entries": thread["entries"][:2]}))
    write("object", json.dumps({"scrape_info": info, "entries": {"a": {"b": 1}}}))
    write("nulls", json.dumps({"scrape_info": None, "entries": [entry(1, "x"), {"entry_id": None}, {}]}))
    write("cut_short", json.dumps(thread)[:-1])
    write("cut_in_text", json.dumps(thread)[:900])
    write("too_many", json.dumps(thread) + "}")
    write("words", "this is no JSON")
    write("empty_object", "{}")
    return folder


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "700b", "spark.sql.files.openCostInBytes": "1b", "spark.sql.files.minPartitionNum": "1"}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name in names:
        spark.conf.unset(name)


def rows_of(threads):
    rows = th.explode_entries(threads).select(
        F.element_at(F.split("path", "/"), -1).alias("file"), "pos", "scrape_info.input", "scrape_info.total_entries",
        F.col("scrape_info.filters").cast("string").alias("filters"), "entry.entry_id", "entry.content", "entry.author",
        F.col("entry.categories").cast("string").alias("categories"))
    return sorted((tuple(r) for r in rows.collect()), key=str)


def problems_of(bad):
    return sorted((r.path.rpartition("/")[2], r.problem) for r in bad.select("path", "problem").collect())


@pytest.mark.parametrize("part_size", [5000, 7, 1])
def test_splits_give_the_same_rows(spark, corpus, small_splits, part_size):
    paths = f"{corpus}/*.json"
    good, bad = th.load_threads(spark, paths)
    split = split_thread_files(spark, paths, part_size)
    got, worse = th.split_readable(th.parse_threads(split, "json"))
    assert rows_of(got) == rows_of(good)
    assert problems_of(worse) == problems_of(bad) != []
    sizes = {(r.path.rpartition("/")[2], r.part): r.n for r in got.select("path", "part", F.size("entries").alias("n")).collect()}
    for name in ("compact.json", "pretty.json", "entries_first.json"):
        assert [sizes[name, p] for p in range(-(-57 // part_size))] == [min(part_size, 57 - a) for a in range(0, 57, part_size)]


def test_a_file_is_read_by_many_tasks(spark, corpus, small_splits):
    path = f"{corpus}/compact.json"
    assert file_pieces(spark, path).select("block").distinct().count() > 5
    plain, large = (reports.count_tables(spark, [path], large=x)["summary"].collect() for x in (False, True))
    assert plain == large and plain[0].num_entries == 57


def merged_parts(spark, corpus, part_size):
    good, _ = th.load_threads(spark, [f"{corpus}/compact.json", f"{corpus}/one.json", f"{corpus}/none.json", f"{corpus}/nulls.json"])
    entries = th.explode_entries(good, ["path"]).select("path", "scrape_info", "pos", "entry.*")
    return nest_entries(entries, ["path"], entry_fields(), carried=["scrape_info"], part_size=part_size)


def file_of():
    return F.concat(F.lit("below/"), F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.json$", "_merged.json"))


@pytest.mark.parametrize("part_size", [5000, 10])
def test_one_valid_file_per_thread(spark, corpus, tmp_path, part_size):
    out = f"{tmp_path}/out"
    write_thread_files(merged_parts(spark, corpus, part_size), file_of(), thread_info(), out)
    assert sorted(os.listdir(out)) == ["below"]
    assert sorted(os.listdir(f"{out}/below")) == ["compact_merged.json", "nulls_merged.json", "one_merged.json"]
    with open(f"{out}/below/compact_merged.json", encoding="utf-8") as file:
        made = json.load(file)
    with open(f"{corpus}/compact.json", encoding="utf-8") as file:
        given = json.load(file)
    assert made["scrape_info"] == given["scrape_info"]
    assert [(e["entry_id"], e["content"], e["categories"]) for e in made["entries"]] == [
        (e["entry_id"], e["content"], e["categories"]) for e in given["entries"]]
    again = lambda rows: [(r[0].replace("_merged", ""), *r[1:]) for r in rows]
    good, bad = th.load_threads(spark, f"{out}/below/*.json")
    names = ("compact.json", "nulls.json", "one.json")
    want = [r for r in rows_of(th.load_threads(spark, f"{corpus}/*.json")[0]) if r[0] in names]
    assert again(rows_of(good)) == want and bad.count() == 0
    assert not [n for n in os.listdir(tmp_path) if n.startswith(".")]
    with pytest.raises(Exception, match="exists"):
        write_thread_files(merged_parts(spark, corpus, part_size), file_of(), thread_info(), out)
    one = merged_parts(spark, corpus, part_size).filter("path LIKE '%one.json'")
    write_thread_files(one, file_of(), thread_info(), f"file://{out}", overwrite=True)
    assert os.listdir(f"{out}/below") == ["one_merged.json"]


def test_an_aborted_job_leaves_nothing(spark, corpus, tmp_path):
    out = f"{tmp_path}/out"
    for file in (F.lit("same.json"), F.lit("../up.json"), F.lit(None).cast("string")):
        with pytest.raises(Exception):
            write_thread_files(merged_parts(spark, corpus, 5000), file, thread_info(), out)
    assert sorted(os.listdir(tmp_path)) == ["data"]
    write_thread_files(merged_parts(spark, corpus, 5000), file_of(), thread_info(), out)
    with pytest.raises(Exception):
        write_thread_files(merged_parts(spark, corpus, 5000), F.lit("same.json"), thread_info(), out, overwrite=True)
    assert sorted(os.listdir(f"{out}/below")) == ["compact_merged.json", "nulls_merged.json", "one_merged.json"]
