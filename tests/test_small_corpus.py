"""A small invented corpus whose totals are counted by hand, through the jobs a user runs."""

import json

import pytest

from threadlens import __main__ as jobs
from threadlens import config
from threadlens.sources.threads import read_typed

# folder, file, searched title, entries as (id, author, date, content)
THREADS = [
    ("suriye_titles_data", "s1", "suriyeli komşular", [
        ("1", "ayşe", "01.02.2014 10:00", "suriyeli bir aile"),
        ("2", "berk", "03.02.2014 11:30 ~ 12:00", "suri derler"),
        ("3", "ayşe", "09.05.2016 09:00", "dün gece")]),
    ("suriye_titles_data", "s2", "yardım parası", [("4", "cem", "11.11.2016 23:59", "para yok")]),
    ("rus_titles_data", "r1", "rus edebiyatı", [
        ("5", "berk", "30.06.2016 08:15", "uzun kış"), ("6", "deniz", "31.02.2016 08:15", "olmayan gün"),
        ("7", "deniz", "", "tarihsiz")]),
    ("gocmen_titles_data", "g1", "göçmen ve mülteci", [("8", "ece", "05.01.2020 00:00", "sınır"), ("9", "ece", "06.01.2020 00:00", "")]),
]


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    root = tmp_path_factory.mktemp("small")
    for folder, name, title, entries in THREADS:
        (root / folder).mkdir(exist_ok=True)
        thread = {"scrape_info": {"input": title, "total_entries": len(entries)}, "entries": [
            {"title": title, "entry_id": i, "author": a, "date": d, "content": c, "has_external_url": i == "1"} for i, a, d, c in entries]}
        (root / folder / f"{name}.json").write_text(json.dumps(thread, ensure_ascii=False), encoding="utf-8")
    (root / "rus_titles_data" / "broken.json").write_text('{"entries": [', encoding="utf-8")
    return root


def run(spark, *argv):
    args = jobs.parser().parse_args([*map(str, argv)])
    jobs.run(spark, args)


def csv(spark, path):
    return sorted(tuple(r) for r in spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(str(path)).collect())


@pytest.mark.parametrize("large", [[], ["--large"]])
def test_counts_and_folders(spark, corpus, tmp_path, large):
    threads = [f"{corpus}/{f}/*.json" for f in ("suriye_titles_data", "rus_titles_data", "gocmen_titles_data")]
    run(spark, "counts", "--threads", *threads, *large, "--out", tmp_path / "counts")
    summary = spark.read.option("header", True).option("inferSchema", True).csv(f"{tmp_path}/counts/summary").collect()
    assert sorted((r.title, r.num_entries, r.title_token_count, r.entry_token_count) for r in summary) == [
        ("göçmen ve mülteci", 2, 3, 1), ("rus edebiyatı", 3, 2, 5), ("suriyeli komşular", 3, 2, 7), ("yardım parası", 1, 2, 2)]
    assert [(p.rpartition("/")[2], why) for p, why in csv(spark, f"{tmp_path}/counts/unreadable")] == [("broken.json", "InvalidDataJSON")]
    run(spark, "folders", "--threads", *threads, *large, "--out", tmp_path / "folders")
    rows = spark.read.option("header", True).option("inferSchema", True).csv(f"{tmp_path}/folders/folders").collect()
    # the broken file is a title without entries
    assert {(r.label.split()[0], r.titles, r.entries) for r in rows} == {
        ("Suriye", 2, 4), ("Rus", 2, 3), ("Göçmen", 1, 2), ("Total", 5, 9)}


def test_descriptives(spark, corpus, tmp_path):
    run(spark, "descriptives", "--threads", f"{corpus}/*/*.json", "--out", tmp_path)
    assert csv(spark, tmp_path / "timeline") == [
        ("gocmen_titles_data", "2020", "2"), ("rus_titles_data", "2016", "1"), ("suriye_titles_data", "2014", "1"),
        ("suriye_titles_data", "2016", "2")]  # the strict layout loses the edited entry
    assert csv(spark, tmp_path / "titles") == [("gocmen_titles_data", "1"), ("rus_titles_data", "1"), ("suriye_titles_data", "2")]


def test_typed_table_and_authors(spark, corpus, tmp_path):
    sources = [("suriye", "suriye_titles_data/*.json", False), ("rus", "rus_titles_data/*.json", False)]
    from threadlens.plans import reports
    from threadlens.sinks.tables import write_typed

    tables = reports.typed_tables(spark, str(corpus), sources)
    write_typed(tables["entries"], f"{tmp_path}/typed")
    rows = {r.entry_id: r for r in read_typed(spark, f"{tmp_path}/typed").collect()}
    assert sorted(rows) == ["1", "2", "3", "4", "5", "6", "7"]
    assert rows["2"].date == "2014-02-03T11:30:00" and rows["6"].date is None and rows["7"].date is None
    assert rows["1"].has_external_url and not rows["2"].has_external_url and rows["1"].sentiment == -1
    assert tables["unreadable"].count() == 1
    run(spark, "authors", "--typed", tmp_path / "typed", "--out", tmp_path / "authors")
    assert csv(spark, tmp_path / "authors/authors") == [("ayşe", "2"), ("berk", "2"), ("cem", "1"), ("deniz", "2")]


def test_frames(spark, corpus, tmp_path):
    run(spark, "frames", "--threads", f"{corpus}/*/*.json", "--out", tmp_path)
    rows = spark.read.option("header", True).option("inferSchema", True).csv(f"{tmp_path}/frame_counts").collect()
    found = {(r.origin_folder, name): r[name] for r in rows for name in config.FRAMES if r[name]}
    # "yardım parası" counts once for economy (yardım, para) and once for solidarity (yardım)
    assert found == {("suriye_titles_data", "economy"): 1, ("suriye_titles_data", "solidarity"): 1}
