import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadlens import config
from threadlens.functions import lookup
from threadlens.operators.score_store import read_scores, stored_scores
from threadlens.operators import (
    frames, frequent, joins, labels, mentions, ranking, regression, scoring, shape, summaries, timelines,
)


def test_lookup_join_with_hot_and_null_keys(spark):
    rows = [("hot", i) for i in range(300)] + [(None, i) for i in range(200)] + [(f"k{i}", i) for i in range(50)]
    left = spark.createDataFrame(rows, "k string, n int")
    right = spark.createDataFrame([("hot", 1), ("k3", 2), ("other", 3)], "k string, v int")
    hot = spark.createDataFrame([("hot",)], "k string")
    got = joins.lookup_join(left, right, ["k"], ["n"], salts=8, probe=hot)
    want = sorted((str(k), n, str({"hot": 1, "k3": 2}.get(k))) for k, n in rows)
    assert sorted((str(r.k), r.n, str(r.v)) for r in got.collect()) == want
    # the same without any hot key found, and without looking for one
    for probe in (True, False):
        cold = joins.lookup_join(left, right, ["k"], ["n"], probe=probe)
        assert sorted((str(r.k), r.n, str(r.v)) for r in cold.collect()) == want


def test_heavy_keys_finds_the_hot_one(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    found = joins.heavy_keys(df, ["k"], fraction=0.1, min_sampled=100)
    assert [r.k for r in found.collect()] == ["hot"]


def test_number_rows_across_ranges(spark):
    random.seed(3)
    rows = [(k, p) for k in ("big", "small") for p in random.sample(range(1000), 200 if k == "big" else 3)]
    got = joins.number_rows(spark.createDataFrame(rows, "k string, pos int"), ["k"], "pos", bucket_rows=50)
    want = {(k, p): i + 1 for k in ("big", "small") for i, p in enumerate(sorted(p for j, p in rows if j == k))}
    assert {(r.k, r.pos): r.rn for r in got.collect()} == want


def test_keep_found_drops_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, x string")
    assert [(r.i, r.y) for r in shape.keep_found(df, "y", F.upper("x")).collect()] == [(1, "A")]


def test_dense_grid_rows_and_zeros(spark):
    cells = spark.createDataFrame(
        [("a", 2010, 3), ("a", 2012, 1), ("b", 2011, 2), (None, 2011, 9), ("c", 1999, 5)], "g string, year int, n bigint"
    )
    rows = shape.dense_grid(cells, "g", "n", 2010, 2025).collect()
    assert len(rows) == 2 * 16
    got = {(r.g, r.year): r.n for r in rows}
    assert got["a", 2010] == 3 and got["a", 2011] == 0 and got["b", 2011] == 2


def test_pivot_averages_duplicates(spark):
    df = spark.createDataFrame([(2010, "a", 1), (2010, "a", 2), (2011, "b", 4)], "year int, g string, n int")
    rows = {r.year: (r.a, r.b) for r in shape.to_wide(df, "year", "g", "n", ["a", "b"]).collect()}
    assert rows == {2010: (1.5, 0.0), 2011: (0.0, 4.0)}


def test_counted_flags_equal_melted_flags(spark):
    df = spark.createDataFrame([(2010, True, False), (2010, True, True), (2011, False, False)], "year int, a boolean, b boolean")
    quick = shape.count_flags(df, ["year"], ["a", "b"], "name")
    slow = shape.melt_flags(df, ["year"], ["a", "b"], "name").filter("present").groupBy("year", "name").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, quick.select("year", "name", "n").collect())) == sorted(map(tuple, slow.collect()))


ENTRIES = [
    ("gocmen_titles_data", "göçmen ve mülteci suç", 2015), ("gocmen_titles_data", "göçmen ve mülteci suç", 2016),
    ("gocmen_titles_data", "göçmen ve mülteci suç", 2016), ("gocmen_titles_data", "sığınmacı vergi", 2016),
    ("rus_titles_data", "rus kadın", 2016), ("rus_titles_data", "rus kadın", 2009), ("x", "kadın", 2016),
]


@pytest.fixture
def entries(spark):
    return spark.createDataFrame(ENTRIES, "origin_folder string, title string, year int")


def test_frames_on_distinct_titles(entries):
    titles = frames.distinct_titles(entries)
    assert titles.count() == 6
    framed = frames.frame_titles(titles, config.FRAMES)
    counts = {r.origin_folder: r for r in frames.frame_counts(framed, "origin_folder", list(config.FRAMES)).collect()}
    assert counts["gocmen_titles_data"].crime == 2 and counts["gocmen_titles_data"].economy == 1
    assert counts["rus_titles_data"].gender == 2
    block = framed.filter(F.col("origin_folder") == config.MIGRANT_FOLDER)
    sub = frames.frame_counts_by_subgroup(block, config.SUBGROUP_STEMS, list(config.FRAMES))
    got = {r.subgroup: (r.crime, r.economy) for r in sub.collect()}
    assert got == {"gocmen": (2, 0), "multeci": (2, 0), "siginmaci": (0, 1)}
    shares = {r.subgroup: r.crime for r in frames.frame_shares(sub, "subgroup", list(config.FRAMES)).collect()}
    assert shares["gocmen"] == 1.0 and shares["siginmaci"] == 0.0
    ratio = frames.frame_ratio(block, config.SUBGROUP_STEMS, list(config.FRAMES), 2010, 2025)
    rows = {(r.subgroup, r.year, r.frame): (r.n, r.total, r.ratio) for r in ratio.collect()}
    assert rows["siginmaci", 2016, "economy"] == (1, 1, 1.0)
    assert ("siginmaci", 2016, "crime") not in rows


def test_fan_out_equals_the_many_to_many_join(entries):
    titles = frames.distinct_titles(entries)
    per_entry = entries.select("title")
    slow = titles.join(per_entry, "title", "left").groupBy("origin_folder", "title", "year").agg(F.count("*").alias("n_rows"))
    quick = frames.title_subgroups_fanned(entries, config.SUBGROUP_STEMS)
    pick = lambda df: sorted(map(tuple, df.select("origin_folder", "title", "year", "n_rows").collect()))
    assert pick(quick) == pick(slow)
    once = frames.title_subgroups(titles, config.SUBGROUP_STEMS)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, quick.select(*once.columns).collect()))
    big = {r.title: r.n_rows for r in quick.filter("year = 2016").collect()}
    assert big["göçmen ve mülteci suç"] == 3  # two years x three entries in all


def test_title_years(entries):
    rows = frames.title_years(frames.distinct_titles(entries), entries).collect()
    assert sorted((r.title, r.year) for r in rows) == sorted({(t, y) for _, t, y in ENTRIES})


def test_timelines(entries):
    assert {(r.origin_folder, r.year): r.entries for r in timelines.timeline(entries, "origin_folder").collect()} == {
        (f, y): n for (f, y), n in Counter((f, y) for f, _, y in ENTRIES).items()
    }
    labelled = timelines.labelled_timeline(entries, "origin_folder", config.GROUP_LABELS).collect()
    assert "x" not in {r.label for r in labelled} and None not in {r.label for r in labelled}
    flagged = shape.add_flags(entries, "title", config.SUBGROUP_STEMS)
    sub = timelines.subgroup_timeline(flagged, list(config.SUBGROUP_STEMS))
    assert {(r.subgroup, r.year): r.entries for r in sub.collect()} == {
        ("gocmen", 2015): 1, ("gocmen", 2016): 2, ("multeci", 2015): 1, ("multeci", 2016): 2, ("siginmaci", 2016): 1,
    }
    main = timelines.labelled_timeline(entries, "origin_folder", config.GROUP_LABELS)
    grid = timelines.combined_timeline(main, sub, config.SUBGROUP_LABELS, 2010, 2025)
    assert grid.count() == 16 * 5


def test_corpus_stats_counts_titles_two_ways(spark):
    rows = [("a", "t", 1, 2, 3), ("a", "t", 2, 2, 4), ("b", "u", 5, 1, 6)]
    df = spark.createDataFrame(rows, "category string, title string, num_entries bigint, title_token_count bigint, entry_token_count bigint")
    got = [tuple(r) for r in summaries.ordered_stats(summaries.corpus_stats(df)).collect()]
    assert got == [("overall", "ALL", 3, 8, 5, 13, 18), ("category", "a", 1, 3, 4, 7, 11), ("category", "b", 1, 5, 1, 6, 7)]


def test_folder_summary_total(spark):
    df = spark.createDataFrame([("a", 2), ("a", None), ("b", 3), ("zz", 9)], "f string, n_entries int")
    rows = {r.label: (r.titles, r.entries) for r in summaries.folder_summary(df, "f", {"a": "A", "b": "B"}).collect()}
    assert rows == {"A": (2, 2), "B": (1, 3), "Total": (3, 5)}


def test_box_stats_match_numpy(spark):
    random.seed(5)
    data = {"a": [random.randrange(5, 60) for _ in range(200)] + [400, 500], "b": [7]}
    df = spark.createDataFrame([(g, "x" * n) for g, xs in data.items() for n in xs], "g string, content string")
    for r in summaries.length_boxstats(df, "g").collect():
        x = np.array(data[r.g])
        q1, q2, q3 = np.percentile(x, [25, 50, 75])
        inside = (x >= q1 - 1.5 * (q3 - q1)) & (x <= q3 + 1.5 * (q3 - q1))
        assert (r.q1, r.median, r.q3, r.total) == (q1, q2, q3, len(x))
        assert (r.whisker_low, r.whisker_high, r.outliers) == (x[inside].min(), x[inside].max(), (~inside).sum())


def test_crosstab_drops_nulls_and_fills_zeros(spark):
    df = spark.createDataFrame([("m", "a"), ("m", None), ("n", "b"), (None, "a")], "marker string, c string")
    got = {r.marker: (r.a, r.b) for r in summaries.crosstab(df, "marker", "c", ["a", "b"]).collect()}
    assert got == {"m": (1, 0), "n": (0, 1)}


def test_source_overlap(spark):
    df = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "a"), ("3", "c"), ("3", "c")], "id string, src string")
    got = {r.key: (r.n_rows, r.n_sources, r.sources) for r in summaries.source_overlap(df, F.col("id"), "src").collect()}
    assert got == {"1": (2, 2, ["a", "b"]), "3": (2, 1, ["c"])}


def test_ties_follow_the_key(spark):
    df = spark.createDataFrame([("g", t) for t in "bbaacc"], "g string, title string")
    rows = ranking.top_titles(df, "g", 2).orderBy("rank").collect()
    assert [(r.title, r.n) for r in rows] == [("a", 2), ("b", 2)]


def test_author_samples_are_repeatable(spark):
    df = spark.createDataFrame([(f"a{i % 4}", str(i)) for i in range(40)], "author string, entry_id string")
    top = ranking.top_authors(df, 2)
    first = sorted(map(tuple, ranking.author_samples(df, top, F.col("entry_id")).collect()))
    again = sorted(map(tuple, ranking.author_samples(df.repartition(5), top, F.col("entry_id")).collect()))
    assert first == again and len(first) == 6
    other = sorted(map(tuple, ranking.author_samples(df, top, F.col("entry_id"), seed=1).collect()))
    assert other != first


def test_top_k_is_cut_before_the_shuffle(spark):
    df = spark.createDataFrame([("g", t) for t in "abc"], "g string, title string")
    plan = ranking.top_titles(df, "g")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_long_rankings_are_cut_in_slots(spark):
    rows = [("g", (i * 7919) % 5000) for i in range(5000)] + [("h", i) for i in range(3)]
    df = spark.createDataFrame(rows, "g string, s int")
    got = joins.top_per_group(df, ["g"], [F.desc("s")], 1500, slots=4).collect()
    want = [("g", 4999 - i, i + 1) for i in range(1500)] + [("h", 2 - i, i + 1) for i in range(3)]
    assert sorted((r.g, r.s, r["rank"]) for r in got) == sorted(want)


def test_extremes_take_both_ends(spark):
    df = spark.createDataFrame([("g", float(i), str(i)) for i in range(10)] + [("g", None, "x")], "g string, s double, k string")
    got = ranking.extremes(df, "g", "s", "k", 2).collect()
    assert sorted((r.side, r.rank, r.s) for r in got) == [
        ("negative", 1, 0.0), ("negative", 2, 1.0), ("positive", 1, 9.0), ("positive", 2, 8.0),
    ]


def test_pack_batches(spark):
    rows = [("t", p * 3, f"e{p}", f"c{p}") for p in range(85)] + [("t", 1, "", "lost"), ("u", 0, "z", "c")]
    df = spark.createDataFrame(rows, "thread string, pos int, entry_id string, content string")
    got = {(r.thread, r.batch): r for r in labels.pack_batches(df, "thread").collect()}
    assert {k: r.n_entries for k, r in got.items()} == {("t", 0): 40, ("t", 1): 40, ("t", 2): 5, ("u", 0): 1}
    assert got["t", 1].entry_ids[0] == "e40"
    assert "ENTRY_ID: e84\nTEXT: c84" in got["t", 2].prompt
    tight = df.filter("entry_id <> ''").withColumn("pos", F.expr("pos div 3"))
    dense = labels.pack_batches(tight, "thread", dense=True)
    assert {(r.thread, r.batch): r for r in dense.collect()} == got


def test_responses_and_audit(spark):
    texts = [
        ("b1", '{"labels":[{"entry_id":"1","sentiment_numeric":"4","categories":"CRIME"}]}'),
        ("b2", 'text {"labels":[{"entry_id":2,"sentiment_numeric":9,"categories":["A","HATE","HATE","ECON","XENO"]},'
               '{"entry_id":" 2 "},{"entry_id":"77","categories":[" "]}]} end'),
        ("b3", "nothing"), ("b4", "}{"), ("b5", '{"x":1}'), ("b6", '{"labels":{}}'), ("b7", '{"labels":[]}'),
        ("b8", '[1]'), ("b9", '{"labels":[{"sentiment_numeric":1}]}'), ("b10", None),
    ]
    df = spark.createDataFrame(texts, "batch string, response string")
    parsed = labels.parse_responses(df, "response")
    assert {r.batch: r.status for r in parsed.collect()} == {
        "b1": "ok", "b2": "ok", "b3": "invalid_json", "b4": "invalid_json", "b5": "no_labels", "b6": "no_labels",
        "b7": "empty_labels", "b8": "no_labels", "b9": "empty_labels", "b10": "invalid_json",
    }
    clean = labels.normalise_labels(parsed, ["batch"])
    assert sorted((r.entry_id, r.sentiment_numeric, r.categories) for r in clean.collect()) == [
        ("1", 4, ["CRIME"]), ("2", 3, ["HATE", "HATE", "ECON"]), ("2", 3, ["NEUTRAL"]), ("77", 3, ["NEUTRAL"]),
    ]
    asked = spark.createDataFrame([("b1", "1"), ("b2", "2"), ("b3", "3")], "batch string, entry_id string")
    audit = {(r.entry_id, r.problem) for r in labels.audit_ids(asked, clean, ["batch"]).collect()}
    assert audit == {("2", "duplicate"), ("77", "unknown"), ("3", "missing")}


def test_merge_keeps_unmatched_and_counts(spark):
    entries = spark.createDataFrame([("f", 0, "1", 9), ("f", 1, "2", None), ("f", 2, None, None)],
                                    "file string, pos int, entry_id string, sentiment_numeric int")
    latest = spark.createDataFrame([("1", 4, ["ECON"])], "entry_id string, sentiment_numeric int, categories array<string>")
    merged = labels.merge_labels(entries, latest, spread_by=["file", "pos"])
    got = {r.pos: (r.sentiment_numeric, r.categories, r.merged) for r in merged.collect()}
    assert got == {0: (4, ["ECON"], True), 1: (None, None, False), 2: (None, None, False)}
    assert tuple(labels.merge_audit(merged, ["file"]).first()) == ("f", 1, 1)


def test_merge_errors_report_the_first_failing_check(spark):
    good_ann, good = '[{"entry_id": "1"}]', '{"entries": [{"entry_id": "1"}]}'
    cases = {
        "ok": (good_ann, good), "lost": (good_ann, None), "badann": ("[{", good), "baddata": (good_ann, "{"),
        "both": ("[{", "{"), "object": ('{"entry_id": "1"}', good), "dict": (good_ann, '{"entries": {"a": 1}}'),
        "root": (good_ann, "[1]"), "noid": (good_ann, '{"entries": [{"a": 1}, {"entry_id": "2"}, {"entry_id": null}]}'),
        "none": (good_ann, "{}"),
    }
    ann = spark.createDataFrame([(f"{k}_annotations.json", a) for k, (a, _) in cases.items()], "name string, json string")
    data = spark.createDataFrame([(f"{k}.json", d) for k, (_, d) in cases.items() if d], "name string, json string")
    a, d = labels.inspect_annotations(ann, "name", "json"), labels.inspect_data(data, "name", "json")
    got = Counter((r.data_file[:-5], r.error_type) for r in labels.merge_errors(a, d).collect())
    assert got == Counter({
        ("lost", "MissingDataFile"): 1, ("badann", "InvalidAnnotationJSON"): 1, ("baddata", "InvalidDataJSON"): 1,
        ("both", "InvalidAnnotationJSON"): 1, ("object", "AnnotationsNotList"): 1, ("dict", "EntriesNotList"): 1,
        ("root", "EntriesNotList"): 1, ("noid", "MissingEntryID"): 2,
    })
    assert labels.match_pairs(a, d).count() == len(cases) - 1
    assert [r.key for r in labels.unmatched(a, d).collect()] == ["lost"]


def test_new_titles(spark):
    titles = spark.createDataFrame([("Bir", 0), ("bir", 1), ("İki", 2), ("üç", 3)], "title string, pos int")
    done = spark.createDataFrame([("ÜÇ",)], "title string")
    assert [(r.title, r.pos) for r in labels.new_titles(titles, done).orderBy("pos").collect()] == [("Bir", 0), ("İki", 2)]
    exact = labels.new_titles(titles, done, fold_case=False)
    assert exact.count() == 4


def test_mention_tables(spark):
    df = spark.createDataFrame(
        [("suri", 2010, -1.0), ("suri", 2010, 0.5), ("suri", 2011, None), ("suriyeli", 2010, -0.2)],
        "marker string, year int, signed double",
    )
    rows = {r.marker: r for r in mentions.mention_descriptives(df).collect()}
    assert (rows["suri"].n, rows["suri"].mean_sent, rows["suri"].prop_neg, rows["suri"].prop_pos) == (3, -0.25, 0.5, 0.5)
    years = {(r.marker, r.year): (r.prop_neg, r.n) for r in mentions.negative_share_by_year(df).collect()}
    assert years["suri", 2011] == (None, 1) and years["suri", 2010] == (0.5, 2)
    one = spark.range(1).select(mentions.signed_score(F.lit("NEGATIVE"), F.lit(0.9)).alias("s")).first()
    assert one.s == -0.9


def test_lexicon_scores(spark):
    df = spark.createDataFrame([("1", "Good good bad"), ("2", "none"), ("3", ""), ("4", None)], "k string, content string")
    got = {r.k: r.compound for r in scoring.lexicon_scores(df, ["k"], {"good": 2.0, "bad": -1.0}).collect()}
    assert got["1"] == pytest.approx(3 / math.sqrt(9 + 15))
    assert got["2"] == got["3"] == got["4"] == 0.0


def test_model_failures_are_null_rows(spark):
    def load_fragile():
        def score(texts):
            if any("boom" in t for t in texts):
                raise ValueError("boom")
            return [("positive", float(len(t))) for t in texts]

        return score

    def load_missing():
        raise OSError("no such model")

    df = spark.createDataFrame([(i, "boom" if i == 5 else "x" * 600) for i in range(40)], "i int, content string")
    got = {r.i: (r.model_label, r.model_score) for r in scoring.model_scores(df, load_fragile, tasks=2, max_chars=512).collect()}
    assert got[5] == (None, None) and got[6] == ("positive", 512.0) and len(got) == 40
    scored = scoring.multi_model_scores(df, {"a": load_fragile, "b": load_missing})
    status = {r.model: (r.status, r.n) for r in scoring.model_status(scored, ["a", "b"]).collect()}
    assert status["a"] == ("ok", 40) and "no such model" in status["b"][0]
    assert scored.filter("b_label IS NOT NULL OR b_score IS NOT NULL").count() == 0
    assert scored.filter("i <> 5").agg({"a_score": "min"}).first()[0] == 600.0  # whole texts unless told otherwise


def _irls(x, y):
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        w = p * (1 - p)
        h = x.T @ (x * w[:, None])
        beta = beta + np.linalg.solve(h, x.T @ (y - p))
    return beta, np.sqrt(np.diag(np.linalg.inv(h)))


def test_logit_matches_irls_on_all_rows(spark):
    rng = np.random.default_rng(11)
    n = 3000
    flag, year = rng.integers(0, 2, n), rng.integers(2010, 2020, n)
    p = 1 / (1 + np.exp(-(0.4 - 0.9 * flag + 0.1 * (year - 2014))))
    y = (rng.random(n) < p).astype(int)
    rows = [(int(a), int(b), int(c), 1) for a, b, c in zip(y, flag, year)]
    df = spark.createDataFrame(rows, "neg int, flag int, year int, constant int")
    with pytest.warns(UserWarning, match="constant"):
        fit = regression.negativity_logit(df, "neg", ["flag", "constant"])
    got = {r.term: r for r in fit.collect()}
    x = np.column_stack([flag, year - year.mean(), np.ones(n)]).astype(float)
    beta, se = _irls(x, y.astype(float))
    for term, b, s in zip(("flag", "year_c", "intercept"), beta, se):
        assert got[term].estimate == pytest.approx(b, abs=1e-6)
        assert got[term].conf_low == pytest.approx(b - 1.96 * s, abs=1e-5)
        assert got[term].conf_high == pytest.approx(b + 1.96 * s, abs=1e-5)
    assert "constant" not in got


LOGIT = "y int, a int, b int, year int"


def _coded(rng, n):
    a, b, year = rng.integers(0, 2, n), rng.integers(0, 2, n), rng.integers(2005, 2020, n)
    p = 1 / (1 + np.exp(-(-1.0 + 1.5 * a - 0.7 * b + 0.05 * (year - 2012))))
    return [tuple(map(int, r)) for r in zip(rng.random(n) < p, a, b, year)]


@pytest.mark.parametrize("max_cells", [100_000, 3])
def test_logit_sums_in_driver_or_tasks(spark, max_cells):
    """Heavy cells, at whose shares of 0 or 1 nothing starts; the same numbers from both ways of summing."""
    rows = _coded(np.random.default_rng(3), 4000)
    df = spark.createDataFrame(rows, LOGIT).repartition(3)
    got = {r.term: r for r in regression.negativity_logit(df, "y", ["a", "b"], max_cells=max_cells).collect()}
    y, a, b, year = (np.array(c, float) for c in zip(*rows))
    beta, se = _irls(np.column_stack([a, b, year - year.mean(), np.ones(len(y))]), y)
    for term, x, s in zip(("a", "b", "year_c", "intercept"), beta, se):
        assert got[term].estimate == pytest.approx(x, abs=1e-8)
        assert got[term].conf_high - got[term].estimate == pytest.approx(1.96 * s, abs=1e-7)
        assert got[term].p_value == pytest.approx(math.erfc(abs(x / s) / math.sqrt(2)), abs=1e-9)


def _firth(x, y):
    """The highest point of the likelihood with Jeffreys' penalty, climbed by plain gradient steps on all rows."""
    beta = np.zeros(x.shape[1])
    for _ in range(200_000):
        p = 1 / (1 + np.exp(-x @ beta))
        w = p * (1 - p)
        inverse = np.linalg.inv(x.T @ (x * w[:, None]))
        hat = w * np.einsum("ni,ij,nj->n", x, inverse, x)
        step = inverse @ (x.T @ (y - p + hat * (0.5 - p)))
        if np.abs(step).max() < 1e-12:
            break
        beta = beta + 0.5 * step
    return beta


def test_logit_of_separated_outcomes_is_firths(spark):
    rows = [(int(a and year > 2010), a, b, year) for a in (0, 1) for b in (0, 1) for year in range(2008, 2014) for _ in range(1 + b)]
    df = spark.createDataFrame(rows, LOGIT)
    with pytest.warns(UserWarning, match="part the outcomes"):
        fit = regression.negativity_logit(df, "y", ["a", "b"])
    got = {r.term: r.estimate for r in fit.collect()}
    y, a, b, year = (np.array(c, float) for c in zip(*rows))
    beta = _firth(np.column_stack([a, b, year - year.mean(), np.ones(len(y))]), y)
    for term, x in zip(("a", "b", "year_c", "intercept"), beta):
        assert got[term] == pytest.approx(x, abs=1e-6)
    with pytest.warns(UserWarning, match="part the outcomes"):
        balance = regression.score_balance(df, "y", ["a", "b"])
    for r in balance.collect():
        assert r.fitted == pytest.approx(r.observed, abs=1e-6)
    with pytest.warns(UserWarning):  # one outcome only
        alone = regression.negativity_logit(df.filter("y = 0"), "y", ["a", "b"]).collect()
    assert all(abs(r.estimate) < 20 for r in alone) and {r.term for r in alone} >= {"intercept"}


def test_logit_gives_no_numbers_unless_settled(spark):
    df = spark.createDataFrame(_coded(np.random.default_rng(5), 500), LOGIT)
    with pytest.raises(regression.NotConverged):
        regression.negativity_logit(df, "y", ["a", "b"], max_iter=1)
    with pytest.warns(UserWarning, match="constant"):
        assert regression.negativity_logit(df.limit(0), "y", ["a", "b"]).count() == 0
    copied = df.withColumns({"c": F.lit(1) - F.col("a"), "n": F.lit(None).cast("int")})
    with pytest.warns(UserWarning, match="determined by others"):
        kept = {r.term for r in regression.negativity_logit(copied, "y", ["a", "c"]).collect()}
    assert kept in ({"a", "year_c", "intercept"}, {"c", "year_c", "intercept"})


GOOD = {"good": 2.0, "bad": -1.5, "fine": 1.0}
RULES = scoring.ContextRules({"very": 0.3, "hardly": -0.3}, frozenset({"not", "never"}), frozenset({"but"}))


@pytest.mark.parametrize(("text", "total"), [
    (None, 0), ("", 0), ("nothing here!", 0), ("good", 2), ("not good", 2 * -0.74), ("very good", 2.3), ("very bad", -1.8),
    ("hardly bad", -1.2), ("very not good", (2 * -0.74) - 0.3 * 0.95), ("not very good", 2.3 * -0.74),
    ("not a b good", 2 * -0.74), ("not a b c good", 2), ("never not good", 2 * 0.74 * 0.74), ("GOOD day", 2.733), ("GOOD DAY", 2),
    ("very BAD day", -1.5 - 0.733 - 0.3), ("good but bad", 0.5 * 2 - 1.5 * 1.5), ("but good but bad", 1.5 * 2 - 1.5 * 1.5),
    ("good!", 2.292), ("bad!!!!!!", -1.5 - 4 * 0.292), ("good?", 2), ("good??", 2.36), ("good?????", 2.96),
    ("good good", 4), ("bad good", 0.5), ("not good. very fine", 2 * -0.74 + (1.3 * -0.74)),
])
def test_context_scores(spark, text, total):
    df = spark.createDataFrame([(1, text)], "k int, content string")
    got = scoring.with_context_score(df, GOOD, RULES).first().compound
    assert got == pytest.approx(total / math.sqrt(total * total + 15))


def test_word_table(spark):
    words = {f"word{i}": {"n": i} for i in range(3000)}
    look = lookup.word_table(words, "n: int")
    df = spark.createDataFrame([(f"word{i}",) for i in range(0, 4000, 7)] + [(None,), ("",)], "w string")
    got = {r.w: r.x for r in df.select("w", look(F.col("w"))["n"].alias("x")).collect()}
    assert got == {w: words[w]["n"] if w in words else None for w in got}
    assert df.select(lookup.word_table({}, "n: int")(F.col("w")).alias("x")).filter("x IS NOT NULL").count() == 0


@pytest.mark.parametrize("tracked", [8, 64, 1024])
def test_frequent_items_are_exact_for_any_summary(spark, tracked):
    """Skewed, flat and tied counts, few rows, null groups and items; small summaries prove little and count in full."""
    rng = random.Random(6)
    rows = [("skew", f"w{int(rng.paretovariate(0.8))}") for _ in range(6000)]
    rows += [("flat", f"w{i % 700}") for i in range(2100)] + [("few", "a"), ("few", "b"), ("few", "a")]
    rows += [(None, "x")] * 40 + [(None, "y")] * 30 + [("skew", None)] * 500
    df = spark.createDataFrame(rows, "g string, w string").repartition(6)
    want = []
    for group in ("skew", "flat", "few", None):
        counts = Counter(w for g, w in rows if g == group and w is not None)
        best = sorted(counts.items(), key=lambda c: (-c[1], c[0]))[:5]
        want += [(group, w, n, i + 1) for i, (w, n) in enumerate(best)]
    got = [tuple(r) for r in frequent.most_frequent(df, "g", "w", 5, tracked).select("g", "w", "n", "rank").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    bounds = {r.g: (r.bound, r["items"]) for r in frequent.summarised(df.filter("w IS NOT NULL"), "g", "w", 5, tracked).collect()}
    for group, (bound, items) in bounds.items():
        counts = Counter(w for g, w in rows if g == group and w is not None)
        assert all(n <= bound for w, n in counts.items() if w not in items)
    assert frequent.most_frequent(df.limit(0), "g", "w", 5, tracked).count() == 0


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_rows_of_a_large_group_do_not_meet_in_one_task(spark, threshold):
    """Rows meet a broadcast before they are counted; without broadcasts counts meet parts of their groups."""
    rng = random.Random(9)
    rows = [("large", f"w{int(rng.paretovariate(0.8))}") for _ in range(5000)] + [("small", "a"), (None, "b")]
    df = spark.createDataFrame(rows, "g string, w string").repartition(6)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        found = frequent.most_frequent(df, "g", "w", 5, 8)
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = [tuple(r) for r in found.collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    counts = {g: Counter(w for at, w in rows if at == g) for g in ("large", "small", None)}
    best = {g: sorted(c.items(), key=lambda x: (-x[1], x[0]))[:5] for g, c in counts.items()}
    assert sorted(got, key=str) == sorted([(g, w, k, i + 1) for g in best for i, (w, k) in enumerate(best[g])], key=str)
    lines = plan.splitlines()
    semi = [i for i, line in enumerate(lines) if "LeftSemi" in line]
    kinds = {("_part" in lines[i], "Broadcast" in lines[i], "HashAggregate" in "".join(lines[i:])) for i in semi}
    assert kinds == ({(True, False, True)} if threshold == "-1" else {(True, True, False)})


def test_score_store_meets_each_text_once(spark, tmp_path):
    """Copies are scored once, a second run loads no model, failures stay open, versions are apart."""
    log = tmp_path / "log"

    def loader(word):
        def load():
            with open(log, "a") as file:
                file.write("load\n")

            def score(texts):
                if any("boom" in t for t in texts) and word != "late":
                    raise ValueError("boom")
                with open(log, "a") as file:
                    file.writelines(f"{t}\n" for t in texts)
                return [(word, float(len(t))) for t in texts]

            return score

        return load

    rows = [(i, "copy" if i % 3 == 0 else f"text {i}") for i in range(60)] + [(60, None), (61, ""), (62, "boom"), (None, "boom")]
    df = spark.createDataFrame(rows, "i int, content string").repartition(4)
    run = lambda word, version="v1", table=df: {
        (r.i, r.content): (r.model_label, r.model_score)
        for r in stored_scores(table, loader(word), str(tmp_path / "store"), version, tasks=3).collect()}
    got = run("first")
    assert got == {(i, t): ((None, None) if t == "boom" else ("first", float(len(t or "")))) for i, t in rows}
    lines = log.read_text().splitlines()
    assert lines.count("copy") == 1 and lines.count("") == 1
    log.unlink()
    assert run("second", table=df.filter("content <> 'boom'")) == {k: x for k, x in got.items() if k[1] not in (None, "boom")}
    assert not log.exists()
    assert run("late")[62, "boom"] == ("late", 4.0)  # what failed is tried again
    assert log.read_text().splitlines() == ["load", "boom"]
    assert set(run("late", "v2").values()) == {("late", x) for _, x in run("late").values()}
    assert read_scores(spark, str(tmp_path / "store"), "v1").count() == len({t or "" for _, t in rows})
