import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadlens import config
from threadlens.functions import dates, labels, patterns, text
from threadlens.functions.register import register_functions
from threadlens.operators import shape

STAMPS = [
    "05.03.2023 04:10",
    "18.06.2016 15:07 ~ 15:09",
    "18.06.2016 15:07 ~ 19.06.2016 08:00",
    "18.06.2016",
    "2016-06-18",
    "31.02.2020 10:00",
    "",
    None,
    "xx 01.01.2001  00:00 yy",
    "5.3.2023 4:10",
    "01.01.0000 10:00",
    "05.03.2023 25:10",
]


def _iso(column, mode):
    return column(STAMPS, lambda c: dates.iso_text(dates.parse_stamp(c, mode)))


def test_first_stamp_takes_creation_time(column):
    assert _iso(column, "first") == [
        "2023-03-05T04:10:00", "2016-06-18T15:07:00", "2016-06-18T15:07:00", None, None, None, None, None,
        "2001-01-01T00:00:00", None, None, None,
    ]


def test_multi_format_drops_edited_entries(column):
    assert _iso(column, "multi") == [
        "2023-03-05T04:10:00", None, None, "2016-06-18T00:00:00", "2016-06-18T00:00:00", None, None, None, None,
        "2023-03-05T04:10:00", None, None,
    ]


def test_strict_stamp(column):
    assert _iso(column, "strict") == ["2023-03-05T04:10:00"] + [None] * 11


def test_tokens_agree_with_unicode_words(column):
    samples = ["göçmen şık ı_1", "i̇a ½ x", "", None, "?!, -", "a1 b_2"]
    want = [len(re.findall(r"\w+", s)) if s else 0 for s in samples]
    assert column(samples, text.token_count) == want
    assert column(samples, lambda c: F.size(text.tokens(c))) == want


def test_strip_blank_equals_python(column):
    samples = [" a b\t\n", " x ", "\x1c\x1fy", "", " \r\n ", None]
    assert column(samples, text.strip_blank) == [s.strip() if s is not None else None for s in samples]
    assert column(samples, text.blank_to_null) == ["a b", "x", "y", None, None, None]


def test_title_words_and_bigrams(column):
    titles = ["Suriye'ye 3 Göçmen", "tek", "", "bir iki üç", None]
    assert column(titles, text.title_words) == [
        ["suriye", "ye", "göçmen"], ["tek"], [], ["bir", "iki", "üç"], [],
    ]
    assert column(titles, lambda c: text.bigrams(text.title_words(c))) == [
        ["suriye ye", "ye göçmen"], [], [], ["bir iki", "iki üç"], [],
    ]


def test_slug(column):
    got = column(["?!", "x" * 200, "__a b__", "İğdır'da şey"], text.slug)
    assert got == ["untitled", "x" * 180, "a_b", "İğdır_da_şey"]


def test_line_and_name_cleaners(column):
    lines = ["title 123", "title 12,345b", "title 1.234", "title", "title 5b  "]
    assert column(lines, text.strip_trailing_count) == ["title", "title", "title 1.", "title", "title"]
    stems = ["a_annotations", "a_annotated", "a_annotations_x", "a"]
    assert column(stems, text.strip_pair_suffix) == ["a", "a", "a_annotations_x", "a"]


def test_length_counts_code_points_and_lower(column):
    assert column(["a😀b"], text.char_length) == [3]
    assert column(["İI"], text.lower_key) == ["İI".lower()]


def test_snippet_and_thousands(column):
    long = "y" * 151
    assert column([long, "short"], text.snippet) == ["y" * 150 + "...", "short"]
    assert column(["z"], lambda c: text.snippet(c, F.array(F.lit("A"), F.lit("B")))) == ["z (A, B)"]
    assert column(["z"], lambda c: text.snippet(c, F.array().cast("array<string>"))) == ["z"]
    assert column([1234567], text.thousands, "bigint") == ["1,234,567"]


def test_case_folding_in_lexicons(column):
    words = ["GÖÇMEN", "SIĞINMACI", "SURİYE", "göçmenler", "kalkınmak", None]
    flag = lambda name: column(words, lambda c: patterns.matches(c, config.SUBGROUP_STEMS[name]))
    assert flag("gocmen") == [True, False, False, True, False, False]
    assert flag("siginmaci") == [False, True, False, False, False, False]
    assert column(words, lambda c: patterns.matches(c, "suri")) == [False, False, True, False, False, False]
    # plain stems and the same stems as a regex agree
    for stem in [*config.SUBGROUP_STEMS.values(), "suri", "kız"]:
        plain = column(words, lambda c, s=stem: patterns.matches(c, s))
        assert plain == column(words, lambda c, s=stem: patterns.matches(c, f"(?:{s})"))


def test_frames_match_inside_words(column):
    found = column(["baldızım", "yardım parası", ""], lambda c: patterns.all_matches(c, config.FRAMES))
    assert found == [[], ["economy", "solidarity"], []] or found[1] == ["economy", "solidarity"]
    assert column(["kızılay"], lambda c: patterns.matches(c, config.FRAMES["gender"])) == [True]


def test_mention_priority_and_word_start(column):
    texts = ["suriyeliler geldi", "suri halkı", "çsuri", "hem suri hem suriyeli", "(Suri)", "yok", None]
    mark = lambda c: patterns.first_match(c, config.MENTION_STEMS, at_word_start=True)
    assert column(texts, mark) == ["suriyeli", "suri", None, "suriyeli", "suri", None, None]


def test_sentiment_bins_are_half_open(column):
    scores = [-1.0, -0.99, -0.05, 0.0, 0.05, 0.051, 1.0, 1.2, None]
    assert column(scores, labels.sentiment_bin, "double") == [
        None, "Negative", "Negative", "Neutral", "Neutral", "Positive", "Positive", None, None,
    ]


def test_half_even_and_share(column):
    assert column([2.25, 2.35, 0.5], lambda c: labels.half_even(c, 1), "double") == [2.2, 2.4, 0.5]
    assert column([0, 4], lambda c: labels.share(F.lit(1), c), "bigint") == [None, 0.25]


def test_clean_topics(column):
    lists = [
        [" HATE ", "FOO", "", "ECON", "ECON", "HUMAN"],
        [],
        None,
        ["x", " "],
        ["POLICY"],
    ]
    got = column(lists, labels.clean_topics, "array<string>")
    assert got == [["HATE", "ECON", "ECON"], ["NEUTRAL"], ["NEUTRAL"], ["NEUTRAL"], ["POLICY"]]


def test_sentiment_codes(column):
    values = ["4", "3.7", '"4"', '" 2 "', '"3.7"', "9", "0", "null", '"x"', "true", "5.9", "-1", "[1]", '"99999999999"']
    got = column(values, lambda c: labels.sentiment_code(F.parse_json(c)))
    assert got == [4, 3, 4, 2, 3, 3, 3, 3, 3, 1, 5, 3, 3, 3]


def test_display_label_drops_unknown(column):
    assert column(["rus_titles_data", "x"], lambda c: labels.display_label(c, config.GROUP_LABELS)) == ["Rus", None]


def test_sql_functions(spark):
    register_functions(spark)
    row = spark.sql(
        """SELECT date_format(parse_first_stamp('18.06.2016 15:07 ~ 15:09'), 'yyyy-MM-dd HH:mm') AS d,
                  parse_first_stamp('18.06.2016') AS n, slug('?') AS s, mention_group('SURİYELİLER') AS m,
                  clean_topics(array('\\tECON', 'x', 'HATE')) AS t"""
    ).first()
    assert (row.d, row.n, row.s, row.m, row.t) == ("2016-06-18 15:07", None, "untitled", "suriyeli", ["ECON", "HATE"])


LETTERS = st.text("abcİıi.ş-]^", min_size=1, max_size=5)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.text("abcİIıiS.ş-]^ ", max_size=30), min_size=1, max_size=6), stems=st.lists(LETTERS, min_size=1, max_size=12))
def test_one_pass_flags_are_the_single_ones(spark, texts, stems):
    """Overlapping stems, stems within and before others, signs of regexes among the plain letters."""
    lexicon = {f"f{i}": stems[i::3] for i in range(3) if stems[i::3]}
    df = spark.createDataFrame([(t,) for t in [*texts, None, ""]], "content string")
    one, each = (shape.add_flags(df, "content", lexicon, one_pass=x).collect() for x in (True, False))
    assert one == each


def test_trie_takes_the_longest_stem():
    words = ["a", "ab", "abcd", "b", "bc", "x.y", "x-z", "zz" * 2000]
    pattern = re.compile(patterns.trie_pattern(words))
    for text, want in (("abcx", "ab"), ("abcde", "abcd"), ("a", "a"), ("bcd", "bc"), ("x.yz", "x.y"), ("x-z", "x-z"), ("z" * 5000, "zz" * 2000)):
        assert pattern.match(text).group() == want
    assert pattern.match("xay") is None and pattern.match("zz") is None
