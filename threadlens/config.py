"""Fixed values of the data model: label domains, lexicons, stems, labels, sources.

Everything here is plain data and can be replaced by the caller; the operators
take these as parameters.
"""

from __future__ import annotations

# Allowed topic codes, and the code used when none is left.
TOPIC_CODES = (
    "HATE",
    "XENO",
    "CRIME",
    "ECON",
    "CULTURE",
    "SEXUAL",
    "GENDER-MORAL",
    "POLICY",
    "NEUTRAL",
    "HUMAN",
    "POS-STEREO",
    "HUMAN-POS",
)
DEFAULT_TOPIC = "NEUTRAL"
MAX_TOPICS = 3

# Sentiment scale 1 (very negative) to 5 (very positive).
SENTIMENT_MIN, SENTIMENT_MAX, SENTIMENT_DEFAULT = 1, 5, 3
MISSING_SENTIMENT = -1

# Entries per annotation prompt.
BATCH_SIZE = 40

# Reporting window, inclusive.
FIRST_YEAR, LAST_YEAR = 2010, 2025

# Title frames, each a list of stems.
FRAMES = {
    "crime": ["suç", "tecavüz", "saldır", "öldür", "hırsız", "güvenlik", "yağma"],
    "economy": ["ekonomi", "işsizlik", "yardım", "para", "vergi", "maliyet", "enflasyon"],
    "solidarity": ["yardım", "insan", "vicdan", "empati", "dayanışma"],
    "culture": ["medeniyet", "batı", "avrupa", "dil", "kültür", "modern"],
    "politics": ["hükümet", "iktidar", "muhalefet", "erdoğan", "seçim", "chp", "akp", "devlet"],
    "gender": ["kadın", "erkek", "kız", "evlilik", "cinsiyet"],
}

# Stems of the migrant block's subgroups.
SUBGROUP_STEMS = {"gocmen": "göçmen", "multeci": "mültec", "siginmaci": "sığınmac"}

# Mention groups, the longer stem first.
MENTION_STEMS = (("suriyeli", "suriyel"), ("suri", "suri"))

# Stems by which titles are assigned to collection groups.
STEM_CATALOGUE = {
    "suriye": ["suri"],
    "afgan": ["afgan"],
    "gocmen": ["göçmen", "mülteci", "sığınmacı"],
    "rus": ["rus"],
    "ukrayna": ["ukrayna"],
}

# Display labels of folders and subgroups.
MIGRANT_FOLDER = "gocmen_titles_data"
GROUP_LABELS = {
    "suriye_titles_data": "Suriye",
    "afgan_titles_data": "Afgan",
    "gocmen_titles_data": "Göçmen+Mülteci+Sığınmacı",
    "rus_titles_data": "Rus",
    "ukrayna_titles_data": "Ukrayna",
}
SUBGROUP_LABELS = {"gocmen": "Göçmen", "multeci": "Mülteci", "siginmaci": "Sığınmacı"}
SUMMARY_LABELS = {
    "suriye_titles_data": "Suriye / Suriyeli / Suri (Syrian)",
    "afgan_titles_data": "Afgan / Afganistan / Afganlı (Afghan)",
    "rus_titles_data": "Rus / Rusya / Rusyalı (Russian)",
    "ukrayna_titles_data": "Ukrayna / Ukraynalı (Ukrainian)",
    "gocmen_titles_data": "Göçmen / Mülteci / Sığınmacı (Migrant / Refugee / Asylum seeker)",
}

# Corpus sources as (category, path pattern under the corpus root, labelled).
SOURCES = (
    ("suriye", "annotated_data/suriye_annotated/*.json", True),
    ("rus", "annotated_data/rus_annotated/*.json", True),
    ("ukrayna", "annotated_data/ukrayna_annotated/*.json", True),
    ("afganistan", "afganistan_titles_data/*.json", False),
    ("pakistan", "pakistan_titles_data/*.json", False),
    ("gocmen", "gocmen_titles_data/gocmen_kw/*.json", False),
    ("multeci", "gocmen_titles_data/multeci_kw/*.json", False),
    ("siginmaci", "gocmen_titles_data/siginmaci_kw/*.json", False),
)

# Errors of the label merge, in the order in which they are looked for.
MERGE_ERRORS = {
    "MissingDataFile": "Data file not found for ",
    "InvalidAnnotationJSON": "Annotation file is not valid JSON",
    "InvalidDataJSON": "Data file is not valid JSON",
    "AnnotationsNotList": "Annotation file is not a list",
    "EntriesNotList": "entries field is not a list",
    "MissingEntryID": "Entry without entry_id",
}

# How an entry stands in a prompt.
PROMPT_ID, PROMPT_TEXT = "ENTRY_ID: ", "TEXT: "

# Scores up to this far from zero are neutral.
NEUTRAL_BAND = 0.05

# A driver-side dictionary becomes a broadcast table only up to this many rows.
MAX_BROADCAST_ROWS = 200_000
