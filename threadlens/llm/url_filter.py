"""URL filter: rules for hosts and paths, and boosted trees on lexical features for the rest.

Everything runs as DataFrame functions and Spark's own tree learner. A url is cut into host
and path, the longest fitting rule judges it, and a url that no rule fits gets the verdict of
gradient-boosted trees. These are trained on labelled urls: by default on those that the
rules judge. Of the distinct urls of each kind about half of ``max_train`` are drawn by a hash, or
all there are, and weighed for their copies and for those not drawn, so neither kind is missed.
The suffix statistics (labelled urls and blocked share of the host's last label and last two
labels) are counted over all labelled urls and joined; they have a row per suffix seen.

A null url, or one without ``://``, has an empty host and path, fits no rule and is judged
by its features like any other. If the labelled urls are all of one kind, that kind is the
verdict for the rest; without any it is allow. Each row counts, also where ids repeat, and
columns of the input that bear the names of the results are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.session import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
FEATURES = (
    "url_length", "host_length", "path_length", "host_labels", "depth", "digit_ratio", "symbol_ratio", "entropy",
    "n_params", "has_fragment", "hyphens", "longest_label", "suffix_seen", "suffix_blocked", "pair_seen", "pair_blocked",
)
MAX_TRAIN = 20_000
TRAIN_TASKS = 6
TREES, TREE_DEPTH, SEED = 12, 4, 17
PRIOR = 10  # a suffix's blocked share is drawn to the overall share as by so many urls


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    return F.when(at > 0, F.substr(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Number of the longest rule that fits; null if none does."""
    out = F.lit(None).cast("int")
    for i in sorted(range(len(rules)), key=lambda i: len(rules[i][1])):
        domain, slash, rest = rules[i][1].partition("/")
        fits = (host == domain) | F.endswith(host, F.lit("." + domain))
        out = F.when(fits & F.startswith(path, F.lit(slash + rest)), F.lit(i)).otherwise(out)
    return out


def _pick(number: Column, values: Sequence[str]) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), number) if values else F.lit(None).cast("string")


def cut_urls(pages: DataFrame, id_col: str, url_col: str, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """``id_col, _url, host, path, rule, _ruled`` of each row."""
    rows = pages.select(
        F.col(id_col), F.coalesce(F.col(url_col), F.lit("")).alias("_url"), host_of(F.col(url_col)).alias("host"),
        path_of(F.col(url_col)).alias("path"),
    )
    number = rows.withColumn("_n", rule_of(F.col("host"), F.col("path"), rules))
    return number.select(
        id_col, "_url", "host", "path", _pick(F.col("_n"), [r for _, r in rules]).alias("rule"),
        _pick(F.col("_n"), [v for v, _ in rules]).alias("_ruled"),
    )


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    n = F.length(text).cast("double")
    shares = F.transform(
        F.array_distinct(F.split(text, "")),
        lambda c: F.when(c == "", F.lit(0.0)).otherwise((n - F.length(F.replace(text, c, F.lit("")))) / n),
    )
    return F.aggregate(
        shares, F.lit(0.0), lambda a, s: a - F.when(s > 0, s * F.log2(F.greatest(s, F.lit(1e-12)))).otherwise(F.lit(0.0)))


def lexical(rows: DataFrame) -> DataFrame:
    """Adds the features that a url has by itself, and its suffixes."""
    url, host, path = F.col("_url"), F.col("host"), F.col("path")
    size = F.greatest(F.length(url), F.lit(1)).cast("double")
    labels = F.split(host, r"\.", -1)
    count = lambda text, chars: F.length(text) - F.length(F.translate(text, chars, ""))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return rows.select(
        "*",
        F.substring_index(host, ".", -1).alias("_suffix"),
        F.substring_index(host, ".", -2).alias("_pair"),
        F.length(url).cast("double").alias("url_length"),
        F.length(host).cast("double").alias("host_length"),
        F.length(path).cast("double").alias("path_length"),
        F.size(labels).cast("double").alias("host_labels"),
        F.size(F.filter(F.split(path, "/", -1), lambda p: p != "")).cast("double").alias("depth"),
        (count(url, "0123456789") / size).alias("digit_ratio"),
        ((F.length(url) - F.length(F.regexp_replace(url, r"[^A-Za-z0-9]", ""))) / size).alias("symbol_ratio"),
        entropy(url).alias("entropy"),
        F.when(query == "", F.lit(0)).otherwise(F.size(F.split(query, "&", -1))).cast("double").alias("n_params"),
        F.contains(url, F.lit("#")).cast("double").alias("has_fragment"),
        count(host, "-").cast("double").alias("hyphens"),
        F.array_max(F.transform(labels, lambda x: F.length(x))).cast("double").alias("longest_label"),
    )


def suffix_table(labelled: DataFrame, column: str, tag: str, overall: float) -> DataFrame:
    """Labelled urls and smoothed blocked share of each value of ``column``."""
    n, blocked = F.count("*"), F.sum((F.col("_label") == "block").cast("double"))
    return labelled.groupBy(F.col(column).alias(f"_{tag}")).agg(
        F.log1p(n.cast("double")).alias(f"{tag}_seen"),
        ((blocked + F.lit(PRIOR * overall)) / (n + PRIOR)).alias(f"{tag}_blocked"),
    )


def with_suffixes(rows: DataFrame, tables: dict[str, DataFrame], overall: float) -> DataFrame:
    """Joins the suffix statistics; a suffix without labelled urls gets the overall share."""
    for tag, stats in tables.items():
        key = "_suffix" if tag == "suffix" else "_pair"
        stats = stats.withColumnRenamed(f"_{tag}", "_of")
        rows = rows.join(stats, rows[key] == stats["_of"], "left").drop("_of")
        rows = rows.withColumns({
            f"{tag}_seen": F.coalesce(f"{tag}_seen", F.lit(0.0)),
            f"{tag}_blocked": F.coalesce(f"{tag}_blocked", F.lit(float(overall))),
        })
    return rows


class UrlModel:
    """Boosted trees with the suffix statistics they were trained on; or one verdict for all."""

    def __init__(self, trees: GBTClassificationModel | None, tables: dict[str, DataFrame], overall: float) -> None:
        self.trees, self.tables, self.overall = trees, tables, overall

    def judge(self, rows: DataFrame) -> DataFrame:
        """Adds ``_score`` (probability of block) to lexical rows."""
        if self.trees is None:
            return rows.withColumn("_score", F.lit(float(self.overall)))
        full = with_suffixes(rows, self.tables, self.overall)
        assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="_features").transform(full)
        scored = self.trees.transform(assembled)
        return scored.withColumn("_score", F.get(vector_to_array("_probability"), F.lit(1))).drop(
            "_features", "_raw", "_probability", "_prediction", *FEATURES)


def drawn_urls(labelled: DataFrame, max_train: int) -> DataFrame:
    """Distinct labelled urls, about ``max_train / 2`` of each kind or all there are, with a ``_weight``.

    The weight stands for a url's copies and for the urls of its kind that were not drawn.
    """
    lexical_columns = [c for c in labelled.columns if c not in ("_url", "_label")]
    urls = labelled.groupBy("_url", "_label").agg(
        F.count("*").alias("_copies"), *[F.first(c).alias(c) for c in lexical_columns])
    kinds = dict(labelled.select("_url", "_label").distinct().groupBy("_label").count().collect())
    share = F.lit(1.0)
    for kind, n in kinds.items():
        share = F.when(F.col("_label") == kind, F.lit(min(1.0, max_train / 2 / n))).otherwise(share)
    scale = 1 << 40
    drawn = urls.filter(F.pmod(F.xxhash64("_url", F.lit(SEED)), F.lit(scale)) < share * scale)
    return drawn.withColumn("_weight", F.col("_copies") / share)


def train(labelled: DataFrame, max_train: int = MAX_TRAIN, trees: int = TREES, depth: int = TREE_DEPTH) -> UrlModel:
    """Fit on lexical rows with a ``_label`` of allow or block."""
    totals = labelled.agg(F.count("*").alias("n"), F.sum((F.col("_label") == "block").cast("long")).alias("b")).first()
    n, blocked = totals["n"], totals["b"] or 0
    overall = blocked / n if n else 0.0
    if blocked in (0, n):
        return UrlModel(None, {}, overall)
    tables = {
        "suffix": suffix_table(labelled, "_suffix", "suffix", overall),
        "pair": suffix_table(labelled, "_pair", "pair", overall),
    }
    rows = drawn_urls(labelled, max_train)
    full = with_suffixes(rows, tables, overall).withColumn("_y", (F.col("_label") == "block").cast("double"))
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="_features").transform(full).select("_features", "_y", "_weight")
    # The trees pass over these rows some hundred times: a bounded number, written once, in a few even tasks.
    rows = materialise(rows, "labelled-urls").coalesce(TRAIN_TASKS)
    learner = GBTClassifier(
        featuresCol="_features", labelCol="_y", weightCol="_weight", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=SEED,
        predictionCol="_prediction",
    )
    learner.set(learner.getParam("probabilityCol"), "_probability")
    learner.set(learner.getParam("rawPredictionCol"), "_raw")
    return UrlModel(learner.fit(rows), tables, overall)


def filter_urls(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str]] = RULES,
    labelled: DataFrame | None = None, threshold: float = 0.5, max_train: int = MAX_TRAIN,
) -> DataFrame:
    """``id_col, host, path, rule, verdict, score``; ``score`` is the trees' probability of block, null under a rule.

    ``labelled`` has ``url`` and ``label`` (allow or block); without it the urls that rules judge are the labels.
    """
    rows = lexical(cut_urls(pages, id_col, url_col, rules))
    if labelled is None:
        known = rows.filter(F.col("_ruled").isNotNull()).withColumn("_label", F.col("_ruled"))
    else:
        own = labelled.select("url", F.col("label").alias("_label")).filter(F.col("_label").isin("allow", "block"))
        known = lexical(cut_urls(own.withColumn("_key", F.col("url")), "_key", "url", rules).join(
            own.select(F.col("url").alias("_key"), "_label").distinct(), "_key"))
    model = train(known, max_train)
    scored = model.judge(rows)
    verdict = F.coalesce("_ruled", F.when(F.col("_score") >= threshold, F.lit("block")).otherwise(F.lit("allow")))
    return scored.select(
        id_col, "host", "path", "rule", verdict.alias("verdict"),
        F.when(F.col("_ruled").isNull(), F.col("_score")).alias("score"))
