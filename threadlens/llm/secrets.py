"""Secrets in texts: fixed patterns, and a battery of randomness tests with false-discovery control.

Fixed patterns give the base spans (assign, access, hex). Beside them, each run of token
characters is cut at '/' and '+', at '-' and '_', and at all of them; the run and each part
that has the marks of an encoding is a candidate, so that a key is tested apart from the path
or the prefix it stands in. The encoding is inferred from the characters (hex, base32,
base36, base64, base64url; a run in groups, as a serial number is, without its separators),
and three tests ask whether its symbols could be uniform draws: chi-squared over the alphabet, runs about the alphabet's middle, and
serial correlation. Fisher's method combines them to one p-value, uniform for a random string
and near 0 for a name, a path or a counter.

Short strings give weak tests, so candidates are judged within strata of encoding and
length. A stratum's distinct strings are counted by bins of p. Random strings fill all bins
evenly and others hardly reach the upper half, which so tells how many random strings there
are; what lies above a cut beyond their share are false discoveries. The cut of a stratum is
the lowest, from the level of a single test on, above which their estimated share is at most
``fdr`` beyond chance. There are some two thousand pairs of stratum and bin at most, whatever
the size of the corpus. Where candidates over their cuts overlap they become one span; what
base spans cover of it is left to these, and the parts beside them stay.

A null text is an empty one and holds nothing. Each row counts, also where ids repeat;
strings that repeat are one string in the strata. Whole texts are searched, of any length.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.llm.blocks import release, renamed, slices
from threadlens.session import materialise

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_MIN, ACCESS_MIN, HEX_MIN = 12, 18, 16

DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
UPPER = LOWER.upper()
ALPHABETS = {
    "hex": DIGITS + "abcdef",
    "base32": UPPER + "234567",
    "base36": DIGITS + LOWER,
    "base64": UPPER + LOWER + DIGITS + "+/",
    "base64url": UPPER + LOWER + DIGITS + "-_",
}
MIN_CHARS = 16
SHORT = 20  # shorter strings are strata of their own
CUTS = tuple(re.compile(x) for x in (".+", "[^/+]+", "[^_-]+", "[^/+_-]+"))
GROUPED = "s"  # ends the name of an encoding whose symbols stand in groups
BINS = 20
FDR = 0.01
LEVEL = 0.05  # no string below this p counts as random, however few its stratum holds
SCAN_SCHEMA = (
    "row long, text_hash long, n_assign long, n_access long, n_hex long, base array<struct<at:int,rank:int,stop:int>>, "
    "found array<struct<at:int,stop:int,stratum:string,p:double,mark:long,free:array<struct<at:int,stop:int>>>>"
)


def upper_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi_squared_p(values: list[int], size: int) -> float:
    """Two-sided p of the symbols' chi-squared against uniform draws (Wilson and Hilferty's approximation)."""
    n, counts = len(values), {}
    for v in values:
        counts[v] = counts.get(v, 0) + 1
    x, df = size / n * sum(c * c for c in counts.values()) - n, size - 1
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)) if x > 0 else -9.0
    p = upper_tail(z)
    return max(1e-300, min(1.0, 2 * min(p, 1 - p)))


def runs_p(values: list[int], size: int) -> float:
    """Two-sided p of the number of runs above and below the alphabet's middle."""
    side = [2 * v >= size for v in values]
    n, up = len(side), sum(side)
    down = n - up
    if not up or not down:
        return max(1e-300, 2.0 ** (1 - n))
    mean = 1 + 2 * up * down / n
    var = (mean - 1) * (mean - 2) / (n - 1)
    runs = 1 + sum(a != b for a, b in zip(side, side[1:]))
    if var <= 0:
        return 1.0
    gap = max(0.0, abs(runs - mean) - 0.5)
    return max(1e-300, min(1.0, 2 * upper_tail(gap / math.sqrt(var))))


def serial_p(values: list[int]) -> float:
    """Two-sided p of the correlation of each symbol's value with the next one's."""
    n = len(values)
    mean = sum(values) / n
    off = [v - mean for v in values]
    total = sum(x * x for x in off)
    if not total:
        return 1e-300
    r = sum(a * b for a, b in zip(off, off[1:])) / total
    return max(1e-300, min(1.0, 2 * upper_tail(abs(r + 1 / n) * math.sqrt(n))))


def fisher(ps: list[float]) -> float:
    half = -sum(math.log(p) for p in ps)
    term = total = 1.0
    for i in range(1, len(ps)):
        term *= half / i
        total += term
    return min(1.0, math.exp(-half) * total)


def infer_encoding(token: str) -> str | None:
    """The narrowest encoding of a token without its padding; None for words, numbers and the like."""
    has = [any(c in s for c in token) for s in (DIGITS, LOWER, UPPER)]
    marks = set(token) - set(DIGITS + LOWER + UPPER)
    if sum(has) < 2 or re.fullmatch(r"[A-Za-z]?[a-z]+[0-9]{1,4}|[A-Z]+[0-9]{1,4}|[0-9]{1,4}[a-z]+|[A-Z][a-z]+", token):
        return None
    if not marks and has[0] and not (has[1] and has[2]):
        low = token.lower()
        if set(low) <= set(ALPHABETS["hex"]):
            return "hex"
        if has[2] and set(token) <= set(ALPHABETS["base32"]):
            return "base32"
        return "base36"
    if sum(has) == 3 or (has[1] and has[2]):
        if marks <= set("+/"):
            return "base64"
        if marks <= set("-_"):
            return "base64url"
    return None


def infer_grouped(token: str) -> str | None:
    """The encoding of groups of letters and digits of one case between '-' or '_'; None if most are words and numbers."""
    groups = re.split("[-_]+", token)
    whole = "".join(groups)
    encoding = infer_encoding(whole) if len(groups) > 1 and whole.isalnum() else None
    mixed = sum(len(g) for g in groups if infer_encoding(g))
    return encoding + GROUPED if encoding in ("hex", "base32", "base36") and 2 * mixed >= len(whole) else None


def candidates(token: str, min_chars: int) -> Iterator[tuple[int, str, str]]:
    """``(place, string, encoding)`` of a run and of its parts between marks."""
    seen = set()
    for part in CUTS:
        for m in part.finditer(token):
            if m.span() in seen or len(m.group()) < min_chars:
                continue
            seen.add(m.span())
            encoding = infer_encoding(m.group()) or infer_grouped(m.group())
            if encoding:
                yield m.start(), m.group(), encoding


def uncovered(at: int, stop: int, base: list[tuple[int, int, int]]) -> list[dict]:
    """What the base spans, in order, leave of ``at .. stop``."""
    out = []
    for a, _, b in base:
        if a >= stop:
            break
        if b > at:
            if a > at:
                out.append({"at": at, "stop": a})
            at = b
    if at < stop:
        out.append({"at": at, "stop": stop})
    return out


def randomness(token: str, encoding: str) -> float:
    if encoding.endswith(GROUPED):
        token, encoding = re.sub("[-_]", "", token), encoding[: -len(GROUPED)]
    alphabet = ALPHABETS[encoding]
    text = token.lower() if encoding in ("hex", "base36") else token
    values = [alphabet.index(c) for c in text]
    return fisher([chi_squared_p(values, len(alphabet)), runs_p(values, len(alphabet)), serial_p(values)])


def length_band(n: int) -> int:
    """Bands of half a doubling, open above 512; the short ones are a band."""
    return min(int(2 * math.log2(n)), 18) if n >= SHORT else 7


def base_spans(text: str, patterns) -> list[tuple[int, int, int]]:
    """``(start, rank of the kind, end)``, in order."""
    assign, access, hexes = patterns
    out = [(m.start(), 0, m.end()) for m in assign.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_MIN]
    out += [(m.start(), 1, m.end()) for m in access.finditer(text) if m.end() - m.start() >= ACCESS_MIN]
    # A run is as long as it can be, so asking for its length at once finds the same spans.
    out += [(m.start(), 2, m.end()) for m in hexes.finditer(text)]
    return sorted(out)


def scan(docs: DataFrame, text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` (which has ``row``) to its base spans and candidates, one row each, with ``text_hash``."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        patterns = re.compile(ASSIGN), re.compile(ACCESS), re.compile(rf"{HEX[:-1]}{{{HEX_MIN},}}")
        runs = re.compile(rf"[A-Za-z0-9+/_-]{{{min_chars},}}")
        schema = None
        for batch in slices(batches, "text"):
            columns: list[list] = [[] for _ in range(7)]
            for row, print_of, text in zip(
                    *[batch.column(c).to_pylist() for c in ("row", "text_hash", "text")], strict=True):
                text = text or ""
                base = base_spans(text, patterns)
                found = []
                for m in runs.finditer(text):
                    for place, token, encoding in candidates(m.group(), min_chars):
                        at, stop = m.start() + place, m.start() + place + len(token)
                        free = uncovered(at, stop, base)
                        if free:
                            mark = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "big", signed=True)
                            found.append({"at": at, "stop": stop, "stratum": f"{encoding}:{length_band(len(token))}",
                                          "p": randomness(token, encoding), "mark": mark, "free": free})
                kinds = [rank for _, rank, _ in base]
                for column, x in zip(columns, (
                    row, print_of, kinds.count(0), kinds.count(1), kinds.count(2),
                    [{"at": a, "rank": r, "stop": b} for a, r, b in base], found), strict=True):
                    column.append(x)
            schema = schema or pa.schema([
                ("row", pa.int64()), ("text_hash", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()),
                ("base", pa.list_(pa.struct([("at", pa.int32()), ("rank", pa.int32()), ("stop", pa.int32())]))),
                ("found", pa.list_(pa.struct([("at", pa.int32()), ("stop", pa.int32()), ("stratum", pa.string()),
                                              ("p", pa.float64()), ("mark", pa.int64()),
                                              ("free", pa.list_(pa.struct([("at", pa.int32()), ("stop", pa.int32())])))])))])
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    texts = docs.select("row", F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return texts.mapInArrow(find, SCAN_SCHEMA)


def cut_of(counts: list[int], fdr: float) -> float | None:
    """The lowest bin edge above which the estimated share of false discoveries is at most ``fdr``.

    ``counts`` are distinct strings by equal bins of p. Random strings fill the bins evenly
    and others hardly reach the upper half, so its mean tells how many random strings a bin
    holds; what lies above an edge beyond that, less one deviation of chance, is false.
    """
    bins = len(counts)
    upper = counts[bins // 2 :]
    density = sum(upper) / len(upper)
    for i in range(math.ceil(LEVEL * bins), bins):
        above = sum(counts[i:])
        if above and above - density * (bins - i) <= fdr * above + math.sqrt(above):
            return i / bins
    return None


def cuts(scanned: DataFrame, fdr: float = FDR, bins: int = BINS) -> dict[str, float]:
    """The cut of each stratum that has one; the histogram is bounded by strata and bins."""
    place = F.least(F.floor(F.col("c.p") * bins), F.lit(bins - 1)).cast("int")
    counted = (
        scanned.select(F.explode("found").alias("c"))
        .select(F.col("c.stratum").alias("stratum"), F.col("c.mark").alias("mark"), place.alias("bin"))
        .distinct()
        .groupBy("stratum", "bin")
        .count()
    )
    table: dict[str, list[int]] = {}
    for r in counted.collect():
        table.setdefault(r["stratum"], [0] * bins)[r["bin"]] = r["count"]
    found = {name: cut_of(counts, fdr) for name, counts in table.items()}
    return {name: cut for name, cut in found.items() if cut is not None}


def all_spans(cut: dict[str, float]) -> Column:
    """Base spans and what these leave of the candidates over their stratum's cut, overlapping ones as one, in order."""
    kind = "array<struct<at:int,rank:int,stop:int>>"
    chosen = F.array().cast(kind)
    if cut:
        limits = F.create_map(*[F.lit(x) for pair in sorted(cut.items()) for x in pair])
        fits = F.filter("found", lambda c: F.coalesce(c["p"] >= limits[c["stratum"]], F.lit(False)))
        rank = F.lit(KINDS.index("random")).alias("rank")
        pieces = F.array_sort(F.flatten(F.transform(fits, lambda c: F.transform(c["free"], lambda f: F.struct(
            f["at"].alias("at"), rank, f["stop"].alias("stop"))))))
        # An earlier start comes first, so a span overlaps the last one or none.
        chosen = F.aggregate(pieces, chosen, lambda done, s: F.when(
            (F.size(done) > 0) & (s["at"] < F.get(done, F.size(done) - 1)["stop"]),
            F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(
                F.get(done, F.size(done) - 1)["at"].alias("at"), rank,
                F.greatest(F.get(done, F.size(done) - 1)["stop"], s["stop"]).alias("stop")))).cast(kind),
        ).otherwise(F.concat(done, F.array(s)).cast(kind)))
    return F.array_sort(F.concat("base", chosen))


def digest(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["rank"]), s["at"].cast("string"), s["stop"].cast("string"))), ",")


def find_secrets(
    docs: DataFrame, text_col: str = "text", min_chars: int = MIN_CHARS, fdr: float = FDR
) -> DataFrame:
    """``docs`` with ``row``, ``text_hash``, base counts, ``base`` and ``spans``; the text is read once, the findings are written."""
    scanned = materialise(scan(docs, text_col, min_chars), "secrets")
    spans = all_spans(cuts(scanned, fdr)).alias("spans")
    return scanned.select("row", "text_hash", "n_assign", "n_access", "n_hex", "base", spans)


def secret_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: its id, base counts, the digest of the base spans and all spans as text."""
    keyed = docs.select(F.col(id_col).alias("row"), F.col(text_col).alias("text"))
    found = find_secrets(keyed, "text", **options)
    return found.select(
        F.col("row").alias(id_col), "n_assign", "n_access", "n_hex",
        F.sha2(digest(F.col("base")), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]", **options) -> DataFrame:
    """``docs`` with each span replaced by ``mark``; overlapping spans are replaced as one.

    Findings go back to their rows by id, null or not, and a hash of the text.
    """
    found = find_secrets(
        docs.select(F.col(id_col).alias("row"), F.col(text_col).alias("text")), "text", **options)
    # Rows with the same id and text have the same spans.
    spans = found.filter(F.size("spans") > 0).groupBy(F.col("row").alias("_of"), F.col("text_hash").alias("_hash")).agg(
        F.first("spans").alias("_spans"))
    rows = renamed(docs)
    own = rows.columns
    text, name = (F.col(f"_c{docs.columns.index(c)}") for c in (text_col, id_col))
    # Code points before, between and after the spans; a span inside an earlier one adds nothing.
    cut = F.aggregate(
        "_spans", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda a, s: F.when(s["stop"] <= a["at"], a).otherwise(F.struct(
            F.when(s["at"] < a["at"], a["out"]).otherwise(
                F.concat(a["out"], F.substr(text, a["at"] + 1, s["at"] - a["at"]), F.lit(mark))).alias("out"),
            s["stop"].alias("at"))),
        lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1, F.length(text))),
    )
    rows = rows.withColumns({"_id": name, "_mark": F.xxhash64(text)})
    joined = rows.join(spans, F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_mark") == F.col("_hash")), "left")
    clean = F.when(F.col("_spans").isNull(), text).otherwise(cut)
    return joined.select(*[(clean if c == text_col else F.col(k)).alias(c) for c, k in zip(docs.columns, own)])
