"""Wide <-> long reshaping and zero-filled grids."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.functions.patterns import flag_columns, matches, plain_stems, stem_hits
from threadlens.functions.text import fold_case

ONE_PASS_STEMS = 100


def keep_found(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add ``value`` as ``name`` and drop the rows where it is null.

    A filter on a computed column is pushed below it and computes it a second time. A
    generator over zero or one element lets nothing past, so the value is computed once.
    """
    rest = [c for c in df.columns if c != name]
    staged = df.select(*rest, value.alias("_found"))
    one = F.when(F.col("_found").isNotNull(), F.array("_found"))
    return staged.select(*rest, F.explode(one).alias(name))


def add_flags(
    df: DataFrame, text: str, lexicon: Mapping[str, str | Iterable[str]], prefix: str = "", one_pass: bool | None = None
) -> DataFrame:
    """Add one boolean per lexicon name; the text is folded once for all of them.

    With ``one_pass`` the text is searched once for all plain stems together, else once for each; the flags
    are the same. By default large lexicons, of ``ONE_PASS_STEMS`` stems or more, take one pass.
    """
    folded = df.withColumn("_folded", fold_case(F.col(text)))
    stems = plain_stems(lexicon)
    if stems and (len(stems) >= ONE_PASS_STEMS if one_pass is None else one_pass):
        found = folded.withColumn("_hits", stem_hits(F.col("_folded"), stems))
        flags = flag_columns(F.col("_hits"), F.col("_folded"), lexicon)
        return found.select(*df.columns, *[flag.alias(prefix + name) for name, flag in flags.items()])
    flags = [matches(F.col("_folded"), stems, folded=True).alias(prefix + name) for name, stems in lexicon.items()]
    return folded.select(*df.columns, *flags)


def melt_flags(df: DataFrame, ids: Sequence[str], flags: Sequence[str], name: str, value: str = "present") -> DataFrame:
    """Wide booleans to one row per flag."""
    return df.unpivot(list(ids), list(flags), name, value)


def count_flags(
    df: DataFrame,
    by: Sequence[str],
    flags: Sequence[str],
    name: str,
    out: str = "n",
    weight: Column | None = None,
) -> DataFrame:
    """Rows per ``(by, flag)`` where the flag holds, without melting the rows first.

    Each input row goes through one conditional sum per flag and the small aggregate is
    melted, so nothing is multiplied before the shuffle.
    """
    one = F.lit(1) if weight is None else weight
    sums = [F.sum(F.when(F.col(f), one).otherwise(F.lit(0)).cast("bigint")).alias(f) for f in flags]
    wide = df.groupBy(*by).agg(*sums)
    return wide.unpivot(list(by), list(flags), name, out).filter(F.col(out) > 0)


def to_wide(df: DataFrame, index: str, columns: str, value: str, names: Sequence[str]) -> DataFrame:
    """Index x given names; duplicate cells average, missing cells are 0."""
    return df.groupBy(index).pivot(columns, list(names)).agg(F.avg(value)).fillna(0.0, list(names))


def dense_grid(
    df: DataFrame, group: str, value: str, first: int, last: int, year: str = "year", kind: str = "bigint"
) -> DataFrame:
    """Every year of the range for every observed, non-null group; 0 where nothing was counted.

    Works on aggregated counts. The years are a literal array exploded per group, and the
    observed cells are added to the zero cells, which needs one small aggregate and no join.
    """
    span = F.array(*[F.lit(y) for y in range(first, last + 1)])
    inside = (
        df.filter(F.col(group).isNotNull())
        .select(group, F.col(year).cast("int").alias(year), F.col(value).cast(kind).alias(value))
        .filter(F.col(year).between(first, last))
    )
    zeros = F.transform(span, lambda y: F.struct(y.cast("int").alias("y"), F.lit(0).cast(kind).alias("v")))
    own = F.array(F.struct(F.col(year).alias("y"), F.col(value).alias("v")))
    return (
        inside.select(group, F.explode(F.concat(own, zeros)).alias("c"))
        .groupBy(group, F.col("c.y").alias(year))
        .agg(F.sum("c.v").alias(value))
        .select(year, group, value)
    )
