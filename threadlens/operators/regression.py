"""Logistic regression of negativity on mention group, year and lexicon flags, fitted on counted cells."""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.session import materialise

Z95 = 1.96
MAX_CELLS = 100_000  # as many combinations of regressors are summed up in the driver; more, in tasks
FAR = 15.0  # log odds beyond which a fit that does not settle counts as running away
SETTLED = 1e-9
RESULT = "term string, estimate double, conf_low double, conf_high double, p_value double"


class NotConverged(ArithmeticError):
    """No estimate was found; there are no numbers to give."""


@dataclass(frozen=True)
class Fit:
    """Estimates with their covariance; ``method`` is ``likelihood`` or, for separated outcomes, ``firth``."""

    terms: list[str]
    estimates: np.ndarray
    covariance: np.ndarray
    method: str
    steps: int


def cell_sums(cells: np.ndarray, at: np.ndarray, inverse: np.ndarray | None = None) -> np.ndarray:
    """What one step needs of the cells (trials, hits, regressors), flat: log likelihood, observed sums, score, information.

    With the inverse information the score is Firth's, which takes off the estimate's first-order bias.
    """
    trials, hits, x = cells[:, 0], cells[:, 1], cells[:, 2:]
    odds = x @ at
    p = 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
    weight = trials * p * (1 - p)
    likelihood = (hits * odds - trials * np.logaddexp(0, odds)).sum()
    missed = hits - trials * p
    if inverse is not None:
        missed = missed + weight * np.einsum("ni,ij,nj->n", x, inverse, x) * (0.5 - p)
    information = x.T @ (x * weight[:, None])
    return np.concatenate([[likelihood], x.T @ hits, x.T @ missed, information.ravel(), [np.abs(odds).max(initial=0)]])


def _added(parts: list[np.ndarray]) -> np.ndarray:
    """Sums of all but the last number, which is the furthest log odds."""
    both = np.sum(parts, axis=0)
    both[-1] = max(p[-1] for p in parts)
    return both


class Sums:
    """``cell_sums`` over all cells: in the driver while they are few, else in tasks that return one row each."""

    def __init__(self, cells: DataFrame, columns: Sequence[str], max_cells: int) -> None:
        self.table = cells.select(*[F.col(c).cast("double") for c in columns])
        rows = self.table.limit(max_cells + 1).collect()
        few = len(rows) <= max_cells
        self.rows = np.array([tuple(r) for r in rows], float).reshape(len(rows), len(columns)) if few else None
        self.width = len(columns) - 2

    def at(self, point: np.ndarray, inverse: np.ndarray | None = None) -> tuple:
        """Log likelihood, observed sums, score, information, furthest log odds."""
        if self.rows is not None:
            parts = [cell_sums(self.rows, point, inverse)]
        else:
            parts = [np.frombuffer(r[0]) for r in self.table.mapInArrow(self._task(point, inverse), "s binary").collect()]
        total, w = _added(parts), self.width
        return float(total[0]), total[1 : 1 + w], total[1 + w : 1 + 2 * w], total[1 + 2 * w : -1].reshape(w, w), float(total[-1])

    @staticmethod
    def _task(point: np.ndarray, inverse: np.ndarray | None):
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = [cell_sums(np.column_stack([c.to_numpy() for c in b.columns]), point, inverse) for b in batches]
            if sums:
                yield pa.RecordBatch.from_arrays([pa.array([_added(sums).tobytes()])], ["s"])

        return add


def _climb(sums: Sums, max_iter: int, firth: bool) -> tuple[np.ndarray, np.ndarray, int, bool, float]:
    """Newton steps, halved while they lower the (penalised) likelihood: point, information, steps, settled, furthest odds."""

    def look(point):
        likelihood, _, score, information, far = sums.at(point)
        if firth:
            sign, size = np.linalg.slogdet(information)
            likelihood = likelihood + size / 2 if sign > 0 else -math.inf
        return likelihood, score, information, far

    point = np.zeros(sums.width)
    likelihood, score, information, far = look(point)
    for steps in range(1, max_iter + 1):
        try:
            inverse = np.linalg.inv(information)
        except np.linalg.LinAlgError:
            return point, information, steps, False, far
        if firth:
            score = sums.at(point, inverse)[2]
        step = inverse @ score
        # the steps of a fit that runs away stay near 1, however little its likelihood gains
        if (np.abs(step) <= SETTLED * (1 + np.abs(point))).all():
            return point, information, steps, True, far
        share = 1.0
        found = look(point + step)
        while found[0] < likelihood - 1e-10 * abs(likelihood) and share > 1e-6:
            share /= 2
            found = look(point + share * step)
        point = point + share * step
        likelihood, score, information, far = found
    return point, information, max_iter, False, far


def _independent(information: np.ndarray, first: int) -> list[int]:
    """Positions whose columns the ones before do not determine, ``first`` before all."""
    kept: list[int] = []
    scale = np.sqrt(np.maximum(np.diag(information), 1e-300))
    scaled = information / np.outer(scale, scale)
    for i in [first, *[j for j in range(len(scaled)) if j != first]] if len(scaled) else []:
        if information[i, i] <= 0:
            continue
        rest = scaled[i, i]
        if kept:
            block = scaled[np.ix_(kept, kept)]
            rest -= scaled[i, kept] @ np.linalg.solve(block, scaled[kept, i])
        if rest > 1e-10:
            kept.append(i)
    return sorted(kept)


def count_cells(df: DataFrame, outcome: str, dummies: Sequence[str], year: str) -> DataFrame:
    """One row for each combination of regressors: ``_year``, the flags, ``trials`` and ``hits``."""
    kept = df.filter(F.col(outcome).isNotNull() & F.col(year).isNotNull())
    for d in dummies:
        kept = kept.filter(F.col(d).isNotNull())
    return kept.groupBy(
        F.col(year).cast("double").alias("_year"), *[F.col(d).cast("double").alias(d) for d in dummies]
    ).agg(F.count("*").cast("double").alias("trials"), F.sum(F.col(outcome).cast("double")).alias("hits"))


def fit_logit(
    df: DataFrame, outcome: str, dummies: Sequence[str], year: str = "year", intercept: bool = True,
    max_iter: int = 50, max_cells: int = MAX_CELLS,
) -> tuple[Fit | None, Sums | None]:
    """The fit and the sums it was made on; None where there are no rows or no regressors.

    The year is centred on its mean. Regressors that are constant or that others determine are
    dropped with a warning. Where some combination of regressors parts the outcomes, the likelihood has
    no highest point; Firth's penalised likelihood has one and is used, with a warning. A fit that
    does not settle raises ``NotConverged``.
    """
    # Written once, so that a lost executor costs a read of a few rows and not a new scan.
    cells = materialise(count_cells(df, outcome, dummies, year), "logit-cells")
    facts = cells.agg(
        (F.sum(F.col("_year") * F.col("trials")) / F.sum("trials")).alias("mean_year"),
        (F.min("_year") < F.max("_year")).alias("year_c"),
        *[(F.min(d) < F.max(d)).alias(d) for d in dummies],
    ).first()
    terms = [t for t in [*dummies, "year_c"] if facts[t]]
    for dropped in sorted({*dummies, "year_c"} - set(terms)):
        warnings.warn(f"regressor {dropped} is constant and was dropped", stacklevel=3)
    if facts["mean_year"] is None or not (terms or intercept):
        return None, None
    ready = cells.withColumns({"year_c": F.col("_year") - F.lit(facts["mean_year"]), "intercept": F.lit(1.0)})
    names = [*terms, "intercept"] if intercept else terms
    sums = Sums(ready, ["trials", "hits", *names], max_cells)
    kept = _independent(sums.at(np.zeros(len(names)))[3], len(names) - 1 if intercept else 0)
    if len(kept) < len(names):
        for i in sorted(set(range(len(names))) - set(kept)):
            warnings.warn(f"regressor {names[i]} is determined by others and was dropped", stacklevel=3)
        names = [names[i] for i in kept]
        sums = Sums(ready, ["trials", "hits", *names], max_cells)
    method = "likelihood"
    point, information, steps, settled, far = _climb(sums, max_iter, firth=False)
    if not settled and far > FAR:
        warnings.warn("regressors part the outcomes; estimates are Firth's", stacklevel=3)
        method = "firth"
        # its steps follow the score, not the penalty's own curvature, and so take longer
        point, information, steps, settled, far = _climb(sums, 20 * max_iter, firth=True)
    if not settled:
        raise NotConverged(f"the fit did not settle in {steps} steps")
    return Fit(names, point, np.linalg.inv(information), method, steps), sums


def negativity_logit(
    df: DataFrame, outcome: str, dummies: Sequence[str], year: str = "year", intercept: bool = True,
    max_iter: int = 50, max_cells: int = MAX_CELLS,
) -> DataFrame:
    """``term, estimate, conf_low, conf_high, p_value`` of a binomial logit.

    Rows are first counted per combination of regressors, which gives the estimates, errors and
    p-values of a fit on all rows (see ``fit_logit``). No rows give no terms.
    """
    fit, _ = fit_logit(df, outcome, dummies, year, intercept, max_iter, max_cells)
    rows = []
    for name, value, variance in zip(fit.terms, fit.estimates, np.diag(fit.covariance)) if fit else []:
        error = math.sqrt(variance)
        p_value = math.erfc(abs(value) / error / math.sqrt(2))
        rows.append((name, float(value), float(value - Z95 * error), float(value + Z95 * error), p_value))
    return df.sparkSession.createDataFrame(rows, RESULT)


def score_balance(
    df: DataFrame, outcome: str, dummies: Sequence[str], year: str = "year", intercept: bool = True,
    max_iter: int = 50, max_cells: int = MAX_CELLS,
) -> DataFrame:
    """``term, observed, fitted``: the sum of each regressor over positive outcomes, and what the fit makes of it.

    At the highest point of the likelihood, and there alone, both agree (for Firth's fit, its penalty included).
    """
    fit, sums = fit_logit(df, outcome, dummies, year, intercept, max_iter, max_cells)
    rows = []
    if fit:
        _, observed, score, _, _ = sums.at(fit.estimates, fit.covariance if fit.method == "firth" else None)
        rows = [(t, float(o), float(o - s)) for t, o, s in zip(fit.terms, observed, score)]
    return df.sparkSession.createDataFrame(rows, "term string, observed double, fitted double")
