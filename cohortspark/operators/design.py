"""Design matrices as named Column expressions: numbers, powers, factors, natural splines, products."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from cohortspark.operators.ranking import quantiles

MAX_LEVELS = 1000


@dataclass(frozen=True)
class Number:
    col: str


@dataclass(frozen=True)
class Powers:
    """x, x squared, ... as raw powers."""

    col: str
    degree: int = 2


@dataclass(frozen=True)
class Factor:
    """Indicator columns for all levels but the first. Levels not given are read from the data, sorted."""

    col: str
    levels: tuple[str, ...] = ()


@dataclass(frozen=True)
class Spline:
    """Natural cubic spline with df columns; inner knots at equally spaced quantiles of the data, outer
    knots at its range, linear beyond."""

    col: str
    df: int = 5
    knots: tuple[float, ...] = ()


@dataclass(frozen=True)
class Product:
    """All products of the columns of two terms."""

    left: object
    right: object


@dataclass(frozen=True)
class Entry:
    """One column of the matrix."""

    name: str
    variable: str
    label: str
    expr: Column


@dataclass(frozen=True)
class Design:
    """Fitted design: knots and levels are fixed, so new rows get the training basis."""

    terms: tuple
    entries: tuple[Entry, ...]

    @property
    def names(self) -> list[str]:
        return [e.name for e in self.entries]

    def prepare(self, df: DataFrame) -> DataFrame:
        """Add the spline basis columns once, so that later expressions only refer to them."""
        new = {n: e for t in self.splines() for n, e in zip(_basis_names(t), spline_basis(F.col(t.col), t.knots))}
        return df.withColumns({n: e for n, e in new.items() if n not in df.columns}) if new else df

    def splines(self) -> list[Spline]:
        flat = [t for term in self.terms for t in ((term.left, term.right) if isinstance(term, Product) else (term,))]
        return list(dict.fromkeys(t for t in flat if isinstance(t, Spline)))

    def helper_columns(self) -> list[str]:
        return [n for t in self.splines() for n in _basis_names(t)]

    def curved(self) -> tuple:
        """The terms that hold a spline."""
        return tuple(t for t in self.terms if any(
            isinstance(x, Spline) for x in ((t.left, t.right) if isinstance(t, Product) else (t,))))

    def straight(self) -> tuple:
        return tuple(t for t in self.terms if t not in self.curved())

    def parted(self, columns: Sequence[str]) -> tuple[tuple, tuple]:
        """The terms that read only some columns, and the others."""
        inside = tuple(t for t in self.terms if columns_of(t) <= set(columns))
        return inside, tuple(t for t in self.terms if t not in inside)

    def linear(self, coef: Sequence[float], terms: Sequence[object] | None = None) -> Column:
        """Weighted sum of the columns, or of those of some terms. All levels of a factor share one lookup, so the expression stays
        small however many columns the design has."""
        weight = dict(zip(self.names, coef))
        total = F.lit(0.0)
        for term in self.terms if terms is None else terms:
            total = total + _weighted(term, weight)
        return total

    def array(self) -> Column:
        return F.array(*[e.expr.cast("double") for e in self.entries])

    def vector(self) -> Column:
        return array_to_vector(self.array())

    def keep(self, names: Sequence[str]) -> Design:
        wanted = set(names)
        return replace(self, entries=tuple(e for e in self.entries if e.name in wanted))


def _fix(term, df: DataFrame, known: dict, rows: str | None):
    """Read knots and levels from the training rows where the term leaves them open, each only once."""
    if isinstance(term, Product):
        return Product(_fix(term.left, df, known, rows), _fix(term.right, df, known, rows))
    if term not in known:
        known[term] = _read(term, df, rows)
    return known[term]


def _read(term, df: DataFrame, rows: str | None):
    if isinstance(term, Factor) and not term.levels:
        rows = df.select(term.col).where(F.col(term.col).isNotNull()).distinct().limit(MAX_LEVELS + 1).collect()
        if len(rows) > MAX_LEVELS:
            raise ValueError(f"{term.col} has more than {MAX_LEVELS} levels")
        return Factor(term.col, tuple(sorted(r[0] for r in rows)))
    if isinstance(term, Spline) and not term.knots:
        probs = [0.0, *[i / term.df for i in range(1, term.df)], 1.0]
        q = quantiles(df, [term.col], probs, kind=7, rows=rows).collect()
        return Spline(term.col, term.df, tuple(sorted({r["quantile"] for r in q})))
    return term


def _basis_names(term: Spline) -> list[str]:
    tag = zlib.crc32(repr((term.col, term.knots)).encode())
    return [f"_ns{tag}_{i}" for i in range(len(term.knots) - 1)]


def _weighted(term, weight: dict[str, float]) -> Column:
    """One term's part of the linear predictor; columns without a weight were dropped from the fit."""
    if isinstance(term, Factor):
        return _lookup(term, {lv: weight.get(f"{term.col}{lv}") for lv in term.levels[1:]})
    if isinstance(term, Product) and isinstance(term.right, Factor):
        parts = [
            e.expr.cast("double") * _lookup(term.right, {
                lv: weight.get(f"{e.name}:{term.right.col}{lv}") for lv in term.right.levels[1:]})
            for e in _entries(term.left)
        ]
        return reduce(lambda a, b: a + b, parts)
    parts = [F.lit(weight[e.name]) * e.expr.cast("double") for e in _entries(term) if e.name in weight]
    return reduce(lambda a, b: a + b, parts, F.lit(0.0))


def _lookup(term: Factor, values: dict[str, float | None]) -> Column:
    x, out = F.col(term.col), None
    for level, v in values.items():
        if v is not None:
            hit = x == F.lit(level)
            out = F.when(hit, F.lit(v)) if out is None else out.when(hit, F.lit(v))
    return F.lit(0.0) if out is None else out.otherwise(F.lit(0.0))


def _entries(term) -> list[Entry]:
    if isinstance(term, Number):
        return [Entry(term.col, term.col, term.col, F.col(term.col))]
    if isinstance(term, Powers):
        x = F.col(term.col).cast("double")
        return [Entry(f"{term.col}^{d}", term.col, f"{term.col}^{d}", F.pow(x, F.lit(float(d)))) for d in range(1, term.degree + 1)]
    if isinstance(term, Factor):
        x = F.col(term.col)
        return [Entry(f"{term.col}{lv}", term.col, str(lv), (x == F.lit(lv)).cast("double")) for lv in term.levels[1:]]
    if isinstance(term, Spline):
        name = f"spline({term.col})"
        return [Entry(f"{name}{i + 1}", name, f"{name}{i + 1}", F.col(c)) for i, c in enumerate(_basis_names(term))]
    if isinstance(term, Product):
        return [
            Entry(f"{a.name}:{b.name}", f"{a.variable}:{b.variable}", f"{a.label}:{b.label}", a.expr * b.expr)
            for b in _entries(term.right) for a in _entries(term.left)
        ]
    raise TypeError(f"unknown term {term!r}")


def spline_basis(x: Column, knots: Sequence[float]) -> list[Column]:
    """Natural cubic spline columns in truncated-power form on the unit range (no constant)."""
    lo, hi = knots[0], knots[-1]
    u = (x.cast("double") - F.lit(lo)) / F.lit(hi - lo)
    k = [(v - lo) / (hi - lo) for v in knots]
    cube = lambda at: F.pow(F.greatest(u - F.lit(at), F.lit(0.0)), F.lit(3.0))
    bend = lambda i: (cube(k[i]) - cube(k[-1])) / F.lit(k[-1] - k[i])
    return [u] + [bend(i) - bend(len(k) - 2) for i in range(len(k) - 2)]


def columns_of(term) -> set[str]:
    """Data columns a term reads."""
    return columns_of(term.left) | columns_of(term.right) if isinstance(term, Product) else {term.col}


def fit_design(df: DataFrame, terms: Sequence[object], rows: str | None = None) -> Design:
    """``rows``: a column with how many rows each row stands for."""
    known: dict = {}
    fixed = tuple(_fix(t, df, known, rows) for t in terms)
    return Design(fixed, tuple(e for t in fixed for e in _entries(t)))


def gram(df: DataFrame, x: str, weight: str | None = None) -> np.ndarray:
    """Sum of w x x' over all rows: one partial matrix per task, added up by Spark."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if not b.num_rows:
                continue
            m = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            part = m.T @ (m * b.column(1).to_numpy(zero_copy_only=False)[:, None] if weight else m)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["k", "v"])

    cols = [x] + ([weight] if weight else [])
    sums = df.select(*cols).mapInArrow(partial, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas()
    p = int(round(len(sums) ** 0.5))
    return sums.sort_values("k")["v"].to_numpy().reshape(p, p)


def independent(matrix: np.ndarray, tol: float = 1e-9) -> list[int]:
    """Columns that are not linear combinations of earlier ones, from their cross-product matrix."""
    scale = np.sqrt(np.where(np.diag(matrix) > 0, np.diag(matrix), 1.0))
    a = matrix / np.outer(scale, scale)
    kept: list[int] = []
    for j in range(len(a)):
        if np.diag(matrix)[j] <= 0:
            continue
        rest = a[j, j]
        if kept:
            sub = a[np.ix_(kept, kept)]
            rest -= a[j, kept] @ np.linalg.solve(sub, a[kept, j])
        if rest > tol:
            kept.append(j)
    return kept
