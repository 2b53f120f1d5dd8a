"""Predicate joins and caliper joins."""

from __future__ import annotations

import itertools
import math
import operator
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# the distinct key values of one side are sent to every task only up to this many rows
SMALL_SIDE = 50_000
# tasks per core that matching pairs are spread over before they bring their rows back
PARTS_PER_CORE = 4
# halvings by which buckets are smaller where rows meet that lie in intervals
FINER = 3


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt by their content over a fixed number of tasks, which adaptive execution doesn't merge.

    Few keys may stand for very many result rows: the size of the keys says nothing of the work.
    """
    return df.repartition(PARTS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism, *df.columns)


def matching_pairs(dx: DataFrame, dy: DataFrame, cond: Column, small_side: int = SMALL_SIDE) -> DataFrame:
    """All pairs of two keyed tables that meet an arbitrary condition.

    The right side is counted up to the bound. Within it, it is broadcast. Beyond it, both sides are
    spread over a grid of cells: a left row goes to one random-free row of cells, a right row to one
    column, so each pair meets in exactly one cell and no cell is larger than the bound.
    """
    if dy.limit(small_side + 1).count() <= small_side:
        return dx.join(F.broadcast(dy), cond)
    nx, ny = dx.count(), dy.count()
    rows, cols = max(1, math.ceil(nx / small_side)), math.ceil(ny / small_side)
    gx = dx.withColumns({
        "_gr": F.pmod(F.xxhash64(*dx.columns), F.lit(rows)),
        "_gc": F.explode(F.sequence(F.lit(0), F.lit(cols - 1))),
    })
    gy = dy.withColumns({
        "_hc": F.pmod(F.xxhash64(*dy.columns), F.lit(cols)).cast("int"),
        "_hr": F.explode(F.sequence(F.lit(0), F.lit(rows - 1))),
    })
    same_cell = (gx["_gr"] == gy["_hr"]) & (gx["_gc"] == gy["_hc"])
    return gx.join(gy, same_cell & cond).drop("_gr", "_gc", "_hr", "_hc")


@dataclass(frozen=True)
class Band:
    """A predicate on numbers, dates or timestamps: lo <= left - right <= hi (in days or seconds for times).

    ``closed`` tells which ends belong to the band: both, left, right or neither.
    """

    lo: float
    hi: float
    closed: str = "both"

    def __post_init__(self) -> None:
        if not (math.isfinite(self.lo) and math.isfinite(self.hi) and self.closed in CLOSED):
            raise ValueError("a band has two finite ends, closed on both, left, right or neither")

    def __call__(self, a: Column, b: Column) -> Column:
        return inside(a - b, F.lit(self.lo), F.lit(self.hi), self.closed)


@dataclass(frozen=True)
class Between:
    """A predicate on a left key and two right keys: low <= left <= high, ends as in :class:`Band`."""

    closed: str = "both"

    def __call__(self, a: Column, low: Column, high: Column) -> Column:
        return inside(a, low, high, self.closed)


CLOSED = ("both", "left", "right", "neither")


def number_of(df: DataFrame, c: str) -> Column:
    """A key as a double: dates as days, timestamps as seconds since 1970."""
    kind = dict(df.dtypes)[c]
    if kind == "date":
        return F.unix_date(c).cast("double")
    if kind.startswith("timestamp"):
        return F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    return F.col(c).cast("double")


def inside(x: Column, low: Column, high: Column, closed: str) -> Column:
    from_low = x >= low if closed in ("both", "left") else x > low
    to_high = x <= high if closed in ("both", "right") else x < high
    return from_low & to_high


def _numbered(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Each key beside itself as a finite double; rows without one cannot match."""
    out = df.withColumns({f"_n{c}": number_of(df, c) for c in names})
    return out.where(reduce(lambda a, b: a & b, [F.abs(f"_n{c}") < float("inf") for c in names]))


def interval_pairs(dx: DataFrame, dy: DataFrame, point: str, ends: Sequence[str], test: Band | Between, cond: Column,
                   finer: int = 0, parts: int | None = None) -> DataFrame:
    """All pairs whose point lies in the interval of the other side, by an equality join on buckets.

    A band is as wide for every row: buckets have its width, so it touches two or three of them. Intervals of their own
    length touch at most two buckets of the power of two next above their length; a point is looked for once on each such
    level (few: one for each doubling of the length). What a join candidate costs is thus bounded by the pairs found; no two
    sides are compared as a whole. A crowded bucket is split by adaptive execution.

    ``finer``: by how many halvings the buckets of intervals of their own length are smaller, for fewer candidates that fail and
    fewer rows in a bucket, at the price of more copies of the intervals. ``parts``: tasks that the buckets are dealt to, merged by none;
    a merge join then needs neither side in memory.
    """
    x, y = _numbered(dx, [point]), _numbered(dy, ends)
    a = F.col(f"_n{point}")
    if isinstance(test, Band):
        if test.lo > test.hi:
            return dx.join(dy, F.lit(False))
        step = (test.hi - test.lo) or 1.0
        low, high = F.col(f"_n{ends[0]}") + test.lo, F.col(f"_n{ends[0]}") + test.hi
    else:
        low, high = F.col(f"_n{ends[0]}"), F.col(f"_n{ends[1]}")
        y = y.where(low <= high)
        least, most = y.agg(F.min(F.when(high > low, high - low)), F.max(F.greatest(F.abs(low), F.abs(high)))).first()
        step = max(least or 1.0, (most or 0.0) / 2.0**50)
    slack = lambda v: F.lit(1e-9) + F.abs(v / step) * 1e-12  # noqa: E731  what rounding may move a bucket's edge
    first, last = F.floor(low / step - slack(low)).cast("long"), F.floor(high / step + slack(high)).cast("long")
    if isinstance(test, Band):
        x = x.withColumn("_level", F.lit(0)).withColumn("_bucket", F.floor(a / step).cast("long"))
        y = y.withColumn("_level", F.lit(0)).withColumn("_bucket", F.explode(F.sequence(first, last)))
    else:
        y = y.withColumn("_level", F.greatest(F.ceil(F.log2((last - first + 1).cast("double"))).cast("int") - finer, F.lit(0)))
        levels = sorted(r[0] for r in y.select("_level").distinct().collect())  # at most one for each doubling
        y = y.withColumn("_bucket", F.explode(F.sequence(_shift(first, F.col("_level")), _shift(last, F.col("_level")))))
        x = x.withColumn("_level", F.explode(F.array(*[F.lit(k) for k in levels]).cast("array<int>")))
        x = x.withColumn("_bucket", _shift(F.floor(a / step).cast("long"), F.col("_level")))
    if parts is not None:
        helpers = [f"_n{c}" for c in (point, *ends)]  # not shuffled
        x, y = x.drop(*helpers).repartition(parts, "_level", "_bucket"), y.drop(*helpers).hint("merge")
    return x.join(y, ["_level", "_bucket"]).where(cond).select(*dx.columns, *dy.columns)


def _shift(bucket: Column, level: Column) -> Column:
    """The bucket of a higher level that holds a bucket."""
    return F.floor(bucket / F.pow(F.lit(2.0), level)).cast("long")


def _band_buckets(df: DataFrame, key: str, low: float, high: float, step: float, name: str, spans: bool) -> DataFrame:
    """Rows with the bucket that their key lies in, or (``spans``) one row for each bucket that their interval touches.

    Rows without a finite key meet nothing: their bucket comes from their content, so that they don't crowd one task.
    """
    n = number_of(df, key)
    known, own = F.abs(n) < float("inf"), F.xxhash64(*df.columns)
    if not spans:
        return df.withColumn(name, F.when(known, F.floor(n / step).cast("long")).otherwise(own))
    slack = lambda v: F.lit(1e-9) + F.abs(v / step) * 1e-12  # noqa: E731  what rounding may move a bucket's edge
    first, last = [F.floor(v / step + sign * slack(v)).cast("long") for v, sign in ((n + low, -1), (n + high, 1))]
    return df.withColumn(name, F.explode(F.when(known, F.sequence(first, last)).otherwise(F.array(own))))


def band_join(x: DataFrame, y: DataFrame, a: str, b: str, band: Band, cond: Column, how: str) -> DataFrame:
    """Rows joined on a band, without a list of pairs; ``cond`` is tested too. The sides must have no column name in common.

    Buckets have the band's width. One side has one bucket a row, the other two or three, so each pair meets once and
    the first side may be the outer one. What is shuffled grows with the sides, however many pairs there are; a merge join
    keeps the work on all cores where a side is small, and adaptive execution splits a crowded bucket.
    """
    step = abs(band.hi - band.lo) or 1.0
    x_spans = how == "right"
    x = _band_buckets(x, a, -band.hi, -band.lo, step, "_bx", x_spans)
    y = _band_buckets(y, b, band.lo, band.hi, step, "_by", not x_spans)
    return x.join(y.hint("merge"), (F.col("_bx") == F.col("_by")) & cond, how).drop("_bx", "_by")


def _keys(x: DataFrame, y: DataFrame, by) -> dict[str, tuple[str, ...]]:
    """Left key -> right keys. Without ``by`` the columns that both sides have; a list names such columns."""
    if by is None:
        by = [c for c in x.columns if c in y.columns]
        if not by:
            raise ValueError("the sides have no column in common; name the keys")
    if not isinstance(by, Mapping):
        by = {c: c for c in by}
    return {a: (b,) if isinstance(b, str) else tuple(b) for a, b in by.items()}


def predicate_join(x: DataFrame, y: DataFrame, by: Mapping[str, str | tuple[str, str]] | Sequence[str] | None = None,
                   match: Callable[..., Column] | Sequence[Callable[..., Column]] | None = None,
                   how: str = "inner", multi: bool = False, distance: tuple[str, Callable[..., Column]] | None = None,
                   small_side: int = SMALL_SIDE, index: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """Join on predicates instead of equality, in any of the modes inner, left, right, full, semi, anti.

    ``by`` maps left key columns to right key columns (to a pair of them for :class:`Between`); a list names keys that both
    sides have, and without it these are all common columns. ``match`` is one predicate for all columns, one
    per column (all must hold), or with ``multi`` a single predicate over all left and right keys.
    Predicates are evaluated once per distinct pair of key values; equality joins bring the rows back,
    so repeated (hot) values cost nothing extra in the predicate step. Pairs are spread over all cores first; few pairs
    of an arbitrary predicate are broadcast to the spread left rows instead. A NULL key matches nothing.
    If a predicate is a :class:`Band` or :class:`Between`, or the plain equality ``operator.eq``, candidates come from an equality
    join and the other predicates are tested on them; only other predicates compare all distinct values. With bands only, or inner with
    a :class:`Between` (and no ``distance``), the rows themselves meet in buckets, and no pairs of values are listed.
    ``index`` takes the place of ``match``: it gets both tables of distinct keys, under their own names (the right ones with
    ``_y`` where both sides have the name), and returns the pairs, with further columns if it likes.
    Columns present on both sides get the endings ``_x`` and ``_y``. ``distance`` (name, function of all
    keys) adds a column computed for each matching pair.
    """
    keys = _keys(x, y, by)
    kx, ky = list(keys), [c for group in keys.values() for c in group]
    tx, ty = [f"_kx{i}" for i in range(len(kx))], [f"_ky{i}" for i in range(len(ky))]
    if index is None and not multi and distance is None:
        fns = [match] * len(kx) if callable(match) else list(match or ())
        if len(fns) == len(kx) == len(ky) and all(isinstance(f, Band) for f in fns):
            return _bands_only(x, y, kx, ky, fns, how)
        if how == "inner" and len(fns) == len(kx) and any(isinstance(f, Between) for f in fns) and operator.eq not in fns:
            return _rows_in_intervals(x, y, keys, fns)
    dx = x.select(*[F.col(c).alias(t) for c, t in zip(kx, tx)]).dropna().distinct()
    dy = y.select(*[F.col(c).alias(t) for c, t in zip(ky, ty)]).dropna().distinct()
    extra: list[str] = []
    any_predicate = False
    if index is not None:
        own = [c + "_y" if c in kx else c for c in ky]
        pairs = index(dx.toDF(*kx), dy.toDF(*own))
        extra = [c for c in pairs.columns if c not in (*kx, *own)]
        pairs = pairs.select(*[F.col(c).alias(t) for c, t in zip((*kx, *own), (*tx, *ty))], *extra).dropna(subset=[*tx, *ty]).distinct()
    elif multi:
        any_predicate = True
        pairs = matching_pairs(dx, dy, match(*[F.col(c) for c in tx], *[F.col(c) for c in ty]), small_side)
    else:
        fns = [match] * len(kx) if callable(match) else list(match or ())
        if len(fns) != len(kx):
            raise ValueError("need one predicate per key column")
        at = [0, *itertools.accumulate(len(g) for g in keys.values())]
        right = [ty[i:j] for i, j in itertools.pairwise(at)]
        value = lambda f, df, c: number_of(df, c) if isinstance(f, Band | Between) else F.col(c)
        cond = reduce(lambda a, b: a & b, [f(value(f, dx, a), *[value(f, dy, c) for c in b]) for f, a, b in zip(fns, tx, right)])
        plain = [i for i, f in enumerate(fns) if f is operator.eq]
        ranged = [i for i, f in enumerate(fns) if isinstance(f, Band | Between)]
        if plain:
            same = reduce(lambda a, b: a & b, [F.col(tx[i]) == F.col(right[i][0]) for i in plain])
            pairs = dx.join(dy, same & cond)
        elif ranged:
            i = ranged[0]
            pairs = interval_pairs(dx, dy, tx[i], right[i], fns[i], cond)
        else:
            any_predicate = True
            pairs = matching_pairs(dx, dy, cond, small_side)
    if distance:
        pairs = pairs.withColumn(distance[0], distance[1](*[F.col(c) for c in tx], *[F.col(c) for c in ty]))
        extra = [*extra, distance[0]]
    if how not in ("semi", "anti"):
        few = any_predicate and pairs.limit(small_side + 1).count() <= small_side
        pairs = F.broadcast(pairs) if few else spread(pairs)

    on_x = reduce(lambda a, b: a & b, [F.col(c) == F.col(t) for c, t in zip(kx, tx)])
    if how in ("semi", "anti"):
        return x.join(pairs.select(*tx).distinct(), on_x, f"left_{how}")
    both = set(x.columns) & set(y.columns)
    left = x.select(*[F.col(c).alias(c + "_x" if c in both else c) for c in x.columns])
    right = y.select(*[F.col(c).alias(c + "_y" if c in both else c) for c in y.columns])
    name_x = lambda c: c + "_x" if c in both else c
    name_y = lambda c: c + "_y" if c in both else c
    out_cols = [*left.columns, *right.columns, *extra]
    to_x = reduce(lambda a, b: a & b, [F.col(name_x(c)) == F.col(t) for c, t in zip(kx, tx)])
    to_y = reduce(lambda a, b: a & b, [F.col(name_y(c)) == F.col(t) for c, t in zip(ky, ty)])
    if how == "inner":
        return (spread(left) if few else left).join(pairs, to_x).join(right, to_y).select(*out_cols)
    if how == "left":
        return left.join(pairs.join(right, to_y), to_x, "left").select(*out_cols)
    if how == "right":
        return right.join(pairs.join(left, to_x), to_y, "left").select(*out_cols)
    if how == "full":
        hits = left.join(pairs, to_x).join(right, to_y).select(*out_cols)
        lone_x = left.join(pairs.select(*tx).distinct(), to_x, "left_anti")
        lone_y = right.join(pairs.select(*ty).distinct(), to_y, "left_anti")
        return hits.unionByName(lone_x, allowMissingColumns=True).unionByName(lone_y, allowMissingColumns=True)
    raise ValueError(f"unknown mode {how}")


def _bands_only(x: DataFrame, y: DataFrame, kx: Sequence[str], ky: Sequence[str], bands: Sequence[Band], how: str) -> DataFrame:
    """A predicate join all of whose predicates are bands; the first one makes the buckets."""
    def test(left: DataFrame, right: DataFrame, of_x: Sequence[str], of_y: Sequence[str]) -> Column:
        return reduce(lambda a, b: a & b, [f(number_of(left, a), number_of(right, b)) for f, a, b in zip(bands, of_x, of_y)])

    tx, ty = [f"_kx{i}" for i in range(len(kx))], [f"_ky{i}" for i in range(len(ky))]
    if how in ("semi", "anti"):
        keys = y.select(*[F.col(c).alias(t) for c, t in zip(ky, ty)]).distinct()
        return band_join(x, keys, kx[0], ty[0], bands[0], test(x, keys, kx, ty), f"left_{how}")
    if how not in ("inner", "left", "right", "full"):
        raise ValueError(f"unknown mode {how}")
    both = set(x.columns) & set(y.columns)
    left = x.select(*[F.col(c).alias(c + "_x" if c in both else c) for c in x.columns])
    right = y.select(*[F.col(c).alias(c + "_y" if c in both else c) for c in y.columns])
    own_x, own_y = [c + "_x" if c in both else c for c in kx], [c + "_y" if c in both else c for c in ky]
    hits = band_join(left, right, own_x[0], own_y[0], bands[0], test(left, right, own_x, own_y), "left" if how == "full" else how)
    hits = hits.select(*left.columns, *right.columns)
    if how != "full":
        return hits
    keys = left.select(*[F.col(c).alias(t) for c, t in zip(own_x, tx)]).distinct()
    back = Band(-bands[0].hi, -bands[0].lo)
    lone_y = band_join(right, keys, own_y[0], tx[0], back, test(keys, right, tx, own_y), "left_anti")
    return hits.unionByName(lone_y, allowMissingColumns=True)


def _rows_in_intervals(x: DataFrame, y: DataFrame, keys: Mapping[str, tuple[str, ...]], fns: Sequence[Callable[..., Column]]) -> DataFrame:
    """An inner predicate join with a :class:`Between`; the first one makes the buckets, in which the rows themselves meet.

    What is shuffled are copies of the rows: one for each length of intervals on the left, up to 2^(FINER + 1) on the right.
    A list of pairs, as long as the result where values don't repeat, is never made.
    """
    both = set(x.columns) & set(y.columns)
    left = x.select(*[F.col(c).alias(c + "_x" if c in both else c) for c in x.columns])
    right = y.select(*[F.col(c).alias(c + "_y" if c in both else c) for c in y.columns])
    own_x = [c + "_x" if c in both else c for c in keys]
    own_y = [[c + "_y" if c in both else c for c in group] for group in keys.values()]
    known = [*own_x], [c for group in own_y for c in group]
    left, right = left.dropna(subset=known[0]), right.dropna(subset=known[1])
    value = lambda f, df, c: number_of(df, c) if isinstance(f, Band | Between) else F.col(c)
    cond = reduce(lambda a, b: a & b, [
        f(value(f, left, a), *[value(f, right, c) for c in group]) for f, a, group in zip(fns, own_x, own_y)])
    i = next(i for i, f in enumerate(fns) if isinstance(f, Between))
    spark = x.sparkSession
    parts = max(PARTS_PER_CORE * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return interval_pairs(left, right, own_x[i], own_y[i], fns[i], cond, FINER, parts)


def caliper_join(x: DataFrame, y: DataFrame, on: Sequence[str], calipers: Mapping[str, float],
                 how: str = "inner") -> DataFrame:
    """Equality on ``on`` and absolute difference within the caliper for each caliper column.

    When there is an equality key the calipers are a residual condition of that hash join. The right
    copy of the caliper columns gets the ending ``_y``.
    """
    right = y.select(*[F.col(c).alias("_y_" + c) for c in on],
                     *[F.col(c).alias(c + "_y") if c in x.columns else F.col(c) for c in y.columns if c not in on])
    cond = [x[c] == right["_y_" + c] for c in on]
    cond += [F.abs(x[c] - right[c + "_y"]) <= F.lit(w) for c, w in calipers.items()]
    out = x.join(right, reduce(lambda a, b: a & b, cond), how)
    return out.drop(*["_y_" + c for c in on])
