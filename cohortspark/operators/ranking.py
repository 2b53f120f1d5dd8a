"""Exact ranks, quantiles and order statistics that never gather a whole group in one task.

A group (a stratum, a subgroup level, or no grouping at all) may hold a large share of all rows, so
a plain window or an exact-percentile aggregate over it would put that share into one task. Each
operator here first cuts the value range into buckets, counts per (group, bucket), and then only
works inside the buckets it needs.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cohortspark.session import stable

ROWS_PER_BUCKET = 1_000_000
MAX_BUCKETS = 8192


def bucket_bounds(df: DataFrame, value: str, n_buckets: int) -> list[float]:
    """Inner bucket boundaries: approximate quantiles from one bounded-memory aggregate."""
    if n_buckets <= 1:
        return []
    probs = [i / n_buckets for i in range(1, n_buckets)]
    row = df.agg(
        F.percentile_approx(F.col(value).cast("double"), probs, min(10 * n_buckets, 100_000)).alias("q")
    ).first()
    return sorted(set(row["q"] or []))


def add_bucket(df: DataFrame, value: str, bounds: Sequence[float], name: str = "_bucket") -> DataFrame:
    """Monotone bucket number of a numeric column (binary search on the JVM; NULLs get their own)."""
    if not bounds:
        return df.withColumn(name, F.lit(0.0))
    cut = Bucketizer(splits=[-math.inf, *bounds, math.inf], inputCol="_v", outputCol=name, handleInvalid="keep")
    return cut.transform(df.withColumn("_v", F.col(value).cast("double"))).drop("_v")


def n_buckets_for(rows: int, rows_per_bucket: int) -> int:
    return max(1, min(MAX_BUCKETS, math.ceil(rows / rows_per_bucket)))


def row_numbers(df: DataFrame, by: Sequence[str], order: str, name: str = "rank",
                rows_per_bucket: int = ROWS_PER_BUCKET, ties: Sequence[str] = ()) -> DataFrame:
    """Exact ``row_number`` within ``by`` ordered by a numeric column (then ``ties``).

    Large inputs take two steps: a row number inside each (group, value bucket), plus the number of
    rows in the lower buckets of the group, which comes from a small count table.
    """
    rows = df.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    n = n_buckets_for(rows, rows_per_bucket)
    keys = [F.col(k) for k in by]
    if n == 1:
        w = W.partitionBy(*keys).orderBy(order, *ties)
        return df.withColumn(name, F.row_number().over(w).cast("long"))
    df = stable(df)  # read for the bounds, the counts and the rows
    cut = add_bucket(df, order, bucket_bounds(df, order, n))
    counts = cut.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        *[F.col(k).alias("_k_" + k) for k in by], F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
    )
    inner = W.partitionBy(*keys, "_bucket").orderBy(order, *ties)
    placed = cut.withColumn("_pos", F.row_number().over(inner))
    cond = [placed[k].eqNullSafe(offsets["_k_" + k]) for k in by] + [placed["_bucket"] == offsets["_b"]]
    return (
        placed.join(offsets, cond)
        .withColumn(name, (F.col("_pos") + F.col("_offset")).cast("long"))
        .select(*df.columns, name)
    )


def kth_smallest(df: DataFrame, col: str, k: int, fanout: int = 4096) -> int | None:
    """The k-th smallest value of an integer column (its maximum when there are fewer rows).

    Repeated equal-width histograms narrow the range; each pass is one aggregate of at most
    ``fanout`` groups, and a 64-bit range needs at most six passes.
    """
    if k < 1:
        return None
    lo, hi, n = df.agg(F.min(col), F.max(col), F.count(col)).first()
    if n == 0:
        return None
    if k >= n:
        return hi
    while lo < hi:
        width = -(-(hi - lo + 1) // fanout)
        bins = (
            df.where(F.col(col).between(lo, hi))
            .groupBy(F.expr(f"(`{col}` - {lo}L) div {width}L").alias("b"))
            .agg(F.count(F.lit(1)).alias("n"))
            .collect()
        )
        for b, count in sorted((r["b"], r["n"]) for r in bins):
            if k <= count:
                lo, hi = lo + b * width, min(hi, lo + (b + 1) * width - 1)
                break
            k -= count
    return lo


def value_counts_long(df: DataFrame, by: Sequence[str], cols: Sequence[str], known: bool = True, rows: str | None = None) -> DataFrame:
    """(by..., variable, value, n): how often each numeric value occurs, several columns at once; ``known``: without
    missing values and not-a-number; ``rows``: a column with how many rows each row stands for."""
    number = F.lit(1) if rows is None else F.col(rows)
    stacked = df.select(
        *by, number.alias("_rows"),
        F.posexplode(F.array(*[F.col(c).cast("double") for c in cols])).alias("_place", "value"),
    )
    if known:
        stacked = stacked.where(F.col("value").isNotNull() & ~F.isnan("value"))
    # grouped by the column's place, which is quicker to hash and to compare than its name
    counts = stacked.groupBy(*by, "_place", "value").agg(F.sum("_rows").alias("n"))
    names = F.array(*[F.lit(c) for c in cols])
    return counts.select(*by, F.element_at(names, F.col("_place") + 1).alias("variable"), "value", "n")


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = (),
              kind: int = 1, rows_per_bucket: int = ROWS_PER_BUCKET, rows: str | None = None) -> DataFrame:
    """Exact quantiles per group and variable: columns (by..., variable, prob, quantile).

    ``rows``: a column with how many rows each row stands for. ``kind`` 1 is the inverse of the empirical distribution function, 2 is the same with averaging at
    its steps, 7 interpolates linearly.
    Equal values are counted together before anything is shuffled. A large input is then cut into
    value buckets; only buckets holding a wanted rank are sorted.
    """
    # read for their number, the bounds, the bucket sizes and the values
    return quantiles_of_counts(stable(value_counts_long(df, by, cols, rows=rows)), cols, probs, by, kind, rows_per_bucket)


def quantiles_of_counts(counts: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = (),
                        kind: int = 1, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """The quantiles from how often each value occurs (:func:`value_counts_long`), which is read several times."""
    keys = [*by, "variable"]
    rows = counts.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    n = n_buckets_for(rows, rows_per_bucket)
    counts = _bucket_each(counts, cols, n)
    per_bucket = counts.groupBy(*keys, "_bucket").agg(F.sum("n").alias("_n"))
    running = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, 0)
    spans = per_bucket.select(
        *keys, "_bucket",
        (F.sum("_n").over(running) - F.col("_n")).alias("_lo"),
        F.sum("_n").over(running).alias("_hi"),
        F.sum("_n").over(W.partitionBy(*keys)).alias("_total"),
    )
    targets = spans.select(
        *[F.col(k).alias("_t_" + k) for k in keys], F.col("_bucket").alias("_tb"), "_lo", "_hi",
        F.explode(F.array(*[_rank_struct(p, kind) for p in probs])).alias("_w"),
    ).select("*", "_w.*").drop("_w")
    targets = targets.where(
        ((F.col("_r1") > F.col("_lo")) & (F.col("_r1") <= F.col("_hi")))
        | ((F.col("_r2") > F.col("_lo")) & (F.col("_r2") <= F.col("_hi")))
    )
    wanted = targets.select(
        *[F.col("_t_" + k).alias("_u_" + k) for k in keys], F.col("_tb").alias("_ub"), F.col("_lo").alias("_base"),
    ).distinct()
    inside = W.partitionBy(*keys, "_bucket").orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    hit = counts.join(
        wanted,
        [counts[k].eqNullSafe(wanted["_u_" + k]) for k in keys] + [counts["_bucket"] == wanted["_ub"]],
    ).select(
        *keys, "_bucket", "value",
        (F.sum("n").over(inside) + F.col("_base")).alias("_top"),
        (F.sum("n").over(inside) + F.col("_base") - F.col("n")).alias("_below"),
    )
    joined = targets.join(
        hit, [targets["_t_" + k].eqNullSafe(hit[k]) for k in keys] + [targets["_tb"] == hit["_bucket"]],
    )
    at = lambda r: F.max(F.when((F.col(r) > F.col("_below")) & (F.col(r) <= F.col("_top")), F.col("value")))
    found = joined.groupBy(*keys, "prob", "_frac").agg(at("_r1").alias("_a"), at("_r2").alias("_b"))
    return found.select(
        *keys, "prob", (F.col("_a") + F.col("_frac") * (F.col("_b") - F.col("_a"))).alias("quantile"),
    )


def _bucket_each(counts: DataFrame, cols: Sequence[str], n: int) -> DataFrame:
    """Bucket the values of every variable by that variable's own approximate quantiles."""
    if n == 1:
        return counts.withColumn("_bucket", F.lit(0.0))
    probs = [i / n for i in range(1, n)]
    found = counts.groupBy("variable").agg(F.percentile_approx("value", probs, min(10 * n, 100_000)).alias("q")).collect()
    bounds = {r["variable"]: sorted(set(r["q"] or [])) for r in found}
    cuts = [c for c in cols if bounds.get(c)]
    if not cuts:
        return counts.withColumn("_bucket", F.lit(0.0))
    # all variables in one pass: a variable's column holds nothing on the rows of the others
    own, out = [f"_v{i}" for i in range(len(cuts))], [f"_b{i}" for i in range(len(cuts))]
    cut = Bucketizer(splitsArray=[[-math.inf, *bounds[c], math.inf] for c in cuts], inputCols=own, outputCols=out, handleInvalid="keep")
    wide = cut.transform(counts.withColumns({v: F.when(F.col("variable") == c, F.col("value")) for c, v in zip(cuts, own)}))
    mine = F.coalesce(*[F.when(F.col("variable") == c, F.col(b)) for c, b in zip(cuts, out)], F.lit(0.0))
    return wide.select(*counts.columns, mine.alias("_bucket"))


def _rank_struct(p: float, kind: int) -> Column:
    """The one or two ranks a quantile needs, and the weight of the second."""
    n = F.col("_total").cast("double")
    if kind == 1:
        # the small step down keeps n*p exact when it is a whole number up to rounding noise
        rank = F.greatest(F.ceil(n * F.lit(p) - F.lit(1e-9)), F.lit(1)).cast("long")
        return F.struct(F.lit(p).alias("prob"), rank.alias("_r1"), rank.alias("_r2"), F.lit(0.0).alias("_frac"))
    if kind == 2:
        pos = n * F.lit(p)
        whole = (F.abs(pos - F.round(pos)) < F.lit(1e-9)) & (pos > F.lit(0.5))
        rank = F.greatest(F.ceil(pos - F.lit(1e-9)), F.lit(1)).cast("long")
        nxt = F.when(whole, F.least(rank + 1, F.col("_total"))).otherwise(rank).cast("long")
        return F.struct(F.lit(p).alias("prob"), rank.alias("_r1"), nxt.alias("_r2"), F.lit(0.5).alias("_frac"))
    if kind == 7:
        pos = (n - 1) * F.lit(p)
        low = F.floor(pos + F.lit(1e-9))
        frac = F.greatest(pos - low, F.lit(0.0))
        return F.struct(
            F.lit(p).alias("prob"), (low + 1).cast("long").alias("_r1"),
            F.least(low + 2, F.col("_total")).cast("long").alias("_r2"), frac.alias("_frac"),
        )
    raise ValueError("kind must be 1, 2 or 7")


def quantiles_wide(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = (),
                   kind: int = 1, **kw) -> DataFrame:
    """One row per (by..., variable) with columns ``p10``, ``p25`` ..."""
    return wide_quantiles(quantiles(df, cols, probs, by, kind, **kw), probs, by)


def wide_quantiles(long: DataFrame, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    return long.groupBy(*by, "variable").agg(*[
        F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(f"p{round(100 * p)}") for p in probs
    ])
