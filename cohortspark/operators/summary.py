"""Summary tables: numeric, date, categorical, two-way, whole-table skim, baseline table, checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cohortspark.functions.columns import ratio
from cohortspark.functions.disclosure import redact, redaction_flag, roundmid_any
from cohortspark.operators.ranking import quantiles_of_counts, quantiles_wide, value_counts_long, wide_quantiles
from cohortspark.session import stable

MISSING = "(missing)"
PROBS = (0.1, 0.25, 0.5, 0.75, 0.9)
NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def stack_text(df: DataFrame, cols: Sequence[str], ids: Sequence[str | Column] = ()) -> DataFrame:
    """(ids..., variable, level) with every level as text and flags as yes/no."""
    kinds = dict(df.dtypes)

    def text(c: str) -> Column:
        x = F.col(c)
        return F.when(x, "yes").when(~x, "no") if kinds[c] == "boolean" else x.cast("string")

    pairs = F.array(*[F.struct(F.lit(c).alias("variable"), text(c).alias("level")) for c in cols])
    stacked = df.select(*ids, F.explode(pairs).alias("_s"))
    return stacked.select(*stacked.columns[:-1], "_s.*")


def numeric_summary(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), threshold: int = 0,
                    probs: Sequence[float] = PROBS, **kw) -> DataFrame:
    """One row per (by..., variable): counts, missingness, moments, type-1 quantiles and range.

    All variables are summarised from one count of their values; a grouping value that is missing has its own row.
    Rows standing for 1..threshold people are blanked.
    """
    for b in by:
        df = df.withColumn(b, F.coalesce(F.col(b).cast("string"), F.lit(MISSING)))
    keys = [*by, "variable"]
    # how often each value occurs, written once: everything is read from these counts
    counts = stable(value_counts_long(df, by, cols, known=False))
    weight, x = F.col("n"), F.col("value")
    base = counts.groupBy(*keys).agg(
        F.sum(weight).alias("n"), F.coalesce(F.sum(F.when(x.isNotNull(), weight)), F.lit(0)).alias("n_nonmiss"),
        F.count(x).alias("unique"), F.try_divide(F.sum(x * weight), F.sum(F.when(x.isNotNull(), weight))).alias("mean"),
        F.min(x).alias("min"), F.max(x).alias("max"))
    # at most one row for each group and variable
    centre = base.select(*[F.col(k).alias(f"_c_{k}") for k in keys], F.col("mean").alias("_mean"), F.col("n_nonmiss").alias("_known"))
    same = [F.col(k) == F.col(f"_c_{k}") for k in keys]
    off = counts.join(F.broadcast(centre), same).groupBy(*keys).agg(
        F.sqrt(F.try_divide(F.sum(weight * (x - F.col("_mean")) * (x - F.col("_mean"))), F.max("_known") - 1)).alias("sd"))
    base = base.join(off, keys, "left").select(
        *keys, "n", "n_nonmiss", "unique", "mean", "sd", "min", "max").withColumns({
        "pct_nonmiss": ratio(F.col("n_nonmiss"), F.col("n")),
        "n_miss": F.col("n") - F.col("n_nonmiss"),
        "pct_miss": ratio(F.col("n") - F.col("n_nonmiss"), F.col("n")),
    })
    found = quantiles_of_counts(counts.where(x.isNotNull() & ~F.isnan(x)), cols, probs, by, 1, **kw)
    out = base.join(wide_quantiles(found, probs, by), keys, "left")
    if threshold:
        out = redaction_flag(out, "n", threshold, ["variable"], list(by))
        out = redact(out, [c for c in out.columns if c not in (*by, "variable", "redacted")])
    return out


def date_summary(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), threshold: int = 0, **kw) -> DataFrame:
    """The numeric summary of dates; mean, range and quantiles come back as dates."""
    days = df.select(*by, *[F.unix_date(c).alias(c) for c in cols])
    out = numeric_summary(days, cols, by, threshold, **kw)
    back = [c for c in out.columns if c in ("mean", "min", "max") or (c[0] == "p" and c[1:].isdigit())]
    return out.withColumns({c: F.date_from_unix_date(F.floor(c).cast("int")) for c in back})


def cat_counts(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., variable, level, n) with missing values as a level."""
    long = stack_text(df, cols, by)
    return long.groupBy(*by, "variable", F.coalesce("level", F.lit(MISSING)).alias("level")).agg(
        F.count(F.lit(1)).alias("n"))


def cat_summary(df: DataFrame, cols: Sequence[str], levels: dict[str, Sequence[str]] | None = None,
                threshold: int = 5, accuracy: int = 1) -> DataFrame:
    """Count, share and share of the non-missing per level, small counts suppressed.

    ``levels`` keeps levels that do not occur, with a count of zero.
    """
    counts = cat_counts(df, cols)
    if levels:
        rows = [(v, lv) for v, lvs in levels.items() for lv in lvs]
        full = df.sparkSession.createDataFrame(rows, "variable string, level string")
        counts = counts.join(full, ["variable", "level"], "full").fillna(0, ["n"])
    w = W.partitionBy("variable")
    known = F.when(F.col("level") != MISSING, F.col("n")).otherwise(F.lit(0))
    out = counts.withColumn("n", (F.bround(F.col("n") / accuracy) * accuracy).cast("long")).withColumns({
        "pct": ratio(F.col("n"), F.sum("n").over(w)), "pct_nonmiss": ratio(known, F.sum(known).over(w))})
    out = redaction_flag(out, "n", threshold, ["variable"], ["level"])
    return redact(out, ["n", "pct", "pct_nonmiss"])


def catcat_summary(df: DataFrame, var1: str, var2: str, threshold: int = 5, accuracy: int = 1,
                   total: str | None = None) -> DataFrame:
    """Two-way counts with shares within the second variable, suppressed row-wise and column-wise."""
    long = stack_text(df, [var1], [F.coalesce(F.col(var2).cast("string"), F.lit(MISSING)).alias("level2")])
    counts = long.groupBy("level2", F.coalesce("level", F.lit(MISSING)).alias("level1")).agg(
        F.count(F.lit(1)).alias("n"))
    # every combination of the levels that occur, so that empty cells count as zero
    levels = counts.agg(F.collect_set("level1").alias("_a"), F.collect_set("level2").alias("_b"))
    grid = levels.select(F.explode("_a").alias("level1"), "_b").select("level1", F.explode("_b").alias("level2"))
    counts = grid.join(counts, ["level1", "level2"], "left").fillna(0, ["n"])
    w = W.partitionBy("level2")
    known = F.when(F.col("level1") != MISSING, F.col("n")).otherwise(F.lit(0))
    out = counts.withColumn("pct", ratio(F.col("n"), F.sum("n").over(w)))
    out = out.withColumn("n", (F.bround(F.col("n") / accuracy) * accuracy).cast("long"))
    out = out.withColumn("pct_nonmiss", ratio(known, F.sum(known).over(w)))
    out = redaction_flag(out, "n", threshold, ["level1"], ["level2"], "_r1")
    out = redaction_flag(out, "n", threshold, ["level2"], ["level1"], "_r2")
    out = out.withColumn("redacted", F.col("_r1") | F.col("_r2")).drop("_r1", "_r2")
    out = redact(out, ["n", "pct", "pct_nonmiss"])
    if total is not None:
        one = cat_summary(df, [var1], threshold=threshold).select(
            F.col("level").alias("level1"), F.lit(total).alias("level2"), "n", "pct", "pct_nonmiss", "redacted")
        out = out.unionByName(one)
    return out


def skim(df: DataFrame, id_suffix: str = "_id", **kw) -> DataFrame:
    """One row per column: completeness and the statistics that fit its type. Id columns are left out."""
    kinds = {c: t for c, t in df.dtypes if not c.endswith(id_suffix)}
    numeric = [c for c, t in kinds.items() if t in NUMERIC or t.startswith("decimal")]
    dates = [c for c, t in kinds.items() if t == "date"]
    texts = [c for c, t in kinds.items() if t in ("string", "boolean")]
    parts = []
    if numeric:
        s = numeric_summary(df, numeric, **kw)
        parts.append(s.select(
            "variable", F.lit("numeric").alias("type"), "n_miss", F.col("pct_nonmiss").alias("complete_rate"),
            F.col("unique").alias("n_unique"), "mean", "sd", "min", "p10", "p25", "p50", "p75", "p90", "max"))
    if dates:
        s = date_summary(df, dates, **kw)
        parts.append(s.select(
            "variable", F.lit("date").alias("type"), "n_miss", F.col("pct_nonmiss").alias("complete_rate"),
            F.col("unique").alias("n_unique"), F.col("min").alias("date_min"), F.col("p50").alias("date_p50"),
            F.col("max").alias("date_max")))
    if texts:
        s = stack_text(df, texts).groupBy("variable").agg(
            (F.count(F.lit(1)) - F.count("level")).alias("n_miss"),
            ratio(F.count("level"), F.count(F.lit(1))).alias("complete_rate"),
            F.count_distinct("level").alias("n_unique"),
            ratio(F.count(F.when(F.col("level") == "yes", F.lit(1))), F.count("level")).alias("mean"))
        flags = [c for c in texts if kinds[c] == "boolean"]
        is_flag = F.col("variable").isin(flags)
        parts.append(s.select(
            "variable", F.when(is_flag, "logical").otherwise("text").alias("type"), "n_miss", "complete_rate",
            "n_unique", F.when(is_flag, F.col("mean")).alias("mean")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def level_counts(df: DataFrame, cols: Sequence[str], top: int = 10, threshold: int = 6) -> DataFrame:
    """Rounded counts and percentages of the first levels of each categorical column.

    A text column may have very many levels: totals come from an aggregate and the rank filter cuts each
    task's levels before the shuffle, so no task sees all levels of a column.
    """
    counts = stack_text(df, cols).groupBy("variable", "level").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("n", roundmid_any(F.col("n"), threshold).cast("long"))
    totals = counts.groupBy("variable").agg(F.sum("n").alias("_total"), F.count(F.lit(1)).alias("n_levels"))
    place = W.partitionBy("variable").orderBy(F.col("level").asc_nulls_last())
    first = counts.withColumn("place", F.row_number().over(place)).where(F.col("place") <= top)
    out = first.join(totals, "variable")
    return out.withColumn("percent", F.round(100 * ratio(F.col("n"), F.col("_total")), 2)).drop("_total")


def baseline_table(df: DataFrame, by: str, categorical: Sequence[str], continuous: Sequence[str] = (),
                   threshold: int = 1, kind: int = 2, **kw) -> DataFrame:
    """Table 1 in long form: per arm, variable and level the rounded count, the base and the share
    recomputed from them, missingness, and median and quartiles of continuous variables."""
    r = lambda c: roundmid_any(F.col(c), threshold).cast("long")
    long = stack_text(df, categorical, [F.col(by).cast("string").alias("arm")])
    counts = long.groupBy("arm", "variable", "level").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("arm", "variable")
    counts = counts.withColumns({
        "n_obs": F.sum("n").over(w),
        "n_miss": F.coalesce(F.sum(F.when(F.col("level").isNull(), F.col("n"))).over(w), F.lit(0)),
    }).withColumn("n_nonmiss", F.col("n_obs") - F.col("n_miss"))
    cats = counts.where(F.col("level").isNotNull()).select(
        "arm", "variable", "level", "n", F.col("n_nonmiss").alias("n_base"), "n_miss", "n_obs", "n_nonmiss")
    if continuous:
        pairs = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("x")) for c in continuous])
        num = df.select(F.col(by).cast("string").alias("arm"), F.explode(pairs).alias("_s")).select("arm", "_s.*")
        base = num.groupBy("arm", "variable").agg(
            F.count(F.lit(1)).alias("n_obs"), F.count("x").alias("n_nonmiss")).withColumn(
            "n_miss", F.col("n_obs") - F.col("n_nonmiss")).withColumn("n_base", F.col("n_nonmiss"))
        q = quantiles_wide(df.withColumn("arm", F.col(by).cast("string")), continuous, [0.25, 0.5, 0.75], ["arm"], kind, **kw)
        nums = base.join(q, ["arm", "variable"], "left").withColumnRenamed("p50", "median").withColumn("level", F.lit(""))
        cats = cats.unionByName(nums, allowMissingColumns=True)
    else:
        cats = cats.withColumns({c: F.lit(None).cast("double") for c in ("median", "p25", "p75")})
    out = cats.withColumns({c: r(c) for c in ("n", "n_base", "n_miss", "n_obs", "n_nonmiss")})
    return out.withColumns({
        "p": ratio(F.col("n"), F.col("n_base")), "p_miss": ratio(F.col("n_miss"), F.col("n_obs")),
        "p_nonmiss": ratio(F.col("n_nonmiss"), F.col("n_obs"))})


def separation_table(df: DataFrame, event: str, cols: Sequence[str]) -> DataFrame:
    """Counts and shares of every covariate level among rows without and with the event."""
    counts = cat_counts(df, cols, [event])
    share = ratio(F.col("n"), F.sum("n").over(W.partitionBy(event, "variable")))
    counts = counts.withColumn("pct", share)
    pick = lambda v, e: F.max(F.when(F.col(event) == e, F.col(v)))
    return counts.groupBy("variable", "level").agg(
        pick("n", 0).alias("event0_n"), pick("pct", 0).alias("event0_pct"),
        pick("n", 1).alias("event1_n"), pick("pct", 1).alias("event1_pct"))


def incidence_summary(df: DataFrame, events: Sequence[str], person: str = "patient_id", by: Sequence[str] = ()) -> DataFrame:
    """Rows, people, events, events per person and events per row."""
    out = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("obs"), F.count_distinct(person).alias("patients"),
        *[F.sum(F.col(e).cast("long")).alias(e) for e in events])
    return out.withColumns({
        **{f"rate_{e}": ratio(F.col(e), F.col("patients")) for e in events},
        **{f"incidencerate_{e}": ratio(F.col(e), F.col("obs")) for e in events}})


def cross_counts(df: DataFrame, row: str, col: str, values: Sequence[object]) -> DataFrame:
    """Two-way frequency table with one column per listed value."""
    return df.groupBy(row).agg(*[
        F.count(F.when(F.col(col) == v, F.lit(1))).alias(f"{col}_{v}") for v in values])


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def any_missing(df: DataFrame) -> DataFrame:
    """Per column, whether any value is missing."""
    row = df.agg(*[F.coalesce(F.max(F.col(c).isNull()), F.lit(False)).alias(c) for c in df.columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).alias("has_missing")) for c in df.columns])
    return row.select(F.explode(pairs).alias("_s")).select("_s.*")


def weighted_mean(x: Column, w: Column) -> Column:
    """Aggregate: mean of x with weights w over the rows where x is known."""
    return F.try_divide(F.sum(x * w), F.sum(F.when(x.isNotNull(), w)))


def histogram(df: DataFrame, x: Column, lo: float, hi: float, bins: int) -> DataFrame:
    """Counts of equal-width bins; values outside fall in bin 0 and bin ``bins`` + 1."""
    return df.groupBy(F.width_bucket(x, F.lit(lo), F.lit(hi), F.lit(bins)).alias("bin")).agg(
        F.count(F.lit(1)).alias("n")).where(F.col("bin").isNotNull())


def redact_baseline(table: DataFrame, threshold: int = 5) -> DataFrame:
    """Suppress small cells of a baseline table within each arm and variable, its missing count
    standing in as one more cell; the shares of suppressed cells go too."""
    cells = table.where(F.col("n").isNotNull()).select("arm", "variable", "level", F.col("n").alias("_n"))
    lost = table.where(F.col("n").isNotNull()).groupBy("arm", "variable").agg(F.max("n_miss").alias("_n"))
    cells = cells.unionByName(lost.withColumn("level", F.lit(None).cast("string")))
    flags = redaction_flag(cells, "_n", threshold, ["arm", "variable"], ["level"])
    hide = flags.where(F.col("level").isNotNull()).select("arm", "variable", "level", "redacted")
    hide_miss = flags.where(F.col("level").isNull()).select("arm", "variable", F.col("redacted").alias("redacted_miss"))
    out = table.join(hide, ["arm", "variable", "level"], "left").join(hide_miss, ["arm", "variable"], "left")
    out = out.fillna(False, ["redacted", "redacted_miss"])
    return redact(redact(out, ["n", "p"]), ["n_miss", "p_miss", "n_nonmiss", "p_nonmiss", "n_base"], "redacted_miss")
