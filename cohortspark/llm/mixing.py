"""Mixing sources to target weights by capped water-filling.

Sources share the mixture in proportion to their weights, but no source is repeated more than `max_epochs` times:
sources above that are clamped and the excess is shared by the others in proportion to their weights, until none
is above. A source whose target is 2.4 times its size is taken twice as a whole and 0.4 times as a seeded sample.

The sample is a threshold, not a list: the documents of a source are ordered by a seeded hash, and the documents up to
a cut come once more. Running sums over 4096 hash ranges for each source, and inside a range over its documents, find
the cut exactly, so a source with a third of all rows is spread over 4096 keys. Applying the mixture needs no
shuffle of documents: the plan has one row for each source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cohortspark.llm.common import WORD_PATTERN, columns_of, whole_row
from cohortspark.session import stable

#: Weights of the sources in the order of their names, repeated as often as needed.
WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
#: The plan is computed on the driver and sent to all tasks: it has one row for each source.
MAX_SOURCES = 100_000


def water_fill(sizes: list[int], weights: list[float], total: float, max_epochs: float) -> list[float]:
    """Targets that share `total` by weight, none above max_epochs times its size.

    If all sources together can't give `total`, each gets its cap; weights of zero get nothing.
    """
    targets = [0.0] * len(sizes)
    caps = [max_epochs * float(s) for s in sizes]
    free = [i for i, w in enumerate(weights) if w > 0]
    left = float(total)
    while free:
        level = left / math.fsum(weights[i] for i in free)
        over = [i for i in free if level * weights[i] > caps[i]]
        if not over:
            for i in free:
                targets[i] = level * weights[i]
            break
        for i in over:
            targets[i] = caps[i]
        left -= math.fsum(caps[i] for i in over)
        free = [i for i in free if targets[i] != caps[i] or i not in set(over)]
    return targets


def draw(seed: int) -> Column:
    """The place of a document in its source's seeded order, from its id and its text: 32 hexadecimal digits."""
    text = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), text).cast("binary"))


def measured(docs: DataFrame, seed: int = 0) -> DataFrame:
    """source, `_size` (words of the text, null: 0), `_draw` and `_row`, the whole row."""
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    return docs.select(F.col("source").cast("string").alias("source"), size.alias("_size"), draw(seed).alias("_draw"), whole_row(docs))


def mixture_plan(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row for each source: its size, target, whole repetitions and the (_draw, _size) up to which one more is due.

    `sized`: source, _draw, _size; read three times.
    """
    spark = sized.sparkSession
    sizes = sized.groupBy("source").agg(F.sum("_size").alias("n")).orderBy(F.col("source").asc_nulls_last()).limit(
        MAX_SOURCES + 1).collect()
    if len(sizes) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    n = [r.n for r in sizes]
    targets = water_fill(n, weight, sum(n), max_epochs)
    rows = []
    for r, target in zip(sizes, targets):
        whole = min(int(target / r.n), max_epochs) if r.n else 0
        rows.append((r.source, r.n, float(target), whole, float(target) - whole * r.n))
    plan = F.broadcast(spark.createDataFrame(rows, "source string, source_size long, target double, whole int, _rest double"))
    part = F.substring("_draw", 1, 3)
    # rows of equal id and text are one unit of the order, whose rows are equally good
    units = sized.groupBy("source", "_draw", "_size").agg(F.count("*").alias("_m")).withColumn("_n", F.col("_m") * F.col("_size"))
    ranges = sized.groupBy("source", part.alias("_part")).agg(F.sum("_size").alias("_n"))
    before = ranges.select("source", "_part", (F.sum("_n").over(W.partitionBy("source").orderBy("_part")) - F.col("_n")).alias("_before"))
    inside = W.partitionBy("source", "_part").orderBy("_draw", "_size").rowsBetween(W.unboundedPreceding, W.currentRow)
    d = units.withColumn("_part", part).withColumn("_cum", F.sum("_n").over(inside) - F.col("_n"))
    d = d.alias("d").join(before.alias("b"), F.expr("d.source <=> b.source and d._part = b._part"))
    d = d.select("d.source", "_draw", "_size", "_m", (F.col("_before") + F.col("_cum")).alias("_cum"))
    d = d.alias("d").join(plan.alias("p"), F.expr("d.source <=> p.source"))
    # a document comes once more if that brings the sum nearer to the target than leaving it out
    due = d.where("2 * _cum + _size <= 2 * p._rest and p._rest > 0")
    fits = F.when(F.col("_size") == 0, F.col("_m")).otherwise(F.least(
        F.col("_m"), F.floor((2 * F.col("p._rest") - 2 * F.col("_cum") - F.col("_size")) / (2 * F.col("_size"))) + 1)).cast("long")
    last = F.max(F.struct("_draw", "_size", fits.alias("fits"), F.col("_m").alias("m")))
    cuts = due.groupBy("d.source").agg(last.alias("cut"))
    return plan.alias("p").join(cuts.alias("c"), F.expr("p.source <=> c.source"), "left").select(
        "p.source", "source_size", "target", "whole", "cut")


def numbered(rows: DataFrame, by: str) -> DataFrame:
    """`rows` with `_number`, counted from 1 for each value of `by` (null-safe), with no value in one task.

    Rows are counted by stored partition, so a task sorts at most one partition's rows.
    """
    rows = stable(rows.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    counts = rows.groupBy(by, "_part").agg(F.count("*").alias("_n"))
    before = counts.select(
        F.col(by).alias("_by"), F.col("_part").alias("_of"),
        (F.sum("_n").over(W.partitionBy(by).orderBy("_part")) - F.col("_n")).alias("_before"))
    here = F.row_number().over(W.partitionBy(by, "_part").orderBy("_at"))
    return rows.withColumn("_here", here).join(before, F.expr(f"`{by}` <=> _by and _part = _of")).withColumn(
        "_number", F.col("_before") + F.col("_here")).drop("_part", "_at", "_by", "_of", "_before", "_here")


def with_repeats(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """`sized` with source_size, target and `_repeats`: how often the mixture takes each document."""
    plan = stable(plan)
    split = plan.where("cut.fits < cut.m").limit(1).count() > 0
    plan = F.broadcast(plan.withColumnRenamed("source", "_source"))  # at most MAX_SOURCES rows
    rows = sized.join(plan, F.expr("source <=> _source"))
    here, last = F.struct("_draw", "_size"), F.struct("cut._draw", "cut._size")
    more = F.coalesce(here <= last, F.lit(False))
    if not split:
        return rows.withColumn("_repeats", F.col("whole") + more.cast("int")).drop("_source", "cut")
    # of the rows at the cut only the first `fits` come once more
    at_cut = F.coalesce((here == last) & F.expr("cut.fits < cut.m"), F.lit(False))
    first = numbered(rows.where(at_cut), "source")
    return rows.where(~at_cut).withColumn("_repeats", F.col("whole") + more.cast("int")).drop("_source", "cut").unionByName(
        first.withColumn("_repeats", F.col("whole") + (F.col("_number") <= F.col("cut.fits")).cast("int")).drop(
            "_source", "cut", "_number"))


def mixture(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 0) -> DataFrame:
    """(doc_id, size, source_size, target, taken): how many words of each document the mixture takes.

    Sources in code point order, null last, get `weights` in turn and share 100 % of all sizes; a target is at most
    max_epochs times its source's size. A document is taken whole or not at all in each repetition, so a source's
    sum is within half a document of its target.

    One row for each input row. Null or empty text: size 0, taken 0. The place in the order comes from id and text, so rows
    with a null or repeated doc_id are drawn one by one by their texts. Of rows with equal id, source and text the mixture may
    take some once more and others not; which ones is open, their number is not. An empty table gives no rows.
    Other columns are not read.
    """
    own = docs.select("doc_id", "text", F.col("source").cast("string").alias("source"))
    sized = stable(measured(own, seed).select("source", "_size", "_draw", F.col("_row.doc_id").alias("doc_id")))
    return with_repeats(sized, mixture_plan(sized, weights, max_epochs)).select(
        "doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * F.col("_repeats")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 0) -> DataFrame:
    """The documents of the mixture, each as often as it is taken, with their own columns.

    The documents are those that `mixture` takes, so a document without words comes `whole` times, and once more if its
    place in the order is below the cut. Null and repeated ids, ties and empty tables are treated as there. Other columns may
    have any names and types.
    """
    sized = measured(docs, seed)
    plan = mixture_plan(stable(sized.drop("_row")), weights, max_epochs)
    taken = with_repeats(sized, plan).where("_repeats > 0")
    copies = taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("_repeats"))))
    return columns_of(copies, docs)
