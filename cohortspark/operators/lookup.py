"""Event lookups around per-person anchor dates.

Dates have day resolution, so events are first summed up per person and day with a map-side
combine. A person who owns a large share of all events therefore reaches the join with at most one
row per calendar day, and every later step per person is bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

FAR = "9999-12-31"


@dataclass(frozen=True)
class Find:
    """One lookup: which events count, the window around the anchor, and what to return.

    ``returning`` is date, flag, count or value; ``on_or_after`` and ``on_or_before`` are Columns on
    the anchor row (inclusive); ``where`` and ``value`` are Columns on the event row.
    """

    name: str
    returning: str = "date"
    pick: str = "last"
    where: Column | None = None
    on_or_after: Column | None = None
    on_or_before: Column | None = None
    value: Column | None = None

    def window(self, day: Column) -> Column:
        tests = []
        if self.on_or_after is not None:
            tests.append(day >= self.on_or_after)
        if self.on_or_before is not None:
            tests.append(day <= self.on_or_before)
        return reduce(lambda a, b: a & b, tests) if tests else F.lit(True)


def daily_summary(events: DataFrame, finds: Sequence[Find], person: str, date: str) -> DataFrame:
    """(person, day) rows: per lookup the number of matching events and the largest known value."""
    aggs = []
    for i, f in enumerate(finds):
        match = F.lit(True) if f.where is None else F.coalesce(f.where, F.lit(False))
        aggs.append(F.count(F.when(match, F.lit(1))).alias(f"_n{i}"))
        if f.value is not None:
            aggs.append(F.max(F.when(match, f.value)).alias(f"_v{i}"))
    if all(f.where is not None for f in finds):
        events = events.where(reduce(lambda a, b: a | b, [f.where for f in finds]))
    return events.groupBy(F.col(person).alias("_person"), F.col(date).alias("_day")).agg(*aggs)


def _answers(finds: Sequence[Find]) -> list[Column]:
    day, out = F.col("_day"), []
    for i, f in enumerate(finds):
        hit = (F.col(f"_n{i}") > 0) & f.window(day)
        if f.returning == "date":
            agg = F.min if f.pick == "first" else F.max
            out.append(agg(F.when(hit, day)).alias(f.name))
        elif f.returning == "flag":
            out.append(F.coalesce(F.max(hit), F.lit(False)).alias(f.name))
        elif f.returning == "count":
            out.append(F.coalesce(F.sum(F.when(hit, F.col(f"_n{i}"))), F.lit(0)).alias(f.name))
        elif f.returning == "value":
            by = F.min_by if f.pick == "first" else F.max_by
            known = F.when(hit & F.col(f"_v{i}").isNotNull(), day)
            out.append(by(F.col(f"_v{i}"), known).alias(f.name))
        else:
            raise ValueError(f"cannot return {f.returning}")
    return out


def lookup(events: DataFrame, anchors: DataFrame, finds: Sequence[Find],
           person: str = "patient_id", date: str = "date") -> DataFrame:
    """Answer several lookups on one event table in one pass; one output row per anchor row.

    A person may have several anchors. Columns of the anchor may bound the windows.
    """
    daily = daily_summary(events, finds, person, date)
    near = reduce(lambda a, b: a | b, [f.window(F.col("_day")) for f in finds])
    return (
        anchors.join(daily, (anchors[person] == F.col("_person")) & near, "left")
        .groupBy(*[anchors[c] for c in anchors.columns]).agg(*_answers(finds))
    )


def lookup_fixed(events: DataFrame, finds: Sequence[Find], person: str = "patient_id", date: str = "date") -> DataFrame:
    """Lookups whose windows are literals: one aggregate with map-side combine, no join. Only persons
    with events appear."""
    day = F.col(date)
    steps = []
    for i, f in enumerate(finds):
        match = F.lit(True) if f.where is None else F.coalesce(f.where, F.lit(False))
        steps.append(F.when(match, F.lit(1)).otherwise(F.lit(0)).alias(f"_n{i}"))
        if f.value is not None:
            steps.append(F.when(match, f.value).alias(f"_v{i}"))
    return events.select(person, day.alias("_day"), *steps).groupBy(person).agg(*_answers(finds))


def nth_events(events: DataFrame, n: int, person: str = "patient_id", date: str = "date",
               carry: Sequence[str] = (), index: str = "k") -> DataFrame:
    """The first n event days of each person, numbered from 1.

    Stepping from one event to the first one at least a day later visits exactly the distinct days,
    so the chain is a row number over days. ``carry`` keeps further columns of the day's event; with
    several events on a day the largest values (in the listed order) are kept.
    """
    if carry:
        days = events.where(F.col(date).isNotNull()).groupBy(person, date).agg(F.max(F.struct(*carry)).alias("_c"))
        days = days.select(person, date, "_c.*")
    else:
        days = events.where(F.col(date).isNotNull()).select(person, date).distinct()
    w = W.partitionBy(person).orderBy(date)
    return days.withColumn(index, F.row_number().over(w)).where(F.col(index) <= n)


def on_or_after(events: DataFrame, anchors: DataFrame, bound: Column, person: str = "patient_id") -> DataFrame:
    """Keep the events of persons whose own anchor bound is not after the event date."""
    return events.join(anchors, person).where(bound)


def widen(long: DataFrame, n: int, columns: Sequence[str], person: str = "patient_id", index: str = "k",
          glue: str = "{name}_{k}_date") -> DataFrame:
    """Numbered columns from numbered rows."""
    return long.groupBy(person).agg(*[
        F.max(F.when(F.col(index) == k, F.col(c))).alias(glue.format(name=c, k=k))
        for c in columns for k in range(1, n + 1)
    ])


def most_frequent(events: DataFrame, code: str, person: str = "patient_id", name: str = "mode") -> DataFrame:
    """Most frequent code of each person; the smallest code wins a tie."""
    counts = events.where(F.col(code).isNotNull()).groupBy(person, code).agg(F.count(F.lit(1)).alias("_n"))
    best = counts.groupBy(person).agg(F.min(F.struct((-F.col("_n")).alias("m"), F.col(code).alias("c"))).alias("_b"))
    return best.select(person, F.col("_b.c").alias(name))


def exclude_days(events: DataFrame, other: DataFrame, person: str = "patient_id", date: str = "date") -> DataFrame:
    """Drop the events on days on which the person also has an event in ``other``."""
    return events.join(other.select(person, date).distinct(), [person, date], "left_anti")


def in_codelist(events: DataFrame, codes: DataFrame, code: str = "code") -> DataFrame:
    """Keep the events whose code is listed; Spark picks the join by the list's actual size."""
    return events.join(codes.select(F.col("code").alias(code)).distinct(), code, "left_semi")


def with_category(events: DataFrame, codes: DataFrame, code: str = "code") -> DataFrame:
    """Attach the category a categorised codelist gives each code (the largest, if listed twice)."""
    table = codes.groupBy(F.col("code").alias(code)).agg(F.max("category").alias("category"))
    return events.join(table, code)


def _longest_per_start(intervals: DataFrame, attrs: Sequence[str], person: str, start: str, end: str) -> DataFrame:
    """At most one interval per person and start day: the one that ends last covers all others."""
    reach = F.coalesce(F.col(end), F.lit(FAR).cast("date"))
    return (
        intervals.groupBy(F.col(person).alias("_person"), F.col(start).alias("_from"))
        .agg(F.max(F.struct(reach.alias("_to"), *attrs)).alias("_i"))
        .select("_person", "_from", "_i.*")
    )


def as_of(intervals: DataFrame, anchors: DataFrame, at: Column, attrs: Sequence[str], found: str | None = None,
          person: str = "patient_id", start: str = "start_date", end: str = "end_date") -> DataFrame:
    """Attributes of the interval covering a date; the latest start (then the latest end) wins."""
    best = _longest_per_start(intervals, attrs, person, start, end)
    cover = (anchors[person] == best["_person"]) & (best["_from"] <= at) & (best["_to"] >= at)
    out = (
        anchors.join(best, cover, "left")
        .groupBy(*[anchors[c] for c in anchors.columns])
        .agg(F.max(F.when(F.col("_from").isNotNull(), F.struct("_from", "_to", *attrs))).alias("_w"))
    )
    extra = [F.col("_w").isNotNull().alias(found)] if found else []
    return out.select(*anchors.columns, *[F.col(f"_w.{a}").alias(a) for a in attrs], *extra)


def registered_throughout(intervals: DataFrame, anchors: DataFrame, begin: Column, finish: Column, name: str,
                          person: str = "patient_id", start: str = "start_date", end: str = "end_date") -> DataFrame:
    """True when one single interval covers both dates."""
    best = _longest_per_start(intervals, [], person, start, end)
    cond = (anchors[person] == best["_person"]) & (best["_from"] <= begin) & (best["_to"] >= finish)
    return (
        anchors.join(best, cond, "left")
        .groupBy(*[anchors[c] for c in anchors.columns])
        .agg(F.max(F.col("_from").isNotNull()).alias(name))
    )


def day_of_age(age: Column, day: Column, least: int) -> Column:
    """The day, whole years before or after `day`, from which somebody of `age` years on `day` counts as `least` years old.

    The lower end of the window of a measurement that counts from a minimum age only. Null where age or day is null.
    """
    return F.add_months(day, (F.lit(least) - age).cast("int") * 12)


def age_on(born: Column, day: Column) -> Column:
    """Completed years of age; somebody born on 29 February completes a year on 1 March where the day is missing."""
    before_birthday = F.date_format(day, "MMdd") < F.date_format(born, "MMdd")
    return (F.year(day) - F.year(born) - before_birthday.cast("int")).cast("int")
