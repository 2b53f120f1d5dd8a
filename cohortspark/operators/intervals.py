"""Time-to-event tables, counting-process intervals and person-days.

Time is whole days from the person's origin; intervals are open on the left, closed on the right.
Change points live in a bounded array on the person's row, so building intervals and person-days is
a narrow explode: only bringing repeated status changes to the person needs a shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cohortspark.functions.columns import cut_band, satisfied


def status_changes(changes: DataFrame, time: str, value: str, order: Sequence[str], last: str,
                   name: str, person: str = "patient_id") -> DataFrame:
    """Collect repeated status changes as one sorted array of (t, v) per person.

    Changes after the person's last day are ignored. Several changes at one time collapse to the
    last in ``order`` before the collect, so an array holds at most one entry per day.
    """
    per_day = (
        changes.where(F.col(time).isNotNull() & (F.col(time) <= F.col(last)))
        .groupBy(person, F.col(time).alias("t"))
        .agg(F.max_by(F.col(value), F.struct(*order)).alias("v"))
    )
    return per_day.groupBy(person).agg(F.array_sort(F.collect_list(F.struct("t", "v"))).alias(name))


def to_intervals(base: DataFrame, stop: str, steps: Mapping[str, str] | None = None,
                 events: Mapping[str, str] | None = None, changes: Sequence[str] = (),
                 keep: Sequence[str] = ()) -> DataFrame:
    """Split each person's time (0, stop] at every change.

    ``steps``: status name -> column with the time the status becomes 1 for good.
    ``events``: event name -> column with the event time; 1 only on the interval ending there.
    ``changes``: array columns of (t, v) made by ``status_changes``; each gives a status of the same
    name without its ending ``_changes``, starting from 0.
    Times at or before 0 hold from the start; times after ``stop`` are ignored.
    """
    steps, events = dict(steps or {}), dict(events or {})
    points = [F.array(*[F.col(c).cast("int") for c in {*steps.values(), *events.values()}])]
    empty = F.array().cast("array<int>")
    points += [F.coalesce(F.transform(c, lambda x: x["t"].cast("int")), empty) for c in changes]
    end = F.col(stop).cast("int")
    inner = F.filter(F.flatten(F.array(*points)), lambda t: (t > 0) & (t < end))
    edges = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0)), inner, F.array(end))))
    spans = F.transform(
        F.sequence(F.lit(1), F.size("_edges") - 1),
        lambda i: F.struct(F.element_at("_edges", i.cast("int")).alias("tstart"),
                           F.element_at("_edges", (i + 1).cast("int")).alias("tstop")),
    )
    out = base.where(end > 0).withColumn("_edges", edges).withColumn("_i", F.explode(spans))
    start, finish = F.col("_i.tstart"), F.col("_i.tstop")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return out.select(
        *[F.col(c) for c in keep], start.alias("tstart"), finish.alias("tstop"),
        *[flag(F.col(c) <= start).alias(n) for n, c in steps.items()],
        *[_value_at(c, start).alias(c.removesuffix("_changes")) for c in changes],
        *[flag(F.col(c) == finish).alias(n) for n, c in events.items()],
    )


def _value_at(changes: str, at: Column) -> Column:
    """Value of the last change not later than a time; 0 before the first."""
    past = F.filter(F.col(changes), lambda x: x["t"] <= at)
    return F.coalesce(F.try_element_at(past, F.lit(-1))["v"].cast("int"), F.lit(0))


def event_times(changes: str, value: int, stop: str) -> Column:
    """Times within (0, stop] at which the status changed to a value."""
    return F.transform(
        F.filter(F.col(changes), lambda x: (x["v"] == value) & (x["t"] > 0) & (x["t"] <= F.col(stop))), lambda x: x["t"])


def mask(df: DataFrame, status: str, requires: str) -> DataFrame:
    """A dependent status can only be 1 while the status it requires is 1."""
    return df.withColumn(status, F.when(F.col(requires) == 0, F.lit(0)).otherwise(F.col(status)))


def person_days(intervals: DataFrame, events: Sequence[str] = ()) -> DataFrame:
    """One row per day; statuses repeat, event flags stay on the last day of their interval only."""
    days = intervals.withColumn("_day", F.explode(F.sequence(F.col("tstart") + 1, F.col("tstop"))))
    last = F.col("_day") == F.col("tstop")
    flags = {e: F.when(last, F.col(e)).otherwise(F.lit(0)) for e in events}
    days = days.withColumns(flags) if flags else days
    return days.withColumns({"tstart": F.col("_day") - 1, "tstop": F.col("_day")}).drop("_day")


def days_since(onset: Column, day: Column) -> Column:
    """Number of days up to ``day`` on which a status that began at ``onset`` has held."""
    held = F.greatest(day - F.greatest(onset, F.lit(0)), F.lit(0))
    return F.when(onset.isNotNull(), held).otherwise(F.lit(0)).cast("int")


def last_time_before(times: Column, day: Column) -> Column:
    """Latest of an array of times that is not after the day."""
    return F.array_max(F.filter(times, lambda t: t <= day))


def time_since_discharge(status: Column, discharge: Column, day: Column) -> Column:
    """In hospital, days since discharge in bands up to 28, otherwise not in hospital."""
    band = cut_band(day - discharge, [0, 21, 28], ["1-21", "22-28"], right=True)
    return (
        F.when(band.isNull() & (status == 0), F.lit("Not in hospital"))
        .when(status == 1, F.lit("In hospital")).otherwise(band)
    )


def split_follow_up(df: DataFrame, time: str, event: str, cuts: Sequence[int]) -> DataFrame:
    """Cut follow-up at fixed days: one row per period entered; the event stays on the last piece."""
    pieces = F.array(*[
        F.struct(F.lit(i + 1).alias("period_id"), F.lit(a).alias("period_start"), F.lit(b).alias("period_end"))
        for i, (a, b) in enumerate(zip(cuts, cuts[1:]))
    ])
    entered = F.filter(pieces, lambda p: p["period_start"] < F.col(time))
    out = df.withColumn("_p", F.explode(entered)).select(*df.columns, "_p.*")
    return out.withColumns({
        "tstart": F.col("period_start"),
        "tstop": F.least(F.col(time), F.col("period_end")).cast("int"),
        event: (F.col(event).cast("boolean") & (F.col(time) <= F.col("period_end"))).cast("int"),
    })


def follow_up(df: DataFrame, outcome: str, end, max_followup: int, origin: str = "trial_date",
              dose2: str = "dose2_date", stops: Sequence[str] = ("death_date", "dereg_date"),
              control_treated: str = "controlistreated_date") -> DataFrame:
    """Follow-up of matched people: censoring dates, time to event or censoring, and event flag.

    Treatment happens at the start of a day and outcomes on that day count as day 1, so the origin is
    the day before; a second dose and the control's own treatment censor at the end of the day before.
    """
    o = F.col(origin)
    censor = F.least(
        *[F.col(s) for s in stops], F.date_sub(F.col(dose2), 1), F.lit(end), F.date_add(o, max_followup - 1))
    out = df.withColumn("censor_date", censor)
    pair_end = F.least(F.col("censor_date"), F.date_sub(F.col(control_treated), 1))
    out = out.withColumn("matchcensor_date", pair_end)
    event = F.col(outcome)
    return out.withColumns({
        "tte_outcome": F.least(F.datediff(event, F.date_sub(o, 1)), F.datediff("matchcensor_date", F.date_sub(o, 1))),
        "ind_outcome": satisfied(event.isNotNull() & (event <= F.col("matchcensor_date"))),
    })


def spells_long(wide: DataFrame, n: int, start: str = "admitted_{i}_date", stop: str = "discharged_{i}_date",
                person: str = "patient_id") -> DataFrame:
    """Numbered start/stop columns to one row per spell; empty numbers are dropped."""
    rows = F.array(*[
        F.struct(F.lit(i).alias("spell"), F.col(start.format(i=i)).alias("admitted_date"),
                 F.col(stop.format(i=i)).alias("discharged_date")) for i in range(1, n + 1)
    ])
    return wide.select(person, F.explode(rows).alias("_s")).select(person, "_s.*").where(
        F.col("admitted_date").isNotNull() | F.col("discharged_date").isNotNull())


def without_spells(spells: DataFrame, other: DataFrame, person: str = "patient_id") -> DataFrame:
    """Spells that are not in ``other``; two missing discharge dates count as equal."""
    keys = [person, "admitted_date", "discharged_date"]
    o = other.select(*[F.col(k).alias("_o_" + k) for k in keys]).distinct()
    return spells.join(o, [spells[k].eqNullSafe(o["_o_" + k]) for k in keys], "left_anti")


def check(df: DataFrame, violation: Column, message: str) -> DataFrame:
    """Raise when any row violates an invariant; otherwise hand the table on."""
    if not df.where(violation).isEmpty():
        raise ValueError(message)
    return df
