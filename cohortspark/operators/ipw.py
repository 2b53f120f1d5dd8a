"""Stabilised inverse-probability weights on person-days.

Both probability models become expressions on the person-day row, so weights are added in place; only the
splines' part, one row for each day and region, is broadcast to them. Only the cumulative product needs the rows of a person together.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from cohortspark.operators import sampling
from cohortspark.operators.design import columns_of
from cohortspark.operators.logistic import LogisticFit, fit_logistic, robust_logistic
from cohortspark.operators.summary import numeric_summary
from cohortspark.operators.windows import running
from cohortspark.session import stable

#: Combinations of the splines' columns up to which their part of a predictor is looked up.
CURVE_ROWS = 50_000


def draw_sample(days: DataFrame, event: str, kind: str, amount: float, person: str = "patient_id") -> DataFrame:
    """(person, sample_weight) of the sampled people. ``kind``: random_n, random_prop, nonoutcomes_n,
    nonoutcomes_prop. The person-days are read once; the search for the cut-off id runs on people."""
    people = stable(days.groupBy(person).agg((F.max(event) > 0).alias("had_event")))
    draw = {
        "random_n": lambda: sampling.sample_random_n(people, int(amount), person),
        "random_prop": lambda: sampling.sample_random_prop(people, amount, person),
        "nonoutcomes_n": lambda: sampling.sample_nonoutcomes_n(people, int(amount), "had_event", person),
        "nonoutcomes_prop": lambda: sampling.sample_nonoutcomes_prop(people, amount, "had_event", person),
    }
    out = draw[kind]()
    if kind.startswith("nonoutcomes"):
        out = sampling.sample_weights(out, "had_event")
    else:
        out = out.withColumn("sample_weight", F.col("sampled").cast("double"))
    return out.where("sampled").select(person, "sample_weight")


def treatment_models(days: DataFrame, event: str, at_risk: str, varying: Sequence[object], fixed: Sequence[object],
                     kind: str, amount: float | None, person: str = "patient_id", robust: bool = False,
                     kinds: DataFrame | None = None, rows: str | None = None) -> tuple[LogisticFit, LogisticFit]:
    """Models of the event with and without time-varying covariates, on those at risk; ``amount``: of a sample, None for all.

    Sampled rows are written once. ``robust``: the first model carries its person-clustered
    variance, from the rows that it was fitted on. ``kinds``: the days counted by all columns that the models read, with
    their number in ``rows`` (:func:`logistic.counted`); models of everybody are then fitted without another pass over the days.
    """
    risk = days.where(F.col(at_risk))
    if amount is None and kinds is not None:
        kinds = kinds.where(F.col(at_risk))
        first = fit_logistic(kinds, varying, event, rows=rows)
        if robust:
            first = robust_logistic(risk, first, event, person, kinds=kinds, rows=rows)
        return first, fit_logistic(kinds, fixed, event, rows=rows)
    if amount is None:
        sample = risk.withColumn("sample_weight", F.lit(1.0))
    else:
        sample = risk.join(draw_sample(risk, event, kind, amount, person), person)
        needed = {c for t in (*varying, *fixed) for c in columns_of(t)}
        sample = stable(sample.select(person, event, "sample_weight", *sorted(needed - {person})))
    first = fit_logistic(sample, varying, event, "sample_weight")
    if robust:
        first = robust_logistic(sample, first, event, person, "sample_weight")
    return first, fit_logistic(sample, fixed, event, "sample_weight")


def realised(probability: Column, event: str) -> Column:
    """Probability of the status that was observed: p if the event happened, 1 - p if not."""
    y = F.col(event).cast("double")
    return (1 - y) + (2 * y - 1) * probability


def with_stabilised_weight(days: DataFrame, models: tuple[LogisticFit, LogisticFit], event: str, at_risk: str,
                           name: str) -> DataFrame:
    """Add the fixed-covariate over time-varying probability of the observed status; 1 when not at risk."""
    return with_stabilised_weights(days, {name: (models, event, at_risk)})


def with_stabilised_weights(days: DataFrame, weights: Mapping[str, tuple[tuple[LogisticFit, LogisticFit], str, str]],
                            kinds: DataFrame | None = None) -> DataFrame:
    """:func:`with_stabilised_weight` for several (models, event, at risk) by name, with one lookup of all their curves.

    ``kinds``: rows that hold every combination of the splines' columns, if there are fewer of them than days.
    """
    fits = [m for pair, _, _ in weights.values() for m in pair]
    ready, p = with_curves(days, fits, kinds=kinds)
    new = {}
    for i, (name, (_, event, at_risk)) in enumerate(weights.items()):
        ratio = realised(p[2 * i + 1], event) / realised(p[2 * i], event)
        new[name] = F.when(F.col(at_risk), ratio).otherwise(F.lit(1.0))
    return ready.withColumns(new).select(*days.columns, *new)


def with_curves(days: DataFrame, models: Sequence[LogisticFit], most: int = CURVE_ROWS,
                kinds: DataFrame | None = None) -> tuple[DataFrame, list[Column]]:
    """Rows from which the models' probabilities can be read, and these probabilities.

    Splines and their products with factors are the long part of a predictor, and they depend on few columns (day and
    region): up to ``most`` combinations, they are computed once for each, with all other terms of these columns, and looked up.
    Otherwise they are expressions. What is left on the row has to stay short: the JVM doesn't compile a method of over 8000
    bytes, and interpreting it takes ten times as long. ``kinds``: rows that hold every combination, else the days are read for them.
    """
    columns = sorted({c for m in models for t in m.design.curved() for c in columns_of(t)})
    kinds = stable((days if kinds is None else kinds).select(*columns).distinct()) if columns else None
    if kinds is None or kinds.count() > most:
        for m in models:
            days = m.prepare(days)
        return days, [m.probability() for m in models]
    parts = [m.design.parted(columns) for m in models]
    for i, (m, (inside, _)) in enumerate(zip(models, parts)):
        kinds = m.prepare(kinds).withColumn(f"_curve{i}", m.design.linear(m.coef[1:], inside))
    looked = kinds.select(*[F.col(c).alias(f"_at_{c}") for c in columns], *[f"_curve{i}" for i in range(len(models))])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_at_{c}")) for c in columns])
    return days.join(F.broadcast(looked), same), [
        m.probability(F.col(f"_curve{i}"), rest) for i, (m, (_, rest)) in enumerate(zip(models, parts))]


def add_weights(days: DataFrame, weights: dict[str, Column], sample_weight: str | None = None,
                person: str = "patient_id", time: str = "tstop", tasks: int | None = None) -> DataFrame:
    """Add each weight, its cumulative product per person, the products over all of them and, with a
    sampling weight, their sampled versions. ``tasks``: over how many tasks the people are dealt to be sorted by time;
    what adaptive execution would merge follows the compressed size, not the rows a task sorts."""
    upto = running([person], [time])
    out = days.withColumns({f"ipweight_{n}": F.coalesce(c, F.lit(1.0)) for n, c in weights.items()})
    if tasks is not None:
        out = out.repartition(tasks, person)
    out = out.withColumns({f"cmlipweight_{n}": F.product(F.col(f"ipweight_{n}")).over(upto) for n in weights})
    times = lambda prefix: reduce(lambda a, b: a * b, [F.col(f"{prefix}_{n}") for n in weights])
    out = out.withColumns({"ipweight": times("ipweight"), "cmlipweight": times("cmlipweight")})
    if sample_weight:
        out = out.withColumns({
            "ipweight_sample": F.col("ipweight") * F.col(sample_weight),
            "cmlipweight_sample": F.col("cmlipweight") * F.col(sample_weight)})
    return out


def weight_report(days: DataFrame, threshold: int = 5) -> DataFrame:
    """Distribution of every weight column."""
    return numeric_summary(days, [c for c in days.columns if "ipweight" in c], threshold=threshold)


def weight_histogram(days: DataFrame, weight: str, bins: int = 30, lo: float = -3.0, hi: float = 3.0) -> DataFrame:
    """Counts of equal-width bins of the weight's decimal logarithm, both ends open."""
    x = F.log10(F.col(weight))
    width = (hi - lo) / bins
    place = F.least(F.greatest(F.floor((x - lo) / width), F.lit(-1)), F.lit(bins)).cast("int")
    return days.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "bin_start", F.lit(lo) + F.col("bin") * F.lit(width))
