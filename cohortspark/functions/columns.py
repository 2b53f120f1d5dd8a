"""Column helpers: each takes and returns Columns, runs no job and stays inside code generation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date
from functools import reduce
from itertools import chain

from pyspark.sql import Column, functions as F

INF = float("inf")


# -- recoding ------------------------------------------------------------------------------------

def case_levels(branches: Sequence[tuple[Column, str | None]], default: str | None = None):
    """First true branch wins and a NULL predicate falls through. Returns (column, ordered levels)."""
    out = reduce(
        lambda acc, b: F.when(b[0], F.lit(b[1])) if acc is None else acc.when(b[0], F.lit(b[1])),
        branches, None,
    )
    levels = list(dict.fromkeys(lbl for _, lbl in [*branches, (None, default)] if lbl is not None))
    return out.otherwise(F.lit(default)), levels


def recode(col: Column, mapping: Mapping[str, str]) -> Column:
    """Dictionary lookup; a value outside the dictionary becomes NULL."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return F.try_element_at(table, col)


def level_order(col: Column, levels: Sequence[str]) -> Column:
    """1-based position of the value among its levels (the sort key of an ordered category)."""
    return F.nullif(F.array_position(F.array(*[F.lit(x) for x in levels]), col), F.lit(0)).cast("int")


def collapse(col: Column, groups: Mapping[str, Sequence[str]]) -> Column:
    """Merge levels into named groups; levels that no group lists are kept."""
    merged = {old: new for new, olds in groups.items() for old in olds}
    return F.coalesce(recode(col, merged), col)


def reverse_order(order: Column, n_levels: int) -> Column:
    """Sort key of the reversed level order."""
    return F.lit(n_levels + 1) - order


# -- banding -------------------------------------------------------------------------------------

def cut_band(x: Column, breaks: Sequence[float], labels: Sequence[str], right: bool = False,
             include_lowest: bool = False) -> Column:
    """Cut a number into labelled bands, closed on the left unless ``right``; outside is NULL."""
    if len(labels) != len(breaks) - 1:
        raise ValueError("need one label fewer than breaks")
    out = None
    for i, label in enumerate(labels):
        lo, hi = breaks[i], breaks[i + 1]
        above = None if lo == -INF else (x > lo if right else x >= lo)
        below = None if hi == INF else (x <= hi if right else x < hi)
        if include_lowest and right and i == 0 and lo != -INF:
            above = x >= lo
        if include_lowest and not right and i == len(labels) - 1 and hi != INF:
            below = x <= hi
        test = [t for t in (above, below) if t is not None]
        cond = reduce(lambda a, b: a & b, test) if test else x.isNotNull()
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out


def cut_band_missing(x: Column, breaks: Sequence[float], labels: Sequence[str], missing: str) -> Column:
    """Banding in which a missing value has its own label."""
    return F.when(x.isNull(), F.lit(missing)).otherwise(cut_band(x, breaks, labels))


def timesince_labels(breaks: Sequence[int], prelabel: str = "pre", prefix: str = "") -> list[str]:
    """Labels of the time-since bands: the pre band, ``b+1-next`` and an open last band."""
    ends = [*[f"-{b}" for b in breaks[1:]], "+"]
    return [prefix + prelabel] + [f"{prefix}{b + 1}{e}" for b, e in zip(breaks, ends)]


def timesince_cut(x: Column, breaks: Sequence[int], prelabel: str = "pre", prefix: str = "") -> Column:
    """Band a time since treatment. Bands are closed on the right, so time zero is still ``pre``;
    a missing time counts as later than every break and takes the last band."""
    labels = timesince_labels(breaks, prelabel, prefix)
    out = F.when(x.isNull(), F.lit(labels[-1]))
    for hi, label in zip(breaks, labels):
        out = out.when(x <= hi, F.lit(label))
    return out.otherwise(F.lit(labels[-1]))


def round_tte(time: Column, width: int = 7) -> Column:
    """Number of the follow-up block of ``width`` days; time zero is block zero."""
    return F.ceil(time / F.lit(width)).cast("int")


# -- dates and time to event ---------------------------------------------------------------------

def earliest(*cols: Column) -> Column:
    """Row-wise minimum that skips NULLs."""
    return cols[0] if len(cols) == 1 else F.least(*cols)


def latest(*cols: Column) -> Column:
    """Row-wise maximum that skips NULLs."""
    return cols[0] if len(cols) == 1 else F.greatest(*cols)


def _all_known(cols: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, [c.isNotNull() for c in cols])


def earliest_known(*cols: Column) -> Column:
    """Row-wise minimum that is NULL as soon as one input is."""
    return F.when(_all_known(cols), F.least(*cols))


def latest_known(*cols: Column) -> Column:
    """Row-wise maximum that is NULL as soon as one input is."""
    return F.when(_all_known(cols), F.greatest(*cols))


def day_index(day: Column, origin: date | Column) -> Column:
    """Day number with the origin date as day 1."""
    return F.datediff(day, _date(origin)) + 1


def _date(value: date | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def tte(origin: Column, event: Column, censor: Column, na_censor: bool = False) -> Column:
    """Days from origin to the event. Uncensored form: the earlier of event and censoring, NULLs
    skipped. ``na_censor``: NULL when the event is missing or falls after censoring."""
    if na_censor:
        return F.when(censor >= event, F.datediff(event, origin))
    return F.least(F.datediff(event, origin), F.datediff(censor, origin))


def censor_event(event: Column, censor: Column, na_censor: bool = True) -> Column:
    """Move an event date that lies after censoring: to NULL, or to the censoring date."""
    late = event > censor
    if na_censor:
        return F.when(~late, event)
    return F.when(late, censor).when(~late, event)


def censor_indicator(event: Column, censor: Column) -> Column:
    """True when the event is known and not after censoring."""
    return F.coalesce(event.isNotNull() & ~F.coalesce(event > censor, F.lit(False)), F.lit(False))


# -- logic and arithmetic ------------------------------------------------------------------------

def satisfied(predicate: Column) -> Column:
    """Two-valued truth: unknown is false."""
    return F.coalesce(predicate, F.lit(False))


def resolved_after_onset(onset: Column, resolved: Column) -> Column:
    """A condition is current when it has an onset and no later resolution."""
    return satisfied(onset.isNotNull() & (resolved.isNull() | (resolved < onset)))


def count_true(*flags: Column) -> Column:
    """Number of true flags in the row; NULL when one is unknown."""
    return reduce(lambda a, b: a + b, [f.cast("int") for f in flags])


def any_true(*flags: Column) -> Column:
    return reduce(lambda a, b: a | b, flags)


def ratio(a: Column, b: Column) -> Column:
    """Division in double precision that gives NULL for a zero denominator."""
    return F.try_divide(a.cast("double"), b.cast("double"))


# -- text ----------------------------------------------------------------------------------------

def fixed(x: Column, digits: int = 2) -> Column:
    """A number with a fixed number of decimals and no digit grouping."""
    return F.format_string(f"%.{digits}f", F.round(x.cast("double"), digits))


def percent_text(x: Column, digits: int = 0) -> Column:
    """A share as a percentage; a share that would print as 100% prints as above the largest step."""
    text = F.concat(fixed(x * 100, digits), F.lit("%"))
    cap = f">{100 - 10 ** -digits:.{digits}f}%"
    return F.when(text == f"{100:.{digits}f}%", F.lit(cap)).otherwise(text)


def estimate_text(est: Column, lo: Column, hi: Column, digits: int = 2) -> Column:
    """``est (lo-hi)``."""
    return F.concat(fixed(est, digits), F.lit(" ("), fixed(lo, digits), F.lit("-"), fixed(hi, digits), F.lit(")"))


def truncate_text(x: Column, width: int) -> Column:
    """Cut a text to ``width`` characters, ending in an ellipsis when something was cut."""
    return F.when(F.length(x) <= width, x).otherwise(F.concat(F.substring(x, 1, width - 3), F.lit("...")))


def wrap_text(x: Column, width: int) -> Column:
    """Break a text into lines of at most ``width`` characters at spaces."""
    return F.regexp_replace(F.regexp_replace(x, rf"(.{{1,{width}}})(\s+|$)", "$1\n"), r"\n$", "")


def fill_template(text: Column, values: Mapping[str, Column]) -> Column:
    """Replace every ``{name}`` in a text by the value given for that name."""
    for name, value in values.items():
        text = F.replace(text, F.lit("{" + name + "}"), value)
    return text


def convert_types(df, source: str, target: str, prefix: str = ""):
    """Cast every column of one type (and name prefix) to another, e.g. flags to integers."""
    return df.withColumns({
        n: F.col(n).cast(target) for n, t in df.dtypes if t == source and n.startswith(prefix)
    })
