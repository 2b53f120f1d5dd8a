"""One-to-one matching of treated people with not-yet-treated controls.

The sequential match takes treated people in the order (trial day, id). Each gets the control with
the smallest id that is unused, agrees on the exact columns, lies within the calipers and is not
treated on or before that day. Exact strata never share controls, so they are independent. A
stratum itself may be huge; it is worked off in blocks of bounded size:

* days are packed into blocks so that no stratum has more than ``block_rows`` treated people plus
  expiring controls in a block; a single day that is too large is cut by treated id;
* a block only loads the controls it can reach: for a caliper value within reach of m treated
  people of the block, the first m controls that stay available (and those expiring before them);
* used controls are removed before the next block. Each block's pairs are checkpointed, so the loss
  of an executor costs at most one block.

Small inputs make exactly one block. The pairs are the same for every block size.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from cohortspark.functions.disclosure import roundmid_any
from cohortspark.operators import ranking
from cohortspark.operators.windows import date_points, dense_grid, running
from cohortspark.session import stable

BLOCK_ROWS = 500_000
NEVER = 2**31 - 1
MERGE_AFTER = 16


@dataclass(frozen=True)
class Block:
    """Consecutive trial days, or one id slice of a single day."""

    first: int
    last: int
    bounds: tuple[float, ...] = ()
    slices: tuple[int, int] | None = None


def pack(sizes: Sequence[tuple[int, int]], limit: int) -> list[tuple[int, int]]:
    """Group consecutive (key, size) entries into runs whose sizes add up to at most the limit."""
    runs: list[tuple[int, int]] = []
    total = 0
    for key, size in sorted(sizes):
        if runs and total + size <= limit:
            runs[-1] = (runs[-1][0], key)
            total += size
        else:
            runs.append((key, key))
            total = size
    return runs


def greedy_pairs(treated: pd.DataFrame, controls: pd.DataFrame, widths: Mapping[str, int]) -> Iterator[tuple]:
    """The greedy rule inside one stratum of one block: (treated id, control id, day, until).

    Controls wait in one queue per caliper value, by id. Only queue heads are ever taken, and a head
    that has expired can be dropped for good because days only move forward.
    """
    cols = list(widths)
    controls = controls.sort_values("_id")
    queues: dict[tuple, list[tuple[int, int]]] = {}
    values = zip(*[controls[c] for c in cols]) if cols else itertools.repeat((), len(controls))
    for value, cid, until in zip(values, controls["_id"], controls["_until"]):
        queues.setdefault(tuple(value), []).append((cid, until))
    heads = dict.fromkeys(queues, 0)
    reach = list(itertools.product(*[range(-w, w + 1) for w in widths.values()]))
    treated = treated.sort_values(["_day", "_id"])
    values = zip(*[treated[c] for c in cols]) if cols else itertools.repeat((), len(treated))
    for value, tid, day in zip(values, treated["_id"], treated["_day"]):
        best, best_key = None, None
        for step in reach:
            key = tuple(a + b for a, b in zip(value, step))
            queue = queues.get(key)
            if queue is None:
                continue
            at = heads[key]
            while at < len(queue) and queue[at][1] <= day:
                at += 1
            heads[key] = at
            if at < len(queue) and (best is None or queue[at][0] < best[0]):
                best, best_key = queue[at], key
        if best is not None:
            heads[best_key] += 1
            yield tid, best[0], day, best[1]


def _plan_blocks(t: DataFrame, c: DataFrame, exact: Sequence[str], limit: int) -> tuple[list[Block], bool]:
    """Blocks in order, and whether reachable controls must be selected per block."""
    load = t.groupBy(*exact, "_day").agg(F.count(F.lit(1)).alias("n"), F.lit(1).alias("_t")).unionByName(
        c.where(F.col("_until") < NEVER).groupBy(*exact, F.col("_until").alias("_day"))
        .agg(F.count(F.lit(1)).alias("n"), F.lit(0).alias("_t"))
    )
    per_day = (
        load.groupBy(*exact, "_day").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("_t")).alias("nt"))
        .groupBy("_day").agg(F.max("n").alias("n"), F.sum("nt").alias("nt"))
    )
    days = [(r["_day"], r["n"], r["nt"]) for r in per_day.collect()]
    trial_days = [d for d, _, nt in days if nt]
    if not trial_days:
        return [], False
    lo, hi = min(trial_days), max(trial_days)
    biggest_pool = c.groupBy(*exact).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    blocks = []
    for first, last in pack([(d, n) for d, n, _ in days if lo <= d <= hi], limit):
        size = next(n for d, n, _ in days if d == first)
        if first == last and size > limit:
            one = t.where(F.col("_day") == first)
            bounds = ranking.bucket_bounds(one, "_id", min(ranking.MAX_BUCKETS, 4 * math.ceil(size / limit)))
            cut = ranking.add_bucket(one, "_id", bounds)
            sizes = cut.groupBy(*exact, "_bucket").agg(F.count(F.lit(1)).alias("n")).groupBy("_bucket").agg(F.max("n"))
            for a, b in pack([(int(r[0]), r[1]) for r in sizes.collect()], limit):
                blocks.append(Block(first, last, tuple(bounds), (a, b)))
        else:
            blocks.append(Block(first, last))
    return blocks, len(blocks) > 1 or biggest_pool > limit


def _of_block(t: DataFrame, block: Block) -> DataFrame:
    part = t.where(F.col("_day").between(block.first, block.last))
    if block.slices:
        part = ranking.add_bucket(part, "_id", block.bounds)
        part = part.where(F.col("_bucket").between(*block.slices)).drop("_bucket")
    return part


def _reachable(t: DataFrame, c: DataFrame, exact: Sequence[str], widths: Mapping[str, int], block: Block) -> DataFrame:
    """The controls this block can possibly use (see the module text)."""
    need = t.groupBy(*exact, *widths).agg(F.count(F.lit(1)).alias("_m"))
    for name, w in widths.items():
        steps = F.sequence(F.lit(-w), F.lit(w))
        need = need.withColumn("_step", F.explode(steps)).withColumn(name, F.col(name) + F.col("_step")).drop("_step")
    need = need.groupBy(*exact, *widths).agg(F.sum("_m").alias("_m"))
    keys = [*exact, *widths]
    open_now = c.where(F.col("_until") > block.first)
    counts = open_now.groupBy(*keys, "_bucket").agg(
        F.count(F.when(F.col("_until") > block.last, F.lit(1))).alias("_safe"))
    below = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    keep = (
        counts.withColumn("_before", F.coalesce(F.sum("_safe").over(below), F.lit(0)))
        .join(need, keys).where(F.col("_before") < F.col("_m")).select(*keys, "_bucket")
    )
    return open_now.join(keep, [*keys, "_bucket"], "left_semi")


def sequential_match(treated: DataFrame, controls: DataFrame, exact: Sequence[str], caliper: Mapping[str, int],
                     day: str = "trial_date", until: str = "treated_date", person: str = "patient_id",
                     block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Greedy sequential matching without replacement.

    ``treated``: one row per treated person with the trial day. ``controls``: one row per potential
    control with the day of own treatment (NULL if never). Caliper columns must be whole numbers.
    Rows with a missing matching value cannot match. Returns one row per pair:
    (exact..., treated_id, control_id, trial_date, controlistreated_date).
    """
    for name in caliper:
        kind = dict(controls.dtypes)[name]
        if kind not in ("tinyint", "smallint", "int", "bigint"):
            raise ValueError(f"caliper column {name} must be a whole number, is {kind}")
    # aliases keep the two sides apart when both come from one table
    cols = [*[F.col(e).alias(e) for e in exact], *[F.col(n).cast("long").alias(n) for n in caliper]]
    names = [*exact, *caliper]
    t = treated.select(*cols, F.col(person).cast("long").alias("_id"), F.unix_date(day).alias("_day"))
    t = t.dropna(subset=[*names, "_day"])
    c = controls.select(
        *cols, F.col(person).cast("long").alias("_id"),
        F.coalesce(F.unix_date(until), F.lit(NEVER)).alias("_until"),
    ).dropna(subset=names)

    # both narrow inputs are read several times; written once, nothing upstream is computed again
    t, c = stable(t), stable(c)
    blocks, select_controls = _plan_blocks(t, c, exact, block_rows)
    types = dict(t.dtypes)
    schema = ", ".join([*[f"`{e}` {types[e]}" for e in exact],
                        "treated_id long", "control_id long", "_day int", "_until int"])

    def match(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = [(*key, *pair) for pair in greedy_pairs(left, right, caliper)]
        return pd.DataFrame(rows, columns=[*exact, "treated_id", "control_id", "_day", "_until"])

    if select_controls:
        n = ranking.n_buckets_for(c.count(), max(1, block_rows // 50))
        c = ranking.add_bucket(c, "_id", ranking.bucket_bounds(c, "_id", n))
    done: list[DataFrame] = []
    for block in blocks:
        left, right = _of_block(t, block), c
        if done:
            used = reduce(DataFrame.unionByName, done).select(F.col("control_id").alias("_id"))
            right = right.join(used, "_id", "left_anti")
        if select_controls:
            right = _reachable(left, right, exact, caliper, block)
        if exact:
            pairs = left.groupBy(*exact).cogroup(right.groupBy(*exact)).applyInPandas(match, schema)
        else:
            one = F.lit(0).alias("_g")
            pairs = left.groupBy(one).cogroup(right.groupBy(one)).applyInPandas(
                lambda key, a, b: match((), a, b), schema)
        done.append(stable(pairs))
        if len(done) >= MERGE_AFTER:
            done = [stable(reduce(DataFrame.unionByName, done))]  # keeps the plan of the next blocks small
    spark = treated.sparkSession
    out = reduce(DataFrame.unionByName, done) if done else spark.createDataFrame([], schema)
    return out.select(
        *exact, "treated_id", "control_id",
        F.date_from_unix_date("_day").alias("trial_date"),
        F.when(F.col("_until") < NEVER, F.date_from_unix_date("_until")).alias("controlistreated_date"),
    )


def exact_rank_match(treated: DataFrame, pool: DataFrame, exact: Sequence[str], day: str = "trial_date",
                     person: str = "patient_id", rows_per_bucket: int = ranking.ROWS_PER_BUCKET) -> DataFrame:
    """Exact-only matching against a pool of controls whose eligibility never ends.

    The k-th treated person of a stratum, by (day, id), meets the k-th control by id: two rankings
    and one equality join.
    """
    t = treated.select(*exact, F.col(person).alias("treated_id"), F.col(day).alias("trial_date"))
    t = t.dropna(subset=[*exact, "trial_date"])
    in_day = ranking.row_numbers(t, [*exact, "trial_date"], "treated_id", "_pos", rows_per_bucket)
    per_day = t.groupBy(*exact, "trial_date").agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy(*exact).orderBy("trial_date").rowsBetween(W.unboundedPreceding, -1)
    offset = per_day.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    left = in_day.join(offset, [*exact, "trial_date"]).withColumn("rank", F.col("_pos") + F.col("_before"))
    p = pool.select(*exact, F.col(person).alias("control_id")).dropna(subset=list(exact))
    right = ranking.row_numbers(p, exact, "control_id", "rank", rows_per_bucket)
    return left.join(right, [*exact, "rank"]).select(*exact, "treated_id", "control_id", "trial_date")


def number_pairs(pairs: DataFrame, rows_per_bucket: int = ranking.ROWS_PER_BUCKET) -> DataFrame:
    """Number the pairs of each trial day by treated id; (trial_date, match_id) is the pair key."""
    return ranking.row_numbers(pairs, ["trial_date"], "treated_id", "match_id", rows_per_bucket)


def pair_members(pairs: DataFrame) -> DataFrame:
    """Two rows per numbered pair: the treated person and the control."""
    both = F.array(
        F.struct(F.col("treated_id").alias("patient_id"), F.lit(1).alias("treated")),
        F.struct(F.col("control_id").alias("patient_id"), F.lit(0).alias("treated")),
    )
    return pairs.select(F.explode(both).alias("_m"), "trial_date", "match_id", "controlistreated_date").select(
        "_m.*", "trial_date", "match_id", "controlistreated_date")


def match_status(treated: DataFrame, pairs: DataFrame, start, day: str = "trial_date",
                 person: str = "patient_id") -> DataFrame:
    """Status of all treated people (matched or not) and of the matched controls."""
    members = pair_members(pairs)
    mine = members.where("treated = 1").select(
        F.col("patient_id").alias("_p"), F.col("trial_date").alias("_d"), "match_id", "controlistreated_date")
    treated = treated.select(F.col(person).alias("patient_id"), F.col(day).alias("trial_date"))
    left = treated.join(mine, (treated["patient_id"] == mine["_p"]) & (treated["trial_date"] == mine["_d"]), "left")
    hit = F.col("match_id").isNotNull()
    left = left.select(
        "patient_id", "match_id", hit.cast("int").alias("matched"), F.lit(1).alias("treated"),
        F.when(hit, F.lit(0)).alias("control"), "trial_date", "controlistreated_date")
    right = members.where("treated = 0").select(
        "patient_id", "match_id", F.lit(1).alias("matched"), "treated", F.lit(1).alias("control"),
        "trial_date", "controlistreated_date")
    return left.unionByName(right).withColumn("trial_time", F.datediff("trial_date", F.lit(start)))


def drop_already_matched(candidates: DataFrame, previous: DataFrame) -> DataFrame:
    """Between rounds: remove people who already serve in the same role."""
    return candidates.join(previous.select("patient_id", "treated"), ["patient_id", "treated"], "left_anti")


def recheck_pairs(members: DataFrame, exact: Sequence[str], caliper: Mapping[str, float],
                  eligible: str | None = None) -> DataFrame:
    """Keep the pairs that still hold after covariates were taken again at the trial date.

    Both members share a pair key, so one shuffle on it is enough; there is no self-join.
    """
    pair = W.partitionBy("trial_date", "match_id")
    tests = [F.count(F.lit(1)).over(pair) == 2]
    for c in exact:
        tests += [F.count(c).over(pair) == 2, F.min(c).over(pair).eqNullSafe(F.max(c).over(pair))]
    for c, w in caliper.items():
        tests += [F.count(c).over(pair) == 2, (F.max(c).over(pair) - F.min(c).over(pair)) <= F.lit(w)]
    if eligible:
        tests.append(F.min(F.coalesce(F.col(eligible), F.lit(False))).over(pair))
    ok = reduce(lambda a, b: a & b, tests)
    return members.withColumn("_ok", ok).where("_ok").drop("_ok")


def success_share(before: DataFrame, after: DataFrame) -> DataFrame:
    """Pairs kept, pairs proposed and the percentage kept."""
    both = before.select("treated", F.lit(0).alias("_k")).unionByName(after.select("treated", F.lit(1).alias("_k")))
    pairs = lambda k: F.count(F.when((F.col("treated") == 1) & (F.col("_k") == k), F.lit(1)))
    return both.agg(pairs(1).alias("kept"), pairs(0).alias("proposed")).withColumn(
        "pct", F.round(100 * F.try_divide(F.col("kept").cast("double"), F.col("proposed").cast("double")), 2))


def add_round(status: DataFrame, number: int, previous: DataFrame | None = None) -> DataFrame:
    """Tag this round's matches and append those of earlier rounds."""
    cols = ["patient_id", "match_id", "trial_date", "matching_round", "treated", "controlistreated_date"]
    now = status.withColumn("matching_round", F.lit(number)).select(*cols)
    return now if previous is None else now.unionByName(previous.select(*cols))


def coverage(status: DataFrame, start, end, threshold: int = 1, day: str = "trial_date",
             matched: str = "matched") -> DataFrame:
    """Matched and unmatched treated people per day and cumulatively, every day of the period present.
    The cumulative count is rounded and the daily count is its difference."""
    per_day = status.groupBy(F.col(day).alias("date")).agg(
        F.count(F.lit(1)).alias("_all"), F.sum(matched).alias("_hit"))
    long = per_day.select("date", F.explode(F.array(
        F.struct(F.lit("unmatched").alias("status"), (F.col("_all") - F.col("_hit")).alias("n")),
        F.struct(F.lit("matched").alias("status"), F.col("_hit").alias("n")),
    )).alias("_s")).select("date", "_s.*")
    grid = dense_grid(long, ["status"], "date", date_points(start, end), {"n": 0})
    w = running(["status"], ["date"])
    cum = grid.withColumn("cumuln", roundmid_any(F.sum("n").over(w), threshold).cast("long"))
    step = W.partitionBy("status").orderBy("date")
    return cum.withColumn("n", F.col("cumuln") - F.lag("cumuln", 1, 0).over(step))


def duplicated_members(status: DataFrame) -> DataFrame:
    """Per role, how many people were matched more than once."""
    n = status.groupBy("treated", "patient_id").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("treated").agg(F.sum((F.col("n") > 1).cast("long")).alias("n_duplicated"))
