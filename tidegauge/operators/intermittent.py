"""Intermittent-demand forecasts (Croston and Croston-TSB) for long series.

Both smooth a state with ``state <- rate * value + (1 - rate) * state``, and the
scan over a series is done in blocks; see :func:`decayed_state`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.operators.joins import attach
from tidegauge.operators.position import decay_block_rows


#: Steps folded to one at each level of a chain, and levels below the last.
FAN, LEVELS = 256, 2


def _power(decay: float, exponent: Column) -> Column:
    return F.pow(F.lit(float(decay)), exponent.cast("double"))


def decayed_state(
    rows: DataFrame,
    updates: dict[str, tuple[str, float]],
    by: Sequence[str],
    position: str,
) -> DataFrame:
    """Scan ``state <- decay * state + u`` over blocks of rows.

    ``rows`` carries a ``_block`` column of consecutive positions, at most
    :func:`~tidegauge.operators.position.decay_block_rows` of them. ``updates``
    maps a state to its column of non-negative ``u`` (NULL: no update on that
    row) and its decay. Adds the state after the row and, as
    ``<name>_before``, the state ahead of it; NULL until the first update.

    After ``k`` updates in a block the state is
    ``decay**k * (state at block start + sum of u_i * decay**-i)``, a running
    sum. A block hands on its number of updates and its own weighted sum.
    """
    by = list(by)
    in_block = Window.partitionBy(*by, "_block").orderBy(position)
    so_far = in_block.rowsBetween(Window.unboundedPreceding, 0)

    counted = rows.withColumns({f"_k_{name}": F.count(u).over(so_far) for name, (u, _) in updates.items()})
    terms = {}
    for name, (u, decay) in updates.items():
        terms[f"_u_{name}"] = F.col(u) * _power(decay, -F.col(f"_k_{name}")) if decay > 0 else F.col(u)
    counted = counted.withColumns(terms)

    blocks = counted.groupBy(*by, "_block").agg(
        *[F.count(f"_u_{name}").alias(f"_k_{name}") for name in updates],
        *[
            (
                F.sum(f"_u_{name}") * _power(decay, F.count(f"_u_{name}"))
                if decay > 0
                else F.max_by(f"_u_{name}", F.when(F.col(f"_u_{name}").isNotNull(), F.col(position)))
            ).alias(f"_u_{name}")
            for name, (_, decay) in updates.items()
        ],
    )
    weights = {f"_a_{name}": _power(decay, F.col(f"_k_{name}")) for name, (_, decay) in updates.items()}
    starts = state_before(blocks.withColumns(weights).withColumnRenamed("_block", "_id"), list(updates), by)
    starts = starts.withColumnRenamed("_id", "_block")

    scanned = counted.join(starts, [*by, "_block"]).withColumns(
        {
            f"_run_{name}": (
                F.sum(f"_u_{name}") if decay > 0 else F.last(f"_u_{name}", ignorenulls=True)
            ).over(so_far)
            for name, (_, decay) in updates.items()
        }
    )
    after = {}
    for name, (_, decay) in updates.items():
        run, start = F.col(f"_run_{name}"), F.col(f"_in_{name}")
        if decay > 0:
            total = F.when(run.isNull(), start).otherwise(run + F.coalesce(start, F.lit(0.0)))
            after[name] = total * _power(decay, F.col(f"_k_{name}"))
        else:
            after[name] = F.coalesce(run, start)
    return (
        scanned.withColumns(after)
        .withColumns(
            {f"{name}_before": F.coalesce(F.lag(name).over(in_block), F.col(f"_in_{name}")) for name in updates}
        )
        .drop(*[f"{p}{name}" for name in updates for p in ("_k_", "_u_", "_in_", "_run_")])
    )


def state_before(steps: DataFrame, names: Sequence[str], by: Sequence[str], level: int = LEVELS) -> DataFrame:
    """``by, _id, _in_<name>``: the state ahead of every step of a long chain.

    Step ``_id`` turns a state ``s`` into ``_a_<name> * s + _u_<name>``; where
    ``_u_`` is NULL it leaves the state as it is, and the state is NULL up to the first
    one that is not. Such steps compose to a pair of the same kind, so ``FAN`` steps are
    folded to one, the chain of these is solved the same way, and each group is then
    walked from the state it starts with. No group holds more than ``FAN`` steps, but
    for the last level with one step for each ``FAN ** LEVELS``. Weights shrink to
    zero as doubles do; nothing is cut off before.
    """
    by, names = list(by), list(names)
    group = F.floor(F.col("_id") / FAN).cast("bigint") if level else F.lit(0).cast("bigint")
    step = F.struct("_id", *[f"{p}{name}" for name in names for p in ("_a_", "_u_")])
    groups = steps.withColumn("_group", group).groupBy(*by, "_group").agg(F.sort_array(F.collect_list(step)).alias("_steps"))

    def after(state: Column, one: Column, name: str) -> Column:
        update = one[f"_u_{name}"]
        return F.when(update.isNull(), state).when(state.isNull(), update).otherwise(one[f"_a_{name}"] * state + update)

    none = F.lit(None).cast("double")
    if level:
        start = F.struct(*[c for name in names for c in (F.lit(1.0).alias(f"_a_{name}"), none.alias(f"_u_{name}"))])
        folded = F.aggregate(
            "_steps",
            start,
            lambda so_far, one: F.struct(
                *[
                    c
                    for name in names
                    for c in (
                        (so_far[f"_a_{name}"] * one[f"_a_{name}"]).alias(f"_a_{name}"),
                        after(so_far[f"_u_{name}"], one, name).alias(f"_u_{name}"),
                    )
                ]
            ),
        )
        above = groups.select(*by, F.col("_group").alias("_id"), folded.alias("_all")).select(*by, "_id", "_all.*")
        ahead = state_before(above, names, by, level - 1).withColumnRenamed("_id", "_group")
        groups = groups.join(ahead, [*by, "_group"])
    else:
        groups = groups.withColumns({f"_in_{name}": none for name in names})

    ids = dict(steps.dtypes)["_id"]
    fields = ", ".join([f"_id: {ids}", *[f"_in_{name}: double" for name in names]])
    done = F.array().cast(f"array<struct<{fields}>>")
    walked = F.aggregate(
        "_steps",
        F.struct(done.alias("done"), *[F.col(f"_in_{name}").alias(name) for name in names]),
        lambda so_far, one: F.struct(
            F.concat(
                so_far["done"], F.array(F.struct(one["_id"].alias("_id"), *[so_far[name].alias(f"_in_{name}") for name in names]))
            ).alias("done"),
            *[after(so_far[name], one, name).alias(name) for name in names],
        ),
        lambda end: end["done"],
    )
    return groups.select(*by, F.explode(walked).alias("_of")).select(*by, "_of.*")


def _smoothed_demand(
    df: DataFrame,
    demand: str,
    by: Sequence[str],
    position: str,
    alpha: float,
    beta: float | None,
    extra_periods: int,
    block_rows: int | None,
) -> DataFrame:
    """Rows ``(by..., position, demand, level, period)`` with the state ahead of
    each row, followed by the future rows. ``beta`` is None for Croston, else
    the rate of the demand probability that then stands in ``period``."""
    by = list(by)
    keep = 1.0 - alpha
    # Longer blocks would underflow the decay, so the bound holds for a given size, too.
    bound = decay_block_rows(keep, keep if beta is None else 1.0 - beta)
    size = min(block_rows or bound, bound)
    at, d = F.col(position), F.col("demand")
    hit = d > 0
    hit_at = F.when(hit, at)
    rows = df.select(
        *by, position, F.col(demand).cast("double").alias("demand"), F.floor(at / size).cast("bigint").alias("_block")
    )

    # Per block: where demand begins and ends; per series: its first demand and its end.
    blocks = rows.groupBy(*by, "_block").agg(
        F.max(hit_at).alias("_tail_hit"),
        F.min(hit_at).alias("_head_hit"),
        F.min_by("demand", hit_at).alias("_head_demand"),
        F.min_by("demand", at).alias("_opening"),
        F.max(at).alias("_last"),
    )
    # Demand last seen before a block: a step that replaces the state.
    hits = blocks.select(
        *by, F.col("_block").alias("_id"), F.lit(0.0).alias("_a_hit"), F.col("_tail_hit").cast("double").alias("_u_hit")
    )
    carried = state_before(hits, ["hit"], by).select(
        *by, F.col("_id").alias("_block"), F.col("_in_hit").cast("bigint").alias("_carried_hit")
    )
    hit_block = F.when(F.col("_head_hit").isNotNull(), F.col("_block"))
    series = blocks.groupBy(*by).agg(
        F.coalesce(F.min_by("_head_demand", hit_block), F.min_by("_opening", "_block")).alias("_first_level"),
        F.coalesce(F.min("_head_hit") + 1, F.lit(1)).cast("double").alias("_first_wait"),
        F.max("_last").alias("_last"),
    )
    facts = attach(carried, series, by)

    in_block = Window.partitionBy(*by, "_block").orderBy(position)
    earlier = in_block.rowsBetween(Window.unboundedPreceding, -1)
    known = rows.withColumn("_seen", F.last(hit_at, ignorenulls=True).over(earlier)).join(facts, [*by, "_block"])
    previous_hit = F.coalesce("_seen", "_carried_hit")
    # The initial state equals the first update, so that one enters with weight 1.
    rate = F.when(previous_hit.isNull(), 1.0).otherwise(alpha)
    if beta is None:
        initial = F.col("_first_wait")
        second = F.when(hit, rate * (at - F.coalesce(previous_hit, F.lit(-1))))
        second_decay = keep
    else:
        initial = 1.0 / F.col("_first_wait")
        occurred = F.when(hit, beta).otherwise(0.0)
        second = F.when(at == 0, occurred + (1.0 - beta) * initial).otherwise(occurred)
        second_decay = 1.0 - beta
    known = known.withColumns({"_level_update": F.when(hit, rate * d), "_period_update": second})
    state = decayed_state(
        known, {"level": ("_level_update", keep), "period": ("_period_update", second_decay)}, by, position
    )

    def cell(position_column, demand_column, suffix):
        return F.struct(
            position_column.alias(position),
            demand_column.alias("demand"),
            F.coalesce(F.col(f"level{suffix}"), F.col("_first_level")).alias("level"),
            F.coalesce(F.col(f"period{suffix}"), initial).alias("period"),
        )

    emitted = F.array(cell(at, d, "_before"))
    if extra_periods > 0:
        future = F.transform(
            F.sequence(F.lit(1), F.lit(extra_periods)), lambda i: cell(at + i, F.lit(None).cast("double"), "")
        )
        emitted = F.when(at == F.col("_last"), F.concat(emitted, future)).otherwise(emitted)
    return state.select(*by, F.explode(emitted).alias("_cell")).select(*by, "_cell.*")


def croston(
    df: DataFrame,
    demand: str,
    by: Sequence[str] = ("protocol",),
    position: str = "t",
    alpha: float = 0.4,
    extra_periods: int = 1,
    block_rows: int | None = None,
) -> DataFrame:
    """Croston forecast per series: ``demand, forecast, period, level, error``.

    Level and period are smoothed on rows with positive demand only. Every row
    holds the forecast made before it was seen; ``extra_periods`` rows follow
    the last one.
    """
    state = _smoothed_demand(df, demand, by, position, alpha, None, extra_periods, block_rows)
    return _with_forecast(state, F.try_divide("level", "period"), by, position)


def croston_tsb(
    df: DataFrame,
    demand: str,
    by: Sequence[str] = ("protocol",),
    position: str = "t",
    alpha: float = 0.4,
    beta: float = 0.4,
    extra_periods: int = 1,
    block_rows: int | None = None,
) -> DataFrame:
    """Croston-TSB forecast: as :func:`croston`, but ``period`` is the demand
    probability, updated on every row with ``beta``."""
    state = _smoothed_demand(df, demand, by, position, alpha, beta, extra_periods, block_rows)
    return _with_forecast(state, F.col("level") * F.col("period"), by, position)


def _with_forecast(state: DataFrame, forecast: Column, by: Sequence[str], position: str) -> DataFrame:
    return state.select(
        *by, position, "demand", forecast.alias("forecast"), "period", "level",
        (F.col("demand") - forecast).alias("error"),
    )
