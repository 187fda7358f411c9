"""Statistics that are kept as state and merged: a new day's rows are read, those of all days before are not.

A state row holds what adds up (rows, sums) and sketches: HyperLogLog for numbers of distinct values and KLL for quantiles.
States of any parts of the rows merge in any order, and a merged state is a state again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Registers of HyperLogLog, as a power of two: a relative standard error of 1.04 / sqrt(2 ** 14), 0.8 %.
REGISTERS = 14
#: KLL's k: a rank is off by about 1 % at most, nearly always.
KLL_K = 400


def partial(rows: DataFrame, by: list[str], *, distinct: list[str] = (), measures: list[str] = ()) -> DataFrame:
    """One state row for each value of `by`: rows, and for each column its sketch; of measures (whole numbers) the sum, too. Nulls in a
    column count as rows alone. Without rows there is no state."""
    parts = [F.count("*").alias("rows")]
    parts += [F.hll_sketch_agg(F.col(c), REGISTERS).alias(f"{c}_distinct") for c in distinct]
    for c in measures:
        parts += [F.sum(F.col(c).cast("long")).alias(f"{c}_sum"), F.kll_sketch_agg_bigint(F.col(c).cast("long"), KLL_K).alias(f"{c}_ranks")]
    return rows.groupBy(*by).agg(*parts)


def merge(states: DataFrame, by: list[str]) -> DataFrame:
    """States put together to those of fewer groups."""

    def one(c: str):
        if c == "rows" or c.endswith("_sum"):
            return F.sum(c).alias(c)
        return (F.hll_union_agg(c) if c.endswith("_distinct") else F.kll_merge_agg_bigint(c)).alias(c)

    held = [c for c in states.columns if c == "rows" or c.endswith(("_sum", "_distinct", "_ranks"))]
    return states.groupBy(*by).agg(*(one(c) for c in held))


def estimates(states: DataFrame, quantiles: tuple[float, ...] = (0.5,)) -> DataFrame:
    """Numbers in the place of sketches: {c}_distinct, and {c}_quantiles, an array."""
    out = []
    for c in states.columns:
        if c.endswith("_distinct"):
            out.append(F.hll_sketch_estimate(c).alias(c))
        elif c.endswith("_ranks"):
            ranks = F.array(*(F.lit(float(q)) for q in quantiles))
            out.append(F.kll_sketch_get_quantile_bigint(F.col(c), ranks).alias(c.removesuffix("_ranks") + "_quantiles"))
        else:
            out.append(F.col(c))
    return states.select(*out)


def entity_state(entities: DataFrame, *extra: str) -> DataFrame:
    """The statistics of active entities by application as a state: entities, types, occurrences, and how many of each confidence."""
    levels = [F.sum((F.coalesce(F.col("confidence") == c, F.lit(False))).cast("long")).alias(f"{c}_confidence_sum") for c in ("high", "medium", "low")]
    by = ["app_id", *extra]
    active = entities.where("is_active")
    return partial(active, by, distinct=["entity_id", "type"], measures=["occurrence_count"]).join(active.groupBy(*by).agg(*levels), by)
