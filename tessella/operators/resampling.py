"""Bootstrap of any metric of weighted sums, without a row for a draw.

Each replicate draws as many units as there are, with replacement. How many draws fall on a range of
units is split in two again and again by binomial draws, given how many fall on both; each split's
generator is seeded by the range, so any task can follow the splits down to its own units and
give them their weights, the same as any other task would. Weights of a replicate add up to the number of units exactly.
A task adds up weighted sums for each replicate and group; these few rows are all that's shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.frames import numbered, settled

#: Units to a block, whose weights are drawn at once.
BLOCK = 1024


@lru_cache(maxsize=4096)
def _left(seed: int, n: int, low: int, high: int, replicates: int) -> np.ndarray:
    """Of the draws on blocks [low, high), how many fall on the first half, by replicate."""
    middle, size = (low + high) // 2, lambda a, b: min(b * BLOCK, n) - a * BLOCK
    return np.random.default_rng([seed, low, high]).binomial(_count(seed, n, low, high, replicates), size(low, middle) / size(low, high))


@lru_cache(maxsize=4096)
def _count(seed: int, n: int, low: int, high: int, replicates: int) -> np.ndarray:
    """Draws on blocks [low, high) by replicate, by splits from the whole down."""
    count, a, b = np.full(replicates, n, dtype=np.int64), 0, -(-n // BLOCK)
    while (a, b) != (low, high):
        left, middle = _left(seed, n, a, b, replicates), (a + b) // 2
        count, a, b = (left, a, middle) if high <= middle else (count - left, middle, b)
    return count


@lru_cache(maxsize=8)
def weights(seed: int, n: int, block: int, replicates: int) -> np.ndarray:
    """Weights of a block's units, a row a replicate; row 0 is all ones: the sample as it is."""
    size = min((block + 1) * BLOCK, n) - block * BLOCK
    drawn = np.random.default_rng([seed, block]).multinomial(_count(seed, n, block, block + 1, replicates), np.full(size, 1 / size))
    return np.concatenate((np.ones((1, size), dtype=np.int64), drawn))


def resampled(df: DataFrame, unit: str, groups: list[str], sums: dict[str, Column], replicates: int = 200, seed: int = 0) -> DataFrame:
    """(*groups, b, *sums): for each group and replicate the weighted sums of what each row holds; b = 0 is the sample as it is.

    ``sums`` are numbers of a row (null: 0). All rows of a unit move together, in all groups alike; rows with a
    null unit are left out. Groups without a row aren't listed; an empty table gives no rows.
    """
    rows = df.where(F.col(unit).isNotNull()).select(F.col(unit).alias("unit_"), *groups, *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(s) for s, c in sums.items()])
    each = rows.groupBy("unit_", *groups).agg(*[F.sum(s).alias(s) for s in sums])
    units = each.groupBy("unit_").agg(F.collect_list(F.struct(*groups, *sums)).alias("r_"))  # a unit's groups
    units = settled(numbered(units, [F.col("unit_")], "at_"))
    n, names = units.count(), list(sums)
    kinds = {f.name: f.dataType.simpleString() for f in each.schema}

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        for frame in frames:
            block = frame["at_"].to_numpy() // BLOCK
            for k in np.unique(block):
                part = frame[block == k]
                w = weights(seed, n, int(k), replicates)[:, part["at_"].to_numpy() - k * BLOCK]
                named = part.groupby(groups, dropna=False).indices if groups else {(): np.arange(len(part))}
                for name, at in named.items():
                    name = name if isinstance(name, tuple) else (name,)
                    held[name] = held.get(name, 0) + w[:, at] @ part[names].to_numpy()[at]
        for name, total in held.items():
            out = pd.DataFrame(total, columns=names)
            out.insert(0, "b", np.arange(replicates + 1, dtype=np.int32))
            for g, v in zip(groups, name, strict=True):
                out[g] = None if v != v else v
            yield out[[*groups, "b", *names]]

    flat = units.select("at_", F.explode("r_").alias("r")).select("at_", "r.*")
    parts = flat.mapInPandas(add, ", ".join([*[f"`{g}` {kinds[g]}" for g in groups], "b int", *[f"`{s}` double" for s in sums]]))
    return parts.groupBy(*groups, "b").agg(*[F.sum(s).alias(s) for s in sums])


def _ends(values: DataFrame, groups: list[str], alpha: float, *more: Column) -> DataFrame:
    drawn = F.when(F.col("b") > 0, F.col("v"))
    q = lambda p: F.percentile(drawn, F.lit(p))
    return values.groupBy(*groups).agg(F.max(F.when(F.col("b") == 0, F.col("v"))).alias("estimate"), q(alpha / 2).alias("low"), q(1 - alpha / 2).alias("high"), F.count(drawn).alias("n_draws"), *more)


def bootstrap(df: DataFrame, unit: str, groups: list[str], sums: dict[str, Column], metric: Column, replicates: int = 200, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """(*groups, estimate, low, high, n_draws): a metric, a column over the names in ``sums``, with a percentile interval from resampled units.

    Draws that leave the metric undefined (null) don't count.
    """
    values = resampled(df, unit, groups, sums, replicates, seed).withColumn("v", metric)
    return _ends(values, groups, alpha)


def bootstrap_difference(df: DataFrame, unit: str, side: str, a: object, b: object, sums: dict[str, Column], metric: Column, replicates: int = 200, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """One row: the metric of side ``a`` less that of side ``b``, both from the same draws; p is twice the share of draws across zero, at most 1."""
    values = resampled(df.where(F.col(side).isin(a, b)), unit, [side], sums, replicates, seed).withColumn("m_", metric)
    of = lambda s: F.max(F.when(F.col(side) == s, F.col("m_")))
    each = values.groupBy("b").agg((of(a) - of(b)).alias("v"))
    observed = each.where("b = 0").select(F.col("v").alias("o_"))  # one row
    across = F.when(F.col("b") > 0, F.when(F.col("o_") > 0, F.col("v") <= 0).otherwise(F.col("v") >= 0).cast("double"))
    return _ends(each.crossJoin(F.broadcast(observed)), [], alpha, F.least(F.lit(1.0), 2 * F.avg(across)).alias("p_value"))


def f1_macro(classes: list) -> tuple[callable, Column]:
    """A metric that isn't a mean of rows: macro F1 over ``classes`` that have rows; (sums of (true, predicted) columns, metric)."""

    def sums(true: str, predicted: str) -> dict[str, Column]:
        is_ = lambda c, k: (F.col(c) == F.lit(k)).cast("double")
        return {f"{x}{i}": v for i, k in enumerate(classes) for x, v in (("t", is_(true, k)), ("p", is_(predicted, k)), ("h", is_(true, k) * is_(predicted, k)))}

    each = [F.when(F.col(f"t{i}") > 0, 2 * F.col(f"h{i}") / (F.col(f"t{i}") + F.col(f"p{i}"))) for i in range(len(classes))]
    total = reduce(lambda x, y: x + y, [F.coalesce(e, F.lit(0.0)) for e in each])
    return sums, total / F.nullif(reduce(lambda x, y: x + y, [e.isNotNull().cast("int") for e in each]), F.lit(0))
