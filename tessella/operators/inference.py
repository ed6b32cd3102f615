"""Resampling, corrections and variance components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.frames import numbered, scanned
from tessella.functions.hashing import seeded_int


def draws(groups: DataFrame, replicates: int, seed: int = 0, unit: str = "unit") -> DataFrame:
    """Bootstrap weights of units: (b, unit, weight), only where a unit is drawn.

    Each replicate draws as many units as there are, with replacement; draw k of replicate b takes
    the unit whose number is a hash of seed, b and k. ``groups`` has a row a unit; units, not rows,
    are drawn, so all rows of a unit move together.
    """
    units = numbered(groups.select(unit).distinct(), [F.col(unit)], "at")
    n = units.count()
    grid = groups.sparkSession.range(replicates * n).select((F.floor(F.col("id") / F.lit(max(n, 1))) + 1).cast("int").alias("b"), (F.col("id") % max(n, 1) + 1).alias("k"))
    taken = grid.select("b", (seeded_int(seed, "b", "k") % n).alias("at")).groupBy("b", "at").agg(F.count(F.lit(1)).alias("weight"))
    return taken.join(units, "at").select("b", unit, "weight")


def drawn_by_unit(groups: DataFrame, replicates: int, seed: int = 0, unit: str = "unit") -> DataFrame:
    """The draws of ``draws`` with a row a unit: (unit, drawn), the replicates that draw it, as often as they do; none of a unit that isn't drawn."""
    units = numbered(groups.select(unit).distinct(), [F.col(unit)], "at")
    n = units.count()
    grid = groups.sparkSession.range(replicates * n).select((F.floor(F.col("id") / F.lit(max(n, 1))) + 1).cast("int").alias("b"), (F.col("id") % max(n, 1) + 1).alias("k"))
    return grid.groupBy((seeded_int(seed, "b", "k") % n).alias("at")).agg(F.collect_list("b").alias("drawn")).join(units, "at").select(unit, "drawn")


def bootstrap_rate(df: DataFrame, unit: str, value: str, groups: list[str], replicates: int = 200, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """Mean of ``value`` by group with a percentile interval from resampled units.

    Rows are summed by unit before they meet the draws, so the work is units times replicates.
    Draws in which a group has no row are dropped.
    """
    sums = df.where(F.col(value).isNotNull()).groupBy(*groups, F.col(unit).alias("unit")).agg(F.sum(F.col(value).cast("double")).alias("s"), F.count(F.lit(1)).alias("c"))
    weighted = draws(df.select(F.col(unit).alias("unit")), replicates, seed).join(sums, "unit")
    each = weighted.groupBy(*groups, "b").agg((F.sum(F.col("s") * F.col("weight")) / F.nullif(F.sum(F.col("c") * F.col("weight")), F.lit(0))).alias("v"))
    interval = each.groupBy(*groups).agg(F.expr(f"percentile(v, {alpha / 2})").alias("low"), F.expr(f"percentile(v, {1 - alpha / 2})").alias("high"), F.count("v").alias("n_draws"))
    point = sums.groupBy(*groups).agg((F.sum("s") / F.sum("c")).alias("estimate"), F.count(F.lit(1)).alias("n_units"))
    return point.join(interval, groups, "left")


def paired_difference(df: DataFrame, unit: str, value: str, side: str, a: str, b: str, replicates: int = 200, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """Difference of two sides' means with the same draws for both; p is twice the share of draws across zero, at most 1.

    An observed difference above zero counts draws at or below zero, any other those at or above.
    """
    sums = df.where(F.col(value).isNotNull() & F.col(side).isin(a, b)).groupBy(F.col(unit).alias("unit")).agg(*[F.sum(F.when(F.col(side) == s, x)).alias(f"{n}{k}") for s, n in ((a, "a"), (b, "b")) for k, x in (("s", F.col(value).cast("double")), ("c", F.lit(1)))])
    rate = lambda n, w: F.sum(F.coalesce(f"{n}s", F.lit(0.0)) * w) / F.nullif(F.sum(F.coalesce(f"{n}c", F.lit(0)) * w), F.lit(0))
    observed = sums.agg((rate("a", F.lit(1)) - rate("b", F.lit(1))).alias("difference"), F.count(F.lit(1)).alias("n_units"))
    each = draws(df.select(F.col(unit).alias("unit")), replicates, seed).join(sums, "unit").groupBy("b").agg((rate("a", F.col("weight")) - rate("b", F.col("weight"))).alias("d"))
    each = each.where("d is not null").crossJoin(F.broadcast(observed))  # one row
    across = F.when(F.col("difference") > 0, F.col("d") <= 0).otherwise(F.col("d") >= 0)
    return each.groupBy("difference", "n_units").agg(F.expr(f"percentile(d, {alpha / 2})").alias("low"), F.expr(f"percentile(d, {1 - alpha / 2})").alias("high"), F.least(F.lit(1.0), 2 * F.avg(across.cast("double"))).alias("p_value"))


def stepped(df: DataFrame, family: list[str], p: str, name: str, alpha: float, raw, extreme: str) -> DataFrame:
    """Adjusted p by a running extreme of ``raw`` (p, rank, number of known p); an undefined p stays with a note and doesn't count. A family may be of any size."""
    known, order = F.col(p).isNotNull(), [F.col(p).asc_nulls_last(), F.col(name)]
    rows = scanned(df, family, order, rank="r_", totals={"m_": F.when(known, 1)})
    value = F.when(known, F.least(F.lit(1.0), raw(F.col(p), F.col("r_"), F.col("m_"))))
    rows = scanned(rows.drop("adjusted"), family, order, **{extreme: {"adjusted": value}})
    adjusted = F.when(known, F.col("adjusted"))
    return rows.select(*df.columns, adjusted.alias("adjusted"), (known & F.coalesce(adjusted <= alpha, F.lit(False))).alias("rejected"), F.when(~known, "undefined_p").alias("note"))


def holm(df: DataFrame, family: list[str], p: str = "p", name: str = "name", alpha: float = 0.05) -> DataFrame:
    """Holm step-down: adjusted p and rejected; an undefined p stays with a note and doesn't count."""
    return stepped(df, family, p, name, alpha, lambda x, r, m: x * (m - r + 1), "highest")


def benjamini_hochberg(df: DataFrame, family: list[str], p: str = "p", name: str = "name", alpha: float = 0.05) -> DataFrame:
    """Benjamini-Hochberg step-up: adjusted p and rejected."""
    return stepped(df, family, p, name, alpha, lambda x, r, m: x * m / r, "lowest_on")


def variance_components(df: DataFrame, groups: list[str], subset: str = "subset_id", value: str = "y", centre: list[str] | None = None) -> DataFrame:
    """One-way random effects: mean squares, between and within variance, standard deviations and ICC.

    ``between`` may be negative and is reported so; only its root and the ICC are floored at 0.
    ``centre`` takes the means of such groups off first. Designs are balanced or nearly: n is the
    mean number of repeats.
    """
    rows = df.where(F.col(value).isNotNull())
    if centre:
        rows = scanned(rows, [*groups, *centre], [F.col(subset)], totals={"s_": F.col(value).cast("double"), "c_": F.lit(1)})
        rows = rows.withColumn(value, F.col(value) - F.col("s_") / F.col("c_"))
    cells = rows.groupBy(*groups, subset).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    a = cells.groupBy(*groups).agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("total"), F.sum(F.col("n") * F.col("v")).alias("ssw"), (F.sum(F.col("n") * F.col("m") * F.col("m")) - F.pow(F.sum(F.col("n") * F.col("m")), F.lit(2)) / F.sum("n")).alias("ssb"))
    a = a.withColumns({"ms_between": F.col("ssb") / F.nullif(F.col("k") - 1, F.lit(0)), "ms_within": F.col("ssw") / F.nullif(F.col("total") - F.col("k"), F.lit(0))})
    a = a.withColumn("between", (F.col("ms_between") - F.col("ms_within")) / (F.col("total") / F.col("k")))
    up = F.greatest("between", F.lit(0.0))
    return a.select(*groups, F.col("k").alias("n_subsets"), "ms_between", "ms_within", "between", F.sqrt(up).alias("sd_between"), F.sqrt("ms_within").alias("sd_within"), (up / F.nullif(up + F.col("ms_within"), F.lit(0.0))).alias("icc"))


def reliability_table(components: DataFrame, most: int = 10, icc: str = "icc") -> DataFrame:
    """Spearman-Brown reliability and the correlation ceiling of 1 to ``most`` repeats, and a verdict."""
    rows = components.withColumn("repeats", F.explode(F.sequence(F.lit(1), F.lit(most))))
    k = F.col("repeats")
    reliability = k * F.col(icc) / F.nullif(1 + (k - 1) * F.col(icc), F.lit(0.0))
    verdict = F.when(reliability.isNull(), "undefined").when(reliability >= 0.8, "reliable").when(reliability >= 0.5, "usable").otherwise("noise")
    return rows.withColumns({"reliability": reliability, "ceiling": F.sqrt(reliability), "verdict": verdict})


def repeats_needed(icc, target: float = 0.8):
    """Repeats that reach a reliability, rounded up; NULL where the ICC is 0."""
    return F.ceil(F.lit(target) * (1 - icc) / F.nullif(icc * (1 - target), F.lit(0.0)) - 1e-9)


def wilson(hits, n, z: float = 1.959963984540054):
    """Wilson interval (low, high) of a share."""
    n = n.cast("double")
    p = hits / F.nullif(n, F.lit(0.0))
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z / (1 + z * z / n) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.when(n > 0, F.greatest(F.lit(0.0), middle - half)), F.when(n > 0, F.least(F.lit(1.0), middle + half))
