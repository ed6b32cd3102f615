"""Subset designs, data values from measured subsets, and threshold evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def banzhaf(subsets: DataFrame, members: DataFrame, least: int = 1) -> DataFrame:
    """Mean utility of the subsets with an image less that of those without; NULL below ``least`` on either side.

    The side without comes from the totals, so only memberships are joined.
    """
    total = subsets.agg(F.sum("utility").alias("all_"), F.count(F.lit(1)).alias("n_"))
    own = members.join(subsets, "subset_id").groupBy("image_id").agg(F.sum("utility").alias("s_"), F.count(F.lit(1)).alias("exposures"))
    rows = own.crossJoin(F.broadcast(total))  # one row
    rest = F.col("n_") - F.col("exposures")
    value = F.col("s_") / F.col("exposures") - (F.col("all_") - F.col("s_")) / F.nullif(rest, F.lit(0))
    return rows.select("image_id", "exposures", F.when((F.col("exposures") >= least) & (rest >= least), value).alias("value"))


def under_exposed(pool: DataFrame, members: DataFrame, least: int) -> DataFrame:
    """Pool images in fewer than ``least`` subsets, never seen ones among them."""
    n = members.groupBy("image_id").agg(F.count(F.lit(1)).alias("exposures"))
    return pool.select("image_id").join(n, "image_id", "left").withColumn("exposures", F.coalesce("exposures", F.lit(0)).cast("bigint")).where(F.col("exposures") < least)


def marginal_targets(outputs: DataFrame) -> DataFrame:
    """Leave-one-out targets: (u_full - u_without) times (n - 1), averaged over subsets; rows (subset_id, image_id, u_full, u_without, n)."""
    return outputs.groupBy("image_id").agg(F.avg((F.col("u_full") - F.col("u_without")) * (F.col("n") - 1)).alias("target"), F.count(F.lit(1)).alias("n_subsets"))


def pooled_features(members: DataFrame, features: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and population deviation of each feature over a subset's images."""
    rows = members.join(features, "image_id")
    return rows.groupBy("subset_id").agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_pop))])


def best_measured(measurements: DataFrame) -> DataFrame:
    """Best threshold of each context by measured utility; the first candidate wins ties."""
    return measurements.groupBy("context_id").agg(F.max_by(F.struct("threshold", "utility"), F.struct("utility", -F.col("position"))).alias("b")).select("context_id", "b.threshold", "b.utility")


def least_ranked(measurements: DataFrame) -> DataFrame:
    """Threshold of the lowest predicted rank of each context."""
    return measurements.groupBy("context_id").agg(F.min_by("threshold", F.struct("rank", "position")).alias("threshold"))


def ranked_in_context(measurements: DataFrame) -> DataFrame:
    over = Window.partitionBy("context_id").orderBy(F.col("utility").desc(), "position")
    return measurements.withColumn("rank", F.row_number().over(over))


def diversified(measurements: DataFrame, k: int = 3, spaced: int = 5) -> DataFrame:
    """Candidates to verify with every reason: best, spaced over the ranking, ends of the threshold range, half the pool."""
    rows = ranked_in_context(measurements)
    over = Window.partitionBy("context_id")
    n = F.count(F.lit(1)).over(over)
    step = F.greatest(F.lit(1), F.floor((n - 1) / (spaced - 1)).cast("int"))
    rows = rows.withColumns({"n_": n, "step_": step, "lo_": F.min("threshold").over(over), "hi_": F.max("threshold").over(over), "half_": F.row_number().over(over.orderBy(F.abs(F.col("selected") - F.col("pool_size") / 2), "position"))})
    reasons = F.filter(F.array(F.when(F.col("rank") <= k, "top"), F.when((F.col("rank") - 1) % F.col("step_") == 0, "spaced"), F.when((F.col("threshold") == F.col("lo_")) | (F.col("threshold") == F.col("hi_")), "boundary"), F.when(F.col("half_") == 1, "half_pool")), lambda x: x.isNotNull())
    return rows.withColumn("reasons", F.array_join(reasons, ",")).where("reasons <> ''").select("context_id", "threshold", "rank", "reasons")


def regret(measurements: DataFrame, predicted: DataFrame) -> DataFrame:
    """Threshold error and utility lost by a predicted threshold against the best measured one of its context."""
    best = best_measured(measurements).select("context_id", F.col("threshold").alias("best_threshold"), F.col("utility").alias("best_utility"))
    got = measurements.join(predicted.select("context_id", F.col("threshold").alias("p_")), "context_id").where("threshold = p_").select("context_id", "threshold", "utility")
    return got.join(best, "context_id").select("context_id", F.abs(F.col("threshold") - F.col("best_threshold")).alias("threshold_error"), (F.col("best_utility") - F.col("utility")).alias("regret"))


def choose_policy(runs: DataFrame, needed: int, band: float, order: tuple[str, ...] = ("percentile", "grid", "network")) -> DataFrame:
    """Of policies with all seeds, the simplest whose mean utility is within the noise band of the best."""
    m = runs.groupBy("policy").agg(F.avg("utility").alias("mean_utility"), F.count_distinct("seed").alias("n_seeds")).where(F.col("n_seeds") >= needed)
    best = m.agg(F.max("mean_utility").alias("b_"))
    place = F.array_position(F.array(*[F.lit(p) for p in order]), F.col("policy"))
    rows = m.crossJoin(F.broadcast(best)).where(F.col("mean_utility") >= F.col("b_") - band).withColumn("place_", place)
    return rows.orderBy("place_", "policy").limit(1).select("policy", "mean_utility")


def layered_thresholds(network: DataFrame, measured: DataFrame, baseline: DataFrame, by: str = "dx") -> DataFrame:
    """Network over measured best over baseline, for each class of the baseline."""
    rows = baseline.select(by, F.col("threshold").alias("c_")).join(measured.select(by, F.col("threshold").alias("b_")), by, "left").join(network.select(by, F.col("threshold").alias("a_")), by, "left")
    origin = F.when(F.col("a_").isNotNull(), "network").when(F.col("b_").isNotNull(), "measured").otherwise("baseline")
    return rows.select(by, F.coalesce("a_", "b_", "c_").alias("threshold"), origin.alias("origin"))
