"""Normalisation, floors, thresholds and selection policies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.frames import largest, quantile_row, quantiles, scanned
from tessella.functions.hashing import seeded
from tessella.operators.labels import require_empty


def fail_closed(pool: DataFrame, flags: DataFrame, key: str = "image_id") -> DataFrame:
    """``pool`` with unsafe and reason: a missing row or a NULL flag is unsafe; an invalid image before a duplicate."""
    valid, duplicate = F.coalesce("valid", F.lit(False)), F.coalesce("duplicate", F.lit(True))
    rows = pool.join(flags.select(key, "valid", "duplicate"), key, "left")
    reason = F.when(~valid, "invalid").when(duplicate, "near_duplicate")
    return rows.select(*pool.columns, (~valid | duplicate).alias("unsafe"), reason.alias("reason"))


def fit_features(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row of statistics: median for gaps, mean and population deviation after filling; infinite counts as missing, no spread as 1."""
    finite = lambda c: F.when(F.abs(F.col(c)) < float("inf"), F.col(c).cast("double"))  # noqa: E731  also drops NaN
    medians = quantile_row(df, {f"{c}_median": (finite(c), 0.5) for c in columns})
    medians = medians.select(*[F.coalesce(m, F.lit(0.0)).alias(m) for m in medians.columns])
    filled = df.crossJoin(F.broadcast(medians)).select(*[F.coalesce(finite(c), F.col(f"{c}_median")).alias(c) for c in columns])  # one row
    moments = filled.agg(*[F.avg(c).alias(f"{c}_mean") for c in columns], *[F.when(F.min(c) < F.max(c), F.stddev_pop(c)).otherwise(1.0).alias(f"{c}_std") for c in columns])
    return medians.crossJoin(F.broadcast(moments))


def apply_features(df: DataFrame, stats: DataFrame, columns: list[str]) -> DataFrame:
    """Fill and standardise with frozen statistics (one row), never fitting again."""
    rows = df.crossJoin(F.broadcast(stats))
    finite = lambda c: F.when(F.abs(F.col(c)) < float("inf"), F.col(c).cast("double"))
    return rows.withColumns({c: (F.coalesce(finite(c), F.col(f"{c}_median")) - F.col(f"{c}_mean")) / F.col(f"{c}_std") for c in columns}).drop(*stats.columns)


def normalised(df: DataFrame, value: str, by: list[str] = (), constant: float = 0.5) -> DataFrame:
    """``df`` with normalised and degenerate, from the extremes joined back as one row a group."""
    ends = df.groupBy(*by).agg(F.min(value).alias("low_"), F.max(value).alias("high_"))
    rows = df.join(ends, list(by)) if by else df.crossJoin(F.broadcast(ends))
    flat = F.col("high_") <= F.col("low_")
    return rows.withColumns({"normalised": F.when(F.col(value).isNull(), None).when(flat, constant).otherwise((F.col(value) - F.col("low_")) / F.nullif(F.col("high_") - F.col("low_"), F.lit(0.0))), "degenerate": flat}).drop("low_", "high_")


def winsorised(df: DataFrame, value: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """``df`` with clipped and standardised targets."""
    q = quantile_row(df, {"lo_": (value, low), "hi_": (value, high)})
    rows = df.crossJoin(F.broadcast(q)).withColumn("clipped", F.greatest("lo_", F.least("hi_", F.col(value))))
    m = rows.agg(F.avg("clipped").alias("m_"), F.stddev_pop("clipped").alias("s_"))
    return rows.crossJoin(F.broadcast(m)).withColumn("standardised", F.coalesce((F.col("clipped") - F.col("m_")) / F.nullif("s_", F.lit(0.0)), F.lit(0.0))).drop("lo_", "hi_", "m_", "s_")


def composite(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted mean of min-max columns, constant ones counting 0."""
    ends = df.agg(*[f(c).alias(f"{c}_{n}") for c in weights for n, f in (("low", F.min), ("high", F.max))])
    rows = df.crossJoin(F.broadcast(ends))
    scaled = [w * F.coalesce((F.col(c) - F.col(f"{c}_low")) / F.nullif(F.col(f"{c}_high") - F.col(f"{c}_low"), F.lit(0)), F.lit(0.0)) for c, w in weights.items()]
    total = reduce(lambda a, b: a + b, scaled) / float(sum(weights.values()))
    return rows.withColumn("composite", total).drop(*ends.columns)


def weight_grid(spark, names: list[str], levels: tuple[float, ...] = (0.0, 0.5, 1.0)) -> DataFrame:
    """All level vectors but zero, baselines first: equal weights, single features, all but one, then the rest in order."""
    rows = spark.range(1).select()
    for n in names:
        rows = rows.withColumn(n, F.explode(F.array(*[F.lit(x) for x in levels])))
    total, ones = reduce(lambda a, b: a + b, [F.col(n) for n in names]), reduce(lambda a, b: a + b, [(F.col(n) == 1.0).cast("int") for n in names])
    k = len(names)
    kind = F.when(ones == k, 0).when((ones == 1) & (total == 1.0), 1).when((ones == k - 1) & (total == k - 1), 2).otherwise(3)
    return rows.where(total > 0).withColumn("priority", kind).withColumn("position", F.row_number().over(Window.orderBy("priority", *[F.col(n).desc() for n in names])))


def soft_gate(score: Column, threshold: float, temperature: float) -> Column:
    """A logistic step at the threshold."""
    return 1 / (1 + F.exp(-(score - threshold) / temperature))


def pooled_floor(df: DataFrame, p: float, score: str = "score") -> DataFrame:
    """Rows at or above one percentile of all scores."""
    cut = quantile_row(df, {"floor": (score, p)})
    return df.crossJoin(F.broadcast(cut)).where(F.col(score) >= F.col("floor"))


def class_floor(df: DataFrame, p: float, score: str = "score", by: str = "dx") -> DataFrame:
    """Rows at or above their own class's percentile."""
    return df.join(quantiles(df, score, [p], [by]).select(by, F.col("v").alias("floor")), by).where(F.col(score) >= F.col("floor"))


def top_k(df: DataFrame, k: Column | int, score: str = "score", by: str | list[str] = "dx", key: str = "image_id", most: int | None = None) -> DataFrame:
    """The k best of each class by score, then key; k may be a column (Spark cuts classes before it shuffles them only for a number, so ranks are scanned then; ``most`` as there)."""
    by, order = [by] if isinstance(by, str) else list(by), [F.col(score).desc_nulls_last(), F.col(key)]
    if isinstance(k, int):
        return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
    return scanned(df, by, order, rank="rank", most=most).withColumn("rank", F.col("rank").cast("int")).where(F.col("rank") <= k)


def top_share(df: DataFrame, share: float, score: str = "score", by: str = "dx", key: str = "image_id") -> DataFrame:
    """The best fraction of each class, at least one, rounded half to even."""
    n = df.groupBy(by).agg(F.greatest(F.lit(1), F.bround(F.count(F.lit(1)) * F.lit(share), 0)).cast("int").alias("k_"))
    return top_k(df.join(n, by), F.col("k_"), score, by, key).drop("k_")


def ratio_targets(counts: DataFrame, ratio: float, least: int, most: int) -> DataFrame:
    """Class targets: real count times a ratio, rounded half to even, clipped."""
    return counts.withColumn("target", F.least(F.lit(most), F.greatest(F.lit(least), F.bround(F.col("n") * F.lit(ratio), 0))).cast("bigint"))


def fill_targets(counts: DataFrame, up_to: int) -> DataFrame:
    return counts.withColumn("target", F.greatest(F.lit(0), F.lit(up_to) - F.col("n")).cast("bigint"))


def rarity_percentiles(counts: DataFrame, base: float = 50.0, least: float = 10.0) -> DataFrame:
    """Percentile of each class's cut: the rarest class gets ``least``, the most common ``base``; a class without real rows ``base``."""
    ends = counts.where("n > 0").agg(F.min("n").alias("low_"), F.max("n").alias("high_"))
    ratio = (F.col("n") - F.col("low_")) / F.nullif(F.col("high_") - F.col("low_"), F.lit(0))
    p = F.when(F.coalesce(F.col("n"), F.lit(0)) <= 0, base).otherwise(F.coalesce(least + (base - least) * ratio, F.lit(base)))
    return counts.crossJoin(F.broadcast(ends)).withColumn("percentile", p).drop("low_", "high_")


def group_percentiles(df: DataFrame, percentiles: DataFrame, score: str = "score", by: str = "dx") -> DataFrame:
    """Linear percentile of each class's scores, at a rank that differs by class (0 to 100)."""
    rows = df.where(F.col(score).isNotNull()).join(percentiles.select(by, "percentile"), by)
    rows = scanned(rows, [by], [F.col(score)], rank="r_", totals={"n_": F.lit(1)}).withColumn("r_", F.col("r_") - 1)
    h = (F.col("n_") - 1) * F.col("percentile") / 100
    low = F.max(F.when(F.col("r_") == F.floor(h), F.col(score)))
    high = F.max(F.when(F.col("r_") == F.ceil(h), F.col(score)))
    part = F.first(h - F.floor(h))
    return rows.groupBy(by).agg((low + (high - low) * part).alias("threshold"))


def threshold_search(df: DataFrame, targets: DataFrame, weight: float = 0.5, steps: int = 100, ties: str = "higher", score: str = "score", by: str = "dx") -> DataFrame:
    """Best of ``steps + 1`` cuts for each class: mean of the kept minus weight times the relative miss of the target.

    An empty selection is worth -1. Equal objectives take the higher or the lower cut. Scores are
    first summed by the highest cut that they pass, so classes, not rows, meet the grid.
    """
    bin_of = F.least(F.floor(F.col(score) * steps + 1e-9), F.lit(steps))
    bins = df.where(F.col(score).between(0, 1)).groupBy(by, bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.sum(score).alias("s"))
    cuts = bins.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("bin").cast("int")))).groupBy(by, "k").agg(F.sum("c").alias("kept"), F.sum("s").alias("total"))
    grid = targets.select(by, "target").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(steps)))).join(cuts, [by, "k"], "left")
    kept = F.coalesce("kept", F.lit(0))
    goal = F.when(kept == 0, -1.0).otherwise(F.round(F.col("total") / kept - weight * F.abs(kept - F.col("target")) / F.greatest(F.col("target"), F.lit(1)), 12))
    grid = grid.select(by, "k", kept.alias("kept"), goal.alias("objective"))
    order = F.struct("objective", F.col("k") if ties == "higher" else -F.col("k"))
    best = grid.groupBy(by).agg(F.max_by(F.struct("k", "kept", "objective"), order).alias("b"))
    return best.select(by, (F.col("b.k") / float(steps)).alias("threshold"), F.col("b.kept").alias("kept"), F.col("b.objective").alias("objective"))


def keep_at_least(df: DataFrame, cuts: DataFrame, least: int, score: str = "score", by: str = "dx", key: str = "image_id", most: int | None = None) -> DataFrame:
    """Cuts lowered where they must be to admit the ``least``-th best of the class (or its last, if it has fewer)."""
    rows = scanned(df, [by], [F.col(score).desc(), F.col(key)], rank="r_", totals={"n_": F.lit(1)}, most=most)
    best = rows.groupBy(by).agg(F.max(F.when(F.col("r_") == F.least(F.lit(least), F.col("n_")), F.col(score))).alias("admit_"))
    return cuts.join(best, by, "left").withColumn("threshold", F.coalesce(F.least("threshold", "admit_"), F.col("threshold"))).drop("admit_")


def above_cut(df: DataFrame, cuts: DataFrame, score: str = "score", by: str = "dx", missing: float = 1.0) -> DataFrame:
    """Rows at or above their class's cut; a class without one has ``missing``."""
    return df.join(cuts.select(by, "threshold"), by, "left").where(F.col(score) >= F.coalesce("threshold", F.lit(missing))).drop("threshold")


def class_context(df: DataFrame, counts: DataFrame, targets: DataFrame, score: str = "score", by: str = "dx") -> DataFrame:
    """Eight features a class: prevalence, log1p of candidates, mean, deviation, quartiles, target by candidates."""
    stats = df.groupBy(by).agg(F.count(score).alias("c"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"), *[F.percentile(score, F.lit(q)).alias(f"q{int(100 * q)}") for q in (0.25, 0.5, 0.75)])
    total = counts.agg(F.sum("n").alias("all_"))
    rows = counts.crossJoin(F.broadcast(total)).join(targets.select(by, "target"), by, "left").join(stats, by, "left").na.fill(0)
    return rows.select(by, (F.col("n") / F.nullif("all_", F.lit(0))).alias("prevalence"), F.log1p("c").alias("log_candidates"), "mean", "std", "q25", "q50", "q75", (F.col("target") / F.greatest("c", F.lit(1))).alias("target_ratio"))


def select_adaptive(pool: DataFrame, flags: DataFrame, counts: DataFrame, floor: float = 0.25, ratio: float = 0.5, least_target: int = 50, most_target: int = 1000, weight: float = 0.5, least_kept: int = 5, cap: int | None = None) -> DataFrame:
    """The full first policy: safety, pooled floor, class cut by search, class minimum, cap.

    Order matters and is this one. Returns the selected rows with their scores scaled to the safe pool.
    """
    safe = fail_closed(pool, flags).where("not unsafe").drop("unsafe", "reason")
    scaled = normalised(safe, "score").drop("degenerate")
    above = pooled_floor(scaled, floor, "normalised").drop("floor")
    targets = ratio_targets(counts, ratio, least_target, most_target)
    most = largest(pool, ["dx"])
    cuts = keep_at_least(above, threshold_search(above, targets, weight, score="normalised"), least_kept, "normalised", most=most)
    chosen = above_cut(above, cuts, "normalised").join(targets.select("dx", "target"), "dx")
    return top_k(chosen, F.col("target") if cap is None else F.least(F.col("target"), F.lit(cap)), "normalised", most=most).drop("target")


def select_filled(pool: DataFrame, flags: DataFrame, counts: DataFrame, floor: float = 0.25, up_to: int = 300) -> DataFrame:
    """The second policy: safety, floor of the own class, the best up to what the class lacks."""
    safe = fail_closed(pool, flags).where("not unsafe").drop("unsafe", "reason")
    rows = class_floor(safe, floor).join(fill_targets(counts, up_to).select("dx", "target"), "dx")
    return top_k(rows, F.col("target"), most=largest(pool, ["dx"]))


def random_matched(pool: DataFrame, targets: DataFrame, seed: int, by: str = "dx", key: str = "image_id") -> DataFrame:
    """As many rows of each class as ``targets`` says, without replacement, in seeded hash order."""
    rows = scanned(pool.join(targets.select(by, "target"), by), [by], [seeded(seed, key), F.col(key)], rank="rank", most=largest(pool, [by]))
    return rows.withColumn("rank", F.col("rank").cast("int")).where(F.col("rank") <= F.col("target"))


def select_with_reasons(pool: DataFrame, flags: DataFrame, floor: float = 0.25, quota: int = 40, bonus: float = 0.05) -> DataFrame:
    """Pooled floor, near duplicates out, a bonus for the middle band, a quota a label; each row with its reason."""
    rows = pool.join(flags.select("image_id", "duplicate"), "image_id", "left")
    cut = quantile_row(pool, {"floor": ("score", floor)})
    rows = rows.crossJoin(F.broadcast(cut)).withColumn("adjusted", F.col("score") + F.when(F.col("score").between(0.4, 0.6), bonus).otherwise(0.0))
    first = F.when(F.col("score") < F.col("floor"), "below_floor").when(F.coalesce("duplicate", F.lit(False)), "near_duplicate")
    rows = rows.withColumn("reason", first)
    rows = scanned(rows.withColumn("free_", F.col("reason").isNull()), ["dx", "free_"], [F.col("adjusted").desc(), F.col("image_id")], rank="rank_")
    return rows.select("image_id", "dx", "adjusted", F.coalesce("reason", F.when(F.col("rank_") > quota, "over_quota"), F.lit("selected")).alias("reason"))


def hard_grid(candidates: DataFrame, grid: list[float], weight: float, most: int, least: int = 0, by: str = "context_id", key: str = "image_id", score: str = "score", utility: str = "utility") -> DataFrame:
    """Thresholds of a grid for each context: how many candidates they select (``most`` at most, the best), their predicted utility (the mean of what is predicted for each), objective and rank.

    The objective is the utility less ``weight`` times the selected share; a threshold that selects
    nothing isn't a choice, and a context without any raises. Equal objectives go to the lower
    threshold. Candidates meet the grid binned by the highest threshold that they reach.
    """
    ranked = scanned(candidates.select(by, score, key, F.col(utility).alias("u_")), [by], [F.col(score).desc(), F.col(key)], rank="selected", sums={"s_": F.col("u_").cast("double"), "c_": F.when(F.col("u_").isNotNull(), 1)})
    ranked = ranked.select(by, score, "selected", (F.col("s_") / F.nullif(F.col("c_"), F.lit(0))).alias("utility"))
    at = F.size(F.filter(F.array(*[F.lit(float(t)) for t in sorted(grid)]), lambda t: t <= F.col(score)))  # thresholds that it reaches
    reached = candidates.groupBy(by, at.alias("at")).agg(F.count(F.lit(1)).alias("n"))
    levels = reached.select(by).distinct().withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(len(grid)))))
    upto = Window.partitionBy(by).orderBy(F.col("level").desc())
    counts = levels.join(reached.select(by, F.col("at").alias("level"), "n"), [by, "level"], "left").withColumn("reached", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    sizes = candidates.groupBy(by).agg(F.count(F.lit(1)).alias("size"))
    threshold = F.element_at(F.array(*[F.lit(float(t)) for t in sorted(grid)]), F.col("level"))
    rows = counts.where("reached > 0").select(by, threshold.alias("threshold"), F.least("reached", F.lit(most)).alias("selected"))
    require_empty(sizes.join(rows, by, "left_anti").select(by), "contexts in which every threshold selects nothing")
    rows = rows.join(ranked.where(F.col("selected") <= most).drop(score), [by, "selected"]).join(sizes, by)
    rows = rows.withColumn("objective", F.col("utility") - weight * F.col("selected") / F.col("size"))
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.round("objective", 12).desc(), "threshold"))
    return rows.select(by, "threshold", "selected", "utility", (F.col("selected") < least).alias("below_least"), place.cast("long").alias("rank"))


#: Policies that can win, in the order in which thresholds are laid over each other.
POLICIES = ("baseline", "pooled_half", "rarity_percentile", "measured_best", "network")


def policy_thresholds(pool: DataFrame, policy: str, layers: dict[str, DataFrame], floor: int, score: str = "score", by: str = "dx", key: str = "image_id") -> DataFrame:
    """(by, threshold) of a policy: each class's median, rarity-scaled percentiles lowered to admit ``floor`` rows a class, or the baseline with measured ones and the network's laid over it where they aren't null."""
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy}")
    if policy == "pooled_half":
        return quantiles(pool, score, [0.5], [by]).select(by, F.col("v").alias("threshold"))
    if policy == "rarity_percentile":
        counts = pool.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
        cuts = group_percentiles(pool, rarity_percentiles(counts), score, by).select(by, "threshold")
        last = top_k(pool, floor, score, by, key).groupBy(by).agg(F.min(score).alias("last"))
        return cuts.join(last, by).select(by, F.least("threshold", "last").alias("threshold"))
    out = layers["baseline"].select(by, "threshold")
    for name in ("measured_best", "network")[: POLICIES.index(policy) - 2 if policy != "baseline" else 0]:
        out = out.join(layers[name].select(by, F.col("threshold").alias("next")), by, "left").select(by, F.coalesce("next", "threshold").alias("threshold"))
    return out


def finalise(pool: DataFrame, policy: str, layers: dict[str, DataFrame], floor: int = 1, score: str = "score", by: str = "dx", key: str = "image_id") -> DataFrame:
    """(key, score, policy) that the winning policy's thresholds select; ValueError where that is nothing."""
    cuts = policy_thresholds(pool, policy, layers, floor, score, by, key)
    rows = pool.join(cuts, by).groupBy(key).agg(F.max(score).alias(score), F.min("threshold").alias("cut")).where(F.col(score) >= F.col("cut"))
    if rows.isEmpty():
        raise ValueError(f"{policy} selects nothing")
    return rows.select(key, score, F.lit(policy).alias("policy"))


def class_weights(df: DataFrame, by: str) -> DataFrame:
    """Inverse frequencies with mean 1."""
    n = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.avg(1 / F.col("n")).alias("m_")))).select(by, (1 / F.col("n") / F.col("m_")).alias("weight"))


def rarity_quotas(counts: DataFrame, base: int, exponent: float, least: int, most: int) -> DataFrame:
    """Quota of each class: base times (median count by count) to a power, clipped, rounded half to even."""
    m = counts.where("n > 0").agg(F.percentile("n", F.lit(0.5)).alias("m_"))
    quota = F.bround(base * F.pow(F.col("m_") / F.col("n"), F.lit(exponent)), 0)
    return counts.where("n > 0").crossJoin(F.broadcast(m)).select("dx", "n", F.least(F.lit(most), F.greatest(F.lit(least), quota)).cast("bigint").alias("quota"))


def quotas_upper_median(counts: DataFrame, base: int, least: int, most: int) -> DataFrame:
    """Quota by prevalence, against the upper of the two middle values."""
    m = counts.agg(F.sort_array(F.collect_list("n")).alias("v")).select(F.get("v", F.floor(F.size("v") / 2).cast("int")).alias("m_"))  # a value a class
    return counts.crossJoin(F.broadcast(m)).select("dx", "n", F.least(F.lit(most), F.greatest(F.lit(least), F.bround(base * F.col("m_") / F.greatest("n", F.lit(1)), 0))).cast("bigint").alias("quota"))


def adaptive_report(pool: DataFrame, flags: DataFrame, counts: DataFrame, floor: float = 0.25, ratio: float = 0.5, least_target: int = 50, most_target: int = 1000, **options) -> DataFrame:
    """What ``select_adaptive`` leaves of each class at each step: pool, safe, above_floor, selected, target, short of it, and whether the class is eliminated."""
    safe = fail_closed(pool, flags).where("not unsafe").drop("unsafe", "reason")
    above = pooled_floor(safe, floor).drop("floor")
    chosen = select_adaptive(pool, flags, counts, floor, ratio, least_target, most_target, **options)
    rows = ratio_targets(counts, ratio, least_target, most_target).select("dx", "target")
    for name, df in (("pool", pool), ("safe", safe), ("above_floor", above), ("selected", chosen)):
        rows = rows.join(df.groupBy("dx").agg(F.count(F.lit(1)).alias(name)), "dx", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return rows.withColumns({"short": F.greatest(F.col("target") - F.col("selected"), F.lit(0)), "eliminated": F.col("selected") == 0})
