"""Go or no-go checks of signals, and the decision."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.frames import numbered, scanned, settled
from tessella.operators.labels import refuse, require_empty
from tessella.operators.metrics import spearman

RAW_PREFIXES = ("explainability_raw", "explainability_focus", "explainability_peripheral")


def admitted_columns(configured: list[str], owner: dict[str, str], survivors: set[str]) -> list[str]:
    """Configured feature columns of surviving signals, in order; a column without an owner, or none left, raises."""
    lacking = [c for c in configured if c not in owner]
    if lacking:
        raise ValueError(f"columns without a signal: {lacking}")
    out = [c for c in configured if owner[c] in survivors]
    if not out:
        raise ValueError("no feature of a surviving signal")
    return out


def admitted(configured: DataFrame, survivors: DataFrame, place: str = "place", feature: str = "feature", signal: str = "signal") -> DataFrame:
    """(place, feature) of configured features (place, feature, signal) whose signal survives, numbered from 0 in their order; Refused names all without a signal, ValueError if none is left."""
    refuse(configured.where(F.col(signal).isNull()).select(feature), "features without a signal")
    out = numbered(configured.join(survivors.select(signal).distinct(), signal, "left_semi").select(place, feature), [place, feature], "at_")
    if out.isEmpty():
        raise ValueError("no feature of a surviving signal")
    return out.select(F.col("at_").alias(place), feature)


def contributing_signals(columns: list[str], owner: dict[str, str]) -> list[str]:
    """The signals that feature columns belong to, sorted; a column without an owner raises."""
    return sorted({owner[c] for c in columns})


#: Splits that reference statistics may come from.
PERMITTED = ("train", "validation", "selection")


def calibration_faults(df: DataFrame, calibrated: str = "calibrated", scientific: str = "scientific", split: str = "reference_split", permitted: tuple[str, ...] = PERMITTED) -> DataFrame:
    """(fault, n) of rows that keep a score from being a selection feature: not calibrated, by an untrained model, or against a split that isn't permitted; a null is a fault."""
    wrong = {"not_calibrated": ~F.coalesce(calibrated, F.lit(False)), "not_scientific": ~F.coalesce(scientific, F.lit(False)), "split_not_permitted": ~F.coalesce(F.col(split).isin(*permitted), F.lit(False))}
    counts = df.agg(*[F.count_if(w).alias(k) for k, w in wrong.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("fault"), F.col(k).alias("n")) for k in wrong])).alias("e")).select("e.*").where("n > 0")


def pilot_checks(rows: DataFrame, planned: int, least_valid: float, most_uniform: float, most_rejected: float, blank: float) -> DataFrame:
    """One row about pilot outputs (status, valid, contrast): counts, shares and whether they pass.

    Outputs that geometry rejects have a limit of their own; the valid share is of the others.
    """
    good = (F.col("status") == "accepted") & F.col("valid")
    n = rows.agg(F.count_if(F.col("status") == "geometry_rejected").alias("rejected"), F.count_if(good).alias("valid"), F.count_if(good & (F.col("contrast") < blank)).alias("near_uniform"))
    share = lambda a, b, empty: F.when(b > 0, F.col(a) / F.nullif(b, F.lit(0))).otherwise(F.lit(empty))
    total = F.lit(planned)
    n = n.withColumns({"valid_share": share("valid", total - F.col("rejected"), 0.0), "rejected_share": share("rejected", total, 1.0), "uniform_share": share("near_uniform", total, 1.0)})
    return n.withColumn("passed", (F.col("valid_share") >= least_valid) & (F.col("uniform_share") <= most_uniform) & (F.col("rejected_share") <= most_rejected))


def raw(name: str) -> Column:
    """Whether a feature is a raw statistic by its name."""
    return reduce(lambda a, b: a | b, [F.col(name).startswith(p) for p in RAW_PREFIXES])


def eligibility(features: DataFrame, survivors: DataFrame, feature: str = "feature", signal: str = "signal") -> DataFrame:
    """``features`` with a verdict each: raw (by its name), no_owner (a null signal), not_surviving (its signal isn't among ``survivors``) or admitted."""
    alive = survivors.select(signal).distinct().withColumn("alive_", F.lit(True))
    verdict = F.when(raw(feature), "raw").when(F.col(signal).isNull(), "no_owner").when(F.col("alive_").isNull(), "not_surviving").otherwise("admitted")
    return features.join(alive, signal, "left").withColumn("verdict", verdict).drop("alive_")


def signals_of(features: DataFrame, owners: DataFrame, feature: str = "feature", signal: str = "signal") -> DataFrame:
    """The signals that features belong to; features without an owner raise."""
    met = features.select(feature).distinct().join(owners.select(feature, signal), feature, "left")
    require_empty(met.where(F.col(signal).isNull()), "features without a signal")
    return met.select(signal).distinct()


def refuse_raw(columns: list[str]) -> None:
    bad = [c for c in columns if c.startswith(RAW_PREFIXES)]
    if bad:
        raise ValueError(f"raw statistics may not be selection features: {bad}")


def column_checks(df: DataFrame, columns: list[str], least_unique: int, most_missing: float) -> DataFrame:
    """(signal, check, passed) for validity, stability and missing rate of each score column, in one pass."""
    aggregates = [F.count(F.lit(1)).alias("n")]
    for c in columns:
        x = F.col(c).cast("double")
        aggregates += [F.count_distinct(c).alias(f"{c}_unique"), F.count_if(F.abs(x) == float("inf")).alias(f"{c}_infinite"), F.avg((x.isNull() | F.isnan(x)).cast("double")).alias(f"{c}_missing")]
    row = df.agg(*aggregates)
    checks = []
    for c in columns:
        for name, passed in (("technical_validity", F.col("n") > 0), ("numerical_stability", (F.col(f"{c}_infinite") == 0) & (F.col(f"{c}_unique") >= least_unique)), ("missing_rate", F.coalesce(F.col(f"{c}_missing") <= most_missing, F.lit(False)))):
            checks.append(F.struct(F.lit(c).alias("signal"), F.lit(name).alias("check"), passed.alias("passed")))
    return row.select(F.explode(F.array(*checks)).alias("e")).select("e.*")


def contrast(df: DataFrame, score: str, flag: str, flagged_lower: bool = True) -> DataFrame:
    """Whether flagged rows score lower (or higher) on average; not contradicted where one side is empty."""
    a = df.agg(F.avg(F.when(F.col(flag), F.col(score))).alias("flagged_mean"), F.avg(F.when(~F.col(flag), F.col(score))).alias("clean_mean"))
    right = F.col("flagged_mean") < F.col("clean_mean") if flagged_lower else F.col("flagged_mean") > F.col("clean_mean")
    return a.select("flagged_mean", "clean_mean", F.coalesce(right, F.lit(True)).alias("passed"))


def redundancy_within(df: DataFrame, columns: list[str], by: str) -> DataFrame:
    """Size-weighted mean of within-class Spearman correlations of each pair of columns (absolute), undefined classes left out."""
    out = None
    for i, x in enumerate(columns):
        for y in columns[i + 1 :]:
            each = spearman(df, [by], x, y).where("rho is not null")
            one = each.agg((F.sum(F.abs("rho") * F.col("n")) / F.nullif(F.sum("n"), F.lit(0))).alias("correlation")).select(F.lit(x).alias("x"), F.lit(y).alias("y"), "correlation")
            out = one if out is None else out.unionByName(one)
    return out


def redundancy_pooled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pooled Pearson correlations (absolute), NULL where a column is constant."""
    pairs = []
    for i, x in enumerate(columns):
        for y in columns[i + 1 :]:
            a, b = F.col(x).cast("double"), F.col(y).cast("double")
            both = a.isNotNull() & b.isNotNull()
            a, b = F.when(both, a), F.when(both, b)
            r = F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))
            pairs.append(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.abs(r).alias("correlation")))
    return df.agg(F.array(*pairs).alias("a")).select(F.explode("a").alias("e")).select("e.*")


def usefulness(df: DataFrame, columns: list[str], key: str, by: list[str], share: float) -> DataFrame:
    """For each column, the Jaccard similarity of the best shares of each class with and without it in the mean of min-max scores."""
    ends = [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("low", F.min), ("high", F.max))]
    classes = settled(df.groupBy(*[F.col(b).alias(f"g{k}_") for k, b in enumerate(by)]).agg(F.count(F.lit(1)).alias("rows_"), *ends))  # a row a class
    most = classes.agg(F.max("rows_")).first()[0] or 0
    same = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"g{k}_")) for k, b in enumerate(by)], F.lit(True))
    scaled = {c: F.coalesce((F.col(c) - F.col(f"low_{c}")) / F.nullif(F.col(f"high_{c}") - F.col(f"low_{c}"), F.lit(0.0)), F.lit(0.0)) for c in columns}
    rows = df.select(key, *by, *columns).join(classes, same).select(key, *by, "rows_", *[v.alias(f"s_{c}") for c, v in scaled.items()])
    total = sum(F.col(f"s_{c}") for c in columns)
    marks = {"all_": total / float(len(columns))} | {f"no_{c}": (total - F.col(f"s_{c}")) / float(max(1, len(columns) - 1)) for c in columns}
    rows = rows.withColumns({k: F.round(v, 9) for k, v in marks.items()}).withColumn("n_", F.greatest(F.lit(1), F.bround(F.col("rows_") * F.lit(share), 0)))
    for m in marks:
        rows = scanned(rows, by, [F.col(m).desc(), F.col(key)], rank="r_", most=most).withColumn(f"in_{m}", F.col("r_") <= F.col("n_"))
    got = rows.agg(*[F.coalesce(F.count_if(F.col("in_all_") & F.col(f"in_no_{c}")) / F.nullif(F.count_if(F.col("in_all_") | F.col(f"in_no_{c}")), F.lit(0)), F.lit(1.0)).alias(c) for c in columns])
    return got.select(F.explode(F.array(*[F.struct(F.lit(c).alias("signal"), F.col(c).alias("jaccard")) for c in columns])).alias("e")).select("e.*")


HARD = ("technical_validity", "numerical_stability", "missing_rate", "provenance")


def decide(checks: DataFrame) -> DataFrame:
    """Outcome of each signal: a failed hard check or direction excludes, a failed soft check (redundancy, usefulness) leaves it for ablation."""
    failed = lambda names: F.array_join(F.array_sort(F.collect_set(F.when(~F.col("passed") & F.col("check").isin(*names), F.col("check")))), ",")
    rows = checks.groupBy("signal").agg(failed(HARD).alias("hard"), failed(("directionality",)).alias("direction"), failed(("redundancy", "usefulness")).alias("soft"))
    outcome = F.when(F.col("hard") != "", "exclude").when(F.col("direction") != "", "exclude").when(F.col("soft") != "", "ablation").otherwise("include")
    reason = F.when(F.col("hard") != "", F.col("hard")).when(F.col("direction") != "", F.col("direction")).when(F.col("soft") != "", F.col("soft")).otherwise("passed")
    return rows.select("signal", outcome.alias("outcome"), reason.alias("reason"))


def report(decisions: DataFrame, least: int = 3) -> DataFrame:
    """Survivors and whether there are enough for the primary analysis."""
    names = F.array_join(F.array_sort(F.collect_list(F.when(F.col("outcome") == "include", F.col("signal")))), ",")
    n = F.count_if(F.col("outcome") == "include")
    return decisions.agg(names.alias("survivors"), n.alias("n_survivors"), (n >= least).alias("primary"))
