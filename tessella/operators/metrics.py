"""Metrics as aggregations: each takes a table and the columns to group by, and returns a row a group.

What isn't defined is NULL, never NaN: a rate without a denominator, AUROC with one class.
Rows whose score or target is NULL are left out by the binary metrics.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.frames import ranged, scanned

Groups = list[str]


def defined(df: DataFrame, *cols: str) -> DataFrame:
    """Rows in which none of the columns is NULL or NaN."""
    return df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in cols]))


def with_mid_rank(df: DataFrame, value: str, groups: Groups = (), name: str = "mid_rank") -> DataFrame:
    """``df`` with the average rank of ties, from 1; distinct values, not rows, are scanned."""
    each = scanned(df.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n_")), list(groups), [F.col(value)], sums={"upto_": "n_"})
    each = each.select(*[F.col(c).alias(f"g{k}_") for k, c in enumerate([*groups, value])], (F.col("upto_") - (F.col("n_") - 1) / F.lit(2.0)).alias(name))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"g{k}_")) for k, c in enumerate([*groups, value])])
    return df.join(each, same, "left").select(*[c for c in df.columns if c != name], name)


def auroc(df: DataFrame, groups: Groups, score: str = "score", target: str = "target") -> DataFrame:
    """Mann-Whitney AUROC from counts at each distinct score.

    Rows are first counted by score, so what is scanned is the distinct scores, not the rows; as many as there are.
    """
    rows = defined(df, score, target).groupBy(*groups, score).agg(F.sum((F.col(target) == 1).cast("double")).alias("p"), F.sum((F.col(target) != 1).cast("double")).alias("q"))
    rows = scanned(rows, list(groups), [F.col(score)], sums={"upto_": "q"}).withColumn("w", F.col("p") * (F.col("upto_") - F.col("q") / 2))
    return rows.groupBy(*groups).agg((F.sum("w") / F.nullif(F.sum("p") * F.sum("q"), F.lit(0.0))).alias("auroc"))


def average_precision(df: DataFrame, groups: Groups, score: str = "score", target: str = "target", tie: str = "row_id") -> DataFrame:
    """Step-wise average precision; ties are taken in the order of ``tie``."""
    rows = cumulative_precision(df, groups, score, target, tie)
    hit = (F.col(target) == 1).cast("double")
    return rows.groupBy(*groups).agg((F.sum(hit * F.col("precision")) / F.nullif(F.sum(hit), F.lit(0.0))).alias("average_precision"))


def cumulative_precision(df: DataFrame, groups: Groups, score: str = "score", target: str = "target", tie: str = "row_id") -> DataFrame:
    """``df`` (rows without a score or target left out) with rank and precision down to it, best first."""
    rows = scanned(defined(df, score, target), list(groups), [F.col(score).desc(), F.col(tie)], rank="rank", sums={"hits_": (F.col(target) == 1).cast("double")})
    return rows.withColumns({"rank": F.col("rank").cast("int"), "precision": F.col("hits_") / F.col("rank")}).drop("hits_")


def micro_auroc(df: DataFrame, mask: str = "mask", **names) -> DataFrame:
    """AUROC over the unmasked rows of all labels together, in one row."""
    rows = df.where(F.col(mask)).withColumn("all_", F.lit(1))
    return auroc(rows, ["all_"], **names).select(F.col("auroc").alias("micro_auroc"))


def brier(df: DataFrame, groups: Groups, score: str = "score", target: str = "target") -> DataFrame:
    return defined(df, score, target).groupBy(*groups).agg(F.avg(F.pow(F.col(score) - F.col(target), 2)).alias("brier"))


def calibration_error(df: DataFrame, groups: Groups, score: str = "score", target: str = "target", bins: int = 10) -> DataFrame:
    """Expected calibration error over equal bins, open below and closed above, the first closed at 0 too."""
    edges = [k / bins for k in range(bins + 1)]
    at = F.lit(0)
    for k in range(1, bins):
        at = F.when(F.col(score) > edges[k], k).otherwise(at)
    rows = defined(df, score, target).where(F.col(score).between(0, 1)).withColumn("bin", at)
    rows = rows.groupBy(*groups, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("s"), F.avg(F.col(target).cast("double")).alias("y"))
    return rows.groupBy(*groups).agg((F.sum(F.col("n") * F.abs(F.col("s") - F.col("y"))) / F.sum("n")).alias("ece"))


def at_threshold(df: DataFrame, groups: Groups, score: str = "score", target: str = "target", threshold: float = 0.5) -> DataFrame:
    """Sensitivity, specificity and F1 of ``score >= threshold``."""
    yes, true = F.col(score) >= threshold, F.col(target) == 1
    rows = defined(df, score, target).groupBy(*groups).agg(F.count_if(yes & true).alias("tp"), F.count_if(yes & ~true).alias("fp"), F.count_if(~yes & true).alias("fn"), F.count_if(~yes & ~true).alias("tn"))
    rate = lambda a, b: a / F.nullif(b, F.lit(0))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    return rows.select(*groups, "tp", "fp", "fn", "tn", rate(tp, tp + fn).alias("sensitivity"), rate(tn, tn + fp).alias("specificity"), rate(2 * tp, 2 * tp + fp + fn).alias("f1"))


def macro_auroc(df: DataFrame, groups: Groups, label: str = "label", mask: str = "mask", least: int = 10, **names) -> DataFrame:
    """Mean AUROC of the labels with enough unmasked rows of either class, and their number (NULL and 0 where none has)."""
    seen = df.where(F.col(mask))
    support = seen.groupBy(*groups, label).agg(F.count_if(F.col(names.get("target", "target")) == 1).alias("pos"), F.count_if(F.col(names.get("target", "target")) != 1).alias("neg"))
    each = auroc(seen, [*groups, label], **names).join(support, [*groups, label])
    each = each.withColumn("auroc", F.when((F.col("pos") >= least) & (F.col("neg") >= least), F.col("auroc")))
    return each.groupBy(*groups).agg(F.avg("auroc").alias("macro_auroc"), F.count("auroc").alias("n_labels"))


def binary_suite(df: DataFrame, groups: Groups, mask: str | None = "mask", threshold: float = 0.5) -> DataFrame:
    """All binary metrics side by side; masked rows don't count."""
    rows = df.where(F.col(mask)) if mask else df
    parts = [auroc(rows, groups), average_precision(rows, groups), brier(rows, groups), calibration_error(rows, groups), at_threshold(rows, groups, threshold=threshold)]
    sizes = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("effective_n"))
    return reduce(lambda a, b: a.join(b, groups, "left"), parts, sizes)


def masked_bce(df: DataFrame, groups: Groups, logit: str = "logit", target: str = "target", mask: str = "mask") -> DataFrame:
    """Mean binary cross-entropy of logits over unmasked rows, 0 where there are none."""
    z = F.col(logit)
    loss = F.greatest(z, F.lit(0.0)) - z * F.col(target) + F.log1p(F.exp(-F.abs(z)))
    seen = F.col(mask) & F.col(target).isNotNull()
    return df.groupBy(*groups).agg(F.coalesce(F.sum(F.when(seen, loss)) / F.nullif(F.count_if(seen), F.lit(0)), F.lit(0.0)).alias("masked_bce"))


def confusion(df: DataFrame, groups: Groups, n_classes: int, true: str = "true_class", predicted: str = "predicted") -> DataFrame:
    """Counts of each (true, predicted), zeros kept."""
    counts = df.groupBy(*groups, true, predicted).agg(F.count(F.lit(1)).alias("n"))
    grid = df.select(*groups).distinct() if groups else df.sparkSession.range(1).select()
    for c in (true, predicted):
        grid = grid.withColumn(c, F.explode(F.sequence(F.lit(0), F.lit(n_classes - 1))))
    return grid.join(counts, [*groups, true, predicted], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))


def per_class(df: DataFrame, groups: Groups, n_classes: int, true: str = "true_class", predicted: str = "predicted") -> DataFrame:
    """Precision, recall and F1 of each class: NULL for a class without true rows, precision 0 for one that is never predicted."""
    c = confusion(df, groups, n_classes, true, predicted)
    t = c.groupBy(*groups, F.col(true).alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col(true) == F.col(predicted), F.col("n")).otherwise(0)).alias("tp"))
    p = c.groupBy(*groups, F.col(predicted).alias("class")).agg(F.sum("n").alias("n_predicted"))
    rows = t.join(p, [*groups, "class"])
    there = F.col("support") > 0
    precision = F.when(there, F.coalesce(F.col("tp") / F.nullif("n_predicted", F.lit(0)), F.lit(0.0)))
    recall = F.when(there, F.col("tp") / F.nullif("support", F.lit(0)))
    rows = rows.select(*groups, "class", "support", "n_predicted", precision.alias("precision"), recall.alias("recall"))
    both = F.col("precision") + F.col("recall")
    return rows.withColumn("f1", F.when(F.col("support") > 0, F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(both, F.lit(0.0)), F.lit(0.0))))


def multiclass_suite(df: DataFrame, groups: Groups, n_classes: int, true: str = "true_class", predicted: str = "predicted") -> DataFrame:
    """Accuracy, balanced accuracy and macro F1 (over classes that have rows)."""
    classes = per_class(df, groups, n_classes, true, predicted)
    means = classes.groupBy(*groups).agg(F.avg("recall").alias("balanced_accuracy"), F.avg("f1").alias("macro_f1"))
    return df.groupBy(*groups).agg(F.avg((F.col(true) == F.col(predicted)).cast("double")).alias("accuracy")).join(means, groups)


def one_vs_rest(df: DataFrame, groups: Groups, probabilities: list[str], true: str = "true_class", key: str = "image_id") -> DataFrame:
    """AUROC and average precision of each class against the rest, from one probability column a class."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("class"), F.col(c).cast("double").alias("score")) for k, c in enumerate(probabilities)])).alias("e")
    rows = df.select(*groups, F.col(key), F.col(true).alias("t"), pairs).select(*groups, key, "e.class", "e.score", (F.col("t") == F.col("e.class")).cast("int").alias("target"))
    by = [*groups, "class"]
    return auroc(rows, by).join(average_precision(rows, by, tie=key), by)


def argmax_class(probabilities: Column) -> Column:
    """Index from 0 of the largest, the first of equals."""
    return F.array_position(probabilities, F.array_max(probabilities)) - 1


def spearman(df: DataFrame, groups: Groups, x: str, y: str) -> DataFrame:
    """Rank correlation with average ties, and the reason where it is undefined.

    Reasons: too_few_rows (under two), constant_x, constant_y.
    """
    rows = defined(df, x, y)
    rows = with_mid_rank(with_mid_rank(rows, x, groups, "rx"), y, groups, "ry")
    a = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.var_pop("rx").alias("vx"), F.var_pop("ry").alias("vy"), F.covar_pop("rx", "ry").alias("cxy"))
    reason = F.when(F.col("n") < 2, "too_few_rows").when(F.col("vx") <= 0, "constant_x").when(F.col("vy") <= 0, "constant_y")
    rho = F.when(reason.isNull(), F.col("cxy") / F.nullif(F.sqrt(F.col("vx") * F.col("vy")), F.lit(0.0)))
    return a.select(*groups, "n", rho.alias("rho"), reason.alias("reason"))


def youden(df: DataFrame, groups: Groups, steps: int = 19, score: str = "score", target: str = "target") -> DataFrame:
    """The threshold k / (steps + 1) of greatest sensitivity + specificity - 1, the lowest of equals; 0.5 where undefined."""
    cut = F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("k")
    small = defined(df, score, target).groupBy(*groups, F.least(F.floor(F.col(score) * (steps + 1) + 1e-9), F.lit(steps)).alias("b")).agg(F.sum((F.col(target) == 1).cast("double")).alias("p"), F.sum((F.col(target) != 1).cast("double")).alias("q"))
    rows = small.select(*groups, "b", "p", "q", cut).groupBy(*groups, "k").agg((F.sum(F.when(F.col("b") >= F.col("k"), F.col("p")).otherwise(0.0)) / F.nullif(F.sum("p"), F.lit(0.0)) - F.sum(F.when(F.col("b") >= F.col("k"), F.col("q")).otherwise(0.0)) / F.nullif(F.sum("q"), F.lit(0.0))).alias("j"))
    return rows.groupBy(*groups).agg(F.coalesce(F.max_by("k", F.when(F.col("j").isNotNull(), F.struct(F.round("j", 12), -F.col("k")))) / (steps + 1.0), F.lit(0.5)).alias("threshold"), F.round(F.max("j"), 12).alias("j"))


#: Distinct predictions of a group up to which pairs are counted in tasks; rows that are counted at once.
FEW_PREDICTIONS, AT_ONCE = 512, 4096


def counted(frame: pd.DataFrame, m: str, out: list[str]) -> pd.DataFrame:
    """Numbers of pairs by prediction (pa of the greater, pb of the lesser ``m``) from rows (pa, m, n) of one group."""
    frame = frame.sort_values(m, kind="stable")
    code, known = pd.factorize(frame["pa"], use_na_sentinel=False)
    n, value, size = frame["n"].to_numpy(dtype=np.int64), frame[m].to_numpy(), len(known)
    first = np.searchsorted(value, value)  # rows before it are lower
    pairs, before, at = np.zeros((size, size), dtype=np.int64), np.zeros(size, dtype=np.int64), 0
    while at < len(n):
        end = min(len(n), at + AT_ONCE)
        end = len(n) if end == len(n) else max(int(first[end]), int(np.searchsorted(value, value[at], side="right")))  # equal values stay together
        own = np.zeros((end - at + 1, size), dtype=np.int64)
        own[np.arange(1, end - at + 1), code[at:end]] = n[at:end]
        lower = own.cumsum(axis=0)[first[at:end] - at] + before
        order = np.argsort(code[at:end], kind="stable")
        some, start = np.unique(code[at:end][order], return_index=True)
        pairs[some] += np.add.reduceat((lower * n[at:end, None])[order], start, axis=0)
        before += own.sum(axis=0)
        at = end
    x, y = pairs.nonzero()
    named = np.asarray(known, dtype=object)
    return frame.iloc[:1][out].loc[lambda f: f.index.repeat(len(x))].assign(pa=named[x], pb=named[y], n=pairs[x, y]) if len(x) else frame.iloc[:0][out].assign(pa=[], pb=[], n=[])


def pairs_by_prediction(rows: DataFrame, groups: Groups) -> DataFrame:
    """Numbers of pairs (*groups, pa, pb, n) of rows (*groups, pa, m, n) with few predictions, a range of ``m`` at a time.

    Pairs inside a range are counted there; for those across, a range counts as one value, with a row a prediction.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([*[f"`{g}` {kinds[g]}" for g in groups], f"pa {kinds['pa']}", f"pb {kinds['pa']}", "n long"])
    dealt = ranged(rows, groups, [F.col("m")])
    inside = dealt.groupBy(*groups, "part_").applyInPandas(lambda f: counted(f, "m", groups), schema)
    held = dealt.groupBy(*groups, "part_", "pa").agg(F.sum("n").alias("n"))
    return inside.unionByName(held.groupBy(*groups).applyInPandas(lambda f: counted(f, "part_", groups), schema))


def pairwise_ranking_accuracy(df: DataFrame, groups: Groups, predicted: str, measured: str, key: str) -> DataFrame:
    """Share of pairs with different measured values that the prediction orders alike; ties of the prediction count as wrong.

    Pairs are counted, not made: tasks count them by range of the measured value where groups have few distinct
    predictions; else each row meets the distinct predictions of its group, and a running count by
    measured value says how many rows with that prediction lie below it. ``key`` is unique in
    a group; rows without it or without a measured value are in no pair.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(measured).isNotNull()).groupBy(*groups, F.col(predicted).alias("pa"), F.col(measured).alias("m")).agg(F.count(F.lit(1)).alias("n"))
    rows = rows.where(reduce(lambda a, b: a & b, [F.col(g).isNotNull() for g in groups], F.lit(True)))
    known = rows.select(*groups, "pa").distinct().groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.max(F.isnan(F.col("pa").cast("double"))).alias("nan"))
    most = known.agg(F.max("n").alias("n"), F.max("nan").alias("nan")).first()
    if (most.n or 0) <= FEW_PREDICTIONS and not most.nan:  # pandas takes NaN for null
        pairs = pairs_by_prediction(rows, groups).groupBy(*groups, "pa", "pb").agg(F.sum("n").alias("n"))
    else:
        cells = rows.join(rows.select(*groups, F.col("pa").alias("pb")).distinct(), groups)
        own = F.when(F.col("pa").eqNullSafe(F.col("pb")), F.col("n")).otherwise(0)
        below = Window.partitionBy(*groups, "pb").orderBy("m").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        under = F.sum(own).over(below) - F.sum(own).over(Window.partitionBy(*groups, "pb", "m"))
        pairs = cells.withColumn("n", F.col("n") * under).groupBy(*groups, "pa", "pb").agg(F.sum("n").alias("n")).where("n > 0")
    # pa belongs to the greater measured value of the pair
    right = (F.col("pa") > F.col("pb")).cast("double")
    loss = F.log1p(F.exp(F.col("pb") - F.col("pa")))
    mean = lambda x: F.sum(F.col("n") * x) / F.sum(F.when(x.isNotNull(), F.col("n")))
    return pairs.groupBy(*groups).agg(F.sum("n").alias("n_pairs"), mean(right).alias("accuracy"), mean(loss).alias("logistic_loss"))
