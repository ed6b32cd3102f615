"""Comparison of conditions: metrics of resampled groups, differences of pairs, corrections by family."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.frames import largest, scanned, settled
from tessella.operators import resampling
from tessella.operators.inference import benjamini_hochberg, drawn_by_unit, draws, holm, repeats_needed
from tessella.operators.labels import require_empty

PRIMARY = "balanced_accuracy"


@dataclass(frozen=True)
class Protocol:
    """Conditions of an experiment, the pairs that are tested, and the pairs whose counts tell a fault."""

    conditions: tuple[str, ...]
    confirmatory: tuple[tuple[str, str], ...]
    exploratory: tuple[tuple[str, str], ...]
    equal_suspect: tuple[tuple[str, str], ...] = ()
    equal_required: tuple[tuple[str, str], ...] = ()


# fixed values: the pre-registered pairs of either protocol
PROTOCOLS = {
    "v1": Protocol(("A", "B", "C"), (("C", "B"),), (("C", "A"), ("B", "A")), (("B", "C"),)),
    "v2": Protocol(("A", "B", "C2", "D2"), (("C2", "D2"),), (("C2", "B"), ("D2", "B"), ("C2", "A"), ("D2", "A"), ("B", "A")), (("B", "C2"), ("B", "D2")), (("C2", "D2"),)),
}


def comparable(predictions: DataFrame, protocol: Protocol, key: str = "image_id") -> DataFrame:
    """``predictions`` of the protocol's conditions; a condition without rows, or runs over other images than the rest, raise."""
    spark = predictions.sparkSession
    rows = predictions.where(F.col("condition").isin(*protocol.conditions))
    runs = rows.select("condition", "seed").distinct()
    wanted = spark.createDataFrame([(c,) for c in protocol.conditions], "condition string")
    require_empty(wanted.join(runs, "condition", "left_anti"), "conditions without predictions")
    n = runs.count()
    require_empty(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("condition", "seed").alias("k")).where((F.col("n") != n) | (F.col("k") != n)), "images that not every run has once")
    return rows


def confusion_metrics(cells: DataFrame, by: list[str]) -> DataFrame:
    """(*by, metric, value) of confusion cells (*by, true_class, predicted, n): balanced accuracy and macro F1 over present classes, accuracy, and each class's recall."""
    hit = F.when(F.col("true_class") == F.col("predicted"), F.col("n")).otherwise(0)
    truth = cells.groupBy(*by, F.col("true_class").alias("k")).agg(F.sum("n").alias("support"), F.sum(hit).alias("hits"))
    claims = cells.groupBy(*by, F.col("predicted").alias("k")).agg(F.sum("n").alias("claimed"))
    each = truth.where("support > 0").join(claims, [*by, "k"], "left")
    each = each.withColumns({"recall": F.col("hits") / F.col("support"), "f1": 2 * F.col("hits") / (F.col("support") + F.coalesce("claimed", F.lit(0)))})
    wide = each.groupBy(*by).agg(F.avg("recall").alias(PRIMARY), F.avg("f1").alias("macro_f1"), (F.sum("hits") / F.sum("support")).alias("accuracy"))
    names = (PRIMARY, "macro_f1", "accuracy")
    long = wide.select(*by, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in names])).alias("m")).select(*by, "m.metric", "m.value")
    return long.unionByName(each.select(*by, F.concat(F.lit("recall_"), F.col("k").cast("string")).alias("metric"), F.col("recall").alias("value")))


def resampled(predictions: DataFrame, unit: str, replicates: int, seed: int, split: bool = False) -> DataFrame:
    """(b, condition, metric, value): each condition's metrics, the mean over its seeds, on the rows as they are (b = 0) and on each resample of units.

    Rows are summed to confusion cells by unit before they meet the draws, which all conditions share.
    ``split``: draws are split where the units lie (see ``resampling``) instead of listed, so no row is made,
    shuffled or joined for a draw; rows with a null unit are left out then.
    """
    key = ["b", "condition", "seed"]
    if split:
        summed = resampling.resampled(predictions, unit, ["condition", "seed", "true_class", "predicted"], {"n": F.lit(1)}, replicates, seed).where("n > 0")
        return settled(confusion_metrics(settled(summed), key).groupBy("b", "condition", "metric").agg(F.avg("value").alias("value")))
    cells = predictions.groupBy(F.col(unit).alias("unit"), "condition", "seed", "true_class", "predicted").agg(F.count(F.lit(1)).alias("c"))
    weights = draws(predictions.select(F.col(unit).alias("unit")), replicates, seed)
    drawn = weights.join(cells, "unit").select("b", "condition", "seed", "true_class", "predicted", (F.col("c") * F.col("weight")).alias("n"))
    whole = cells.select(F.lit(0).alias("b"), "condition", "seed", "true_class", "predicted", F.col("c").alias("n"))
    summed = settled(drawn.unionByName(whole).groupBy(*key, "true_class", "predicted").agg(F.sum("n").alias("n")))
    return settled(confusion_metrics(summed, key).groupBy("b", "condition", "metric").agg(F.avg("value").alias("value")))


#: Distinct (run, class, score) that a task adds up weights for before it gives them on.
HELD = 1 << 15
#: Rows whose weights it adds up at once.
AT_ONCE = 1 << 16


def resampled_auroc(predictions: DataFrame, unit: str, probabilities: list[str], replicates: int, seed: int) -> DataFrame:
    """The same for the macro one-vs-rest AUROC, from one probability column a class: (b, condition, metric, value).

    A unit's draws meet its rows as one list, and tasks add up the weights of all replicates by score
    before anything is dealt out again: neither rows by replicates nor rows by classes are shuffled,
    and distinct scores are what is sorted. Classes without rows on both sides of a resample are left
    out of its mean. Null scores are the lowest.
    """
    kinds = {f.name: f.dataType.simpleString() for f in predictions.schema}
    scores = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("-inf"))) for c in probabilities])
    rows = predictions.where("true_class is not null").select(F.col(unit).alias("unit"), "condition", "seed", "true_class", scores.alias("s"))
    rows = rows.join(drawn_by_unit(predictions.select(F.col(unit).alias("unit")), replicates, seed), "unit", "left").select("condition", "seed", "true_class", "s", "drawn")

    names, width = ["b", "condition", "seed", "k", "s", "p", "n"], replicates + 1

    def given(held: dict, of: pa.Schema) -> pa.RecordBatch:
        """A row for each weight that isn't zero."""
        keys, sums = list(held), np.array(list(held.values()))
        at, b = (sums != 0).nonzero()
        parts, w = [pa.array(x).take(pa.array(at)) for x in zip(*keys, strict=True)], sums[at, b]
        y = parts[4].to_numpy()
        return pa.RecordBatch.from_arrays([pa.array(b.astype(np.int32)), parts[0].cast(of.field("condition").type), parts[1].cast(of.field("seed").type), parts[2].cast(pa.int32()), parts[3], pa.array(w * y), pa.array(w * (1 - y))], names=names)

    def add(held: dict, rows: pa.Table) -> None:
        n, lists = len(rows), rows["drawn"].combine_chunks()
        sizes = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        at = np.repeat(np.arange(n), sizes) * width + lists.flatten().to_numpy()
        weight = np.bincount(at, minlength=n * width).reshape(n, width)
        weight[:, 0] = 1  # the rows as they are
        s = rows["s"].combine_chunks().flatten().to_numpy().reshape(n, len(probabilities))
        truth, condition, of_seed = (rows[c].combine_chunks() for c in ("true_class", "condition", "seed"))
        truth, (runs, which) = truth.to_numpy(zero_copy_only=False), (x.dictionary_encode(null_encoding="encode") for x in (condition, of_seed))
        runs = runs.indices.to_numpy().astype(np.int64) * (len(which.dictionary) + 1) + which.indices.to_numpy()
        for k in range(s.shape[1]):
            y = (truth == k).astype(np.int64)
            order = np.lexsort((y, s[:, k], runs))
            a, b, c = runs[order], s[order, k], y[order]
            first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])])
            ids = order[first]
            keys = zip(condition.take(pa.array(ids)).to_pylist(), of_seed.take(pa.array(ids)).to_pylist(), [k] * len(ids), s[ids, k].tolist(), y[ids].tolist(), strict=True)
            for key, total in zip(keys, np.add.reduceat(weight[order], first, axis=0), strict=True):
                if key in held:
                    held[key] += total
                else:
                    held[key] = total.copy()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            waiting.append(batch)
            if sum(map(len, waiting)) >= AT_ONCE:
                add(held, pa.Table.from_batches(waiting))
                waiting = []
            if len(held) > HELD:
                yield given(held, batch.schema)
                held = {}
        if sum(map(len, waiting)):
            add(held, pa.Table.from_batches(waiting))
        if held:
            yield given(held, batch.schema)

    drawn = rows.mapInArrow(weigh, f"b int, condition {kinds['condition']}, seed {kinds['seed']}, k int, s double, p long, n long")
    by = ["b", "condition", "seed", "k"]
    summed = drawn.groupBy(*by, "s").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    below = F.col("upto_") - F.col("n")
    each = scanned(summed, by, [F.col("s")], sums={"upto_": "n"}, most=largest(predictions, ["condition", "seed"])).withColumn("below", below).groupBy(*by).agg((F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)) / F.nullif(F.sum("p") * F.sum("n"), F.lit(0))).alias("auroc"))
    means = each.groupBy("b", "condition", "seed").agg(F.avg("auroc").alias("value")).groupBy("b", "condition").agg(F.avg("value").alias("value"))
    return settled(means.select("b", "condition", F.lit("macro_auroc").alias("metric"), "value"))


def estimates(values: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(condition, metric, estimate, low, high, n_draws) of ``resampled`` values."""
    draw = F.when(F.col("b") > 0, F.col("value"))
    q = lambda p: F.percentile(draw, F.lit(p))  # noqa: E731  as many values as replicates
    return values.groupBy("condition", "metric").agg(F.max(F.when(F.col("b") == 0, F.col("value"))).alias("estimate"), q(alpha / 2).alias("low"), q(1 - alpha / 2).alias("high"), F.count(draw).alias("n_draws"))


def differences(values: DataFrame, protocol: Protocol, alpha: float = 0.05) -> DataFrame:
    """(family, name, difference, low, high, p) for the pairs of a protocol.

    Confirmatory is the primary metric of the confirmatory pairs; their other metrics, and all of
    the exploratory pairs but recalls, are exploratory.
    """
    pairs = [(a, b, True) for a, b in protocol.confirmatory] + [(a, b, False) for a, b in protocol.exploratory]
    pairs = values.sparkSession.createDataFrame(pairs, "left string, right string, main boolean")
    side = lambda s, v: values.select("b", "metric", F.col("condition").alias(s), F.col("value").alias(v))
    met = side("left", "x").join(F.broadcast(pairs), "left").join(side("right", "y"), ["b", "metric", "right"])
    met = met.where("main or metric not like 'recall%'").select("b", "main", "metric", F.concat("left", F.lit("_vs_"), "right", F.lit(":"), "metric").alias("name"), (F.col("x") - F.col("y")).alias("d"))
    observed = met.where("b = 0").select("name", F.col("d").alias("difference"))
    drawn = met.where("b > 0 and d is not null").join(observed, "name", "right")
    across = F.when(F.col("difference") > 0, F.col("d") <= 0).otherwise(F.col("d") >= 0)
    q = lambda p: F.percentile("d", F.lit(p))
    family = F.when(F.col("main") & (F.col("metric") == PRIMARY), "confirmatory").otherwise("exploratory")
    return drawn.groupBy(family.alias("family"), "name", "difference").agg(q(alpha / 2).alias("low"), q(1 - alpha / 2).alias("high"), F.least(F.lit(1.0), 2 * F.avg(across.cast("double"))).alias("p"))


def corrected(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """The families apart: confirmatory by Holm, exploratory by Benjamini-Hochberg."""
    part = lambda f: tests.where(F.col("family") == f)
    return holm(part("confirmatory"), ["family"], alpha=alpha).unionByName(benjamini_hochberg(part("exploratory"), ["family"], alpha=alpha))


def compare(predictions: DataFrame, protocol: Protocol, unit: str, replicates: int = 200, seed: int = 0, alpha: float = 0.05, probabilities: list[str] = (), split: bool = False) -> DataFrame:
    """The comparison of a protocol's conditions, by family, with the macro AUROC where there are probabilities (its draws are listed); see ``comparable`` for what raises."""
    rows = comparable(predictions, protocol)
    values = resampled(rows, unit, replicates, seed, split)
    if probabilities:
        values = values.unionByName(resampled_auroc(rows, unit, list(probabilities), replicates, seed))
    return corrected(differences(values, protocol, alpha), alpha)


def count_faults(counts: DataFrame, protocol: Protocol) -> DataFrame:
    """Pairs of conditions (left, right, fault) whose counts (condition, n) agree where that is suspect, or differ where they must agree."""
    pairs = [(a, b, True) for a, b in protocol.equal_suspect] + [(a, b, False) for a, b in protocol.equal_required]
    pairs = counts.sparkSession.createDataFrame(pairs, "left string, right string, suspect boolean")
    side = lambda s, n: counts.select(F.col("condition").alias(s), F.col("n").alias(n))
    met = pairs.join(side("left", "x"), "left").join(side("right", "y"), "right")
    return met.where((F.col("x") == F.col("y")) == F.col("suspect")).select("left", "right", F.when(F.col("suspect"), "equal_counts").otherwise("unequal_counts").alias("fault"))


def ensembles(probabilities: DataFrame, by: list[str]) -> DataFrame:
    """Probabilities averaged over runs, and their spread over runs (sample deviation, null for one run)."""
    return probabilities.groupBy(*by).agg(F.avg("p").alias("p"), F.stddev_samp("p").alias("spread"), F.count(F.lit(1)).alias("n_runs"))


def resampled_components(cells: DataFrame, replicates: int, seed: int, split: bool = False) -> DataFrame:
    """Variance components on each resample of subsets: cells (unit, n, m, v: repeats, mean, population variance); ``split`` as in ``resampled``."""
    n, m = F.col("n"), F.col("m")
    each = {"k": F.lit(1), "total": n, "ssw": n * F.col("v"), "sq": n * m * m, "s": n * m}
    if split:
        sums = resampling.resampled(cells, "unit", [], each, replicates, seed).where("b > 0")
    else:
        sums = draws(cells.select("unit"), replicates, seed).join(cells, "unit").groupBy("b").agg(*[F.sum(F.col("weight") * c).alias(k) for k, c in each.items()])
    ssb = F.col("sq") - F.col("s") * F.col("s") / F.col("total")
    within = F.col("ssw") / F.nullif(F.col("total") - F.col("k"), F.lit(0))
    rows = sums.withColumn("within", within).withColumn("between", (ssb / F.nullif(F.col("k") - 1, F.lit(0)) - F.col("within")) * F.col("k") / F.col("total"))
    up = F.greatest("between", F.lit(0.0))
    return rows.select("b", "between", "within", (up / F.nullif(up + F.col("within"), F.lit(0.0))).alias("icc"))


def subset_bootstrap(df: DataFrame, replicates: int, seed: int, affordable: int = 4, most: int = 10, subset: str = "subset_id", value: str = "y", alpha: float = 0.05, split: bool = False) -> DataFrame:
    """One row: interval of the ICC, median and 0.9 quantile of the repeats needed (``most`` + 1 for more), and the share of resamples that ``affordable`` repeats satisfy."""
    cells = df.groupBy(F.col(subset).alias("unit")).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    rows = resampled_components(cells, replicates, seed, split)
    needed = F.coalesce(F.least(repeats_needed(F.col("icc")), F.lit(most + 1)), F.lit(most + 1)).cast("double")
    q = lambda c, p: F.percentile(c, F.lit(p))
    return rows.withColumn("needed", needed).agg(q("icc", alpha / 2).alias("low"), q("icc", 1 - alpha / 2).alias("high"), q("needed", 0.5).alias("needed_median"), q("needed", 0.9).alias("needed_p90"), F.avg((F.col("needed") <= affordable).cast("double")).alias("affordable_share"))


def metric_choice(metrics: DataFrame, default: str, affordable: int = 4) -> DataFrame:
    """Of metrics (metric, icc), the one with the highest ICC whose needed repeats are affordable, with them; else the default, without (one row)."""
    rows = metrics.withColumn("needed", repeats_needed(F.col("icc"))).where(F.col("needed") <= affordable)
    best = rows.agg(F.max_by(F.struct("metric", "needed"), F.struct("icc", "metric")).alias("best"))
    return best.select(F.coalesce("best.metric", F.lit(default)).alias("metric"), F.col("best.needed").cast("bigint").alias("repeats"))


def recall_table(stored: DataFrame, classes: list[str]) -> DataFrame:
    """Columns of recalls out of stored reports (condition, report: JSON with a ``per_class_recall`` object); a class that isn't there is null."""
    parsed = F.from_json("report", "per_class_recall map<string, double>")["per_class_recall"]
    return stored.select("condition", *[F.try_element_at(parsed, F.lit(c)).alias(f"recall_{c}") for c in classes])
