"""Steps that grow no faster than their input: nothing whole in one task, no rows by replicates."""

import numpy as np
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from tessella.functions import frames
from tessella.operators import comparison, inference, metrics, pivots, select, vectors
from tessella.plans import QUERIES, evaluation


def test_auroc_of_resamples_lists_no_draws_by_rows(spark, monkeypatch):
    """The same as from listed draws, with tasks that give on their sums often, and without a row a replicate."""
    data = [(k, k % 17, "AB"[k % 2], k % 2, (k * 7) % 3, *[((k * (31 + j)) % 11) / 10 if (k + j) % 13 else None for j in range(3)]) for k in range(300)]
    rows = spark.createDataFrame(data, "image_id int, unit int, condition string, seed int, true_class int, p0 double, p1 double, p2 double")
    weights = {(r.b, r.unit): r.weight for r in inference.draws(rows.select("unit"), 5, 3).collect()}
    weights |= {(0, u): 1 for u in range(17)}
    monkeypatch.setattr(comparison, "draws", None)
    monkeypatch.setattr(comparison, "HELD", 7)
    monkeypatch.setattr(comparison, "AT_ONCE", 20)
    got = {(r.b, r.condition): r.value for r in comparison.resampled_auroc(rows, "unit", ["p0", "p1", "p2"], 5, 3).collect()}
    assert len(got) == 12
    for (b, condition), value in got.items():
        mine, each = [(x, weights.get((b, x[1]), 0)) for x in data if x[2] == condition], []
        for j in range(3):
            s = np.array([-1.0 if x[5 + j] is None else x[5 + j] for x, _ in mine])
            w, y = np.array([w for _, w in mine]), np.array([x[4] == j for x, _ in mine])
            pairs = np.outer(w * y, w * ~y)
            each.append((pairs * ((s[:, None] > s) + (s[:, None] == s) / 2)).sum() / pairs.sum())
        assert value == pytest.approx(np.mean(each), abs=1e-9)


def test_rows_of_a_column_do_not_meet_in_a_task(spark):
    """Quantiles by few groups: the groups' bounds are broadcast, rows aren't dealt out by group."""
    df = spark.range(0, 1000, 1, 7).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = frames.quantiles(df, "v", [0.25, 0.5], ["g"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_no_spread_is_one_however_tasks_add_up(spark):
    for value in (0.1, 0.7, 1.1, 49.3):
        df = spark.range(0, 100_003, 1, 11).select(F.lit(value).alias("flat"))
        assert select.fit_features(df, ["flat"]).first().flat_std == 1.0


def test_files_are_made_by_many_tasks(spark, monkeypatch):
    parts, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path: (parts.append(self._df.rdd.getNumPartitions()), write(self, path))[1])
    assert QUERIES["pf23_rows_with_files"](spark, "/root/testdata/sf0.1").count() == 334
    assert parts == [2]


def test_pairs_are_counted_without_a_row_a_prediction(spark, monkeypatch):
    """Few predictions: the same as with many, small steps and ranges, and no join of rows with predictions."""
    df = spark.range(0, 400, 1, 4).select(F.col("id").alias("k"), F.lit(1).alias("g"), F.when(F.col("id") % 19 != 0, F.col("id") * 7 % 11 / 10).alias("p"), (F.col("id") * 13 % 37).cast("double").alias("m"))
    monkeypatch.setattr(metrics, "AT_ONCE", 16)
    got = metrics.pairwise_ranking_accuracy(df, ["g"], "p", "m", "k")
    assert "Join" not in got._jdf.queryExecution().analyzed().toString()
    few = got.first()
    monkeypatch.setattr(metrics, "FEW_PREDICTIONS", 0)
    many = metrics.pairwise_ranking_accuracy(df, ["g"], "p", "m", "k").first()
    assert few.n_pairs == many.n_pairs > 0 and (few.accuracy, few.logistic_loss) == pytest.approx((many.accuracy, many.logistic_loss), abs=1e-12)


@pytest.mark.parametrize("name", ["im16_uncertainty", "im17_uncertainty_multi"])
def test_passes_are_dealt_out_once_over_enough_tasks(spark, monkeypatch, name):
    monkeypatch.setattr(evaluation, "PASSES", 1000)
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    n = -(-spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count() // 1000)
    assert n > 1 and plan.count("hashpartitioning(") == 1 and f", {n}), REPARTITION_BY_NUM" in plan


def test_references_are_repeated_by_choice_of_sets_not_by_label_set(spark, monkeypatch):
    """Label sets of one candidate each: they are compared with the same sets, so references meet them as one class."""
    rng = np.random.default_rng(1)
    own = spark.createDataFrame([(k, ["a", f"own{k:03d}"], rng.normal(size=4).tolist()) for k in range(60)], "k long, l array<string>, v array<double>")
    refs = spark.createDataFrame([(100 + k, ["a"], rng.normal(size=4).tolist()) for k in range(40)], "k long, l array<string>, v array<double>")
    met, nearest = [], vectors.nearest
    monkeypatch.setattr(vectors, "nearest", lambda left, right, *a, **b: (met.append(right.count()), nearest(left, right, *a, **b))[1])
    got = vectors.tiered_scores(own, refs, "k", "l", "v").collect()
    assert met == [40] and len(got) == 60 and all(r.n_references == 40 and r.tier == "tier2" for r in got)


def test_vectors_are_shuffled_by_block_not_by_cell(spark, monkeypatch):
    """Vectors without clusters visit all cells, but are sent once for each pack of them."""
    monkeypatch.setattr(pivots, "WORTH", 20)
    rng, sent, blocks = np.random.default_rng(3), [], vectors.blocks
    rows = spark.createDataFrame([(k, "a", rng.normal(size=32).tolist()) for k in range(640)], "id long, class_ string, v array<double>")
    monkeypatch.setattr(vectors, "blocks", lambda left, *a: (sent.append(left.count()), blocks(left, *a))[1])
    got = vectors.nearest(rows, rows, 5, 0.95, True)
    assert got.count() == 640 and 640 <= sum(sent) <= 2 * 640


def test_a_task_holds_a_strip_of_similarities(spark, monkeypatch):
    x = np.random.default_rng(5).normal(size=(70, 8))
    rows = spark.createDataFrame([(k, "a", v.tolist()) for k, v in enumerate(x)], "id long, class_ string, v array<double>")
    whole = {r.id: (r.top, r.n_duplicates, r.n_peers) for r in vectors.nearest(rows, rows, 5, 0.5, True).collect()}
    edges = lambda: {r.node: r.cluster for r in vectors.clusters(vectors.duplicate_edges(rows, "id", "class_", "v", 0.6)).collect()}
    linked = edges()
    monkeypatch.setattr(vectors, "STRIP", 200)
    assert [s.stop - s.start for s in vectors.strips(70, 70)][0] == 2
    got = {r.id: (r.top, r.n_duplicates, r.n_peers) for r in vectors.nearest(rows, rows, 5, 0.5, True).collect()}
    assert {k: v[1:] for k, v in got.items()} == {k: v[1:] for k, v in whole.items()} and all(got[k][0] == pytest.approx(v[0], abs=1e-12) for k, v in whole.items())
    assert edges() == linked != {}
