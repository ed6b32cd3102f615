"""Known answers and the traps of nulls, ties and constants."""

import numpy as np
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from tessella.functions import text
from tessella.operators import gate, inference, labels, metrics, sampling, select, signals, vectors


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def one(df, column):
    return df.first()[column]


@pytest.mark.parametrize(("rows", "want"), [([(0.9, 1), (0.1, 0)], 1.0), ([(0.1, 1), (0.9, 0)], 0.0), ([(0.5, 1), (0.5, 0)], 0.5), ([(0.8, 1), (0.6, 0), (0.4, 1), (0.2, 0)], 0.75), ([(0.8, 1), (0.4, 1)], None)])
def test_auroc(spark, rows, want):
    df = frame(spark, [("a", s, y) for s, y in rows], "g string, score double, target int")
    assert one(metrics.auroc(df, ["g"]), "auroc") == want


def test_nan_scores_pass_no_metric(spark):
    df = frame(spark, [("a", float("nan"), 1), ("a", 0.2, 0), ("a", 0.9, 1), ("a", None, 0)], "g string, score double, target int")
    assert one(metrics.auroc(df, ["g"]), "auroc") == 1.0


def test_average_precision(spark):
    df = frame(spark, [("a", 1, 0.9, 1), ("a", 2, 0.8, 0), ("a", 3, 0.7, 1)], "g string, row_id int, score double, target int")
    assert one(metrics.average_precision(df, ["g"]), "average_precision") == pytest.approx(5 / 6)


def test_calibration_edges(spark):
    df = frame(spark, [("a", 0.1, 0), ("a", 0.3, 0), ("a", 1.0, 1), ("a", 0.0, 0)], "g string, score double, target int")
    assert one(metrics.calibration_error(df, ["g"]), "ece") == pytest.approx(0.1)


def test_spearman_constant(spark):
    df = frame(spark, [("a", 1.0, 2.0), ("a", 1.0, 3.0)], "g string, x double, y double")
    row = metrics.spearman(df, ["g"], "x", "y").first()
    assert (row.rho, row.reason) == (None, "constant_x")


def test_per_class_absent_and_never_predicted(spark):
    df = frame(spark, [(1, 0, 0), (2, 1, 0)], "image_id int, true_class int, predicted int")
    got = {r["class"]: r for r in metrics.per_class(df, [], 3).collect()}
    assert (got[1].precision, got[1].f1, got[2].precision, got[2].recall) == (0.0, 0.0, None, None)


def test_holm(spark):
    df = frame(spark, [("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.03), ("f", "d", None)], "family string, name string, p double")
    got = {r.name: r for r in inference.holm(df, ["family"]).collect()}
    assert got["a"].adjusted == pytest.approx(0.03) and got["a"].rejected and not got["b"].rejected
    assert got["b"].adjusted == pytest.approx(0.06) and got["d"].note == "undefined_p" and got["d"].adjusted is None


def test_variance_components_recover_planted(spark):
    rng = np.random.default_rng(1)
    rows = [(s, k, float(m + e)) for s, m in enumerate(rng.normal(0, 0.04, 400)) for k, e in enumerate(rng.normal(0, 0.02, 4))]
    got = inference.variance_components(frame(spark, rows, "subset_id int, seed int, y double"), []).first()
    assert got.icc == pytest.approx(0.8, abs=0.05)


def test_paired_difference_of_same_sides_is_not_significant(spark):
    rows = [(u, c, 1.0 if u % 3 else 0.0) for u in range(30) for c in "AB"]
    got = inference.paired_difference(frame(spark, rows, "u int, c string, v double"), "u", "v", "c", "A", "B", 30).first()
    assert (got.difference, got.p_value) == (0.0, 1.0)


def test_fail_closed(spark):
    pool = frame(spark, [(1,), (2,), (3,), (4,)], "image_id int")
    flags = frame(spark, [(1, True, False), (2, None, False), (3, True, True)], "image_id int, valid boolean, duplicate boolean")
    got = {r.image_id: (r.unsafe, r.reason) for r in select.fail_closed(pool, flags).collect()}
    assert got == {1: (False, None), 2: (True, "invalid"), 3: (True, "near_duplicate"), 4: (True, "invalid")}


def test_fill_targets(spark):
    counts = frame(spark, [("nv", 4000), ("mel", 190), ("vasc", 20)], "dx string, n int")
    assert {r.dx: r.target for r in select.fill_targets(counts, 300).collect()} == {"nv": 0, "mel": 110, "vasc": 280}


def test_floor_is_by_class(spark):
    rows = [(i, "mel", i * 0.003) for i in range(100)] + [(100 + i, "df", 0.7 + i * 0.003) for i in range(100)]
    df = frame(spark, rows, "image_id int, dx string, score double")
    assert {r.dx: r["count"] for r in select.class_floor(df, 0.25).groupBy("dx").count().collect()} == {"mel": 75, "df": 75}
    assert {r.dx for r in select.pooled_floor(df, 0.5).collect()} == {"df"}


def test_threshold_ties(spark):
    df = frame(spark, [(1, "a", 0.95)], "image_id int, dx string, score double")
    target = frame(spark, [("a", 1)], "dx string, target int")
    assert one(select.threshold_search(df, target, ties="higher"), "threshold") == 0.95
    assert one(select.threshold_search(df, target, ties="lower"), "threshold") == 0.0


def test_allocation_loses_nothing(spark):
    got = sampling.allocation(frame(spark, [("a", 10), ("b", 3), ("c", 1)], "dx string, n int")).groupBy("dx").agg(F.sum("groups").alias("g")).collect()
    assert {r.dx: r.g for r in got} == {"a": 10, "b": 3, "c": 1}


def test_adding_a_class_moves_no_group(spark):
    rows = [(g, "a") for g in range(40)]
    before = {r.group_id: r.split for r in sampling.stratified_groups(frame(spark, rows, "group_id int, dx string")).collect()}
    after = sampling.stratified_groups(frame(spark, rows + [(100 + g, "b") for g in range(20)], "group_id int, dx string"))
    assert before == {r.group_id: r.split for r in after.where("dx = 'a'").collect()}


def test_drivers_heuristics():
    v = [(g, (g % 2, int(g % 5 == 0))) for g in range(20)]
    got = sampling.greedy_counts({x: sum(w == x for _, w in v) for x in {w for _, w in v}}, {"a": 0.5, "b": 0.5})
    assert sum(got.values()) == 20 and sum(n for (_, s), n in got.items() if s == "a") == 10
    assert all(sum(n for (x, s), n in got.items() if s == "a" and x[k]) == sum(x[k] for _, x in v) / 2 for k in range(2))
    # a small split gets its own share of a rare label
    got = sampling.greedy_counts({(1, 0): 20, (0, 1): 380}, {"large": 0.9, "small": 0.1})
    assert got[(1, 0), "small"] == 2 and got[(0, 1), "small"] == 38
    pool = {(1, 0): 9, (0, 1): 2, (1, 1): 2, (0, 0): 7}
    take = sampling.matched_counts(pool, [4, 2], 8, 0.5, 0.125)
    assert sum(take.values()) == 8 and all(take[x] <= pool[x] for x in take)
    assert [sum(n * x[k] for x, n in take.items()) for k in range(2)] == [4, 2]


def test_ternary_domain(spark):
    df = frame(spark, [("1.0",), ("-1",), ("",), (None,), ("NaN",)], "v string").select(labels.normalize_ternary(F.col("v")).alias("x"))
    assert [r.x for r in df.collect()] == [1, -1, None, None, None]
    with pytest.raises(Exception, match="label outside"):
        frame(spark, [("2",)], "v string").select(labels.normalize_ternary(F.col("v"))).collect()


def test_attach_refuses(spark):
    left, right = frame(spark, [(1,), (2,)], "k int"), frame(spark, [(1, 1.0), (1, 2.0)], "k int, s double")
    with pytest.raises(ValueError, match="duplicate"):
        labels.attach(left, right, "k", ["s"])
    with pytest.raises(ValueError, match="without a row"):
        labels.attach(left, right.limit(1), "k", ["s"])


def test_texts(spark):
    df = frame(spark, [(["a"],), (["a", "b"],), (["a", "b", "c"],), ([],)], "v array<string>")
    assert [r[0] for r in df.select(text.natural_list(F.col("v"))).collect()] == ["a", "a and b", "a, b, and c", ""]
    ages = frame(spark, [("45",), ("0",), ("x",), (None,)], "v string")
    assert [r[0] for r in ages.select(text.age_bucket(F.col("v"))).collect()] == ["40-49-year-old", "adult", "adult", "adult"]


def test_gate_guards():
    with pytest.raises(ValueError):
        gate.refuse_raw(["explainability_raw_plausibility"])
    assert gate.admitted_columns(["b", "a"], {"a": "s", "b": "t"}, {"s"}) == ["a"]
    with pytest.raises(ValueError):
        gate.admitted_columns(["a"], {"a": "s"}, set())


def test_image_kernels():
    flat, ramp = np.full((20, 20), 7.0), np.tile(np.arange(20.0), (20, 1))
    assert signals.laplacian_variance(flat) == 0 and signals.border_uniform(flat) == 1.0
    assert signals.laplacian_variance(ramp) == pytest.approx(0.1)
    cam = np.zeros((4, 4))
    cam[1, 1] = 1
    assert signals.focus_area(cam) == 1 / 16 and signals.focus_area(np.zeros((4, 4))) is None


def test_bad_images_stay_as_rows(spark):
    df = frame(spark, [("a", [[1.0, 2.0], [3.0, 4.0]]), ("b", None), ("c", [[1.0], [2.0, 3.0]])], "k string, p array<array<double>>")
    assert {r.k: r.valid for r in signals.image_statistics(df, "p", "k").collect()} == {"a": True, "b": False, "c": False}


def test_pgm(spark):
    df = frame(spark, [("x", bytearray(b"P5 2 1 255\n\x01\x02")), ("y", bytearray(b"no"))], "path string, content binary")
    assert {r.path: r.pixels for r in signals.decode_images(df).collect()} == {"x": [[1.0, 2.0]], "y": None}


def test_clusters(spark):
    edges = frame(spark, [(1, 2), (2, 3), (3, 4), (4, 5), (8, 9)], "a long, b long")
    assert {r.node: r.cluster for r in vectors.clusters(edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8}


def test_clusters_of_a_chain_keep_plans_small(spark, monkeypatch):
    """A chain of shuffled names takes many rounds; no table of a round carries an estimate that grows by the rounds before."""
    names = [(k * 389) % 1009 for k in range(1, 1009)]
    digits, write, checkpoint = [], DataFrameWriter.parquet, DataFrame.checkpoint

    def seen(df):
        digits.append(len(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())))

    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path: (seen(self._df), write(self, path))[1])
    monkeypatch.setattr(DataFrame, "checkpoint", lambda self: (seen(self), checkpoint(self))[1])
    edges = frame(spark, list(zip(names, names[1:], strict=False)), "a long, b long")
    got = {r.node: r.cluster for r in vectors.clusters(edges).collect()}
    assert got == {k: 1 for k in range(1, 1009)}
    assert len(digits) > 4 and max(digits) < 300


def test_frechet_of_the_same_is_zero(spark):
    df = frame(spark, [([float(i), float(i * i % 7)],) for i in range(20)], "v array<double>")
    assert vectors.frechet(df, df, "v") == pytest.approx(0, abs=1e-6)
