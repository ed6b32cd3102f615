"""Bootstrap by splitting: exact totals, the spread of a plain bootstrap, and nothing of the draws in a join or shuffle."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import comparison, resampling
from tessella.plans.comparison import SEED
from tessella.plans.registry import Tables

DATA = "/root/testdata/sf0.001"


def one_and_y():
    return {"n": F.lit(1), "s": F.col("y")}


def table(spark, n=400, seed=0):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(int(u), "ab"[int(g)], float(u % 7 + rng.normal())) for u, g in zip(rng.integers(0, n, 5 * n), rng.integers(0, 2, 5 * n), strict=True)], "unit int, g string, y double")


@pytest.mark.parametrize("n, block", [(1, 4), (5, 4), (37, 4), (400, 64)])
def test_weights_add_up(monkeypatch, n, block):
    monkeypatch.setattr(resampling, "BLOCK", block)
    for f in (resampling._left, resampling._count, resampling.weights):
        f.cache_clear()
    w = np.concatenate([resampling.weights(3, n, k, 300) for k in range(-(-n // block))], axis=1)
    assert w.shape == (301, n) and (w.sum(axis=1) == n).all() and (w[0] == 1).all()
    assert n == 1 or abs(w[1:].var(axis=0).mean() - (1 - 1 / n)) < 0.1  # of a multinomial with equal chances
    if n == 400:
        pair = np.cov(w[1:, 0::2].sum(axis=1), w[1:, 1::2].sum(axis=1))[0, 1]
        assert pair < 0 and abs(pair + n / 4) < 0.4 * n / 4
    for f in (resampling._left, resampling._count, resampling.weights):
        f.cache_clear()


def test_intervals_are_those_of_a_plain_bootstrap(spark):
    df = table(spark)
    got = {r.g: r for r in resampling.bootstrap(df, "unit", ["g"], one_and_y(), F.col("s") / F.nullif(F.col("n"), F.lit(0.0)), 800, 5).collect()}
    rows = df.toPandas()
    units = rows["unit"].unique()
    for g in "ab":
        own = rows[rows["g"] == g].groupby("unit")["y"].agg(["sum", "count"]).reindex(units).fillna(0).to_numpy()
        rng = np.random.default_rng(1)
        w = rng.multinomial(len(units), np.full(len(units), 1 / len(units)), 4000)
        plain = (w @ own[:, 0]) / (w @ own[:, 1])
        low, high = np.percentile(plain, [2.5, 97.5])
        assert got[g].estimate == pytest.approx(own[:, 0].sum() / own[:, 1].sum())
        assert abs(got[g].low - low) < 0.15 * (high - low) and abs(got[g].high - high) < 0.15 * (high - low) and got[g].n_draws == 800


def test_draws_do_not_depend_on_partitions_and_total_the_units(spark):
    df = table(spark, 3000, 2)
    n = df.select("unit").distinct().count()
    once = df.dropDuplicates(["unit"])
    totals = [r.n for r in resampling.resampled(once, "unit", [], {"n": F.lit(1)}, 50, 1).collect()]
    assert totals == [n] * 51
    one, other = ({(r.g, r.b): (r.n, round(r.s, 6)) for r in resampling.resampled(x, "unit", ["g"], one_and_y(), 20, 4).collect()} for x in (df, df.repartition(7).orderBy(F.rand(3))))
    assert one == other
    plan = resampling.resampled(df, "unit", ["g"], one_and_y(), 20, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan.partition("MapInPandas")[0] and "Join" not in plan.partition("MapInPandas")[2]  # units are checkpointed with their numbers


def test_difference_and_any_metric(spark):
    rng = np.random.default_rng(8)
    rows = [(i, s, int(rng.integers(0, 3)), 0) for i in range(500) for s in ("A", "B")]
    rows = [(u, s, t, t if rng.random() < (0.9 if s == "A" else 0.6) else int(rng.integers(0, 3))) for u, s, t, _ in rows]
    df = spark.createDataFrame(rows, "unit int, side string, t int, p int")
    sums, metric = resampling.f1_macro([0, 1, 2])
    r = resampling.bootstrap_difference(df, "unit", "side", "A", "B", sums("t", "p"), metric, 200, 1).first()
    assert 0.1 < r.low < r.estimate < r.high < 0.4 and r.p_value == 0.0
    same = resampling.bootstrap_difference(df.withColumn("p", F.col("t")), "unit", "side", "A", "B", sums("t", "p"), metric, 50, 1).first()
    assert (same.estimate, same.low, same.high, same.p_value) == (0.0, 0.0, 0.0, 1.0)
    assert resampling.bootstrap(df.limit(0), "unit", ["side"], {"n": F.lit(1)}, F.col("n"), 5).collect() == []


def drawn(units: list, replicates: int) -> dict:
    """Each unit's weights, b = 0 first, by the same splits."""
    n = len(units)
    w = np.concatenate([resampling.weights(SEED, n, k, replicates) for k in range(-(-n // resampling.BLOCK))], axis=1)
    return {u: w[:, k] for k, u in enumerate(sorted(units))}


def test_compared_conditions_by_splits_equal_a_loop_over_rows(spark):
    """All metrics of all resamples of all predictions, against weighted rows in plain Python."""
    rows = [r.asDict() for r in Tables(spark, DATA).predictions.collect()]
    by, replicates = drawn({r["lesion_id"] for r in rows}, 12), 12
    cells: dict = {}
    for r in rows:
        cell = cells.setdefault((r["condition"], r["seed"]), np.zeros((replicates + 1, 5, 5)))
        cell[:, r["true_class"], r["predicted"]] += by[r["lesion_id"]]
    want: dict = {}
    for (condition, _), cell in cells.items():
        for b in range(replicates + 1):
            m = cell[b]
            there = m.sum(axis=1) > 0
            hits, support, claimed = np.diag(m)[there], m.sum(axis=1)[there], m.sum(axis=0)[there]
            each = {"balanced_accuracy": (hits / support).mean(), "macro_f1": (2 * hits / (support + claimed)).mean(), "accuracy": hits.sum() / support.sum()}
            each |= {f"recall_{k}": h / s for k, h, s in zip(np.flatnonzero(there), hits, support, strict=True)}
            for metric, value in each.items():
                want.setdefault((b, condition, metric), []).append(value)
    got = comparison.resampled(Tables(spark, DATA).predictions, "lesion_id", replicates, SEED, split=True).collect()
    assert len(got) == len(want)
    for r in got:
        assert r.value == pytest.approx(np.mean(want[r.b, r.condition, r.metric])), r


def test_subsets_by_splits_equal_plain_analysis_of_variance(spark):
    rows = Tables(spark, DATA).repeats.toPandas()
    groups, replicates = {u: g["y"].to_numpy() for u, g in rows.groupby("subset_id")}, 30
    by = drawn(list(groups), replicates)
    cells = spark.createDataFrame([(int(u), len(y), float(y.mean()), float(y.var())) for u, y in groups.items()], "unit long, n long, m double, v double")
    got = {r.b: r for r in comparison.resampled_components(cells, replicates, SEED, split=True).collect()}
    assert set(got) == set(range(1, replicates + 1))
    for b, r in got.items():
        many = [y for u, y in groups.items() for _ in range(by[u][b])]
        k, total, grand = len(many), sum(map(len, many)), np.concatenate(many).mean()
        within = sum(((y - y.mean()) ** 2).sum() for y in many) / (total - k)
        between = (sum(len(y) * (y.mean() - grand) ** 2 for y in many) / (k - 1) - within) / (total / k)
        assert (r.within, r.between) == pytest.approx((within, between))
        assert r.icc == pytest.approx(max(between, 0) / (max(between, 0) + within))


def test_splits_and_lists_of_draws_agree(spark):
    """Intervals of the same differences from either kind of draws; what isn't drawn is equal."""
    t = Tables(spark, DATA)
    one, other = ({r.name: r for r in comparison.compare(t.predictions, comparison.PROTOCOLS["v1"], "lesion_id", 150, SEED, split=s).collect()} for s in (False, True))
    assert set(one) == set(other)
    wide = [abs(one[n].low - other[n].low) + abs(one[n].high - other[n].high) - 0.5 * (one[n].high - one[n].low) for n in one]
    assert all(one[n].difference == pytest.approx(other[n].difference) and one[n].family == other[n].family for n in one) and max(wide) < 0
