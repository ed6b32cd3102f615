"""Prefix scans over groups of any size: against plain Python, and with no task that holds a group."""

import itertools
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tessella.functions import frames
from tessella.functions.frames import ranged, scanned
from tessella.operators import inference, metrics, sampling
from tessella.plans import ORACLES, QUERIES
from tessella.plans.registry import TABLES
from test_oracles import DATA, rows


def rows_of(seed, n, hot=0.9):
    rng = random.Random(seed)
    return [(i, "hot" if rng.random() < hot else rng.choice(("a", "b", None)), rng.choice((None, *range(40))), rng.randint(-5, 5)) for i in range(n)]


@pytest.mark.parametrize("parts", [None, 1, 3, 16])
def test_scan_is_plain_python(spark, parts):
    data = rows_of(parts or 0, 700)
    df = spark.createDataFrame(data, "id long, g string, x int, v int")
    got = scanned(df, ["g"], [F.col("x").desc_nulls_last(), F.col("id")], rank="r", sums={"s": "v", "k": F.when(F.col("v") > 0, 1)}, totals={"t": "v"}, highest={"h": "v"}, lowest_on={"l": "v"}, parts=parts)
    got = {r.id: tuple(r)[4:] for r in got.collect()}
    assert len(got) == 700
    for g in ("hot", "a", "b", None):
        own = sorted((r for r in data if r[1] == g), key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))
        v = [r[3] for r in own]
        for k, r in enumerate(own):
            some = sum(x > 0 for x in v[: k + 1]) or None
            assert got[r[0]] == (sum(v[: k + 1]), some, k + 1, sum(v), max(v[: k + 1]), min(v[k:]))


def test_a_hot_group_lies_in_many_ranges(spark):
    df = spark.createDataFrame(rows_of(1, 4000), "id long, g string, x int, v int")
    held = ranged(df, ["g"], [F.col("x"), F.col("id")], 16).groupBy("part_", "g").count()
    most = held.agg(F.max("count")).first()[0]
    assert most < 2.5 * 4000 / 16 and held.where("g = 'hot'").count() >= 12


def test_a_large_family_of_corrections(spark, monkeypatch):
    monkeypatch.setattr(frames, "ROWS", 1000)
    n = 100_000
    p = spark.range(n).select(F.lit("all").alias("family"), F.col("id").alias("name"), (F.pmod(F.xxhash64("id"), F.lit(10**9)) / 1e9).alias("p"))
    for f, plain in ((inference.holm, lambda s: list(itertools.accumulate((min(1.0, x * (n - k)) for k, x in enumerate(s)), max))), (inference.benjamini_hochberg, lambda s: list(itertools.accumulate((min(1.0, x * n / (n - k)) for k, x in enumerate(reversed(s))), min))[::-1])):
        out = f(p, ["family"])
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "windowspecdefinition(part_" in plan and "RepartitionByExpression" not in plan  # windows by range; the ranges are cut already
        got = [r.adjusted for r in out.orderBy("p", "name").select("adjusted").collect()]
        assert got == pytest.approx(plain(sorted(r.p for r in p.select("p").collect())), abs=1e-12)


def test_empty_tables_and_ties(spark):
    none = spark.createDataFrame([], "id long, g string, x int, v int")
    assert scanned(none, ["g"], [F.col("x")], rank="r", totals={"t": "v"}).collect() == []
    df = spark.createDataFrame([(i, "a", 1.0 if i < 6 else 2.0) for i in range(8)], "id long, g string, x double")
    assert sorted(r.mid_rank for r in metrics.with_mid_rank(df, "x", ["g"]).collect()) == [3.5] * 6 + [7.5] * 2
    assert sorted(r.r for r in scanned(df, [], [F.col("x")], rank="r").collect()) == list(range(1, 9))


SCANNED = ["st1_auroc", "st17_auroc_estimates", "wn1_top_k_per_class", "wn4_top_share", "se18_random_matched", "se18_select_filled", "gt8_usefulness"]


@pytest.mark.parametrize("name", SCANNED)
def test_queries_give_the_same_by_ranges(spark, monkeypatch, name):
    """No group fits a task, so all are scanned over ranges; the oracle's rows all the same."""
    monkeypatch.setattr(frames, "ROWS", 5)
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    want = duck.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(want.fetchall(), names)


def test_draws_and_centring_by_ranges(spark, monkeypatch):
    rng = random.Random(4)
    df = spark.createDataFrame([(rng.choice("ab"), rng.choice((None, 1, 2)), k % 40, float(rng.randint(0, 9))) for k in range(400)], "metric string, size int, subset_id int, y double")
    pool = spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(300)], "group_id int, p int, q int")

    def both():
        parts = {r.metric: tuple(r)[1:] for r in inference.variance_components(df, ["metric"], centre=["size"]).collect()}
        return parts, sorted(tuple(r) for r in sampling.matched_draw(pool, ["p", "q"], [40, 30], 80, 0.3, 0.5).collect())

    (parts, drawn), _ = both(), monkeypatch.setattr(frames, "ROWS", 5)
    other, again = both()
    assert drawn == again and len(drawn) == 80
    for m, x in parts.items():
        assert other[m] == pytest.approx(x)
