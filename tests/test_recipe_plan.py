"""Recipe plans in rounds: quotas met, shares kept, rounds by the logarithm of quotas; hash-order cuts."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tessella.functions.hashing import seeded
from tessella.operators import recipes, sampling


@pytest.mark.parametrize("seed", range(8))
def test_quotas_are_met(seed):
    rng = random.Random(seed)
    labels = "abcdef"[: rng.randint(2, 6)]
    combinations = [(x,) for x in labels] + [tuple(sorted(rng.sample(labels, 2))) for _ in range(4)]
    quotas = {x: rng.choice((0, 1, 7, 300)) for x in labels}
    made = recipes.plan(sorted(set(combinations)), quotas, 0.4, 0.1, seed)
    held = {x: sum(n for c, n in made.items() if x in c) for x in labels}
    assert all(held[x] >= n for x, n in quotas.items())
    assert sum(n for c, n in made.items() if c) <= sum(quotas.values()) + len(labels)  # never more than one label a recipe would take
    assert made == recipes.plan(sorted(set(combinations)), quotas, 0.4, 0.1, seed)


def test_work_does_not_grow_with_quotas():
    combinations = [("a",), ("b",), ("c",), ("a", "b"), ("b", "c")]
    began = time.time()
    made = recipes.plan(combinations, {"a": 10**9, "b": 3 * 10**8, "c": 5}, 0.5, 0.0)
    assert time.time() - began < 5
    assert all(sum(n for c, n in made.items() if x in c) >= q for x, q in (("a", 10**9), ("b", 3 * 10**8), ("c", 5)))
    single = sum(n for c, n in made.items() if len(c) == 1)
    assert 0.4 < single / sum(made.values()) < 0.6


@pytest.mark.parametrize("most", [-1, 0, 1, 5, 99, 1000, 10**6])
def test_cuts_in_hash_order(spark, most):
    rows = spark.range(700).select(F.col("id").alias("k"), (F.col("id") % 3 + 1).alias("n"))
    order = rows.select("k", "n", seeded(1, F.lit("x"), "k").alias("h")).orderBy("h", "k").collect()
    want, total = set(), 0
    for r in order:
        if total >= most:
            break
        want.add(r.k)
        total += r.n
    assert {r.k for r in sampling.upto(rows, "n", most, "k", 1, F.lit("x")).collect()} == want
