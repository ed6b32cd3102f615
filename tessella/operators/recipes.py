"""Multi-label recipes: which label combinations are allowed, and how many rows of each fill the labels' quotas."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.hashing import seeded, seeded_int


# fixed values: where candidates are from, and what is said of them
ALLOWED, MINED, SINGLE = "medical_rule_allow", "empirical_cooccurrence", "single_label_guaranteed"
ACCEPTED = {ALLOWED: "accepted_medical_rule_allow", MINED: "accepted_empirical_support", SINGLE: "accepted_single_label_below_support_but_required_for_coverage"}
BLOCKED, TOO_MANY = "medical_rule_block:", "exceeds_max_positive_labels:"


def decisions(mined: DataFrame, labels: list[str], most: int, allow: list[list[str]], block: list[list[str]]) -> DataFrame:
    """(combination, origin, accepted, reason, support) of every candidate combination (sorted array).

    ``mined``: combination, support; those of more than ``most`` labels aren't candidates. Every
    single label is one, so that rare ones can be reached, and so are the allowed combinations,
    which no block refuses. A block refuses what holds all its labels; the first one is named.
    """
    spark = mined.sparkSession
    given = [(sorted(r), "allow") for r in allow if r] + [([x], "single") for x in labels]
    fixed = spark.createDataFrame(given, "combination array<string>, given string").groupBy("combination").agg(F.min("given").alias("given"))  # allow before single
    rows = mined.join(fixed, "combination", "full").withColumn("support", F.coalesce("support", F.lit(0)))
    rows = rows.where(F.col("given").isNotNull() | (F.size("combination") <= most))
    origin = F.when(F.col("given") == "allow", ALLOWED).when(F.col("support") > 0, MINED).otherwise(SINGLE)
    rules = [sorted(r) for r in block if r]
    hit = F.coalesce(*[F.when(F.size(F.array_except(F.array(*[F.lit(x) for x in r]), "combination")) == 0, F.lit(BLOCKED + ",".join(r))) for r in rules]) if rules else F.lit(None).cast("string")
    rows = rows.withColumn("origin", origin).withColumn("refused", F.when(F.col("origin") != ALLOWED, hit))
    refused = F.coalesce("refused", F.when(F.size("combination") > most, f"{TOO_MANY}{most}"))
    reason = F.element_at(F.create_map(*[F.lit(x) for pair in ACCEPTED.items() for x in pair]), F.col("origin"))
    return rows.select("combination", "origin", refused.isNull().alias("accepted"), F.coalesce(refused, reason).alias("reason"), "support")


def plan(combinations: list[tuple[str, ...]], quotas: dict[str, int], single_share: float, none_share: float, seed: object = 0) -> dict[tuple[str, ...], int]:
    """How many recipes of each combination meet every label's quota, and how many without a label make up their share.

    Each round draws as many recipes as the least unmet quota asks for, so none is passed by more than a
    round's single recipe could: single and multiple labels by their shares, and of these the combinations that
    serve an unmet quota evenly (any, where none of a kind does); what doesn't divide is dealt by hashes of seed and round.
    Rounds grow with labels and the logarithm of quotas (driver); quotas that no combination serves raise.
    """
    lacking = {k for k, n in quotas.items() if n} - {x for c in combinations for x in c}
    if lacking:
        raise ValueError(f"no combination holds {sorted(lacking)}")
    single, multi = ([c for c in sorted(combinations) if (len(c) == 1) == one] for one in (True, False))
    left, out, step = dict(quotas), {}, 0
    draw = lambda what: int(hashlib.sha256(f"{seed}:{step}:{what}".encode()).hexdigest()[:8], 16) / 2**32
    serves = lambda c: any(left.get(x, 0) > 0 for x in c)
    while any(n > 0 for n in left.values()):
        if not any(map(serves, [*single, *multi])):
            raise ValueError("quotas can't be met")
        n = min(x for x in left.values() if x > 0)
        share = 1.0 if not multi else 0.0 if not single else single_share
        ones = int(n * share + draw("kind"))
        for pool, many in ((single, ones), (multi, n - ones)):
            some = sorted((c for c in pool if serves(c)), key=lambda c: draw(c)) or sorted(pool, key=lambda c: draw(c))
            for k, c in enumerate(some):
                if m := many // len(some) + (k < many % len(some)):
                    out[c] = out.get(c, 0) + m
        for x in left:
            left[x] = max(0, quotas[x] - sum(m for c, m in out.items() if x in c))
        step += 1
    total = sum(quotas.values())
    out[()] = round(total / max(1 - none_share, 1e-6)) - total
    return out


def recipes(spark, counts: dict[tuple[str, ...], int], ages: list[int], sexes: list[str], device_share: float, seed: object = 0) -> DataFrame:
    """A row a recipe in seeded order: recipe_id, combination, age, sex, support_devices, image_seed, all from hashes of its number."""
    rows = spark.createDataFrame([(list(c), n) for c, n in counts.items() if n], "combination array<string>, n int")
    rows = rows.withColumn("slot", F.explode(F.sequence(F.lit(1), "n"))).withColumn("recipe_id", seeded(seed, F.array_join("combination", "|"), "slot"))
    pick = lambda what, values: F.get(F.array(*[F.lit(v) for v in values]), (seeded_int(f"{seed}:{what}", "recipe_id") % len(values)).cast("int"))
    device = seeded_int(f"{seed}:device", "recipe_id") / float(1 << 32) < device_share
    return rows.select("recipe_id", "combination", pick("age", ages).alias("age"), pick("sex", sexes).alias("sex"), device.alias("support_devices"), seeded_int(seed, "recipe_id").alias("image_seed"))


def statistics(made: DataFrame, labels: list[str]) -> DataFrame:
    """One row: recipes, single, multi and without label, and of each label how many were emitted (map)."""
    n = F.size("combination")
    emitted = F.map_from_arrays(F.array(*[F.lit(x) for x in labels]), F.array(*[F.count_if(F.array_contains("combination", x)) for x in labels]))
    return made.agg(F.count(F.lit(1)).alias("n_recipes"), F.count_if(n == 1).alias("single"), F.count_if(n > 1).alias("multi"), F.count_if(n == 0).alias("none"), emitted.alias("emitted"))
