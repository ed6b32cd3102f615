"""Contracts, budgets, designs and the remaining joins over the stand-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import contracts
from tessella.plans.evaluation import MEASURED
from tessella.plans.registry import Tables, register
from tessella.plans.selection import rounded


@register("jn3_optional_left_merge", "SELECT p.image_id, p.score, f.duplicate FROM pool p LEFT JOIN flags f ON p.image_id = f.image_id")
def jn3(t: Tables):
    return t.pool.select("image_id", "score").join(t.flags.select("image_id", "duplicate"), "image_id", "left")


@register("jn5_truth_alignment", "SELECT p.image_id, p.predicted, c.c_mktsegment AS truth FROM predictions p LEFT JOIN customer c ON p.lesion_id = c.c_custkey WHERE p.seed = 2")
def jn5(t: Tables):
    truth = t.customer.select(F.col("c_custkey").alias("lesion_id"), F.col("c_mktsegment").alias("truth"))
    return t.predictions.where("seed = 2").join(truth, "lesion_id", "left").select("image_id", "predicted", "truth")


@register("pf18_split_metadata", "SELECT label AS split, count(*) AS n, sha256(string_agg(CAST(row_id AS VARCHAR), chr(10) ORDER BY CAST(row_id AS VARCHAR))) AS ids_hash FROM scored GROUP BY 1")
def pf18(t: Tables):
    return contracts.split_metadata(t.scored.withColumnRenamed("label", "split"), "row_id")


@register("pf21_forbidden_mentions", "SELECT event_id, '$.k' AS path FROM events WHERE json_extract_string(props, '$.k') = '42'")
def pf21(t: Tables):
    return contracts.forbidden_paths(t.events, "props", "event_id", 42)


@register("pf28_provenance_columns", "SELECT count(*) AS n, count(DISTINCT image_id) = count(*) AS unique_ids, bool_and(score >= 0) AS uniform FROM pool")
def pf28(t: Tables):
    return t.pool.agg(F.count(F.lit(1)).alias("n"), (F.count_distinct("image_id") == F.count(F.lit(1))).alias("unique_ids"), F.every(F.col("score") >= 0).alias("uniform"))


EVIDENCE = "SELECT position AS dx, CAST(sum(CASE WHEN context_id % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS train, CAST(sum(CASE WHEN context_id % 2 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS held_out, avg(CASE WHEN context_id % 3 = 0 THEN utility END) AS network, avg(CASE WHEN context_id % 3 = 1 THEN utility END) AS baseline FROM (" + MEASURED + ") m GROUP BY position"


@register("se22_official_method", f"WITH e AS ({EVIDENCE}), n AS (SELECT count(*) // 4 AS least FROM orders) SELECT dx, CASE WHEN train >= least AND held_out >= least AND network > baseline THEN 'network' WHEN train >= least AND held_out >= least THEN 'measured' ELSE 'baseline' END AS method FROM e, n")
def se22(t: Tables):
    return contracts.official_method(t.sql(EVIDENCE), t.orders.count() // 4).select("dx", "method")


@register("se24_acceptance", "WITH e AS (SELECT dx, avg(score) AS value FROM pool GROUP BY dx) SELECT dx AS name, CASE WHEN dx < '4' THEN value >= 0.5 ELSE value <= 0.5 END AS accepted FROM e UNION ALL SELECT '9-NONE', false")
def se24(t: Tables):
    evidence = t.pool.groupBy(F.col("dx").alias("name")).agg(F.avg("score").alias("value"))
    names = evidence.select("name").unionByName(t.spark.createDataFrame([("9-NONE",)], "name string"))
    criteria = names.withColumns({"comparison": F.when(F.col("name").between("4", "8"), "<=").otherwise(">="), "bound": F.lit(0.5)})
    return contracts.accepted(evidence, criteria).select("name", "accepted")


@register("se29_budget", "SELECT p_partkey, p_size * 9 AS runs, p_size * 9 * 0.5::DOUBLE AS hours, p_size * 9 * 0.5 <= 100 AS within FROM part")
def se29(t: Tables):
    plan = t.part.select("p_partkey", F.col("p_size").alias("policies"), F.lit(3).alias("seeds"), F.lit(3).alias("folds"))
    return contracts.budget(plan, 0.5, 100).select("p_partkey", "runs", "hours", "within")


@register("se30_feasibility", "WITH b AS (SELECT dx, greatest(1, CAST(ceil((r - 1) * 3 / CAST(greatest(n - 1, 1) AS DOUBLE) - 1e-12) AS BIGINT)) AS band FROM (SELECT dx, row_number() OVER (PARTITION BY dx ORDER BY score, image_id) AS r, count(*) OVER (PARTITION BY dx) AS n FROM pool)), c AS (SELECT dx, band, count(*) AS n FROM b GROUP BY 1, 2) SELECT dx, band, n, n >= 1010 AS feasible, concat_ws(',', CASE WHEN n < 60 THEN '60' END, CASE WHEN n < 990 THEN '990' END, CASE WHEN n < 1010 THEN '1010' END) AS too_large FROM c")
def se30(t: Tables):
    return contracts.feasibility_report(t.pool, [60, 990, 1010], 3)


UNIT_HASH = "CAST('0x' || substr(h, 1, 8) AS BIGINT)"


@register("sm5_subset_design", f"WITH n AS (SELECT count(*) AS n FROM pool), r AS (SELECT image_id, row_number() OVER (ORDER BY score, image_id) - 1 AS pos FROM pool), b AS (SELECT image_id, greatest(1, ceil(pos * 3 / greatest(n - 1, 1)::DOUBLE - 1e-12)) AS band FROM r, n), e AS (SELECT k, band, -ln(({UNIT_HASH} + 1) / 4294967297.0::DOUBLE) AS w FROM (SELECT k, band, sha256(concat_ws(':', '0', 'mixture', k, band)) AS h FROM (SELECT unnest(generate_series(0, 3)) AS k), (SELECT unnest([1, 2, 3]) AS band))), i AS (SELECT k, band, round(60 * w / sum(w) OVER (PARTITION BY k), 9) AS ideal FROM e), m AS (SELECT 'mixture' AS role, k, band, floor(ideal) + CASE WHEN row_number() OVER (PARTITION BY k ORDER BY ideal - floor(ideal) DESC, band) <= 60 - sum(floor(ideal)) OVER (PARTITION BY k) THEN 1 ELSE 0 END AS take FROM i), p AS (SELECT * FROM m UNION ALL SELECT 'random', k, 0, 60 FROM generate_series(0, 3) g(k) UNION ALL SELECT 'band', k, k % 3 + 1, 60 FROM generate_series(0, 3) g(k)), a AS (SELECT image_id, 0 AS band FROM pool UNION ALL SELECT image_id, band FROM b), d AS (SELECT role, k, p.band, take, image_id, sha256(concat_ws(':', '0', role, k, image_id)) AS h FROM a JOIN p ON a.band = p.band), x AS (SELECT *, row_number() OVER (PARTITION BY role, k, band ORDER BY h, image_id) AS r FROM d, n WHERE {UNIT_HASH} / 4294967296.0::DOUBLE < (4.0 * 60 + 64) / CASE WHEN band = 0 THEN n ELSE n / 3 END) SELECT role || '-' || k AS subset_id, role, image_id FROM x WHERE r <= take")
def sm5(t: Tables):
    return contracts.subset_design(t.pool, 4, 60)


@register("ag28_recipe_statistics", "SELECT dx, count(*) AS emitted, round(avg(CASE WHEN score > 0.5 THEN 1.0 ELSE 0 END), 6) AS high_share FROM pool GROUP BY 1")
def ag28(t: Tables):
    return rounded(t.pool.groupBy("dx").agg(F.count(F.lit(1)).alias("emitted"), F.avg((F.col("score") > 0.5).cast("double")).alias("high_share")), "high_share")
