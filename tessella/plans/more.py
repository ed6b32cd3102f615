"""Joins, windows, checks and selection steps with entries of their own over the stand-ins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessella.functions.frames import numbered
from tessella.operators import contracts, gate, inference, labels, metrics, recipes, sampling, select, signals, valuation, vectors
from tessella.plans.evaluation import PROBS
from tessella.plans.registry import Tables, register
from tessella.plans.selection import CAND, COUNTS, SAFE, UNIT, halves, rounded
from tessella.plans.storage import BOXES

P_VALUES = "SELECT c_mktsegment AS family, c_custkey AS name, CASE WHEN c_custkey % 10 <> 0 THEN CAST(c_custkey % 97 AS DOUBLE) / 1000 END AS p FROM customer"


@register("jn9_class_references", f"WITH {CAND} SELECT vec_id, any_value(tier) AS tier, count(*) AS n_references FROM p GROUP BY vec_id")
def jn9(t: Tables):
    c, r = halves(t)
    return vectors.knn_scores(c, r, "vec_id", "label", "embedding").select("vec_id", "tier", "n_references")


@register("jn11_class_peers", "SELECT a.vec_id, count(b.vec_id) AS n_peers FROM embeddings a LEFT JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY 1")
def jn11(t: Tables):
    return vectors.distinctiveness(t.embeddings, "vec_id", "label", "embedding").select("vec_id", "n_peers")


@register("jn12_membership", "SELECT image_id, count(*) AS n_in, (SELECT count(*) FROM subsets) - count(*) AS n_out FROM members JOIN subsets USING (subset_id) GROUP BY 1")
def jn12(t: Tables):
    n = t.subsets.agg(F.count(F.lit(1)).alias("n"))
    own = valuation.banzhaf(t.subsets, t.members).select("image_id", "exposures")
    return own.crossJoin(F.broadcast(n)).select("image_id", F.col("exposures").alias("n_in"), (F.col("n") - F.col("exposures")).alias("n_out"))


@register("jn18_exact_boxes", "SELECT CAST(s_suppkey AS VARCHAR) AS image_id, round((0.5 + (s_suppkey % 5) / 10)::DOUBLE, 6) AS y1 FROM supplier")
def jn18(t: Tables):
    c = t.supplier.select(F.col("s_suppkey").cast("string").alias("image_id"))
    return rounded(labels.attach(c, t.sql(BOXES), "image_id", ["y1"]), "y1")


@register("jn19_class_from_manifest", "SELECT image_id, dx, f.duplicate FROM flags f JOIN pool p USING (image_id)")
def jn19(t: Tables):
    return labels.attach(t.flags.select("image_id", "duplicate"), t.pool, "image_id", ["dx"]).select("image_id", "dx", "duplicate")


@register("jn21_uncalibrated_class", "SELECT image_id, dx, dx <> '5-LOW' AS calibrated, dx = '5-LOW' AS is_null FROM pool WHERE image_id % 2 = 0")
def jn21(t: Tables):
    rows = signals.typicality(t.pool.where("image_id % 2 = 0"), t.pool.where("image_id % 2 = 1 AND dx <> '5-LOW'"), "dx", "score")
    return rows.select("image_id", "dx", "calibrated", F.col("typicality").isNull().alias("is_null"))


@register("wn6_top_similarities", f"WITH {CAND}, k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, ref) AS r FROM p) SELECT vec_id, round(avg(s), 6) AS mean, round(max(s), 6) AS top, round(max(s) - min(s), 6) AS spread, round(max(s) - avg(CASE WHEN r > 1 THEN s END), 6) AS gap FROM k WHERE r <= 3 GROUP BY vec_id")
def wn6(t: Tables):
    c, r = halves(t)
    rows = vectors.knn_scores(c, r, "vec_id", "label", "embedding", k=3)
    return rounded(rows.select("vec_id", F.col("knn_mean").alias("mean"), F.col("top1").alias("top"), F.col("topk_spread").alias("spread"), F.col("top1_gap").alias("gap")), "mean", "top", "spread", "gap")


@register("wn7_mid_ranks", "SELECT image_id, rank() OVER (PARTITION BY dx ORDER BY score) + (count(*) OVER (PARTITION BY dx, score) - 1) / 2.0::DOUBLE AS mid_rank FROM pool")
def wn7(t: Tables):
    return metrics.with_mid_rank(t.pool, "score", ["dx"]).select("image_id", F.col("mid_rank").cast("double"))


@register("wn10_cumulative_precision", "WITH b AS (SELECT * FROM scored WHERE mask) SELECT row_id, label, CAST(row_number() OVER w AS INT) AS rank, round(sum(CASE WHEN target = 1 THEN 1.0::DOUBLE ELSE 0 END) OVER (PARTITION BY label ORDER BY score DESC, row_id ROWS UNBOUNDED PRECEDING) / row_number() OVER w, 6) AS precision FROM b WINDOW w AS (PARTITION BY label ORDER BY score DESC, row_id)")
def wn10(t: Tables):
    return rounded(metrics.cumulative_precision(t.scored.where("mask"), ["label"]).select("row_id", "label", "rank", "precision"), "precision")


MASSES = "[s_suppkey % 3 + 1, 2, 5, 1, s_suppkey % 4 + 1]"


@register("wn11_focus_growth", f"WITH RECURSIVE m AS (SELECT s_suppkey, list_transform({MASSES}, lambda x: x::DOUBLE / list_sum({MASSES})) AS p FROM supplier), s AS (SELECT s_suppkey, p, CASE WHEN p[1] >= 0.5 THEN 1 WHEN p[1] + p[2] >= 0.5 THEN 2 WHEN p[1] + p[2] + p[3] >= 0.5 THEN 3 WHEN p[1] + p[2] + p[3] + p[4] >= 0.5 THEN 4 ELSE 5 END AS k FROM m), g(s_suppkey, p, a, b, held) AS (SELECT s_suppkey, p, k, k, p[k] FROM s UNION ALL SELECT s_suppkey, p, CASE WHEN coalesce(p[nullif(a - 1, 0)], -1) >= coalesce(p[b + 1], -1) THEN a - 1 ELSE a END, CASE WHEN coalesce(p[nullif(a - 1, 0)], -1) >= coalesce(p[b + 1], -1) THEN b ELSE b + 1 END, held + greatest(coalesce(p[nullif(a - 1, 0)], -1), coalesce(p[b + 1], -1)) FROM g WHERE held < sqrt(0.8) AND b - a < 4) SELECT s_suppkey, round(max(b - a + 1) / 5.0::DOUBLE, 6) AS area FROM g GROUP BY 1")
def wn11(t: Tables):
    def area(frames):
        for f in frames:
            yield f[["s_suppkey"]].assign(area=[signals.focus_area(np.array(list(m), dtype=float)[:, None]) for m in f["m"]])

    k = F.col("s_suppkey")
    masses = F.array(*[F.lit(x).cast("double") if isinstance(x, int) else x.cast("double") for x in (k % 3 + 1, 2, 5, 1, k % 4 + 1)])
    return rounded(t.supplier.select("s_suppkey", masses.alias("m")).mapInPandas(area, "s_suppkey long, area double"), "area")


@register("wn12_running_extremes", f"WITH x AS ({P_VALUES}), h AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, name) AS k, count(*) OVER (PARTITION BY family) AS n FROM x WHERE p IS NOT NULL) SELECT family, name, round(max(least(1.0, p * (n - k + 1))) OVER (PARTITION BY family ORDER BY k), 6) AS step_down, round(min(least(1.0, p * n / k)) OVER (PARTITION BY family ORDER BY k DESC), 6) AS step_up FROM h")
def wn12(t: Tables):
    p = t.sql(P_VALUES).where("p is not null")
    down = inference.holm(p, ["family"]).select("family", "name", F.col("adjusted").alias("step_down"))
    return rounded(down.join(inference.benjamini_hochberg(p, ["family"]).select("family", "name", F.col("adjusted").alias("step_up")), ["family", "name"]), "step_down", "step_up")


@register("wn15_class_order", "SELECT dx, count(*) AS n, row_number() OVER (ORDER BY dx) - 1 AS place FROM pool GROUP BY dx")
def wn15(t: Tables):
    return numbered(t.pool.groupBy("dx").agg(F.count(F.lit(1)).alias("n")), [F.col("dx")], "place")


@register("sm4_heads", "WITH r AS (SELECT user_id, event_type AS label, min(event_id) AS first_id FROM events GROUP BY 1, 2), h AS (SELECT user_id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY first_id) AS k FROM r) WHERE k <= 7), p AS (SELECT user_id FROM (SELECT user_id, min(first_id) AS first_id FROM r GROUP BY 1) ORDER BY first_id LIMIT 7) SELECT user_id FROM h UNION SELECT user_id FROM p")
def sm4(t: Tables):
    rows = t.events.groupBy("user_id", F.col("event_type").alias("label")).agg(F.min("event_id").alias("at"))
    return sampling.heads(rows, "label", ["at"], 7, "user_id")


@register("sp7_fraction_proposal", "WITH s AS (SELECT CASE WHEN patient_id % 20 = 0 THEN 'final' WHEN patient_id % 4 = 1 THEN 'validation' ELSE 'train' END AS split, label, patient_id, max(CASE WHEN raw = 1 THEN 1 ELSE 0 END) AS p, max(CASE WHEN raw = 0 THEN 1 ELSE 0 END) AS q FROM ternary GROUP BY 1, 2, 3), c AS (SELECT split, label, count_if(p = 1) AS a, count_if(p = 0 AND q = 1) AS b FROM s GROUP BY 1, 2), n AS (SELECT count(DISTINCT patient_id) AS n FROM ternary), f AS (SELECT split, CASE split WHEN 'final' THEN 0.05 WHEN 'validation' THEN 0.25 ELSE 0.7 END::DOUBLE AS share, max(greatest(CASE WHEN a < 60 THEN 60.0 / greatest(a, 1) ELSE 1 END, CASE WHEN b < 3 THEN 3.0 / greatest(b, 1) ELSE 1 END))::DOUBLE AS factor FROM c GROUP BY 1), x AS (SELECT split, share, factor, least(1.0, share * factor) AS w FROM f WHERE factor > 1), y AS (SELECT split, share, round(factor, 3) AS factor, round(w, 4) AS proposed, CAST(floor(n * (w - share) + 1e-9) AS BIGINT) AS more_groups FROM x, n) SELECT * FROM y UNION ALL SELECT 'train', 0.7, NULL, round(0.7 - coalesce(sum(more_groups), 0) / any_value(n), 4), -coalesce(sum(more_groups), 0)::BIGINT FROM n LEFT JOIN y ON true")
def sp7(t: Tables):
    k = F.col("patient_id")
    rows = t.ternary.withColumn("split", F.when(k % 20 == 0, "final").when(k % 4 == 1, "validation").otherwise("train"))
    support = labels.patient_support(rows.withColumn("label", F.concat_ws("/", "split", "label")))
    cell = F.split("label", "/")
    support = support.select(cell[0].alias("split"), cell[1].alias("label"), F.col("positive_patients").alias("positives"), F.col("negative_patients").alias("negatives"))
    total = t.ternary.select("patient_id").distinct().count()
    return sampling.fraction_proposal(support, {"train": 0.7, "validation": 0.25, "final": 0.05}, total, 60, 3, "train")


@register("pf4_metadata_faults", "SELECT o_orderkey, 'no_group' AS fault FROM orders WHERE o_custkey % 11 = 0 UNION ALL SELECT o_orderkey, 'unknown_class' FROM orders WHERE o_orderpriority LIKE '4%'")
def pf4(t: Tables):
    rows = t.orders.select("o_orderkey", F.when(F.col("o_custkey") % 11 != 0, F.col("o_custkey")).alias("g"), F.when(F.col("o_orderpriority").startswith("4"), "?").otherwise(F.concat(F.lit(" "), F.lower("o_orderpriority"))).alias("dx"))
    return labels.metadata_faults(rows, "o_orderkey", "g", "dx")


@register("pf5_source_faults", "WITH p AS (SELECT CASE WHEN page_id % 10 = 0 THEN ' ' WHEN page_id % 10 = 1 THEN 'same/patient1.jpg' ELSE url || '/patient' || page_id || '.jpg' END AS path, page_id % 10 AS k FROM pages) SELECT path, 'blank_path' AS fault FROM p WHERE k = 0 UNION ALL SELECT 'same/patient1.jpg', 'repeated_path' FROM p WHERE k = 1 GROUP BY path HAVING count(*) > 1 UNION ALL SELECT path, 'label_domain' FROM p WHERE k = 5")
def pf5(t: Tables):
    k = F.col("page_id") % 10
    path = F.when(k == 0, " ").when(k == 1, "same/patient1.jpg").otherwise(F.concat("url", F.lit("/patient"), F.col("page_id").cast("string"), F.lit(".jpg")))
    rows = t.pages.select(path.alias("p"), F.when(k == 5, "2").when(k == 6, "").when(k == 7, "-1.0").otherwise("1").alias("a"), F.lit(None).cast("string").alias("b"))
    return labels.source_faults(rows, "p", ["a", "b"], r"patient\d+")


@register("pf11_feature_admission", "WITH d AS (SELECT 0 AS k, count(DISTINCT score) >= 5 AS alive FROM pool UNION ALL SELECT 1, count(DISTINCT CASE WHEN image_id % 3 = 0 THEN score END) >= 5 AND avg(CASE WHEN image_id % 3 = 0 THEN 0.0 ELSE 1.0 END) <= 0.1 FROM pool UNION ALL SELECT 2, count(DISTINCT score) >= 5 FROM pool UNION ALL SELECT 3, count(DISTINCT 1.0) >= 5 FROM pool) SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS place, p_name AS feature FROM part JOIN d ON k = p_partkey % 4 WHERE alive")
def pf11(t: Tables):
    """Configured features, in their order, of the signals that the decision leaves."""
    signal = F.element_at(F.array(*[F.lit(s) for s in ("iqa", "similarity", "novelty", "uncertainty")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    configured = t.part.select(F.col("p_partkey").alias("place"), F.col("p_name").alias("feature"), signal.alias("signal"))
    return gate.admitted(configured, decisions(t).where("outcome = 'include'"))


def decisions(t: Tables):
    """Signals whose columns miss too much or vary too little are out."""
    k, s = F.col("image_id"), F.col("score")
    rows = t.pool.select(s.alias("iqa"), F.when(k % 3 == 0, s).alias("similarity"), (s * 2).alias("novelty"), F.lit(1.0).alias("uncertainty"))
    return gate.decide(gate.column_checks(rows, rows.columns, 5, 0.1))


@register("pf12_contributing_signals", "SELECT DISTINCT n_name AS signal FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 2000")
def pf12(t: Tables):
    owners = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("feature"), F.col("n_name").alias("signal"))
    return gate.signals_of(t.supplier.where("s_acctbal > 2000").select(F.col("s_suppkey").alias("feature")), owners)


@register("gt1_technical_validity", "SELECT unnest(['iqa', 'similarity', 'novelty', 'uncertainty']) AS signal, (SELECT count(*) FROM pool) > 0 AS passed")
def gt1(t: Tables):
    rows = t.pool.select(*[F.col("score").alias(c) for c in ("iqa", "similarity", "novelty", "uncertainty")])
    return gate.column_checks(rows, rows.columns, 5, 0.1).where(F.col("check") == "technical_validity").select("signal", "passed")


@register("gt4_missing_rates", "SELECT 'a' AS signal, avg(CASE WHEN image_id % 3 <> 0 THEN 1.0 ELSE 0 END) <= 0.5 AS passed FROM pool UNION ALL SELECT 'b', avg(CASE WHEN image_id % 20 = 0 THEN 1.0 ELSE 0 END) <= 0.5 FROM pool")
def gt4(t: Tables):
    rows = t.pool.select(F.when(F.col("image_id") % 3 == 0, F.col("score")).alias("a"), F.when(F.col("image_id") % 20 != 0, F.col("score")).alias("b"))
    return gate.column_checks(rows, ["a", "b"], 1, 0.5).where(F.col("check") == "missing_rate").select("signal", "passed")


NAMED = "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'score' WHEN 1 THEN 'explainability_calibrated' WHEN 2 THEN 'explainability_raw_x' WHEN 3 THEN 'explainability_focus_area' ELSE 'explainability_peripheral_mass' END || '_' || p_brand AS name FROM part"


@register("pf15_raw_columns", f"SELECT p_partkey, name, p_partkey % 5 > 1 AS raw FROM ({NAMED})")
def pf15(t: Tables):
    return t.sql(NAMED).withColumn("raw", gate.raw("name"))


@register("pf16_calibration_faults", "SELECT 'not_calibrated' AS fault, count(*) AS n FROM pool WHERE image_id % 7 = 0 HAVING count(*) > 0 UNION ALL SELECT 'split_not_permitted', count(*) FROM pool WHERE image_id % 5 = 0 HAVING count(*) > 0")
def pf16(t: Tables):
    k = F.col("image_id")
    return gate.calibration_faults(t.pool.select(F.when(k % 7 != 0, F.lit(True)).alias("calibrated"), F.lit(True).alias("scientific"), F.when(k % 5 == 0, "final").otherwise("train").alias("reference_split")))


@register("pf25_candidate_rows", "SELECT image_id, dx FROM pool ORDER BY image_id LIMIT 50")
def pf25(t: Tables):
    return labels.candidates(t.pool, ["image_id", "dx"], most=50)


@register("ve3_tiered_similarity")
def ve3(t: Tables):
    return rounded(tiered(t), "knn_mean", "top1", "topk_spread", "top1_gap", "novelty")


def tiered(t: Tables):
    """Label sets from two digits of the id and the class: some frequent, some rare, some empty."""
    k = F.col("vec_id")
    h = F.floor(k / 2)  # candidates are the even ids
    parts = F.array(F.when(h % 3 != 0, F.concat(F.lit("l"), (F.col("label") % 4).cast("string"))), F.when(h % 4 == 1, "x"), F.when(h % 50 == 7, "rare"), F.when(k % 90 == 8, F.concat(F.lit("own"), k.cast("string"))))
    e = t.embeddings.withColumn("labels", F.array_sort(F.array_compact(parts)))
    return vectors.tiered_scores(e.where("vec_id % 2 = 0"), e.where("vec_id % 2 = 1"), "vec_id", "labels", "embedding", duplicate=0.3, collapsed=0.05)


GRID = [0.1, 0.3, 0.5, 0.7, 0.9]


@register("se14_hard_grid", f"WITH c AS (SELECT label AS context_id, row_id AS image_id, score, (row_id * 37 % 101) / 101.0::DOUBLE AS utility FROM scored), r AS (SELECT *, row_number() OVER (PARTITION BY context_id ORDER BY score DESC, image_id) AS k, count(*) OVER (PARTITION BY context_id) AS size FROM c), g AS (SELECT unnest({GRID}::DOUBLE[]) AS threshold), x AS (SELECT context_id, threshold, count(*) AS selected, avg(utility) AS utility, any_value(size) AS size FROM r, g WHERE score >= threshold AND k <= 60 GROUP BY 1, 2) SELECT context_id, threshold, selected, round(utility, 6) AS utility, selected < 30 AS below_least, row_number() OVER (PARTITION BY context_id ORDER BY round(utility - 0.1 * selected / size, 12) DESC, threshold) AS rank FROM x")
def se14(t: Tables):
    c = t.scored.select(F.col("label").alias("context_id"), F.col("row_id").alias("image_id"), "score", (F.col("row_id") * 37 % 101 / F.lit(101.0)).alias("utility"))
    return rounded(select.hard_grid(c, GRID, 0.1, 60, 30), "utility")


@register("se32_final_selection", f"WITH k AS ({COUNTS}), e AS (SELECT min(n) AS lo, max(n) AS hi FROM k), p AS (SELECT dx, coalesce(10 + 40 * (n - lo) / nullif(hi - lo, 0), 50.0) AS percentile FROM k, e), r AS (SELECT image_id, p.dx, score, percentile, row_number() OVER (PARTITION BY p.dx ORDER BY score) - 1 AS r, row_number() OVER (PARTITION BY p.dx ORDER BY score DESC, image_id) AS d, (count(*) OVER (PARTITION BY p.dx) - 1) * percentile / 100 AS h FROM pool JOIN p ON pool.dx = p.dx), c AS (SELECT dx, least(max(CASE WHEN r = floor(h) THEN score END) + (max(CASE WHEN r = ceil(h) THEN score END) - max(CASE WHEN r = floor(h) THEN score END)) * any_value(h - floor(h)), min(CASE WHEN d <= 25 THEN score END)) AS cut FROM r GROUP BY dx) SELECT image_id, round(score, 6) AS score, 'rarity_percentile' AS policy FROM pool JOIN c ON pool.dx = c.dx WHERE score >= cut")
def se32(t: Tables):
    runs = t.repeats.select(F.when(F.col("subset_id") % 2 == 0, "rarity_percentile").otherwise("measured_best").alias("policy"), F.col("seed"), F.when(F.col("subset_id") % 2 == 0, 0.9).otherwise(0.5).alias("utility"))
    winner = runs.groupBy("policy").agg(F.avg("utility").alias("u")).orderBy(F.col("u").desc(), "policy").first().policy
    return rounded(select.finalise(t.pool, winner, {}, floor=25), "score")


@register("se32_layered_thresholds", "SELECT dx, CASE WHEN dx LIKE '1%' THEN 0.9 WHEN dx LIKE '2%' THEN 0.7 ELSE 0.5 END::DOUBLE AS threshold FROM (SELECT DISTINCT dx FROM pool)")
def se32_layers(t: Tables):
    of = lambda f: t.pool.select("dx").distinct().select("dx", f.alias("threshold"))
    layers = {"baseline": of(F.lit(0.5)), "measured_best": of(F.when(F.col("dx") < "3", 0.7)), "network": of(F.when(F.col("dx") < "2", 0.9))}
    return select.policy_thresholds(t.pool, "network", layers, 1)


@register("se17_attrition", f"WITH {SAFE}, a AS (SELECT * FROM safe WHERE score >= (SELECT quantile_cont(score, 0.25) FROM safe)), t AS (SELECT dx, count(*) AS pool, CAST(least(200, greatest(50, round_even(count(*) * 0.1, 0))) AS BIGINT) AS target FROM pool GROUP BY dx), n AS (SELECT t.dx, target, pool, (SELECT count(*) FROM safe s WHERE s.dx = t.dx) AS safe, (SELECT count(*) FROM a WHERE a.dx = t.dx) AS above_floor FROM t) SELECT * FROM n")
def se17_attrition(t: Tables):
    counts = t.pool.groupBy("dx").agg(F.count(F.lit(1)).alias("n"))
    return select.adaptive_report(t.pool, t.flags, counts, ratio=0.1, most_target=200).select("dx", "target", "pool", "safe", "above_floor")


@register("st8_micro_auroc", "WITH b AS (SELECT target, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM scored WHERE mask) SELECT round((sum(CASE WHEN target = 1 THEN r END) - count_if(target = 1) * (count_if(target = 1) + 1) / 2.0) / nullif(count_if(target = 1) * count_if(target = 0), 0), 6) AS micro_auroc FROM b")
def st8_micro(t: Tables):
    return rounded(metrics.micro_auroc(t.scored), "micro_auroc")


@register("fn14_soft_gate", "SELECT image_id, round(1 / (1 + exp(-(score - 0.5) / 0.1)), 6) AS gate FROM pool")
def fn14(t: Tables):
    return rounded(t.pool.select("image_id", select.soft_gate(F.col("score"), 0.5, 0.1).alias("gate")), "gate")


NAMES = "SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'production' WHEN 1 THEN 'dev-smoke-v1' WHEN 2 THEN 'dev-' ELSE 'production-2' END AS name, CASE s_suppkey % 4 WHEN 3 THEN 'production' ELSE 'dev' END AS kind FROM supplier"


@register("fn15_run_names", f"SELECT s_suppkey, name IN ('dev-smoke-v1', 'production-2') AS valid, CASE WHEN name = 'production' THEN name ELSE 'non-production / development-only' END AS status, '/runs/' || name || '/selection' AS path FROM ({NAMES})")
def fn15(t: Tables):
    rows = t.sql(NAMES)
    where = F.concat(F.lit(contracts.run_paths("/runs", "?")["selection"].split("?")[0]), "name", F.lit("/selection"))
    return rows.select("s_suppkey", contracts.valid_run("name", "kind").alias("valid"), contracts.scientific_status("name").alias("status"), where.alias("path"))


@register("fn16_raw_vectors", "SELECT row_id, CASE WHEN raw IS NULL THEN label || '=' ELSE label || '=' || CAST(raw AS INT) END AS entry FROM ternary")
def fn16(t: Tables):
    v = labels.raw_vector(F.col("label"), F.col("raw"))
    return t.ternary.select("row_id", v.alias("v")).select("row_id", F.explode("v").alias("k", "x")).select("row_id", F.concat("k", F.lit("="), F.coalesce(F.col("x").cast("int").cast("string"), F.lit(""))).alias("entry"))


def images(t: Tables):
    """Eight by eight images of the embeddings."""
    return t.embeddings.select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 4 + 128).alias("p"))


def per_image(df, names: list[str], look):
    """(vec_id, *names) of a function of each 8 x 8 image."""

    def run(frames):
        for f in frames:
            got = [look(int(k), np.array(list(p), dtype=float).reshape(8, 8)) for k, p in zip(f["vec_id"], f["p"], strict=True)]
            yield f[["vec_id"]].assign(**{n: [g[i] for g in got] for i, n in enumerate(names)})

    return df.mapInPandas(run, "vec_id long, " + ", ".join(f"{n} {'string' if n == 'status' else 'double'}" for n in names))


INNER = "(SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 4 + 128) AS p FROM embeddings)"


def band_sql(first: int, last: int, alias: str) -> str:
    """Share of the outer band (one pixel, corners twice) of rows and columns first..last of the 8 x 8 images."""
    cells = [r * 8 + c + 1 for r in range(first, last + 1) for c in range(first, last + 1) for _ in range((r in (first, last)) + (c in (first, last)))]
    v = "list_transform([" + ", ".join(map(str, cells)) + "], lambda i: p[i])"
    return f"round(list_avg(list_transform({v}, lambda x: CASE WHEN abs(x - list_avg({v})) < 2.0 THEN 1.0 ELSE 0.0 END))::DOUBLE, 6) AS {alias}"


@register("im2_border_uniform", f"SELECT vec_id, {band_sql(0, 7, 'canvas')}, {band_sql(1, 6, 'content')} FROM {INNER}")
def im2(t: Tables):
    return rounded(per_image(images(t), ["canvas", "content"], lambda k, g: (signals.border_uniform(g), signals.border_uniform(g, box=(1, 1, 7, 7)))), "canvas", "content")


@register("im7_resolved_thresholds", "WITH c AS (SELECT dx || '/' || group_id % 10 AS class, any_value(group_id % 10) AS k, quantile_cont(score, 0.05) AS threshold FROM pool GROUP BY 1) SELECT class, CASE WHEN k = 1 THEN 0.5 WHEN k IN (0, 6, 7, 8, 9) THEN round(threshold, 6) END::DOUBLE AS threshold, CASE WHEN k = 1 THEN 'inherited_constant_uncalibrated' WHEN k IN (0, 6, 7, 8, 9) THEN 'train_lower_quantile_0.05' END AS source, CASE k WHEN 2 THEN 'no_calibration' WHEN 3 THEN 'split_not_permitted' WHEN 4 THEN 'other_quantile' WHEN 5 THEN 'other_region' END AS fault FROM c")
def im7(t: Tables):
    """Thresholds of classes by their settings and calibrations, and why others have none."""
    from tessella.functions.frames import quantiles

    rows = t.pool.select("score", F.concat_ws("/", "dx", (F.col("group_id") % 10).cast("string")).alias("class"))
    k = F.substring_index("class", "/", -1).cast("int")
    split, rule = F.when(k == 3, "final").otherwise("train").alias("source_split"), F.lit("lower_quantile").alias("rule")
    settings = rows.select("class").distinct().select("class", (k != 1).alias("calibrated"), F.lit(0.5).alias("constant"), split, rule, F.when(k == 5, "border").alias("region"), F.when(k == 4, 0.1).otherwise(0.05).alias("quantile"))
    found = quantiles(rows.where(k != 2), "score", [0.05], ["class"])
    calibrations = found.select("class", split, rule, F.lit(None).cast("string").alias("region"), F.col("q").alias("quantile"), F.col("v").alias("threshold"))
    return rounded(signals.resolved_thresholds(settings, calibrations, "class"), "threshold")


@register("im9_explainability", "SELECT vec_id, round((1 - CASE WHEN vec_id % 8 BETWEEN 1 AND 6 THEN 1 ELSE 0 END)::DOUBLE, 6) AS peripheral, 1 / 64::DOUBLE AS area, round((CASE WHEN vec_id % 8 BETWEEN 1 AND 6 THEN 1 ELSE 0 END * (1 - 1 / 64))::DOUBLE, 6) AS raw FROM embeddings")
def im9(t: Tables):
    one = t.embeddings.select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(i == 24 + F.col("vec_id") % 8, 1.0).otherwise(0.0)).alias("p"))  # one cell of the fourth row
    return rounded(per_image(one, ["peripheral", "area", "raw"], lambda k, g: signals.explainability(g, (1 / 8, 1 / 8, 7 / 8, 7 / 8))), "peripheral", "area", "raw")


def strip_sql(cells: list[int]) -> str:
    return "list_stddev_pop(list_transform([" + ", ".join(map(str, cells)) + "], lambda i: p[i]))"


STRIPS = {"top": [c + 1 for c in range(8)], "bottom": [57 + c for c in range(8)], "left": [r * 8 + 1 for r in range(8)], "right": [r * 8 + 8 for r in range(8)]}


@register("im12_flat_borders", f"WITH s AS (SELECT vec_id, " + ", ".join(f"{strip_sql(c)} AS s_{k}" for k, c in STRIPS.items()) + f" FROM {INNER}) SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN 'wrong_size' WHEN least(s_top, s_bottom, s_left, s_right) >= 0.4 THEN 'accepted' ELSE 'flat_border:' || concat_ws(',', CASE WHEN s_bottom < 0.4 THEN 'bottom' END, CASE WHEN s_left < 0.4 THEN 'left' END, CASE WHEN s_right < 0.4 THEN 'right' END, CASE WHEN s_top < 0.4 THEN 'top' END) END AS status FROM s")
def im12(t: Tables):
    return per_image(images(t), ["status"], lambda k, g: (signals.standard_geometry(g, (9 if k % 10 == 0 else 8, 8), 0.4),))


@register("im14_reference_distributions", "SELECT dx, image_id, round(score, 6) AS score FROM pool WHERE group_id % 5 = 1")
def im14(t: Tables):
    protected = t.pool.where("group_id % 5 = 0").select("image_id")
    mine = t.pool.where("group_id % 5 = 1").unionByName(t.pool.where("group_id % 5 = 2").withColumn("score", F.lit(float("inf"))))
    stored = signals.reference_distributions(mine, protected, "train", "dx", "image_id", "score", 5)
    return rounded(signals.reference_distributions(stored, protected, "train", "dx", "image_id", "score", 5), "score")


@register("im20_pilot_checks", "WITH r AS (SELECT count_if(p_size % 10 = 0) AS rejected, count_if(p_size % 10 <> 0 AND p_size % 7 <> 0) AS valid, count_if(p_size % 10 <> 0 AND p_size % 7 <> 0 AND p_size % 9 = 0) AS near_uniform, count(*) AS n FROM part) SELECT rejected, valid, near_uniform, round(valid / (n - rejected), 6) AS valid_share, round(rejected / n, 6) AS rejected_share, round(near_uniform / n, 6) AS uniform_share, valid / (n - rejected) >= 0.8 AND near_uniform / n <= 0.2 AND rejected / n <= 0.2 AS passed FROM r")
def im20(t: Tables):
    k = F.col("p_size")
    rows = t.part.select(F.when(k % 10 == 0, "geometry_rejected").otherwise("accepted").alias("status"), (k % 7 != 0).alias("valid"), F.when(k % 9 == 0, 0.5).otherwise(30.0).alias("contrast"))
    return rounded(gate.pilot_checks(rows, t.part.count(), 0.8, 0.2, 0.2, 5.0), "valid_share", "rejected_share", "uniform_share")


EVENT_LABELS = "SELECT s, count(*) AS support FROM (SELECT list_sort(list(DISTINCT event_type)) AS s FROM events WHERE value > 40 GROUP BY user_id) GROUP BY 1 HAVING count(*) >= 3"


def mined(t: Tables):
    sets = t.events.where("value > 40").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("combination"))
    return sets.groupBy("combination").agg(F.count(F.lit(1)).alias("support")).where("support >= 3")


LABELS = ["click", "error", "purchase", "view", "zzz"]
ALLOW, BLOCK = [["click", "purchase", "zzz"]], [["error", "view"], ["zzz"]]


@register("se26_recipe_decisions", f"WITH m AS ({EVENT_LABELS}), f AS (SELECT ['click', 'purchase', 'zzz'] AS s, 'allow' AS g UNION ALL SELECT [unnest({LABELS})], 'single'), x AS (SELECT coalesce(m.s, f.s) AS s, coalesce(support, 0) AS support, g FROM m FULL JOIN f ON m.s = f.s WHERE g IS NOT NULL OR len(m.s) <= 2), o AS (SELECT s, support, CASE WHEN g = 'allow' THEN 'medical_rule_allow' WHEN support > 0 THEN 'empirical_cooccurrence' ELSE 'single_label_guaranteed' END AS origin FROM x), b AS (SELECT *, CASE WHEN origin = 'medical_rule_allow' THEN NULL WHEN list_has_all(s, ['error', 'view']) THEN 'medical_rule_block:error,view' WHEN list_has_all(s, ['zzz']) THEN 'medical_rule_block:zzz' END AS blocked FROM o), r AS (SELECT *, coalesce(blocked, CASE WHEN len(s) > 2 THEN 'exceeds_max_positive_labels:2' END) AS refused FROM b) SELECT array_to_string(s, '|') AS combination, origin, refused IS NULL AS accepted, coalesce(refused, CASE origin WHEN 'medical_rule_allow' THEN 'accepted_medical_rule_allow' WHEN 'single_label_guaranteed' THEN 'accepted_single_label_below_support_but_required_for_coverage' ELSE 'accepted_empirical_support' END) AS reason, support FROM r")
def se26_decisions(t: Tables):
    return recipes.decisions(mined(t), LABELS, 2, ALLOW, BLOCK).withColumn("combination", F.array_join("combination", "|"))


QUOTAS = {"click": 60, "error": 25, "purchase": 40, "view": 80}


def planned(t: Tables):
    """Recipes of the accepted combinations; as many combinations as label sets are driver rows."""
    accepted = recipes.decisions(mined(t), LABELS, 3, [], BLOCK).where("accepted").select("combination").collect()
    return recipes.recipes(t.spark, recipes.plan([tuple(r.combination) for r in accepted], QUOTAS, 0.5, 0.1, 4), [20, 40, 60], ["Male", "Female"], 0.3, 4)


@register("se26_recipe_rows")
def se26_rows(t: Tables):
    return planned(t)


@register("ag28_recipe_mix")
def ag28_mix(t: Tables):
    return recipes.statistics(planned(t), sorted(QUOTAS)).withColumn("emitted", F.to_json("emitted"))
