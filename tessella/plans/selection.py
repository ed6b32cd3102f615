"""Selection, floors, thresholds and sampling over the stand-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions.frames import numbered
from tessella.operators import sampling, select, vectors
from tessella.plans.registry import Tables, register


def rounded(df, *columns: str, places: int = 6):
    return df.withColumns({c: F.round(c, places) for c in columns})


@register("pf13_fail_closed", "SELECT p.image_id, NOT coalesce(f.valid, false) OR coalesce(f.duplicate, true) AS unsafe, CASE WHEN NOT coalesce(f.valid, false) THEN 'invalid' WHEN coalesce(f.duplicate, true) THEN 'near_duplicate' END AS reason FROM pool p LEFT JOIN flags f USING (image_id)")
def pf13(t: Tables):
    return select.fail_closed(t.pool, t.flags).select("image_id", "unsafe", "reason")


@register("pf14_above_cut", "SELECT image_id, dx, score FROM pool WHERE score >= CASE dx WHEN '1-URGENT' THEN 0.9 WHEN '2-HIGH' THEN 0.5 ELSE 1.0 END")
def pf14(t: Tables):
    cuts = t.spark.createDataFrame([("1-URGENT", 0.9), ("2-HIGH", 0.5)], "dx string, threshold double")
    return select.above_cut(t.pool, cuts).select("image_id", "dx", "score")


@register("wn1_top_k_per_class", "SELECT image_id, dx, score, rank FROM (SELECT image_id, dx, score, row_number() OVER (PARTITION BY dx ORDER BY score DESC, image_id) AS rank FROM pool) WHERE rank <= length(dx)")
def wn1(t: Tables):
    return select.top_k(t.pool, F.length("dx")).select("image_id", "dx", "score", F.col("rank").cast("bigint").alias("rank"))


@register("wn2_budget_cap", "SELECT image_id, dx FROM (SELECT image_id, dx, row_number() OVER (PARTITION BY dx ORDER BY score DESC, image_id) AS r FROM pool) WHERE r <= 25")
def wn2(t: Tables):
    return select.top_k(t.pool, 25).select("image_id", "dx")


@register("wn3_overlapping_winners", "WITH m AS (SELECT image_id, score, dx AS label FROM pool UNION ALL SELECT image_id, score, 'mod' || image_id % 4 FROM pool) SELECT DISTINCT image_id FROM (SELECT image_id, row_number() OVER (PARTITION BY label ORDER BY score DESC, image_id) AS r FROM m) WHERE r <= 20")
def wn3(t: Tables):
    p = t.pool.withColumn("label", F.explode(F.array("dx", F.concat(F.lit("mod"), (F.col("image_id") % 4).cast("string")))))
    return select.top_k(p, 20, by="label").select("image_id").distinct()


@register("wn4_top_share", "WITH n AS (SELECT dx, greatest(1, CAST(round_even(count(*) * 0.15, 0) AS INT)) AS k FROM pool GROUP BY dx) SELECT image_id, p.dx FROM (SELECT *, row_number() OVER (PARTITION BY dx ORDER BY score DESC, image_id) AS r FROM pool) p JOIN n ON p.dx = n.dx WHERE r <= k")
def wn4(t: Tables):
    return select.top_share(t.pool, 0.15).select("image_id", "dx")


@register("wn5_pooled_half", "SELECT image_id FROM (SELECT image_id, row_number() OVER (ORDER BY score DESC, image_id) AS r FROM pool) WHERE r <= (SELECT greatest(1, count(*) // 2) FROM pool)")
def wn5(t: Tables):
    n = max(1, t.pool.count() // 2)
    return numbered(t.pool, [F.col("score").desc(), F.col("image_id")], "place").where(F.col("place") < n).select("image_id")


@register("wn8_rank_bands", "SELECT image_id, greatest(1, CAST(ceil((r - 1) * 3 / CAST(greatest(n - 1, 1) AS DOUBLE) - 1e-12) AS BIGINT)) AS band FROM (SELECT image_id, row_number() OVER (PARTITION BY dx ORDER BY score, image_id) AS r, count(*) OVER (PARTITION BY dx) AS n FROM pool)")
def wn8(t: Tables):
    return sampling.rank_bins(t.pool, 3, "score", "image_id", ["dx"]).select("image_id", "band")


@register("wn9_one_per_bin", "SELECT dx, bin, image_id FROM (SELECT *, row_number() OVER (PARTITION BY dx, bin ORDER BY sha256(concat_ws(':', '3', dx, bin, image_id)), image_id) AS d FROM (SELECT dx, image_id, ntile(8) OVER (PARTITION BY dx ORDER BY score, image_id) AS bin FROM pool)) WHERE d = 1")
def wn9(t: Tables):
    return sampling.equal_bins(t.pool, 8, "score", "image_id", 3, ["dx"]).select("dx", F.col("bin").cast("bigint").alias("bin"), "image_id")


@register("wn14_thresholded_top_n", "SELECT image_id, dx FROM (SELECT image_id, dx, row_number() OVER (PARTITION BY dx ORDER BY score DESC, image_id) AS r FROM pool WHERE score >= 0.75) WHERE r <= 30")
def wn14(t: Tables):
    return select.top_k(t.pool.where("score >= 0.75"), 30).select("image_id", "dx")


@register("sm1_sample_per_class", "SELECT image_id, dx FROM (SELECT image_id, dx, row_number() OVER (PARTITION BY dx ORDER BY sha256(concat_ws(':', '7', dx, image_id)), image_id) AS d FROM pool) WHERE d <= 50")
def sm1(t: Tables):
    return sampling.take(t.pool, 50, "image_id", 7, ["dx"]).select("image_id", "dx")


@register("sm2_proportional", "WITH q AS (SELECT dx, CAST(round_even(100 * count(*) / (SELECT count(*) FROM pool), 0) AS INT) AS q FROM pool GROUP BY dx), r AS (SELECT p.image_id, p.dx, sha256(concat_ws(':', '7', p.image_id)) AS h, row_number() OVER (PARTITION BY p.dx ORDER BY sha256(concat_ws(':', '7', p.image_id)), p.image_id) <= q AS f FROM pool p JOIN q ON p.dx = q.dx) SELECT image_id, dx FROM r ORDER BY f DESC, h, image_id LIMIT 100")
def sm2(t: Tables):
    return sampling.proportional(t.pool, 100, "image_id", "dx", 7).select("image_id", "dx")


@register("sm3_reference_sample", "SELECT label, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY sha256(concat_ws(':', '1', label, vec_id)), vec_id) AS d FROM embeddings) WHERE d <= 20")
def sm3(t: Tables):
    return sampling.take(t.embeddings.select("label", "vec_id"), 20, "vec_id", 1, ["label"]).select("label", "vec_id")


@register("sm6_two_way_split", "SELECT image_id, CASE WHEN row_number() OVER (PARTITION BY dx ORDER BY sha256(concat_ws(':', '2', image_id)), image_id) <= round_even(count(*) OVER (PARTITION BY dx) * 0.3, 0) THEN 'a' ELSE 'b' END AS side FROM pool")
def sm6(t: Tables):
    return sampling.split_share(t.pool, 0.3, "image_id", 2, ["dx"]).select("image_id", "side")


@register("sm7_bootstrap_contexts", "WITH x AS (SELECT dx, image_id, replicate FROM pool, (SELECT unnest(generate_series(1, 3)) AS replicate)) SELECT dx, CAST(replicate AS INT) AS replicate, image_id FROM (SELECT *, row_number() OVER (PARTITION BY dx, replicate ORDER BY sha256(concat_ws(':', '4', replicate, image_id)), image_id) AS r, count(*) OVER (PARTITION BY dx, replicate) AS n FROM x) WHERE r <= greatest(1, round_even(n * 0.2, 0))")
def sm7(t: Tables):
    return sampling.bootstrap_contexts(t.pool, 3, 0.2, "image_id", "dx", 4).select("dx", "replicate", "image_id")


@register("sm8_folds", "SELECT group_id, (row_number() OVER (ORDER BY sha256(concat_ws(':', '5', group_id)), group_id) - 1) % 5 AS fold FROM (SELECT DISTINCT group_id FROM pool)")
def sm8(t: Tables):
    return sampling.folds(t.pool, 5, "group_id", 5)


@register("sm9_with_replacement", "WITH n AS (SELECT dx, image_id, row_number() OVER (PARTITION BY dx ORDER BY image_id) - 1 AS at FROM pool), c AS (SELECT dx, count(*) AS k FROM pool GROUP BY dx), s AS (SELECT dx, slot, CAST('0x' || substr(sha256(concat_ws(':', '6', dx, slot)), 1, 8) AS BIGINT) % k AS at FROM c, (SELECT unnest(generate_series(1, 40)) AS slot)) SELECT s.dx, CAST(slot AS INT) AS slot, image_id FROM s JOIN n ON s.dx = n.dx AND s.at = n.at")
def sm9(t: Tables):
    slots = t.pool.select("dx").distinct().withColumn("slot", F.explode(F.sequence(F.lit(1), F.lit(40))))
    return sampling.with_replacement(t.pool, slots, "dx", "image_id", 6)


@register("sm10_seeded_subset", "SELECT image_id FROM pool ORDER BY sha256(concat_ws(':', '8', image_id)), image_id LIMIT 64")
def sm10(t: Tables):
    return t.pool.orderBy(sampling.seeded(8, "image_id"), "image_id").limit(64).select("image_id")


@register("sm13_first_per_class", "SELECT image_id, dx FROM (SELECT image_id, dx, row_number() OVER (PARTITION BY dx ORDER BY image_id) AS r FROM pool) WHERE r <= 10")
def sm13(t: Tables):
    return select.top_k(t.pool.withColumn("neg", -F.col("image_id")), 10, "neg").select("image_id", "dx")


@register("sm14_limit", "SELECT image_id FROM pool ORDER BY image_id LIMIT 100")
def sm14(t: Tables):
    return t.pool.orderBy("image_id").limit(100).select("image_id")


@register("sm15_whole_groups", "WITH g AS (SELECT group_id, min(dx) AS dx FROM pool GROUP BY group_id), k AS (SELECT group_id FROM (SELECT *, row_number() OVER (PARTITION BY dx ORDER BY sha256(concat_ws(':', '9', dx, group_id)), group_id) AS d FROM g) WHERE d <= 15) SELECT image_id, group_id FROM pool WHERE group_id IN (SELECT group_id FROM k)")
def sm15(t: Tables):
    groups = t.pool.groupBy("group_id").agg(F.min("dx").alias("dx"))
    return t.pool.join(sampling.take(groups, 15, "group_id", 9, ["dx"]), "group_id", "left_semi").select("image_id", "group_id")


FEATURES = "SELECT o_orderkey AS image_id, CASE WHEN o_orderkey % 23 = 0 THEN NULL WHEN o_orderkey % 29 = 0 THEN CAST('inf' AS DOUBLE) ELSE o_totalprice / 1000 END AS a, CAST(o_orderkey % 37 AS DOUBLE) AS b, 1.0 AS flat FROM orders"
FITTED = f"WITH x AS ({FEATURES}), f AS (SELECT image_id, CASE WHEN abs(a) < 'inf'::DOUBLE THEN a END AS a, b, CAST(flat AS DOUBLE) AS flat FROM x), m AS (SELECT quantile_cont(a, 0.5) AS ma, quantile_cont(b, 0.5) AS mb FROM f), g AS (SELECT image_id, coalesce(a, ma) AS a, b FROM f, m)"


@register("se1_fit_features", FITTED + " SELECT round(ma, 6) AS a_median, round((SELECT avg(a) FROM g), 6) AS a_mean, round((SELECT stddev_pop(a) FROM g), 6) AS a_std, round((SELECT stddev_pop(b) FROM g), 6) AS b_std, 1.0::DOUBLE AS flat_std FROM m")
def se1(t: Tables):
    stats = select.fit_features(t.sql(FEATURES), ["a", "b", "flat"])
    return rounded(stats.select("a_median", "a_mean", "a_std", "b_std", "flat_std"), "a_median", "a_mean", "a_std", "b_std")


@register("se2_apply_features", FITTED + " SELECT image_id, round((a - (SELECT avg(a) FROM g)) / (SELECT stddev_pop(a) FROM g), 6) AS a, round((b - (SELECT avg(b) FROM g)) / (SELECT stddev_pop(b) FROM g), 6) AS b FROM g")
def se2(t: Tables):
    rows = t.sql(FEATURES).select("image_id", "a", "b")
    return rounded(select.apply_features(rows, select.fit_features(rows, ["a", "b"]), ["a", "b"]), "a", "b")


@register("se3_winsorised", "WITH q AS (SELECT quantile_cont(utility, 0.05) AS lo, quantile_cont(utility, 0.95) AS hi FROM subsets), c AS (SELECT subset_id, greatest(lo, least(hi, utility)) AS clipped FROM subsets, q) SELECT subset_id, round(clipped, 2) AS clipped, round((clipped - (SELECT avg(clipped) FROM c)) / (SELECT stddev_pop(clipped) FROM c), 6) AS standardised FROM c")
def se3(t: Tables):
    out = rounded(select.winsorised(t.subsets, "utility").select("subset_id", "clipped", "standardised"), "standardised")
    return out.withColumn("clipped", F.round(F.col("clipped") * 100) / 100)  # the double itself is rounded, not its shortest decimal


@register("se4_min_max", "WITH e AS (SELECT min(utility) AS lo, max(utility) AS hi FROM subsets) SELECT subset_id, round((utility - lo) / (hi - lo), 6) AS normalised, false AS degenerate FROM subsets, e UNION ALL SELECT -1, 0.5, true")
def se4(t: Tables):
    flat = t.spark.createDataFrame([(-1, 3.0)], "subset_id long, utility double")
    a = select.normalised(t.subsets, "utility").unionByName(select.normalised(flat, "utility"))
    return rounded(a.select("subset_id", "normalised", "degenerate"), "normalised")


@register("se5_composite", "WITH e AS (SELECT min(l_quantity) q0, max(l_quantity) q1, min(l_discount) d0, max(l_discount) d1 FROM lineitem) SELECT l_orderkey, l_linenumber, round((2 * (l_quantity - q0) / (q1 - q0) + (l_discount - d0) / (d1 - d0)) / 3, 6) AS composite FROM lineitem, e")
def se5(t: Tables):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return rounded(select.composite(rows, {"l_quantity": 2.0, "l_discount": 1.0}).select("l_orderkey", "l_linenumber", "composite"), "composite")


@register("se6_weight_grid", "WITH l AS (SELECT unnest([0.0, 0.5, 1.0])::DOUBLE AS v), g AS (SELECT x.v AS a, y.v AS b, z.v AS c FROM l x, l y, l z WHERE x.v + y.v + z.v > 0), k AS (SELECT *, CASE WHEN a + b + c = 3 THEN 0 WHEN a + b + c = 1 AND (a = 1 OR b = 1 OR c = 1) THEN 1 WHEN a + b + c = 2 AND a <> 0.5 AND b <> 0.5 AND c <> 0.5 THEN 2 ELSE 3 END AS priority FROM g) SELECT a, b, c, row_number() OVER (ORDER BY priority, a DESC, b DESC, c DESC) AS position FROM k")
def se6(t: Tables):
    return select.weight_grid(t.spark, ["a", "b", "c"]).select("a", "b", "c", F.col("position").cast("bigint").alias("position"))


@register("se7_pooled_floor", "SELECT image_id FROM pool WHERE score >= (SELECT quantile_cont(score, 0.25) FROM pool)")
def se7(t: Tables):
    return select.pooled_floor(t.pool, 0.25).select("image_id")


@register("se8_class_floor", "SELECT image_id, p.dx FROM pool p JOIN (SELECT dx, quantile_cont(score, 0.25) AS f FROM pool GROUP BY dx) q ON p.dx = q.dx WHERE score >= f")
def se8(t: Tables):
    return select.class_floor(t.pool, 0.25).select("image_id", "dx")


@register("se9_targets", "SELECT dx, CAST(least(1000, greatest(50, round_even(n * 0.5, 0))) AS BIGINT) AS ratio_target, greatest(0, 305 - n) AS fill_target FROM real_counts")
def se9(t: Tables):
    a = select.ratio_targets(t.real_counts, 0.5, 50, 1000).select("dx", F.col("target").alias("ratio_target"))
    return a.join(select.fill_targets(t.real_counts, 305).select("dx", F.col("target").alias("fill_target")), "dx")


COUNTS = "SELECT dx, count(*) AS n FROM pool GROUP BY dx"
PERCENTILES = f"WITH k AS ({COUNTS}), e AS (SELECT min(n) AS lo, max(n) AS hi FROM k), p AS (SELECT dx, coalesce(10 + 40 * (n - lo) / nullif(hi - lo, 0), 50.0) AS percentile FROM k, e)"


@register("se10_rarity_percentile_cuts", PERCENTILES + ", r AS (SELECT p.dx, score, percentile, row_number() OVER (PARTITION BY p.dx ORDER BY score) - 1 AS r, (count(*) OVER (PARTITION BY p.dx) - 1) * percentile / 100 AS h FROM pool JOIN p ON pool.dx = p.dx) SELECT dx, round(any_value(percentile), 6) AS percentile, round(max(CASE WHEN r = floor(h) THEN score END) + (max(CASE WHEN r = ceil(h) THEN score END) - max(CASE WHEN r = floor(h) THEN score END)) * any_value(h - floor(h)), 6) AS threshold FROM r GROUP BY dx")
def se10(t: Tables):
    p = select.rarity_percentiles(t.pool.groupBy("dx").agg(F.count(F.lit(1)).alias("n")))
    return rounded(select.group_percentiles(t.pool, p).join(p.select("dx", "percentile"), "dx").select("dx", "percentile", "threshold"), "percentile", "threshold")


@register("se11_prevalence_percentiles", "WITH s AS (SELECT label, count(DISTINCT CASE WHEN raw = 1 THEN patient_id END) AS p, count(DISTINCT CASE WHEN raw IN (0, 1) THEN patient_id END) AS k FROM ternary GROUP BY label), v AS (SELECT label AS dx, p / k AS n FROM s), e AS (SELECT min(n) AS lo, max(n) AS hi FROM v) SELECT dx, round(n, 6) AS prevalence, round(coalesce(10 + 40 * (n - lo) / nullif(hi - lo, 0), 50.0), 6) AS percentile FROM v, e")
def se11(t: Tables):
    from tessella.operators.labels import patient_support

    s = patient_support(t.ternary)
    v = s.select(F.col("label").alias("dx"), (F.col("positive_patients") / (F.col("positive_patients") + F.col("negative_patients"))).alias("n"))
    return rounded(select.rarity_percentiles(v).select("dx", F.col("n").alias("prevalence"), "percentile"), "prevalence", "percentile")


def search_sql(tie: str) -> str:
    return f"WITH k AS (SELECT CAST(unnest(generate_series(0, 100)) AS INT) AS k), g AS (SELECT t.dx, k.k, count(p.image_id) AS kept, avg(p.score) AS m, any_value(t.target) AS target FROM (SELECT dx, 300 AS target FROM real_dx) t CROSS JOIN k LEFT JOIN pool p ON p.dx = t.dx AND floor(p.score * 100 + 1e-9) >= k.k GROUP BY t.dx, k.k), o AS (SELECT dx, k, kept, CASE WHEN kept = 0 THEN -1.0 ELSE round(m - 0.5 * abs(kept - target) / target, 12) END AS objective FROM g) SELECT dx, round(k / 100, 6) AS threshold, kept, round(objective, 6) AS objective FROM (SELECT *, row_number() OVER (PARTITION BY dx ORDER BY objective DESC, k {tie}) AS r FROM o) WHERE r = 1".replace("real_dx", "(SELECT DISTINCT dx FROM pool)")


def search(t: Tables, ties: str):
    targets = t.pool.select("dx").distinct().withColumn("target", F.lit(300))
    return rounded(select.threshold_search(t.pool, targets, ties=ties), "threshold", "objective")


@register("se12_threshold_search_high_ties", search_sql("DESC"))
def se12(t: Tables):
    return search(t, "higher")


@register("se13_threshold_search_low_ties", search_sql("ASC"))
def se13(t: Tables):
    return search(t, "lower")


@register("se15_class_context", "WITH s AS (SELECT dx, count(*) AS c, avg(score) AS mean, stddev_pop(score) AS std, quantile_cont(score, 0.25) AS q25, quantile_cont(score, 0.5) AS q50, quantile_cont(score, 0.75) AS q75 FROM pool GROUP BY dx) SELECT dx, round(c / (SELECT count(*) FROM pool), 6) AS prevalence, round(ln(1 + c), 6) AS log_candidates, round(mean, 6) AS mean, round(std, 6) AS std, round(q25, 6) AS q25, round(q50, 6) AS q50, round(q75, 6) AS q75, round(least(1000, greatest(50, round_even(c * 0.5, 0))) / c, 6) AS target_ratio FROM s")
def se15(t: Tables):
    counts = t.pool.groupBy("dx").agg(F.count(F.lit(1)).alias("n"))
    return rounded(select.class_context(t.pool, counts, select.ratio_targets(counts, 0.5, 50, 1000)), "prevalence", "log_candidates", "mean", "std", "q25", "q50", "q75", "target_ratio")


@register("se16_keep_at_least", "SELECT dx, round(least(0.999, max(CASE WHEN r = least(40, n) THEN score END)), 6) AS threshold FROM (SELECT dx, score, row_number() OVER (PARTITION BY dx ORDER BY score DESC, image_id) AS r, count(*) OVER (PARTITION BY dx) AS n FROM pool) GROUP BY dx")
def se16(t: Tables):
    cuts = t.pool.select("dx").distinct().withColumn("threshold", F.lit(0.999))
    return rounded(select.keep_at_least(t.pool, cuts, 40), "threshold")


SAFE = "safe AS (SELECT p.* FROM pool p JOIN flags f USING (image_id) WHERE f.valid AND NOT f.duplicate)"


@register("se17_select_adaptive", f"WITH {SAFE}, e AS (SELECT min(score) AS lo, max(score) AS hi FROM safe), s AS (SELECT image_id, dx, (score - lo) / (hi - lo) AS score FROM safe, e), a AS (SELECT * FROM s WHERE score >= (SELECT quantile_cont(score, 0.25) FROM s)), t AS (SELECT dx, CAST(least(200, greatest(50, round_even(count(*) * 0.1, 0))) AS BIGINT) AS target FROM pool GROUP BY dx), k AS (SELECT CAST(unnest(generate_series(0, 100)) AS INT) AS k), g AS (SELECT t.dx, k.k, count(p.image_id) AS kept, avg(p.score) AS m, any_value(t.target) AS target FROM t CROSS JOIN k LEFT JOIN a p ON p.dx = t.dx AND floor(p.score * 100 + 1e-9) >= k.k GROUP BY t.dx, k.k), o AS (SELECT dx, k, CASE WHEN kept = 0 THEN -1.0 ELSE round(m - 0.5 * abs(kept - target) / target, 12) END AS objective FROM g), c AS (SELECT dx, k / 100 AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY dx ORDER BY objective DESC, k DESC) AS r FROM o) WHERE r = 1), r AS (SELECT *, row_number() OVER (PARTITION BY dx ORDER BY score DESC, image_id) AS r, count(*) OVER (PARTITION BY dx) AS n FROM a), f AS (SELECT dx, max(CASE WHEN r = least(5, n) THEN score END) AS admit FROM r GROUP BY dx) SELECT image_id, r.dx, round(score, 6) AS normalised FROM r JOIN c ON r.dx = c.dx JOIN f ON r.dx = f.dx JOIN t ON r.dx = t.dx WHERE score >= least(threshold, admit) AND r <= target")
def se17(t: Tables):
    counts = t.pool.groupBy("dx").agg(F.count(F.lit(1)).alias("n"))
    return rounded(select.select_adaptive(t.pool, t.flags, counts, ratio=0.1, most_target=200).select("image_id", "dx", "normalised"), "normalised")


@register("se18_select_filled", f"WITH {SAFE}, q AS (SELECT dx, quantile_cont(score, 0.25) AS f FROM safe GROUP BY dx), t AS (SELECT dx, greatest(0, 3100 - count(*)) AS target FROM pool GROUP BY dx), r AS (SELECT image_id, safe.dx, row_number() OVER (PARTITION BY safe.dx ORDER BY score DESC, image_id) AS r FROM safe JOIN q ON safe.dx = q.dx WHERE score >= f) SELECT image_id, r.dx FROM r JOIN t ON r.dx = t.dx WHERE r <= target")
def se18(t: Tables):
    counts = t.pool.groupBy("dx").agg(F.count(F.lit(1)).alias("n"))
    return select.select_filled(t.pool, t.flags, counts, up_to=3100).select("image_id", "dx")


@register("se18_random_matched", "WITH t AS (SELECT dx, greatest(0, 3100 - count(*)) AS target FROM pool GROUP BY dx) SELECT image_id, r.dx FROM (SELECT image_id, dx, row_number() OVER (PARTITION BY dx ORDER BY sha256(concat_ws(':', '11', image_id)), image_id) AS r FROM pool) r JOIN t ON r.dx = t.dx WHERE r <= target")
def se18_random(t: Tables):
    counts = t.pool.groupBy("dx").agg(F.count(F.lit(1)).alias("n"))
    return select.random_matched(t.pool, select.fill_targets(counts, 3100), 11).select("image_id", "dx")


@register("se19_reasons", "WITH c AS (SELECT quantile_cont(score, 0.25) AS f FROM pool), r AS (SELECT p.image_id, p.dx, p.score + CASE WHEN p.score BETWEEN 0.4 AND 0.6 THEN 0.05 ELSE 0.0 END AS adjusted, CASE WHEN p.score < f THEN 'below_floor' WHEN coalesce(g.duplicate, false) THEN 'near_duplicate' END AS reason FROM pool p CROSS JOIN c LEFT JOIN flags g USING (image_id)) SELECT image_id, round(adjusted, 6) AS adjusted, coalesce(reason, CASE WHEN row_number() OVER (PARTITION BY dx, reason IS NULL ORDER BY adjusted DESC, image_id) > 40 THEN 'over_quota' ELSE 'selected' END) AS reason FROM r")
def se19(t: Tables):
    return rounded(select.select_with_reasons(t.pool, t.flags).select("image_id", "adjusted", "reason"), "adjusted")


@register("se20_multilabel_cut", "WITH m AS (SELECT image_id, score, dx AS label FROM pool UNION ALL SELECT image_id, score, 'mod' || image_id % 4 FROM pool), c AS (SELECT * FROM (VALUES ('1-URGENT', 0.8), ('mod1', 0.6), ('mod2', 0.9)) v(label, threshold)) SELECT image_id FROM m JOIN c USING (label) GROUP BY image_id HAVING any_value(score) >= min(threshold)")
def se20(t: Tables):
    cuts = t.spark.createDataFrame([("1-URGENT", 0.8), ("mod1", 0.6), ("mod2", 0.9)], "label string, threshold double")
    m = t.pool.withColumn("label", F.explode(F.array("dx", F.concat(F.lit("mod"), (F.col("image_id") % 4).cast("string")))))
    return m.join(F.broadcast(cuts), "label").groupBy("image_id").agg(F.first("score").alias("s"), F.min("threshold").alias("c")).where("s >= c").select("image_id")


@register("se25_rarity_quotas", "WITH m AS (SELECT quantile_cont(n, 0.5) AS m, list_sort(list(n)) AS v FROM real_counts) SELECT dx, CAST(least(400, greatest(20, round_even(100 * pow(m / n, 0.5), 0))) AS BIGINT) AS quota, CAST(least(400, greatest(20, round_even(100 * v[len(v) // 2 + 1] / greatest(n, 1), 0))) AS BIGINT) AS upper_quota FROM real_counts, m")
def se25(t: Tables):
    a = select.rarity_quotas(t.real_counts, 100, 0.5, 20, 400).select("dx", "quota")
    return a.join(select.quotas_upper_median(t.real_counts, 100, 20, 400).select("dx", F.col("quota").alias("upper_quota")), "dx")


@register("se26_recipe_slots", "WITH q AS (SELECT dx, CAST(least(400, greatest(20, round_even(100 * pow((SELECT quantile_cont(n, 0.5) FROM real_counts) / n, 0.5), 0))) AS BIGINT) AS quota FROM real_counts) SELECT dx || '-' || slot AS recipe_id, dx, slot, CAST('0x' || substr(sha256(concat_ws(':', '42', dx || '-' || slot)), 1, 8) AS BIGINT) AS image_seed FROM (SELECT dx, unnest(generate_series(1, quota)) AS slot FROM q)")
def se26(t: Tables):
    from tessella.functions.hashing import seeded_int

    rows = select.rarity_quotas(t.real_counts, 100, 0.5, 20, 400).withColumn("slot", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("quota"))))
    rows = rows.withColumn("recipe_id", F.concat_ws("-", "dx", "slot"))
    return rows.select("recipe_id", "dx", "slot", seeded_int(42, "recipe_id").alias("image_seed"))


@register("se28_class_weights", "WITH n AS (SELECT dx, count(*) AS n FROM pool GROUP BY dx) SELECT dx, round(1 / n / (SELECT avg(1 / n) FROM n), 6) AS weight FROM n")
def se28(t: Tables):
    return rounded(select.class_weights(t.pool, "dx"), "weight")


@register("sp1_allocation", "WITH c AS (SELECT c_mktsegment AS dx, count(*) AS n FROM customer GROUP BY 1), s AS (SELECT * FROM (VALUES (0, 'train', 0.5), (1, 'validation', 0.2), (2, 'selection', 0.2), (3, 'final', 0.1)) v(pos, split, share)), i AS (SELECT dx, n, pos, split, n * share::DOUBLE AS ideal, floor(n * share::DOUBLE + 1e-9) AS whole FROM c, s) SELECT dx, split, CAST(whole + CASE WHEN row_number() OVER (PARTITION BY dx ORDER BY round(whole - ideal, 9), pos) <= n - sum(whole) OVER (PARTITION BY dx) THEN 1 ELSE 0 END AS BIGINT) AS groups FROM i")
def sp1(t: Tables):
    return sampling.allocation(t.real_counts).select("dx", "split", "groups")


SPLIT_SQL = "c AS (SELECT c_mktsegment AS dx, count(*) AS n FROM customer GROUP BY 1), v AS (SELECT * FROM (VALUES (0, 'train', 0.5), (1, 'validation', 0.2), (2, 'selection', 0.2), (3, 'final', 0.1)) v(pos, split, share)), i AS (SELECT dx, n, pos, split, n * share::DOUBLE AS ideal, floor(n * share::DOUBLE + 1e-9) AS whole FROM c, v), g AS (SELECT dx, pos, split, whole + CASE WHEN row_number() OVER (PARTITION BY dx ORDER BY round(whole - ideal, 9), pos) <= n - sum(whole) OVER (PARTITION BY dx) THEN 1 ELSE 0 END AS k FROM i), e AS (SELECT dx, split, sum(k) OVER (PARTITION BY dx ORDER BY pos) AS hi, sum(k) OVER (PARTITION BY dx ORDER BY pos) - k AS lo FROM g), o AS (SELECT c_custkey, c_mktsegment AS dx, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256(concat_ws(':', '0', c_mktsegment, c_custkey)), c_custkey) - 1 AS r FROM customer), a AS (SELECT c_custkey AS group_id, o.dx, split FROM o JOIN e ON o.dx = e.dx AND r >= lo AND r < hi)"


def assigned(t: Tables):
    return sampling.stratified_groups(t.customer.select(F.col("c_mktsegment").alias("dx"), F.col("c_custkey").alias("group_id")))


@register("sp2_stratified_groups", f"WITH {SPLIT_SQL} SELECT group_id, dx, split FROM a")
def sp2(t: Tables):
    return assigned(t).select("group_id", "dx", "split")


@register("sp3_contiguous_groups", "SELECT group_id, CASE WHEN r < floor(n * 0.5 + 1e-9) THEN 'train' WHEN r < floor(n * 0.5 + 1e-9) + floor(n * 0.2 + 1e-9) THEN 'validation' WHEN r < floor(n * 0.5 + 1e-9) + 2 * floor(n * 0.2 + 1e-9) THEN 'selection' ELSE 'final' END AS split FROM (SELECT c_custkey AS group_id, row_number() OVER (ORDER BY sha256(concat_ws(':', '0', c_custkey)), c_custkey) - 1 AS r, count(*) OVER () AS n FROM customer)")
def sp3(t: Tables):
    return sampling.contiguous_groups(t.customer.select(F.col("c_custkey").alias("group_id")))


@register("sp5_feasibility", "WITH c AS (SELECT c_mktsegment AS dx, count(*) AS n FROM customer GROUP BY 1), s AS (SELECT * FROM (VALUES (0, 'train', 0.5, 0), (1, 'validation', 0.2, 0), (2, 'selection', 0.2, 0), (3, 'final', 0.1, 30)) v(pos, split, share, least_)), i AS (SELECT dx, n, pos, split, least_, n * share::DOUBLE AS ideal, floor(n * share::DOUBLE + 1e-9) AS whole FROM c, s), g AS (SELECT dx, split, least_, CAST(whole + CASE WHEN row_number() OVER (PARTITION BY dx ORDER BY round(whole - ideal, 9), pos) <= n - sum(whole) OVER (PARTITION BY dx) THEN 1 ELSE 0 END AS BIGINT) AS groups FROM i) SELECT dx, split, groups, groups >= least_ AS feasible, CAST(greatest(least_ - groups, 0) AS BIGINT) AS short FROM g")
def sp5(t: Tables):
    return sampling.feasibility(t.real_counts, {"final": 30}).select("dx", "split", "groups", "feasible", "short")


@register("sp6_leakage_audit", f"WITH {SPLIT_SQL}, u AS (SELECT group_id, split FROM a UNION ALL SELECT group_id, 'rogue' FROM a WHERE group_id % 9 = 0) SELECT x.split AS split_a, y.split AS split_b, count(DISTINCT x.group_id) AS shared FROM u x JOIN u y ON x.group_id = y.group_id AND x.split < y.split GROUP BY 1, 2")
def sp6(t: Tables):
    a = assigned(t).select("group_id", "split")
    return sampling.overlaps(a.unionByName(a.where("group_id % 9 = 0").withColumn("split", F.lit("rogue"))), "group_id")


CAND = "c AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE vec_id % 2 = 0), r AS (SELECT vec_id AS ref, label AS rl, list_transform(embedding, lambda x: x::DOUBLE) AS w FROM embeddings WHERE vec_id % 2 = 1), cu AS (SELECT vec_id, label, list_transform(v, lambda x: x / (sqrt(list_dot_product(v, v)) + 1e-8)) AS v FROM c), ru AS (SELECT ref, rl, list_transform(w, lambda x: x / (sqrt(list_dot_product(w, w)) + 1e-8)) AS w FROM r), n AS (SELECT rl, count(*) AS n FROM r GROUP BY rl), p AS (SELECT vec_id, ref, CASE WHEN n.n >= 25 THEN 'same_class' ELSE 'all' END AS tier, list_dot_product(v, w) AS s FROM cu LEFT JOIN n ON n.rl = cu.label JOIN ru ON coalesce(n.n, 0) < 25 OR ru.rl = cu.label)"


def halves(t: Tables):
    e = t.embeddings
    return e.where("vec_id % 2 = 0"), e.where("vec_id % 2 = 1")


@register("ve2_knn_similarity", f"WITH {CAND}, k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, ref) AS r FROM p), a AS (SELECT vec_id, any_value(tier) AS tier, avg(s) AS knn_mean, max(s) AS top1, max(s) - min(s) AS topk_spread, max(s) - avg(CASE WHEN r > 1 THEN s END) AS top1_gap FROM k WHERE r <= 5 GROUP BY vec_id) SELECT vec_id, tier, round(knn_mean, 6) AS knn_mean, round(top1, 6) AS top1, round(topk_spread, 6) AS topk_spread, round(top1_gap, 6) AS top1_gap, top1 >= 0.3 AS is_near_duplicate, round(CASE WHEN top1 >= 0.3 THEN 0.0 ELSE knn_mean END, 6) AS novelty FROM a")
def ve2(t: Tables):
    c, r = halves(t)
    rows = vectors.knn_scores(c, r, "vec_id", "label", "embedding", duplicate=0.3)
    return rounded(rows.select("vec_id", "tier", "knn_mean", "top1", "topk_spread", "top1_gap", "is_near_duplicate", "novelty"), "knn_mean", "top1", "topk_spread", "top1_gap", "novelty")


UNIT = "u AS (SELECT vec_id, label, list_transform(v, lambda x: x / (sqrt(list_dot_product(v, v)) + 1e-8)) AS v FROM (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings))"


@register("ve1_unit_vectors", f"WITH {UNIT} SELECT vec_id, round(sqrt(list_dot_product(v, v)), 6) AS norm, round(v[1], 6) AS first FROM u")
def ve1(t: Tables):
    u = vectors.with_units(t.embeddings.select("vec_id", "embedding"), "embedding")
    return rounded(u.select("vec_id", F.sqrt(vectors.dot("embedding", "embedding")).alias("norm"), F.get("embedding", F.lit(0)).alias("first")), "norm", "first")


@register("ve4_distinctiveness", f"WITH {UNIT}, p AS (SELECT a.vec_id, b.vec_id AS ref, list_dot_product(a.v, b.v) AS s FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, ref) AS r FROM p) SELECT vec_id, round(1 - avg(CASE WHEN r <= 5 THEN s END), 6) AS score, round(max(s), 6) AS max_similarity, count_if(s >= 0.3) AS n_duplicates, count(*) AS n_peers FROM k GROUP BY vec_id")
def ve4(t: Tables):
    rows = vectors.distinctiveness(t.embeddings, "vec_id", "label", "embedding", duplicate=0.3)
    return rounded(rows.select("vec_id", "score", "max_similarity", "n_duplicates", "n_peers"), "score", "max_similarity")


@register("ve5_duplicate_clusters", f"WITH RECURSIVE {UNIT}, e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_dot_product(a.v, b.v) >= 0.33), w(node, seen) AS (SELECT DISTINCT a, a FROM e UNION SELECT w.node, e.b FROM w JOIN e ON w.seen = e.a) SELECT node, min(seen) AS cluster FROM w GROUP BY node")
def ve5(t: Tables):
    return vectors.clusters(vectors.duplicate_edges(t.embeddings, "vec_id", "label", "embedding", 0.33))


@register("ve6_frechet_distance")
def ve6(t: Tables):
    c, r = halves(t)
    return t.spark.createDataFrame([(round(vectors.frechet(c, r, "embedding"), 6),)], "frechet double")


FLAGSHIP = f"WITH {CAND}, k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, ref) AS r FROM p), a AS (SELECT vec_id, avg(s) AS knn_mean, max(s) AS top1 FROM k WHERE r <= 5 GROUP BY vec_id), x AS (SELECT a.vec_id, label, knn_mean FROM a JOIN c ON a.vec_id = c.vec_id WHERE top1 < 0.3), q AS (SELECT label, quantile_cont(knn_mean, 0.25) AS f FROM x GROUP BY label), w AS (SELECT x.vec_id, x.label, knn_mean, row_number() OVER (PARTITION BY x.label ORDER BY knn_mean DESC, x.vec_id) AS rank FROM x JOIN q ON x.label = q.label WHERE knn_mean >= f) SELECT vec_id, label, round(knn_mean, 6) AS knn_mean, rank FROM w WHERE rank <= 10"


def flagship(spark, sf_dir: str):
    """Similarity to references of the class, near duplicates out, quality floor by class, the ten best of each."""
    c, r = halves(Tables(spark, sf_dir))
    scores = vectors.knn_scores(c, r, "vec_id", "label", "embedding", duplicate=0.3)
    rows = scores.where("not is_near_duplicate").join(c.select("vec_id", "label"), "vec_id")
    best = select.top_k(select.class_floor(rows, 0.25, "knn_mean", "label"), 10, "knn_mean", "label", "vec_id")
    return rounded(best.select("vec_id", "label", "knn_mean", F.col("rank").cast("bigint").alias("rank")), "knn_mean")


@register("flagship_select_per_class", FLAGSHIP)
def flagship_query(t: Tables):
    return flagship(t.spark, t.sf_dir)
