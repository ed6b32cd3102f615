"""Metrics, inference, gate and valuation over the stand-ins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.operators import gate, inference, labels, metrics, signals, valuation
from tessella.plans.registry import ORACLES, Tables, register
from tessella.plans.selection import rounded

SEEN = "b AS (SELECT * FROM scored WHERE mask)"


def seen(t: Tables):
    return t.scored.where("mask")


@register("st1_auroc", f"WITH {SEEN}, r AS (SELECT label, target, rank() OVER (PARTITION BY label ORDER BY score) + (count(*) OVER (PARTITION BY label, score) - 1) / 2.0 AS r FROM b) SELECT label, round((sum(CASE WHEN target = 1 THEN r END) - count_if(target = 1) * (count_if(target = 1) + 1) / 2.0) / nullif(count_if(target = 1) * count_if(target = 0), 0), 6) AS auroc FROM r GROUP BY label")
def st1(t: Tables):
    return rounded(metrics.auroc(seen(t), ["label"]), "auroc")


@register("st3_average_precision", f"WITH {SEEN}, r AS (SELECT label, target, sum(CASE WHEN target = 1 THEN 1.0 ELSE 0 END) OVER (PARTITION BY label ORDER BY score DESC, row_id ROWS UNBOUNDED PRECEDING) / row_number() OVER (PARTITION BY label ORDER BY score DESC, row_id) AS p FROM b) SELECT label, round(CAST(sum(CASE WHEN target = 1 THEN p ELSE 0 END) / nullif(count_if(target = 1), 0) AS DOUBLE), 6) AS average_precision FROM r GROUP BY label")
def st3(t: Tables):
    return rounded(metrics.average_precision(seen(t), ["label"]), "average_precision")


@register("st4_brier", f"WITH {SEEN} SELECT label, round(avg(pow(score - target, 2)), 6) AS brier FROM b GROUP BY label")
def st4(t: Tables):
    return rounded(metrics.brier(seen(t), ["label"]), "brier")


ECE = "CASE " + " ".join(f"WHEN score > {k / 10!r} THEN {k}" for k in range(9, 0, -1)) + " ELSE 0 END"


@register("st5_calibration_error", f"WITH {SEEN}, g AS (SELECT label, {ECE} AS bin, count(*) AS n, avg(score) AS s, avg(target) AS y FROM b GROUP BY 1, 2) SELECT label, round(sum(n * abs(s - y)) / sum(n), 6) AS ece FROM g GROUP BY label")
def st5(t: Tables):
    return rounded(metrics.calibration_error(seen(t), ["label"]), "ece")


@register("st6_at_threshold", f"WITH {SEEN}, c AS (SELECT label, CAST(count_if(score >= 0.5 AND target = 1) AS BIGINT) AS tp, CAST(count_if(score >= 0.5 AND target = 0) AS BIGINT) AS fp, CAST(count_if(score < 0.5 AND target = 1) AS BIGINT) AS fn, CAST(count_if(score < 0.5 AND target = 0) AS BIGINT) AS tn FROM b GROUP BY label) SELECT *, round(tp / nullif(tp + fn, 0), 6) AS sensitivity, round(tn / nullif(tn + fp, 0), 6) AS specificity, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c")
def st6(t: Tables):
    return rounded(metrics.at_threshold(seen(t), ["label"]), "sensitivity", "specificity", "f1")


@register("st7_macro_auroc", f"WITH {SEEN}, r AS (SELECT label, target, rank() OVER (PARTITION BY label ORDER BY score) + (count(*) OVER (PARTITION BY label, score) - 1) / 2.0 AS r FROM b), a AS (SELECT label, (sum(CASE WHEN target = 1 THEN r END) - count_if(target = 1) * (count_if(target = 1) + 1) / 2.0) / nullif(count_if(target = 1) * count_if(target = 0), 0) AS auroc FROM r GROUP BY label HAVING count_if(target = 1) >= 10 AND count_if(target = 0) >= 10) SELECT 'all' AS scope, round(avg(auroc), 6) AS macro_auroc, count(auroc) AS n_labels FROM a")
def st7(t: Tables):
    return rounded(metrics.macro_auroc(t.scored.withColumn("scope", F.lit("all")), ["scope"]), "macro_auroc")


PARTS = ("st1_auroc", "st3_average_precision", "st4_brier", "st5_calibration_error", "st6_at_threshold")


@register("st8_binary_suite", "SELECT * FROM (SELECT label, count(*) AS effective_n FROM scored WHERE mask GROUP BY 1)" + "".join(f" LEFT JOIN ({ORACLES[p]}) USING (label)" for p in PARTS))
def st8(t: Tables):
    return rounded(metrics.binary_suite(t.scored, ["label"]), "auroc", "average_precision", "brier", "ece", "sensitivity", "specificity", "f1")


@register("st9_confusion", "WITH k AS (SELECT CAST(unnest(generate_series(0, 4)) AS INT) AS k), s AS (SELECT DISTINCT seed FROM predictions), g AS (SELECT seed, a.k AS true_class, b.k AS predicted FROM s, k a, k b) SELECT g.seed, g.true_class, g.predicted, count(p.image_id) AS n FROM g LEFT JOIN predictions p ON p.seed = g.seed AND p.true_class = g.true_class AND p.predicted = g.predicted GROUP BY 1, 2, 3")
def st9(t: Tables):
    return metrics.confusion(t.predictions, ["seed"], 5)


PER_CLASS = "k AS (SELECT CAST(unnest(generate_series(0, 4)) AS INT) AS class), a AS (SELECT seed, true_class AS class, count(*) AS support, count_if(true_class = predicted) AS tp FROM predictions GROUP BY 1, 2), q AS (SELECT seed, predicted AS class, count(*) AS n_predicted FROM predictions GROUP BY 1, 2), c AS (SELECT a.seed, a.class, support, CAST(coalesce(n_predicted, 0) AS BIGINT) AS n_predicted, coalesce(tp / nullif(n_predicted, 0), 0.0) AS precision, tp / support AS recall FROM a LEFT JOIN q ON a.seed = q.seed AND a.class = q.class), f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1 FROM c)"


@register("st10_per_class", f"WITH {PER_CLASS} SELECT seed, class, support, n_predicted, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f")
def st10(t: Tables):
    return rounded(metrics.per_class(t.predictions, ["seed"], 5), "precision", "recall", "f1")


@register("st11_balanced_accuracy", f"WITH {PER_CLASS}, p AS (SELECT seed, avg(CASE WHEN true_class = predicted THEN 1.0 ELSE 0.0 END) AS accuracy FROM predictions GROUP BY seed) SELECT p.seed, round(any_value(accuracy), 6) AS accuracy, round(avg(recall), 6) AS balanced_accuracy, round(avg(f1), 6) AS macro_f1 FROM p JOIN f ON p.seed = f.seed GROUP BY p.seed")
def st11(t: Tables):
    return rounded(metrics.multiclass_suite(t.predictions, ["seed"], 5), "accuracy", "balanced_accuracy", "macro_f1")


PROBS = "SELECT o_orderkey AS image_id, CAST(substr(o_orderpriority, 1, 1) AS INT) - 1 AS true_class, CAST((o_orderkey * 31) % 101 AS DOUBLE) / 101 AS p0, CAST((o_orderkey * 17) % 103 AS DOUBLE) / 103 AS p1, CAST((o_orderkey * 7) % 107 AS DOUBLE) / 107 AS p2 FROM orders"


@register("st12_one_vs_rest", f"WITH x AS ({PROBS}), e AS (SELECT image_id, 0 AS class, p0 AS s, CASE WHEN true_class = 0 THEN 1 ELSE 0 END AS y FROM x UNION ALL SELECT image_id, 1, p1, CASE WHEN true_class = 1 THEN 1 ELSE 0 END FROM x UNION ALL SELECT image_id, 2, p2, CASE WHEN true_class = 2 THEN 1 ELSE 0 END FROM x), r AS (SELECT class, y, rank() OVER (PARTITION BY class ORDER BY s) + (count(*) OVER (PARTITION BY class, s) - 1) / 2.0 AS r, sum(y) OVER (PARTITION BY class ORDER BY s DESC, image_id ROWS UNBOUNDED PRECEDING) / row_number() OVER (PARTITION BY class ORDER BY s DESC, image_id) AS p FROM e) SELECT class, round((sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 6) AS auroc, round(sum(CASE WHEN y = 1 THEN p ELSE 0 END) / sum(y), 6) AS average_precision FROM r GROUP BY class")
def st12(t: Tables):
    return rounded(metrics.one_vs_rest(t.sql(PROBS), [], ["p0", "p1", "p2"]), "auroc", "average_precision")


@register("st25_prediction_table", f"WITH x AS ({PROBS}) SELECT image_id, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS predicted, round(greatest(p0, p1, p2), 6) AS p_top, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END = true_class AS correct FROM x")
def st25(t: Tables):
    p = F.array("p0", "p1", "p2")
    return rounded(t.sql(PROBS).select("image_id", metrics.argmax_class(p).cast("int").alias("predicted"), F.array_max(p).alias("p_top"), (metrics.argmax_class(p) == F.col("true_class")).alias("correct")), "p_top")


@register("st2_spearman", "WITH x AS (SELECT l_linenumber AS g, l_quantity AS a, l_extendedprice AS b FROM lineitem), r AS (SELECT g, rank() OVER (PARTITION BY g ORDER BY a) + (count(*) OVER (PARTITION BY g, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY g ORDER BY b) + (count(*) OVER (PARTITION BY g, b) - 1) / 2.0 AS rb FROM x) SELECT g, count(*) AS n, round(corr(ra, rb), 6) AS rho, NULL::VARCHAR AS reason FROM r GROUP BY g UNION ALL SELECT -1, 3, NULL, 'constant_x'")
def st2(t: Tables):
    rows = t.lineitem.select(F.col("l_linenumber").alias("g"), F.col("l_quantity").alias("a"), F.col("l_extendedprice").alias("b"))
    flat = t.spark.createDataFrame([(-1, 1.0, 2.0), (-1, 1.0, 3.0), (-1, 1.0, 4.0)], "g int, a double, b double")
    return rounded(metrics.spearman(rows.unionByName(flat), ["g"], "a", "b"), "rho")


@register("st26_rank_agreement_per_class", "WITH x AS (SELECT dx, score AS a, CAST((image_id * 13) % 31 AS DOUBLE) AS b FROM pool), r AS (SELECT dx, rank() OVER (PARTITION BY dx ORDER BY a) + (count(*) OVER (PARTITION BY dx, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY dx ORDER BY b) + (count(*) OVER (PARTITION BY dx, b) - 1) / 2.0 AS rb FROM x), c AS (SELECT dx, corr(ra, rb) AS rho FROM r GROUP BY dx) SELECT round(avg(rho), 6) AS macro, round(quantile_cont(rho, 0.5), 6) AS median FROM c")
def st26(t: Tables):
    rows = t.pool.withColumn("b", ((F.col("image_id") * 13) % 31).cast("double"))
    return rounded(metrics.spearman(rows, ["dx"], "score", "b").agg(F.avg("rho").alias("macro"), F.percentile("rho", F.lit(0.5)).alias("median")), "macro", "median")


@register("st27_pairwise_ranking", "WITH x AS (SELECT subset_id, utility, CAST((subset_id * 37) % 41 AS DOUBLE) / 41 AS p FROM subsets) SELECT count(*) AS n_pairs, round(avg(CASE WHEN sign(a.p - b.p) = sign(a.utility - b.utility) THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(ln(1 + exp(-(a.p - b.p) * sign(a.utility - b.utility)))), 6) AS logistic_loss FROM x a JOIN x b ON a.subset_id < b.subset_id AND a.utility <> b.utility")
def st27(t: Tables):
    rows = t.subsets.withColumns({"p": ((F.col("subset_id") * 37) % 41).cast("double") / 41, "one": F.lit(1)})
    return rounded(metrics.pairwise_ranking_accuracy(rows, ["one"], "p", "utility", "subset_id").drop("one"), "accuracy", "logistic_loss")


@register("st30_masked_bce", "SELECT label, round(coalesce(sum(CASE WHEN mask THEN greatest(z, 0) - z * target + ln(1 + exp(-abs(z))) END) / nullif(count_if(mask), 0), 0), 6) AS masked_bce FROM (SELECT *, 4 * score - 2 AS z FROM scored) GROUP BY label")
def st30(t: Tables):
    return rounded(metrics.masked_bce(t.scored.withColumn("logit", 4 * F.col("score") - 2), ["label"]), "masked_bce")


@register("se27_youden_threshold", f"WITH {SEEN}, g AS (SELECT label, k, sum(CASE WHEN target = 1 AND floor(score * 20 + 1e-9) >= k THEN 1.0 ELSE 0 END) / nullif(count_if(target = 1), 0) - sum(CASE WHEN target = 0 AND floor(score * 20 + 1e-9) >= k THEN 1.0 ELSE 0 END) / nullif(count_if(target = 0), 0) AS j FROM b, (SELECT unnest(generate_series(1, 19)) AS k) GROUP BY label, k) SELECT label, round(coalesce(max_by(k, round(j, 12) * 1000000 - k) / 20, 0.5), 6) AS threshold, round(max(j)::DOUBLE, 6) AS j FROM g GROUP BY label")
def se27(t: Tables):
    return rounded(metrics.youden(seen(t), ["label"]), "threshold", "j")


@register("st15_holm", "WITH p AS (SELECT c_mktsegment AS family, c_custkey AS name, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE (c_custkey % 97) / 1000.0::DOUBLE END AS p FROM customer), r AS (SELECT *, CASE WHEN p IS NOT NULL THEN least(1.0, p * (count(p) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p ASC NULLS LAST, name) + 1)) END AS raw FROM p), a AS (SELECT *, CASE WHEN p IS NOT NULL THEN max(raw) OVER (PARTITION BY family ORDER BY p ASC NULLS LAST, name ROWS UNBOUNDED PRECEDING) END AS adjusted FROM r) SELECT family, name, round(adjusted, 6) AS adjusted, coalesce(adjusted <= 0.05, false) AS rejected, CASE WHEN p IS NULL THEN 'undefined_p' END AS note FROM a")
def st15(t: Tables):
    return rounded(inference.holm(p_values(t), ["family"]).select("family", "name", "adjusted", "rejected", "note"), "adjusted")


def p_values(t: Tables):
    return t.customer.select(F.col("c_mktsegment").alias("family"), F.col("c_custkey").alias("name"), F.when(F.col("c_custkey") % 10 != 0, (F.col("c_custkey") % 97) / 1000.0).alias("p"))


@register("st16_benjamini_hochberg", "WITH p AS (SELECT c_mktsegment AS family, c_custkey AS name, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE (c_custkey % 97) / 1000.0::DOUBLE END AS p FROM customer), r AS (SELECT *, CASE WHEN p IS NOT NULL THEN least(1.0, p * count(p) OVER (PARTITION BY family) / row_number() OVER (PARTITION BY family ORDER BY p ASC NULLS LAST, name)) END AS raw FROM p), a AS (SELECT *, CASE WHEN p IS NOT NULL THEN min(raw) OVER (PARTITION BY family ORDER BY p ASC NULLS LAST, name ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) END AS adjusted FROM r) SELECT family, name, round(adjusted, 6) AS adjusted, coalesce(adjusted <= 0.05, false) AS rejected FROM a")
def st16(t: Tables):
    return rounded(inference.benjamini_hochberg(p_values(t), ["family"]).select("family", "name", "adjusted", "rejected"), "adjusted")


DRAWS = "u AS (SELECT unit, row_number() OVER (ORDER BY unit) - 1 AS pos FROM (SELECT DISTINCT lesion_id AS unit FROM predictions)), n AS (SELECT count(*) AS n FROM u), w AS (SELECT b, CAST('0x' || substr(sha256(concat_ws(':', '3', b, k)), 1, 8) AS BIGINT) % n AS pos, count(*) AS weight FROM n, (SELECT unnest(generate_series(1, 40)) AS b), (SELECT unnest(generate_series(1, (SELECT n FROM n))) AS k) GROUP BY 1, 2), d AS (SELECT b, unit, weight FROM w JOIN u ON w.pos = u.pos)"


@register("st13_cluster_bootstrap", f"WITH {DRAWS}, s AS (SELECT condition, lesion_id AS unit, sum(CASE WHEN true_class = predicted THEN 1.0::DOUBLE ELSE 0 END) AS s, count(*) AS c FROM predictions GROUP BY 1, 2), v AS (SELECT condition, b, sum(s * weight) / sum(c * weight) AS v FROM d JOIN s USING (unit) GROUP BY 1, 2), i AS (SELECT condition, quantile_cont(v, 0.025) AS low, quantile_cont(v, 0.975) AS high, count(v) AS n_draws FROM v GROUP BY 1) SELECT s.condition, round(sum(s) / sum(c), 6) AS estimate, count(*) AS n_units, round(any_value(low), 6) AS low, round(any_value(high), 6) AS high, any_value(n_draws) AS n_draws FROM s JOIN i ON s.condition = i.condition GROUP BY s.condition")
def st13(t: Tables):
    rows = t.predictions.withColumn("hit", (F.col("true_class") == F.col("predicted")).cast("double"))
    return rounded(inference.bootstrap_rate(rows, "lesion_id", "hit", ["condition"], 40, 3), "estimate", "low", "high")


@register("st14_paired_bootstrap", f"WITH {DRAWS}, s AS (SELECT lesion_id AS unit, sum(CASE WHEN condition = 'A' AND true_class = predicted THEN 1.0::DOUBLE WHEN condition = 'A' THEN 0.0 END) AS sa, count(CASE WHEN condition = 'A' THEN 1 END) AS ca, sum(CASE WHEN condition = 'B' AND true_class = predicted THEN 1.0::DOUBLE WHEN condition = 'B' THEN 0.0 END) AS sb, count(CASE WHEN condition = 'B' THEN 1 END) AS cb FROM predictions WHERE condition IN ('A', 'B') GROUP BY 1), o AS (SELECT sum(sa) / sum(ca) - sum(sb) / sum(cb) AS difference, count(*) AS n_units FROM s), e AS (SELECT b, sum(sa * weight) / sum(ca * weight) - sum(sb * weight) / sum(cb * weight) AS d FROM d JOIN s USING (unit) GROUP BY b) SELECT round(difference, 6) AS difference, any_value(n_units) AS n_units, round(quantile_cont(d, 0.025), 6) AS low, round(quantile_cont(d, 0.975), 6) AS high, round(least(1.0, 2 * avg(CASE WHEN CASE WHEN difference > 0 THEN d <= 0 ELSE d >= 0 END THEN 1.0 ELSE 0.0 END)), 6) AS p_value FROM e, o GROUP BY difference")
def st14(t: Tables):
    rows = t.predictions.withColumn("hit", (F.col("true_class") == F.col("predicted")).cast("double"))
    return rounded(inference.paired_difference(rows, "lesion_id", "hit", "condition", "A", "B", 40, 3), "difference", "low", "high", "p_value")


ANOVA = "c AS (SELECT subset_id, count(*) AS n, avg(y) AS m, var_pop(y) AS v FROM repeats GROUP BY 1), a AS (SELECT count(*) AS k, sum(n) AS total, sum(n * v) AS ssw, sum(n * m * m) - pow(sum(n * m), 2) / sum(n) AS ssb FROM c), q AS (SELECT k, total, ssb / (k - 1) AS ms_between, ssw / (total - k) AS ms_within FROM a), z AS (SELECT *, (ms_between - ms_within) / (total / k) AS between_ FROM q)"


@register("st20_variance_components", f"WITH {ANOVA} SELECT k AS n_subsets, round(ms_between, 4) AS ms_between, round(ms_within, 4) AS ms_within, round(between_, 4) AS between, round(sqrt(greatest(between_, 0.0)), 4) AS sd_between, round(sqrt(ms_within), 4) AS sd_within, round(greatest(between_, 0.0) / (greatest(between_, 0.0) + ms_within), 4) AS icc FROM z")
def st20(t: Tables):
    return rounded(inference.variance_components(t.repeats, []), "ms_between", "ms_within", "between", "sd_between", "sd_within", "icc", places=4)


@register("st21_reliability", "WITH i AS (SELECT unnest([0.0, 0.14, 0.5]) AS icc), r AS (SELECT icc::DOUBLE AS icc, CAST(unnest(generate_series(1, 10)) AS INT) AS repeats FROM i), x AS (SELECT icc, repeats, repeats * icc / (1 + (repeats - 1) * icc) AS reliability FROM r) SELECT icc, repeats, round(reliability, 6) AS reliability, round(sqrt(reliability), 6) AS ceiling, CASE WHEN reliability >= 0.8 THEN 'reliable' WHEN reliability >= 0.5 THEN 'usable' ELSE 'noise' END AS verdict, CAST(ceil(0.8 * (1 - icc) / nullif(icc * (1 - 0.8::DOUBLE), 0) - 1e-9) AS BIGINT) AS needed FROM x")
def st21(t: Tables):
    rows = t.spark.createDataFrame([(0.0,), (0.14,), (0.5,)], "icc double")
    out = inference.reliability_table(rows).withColumn("needed", inference.repeats_needed(F.col("icc")).cast("bigint"))
    return rounded(out, "reliability", "ceiling")


@register("st24_wilson_agreement", "WITH c AS (SELECT seed, true_class, count_if(true_class = predicted) AS k, count(*) AS n FROM predictions GROUP BY GROUPING SETS ((seed, true_class), (seed))) SELECT seed, coalesce(CAST(true_class AS VARCHAR), 'ALL') AS class, n, round(k / n, 6) AS agreement, round(greatest(0, (k / n + 1.959963984540054 ** 2 / (2 * n)) / (1 + 1.959963984540054 ** 2 / n) - 1.959963984540054 / (1 + 1.959963984540054 ** 2 / n) * sqrt(k / n * (1 - k / n) / n + 1.959963984540054 ** 2 / (4 * n * n))), 6) AS low, round(least(1, (k / n + 1.959963984540054 ** 2 / (2 * n)) / (1 + 1.959963984540054 ** 2 / n) + 1.959963984540054 / (1 + 1.959963984540054 ** 2 / n) * sqrt(k / n * (1 - k / n) / n + 1.959963984540054 ** 2 / (4 * n * n))), 6) AS high FROM c")
def st24(t: Tables):
    p = t.predictions
    both = p.select("seed", F.col("true_class").cast("string").alias("class"), (F.col("true_class") == F.col("predicted")).alias("hit"))
    # the subtotal comes from the classes' counts, not from another pass over the rows
    each = both.groupBy("seed", "class").agg(F.count_if("hit").alias("k"), F.count(F.lit(1)).alias("n"))
    rows = each.unionByName(each.groupBy("seed").agg(F.sum("k").alias("k"), F.sum("n").alias("n")).withColumn("class", F.lit("ALL")))
    low, high = inference.wilson(F.col("k"), F.col("n"))
    return rounded(rows.select("seed", "class", "n", (F.col("k") / F.col("n")).alias("agreement"), low.alias("low"), high.alias("high")), "agreement", "low", "high")


@register("st29_quantiles", "SELECT dx, round(quantile_cont(score, 0.05), 6) AS q05, round(quantile_cont(score, 0.5), 6) AS q50, round(quantile_cont(score, 0.95), 6) AS q95 FROM pool GROUP BY dx")
def st29(t: Tables):
    return rounded(t.pool.groupBy("dx").agg(*[F.percentile("score", F.lit(q)).alias(f"q{int(100 * q):02d}") for q in (0.05, 0.5, 0.95)]), "q05", "q50", "q95")


@register("ag9_banzhaf", "WITH t AS (SELECT sum(utility) AS a, count(*) AS n FROM subsets), o AS (SELECT image_id, sum(utility) AS s, count(*) AS k FROM members JOIN subsets USING (subset_id) GROUP BY 1) SELECT image_id, k AS exposures, round(CASE WHEN k >= 2 AND n - k >= 2 THEN s / k - (a - s) / (n - k) END, 4) AS value FROM o, t")
def ag9(t: Tables):
    return rounded(valuation.banzhaf(t.subsets, t.members, 2), "value", places=4)


@register("ag10_value_agreement", "WITH t AS (SELECT sum(utility) AS a, count(*) AS n FROM subsets), o AS (SELECT image_id, sum(utility) AS s, count(*) AS k FROM members JOIN subsets USING (subset_id) GROUP BY 1), l AS (SELECT image_id, avg((utility - utility * 0.9) * (k - 1)) AS y FROM members JOIN subsets USING (subset_id) JOIN (SELECT subset_id, count(*) AS k FROM members GROUP BY 1) USING (subset_id) GROUP BY image_id), v AS (SELECT o.image_id, s / k - (a - s) / (n - k) AS x, y FROM o JOIN l USING (image_id), t), r AS (SELECT rank() OVER (ORDER BY x) AS rx, rank() OVER (ORDER BY y) AS ry FROM v) SELECT round(corr(rx, ry), 6) AS rho FROM r")
def ag10(t: Tables):
    b = valuation.banzhaf(t.subsets, t.members).select("image_id", F.col("value").alias("x"))
    loo = left_out(t).select("image_id", F.col("target").alias("y"))
    return rounded(metrics.spearman(b.join(loo, "image_id"), [], "x", "y").select("rho"), "rho")


@register("ag11_marginal_targets", "SELECT image_id, round(avg((utility - utility * 0.9) * (k - 1)), 4) AS target, count(*) AS n_subsets FROM members JOIN subsets USING (subset_id) JOIN (SELECT subset_id, count(*) AS k FROM members GROUP BY 1) USING (subset_id) GROUP BY image_id")
def ag11(t: Tables):
    return rounded(left_out(t), "target", places=4)


def left_out(t: Tables):
    """Leave-one-out targets, where leaving any image out costs a tenth."""
    n = t.members.groupBy("subset_id").agg(F.count(F.lit(1)).alias("n"))
    rows = t.members.join(t.subsets, "subset_id").join(n, "subset_id").select("subset_id", "image_id", F.col("utility").alias("u_full"), (F.col("utility") * 0.9).alias("u_without"), "n")
    return valuation.marginal_targets(rows)


@register("ag12_under_exposed", "SELECT i.image_id, count(m.subset_id) AS exposures FROM (SELECT unnest(generate_series(0, 54)) AS image_id) i LEFT JOIN members m ON m.image_id = i.image_id GROUP BY 1 HAVING count(m.subset_id) < 25")
def ag12(t: Tables):
    return valuation.under_exposed(t.spark.range(55).withColumnRenamed("id", "image_id"), t.members, 25)


@register("ag29_pooled_features", "SELECT subset_id, round(avg(f), 6) AS f_mean, round(stddev_pop(f), 6) AS f_std FROM members JOIN (SELECT unnest(generate_series(0, 49)) AS image_id, (unnest(generate_series(0, 49)) * 7) % 13 / 13 AS f) x USING (image_id) GROUP BY subset_id")
def ag29(t: Tables):
    features = t.spark.range(50).select(F.col("id").alias("image_id"), (((F.col("id") * 7) % 13) / 13).alias("f"))
    return rounded(valuation.pooled_features(t.members, features, ["f"]), "f_mean", "f_std")


MEASURED = "SELECT l_orderkey AS context_id, l_linenumber AS position, l_linenumber / 10 AS threshold, CAST((l_orderkey * 7 + l_linenumber * 3) % 5 AS DOUBLE) AS utility, (l_orderkey * 11 + l_linenumber) % 40 AS selected, 40 AS pool_size FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) d"


@register("ag22_best_measured", f"WITH m AS ({MEASURED}) SELECT context_id, threshold, utility FROM (SELECT *, row_number() OVER (PARTITION BY context_id ORDER BY utility DESC, position) AS r FROM m) WHERE r = 1")
def ag22(t: Tables):
    return valuation.best_measured(t.sql(MEASURED))


@register("ag23_least_ranked", f"WITH m AS ({MEASURED}), r AS (SELECT *, row_number() OVER (PARTITION BY context_id ORDER BY utility DESC, position) AS rank FROM m) SELECT context_id, threshold FROM r WHERE rank = 1")
def ag23(t: Tables):
    return valuation.least_ranked(valuation.ranked_in_context(t.sql(MEASURED)))


@register("wn13_rank_in_context", f"WITH m AS ({MEASURED}) SELECT context_id, position, row_number() OVER (PARTITION BY context_id ORDER BY utility DESC, position) AS rank FROM m")
def wn13(t: Tables):
    return valuation.ranked_in_context(t.sql(MEASURED)).select("context_id", "position", F.col("rank").cast("bigint").alias("rank"))


@register("se23_diversified", f"WITH m AS ({MEASURED}), r AS (SELECT *, row_number() OVER (PARTITION BY context_id ORDER BY utility DESC, position) AS rank, count(*) OVER (PARTITION BY context_id) AS n, min(threshold) OVER (PARTITION BY context_id) AS lo, max(threshold) OVER (PARTITION BY context_id) AS hi, row_number() OVER (PARTITION BY context_id ORDER BY abs(selected - pool_size / 2), position) AS half FROM m), q AS (SELECT *, concat_ws(',', CASE WHEN rank <= 3 THEN 'top' END, CASE WHEN (rank - 1) % greatest(1, (n - 1) // 4) = 0 THEN 'spaced' END, CASE WHEN threshold = lo OR threshold = hi THEN 'boundary' END, CASE WHEN half = 1 THEN 'half_pool' END) AS reasons FROM r) SELECT context_id, threshold, rank, reasons FROM q WHERE reasons <> ''")
def se23(t: Tables):
    return valuation.diversified(t.sql(MEASURED)).withColumn("rank", F.col("rank").cast("bigint"))


@register("st28_threshold_regret", f"WITH m AS ({MEASURED}), b AS (SELECT context_id, threshold AS bt, utility AS bu FROM (SELECT *, row_number() OVER (PARTITION BY context_id ORDER BY utility DESC, position) AS r FROM m) WHERE r = 1) SELECT m.context_id, round(abs(threshold - bt), 6) AS threshold_error, bu - utility AS regret FROM m JOIN b ON m.context_id = b.context_id WHERE position = 1")
def st28(t: Tables):
    m = t.sql(MEASURED)
    return rounded(valuation.regret(m, m.where("position = 1").select("context_id", "threshold")), "threshold_error")


@register("ag24_median_threshold", f"WITH m AS ({MEASURED}) SELECT position, round(quantile_cont(threshold * utility, 0.5), 6) AS median FROM m GROUP BY position")
def ag24(t: Tables):
    return rounded(t.sql(MEASURED).groupBy("position").agg(F.percentile(F.col("threshold") * F.col("utility"), F.lit(0.5)).alias("median")), "median")


@register("ag25_mean_threshold", f"WITH m AS ({MEASURED}) SELECT round(avg(coalesce(CASE WHEN utility > 1 THEN threshold END, 0.5)), 6) AS mean_threshold FROM m")
def ag25(t: Tables):
    return rounded(t.sql(MEASURED).agg(F.avg(F.coalesce(F.when(F.col("utility") > 1, F.col("threshold")), F.lit(0.5))).alias("mean_threshold")), "mean_threshold")


@register("ag26_threshold_stability", f"WITH m AS ({MEASURED}), s AS (SELECT context_id, stddev_pop(threshold) AS s FROM m GROUP BY 1 HAVING count(*) >= 2) SELECT round(quantile_cont(s, 0.5), 6) AS stability FROM s")
def ag26(t: Tables):
    each = t.sql(MEASURED).groupBy("context_id").agg(F.stddev_pop("threshold").alias("s"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    return rounded(each.agg(F.percentile("s", F.lit(0.5)).alias("stability")), "stability")


@register("ag15_condition_summary", f"WITH {PER_CLASS}, m AS (SELECT seed, avg(recall) AS v FROM f GROUP BY seed) SELECT seed % 2 AS arm, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, count(*) AS n_seeds, count(*) = 2 AS complete FROM m GROUP BY 1")
def ag15(t: Tables):
    m = metrics.multiclass_suite(t.predictions, ["seed"], 5)
    return rounded(m.groupBy((F.col("seed") % 2).alias("arm")).agg(F.avg("balanced_accuracy").alias("mean"), F.stddev_samp("balanced_accuracy").alias("std"), F.count(F.lit(1)).alias("n_seeds"), (F.count(F.lit(1)) == 2).alias("complete")), "mean", "std")


@register("ag16_delta_vs_baseline", f"WITH {PER_CLASS} SELECT a.seed, a.class, round(a.recall - b.recall, 6) AS delta FROM f a JOIN f b ON a.class = b.class AND b.seed = 1 WHERE a.seed > 1")
def ag16(t: Tables):
    c = metrics.per_class(t.predictions, ["seed"], 5)
    base = c.where("seed = 1").select("class", F.col("recall").alias("b_"))
    return rounded(c.where("seed > 1").join(base, "class").select("seed", "class", (F.col("recall") - F.col("b_")).alias("delta")), "delta")


@register("ag19_paired_flips", "WITH h AS (SELECT image_id, condition, true_class = predicted AS hit FROM predictions) SELECT a.condition AS a, b.condition AS b, CAST(count_if(a.hit AND b.hit) AS BIGINT) AS both, CAST(count_if(a.hit AND NOT b.hit) AS BIGINT) AS only_a, CAST(count_if(NOT a.hit AND b.hit) AS BIGINT) AS only_b, CAST(count_if(NOT a.hit AND NOT b.hit) AS BIGINT) AS neither FROM h a JOIN h b ON a.image_id = b.image_id AND a.condition < b.condition GROUP BY 1, 2")
def ag19(t: Tables):
    h = t.predictions.select("image_id", "condition", (F.col("true_class") == F.col("predicted")).alias("hit"))
    a, b = h.select("image_id", F.col("condition").alias("a"), F.col("hit").alias("ha")), h.select("image_id", F.col("condition").alias("b"), F.col("hit").alias("hb"))
    p, q = F.col("ha"), F.col("hb")
    return a.join(b, "image_id").where("a < b").groupBy("a", "b").agg(F.count_if(p & q).alias("both"), F.count_if(p & ~q).alias("only_a"), F.count_if(~p & q).alias("only_b"), F.count_if(~p & ~q).alias("neither"))


@register("ag20_pivot", "SELECT subset_id, " + ", ".join(f"round(max(CASE WHEN seed = {k} THEN y END), 6) AS s{k}" for k in range(1, 8)) + " FROM repeats GROUP BY subset_id")
def ag20(t: Tables):
    wide = t.repeats.groupBy("subset_id").pivot("seed", list(range(1, 8))).agg(F.max("y"))
    return rounded(wide.select("subset_id", *[F.col(str(k)).alias(f"s{k}") for k in range(1, 8)]), *[f"s{k}" for k in range(1, 8)])


@register("ag30_ensemble_or_mean", "WITH e AS (SELECT image_id, any_value(true_class) AS y, avg(CASE WHEN predicted = 0 THEN 1.0 ELSE 0 END) AS p FROM predictions GROUP BY 1), m AS (SELECT seed, avg(pow(CASE WHEN predicted = 0 THEN 1.0 ELSE 0 END - CASE WHEN true_class = 0 THEN 1 ELSE 0 END, 2)) AS b FROM predictions GROUP BY 1) SELECT round((SELECT avg(pow(p - CASE WHEN y = 0 THEN 1 ELSE 0 END, 2)) FROM e), 6) AS of_ensemble, round((SELECT avg(b) FROM m), 6) AS mean_of_seeds")
def ag30(t: Tables):
    rows = t.predictions.select("image_id", "seed", (F.col("predicted") == 0).cast("double").alias("score"), (F.col("true_class") == 0).cast("int").alias("target"))
    e = metrics.brier(rows.groupBy("image_id", "target").agg(F.avg("score").alias("score")), []).select(F.col("brier").alias("of_ensemble"))
    m = metrics.brier(rows, ["seed"]).agg(F.avg("brier").alias("mean_of_seeds"))
    return rounded(e.crossJoin(F.broadcast(m)), "of_ensemble", "mean_of_seeds")


@register("ag31_quality_report", "SELECT coalesce(dx, 'ALL') AS dx, count(*) AS n, round(quantile_cont(score, 0.5), 6) AS median, count(DISTINCT score) AS n_distinct, round(avg(CASE WHEN score < 0.1 THEN 1.0 ELSE 0 END), 6) AS low_rate FROM pool GROUP BY GROUPING SETS ((dx), ())")
def ag31(t: Tables):
    p = t.pool
    report = [F.count(F.lit(1)).alias("n"), F.percentile("score", F.lit(0.5)).alias("median"), F.count_distinct("score").alias("n_distinct"), F.avg((F.col("score") < 0.1).cast("double")).alias("low_rate")]
    return rounded(p.groupBy("dx").agg(*report).unionByName(p.agg(*report).withColumn("dx", F.lit("ALL"))), "median", "low_rate")


@register("gt3_column_checks", "SELECT * FROM (VALUES ('score', 'technical_validity', true), ('score', 'numerical_stability', true), ('score', 'missing_rate', true), ('b', 'technical_validity', true), ('b', 'numerical_stability', false), ('b', 'missing_rate', false)) v(signal, \"check\", passed)")
def gt3(t: Tables):
    rows = t.pool.withColumn("b", F.when(F.col("image_id") % 2 == 0, (F.col("image_id") % 3).cast("double")))
    return gate.column_checks(rows, ["score", "b"], 20, 0.05)


@register("gt6_directionality", "SELECT round(avg(CASE WHEN image_id % 17 = 0 THEN score END), 6) AS flagged_mean, round(avg(CASE WHEN image_id % 17 <> 0 THEN score END), 6) AS clean_mean, avg(CASE WHEN image_id % 17 = 0 THEN score END) < avg(CASE WHEN image_id % 17 <> 0 THEN score END) AS passed FROM pool")
def gt6(t: Tables):
    return rounded(gate.contrast(t.pool.withColumn("flag", F.col("image_id") % 17 == 0), "score", "flag"), "flagged_mean", "clean_mean")


@register("gt7_redundancy_within", "WITH x AS (SELECT dx, score AS a, CAST((image_id * 13) % 31 AS DOUBLE) AS b FROM pool), r AS (SELECT dx, rank() OVER (PARTITION BY dx ORDER BY a) + (count(*) OVER (PARTITION BY dx, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY dx ORDER BY b) + (count(*) OVER (PARTITION BY dx, b) - 1) / 2.0 AS rb FROM x), c AS (SELECT dx, corr(ra, rb) AS rho, count(*) AS n FROM r GROUP BY dx) SELECT 'score' AS x, 'b' AS y, round(sum(abs(rho) * n) / sum(n), 6) AS correlation FROM c")
def gt7(t: Tables):
    return rounded(gate.redundancy_within(t.pool.withColumn("b", ((F.col("image_id") * 13) % 31).cast("double")), ["score", "b"], "dx"), "correlation")


@register("gt7_redundancy_pooled", "SELECT 'l_quantity' AS x, 'l_extendedprice' AS y, round(abs(corr(l_quantity, l_extendedprice)), 6) AS correlation FROM lineitem UNION ALL SELECT 'l_quantity', 'flat', NULL UNION ALL SELECT 'l_extendedprice', 'flat', NULL")
def gt7p(t: Tables):
    return rounded(gate.redundancy_pooled(t.lineitem.withColumn("flat", F.lit(1.0)), ["l_quantity", "l_extendedprice", "flat"]), "correlation")


@register("gt8_usefulness", "WITH x AS (SELECT image_id, dx, (score - min(score) OVER (PARTITION BY dx)) / (max(score) OVER (PARTITION BY dx) - min(score) OVER (PARTITION BY dx)) AS a, CAST((image_id * 13) % 31 AS DOUBLE) / 30 AS b FROM pool), y AS (SELECT image_id, dx, round((a + b) / 2, 9) AS m, round(b / 1.0, 9) AS na, round(a / 1.0, 9) AS nb, greatest(1, round_even(count(*) OVER (PARTITION BY dx) * 0.2, 0)) AS n FROM x), z AS (SELECT row_number() OVER (PARTITION BY dx ORDER BY m DESC, image_id) <= n AS i, row_number() OVER (PARTITION BY dx ORDER BY na DESC, image_id) <= n AS ia, row_number() OVER (PARTITION BY dx ORDER BY nb DESC, image_id) <= n AS ib FROM y) SELECT 'score' AS signal, round(count_if(i AND ia) / count_if(i OR ia), 6) AS jaccard FROM z UNION ALL SELECT 'b', round(count_if(i AND ib) / count_if(i OR ib), 6) FROM z")
def gt8(t: Tables):
    return rounded(gate.usefulness(t.pool.withColumn("b", ((F.col("image_id") * 13) % 31).cast("double")), ["score", "b"], "image_id", ["dx"], 0.2), "jaccard")


CHECKS = ("technical_validity", "numerical_stability", "missing_rate", "provenance", "directionality", "redundancy", "usefulness")
#: Passed or not by sums over the events of a type.
CHECK_SQL = "SELECT event_type AS signal, check_name, (sum(event_id * (k + 3)) + k * k) % 5 <> 0 AS passed FROM events CROSS JOIN (" + " UNION ALL ".join(f"SELECT {k} AS k, '{c}' AS check_name" for k, c in enumerate(CHECKS)) + ") c GROUP BY event_type, k, check_name"
FAILED = lambda names: "coalesce(string_agg(CASE WHEN NOT passed AND check_name IN (" + ", ".join(f"'{n}'" for n in names) + ") THEN check_name END, ',' ORDER BY check_name), '')"
DECIDED = f"c AS ({CHECK_SQL}), f AS (SELECT signal, {FAILED(CHECKS[:4])} AS hard, {FAILED(CHECKS[4:5])} AS direction, {FAILED(CHECKS[5:])} AS soft FROM c GROUP BY signal), o AS (SELECT signal, CASE WHEN hard <> '' OR direction <> '' THEN 'exclude' WHEN soft <> '' THEN 'ablation' ELSE 'include' END AS outcome, CASE WHEN hard <> '' THEN hard WHEN direction <> '' THEN direction WHEN soft <> '' THEN soft ELSE 'passed' END AS reason FROM f)"


def checks(t: Tables):
    return t.sql(CHECK_SQL).withColumnRenamed("check_name", "check")


@register("gt9_decision", f"WITH {DECIDED} SELECT * FROM o")
def gt9(t: Tables):
    return gate.decide(checks(t))


@register("gt10_report", f"WITH {DECIDED} SELECT coalesce(string_agg(CASE WHEN outcome = 'include' THEN signal END, ',' ORDER BY signal), '') AS survivors, CAST(count_if(outcome = 'include') AS BIGINT) AS n_survivors, count_if(outcome = 'include') >= 3 AS primary FROM o")
def gt10(t: Tables):
    return gate.report(gate.decide(checks(t)))


IMAGES = "SELECT l_partkey AS image_id, l_quantity AS contrast, l_extendedprice / 1000 AS sharpness, l_tax AS clipped_low, l_discount AS clipped_high, l_discount * 10 AS border, l_tax * 50 AS channel_spread, l_returnflag AS dx FROM lineitem WHERE l_linenumber = 1"
FLAGS = "0.4 * (contrast < 5)::INT + 0.2 * (sharpness < 10)::INT + 0.1 * (contrast < 15)::INT + 0.1 * (border > 0.9)::INT + 0.1 * (clipped_low + clipped_high > 0.2)::INT"


@register("im3_quality_single", f"WITH i AS ({IMAGES}) SELECT image_id, round(contrast, 2) AS contrast, round(greatest(0, 1 - ({FLAGS})) * 0.94 + 0.06 * 0.5 * (tanh(sharpness / 20) + tanh(contrast / 30)), 5) AS composite FROM i")
def im3(t: Tables):
    return signals.quality_single(t.sql(IMAGES), 5, 10, 15, 0.9).select("image_id", F.round("contrast", 2).alias("contrast"), F.round("composite", 5).alias("composite"))


@register("im4_quality_multi", f"WITH i AS ({IMAGES}) SELECT image_id, round(contrast, 2) AS contrast, round(greatest(0, 1 - ({FLAGS} + 0.1 * (channel_spread > 2)::INT)), 5)::DOUBLE AS composite FROM i")
def im4(t: Tables):
    return signals.quality_multi(t.sql(IMAGES), 5, 10, 15, 0.9).select("image_id", F.round("contrast", 2).alias("contrast"), F.round("composite", 5).alias("composite"))


@register("im5_blur_threshold", f"WITH i AS ({IMAGES}), q AS (SELECT quantile_cont(sharpness, 0.05) AS t FROM i) SELECT dx, round(t, 5) AS threshold, count(*) AS n, round(avg(CASE WHEN sharpness < t THEN 1.0 ELSE 0 END), 6) AS rejected FROM i, q GROUP BY dx, t")
def im5(t: Tables):
    return rounded(signals.calibrated_threshold(t.sql(IMAGES), "sharpness", 0.05, False, "dx").withColumn("threshold", F.round("threshold", 5)), "rejected")


@register("im6_border_threshold", f"WITH i AS ({IMAGES}), q AS (SELECT quantile_cont(border, 0.9) AS t FROM i) SELECT dx, round(t, 5) AS threshold, count(*) AS n, round(avg(CASE WHEN border > t THEN 1.0 ELSE 0 END), 6) AS rejected FROM i, q GROUP BY dx, t")
def im6(t: Tables):
    return rounded(signals.calibrated_threshold(t.sql(IMAGES), "border", 0.9, True, "dx").withColumn("threshold", F.round("threshold", 5)), "rejected")


CELLS = "SELECT vec_id AS image_id, label AS dx, CAST(i // 8 AS INT) AS r, CAST(i % 8 AS INT) AS c, CAST(v AS DOUBLE) AS v FROM (SELECT vec_id, label, unnest(embedding) AS v, unnest(generate_series(0, 63)) AS i FROM embeddings)"


def cells(t: Tables):
    return t.embeddings.select(F.col("vec_id").alias("image_id"), F.col("label").alias("dx"), F.posexplode("embedding").alias("i", "v")).select("image_id", "dx", F.floor(F.col("i") / 8).cast("int").alias("r"), (F.col("i") % 8).alias("c"), F.col("v").cast("double").alias("v"))


@register("im8_peripheral_mass", f"WITH x AS ({CELLS}), w AS (SELECT image_id, greatest(v, 0) AS v, greatest(0, least(1, (least((r + 1) / 8, 0.9) - greatest(r / 8, 0.1)) * 8)) * greatest(0, least(1, (least((c + 1) / 8, 0.8) - greatest(c / 8, 0.15)) * 8)) AS w FROM x) SELECT image_id, round(least(1, greatest(0, 1 - sum(v * w) / sum(v))), 6) AS peripheral_mass FROM w GROUP BY image_id")
def im8(t: Tables):
    return rounded(signals.peripheral_mass(cells(t), "image_id", 8, 0.15, 0.1, 0.8, 0.9), "peripheral_mass")


@register("im10_region_overlap", f"WITH x AS ({CELLS}), b AS (SELECT * FROM (VALUES ('left', 0.0, 0.0, 0.5, 1.0), ('top', 0.0, 0.0, 1.0, 0.5)) v(region, x0, y0, x1, y1)), s AS (SELECT image_id, region, sum(CASE WHEN (c + 0.5) / 8 >= x0 AND (c + 0.5) / 8 < x1 AND (r + 0.5) / 8 >= y0 AND (r + 0.5) / 8 < y1 THEN greatest(v, 0) ELSE 0 END) / sum(greatest(v, 0)) AS s FROM x, b GROUP BY 1, 2) SELECT image_id, round(avg(s), 6) AS mean_overlap, round(min(s), 6) AS min_overlap FROM s GROUP BY 1")
def im10(t: Tables):
    regions = t.embeddings.select(F.col("label").alias("dx")).distinct().withColumn("b", F.explode(F.array(*[F.struct(F.lit(n).alias("region"), F.lit(a).alias("x0"), F.lit(0.0).alias("y0"), F.lit(c).alias("x1"), F.lit(d).alias("y1")) for n, a, c, d in (("left", 0.0, 0.5, 1.0), ("top", 0.0, 1.0, 0.5))]))).select("dx", "b.*")
    return rounded(signals.region_overlap(cells(t), regions, "image_id", "dx", 8), "mean_overlap", "min_overlap")


@register("im11_letterbox", "WITH p AS (SELECT p_partkey, p_size * 13 + 5 AS w, p_partkey % 700 + 20 AS h FROM part), f AS (SELECT *, greatest(1, CAST(round_even(w * (512.0::DOUBLE / greatest(w, h)), 0) AS INT)) AS fw, greatest(1, CAST(round_even(h * (512.0::DOUBLE / greatest(w, h)), 0) AS INT)) AS fh FROM p) SELECT p_partkey, fw AS fit_width, fh AS fit_height, CAST((512 - fw) // 2 AS BIGINT) AS \"left\", CAST((512 - fh) // 2 AS BIGINT) AS top, round(((512 - fw) // 2) / 512, 6) AS x0, round(((512 - fh) // 2 + fh) / 512, 6) AS y1 FROM f")
def im11(t: Tables):
    p = t.part.select("p_partkey", (F.col("p_size") * 13 + 5).alias("w"), (F.col("p_partkey") % 700 + 20).alias("h"))
    return rounded(p.withColumns(signals.letterbox(F.col("w"), F.col("h"), 512)).select("p_partkey", "fit_width", "fit_height", "left", "top", "x0", "y1"), "x0", "y1")


@register("im13_typicality", "WITH c AS (SELECT * FROM pool WHERE image_id % 2 = 0), r AS (SELECT dx, score FROM pool WHERE image_id % 2 = 1 AND dx <> '5-LOW'), j AS (SELECT c.image_id, count(r.score) AS n, count_if(r.score < c.score) AS b, count_if(r.score = c.score) AS e FROM c LEFT JOIN r ON c.dx = r.dx GROUP BY 1) SELECT image_id, CASE WHEN n > 0 THEN round(least(1, 2 * least((b + 0.5 * e + 0.5) / (n + 1), 1 - (b + 0.5 * e + 0.5) / (n + 1))), 6) END AS typicality, n > 0 AS calibrated, n AS n_references FROM j")
def im13(t: Tables):
    p = t.pool
    return rounded(signals.typicality(p.where("image_id % 2 = 0"), p.where("image_id % 2 = 1 AND dx <> '5-LOW'"), "dx", "score").select("image_id", "typicality", "calibrated", "n_references"), "typicality")


@register("im15_tie_report", "WITH g AS (SELECT dx, score, count(*) AS c FROM pool GROUP BY 1, 2) SELECT dx, CAST(sum(c) AS BIGINT) AS n, round(count(*) / sum(c), 6) AS unique_fraction, max(c) AS largest_tie, round(sum(CASE WHEN score = 0 THEN c ELSE 0 END) / sum(c), 6) AS zero_share FROM g GROUP BY dx")
def im15(t: Tables):
    return rounded(signals.tie_report(t.pool, "score", ["dx"]), "unique_fraction", "zero_share")


RAWP = "SELECT l_orderkey AS image_id, l_linenumber AS pass, k AS class, CAST((l_partkey * (k + 3) + l_suppkey * k) % 17 + 1 AS DOUBLE) AS w FROM lineitem CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) c"


#: Rows of passes that a task gets.
PASSES = 1 << 18


def passes(t: Tables):
    """Dealt out by image once, over as many tasks as the rows need: what follows is grouped where it lies."""
    raw = t.sql(RAWP).repartition(-(-t.lineitem.count() // PASSES) or 1, "image_id")
    total = F.sum("w").over(Window.partitionBy("image_id", "pass"))
    return raw.select("image_id", "pass", "class", (F.col("w") / total).alias("p"))


@register("im16_uncertainty", f"WITH x AS ({RAWP}), q AS (SELECT *, w / sum(w) OVER (PARTITION BY image_id, pass) AS p FROM x), e AS (SELECT image_id, class, avg(p) AS m, avg(-p * ln(greatest(p, 1e-12))) AS e, stddev_pop(p) AS s, count(*) AS n FROM q GROUP BY 1, 2), a AS (SELECT image_id, sum(-m * ln(greatest(m, 1e-12))) / ln(3) AS h, sum(e) / ln(3) AS x, avg(s) AS ms, max(s) AS xs, max(n) AS n FROM e GROUP BY 1) SELECT image_id, round(h, 6) AS predictive_entropy, round(x, 6) AS expected_entropy, round(greatest(0, h - x), 6) AS mutual_information, round(ms, 6) AS mean_std, round(xs, 6) AS max_std, n AS n_passes, CASE WHEN greatest(0, h - x) <= 0.05 THEN 'low' WHEN greatest(0, h - x) <= 0.1 THEN 'moderate' ELSE 'extreme' END AS band FROM a")
def im16(t: Tables):
    return rounded(signals.uncertainty(passes(t), "image_id", 3, 0.05, 0.1), "predictive_entropy", "expected_entropy", "mutual_information", "mean_std", "max_std")


@register("im17_uncertainty_multi", f"WITH x AS ({RAWP}), q AS (SELECT *, w / sum(w) OVER (PARTITION BY image_id, pass) AS p FROM x), e AS (SELECT image_id, class, greatest(1e-6, least(1 - 1e-6, avg(p))) AS m, stddev_pop(p) AS s FROM q GROUP BY 1, 2), a AS (SELECT image_id, avg(s) AS ms, max(s) AS xs, avg(-(m * ln(m) + (1 - m) * ln(1 - m))) AS h FROM e GROUP BY 1) SELECT image_id, round(ms, 6) AS mean_std, round(xs, 6) AS max_std, round(h, 6) AS entropy, CASE WHEN ms <= 0.05 + 1e-9 THEN 'low' WHEN ms <= 0.151 + 1e-9 THEN 'moderate' ELSE 'extreme' END AS band FROM a")
def im17(t: Tables):
    return rounded(signals.uncertainty_multi(passes(t), "image_id", 0.05, 0.151), "mean_std", "max_std", "entropy")


@register("im18_agreement", f"WITH x AS (SELECT image_id, true_class % 3 AS true_class, p0, p1, p2 FROM ({PROBS})), y AS (SELECT *, CASE true_class WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END AS own, CASE true_class WHEN 0 THEN greatest(p1, p2) WHEN 1 THEN greatest(p0, p2) ELSE greatest(p0, p1) END AS rival FROM x) SELECT image_id, round(own - 0.5 * CASE WHEN rival >= 0.6 THEN rival ELSE 0 END, 6) AS score, round(own - rival, 6) AS margin, rival >= 0.6 AS penalised, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END = true_class AS is_match FROM y")
def im18(t: Tables):
    rows = t.sql(PROBS).withColumns({"true_class": F.col("true_class") % 3, "p": F.array("p0", "p1", "p2")})
    return rounded(signals.agreement(rows, "p", "true_class", 0.6, 0.5).select("image_id", "score", "margin", "penalised", "is_match"), "score", "margin")


@register("im19_agreement_multi", f"WITH x AS (SELECT *, image_id % 2 AS w0, image_id % 3 // 2 AS w1, 0 AS w2 FROM ({PROBS})), y AS (SELECT *, w0 + w1 AS k, (p0 >= 0.6 AND w0 = 0)::INT AS u0, (p1 >= 0.6 AND w1 = 0)::INT AS u1, (p2 >= 0.6)::INT AS u2 FROM x), z AS (SELECT image_id, CASE WHEN k > 0 THEN (w0 * p0 + w1 * p1) / k ELSE 1 - (p0 + p1 + p2) / 3 END AS m, coalesce((u0 * p0 + u1 * p1 + u2 * p2) / nullif(u0 + u1 + u2, 0), 0) AS u, k = 0 AS f FROM y) SELECT image_id, round(m - 0.5 * u, 6) AS score, round(u, 6) AS penalty, f AS is_no_finding FROM z")
def im19(t: Tables):
    rows = t.sql(PROBS).withColumns({"p": F.array("p0", "p1", "p2"), "w": F.array((F.col("image_id") % 2).cast("int"), F.floor(F.col("image_id") % 3 / 2).cast("int"), F.lit(0))})
    return rounded(signals.agreement_multi(rows, "p", "w", 0.6, 0.5).select("image_id", "score", "penalty", "is_no_finding"), "score", "penalty")


@register("ag32_mean_map", f"WITH x AS ({CELLS}), p AS (SELECT image_id, max(v) AS p FROM x GROUP BY 1 HAVING max(v) > 0) SELECT dx, r, c, round(avg(v / p), 5) AS v FROM x JOIN p USING (image_id) GROUP BY 1, 2, 3")
def ag32(t: Tables):
    return signals.mean_map(cells(t), "image_id", "dx").withColumn("v", F.round("v", 5))


@register("im1_image_statistics")
def im1(t: Tables):
    grid = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.transform(F.slice("embedding", r * 8 + 1, F.lit(8)), lambda x: x.cast("double") * 40 + 128))
    return signals.image_statistics(t.embeddings.select("vec_id", grid.alias("pixels")), "pixels", "vec_id")


RUN_UTILITY = "SELECT CASE subset_id % 4 WHEN 0 THEN 'percentile' WHEN 1 THEN 'grid' WHEN 2 THEN 'network' ELSE 'other' END AS policy, seed, y + CASE subset_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1.02 ELSE 9 END AS utility FROM repeats WHERE subset_id % 4 < 3 OR seed < 3"


@register("se21_policy_choice", f"WITH m AS (SELECT policy, avg(utility) AS u, count(DISTINCT seed) AS k FROM ({RUN_UTILITY}) GROUP BY 1) SELECT policy, round(u, 6) AS mean_utility FROM (SELECT policy, u, max(u) OVER () AS best FROM m WHERE k >= 4) WHERE u >= best - 0.5 ORDER BY CASE policy WHEN 'percentile' THEN 1 WHEN 'grid' THEN 2 ELSE 3 END LIMIT 1")
def se21(t: Tables):
    k = F.col("subset_id") % 4
    policy = F.when(k == 0, "percentile").when(k == 1, "grid").when(k == 2, "network").otherwise("other")
    plus = F.when(k == 0, 0).when(k == 1, 1).when(k == 2, 1.02).otherwise(9)
    rows = t.repeats.where((k < 3) | (F.col("seed") < 3)).select(policy.alias("policy"), "seed", (F.col("y") + plus).alias("utility"))
    return rounded(valuation.choose_policy(rows, 4, 0.5), "mean_utility")


@register("se31_threshold_layers", "SELECT dx, CASE dx WHEN '1-URGENT' THEN 0.9 WHEN '2-HIGH' THEN 0.8 ELSE 0.5 END::DOUBLE AS threshold, CASE dx WHEN '1-URGENT' THEN 'network' WHEN '2-HIGH' THEN 'measured' ELSE 'baseline' END AS origin FROM (SELECT DISTINCT dx FROM pool)")
def se31(t: Tables):
    of = lambda rows: t.spark.createDataFrame(rows, "dx string, threshold double")
    base = t.pool.select("dx").distinct().withColumn("threshold", F.lit(0.5))
    return valuation.layered_thresholds(of([("1-URGENT", 0.9)]), of([("1-URGENT", 0.7), ("2-HIGH", 0.8)]), base)


@register("ag21_verified_counts", f"WITH m AS ({MEASURED}) SELECT position, CAST(count_if(context_id % 2 = 0) AS BIGINT) AS train, CAST(count_if(context_id % 2 = 1) AS BIGINT) AS held_out, count_if(context_id % 2 = 0) >= 20 AND count_if(context_id % 2 = 1) >= 20 AS eligible FROM m GROUP BY 1")
def ag21(t: Tables):
    a, b = F.count_if(F.col("context_id") % 2 == 0), F.count_if(F.col("context_id") % 2 == 1)
    return t.sql(MEASURED).groupBy("position").agg(a.alias("train"), b.alias("held_out"), ((a >= 20) & (b >= 20)).alias("eligible"))


@register("ag27_fairness", "SELECT * FROM (VALUES ('seed', 3::BIGINT, false), ('true_class', 5::BIGINT, false), ('fixed', 1::BIGINT, true)) v(\"key\", n_values, uniform)")
def ag27(t: Tables):
    return labels.one_value_per_key(t.predictions.withColumn("fixed", F.lit("same")), ["seed", "true_class", "fixed"])
