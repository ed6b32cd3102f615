"""Comparison of conditions, noise floors and metric choice over the stand-ins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import comparison, inference, metrics, resampling
from tessella.plans.evaluation import PROBS
from tessella.plans.registry import Tables, register
from tessella.plans.selection import rounded

REPLICATES, SEED = 40, 3


def draws_sql(units: str) -> str:
    """The draws of ``inference.draws`` over a table of units, with the unresampled rows as b = 0, as table d."""
    return f"du AS (SELECT unit, row_number() OVER (ORDER BY unit) - 1 AS pos FROM ({units})), dn AS (SELECT count(*) AS n FROM du), dw AS (SELECT b, CAST('0x' || substr(sha256(concat_ws(':', '{SEED}', b, k)), 1, 8) AS BIGINT) % n AS pos, count(*) AS weight FROM dn, (SELECT unnest(generate_series(1, {REPLICATES})) AS b), (SELECT unnest(generate_series(1, (SELECT n FROM dn))) AS k) GROUP BY 1, 2), d AS (SELECT b, unit, weight FROM dw JOIN du ON dw.pos = du.pos UNION ALL SELECT 0, unit, 1 FROM du)"


VALUES = f"{draws_sql('SELECT DISTINCT lesion_id AS unit FROM predictions')}, c AS (SELECT lesion_id AS unit, condition, seed, true_class, predicted, count(*) AS n FROM predictions GROUP BY ALL), cells AS (SELECT b, condition, seed, true_class, predicted, sum(n * weight) AS n FROM c JOIN d USING (unit) GROUP BY ALL), t AS (SELECT b, condition, seed, true_class AS k, sum(n) AS support, sum(CASE WHEN true_class = predicted THEN n ELSE 0 END) AS hits FROM cells GROUP BY ALL), g AS (SELECT b, condition, seed, predicted AS k, sum(n) AS claimed FROM cells GROUP BY ALL), e AS (SELECT t.*, hits / support AS recall, 2 * hits / (support + coalesce(claimed, 0)) AS f1 FROM t LEFT JOIN g USING (b, condition, seed, k)), m AS (SELECT b, condition, seed, 'balanced_accuracy' AS metric, avg(recall) AS value FROM e GROUP BY ALL UNION ALL SELECT b, condition, seed, 'macro_f1', avg(f1) FROM e GROUP BY ALL UNION ALL SELECT b, condition, seed, 'accuracy', sum(hits) / sum(support) FROM e GROUP BY ALL UNION ALL SELECT b, condition, seed, 'recall_' || k, recall FROM e), v AS (SELECT b, condition, metric, avg(value) AS value FROM m GROUP BY ALL)"


@register("st17_condition_estimates", f"WITH {VALUES} SELECT condition, metric, round(max(CASE WHEN b = 0 THEN value END), 6) AS estimate, round(quantile_cont(CASE WHEN b > 0 THEN value END, 0.025), 6) AS low, round(quantile_cont(CASE WHEN b > 0 THEN value END, 0.975), 6) AS high, count(CASE WHEN b > 0 THEN value END) AS n_draws FROM v GROUP BY 1, 2")
def st17_estimates(t: Tables):
    rows = comparison.comparable(t.predictions, comparison.PROTOCOLS["v1"])
    return rounded(comparison.estimates(comparison.resampled(rows, "lesion_id", REPLICATES, SEED)), "estimate", "low", "high")


@register("st17_condition_comparison", f"WITH {VALUES}, pairs AS (SELECT * FROM (VALUES ('C', 'B', true), ('C', 'A', false), ('B', 'A', false)) p(l, r, main)), x AS (SELECT x.b, main, x.metric, l || '_vs_' || r || ':' || x.metric AS name, x.value - y.value AS diff FROM pairs JOIN v x ON x.condition = l JOIN v y ON y.condition = r AND y.b = x.b AND y.metric = x.metric WHERE main OR x.metric NOT LIKE 'recall%'), o AS (SELECT name, main, metric, diff AS difference FROM x WHERE b = 0), p AS (SELECT CASE WHEN main AND metric = 'balanced_accuracy' THEN 'confirmatory' ELSE 'exploratory' END AS family, name, difference, quantile_cont(diff, 0.025) AS low, quantile_cont(diff, 0.975) AS high, least(1.0, 2 * avg(CASE WHEN CASE WHEN difference > 0 THEN diff <= 0 ELSE diff >= 0 END THEN 1.0 ELSE 0 END)) AS p FROM (SELECT o.*, x.diff FROM o JOIN x ON o.name = x.name AND x.b > 0) GROUP BY ALL), h AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, name) AS k, count(*) OVER (PARTITION BY family) AS n FROM p), a AS (SELECT *, CASE WHEN family = 'confirmatory' THEN max(least(1.0, p * (n - k + 1))) OVER (PARTITION BY family ORDER BY k) ELSE min(least(1.0, p * n / k)) OVER (PARTITION BY family ORDER BY k DESC) END AS adj FROM h) SELECT family, name, round(difference, 6) AS difference, round(low, 6) AS low, round(high, 6) AS high, round(p, 6) AS p, round(adj, 6) AS adjusted, adj <= 0.05 AS rejected FROM a")
def st17_comparison(t: Tables):
    rows = comparison.compare(t.predictions, comparison.PROTOCOLS["v1"], "lesion_id", REPLICATES, SEED)
    return rounded(rows.drop("note"), "difference", "low", "high", "p", "adjusted")


KINDS = range(5)
CHANCES = ", ".join(f"round((CAST((image_id * {31 + 2 * k} + seed * 7) % 101 AS DOUBLE) / 101 + CASE WHEN predicted = {k} THEN 0.5 ELSE 0 END) / 2, 6) AS p{k}" for k in KINDS)
AUROC = "x AS (SELECT *, " + CHANCES + " FROM predictions), y AS (" + " UNION ALL ".join(f"SELECT lesion_id AS unit, condition, seed, {k} AS k, p{k} AS s, CASE WHEN true_class = {k} THEN 1 ELSE 0 END AS y FROM x" for k in KINDS) + f"), {draws_sql('SELECT DISTINCT lesion_id AS unit FROM predictions')}, c AS (SELECT b, condition, seed, k, s, sum(y * weight) AS p, sum((1 - y) * weight) AS n FROM y JOIN d USING (unit) GROUP BY ALL), a AS (SELECT *, sum(n) OVER (PARTITION BY b, condition, seed, k ORDER BY s) - n AS below FROM c), e AS (SELECT b, condition, seed, k, sum(p * (below + n / 2)) / nullif(sum(p) * sum(n), 0) AS auroc FROM a GROUP BY ALL), m AS (SELECT b, condition, seed, avg(auroc) AS value FROM e GROUP BY ALL), v AS (SELECT b, condition, avg(value) AS value FROM m GROUP BY ALL)"


@register("st17_auroc_estimates", f"WITH {AUROC} SELECT condition, 'macro_auroc' AS metric, round(max(CASE WHEN b = 0 THEN value END), 6) AS estimate, round(quantile_cont(CASE WHEN b > 0 THEN value END, 0.025), 6) AS low, round(quantile_cont(CASE WHEN b > 0 THEN value END, 0.975), 6) AS high, count(CASE WHEN b > 0 THEN value END) AS n_draws FROM v GROUP BY 1")
def st17_auroc(t: Tables):
    chance = lambda k: F.round(((F.col("image_id") * (31 + 2 * k) + F.col("seed") * 7) % 101 / F.lit(101.0) + F.when(F.col("predicted") == k, 0.5).otherwise(0)) / 2, 6)
    rows = t.predictions.withColumns({f"p{k}": chance(k) for k in KINDS})
    return rounded(comparison.estimates(comparison.resampled_auroc(rows, "lesion_id", [f"p{k}" for k in KINDS], REPLICATES, SEED)), "estimate", "low", "high")


RUNS = f"SELECT image_id, true_class, run, CAST(k AS INT) AS label, CASE k WHEN 0 THEN (p0 + run / 10.0) / 2 WHEN 1 THEN (p1 + run / 20.0) / 2 ELSE (p2 + run / 40.0) / 2 END AS p FROM ({PROBS}) CROSS JOIN (SELECT 1 AS run UNION ALL SELECT 2 UNION ALL SELECT 3) r CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) l"


@register("st18_ensemble_labels", f"WITH x AS ({RUNS}), e AS (SELECT image_id, true_class, label, avg(p) AS p, stddev_samp(p) AS s FROM x GROUP BY ALL), r AS (SELECT *, rank() OVER (PARTITION BY label ORDER BY round(p, 9)) + (count(*) OVER (PARTITION BY label, round(p, 9)) - 1) / 2.0 AS r FROM e), a AS (SELECT label, (sum(CASE WHEN true_class = label THEN r END) - count_if(true_class = label) * (count_if(true_class = label) + 1) / 2.0) / nullif(count_if(true_class = label) * count_if(true_class <> label), 0) AS auroc, avg(s) AS spread FROM r GROUP BY label) SELECT label, round(auroc, 6) AS auroc, round(spread, 6) AS spread FROM a")
def st18(t: Tables):
    e = comparison.ensembles(t.sql(RUNS), ["image_id", "true_class", "label"])
    e = e.withColumns({"score": F.round("p", 9), "target": (F.col("true_class") == F.col("label")).cast("int")})
    return rounded(metrics.auroc(e, ["label"]).select("label", "auroc").join(e.groupBy("label").agg(F.avg("spread").alias("spread")), "label"), "auroc", "spread")


@register("st19_count_faults", "WITH n AS (SELECT CASE condition WHEN 'A' THEN 'B' WHEN 'B' THEN 'C2' ELSE 'D2' END AS condition, count(*) - CASE WHEN condition = 'C' THEN 1 ELSE 0 END AS n FROM predictions GROUP BY condition), r AS (SELECT * FROM (VALUES ('B', 'C2', true), ('B', 'D2', true), ('C2', 'D2', false)) v(l, r, suspect)) SELECT l AS \"left\", r AS \"right\", CASE WHEN suspect THEN 'equal_counts' ELSE 'unequal_counts' END AS fault FROM r JOIN n x ON x.condition = l JOIN n y ON y.condition = r WHERE (x.n = y.n) = suspect")
def st19(t: Tables):
    name = F.element_at(F.create_map(*[F.lit(x) for x in ("A", "B", "B", "C2", "C", "D2")]), F.col("condition"))
    n = t.predictions.groupBy("condition").agg(F.count(F.lit(1)).alias("n")).select(name.alias("condition"), (F.col("n") - (F.col("condition") == "C").cast("int")).alias("n"))
    return comparison.count_faults(n, comparison.PROTOCOLS["v2"])


@register("st22_subset_bootstrap", f"WITH c AS (SELECT subset_id AS unit, count(y) AS n, avg(y) AS m, var_pop(y) AS v FROM repeats GROUP BY 1), {draws_sql('SELECT unit FROM c')}, s AS (SELECT b, sum(weight) AS k, sum(weight * n) AS total, sum(weight * n * v) AS ssw, sum(weight * n * m * m) AS sq, sum(weight * n * m) AS s FROM c JOIN d USING (unit) WHERE b > 0 GROUP BY b), w AS (SELECT ssw / nullif(total - k, 0) AS within_, ((sq - s * s / total) / nullif(k - 1, 0) - ssw / nullif(total - k, 0)) * k / total AS between_ FROM s), i AS (SELECT greatest(between_, 0.0) / nullif(greatest(between_, 0.0) + within_, 0) AS icc FROM w), r AS (SELECT icc, coalesce(least(ceil(0.8 * (1 - icc) / nullif(icc * (1 - 0.8::DOUBLE), 0) - 1e-9), 11), 11) AS needed FROM i) SELECT round(quantile_cont(icc, 0.025), 4) AS low, round(quantile_cont(icc, 0.975), 4) AS high, round(quantile_cont(needed, 0.5), 4) AS needed_median, round(quantile_cont(needed, 0.9), 4) AS needed_p90, round(avg(CASE WHEN needed <= 4 THEN 1.0 ELSE 0 END), 4) AS affordable_share FROM r")
def st22(t: Tables):
    return rounded(comparison.subset_bootstrap(t.repeats, REPLICATES, SEED), "low", "high", "needed_median", "needed_p90", "affordable_share", places=4)


MEASURES = {"quantity": "l_quantity", "share": "l_suppkey % 100 + l_quantity / 100", "order": "l_suppkey % 100 + l_quantity / 10"}


def measure_sql(name: str) -> str:
    return f"SELECT '{name}' AS metric, l_suppkey AS subset_id, l_linenumber AS seed, avg({MEASURES[name]}) AS y FROM lineitem GROUP BY 2, 3"


@register("st23_metric_choice", "WITH c AS (SELECT metric, subset_id, count(*) AS n, avg(y) AS m, var_pop(y) AS v FROM (" + " UNION ALL ".join(measure_sql(m) for m in MEASURES) + ") GROUP BY 1, 2), a AS (SELECT metric, count(*) AS k, sum(n) AS total, sum(n * v) AS ssw, sum(n * m * m) - pow(sum(n * m), 2) / sum(n) AS ssb FROM c GROUP BY 1), z AS (SELECT metric, ssw / (total - k) AS w, greatest((ssb / (k - 1) - ssw / (total - k)) / (total / k), 0.0) AS b FROM a), i AS (SELECT metric, b / (b + w) AS icc FROM z), q AS (SELECT metric, icc, ceil(0.8 * (1 - icc) / nullif(icc * (1 - 0.8::DOUBLE), 0) - 1e-9) AS needed FROM i), s AS (SELECT arg_max(metric, icc) AS metric, CAST(arg_max(needed, icc) AS BIGINT) AS repeats FROM q WHERE needed <= 4) SELECT coalesce(metric, 'quantity') AS metric, repeats FROM s")
def st23(t: Tables):
    rows = t.sql(measure_sql("quantity")).unionByName(t.sql(measure_sql("share"))).unionByName(t.sql(measure_sql("order")))
    return comparison.metric_choice(inference.variance_components(rows, ["metric"]).select("metric", "icc"), "quantity")


@register("st31_recall_table", "WITH r AS (SELECT condition, true_class AS k, round(avg(CASE WHEN true_class = predicted THEN 1.0 ELSE 0 END), 6) AS recall FROM predictions GROUP BY 1, 2) SELECT condition, max(CASE WHEN k = 0 THEN recall END) AS recall_0, max(CASE WHEN k = 3 THEN recall END) AS recall_3, max(CASE WHEN k = 9 THEN recall END) AS recall_9 FROM r GROUP BY 1")
def st31(t: Tables):
    hit = F.avg((F.col("true_class") == F.col("predicted")).cast("double"))
    each = t.predictions.groupBy("condition", F.col("true_class").cast("string").alias("k")).agg(F.round(hit, 6).alias("r"))
    stored = each.groupBy("condition").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("k", "r"))).alias("per_class_recall"))).alias("report"))
    return comparison.recall_table(stored, ["0", "3", "9"])


def hits_of(t: Tables) -> DataFrame:
    return t.predictions.select("lesion_id", "condition", "true_class", "predicted")


@register("st13_metric_bootstrap")
def st13_metric(t: Tables):
    """Macro F1, which isn't a mean of rows, with intervals by draws that are split, not listed."""
    sums, metric = resampling.f1_macro([0, 1, 2, 3, 4])
    return rounded(resampling.bootstrap(hits_of(t), "lesion_id", ["condition"], sums("true_class", "predicted"), metric, 100, SEED), "estimate", "low", "high")


@register("st14_metric_difference")
def st14_metric(t: Tables):
    sums, metric = resampling.f1_macro([0, 1, 2, 3, 4])
    return rounded(resampling.bootstrap_difference(hits_of(t), "lesion_id", "condition", "A", "B", sums("true_class", "predicted"), metric, 100, SEED), "estimate", "low", "high")


@register("st13_resample_totals", "SELECT b, (SELECT count(DISTINCT lesion_id) FROM predictions)::DOUBLE AS n FROM (SELECT unnest(generate_series(0, 100))::INT AS b)")
def st13_totals(t: Tables):
    """Weights of each replicate add up to the number of units."""
    units = hits_of(t).select("lesion_id").distinct()
    return resampling.resampled(units, "lesion_id", [], {"n": F.lit(1)}, 100, SEED)


@register("st17_split_comparison")
def st17_split(t: Tables):
    """The comparison with draws that are split, not listed."""
    rows = comparison.compare(t.predictions, comparison.PROTOCOLS["v1"], "lesion_id", 200, SEED, split=True)
    return rounded(rows.drop("note"), "difference", "low", "high", "p", "adjusted")


@register("st22_split_bootstrap")
def st22_split(t: Tables):
    return rounded(comparison.subset_bootstrap(t.repeats, 200, SEED, split=True), "low", "high", "needed_median", "needed_p90", "affordable_share", places=4)
