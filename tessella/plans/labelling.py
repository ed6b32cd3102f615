"""Labels, joins, set operations, text and contracts over the stand-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import hashing, text
from tessella.operators import labels, sampling, vectors
from tessella.plans.registry import Tables, register
from tessella.plans.selection import rounded
from tessella.streaming.incremental import pending


@register("pf1_ternary", "SELECT row_id, CAST(raw AS INT) AS raw FROM ternary")
def pf1(t: Tables):
    return t.ternary.select("row_id", labels.normalize_ternary(F.concat(F.lit(" "), F.col("raw").cast("string"), F.lit(".0"))).cast("int").alias("raw"))


@register("pf2_invalid_rows", "SELECT event_id FROM events WHERE event_type NOT IN ('click', 'view')")
def pf2(t: Tables):
    return labels.invalid_rows(t.events, "event_type", ["click", "view"]).select("event_id")


@register("pf3_class_index", "SELECT o_orderkey, CAST(substr(o_orderpriority, 1, 1) AS INT) - 1 AS class FROM orders")
def pf3(t: Tables):
    return t.orders.select("o_orderkey", labels.class_index(F.concat(F.lit("  "), F.lower("o_orderpriority"))).alias("class"))


@register("pf6_extract_id", "SELECT c_custkey, CAST(regexp_extract(c_name, '#0*([0-9]+)$', 1) AS BIGINT) AS id FROM customer")
def pf6(t: Tables):
    return t.customer.select("c_custkey", F.regexp_extract("c_name", r"#0*([0-9]+)$", 1).cast("bigint").alias("id"))


@register("pf7_sanitize_id", "SELECT page_id, replace(regexp_replace(regexp_replace(url, '^https?://', ''), '\\.(jpg|jpeg|png)$', '', 'i'), '/', '__') AS id FROM pages")
def pf7(t: Tables):
    return t.pages.select("page_id", text.sanitize_id(F.col("url"), "https?://").alias("id"))


@register("pf8_label_arrays", "SELECT row_id, CAST(coalesce(raw, -2) AS INT) AS raw, CASE WHEN raw = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS target, coalesce(raw IN (0, 1), false) AS mask FROM ternary")
def pf8(t: Tables):
    return labels.ternary_arrays(t.ternary).select("row_id", F.col("raw").cast("int").alias("raw"), F.col("target").cast("double").alias("target"), "mask")


@register("pf9_one_hot", "SELECT o_orderkey, k AS class, CASE WHEN CAST(substr(o_orderpriority, 1, 1) AS INT) - 1 = k THEN 1 ELSE 0 END AS hot FROM orders, (SELECT CAST(unnest(generate_series(0, 4)) AS INT) AS k)")
def pf9(t: Tables):
    rows = t.orders.select("o_orderkey", F.posexplode(labels.one_hot(labels.class_index(F.col("o_orderpriority")), 5)).alias("class", "hot"))
    return rows


@register("pf10_intended_positives", "SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 2 = 0 THEN 'b' END, CASE WHEN o_orderkey % 3 = 0 THEN 'a' END) AS names FROM orders")
def pf10(t: Tables):
    v = F.create_map(F.lit("a"), (F.col("o_orderkey") % 3 == 0).cast("int"), F.lit("b"), (F.col("o_orderkey") % 2 == 0).cast("int"))
    return t.orders.select("o_orderkey", F.array_join(labels.positives(v, ["b", "a"]), ",").alias("names"))


@register("pf19_row_count_check", "SELECT count(*) AS n, abs(count(*) - 15500) / 15500 <= 0.05 AS within FROM orders")
def pf19(t: Tables):
    return t.orders.agg(F.count(F.lit(1)).alias("n"), (F.abs(F.count(F.lit(1)) - 15500) / 15500 <= 0.05).alias("within"))


@register("pf20_spot_check", "SELECT image_id FROM pool ORDER BY sha256(concat_ws(':', 'spot', image_id)), image_id LIMIT 20")
def pf20(t: Tables):
    return t.pool.orderBy(hashing.seeded("spot", "image_id"), "image_id").limit(20).select("image_id")


@register("pf22_json_path", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.none') AS none FROM events")
def pf22(t: Tables):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.get_json_object("props", "$.none").alias("none"))


@register("pf24_allow_list", "SELECT image_id, image_id % 7 = 0 AS listed FROM pool")
def pf24(t: Tables):
    p = t.pool
    allowed = p.where("image_id % 7 = 0").select("image_id")
    return p.join(allowed, "image_id", "left_semi").select("image_id", F.lit(True).alias("listed")).unionByName(p.join(allowed, "image_id", "left_anti").select("image_id", F.lit(False).alias("listed")))


@register("pf26_row_status", "SELECT CASE WHEN raw IS NULL THEN 'blank' WHEN raw = -1 THEN 'uncertain' ELSE 'keep' END AS status, count(*) AS n FROM ternary GROUP BY 1")
def pf26(t: Tables):
    status = F.when(F.col("raw").isNull(), "blank").when(F.col("raw") == -1, "uncertain").otherwise("keep")
    return t.ternary.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@register("pf27_stratum", "WITH s AS (SELECT user_id, string_agg(DISTINCT event_type, '|' ORDER BY event_type) FILTER (WHERE value > 25) AS s FROM events GROUP BY 1) SELECT user_id, coalesce(nullif(s, ''), '__no_finding__') AS stratum FROM s")
def pf27(t: Tables):
    sets = t.events.groupBy("user_id").agg(F.collect_set(F.when(F.col("value") > 25, F.col("event_type"))).alias("s"))
    return sets.select("user_id", labels.stratum(F.col("s")).alias("stratum"))


@register("jn1_inner_merge", "SELECT s.s_suppkey, round(s_acctbal, 2) AS s_acctbal, n, q FROM supplier s JOIN (SELECT l_suppkey AS s_suppkey, count(*) AS n FROM lineitem GROUP BY 1) a USING (s_suppkey) JOIN (SELECT l_suppkey AS s_suppkey, max(l_quantity) AS q FROM lineitem GROUP BY 1) b USING (s_suppkey)")
def jn1(t: Tables):
    li = t.lineitem.withColumnRenamed("l_suppkey", "s_suppkey")
    a, b = li.groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("n")), li.groupBy("s_suppkey").agg(F.max("l_quantity").alias("q"))
    return labels.merge_all([t.supplier.select("s_suppkey", F.round("s_acctbal", 2).alias("s_acctbal")), a, b], "s_suppkey")


@register("jn2_outer_merge", "SELECT image_id, p.score AS a, f.duplicate AS b FROM pool p FULL JOIN flags f USING (image_id)")
def jn2(t: Tables):
    return labels.merge_all([t.pool.select("image_id", F.col("score").alias("a")), t.flags.select("image_id", F.col("duplicate").alias("b"))], "image_id", "full")


@register("jn4_attach_scores", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def jn4(t: Tables):
    c = t.customer.select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    return labels.attach(c, t.nation, "n_nationkey", ["n_name"]).select("c_custkey", "n_name")


@register("jn6_dimension_lookup", "SELECT s_suppkey, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def jn6(t: Tables):
    places = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))  # 5 regions, fixed
    return t.supplier.join(places, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "r_name")


@register("jn7_anti_check", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def jn7(t: Tables):
    return t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@register("jn8_split_overlap", "SELECT a.event_type AS split_a, b.event_type AS split_b, count(DISTINCT a.user_id) AS shared FROM events a JOIN (SELECT DISTINCT user_id, event_type FROM events) b ON a.user_id = b.user_id AND a.event_type < b.event_type GROUP BY 1, 2")
def jn8(t: Tables):
    return sampling.overlaps(t.events, "user_id", "event_type")


SETS = "s AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS v FROM events WHERE value > 40 GROUP BY 1)"


@register("jn10_set_similarity", f"WITH {SETS}, k AS (SELECT v, count(*) AS n FROM s GROUP BY 1) SELECT array_to_string(a.v, '|') AS a, array_to_string(b.v, '|') AS b, b.n AS n, round(len(list_intersect(a.v, b.v)) / len(list_distinct(list_concat(a.v, b.v))), 6) AS jaccard FROM k a, k b WHERE len(list_intersect(a.v, b.v)) * 2 >= len(list_distinct(list_concat(a.v, b.v)))")
def jn10(t: Tables):
    sets = t.events.where("value > 40").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("v"))
    return rounded(vectors.set_similarity(sets, "v", 0.5), "jaccard")


@register("jn13_paired_units", "SELECT image_id, max(CASE WHEN condition = 'A' THEN predicted END) AS a, max(CASE WHEN condition = 'B' THEN predicted END) AS b FROM predictions GROUP BY 1")
def jn13(t: Tables):
    return t.predictions.groupBy("image_id").agg(F.max(F.when(F.col("condition") == "A", F.col("predicted"))).alias("a"), F.max(F.when(F.col("condition") == "B", F.col("predicted"))).alias("b"))


@register("jn14_id_coverage", "SELECT CAST(count_if(l.k IS NULL) AS BIGINT) AS missing, CAST(count_if(o.k IS NULL) AS BIGINT) AS extra, CAST(count_if(l.k IS NOT NULL AND o.k IS NOT NULL) AS BIGINT) AS matched, CAST(count_if(l.n > 1 OR o.n > 1) AS BIGINT) AS doubled FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) o FULL JOIN (SELECT l_suppkey * 10 AS k, count(*) AS n FROM lineitem GROUP BY 1) l ON o.k = l.k")
def jn14(t: Tables):
    return labels.coverage(t.orders.select(F.col("o_custkey").alias("k")), t.lineitem.select((F.col("l_suppkey") * 10).alias("k")), "k")


@register("jn15_leakage_semi", "SELECT DISTINCT o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def jn15(t: Tables):
    protected = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.select("o_custkey").distinct().join(protected, "o_custkey", "left_semi")


@register("jn16_one_manifest", "SELECT condition, count(DISTINCT lesion_id) AS n_values, count(DISTINCT lesion_id) <= 1 AS consistent FROM predictions GROUP BY 1")
def jn16(t: Tables):
    n = F.count_distinct("lesion_id")
    return t.predictions.groupBy("condition").agg(n.alias("n_values"), (n <= 1).alias("consistent"))


@register("jn17_pending", "SELECT subset_id FROM subsets WHERE subset_id % 3 <> 0")
def jn17(t: Tables):
    return pending(t.subsets.select("subset_id"), t.subsets.where("subset_id % 3 = 0"), "subset_id")


@register("jn20_reconciliation", "SELECT image_id, p.image_id IS NULL AS orphan, f.image_id IS NULL AS missing FROM (SELECT image_id FROM pool WHERE image_id % 4 <> 0) p FULL JOIN (SELECT image_id FROM flags) f USING (image_id) WHERE p.image_id IS NULL OR f.image_id IS NULL")
def jn20(t: Tables):
    a = t.pool.where("image_id % 4 <> 0").select("image_id", F.lit(True).alias("a"))
    b = t.flags.select("image_id", F.lit(True).alias("b"))
    return a.join(b, "image_id", "full").where("a is null or b is null").select("image_id", F.col("a").isNull().alias("orphan"), F.col("b").isNull().alias("missing"))


PATIENT = "p AS (SELECT label, patient_id, max(CASE WHEN raw = 1 THEN 1 ELSE 0 END) AS p, max(CASE WHEN raw = 0 THEN 1 ELSE 0 END) AS q, count_if(raw = 1) AS rp, count_if(raw = 0) AS rq FROM ternary GROUP BY 1, 2)"


@register("ag1_patient_support", f"WITH {PATIENT} SELECT label, CAST(count_if(p = 1) AS BIGINT) AS positive_patients, CAST(count_if(p = 0 AND q = 1) AS BIGINT) AS negative_patients, CAST(count_if(p = 0 AND q = 0) AS BIGINT) AS masked_patients, CAST(sum(rp) AS BIGINT) AS positive_rows, CAST(sum(rq) AS BIGINT) AS negative_rows FROM p GROUP BY 1")
def ag1(t: Tables):
    return labels.patient_support(t.ternary)


@register("ag2_group_support", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS positive_groups, (SELECT count(DISTINCT o_custkey) FROM orders) - count(DISTINCT o_custkey) AS negative_groups, count(*) AS n_rows FROM orders GROUP BY 1")
def ag2(t: Tables):
    return labels.group_support(t.orders, "o_custkey", "o_orderpriority")


@register("ag3_support_rule", f"WITH {PATIENT}, s AS (SELECT label, count_if(p = 1) AS a, count_if(p = 0 AND q = 1) AS b FROM p GROUP BY 1) SELECT label, a >= 140 AND b >= 5 AS passed, concat_ws(',', CASE WHEN a < 140 THEN 'positives' END, CASE WHEN b < 5 THEN 'negatives' END) AS failures FROM s")
def ag3(t: Tables):
    return labels.support_failures(labels.patient_support(t.ternary), 140, 5).select("label", "passed", "failures")


@register("ag4_split_support", "WITH x AS (SELECT *, CASE WHEN patient_id % 3 = 0 THEN 'a' ELSE 'b' END AS split FROM ternary), p AS (SELECT split, label, patient_id, max(CASE WHEN raw = 1 THEN 1 ELSE 0 END) AS p FROM x GROUP BY 1, 2, 3) SELECT split || '/' || label AS cell, CAST(sum(p) AS BIGINT) AS positive_patients FROM p GROUP BY 1")
def ag4(t: Tables):
    split = F.when(F.col("patient_id") % 3 == 0, "a").otherwise("b")
    rows = t.ternary.withColumn("cell", F.concat(split, F.lit("/"), F.col("label")))
    return labels.patient_support(rows, label="cell").select("cell", "positive_patients")


@register("ag5_patient_vectors", f"WITH {PATIENT} SELECT patient_id, label, p AS positive, CASE WHEN p = 0 THEN q ELSE 0 END AS negative FROM p")
def ag5(t: Tables):
    p, q = F.max(F.coalesce((F.col("raw") == 1).cast("int"), F.lit(0))), F.max(F.coalesce((F.col("raw") == 0).cast("int"), F.lit(0)))
    return t.ternary.groupBy("patient_id", "label").agg(p.alias("positive"), F.when(p == 0, q).otherwise(0).alias("negative"))


@register("ag6_counts_with_zeros", "SELECT n_name, count(s_suppkey) AS n, round(count(s_suppkey) / (SELECT count(*) FROM supplier), 6) AS share FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def ag6(t: Tables):
    s = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return rounded(labels.counts_over(s, t.nation, "n_name"), "share")


@register("ag7_prevalence_deviation", "WITH f AS (SELECT label, avg(CASE WHEN raw = 1 THEN 1.0 ELSE 0 END) AS f FROM ternary GROUP BY 1), s AS (SELECT label, avg(CASE WHEN raw = 1 THEN 1.0 ELSE 0 END) AS s FROM ternary WHERE patient_id % 5 = 0 GROUP BY 1) SELECT f.label, round(f, 6) AS full_rate, round(s, 6) AS subset_rate, round(abs(f - s), 6) AS deviation, abs(f - s) <= 0.01 AS within_tolerance FROM f LEFT JOIN s USING (label)")
def ag7(t: Tables):
    return rounded(labels.prevalence_deviation(t.ternary.where("patient_id % 5 = 0"), t.ternary, 0.01), "full_rate", "subset_rate", "deviation")


@register("ag8_conflicting_groups", "SELECT o_custkey, count(DISTINCT o_orderpriority) AS n_classes FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) > 1")
def ag8(t: Tables):
    return labels.conflicting_groups(t.orders, "o_custkey", "o_orderpriority")


@register("ag13_cooccurrence", "WITH s AS (SELECT user_id, string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS labels FROM events WHERE value > 40 GROUP BY 1) SELECT labels, count(DISTINCT user_id) AS support FROM s GROUP BY 1 HAVING count(DISTINCT user_id) >= 3")
def ag13(t: Tables):
    return labels.cooccurrence(labels.label_sets(t.events.where("value > 40"), "user_id", "event_type"), "user_id", 3)


@register("ag14_class_mix", "WITH s AS (SELECT user_id, count(DISTINCT CASE WHEN value > 40 THEN event_type END) AS k FROM events GROUP BY 1) SELECT count(*) AS total, CAST(count_if(k = 0) AS BIGINT) AS \"none\", CAST(count_if(k = 1) AS BIGINT) AS single, CAST(count_if(k > 1) AS BIGINT) AS multi, round(avg(CASE WHEN k > 1 THEN 1.0 ELSE 0 END), 6) AS multi_share FROM s")
def ag14(t: Tables):
    e = t.events.withColumn("label", F.when(F.col("value") > 40, F.col("event_type")))
    return rounded(labels.class_mix(labels.label_sets(e, "user_id", "label")), "multi_share")


@register("ag17_agreement_with_subtotal", "SELECT seed, coalesce(CAST(true_class AS VARCHAR), 'ALL') AS class, count(*) AS n, CAST(count_if(true_class = predicted) AS BIGINT) AS hits FROM predictions GROUP BY GROUPING SETS ((seed, true_class), (seed))")
def ag17(t: Tables):
    each = t.predictions.groupBy("seed", F.col("true_class").cast("string").alias("class")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("true_class") == F.col("predicted")).alias("hits"))
    return each.unionByName(each.groupBy("seed").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).withColumn("class", F.lit("ALL")))


@register("ag18_confusion_by_snapshot", "SELECT condition, true_class, predicted, count(*) AS n FROM predictions GROUP BY 1, 2, 3")
def ag18(t: Tables):
    return t.predictions.groupBy("condition", "true_class", "predicted").agg(F.count(F.lit(1)).alias("n"))


@register("so1_union", "SELECT s_suppkey AS k, 's' AS origin FROM supplier UNION ALL SELECT p_partkey, 'p' FROM part")
def so1(t: Tables):
    return t.supplier.select(F.col("s_suppkey").alias("k"), F.lit("s").alias("origin")).unionByName(t.part.select(F.col("p_partkey").alias("k"), F.lit("p").alias("origin")))


@register("so2_keep_first", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def so2(t: Tables):
    return t.events.groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@register("so3_exact_cover", "SELECT 'missing' AS side, s_suppkey AS k FROM supplier WHERE s_suppkey % 9 = 0 UNION ALL SELECT 'extra', -1")
def so3(t: Tables):
    universe = t.supplier.select(F.col("s_suppkey").alias("k"))
    parts = universe.where("k % 9 <> 0").unionByName(t.spark.createDataFrame([(-1,)], "k long"))
    return universe.exceptAll(parts).select(F.lit("missing").alias("side"), "k").unionByName(parts.exceptAll(universe).select(F.lit("extra").alias("side"), "k"))


@register("so4_intersection", "SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 5000")
def so4(t: Tables):
    return t.orders.select("o_custkey").intersect(t.customer.where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey")))


@register("so5_selection_jaccard", "WITH a AS (SELECT image_id FROM pool WHERE score > 0.5), b AS (SELECT image_id FROM pool WHERE image_id % 2 = 0) SELECT round(coalesce(CAST(count_if(a.image_id IS NOT NULL AND b.image_id IS NOT NULL) AS DOUBLE) / nullif(count(*), 0), 1.0), 6) AS jaccard FROM a FULL JOIN b ON a.image_id = b.image_id")
def so5(t: Tables):
    return rounded(vectors.selection_jaccard(t.pool.where("score > 0.5"), t.pool.where("image_id % 2 = 0"), "image_id"), "jaccard")


@register("so6_blocked_sets", f"WITH {SETS} SELECT user_id, array_to_string(v, '|') AS labels FROM s WHERE list_has_all(v, ['click', 'view'])")
def so6(t: Tables):
    s = t.events.where("value > 40").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("v"))
    return s.where(F.size(F.array_except(F.array(F.lit("click"), F.lit("view")), "v")) == 0).select("user_id", F.array_join("v", "|").alias("labels"))


@register("so7_subset_distinctness", "SELECT l_orderkey AS subset_id, count(*) AS declared, count(DISTINCT l_partkey) AS n_distinct, count(*) = count(DISTINCT l_partkey) AS ok FROM lineitem GROUP BY 1")
def so7(t: Tables):
    s = t.lineitem.groupBy(F.col("l_orderkey").alias("subset_id")).agg(F.collect_list("l_partkey").alias("ids"))
    n, d = F.size("ids").cast("bigint"), F.size(F.array_distinct("ids")).cast("bigint")
    return s.select("subset_id", n.alias("declared"), d.alias("n_distinct"), (n == d).alias("ok"))


@register("fn1_age_bucket", "SELECT c_custkey, CASE WHEN c_custkey % 97 = 0 THEN 'adult' ELSE CAST(c_custkey % 97 // 10 * 10 AS VARCHAR) || '-' || CAST(c_custkey % 97 // 10 * 10 + 9 AS VARCHAR) || '-year-old' END AS bucket FROM customer UNION ALL SELECT -1, 'adult'")
def fn1(t: Tables):
    bad = t.spark.createDataFrame([(-1, "unknown")], "c_custkey long, age string")
    return t.customer.select("c_custkey", (F.col("c_custkey") % 97).cast("string").alias("age")).unionByName(bad).select("c_custkey", text.age_bucket(F.col("age")).alias("bucket"))


@register("fn3_natural_list", f"WITH {SETS} SELECT user_id, CASE len(v) WHEN 0 THEN '' WHEN 1 THEN v[1] WHEN 2 THEN v[1] || ' and ' || v[2] ELSE array_to_string(v[1:len(v) - 1], ', ') || ', and ' || v[len(v)] END AS sentence FROM s")
def fn3(t: Tables):
    s = t.events.where("value > 40").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("v"))
    return s.select("user_id", text.natural_list(F.col("v")).alias("sentence"))


@register("fn6_article", "SELECT n_nationkey, CASE WHEN regexp_matches(lower(n_name), '^[aeiou]') THEN 'an' ELSE 'a' END AS article FROM nation UNION ALL SELECT * FROM (VALUES (108, 'an'), (111, 'an'), (110, 'a'), (180, 'an')) v")
def fn6(t: Tables):
    ages = t.spark.createDataFrame([(108, "8-year-old"), (111, "11-year-old"), (110, "10-year-old"), (180, "80-89-year-old")], "n_nationkey int, n_name string")
    return t.nation.select("n_nationkey", "n_name").unionByName(ages).select("n_nationkey", text.indefinite_article(F.col("n_name")).alias("article"))


@register("fn7_site_clause", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE ' on the ' || lower(c_mktsegment) END AS clause FROM customer")
def fn7(t: Tables):
    site = F.when(F.col("c_custkey") % 3 == 0, F.lit(" Unknown ")).otherwise(F.concat(F.col("c_mktsegment"), F.lit(" ")))
    return t.customer.select("c_custkey", text.site_clause(site).alias("clause"))


@register("fn8_variant_index", "SELECT o_orderkey, CAST('0x' || substr(sha256(concat_ws(':', o_orderkey, 3)), 58, 7) AS BIGINT) % 4 AS variant FROM orders")
def fn8(t: Tables):
    return t.orders.select("o_orderkey", hashing.variant_index(F.col("o_orderkey"), F.lit(3)).alias("variant"))


@register("fn9_image_seed", "SELECT o_orderkey, CAST('0x' || substr(sha256(concat_ws(':', 42, o_orderkey)), 1, 8) AS BIGINT) AS image_seed FROM orders")
def fn9(t: Tables):
    return t.orders.select("o_orderkey", hashing.seeded_int(42, "o_orderkey").alias("image_seed"))


@register("fn11_set_hash", "SELECT dx, sha256(string_agg(CAST(image_id AS VARCHAR), chr(10) ORDER BY CAST(image_id AS VARCHAR))) AS digest FROM pool GROUP BY 1")
def fn11(t: Tables):
    return t.pool.groupBy("dx").agg(hashing.set_hash(F.col("image_id")).alias("digest"))


@register("fn12_json_vector", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def fn12(t: Tables):
    v = F.from_json("props", "map<string,int>")
    return t.events.select("event_id", F.element_at(v, "k").alias("k"))


@register("fn13_scalar_math", "SELECT p_partkey, round(tanh(p_size / 10), 6) AS t, round(ln(1 + p_size), 6) AS l, round(1 / (1 + exp(-(p_size - 25) / 10)), 6) AS gate, round_even(p_size / 2, 0) AS half FROM part")
def fn13(t: Tables):
    s = F.col("p_size")
    return rounded(t.part.select("p_partkey", F.tanh(s / 10).alias("t"), F.log1p(s).alias("l"), (1 / (1 + F.exp(-(s - 25) / 10))).alias("gate"), F.bround(s / 2, 0).alias("half")), "t", "l", "gate")


PERSONS = "SELECT c_custkey, c_mktsegment, CASE c_custkey % 4 WHEN 0 THEN 'Male' WHEN 1 THEN ' female' WHEN 3 THEN 'x' END AS sex, CASE c_custkey % 3 WHEN 0 THEN 'Lateral' WHEN 1 THEN 'Frontal' END AS view, CAST(c_custkey % 97 AS STRING) AS age FROM customer"
SEX = "CASE c_custkey % 4 WHEN 0 THEN 'male' WHEN 1 THEN 'female' ELSE 'patient' END AS sex, CASE c_custkey % 3 WHEN 0 THEN 'lateral' ELSE 'frontal' END AS view, CASE WHEN c_custkey % 97 = 0 THEN 'adult' ELSE CAST(c_custkey % 97 // 10 * 10 AS VARCHAR) || '-' || CAST(c_custkey % 97 // 10 * 10 + 9 AS VARCHAR) || '-year-old' END AS age"
CLAUSE = "CASE WHEN c_custkey % 7 = 1 OR (c_custkey % 2 <> 1 AND c_custkey % 3 <> 1 AND c_custkey % 5 <> 1) THEN 'no acute cardiopulmonary abnormality' ELSE array_to_string([x for x in [CASE WHEN c_custkey % 3 = 1 THEN 'cardiomegaly' END, CASE WHEN c_custkey % 2 = 1 THEN 'pulmonary edema' END, CASE WHEN c_custkey % 5 = 1 THEN 'a fracture' END] if x IS NOT NULL], '|') END"
CLAUSES = f"SELECT *, CASE len(string_split(c, '|')) WHEN 1 THEN c WHEN 2 THEN replace(c, '|', ' and ') ELSE regexp_replace(replace(c, '|', ', '), ', ([^,]*)$', ', and \\1') END AS clause, CASE WHEN c_custkey % 11 = 1 THEN 'Support devices are present.' ELSE '' END AS device FROM (SELECT c_custkey, c_mktsegment, {SEX}, {CLAUSE} AS c FROM customer)"


def findings_of(t: Tables):
    """Customers with label maps: 1, 0, uncertain and absent values."""
    k = F.col("c_custkey")
    mod = lambda n: F.when(k % n == 1, 1).when(k % n == 0, -1).otherwise(0)
    pairs = {"Edema": mod(2), "Cardiomegaly": mod(3), "Fracture": mod(5), text.NO_FINDING: mod(7), text.DEVICE: mod(11), "Pneumonia": F.lit(None).cast("int")}
    return t.sql(PERSONS).withColumn("labels", F.create_map(*[x for n, v in pairs.items() for x in (F.lit(n), v)]))


@register("fn2_person_phrases", f"SELECT c_custkey, {SEX} FROM customer")
def fn2(t: Tables):
    return t.sql(PERSONS).select("c_custkey", text.sex_phrase(F.col("sex")).alias("sex"), text.view_phrase(F.col("view")).alias("view"), text.age_bucket(F.col("age")).alias("age"))


@register("fn4_finding_clauses", f"SELECT c_custkey, clause, device FROM ({CLAUSES})")
def fn4(t: Tables):
    return findings_of(t).select("c_custkey", text.finding_clause(F.col("labels")).alias("clause"), text.device_clause(F.col("labels")).alias("device"))


VARIANT = "CAST('0x' || substr(sha256(concat_ws(':', c_custkey, 0)), 58, 7) AS BIGINT) % 4"


@register("fn5_chest_caption", f"SELECT c_custkey, concat_ws(' ', CASE {VARIANT} WHEN 0 THEN 'A ' || view || ' chest X-ray of a ' || age || ' ' || sex || ' patient. Findings: ' || clause || '.' WHEN 1 THEN 'Chest radiograph, ' || view || ' view, ' || age || ' ' || sex || ' patient. Findings: ' || clause || '.' WHEN 2 THEN 'A ' || view || ' view chest X-ray from a ' || age || ' ' || sex || ' patient showing ' || clause || '.' ELSE age || ' ' || sex || ' patient, ' || view || ' chest X-ray. Findings: ' || clause || '.' END, nullif(device, '')) AS caption FROM ({CLAUSES})")
def fn5_chest(t: Tables):
    variant = hashing.variant_index(F.col("c_custkey"), F.lit(0))
    return findings_of(t).select("c_custkey", text.chest_caption(variant, F.col("view"), F.col("age"), F.col("sex"), F.col("labels")).alias("caption"))


ARTICLE = "CASE WHEN age = 'adult' OR age LIKE '8%' THEN 'an' ELSE 'a' END"


@register("fn5_caption", f"SELECT c_custkey, CASE {VARIANT} WHEN 0 THEN 'A dermoscopic image of a lesion on the ' || lower(c_mktsegment) || ' in ' || {ARTICLE} || ' ' || age || ' ' || sex || ' patient.' WHEN 1 THEN 'Dermoscopy of a lesion on the ' || lower(c_mktsegment) || ', ' || age || ' ' || sex || ' patient.' WHEN 2 THEN upper(substr({ARTICLE}, 1, 1)) || substr({ARTICLE}, 2) || ' ' || age || ' ' || sex || ' patient with a lesion on the ' || lower(c_mktsegment) || ', dermoscopic view.' ELSE 'Dermoscopic image, ' || age || ' ' || sex || ' patient, showing a lesion on the ' || lower(c_mktsegment) || '.' END AS caption FROM ({CLAUSES})")
def fn5_skin(t: Tables):
    variant = hashing.variant_index(F.col("c_custkey"), F.lit(0))
    return t.sql(PERSONS).select("c_custkey", text.skin_caption(variant, F.lit("a lesion"), F.col("age"), F.col("sex"), F.col("c_mktsegment")).alias("caption"))


@register("ct1_snapshot_fairness", "WITH e AS (SELECT condition, count(*) AS n_images, sha256(string_agg(DISTINCT CAST(image_id AS VARCHAR), chr(10) ORDER BY CAST(image_id AS VARCHAR))) AS ids FROM predictions GROUP BY 1), c AS (SELECT unnest(['n_images', 'ids', 'condition']) AS \"key\", unnest([count(DISTINCT n_images), count(DISTINCT ids), count(DISTINCT condition)]) AS n_values FROM e) SELECT \"key\", n_values, n_values <= 1 AS uniform FROM c")
def ct1(t: Tables):
    each = t.predictions.groupBy("condition").agg(F.count(F.lit(1)).alias("n_images"), hashing.set_hash(F.col("image_id")).alias("ids"))
    return labels.one_value_per_key(each, ["n_images", "ids", "condition"])


@register("ct2_reproduced_confusion", "SELECT true_class, predicted, count(*) AS n FROM predictions WHERE seed = 1 GROUP BY 1, 2 EXCEPT ALL SELECT true_class, predicted, count(*) FROM predictions WHERE seed = 1 AND image_id % 1000 <> 0 GROUP BY 1, 2")
def ct2(t: Tables):
    of = lambda df: df.groupBy("true_class", "predicted").agg(F.count(F.lit(1)).alias("n"))
    p = t.predictions.where("seed = 1")
    return of(p).exceptAll(of(p.where("image_id % 1000 <> 0")))


@register("ct4_output_consistency", "SELECT image_id, CASE WHEN f.image_id IS NULL THEN 'no_flags' WHEN p.image_id IS NULL THEN 'no_row' ELSE 'differs' END AS problem FROM (SELECT * FROM pool WHERE image_id % 4 <> 0) p FULL JOIN flags f USING (image_id) WHERE f.image_id IS NULL OR p.image_id IS NULL OR f.valid = (p.score < 0.01)")
def ct4(t: Tables):
    a = t.pool.where("image_id % 4 <> 0").select("image_id", "score")
    both = a.withColumn("a", F.lit(1)).join(t.flags.withColumn("b", F.lit(1)), "image_id", "full")
    problem = F.when(F.col("b").isNull(), "no_flags").when(F.col("a").isNull(), "no_row").when(F.col("valid") == (F.col("score") < 0.01), "differs")
    return both.select("image_id", problem.alias("problem")).where("problem is not null")


@register("ct7_context_consistency", "SELECT label, count(DISTINCT raw) AS n_values FROM ternary WHERE raw IS NOT NULL GROUP BY 1 HAVING count(DISTINCT raw) > 1")
def ct7(t: Tables):
    return t.ternary.where("raw is not null").groupBy("label").agg(F.count_distinct("raw").alias("n_values")).where("n_values > 1")


@register("sc2_projected_scan", "SELECT l_orderkey, l_linenumber FROM lineitem")
def sc2(t: Tables):
    return t.lineitem.select("l_orderkey", "l_linenumber")


@register("sc7_grid_discovery", "SELECT * FROM (VALUES (1, 'D'), (2, 'D'), (3, 'D')) v(seed, condition) UNION ALL SELECT s, c FROM (VALUES (1, 'B'), (1, 'C'), (2, 'A'), (2, 'C'), (3, 'A'), (3, 'B')) w(s, c)")
def sc7(t: Tables):
    from tessella.sources.io import missing_cells

    return missing_cells(t.predictions, {"seed": [1, 2, 3], "condition": ["A", "B", "C", "D"]})


def vectors_of(t: Tables):
    """Label vectors of all customers with orders."""
    kinds = enumerate(labels.CLASSES)
    return t.orders.where("o_custkey is not null").groupBy(F.col("o_custkey").alias("group_id")).agg(*[F.max((F.coalesce("o_orderpriority", F.lit("")) == k).cast("int")).alias(f"k{i}") for i, k in kinds])


KINDS = [f"k{i}" for i in range(len(labels.CLASSES))]


def signals_of(t: Tables):
    """Positives of each label, and confident negatives of the first two: customers of enough orders without the label."""
    v = vectors_of(t).join(t.orders.groupBy(F.col("o_custkey").alias("group_id")).agg(F.count(F.lit(1)).alias("n_")), "group_id")
    return v.select("group_id", *KINDS, *[((F.col(f"k{i}") == 0) & (F.col("n_") >= 8)).cast("int").alias(f"n{i}") for i in range(2)])


SIGNALS = [*KINDS, "n0", "n1"]


@register("sp4_multilabel_allocation")
def sp4(t: Tables):
    return sampling.multilabel_groups(signals_of(t), SIGNALS)


def group_sizes(t: Tables):
    """Customers with their orders and, for each priority, how many of these have it."""
    kinds = enumerate(labels.CLASSES)
    return t.orders.where("o_custkey is not null").groupBy(F.col("o_custkey").alias("group_id")).agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.col("o_orderpriority") == k).alias(f"k{i}") for i, k in kinds])


def rarity_sql(target: int) -> str:
    """The same draws as a chain of steps, the order of the labels by a switch over all of them."""
    n = len(labels.CLASSES)
    kinds = ", ".join(f"count_if(o_orderpriority = '{k}') AS k{i}" for i, k in enumerate(labels.CLASSES))
    long = " UNION ALL ".join(f"SELECT {i} AS label, sum(k{i}) AS n, round_even(round({target} * sum(k{i}) / sum(n_rows), 9), 0) AS quota FROM g" for i in range(n))
    steps = [f"g AS (SELECT o_custkey AS group_id, count(*) AS n_rows, {kinds} FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1)", f"o AS (SELECT *, row_number() OVER (ORDER BY n, label) AS step FROM ({long}))", "v AS (SELECT group_id, n_rows, label, x FROM (UNPIVOT g ON " + ", ".join(f"k{i}" for i in range(n)) + " INTO NAME name VALUE x) JOIN (SELECT label, 'k' || label AS name FROM o) USING (name))", "s0 AS (SELECT group_id FROM g WHERE false)"]
    for k in range(1, n + 1):
        steps.append(f"h{k} AS (SELECT quota - coalesce((SELECT sum(x) FROM v JOIN s{k - 1} USING (group_id) WHERE v.label = o.label), 0) AS need, label FROM o WHERE step = {k})")
        steps.append(f"s{k} AS (SELECT group_id FROM s{k - 1} UNION ALL SELECT group_id FROM (SELECT group_id, need, coalesce(sum(x) OVER (ORDER BY sha256(concat_ws(':', '0', 'k' || v.label, group_id)), group_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM v JOIN h{k} ON v.label = h{k}.label WHERE x > 0 AND group_id NOT IN (SELECT group_id FROM s{k - 1})) WHERE before < need)")
    rest = f"SELECT group_id, coalesce(sum(n_rows) OVER (ORDER BY sha256(concat_ws(':', '0', group_id)), group_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g WHERE group_id NOT IN (SELECT group_id FROM s{n})"
    return f"WITH {', '.join(steps)} SELECT group_id FROM s{n} UNION ALL SELECT group_id FROM ({rest}) WHERE before < {target} - (SELECT coalesce(sum(n_rows), 0) FROM g JOIN s{n} USING (group_id))"


@register("sm11_rarity_first", rarity_sql(400))
def sm11(t: Tables):
    return sampling.rarity_first(group_sizes(t), KINDS, 400)


WANTED, DRAWN = [20, 25, 30, 20, 15], 45


def drawn_of(t: Tables):
    return sampling.matched_draw(vectors_of(t), KINDS, WANTED, DRAWN, 0.1, 0.9)


@register("sm12_matched_draw")
def sm12(t: Tables):
    return drawn_of(t)


@register("sm12_draw_residuals")
def sm12_residuals(t: Tables):
    return sampling.draw_residuals(drawn_of(t), KINDS, WANTED, 0.1)
