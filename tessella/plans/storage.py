"""Sources, sinks, registries and access guards: tables written to a scratch folder, read back and compared."""

from __future__ import annotations

import json
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.frames import settled
from tessella.operators import contracts, gate, labels
from tessella.plans.registry import Tables, register
from tessella.sources import commits, io


@contextmanager
def folder(t: Tables, name: str):
    """A scratch folder that is removed behind the block; what reads it must be settled in it."""
    path = io.scratch(t.spark, name)
    try:
        yield path
    finally:
        io.delete(t.spark, path)


def through(t: Tables, name: str, work: Callable[[str], DataFrame]) -> DataFrame:
    with folder(t, name) as path:
        return settled(work(path))


def outcomes(t: Tables, cases: dict[str, Callable[[], object]]) -> DataFrame:
    """(case, outcome): what each action does, "ok" or the error's name."""
    rows = []
    for name, act in cases.items():
        try:
            act()
            rows.append((name, "ok"))
        except (ValueError, PermissionError, FileExistsError) as e:
            rows.append((name, type(e).__name__))
    return t.spark.createDataFrame(rows, "case string, outcome string")


def refused(t: Tables, act: Callable[[], object], schema: str) -> DataFrame:
    """The faults for which an action is refused; no rows where it isn't."""
    try:
        act()
    except labels.Refused as e:
        return e.faults
    return t.spark.createDataFrame([], schema)


def named_file(t: Tables, df: DataFrame, path: str, form: str = "parquet") -> None:
    """``df`` as one file of that name."""
    fs, part = io._fs(t.spark, f"{path}.parts")
    getattr(df.coalesce(1).write, form)(f"{path}.parts")
    to = t.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    one = next(s.getPath() for s in fs.listStatus(part) if s.getPath().getName().startswith("part-"))
    fs.rename(one, to(path))
    fs.delete(part, True)


SUPPLIER = "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double"
SUPPLIERS = "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier"


@register("sc1_csv_scan", SUPPLIERS)
def sc1(t: Tables):
    def work(path: str):
        t.supplier.select("s_suppkey", "s_name", "s_nationkey", "s_acctbal").write.option("header", True).csv(f"{path}/t")
        return io.read_csv(t.spark, f"{path}/t", SUPPLIER)

    return through(t, "sc1", work)


@register("sc3_parquet_scan", "SELECT o_orderkey, o_totalprice FROM orders")
def sc3(t: Tables):
    return io.read_parquet(t.spark, f"{t.sf_dir}/orders.parquet", ["o_orderkey", "o_totalprice"]).select("o_orderkey", "o_totalprice")


@register("sc4_jsonl_scan", "SELECT s_suppkey, s_acctbal FROM supplier")
def sc4(t: Tables):
    def work(path: str):
        lines = t.supplier.select(F.explode(F.array(F.to_json(F.struct("s_suppkey", "s_acctbal")), F.lit(""))).alias("value"))  # a blank line behind each
        lines.write.text(f"{path}/t")
        return io.read_jsonl(t.spark, f"{path}/t", "s_suppkey bigint, s_acctbal double")

    return through(t, "sc4", work)


@register("sc5_keyed_jsonl", "SELECT 'customers' AS file, c_custkey AS custkey, NULL::VARCHAR AS fault, 1 AS n FROM customer UNION ALL SELECT 'orders', k, CASE WHEN k IS NULL THEN 'missing' ELSE 'repeated' END, count(*) FROM (SELECT CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS k FROM orders) GROUP BY k HAVING k IS NULL OR count(*) > 1")
def sc5(t: Tables):
    """The keys of a file that is read, and those for which another is refused."""
    with folder(t, "sc5") as path:
        files = {"customers": t.customer.select(F.col("c_custkey").alias("custkey")), "orders": t.orders.select(F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey")).alias("custkey"))}
        for name, df in files.items():
            df.select(F.to_json(F.struct("custkey")).alias("value")).write.text(f"{path}/{name}")
        read = lambda name: io.read_keyed_jsonl(t.spark, f"{path}/{name}", "custkey bigint", "custkey")
        good = read("customers").select(F.lit("customers").alias("file"), "custkey", F.lit(None).cast("string").alias("fault"), F.lit(1).cast("bigint").alias("n"))
        bad = refused(t, lambda: read("orders"), "custkey bigint, fault string, n bigint")
        return settled(good.unionByName(bad.withColumn("file", F.lit("orders"))))


@register("sc6_tagged_files", "SELECT image_id, predicted, condition, seed FROM predictions")
def sc6(t: Tables):
    def work(path: str):
        for c, seed in (("A", 1), ("B", 2), ("C", 3)):
            named_file(t, t.predictions.where(f"condition = '{c}'").select("image_id", "predicted"), f"{path}/pred_{c}_seed{seed}.parquet")
        got = io.read_tagged(t.spark, f"{path}/pred_*.parquet", r"^pred_([A-Z])_seed(\d+)\.", ["condition", "seed"])
        return got.withColumn("seed", F.col("seed").cast("int"))

    return through(t, "sc6", work)


@register("sc7_run_folders", "SELECT c AS condition, s AS seed, (c, s) IN (SELECT (condition, CAST(seed AS INT)) FROM predictions) AS present FROM (SELECT unnest(['A', 'B', 'C', 'D']) AS c), (SELECT unnest([1, 2]) AS s)")
def sc7(t: Tables):
    def work(path: str):
        cells = t.predictions.select("condition", "seed").distinct().collect()  # a row a run
        for r in cells:
            named_file(t, t.spark.createDataFrame([("{}",)], "value string"), f"{path}/runs/{r.condition}_s{r.seed}/metrics.json", "text")
        found = io.present_cells(t.spark, f"{path}/runs", "metrics.json", r"^([A-Z])_s(\d+)$", ["condition", "seed"]).withColumn("seed", F.col("seed").cast("int"))
        grid = {"condition": ["A", "B", "C", "D"], "seed": [1, 2]}
        lacking = io.missing_cells(found, grid).withColumn("present", F.lit(False))
        wanted = F.array(*[F.lit(c) for c in grid["condition"]])
        return lacking.unionByName(found.where(F.array_contains(wanted, F.col("condition")) & F.col("seed").isin(grid["seed"])).withColumn("present", F.lit(True)))

    return through(t, "sc7", work)


@register("sc8_image_files", "SELECT n_nationkey, n_nationkey % 5 <> 4 AS valid, CASE WHEN n_nationkey % 5 <> 4 THEN 3 END AS width, CASE WHEN n_nationkey % 5 <> 4 THEN 2 END AS height, CASE WHEN n_nationkey % 5 = 4 THEN NULL WHEN n_nationkey % 2 = 0 THEN round(n_nationkey * 0.299 + 10 * 0.587 + 20 * 0.114, 6) ELSE n_nationkey END::DOUBLE AS mean FROM nation")
def sc8(t: Tables):
    from tessella.operators.signals import decode_images

    b = lambda n: F.to_binary(F.lpad(F.hex(n), 2, "0"), F.lit("hex"))
    text = lambda s: F.encode(F.lit(s), "UTF-8")
    repeat = lambda x, n: F.concat(*[x] * n)
    k = F.col("n_nationkey")
    grey, colour = F.concat(text("P5\n3 2\n255\n"), repeat(b(k), 6)), F.concat(text("P6\n3 2\n255\n"), repeat(F.concat(b(k), b(F.lit(10)), b(F.lit(20))), 6))
    content = F.when(k % 5 == 4, text("P6\n3 2\n255\nshort")).when(k % 2 == 0, colour).otherwise(grey)
    rows = decode_images(t.nation.select("n_nationkey", content.alias("content")), key="n_nationkey")
    mean = F.aggregate(F.flatten("pixels"), F.lit(0.0), lambda a, x: a + x) / 6
    return rows.select("n_nationkey", "valid", "width", "height", F.round(mean, 6).alias("mean"))


@register("sc9_report_fields", "WITH r AS (SELECT n_nationkey AS k, count(s_suppkey)::VARCHAR AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1) SELECT k AS n_nationkey, 'split' AS field, 'train' AS expected, CASE WHEN k % 4 = 1 THEN 'final' END AS found FROM r WHERE k % 4 IN (1, 2) UNION ALL SELECT k, 'n', n, (n::BIGINT + 1)::VARCHAR FROM r WHERE k % 5 = 3")
def sc9(t: Tables):
    """Required fields that reports, a file each, lack or hold with another value."""
    with folder(t, "sc9") as path:
        k = F.col("n_nationkey")
        counts = settled(t.nation.join(t.supplier, F.col("s_nationkey") == k, "left").groupBy("n_nationkey").agg(F.count("s_suppkey").alias("n")))
        record = F.to_json(F.struct((F.col("n") + (k % 5 == 3).cast("int")).alias("n"), F.when(k % 4 == 1, "final").when(k % 4 != 2, "train").alias("split")))
        counts.select("n_nationkey", record.alias("record")).repartition("n_nationkey").write.partitionBy("n_nationkey").text(f"{path}/r")
        reports = io.read_reports(t.spark, f"{path}/r/*/*.txt", up=1).select(F.regexp_extract("name", r"(\d+)$", 1).cast("int").alias("n_nationkey"), "record")
        required = F.explode(F.create_map(F.lit("n"), F.col("n").cast("string"), F.lit("split"), F.lit("train"))).alias("field", "expected")
        return settled(contracts.field_faults(reports, counts.select("n_nationkey", required), "n_nationkey"))


BOXES = "SELECT CAST(s_suppkey AS STRING) AS image_id, 100 AS source_width, 80 AS source_height, 0.0D AS x0, 0.1D AS y0, 1.0D AS x1, 0.5D + (s_suppkey % 5) / 10.0D AS y1 FROM supplier"


@register("sc10_content_boxes", "SELECT CAST(s_suppkey AS VARCHAR) AS image_id, round((0.5 + (s_suppkey % 5) / 10 - 0.1)::DOUBLE, 6) AS area FROM supplier")
def sc10(t: Tables):
    def work(path: str):
        t.sql(BOXES).write.option("header", True).csv(f"{path}/t")
        return io.read_boxes(t.spark, f"{path}/t").select("image_id", F.round((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")), 6).alias("area"))

    return through(t, "sc10", work)


@register("sk1_csv_sink", SUPPLIERS)
def sk1(t: Tables):
    def work(path: str):
        io.publish(t.supplier.select("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), f"{path}/t", "csv", key="s_suppkey")
        return io.read_csv(t.spark, f"{path}/t", SUPPLIER)

    return through(t, "sk1", work)


@register("sk2_parquet_with_provenance", "SELECT s_suppkey, (SELECT count(*) FROM supplier) AS n_rows, 'similarity' AS signal FROM supplier")
def sk2(t: Tables):
    def work(path: str):
        io.publish(t.supplier.select("s_suppkey"), f"{path}/t", provenance={"signal": "similarity"})
        seen = io.provenance_of(t.spark, f"{path}/t", {"signal": "similarity"})
        return t.spark.read.parquet(f"{path}/t").select("s_suppkey", F.lit(seen["n_rows"]).cast("bigint").alias("n_rows"), F.lit(seen["signal"]).alias("signal"))

    return through(t, "sk2", work)


@register("sk3_checked_sink", "WITH l AS (SELECT CASE WHEN l_orderkey % 10 = 0 THEN -l_orderkey ELSE l_orderkey END AS k, count(*) AS n FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1) SELECT 'orders' AS sink, o_orderkey, NULL::VARCHAR AS fault, 1 AS n FROM orders UNION ALL SELECT 'lines', k, 'repeated', n FROM l WHERE n > 1 UNION ALL SELECT 'lines', k, 'unexpected', n FROM l WHERE k NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'lines', o_orderkey, 'absent', 0 FROM orders WHERE o_orderkey NOT IN (SELECT k FROM l)")
def sk3(t: Tables):
    """The keys of a table that is published, and those for which another is refused after it was read back."""
    with folder(t, "sk3") as path:
        wanted, k = t.orders.select("o_orderkey"), F.col("l_orderkey")
        io.publish(wanted, f"{path}/orders", key="o_orderkey", expected=wanted)
        lines = t.lineitem.where("l_linenumber <= 2").select(F.when(k % 10 == 0, -k).otherwise(k).alias("o_orderkey"))
        bad = refused(t, lambda: io.publish(lines, f"{path}/lines", key="o_orderkey", expected=wanted), "o_orderkey bigint, fault string, n bigint")
        if not bad.isEmpty() and io.exists(t.spark, f"{path}/lines"):
            raise AssertionError("a refused table was published")
        good = t.spark.read.parquet(f"{path}/orders").select(F.lit("orders").alias("sink"), "o_orderkey", F.lit(None).cast("string").alias("fault"), F.lit(1).cast("bigint").alias("n"))
        return settled(good.unionByName(bad.withColumn("sink", F.lit("lines"))))


@register("sk4_jsonl_append", "SELECT s_suppkey, s_acctbal FROM supplier UNION ALL SELECT p_partkey, p_retailprice FROM part")
def sk4(t: Tables):
    def work(path: str):
        io.publish(t.supplier.select("s_suppkey", "s_acctbal"), f"{path}/t", "json")
        io.append_log(t.part.select(F.col("p_partkey").alias("s_suppkey"), F.col("p_retailprice").alias("s_acctbal")), f"{path}/t")
        return io.read_jsonl(t.spark, f"{path}/t", "s_suppkey bigint, s_acctbal double")

    return through(t, "sk4", work)


@register("sk5_frozen_report", "WITH r AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT o_custkey, n::VARCHAR AS frozen, NULL::VARCHAR AS found FROM r UNION ALL SELECT o_custkey, n::VARCHAR, (n + 1)::VARCHAR FROM r WHERE o_custkey % 5 = 0")
def sk5(t: Tables):
    """Frozen values, and those found later for which a write is refused."""

    def work(path: str):
        rows = settled(t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")))
        io.freeze(t.spark, f"{path}/r", rows.where("o_custkey % 3 = 0"), "o_custkey")
        io.freeze(t.spark, f"{path}/r", rows, "o_custkey")  # a third is there with the same values
        later = rows.withColumn("n", F.col("n") + (F.col("o_custkey") % 5 == 0).cast("int"))
        bad = refused(t, lambda: io.freeze(t.spark, f"{path}/r", later, "o_custkey"), "o_custkey bigint, field string, frozen string, found string")
        held = commits.table(t.spark, f"{path}/r").select("o_custkey", F.col("n").cast("string").alias("frozen"), F.lit(None).cast("string").alias("found"))
        return held.unionByName(bad.drop("field"))

    return through(t, "sk5", work)


@register("sk6_sorted_csv", "SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey) - 1 AS place FROM supplier")
def sk6(t: Tables):
    def work(path: str):
        io.publish(t.supplier.select("s_acctbal", "s_suppkey"), f"{path}/t", "csv", sort=["s_acctbal", "s_suppkey"])
        rows = t.spark.read.schema("s_acctbal double, s_suppkey bigint").csv(f"{path}/t", header=True)
        # the place that files and their lines say, not the values
        rows = rows.select("s_suppkey", F.col("_metadata.file_name").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
        from pyspark.sql import Window

        return settled(rows).select("s_suppkey", (F.row_number().over(Window.orderBy("f", "b", "i")) - 1).cast("bigint").alias("place"))

    return through(t, "sk6", work)


@register("sk7_folder_publish", "SELECT 'a' AS name, count(*) AS n FROM supplier UNION ALL SELECT 'b', count(*) FROM nation")
def sk7(t: Tables):
    def work(path: str):
        parts = {"a": t.supplier.select(F.col("s_suppkey").alias("k")), "b": t.nation.select(F.col("n_nationkey").cast("bigint").alias("k"))}
        whole = parts["a"].withColumn("name", F.lit("a")).unionByName(parts["b"].withColumn("name", F.lit("b")))
        io.publish(whole.limit(1), f"{path}/t")
        io.publish(whole, f"{path}/t", once=False)  # replaces the folder
        return t.spark.read.parquet(f"{path}/t").groupBy("name").agg(F.count(F.lit(1)).alias("n"))

    return through(t, "sk7", work)


@register("sk8_registry", "SELECT * FROM (VALUES ('r1', 'completed', (SELECT count(*) FROM nation), 0), ('r2', 'failed', NULL, 1), ('r3', 'completed', NULL, 2)) v(experiment_id, status, n, n_ancestors)")
def sk8(t: Tables):
    def work(path: str):
        with io.experiment(t.spark, f"{path}/r", "r1", "select", "h1") as metrics:
            metrics["n"] = t.nation.count()
        try:
            with io.experiment(t.spark, f"{path}/r", "r2", "select", "h2", parent="r1"):
                raise ValueError("a failing run")
        except ValueError:
            pass
        with io.experiment(t.spark, f"{path}/r", "r3", "select", "h3", parent="r2"):
            pass
        runs = settled(commits.table(t.spark, f"{path}/r"))
        up = io.ancestors(runs, 5).groupBy("experiment_id").agg(F.count(F.lit(1)).alias("n_ancestors"))
        rows = runs.join(up, "experiment_id", "left")
        return rows.select("experiment_id", "status", F.get_json_object("metrics", "$.n").cast("bigint").alias("n"), F.coalesce("n_ancestors", F.lit(0)).cast("int").alias("n_ancestors"))

    return through(t, "sk8", work)


@register("sk9_reports", "WITH c AS (SELECT i, j, (SELECT count(*) FROM predictions WHERE true_class = i AND predicted = j) AS n FROM range(5) a(i), range(5) b(j)) SELECT '| r_regionkey | r_name |' || chr(10) || '| --- | --- |' || chr(10) || (SELECT string_agg('| ' || r_regionkey || ' | ' || r_name || ' |', chr(10) ORDER BY r_regionkey) FROM region) AS markdown, (SELECT list(n ORDER BY i, j) FROM c) AS cells")
def sk9(t: Tables):
    cells = t.predictions.groupBy("true_class", "predicted").agg(F.count(F.lit(1)).alias("n"))
    shown = contracts.confusion_text(cells, list("abcde"))
    numbers = [int(x) for x in shown.split() if x.isdigit()]
    return t.spark.createDataFrame([(contracts.markdown(t.region.select("r_regionkey", "r_name").orderBy("r_regionkey")), numbers)], "markdown string, cells array<bigint>")


@register("sk10_candidate_tables", "SELECT n_nationkey AS dx, count(s_suppkey) AS n FROM nation LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON s_nationkey = n_nationkey GROUP BY 1")
def sk10(t: Tables):
    def work(path: str):
        c = t.supplier.select(F.col("s_suppkey").cast("string").alias("image_id"), F.col("s_nationkey").alias("dx"), (F.col("s_acctbal") > 0).alias("accepted"))
        counts = settled(io.write_candidates(c, t.sql(BOXES), t.nation.select(F.col("n_nationkey").alias("dx")), path).select("dx", "n"))
        n = t.spark.read.parquet(f"{path}/candidates").join(t.spark.read.parquet(f"{path}/boxes"), "image_id").count()
        if n != counts.agg(F.sum("n")).first()[0]:
            raise AssertionError("tables and counts differ")
        return counts

    return through(t, "sk10", work)


@register("sk11_exclusive_create", "SELECT s_suppkey, s_acctbal > 0 AS first_run, s_acctbal > 0 AS written FROM supplier")
def sk11(t: Tables):
    """Rows of two runs that make the same file; only the first's are in it."""

    def work(path: str):
        rows = t.supplier.select("s_suppkey", (F.col("s_acctbal") > 0).alias("first_run"))
        io.publish(rows.where("first_run"), f"{path}/t", "json")
        try:
            io.publish(rows.where("not first_run"), f"{path}/t", "json")
            raise AssertionError("a second run was not refused")
        except FileExistsError:
            pass
        held = io.read_jsonl(t.spark, f"{path}/t", "s_suppkey bigint, first_run boolean").select("s_suppkey", F.lit(True).alias("there"))
        return rows.join(held, "s_suppkey", "left").select("s_suppkey", "first_run", F.coalesce("there", F.lit(False)).alias("written"))

    return through(t, "sk11", work)


@register("pf17_protected_split", "WITH s AS (SELECT CASE WHEN group_id % 5 = 0 THEN 'final' ELSE 'train' END AS split, dx, count(*) AS n FROM pool GROUP BY 1, 2), p AS (SELECT unnest(['training', 'schema_validation', 'final_evaluation']) AS purpose) SELECT purpose, split, dx, n FROM s, p WHERE NOT (split = 'final' AND purpose = 'training') UNION ALL SELECT 'training', 'final', NULL, NULL")
def pf17(t: Tables):
    """What each purpose gets of each split, counted by class; a row of nulls where it may read nothing."""

    def work(path: str):
        t.pool.withColumn("split", F.when(F.col("group_id") % 5 == 0, "final").otherwise("train")).write.partitionBy("split").parquet(f"{path}/t")
        got = None
        for purpose in ("training", "schema_validation", "final_evaluation"):
            for split in ("final", "train"):
                try:
                    seen = contracts.read_split(t.spark, f"{path}/t", split, purpose).groupBy("dx").agg(F.count(F.lit(1)).alias("n"))
                except PermissionError:
                    seen = t.spark.createDataFrame([(None, None)], "dx string, n bigint")
                seen = seen.select(F.lit(purpose).alias("purpose"), F.lit(split).alias("split"), "dx", "n")
                got = seen if got is None else got.unionByName(seen)
        return got

    return through(t, "pf17", work)


#: Files that a task makes.
FILES = 256


@register("pf23_rows_with_files", "SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 = 0")
def pf23(t: Tables):
    def work(path: str):
        held = t.supplier.where("s_suppkey % 3 = 0").select(F.concat(F.lit("img"), F.col("s_suppkey").cast("string")).alias("name"), "s_name")
        # each file is made by one task, and moved to its place by it (version 2), not by the driver
        held = held.repartition(-(-held.count() // FILES) or 1, "name")
        held.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("name").parquet(f"{path}/t")
        files = t.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{path}/t").select(F.regexp_extract("path", r"/name=([^/]+)/", 1).alias("name"))
        return labels.known_files(t.supplier.withColumn("file", F.concat(F.lit("img"), F.col("s_suppkey").cast("string"))), files, "file").select("s_suppkey")

    return through(t, "pf23", work)


def nation_files(t: Tables, path: str) -> DataFrame:
    """Hashes of one text file a nation, named by its folder."""
    t.nation.repartition("n_nationkey").select("n_nationkey", "n_name").write.partitionBy("n_nationkey").text(f"{path}/f")
    return io.hash_files(t.spark, f"{path}/f/*/*.txt", up=1)


@register("fn10_content_hashes", "SELECT n_nationkey, sha256(n_name || chr(10)) AS sha256, sha256((SELECT string_agg(l, chr(10) ORDER BY l) FROM (SELECT 'n_nationkey=' || n_nationkey || ':' || sha256(n_name || chr(10)) AS l FROM nation))) AS folder FROM nation")
def fn10(t: Tables):
    def work(path: str):
        files = nation_files(t, path)
        return files.select(F.regexp_extract("name", r"(\d+)$", 1).cast("int").alias("n_nationkey"), "sha256").crossJoin(F.broadcast(io.folder_hash(files).select(F.col("sha256").alias("folder"))))

    return through(t, "fn10", work)


@register("ct3_frozen_design", "WITH d AS (SELECT o_custkey, count(*) AS n, o_custkey % 3 AS seed FROM orders GROUP BY 1) SELECT o_custkey, sha256('{\"n\":' || n || ',\"seed\":' || seed || '}') AS design_hash, CASE WHEN o_custkey % 7 = 0 THEN 'seed' END AS refused_field, CASE WHEN o_custkey % 7 = 0 THEN (seed + 1)::VARCHAR END AS found FROM d")
def ct3(t: Tables):
    """Frozen designs, and the field and value for which one is refused later; notes may differ."""

    def work(path: str):
        k = F.col("o_custkey")
        designs = settled(t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).withColumns({"seed": k % 3, "note": F.lit("a")}))
        put = lambda df: contracts.freeze_designs(t.spark, f"{path}/d", df, "o_custkey", ["n", "seed"])
        put(designs)
        frozen = put(designs.withColumn("note", F.lit("b")))
        bad = refused(t, lambda: put(designs.withColumn("seed", F.col("seed") + (k % 7 == 0).cast("int"))), "o_custkey bigint, field string, frozen string, found string")
        return frozen.join(bad, "o_custkey", "left").select("o_custkey", "design_hash", F.col("field").alias("refused_field"), "found")

    return through(t, "ct3", work)


@register("ct5_artifact_hashes", "SELECT 'n_nationkey=' || n_nationkey AS name, CASE n_nationkey % 5 WHEN 1 THEN 'other_contents' ELSE 'incomplete' END AS problem FROM nation WHERE n_nationkey % 5 IN (1, 2) UNION ALL SELECT 'n_nationkey=none', 'missing'")
def ct5(t: Tables):
    def work(path: str):
        files = nation_files(t, path)
        k = F.regexp_extract("name", r"(\d+)$", 1).cast("int") % 5
        records = files.select("name", F.when(k == 2, "running").otherwise("complete").alias("status"), F.when(k == 1, F.sha2(F.lit("other"), 256)).otherwise(F.col("sha256")).alias("sha256"))
        lost = t.spark.createDataFrame([("n_nationkey=none", "complete", "0")], "name string, status string, sha256 string")
        return contracts.hash_contracts(records.unionByName(lost), files)

    return through(t, "ct5", work)


def runs_of(t: Tables) -> DataFrame:
    """Runs of which those of C were tuned on the protected split, and B and C trained on the same data."""
    trained = F.sha2(F.when(F.col("condition") == "A", "real").otherwise("real+synthetic"), 256)
    split = F.when(F.col("condition") == "C", "final").otherwise("train")
    return t.predictions.select("condition", "seed").distinct().select("condition", "seed", split.alias("split"), F.lit("p1").alias("protocol"), trained.alias("trained_on"))


@register("ct6_preconditions", "SELECT 'grid_complete' AS \"check\", 1 AS n_bad, false AS passed UNION ALL SELECT 'protected_split_unused', count(DISTINCT seed), false FROM predictions WHERE condition = 'C' UNION ALL SELECT 'shared_protocol', 0, true UNION ALL SELECT 'training_data_differs', 1, false UNION ALL SELECT 'groups_known', count(*), count(*) = 0 FROM pool WHERE group_id % 50 = 7")
def ct6(t: Tables):
    grid = t.spark.createDataFrame([("A", 1), ("B", 2), ("C", 3), ("C", 1)], "condition string, seed int")
    protected = t.pool.select("image_id", F.when(F.col("group_id") % 50 != 7, F.col("group_id")).alias("group_id"))
    return contracts.preconditions(runs_of(t), grid, protected, ["protocol"])


@register("ct8_evaluation_runs", "WITH r AS (SELECT c_mktsegment AS run, row_number() OVER (ORDER BY c_mktsegment) AS k FROM customer GROUP BY 1) SELECT run AS \"case\", CASE k WHEN 1 THEN 'ok' ELSE 'PermissionError' END AS outcome FROM r UNION ALL SELECT run || ' again', 'ok' FROM r WHERE k = 1")
def ct8(t: Tables):
    runs = [r.c_mktsegment for r in t.customer.select("c_mktsegment").distinct().orderBy("c_mktsegment").collect()]  # a row a segment
    with folder(t, "ct8") as path:
        mark = lambda run: lambda: contracts.register_evaluation(t.spark, run, f"{path}/e")
        return outcomes(t, {r: mark(r) for r in runs} | {f"{runs[0]} again": mark(runs[0])})


@register("ct9_design_hash", "WITH d AS (SELECT subset_id FROM members GROUP BY 1) SELECT subset_id, CASE WHEN subset_id % 7 = 0 THEN 'field_lacks' WHEN subset_id % 11 = 0 THEN 'not_reported' ELSE 'differs' END AS fault FROM d WHERE subset_id % 7 = 0 OR subset_id % 11 = 0 OR subset_id % 5 = 0")
def ct9(t: Tables):
    """Builds that are refused, and why: designs of subsets against the hashes that were reported for them."""
    k, fields = F.col("subset_id"), ["size", "least", "seed"]
    designs = t.members.groupBy("subset_id").agg(F.count(F.lit(1)).alias("size"), F.min("image_id").alias("least")).withColumn("seed", k % 3)
    reported = contracts.design_hashes(designs, fields).where(k % 11 != 0)
    builds = designs.withColumns({"size": F.col("size") + (k % 5 == 0).cast("int"), "seed": F.when(k % 7 != 0, F.col("seed"))})
    return contracts.build_faults(builds, reported, "subset_id", fields)


@register("gt5_provenance", "SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'candidates_csv_sha256,git_commit_hash' WHEN s_suppkey % 4 = 3 THEN 'candidates_csv_sha256,git_commit_hash,n_rows,schema_version,signal' ELSE '' END AS missing, CASE WHEN s_suppkey % 4 = 1 THEN 2 ELSE 0 END AS mentions, s_suppkey % 4 = 2 AS passed FROM supplier")
def gt5(t: Tables):
    k = F.col("s_suppkey")
    whole = {"schema_version": 2, "signal": "s", "n_rows": 5, "candidates_csv_sha256": "x", "git_commit_hash": "y"}
    record = F.when(k % 4 == 0, json.dumps({f: whole[f] for f in list(whole)[:3]})).when(k % 4 == 1, json.dumps(whole | {"split": "final", "deep": {"used": ["train", "final"]}})).when(k % 4 == 2, json.dumps(whole | {"split": "train"}))
    return contracts.provenance_checks(t.supplier.select("s_suppkey", record.alias("record")), "s_suppkey", "record", "final")


FEATURES = "SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'explainability_raw_' ELSE 'feature_' END || CAST(s_suppkey AS VARCHAR(20)) AS feature, CASE WHEN s_suppkey % 7 <> 0 THEN s_nationkey END AS signal FROM supplier"


@register("gt2_selection_eligibility", f"WITH f AS ({FEATURES}) SELECT s_suppkey, feature, CASE WHEN feature LIKE 'explainability_raw_%' THEN 'raw' WHEN signal IS NULL THEN 'no_owner' WHEN n_nationkey IS NULL THEN 'not_surviving' ELSE 'admitted' END AS verdict FROM f LEFT JOIN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 2) n ON n_nationkey = signal")
def gt2(t: Tables):
    alive = t.nation.where("n_regionkey <> 2").select(F.col("n_nationkey").alias("signal"))
    return gate.eligibility(t.sql(FEATURES), alive).select("s_suppkey", "feature", "verdict")
