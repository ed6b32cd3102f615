"""Access rules, frozen designs, acceptance criteria, budgets and feasibility."""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.frames import numbered
from tessella.functions.hashing import hash_dict, seeded
from tessella.operators.sampling import rank_bins
from tessella.sources.io import exists, freeze, read_json, write_frozen_json

#: Purposes that may read each protected split; other splits are open.
PURPOSES = {"final": frozenset({"final_evaluation", "schema_validation"})}


def read_split(spark: SparkSession, root: str, split: str, purpose: str, protected: dict[str, frozenset] = PURPOSES) -> DataFrame:
    """A split's rows; a purpose that isn't allowed raises before any plan is made."""
    if split in protected and purpose not in protected[split]:
        raise PermissionError(f"{purpose} may not read {split}")
    return spark.read.parquet(f"{root}/split={split}")


def split_metadata(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Size and set hash of each split, without its labels."""
    from tessella.functions.hashing import set_hash

    return df.groupBy(split).agg(F.count(F.lit(1)).alias("n"), set_hash(F.col(key)).alias("ids_hash"))


def design_hash(design: dict, fields: list[str]) -> str:
    """Hash of the fields that matter; a missing one raises."""
    return hash_dict({f: design[f] for f in fields})


def freeze_or_match(spark: SparkSession, design: dict, fields: list[str], path: str) -> str:
    """Freeze a design at its first use; later a design that differs in a field that matters is refused."""
    digest = design_hash(design, fields)
    write_frozen_json(spark, {"design_hash": digest}, path)
    return digest


def design_hashes(designs: DataFrame, fields: list[str]) -> DataFrame:
    """``designs`` with the hash of each row's fields that matter (SHA-256 of their JSON, by name); NULL where one lacks."""
    whole = F.sha2(F.to_json(F.struct(*sorted(fields))), 256)
    lacks = reduce(lambda a, b: a | b, [F.col(f).isNull() for f in fields])
    return designs.withColumn("design_hash", F.when(~lacks, whole))


def freeze_designs(spark: SparkSession, path: str, designs: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Freeze the fields that matter of each design at its first use; a design that differs in one later is refused, and all that come with it.

    Returns the frozen designs with their hashes. Refused tells each design, field and both values.
    """
    return design_hashes(freeze(spark, path, designs.select(key, *fields), key), fields)


def build_faults(builds: DataFrame, reported: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, fault) of builds that may not go on: a field that matters lacks, no hash was reported for them, or another one."""
    met = design_hashes(builds, fields).join(reported.select(key, F.col("design_hash").alias("reported_")), key, "left")
    fault = F.when(F.col("design_hash").isNull(), "field_lacks").when(F.col("reported_").isNull(), "not_reported").when(F.col("design_hash") != F.col("reported_"), "differs")
    return met.select(key, fault.alias("fault")).where("fault is not null")


def field_faults(reports: DataFrame, expected: DataFrame, key: str, column: str = "record") -> DataFrame:
    """(key, field, expected, found) of required fields (key, field, expected, as text) that reports (JSON) don't have with that value; found is NULL where the field, or the report, lacks."""
    held = reports.select(key, F.explode(F.from_json(column, "map<string,string>")).alias("field", "found"))
    return expected.join(held, [key, "field"], "left").where(~F.col("expected").eqNullSafe(F.col("found"))).select(key, "field", "expected", "found")


def register_evaluation(spark: SparkSession, run: str, path: str) -> None:
    """Mark outcomes as read by a run; another run is refused from then on."""
    if exists(spark, path) and read_json(spark, path).get("run") != run:
        raise PermissionError(f"outcomes were read by {read_json(spark, path).get('run')}")
    write_frozen_json(spark, {"run": run}, path)


def forbidden_paths(df: DataFrame, column: str, key: str, value: object, depth: int = 8) -> DataFrame:
    """(key, path) of every place of a JSON tree, ``depth`` levels deep at most, whose value is ``value``; what is no JSON has none.

    A deeper tree raises.
    """
    rows = df.select(F.col(key).alias("k"), F.try_parse_json(column).alias("v"), F.lit("$").alias("path")).where("v is not null")
    found, wanted = None, F.parse_json(F.lit(json.dumps(value)))
    for level in range(depth + 1):
        here = rows.where(F.to_json("v") == F.to_json(wanted)).select(F.col("k").alias(key), "path")
        found = here if found is None else found.unionByName(here)
        nested = F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)")
        if level == depth:
            deep = F.raise_error(F.lit("a tree is deeper than expected")).cast("string")
            found = found.unionByName(rows.where(nested).select(F.col("k").alias(key), deep.alias("path")))
            break
        # one level down: entries of objects by name, items of arrays by place
        rows = rows.where(nested).lateralJoin(df.sparkSession.tvf.variant_explode(F.col("v").outer()).select("pos", F.col("key").alias("name"), F.col("value").alias("next")))
        step = F.when(F.col("name").isNotNull(), F.concat(F.lit("."), "name")).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        rows = rows.select("k", F.col("next").alias("v"), F.concat("path", step).alias("path"))
    return found


def accepted(evidence: DataFrame, criteria: DataFrame) -> DataFrame:
    """Frozen criteria (name, comparison ``>=`` or ``<=``, bound) against evidence (name, value); missing evidence fails."""
    rows = criteria.join(evidence, "name", "left")
    good = F.when(F.col("comparison") == ">=", F.col("value") >= F.col("bound")).when(F.col("comparison") == "<=", F.col("value") <= F.col("bound"))
    return rows.withColumn("accepted", F.coalesce(good, F.lit(False)))


def official_method(evidence: DataFrame, least: int) -> DataFrame:
    """Per class: the network where it was verified on both sides and beats the baseline, the measured best where verified, else the baseline."""
    verified = (F.col("train") >= least) & (F.col("held_out") >= least)
    method = F.when(verified & (F.col("network") > F.col("baseline")), "network").when(verified, "measured").otherwise("baseline")
    return evidence.withColumn("method", method)


def budget(plan: DataFrame, hours_each: float, limit: float) -> DataFrame:
    """Runs, hours and whether a plan (policies, seeds, folds) stays in its budget."""
    runs = F.col("policies") * F.col("seeds") * F.col("folds")
    return plan.withColumns({"runs": runs, "hours": runs * F.lit(hours_each), "within": runs * F.lit(hours_each) <= limit})


def feasibility_report(pool: DataFrame, sizes: list[int], bins: int, by: str = "dx", score: str = "score", key: str = "image_id") -> DataFrame:
    """For each class and band, its rows and which subset sizes it could fill; all failures stay listed."""
    banded = rank_bins(pool, bins, score, key, [by]).groupBy(by, "band").agg(F.count(F.lit(1)).alias("n"))
    short = F.filter(F.array(*[F.lit(s) for s in sizes]), lambda s: s > F.col("n"))
    return banded.withColumns({"feasible": F.size(short) == 0, "too_large": F.array_join(F.transform(short, lambda s: s.cast("string")), ",")})


def subset_design(pool: DataFrame, per_role: int, size: int, bins: int = 3, seed: int = 0, key: str = "image_id", score: str = "score") -> DataFrame:
    """Members (subset_id, role, key) of random subsets, of subsets of one score band, and of mixtures of all bands.

    Each subset draws by its own hash order; a band subset draws in band ``k mod bins + 1``; a
    mixture's shares of the bands are a uniform Dirichlet draw (exponentials of hashes over their
    sum), turned into counts by largest remainders. Candidates of a draw are thinned by their hash
    to a few times ``size`` before they are ranked.
    """
    rows = numbered(pool.select(key, score), [F.col(score), F.col(key)], "at_")
    n = rows.count()
    band = F.greatest(F.lit(1), F.ceil(F.col("at_") * bins / F.lit(float(max(n - 1, 1))) - 1e-12)).cast("int")
    unit = lambda h: F.conv(F.substring(h, 1, 8), 16, 10).cast("double")
    # how many each subset takes of each band; band 0 is the whole pool
    plan = pool.sparkSession.range(per_role).select(F.col("id").cast("int").alias("k"))
    mixed = plan.withColumn("band", F.explode(F.sequence(F.lit(1), F.lit(bins)))).withColumn("role", F.lit("mixture"))
    mixed = mixed.withColumn("w", -F.log((unit(seeded(seed, "role", "k", "band")) + 1) / float((1 << 32) + 1)))
    over = Window.partitionBy("k")
    mixed = mixed.withColumn("ideal", F.round(size * F.col("w") / F.sum("w").over(over), 9)).withColumn("whole", F.floor("ideal"))
    extra = F.row_number().over(over.orderBy((F.col("ideal") - F.col("whole")).desc(), "band")) <= size - F.sum("whole").over(over)
    mixed = mixed.select("role", "k", "band", (F.col("whole") + extra.cast("int")).cast("int").alias("take"))
    other = lambda role, b: plan.select(F.lit(role).alias("role"), "k", b.cast("int").alias("band"), F.lit(size).alias("take"))
    plan = mixed.unionByName(other("random", F.lit(0))).unionByName(other("band", F.col("k") % bins + 1))
    rows = rows.select(key, F.explode(F.array(F.lit(0), band)).alias("band"))
    drawn = rows.join(F.broadcast(plan), "band").withColumn("h", seeded(seed, "role", "k", key))  # a row a subset and band
    room = F.when(F.col("band") == 0, F.lit(n)).otherwise(F.lit(n / bins))
    drawn = drawn.where(unit("h") / float(1 << 32) < (4.0 * size + 64) / room)
    rank = F.row_number().over(Window.partitionBy("role", "k", "band").orderBy("h", key))
    return drawn.withColumn("r", rank).where(F.col("r") <= F.col("take")).select(F.concat_ws("-", "role", "k").alias("subset_id"), "role", key)


#: Fields that an artifact's provenance must have.
PROVENANCE = ("schema_version", "signal", "n_rows", "candidates_csv_sha256", "git_commit_hash")


def provenance_checks(sidecars: DataFrame, key: str, column: str, forbidden: str, required: tuple[str, ...] = PROVENANCE) -> DataFrame:
    """(key, missing, mentions, passed) of provenance records (JSON): required fields that are absent, and how often a forbidden value occurs; a null record fails."""
    keys = F.coalesce(F.json_object_keys(column), F.array().cast("array<string>"))
    missing = F.array_join(F.array_sort(F.array_except(F.array(*[F.lit(r) for r in required]), keys)), ",")
    mentions = forbidden_paths(sidecars, column, key, forbidden).groupBy(key).agg(F.count(F.lit(1)).alias("mentions"))
    rows = sidecars.select(key, missing.alias("missing")).join(mentions, key, "left").withColumn("mentions", F.coalesce("mentions", F.lit(0)))
    return rows.withColumn("passed", (F.col("missing") == "") & (F.col("mentions") == 0))


def hash_contracts(records: DataFrame, files: DataFrame, name: str = "name") -> DataFrame:
    """(name, problem) of artifacts whose completion record (name, status, sha256) isn't met by the files (name, sha256): missing, incomplete or other contents."""
    both = records.join(files.select(name, F.col("sha256").alias("found")), name, "left")
    problem = F.when(F.col("found").isNull(), "missing").when(~F.col("status").eqNullSafe("complete"), "incomplete").when(F.col("found") != F.col("sha256"), "other_contents")
    return both.select(name, problem.alias("problem")).where("problem is not null")


def preconditions(runs: DataFrame, grid: DataFrame, protected: DataFrame, shared: list[str], key: str = "image_id") -> DataFrame:
    """(check, n_bad, passed) of what must hold before the protected split is evaluated.

    ``runs``: condition, seed, split, trained_on (a hash of the training data) and the ``shared``
    columns; ``grid``: the condition and seed of every planned run; ``protected``: the split's key
    and group. Every planned run is there once; none was trained or tuned on the protected
    split; each shared column has one value; no two conditions were trained on the same data; every
    protected row has a group.
    """
    cells = ["condition", "seed"]
    bad = {
        "grid_complete": grid.join(runs, cells, "left_anti").select(F.lit(1)).unionAll(runs.groupBy(*cells).count().where("count > 1").select(F.lit(1))),
        "protected_split_unused": runs.where("split = 'final'").select(F.lit(1)),
        "shared_protocol": runs.agg(*[F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("null"))).alias(c) for c in shared]).select(F.explode(F.array(*[F.col(c) for c in shared])).alias("n")).where("n > 1").select(F.lit(1)),
        "training_data_differs": runs.groupBy("trained_on").agg(F.count_distinct("condition").alias("n")).where("n > 1").select(F.lit(1)),
        "groups_known": protected.where("group_id is null").select(F.lit(1)),
    }
    out = None
    for name, rows in bad.items():
        one = rows.agg(F.count(F.lit(1)).alias("n_bad")).select(F.lit(name).alias("check"), "n_bad", (F.col("n_bad") == 0).alias("passed"))
        out = one if out is None else out.unionByName(one)
    return out


def enforce(checks: DataFrame) -> None:
    """ValueError that names all failed checks, of a table of a row a check."""
    failed = sorted(r.check for r in checks.where("not passed").select("check").limit(100).collect())
    if failed:
        raise ValueError(f"preconditions failed: {failed}")


def run_name(kind: str, version: str) -> str:
    """A run's immutable name, ``kind-version``; kinds other than dev and production, and empty versions, raise."""
    if kind not in ("dev", "production") or not re.fullmatch(r"[A-Za-z0-9._-]+", version):
        raise ValueError(f"no run name: {kind!r}, {version!r}")
    return f"{kind}-{version}"


def valid_run(name: str, kind: str):
    """Whether a column's run names are of the kind that another column says, with something behind it."""
    return F.coalesce(F.col(kind).isin("dev", "production") & F.startswith(F.col(name), F.concat(kind, F.lit("-"))) & (F.length(name) > F.length(kind) + 1), F.lit(False))


def scientific_status(name: str):
    """Only the namespace ``production`` itself is production evidence."""
    return F.when(F.col(name) == "production", "production").otherwise("non-production / development-only")


def run_paths(root: str, name: str) -> dict[str, str]:
    """Where a run's tables and reports lie."""
    base = f"{root.rstrip('/')}/{name}"
    tables = ("recipes", "recipe_decisions", "generation_manifest", "candidates", "boxes", "scores", "selection", "predictions")
    return {t: f"{base}/{t}" for t in tables} | {f"{r}_report": f"{base}/reports/{r}.json" for r in ("generation", "selection", "comparison")}


def markdown(df: DataFrame, most: int = 50) -> str:
    """A small result as a markdown table."""
    cells = [[str(c) for c in df.columns], ["---"] * len(df.columns), *[["" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|") for v in r] for r in df.limit(most).collect()]]
    return "\n".join(f"| {' | '.join(r)} |" for r in cells)


def confusion_text(cells: DataFrame, classes: list[str]) -> str:
    """A confusion table (true_class, predicted: indexes, n) as text, true classes down, zero cells kept."""
    n = {(r.true_class, r.predicted): r.n for r in cells.groupBy("true_class", "predicted").agg(F.sum("n").alias("n")).limit(len(classes) ** 2 + 1).collect()}
    rows = [["", *classes], *[[name, *[str(n.get((i, j), 0)) for j in range(len(classes))]] for i, name in enumerate(classes)]]
    width = max(len(x) for r in rows for x in r)
    return "\n".join("  ".join(x.rjust(width) for x in r) for r in rows)


def table_text(df: DataFrame, most: int = 50) -> str:
    """A small result as a fixed-width table."""
    rows = [list(map(str, df.columns)), *[["" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r] for r in df.limit(most).collect()]]
    widths = [max(map(len, c)) for c in zip(*rows, strict=True)]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)).rstrip() for r in rows)
