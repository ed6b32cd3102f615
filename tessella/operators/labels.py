"""Label domains, patient support, validation and coverage checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.frames import settled
from tessella.functions.hashing import hash_dict

#: Frozen class order: an index is a contract, never the alphabet.
CLASSES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def normalize_ternary(value: Column) -> Column:
    """1, 0, -1 or NULL (blank or NaN); anything else raises."""
    n = F.nullif(F.trim(value.cast("string")), F.lit("")).try_cast("double")
    blank = value.isNull() | (F.trim(value.cast("string")) == "") | F.isnan(n)
    bad = F.raise_error(F.concat(F.lit("label outside 1, 0, -1, blank: "), value.cast("string")))
    return F.when(blank, None).when(n.isin(1.0, 0.0, -1.0), n.cast("tinyint")).otherwise(bad.cast("tinyint"))


def ternary_arrays(df: DataFrame, raw: str = "raw") -> DataFrame:
    """raw (-2 for blank), target (positive or not) and mask (1 and 0 only)."""
    return df.withColumns({"target": F.coalesce((F.col(raw) == 1).cast("float"), F.lit(0.0).cast("float")), "mask": F.coalesce(F.col(raw).isin(0, 1), F.lit(False)), "raw": F.coalesce(F.col(raw), F.lit(-2)).cast("tinyint")})


def invalid_rows(df: DataFrame, column: str, domain: list) -> DataFrame:
    """Rows whose value is neither NULL nor in the domain."""
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(domain))


def class_index(value: Column, classes: tuple[str, ...] = CLASSES) -> Column:
    """Index of a class code after trim (case is ignored); an unknown one raises."""
    at = F.array_position(F.array(*[F.lit(c.lower()) for c in classes]), F.lower(F.trim(value)))
    return F.when(at > 0, (at - 1).cast("int")).otherwise(F.raise_error(F.concat(F.lit("unknown class: "), F.coalesce(value, F.lit("null")))).cast("int"))


def one_hot(index: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: (k == index).cast("int"))


def raw_vector(names: Column, values: Column) -> Column:
    """A map of one label to its raw value, NULL kept."""
    return F.create_map(names, values)


def positives(vector: Column, order: list[str]) -> Column:
    """Names of a map's positive labels, in a fixed order."""
    return F.filter(F.array(*[F.lit(x) for x in order]), lambda x: F.coalesce(F.element_at(vector, x), F.lit(0)) == 1)


def stratum(names: Column) -> Column:
    return F.coalesce(F.nullif(F.array_join(F.array_sort(names), "|"), F.lit("")), F.lit("__no_finding__"))


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` if it has the columns; ValueError before any job otherwise."""
    lacking = [c for c in columns if c not in df.columns]
    if lacking:
        raise ValueError(f"missing columns: {lacking}")
    return df


def require_empty(bad: DataFrame, what: str, shown: int = 5) -> None:
    """ValueError with the first rows if there are any; one job with a limit."""
    rows = bad.limit(shown).collect()
    if rows:
        raise ValueError(f"{what}: {[r.asDict() for r in rows]}")


class Refused(ValueError):
    """A refusal with all its reasons: ``faults`` has a row for each, and doesn't depend on what was refused."""

    def __init__(self, what: str, faults: DataFrame):
        super().__init__(what)
        self.faults = faults


def refuse(faults: DataFrame, what: str, shown: int = 5) -> None:
    """Refused if there are any faults, with all of them; the message names the first."""
    held = settled(faults)
    rows = held.limit(shown).collect()
    if rows:
        raise Refused(f"{what}: {[r.asDict() for r in rows]}", held)


def key_faults(df: DataFrame, key: str, expected: DataFrame | None = None) -> DataFrame:
    """(key, fault, n) of keys that are missing (null) or repeated; against ``expected``, also those unexpected or absent. n: rows of the key."""
    held = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    wrong = [F.when(F.col(key).isNull(), "missing"), F.when(F.col(key).isNotNull() & (F.col("n") > 1), "repeated")]
    if expected is not None:
        known = expected.where(F.col(key).isNotNull()).select(key).distinct().withColumn("known_", F.lit(True))
        held = held.join(known, key, "full")
        wrong += [F.when(F.col(key).isNotNull() & F.col("known_").isNull(), "unexpected"), F.when(F.col("n").isNull(), "absent")]
    return held.select(key, F.explode(F.filter(F.array(*wrong), lambda x: x.isNotNull())).alias("fault"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def changed(frozen: DataFrame, found: DataFrame, key: str, fields: list[str] | None = None) -> DataFrame:
    """(key, field, frozen, found), values as text, of each field of ``found`` that another value is frozen for; a null is a value, new keys have none."""
    fields = fields or [c for c in found.columns if c != key]
    side = lambda df, name: df.select(key, F.struct(*[F.col(c).cast("string").alias(c) for c in fields]).alias(name))
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col("a_")[c].alias("frozen"), F.col("b_")[c].alias("found")) for c in fields])
    met = side(found, "b_").join(side(frozen, "a_"), key)
    return met.select(key, F.explode(F.filter(cells, lambda x: ~x["frozen"].eqNullSafe(x["found"]))).alias("c_")).select(key, "c_.*")


def duplicate_keys(df: DataFrame, key: str | list[str]) -> DataFrame:
    keys = [key] if isinstance(key, str) else key
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def metadata_faults(df: DataFrame, key: str, group: str, by: str, classes: tuple[str, ...] = CLASSES) -> DataFrame:
    """(key, fault) of rows without a group, or whose class isn't one of ``classes`` after trim and whatever the case; a missing column raises."""
    require(df, [key, group, by])
    code = F.lower(F.trim(by))
    faults = F.array(F.when(F.col(group).isNull(), "no_group"), F.when(~F.coalesce(code.isin(*[c.lower() for c in classes]), F.lit(False)), "unknown_class"))
    return df.select(key, F.explode(F.filter(faults, lambda x: x.isNotNull())).alias("fault"))


def source_faults(df: DataFrame, path: str, labels: list[str], pattern: str) -> DataFrame:
    """(path, fault) of source rows: blank path, path that comes twice, path without a patient id, label outside 1, 0, -1 and blank; missing columns raise."""
    require(df, [path, *labels])
    blank = F.trim(F.coalesce(F.col(path), F.lit(""))) == ""
    outside = [F.coalesce(~F.col(c).try_cast("double").isin(1.0, 0.0, -1.0) & ~F.isnan(F.col(c).try_cast("double")), F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "") for c in labels]
    faults = F.array(F.when(blank, "blank_path"), F.when(~blank & ~F.col(path).rlike(pattern), "no_patient_id"), F.when(reduce(lambda a, b: a | b, outside), "label_domain"))
    rows = df.select(F.col(path).alias("path"), F.explode(F.filter(faults, lambda x: x.isNotNull())).alias("fault"))
    twice = duplicate_keys(df.where(~blank), path).select(F.col(path).alias("path"), F.lit("repeated_path").alias("fault"))
    return rows.unionByName(twice)


def schema_hash(df: DataFrame) -> str:
    """Hash of column names, in order, and their types."""
    return hash_dict({"columns": df.columns, "types": dict(df.dtypes)})


def known_files(df: DataFrame, files: DataFrame, name: str) -> DataFrame:
    """Rows whose file is there (files: name)."""
    return df.join(files.select("name").distinct(), df[name] == F.col("name"), "left_semi")


def candidates(df: DataFrame, columns: list[str], key: str = "image_id", most: int | None = None) -> DataFrame:
    """Candidate rows of a reader: required columns and distinct keys or ValueError; the first ``most`` by key where given."""
    require(df, columns)
    require_empty(duplicate_keys(df, key), f"repeated {key}")
    rows = df.select(*columns)
    return rows if most is None else rows.orderBy(key).limit(most)


def patient_support(df: DataFrame, patient: str = "patient_id", label: str = "label", raw: str = "raw") -> DataFrame:
    """Patients and rows for and against each label: any positive wins, else any 0, else masked."""
    each = df.groupBy(label, patient).agg(F.max((F.col(raw) == 1).cast("int")).alias("p"), F.max((F.col(raw) == 0).cast("int")).alias("q"), F.count_if(F.col(raw) == 1).alias("rp"), F.count_if(F.col(raw) == 0).alias("rq"))
    p, q = F.coalesce("p", F.lit(0)) == 1, F.coalesce("q", F.lit(0)) == 1
    return each.groupBy(label).agg(F.count_if(p).alias("positive_patients"), F.count_if(~p & q).alias("negative_patients"), F.count_if(~p & ~q).alias("masked_patients"), F.sum("rp").alias("positive_rows"), F.sum("rq").alias("negative_rows"))


def group_support(df: DataFrame, group: str, by: str) -> DataFrame:
    """Groups with and without each class, and rows."""
    total = df.agg(F.count_distinct(group).alias("all_"))
    each = df.groupBy(by).agg(F.count_distinct(group).alias("positive_groups"), F.count(F.lit(1)).alias("n_rows"))
    return each.crossJoin(F.broadcast(total)).select(by, "positive_groups", (F.col("all_") - F.col("positive_groups")).alias("negative_groups"), "n_rows")


def support_failures(support: DataFrame, least_positive: int, least_negative: int, positive: str = "positive_patients", negative: str = "negative_patients") -> DataFrame:
    """``support`` with passed and every failed rule."""
    failures = F.filter(F.array(F.when(F.col(positive) < least_positive, "positives"), F.when(F.col(negative) < least_negative, "negatives")), lambda x: x.isNotNull())
    return support.withColumns({"passed": F.size(failures) == 0, "failures": F.array_join(failures, ",")})


def counts_over(df: DataFrame, dimension: DataFrame, by: str) -> DataFrame:
    """Counts and shares of all values of a dimension, zeros kept."""
    rows = dimension.select(by).join(df.groupBy(by).agg(F.count(F.lit(1)).alias("n")), by, "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))
    return rows.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("all_")))).select(by, "n", (F.col("n") / F.nullif("all_", F.lit(0))).alias("share"))


def prevalence(df: DataFrame, by: str = "label", raw: str = "raw") -> DataFrame:
    """Share of positive and of uncertain rows among all of the label."""
    return df.groupBy(by).agg(F.avg(F.coalesce((F.col(raw) == 1).cast("double"), F.lit(0.0))).alias("positive_rate"), F.avg(F.coalesce((F.col(raw) == -1).cast("double"), F.lit(0.0))).alias("uncertain_rate"))


def prevalence_deviation(subset: DataFrame, full: DataFrame, tolerance: float, by: str = "label") -> DataFrame:
    f = prevalence(full, by).select(by, F.col("positive_rate").alias("full_rate"))
    rows = f.join(prevalence(subset, by).select(by, F.col("positive_rate").alias("subset_rate")), by, "left")
    d = F.abs(F.col("full_rate") - F.coalesce("subset_rate", F.lit(0.0)))
    return rows.withColumns({"deviation": d, "within_tolerance": d <= tolerance})


def conflicting_groups(df: DataFrame, group: str, by: str) -> DataFrame:
    """Groups that come with several classes."""
    return df.groupBy(group).agg(F.count_distinct(by).alias("n_classes")).where("n_classes > 1")


def label_sets(df: DataFrame, unit: str, label: str) -> DataFrame:
    """The sorted distinct labels of each unit, joined by ``|``."""
    return df.groupBy(unit).agg(F.array_join(F.array_sort(F.collect_set(label)), "|").alias("labels"))


def cooccurrence(sets: DataFrame, unit: str, least: int) -> DataFrame:
    """Label sets with enough units."""
    return sets.groupBy("labels").agg(F.count_distinct(unit).alias("support")).where(F.col("support") >= least)


def class_mix(sets: DataFrame) -> DataFrame:
    n = F.when(F.coalesce(F.col("labels"), F.lit("")) == "", 0).otherwise(F.size(F.split("labels", r"\|")))
    return sets.agg(F.count(F.lit(1)).alias("total"), F.count_if(n == 0).alias("none"), F.count_if(n == 1).alias("single"), F.count_if(n > 1).alias("multi"), F.avg((n > 1).cast("double")).alias("multi_share"))


def coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Ids on one side only, on both, and doubly present, as one row."""
    a, b = left.groupBy(key).agg(F.count(F.lit(1)).alias("na")), right.groupBy(key).agg(F.count(F.lit(1)).alias("nb"))
    both = a.join(b, key, "full")
    return both.agg(F.count_if(F.col("nb").isNull()).alias("missing"), F.count_if(F.col("na").isNull()).alias("extra"), F.count_if(F.col("na").isNotNull() & F.col("nb").isNotNull()).alias("matched"), F.count_if((F.col("na") > 1) | (F.col("nb") > 1)).alias("doubled"))


def attach(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Left merge that refuses duplicate keys on the right and keys without a row there; the checks run first."""
    require_empty(duplicate_keys(right, key), f"duplicate {key}")
    require_empty(left.join(right, key, "left_anti").select(key), f"{key} without a row")
    return left.join(right.select(key, *columns), key, "left")


def merge_all(tables: list[DataFrame], key: str, how: str = "inner") -> DataFrame:
    """N-way merge on a key."""
    return reduce(lambda a, b: a.join(b, key, how), tables)


def one_value_per_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """For each column, how many distinct values it has and whether it is uniform (NULL is a value)."""
    counts = df.agg(*[(F.count_distinct(k) + F.max(F.col(k).isNull().cast("int"))).alias(k) for k in keys])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("bigint").alias("n_values")) for k in keys])).alias("e")).select("e.key", "e.n_values", (F.col("e.n_values") <= 1).alias("uniform"))
