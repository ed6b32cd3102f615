"""Sources with declared schemas and checks; sinks that publish whole or not at all."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessella.operators.labels import changed, counts_over, duplicate_keys, key_faults, refuse, require, require_empty
from tessella.sources import commits


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def read_csv(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None) -> DataFrame:
    """CSV with a header and a declared schema; only the wanted columns are parsed."""
    df = spark.read.schema(schema).csv(path, header=True, enforceSchema=False)
    return df.select(*columns) if columns else df


def read_parquet(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return require(spark.read.parquet(path), columns)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped, broken ones fail the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_keyed_jsonl(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """JSON lines whose key is neither missing nor repeated; else Refused with all keys at fault."""
    df = read_jsonl(spark, path, schema)
    refuse(key_faults(df, key), f"{path}: {key}")
    return df


def read_reports(spark: SparkSession, glob: str, up: int = 0) -> DataFrame:
    """(name, record) of small JSON files, a row a file read whole; ``up``: so many folders up is what names it."""
    files = spark.read.text(glob, wholetext=True)
    return files.select(F.element_at(F.split("_metadata.file_path", "/"), -1 - up).alias("name"), F.col("value").alias("record"))


def read_tagged(spark: SparkSession, glob: str, pattern: str, names: list[str]) -> DataFrame:
    """Parquet files of a glob with the parts of their names that a pattern captures; a name that doesn't match raises."""
    df = spark.read.parquet(glob)
    file = F.col("_metadata.file_name")
    bad = F.raise_error(F.concat(F.lit("file name: "), file))
    got = {n: F.when(file.rlike(pattern), F.regexp_extract(file, pattern, k + 1)).otherwise(bad.cast("string")) for k, n in enumerate(names)}
    return df.withColumns(got)


def missing_cells(df: DataFrame, axes: dict[str, list]) -> DataFrame:
    """Cells of a grid without a row."""
    grid = df.sparkSession.range(1).select()
    for name, values in axes.items():
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return grid.join(df.select(*axes).distinct(), list(axes), "left_anti")


def read_boxes(spark: SparkSession, path: str) -> DataFrame:
    """Content boxes: one per image, each half open and inside the unit square."""
    df = read_csv(spark, path, "image_id string, source_width int, source_height int, x0 double, y0 double, x1 double, y1 double")
    require_empty(duplicate_keys(df, "image_id"), "repeated image_id")
    require_empty(df.where("not (0 <= x0 and x0 < x1 and x1 <= 1 and 0 <= y0 and y0 < y1 and y1 <= 1) or coalesce(x0, y0, x1, y1) is null"), "invalid box")
    return df


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Image files of the kinds that Spark's image source reads (PNG, JPEG, GIF, BMP), a row a file: origin, height, width, nChannels (-1 for what it can't read), mode, data; see signals.source_images."""
    return spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in ``spark.checkpoint.dir``, which driver and executors share; on one machine without the setting, in a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        sc = spark.sparkContext
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='tessella-')}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def publish(df: DataFrame, path: str, form: str = "parquet", check: Callable[[DataFrame], None] | None = None, key: str | None = None, once: bool = True, sort: list[str] = (), provenance: dict | None = None, expected: DataFrame | None = None) -> None:
    """Write to a staging folder, read it back, check it, then rename; nothing is seen under ``path`` before.

    Checks the schema, the number of rows (counted while they are written, so the plan runs once)
    and (``key``) that keys are given, distinct and, with ``expected``, just those of that table (Refused, with
    all keys at fault); then calls ``check``. ``once`` refuses to replace what is
    there; else the old table moves aside until the new one has its name; if that fails it moves back, and if
    the process dies in between, the next ``publish`` or ``recover`` moves it back. (``commits.commit`` has no such gap.)
    ``sort`` orders rows within and across files. ``provenance`` lies, with the number of rows, inside the
    folder, so it comes and goes with its data.
    """
    spark = df.sparkSession
    recover(spark, path)
    if once and exists(spark, path):
        raise FileExistsError(path)
    base, tag = path.rstrip("/"), uuid.uuid4().hex
    staging, aside = f"{base}.staging-{tag}", f"{base}.old-{tag}"
    fs, stage = _fs(spark, staging)
    to = lambda p: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
    try:
        seen = Observation()
        rows = df.repartitionByRange(*sort).sortWithinPartitions(*sort) if sort else df
        writer = rows.observe(seen, F.count(F.lit(1)).alias("n")).write
        getattr(writer.option("header", True) if form == "csv" else writer, form)(staging)
        back = getattr(spark.read.schema(df.schema).option("header", True), form)(staging)
        if (n := back.count()) != seen.get["n"]:
            raise ValueError(f"{n} rows written, {seen.get['n']} expected")
        if key:
            refuse(key_faults(back, key, expected), f"{path}: {key}")
        if check:
            check(back)
        if provenance is not None:
            write_frozen_json(spark, provenance | {"n_rows": n}, f"{staging}/{PROVENANCE}")
        if not once and fs.exists(to(path)) and not fs.rename(to(path), to(aside)):
            raise OSError(f"cannot move {path}")
        if not fs.rename(stage, to(path)):
            raise OSError(f"cannot publish {path}")
        fs.delete(to(aside), True)
    finally:
        fs.delete(stage, True)
        recover(spark, path)


#: A table's provenance inside its folder; Spark's readers pass over such names.
PROVENANCE = "_provenance"


def provenance_of(spark: SparkSession, path: str, required: dict | None = None) -> dict:
    return read_json(spark, f"{path.rstrip('/')}/{PROVENANCE}", required)


def recover(spark: SparkSession, path: str) -> None:
    """Give a table back its name that a dead ``publish`` had moved aside; nothing else."""
    fs, p = _fs(spark, path.rstrip("/"))
    if fs.exists(p) or not fs.exists(p.getParent()):
        return
    for s in fs.listStatus(p.getParent()):
        if s.getPath().getName().startswith(f"{p.getName()}.old-"):
            fs.rename(s.getPath(), p)
            return


def write_frozen_json(spark: SparkSession, value: dict, path: str) -> None:
    """A small report with sorted keys, written once; another with other contents is refused."""
    text = json.dumps(value, sort_keys=True)
    if exists(spark, path):
        if read_json(spark, path) != value:
            raise FileExistsError(path)
        return
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)


def freeze(spark: SparkSession, path: str, rows: DataFrame, key: str) -> DataFrame:
    """A table of values written once a key: new keys are added, the same values again change nothing, another value refuses all of ``rows``.

    Refused has each such key with the field, its frozen and its found value. Writers at one time agree (see ``commits``).
    """

    def make(old: DataFrame | None) -> DataFrame:
        if old is None:
            return rows
        refuse(changed(old, rows, key), f"{path}: frozen")
        return rows.join(old, key, "left_anti").select(*rows.columns)

    commits.commit(spark, path, make, replaces=False, key=key)
    return commits.table(spark, path)


#: Reports are read whole; larger files are refused.
MOST_BYTES = 16 << 20


def read_json(spark: SparkSession, path: str, required: dict | None = None) -> dict:
    """A small report; ValueError where a required field has another value, or where it is too large to be one."""
    fs, p = _fs(spark, path)
    if fs.getContentSummary(p).getLength() > MOST_BYTES:
        raise ValueError(f"{path} is larger than a report")
    value = json.loads("\n".join(r.value for r in spark.read.text(path).collect()))
    wrong = {k: value.get(k) for k, v in (required or {}).items() if value.get(k) != v}
    if wrong:
        raise ValueError(f"{path}: unexpected {wrong}")
    return value


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


REGISTRY = "experiment_id string, parent_experiment_id string, at timestamp, stage string, config_hash string, status string, metrics string"


def upsert(spark: SparkSession, path: str, rows: DataFrame, key: str = "experiment_id") -> DataFrame:
    """Registry rows by key: new ones replace old ones, others stay; writers at one time all keep their rows (see ``commits``)."""
    commits.commit(spark, path, lambda old: rows if old is None else old.join(rows, key, "left_anti").unionByName(rows), key=key)
    return commits.table(spark, path)


@contextmanager
def experiment(spark: SparkSession, path: str, run: str, stage: str, config_hash: str, parent: str | None = None) -> Iterator[dict]:
    """A run's row in the registry: running at first, then completed or failed, with what the body puts in the yielded dict as metrics."""

    def put(status: str, metrics: dict) -> None:
        row = spark.createDataFrame([(run, parent, stage, config_hash, status, json.dumps(metrics, sort_keys=True))], "experiment_id string, parent_experiment_id string, stage string, config_hash string, status string, metrics string")
        upsert(spark, path, row.select("experiment_id", "parent_experiment_id", F.current_timestamp().alias("at"), "stage", "config_hash", "status", "metrics"))

    metrics: dict = {}
    put("running", metrics)
    try:
        yield metrics
    except BaseException:
        put("failed", metrics)
        raise
    put("completed", metrics)


def write_candidates(candidates: DataFrame, boxes: DataFrame, classes: DataFrame, folder: str, key: str = "image_id", by: str = "dx") -> DataFrame:
    """Publish the accepted candidates and their content boxes (every one must have its own) and return counts of all classes, zeros kept."""
    accepted = candidates.where("accepted").drop("accepted")
    require_empty(duplicate_keys(boxes, key), f"repeated {key}")
    require_empty(accepted.join(boxes, key, "left_anti").select(key), "candidates without a content box")
    publish(accepted, f"{folder}/candidates", key=key)
    publish(boxes.join(accepted, key, "left_semi"), f"{folder}/boxes", key=key)
    return counts_over(accepted, classes, by)


def hash_files(spark: SparkSession, glob: str, up: int = 0) -> DataFrame:
    """(name, bytes, sha256) of files, hashed where they are read; a file is one task's value. ``up``: so many folders up is what names it."""
    files = spark.read.format("binaryFile").load(glob)
    return files.select(F.element_at(F.split("path", "/"), -1 - up).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def folder_hash(files: DataFrame) -> DataFrame:
    """One row: the hash of a folder's file names and hashes, in order of the names."""
    lines = F.array_sort(F.collect_list(F.concat_ws(":", "name", "sha256")))
    return files.agg(F.sha2(F.array_join(lines, "\n"), 256).alias("sha256"), F.count(F.lit(1)).alias("n_files"))


def present_cells(spark: SparkSession, root: str, marker: str, pattern: str, names: list[str]) -> DataFrame:
    """The cells of a grid whose run folder below ``root`` holds the file ``marker``; the folder's name gives the cell by a pattern."""
    folder = F.element_at(F.split("path", "/"), -2)
    found = spark.read.format("binaryFile").load(f"{root}/*/{marker}").select(folder.alias("folder")).where(F.col("folder").rlike(pattern))
    return found.select(*[F.regexp_extract("folder", pattern, k + 1).alias(n) for k, n in enumerate(names)]).distinct()


def ancestors(registry: DataFrame, most: int = 50) -> DataFrame:
    """(experiment_id, ancestor, depth) over parent links; a cycle ends at ``most``."""
    parents = registry.where("parent_experiment_id is not null").select("experiment_id", F.col("parent_experiment_id").alias("parent"))
    step = parents.select("experiment_id", F.col("parent").alias("ancestor"), F.lit(1).alias("depth"))
    out = step
    for depth in range(2, most + 1):
        step = step.join(parents.select(F.col("experiment_id").alias("ancestor"), F.col("parent").alias("next")), "ancestor").select("experiment_id", F.col("next").alias("ancestor"), F.lit(depth).alias("depth"))
        if not step.limit(1).count():
            break
        out = out.unionByName(step)
    return out
