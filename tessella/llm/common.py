"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable by the Python workers of any executor.

    Where the driver's PYTHONPATH already holds the package's root (or the session was
    submitted with it), nothing is sent; else the package's sources go out as one zip.
    """
    root = Path(__file__).resolve().parents[2]
    sc = spark.sparkContext
    known = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if str(root) in known or getattr(sc, "_tessella_shipped", False):
        return spark
    name = os.path.join(tempfile.mkdtemp(), "tessella_src.zip")  # the driver serves this file to executors
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted((root / "tessella").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(name)
    sc._tessella_shipped = True
    return spark


_HELD: dict = {}


def held(key, make):
    """What this worker keeps from task to task, made once; one thing at a time."""
    if key not in _HELD:
        let_go()
        _HELD[key] = make()
    return _HELD[key]


def let_go() -> None:
    """Workers outlive a stage: tasks of other operators drop what is held before they take memory of their own."""
    _HELD.clear()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where neither the session nor its context has one and all runs on one machine (tests), a
    local temporary folder is set; on a cluster that raises.
    """
    sc = spark.sparkContext
    set_dir = sc._jsc.sc().getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None) or getattr(sc, "_tessella_shared", None)
    if not folder:
        if not set_dir.isDefined() and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = set_dir.get() if set_dir.isDefined() else "file://" + tempfile.mkdtemp(prefix="tessella-")
        sc._tessella_shared = folder
    if not set_dir.isDefined():
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path below the shared folder, with the store's scheme, so that workers and Spark mean the same."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    whole = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path)
    return f"{whole.toString().rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder.

    Spark removes the files once the plan that reads them is garbage, where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint()


def kept(df: DataFrame, folder: str, name: str) -> DataFrame:
    """``df`` with its lineage cut by a Parquet table below ``folder``, of which later plans read only the columns they need."""
    df.write.parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


#: A key that holds more than one part in PARTS of all rows is hot.
PARTS = 4096


def hot_keys(counts: DataFrame, on: list[str], n: str = "n") -> DataFrame:
    """Of keys with their numbers of rows, the hot ones and by how many salts to deal each out: (*on, salts_).

    Fewer than PARTS keys can hold more than one part in PARTS each, and their salts add up to less
    than twice PARTS, so the table may be broadcast however large the input is.
    """
    total = counts.agg(F.sum(n)).first()[0] or 0
    hot = counts.where(F.col(n) * PARTS > F.lit(total)).select(*on, F.ceil(F.col(n) * PARTS / F.lit(max(total, 1))).alias("salts_"))
    return saved(hot)


def even_join(rows: DataFrame, side: DataFrame, on: list[str], hot: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``side`` on columns of equal names; rows of hot keys are dealt out by salts, for each of which ``side``'s are repeated.

    ``how``: inner, left or left_semi. Null keys fit nothing.
    """
    salt, names = "salt_", [*rows.columns, *([] if how == "left_semi" else [c for c in side.columns if c not in on])]
    while salt in (taken := {c.lower() for c in rows.columns + side.columns}) or "salts" + salt in taken:
        salt += "_"
    many, nth = hot.withColumnRenamed("salts_", "salts" + salt), F.monotonically_increasing_id()
    rows = rows.join(F.broadcast(many), on, "left").withColumn(salt, F.coalesce(F.pmod(nth, "salts" + salt), F.lit(0).cast("long"))).drop("salts" + salt)
    side = side.join(F.broadcast(many), on, "left").withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts" + salt, F.lit(1).cast("long")) - 1))).drop("salts" + salt)
    return rows.join(side, [*on, salt], how).select(*[quoted(c) for c in names])


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def quoted(name: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def as_long(name: str):
    return F.col(name).cast(LongType())
