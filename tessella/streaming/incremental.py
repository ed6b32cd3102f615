"""Incremental processing: finished keys are skipped, results are appended.

The domain needs no event time; ``follow`` is the same append as a Structured Streaming query,
with late and repeated keys dropped within a watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.sources import commits


def pending(planned: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Planned rows whose key isn't done."""
    return planned.join(done.select(key).distinct(), key, "left_anti")


def resume(spark: SparkSession, planned: DataFrame, log: str, key: str, work: Callable[[DataFrame], DataFrame]) -> int:
    """Work on what the log lacks and append the results; returns how many rows it has then.

    Several at once are safe: who commits second works again on what the log lacks then.
    """
    commits.commit(spark, log, lambda done: work(planned if done is None else pending(planned, done, key)), replaces=False)
    return commits.table(spark, log).count()


def follow(stream: DataFrame, key: str, at: str, log: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], delay: str = "1 hour"):
    """A running query that appends the work on each new key once; the log is read by ``commits.table``.

    A batch is committed under the checkpoint and its number, so one that is run again after a
    failure, wherever it failed, isn't appended again.
    """

    def batch(df: DataFrame, number: int) -> None:
        name = f"{checkpoint}:{number}"
        if any(r["name"] == name for r in commits.history(df.sparkSession, log)):
            df.write.format("noop").mode("overwrite").save()  # the keys seen are state of the query, which must go on
            return
        commits.commit(df.sparkSession, log, lambda _: work(df), replaces=False, name=name)

    once = stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])
    return once.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
