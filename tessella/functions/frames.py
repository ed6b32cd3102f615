"""Ranks and quantiles of whole tables without a task that holds all rows."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def settled(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in ``spark.checkpoint.dir``.

    Only on one machine may the setting be absent; a temporary folder is set then.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tessella-"))
    return df.checkpoint()


def numbered(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """``df`` with each row's number, from 0, as last column, in an order that must have no ties.

    Rows are dealt out by ranges of the order and numbered within them; a row a range, with the
    number of rows before it, is broadcast.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = settled(rows.withColumns({"part_": F.spark_partition_id(), "at_": F.monotonically_increasing_id()}))
    sizes = rows.groupBy("part_").agg(F.count(F.lit(1)).alias("size_"))
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("part_", F.coalesce(F.sum("size_").over(before), F.lit(0)).alias("before_"))
    number = F.col("before_") + F.col("at_").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(F.broadcast(sizes), "part_").select(*[c for c in df.columns if c != name], number.alias(name))


def ranged(df: DataFrame, by: list[str], order: list[str | Column], parts: int | None = None) -> DataFrame:
    """``df`` dealt out by ranges of group and order, checkpointed, with the range's number as ``part_``: a group of any size lies in as many as it needs."""
    keys = [*[F.col(c).asc_nulls_first() for c in by], *order]
    rows = df.repartitionByRange(parts, *keys) if parts else df.repartitionByRange(*keys)
    return settled(rows.withColumn("part_", F.spark_partition_id()))


#: Rows of a group that a window may hold in a task.
ROWS = 1 << 20


def largest(df: DataFrame, by: list[str]) -> int:
    """The rows of the largest group."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_")).agg(F.max("n_")).first()[0] or 0


def along(rows: DataFrame, group, order: list[str | Column], values: list[str], fold: dict) -> DataFrame:
    """Values folded along a window's order (``scanned``'s names): of the whole, up to the row, or from it on."""
    upto = group.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"w{c}": fold[c[0]](c).over(group if c[0] == "t" else upto) for c in values if c[0] != "l"} | ({"at_": F.row_number().over(group.orderBy(*order))} if any(c[0] == "l" for c in values) else {}))
    # backwards, as frames that end with the group are folded anew for each row
    on = group.orderBy(F.desc("at_")).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({f"w{c}": F.min(c).over(on) for c in values if c[0] == "l"})


def scanned(df: DataFrame, by: list[str], order: list[str | Column], rank: str | None = None, sums: dict[str, str | Column] | None = None, totals: dict[str, str | Column] | None = None, highest: dict[str, str | Column] | None = None, lowest_on: dict[str, str | Column] | None = None, parts: int | None = None, most: int | None = None) -> DataFrame:
    """``df`` with values taken along the order of each group, however large it is: a prefix scan over ranges.

    ``rank``: the row's number, from 1; ``sums``: of what comes up to the row; ``totals``: of the whole
    group; ``highest``: up to the row; ``lowest_on``: from the row to the end. Nulls add nothing. Rows
    that the order doesn't tell apart are taken in any order. Values are scanned within ranges; what
    the ranges before (or behind) hold of the same group is added. A range has one group at most that
    began before it and one that goes on behind it, so what is broadcast is two rows a range. Where no
    group has more than ROWS rows, each is a window's; ``parts``: the number of ranges, whatever the sizes;
    ``most``: a bound on the rows of a group, where one is known, so that ``df`` isn't computed to count them.
    """
    sums, totals, highest, lowest_on = dict(sums or {}), totals or {}, highest or {}, lowest_on or {}
    if rank:
        sums[rank] = F.lit(1).cast("long")
    kinds = {"s": sums, "t": totals, "h": highest, "l": lowest_on}
    values = {f"{k}_{n}_": (F.col(v) if isinstance(v, str) else v) for k, named in kinds.items() for n, v in named.items()}
    fold = {"s": F.sum, "t": F.sum, "h": F.max, "l": F.min}
    named = [n for names in kinds.values() for n in names]
    if not parts and most is None:
        most = largest(df, by)
    if not parts and most <= ROWS:
        rows = along(df.withColumns(values), Window.partitionBy(*by), order, list(values), fold)
        return rows.select(*[c for c in df.columns if c not in named], *[F.col(f"w{k}_{n}_").alias(n) for k, names in kinds.items() for n in names])
    rows = ranged(df.withColumns(values), by, order, parts)
    group = Window.partitionBy("part_", *by)
    held = rows.groupBy("part_", *by).agg(*[fold[c[0]](c).alias(c) for c in values])
    whole = Window.partitionBy(*by)
    before, behind = (whole.orderBy(x).rowsBetween(Window.unboundedPreceding, -1) for x in ("part_", F.desc("part_")))
    across = {c: fold[c[0]](c).over({"t": whole, "l": behind}.get(c[0], before)).alias(f"o{c}") for c in values}
    ends = held.withColumn("spans_", F.count(F.lit(1)).over(whole)).select("spans_", F.col("part_").alias("p_"), *[F.col(c).alias(f"g{k}_") for k, c in enumerate(by)], *across.values()).where("spans_ > 1").drop("spans_")
    same = F.col("part_") == F.col("p_")
    for k, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"g{k}_"))
    rows = along(rows, group, order, list(values), fold).join(F.broadcast(ends), same, "left")
    joined = {"s": lambda w, o: F.coalesce(w + o, w, o), "t": lambda w, o: F.coalesce(o, w), "h": F.greatest, "l": F.least}
    out = [joined[k](F.col(f"w{k}_{n}_"), F.col(f"o{k}_{n}_")).alias(n) for k, names in kinds.items() for n in names]
    return rows.select(*[c for c in df.columns if c not in named], *out)


#: Rows (group and quantile) that are broadcast to find quantiles.
FEW = 100_000


def quantiles(df: DataFrame, value: str | Column, qs: list[float], by: list[str] = (), accuracy: int = 10_000) -> DataFrame:
    """Exact linear quantiles: (*by, q, v); no row for a group without values, one with a null for no rows without ``by``.

    A sketch of bounded size gives two values around each quantile; then rows below and above them are
    counted, those between counted by value, and the rank found among these: about 4 in
    ``accuracy`` of a group's distinct values meet in one task.
    """
    near = 2 / accuracy
    rows = df.select(*by, (F.col(value) if isinstance(value, str) else value).cast("double").alias("v")).where("v is not null")
    approx = lambda shift: F.percentile_approx("v", [min(1.0, max(0.0, q + shift)) for q in qs], accuracy)
    ends = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), approx(-near).alias("low"), approx(near).alias("high"))
    zipped = F.explode(F.arrays_zip("low", "high", F.array(*[F.lit(float(q)) for q in qs]).alias("q")))
    ends = ends.select(*by, "n", zipped.alias("z")).select(*by, "n", "z.low", "z.high", "z.q")
    if by:  # few groups are broadcast, so that a group's rows don't meet in a task
        ends = settled(ends)
        met = rows.join(F.broadcast(ends) if ends.count() <= FEW else ends, list(by))
    else:
        met = rows.crossJoin(F.broadcast(ends))  # a row a quantile
    side = F.when(F.col("v") < F.col("low"), 0).when(F.col("v") <= F.col("high"), 1).otherwise(2)
    met = met.groupBy(*by, "q", "n", side.alias("side"), F.when(side == 1, F.col("v")).alias("x")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
    upto = Window.partitionBy(*by, "q").orderBy("side", "x")
    met = met.withColumns({"upto": F.sum("c").over(upto), "place": F.col("q") * (F.col("n") - 1)})

    def at(rank: Column) -> Column:
        """The value of a rank; of the rows on either side of the middle, only the nearest is known, and needed."""
        first, last = F.col("upto") - F.col("c"), F.col("upto") - 1
        near = F.when(F.col("side") == 1, F.col("x")).when((F.col("side") == 0) & (rank == last), F.col("most")).when((F.col("side") == 2) & (rank == first), F.col("least"))
        return F.max(F.when((first <= rank) & (rank <= last), near))

    got = met.groupBy(*by, "q").agg(at(F.floor("place")).alias("a"), at(F.ceil("place")).alias("b"), (F.first("place") - F.floor(F.first("place"))).alias("part"))
    missed = F.raise_error(F.lit("a quantile lies outside its sketch's error"))
    got = got.select(*by, "q", F.when(F.col("a").isNull() | F.col("b").isNull(), missed.cast("double")).when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") * (1 - F.col("part")) + F.col("b") * F.col("part")).alias("v"))
    if by:
        return got
    all_qs = df.sparkSession.createDataFrame([(float(q),) for q in qs], "q double")
    return all_qs.join(got, "q", "left")


def quantile_row(df: DataFrame, wanted: dict[str, tuple[str | Column, float]]) -> DataFrame:
    """One row with a column for each name: the quantile of (value, q)."""
    stacked = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), (F.col(v) if isinstance(v, str) else v).cast("double").alias("x")) for n, (v, _) in wanted.items()]))
    rows = df.select(stacked.alias("s")).select("s.name", "s.x")
    levels = sorted({q for _, q in wanted.values()})
    got = quantiles(rows, "x", levels, ["name"])
    return got.agg(*[F.max(F.when((F.col("name") == n) & (F.col("q") == q), F.col("v"))).alias(n) for n, (_, q) in wanted.items()])
