"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source gets the same expected number of copies; its whole part is given,
its fraction is a probability to round. Two documents at a time, mass (probability times size)
moves from one to the other in a random direction until one of them is 0 or 1; the sum of
probability times size stays, and so does each expectation. Documents are rounded in blocks
of bounded size; the one fraction that a block leaves goes up a tree of blocks until one is
left for each source, which is rounded on its own. So a source's words miss its target by at
most one document. All of it is DataFrame and SQL functions; random numbers are hashes of the
rows' values, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm import common

#: Documents to a block, on average.
BLOCK = 128
MOST_COPIES = 3
WEIGHTS = (1, 2, 3)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``sizes`` (source, source_size; one row a source) with weight, target (double) and rate (copies a document, or 0).

    Sources by code point, null last, take the weights in turn and share all words. A target
    stops at ``most`` times its source's size; what is over is shared again by weight. In closed
    form: in ascending order of limit by weight, a source is at its limit if the limit is below
    its share of what the sources before it leave. The table has a row a source, not a document.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    rows = sizes.withColumn("weight", F.get(F.array(*[F.lit(w) for w in weights]), (turn % len(weights)).cast("int")))
    rows = rows.withColumn("limit", (F.col("source_size") * most).cast("double"))
    over = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = over.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rows = rows.withColumns({"limit_before": F.coalesce(F.sum("limit").over(before), F.lit(0.0)), "weight_before": F.coalesce(F.sum("weight").over(before), F.lit(0)), "words": F.sum("source_size").over(everything), "weight_all": F.sum("weight").over(everything)})
    full = F.col("limit") * (F.col("weight_all") - F.col("weight_before")) <= (F.col("words") - F.col("limit_before")) * F.col("weight")
    rows = rows.withColumn("full", full)
    rows = rows.withColumns({"limit_full": F.coalesce(F.sum(F.when(F.col("full"), F.col("limit"))).over(everything), F.lit(0.0)), "weight_full": F.coalesce(F.sum(F.when(F.col("full"), F.col("weight"))).over(everything), F.lit(0))})
    share = F.try_divide((F.col("words") - F.col("limit_full")) * F.col("weight"), F.col("weight_all") - F.col("weight_full"))
    rows = rows.withColumn("target", F.when(F.col("full"), F.col("limit")).otherwise(share).cast("double"))
    rows = rows.withColumn("rate", F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0)))
    return rows.select("source", "source_size", "weight", "target", F.least("rate", F.lit(float(most))).alias("rate"))


#: One pivotal step, as SQL: s.held and x are fractions p of documents of size words; x.u is random.
STEP = """
aggregate(items, struct(cast(null as struct<row: {row}, size: bigint, p: double>) as held, cast(array() as array<struct<row: {row}, taken: int>>) as done),
  (s, x) -> if(s.held is null,
    struct(struct(x.row as row, x.size as size, x.p as p) as held, s.done as done),
    transform(transform(array(struct(
        least(1 - s.held.p, x.p * x.size / s.held.size) as up,
        least(s.held.p, (1 - x.p) * x.size / s.held.size) as down)),
      m -> if(x.u * (m.up + m.down) < m.down,
        struct(s.held.p + m.up as p, x.p - m.up * s.held.size / x.size as q),
        struct(s.held.p - m.down as p, x.p + m.down * s.held.size / x.size as q))),
      m -> case
        when least(m.p, 1 - m.p) < 1e-9 and least(m.q, 1 - m.q) < 1e-9 then
          struct(cast(null as struct<row: {row}, size: bigint, p: double>) as held, concat(s.done, array(struct(s.held.row as row, cast(round(m.p) as int) as taken), struct(x.row as row, cast(round(m.q) as int) as taken))) as done)
        when least(m.p, 1 - m.p) < least(m.q, 1 - m.q) then
          struct(struct(x.row as row, x.size as size, m.q as p) as held, concat(s.done, array(struct(s.held.row as row, cast(round(m.p) as int) as taken))) as done)
        else
          struct(struct(s.held.row as row, s.held.size as size, m.p as p) as held, concat(s.done, array(struct(x.row as row, cast(round(m.q) as int) as taken))) as done)
      end)[0]))
"""


def rounded(items: DataFrame, rows: int, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """Round fractions: ``items`` has source, row (struct), size (> 0) and p (0 < p < 1); returns source, row, taken (0 or 1).

    ``rows``: the most items that a source has; it sets the height of the tree.
    """
    kind = items.schema["row"].dataType.simpleString()
    out, level = [], 0
    while True:
        of = F.xxhash64("row", F.lit(seed), F.lit(level))
        blocks = -(-rows // block)
        each = items.withColumns({"u": F.pmod(of, F.lit(1 << 52)) / F.lit(float(1 << 52)), "block": F.pmod(F.xxhash64(of), F.greatest(F.ceil(F.col("n") / block), F.lit(1)))})
        each = each.groupBy("source", "block").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("order"), "u", "row", "size", "p"))).alias("items"))
        folded = common.saved(each.withColumn("s", F.expr(STEP.format(row=kind))).select("source", "n", "s.held", "s.done"))
        out.append(folded.select("source", F.explode("done").alias("d")).select("source", "d.row", "d.taken"))
        left = folded.where("held is not null").select("source", F.greatest(F.ceil(F.col("n") / block), F.lit(1)).alias("n"), "held.row", "held.size", "held.p")
        if blocks <= 1:
            last = F.pmod(F.xxhash64("row", F.lit(seed), F.lit(-1)), F.lit(1 << 52)) / F.lit(float(1 << 52))
            out.append(left.select("source", "row", (last < F.col("p")).cast("int").alias("taken")))
            break
        items, rows, level = left, blocks, level + 1
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


def decide(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", extra: tuple[str, ...] = (), seed: int = 0, weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK) -> DataFrame:
    """One row a document: key, source, ``extra`` columns, nth, size, source_size, target, copies, taken.

    Size is the number of words (a null text has none). ``nth`` numbers rows that agree in key,
    source, size and the extra columns, so repeated rows are decided one by one; a null key is an
    ordinary value. Documents without words get no copies. An empty table gives no rows.
    """
    size = F.regexp_count(common.text_or_empty(text), F.lit(common.WORD)).cast("long")
    names = [key, *extra]
    rows = docs.select(F.struct(*names).alias("of"), F.col(source).cast("string").alias("source"), size.alias("size"))
    rows = rows.groupBy("of", "source", "size").agg(F.count(F.lit(1)).cast("int").alias("n_equal"))
    rows = common.saved(rows.select("of", "source", "size", F.explode(F.sequence(F.lit(1), "n_equal")).alias("nth")))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    plan = common.saved(targets(sizes, weights).join(sizes.select(F.col("source").alias("s_"), "n"), F.col("source").eqNullSafe(F.col("s_"))).drop("s_").withColumnRenamed("source", "source_"))
    most = plan.agg(F.max("n")).first()[0] or 0
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("source_"))).drop("source_")
    whole = F.floor(F.col("rate") + 1e-12).cast("int")
    rows = rows.withColumns({"whole": F.when(F.col("size") > 0, whole).otherwise(0), "p": F.col("rate") - whole})
    items = rows.where("size > 0 and p > 1e-9").select("source", "n", F.struct("of", "size", "nth", "source_size", "target", "whole").alias("row"), "size", "p")
    fixed = rows.where("not (size > 0 and p > 1e-9)").select("source", F.struct("of", "size", "nth", "source_size", "target", "whole").alias("row"), F.lit(0).alias("taken"))
    done = fixed.unionByName(rounded(items, most, seed, block)) if most else fixed
    copies = F.col("row.whole") + F.col("taken")
    return done.select(*[F.col(f"row.of.{c}").alias(c) for c in names], "source", F.col("row.nth").alias("nth"), F.col("row.size").alias("size"), F.col("row.source_size").alias("source_size"), F.col("row.target").alias("target"), copies.alias("copies"), (copies * F.col("row.size")).alias("taken"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as its copies, with all its columns.

    Rows that agree in key, source and text are interchangeable: how many of them get how many
    copies comes as four counts, and a number within them says which. Numbering and join lie by
    the same digest, so the texts are shuffled once.
    """
    digest, nth, counts, made = (common.free_name(docs, x) for x in ("digest", "nth", "counts", "made"))
    marked = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    rows = docs.withColumn(digest, F.md5(F.concat(marked(key), F.lit("\0"), marked(source), F.lit("\0"), common.text_or_empty(text))))
    plan = decide(rows.select(*dict.fromkeys([key, source, text, digest])), key, text, source, (digest,), seed, **options)
    plan = plan.groupBy(F.col(digest).alias(made)).agg(F.array(*[F.count_if(F.col("copies") >= c) for c in range(1, MOST_COPIES + 1)]).alias(counts))
    rows = rows.withColumn(nth, F.row_number().over(Window.partitionBy(digest).orderBy(F.lit(1))))
    rows = rows.join(plan, rows[digest] == plan[made])
    copies = F.size(F.filter(F.col(counts), lambda c: c >= F.col(nth)))
    return rows.withColumn(made, F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)))).select(*[common.quoted(c) for c in docs.columns])
