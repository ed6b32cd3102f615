"""Similarity of vectors with class constraints.

Pairs meet by class and cell of a pivot index, an equi-join key, in blocks of bounded size, as products
of matrices; of these only what is asked for becomes rows. Exact results are asked for, so nothing is
approximated: cells are passed over only where the triangle inequality rules them out. Where
vectors don't lie in clusters it seldom does, and work is the sum of squared class sizes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.frames import settled
from tessella.operators import pivots
from tessella.sources import io

EPSILON = 1e-8


def unit(v: Column) -> Column:
    """A vector over its norm (plus a small constant), in double."""
    d = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: x.cast("double") / (norm + EPSILON))


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def with_units(df: DataFrame, vector: str) -> DataFrame:
    """``df`` with the normalised vector in place; the norm is computed once a row."""
    d = df.withColumn(vector, F.transform(vector, lambda x: x.cast("double")))
    d = d.withColumn("norm_", F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x)) + EPSILON)
    return d.withColumn(vector, F.zip_with(vector, F.array_repeat("norm_", F.size(vector)), lambda x, n: x / n)).drop("norm_")


#: Vectors to either side of a block, on average: a vector is shuffled once for each block of the other side.
BLOCK = 8192
#: Similarities that a task holds at once.
STRIP = 1 << 21


def blocks(left: DataFrame, right: DataFrame, work, schema: str) -> DataFrame:
    """``work(a, b)`` over blocks of two tables (id, class_, v), so that each pair of one class meets in one block.

    A class is cut into blocks by hash; each block of one side meets each of the other. ``work`` gets
    two frames, ids in ``id`` and unit vectors, one a row, as a matrix. So a task holds two blocks,
    however large a class is, and pairs are never rows.
    """
    sizes = lambda df, n: df.groupBy("class_").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias(n))
    plan = sizes(left, "n_").join(sizes(right, "m_"), "class_")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    place = lambda n: F.pmod(F.xxhash64("id"), n)
    one = left.join(plan, "class_").select("id", "class_", "v", place("n_").alias("i"), every("m_").alias("j"))
    again = [F.col(c).alias(c) for c in ("id", "class_", "v")]  # the sides may be one table
    two = right.join(plan, "class_").select(*again, every("n_").alias("i"), place("m_").alias("j"))

    def matrix(frame: pd.DataFrame) -> np.ndarray:
        x = np.stack(frame["v"].to_numpy()).astype(np.float64)
        return x / (np.sqrt((x * x).sum(axis=1, keepdims=True)) + EPSILON)

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])
        return work(a, matrix(a), b, matrix(b))

    key = ["class_", "i", "j"]
    return one.groupBy(*key).cogroup(two.groupBy(*key)).applyInPandas(run, schema)


def strips(n: int, width: int) -> Iterator[slice]:
    """Rows of a block's product of ``n`` times ``width``, STRIP values at a time."""
    step = max(1, STRIP // max(width, 1))
    return (slice(at, at + step) for at in range(0, n, step))


NEAREST = "id long, top array<double>, n_duplicates long, n_peers long"


def nearest(left: DataFrame, right: DataFrame, k: int, duplicate: float, same: bool) -> DataFrame:
    """For each of ``left`` (id, class_, v): its k greatest similarities to those of its class in ``right``, and how many there are, in all and from ``duplicate`` on.

    ``same``: the sides are one table, and rows of equal id don't meet. Blocks return k values a row.
    """

    def work(a: pd.DataFrame, x: np.ndarray, b: pd.DataFrame, y: np.ndarray) -> pd.DataFrame:
        left, right, out, most = a["id"].to_numpy(), b["id"].to_numpy(), [], len(b)
        for at in strips(len(a), most):
            s, n_peers = x[at] @ y.T, np.full(len(left[at]), most)
            if same:
                own = left[at][:, None] == right[None, :]
                s[own] = -np.inf
                n_peers -= own.sum(axis=1)
            top = np.partition(s, most - k, axis=1)[:, -k:] if most > k else s
            top = [t[np.isfinite(t)] for t in -np.sort(-top, axis=1)]
            out.append(pd.DataFrame({"id": left[at], "top": top, "n_duplicates": (s >= duplicate).sum(axis=1), "n_peers": n_peers}))
        return pd.concat(out)

    known, laid = pivots.index(right)
    merged = lambda rows: rows.groupBy("id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("top")), asc=False), 1, k).alias("top"), F.sum("n_duplicates").alias("n_duplicates"), F.sum("n_peers").alias("n_peers"))
    if not known.pivots:
        return merged(blocks(left, right, work, NEAREST))
    # first the packs of the nearest cells; what they hold bounds how far the others can matter
    need, packs = k + same, {name: known.packs(name, BLOCK) for name in known.pivots}
    right = pivots.by_cell(settled(pivots.packed(laid, packs)))

    def first(i: pivots.Index, name: str, x: np.ndarray, _=None) -> np.ndarray:
        return pivots.any_of(i.first(name, x, need), packs[name])

    near = settled(merged(blocks(pivots.by_cell(pivots.visits(left, known, first)), right, work, NEAREST)))
    kth = F.when(F.size("top") >= k, F.element_at("top", k))
    left = left.join(near.select("id", F.least(kth, F.lit(duplicate)).alias("kth")), "id", "left").withColumn("kth", F.coalesce("kth", F.lit(-2.0)))

    def rest(i: pivots.Index, name: str, x: np.ndarray, kth: np.ndarray) -> np.ndarray:
        return pivots.any_of(i.bounds(name, x)[1] <= pivots.reach(kth)[:, None], packs[name]) & ~first(i, name, x)

    more = merged(near.unionByName(blocks(pivots.by_cell(pivots.visits(left, known, rest, "kth")), right, work, NEAREST)))
    # peers are counted by class: those passed over are peers too
    count = laid.groupBy("class_").agg(F.count(F.lit(1)).alias("n_peers"))
    own = left.select("id", "class_").join(count, "class_")
    if same:
        own = own.withColumn("n_peers", F.col("n_peers") - 1)
    return more.drop("n_peers").join(own.select("id", "n_peers"), "id")


def knn_scores(candidates: DataFrame, references: DataFrame, key: str, by: str, vector: str, k: int = 5, duplicate: float = 0.95, least_references: int = 25) -> DataFrame:
    """Mean, top, spread and gap of a candidate's k greatest similarities to references of its class, or to all where the class has too few.

    Novelty is the mean unless it is a near duplicate.
    """
    enough = references.groupBy(F.col(by).alias("class_")).agg(F.count(F.lit(1)).alias("n_")).where(F.col("n_") >= least_references)
    c = candidates.select(F.col(key).alias("id"), F.col(by).alias("class_"), F.col(vector).alias("v")).join(enough, "class_", "left")
    # classes as arrays: a class of its own, empty, stands for all references
    c = c.select("id", F.when(F.col("n_").isNotNull(), F.array("class_")).otherwise(F.array().cast(f"array<{candidates.schema[by].dataType.simpleString()}>")).alias("class_"), "v")
    r = references.select(F.monotonically_increasing_id().alias("id"), F.array(by).alias("class_"), F.col(vector).alias("v"))
    if not c.where("size(class_) = 0").isEmpty():
        r = r.unionByName(r.withColumn("class_", F.slice("class_", 1, 0)))
    top = nearest(c, r, k, duplicate, same=False).join(c.select("id", F.when(F.size("class_") > 0, "same_class").otherwise("all").alias("tier")), "id")
    return top_scores(top, key, duplicate).join(top.select(F.col("id").alias(key), F.col("n_peers").alias("n_references")), key)


def tiers(wanted: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """For each wanted label set (array), its tier and the reference sets it is compared with: (wanted, tier, refs; null refs for all).

    The first of these with enough references: equal sets, sets of Jaccard similarity 0.5 or more,
    sets that share a label; else all. ``sets``: labels, n. Distinct sets are paired by the labels
    they share, and equal ones also where empty.
    """
    s = sets.select(F.col("labels").alias("ref"), "n")
    shared = wanted.select("wanted", F.explode("wanted").alias("x")).join(s.select("ref", "n", F.explode("ref").alias("x")), "x").select("wanted", "ref", "n").distinct()
    pairs = shared.unionByName(wanted.join(s, F.col("wanted") == F.col("ref")).where("size(wanted) = 0"))
    pairs = pairs.withColumn("j", F.coalesce(F.size(F.array_intersect("wanted", "ref")) / F.nullif(F.size(F.array_union("wanted", "ref")), F.lit(0)), F.lit(1.0)))
    level = F.when(F.col("wanted") == F.col("ref"), 1).when(F.col("j") >= 0.5, 2).otherwise(3)
    pairs = pairs.withColumn("level", level)
    held = lambda k: F.sum(F.when(F.col("level") <= k, F.col("n")))
    first = F.when(held(1) >= least, 1).when(held(2) >= least, 2).when(held(3) >= least, 3)
    got = pairs.groupBy("wanted").agg(first.alias("tier"), F.collect_list(F.struct("level", "ref")).alias("refs"))
    refs = F.transform(F.filter("refs", lambda x: x["level"] <= F.col("tier")), lambda x: x["ref"])
    return wanted.join(got.where("tier is not null").select("wanted", "tier", refs.alias("refs")), "wanted", "left").withColumn("tier", F.coalesce("tier", F.lit(4)))


def tiered_scores(candidates: DataFrame, references: DataFrame, key: str, labels: str, vector: str, k: int = 5, duplicate: float = 0.95, collapsed: float = 0.1, least_references: int = 5) -> DataFrame:
    """``knn_scores`` for label sets (sorted arrays): references by tier (see ``tiers``), their number, and whether a near duplicate stands out from the other neighbours.

    Candidates whose label sets are compared with the same reference sets are a class, so references
    are repeated for each such choice, of which there are few, not for each label set of a candidate.
    """
    plan = settled(tiers(candidates.select(F.col(labels).alias("wanted")).distinct(), references.groupBy(F.col(labels).alias("labels")).agg(F.count(F.lit(1)).alias("n")), least_references))
    every = F.array().cast("array<array<string>>")
    plan = plan.withColumn("class_", F.when(F.col("tier") < 4, F.array_sort("refs")).otherwise(every))
    c = candidates.select(F.col(key).alias("id"), F.col(labels).alias("wanted"), F.col(vector).alias("v")).join(plan.select("wanted", "tier", "class_"), "wanted")
    c = c.select("id", "class_", "v", "tier")
    r = references.select(F.monotonically_increasing_id().alias("id"), F.col(labels).alias("ref"), F.col(vector).alias("v"))
    own = plan.where("tier < 4").select("class_").distinct().select("class_", F.explode("class_").alias("ref"))
    met = r.join(own, "ref").select("id", "class_", "v")
    if not plan.where("tier = 4").isEmpty():
        met = met.unionByName(r.select("id", every.alias("class_"), "v"))
    top = nearest(c.drop("tier"), met, k, duplicate, same=False).join(c.select("id", F.concat(F.lit("tier"), "tier").alias("tier")), "id")
    rows = top_scores(top, key, duplicate).join(top.select(F.col("id").alias(key), F.col("n_peers").alias("n_references")), key)
    gap = F.coalesce("top1_gap", F.lit(0.0))
    return rows.withColumns({"top1_gap": gap, "collapsed": F.col("is_near_duplicate") & (gap >= collapsed)})


def top_scores(top: DataFrame, key: str, duplicate: float) -> DataFrame:
    """Statistics of (id, tier, top), the greatest similarities in falling order."""
    first, n = F.get("top", F.lit(0)), F.size("top")
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(a), F.lit(0))
    rows = top.where(n > 0).select(F.col("id").alias(key), "tier", mean("top").alias("knn_mean"), first.alias("top1"), (first - F.get("top", n - 1)).alias("topk_spread"), (first - mean(F.slice("top", F.lit(2), n))).alias("top1_gap"), n.cast("long").alias("k_used"))
    twin = F.col("top1") >= duplicate
    return rows.withColumns({"is_near_duplicate": twin, "novelty": F.when(twin, 0.0).otherwise(F.col("knn_mean"))})


def distinctiveness(df: DataFrame, key: str, by: str, vector: str, k: int = 5, duplicate: float = 0.95) -> DataFrame:
    """1 minus the mean of the k greatest similarities to peers of the class, itself left out; NULL without peers."""
    rows = df.select(F.col(key).alias("id"), F.col(by).alias("class_"), F.col(vector).alias("v"))
    got = nearest(rows, rows, k, duplicate, same=True)
    mean = F.aggregate("top", F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size("top"), F.lit(0))
    got = got.select(F.col("id").alias(key), (1 - mean).alias("score"), F.get("top", F.lit(0)).alias("max_similarity"), "n_duplicates", "n_peers")
    return df.select(key, by).join(got, key, "left").withColumns({"is_undefined": F.col("score").isNull(), "n_duplicates": F.coalesce("n_duplicates", F.lit(0)), "n_peers": F.coalesce("n_peers", F.lit(0))})


def duplicate_edges(df: DataFrame, key: str, by: str, vector: str, limit: float) -> DataFrame:
    """Links (a, b) that connect all rows of a class whose similarity is ``limit`` or more, directly or by others: of each block a forest, not all pairs."""
    rows = df.select(F.col(key).alias("id"), F.col(by).alias("class_"), F.col(vector).alias("v"))

    def work(a: pd.DataFrame, x: np.ndarray, b: pd.DataFrame, y: np.ndarray) -> pd.DataFrame:
        left, right = a["id"].tolist(), b["id"].tolist()
        parent, out = {}, []

        def root(z: int) -> int:
            while (up := parent.setdefault(z, z)) != z:
                parent[z] = z = parent[up]
            return z

        for at in strips(len(left), len(right)):
            for own, hits in zip(left[at], x[at] @ y.T >= limit, strict=True):
                for j in np.flatnonzero(hits).tolist():
                    p, q = root(own), root(right[j])
                    if p != q:
                        parent[max(p, q)] = min(p, q)
                        out.append((own, right[j]))
        return pd.DataFrame(out, columns=["a", "b"])

    known, laid = pivots.index(rows)
    if not known.pivots:
        return blocks(rows, rows, work, "a long, b long")
    far = pivots.reach(limit)

    def later(i: pivots.Index, name: str, x: np.ndarray, _) -> np.ndarray:
        """Each pair meets in the later of its two cells."""
        d, b = i.bounds(name, x)
        return (b <= far) & (d.argmin(axis=1)[:, None] <= np.arange(d.shape[1]))

    return blocks(pivots.by_cell(pivots.visits(rows, known, later)), pivots.by_cell(settled(laid.select("id", "class_", "v", "cell"))), work, "a long, b long")


def clusters(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """Single-linkage clusters of two or more: (node, cluster), the cluster named by its least node.

    Large-star and small-star steps (Kiveris and others, 2014) hang neighbours on smaller ones until
    nothing changes. Rounds are kept as Parquet, not as checkpoints: these inherit their plan's estimated
    size, which the joins multiply, so that its digits grew fourfold a round until the driver had no memory.
    """
    spark = edges.sparkSession
    folder = io.scratch(spark, "clusters")

    def kept(df: DataFrame, k: int) -> DataFrame:
        df.write.parquet(f"{folder}/{k}")
        io.delete(spark, f"{folder}/{k - 1}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{k}")

    try:
        now = kept(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), 0)
        state = None
        for k in range(1, most_rounds + 1):
            both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
            large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
            least = large.groupBy("a").agg(F.min("b").alias("m"))
            small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
            now = kept(small.where("a <> b").distinct(), k)
            seen = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
            if seen == state:
                heads = now.select(F.col("b").alias("node"), F.col("b").alias("cluster")).distinct()
                return settled(now.select(F.col("a").alias("node"), F.col("b").alias("cluster")).unionByName(heads))
            state = seen
    finally:
        io.delete(spark, folder)
    raise RuntimeError("clusters did not settle")


def moments(df: DataFrame, vector: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean, covariance (sample) and count: each task adds up the products of its batches, the d x d tables of the tasks are added on the driver."""

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, ss = 0, 0.0, 0.0
        for frame in frames:
            if len(frame):
                x = np.stack(frame["v"].to_numpy()).astype(np.float64)
                n, s, ss = n + len(x), s + x.sum(axis=0), ss + x.T @ x
        if n:
            yield pd.DataFrame({"n": [n], "s": [s], "ss": [np.ravel(ss)]})

    rows = df.select(F.col(vector).alias("v")).mapInPandas(sums, "n long, s array<double>, ss array<double>")
    at = lambda c: F.posexplode(c).alias("k", "x")
    n = rows.agg(F.sum("n")).first()[0]
    total = lambda c: np.array([r.x for r in rows.select(at(c)).groupBy("k").agg(F.sum("x").alias("x")).orderBy("k").collect()])
    m = total("s") / n
    return m, (total("ss").reshape(len(m), len(m)) - n * np.outer(m, m)) / (n - 1), n


def frechet(a: DataFrame, b: DataFrame, vector: str) -> float:
    """Fréchet distance of two feature sets; the root of the product by a symmetric eigendecomposition."""
    (ma, ca, _), (mb, cb, _) = moments(a, vector), moments(b, vector)
    w, q = np.linalg.eigh(ca)
    root = (q * np.sqrt(np.clip(w, 0, None))) @ q.T
    inner = np.linalg.eigvalsh(root @ cb @ root)
    return float(((ma - mb) ** 2).sum() + np.trace(ca) + np.trace(cb) - 2 * np.sqrt(np.clip(inner, 0, None)).sum())


def set_similarity(df: DataFrame, labels: str, least: float) -> DataFrame:
    """Pairs of distinct label sets with enough Jaccard similarity, and rows of the second.

    Distinct sets, not rows, are paired, by the labels they share; equal pairs are dropped again.
    """
    sets = df.groupBy(labels).agg(F.count(F.lit(1)).alias("n")).withColumn("x", F.explode(labels))
    a, b = sets.select(F.col(labels).alias("a"), "x"), sets.select(F.col(labels).alias("b"), "n", "x")
    pairs = a.join(b, "x").select("a", "b", "n").distinct()
    j = F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b"))
    return pairs.withColumn("jaccard", j).where(F.col("jaccard") >= least).select(F.array_join("a", "|").alias("a"), F.array_join("b", "|").alias("b"), "n", "jaccard")


def selection_jaccard(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Jaccard similarity of two sets of keys; 1 where both are empty."""
    both = a.select(key).distinct().withColumn("a", F.lit(True)).join(b.select(key).distinct().withColumn("b", F.lit(True)), key, "full")
    return both.agg(F.coalesce(F.count_if(F.col("a") & F.col("b")) / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(1.0)).alias("jaccard"))
