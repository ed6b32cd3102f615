"""Vectors of one label that point nearly the same way: exact pairs by cover trees.

Vectors are laid on the unit sphere, where the chord between two is a metric and a cosine limit is
a chord limit. A cover tree holds nested levels of centres with halving radii: each node's points
lie within its radius. A pair of nodes is passed over where the chord of their centres is
longer than both radii and the limit together, and taken whole where centre chord and radii together stay
under the limit; else it is opened.

The top of a label's tree is fitted on a bounded sample: its nodes of radius CELL that hold several
sampled points are cells. Every vector goes to the nearest cell of its label if that is within CELL of
its centre, else it is a loose one; and it visits each later cell that a partner could lie in, by the
same bound. Cells and the loose ones are dealt out in blocks of bounded size, and each two blocks that
must meet do so in one group, where a tree over each is traversed with the other's. A group gives each
vector's number of links there and a spanning forest of them, not the pairs, so results are
as many as vectors however many links there are.

Equal vectors are one class with a number of copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import common, files
from tessella.llm.components import connected

LIMIT = 0.93
#: Vectors of the sample that cells are fitted on, at most, of all labels together.
SAMPLE = 8192
#: Radius of a cell (a level of the tree: 2, 1, 0.5) and sampled points that it must hold.
CELL, MEMBERS = 0.5, 4
#: Classes of a block on average.
BLOCK = 4096
#: A node of no more points is compared point by point, as is one whose next level would have fewer than SPREAD points to a centre.
LEAF, SPREAD = 256, 32
#: Rounding that bounds allow for: chords near zero are roots of differences near 1e-16.
SLACK = 1e-7


def chord(cosine: float) -> float:
    return float(np.sqrt(max(0.0, 2 - 2 * cosine)))


def chords(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * (x @ y.T)))


def net(x: np.ndarray, radius: float, most: int) -> tuple[list[int], np.ndarray] | None:
    """Centres more than ``radius`` apart that cover all points, and each point's centre; None if it takes more than ``most``."""
    of, centres = np.full(len(x), -1), []
    while len(left := np.flatnonzero(of < 0)):
        if len(centres) == most:
            return None
        near = left[chords(x[left[:1]], x[left])[0] <= radius]
        of[left[0]], of[near] = len(centres), len(centres)
        centres.append(int(left[0]))
    return centres, of


class Node:
    """Points (indices) around a centre, their covering radius, and the next level's nodes."""

    def __init__(self, x: np.ndarray, at: np.ndarray, centre: int, level: float):
        self.at, self.centre = at, centre
        self.radius = float(chords(x[centre : centre + 1], x[at]).max()) + SLACK
        self.children: list[Node] = []
        while len(at) > LEAF and level > 1e-6 and not self.children:
            level /= 2
            if level >= self.radius:  # one centre would do
                continue
            made = net(x[at], level, len(at) // SPREAD)
            if made is None:
                break
            self.children = [Node(x, at[made[1] == k], int(at[c]), level) for k, c in enumerate(made[0])]


def tree(x: np.ndarray) -> Node:
    return Node(x, np.arange(len(x)), 0, 2.0)


def pairs(x: np.ndarray, a: Node, y: np.ndarray, b: Node, limit: float, same: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """All pairs with a cosine of ``limit`` or more, as (points of x, points of y, which of their products are meant; None: all).

    ``same``: both are the same points; each pair comes once then, and none of a point with itself.
    """
    reach, stack = chord(limit) + SLACK, [(a, b)]
    while stack:
        u, v = stack.pop()
        own = same and u is v
        d = float(chords(x[u.centre : u.centre + 1], y[v.centre : v.centre + 1])[0, 0])
        if not own and d > u.radius + v.radius + reach:
            continue
        if not own and d + u.radius + v.radius < chord(limit) - SLACK:
            yield u.at, v.at, None
        elif not u.children and not v.children:
            for k in range(0, len(u.at), 1024):
                part = u.at[k : k + 1024]
                hit = x[part] @ y[v.at].T >= limit
                if own:
                    hit &= part[:, None] < v.at[None, :]
                if hit.any():
                    yield part, v.at, hit
        elif own:
            c, r = x[[p.centre for p in u.children]], np.array([p.radius for p in u.children])
            near = np.triu(chords(c, c) <= r[:, None] + r[None, :] + reach)
            stack += [(u.children[i], u.children[j]) for i, j in zip(*near.nonzero(), strict=True)]
        elif v.children and (not u.children or v.radius > u.radius):
            d = chords(x[u.centre : u.centre + 1], y[[q.centre for q in v.children]])[0]
            stack += [(u, q) for q, away in zip(v.children, d, strict=True) if away <= u.radius + q.radius + reach]
        else:
            d = chords(x[[p.centre for p in u.children]], y[v.centre : v.centre + 1])[:, 0]
            stack += [(p, v) for p, away in zip(u.children, d, strict=True) if away <= p.radius + v.radius + reach]


class Forest:
    """Components of numbers, and the links that made them."""

    def __init__(self, n: int):
        self.up, self.links = np.arange(n), []

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = int(self.up[i])
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.links.append((i, j))

    def join_all(self, one: np.ndarray, two: np.ndarray, hit: np.ndarray | None) -> None:
        """Join the ends of many links, looking only at those whose ends differ yet."""
        if hit is None:
            for i in one:
                self.join(int(i), int(two[0]))
            for j in two:
                self.join(int(one[0]), int(j))
            return
        for k, i in enumerate(one):
            at = two[hit[k]]
            while len(at):
                roots = np.array([self.root(int(j)) for j in at]) if len(at) < 64 else self.flat(at)
                at = at[roots != self.root(int(i))]
                if len(at):
                    self.join(int(i), int(at[0]))

    def flat(self, at: np.ndarray) -> np.ndarray:
        """Roots of many numbers at once."""
        r = self.up[at]
        while (s := self.up[r]) is not r and (s != r).any():
            r = s
        self.up[at] = r
        return r


def linked(x: np.ndarray, y: np.ndarray | None, limit: float, copies: np.ndarray, more: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, list]:
    """Links within x (y None) or between x and y: how many copies each point of x and of y is linked with, and a forest (indices, y's behind x's)."""
    a, n = tree(x), len(x)
    same = y is None
    b = a if same else tree(y)
    y, more = (x, copies) if same else (y, more)
    one, two, forest = np.zeros(n, dtype=np.int64), np.zeros(len(y), dtype=np.int64), Forest(n if same else n + len(y))
    for i, j, hit in pairs(x, a, y, b, limit, same):
        if hit is None:
            one[i] += more[j].sum()
            two[j] += copies[i].sum()
        else:
            one[i] += hit @ more[j]
            two[j] += copies[i] @ hit
        forest.join_all(i, j if same else j + n, hit)
    return (one + two, two[:0], forest.links) if same else (one, two, forest.links)


def classes_of(rows: DataFrame, key: str, vector: str, label: str) -> tuple[DataFrame, DataFrame]:
    """Rows as (id, label, x: double components or null) and classes of equal usable ones: (label, x, rep, copies).

    ``copies`` counts rows with an id; a class without is left out.
    """
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    sound = (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    usable = F.col(label).isNotNull() & F.col(key).isNotNull() & F.coalesce(sound, F.lit(False))
    rows = rows.select(F.col(key).cast("long").alias("id"), F.when(usable, F.col(label)).alias("label"), F.when(usable, x).alias("x"))
    return rows, rows.where("x is not null").groupBy("label", "x").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))


def unit(vectors: list) -> np.ndarray:
    """Rows of length one; scaled by the largest component first, so that squares neither overflow nor vanish."""
    x = np.array(vectors, dtype=np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cells(classes: DataFrame) -> dict:
    """(label, number of components) to cell centres, from SAMPLE classes chosen by hash.

    By label, the nested levels 2, 1, 0.5 of a tree over the sampled points; of its last, the nodes of MEMBERS points.
    """
    drawn = classes.select("label", "x", F.xxhash64("x", "label").alias("h")).orderBy("h", "label", "x").limit(SAMPLE).collect()
    groups: dict = {}
    for r in drawn:
        groups.setdefault((r.label, len(r.x)), []).append(r.x)
    out = {}
    for name, vectors in groups.items():
        x = unit(vectors)
        parts, level = [np.arange(len(x))], 2.0
        while level > CELL:
            level, old, parts = level / 2, parts, []
            for at in old:
                _, of = net(x[at], level, len(at))
                parts += [p for k in range(of.max() + 1) if len(p := at[of == k]) >= MEMBERS]
        if parts:
            out[name] = np.array([x[p[0]] for p in parts])
    return out


def placed(classes: DataFrame) -> DataFrame:
    """Where classes meet others: (label, size, cell, home, c, x, copies); cell -1 holds the loose ones, home false is a visit."""
    kind = classes.schema["label"].dataType.simpleString()
    known = classes.sparkSession.sparkContext.broadcast(cells(classes))
    reach = CELL + chord(LIMIT) + SLACK

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            labels, raw = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            groups: dict = {}
            for i, v in enumerate(raw):
                groups.setdefault((labels[i], len(v)), []).append(i)
            for (label, size), at in groups.items():
                at, x = np.array(at), unit([raw[i] for i in at])
                home, visits = np.full(len(at), -1), [(np.arange(len(at)), None)]
                if (centres := known.value.get((label, size))) is not None:
                    d = chords(x, centres)
                    home = np.where(d.min(axis=1) <= CELL, d.argmin(axis=1), -1)
                    visits += [(w, k) for k in range(len(centres)) if len(w := np.flatnonzero((d[:, k] <= reach) & (home < k)))]
                for who, cell in visits:
                    rows = at[who].tolist()
                    flat = pa.array(x[who].ravel())
                    vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(who) + 1, dtype=np.int32) * size), flat)
                    where = home[who] if cell is None else np.full(len(who), cell)
                    yield pa.record_batch([batch.column(0).take(pa.array(rows)), pa.array([size] * len(who), pa.int32()), pa.array(where, pa.int32()), pa.array([cell is None] * len(who)), batch.column(2).take(pa.array(rows)), vectors, batch.column(3).take(pa.array(rows))], names=["label", "size", "cell", "home", "c", "x", "copies"])

    return classes.select("label", "x", "c", "copies").mapInArrow(place, f"label {kind}, size int, cell int, home boolean, c long, x array<double>, copies long")


def met(rows: DataFrame, limit: float) -> DataFrame:
    """What blocks show on meeting: (a, b, n): n copies linked with class a (b null), or a link of the forest (n null)."""
    on = ["label", "size", "cell"]
    held = common.saved(rows.groupBy(*on).agg(F.count(F.when(F.col("home"), 1)).alias("homes"), F.count(F.when(~F.col("home"), 1)).alias("guests")))
    blocks = held.select(*on, F.greatest(F.ceil(F.col("homes") / BLOCK), F.lit(1)).alias("homes"), F.ceil(F.col("guests") / BLOCK).alias("guests"))
    hot = common.hot_keys(held.select(*on, (F.col("homes") + F.col("guests")).alias("n")), on)
    rows = common.even_join(rows, blocks, on, hot)
    h = F.pmod(F.xxhash64("c"), F.when(F.col("home"), F.col("homes")).otherwise(F.col("guests")))
    # a home block meets each home block from itself on (as first), those before it (as second), and all guests' blocks
    first = F.transform(F.sequence(h, F.col("homes") + F.col("guests") - 1), lambda j: F.struct(h.alias("i"), j.alias("j"), F.lit(0).alias("side")))
    second = F.transform(F.sequence(F.lit(0).cast("long"), h), lambda i: F.struct(i.alias("i"), h.alias("j"), F.lit(1).alias("side")))
    second = F.filter(second, lambda s: s["i"] < s["j"])
    guest = F.transform(F.sequence(F.lit(0).cast("long"), F.col("homes") - 1), lambda i: F.struct(i.alias("i"), (h + F.col("homes")).alias("j"), F.lit(1).alias("side")))
    rows = rows.select(*on, F.explode(F.when(F.col("home"), F.concat(first, second)).otherwise(guest)).alias("m"), "c", "x", "copies")
    group = [*on, "i", "j"]
    rows = rows.select(*on, "m.i", "m.j", "m.side", "c", "x", "copies").repartition(*group).sortWithinPartitions(*group, "side")

    def compare(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def links(name: tuple, group: list):
            side = [[g[1:] for g in group if g[0] == s] for s in (0, 1)]
            c = [np.array([g[0] for g in s], dtype=np.int64) for s in side]
            copies = [np.array([g[2] for g in s], dtype=np.int64) for s in side]
            x = [np.array([g[1] for g in s], dtype=np.float64) for s in side]
            own = name[3] == name[4]
            if len(c[0]) and (own or len(c[1])):
                one, two, forest = linked(x[0], None if own else x[1], limit, copies[0], None if own else copies[1])
                c, n = np.concatenate(c), np.concatenate((one, two))
                if some := np.flatnonzero(n).tolist():
                    yield pa.record_batch([pa.array(c[some]), pa.nulls(len(some), pa.int64()), pa.array(n[some])], names=["a", "b", "n"])
                    ends = c[np.array(forest)]
                    yield pa.record_batch([pa.array(ends[:, 0]), pa.array(ends[:, 1]), pa.nulls(len(ends), pa.int64())], names=["a", "b", "n"])

        group, name = [], None
        for batch in batches:
            for *now, s, c, x, n in zip(*(k.to_pylist() for k in batch.columns), strict=True):
                if now != name:
                    yield from links(name, group) if name else ()
                    group, name = [], now
                group.append((s, c, x, n))
        yield from links(name, group) if name else ()

    return rows.mapInArrow(compare, "a long, b long, n long")


def link(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", limit: float = LIMIT) -> DataFrame:
    """One row a vector: key, n_links (other rows linked with it), component_id (least key reachable) and kept (is it that one).

    Vectors are linked if their labels are equal and not null, they have equally many components, and their cosine in double
    precision is ``limit`` or more. One that is null, empty, zero, or holds a null or non-finite component, and
    one with a null key, is linked with nothing; a null key's component is null and it is kept.
    Rows that repeat a key share its component and are vectors of their own otherwise. An empty
    table gives no rows; other columns aren't read.
    """
    spark = common.ship(rows.sparkSession)
    folder = common.scratch(spark, "vectors")
    try:
        rows, groups = classes_of(rows, key, vector, label)
        classes = common.kept(groups.withColumn("c", F.monotonically_increasing_id()), folder, "classes")  # numbers are fixed once written
        shown = common.kept(met(common.kept(placed(classes), folder, "placed"), limit), folder, "shown")
        counts = shown.where("b is null").groupBy(F.col("a").alias("c")).agg(F.sum("n").alias("n"))
        of = classes.select("c", "rep")
        ends = shown.where("n is null").select("a", "b")
        for side in "ab":
            ends = ends.join(of.select(F.col("c").alias(side), F.col("rep").alias(f"rep_{side}")), side)
        links = ends.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
        # rows of a class are joined with its first, and a key that comes with several vectors joins their classes
        named = classes.join(counts, "c", "left").select("label", "x", "rep", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "copies")
        hot = common.hot_keys(named.where("copies > 1").select("label", "x", F.col("copies").alias("n")), ["label", "x"])
        full = common.kept(common.even_join(rows.where("x is not null"), named.drop("copies"), ["label", "x"], hot).select("id", "rep", "n_links"), folder, "full")
        several = full.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("id")
        links = links.unionByName(full.join(several, "id", "left_semi").select(F.col("rep").alias("a"), F.col("id").alias("b")))
        labels = common.saved(connected(links)).select(F.col("node").alias("rep"), "component")
        held = common.hot_keys(full.groupBy("rep").agg(F.count(F.lit(1)).alias("n")), ["rep"])
        full = common.even_join(full, labels, ["rep"], held, "left").select("id", "n_links", F.coalesce("component", "rep").alias("component"))
        bare = rows.where("x is null").select("id", F.lit(0).cast("long").alias("n_links"))
        shared = full.groupBy("id").agg(F.min("component").alias("shared"))
        bare = bare.join(shared, "id", "left").select("id", "n_links", F.coalesce("shared", "id").alias("component"))
        out = full.unionByName(bare)
        return common.saved(out.select(F.col("id").alias(key), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("component") == F.col("id"), F.lit(True)).alias("kept")))
    finally:
        files.delete(spark, folder)
