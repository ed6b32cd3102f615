"""Seeded sampling, folds and group splits; hashes of seed and key decide, so input order doesn't."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.frames import numbered, scanned, settled
from tessella.functions.hashing import seeded


def take(df: DataFrame, n: int, key: str, seed: object = 0, by: list[str] = ()) -> DataFrame:
    """n rows a group without replacement, in hash order."""
    over = Window.partitionBy(*by).orderBy(seeded(seed, *by, key), key)
    return df.withColumn("draw", F.row_number().over(over)).where(F.col("draw") <= n)


def proportional(df: DataFrame, n: int, key: str, stratum: str, seed: object = 0) -> DataFrame:
    """About n rows by stratum size (half to even), topped up from the rest in hash order."""
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("c_"))
    total = df.agg(F.count(F.lit(1)).alias("t_"))
    sizes = sizes.crossJoin(F.broadcast(total)).select(stratum, F.bround(F.lit(n) * F.col("c_") / F.col("t_"), 0).cast("int").alias("q_"))
    rows = scanned(df.join(sizes, stratum), [stratum], [seeded(seed, key), F.col(key)], rank="r_").withColumn("first_", (F.col("r_") <= F.col("q_")).cast("int")).drop("r_")
    order = Window.orderBy(F.col("first_").desc(), seeded(seed, key), key)
    # only n rows of the global order are wanted: a sort with a limit, not a window over all
    return rows.orderBy(F.col("first_").desc(), seeded(seed, key), key).limit(n).withColumn("position", F.row_number().over(order)).drop("q_", "first_")


def split_share(df: DataFrame, share: float, key: str, seed: object = 0, by: list[str] = ()) -> DataFrame:
    """``df`` with side a or b: the first half-to-even share of each group in hash order is a."""
    rows = scanned(df, list(by), [seeded(seed, key), F.col(key)], rank="r_", totals={"n_": F.lit(1)})
    return rows.withColumn("side", F.when(F.col("r_") <= F.bround(F.col("n_") * F.lit(share), 0), "a").otherwise("b")).drop("r_", "n_")


def folds(df: DataFrame, k: int, key: str, seed: object = 0) -> DataFrame:
    """Distinct keys dealt to k folds in hash order."""
    rows = numbered(df.select(key).distinct(), [seeded(seed, key), F.col(key)], "fold")
    return rows.withColumn("fold", (F.col("fold") % k).cast("bigint"))


def bootstrap_contexts(df: DataFrame, replicates: int, share: float, key: str, by: str, seed: object = 0) -> DataFrame:
    """For each class and replicate, a share of its rows without replacement (at least one)."""
    rows = df.select(by, key).withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    rows = scanned(rows, [by, "replicate"], [seeded(seed, "replicate", key), F.col(key)], rank="rank_", totals={"n_": F.lit(1)})
    return rows.where(F.col("rank_") <= F.greatest(F.lit(1), F.bround(F.col("n_") * F.lit(share), 0))).drop("rank_", "n_")


def with_replacement(source: DataFrame, slots: DataFrame, by: str, key: str, seed: object = 0) -> DataFrame:
    """A row of the class for each slot (class, slot): the one whose number is a hash modulo the class's size."""
    from tessella.functions.hashing import seeded_int

    rows = scanned(source.select(by, key), [by], [F.col(key)], rank="at_").withColumn("at_", F.col("at_") - 1)
    sizes = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n_"))
    picks = slots.join(sizes, by).withColumn("at_", seeded_int(seed, by, "slot") % F.col("n_"))
    return picks.join(rows, [by, "at_"]).select(by, "slot", key)


def rank_bins(df: DataFrame, bins: int, value: str, key: str, by: list[str] = ()) -> DataFrame:
    """Bands of equal count by first-come rank, edges at 1 + (n - 1) k / bins, closed on the right; exact integers."""
    rows = scanned(df, list(by), [F.col(value), F.col(key)], rank="r_", totals={"n_": F.lit(1)})
    band = F.greatest(F.lit(1), F.ceil((F.col("r_") - 1) * bins / F.greatest(F.col("n_") - 1, F.lit(1)).cast("double") - 1e-12)).cast("bigint")
    return rows.withColumn("band", band).drop("r_", "n_")


def equal_bins(df: DataFrame, bins: int, value: str, key: str, seed: object = 0, by: list[str] = ()) -> DataFrame:
    """One seeded row out of each of ``bins`` equal parts of a ranking."""
    rows = scanned(df, list(by), [F.col(value), F.col(key)], rank="r_", totals={"n_": F.lit(1)})
    # the first n % bins parts have one row more
    some, more, at = F.floor(F.col("n_") / bins), F.col("n_") % bins, F.col("r_") - 1
    bin_ = F.when(at < more * (some + 1), F.floor(at / (some + 1))).otherwise(more + F.floor((at - more * (some + 1)) / F.greatest(some, F.lit(1))))
    rows = rows.withColumn("bin", (bin_ + 1).cast("int")).drop("r_", "n_")
    return take(rows, 1, key, seed, [*by, "bin"]).drop("draw")


SPLITS = {"train": 0.5, "validation": 0.2, "selection": 0.2, "final": 0.1}


def allocation(counts: DataFrame, shares: dict[str, float] = SPLITS, by: str = "dx") -> DataFrame:
    """Largest-remainder counts of groups to splits in each stratum; equal remainders go to the earlier split."""
    names = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(s).alias("split"), F.lit(p).alias("share")) for i, (s, p) in enumerate(shares.items())])
    rows = counts.select(by, "n", F.explode(names).alias("s")).select(by, "n", "s.at", "s.split", "s.share")
    rows = rows.withColumn("ideal", F.col("n") * F.col("share")).withColumn("whole", F.floor(F.col("ideal") + 1e-9))
    over = Window.partitionBy(by)
    rank = F.row_number().over(over.orderBy(F.round(F.col("whole") - F.col("ideal"), 9), "at"))
    rest = F.col("n") - F.sum("whole").over(over)
    rows = rows.withColumn("groups", (F.col("whole") + (rank <= rest).cast("bigint")).cast("bigint"))
    return rows.withColumn("end", F.sum("groups").over(over.orderBy("at"))).select(by, "at", "split", "groups", (F.col("end") - F.col("groups")).alias("begin"), "end")


def stratified_groups(groups: DataFrame, shares: dict[str, float] = SPLITS, by: str = "dx", key: str = "group_id", seed: object = 0) -> DataFrame:
    """A split for each group: hash order within its class (the class is part of the hash), cut at the allocation."""
    counts = groups.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    rows = scanned(groups.select(by, key), [by], [seeded(seed, by, key), F.col(key)], rank="r_").withColumn("r_", F.col("r_") - 1)
    plan = allocation(counts, shares, by).select(F.col(by).alias("by_"), "split", "begin", "end")
    return rows.join(plan, (F.col(by) == F.col("by_")) & (F.col("r_") >= F.col("begin")) & (F.col("r_") < F.col("end"))).select(by, key, "split")


def contiguous_groups(groups: DataFrame, shares: dict[str, float] = SPLITS, key: str = "group_id", seed: object = 0) -> DataFrame:
    """Unstratified: hash order cut at floors of the shares, the rest to the last split."""
    rows = numbered(groups.select(key).distinct(), [seeded(seed, key), F.col(key)], "r_")
    rows = rows.crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("n_"))))
    at, case = F.lit(0).cast("bigint"), None
    for name, share in list(shares.items())[:-1]:
        at = at + F.floor(F.col("n_") * share + 1e-9)
        case = F.when(F.col("r_") < at, name) if case is None else case.when(F.col("r_") < at, name)
    return rows.select(key, case.otherwise(list(shares)[-1]).alias("split"))


def overlaps(assigned: DataFrame, unit: str, split: str = "split") -> DataFrame:
    """Units that two splits share, for each pair that shares any."""
    each = assigned.select(unit, split).distinct()
    a, b = each.select(unit, F.col(split).alias("split_a")), each.select(unit, F.col(split).alias("split_b"))
    return a.join(b, unit).where("split_a < split_b").groupBy("split_a", "split_b").agg(F.count(F.lit(1)).alias("shared"))


def feasibility(counts: DataFrame, least: dict[str, int], shares: dict[str, float] = SPLITS, by: str = "dx") -> DataFrame:
    """Allocated groups against the minimum of each split, before anything is assigned."""
    rule = F.create_map(*[x for s, n in least.items() for x in (F.lit(s), F.lit(n))])
    rows = allocation(counts, shares, by).withColumn("least", F.coalesce(F.element_at(rule, F.col("split")), F.lit(0)))
    return rows.select(by, "split", "groups", "least", (F.col("groups") >= F.col("least")).alias("feasible"), F.greatest(F.col("least") - F.col("groups"), F.lit(0)).cast("bigint").alias("short"))


def greedy_counts(counts: dict[tuple, int], shares: dict[str, float], seed: object = 0) -> dict[tuple, int]:
    """Multi-label allocation over distinct vectors and how many groups have each; returns (vector, split) to the number of groups.

    A vector's places are signals to balance: positives of each label, and confident negatives
    where they are given too. Vectors with the rarest signal come first, of these the largest,
    then by a seeded hash. Each group goes to the split with room whose lack is greatest: the sum
    over its signals of the share of the split's own target that is still to come, so that small
    splits aren't starved; then by the share of room, then in the order of splits. Groups with
    equal vectors are alike, so a step takes a group's time but a vector's memory (driver).
    """
    names, total = list(shares), sum(counts.values())
    room = {s: int(total * p) for s, p in shares.items()}
    room[max(names, key=shares.get)] += total - sum(room.values())
    size = {s: max(n, 1) for s, n in room.items()}
    signals = range(len(next(iter(counts), ())))
    totals = [sum(n * v[j] for v, n in counts.items()) for j in signals]
    target = {s: [max(shares[s] * t, 1e-9) for t in totals] for s in names}
    have = {s: [0] * len(totals) for s in names}
    out: dict[tuple, int] = {}
    digest = lambda v: hashlib.sha256(f"{seed}:{v}".encode()).hexdigest()
    rarest = lambda v: min((totals[j] for j in signals if v[j]), default=total + 1)
    for v in sorted(counts, key=lambda v: (rarest(v), -sum(v), digest(v))):
        own = [j for j in signals if v[j]]

        def offer(k: int, t: int, own=own) -> tuple:
            """What split k offers to the next group after t."""
            s = names[k]
            return round(sum(max(0.0, 1 - (have[s][j] + t) / target[s][j]) for j in own), 9), (room[s] - t) / size[s], -k

        for k, n in enumerate(best_of(offer, [room[s] for s in names], counts[v])):
            if n:
                s = names[k]
                out[v, s] = n
                room[s] -= n
                for j in own:
                    have[s][j] += n
    return out


def best_of(value, lengths: list[int], n: int) -> list[int]:
    """Of lists whose values ``value(list, place)`` fall, all distinct, how many of each belong to the ``n`` greatest of all.

    The middle of the list that is least known splits all lists: if no more than ``n`` values reach
    it, all that do belong, else it and what is below don't.
    """
    least, most = [0] * len(lengths), [min(x, n) for x in lengths]

    def reaching(k: int, pivot) -> int:
        low, high = 0, lengths[k]
        while low < high:
            middle = (low + high) // 2
            low, high = (middle + 1, high) if value(k, middle) >= pivot else (low, middle)
        return low

    while any(a < b for a, b in zip(least, most, strict=True)):
        k = max(range(len(lengths)), key=lambda k: most[k] - least[k])
        middle = (least[k] + most[k]) // 2
        pivot = value(k, middle)
        count = [reaching(u, pivot) for u in range(len(lengths))]
        if sum(count) <= n:
            least = [max(a, c) for a, c in zip(least, count, strict=True)]
        else:
            most = [min(b, c) for b, c in zip(most, count, strict=True)]
            most[k] = min(most[k], middle)
    return least


def multilabel_groups(groups: DataFrame, kinds: list[str], shares: dict[str, float] = SPLITS, key: str = "group_id", seed: object = 0) -> DataFrame:
    """A split for each group by ``greedy_counts``: distinct vectors come to the driver, groups of a vector are dealt in hash order."""
    plan, begin = [], {}
    # as many as there are distinct vectors
    for (v, s), n in greedy_counts({tuple(r[:-1]): r[-1] for r in groups.groupBy(*kinds).agg(F.count(F.lit(1))).collect()}, shares, seed).items():
        plan.append((*v, s, begin.get(v, 0), begin.get(v, 0) + n))
        begin[v] = begin.get(v, 0) + n
    plan = groups.sparkSession.createDataFrame(plan, ", ".join(f"{k} int" for k in kinds) + ", split string, begin long, end long")
    # ranks in hash order: within the hash's first two digits, after what lies before these, so that a frequent vector isn't one task's
    rows = groups.withColumns({"h_": seeded(seed, key), "d_": F.substring(seeded(seed, key), 1, 2)})
    sums = rows.groupBy(*kinds, "d_").agg(F.count(F.lit(1)).alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.partitionBy(*kinds).orderBy("d_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(F.broadcast(sums.select(*kinds, "d_", before.alias("o_"))), [*kinds, "d_"])
    rows = rows.withColumn("r_", F.col("o_") + F.row_number().over(Window.partitionBy(*kinds, "d_").orderBy("h_", key)) - 1)
    # a row for each vector and split
    return rows.join(F.broadcast(plan), kinds).where((F.col("r_") >= F.col("begin")) & (F.col("r_") < F.col("end"))).select(key, "split")


def fraction_proposal(support: DataFrame, shares: dict[str, float], total: int, least_positive: int, least_negative: int, donor: str) -> DataFrame:
    """(split, share, factor, proposed, more_groups) for splits whose support (split, label, positives, negatives) fails, and the donor's row.

    The factor would lift the label that lacks most to the minimum; what the others need is
    taken from the donor. A proposal only: nothing is changed.
    """
    ratio = lambda have, least: F.when(F.col(have) < least, F.lit(least) / F.greatest(F.col(have), F.lit(1))).otherwise(1.0)
    share = F.element_at(F.create_map(*[F.lit(x) for pair in shares.items() for x in pair]), F.col("split"))
    worst = F.max(F.greatest(ratio("positives", least_positive), ratio("negatives", least_negative)))
    failing = support.groupBy("split").agg(worst.alias("factor")).where("factor > 1").withColumn("share", share)
    rows = failing.withColumn("whole", F.least(F.lit(1.0), F.col("share") * F.col("factor")))
    rows = rows.select("split", "share", F.round("factor", 3).alias("factor"), F.round("whole", 4).alias("proposed"), F.floor(total * (F.col("whole") - F.col("share")) + 1e-9).cast("bigint").alias("more_groups"))
    lost = rows.agg(F.coalesce(F.sum("more_groups"), F.lit(0)).alias("n"))
    return rows.unionByName(lost.select(F.lit(donor).alias("split"), F.lit(shares[donor]).alias("share"), F.lit(None).cast("double").alias("factor"), F.round(shares[donor] - F.col("n") / max(total, 1), 4).alias("proposed"), (-F.col("n")).alias("more_groups")))


def heads(rows: DataFrame, by: str, order: list[str], n: int, key: str) -> DataFrame:
    """Keys of the first n rows of each label (rows: one a key and label), and of the first n keys of all, each once."""
    each = rows.withColumn("r_", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("r_") <= n).select(key)
    return each.unionByName(rows.groupBy(key).agg(F.min(F.struct(*order)).alias("o_")).orderBy("o_").limit(n).select(key)).distinct()


def upto(rows: DataFrame, value: str, most: int, key: str, seed: object, *salt) -> DataFrame:
    """The first rows in seeded hash order until ``value`` (1 or more a row) adds up to ``most``.

    Sums by the hash's first three digits, 4,096 at most, tell in which of these the sum is reached:
    rows before it are taken in passing, and only its own are put in order.
    """
    h = seeded(seed, *salt, key)
    digits = F.substring(h, 1, 3)
    before, cut = 0, None
    for r in sorted(rows.groupBy(digits.alias("d")).agg(F.sum(value).alias("s")).collect()):
        if before + (r.s or 0) >= most:
            cut = r.d
            break
        before += r.s or 0
    if most <= 0:
        return rows.limit(0)
    if cut is None:
        return rows
    held = F.coalesce(F.sum(value).over(Window.orderBy(h, F.col(key)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = rows.where(digits == cut).withColumn("before_", held).where(F.col("before_") + before < most).drop("before_")
    return rows.where(digits < cut).unionByName(last)


def rarity_first(groups: DataFrame, labels: list[str], target: int, key: str = "group_id", size: str = "n_rows", seed: object = 0) -> DataFrame:
    """Whole groups, about ``target`` rows: for each label, rarest first, groups in hash order until its quota of positive rows is met, then any groups in hash order.

    ``groups``: key, size and, for each label, its positive rows. A quota is the label's share of
    all rows times the target, half to even; what groups drawn before hold counts. Two passes over
    the groups a label (see ``upto``); no task holds the sample.
    """
    total = groups.agg(*[F.sum(c).alias(c) for c in (size, *labels)]).first()
    quota = {x: int(half_even(target * (total[x] or 0) / max(total[size] or 0, 1))) for x in labels}
    chosen = groups.limit(0)
    for x in sorted(labels, key=lambda x: (total[x] or 0, labels.index(x))):
        have = chosen.agg(F.coalesce(F.sum(x), F.lit(0))).first()[0]
        if quota[x] > have:
            rest = groups.where(F.col(x) > 0).join(chosen, key, "left_anti")
            chosen = settled(chosen.unionByName(upto(rest, x, quota[x] - have, key, seed, F.lit(x))))
    have = chosen.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    if have < target:
        chosen = settled(chosen.unionByName(upto(groups.join(chosen, key, "left_anti"), size, target - have, key, seed)))
    return chosen.select(key)


def half_even(x: float) -> float:
    """Half to even, after the noise of a product is off."""
    return round(round(x, 9))


def matched_counts(pool: dict[tuple, int], wanted: list[int], size: int, single: float, multi: float, seed: object = 0, swaps: int = 100) -> dict[tuple, int]:
    """How many rows of each label vector to draw so that label totals are near ``wanted`` and shares of single- and multi-label rows near theirs.

    Labels by what is wanted, least first: vectors with the label in seeded order until it has
    enough; then vectors without labels, then any, up to ``size``; then up to ``swaps`` best
    exchanges of a row of one vector for a row of another, while the mismatch falls. Rows of a
    vector are alike, so only vectors and counts are looked at (driver; pool: vector to rows); all
    exchanges are rated at once by what they change.
    """
    order = sorted(pool, key=lambda v: hashlib.sha256(f"{seed}:{v}".encode()).hexdigest())
    take, totals, drawn = dict.fromkeys(order, 0), [0] * len(wanted), 0

    def more(v: tuple, most: int) -> None:
        nonlocal drawn
        n = max(0, min(pool[v] - take[v], most, size - drawn))
        take[v], drawn = take[v] + n, drawn + n
        for k, x in enumerate(v):
            totals[k] += n * x

    for k in sorted(range(len(wanted)), key=lambda k: (wanted[k], k)):
        for v in order:
            if v[k]:
                more(v, wanted[k] - totals[k])
    for v in sorted(order, key=any):  # those without a label come first, the sort keeps the order
        more(v, pool[v])
    if not order:
        return {}
    x, have, held = np.array(order, dtype=np.float64), np.array([take[v] for v in order]), np.array([pool[v] for v in order])
    goal, weight = np.array(wanted, dtype=np.float64), np.maximum(np.array(wanted, dtype=np.float64), 1)
    kind = np.minimum(x.sum(axis=1), 2).astype(int)  # none, one or several labels
    for _ in range(swaps):
        gone, come = np.flatnonzero(have > 0), np.flatnonzero(have < held)
        if not len(gone) or not len(come):
            break
        off, parts = have @ x - goal, np.bincount(kind, have, 3)
        shares = lambda a, b: np.abs((parts[1] - (a == 1) + (b == 1)) / max(size, 1) - single) + np.abs((parts[2] - (a == 2) + (b == 2)) / max(size, 1) - multi)
        now = round(float((np.abs(off) / weight).sum() + shares(0, 0)), 9)
        cost = shares(*np.meshgrid(kind[gone], kind[come], indexing="ij"))
        if ((x == 0) | (x == 1)).all():  # of labels that are there or not, a label's part is linear in either side and their product
            up, down, same = (np.abs(off + d) / weight for d in (1, -1, 0))
            cost += same.sum() + (x[gone] @ (down - same))[:, None] + x[come] @ (up - same) + (x[gone] * (2 * same - up - down)) @ x[come].T
        else:
            for k in range(len(goal)):
                cost += np.abs(off[k] - x[gone, k][:, None] + x[come, k]) / weight[k]
        cost[gone[:, None] == come] = np.inf
        i, j = divmod(int(np.round(cost, 9).argmin()), len(come))
        if np.round(cost[i, j], 9) >= now:
            break
        have[gone[i]] -= 1
        have[come[j]] += 1
    return {v: int(n) for v, n in zip(order, have, strict=True) if n}


def matched_draw(pool: DataFrame, labels: list[str], wanted: list[int], size: int, single: float, multi: float, key: str = "group_id", seed: object = 0, swaps: int = 100) -> DataFrame:
    """The rows of ``matched_counts``, of each vector the first in hash order: key and the labels."""
    counts = {tuple(r[:-1]): r[-1] for r in pool.groupBy(*labels).agg(F.count(F.lit(1))).collect()}  # a row a vector
    take = matched_counts(counts, wanted, size, single, multi, seed, swaps)
    plan = pool.sparkSession.createDataFrame([(*v, n) for v, n in take.items()], ", ".join(f"{x} int" for x in labels) + ", n_ int")
    rows = scanned(pool.join(F.broadcast(plan), labels), labels, [seeded(seed, key), F.col(key)], rank="r_", most=max(counts.values(), default=0))
    return rows.where(F.col("r_") <= F.col("n_")).select(key, *labels)


def draw_residuals(drawn: DataFrame, labels: list[str], wanted: list[int], tolerance: float) -> DataFrame:
    """(label, target, achieved, delta, within): what a matched draw misses; within a share of the target, or one row."""
    rows = F.explode(F.array(*[F.struct(F.lit(x).alias("label"), F.lit(w).cast("long").alias("target"), F.col(x).alias("achieved")) for x, w in zip(labels, wanted, strict=True)]))
    sums = drawn.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in labels]).select(rows.alias("r")).select("r.*")
    delta = F.col("achieved") - F.col("target")
    return sums.withColumns({"delta": delta, "within": F.abs(delta) <= F.greatest(F.lit(1.0), tolerance * F.greatest("target", F.lit(1)))})
