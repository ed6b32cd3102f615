"""MinHash near-duplicate detection with odd sketches.

Texts with equal shingle sets are one class. Classes that share a band of MinHash values are
candidates. The MinHash samples of a class are folded into a bitmap of parities, its odd
sketch; the ones in the XOR of two sketches estimate high similarities precisely, so they
decide which candidates are confirmed on the full sets.

Not all pairs of a bucket are made. First each class is compared with its buckets' smallest
ones. What that links becomes components; then, in buckets that hold several components,
classes outside the bucket's largest one are compared with all others of other components, in
blocks of bounded size. Pairs inside a component need no comparison, so no link between
components is left out.

What is shuffled is small: bands meet as two numbers (band, class), and shingle sets are made
again from the texts, only for classes that are compared, so neither texts nor the sets of
all documents are ever moved. Which documents those are is told by a Bloom filter of fixed size;
beyond what it can tell apart, more sets than needed are made, and dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import common, files
from tessella.llm.components import connected

SHINGLE, PERCENT = 5, 75
#: 40 bands of 5: a pair of similarity 0.75 shares none with probability 2e-5.
BANDS, ROWS = 40, 5
SKETCH_BITS = 1024
#: Sketch estimates this far below the limit (over four standard errors) rule a pair out.
SLACK = 0.13
#: Classes of a bucket to a block on either side of a comparison, on average.
BLOCK = 256
#: Bits of the Bloom filter of wanted documents (8 MB) and hashes of each.
BLOOM_BITS, BLOOM_HASHES = 1 << 26, 3


def signatures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: id, n_shingles, digest (of the set; null if it is empty), bands, sketch."""
    common.ship(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("id"), common.text_or_empty(text).alias("text"))

    def sign(batches: Iterator) -> Iterator:
        common.let_go()
        import hashlib

        import numpy as np
        import pyarrow as pa

        from tessella.llm.shingles import MinHash, shingle_set

        m = MinHash(BANDS * ROWS, SKETCH_BITS)
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary()]
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text.encode("utf-8", "surrogatepass"), SHINGLE)
                if len(s):
                    minima = m.minima(s)
                    out.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), m.bands(minima, ROWS).view(np.int64), m.odd_sketch(minima).tobytes()))
                else:
                    out.append((0, None, None, None))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.record_batch([batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds[1:], strict=True))], names=["id", "n_shingles", "digest", "bands", "sketch"])

    return rows.mapInArrow(sign, "id long, n_shingles long, digest binary, bands array<long>, sketch binary")


def likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b: classes) whose sizes and sketches allow the limit."""
    of = classes.select("c", "n_shingles", "sketch")
    a, b = (of.select(F.col("c").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "ab")
    pairs = common.saved(pairs)
    hot = common.hot_keys(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")), ["a"])
    rows = common.even_join(pairs, a, ["a"], hot).join(b, "b")
    rows = rows.where(100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb"))

    def sift(batches: Iterator) -> Iterator:
        common.let_go()
        import numpy as np
        import pyarrow as pa

        from tessella.llm.shingles import MinHash

        m = MinHash(BANDS * ROWS, SKETCH_BITS)
        for batch in batches:
            if batch.num_rows:
                sa, sb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint64).reshape(batch.num_rows, -1) for i in (2, 3))
                keep = m.estimate(np.bitwise_count(sa ^ sb).sum(axis=1)) >= PERCENT / 100 - SLACK
                yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return rows.select("a", "b", "sa", "sb").mapInArrow(sift, "a long, b long")


def places(key: str) -> list:
    """Where a key's bits lie in the Bloom filter."""
    return [F.pmod(F.xxhash64(key, F.lit(k)), F.lit(BLOOM_BITS)).alias(f"place{k}") for k in range(BLOOM_HASHES)]


def bloom(keys: DataFrame, key: str):
    """The Bloom filter of the keys as bytes: BLOOM_BITS bits, made where the keys are."""
    import numpy as np

    out, size = np.zeros(BLOOM_BITS // 8, dtype=np.uint8), 1 << 15  # bits to a row
    at = keys.select(F.explode(F.array(*places(key))).alias("at"))
    made = at.groupBy((F.col("at") / size).cast("long").alias("k")).agg(F.bitmap_construct_agg(F.col("at") % size).alias("bits"))
    for r in made.collect():
        out[r.k * size // 8 : r.k * size // 8 + len(r.bits)] = np.frombuffer(r.bits, dtype=np.uint8)
    return out


def full_sets(wanted: DataFrame, classes: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """(c, hashes) of the wanted classes, made again from the text of the document that each is named by."""
    wanted = common.saved(classes.select("c", "digest", "rep").join(wanted, "c", "left_semi"))
    shared = docs.sparkSession.sparkContext.broadcast(bloom(wanted, "rep"))
    rows = docs.select(F.col(key).cast("long").alias("id"), common.text_or_empty(text).alias("text")).where("id is not null").select("text", *places("id"))

    def sets(batches: Iterator) -> Iterator:
        common.let_go()
        import hashlib

        import numpy as np
        import pyarrow as pa

        from tessella.llm.shingles import shingle_set

        bits = shared.value
        for batch in batches:
            keep = np.ones(batch.num_rows, dtype=bool)
            for k in range(BLOOM_HASHES):
                at = batch.column(k + 1).to_numpy()
                keep &= (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            raws = [shingle_set(t.encode("utf-8", "surrogatepass"), SHINGLE).tobytes() for t in batch.column(0).filter(pa.array(keep)).to_pylist()]
            yield pa.record_batch([pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in raws], pa.binary()), pa.array(raws, pa.binary())], names=["digest", "hashes"])

    made = rows.mapInArrow(sets, "digest binary, hashes binary").join(wanted.select("digest", "c"), "digest")
    return made.dropDuplicates(["digest"]).select("c", "hashes")  # a repeated id may have other texts, or the same again


def confirmed(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Of pairs (a, b: classes), those that meet the limit on their full shingle sets.

    Pairs lie by ``a`` (and a salt, where one has very many): its set comes once before those of its
    partners, so memory holds two sets at a time.
    """
    pairs = common.saved(pairs)
    hot = common.hot_keys(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")), ["a"])
    salt = F.pmod(F.xxhash64("b"), F.coalesce("salts_", F.lit(1).cast("long")))
    pairs = pairs.join(F.broadcast(hot), "a", "left").select("a", "b", salt.alias("salt"))
    firsts = pairs.select("a", "salt").distinct().join(found, F.col("a") == F.col("c")).select("a", "salt", F.lit(None).cast("long").alias("b"), "hashes")
    others = pairs.join(found, F.col("b") == F.col("c")).select("a", "salt", "b", "hashes")
    rows = firsts.unionByName(others).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def check(batches: Iterator) -> Iterator:
        common.let_go()
        import numpy as np
        import pyarrow as pa

        first = None
        for batch in batches:
            out = []
            for a, b, raw in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                s = np.frombuffer(raw, dtype=np.uint64)
                if b is None:
                    first = (a, s)
                    continue
                if first is None or first[0] != a:
                    raise ValueError("a set is missing")
                if alike(first[1], s):
                    out.append((a, b))
            yield pa.record_batch([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return rows.mapInArrow(check, "a long, b long")


def alike(a, b) -> bool:
    """Whether two sets (sorted hashes) meet the limit."""
    import numpy as np

    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    both = int((a[at] == b).sum())
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def mixed_buckets(buckets: DataFrame, of: DataFrame, hot: DataFrame) -> DataFrame:
    """Classes of buckets that hold several components: band, c, component, and the bucket's n, most and main (its largest component, of ``most`` classes).

    ``buckets``: band, c, n, first; ``of``: c, component; ``hot``: hot bands. A bucket's first class
    has been compared with all others, so it isn't among them.
    """
    rows = common.saved(buckets.where("n > 2").join(of, "c").select("band", "c", "component", "first"))
    held = rows.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = held.groupBy("band").agg(F.sum("n").alias("n"), F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("most")).where("most < n")
    return common.saved(common.even_join(rows, mixed, ["band"], hot).where("c <> first").drop("first"))


def grouped(rows: DataFrame, group: list[str], each) -> Iterator:
    """Helper of tasks: ``each`` (name, rows) on each run of Arrow rows whose first columns, ``group``, are equal; lists of numbers, all as long, come as arrays."""
    held, name, k = [], None, len(group)
    of = lambda x: x.flatten().to_numpy().reshape(len(x), -1) if hasattr(x, "flatten") and hasattr(x.type, "value_type") else x.to_pylist()
    for batch in (b for b in rows if b.num_rows):
        for row in zip(*map(of, batch.columns), strict=True):
            if row[:k] != name:
                if name is not None:
                    yield from each(name, held)
                held, name = [], row[:k]
            held.append(row[k:])
    if name is not None:
        yield from each(name, held)


def sifted(met: DataFrame) -> DataFrame:
    """Of classes in blocks (band, i, j, side, c, component, n_shingles, sketch, bands), those with a likely partner on the other side: (band, i, j, side, c, component).

    Sketches alone are looked at, a block's against one another at once. A pair counts in the first band that it shares.
    """

    def sift(batches: Iterator) -> Iterator:
        common.let_go()
        import numpy as np
        import pyarrow as pa

        from tessella.llm.shingles import MinHash

        m = MinHash(BANDS * ROWS, SKETCH_BITS)
        most = int((m.estimate(np.arange(SKETCH_BITS + 1)) >= PERCENT / 100 - SLACK).sum()) - 1  # estimates fall with the ones

        def each(name: tuple, group: list) -> Iterator:
            sides = [[x for x in group if x[0] == k] for k in (0, 1)]
            if not all(sides):
                return
            comp, n = ([np.array([x[k] for x in side]) for side in sides] for k in (2, 3))
            # bits as 0 and 1: what two sketches differ in is what both have, less twice what they share
            bits = [np.unpackbits(np.array([np.frombuffer(x[4], dtype=np.uint8) for x in side]), axis=1).astype(np.float32) for side in sides]
            bands = [np.array([x[5] for x in side]) for side in sides]
            ones = [b.sum(axis=1) for b in bits]
            fits = (comp[0][:, None] != comp[1]) & (100 * np.minimum(n[0][:, None], n[1]) >= PERCENT * np.maximum(n[0][:, None], n[1]))
            fits &= ones[0][:, None] + ones[1] - 2 * (bits[0] @ bits[1].T) <= most
            one, two = fits.nonzero()
            here = np.concatenate([bands[0][a, (bands[0][a] == bands[1][b]).argmax(axis=1)] == name[0] for a, b in ((one[k : k + 4096], two[k : k + 4096]) for k in range(0, len(one), 4096))] or [one > 0])
            keep = [np.isin(np.arange(len(side)), at[here]) for side, at in zip(sides, (one, two), strict=True)]
            out = [(*name, *x[:3]) for side, some in zip(sides, keep, strict=True) for x, k in zip(side, some, strict=True) if k]
            if out:
                yield pa.record_batch([pa.array([x[k] for x in out], pa.int32() if k == 3 else pa.int64()) for k in range(6)], names=["band", "i", "j", "side", "c", "component"])

        yield from grouped(batches, ["band", "i", "j"], each)

    met = met.select("band", "i", "j", "side", "c", "component", "n_shingles", "sketch", "bands")
    return met.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(sift, "band long, i long, j long, side int, c long, component long")


def across(rows: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """Links (a, b: classes) between components in the buckets of ``rows`` (see ``mixed_buckets``).

    Classes outside a bucket's largest component meet all others in blocks: each side's block
    number is a hash, so a block has about BLOCK classes however many the bucket has. First their
    sketches meet; full sets follow to a block only for classes that have a likely partner there. A pair is
    looked at in the first band that it shares; likely pairs are confirmed there on the full
    sets, the likeliest first, and pairs whose components a block has already joined are passed
    over, so what leaves a block is a forest.
    """
    signs = classes.select("c", "n_shingles", "sketch", "bands")
    rows = rows.withColumns({"left": F.greatest(F.ceil(F.col("n") / BLOCK), F.lit(1)), "right": F.greatest(F.ceil((F.col("n") - F.col("most")) / BLOCK), F.lit(1)), "h": F.xxhash64("c", "band")})
    body = ["band", "c", "component"]
    one = rows.select(*body, F.lit(0).alias("side"), F.pmod("h", "left").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("right") - 1)).alias("j"))
    two = rows.where("component <> main").select(*body, F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("left") - 1)).alias("i"), F.pmod("h", "right").alias("j"))
    met = common.saved(sifted(one.unionByName(two).join(signs, "c")))
    met = met.join(found, "c").join(signs.drop("n_shingles"), "c").select("band", "i", "j", "side", "c", "component", "sketch", "bands", "hashes")
    met = met.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")

    def compare(batches: Iterator) -> Iterator:
        common.let_go()
        import numpy as np
        import pyarrow as pa

        from tessella.llm.shingles import MinHash

        m = MinHash(BANDS * ROWS, SKETCH_BITS)

        def links(band: int, group: list) -> list:
            one, two = [x for x in group if not x[0]], [x for x in group if x[0]]
            if not one or not two:
                return []
            comp, n = np.array([x[2] for x in one]), np.array([len(x[5]) // 8 for x in one])
            sketch = np.array([np.frombuffer(x[3], dtype=np.uint64) for x in one])
            bands = np.array([x[4] for x in one], dtype=np.int64)
            likely = []
            for y, (_, _, c, s, own, raw) in enumerate(two):
                size = len(raw) // 8
                at = np.flatnonzero((comp != c) & (100 * np.minimum(n, size) >= PERCENT * np.maximum(n, size)))
                guess = m.estimate(np.bitwise_count(sketch[at] ^ np.frombuffer(s, dtype=np.uint64)).sum(axis=1))
                at, guess = at[guess >= PERCENT / 100 - SLACK], guess[guess >= PERCENT / 100 - SLACK]
                if not len(at):
                    continue
                own = np.array(own, dtype=np.int64)
                here = own[(bands[at] == own).argmax(axis=1)] == band
                likely += [(-g, x, y) for x, g in zip(at[here].tolist(), guess[here].tolist(), strict=True)]
            parent: dict[int, int] = {}

            def root(x: int) -> int:
                while (up := parent.get(x, x)) != x:
                    x = up
                return x

            out = []
            for _, x, y in sorted(likely):
                cx, cy = root(one[x][2]), root(two[y][2])
                if cx != cy and alike(*(np.frombuffer(z[5], dtype=np.uint64) for z in (one[x], two[y]))):
                    parent[max(cx, cy)] = min(cx, cy)
                    out.append((one[x][1], two[y][1]))
            return out

        group, name = [], None
        for batch in batches:
            done = []
            for band, i, j, *rest in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if (band, i, j) != name:
                    done += links(name[0], group) if name else []
                    group, name = [], (band, i, j)
                group.append(rest)
            yield pa.record_batch([pa.array([x[k] for x in done], pa.int64()) for k in (0, 1)], names=["a", "b"])
        done = links(name[0], group) if name else []
        yield pa.record_batch([pa.array([x[k] for x in done], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return met.mapInArrow(compare, "a long, b long").distinct()


def link(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: key, n_shingles, component_id (least key reachable over links) and kept (is it that one).

    A text without words has no shingles and is linked with nothing. Rows with a null key are
    linked with nothing: their component is null and they are kept. Rows that repeat a key share
    its component, whatever their texts; an empty table gives no rows. Other columns of ``docs``
    aren't read.
    """
    spark = docs.sparkSession
    folder = common.scratch(spark, "near")
    keep = lambda df, name: common.kept(df, folder, name)
    try:
        rows = keep(signatures(docs, key, text), "signatures")
        full = rows.where("digest is not null and id is not null")
        groups = full.groupBy("digest").agg(F.min("id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
        classes = keep(groups.withColumn("c", F.monotonically_increasing_id()), "classes")  # numbers are fixed once written
        rows = keep(rows.select("id", "n_shingles", "digest"), "rows")
        files.delete(spark, f"{folder}/signatures")
        full, reps = rows.where("digest is not null and id is not null"), classes.select("c", "rep")

        spread = classes.select(F.explode("bands").alias("band"), "c")
        sizes = keep(spread.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("first")).where("n > 1"), "sizes")
        hot = common.hot_keys(sizes, ["band"])
        buckets = keep(common.even_join(spread, sizes, ["band"], hot).select("band", "c", "n", "first"), "buckets")

        stars = buckets.where("c <> first").select(F.col("first").alias("a"), F.col("c").alias("b")).distinct()
        stars = keep(likely(stars, classes), "stars")
        ends = lambda p: p.join(reps.select(F.col("c").alias("a"), F.col("rep").alias("x")), "a").join(reps.select(F.col("c").alias("b"), F.col("rep").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        found = keep(full_sets(buckets.select("c").distinct(), classes, docs, key, text), "sets")
        links = ends(confirmed(stars, found))
        # a key that comes with several texts joins their classes
        several = full.groupBy("id").agg(F.min("digest").alias("d"), F.max("digest").alias("e")).where("d <> e").select("id")
        links = links.unionByName(full.join(several, "id", "left_semi").join(classes.select("digest", "rep"), "digest").select(F.col("rep").alias("a"), F.col("id").alias("b")))
        labels = common.saved(connected(links)).select(F.col("node").alias("rep"), "component")
        of = keep(reps.join(labels, "rep", "left").select("c", "rep", F.coalesce("component", "rep").alias("component")), "of")

        mixed = mixed_buckets(buckets, of.select("c", "component"), hot)
        label = lambda side: of.select(F.col("c").alias(side), F.col("component").alias(f"c{side}"))
        more = across(mixed, classes, found).join(label("a"), "a").join(label("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        merged = connected(more).select(F.col("node").alias("component"), F.col("component").alias("merged"))
        of = of.join(merged, "component", "left").select("c", F.coalesce("merged", "component").alias("component"))
        of = classes.select("c", "digest").join(of, "c").select("digest", "component")

        held = full.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
        named = common.even_join(full, of, ["digest"], common.hot_keys(held, ["digest"])).select("id", "n_shingles", "component")
        bare = rows.where("digest is null or id is null").select("id", "n_shingles", F.col("id").alias("component"))
        # a row without words or key stands for itself, but for a key that also comes with words
        alone = bare.join(named.groupBy("id").agg(F.min("component").alias("shared")), "id", "left").select("id", "n_shingles", F.coalesce("shared", "component").alias("component"))
        out = named.unionByName(alone)
        return common.saved(out.select(F.col("id").alias(key), "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("component") == F.col("id"), F.lit(True)).alias("kept")))
    finally:
        files.delete(spark, folder)
