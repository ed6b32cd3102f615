"""Spelling variants: words one edit apart, without ever forming the pairs.

Words are counted over all texts and ranked by count, most frequent first, so that of any set of
near words the preferred one has the least rank. For each place of a word there is a wildcard
group, named by (position, prefix, suffix): all words that differ from it there alone. A group
keeps its size and its two best words, which tell every member how many near words it has
in the group and which is the best other than itself. A word less one letter is met by the
vocabulary under the whole word's own name; that gives insertions and deletions alike. What the
groups say of a word is added up; so rows are as many as letters of the vocabulary, however many
words are near one another.

Groups are named by two 64-bit hashes in place of the strings, so a word's rows take space by its
length, not by the square of it. A collision of both has a chance below 1e-20 for a billion groups.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.frames import numbered
from tessella.llm import common
from tessella.llm.oracles import LOWER, UPPER

#: A run of letters, and what parts two of them.
LETTERS = r"A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: One run in so many loses a letter, as contract of the registered query.
DAMAGE = 199
WHOLE, SHORTER, WILD = 0, 1, 2
#: Letters to a batch of the vocabulary whose group names are made at once.
PIECE = 1 << 18


def runs(docs: DataFrame, key: str = "doc_id", text: str = "text", damage: int | None = None) -> DataFrame:
    """A row (word) for each run of letters of LEAST_LENGTH or more, A-Z lower-cased.

    ``damage``: where that divides the checksum of ``<key>:<run>``, the run loses the letter at
    checksum modulo length. A null key counts as an empty string there, a null text has no runs.
    """
    each = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), F.explode(F.split(common.text_or_empty(text), f"[^{LETTERS}]+")).alias("run")).where(F.length("run") >= LEAST_LENGTH)
    ascii_ = F.octet_length("run") == F.length("run")
    each = each.select("id", F.when(ascii_, F.lower("run")).otherwise(F.translate("run", UPPER, LOWER)).alias("run"))
    if damage is None:
        return each.select(F.col("run").alias("word"))
    each = each.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return each.select(F.when(F.col("h") % damage == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= LEAST_LENGTH)


def vocabulary(words: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """(rank, word, n): the words with ``least`` occurrences or more, numbered by count, ties by code points."""
    counts = common.saved(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least))
    return common.saved(numbered(counts, [F.desc("n"), F.asc("word")], "rank").select("rank", "word", "n"))


def names(words: list[str]):
    """Names of the groups of some words: (index of the word, kind, first hash, second hash) as arrays.

    A letter's hash depends on it and its place; a string's is the XOR of its letters'. Prefix and
    suffix hashes are running XORs, taken for all words at once. Of equal letters in a row, leaving
    out any gives the same string, so that's named once.
    """
    import numpy as np

    from tessella.llm.shingles import mixed

    n = np.array([len(w) for w in words], dtype=np.int64)
    letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    starts = np.cumsum(n) - n
    word = np.repeat(np.arange(len(words)), n)
    place = (np.arange(len(letters)) - starts[word]).astype(np.uint64)
    length = n[word].astype(np.uint64)
    out = []
    with np.errstate(over="ignore"):
        for seed in (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)):
            of = lambda at, s=seed: mixed(mixed((at + np.uint64(1)) * s) + letters * (s | np.uint64(1)))
            here, left = of(place), of(place - np.uint64(1))  # where a letter stands, and where it does once one before it has gone
            before = np.bitwise_xor.accumulate(np.concatenate((np.zeros(1, np.uint64), here)))
            moved = np.bitwise_xor.accumulate(np.concatenate((np.zeros(1, np.uint64), left)))
            i = np.arange(len(letters))
            prefix = before[i] ^ before[starts[word]]
            suffix = before[(starts + n)[word]] ^ before[i + 1]
            rest = moved[(starts + n)[word]] ^ moved[i + 1]
            size = lambda m, s=seed: mixed(m * s)
            wild = mixed(prefix ^ suffix ^ size(length)) + mixed(place + seed)
            shorter = mixed(prefix ^ rest ^ size(length - np.uint64(1)))
            whole = mixed(before[starts + n] ^ before[starts] ^ size(n.astype(np.uint64)))
            out.append((whole, shorter, wild))
    first = np.ones(len(letters), dtype=bool)
    first[1:] = (letters[1:] != letters[:-1]) | (word[1:] != word[:-1])
    parts = [(np.arange(len(words)), WHOLE, *(x[0] for x in out)), (word[first], SHORTER, *(x[1][first] for x in out)), (word, WILD, *(x[2] for x in out))]
    index, kind = np.concatenate([p[0] for p in parts]), np.concatenate([np.full(len(p[0]), p[1], dtype=np.int8) for p in parts])
    return index, kind, *(np.concatenate([p[k] for p in parts]).view(np.int64) for k in (2, 3))


def near(vocab: DataFrame) -> DataFrame:
    """(rank, n_near, best): how many words are near each that has some, and the least rank of those."""
    common.ship(vocab.sparkSession)

    def name(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            ranks, words = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            ends = np.cumsum([len(w) for w in words])
            cuts = [0, *(np.flatnonzero(np.diff(ends // PIECE)) + 1).tolist(), len(words)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a < b:
                    index, kind, one, two = names(words[a:b])
                    yield pa.record_batch([pa.array(one), pa.array(two), pa.array(kind), pa.array(ranks[a:b][index])], names=["one", "two", "kind", "rank"])

    rows = vocab.select("rank", "word").mapInArrow(name, "one long, two long, kind byte, rank long")
    group = Window.partitionBy("one", "two").orderBy("kind", "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"size": F.count(F.lit(1)).over(group), "whole": F.first("kind").over(group) == WHOLE, "top": F.first("rank").over(group), "next": F.nth_value("rank", 2).over(group)}).where("size > 1")
    kind, first = F.col("kind"), F.col("rank") == F.col("top")
    others = F.when(kind == SHORTER, F.when(F.col("whole"), F.lit(1).cast("long"))).otherwise(F.col("size") - 1)
    best = F.when((kind == WHOLE) | (kind == WILD) & first, F.col("next")).otherwise(F.col("top"))
    rows = rows.select("rank", others.alias("n_near"), best.alias("best")).where("n_near is not null")
    return rows.groupBy("rank").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(rank, root): from each rank along ``forms`` (rank, form) to the last, by doubling the steps.

    A form is more frequent than its word by a factor, so paths have no loops and a length by the
    logarithm of the largest count.
    """
    now = common.saved(forms.select("rank", F.col("form").alias("root")))
    while True:
        hot = common.hot_keys(now.groupBy("root").agg(F.count(F.lit(1)).alias("n")), ["root"])
        step = now.select(F.col("rank").alias("root"), F.col("root").alias("further"))
        met = common.saved(common.even_join(now, step, ["root"], hot, "left"))
        if not met.where("further is not null").limit(1).count():
            return now
        now = met.select("rank", F.coalesce("further", "root").alias("root"))


def variants(vocab: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Words with n, n_near, their form (near word of largest count, ties by code points, if ``ratio`` times as frequent), form_n and root."""
    rows = vocab.join(near(vocab), "rank", "left")
    best = vocab.select(F.col("rank").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    rows = rows.join(best, "best", "left").withColumn("fits", F.col("form_n") >= ratio * F.col("n"))
    rows = common.saved(rows.select("rank", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), *[F.when(F.col("fits"), F.col(c)).alias(c) for c in ("form", "form_n", "best")]))
    last = roots(rows.where("best is not null").select("rank", F.col("best").alias("form")))
    hot = common.hot_keys(last.groupBy("root").agg(F.count(F.lit(1)).alias("n")), ["root"])
    named = common.even_join(last, vocab.select(F.col("rank").alias("root"), F.col("word").alias("last")), ["root"], hot).select("rank", "last")
    return rows.join(named, "rank", "left").select("word", "form", F.coalesce("last", "word").alias("root"), "n", "n_near", "form_n")


def group(docs: DataFrame, key: str = "doc_id", text: str = "text", damage: int | None = None) -> DataFrame:
    """Spelling variants of the words of ``docs``: word, form, root, n, n_near, form_n.

    Null and empty texts have no words and an empty table gives no rows; repeated rows count
    again; a run of any length is one word. Other columns aren't read.
    """
    return variants(vocabulary(runs(docs, key, text, damage)))
