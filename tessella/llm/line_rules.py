"""Quality rules: per-document counts, and lines that too many documents of a host share.

Lines are normalised (lower case, white space squeezed) and hashed; the number of distinct
documents of a host that hold a line is counted over the whole table, lines above the limit
are removed, and documents that lose most of their words are rejected. All of it is built
from DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm import common

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: A line is removed if more distinct documents of its host than this hold it, however large the host
#: is: prose doesn't repeat whole lines over dozens of documents, boilerplate does, and a share of the
#: host would let it pass the more easily the larger the host is.
MOST_DOCS = 20
#: A document is rejected if it keeps a smaller share of its words.
LEAST_KEPT = 0.3
#: And if it fails a base rule: too few words, or too many (percent) in repeated windows.
LEAST_WORDS, MOST_REPEATED = 20, 30


def let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(common.WORD), F.lit(0))


def lines_of(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(common.WORD))


def line_hash(line: Column) -> Column:
    return F.xxhash64(F.trim(F.regexp_replace(F.lower(line), SPACE + "+", " ")))


def repeated_words(words: Column) -> Column:
    """Number of words inside windows of eight words that the text has at least twice.

    Windows are hashed from their words' hashes by doubling (two, four, eight words). Only
    texts with equal hashes go on: windows sorted by hash, those with an equal neighbour,
    their places in order, and the length of the union of the windows there.
    """

    def joined(a: Column, step: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(a) - step - 1), lambda i: F.xxhash64(F.get(a, i), F.get(a, i + step)))

    def covered(hashes: Column) -> Column:
        def alike(s: Column) -> Column:
            near = lambda e, k: F.coalesce(F.get(s, k)["h"] == e["h"], F.lit(False))
            return F.filter(s, lambda e, i: near(e, i - 1) | near(e, i + 1))

        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        places = let(pairs, lambda s: F.sort_array(F.transform(alike(s), lambda e: e["i"])))
        gaps = lambda p: F.transform(F.sequence(F.lit(0), F.size(p) - 2), lambda k: F.least(F.lit(WINDOW), F.get(p, k + 1) - F.get(p, k)))
        return let(places, lambda p: F.aggregate(gaps(p), F.lit(WINDOW), lambda a, x: a + x))

    def of(w: Column) -> Column:
        eights = let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: let(joined(h, 1), lambda p: let(joined(p, 2), lambda q: joined(q, 4))))
        some = let(eights, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g)))
        return F.when(F.size(w) <= WINDOW, F.lit(0)).otherwise(some)

    return let(words, of)


def counts(text: Column) -> dict[str, Column]:
    """The base counts of a text (a null counts as empty), all long."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    words, lines = words_of(text), lines_of(text)
    bare = F.translate(text, "\t\n\x0b\x0c\r ", "")
    out = {
        "n_words": F.size(words),
        "word_chars": F.length(bare),
        "n_symbols": F.length(bare) - F.length(F.translate(bare, SYMBOLS, "")),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_repeat_words": repeated_words(words),
    }
    return {k: v.cast("long") for k, v in out.items()}


def frequent_lines(docs: DataFrame, text: str = "text", host: str = "source", most_docs: int = MOST_DOCS) -> tuple[DataFrame, DataFrame]:
    """For each distinct document with lines above the limit: host, doc (digest of the text), lines (their hashes), lost (their words).

    And hot documents (see ``common.hot_keys``). Documents of a host with equal texts count once. A
    null host is a host of its own. A line is above the limit if more than ``most_docs`` distinct
    documents of the host hold it.
    """
    whole = common.text_or_empty(text)
    hashes = F.transform(lines_of(whole), lambda x: F.struct(line_hash(x).alias("h"), F.regexp_count(x, F.lit(common.WORD)).alias("w")))
    each = docs.select(F.coalesce(F.concat(F.lit("h"), F.col(host).cast("string")), F.lit("")).alias("host"), F.md5(whole).alias("doc"), hashes.alias("all"))
    each = common.saved(each.groupBy("host", "doc").agg(F.first("all").alias("all"), F.count(F.lit(1)).alias("n")))
    spread = each.select("host", F.explode(F.array_distinct("all.h")).alias("line"))
    above = common.saved(spread.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most_docs))
    lines = each.select("host", "doc", F.explode("all").alias("l")).select("host", "doc", F.col("l.h").alias("line"), F.col("l.w").alias("w"))
    lines = common.even_join(lines, above.drop("n"), ["host", "line"], common.hot_keys(above, ["host", "line"]), "left_semi")
    return lines.groupBy("host", "doc").agg(F.collect_set("line").alias("lines"), F.sum("w").alias("lost")), common.hot_keys(each, ["host", "doc"])


def judge(docs: DataFrame, text: str = "text", host: str = "source", cleaned: str = "cleaned_text", least_kept: float = LEAST_KEPT, **limits) -> DataFrame:
    """``docs`` with the base counts, base_failed, n_kept_words, kept and the text without lines above the limit.

    A document without words fails the base rules. Rows, repeated ones included, stay as many as
    they are; columns of the names added are replaced, others kept. An empty table gives no rows.
    Removed words are counted where lines are, so texts take part in a join only if the cleaned text
    is asked for; lines and documents that very many rows share are dealt out over many tasks.
    """
    whole = common.text_or_empty(text)
    made = counts(F.col(text))
    added = {*made, "base_failed", "kept", "n_kept_words", cleaned}
    rows = docs.drop(*[c for c in docs.columns if c.lower() in added and c not in (text, host)])
    found, hot = frequent_lines(docs.select(*dict.fromkeys([text, host])), text, host, **limits)
    key, here, lines, lost = (common.free_name(rows, x) for x in ("key", "here", "lines", "lost"))
    rows = rows.withColumns(made | {key: F.md5(whole), here: F.coalesce(F.concat(F.lit("h"), F.col(host).cast("string")), F.lit(""))})
    found = found.select(F.col("host").alias(here), F.col("doc").alias(key), F.col("lines").alias(lines), F.col("lost").alias(lost))
    rows = common.even_join(rows, found, [here, key], hot.select(F.col("host").alias(here), F.col("doc").alias(key), "salts_"), "left").drop(here, key)
    rows = rows.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))
    rest = F.filter(F.split(whole, "\n"), lambda x: ~F.array_contains(F.col(lines), line_hash(x)))
    rows = rows.withColumns({"n_kept_words": F.col("n_words") - F.coalesce(lost, F.lit(0)), cleaned: F.when(F.col(lines).isNotNull(), F.array_join(rest, "\n")).otherwise(whole)})
    verdict = ~F.col("base_failed") & (F.col("n_kept_words") >= F.col("n_words") * F.lit(least_kept))
    return rows.withColumn("kept", verdict).drop(lines, lost)
