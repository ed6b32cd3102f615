"""URL filters: rules on a host and its subdomains and on the start of the path.

Each URL is expanded into (host suffix, path prefix) expressions. Their short hash prefixes
meet the rules' in an equi-join; a full digest then confirms, and the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import common

#: Bytes of the digest that the equi-join uses.
PREFIX_BYTES = 4
#: Rules are broadcast up to so many rows; beyond, they are joined by a shuffle.
BROADCAST_RULES = 100_000


def lowered(text: Column) -> Column:
    """A-Z lower-cased, other letters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return lowered(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def expression(host: Column, path: Column) -> Column:
    """What is hashed: lengths keep host and path apart whatever their characters."""
    return F.concat_ws(":", F.octet_length(host).cast("string"), host, path)


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict; columns of these names are replaced, others kept.

    ``rules``: host, path, verdict. A rule fits its host and all subdomains if the path starts
    with the rule's. The rule with the longest host and path together wins (then the longest
    host; then ``block`` before ``allow``). Where none fits, rule is null and the verdict is
    ``default``. A null URL, or one without ``://``, has an empty host and path and fits none.
    Rules with a null host or path count as empty strings; rules with an empty host fit none.
    Repeated rows and rules change nothing.

    Rules' hosts are lower-cased as pages' are, A-Z alone. Only distinct (host, start of path)
    pairs are expanded, by as many characters as the longest rule has, so a host with a third of
    all pages is expanded once a path start; pages of a pair that very many share are dealt out
    over many tasks.
    """
    clash = {"host", "path", "rule", "verdict"}
    rows = pages.drop(*[c for c in pages.columns if c.lower() in clash and c != url])
    rows = rows.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    rules = rules.select(F.coalesce(lowered(F.col("host")), F.lit("")).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), "verdict").where("rule_host <> ''").groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("verdict"))
    rules = common.saved(rules)
    bounds = rules.agg(F.count(F.lit(1)).alias("n"), F.max(F.length("rule_path")).alias("longest"), F.sort_array(F.collect_set(F.length("rule_path"))).alias("lengths"), F.max(F.size(F.split("rule_host", r"\."))).alias("labels")).first()
    if not bounds.n:
        return rows.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    digest = F.sha2(expression(F.col("rule_host"), F.col("rule_path")), 256)
    rules = rules.withColumns({"digest": digest, "short": F.substring(digest, 1, 2 * PREFIX_BYTES)})
    head, best_of = common.free_name(rows, "start"), common.free_name(rows, "best")
    rows = rows.withColumn(head, F.substring("path", 1, bounds.longest))
    keys = common.saved(rows.where("host <> ''").groupBy("host", F.col(head).alias("start")).agg(F.count(F.lit(1)).alias("n")))
    hot = common.hot_keys(keys, ["host", "start"])
    labels = F.split("host", r"\.")
    # suffixes of at most as many labels as any rule has; prefixes of the lengths that rules have
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(bounds.labels))), lambda k: F.array_join(F.slice(labels, F.size(labels) - k + 1, k), "."))
    lengths = F.array(*[F.lit(n) for n in bounds.lengths])
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length("start")), lambda n: F.substring(F.col("start"), F.lit(1), n))
    spread = keys.withColumn("suffix", F.explode(suffixes)).withColumn("prefix", F.explode(prefixes))
    digest = F.sha2(expression(F.col("suffix"), F.col("prefix")), 256)
    spread = spread.select("host", "start", F.substring(digest, 1, 2 * PREFIX_BYTES).alias("short"), digest.alias("full"))
    side = F.broadcast(rules) if bounds.n <= BROADCAST_RULES else rules
    found = spread.join(side, "short").where("full = digest")
    order = F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"), F.col("verdict"))
    best = found.groupBy("host", "start").agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), F.col("verdict").alias("verdict")), order).alias("best"))
    best = best.select("host", F.col("start").alias(head), F.col("best").alias(best_of))
    out = common.even_join(rows, best, ["host", head], hot.withColumnRenamed("start", head), "left")
    return out.withColumns({"rule": F.col(f"{best_of}.rule"), "verdict": F.coalesce(f"{best_of}.verdict", F.lit(default))}).drop(head, best_of)


#: The rules of the registered query.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")
