"""Registration of queries and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Tables:
    """The tables of a folder, read when named, and stand-ins: SQL that Spark and the oracle share."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name in STAND_INS:
            return self.sql(STAND_INS[name])
        raise AttributeError(name)

    def sql(self, text: str) -> DataFrame:
        import re

        named = {t: getattr(self, t) for t in TABLES if re.search(rf"\b{t}\b", text)}
        for t in named:
            text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
        return self.spark.sql(text, **named)


#: Tables in the shape of the domain's, made of the driver's. Both engines run this SQL.
STAND_INS = {
    # scored candidates: many ties, one class column
    "pool": "SELECT o_orderkey AS image_id, o_orderpriority AS dx, CAST((o_orderkey * 7919) % 1009 AS DOUBLE) / 1009 AS score, o_custkey AS group_id FROM orders",
    # safety flags of the same candidates; some rows are missing, some flags null
    "flags": "SELECT o_orderkey AS image_id, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderkey % 11 <> 0 END AS valid, o_orderkey % 17 = 0 AS duplicate FROM orders WHERE o_orderkey % 19 <> 0",
    # real rows per class
    "real_counts": "SELECT c_mktsegment AS dx, count(*) AS n FROM customer GROUP BY c_mktsegment",
    # scores with a partly missing binary truth; label is what metrics are grouped by
    "scored": "SELECT d.doc_id AS row_id, d.lang AS label, d.source AS patient_id, CAST((d.doc_id * 7919) % 1009 AS DOUBLE) / 1009 AS score, l.quality AS target, l.quality IS NOT NULL AS mask FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    # multi-class predictions of three seeds
    "predictions": "SELECT o_orderkey AS image_id, o_custkey AS lesion_id, seed, CAST(substr(o_orderpriority, 1, 1) AS INT) - 1 AS true_class, CASE WHEN (o_orderkey * 31 + seed * 17) % 10 < 4 THEN CAST(substr(o_orderpriority, 1, 1) AS INT) - 1 ELSE CAST((o_orderkey * 13 + seed * 7) % 5 AS INT) END AS predicted, CASE WHEN seed = 1 THEN 'A' WHEN seed = 2 THEN 'B' ELSE 'C' END AS condition FROM orders CROSS JOIN (SELECT 1 AS seed UNION ALL SELECT 2 UNION ALL SELECT 3) s",
    # rows of patients with a ternary label: 1, 0, -1 or blank
    "ternary": "SELECT event_id AS row_id, user_id AS patient_id, event_type AS label, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 5 = 0 THEN -1 WHEN value > 10 THEN 1 ELSE 0 END AS raw FROM events",
    # design by repeats
    "repeats": "SELECT l_suppkey AS subset_id, l_linenumber AS seed, avg(l_quantity) AS y FROM lineitem GROUP BY l_suppkey, l_linenumber",
    # measured subsets and their members
    "subsets": "SELECT o_orderkey AS subset_id, o_totalprice / 1000 AS utility FROM orders",
    "members": "SELECT DISTINCT l_orderkey AS subset_id, l_partkey % 50 AS image_id FROM lineitem",
}


def register(name: str, oracle: str | None = None):
    """Decorator: ``f(t: Tables) -> DataFrame`` becomes query ``name``.

    In ``oracle``, the stand-ins it names are put before it as common table expressions.
    """

    def put(f):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = with_stand_ins(oracle)
        return f

    return put


def with_stand_ins(sql: str) -> str:
    import re

    used = [s for s in STAND_INS if re.search(rf"\b{s}\b", sql)]
    heads = [f"{s} AS ({STAND_INS[s]})" for s in used]
    body = sql.strip()
    if not heads:
        return body
    if m := re.match(r"WITH\s+(RECURSIVE\s+)?", body, re.I):
        return f"WITH {m[1] or ''}{', '.join(heads)}, {body[m.end():]}"
    return f"WITH {', '.join(heads)} {body}"
