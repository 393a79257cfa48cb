"""Queries of human review over pairs and verdicts derived from labels, documents and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.functions import registry
from codequarry.operators import review
from codequarry.plans.corpus import table

REVIEWERS = ["ana", "bo", "cy"]


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    return table(spark, sf_dir, "labels").select(
        k.cast("string").alias("id"), F.concat(F.lit("R"), (k % 5 + 1).cast("string")).alias("smell_type"), F.lit("old").alias("before_code"), F.lit("new").alias("after_code"),
    )


def _reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three verdicts a pair, of which every fourth is missing; a cut lacks one side for odd ids."""
    status = F.array(*map(F.lit, review.STATUS))
    k = F.col("doc_id")
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("reviewer"), F.lit(i).alias("i")) for i, n in enumerate(REVIEWERS))))
    rows = table(spark, sf_dir, "labels").select("doc_id", "quality", each.alias("r")).filter((k + F.col("r.i")) % 4 != 0)
    verdict = F.element_at(status, (F.floor((k + F.col("r.i") * (F.col("quality") + 1)) / 2) % 3 + 1).cast("int"))
    return rows.select(k.cast("string").alias("id"), "r.reviewer", verdict.alias("status"), F.lit("cut old").alias("before_clean"), F.when(k % 2 == 0, "cut new").otherwise(" ").alias("after_clean"))


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.assign_blocks(_pairs(spark, sf_dir).withColumnRenamed("smell_type", "smell"), REVIEWERS)


def latest_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("reviewer"), "value", "event_id")
    return review.latest(log, ["id", "reviewer"], ["event_id"]).select("id", "reviewer", "value")


def verdict_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        k, F.when(k % 11 > 0, k.cast("string")).alias("id"), F.when(k % 7 > 0, "R1").otherwise(" ").alias("smell"),
        F.element_at(F.array(*map(F.lit, [*review.STATUS, "maybe"])), (k % 4 + 1).cast("int")).alias("status"),
        F.when(k % 3 == 0, "because").otherwise("\t").alias("justificativa"), F.when(k % 5 == 0, "certain").when(k % 5 == 1, "alta").alias("confianca"),
    )
    return review.verdict_errors(rows).select("event_id", "error")


def single_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _reviews(spark, sf_dir).filter("reviewer = 'ana'")
    return review.single_review(_pairs(spark, sf_dir), own)


def double_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.double_review(_pairs(spark, sf_dir), _reviews(spark, sf_dir), _blocks(spark, sf_dir))


def visible_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.visible(_pairs(spark, sf_dir), _blocks(spark, sf_dir), _reviews(spark, sf_dir), "bo").select("id", "smell_type", "status")


def divergent_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.visible(_pairs(spark, sf_dir), _blocks(spark, sf_dir), _reviews(spark, sf_dir), "cy", adjudicate=True).select("id", "status")


def review_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.progress(review.visible(_pairs(spark, sf_dir), _blocks(spark, sf_dir), _reviews(spark, sf_dir), "ana"))


def block_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir)


def kappa_by_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.agreement(_blocks(spark, sf_dir), _reviews(spark, sf_dir)).withColumn("kappa", F.round("kappa", 6))


def kappa_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of an order's priority with a second rating, by group of customers, called from SQL."""
    registry.register(spark)
    table(spark, sf_dir, "orders").createOrReplaceTempView("codequarry_orders")
    return spark.sql(
        """WITH rated AS (SELECT o_custkey % 7 AS g, left(o_orderpriority, 1) AS a, CASE WHEN o_orderkey % 3 = 0 THEN left(o_orderpriority, 1) WHEN o_orderkey % 17 > 0 THEN cast(o_orderkey % 5 + 1 AS string) END AS b FROM codequarry_orders)
           SELECT g, kappa_of(approx_top_k(rated(a, b), 1000, 10000), count(*)) AS kappa FROM rated GROUP BY g"""
    ).withColumn("kappa", F.round("kappa", 6))


def repo_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    repo = F.when(k % 50 > 0, F.concat("source", (k % 3).cast("string")))
    rows = table(spark, sf_dir, "documents").select(k.cast("string").alias("id"), repo.alias("repo"), F.concat(F.lit("R"), (k % 5 + 1).cast("string")).alias("smell_type"))
    return review.split_by_repo(rows).select("id", "split")


def validated_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = review.schema_errors(_drafts(spark, sf_dir))
    return rows.select("k", F.array_join("errors", "; ").alias("errors"))


def _drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        k.alias("k"), F.when(k % 7 > 0, F.col("source")).alias("repo"), F.lit("c").alias("commit_hash"), F.when(k % 5 == 0, "R7").otherwise("R1").alias("smell_type"),
        F.when(k % 3 == 0, F.concat(F.repeat(F.lit("x = 1\n"), (k % 4).cast("int")), F.lit("x = "))).otherwise("x = 1").alias("before_code"), F.when(k % 4 == 0, " \n").otherwise("x = 2").alias("after_code"), F.when(k % 9 == 0, "elsewhere").alias("source"),
    )


def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.validation_report(review.schema_errors(_drafts(spark, sf_dir)))


QUERIES = {
    f.__name__: f
    for f in (
        latest_verdict, verdict_rules, single_review, double_review, visible_pairs, divergent_pairs, review_progress, block_assignment, kappa_by_block, kappa_in_sql, repo_split, validated_pairs, validation_report,
    )
}

_REVIEW = """
WITH pairs AS (SELECT doc_id, quality, CAST(doc_id AS VARCHAR) AS id, 'R' || (doc_id % 5 + 1) AS smell_type FROM labels),
reviews AS (
  SELECT id, doc_id, reviewer, (['clean', 'noisy', 'rejected'])[((doc_id + i * (quality + 1)) // 2) % 3 + 1] AS status, doc_id % 2 = 0 AS cut
  FROM pairs, (VALUES ('ana', 0), ('bo', 1), ('cy', 2)) r(reviewer, i) WHERE (doc_id + i) % 4 <> 0
), placed AS (SELECT *, (row_number() OVER (PARTITION BY smell_type ORDER BY sha1('42|' || id), id) - 1) % 3 AS b FROM pairs),
blocks AS (SELECT id, smell_type AS smell, 'B' || (b + 1) AS block, (['ana', 'bo', 'cy'])[b + 1] AS first, (['bo', 'cy', 'ana'])[b + 1] AS second, (['cy', 'ana', 'bo'])[b + 1] AS adjudicator FROM placed),
judged AS (
  SELECT b.*, v1.status AS s1, v2.status AS s2, v3.status AS s3, v3.cut AS cut3 FROM blocks b
  LEFT JOIN reviews v1 ON v1.id = b.id AND v1.reviewer = first LEFT JOIN reviews v2 ON v2.id = b.id AND v2.reviewer = second LEFT JOIN reviews v3 ON v3.id = b.id AND v3.reviewer = adjudicator
), differ AS (SELECT * FROM judged WHERE s1 IS NOT NULL AND s2 IS NOT NULL AND NOT (s1 = s2 AND s1 <> 'noisy'))
"""
_DRAFTS = """
WITH e AS (
  SELECT doc_id AS k, list_filter([
    CASE WHEN doc_id % 7 = 0 OR source IS NULL THEN 'repo is missing' END, CASE WHEN doc_id % 4 = 0 THEN 'after_code is empty' END, CASE WHEN doc_id % 5 = 0 THEN 'unknown smell_type' END,
    CASE WHEN doc_id % 9 = 0 THEN 'unknown source' END, CASE WHEN doc_id % 3 = 0 THEN 'before_code doesn''t parse at line ' || (doc_id % 4 + 1) END], lambda x: x IS NOT NULL) AS errors FROM documents
)
"""

ORACLE_SQL = {
    "latest_verdict": """
SELECT user_id AS id, CASE WHEN event_type <> 'view' THEN event_type END AS reviewer, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1""",
    "verdict_rules": """
SELECT event_id, CASE WHEN event_id % 11 = 0 OR event_id % 7 = 0 THEN 'smell and id are required' WHEN event_id % 4 = 3 THEN 'unknown status'
  WHEN event_id % 4 IN (1, 2) AND event_id % 3 <> 0 THEN 'a reason is required' WHEN event_id % 5 = 0 THEN 'unknown confidence' END AS error FROM events""",
    "single_review": _REVIEW
    + """SELECT id, p.smell_type, CASE WHEN status = 'noisy' THEN 'cut old' ELSE 'old' END AS before_code, CASE WHEN status = 'noisy' THEN 'cut new' ELSE 'new' END AS after_code
FROM pairs p JOIN reviews r USING (id) WHERE reviewer = 'ana' AND (status = 'clean' OR (status = 'noisy' AND cut))""",
    "double_review": _REVIEW
    + """SELECT id, smell AS smell_type, 'old' AS before_code, 'new' AS after_code FROM judged WHERE s1 = 'clean' AND s2 = 'clean'
UNION ALL SELECT id, smell, CASE WHEN s3 = 'noisy' THEN 'cut old' ELSE 'old' END, CASE WHEN s3 = 'noisy' THEN 'cut new' ELSE 'new' END FROM differ WHERE s3 = 'clean' OR (s3 = 'noisy' AND cut3)""",
    "visible_pairs": _REVIEW + "SELECT b.id, b.smell AS smell_type, r.status FROM blocks b LEFT JOIN reviews r ON r.id = b.id AND r.reviewer = 'bo' WHERE 'bo' IN (first, second)",
    "divergent_pairs": _REVIEW + "SELECT id, s3 AS status FROM differ WHERE adjudicator = 'cy'",
    "review_progress": _REVIEW
    + "SELECT count(*) AS total, count(r.status) AS reviewed, count(*) - count(r.status) AS pending FROM blocks b LEFT JOIN reviews r ON r.id = b.id AND r.reviewer = 'ana' WHERE 'ana' IN (first, second)",
    "block_assignment": _REVIEW + "SELECT * FROM blocks",
    "kappa_by_block": _REVIEW
    + """, rated AS (SELECT block, s1, s2 FROM judged WHERE s1 IS NOT NULL AND s2 IS NOT NULL),
n AS (SELECT block, count(*) AS n, count(*) FILTER (s1 = s2) / CAST(count(*) AS DOUBLE) AS po FROM rated GROUP BY 1),
labels_of AS (SELECT block, label, count(*) FILTER (side = 1) AS na, count(*) FILTER (side = 2) AS nb FROM (SELECT block, s1 AS label, 1 AS side FROM rated UNION ALL SELECT block, s2, 2 FROM rated) GROUP BY 1, 2),
chance AS (SELECT block, sum(na * nb) AS c, count(*) AS k FROM labels_of GROUP BY 1)
SELECT block, n, CASE WHEN n >= 2 AND k >= 2 THEN round((po - c / CAST(n * n AS DOUBLE)) / (1 - c / CAST(n * n AS DOUBLE)), 6) END AS kappa FROM n JOIN chance USING (block)""",
    "kappa_in_sql": """
WITH r AS (SELECT o_custkey % 7 AS g, left(o_orderpriority, 1) AS a, CASE WHEN o_orderkey % 3 = 0 THEN left(o_orderpriority, 1) WHEN o_orderkey % 17 > 0 THEN CAST(o_orderkey % 5 + 1 AS VARCHAR) END AS b FROM orders),
judged AS (SELECT * FROM r WHERE a IS NOT NULL AND b IS NOT NULL), n AS (SELECT g, count(*) AS n, count(*) FILTER (a = b) / CAST(count(*) AS DOUBLE) AS po FROM judged GROUP BY 1),
sides AS (SELECT g, label, count(*) FILTER (side = 1) AS na, count(*) FILTER (side = 2) AS nb FROM (SELECT g, a AS label, 1 AS side FROM judged UNION ALL SELECT g, b, 2 FROM judged) GROUP BY 1, 2),
chance AS (SELECT g, sum(na * nb) / CAST(any_value(n) * any_value(n) AS DOUBLE) AS pe, count(*) AS k FROM sides JOIN n USING (g) GROUP BY 1)
SELECT g, CASE WHEN n >= 2 AND k >= 2 THEN round((po - pe) / (1 - pe), 6) END AS kappa FROM (SELECT DISTINCT g FROM r) LEFT JOIN n USING (g) LEFT JOIN chance USING (g)""",
    "repo_split": """
WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 50 > 0 AND source IS NOT NULL THEN source || (doc_id % 3) ELSE 'no repository ' || doc_id END AS g FROM documents),
r AS (SELECT g, row_number() OVER (ORDER BY sha1('42|' || g), g) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT g FROM d))
SELECT id, CASE WHEN place < greatest(1, round_even(0.1 * n, 0)) THEN 'test' WHEN place < 2 * greatest(1, round_even(0.1 * n, 0)) THEN 'val' ELSE 'train' END AS split FROM d JOIN r USING (g)""",
    "validated_pairs": _DRAFTS + "SELECT k, array_to_string(errors, '; ') AS errors FROM e",
    "validation_report": _DRAFTS
    + "SELECT count(*) FILTER (len(errors) = 0) AS valid, count(*) FILTER (len(errors) > 0) AS invalid, round(100.0 * count(*) FILTER (len(errors) = 0) / greatest(count(*), 1), 1) AS pass_rate FROM e",
}
