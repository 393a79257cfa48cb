"""Pairs and verdicts from files to what is kept: single or double review, by whether there is an assignment of blocks."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from codequarry.operators import review
from codequarry.sources import readers
from codequarry.sources.scratch import release, stage


@dataclass
class Curated:
    pairs: DataFrame
    #: Cohen's kappa by block, for double review.
    kappa: DataFrame | None
    #: How many pairs each file has, known after the first action on ``pairs``.
    raw: dict[str, Observation] = field(default_factory=dict)


def counted(rows: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``rows`` and how many there were, known after the next action on them; no pass of its own."""
    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def _smells(spark: SparkSession, raw: str) -> list[str]:
    """Names of the files ``<smell>.jsonl``."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(raw)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName().removesuffix(".jsonl") for f in fs.listStatus(folder) if f.getPath().getName().endswith(".jsonl")) if fs.exists(folder) else []


def read_curated(
    spark: SparkSession, raw: str, reviews: str, schema: str = readers.PAIR, allow_unreviewed: bool = False, use_assignment: bool = True, assignment: str | None = None
) -> Curated:
    """Pairs of the files ``<smell>.jsonl`` in ``raw`` that the verdicts in ``<smell>.reviews.jsonl`` keep.

    With an assignment of blocks (``assignment.json`` beside the verdicts by default) two reviewers and an adjudicator decide, else the one reviewer.
    A missing file of verdicts is an error: without review every pair would be dropped. ``allow_unreviewed`` takes those pairs as they are.
    """
    names = _smells(spark, raw)
    if not names:
        raise FileNotFoundError(f"no .jsonl files in {raw}")
    blocks = readers.assignment(spark, assignment or f"{reviews}/assignment.json") if use_assignment else None
    kept, log, seen = None, None, {}
    for name in names:
        pairs, seen[name] = counted(readers.json_lines(spark, f"{raw}/{name}.jsonl", schema), f"pairs of {name}")
        verdicts = readers.sidecar(spark, f"{reviews}/{name}.reviews.jsonl", strict=True)
        if verdicts is None and not allow_unreviewed:
            raise FileNotFoundError(f"no verdicts for {name} in {reviews}: review its pairs, or allow unreviewed ones")
        if verdicts is not None:
            rows = review.double_review(pairs, verdicts, blocks) if blocks is not None else review.single_review(pairs, _one_each(verdicts))
            log = verdicts if log is None else log.unionByName(verdicts)
        else:
            rows = pairs
        kept = rows if kept is None else kept.unionByName(rows)
    return Curated(kept, review.agreement(blocks, log) if blocks is not None and log is not None else None, seen)


def _one_each(verdicts: DataFrame) -> DataFrame:
    """The newest verdict of each pair, whoever gave it."""
    return review.latest(verdicts, ["id"], ["timestamp"])


def page(
    spark: SparkSession, raw: str, reviews: str, reviewer: str | None = None, adjudicate: bool = False, smell: str | None = None, status: str = "all", use_assignment: bool = True, schema: str = readers.PAIR
) -> tuple[DataFrame, DataFrame]:
    """What a reviewer sees: pairs with ``smell_file``, ``line`` and their own ``verdict``, and the totals before ``status`` (all, pending, reviewed) chooses among them.

    With an assignment and a reviewer they are the pairs of the reviewer's blocks, or the divergent ones to adjudicate; else all, with the verdict that the reviewer (or nobody named) gave. Malformed lines are skipped.
    """
    if status not in ("all", "pending", "reviewed"):
        raise ValueError(f"unknown status {status}")
    blocks = readers.assignment(spark, f"{reviews}/assignment.json") if use_assignment and reviewer is not None else None
    seen = None
    for name in [smell] if smell else _smells(spark, raw):
        pairs = readers.json_lines(spark, f"{raw}/{name}.jsonl", schema, strict=False, order=True).withColumn("smell_file", F.lit(name))
        log = readers.sidecar(spark, f"{reviews}/{name}.reviews.jsonl")
        log = spark.createDataFrame([], readers.REVIEW_LOG) if log is None else log
        own = log.filter(F.col("reviewer").eqNullSafe(F.lit(reviewer)))
        if blocks is not None:
            pairs = pairs.join(review.visible(pairs.select("id"), blocks, log, reviewer, adjudicate).select("id"), "id", "left_semi")
        given = own.select("id", F.struct("status", "before_clean", "after_clean", "notes", "justificativa", "confianca", "timestamp").alias("verdict"))
        rows = pairs.join(given, "id", "left").select("smell_file", *pairs.drop("smell_file").columns, "verdict")
        seen = rows if seen is None else seen.unionByName(rows)
    if seen is None:
        raise FileNotFoundError(f"no .jsonl files in {raw}")
    totals = review.progress(seen.withColumn("status", F.col("verdict.status")))
    chosen = {"all": F.lit(True), "pending": F.col("verdict").isNull(), "reviewed": F.col("verdict").isNotNull()}[status]
    return seen.filter(chosen), totals


def give_verdicts(reviews: str, smell: str, given: DataFrame) -> int:
    """Verdicts (any columns of ``readers.REVIEW_LOG``) into a smell's log, each in place of the last one of its pair and reviewer; how many the log has then.

    A verdict that breaks a rule (``review.verdict_errors``) is an error and nothing is written. The log is written anew beside the old one, which two renames replace. A run that is lost
    between them leaves ``<log>.old-..``, and no log: an error for those who read it, not a loss.
    """
    spark, log = given.sparkSession, f"{reviews}/{smell}.reviews.jsonl"
    types = {f.name: f.dataType for f in StructType.fromDDL(readers.REVIEW_LOG)}
    rows = given.withColumn("smell", F.lit(smell)).select(*((F.col(c) if c in (*given.columns, "smell") else F.lit(None)).cast(t).alias(c) for c, t in types.items()))
    if (bad := review.verdict_errors(rows).filter("error is not null").select("id", "error").first()) is not None:
        raise ValueError(f"{bad.id}: {bad.error}")
    before = readers.sidecar(spark, log)
    both = rows.withColumn("n", F.lit(1))
    if before is not None:
        both = both.unionByName(before.withColumn("n", F.lit(0)))
    merged = stage(review.latest(both, ["id", "reviewer"], ["n", "timestamp"]).drop("n"), "verdicts")
    mark = uuid.uuid4().hex
    merged.coalesce(1).write.json(f"{log}.new-{mark}")
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(log).getFileSystem(spark._jsc.hadoopConfiguration())
    if before is not None:
        fs.rename(path(log), path(f"{log}.old-{mark}"))
    if not fs.rename(path(f"{log}.new-{mark}"), path(log)):
        raise RuntimeError(f"{log} couldn't be replaced; its last state is in {log}.old-{mark}")
    fs.delete(path(f"{log}.old-{mark}"), True)
    n = merged.count()
    release(merged)
    return n
