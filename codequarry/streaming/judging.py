"""A judge over a stream of pairs: each pair gets one verdict, whatever is lost or delivered again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codequarry.functions.columns import smell_code
from codequarry.functions.rowwise import with_kernel
from codequarry.operators import sample
from codequarry.sources.sinks import BatchLog

#: What a judge is given and what it answers. It runs on executors, a pair at a time.
Judge = Callable[[str, str, str], str]
PENDING = "id string, smell_type string, before_code string, after_code string"
ANSWER = "id string, smell_type string, response string"


def answered(pairs: DataFrame, judge: Judge) -> DataFrame:
    """``id``, ``smell_type`` and ``response`` of pairs; the smell is given as its code. An answer that fails is null: the pair stays pending."""

    def ask(smell: str, before: str | None, after: str | None) -> str | None:
        try:
            return judge(smell, before or "", after or "")
        except Exception:  # as with a judge that doesn't answer: the pair is asked for again
            return None

    named = pairs.select("id", smell_code("smell_type").alias("smell_type"), "before_code", "after_code")
    return with_kernel(named, "response", ask, "string", "smell_type", "before_code", "after_code").select("id", "smell_type", "response")


def verdicts_of(batch: DataFrame, log: BatchLog, judge: Judge | None) -> DataFrame:
    """Verdicts of the pairs of a batch that have none; an id that comes twice counts once, and rows without an id don't."""
    rows = batch.filter(F.col("id").isNotNull())
    if judge is None:
        rows = rows.filter(F.col("response").isNotNull()).groupBy("id").agg(F.min(F.struct("smell_type", "response")).alias("r")).select("id", "r.*")
    else:
        rows = rows.groupBy("id").agg(F.min(F.struct("smell_type", "before_code", "after_code")).alias("r")).select("id", "r.*")
    done = log.read()
    if done is not None:
        rows = sample.pending(rows, done)
    if judge is not None:
        rows = answered(rows, judge).filter(F.col("response").isNotNull())
    return sample.judged(rows)


def follow(pairs: DataFrame, log: BatchLog, checkpoint: str, judge: Judge | None = None) -> StreamingQuery:
    """Judge what has come to the stream ``pairs`` since the last run with this ``checkpoint``, then stop.

    Pairs are ``PENDING``, or ``ANSWER`` if the answers are there already and there is no ``judge``. Verdicts of a batch and the fact that it is done come into the log in one step, so a run that is lost
    before that judges the batch again, and one that is lost after it does not. A pair that comes again in a later batch, or by another stream, has its
    verdict already and isn't judged; only ids of the log are read for that. How much is asked again after a loss is one batch: limit it by the source's
    ``maxFilesPerTrigger`` or ``maxBytesPerTrigger``. Pairs whose judge failed have no verdict and are asked again when they come again.
    """
    spark = pairs.sparkSession

    def judge_batch(batch: DataFrame, number: int) -> None:
        stream = spark.read.json(f"{checkpoint}/metadata").first().id
        if not log.has(stream, number):
            log.append(verdicts_of(batch, log, judge), stream, number)

    return pairs.writeStream.foreachBatch(judge_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
