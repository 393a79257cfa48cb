"""Shards by proportional stratified interleaving, in DataFrame functions.

Rows of each source are shuffled by a seeded hash and ranked; a row's fractional rank is its rank in its source, moved by a part of one that the source's place
among the others decides, over the number of the source's rows. In the order of fractional ranks any stretch has every source in proportion,
so equal cuts give shards that match the mixture, with counts at most one apart. The part of one spreads sources of few rows, which would otherwise meet
in one place.

Null sources count as the source ''. Null texts have no bytes; repeated rows and equal texts are rows like others and are spread like others. Null
``doc_id`` are rows like others. Empty tables give no rows. Extra columns of any name are left alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.ranks import in_order, numbered, within
from codequarry.sources.scratch import release, stage, write_once

#: Bytes that a row takes besides its text.
OVERHEAD = 16
#: The golden ratio's fractional part, in parts of 2 to the 32.
GOLDEN = 2654435769


def _measured(docs: DataFrame) -> list:
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    return [F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), (F.octet_length(raw) + OVERHEAD).cast("long").alias("size"), F.crc32(raw).alias("text_crc32")]


def places(docs: DataFrame, shards: int, seed: int = 2024) -> DataFrame:
    """``doc_id``, ``source``, ``size``, ``text_crc32``, ``row``, ``shard`` (from 0) and ``slot`` (from 0, without gaps in a shard), a row each. Texts don't move."""
    return _cut(numbered(docs.select(*_measured(docs)), "shard-rows"), shards, seed)


def write_shards(docs: DataFrame, path: str, shards: int, seed: int = 2024) -> None:
    """Write all columns of ``docs``, as a struct ``doc``, with ``slot`` into folders ``shard=..``: files in order of ``slot``, several for a large shard.

    The corpus is written once with numbers of its rows, as rows may be equal; texts are shuffled twice, to their places and into order.
    """
    rows = numbered(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), *_measured(docs)), "shard-texts")
    placed = _cut(rows.drop("doc"), shards, seed).select("row", "shard", "slot")
    ordered = rows.select("row", "doc").join(placed, "row").select("shard", "slot", "doc").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    write_once(ordered, path, "shard")
    release(rows)


def _cut(rows: DataFrame, shards: int, seed: int) -> DataFrame:
    """``rows`` (``doc_id``, ``source``, ``size``, ``text_crc32``, ``row``) with ``shard`` and ``slot``."""
    if shards < 1:
        raise ValueError("there must be a shard")
    shuffled = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text_crc32", F.lit(seed))
    by_source = in_order(rows.withColumn("__h", shuffled), F.col("source"), F.col("__h"), F.col("row"), label="by-source").drop("__h")
    # Multiples of the golden ratio, without their whole part: those of sources in a row are evenly spread.
    part_of_one = F.expr(f"(((first % {1 << 31}L) * {GOLDEN}L) % {1 << 32}L) / {1 << 32}D")
    at = (F.col("place") - F.col("first") + part_of_one) / F.col("size")
    by_source = within(by_source.withColumnRenamed("size", "bytes"), "source")
    ranked = by_source.select(*(F.col("bytes" if c == "size" else c).alias(c) for c in rows.columns), at.alias("__at"))
    mixed = in_order(stage(ranked, "fractional-ranks"), F.col("__at"), F.xxhash64("source", F.lit(seed)), F.col("row"), label="interleaved")
    total = rows.count()
    first = F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")
    cut = mixed.withColumn("shard", F.expr(f"cast((place * {shards}L) div {max(total, 1)}L as int)"))
    return cut.withColumn("slot", F.col("place") - first).select(*rows.columns, "shard", "slot")
