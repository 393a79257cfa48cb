"""Names for rows that have no unique column, columns of the caller's out of the way, and joins on keys of any frequency."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Column of the key in tables that are an operator's own.
KEY = "row_key"
#: A key is hot if it has more than one in so many of a table's rows: so there are at most so many hot keys.
HOT = 1000


def row_key() -> Column:
    """128 bits of ``doc_id`` and ``text``: equal for rows equal in both (null and empty texts count as equal)."""
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("binary"))


def keyed(docs: DataFrame) -> DataFrame:
    """``row_key`` and ``row``, all columns of the caller's under names that can't clash with an operator's."""
    return docs.select(row_key().alias(KEY), F.struct(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns))).alias("row"))


def unkeyed(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*(F.col(f"row.c{k}").alias(c) for k, c in enumerate(columns)))


def join_skewed(left: DataFrame, right: DataFrame, key: str, sizes: DataFrame, total: int) -> DataFrame:
    """``left`` joined with ``right``, which has one row for each ``key``; ``sizes`` has the rows ``n`` of ``left`` by key, ``total`` their sum.

    Rows of hot keys, of which there are at most ``HOT``, meet their row of ``right`` by broadcast; the others are shuffled, in parts that no key dominates.
    """
    hot = sizes.filter(F.col("n") > total // HOT).select(key)
    few = F.broadcast(right.join(F.broadcast(hot), key, "left_semi"))
    return left.join(few, key).unionByName(left.join(F.broadcast(hot), key, "left_anti").join(right, key))


def may_be_among(keys: DataFrame, key: str) -> Column:
    """Whether a row's ``key`` may be one of ``keys`` (a table of distinct ones): true for all that are, and for few others, so that an exact join needs to shuffle few rows in vain.

    Two bits of each key in a table of eight to sixteen bits a key (a Bloom filter), which Spark makes; only that goes to the driver and to all tasks.
    """
    bits = 1 << max(10, (8 * keys.count() - 1).bit_length())
    at = [F.pmod(F.xxhash64(F.lit(seed), key), F.lit(bits)) for seed in (1, 2)]
    word = keys.select(F.explode(F.array(*at)).alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("bits"))
    table, found = np.zeros(bits // 64, np.uint64), word.toArrow()
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)

    @F.arrow_udf("boolean")
    def held(one: pa.Array, two: pa.Array) -> pa.Array:
        both = [table[x >> 6] >> (x & 63).astype(np.uint64) & np.uint64(1) for x in (one.to_numpy(), two.to_numpy())]
        return pa.array((both[0] & both[1]).astype(bool))

    return held(*at)
