"""Cross-site boilerplate lines by distinct-site spread, in DataFrame functions only.

A line, without spaces at its ends, is counted by the sites it is on: a HyperLogLog sketch per line hash, merged by
aggregation. Lines whose estimate is near the threshold get an exact distinct count; the rest are decided by the
sketch. Lines on at least ``min_sites`` sites are removed from every document but those that have no other line. A text counts for one of its
sites only, the first in order, so copies of a whole text don't make its lines boilerplate.

Lines under ``min_chars`` characters are kept. A null text stays null and has no lines; a null site is a site of its own (the empty
one). Repeated rows are kept and treated alike. Extra columns are returned unchanged, whatever their names, but for ones named like the two new ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.sources.scratch import stage

#: log2 of the sketch's registers, and the share of the threshold that counts as near: some ten standard errors.
REGISTERS, NEAR = 12, 0.2


def _clean(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def _row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def one_site_a_text(docs: DataFrame) -> DataFrame:
    """``docs`` without rows whose text is also on a site that comes before theirs."""
    site, text = F.coalesce("source", F.lit("")), F.xxhash64("text")
    sites = docs.select(text.alias("__text"), site.alias("__site")).groupBy("__text").agg(F.min("__site").alias("__first"), F.max("__site").alias("__last"))
    copied = stage(sites.filter("__first <> __last").select("__text", "__first"), "copied-texts")
    return docs.withColumn("__text", text).join(copied, "__text", "left").filter(F.col("__first").isNull() | (F.col("__first") == site)).select(*(F.col(f"`{c}`") for c in docs.columns))


def spread_lines(docs: DataFrame, min_sites: int = 8, min_chars: int = 20) -> DataFrame:
    """``h``, the hash of each line that is on at least ``min_sites`` sites."""
    lines = (
        docs.select(F.coalesce("source", F.lit("")).alias("site"), F.explode(F.split("text", "\n")).alias("line"))
        .select("site", _clean(F.col("line")).alias("line"))
        .filter(F.length("line") >= min_chars)
        .select(F.xxhash64("line").alias("h"), F.xxhash64("site").alias("site"))
    )
    sketched = lines.groupBy("h").agg(F.hll_sketch_agg("site", REGISTERS).alias("sketch")).select("h", F.hll_sketch_estimate("sketch").alias("sites"))
    likely = stage(sketched.filter(F.col("sites") >= min_sites * (1 - NEAR)), "spread-lines")
    sure = likely.filter(F.col("sites") > min_sites * (1 + NEAR)).select("h")
    near = likely.filter(F.col("sites") <= min_sites * (1 + NEAR)).select("h")
    exact = lines.join(near, "h", "left_semi").groupBy("h", "site").count().groupBy("h").count().filter(F.col("count") >= min_sites).select("h")
    return sure.union(exact)


def remove_boilerplate(docs: DataFrame, min_sites: int = 8, min_chars: int = 20) -> DataFrame:
    """``docs`` with cleaned ``text`` and two more columns, ``n_lines`` and ``n_removed``."""
    spread = stage(spread_lines(one_site_a_text(docs.select("source", "text")), min_sites, min_chars), "boilerplate")
    lines, extra = F.split("text", "\n"), [c for c in docs.columns if c not in ("doc_id", "text")]
    hashes = F.transform(lines, lambda x: F.xxhash64(_clean(x)))
    on_lines = docs.select(_row_key().alias("key"), F.explode(F.array_distinct(hashes)).alias("h"))
    found = on_lines.join(spread, "h").groupBy("key").agg(F.collect_set("h").alias("bad"))
    # Columns of the caller's are in a struct of their own, so none of their names can clash with one of these.
    rows = docs.select(_row_key().alias("key"), "doc_id", "text", F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(extra))).alias("rest"))
    marked = rows.join(found, "key", "left").withColumn("kept", F.when(F.col("bad").isNotNull(), F.filter(lines, lambda x: ~F.array_contains("bad", F.xxhash64(_clean(x))))))
    cut = F.coalesce(F.exists("kept", lambda x: _clean(x) != ""), F.lit(False))
    n_lines = F.when(F.col("text").isNotNull(), F.size(lines)).otherwise(0)
    named = {"doc_id": F.col("doc_id"), "text": F.when(cut, F.array_join("kept", "\n")).otherwise(F.col("text"))} | {c: F.col(f"rest.c{k}") for k, c in enumerate(extra)}
    named |= {"n_lines": n_lines, "n_removed": F.when(cut, n_lines - F.size("kept")).otherwise(0)}
    return marked.select(*(named[c].alias(c) for c in [*(c for c in docs.columns if c not in ("n_lines", "n_removed")), "n_lines", "n_removed"]))


#: The same for DuckDB over the documents table, exact counts throughout; digests stand for texts.
ORACLE_SQL = """
WITH one AS (SELECT text, min(coalesce(source, '')) AS site FROM documents WHERE text IS NOT NULL GROUP BY text),
spread AS (
  SELECT trim(line, ' ' || chr(9) || chr(13)) AS line FROM (SELECT site, unnest(string_split(text, chr(10))) AS line FROM one)
  WHERE length(trim(line, ' ' || chr(9) || chr(13))) >= 20
  GROUP BY 1 HAVING count(DISTINCT site) >= 8
), lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10))))) AS pos FROM documents
), marked AS (
  SELECT l.*, trim(l.line, ' ' || chr(9) || chr(13)) AS clean, s.line IS NOT NULL AS bad
  FROM lines l LEFT JOIN spread s ON trim(l.line, ' ' || chr(9) || chr(13)) = s.line
), docs AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (bad) AS n_bad, bool_or(bad) AND bool_or(NOT bad AND clean <> '') AS cut,
         string_agg(line, chr(10) ORDER BY pos) AS whole, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT bad), '') AS kept
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(CASE WHEN cut THEN n_bad ELSE 0 END AS BIGINT) AS n_removed,
       md5(CASE WHEN cut THEN kept WHEN n_lines IS NULL THEN NULL ELSE whole END) AS text_md5
FROM documents d LEFT JOIN docs USING (doc_id)
"""
