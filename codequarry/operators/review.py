"""Human review of pairs: verdict logs, blocks of reviewers, double review, agreement, validation and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.functions import kernels
from codequarry.functions.columns import SMELLS, is_blank
from codequarry.functions.rowwise import with_kernel

# Verdicts, those that need a reason, and degrees of confidence.
STATUS, NEEDS_REASON, CONFIDENCE = ["clean", "noisy", "rejected"], ["noisy", "rejected"], ["alta", "media", "baixa"]
SOURCES = ["mined_commit", "mined_pr", "adjacent_oracle", "translated_java", "cross_file", "rule_id_mined"]


def latest(log: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; null keys are keys too. A hot key is reduced before the shuffle.

    ``order`` decides; rows that are equal in it are told apart by their hash.
    """
    place = F.struct(*order, F.xxhash64(*log.columns).alias("tie"))
    rest = [c for c in log.columns if c not in key]
    newest = log.groupBy(*key).agg(F.max_by(F.struct(*rest), place).alias("row"))
    return newest.select(*key, "row.*").select(*log.columns)


def shuffle_rank(*keys: Column | str, seed: int = 42) -> Column:
    """A number that orders rows at random but always alike."""
    parts = [F.lit(str(seed)), *(F.coalesce(F.col(k) if isinstance(k, str) else k, F.lit("")).cast("string") for k in keys)]
    return F.sha1(F.concat_ws("|", *parts).cast("binary"))


def verdict_errors(reviews: DataFrame) -> DataFrame:
    """``reviews`` with ``error``, the first rule that a verdict breaks; null for a good one."""
    error = (
        F.when(is_blank("id") | is_blank("smell"), "smell and id are required")
        .when(~F.coalesce(F.col("status").isin(*STATUS), F.lit(False)), "unknown status")
        .when(F.col("status").isin(*NEEDS_REASON) & is_blank("justificativa"), "a reason is required")
        .when((F.coalesce("confianca", F.lit("")) != "") & ~F.col("confianca").isin(*CONFIDENCE), "unknown confidence")
    )
    return reviews.withColumn("error", error)


def _settled(status: Column, before: Column, after: Column) -> Column:
    """Whether a verdict keeps its pair: as it is, or with the reviewer's cut if both sides have one."""
    return (status == "clean") | ((status == "noisy") & ~is_blank(before) & ~is_blank(after))


def _with_cut(rows: DataFrame, verdict: str) -> DataFrame:
    cut = F.coalesce(F.col(f"{verdict}.status") == "noisy", F.lit(False))
    return rows.withColumns({f"{side}_code": F.when(cut, F.col(f"{verdict}.{side}_clean")).otherwise(F.col(f"{side}_code")) for side in ("before", "after")})


def single_review(pairs: DataFrame, reviews: DataFrame) -> DataFrame:
    """Pairs that their verdict keeps; the id stays, the code is the reviewer's cut where there is one. ``reviews``: one row an id."""
    verdicts = reviews.select("id", F.struct("status", "before_clean", "after_clean").alias("verdict"))
    kept = pairs.join(verdicts, "id").filter(_settled(F.col("verdict.status"), F.col("verdict.before_clean"), F.col("verdict.after_clean")))
    return _with_cut(kept, "verdict").select(*pairs.columns)


def _reviewed_twice(blocks: DataFrame, reviews: DataFrame, how: str = "inner") -> DataFrame:
    """``blocks`` (``id``, ``block``, ``first``, ``second``, ``adjudicator``) with the verdicts ``v1``, ``v2`` of both reviewers and ``v3`` of the adjudicator.

    One aggregation over the verdicts of a pair stands for three joins.
    """
    log = reviews.select("id", F.struct("reviewer", "status", "before_clean", "after_clean").alias("v"))
    gathered = blocks.join(log, "id", "left").groupBy("id", "block", "first", "second", "adjudicator").agg(
        *(F.max(F.when(F.col("v.reviewer") == F.col(who), F.struct("v.status", "v.before_clean", "v.after_clean"))).alias(name) for name, who in (("v1", "first"), ("v2", "second"), ("v3", "adjudicator")))
    )
    return gathered.filter("v1 is not null and v2 is not null") if how == "inner" else gathered


def divergent(v1: Column, v2: Column) -> Column:
    """Both have judged, and neither both clean nor both rejected."""
    agreed = (v1["status"] == v2["status"]) & v1["status"].isin("clean", "rejected")
    return v1.isNotNull() & v2.isNotNull() & ~F.coalesce(agreed, F.lit(False))


def double_review(pairs: DataFrame, reviews: DataFrame, blocks: DataFrame) -> DataFrame:
    """Pairs kept by two reviewers or, where they differ, by the adjudicator; incomplete reviews keep nothing. ``reviews``: one row an (id, reviewer)."""
    judged = _reviewed_twice(blocks, reviews)
    both_clean = (F.col("v1.status") == "clean") & (F.col("v2.status") == "clean")
    settled = F.col("v3").isNotNull() & _settled(F.col("v3.status"), F.col("v3.before_clean"), F.col("v3.after_clean"))
    decided = judged.filter(F.coalesce(both_clean, F.lit(False)) | (divergent(F.col("v1"), F.col("v2")) & F.coalesce(settled, F.lit(False))))
    verdict = F.when(~F.coalesce(both_clean, F.lit(False)), F.col("v3"))
    kept = pairs.join(decided.select("id", verdict.alias("verdict")), "id")
    return _with_cut(kept, "verdict").select(*pairs.columns)


#: Ratings of two sides, ``a`` and ``b``, as one text; null if a side is missing.
RATED = "CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN concat(hex(a), '/', hex(b)) END"
#: How often each pair of ratings comes: a state of bounded size that is merged before and after the shuffle.
CONFUSION = f"approx_top_k({RATED}, 1000, 10000)"
#: The table of ``counts``, over ``total`` rows. A sketch of 10,000 places that has lost a pair has either 1,000 to give, or counts whose sum falls short of the rows, as each loss
#: takes from 3,750 places at least; so fewer pairs with the right sum are exact, and everything else is an error.
CELLS = """CASE WHEN size(counts) < 1000 AND aggregate(counts, 0L, (s, c) -> s + c.count) = total
  THEN transform(filter(counts, c -> c.item IS NOT NULL), c -> named_struct('a', split(c.item, '/')[0], 'b', split(c.item, '/')[1], 'n', c.count))
  ELSE raise_error('more than 999 pairs of ratings') END"""
RATINGS = "aggregate(cells, 0L, (s, c) -> s + c.n)"
_AGREED = "aggregate(cells, 0L, (s, c) -> s + IF(c.a = c.b, c.n, 0L))"
_CHANCE = "aggregate(cells, 0D, (s, c) -> s + aggregate(cells, 0D, (t, d) -> t + IF(d.b = c.a, 1D * c.n * d.n, 0D)))"
_LABELS = "size(array_distinct(concat(transform(cells, c -> c.a), transform(cells, c -> c.b))))"
#: Cohen's kappa of ``cells``; null under two ratings or with one label in all.
KAPPA = f"""CASE WHEN {RATINGS} >= 2 AND {_LABELS} >= 2
  THEN (1D * {_AGREED} / {RATINGS} - {_CHANCE} / (1D * {RATINGS} * {RATINGS})) / (1D - {_CHANCE} / (1D * {RATINGS} * {RATINGS})) END"""


def agreement(blocks: DataFrame, reviews: DataFrame) -> DataFrame:
    """``block``, ``n`` and Cohen's ``kappa`` of its two reviewers over the pairs that both judged; null under two pairs or with one label in all."""
    rated = _reviewed_twice(blocks, reviews, "left").select("block", F.col("v1.status").alias("a"), F.col("v2.status").alias("b"))
    tables = rated.groupBy("block").agg(F.expr(CONFUSION).alias("counts"), F.count("*").alias("total")).select("block", F.expr(CELLS).alias("cells"))
    return tables.select("block", F.expr(RATINGS).alias("n"), F.expr(KAPPA).alias("kappa"))


def assign_blocks(pairs: DataFrame, reviewers: list[str], seed: int = 42) -> DataFrame:
    """``id``, ``smell``, ``block`` and its two reviewers and adjudicator: three blocks, each with a third of every smell.

    Pairs of a smell are dealt out in a fixed random order. Places come from counts of ranges of that order, so a frequent smell isn't sorted in one task.
    """
    if len(reviewers) != 3 or len(set(reviewers)) != 3:
        raise ValueError("double review needs three different reviewers")
    placed = rank_at_random(pairs.select("id", "smell"), ["smell"], "id", seed)
    seats = F.array(*(F.struct(F.lit(f"B{k + 1}").alias("block"), *(F.lit(reviewers[(k + j) % 3]).alias(n) for j, n in enumerate(("first", "second", "adjudicator")))) for k in range(3)))
    return placed.select("id", "smell", F.element_at(seats, (F.col("place") % 3 + 1).cast("int")).alias("seat")).select("id", "smell", "seat.*")


def rank_at_random(rows: DataFrame, groups: list[str], key: str, seed: int = 42) -> DataFrame:
    """``rows`` with ``place`` (from 0) in a random but fixed order within its group; ties by ``key``.

    Groups may be of any size: the first byte of the random number cuts each into ranges, whose counts give the offset of each range.
    """
    drawn = rows.withColumn("draw", shuffle_rank(key, seed=seed)).withColumn("range", F.substring("draw", 1, 2))
    before = Window.partitionBy(*groups).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = drawn.groupBy(*groups, "range").agg(F.count("*").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy(*groups, "range").orderBy("draw", key)
    placed = drawn.withColumn("place", F.row_number().over(within) - 1)
    same = [F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}")) for g in (*groups, "range")]
    joined = placed.alias("l").join(offsets.alias("r"), same)
    return joined.select(*(f"l.{c}" for c in rows.columns), (F.col("l.place") + F.col("r.offset")).alias("place"))


def visible(pairs: DataFrame, blocks: DataFrame, reviews: DataFrame, reviewer: str, adjudicate: bool = False) -> DataFrame:
    """Pairs that a reviewer sees, with their own verdict ``status`` (null: pending): those of their blocks, or the divergent ones that they adjudicate."""
    if adjudicate:
        judged = _reviewed_twice(blocks.filter(F.col("adjudicator") == reviewer), reviews)
        mine = judged.filter(divergent(F.col("v1"), F.col("v2"))).select("id")
    else:
        mine = blocks.filter((F.col("first") == reviewer) | (F.col("second") == reviewer)).select("id")
    own = reviews.filter(F.col("reviewer") == reviewer).select("id", "status")
    return pairs.join(mine, "id").join(own, "id", "left")


def progress(seen: DataFrame) -> DataFrame:
    """``total``, ``reviewed`` and ``pending`` of what a reviewer sees."""
    return seen.agg(F.count("*").alias("total"), F.count("status").alias("reviewed"), F.count_if(F.col("status").isNull()).alias("pending"))


def schema_errors(pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``errors``: every rule of the data model that a row breaks, sources included, with the line where a side stops parsing; empty for a valid one."""
    checked = with_kernel(pairs, "syntax", lambda a, b: [kernels.syntax_error(a), kernels.syntax_error(b)], "array<string>", "before_code", "after_code")
    rules = [F.when(F.col(c).isNull(), F.lit(f"{c} is missing")) for c in ("repo", "commit_hash", "smell_type")]
    rules += [F.when(is_blank(c), F.lit(f"{c} is empty")) for c in ("before_code", "after_code")]
    rules.append(F.when(~F.col("smell_type").isin(*SMELLS), F.lit("unknown smell_type")))
    rules.append(F.when(~F.coalesce("source", F.lit(SOURCES[0])).isin(*SOURCES), F.lit("unknown source")))
    rules += [F.when(~is_blank(c) & F.col("syntax")[k].isNotNull(), F.concat(F.lit(f"{c} doesn't parse"), F.coalesce(F.concat(F.lit(" at "), F.regexp_substr(F.col("syntax")[k], F.lit("^line [0-9]+"))), F.lit("")))) for k, c in enumerate(("before_code", "after_code"))]
    return checked.withColumn("errors", F.array_compact(F.array(*rules))).drop("syntax")


def validation_report(checked: DataFrame) -> DataFrame:
    row = checked.agg(F.count_if(F.size("errors") == 0).alias("valid"), F.count_if(F.size("errors") > 0).alias("invalid"))
    return row.withColumn("pass_rate", F.round(100.0 * F.col("valid") / F.greatest(F.col("valid") + F.col("invalid"), F.lit(1)), 1))


def split_by_repo(pairs: DataFrame, val: float = 0.1, test: float = 0.1, seed: int = 42) -> DataFrame:
    """``pairs`` with ``split``: every repository is in one split only; repositories are in random but fixed order, test first, then val.

    A pair without a repository is one of its own. Three repositories, five pairs, and three pairs of each smell are needed at least.
    """
    keyed = pairs.withColumn("__group", F.coalesce(F.nullif("repo", F.lit("")), F.concat(F.lit("no repository "), F.col("id"))))
    few = [r.smell_type for r in pairs.groupBy("smell_type").count().filter("count < 3").limit(len(SMELLS) + 1).collect()]
    groups = keyed.groupBy("__group").agg(F.count("*").alias("rows"))
    n, rows = groups.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
    n_test, n_val = max(1, round(test * n)), max(1, round(val * n))
    if few or rows < 5 or n < 3 or n_test + n_val >= n:
        raise ValueError(f"too little to split: {rows} pairs, {n} repositories, smells under three pairs: {few}")
    placed = rank_at_random(groups.withColumn("all", F.lit(0)), ["all"], "__group", seed)
    named = placed.select("__group", F.when(F.col("place") < n_test, "test").when(F.col("place") < n_test + n_val, "val").otherwise("train").alias("split"))
    return keyed.join(named, "__group").drop("__group")
