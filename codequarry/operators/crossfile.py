"""Functions moved between files of one commit: pairs of a small commit, or a prefix-filtered join on kinds of nodes; cheap distances next, tree distance on what is left."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.functions import kernels
from codequarry.functions.columns import is_test_path, jaccard, shape_distance
from codequarry.functions.rowwise import with_kernel
from codequarry.sources.scratch import release, stage

COMMIT = ["repo", "commit_hash"]
_FUNCTION = f"{kernels.FUNCTION}, kinds map<string,int>"
#: Nodes of one kind in a function beyond so many are equally rare.
DEEP = 63
#: Commits of at most so many pairs of functions don't need their rare nodes: those would be more rows than the pairs.
FEW = 1024


def _side(before: str | None, after: str | None, old_path: str | None, new_path: str | None) -> dict:
    """Functions that a file's change took away or added, with the numbers of their nodes by kind; a side that doesn't parse has none.

    In a file that keeps its path those of one name on both sides haven't moved and aren't measured.
    """
    old, new = ([f for f in kernels.listed(x)[1] if not f["owner_class"] and not f["shadowed"]] for x in (before, after))
    stayed = {f["name"] for f in old} & {f["name"] for f in new} if old_path == new_path else set()
    measured = [[f | kernels.measure(f["source"]) | {"kinds": list(kernels.kinds_of(f["source"]).items())} for f in side if f["name"] not in stayed] for side in (old, new)]
    return {"error": None, "before": measured[0], "after": measured[1]}


def measured(rows: DataFrame) -> DataFrame:
    """Top-level functions that a file's change took away (``side`` is ``before``) or added (``after``); ``uid`` tells them apart."""
    info = [*COMMIT, "parent_commit", "seq", "message", "msg_keywords"]
    sides_type = f"struct<error string, before array<struct<{_FUNCTION}>>, after array<struct<{_FUNCTION}>>>"
    listed = with_kernel(rows.filter(~is_test_path("file")).select(*info, "old_path", "new_path", "file", "before", "after"), "sides", _side, sides_type, "before", "after", "old_path", "new_path", without=("before", "after"))

    def only(side: str, path: str) -> Column:
        kept = F.filter(f"sides.{side}", lambda f: f["shape"].isNotNull())
        return F.transform(kept, lambda f: F.struct(F.lit(side).alias("side"), F.coalesce(path, "file").alias("path"), f["name"].alias("name"), f.alias("f")))

    sides = F.concat(only("before", "old_path"), only("after", "new_path"))
    # Written once: both sides are read several times, and parsing is what costs.
    return stage(listed.select(*info, F.inline(sides)).withColumn("uid", F.monotonically_increasing_id()), "moved-functions")


def _sides_of(moved: DataFrame) -> tuple[DataFrame, DataFrame]:
    return tuple(moved.filter(F.col("side") == side).drop("side") for side in ("before", "after"))


def one_sided(moved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``measured`` functions those by (commit, file, name) that only the old, or only the new, state of a commit's files has."""
    old, new = _sides_of(moved)
    on = [*COMMIT, "path", "name"]
    return tuple(one.join(_large(other.select(*on)), on, "left_anti").drop("name") for one, other in ((old, new), (new, old)))


def gone_and_fresh(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Functions that only the old, or only the new, state of a commit's files has."""
    return one_sided(measured(rows))


def _large(side: DataFrame) -> DataFrame:
    """A side that is sorted and merged: code in a staged file is packed so well that the planner would send whole tables through the driver to every task."""
    return side.hint("merge")


def rarity(kinds: DataFrame) -> list[tuple[str, int]]:
    """Nodes of functions, as (kind, how many of the kind come before), in order of how few functions have them; at most ``DEEP + 1`` for each kind of the language's."""
    entries = kinds.select(F.explode("kinds").alias("kind", "n")).groupBy("kind", F.least("n", F.lit(DEEP + 1)).alias("n")).count().collect()
    functions: Counter[tuple[str, int]] = Counter()
    for row in entries:
        for k in range(row.n):
            functions[row.kind, k] += row["count"]
    return sorted(functions, key=lambda x: (functions[x], x))


def prefix(kinds: Iterable[tuple[str, int]] | None, places: dict[tuple[str, int], int], similarity: float) -> list[int]:
    """The rarest nodes of a function, so many that one as similar shares at least one of them.

    Trees of similarity ``s`` have ``s`` times the nodes of the larger one, or more, of equal kinds. So the nodes of a function that are left when all
    but one of that share are taken away, whichever they are, meet those of the other in one at least, if both sides take them in one order.
    """
    counts = dict(kinds or ())
    nodes = sorted(places[kind, min(k, DEEP)] * (1 << 32) + max(0, k - DEEP) for kind, n in counts.items() for k in range(n))
    return nodes[: len(nodes) - math.ceil(similarity * len(nodes) - 1e-9) + 1]


def shared_nodes(one: Column, two: Column) -> Column:
    """How many nodes of equal kinds two functions have."""
    return F.aggregate(F.map_entries(one), F.lit(0), lambda n, e: n + F.least(e["value"], F.coalesce(F.element_at(two, e["key"]), F.lit(0))))


def near_pairs(gone: DataFrame, fresh: DataFrame, shape: float = 0.5, similarity: float = 0.7, overlap: float = 0.0) -> DataFrame:
    """``old_uid``, ``new_uid`` and ``identifier_overlap`` of the pairs whose trees may be as similar; no other pair can be.

    What is shuffled are numbers: sources don't move. Functions of a large commit and of one size meet only where they share a rare node. The pairs are staged, so what was shuffled for them is gone.
    """
    slim = ["uid", *COMMIT, "path", F.col("f.shape").alias("shape"), F.col("f.kinds").alias("kinds"), F.col("f.identifiers").alias("identifiers")]
    left, right = (stage(side.select(*slim).withColumn("nodes", F.aggregate(F.map_values("kinds"), F.lit(0), lambda n, x: n + x)), name) for side, name in ((gone, "gone"), (fresh, "fresh")))
    sizes = [side.groupBy(*COMMIT).agg(F.count("*").alias(n)) for side, n in ((left, "n_old"), (right, "n_new"))]
    few = F.lit(similarity <= 0) | (F.col("n_old") * F.col("n_new") <= FEW)
    commits = stage(sizes[0].join(_large(sizes[1]), COMMIT).select(*COMMIT, few.alias("few")), "commits")

    def of(side: DataFrame, few: bool, *columns: str) -> DataFrame:
        """Functions of the small commits, or of the others."""
        return side.select("uid", *COMMIT, "path", "nodes", "shape", *columns).join(_large(commits.filter(F.col("few") == few).select(*COMMIT)), COMMIT, "left_semi")

    def rows(side: DataFrame, name: str, *keys: Column | str) -> DataFrame:
        return side.select(*COMMIT, *keys, F.struct("uid", "path", "nodes", "shape").alias(name))

    met = rows(of(left, True), "a").join(_large(rows(of(right, True), "b")), COMMIT)
    if not commits.filter(~F.col("few")).isEmpty():
        large = [stage(of(side, False, "kinds"), "large") for side in (left, right)]
        places = {node: k for k, node in enumerate(rarity(large[0].unionByName(large[1])))}
        keyed = partial(prefix, places=places, similarity=similarity)
        tokens = [with_kernel(side, "tokens", keyed, "array<long>", "kinds", without=("kinds",)) for side in large]
        a, b = (rows(side, name, F.explode("tokens").alias("token")) for side, name in zip(tokens, "ab", strict=True))
        met = met.unionByName(a.join(_large(b), [*COMMIT, "token"]).drop("token"))
    ratio = F.least("a.nodes", "b.nodes") / F.greatest("a.nodes", "b.nodes")
    met = met.filter((F.col("a.path") != F.col("b.path")) & (ratio >= similarity) & (shape_distance(F.col("a.shape"), F.col("b.shape")) <= shape))
    pairs = met.select(F.col("a.uid").alias("old_uid"), F.col("b.uid").alias("new_uid")).distinct()
    for side, name in ((left, "old"), (right, "new")):
        pairs = pairs.join(_large(side.select(F.col("uid").alias(f"{name}_uid"), *(F.col(c).alias(f"{name}_{c}") for c in ("kinds", "identifiers", "nodes")))), f"{name}_uid")
    alike = shared_nodes(F.col("old_kinds"), F.col("new_kinds")) >= similarity * F.greatest("old_nodes", "new_nodes") - 1e-9
    found = pairs.filter(alike).withColumn("identifier_overlap", jaccard(F.col("old_identifiers"), F.col("new_identifiers")))
    near = stage(found.filter(F.col("identifier_overlap") >= overlap).select("old_uid", "new_uid", "identifier_overlap"), "near-pairs")
    release(left, right, commits)
    return near


def scored(near: DataFrame, gone: DataFrame, fresh: DataFrame, similarity: float) -> DataFrame:
    """Pairs whose trees are as similar, with ``similarity``, commit, files and names; only sources are shuffled."""
    spark = near.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    old = gone.select(F.col("uid").alias("old_uid"), *COMMIT, F.col("path").alias("file_before"), F.col("f.name").alias("old_name"), F.col("f.source").alias("one"))
    new = fresh.select(F.col("uid").alias("new_uid"), F.col("path").alias("file"), F.col("f.name").alias("new_name"), F.col("f.source").alias("two"))
    # So many partitions as rows would be dealt out to: the kernel needs no further shuffle.
    sources = near.join(_large(old), "old_uid").repartition(n, "new_uid").join(_large(new.repartition(n, "new_uid")), "new_uid")
    return with_kernel(sources, "similarity", partial(kernels.tree_similarity_from, least=similarity), "double", "one", "two", without=("one", "two"), dealt=True).filter(F.col("similarity") >= similarity)


def with_functions(pairs: DataFrame, gone: DataFrame, fresh: DataFrame) -> DataFrame:
    """``scored`` pairs with their functions and the rest of their commit."""
    old = gone.select(F.col("uid").alias("old_uid"), "parent_commit", "seq", "message", "msg_keywords", F.col("f").dropFields("kinds").alias("old"))
    new = fresh.select(F.col("uid").alias("new_uid"), F.col("f").dropFields("kinds").alias("new"))
    return pairs.join(_large(old), "old_uid").join(_large(new), "new_uid").drop("old_uid", "new_uid", "old_name", "new_name")


def candidate_pairs(gone: DataFrame, fresh: DataFrame, shape: float = 0.5, similarity: float = 0.7, overlap: float = 0.0) -> DataFrame:
    """Pairs of one commit but different files that pass, in this order, kinds of nodes, size, shape distance, shared identifiers and tree similarity."""
    return with_functions(scored(near_pairs(gone, fresh, shape, similarity, overlap), gone, fresh, similarity), gone, fresh)


def best_match(pairs: DataFrame) -> DataFrame:
    """For each function that is gone the most similar fresh one; ties by file and name. Two may choose the same."""
    order = Window.partitionBy(*COMMIT, "file_before", "old_name").orderBy(F.desc("similarity"), "file", "new_name")
    return pairs.withColumn("place", F.row_number().over(order)).filter("place = 1").drop("place")


def moved_functions(rows: DataFrame, shape: float = 0.5, similarity: float = 0.7, overlap: float = 0.0) -> DataFrame:
    """Candidates for verification: the new name and file count, and no helpers are looked for."""
    moved = measured(rows)
    near = near_pairs(*one_sided(moved), shape, similarity, overlap)
    # Pairs are chosen by names and numbers; the functions of those that are chosen follow.
    chosen = stage(best_match(scored(near, *_sides_of(moved), similarity)), "moved-pairs")
    release(near)
    best = with_functions(chosen, *_sides_of(moved))
    named = F.col("old").withField("qualname", F.col("new.qualname"))
    none = F.filter(F.array("new"), lambda f: F.lit(False))
    return best.select(*COMMIT, "parent_commit", "seq", "message", "msg_keywords", "file", "file_before", "similarity", "identifier_overlap", named.alias("old"), "new", none.alias("helpers"))
