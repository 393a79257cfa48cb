"""Mining of refactoring pairs from commits: recall by message, pairing of functions, verification by the detectors.

Both versions of a file come in one row, so parsing and pairing need no shuffle; caps shuffle only rows that survive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.functions import kernels
from codequarry.functions.columns import SMELLS, has_keyword, is_bot, is_test_path, magnitude, matched_keywords, mentions_test, pair_id, stripped
from codequarry.functions.rowwise import with_kernel
from codequarry.operators.crossfile import moved_functions
from codequarry.operators.detect import DEFAULT, Thresholds, has_smell
from codequarry.sources.scratch import release, stage


@dataclass(frozen=True)
class Options:
    """What a mining run keeps; the presets below are the usual runs."""

    require_keyword: bool = True
    partial_threshold: float | None = None
    source: str = "mined_commit"
    since: str | None = None
    until: str | None = None
    merges: bool = False
    max_commits: int | None = None
    caps: dict[str, int] = field(default_factory=dict)
    #: Least tree similarity of functions moved between files; none: off.
    cross_file: float | None = None
    identifier_overlap: float = 0.0
    thresholds: Thresholds = DEFAULT


#: Commits given by a list, whatever their message; the same for merged requests.
LISTED = Options(require_keyword=False, partial_threshold=0.1, source="adjacent_oracle", merges=True)
REQUESTS = Options(require_keyword=False, partial_threshold=0.1, source="mined_pr", merges=True)
#: Commits whose message names a linter's rule.
BY_RULE = Options(require_keyword=False, partial_threshold=0.1, source="rule_id_mined", merges=True)
# What is searched for in messages, by smell; all words of a query have to occur.
RULE_QUERIES = {
    "R2": ["PLR0913 dataclass", "PLR0913 extract", "R0913 dataclass", "PLR0913 parameter"],
    "R3": ["PLR2004 constant", "PLR2004 extract", "R2004 constant", "PLR2004 magic"],
    "R4": ["PLR1702 guard", "PLR1702 early return", "R1702 nested", "PLR1702 refactor"],
}


def _says(queries: list[str]) -> Column:
    """Whether a message has all words of some query, without regard to case."""
    # One expression: filters also reach tables that are joined by the key they are made of, where each use of the message would make it again.
    each = ["".join(rf"(?=.*\Q{word}\E)" for word in query.lower().split()) for query in queries]
    return F.lower(F.coalesce("message", F.lit(""))).rlike(rf"(?s)\A(?:{'|'.join(each)})") if each else F.lit(False)


def searched(changes: DataFrame, queries: list[str]) -> DataFrame:
    """Changes of commits whose message has all words of some query, without regard to case."""
    return changes.filter(_says(queries))


def commits_by_rule(changes: DataFrame, most: int, queries: dict[str, list[str]] = RULE_QUERIES, seen: DataFrame | None = None) -> DataFrame:
    """``repo``, ``commit_hash`` and ``smell`` of the newest ``most`` commits of each smell whose messages its queries find, without those in ``seen``.

    A commit that several smells' queries find belongs to the first. Commits beyond ``most`` aren't seen, so a later run comes to them.
    """
    smell = F.coalesce(*(F.when(_says(some), F.lit(code)) for code, some in queries.items()))
    found = changes.select("repo", "commit_hash", "committed_at", smell.alias("smell")).filter("smell is not null")
    each = found.groupBy("repo", "commit_hash").agg(F.min("smell").alias("smell"), F.max("committed_at").alias("committed_at"))
    if seen is not None:
        each = each.join(seen.select("repo", "commit_hash"), ["repo", "commit_hash"], "left_anti")
    newest = Window.partitionBy("smell").orderBy(F.desc("committed_at"), "repo", "commit_hash")
    return each.withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= most).select("repo", "commit_hash", "smell")


def first_years(repos: DataFrame, years: int = 7, last: str = "2014-12-31") -> DataFrame:
    """Windows (``repo``, ``since``, ``until``) of the first ``years`` of repositories by ``created_at``, to ``last`` at most; those made after it, or at an unknown time, have none."""
    created = F.col("created_at").try_cast("date")
    end = F.least(F.add_months(created, 12 * years), F.lit(last).cast("date"))
    return repos.filter(created <= F.lit(last).cast("date")).select("repo", created.cast("string").alias("since"), end.cast("string").alias("until"))


def commits(changes: DataFrame, options: Options = Options(), only: DataFrame | None = None, windows: DataFrame | None = None) -> DataFrame:
    """The files that a run looks at, with ``file`` and ``msg_keywords``: all filters are native and reach the scan where they can.

    ``only`` has ``commit_hash``, and ``repo`` if hashes are those of a repository. ``windows`` (``repo``, ``since``, ``until``) limits each repository to a time of its own; others aren't looked at.
    """
    file = F.coalesce("new_path", "old_path")
    rows = changes.withColumn("file", file).filter(F.endswith("file", F.lit(".py")))
    if not options.merges:
        rows = rows.filter(~F.col("is_merge"))
    if options.since:
        rows = rows.filter(F.col("committed_at") >= F.lit(options.since).cast("timestamp"))
    if options.until:
        rows = rows.filter(F.col("committed_at") <= F.lit(options.until).cast("timestamp"))
    if windows is not None:
        times = windows.select("repo", F.col("since").cast("timestamp").alias("__since"), F.col("until").cast("timestamp").alias("__until"))
        rows = rows.join(times, "repo").filter(F.col("committed_at").between(F.col("__since"), F.col("__until"))).drop("__since", "__until")
    if only is not None:
        key = [c for c in ("repo", "commit_hash") if c in only.columns]
        rows = rows.join(only.select(*key).distinct(), key, "left_semi")
    if options.require_keyword:
        rows = rows.filter(has_keyword("message"))
    rows = rows.withColumn("msg_keywords", matched_keywords("message"))
    if options.max_commits is not None:
        rows = rows.join(first_commits(rows, options.max_commits), ["repo", "commit_hash"], "left_semi")
    return rows


def first_commits(rows: DataFrame, n: int) -> DataFrame:
    """The first ``n`` commits of each repository, by ``seq``."""
    each = rows.groupBy("repo", "commit_hash").agg(F.min("seq").alias("seq"))
    order = Window.partitionBy("repo").orderBy("seq", "commit_hash")
    return each.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n).drop("place")


def files_by_rule(changes: DataFrame) -> DataFrame:
    """The looser file filter of searches by rule names: modified Python files without ``test`` in the path, not by bots (``author``)."""
    both = F.col("before").isNotNull() & F.col("after").isNotNull()
    path = F.coalesce("new_path", "old_path")
    return changes.filter(both & F.endswith(path, F.lit(".py")) & ~mentions_test(path) & ~is_bot("author"))


def _by_name(functions: Column) -> Column:
    return F.map_from_entries(F.transform(functions, lambda f: F.struct(f["qualname"], f)))


def candidates(rows: DataFrame) -> DataFrame:
    """A row for each function that a file's change altered: ``old`` and ``new`` (measured functions) and ``helpers``, the new functions it calls.

    Of definitions with one name the last counts. Both sources parse alone, differ but for white space at the ends, and the new one isn't tiny.
    """
    sided = with_kernel(rows.filter("before is not null and after is not null"), "sides", kernels.both_sides, f"struct<{kernels.CHANGED}>", "before", "after", without=("before", "after"))
    last = {side: F.filter(f"sides.{side}", lambda f: ~f["shadowed"]) for side in ("before", "after")}

    def changed(pair: Column) -> Column:
        old, new = pair["old"], pair["new"]
        return new.isNotNull() & (old["source"] != new["source"]) & old["parses"] & new["parses"] & (stripped(old["source"]) != stripped(new["source"])) & (F.length(stripped(new["source"])) >= 10)

    def matched(m: Column) -> Column:
        pairs = F.filter(F.transform(m["olds"], lambda old: F.struct(old.alias("old"), F.element_at(m["by_new"], old["qualname"]).alias("new"))), changed)
        added = F.filter(m["news"], lambda f: ~F.map_contains_key(m["by_old"], f["qualname"]))
        return F.struct(pairs.alias("pairs"), added.alias("added"))

    def with_helpers(m: Column) -> Column:
        def one(pair: Column) -> Column:
            called = pair["new"]["called"]
            return F.struct(pair["old"].alias("old"), pair["new"].alias("new"), F.filter(m["added"], lambda h: F.array_contains(called, h["name"])).alias("helpers"))

        return F.transform(m["pairs"], one)

    named = F.struct(last["before"].alias("olds"), last["after"].alias("news"), _by_name(last["before"]).alias("by_old"), _by_name(last["after"]).alias("by_new"))
    keys = [c for c in sided.columns if c != "sides"]
    return sided.select(*keys, F.inline(_let(_let(named, matched), with_helpers)))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once: the optimizer would otherwise put its expression at every place of use, lambdas included."""
    return F.transform(F.array(value), use)[0]


def verified(found: DataFrame, options: Options = Options()) -> DataFrame:
    """Pairs: the detector of a smell fires before, and after not at all or on a smell less grave by ``partial_threshold``.

    A long method counts only with helpers, none of them long; its new code ends with their sources, in the order of the file.
    """
    t = options.thresholds

    def judged(smell: str) -> Column:
        old, new, helpers = F.col("old"), F.col("new"), F.col("helpers")
        grave_old, grave_new = magnitude(F.lit(smell), old), magnitude(F.lit(smell), new)
        fires = has_smell(smell, new, t)
        if options.partial_threshold is None:
            accepted = ~fires
        else:
            accepted = ~fires | ((grave_old > 0) & (grave_new <= grave_old * (1.0 - options.partial_threshold)))
        code, n_after = new["source"], F.lit(1)
        if smell == "R1":
            accepted = accepted & (F.size(helpers) > 0) & ~F.exists(helpers, lambda h: h["parses"] & has_smell("R1", h, t))
            code = F.array_join(F.concat(F.array(new["source"]), helpers["source"]), "\n\n\n")
            n_after = 1 + F.size(helpers)
        row = F.struct(F.lit(smell).alias("smell_type"), code.alias("after_code"), fires.alias("partial"), n_after.cast("int").alias("n_functions_after"), grave_old.alias("magnitude_before"), grave_new.alias("magnitude_after"))
        return F.when(has_smell(smell, old, t) & accepted, row)

    rows = found.select("repo", "commit_hash", "parent_commit", "seq", "message", "msg_keywords", "file", "old", "new", F.inline(F.array_compact(F.array(*map(judged, SMELLS)))))
    measures = ["nloc", "ccn", "n_statements", "max_depth", "params", "magic", "dead"]
    return rows.select(
        pair_id("repo", "commit_hash", "file", F.col("old.qualname"), "smell_type", F.col("old.source"), "after_code").alias("id"),
        "smell_type", "repo", "commit_hash", "parent_commit", "seq", "file",
        F.col("old.qualname").alias("function_name"), F.col("message").alias("commit_msg"), "msg_keywords",
        F.col("old.source").alias("before_code"), "after_code",
        F.struct(*(F.col(f"old.{m}") for m in measures)).alias("metrics_before"),
        F.struct(*(F.col(f"new.{m}") for m in measures)).alias("metrics_after"),
        "magnitude_before", "magnitude_after", F.lit(True).alias("verified"), "partial", "n_functions_after", F.lit(options.source).alias("source"),
    )


def first_of_each_id(pairs: DataFrame) -> DataFrame:
    """One row an id, the first by ``seq``; rows with one id have the same code."""
    order = Window.partitionBy("id").orderBy("seq", "file")
    return pairs.withColumn("place", F.row_number().over(order)).filter("place = 1").drop("place")


def capped(pairs: DataFrame, caps: dict[str, int], all_smells: bool = False) -> DataFrame:
    """At most so many pairs of a smell from each repository, in order of ``seq``; smells without a cap aren't limited.

    With ``all_smells``, a repository is read no further than the commit at which every capped smell is full. ``seq`` orders
    commits. The ranks are limited before the shuffle, so a frequent smell costs no more than its cap.
    """
    if not caps:
        return pairs
    limit = F.element_at(F.create_map(*[F.lit(x) for item in caps.items() for x in item]), F.col("smell_type"))
    unique = first_of_each_id(pairs)
    order = Window.partitionBy("repo", "smell_type").orderBy("seq", "id")
    ranked = unique.withColumn("limit", limit)
    under = ranked.filter("limit is not null").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= max(caps.values())).filter("place <= limit")
    kept = under.unionByName(ranked.filter("limit is null").withColumn("place", F.lit(0)))
    if all_smells and len(caps) < len(SMELLS):
        full = under.filter("place = limit").groupBy("repo").agg(F.count("*").alias("n"), F.max("seq").alias("stop")).filter(F.col("n") == len(caps))
        kept = kept.join(full.select("repo", "stop"), "repo", "left").filter("stop is null or seq <= stop").drop("stop")
    return kept.drop("limit", "place")


def mine(changes: DataFrame, options: Options = Options(), only: DataFrame | None = None, windows: DataFrame | None = None) -> DataFrame:
    """Verified pairs of the commits in ``changes``."""
    rows = commits(changes, options, only, windows)
    if not options.caps:
        return first_of_each_id(_pairs(rows, options))
    return capped(_pairs_until_full(rows, options), options.caps, all_smells=True)


def _pairs(rows: DataFrame, options: Options) -> DataFrame:
    pairs = verified(candidates(rows.filter(~is_test_path("file"))), options)
    if options.cross_file is not None:
        moved = moved_functions(rows, similarity=options.cross_file, overlap=options.identifier_overlap)
        again = verified(moved, Options(partial_threshold=options.partial_threshold, source="cross_file", thresholds=options.thresholds))
        pairs = pairs.unionByName(again)
    return pairs


#: Commits of a repository that are looked at first if there are caps, and how many times as many come next.
FIRST, TIMES = 256, 16


def _pairs_until_full(rows: DataFrame, options: Options) -> DataFrame:
    """Pairs of each repository's commits in order of ``seq``, all of them or up to one by which every capped smell is full: later ones can't be among those that caps keep.

    Some commits of every repository are looked at, then more of those that aren't full, so a repository that never is full is read to its end.
    """
    at = F.coalesce(F.col("seq").cast("long"), F.lit(-1 << 63))
    order = stage(rows.select("repo", at.alias("at")).distinct(), "commit-order")
    wanted = {s: n for s, n in options.caps.items() if n > 0}
    limit = F.element_at(F.create_map(*[F.lit(x) for item in wanted.items() for x in item]), F.col("smell_type")) if wanted else F.lit(None).cast("int")
    # A cap of none is never reached, so smells without a cap are read to the end beside it.
    stops = len(wanted) == len(options.caps) or len(options.caps) == len(SMELLS)
    left, n, found = order.select("repo", F.lit(None).cast("long").alias("low")).distinct(), FIRST, None
    while True:
        mine = left.select(F.col("repo").alias("__repo"), "low")
        ahead = order.join(mine, F.col("repo").eqNullSafe(F.col("__repo"))).filter("low is null or at > low")
        first = Window.partitionBy("repo").orderBy("at")
        next_ones = ahead.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= n)
        parts = stage(next_ones.groupBy(F.col("repo").alias("__repo")).agg(F.first("low").alias("low"), F.max("at").alias("high"), F.count("*").alias("n")), "commit-parts")
        top, longest = parts.agg(F.max("high"), F.max("n")).first()
        if top is None:
            break
        some = rows.filter(F.col("seq").isNull() | (F.col("seq") <= top)).join(parts.select("__repo", F.col("low").alias("__low"), F.col("high").alias("__high")), F.col("repo").eqNullSafe(F.col("__repo")))
        new = _pairs(some.filter((at <= F.col("__high")) & (F.col("__low").isNull() | (at > F.col("__low")))).select(*rows.columns), options)
        if longest < n:  # no repository has commits behind these
            return new if found is None else found.unionByName(new)
        new = stage(new, "pairs")
        found = new if found is None else found.unionByName(new)
        counted = found.groupBy("repo", "smell_type").agg(F.countDistinct("id").alias("n")).filter(F.col("n") >= limit)
        full = counted.groupBy("repo").agg(F.count("*").alias("smells")).filter((F.col("smells") == len(wanted)) & F.lit(stops)).select("repo")
        more = parts.filter(F.col("n") == n).select(F.col("__repo").alias("repo"), F.col("high").alias("low"))
        left = stage(more.join(full.withColumnRenamed("repo", "__repo"), F.col("repo").eqNullSafe(F.col("__repo")), "left_anti"), "commits-left")
        release(parts)
        n *= TIMES
    release(order, left)
    return _pairs(rows.filter(F.lit(False)), options) if found is None else found


def mine_by_rule(changes: DataFrame, queries: dict[str, list[str]] = RULE_QUERIES, options: Options = BY_RULE, only: DataFrame | None = None) -> DataFrame:
    """Pairs of commits found by the names of rules, by the looser file filter (``changes`` has ``author`` too); keywords aren't recorded. ``only``: of these commits."""
    rows = files_by_rule(searched(changes, [q for some in queries.values() for q in some]))
    if only is not None:
        rows = rows.join(only.select("repo", "commit_hash"), ["repo", "commit_hash"], "left_semi")
    rows = rows.withColumns({"file": F.coalesce("new_path", "old_path"), "msg_keywords": F.array().cast("array<string>")})
    return first_of_each_id(verified(candidates(rows), options))


def counts(pairs: DataFrame) -> DataFrame:
    """Distinct pairs of each smell in this run."""
    return pairs.groupBy("smell_type").agg(F.countDistinct("id").alias("n"))


def unseen(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """Commits, once each, that an earlier run hasn't seen."""
    return rows.dropDuplicates(["repo", "commit_hash"]).join(seen.select("repo", "commit_hash"), ["repo", "commit_hash"], "left_anti")


def budgets(per_repo: DataFrame, cap: int | dict[str, int]) -> DataFrame:
    """How many pairs each repository may give of a smell, so that the total comes near ``cap``: the rest of the cap shared by the repositories left.

    ``per_repo`` has ``smell_type``, ``place`` (order of the repositories), ``repo`` and ``available``. What a repository doesn't use goes to those after it, so
    a smell's repositories are run through in order; rows stream by, and only a running total is kept.
    """
    caps = F.lit(cap) if isinstance(cap, int) else F.coalesce(F.element_at(F.create_map(*[F.lit(x) for item in cap.items() for x in item]), F.col("smell_type")), F.lit(1 << 62))
    sizes = per_repo.groupBy("smell_type").agg(F.count("*").alias("repos"))
    rows = per_repo.join(sizes, "smell_type").select("smell_type", "place", "repo", F.col("available").cast("long").alias("available"), "repos", caps.cast("long").alias("cap"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        smell, total, left = None, 0, 0
        for batch in batches:
            made: list[tuple] = []
            for name, repo, available, repos, most in zip(*(batch.column(c).to_pylist() for c in ("smell_type", "repo", "available", "repos", "cap")), strict=True):
                if name != smell:
                    smell, total, left = name, 0, repos
                budget = max(0, -(-(most - total) // left))
                taken = min(budget, available)
                total, left = total + taken, left - 1
                made.append((name, repo, budget, taken))
            columns = zip(*made, strict=True) if made else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["smell_type", "repo", "budget", "taken"])

    ordered = rows.repartition("smell_type").sortWithinPartitions("smell_type", "place", "repo")
    return ordered.mapInArrow(run, "smell_type string, repo string, budget long, taken long")


def within_budgets(pairs: DataFrame, cap: int | dict[str, int]) -> DataFrame:
    """The first pairs by ``seq`` of each repository and smell, as many as ``budgets`` allows; repositories are taken in order of their names."""
    unique = first_of_each_id(pairs)
    available = unique.groupBy("smell_type", "repo").agg(F.count("*").alias("available")).withColumn("place", F.col("repo"))
    allowed = budgets(available, cap).select("smell_type", "repo", "budget")
    order = Window.partitionBy("repo", "smell_type").orderBy("seq", "id")
    return unique.withColumn("place", F.row_number().over(order)).join(allowed, ["smell_type", "repo"]).filter(F.col("place") <= F.col("budget")).drop("place", "budget")


def in_waves(changes: DataFrame, merge: Callable[[DataFrame], object], caps: dict[str, int], options: Options = Options(), windows: DataFrame | None = None, wave: int = 32, repos: DataFrame | None = None) -> Iterator[dict[str, int]]:
    """Mine some repositories at a time, in order of their names, until every smell has its cap; after each wave the pairs so far of each smell.

    A repository may give an equal share, rounded up, of what a smell still lacks, over the repositories that are left, the first by ``seq``; what it doesn't use goes to those after it.
    So the pairs are those of mining one repository after another, whatever the size of a wave, and repositories after the last cap is reached aren't read. Each wave is
    merged (``PairTable.merge``) before the next one begins. The driver holds a wave's names and counts. ``repos`` (``repo``) spares reading all changes for their names.
    """
    if wave < 1 or not set(SMELLS) <= set(caps):
        raise ValueError("a wave has a repository at least, and each smell a cap")
    spark = changes.sparkSession
    listed = repos if repos is not None else windows if windows is not None else changes
    names = stage(listed.select("repo").filter("repo is not null").distinct(), "repositories")
    left, last, total = names.count(), None, dict.fromkeys(SMELLS, 0)
    while left and any(total[s] < caps[s] for s in SMELLS):
        after = names if last is None else names.filter(F.col("repo") > F.lit(last))
        some = [r.repo for r in after.orderBy("repo").limit(wave).collect()]
        # No repository may give more than what is lacking before the wave.
        first = Window.partitionBy("repo", "smell_type").orderBy("seq", "id")
        lacking = {s: max(0, caps[s] - total[s]) for s in SMELLS}
        mined = mine(changes.filter(F.col("repo").isin(some)), options if options.caps else replace(options, caps=lacking), windows=windows)
        pairs = stage(mined.withColumn("place", F.row_number().over(first)), "wave")
        available = {(r.repo, r.smell_type): r.n for r in pairs.groupBy("repo", "smell_type").agg(F.count("*").alias("n")).collect()}
        shares = []
        for repo in some:
            for smell in SMELLS:
                share = max(0, -(-(caps[smell] - total[smell]) // left))
                shares.append((repo, smell, share))
                total[smell] += min(share, available.get((repo, smell), 0))
            left -= 1
        allowed = spark.createDataFrame(shares, "repo string, smell_type string, share long")
        kept = pairs.join(F.broadcast(allowed), ["repo", "smell_type"]).filter(F.col("place") <= F.col("share"))
        merge(kept.select(*(c for c in pairs.columns if c != "place")))
        release(pairs)
        last = some[-1]
        yield dict(total)
    release(names)
