"""Command line over files that Spark reads; ``--help`` lists the commands."""

from __future__ import annotations

import argparse
import sys
import uuid
from dataclasses import replace
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.functions import behaviour
from codequarry.functions.columns import KEYWORDS, REFACTORINGS, SMELLS
from codequarry.functions.rowwise import with_kernel
from codequarry.operators import crossfile, curation, detect, mining, quality, review, sample
from codequarry.sources import git, readers, sinks
from codequarry.sources.scratch import release, stage
from codequarry.streaming import judging

VERSION = "0.1.0"


def _scan(spark: SparkSession, a: argparse.Namespace) -> int:
    """2: no files; 1: findings, with ``--fail-on-detect``."""
    files = readers.python_files(spark, *a.paths)
    if files.isEmpty():
        print("no Python files", file=sys.stderr)
        return 2
    parsed = stage(detect.parsed(files, a.dedent), "parsed")
    for r in detect.parse_errors(parsed).orderBy("path").limit(50).collect():
        print(f"{r.path}: {r.error}", file=sys.stderr)
    found = stage(detect.findings(parsed.select("path", F.inline("functions")), a.smell), "findings")
    counts = {r.smell: r.n for r in detect.counts_by_smell(found, a.smell).collect()}
    if a.out:
        (detect.report_of(parsed, a.smell).write.mode("overwrite").json if a.json else found.write.mode("overwrite").csv)(a.out)
    for smell, n in counts.items():
        print(f"{smell} {SMELLS[smell]}: {n}")
    if a.show:
        for r in found.orderBy("path", "lineno", "smell").limit(a.show).collect():
            print(f"{r.path}:{r.lineno} {r.qualname} {r.smell} {r.evidence}")
    release(parsed, found)
    return int(bool(a.fail_on_detect and any(counts.values())))


def _smells(spark: SparkSession, a: argparse.Namespace) -> int:
    for code, name in SMELLS.items():
        print(f"{code} {name}: {REFACTORINGS[code]}")
    return 0


def _mine(spark: SparkSession, a: argparse.Namespace) -> int:
    options = mining.Options(
        require_keyword=not a.no_require_keyword, partial_threshold=a.partial_threshold, since=a.since, until=a.to, max_commits=a.max_commits,
        caps=dict.fromkeys(SMELLS, a.cap) if a.cap else {}, cross_file=a.cross_file_threshold, identifier_overlap=a.identifier_overlap_threshold, source=a.source, merges=a.merges,
    )
    only = readers.json_lines(spark, a.only, "commit_hash string") if a.only else None
    windows = spark.read.option("multiLine", "true").schema("repo string, since string, to string").json(a.windows).withColumnRenamed("to", "until") if a.windows else None
    if a.created:
        windows = mining.first_years(spark.read.option("multiLine", "true").schema("repo string, created_at string").json(a.created), a.first_years)
    given = [n for n in ("since", "to", "only", "windows", "created", "cap", "partial_threshold", "cross_file_threshold", "requests", "waves") if getattr(a, n)]
    if a.by_rule and given:
        print(f"--by-rule looks at all commits by its own rules and takes no {', '.join('--' + n.replace('_', '-') for n in given)}", file=sys.stderr)
        return 2
    if (a.limit_repos and not a.requests) or (a.requests and a.only) or (a.windows and a.created) or (a.waves and not a.total_cap) or (a.seen and not (a.by_rule and a.max_commits)):
        print("--limit-repos needs --requests, which takes no --only; --windows and --created are one or the other; --waves needs --total-cap, and --seen --by-rule and --max-commits", file=sys.stderr)
        return 2
    if a.requests:
        only = readers.requested(spark, a.requests, a.limit_repos)
        options = replace(mining.REQUESTS, partial_threshold=a.partial_threshold if a.partial_threshold is not None else mining.REQUESTS.partial_threshold, caps=options.caps, since=a.since, until=a.to)
    phrases = {"phrases": "\n".join(KEYWORDS)} if options.require_keyword and not a.by_rule else {}
    changes = git.changes(spark, a.changes, ref=a.ref, **phrases) if a.git else spark.read.parquet(a.changes)
    table = sinks.PairTable(spark, a.out)
    if a.waves:
        counts = {}
        repos = spark.createDataFrame([(name,) for name, _ in git.repositories(a.changes)], "repo string") if a.git else None
        for counts in mining.in_waves(changes, table.merge, dict.fromkeys(SMELLS, a.total_cap), options, windows, a.waves, repos):
            print(f"so far: {counts}")
    elif a.by_rule and a.max_commits:
        counts = _mine_rules(spark, changes, table, a.max_commits, a.seen)
    else:
        pairs = mining.mine_by_rule(changes) if a.by_rule else mining.mine(changes, options, only, windows)
        if a.total_cap:
            pairs = mining.within_budgets(stage(pairs, "mined"), a.total_cap)
        counts = table.merge(pairs)
    for smell, n in sorted(counts.items()):
        print(f"{smell}: {n}")
    return 0


def _mine_rules(spark: SparkSession, changes: DataFrame, table: sinks.PairTable, most: int, seen: str | None) -> dict[str, int]:
    """The newest commits of each smell's rules that earlier runs haven't seen. They are noted when their pairs are in the table; after a loss they are mined again into the same pairs."""
    log = sinks.BatchLog(spark, seen) if seen else None
    found = stage(mining.commits_by_rule(changes, most, seen=log and log.read()), "commits")
    for r in found.groupBy("smell").count().orderBy("smell").collect():
        print(f"{r.smell}: {r['count']} new commits")
    counts = table.merge(mining.mine_by_rule(changes, only=found))
    if log:
        log.append(found, uuid.uuid4().hex, 0)
    release(found)
    return counts


def _pilot(spark: SparkSession, a: argparse.Namespace) -> int:
    """The newest small merged requests of a label: their pairs into a table, and the yield of those that a judge has answered."""
    rows = readers.json_lines(spark, a.pulls, "repo string, pr_number long, merge_commit_sha string, merged_at string, label string, changed_files int")
    some = rows.filter((F.col("label") == a.label) & F.col("merge_commit_sha").isNotNull() & F.col("merged_at").isNotNull())
    chosen = stage(readers.small_requests(some, a.max_files, a.max_prs), "requests")
    print(f"{chosen.count()} requests of at most {a.max_files} files")
    changes = git.changes(spark, a.changes, ref=a.ref) if a.git else spark.read.parquet(a.changes)
    table = sinks.PairTable(spark, a.out)
    for smell, n in sorted(table.merge(mining.mine(changes, mining.REQUESTS, chosen.select("repo", F.col("merge_commit_sha").alias("commit_hash")))).items()):
        print(f"{smell}: {n} candidates")
    pairs = table.read()
    if a.answers and pairs is not None:
        answers = readers.json_lines(spark, a.answers, "id string, response string", key="id").dropDuplicates(["id"])
        _yields(sample.judged(pairs.select("id", "smell_type").join(answers, "id")))
    release(chosen)
    return 0


def _curator(spark: SparkSession, a: argparse.Namespace) -> int:
    """What a reviewer sees, as JSON lines: at most ``--limit`` pairs, in the order of the files; totals first."""
    rows, totals = curation.page(spark, a.raw, a.reviews, a.reviewer, a.adjudicate, a.smell, a.status, not a.no_assignment)
    t = totals.first()
    print(f"{t.total} pairs: {t.reviewed} reviewed, {t.pending} pending")
    for r in rows.orderBy("smell_file", "line").limit(a.limit).drop("line").toJSON().collect():
        print(r)
    return 0


def _verdict(spark: SparkSession, a: argparse.Namespace) -> int:
    """One verdict into the log of a smell; 2 if it breaks a rule."""
    row = (a.id, a.status, a.before_clean, a.after_clean, a.out_of_rule, a.reviewer, a.notes, (a.reason or "").strip() or None, a.confidence, datetime.now(UTC).isoformat())
    given = spark.createDataFrame([row], "id string, status string, before_clean string, after_clean string, out_of_rule boolean, reviewer string, notes string, justificativa string, confianca string, timestamp string")
    try:
        print(f"{curation.give_verdicts(a.reviews, a.smell, given)} verdicts on {a.smell}")
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    return 0


def _compact(spark: SparkSession, a: argparse.Namespace) -> int:
    """Each smell of a table into one folder; with ``--vacuum-hours`` what no reader of that age needs is deleted."""
    table = sinks.PairTable(spark, a.pairs)
    table.compact()
    if a.vacuum_hours is not None:
        print(f"{table.vacuum(older_than_hours=a.vacuum_hours)} folders deleted")
    return 0


def _check(spark: SparkSession, a: argparse.Namespace) -> int:
    """2: no table; 0: no pairs, or all good; 1: a pair fails (or is doubtful, with ``--fail-on-warn``)."""
    pairs = sinks.PairTable(spark, a.pairs).read()
    if pairs is None:
        print("no pairs table", file=sys.stderr)
        return 2
    if a.source:
        pairs = pairs.filter(F.col("source") == a.source)
    if a.smell:
        pairs = detect.keep_smells(pairs, a.smell)
    checks = stage(quality.checked(pairs).select("issues"), "checks")
    row = quality.summary(checks).first()
    print(f"{row.total} pairs: {row.clean} clean, {row.warn} doubtful, {row.fail} failed")
    for r in quality.issue_counts(checks).collect():
        print(f"{r.severity} {r.rule}: {r.n}")
    release(checks)
    return int(row.fail > 0 or (a.fail_on_warn and row.warn > 0))


def _split(spark: SparkSession, a: argparse.Namespace) -> int:
    return _validated(review.schema_errors(sinks.PairTable(spark, a.pairs).read()), a)


def _curate(spark: SparkSession, a: argparse.Namespace) -> int:
    """Verdicts applied to files of pairs, then validation and splits."""
    found = curation.read_curated(spark, a.raw, a.reviews, allow_unreviewed=a.allow_unreviewed, use_assignment=not a.no_assignment)
    if found.kappa is not None:
        for r in found.kappa.orderBy("block").collect():
            print(f"{r.block}: kappa {r.kappa} over {r.n}")
    return _validated(review.schema_errors(found.pairs), a, found.raw)


def _validated(rows: DataFrame, a: argparse.Namespace, raw: dict | None = None) -> int:
    checked = stage(rows, "validated")
    if raw:
        kept = {r.smell_type: r["count"] for r in checked.groupBy("smell_type").count().collect()}
        for name, seen in raw.items():
            print(f"{name}: {seen.get['rows']} pairs in the file")
        print(f"kept: {kept}")
    print(review.validation_report(checked).first())
    valid = checked.filter(F.size("errors") == 0).drop("errors")
    sinks.write_splits(review.split_by_repo(valid, a.val, a.test, a.seed), a.out, a.force)
    release(checked)
    return 0


def _blocks(spark: SparkSession, a: argparse.Namespace) -> int:
    pairs = sinks.PairTable(spark, a.pairs).read().select("id", F.col("smell_type").alias("smell"))
    sinks.write_json(review.assign_blocks(pairs, a.reviewers, a.seed), a.out, a.force)
    return 0


def _catalogue(spark: SparkSession, a: argparse.Namespace) -> int:
    """Entries of a catalogue, of a folder of example files, or both."""
    parts = [readers.catalogue_csv(spark, a.csv)] if a.csv else []
    parts += [readers.example_entries(readers.python_files(spark, a.examples), a.examples_repo)] if a.examples else []
    if not parts:
        print("a catalogue or a folder of examples is needed", file=sys.stderr)
        return 2
    sinks.write_json(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True), a.out, a.force)
    return 0


def _requests(spark: SparkSession, a: argparse.Namespace) -> int:
    """Saved answers of a forge into a cache of requests, and the hashes to mine of each repository."""
    new = readers.requests(spark.read.option("multiLine", "true").json(a.pages))
    old = spark.read.parquet(a.cache) if a.cache else new.limit(0)
    rows = stage(sinks.newest_requests(old, new), "requests")
    rows.write.mode("overwrite" if a.force else "errorifexists").parquet(a.out)
    print(f"{rows.count()} requests of {readers.hashes_by_repo(rows).count()} repositories")
    release(rows)
    return 0


def _backfill(spark: SparkSession, a: argparse.Namespace) -> int:
    """A source for the pairs that have none; the table is written beside the old one."""
    pairs = sinks.PairTable(spark, a.pairs).read()
    row = sinks.backfill_counts(pairs, "source").first()
    sinks.PairTable(spark, a.out).merge(sinks.backfill(pairs, "source", a.source))
    print(f"{row.total} pairs: {row.already} had a source, {row.updated} were given one")
    return 0


def _html(spark: SparkSession, a: argparse.Namespace) -> int:
    """Pages of diffs, the first pairs of each smell by id."""
    pairs = sinks.PairTable(spark, a.pairs).read(a.smell)
    if pairs is None:
        print("no pairs of these smells", file=sys.stderr)
        return 0
    blocks = stage(sample.diff_html(sample.first_of_smell(pairs, a.limit, ["id"])), "html")
    for r in sinks.write_html(blocks, a.out, a.force).orderBy("smell_type").collect():
        print(f"{r.smell_type}: {r.pairs} pairs of {r.repos} repositories")
    release(blocks)
    return 0


def _judge(spark: SparkSession, a: argparse.Namespace) -> int:
    """Answers of a judge (``id``, ``smell_type``, ``response`` as JSON lines) that aren't in ``--done`` yet, parsed and counted.

    With ``--follow`` the answers are a folder that grows: what has come since the last call is added to a log in which each pair has one verdict.
    """
    if a.follow and (a.done or a.pilot):
        print("--follow knows what is done, and takes all that has come: no --done or --pilot", file=sys.stderr)
        return 2
    if a.follow:
        log = sinks.BatchLog(spark, a.out)
        judging.follow(spark.readStream.schema(judging.ANSWER).json(a.answers), log, f"{a.out}/stream").awaitTermination()
        if (verdicts := log.read()) is None:
            print("no answers", file=sys.stderr)
            return 0
        return _yields(verdicts)
    answers = readers.json_lines(spark, a.answers, "id string, smell_type string, response string", key="id")
    if a.done:
        answers = sample.judged_batch(answers, readers.json_lines(spark, a.done, "id string", key="id"), a.pilot)
    verdicts = stage(sample.judged(answers), "verdicts")
    verdicts.write.mode("append").json(a.out)
    _yields(verdicts)
    release(verdicts)
    return 0


def _yields(verdicts: DataFrame) -> int:
    for r in sample.yields(verdicts).orderBy("smell_type").collect():
        print(f"{r.smell_type}: {r.real} of {r.judged} real ({r.percent} %)")
    return 0


def _sample(spark: SparkSession, a: argparse.Namespace) -> int:
    """A sample of the pairs judged real, by whether the code changed as the refactoring changes it, and the rates of that."""
    real = sample.judged_real(sinks.PairTable(spark, a.pairs).read(), readers.annotations(spark, a.annotations))
    sized = real.withColumns({f"lines_{s}": F.col(f"metrics_{s}.nloc") for s in ("before", "after")})
    flagged = stage(quality.pattern_matches(sized).withColumnRenamed("pattern_match", "flag"), "flagged")
    sinks.write_sample(sample.stratified_sample(flagged, seed=a.seed), sample.base_rates(flagged), a.out, a.force)
    release(flagged)
    return 0


def _calibrate(spark: SparkSession, a: argparse.Namespace) -> int:
    """The smallest similarity of moved functions whose sampled pairs behave alike often enough. Runs the mined code: see ``functions.behaviour``."""
    if not a.run_code:
        print("this runs mined code in limited processes: give --run-code to allow it", file=sys.stderr)
        return 2
    changes = spark.read.parquet(a.changes)
    moved = crossfile.moved_functions(mining.commits(changes, mining.Options(require_keyword=False)), similarity=min(a.thresholds))
    sides = moved.select(F.sha2(F.concat_ws("|", "repo", "commit_hash", "file", "old.source", "new.source"), 256).alias("id"), "similarity", F.col("old.source").alias("before"), F.col("new.source").alias("after"))
    moved = stage(sides.dropDuplicates(["id"]), "moved")
    drawn = sample.nested_samples(moved, a.thresholds, a.sample, a.seed)
    run = with_kernel(drawn.select("thresholds", "before", "after"), "r", behaviour.compared, behaviour.RESULT, "before", "after")
    checks = run.select(F.explode("thresholds").alias("threshold"), "r.equivalent", "r.samples", "r.error")
    precisions = stage(sample.behaviour_precision(checks), "precisions")
    for r in precisions.orderBy("threshold").collect():
        print(f"{r.threshold}: {r.equiv} alike, {r.diff} not, {r.inconclusive} unknown of {r.sampled}")
    print(f"chosen: {sample.least_precise_enough(precisions, a.precision).first().threshold}")
    release(moved, precisions)
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="codequarry", description=__doc__)
    top.add_argument("-V", "--version", action="version", version=VERSION)
    sub = top.add_subparsers(required=True)

    def command(name: str, run, *arguments: tuple) -> None:
        p = sub.add_parser(name)
        p.set_defaults(run=run)
        for names, options in arguments:
            p.add_argument(*names, **options)

    arg = lambda *names, **options: (names, options)
    out, force, seed = arg("--out", required=True), arg("--force", action="store_true"), arg("--seed", type=int, default=42)
    smell = arg("--smell", action="append")
    command("scan", _scan, arg("paths", nargs="+"), smell, arg("--json", action="store_true"), arg("--fail-on-detect", action="store_true"), arg("--dedent", action="store_true"), arg("--show", type=int, default=0), arg("--out"))
    command("smells", _smells)
    command(
        "mine", _mine, arg("changes"), out, arg("--since"), arg("--to"), arg("--no-require-keyword", action="store_true"), arg("--merges", action="store_true"), arg("--max-commits", type=int), arg("--cap", type=int),
        arg("--partial-threshold", type=float), arg("--cross-file-threshold", type=float), arg("--identifier-overlap-threshold", type=float, default=0.0), arg("--only"), arg("--source", default="mined_commit"),
        arg("--windows"), arg("--by-rule", action="store_true"), arg("--total-cap", type=int), arg("--git", action="store_true"), arg("--ref", default="HEAD"),
        arg("--requests"), arg("--limit-repos", type=int), arg("--created"), arg("--first-years", type=int, default=7), arg("--waves", type=int), arg("--seen"),
    )
    command("pilot", _pilot, arg("pulls"), arg("changes"), out, arg("--label", default="code-quality"), arg("--max-files", type=int, default=3), arg("--max-prs", type=int, default=300), arg("--answers"), arg("--git", action="store_true"), arg("--ref", default="HEAD"))
    command("curator", _curator, arg("raw"), arg("reviews"), arg("--reviewer"), arg("--adjudicate", action="store_true"), arg("--smell"), arg("--status", default="all", choices=["all", "pending", "reviewed"]), arg("--limit", type=int, default=200), arg("--no-assignment", action="store_true"))
    command("verdict", _verdict, arg("reviews"), arg("smell"), arg("id"), arg("status"), arg("--reviewer"), arg("--reason"), arg("--confidence"), arg("--notes", default=""), arg("--before-clean"), arg("--after-clean"), arg("--out-of-rule", action="store_true"))
    command("compact", _compact, arg("pairs"), arg("--vacuum-hours", type=float))
    command("check", _check, arg("pairs"), arg("--source"), smell, arg("--fail-on-warn", action="store_true"))
    command("split", _split, arg("pairs"), out, force, seed, arg("--val", type=float, default=0.1), arg("--test", type=float, default=0.1))
    command("blocks", _blocks, arg("pairs"), out, force, seed, arg("--reviewers", nargs=3, required=True))
    command("curate", _curate, arg("raw"), arg("reviews"), out, force, seed, arg("--allow-unreviewed", action="store_true"), arg("--no-assignment", action="store_true"), arg("--val", type=float, default=0.1), arg("--test", type=float, default=0.1))
    command("catalogue", _catalogue, arg("csv", nargs="?"), out, force, arg("--examples"), arg("--examples-repo", default=""))
    command("requests", _requests, arg("pages"), out, force, arg("--cache"))
    command("backfill", _backfill, arg("pairs"), out, arg("--source", default="mined_commit"))
    command("html", _html, arg("pairs"), out, force, smell, arg("--limit", type=int, default=50))
    command("judge", _judge, arg("answers"), out, arg("--done"), arg("--pilot", type=int), arg("--follow", action="store_true"))
    command("sample", _sample, arg("pairs"), arg("annotations"), out, force, seed)
    command("calibrate", _calibrate, arg("changes"), seed, arg("--thresholds", type=float, nargs="+", default=[0.5, 0.6, 0.7, 0.8, 0.9]), arg("--sample", type=int, default=50), arg("--precision", type=float, default=0.7), arg("--run-code", action="store_true"))
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    return a.run(spark or SparkSession.builder.appName("codequarry").getOrCreate(), a)


if __name__ == "__main__":
    sys.exit(main())
