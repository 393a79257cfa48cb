"""Readers: Python files, JSON lines (strict or lenient), raw pairs, catalogues, saved request pages, test results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codequarry.functions import kernels
from codequarry.functions.columns import SKIPPED_FOLDERS, commit_url_hash, commit_url_repo, described_file, described_function, null_if_empty, stripped
from codequarry.functions.rowwise import with_kernel

REVIEW = "struct<status string, before_clean string, after_clean string, out_of_rule boolean, reviewer string, timestamp string, notes string, justificativa string, confianca string>"
#: Pairs as they are kept on disk; what differs by smell stays JSON text.
PAIR = (
    "id string, before_code string, after_code string, smell_type string, repo string, commit_hash string, parent_commit string, file string, "
    "function_name string, commit_msg string, msg_keywords array<string>, metrics_before string, metrics_after string, detector_before string, "
    f"detector_after string, verified boolean, partial boolean, n_functions_after int, source string, review {REVIEW}"
)
REVIEW_LOG = "id string, smell string, status string, before_clean string, after_clean string, out_of_rule boolean, reviewer string, notes string, justificativa string, confianca string, timestamp string"


def python_files(spark: SparkSession, *paths: str) -> DataFrame:
    """``path`` and ``text`` of the ``.py`` files under folders and of files named outright.

    Folders that never hold the user's code are skipped, but for files named outright. A file under several paths comes once. Bytes that
    aren't UTF-8 are replaced.
    """
    skip = F.array(*map(F.lit, SKIPPED_FOLDERS))
    found = None
    for named in (True, False):
        some = [p for p in paths if p.endswith(".py") == named]
        if some:
            reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.py")
            rows = reader.load(some).select("path", "content")
            rows = rows if named else rows.filter(~F.arrays_overlap(F.split("path", "/"), skip))
            found = rows if found is None else found.union(rows)
    if found is None:
        raise ValueError("no path is given")
    rows = found if len(paths) == 1 else found.dropDuplicates(["path"])
    return rows.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def json_lines(spark: SparkSession, path: str | list[str], schema: str, strict: bool = True, key: str | None = None, order: bool = False) -> DataFrame:
    """One object a line; blank lines don't count.

    A malformed line is an error if ``strict`` and is skipped otherwise; with ``key``, rows without it are skipped too. ``order`` adds ``line``, an
    order within a file that a later line is last in: where it begins in the file and where it comes in its part.
    """
    place = [F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row")).alias("line")] if order else []
    if strict:
        rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
        rows = rows.select(*rows.columns, *place)
    else:
        options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}
        read = F.from_json("value", f"{schema}, __bad string", options).alias("row")
        rows = spark.read.text(path).filter(F.trim("value") != "").select(read, *place).filter("row is not null and row.__bad is null")
        rows = rows.select("row.*", *(["line"] if order else [])).drop("__bad")
    return rows.filter(F.coalesce(F.col(key).cast("string"), F.lit("")) != "") if key else rows


def sidecar(spark: SparkSession, path: str, strict: bool = False) -> DataFrame | None:
    """The last verdict of each (id, reviewer) of a log; None if there is no log, which differs from an empty one."""
    if not _exists(spark, path):
        return None
    log = json_lines(spark, path, REVIEW_LOG, strict, key="id", order=True)
    rest = [c for c in log.columns if c not in ("id", "reviewer", "line")]
    newest = log.groupBy("id", "reviewer").agg(F.max_by(F.struct(*rest), "line").alias("row"))
    return newest.select("id", "reviewer", "row.*")


def raw(spark: SparkSession, path: str) -> DataFrame:
    """Pairs from ``.json`` (a list or one object), ``.jsonl`` or ``.csv`` (texts only)."""
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    if path.endswith(".json"):
        return spark.read.option("multiLine", "true").option("mode", "FAILFAST").json(path)
    if path.endswith(".jsonl"):
        return spark.read.option("mode", "FAILFAST").json(path)
    if path.endswith(".csv"):
        return spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    raise ValueError(f"neither json, jsonl nor csv: {path}")


# Kinds of refactoring in a public catalogue and the smell each belongs to; other kinds have none.
CATALOGUE_SMELLS = {"Extract Method": "R1", "Inline Method": "R1"}


def catalogue_entries(rows: DataFrame) -> DataFrame:
    """Entries from a catalogue's rows (``commit``, ``refactoring type``, ``description``, ``tool``, ``validation``, ``note``).

    Rows whose address isn't one of a commit are dropped; a validation other than TP, FP or CTP is ``unknown``; empty texts are null.
    """
    text = lambda c: null_if_empty(stripped(F.col(f"`{c}`")))
    kind = F.coalesce(text("refactoring type"), F.lit(""))
    smell = F.element_at(F.create_map(*[F.lit(x) for item in CATALOGUE_SMELLS.items() for x in item]), kind)
    checked = text("validation")
    return rows.filter(commit_url_repo("commit").isNotNull()).select(
        F.lit("pyref").alias("source_dataset"),
        kind.alias("external_refactoring_type"),
        F.when(checked.isin("TP", "FP", "CTP"), checked).otherwise("unknown").alias("validation"),
        commit_url_repo("commit").alias("repo"),
        commit_url_hash("commit").alias("commit_hash"),
        described_file("description").alias("file"),
        described_function("description").alias("function_name"),
        smell.alias("smell_type"),
        text("description").alias("description"),
        text("tool").alias("tool"),
        text("note").alias("notes"),
    )


def catalogue_csv(spark: SparkSession, path: str) -> DataFrame:
    return catalogue_entries(spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path))


def _all_functions(text: str | None) -> list[str]:
    import ast

    tree = kernels.parse(text or "")[0]
    return [n.name for n in ast.walk(tree) if isinstance(n, kernels.DEFS)] if tree else []


def example_entries(files: DataFrame, repo: str) -> DataFrame:
    """An entry without a smell for every function anywhere in the files that parse."""
    rows = with_kernel(files.select("path", "text"), "names", _all_functions, "array<string>", "text")
    return rows.select(F.lit("sourcery").alias("source_dataset"), F.lit("unknown").alias("validation"), F.lit(repo).alias("repo"), F.col("path").alias("file"), F.explode("names").alias("function_name"))


def contents(answers: DataFrame) -> DataFrame:
    """``answers`` of a forge for a file (``encoding``, ``content``) with ``text``: base64 as UTF-8, bytes that aren't are replaced; null for other encodings and for what isn't base64."""
    raw = F.try_to_binary(F.regexp_replace("content", r"\s", ""), F.lit("base64"))
    return answers.withColumn("text", F.when(F.col("encoding") == "base64", F.make_valid_utf8(raw.cast("string"))))


ANNOTATION = "struct<veredito:string,confianca:string,justificativa:string,smell:string,ts:string>"


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """Judges' verdicts from a JSON object keyed by pair id, under ``anotacoes`` or at the top: ``id`` and its fields."""
    text = spark.read.text(path, wholetext=True)
    whole = F.from_json("value", f"anotacoes map<string,{ANNOTATION}>", {"mode": "PERMISSIVE"})["anotacoes"]
    plain = F.from_json("value", f"map<string,{ANNOTATION}>", {"mode": "PERMISSIVE"})
    return text.select(F.explode(F.coalesce(whole, plain)).alias("id", "a")).select("id", "a.*")


def requests(pages: DataFrame) -> DataFrame:
    """Merged requests from saved answers of a forge: ``label``, ``year`` and ``nodes``; nodes without a merge commit are dropped."""
    node = pages.select("label", "year", F.explode("nodes").alias("n"))
    return node.filter("n.mergeCommit.oid is not null").select(
        F.col("n.repository.nameWithOwner").alias("repo"), F.col("n.number").cast("long").alias("pr_number"), F.col("n.mergeCommit.oid").alias("merge_commit_sha"),
        F.col("n.mergedAt").alias("merged_at"), F.col("n.title").alias("title"), "label", "year",
    )


def hashes_by_repo(rows: DataFrame, repo: str = "repo", commit: str = "merge_commit_sha") -> DataFrame:
    """``repo`` and ``commits``, the sorted distinct hashes; rows without either are dropped."""
    some = rows.filter(F.col(repo).isNotNull() & F.col(commit).isNotNull())
    return some.groupBy(F.col(repo).alias("repo")).agg(F.sort_array(F.collect_set(commit)).alias("commits"))


def requested(spark: SparkSession, path: str, most_repos: int | None = None) -> DataFrame:
    """``repo`` and ``commit_hash`` of a list of merged requests (JSON lines with ``repo`` and ``merge_commit_sha``), once each; of the ``most_repos`` repositories that come first in the file."""
    rows = json_lines(spark, path, "repo string, merge_commit_sha string", key="merge_commit_sha", order=True).filter(F.coalesce("repo", F.lit("")) != "")
    if most_repos is not None:
        first = rows.groupBy("repo").agg(F.min("line").alias("line")).orderBy("line").limit(most_repos)
        rows = rows.join(first.select("repo"), "repo", "left_semi")
    return rows.select("repo", F.col("merge_commit_sha").alias("commit_hash")).distinct()


def shards(spark: SparkSession, labels: list[str], years: list[int], first: int | None = None) -> DataFrame:
    """Each label with each year, in that order; both lists are arguments, so small."""
    rows = [(k, label, year) for k, (label, year) in enumerate((x, y) for x in labels for y in years)]
    return spark.createDataFrame(rows[:first] if first is not None else rows, "place int, label string, year int")


def small_requests(rows: DataFrame, most_files: int, n: int) -> DataFrame:
    """The ``n`` newest requests of few files."""
    return rows.filter(F.col("changed_files") <= most_files).orderBy(F.desc("merged_at"), "repo", "pr_number").limit(n)


def test_counts(results: DataFrame) -> DataFrame:
    """``results`` (``xml``) with ``total`` and ``passed``: sums over the suites, skipped ones left out; null where the XML isn't valid."""
    attributes = ("tests", "skipped", "failures", "errors")
    own = ", ".join(f"_{a} int" for a in attributes)
    some = results.filter(F.coalesce(F.trim("xml"), F.lit("")) != "")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}
    read = some.withColumn("__read", F.from_xml("xml", f"struct<{own}, testsuite array<struct<{own}>>, __bad string>".replace(" int", ":int").replace(" array", ":array").replace(" string", ":string"), options))
    several = F.col("xml").rlike(r"^\s*(?:<\?[^>]*>\s*|<!--.*?-->\s*)*<testsuites[\s/>]")
    suites = F.when(several, F.coalesce("__read.testsuite", F.array().cast(f"array<struct<{', '.join(f'_{a}:int' for a in attributes)}>>"))).otherwise(F.array(F.struct(*(F.col(f"__read._{a}") for a in attributes))))
    total = lambda a: F.aggregate(F.col("__suites"), F.lit(0), lambda s, x: s + F.coalesce(x[f"_{a}"], F.lit(0)))
    valid = F.col("__read").isNotNull() & F.col("__read.__bad").isNull()
    counted = total("tests") - total("skipped")
    found = read.withColumn("__suites", F.when(valid, suites))
    return found.withColumns({"total": counted, "passed": counted - total("failures") - total("errors")}).drop("__read", "__suites")


def test_counts_from_text(output: Column | str) -> tuple[Column, Column]:
    """Total and passed from the last line of a test run, where no file was written."""
    text = F.coalesce(F.col(output) if isinstance(output, str) else output, F.lit(""))
    whole = r"(\d+) passed(?:, (\d+) failed)?(?:, (\d+) error)?"
    number = lambda pattern, k: F.coalesce(null_if_empty(F.regexp_extract(text, pattern, k)).cast("int"), F.lit(0))
    passed = number(r"(\d+) passed", 1)
    failed = F.when(text.rlike(r"\d+ passed"), number(whole, 2) + number(whole, 3)).otherwise(number(r"(\d+) failed", 1))
    return passed + failed, passed


def coverage_of(reports: DataFrame) -> DataFrame:
    """``reports`` (``report`` JSON, ``target``, ``lineno``, ``end_lineno``) with ``exercised`` and ``coverage`` of the target's lines behind its first.

    The file is the one of the same path, else the first of the same name; null where there is none.
    """
    lines = F.from_json("report", "files map<string, struct<executed_lines array<int>, missing_lines array<int>>>")["files"]
    base = lambda p: F.element_at(F.split(p, "/"), -1)
    same_name = F.filter(F.map_keys("__files"), lambda k: base(k) == base(F.col("target")))
    entry = F.coalesce(F.try_element_at("__files", F.col("target")), F.try_element_at("__files", F.get(F.sort_array(same_name), F.lit(0))))
    body = F.sequence(F.col("lineno") + 1, F.greatest("end_lineno", F.col("lineno") + 1))
    part = lambda f: F.when(F.col("lineno").isNull() | F.col("end_lineno").isNull(), F.array_distinct(F.col("__entry")[f])).when(F.col("end_lineno") > F.col("lineno"), F.array_intersect(F.col("__entry")[f], body)).otherwise(F.array().cast("array<int>"))
    counted = reports.withColumn("__files", lines).withColumn("__entry", entry).withColumns({"__hit": F.size(F.coalesce(part("executed_lines"), F.array().cast("array<int>"))), "__miss": F.size(F.coalesce(part("missing_lines"), F.array().cast("array<int>")))})
    known = F.col("__entry").isNotNull()
    share = F.coalesce(F.try_divide(F.col("__hit"), F.col("__hit") + F.col("__miss")), F.lit(0.0))
    return counted.withColumns({"exercised": F.when(known, F.col("__hit") > 0), "coverage": F.when(known, share)}).drop("__files", "__entry", "__hit", "__miss")


def pass_rates(runs: DataFrame) -> DataFrame:
    """``runs`` with the pass rates before and after (0 where nothing ran) and their difference."""
    rate = lambda side: F.coalesce(F.try_divide(F.col(f"passed_{side}"), F.col(f"total_{side}")), F.lit(0.0))
    return runs.withColumns({"rate_before": rate("before"), "rate_after": rate("after"), "delta": rate("after") - rate("before")})


def assignment(spark: SparkSession, path: str) -> DataFrame | None:
    """Blocks of an assignment file as ``id``, ``smell``, ``block``, ``first``, ``second``, ``adjudicator``; None if there is none. Of an id in several blocks the last counts."""
    if not _exists(spark, path):
        return None
    schema = "seed int, revisores array<string>, blocos array<struct<id string, revisores array<string>, adjudicator string, pares array<struct<id string, smell string>>>>"
    blocks = spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path).select(F.posexplode("blocos").alias("place", "b"))
    rows = blocks.select("place", F.explode("b.pares").alias("pair"), F.col("b.id").alias("block"), F.col("b.revisores")[0].alias("first"), F.col("b.revisores")[1].alias("second"), F.col("b.adjudicator").alias("adjudicator"))
    last = Window.partitionBy("pair.id").orderBy(F.desc("place"))
    return rows.withColumn("n", F.row_number().over(last)).filter("n = 1").select("pair.id", "pair.smell", "block", "first", "second", "adjudicator")
