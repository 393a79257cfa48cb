"""Queries that write files and read them back, and those of operators that work on whole folders; SQL says what must come back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.functions import behaviour, registry
from codequarry.functions.columns import CODE_OF_FILE, SMELLS
from codequarry.functions.rowwise import with_kernel
from codequarry.operators import curation, detect, mining, quality, sample
from codequarry.plans import corpus
from codequarry.plans.code_queries import CHANGES, FUNCTIONS
from codequarry.plans.corpus import table
from codequarry.sources import readers, scratch, sinks
from codequarry.sources.scratch import new_path


def _written(rows: DataFrame, line: Column, label: str, suffix: str = "") -> str:
    """The folder of a text file with ``line`` of each row."""
    path = new_path(rows.sparkSession, label) + suffix
    rows.select(line.alias("value")).write.text(path)
    return path


def strict_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON lines, one blank line behind each, read strictly."""
    docs = table(spark, sf_dir, "documents")
    path = _written(docs, F.concat(F.to_json(F.struct("doc_id", "lang", "text")), F.lit("\n")), "strict-lines")
    return readers.json_lines(spark, path, "doc_id long, lang string, text string").select("doc_id", "lang", F.md5("text").alias("text_md5"))


def lenient_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth line is cut in half and every seventh has no key; those are skipped."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit("k"), F.col("doc_id").cast("string"))).alias("id"), F.lower("lang").alias("lang"))
    whole = F.to_json(F.struct("doc_id", "id", "lang"))
    path = _written(docs, F.when(F.col("doc_id") % 5 == 0, F.left(whole, F.lit(9))).otherwise(whole), "lenient-lines")
    return readers.json_lines(spark, path, "doc_id long, id string, lang string", strict=False, key="id").select("doc_id", "id", "lang")


def raw_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts, null ones as empty, with quotes and line ends, as CSV."""
    path = new_path(spark, "raw") + ".csv"
    code = F.concat(F.lit('"'), F.coalesce("text", F.lit("")), F.lit('"\nend'))
    table(spark, sf_dir, "documents").select("doc_id", code.alias("code")).write.option("header", "true").option("escape", '"').option("quoteAll", "true").csv(path)
    return readers.raw(spark, path).select(F.col("doc_id").cast("long").alias("doc_id"), F.length("code").cast("long").alias("n"), F.md5("code").alias("code_md5"))


def example_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.example_entries(corpus.part_files(spark, sf_dir), "repo").select("file", "function_name", "source_dataset")


def request_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as answers of a forge, a page for each priority and year; every ninth has no merge commit."""
    k = F.col("o_orderkey")
    oid = F.when(k % 9 != 0, F.sha1(k.cast("string").cast("binary")))
    node = F.struct(k.alias("number"), F.col("o_orderstatus").alias("title"), F.col("o_orderdate").cast("string").alias("mergedAt"), F.struct(oid.alias("oid")).alias("mergeCommit"), F.struct(F.concat(F.lit("o/"), F.col("o_custkey").cast("string")).alias("nameWithOwner")).alias("repository"))
    pages = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("label"), F.year("o_orderdate").alias("year")).agg(F.collect_list(node).alias("nodes"))
    return readers.requests(pages).select("repo", "pr_number", "merge_commit_sha", "label", "year")


def decoded_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as a forge gives them, in base64 with line ends; every sixth in no encoding."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 6 != 0, "base64").otherwise("none").alias("encoding"), F.concat(F.base64(F.col("text").cast("binary")), F.lit("\n")).alias("content"))
    return readers.contents(rows).select("doc_id", F.md5("text").alias("text_md5"))


def evidence_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.findings(detect.functions(corpus.part_files(spark, sf_dir), only=detect.FOUND)).select("path", "qualname", "smell", "evidence")


def rich_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions with loops, elif, try, defaults, comprehensions, decorators, async and positional-only parameters."""
    found = detect.functions(corpus.rich_files(spark, sf_dir))
    n = lambda c: F.size(c).cast("long")
    return found.select(
        "name", F.col("nloc").cast("long").alias("nloc"), F.col("ccn").cast("long").alias("ccn"), F.col("max_depth").cast("long").alias("max_depth"), n("magic").alias("magic"), n("dead").alias("dead"),
        F.array_join("params", ",").alias("params"), F.array_join("called", ",").alias("called"),
    )


def method_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes with a base by key and one from a module."""
    k = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("class C_"), k, F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit("(Base_"), (F.col("p_partkey") % 3).cast("string"), F.lit(", mixins.M[int])"))).otherwise(""), F.lit(":\n    def m(self, a):\n        return a\n"))
    files = table(spark, sf_dir, "part").select(F.concat(F.lit("c_"), k, F.lit(".py")).alias("path"), text.alias("text"))
    return detect.functions(files).select("path", "qualname", F.array_join("owner_bases", ",").alias("bases"))


def functions_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The function table and the detectors, called by name from SQL."""
    registry.register(spark)
    corpus.part_files(spark, sf_dir).createOrReplaceTempView("codequarry_part_files")
    return spark.sql(
        """WITH found AS (SELECT f.path, t.qualname, t.source FROM codequarry_part_files f, LATERAL functions_of(f.text) t)
           SELECT path, qualname, smells_of(source).long_method AS long_method, deep_nesting(source) AS deep_nesting FROM found"""
    )


def mine_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge commits of requests: those of orders of high priority, merges included."""
    wanted = table(spark, sf_dir, "orders").filter("o_orderpriority = '2-HIGH'").select(F.sha1(F.col("o_orderkey").cast("string").cast("binary")).alias("commit_hash"))
    return mining.mine(corpus.modified_files(spark, sf_dir), mining.REQUESTS, wanted).select("repo", "seq", "function_name", "smell_type", "partial", "source")


def _authored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits whose messages name a rule by the order's key, by authors of whom some are bots."""
    k = F.col("seq")
    names = F.array(*map(F.lit, ["ann", "dependabot[bot]", "Bot", "robot"]))
    messages = F.array(*map(F.lit, ["Fix PLR0913 with a dataclass", "plr2004: name the constant", "PLR1702 in passing", "early return for PLR1702", "tidy"]))
    return corpus.modified_files(spark, sf_dir).withColumns({"author": F.element_at(names, (k % 4 + 1).cast("int")), "message": F.element_at(messages, (k % 5 + 1).cast("int"))})


def rule_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _authored(spark, sf_dir).drop("message")
    return mining.files_by_rule(rows).select("repo", "seq", "author")


def mine_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.mine_by_rule(_authored(spark, sf_dir)).select("repo", "seq", "function_name", "smell_type", "partial", "source")


def mine_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A time of its own for each repository with an even number; the others aren't mined."""
    windows = spark.createDataFrame([(f"repo_{k}", f"{1992 + k % 5}-01-01", f"{1994 + k % 5}-12-31") for k in range(0, 25, 2)], "repo string, since string, until string")
    return mining.mine(corpus.modified_files(spark, sf_dir), mining.Options(require_keyword=False), windows=windows).select("repo", "seq", "function_name", "smell_type")


def mine_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs shared out over the repositories by a cap for each smell."""
    pairs = mining.mine(corpus.modified_files(spark, sf_dir), mining.Options())
    kept = mining.within_budgets(pairs, {"R1": 30, "R2": 60, "R3": 200, "R4": 100, "R5": 100_000})
    return kept.groupBy("repo", "smell_type").agg(F.count("*").alias("n"), F.max("seq").alias("last"))


#: Pairs wanted of each smell by the query below.
_WANTED = {"R1": 3, "R2": 10, "R3": 12, "R4": 8, "R5": 14}


def mine_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four repositories at a time, by name, until each smell has its cap; those after that aren't mined."""
    out = sinks.PairTable(spark, new_path(spark, "waves"))
    # What no wave looks at isn't written.
    *_, _ = mining.in_waves(scratch.stage(mining.commits(corpus.modified_files(spark, sf_dir)), "changes"), out.merge, _WANTED, wave=4)
    # Pairs of one commit are in the order of their ids, which SQL doesn't have: how many of each are taken, it knows.
    return out.read().groupBy("repo", "seq", "smell_type").agg(F.count("*").alias("n"))


def rule_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits that two runs take of each rule's, the second one those that the first hasn't seen."""
    rows = scratch.stage(_authored(spark, sf_dir).select("repo", "commit_hash", "seq", "committed_at", "message"), "messages")
    log = sinks.BatchLog(spark, new_path(spark, "seen"))
    for run in (1, 2):
        log.append(scratch.stage(mining.commits_by_rule(rows, 25, seen=log.read()).withColumn("run", F.lit(run)), "run"), "rule-runs", run)
    return log.read().select("repo", "commit_hash", "smell", "run")


def first_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of each customer's repository in the two years after its first order."""
    changes = scratch.stage(corpus.modified_files(spark, sf_dir), "changes")
    created = changes.groupBy("repo").agg(F.min("committed_at").cast("date").cast("string").alias("created_at"))
    made = created.withColumn("created_at", F.when(F.col("repo") != "repo_7", F.col("created_at")).otherwise("2015-01-01"))
    return mining.mine(changes, mining.Options(require_keyword=False), windows=mining.first_years(made, 2)).select("repo", "seq", "function_name", "smell_type")


def pair_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines into a table of pairs, then those that weren't returned of three smells, then odd ones of all smells after a compaction; superseded folders are deleted before it is read."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.concat(F.lit("R"), (F.col("l_orderkey") % 5 + 1).cast("string")).alias("smell_type"), F.col("l_returnflag").alias("flag"), (F.col("l_linenumber") % 2).alias("odd"), F.col("l_partkey").cast("long").alias("seq"),
    )
    out = sinks.PairTable(spark, new_path(spark, "pair-table"))
    out.merge(lines.withColumn("run", F.lit(1)))
    out.merge(lines.filter("flag <> 'R' and smell_type in ('R1', 'R2', 'R3')").withColumn("run", F.lit(2)))
    out.compact()
    out.merge(lines.filter("odd = 1").withColumn("run", F.lit(3)))
    out.vacuum(older_than_hours=0)
    return out.read().groupBy("smell_type", "run").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.sum("seq").alias("seqs"))


def appended_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts appended twice under the code of their smell; of each key one row is read."""
    names = F.array(*map(F.lit, CODE_OF_FILE))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.element_at(names, (F.col("p_partkey") % 5 + 1).cast("int")).alias("smell_type"))
    path = new_path(spark, "appended")
    for run in (1, 2):
        sinks.append_by_code(rows.withColumn("run", F.lit(run)), path)
    return sinks.read_appended(spark, path, "id string, smell_type string, run int", order=("run",)).select("id", "smell_type", "run", "code")


def _annotated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.concat(F.lit("R"), (F.col("p_partkey") % 5 + 1).cast("string")).alias("smell_type"), F.when(F.col("p_partkey") % 8 != 0, F.concat(F.lit("o/"), (F.col("p_partkey") % 30).cast("string"))).alias("repo"))
    verdicts = parts.select("id", F.when(F.col("id").cast("long") % 3 == 0, "real").otherwise("aparente").alias("veredito")).filter(F.col("id").cast("long") % 4 != 0)
    return parts, verdicts


def real_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations written as one object keyed by id, read back and joined with the pairs."""
    parts, verdicts = _annotated(spark, sf_dir)
    path = new_path(spark, "annotations")
    one = verdicts.select(F.concat(F.lit('"'), F.col("id"), F.lit('": '), F.to_json(F.struct("veredito"))).alias("item"))
    one.agg(F.concat(F.lit('{"anotacoes": {'), F.array_join(F.collect_list("item"), ", "), F.lit("}}")).alias("value")).coalesce(1).write.text(path)
    return sample.judged_real(parts, readers.annotations(spark, path)).select("id", "smell_type")


def report_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct repositories of all pairs, and pages of the first twenty of each smell: blocks are the report's."""
    parts, _ = _annotated(spark, sf_dir)
    first = sample.first_of_smell(parts.withColumn("k", F.col("id").cast("long")), 20, ["k"])
    blocks = first.withColumn("html", F.concat(F.lit("<h3>"), F.col("id"), F.lit("</h3>")))
    pages = sinks.write_html(blocks, new_path(spark, "html"))
    whole = sample.distinct_repos(parts).select(F.lit("all").alias("smell_type"), "pairs", "repos")
    return pages.select("smell_type", "pairs", "repos").union(whole)


def numbered_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifty parts of each brand, numbered: the limit is the report's."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("smell_type"))
    return sinks.numbered(sample.first_of_smell(rows, 50, ["k"]), "smell_type", ["k"]).select("k", "smell_type", "item")


def evidence_magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence as JSON under old and new keys, by part."""
    k, n = F.col("p_partkey"), F.col("p_size").cast("string")
    keys = F.array(*map(F.lit, ["lines_of_code", "parametros", "n_params", "magic_numbers_count", "profundidade", "dead_vars", "other"]))
    text = F.concat(F.lit('{"'), F.element_at(keys, (k % 7 + 1).cast("int")), F.lit('": '), F.when(k % 10 == 0, "0").otherwise(n), F.lit("}"))
    rows = table(spark, sf_dir, "part").select(k.alias("k"), F.concat(F.lit("R"), (k % 5 + 1).cast("string")).alias("smell"), text.alias("evidence"))
    return rows.select("k", quality.magnitude_of_evidence("smell", "evidence").alias("magnitude"))


def stored_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the detectors find in each part's function, kept as VARIANT in a table and read back: as the size of the smell, and by the gate of partial pairs that come down by 0 to 11 %."""
    functions = detect.functions(corpus.part_functions(spark, sf_dir).select(F.col("k").cast("string").alias("path"), F.col("source").alias("text")))
    found = scratch.stage(detect.findings(functions, typed=True).select(F.col("path").cast("int").alias("k"), "smell", "details"), "evidence")
    size = quality.magnitude_of_evidence("smell", "details", typed=True)
    # What older detectors call the sizes.
    old_keys = {"R1": "lines_fallback", "R2": "parametros", "R3": "magic_numbers_count", "R4": "profundidade", "R5": "dead_vars"}
    key = F.element_at(F.create_map(*[F.lit(x) for item in old_keys.items() for x in item]), F.col("smell"))
    left = F.parse_json(F.concat(F.lit('{"'), key, F.lit('": '), (size * (100 - F.col("k") % 12) / 100).cast("string"), F.lit("}")))
    code = F.lit("def f(a):\n    b = a\n    return b")
    pairs = found.select(
        "k", F.col("smell").alias("smell_type"), size.alias("size"), code.alias("before_code"), F.replace(code, F.lit("b"), F.lit("c")).alias("after_code"), F.lit(2).alias("n_functions_after"), (F.col("k") % 3 > 0).alias("partial"),
        F.struct(F.lit(True).alias("detected"), F.col("details").alias("evidence")).alias("detector_before"), F.struct(F.lit(True).alias("detected"), left.alias("evidence")).alias("detector_after"),
    )
    checked = quality.checked(scratch.stage(pairs, "evidence-pairs"))
    return checked.select("k", "smell_type", "size", F.exists("issues", lambda i: i["rule"] == "trivial_reduction").alias("trivial"))


def _reviewed(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Folders of pairs and of verdicts, a file for each of two smells: parts, and two reviewers' and an adjudicator's verdicts on them, the older ones first."""
    raw, reviews = new_path(spark, "raw"), new_path(spark, "reviews")
    k = F.col("p_partkey")
    parts = table(spark, sf_dir, "part").select(k.alias("k"), k.cast("string").alias("id"), F.concat(F.lit("def f():\n    return "), k.cast("string")).alias("before_code"), F.lit("def f():\n    return 0").alias("after_code"), F.concat(F.lit("o/"), (k % 30).cast("string")).alias("repo"))
    states = F.array(*map(F.lit, ["clean", "noisy", "rejected"]))
    status = lambda n: F.element_at(states, (F.floor(F.col("k") / n) % 3 + 1).cast("int"))
    said = lambda who, n, keep: parts.filter(keep).select("k", "id", status(n).alias("status"), F.lit(who).alias("reviewer"), F.lit("def f():\n    return 1").alias("before_clean"), F.when(F.col("k") % 4 != 0, "def f():\n    pass").alias("after_clean"), F.lit("2024-02-01").alias("timestamp"))
    log = said("ann", 2, "k % 11 <> 0").union(said("bob", 6, "k % 13 <> 0")).union(said("cid", 18, "k % 2 = 0"))
    for place, smell in enumerate(list(SMELLS.values())[:2]):
        own = F.col("k") % 2 == place
        parts.filter(own).withColumn("smell_type", F.lit(list(SMELLS)[place])).drop("k").coalesce(1).write.json(f"{raw}/{smell}.jsonl")
        log.filter(own).drop("k").coalesce(1).write.json(f"{reviews}/{smell}.reviews.jsonl")
    blocks = parts.select(F.concat(F.lit("B"), (F.col("k") % 3).cast("string")).alias("b"), F.struct("id", F.lit("").alias("smell")).alias("pair")).groupBy("b").agg(F.collect_list("pair").alias("pares"))
    listed = blocks.select(F.struct(F.col("b").alias("id"), F.array(F.lit("ann"), F.lit("bob")).alias("revisores"), F.lit("cid").alias("adjudicator"), "pares").alias("block"))
    listed.agg(F.collect_list("block").alias("blocos")).withColumn("seed", F.lit(42)).coalesce(1).write.json(f"{reviews}/assignment.json")
    return raw, reviews


def curated_double(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that two reviewers and the adjudicator keep, from files."""
    return curation.read_curated(spark, *_reviewed(spark, sf_dir)).pairs.select("id", "smell_type", F.length("after_code").cast("long").alias("after"))


def curated_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.read_curated(spark, *_reviewed(spark, sf_dir)).kappa.select("block", "n", F.round("kappa", 6).alias("kappa"))


def behaviour_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each supplier two functions that give the same, differ, fail alike, or fail on one side only; code of this repository's own."""
    sides = [("a", "a + 1"), ("a and 2", "2 if a else a"), ("a.nothing", "a.missing"), ("0", "a.nothing")]
    # What both functions return, and whether that is alike.
    cases = F.array(*(F.struct(*(F.concat(F.lit("def f(a):\n    return "), F.lit(c)).alias(n) for n, c in zip(("before", "after"), pair, strict=True))) for pair in sides))
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.element_at(cases, (F.col("s_suppkey") % len(sides) + 1).cast("int")).alias("c")).select("k", "c.*")
    checked = with_kernel(rows, "result", behaviour.compared, behaviour.RESULT, "before", "after")
    return checked.select("k", "result.equivalent", F.col("result.samples").cast("long").alias("samples"), (F.col("result.one_raised") > 0).alias("one_raised"))


QUERIES = {
    f.__name__: f
    for f in (
        strict_lines, lenient_lines, raw_csv, example_functions, request_pages, decoded_files, evidence_text, rich_measures, method_bases, functions_in_sql, mine_requests, rule_files, mine_by_rule, mine_windows, mine_budgets, mine_waves, rule_runs, first_years,
        pair_table, appended_results, real_pairs, report_repos, numbered_items, evidence_magnitude, stored_evidence, curated_double, curated_kappa, behaviour_check,
    )
}

_PARTS = "WITH p AS (SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) AS id, CAST(p_size AS INT) AS size FROM part)\n"
_STATUS = "CASE (k // {n}) % 3 WHEN 0 THEN 'clean' WHEN 1 THEN 'noisy' ELSE 'rejected' END"
_VERDICTS = (
    _PARTS
    + f""", v AS (SELECT k, id, 'R' || (k % 2 + 1) AS smell_type, CASE WHEN k % 11 <> 0 THEN {_STATUS.format(n=2)} END AS v1, CASE WHEN k % 13 <> 0 THEN {_STATUS.format(n=6)} END AS v2,
  CASE WHEN k % 2 = 0 THEN {_STATUS.format(n=18)} END AS v3 FROM p)
"""
)
_R2_TO_R5 = "'R' || (p_partkey % 5 + 1)"

ORACLE_SQL = {
    "strict_lines": "SELECT doc_id, lang, md5(text) AS text_md5 FROM documents",
    "lenient_lines": "SELECT doc_id, 'k' || doc_id AS id, lower(lang) AS lang FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 0",
    "raw_csv": """SELECT doc_id, CAST(length(coalesce(text, '')) + 6 AS BIGINT) AS n, md5('"' || coalesce(text, '') || '"' || chr(10) || 'end') AS code_md5 FROM documents""",
    "example_functions": FUNCTIONS + "SELECT 'src/m_' || file || '.py' AS file, 'f_' || k AS function_name, 'sourcery' AS source_dataset FROM m",
    "request_pages": """SELECT 'o/' || o_custkey AS repo, o_orderkey AS pr_number, sha1(CAST(o_orderkey AS VARCHAR)) AS merge_commit_sha, o_orderpriority AS label, CAST(year(CAST(o_orderdate AS DATE)) AS INT) AS year
FROM orders WHERE o_orderkey % 9 <> 0""",
    "decoded_files": "SELECT doc_id, CASE WHEN doc_id % 6 <> 0 THEN md5(text) END AS text_md5 FROM documents",
    "evidence_text": FUNCTIONS
    + """, places AS (SELECT m.*, 2 + filler AS before_literals, 2 + filler + literals AS before_dead FROM m), firsts AS (
  SELECT p.*, CASE WHEN p.method THEN 1 ELSE 0 END AS inside FROM places p
), unreach AS (SELECT k, k % 11 = 0 AS u, (k // 7) % 3 AS dead_vars FROM f)
SELECT path, qualname, 'R1' AS smell, 'nloc=' || nloc || ' ccn=' || ccn || ' statements=' || (CASE WHEN method THEN 0 ELSE nloc - 1 END) AS evidence FROM m WHERE nloc > 30 OR ccn > 10
UNION ALL SELECT path, qualname, 'R2', params || ' parameters: ' || array_to_string(list_transform(range(0, params), lambda i: 'p' || i), ', ') FROM m WHERE params > 5
UNION ALL SELECT path, qualname, 'R3', array_to_string(list_transform(range(0, magic), lambda i: '10' || i || ' (line ' || (before_literals + i + 1) || ')'), ', ') FROM places WHERE magic > 0
UNION ALL SELECT path, qualname, 'R4', 'depth ' || max_depth FROM m WHERE max_depth > 3
UNION ALL SELECT path, qualname, 'R5', array_to_string(list_concat(CASE WHEN u THEN ['unreachable (line ' || nloc || ')'] ELSE [] END,
  list_transform(range(0, dead_vars), lambda i: 'unused_var (line ' || (before_dead + i + 1) || ')')), ', ') FROM places JOIN unreach USING (k) WHERE dead > 0""",
    "rich_measures": _PARTS
    + """SELECT 'r_' || k AS name, CAST(5 + 2 * (k % 4) + 6 * (k % 2) + 4 * CAST(k % 3 = 1 AS INT) + CAST(k % 5 = 1 AS INT) + CAST(k % 7 = 0 AS INT) AS BIGINT) AS nloc,
  CAST(5 + k % 4 + 2 * (k % 2) + 2 * CAST(k % 3 = 1 AS INT) AS BIGINT) AS ccn, CAST(greatest(1 + k % 4, 3 * CAST(k % 3 = 1 AS INT)) AS BIGINT) AS max_depth, CAST(1 AS BIGINT) AS magic,
  CAST(CAST(k % 5 = 1 AS INT) + CAST(k % 7 = 0 AS INT) AS BIGINT) AS dead, 'b,c,rest,more' AS params, CASE WHEN k % 2 = 1 THEN 'clear' ELSE '' END AS called FROM p""",
    "method_bases": _PARTS + "SELECT 'c_' || k || '.py' AS path, 'C_' || k || '.m' AS qualname, CASE WHEN k % 3 <> 0 THEN 'Base_' || (k % 3) || ',mixins.M[int]' ELSE '' END AS bases FROM p",
    "functions_in_sql": FUNCTIONS + "SELECT path, qualname, nloc > 30 OR ccn > 10 AS long_method, max_depth > 3 AS deep_nesting FROM m",
    "mine_requests": CHANGES + "SELECT repo, seq, function_name, smell_type, partial, 'mined_pr' AS source FROM partials WHERE o IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '2-HIGH')",
    "rule_files": """SELECT 'repo_' || (o_custkey % 25) AS repo, o_orderkey AS seq, CASE o_orderkey % 4 WHEN 0 THEN 'ann' ELSE 'robot' END AS author FROM orders
WHERE o_orderkey % 10 <> 0 AND o_orderkey % 4 IN (0, 3) AND o_orderkey IN (SELECT l_orderkey FROM lineitem)""",
    "mine_by_rule": CHANGES + "SELECT repo, seq, function_name, smell_type, partial, 'rule_id_mined' AS source FROM partials WHERE seq % 4 IN (0, 3) AND seq % 5 IN (0, 1, 3)",
    "mine_windows": CHANGES
    + """SELECT repo, seq, function_name, smell_type FROM strict JOIN orders ON o_orderkey = seq
WHERE (o_custkey % 25) % 2 = 0 AND CAST(o_orderdate AS DATE) BETWEEN make_date(1992 + (o_custkey % 25) % 5, 1, 1) AND make_date(1994 + (o_custkey % 25) % 5, 12, 31)""",
    "mine_budgets": CHANGES.replace("WITH l AS", "WITH RECURSIVE l AS")
    + """, per AS MATERIALIZED (SELECT smell_type, repo, count(*) AS available FROM strict WHERE keyword GROUP BY 1, 2),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY smell_type ORDER BY repo) AS place, count(*) OVER (PARTITION BY smell_type) AS n,
  CASE smell_type WHEN 'R1' THEN 30 WHEN 'R2' THEN 60 WHEN 'R3' THEN 200 WHEN 'R4' THEN 100 ELSE 100000 END AS cap FROM per),
fold AS (
  SELECT smell_type, repo, place, n, cap, CAST(ceil(cap / CAST(n AS DOUBLE)) AS BIGINT) AS budget, least(available, CAST(ceil(cap / CAST(n AS DOUBLE)) AS BIGINT)) AS total FROM placed WHERE place = 1
  UNION ALL
  SELECT p.smell_type, p.repo, p.place, p.n, p.cap, CAST(greatest(0, ceil((p.cap - f.total) / CAST(p.n - f.place AS DOUBLE))) AS BIGINT), f.total + least(p.available, CAST(greatest(0, ceil((p.cap - f.total) / CAST(p.n - f.place AS DOUBLE))) AS BIGINT))
  FROM fold f JOIN placed p ON p.smell_type = f.smell_type AND p.place = f.place + 1
), ranked AS (SELECT repo, smell_type, seq, row_number() OVER (PARTITION BY repo, smell_type ORDER BY seq, function_name) AS r FROM strict WHERE keyword)
SELECT repo, smell_type, count(*) AS n, max(seq) AS last FROM ranked JOIN (SELECT repo, smell_type, budget FROM fold) USING (repo, smell_type) WHERE r <= budget GROUP BY 1, 2""",
    "mine_waves": CHANGES.replace("WITH l AS", "WITH RECURSIVE l AS")
    + """, repos AS MATERIALIZED (SELECT repo, row_number() OVER (ORDER BY repo) AS place, count(*) OVER () AS n FROM (SELECT DISTINCT 'repo_' || (o_custkey % 25) AS repo FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))),
caps(smell_type, cap) AS (VALUES ('R1', 3), ('R2', 10), ('R3', 12), ('R4', 8), ('R5', 14)), mined AS MATERIALIZED (SELECT * FROM strict WHERE keyword),
placed AS MATERIALIZED (SELECT smell_type, cap, repos.repo, place, n, (SELECT count(*) FROM mined m WHERE m.repo = repos.repo AND m.smell_type = caps.smell_type) AS available FROM repos, caps),
fold AS (
  SELECT smell_type, repo, place, CAST(ceil(cap / CAST(n AS DOUBLE)) AS BIGINT) AS budget, least(available, CAST(ceil(cap / CAST(n AS DOUBLE)) AS BIGINT)) AS total FROM placed WHERE place = 1
  UNION ALL
  SELECT p.smell_type, p.repo, p.place, CAST(greatest(0, ceil((p.cap - f.total) / CAST(p.n - f.place AS DOUBLE))) AS BIGINT), f.total + least(p.available, CAST(greatest(0, ceil((p.cap - f.total) / CAST(p.n - f.place AS DOUBLE))) AS BIGINT))
  FROM fold f JOIN placed p ON p.smell_type = f.smell_type AND p.place = f.place + 1
), ranked AS (SELECT repo, smell_type, seq, function_name, row_number() OVER (PARTITION BY repo, smell_type ORDER BY seq, function_name) AS r FROM mined)
SELECT repo, seq, smell_type, count(*) AS n FROM ranked JOIN (SELECT repo, smell_type, budget FROM fold) USING (repo, smell_type) WHERE r <= budget GROUP BY ALL""",
    "rule_runs": """
WITH c AS (SELECT 'repo_' || (o_custkey % 25) AS repo, sha1(CAST(o_orderkey AS VARCHAR)) AS commit_hash, o_orderdate, CASE o_orderkey % 5 WHEN 0 THEN 'R2' WHEN 1 THEN 'R3' WHEN 3 THEN 'R4' END AS smell
  FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
p AS (SELECT *, row_number() OVER (PARTITION BY smell ORDER BY o_orderdate DESC, repo, commit_hash) AS place FROM c WHERE smell IS NOT NULL)
SELECT repo, commit_hash, smell, CAST(1 + (place > 25)::INT AS INT) AS run FROM p WHERE place <= 50""",
    "first_years": CHANGES
    + """, made AS (SELECT 'repo_' || (o_custkey % 25) AS made_repo, min(CAST(o_orderdate AS DATE)) AS d FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY 1)
SELECT repo, seq, function_name, smell_type FROM strict JOIN orders ON o_orderkey = seq JOIN made ON made_repo = repo WHERE repo <> 'repo_7' AND CAST(o_orderdate AS DATE) BETWEEN d AND d + INTERVAL 2 YEAR""",
    "pair_table": """WITH l AS (SELECT l_orderkey || '-' || l_linenumber AS id, 'R' || (l_orderkey % 5 + 1) AS smell_type, l_returnflag AS flag, l_linenumber % 2 AS odd, CAST(l_partkey AS BIGINT) AS seq FROM lineitem),
runs AS (
  SELECT smell_type, id, seq, 1 AS run FROM l UNION ALL SELECT smell_type, id, seq, 2 FROM l WHERE flag <> 'R' AND smell_type IN ('R1', 'R2', 'R3') UNION ALL SELECT smell_type, id, seq, 3 FROM l WHERE odd = 1
), merged AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY smell_type, id ORDER BY run DESC, seq DESC) = 1)
SELECT smell_type, run, count(*) AS n, count(DISTINCT id) AS ids, CAST(sum(seq) AS BIGINT) AS seqs FROM merged GROUP BY 1, 2""",
    "appended_results": f"SELECT CAST(p_partkey AS VARCHAR) AS id, CASE p_partkey % 5 WHEN 0 THEN 'long_method' WHEN 1 THEN 'long_param_list' WHEN 2 THEN 'magic_numbers' WHEN 3 THEN 'deep_nesting' ELSE 'dead_code' END AS smell_type, 1 AS run, {_R2_TO_R5} AS code FROM part",
    "real_pairs": f"SELECT CAST(p_partkey AS VARCHAR) AS id, {_R2_TO_R5} AS smell_type FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 4 <> 0",
    "report_repos": f"""WITH p AS (SELECT p_partkey AS k, {_R2_TO_R5} AS smell_type, CASE WHEN p_partkey % 8 <> 0 THEN 'o/' || (p_partkey % 30) ELSE '' END AS repo FROM part)
SELECT smell_type, count(*) AS pairs, count(DISTINCT repo) AS repos FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY smell_type ORDER BY k) <= 20) GROUP BY 1
UNION ALL SELECT 'all', count(*), count(DISTINCT repo) FROM p""",
    "numbered_items": "SELECT p_partkey AS k, p_brand AS smell_type, '#' || row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS item FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) <= 50",
    "evidence_magnitude": """SELECT p_partkey AS k, CASE WHEN p_partkey % 10 = 0 THEN NULL WHEN (p_partkey % 5, p_partkey % 7) IN ((0, 0), (1, 1), (1, 2), (2, 3), (3, 4), (4, 5)) THEN CAST(p_size AS DOUBLE) END AS magnitude FROM part""",
    "stored_evidence": """WITH f AS (
  SELECT CAST(p_partkey AS INT) AS k, CAST(p_partkey AS INT) % 9 AS params, CAST(p_partkey AS INT) % 6 AS depth, CAST(p_size AS INT) % 4 AS literals, (CAST(p_partkey AS INT) // 7) % 3 AS dead,
         CAST(p_size AS INT) AS filler, CASE WHEN CAST(p_partkey AS INT) % 11 = 0 THEN 1 ELSE 0 END AS unreachable FROM part
), m AS (SELECT *, filler + literals + dead + depth + CAST(depth > 0 AS INT) + 3 + unreachable AS nloc FROM f
), found AS (
  SELECT k, 'R1' AS smell_type, CAST(nloc AS DOUBLE) AS size FROM m WHERE nloc > 30 OR depth > 9 UNION ALL SELECT k, 'R2', params FROM m WHERE params > 5 UNION ALL SELECT k, 'R3', literals FROM m WHERE literals > 0
  UNION ALL SELECT k, 'R4', depth FROM m WHERE depth > 3 UNION ALL SELECT k, 'R5', dead + unreachable FROM m WHERE dead + unreachable > 0
)
SELECT k, smell_type, size, k % 3 > 0 AND (size - size * CAST(100 - k % 12 AS DOUBLE) / 100.0::DOUBLE) / size < 0.05::DOUBLE AS trivial FROM found""",
    "curated_double": _VERDICTS
    + """SELECT id, smell_type, CAST(CASE WHEN v1 = 'clean' AND v2 = 'clean' THEN length('def f():' || chr(10) || '    return 0') WHEN v3 = 'noisy' THEN length('def f():' || chr(10) || '    pass') ELSE length('def f():' || chr(10) || '    return 0') END AS BIGINT) AS after
FROM v WHERE v1 IS NOT NULL AND v2 IS NOT NULL AND ((v1 = 'clean' AND v2 = 'clean')
  OR (NOT (v1 = v2 AND v1 IN ('clean', 'rejected')) AND (v3 = 'clean' OR (v3 = 'noisy' AND k % 4 <> 0))))""",
    "curated_kappa": _VERDICTS
    + """, r AS (SELECT 'B' || (k % 3) AS block, v1, v2 FROM v WHERE v1 IS NOT NULL AND v2 IS NOT NULL), n AS (SELECT block, count(*) AS n, avg(CAST(v1 = v2 AS INT)) AS po FROM r GROUP BY 1),
e AS (SELECT a.block, sum(a.p * b.p) AS pe FROM (SELECT block, v1 AS s, count(*) / CAST(sum(count(*)) OVER (PARTITION BY block) AS DOUBLE) AS p FROM r GROUP BY 1, 2) a
  JOIN (SELECT block, v2 AS s, count(*) / CAST(sum(count(*)) OVER (PARTITION BY block) AS DOUBLE) AS p FROM r GROUP BY 1, 2) b ON a.block = b.block AND a.s = b.s GROUP BY 1)
SELECT block, n, round((po - pe) / (1 - pe), 6) AS kappa FROM n JOIN e USING (block)""",
    "behaviour_check": "SELECT s_suppkey AS k, s_suppkey % 4 IN (1, 2) AS equivalent, CAST(10 AS BIGINT) AS samples, s_suppkey % 4 IN (0, 3) AS one_raised FROM supplier",
}
