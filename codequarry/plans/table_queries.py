"""Queries of the other operators over the relational tables."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.functions import registry
from codequarry.functions.columns import KEYWORDS, SMELLS, escape_html, is_test_path, matched_keywords, mentions_test, nonblank_lines, pair_id, smell_code, smell_name
from codequarry.operators import detect, mining, sample
from codequarry.plans.corpus import table
from codequarry.sources import readers, sinks
from codequarry.sources.scratch import new_path
from codequarry.sources.sinks import BatchLog
from codequarry.streaming import judging


def test_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses taken as paths, with a file name that depends on the page."""
    names = F.array(*map(F.lit, ["test_a.py", "a_test.py", "contest.py", "latest/a.py", "tests/a.py", "test/b.py"]))
    path = F.concat(F.col("url"), F.lit("/"), F.element_at(names, (F.col("page_id") % 6 + 1).cast("int")))
    return table(spark, sf_dir, "pages").select("page_id", is_test_path(path).alias("is_test"), mentions_test(path).alias("mentions_test"))


def keyword_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with a keyword: texts of documents behind a phrase that depends on the document."""
    phrase = F.element_at(F.array(*map(F.lit, KEYWORDS)), (F.col("doc_id") % len(KEYWORDS) + 1).cast("int"))
    message = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" "), F.upper(phrase))).otherwise(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", matched_keywords(message).alias("found"))
    return rows.filter(F.size("found") > 0).select("doc_id", F.array_join("found", ",").alias("keywords"))


def pair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = F.when(F.col("doc_id") % 2 == 0, F.lit("a.py"))
    return table(spark, sf_dir, "documents").select("doc_id", pair_id("source", F.col("doc_id"), file, "lang", F.lit("R1"), "text", F.lit("after")).alias("id"))


def nonblank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(nonblank_lines("text"), F.lit(0)).cast("long").alias("lines"), F.length(escape_html("text")).cast("long").alias("escaped"))


def repo_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as repositories by nation, priorities as smells, orders as what a repository has."""
    place = (F.col("o_custkey") % 25).cast("int")
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("smell_type"), place.alias("place")).agg(F.count("*").alias("available"))
    return mining.budgets(rows.withColumn("repo", F.concat(F.lit("repo_"), F.col("place").cast("string"))), cap=400)


def budgets_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the table function, called from SQL."""
    registry.register(spark)
    table(spark, sf_dir, "orders").createOrReplaceTempView("codequarry_orders")
    return spark.sql(
        """WITH counted AS (SELECT o_orderpriority AS smell_type, CAST(o_custkey % 25 AS INT) AS place, concat('repo_', o_custkey % 25) AS repo, count(*) AS available FROM codequarry_orders GROUP BY ALL)
           SELECT * FROM budgets(TABLE(SELECT *, count(*) OVER (PARTITION BY smell_type) AS repos FROM counted), 400)"""
    )


def capped_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first seven orders of each repository and priority by price, with columns of their own, by the table function."""
    registry.register(spark)
    table(spark, sf_dir, "orders").createOrReplaceTempView("codequarry_orders")
    return spark.sql(
        """SELECT id, repo, smell_type, status FROM capped(TABLE(
             SELECT o_orderkey AS id, concat('repo_', o_custkey % 25) AS repo, o_orderpriority AS smell_type, o_totalprice AS seq, o_orderstatus AS status FROM codequarry_orders), 7)"""
    )


def keyed_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    old = orders.withColumn("run", F.lit("old"))
    new = orders.filter("price > 150000").withColumn("run", F.lit("new"))
    return sinks.merged(old, new, ["id"])


def unseen_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("repo"), (F.col("o_orderkey") % 7).alias("commit_hash"))
    return mining.unseen(orders, orders.filter("commit_hash = 3"))


def request_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("repo"), (F.col("event_id") % 100).alias("pr_number"), F.col("event_id"), F.col("event_type").alias("label"))
    newest = lambda rows: rows.groupBy("repo", "pr_number").agg(F.max_by("label", "event_id").alias("label"), F.max("event_id").alias("event_id"))
    return sinks.newest_requests(newest(events), newest(events.filter("label = 'purchase'")))


def commits_by_repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("repo"), F.when(F.col("o_orderkey") % 9 != 0, F.left(F.sha1(F.col("o_orderkey").cast("string").cast("binary")), F.lit(4))).alias("merge_commit_sha"))
    return readers.hashes_by_repo(orders).select("repo", F.size("commits").cast("long").alias("n"), F.md5(F.array_join("commits", ",").cast("binary")).alias("commits"))


def small_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty newest of at most three files: the limit is the report's."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("repo"), F.col("o_orderkey").alias("pr_number"), F.col("o_orderdate").alias("merged_at"), (F.col("o_orderkey") % 8).alias("changed_files"))
    return readers.small_requests(rows, 3, 50).select("repo", "pr_number", "changed_files")


def request_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many orders each priority and year has, by shards."""
    shards = readers.shards(spark, ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"], list(range(1992, 1999)))
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("label"), F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"))
    return shards.join(orders, ["label", "year"], "left").select("place", "label", "year", F.coalesce("n", F.lit(0)).alias("n"))


def catalogue_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue whose addresses are of commits or, for every fourth page, are not."""
    k = F.col("page_id")
    kinds = F.array(*map(F.lit, ["Extract Method", "Inline Method", "Rename Method", " Move Method "]))
    checks = F.array(*map(F.lit, ["TP", "FP", "CTP", "perhaps", " "]))
    address = F.when(k % 4 == 3, F.col("url")).otherwise(F.concat(F.lit(" https://github.com/o"), (k % 7).cast("string"), F.lit("/n/commit/"), F.md5(k.cast("string").cast("binary"))))
    rows = table(spark, sf_dir, "pages").select(
        k, address.alias("commit"), F.element_at(kinds, (k % 4 + 1).cast("int")).alias("refactoring type"),
        F.when(k % 3 > 0, F.concat(F.lit("Location: src/m_"), k.cast("string"), F.lit('.py\nThe method "run_'), k.cast("string"), F.lit('" is renamed'))).otherwise("").alias("description"),
        F.lit("tool ").alias("tool"), F.element_at(checks, (k % 5 + 1).cast("int")).alias("validation"), F.lit("").alias("note"),
    )
    return readers.catalogue_entries(rows).select("external_refactoring_type", "validation", "repo", "commit_hash", "file", "function_name", "smell_type", "tool", "notes")


def smell_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and names of smells as they are written; what is neither has none."""
    names = F.array(*map(F.lit, [*SMELLS, *SMELLS.values(), "r2", "refused_bequest"]))
    written = F.element_at(names, (F.col("p_partkey") % 12 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), smell_code(written, strict=False).alias("code"), smell_name(written, strict=False).alias("name"))


def smell_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, [*SMELLS, *SMELLS.values()]))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.element_at(names, (F.col("p_partkey") % 10 + 1).cast("int")).alias("smell_type"))
    return detect.keep_smells(rows, ["R2", "dead_code"])


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges' answers in several forms, with the conversation's text behind them."""
    heads = F.array(*map(F.lit, ["REAL\nalta\nok", "aparente\n\n  Baixa confianca\n", "Real, não aparente", "", "  real  \r\nmedia\nporque"]))
    k = F.col("conv_id") * 31 + F.col("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("R"), (k % 5 + 1).cast("string")).alias("smell_type"), F.element_at(heads, (k % 5 + 1).cast("int")).alias("response"))


def judge_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.judged(_answers(spark, sf_dir)).select("conv_id", "turn", "verdict", "confidence", "reason")


def _shorter(smell: str, before: str, after: str) -> str:
    """A judge for the query below: real is what makes code shorter."""
    return f"REAL\nalta\n{smell}" if len(after) < len(before) else f"APARENTE\nbaixa\n{smell}"


class _Lost(Exception):
    """A driver that is lost, in the query below."""


def judge_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns and what follows them, judged as a stream in three batches with every seventh turn in two of them; the first run is lost after its batch was written and before the stream
    knows, the second one before it was written."""
    turns, log = new_path(spark, "turns"), BatchLog(spark, new_path(spark, "verdict-log"))
    k = F.col("conv_id") + F.col("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("before_code"))
    pairs = table(spark, sf_dir, "conversations").join(rows, ["conv_id", "turn"]).select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), F.concat(F.lit("R"), (k % 5 + 1).cast("string")).alias("smell_type"), "before_code", F.col("text").alias("after_code"), k.alias("k"),
    )
    append, checkpoint = log.append, new_path(spark, "judging")

    def lost_after(*batch) -> bool:
        append(*batch)
        raise _Lost

    def lost_before(*batch) -> bool:
        raise _Lost

    for n, lost in enumerate((lost_after, lost_before, append)):
        pairs.filter((F.col("k") % 3 == n) | ((F.col("k") % 7 == 0) & (F.col("k") % 3 == (n + 1) % 3))).drop("k").coalesce(1).write.mode("append").parquet(turns)
        log.append = lost
        try:
            judging.follow(spark.readStream.schema(judging.PENDING).parquet(turns), log, checkpoint, _shorter).awaitTermination()
        except StreamingQueryException as e:
            if "_Lost" not in str(e):
                raise
    return log.read().select("id", "smell_type", "verdict", "confidence", "reason")


def yield_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.yields(sample.judged(_answers(spark, sf_dir).withColumn("smell_type", F.concat(F.lit("R"), (F.col("conv_id") % 5 + 1).cast("string")))))


def pending_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang")
    return sample.pending(docs, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")))


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    smell = F.concat(F.lit("R"), (F.col("doc_id") % 5 + 1).cast("string"))
    return table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id"), smell.alias("smell_type"), (F.col("quality") == 1).alias("flag"))


def base_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.base_rates(_flagged(spark, sf_dir))


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.stratified_sample(_flagged(spark, sf_dir)).select("id", "smell_type", "flag", "sample_id")


def uniform_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.uniform_sample(_flagged(spark, sf_dir), 50).select("id", "smell_type")


def nested_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of orders at three similarities, drawn together."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k.cast("string").alias("id"), F.when(k % 19 > 0, (k % 10) / 10).alias("similarity"))
    return sample.nested_samples(rows, [0.5, 0.7, 0.9], 40).select("id", F.array_join(F.col("thresholds").cast("array<string>"), ",").alias("thresholds"))


def first_of_smell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.first_of_smell(_flagged(spark, sf_dir).withColumn("n", F.col("id").cast("long")), 7, ["n"]).select("id", "smell_type", F.col("number").cast("long").alias("number"))


def _behaviour(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        (F.lit(5) + k % 5).alias("threshold"), (k % 11).alias("samples"), F.when(k % 13 == 0, "timeout").alias("error"), (k % 10 < 3 + k % 5).alias("equivalent"),
    )


def behaviour_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.behaviour_precision(_behaviour(spark, sf_dir)).withColumn("precision", F.round("precision", 6))


def threshold_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.least_precise_enough(sample.behaviour_precision(_behaviour(spark, sf_dir)), 0.5)


def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    smell = F.concat(F.lit("R"), (F.col("doc_id") % 5 + 1).cast("string"))
    said = docs.select("doc_id", sample.messages(smell, F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 2 == 0, F.col("lang"))).alias("m"))
    return said.select("doc_id", F.array_join("m.role", ",").alias("roles"), F.md5(F.array_join("m.content", "|").cast("binary")).alias("content"))


def backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("source")).alias("source"))
    return sinks.backfill(rows, "source", "mined_commit")


def backfill_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 3 > 0, F.col("source")).alias("source"))
    return sinks.backfill_counts(rows, "source")


def test_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result file of two suites for each order, before and after, and the pass rates."""
    k = F.col("o_orderkey")

    def suite(tests, failed, errors, skipped):
        return F.format_string('<testsuite name="s" tests="%d" failures="%d" errors="%d" skipped="%d"></testsuite>', *(c.cast("int") for c in (tests, failed, errors, skipped)))

    before = F.concat(F.lit("<testsuites>"), suite(k % 9 + 3, k % 3, k % 2, F.lit(0)), suite(k % 5, F.lit(0), F.lit(0), k % 5), F.lit("</testsuites>"))
    after = suite(k % 9 + 3, F.lit(0), k % 2, F.lit(1))
    rows = table(spark, sf_dir, "orders").select(k.alias("k"), before.alias("xml"))
    old = readers.test_counts(rows).select("k", F.col("total").alias("total_before"), F.col("passed").alias("passed_before"))
    both = readers.test_counts(table(spark, sf_dir, "orders").select(k.alias("k"), after.alias("xml"))).select("k", F.col("total").alias("total_after"), F.col("passed").alias("passed_after")).join(old, "k")
    return readers.pass_rates(both).select("k", "total_before", "passed_before", "total_after", "passed_after", F.round("delta", 6).alias("delta"))


def test_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    forms = F.array(F.format_string("== %d passed, %d failed, %d error in 1s", k, k % 7, k % 3), F.format_string("== %d passed in 1s", k), F.format_string("%d failed in 2s", k % 7), F.lit("no tests ran"))
    total, passed = readers.test_counts_from_text(F.element_at(forms, (k % 4 + 1).cast("int")))
    return table(spark, sf_dir, "orders").select(k.alias("k"), total.cast("long").alias("total"), passed.cast("long").alias("passed"))


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function of ``p_size`` lines of which those with even numbers ran; every fifth report doesn't know the file."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("int")
    even, odd = (F.to_json(F.filter(F.sequence(F.lit(1), size), lambda i: i % 2 == r)) for r in (0, 1))
    report = F.concat(F.lit('{"files": {"/w/src/m.py": {"executed_lines": '), even, F.lit(', "missing_lines": '), odd, F.lit("}}}"))
    rows = table(spark, sf_dir, "part").select(k.alias("k"), report.alias("report"), F.when(k % 5 == 0, "src/other.py").otherwise("src/m.py").alias("target"), F.lit(3).alias("lineno"), size.alias("end_lineno"))
    return readers.coverage_of(rows).select("k", "exercised", F.round("coverage", 6).alias("coverage"))


QUERIES = {
    f.__name__: f
    for f in (
        test_paths, keyword_recall, pair_ids, nonblank, repo_budget, budgets_in_sql, capped_in_sql, keyed_merge, unseen_commits, request_cache, commits_by_repo, small_requests, request_shards, catalogue_rows, smell_lookup,
        smell_rows, judge_parse, judge_stream, yield_report, pending_pairs, base_rates, stratified_sample, uniform_sample, nested_samples, first_of_smell, behaviour_precision, threshold_choice, chat_messages, backfill,
        backfill_counts, test_results, test_output, coverage,
    )
}

_QUOTED = "[" + ", ".join(f"'{k}'" for k in KEYWORDS) + "]"
_SMELLS = "[" + ", ".join(f"'{k}'" for k in [*SMELLS, *SMELLS.values(), "r2", "refused_bequest"]) + "]"
_ANSWERS = """
WITH a AS (SELECT conv_id, turn, (conv_id * 31 + turn) % 5 AS form, 'R' || (conv_id % 5 + 1) AS smell_type FROM conversations)
"""
_FLAGGED = """
WITH f AS (SELECT CAST(doc_id AS VARCHAR) AS id, 'R' || (doc_id % 5 + 1) AS smell_type, quality = 1 AS flag, sha1('42|' || doc_id) AS draw FROM labels)
"""
_BEHAVIOUR = """
WITH b AS (SELECT 5 + o_orderkey % 5 AS threshold, o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 AS bad, o_orderkey % 10 < 3 + o_orderkey % 5 AS equivalent FROM orders),
p AS (SELECT threshold, count(*) AS sampled, count(*) FILTER (NOT bad AND equivalent) AS equiv, count(*) FILTER (NOT bad AND NOT equivalent) AS diff, count(*) FILTER (bad) AS inconclusive FROM b GROUP BY 1)
"""


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_TASKS = " ".join(f"WHEN {k} THEN {_sql_text(sample.SYSTEM.format(a, b))}" for k, (a, b) in enumerate(sample.TASKS.values()))

_BUDGETS = """
WITH RECURSIVE c AS (SELECT o_orderpriority AS smell_type, CAST(o_custkey % 25 AS INT) AS place, count(*) AS available FROM orders GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY smell_type ORDER BY place) AS i, count(*) OVER (PARTITION BY smell_type) AS repos FROM c),
r AS (
  SELECT smell_type, i, place, CAST(ceil(400.0 / repos) AS BIGINT) AS budget, least(CAST(ceil(400.0 / repos) AS BIGINT), available) AS taken, least(CAST(ceil(400.0 / repos) AS BIGINT), available) AS total FROM n WHERE i = 1
  UNION ALL
  SELECT n.smell_type, n.i, n.place, greatest(0, CAST(ceil((400.0 - r.total) / (n.repos - n.i + 1)) AS BIGINT)), least(greatest(0, CAST(ceil((400.0 - r.total) / (n.repos - n.i + 1)) AS BIGINT)), n.available),
         r.total + least(greatest(0, CAST(ceil((400.0 - r.total) / (n.repos - n.i + 1)) AS BIGINT)), n.available)
  FROM r JOIN n ON n.smell_type = r.smell_type AND n.i = r.i + 1
)
SELECT smell_type, 'repo_' || place AS repo, budget, taken FROM r"""

ORACLE_SQL = {
    "test_paths": """
WITH p AS (SELECT page_id, url || '/' || (['test_a.py', 'a_test.py', 'contest.py', 'latest/a.py', 'tests/a.py', 'test/b.py'])[page_id % 6 + 1] AS path FROM pages)
SELECT page_id, list_has_any(string_split(path, '/')[:-2], ['test', 'tests']) OR string_split(path, '/')[-1] LIKE 'test\\_%' ESCAPE '\\' OR path LIKE '%\\_test.py' ESCAPE '\\' AS is_test,
       contains(lower(path), 'test') AS mentions_test FROM p""",
    "keyword_recall": f"""
WITH d AS (SELECT doc_id, lower(coalesce(text, '') || CASE WHEN doc_id % 3 = 0 THEN ' ' || upper({_QUOTED}[doc_id % {len(KEYWORDS)} + 1]) ELSE '' END) AS low FROM documents),
k AS (SELECT doc_id, list_filter({_QUOTED}, lambda k: contains(low, k)) AS found FROM d)
SELECT doc_id, array_to_string(found, ',') AS keywords FROM k WHERE len(found) > 0""",
    "pair_ids": "SELECT doc_id, left(sha1(coalesce(source, '') || '|' || doc_id || '|' || CASE WHEN doc_id % 2 = 0 THEN 'a.py' ELSE '' END || '|' || coalesce(lang, '') || '|R1|' || coalesce(text, '') || '|after'), 16) AS id FROM documents",
    "nonblank": r"""
SELECT doc_id, CAST(coalesce(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\x0b\f\r]'))), 0) AS BIGINT) AS lines,
       CAST(length(text) + 4 * (length(text) - length(replace(text, '&', ''))) + 3 * (length(text) - length(replace(text, '<', ''))) + 3 * (length(text) - length(replace(text, '>', ''))) AS BIGINT) AS escaped FROM documents""",
    "repo_budget": _BUDGETS,
    "budgets_in_sql": _BUDGETS,
    "capped_in_sql": "SELECT o_orderkey AS id, 'repo_' || (o_custkey % 25) AS repo, o_orderpriority AS smell_type, o_orderstatus AS status FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey % 25, o_orderpriority ORDER BY o_totalprice, o_orderkey) <= 7",
    "keyed_merge": "SELECT o_orderkey AS id, o_totalprice AS price, CASE WHEN o_totalprice > 150000 THEN 'new' ELSE 'old' END AS run FROM orders",
    "unseen_commits": "SELECT DISTINCT o_custkey AS repo, o_orderkey % 7 AS commit_hash FROM orders WHERE o_orderkey % 7 <> 3",
    "request_cache": """
WITH e AS (SELECT user_id AS repo, event_id % 100 AS pr_number, event_id, event_type AS label FROM events)
SELECT repo, pr_number, label, event_id FROM e
QUALIFY row_number() OVER (PARTITION BY repo, pr_number ORDER BY label = 'purchase' DESC, event_id DESC) = 1""",
    "commits_by_repo": """
WITH o AS (SELECT DISTINCT o_custkey % 100 AS repo, left(sha1(CAST(o_orderkey AS VARCHAR)), 4) AS h FROM orders WHERE o_orderkey % 9 <> 0)
SELECT repo, count(*) AS n, md5(string_agg(h, ',' ORDER BY h)) AS commits FROM o GROUP BY 1""",
    "small_requests": "SELECT o_custkey AS repo, o_orderkey AS pr_number, o_orderkey % 8 AS changed_files FROM orders WHERE o_orderkey % 8 <= 3 ORDER BY o_orderdate DESC, o_custkey, o_orderkey LIMIT 50",
    "request_shards": """
WITH s AS (SELECT CAST(7 * l.p + y.p AS INT) AS place, label, CAST(1992 + y.p AS INT) AS year FROM (VALUES (0, '1-URGENT'), (1, '2-HIGH'), (2, '3-MEDIUM'), (3, '4-NOT SPECIFIED'), (4, '5-LOW')) l(p, label), range(7) y(p))
SELECT place, label, s.year, count(o_orderkey) AS n FROM s LEFT JOIN orders ON o_orderpriority = label AND year(o_orderdate) = s.year GROUP BY 1, 2, 3""",
    "catalogue_rows": """
SELECT (['Extract Method', 'Inline Method', 'Rename Method'])[page_id % 4 + 1] AS external_refactoring_type, (['TP', 'FP', 'CTP', 'unknown', 'unknown'])[page_id % 5 + 1] AS validation,
       'https://github.com/o' || (page_id % 7) || '/n' AS repo, md5(CAST(page_id AS VARCHAR)) AS commit_hash, CASE WHEN page_id % 3 > 0 THEN 'src/m_' || page_id || '.py' END AS file,
       CASE WHEN page_id % 3 > 0 THEN 'run_' || page_id END AS function_name, CASE WHEN page_id % 4 < 2 THEN 'R1' END AS smell_type, 'tool' AS tool, CAST(NULL AS VARCHAR) AS notes
FROM pages WHERE page_id % 4 <> 3""",
    "smell_lookup": f"""
WITH w AS (SELECT p_partkey AS k, {_SMELLS}[p_partkey % 12 + 1] AS s, p_partkey % 12 AS i FROM part)
SELECT k, CASE WHEN i < 10 THEN 'R' || (i % 5 + 1) WHEN i = 10 THEN 'R2' END AS code, CASE WHEN i < 11 THEN {_SMELLS}[CASE WHEN i = 10 THEN 7 ELSE i % 5 + 6 END] END AS name FROM w""",
    "smell_rows": f"SELECT p_partkey AS k, {_SMELLS}[p_partkey % 10 + 1] AS smell_type FROM part WHERE p_partkey % 5 IN (1, 4)",
    "judge_stream": """
WITH t AS (SELECT c.conv_id || '-' || c.turn AS id, 'R' || ((c.conv_id + c.turn) % 5 + 1) AS smell_type, length(c.text) < length(p.text) AS shorter
  FROM conversations c JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1)
SELECT id, smell_type, CASE WHEN coalesce(shorter, false) THEN 'real' ELSE 'aparente' END AS verdict, CASE WHEN coalesce(shorter, false) THEN 'alta' ELSE 'baixa' END AS confidence, smell_type AS reason FROM t""",
    "judge_parse": _ANSWERS
    + """SELECT conv_id, turn, CASE WHEN form IN (0, 4) THEN 'real' ELSE 'aparente' END AS verdict, CASE form WHEN 0 THEN 'alta' WHEN 1 THEN 'baixa' ELSE 'media' END AS confidence,
       CASE form WHEN 0 THEN 'ok' WHEN 1 THEN 'aparente' || chr(10) || chr(10) || '  Baixa confianca' WHEN 2 THEN 'Real, não aparente' WHEN 3 THEN '' ELSE 'porque' END AS reason FROM a""",
    "yield_report": _ANSWERS
    + """, y AS (SELECT coalesce(smell_type, 'TOTAL') AS smell_type, count(*) AS judged, count(*) FILTER (form IN (0, 4)) AS real FROM a GROUP BY ROLLUP (smell_type))
SELECT smell_type, judged, real, CAST(floor(real * 100.0 / judged) AS BIGINT) AS percent FROM y WHERE judged > 0""",
    "pending_pairs": "SELECT doc_id AS id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "base_rates": _FLAGGED
    + """, b AS (SELECT coalesce(smell_type, 'TOTAL') AS smell_type, count(*) AS n, count(*) FILTER (flag) AS flag_true FROM f GROUP BY ROLLUP (smell_type))
SELECT smell_type, n, flag_true, n - flag_true AS flag_false, CAST(floor(flag_true * 100.0 / n) AS BIGINT) AS percent FROM b WHERE n > 0""",
    "stratified_sample": _FLAGGED
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY smell_type, flag ORDER BY draw, id) AS place FROM f),
s AS (SELECT *, row_number() OVER (PARTITION BY smell_type ORDER BY place <= 5 DESC, flag DESC, place, id) AS number FROM r)
SELECT id, smell_type, flag, lower(smell_type) || '_' || lpad(CAST(number AS VARCHAR), 6, '0') AS sample_id FROM s WHERE number <= 10""",
    "uniform_sample": _FLAGGED + "SELECT id, smell_type FROM f ORDER BY draw, id LIMIT 50",
    "nested_samples": """
WITH r AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 19 > 0 THEN (o_orderkey % 10) / CAST(10 AS DOUBLE) END AS similarity FROM orders),
p AS (SELECT id, t, row_number() OVER (PARTITION BY t ORDER BY sha1('42|' || id), id) AS place FROM r, (VALUES (CAST(0.5 AS DOUBLE)), (0.7), (0.9)) v(t) WHERE similarity >= t)
SELECT id, string_agg(CAST(t AS VARCHAR), ',' ORDER BY t) AS thresholds FROM p WHERE place <= 40 GROUP BY id""",
    "first_of_smell": _FLAGGED + ", n AS (SELECT id, smell_type, row_number() OVER (PARTITION BY smell_type ORDER BY CAST(id AS BIGINT)) AS number FROM f) SELECT * FROM n WHERE number <= 7",
    "behaviour_precision": _BEHAVIOUR + "SELECT *, round(equiv / CAST(nullif(equiv + diff, 0) AS DOUBLE), 6) AS precision FROM p",
    "threshold_choice": _BEHAVIOUR + "SELECT min(threshold) FILTER (equiv / CAST(equiv + diff AS DOUBLE) > 0.5) AS threshold FROM p",
    "chat_messages": f"""
SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND lang IS NOT NULL THEN 'system,user,assistant' ELSE 'system,user' END AS roles,
       md5(CASE doc_id % 5 {_TASKS} END || '|' || coalesce(text, '') || CASE WHEN doc_id % 2 = 0 AND lang IS NOT NULL THEN '|' || lang ELSE '' END) AS content FROM documents""",
    "backfill": "SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN coalesce(source, 'mined_commit') ELSE 'mined_commit' END AS source FROM documents",
    "backfill_counts": "SELECT count(*) AS total, count(source) FILTER (doc_id % 3 > 0) AS already, count(*) - count(source) FILTER (doc_id % 3 > 0) AS updated FROM documents",
    "test_results": """
WITH t AS (SELECT o_orderkey AS k, CAST(o_orderkey % 9 + 3 AS INT) AS n, CAST(o_orderkey % 3 AS INT) AS f, CAST(o_orderkey % 2 AS INT) AS e FROM orders)
SELECT k, n AS total_before, n - f - e AS passed_before, n - 1 AS total_after, n - 1 - e AS passed_after, round((n - 1 - e) / CAST(n - 1 AS DOUBLE) - (n - f - e) / CAST(n AS DOUBLE), 6) AS delta FROM t""",
    "test_output": """
SELECT o_orderkey AS k, CAST(CASE o_orderkey % 4 WHEN 0 THEN o_orderkey + o_orderkey % 7 + o_orderkey % 3 WHEN 1 THEN o_orderkey WHEN 2 THEN o_orderkey % 7 ELSE 0 END AS BIGINT) AS total,
       CAST(CASE WHEN o_orderkey % 4 < 2 THEN o_orderkey ELSE 0 END AS BIGINT) AS passed FROM orders""",
    "coverage": """
WITH c AS (SELECT p_partkey AS k, CAST(p_size AS INT) AS s FROM part)
SELECT k, CASE WHEN k % 5 <> 0 THEN s >= 4 END AS exercised, CASE WHEN k % 5 <> 0 THEN round(CASE WHEN s > 3 THEN (s // 2 - 1) / CAST(s - 3 AS DOUBLE) ELSE 0.0 END, 6) END AS coverage FROM c""",
}
