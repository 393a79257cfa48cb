"""Queries over the derived code corpus: the real parser and detectors run on Spark, SQL says in closed form what they find."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.functions import kernels
from codequarry.functions.columns import KEYWORDS, jaccard, shape_distance
from codequarry.functions.rowwise import with_kernel, with_kernels
from codequarry.operators import crossfile, detect, mining, quality, sample
from codequarry.plans import corpus, git_corpus
from codequarry.sources import git, scratch, sinks
from codequarry.sources.scratch import new_path
from codequarry.streaming import incremental

#: The functions of ``part_files`` and what each measures.
FUNCTIONS = """
WITH f AS (
  SELECT CAST(p_partkey AS INT) AS k, CAST(p_partkey AS INT) // 4 AS file, CAST(p_partkey AS INT) % 9 AS params, CAST(p_partkey AS INT) % 6 AS depth,
         CAST(p_size AS INT) % 4 AS literals, (CAST(p_partkey AS INT) // 7) % 3 AS dead, CAST(p_size AS INT) AS filler,
         CASE WHEN CAST(p_partkey AS INT) % 11 = 0 THEN 1 ELSE 0 END AS unreachable, CAST(p_partkey AS INT) % 5 = 0 AS method
  FROM part
), broken AS (SELECT DISTINCT file FROM f WHERE k % 97 = 0),
m AS (
  SELECT k, file, 'src/m_' || file || '.py' AS path, CASE WHEN method THEN 'C_' || k || '.f_' || k ELSE 'f_' || k END AS qualname, params,
         filler + literals + dead + depth + CAST(depth > 0 AS INT) + 3 + unreachable AS nloc, 1 + depth AS ccn,
         CASE WHEN method THEN 0 ELSE literals END AS magic, CASE WHEN method THEN 0 ELSE depth END AS max_depth,
         CASE WHEN method THEN 0 ELSE dead + unreachable END AS dead, method, filler, literals, depth
  FROM f WHERE file NOT IN (SELECT file FROM broken)
), found AS (
  SELECT path, qualname, 'R1' AS smell, nloc AS magnitude FROM m WHERE nloc > 30 OR ccn > 10
  UNION ALL SELECT path, qualname, 'R2', params FROM m WHERE params > 5
  UNION ALL SELECT path, qualname, 'R3', magic FROM m WHERE magic > 0
  UNION ALL SELECT path, qualname, 'R4', max_depth FROM m WHERE max_depth > 3
  UNION ALL SELECT path, qualname, 'R5', dead FROM m WHERE dead > 0
)
"""

#: The functions that commits change, before (plain names) and after (with a 2).
CHANGES = """
WITH l AS (
  SELECT l_orderkey AS o, CAST(l_linenumber AS INT) AS j, CAST(l_quantity AS INT) AS q, l_returnflag AS flag FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) = 1
), b AS (
  SELECT o, j, flag, q % 9 AS params, j % 6 AS depth, q % 4 AS literals, q % 3 AS dead, CASE WHEN q % 10 = 0 THEN 32 ELSE q % 5 END AS filler, flag = 'R' AND j % 2 = 1 AS helper FROM l
), a AS (
  SELECT *, CASE flag WHEN 'R' THEN 0 WHEN 'A' THEN params // 2 ELSE params END AS params2, CASE flag WHEN 'R' THEN 0 WHEN 'A' THEN depth // 2 ELSE depth END AS depth2,
         CASE flag WHEN 'R' THEN 0 WHEN 'A' THEN literals // 2 ELSE literals END AS literals2, CASE flag WHEN 'R' THEN 0 WHEN 'A' THEN dead // 2 ELSE dead END AS dead2,
         CASE flag WHEN 'R' THEN 1 WHEN 'A' THEN filler // 2 ELSE filler END AS filler2 FROM b
), changes AS (
  SELECT a.*, 'repo_' || (o_custkey % 25) AS repo, o AS seq, CASE WHEN o % 10 = 0 THEN 'tests/' ELSE 'pkg/' END || 'm_' || (o % 50) || '.py' AS file, 'f_' || j AS function_name,
         filler + literals + dead + depth + CAST(depth > 0 AS INT) + 3 AS nloc, filler2 + literals2 + dead2 + depth2 + CAST(depth2 > 0 AS INT) + 3 + CAST(helper AS INT) AS nloc2,
         o % 13 = 0 AS is_merge, o % 5 IN (0, 2, 4) AS keyword
  FROM a JOIN orders ON o = o_orderkey
  WHERE o % 10 <> 0 AND (params <> params2 OR depth <> depth2 OR literals <> literals2 OR dead <> dead2 OR filler <> filler2 OR helper)
), judged AS (
  SELECT *, 'R1' AS smell_type, nloc AS grave, nloc2 AS grave2, nloc2 > 30 AS fires FROM changes WHERE nloc > 30 AND helper
  UNION ALL SELECT *, 'R2', params, params2, params2 > 5 FROM changes WHERE params > 5
  UNION ALL SELECT *, 'R3', literals, literals2, literals2 > 0 FROM changes WHERE literals > 0
  UNION ALL SELECT *, 'R4', depth, depth2, depth2 > 3 FROM changes WHERE depth > 3
  UNION ALL SELECT *, 'R5', dead, dead2, dead2 > 0 FROM changes WHERE dead > 0
), strict AS (SELECT *, FALSE AS partial FROM judged WHERE NOT fires AND NOT is_merge),
partials AS (SELECT *, fires AS partial FROM judged WHERE (NOT fires OR grave2 <= grave * 0.9))
"""


def _functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.functions(corpus.part_files(spark, sf_dir), only=detect.FOUND)


def scan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.counts_by_smell(detect.findings(_functions(spark, sf_dir)))


def scan_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.findings(_functions(spark, sf_dir)).select("path", "qualname", "smell", "magnitude")


def scan_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.scan_totals(corpus.part_files(spark, sf_dir))


def scan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detect.report(corpus.part_files(spark, sf_dir))
    return rows.select("path", F.col("error").isNotNull().alias("failed"), F.coalesce(F.json_array_length("json"), F.lit(0)).cast("long").alias("functions"))


def _detector(smell: str, *measures):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _functions(spark, sf_dir).select("path", "qualname", *(m() for m in measures), detect.has_smell(smell, detect.ROW).alias("detected"))

    return query


def _size(column: str, name: str):
    return lambda: F.greatest(F.coalesce(F.size(column), F.lit(0)), F.lit(0)).alias(name)


detector_r1 = _detector("R1", lambda: F.col("nloc"), lambda: F.col("ccn"), lambda: F.col("n_statements"))
detector_r2 = _detector("R2", _size("params", "n_params"))
detector_r3 = _detector("R3", _size("magic", "n_magic"), lambda: F.array_join(F.transform("magic", lambda x: x["literal"]), ",").alias("numbers"))
detector_r4 = _detector("R4", lambda: F.coalesce("max_depth", F.lit(0)).alias("max_depth"))
detector_r5 = _detector("R5", _size("dead", "n_dead"))


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.sweep(_functions(spark, sf_dir), {"default": detect.DEFAULT, "candidate": detect.CANDIDATE})


def commit_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = corpus.modified_files(spark, sf_dir).drop("before", "after")
    rows = mining.commits(changes, mining.Options(since="1993-01-01", until="1997-12-31 23:59:59"))
    return rows.select("repo", "seq", "file", F.array_join("msg_keywords", ",").alias("keywords"))


def first_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred commits with a keyword of each repository."""
    changes = corpus.modified_files(spark, sf_dir).drop("before", "after")
    return mining.commits(changes, mining.Options(max_commits=100)).select("repo", "seq", "file")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = corpus.modified_files(spark, sf_dir)
    return mining.candidates(mining.commits(changes, mining.Options(require_keyword=False)).filter(~F.startswith("file", F.lit("tests/"))))


def changed_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).select("repo", "seq", "file", F.col("old.qualname").alias("function_name"), F.size("helpers").cast("long").alias("helpers"))


def new_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).select("repo", "seq", F.col("old.qualname").alias("function_name"), F.explode("helpers.qualname").alias("helper"))


def _mined(spark: SparkSession, sf_dir: str, only: DataFrame | None = None, **options) -> DataFrame:
    return mining.mine(corpus.modified_files(spark, sf_dir), mining.Options(**options), only)


def mine_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mined(spark, sf_dir).select("repo", "seq", "file", "function_name", "smell_type", F.size("msg_keywords").cast("long").alias("keywords"), F.col("n_functions_after").cast("long").alias("functions"))


def mine_git(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same commits as bare repositories, read by the git source; the number of the change is in the last line of a message."""
    rows = mining.mine(git.changes(spark, git_corpus.repositories(spark, sf_dir), ref="all", phrases="\n".join(KEYWORDS)))
    seq = F.regexp_extract("commit_msg", "change ([0-9]+)$", 1).cast("long")
    return rows.select("repo", seq.alias("seq"), "file", "function_name", "smell_type", F.size("msg_keywords").cast("long").alias("keywords"), F.col("n_functions_after").cast("long").alias("functions"))


def mine_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _mined(spark, sf_dir, require_keyword=False, partial_threshold=0.1)
    return rows.select("repo", "seq", "function_name", "smell_type", "partial", F.col("magnitude_before").cast("long").alias("before"), F.col("magnitude_after").cast("long").alias("after"))


def mine_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only listed commits, merges included: those of urgent orders."""
    urgent = corpus.table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.sha1(F.col("o_orderkey").cast("string").cast("binary")).alias("commit_hash"))
    rows = mining.mine(corpus.modified_files(spark, sf_dir), mining.LISTED, urgent)
    return rows.select("repo", "seq", "function_name", "smell_type", "partial", "source")


def mine_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five pairs of each smell from each repository."""
    rows = _mined(spark, sf_dir, caps=dict.fromkeys(("R1", "R2", "R3", "R4", "R5"), 5))
    return rows.groupBy("repo", "smell_type").agg(F.countDistinct("id").alias("n"), F.max("seq").alias("last"))


def stream_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commits come in three parts by number, each as often as it likes: the last one again with the second. The stream stops and goes on in between."""
    folder, caps = new_path(spark, "stream-in"), mining.Options(caps=dict.fromkeys(mining.SMELLS, 5))
    out = sinks.PairTable(spark, new_path(spark, "stream-pairs"))
    changes = corpus.modified_files(spark, sf_dir)
    last = changes.agg(F.max("seq")).first()[0] or 0
    for low, high in ((0, last // 3), (last // 4, 2 * last // 3), (last // 2, last + 1)):
        scratch.write_once(changes.filter((F.col("seq") >= low) & (F.col("seq") < high)), folder, mode="append")
        incremental.follow_capped(spark, folder, out, caps).awaitTermination()
    return out.read().groupBy("repo", "smell_type").agg(F.count("*").alias("n"), F.max("seq").alias("last"))


def mine_until_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Caps on two smells: a repository is read up to the commit that fills both."""
    rows = _mined(spark, sf_dir, caps={"R2": 3, "R4": 4})
    return rows.groupBy("repo", "smell_type").agg(F.count("*").alias("n"), F.max("seq").alias("last"))


def mine_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.counts(_mined(spark, sf_dir))


def _sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each function of ``part`` and itself with two further statements, and with as many fewer parameters as it has dead variables."""
    rows = corpus.part_functions(spark, sf_dir)
    name = F.concat(F.lit("f_"), F.col("k").cast("string"))
    less = F.greatest(F.col("params") - F.col("dead"), F.lit(0))
    after = corpus.function_source(name, less, F.col("depth"), F.col("literals"), F.col("dead"), F.col("filler") + 2, F.col("unreachable"))
    return rows.select("k", F.col("source").alias("before_code"), after.alias("after_code"))


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_kernels(_sides(spark, sf_dir), *((side, kernels.measure, f"struct<{kernels.MEASURES}>", (f"{side}_code",)) for side in ("before", "after")))
    distance = shape_distance(F.col("before.shape"), F.col("after.shape"))
    return rows.select("k", F.col("before.shape.n_stmts").cast("long").alias("statements"), F.col("before.shape.n_params").cast("long").alias("params"), F.col("before.shape.n_returns").cast("long").alias("returns"), F.round(distance, 6).alias("distance"))


def identifier_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.part_functions(spark, sf_dir).select("k", "source", F.regexp_replace("source", "dead_", "gone_").alias("other"))
    rows = with_kernels(rows, *((f"in_{side}", kernels.identifiers, "array<string>", (side,)) for side in ("source", "other")), without=("source", "other"))
    return rows.select("k", F.round(jaccard(F.col("in_source"), F.col("in_other")), 6).alias("overlap"))


def tree_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two statements more: the nodes of two assignments of a sum are inserted."""
    rows = corpus.part_functions(spark, sf_dir)
    longer = corpus.function_source(F.concat(F.lit("g_"), F.col("k").cast("string")), *(F.col(c) for c in ("params", "depth", "literals", "dead")), F.col("filler") + 2, F.col("unreachable"))
    scored = with_kernel(rows.select("k", "source", longer.alias("other")), "similarity", kernels.tree_similarity, "double", "source", "other")
    return scored.select("k", F.round("similarity", 6).alias("similarity"))


def cross_file_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three parts, of sizes apart, are a commit that moves their functions, without dead code, to a new file and name.

    Beside each stand a longer function, less alike, and for even keys the same function again in a file that comes later.
    """
    rows = corpus.part_functions(spark, sf_dir).withColumn("filler", F.element_at(F.array(*map(F.lit, (4, 18, 48))), F.col("k") % 3 + 1))
    k, shape = F.col("k").cast("string"), [F.col(c) for c in ("params", "depth", "literals")]
    moved = lambda prefix, more: corpus.function_source(F.concat(F.lit(prefix), k), *shape, F.lit(0), F.col("filler") + more, F.lit(0))
    old = corpus.function_source(F.concat(F.lit("f_"), k), *shape, F.col("dead"), F.col("filler"), F.col("unreachable"))
    files = {"old.py": old, "new.py": F.concat(moved("g_", 0), F.lit("\n\n\n"), moved("h_", 4)), "zew.py": F.when(F.col("k") % 2 == 0, moved("g_", 0))}
    listed = rows.select(F.floor(F.col("k") / 3).cast("long").alias("seq"), F.inline(F.array(*(F.struct(F.lit(n).alias("file"), F.struct("k", t.alias("text")).alias("one")) for n, t in files.items()))))
    texts = listed.filter("one.text is not null").groupBy("seq", "file").agg(F.sort_array(F.collect_list("one")).alias("all")).withColumn("text", F.array_join("all.text", "\n\n\n"))
    gone = F.col("file") == "old.py"
    changes = texts.select(
        F.lit("repo").alias("repo"), F.col("seq").cast("string").alias("commit_hash"), F.lit(None).cast("string").alias("parent_commit"), "seq", F.lit("move").alias("message"), F.array(F.lit("move")).alias("msg_keywords"),
        F.when(gone, F.col("file")).alias("old_path"), F.when(~gone, F.col("file")).alias("new_path"), "file", F.when(gone, F.col("text")).alias("before"), F.when(~gone, F.col("text")).alias("after"),
    )
    found = crossfile.moved_functions(changes)
    pairs = mining.verified(found.drop("file_before", "similarity", "identifier_overlap"), mining.Options(source="cross_file"))
    return pairs.select("seq", "file", "function_name", "smell_type", "source")


def _quality_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of which some have no change, don't parse, are very short, or of an unknown smell."""
    rows = _sides(spark, sf_dir)
    k = F.col("k")
    after = F.when(k % 10 == 0, F.col("before_code")).when(k % 10 == 1, F.lit("def f(:")).when(k % 10 == 2, F.lit("def f():\n    return 0")).when(k % 10 == 3, F.lit("x = 1\ny = 2\nz = 1")).otherwise(F.col("after_code"))
    smell = F.when(k % 10 == 4, "R9").otherwise(F.concat(F.lit("R"), (k % 5 + 1).cast("string")))
    return rows.select(
        "k", "before_code", after.alias("after_code"), smell.alias("smell_type"), F.when(k % 3 == 0, 2).otherwise(1).alias("n_functions_after"),
        (k % 4 == 0).alias("partial"), F.lit(100).alias("magnitude_before"), (F.lit(100) - k % 12).alias("magnitude_after"),
    )


def quality_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All but the similarity rules, of which SQL knows only whether there is a similarity."""
    rows = quality.checked(_quality_pairs(spark, sf_dir))
    named = F.filter("issues", lambda i: ~i["rule"].isin("similarity_borderline", "similarity_too_low"))
    return rows.select("k", F.array_join(F.transform(named, lambda i: F.concat_ws(":", i["severity"], i["rule"])), ",").alias("issues"))


def quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.summary(quality.checked(_quality_pairs(spark, sf_dir)))


def quality_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.issue_counts(quality.checked(_quality_pairs(spark, sf_dir)))


def _pattern_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each smell code that is refactored as it should be and, for odd keys, code that isn't quite."""
    k = corpus.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("k"))
    # Code before and after, and after a change that is no such refactoring.
    cases = [
        ("R1", "def f(a):\n    a = a + 1\n    a = a + 2\n    return a", "def g(a):\n    return a + 2\ndef f(a):\n    return g(a)", "def g(a):\n    return a + 2\ndef f(a):\n    return a"),
        ("R2", "def f(a, b, c):\n    return a + b + c", "def f(o):\n    return o.a + o.b + o.c", "def f(o):\n    return o.x + o.y"),
        ("R3", "def f(a):\n    return a * 86400", "def f(a):\n    return a * DAY_SECONDS", "def f(a):\n    return a * day_seconds"),
        ("R4", "def f(a):\n    if a:\n        if a > 1:\n            return a", "def f(a):\n    if not a:\n        return None\n    if a <= 1:\n        return None\n    return a", "def f(a):\n    if a:\n        return a\n    x = a"),
        ("R5", "def f(a):\n    x = a\n    return a", "def f(a):\n    return a", "def f(a):\n    y = a\n    return y"),
    ]
    options = F.array(*(F.struct(F.lit(s).alias("smell_type"), F.lit(b).alias("before_code"), F.lit(good).alias("good"), F.lit(bad).alias("bad")) for s, b, good, bad in cases))
    rows = k.select("k", F.element_at(options, (F.col("k") % 5 + 1).cast("int")).alias("c"))
    after = F.when(F.col("k") % 7 == 0, F.lit("def f(")).when(F.col("k") % 2 == 0, F.col("c.good")).otherwise(F.col("c.bad"))
    none = F.lit(None).cast("int")
    return rows.select("k", "c.smell_type", "c.before_code", after.alias("after_code"), F.lit("f").alias("function_name"), none.alias("lines_before"), none.alias("lines_after"))


def pattern_proxies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.pattern_matches(_pattern_pairs(spark, sf_dir)).select("k", "smell_type", "pattern", "pattern_match")


def diff_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lines more, and one line replaced where parameters went."""
    rows = sample.diffs(_sides(spark, sf_dir))
    lines = lambda tag, a, b: F.aggregate(F.filter("changes", lambda c: c["tag"] == tag), F.lit(0), lambda n, c: n + c[b] - c[a]).cast("long")
    return rows.select("k", lines("insert", "j1", "j2").alias("inserted"), lines("delete", "i1", "i2").alias("deleted"), lines("replace", "i1", "i2").alias("replaced"))


QUERIES = {
    f.__name__: f
    for f in (
        scan_counts, scan_findings, scan_totals, scan_report, threshold_sweep, commit_recall, first_commits, changed_functions, new_helpers, mine_strict, mine_git, mine_partial, mine_listed,
        mine_capped, stream_capped, mine_until_full, mine_counts, shapes, identifier_overlap, tree_similarity, cross_file_best, quality_checks, quality_summary, quality_issues, pattern_proxies, diff_stats,
    )
} | {"detector_r1": detector_r1, "detector_r2": detector_r2, "detector_r3": detector_r3, "detector_r4": detector_r4, "detector_r5": detector_r5}

_SIDES = """
WITH f AS (
  SELECT CAST(p_partkey AS INT) AS k, CAST(p_partkey AS INT) % 9 AS params, CAST(p_partkey AS INT) % 6 AS depth, CAST(p_size AS INT) % 4 AS literals,
         (CAST(p_partkey AS INT) // 7) % 3 AS dead, CAST(p_size AS INT) AS filler, CASE WHEN CAST(p_partkey AS INT) % 11 = 0 THEN 1 ELSE 0 END AS unreachable
  FROM part
)
"""
_SUM_NODES = "(1 + 1 + 1 + 1 + 1 + 1 + 1 + 1)"  # Assign, Name, Store, BinOp, Name, Load, Add, Constant
_QUALITY = (
    _SIDES
    + """, q AS (
  SELECT *, k % 10 AS d, CASE WHEN k % 10 = 4 THEN 'R9' ELSE 'R' || (k % 5 + 1) END AS smell_type,
         literals + dead + filler + depth + CAST(depth > 0 AS INT) + 3 + unreachable AS lines FROM f
), issues AS (
  SELECT k, 0 AS place, 'fail:no_change' AS issue FROM q WHERE d = 0
  UNION ALL SELECT k, 1, 'fail:after_unparseable' FROM q WHERE d = 1
  UNION ALL SELECT k, 2, 'warn:similarity_unavailable' FROM q WHERE d = 3
  UNION ALL SELECT k, 3, 'warn:after_too_short' FROM q WHERE d = 2
  UNION ALL SELECT k, 4, 'fail:smell_invalid' FROM q WHERE d = 4
  UNION ALL SELECT k, 5, 'warn:r1_no_helper' FROM q WHERE d > 1 AND smell_type = 'R1' AND k % 3 <> 0
  UNION ALL SELECT k, 6, 'warn:trivial_reduction' FROM q WHERE d > 1 AND k % 4 = 0 AND (k % 12) / 100.0 < 0.05
), sizes AS (
  SELECT k, d, params - greatest(params - dead, 0) AS fewer, 9 + params + (filler + literals) * 8 + dead * 5 + CASE WHEN depth > 0 THEN depth * 6 + 8 ELSE 0 END + unreachable * 4 AS n FROM q WHERE d = 2 OR d > 3
), sims AS (  -- of four nodes three are alike; two sums of eight nodes are inserted and parameters taken away
  SELECT k, CASE WHEN d = 2 THEN 1 - (n - 3) / CAST(n AS DOUBLE) ELSE 1 - (16 + fewer) / CAST(n + 16 - fewer AS DOUBLE) END AS sim FROM sizes
), alike AS (
  SELECT k, 'fail:similarity_too_low' AS issue FROM sims WHERE sim < 0.1 UNION ALL SELECT k, 'warn:similarity_borderline' FROM sims WHERE sim >= 0.1 AND sim < 0.3
)
"""
)

_MINED = """SELECT repo, seq, file, function_name, smell_type, CAST(CASE seq % 5 WHEN 0 THEN 1 WHEN 2 THEN 3 ELSE 2 END AS BIGINT) AS keywords,
         CAST(CASE WHEN smell_type = 'R1' THEN 2 ELSE 1 END AS BIGINT) AS functions FROM strict WHERE keyword"""

_CAPPED = """SELECT repo, smell_type, count(*) AS n, max(seq) AS last
FROM (SELECT * FROM strict WHERE keyword QUALIFY row_number() OVER (PARTITION BY repo, smell_type ORDER BY seq, function_name) <= 5) GROUP BY 1, 2"""

ORACLE_SQL = {
    "scan_counts": FUNCTIONS + "SELECT s.smell, count(found.smell) AS n FROM (VALUES ('R1'), ('R2'), ('R3'), ('R4'), ('R5')) s(smell) LEFT JOIN found USING (smell) GROUP BY 1",
    "scan_findings": FUNCTIONS + "SELECT path, qualname, smell, CAST(magnitude AS INT) AS magnitude FROM found",
    "scan_totals": FUNCTIONS
    + """SELECT (SELECT count(DISTINCT file) FROM f) AS files, (SELECT count(*) FROM broken) AS errors, (SELECT count(*) FROM m) AS functions, (SELECT count(*) FROM found) AS findings,
         (SELECT count(DISTINCT path || ':' || qualname) FROM found) AS functions_with_findings, (SELECT count(DISTINCT path) FROM found) AS files_with_findings""",
    "scan_report": FUNCTIONS
    + "SELECT path, FALSE AS failed, count(DISTINCT qualname) AS functions FROM found GROUP BY path UNION ALL SELECT 'src/m_' || file || '.py', TRUE, 0 FROM broken",
    "detector_r1": FUNCTIONS + "SELECT path, qualname, nloc, ccn, CASE WHEN method THEN 0 ELSE nloc - 1 END AS n_statements, nloc > 30 OR ccn > 10 AS detected FROM m",
    "detector_r2": FUNCTIONS + "SELECT path, qualname, params AS n_params, params > 5 AS detected FROM m",
    "detector_r3": FUNCTIONS
    + "SELECT path, qualname, magic AS n_magic, CASE WHEN method THEN NULL ELSE array_to_string(list_transform(range(0, magic), lambda i: '10' || i), ',') END AS numbers, magic > 0 AS detected FROM m",
    "detector_r4": FUNCTIONS + "SELECT path, qualname, max_depth, max_depth > 3 AS detected FROM m",
    "detector_r5": FUNCTIONS + "SELECT path, qualname, dead AS n_dead, dead > 0 AS detected FROM m",
    "threshold_sweep": FUNCTIONS
    + """, grid AS (SELECT * FROM (VALUES ('default', 30, 10, 1000000, 5, 3), ('candidate', 75, 25, 35, 6, 4)) g(thresholds, lines, ccns, statements, params_t, depth_t))
SELECT thresholds, 'R1' AS smell, count(*) FILTER (nloc > lines OR ccn > ccns OR (CASE WHEN method THEN 0 ELSE nloc - 1 END) > statements) AS n FROM m, grid GROUP BY 1
UNION ALL SELECT thresholds, 'R2', count(*) FILTER (params > params_t) FROM m, grid GROUP BY 1 UNION ALL SELECT thresholds, 'R3', count(*) FILTER (magic > 0) FROM m, grid GROUP BY 1
UNION ALL SELECT thresholds, 'R4', count(*) FILTER (max_depth > depth_t) FROM m, grid GROUP BY 1 UNION ALL SELECT thresholds, 'R5', count(*) FILTER (dead > 0) FROM m, grid GROUP BY 1""",
    "commit_recall": """
SELECT 'repo_' || (o_custkey % 25) AS repo, o_orderkey AS seq, CASE WHEN o_orderkey % 10 = 0 THEN 'tests/' ELSE 'pkg/' END || 'm_' || (o_orderkey % 50) || '.py' AS file,
       CASE o_orderkey % 5 WHEN 0 THEN 'refactor' WHEN 2 THEN 'remove dead code,dead code,clean up' ELSE 'parameter object,introduce parameter' END AS keywords
FROM orders WHERE o_orderkey % 5 IN (0, 2, 4) AND o_orderkey % 13 <> 0 AND o_orderdate BETWEEN '1993-01-01' AND '1997-12-31 23:59:59' AND o_orderkey IN (SELECT l_orderkey FROM lineitem)""",
    "first_commits": """
SELECT 'repo_' || (o_custkey % 25) AS repo, o_orderkey AS seq, CASE WHEN o_orderkey % 10 = 0 THEN 'tests/' ELSE 'pkg/' END || 'm_' || (o_orderkey % 50) || '.py' AS file
FROM orders WHERE o_orderkey % 5 IN (0, 2, 4) AND o_orderkey % 13 <> 0 AND o_orderkey IN (SELECT l_orderkey FROM lineitem)
QUALIFY row_number() OVER (PARTITION BY o_custkey % 25 ORDER BY o_orderkey) <= 100""",
    "changed_functions": CHANGES + "SELECT repo, seq, file, function_name, CAST(helper AS BIGINT) AS helpers FROM changes WHERE NOT is_merge",
    "new_helpers": CHANGES + "SELECT repo, seq, function_name, 'h_' || j AS helper FROM changes WHERE NOT is_merge AND helper",
    "mine_strict": CHANGES + _MINED,
    "mine_git": CHANGES + _MINED,
    "mine_partial": CHANGES + "SELECT repo, seq, function_name, smell_type, partial, CAST(grave AS BIGINT) AS before, CAST(grave2 AS BIGINT) AS after FROM partials WHERE NOT is_merge",
    "mine_listed": CHANGES + "SELECT repo, seq, function_name, smell_type, partial, 'adjacent_oracle' AS source FROM partials WHERE o IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    "mine_capped": CHANGES + _CAPPED,
    "stream_capped": CHANGES + _CAPPED,
    "mine_until_full": CHANGES
    + """, ranked AS (SELECT *, CASE smell_type WHEN 'R2' THEN 3 WHEN 'R4' THEN 4 END AS cap, row_number() OVER (PARTITION BY repo, smell_type ORDER BY seq, function_name) AS place FROM strict WHERE keyword),
stops AS (SELECT repo, max(seq) AS stop FROM ranked WHERE place = cap GROUP BY repo HAVING count(*) = 2)
SELECT repo, smell_type, count(*) AS n, max(seq) AS last FROM ranked LEFT JOIN stops USING (repo)
WHERE (cap IS NULL OR place <= cap) AND (stop IS NULL OR seq <= stop) GROUP BY 1, 2""",
    "mine_counts": CHANGES + "SELECT smell_type, count(*) AS n FROM strict WHERE keyword GROUP BY 1",
    "shapes": _SIDES
    + """, s AS (SELECT k, 2 + filler + literals + dead + CAST(depth > 0 AS INT) + unreachable AS n, params, greatest(params - dead, 0) AS params2,
  CASE WHEN depth > 0 THEN depth + 4 ELSE 4 END AS d FROM f)
SELECT k, CAST(n AS BIGINT) AS statements, CAST(params AS BIGINT) AS params, CAST(1 AS BIGINT) AS returns, round((2.0 / (n + 2) + abs(params - params2) / CAST(greatest(params, params2, 1) AS DOUBLE)) / 4, 6) AS distance FROM s""",
    "identifier_overlap": _SIDES + "SELECT k, round(1.0 / (1 + 2 * dead), 6) AS overlap FROM f",
    "tree_similarity": _SIDES
    + f"""SELECT k, round(1.0 - 2.0 * {_SUM_NODES} / (2 + params + 4 + (filler + 2 + literals) * {_SUM_NODES} + dead * 5
  + CASE WHEN depth > 0 THEN depth * 6 + {_SUM_NODES} ELSE 0 END + 3 + unreachable * 4), 6) AS similarity FROM f""",
    "cross_file_best": _SIDES + "SELECT CAST(k // 3 AS BIGINT) AS seq, 'new.py' AS file, 'g_' || k AS function_name, 'R5' AS smell_type, 'cross_file' AS source FROM f WHERE dead + unreachable > 0",
    "quality_summary": _QUALITY
    + """, s AS (SELECT q.k, bool_or(issue LIKE 'fail%') AS failed, count(issue) AS n FROM q LEFT JOIN (SELECT k, issue FROM issues UNION ALL SELECT k, issue FROM alike) i USING (k) GROUP BY 1)
SELECT count(*) AS total, count(*) FILTER (n = 0) AS clean, count(*) FILTER (n > 0 AND NOT failed) AS warn, count(*) FILTER (n > 0 AND failed) AS fail, round(100.0 * count(*) FILTER (n = 0) / count(*), 1) AS clean_percent FROM s""",
    "quality_issues": _QUALITY + "SELECT split_part(issue, ':', 1) AS severity, split_part(issue, ':', 2) AS rule, count(*) AS n FROM (SELECT issue FROM issues UNION ALL SELECT issue FROM alike) GROUP BY 1, 2",
    "quality_checks": _QUALITY + "SELECT q.k, coalesce(string_agg(issue, ',' ORDER BY place), '') AS issues FROM q LEFT JOIN issues USING (k) GROUP BY 1",
    "pattern_proxies": """
SELECT CAST(p_partkey AS INT) AS k, 'R' || (p_partkey % 5 + 1) AS smell_type,
       CASE WHEN p_partkey % 7 = 0 THEN 'parse_fail' ELSE CASE p_partkey % 5 WHEN 0 THEN 'extract_method' WHEN 1 THEN 'parameter_object' WHEN 2 THEN 'named_constant' WHEN 3 THEN 'guard_clauses' ELSE 'dead_code_removal' END END AS pattern,
       p_partkey % 7 <> 0 AND p_partkey % 2 = 0 AS pattern_match
FROM part""",
    "diff_stats": _SIDES
    + "SELECT k, CAST(2 AS BIGINT) AS inserted, CAST(0 AS BIGINT) AS deleted, CAST(CASE WHEN params > 0 AND dead > 0 THEN 1 ELSE 0 END AS BIGINT) AS replaced FROM f",
}
