"""Operators on small made-up rows: scenarios of mining, review, files and streams."""

from __future__ import annotations

import json
import random
import subprocess
import sys
import uuid
from datetime import datetime

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from codequarry import cli
from codequarry.functions import columns, registry
from codequarry.functions.columns import smell_code, stripped
from codequarry.functions.rowwise import with_kernel
from codequarry.operators import crossfile, detect, mining, quality, review, sample
from codequarry.plans import corpus
from codequarry.sources import readers, sinks
from codequarry.sources.scratch import stage
from codequarry.streaming import incremental, judging
from tests.conftest import ROOT


def changes(spark, *rows):
    """Rows of (commit, message, old path, new path, before, after)."""
    full = [("r", c, None, k, datetime(2020, 1, 1 + k), m, c.startswith("merge"), o, n, b, a) for k, (c, m, o, n, b, a) in enumerate(rows)]
    return spark.createDataFrame(full, incremental.CHANGE)


MANY = "def {0}(a, b, c, d, e, f, g, h):\n    return a + b"
ONE = "def {0}(o):\n    return o.a + o.b"


def test_keywords_and_caps(spark):
    six = ["\n\n".join(t.format(f"f{k}") for k in range(6)) for t in (MANY, ONE)]
    three = ["\n\n".join(t.format(f"g{k}") for k in range(3)) for t in (MANY, ONE)]
    rows = changes(spark, ("a", "Introduce parameter object", "x.py", "x.py", *six), ("b", "tidy", "y.py", "y.py", *three), ("merge", "refactor", "z.py", "z.py", *three), ("t", "refactor", "tests/z.py", "tests/z.py", *three))
    count = lambda **o: mining.mine(rows, mining.Options(**o)).filter("smell_type = 'R2'").count()
    assert count() == 6
    assert count(require_keyword=False) == 9
    assert count(require_keyword=False, merges=True) == 12
    assert count(caps={"R2": 3}) == 3
    assert count(max_commits=0) == 0
    only = spark.createDataFrame([("b",)], "commit_hash string")
    found = mining.mine(rows, mining.LISTED, only)
    assert {(r.commit_hash, r.source) for r in found.collect()} == {("b", "adjacent_oracle")}
    assert sorted(r.id for r in mining.mine(rows, mining.LISTED, only).collect()) == sorted(r.id for r in found.collect())
    assert mining.mine(rows, mining.LISTED, only.limit(0)).count() == 0


def test_renames_and_helpers(spark):
    long = "def f(a):\n" + "".join(f"    a = a + {k % 2}\n" for k in range(40)) + "    return a"
    short = "def f(a):\n    return g(a)\n\n\ndef g(a):\n    return a + 1"
    rows = changes(spark, ("a", "extract method", "old.py", "new.py", long, short), ("b", "refactor", "u.py", "u.py", long, "def f(a):\n    return a + 1"))
    (pair,) = mining.mine(rows).collect()
    assert (pair.smell_type, pair.file, pair.n_functions_after, pair.commit_hash) == ("R1", "new.py", 2, "a")
    assert pair.after_code.endswith("\n\n\ndef g(a):\n    return a + 1")
    assert len(pair.id) == 16


def test_methods_count_only_dedented(spark):
    text = "class C:\n    def m(self):\n        return 86400\n"
    files = spark.createDataFrame([("c.py", text)], "path string, text string")
    smells = lambda dedent: [r.smell for r in detect.findings(detect.functions(files, dedent)).collect()]
    assert smells(False) == [] and smells(True) == ["R3"]


def test_moved_functions(spark):
    old = "def f(a):\n    x = 1\n    y = 2\n    z = 3\n    return a + 1"
    new = "def f(a):\n    return a + 1"
    moved = [("m", "move", "a.py", "a.py", old, "y = 1"), ("m", "move", "b.py", "b.py", "y = 1", new)]
    rows = changes(spark, *moved).withColumn("seq", F.lit(1).cast("long"))
    mine = lambda s: mining.mine(rows, mining.Options(require_keyword=False, cross_file=s)).collect()
    assert mine(None) == [] and mine(0.99) == []
    (pair,) = mine(0.3)
    assert (pair.smell_type, pair.source, pair.file) == ("R5", "cross_file", "b.py")
    keyed = mining.commits(rows, mining.Options(require_keyword=False))
    gone, fresh = crossfile.gone_and_fresh(keyed)
    assert (gone.count(), fresh.count()) == (1, 1)


def test_partial(spark):
    rows = changes(spark, ("a", "refactor", "a.py", "a.py", "def f(a):\n    return a + 3 + 4 + 5", "def f(a):\n    return a + 3 + 4"))
    assert mining.mine(rows).count() == 0
    (pair,) = mining.mine(rows, mining.Options(partial_threshold=0.1)).collect()
    assert pair.partial and (pair.magnitude_before, pair.magnitude_after) == (3, 2)
    assert mining.mine(rows, mining.Options(partial_threshold=0.5)).count() == 0
    assert quality.checked(mining.mine(rows, mining.Options(partial_threshold=0.1))).first().issues == [("warn", "before_too_short"), ("warn", "after_too_short")]


def test_the_kernel_runs_once_and_filters_come_first(spark, small, tmp_path):
    path = str(tmp_path / "changes")
    changes(spark, ("a", "refactor", "a.py", "a.py", MANY.format("f"), ONE.format("f"))).write.parquet(path)
    plan = mining.mine(spark.read.parquet(path))._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("MapInArrow") == 1
    assert "EndsWith" in plan or "PushedFilters" in plan
    capped = mining.mine(spark.read.parquet(path), mining.Options(caps={"R2": 3, "R3": 3}))._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in capped.split("== Physical Plan ==")[1]


def test_pair_table_merges(spark, tmp_path):
    table = sinks.PairTable(spark, str(tmp_path / "pairs"))
    assert table.read() is None
    one = spark.createDataFrame([("1", "R1", "a"), ("2", "R1", "a"), ("3", "R2", "a")], "id string, smell_type string, source string")
    two = spark.createDataFrame([("2", "R1", "b"), ("2", "R1", "b"), ("4", "R3", "b")], "id string, smell_type string, source string")
    assert table.merge(one) == {"R1": 2, "R2": 1}
    assert table.merge(two) == {"R1": 1, "R3": 1}
    assert table.merge(two) == {"R1": 1, "R3": 1}
    assert sorted(map(tuple, table.read().collect())) == [("1", "R1", "a"), ("2", "R1", "b"), ("3", "R2", "a"), ("4", "R3", "b")]
    assert table.read(["R2"]).count() == 1


def test_pair_table_keeps_the_last_and_computes_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            calls.add(b.num_rows)
            yield b

    rows = [(str(k % 10), f"R{k % 2 + 1}", k) for k in range(50)]
    new = spark.createDataFrame(rows, "id string, smell_type string, seq long").mapInArrow(seen, "id string, smell_type string, seq long")
    table = sinks.PairTable(spark, str(tmp_path / "pairs"))
    for n in (1, 2):
        assert table.merge(new) == {"R1": 5, "R2": 5}
        assert calls.value == 50 * n
    assert sorted(r.seq for r in table.read().collect()) == list(range(40, 50))


@pytest.mark.parametrize("step", ["create", "rename"])
def test_pair_table_survives_a_lost_driver(spark, tmp_path, step):
    rows = lambda ids: spark.createDataFrame([(i, "R1") for i in ids], "id string, smell_type string")
    table = sinks.PairTable(spark, str(tmp_path / "pairs"))
    table.merge(rows("12"))
    whole = table._fs

    class Lost(Exception):
        pass

    class Broken:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            if name == step:
                raise Lost
            return getattr(self.fs, name)

    table._fs = lambda name: (Broken(whole(name)[0]), whole(name)[1])
    with pytest.raises(Lost):
        table.merge(rows("9"))
    table._fs = whole
    assert sorted(r.id for r in table.read().collect()) == ["1", "2"]
    table.merge(rows("9"))
    assert sorted(r.id for r in table.read().collect()) == ["1", "2", "9"]


def test_kernels_run_on_many_tasks(spark):
    files = spark.createDataFrame([(f"{k}.py", "def f(a):\n    return a") for k in range(200)], "path string, text string").coalesce(1)
    tasks = detect.functions(files).select(F.spark_partition_id().alias("t")).distinct().count()
    assert tasks >= spark.sparkContext.defaultParallelism


def test_intermediate_tables_need_a_shared_folder():
    from codequarry.sources import scratch

    class Nothing:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"getCheckpointDir": staticmethod(lambda: None)})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_root(Nothing)


def test_stream_merges_once(spark, tmp_path):
    folder, table, mark = str(tmp_path / "in"), sinks.PairTable(spark, str(tmp_path / "pairs")), str(tmp_path / "mark")
    batch = changes(spark, ("a", "refactor", "a.py", "a.py", MANY.format("f"), ONE.format("f")))
    for _ in range(2):
        batch.write.mode("append").parquet(folder)
        incremental.follow(spark, folder, table, checkpoint=mark).awaitTermination()
    changes(spark, ("b", "refactor", "b.py", "b.py", MANY.format("g"), ONE.format("g"))).write.mode("append").parquet(folder)
    incremental.follow(spark, folder, table, checkpoint=mark).awaitTermination()
    assert sorted(r.function_name for r in table.read().collect()) == ["f", "g"]


def test_stream_mines_commits_that_come_late(spark, tmp_path):
    folder, table, mark = str(tmp_path / "in"), sinks.PairTable(spark, str(tmp_path / "pairs")), str(tmp_path / "mark")
    for name, when in (("f", "2024-06-01"), ("g", "2020-01-01")):
        batch = changes(spark, (name, "refactor", f"{name}.py", f"{name}.py", MANY.format(name), ONE.format(name)))
        batch.withColumn("committed_at", F.to_timestamp(F.lit(when))).write.mode("append").parquet(folder)
        incremental.follow(spark, folder, table, checkpoint=mark).awaitTermination()
    assert sorted(r.function_name for r in table.read().collect()) == ["f", "g"]


def test_files(spark, tmp_path):
    for name in ("a.py", "sub/b.py", "build/c.py", "d.txt"):
        path = tmp_path / "src" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x = 1\n")
    root = str(tmp_path / "src")
    names = lambda *p: sorted(r.path.split("/src/")[1] for r in readers.python_files(spark, *p).collect())
    assert names(root) == ["a.py", "sub/b.py"]
    assert names(root, f"{root}/build/c.py", f"{root}/a.py") == ["a.py", "build/c.py", "sub/b.py"]


def test_json_lines(spark, tmp_path):
    good, bad = tmp_path / "good.jsonl", tmp_path / "bad.jsonl"
    good.write_text('{"id": "1", "status": "clean"}\n\n{"id": "1", "status": "noisy"}\n{"status": "clean"}\n')
    bad.write_text('{"id": "1", "status": "clean"}\n{"id": \n')
    assert readers.json_lines(spark, str(good), "id string, status string").count() == 3
    assert readers.json_lines(spark, str(good), "id string, status string", key="id").count() == 2
    assert readers.json_lines(spark, str(bad), "id string, status string", strict=False).count() == 1
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        readers.json_lines(spark, str(bad), "id string, status string").collect()
    assert [(r.id, r.reviewer, r.status) for r in readers.sidecar(spark, str(good)).collect()] == [("1", None, "noisy")]
    assert readers.sidecar(spark, str(tmp_path / "none.jsonl")) is None


def test_raw(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": 1},\n {"id": 2}]')
    (tmp_path / "a.csv").write_text('id,text\n1,"two\nlines ""quoted"""\n')
    assert readers.raw(spark, str(tmp_path / "a.json")).count() == 2
    assert readers.raw(spark, str(tmp_path / "a.csv")).first().text == 'two\nlines "quoted"'
    with pytest.raises(FileNotFoundError):
        readers.raw(spark, str(tmp_path / "b.json"))
    with pytest.raises(ValueError):
        readers.raw(spark, str(tmp_path))


def test_requests(spark):
    pages = spark.createDataFrame([("l", 2020, [{"number": 1, "title": "t", "mergedAt": "x", "mergeCommit": {"oid": "h"}, "repository": {"nameWithOwner": "o/r"}}, {"number": 2, "title": "t", "mergedAt": None, "mergeCommit": None, "repository": {"nameWithOwner": "o/r"}}])], "label string, year int, nodes array<struct<number int, title string, mergedAt string, mergeCommit struct<oid string>, repository struct<nameWithOwner string>>>")
    (row,) = readers.requests(pages).collect()
    assert (row.repo, row.pr_number, row.merge_commit_sha) == ("o/r", 1, "h")


def test_test_files(spark):
    texts = ['<testsuite tests="3" failures="1" errors="0" skipped="1"/>', "", None, '<testsuite tests="3"', '<testsuites><testsuite tests="4" errors="1"/><testsuite tests="2"/></testsuites>', "<testsuites></testsuites>", '<?xml version="1.0"?><testsuites><testsuite tests="1"><testcase/></testsuite></testsuites>']
    xml = spark.createDataFrame([(t,) for t in texts], "xml string")
    assert [(r.total, r.passed) for r in readers.test_counts(xml).collect()] == [(2, 1), (None, None), (6, 5), (0, 0), (1, 1)]


def test_example_functions(spark):
    files = spark.createDataFrame([("a.py", "class C:\n    def m(self):\n        def n(): pass"), ("b.py", "def (")], "path string, text string")
    assert sorted(r.function_name for r in readers.example_entries(files, "r").collect()) == ["m", "n"]


def test_kappa(spark):
    def kappa(*pairs):
        blocks = spark.createDataFrame([(str(k), "R1", "B1", "x", "y", "z") for k in range(len(pairs))], "id string, smell string, block string, first string, second string, adjudicator string")
        rows = [(str(k), who, s, None, None) for k, p in enumerate(pairs) for who, s in zip("xy", p, strict=True)]
        return review.agreement(blocks, spark.createDataFrame(rows, "id string, reviewer string, status string, before_clean string, after_clean string")).first().kappa

    c, r = "clean", "rejected"
    assert kappa((c, c), (c, r), (r, c), (r, r)) == 0
    assert kappa((c, c), (r, r)) == 1
    assert kappa((c, c)) is None and kappa((c, c), (c, c)) is None


def test_kappa_called_from_sql(spark):
    registry.register(spark)
    rows = [("x", "a/", "a/"), ("x", "b", "a/"), ("x", "b", "b"), ("x", None, "b"), ("y", "a", "a"), ("y", "a", "a"), ("z", None, None)]
    spark.createDataFrame(rows, "g string, a string, b string").createOrReplaceTempView("ratings")
    found = spark.sql("SELECT g, kappa_of(approx_top_k(rated(a, b), 1000, 10000), count(*)) AS k FROM ratings GROUP BY g")
    assert "partial_approx_top_k" in found._jdf.queryExecution().executedPlan().toString()
    k = {r.g: r.k for r in found.collect()}
    assert k["x"] == pytest.approx((2 / 3 - 4 / 9) / (1 - 4 / 9)) and k["y"] is None and k["z"] is None
    many = "SELECT kappa_of(approx_top_k(rated(cast(id % {} AS string), 'a'), 1000, 10000), count(*)) AS k FROM range({})"
    assert spark.sql(many.format(999, 5000)).first().k == pytest.approx(0)
    for labels in (1000, 7000, 50_000):
        with pytest.raises(Exception, match="more than 999"):
            spark.sql(many.format(labels, 200_000)).collect()


def test_samples_of_all_thresholds_are_drawn_and_run_once(spark, tmp_path):
    rows = stage(spark.range(300).selectExpr("cast(id AS string) AS id", "IF(id % 9 = 0, NULL, (id % 10) / 10D) AS similarity"), "rows")
    thresholds = [0.8, 0.2, 0.5]
    drawn = {r.id: r.thresholds for r in sample.nested_samples(rows, thresholds, 25).collect()}
    for t in thresholds:
        alone = {r.id for r in sample.uniform_sample(rows.filter(F.col("similarity") >= t), 25).collect()}
        assert alone == {i for i, ts in drawn.items() if t in ts} and len(alone) == 25
    assert len(drawn) < 75 and any(len(ts) > 1 for ts in drawn.values())

    def run(i):
        (tmp_path / f"{i}-{uuid.uuid4().hex}").touch()
        return len(i) % 2 == 0

    once = with_kernel(sample.nested_samples(rows, thresholds, 25), "equivalent", run, "boolean", "id")
    checks = once.select(F.explode("thresholds").alias("threshold"), "equivalent", F.lit(1).alias("samples"), F.lit(None).cast("string").alias("error"))
    assert [r.sampled for r in sample.behaviour_precision(checks).collect()] == [25] * 3
    assert len(list(tmp_path.iterdir())) == len(drawn)
    assert sample.nested_samples(rows.limit(0), thresholds, 25).count() == 0


def test_verdicts_come_once(spark, tmp_path):
    """A pair that comes again, a judge that fails, a run that is lost before and after its commit, and another stream over the same pairs."""
    calls, pairs = tmp_path / "calls", str(tmp_path / "pairs")
    calls.mkdir()

    def judge(smell, before, after):
        (calls / f"{before}-{uuid.uuid4().hex}").touch()
        if before == "bad" and not after:
            raise ValueError("no answer")
        return f"REAL\nalta\n{smell}"

    def come(*rows):
        spark.createDataFrame([(i, "long_method", b, a) for i, b, a in rows], judging.PENDING).coalesce(1).write.mode("append").parquet(pairs)

    def run(checkpoint="one"):
        judging.follow(spark.readStream.schema(judging.PENDING).parquet(pairs), log, str(tmp_path / checkpoint), judge).awaitTermination()

    log = sinks.BatchLog(spark, str(tmp_path / "log"))
    assert log.read() is None and log.vacuum(0) == 0
    come(("1", "a", "x"), ("1", "a", "x"), (None, "n", "x"), ("2", "bad", None), ("3", None, None))
    commit, log._commit = log._commit, None
    with pytest.raises(Exception):
        run()  # lost between its rows and its commit
    log._commit = commit
    assert log.read() is None
    run()
    assert sorted(r.id for r in log.read().collect()) == ["1", "3"]
    assert len(list(calls.glob("a-*"))) == 2, "once in the lost run, once more after it"
    append = log.append

    def lost(*batch):
        append(*batch)
        raise RuntimeError("lost after the commit")

    come(("1", "a", "x"), ("4", "d", "x"), ("2", "bad", "x"))
    log.append = lost
    with pytest.raises(Exception, match="lost after"):
        run()
    log.append = append
    before = len(list(calls.iterdir()))
    run()
    run("two")
    assert sorted((r.id, r.smell_type, r.verdict) for r in log.read().collect()) == [(i, "R1", "real") for i in "1234"]
    assert len(list(calls.iterdir())) == before, "nothing is asked twice"
    assert log.vacuum(0) == 1 and log.read().count() == 4


def test_answers_followed_by_command(spark, tmp_path, capsys):
    answers, out = tmp_path / "answers", str(tmp_path / "verdicts")
    answers.mkdir()
    for k in range(2):
        (answers / f"{k}.jsonl").write_text("".join(json.dumps({"id": str(i), "smell_type": "R2", "response": "REAL" if i % 2 else "no"}) + "\n" for i in range(k + 3)))
        assert cli.main(["judge", str(answers), "--out", out, "--follow"], spark) == 0
    assert "TOTAL: 1 of 3 real" in (said := capsys.readouterr().out) and "TOTAL: 2 of 4 real" in said
    assert cli.main(["judge", str(answers), "--out", out, "--follow", "--pilot", "3"], spark) == 2


def test_splits_need_enough(spark):
    rows = spark.createDataFrame([(str(k), f"r{k % 2}", "R1") for k in range(10)], "id string, repo string, smell_type string")
    with pytest.raises(ValueError, match="too little"):
        review.split_by_repo(rows)
    with pytest.raises(ValueError, match="three"):
        review.assign_blocks(rows.selectExpr("id", "smell_type as smell"), ["a", "a", "b"])


def test_messages_and_codes(spark):
    row = spark.range(1).select(sample.messages(F.lit("magic_numbers"), F.lit("x"), F.lit(None).cast("string")).alias("m"), stripped(F.lit("\u2003 a\x1f\n")).alias("s")).first()
    assert [m.role for m in row.m] == ["system", "user"]
    with pytest.raises(Exception, match="unknown smell"):
        spark.range(1).select(smell_code(F.lit("R9"))).collect()
    with pytest.raises(ValueError):
        detect.selected(["R9"])
    assert detect.selected(["r2", "dead_code", "R2"]) == ["R2", "R5"]


def test_html(spark):
    pair = spark.createDataFrame([("R1", "https://github.com/o/n", "0123456789", "f<a>", "a\nb", "a\nc & d")], "smell_type string, repo string, commit_hash string, function_name string, before_code string, after_code string")
    html = sample.diff_html(pair).first().html
    assert "o/n 0123456 f&lt;a&gt;" in html and "c &amp; d" in html and '<tr class="replace">' in html


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.py").write_text("def f(a):\n    return a * 86400\n")
    assert cli.main(["scan", str(tmp_path), "--show", "5"], spark) == 0
    assert "R3 magic_numbers: 1" in capsys.readouterr().out
    assert cli.main(["scan", str(tmp_path), "--fail-on-detect", "--smell", "R3"], spark) == 1
    assert cli.main(["scan", str(tmp_path), "--fail-on-detect", "--smell", "deep_nesting"], spark) == 0
    (tmp_path / "empty").mkdir()
    assert cli.main(["scan", str(tmp_path / "empty")], spark) == 2
    assert cli.main(["smells"], spark) == 0
    path = str(tmp_path / "changes")
    changes(spark, ("a", "refactor", "a.py", "a.py", MANY.format("f"), ONE.format("f"))).write.parquet(path)
    assert cli.main(["mine", path, "--out", str(tmp_path / "pairs")], spark) == 0
    assert cli.main(["check", str(tmp_path / "pairs")], spark) == 0
    assert cli.main(["check", str(tmp_path / "pairs"), "--fail-on-warn"], spark) == 1
    assert cli.main(["check", str(tmp_path / "nothing")], spark) == 2
    assert cli.main(["blocks", str(tmp_path / "pairs"), "--out", str(tmp_path / "blocks"), "--reviewers", "a", "b", "c"], spark) == 0


def test_other_commands(spark, tmp_path, capsys):
    path, pairs = str(tmp_path / "changes"), str(tmp_path / "pairs")
    rows = [("a", "refactor", f"{k}.py", f"{k}.py", MANY.format(f"f{k}"), ONE.format(f"f{k}")) for k in range(6)]
    changes(spark, *rows).withColumn("repo", F.concat(F.lit("r"), F.element_at(F.split("new_path", r"\."), 1))).write.parquet(path)
    assert cli.main(["mine", path, "--out", pairs, "--total-cap", "5"], spark) == 0
    assert sinks.PairTable(spark, pairs).read().count() == 5
    (tmp_path / "w.json").write_text('[{"repo": "r1", "since": "2020-01-01", "to": "2020-12-31"}]')
    assert cli.main(["mine", path, "--out", str(tmp_path / "windowed"), "--windows", str(tmp_path / "w.json")], spark) == 0
    assert [r.repo for r in sinks.PairTable(spark, str(tmp_path / "windowed")).read().collect()] == ["r1"]
    assert cli.main(["backfill", pairs, "--out", str(tmp_path / "filled")], spark) == 0
    assert cli.main(["html", pairs, "--out", str(tmp_path / "html")], spark) == 0
    assert "R2: 5 pairs of 5 repositories" in capsys.readouterr().out
    ids = [r.id for r in sinks.PairTable(spark, pairs).read().collect()]
    (tmp_path / "answers.jsonl").write_text("".join(json.dumps({"id": i, "smell_type": "R2", "response": "REAL\nalta\nok"}) + "\n" for i in ids))
    assert cli.main(["judge", str(tmp_path / "answers.jsonl"), "--out", str(tmp_path / "verdicts")], spark) == 0
    assert "TOTAL: 5 of 5 real (100 %)" in capsys.readouterr().out
    (tmp_path / "annotations.json").write_text(json.dumps({"anotacoes": {i: {"veredito": "real"} for i in ids[:3]}}))
    assert cli.main(["sample", pairs, str(tmp_path / "annotations.json"), "--out", str(tmp_path / "sample")], spark) == 0
    assert spark.read.json(str(tmp_path / "sample" / "sample")).count() == 3
    assert cli.main(["calibrate", path], spark) == 2
    assert cli.main(["calibrate", path, "--run-code", "--thresholds", "0.5"], spark) == 0
    assert cli.main(["catalogue", "--out", str(tmp_path / "c")], spark) == 2
    raw, reviews = tmp_path / "raw", tmp_path / "reviews"
    raw.mkdir(), reviews.mkdir()
    code = [{"id": str(k), "repo": f"r{k % 5}", "commit_hash": "c", "smell_type": "R2", "before_code": "x = 1", "after_code": "x = 2"} for k in range(10)]
    (raw / "long_param_list.jsonl").write_text("".join(json.dumps(r) + "\n" for r in code))
    with pytest.raises(FileNotFoundError, match="verdicts"):
        cli.main(["curate", str(raw), str(reviews), "--out", str(tmp_path / "split")], spark)
    assert cli.main(["curate", str(raw), str(reviews), "--out", str(tmp_path / "split"), "--allow-unreviewed"], spark) == 0
    assert spark.read.parquet(str(tmp_path / "split")).count() == 10


def test_behaviour_of_code_that_does_not_stop():
    from codequarry.functions.behaviour import compared

    assert compared("def f():\n    return open('/tmp/x', 'w')", "def f():\n    return 1")["equivalent"] is False
    assert compared("x = 1", "def f(): pass")["error"]
    found = compared("def f(a):\n    while True:\n        pass", "def f(a):\n    return a", 1, 0.2)
    assert (found["equivalent"], found["one_raised"]) == (False, 1)


def test_the_entry_works_without_the_optional_part(tmp_path):
    script = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; import json; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"
    out = subprocess.run([sys.executable, "-c", script], cwd=ROOT, capture_output=True, text=True, timeout=120)
    queries, sql = json.loads(out.stdout.strip().splitlines()[-1])
    assert "scan_counts" in queries and not any(q.startswith("op") for q in queries) and set(sql) <= set(queries)


def small_rows(spark, ids, smell="R1", value="a"):
    return spark.createDataFrame([(str(i), smell, value, f"code {i}") for i in ids], "id string, smell_type string, source string, code string")


def written(folder) -> dict[str, int]:
    """Rows of each run's folder."""
    return {p.name: sum(pq.ParquetFile(f).metadata.num_rows for f in p.rglob("*.parquet")) for p in folder.glob("run-*")}


def test_a_merge_writes_its_own_rows_alone(spark, tmp_path):
    table = sinks.PairTable(spark, str(tmp_path / "pairs"))
    table.merge(small_rows(spark, range(500)).unionByName(small_rows(spark, range(500), "R2")))
    first = written(tmp_path / "pairs")
    assert table.merge(small_rows(spark, [3, 600], value="b")) == {"R1": 2}
    assert sorted(written(tmp_path / "pairs").values()) == [2, 1000] and written(tmp_path / "pairs").items() > first.items()
    rows = {(r.smell_type, r.id): r.source for r in table.read().collect()}
    assert len(rows) == 1001 and rows["R1", "3"] == rows["R1", "600"] == "b" and rows["R2", "3"] == "a"
    plan = table.read(["R2"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    assert table.merge(small_rows(spark, [])) == {} and len(table._numbers()) == 2


def test_readers_compare_keys_not_rows(spark, tmp_path):
    """What is shuffled or sent to find the newest rows has keys alone; rows of the first folder are only filtered."""
    table = sinks.PairTable(spark, str(tmp_path / "pairs"))
    table.merge(small_rows(spark, range(300)))
    for k in range(3):
        table.merge(small_rows(spark, range(k, 300, 100), value=str(k)))
    plan = table.read()._jdf.queryExecution().executedPlan().toString()
    exchanged = [line for line in plan.split("\n") if "Exchange" in line]
    assert exchanged and not any("code" in line for line in exchanged)


@pytest.mark.parametrize("most", [2, 3, 8])
def test_many_merges_are_the_last_rows(spark, tmp_path, most):
    table, want, draw = sinks.PairTable(spark, str(tmp_path / "pairs"), most_folders=most), {}, random.Random(most)
    for run in range(7):
        ids = draw.sample(range(40), 40 if run == 0 else 6)
        smell = "R1" if run % 3 else "R2"
        table.merge(small_rows(spark, ids, smell, str(run)))
        want |= {(smell, str(i)): str(run) for i in ids}
        assert {(r.smell_type, r.id): r.source for r in table.read().collect()} == want and table.read().count() == len(want)
        assert all(len(f) <= most for f in table.folders().values())
        assert {s: sum(k[0] == s for k in want) for s in table.folders()} == {s: table.read([s]).count() for s in table.folders()}
    before = written(tmp_path / "pairs")
    table.compact()
    assert all(len(f) == 1 for f in table.folders().values()) and written(tmp_path / "pairs").items() >= before.items()
    assert table.vacuum() == 0
    table.vacuum(older_than_hours=0)
    named = {f for some in table.folders().values() for f, _ in some}
    assert set(written(tmp_path / "pairs")) == named and {(r.smell_type, r.id): r.source for r in table.read().collect()} == want


def test_later_folders_become_one_before_the_first_is_rewritten(spark, tmp_path):
    table = sinks.PairTable(spark, str(tmp_path / "pairs"), most_folders=3)
    table.merge(small_rows(spark, range(400)))
    base = table.folders()["R1"][0]
    for k in range(4):
        table.merge(small_rows(spark, [k, k + 1], value=f"v{k}"))
    assert table.folders()["R1"][0] == base and [n for _, n in table.folders()["R1"]][1] == 4
    table.merge(small_rows(spark, range(200), value="w"))
    table.merge(small_rows(spark, [1], value="x"))
    assert table.folders()["R1"][0] != base and [n for _, n in table.folders()["R1"]] == [400, 1]


def test_vacuum_keeps_what_earlier_pointers_name_and_columns_may_come_later(spark, tmp_path):
    table = sinks.PairTable(spark, str(tmp_path / "pairs"))
    table.merge(small_rows(spark, range(5)))
    old = table.folders()
    table.merge(small_rows(spark, range(2), value="b").withColumn("more", F.lit(1)))
    table.compact()
    assert table.vacuum(keep=3, older_than_hours=0) == 0 and table.vacuum(keep=2, older_than_hours=0) == 0
    assert table.vacuum(keep=1, older_than_hours=0) == 2 and table.folders() != old
    assert sorted((r.id, r.more) for r in table.read().collect()) == [("0", 1), ("1", 1), ("2", None), ("3", None), ("4", None)]
    lost = tmp_path / "pairs" / "run-lost"
    lost.mkdir()
    (lost / "part").write_text("x")
    assert table.vacuum() == 0 and table.vacuum(older_than_hours=0) == 1 and not lost.exists()


def test_caps_and_seen_files_hold_over_batches_and_restarts(spark, tmp_path):
    folder, table, options = str(tmp_path / "in"), sinks.PairTable(spark, str(tmp_path / "pairs")), mining.Options(caps={"R2": 3})
    batches = [["a", "b"], ["b", "c", "d", "e"], ["f", "a"]]
    numbers = {name: k for k, name in enumerate("abcdef")}
    counts = []
    for names in batches:
        rows = changes(spark, *((n, "refactor", f"{n}.py", f"{n}.py", MANY.format(n) + "\n    return 86400", ONE.format(n)) for n in names))
        numbered = rows.withColumn("seq", F.element_at(F.create_map(*[F.lit(x) for item in numbers.items() for x in item]), F.col("commit_hash")).cast("long"))
        # Another repository has caps of its own.
        numbered.unionByName(numbered.withColumn("repo", F.lit("other")).filter("commit_hash in ('d', 'f')")).write.mode("append").parquet(folder)
        incremental.follow_capped(spark, folder, table, options).awaitTermination()
        counts.append({(r.repo, r.smell_type): sorted(r.function_names) for r in table.read().groupBy("repo", "smell_type").agg(F.collect_list("function_name").alias("function_names")).collect()})
    assert [c["r", "R2"] for c in counts] == [["a", "b"], ["a", "b", "c"], ["a", "b", "c"]]
    assert [c.get(("other", "R2"), []) for c in counts] == [[], ["d"], ["d", "f"]]
    # A smell without a cap isn't limited; what the same files gave before isn't found again.
    assert counts[2]["r", "R5" if ("r", "R5") in counts[2] else "R3"] == list("abcdef")
    with pytest.raises(ValueError, match="follow"):
        incremental.follow_capped(spark, folder, table, mining.Options())


def test_seen_files_are_not_mined_again(spark, tmp_path):
    folder, options = str(tmp_path / "in"), mining.Options(caps={"R2": 9})
    mark, tables = str(tmp_path / "mark"), [sinks.PairTable(spark, str(tmp_path / name)) for name in ("one", "two")]
    row = changes(spark, ("a", "refactor", "a.py", "a.py", MANY.format("f"), ONE.format("f")))
    for table in tables:
        row.write.mode("append").parquet(folder)
        incremental.follow_capped(spark, folder, table, options, checkpoint=mark).awaitTermination()
    assert tables[0].read().count() == 1 and tables[1].read() is None


def test_code_of_a_stream_is_not_shuffled_where_all_smells_have_caps(spark, tmp_path):
    changes(spark, ("a", "refactor", "a.py", "a.py", MANY.format("f"), ONE.format("f"))).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(incremental.CHANGE).parquet(str(tmp_path / "in"))
    plan = lambda caps: incremental.capped_pairs(stream, mining.Options(caps=caps))._jdf.queryExecution().analyzed().toString()
    everything, some = plan(dict.fromkeys(mining.SMELLS, 2)), plan({"R2": 2})
    assert "Repartition" not in everything + some and "Deduplicate" not in everything and "Deduplicate" in some
    # What reaches the state has been thinned out by caps before, behind the kernel.
    assert everything.count("MapInArrow") == 2


@pytest.mark.parametrize("ids", [1, 1 << 17])
def test_pairs_behind_a_task_s_caps_are_left_out(monkeypatch, ids):
    import pyarrow as pa

    monkeypatch.setattr(incremental, "FIRST_IDS", ids)
    draw, caps = random.Random(6), {"R1": 3, "R2": 1, "R3": 0}
    rows = [(f"r{draw.randrange(3)}", draw.choice(list(caps)), str(draw.randrange(40)), draw.choice([None, *range(30)])) for _ in range(600)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("repo", "smell_type", "id", "seq"), r, strict=True)) for r in rows[k : k + 50]]) for k in range(0, 600, 50)]
    got = [tuple(r.values()) for b in incremental._may_be_first(caps, iter(batches)) for r in b.to_pylist()]
    place = lambda r: (r[3] is None, r[3] or 0, r[2])

    def first(of: list[tuple]) -> dict[tuple, list]:
        best: dict[tuple, tuple] = {}
        for r in sorted(of, key=place):
            best.setdefault(r[:3], place(r))
        return {(repo, s): sorted(p for k, p in best.items() if k[:2] == (repo, s))[: caps[s]] for repo in ("r0", "r1", "r2") for s in caps}

    assert first(got) == first(rows) and set(got) <= set(rows) and len(got) < len(rows) / (1 if ids == 1 else 2)


def test_a_batch_gives_the_first_pairs_whatever_their_order():
    from types import SimpleNamespace

    class Map(dict):
        containsKey, updateValue = dict.__contains__, dict.__setitem__  # noqa: N815

    state = SimpleNamespace(value=None)
    draw = random.Random(4)
    for cap in (1, 3, 10):
        capped, kept = incremental._Capped({"R1": cap}), Map()
        state.value = None
        capped._kept, capped._n = kept, SimpleNamespace(exists=lambda: state.value is not None, get=lambda: state.value, update=lambda v: setattr(state, "value", v))
        want = []
        for batch in range(4):
            rows = [SimpleNamespace(id=str(draw.randrange(30)), seq=100 * batch + draw.randrange(40)) for _ in range(60 if batch != 1 else 2)]
            got = [(r.id, r.seq) for r in capped.handleInputRows(("r", "R1"), iter(rows), None)]
            best: dict[str, int] = {}
            for r in rows:
                if r.id not in dict(want):
                    best[r.id] = min(r.seq, best.get(r.id, r.seq))
            now = sorted(best.items(), key=lambda x: (x[1], x[0]))[: cap - len(want)]
            assert got == now
            want += now
        assert len(want) == cap and set(kept) == {(i,) for i, _ in want}


def test_caps_and_budgets_called_from_sql(spark):
    registry.register(spark)
    draw = random.Random(2)
    pairs = spark.createDataFrame([(str(k), f"R{draw.randrange(1, 4)}", f"r{draw.randrange(6)}", draw.randrange(50), "code") for k in range(300)], "id string, smell_type string, repo string, seq long, code string")
    pairs.createOrReplaceTempView("some_pairs")
    capped = spark.sql("SELECT * FROM capped(TABLE(some_pairs), 4)")
    assert capped.schema == pairs.schema
    want = mining.capped(pairs.withColumn("file", F.lit("f")), {"R1": 4, "R2": 4, "R3": 4}).drop("file")
    assert sorted(map(tuple, capped.collect())) == sorted(map(tuple, want.select(*pairs.columns).collect()))
    per = pairs.groupBy("smell_type", "repo").agg(F.count("*").alias("available")).withColumn("place", F.col("repo"))
    per.createOrReplaceTempView("per_repo")
    got = spark.sql("SELECT * FROM budgets(TABLE(SELECT *, count(*) OVER (PARTITION BY smell_type) AS repos FROM per_repo), 40)")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, mining.budgets(per, 40).collect()))
    assert spark.sql("SELECT * FROM capped(TABLE(SELECT * FROM some_pairs WHERE false), 4)").count() == 0
    with pytest.raises(Exception, match="the table has no seq"):
        spark.sql("SELECT * FROM capped(TABLE(SELECT id, repo, smell_type FROM some_pairs), 4)").collect()


def test_the_gate_reads_stored_evidence(spark, tmp_path):
    rows = [(k, "R2", "def f(a):\n    b = a\n    return b", "def f(a):\n    c = a\n    return c", 1, True, before, after) for k, (before, after) in enumerate([
        ('{"parametros": 100}', '{"parametros": 99}'), ('{"n_params": 100}', '{"n_params": 50}'), ('{"parametros": "many"}', '{"parametros": 1}'), (None, None), ('{"other": 3}', "[1]"),
    ])]
    text = spark.createDataFrame(rows, "k int, smell_type string, before_code string, after_code string, n_functions_after int, partial boolean, b string, a string")
    trivial = lambda df: {r.k: any(i.rule == "trivial_reduction" for i in r.issues) for r in quality.checked(df).collect()}
    want = {0: True, 1: False, 2: False, 3: False, 4: False}
    sides = {"detector_before": "b", "detector_after": "a"}
    assert trivial(text.withColumns({n: F.struct(F.lit(True).alias("detected"), F.col(c).alias("evidence")) for n, c in sides.items()})) == want
    variant = text.withColumns({n: F.struct(F.lit(True).alias("detected"), F.parse_json(c).alias("evidence")) for n, c in sides.items()})
    variant.write.parquet(str(tmp_path / "pairs"))
    stored = spark.read.parquet(str(tmp_path / "pairs"))
    assert trivial(stored) == want
    # Without evidence the sizes of the row count, where it has them.
    assert trivial(stored.withColumns({"magnitude_before": F.lit(100), "magnitude_after": F.lit(99)})) == want | {2: False, 3: True, 4: True}


def test_mine_from_git_by_command_and_compact(spark, tmp_path, capsys):
    import shutil

    from tests.test_git import LINES, Repository

    if shutil.which("git") is None:
        pytest.skip("repositories are made with git")
    repo = Repository(tmp_path / "repos" / "one")
    for message, text in (("first", LINES["x"]), ("refactor", LINES["y"])):
        repo.write("b.py", text)
        repo.commit(message)
    repos, out = str(tmp_path / "repos"), str(tmp_path / "pairs")
    assert cli.main(["mine", repos, "--git", "--out", out], spark) == 0
    assert cli.main(["mine", repos, "--git", "--out", out], spark) == 0
    assert [(r.repo, r.smell_type, r.file) for r in sinks.PairTable(spark, out).read().collect()] == [("one", "R2", "b.py")]
    assert cli.main(["compact", out, "--vacuum-hours", "0"], spark) == 0 and "2 folders deleted" in capsys.readouterr().out
    assert sinks.PairTable(spark, out).read().count() == 1
    assert cli.main(["mine", repos, "--git", "--by-rule", "--cap", "3", "--out", out], spark) == 2 and "--cap" in capsys.readouterr().err


def test_orders_as_commits_meet_their_lines_without_the_driver_and_keywords_are_searched_once(spark, small):
    rows = mining.commits(corpus.modified_files(spark, small))
    plan = rows.select("seq", "before")._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin [o_orderkey" in plan and "BroadcastHashJoin [o_orderkey" not in plan and "lambdafunction" not in plan
    texts = spark.createDataFrame([("Clean  up",), ("CLEAN UP",), (None,), ("a magic numbers",), ("",)], "m string")
    assert [(r.a, r.b) for r in texts.select(columns.has_keyword("m").alias("a"), (F.size(columns.matched_keywords("m")) > 0).alias("b")).collect()] == [(x, x) for x in (False, True, False, True, False)]


def test_caps_end_the_reading_of_a_repository(spark, monkeypatch):
    """Repositories are read in parts, up to one that fills all caps; pairs are those of a whole search."""
    old, new = "def f(a, b, c, d, e, g):\n    return a + {}", "def f(a, o):\n    return a + {}"
    rows = [(f"r{k % 3}", f"c{k:03}", None, k, "refactor", None, False, "m.py", "m.py", old.format(k), new.format(k)) for k in range(30) if k % 3 or k > 25]
    changes = spark.createDataFrame(rows, "repo string, commit_hash string, parent_commit string, seq long, message string, committed_at timestamp, is_merge boolean, old_path string, new_path string, before string, after string")
    whole = stage(mining.mine(changes), "whole")
    looked_at = []
    seen = mining.candidates
    monkeypatch.setattr(mining, "candidates", lambda rows: looked_at.append(rows.count()) or seen(rows))
    monkeypatch.setattr(mining, "FIRST", 4)
    for caps, n in (({"R2": 3}, 4 + 4 + 1), ({"R2": 3, "R4": 0}, len(rows))):
        looked_at.clear()
        got = sorted(r.id for r in mining.mine(changes, mining.Options(caps=caps)).select("id").collect())
        assert got == sorted(r.id for r in mining.capped(whole, caps, all_smells=True).select("id").collect())
        assert sum(looked_at) == n


def test_searches_look_at_a_message_once(spark):
    rows = spark.createDataFrame([("PLR0913 by a\nDataclass",), ("plr0913",), (None,)], "message string")
    found = mining.searched(rows, ["PLR0913 dataclass", "R0913 x.y"])
    assert [r.message for r in found.collect()] == ["PLR0913 by a\nDataclass"]
    assert found._jdf.queryExecution().analyzed().toString().count("lower(") == 1
    assert mining.searched(rows, []).count() == 0 and mining.searched(rows, [""]).count() == 3


def test_only_the_fields_that_are_asked_for_leave_python(spark):
    files = spark.createDataFrame([("a.py", "def f(a):\n    x = 7\n    y = a * 8\n    return a\n"), ("b.py", "def f(:")], "path string, text string")
    some = detect.functions(files, only=detect.FOUND)
    assert set(some.columns) == {"path", *detect.FOUND}
    assert detect.findings(some).collect() == detect.findings(detect.functions(files)).collect() != []
    assert detect.parse_errors(detect.parsed(files, only=detect.FOUND)).count() == 1
    assert with_kernel(files, "n", len, "int", "text", without=("text",)).columns == ["path", "n"]
