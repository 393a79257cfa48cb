"""Commands that mine in part and again, and those of review, with what they do to their files."""

from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from codequarry import cli
from codequarry.functions.columns import SMELLS
from codequarry.operators import mining, review
from codequarry.sources import readers, sinks
from codequarry.streaming.incremental import CHANGE

MANY = "def {0}(a, b, c, d, e, f, g, h):\n    return a + b"
ONE = "def {0}(o):\n    return o.a + o.b"


def changed(spark, *rows):
    """Files of (repository, commit, message): in each a function loses its parameters."""
    full = [(r, c, None, k, datetime(2010 + k % 8, 1, 1 + k % 28), m, False, f"{k}.py", f"{k}.py", MANY.format(f"f{k}"), ONE.format(f"f{k}")) for k, (r, c, m) in enumerate(rows)]
    return spark.createDataFrame(full, CHANGE)


@pytest.mark.parametrize("wave", [1, 3, 100])
def test_waves_are_repositories_one_after_another(spark, tmp_path, wave):
    has = {"a": 4, "b": 0, "c": 1, "d": 9, "e": 2, "f": 7}
    rows = changed(spark, *((r, f"{r}{k}", "refactor" if has[r] else "nothing") for r in has for k in range(max(1, has[r]))))
    read = []
    table = sinks.PairTable(spark, str(tmp_path / "pairs"))
    caps = dict.fromkeys(SMELLS, 0) | {"R2": 9}

    def merge(pairs):
        read.append({r.repo for r in pairs.select("repo").distinct().collect()})
        return table.merge(pairs)

    *_, last = mining.in_waves(rows, merge, caps, wave=wave)
    left, total, expected = len(has), 0, {}
    for repo, n in has.items():
        took = min(n, max(0, -(-(9 - total) // left)))
        total, left, expected = total + took, left - 1, expected | ({repo: took} if took else {})
    got = {r.repo: [x.seq for x in sorted(r.rows)] for r in table.read().groupBy("repo").agg(F.collect_list(F.struct("seq")).alias("rows")).collect()}
    assert {r: len(s) for r, s in got.items()} == expected and last["R2"] == total
    assert all(s == list(range(s[0], s[0] + len(s))) for s in got.values()), "the first of each"
    assert len(read) == -(-6 // wave)


def test_waves_end_when_all_have_enough(spark):
    rows = changed(spark, *((r, r, "refactor") for r in "abcd"))
    merged = []
    totals = list(mining.in_waves(rows, merged.append, dict.fromkeys(SMELLS, 0) | {"R2": 1}, wave=1))
    assert [t["R2"] for t in totals] == [1] and len(merged) == 1
    assert not list(mining.in_waves(rows.limit(0), merged.append, dict.fromkeys(SMELLS, 5)))
    with pytest.raises(ValueError, match="cap"):
        next(mining.in_waves(rows, merged.append, {"R1": 1}))


def test_windows_of_first_years(spark):
    made = spark.createDataFrame([("a", "2003-05-06"), ("b", "2012-02-29T10:00:00Z"), ("c", "2015-01-01"), ("d", None), ("e", "soon")], "repo string, created_at string")
    assert sorted(tuple(r) for r in mining.first_years(made).collect()) == [("a", "2003-05-06", "2010-05-06"), ("b", "2012-02-29", "2014-12-31")]


def test_mining_in_part_and_again_by_command(spark, tmp_path, capsys):
    messages = ["PLR0913 extract", "plr2004 named constant, PLR0913 dataclass", "PLR2004 constant", "tidy"]
    rows = changed(spark, *((f"r{k % 3}", f"c{k}", messages[k % 4]) for k in range(12))).withColumn("author", F.lit("ann"))
    path, out = str(tmp_path / "changes"), str(tmp_path / "out")
    rows.write.parquet(path)
    for run, n in ((1, 4), (2, 7), (3, 9), (4, 9)):
        assert cli.main(["mine", path, "--out", f"{out}-rule", "--by-rule", "--max-commits", "2", "--seen", str(tmp_path / "seen")], spark) == 0
        assert sinks.PairTable(spark, f"{out}-rule").read().count() == n, run
    assert cli.main(["mine", path, "--out", out, "--by-rule", "--seen", "x"], spark) == 2
    assert cli.main(["mine", path, "--out", f"{out}-waves", "--waves", "2", "--total-cap", "4", "--no-require-keyword"], spark) == 0
    assert sinks.PairTable(spark, f"{out}-waves").read().groupBy("repo").count().count() == 3
    listed = tmp_path / "requests.jsonl"
    listed.write_text("".join(json.dumps({"repo": f"r{r}", "merge_commit_sha": f"c{c}"}) + "\n" for r, c in ((2, 2), (2, 2), (0, 0), (1, 0), (0, 3), (1, 4))))
    assert cli.main(["mine", path, "--out", f"{out}-pr", "--requests", str(listed), "--limit-repos", "2"], spark) == 0
    assert sorted((r.repo, r.commit_hash, r.source) for r in sinks.PairTable(spark, f"{out}-pr").read().collect()) == [("r0", "c0", "mined_pr"), ("r0", "c3", "mined_pr"), ("r2", "c2", "mined_pr")]
    assert cli.main(["mine", path, "--out", out, "--limit-repos", "2"], spark) == 2
    (tmp_path / "created.json").write_text('[{"repo": "r1", "created_at": "2009-06-01"}, {"repo": "r2", "created_at": "2016-01-01"}]')
    assert cli.main(["mine", path, "--out", f"{out}-first", "--created", str(tmp_path / "created.json"), "--first-years", "3", "--no-require-keyword"], spark) == 0
    assert {(r.repo, r.commit_hash) for r in sinks.PairTable(spark, f"{out}-first").read().collect()} == {("r1", "c1"), ("r1", "c10")}
    capsys.readouterr()


def test_pilot_by_command(spark, tmp_path, capsys):
    path, out, pulls, answers = str(tmp_path / "changes"), str(tmp_path / "out"), tmp_path / "pulls.jsonl", tmp_path / "answers.jsonl"
    changed(spark, *(("r", f"c{k}", "tidy") for k in range(5))).write.parquet(path)
    rows = [{"repo": "r", "pr_number": k, "merge_commit_sha": f"c{k}", "merged_at": f"2020-01-0{k + 1}", "label": "code-quality" if k else "bug", "changed_files": 9 if k == 2 else 1} for k in range(5)]
    pulls.write_text("".join(json.dumps(r) + "\n" for r in rows))
    assert cli.main(["pilot", str(pulls), path, "--out", out, "--max-prs", "2"], spark) == 0
    found = {r.commit_hash: r.id for r in sinks.PairTable(spark, out).read().collect()}
    assert set(found) == {"c3", "c4"} and "2 requests" in capsys.readouterr().out
    answers.write_text("".join(json.dumps({"id": i, "response": "REAL" if c == "c3" else "no"}) + "\n" for c, i in found.items()) + json.dumps({"id": "other", "response": "REAL"}) + "\n")
    assert cli.main(["pilot", str(pulls), path, "--out", out, "--max-prs", "2", "--answers", str(answers)], spark) == 0
    assert "TOTAL: 1 of 2 real (50 %)" in capsys.readouterr().out


def test_curator_and_verdicts_by_command(spark, tmp_path, capsys):
    raw, reviews = tmp_path / "raw", tmp_path / "reviews"
    raw.mkdir(), reviews.mkdir()
    for smell, code in (("dead_code", "R5"), ("long_method", "R1")):
        lines = [json.dumps({"id": f"{code}-{k}", "repo": f"r{k}", "commit_hash": "c", "smell_type": code, "before_code": "x = 1", "after_code": "x = 2"}) for k in range(6)]
        (raw / f"{smell}.jsonl").write_text("\n".join([*lines, "{broken", ""]))

    def run(*arguments):
        code = cli.main([*arguments[:1], *([str(raw)] if arguments[0] == "curator" else []), str(reviews), *arguments[1:]], spark)
        said = capsys.readouterr().out.splitlines()
        return (code, said[0] if said else "", [json.loads(x)["id"] for x in said[1:]])

    assert run("curator", "--reviewer", "ann", "--limit", "7") == (0, "12 pairs: 0 reviewed, 12 pending", [f"R5-{k}" for k in range(6)] + ["R1-0"])
    assert run("verdict", "dead_code", "R5-1", "noisy", "--reviewer", "ann")[0] == 2, "a reason is required"
    assert not (reviews / "dead_code.reviews.jsonl").exists()
    assert run("verdict", "dead_code", "R5-1", "noisy", "--reviewer", "ann", "--reason", "too much")[:2] == (0, "1 verdicts on dead_code")
    assert run("verdict", "dead_code", "R5-1", "clean", "--reviewer", "bob")[1] == "2 verdicts on dead_code"
    assert run("verdict", "dead_code", "R5-2", "clean", "--reviewer", "ann")[1] == "3 verdicts on dead_code"
    assert run("verdict", "dead_code", "R5-1", "clean", "--reviewer", "ann")[1] == "3 verdicts on dead_code", "in place of the first"
    assert {(r.id, r.reviewer): r.status for r in readers.sidecar(spark, str(reviews / "dead_code.reviews.jsonl")).collect()}["R5-1", "ann"] == "clean"
    assert [p.name for p in reviews.iterdir()] == ["dead_code.reviews.jsonl"]
    assert run("curator", "--reviewer", "ann", "--status", "reviewed") == (0, "12 pairs: 2 reviewed, 10 pending", ["R5-1", "R5-2"])
    assert run("curator", "--reviewer", "ann", "--smell", "dead_code", "--status", "pending") == (0, "6 pairs: 2 reviewed, 4 pending", ["R5-0", "R5-3", "R5-4", "R5-5"])
    pair = [{"id": f"R5-{k}", "smell": "R5"} for k in range(3)]
    (reviews / "assignment.json").write_text(json.dumps({"seed": 42, "revisores": ["ann", "bob", "cid"], "blocos": [{"id": "B1", "revisores": ["ann", "bob"], "adjudicator": "cid", "pares": pair}]}))
    assert run("curator", "--reviewer", "ann")[1] == "3 pairs: 2 reviewed, 1 pending"
    assert run("curator", "--reviewer", "cid", "--adjudicate")[1] == "0 pairs: 0 reviewed, 0 pending"
    assert run("verdict", "dead_code", "R5-2", "rejected", "--reviewer", "bob", "--reason", "worse")[0] == 0
    assert run("curator", "--reviewer", "cid", "--adjudicate") == (0, "1 pairs: 0 reviewed, 1 pending", ["R5-2"])
    assert run("curator", "--reviewer", "cid", "--no-assignment")[1] == "12 pairs: 0 reviewed, 12 pending"


def test_kept_pairs_beside_those_of_the_files(spark, tmp_path, capsys):
    raw, reviews = tmp_path / "raw", tmp_path / "reviews"
    raw.mkdir(), reviews.mkdir()
    rows = [{"id": str(k), "repo": f"r{k % 5}", "commit_hash": "c", "smell_type": "R2", "before_code": "x = 1", "after_code": "x = 2"} for k in range(12)]
    (raw / "long_param_list.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    (reviews / "long_param_list.reviews.jsonl").write_text("".join(json.dumps({"id": str(k), "reviewer": "a", "status": "clean", "timestamp": "1"}) + "\n" for k in range(10)))
    assert cli.main(["curate", str(raw), str(reviews), "--out", str(tmp_path / "split")], spark) == 0
    said = capsys.readouterr().out
    assert "long_param_list: 12 pairs in the file" in said and "kept: {'R2': 10}" in said


def test_errors_name_the_line_of_a_side(spark):
    rows = [("r", "c", "R1", "x = 1\ny = (", "x = 1"), ("r", "c", "R1", "x = 1", "\x00")]
    pairs = spark.createDataFrame(rows, "repo string, commit_hash string, smell_type string, before_code string, after_code string").withColumn("source", F.lit(None).cast("string"))
    found = [r.errors for r in review.schema_errors(pairs).orderBy("after_code").collect()]
    assert ["before_code doesn't parse at line 2"] in found
    assert any(len(e) == 1 and e[0].startswith("after_code doesn't parse") for e in found)
