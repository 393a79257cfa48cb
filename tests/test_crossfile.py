"""The join of moved functions: no pair is lost, and few are compared."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codequarry.functions import kernels
from codequarry.operators import crossfile, detect
from codequarry.streaming import incremental

STATEMENTS = [
    "x{0} = a + b", "call(a, x)", "y = [a, b.c]", "assert a", "del b", "z = h(x)(y)", "q = {{a: b}}", "k = (a, b)", "w = a if b else c", "s = f'{{a}}'", "raise a", "import m{0}", "global g{0}",
    "v = lambda u: u", "t = [i for i in a]", "e = not a", "o = -a", "n = a < b", "p = a and b", "r = a[1:2]",
]


def function(name: str, draw: random.Random, n: int) -> str:
    """A function of ``n`` statements of a few forms; the forms differ from function to function."""
    forms = draw.sample(STATEMENTS, 4)
    return f"def {name}(a, b, c):\n" + "".join("    " + draw.choice(forms).format(k) + "\n" for k in range(n))


def commit(spark, old: list[str], new: list[str], name: str = "c"):
    rows = [("r", name, None, 0, None, "move", False, f"old{k}.py", None, text, None) for k, text in enumerate(old)]
    rows += [("r", name, None, 0, None, "move", False, None, f"new{k}.py", None, text) for k, text in enumerate(new)]
    changes = spark.createDataFrame(rows, incremental.CHANGE)
    return changes.withColumns({"file": F.coalesce("new_path", "old_path"), "msg_keywords": F.array().cast("array<string>")})


@pytest.mark.parametrize("similarity", [0.0, 0.7, 0.9])
def test_no_pair_is_lost(spark, similarity):
    draw = random.Random(7)
    old = [function(f"f{k}", draw, draw.randrange(1, 9)) for k in range(16)]
    new = [text.replace("(a, b, c)", "(a, b)").replace(" = a", " = bb(a)", k % 3).replace("def f", "def g") for k, text in enumerate(old[:10])] + [function(f"h{k}", draw, draw.randrange(1, 9)) for k in range(6)]
    gone, fresh = crossfile.gone_and_fresh(commit(spark, ["\n\n".join(old[:8]), "\n\n".join(old[8:])], ["\n\n".join(new)]))
    found = {(r.old.name, r.new.name): r.similarity for r in crossfile.candidate_pairs(gone, fresh, similarity=similarity).select("old", "new", "similarity").collect()}
    shapes = {t.split("(")[0][4:]: kernels.measure(t)["shape"] for t in old + new}

    def apart(a: dict, b: dict) -> float:
        return sum(abs(a[k] - b[k]) / max(a[k], b[k], 1) for k in ("n_stmts", "n_params", "depth", "n_returns")) / 4

    want = {}
    for one in old:
        for two in new:
            names = one.split("(")[0][4:], two.split("(")[0][4:]
            alike = kernels.tree_similarity(one, two)
            sizes = sorted(kernels.kinds_of(x).total() for x in (one, two))
            if alike >= similarity and apart(shapes[names[0]], shapes[names[1]]) <= 0.5 and sizes[0] / sizes[1] >= similarity:
                want[names] = alike
    assert found == want and want


@pytest.mark.parametrize("few", [0, 20, 1024])
def test_small_commits_need_no_rare_nodes(spark, monkeypatch, few):
    """Commits of any size, by either way, give the same pairs; rare nodes, a row each, are for large ones only."""
    draw, looked = random.Random(5), []
    texts = [function(f"f{k}", draw, draw.randrange(2, 7)) for k in range(7)]
    moved = [text.replace("def f", "def g").replace(" = a", " = bb(a)", k % 2) for k, text in enumerate(texts)]
    rows = commit(spark, texts, ["\n\n".join(moved)], "seven").unionByName(commit(spark, texts[:2], moved[:2], "two")).unionByName(commit(spark, texts[:1], [], "one"))
    whole = crossfile.rarity
    monkeypatch.setattr(crossfile, "rarity", lambda kinds: looked.append({r.commit_hash for r in kinds.select("commit_hash").distinct().collect()}) or whole(kinds))
    monkeypatch.setattr(crossfile, "FEW", few)
    gone, fresh = crossfile.gone_and_fresh(rows)
    pairs = crossfile.candidate_pairs(gone, fresh, similarity=0.6).select("commit_hash", "old.name", "new.name", "similarity").collect()
    want = {(c, a.split("(")[0][4:], b.split("(")[0][4:]) for c, n in (("seven", 7), ("two", 2)) for a in texts[:n] for b in moved[:n] if kernels.tree_similarity(a, b) >= 0.6}
    assert {tuple(p)[:3] for p in pairs} <= want and len(pairs) == len({tuple(p)[:3] for p in pairs}) and {(c, f"f{k}", f"g{k}") for c, n in (("seven", 7), ("two", 2)) for k in range(n)} <= {tuple(p)[:3] for p in pairs}
    assert looked == {0: [{"seven", "two"}], 20: [{"seven"}], 1024: []}[few]


def test_code_is_shuffled_once_a_side_for_its_similarity(spark):
    rows = commit(spark, ["def f(a):\n    return a"], ["def g(a):\n    return a"])
    gone, fresh = crossfile.gone_and_fresh(rows)
    plan = crossfile.scored(crossfile.near_pairs(gone, fresh), gone, fresh, 0.7)._jdf.queryExecution().optimizedPlan().toString()
    # The rows that reach the kernel are those of the join: no other shuffle is between.
    kernel = plan.index("MapInArrow")
    assert "Join" in plan[kernel : plan.index("Repartition", kernel)]


def test_five_thousand_functions_of_one_size(spark):
    """One commit moves 2,500 functions, all of eight statements; all pairs whose kinds of nodes allow it are kept, and they are a small part of all."""
    draw, n = random.Random(11), 2500
    old = [function(f"f{k}", draw, 8) for k in range(n)]
    new = [text.replace("def f", "def g", 1) for text in old]
    draw.shuffle(new)
    files = lambda texts: ["\n\n".join(texts[k : k + 250]) for k in range(0, n, 250)]
    gone, fresh = crossfile.gone_and_fresh(commit(spark, files(old), files(new)))
    near = crossfile.near_pairs(gone, fresh, shape=9.0, similarity=0.95).collect()
    uids = [{r.name: r.uid for r in side.select("uid", F.col("f.name").alias("name")).collect()} for side in (gone, fresh)]
    found = {(r.old_uid, r.new_uid) for r in near}
    assert len(found) == len(near)
    kinds = sorted({k for t in old for k in kernels.kinds_of(t)})
    counts = [np.array([[c[k] for k in kinds] for c in map(kernels.kinds_of, texts)], np.int32) for texts in (old, new)]
    names = [[t.split("(")[0][4:] for t in texts] for texts in (old, new)]
    want = set()
    for k in range(n):
        shared, sizes = np.minimum(counts[0][k], counts[1]).sum(1), np.maximum(counts[0][k].sum(), counts[1].sum(1))
        smaller = np.minimum(counts[0][k].sum(), counts[1].sum(1))
        for j in np.flatnonzero((shared >= 0.95 * sizes - 1e-9) & (smaller >= 0.95 * sizes)):
            want.add((uids[0][names[0][k]], uids[1][names[1][j]]))
    assert found == want and n <= len(found) < n * n / 50


def test_functions_that_stay_are_not_measured(monkeypatch):
    seen = []
    whole = kernels.measure
    monkeypatch.setattr(kernels, "measure", lambda x: seen.append(x) or whole(x))
    text = "def f(a):\n    return 1\n\ndef g(a):\n    return a\n"
    sides = crossfile._side(text, text.replace("def g", "def h"), "a.py", "a.py")
    assert [f["name"] for f in sides["before"]] == ["g"] and [f["name"] for f in sides["after"]] == ["h"] and len(seen) == 2
    assert len(crossfile._side(text, text, "a.py", "b.py")["after"]) == 2


def test_code_is_not_sent_to_every_task(spark):
    text = "def {}(a):\n" + "    a = a + 1\n" * 20 + "    return a\n"
    rows = [("r", str(k), None, k, "move", ["move"], *paths, *sides) for k in range(20) for paths, sides in ((("old.py", None, "old.py"), (text.format("f"), None)), ((None, "new.py", "new.py"), (None, text.format("g"))))]
    schema = "repo string, commit_hash string, parent_commit string, seq long, message string, msg_keywords array<string>, old_path string, new_path string, file string, before string, after string"
    found = crossfile.moved_functions(spark.createDataFrame(rows, schema))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan
    assert sorted((r.seq, r.old.qualname, r.new.qualname) for r in found.collect()) == [(k, "g", "g") for k in range(20)]


def test_a_wide_scan_is_not_shuffled_before_a_kernel(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    files = spark.range(40 * cores).selectExpr("concat(id, '.py') as path", "concat('def f', id, '(a):\n    return 5') as text")
    files.repartition(3 * cores).write.parquet(str(tmp_path / "files"))
    try:
        # Opening a file counts as much as a partition may hold, so each file is one.
        spark.conf.set("spark.sql.files.openCostInBytes", "128m")
        found = detect.functions(spark.read.parquet(str(tmp_path / "files")))
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        assert found.rdd.getNumPartitions() >= 2 * cores and found.count() == 40 * cores
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
