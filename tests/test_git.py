"""The git source against git itself, on repositories made here, and against the same commits as a snapshot table."""

from __future__ import annotations

import hashlib
import os
import random
import shutil
import subprocess
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from codequarry.operators import mining
from codequarry.plans import git_corpus
from codequarry.sources import git as source

pytestmark = pytest.mark.skipif(shutil.which("git") is None, reason="repositories are made with git")
LONG = "def f({}):\n" + "".join(f"    total = total + {k}\n" for k in range(12)) + "    return total\n"
LINES = {"x": "def g(a, b, c, d, e, f, g):\n    return a\n", "y": "def g(a):\n    return a\n"}


class Repository:
    def __init__(self, path):
        self.path, self.clock = str(path), 1_600_000_000
        os.makedirs(self.path)
        self("init", "-q", "-b", "main")

    def __call__(self, *args: str) -> str:
        who = {f"GIT_{a}_{b}": c for a in ("AUTHOR", "COMMITTER") for b, c in (("NAME", "Some One"), ("EMAIL", "a@b"), ("DATE", f"{self.clock} +0200"))}
        return subprocess.run(["git", "-C", self.path, *args], env=os.environ | who | {"GIT_CONFIG_GLOBAL": os.devnull, "GIT_CONFIG_NOSYSTEM": "1"}, check=True, capture_output=True).stdout.decode(errors="ignore")

    def write(self, path: str, text: str) -> None:
        os.makedirs(os.path.dirname(f"{self.path}/{path}"), exist_ok=True)
        with open(f"{self.path}/{path}", "w", newline="") as file:
            file.write(text)

    def commit(self, message: str) -> None:
        self.clock += 3600
        self("add", "-A")
        self("commit", "-qm", message, "--allow-empty")


def history(repo: Repository) -> None:
    """Files that come, change, move, move and change, go; folders, other files, links, a merge, a tag, an empty commit."""
    draw = random.Random(3)
    for k in range(12):
        repo.write(f"pkg/s{k % 3}/m{k}.py", "".join(f"x{j} = {draw.randrange(10**6)}\n" for j in range(40)))
        repo.write("notes.txt", str(k))
        repo.commit(f"commit {k}\n\nwith more")
    repo.write("pkg/big.py", "".join(f"line_{j} = {j}\n" for j in range(6000)))
    repo.commit("a long file")
    for k in range(8):
        with open(f"{repo.path}/pkg/big.py", "a") as file:
            file.write(f"more = {k}\n")
        repo.commit("Refactor the long file")
    repo("mv", "pkg/s0/m0.py", "pkg/moved.py")
    repo.commit("move")
    repo("mv", "pkg/s1/m1.py", "other/m1.py") if os.path.isdir(f"{repo.path}/other") else (os.makedirs(f"{repo.path}/other"), repo("mv", "pkg/s1/m1.py", "other/m1.py"))
    with open(f"{repo.path}/other/m1.py", "a") as file:
        file.write("changed = 1\n")
    repo.commit("move and change")
    os.remove(f"{repo.path}/pkg/s2/m2.py")
    repo.write("pkg/s2/unlike.py", "nothing = 'alike'\n" * 60)
    os.symlink("big.py", f"{repo.path}/pkg/link.py")
    repo.commit("go and come")
    repo("checkout", "-qb", "side")
    repo.write("pkg/side.py", "s = 1\n")
    repo.commit("on the side")
    repo("checkout", "-q", "main")
    repo.write("pkg/side2.py", "s = 2\n")
    repo.commit("meanwhile")
    repo.clock += 3600
    repo("merge", "-q", "--no-ff", "-m", "Merge the side", "side")
    repo("tag", "-a", "v1", "-m", "first")
    repo.commit("empty")
    repo.write("café/näme.py", "a = 'é'\r\nb = 1\r\n")
    repo.commit("names of other letters")


def expected(repo: Repository) -> set[tuple]:
    """What git says of each commit: paths of changed files against its first parent, and their contents."""
    out = set()
    for line in repo("log", "--format=%H %P|%ct", "--first-parent", "-m", "HEAD").split("\n") + repo("log", "--format=%H %P|%ct", "HEAD").split("\n"):
        if not line:
            continue
        head, time = line.split("|")
        name, *parents = head.split()
        args = [parents[0], name] if parents else ["--root", name]
        fields = repo("diff-tree", "-r", "-M50%", "-z", "--no-commit-id", "--name-status", *args).split("\0")[:-1]
        k = 0
        while k < len(fields):
            kind = fields[k][0]
            old, new = (fields[k + 1], fields[k + 2]) if kind == "R" else (None if kind == "A" else fields[k + 1], None if kind == "D" else fields[k + 1])
            k += 3 if kind == "R" else 2
            if (new or old).endswith(".py") and (new or old) != "pkg/link.py":
                before = repo("show", f"{parents[0]}:{old}") if old else None
                out.add((name, parents[0] if parents else None, int(time), len(parents) > 1, old, new, before, repo("show", f"{name}:{new}") if new else None))
    return out


def found(rows) -> set[tuple]:
    return {(r.commit_hash, r.parent_commit, int(r.committed_at.replace(tzinfo=timezone.utc).timestamp()), r.is_merge, r.old_path, r.new_path, r.before, r.after) for r in rows}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """One history as loose objects, in packs with both kinds of deltas, partly packed and borrowed, and bare."""
    top = tmp_path_factory.mktemp("repositories")
    loose = Repository(top / "loose")
    history(loose)
    for name, args in (("packed", ["repack", "-adfq", "--depth=50"]), ("by_name", ["-c", "repack.useDeltaBaseOffset=false", "repack", "-adfq"])):
        shutil.copytree(loose.path, top / name, symlinks=True)
        copy = Repository.__new__(Repository)
        copy.path, copy.clock = str(top / name), loose.clock
        copy(*args)
        copy("pack-refs", "--all")
    subprocess.run(["git", "clone", "-q", "--bare", "--shared", str(top / "packed"), str(top / "group" / "borrowed.git")], check=True)
    return top, loose


def utc(spark, rows):
    return rows.withColumn("committed_at", F.to_utc_timestamp("committed_at", spark.conf.get("spark.sql.session.timeZone"))).collect()


def test_changes_are_git_s(spark, folder):
    top, loose = folder
    want = expected(loose)
    rows = source.changes(spark, str(top)).collect()
    assert {r.repo for r in rows} == {"loose", "packed", "by_name", "group/borrowed"}
    for repo in {r.repo for r in rows}:
        mine = [r for r in rows if r.repo == repo]
        assert {(x[0], x[4], x[5]) for x in found(mine)} == {(x[0], x[4], x[5]) for x in want}
        assert {(x[0], x[1], x[3], x[6], x[7]) for x in found(mine)} == {(x[0], x[1], x[3], x[6], x[7]) for x in want}
        assert len(mine) == len(want)
        order = {r.commit_hash: r.seq for r in mine}
        assert all(order[r.parent_commit] < r.seq for r in mine if r.parent_commit in order)
    assert {r.author for r in rows} == {"Some One"}


def test_slices_have_all_commits_once(spark, folder):
    top, _ = folder
    whole = source.changes(spark, str(top / "packed"))
    parts = source.changes(spark, str(top / "packed"), sliceBytes=2000)
    assert parts.rdd.getNumPartitions() > 3 == 3 * whole.rdd.getNumPartitions()
    assert sorted(map(tuple, parts.collect()), key=repr) == sorted(map(tuple, whole.collect()), key=repr)


def test_filters_reach_the_source(spark, folder, monkeypatch):
    top, loose = folder
    rows = source.changes(spark, str(top))
    times = sorted(r.committed_at for r in rows.collect())
    middle = times[len(times) // 2]
    tests = [
        F.col("committed_at") >= F.lit(middle), (F.col("committed_at") < F.lit(middle)) & ~F.col("is_merge"), F.col("repo") == "packed",
        F.col("repo").isin("packed", "loose") & (F.col("commit_hash") == loose("rev-parse", "HEAD~3").strip()), F.col("is_merge"),
    ]
    everything = rows.collect()
    for test in tests:
        kept = rows.filter(test)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "Filter" not in plan.replace("RuntimeFilters", ""), plan
        local = spark.createDataFrame(everything, rows.schema).filter(test).collect()
        assert sorted(map(tuple, kept.collect()), key=repr) == sorted(map(tuple, local), key=repr) and local
    reader = source.GitReader({"path": str(top)})
    assert not list(reader.pushFilters([source.EqualTo(("repo",), "packed")])) and {p.repo for p in reader.partitions()} == {"packed"}
    late = source.GreaterThanOrEqual(("committed_at",), datetime(2100, 1, 1, tzinfo=timezone.utc))
    odd = source.EqualTo(("message",), "x")
    assert list(reader.pushFilters([late, odd])) == [odd]
    monkeypatch.setattr(source.Store, "changed", lambda *_: pytest.fail("a commit outside the time was compared"))
    assert [r for p in reader.partitions() for r in reader.read(p)] == []


def test_other_refs_and_odd_folders(spark, folder, tmp_path):
    top, loose = folder
    loose("branch", "-f", "gone-on", "side")
    heads = {r.commit_hash for r in source.changes(spark, str(top / "loose"), ref="refs/tags/v1").collect()}
    assert heads == {r.commit_hash for r in source.changes(spark, str(top / "loose")).collect()} - {loose("rev-parse", "HEAD").strip()}
    assert source.changes(spark, str(top / "loose"), ref="refs/heads/none").count() == 0
    Repository(tmp_path / "empty")
    assert source.changes(spark, str(tmp_path)).count() == 0
    os.makedirs(tmp_path / "nothing" / "here")
    assert source.changes(spark, str(tmp_path / "nothing")).count() == 0
    subprocess.run(["git", "clone", "-q", "--depth", "3", f"file://{top}/packed", str(tmp_path / "shallow")], check=True)
    assert {r.parent_commit is None for r in source.changes(spark, str(tmp_path / "shallow"), ref="all").collect()} >= {False}


@pytest.fixture(scope="module")
def refactorings(tmp_path_factory):
    """What the snapshot tests have: caps, keywords, merges, renamed files, helpers that are taken out."""
    top = tmp_path_factory.mktemp("mined")
    for name in ("one", "two"):
        repo = Repository(top / name)
        repo.write("a.py", "\n\n".join(f"def f{k}(a, b, c, d, e, f, g, h):\n    return a + {k}" for k in range(6)) + "\n")
        repo.write("b.py", LINES["x"])
        repo.write("long.py", "def work(total):\n" + "".join(f"    total = total * {k} + total\n" for k in range(2, 40)) + "    return total\n")
        repo.commit("first")
        repo.write("a.py", "\n\n".join(f"def f{k}(options):\n    return options.a + {k}" for k in range(6)) + "\n")
        repo.commit("Refactor: introduce parameter object")
        repo.write("b.py", LINES["y"])
        repo.commit("fewer of them")
        repo("mv", "long.py", "short.py")
        body = "".join(f"    total = total * {k} + total\n" for k in range(2, 21))
        rest = "".join(f"    total = total * {k} + total\n" for k in range(21, 40))
        repo.write("short.py", f"def work(total):\n{body}    return rest(total)\n\n\ndef rest(total):\n{rest}    return total\n")
        repo.commit("extract method")
    return top


@pytest.mark.parametrize(("options", "n"), [(mining.Options(), {"R2": 12, "R3": 0, "R1": 2}), (mining.Options(require_keyword=False), {"R2": 14, "R1": 2}), (mining.Options(caps={"R2": 3, "R1": 1}), {"R2": 6, "R1": 2})])
def test_git_is_mined_like_its_snapshot(spark, refactorings, tmp_path, options, n):
    changes = source.changes(spark, str(refactorings))
    changes.write.parquet(str(tmp_path / "snapshot"))
    snapshot = spark.read.parquet(str(tmp_path / "snapshot"))
    pairs = mining.mine(changes, options).collect()
    assert sorted(map(tuple, pairs), key=repr) == sorted(map(tuple, mining.mine(snapshot, options).collect()), key=repr)
    assert {smell: sum(p.smell_type == smell for p in pairs) for smell in n} == n
    assert {p.file for p in pairs if p.smell_type == "R1"} == {"short.py"}


@pytest.mark.parametrize("case", [(b"", b"x" * 300), (b"a" * 70_000 + b"1" + b"b" * 9, b"a" * 70_000 + b"22" + b"b" * 9), (b"abc", b"abc"), (b"abcd", b""), (b"aaa", b"aaaaa")])
def test_deltas_are_what_the_source_reads(case):
    assert source._patched(case[0], git_corpus.delta(*case)) == case[1]


def test_trees_that_differ_little_are_written_as_deltas(tmp_path):
    pack, names = git_corpus._Pack(str(tmp_path / "r.git")), []
    trees = [b"".join(b"100644 m_%d.py\0" % k + hashlib.sha1(b"%d" % (k if k != n % 40 else n)).digest() for k in range(40)) for n in range(200)]
    names = [pack.add("tree", tree, series="pkg") for tree in trees]
    pack.close("refs/heads/main", names[-1])
    (packed,) = (tmp_path / "r.git/objects/pack").glob("*.pack")
    assert packed.stat().st_size < sum(map(len, trees)) / 8
    shown = subprocess.run(["git", "--git-dir", str(tmp_path / "r.git"), "verify-pack", "-v", str(packed)], capture_output=True, text=True, check=True).stdout
    assert {n.hex() for n in names} <= set(shown.split())


def test_commits_without_a_phrase_are_not_compared(spark, refactorings, monkeypatch):
    phrases = "EXTRACT method\nparameter object"
    want = {(r.repo, r.commit_hash) for r in source.changes(spark, str(refactorings)).collect() if "extract method" in r.message or "parameter object" in r.message}
    assert {(r.repo, r.commit_hash) for r in source.changes(spark, str(refactorings), phrases=phrases).collect()} == want and len(want) == 4
    monkeypatch.setattr(source.Store, "changed", lambda *_: pytest.fail("a commit without the phrase was compared"))
    reader = source.GitReader({"path": str(refactorings), "phrases": "no such phrase"})
    assert [r for p in reader.partitions() for r in reader.read(p)] == []


def test_a_name_is_found_without_a_search_of_the_index(tmp_path, monkeypatch):
    pack = git_corpus._Pack(str(tmp_path / "r.git"))
    names = [pack.add("blob", b"%d" % k) for k in range(3000)]
    places = {n: at for n, (at, *_) in pack.places.items()}
    pack.close("refs/heads/main", names[0])
    (index,) = (tmp_path / "r.git/objects/pack").glob("*.idx")
    read, searched = source.Pack(str(index)), []
    monkeypatch.setattr(source.Pack, "name", lambda self, k: searched.append(k) or self._index[1032 + 20 * k : 1052 + 20 * k])
    assert [read.offset(n) for n in names] == [places[n] for n in names] and len(searched) < len(names)
    assert not any(read.offset(hashlib.sha1(n).digest()) for n in names)


def test_files_that_come_back_keep_their_trees(tmp_path):
    """Contents of a few files that come again and again, also right after each other: every tree is the one git makes of the same files."""
    pack, chance, files, trees = git_corpus._Pack(str(tmp_path / "r.git")), random.Random(3), {}, []
    written = git_corpus._Files(pack)
    for _ in range(400):
        path, content = f"{chance.choice(('pkg', 'tests'))}/m_{chance.randrange(12)}.py", b"x = %d\n" % chance.randrange(3)
        files[path] = content
        trees.append((written.put(path, pack.add("blob", content)), dict(files)))
    pack.close("refs/heads/main", trees[-1][0])
    store = source.Store(str(tmp_path / "r.git"))
    for tree, want in trees:
        assert {path.decode(): store.read(blob)[1] for path, _, blob in store.changed(None, tree)} == want
    (packed,) = (tmp_path / "r.git/objects/pack").glob("*.pack")
    subprocess.run(["git", "--git-dir", str(tmp_path / "r.git"), "verify-pack", str(packed)], check=True)
