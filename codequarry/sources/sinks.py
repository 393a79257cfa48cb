"""Sinks: keyed merges that don't read what they write, backfills, splits, assignments, appended results and reports."""

from __future__ import annotations

import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codequarry.functions.columns import smell_code
from codequarry.operators.review import latest


def merged(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """All rows of ``new``, and those of ``existing`` whose key isn't in ``new``."""
    return existing.join(new.select(*key), key, "left_anti").select(*existing.columns).unionByName(new)


class PairTable:
    """Pairs in folders by run and smell; numbered pointer files name the folders of each smell, oldest first.

    A merge writes its own rows to a folder of their own, and then a pointer with the next number, which a rename brings into place whole; it reads and
    rewrites nothing that is there. A reader takes for each key the row of the newest folder: smells in one folder are read as they are, and of the others only
    the keys of later folders are compared. When a smell has more than ``most_folders``, its later folders become one, or all do where
    those have a quarter of the first one's rows, so a row is rewritten a few times in all. Nothing is deleted or written over but by ``vacuum``, so a
    driver or executor that is lost at any moment leaves the last pointer and all that it names. One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str, most_folders: int = 8):
        if most_folders < 2:
            raise ValueError("a smell has a folder and what was merged since")
        self.spark, self.root, self.most_folders = spark, root.rstrip("/"), most_folders

    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, folder: str) -> dict[str, int]:
        """What is in a folder, with the times of its last changes in milliseconds."""
        fs, path = self._fs(folder)
        return {f.getPath().getName(): f.getModificationTime() for f in fs.listStatus(path)} if fs.exists(path) else {}

    def _numbers(self) -> list[int]:
        """Numbers of the pointers, newest last. Unfinished ones have names that aren't numbers."""
        return sorted(int(n) for n in self._names("_pointers") if n.isdigit())

    def folders(self, number: int | None = None) -> dict[str, list[tuple[str, int]]]:
        """The folders of each smell with their rows, oldest first; those of the newest pointer, or of an earlier one."""
        number = number or max(self._numbers(), default=0)
        if not number:
            return {}
        lines = [r.value.split(" ") for r in self.spark.read.text(f"{self.root}/_pointers/{number}").collect()]
        return {smell: [(f, int(n)) for f, n in (x.split(":") for x in rest)] for smell, *rest in lines}

    def read(self, smells: list[str] | None = None) -> DataFrame | None:
        """Rows of the table, or of some smells; None before the first merge. Other smells' folders aren't opened."""
        rows = self._keyed({s: f for s, f in self.folders().items() if smells is None or s in smells})
        return rows if rows is None else rows.drop("__smell", "__key")

    def _keyed(self, folders: dict[str, list[tuple[str, int]]]) -> DataFrame | None:
        """One row a key, with the key as the table compares it. Folders in the same place of their smells are read together, so there are at most ``most_folders`` reads."""
        if not folders:
            return None
        reads, plain = [], [f"{self.root}/{f[0][0]}/of={s}" for s, f in sorted(folders.items()) if len(f) == 1]
        several = {s: f for s, f in folders.items() if len(f) > 1}
        for place in range(max(map(len, several.values()), default=0)):
            paths = [f"{self.root}/{f[place][0]}/of={s}" for s, f in sorted(several.items()) if place < len(f)]
            reads.append(self._parquet(paths).withColumn("__place", F.lit(place)))
        out = self._parquet(plain) if plain else None
        if reads:
            key = ["__smell", "__key"]
            later = [r.select(*key, "__place") for r in reads[1:]]
            newest = reduce(DataFrame.unionByName, later).groupBy(*key).agg(F.max("__place").alias("__newest"))
            kept = [reads[0].join(newest.select(*key), key, "left_anti")]
            kept += [r.join(newest, key).filter("__place = __newest").drop("__newest") for r in reads[1:]]
            whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), kept).drop("__place")
            out = whole if out is None else out.unionByName(whole, allowMissingColumns=True)
        return out

    def _parquet(self, paths: list[str]) -> DataFrame:
        return self.spark.read.option("mergeSchema", "true").parquet(*paths)

    def merge(self, new: DataFrame, key: str = "id", smell: str = "smell_type", order: list[str] | None = None) -> dict[str, int]:
        """Put ``new`` in place of rows with its keys; returns the distinct keys of this run by smell.

        Of rows with one key in ``new`` the last by ``order`` (by default ``seq``, where there is one) counts. ``new`` is computed once.
        """
        order = order if order is not None else [c for c in ("seq",) if c in new.columns]
        folder = f"run-{uuid.uuid4().hex}"
        rows = latest(new, [smell, key], order).withColumns({"__smell": F.col(smell).cast("string"), "__key": F.col(key).cast("string"), "of": F.col(smell)})
        rows.write.partitionBy("of").parquet(f"{self.root}/{folder}")
        # An empty run has no folders of smells and leaves the table as it is.
        wrote = [n for n in self._names(folder) if n.startswith("of=")]
        found = {r["__smell"]: r["count"] for r in self._parquet([f"{self.root}/{folder}/{n}" for n in wrote]).groupBy("__smell").count().collect()} if wrote else {}
        if found:
            now = self.folders()
            self._point({**now, **{s: [*now.get(s, []), (folder, n)] for s, n in found.items()}})
            self._fold({s for s in found if len(now.get(s, [])) >= self.most_folders})
        return found

    def _fold(self, smells: set[str]) -> None:
        """Make one folder of the later ones, or of all."""
        now = self.folders()
        whole = {s for s in smells if 4 * sum(n for _, n in now[s][1:]) >= now[s][0][1]}
        if whole:
            self.compact(sorted(whole))
        if smells - whole:
            self._rewrite({s: now[s][1:] for s in smells - whole})

    def compact(self, smells: list[str] | None = None) -> None:
        """Bring every smell that has several folders, or some smells, into one."""
        self._rewrite({s: f for s, f in self.folders().items() if len(f) > 1 and (smells is None or s in smells)})

    def _rewrite(self, parts: dict[str, list[tuple[str, int]]]) -> None:
        """Write the newest rows of some folders of each smell to one that takes their place."""
        if not parts:
            return
        folder = f"run-{uuid.uuid4().hex}"
        keyed = self._keyed(parts)
        keyed.withColumn("of", F.col("__smell")).write.partitionBy("of").parquet(f"{self.root}/{folder}")
        rows = {r["__smell"]: r["count"] for r in self._parquet([f"{self.root}/{folder}/of={s}" for s in parts]).groupBy("__smell").count().collect()}
        now = self.folders()
        for s, old in parts.items():
            at = now[s].index(old[0])
            now[s][at : at + len(old)] = [(folder, rows[s])]
        self._point(now)

    def vacuum(self, keep: int = 1, older_than_hours: float = 24) -> int:
        """Delete folders that the newest ``keep`` pointers don't name, and older pointers; returns how many folders went.

        What has changed within ``older_than_hours`` stays, for readers and a writer that are still at work.
        """
        numbers = self._numbers()
        named = {f for n in numbers[-keep:] for folders in self.folders(n).values() for f, _ in folders}
        before = time.time() * 1000 - older_than_hours * 3_600_000
        gone = [n for n, at in self._names("").items() if n.startswith("run-") and n not in named and at <= before]
        for name in [f"_pointers/{n}" for n in numbers[:-keep]] + gone:
            fs, path = self._fs(name)
            fs.delete(path, True)
        return len(gone)

    def _point(self, folders: dict[str, list[tuple[str, int]]]) -> None:
        number = max(self._numbers(), default=0) + 1
        fs, fresh = self._fs(f"_pointers/unfinished-{uuid.uuid4().hex}")
        out = fs.create(fresh, False)
        out.write(bytearray("\n".join(" ".join([s, *(f"{f}:{n}" for f, n in some)]) for s, some in sorted(folders.items())).encode()))
        out.close()
        _, path = self._fs(f"_pointers/{number}")
        if not fs.rename(fresh, path):
            raise RuntimeError(f"another writer has made pointer {number} of {self.root}")


class BatchLog:
    """Rows of a stream's batches, each batch once, whatever is lost or run again.

    A batch writes a folder of its own and then a commit, a small file with the folder's name that a rename brings into place whole; only folders that a commit names are read.
    A batch that has a commit isn't written again. Commits are named by stream and batch, so several streams may write to one log. What lost runs have left is deleted by ``vacuum``.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def has(self, stream: str, batch: int) -> bool:
        fs, path = self._fs(f"commits/{stream}-{batch}")
        return fs.exists(path)

    def append(self, rows: DataFrame, stream: str, batch: int) -> bool:
        """Whether the rows were written now; not if this batch has been."""
        if self.has(stream, batch):
            return False
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.root}/rows/{name}")
        self._commit(name, stream, batch)
        return True

    def _commit(self, name: str, stream: str, batch: int) -> None:
        fs, new = self._fs(f"commits/.{name}")
        out = fs.create(new, True)
        out.write(bytearray(name.encode()))
        out.close()
        place = self._fs(f"commits/{stream}-{batch}")[1]
        if not fs.rename(new, place):
            raise RuntimeError(f"batch {batch} of {stream} has been written by another run")

    def _committed(self) -> list[str]:
        fs, path = self._fs("commits")
        return [r.value for r in self.spark.read.text(f"{self.root}/commits").collect()] if fs.exists(path) else []

    def read(self) -> DataFrame | None:
        """All rows; None before the first batch."""
        names = self._committed()
        return self.spark.read.parquet(*(f"{self.root}/rows/{n}" for n in names)) if names else None

    def vacuum(self, older_than_hours: float = 24) -> int:
        """Delete folders that no commit names and no running batch can be writing any more; how many."""
        fs, path = self._fs("rows")
        named, before = set(self._committed()), (time.time() - older_than_hours * 3600) * 1000
        gone = [f.getPath() for f in fs.listStatus(path) if f.getPath().getName() not in named and f.getModificationTime() <= before] if fs.exists(path) else []
        for folder in gone:
            fs.delete(folder, True)
        return len(gone)


def backfill(rows: DataFrame, column: str, value: str) -> DataFrame:
    return rows.withColumn(column, F.coalesce(column, F.lit(value)))


def backfill_counts(rows: DataFrame, column: str) -> DataFrame:
    """``total``, ``already`` and ``updated`` of a backfill."""
    return rows.agg(F.count("*").alias("total"), F.count(column).alias("already"), F.count_if(F.col(column).isNull()).alias("updated"))


def newest_requests(existing: DataFrame, new: DataFrame) -> DataFrame:
    """A cache of requests by (``repo``, ``pr_number``), in that order; new rows come before old. Of new rows with one key the last by merge time counts."""
    order = [c for c in ("merged_at",) if c in new.columns]
    return merged(existing, latest(new, ["repo", "pr_number"], order), ["repo", "pr_number"]).orderBy("repo", "pr_number")


def write_splits(rows: DataFrame, path: str, force: bool = False) -> None:
    rows.write.mode("overwrite" if force else "errorifexists").partitionBy("split").parquet(path)


def first_of_key(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``, others dropped; rows equal in both are told apart by their hash. A hot key is reduced before the shuffle."""
    place = F.struct(*order, F.xxhash64(*rows.columns).alias("tie"))
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), place).alias("row")).select(*key, "row.*").select(*rows.columns)


def append_by_code(rows: DataFrame, path: str, smell: str = "smell_type") -> None:
    """Add rows as JSON lines to a folder for each smell code; what is there stays, so a key may come twice (``read_appended`` keeps one)."""
    rows.withColumn("code", smell_code(smell)).write.mode("append").partitionBy("code").json(path)


def read_appended(spark: SparkSession, path: str, schema: str, key: str = "id", order: tuple[str, ...] = ()) -> DataFrame:
    """What ``append_by_code`` has written, one row a key: the first by ``order``."""
    return first_of_key(spark.read.schema(f"{schema}, code string").json(path), [key], list(order))


def write_sample(sample: DataFrame, rates: DataFrame, path: str, force: bool = False) -> None:
    """A numbered sample and the base rates it was drawn from, beside each other."""
    write_json(sample, f"{path}/sample", force)
    write_json(rates, f"{path}/rates", force)


def write_html(blocks: DataFrame, path: str, force: bool = False) -> DataFrame:
    """Blocks (``smell_type``, ``number``, ``html``, ``repo``) as one text per smell, in order of their numbers; returns blocks and distinct repositories by smell.

    A missing repository counts as one of its own. Reports hold a limited number of blocks (``sample.first_of_smell``), so a smell is one file.
    """
    pages = blocks.repartition("smell_type").sortWithinPartitions("smell_type", "number")
    pages.select("smell_type", F.concat(F.lit("<!-- "), F.col("number").cast("string"), F.lit(" -->"), F.col("html")).alias("value")).write.mode("overwrite" if force else "errorifexists").partitionBy("smell_type").text(path)
    return blocks.groupBy("smell_type").agg(F.count("*").alias("pairs"), F.countDistinct(F.coalesce("repo", F.lit(""))).alias("repos"))


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``item``, ``#1`` and so on within each group. For reports: a group is sorted in one task, so limit it first."""
    return rows.withColumn("item", F.concat(F.lit("#"), F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("string")))


def write_json(rows: DataFrame, path: str, force: bool = False) -> None:
    rows.write.mode("overwrite" if force else "errorifexists").json(path)
