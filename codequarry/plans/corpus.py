"""Python source and commits derived from the relational tables, so that SQL can say what the operators must find.

Each row of ``part`` becomes one function whose parameters, nesting, numbers, dead variables and plain statements follow from its
key and size; four functions make a file. Each line of an order becomes a function that the order, as a commit, changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Quantities that are equal modulo this give the same function: it is a multiple of all that they are divided by.
PERIOD = 180


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _times(n: Column, line: str) -> Column:
    return F.repeat(F.lit(line + "\n"), n)


def _numbered(n: Column, build) -> Column:
    """Lines built from 0 .. n - 1."""
    items = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: build(i.cast("string")))).otherwise(F.array().cast("array<string>"))
    return F.array_join(items, "")


def function_source(name: Column, params: Column, depth: Column, literals: Column, dead: Column, filler: Column, unreachable: Column, call: Column | None = None) -> Column:
    """A function of ``filler + literals + dead + depth + (depth > 0) + 3 + unreachable`` lines, one more with a call."""
    listed = F.when(params > 0, F.array_join(F.transform(F.sequence(F.lit(0), params - 1), lambda i: F.concat(F.lit("p"), i.cast("string"))), ", ")).otherwise("")
    nested = F.when(depth > 0, F.concat(_numbered(depth, lambda i: F.concat(F.repeat(F.lit("    "), i.cast("int") + 1), F.lit("if total > 0:\n"))), F.repeat(F.lit("    "), depth + 1), F.lit("total = total + 2\n"))).otherwise("")
    return F.concat(
        F.lit("def "), name, F.lit("("), listed, F.lit("):\n    total = 0\n"),
        _times(filler, "    total = total + 1"),
        _numbered(literals, lambda i: F.concat(F.lit("    total = total + 10"), i, F.lit("\n"))),
        _numbered(dead, lambda i: F.concat(F.lit("    dead_"), i, F.lit(" = total\n"))),
        nested,
        F.lit("") if call is None else F.when(call.isNotNull(), F.concat(F.lit("    total = total + "), call, F.lit("(total)\n"))).otherwise(""),
        F.lit("    return total"),
        F.when(unreachable > 0, F.lit("\n    total = 1")).otherwise(""),
    )


def _as_method(source: Column, owner: Column) -> Column:
    """The function, indented, as the only method of a class."""
    return F.concat(F.lit("class "), owner, F.lit(":\n    "), F.replace(source, F.lit("\n"), F.lit("\n    ")))


def part_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey").cast("int"), F.col("p_size").cast("int")
    rows = table(spark, sf_dir, "part").select(
        k.alias("k"), (k % 9).alias("params"), (k % 6).alias("depth"), (s % 4).alias("literals"), (F.floor(k / 7) % 3).cast("int").alias("dead"), s.alias("filler"), (k % 11 == 0).cast("int").alias("unreachable"),
    )
    name = F.concat(F.lit("f_"), F.col("k").cast("string"))
    source = function_source(name, *(F.col(c) for c in ("params", "depth", "literals", "dead", "filler", "unreachable")))
    return rows.withColumn("source", source)


def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path`` and ``text``: four functions a file, every fifth one a method; every 97th key breaks its file."""
    rows = part_functions(spark, sf_dir)
    owner = F.concat(F.lit("C_"), F.col("k").cast("string"))
    text = F.when(F.col("k") % 5 == 0, _as_method(F.col("source"), owner)).otherwise(F.col("source"))
    text = F.concat(text, F.when(F.col("k") % 97 == 0, F.lit("\ndef broken(:")).otherwise(""))
    keyed = rows.select(F.floor(F.col("k") / 4).alias("file"), F.struct("k", text.alias("text")).alias("one"))
    files = keyed.groupBy("file").agg(F.sort_array(F.collect_list("one")).alias("all"))
    return files.select(F.concat(F.lit("src/m_"), F.col("file").cast("string"), F.lit(".py")).alias("path"), F.concat(F.array_join("all.text", "\n\n\n"), F.lit("\n")).alias("text"))


def modified_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commits, each to one file, with the lines of the order as its functions before and after.

    Returned lines lose every smell, accepted ones some, the others stay as they are; returned lines whose number is odd get a helper.
    Lines with one number are definitions of one name, of which the last counts. Functions follow from a line's number, status and ``PERIOD`` of the quantity,
    so each different one is spelt once, and lines are brought together as numbers.
    """
    q, j, status = F.col("q"), F.col("j"), F.col("status")
    before = {"params": q % 9, "depth": j % 6, "literals": q % 4, "dead": q % 3, "filler": F.when(q % 10 == 0, 32).otherwise(q % 5)}

    def after(name: str, c: Column) -> Column:
        return F.when(status == "R", F.lit(1 if name == "filler" else 0)).when(status == "A", F.floor(c / 2).cast("int")).otherwise(c)

    base = F.concat(F.lit("f_"), j.cast("string"))
    helper = F.when((status == "R") & (j % 2 == 1), F.concat(F.lit("h_"), j.cast("string")))
    none = F.lit(0)
    old = function_source(base, *before.values(), none)
    new = function_source(base, *(after(n, c) for n, c in before.items()), none, helper)
    extra = F.when(helper.isNotNull(), F.concat(F.lit("\n\n\ndef "), helper, F.lit("(total):\n    return total + 1"))).otherwise("")
    kind = {"j": F.col("l_linenumber").cast("int"), "q": F.col("l_quantity").cast("int") % PERIOD, "status": F.col("l_returnflag")}
    rows = table(spark, sf_dir, "lineitem").withColumns(kind)
    spelt = rows.select(*kind).distinct().select(*(F.col(c).alias(f"__{c}") for c in kind), old.alias("old"), F.concat(new, extra).alias("new"))
    dealt = rows.select(F.col("l_orderkey").alias("o_orderkey"), *kind, "l_partkey", "l_suppkey", "l_extendedprice").repartition("o_orderkey")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in kind]
    lines = dealt.join(F.broadcast(spelt), same).select("o_orderkey", F.struct("j", "l_partkey", "l_suppkey", "l_extendedprice", "old", "new").alias("line"))
    files = lines.groupBy("o_orderkey").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    orders = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    # Messages of the commits, in turn.
    messages = ["Refactor the loader", "Fix a typo", "Remove dead code and clean up", "Add a feature", "Introduce parameter object"]
    message = F.element_at(F.array(*map(F.lit, messages)), (k % len(messages) + 1).cast("int"))
    path = F.concat(F.when(k % 10 == 0, F.lit("tests/")).otherwise("pkg/"), F.lit("m_"), (k % 50).cast("string"), F.lit(".py"))
    # Packed orders look small enough for the driver, but there is one for each commit.
    return orders.hint("shuffle_hash").join(files, "o_orderkey").select(
        F.concat(F.lit("repo_"), (F.col("o_custkey") % 25).cast("string")).alias("repo"),
        F.sha1(k.cast("string").cast("binary")).alias("commit_hash"),
        F.lit(None).cast("string").alias("parent_commit"),
        k.cast("long").alias("seq"),
        F.col("o_orderdate").cast("timestamp").alias("committed_at"),
        message.alias("message"),
        (k % 13 == 0).alias("is_merge"),
        path.alias("old_path"),
        path.alias("new_path"),
        F.array_join("lines.old", "\n\n\n").alias("before"),
        F.array_join("lines.new", "\n\n\n").alias("after"),
    )


def rich_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function for each part with what ``part_files`` lacks: loops, ``elif``, ``try``, defaults, comprehensions, a decorator, ``async``, all kinds of parameters."""
    k = F.col("p_partkey").cast("int")
    when = lambda test, text: F.when(test, F.lit(text)).otherwise("")
    text = F.concat(
        when(k % 2 == 0, "@decorated(86400)\n"), when(k % 5 == 0, "async "), F.lit("def r_"), k.cast("string"), F.lit("(a, /, b=7, *rest, c=3, **more):\n"),
        when(k % 3 == 0, '    """Says nothing,\n    on two lines."""\n'),
        F.lit("    # a remark\n\n    total = [x * 5 for x in b if x and a]\n    if a == 0:\n        total = 0\n"),
        F.repeat(F.lit("    elif a == 1:\n        total = 1\n"), k % 4),
        when(k % 2 == 1, "    try:\n        total = a.b\n    except KeyError:\n        total = None\n    finally:\n        more.clear()\n"),
        when(k % 3 == 1, "    for i in b:\n        while i:\n            with c:\n                break\n"),
        when(k % 5 == 1, "    spare = a\n"),
        F.lit("    return total\n"),
        when(k % 7 == 0, "    return c\n"),
    )
    return table(spark, sf_dir, "part").select(F.concat(F.lit("src/r_"), k.cast("string"), F.lit(".py")).alias("path"), text.alias("text"))
