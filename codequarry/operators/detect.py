"""Smell detection over Python files: parse once, measure once, decide by column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from codequarry.functions import kernels
from codequarry.functions.columns import SMELLS, magnitude, smell_code
from codequarry.functions.rowwise import with_kernel


@dataclass(frozen=True)
class Thresholds:
    """A function has a smell if a measure is above its threshold; ``statements`` is off by default."""

    lines: int = 30
    ccn: int = 10
    statements: int | None = None
    params: int = 5
    depth: int = 3


DEFAULT = Thresholds()
#: Proposed values that are not in use.
CANDIDATE = Thresholds(lines=75, ccn=25, statements=35, params=6, depth=4)


#: What detectors and their findings read of a function.
FOUND = ("qualname", "lineno", "end_lineno", "params", "nloc", "ccn", "n_statements", "max_depth", "magic", "dead")


def parsed(files: DataFrame, dedent: bool = False, only: tuple[str, ...] | None = None) -> DataFrame:
    """``files`` (with ``path`` and ``text``) with ``error`` and ``functions``, of which ``only`` these fields leave Python, if given; the text isn't carried on."""
    fields = StructType.fromDDL(kernels.FUNCTION)
    result = StructType([StructField("error", StringType()), StructField("functions", ArrayType(StructType([f for f in fields if only is None or f.name in only])))])

    def kernel(text: str | None) -> dict:
        return kernels.functions_of(text, dedent)

    out = with_kernel(files.select("path", "text"), "parsed", kernel, result.simpleString(), "text", without=("text",))
    return out.select("path", "parsed.error", "parsed.functions")


def functions(files: DataFrame, dedent: bool = False, only: tuple[str, ...] | None = None) -> DataFrame:
    """A row for each function and method of the files that parse."""
    return parsed(files, dedent, only).select("path", F.inline("functions"))


def parse_errors(parsed_files: DataFrame) -> DataFrame:
    return parsed_files.filter("error is not null").select("path", "error")


def has_smell(smell: str, m: Column, t: Thresholds = DEFAULT) -> Column:
    """Whether measures ``m`` (a struct or row of ``functions``) show a smell; never null."""
    if smell == "R1":
        long = (m["nloc"] > t.lines) | (m["ccn"] > t.ccn)
        if t.statements is not None:
            long = long | (m["n_statements"] > t.statements)
        shown = F.when(m["nloc"].isNull(), m["end_lineno"] - m["lineno"] + 1 > t.lines).otherwise(long)
    elif smell == "R2":
        shown = F.size(m["params"]) > t.params
    elif smell == "R4":
        shown = m["max_depth"] > t.depth
    else:
        shown = F.size(m[{"R3": "magic", "R5": "dead"}[smell]]) > 0
    return F.coalesce(shown, F.lit(False))


def _rest(n: Column, shown: int) -> Column:
    return F.when(n > shown, F.concat(F.lit(" (+"), (n - shown).cast("string"), F.lit(")"))).otherwise("")


def evidence(smell: str, m: Column) -> Column:
    """One line that says what was found."""
    if smell == "R1":
        text = F.format_string("nloc=%d ccn=%d statements=%d", m["nloc"], m["ccn"], m["n_statements"])
        return F.when(m["nloc"].isNull(), F.format_string("lines=%d", m["end_lineno"] - m["lineno"] + 1)).otherwise(text)
    if smell == "R2":
        return F.concat(F.size(m["params"]).cast("string"), F.lit(" parameters: "), F.array_join(m["params"], ", "))
    if smell == "R4":
        return F.concat(F.lit("depth "), m["max_depth"].cast("string"))
    column, shown = {"R3": ("magic", 5), "R5": ("dead", 4)}[smell]
    if smell == "R3":
        items = F.transform(F.slice(m[column], 1, shown), lambda x: F.concat(x["literal"], F.lit(" (line "), x["lineno"].cast("string"), F.lit(")")))
    else:
        items = F.transform(F.slice(m[column], 1, shown), lambda x: F.concat(x["type"], F.lit(" (line "), x["lineno"].cast("string"), F.lit(")")))
    return F.concat(F.array_join(items, ", "), _rest(F.size(m[column]), shown))


class _Row:
    """Columns of a flat row, by the names that a struct has."""

    def __getitem__(self, name: str) -> Column:
        return F.col(name)


ROW = _Row()


def details(smell: str, f: Column) -> Column:
    """What a detector has found in a function, as a VARIANT: its size under the usual key, and what it consists of."""
    fields = {
        "R1": {"lines_of_code": f["nloc"], "ccn": f["ccn"], "n_statements": f["n_statements"]},
        "R2": {"n_params": F.size(f["params"]), "params": f["params"]},
        "R3": {"magic_numbers_count": F.size(f["magic"]), "numbers": f["magic"]},
        "R4": {"max_depth": f["max_depth"]},
        "R5": {"dead_count": F.size(f["dead"]), "dead": f["dead"]},
    }
    return F.to_variant_object(F.struct(*(c.alias(n) for n, c in fields[smell].items())))


def findings(found: DataFrame, smells: list[str] | None = None, thresholds: Thresholds = DEFAULT, typed: bool = False) -> DataFrame:
    """A row (``path``, ``qualname``, ``lineno``, ``smell``, ``magnitude``, ``evidence``) for each smell of each function; with ``typed`` also ``details``."""
    chosen = selected(smells)

    def one(s: str) -> Column:
        more = [details(s, ROW).alias("details")] if typed else []
        return F.struct(F.lit(s).alias("smell"), magnitude(F.lit(s), ROW).alias("magnitude"), evidence(s, ROW).alias("evidence"), *more)

    each = [F.when(has_smell(s, ROW, thresholds), one(s)) for s in chosen]
    return found.select("path", "qualname", "lineno", F.inline(F.array_compact(F.array(*each))))


def selected(smells: list[str] | None) -> list[str]:
    """Codes of smells given by code or name, without repeats, in the order given; all by default."""
    known = {**{c.lower(): c for c in SMELLS}, **{n: c for c, n in SMELLS.items()}}
    bad = [s for s in smells or [] if s not in known and s.lower() not in known]
    if bad:
        raise ValueError(f"unknown smells: {', '.join(bad)}")
    return list(dict.fromkeys(known.get(s) or known[s.lower()] for s in smells)) if smells else list(SMELLS)


def counts_by_smell(found: DataFrame, smells: list[str] | None = None) -> DataFrame:
    """``smell`` and ``n``, with a row for each smell that was looked for."""
    spark = found.sparkSession
    wanted = spark.createDataFrame([(s,) for s in selected(smells)], "smell string")
    counted = found.groupBy("smell").agg(F.count("*").alias("n"))
    return wanted.join(counted, "smell", "left").select("smell", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def scan_totals(files: DataFrame, thresholds: Thresholds = DEFAULT) -> DataFrame:
    """One row: files, files that don't parse, functions, findings, and functions and files with any. One aggregation, no explode."""
    rows = parsed(files, only=FOUND).withColumn("hits", F.transform("functions", lambda f: _hits(f, thresholds)))
    some = F.size(F.filter("hits", lambda h: h > 0))
    return rows.agg(
        F.count("*").alias("files"),
        F.count("error").alias("errors"),
        F.sum(F.size("functions")).cast("long").alias("functions"),
        F.sum(F.aggregate("hits", F.lit(0), lambda a, h: a + h)).cast("long").alias("findings"),
        F.sum(some).cast("long").alias("functions_with_findings"),
        F.count_if(some > 0).alias("files_with_findings"),
    )


def _hits(f: Column, thresholds: Thresholds) -> Column:
    total = F.lit(0)
    for s in SMELLS:
        total = total + has_smell(s, f, thresholds).cast("int")
    return total


def sweep(found: DataFrame, grid: dict[str, Thresholds]) -> DataFrame:
    """Findings for several thresholds in one pass: ``thresholds``, ``smell``, ``n``."""
    counts = [F.count_if(has_smell(s, ROW, t)).alias(f"{name}:{s}") for name, t in grid.items() for s in SMELLS]
    row = found.agg(*counts)
    entries = [F.struct(F.lit(name).alias("thresholds"), F.lit(s).alias("smell"), F.col(f"`{name}:{s}`").alias("n")) for name in grid for s in SMELLS]
    return row.select(F.inline(F.array(*entries)))


def report(files: DataFrame, smells: list[str] | None = None, thresholds: Thresholds = DEFAULT) -> DataFrame:
    """``report_of`` for files that aren't parsed yet."""
    return report_of(parsed(files, only=FOUND), smells, thresholds)


def report_of(parsed_files: DataFrame, smells: list[str] | None = None, thresholds: Thresholds = DEFAULT) -> DataFrame:
    """``path``, ``error`` and ``json``, the findings of a file by function, for files with a finding or an error."""
    chosen = selected(smells)

    def of_function(f: Column) -> Column:
        each = [F.when(has_smell(s, f, thresholds), F.struct(F.lit(s).alias("smell"), evidence(s, f).alias("evidence"))) for s in chosen]
        return F.struct(f["qualname"].alias("function"), f["lineno"].alias("line"), F.array_compact(F.array(*each)).alias("findings"))

    rows = parsed_files.withColumn("found", F.filter(F.transform("functions", of_function), lambda f: F.size(f["findings"]) > 0))
    return rows.filter("error is not null or size(found) > 0").select("path", "error", F.to_json("found").alias("json"))


def keep_smells(pairs: DataFrame, smells: list[str]) -> DataFrame:
    """Rows of a smell, in whichever form it is written."""
    return pairs.filter(smell_code("smell_type", strict=False).isin(*selected(smells)))
