"""Detectors, the function table, caps and budgets under names that SQL can call."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, SkipRestOfInputTableException

from codequarry.functions import kernels
from codequarry.functions.columns import SMELLS
from codequarry.operators import review

SHOWS = "struct<" + ", ".join(f"{name}: boolean" for name in SMELLS.values()) + ">"


def shows(source: str | None) -> dict[str, bool]:
    """Whether the one function of a source shows each smell, at the usual thresholds."""
    found = kernels.measure(source or "")
    tree = kernels.parse(source or "")[0]
    top = kernels.top_level_function(tree)
    return {
        "long_method": (found["nloc"] or 0) > 30 or (found["ccn"] or 0) > 10,
        "long_param_list": top is not None and len(kernels.params_of(top)) > 5,
        "magic_numbers": bool(found.get("magic")),
        "deep_nesting": found.get("max_depth", 0) > 3,
        "dead_code": bool(found.get("dead")),
    }


_CELLS = "ARRAY<STRUCT<a: STRING, b: STRING, n: BIGINT>>"
#: Functions in SQL alone: name, what it takes, what it gives, and how.
KAPPA_FUNCTIONS = [
    ("rated", "a STRING, b STRING", "STRING", review.RATED),
    ("rating_cells", "counts ARRAY<STRUCT<item: STRING, count: BIGINT>>, total BIGINT", _CELLS, review.CELLS),
    ("kappa_of_cells", f"cells {_CELLS}", "DOUBLE", review.KAPPA),
    ("kappa_of", "counts ARRAY<STRUCT<item: STRING, count: BIGINT>>, total BIGINT", "DOUBLE", "kappa_of_cells(rating_cells(counts, total))"),
]


class FunctionsOf:
    """A row for each function and method of a source; none if it doesn't parse."""

    def eval(self, source: str) -> Iterator[tuple]:
        for f in kernels.listed(source)[1]:
            yield f["qualname"], f["lineno"], f["end_lineno"], f["params"], f["source"]


def _columns(rows: AnalyzeArgument, *names: str) -> StructType:
    """The type of a table argument that has these columns."""
    if not rows.isTable:
        raise ValueError("the first argument is a table: TABLE(..)")
    if missing := [n for n in names if n not in rows.dataType.names]:
        raise ValueError(f"the table has no {', '.join(missing)}")
    return rows.dataType


class Capped:
    """The first rows by ``seq`` and ``id`` of each ``repo`` and ``smell_type`` of a table with any other columns; what comes after them isn't looked at."""

    def __init__(self) -> None:
        self._n = 0

    @staticmethod
    def analyze(rows: AnalyzeArgument, cap: AnalyzeArgument) -> AnalyzeResult:
        schema = _columns(rows, "repo", "smell_type", "seq", "id")
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("repo"), PartitioningColumn("smell_type")], orderBy=[OrderingColumn("seq"), OrderingColumn("id")])

    def eval(self, row: Row, cap: int) -> Iterator[Row]:
        if self._n >= cap:
            raise SkipRestOfInputTableException(f"{cap} rows are enough")
        self._n += 1
        yield row


class Budgets:
    """How many pairs each repository may give, as ``mining.budgets``: a table of ``smell_type``, ``place``, ``repo``, ``available`` and ``repos`` (of the smell), and the cap of a smell."""

    def __init__(self) -> None:
        self._total = self._seen = 0

    @staticmethod
    def analyze(rows: AnalyzeArgument, cap: AnalyzeArgument) -> AnalyzeResult:
        given = _columns(rows, "smell_type", "place", "repo", "available", "repos")
        kinds = [given["smell_type"].dataType, StringType(), LongType(), LongType()]
        schema = StructType([StructField(n, t) for n, t in zip(("smell_type", "repo", "budget", "taken"), kinds, strict=True)])
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("smell_type")], orderBy=[OrderingColumn("place"), OrderingColumn("repo")])

    def eval(self, row: Row, cap: int) -> Iterator[tuple]:
        budget = max(0, -(-(cap - self._total) // (row["repos"] - self._seen)))
        taken = min(budget, row["available"])
        self._total, self._seen = self._total + taken, self._seen + 1
        yield row["smell_type"], row["repo"], budget, taken


def register(spark: SparkSession) -> None:
    """``functions_of(source)`` as a table, ``smells_of(source)`` and a function for each detector by its name; ``capped(TABLE(pairs), n)`` and ``budgets(TABLE(counts), cap)``.

    ``kappa_of(approx_top_k(rated(a, b), 1000, 10000), count(*))`` is Cohen's kappa of a group: the first part is merged in parts, the rest is arithmetic on its few counts.
    """
    spark.udtf.register("capped", F.udtf(Capped))
    spark.udtf.register("budgets", F.udtf(Budgets))
    spark.udtf.register("functions_of", F.udtf(FunctionsOf, returnType="qualname: string, lineno: int, end_lineno: int, params: array<string>, source: string"))

    @F.pandas_udf(SHOWS)
    def smells_of(sources: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shows(s) for s in sources], columns=list(SMELLS.values()))

    spark.udf.register("smells_of", smells_of)
    for name, takes, gives, body in KAPPA_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({takes}) RETURNS {gives} RETURN {body}")
    for name in SMELLS.values():
        spark.udf.register(name, _detector(name))


def _detector(name: str):
    @F.pandas_udf("boolean")
    def detector(sources: pd.Series) -> pd.Series:
        return pd.Series([shows(s)[name] for s in sources], dtype=object)

    return detector
