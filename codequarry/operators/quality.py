"""Quality gate and refactoring patterns of pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import VariantType

from codequarry.functions import kernels
from codequarry.functions.columns import SMELLS, nonblank_lines
from codequarry.functions.rowwise import with_kernel, with_kernels

#: Tree similarities below which a pair fails or is doubtful, the fewest lines, and the least reduction of a partial pair.
FAIL_BELOW, WARN_BELOW, FEW_LINES, TRIVIAL_REDUCTION = 0.10, 0.30, 3, 0.05


def _gate(before: str | None, after: str | None) -> dict:
    before, after = before or "", after or ""
    if before == after:
        return {"before_ok": True, "after_ok": True, "similarity": None}
    before_ok, after_ok, similarity = kernels.gate(before, after)
    return {"before_ok": before_ok, "after_ok": after_ok, "similarity": similarity}


def _issue(severity: str, rule: str) -> Column:
    return F.struct(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"))


def _size(pairs: DataFrame, side: str) -> Column:
    """A smell's size on one side, from the evidence that is stored or else from its column."""
    known = [F.col(f"magnitude_{side}").cast("double")] if f"magnitude_{side}" in pairs.columns else []
    if f"detector_{side}" in pairs.columns:
        kind = pairs.schema[f"detector_{side}"].dataType["evidence"].dataType
        known.insert(0, magnitude_of_evidence("smell_type", f"detector_{side}.evidence", typed=isinstance(kind, VariantType)))
    return F.coalesce(*known) if known else F.lit(None).cast("double")


def checked(pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``similarity`` and ``issues`` (severity and rule), in the order of the rules.

    Needs ``before_code``, ``after_code``, ``smell_type``, ``n_functions_after``, ``partial``, and the sizes of the smell: ``magnitude_before`` and ``magnitude_after``, or
    the detectors' stored ``evidence`` (VARIANT or JSON text) in structs ``detector_before`` and ``detector_after``, which count where both are there. A pair without a change, or with a side that doesn't parse, gets no further rules.
    """
    rows = with_kernel(pairs, "gate", _gate, "struct<before_ok boolean, after_ok boolean, similarity double>", "before_code", "after_code")
    sim = F.col("gate.similarity")
    old, new = (_size(pairs, side) for side in ("before", "after"))
    same = F.col("before_code") == F.col("after_code")
    reduced = (old - new) / old
    broken = [F.when(~F.col("gate.before_ok"), _issue("fail", "before_unparseable")), F.when(~F.col("gate.after_ok"), _issue("fail", "after_unparseable"))]
    rules = [
        F.when(sim.isNull(), _issue("warn", "similarity_unavailable")).when(sim < FAIL_BELOW, _issue("fail", "similarity_too_low")).when(sim < WARN_BELOW, _issue("warn", "similarity_borderline")),
        F.when(nonblank_lines("before_code") < FEW_LINES, _issue("warn", "before_too_short")),
        F.when(nonblank_lines("after_code") < FEW_LINES, _issue("warn", "after_too_short")),
        F.when(~F.col("smell_type").isin(*SMELLS), _issue("fail", "smell_invalid")),
        F.when((F.col("smell_type") == "R1") & (F.coalesce("n_functions_after", F.lit(0)) < 2), _issue("warn", "r1_no_helper")),
        F.when(F.col("partial") & (old > 0) & (reduced < TRIVIAL_REDUCTION), _issue("warn", "trivial_reduction")),
    ]
    issues = F.when(same, F.array(_issue("fail", "no_change"))).when(F.col("gate.before_ok") & F.col("gate.after_ok"), F.array_compact(F.array(*rules))).otherwise(F.array_compact(F.array(*broken)))
    return rows.withColumns({"similarity": sim, "issues": issues}).drop("gate")


# What detectors of different ages call the size of a smell, the first that is there counts.
EVIDENCE_KEYS = {
    "R1": ["lines_of_code", "lines_fallback"],
    "R2": ["parametros", "n_params"],
    "R3": ["magic_numbers_count"],
    "R4": ["max_depth", "profundidade"],
    "R5": ["dead_count", "dead_vars"],
}


def magnitude_of_evidence(smell: Column | str, evidence: Column | str, typed: bool = False) -> Column:
    """The size of a smell from a detector's evidence as JSON text, or as a VARIANT if ``typed``; a zero counts as absent, as do other keys and values; null where there is none."""
    smell = F.col(smell) if isinstance(smell, str) else smell

    def number(key: str) -> Column:
        found = F.try_variant_get(evidence, f"$.{key}", "double") if typed else F.get_json_object(evidence, f"$.{key}").try_cast("double")
        return F.nullif(found, F.lit(0.0))

    fields = {s: F.coalesce(*map(number, keys)) for s, keys in EVIDENCE_KEYS.items()}
    out = F.lit(None).cast("double")
    for s, value in fields.items():
        out = F.when(smell == s, value).otherwise(out)
    return out


def status(issues: Column | str = "issues") -> Column:
    has = lambda level: F.exists(issues, lambda i: i["severity"] == level)
    return F.when(has("fail"), "fail").when(has("warn"), "warn").otherwise("clean")


def summary(checks: DataFrame) -> DataFrame:
    """One row: ``total``, and how many are clean, doubtful and failed, with the share that is clean in per cent."""
    row = checks.select(status().alias("status")).agg(F.count("*").alias("total"), *(F.count_if(F.col("status") == s).alias(s) for s in ("clean", "warn", "fail")))
    return row.withColumn("clean_percent", F.round(F.try_divide(F.col("clean") * 100.0, F.col("total")), 1))


def issue_counts(checks: DataFrame) -> DataFrame:
    """``severity``, ``rule`` and ``n``, the most frequent first."""
    return checks.select(F.inline("issues")).groupBy("severity", "rule").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "severity", "rule")


# Spellings of literals that say nothing.
TRIVIAL_LITERALS = ["0", "1", "2", "-1", "''", "' '", "'\\n'"]
PATTERNS = {"R1": "extract_method", "R2": "parameter_object", "R3": "named_constant", "R4": "guard_clauses", "R5": "dead_code_removal"}


def pattern_matches(pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``pattern`` and ``pattern_match``: whether the code changed as the smell's refactoring changes it.

    Needs ``smell_type``, ``before_code``, ``after_code``, ``function_name``; ``lines_before`` and ``lines_after`` (lines of code) are used where they are given.
    """
    rows = with_kernels(pairs, *((f"in_{side}", kernels.pattern_input, f"struct<{kernels.PATTERN_INPUT}>", (f"{side}_code", "function_name")) for side in ("before", "after")))
    old, new = F.col("in_before"), F.col("in_after")
    added = F.array_except(new["functions"], old["functions"])
    both_mains = old["main"].isNotNull() & new["main"].isNotNull()
    shrank = F.col("lines_before").isNull() | (F.col("lines_before") > F.coalesce("lines_after", F.lit(10**9)))

    def becomes_object(name: Column) -> Column:
        at = [F.element_at(m, name) for m in (old["n_params"], new["n_params"], old["params"], new["params"], new["attributes"])]
        return (at[0] - at[1] >= 2) & F.arrays_overlap(F.array_except(at[2], at[3]), at[4])

    constants = F.filter(F.array_except(new["names"], old["names"]), lambda n: n.rlike("^[A-Z][A-Z0-9_]{2,}$"))
    vanished = F.array_except(F.array_except(old["literals"], F.array(*map(F.lit, TRIVIAL_LITERALS))), new["literals"])
    rules = {
        "R1": F.arrays_overlap(new["called"], added) & shrank,
        "R2": F.exists(F.array_intersect(old["functions"], new["functions"]), becomes_object),
        "R3": both_mains & (F.size(vanished) > 0) & (F.size(constants) > 0),
        "R4": both_mains & (old["depth"] > new["depth"]) & (new["guards"] > old["guards"]),
        "R5": (new["lines"] < old["lines"]) & (F.size(added) == 0),
    }
    match, name = F.lit(False), F.lit("?")
    for smell, rule in rules.items():
        match = F.when(F.col("smell_type") == smell, rule).otherwise(match)
        name = F.when(F.col("smell_type") == smell, PATTERNS[smell]).otherwise(name)
    parse = old["parses"] & new["parses"]
    return rows.withColumns({"pattern": F.when(parse, name).otherwise("parse_fail"), "pattern_match": F.coalesce(parse & match, F.lit(False))}).drop("in_before", "in_after")
