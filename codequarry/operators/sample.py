"""Judging, sampling and reporting over pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.functions import kernels
from codequarry.functions.columns import REFACTORINGS, SMELLS, escape_html, smell_code, stripped
from codequarry.functions.rowwise import with_kernel
from codequarry.operators.review import shuffle_rank


def parse_verdict(response: Column | str) -> tuple[Column, Column, Column]:
    """Verdict, confidence and reason from a judge's answer: its first line, its second, and the rest."""
    text = stripped(F.coalesce(F.col(response) if isinstance(response, str) else response, F.lit("")))
    lines = F.filter(F.transform(F.split(text, r"\r\n|[\r\n]"), stripped), lambda x: x != "")
    first, second = F.upper(F.get(lines, F.lit(0))), F.lower(F.get(lines, F.lit(1)))
    verdict = F.when(F.contains(first, F.lit("REAL")) & ~F.contains(first, F.lit("APARENTE")), "real").otherwise("aparente")
    confidence = F.when(F.contains(second, F.lit("alta")), "alta").when(F.contains(second, F.lit("baixa")), "baixa").otherwise("media")
    reason = F.when(F.size(lines) >= 3, F.array_join(F.slice(lines, 3, 1_000_000), " ")).otherwise(text)
    return verdict, confidence, reason


def judged(answers: DataFrame) -> DataFrame:
    """``answers`` (with ``response``) with ``verdict``, ``confidence`` and ``reason``."""
    verdict, confidence, reason = parse_verdict("response")
    return answers.withColumns({"verdict": verdict, "confidence": confidence, "reason": reason})


def judged_real(pairs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Pairs whose annotation (``id``, ``veredito``) says that they are real."""
    return pairs.join(verdicts.filter("veredito = 'real'").select("id").distinct(), "id", "left_semi")


def judged_batch(pairs: DataFrame, done: DataFrame, most: int | None = None) -> DataFrame:
    """The next pairs to judge, at most ``most`` in order of their ids: those without a verdict. Answers are appended to ``done`` after each batch."""
    rows = pending(pairs, done)
    return rows if most is None else rows.orderBy("id").limit(most)


def distinct_repos(pairs: DataFrame) -> DataFrame:
    """One row: pairs and their distinct repositories, a missing one taken as an empty name."""
    return pairs.agg(F.count("*").alias("pairs"), F.countDistinct(F.coalesce("repo", F.lit(""))).alias("repos"))


def pending(pairs: DataFrame, done: DataFrame) -> DataFrame:
    return pairs.join(done.select("id"), "id", "left_anti")


def yields(judgements: DataFrame, by: str = "smell_type") -> DataFrame:
    """Judged and real pairs by smell and in all (``TOTAL``), with the yield in whole per cent, rounded down."""
    rows = judgements.rollup(by).agg(F.count("*").alias("judged"), F.count_if(F.col("verdict") == "real").alias("real"), F.grouping(by).alias("all"))
    percent = F.floor(F.try_divide(F.col("real") * 100, F.col("judged"))).cast("long")
    return rows.select(F.when(F.col("all") == 1, "TOTAL").otherwise(F.col(by)).alias(by), "judged", "real", percent.alias("percent"))


def base_rates(flagged: DataFrame) -> DataFrame:
    """Rows by smell and in all with and without ``flag``, and the share with it in whole per cent, rounded down."""
    rows = flagged.rollup("smell_type").agg(F.count("*").alias("n"), F.count_if("flag").alias("flag_true"), F.grouping("smell_type").alias("all"))
    percent = F.floor(F.try_divide(F.col("flag_true") * 100, F.col("n"))).cast("long")
    return rows.select(F.when(F.col("all") == 1, "TOTAL").otherwise(F.col("smell_type")).alias("smell_type"), "n", "flag_true", (F.col("n") - F.col("flag_true")).alias("flag_false"), percent.alias("percent"))


def stratified_sample(flagged: DataFrame, per_flag: int = 5, per_smell: int = 10, seed: int = 42) -> DataFrame:
    """Of each smell ``per_flag`` rows with and as many without ``flag``, filled up to ``per_smell`` with the others; numbered.

    Both ranks are limited before their shuffle, so large smells cost no more than the sample.
    """
    drawn = flagged.withColumn("draw", shuffle_rank("id", seed=seed))
    by_flag = Window.partitionBy("smell_type", "flag").orderBy("draw", "id")
    near = drawn.withColumn("place", F.row_number().over(by_flag)).filter(F.col("place") <= per_smell)
    by_smell = Window.partitionBy("smell_type").orderBy(F.desc(F.col("place") <= per_flag), F.desc("flag"), "place", "id")
    return near.withColumn("number", F.row_number().over(by_smell)).filter(F.col("number") <= per_smell).withColumn("sample_id", F.concat(F.lower("smell_type"), F.lit("_"), F.lpad(F.col("number").cast("string"), 6, "0"))).drop("draw", "place")


def uniform_sample(rows: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (or all, if fewer), always the same."""
    return rows.orderBy(shuffle_rank("id", seed=seed), "id").limit(n)


def nested_samples(rows: DataFrame, thresholds: list[float], n: int, seed: int = 42) -> DataFrame:
    """``rows`` (``id``, ``similarity``) that are among the first ``n`` at random of those with at least a threshold's similarity, once each, with ``thresholds``, those they are drawn for.

    Each threshold's sample is ``uniform_sample`` of its rows; one order serves all, so a row drawn for a threshold is drawn for the higher ones that it reaches too, and whatever is computed of
    it is computed once. Ranks are limited before their shuffle; only ids and similarities are ranked. Rows without a similarity are drawn for none. ``id`` is distinct.
    """
    reached = F.filter(F.array(*map(F.lit, sorted(set(thresholds)))), lambda t: t <= F.col("similarity"))
    drawn = rows.select("id", shuffle_rank("id", seed=seed).alias("draw"), F.explode(reached).alias("threshold"))
    first = drawn.withColumn("place", F.row_number().over(Window.partitionBy("threshold").orderBy("draw", "id"))).filter(F.col("place") <= n)
    return rows.join(first.groupBy("id").agg(F.sort_array(F.collect_list("threshold")).alias("thresholds")), "id")


def first_of_smell(rows: DataFrame, n: int, order: list[str]) -> DataFrame:
    return rows.withColumn("number", F.row_number().over(Window.partitionBy("smell_type").orderBy(*order))).filter(F.col("number") <= n)


def behaviour_precision(checks: DataFrame) -> DataFrame:
    """By ``threshold``: equivalent, different and inconclusive pairs, and the share of equivalent among the comparable (null without any)."""
    bad = F.col("error").isNotNull() | (F.col("samples") == 0)
    rows = checks.groupBy("threshold").agg(
        F.count("*").alias("sampled"),
        F.count_if(~bad & F.col("equivalent")).alias("equiv"),
        F.count_if(~bad & ~F.col("equivalent")).alias("diff"),
        F.count_if(bad).alias("inconclusive"),
    )
    return rows.withColumn("precision", F.try_divide(F.col("equiv"), F.col("equiv") + F.col("diff")))


def least_precise_enough(precisions: DataFrame, least: float = 0.7) -> DataFrame:
    """One row: the smallest threshold whose precision is above ``least``; null if none is."""
    return precisions.agg(F.min(F.when(F.col("precision") > least, F.col("threshold"))).alias("threshold"))


# What a model is told for each smell, and the frame of it.
TASKS = {
    "R1": (
        "refactor a Long Method by applying the Extract Method pattern",
        "Identify cohesive groups of statements within the function and extract each group into a well-named helper function. The original function must become a thin orchestrator that calls the extracted helpers. Do not change observable behaviour.",
    ),
    "R2": (
        "refactor a Long Parameter List by introducing a Parameter Object",
        "Group logically related parameters into a dataclass (or named tuple). Replace the long parameter list in the original function signature with a single object of the new type. Validation that was inline in the function body should move into the dataclass __post_init__. Do not change observable behaviour.",
    ),
    "R3": (
        "refactor Magic Numbers and Magic Strings by replacing them with Named Constants",
        "Every literal number or string that encodes domain knowledge must be extracted to a module-level constant with a descriptive ALL_CAPS name. The constant name must convey the business meaning, not just the value (e.g. MAX_RETRY_COUNT = 3, not THREE = 3). Do not change observable behaviour.",
    ),
    "R4": (
        "refactor Deeply Nested Conditionals by introducing Guard Clauses",
        "Invert each nesting level into an early return (guard clause) that handles the error or edge case immediately. The main success path must be left-aligned with no deep nesting. Each guard clause must return or raise before the next clause. Do not change observable behaviour.",
    ),
    "R5": (
        "refactor Dead Code inside a function by removing unreachable statements",
        "Remove all statements that can never be executed: code after an unconditional return/raise, variables assigned but never read, branches whose condition is always false, and commented-out code blocks. Do not remove intentional no-ops or logging. Do not change observable behaviour.",
    ),
}
SYSTEM = "You are a Python refactoring assistant. Your task is to {}.\nApply the refactoring strictly: {}\nReturn ONLY the refactored code, no explanations."


def _said(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def messages(smell: Column | str, before: Column | str, after: Column | str | None = None) -> Column:
    """Chat turns of a pair: system, user and, unless ``after`` is none or null, assistant. An unknown smell is an error."""
    before = F.col(before) if isinstance(before, str) else before
    told = F.create_map(*[F.lit(x) for s in SMELLS for x in (s, SYSTEM.format(*TASKS[s]))])
    asked = F.array(_said("system", F.element_at(told, smell_code(smell))), _said("user", before))
    if after is None:
        return asked
    after = F.col(after) if isinstance(after, str) else after
    return F.when(after.isNull(), asked).otherwise(F.concat(asked, F.array(_said("assistant", after))))


def diffs(pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``changes``, the runs of lines kept, replaced, deleted or inserted."""
    return with_kernel(pairs, "changes", kernels.line_changes, "array<struct<tag string, i1 int, i2 int, j1 int, j2 int>>", "before_code", "after_code")


def diff_html(pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``html``, one block a pair: its title and its lines side by side."""
    rows = diffs(pairs).withColumns({"__old": F.split("before_code", "\n"), "__new": F.split("after_code", "\n")})

    def cell(lines: Column, start: Column, end: Column) -> Column:
        return F.concat(F.lit("<td><pre>"), escape_html(F.array_join(F.slice(lines, start + 1, end - start), "\n")), F.lit("</pre></td>"))

    def block(c: Column) -> Column:
        return F.concat(F.lit('<tr class="'), c["tag"], F.lit('">'), cell(F.col("__old"), c["i1"], c["i2"]), cell(F.col("__new"), c["j1"], c["j2"]), F.lit("</tr>"))

    refactoring = F.element_at(F.create_map(*[F.lit(x) for item in REFACTORINGS.items() for x in item]), F.col("smell_type"))
    title = F.concat_ws(" ", "smell_type", refactoring, escape_html(F.replace("repo", F.lit("https://github.com/"), F.lit(""))), F.left("commit_hash", F.lit(7)), escape_html("function_name"))
    html = F.concat(F.lit("<h3>"), title, F.lit("</h3><table>"), F.array_join(F.transform("changes", block), ""), F.lit("</table>"))
    return rows.withColumn("html", html).drop("__old", "__new", "changes")
