"""Column expressions shared by operators; all native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes, names and refactorings of the smells, in order.
SMELLS = {"R1": "long_method", "R2": "long_param_list", "R3": "magic_numbers", "R4": "deep_nesting", "R5": "dead_code"}
REFACTORINGS = {"R1": "Extract Method", "R2": "Introduce Parameter Object", "R3": "Replace with Named Constant", "R4": "Guard Clauses", "R5": "Remove Dead Code"}

#: Code of the smell that a file of pairs, named after it, holds.
CODE_OF_FILE = {name: code for code, name in SMELLS.items()}

# Phrases of commit messages, in order.
KEYWORDS = [
    "extract method", "extract function", "split method", "split function",
    "refactor", "decompose", "break down", "too long", "large method",
    "parameter object", "introduce parameter", "too many params",
    "too many arguments", "reduce params",
    "magic number", "named constant", "replace literal", "extract constant",
    "hardcoded", "magic string",
    "guard clause", "early return", "reduce nesting", "flatten",
    "nested if", "deep nesting", "simplify condition",
    "remove dead code", "dead code", "unused variable", "unreachable",
    "remove unused", "cleanup", "clean up",
]

# Folders without code of the user's.
SKIPPED_FOLDERS = [".git", "__pycache__", ".venv", "venv", ".tox", "node_modules", ".mypy_cache", ".ruff_cache", "build", "dist", ".eggs"]

#: White space at the ends of code and messages.
WHITE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stripped(text: Column | str) -> Column:
    """Without white space of any kind at the ends."""
    return F.btrim(as_column(text), F.lit(WHITE))


def is_blank(text: Column | str) -> Column:
    return F.coalesce(stripped(text) == "", F.lit(True))


def matched_keywords(message: Column | str) -> Column:
    """Phrases that occur in a commit message, in the order of the list."""
    low = F.lower(F.coalesce(as_column(message), F.lit("")))
    return F.filter(F.array(*map(F.lit, KEYWORDS)), lambda k: F.contains(low, k))


def has_keyword(message: Column | str) -> Column:
    """Whether ``matched_keywords`` finds any: one compiled search, as filters also go to tables that are joined by the key that a message is made of."""
    return F.lower(F.coalesce(as_column(message), F.lit(""))).rlike("|".join(KEYWORDS))


def is_test_path(path: Column | str) -> Column:
    """A folder is ``test`` or ``tests``, or the file is named ``test_*`` or ``*_test.py``."""
    return as_column(path).rlike(r"(^|/)tests?/+[^/]") | as_column(path).rlike(r"(^|/)(test_[^/]*|[^/]*_test\.py)/*$")


def mentions_test(path: Column | str) -> Column:
    """The loose form: ``test`` occurs anywhere in the path."""
    return F.contains(F.lower(as_column(path)), F.lit("test"))


def is_bot(login: Column | str) -> Column:
    low = F.lower(F.coalesce(as_column(login), F.lit("")))
    return F.endswith(low, F.lit("[bot]")) | (low == "bot")


def pair_id(repo: Column | str, commit: Column | str, file: Column | str, function: Column | str, smell: Column | str, before: Column | str, after: Column | str) -> Column:
    """Sixteen hexadecimal digits that name a pair; a null part counts as an empty one."""
    parts = [F.coalesce(as_column(c).cast("string"), F.lit("")) for c in (repo, commit, file, function, smell, before, after)]
    return F.left(F.sha1(F.concat_ws("|", *parts).cast("binary")), F.lit(16))


def _lookup(table: dict[str, str], key: Column, otherwise: Column) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), otherwise)


def smell_code(smell: Column | str, strict: bool = True) -> Column:
    """A code or a name as the code; what is neither is an error, or null if not ``strict``."""
    c = as_column(smell)
    known = F.upper(c).isin(*SMELLS)
    bad = F.raise_error(F.concat(F.lit("unknown smell: "), F.coalesce(c, F.lit("null")))).cast("string") if strict else F.lit(None).cast("string")
    return F.when(known, F.upper(c)).otherwise(_lookup({n: code for code, n in SMELLS.items()}, c, bad))


def smell_name(smell: Column | str, strict: bool = True) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for item in SMELLS.items() for x in item]), smell_code(smell, strict))


def shape_distance(a: Column, b: Column) -> Column:
    """Mean over the four sizes of a function's shape of their difference, as a share of the larger."""
    terms = [F.abs(a[f] - b[f]) / F.greatest(a[f], b[f], F.lit(1)) for f in ("n_stmts", "n_params", "depth", "n_returns")]
    return (terms[0] + terms[1] + terms[2] + terms[3]) / 4.0


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Shared part of two arrays taken as sets; 1 if both are empty, null if one is null."""
    a, b = as_column(a), as_column(b)
    union = F.size(F.array_union(a, b))
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def nonblank_lines(code: Column | str) -> Column:
    return F.size(F.filter(F.split(as_column(code), "\n"), lambda line: line.rlike(r"\S")))


def escape_html(text: Column | str) -> Column:
    out = as_column(text)
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(char), F.lit(name))
    return out


def null_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


# Addresses of commits on a public forge, and what catalogues write before a file.
COMMIT_URL = r"^https?://github\.com/([^/]+)/([^/]+)/commit/([0-9a-f]+)"


def commit_url_repo(url: Column | str) -> Column:
    u = stripped(url)
    parts = [F.regexp_extract(u, COMMIT_URL, k) for k in (1, 2)]
    return F.when(u.rlike(COMMIT_URL), F.concat(F.lit("https://github.com/"), parts[0], F.lit("/"), parts[1]))


def commit_url_hash(url: Column | str) -> Column:
    return null_if_empty(F.regexp_extract(stripped(url), COMMIT_URL, 3))


def described_file(description: Column | str) -> Column:
    return null_if_empty(F.regexp_extract(as_column(description), r"Location:\s*(\S+)", 1))


def described_function(description: Column | str) -> Column:
    """The first identifier in double quotes."""
    return null_if_empty(F.regexp_extract(as_column(description), '"([A-Za-z_][A-Za-z0-9_]*)"', 1))


def magnitude(smell: Column, m: Column) -> Column:
    """How grave a smell is, by measures ``m``; null measures count as none."""
    sizes = {"R1": F.coalesce(m["nloc"], m["end_lineno"] - m["lineno"] + 1), "R2": F.size(m["params"]), "R3": F.size(m["magic"]), "R4": m["max_depth"], "R5": F.size(m["dead"])}
    out = F.lit(0)
    for code, size in sizes.items():
        out = F.when(smell == code, F.greatest(F.coalesce(size, F.lit(0)), F.lit(0))).otherwise(out)
    return out
