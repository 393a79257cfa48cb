"""Parsing and measuring Python source: the only per-row Python of the code operators.

Kernels are total functions: what can't be parsed gives an error or nulls as data, never an exception.
"""

from __future__ import annotations

import ast
import hashlib
import io
import keyword
import re
import textwrap
import token
import tokenize
from array import array
from collections import Counter, OrderedDict
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from functools import lru_cache, wraps

import numpy as np

#: Numbers that are never magic, and keywords that add a path.
TRIVIAL = {0, 1, 2}
BRANCHES = {"if", "elif", "for", "while", "and", "or", "except", "finally"}

DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)
SCOPES = (*DEFS, ast.Lambda, ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)
NESTING = (ast.If, ast.For, ast.While, ast.With, ast.Try, ast.AsyncFor, ast.AsyncWith)
JUMPS = (ast.Return, ast.Raise, ast.Break, ast.Continue)

SIZES = (
    "parses boolean, nloc int, ccn int, n_statements int, max_depth int, magic array<struct<value:double,literal:string,lineno:int>>, "
    "dead array<struct<type:string,lineno:int>>, called array<string>"
)
MEASURES = SIZES + ", identifiers array<string>, shape struct<n_stmts:int,n_params:int,depth:int,n_returns:int>, nodes int"
PLACE = "qualname string, name string, owner_class string, ordinal int, shadowed boolean, lineno int, end_lineno int, source string, params array<string>, owner_bases array<string>, "
FUNCTION = PLACE + MEASURES
PARSED = f"error string, functions array<struct<{FUNCTION}>>"
#: Pairs of one name aren't compared by shape or identifiers.
CHANGED = f"error string, before array<struct<{PLACE + SIZES}>>, after array<struct<{PLACE + SIZES}>>"


Kids = dict[ast.AST, list[ast.AST]]


#: Texts of up to so many characters are remembered by a worker, the last used ones: code repeats itself, above all from one commit to the next.
KEPT_CHARS = 4096


def remembered(most: int) -> Callable[[Callable], Callable]:
    """Results of a function of a text (and flags) are kept for the last ``most`` texts that aren't long; nobody may change what it returns."""

    def around(f: Callable) -> Callable:
        kept = lru_cache(most)(f)

        @wraps(f)
        def call(text: str, *flags: bool):
            return kept(text, *flags) if len(text) <= KEPT_CHARS else f(text, *flags)

        return call

    return around


def family(root: ast.AST) -> tuple[list[ast.AST], Kids]:
    """All nodes breadth first, and the children of each; looked up once for all measures."""
    nodes, kids = [root], {}
    for node in nodes:
        kids[node] = found = _kids(node)
        nodes += found
    return nodes, kids


def _kids(node: ast.AST) -> list[ast.AST]:
    kind = node.__class__
    if kind is ast.Name:
        return [node.ctx]
    found: list[ast.AST] = []
    if kind is not ast.Constant:
        for value in [getattr(node, f, None) for f in kind._fields]:
            if value.__class__ is list:
                found += [x for x in value if isinstance(x, ast.AST)]
            elif isinstance(value, ast.AST):
                found.append(value)
    return found


def below(root: ast.AST, kids: Kids) -> list[ast.AST]:
    nodes = [root]
    for node in nodes:
        nodes += kids[node]
    return nodes


@remembered(64)
def parse(text: str) -> tuple[ast.Module | None, str | None]:
    try:
        return ast.parse(text), None
    except SyntaxError as e:
        return None, f"line {e.lineno or 0}: {e.msg}"
    except (ValueError, RecursionError, MemoryError) as e:
        return None, type(e).__name__


def params_of(node: ast.AST) -> list[str]:
    """Names in the order plain, keyword-only, ``*``, ``**``; the receiver and positional-only ones aren't listed."""
    a = node.args
    found = [*a.args, *a.kwonlyargs, *filter(None, (a.vararg, a.kwarg))]
    return [x.arg for x in found if x.arg not in ("self", "cls")]


def n_params(node: ast.AST) -> int:
    a = node.args
    return len(a.posonlyargs) + len(a.args) + len(a.kwonlyargs) + (a.vararg is not None) + (a.kwarg is not None)


#: Characters with which words and lines aren't all that tokens are; digits before a keyword may be a token of their own.
NOT_PLAIN = re.compile(r"""[^\x20-\x7e\n]|["'#\\]|[0-9]\w*(?:if|or|and|while|except|finally)""")
BRANCH = re.compile(rf"\b(?:{'|'.join(sorted(BRANCHES))})\b")


def plain_size(source: str) -> tuple[int, int] | None:
    """``code_size`` of code that parses, or is a part of such, if it has no strings, comments and the like; else None."""
    if NOT_PLAIN.search(source):
        return None
    return sum(not x.isspace() for x in source.split("\n") if x), 1 + len(BRANCH.findall(source))


def code_size(source: str) -> tuple[int | None, int | None]:
    """Lines of code (without blank lines, comments and triple-quoted docstrings) and cyclomatic complexity, from tokens."""
    skip = {token.COMMENT, token.NL, token.NEWLINE, token.INDENT, token.DEDENT, token.ENDMARKER}
    lines, paths, formatted, opening, body = set(), 1, 0, False, False
    try:
        for t in tokenize.generate_tokens(io.StringIO(source).readline):
            formatted += (t.type == token.FSTRING_START) - (t.type == token.FSTRING_END)
            if t.type == token.NAME and not formatted:
                paths += t.string in BRANCHES
                opening = opening or t.string == "def"
            if t.type == token.NEWLINE:
                opening, body = False, opening
            elif t.type not in skip:
                if not (body and t.type == token.STRING and t.string[:3] in ('"""', "'''")):
                    lines.update(range(t.start[0], t.end[0] + 1))
                body = False
    except (tokenize.TokenError, SyntaxError):
        return None, None
    return len(lines), paths


def _number(node: ast.AST | None) -> ast.AST | None:
    """The number that an expression is, under one minus sign at most."""
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
        node = node.operand
    return node if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)) else None


def magic_numbers(nodes: list[ast.AST]) -> list[dict]:
    """Numbers without a name, breadth first; parents come before children, so names are known in time."""
    named, found = set(), []
    for node in nodes:
        kind = node.__class__
        if kind is ast.Constant:
            value = node.value
            if isinstance(value, (int, float)) and value not in TRIVIAL and id(node) not in named:
                found.append({"value": _double(value), "literal": repr(value), "lineno": node.lineno})
        elif kind is ast.Assign or kind is ast.AnnAssign:
            named.add(id(_number(node.value)))
        elif kind in DEFS:
            named.update(id(_number(d)) for d in (*node.args.defaults, *node.args.kw_defaults))
    return found


def _double(value: float) -> float:
    try:
        return float(value)
    except OverflowError:
        return float("inf")


def _within(scope: ast.AST, kids: Kids) -> Iterator[ast.AST]:
    """Nodes of a scope from the first to the last; scopes inside it are leaves."""
    todo = kids[scope][::-1]
    while todo:
        node = todo.pop()
        yield node
        if node.__class__ not in SCOPES and (below := kids[node]):
            todo += below[::-1]


def _names(node: ast.AST) -> set[str]:
    return {x.id for x in ast.walk(node) if isinstance(x, ast.Name)}


def _taken_from_outside(scope: ast.AST, kids: Kids) -> set[str]:
    own = set().union(*(_names(g.target) for g in getattr(scope, "generators", [])))
    read: set[str] = set()
    for node in _within(scope, kids):
        match node:
            case ast.arg(arg=name) | ast.Name(id=name, ctx=ast.Store()):
                own.add(name)
            case ast.arguments():
                own.update(a.arg for a in (node.vararg, node.kwarg) if a)
            case ast.Name(id=name, ctx=ast.Load()):
                read.add(name)
            case _ if isinstance(node, SCOPES):
                read |= _taken_from_outside(node, kids)
    return read - own


def unused_variables(function: ast.AST, kids: Kids) -> list[int]:
    """Lines of first assignments of locals that nothing reads and no idiom explains."""
    first: dict[str, int] = {}
    explained: set[str] = set()
    for node in _within(function, kids):
        kind = node.__class__
        if kind is ast.Name:
            if node.ctx.__class__ is ast.Store:
                first.setdefault(node.id, node.lineno)
            else:
                explained.add(node.id)
        elif kind is ast.arg:
            explained.add(node.arg)
        elif kind is ast.AugAssign or kind is ast.NamedExpr:
            if node.target.__class__ is ast.Name:
                explained.add(node.target.id)
        elif kind is ast.Global or kind is ast.Nonlocal:
            explained.update(node.names)
        elif kind is ast.For or kind is ast.AsyncFor:
            explained |= _names(node.target)
        elif kind is ast.Assign:
            for target in node.targets:
                if isinstance(target, (ast.Tuple, ast.List)):
                    explained |= _names(target)
        elif kind in SCOPES:
            explained |= _taken_from_outside(node, kids)
    return [line for name, line in first.items() if name not in explained and not name.startswith("_")]


#: Fields that may be blocks of statements, by kind of node.
BLOCKS = {k: some for k in vars(ast).values() if isinstance(k, type) and issubclass(k, ast.AST) and (some := [f for f in ("body", "orelse", "finalbody") if f in k._fields])}


def dead_code(nodes: list[ast.AST], kids: Kids) -> list[dict]:
    """Statements behind a jump in their block, then variables that nothing reads."""
    found = []
    for node in nodes:
        for block in [getattr(node, f, None) for f in BLOCKS.get(node.__class__, ())]:
            if isinstance(block, list):
                jump = next((k for k, s in enumerate(block) if isinstance(s, JUMPS)), len(block))
                found += [{"type": "unreachable", "lineno": s.lineno} for s in block[jump + 1 :]]
    for node in nodes:
        if isinstance(node, DEFS):
            found += [{"type": "unused_var", "lineno": line} for line in unused_variables(node, kids)]
    return found


def depth(root: ast.AST, kids: Kids, kinds: tuple | type = ast.AST) -> int:
    """Most nodes of some kinds on a way down from ``root``, itself included if it is of them."""
    deepest, todo = 0, [(root, 0)]
    while todo:
        node, level = todo.pop()
        level += isinstance(node, kinds)
        if level > deepest:
            deepest = level
        if below := kids[node]:
            todo += [(c, level) for c in below]
    return deepest


def called_in(nodes: list[ast.AST]) -> set[str]:
    targets = (n.func for n in nodes if isinstance(n, ast.Call))
    return {t.id if isinstance(t, ast.Name) else t.attr for t in targets if isinstance(t, (ast.Name, ast.Attribute))}


def top_level_function(tree: ast.Module | None) -> ast.AST | None:
    return next((n for n in tree.body if isinstance(n, DEFS)), None) if tree else None


#: A plain function up to its name, and the name.
NAMED = re.compile(r"((?:async +)?def +)([A-Za-z_][A-Za-z0-9_]*)(?= *\()")


def unnamed(source: str) -> tuple[str, str | None]:
    """A function's source with its name taken for another one, which no measure looks at, and its own name; a source that begins otherwise as it is."""
    found = NAMED.match(source)
    if not found or keyword.iskeyword(found[2]) or found[2] == "__debug__":
        return source, None
    return f"{found[1]}_{source[found.end() :]}", found[2]


def measure(source: str) -> dict:
    """Everything that operators ask about a function's source; a source that doesn't parse alone has its size only."""
    return _measured(unnamed(source)[0], False)


def identifiers(source: str) -> list[str] | None:
    """Names and attributes of the first function of a source; none if it doesn't parse or has no function."""
    return _identifiers(unnamed(source)[0])


@remembered(16384)
def _identifiers(source: str) -> list[str] | None:
    top = top_level_function(parse(source)[0])
    if top is None:
        return None
    return _named_in(family(top)[0][1:])


def _named_in(nodes: list[ast.AST]) -> list[str]:
    return sorted({n.id if n.__class__ is ast.Name else n.attr for n in nodes if n.__class__ is ast.Name or n.__class__ is ast.Attribute})


@remembered(16384)
def _measured(source: str, of_module: bool) -> dict:
    """``of_module``: whole lines of a text that parses, so that there are tokens even if they don't parse alone."""
    tree, error = (None, "indented") if of_module and source[:1] in (" ", "\t") else parse(source)
    nloc, ccn = ((not error or of_module) and plain_size(source)) or code_size(source)
    out = {"parses": False, "nloc": nloc, "ccn": ccn, "n_statements": 0}
    if error:
        return out
    nodes, kids = family(tree)
    first = next((n for n in nodes if isinstance(n, DEFS)), None)
    # A function alone is nearly always all that its module has.
    alone = len(tree.body) == 1 and not tree.type_ignores and tree.body[0] is first
    out |= {
        "parses": True,
        "n_statements": sum(isinstance(n, ast.stmt) for n in (nodes if alone else below(first, kids))) - 1 if first else 0,
        "max_depth": depth(first or tree, kids, NESTING),
        "magic": magic_numbers(nodes),
        "dead": dead_code(nodes, kids),
        "called": sorted(called_in(nodes)),
    }
    if (top := top_level_function(tree)) is not None:
        inside = nodes[1:] if alone else below(top, kids)
        out["identifiers"] = _named_in(inside)
        out["shape"] = {"n_stmts": len(top.body), "n_params": n_params(top), "depth": depth(top, kids) - 1, "n_returns": sum(n.__class__ is ast.Return for n in inside)}
        out["nodes"] = len(inside)
    return out


def listed(text: str | None, dedent: bool = False) -> tuple[str | None, list[dict]]:
    """The error of a module, or its top-level functions and the methods of its top-level classes, not yet measured.

    A method's source keeps its indentation, so it doesn't parse alone, unless ``dedent`` is set. ``shadowed``: a later definition
    has the same name.
    """
    error, found = _listed(text, dedent)
    return error, [row for row, _ in found]


def _listed(text: str | None, dedent: bool) -> tuple[str | None, list[tuple[dict, str]]]:
    """``listed``, and with each function what ``_measured`` takes: its source without its name."""
    error, found, last = _in_order(text, dedent)
    return error, [(_placed(k, line, row, last), plain) for k, (line, row, plain) in enumerate(found)]


def _in_order(text: str | None, dedent: bool) -> tuple[str | None, list[tuple[int, dict, str]], dict[str, int]]:
    """The error of a module, or its definitions, methods last, each with the lines before its part and its source without its name; and the place of the last one of each name."""
    error, parts = _in_parts(text or "", dedent)
    if error:
        return error, [], {}
    found = [(line, row, plain) for line, rows in parts for row, plain in rows]
    found.sort(key=lambda x: x[1]["owner_class"] is not None)
    return None, found, {x[1]["qualname"]: k for k, x in enumerate(found)}


def _placed(k: int, line: int, row: dict, last: dict[str, int]) -> dict:
    return {**row, "ordinal": k, "shadowed": last[row["qualname"]] != k, "lineno": row["lineno"] + line, "end_lineno": row["end_lineno"] + line}


#: Where a definition begins that is no part of another, with decorators of a line, and what ends lines for Python's strings or its parser, but not for both.
BEGINS = re.compile(r"\n(?:@.*\n)*(?:async +def|def|class)\b")
ODD_LINES = re.compile("[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")


def _in_parts(text: str, dedent: bool) -> tuple[str | None, list[tuple[int, list[tuple[dict, str]]]]]:
    """The error of a module, or for each part of it the lines before and its definitions, each with its source without its name.

    A module is cut where definitions begin. If every part parses, so does the whole, to the same definitions: each leaves no string, bracket or block open for the next one. Otherwise it is parsed as a whole.
    """
    parts, line = [], 0
    if not ODD_LINES.search(text):
        places = [0, *[m.start() + 1 for m in BEGINS.finditer(text)], len(text)]
        for begin, end in zip(places, places[1:]):
            rows = _part(text[begin:end].rstrip("\n"), dedent)
            if rows is None:
                break
            parts.append((line, rows))
            line += text.count("\n", begin, end)
        else:
            return None, parts
    return (parse(text)[1], []) if (rows := _definitions(text, dedent)) is None else (None, [(0, [(row, unnamed(row["source"])[0]) for row in rows])])


#: A class that begins with a plain method, up to that one's name.
OWNED = re.compile(r"(class +)([A-Za-z_][A-Za-z0-9_]*)((?:\([A-Za-z0-9_., \[\]]*\))?:\n +(?:async +)?def +)([A-Za-z_][A-Za-z0-9_]*)(?= *\()")


def _part_of_class(found: re.Match, dedent: bool) -> list[tuple[dict, str]] | None:
    """``_part`` of a class, found without its name and that of its first method."""
    whole, (_, owner, _, name) = found.string, found.groups()
    plain = not any(keyword.iskeyword(x) or x == "__debug__" for x in (owner, name))
    rows = _definitions(f"{found[1]}_{found[3]}_{whole[found.end() :]}", dedent) if plain else None
    if not rows or any(row["owner_class"] != "_" for row in rows):
        rows = _definitions(whole, dedent)
        return None if rows is None else [(row, unnamed(row["source"])[0]) for row in rows]
    out = []
    for k, row in enumerate(rows):
        own = {"name": name, "source": row["source"].replace(" _", f" {name}", 1)} if k == 0 else {}
        row = row | own | {"owner_class": owner}
        out.append((row | {"qualname": f"{owner}.{row['name']}"}, rows[0]["source"] if k == 0 else unnamed(row["source"])[0]))
    return out


@remembered(8192)
def _part(whole: str, dedent: bool) -> list[tuple[dict, str]] | None:
    """``_definitions`` of a part, found without the name of the one function that it may be, and the source of each without its name."""
    if found := OWNED.match(whole):
        return _part_of_class(found, dedent)
    part, name = unnamed(whole)
    rows = _definitions(part, dedent)
    if rows and name and len(rows) == 1:
        return [(rows[0] | {"qualname": name, "name": name, "source": rows[0]["source"].replace(" _", f" {name}", 1)}, rows[0]["source"])]
    if rows is not None and name:
        rows = _definitions(whole, dedent)
    return None if rows is None else [(row, unnamed(row["source"])[0]) for row in rows]


@remembered(16384)
def _definitions(text: str, dedent: bool) -> list[dict] | None:
    """Functions and methods of a text by itself; none if it doesn't parse."""
    tree, error = parse(text)
    if error:
        return None
    lines = text.splitlines()
    places = [(None, [], n) for n in tree.body]
    places += [(c.name, bases, n) for c in tree.body if isinstance(c, ast.ClassDef) for bases in [list(map(ast.unparse, c.bases))] for n in c.body]
    found = []
    for owner, bases, node in places:
        if not isinstance(node, DEFS):
            continue
        source = "\n".join(lines[node.lineno - 1 : node.end_lineno])
        qualname = f"{owner}.{node.name}" if owner else node.name
        row = {"qualname": qualname, "name": node.name, "owner_class": owner}
        row |= {"lineno": node.lineno, "end_lineno": node.end_lineno, "source": textwrap.dedent(source) if dedent else source, "params": params_of(node), "owner_bases": bases}
        found.append(row)
    return found


def functions_of(text: str | None, dedent: bool = False) -> dict:
    error, found, last = _in_order(text, dedent)
    return {"error": error, "functions": [_placed(k, line, row, last) | _measured(plain, True) for k, (line, row, plain) in enumerate(found)]}


def both_sides(before: str | None, after: str | None, dedent: bool = False) -> dict:
    """Functions of two versions of a file, without those that are the same on both sides."""
    (error, *old), (error_after, *new) = _in_order(before, dedent), _in_order(after, dedent)
    if error or error_after:
        return {"error": error or error_after, "before": [], "after": []}
    kept = [{(name, found[k][1]["source"]) for name, k in last.items()} for found, last in (old, new)]
    same = kept[0] & kept[1]
    sides = [
        [_placed(k, line, row, last) | _measured(plain, True) for k, (line, row, plain) in enumerate(found) if (row["qualname"], row["source"]) not in same]
        for found, last in (old, new)
    ]
    return {"error": None, "before": sides[0], "after": sides[1]}


def syntax_error(code: str | None) -> str | None:
    return parse(code or "")[1]


#: Kinds of a tree's nodes in postorder, and for each the first node of its subtree.
Labelled = tuple[list[str], list[int]]


def labels_of(node: ast.AST) -> Labelled:
    nodes, todo = [], [(node, _kids(node))]
    while todo:  # a node before its children, from the last one to the first: postorder from its end
        at, kids = todo.pop()
        nodes.append((at.__class__.__name__, len(kids)))
        if kids:
            todo += [(c, _kids(c)) for c in kids]
    labels, first, begins = [], [], []
    for k, (label, n) in enumerate(reversed(nodes)):
        if n:
            begin = begins[-n]
            del begins[-n:]
        else:
            begin = k
        labels.append(label)
        first.append(begin)
        begins.append(begin)
    return labels, first


def kinds_of(source: str) -> Counter:
    """Nodes of the first function of a source, by kind."""
    top = _top_labels(unnamed(source)[0])
    return Counter(top[0] if top is not None else ())


@remembered(512)
def _top_labels(source: str) -> Labelled | None:
    top = top_level_function(parse(source)[0])
    return labels_of(top) if top is not None else None


def _children(first: list[int], node: int) -> list[tuple[int, int]]:
    """First and last node (postorder) of each child's subtree."""
    spans, at = [], node - 1
    while at >= first[node]:
        spans.append((first[at], at))
        at = first[at] - 1
    return spans[::-1]


def _equal(one: Labelled, x: tuple[int, int], two: Labelled, y: tuple[int, int]) -> bool:
    (a, la), (b, lb) = one, two
    (i, m), (j, n) = x, y
    return m - i == n - j and a[i : m + 1] == b[j : n + 1] and all(p - i == q - j for p, q in zip(la[i : m + 1], lb[j : n + 1], strict=True))


def _differing(one: Labelled, two: Labelled) -> tuple[Labelled, Labelled]:
    """Smaller trees of the same distance: equal roots, and equal trees at either end of what is below them, add nothing to it."""
    xs, ys = [(0, len(one[0]) - 1)], [(0, len(two[0]) - 1)]
    while True:
        for end in (0, -1):
            while xs and ys and _equal(one, xs[end], two, ys[end]):
                xs.pop(end), ys.pop(end)
        if len(xs) == len(ys) == 1 and one[0][xs[0][1]] == two[0][ys[0][1]]:
            xs, ys = _children(one[1], xs[0][1]), _children(two[1], ys[0][1])
        else:
            break
    out = []
    for (labels, first), spans in ((one, xs), (two, ys)):
        kept, begin = [], []
        for i, m in spans:
            begin += [f - i + len(kept) for f in first[i : m + 1]]
            kept += labels[i : m + 1]
        out.append(([*kept, ""], [*begin, 0]))
    return out[0], out[1]


def _repeated(labels: np.ndarray, first: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """The different subtrees that the recurrence is for, smallest first: the nodes on the leftmost way of each occurrence, and the last node of the first one.

    Code repeats itself, so distances are found once for each pair of different subtrees and written to all their occurrences.
    """
    known: dict[tuple[bytes, bytes], list[int]] = {}
    for start, last in {f: k for k, f in enumerate(first.tolist())}.items():
        known.setdefault((labels[start : last + 1].tobytes(), (first[start : last + 1] - start).tobytes()), []).append(last)
    out = []
    for ends in sorted(known.values(), key=lambda e: e[0] - first[e[0]]):
        start = first[ends[0]]
        way = np.flatnonzero(first[start : ends[0] + 1] == start)
        out.append((first[ends][:, None] + way[None, :], ends[0]))
    return out


def tree_distance(one: Labelled, two: Labelled) -> int:
    """Least insertions, deletions and relabellings of nodes from one ordered tree to another: Zhang and Shasha's recurrence, a numpy row at a time."""
    (a, la), (b, lb) = _differing(one, two)
    if len(a) == 1 or len(b) == 1:
        return len(a) + len(b) - 2
    numbers = {x: k for k, x in enumerate(dict.fromkeys([*a, *b]))}
    an, bn = (np.array([numbers[x] for x in labels]) for labels in (a, b))
    la_, lb_ = np.array(la), np.array(lb)
    trees = np.zeros((len(a), len(b)), np.int64)
    shapes = [_repeated(labels, first) for labels, first in ((an, la_), (bn, lb_))]
    for rows, i in shapes[0]:
        for cols, j in shapes[1]:
            i0, j0 = la[i], lb[j]
            step = np.arange(j - j0 + 2)
            forest = np.zeros((i - i0 + 2, len(step)), np.int64)
            forest[0], forest[:, 0] = step, np.arange(i - i0 + 2)
            whole, back, here = lb_[j0 : j + 1] == j0, lb_[j0 : j + 1] - j0, slice(j0, j + 1)
            found = []
            for x in range(i0, i + 1):
                row, done = forest[x - i0 + 1], trees[x, here]
                best = forest[la_[x] - i0, back] + done
                if la_[x] == i0:
                    best = np.where(whole, forest[x - i0, :-1] + (an[x] != bn[here]), best)
                row[1:] = np.minimum(forest[x - i0, 1:] + 1, best)
                np.add(np.minimum.accumulate(row - step), step, out=row)
                if la_[x] == i0:
                    done[whole] = row[1:][whole]
                    found.append(row[1:][whole])
            if rows.size > len(found) or cols.size > len(found[0]):
                trees[np.ix_(rows.ravel(), cols.ravel())] = np.tile(np.array(found), (len(rows), len(cols)))
    return int(trees[-1, -1])


def _nearest(xs: np.ndarray, ys: np.ndarray) -> tuple[int, int, int]:
    """Of two rising sequences the places of the closest two values, and how far they are apart."""
    right = np.searchsorted(ys, xs).clip(0, len(ys) - 1)
    left = (right - 1).clip(0)
    gaps = np.stack([np.abs(ys[left] - xs), np.abs(ys[right] - xs)])
    side, k = np.unravel_index(gaps.argmin(), gaps.shape)
    return int(k), int((left, right)[side][k]), int(gaps[side, k])


def tree_distance_within(one: Labelled, two: Labelled, most: int) -> int | None:
    """``tree_distance`` if it is at most ``most``, else None, in memory of the nodes times ``most``.

    Edits move a node by at most their number in postorder, so distances of subtrees are kept for a strip of places, and those of forests only in
    a band around their diagonal, which is narrower the further two subtrees are apart. A band that is beyond ``most`` in a whole row ends its forest.
    """
    (a, la), (b, lb) = _differing(one, two)
    n, m = len(a), len(b)
    if abs(n - m) > most or _kinds_apart(a, b) > most:
        return None
    if n == 1 or m == 1:
        return n + m - 2
    if n * m <= SMALL_TREES:
        whole = tree_distance(one, two)
        return whole if whole <= most else None
    numbers = {x: k for k, x in enumerate(dict.fromkeys([*a, *b]))}
    an, bn = (np.array([numbers[x] for x in labels]) for labels in (a, b))
    la_, lb_ = np.array(la), np.array(lb)
    far = most + 1
    wide = 2 * most + 1 >= m
    strip = np.full((n, m if wide else 2 * most + 1), far, np.int16 if far < 16000 else np.int32)
    shapes = [[(rows[np.argsort(rows[:, 0])], end) for rows, end in _repeated(labels, first)] for labels, first in ((an, la_), (bn, lb_))]
    for rows, end in shapes[0]:
        for cols, end2 in shapes[1]:
            r, c, apart = _nearest(rows[:, 0], cols[:, 0])
            if (band := most - apart) < 0:
                continue
            found = _forest(rows[r], cols[c], an, bn, la_, lb_, strip, wide, most, band)
            if found is None:
                if end == n - 1 and end2 == m - 1:
                    return None
                continue
            # Every two occurrences within the strip get what was found; a block of them at a time.
            step = max(1, (1 << 20) // cols.size)
            for at in range(0, len(rows), step):
                some = rows[at : at + step]
                # Only occurrences of the other tree that begin within the strip.
                near = cols[np.searchsorted(cols[:, 0], some[0, 0] - most) : np.searchsorted(cols[:, 0], some[-1, 0] + most, "right")]
                if not len(near):
                    continue
                x, y = some.ravel()[:, None], near.ravel()[None, :]
                place = y - x * (not wide) + most * (not wide)
                inside = (place >= 0) & (place < strip.shape[1])
                values = np.tile(found, (len(some), len(near)))
                strip[np.broadcast_to(x, place.shape)[inside], place[inside]] = values[inside]
    least = int(strip[n - 1, m - 1 if wide else m - n + most])
    return least if least <= most else None


def _forest(way: np.ndarray, way2: np.ndarray, an: np.ndarray, bn: np.ndarray, la: np.ndarray, lb: np.ndarray, strip: np.ndarray, wide: bool, most: int, band: int) -> np.ndarray | None:
    """Distances of the trees on two leftmost ways, above ``band`` as ``most + 1``; None where all are. Row ``x`` of the table has the columns ``x - band .. x + band``, or all if those are more."""
    i0, i, j0, j = int(way[0]), int(way[-1]), int(way2[0]), int(way2[-1])
    s, t, far = i - i0 + 1, j - j0 + 1, most + 1
    slope = int(2 * band < t)
    table = np.full((s + 1, 2 * band + 1 if slope else t + 1), far, strip.dtype)
    zero = band * slope
    table[0, zero : zero + min(t, band) + 1] = np.arange(min(t, band) + 1)
    found = np.full((len(way), len(way2)), far, strip.dtype)
    on_way, back = lb[j0 : j + 1] == j0, lb[j0 : j + 1] - j0
    rank = np.cumsum(on_way) - 1
    way_rows = {int(x): k for k, x in enumerate(way)}
    for dx in range(1, s + 1):
        low, high = max(0, dx - band), min(t, dx + band)
        if low > t:
            break
        before, x = table[dx - 1], i0 + dx - 1
        row = np.full(high - low + 1, far, strip.dtype)
        if low == 0:
            row[0] = dx
        # Taking the node away: the same column in the row before, a place further in its band.
        reach = min(high, dx - 1 + band)
        if reach >= low:
            shift = zero - slope * (dx - 1)
            part = before[low + shift : reach + shift + 1] + 1
            row[: len(part)] = np.minimum(row[: len(part)], part)
        y0 = max(low, 1)
        if y0 <= high:
            ys, rx = np.arange(y0, high + 1), int(la[x]) - i0
            there = _clipped(strip[x], j0 + y0 - 1 + (0 if wide else most - x), len(ys), far)
            place = back[ys - 1] + zero - slope * rx
            fits = (place >= 0) & (place < table.shape[1])
            best = np.where(fits, table[rx, place.clip(0, table.shape[1] - 1)] + there, far)
            if rx == 0:
                # Both nodes have all before them in their trees: put one in place of the other.
                put = before[ys - 1 + zero - slope * (dx - 1)] + (an[x] != bn[j0 + ys - 1])
                best = np.where(on_way[ys - 1], put, best)
            row[y0 - low :] = np.minimum(row[y0 - low :], best)
        step = np.arange(len(row))
        row = np.minimum(np.minimum.accumulate(row - step) + step, far).astype(strip.dtype)
        table[dx, low + zero - slope * dx : high + zero - slope * dx + 1] = row
        if x in way_rows and y0 <= high:
            mine = on_way[ys - 1]
            found[way_rows[x], rank[ys - 1][mine]] = row[y0 - low :][mine]
        if row.min() >= far:
            break
    return found if found.min() < far else None


def _clipped(values: np.ndarray, start: int, n: int, far: int) -> np.ndarray:
    """``n`` values from ``start`` on; ``far`` where there is none."""
    out = np.full(n, far, values.dtype)
    a, b = max(0, start), min(len(values), start + n)
    if a < b:
        out[a - start : b - start] = values[a:b]
    return out


def _kinds_apart(a: list[str], b: list[str]) -> int:
    """Edits that the numbers of nodes of each kind ask for: one changes at most two of them."""
    one, two = Counter(a), Counter(b)
    return -(-((one - two).total() + (two - one).total()) // 2)


#: Up to so many pairs of nodes the whole recurrence is the quicker way; beyond it distances are searched in strips.
SMALL_TREES = 1 << 20


def _distance(one: Labelled, two: Labelled) -> int:
    """``tree_distance`` in memory that follows the nodes times the distance: strips of twice the width until one holds it."""
    most = max(16, abs(len(one[0]) - len(two[0])), _kinds_apart(one[0], two[0]))
    if len(one[0]) * len(two[0]) <= SMALL_TREES:
        return tree_distance(one, two)
    while (found := tree_distance_within(one, two, most)) is None:
        most *= 2
    return found


#: Distances of trees, the last used ones, by a digest of what is compared.
_DISTANCES: OrderedDict[bytes, int | None] = OrderedDict()


def _of_trees(distance: Callable, one: Labelled, two: Labelled, *most: int) -> int | None:
    """``distance`` of two trees, which is found once for pairs of the same shape."""
    told = hashlib.blake2b(f"{distance.__name__} {most} {' '.join(one[0])},{' '.join(two[0])}".encode(), digest_size=16)
    told.update(array("q", one[1] + two[1]).tobytes())
    return _once(_DISTANCES, told.digest(), lambda: distance(one, two, *most))


def _once(known: OrderedDict, key: bytes, make: Callable):
    """What is known by ``key``, or is made now; the last used 65,536 are kept."""
    if key not in known:
        known[key] = make()
        if len(known) > 1 << 16:
            known.popitem(last=False)
    known.move_to_end(key)
    return known[key]


#: Whether two sources parse, and how alike they are, the last used ones by a digest of both without names.
_GATED: OrderedDict[bytes, tuple[bool, bool, float | None]] = OrderedDict()


#: Decorators of a function, a line each.
DECORATED = re.compile(r"(?:@[^\n]*\n)*")


def gate(before: str, after: str) -> tuple[bool, bool, float | None]:
    """Whether each side parses, and if both do the similarity of the first function before to the first one after, which counts without decorators."""
    heads = [DECORATED.match(x)[0] for x in (before, after)]
    one, two = (head + unnamed(x[len(head) :])[0] for head, x in zip(heads, (before, after), strict=True))
    told = hashlib.blake2b(f"{len(one)} {one}{two}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
    return _once(_GATED, told, lambda: _gate(one, two))


def _gate(one: str, two: str) -> tuple[bool, bool, float | None]:
    ok = [syntax_error(x) is None for x in (one, two)]
    if not all(ok):
        return ok[0], ok[1], None
    top = top_level_function(parse(two)[0])
    alone = first_function_source(two) if top is not None and top.decorator_list else None
    return True, True, tree_similarity(one, alone or two)


def tree_similarity(before: str | None, after: str | None) -> float | None:
    """One less the share of nodes that differ between the first functions of two sources; null where there is none."""
    one, two = (_top_labels(unnamed(x or "")[0]) for x in (before, after))
    if one is None or two is None:
        return None
    return max(0.0, 1.0 - _of_trees(_distance, one, two) / max(len(one[0]), len(two[0])))


def tree_similarity_from(before: str | None, after: str | None, least: float) -> float | None:
    """``tree_similarity`` where it is ``least`` or more, else null: only so many edits are looked for."""
    one, two = (_top_labels(unnamed(x or "")[0]) for x in (before, after))
    if one is None or two is None:
        return None
    size = max(len(one[0]), len(two[0]))
    most = min(size, int((1.0 - least) * size) + 1) if least > 0 else 2 * size
    while most >= 0 and least > 0 and 1.0 - most / size < least:
        most -= 1
    if most < 0:
        return None
    found = _of_trees(tree_distance_within, one, two, most)
    return None if found is None else max(0.0, 1.0 - found / size)


def first_function_source(code: str) -> str | None:
    top = top_level_function(parse(code)[0])
    return ast.get_source_segment(code, top) if top is not None else None


def line_changes(before: str | None, after: str | None) -> list[dict]:
    """Runs of lines that were kept, replaced, deleted or inserted."""
    a, b = (before or "").splitlines(), (after or "").splitlines()
    return [dict(zip(("tag", "i1", "i2", "j1", "j2"), op, strict=True)) for op in SequenceMatcher(None, a, b, autojunk=False).get_opcodes()]


PATTERN_INPUT = (
    "parses boolean, functions array<string>, main string, params map<string,array<string>>, n_params map<string,int>, "
    "attributes map<string,array<string>>, called array<string>, names array<string>, literals array<string>, depth int, guards int, lines int"
)


def pattern_input(code: str | None, function_name: str | None) -> dict:
    """What the refactoring patterns compare on each side of a pair; they are decided by column expressions."""
    code = code or ""
    tree, error = parse(code)
    out = {"parses": error is None, "lines": len(code.splitlines())}
    if error:
        return out
    nodes, kids = family(tree)
    by_name = {n.name: n for n in nodes if isinstance(n, DEFS)}
    wanted = [function_name, (function_name or "").rpartition(".")[2]]
    main = next((x for x in wanted if x in by_name), next(iter(by_name), None))
    arguments = {k: [a.arg for a in (*f.args.posonlyargs, *f.args.args, *f.args.kwonlyargs)] for k, f in by_name.items()}
    out |= {"functions": list(by_name), "main": main, "params": arguments, "n_params": {k: n_params(f) for k, f in by_name.items()}}
    out["attributes"] = {k: sorted({n.attr for n in below(f, kids) if isinstance(n, ast.Attribute)}) for k, f in by_name.items()}
    if main is not None:
        inside = below(by_name[main], kids)
        out["called"] = sorted(called_in(inside))
        out["names"] = sorted({n.id for n in inside if isinstance(n, ast.Name)})
        out["literals"] = sorted({_spelling(n.value) for n in inside if isinstance(n, ast.Constant) and isinstance(n.value, (int, float, str))})
        out["depth"] = depth(by_name[main], kids, NESTING)
        out["guards"] = sum(isinstance(n, ast.If) and isinstance(n.body[-1], JUMPS) for n in inside)
    return out


def _spelling(value: object) -> str:
    """Numbers that are equal are spelt alike."""
    if isinstance(value, str):
        return repr(value)
    return repr(int(value)) if value == value and abs(value) != float("inf") and value == int(value) else repr(value)
