"""Kernels on the cases that decide each rule."""

from __future__ import annotations

import ast
import random
import tracemalloc

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codequarry.functions import kernels


def measured(source: str) -> dict:
    return kernels.measure(source)


def numbers(source: str) -> list[str]:
    return [m["literal"] for m in measured(source)["magic"]]


@pytest.mark.parametrize(
    "source, found",
    [
        ("def f(x):\n    return x * 86400", ["86400"]),
        ("def f(x):\n    return x + 0 + 1 + 2 + 1.0 + True", []),
        ("def f():\n    timeout = 30\n    return timeout", []),
        ("def f():\n    timeout: int = -30\n    return timeout", []),
        ("def f():\n    x = 86400 * 2\n    return x", ["86400"]),
        ("def f(a=30, *, b=-3):\n    return a", []),
        ("def f(a):\n    return a if a > -5 else 0.5", ["0.5", "5"]),
        ("def f(a):\n    a.x = 7\n    a[9] = 7\n    a += 8", ["8", "9"]),
        ("def f():\n    return lambda x=4: x", ["4"]),
        ("def f():\n    return '42', 3j", []),
    ],
)
def test_magic_numbers(source, found):
    assert sorted(numbers(source)) == found


def dead(body: str) -> list[str]:
    source = "def f(p):\n" + "\n".join(f"    {line}" for line in body.split("\n"))
    return [f"{d['type']}:{d['lineno'] - 1}" for d in measured(source)["dead"]]


@pytest.mark.parametrize(
    "body, found",
    [
        ("x = p", ["unused_var:1"]),
        ("x = p\nreturn x", []),
        ("return p\nprint(p)\nprint(p)", ["unreachable:2", "unreachable:3"]),
        ("for i in p:\n    break\n    print(i)", ["unreachable:3"]),
        ("while p:\n    continue\nelse:\n    raise p\n    print(p)", ["unreachable:5"]),
        ("try:\n    pass\nfinally:\n    return p\n    print(p)", ["unreachable:5"]),
        ("p = 1", []),
        ("for i in p:\n    pass", []),
        ("a, b = p\nreturn a", []),
        ("_x = p", []),
        ("x = p\ndel x", []),
        ("x = p\nx += 1", []),
        ("global x\nx = p", []),
        ("if (n := p):\n    pass", []),
        ("x = p\ndef g():\n    return x\nreturn g", []),
        ("x = p\ndef g():\n    x = 1\n    return x\nreturn g", ["unused_var:1"]),
        ("x = p\nreturn [x for x in p]", ["unused_var:1"]),
        ("x = p\nreturn [y for y in p if x]", []),
        ("x = p\nreturn lambda x: x", ["unused_var:1"]),
        ("with p as x:\n    pass", ["unused_var:1"]),
        ("try:\n    pass\nexcept p as e:\n    pass", []),
        ("def g():\n    y = 1\nreturn g", ["unused_var:2"]),
        ("x: int = p", ["unused_var:1"]),
        ("return p if p else 1", []),
    ],
)
def test_dead_code(body, found):
    assert dead(body) == found


@pytest.mark.parametrize(
    "body, depth",
    [
        ("pass", 0),
        ("if p:\n    for x in p:\n        while x:\n            with x:\n                pass", 4),
        ("if p:\n    pass\nelif p:\n    pass\nelif p:\n    pass", 3),
        ("match p:\n    case 1:\n        if p:\n            pass", 1),
        ("def g():\n    if p:\n        try:\n            pass\n        except E:\n            pass", 2),
        ("try:\n    pass\nexcept* E:\n    pass", 0),
    ],
)
def test_nesting(body, depth):
    source = "def f(p):\n" + "\n".join(f"    {line}" for line in body.split("\n"))
    assert measured(source)["max_depth"] == depth


@pytest.mark.parametrize(
    "source, lines, paths",
    [
        ('def f(a):\n    """Doc\n    string."""\n\n    # comment\n    return a', 2, 1),
        ("def f(a):\n    if a and b or c:\n        return 1\n    elif d:\n        return 2\n    return 3", 6, 5),
        ("def f(a):\n    return [x for x in a if x] + [1 if a else 2]", 2, 4),
        ('def f(a):\n    return f"{1 if a else 2} and or"', 2, 1),
        ("def f(a):\n    try:\n        pass\n    except E:\n        pass\n    finally:\n        pass", 7, 3),
        ("def f(a):\n    x = '''one\n    two'''\n    return x", 4, 1),
    ],
)
def test_code_size(source, lines, paths):
    assert kernels.code_size(source) == (lines, paths)


def test_functions_and_methods():
    text = "import x\n\n@d\ndef f(a, /, b, *c, k=1, **e):\n    def inner(): pass\n\nclass C:\n    def m(self, z):\n        return 99\n    class D:\n        def n(self): pass\n\nif x:\n    def hidden(): pass\n"
    out = kernels.functions_of(text)
    assert out["error"] is None
    assert [(f["qualname"], f["params"], f["lineno"], f["parses"]) for f in out["functions"]] == [("f", ["b", "k", "c", "e"], 4, True), ("C.m", ["z"], 8, False)]
    assert out["functions"][1]["source"].startswith("    def m")
    assert kernels.functions_of(text, dedent=True)["functions"][1]["magic"][0]["literal"] == "99"


@pytest.mark.parametrize("text", ["def f(:", "x = \0", "(" * 500, "\tif x:\n y", None, "", "é = 1"])
def test_total(text):
    out = kernels.functions_of(text)
    assert isinstance(out["functions"], list) and (out["error"] is None or not out["functions"])
    kernels.measure(text or "")
    assert kernels.both_sides(text, text)["before"] == kernels.both_sides(text, text)["after"]


def test_code_that_comes_again_under_other_names_is_parsed_once(monkeypatch):
    parsed, whole = [], ast.parse
    monkeypatch.setattr(ast, "parse", lambda x: parsed.append(x) or whole(x))
    texts = ["\n\n".join(f"def {name}_{k}(a, b={k % 3}):\n    once_{k % 3} = a\n    return b\n" for name in ("f", "g")) for k in range(60)]
    found = [kernels.functions_of(t)["functions"] for t in texts]
    assert 0 < len(parsed) < 20
    assert [[(f["name"], f["lineno"], f["dead"][0]["lineno"], f["source"].split("(")[0]) for f in fs] for fs in found] == [[(f"f_{k}", 1, 2, f"def f_{k}"), (f"g_{k}", 6, 2, f"def g_{k}")] for k in range(60)]


@pytest.mark.parametrize(
    "text",
    [
        "@a(\n    1)\ndef f(x):\n    return x\n@b\ndef f(y): return y\n",
        "def if(a):\n    return 1\ndef g(): pass\n",
        "x = '''\ndef f(a):\n    return 3\n'''\ndef g(a): return 4  \n\n",
        "if x:\n    pass\ndef f(): return 1\nelse:\n    pass\n",
        "def f(a):\n  return a\nasync\tdef g(b):\n  return b\nclass C:\n  def m(self): return 12\ndef f(c): return c or 3if c else 4\n",
        "def f():\n    a = 1\x0c\n    return 7\r\ndef g(): return 8\r",
        "def __debug__(a): return a\ndef __a(b): return 5\n",
    ],
)
@pytest.mark.parametrize("dedent", [False, True])
def test_parts_of_a_module_are_those_of_the_whole(monkeypatch, text, dedent):
    found = kernels.functions_of(text, dedent)
    monkeypatch.setattr(kernels, "ODD_LINES", kernels.re.compile(""))
    monkeypatch.setattr(kernels, "plain_size", lambda source: None)
    for kept in (kernels.parse, kernels._definitions, kernels._measured):
        monkeypatch.setattr(kernels, kept.__name__, kept.__wrapped__)
    monkeypatch.setattr(kernels, "unnamed", lambda source: (source, None))
    assert found == kernels.functions_of(text, dedent)


def test_the_last_definition_counts():
    before, after = "def f():\n    return 5\ndef f():\n    return 6\n", "def f():\n    return 5\n"
    sides = kernels.both_sides(before, after)
    assert [f["shadowed"] for f in sides["before"]] == [True, False] and sides["after"][0]["parses"]


def test_functions_that_are_the_same_on_both_sides_are_left_out():
    kept = "def kept(a):\n    return a\n"
    sides = kernels.both_sides(f"{kept}def f():\n    return 5\n", f"def g():\n    return 7\n{kept}def f():\n    return 6\n")
    assert [[f["qualname"] for f in sides[s]] for s in ("before", "after")] == [["f"], ["g", "f"]]
    assert [f["magic"][0]["literal"] for f in sides["after"]] == ["7", "6"]


def test_similarity():
    a = "def f(a):\n    b = a + 1\n    return b"
    assert kernels.tree_similarity(a, a.replace("b", "other")) == 1.0
    assert kernels.tree_similarity(a, "x = 1") is None and kernels.tree_similarity(a, "def f(") is None
    assert 0 < kernels.tree_similarity(a, "def g(x):\n    for y in x:\n        print(y)") < 1


def _naive(one: ast.AST, two: ast.AST) -> int:
    from functools import cache

    def plain(n):
        return type(n).__name__, tuple(map(plain, ast.iter_child_nodes(n)))

    @cache
    def distance(f, g):
        if not f and not g:
            return 0
        if not f:
            return 1 + distance(f, g[:-1] + g[-1][1])
        if not g:
            return 1 + distance(f[:-1] + f[-1][1], g)
        (x, c), (y, d) = f[-1], g[-1]
        return min(1 + distance(f[:-1] + c, g), 1 + distance(f, g[:-1] + d), distance(f[:-1], g[:-1]) + distance(c, d) + (x != y))

    return distance((plain(one),), (plain(two),))


_code = st.recursive(st.sampled_from(["a", "1", "f()", "-b"]), lambda x: st.builds(lambda p, q, t: t.format(p, q), x, x, st.sampled_from(["[{}, {}]", "({} + {})", "f({}, {})", "{}[{}]"])), max_leaves=4)


@settings(max_examples=40, deadline=None)
@given(_code, _code)
def test_tree_distance_is_the_definition(p, q):
    one, two = (ast.parse(f"def f():\n    {x}").body[0] for x in (p, q))
    a, b = kernels.labels_of(one), kernels.labels_of(two)
    assert kernels.tree_distance(a, b) == kernels.tree_distance(b, a) == _naive(one, two)
    assert kernels.tree_distance(a, a) == 0


def _labelled(draw: random.Random, n: int) -> kernels.Labelled:
    kids: dict[int, list[int]] = {k: [] for k in range(n)}
    for k in range(1, n):
        kids[draw.randrange(max(0, k - draw.choice([1, 2, 5, 50])), k)].append(k)
    labels: list[str] = []
    first: list[int] = []

    def go(k: int) -> None:
        begin = len(labels)
        for x in kids[k]:
            go(x)
        labels.append(draw.choice("abc"))
        first.append(begin)

    go(0)
    return labels, first


def _edited(draw: random.Random, tree: kernels.Labelled, n: int) -> kernels.Labelled:
    labels, first = list(tree[0]), list(tree[1])
    for _ in range(n):
        k = draw.randrange(len(labels))
        if draw.random() < 0.5 and 2 < len(labels) != k + 1:
            labels.pop(k), first.pop(k)
            first = [x - (x > k) for x in first]
        else:
            labels[k] = draw.choice("abcd")
    return labels, first


@pytest.mark.parametrize("seed", range(4))
def test_bounded_distance_is_the_whole_recurrence_under_its_bound(monkeypatch, seed):
    monkeypatch.setattr(kernels, "SMALL_TREES", 0)
    draw = random.Random(seed)
    for _ in range(150):
        one = _labelled(draw, draw.randrange(1, 28))
        two = _edited(draw, one, draw.randrange(6)) if draw.random() < 0.5 else _labelled(draw, draw.randrange(1, 28))
        plain = kernels.tree_distance(one, two)
        for most in (0, 1, 2, 3, 5, 9, 17, 60):
            assert kernels.tree_distance_within(one, two, most) == (plain if plain <= most else None)
        assert kernels._distance(one, two) == plain


def _long(lines: int, *inserted: int) -> str:
    draw = random.Random(1)
    forms = ["    x{0} = a + b * {1}", "    g(a, x, {1})", "    y = [a[{1}], b.c]", "    if a > {1}:\n        b = a", "    z = h(x)(y)"]
    code = ["def f(a, b):", "    first = 1", *(draw.choice(forms).format(k % 7, k % 5) for k in range(lines)), "    return a"]
    for k in inserted:
        code.insert(k, "    more = a")
    return "\n".join(code)


def test_bounded_distance_of_ten_thousand_nodes_in_little_memory():
    one, two = (kernels.labels_of(ast.parse(x).body[0]) for x in (_long(900), _long(900, 2, 450, 902).replace("    first = 1", "    first = [1]").replace("return a", "return [a]")))
    assert len(one[0]) > 10_000
    tracemalloc.start()
    try:
        # Four nodes for each line, and a list around each of two values, with the mark of its use.
        assert kernels.tree_distance_within(one, two, 40) == 3 * 5 + 2 * 2
        assert kernels.tree_distance_within(one, two, 10) is None
        assert tracemalloc.get_traced_memory()[1] < 60 << 20
    finally:
        tracemalloc.stop()


def test_similarity_from_a_bound_is_the_similarity():
    one = _long(30)
    for two in (_long(30, 3), _long(30, 3, 9, 14), _long(8), _long(1)):
        exact = kernels.tree_similarity(one, two)
        for least in (0.0, 0.3, 0.7, 0.9, exact, exact + 1e-9):
            assert kernels.tree_similarity_from(one, two, least) == (exact if exact >= least else None)
    assert kernels.tree_similarity_from(one, "x = 1", 0.5) is None


def test_line_changes():
    ops = kernels.line_changes("a\nb\nc", "a\nx\nc\nd")
    assert [(o["tag"], o["i1"], o["i2"], o["j1"], o["j2"]) for o in ops] == [("equal", 0, 1, 0, 1), ("replace", 1, 2, 1, 2), ("equal", 2, 3, 2, 3), ("insert", 3, 3, 3, 4)]


def test_classes_that_differ_by_names_are_parsed_once(monkeypatch):
    code = "class {}(Base):\n    def {}(self, a):\n        return a + 41\n\n    def other(self):\n        return {}\n"
    kernels.functions_of(code.format("A1", "m1", "self"))
    parsed = []
    monkeypatch.setattr(kernels, "parse", lambda text: parsed.append(text) or (None, "parsed again"))
    found = kernels.functions_of(code.format("A2", "m2", "self"))["functions"]
    assert [(f["qualname"], f["name"], f["owner_class"], f["source"].split("(")[0]) for f in found] == [("A2.m2", "m2", "A2", "    def m2"), ("A2.other", "other", "A2", "    def other")]
    assert not parsed


def test_pairs_that_differ_by_names_are_compared_once(monkeypatch):
    before, after = "def {}(a):\n    b = a + 43\n    return b", "@d\ndef {}(a):\n    return a + 43"
    first = kernels.gate(before.format("f"), after.format("f"))
    monkeypatch.setattr(kernels, "parse", None)
    assert kernels.gate(before.format("g"), after.format("g")) == first
    assert first[:2] == (True, True) and 0 < first[2] < 1


def test_identifiers_alone_are_those_of_all_measures():
    for source in ("def f(a, b=c):\n    x = a.b\n    return x", "async def g():\n    return h.i", "class C:\n    def m(self):\n        return self.x", "x = 1", "def f(:", ""):
        assert kernels.identifiers(source) == kernels.measure(source).get("identifiers"), source
    assert kernels.identifiers("def f(a, b=c):\n    x = a.b\n    return x") == ["a", "b", "c", "x"]
