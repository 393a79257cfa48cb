"""Whether two functions behave alike on sampled arguments. It runs the code that it is given, so it is off unless asked for.

Each pair runs in a process of its own, without site packages or environment, under limits of time, memory and files, that is killed when its time is up.
"""

from __future__ import annotations

import json
import subprocess
import sys

RESULT = "struct<equivalent boolean, samples int, matching int, one_raised int, different int, error string>"
SECONDS, MEGABYTES = 10, 512

_CHILD = r"""
import ast, hashlib, json, resource, signal, sys
resource.setrlimit(resource.RLIMIT_AS, (%(bytes)d, %(bytes)d))
resource.setrlimit(resource.RLIMIT_CPU, (%(seconds)d, %(seconds)d))
resource.setrlimit(resource.RLIMIT_FSIZE, (0, 0))
resource.setrlimit(resource.RLIMIT_NOFILE, (8, 8))
before, after, samples, seconds = json.loads(sys.stdin.read())

class TimeIsUp(BaseException):
    pass

def ring(*_):
    raise TimeIsUp

def compiled(source):
    try:
        tree = ast.parse(source)
        top = next((n for n in tree.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))), None)
        if top is None:
            return None, 0
        tree.body = [top]
        names = {}
        exec(compile(tree, "pair", "exec"), names)
        return names[top.name], len(top.args.args) + len(top.args.posonlyargs)
    except Exception:
        return None, 0

def value(seed):
    h = hashlib.sha256(seed.encode()).digest()
    kind = h[0] %% 4
    if kind == 0:
        return h[1] %% 201 - 100
    if kind == 1:
        return "".join(chr(97 + b %% 26) for b in h[2 : 2 + h[1] %% 11])
    if kind == 2:
        return [b %% 11 for b in h[2 : 2 + h[1] %% 6]]
    return None

def called(f, args):
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        return f(*args), None
    except TimeIsUp:
        return None, TimeIsUp
    except Exception as e:
        return None, type(e)
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)

signal.signal(signal.SIGALRM, ring)
(f, m), (g, n) = compiled(before), compiled(after)
out = {"equivalent": False, "samples": 0, "matching": 0, "one_raised": 0, "different": 0, "error": None}
if f is None or g is None:
    out["error"] = "a side has no function that compiles"
else:
    arity = max(m, n)
    for k in range(samples if arity else 1):
        seeds = [f"{k}:{j}" for j in range(arity)]
        (x, raised_x), (y, raised_y) = called(f, [value(s) for s in seeds]), called(g, [value(s) for s in seeds])
        out["samples"] += 1
        if (raised_x is None) != (raised_y is None):
            out["one_raised"] += 1
        elif raised_x is raised_y and (raised_x is not None or x == y):
            out["matching"] += 1
        else:
            out["different"] += 1
    out["equivalent"] = out["samples"] > 0 and out["matching"] == out["samples"]
sys.__stdout__.write(json.dumps(out))
"""


def compared(before: str | None, after: str | None, samples: int = 10, seconds: float = 0.5) -> dict:
    """Counts over the samples: whole numbers, short texts, lists and None, the same for every run; alike if all give equal values or errors of one type."""
    child = _CHILD % {"bytes": MEGABYTES << 20, "seconds": SECONDS}
    failed = {"equivalent": False, "samples": 0, "matching": 0, "one_raised": 0, "different": 0}
    try:
        done = subprocess.run([sys.executable, "-I", "-S", "-c", child], input=json.dumps([before or "", after or "", samples, seconds]), capture_output=True, text=True, timeout=SECONDS, env={})
        return json.loads(done.stdout)
    except subprocess.TimeoutExpired:
        return failed | {"error": "time is up"}
    except ValueError:
        return failed | {"error": "the process ended early"}
