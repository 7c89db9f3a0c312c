import ast
import time

from corpusvitals.operators import modules, scripts
from corpusvitals.operators.scripts import _function_facts

SAMPLE = '''# TODO: Refactor this later
def risky(user):
    if user:
        if user.is_admin:
            if user.is_active:
                pass
            else:
                pass
        elif user.is_guest:
            if user.ok and a and b:
                pass
    return [i for i in x for j in i]

async def outer():
    def inner():
        assert x
    with a as b:
        try:
            pass
        except E:
            y = 1 if z else 2
    return lambda: (p or q)
'''


def direct_complexity(node):
    total = 1
    for child in ast.walk(node):
        if isinstance(child, ast.BoolOp):
            total += len(child.values) - 1
        elif isinstance(child, (ast.If, ast.For, ast.AsyncFor, ast.While, ast.IfExp, ast.ExceptHandler,
                                ast.With, ast.AsyncWith, ast.Assert, ast.comprehension)):
            total += 1
    return total


def test_python_functions_against_the_syntax_tree(files):
    sources = {"a.py": SAMPLE, "b.py": open(modules.__file__).read(), "c.py": open(scripts.__file__).read(), "bad.py": "def ("}
    facts = modules.python_facts(files(sources))
    got = {tuple(r) for r in modules.python_functions(facts).select("path", "name", "line", "end_line", "complexity").collect()}
    expected = {
        (path, n.name, n.lineno, n.end_lineno, direct_complexity(n))
        for path, text in sources.items() if path != "bad.py"
        for n in ast.walk(ast.parse(text)) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))
    }
    assert got == expected


def test_python_unused_imports(files):
    text = "from __future__ import annotations\nimport os.path\nimport sys as s\nfrom a import *\nfrom b import c as d, e\nprint(e)\n"
    facts = modules.python_facts(files({"m.py": text, "p/__init__.py": "import os", "dist/x.py": "import os"}))
    assert {(r.line, r.details) for r in modules.unused_python_imports(facts).collect()} == {
        (2, "os is imported but never used."), (3, "s is imported but never used."), (5, "d is imported but never used."),
    }


def test_long_functions(files):
    body = lambda n: "def f():\n" + "    x = 1\n" * (n - 1)
    tree = {f"f{n}.py": body(n) for n in (80, 81, 159, 160)}
    functions = modules.python_functions(modules.python_facts(files(tree)))
    assert {r.file: r.severity for r in modules.long_functions(functions).collect()} == {
        "f81.py": "MEDIUM", "f159.py": "MEDIUM", "f160.py": "HIGH",
    }


def test_texts_go_to_python_in_batches_of_a_hundred(files):
    tree = files({"a.py": "def f(): pass\n", "b.js": "function g() {}\n", "c.py": ""})
    for functions in (modules.python_functions(modules.python_facts(tree)), scripts.js_functions(tree)):
        plan = functions._jdf.queryExecution().executedPlan().toString()
        # Arrow's batches would grow with the input up to the session's setting
        assert (plan.count("BatchEvalPython"), plan.count("ArrowEvalPython")) == (1, 0)
    assert {r.path: r.parse_status for r in modules.python_facts(tree).collect()} == {"a.py": "parsed", "c.py": None}


def test_js_imports_and_use(files):
    text = "\nimport React, { a, b as c, type D } from 'x';\nimport e from \"y\"\nimport {\n  f,\n  $g\n} from 'z'\nuse(a, f); // e\n"
    tree = files({"m.ts": text, "n.jsx": "import React from 'react'\nexport default () => <div/>\n", "o.css": text})
    got = [(r.path, r.identifier, r.line) for r in scripts.js_imports(tree).collect()]
    assert sorted(got) == sorted(
        [("m.ts", "React", 1), ("m.ts", "a", 1), ("m.ts", "c", 1), ("m.ts", "D", 1), ("m.ts", "e", 3),
         ("m.ts", "f", 4), ("m.ts", "$g", 4), ("n.jsx", "React", 1)]
    )
    unused = {r.details.split()[0] for r in scripts.unused_js_imports(tree).collect()}
    assert unused == {"React", "c", "D", "e", "$g"}


def test_js_string_stripping_survives_long_literals(files):
    row = scripts.js_identifier_counts(files({"a.js": "x = '" + "y\\'" * 200_000 + "'; z()"}))
    assert {(r.identifier, r.n) for r in row.collect()} == {("x", 1), ("z", 1)}


def test_js_function_facts():
    text = """function f({a, b}) {
  if (a ?? b) { g?.(x ? y : z); }
  items.map((i) => {
    if (i) { return 1; }
  });
  const inner = () => { while (a) {} };
  switch (a) { case 1: break; case 2: break; }
}

class K {

  method(a) { // if (no)
    for (;;) { "if (no)"; }
  }
}
const h = async q => {
  catch (e) {}
};
"""
    facts = {(n, line): c for n, line, _, c in _function_facts(text)}
    assert facts == {
        ("f", 1): 1 + 1 + 1 + 1 + 3, ("inner", 6): 2, ("method", 12): 2, ("h", 16): 2,
    }


def test_js_complexity_threshold(files):
    body = lambda n: "function f() {\n" + "if (a) {}\n" * n + "}\n"
    functions = scripts.js_functions(files({f"f{n:02d}.js": body(n) for n in (9, 10, 18, 19)}))
    assert {r.file: r.severity for r in scripts.js_complexity(functions).collect()} == {
        "f10.js": "MEDIUM", "f18.js": "MEDIUM", "f19.js": "HIGH",
    }


def test_js_facts_are_linear():
    shapes = [
        lambda n: "g(" + " " * n, lambda n: "\n" * n, lambda n: "a" * n, lambda n: "/*" * (n // 2), lambda n: '\\"' * (n // 2),
        lambda n: "function f(a) {\n" * (n // 20) + "}" * (n // 20), lambda n: "f(" * (n // 2) + ") {}",
    ]
    for shape in shapes:
        took = []
        for n in (250_000, 1_000_000):
            start = time.perf_counter()
            _function_facts(shape(n))
            took.append(time.perf_counter() - start)
        assert took[1] < 8 * took[0] + 1


def test_import_pattern_reads_blank_lines_once(files):
    start = time.perf_counter()
    rows = scripts.js_imports(files({"a.js": "x\n" + "\n" * 200_000 + "import a from 'b'\n", "b.js": " \n\n import c from 'd'"})).collect()
    assert {(r.path, r.identifier) for r in rows} == {("a.js", "a"), ("b.js", "c")}
    assert time.perf_counter() - start < 60


def test_parse_status(files):
    rows = modules.python_facts(files({"a.py": "x = 1", "b.py": "def (", "c.py": "", "d.py": "(" * 150 + ")" * 150, "e.py": "-" * 100_000 + "1"}))
    found = {r.path: r.parse_status for r in rows.collect()}
    assert (found["a.py"], found["b.py"], found["c.py"], found["d.py"]) == ("parsed", "invalid", None, "parsed")
    assert found["e.py"] in ("invalid", "too deep")
