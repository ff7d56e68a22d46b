"""Blocks of languages without a parser against a search line by line."""

import random
import re

from codeglint.functions.rules import GENERIC_UNITS
from codeglint.operators.blocks import block_units

GO = "package main\n\nfunc add(a int, b int) int {\n    if a > b {\n        return a;\n    }\n    return b\n}\n\ntype struct Point\n\n  x int;\ny;\n"
C = "struct P {\n  int x;\n};\n  static  int go(int x,\n    int y) {\n    call(x);\n  }\nclass B { };\n"


def searched(path, content):
    """Units by reading on from every line that begins one."""
    lines = re.split(r"\r\n|\r|\n", re.sub(r"(\r\n|\r|\n)\Z", "", content or "")) if content else []
    out = [(path, "file", path.rsplit("/", 1)[-1] if path is not None else None, 1, len(lines))]
    for pattern, kind in GENERIC_UNITS:
        for s, line in enumerate(lines):
            if m := re.search(pattern, line, re.ASCII):
                out.append((path, kind, m[1], s + 1, ended(lines, s) + 1))
    return out


def ended(lines, s):
    indent = lambda x: len(re.match(r"[ \t\n\x0b\f\r]*", x)[0])
    a = b = 0
    for i in range(s, len(lines)):
        x = lines[i]
        if i > s and x.strip(" \t\n\x0b\f\r") and indent(x) <= indent(lines[s]):
            return i - 1
        a, b = a + x.count("(") - x.count(")"), b + x.count("{") - x.count("}")
        if not a and not b and ";" in x:
            return i
    return len(lines) - 1


def held(spark, rows):
    df = spark.createDataFrame([(p, c, "x", 1) for p, c in rows], "path string, content string, _digest string, _at int")
    got = sorted(map(tuple, block_units(df).collect()), key=str)
    assert got == sorted((u for p, c in dict.fromkeys(rows) for u in searched(p, c)), key=str)
    return got


def test_units_and_their_ends(spark):
    got = held(spark, [("a/x.go", GO), ("y.c", C)])
    assert ("a/x.go", "function", "add", 3, 7) in got and ("y.c", "class", "B", 8, 8) in got and ("y.c", "method", "go", 4, 6) in got


def test_empty_null_and_repeated_files(spark):
    got = held(spark, [("e", ""), ("n", None), (None, "def f(\n"), ("r", GO), ("r", GO), ("r", C), ("w", "\r\n \n\n"), ("e2", "\n")])
    assert ("e", "file", "e", 1, 0) in got and (None, "function", "f", 1, 1) in got
    assert block_units(spark.createDataFrame([], "path string, content string")).count() == 0


def test_random_files(spark):
    rng = random.Random(5)
    parts = ["def f(", "class K", "function g (x) {", "  static  t h(", "}", ")", "{", ";", "x = (1", "", "   ", "});", "interface I {", "\tfunc u()", "é;"]
    rows = [(f"r{i}", rng.choice(["\n", "\r\n", "\r"]).join(" " * rng.choice([0, 0, 2, 4, 8]) + rng.choice(parts) for _ in range(rng.randrange(1, 60)))) for i in range(120)]
    assert sum(u[1] != "file" for u in held(spark, rows)) > 500


def test_a_long_file(spark):
    """A block a line, to forty deep; those indented by two or more read as methods too."""
    lines = [" " * (i % 40) + f"def f{i}((" for i in range(4000)]
    got = block_units(spark.createDataFrame([("l", "\n".join(lines))], "path string, content string")).collect()
    assert len(got) == 1 + 4000 + 38 * 100 and {r.end_line for r in got} == set(range(40, 4001, 40))
