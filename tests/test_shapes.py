"""Chunks of files that differ in names' numbers only are parsed once, and give what the whole file's tree gives."""

import ast

from codeglint.operators import parsers as P

CHUNKS = (
    "import m{0}.n{1} as k2", "from a{0} import b{1}", "def f{0}_1(v{1}, *, w3=lambda: {0}) -> T:\n    return self.g{1}(v{1}, x={0})", "class K{0}(B):\n    @staticmethod\n    def h{1}(a): return f{0}_1(h{1})\n    async def _p(self):\n        if a: self.h{1}()",
    "@d{0}\ndef e{1}(): pass", "def r{0}() -> L[{1}]: pass", 'x{0} = """\ndef s{1}(): pass\n"""', "y = (\ndef z{0}(): pass\n)", "v{0} = 0b2", "u{0} = '\\x{1}1'", "é{0} = g(1)", "a{0}(\r)", "z = 0x1{0} + w{1}(1.e5)", "async def q{0}(): await q{0}()",
)


def parsed(path, code):
    tree = P._tree(code)
    units, calls = P.python_units(path, code, tree), P.python_calls(path, code, tree) if tree else []
    return [units, calls, P.python_imports(path, code, tree) if tree else [], P.own_edges(units, calls)]


def test_shapes_equal_the_whole_tree():
    P._shapes.clear()
    for i, a in enumerate(CHUNKS):
        for j, b in enumerate(CHUNKS):
            code = "\n".join((a.format(i, j), "", b.format(j + 20, 3), CHUNKS[2].format(i, 8))) + "\n" * (i % 3)
            got = P.facts_of("p/m1.py", code, "python", ("units", "calls", "imports", "edges"))
            assert [sorted(map(str, x)) for x in got] == [sorted(map(str, x)) for x in parsed("p/m1.py", code)], code
    assert any(P._shapes.values()) and None in P._shapes.values()


def test_a_shape_is_parsed_once(monkeypatch):
    n, parse = [], ast.parse
    monkeypatch.setattr(ast, "parse", lambda *a, **k: n.append(1) or parse(*a, **k))
    P._shapes.clear()
    for i in range(50):
        units, edges = P.facts_of(f"m{i}.py", f"import m{i}\ndef f{i}_1(v):\n    return f{i}_2(v)\ndef f{i}_2(v):\n    return str(v)\n", "python", ("units", "edges"), ids=False)
        assert [u[2:6] for u in units[1:]] == [(f"f{i}_1", "function", 2, 3), (f"f{i}_2", "function", 4, 5)] and edges[0][6] == f"f{i}_2" and units[0][0] is None
    assert len(n) == 3
    # beyond the bound nothing is remembered
    monkeypatch.setattr(P, "SHAPES", 3)
    assert P.python_shaped("a.py", "y1 = g2()\n") is None and len(P._shapes) == 3


def test_lines_without_quotes_and_comments():
    for code in ("function f(a) {\n  if (a) { g(a); }\n}\nconst h = (x) => {\n};\n", "class A {\n  go(x)\n  {\n    return x ? 1 : 2;\n  }\n}\nfunction k();\n}}{\n", "function a() { }} {\n}\n"):
        lines = code.split("\n")
        assert [P._plain_end(lines, n) for n in range(1, len(lines) + 1)] == [P.block_end(lines, n) for n in range(1, len(lines) + 1)]
