"""Code units, calls, imports and assignments of source files.

Python is read by its own parser, other languages by line patterns and brackets.  Each file is parsed on its own, in Arrow
batches; a file that can't be parsed gives its whole-file unit only.
"""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored

UNIT = "id string, path string, name string, type string, start_line int, end_line int, parent_id string, params array<string>, returns string, visibility string, is_async boolean, is_static boolean, complexity int"
CALL = "path string, caller string, callee string, type string, confidence double, line int, n_args int, has_kwargs boolean"
FLOW = "path string, scope string, src string, dst string, line int, kind string, sanitized boolean"

SANITIZERS = ("escape", "html.escape", "quote", "shlex.quote", "bleach.clean", "sanitize", "clean", "validate")
# Line patterns by language (fixed values).
JS_FUNCTIONS = (
    r"(?:function\s+)([a-zA-Z0-9_$]+)\s*\(", r"(?:const|let|var)\s+([a-zA-Z0-9_$]+)\s*=\s*function\s*\(",
    r"(?:const|let|var)\s+([a-zA-Z0-9_$]+)\s*=\s*\([^)]*\)\s*=>\s*{", r"([a-zA-Z0-9_$]+)\s*\([^)]*\)\s*{", r"([a-zA-Z0-9_$]+)\s*:\s*function\s*\(",
)
JS_CONTROL = {"if", "for", "while", "switch", "catch", "function", "return"}
JAVA_CLASS = r"(?:public|private|protected)?\s*(?:static)?\s*(?:final)?\s*\bclass\s+([a-zA-Z0-9_]+)"
JAVA_METHOD = r"(?:public|private|protected)\s+(?:static\s+)?(?:final\s+)?(?:[a-zA-Z0-9_<>\[\]]+)\s+([a-zA-Z0-9_]+)\s*\("
_JS_CALL = re.compile(r"(?:([A-Za-z_$][\w$]*)\.)?([A-Za-z_$][\w$]*)\s*\(")
GENERIC = ((r"(?:function|def|func)\s+([a-zA-Z0-9_]+)\s*\(", "function"), (r"(?:class|interface|struct)\s+([a-zA-Z0-9_]+)", "class"))


_SCRIPT_LINES = tuple((k, re.compile(p)) for k, p in (("class", r"\bclass\s+([a-zA-Z0-9_$]+)"), *(("function", p) for p in JS_FUNCTIONS)))
_JAVA_LINES = tuple((k, re.compile(p)) for k, p in (("class", JAVA_CLASS), ("function", JAVA_METHOD)))
_OTHER_LINES = tuple((k, re.compile(p)) for p, k in GENERIC)
#: What a line that begins a unit has in it.
_BRACES = re.compile(r"[{}]")
_HEADS = re.compile(r"\(|class|interface|struct")


def unit_id(path: str, kind: str, name: str, line: int) -> str:
    return hashlib.md5(f"{path}|{kind}|{name}|{line}".encode()).hexdigest()


def _unit(path: str, kind: str, name: str, start: int, end: int, parent: str | None, **more) -> tuple:
    d = {"params": [], "returns": None, "visibility": visibility(name), "is_async": False, "is_static": False, "complexity": 1} | more
    return (unit_id(path, kind, name, start), path, name, kind, start, end, parent, d["params"], d["returns"], d["visibility"], d["is_async"], d["is_static"], d["complexity"])


def visibility(name: str) -> str:
    if name.startswith("__"):
        return "special" if name.endswith("__") else "private"
    return "protected" if name.startswith("_") else "public"


#: Fields that hold no node but names, operators and contexts, which have neither calls nor functions in them; those that hold statements; what counts as a point of complexity.
_PLAIN = {"ctx", "op", "ops", "id", "attr", "arg", "name", "asname", "module", "level", "names", "rest", "kind", "type_comment", "conversion", "simple", "is_async", "n", "s", "tag"}
_BLOCKS = ("body", "orelse", "finalbody", "handlers", "cases")
_POINTS = (ast.If, ast.While, ast.For, ast.Try, ast.ExceptHandler, ast.Lambda)
_fields: dict[type, tuple[str, ...]] = {ast.Constant: (), ast.Lambda: ("args", "body")}


def _parts(node: ast.AST) -> list[ast.AST]:
    """Child nodes in order, but for those of names, operators and contexts."""
    kind = node.__class__
    if (names := _fields.get(kind)) is None:
        names = _fields[kind] = tuple(f for f in kind._fields if f not in _PLAIN or (f == "name" and kind.__name__ == "TypeAlias"))
    out = []
    for f in names:
        v = getattr(node, f, None)
        if v.__class__ is list:
            out += [x for x in v if isinstance(x, ast.AST)]
        elif isinstance(v, ast.AST):
            out.append(v)
    return out


def _statements(node: ast.AST) -> list[ast.AST]:
    """Child nodes that are or hold statements: all that can hold a function or class."""
    out = []
    for f in _BLOCKS:
        v = getattr(node, f, None)
        if v.__class__ is list:
            out += v
    return out


def cyclomatic(node: ast.AST) -> int:
    """1 and a point for each if, loop, try, handler and lambda."""
    return 1 + sum(isinstance(n, _POINTS) for n in ast.walk(node))


def _tree(code: str) -> ast.Module | None:
    try:
        return ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def python_units(path: str, code: str, tree: ast.Module | None = None) -> list[tuple]:
    whole = _unit(path, "file", path.rsplit("/", 1)[-1], 1, code.count("\n") + 1, None)
    out = [whole]
    if tree := tree or _tree(code):
        # only lambdas are points outside of statements
        _visit_units(tree, path, whole[0], None, out, _parts if "lambda" in code else _statements)
    return out


def _visit_units(node: ast.AST, path: str, parent: str, owner: str | None, out: list[tuple], children) -> int:
    """Adds the units in node to out; the points of complexity in it.  No closure, as its cycle would keep the file until garbage is collected."""
    points = 0
    for child in children(node):
        kind = child.__class__
        if kind is ast.FunctionDef or kind is ast.AsyncFunctionDef:
            static = any(isinstance(d, ast.Name) and d.id == "staticmethod" for d in child.decorator_list)
            name, at = f"{owner}.{child.name}" if owner else child.name, len(out)
            more = {"params": [a.arg for a in child.args.args], "returns": ast.unparse(child.returns) if child.returns else None, "visibility": visibility(child.name), "is_async": kind is ast.AsyncFunctionDef, "is_static": static}
            out.append(_unit(path, "method" if owner else "function", name, child.lineno, child.end_lineno, parent, **more))
            inner = _visit_units(child, path, out[at][0], None, out, children)
            out[at] = (*out[at][:-1], 1 + inner)
            points += inner
        elif kind is ast.ClassDef:
            out.append(u := _unit(path, "class", child.name, child.lineno, child.end_lineno, parent))
            points += _visit_units(child, path, u[0], child.name, out, children)
        else:
            points += isinstance(child, _POINTS)
            points += _visit_units(child, path, parent, owner, out, children)
    return points


def block_end(lines: list[str], start: int) -> int:
    """Line (from 1) at which the first bracket opened at or behind `start` closes; quotes and comments don't count."""
    depth, opened, quote, comment = 0, False, "", False
    for n in range(start - 1, len(lines)):
        line, i = lines[n], 0
        while i < len(line):
            c = line[i]
            if comment:
                if line.startswith("*/", i):
                    comment, i = False, i + 1
            elif quote:
                if c == "\\":
                    i += 1
                elif c == quote:
                    quote = ""
            elif line.startswith("//", i):
                break
            elif line.startswith("/*", i):
                comment, i = True, i + 1
            elif c in "\"'`":
                quote = c
            elif c == "{":
                depth, opened = depth + 1, True
            elif c == "}":
                depth -= 1
                if opened and depth <= 0:
                    return n + 1
            i += 1
        if quote in "\"'":
            quote = ""
        if not opened and line.rstrip().endswith(";"):
            return n + 1
    return len(lines)


def _plain_end(lines: list[str], start: int) -> int:
    """block_end() of a file without quotes, comments and escapes."""
    depth = 0
    opened = False
    for n in range(start - 1, len(lines)):
        line = lines[n]
        for c in _BRACES.findall(line):
            if c == "{":
                depth, opened = depth + 1, True
            else:
                depth -= 1
                if opened and depth <= 0:
                    return n + 1
        if not opened and line.rstrip().endswith(";"):
            return n + 1
    return len(lines)


def indent_end(lines: list[str], start: int) -> int:
    """Line (from 1) of the last line that is indented deeper than `start`."""
    own, end = len(lines[start - 1]) - len(lines[start - 1].lstrip()), start
    for n in range(start, len(lines)):
        if lines[n].strip():
            if len(lines[n]) - len(lines[n].lstrip()) <= own:
                break
            end = n + 1
    return end


def line_units(path: str, code: str, language: str) -> list[tuple]:
    """Units of JavaScript, TypeScript, Java and other languages by line; one unit a line and kind."""
    lines = code.split("\n")
    whole = _unit(path, "file", path.rsplit("/", 1)[-1], 1, len(lines), None)
    out, comment = [whole], False
    kinds = _SCRIPT_LINES if language in ("javascript", "typescript") else _JAVA_LINES if language == "java" else _OTHER_LINES
    plain = not re.search(r"[\"'`\\]|//|/\*", code)
    owners: list[tuple[int, int, str, str]] = []
    for n, line in enumerate(lines, 1):
        bare = line.strip()
        if comment or bare.startswith(("//", "*", "/*")):
            comment = (comment or bare.startswith("/*")) and "*/" not in bare
            continue
        if not _HEADS.search(line):
            continue
        for kind, pattern in kinds:
            m = pattern.search(line)
            if not m or m[1] in JS_CONTROL or m[1] == "constructor":
                continue
            owner = next((o for o in reversed(owners) if o[0] < n <= o[1]), None)
            if owner and kind == "function" and m[1].startswith("_") and language in ("javascript", "typescript"):
                break
            braced = "{" in "".join(lines[n - 1 : n + 2])
            end = (_plain_end if plain else block_end)(lines, n) if braced else indent_end(lines, n)
            name = f"{owner[3]}.{m[1]}" if owner and kind == "function" else m[1]
            body = "\n".join(lines[n - 1 : end])
            u = _unit(path, "method" if owner and kind == "function" else kind, name, n, end, owner[2] if owner else whole[0], visibility=visibility(m[1]), complexity=1 + len(re.findall(r"\b(?:if|while|for|switch|catch)\b", body)) + (len(re.findall(r"\?\s*.*\s*:", body)) if "?" in body else 0))
            out.append(u)
            if kind == "class":
                owners.append((n, end, u[0], m[1]))
            break
    return out


def units_of(path: str, code: str, language: str) -> list[tuple]:
    if language == "python":
        return python_units(path, code)
    if language in ("javascript", "typescript", "java", "other", "go", "php", "ruby", "csharp", "cpp", "c"):
        return line_units(path, code, language)
    return [_unit(path, "file", path.rsplit("/", 1)[-1], 1, code.count("\n") + 1, None)]


#: A number in a name, and where a file is cut: at lines that begin a statement of their own.
_NUMBER, _CUT = re.compile(r"(?<=[A-Za-z_])([0-9]+)"), re.compile(r"\n(?=(?:def|class|import|from|async) )")
#: Shapes that a worker remembers, and characters of a chunk that may be one.
SHAPES, SHAPE_CHARS = 4096, 2000
_shapes: dict[tuple[str, ...], tuple[list, list, list] | None] = {}


def _shape(texts: tuple[str, ...]) -> tuple[list, list, list] | None:
    """Units, calls and imports of a chunk whose names' numbers are taken out: strings are formats of the numbers.

    None where the numbers could change more than names: in escapes, number literals, or names beyond ASCII; or a line end that the count of lines misses.
    """
    text = "".join(f"{t}{i}" for i, t in enumerate(texts[:-1])) + texts[-1]
    if len(text) > SHAPE_CHARS or not text.isascii() or re.search(r"[\\\r]", text) or re.search(r"(?<![A-Za-z_0-9])[0-9]+[A-Za-z_]", text) or not (tree := _tree(text)):
        return None
    form = lambda x: x if x is None else re.sub(r"[0-9]+", r"{\g<0>}", x.replace("{", "{{").replace("}", "}}"))
    found: list[tuple] = []
    _visit_units(tree, "", "", None, found, _parts if "lambda" in text else _statements)
    if any(u[8] and re.search("[0-9]", u[8]) for u in found):
        return None
    at = {u[0]: i for i, u in enumerate(found)}
    units = [(form(u[2]), u[3], u[4] - 1, u[5] - 1, at.get(u[6], -1), [form(x) for x in u[7]], *u[8:]) for u in found]
    calls = [(form(c[1]), form(c[2]), *c[3:5], c[5] - 1, *c[6:]) for c in python_calls("", text, tree)]
    return units, calls, [(form(i[1]), form(i[2]), i[3]) for i in python_imports("", text, tree)]


def python_shaped(path: str, code: str, ids: bool = True) -> tuple[list[tuple], list[tuple], list[tuple]] | None:
    """Units, calls and imports by the shapes of a file's chunks, each of which is parsed once; None if the file must be parsed.

    Chunks that parse alone are whole statements, so the file is their sequence; chunks that differ in names' numbers only have the
    same tree but for these.  Without ids, units have neither their own nor their parent's.
    """
    if not _NUMBER.search(code):
        return None
    units = [_unit(path, "file", path.rsplit("/", 1)[-1], 1, code.count("\n") + 1, None)]
    calls, imports, line, whole = [], [], 1, units[0][0]
    if not ids:
        units = [(None, *units[0][1:])]
    for chunk in _CUT.split(code):
        parts = _NUMBER.split(chunk)
        key, numbers = tuple(parts[::2]), parts[1::2]
        made = _shapes.get(key, _shapes)
        if made is _shapes:
            if len(_shapes) >= SHAPES or len(chunk) > SHAPE_CHARS:
                return None
            made = _shapes[key] = _shape(key)
        if made is None:
            return None
        base = len(units)
        for name, kind, start, end, parent, params, *more in made[0]:
            name = name.format(*numbers)
            own, above = (unit_id(path, kind, name, line + start), whole if parent < 0 else units[base + parent][0]) if ids else (None, None)
            units.append((own, path, name, kind, line + start, line + end, above, [x.format(*numbers) for x in params], *more))
        for caller, callee, how, confidence, at, *more in made[1]:
            calls.append((path, caller and caller.format(*numbers), callee.format(*numbers), how, confidence, line + at, *more))
        for module, name, kind in made[2]:
            imports.append((path, module.format(*numbers), name.format(*numbers), kind))
        line += chunk.count("\n") + 1
    return units, calls, imports


def _called(f: ast.expr) -> str | None:
    if isinstance(f, ast.Name):
        return f.id
    if isinstance(f, ast.Attribute):
        return f"{f.value.id}.{f.attr}" if isinstance(f.value, ast.Name) else f.attr
    return None


def python_calls(path: str, code: str, tree: ast.Module | None = None) -> list[tuple]:
    """Calls with the innermost function they are in, and None outside of any."""
    out: list[tuple] = []
    if tree := tree or _tree(code):
        _visit_calls(tree, path, None, None, out)
    return out


def _visit_calls(node: ast.AST, path: str, caller: str | None, owner: str | None, out: list[tuple]) -> None:
    for child in _parts(node):
        kind = child.__class__
        if kind is ast.Name or kind is ast.Constant:
            continue
        if kind is ast.FunctionDef or kind is ast.AsyncFunctionDef:
            _visit_calls(child, path, f"{owner}.{child.name}" if owner else child.name, None, out)
            continue
        if kind is ast.ClassDef:
            _visit_calls(child, path, caller, child.name, out)
            continue
        if kind is ast.Call and (callee := _called(child.func)):
            how = "direct" if isinstance(child.func, ast.Name) else "method" if isinstance(child.func.value, ast.Name) and child.func.value.id == "self" else "indirect"
            out.append((path, caller, callee.removeprefix("self."), how, 0.9 if how == "direct" else 0.8, child.lineno, len(child.args), bool(child.keywords)))
        _visit_calls(child, path, caller, owner, out)


def js_calls(path: str, code: str, language: str, units: list[tuple] | None = None) -> list[tuple]:
    """Calls of JavaScript and TypeScript by line patterns, with the innermost unit around them; definitions are no calls."""
    units = [u for u in (line_units(path, code, language) if units is None else units) if u[3] in ("function", "method")]
    heads = {(u[4], u[2].split(".")[-1]) for u in units}
    out = []
    for n, line in enumerate(code.split("\n"), 1):
        if line.strip().startswith(("//", "*", "/*")):
            continue
        for m in _JS_CALL.finditer(line):
            owner, name = m[1], m[2]
            if name in JS_CONTROL or (not owner and (n, name) in heads):
                continue
            around = max((u for u in units if u[4] <= n <= u[5]), key=lambda u: (u[4], -u[5]), default=None)
            callee = f"{owner}.{name}" if owner and owner != "this" else name
            out.append((path, around[2] if around else None, callee, "method" if owner else "direct", 0.8, n, None, None))
    return out


def python_imports(path: str, code: str, tree: ast.Module | None = None) -> list[tuple]:
    """(path, module, name, kind) of imports: direct or from."""
    out, left = [], [tree] if (tree := tree or _tree(code)) else []
    while left:
        node = left.pop()
        if isinstance(node, ast.Import):
            out += [(path, a.name, a.asname or a.name, "direct") for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            out += [(path, node.module or "", a.name, "from") for a in node.names]
        else:
            left += _statements(node)
    return out


def python_flows(path: str, code: str) -> list[tuple]:
    """Steps of data between variables, qualified by their scope: each name on the right of an assignment flows to its target;
    a step through a sanitising call is marked."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out = []

    def dotted(f: ast.expr) -> str:
        return ast.unparse(f) if isinstance(f, (ast.Name, ast.Attribute)) else ""

    def visit(node: ast.AST, scope: str) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                visit(child, f"{scope}.{child.name}" if scope else child.name)
                continue
            if isinstance(child, ast.Assign):
                clean = any(isinstance(n, ast.Call) and dotted(n.func) in SANITIZERS for n in ast.walk(child.value))
                called = any(isinstance(n, ast.Call) for n in ast.walk(child.value))
                functions = {id(n.func) for n in ast.walk(child.value) if isinstance(n, ast.Call)}
                names = sorted({n.id for n in ast.walk(child.value) if isinstance(n, ast.Name) and id(n) not in functions})
                for target in child.targets:
                    for t in ast.walk(target):
                        if isinstance(t, ast.Name):
                            out.extend((path, scope, f"{scope}::{n}", f"{scope}::{t.id}", child.lineno, "return" if called else "direct", clean) for n in names)
            visit(child, scope)

    visit(tree, "")
    return out


#: Names of calls that taint a variable, and that clean it (fixed values).
TAINT_CALLS = {"input", "raw_input", "request", "form", "args", "json", "params", "cookies", "headers", "open", "read", "readline", "readlines"}
CLEAN_CALLS = {"escape", "quote", "sanitize", "validate", "filter", "html_escape", "url_quote", "sql_escape"}
STATE = "path string, scope string, name string, line int, taint string, kind string, dependencies array<string>, alias string"


def python_states(path: str, code: str) -> list[tuple]:
    """State of each variable behind its assignments: taint, type, the names it depends on, and the name it is an alias of.

    A call of a source taints, one of a sanitiser sanitises; a name passes on its own state; of two operands the worse counts.
    """
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError):
        return []
    order, out = ("safe", "sanitized", "tainted"), []

    def taint(e: ast.expr, known: dict[str, str]) -> str:
        if isinstance(e, ast.Name):
            return known.get(e.id, "safe")
        if isinstance(e, ast.Call) and isinstance(e.func, ast.Name):
            name = e.func.id.lower()
            return "tainted" if name in TAINT_CALLS else "sanitized" if name in CLEAN_CALLS else "safe"
        if isinstance(e, ast.BinOp):
            return max(taint(e.left, known), taint(e.right, known), key=order.index)
        return "safe"

    def kind(e: ast.expr) -> str | None:
        if isinstance(e, ast.Constant):
            return type(e.value).__name__
        if isinstance(e, (ast.List, ast.Dict)):
            return type(e).__name__.lower()
        if isinstance(e, ast.Call) and isinstance(e.func, ast.Name) and e.func.id in ("str", "int", "float", "bool"):
            return e.func.id
        return None

    def visit(node: ast.AST, scope: str, known: dict[str, str]) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                visit(child, f"{scope}.{child.name}" if scope else child.name, {})
                continue
            if isinstance(child, ast.Assign):
                level = taint(child.value, known)
                names = sorted({n.id for n in ast.walk(child.value) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load)})
                for t in (t for target in child.targets for t in ast.walk(target) if isinstance(t, ast.Name)):
                    known[t.id] = level
                    out.append((path, scope, t.id, child.lineno, level, kind(child.value), names, child.value.id if isinstance(child.value, ast.Name) else None))
            visit(child, scope, known)

    visit(tree, "", {})
    return out


def variable_states(files: DataFrame) -> DataFrame:
    return _rows(files, STATE, lambda p, c, _: python_states(p, c), "python")


#: Files whose rows a Python worker holds at once.
HELD = 256
IMPORT = "path string, module string, name string, kind string"
EDGE = "path string, caller string, callee string, type string, confidence double, line int, own string"
#: Kinds of facts of a file, with their rows' schema; edges are calls within units with the unit of the same file that they name.
FACTS = {"units": UNIT, "calls": CALL, "imports": IMPORT, "edges": EDGE}


def _rows(files: DataFrame, schema: str, parse, language: str | None = None) -> DataFrame:
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    types = to_arrow_schema(StructType.fromDDL(schema))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, HELD):
                some = batch.slice(at, HELD)
                rows = [r for p, c, k in zip(*(some.column(i).to_pylist() for i in range(3))) for r in parse(p, c or "", k)]
                yield pa.RecordBatch.from_arrays([pa.array(column, t) for column, t in zip(zip(*rows) if rows else [()] * len(types), types.types)], schema=types)

    f = files if language is None else files.filter(F.col("language") == language)
    return f.select("path", "content", "language").mapInArrow(work, schema)


def facts_of(path: str, code: str, language: str, kinds: tuple[str, ...], ids: bool = True) -> list[list[tuple]]:
    """Rows of each kind that a file has, parsed once; calls are those of Python and JavaScript, imports of Python.

    ids: whether units need their own and their parent's.
    """
    python = language == "python"
    units, calls, imports = python and python_shaped(path, code, ids) or (None, None, None)
    tree = _tree(code) if python and units is None else None
    out = []
    for kind in kinds:
        if kind in ("units", "edges") and units is None:
            units = python_units(path, code, tree) if python else units_of(path, code, language)
        if kind in ("calls", "edges") and calls is None:
            calls = python_calls(path, code, tree) if tree else js_calls(path, code, language, units) if language in ("javascript", "typescript") else []
        if kind == "imports" and imports is None:
            imports = python_imports(path, code, tree) if tree else []
        out.append(units if kind == "units" else calls if kind == "calls" else imports if kind == "imports" else own_edges(units, calls))
    return out


def own_edges(units: list[tuple], calls: list[tuple]) -> list[tuple]:
    """Calls within units, each with the unit of this file that it names: by its whole name, else the first of its last part."""
    named = sorted(u[2] for u in units if u[3] in ("function", "method"))
    own = {n.rsplit(".", 1)[-1]: n for n in reversed(named)}
    whole = set(named)
    return [(*c[:6], c[2] if c[2] in whole else own.get(c[2].rsplit(".", 1)[-1])) for c in calls if c[1] is not None]


def with_facts(files: DataFrame, *kinds: str, columns: dict[str, str] | None = None) -> DataFrame:
    """files with a column for each kind of FACTS: an array of what the file has, so that what concerns one file needs no join.

    columns: of a kind, the schema of the columns wanted, if not all.
    """
    import pyarrow as pa
    from pyspark.sql.functions import ArrowUDFType, arrow_udf
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import ArrayType, StructField, StructType

    schemas, places = [], []
    for k in kinds:
        every = StructType.fromDDL(FACTS[k]).names
        kept = StructType([f for f in StructType.fromDDL((columns or {}).get(k, FACTS[k])).fields if f.name != "path"])
        schemas.append(kept)
        places.append([every.index(n) for n in kept.names])
    types = [to_arrow_type(s) for s in schemas]
    ids = any({"id", "parent_id"} & set(s.names) for s in schemas)

    def facts(batches):
        for path, content, language in batches:
            parts = []
            for at in range(0, len(path), HELD):
                rows = [facts_of(p, c or "", k, kinds, ids) for p, c, k in zip(*(x.slice(at, HELD).to_pylist() for x in (path, content, language)))]
                lists = []
                for i, (t, place) in enumerate(zip(types, places)):
                    ends = [0]
                    for r in rows:
                        ends.append(ends[-1] + len(r[i]))
                    flat = [x for r in rows for x in r[i]]
                    row = pa.StructArray.from_arrays([pa.array([x[j] for x in flat], t.field(n).type) for n, j in enumerate(place)], fields=list(t))
                    lists.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), row))
                parts.append(pa.StructArray.from_arrays(lists, names=list(kinds)))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct([pa.field(k, pa.list_(t)) for k, t in zip(kinds, types)]))

    made = arrow_udf(facts, StructType([StructField(k, ArrayType(s)) for k, s in zip(kinds, schemas)]), ArrowUDFType.SCALAR_ITER)
    f = files.withColumn("_facts", made("path", "content", "language"))
    return f.select(*files.columns, *[F.col(f"_facts.{k}").alias(k) for k in kinds])


def exploded(parsed: DataFrame, kind: str) -> DataFrame:
    """path and the columns of a kind of facts, a row each."""
    return parsed.select("path", F.explode(kind).alias("_fact")).select("path", "_fact.*")


def code_units(files: DataFrame) -> DataFrame:
    """Units of files (path, content, language): the file, classes, functions and methods, each once."""
    return _rows(files, UNIT, units_of)


def calls(files: DataFrame) -> DataFrame:
    """Calls of Python and JavaScript files."""
    return _rows(files.filter(F.col("language").isin("python", "javascript", "typescript")), CALL, lambda p, c, k: python_calls(p, c) if k == "python" else js_calls(p, c, k))


def imports(files: DataFrame) -> DataFrame:
    return _rows(files, IMPORT, lambda p, c, _: python_imports(p, c), "python")


def flows(files: DataFrame) -> DataFrame:
    return _rows(files, FLOW, lambda p, c, _: python_flows(p, c), "python")


def file_dependencies(files: DataFrame, imported: DataFrame) -> DataFrame:
    """(src, dst) of files: a module is the file whose path ends with it, the first by path; modules elsewhere have none."""
    stem = F.regexp_replace(F.regexp_replace("path", r"\.py$", ""), "/", ".")
    named = files.filter(F.col("language") == "python").select(F.col("path").alias("dst"), F.explode(_suffixes(stem)).alias("module"))
    named = named.groupBy("module").agg(F.min("dst").alias("dst"))
    return imported.join(named, "module").filter("path <> dst").select(F.col("path").alias("src"), "dst").distinct()


def _suffixes(dotted):
    parts = F.split(dotted, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def with_code(parsed: DataFrame, kinds: tuple[str, ...] = ("function", "method")) -> DataFrame:
    """path, content, name, type, start_line, end_line and code of each unit of these kinds, from files with their units."""
    unit = lambda u: [u[c].alias(c) for c in ("name", "type", "start_line", "end_line")]
    code = lambda lines, u: F.array_join(F.slice(lines, u["start_line"], u["end_line"] - u["start_line"] + 1), "\n").alias("code")
    # lines are split once a file, as the variable of an outer function
    every = F.transform(F.array(F.split("content", "\n")), lambda lines: F.transform(F.filter("units", lambda u: u["type"].isin(*kinds)), lambda u: F.struct(*unit(u), code(lines, u))))
    return parsed.select("path", "content", F.explode(F.flatten(every)).alias("_unit")).select("path", "content", "_unit.*")


#: What with_code() needs of units, and call_edges() of units and edges.
CODE_FACTS = {"units": "name string, type string, start_line int, end_line int"}
EDGE_FACTS = {"units": "name string, type string"}


def call_edges(files: DataFrame) -> DataFrame:
    """(src, dst, type, line): calls between units named path::unit, one edge a pair.

    files: path, content, language, or a stored table of with_facts() with units and edges, which isn't parsed again.
    A callee resolves to its own file first, then to the first file by path that has such a unit; others stay as they are named.
    What its own file doesn't resolve is looked up once for each name, among units reduced to one for each name, so a name that
    many files have multiplies nothing.
    """
    if not {"units", "edges"} <= set(files.columns):
        files = stored(with_facts(files, "units", "edges", columns=EDGE_FACTS).select("path", "units", "edges"), "parsed")
    made = exploded(files, "edges").withColumn("src", F.concat_ws("::", "path", "caller"))
    names = resolved(files).select("callee", F.concat_ws("::", "to", "unit").alias("elsewhere"))
    own = made.filter("own is not null").withColumn("dst", F.concat_ws("::", "path", "own"))
    other = made.filter("own is null").join(names, "callee", "left").withColumn("dst", F.coalesce("elsewhere", "callee"))
    columns = ("src", "dst", F.when(F.col("src") == F.col("dst"), "recursive").otherwise(F.col("type")).alias("type"), "line", "confidence")
    out = own.select(*columns).unionByName(other.select(*columns))
    return out.groupBy("src", "dst").agg(F.max_by(F.struct("type", "line", "confidence"), "line").alias("e")).select("src", "dst", "e.*")


def resolved(parsed: DataFrame) -> DataFrame:
    """(callee, to, unit): what callees name that their own file doesn't have, the first file by path that does and its unit."""
    short = lambda c: F.element_at(F.split(c, r"\."), -1)
    units = exploded(parsed, "units").filter(F.col("type").isin("function", "method"))
    known = units.select(F.col("path").alias("u_path"), F.col("name").alias("u_name"), short("name").alias("short"))
    first = lambda key, c: known.groupBy(F.col(key).alias(c)).agg(F.min(F.struct("u_path", "u_name")).alias(f"by_{c}"))
    names = exploded(parsed, "edges").filter("own is null").select("callee").distinct().withColumn("short", short("callee"))
    names = names.join(first("u_name", "callee"), "callee", "left").join(first("short", "short"), "short", "left")
    return names.select("callee", F.coalesce("by_callee", "by_short").alias("u")).filter("u is not null").select("callee", F.col("u.u_path").alias("to"), F.col("u.u_name").alias("unit"))


def elsewhere(parsed: DataFrame) -> DataFrame:
    """(path, caller, to, unit): calls that another file's unit answers, of a table of with_facts() with units and edges."""
    made = exploded(parsed, "edges").filter("own is null").select("path", "caller", "callee")
    return made.join(resolved(parsed), "callee").select("path", "caller", "to", "unit")


def enclosing_function(points: DataFrame, units: DataFrame) -> DataFrame:
    """points (path, line and more) with the innermost function or method around them: an equi-join on the file, then the range."""
    u = units.filter(F.col("type").isin("function", "method")).select("path", F.col("name").alias("function"), "start_line", "end_line")
    p = points.withColumn("_p", F.monotonically_increasing_id())
    j = p.join(u, "path", "left").withColumn("_in", F.col("line").between(F.col("start_line"), F.col("end_line")))
    best = F.max_by("function", F.when(F.col("_in"), F.struct(F.col("start_line"), -F.col("end_line"))))
    return p.join(j.groupBy("_p").agg(best.alias("function")), "_p").drop("_p")
