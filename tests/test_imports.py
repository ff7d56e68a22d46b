"""Files that import one another, against all pairs of nodes."""

import re

from codeglint.operators import detect, parsers

FILES = (
    ("pkg/db.py", "import os\nimport q.web, x.web\nimport a.web\ndef run(x):\n    return myform(x)\nclass K:\n    def go(self):\n        return web.K.go (self)\n"), ("web.py", "def form(x):\n    return str(x)\ndef form(y):\n    return 2\ndef other():\n    pass\n"),
    ("lib/web.py", "from pkg import db\nfrom pkg.db import run\nclass A:\n    def go(self):\n        return run((1))\n"), ("self.py", "import self\ndef me():\n    me()\n"), ("none.py", None), ("long.py", "import db\nx = '" + "y" * 200_000 + "'\ndef z(): return run(\n1)\n"),
    ("s.js", "import web\nfunction k(a) {\n  return other(a)(go(a));\n}\n"), ("noext", "import db.\ndef n(): return run(1)\n"),
)


def test_import_relations(spark):
    files = spark.createDataFrame([(p, c, "javascript" if p.endswith(".js") else "python") for p, c in FILES], "path string, content string, language string")
    nodes = {(p, u[2]) for p, c in FILES for u in parsers.units_of(p, c or "", "javascript" if p.endswith(".js") else "python") if u[3] in ("function", "method")}
    stem = lambda p: m[1] if (m := re.search(r"([^/]+)\.[^./]+$", p)) else ""
    stems = {p: {x.split(".")[-1] for x in re.findall(r"(?m)^\s*(?:import|from)\s+([\w.]+)", c or "")} for p, c in FILES}
    text = dict(FILES)
    want = sorted({(f"{a}::{m}", f"{b}::{n}") for a, m in nodes for b, n in nodes if a != b and stem(a) in stems[b] and m.split(".")[-1] + "(" in (text[b] or "")})
    got = detect.import_relations(files)
    assert want == sorted(map(tuple, got.collect())) and ("web.py::form", "pkg/db.py::run") in want
    assert want == sorted(map(tuple, detect.import_related(detect.entities(files)).collect()))
    # contents are read where the file is parsed, and only there
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan and "ArrowEval" not in plan
