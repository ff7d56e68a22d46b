"""Cross-file findings of groups of files that one task solves, against rounds of joins over the whole."""

import random

import pytest

from codeglint.operators import detect, parsers

BODIES = ("q = request.args", "q = request.args", "cursor.execute(v)", "cursor.execute(v)", "v = escape(v)", "eval(v)", "print(v)", "login(v)", "v = drop(v)", "pass")


def made(seed, groups=5, size=6):
    """Files of a few functions that call their own, or those of files of the same group, imported or not; some names twice."""
    rng, out = random.Random(seed), []
    for g in range(groups):
        for f in range(size):
            lines = [f"import m{g}{rng.randrange(size)}", f"from pkg.m{g}{rng.randrange(size)} import f"]
            for k in range(rng.randrange(2, 6)):
                callee = rng.choice([f"f{g}{f}_{rng.randrange(4)}", f"x.f{g}{rng.randrange(size)}_{rng.randrange(4)}", f"x.f{g}{rng.randrange(size)}_0", "str"])
                lines += [f"def f{g}{f}_{rng.choice((k, 0))}(v):", f"    {rng.choice(BODIES)}", f"    return {callee}(v)"]
            out.append((f"src/m{g}{f}.py", "\n".join(lines) + "\n", "python"))
    return out


@pytest.mark.parametrize("seed, depth", [(1, None), (2, 1), (3, 2)])
def test_groups_equal_the_rounds(spark, monkeypatch, seed, depth):
    files = spark.createDataFrame(made(seed), "path string, content string, language string")
    rows = lambda d: sorted(map(str, d.collect()))
    parsed = parsers.with_facts(files, "units", "edges", columns=parsers.CODE_FACTS)
    want = rows(detect.cross_file_findings(detect.entities(files), parsers.call_edges(parsed), depth))
    assert len({w.split("'")[1] for w in want}) > 2
    rounds, whole = [], detect.cross_file_findings
    monkeypatch.setattr(detect, "cross_file_findings", lambda *a: rounds.append(1) or whole(*a))
    assert rows(detect.audit(files, depth)) == want and not rounds
    # a bound that some groups exceed
    monkeypatch.setattr(detect, "GROUP_ROWS", 12)
    assert rows(detect.audit(files, depth)) == want and rounds


def test_no_files(spark):
    assert detect.audit(spark.createDataFrame([], "path string, content string, language string")).collect() == []
