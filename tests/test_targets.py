"""Fuzzy targets against a comparison of all pairs."""

import random

from codeglint.operators import knowledge as N


def compared(refs, units):
    out = {}
    for ref, target, path in refs:
        best = []
        for unit, name, home in units:
            same = path is not None and path == home
            if target == name:
                best.append((-100 - same, unit))
            elif min(len(target), len(name)) >= 3:
                score = max(5 * (target in name), 3 * (name in target)) + 2 * same
                best += [(-score, unit)] * (score >= 5)
        if best:
            out[ref] = min(best)[1]
    return out


def test_targets_equal_all_pairs(spark):
    draw = random.Random(5)
    word = lambda n: "".join(draw.choice("abc_") for _ in range(n))
    path = lambda: draw.choice(["a", "b", "c", "d", None])
    # a hundred units of one name, asked from everywhere, and names beyond the length that is met as a whole
    units = [(f"u{i:03}", word(draw.randrange(1, 9)), path()) for i in range(120)] + [(f"v{i:03}", "main", "m") for i in range(100)] + [("w1", "x" * 90 + "y", "a"), ("w2", "x" * 99, "b")]
    refs = [(i, word(draw.randrange(1, 7)), path()) for i in range(150)] + [(1000 + i, "main", path()) for i in range(100)]
    refs += [(2000, "x" * 70 + "y", "b"), (2001, "x" * 95, "a"), (2002, "x" * 64, None), (2003, "zzz", "a"), (2004, "main_old", "m"), (2005, "main_old", "a"), (2006, "", "a")]
    got = N.fuzzy_targets(spark.createDataFrame(refs, "ref_id int, target string, path string"), spark.createDataFrame(units, "unit string, name string, path string"))
    assert {r.ref_id: r.unit for r in got.collect()} == compared(refs, units)
