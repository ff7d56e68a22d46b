"""Scores as column expressions: CVSS, taint risk, similarity of findings, consensus bands, telemetry."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules


def lookup(key: Column, table: Mapping[str, float | int | str], default=None) -> Column:
    """The table's value for key, or default."""
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def first_match(cases: Iterable[tuple[Column, object]], default=None) -> Column:
    """The value of the first condition that holds."""
    out = F.lit(default)
    for condition, value in reversed(list(cases)):
        out = F.when(condition, F.lit(value) if not isinstance(value, Column) else value).otherwise(out)
    return out


def banded(x: Column, bands: Iterable[tuple[float, str]], default: str) -> Column:
    """The label of the first band whose bound x reaches; bands in falling order."""
    return first_match(((x >= low, label) for low, label in bands), default)


def any_regex(patterns: Iterable[str]) -> str:
    """One alternation, case ignored."""
    return "(?i)" + "|".join(f"(?:{p})" for p in patterns)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def contains_count(text: Column, words: Iterable[str]) -> Column:
    """How many of the words occur in text."""
    total = F.lit(0)
    for w in words:
        total = total + F.contains(text, F.lit(w)).cast("int")
    return total


def contains_any(text: Column, words: Iterable[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


# CVSS -------------------------------------------------------------------------------------------------------------


def cvss_exploitability(m: Mapping[str, Column]) -> Column:
    out = F.lit(8.22)
    for name, weights in rules.CVSS_WEIGHTS.items():
        out = out * (1 - lookup(m[name], weights))
    return out


def cvss_impact(m: Mapping[str, Column]) -> Column:
    """Impact of the vulnerable and the subsequent system: the larger and half the smaller, at most 6."""

    def part(names: str) -> Column:
        weights = [lookup(m[n], rules.CVSS_IMPACT) for n in names.split()]
        return 1 - weights[0] * weights[1] * weights[2]

    v, s = part("vc vi va"), part("sc si sa")
    both = F.greatest(v, s) + 0.5 * F.least(v, s)
    return F.least(F.lit(6.0), F.when((v > 0) & (s > 0), both).otherwise(F.greatest(v, s)) * 6.0)


def cvss_base(m: Mapping[str, Column]) -> Column:
    impact = cvss_impact(m)
    return F.when(impact <= 0, F.lit(0.0)).otherwise(F.round(F.least(F.lit(10.0), cvss_exploitability(m) + impact), 1))


def cvss_threat(base: Column, maturity: Column) -> Column:
    return F.round(base * lookup(maturity, rules.CVSS_MATURITY, 1.0), 1)


def cvss_environmental(base: Column, *requirements: Column) -> Column:
    total = sum((lookup(r, rules.CVSS_REQUIREMENT, 1.0) for r in requirements[1:]), lookup(requirements[0], rules.CVSS_REQUIREMENT, 1.0))
    return F.round(F.least(F.lit(10.0), base * (total / float(len(requirements)))), 1)


def cvss_severity(base: Column) -> Column:
    return first_match(((base == 0, "NONE"), (base.between(0.1, 3.9), "LOW"), (base.between(4.0, 6.9), "MEDIUM"), (base.between(7.0, 8.9), "HIGH"), (base.between(9.0, 10.0), "CRITICAL")), "UNKNOWN")


def cvss_vector(m: Mapping[str, Column], extra: Mapping[str, Column] | None = None) -> Column:
    """CVSS:4.0/AV:../..; optional metrics that are null are left out."""
    parts = [F.lit("CVSS:4.0")] + [F.concat(F.lit(f"{n.upper()}:"), m[n]) for n in rules.CVSS_METRICS]
    parts += [F.concat(F.lit(f"{n.upper()}:"), c) for n, c in (extra or {}).items()]
    return F.concat_ws("/", *parts)


def cvss_template(finding_type: Column) -> Column:
    """The metrics, one letter each in CVSS_METRICS order, of the first template whose key is in the type."""
    t = F.lower(finding_type)
    return first_match(((F.contains(t, F.lit(k)), rules.cvss_letters(v)) for k, v in rules.CVSS_TEMPLATES), rules.cvss_letters(rules.CVSS_DEFAULT))


def cvss_metrics(template: Column) -> dict[str, Column]:
    return {n: F.substring(template, i + 1, 1) for i, n in enumerate(rules.CVSS_METRICS)}


def cvss_v2_severity(score: Column) -> Column:
    return banded(score, ((7.0, "HIGH"), (4.0, "MEDIUM")), "LOW")


# Taint ------------------------------------------------------------------------------------------------------------


def taint_effect(code: Column) -> Column:
    """sanitize, amplify or propagate: what a node's code does to taint; sanitising words come first."""
    c = F.lower(code)
    return first_match(((contains_any(c, rules.SANITIZE_WORDS), "sanitize"), (contains_any(c, rules.AMPLIFY_WORDS), "amplify")), "propagate")


def taint_step(level: Column, effect: Column) -> Column:
    """Rank of the taint level behind a node: sanitised once is sanitised; amplified taint is dangerous."""
    return F.when(effect == "sanitize", F.lit(1)).when((effect == "amplify") & (level == 2), F.lit(3)).otherwise(level)


def taint_start(source_type: Column) -> Column:
    return F.when(source_type == "user_input", F.lit(3)).otherwise(F.lit(2))


def taint_risk(source_type: Column, sink_type: Column, level: Column, path_length: Column, confidence: Column) -> Column:
    """Risk of a path of path_length nodes at a level's rank."""
    base = lookup(source_type, rules.SOURCE_SCORES, rules.SOURCE_DEFAULT) + lookup(sink_type, rules.SINK_SCORES, rules.SINK_DEFAULT)
    multiplier = F.element_at(F.array(*[F.lit(x) for x in rules.TAINT_MULTIPLIERS]), level + 1)
    return F.least(F.lit(1.0), base * multiplier * F.greatest(F.lit(0.3), 1.0 - (path_length - 2) * 0.1) * confidence)


def risk_severity(risk: Column) -> Column:
    return banded(risk, ((0.8, "critical"), (0.6, "high"), (0.4, "medium")), "low")


# Findings ---------------------------------------------------------------------------------------------------------


def severity_rank(severity: Column) -> Column:
    return lookup(F.lower(severity), rules.SEVERITY_RANK, 3)


def severity_similarity(a: Column, b: Column) -> Column:
    return F.when(F.lower(a) == F.lower(b), F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1.0 - F.abs(severity_rank(a) - severity_rank(b)) * 0.25))


def type_similarity(a: Column, b: Column) -> Column:
    x, y, related = F.lower(a), F.lower(b), F.lit(False)
    for base, words in rules.RELATED_TYPES.items():
        related = related | (F.contains(x, F.lit(base)) & contains_any(y, words)) | (F.contains(y, F.lit(base)) & contains_any(x, words))
    return F.when(a == b, F.lit(1.0)).when(related, F.lit(0.7)).otherwise(F.lit(0.0))


def line_similarity(line_a: Column, line_b: Column) -> Column:
    """Of two places in one file."""
    gap = F.abs(line_a - line_b)
    return first_match(((gap == 0, 1.0), (gap <= 5, 0.8), (gap <= 20, 0.6)), 0.4)


def location_similarity(path_a: Column, line_a: Column, path_b: Column, line_b: Column) -> Column:
    name_a, name_b = (F.element_at(F.split(p, "/"), -1) for p in (path_a, path_b))
    stem_a, stem_b = (F.element_at(F.split(n, r"\."), 1) for n in (name_a, name_b))
    return F.when(path_a == path_b, line_similarity(line_a, line_b)).when(name_a == name_b, F.lit(0.3)).when(stem_a == stem_b, F.lit(0.2)).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column, none: float = 0.0, one_none: float = 0.0) -> Column:
    """Of two arrays as sets; none: if both are empty, one_none: if one is."""
    na, nb = F.size(a), F.size(b)
    shared = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    return F.when((na == 0) & (nb == 0), F.lit(none)).when((na == 0) | (nb == 0), F.lit(one_none)).otherwise(shared)


def word_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))


def code_tokens(text: Column) -> Column:
    t = F.lower(text)
    return F.filter(F.array(*[F.lit(x) for x in rules.CODE_TOKENS]), lambda x: F.contains(t, x))


def finding_similarity(a: Mapping[str, Column], b: Mapping[str, Column]) -> Column:
    """Weighted similarity of two findings given as type, path, line, severity, words (of the description) and tokens (of the
    snippet), or description and snippet in place of these two."""
    w = rules.SIMILARITY_WEIGHTS
    words = [x["words"] if "words" in x else word_set(x["description"]) for x in (a, b)]
    tokens = [x["tokens"] if "tokens" in x else code_tokens(x["snippet"]) for x in (a, b)]
    total = (
        type_similarity(a["type"], b["type"]) * w["type"]
        + location_similarity(a["path"], a["line"], b["path"], b["line"]) * w["location"]
        + jaccard(*words) * w["description"]
        + jaccard(*tokens) * w["code_pattern"]
        + severity_similarity(a["severity"], b["severity"]) * w["severity"]
    )
    return clamp(total)


def normal_severity(severity: Column, default: str = "medium") -> Column:
    s = F.lower(severity)
    return F.when(s.isin(*rules.SEVERITY_RANK), s).otherwise(F.lit(default))


def owasp_category(finding_type: Column) -> Column:
    """OWASP category by the type's words, the first that fits; null if none does."""
    t = F.lower(finding_type)
    return first_match((F.contains(t, F.lit(k)), v) for k, v in rules.OWASP_BY_TYPE.items())


def cwe_of(finding_type: Column) -> Column:
    return lookup(finding_type, {k: v["cwe"] for k, v in rules.CROSS_FILE.items()} | {"Cross-File Authorization Bypass": rules.AUTH_BYPASS["cwe"]})


# Telemetry --------------------------------------------------------------------------------------------------------


def audit_risk(event_type: Column, result: Column, security: Column) -> Column:
    return F.least(F.lit(1.0), lookup(event_type, rules.AUDIT_BASE, rules.AUDIT_BASE_DEFAULT) * lookup(result, rules.AUDIT_RESULT, 1.0) * lookup(security, rules.AUDIT_SECURITY, 1.0))


def performance_score(response: Column, error_rate: Column, throughput: Column, memory: Column) -> Column:
    """100 less penalties."""
    lost = (
        first_match(((response > 10, 40.0), (response > 5, 20.0), (response > 1, 10.0)), 0.0)
        + first_match(((error_rate > 0.1, 30.0), (error_rate > 0.05, 15.0), (error_rate > 0.01, 5.0)), 0.0)
        + first_match(((throughput < 1, 20.0), (throughput < 5, 10.0)), 0.0)
        + first_match(((memory > 0.9, 10.0), (memory > 0.8, 5.0)), 0.0)
    )
    return F.greatest(F.lit(0.0), 100.0 - lost)


def alert_level(metric: str, value: Column) -> Column:
    """The highest level whose threshold the value reaches, else null."""
    return first_match(((value >= t, level) for level, t in rules.PERFORMANCE_ALERTS[metric]))


def quality_alert(metric: Column, value: Column) -> Column:
    """The most severe level met; a rate of false positives alarms upwards, the others downwards."""
    cases = []
    for name, levels in rules.QUALITY_ALERTS.items():
        for level, t in levels:
            cases.append(((metric == name) & ((value >= t) if name == "false_positive_rate" else (value <= t)), level))
    return first_match(cases)


def timeliness(seconds: Column) -> Column:
    """1 up to 5 s, then linear over 15, 30 and 60 s, then falling to 0."""
    slopes = F.when(seconds <= 15, 0.8 + 0.2 * (15 - seconds) / 10).when(seconds <= 30, 0.6 + 0.2 * (30 - seconds) / 15).when(seconds <= 60, 0.4 + 0.2 * (60 - seconds) / 30)
    return F.when(seconds <= 5, F.lit(1.0)).otherwise(F.coalesce(slopes, F.greatest(F.lit(0.0), 0.4 - (seconds - 60) / 60)))


def backoff(attempt: Column, base: float, cap: float, strategy: str) -> Column:
    """Seconds before a retry; attempts count from 0, jitter is left to the caller."""
    golden, other = (1 + 5**0.5) / 2, (1 - 5**0.5) / 2
    n = attempt + 1
    delay = {
        "fixed": F.lit(base), "linear": base * n, "exponential": base * F.pow(F.lit(2.0), attempt),
        "fibonacci": base * F.round((F.pow(F.lit(golden), n) - F.pow(F.lit(other), n)) / 5**0.5),
    }[strategy]
    return F.least(F.lit(cap), delay)
