"""Text and code functions as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules
from .scoring import any_regex, contains_any, contains_count, first_match, jaccard, lookup

#: A word in the sense of Unicode letters, digits and the underscore.
WORDS = r"[\p{L}\p{N}_]+"
IDENTIFIER = r"[a-zA-Z_][a-zA-Z0-9_]*"
#: Reserved words, words that weigh more in similarity, and words that a pattern keeps (fixed values).
PYTHON_WORDS = (
    "and", "as", "assert", "break", "class", "continue", "def", "del", "elif", "else", "except", "exec", "finally", "for", "from", "global",
    "if", "import", "in", "is", "lambda", "not", "or", "pass", "print", "raise", "return", "try", "while", "with", "yield", "True", "False", "None",
)
IMPORTANT_WORDS = ("password", "user", "auth", "login", "query", "sql", "database", "input", "output", "validate", "sanitize", "escape", "security")
KEEP_IN_PATTERN = ("if", "else", "for", "while", "def", "class", "return", "import", "function", "var", "let", "const")


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def token_estimate(text: Column) -> Column:
    """Characters / 1.5 for text mostly of Chinese characters, else words * 1.3; truncated."""
    chinese = F.regexp_count(text, F.lit("[\\x{4e00}-\\x{9fff}]"))
    return F.when(chinese > F.length(text) * 0.5, F.floor(F.length(text) / 1.5)).otherwise(F.floor(F.regexp_count(text, F.lit(WORDS)) * 1.3)).cast("long")


def char_chunks(text: Column, size: int = 1000, overlap: int = 200) -> Column:
    """Overlapping chunks; the last ends with the text. Empty text has none."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.length(text) - size) / step)).cast("int"))
    return F.when(F.length(text) > 0, F.transform(starts, lambda i: F.substr(text, i * step + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def truncated(text: Column, limit: int) -> Column:
    """At most limit characters and "..."; cut at a line end that lies in the last 50."""
    head = F.substr(text, F.lit(1), F.lit(limit))
    last = F.lit(limit) - F.locate("\n", F.reverse(head))  # position of the last line end, from 0
    cut = F.when((F.locate("\n", F.reverse(head)) > 0) & (last > 0) & (limit - last < 50), F.substr(head, F.lit(1), last)).otherwise(head)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(cut, F.lit("...")))


def fenced_code(text: Column) -> Column:
    """array<struct<language, code>> of fenced blocks; the language defaults to text."""
    pattern = "(?s)```(\\w*)\\n(.*?)```"
    return F.transform(F.arrays_zip(_all(text, pattern, 1).alias("l"), _all(text, pattern, 2).alias("c")), lambda x: F.struct(F.when(x["l"] == "", "text").otherwise(x["l"]).alias("language"), x["c"].alias("code")))


def safe_filename(name: Column) -> Column:
    clean = F.regexp_replace(name, r'[\\/*?:"<>|]', "_")
    extension, stem = F.element_at(F.split(clean, r"\."), -1), F.regexp_replace(clean, r"\.[^.]*$", "")
    long = F.when(F.contains(clean, F.lit(".")), F.concat(F.substr(stem, F.lit(1), F.lit(190)), F.lit("."), extension)).otherwise(F.substr(clean, F.lit(1), F.lit(200)))
    return F.when(F.length(clean) > 200, long).otherwise(clean)


def provider_of(model: Column) -> Column:
    """Service that a model's name points to."""
    m = F.lower(model)
    starts = {"gpt-": "openai", "text-embedding-": "openai", "deepseek-": "deepseek", "moonshot-": "moonshot", "qwen-": "qwen", "baichuan": "baichuan", "glm-": "zhipu", "chatglm": "zhipu", "mxbai-embed": "ollama_emd"}
    parts = {"gpt4": "openai", "gpt3": "openai", "embedding-bert": "deepseek", "yi-": "01ai", "claude": "anthropic", "llama": "meta", "mxbai": "ollama_emd"}
    local = contains_any(m, ("llama", "mistral", "qwen", "gemma")) & (F.contains(m, F.lit(":")) | m.endswith(".bin") | m.endswith(".gguf"))
    return first_match([*((m.startswith(k), v) for k, v in starts.items()), *((F.contains(m, F.lit(k)), v) for k, v in parts.items()), (local, "ollama")], "openai")


def language_of(extension: Column) -> Column:
    return lookup(F.lower(extension), rules.LANGUAGES, "other")


def without_comments(code: Column, language: Column) -> Column:
    hashes = F.regexp_replace(code, "(?m)#.*$", "")
    slashes = F.regexp_replace(F.regexp_replace(code, "(?m)//.*$", ""), r"(?s)/\*.*?\*/", "")
    dashes = F.regexp_replace(F.regexp_replace(code, "(?m)--.*$", ""), r"(?s)/\*.*?\*/", "")
    lang = F.lower(language)
    return F.when(lang.isin("python", "bash", "shell"), hashes).when(lang.isin("java", "javascript", "c", "cpp", "csharp", "php"), slashes).when(lang == "sql", dashes).otherwise(code)


def normal_code(code: Column, language: Column) -> Column:
    """Without comments, spaces collapsed, literals blanked."""
    bare = F.regexp_replace(F.trim(F.regexp_replace(without_comments(code, language), r"\s+", " ")), "[\"'].*?[\"']", '""')
    return F.regexp_replace(bare, r"\b\d+\b", "0")


def tokens(code: Column) -> Column:
    return F.array_distinct(_all(F.lower(code), WORDS))


def keywords(code: Column) -> Column:
    known = F.array(*[F.lit(w) for w in dict.fromkeys((*rules.PROGRAMMING_WORDS, *rules.SECURITY_WORDS))])
    return F.array_intersect(tokens(code), known)


def code_patterns(code: Column) -> Column:
    """Calls, assignments, conditions and loops of code, as a set."""
    trimmed = lambda a: F.transform(a, lambda x: F.rtrim(x))
    return F.array_distinct(F.concat(trimmed(_all(code, r"\w+\s*\(")), trimmed(_all(code, r"\w+\s*=")), _all(code, r"if\s*\(.*?\)"), _all(code, r"(for|while)\s*\(.*?\)", 1)))


def token_similarity(a: Column, b: Column) -> Column:
    return jaccard(tokens(a), tokens(b), 1.0, 0.0)


def code_similarity(a: Column, b: Column, language: Column, structure: Column) -> Column:
    """Weighted similarity of two codes; structure: the ratio of their shapes, see operators.retrieval.structure_ratio."""
    x, y, w = normal_code(a, language), normal_code(b, language), rules.CODE_SIMILARITY_WEIGHTS
    return (
        token_similarity(x, y) * w["token"] + structure * w["structure"]
        + jaccard(keywords(x), keywords(y), 1.0, 0.0) * w["semantic"] + jaccard(code_patterns(x), code_patterns(y), 1.0, 0.0) * w["pattern"]
    )


def nesting_depth(code: Column) -> Column:
    """Deepest bracket nesting; closing brackets don't go below 0."""
    brackets = F.split(F.regexp_replace(code, r"[^{}()\[\]]", ""), "")
    start = F.struct(F.lit(0).alias("d"), F.lit(0).alias("m"))

    def step(acc: Column, c: Column) -> Column:
        d = F.when(c.isin("{", "(", "["), acc["d"] + 1).when(c.isin("}", ")", "]"), F.greatest(F.lit(0), acc["d"] - 1)).otherwise(acc["d"])
        return F.struct(d.alias("d"), F.greatest(acc["m"], d).alias("m"))

    return F.aggregate(brackets, start, step, lambda a: a["m"])


def complexity(code: Column) -> Column:
    """0.1 a line, 0.5 a control word, 0.2 a call, 0.3 a nesting level; 10 at most."""
    total = F.size(lines(code)) * 0.1 + F.regexp_count(code, F.lit(r"(?i)\b(if|for|while|switch|try)\b")) * 0.5 + F.regexp_count(code, F.lit(r"\w+\s*\(")) * 0.2 + nesting_depth(code) * 0.3
    return F.least(total, F.lit(10.0))


def branch_complexity(code: Column) -> Column:
    """Of JavaScript: 1 and a point for each control word, catch and ternary of a line."""
    count = lambda p: F.regexp_count(code, F.lit(p))
    return 1 + count(r"\b(if|while|for|switch)\b") + count(r"\bcatch\b") + count(r"\?\s*.*\s*:")


def visibility(name: Column) -> Column:
    return first_match(((name.startswith("__") & name.endswith("__"), "special"), (name.startswith("__"), "private"), (name.startswith("_"), "protected")), "public")


def snippet_variables(snippet: Column) -> Column:
    found = F.filter(_all(snippet, IDENTIFIER), lambda x: F.length(x) > 1)
    return F.array_sort(F.array_except(F.array_distinct(found), F.array(*[F.lit(w) for w in PYTHON_WORDS])))


def snippet_keywords(snippet: Column) -> Column:
    """Identifiers, words in string literals and words in comments, in lower case."""
    flat = lambda texts: F.flatten(F.transform(texts, lambda x: _all(F.lower(x), "[a-zA-Z]+")))
    return F.array_sort(F.array_distinct(F.concat(_all(F.lower(snippet), IDENTIFIER), flat(_all(snippet, "[\"']([^\"']*)[\"']", 1)), flat(_all(snippet, r"#\s*(.+)", 1)))))


def keyword_similarity(a: Column, b: Column) -> Column:
    """Jaccard and 0.1 for each important word shared; 1 at most."""
    important = F.array(*[F.lit(w) for w in IMPORTANT_WORDS])
    bonus = F.size(F.array_intersect(F.array_intersect(a, b), important)) * 0.1
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.least(F.lit(1.0), jaccard(a, b) + bonus))


def inferred_type(code: Column) -> Column:
    c = F.lower(code)
    cases = (
        (("sql", "query", "select", "insert", "update", "delete"), "sql injection"), (("<script>", "javascript:", "onerror", "onload"), "xss"),
        (("system", "exec", "shell", "command"), "command injection"), (("../", "..\\", "path", "file"), "path traversal"), (("buffer", "overflow", "strcpy", "strcat"), "buffer overflow"),
    )
    return first_match(((contains_any(c, words), t) for words, t in cases), "general")


def search_terms(finding_type: Column, code: Column) -> Column:
    """Sorted terms that a knowledge search takes: those of the type, and dangerous words of the code."""
    by_type = {
        "sql injection": ("sql", "injection", "database"), "xss": ("cross-site", "scripting", "xss"), "command injection": ("command", "injection", "execution"),
        "path traversal": ("path", "traversal", "directory"), "buffer overflow": ("buffer", "overflow", "memory"),
    }
    none = F.array().cast("array<string>")
    t = first_match(((F.contains(F.lower(finding_type), F.lit(k)), F.array(*[F.lit(x) for x in v])) for k, v in by_type.items()), None)
    return F.array_sort(F.array_union(F.coalesce(t, none), F.filter(F.array(*[F.lit(x) for x in rules.CODE_TOKENS]), lambda x: F.contains(F.lower(code), x))))


def code_to_pattern(snippet: Column) -> Column:
    """A snippet generalised to a regular expression: literals, numbers and names become classes, the rest is quoted; 200 characters at most."""
    marked = F.regexp_replace(F.regexp_replace(snippet, '"[^"]*"', '"\u0001"'), "'[^']*'", "'\u0001'")
    marked = F.regexp_replace(marked, r"\b\d+\b", "\u0002")
    keep = "|".join(KEEP_IN_PATTERN)
    marked = F.regexp_replace(marked, rf"\b(?!(?i:{keep})\b)(?![A-Z_]+\b)\w+\b", "\u0003")
    quoted = F.regexp_replace(marked, r"([()\[\]{}+*?^$|.])", r"\\$1")
    out = F.replace(F.replace(F.replace(quoted, F.lit("\u0001"), F.lit(".*?")), F.lit("\u0002"), F.lit("\\d+")), F.lit("\u0003"), F.lit("\\w+"))
    return F.when(F.length(out) > 200, F.concat(F.substr(out, F.lit(1), F.lit(200)), F.lit(".*"))).otherwise(out)


def mock_analysis(code: Column) -> Column:
    """array<struct<type, severity>> of the offline analyser: eval or exec is high, a password assigned is medium."""
    c = F.lower(code)
    run = F.when(F.contains(c, F.lit("eval(")) | F.contains(c, F.lit("exec(")), F.struct(F.lit("code execution").alias("type"), F.lit("high").alias("severity")))
    word = F.when(F.contains(c, F.lit("password")) & (F.contains(c, F.lit("=")) | F.contains(c, F.lit(":"))), F.struct(F.lit("hardcoded credential").alias("type"), F.lit("medium").alias("severity")))
    return F.array_compact(F.array(run, word))


def error_category(kind: Column, message: Column) -> Column:
    k, m = F.lower(kind), F.lower(message)
    has = lambda c, w: F.contains(c, F.lit(w))
    return first_match(
        ((has(k, "timeout") | has(m, "timeout"), "timeout"), (has(k, "network") | has(k, "connection"), "network"), (has(k, "validation") | has(m, "invalid"), "validation"),
         (has(k, "resource") | has(m, "memory"), "resource"), (has(k, "config"), "configuration")), "unknown",
    )


def error_severity(category: Column) -> Column:
    return lookup(category, {"network": "high", "timeout": "high", "resource": "high", "validation": "medium", "configuration": "medium", "external_service": "medium"}, "low")


def file_group(path: Column, content: Column) -> Column:
    texts = {"path": F.lower(path), "content": F.lower(content)}
    return first_match(((contains_any(texts[where], words), group) for group, where, words in rules.FILE_GROUPS), "low_risk")


def file_risk(path: Column, content: Column, n_units: Column) -> Column:
    """0 to 10 from words, extension, lines and units."""
    c, n = F.lower(content), F.size(lines(content))
    score = 2 * contains_count(c, rules.FILE_HIGH_RISK) + contains_count(c, rules.FILE_MEDIUM_RISK) + contains_any(F.lower(path), (".py", ".js", ".php", ".java")).cast("int")
    score = score + F.when(n > 500, 2).when(n > 200, 1).otherwise(0) + F.when(n_units > 20, 2).when(n_units > 10, 1).otherwise(0)
    return F.least(score, F.lit(10))


#: Kinds of issue that a model's text may name, in English, by pattern (fixed values).
ISSUE_PATTERNS = (
    (r"sql\s+injection", "sql injection"), (r"xss|cross-site scripting", "xss"), (r"csrf", "csrf"), (r"command\s*injection", "command injection"), (r"path\s+traversal", "path traversal"),
    (r"open\s+redirect", "open redirect"), (r"insecure\s+deserialization", "insecure deserialization"), (r"xxe|xml\s+injection", "xml injection"), (r"ssrf", "ssrf"),
    (r"hard-?coded\s*(?:password|credential|secret|api\s+key)", "hardcoded credential"), (r"sensitive\s+data", "information disclosure"),
)


def named_issues(text: Column) -> Column:
    """array<struct<type, description>>: kinds of issue that a text names, each with up to 200 characters behind the first mention."""
    found = [F.struct(F.lit(kind).alias("type"), F.nullif(F.regexp_extract(text, f"(?is)((?:{p}).{{0,200}})", 1), F.lit("")).alias("description")) for p, kind in ISSUE_PATTERNS]
    return F.filter(F.array(*found), lambda x: x["description"].isNotNull())


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def text_property(text: Column, name: str) -> Column:
    """A property's value in a model's text: a list entry, a JSON pair, a quoted pair, or a pair up to the line's end; the first
    of these that is there and at most 100 characters long."""
    patterns = (rf"(?is)- {name}: ?(.*?)(?=\n- |\n\n|\z)", rf'(?is)"{name}":\s*"(.*?)"(?=[,}}\n]|\z)', rf"(?is){name}:\s*['\"]([^'\"]*)['\"](?=[,\n]|\z)", rf"(?i){name}\s*[:=]\s*([^\n]*)")
    values = [F.nullif(_stripped(F.regexp_extract(text, p, 1)), F.lit("")) for p in patterns]
    return F.coalesce(*[F.when(F.length(v) <= 100, v) for v in values])


def text_snippet(text: Column) -> Column:
    """The first piece of code in a text: a fenced block, a code tag, a code quote; over ten characters and with a sign of code."""
    patterns = (r"(?s)```(?:\w+)?\n(.*?)```", r"(?s)<code>(.*?)</code>", r"`([^`\n]+)`")
    values = [_stripped(F.regexp_extract(text, p, 1)) for p in patterns]
    return F.coalesce(*[F.when((F.length(v) > 10) & F.regexp_like(v, F.lit(r"[=(){}\[\];:+*/%-]")), v) for v in values])


def guessed_language(path: Column, code: Column) -> Column:
    """Language by the extension, else by what the code looks like."""
    known = lookup(F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)), rules.LANGUAGES, None)
    seen = first_match(((F.contains(code, F.lit("<?php")), "php"), (F.regexp_like(code, F.lit(r"(?m)^\s*def \w+\(")), "python"), (F.regexp_like(code, F.lit(r"\bpublic (?:static )?class\b")), "java"), (F.regexp_like(code, F.lit(r"\bfunction\b|=>")), "javascript")), "text")
    return F.coalesce(known, seen)


def task_seconds(task_type: Column, n_units: Column, n_lines: Column) -> Column:
    factor = F.when(n_units > 50, F.lit(2.0)).when(n_units > 10, F.lit(1.5)).otherwise(F.lit(1.0)) * F.when(n_lines > 1000, F.lit(1.3)).otherwise(F.lit(1.0))
    return lookup(task_type, rules.TASK_SECONDS, rules.TASK_SECONDS_DEFAULT) * factor


def leading(pattern: str) -> str | None:
    """The characters that every match of a pattern begins with; None if it has no two such."""
    m = re.match(r"(?:[A-Za-z0-9_ =%]|\\[.({])+", pattern)
    if not m or "|" in pattern:
        return None
    run = m[0]
    if re.match(r"[?*{]", pattern[m.end() :]):
        run = re.sub(r"\\?.$", "", run)
    run = run.replace("\\", "")
    return run if len(run) > 1 else None


def matches_any(text: Column, patterns, low: Column | None = None) -> Column:
    """Whether one of the patterns is in the text; those of known first characters are tried only where these are.

    low: the text in lower case, if there is one.
    """
    found = F.regexp_like(text, F.lit(any_regex(patterns)))
    first = [leading(p) for p in patterns]
    if not first or None in first:
        return found
    low = F.lower(text) if low is None else low
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(x.lower())) for x in dict.fromkeys(first)]) & found


def security_flags(code: Column) -> dict[str, Column]:
    """Control flow, error handling and protective patterns of code."""
    c = F.lower(code)
    return {
        "n_conditions": F.regexp_count(c, F.lit(r"\b(if|elif|else|switch|case)\b")), "n_loops": F.regexp_count(c, F.lit(r"\b(for|while)\b")), "n_returns": F.regexp_count(c, F.lit(r"\breturn\b")),
        "has_try": F.regexp_like(c, F.lit(r"\btry\b")), "has_catch": F.regexp_like(c, F.lit(r"\b(except|catch)\b")), "has_finally": F.regexp_like(c, F.lit(r"\bfinally\b")),
        "validates": F.regexp_like(c, F.lit("validate|check|verify")), "escapes": F.regexp_like(c, F.lit("escape|encode|quote")), "authenticates": F.regexp_like(c, F.lit("auth|login|permission")),
        "encrypts": F.regexp_like(c, F.lit("encrypt|hash|crypt")), "sanitizes": F.regexp_like(c, F.lit("sanitize|clean|filter")), "logs": F.regexp_like(c, F.lit("log|audit")),
    }
