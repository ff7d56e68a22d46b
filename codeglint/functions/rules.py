"""Rule tables of the audit: fixed values that decide results."""

from __future__ import annotations

#: File extension to language (fixed values); others are "other".
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".tsx": "typescript", ".jsx": "javascript", ".java": "java",
    ".cs": "csharp", ".cpp": "cpp", ".cc": "cpp", ".c": "c", ".h": "c", ".hpp": "cpp", ".go": "go", ".rb": "ruby",
    ".php": "php", ".rs": "rust", ".swift": "swift", ".kt": "kotlin", ".lua": "lua", ".scala": "scala", ".dart": "dart",
    ".sh": "bash", ".bash": "bash", ".ps1": "powershell", ".psm1": "powershell", ".html": "html", ".htm": "html",
    ".css": "css", ".json": "json", ".xml": "xml", ".yml": "yaml", ".yaml": "yaml", ".sql": "sql",
}

# Taint sources and sinks (fixed values).
SOURCE_PATTERNS = {
    "user_input": [r"request\.", r"input\s*\(", r"raw_input\s*\(", r"sys\.argv", r"os\.environ", r"form\.", r"args\.", r"json\.", r"params\.", r"cookies\.", r"headers\."],
    "file_input": [r"open\s*\(", r"read\s*\(", r"readline\s*\(", r"readlines\s*\(", r"file\s*\(", r"csv\.reader", r"json\.load"],
    "network_input": [r"requests\.", r"urllib\.", r"socket\.", r"http\.", r"ftp\.", r"urlopen"],
}
SINK_PATTERNS = {
    "sql_query": [r"execute\s*\(", r"query\s*\(", r"cursor\.", r"SELECT\s+.*FROM", r"INSERT\s+INTO", r"UPDATE\s+.*SET", r"DELETE\s+FROM"],
    "command_exec": [r"os\.system\s*\(", r"subprocess\.", r"eval\s*\(", r"exec\s*\(", r"shell=True", r"popen\s*\("],
    "file_write": [r"write\s*\(", r"writelines\s*\(", r"open\s*\(.*[\"']w", r"open\s*\(.*[\"']a"],
    "template_render": [r"render\s*\(", r"template\.", r"jinja", r"\{% .*%\}", r"\{\{ .*\}\}"],
    "response_output": [r"response\.", r"HttpResponse", r"return.*render", r"print\s*\(", r"write\s*\("],
}
SOURCE_SCORES, SOURCE_DEFAULT = {"user_input": 0.8, "file_input": 0.6, "network_input": 0.7}, 0.5
SINK_SCORES, SINK_DEFAULT = {"sql_query": 0.9, "command_exec": 1.0, "file_write": 0.6, "template_render": 0.7, "response_output": 0.5}, 0.3
HIGH_DANGER_SINKS = ("sql_query", "command_exec")
#: Taint levels by rank, and what each multiplies a risk by.
TAINT_LEVELS = ("safe", "sanitized", "tainted", "dangerous")
TAINT_MULTIPLIERS = (0.0, 0.2, 0.7, 1.0)
SANITIZE_WORDS = ("escape", "sanitize", "clean", "validate", "filter", "quote", "encode", "htmlentities", "htmlspecialchars", "strip_tags", "bleach", "purify")
AMPLIFY_WORDS = ("eval", "exec", "compile", "format", "template")

# Cross-file detectors: patterns of the sink, of protection on the way, severity, confidence, CWE, OWASP (fixed values).
INPUT_PATTERNS = [r"request\.", r"input\s*\(", r"raw_input\s*\(", r"argv", r"environ", r"form\.", r"args\.", r"json\.", r"params\."]
CROSS_FILE = {
    "Cross-File SQL Injection": dict(
        sink=[r"execute\s*\(", r"query\s*\(", r"cursor\.", r"sql\s*=", r"SELECT\s+.*FROM", r"INSERT\s+INTO", r"UPDATE\s+.*SET", r"DELETE\s+FROM"],
        protection=["escape", "quote", "parameterized", "prepared", "bind", "placeholder"], severity="HIGH", confidence=0.8, cwe="CWE-89", owasp="A03:2021",
    ),
    "Cross-File XSS": dict(
        sink=["render", "response", "write", "print", r"return.*html", "template"],
        protection=["escape", "encode", "htmlentities", "htmlspecialchars", "sanitize", "safe"], severity="HIGH", confidence=0.7, cwe="CWE-79", owasp="A03:2021",
    ),
    "Cross-File Command Injection": dict(
        sink=[r"os\.system\s*\(", r"subprocess\.", r"eval\s*\(", r"exec\s*\(", r"shell=True"],
        protection=["escape", "quote", "sanitize", "validate", "whitelist", "shlex"], severity="CRITICAL", confidence=0.9, cwe="CWE-78", owasp="A03:2021",
    ),
    "Cross-File Path Traversal": dict(
        sink=[r"open\s*\(", r"file\s*\(", r"os\.path\.", r"pathlib\."],
        protection=["realpath", "abspath", "normpath", "validate", "whitelist", "basename", "secure_filename"], severity="MEDIUM", confidence=0.6, cwe="CWE-22", owasp="A01:2021",
    ),
}
SENSITIVE_PATTERNS = ["delete", "admin", "payment", "transfer", "sensitive", "critical", "remove", "drop"]
AUTH_PATTERNS = ["login", "authenticate", "check_permission", "authorize", "verify", "token", "session"]
AUTH_BYPASS = dict(severity="CRITICAL", confidence=0.6, cwe="CWE-285", owasp="A01:2021")

#: Type to OWASP category, in order (fixed values).
OWASP_BY_TYPE = {
    "sql injection": "A03:2021 – Injection", "xss": "A07:2021 – Cross-Site Scripting", "command injection": "A03:2021 – Injection",
    "path traversal": "A01:2021 – Broken Access Control", "buffer overflow": "A06:2021 – Vulnerable and Outdated Components",
}
#: Pair of source and sink to finding type; others are "Data Flow Vulnerability" (fixed values).
FLOW_TYPES = {
    ("user_input", "sql_query"): "SQL Injection", ("user_input", "command_exec"): "Command Injection", ("user_input", "template_render"): "XSS",
    ("user_input", "file_write"): "Path Traversal", ("file_input", "command_exec"): "Code Injection", ("file_input", "response_output"): "Information Disclosure",
    ("network_input", "file_write"): "Remote File Write", ("network_input", "command_exec"): "Remote Code Execution",
}

# False-positive rules in order: name, patterns, confidence (fixed values).
FALSE_POSITIVE_RULES = (
    ("test_file_rule", [r"test[s]?[/\\]", r"[/\\]test[s]?[/\\]", r"\.test\.", r"_test\.", r"spec[s]?[/\\]", r"[/\\]spec[s]?[/\\]", r"\.spec\.", r"_spec\.", r"mock[s]?[/\\]", r"fixture[s]?[/\\]"], 0.9),
    ("example_code_rule", [r"example[s]?[/\\]", r"[/\\]example[s]?[/\\]", r"demo[s]?[/\\]", r"[/\\]demo[s]?[/\\]", r"sample[s]?[/\\]", r"tutorial[s]?[/\\]", r"playground[/\\]", r"\.example\.", r"_example\.", r"\.demo\.", r"_demo\."], 0.85),
    ("comment_rule", [r"^\s*//.*", r"^\s*#.*", r"^\s*/\*.*\*/", r"^\s*<!--.*-->", r"^\s*\*.*", r'^\s*""".*"""', r"^\s*'''.*'''"], 0.95),
    ("documentation_rule", [r"doc[s]?[/\\]", r"[/\\]doc[s]?[/\\]", r"readme", r"\.md$", r"\.rst$", r"\.txt$", r"changelog", r"license"], 0.8),
    ("placeholder_rule", [r"<placeholder>", r"\{\{.*\}\}", r"\$\{.*\}", r"example\.com", r"localhost", r"127\.0\.0\.1", r"TODO", r"FIXME", r"XXX"], 0.75),
)
PROTECTION_WORDS = ("validate", "sanitize", "escape", "filter", "check", "verify", "authenticate", "authorize", "permission", "csrf", "xss_clean", "sql_escape", "prepared_statement", "parameterized_query")
#: Learned patterns to begin with: id, type, pattern, confidence (fixed values).
LEARNED_PATTERNS = (
    ("test_sql_1", "sql injection", r"test.*sql.*query", 0.8),
    ("example_xss_1", "xss", r"example.*script.*tag", 0.7),
    ("comment_cmd_1", "command injection", r"//.*system.*call", 0.9),
    ("doc_path_1", "path traversal", r"documentation.*\.\./", 0.75),
)

# CVSS weights by metric and letter, and templates by finding type in order (fixed values).
CVSS_WEIGHTS = {
    "av": {"N": 0.0, "A": 0.1, "L": 0.2, "P": 0.3}, "ac": {"L": 0.0, "H": 0.1}, "at": {"N": 0.0, "P": 0.1},
    "pr": {"N": 0.0, "L": 0.1, "H": 0.2}, "ui": {"N": 0.0, "P": 0.1, "A": 0.2},
}
CVSS_IMPACT = {"H": 0.0, "L": 0.1, "N": 0.2}
CVSS_MATURITY = {"X": 1.0, "U": 0.91, "P": 0.94, "F": 0.97, "H": 1.0}
CVSS_REQUIREMENT = {"X": 1.0, "L": 0.5, "M": 1.0, "H": 1.5}
CVSS_METRICS = ("av", "ac", "at", "pr", "ui", "vc", "vi", "va", "sc", "si", "sa")
# Metrics of each type of finding (fixed values).
CVSS_TEMPLATES = (
    ("sql injection", "AV:N/AC:L/AT:N/PR:N/UI:N/VC:H/VI:H/VA:L/SC:H/SI:H/SA:N"),
    ("command injection", "AV:N/AC:L/AT:N/PR:L/UI:N/VC:H/VI:H/VA:H/SC:H/SI:H/SA:H"),
    ("path traversal", "AV:N/AC:L/AT:N/PR:N/UI:N/VC:H/VI:N/VA:N/SC:L/SI:N/SA:N"),
    ("xss", "AV:N/AC:L/AT:N/PR:N/UI:A/VC:L/VI:L/VA:N/SC:L/SI:L/SA:N"),
    ("authorization bypass", "AV:N/AC:L/AT:N/PR:L/UI:N/VC:H/VI:H/VA:N/SC:H/SI:H/SA:N"),
)
CVSS_DEFAULT = "AV:N/AC:L/AT:N/PR:L/UI:N/VC:L/VI:L/VA:N/SC:N/SI:N/SA:N"


def cvss_letters(vector: str) -> str:
    """The values of a vector's metrics, one letter each, in the order of CVSS_METRICS."""
    return "".join(metric.split(":")[1] for metric in vector.split("/"))


# Similarity of findings (fixed values).
SIMILARITY_WEIGHTS = {"type": 0.3, "location": 0.25, "description": 0.2, "code_pattern": 0.15, "severity": 0.1}
RELATED_TYPES = {
    "sql injection": ("database", "injection", "query"), "xss": ("cross-site", "scripting", "javascript"),
    "command injection": ("command", "execution", "system"), "path traversal": ("directory", "file", "path"),
}
CODE_TOKENS = ("select", "insert", "update", "delete", "eval", "exec", "system", "include", "require", "import", "http", "request", "response")
SEVERITY_RANK = {"critical": 5, "high": 4, "medium": 3, "low": 2, "info": 1}
RISK_WEIGHTS = {"critical": 10.0, "high": 5.0, "medium": 2.0, "low": 1.0, "info": 0.1}
HEAT_WEIGHTS = {"critical": 5, "high": 4, "medium": 3, "low": 2, "info": 1}

# Confidence of a finding: weights before normalisation; one factor has an implicit weight (fixed values).
CONFIDENCE_WEIGHTS = {
    "code_quality": 0.15, "pattern_match": 0.20, "context_completeness": 0.15, "historical_accuracy": 0.15,
    "cross_validation": 0.20, "knowledge_relevance": 0.10, "semantic_coherence": 0.05, "impact_assessment": 0.1,
}
PATTERN_PROFILES = {
    "sql injection": (("select", "insert", "update", "delete", "union", "or", "and", "where", "from"), ("or 1=1", "union select", "; drop", "-- ", "/*")),
    "xss": (("script", "alert", "document", "window", "eval", "innerhtml", "onclick"), ("<script>", "javascript:", "onerror=", "onload=")),
    "command injection": (("system", "exec", "shell", "cmd", "subprocess", "popen", "os."), ("system(", "exec(", "`", "$(", "&&", "||", ";")),
    "path traversal": (("../", "..\\", "path", "file", "directory", "readfile", "include"), ("../../../", "..\\..\\..\\", "/etc/passwd", "c:\\windows")),
    "buffer overflow": (("strcpy", "strcat", "sprintf", "gets", "buffer", "malloc", "free"), ("strcpy(", "gets(", "sprintf(", "strcat(")),
    "deserialization": (("deserialize", "pickle", "unserialize", "json.loads", "yaml.load"), ("pickle.loads", "yaml.load", "unserialize(")),
}
GENERIC_SECURITY_WORDS = ("password", "token", "secret", "key", "auth", "login", "admin", "user", "input", "output", "request", "response", "validate")
DEFAULT_ACCURACIES = {
    "sql injection": 0.85, "xss": 0.80, "command injection": 0.88, "path traversal": 0.75, "buffer overflow": 0.70,
    "deserialization": 0.82, "authentication bypass": 0.78, "privilege escalation": 0.73,
}
DEFAULT_ACCURACY = 0.65

# Telemetry (fixed values).
QUALITY_WEIGHTS = {"accuracy": 0.25, "precision": 0.20, "recall": 0.20, "f1_score": 0.15, "false_positive_rate": -0.10, "confidence_score": 0.10}
QUALITY_LEVELS = ((0.90, "excellent"), (0.80, "good"), (0.65, "acceptable"), (0.45, "poor"))
QUALITY_ALERTS = {
    "accuracy": (("critical", 0.50), ("high", 0.65), ("medium", 0.75), ("low", 0.85)),
    "false_positive_rate": (("critical", 0.40), ("high", 0.25), ("medium", 0.15), ("low", 0.10)),
    "confidence_score": (("critical", 0.40), ("high", 0.55), ("medium", 0.70), ("low", 0.80)),
}
DIMENSION_WEIGHTS = {
    "accuracy": 0.25, "precision": 0.20, "recall": 0.15, "f1_score": 0.10, "confidence_calibration": 0.10,
    "consistency": 0.08, "completeness": 0.07, "timeliness": 0.03, "robustness": 0.02,
}
DIMENSION_LEVELS = ((0.9, "excellent"), (0.75, "good"), (0.6, "fair"), (0.4, "poor"))
PERFORMANCE_ALERTS = {
    "response_time": (("critical", 30.0), ("error", 10.0), ("warning", 5.0)), "error_rate": (("critical", 0.2), ("error", 0.1), ("warning", 0.05)),
    "memory_usage": (("critical", 0.95), ("error", 0.9), ("warning", 0.8)), "cpu_usage": (("critical", 0.95), ("error", 0.9), ("warning", 0.8)),
}
AUDIT_BASE, AUDIT_BASE_DEFAULT = {"security_violation": 0.9, "user_login": 0.3, "user_logout": 0.1, "configuration_changed": 0.6, "data_access": 0.4, "error_occurred": 0.5}, 0.3
AUDIT_RESULT = {"success": 1.0, "failure": 1.5, "partial": 1.2}
AUDIT_SECURITY = {"public": 0.5, "internal": 1.0, "confidential": 1.5, "restricted": 2.0}

# Tasks (fixed values).
FILE_HIGH_RISK = ("sql", "database", "query", "exec", "eval", "system", "shell", "command", "network", "socket", "auth", "password", "token", "session", "cookie")
FILE_MEDIUM_RISK = ("input", "output", "file", "read", "write", "http", "api", "request", "response")
FILE_GROUPS = (
    ("test", "path", ("test", "spec", "__test__")), ("config", "path", ("config", "setting", "env")), ("library", "path", ("lib", "vendor", "node_modules")),
    ("high_risk", "content", ("sql", "database", "network", "http", "api", "auth")), ("medium_risk", "content", ("function", "class", "method", "import")),
)
TASK_PLANS = {
    "critical": (("security_scan", 1), ("logic_analysis", 2), ("dependency_analysis", 2), ("syntax_check", 3)),
    "high": (("security_scan", 2), ("logic_analysis", 3), ("dependency_analysis", 3), ("syntax_check", 4)),
    "medium": (("security_scan", 3), ("logic_analysis", 4), ("syntax_check", 3)),
    "low": (("syntax_check", 3), ("logic_analysis", 4)),
    "test": (("syntax_check", 2), ("logic_analysis", 3)),
    "config": (("security_scan", 2), ("syntax_check", 3)),
}
TASK_SECONDS, TASK_SECONDS_DEFAULT = {"syntax_check": 0.5, "logic_analysis": 2.0, "security_scan": 3.0, "dependency_analysis": 1.5}, 1.0
TASK_RULES = (("syntax_check", "logic_analysis", "requires"), ("logic_analysis", "security_scan", "enhances"), ("dependency_analysis", "security_scan", "enhances"))

# Code vocabulary (fixed values).
PROGRAMMING_WORDS = ("if", "else", "for", "while", "function", "class", "return", "try", "catch", "throw", "import", "from", "def", "var", "let", "const", "public", "private", "protected", "static")
SECURITY_WORDS = ("password", "token", "auth", "login", "session", "cookie", "encrypt", "decrypt", "hash", "sql", "query", "execute", "eval", "exec", "system", "shell", "file", "path")
CODE_SIMILARITY_WEIGHTS = {"token": 0.3, "structure": 0.25, "semantic": 0.25, "pattern": 0.2}

#: Practice rules: id, language, type, severity, confidence, pattern (fixed values).
PRACTICE_RULES = (
    ("sql_injection_001", "general", "sql injection", "HIGH", 0.9, r"(SELECT|INSERT|UPDATE|DELETE).*\+.*['\"]"),
    ("xss_001", "javascript", "xss", "MEDIUM", 0.8, r"innerHTML\s*=\s*[^;]*\+"),
    ("command_injection_001", "php", "command injection", "HIGH", 0.95, r"(system|exec|shell_exec|passthru)\s*\([^)]*\$"),
    ("path_traversal_001", "php", "path traversal", "HIGH", 0.9, r"(file_get_contents|fopen|include|require)\s*\([^)]*\.\./"),
    ("buffer_overflow_001", "c", "buffer overflow", "HIGH", 0.95, r"(strcpy|strcat|sprintf|gets)\s*\("),
    ("owasp_a01_001", "php", "broken access control", "HIGH", 0.8, r"if\s*\(\s*\$_SESSION\[['\"]\w+['\"]\]\s*==\s*['\"]admin['\"]"),
    ("owasp_a02_001", "general", "cryptographic failures", "MEDIUM", 0.9, r"(md5|sha1)\s*\([^)]*password"),
    ("owasp_a03_001", "general", "injection", "HIGH", 0.85, r"query\s*=\s*['\"].*\$.*['\"]"),
    ("owasp_a07_001", "general", "authentication failures", "MEDIUM", 0.7, r"password\s*=\s*['\"][^'\"]{1,7}['\"]"),
    ("sans_cwe79_001", "javascript", "xss", "HIGH", 0.85, r"document\.write\s*\([^)]*\+"),
    ("sans_cwe89_001", "php", "sql injection", "HIGH", 0.9, r"(mysqli_query|mysql_query)\s*\([^)]*\.[^)]*\$"),
    ("sans_cwe78_001", "java", "command injection", "HIGH", 0.9, r"Runtime\.getRuntime\(\)\.exec\s*\([^)]*\+"),
    ("nist_ac_001", "general", "access control", "HIGH", 0.95, r"chmod\s+777"),
    ("nist_sc_001", "general", "insecure communication", "MEDIUM", 0.8, r"http://[^/]*password"),
)

# Quality levels of each metric, best first; of a rate of false positives less is better (fixed values).
METRIC_LEVELS = {
    "accuracy": (("excellent", 0.95), ("good", 0.85), ("acceptable", 0.70), ("poor", 0.50)),
    "precision": (("excellent", 0.90), ("good", 0.80), ("acceptable", 0.65), ("poor", 0.45)),
    "recall": (("excellent", 0.90), ("good", 0.80), ("acceptable", 0.65), ("poor", 0.45)),
    "f1_score": (("excellent", 0.90), ("good", 0.80), ("acceptable", 0.65), ("poor", 0.45)),
    "false_positive_rate": (("excellent", 0.05), ("good", 0.10), ("acceptable", 0.20), ("poor", 0.35)),
    "confidence_score": (("excellent", 0.90), ("good", 0.80), ("acceptable", 0.65), ("poor", 0.45)),
}
SUMMARY_LEVELS = ((0.90, "excellent"), (0.80, "good"), (0.65, "acceptable"), (0.45, "poor"))
#: Factor of a task type's confidence, and relevance of a kind of source (fixed values).
TASK_FACTORS = {"syntax_check": 0.95, "logic_analysis": 0.85, "security_scan": 0.80, "dependency_analysis": 0.90}
SOURCE_RELEVANCE = {"cve": 0.9, "practice": 0.8, "case": 0.7, "rag": 0.6}
#: Words in names that make a flow across files risky (fixed values).
FLOW_RISK_WORDS = ("auth", "login", "password", "token", "admin", "delete", "execute", "sql")

#: Lines that begin a unit in a language without a parser: pattern, kind (fixed values).
GENERIC_UNITS = (
    (r"(?:function|def|func)\s+([a-zA-Z0-9_]+)\s*\(", "function"),
    (r"(?:class|interface|struct)\s+([a-zA-Z0-9_]+)", "class"),
    (r"(?:public|private|protected)?\s+(?:static)?\s+(?:[a-zA-Z0-9_<>]+)\s+([a-zA-Z0-9_]+)\s*\(", "method"),
)
