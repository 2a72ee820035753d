"""Security rules over lines, and compliance rules over whole files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rule, severity, weakness, category, and patterns, which match
# without regard to case; a line counts once for each rule.
SECURITY = (
    ("sql_injection", "high", "CWE-89", "A03:2021-Injection", (
        r"""\.execute\s*\(\s*["']?\s*SELECT.*%s.*["']?\s*\)""",
        r"""\.execute\s*\(\s*["']?\s*INSERT.*%s.*["']?\s*\)""",
        r"""\.execute\s*\(\s*["']?\s*UPDATE.*%s.*["']?\s*\)""",
        r"""\.execute\s*\(\s*["']?\s*DELETE.*%s.*["']?\s*\)""",
        r"cursor\.execute\s*\(\s*.*\+.*\)", r"query\s*=.*%.*\s*db\.execute")),
    ("xss_vulnerability", "high", "CWE-79", "A03:2021-Injection", (
        r"innerHTML\s*=.*\+", r"document\.write\s*\(.*\+.*\)", r"eval\s*\(.*\+.*\)",
        r"setTimeout\s*\(.*\+.*\)", r"setInterval\s*\(.*\+.*\)")),
    ("weak_crypto", "medium", "CWE-327", "A02:2021-Cryptographic Failures", (
        r"import\s+md5", r"from\s+crypt\s+import", r"hashlib\.md5\s*\(", r"hashlib\.sha1\s*\(", r"random\.", r"os\.urandom")),
    ("hardcoded_secrets", "high", "CWE-798", "A05:2021-Security Misconfiguration", (
        r"""password\s*=\s*["'][^"']+["']""", r"""secret\s*=\s*["'][^"']+["']""", r"""key\s*=\s*["'][^"']+["']""",
        r"""token\s*=\s*["'][^"']+["']""", r"""api_key\s*=\s*["'][^"']+["']""")),
    ("path_traversal", "high", "CWE-22", "A01:2021-Broken Access Control", (
        r"open\s*\(\s*.*\+.*\)", r"file\s*=\s*open\s*\(.*\+.*\)", r"with\s+open\s*\(.*\+.*\)", r"\.\./", r"\.\.\\")),
    ("command_injection", "critical", "CWE-78", "A03:2021-Injection", (
        r"os\.system\s*\(.*\+.*\)", r"subprocess\.call\s*\(.*\+.*\)", r"os\.popen\s*\(.*\+.*\)", r"subprocess\.Popen\s*\(.*\+.*\)")),
    ("insecure_deserialization", "high", "CWE-502", "A08:2021-Software and Data Integrity Failures", (
        r"pickle\.loads?\s*\(", r"yaml\.load\s*\(", r"json\.loads?\s*\(", r"eval\s*\(")),
)
#: What a line in lower case must hold for any pattern above to match.
NEEDLES = (
    ".execute", "innerhtml", "document.write", "eval", "settimeout", "setinterval", "md5", "crypt", "hashlib.sha1", "random.", "os.urandom",
    "password", "secret", "key", "token", "open", "../", "..\\", "os.system", "subprocess.call", "load",
)
#: Weight of each severity in the risk score (fixed values).
WEIGHTS = {"critical": 1.0, "high": 0.7, "medium": 0.4, "low": 0.1, "info": 0.05}


def alternation(patterns: tuple[str, ...]) -> str:
    """One pattern that matches where any does, without regard to case."""
    return "(?i)" + "|".join(f"(?:{p})" for p in patterns)


def suspect(line: Column) -> Column:
    """Whether any rule matches the line: a search for literals, which is far
    cheaper than patterns, drops most lines before the alternation of all rules."""
    # The array of one binds the line in lower case, so that it is made once.
    literal = F.exists(F.array(F.lower(line)), lambda low: reduce(lambda a, b: a | b, [low.contains(n) for n in NEEDLES]))
    return literal & line.rlike(alternation(tuple(p for r in SECURITY for p in r[4])))


def suspects(docs: DataFrame) -> DataFrame:
    """The lines of texts that any rule matches; others don't leave the row of
    their text. A text without any gives a null line, as the planner would
    search all lines twice, first for the size of what ``explode`` is given."""
    return docs.select("doc_id", "source", F.explode_outer(F.filter(F.split("text", "\n"), suspect)).alias("line"))


def security_findings(lines: DataFrame, searched: bool = False) -> DataFrame:
    """A row per line and rule that it breaks; ``searched`` lines come from ``suspects``."""
    hits = [
        F.when(F.col("line").rlike(alternation(r[4])), F.struct(*(F.lit(x).alias(n) for n, x in zip(("rule", "severity", "cwe", "owasp"), r[:4], strict=True))))
        for r in SECURITY
    ]
    found = (lines if searched else lines.filter(suspect(F.col("line")))).withColumn("hit", F.explode(F.array_compact(F.array(*hits))))
    return found.select(*lines.columns, "hit.*")


def severities(text: Column) -> Column:
    """Severity of each line's broken rules, of a whole text."""
    found = F.filter(F.split(text, "\n"), suspect)
    return F.flatten(F.transform(found, lambda line: F.array_compact(F.array(*(F.when(line.rlike(alternation(r[4])), F.lit(r[1])) for r in SECURITY)))))


#: Rule and advice, in order.
ADVICE = (
    ("sql_injection", "Implement parameterized queries or prepared statements for all database operations"),
    ("xss_vulnerability", "Implement proper output encoding and input validation for all user inputs"),
    ("command_injection", "Avoid shell command execution with user inputs; use safe APIs instead"),
    ("hardcoded_secrets", "Move all secrets to environment variables or secure credential stores"),
    ("weak_crypto", "Upgrade to modern cryptographic algorithms (AES-256, SHA-256+)"),
)
NO_FINDINGS = "No critical security issues detected. Continue regular security reviews."
ALWAYS = ("Implement automated security testing in CI/CD pipeline", "Conduct regular security code reviews and penetration testing")


def advice(docs: DataFrame) -> DataFrame:
    """What each source should do, ``(source, findings, critical, high, medium, advice)``,
    with the advice as a list in order. Rules are counted inside the row of their
    text, so one partial aggregate answers all; a null text breaks no rule."""
    broken = F.flatten(F.transform(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), suspect), lambda x: F.transform(F.filter(F.array(*(F.struct(F.lit(r[0]).alias("rule"), x.rlike(alternation(r[4])).alias("is")) for r in SECURITY)), lambda h: h["is"]), lambda h: h["rule"])))
    rows = docs.select("source", broken.alias("hits"))
    count = lambda rule: F.sum(F.size("hits") - F.size(F.array_remove("hits", rule)))
    told = rows.groupBy("source").agg(*(count(r[0]).alias(r[0]) for r in SECURITY))
    level = lambda s: sum((F.col(r[0]) for r in SECURITY if r[1] == s), F.lit(0)).cast("long")
    told = told.select("source", *(F.col(r[0]) for r in SECURITY), *(level(s).alias(s) for s in ("critical", "high", "medium")), sum((F.col(r[0]) for r in SECURITY), F.lit(0)).cast("long").alias("findings"))
    urgent = F.when(F.col("critical") > 0, F.concat(F.lit("Address "), F.col("critical").cast("string"), F.lit(" critical security findings immediately")))
    listed = F.array_compact(F.array(*(F.when(F.col(rule) > 0, F.lit(text)) for rule, text in ADVICE), urgent, *map(F.lit, ALWAYS)))
    return told.select("source", "findings", "critical", "high", "medium", F.when(F.col("findings") == 0, F.array(F.lit(NO_FINDINGS))).otherwise(listed).alias("advice"))


def weight(severity: Column) -> Column:
    return reduce(lambda out, x: out.when(severity == x[0], x[1]), list(WEIGHTS.items())[1:], F.when(severity == "critical", 1.0)).otherwise(0.0)


#: Compliance rules with framework and severity.
COMPLIANCE = (
    ("OWASP-A04", "OWASP", "high"), ("OWASP-A05", "OWASP", "high"), ("OWASP-A03", "OWASP", "high"),
    ("SEC-001", "SECURITY", "critical"), ("SEC-002", "SECURITY", "medium"), ("SEC-004", "SECURITY", "high"),
    ("QUAL-001", "QUALITY", "medium"), ("QUAL-002", "QUALITY", "low"), ("QUAL-003", "QUALITY", "low"),
    ("GDPR-001", "GDPR", "high"), ("GDPR-002", "GDPR", "medium"), ("CCPA-001", "CCPA", "medium"),
)
#: Four more rules, which search by patterns.
MORE_COMPLIANCE = (
    ("OWASP-A01", "OWASP", "critical"), ("OWASP-A02", "OWASP", "high"), ("SEC-003", "SECURITY", "high"), ("QUAL-004", "QUALITY", "medium"),
)
# Words and patterns of the rules.
SENSITIVE = ("password|passwd|pwd", "secret|token|key", "ssn|social.*security", "credit.*card|ccv")
PERSONAL = ("email|phone|address", "name|age|birth", "ssn|social.*security")
SECRETS = (r"""password\s*=\s*["'][^"']+["']""", r"""api_key\s*=\s*["'][^"']+["']""", r"""secret\s*=\s*["'][^"']+["']""", r"""token\s*=\s*["'][^"']+["']""")
# A dot stands for all but a line feed, as in the reference: (?d).
SQL_INJECTION = (r"""execute\s*\(\s*["'].*?\+\s*.*?\s*["']""", r"""cursor\.execute\s*\(\s*["'].*?%.*?\s*["']""", r"""["'].*?\s*SELECT.*?\s*["'].*?\+\s*""")
WEAK_LOGIN = (r"""password\s*=\s*["'].*?["']""", r"""session\s*=\s*.*?\.get\s*\(\s*["']session["']""", r"auth.*=\s*(True|False)")
COMMANDS = (r"os\.system\s*\(\s*.*?\+\s*.*?\)", r"subprocess\.call\s*\(\s*.*?\+\s*.*?\)", r"exec\s*\(\s*.*?\+\s*.*?\)")
PRIVACY = ("consent", "opt-out", "gdpr", "ccpa", "privacy")


def compliance_checks(text: Column, low: Column) -> dict[str, Column]:
    """Whether a whole text breaks each rule; one scan answers all. ``low`` is
    the text in lower case."""

    def one_of(alternatives: str) -> Column:
        """Literals by search; a pattern only where its first literal is found."""
        tests = [low.contains(a) if ".*" not in a else low.contains(a.split(".*")[0]) & low.rlike(a) for a in alternatives.split("|")]
        return reduce(lambda a, b: a | b, tests)

    has = lambda *words: reduce(lambda a, b: a | b, [low.contains(w) for w in words])
    families = lambda ps: reduce(lambda a, b: a + b, [one_of(p).cast("int") for p in ps])
    exact = lambda *words: reduce(lambda a, b: a | b, [text.contains(w) for w in words])
    defined = F.when(text.contains("def"), F.regexp_count(text, F.lit(r"def\s+\w+\s*\([^)]*\):"))).otherwise(0)
    return {
        # Literals first, of which every match of the patterns holds one.
        "OWASP-A01": has("execute", "select") & text.rlike("(?d)" + alternation(SQL_INJECTION)),
        "OWASP-A02": low.contains("=") & has("password", "session", "auth") & text.rlike("(?d)" + alternation(WEAK_LOGIN)),
        "SEC-003": exact("os.system", "subprocess.call", "exec") & text.rlike("(?d)" + "|".join(COMMANDS)),
        "QUAL-004": (defined > 0) & (F.size(F.split(text, "\n")) > 50 * defined),
        "OWASP-A03": families(SENSITIVE) > 2,
        "OWASP-A04": has("xml") & has("parser", "sax") & ~has("secure") & ~has("safe"),
        "OWASP-A05": has("admin", "user") & ~has("role"),
        "SEC-001": text.contains("=") & text.rlike(alternation(SECRETS)),
        "SEC-002": has("random") & ~has("secure"),
        "SEC-004": exact("../", "..\\") & exact("open", "file"),
        "QUAL-001": F.size(F.split(text, "\n")) > 100,
        "QUAL-002": exact("TODO", "FIXME"),
        "QUAL-003": F.regexp_count(text, F.lit(r"\b\d{2,}\b")) > 10,
        "GDPR-001": families(PERSONAL) > 1,
        "GDPR-002": ~has("delete", "expire"),
        "CCPA-001": ~has(*PRIVACY),
    }


def compliance(docs: DataFrame, rules: tuple = COMPLIANCE) -> DataFrame:
    """A row per file and rule, passed or broken."""
    docs = docs.select("doc_id", "source", "text", F.lower("text").alias("low"))
    checks = compliance_checks(F.col("text"), F.col("low"))
    rows = [F.struct(F.lit(r).alias("rule"), F.lit(f).alias("framework"), F.lit(s).alias("severity"), checks[r].alias("broken")) for r, f, s in rules]
    # Outer, as the planner would answer all rules twice, first for their number.
    return docs.select("doc_id", "source", F.explode_outer(F.array(*rows)).alias("x")).select("doc_id", "source", "x.*")
