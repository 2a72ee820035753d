"""Standards that a repository's documents and files speak for, in one partial aggregate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Documents at the root, and words in files, of each check.
GDPR_FILES = ("privacy_policy.md", "gdpr.md", "data_processing.md")
GDPR_WORDS = ("personal_data", "user_data", "gdpr", "data_processing", "consent", "privacy_policy", "data_retention")
HIPAA_FILES = ("hipaa_compliance.md", "phi_protection.md", "health_data.md")
HIPAA_WORDS = ("protected_health_information", "phi", "medical_data", "patient_data", "health_records", "hipaa")
GUARDS = ("encryption", "access_control", "audit_logging")
LICENCES = ("LICENSE", "LICENSE.md", "COPYING")
LICENCE_WORDS = ("mit", "apache", "gpl", "gnu", "bsd")
MANIFESTS = ("requirements.txt", "pyproject.toml", "package.json", "Cargo.toml")
SECRET = r"""(?i)(password|secret|key)\s*=\s*['"][^'"]+['"]"""
OLD = r"(?i)requests.*[<>=].*2\.0|django.*[<>=].*2\.0"


def standards(files: DataFrame) -> DataFrame:
    """Six checks of each repository of ``files(repo, path, content)``:
    ``repo, gdpr, hipaa, soc2, security, license, dependencies, compliant, score``.

    Content is searched inside its row, and all files are searched; paths are
    relative to the root. Of several license files the first by name in
    ``LICENCES`` tells the kind. A null content is empty.
    """
    path, low, text = F.col("path"), F.col("low"), F.col("text")
    holds = lambda words: reduce(lambda a, b: a | b, [low.contains(w) for w in words])
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    code = path.endswith(".py") | path.endswith(".js") | path.endswith(".ts")
    known = holds(LICENCE_WORDS)
    place = reduce(lambda out, x: out.when(path == x[1], x[0]), list(enumerate(LICENCES))[1:], F.when(path == LICENCES[0], 0))
    flags = {
        "gdpr_file": path.isin(*GDPR_FILES), "gdpr_code": code & holds(GDPR_WORDS), "hipaa_file": path.isin(*HIPAA_FILES), "phi": path.endswith(".py") & holds(HIPAA_WORDS), "guarded": holds(GUARDS),
        "controls": path == ".github/workflows/security.yml", "available": path.isin("docker-compose.yml", "Dockerfile"), "tested": low.contains("test"), "encrypts": low.contains("encrypt"), "private": path.isin("PRIVACY.md", "privacy_policy.md"),
        "told": path == "SECURITY.md", "dependabot": path == ".github/dependabot.yml", "codeql": path == ".github/workflows/codeql.yml", "leaks": text.rlike(SECRET), "plain": low.contains("http://"),
        "manifest": path.isin(*MANIFESTS), "outdated": text.rlike(OLD),
    }
    rows = files.select("repo", "path", F.coalesce("content", F.lit("")).alias("text")).withColumn("low", F.lower("text"))
    first = F.min(F.when(place.isNotNull(), F.struct(place.alias("place"), (~known).alias("odd")))).alias("licence")
    seen = rows.groupBy("repo").agg(*(some(c).alias(n) for n, c in flags.items()), first)
    has: dict[str, Column] = {n: F.col(n) for n in flags}
    good = sum((c.cast("int") for c in (has["told"], has["dependabot"], has["codeql"], ~has["leaks"], ~has["plain"])), F.lit(0))
    checks = {
        "gdpr": has["gdpr_file"] & has["gdpr_code"], "hipaa": has["hipaa_file"] & (~has["phi"] | has["guarded"]), "soc2": has["controls"] & has["available"] & has["tested"] & has["encrypts"] & has["private"],
        "security": good >= 3, "license": F.coalesce(~F.col("licence.odd"), F.lit(False)), "dependencies": has["manifest"] & ~has["outdated"],
    }
    out = seen.select("repo", *(c.alias(n) for n, c in checks.items()))
    n = sum((F.col(c).cast("int") for c in checks), F.lit(0))
    return out.select("*", n.alias("compliant"), F.round(n / len(checks), 6).alias("score"))
