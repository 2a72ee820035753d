"""Dependencies that manifests name, and the health they mean."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Known vulnerable packages by ecosystem, and the versions named.
VULNERABLE = (
    ("python", "requests", "<2.20.0"), ("python", "django", "<2.2.0"), ("python", "flask", "<1.0.0"),
    ("javascript", "lodash", "<4.17.11"), ("javascript", "moment", "<2.20.0"), ("javascript", "axios", "<0.18.1"),
)


def dependencies(files: DataFrame) -> DataFrame:
    """Rows ``(repo, ecosystem, name, spec)`` of the manifests at any depth."""
    own = lambda name: files.filter(F.regexp_extract("path", "[^/]*$", 0) == name)
    line = F.explode(F.transform(F.split("content", r"\r?\n"), F.trim)).alias("spec")
    python = own("requirements.txt").select("repo", line).filter((F.col("spec") != "") & ~F.col("spec").startswith("#"))
    python = python.select("repo", F.lit("python").alias("ecosystem"), F.regexp_extract("spec", "^([a-zA-Z0-9_-]+)", 1).alias("name"), "spec")
    parsed = F.from_json("content", "dependencies map<string,string>, devDependencies map<string,string>")
    entries = F.concat(*(F.coalesce(F.map_entries(parsed[s]), F.array()) for s in ("dependencies", "devDependencies")))
    script = own("package.json").select("repo", F.explode(entries).alias("e")).select("repo", F.lit("javascript").alias("ecosystem"), F.col("e.key").alias("name"), F.col("e.value").alias("spec"))
    block = F.explode(F.regexp_extract_all("content", F.lit(r"(?s)<dependency>(.*?)</dependency>"), 1)).alias("b")
    tag = lambda t: F.regexp_extract("b", f"<{t}>([^<]*)</{t}>", 1)
    java = own("pom.xml").select("repo", block).select("repo", F.lit("java").alias("ecosystem"), F.concat_ws(":", tag("groupId"), tag("artifactId")).alias("name"), F.coalesce(F.nullif(tag("version"), F.lit("")), F.lit("unknown")).alias("spec"))
    return python.unionByName(script).unionByName(java)


def dependency_health(files: DataFrame) -> DataFrame:
    """Packages of each repository, those that are vulnerable, of a strict
    licence or outdated, and a score that starts at 100. The vulnerable
    packages are a fixed table, matched by ecosystem and name whatever the version."""
    known = F.concat_ws(":", "ecosystem", F.lower("name")).isin(*(f"{e}:{n}" for e, n, _ in VULNERABLE))
    old = F.col("spec").startswith("1.") | F.col("spec").startswith("^1.")
    counts = dependencies(files).groupBy("repo").agg(
        F.count(F.lit(1)).alias("packages"), F.count_if(known).alias("vulnerable"), F.count_if(F.lower("name").contains("gpl")).alias("licence_issues"), F.count_if(old).alias("outdated"),
    )
    rows = files.select("repo").distinct().join(counts, "repo", "left").na.fill(0)
    lost = lambda c, each, most: F.least(F.col(c) * each, F.lit(most))
    score = 100 - lost("vulnerable", 10, 40) - lost("licence_issues", 5, 20) - lost("outdated", 2, 20) - F.when(F.col("packages") == 0, 30).otherwise(0)
    return rows.withColumn("health", F.greatest(F.lit(0), score).cast("long"))
