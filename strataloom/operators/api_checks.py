"""Checks of declared endpoints: security, design and documentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.functions.scalars import share

# What the checks look for.
CHANGING = ("PUT", "PATCH", "DELETE")
SENSITIVE = ("/admin", "/internal", "/debug", "/config")
PROTECTED = ("admin", "user", "private")
WEAK = ("Basic", "API-Key")
NAMING = r"^/[a-z][a-z0-9_-]*/?$"
VERBS = ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS")
CODES = (200, 201, 204, 400, 401, 403, 404, 409, 422, 500)
#: Points that each finding of an area costs, and the most that an area costs.
COSTS = {"security": (5, 30), "design": (2, 20), "documentation": (1, 15)}


def _finding(area: str, kind: str, severity: str, issue: str | Column) -> Column:
    parts = {"area": F.lit(area), "type": F.lit(kind), "severity": F.lit(severity), "issue": F.lit(issue) if isinstance(issue, str) else issue}
    return F.struct(*(v.alias(k) for k, v in parts.items()))


def findings() -> Column:
    """All findings of one endpoint as an array, so that one scan answers all checks."""
    path, low, method = F.col("path"), F.lower("path"), F.col("method")
    undescribed = F.trim(F.coalesce("description", F.lit(""))) == ""
    schemes = F.flatten(F.transform("security", lambda s: F.coalesce(F.json_object_keys(s), F.array().cast("array<string>"))))
    codes = F.transform("responses", lambda c: F.when(c.rlike("^[0-9]+$"), c.try_cast("long")))
    # A path counts once for each sensitive part that it holds.
    changed = F.transform(
        F.filter(F.array(*map(F.lit, SENSITIVE)), lambda part: method.isin(*CHANGING) & low.contains(part)),
        lambda part: _finding("security", "insecure_method", "high", F.concat(F.lit("Insecure "), method, F.lit(" method on sensitive path"))),
    )
    weak = F.transform(
        F.filter(schemes, lambda s: s.isin(*WEAK)),
        lambda s: _finding("security", "weak_auth", "medium", F.concat(F.lit("Weak authentication method: "), s)),
    )
    single = (
        ((F.size("security") == 0) & low.rlike("|".join(PROTECTED)), _finding("security", "missing_auth", "medium", "Missing authentication on protected endpoint")),
        (~path.rlike(NAMING), _finding("design", "naming_convention", "low", "Non-standard resource naming")),
        (~method.isin(*VERBS), _finding("design", "http_method", "medium", F.concat(F.lit("Non-standard HTTP method: "), method))),
        ((F.size("responses") > 0) & ~F.exists(codes, lambda c: F.coalesce(c.isin(*CODES), F.lit(False))), _finding("design", "status_codes", "low", "Non-standard HTTP status codes")),
        (undescribed, _finding("documentation", "missing_description", "low", "Missing endpoint description")),
        (undescribed & (F.size("parameters") > 0), _finding("documentation", "undocumented_parameters", "medium", "Parameters defined but not documented")),
    )
    return F.array_compact(F.concat(changed, weak, F.array(*(F.when(holds, found) for holds, found in single))))


def _of_area(area: str) -> Column:
    return F.size(F.filter("f", lambda x: x["area"] == area))


def issues(endpoints: DataFrame) -> DataFrame:
    """A row per finding: ``endpoint, file, area, type, severity, issue``."""
    rows = endpoints.select(F.concat_ws(" ", "method", "path").alias("endpoint"), "file", F.explode(findings()).alias("f"))
    return rows.select("endpoint", "file", "f.*")


def health(endpoints: DataFrame, described: bool) -> DataFrame:
    """One row of counts and the health score. ``described``: whether the tree
    holds API descriptions, which earns 10 points, so a score can pass 100."""
    rows = endpoints.select("security", "description", findings().alias("f"))
    counts = {a: F.coalesce(F.sum(_of_area(a)), F.lit(0)) for a in COSTS}
    out = rows.agg(
        F.count(F.lit(1)).alias("total_endpoints"), F.count_if(F.size("security") > 0).alias("secure_endpoints"),
        F.count_if(F.trim(F.coalesce("description", F.lit(""))) != "").alias("documented_endpoints"),
        *(n.alias(f"{a}_issues") for a, n in counts.items()),
    )
    score = F.lit(110 if described else 100) + 10 * share(F.col("secure_endpoints"), F.col("total_endpoints"))
    for area, (each, most) in COSTS.items():
        score = score - F.least(each * F.col(f"{area}_issues"), F.lit(most))
    return out.withColumn("score", F.greatest(score, F.lit(0.0)))
