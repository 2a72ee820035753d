"""Risk of the components of a repository, from what their analyses counted.

One row a repository in, one row a component out; no shuffle.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.functions.scalars import level

# Component, bounds of its levels (the last is "low"), and its rules: condition, points and factor.
# Conditions, points and factors are SQL over the columns of the counts.
_STEPS = ((4, "high"), (2, "medium"))
_WIDE = ((12, "critical"), (6, "high"), (3, "medium"))
RISKS = (
    ("structural", ((5, "high"), (3, "medium")), (
        ("code > 100 AND test < code * 0.1", "3", "'insufficient_test_coverage'"), ("config > total * 0.3", "2", "'excessive_configuration'"), ("code > 50 AND builds = 0", "2", "'missing_build_system'"))),
    ("semantic", ((5, "high"), (3, "medium")), (
        ("complex_functions > functions * 0.2", "3", "'high_function_complexity'"), ("dotted_imports > imports * 0.5", "2", "'heavy_external_dependencies'"), ("quality_signals > 10", "2", "'code_quality_concerns'"))),
    ("security", ((10, "critical"), (5, "high"), (2, "medium")), (
        ("critical > 0", "critical * 5", "'critical_security_vulnerabilities'"), ("high > 0", "high * 3", "'high_security_vulnerabilities'"), ("medium > 0", "medium", "NULL"), ("density > 5", "0", "'high_vulnerability_density'"))),
    ("comprehension", ((6, "high"), (3, "medium")), (
        ("tangled", "3", "'high_code_complexity'"), ("NOT consistent", "2", "'inconsistent_architecture'"), ("issues > 2", "3", "'high_issue_density'"), ("issues > 1 AND issues <= 2", "1", "'moderate_issue_density'"),
        ("indicators > 5", "2", "'multiple_code_risks'"), ("comprehended = 0", "2", "'no_ai_analysis_available'"))),
    ("compliance", ((8, "high"), (4, "medium")), (
        ("compliance < 70", "4", "'low_overall_compliance'"), ("compliance >= 70 AND compliance < 85", "2", "'moderate_compliance_issues'"), ("broken_critical > 0", "broken_critical * 3", "'critical_compliance_violations'"),
        ("broken_high > 0", "broken_high * 2", "'high_severity_compliance_violations'"), ("owasp < 80", "2", "'owasp_compliance_issues'"), ("practices < 80", "2", "'security_best_practice_violations'"))),
    ("dependency", ((15, "critical"), (8, "high"), (4, "medium")), (
        ("health < 50", "8", "'very_poor_dependency_health'"), ("health >= 50 AND health < 70", "5", "'poor_dependency_health'"), ("health >= 70 AND health < 85", "2", "'moderate_dependency_health'"),
        ("vulnerable > 0", "least(vulnerable * 3, 15)", "concat(vulnerable, '_vulnerable_dependencies')"), ("licences > 0", "least(licences * 2, 10)", "concat(licences, '_license_issues')"),
        ("outdated > 0", "least(outdated, 5)", "concat(outdated, '_outdated_packages')"), ("ecosystems = 0", "10", "'no_dependency_management'"))),
    ("duplication", _WIDE, (
        ("duplication < 50", "8", "'severe_duplication'"), ("duplication >= 50 AND duplication < 70", "5", "'high_duplication'"), ("duplication >= 70 AND duplication < 85", "2", "'moderate_duplication'"),
        ("ratio > 0.3", "3", "'high_duplicate_ratio'"), ("ratio > 0.15 AND ratio <= 0.3", "1", "'moderate_duplicate_ratio'"), ("cloned_critical > 0", "least(cloned_critical * 2, 10)", "concat(cloned_critical, '_files_critical_duplication')"),
        ("cloned_high > 0", "least(cloned_high, 5)", "concat(cloned_high, '_files_high_duplication')"), ("largest > 10", "2", "'large_clone_groups'"))),
    ("api", _WIDE, (
        ("api < 50", "8", "'severe_api_issues'"), ("api >= 50 AND api < 70", "5", "'high_api_issues'"), ("api >= 70 AND api < 85", "2", "'moderate_api_issues'"),
        ("api_critical > 0", "least(api_critical * 3, 12)", "concat(api_critical, '_critical_api_security_issues')"), ("api_high > 0", "least(api_high * 2, 8)", "concat(api_high, '_high_api_security_issues')"),
        ("api_broken > 0", "least(api_broken, 5)", "concat(api_broken, '_api_compliance_violations')"), ("api_design > 5", "3", "'poor_api_design'"), ("api_design > 2 AND api_design <= 5", "1", "'moderate_api_design_issues'"),
        ("endpoint_coverage < 0.5", "2", "'low_api_endpoint_coverage'"))),
    ("advanced_code", ((8, "high"), (4, "medium")), (
        ("cyclomatic_high > 0", "cyclomatic_high * 2", "'high_cyclomatic_complexity'"), ("cyclomatic_mid > 0", "cyclomatic_mid", "'moderate_cyclomatic_complexity'"), ("cognitive_high > 0", "cognitive_high * 2", "'high_cognitive_complexity'"),
        ("cognitive_mid > 0", "cognitive_mid", "'moderate_cognitive_complexity'"), ("control_high > 0", "control_high * 2", "'complex_control_flow'"), ("control_mid > 0", "control_mid", "'moderate_control_flow'"),
        ("redefined > 0", "redefined", "'frequent_variable_redefinition'"), ("insights_high > 0", "insights_high * 3", "'advanced_insight_high'"), ("insights_medium > 0", "insights_medium * 2", "'advanced_insight_medium'"))),
    ("testing", _STEPS, (("testing < 0.3", "4", "'very_low_test_maturity'"), ("testing >= 0.3 AND testing < 0.6", "2", "'low_test_maturity'"), ("test_gaps > 3", "2", "'multiple_test_gaps'"))),
    ("governance", _STEPS, (
        ("governance < 0.3", "4", "'very_low_governance_maturity'"), ("governance >= 0.3 AND governance < 0.6", "2", "'low_governance_maturity'"), ("NOT scanning", "2", "'missing_security_scanning'"), ("licence_kinds > 1", "1", "'multiple_licenses'"))),
    ("intent", _STEPS, (("posture < 3", "3", "'low_security_posture'"), ("maturity < 0.3", "2", "'low_maturity_level'"))),
    ("misleading", _STEPS, (("misled = 'high'", "4", "'high_misleading_signals'"), ("misled = 'medium'", "2", "'medium_misleading_signals'"), ("signals > 5", "1", "'multiple_misleading_signals'"))),
    ("change", _STEPS, (("safety = 'very_low'", "4", "'very_low_change_safety'"), ("safety = 'low'", "2", "'low_change_safety'"))),
)
#: Risk scores that are cut at a bound, once their level is told (fixed value).
CUT = {"compliance": 10}


#: Weights of the components in the overall risk (fixed values).
WEIGHTS = {
    "structural": 1, "semantic": 1, "security": 3, "comprehension": 2, "compliance": 2, "dependency": 2, "duplication": 1, "api": 2,
    "advanced_code": 2, "testing": 2, "governance": 2, "intent": 1, "misleading": 1, "change": 1,
}


def components(counts: DataFrame) -> list[Column]:
    """A struct of component, level, score and factors for each component, from
    columns of ``counts``; those that it lacks count as null, and a null breaks
    no rule. ``assessed``, where not null, is the level of security as its own
    analysis told it."""
    known = set(counts.columns)

    def held(test: str) -> bool:
        return set(re.findall("[a-z_]+", re.sub("'[^']*'", "", test))) <= known

    def one(component, steps, rules):
        rules = [r for r in rules if held(r[0])]
        points = reduce(lambda a, b: a + b, [F.when(F.expr(test), F.expr(n).cast("long")).otherwise(F.lit(0).cast("long")) for test, n, _ in rules], F.lit(0).cast("long"))
        factors = [F.when(F.expr(test), F.expr(name).cast("string")) for test, _, name in rules] or [F.lit(None).cast("string")]
        told = level(points, steps, "low")
        if component == "security" and "assessed" in known:
            told = F.coalesce("assessed", told)
        cut = F.least(points, F.lit(CUT[component])) if component in CUT else points
        return F.struct(F.lit(component).alias("component"), told.alias("level"), cut.cast("long").alias("score"), F.array_compact(F.array(*factors)).alias("factors"))

    return [one(*r) for r in RISKS]


def component_risks(counts: DataFrame) -> DataFrame:
    """``repo, component, level, score, factors`` of each repository's counts."""
    return counts.select("repo", F.explode(F.array(*components(counts))).alias("x")).select("repo", "x.*")


def weighted(levels: Column) -> Column:
    """The weighted mean of an array of components with levels, in its own row:
    3 for high, 2 for medium, 1 for any other."""
    weights = F.create_map(*(F.lit(x) for pair in WEIGHTS.items() for x in pair))
    points = lambda x: F.when(x["level"] == "high", 3).when(x["level"] == "medium", 2).otherwise(1)
    total = F.aggregate(levels, F.lit(0), lambda a, x: a + points(x) * F.element_at(weights, x["component"]))
    return total / F.aggregate(levels, F.lit(0), lambda a, x: a + F.element_at(weights, x["component"]))
