"""Component risks against values worked out by hand."""

from strataloom.operators.risks import RISKS, component_risks
from strataloom.plans.repositories import COMPONENTS, weighted_risk
from strataloom.sources.examples import example

BUSY = {
    "structural": ("high", 7), "semantic": ("high", 7), "security": ("critical", 17), "comprehension": ("high", 12), "compliance": ("high", 10), "dependency": ("critical", 42), "duplication": ("critical", 28),
    "api": ("critical", 38), "advanced_code": ("high", 17), "testing": ("high", 6), "governance": ("high", 7), "intent": ("high", 5), "misleading": ("high", 5), "change": ("high", 4),
}
BETWEEN = {
    "structural": ("low", 2), "semantic": ("low", 0), "security": ("high", 5), "comprehension": ("low", 1), "compliance": ("low", 2), "dependency": ("medium", 6), "duplication": ("high", 7),
    "api": ("medium", 5), "advanced_code": ("medium", 4), "testing": ("medium", 2), "governance": ("medium", 2), "intent": ("medium", 3), "misleading": ("medium", 2), "change": ("medium", 2),
}


def test_scores_and_levels(spark):
    rows = component_risks(example(spark, "counts")).collect()
    of = lambda repo: {r.component: (r.level, r.score) for r in rows if r.repo == repo}
    assert of("busy") == BUSY and of("between") == BETWEEN
    assert of("told")["security"] == ("low", 15)
    assert set(of("calm").values()) == set(of("blank").values()) == {("low", 0)}
    factors = {r.component: r.factors for r in rows if r.repo == "busy"}
    assert factors["dependency"] == ["very_poor_dependency_health", "7_vulnerable_dependencies", "2_license_issues", "9_outdated_packages", "no_dependency_management"]
    assert "high_vulnerability_density" in factors["security"] and len(factors["security"]) == 3
    # All rules with a factor fire but the 12 of middle ranges and the two of middle levels.
    assert sum(map(len, factors.values())) == sum(n != "NULL" for _, _, rules in RISKS for _, _, n in rules) - 14


def test_weights_of_levels(spark):
    got = {r.repo: (round(r.risk, 4), r.level) for r in weighted_risk(component_risks(example(spark, "counts"))).collect()}
    assert [c for c, _, _ in RISKS] and {c for c, _, _ in RISKS} == set(COMPONENTS)
    # Four critical components of weight 8 count once, the other 15 three times.
    assert got["busy"] == (round(53 / 23, 4), "medium") and got["calm"] == (1.0, "low")
