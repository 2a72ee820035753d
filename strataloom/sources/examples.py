"""Counts of made-up repositories, for tests of the rules of risk; no query reads them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_CALM = {
    "code": 10, "test": 5, "config": 1, "total": 20, "builds": 1, "functions": 10, "complex_functions": 0, "imports": 4, "dotted_imports": 1, "quality_signals": 0, "critical": 0, "high": 0, "medium": 0, "density": 0.0, "assessed": None,
    "tangled": False, "consistent": True, "issues": 0.0, "indicators": 0, "comprehended": 5, "compliance": 95.0, "broken_critical": 0, "broken_high": 0, "owasp": 100.0, "practices": 100.0, "health": 100, "vulnerable": 0, "licences": 0,
    "outdated": 0, "ecosystems": 1, "duplication": 100.0, "ratio": 0.0, "cloned_critical": 0, "cloned_high": 0, "largest": 0, "api": 100.0, "api_critical": 0, "api_high": 0, "api_broken": 0, "api_design": 0, "endpoint_coverage": 1.0,
    "cyclomatic_high": 0, "cyclomatic_mid": 0, "cognitive_high": 0, "cognitive_mid": 0, "control_high": 0, "control_mid": 0, "redefined": 0, "insights_high": 0, "insights_medium": 0, "testing": 0.9, "test_gaps": 0, "governance": 0.9,
    "scanning": True, "licence_kinds": 1, "posture": 8, "maturity": 0.9, "misled": "low", "signals": 0, "safety": "high",
}
_BUSY = {
    "code": 120, "test": 3, "config": 60, "total": 150, "builds": 0, "functions": 10, "complex_functions": 3, "imports": 4, "dotted_imports": 3, "quality_signals": 11, "critical": 2, "high": 1, "medium": 4, "density": 7.5,
    "tangled": True, "consistent": False, "issues": 2.5, "indicators": 6, "comprehended": 0, "compliance": 60.0, "broken_critical": 2, "broken_high": 3, "owasp": 50.0, "practices": 70.0, "health": 40, "vulnerable": 7, "licences": 2,
    "outdated": 9, "ecosystems": 0, "duplication": 30.0, "ratio": 0.5, "cloned_critical": 6, "cloned_high": 7, "largest": 12, "api": 40.0, "api_critical": 5, "api_high": 5, "api_broken": 7, "api_design": 6, "endpoint_coverage": 0.2,
    "cyclomatic_high": 1, "cyclomatic_mid": 2, "cognitive_high": 1, "cognitive_mid": 1, "control_high": 1, "control_mid": 1, "redefined": 2, "insights_high": 1, "insights_medium": 1, "testing": 0.1, "test_gaps": 4, "governance": 0.2,
    "scanning": False, "licence_kinds": 2, "posture": 1, "maturity": 0.1, "misled": "high", "signals": 6, "safety": "very_low",
}
_BETWEEN = {
    "config": 7, "critical": 0, "high": 1, "medium": 2, "issues": 2.0, "compliance": 70.0, "owasp": 80.0, "health": 70, "vulnerable": 1, "outdated": 1, "duplication": 69.9, "ratio": 0.3, "cloned_high": 1, "api": 84.0, "api_high": 1,
    "api_design": 5, "endpoint_coverage": 0.5, "cyclomatic_mid": 4, "testing": 0.3, "governance": 0.59, "posture": 2, "misled": "medium", "safety": "low",
}
_KINDS = {bool: "boolean", int: "int", float: "double", str: "string", type(None): "string"}

ROWS: dict[str, tuple[str, list[tuple]]] = {
    "counts": ("repo string, " + ", ".join(f"{c} {_KINDS[type(v)]}" for c, v in _CALM.items()), [
        ("calm", *_CALM.values()), ("busy", *(_CALM | _BUSY).values()), ("between", *(_CALM | _BETWEEN).values()), ("told", *(_CALM | {"critical": 3, "assessed": "low"}).values()), ("blank", *({c: None for c in _CALM}).values()),
    ]),
}


def example(spark: SparkSession, name: str) -> DataFrame:
    schema, rows = ROWS[name]
    return spark.createDataFrame(rows, schema)
