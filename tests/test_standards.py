"""Six standards on planted repositories."""

from strataloom.operators.standards import standards


def test_planted_repositories(spark):
    rows = [
        ("good", "SECURITY.md", "x"), ("good", ".github/dependabot.yml", ""), ("good", "LICENSE", "The MIT License"), ("good", "LICENSE.md", "odd"), ("good", "privacy_policy.md", "Consent."), ("good", "app.py", "CONSENT = encrypt(test)"),
        ("good", ".github/workflows/security.yml", None), ("good", "Dockerfile", "FROM a"), ("good", "requirements.txt", "requests>=3"), ("good", "hipaa_compliance.md", "phi"),
        ("bad", "docs/LICENSE", "MIT"), ("bad", "COPYING", "own terms"), ("bad", "app.py", "phi = 1\nkey = 'x'\nhttp://a"), ("bad", "hipaa_compliance.md", ""), ("bad", "requirements.txt", "Django<2.0"), ("bad", "gdpr.md", ""),
        ("guarded", "hipaa_compliance.md", ""), ("guarded", "m.py", "patient_data"), ("guarded", "readme", "Encryption at rest"), ("none", "a", None),
    ]
    got = {r.repo: r for r in standards(spark.createDataFrame(rows, "repo string, path string, content string")).collect()}
    told = lambda r: tuple(bool(got[r][c]) for c in ("gdpr", "hipaa", "soc2", "security", "license", "dependencies"))
    assert told("good") == (True, True, True, True, True, True) and got["good"].score == 1.0
    assert told("bad") == (False,) * 6 and got["bad"].compliant == 0
    assert told("guarded")[1] and not told("none")[3]
    assert standards(spark.createDataFrame([], "repo string, path string, content string")).collect() == []
