"""What the paths and contents of a repository's files tell about it.

Relations have the columns ``repo, path, content``. A signal is present where
any path holds its needle; all signals are answered in one pass by a partial
aggregate of one flag each, without a join of files and needles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of languages by extension, and sets of extensions and path parts.
LANGUAGES = {
    ".py": "Python", ".js": "JavaScript", ".ts": "TypeScript", ".java": "Java", ".rs": "Rust", ".go": "Go", ".cpp": "C++", ".c": "C", ".h": "C/C++ Header",
    ".rb": "Ruby", ".php": "PHP", ".sh": "Shell", ".yml": "YAML", ".yaml": "YAML", ".json": "JSON", ".xml": "XML", ".md": "Markdown", ".txt": "Text",
}
CODE = (".py", ".js", ".ts", ".java", ".rs", ".go", ".cpp", ".c", ".rb", ".php")
CONFIG = (".yml", ".yaml", ".json", ".xml", ".toml", ".ini", ".cfg")
SCANNED = (".py", ".js", ".ts", ".java", ".cpp", ".c", ".php", ".rb", ".go", ".rs")
CLONED = (".py", ".js", ".jsx", ".ts", ".tsx", ".java", ".cpp", ".c", ".h", ".hpp", ".cs", ".php", ".rb", ".go", ".rs", ".swift", ".kt", ".scala", ".clj")
NOT_CLONED = (
    "/test/", "/tests/", "/spec/", "/specs/", ".test.", ".spec.", ".min.", ".generated.", "/node_modules/", "/build/", "/dist/", "/target/",
    "/__pycache__/", ".pyc", "/venv/", "/env/",
)

#: Group, label, needle, and whether the path is compared as it is, in lower or in upper case.
SIGNALS = (
    *(("framework", label, needle, "exact") for label, needle in (
        ("Python (requirements.txt)", "requirements.txt"), ("Python (pyproject.toml)", "pyproject.toml"), ("Python (setup.py)", "setup.py"),
        ("Node.js", "package.json"), ("Maven (Java)", "pom.xml"), ("Gradle (Java)", "build.gradle"), ("Rust (Cargo)", "Cargo.toml"))),
    *(("build", label, needle, "exact") for label, needle in (("Make", "Makefile"), ("CMake", "CMakeLists.txt"), ("Gradle", "build.gradle"), ("Maven", "pom.xml"))),
    ("test_framework", "pytest", "pytest", "lower"), ("test_framework", "unittest", "unittest", "lower"), ("test_framework", "Jest", "jest", "lower"), ("test_framework", "Mocha", "mocha", "lower"),
    ("documentation", "README", "README", "upper"), ("documentation", "docs/ directory", "docs/", "exact"), ("documentation", "Markdown files", ".md", "exact"),
    *(("configuration", f, f, "exact") for f in (".gitignore", ".gitattributes", ".editorconfig", ".prettierrc", "eslint.config.js")),
    *(("linter", t, t, "lower") for t in ("pylint", "flake8")),
    *(("formatter", t, t, "lower") for t in ("black", "isort")),
    *(("static_analyzer", t, t, "lower") for t in ("mypy", "bandit", "safety")),
    *(("quality_config", f, f, "exact") for f in (
        ".pylintrc", "setup.cfg", "pyproject.toml", "tox.ini", ".flake8", ".pre-commit-config.yaml", ".prettierrc", "eslint.config.js", "tsconfig.json")),
    ("pre_commit", "pre-commit", ".pre-commit-config", "exact"),
    *(("security_scanner", t, t, "lower") for t in ("bandit", "safety", "trivy", "snyk", "owasp", "dependabot", "sonar", "checkov", "semgrep", "codeql")),
    ("security_policy", "SECURITY.md", "security.md", "lower"), ("security_policy", ".secrets", ".secrets", "lower"), ("security_policy", "security.txt", "security.txt", "lower"),
    ("security_policy", ".github/security", ".github/security", "lower"), ("security_policy", "security-policy.md", "security-policy.md", "lower"),
    *(("secret_scanning", w, w, "lower") for w in ("secret", "credential")),
    *(("ci_platform", label, needle, "exact") for needle, label in (
        (".github/workflows", "GitHub Actions"), (".gitlab-ci.yml", "GitLab CI"), ("Jenkinsfile", "Jenkins"), ("azure-pipelines.yml", "Azure DevOps"),
        ("bitbucket-pipelines.yml", "Bitbucket Pipelines"), (".travis.yml", "Travis CI"), ("circle.yml", "CircleCI"))),
    *(("build_automation", f, f, "exact") for f in ("Makefile", "build.gradle", "pom.xml", "package.json", "Dockerfile")),
    *(("automation_script", f, f, "exact") for f in ("scripts/", "tools/", ".sh", ".ps1", ".bat")),
    *(("document", f, f, "upper") for f in ("README", "CONTRIBUTING", "CODE_OF_CONDUCT", "LICENSE", "CHANGELOG")),
    *(("api_docs", f, f, "lower") for f in ("docs/", "api.md", "swagger", "openapi")),
    *(("documentation_tool", f, f, "lower") for f in ("sphinx", "mkdocs", "docusaurus", "gitbook", "readthedocs")),
    *(("dependency_file", f, f, "exact") for f in (
        "requirements.txt", "pyproject.toml", "Pipfile", "poetry.lock", "package.json", "yarn.lock", "package-lock.json", "Gemfile", "Gemfile.lock",
        "Cargo.toml", "Cargo.lock", "pom.xml", "build.gradle")),
    *(("lock_file", f, f, "exact") for f in (
        "requirements-lock.txt", "poetry.lock", "yarn.lock", "package-lock.json", "Gemfile.lock", "Cargo.lock", "gradle.lockfile")),
    *(("dependency_scanning", f, f, "lower") for f in ("dependabot", "renovate")),
    *(("legal", f, f, "upper") for f in ("LICENSE", "COPYING", "NOTICE", "PATENTS", "DCO", "CLA")),
    *(("coverage_tool", f, f, "lower") for f in ("coverage.py", "pytest-cov", "nyc", "istanbul")),
)


def has(path: Column, *needles: str) -> Column:
    return reduce(lambda a, b: a | b, [path.contains(n) for n in needles])


def extension(path: Column) -> Column:
    """The extension in lower case; a name that only starts with a dot has none."""
    return F.lower(F.regexp_extract(path, r"(^|/)[.]*[^./][^/]*([.][^./]*)$", 2))


def language(path: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.coalesce(F.try_element_at(names, extension(path)), F.lit("Unknown"))


def normal(path: Column) -> Column:
    """The path without leading ``./`` and doubled slashes."""
    return F.regexp_replace(F.regexp_replace(path, "/([.]?/)+", "/"), "^([.]/)+", "")


def is_test(path: Column) -> Column:
    low = F.lower(path)
    return has(low, "test", "spec") & ~has(low, "node_modules", ".git", "__pycache__")


def test_kind(path: Column) -> Column:
    low = F.lower(path)
    return F.when(has(low, "unit", "test_"), "unit").when(has(low, "int"), "integration").when(has(low, "e2e", "end_to_end"), "e2e").otherwise("other")


def ends(path: Column, suffixes: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [path.endswith(s) for s in suffixes])


def comment_lines(path: Column, content: Column) -> Column:
    """Lines that are comments in the language of the file."""
    lines = F.transform(F.split(content, "\n"), F.trim)
    hashes = F.size(F.filter(lines, lambda x: x.startswith("#")))
    slashes = F.size(F.filter(lines, lambda x: x.startswith("//") | x.startswith("/*") | x.contains("*/")))
    return F.when(ends(path, (".py", ".rb")), hashes).when(ends(path, (".js", ".ts", ".java", ".c", ".cpp", ".go", ".rs", ".php")), slashes).otherwise(0)


def signals(files: DataFrame) -> DataFrame:
    """Rows ``(repo, grp, label)`` of the signals that any path of a repository holds."""
    cased = {"exact": F.col("path"), "lower": F.lower("path"), "upper": F.upper("path")}
    flags = [F.bool_or(cased[mode].contains(needle)).alias(f"f{i}") for i, (_, _, needle, mode) in enumerate(SIGNALS)]
    found = [F.when(F.col(f"f{i}"), F.struct(F.lit(g).alias("grp"), F.lit(label).alias("label"))) for i, (g, label, _, _) in enumerate(SIGNALS)]
    return files.groupBy("repo").agg(*flags).select("repo", F.explode(F.array_compact(F.array(*found))).alias("s")).select("repo", "s.*")


def file_counts(files: DataFrame) -> DataFrame:
    """Distinct normal paths of each repository: all, and code, test, configuration and documentation among them."""
    paths = files.select("repo", F.lower(normal(F.col("path"))).alias("p"), normal(F.col("path")).alias("path")).dropDuplicates(["repo", "path"])
    ext = extension(F.col("p"))
    return paths.groupBy("repo").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(ext.isin(*CODE)).alias("code"), F.count_if(F.col("p").contains("test")).alias("test"),
        F.count_if(ext.isin(*CONFIG)).alias("config"), F.count_if(has(F.col("p"), "readme", "docs") | (ext == ".md")).alias("docs"),
    )


def untested_modules(files: DataFrame) -> DataFrame:
    """Python files without a test file named after them: an equal join on the
    names that test paths hold, not a search of every test for every module."""
    tests = files.filter(is_test(F.col("path"))).select("repo", F.explode(F.regexp_extract_all("path", F.lit("(?=test_(.+?)[.]py)"), 1)).alias("stem"))
    modules = files.filter(F.col("path").endswith(".py")).select("repo", "path", F.regexp_extract("path", "([^/]+)[.]py$", 1).alias("stem"))
    return modules.join(tests.distinct(), ["repo", "stem"], "left_anti").select("repo", "path")
