"""Facts of the syntax trees of Python files: style, variables and calls.

Files are parsed in Arrow batches, a row each; what is told of a repository is
aggregated in the JVM. Files that can't be parsed tell nothing.
"""

from __future__ import annotations

import ast
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Modules that count as Python's own.
STANDARD = (
    "abc", "argparse", "ast", "asyncio", "base64", "collections", "contextlib", "copy", "csv", "datetime", "enum", "functools", "hashlib", "heapq", "html", "http", "inspect", "io",
    "itertools", "json", "logging", "math", "os", "pathlib", "pickle", "platform", "random", "re", "shutil", "socket", "sqlite3", "ssl", "string", "subprocess", "sys", "tempfile",
    "threading", "time", "typing", "unittest", "urllib", "uuid", "warnings", "weakref", "xml", "zipfile",
)
MODULE = "<module>"


def parsed(text: str | None) -> ast.Module | None:
    try:
        return ast.parse(text or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def origin(module: str | None, local: bool) -> str:
    if (module or "").split(".")[0] in STANDARD:
        return "standard"
    return "own" if local else "others"


def style_facts(tree: ast.Module) -> list[tuple]:
    """One row of counts; ``parted`` tells whether lines lie between imports, null without any."""
    n, lines = defaultdict(int), []
    for node in ast.walk(tree):
        if isinstance(node, ast.FunctionDef):
            n["functions"] += 1
            n["private"] += node.name.startswith("_")
            n["told"] += bool(ast.get_docstring(node))
        elif isinstance(node, ast.ClassDef):
            n["classes"] += 1
            n["pascal"] += node.name[0].isupper()
        elif isinstance(node, ast.Import):
            lines.append(node.lineno)
            for a in node.names:
                n[origin(a.name, "." in a.name)] += 1
        elif isinstance(node, ast.ImportFrom):
            lines.append(node.lineno)
            n[origin(node.module, node.level > 0)] += 1
    lines.sort()
    parted = float(any(b - a > 1 for a, b in zip(lines, lines[1:], strict=False))) if lines else None
    return [(*(n[c] for c in COUNTS), parted)]


def variable_facts(tree: ast.Module) -> list[tuple]:
    """(name, lines of definitions, lines of uses) of each name that is set or read."""
    seen: dict[str, tuple[list, list]] = {}
    for node in ast.walk(tree):
        if isinstance(node, ast.Name) and not isinstance(node.ctx, ast.Del):
            seen.setdefault(node.id, ([], []))[isinstance(node.ctx, ast.Load)].append(node.lineno)
    return [(name, sorted(stored), sorted(read)) for name, (stored, read) in seen.items()]


def callee(node: ast.expr) -> str:
    parts = []
    if not isinstance(node, ast.Name | ast.Attribute):
        return ast.dump(node)
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        parts.append(node.id)
    return ".".join(reversed(parts))


def call_facts(tree: ast.Module) -> list[tuple]:
    """(caller, callee, line); callers are joined by ``+`` with what holds them."""
    out, todo = [], [(tree, MODULE)]
    while todo:
        held, where = todo.pop()
        for node in ast.iter_child_nodes(held):
            inside = where
            if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                inside = node.name if where == MODULE else f"{where}+{node.name}"
            elif isinstance(node, ast.Call):
                out.append((where, callee(node.func), node.lineno))
            todo.append((node, inside))
    return out


COUNTS = ("functions", "private", "told", "classes", "pascal", "standard", "others", "own")
_STYLE = [(c, pa.int64()) for c in COUNTS] + [("parted", pa.float64())]
_VARIABLES = [("name", pa.string()), ("defined", pa.list_(pa.int32())), ("used", pa.list_(pa.int32()))]
_CALLS = [("caller", pa.string()), ("callee", pa.string()), ("line", pa.int32())]


def _facts(files: DataFrame, of: Callable, fields: list[tuple], ddl: str) -> DataFrame:
    schema = pa.schema([("repo", pa.string()), ("path", pa.string()), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for repo, path, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tree = parsed(text)
                if tree is not None:
                    rows += [(repo, path, *fact) for fact in of(tree)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return files.filter(F.col("path").endswith(".py")).select("repo", "path", "content").mapInArrow(run, f"repo string, path string, {ddl}")


def variables(files: DataFrame) -> DataFrame:
    return _facts(files, variable_facts, _VARIABLES, "name string, defined array<int>, used array<int>")


def calls(files: DataFrame) -> DataFrame:
    return _facts(files, call_facts, _CALLS, "caller string, callee string, line int")


def style(files: DataFrame) -> DataFrame:
    """Preferences of each repository; null where nothing tells of them."""
    facts = _facts(files, style_facts, _STYLE, ", ".join(f"{c} long" for c in COUNTS) + ", parted double")
    n = facts.groupBy("repo").agg(*(F.sum(c).alias(c) for c in COUNTS), F.avg("parted").alias("parted"))
    over = lambda part, whole, bound, yes, no: F.when(F.col(whole) > 0, F.when(F.col(part) / F.col(whole) > bound, yes).otherwise(no))
    return n.select(
        "repo", "functions", over("private", "functions", 0.3, "prefers_private", "balanced").alias("function_naming"), over("told", "functions", 0.7, "well_documented", "minimal").alias("documentation"),
        over("pascal", "classes", 0.8, "pascal_case", "mixed").alias("class_naming"), F.when(F.col("parted") > 0.5, "separated").when(F.col("parted").isNotNull(), "mixed").alias("import_grouping"),
        "standard", "others", "own",
    )
