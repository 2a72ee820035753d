"""Symbols and imports of source files.

Python files are parsed (Arrow batches, the one place that needs Python code);
other languages are searched with regular expressions in one scan.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS_DDL = "rel_path string, lang string, kind string, name string, line int, is_method boolean, complexity int"
#: Fixed values: (language, kind, pattern whose first group is the name).
PATTERNS = (
    ("javascript", "function", r"function\s+(\w+)\s*\("),
    ("javascript", "function", r"const\s+(\w+)\s*=\s*\("),
    ("javascript", "function", r"const\s+(\w+)\s*=\s*(\w+)\s*=>\s*\{"),
    ("javascript", "function", r"(\w+)\s*\([^)]*\)\s*\{"),
    ("javascript", "class", r"class\s+(\w+)"),
    ("javascript", "import", r"""import\s+.*?\s+from\s+['"]([^'"]+)['"]"""),
    ("javascript", "export", r"export\s+(?:const|function|class)?\s*(\w+)"),
    ("javascript", "component", r"function\s+(\w+)\s*\([^)]*\)\s*\{[^}]*return\s*\("),
    ("javascript", "component", r"const\s+(\w+)\s*=\s*\([^)]*\)\s*=>\s*\("),
    ("typescript", "interface", r"interface\s+(\w+)"),
    ("typescript", "type", r"type\s+(\w+)"),
    ("java", "package", r"package\s+([^;]+);"),
    ("java", "import", r"import\s+([^;]+);"),
    ("java", "class", r"class\s+(\w+)"),
    ("java", "interface", r"interface\s+(\w+)"),
    ("java", "enum", r"enum\s+(\w+)"),
    ("java", "method", r"\w+\s{2,}(\w+)\s*\([^)]*\)"),
    ("java", "annotation", r"(@\w+)"),
)
#: Beginnings that are statements, not functions.
STATEMENTS = {"function": ("if", "for", "while", "catch"), "method": ("if", "for", "while")}
#: Kinds that are kept once a file.
DISTINCT = ("import", "export", "interface", "type", "package", "annotation")
BRANCHES = (ast.If, ast.For, ast.While, ast.And, ast.Or)


def language(path: Column) -> Column:
    ends = lambda *e: F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)).isin(*e)
    return F.when(ends(".py"), "python").when(ends(".js", ".jsx"), "javascript").when(ends(".ts", ".tsx"), "typescript").when(ends(".java"), "java").otherwise("unknown")


def python_symbols(text: str) -> list[tuple]:
    """(kind, name, line, complexity) of a module: classes and functions that no
    other class or function holds, and imports. Unreadable files have none."""
    try:
        todo = [ast.parse(text)]
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out = []
    while todo:
        for node in ast.iter_child_nodes(todo.pop()):
            if isinstance(node, ast.ClassDef):
                out.append(("class", node.name, node.lineno, None))
            elif isinstance(node, ast.FunctionDef):
                out.append(("function", node.name, node.lineno, 1 + sum(isinstance(n, BRANCHES) for n in ast.walk(node))))
            elif isinstance(node, ast.Import):
                out += [("import", a.name, node.lineno, None) for a in node.names]
            elif isinstance(node, ast.ImportFrom):
                out += [("import", f"{node.module}.{a.name}" if node.module else a.name, node.lineno, None) for a in node.names]
            else:
                todo.append(node)
    return out


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.int32())
    names = [c.split()[0] for c in SYMBOLS_DDL.split(", ")]
    for batch in batches:
        rows = [
            (path, "python", kind, name, line, False, complexity)
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for kind, name, line, complexity in python_symbols(text or "")
        ]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _not_like(pattern: str) -> Callable[[Column], Column]:
    return lambda n: ~n.rlike(pattern)


def _named(kind: str) -> Callable[[Column], Column]:
    return lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name"))


def _found(content: Column, own: Column) -> Column:
    """All matches of a file's language as structs (kind, name)."""
    lists = []
    for lang, kind, pattern in PATTERNS:
        # Words are those of Unicode.
        names = F.regexp_extract_all(content, F.lit(f"(?U){pattern}"), 1)
        if kind == "package":
            names = F.slice(names, 1, 1)
        if kind in DISTINCT:
            names = F.array_distinct(names)
        if kind in STATEMENTS:
            names = F.filter(names, _not_like(f"^({'|'.join(STATEMENTS[kind])})"))
        if kind == "method":
            names = F.filter(names, lambda n: ~n.isin("class", "interface", "enum"))
        holds = own.isin("javascript", "typescript") if lang == "javascript" else own == lang
        none = F.array().cast("array<struct<kind:string,name:string>>")
        lists.append(F.when(holds, F.transform(names, _named(kind))).otherwise(none))
    return F.flatten(F.array(*lists))


def symbols(files: DataFrame) -> DataFrame:
    """Symbols of ``files(rel_path, content)``. Lines are 0 where a regular
    expression found the symbol; other languages have none."""
    rows = files.select("rel_path", "content").withColumn("lang", language(F.col("rel_path")))
    parsed = rows.filter("lang = 'python'").select("rel_path", "content").mapInArrow(_parsed, SYMBOLS_DDL)
    searched = rows.filter(F.col("lang").isin("javascript", "typescript", "java")).select("rel_path", "lang", F.explode(_found(F.col("content"), F.col("lang"))).alias("s"))
    return parsed.unionByName(
        searched.select("rel_path", "lang", "s.kind", "s.name", F.lit(0).alias("line"), F.lit(False).alias("is_method"), F.lit(None).cast("int").alias("complexity"))
    )


def imports(found: DataFrame) -> DataFrame:
    """Distinct imports of each language."""
    return found.filter("kind = 'import'").select("lang", F.col("name").alias("module")).distinct()


def untested(found: DataFrame, files: DataFrame) -> DataFrame:
    """Python modules without a file ``test_<module>.py``."""
    name = F.regexp_extract("rel_path", r"([^/]+)\.py$", 1)
    is_test = F.col("rel_path").rlike("(?i)test|spec")
    tests = files.filter(is_test).select(name.alias("name")).filter(F.col("name").startswith("test_")).distinct()
    modules = files.filter(F.col("rel_path").endswith(".py") & ~is_test).select("rel_path", F.concat(F.lit("test_"), name).alias("name"))
    return modules.join(tests, "name", "left_anti").select("rel_path")
