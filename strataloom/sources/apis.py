"""Endpoints that API descriptions and source code declare."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ("path", "method", "description", "parameters", "responses", "security", "source", "file")
METHODS = ("GET", "POST", "PUT", "DELETE", "PATCH")
#: File names and endings of API descriptions.
KINDS = (
    ("openapi", ("openapi.yaml", "openapi.yml", "swagger.yaml", "swagger.yml"), ()),
    ("postman", (), (".postman_collection.json",)),
    ("insomnia", (), (".insomnia.json",)),
    ("graphql", ("schema.graphql",), (".graphql",)),
    ("raml", (), (".raml",)),
    ("api_blueprint", (), (".apib",)),
)
#: Framework, pattern of a route, its method; no method: the first group in upper case, before the path.
ROUTES = (
    ("flask", r"""@app\.route\(["']([^"']+)["']""", "GET"),
    ("flask", r"""@app\.route\(["']([^"']+)["'], methods=\[([^\]]+)\]""", None),
    ("django", r"""path\(["']([^"']+)["']""", "GET"),
    ("django", r"""url\(["']([^"']+)["']""", "GET"),
    ("express", r"""app\.(get|post|put|delete)\(["']([^"']+)["']""", None),
    ("spring", r"""@RequestMapping\(["']([^"']+)["']""", "GET"),
    ("spring", r"""@GetMapping\(["']([^"']+)["']""", "GET"),
    ("spring", r"""@PostMapping\(["']([^"']+)["']""", "POST"),
)


def api_kind(path: Column) -> Column:
    """The kind of API description a file name tells, null for other files."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    out = None
    for kind, names, ends in KINDS:
        holds = name.isin(*names) if names else F.lit(False)
        for e in ends:
            holds = holds | name.endswith(e)
        out = F.when(holds, kind) if out is None else out.when(holds, kind)
    return out


def _endpoint(rows: DataFrame, **given: Column) -> DataFrame:
    none = F.array().cast("array<string>")
    default = {"description": F.lit(""), "parameters": none, "responses": none, "security": none, "file": F.col("rel_path")}
    return rows.select(*((default | given)[c].alias(c) for c in COLUMNS))


#: Nodes of a YAML description, aliases resolved, beyond which it is refused.
NODES = 1_000_000


def _sized(value, left: int = NODES) -> int:
    """How many nodes are left of ``left``; aliases count each time."""
    todo = [value]
    while todo:
        left -= 1
        if left < 0:
            raise ValueError(f"an API description has over {NODES} nodes")
        x = todo.pop()
        todo += x.values() if isinstance(x, dict) else x if isinstance(x, list) else ()
    return left


def as_json(text: str | None) -> str | None:
    """A description in YAML as JSON; null where it is neither. Aliases are
    resolved; a description that grows over ``NODES`` nodes so raises an error,
    as does one in YAML where no reader of YAML is installed."""
    if not text:
        return None
    try:
        if text.lstrip().startswith("{"):
            json.loads(text)
            return text
    except (ValueError, RecursionError):
        pass
    import yaml

    try:
        told = yaml.safe_load(text)
    except (yaml.YAMLError, RecursionError):
        return None
    _sized(told)
    try:
        return json.dumps(told, default=str)
    except (ValueError, TypeError, RecursionError):  # an alias of itself, or keys that JSON lacks
        return None


def _as_json(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [as_json(text) for text in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["rel_path", "content"])


def openapi(files: DataFrame) -> DataFrame:
    """Operations of OpenAPI descriptions in JSON or YAML. Parameters and security stay JSON texts."""
    files = files.select("rel_path", "content").mapInArrow(_as_json, "rel_path string, content string")
    one = "struct<description:string,parameters:array<string>,responses:map<string,string>,security:array<string>>"
    # Members of a path that are no operations, such as shared parameters, stay texts until their names are known.
    spec = F.from_json("content", "struct<paths:map<string,map<string,string>>>")
    rows = files.select("rel_path", F.explode(spec["paths"]).alias("path", "members"))
    rows = rows.select("rel_path", "path", F.explode("members").alias("method", "details")).filter(F.upper("method").isin(*METHODS))
    rows = rows.withColumn("d", F.from_json("details", one))
    empty = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    return _endpoint(
        rows, path=F.col("path"), method=F.upper("method"), description=F.coalesce("d.description", F.lit("")), parameters=empty(F.col("d.parameters")),
        responses=empty(F.map_keys("d.responses")), security=empty(F.col("d.security")), source=F.lit("openapi"),
    )


def postman_requests(text: str) -> list[tuple[str, str, str]]:
    """(path, method, name) of a collection's requests, folders included, in order."""
    try:
        todo = list(reversed(json.loads(text).get("item", [])))
    except (ValueError, AttributeError, TypeError, RecursionError):
        return []
    out = []
    while todo:
        item = todo.pop()
        if not isinstance(item, dict):
            continue
        request = item.get("request")
        if isinstance(request, dict):
            url = request.get("url", {})
            path = url["raw"] if isinstance(url, dict) and "raw" in url else str(url)
            out.append((str(path), str(request.get("method", "GET")), str(item.get("name", ""))))
        if isinstance(item.get("item"), list):
            todo += reversed(item["item"])
    return out


def _requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["rel_path", "path", "method", "name"]
    for batch in batches:
        rows = [(f, *r) for f, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in postman_requests(text or "")]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in columns], names=names)


def postman(files: DataFrame) -> DataFrame:
    """Requests of Postman collections; folders nest without bound, so they are walked in Python."""
    rows = files.select("rel_path", "content").mapInArrow(_requests, "rel_path string, path string, method string, name string")
    return _endpoint(rows, path=F.col("path"), method=F.col("method"), description=F.col("name"), source=F.lit("postman"))


def graphql(files: DataFrame) -> DataFrame:
    """Fields with arguments of the root types of GraphQL schemas."""
    block = F.explode(F.regexp_extract_all("content", F.lit(r"(?s)(type\s+\w+\s*\{[^}]*\})"), 1)).alias("block")
    rows = files.select("rel_path", block)
    rows = rows.select("rel_path", F.regexp_extract("block", r"^type\s+(\w+)", 1).alias("type"), F.explode(F.split(F.regexp_extract("block", r"(?s)\{([^}]*)\}", 1), "\n")).alias("line"))
    field = r"^\s*(\w+)\s*\([^)]*\)\s*:\s*(\w+)"
    rows = rows.filter(F.col("type").isin("Query", "Mutation", "Subscription") & F.col("line").rlike(field))
    name = F.regexp_extract("line", field, 1)
    return _endpoint(
        rows, path=F.concat(F.lit("/"), F.lower("type"), F.lit("/"), name), method=F.lit("GRAPHQL"), description=F.concat_ws(" ", "type", name),
        responses=F.array(F.regexp_extract("line", field, 2)), source=F.lit("graphql"),
    )


def _route(framework: str, method: str | None) -> Callable[..., Column]:
    def made(way: Column, path: Column) -> Column:
        return F.struct(F.lit(framework).alias("framework"), way.alias("method"), path.alias("path"))

    return (lambda m, p: made(F.upper(m), p)) if method is None else (lambda p: made(F.lit(method), p))


def routes(files: DataFrame) -> DataFrame:
    """Routes that web frameworks' calls declare in code. A pattern without a
    method takes its first group as the method, also where that is a path."""
    lists = []
    for framework, pattern, method in ROUTES:
        groups = [F.regexp_extract_all("content", F.lit(pattern), g) for g in ((1, 2) if method is None else (1,))]
        made = F.zip_with(*groups, _route(framework, None)) if method is None else F.transform(groups[0], _route(framework, method))
        lists.append(made)
    code = files.filter(F.regexp_extract("rel_path", r"(\.[^./]+)$", 1).isin(".py", ".js", ".java"))
    rows = code.select("rel_path", F.explode(F.flatten(F.array(*lists))).alias("r"))
    return _endpoint(
        rows, path=F.col("r.path"), method=F.col("r.method"), description=F.concat(F.lit("Detected in "), F.col("rel_path")), source=F.concat(F.lit("code_"), F.col("r.framework"))
    )


def endpoints(files: DataFrame) -> DataFrame:
    """Endpoints of API descriptions; only in repositories (``repo``, if there is
    such a column) without any of these, routes of the code."""
    files = files if "repo" in files.columns else files.withColumn("repo", F.lit(""))
    described = files.withColumn("kind", api_kind(F.col("rel_path"))).filter(F.col("kind").isNotNull())
    code = files.join(described.select("repo").distinct(), "repo", "left_anti")
    of = lambda k: described.filter(F.col("kind") == k)
    return openapi(of("openapi")).unionByName(postman(of("postman"))).unionByName(graphql(of("graphql"))).unionByName(routes(code))
