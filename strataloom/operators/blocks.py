"""Clone detection over blocks of six lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 6
#: Extensions, and what a comment line of such files begins with or holds.
COMMENTS = (
    ((".py", ".rb"), ("#",), ()),
    ((".js", ".jsx", ".ts", ".tsx", ".java", ".cpp", ".c", ".cs", ".php", ".go", ".rs"), ("//", "/*"), ("*/",)),
    ((".html", ".xml"), ("<!--",), ()),
)
INDENT = r"^[ \t\r\f]*"


def blocks(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """Each run of ``size`` lines of a document that aren't blank, and its
    digest. Runs are cut inside the row of their text, so no text is shuffled."""
    numbered = F.transform(F.split("text", "\n"), lambda line, i: F.struct(F.trim(line).alias("line"), (i + 1).alias("line_no")))
    full = docs.select("doc_id", "source", F.filter(numbered, lambda x: x["line"] != "").alias("full")).filter(F.size("full") >= size)

    def run(i):
        return F.struct(
            F.element_at("full", i)["line_no"].alias("line_no"),
            F.array_join(F.transform(F.slice("full", i, size), lambda x: x["line"]), "\n").alias("text"),
        )

    # Outer, as the planner would make all runs twice, first for their number.
    rows = full.select("doc_id", "source", F.explode_outer(F.transform(F.sequence(F.lit(1), F.size("full") - size + 1), run)).alias("run"))
    return rows.filter(F.length("run.text") >= 10).select("doc_id", "source", "run.line_no", F.md5("run.text").alias("digest"))


def digests(lines: Column, size: int = BLOCK) -> Column:
    """Digests of all runs of ``size`` lines that aren't blank, as an array."""
    full = F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")
    # The array of one binds the lines that aren't blank, so that they are made once.
    runs = lambda xs: F.transform(F.sequence(F.lit(1), F.size(xs) - size + 1), lambda i: F.array_join(F.slice(xs, i, size), "\n"))
    texts = F.flatten(F.transform(F.filter(F.array(full), lambda xs: F.size(xs) >= size), runs))
    return F.transform(F.filter(texts, lambda t: F.length(t) >= 10), F.md5)


def stripped(line: Column) -> Column:
    return F.regexp_replace(line, r"^[ \t\r\f]+|[ \t\r\f]+$", "")


def is_comment(path: Column, line: Column) -> Column:
    """Whether a stripped line is a comment in the language of its file."""
    either = lambda tests: reduce(lambda a, b: a | b, tests)
    kinds = [either([path.endswith(e) for e in ends]) & either([line.startswith(b) for b in begins] + [line.contains(h) for h in holds]) for ends, begins, holds in COMMENTS]
    return either(kinds)


def code_blocks(files: DataFrame, size: int = BLOCK, least: int = 10) -> DataFrame:
    """Each run of ``size`` lines of code of ``files(repo, path, content)``: its
    place from 0, the digest of its normal form, and whether that holds a token.

    Blank and comment lines don't count; the normal form strips lines and rounds
    their indentation down to a multiple of four. Blocks of equal digest hold
    equal tokens, so their Jaccard similarity is 1, or 0 where they hold none:
    ``has_token`` is all that is left of comparing the members of a group.
    """
    indent = lambda x: F.repeat(F.lit(" "), (F.floor(F.length(F.regexp_extract(x, INDENT, 0)) / 4) * 4).cast("int"))
    told = F.transform(F.split("content", "\n"), lambda x: F.struct(x.alias("line"), stripped(x).alias("bare")))
    kept = F.filter(told, lambda x: (x["bare"] != "") & ~is_comment(F.col("path"), x["bare"]))
    normal = F.transform(kept, lambda x: F.struct(F.length(x["line"]).alias("n"), F.concat(indent(x["line"]), x["bare"]).alias("normal")))

    def run(xs, i):
        own = F.slice(xs, i + 1, size)
        n = F.aggregate(own, F.lit(size - 1), lambda sum_, x: sum_ + x["n"])
        return F.struct(i.alias("place"), n.alias("n"), F.array_join(F.transform(own, lambda x: x["normal"]), "\n").alias("text"))

    # The array of one binds the lines of a file, which each of its runs would make anew.
    every = lambda xs: F.transform(F.sequence(F.lit(0), F.size(xs) - size), lambda i: run(xs, i))
    made = F.flatten(F.transform(F.filter(F.array(normal), lambda xs: F.size(xs) >= size), every))
    runs = files.select("repo", "path", F.explode_outer(made).alias("run")).filter(F.col("run.n") >= least)
    return runs.select("repo", "path", "run.place", F.md5("run.text").alias("digest"), F.col("run.text").rlike(r"\w\w").alias("has_token"))


def clones(blocks: DataFrame) -> DataFrame:
    """The places of each file's blocks that occur more than once in the
    repository, with the occurrences of the group and the files it affects.

    Blocks are combined by file before they meet, so a group holds one row a
    file; the list of places is bounded by its file.
    """
    by_file = blocks.filter("has_token").groupBy("repo", "digest", "path").agg(F.count(F.lit(1)).alias("own"), F.array_sort(F.collect_list("place")).alias("places"))
    totals = by_file.groupBy("repo", "digest").agg(F.sum("own").alias("occurrences"), F.count(F.lit(1)).alias("files")).filter("occurrences > 1")
    return by_file.join(totals, ["repo", "digest"])
