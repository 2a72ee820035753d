"""Scalar helpers that the analyses share, as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def level(value: Column, steps: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """The label of the first threshold that ``value`` reaches."""
    out = None
    for bound, label in steps:
        out = F.when(value >= bound, label) if out is None else out.when(value >= bound, label)
    return out.otherwise(otherwise)


def share(part: Column, whole: Column) -> Column:
    """``part / whole``, 0 where the whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def wilson(successes: Column, n: Column, z: float = 3.291) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval, cut to 0 and 1."""
    p, z2 = share(successes, n), z * z
    centre = p + z2 / (2 * n)
    spread = z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    scale = 1 + z2 / n
    return F.greatest(F.lit(0.0), (centre - spread) / scale), F.least(F.lit(1.0), (centre + spread) / scale)


def p95_nearest(sorted_values: Column) -> Column:
    """Element number ``int(0.95 n)``, counted from 0."""
    return F.element_at(sorted_values, (F.floor(F.size(sorted_values) * 0.95) + 1).cast("int"))


def p95_exclusive(sorted_values: Column) -> Column:
    """The 19th of 20 exclusive quantiles; it may lie beyond the largest value."""
    n = F.size(sorted_values)
    j = F.greatest(F.lit(1), F.least(n - 1, F.floor(19 * (n + 1) / 20).cast("int")))
    d = 19 * (n + 1) - 20 * j
    return F.when(n >= 2, (F.element_at(sorted_values, j) * (20 - d) + F.element_at(sorted_values, j + 1) * d) / 20)


# Words are runs of ASCII letters, digits and _, as engines agree on them; their
# word boundaries differ beside other letters.
WORD = "[A-Za-z0-9_]+"
#: Words that open a branch (fixed values).
BRANCHES = ("if", "elif", "for", "while", "and", "or", "case")


def cyclomatic(text: Column) -> Column:
    """One more than the branches of a text."""
    return (1 + F.size(F.filter(F.regexp_extract_all(text, F.lit(WORD), 0), lambda x: x.isin(*BRANCHES)))).cast("long")


def nesting(lines: Column) -> Column:
    """The deepest indentation of lines, in steps of four blanks."""
    return F.array_max(F.transform(lines, lambda x: F.floor((F.length(x) - F.length(F.ltrim(x))) / 4)))


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def entropy(counts: Column) -> Column:
    """Shannon entropy to base 2 of an array of counts."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(counts, F.lit(0.0), lambda a, x: a - x / total * F.log2(x / total))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; 0 where either is empty."""
    either = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / either).otherwise(0.0)
