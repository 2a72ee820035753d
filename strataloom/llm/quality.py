"""Quality rules with risk-controlled thresholds.

Fixed base rules come first. Further rules compare a feature of a document with
a cutoff per stratum (language); a document is rejected if any rule fires. The
cutoffs of all rules of a stratum form one sequence, from none to the
strictest, whose order is proposed by the bad documents and a quarter of the
good ones: next come the steps that catch most bad for each good document, as
long as they catch more bad than good. The other good labels test the sequence
in order, each time by the exact binomial test of "the share of good documents
that are rejected is at most ``risk``" at level ``delta / strata``. The last
cutoffs that pass before the first failure are used. So with probability 1 -
``delta`` the rules falsely reject at most ``risk`` of the good documents of
each stratum.

No test can pass on fewer than ``log(delta / strata) / log(1 - risk)`` good
labels, which is 183 for four strata and so about 244 with the quarter. Strata
below that are pooled to one, for which the guarantee holds as a whole; where
the pool is below it too, only the base rules act on them.

Edge cases: a null text has no words and fails the base rules, like an empty
one; a null language is a stratum of its own; repeated rows are judged alike;
labels that are null, or of documents that are missing, are unused; an empty
table gives an empty result; with no labels only the base rules apply; further
columns of any name stay as they are in ``keep_good`` and unread in ``judge``; a
text of any length is judged whole; a row without an id has no label.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import exp, lgamma, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.llm.common import WORD_SPACE, discard, mapped, slices, store, text_bytes

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
SYMBOLS = b"#*$%&|<>"
#: Share of good documents of a stratum that learned cutoffs may reject.
RISK = 0.02
#: Chance that the guarantee fails in any stratum.
DELTA = 0.1
#: One good label in so many proposes the order of cutoffs; the others test it.
PROPOSE = 4
#: Features are compared on a grid of this many steps from 0 to 1.
STEPS = 256
#: Name of each learned rule: a document is rejected at or above its cutoff.
RULES = ("symbol_ratio", "shout_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio")
#: Texts longer than this many words are compared by sorted arrays, not sets.
LONG = 200_000

STATS = {
    "n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(),
    "n_repeat_words": pa.int64(), "symbol_ratio": pa.float64(), "shout_ratio": pa.float64(),
    "dup_line_ratio": pa.float64(), "repeat_ratio": pa.float64(), "upper_ratio": pa.float64(),
}
_DDL = {pa.int64(): "long", pa.float64(): "double"}
STATS_DDL = ", ".join(f"{k} {_DDL[v]}" for k, v in STATS.items())

_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
_NOT_LETTERS = bytes(set(range(256)) - set(_LETTERS))
_NOT_UPPER = bytes(set(range(256)) - set(range(65, 91)))


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words that lie in a window of ``width`` words found twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    if n > LONG:
        numbers: dict[bytes, int] = {}
        ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
        rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(ids.astype(np.int32), width))
        _, where, counts = np.unique(rows.view(f"V{4 * width}").ravel(), return_inverse=True, return_counts=True)
        starts = np.flatnonzero(counts[where.ravel()] > 1)
    else:
        windows = list(zip(*(words[i:] for i in range(width)), strict=False))
        if len(set(windows)) == n:
            return 0
        counts = Counter(windows)
        starts = [i for i, w in enumerate(windows) if counts[w] > 1]
    covered = end = 0
    for i in starts:
        covered += i + width - max(i, end)
        end = i + width
    return int(covered)


def text_stats(data: bytes) -> tuple:
    """The figures of ``STATS`` for one text in UTF-8."""
    words = data.split()
    n = len(words)
    letters_only = data.translate(None, WORD_SPACE)
    chars = len(letters_only.decode("utf-8")) if not letters_only.isascii() else len(letters_only)
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip()]
    duplicates = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    ascii_letters = len(data.translate(None, _NOT_LETTERS))
    upper = len(data.translate(None, _NOT_UPPER))
    return (
        n, chars, symbols, duplicates, repeats, symbols / max(chars, 1), data.count(b"!") / max(chars, 1),
        duplicates / max(len(lines), 1), repeats / max(n, 1), upper / max(ascii_letters, 1),
    )


def with_stats(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with the columns of ``STATS`` of each whole text."""
    keep = docs.columns if keep is None else keep
    taken = [c for c in STATS if c in keep]
    if taken:
        raise ValueError(f"columns {taken} clash with statistics; rename them or leave them out of keep")
    source = docs.select(*keep, docs[text].alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [text_stats(x or b"") for x in text_bytes(batch.column(batch.num_columns - 1))]
            stats = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), STATS.values(), strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:-1] + stats, names=[*keep, *STATS])

    return mapped(source, run, ", ".join(x for x in (schema, STATS_DDL) if x))


def base_failed() -> Column:
    n, repeats = F.col("n_words"), F.col("n_repeat_words")
    return (n < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial with n trials of chance p, exactly summed."""
    if k >= n:
        return 1.0
    logs = [
        lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log1p(-p) for i in range(k + 1)
    ]
    top = max(logs)
    return min(1.0, exp(top) * sum(exp(x - top) for x in logs))


def upper_bound(k: int, n: int, level: float) -> float:
    """Clopper-Pearson: the largest share that k of n do not refute at ``level``."""
    if n == 0 or k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        if mid in (0.0, 1.0):
            break
        low, high = (mid, high) if binomial_tail(k, n, mid) > level else (low, mid)
    return high


def _step(rule: str) -> Column:
    return F.least(F.floor(F.greatest(F.col(rule), F.lit(0.0)) * STEPS), F.lit(STEPS)).cast("int")


def fit_cutoffs(stats: DataFrame, labels: DataFrame, stratum: str = "lang", key: str = "doc_id",
                risk: float = RISK, delta: float = DELTA) -> dict[tuple[str | None, str], int]:
    """Steps at which each (stratum, rule) starts to reject.

    Reads histograms only: a row per stratum, rule and step, and one per stratum
    and place in its sequence, so the driver holds strata x rules x ``STEPS``
    counts however many labels there are. Documents that fail the base rules
    are left out: the cutoffs act on the rest.
    """
    judged = labels.filter(F.col("quality").isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(
        F.max("quality").alias("__quality")
    )
    proposes = F.crc32(F.col(key).cast("string").cast("binary")) % PROPOSE == 0
    seen = store(
        stats.filter(~base_failed()).join(judged, key)
        .select(F.col(stratum).alias("__stratum"), "__quality", proposes.alias("__proposes"), *(_step(r).alias(r) for r in RULES)),
        "quality-labelled",
    )
    good, bad = F.col("__quality") == 1, F.col("__quality") == 0
    sizes = {r["__stratum"]: r["n"] for r in seen.groupBy("__stratum").agg(F.count_if(good & ~F.col("__proposes")).alias("n")).collect()}
    floor = log(delta / max(1, len(sizes))) / log1p(-risk)
    pooled = [s for s, n in sizes.items() if n < floor]
    groups = [[s] for s in sizes if s not in pooled] + ([pooled] if pooled else [])
    group = F.lit(None).cast("int")
    for g, members in enumerate(groups):
        for s in members:
            group = F.when(F.col("__stratum").eqNullSafe(F.lit(s)), g).otherwise(group)
    grouped = seen.withColumn("__group", group)
    pairs = F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).alias("step")) for r in RULES))
    counts = (
        grouped.select("__group", F.explode(pairs).alias("x"), bad.alias("bad"), (good & F.col("__proposes")).alias("good"))
        .groupBy("__group", "x.rule", "x.step").agg(F.count_if("good").alias("good"), F.count_if("bad").alias("bad"))
        .collect()
    )
    paths = []
    for g in range(len(groups)):
        tallies = {r: (np.zeros(STEPS + 1, np.int64), np.zeros(STEPS + 1, np.int64)) for r in RULES}
        for c in counts:
            if c["__group"] == g:
                tallies[c["rule"]][0][c["step"]] += c["good"]
                tallies[c["rule"]][1][c["step"]] += c["bad"]
        paths.append(sequence(tallies))
    place = F.lit(None).cast("int")
    for g, path in enumerate(paths):
        firsts = []
        for rule in RULES:
            at = [len(path)] * (STEPS + 1)
            for i in reversed([i for i, (r, _) in enumerate(path) if r == rule]):
                at[path[i][1] :] = [i] * (STEPS + 1 - path[i][1])
            firsts.append(F.element_at(F.lit(at), F.col(rule) + 1))
        place = F.when(F.col("__group") == g, F.least(*firsts)).otherwise(place)
    lost = grouped.filter(good & ~F.col("__proposes")).groupBy("__group", place.alias("place")).agg(F.count(F.lit(1)).alias("n")).collect()
    discard(seen)
    level, cutoffs = delta / max(1, len(groups)), {}
    for g, path in enumerate(paths):
        tested = np.zeros(len(path) + 1, np.int64)
        for r in lost:
            if r["__group"] == g:
                tested[r["place"]] += r["n"]
        for rule, step in path[: accepted(tested, risk, level)]:
            for s in groups[g]:
                cutoffs[s, rule] = step
    return cutoffs


def accepted(tested: np.ndarray, risk: float, level: float) -> int:
    """How many cutoffs of a sequence pass in order, from the number of good
    documents that each is the first to reject (the last: never rejected)."""
    n, refused = int(tested.sum()), 0
    for i, lost in enumerate(tested[:-1].tolist()):
        refused += lost
        if n == 0 or binomial_tail(refused, n, risk) > level:
            return i
    return len(tested) - 1


def sequence(tallies: dict[str, tuple[np.ndarray, np.ndarray]]) -> list[tuple[str, int]]:
    """Cutoffs ``(rule, step)`` in the order in which they are tested, from
    each rule's counts of good and bad documents that propose, by step."""
    now, out = dict.fromkeys(tallies, STEPS + 1), []
    while True:
        best = None
        for rule, (good, bad) in tallies.items():
            low = now[rule]
            lost, caught = np.cumsum(good[1:low][::-1]), np.cumsum(bad[1:low][::-1])
            for i in np.flatnonzero((bad[1:low][::-1] > 0) & (caught > PROPOSE * lost)):
                worth = (caught[i] / (PROPOSE * lost[i] + 1), low - 1 - int(i))
                if best is None or worth > best[0]:
                    best = worth, rule
        if best is None:
            return out
        (_, step), rule = best
        out += [(rule, s) for s in range(now[rule] - 1, step - 1, -1)]
        now[rule] = step


def rejected(cutoffs: dict[tuple[str | None, str], int], stratum: str = "lang") -> Column:
    """Whether a learned rule rejects the row."""
    out = F.lit(False)
    for (s, rule), step in sorted(cutoffs.items(), key=str):
        out = out | (F.col(stratum).eqNullSafe(F.lit(s)) & (_step(rule) >= step))
    return out


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", key: str = "doc_id",
          risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """Statistics and verdicts, one row per row of ``docs``, without its text."""
    stats = store(with_stats(docs, keep=[key, stratum]), "quality")
    cutoffs = fit_cutoffs(stats, labels, stratum, key, risk, delta)
    return stats.withColumn("base_failed", base_failed()).withColumn(
        "kept", ~F.col("base_failed") & ~rejected(cutoffs, stratum)
    )


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang", key: str = "doc_id", text: str = "text",
              risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """``docs`` without the documents that a rule rejects, in one further pass
    over the texts; only statistics are shuffled, never texts."""
    cutoffs = fit_cutoffs(with_stats(docs, text, keep=[key, stratum]), labels, stratum, key, risk, delta)
    # Columns go by number meanwhile, so that none clashes with a statistic.
    number = {c: f"__column{i}" for i, c in enumerate(docs.columns)}
    judged = with_stats(docs.toDF(*number.values()), number[text])
    good = judged.filter(~base_failed() & ~rejected(cutoffs, number[stratum]))
    return good.select(*number.values()).toDF(*docs.columns)
