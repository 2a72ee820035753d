"""Exact similarity join of sets by prefixes, over the order of token frequency.

Two sets of Jaccard similarity ``t`` share a token among the first
``n - ceil(t n) + 1`` of each, in any common order of tokens; rarest first, few
sets meet in one. Equal sets are one class with its number of rows, so copies
cost one row. What meets are names, sizes, places and sketches, never sets: pairs
are told off where they meet, before any of them is shuffled, and only the rest
fetch their sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.llm.common import store

#: Classes of one token that a task compares with each other; more are dealt.
MOST = 20_000
#: Prefix tokens that meet in one group of tokens, about, and pairs that are compared at a time.
GROUP, BLOCK = 400_000, 1 << 20
#: Least 64-bit words of a sketch; sets of over 88 tokens a word have twice as many, and so on.
WORDS = 4
#: Numbers that tokens are counted under, which bounds what is broadcast; tokens that share one stay apart in the order.
SLOTS = 1 << 20


def _needed(n: Column, similarity: float) -> Column:
    """Least size of the overlap with a set of size n, as ceil without float noise."""
    return F.ceil(F.round(n * similarity, 6)).cast("int")


def classes(sets: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Distinct sets, ``(cls, tokens, copies)``: tokens as hashes, rarest first
    by the number of rows that hold them, and the class as the hash of its set.
    Sets that are null or empty are in none. A set is shuffled once, to its
    class; its tokens are ordered there."""
    rows = sets.select(F.array_sort(F.array_distinct(F.transform(F.col(tokens), lambda x: F.xxhash64(x.cast("string"))))).alias("own")).filter(F.size("own") > 0)
    slot = lambda t: F.pmod(t, F.lit(SLOTS)).cast("int").alias("slot")
    counts = rows.select(F.explode("own").alias("token")).groupBy(slot(F.col("token"))).agg(F.count(F.lit(1)).alias("n"))
    named = rows.select(F.base64(F.unhex(F.md5(F.array_join(F.transform("own", lambda x: x.cast("string")), ",")))).alias("cls"), "own")
    distinct = named.groupBy("cls").agg(F.count(F.lit(1)).alias("copies"), F.first("own").alias("own"))
    exploded = distinct.select("cls", "copies", F.explode("own").alias("token")).withColumn("slot", slot(F.col("token")))
    ordered = exploded.join(F.broadcast(counts), "slot").groupBy("cls").agg(F.max("copies").alias("copies"), F.array_sort(F.collect_list(F.struct("n", "token"))).alias("x"))
    return ordered.select("cls", "copies", F.transform("x", lambda t: t["token"]).alias("tokens"))


def _widths(n: np.ndarray) -> np.ndarray:
    """Words of the sketches of sets of size n."""
    return WORDS << np.ceil(np.log2(np.maximum(n / (WORDS * 88), 1))).astype(int)


def _sketches(n: np.ndarray, tokens: np.ndarray) -> list[bytes]:
    """Bits of each set that tell whether an odd number of its tokens have that
    number: sketches of two sets differ in no more bits than the sets in tokens."""
    widths, out = np.repeat(_widths(n), n), [b""] * len(n)
    own = np.repeat(np.arange(len(n)), n)
    for w in np.unique(widths):
        at, bits = np.flatnonzero(_widths(n) == w), int(w) * 64
        place = np.zeros(len(n), int)
        place[at] = np.arange(len(at))
        some = widths == w
        odd = np.bincount(place[own[some]] * bits + (tokens[some] & (bits - 1)), minlength=len(at) * bits) & 1
        for i, x in zip(at, np.packbits(odd.astype(np.uint8).reshape(-1, bits), axis=1), strict=True):
            out[i] = x.tobytes()
    return out


def _need(n: np.ndarray, similarity: float) -> np.ndarray:
    """As ``_needed``."""
    return np.ceil(np.round(n * similarity, 6)).astype(np.int64)


SPREAD = "dest int, cls string, n int, sketch binary, token array<long>, at array<int>, before array<long>"


def _spread(similarity: float, groups: int, hot: dict[int, int]) -> Callable:
    """Classes to the groups of the tokens of their prefixes, with sketch, places
    and the tokens before. A hot token's classes are in parts, and go to the cells of pairs of parts."""
    known, parts_of = np.array(sorted(hot), np.int64), np.array([hot[t] for t in sorted(hot)], np.int64)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sets, dice = batch.column("tokens"), batch.column("dice").to_numpy()
            n, flat = sets.value_lengths().to_numpy().astype(np.int64), sets.flatten().to_numpy()
            row = np.repeat(np.arange(len(n)), n)
            at = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
            i = np.flatnonzero(at < (n - _need(n, similarity) + 1)[row])
            cell = np.zeros(len(i), np.int64)
            if len(known):
                found = np.minimum(np.searchsorted(known, flat[i]), len(known) - 1)
                parts = np.where(known[found] == flat[i], parts_of[found], 1)
                j = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
                i, parts = np.repeat(i, parts), np.repeat(parts, parts)
                part = dice[row[i]] % parts
                cell = np.minimum(part, j) * parts + np.maximum(part, j)
            # Two cells of equal numbers only bring sets together that need not meet.
            key = flat[i] + cell * np.int64(-7046029254386353131)
            before = np.where(at[i] > 0, flat[np.maximum(i - 1, 0)], 0)
            dest = ((key.view(np.uint64) >> np.uint64(20)) % np.uint64(groups)).astype(np.int32)
            order = np.lexsort((row[i], dest))
            i, key, before, dest = i[order], key[order], before[order], dest[order]
            first = np.flatnonzero(np.r_[True, (np.diff(dest) != 0) | (np.diff(row[i]) != 0)])
            cut, own = pa.array(np.r_[first, len(i)].astype(np.int32)), row[i[first]]
            lists = [pa.ListArray.from_arrays(cut, pa.array(x)) for x in (key, at[i].astype(np.int32), before)]
            held = batch.column("cls").take(pa.array(own))
            sketches = pa.array(_sketches(n, flat), pa.binary()).take(pa.array(own))
            yield pa.RecordBatch.from_arrays([pa.array(dest[first]), held, pa.array(n[own].astype(np.int32)), sketches, *lists], names=["dest", "cls", "n", "sketch", "token", "at", "before"])

    return spread


def _folded(sketches: list[bytes], width: np.ndarray, least: int) -> np.ndarray:
    """Sketches of ``least`` words: those of more are folded, as bits go by the last bits of tokens; those of fewer are left empty."""
    out = np.zeros((len(sketches), least), np.uint64)
    for w in np.unique(width[width >= least]):
        at = np.flatnonzero(width == w)
        x = np.frombuffer(b"".join(sketches[i] for i in at), np.uint64).reshape(len(at), w // least, least)
        out[at] = np.bitwise_xor.reduce(x, axis=1)
    return out


def _meet(similarity: float) -> Callable:
    """The pairs of one group of tokens that sizes, places and sketches don't tell off, each once."""

    def meet(table: pa.Table) -> pa.Table:
        size, name = table.column("n").to_numpy().astype(np.int64), table.column("cls").combine_chunks()
        sketches, width = table.column("sketch").to_pylist(), _widths(size)
        lists = table.column("token").combine_chunks()
        own = np.repeat(np.arange(len(size)), lists.value_lengths().to_numpy())
        token = lists.flatten().to_numpy()
        at, before = (table.column(c).combine_chunks().flatten().to_numpy() for c in ("at", "before"))
        # In order of size, the sets that may fit a smaller one follow it.
        order = np.lexsort((size[own], token))
        own, token, at, before = own[order], token[order], at[order].astype(np.int64), before[order]
        n, base = size[own], int(size.max()) + 2
        group = np.cumsum(np.r_[0, np.diff(token) != 0]) * base
        most = np.minimum(np.floor(n / similarity + 1e-6).astype(np.int64), base - 1)
        many = np.searchsorted(group + n, group + most, side="right") - np.arange(len(own)) - 1
        folded = {int(w): _folded(sketches, width, int(w)) for w in np.unique(width)}
        ends, found, fresh = np.cumsum(many), [np.zeros(0, np.int64)], 0
        start = done = 0
        while start < len(own):
            stop = max(start + 1, int(np.searchsorted(ends, done + BLOCK, side="right")))
            k = many[start:stop]
            i = np.repeat(np.arange(start, stop), k)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(k) - k, k)
            start, done = stop, int(ends[stop - 1])
            # Of two sets that fit, no more than this many tokens are in one alone.
            apart = n[i] + n[j] - 2 * _need(n[i] + n[j], similarity / (1 + similarity))
            fits = np.abs(at[i] - at[j]) + np.abs((n[i] - at[i]) - (n[j] - at[j])) <= apart
            # Sets that share the token before have met there.
            fits &= (before[i] != before[j]) | (at[i] == 0) | (at[j] == 0)
            a, b, apart = own[i[fits]], own[j[fits]], apart[fits]
            w = np.minimum(width[a], width[b])
            for v, x in folded.items():
                some = np.flatnonzero(w == v)
                differ = np.bitwise_count(x[a[some]] ^ x[b[some]]).sum(axis=1, dtype=np.int64)
                some = some[differ <= apart[some]]
                found.append(np.minimum(a[some], b[some]) * len(size) + np.maximum(a[some], b[some]))
                fresh += len(some)
            if fresh > 4 * BLOCK:
                found, fresh = [np.unique(np.concatenate(found))], 0
        a, b = np.divmod(np.unique(np.concatenate(found)), len(size))
        both = pa.array((size[a] + size[b]).astype(np.int32))
        return pa.table({"x": name.take(pa.array(a)), "y": name.take(pa.array(b)), "both": both})

    return meet


def similar_pairs(found: DataFrame, similarity: float = 0.8, most: int = MOST) -> DataFrame:
    """Pairs of ``classes`` of Jaccard ``similarity`` or more, ``(a, b, common, jaccard)`` with a < b.

    A class goes to the groups of the tokens of its prefix, once to a group. A
    token with over ``most`` classes is dealt to pairs of parts, so no task
    compares more than about ``2 most`` of them. A pair is left out where sizes,
    places in the order or sketches can't fit; what is left leaves each group
    once, and is compared whole. ``found`` is read several times, and pairs to
    compare are stored, so that the files of what met are gone by then.
    """
    n = F.size("tokens")
    prefix = F.slice("tokens", F.lit(1), n - _needed(n, similarity) + 1)
    counts = found.select(F.explode(prefix).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("k"))
    # One row for ``most`` rows, so the list may go to all tasks.
    hot = {r.token: r.parts for r in counts.filter(F.col("k") > most).select("token", F.ceil(F.col("k") / most).cast("int").alias("parts")).collect()}
    total = found.agg(F.sum(F.size(prefix))).first()[0] or 0
    dice = F.shiftrightunsigned(F.xxhash64("cls"), 1).alias("dice")
    spread = found.select("cls", "tokens", dice).mapInArrow(_spread(similarity, max(8, -(-total // GROUP)), hot), SPREAD)
    met = spread.groupBy("dest").applyInArrow(_meet(similarity), "x string, y string, both int")
    told = store(met.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "both").distinct(), "told")
    of = lambda s: found.select(F.col("cls").alias(s), F.col("tokens").alias(f"{s}_tokens"))
    rows = told.join(of("a"), "a").join(of("b"), "b").select("a", "b", F.size(F.array_intersect("a_tokens", "b_tokens")).alias("common"), "both")
    return rows.select("a", "b", "common", (F.col("common") / (F.col("both") - F.col("common"))).alias("jaccard")).filter(F.col("jaccard") >= similarity)
