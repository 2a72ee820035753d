"""A model of words after pairs of words, and how well texts fit it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.llm.common import discard, store

#: What each step back to a shorter context costs.
BACK = 0.4
#: Contexts of a model that go to all tasks, those seen most; about 16 bytes each.
HEAD = 4_000_000
#: Bits that tell which of the others there may be, at most: 16 a context, in so many slices.
BITS, SLICES = 1 << 29, 64


def words(text: Column) -> Column:
    """Runs of ASCII letters and digits, in lower case."""
    return F.split(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), " ")


def windows(texts: DataFrame, *key: str, text: str = "text") -> DataFrame:
    """Rows ``(*key, a, b, c)`` of three words in a row; a text of fewer has one row of nulls."""
    at = lambda i, k: F.element_at("w", i + k)
    some = F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.struct(at(i, 0).alias("a"), at(i, 1).alias("b"), at(i, 2).alias("c")))
    rows = texts.select(*key, words(F.coalesce(F.col(text), F.lit(""))).alias("w"))
    return rows.select(*key, F.explode_outer(F.when(F.size("w") > 2, some)).alias("t")).select(*key, "t.*")


def chances(texts: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame, Column]:
    """The model of ``texts``: chances of a word after two words ``(a, b, c, p3)``,
    after one ``(b, c, p2)``, alone ``(c, p1)``, each with its count ``n``, and of an
    unseen one. Counts of shorter contexts are made from those of triples, and combine before each shuffle. Each step
    is stored, so it is made once, and the files of its shuffles are gone by the next."""
    seen = store(windows(texts, text=text).filter("c is not null").groupBy("a", "b", "c").agg(F.count(F.lit(1)).alias("n")), "triples")
    share = lambda counts, by, name: counts.join(counts.groupBy(*by).agg(F.sum("n").alias("all")), list(by)).withColumn(name, F.col("n") / F.col("all")).drop("all")
    pairs = store(seen.groupBy("b", "c").agg(F.sum("n").alias("n")), "pairs")
    total = pairs.agg(F.sum("n")).first()[0] or 1
    alone = pairs.groupBy("c").agg(F.sum("n").alias("n"))
    p1 = store(alone.select("c", "n", (F.col("n") / total).alias("p1")), "p1")
    p2 = store(share(pairs, ("b",), "p2"), "p2")
    discard(pairs)
    p3 = store(share(seen, ("a", "b"), "p3"), "p3")
    discard(seen)
    return p3, p2, p1, F.lit(1.0 / total)


def _key(*words: Column) -> Column:
    """The number that one to three words in a row are looked up by."""
    return F.xxhash64(F.lit(len(words)), *words)


def gains(model: tuple) -> DataFrame:
    """What each known context adds to the logarithm of a chance over the next
    shorter one, ``(key, gain, known, n)``: a word over an unseen one, a pair over its
    last word, a triple, the only ``known`` one, over its last pair."""
    p3, p2, p1, unseen = model
    one = p1.select(_key(F.col("c")).alias("key"), (F.log2(BACK**2 * F.col("p1")) - F.log2(BACK**3 * unseen)).alias("gain"), F.lit(0).alias("known"), "n")
    two = p2.join(p1.drop("n"), "c").select(_key(F.col("b"), F.col("c")).alias("key"), (F.log2(BACK * F.col("p2")) - F.log2(BACK**2 * F.col("p1"))).alias("gain"), F.lit(0).alias("known"), "n")
    three = p3.join(p2.drop("n"), ["b", "c"]).select(_key(F.col("a"), F.col("b"), F.col("c")).alias("key"), (F.log2("p3") - F.log2(BACK * F.col("p2"))).alias("gain"), F.lit(1).alias("known"), "n")
    return one.unionByName(two).unionByName(three)


def _places(keys: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Two of the bits of each key, in the slice that its first bits tell."""
    k = keys.view(np.uint64)
    some = np.uint64(bits // SLICES)
    for x in (k, k * np.uint64(0x9E3779B97F4A7C15)):
        yield (k >> np.uint64(58)) * some + (x >> np.uint64(20)) % some


def _slice(bits: int) -> Callable:
    """The bits of one slice of keys."""

    def build(table: pa.Table) -> pa.Table:
        at, own = table.column("slice")[0].as_py(), bits // SLICES
        out = np.zeros(own, np.uint8)
        for x in _places(table.column("key").to_numpy(), bits):
            out[x.astype(np.int64) - at * own] = 1
        return pa.table({"slice": pa.array([at], pa.int32()), "bits": pa.array([np.packbits(out, bitorder="little").tobytes()], pa.binary())})

    return build


def _look_up(key: str, sent) -> Callable:
    """Gains of windows by the contexts that are in all tasks, a row for a text of a
    batch, and rows of contexts that must be looked up elsewhere, ``kind`` 0."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, gain, known, bits = sent.value
        # Where keys of equal first bits begin, so a search has few steps.
        shift = np.uint64(64 - max(1, min(22, len(keys).bit_length())))
        begin = np.searchsorted(keys >> shift, np.arange((1 << (64 - int(shift))) + 1, dtype=np.uint64))
        longest = int(np.diff(begin).max(initial=0))
        for batch in batches:
            if not batch.num_rows:
                continue
            names, row = batch.column(key), batch.column("row").to_numpy()
            asked = np.stack([batch.column(c).to_numpy() for c in ("k1", "k2", "k3")], axis=1).ravel()
            k = asked.view(np.uint64)
            first = (k >> shift).astype(np.int64)
            low, high = begin[first], begin[first + 1]
            for _ in range(longest.bit_length()):
                mid = (low + high) >> 1
                up = (low < high) & (keys[np.minimum(mid, len(keys) - 1)] < k) if len(keys) else low < low
                low, high = np.where(up, mid + 1, low), np.where(up, high, np.minimum(mid, high))
            at = np.minimum(low, max(len(keys) - 1, 0))
            hit = keys[at] == k if len(keys) else np.zeros(len(k), bool)
            starts = np.flatnonzero(np.r_[True, np.diff(row) != 0])
            sums = [np.add.reduceat(np.where(hit, x[at], 0) if len(keys) else np.zeros(len(k)), starts * 3) for x in (gain, known)]
            rest = np.flatnonzero(~hit) if len(bits) else np.zeros(0, np.int64)
            if len(rest):
                there = [bits[x >> np.uint64(3)] >> (x & np.uint64(7)).astype(np.uint8) & 1 for x in _places(asked[rest], len(bits) * 8)]
                rest = rest[there[0] & there[1] > 0]
            n = len(starts), len(rest)
            yield pa.RecordBatch.from_arrays([
                names.take(pa.array(np.r_[starts, rest // 3])), pa.array(np.repeat([1, 0], n).astype(np.int32)), pa.array(np.r_[row[starts], asked[rest]]),
                pa.array(np.r_[sums[1].astype(np.int64), np.zeros(n[1], np.int64)]), pa.array(np.r_[sums[0], np.zeros(n[1])]),
            ], names=[key, "kind", "key_", "known", "sum"])

    return look


def surprise(texts: DataFrame, model: tuple, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Mean bits a word of each text under a model: ``(key, windows, known, bits)``.

    A word that the model hasn't seen after its two words is looked up after one,
    then alone, each step at ``BACK`` of its chance; an unseen word has the least.
    The logarithm of that chance is a sum of ``gains``, so the word, pair and
    triple of each window are looked up alike, by numbers of 64 bits; words don't
    travel. The ``HEAD`` contexts seen most go to all tasks, which also know by
    bits which others there may be: only windows of those are shuffled, to one
    join. The model is stored; it has one row a number, so a skewed join may split
    those of a common one; sums of a text combine before their shuffle. A text of
    fewer than three words, or null, has no windows and 0 bits; of rows with one
    key, windows are taken together. Bits are rounded to 9 places, as sums of
    parts are not exact beyond that.
    """
    spark = texts.sparkSession
    known = store(gains(model), "gains")
    sizes = known.groupBy(F.least("n", F.lit(1000)).cast("long").alias("n")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("n")).collect()
    cut, count = 1001, 0
    for r in sizes:
        if count + r.k > HEAD:
            break
        cut, count = r.n, count + r.k
    head = known.filter(F.col("n") >= cut).select("key", "gain", "known").toArrow()
    rest, others = known.filter(F.col("n") < cut), sum(r.k for r in sizes) - count
    bits = np.zeros(0, np.uint8)
    if others:
        size = 1 << max(16, min(BITS.bit_length() - 1, (16 * others).bit_length()))
        parts = rest.select("key", F.shiftrightunsigned("key", 58).cast("int").alias("slice")).groupBy("slice").applyInArrow(_slice(size), "slice int, bits binary")
        bits = np.zeros((SLICES, size // SLICES // 8), np.uint8)
        for r in parts.toLocalIterator():
            bits[r.slice] = np.frombuffer(r.bits, np.uint8)
    order = np.argsort((keys := head.column("key").to_numpy().view(np.uint64)))
    sent = spark.sparkContext.broadcast((keys[order], head.column("gain").to_numpy()[order], head.column("known").to_numpy().astype(np.int8)[order], bits.ravel()))
    # Arrays beside each other, as a function of each place would be slower than their rows.
    run = lambda i: F.slice("w", i, F.size("w") - 2).alias(f"w{i}")
    every = _key(F.col("t.w3")).alias("k1"), _key(F.col("t.w2"), F.col("t.w3")).alias("k2"), _key(F.col("t.w1"), F.col("t.w2"), F.col("t.w3")).alias("k3")
    own = texts.select(key, words(F.coalesce(F.col(text), F.lit(""))).alias("w"))
    many = F.greatest(F.size("w") - 2, F.lit(0)).cast("long")
    base = own.select(key, many.alias("windows"), F.lit(0).cast("long").alias("known"), (many * F.log2(BACK**3 * model[3])).alias("sum"))
    looked = own.filter(F.size("w") > 2).select(key, F.monotonically_increasing_id().alias("row"), run(1), run(2), run(3)).select(key, "row", F.explode(F.arrays_zip("w1", "w2", "w3")).alias("t"))
    met = looked.select(key, "row", *every).mapInArrow(_look_up(key, sent), f"`{key}` {texts.schema[key].dataType.simpleString()}, kind int, key_ long, known long, sum double")
    if others:
        # Sums of windows join nothing; by the number of their text they spread.
        told = rest.select(F.lit(0).alias("kind"), F.col("key").alias("key_"), "gain", F.col("known").alias("one")).hint("shuffle_hash")
        met = met.join(told, ["kind", "key_"], "left").select(key, (F.col("known") + F.coalesce("one", F.lit(0))).alias("known"), (F.col("sum") + F.coalesce("gain", F.lit(0.0))).alias("sum"))
    rows = base.unionByName(met.select(key, F.lit(0).cast("long").alias("windows"), "known", "sum"))
    n = F.sum("windows")
    mean = F.round(-F.sum("sum") / F.nullif(n, F.lit(0)), 9)
    return rows.groupBy(key).agg(n.alias("windows"), F.sum("known").alias("known"), F.coalesce(mean, F.lit(0.0)).alias("bits"))
