"""Which keys (hashes of text) documents share, without gathering any key.

Tasks send entries (document, key) to buckets of the key as packed arrays, a
row per bucket, after combining what they hold of a key: however many documents
share a key, a task sends one entry of it to the key's bucket. What it knows of
its other documents goes straight to their homes, as does what a bucket finds:
as packed notes that meet the texts there; only texts are shuffled besides.

A null key of a document counts as larger than any other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.common import mapped, slices

PACKET_DDL = "bucket int, docs binary, counts binary, kind int, keys binary, more binary"
_NAMES = ("bucket", "docs", "counts", "kind", "keys", "more")
_TYPES = (pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary())
#: Entries that a task gathers before it combines and sends them.
FLUSH = 400_000
#: Bytes of text for one bucket of keys, and for one home of documents.
BUCKET_BYTES = 4 << 20
NO_ID = np.iinfo(np.int64).max
#: Kinds of packets: entries to be matched, notes found already that pass by the
#: bucket of their key, and notes that pass by the home of their document.
ENTRY, NOTE, KNOWN = 0, 1, 2
#: Documents of one key in a task beyond which all know it for a hot one.
CROWD = 32


class Layout(NamedTuple):
    """Partitions are the session's; buckets (as many homes) follow the bytes of
    the input. A task takes one bucket or home at a time, so what Python holds
    stays alike however much a partition has, and Spark's sorts can spill."""

    partitions: int
    buckets: int


def layout(docs: DataFrame, text: str) -> Layout:
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return Layout(partitions, partitions * max(1, -(-size // (partitions * BUCKET_BYTES))))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned longs (the finaliser of SplitMix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int32)


def home_of(docs: np.ndarray, homes: int) -> np.ndarray:
    return (((docs % (1 << 31)) * 2654435761 >> 15) & 0x7FFFFFFF) % homes


def home_column(key: str, homes: int):
    value = F.coalesce(F.col(key).cast("long"), F.lit(int(NO_ID)))
    product = F.pmod(value, F.lit(1 << 31)) * F.lit(2654435761)
    return F.pmod(F.shiftright(product, 15).bitwiseAND(F.lit(0x7FFFFFFF)), F.lit(homes)).cast("int")


def packets(bucket: np.ndarray, docs: np.ndarray, keys: np.ndarray, kind: int, more: np.ndarray | None = None) -> list[tuple]:
    """Rows of packed entries, one per bucket. Entries of a document that lie
    together are run-length coded; ``more`` has a fixed number of bytes each."""
    small = bucket.astype(np.uint16) if len(bucket) and bucket.max() < 65536 else bucket
    order = np.argsort(small, kind="stable")
    bucket, docs, keys = bucket[order], docs[order], keys[order]
    more = None if more is None else more[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    out = []
    for a, b in zip([0, *cuts], [*cuts, len(bucket)], strict=True):
        if a == b:
            continue
        own = docs[a:b]
        starts = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1])
        counts = np.diff(np.append(starts, b - a)).astype(np.uint32)
        out.append((int(bucket[a]), own[starts].tobytes(), counts.tobytes(), kind, keys[a:b].tobytes(), None if more is None else more[a:b].tobytes()))
    return out


def known_packets(docs: np.ndarray, keys: np.ndarray, buckets: int) -> list[tuple]:
    """Notes found already, by way of the documents' homes, to spread as documents do."""
    return packets(home_of(docs, buckets).astype(np.int32), docs, keys, KNOWN)


def packet_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _TYPES, strict=True)], names=list(_NAMES))


def unpacked(rows: list[dict], key_type: type = np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Documents and keys of packet rows."""
    docs = [np.repeat(np.frombuffer(r["docs"], np.int64), np.frombuffer(r["counts"], np.uint32)) for r in rows]
    keys = [np.frombuffer(r["keys"], key_type) for r in rows]
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, key_type)
    return np.concatenate(docs), np.concatenate(keys)


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[dict]]]:
    """``(bucket, kind, rows)`` of batches in order of bucket and kind: all
    entries of a bucket at once, then its notes by the batch, so that only
    entries are held."""
    now, held = (None, ENTRY), []
    for batch in batches:
        for row in batch.to_pylist():
            at = (row["bucket"], row["kind"])
            if at != now:
                if held:
                    yield *now, held
                now, held = at, []
            held.append(row)
        if held and now[1] != ENTRY:
            yield *now, held
            held = []
    if held:
        yield *now, held


def sent(packed: DataFrame, at: Layout) -> DataFrame:
    """Packets at their buckets, sorted by bucket and kind in each partition."""
    where = F.pmod("bucket", F.lit(at.partitions)).cast("int")
    return packed.repartitionById(at.partitions, where).sortWithinPartitions("bucket", "kind")


class Outbox:
    """Notes of many buckets, sent to homes when there are ``FLUSH`` of them."""

    def __init__(self, homes: int):
        self.homes, self.docs, self.notes, self.size = homes, [], [], 0

    def put(self, docs: np.ndarray, notes: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(docs):
            self.docs.append(docs)
            self.notes.append(notes)
            self.size += len(docs)
        if self.size >= FLUSH:
            yield from self.end()

    def end(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        docs, notes = np.concatenate(self.docs), np.concatenate(self.notes)
        self.docs, self.notes, self.size = [], [], 0
        by_doc = np.argsort(docs, kind="stable")
        docs, notes = docs[by_doc], notes[by_doc]
        yield packet_batch(packets(home_of(docs, self.homes).astype(np.int32), docs, notes, NOTE))


def groups(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by key and document; group number of each ordered entry; starts."""
    order = np.lexsort((docs, keys))
    k = keys[order]
    starts = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1]) if len(k) else np.zeros(0, np.int64)
    number = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(k))))
    return order, number, starts


class Shared:
    """Keys that at least two documents hold, of which one indexes it.

    Keys have 61 bits; bit 0 says that an entry is indexed, bit 1 that another
    document of the sending task holds the key as well, bit 2 that over
    ``CROWD`` of them do.
    """

    INDEXED, TWO, MANY, FLAGS = np.uint64(1), np.uint64(2), np.uint64(4), np.uint64(7)

    @staticmethod
    def combine(docs: np.ndarray, keys: np.ndarray, indexed: np.ndarray) -> tuple:
        """Entries to send (docs, keys with flags), and entries known to be
        shared (docs, keys, whether over ``CROWD`` documents here hold the key)."""
        keys = keys & ~Shared.FLAGS
        order, _, _ = groups(keys, docs)
        d, k, x = docs[order], keys[order], indexed[order]
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1])
        at = np.flatnonzero(new)
        if not len(at):
            return (d, k), (d, k, np.zeros(0, bool))
        x = np.logical_or.reduceat(x, at)
        d, k = d[at], k[at]
        starts = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1])
        sizes = np.diff(np.append(starts, len(k)))
        any_index = np.repeat(np.logical_or.reduceat(x, starts), sizes)
        many = np.repeat(sizes > 1, sizes)
        known = many & any_index
        first = np.zeros(len(k), bool)
        first[starts] = True
        send = ~known | first
        crowd = np.repeat(np.diff(np.append(starts, len(k))) > CROWD, sizes)
        flags = (any_index & known | x).astype(np.uint64) | (many.astype(np.uint64) << np.uint64(1)) | (crowd.astype(np.uint64) << np.uint64(2))
        # In document order, so that entries of a document lie together.
        by_doc = lambda mask: np.flatnonzero(mask)[np.argsort(d[mask], kind="stable")]
        s, h = by_doc(send), by_doc(known)
        return (d[s], (k | flags)[s]), (d[h], k[h], crowd[h])

    @staticmethod
    def match(docs: np.ndarray, keys: np.ndarray, hot: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entries of shared keys: documents, keys, and whether over ``hot``
        entries came of the key or one from a task with many."""
        if not len(docs):
            return docs, keys, np.zeros(0, bool)
        plain = keys & ~Shared.FLAGS
        order, number, starts = groups(plain, docs)
        d, k = docs[order], keys[order]
        indexed = np.logical_or.reduceat((k & Shared.INDEXED) > 0, starts)
        two = np.logical_or.reduceat((k & Shared.TWO) > 0, starts)
        ends = np.append(starts[1:], len(d)) - 1
        shared = indexed & (two | (d[starts] != d[ends]))
        busy = (ends - starts + 1 > hot) | np.logical_or.reduceat((k & Shared.MANY) > 0, starts)
        keep = shared[number]
        return d[keep], plain[order][keep], busy[number][keep]


class Earliest:
    """Keys that a document of smaller id holds as well."""

    @staticmethod
    def combine(docs: np.ndarray, keys: np.ndarray, more: np.ndarray) -> tuple:
        """Entries to send, the smallest document of each key; entries known to
        be later ones. ``more`` are further bits of the keys."""
        order = np.lexsort((docs, more, keys))
        d, k, m = docs[order], keys[order], more[order]
        new = np.ones(len(d), bool)
        new[1:] = (k[1:] != k[:-1]) | (m[1:] != m[:-1])
        starts = np.flatnonzero(new)
        least = np.repeat(d[starts], np.diff(np.append(starts, len(d))))
        later = d > least
        later[1:] &= (d[1:] != d[:-1]) | new[1:]
        by_doc = lambda mask: np.flatnonzero(mask)[np.argsort(d[mask], kind="stable")]
        s, h = by_doc(new), by_doc(later)
        return (d[s], k[s], m[s]), (d[h], k[h])


def meet(docs: DataFrame, notes: DataFrame, key: str, function: Callable, kind: type, schema: str, at: Layout) -> DataFrame:
    """Bring texts and notes together at the documents' homes.

    ``function()`` is called once a task and returns ``(add, end)``:
    ``add(rows, notes_of)`` gets an Arrow batch of documents of one home and a
    function from a document to its notes, of type ``kind``; ``end()`` comes
    after the last; both yield Arrow batches.
    """
    columns = docs.columns
    left = docs.select(home_column(key, at.buckets).alias("__home"), F.lit(1).alias("__side"), F.struct(*(F.col(f"`{c}`") for c in columns)).alias("__doc"))
    right = notes.select(F.col("bucket").alias("__home"), F.lit(0).alias("__side"), F.struct(*_NAMES).alias("__note"))
    both = left.withColumn("__note", F.lit(None).cast(right.schema["__note"].dataType)).unionByName(
        right.withColumn("__doc", F.lit(None).cast(left.schema["__doc"].dataType))
    )
    dealt = both.repartitionById(at.partitions, F.pmod("__home", F.lit(at.partitions)).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, notes_of = None, [], None
        add, end = function()
        for batch in batches:
            home, side = batch.column("__home").to_numpy(), batch.column("__side").to_numpy()
            cuts = np.flatnonzero((home[1:] != home[:-1]) | (side[1:] != side[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if a == b:
                    continue
                if home[a] != now:
                    now, held, notes_of = home[a], [], None
                part = batch.slice(a, b - a)
                if side[a] == 0:
                    held += part.column("__note").to_pylist()
                    continue
                if notes_of is None:
                    notes_of, held = notes_by_doc(held, kind), []
                fields = part.column("__doc").flatten()
                for rows in slices([pa.RecordBatch.from_arrays(fields, names=columns)]):
                    yield from add(rows, notes_of)
        yield from end()

    return mapped(dealt.sortWithinPartitions("__home", "__side"), run, schema)


def each(function: Callable) -> Callable:
    """For ``meet``: a function of rows and notes that keeps nothing between them."""
    return lambda: (function, lambda: iter(()))


def notes_by_doc(rows: list[dict], key_type: type) -> Callable[[int], np.ndarray]:
    """A function from a document to the keys of its notes."""
    docs, keys = unpacked(rows, key_type)
    order = np.argsort(docs, kind="stable")
    docs, keys = docs[order], keys[order]

    def of(doc: int) -> np.ndarray:
        a, b = np.searchsorted(docs, [doc, doc + 1]) if doc != NO_ID else (np.searchsorted(docs, doc), len(docs))
        return keys[a:b]

    return of


def ids(column: pa.Array) -> np.ndarray:
    """Document ids as longs; null is the largest."""
    return column.cast(pa.int64()).fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)
