"""Suffix-array dedup of bytes by longest-previous-factor arrays.

A byte is removed where a string of ``LENGTH`` bytes covers it that also starts
in a document of smaller id. The suffix array over all documents is built in
parts: suffixes whose first ``LENGTH`` bytes have the same minimiser (the least
hash of a ``GRAM``-byte string in them) form a part, so suffixes that share
``LENGTH`` bytes are always in one part. Consecutive suffixes of a document
with one minimiser are kept as one context. Three steps:

1. minimisers that only one document holds are dropped;
2. contexts of the others go to their part, equal ones combined first: all but
   those of the smallest document are later copies as a whole. The suffixes of
   the rest are put in suffix order with the lengths of common prefixes; the
   previous and the next smaller document in that order give each suffix its
   longest previous factor, and it is a later copy where that factor has
   ``LENGTH`` bytes;
3. documents lose the bytes that later copies cover.

Suffixes of minimisers that more than ``HOT`` tasks' entries hold, or over
``CROWD`` documents of one task, are parted
further by a hash of their ``LENGTH`` bytes, so that no part grows with one
passage. Bytes are compared, not hashes.

Edge cases: a null text is empty; a text shorter than ``LENGTH`` loses
nothing; repeated rows of one id remove nothing from each other; a null id
counts as larger than any other; further columns are unread; an empty table
gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from strataloom.llm import matching as M
from strataloom.llm.common import discard, mapped, slices, store, text_bytes

LENGTH = 50
GRAM = 16
HOT = 2000
#: Suffixes that are sorted at a time.
SUFFIXES = 1 << 18
#: Contexts that a task holds before it sends them.
CONTEXTS = 150_000


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` = 16 bytes that start at each position."""
    x = data.astype(np.uint64)
    for step in (1, 2, 4):
        x = (x[:-step] << np.uint64(8 * step)) | x[step:]
    with np.errstate(over="ignore"):
        return M.mixed(x[:-8] * np.uint64(0x9E3779B97F4A7C15) ^ M.mixed(x[8:]))


def minimisers(data: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The least gram hash in each window of ``length`` bytes."""
    if len(data) < length:
        return np.zeros(0, np.uint64)
    h, size, wanted = gram_hashes(data), 1, length - GRAM + 1
    while 2 * size <= wanted:
        h, size = np.minimum(h[:-size], h[size:]), 2 * size
    rest = wanted - size
    return np.minimum(h[:-rest], h[rest:]) if rest else h


def runs(data: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts of a text: minimiser, first window, and end of windows."""
    least = minimisers(np.frombuffer(data, np.uint8), length)
    if not len(least):
        return least, np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    # Least hashes are small numbers; mixed again, they spread over the parts.
    return M.mixed(least[starts]), starts, np.append(starts[1:], len(least))


def _short(keys: np.ndarray) -> np.ndarray:
    return ((keys >> np.uint64(3)) & np.uint64(0x7FFFFFFF)).astype(np.uint32)


def window_hashes(data: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """A hash of the ``length`` bytes that start at each position."""
    h = gram_hashes(data)
    n = len(data) - length + 1
    out = h[length - GRAM :][:n]
    for at in range(0, length - GRAM, GRAM):
        out = M.mixed(out + np.uint64(at + 1)) ^ h[at : at + n]
    return M.mixed(out)


def _first_packets(docs: np.ndarray, keys: np.ndarray, buckets: int) -> list[tuple]:
    """One entry a key for its bucket. Of documents that share it here, few pass
    by that bucket too, to learn whether it is hot; many know, and go home."""
    (d, k), (hd, hk, many) = M.Shared.combine(docs, keys, np.ones(len(docs), bool))
    few = M.packets(M.bucket_of(hk[~many], buckets), hd[~many], hk[~many], M.NOTE)
    return M.packets(M.bucket_of(k, buckets), d, k, M.ENTRY) + few + M.known_packets(hd[many], hk[many], buckets)


def _minimiser_packets(docs: DataFrame, key: str, text: str, length: int, at: M.Layout, hot: int) -> DataFrame:
    buckets = at.buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], []]

        def flush() -> pa.RecordBatch:
            d, k = (np.concatenate(c) for c in held)
            for c in held:
                c.clear()
            return M.packet_batch(_first_packets(d, k, buckets))

        size = 0
        for batch in slices(batches):
            for doc, data in zip(M.ids(batch.column(0)), text_bytes(batch.column(1)), strict=True):
                if data and len(data) >= length:
                    keys = np.unique(runs(data, length)[0])
                    held[0].append(np.full(len(keys), doc))
                    held[1].append(keys)
                    size += len(keys)
                if size >= M.FLUSH:
                    yield flush()
                    size = 0
        if size:
            yield flush()

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = M.Outbox(buckets)
        hot_bit, busy, of = np.uint32(1 << 31), np.zeros(0, np.uint64), None
        for bucket, kind, rows in M.by_bucket(batches):
            d, k = M.unpacked(rows)
            if kind == M.ENTRY:
                d, k, many = M.Shared.match(d, k, hot)
                # Whether a key is hot is told alike to all its documents.
                busy, of = np.unique(k[many]), bucket
            elif kind == M.NOTE:
                many = np.isin(k, busy) if bucket == of else np.zeros(len(k), bool)
            else:
                many = np.ones(len(k), bool)
            yield from out.put(d, np.where(many, _short(k) | hot_bit, _short(k)))
        yield from out.end()

    return mapped(M.sent(mapped(docs.select(key, text), run, M.PACKET_DDL), at), matched, M.PACKET_DDL)


def suffix_order(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, enough: int = 1 << 40) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes ``data[starts[i]:ends[i]]`` in order, and the length of the
    common prefix of each with the one before it.

    Eight bytes are compared at a time, as big-endian numbers; only suffixes
    that agree so far are compared further, up to ``enough`` bytes: those that
    agree in as many stay in any order, so that long repeats cost no more.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    words = padded
    for step in (1, 2, 4):
        words = (words[:-step] << np.uint64(8 * step)) | words[step:]
    n = len(starts)
    order, common = np.arange(n), np.zeros(n, np.int64)
    todo, tie = np.arange(n), np.zeros(n, np.int64)  # places that are unsettled, and the tie that each belongs to
    depth = 0
    while len(todo) and depth < enough:
        own = order[todo]
        rest = ends[own] - starts[own] - depth
        word = words[np.minimum(starts[own] + depth, len(data))]
        short = rest < 8
        if short.any():
            cut = np.clip(8 - rest[short], 0, 8).astype(np.uint64) * np.uint64(8)
            word[short] = np.where(cut < 64, (word[short] >> np.minimum(cut, 63)) << np.minimum(cut, 63), 0)
        by = np.lexsort((rest, word, tie)) if (rest <= 8).any() else _by_tie(word, tie)
        order[todo], own, word, rest, tie = own[by], own[by], word[by], rest[by], tie[by]
        fresh = np.ones(len(todo), bool)
        fresh[1:] = tie[1:] != tie[:-1]
        differ = np.zeros(len(todo), np.uint64)
        differ[1:] = word[1:] ^ word[:-1]
        least = rest.copy()
        least[1:] = np.minimum(rest[1:], rest[:-1])
        # Equal bytes in front of the first that differs; of a suffix that ends, no more than it has.
        equal = np.minimum(_leading_bytes(differ), np.maximum(least, 0))
        common[todo[~fresh]] = depth + equal[~fresh]
        parted = fresh | (differ != 0) | (least <= 8)
        number = np.cumsum(parted) - 1
        alone = parted & np.append(parted[1:], True)
        todo, tie, depth = todo[~alone], number[~alone], depth + 8
    return order, common


def _by_tie(word: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """Order by tie, then word: two sorts of plain numbers."""
    order = np.argsort(word)
    rank = np.empty(len(word), np.uint64)
    rank[order] = np.arange(len(word), dtype=np.uint64)
    return np.argsort((tie.astype(np.uint64) << np.uint64(32)) | rank)


def _leading_bytes(differ: np.ndarray) -> np.ndarray:
    """Zero bytes in front of each eight-byte number."""
    out = np.zeros(len(differ), np.int64)
    for i in range(1, 9):
        out += (differ >> np.uint64(64 - 8 * i)) == 0 if i < 8 else differ == 0
    return out


def previous_factors(position: np.ndarray, common: np.ndarray, floor: int = 1) -> np.ndarray:
    """Longest previous factor of each suffix, of suffixes in order: the longest
    prefix that it shares with one of a smaller position. Factors shorter than
    ``floor`` count as 0.

    The nearest smaller position before (and after) it in suffix order shares
    most; all places look for theirs at once, each jumping over what the place
    that it looks at has jumped over already.
    """

    def before(position: np.ndarray, common: np.ndarray) -> np.ndarray:
        at, shared = np.arange(len(position)) - 1, np.where(common >= floor, common, 0)
        looking = np.flatnonzero(shared)
        while True:
            looking = looking[(shared[looking] > 0) & (position[at[looking]] >= position[looking])]
            if not len(looking):
                return shared
            over = at[looking]
            at[looking], shared[looking] = at[over], np.minimum(shared[looking], shared[over])

    if not len(position):
        return common
    first = np.concatenate([[0], common[1:]])
    after = before(position[::-1], np.concatenate([[0], common[1:][::-1]]))[::-1]
    return np.maximum(before(position, first), after)


def later_suffixes(contexts: list[bytes], docs: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Which suffixes of at least ``length`` bytes of the contexts, given with
    the smallest document of each, are later copies; and each one's context."""
    sizes = np.array([len(c) for c in contexts], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(len(contexts)), sizes - length + 1)
    first = np.concatenate([[0], np.cumsum(sizes - length + 1)])
    starts = begin[owner] + np.arange(first[-1]) - first[owner]
    order, common = suffix_order(np.frombuffer(b"".join(contexts), np.uint8), starts, begin[owner + 1], length)
    later = np.zeros(len(order), bool)
    later[order] = previous_factors(docs[owner][order], common, length) >= length
    return later, owner


def spans(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    change = np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8))
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)


_SPAN = np.dtype([("crc", np.uint32), ("start", np.uint32), ("end", np.uint32)])
_CONTEXT = np.dtype([("group", np.uint64), ("crc", np.uint32), ("start", np.uint32), ("size", np.uint32)])


def _touching(docs: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans with those of one text that touch joined; at least one."""
    order = np.lexsort((found["start"], found["crc"], docs))
    d, f = docs[order], found[order]
    text = np.concatenate([[True], (d[1:] != d[:-1]) | (f["crc"][1:] != f["crc"][:-1])])
    number = np.cumsum(text)
    # The furthest end so far in the text; texts are kept apart by adding their number.
    reach = np.maximum.accumulate(f["end"].astype(np.int64) + (number << 33)) - (number << 33)
    new = text.copy()
    new[1:] |= f["start"][1:] > reach[:-1]
    at = np.flatnonzero(new)
    out = f[at]
    out["end"] = reach[np.append(at[1:], len(f)) - 1]
    return d[at], out


class _Places:
    """Contexts with their places: document, crc of its text, first window, group."""

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.columns: list[list] = [[] for _ in range(5)]
        self.size = 0

    def add(self, contexts: list[bytes], doc, crc, start: np.ndarray, group: np.ndarray) -> None:
        n, numbers = len(contexts), self.numbers
        number = np.fromiter((numbers.setdefault(c, len(numbers)) for c in contexts), np.int64, n)
        each = (number, np.broadcast_to(doc, n), np.broadcast_to(crc, n), start, group)
        for c, x in zip(self.columns, each, strict=True):
            c.append(x)
        self.size += n

    def taken(self) -> tuple[list[bytes], tuple, np.ndarray, tuple]:
        """Contexts, places in their smallest documents (by context), smallest
        document by context, and spans ``(docs, spans)`` of the other places."""
        contexts = list(self.numbers)
        number, doc, crc, start, group = (np.concatenate(c) for c in self.columns)
        self.__init__()
        order = np.lexsort((doc, number))
        number, doc, crc, start, group = number[order], doc[order], crc[order], start[order], group[order]
        first = np.concatenate([[True], number[1:] != number[:-1]])
        least = doc[first]
        sizes = np.array([len(c) for c in contexts], np.int64)
        keep = doc == least[number]
        known = np.zeros(int((~keep).sum()), _SPAN)
        known["crc"], known["start"] = crc[~keep], start[~keep]
        return contexts, (number[keep], doc[keep], crc[keep], start[keep], group[keep]), least, (doc[~keep], known, sizes[number[~keep]])


def _context_packets(docs: DataFrame, hits: DataFrame, key: str, text: str, length: int, at: M.Layout) -> DataFrame:
    buckets = at.buckets

    def task() -> tuple:
        held = _Places()

        def add(rows: pa.RecordBatch, notes_of: Callable) -> Iterator[pa.RecordBatch]:
            for doc, data in zip(M.ids(rows.column(0)).tolist(), text_bytes(rows.column(1)), strict=True):
                own = notes_of(doc)
                if not len(own) or not data or len(data) < length:
                    continue
                keys, starts, ends = runs(data, length)
                short, crc = _short(keys), zlib.crc32(data)
                busy = np.isin(short | np.uint32(1 << 31), own) if own.max() >> np.uint32(31) else np.zeros(len(short), bool)
                # Where two keys look alike here, one hot and one not, both ways are gone.
                plain = np.isin(short, own)
                a, b = starts[plain], ends[plain] + length - 1
                held.add([data[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)], doc, crc, a, keys[plain])
                if busy.any():
                    at_ = np.concatenate([np.arange(i, j) for i, j in zip(starts[busy].tolist(), ends[busy].tolist(), strict=True)])
                    parts = window_hashes(np.frombuffer(data, np.uint8), length)[at_]
                    held.add([data[i : i + length] for i in at_.tolist()], doc, crc, at_, parts)
                if held.size >= CONTEXTS:
                    yield from end()

        def end() -> Iterator[pa.RecordBatch]:
            if not held.size:
                return
            contexts, (number, d, crc, start, group), _, (kd, known, sizes) = held.taken()
            out = []
            if len(kd):
                known["end"] = known["start"] + sizes - length + 1
                kd, known = _touching(kd, known)
                out += M.known_packets(kd, known, buckets)
            bucket = M.bucket_of(group, buckets)
            order = np.lexsort((number, group, bucket))
            heads = np.zeros(len(order), _CONTEXT)
            heads["group"], heads["crc"], heads["start"] = group[order], crc[order], start[order]
            bucket, number, d = bucket[order], number[order], d[order]
            heads["size"] = np.array([len(c) for c in contexts], np.int64)[number]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                blob = b"".join([contexts[i] for i in number[a:b].tolist()])
                out.append((int(bucket[a]), d[a:b].tobytes(), np.ones(b - a, np.uint32).tobytes(), M.ENTRY, heads[a:b].tobytes(), zstandard.compress(blob, 1)))
            yield M.packet_batch(out)

        return add, end

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = M.Outbox(buckets)
        for _, kind, rows in M.by_bucket(batches):
            for docs_, found in _later(rows, length) if kind == M.ENTRY else [M.unpacked(rows, _SPAN)]:
                yield from out.put(docs_, found)
        yield from out.end()

    packed = M.meet(docs.select(key, text), hits, key, task, np.uint32, M.PACKET_DDL, at)
    return mapped(M.sent(packed, at), matched, M.PACKET_DDL)


def _later(rows: list[dict], length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Documents and spans of later copies among the contexts of one bucket."""
    held = _Places()
    for r in rows:
        heads, blob = np.frombuffer(r["keys"], _CONTEXT), zstandard.decompress(r["more"])
        ends = np.cumsum(heads["size"].astype(np.int64))
        contexts = [blob[a:b] for a, b in zip((ends - heads["size"]).tolist(), ends.tolist(), strict=True)]
        held.add(contexts, np.frombuffer(r["docs"], np.int64), heads["crc"], heads["start"].astype(np.int64), heads["group"])
    if not held.size:
        return
    contexts, (number, doc, crc, start, group), least, (kd, known, sizes) = held.taken()
    known["end"] = known["start"] + sizes - length + 1
    yield kd, known
    # Places are in the order of their contexts' numbers; groups of one context are done.
    first = np.searchsorted(number, np.arange(len(contexts) + 1))
    group = group[first[:-1]]
    order = np.argsort(group, kind="stable")
    bounds = np.concatenate([[0], np.flatnonzero(np.diff(group[order])) + 1, [len(order)]])
    several = np.repeat(np.diff(bounds) > 1, np.diff(bounds))
    chosen, parts = order[several], group[order[several]]
    windows = np.cumsum(np.array([len(contexts[i]) - length + 1 for i in chosen], np.int64))
    at = 0
    while at < len(chosen):
        # As many groups as have about SUFFIXES suffixes, one at least.
        stop = max(int(np.searchsorted(windows, (windows[at - 1] if at else 0) + SUFFIXES)), at + 1)
        stop = at + int(np.searchsorted(parts[at:], parts[stop - 1], "right"))
        own = chosen[at:stop]
        at = stop
        later, owner = later_suffixes([contexts[i] for i in own.tolist()], least[own], length)
        a, b = spans(later)
        if not len(a):
            continue
        # A run may pass from one context to the next; it is cut there.
        edge = np.flatnonzero(later[1:] & later[:-1] & (owner[1:] != owner[:-1])) + 1
        a, b = np.sort(np.concatenate([a, edge])), np.sort(np.concatenate([b, edge]))
        begins = np.searchsorted(owner, owner[a])
        places = first[own[owner[a]] + 1] - first[own[owner[a]]]
        which = np.repeat(np.arange(len(a)), places)
        place = np.repeat(first[own[owner[a]]], places) + np.arange(len(which)) - np.repeat(np.cumsum(places) - places, places)
        found = np.zeros(len(which), _SPAN)
        found["crc"] = crc[place]
        found["start"] = start[place] + (a - begins)[which]
        found["end"] = start[place] + (b - begins)[which]
        yield doc[place], found


def copies(docs: DataFrame, key: str, text: str, length: int, hot: int, at: M.Layout) -> DataFrame:
    """Stored notes: ranges of windows of each document that are later copies."""
    hits = store(_minimiser_packets(docs, key, text, length, at, hot), "minimisers")
    found = store(_context_packets(docs, hits, key, text, length, at), "copies")
    discard(hits)
    return found


def removed_bytes(data: bytes, notes: np.ndarray, length: int) -> np.ndarray:
    change = np.zeros(len(data) + 1, np.int64)
    if len(notes):
        own = notes[notes["crc"] == zlib.crc32(data)]
        np.add.at(change, own["start"].astype(np.int64), 1)
        np.add.at(change, own["end"].astype(np.int64) + length - 1, -1)
    return np.cumsum(change[:-1]) > 0


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, with_text: bool = False, hot: int = HOT) -> DataFrame:
    """Per document: ``n_bytes, n_removed, n_spans, kept_sha256``, and with
    ``with_text`` the remaining bytes (a cut may fall inside a character)."""
    kind = docs.schema[key].dataType.simpleString()

    def run(rows: pa.RecordBatch, later: Callable) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], [], [], [], []]
        for doc, data in zip(M.ids(rows.column(0)).tolist(), text_bytes(rows.column(1)), strict=True):
            data = data or b""
            own = later(doc)
            gone = removed_bytes(data, own, length) if len(own) else np.zeros(len(data), bool)
            n = int(gone.sum())
            kept = np.frombuffer(data, np.uint8)[~gone].tobytes() if n else data
            for c, x in zip(out, (len(data), n, len(spans(gone)[0]) if n else 0, sha256(kept).hexdigest(), kept), strict=True):
                c.append(x)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        names = [key, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        arrays = [rows.column(0), *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))]
        yield pa.RecordBatch.from_arrays(arrays if with_text else arrays[:-1], names=names if with_text else names[:-1])

    at = M.layout(docs, text)
    found = copies(docs, key, text, length, hot, at)
    schema = f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return M.meet(docs.select(key, text), found, key, M.each(run), _SPAN, schema, at)
