"""Bounded-space online packing of token sequences.

Every partition keeps at most ``OPEN`` open windows. A document's tokens first
fill whole windows; the rest goes to the open window that it leaves least space
in (best fit). Where none fits and all windows are open, the rest is cut to
fill the fullest window exactly, that window is emitted, and what remains is
placed in turn. At the end of a partition the open windows are merged into full
ones, so that less than one window is left; leftovers are then merged over
partitions in groups, round by round, until one group is left. Only the last
leftover can't fill a window: it is cut at powers of two, which need no
padding.

Edge cases: a null text counts as empty, and an empty text still has its end
token; a document longer than a window is cut; repeated rows are packed as
separate documents, and so are rows without an id; a document of any length is
encoded whole; of windows with equal room one is taken; further columns are
unread; an empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.bpe import byte_letters
from strataloom.llm.common import mapped, slices, store, text_bytes

WINDOW = 2048
#: Windows that a partition keeps open.
OPEN = 64
#: Leftovers that one task of a merge round takes.
GROUP = 256
#: Words whose ids a worker remembers, and their greatest length in bytes.
CACHE = 200_000
CACHE_BYTES = 48

PIECES = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()),
])
PIECES_DDL = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long, ids binary"
)
COLUMNS = [f.name for f in PIECES][:-1]

_words: dict[str, tuple] = {}


def word_encoder(path: str) -> Callable[[bytes], bytes]:
    """A function from a text in UTF-8 to its ids, as little-endian unsigned
    32-bit numbers. The vocabulary drops white space and never joins what it
    parts, so the library encodes each distinct word once. The vocabulary has
    no upper case; A-Z are lowered first, unless special tokens may be there."""
    if path not in _words:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _words[path] = (tokenizer, {})
    tokenizer, known = _words[path]

    letters = {b: c for c, b in byte_letters().items()}

    def ids_of(text: str) -> bytes:
        # One piece of letters in lower case is what the model itself takes.
        if text.isalpha() and text == text.lower() and (text.isascii() or unicodedata.is_normalized("NFC", text)):
            piece = text if text.isascii() else "".join([letters[b] for b in text.encode()])
            return array("I", [t.id for t in tokenizer.model.tokenize(piece)]).tobytes()
        return array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def learned(word: bytes) -> bytes:
        """Ids of a word, remembered for later. Punctuation that ends a word of
        letters is a piece of its own."""
        if len(known) > CACHE:
            known.clear()
        stem = word.rstrip(b".,;:!?")
        if len(stem) < len(word) and stem[-1:].isalpha():
            tail = word[len(stem) :]
            ids = (known.get(stem) or learned(stem)) + (known.get(tail) or learned(tail))
        else:
            ids = ids_of(word.decode())
        if len(word) <= CACHE_BYTES:
            known[word] = ids
        return ids

    def encode(data: bytes) -> bytes:
        words = (data if b"<|" in data else data.lower()).split()
        get = known.get
        return b"".join([get(w) or learned(w) for w in words])

    return encode


class Packer:
    """Open windows of one partition; ``full`` returns what is finished.

    A piece is ``[doc_id, start, ids, doc_tokens]`` with its ids as bytes.
    """

    def __init__(self, window: int = WINDOW, open_windows: int = OPEN):
        self.size, self.most = 4 * window, open_windows
        self.open: list[list] = []  # [bytes used, pieces]
        self.done: list[list] = []  # pieces of each full window

    def add(self, doc_id, start: int, ids: bytes, doc_tokens: int) -> None:
        size, at = self.size, 0
        while len(ids) - at >= size:
            self.done.append([(doc_id, start + at // 4, ids[at : at + size], doc_tokens)])
            at += size
        while at < len(ids):
            rest = len(ids) - at
            best = max((w for w in self.open if size - w[0] >= rest), key=lambda w: w[0], default=None)
            if best is None and len(self.open) < self.most:
                best = [0, []]
                self.open.append(best)
            if best is None:
                best = max(self.open, key=lambda w: w[0])
                rest = size - best[0]
            best[1].append((doc_id, start + at // 4, ids[at : at + rest], doc_tokens))
            best[0] += rest
            at += rest
            if best[0] == size:
                self.done.append(best[1])
                self.open = [w for w in self.open if w is not best]

    def finish(self) -> None:
        """Merge the open windows: the emptiest give their pieces to the fullest."""
        windows = sorted(self.open, key=lambda w: -w[0])
        self.most, self.open = 1, []
        for w in windows:
            for piece in w[1]:
                self.add(*piece)

    def full(self) -> list[list]:
        out, self.done = self.done, []
        return out


def _rows(windows: list[list], first: int, keep_ids: bool) -> pa.RecordBatch:
    columns: list[list] = [[] for _ in PIECES]
    for n, pieces in enumerate(windows):
        offset = 0
        for doc_id, start, ids, doc_tokens in pieces:
            for c, x in zip(columns, (doc_id, start, len(ids) // 4, zlib.crc32(ids), doc_tokens, first + n, offset, ids if keep_ids else None), strict=True):
                c.append(x)
            offset += len(ids) // 4
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PIECES, strict=True)], schema=PIECES)


def _packed(pieces: Iterator[tuple], base: int, window: int, open_windows: int, last: bool) -> Iterator[pa.RecordBatch]:
    packer, n = Packer(window, open_windows), base
    for piece in pieces:
        packer.add(*piece)
        if len(packer.done) >= 512:
            full = packer.full()
            yield _rows(full, n, False)
            n += len(full)
    packer.finish()
    full = packer.full()
    yield _rows(full, n, False)
    n += len(full)
    for _, rest in packer.open:
        if not last:
            yield _rows([rest], n, True)
            continue
        cut = power_cuts(rest)
        yield _rows(cut, n, False)


def power_cuts(pieces: list[tuple]) -> list[list]:
    """Windows whose lengths are falling powers of two, from less than a window."""
    left = sum(len(p[2]) for p in pieces) // 4
    out, todo = [], list(reversed(pieces))
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        window = []
        while room:
            doc_id, start, ids, doc_tokens = todo.pop()
            take = min(room, len(ids) // 4)
            window.append((doc_id, start, ids[: 4 * take], doc_tokens))
            if 4 * take < len(ids):
                todo.append((doc_id, start + take, ids[4 * take :], doc_tokens))
            room -= take
        out.append(window)
    return out


def pack(docs: DataFrame, path: str, end_id: int = 1, window: int = WINDOW, open_windows: int = OPEN,
         key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: where a run of a document's ids lies in a sequence."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = word_encoder(path), end_id.to_bytes(4, "little")

        def pieces() -> Iterator[tuple]:
            for batch in slices(batches):
                for doc_id, data in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                    ids = encode(data or b"") + end
                    yield doc_id, 0, ids, len(ids) // 4

        yield from _packed(pieces(), TaskContext.get().partitionId() << 32, window, open_windows, False)

    def merge(level: int, last: bool) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def pieces() -> Iterator[tuple]:
                names = ("doc_id", "start", "ids", "doc_tokens")
                for batch in slices(batches):
                    yield from zip(*(batch.column(n).to_pylist() for n in names), strict=True)

            base = (level << 58) | (TaskContext.get().partitionId() << 32)
            yield from _packed(pieces(), base, window, open_windows, last)

        return run

    packed = store(mapped(docs.select(F.col(key).cast("long").alias("doc_id"), text), first, PIECES_DDL), "packed")
    done = [packed.filter(F.col("ids").isNull())]
    left, level = packed.filter(F.col("ids").isNotNull()), 0
    while True:
        level += 1
        groups = left.select("sequence_id").distinct().count() // GROUP + 1
        keyed = left.repartition(groups, "sequence_id") if groups > 1 else left.coalesce(1)
        merged = store(mapped(keyed.sortWithinPartitions("sequence_id", "offset"), merge(level, groups == 1), PIECES_DDL), "packed")
        done.append(merged.filter(F.col("ids").isNull()))
        left = merged.filter(F.col("ids").isNotNull())
        if groups == 1:
            out = done[0]
            for x in done[1:]:
                out = out.unionByName(x)
            return out.select(*COLUMNS)
