"""Byte-level BPE encoding and decoding with a contiguous rank array.

A text is cut into pieces by the vocabulary's pattern. For each piece the part
boundaries and the ranks of adjacent pairs lie in two arrays; the smallest rank
is found by scanning, its boundary is deleted and the neighbouring ranks are
refreshed, until no pair has a rank. Pieces over ``SHORT`` bytes use a heap
with the same order of merges, as scanning would be quadratic.

Edge cases: a null text counts as empty and has no ids; strings of special
tokens inside a text get the special id, as the library does by default;
repeated rows are encoded alike; a text of any length is encoded whole, in one
task; a row without an id keeps its null; further columns are unread; an empty
table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from strataloom.llm.common import mapped, slices

#: The pattern of the public byte-level vocabulary (fixed value).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHORT = 256
#: Chunks of text whose ids a worker remembers, and their greatest length.
CACHE = 1_000_000
CACHE_CHARS = 48
_INF = 1 << 60


def byte_letters() -> dict[str, int]:
    """The printable letter of each byte in byte-level vocabularies: printable
    Latin-1 bytes stand for themselves, others for letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Encoder and decoder of a tokenizers file with a byte-level BPE model."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        self.ids = {raw(token): i for token, i in spec["model"]["vocab"].items()}
        self.tokens = {str(i): token for token, i in self.ids.items()}
        self.ranks: dict[tuple[bytes, bytes], int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[raw(left), raw(right)] = rank
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {str(i): s.encode() for s, i in self.special.items()}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special))) + ")")
        self.pieces = regex.compile(PIECES)
        self.loose = regex.compile(r"\s | \s|^ | $")
        self.cut = regex.compile(r"(?<=\S) (?=\S)")
        self.known: dict[str, dict[str, str]] = {" ": {}, "": {}}
        self.single = [bytes([b]) for b in range(256)]

    def merge(self, piece: bytes) -> list[bytes]:
        """Parts of one piece after all merges."""
        if len(piece) > SHORT:
            return self._merge_long(piece)
        get, bounds = self.ranks.get, list(range(len(piece) + 1))
        ranks = [get((piece[i : i + 1], piece[i + 1 : i + 2]), _INF) for i in range(len(piece) - 1)]
        while ranks:
            least = min(ranks)
            if least == _INF:
                break
            i = ranks.index(least)
            del bounds[i + 1], ranks[i]
            a, b = bounds[i], bounds[i + 1]
            if i < len(ranks):
                ranks[i] = get((piece[a:b], piece[b : bounds[i + 2]]), _INF)
            if i:
                ranks[i - 1] = get((piece[bounds[i - 1] : a], piece[a:b]), _INF)
        return [piece[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def _merge_long(self, piece: bytes) -> list[bytes]:
        n, get = len(piece), self.ranks.get
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts at i
        heap = []

        def push(i: int) -> None:
            if i >= 0 and (j := end[i]) < n and (r := get((piece[i:j], piece[j : end[j]]))) is not None:
                heapq.heappush(heap, (r, i, j, end[j]))

        for i in range(n - 1):
            push(i)
        alive = bytearray([1]) * n
        while heap:
            _, i, j, k = heapq.heappop(heap)
            if alive[i] and alive[j] and end[i] == j and end[j] == k:
                alive[j], end[i] = 0, k
                if k < n:
                    before[k] = i
                push(i)
                push(before[i])
        out, i = [], 0
        while i < n:
            out.append(piece[i : end[i]])
            i = end[i]
        return out

    def _ids(self, text: str) -> str:
        """Ids of a text without special tokens, in decimal, joined by commas."""
        ids = self.ids
        return ",".join(str(ids[part]) for piece in self.pieces.findall(text) for part in self.merge(piece.encode()))

    def _chunk(self, chunk: str, lead: str) -> str:
        """Ids of a chunk that follows a space (``lead`` " ") or nothing ("")."""
        known = self.known[lead]
        if (found := known.get(chunk)) is not None:
            return found
        stem = chunk.rstrip(".,;:!?")
        if len(stem) < len(chunk) and stem.isalpha():
            # Letters and the punctuation behind them are separate pieces.
            found = f"{self._chunk(stem, lead)},{self._chunk(chunk[len(stem):], '')}"
        elif "\n" in chunk and all(p and not p[0].isspace() and not p[-1].isspace() for p in chunk.split("\n")):
            # So is a line feed between two other characters.
            first, *rest = chunk.split("\n")
            feed = self._chunk_ids("\n")
            return ",".join([self._chunk(first, lead), *(x for p in rest for x in (feed, self._chunk(p, "")))])
        else:
            found = self._ids(lead + chunk)
        if len(chunk) <= CACHE_CHARS:
            if len(known) >= CACHE:
                known.clear()
            known[chunk] = found
        return found

    def _chunk_ids(self, text: str) -> str:
        found = self.known[""].get(text)
        if found is None:
            found = self.known[""][text] = self._ids(text)
        return found

    def _ordinary(self, text: str) -> str:
        # A space between two other characters always starts a piece, so that
        # chunks between such spaces can be encoded, and remembered, alone.
        chunks = self.cut.split(text) if self.loose.search(text) else text.split(" ")
        known = self.known[" "].get
        out = [self._ids(chunks[0])]
        out += [known(c) or self._chunk(c, " ") for c in chunks[1:]]
        return ",".join(out)

    def encode(self, text: str) -> str:
        """Ids in decimal, joined by commas ('' for an empty text)."""
        if not text:
            return ""
        if any(s in text for s in self.special):
            parts = (
                str(self.special[x]) if x in self.special else self._ordinary(x)
                for x in self.special_split.split(text) if x
            )
            return ",".join(parts)
        return self._ordinary(text)

    def decode(self, ids: str) -> str:
        """Text of ids in decimal joined by commas; broken UTF-8 is replaced."""
        if not ids:
            return ""
        return b"".join(map(self.tokens.__getitem__, ids.split(","))).decode("utf-8", "replace")


_loaded: dict[str, ByteBpe] = {}


def loaded(path: str) -> ByteBpe:
    """The encoder of a file, read once in each worker."""
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


def encode_decode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text",
                  output: str = "digest") -> DataFrame:
    """Encode each whole text and decode its ids again.

    ``output`` "digest" gives ``n_tokens, ids_sha256, decoded_sha256``; "full"
    gives ``n_tokens``, the ids as an array of ints, and the decoded text.
    """
    full = output == "full"
    kind = docs.schema[key].dataType.simpleString()
    more = "ids array<int>, decoded string" if full else "ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in slices(batches):
            counts, first, second = [], [], []
            for t in batch.column(1).to_pylist():
                ids = bpe.encode(t or "")
                decoded = bpe.decode(ids)
                counts.append(ids.count(",") + 1 if ids else 0)
                if full:
                    first.append([int(i) for i in ids.split(",")] if ids else [])
                    second.append(decoded)
                else:
                    first.append(sha256(ids.encode()).hexdigest())
                    second.append(sha256(decoded.encode()).hexdigest())
            names = [key, "n_tokens", *(("ids", "decoded") if full else ("ids_sha256", "decoded_sha256"))]
            arrays = [batch.column(0), pa.array(counts, pa.int64()), pa.array(first, pa.list_(pa.int32()) if full else pa.string()), pa.array(second, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return mapped(docs.select(key, text), run, f"`{key}` {kind}, n_tokens long, {more}")
