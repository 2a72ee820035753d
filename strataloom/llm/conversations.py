"""Repair of conversation structure by cheapest edits.

A conversation is well formed if the first letters of its roles read
``(s?(ua)+)?``. Its rows, in order of turn, are kept (0), rerolled to user or
assistant (1) or deleted (2); empty messages may be put in anywhere (5); a
truncated message that stays costs 5 more, and blank or repeated ones must go.
With four states of that pattern between any two rows this is a shortest path
with costs of 0 to 7, found by Dial's bucket queue from the end; recorded
distances tell the tight arcs, and the least walk along them is the audit.

Rows are sorted over range partitions, so a conversation of any size spreads
over tasks, and are cut to segments of bounded rows and bytes. One that lies
within a partition is repaired there. The others, two a partition and very long
ones, meet as segments: messages seen in an earlier segment by a key, distances
by a 4 x 4 table a segment, then the walk from segment to segment. Only the
digest of a repaired conversation, which no hash can take in parts, is streamed
through one task, a segment at a time.

Edge cases: null roles and texts count as one space; rows of a null ``conv_id``
are one conversation; rows of equal turn are ordered by a hash of role and text;
repeated rows are duplicates of the first; a role without a letter fits nowhere;
a conversation that loses all rows has zeros, an empty audit and the digest of
an empty text; texts of any length are compared by digest only; an empty table
gives an empty result; further columns are unread.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.llm.common import mapped, scratch, slices, store, work_dir

SPACE = " \t\n\x0b\x0c\r"
#: Rows, and about bytes of text, of a segment.
SEGMENT_ROWS, SEGMENT_BYTES = 4096, 4 << 20
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
FAR = 1 << 60
#: States of ``(s?(ua)+)?``: nothing yet, after s, after u, after a.
STEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
#: Messages to put in after each state until the pattern may end.
_TO_END = (0, 2, 1, 0)
ROLES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")


def damaged(rows: DataFrame) -> DataFrame:
    """Rows after damage by a hash of ``conv_id:turn``; dropped ones stay as
    rows with ``gone``, so that each conversation is kept."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat_ws(":", *text).cast("binary")) % 20
    told = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")), kind.alias("k"))
    k = F.col("k")
    changed = F.when(k.isin(0, 1), "").when(k == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(k == 3, F.array_repeat(F.lit(0), 2)).otherwise(F.array(F.lit(0)))
    return told.select(
        "conv_id", "turn", F.when(k == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"),
        (k == 0).alias("gone"), F.explode(copies).alias("copy"),
    ).drop("copy")


def _arcs(sign: str, state: int) -> list[tuple[str, int, int, int]]:
    """Edits of the next row, given as its sign, and inserts: letter, rows
    used, next state, cost. Letters are unique and in ASCII order."""
    out = []
    if sign:
        initial, fault = sign
        out.append(("D", 1, state, DELETE))
        more = TRUNCATED if fault == "t" else 0
        if fault != "x" and initial in STEPS[state]:
            out.append(("K", 1, STEPS[state][initial], KEEP + more))
    for letter in ROLES:
        if letter in STEPS[state]:
            out.append(("I", 0, STEPS[state][letter], INSERT))
            if sign and fault != "x":
                out.append(("R", 1, STEPS[state][letter], REROLE + more))
    return sorted(out)


def distances(signs: str, ends: dict[int, int]) -> list[list[int]]:
    """Dial's algorithm: the least cost from each (row, state) to the end, where
    state ``e`` costs ``ends[e]`` more. ``signs`` has two letters a row: the
    role's first letter, and t (truncated), x (must go) or '-'."""
    n = len(signs) // 2
    into: dict[tuple[str, int], list[tuple[int, int, int]]] = {}
    for sign in {signs[2 * i : 2 * i + 2] for i in range(n)} | {""}:
        for state in range(4):
            for _, used, after, cost in _arcs(sign, state):
                if used or not sign:
                    into.setdefault((sign, after), []).append((used, state, cost))
    best = [[FAR] * 4 for _ in range(n + 1)]
    widest = DELETE + INSERT + TRUNCATED
    buckets: list[list[tuple[int, int]]] = [[] for _ in range(widest + 1)]
    least, waiting, begin = min(ends.values(), default=0), 0, {}
    for e, cost in ends.items():
        begin.setdefault(cost - least, []).append((n, e))
    at = 0
    while waiting or begin:
        if at in begin:
            for i, q in begin.pop(at):
                if at < best[i][q]:
                    best[i][q] = at
                    buckets[at % len(buckets)].append((i, q))
                    waiting += 1
        bucket = buckets[at % len(buckets)]
        while bucket:
            i, q = bucket.pop()
            waiting -= 1
            if best[i][q] != at:
                continue
            arcs = into.get(("", q), [])
            if i:
                arcs = arcs + into.get((signs[2 * i - 2 : 2 * i], q), [])
            for used, state, cost in arcs:
                if at + cost < best[i - used][state]:
                    best[i - used][state] = at + cost
                    buckets[(at + cost) % len(buckets)].append((i - used, state))
                    waiting += 1
        at += 1
    return [[d + least if d < FAR else FAR for d in row] for row in best]


def walk(signs: str, best: list[list[int]], state: int, last: bool) -> tuple[str, list[str], int]:
    """The ASCII-least walk along tight arcs: letters, the role that each gives
    ('' for deletions, '=' for kept ones), and the state at the end. Inserts
    after the last row are left to the next segment, unless this is the last."""
    n, i, letters, roles = len(signs) // 2, 0, [], []
    while i < n or (last and best[n][state]):
        for letter, used, after, cost in _arcs(signs[2 * i : 2 * i + 2], state):
            if best[i + used][after] + cost == best[i][state]:
                break
        letters.append(letter)
        roles.append("" if letter == "D" else "=" if letter == "K" else ROLES["u" if after == 2 else "a"])
        i, state = i + used, after
    return "".join(letters), roles, state


@lru_cache(maxsize=1 << 14)
def _short(signs: str) -> tuple[int, str, tuple[str, ...]]:
    return _whole(signs)


def _whole(signs: str) -> tuple[int, str, tuple[str, ...]]:
    best = distances(signs, dict.fromkeys(ENDS, 0))
    audit, roles, _ = walk(signs, best, 0, True)
    return best[0][0], audit, tuple(roles)


def repair(signs: str) -> tuple[int, str, tuple[str, ...]]:
    """Cost, audit and roles of a whole conversation; short ones are remembered."""
    return _short(signs) if len(signs) <= 64 else _whole(signs)


def fault(role: str, text: str, seen: set[bytes]) -> tuple[str, bytes | None]:
    """b (blank), d (duplicate), t (truncated) or '-', and the message's key if new."""
    end = text.rstrip(SPACE)[-1:]
    if not end:
        return "b", None
    key = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(errors="surrogatepass"), digest_size=16).digest()
    if key in seen:
        return "d", None
    seen.add(key)
    return ("-" if end in ".!?" else "t"), key


def _signs(roles: list[str], faults: str) -> str:
    return "".join((r[:1] or "\0") + ("x" if f in "bd" else f) for r, f in zip(roles, faults, strict=True))


def repaired(roles: list[str], texts: list[str], made: tuple[str, ...] | list[str]) -> Iterator[str]:
    """Messages of the repaired rows, in order."""
    i = 0
    for letter, role in made:
        if letter == "I":
            yield f"{role}:"
            continue
        if letter != "D":
            yield f"{roles[i] if role == '=' else role}:{texts[i]}"
        i += 1


def _digest(parts: Iterator[str]) -> str:
    h, first = hashlib.sha256(), True
    for p in parts:
        h.update(("" if first else "\n").encode() + p.encode(errors="surrogatepass"))
        first = False
    return h.hexdigest()


def _illegal(roles: list[str]) -> int:
    return sum((a[:1] + b[:1]) not in LEGAL for a, b in zip(roles, roles[1:], strict=False))


class _Segment:
    """Rows of one conversation that follow each other, as they come."""

    def __init__(self, seen: set[bytes]):
        self.roles, self.texts, self.keys, self.faults, self.turns, self.distinct, self.bytes, self.seen = [], [], [], [], [], 0, 0, seen

    def add(self, turn: int | None, role: str, text: str) -> None:
        f, key = fault(role, text, self.seen)
        self.roles.append(role), self.texts.append(text), self.faults.append(f), self.keys.append(key)
        self.bytes += len(text)
        if turn is not None and (not self.turns or turn != self.turns[1]):
            self.turns = [self.turns[0] if self.turns else turn, turn]
            self.distinct += 1

    def full(self, most: int) -> bool:
        return len(self.roles) >= most or self.bytes >= SEGMENT_BYTES


_LONG, _INT, _TEXT = pa.int64(), pa.int32(), pa.string()
_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_TOLD = [("gaps", _LONG), *((c, _LONG) for c in _COUNTS), ("cost", _LONG), ("audit", _TEXT), ("repaired_sha256", _TEXT)]
_CUT = [
    ("part", _INT), ("no", _INT), ("roles", pa.list_(_TEXT)), ("texts", pa.list_(_TEXT)), ("faults", _TEXT),
    ("keys", pa.list_(pa.binary())), ("low", _LONG), ("high", _LONG), ("distinct_turns", _LONG),
]
_TABLE = [
    ("part", _INT), ("no", _INT), ("signs", _TEXT), *((c, _LONG) for c in _COUNTS), ("head", _TEXT), ("tail", _TEXT), ("ways", pa.list_(_LONG)),
]
_AHEAD = [("part", _INT), ("no", _INT), ("after", pa.list_(_LONG)), ("last", pa.bool_())]
_WALKS = [("part", _INT), ("no", _INT), ("audits", pa.list_(_TEXT)), ("states", pa.list_(_INT)), ("cost", _LONG)]
_SQL = {_LONG: "long", _INT: "int", _TEXT: "string", pa.binary(): "binary", pa.bool_(): "boolean"}


def _ddl(fields: list) -> str:
    kind = lambda t: f"array<{_SQL[t.value_type]}>" if pa.types.is_list(t) else _SQL[t]
    return ", ".join(f"{name} {kind(t)}" for name, t in fields)


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _told(s: _Segment) -> list:
    faults, signs = "".join(s.faults), _signs(s.roles, "".join(s.faults))
    cost, audit, made = repair(signs)
    gaps = s.turns[1] - s.turns[0] + 1 - s.distinct if s.turns else 0
    digest = _digest(repaired(s.roles, s.texts, zip(audit, made, strict=True)))
    return [gaps, *(faults.count(f) for f in "bdt"), _illegal(s.roles), cost, audit, digest]


def segments(rows: DataFrame, most: int = SEGMENT_ROWS) -> DataFrame:
    """Finished conversations of sorted rows, and segments (``part`` is not
    null) of those that may lie in more than one partition or are long."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no, out, size, first, schema = TaskContext.get().partitionId(), 0, [], 0, True, None
        conv, held = None, None  # the conversation at hand, and its segments so far

        def cut(s: _Segment) -> list:
            nonlocal no
            no += 1
            low, high = s.turns or (None, None)
            return [conv[0], *[None] * 8, part, no, s.roles, s.texts, "".join(s.faults), s.keys, low, high, s.distinct]

        def batch() -> pa.RecordBatch:
            nonlocal out, size
            made = _batch(out, schema)
            out, size = [], 0
            return made

        def told(ends: bool) -> None:
            """The conversation at hand is over; ``ends`` if the partition is, too."""
            nonlocal size
            if conv is None:
                return
            s, edge = held
            size += s.bytes if edge or ends else 100
            out.append(cut(s) if edge or ends else [conv[0], *_told(s), *[None] * 9])

        for b in slices(batches):
            schema = schema or pa.schema([("conv_id", b.schema.field(0).type), *_TOLD, *_CUT])
            ids, turns, roles, texts, gone = (c.to_pylist() for c in b.columns)
            for c, turn, role, message, lost in zip(ids, turns, roles, texts, gone, strict=True):
                if conv is None or c != conv[0]:
                    told(False)
                    conv, held = (c,), [_Segment(set()), first]
                    first = False
                if lost:
                    continue
                s = held[0]
                if s.full(most):
                    size += s.bytes
                    out.append(cut(s))
                    held = [s := _Segment(set()), True]
                s.add(turn, role, message)
                if len(out) >= 512 or size >= SEGMENT_BYTES:
                    yield batch()
        told(True)
        if out:
            yield batch()

    return mapped(rows, run, f"conv_id {kind}, {_ddl(_TOLD)}, {_ddl(_CUT)}")


def _unseen(cut: DataFrame) -> DataFrame:
    """Segments with the places of messages that an earlier segment holds, as ``again``.

    A key is once in a segment, so a message has as many rows here as segments hold it."""
    keys = cut.select("conv_id", "part", "no", F.posexplode("keys").alias("at", "key")).filter("key is not null")
    heads = keys.groupBy("conv_id", "key").agg(F.min(F.struct("part", "no")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    heads = heads.select(F.col("conv_id").alias("in_conv"), F.col("key").alias("in_key"), "first")
    same = F.col("key").eqNullSafe(F.col("in_key")) & F.col("conv_id").eqNullSafe(F.col("in_conv"))
    repeats = keys.join(heads, same).filter(F.struct("part", "no") > F.col("first"))
    return cut.join(repeats.groupBy("part", "no").agg(F.collect_list("at").alias("again")), ["part", "no"], "left")


def _with_faults(faults: str, again: list[int] | None) -> str:
    if not again:
        return faults
    told = list(faults)
    for i in again:
        told[i] = "d"
    return "".join(told)


def _tables(cut: DataFrame) -> DataFrame:
    """A row per segment: counts, end roles, and least costs between states."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 16):
            rows = []
            for r in b.to_pylist():
                faults = _with_faults(r["faults"], r["again"])
                signs = _signs(r["roles"], faults)
                ways = [distances(signs, {e: 0})[0] for e in range(4)] if signs else [[0 if q == e else FAR for q in range(4)] for e in range(4)]
                rows.append((
                    r["part"], r["no"], signs, *(faults.count(f) for f in "bdt"), _illegal(r["roles"]),
                    r["roles"][0][:1] if signs else None, r["roles"][-1][:1] if signs else None, [ways[e][q] for q in range(4) for e in range(4)],
                ))
            if rows:
                yield _batch(rows, pa.schema(_TABLE))

    wanted = cut.select("part", "no", "roles", "faults", "again")
    made = mapped(wanted, run, _ddl(_TABLE))
    return cut.select("conv_id", "part", "no", "low", "high", "distinct_turns").join(made, ["part", "no"])


def _by_conversation(df: DataFrame, *order: Column) -> DataFrame:
    """Rows of a conversation in one task, in order; they are streamed, never held.
    Only segments come here, each for up to ``SEGMENT_ROWS`` rows."""
    return df.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def _ahead(tables: DataFrame) -> DataFrame:
    """Least costs from each state after a segment to the conversation's end, by a fold from the last segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, costs = None, None
        for b in slices(batches):
            rows = []
            for c, part, no, ways in zip(*(b.column(x).to_pylist() for x in ("conv_id", "part", "no", "ways")), strict=True):
                last = conv is None or c != conv[0]
                if last:
                    conv, costs = (c,), [INSERT * n for n in _TO_END]
                rows.append((part, no, costs, last))
                costs = [min(ways[4 * q + e] + costs[e] for e in range(4)) for q in range(4)]
            if rows:
                yield _batch(rows, pa.schema(_AHEAD))

    sorted_rows = _by_conversation(tables.select("conv_id", "part", "no", "ways"), F.desc("part"), F.desc("no"))
    return mapped(sorted_rows, run, _ddl(_AHEAD))


def _walks(tables: DataFrame) -> DataFrame:
    """For each state before a segment the audit of its rows, and the state after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            rows = []
            for part, no, signs, after, last in zip(*(b.column(x).to_pylist() for x in ("part", "no", "signs", "after", "last")), strict=True):
                best = distances(signs, dict(enumerate(after)))
                ways = [walk(signs, best, q, last) for q in range(4)]
                rows.append((part, no, [w[0] for w in ways], [w[2] for w in ways], best[0][0]))
            if rows:
                yield _batch(rows, pa.schema(_WALKS))

    return mapped(tables.select("part", "no", "signs", "after", "last"), run, _ddl(_WALKS))


def _joined(rows: DataFrame) -> DataFrame:
    """One row per conversation from its segments in order, streamed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None

        def stream() -> Iterator[dict]:
            nonlocal schema
            for b in slices(batches, 4):
                schema = schema or pa.schema([b.schema.field("conv_id"), *map(pa.field, *zip(*_TOLD, strict=True))])
                yield from b.to_pylist()

        for conv, parts in groupby(stream(), key=lambda r: (r["conv_id"],)):
            h, state, first, audit, low, high, distinct, tail = hashlib.sha256(), 0, True, [], None, None, 0, None
            counts, cost = dict.fromkeys(_COUNTS, 0), None
            for r in parts:
                cost = r["cost"] if cost is None else cost
                letters = r["audits"][state]
                roles = _roles(letters, state, r["roles"])
                for message in repaired(r["roles"], r["texts"], zip(letters, roles, strict=True)):
                    h.update(("" if first else "\n").encode() + message.encode(errors="surrogatepass"))
                    first = False
                audit.append(letters)
                state = r["states"][state]
                for c in counts:
                    counts[c] += r[c]
                if r["head"] is not None:
                    counts["illegal"] += tail is not None and (tail + r["head"]) not in LEGAL
                    tail = r["tail"]
                if r["low"] is not None:
                    distinct += r["distinct_turns"] - (high is not None and high == r["low"])
                    low, high = r["low"] if low is None else low, r["high"]
            gaps = high - low + 1 - distinct if low is not None else 0
            yield _batch([(conv[0], gaps, *counts.values(), cost, "".join(audit), h.hexdigest())], schema)

    kind = rows.schema["conv_id"].dataType.simpleString()
    return mapped(_by_conversation(rows, F.col("part"), F.col("no")), run, f"conv_id {kind}, {_ddl(_TOLD)}")


def _roles(letters: str, state: int, own: list[str]) -> list[str]:
    """Roles that an audit gives from a state on."""
    out, i = [], 0
    for letter in letters:
        if letter == "K":
            state = STEPS[state][own[i][:1]]
            out.append("=")
        elif letter == "D":
            out.append("")
        else:
            state = 3 if state == 2 else 2
            out.append(ROLES["u" if state == 2 else "a"])
        i += letter != "I"
    return out


def repairs(conversations: DataFrame, damage: bool = True, most: int = SEGMENT_ROWS) -> DataFrame:
    """One row per conversation: faults, cost, audit and digest of the cheapest repair."""
    rows = conversations.select("conv_id", "turn", "role", "text")
    if damage:
        rows = damaged(rows)
    else:
        texts = (F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text"))
        rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *texts, F.lit(False).alias("gone"))
    # Equal rows part by their number, so that no range holds more than its share.
    rows = rows.withColumn("mark", F.xxhash64("role", "text")).withColumn("row", F.monotonically_increasing_id())
    order = ["conv_id", F.col("turn").asc_nulls_first(), "mark"]
    rows = rows.repartitionByRange(*order, "row").sortWithinPartitions(*order)
    outer, names = work_dir(conversations.sparkSession), ["conv_id", *(c for c, _ in _TOLD)]
    made = store(segments(rows.select("conv_id", "turn", "role", "text", "gone"), most), "conversation-repairs", outer)
    with scratch(conversations.sparkSession):
        cut = store(_unseen(made.filter("part is not null").select("conv_id", *(c for c, _ in _CUT))), "segments")
        tables = store(_tables(cut), "segment-tables")
        walks = _walks(tables.join(_ahead(tables), ["part", "no"]))
        told = tables.drop("signs", "ways").join(walks, ["part", "no"]).join(cut.select("part", "no", "roles", "texts"), ["part", "no"])
        long = store(_joined(told), "conversation-repairs", outer)
    return made.filter("part is null").select(*names).unionByName(long.select(*names))
