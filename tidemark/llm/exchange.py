"""Shuffling of packed keys: many numbers in one row, grouped by a prefix of their hash.

Each chunk sorts its distinct keys and cuts them into ``parts`` ranges of the
hash.  It sends one row to each range, so a key that is common everywhere costs
one entry a chunk, however many rows of the corpus have it.  ``parts`` grows
with the corpus, which bounds what one reducer holds; where more than
ROWS_PER_TASK chunks may send to a part, they are dealt to several reducers, and
what these make of their keys is reduced once more.  Answers name keys by
their place in the chunk's own list; the chunk computes that list again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored
from tidemark.llm.kernel import U64

#: About so many keys, of all chunks together, go to one reducer.
KEYS_PER_PART = 1 << 21
#: So many chunks at most send to one reducer.
ROWS_PER_TASK = 1 << 16

SENT = "part int, chunk long, keys binary, checks binary, places binary, values binary"
_SENT = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), *[(name, pa.binary()) for name in ("keys", "checks", "places", "values")]])
ANSWERED = "chunk long, part int, places binary, values binary"
_ANSWERED = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("places", pa.binary()), ("values", pa.binary())])


def parts_for(chunks: DataFrame, keys_per_byte: float = 0.17) -> tuple[int, int]:
    """A power of two, at least 8, such that a reducer gets about KEYS_PER_PART keys; and the number of chunks."""
    found = chunks.agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).first()
    parts = 8
    while parts * KEYS_PER_PART < (found["size"] or 0) * keys_per_byte:
        parts *= 2
    return parts, found["n"]


def shortened(keys: np.ndarray, parts: int, width: int) -> np.ndarray:
    """Hashes cut to what names the part and ``width`` bytes more."""
    return keys >> U64(64 - min(64, (parts.bit_length() - 1) + 8 * width))


@dataclass
class Cuts:
    """Where the keys of each part begin; of ``parts`` (or -1), the end.  Only the parts that have keys are held."""

    named: np.ndarray
    begins: np.ndarray
    parts: int

    def __getitem__(self, part: int) -> int:
        return int(self.begins[np.searchsorted(self.named, part % (self.parts + 1))])


def cuts(keys: np.ndarray, parts: int, width: int) -> Cuts:
    """Cuts of sorted (shortened) keys; takes time by the keys, not by the parts, of which a large corpus has far more."""
    part = (keys >> U64(min(8 * width, 65 - parts.bit_length()))).astype(np.int64)
    first = np.flatnonzero(_changes(part))
    return Cuts(part[first], np.append(first, len(keys)), parts)


def _changes(ranked: np.ndarray) -> np.ndarray:
    """Which values differ from the one before them."""
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    return new


def numbered(keys: np.ndarray, checks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of each distinct key (with its check, if there are any) one place, keys ascending; and the number of each one's key."""
    order = np.argsort(keys, kind="stable") if checks is None else np.lexsort((checks, keys))
    new = _changes(keys[order])
    if checks is not None:
        new |= _changes(checks[order])
    number = np.empty(len(keys), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def _packed(keys: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of sorted keys: the first, and the gaps between them in planes of bytes, the highest compressed."""
    low = keys if width == 8 else keys & U64((1 << 8 * width) - 1)
    gaps = np.diff(low)
    planes = (int(gaps.max(initial=0)).bit_length() + 7) // 8
    bytes_of = gaps.astype("<u8").view(np.uint8).reshape(-1, 8)
    head = bytes([planes]) + int(low[0]).to_bytes(8, "little") + len(keys).to_bytes(4, "little")
    if not planes:
        return head
    top = zstandard.ZstdCompressor(level=1).compress(bytes_of[:, planes - 1].tobytes())
    return b"".join([head, *[bytes_of[:, k].tobytes() for k in range(planes - 1)], top])


def _unpacked(data: bytes) -> np.ndarray:
    planes, n = data[0], int.from_bytes(data[9:13], "little")
    gaps = np.zeros((n, 8), dtype=np.uint8)
    gaps[0] = np.frombuffer(data, dtype=np.uint8, offset=1, count=8)
    for k in range(planes - 1):
        gaps[1:, k] = np.frombuffer(data, dtype=np.uint8, count=n - 1, offset=13 + k * (n - 1))
    if planes:
        top = zstandard.ZstdDecompressor().decompress(data[13 + (planes - 1) * (n - 1) :])
        gaps[1:, planes - 1] = np.frombuffer(top, dtype=np.uint8)
    return np.cumsum(gaps.view("<u8").ravel(), dtype=U64)


def _numbers(values: np.ndarray) -> bytes:
    """A byte that tells the width, and the numbers in the least that holds them all."""
    if len(values) and values.min() >= 0:
        for width in (1, 2, 4):
            if values.max() < 1 << (8 * width):
                return bytes([width]) + values.astype(f"<u{width}").tobytes()
    return b"\x08" + values.astype("<i8").tobytes()


def _as_numbers(data: bytes) -> np.ndarray:
    kind = "<i8" if data[0] == 8 else f"<u{data[0]}"
    return np.frombuffer(data, dtype=kind, offset=1).astype(np.int64)


def _places(places: np.ndarray, n: int) -> bytes:
    """Which of n: all, as a bit each, or as a list, whichever is short."""
    if len(places) == n:
        return b"A"
    if 32 * len(places) < n:
        return b"L" + places.astype("<u4").tobytes()
    there = np.zeros(n, bool)
    there[places] = True
    return b"B" + np.packbits(there).tobytes()


def _as_places(data: bytes, n: int) -> np.ndarray:
    if data[:1] == b"A":
        return np.arange(n)
    if data[:1] == b"L":
        return np.frombuffer(data, dtype="<u4", offset=1).astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, dtype=np.uint8, offset=1), count=n))


def sends(
    chunk: int, keys: np.ndarray, parts: int, width: int, places: np.ndarray, values: np.ndarray, checks: np.ndarray | None = None, first_part: int = 0
) -> Iterator[pa.RecordBatch]:
    """The rows that a chunk sends: sorted distinct keys, and values at some sorted places among them.

    ``checks`` are 64 bits more of each key, for keys that their width alone does not tell apart surely enough.
    """
    cut = cuts(keys, parts, width)
    at = cut.begins
    rows = {name: [] for name in _SENT.names}
    inside = np.searchsorted(places, at)
    for r, part in enumerate(cut.named.tolist()):
        mine = slice(at[r], at[r + 1])
        own = slice(inside[r], inside[r + 1])
        rows["part"].append(first_part + part)
        rows["chunk"].append(chunk)
        rows["keys"].append(_packed(keys[mine], width))
        rows["checks"].append(None if checks is None else checks[mine].astype("<u8").tobytes())
        rows["places"].append(_places(places[own] - at[r], int(at[r + 1] - at[r])))
        rows["values"].append(_numbers(values[own]))
    yield pa.RecordBatch.from_pydict(rows, schema=_SENT)


@dataclass
class Reduction:
    """How the values of a key from several chunks become one, and which chunks are told of it."""

    join: np.ufunc
    none: int  # the value of a key without one
    #: (own value of each entry, the key's joined value, whether several chunks have the key) -> entries to answer
    told: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
    #: joined values of a part's keys -> numbers that describe the part
    note: Callable[[np.ndarray], list[int]] = lambda totals: []


NOTE = -1  # stands for the chunk in the row that describes a part


class _Rows:
    """The entries of the rows of a part: own values, number of each entry's key, where each row begins."""

    def __init__(self, table: pa.Table, none: int):
        data = [table.column(name).to_pylist() for name in ("keys", "places", "values", "checks")]
        self.keys = [_unpacked(k) for k in data[0]]
        self.begin = np.concatenate(([0], np.cumsum([len(k) for k in self.keys]))).astype(np.int64)
        self.own = np.full(self.begin[-1], none, dtype=np.int64)
        for p, v, k, b in zip(data[1], data[2], self.keys, self.begin, strict=False):
            self.own[_as_places(p, len(k)) + b] = _as_numbers(v)
        self.all = np.concatenate(self.keys)
        self.checks = None if data[3][0] is None else np.concatenate([np.frombuffer(c, dtype="<u8") for c in data[3]])
        self.first, self.number = numbered(self.all, self.checks)

    def joined(self, how: Reduction) -> np.ndarray:
        out = np.full(len(self.first), how.none, dtype=np.int64)
        how.join.at(out, self.number, self.own)
        return out

    def answers(self, table: pa.Table, told: np.ndarray, values: np.ndarray) -> pa.Table:
        """The values of the entries that are told, a row for each row that has any."""
        back = np.flatnonzero(told)
        at = np.searchsorted(back, self.begin)
        own = [slice(at[r], at[r + 1]) for r in range(len(self.keys))]
        out = {
            "chunk": table.column("chunk").to_pylist(),
            "part": table.column("part").to_pylist(),
            "places": [_places(back[o] - b, len(k)) for o, b, k in zip(own, self.begin, self.keys, strict=False)],
            "values": [_numbers(values[back[o]]) for o in own],
        }
        return pa.Table.from_pydict(out, schema=_ANSWERED).filter(pa.array([o.stop > o.start for o in own]))


def _noted(part: int, note: list[int]) -> pa.Table:
    row = {"chunk": [NOTE], "part": [part], "places": [b""], "values": [_numbers(np.array(note, dtype=np.int64))]}
    return pa.Table.from_pydict(row, schema=_ANSWERED)


_MERGED = "part int, salt int, keys binary, checks binary, places binary, values binary, several binary"
_merged = pa.schema([("part", pa.int32()), ("salt", pa.int32()), *[(name, pa.binary()) for name in ("keys", "checks", "places", "values", "several")]])
_WHOLE = "part int, salt int, totals binary, several binary"
_whole = pa.schema([("part", pa.int32()), ("salt", pa.int32()), ("totals", pa.binary()), ("several", pa.binary())])


def exchanged(sent: DataFrame, how: Reduction, chunks: int) -> DataFrame:
    """Reduces each part; a row (chunk, part, places, values) goes back for each of the ``chunks`` that is told something.

    One row more for each part, of chunk NOTE, has the numbers that describe it.
    """

    def run(table: pa.Table) -> pa.Table:
        rows = _Rows(table, how.none)
        total, several = rows.joined(how), np.bincount(rows.number) > 1
        told = how.told(rows.own, total[rows.number], several[rows.number])
        note = _noted(table.column("part")[0].as_py(), how.note(total))
        return pa.concat_tables([rows.answers(table, told, total[rows.number]), note])

    salts = -(-chunks // ROWS_PER_TASK)
    if salts <= 1:
        return sent.groupBy("part").applyInArrow(run, ANSWERED)

    def merge(table: pa.Table) -> pa.Table:
        rows = _Rows(table, how.none)
        total, several = rows.joined(how), np.bincount(rows.number) > 1
        some = np.flatnonzero(total != how.none)
        row = {
            "part": [table.column("part")[0].as_py()], "salt": [table.column("salt")[0].as_py()],
            "keys": [_packed(rows.all[rows.first], 8)],
            "checks": [None if rows.checks is None else rows.checks[rows.first].tobytes()],
            "places": [_places(some, len(total))], "values": [_numbers(total[some])], "several": [np.packbits(several).tobytes()],
        }
        return pa.Table.from_pydict(row, schema=_merged)

    def whole(table: pa.Table) -> pa.Table:
        rows = _Rows(table, how.none)
        total, several = rows.joined(how), np.bincount(rows.number) > 1
        for k, bits in enumerate(table.column("several").to_pylist()):
            mine = slice(rows.begin[k], rows.begin[k + 1])
            there = np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=mine.stop - mine.start).astype(bool)
            several[rows.number[mine][there]] = True
        own = [rows.number[a:b] for a, b in zip(rows.begin[:-1], rows.begin[1:], strict=True)]
        out = {
            "part": table.column("part").to_pylist(), "salt": table.column("salt").to_pylist(),
            "totals": [_numbers(total[n]) for n in own], "several": [np.packbits(several[n]).tobytes() for n in own],
        }
        noted = {"part": [out["part"][0]], "salt": [NOTE], "totals": [_numbers(np.array(how.note(total), dtype=np.int64))], "several": [b""]}
        return pa.concat_tables([pa.Table.from_pydict(out, schema=_whole), pa.Table.from_pydict(noted, schema=_whole)])

    def tell(table: pa.Table, reduced: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _noted(reduced.column("part")[0].as_py(), _as_numbers(reduced.column("totals")[0].as_py()).tolist())
        rows = _Rows(table, how.none)
        total = _as_numbers(reduced.column("totals")[0].as_py())
        several = np.unpackbits(np.frombuffer(reduced.column("several")[0].as_py(), dtype=np.uint8), count=len(total)).astype(bool)
        return rows.answers(table, how.told(rows.own, total[rows.number], several[rows.number]), total[rows.number])

    dealt = stored(sent.withColumn("salt", F.pmod(F.xxhash64("chunk"), F.lit(salts)).cast("int")), "exchange-sent")
    keyed = dealt.groupBy("part", "salt")
    merged = keyed.applyInArrow(merge, _MERGED)
    reduced = merged.groupBy("part").applyInArrow(whole, _WHOLE)
    return keyed.cogroup(reduced.groupBy("part", "salt")).applyInArrow(tell, ANSWERED)


def notes(answered: DataFrame, n: int) -> list[int]:
    """The sums over all parts of the n numbers that describe a part."""

    def run(batches):
        for batch in batches:
            values = [_as_numbers(v.as_py()) for v in batch.column("values")]
            total = np.sum(values, axis=0) if values else np.zeros(n, dtype=np.int64)
            yield pa.RecordBatch.from_pydict({f"n{k}": [int(total[k])] for k in range(n)})

    described = answered.where(F.col("chunk") == NOTE).select("values").mapInArrow(run, ", ".join(f"n{k} long" for k in range(n)))
    return [int(x or 0) for x in described.agg(*[F.sum(f"n{k}") for k in range(n)]).first()]


def by_chunk(answered: DataFrame, name: str) -> DataFrame:
    """One row a chunk: its answers, as many as it has keys at most."""
    return answered.where(F.col("chunk") != NOTE).groupBy("chunk").agg(F.collect_list(F.struct("part", "places", "values")).alias(name))


def received(answers: list[dict] | None, at: Cuts) -> tuple[np.ndarray, np.ndarray]:
    """Places in the chunk's whole list and their values; ``at`` from ``cuts``."""
    if not answers:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    places = [_as_places(a["places"], at[a["part"] + 1] - at[a["part"]]) + at[a["part"]] for a in answers]
    return np.concatenate(places), np.concatenate([_as_numbers(a["values"]) for a in answers])
