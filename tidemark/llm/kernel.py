"""Vectorised word scanning over UTF-8 bytes, and chunks of documents packed for shuffling.

A *blob* is a byte array holding texts one after the other, each followed by a
newline, so that no word crosses a text's end.  All functions work on whole
blobs with numpy; none loops over words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

U64 = np.uint64
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LONG = 512  # spans of more bytes are digested one by one
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit over all others."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(30))
        x = x * U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(27)
        x *= U64(0x94D049BB133111EB)
        x ^= x >> U64(31)
    return x


#: Bytes that are neither ASCII letters nor digits nor part of a longer character.
NOT_ALNUM = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def word_spans(blob: np.ndarray, separator: np.ndarray = _SEPARATOR) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a blob, which must end with a separator."""
    word = ~separator[blob]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if len(word) and word[0]:
        edge = np.concatenate(([0], edge))
    return edge[0::2], edge[1::2]


def span_hashes(blob: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each span's bytes; another ``salt`` gives hashes that are independent of these.

    Length and bytes, eight at a time, go through a bijection each, so spans of
    up to eight bytes and equal length never collide.  Long spans are digested.
    """
    size = ends - starts
    out = mixed(size.astype(U64) + U64(0x9E3779B97F4A7C15 * (salt + 1) % 2**64))
    if len(blob) < 8:
        blob = np.concatenate((blob, np.zeros(8, np.uint8)))
    lanes = np.ndarray(len(blob) - 7, "<u8", np.ascontiguousarray(blob).data, strides=(1,))

    def lane(at, left):
        near = np.minimum(at, len(lanes) - 1)
        return (lanes[near] >> (8 * (at - near)).astype(U64)) & _MASK[np.minimum(left, 8)]

    some = np.flatnonzero((size > 0) & (size <= _LONG))
    some = slice(None) if len(some) == len(size) else some
    at, left = starts[some], size[some]
    state = mixed(out[some] ^ lane(at, left))
    while True:
        more = np.flatnonzero(left > 8)
        if not len(more):
            break
        out[some] = state
        some = more if isinstance(some, slice) else some[more]
        at, left = at[more] + 8, left[more] - 8
        state = mixed(state[more] ^ lane(at, left))
    out[some] = state
    for k in np.flatnonzero(size > _LONG).tolist():
        digest = hashlib.blake2b(blob[starts[k] : ends[k]].data, digest_size=8, salt=salt.to_bytes(8, "little"))
        out[k] = int.from_bytes(digest.digest(), "little")
    return out


def joined(left: np.ndarray, right: np.ndarray, gap: int) -> np.ndarray:
    """Hashes of runs made of the run at each place and the one ``gap`` places on."""
    n = min(len(left), len(right) - gap)
    return mixed(left[:n] * U64(0x9E3779B97F4A7C15) + right[gap : gap + n])


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k word hashes; empty if there are fewer.

    Runs of one, two, four .. words are joined, each time through a bijection.
    """
    if len(words) < k:
        return np.empty(0, dtype=U64)
    out, done, run, size = None, 0, words, 1
    while size <= k:
        if k & size:
            out = run if out is None else joined(out, run, done)
            done += size
        size *= 2
        if size <= k:
            run = joined(run, run, size // 2)
    return out


def lowered(blob: np.ndarray) -> np.ndarray:
    """A-Z as a-z, all other bytes as they are."""
    return _LOWER[blob]


def sha256_hex(data) -> str:
    return hashlib.sha256(data).hexdigest()


def text_bytes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its texts; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data or b"", dtype=np.uint8), offsets


def blob_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A blob of the texts, and where each of them starts (and, last, the blob's length)."""
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    begins = np.concatenate(([0], np.cumsum(lengths + 1)))
    blob = np.full(begins[-1], 10, dtype=np.uint8)
    inside = np.ones(begins[-1], bool)
    inside[begins[1:] - 1] = False
    blob[inside] = data[offsets[0] : offsets[n]]
    return blob, begins


def pieces(batch: pa.RecordBatch, column: str, target: int = 1 << 19) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Rows of a batch, blob and starts, about ``target`` bytes (at least a text) at a time."""
    data, offsets = text_bytes(batch.column(column))
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + target, "right")) - 1)
        yield slice(at, to), *blob_of(data, offsets[at : to + 1])
        at = to


CHUNK_SCHEMA = "chunk long, size long, marks binary, begins binary, blob binary"


def pack(docs: DataFrame, id_col: str, text_col: str, mark=None, target: int = 384 << 10) -> DataFrame:
    """Documents packed into rows of about ``target`` bytes of text, a whole text at least.

    ``marks`` has the ids, ``size`` the bytes; ``begins`` and ``blob`` the texts, compressed.  With
    ``mark`` (a boolean column) a chunk has rows of one value only, in the added
    column ``mark``.  Null ids are held as the smallest long.
    """
    columns = [docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")]
    given = docs.select(*columns, mark.alias("mark")) if mark is not None else docs.select(*columns)
    schema = CHUNK_SCHEMA + (", mark boolean" if mark is not None else "")

    marked = mark is not None

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=3)
        serial = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        for batch in batches:
            parts = [(batch, None)]
            if marked:
                on = batch.column("mark").fill_null(False)
                parts = [(batch.filter(on), True), (batch.filter(pc.invert(on)), False)]
            for part, value in parts:
                for rows, blob, begins in pieces(part, "text", target):
                    ids = part.column("id")[rows].fill_null(NULL_ID).to_numpy(zero_copy_only=False)
                    row = {
                        "chunk": [serial],
                        "size": [len(blob)],
                        "marks": [ids.astype("<i8").tobytes()],
                        "begins": [begins.astype("<i8").tobytes()],
                        "blob": [squeeze.compress(blob.tobytes())],
                    }
                    if marked:
                        row["mark"] = [value]
                    serial += 1
                    yield pa.RecordBatch.from_pydict(row, schema=_arrow_chunk(marked))

    return given.mapInArrow(run, schema)


#: Stands for a null id in a chunk; ids of this value itself come back as null.
NULL_ID = -(2**63)


def _arrow_chunk(marked: bool) -> pa.Schema:
    fields = [("chunk", pa.int64()), ("size", pa.int64()), ("marks", pa.binary()), ("begins", pa.binary()), ("blob", pa.binary())]
    return pa.schema(fields + [("mark", pa.bool_())] * marked)


def unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blob, starts and ids of a chunk row."""
    blob = zstandard.ZstdDecompressor().decompress(row["blob"])
    ids, begins = (np.frombuffer(row[name], dtype="<i8") for name in ("marks", "begins"))
    return np.frombuffer(blob, dtype=np.uint8), begins, ids


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of large-valued batches, one at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(name)[i].as_py() for name in batch.schema.names}
