"""Removal of repeated passages by fixed-block anchors.

Every document is cut into non-overlapping reference blocks of ``window // 2``
words; of any ``window`` words in a row at least one block is whole.  The
blocks are indexed by hash, and every rolling window of that length of every
document probes the index.  A hit is extended over the windows around it: those
that occur in a document of smaller id, compared on 128 bits of two independent
hashes of all their words, make up the maximal exact repeats, whose words are removed.

Index, probes and window hashes travel as packed keys (see ``exchange``).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm import exchange
from tidemark.llm.common import stored
from tidemark.llm.kernel import NULL_ID, pack, rows_of, sha256_hex, span_hashes, unpack, window_hashes, word_spans

_NONE = np.iinfo(np.int64).max
PROBE_WIDTH = 4  # bytes of a probe's hash beyond its part: a chance hit only costs a comparison


@dataclass
class Words:
    """The words of a chunk: hashes, each document's first word (and the end), owner and id of each word."""

    row: dict
    window: int

    def __post_init__(self):
        self.blob, self.begins, self.ids = unpack(self.row)
        self.starts, self.ends = word_spans(self.blob)
        self.hashes = span_hashes(self.blob, self.starts, self.ends)
        self.bound = np.searchsorted(self.starts, self.begins)
        self.owner = np.repeat(np.arange(len(self.ids)), np.diff(self.bound))
        self.id = self.ids[self.owner]

    def anchors(self, parts: int):
        """Sorted distinct block-length hashes; each probe's position and its place among them; which are blocks."""
        k = self.window // 2
        hashes = exchange.shortened(window_hashes(self.hashes, k), parts, PROBE_WIDTH)
        at = np.arange(len(hashes))
        long = np.diff(self.bound) >= self.window
        at = at[(self.owner[at] == self.owner[at + k - 1]) & long[self.owner[at]]] if len(at) else at
        keys, place = np.unique(hashes[at], return_inverse=True)
        return keys, at, place, (at - self.bound[self.owner[at]]) % k == 0

    def least(self, n: int, place: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The smallest id at each of n places."""
        out = np.full(n, _NONE)
        np.minimum.at(out, place, self.id[at])
        return out

    def windows(self, parts: int, hits: list[dict] | None):
        """Sorted distinct hashes of the windows to compare and their checks; starts of these windows and their places among them."""
        keys, at, place, block = self.anchors(parts)
        bounds = self.least(len(keys), place[block], at[block])
        first = self.least(len(keys), place, at)
        last = np.full(len(keys), NULL_ID)
        np.maximum.at(last, place, self.id[at])
        bounds[first == last] = _NONE  # within this chunk, in one document only
        places, values = exchange.received(hits, exchange.cuts(keys, parts, PROBE_WIDTH))
        np.minimum.at(bounds, places, values)
        at = at[self.id[at] >= bounds[place]]
        low = np.maximum(at - (self.window - self.window // 2), self.bound[self.owner[at]])
        high = np.minimum(at, self.bound[self.owner[at] + 1] - self.window) + 1
        change = np.zeros(len(self.hashes) + 1, dtype=np.int64)
        np.add.at(change, low, 1)
        np.add.at(change, high, -1)
        starts = np.flatnonzero(np.cumsum(change) > 0)
        hashes = window_hashes(self.hashes, self.window)[starts]
        checks = window_hashes(span_hashes(self.blob, self.starts, self.ends, 1), self.window)[starts]
        first, place = exchange.numbered(hashes, checks)
        return hashes[first], checks[first], starts, place


#: To every chunk that has a block's hash, if several chunks do: the smallest id that has it as a block.
ANCHORS = exchange.Reduction(np.minimum, _NONE, lambda own, least, several: several & (least != _NONE))
#: To every chunk that has a window: the smallest id that has it, where another chunk's is smaller.
WINDOWS = exchange.Reduction(np.minimum, _NONE, lambda own, least, several: least < own)


def substring_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_removed, kept_sha256, kept_text``.

    A word goes if a run of ``window`` words of its document covers it that
    also starts in a document of smaller id.  Runs are judged on the input.
    Words are runs of anything but ASCII white space; kept words are joined by
    one space.  Null and empty texts have no words; texts shorter than the
    window lose nothing.  A null id counts as smaller than every other; rows of
    equal id do not remove each other's words.  Other columns are ignored.
    """
    chunks = stored(pack(docs, id_col, text_col), "substring-chunks")
    parts, n_chunks = exchange.parts_for(chunks)

    def anchors(batches):
        for row in rows_of(batches):
            words = Words(row, window)
            keys, at, place, block = words.anchors(parts)
            if len(keys):
                least = words.least(len(keys), place[block], at[block])
                places = np.flatnonzero(least != _NONE)
                yield from exchange.sends(row["chunk"], keys, parts, PROBE_WIDTH, places, least[places])

    sent = chunks.mapInArrow(anchors, exchange.SENT)
    hits = stored(exchange.by_chunk(exchange.exchanged(sent, ANCHORS, n_chunks), "hits"), "substring-hits")
    probed = chunks.join(hits, "chunk", "left")

    def compare(batches):
        for row in rows_of(batches):
            words = Words(row, window)
            keys, checks, starts, place = words.windows(parts, row["hits"])
            if len(keys):
                least = words.least(len(keys), place, starts)
                yield from exchange.sends(row["chunk"], keys, parts, 8, np.arange(len(keys)), least, checks)

    compared = exchange.exchanged(probed.mapInArrow(compare, exchange.SENT), WINDOWS, n_chunks)
    repeats = stored(exchange.by_chunk(compared, "repeats"), "substring-repeats")

    def remove(batches):
        for row in rows_of(batches):
            words = Words(row, window)
            keys, _, starts, place = words.windows(parts, row["hits"])
            least = words.least(len(keys), place, starts)
            places, values = exchange.received(row["repeats"], exchange.cuts(keys, parts, 8))
            np.minimum.at(least, places, values)
            starts = starts[words.id[starts] > least[place]]
            change = np.zeros(len(words.hashes) + 1, dtype=np.int64)
            np.add.at(change, starts, 1)
            np.add.at(change, starts + window, -1)
            gone = np.cumsum(change)[:-1] > 0
            yield _kept(words, gone)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    return probed.join(repeats, "chunk", "left").mapInArrow(remove, schema)


def _kept(words: Words, gone: np.ndarray) -> pa.RecordBatch:
    """Result rows of a chunk: kept words and the separator after each, which becomes a space."""
    starts, ends = words.starts[~gone], words.ends[~gone]
    change = np.zeros(len(words.blob) + 1, dtype=np.int8)
    change[starts] += 1
    change[ends + 1] -= 1  # a word's next may start right there: += keeps both
    stay = np.cumsum(change[:-1], dtype=np.int8) > 0
    text = words.blob.copy()
    text[ends] = 0x20
    text, bound = text[stay].tobytes(), np.concatenate(([0], np.cumsum(stay)))[words.begins]
    kept = [text[a : max(a, b - 1)] for a, b in zip(bound[:-1], bound[1:], strict=True)]
    n = len(words.ids)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(words.ids, mask=words.ids == NULL_ID),
            pa.array(np.diff(words.bound).astype(np.int64)),
            pa.array(np.bincount(words.owner[gone], minlength=n).astype(np.int64)),
            pa.array([sha256_hex(k) for k in kept]),
            pa.array(kept, pa.binary()).cast(pa.string()),
        ],
        names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
    )


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), x AS (
  SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS s FROM w WHERE len(ws) >= 50
), k AS (
  SELECT doc_id, s, array_to_string(ws[s:s + 49], ' ') AS words FROM x
), f AS (
  SELECT k.doc_id, k.s FROM k JOIN (SELECT words, min(doc_id) AS first_id FROM k GROUP BY words) m ON k.words = m.words
  WHERE k.doc_id > m.first_id
), p AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w WHERE len(ws) > 0
), c AS (
  SELECT p.doc_id, p.word, p.i, max(f.s) OVER (PARTITION BY p.doc_id ORDER BY p.i) AS last_s
  FROM p LEFT JOIN f ON p.doc_id = f.doc_id AND p.i = f.s
), d AS (
  SELECT doc_id, word, i, last_s IS NOT NULL AND last_s >= i - 49 AS gone FROM c
), a AS (
  SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept
  FROM d GROUP BY doc_id
)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, coalesce(a.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(a.kept, '')) AS kept_sha256
FROM w LEFT JOIN a ON w.doc_id = a.doc_id
"""
