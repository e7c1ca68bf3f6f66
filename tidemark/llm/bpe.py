"""Byte-level BPE by backtracking over Aho-Corasick matches.

Bytes are mapped to the characters of equal number (Latin-1), so that an
automaton over strings finds every vocabulary token inside a piece of text in
one pass.  Encoding walks left to right, taking the longest match whose pair
with the token before it is compatible, and steps back where none is.  A pair
is compatible if merging its joined bytes by rank gives just that pair; answers
are memoised.  A sequence whose adjacent pairs are all compatible is the one
that rank-ordered merging produces, so results are exact.
"""

from __future__ import annotations

import base64
import hashlib

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidemark.llm.common import carrying, free_name, named


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank from a file of ``base64 rank`` lines."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Encoder:
    """Encodes and decodes texts; ``cache`` bounds the pieces and the pairs that are remembered."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache: int = 400_000):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.pieces = regex.compile(pattern).findall
        self.cache = cache
        self.known: dict[str, str] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.split: dict[int, tuple[int, int]] = {}
        self.printed = {str(rank): token for token, rank in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()

    def merged(self, data: bytes, below: int = 1 << 62) -> list[int]:
        """Rank-ordered merging by ranks under ``below``; the definition, used for single tokens only."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranked = [(self.ranks.get(parts[i] + parts[i + 1], 1 << 62), i) for i in range(len(parts) - 1)]
            rank, i = min(ranked)
            if rank >= below:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, rank: int) -> tuple[int, int]:
        """The pair whose merge makes a token; the token twice if none does (single bytes)."""
        found = self.split.get(rank)
        if found is None:
            parts = self.merged(self.tokens[rank], rank)
            found = self.split[rank] = (parts[0], parts[1]) if len(parts) == 2 else (rank, rank)
        return found

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the joined bytes of two tokens gives these two again.

        It does unless some merge across their border comes before the merges
        that complete them: undo those from the latest on, and look.
        """
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) >= self.cache:
                self.pairs.clear()
            found = self.pairs[left, right] = self._stays_apart(left, right)
        return found

    def _stays_apart(self, left: int, right: int) -> bool:
        tokens, ranks = self.tokens, self.ranks
        limit = 1 << 62
        while True:
            across = ranks.get(tokens[left] + tokens[right])
            if across is not None and across < limit:
                return False
            inner_left, inner_right = self.halves(left)[1], self.halves(right)[0]
            if inner_left == left and inner_right == right:
                return True
            if inner_right == right or (inner_left != left and left > right):
                left, limit = inner_left, left
            else:
                right, limit = inner_right, right + 1

    def encode_piece(self, data: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        if data in self.ranks:
            return [self.ranks[data]]
        matches: list[list[tuple[int, int]]] = [[] for _ in data]
        for end, (length, rank) in self.automaton.iter(data.decode("latin-1")):
            matches[end - length + 1].append((length, rank))  # shorter ones of a start come first
        dead = bytearray(len(data) + 1)  # ends from which no way on was found
        taken: list[tuple[int, int, int]] = []  # start, index into matches[start], rank
        at, choice = 0, len(matches[0]) - 1
        while at < len(data):
            here = matches[at]
            while choice >= 0:
                length, rank = here[choice]
                if not dead[at + length] and (not taken or self.compatible(taken[-1][2], rank)):
                    break
                choice -= 1
            if choice >= 0:
                taken.append((at, choice, rank))
                at += length
                choice = len(matches[at]) - 1 if at < len(data) else -1
            else:
                dead[at] = 1
                at, choice, _ = taken.pop()
                choice -= 1
        return [rank for _, _, rank in taken]

    def encode_text(self, text: str) -> str:
        """Decimal ids joined by one space."""
        known, out = self.known, []
        for piece in self.pieces(text):
            ids = known.get(piece)
            if ids is None:
                ids = " ".join(map(str, self.encode_piece(piece.encode())))
                if len(piece) <= 64:
                    if len(known) >= self.cache:
                        known.clear()
                    known[piece] = ids
            out.append(ids)
        return " ".join(out)

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.encode_text(text).split()]

    def decode_text(self, ids: str) -> bytes:
        """The bytes of decimal ids joined by one space."""
        return b"".join(map(self.printed.__getitem__, ids.split()))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(self.tokens[i] for i in ids)


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One per Python worker, vocabulary and pattern."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(read_ranks(path), pattern)
    return _encoders[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` (array<int>) for every row; the vocabulary is a file that every executor has at ``path``.

    Null and empty texts have no ids.  Each row is encoded by itself, so
    repeated rows and null ids come out as they are; other columns are ignored.
    """

    def run(batches):
        bpe = encoder(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                ids = [bpe.encode(text or "") for text in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    given = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return given.mapInArrow(run, f"doc_id {given.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, bytes`` from ``doc_id, ids``; null ids give no bytes."""

    def run(batches):
        bpe = encoder(path, pattern)
        for batch in batches:
            data = [bpe.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(data, pa.binary())], names=["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, bytes binary")


def round_trip_digests(
    docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for every row, and the columns named in ``keep``.

    Encodes and decodes in one pass, so that ids, several times the text's
    size, are not stored.  Rows are treated as ``encode`` says.
    """
    if "doc_id" in keep:
        raise ValueError("keep may not name doc_id, which is there anyway")
    text = free_name("text", ("doc_id", *keep))
    given = docs.select(named(docs, id_col).alias("doc_id"), named(docs, text_col).alias(text), *[named(docs, c).alias(c) for c in keep])

    def run(batches):
        bpe = encoder(path, pattern)
        for batch in batches:
            columns = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for text in batch.column("text"):
                ids = bpe.encode_text(text.as_py() or "")
                columns["n_tokens"].append(ids.count(" ") + bool(ids))
                columns["ids_sha256"].append(hashlib.sha256(ids.encode()).hexdigest())
                columns["decoded_sha256"].append(hashlib.sha256(bpe.decode_text(ids)).hexdigest())
            added = [pa.array(columns["n_tokens"], pa.int64()), pa.array(columns["ids_sha256"], pa.string()), pa.array(columns["decoded_sha256"], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("kept"), *added], names=["kept", *columns])

    added = StructType([StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())])
    return carrying(given, text, ("doc_id", *keep), run, added).select("doc_id", *added.names, *[F.col(f"`{c}`") for c in keep])
