"""Codes of vector parts by Lloyd's rounds with Hamerly's bounds.

Vectors are cut into equal parts; each part position has a codebook.  A round
assigns every part to the nearest entry and moves entries to their parts' means.
With its code a part keeps two bounds in the stored table: one above its
distance to its entry, one below that to the second nearest.  When entries have
moved, the bounds move with them, and only where they (or the gap between
entries) do not strictly tell that the entry is still the nearest one, all
entries are searched, in integers.  So ties still go to the lower index.

A task sums the parts of each entry before they are shuffled; what comes to the
driver is a codebook, whose size does not depend on the rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored
from tidemark.llm.vectors import integer_rows, matrix, packed, unpacked

#: Integer distances whose components are in memory at once.
STEP = 1 << 22
_TABLE = "vec_id long, label long, vector binary, code binary, upper binary, lower binary"
_UP, _DOWN = np.float32(np.inf), np.float32(-np.inf)


def _above(x: np.ndarray) -> np.ndarray:
    """Single-precision values that are surely not below doubles with a rounding error."""
    return np.nextafter(np.nextafter(x.astype(np.float32), _UP), _UP)


def _below(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(np.nextafter(x.astype(np.float32), _DOWN), _DOWN), 0)


def full_scan(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry of each part (n, size), its squared distance and the second nearest's (infinite with one entry)."""
    n, entries = len(parts), len(book)
    code, near, second = np.empty(n, np.int64), np.empty(n, np.int64), np.full(n, np.inf)
    step = max(1, STEP // max(1, book.size))
    for k in range(0, n, step):
        some = parts[k : k + step]
        distance = np.zeros((len(some), entries), np.int64)
        for d in range(book.shape[1]):
            distance += (some[:, d, None] - book[None, :, d]) ** 2
        code[k : k + step] = distance.argmin(1)  # the first of equal ones
        if entries > 1:
            two = np.partition(distance, 1, axis=1)
            near[k : k + step], second[k : k + step] = two[:, 0], two[:, 1]
        else:
            near[k : k + step] = distance[:, 0]
    return code, near, second


def moved_bounds(old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For one codebook: how far each entry moved, how far any other did, and half the gap to each entry's nearest other."""
    step = np.sqrt(((old - new) ** 2).sum(1))
    order = np.argsort(-step)
    others = np.full(len(step), step[order[0]])
    others[order[0]] = step[order[1]] if len(step) > 1 else 0
    gaps = np.sqrt(((new[:, None, :] - new[None, :, :]) ** 2).sum(2)).astype(float)
    np.fill_diagonal(gaps, np.inf)
    return step, others, gaps.min(1) / 2


def reassign(parts: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, old: np.ndarray, new: np.ndarray):
    """Codes and bounds of one position's parts after its codebook moved, and how many parts were searched in full."""
    step, others, gap = moved_bounds(old, new)
    upper, lower, code = _above(upper.astype(float) + step[code]), _below(lower.astype(float) - others[code]), code.copy()
    reach = np.maximum(lower, _below(gap)[code])
    doubt = np.flatnonzero(~(upper < reach))
    own = ((parts[doubt] - new[code[doubt]]) ** 2).sum(1)  # the exact distance may settle it
    upper[doubt] = _above(np.sqrt(own))
    doubt = doubt[~(upper[doubt] < reach[doubt])]
    code[doubt], near, second = full_scan(parts[doubt], new)
    upper[doubt], lower[doubt] = _above(np.sqrt(near)), _below(np.sqrt(second))
    return code, upper, lower, len(doubt)


class _Coder:
    """What tasks need: the parts' number and size, the codebooks now and before."""

    def __init__(self, parts: int, width: int, books: np.ndarray, before: np.ndarray | None = None):
        self.parts, self.width, self.books, self.before = parts, width, books, before

    def cut(self, vectors: np.ndarray) -> np.ndarray:
        return vectors.reshape(len(vectors), self.parts, self.width // self.parts)

    def first(self, batches):
        for batch in batches:
            v = matrix(batch.column("vector"), self.width)
            cut, code = self.cut(v), np.empty((len(v), self.parts), np.uint8)
            upper, lower = np.empty(code.shape, np.float32), np.empty(code.shape, np.float32)
            for p in range(self.parts):
                code[:, p], near, second = full_scan(cut[:, p], self.books[p])
                upper[:, p], lower[:, p] = _above(np.sqrt(near)), _below(np.sqrt(second))
            yield self._batch(batch, v, code, upper, lower)

    def again(self, batches):
        for batch in batches:
            v, code, upper, lower = self._read(batch)
            cut = self.cut(v)
            for p in range(self.parts if len(v) else 0):
                code[:, p], upper[:, p], lower[:, p], _ = reassign(cut[:, p], code[:, p], upper[:, p], lower[:, p], self.before[p], self.books[p])
            yield self._batch(batch, v, code, upper, lower)

    def final(self, batches):
        """Codes once more, as hex digits, and the exact distances."""
        for batch in self.again(batches):
            v, code, _, _ = self._read(batch)
            near = self.books[np.arange(self.parts), code] if len(v) else np.empty((0, self.parts, 0), np.int64)
            error = ((self.cut(v) - near) ** 2).sum((1, 2)) if len(v) else np.empty(0, np.int64)
            text = pa.array([row.tobytes().hex() for row in code], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], text, pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    def sums(self, batches):
        """Components' sums and the number of each entry's parts in a task."""
        size = self.width // self.parts
        total = np.zeros((self.parts, self.books.shape[1], size + 1), np.int64)
        for batch in batches:
            v, code, _, _ = self._read(batch)
            cut = self.cut(v)
            for p in range(self.parts if len(v) else 0):
                total[p, :, size] += np.bincount(code[:, p], minlength=total.shape[1])
                for d in range(size):  # exact: |sum| of a batch is far below 2^53
                    total[p, :, d] += np.bincount(code[:, p], cut[:, p, d], minlength=total.shape[1]).astype(np.int64)
        p, e = np.nonzero(total[:, :, size])
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), *[pa.array(total[p, e, d]) for d in range(size + 1)]], names=["p", "e", *[f"s{d}" for d in range(size)], "n"])

    def _read(self, batch):
        columns = [unpacked(batch.column(c), t) for c, t in (("vector", np.int32), ("code", np.uint8), ("upper", np.float32), ("lower", np.float32))]
        if not batch.num_rows:
            columns = [np.empty((0, w), c.dtype) for c, w in zip(columns, (self.width, *[self.parts] * 3), strict=True)]
        return columns[0].astype(np.int64), *[c.copy() for c in columns[1:]]

    def _batch(self, batch, v, code, upper, lower):
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:2], packed(v.astype(np.int32)), packed(code), packed(upper), packed(lower)],
            names=["vec_id", "label", "vector", "code", "upper", "lower"],
        )


def moved(table: DataFrame, coder: _Coder) -> np.ndarray:
    """The codebooks after a round: entries at the rounded-down means of their parts, unused ones as they were."""
    size = coder.width // coder.parts
    sums = [f"s{d}" for d in range(size)]
    found = table.mapInArrow(coder.sums, f"p int, e int, {', '.join(f'{s} long' for s in sums)}, n long").groupBy("p", "e")
    books = coder.books.copy()
    for row in found.agg(*[F.sum(s).alias(s) for s in sums], F.sum("n").alias("n")).collect():  # at most parts * entries rows
        books[row["p"], row["e"]] = [row[s] // row["n"] for s in sums]
    return books


def vector_codes(
    df: DataFrame, *, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", parts: int = 16,
    entries: int = 64, rounds: int = 2,
) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` for each row with a usable vector.

    Components become floor(256 * x).  The codebooks start as the parts of the
    rows with the ``entries`` smallest ids (of repeated ids the smaller vectors
    first, null ids last; fewer rows give fewer entries).  ``rounds`` rounds
    move them; then parts are assigned for the last time.  ``code`` has two hex
    digits a part, so up to 256 entries are allowed; ``error`` is the sum of
    squared distances, ``label_error`` its sum over the rows of equal label,
    null labels together; the digest is that of all final components.

    Rows with a null vector or a null or non-finite component are left out;
    repeated rows are rows; null ids and labels stay; an empty table gives no
    rows.  Vectors of different lengths, of a length that is no multiple of
    ``parts``, or with components beyond some 10^4 raise ValueError; ids and
    labels that are not whole numbers raise TypeError.  Further columns are ignored.
    """
    if not 0 < entries <= 256:
        raise ValueError("entries must be from 1 to 256")
    rows = integer_rows(df, id_col, label_col, vector_col)
    seeds = rows.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).select("vector").collect()
    vectors = matrix(pa.array([row[0] for row in seeds], pa.list_(pa.int64())))
    width = vectors.shape[1]
    if width % parts or seeds and not width:
        raise ValueError(f"{width} components cannot be cut into {parts} equal parts")
    books = vectors.reshape(len(vectors), parts, width // parts).transpose(1, 0, 2).copy()
    coder = _Coder(parts, width, books)
    table = rows.select("vec_id", "label", "vector").mapInArrow(coder.first, _TABLE) if seeds else df.sparkSession.createDataFrame([], _TABLE)
    for k in range(rounds if seeds else 0):
        table = stored(table, "codes")
        before, coder = coder, _Coder(parts, width, moved(table, coder), coder.books)
        table = table.mapInArrow(coder.again, _TABLE) if k < rounds - 1 else table
    if rounds == 0 or not seeds:
        coder = _Coder(parts, width, books, books)
    final = stored(table.mapInArrow(coder.final, "vec_id long, label long, code string, error long"), "codes")
    digest = hashlib.sha256(",".join(map(str, coder.books.ravel())).encode()).hexdigest()
    key = F.struct(F.col("label").isNull().alias("missing"), F.coalesce("label", F.lit(0)).alias("label"))
    sums = final.groupBy(key.alias("key")).agg(F.sum("error").alias("label_error"))
    return final.withColumn("key", key).join(sums, "key").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql() -> str:
    assigned = """
assigned{k} AS MATERIALIZED (
  SELECT place, part, arg_min(entry, (distance, entry)) AS entry, min(distance) AS distance FROM (
    SELECT p.place, p.part, b.entry, list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS distance
    FROM parts p JOIN book{k} b USING (part)) GROUP BY ALL),"""
    moved_book = """
means{n} AS (
  SELECT part, entry, list(mean ORDER BY d) AS v FROM (
    SELECT a.part, a.entry, d, floor(sum(p.v[d]) / count(*))::BIGINT AS mean
    FROM assigned{k} a JOIN parts p USING (place, part), range(1, (SELECT max(len(v)) FROM parts) + 1) t(d) GROUP BY ALL) GROUP BY ALL),
book{n} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN means{n} m USING (part, entry)),"""
    return (
        """
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS place, vec_id, label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT place, part, v[(part * len(v) // 16 + 1):((part + 1) * len(v) // 16)] AS v FROM kept, range(16) t(part)),
book0 AS (SELECT part, place - 1 AS entry, v FROM parts WHERE place <= 64),"""
        + "".join(assigned.format(k=k) + moved_book.format(k=k, n=k + 1) for k in range(2))
        + assigned.format(k=2)
        + """
coded AS (
  SELECT vec_id, label, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, sum(distance)::BIGINT AS error
  FROM assigned2 JOIN kept USING (place) GROUP BY place, vec_id, label)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM book2) AS codebooks_sha256
FROM coded
"""
    )


ORACLE_SQL = _sql()
