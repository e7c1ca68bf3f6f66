"""Hard negatives through a vector-approximation file.

Every dimension is cut into cells, and the file keeps a vector's cells beside
its integer components, in blocks of bounded size on the shared folder.  A
block of vectors meets a block of anchors in one task, which reads both by
itself: nothing is replicated by a shuffle, and nothing passes whole through
the driver, a broadcast or a task.  There the cells give, through the tables of
their middles and half widths, a lower and an upper bound of every score, and
only what may enter the first places, or a window, is scored exactly.

Two rounds of such tasks: the first finds the anchors' positives; the second
reads the windows that these leave and finds the negatives in them.  Each task
sends a few rows an anchor, and a window by anchor keeps the first of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import scratch
from tidemark.llm.files import opened
from tidemark.llm.vectors import integer_rows, matrix, packed, unpacked

CELLS = 64
#: Components of the rows in a block of the file, and anchors in a block of theirs: what one task holds at once.
BLOCK_COMPONENTS, BLOCK_ANCHORS = 1 << 22, 1 << 12
#: Rows and anchors whose bounds are in memory at once, and pairs scored at once.
STEP_ROWS, STEP_ANCHORS, STEP_PAIRS = 4096, 128, 1 << 15
MOST_TASKS = 100_000
_NULL = np.iinfo(np.int64).max  # a null id comes after all others


@dataclass
class Cells:
    """Uniform cells between the least and the largest component of each dimension."""

    low: np.ndarray
    width: np.ndarray

    @staticmethod
    def fitted(low: np.ndarray, high: np.ndarray) -> Cells:
        return Cells(low, (high - low) // CELLS + 1)

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        return ((vectors - self.low) // self.width).astype(np.uint8)

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Middle of each cell (by dimension and cell), and half the width of a dimension's cells."""
        first = self.low[:, None] + np.arange(CELLS)[None, :] * self.width[:, None]
        half = (self.width - 1) / 2
        return first + half[:, None], half


def _best(group: np.ndarray, score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the first ``most`` of each group: higher scores first, then smaller ids."""
    order = np.lexsort((ids, -score, group))
    sorted_group = group[order]
    start = np.flatnonzero(np.concatenate(([True], sorted_group[1:] != sorted_group[:-1]))) if len(order) else np.empty(0, int)
    place = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    return order[place < most]


class _Found:
    """The first rows of each group so far, and the score that another row must reach to be among them."""

    def __init__(self, groups: int, most: int):
        self.most, self.columns = most, [np.empty(0, np.int64) for _ in range(3)]
        self.least = np.full(groups, -np.inf)

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        merged = [np.concatenate(pair) for pair in zip(self.columns, (group, score, ids), strict=True)]
        kept = _best(*merged, self.most)
        self.columns = [c[kept] for c in merged]
        counts = np.bincount(self.columns[0], minlength=len(self.least))
        worst = np.full(len(self.least), np.inf)
        np.minimum.at(worst, self.columns[0], self.columns[1])
        self.least = np.where(counts >= self.most, worst, -np.inf)


def _exact(anchors: np.ndarray, vectors: np.ndarray, a: np.ndarray, r: np.ndarray) -> np.ndarray:
    scores = np.empty(len(a), np.int64)
    for k in range(0, len(a), STEP_PAIRS):
        part = slice(k, k + STEP_PAIRS)
        scores[part] = np.einsum("ij,ij->i", anchors[a[part]].astype(np.int64), vectors[r[part]].astype(np.int64))
    return scores


def _bounds(anchors: np.ndarray, middles: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of anchors (rows) and coded vectors (columns); exact in doubles.

    A bound sums over dimensions what the cells' tables hold times the anchor's
    component: looked up once a vector (``middles``), summed by a product.
    """
    centre = anchors.astype(np.float64) @ middles.T
    slack = (np.abs(anchors) @ half)[:, None]
    return centre - slack, centre + slack


@dataclass
class Block:
    """Rows of the file or anchors, as arrays."""

    place: np.ndarray  # which row of which file
    ids: np.ndarray
    labels: np.ndarray
    codes: np.ndarray
    vectors: np.ndarray

    @staticmethod
    def read(uri: str) -> Block:
        system, path = opened(uri)
        table = pq.read_table(path, filesystem=system, columns=["place", "vec_id", "label", "codes", "vector"])
        ids = table["vec_id"].fill_null(_NULL).to_numpy()
        return Block(table["place"].to_numpy(), ids, table["label"].to_numpy(), unpacked(table["codes"], np.uint8), unpacked(table["vector"], np.int32))

    def steps(self, size: int):
        for k in range(0, len(self.ids), size):
            part = slice(k, k + size)
            yield Block(self.place[part], self.ids[part], self.labels[part], self.codes[part], self.vectors[part])


def first_positives(anchors: Block, rows: Block, tables, most: int):
    """(anchor's number in its block, score, id) of the first other rows of the anchor's label, in this block of rows."""
    table, half = tables
    steps = [(step, table[np.arange(step.codes.shape[1]), step.codes]) for step in rows.steps(STEP_ROWS)]
    for k, some in enumerate(anchors.steps(STEP_ANCHORS)):
        found = _Found(len(some.ids), most)
        for step, middles in steps:
            same = (some.labels[:, None] == step.labels[None, :]) & (some.place[:, None] != step.place[None, :])
            if not same.any():
                continue
            low, high = _bounds(some.vectors, middles, half)
            least = found.least
            if low.shape[1] > most:  # so many rows surely reach this
                least = np.maximum(least, np.partition(np.where(same, low, -np.inf), -most, axis=1)[:, -most])
            a, r = np.nonzero(same & (high >= least[:, None]))
            found.add(a, _exact(some.vectors, step.vectors, a, r), step.ids[r])
        yield found.columns[0] + k * STEP_ANCHORS, *found.columns[1:]


def first_negatives(anchors: Block, rows: Block, tables, owner: np.ndarray, low_end: np.ndarray, high_end: np.ndarray, most: int):
    """(window, score, id) of the first rows of another label with a score inside each window, in this block of rows.

    Window w belongs to anchor ``owner[w]`` of the block (ascending) and takes
    scores from ``low_end[w]`` to ``high_end[w]``.
    """
    table, half = tables
    steps = [(step, table[np.arange(step.codes.shape[1]), step.codes]) for step in rows.steps(STEP_ROWS)]
    for k, some in enumerate(anchors.steps(STEP_ANCHORS)):
        first = np.searchsorted(owner, k * STEP_ANCHORS + np.arange(len(some.ids) + 1))
        mine = slice(first[0], first[-1])
        own, low_own, high_own = owner[mine] - k * STEP_ANCHORS, low_end[mine], high_end[mine]
        starts, windows = first[:-1] - first[0], np.diff(first)
        widest_low, widest_high = np.full(len(some.ids), np.inf), np.full(len(some.ids), -np.inf)
        np.minimum.at(widest_low, own, low_own)
        np.maximum.at(widest_high, own, high_own)
        found = _Found(len(own), most)
        for step, middles in steps:
            low, high = _bounds(some.vectors, middles, half)
            a, r = np.nonzero((high >= widest_low[:, None]) & (low <= widest_high[:, None]) & (some.labels[:, None] != step.labels[None, :]))
            low, high, times = low[a, r], high[a, r], windows[a]
            pair = np.repeat(np.arange(len(a)), times)  # each pair with each window of its anchor
            window = np.repeat(starts[a] - np.cumsum(times) + times, times) + np.arange(len(pair))
            may = (high[pair] >= np.maximum(low_own, found.least)[window]) & (low[pair] <= high_own[window])
            pair, window = pair[may], window[may]
            needed, back = np.unique(pair, return_inverse=True)
            score = _exact(some.vectors, step.vectors, a[needed], r[needed])[back]
            inside = (score >= low_own[window]) & (score <= high_own[window])
            found.add(window[inside], score[inside], step.ids[r[pair[inside]]])
        yield found.columns[0] + first[0], *found.columns[1:]


def _ids(values: np.ndarray) -> pa.Array:
    return pa.array(values, pa.int64(), mask=values == _NULL)


def _limits(spark: SparkSession, rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest component of each dimension: one row a dimension comes to the driver."""

    def run(batches):
        least = most = None
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column("vector"), None if least is None else len(least))
                least = v.min(0) if least is None else np.minimum(least, v.min(0))
                most = v.max(0) if most is None else np.maximum(most, v.max(0))
        if least is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(least))), pa.array(least), pa.array(most), pa.array(np.full(len(least), len(least)))], names=["d", "least", "most", "width"])

    found = rows.select("vector").mapInArrow(run, "d long, least long, most long, width long")
    found = found.groupBy("d").agg(F.min("least"), F.max("most"), F.min("width"), F.max("width")).orderBy("d").collect()
    if any(row[3] != row[4] for row in found):
        raise ValueError(f"vectors of {found[0][3]} components beside some of {found[0][4]}")
    return np.array([row[1] for row in found], np.int64), np.array([row[2] for row in found], np.int64)


class ApproximationFile:
    """Cells and integer components of all rows in blocks, and the anchors among them in blocks of their own."""

    def __init__(self, spark: SparkSession, rows: DataFrame, anchor):
        """``rows`` has vec_id, label and integer vectors; ``anchor``, a column over them, says which are anchors."""
        self.spark, folder = spark, scratch(spark, "approximation")
        low, high = _limits(spark, rows)
        self.cells = cells = Cells.fitted(low, high)

        def run(batches):
            for batch in batches:
                v = matrix(batch.column("vector"), len(low))
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], packed(cells.codes(v)), packed(v.astype(np.int32))], names=["vec_id", "label", "codes", "vector"])

        coded = rows.select("vec_id", "label", "vector").mapInArrow(run, "vec_id long, label long, codes binary, vector binary")
        options = {"maxRecordsPerFile": max(1, BLOCK_COMPONENTS // max(len(low), 1)), "compression": "zstd"}
        coded.select(F.monotonically_increasing_id().alias("place"), "*").write.options(**options).parquet(f"{folder}/rows")
        self.rows = spark.read.schema("place long, vec_id long, label long, codes binary, vector binary").parquet(f"{folder}/rows")
        chosen = self.rows.where(anchor)
        chosen.repartition(max(1, -(-chosen.count() // BLOCK_ANCHORS))).write.options(**(options | {"maxRecordsPerFile": BLOCK_ANCHORS})).parquet(f"{folder}/anchors")
        self.anchors = spark.read.schema(self.rows.schema).parquet(f"{folder}/anchors")
        self.folder = folder

    def block_pairs(self) -> DataFrame:
        """A row, and a task, for each block of rows and block of anchors: made of the names of the files alone."""
        files, anchors = sorted(self.rows.inputFiles()), sorted(self.anchors.inputFiles())
        names = self.spark.createDataFrame([(f,) for f in files], "rows string")
        tasks = min(max(1, len(files) * len(anchors)), MOST_TASKS)
        return names.withColumn("anchors", F.explode(F.lit(anchors).cast("array<string>"))).repartition(tasks)

    def positives(self, most: int) -> DataFrame:
        """``place`` and ``anchor_id`` of an anchor, ``rank`` (from 1), ``positive_id`` and ``score``."""
        tables = self.cells.tables()

        def run(batches):
            for batch in batches:
                for rows, anchors in zip(batch.column("rows").to_pylist(), batch.column("anchors").to_pylist(), strict=True):
                    block = Block.read(anchors)
                    for a, score, ids in first_positives(block, Block.read(rows), tables, most):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([anchors] * len(a), pa.string()), pa.array(block.place[a]), _ids(block.ids[a]), _ids(ids), pa.array(score)],
                            names=["block", "place", "anchor_id", "positive_id", "score"],
                        )

        found = self.block_pairs().mapInArrow(run, "block string, place long, anchor_id long, positive_id long, score long")
        order = Window.partitionBy("place").orderBy(F.desc("score"), F.asc_nulls_last("positive_id"))
        return found.withColumn("order", F.row_number().over(order)).where(F.col("order") <= most)

    def negatives(self, positives: DataFrame, low_end, high_end, most: int) -> DataFrame:
        """``anchor_id, positive_id, positive_score`` of each positive with ``rank, negative_id, negative_score``.

        ``low_end`` and ``high_end`` are columns over ``score``, a positive's score.
        """
        windows = positives.select("place", "anchor_id", "order", "positive_id", "score", low_end.alias("low_end"), high_end.alias("high_end"), F.regexp_extract("block", "[^/]+$", 0).alias("block"))
        path = f"{scratch(self.spark, 'windows')}"
        windows.write.partitionBy("block").parquet(path)
        names = ["place", "anchor_id", "order", "positive_id", "score", "negative_id", "negative_score"]
        tables, schema = self.cells.tables(), "place long, anchor_id long, order int, positive_id long, positive_score long, negative_id long, negative_score long"

        def run(batches):
            for batch in batches:
                for rows, anchors in zip(batch.column("rows").to_pylist(), batch.column("anchors").to_pylist(), strict=True):
                    block, (system, folder) = Block.read(anchors), opened(f"{path}/block={anchors.rpartition('/')[2]}")
                    if system.get_file_info(folder).type.name != "Directory":
                        continue  # no anchor of this block has a positive
                    given = pads.dataset(folder, filesystem=system).to_table()
                    number = {int(p): k for k, p in enumerate(block.place)}
                    owner = np.array([number[p] for p in given["place"].to_pylist()], np.int64)
                    turn = np.argsort(owner, kind="stable")
                    given = given.take(turn)
                    ends = [given[c].to_numpy() for c in ("low_end", "high_end")]
                    for w, score, ids in first_negatives(block, Block.read(rows), tables, owner[turn], *ends, most):
                        same = [pa.concat_arrays(given[c].chunks).take(pa.array(w)) if given.num_rows else pa.array([], given[c].type) for c in names[:5]]
                        yield pa.RecordBatch.from_arrays([*same, _ids(ids), pa.array(score)], names=[*names[:4], "positive_score", *names[5:]])

        found = self.block_pairs().mapInArrow(run, schema)
        order = Window.partitionBy("place", "order").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"))
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def hard_negatives(
    df: DataFrame, *, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", every: int = 100,
    positives: int = 5, negatives: int = 5, percent: int = 80,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: the negatives near each positive of each anchor.

    Rows whose id is divisible by ``every`` are anchors.  A row's score is its
    integer inner product with the anchor, components being floor(256 * x);
    higher scores come first, ties by smaller id, null ids last.  An anchor's
    positives are the first other rows of its label; a positive's negatives are
    the first rows of other labels with a score between ``percent`` hundredths
    of the positive's score and that score.

    Rows with a null label, a null vector or a null or non-finite component
    take no part.  A null id is never an anchor.  Rows are rows: repeated ones
    count as often as they are there, so a copy of an anchor is a positive of
    it, and an anchor itself.  An empty table, a label of its own and an empty
    window (all with a negative positive's score) give no rows.  Vectors of
    different lengths, and components beyond some 10^4, raise ValueError; ids
    and labels that are not whole numbers raise TypeError.  Further columns are ignored.
    """
    spark = df.sparkSession
    rows = integer_rows(df, id_col, label_col, vector_col).where("label is not null")
    file = ApproximationFile(spark, rows, F.col("vec_id") % every == 0)
    low_end = F.expr(f"cast(ceil(cast(score as decimal(20,0)) * {int(percent)} / 100) as long)")
    found = file.negatives(file.positives(positives), low_end, F.col("score"), negatives)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def hard_negatives_query(embeddings: DataFrame) -> DataFrame:
    """The contract's rows: where the id is divisible by 7, the label is first one further, modulo 10."""
    names = {c: embeddings[f"`{c}`"] for c in ("vec_id", "label", "embedding")}
    moved = F.when(names["vec_id"] % 7 == 0, (names["label"] + 1) % 10).otherwise(names["label"])
    return hard_negatives(embeddings.select(names["vec_id"], moved.alias("label"), names["embedding"]))


ORACLE_SQL = """
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id, label, embedding) AS place, vec_id,
         CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS MATERIALIZED (
  SELECT a.place, a.vec_id AS anchor_id, r.vec_id AS id, r.place AS row_place, r.label = a.label AS same, list_dot_product(a.v, r.v)::BIGINT AS score
  FROM kept a, kept r WHERE a.vec_id % 100 = 0 AND r.place != a.place),
positives AS (
  SELECT place, anchor_id, id AS positive_id, score AS positive_score, row_place FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY place ORDER BY score DESC, id NULLS LAST, row_place) <= 5)
SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.place, p.row_place ORDER BY n.score DESC, n.id NULLS LAST)::INTEGER AS rank,
       n.id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scores n ON n.place = p.place AND NOT n.same AND 80 * p.positive_score <= 100 * n.score AND n.score <= p.positive_score
QUALIFY rank <= 5
"""
