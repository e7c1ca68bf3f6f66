"""Quality scores from a generalised additive model with pairwise interactions.

Surface features of each text are cut into bins.  Cyclic boosting visits one
feature after another and adds a shallow tree over its bins to that feature's
lookup table; then the same for the pairs of features that explain most of what
is left.  A score is the sum of table entries, looked up for whole batches.

Feature extraction and scoring run on Spark over every row.  The tables are
fitted on a sample of at most ``max_train_rows`` labelled rows, taken in the
order of a hash of the id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from tidemark.llm.common import carrying, crc_mod, labelled
from tidemark.llm.kernel import U64, mixed, pieces, span_hashes, word_spans

FEATURES = (
    "log_words", "word_length", "word_length_sd", "short_words", "unique_words", "top_word", "repeats_next",
    "unique_pairs", "caps_words", "symbol_ended", "upper", "digits", "marks", "symbols", "non_ascii",
    "log_line_words", "repeated_lines", "lower_starts", "lone_symbols", "sentence_ends",
)

_ADDED = StructType([StructField("score", DoubleType()), StructField("predicted", IntegerType())])
_CLASS = np.zeros(256, dtype=np.uint8)  # 0: none of the below
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[[ord(c) for c in ".,;:?!'\"()-"]] = 4
_CLASS[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 5
_CLASS[128:] = 6


def text_features(blob: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text of a blob; texts without words have zeros."""
    n = len(begins) - 1
    kind = _CLASS[blob]
    size = np.maximum(np.diff(begins) - 1, 1)
    share = {k: np.add.reduceat(kind == k, begins[:-1]) / size for k in (2, 3, 4, 5, 6)}
    starts, ends = word_spans(blob)
    owner = np.searchsorted(begins, starts, "right") - 1
    words = np.bincount(owner, minlength=n)
    per_word = lambda x: np.bincount(owner, weights=x, minlength=n) / np.maximum(words, 1)
    hashes = span_hashes(blob, starts, ends)
    length = (ends - starts).astype(np.float64)
    mean = per_word(length)
    spread = np.sqrt(np.maximum(per_word(length**2) - mean**2, 0))

    salt = mixed(owner.astype(U64) + U64(1))
    _, first, count = np.unique(hashes ^ salt, return_index=True, return_counts=True)
    distinct = np.bincount(owner[first], minlength=n)
    top = np.zeros(n, dtype=np.int64)
    np.maximum.at(top, owner[first], count)
    near = owner[1:] == owner[:-1]
    same = np.bincount(owner[1:][near & (hashes[1:] == hashes[:-1])], minlength=n)
    _, first = np.unique((mixed(hashes[1:] + U64(3) * hashes[:-1]) ^ salt[1:])[near], return_index=True)
    pairs = np.bincount(owner[1:][near][first], minlength=n)

    seen = lambda k: np.concatenate(([0], np.cumsum(kind == k)))
    lower, upper, symbol = seen(1), seen(2), seen(5)
    has = lambda c: c[ends] - c[starts]
    caps = (has(upper) >= 2) & (has(lower) == 0)
    last = kind[ends - 1]
    ended = (last == 5) | ((blob[ends - 1] == ord("!")) & (length > 2) & (blob[np.maximum(ends - 2, 0)] == ord("!")))

    line_ends = np.flatnonzero(blob == 10)
    line_starts = np.concatenate(([0], line_ends[:-1] + 1))
    full = line_ends > line_starts
    line_starts, line_ends = line_starts[full], line_ends[full]
    line_owner = np.searchsorted(begins, line_starts, "right") - 1
    n_lines = np.bincount(line_owner, minlength=n)
    lines = np.maximum(n_lines, 1)
    line_keys = span_hashes(blob, line_starts, line_ends) ^ mixed(line_owner.astype(U64) + U64(1))
    distinct_lines = np.bincount(line_owner[np.unique(line_keys, return_index=True)[1]], minlength=n)

    some = np.maximum(words, 1)
    return np.column_stack(
        [
            np.log1p(words), mean, spread, per_word(length <= 3), distinct / some, top / some, same / some,
            pairs / np.maximum(words - 1, 1), per_word(caps), per_word(ended), share[2], share[3], share[4], share[5],
            share[6], np.log1p(words / lines), (n_lines - distinct_lines) / lines, per_word(kind[starts] == 1),
            per_word(has(symbol) == length), per_word((blob[ends - 1] == ord(".")) | (blob[ends - 1] == ord("?"))),
        ]
    ).astype(np.float32)


@dataclass
class AdditiveModel:
    """Bin edges and lookup tables; pairs use every fourth edge."""

    bias: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    @staticmethod
    def coarse(bins: np.ndarray) -> np.ndarray:
        return bins // 4

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)])

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1."""
        b = self.bins(x)
        total = np.full(len(x), self.bias)
        for k, table in enumerate(self.tables):
            total += table[b[:, k]]
        c = self.coarse(b)
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[c[:, i], c[:, j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _shallow_tree(g: np.ndarray, h: np.ndarray, penalty: float) -> np.ndarray:
    """Newton steps per bin from a tree of up to three leaves over ordered bins."""
    gain = lambda a, b: a * a / (b + penalty)
    leaves = [(0, len(g))]
    for _ in range(2):
        best = (1e-9, None, None)
        for leaf in leaves:
            lo, hi = leaf
            if hi - lo < 2:
                continue
            cg, ch = np.cumsum(g[lo:hi]), np.cumsum(h[lo:hi])
            left = gain(cg[:-1], ch[:-1]) + gain(cg[-1] - cg[:-1], ch[-1] - ch[:-1]) - gain(cg[-1], ch[-1])
            left[(ch[:-1] < 1) | (ch[-1] - ch[:-1] < 1)] = 0
            cut = int(np.argmax(left))
            if left[cut] > best[0]:
                best = (left[cut], leaf, lo + cut + 1)
        if best[1] is None:
            break
        leaves.remove(best[1])
        leaves += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(g))
    for lo, hi in leaves:
        out[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + penalty)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """Gain and steps of the best cut into four quadrants of a two-way table."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    best, at = 0.0, (0, 0)
    total = cg[-1, -1] ** 2 / (ch[-1, -1] + penalty)
    quadrants = lambda c: (c[:-1, :-1], c[:-1, -1:] - c[:-1, :-1], c[-1:, :-1] - c[:-1, :-1], c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + c[:-1, :-1])
    gains = sum(a * a / (b + penalty) for a, b in zip(quadrants(cg), quadrants(ch), strict=True)) - total
    if gains.size:
        at = np.unravel_index(int(np.argmax(gains)), gains.shape)
        best = float(gains[at])
    out = np.zeros_like(g)
    i, j = at[0] + 1, at[1] + 1
    for rows in (slice(0, i), slice(i, None)):
        for cols in (slice(0, j), slice(j, None)):
            out[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + penalty)
    return best, out


def fit(
    x: np.ndarray, y: np.ndarray, *, bins: int = 32, rounds: int = 150, pair_rounds: int = 60, n_pairs: int = 6,
    rate: float = 0.15, penalty: float = 2.0,
) -> AdditiveModel:
    """Cyclic boosting of single tables, then of pair tables.  Without two classes every score is the labels' mean."""
    width = x.shape[1]
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.empty(0) for k in range(width)]
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    model = AdditiveModel(np.log(mean / (1 - mean)), edges, [np.zeros(len(e) + 1) for e in edges], [], [])
    if len(np.unique(y)) < 2:
        return model
    b = model.bins(x)
    margin = np.full(len(y), model.bias)

    def slopes():
        p = 1 / (1 + np.exp(-margin))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for k, table in enumerate(model.tables):
            if len(table) == 1:
                continue
            g, h = slopes()
            step = rate * _shallow_tree(np.bincount(b[:, k], g, len(table)), np.bincount(b[:, k], h, len(table)), penalty)
            table += step
            margin += step[b[:, k]]

    c = model.coarse(b)
    sizes = [model.coarse(np.array(len(t) - 1)) + 1 for t in model.tables]

    def two_way(i, j, g, h):
        flat = c[:, i] * sizes[j] + c[:, j]
        shape = (int(sizes[i]), int(sizes[j]))
        return np.bincount(flat, g, shape[0] * shape[1]).reshape(shape), np.bincount(flat, h, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    ranked = sorted(((_pair_tree(*two_way(i, j, g, h), penalty)[0], i, j) for i in range(width) for j in range(i)), reverse=True)
    model.pairs = [(i, j) for _, i, j in ranked[:n_pairs]]
    model.pair_tables = [np.zeros((int(sizes[i]), int(sizes[j]))) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for (i, j), table in zip(model.pairs, model.pair_tables, strict=True):
            g, h = slopes()
            step = rate * _pair_tree(*two_way(i, j, g, h), penalty)[1]
            table += step
            margin += step[c[:, i], c[:, j]]
    return model


def _features_of(batch: pa.RecordBatch, text_col: str):
    """(rows, features) of a batch, some texts at a time."""
    for rows, blob, begins in pieces(batch, text_col):
        yield rows, text_features(blob, begins).astype(np.float64)


def train(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    trainable: Column | None = None, max_train_rows: int = 20000,
) -> AdditiveModel:
    """A model of label 1 from at most ``max_train_rows`` labels, chosen as ``labelled`` says; one text and label an id.

    Further columns of either table are ignored, whatever they are called; very
    long texts are taken whole.  Without labels every score is 0.5.
    """
    texts = labelled(docs, labels, id_col, text_col, label_col, trainable, max_train_rows)

    def run(batches):
        for batch in batches:
            for rows, x in _features_of(batch, "text"):
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("y")[rows], values], names=["y", "x"])

    sample = texts.select("text", "y").mapInArrow(run, "y int, x array<double>").toPandas()
    x = np.stack(sample["x"].to_numpy()) if len(sample) else np.empty((0, len(FEATURES)))
    order = np.lexsort((*x.T, sample["y"].to_numpy()))  # the order in which tasks end must not matter
    return fit(x[order], sample["y"].to_numpy(dtype=np.float64)[order])


def score(docs: DataFrame, model: AdditiveModel, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.3) -> DataFrame:
    """The columns ``keep`` of every row with ``score``, the probability of label 1, and ``predicted``.

    Null texts count as empty; empty and very long texts are scored like
    others.  Each row is scored by itself, so repeated rows, null ids and any
    further columns pass unchanged; an empty table stays empty.  ``keep`` may
    not name the columns that are added.
    """

    def run(batches):
        for batch in batches:
            for rows, x in _features_of(batch, "text"):
                p = model.score(x)
                yield pa.RecordBatch.from_arrays([batch.column("kept")[rows], pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["kept", "score", "predicted"])

    return carrying(docs, text_col, keep, run, _ADDED)


def quality_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns: learned from the rows whose id hash mod 5 is not 0."""
    held_out = crc_mod(F.col("doc_id"), 5) == 0
    model = train(docs, labels, trainable=~held_out)
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
