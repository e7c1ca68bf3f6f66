"""Near-duplicate join on word shingles with Bayesian candidate pruning.

Texts with the same shingle set form a class at once.  Classes get MinHash
values; those that agree on all rows of some band are candidates.  MinHash
values of candidates are compared a few at a time; a pair is dropped when the
posterior probability that its similarity reaches the threshold falls below
the tolerance.  What is left is verified exactly on the shingle sets.

Pairs inside a large crowd (classes whose smallest candidate's candidate is the
same) are compared block against block inside tasks and only counted there, so a
group of thousands of near copies yields rows in proportion to its members.  A
block is of bounded bytes, and its sets travel as differences from one member's
set, which near copies have few of.
"""

from __future__ import annotations

from functools import lru_cache
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored
from tidemark.llm.graph import components
from tidemark.llm.kernel import U64, mixed, pieces, span_hashes, window_hashes, word_spans

N_HASHES, BAND = 128, 4
#: A crowd whose MinHash values and shingles have b bytes is cut into sqrt(b / UNIT_BYTES) blocks, so that its pairs of blocks, which are
#: the tasks, are as many as its units; but no block has more than MAX_BLOCK_BYTES.
UNIT_BYTES, MAX_BLOCK_BYTES = 512 << 10, 32 << 20
PAIRS = 1 << 19  # pairs of a task that are compared at a time
BUCKET_PART = 512  # nodes of a bucket that meet others in one key
SMALL_CROWD = 16  # up to this size, pairs of a crowd are rows
STEP = 16  # MinHash values compared at a time

_seeds = mixed(np.arange(1, 2 * N_HASHES + 1, dtype=U64))
_MULTIPLY = (_seeds[:N_HASHES] >> U64(32)).astype(np.uint32) | np.uint32(1)
_ADD = (_seeds[N_HASHES:] >> U64(32)).astype(np.uint32)


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of k words in a row; of all words if there are fewer; none without words."""
    if len(words) == 0:
        return np.empty(0, dtype=U64)
    return np.unique(window_hashes(words, min(k, len(words))))


def minhash(shingles: np.ndarray) -> np.ndarray:
    """N_HASHES minima of multiply-add hashes, in bounded memory for any length."""
    out = np.full(N_HASHES, 0xFFFFFFFF, dtype=np.uint32)
    x = (shingles >> U64(32)).astype(np.uint32)
    for at in range(0, len(x), 2048):
        part = _MULTIPLY[:, None] * x[None, at : at + 2048]
        part += _ADD[:, None]
        # the high bits decide, and the low ones of a product are weak
        np.minimum(out, part.min(axis=1), out=out)
    return out


def set_key(shingles: np.ndarray, others: np.ndarray) -> bytes:
    """128 bits that stand for a whole shingle set, given by two independent hashes of its shingles."""
    a = np.bitwise_xor.reduce(mixed(shingles + U64(11))) if len(shingles) else U64(0)
    b = np.add.reduce(mixed(others ^ U64(0xABCDEF0123456789))) if len(others) else U64(0)
    return np.array([a, b], dtype="<u8").tobytes()


def _sets(blob: np.ndarray, begins: np.ndarray, k: int) -> tuple[list[np.ndarray], list[bytes | None]]:
    """The shingle set of each text of a blob, and its key (none for a text without words)."""
    starts, ends = word_spans(blob)
    bound = np.searchsorted(starts, begins)
    words, others = (span_hashes(blob, starts, ends, salt) for salt in (0, 1))
    own = [slice(bound[d], bound[d + 1]) for d in range(len(begins) - 1)]
    sets = [shingle_set(words[o], k) for o in own]
    return sets, [set_key(x, shingle_set(others[o], k)) if len(x) else None for o, x in zip(own, sets, strict=True)]


@lru_cache(maxsize=None)
def least_agreement(threshold: float, tolerance: float) -> tuple[int, ...]:
    """For n = STEP, 2 STEP, .. compared values: the fewest agreements a pair may have to stay.

    With a uniform prior on the similarity s, m agreements of n leave a
    Beta(m + 1, n - m + 1); its tail above the threshold is the probability
    that a Binomial(n + 1, threshold) is at most m.
    """
    out = []
    for n in range(STEP, N_HASHES + 1, STEP):
        tail, least = 0.0, n
        for m in range(n + 1):
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                least = m
                break
        out.append(least)
    return tuple(out)


def survivors(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray, least: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) of MinHash rows that Bayesian pruning keeps."""
    agreed = np.zeros(len(i), dtype=np.int32)
    for step, m in enumerate(least):
        if not len(i):
            break
        cols = slice(step * STEP, (step + 1) * STEP)
        agreed = agreed + (left[i, cols] == right[j, cols]).sum(axis=1, dtype=np.int32)
        stay = agreed >= m
        i, j, agreed = i[stay], j[stay], agreed[stay]
    return i, j


def _signatures(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    given = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = given.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for rows, blob, begins in pieces(batch, "text"):
                sets, keys = _sets(blob, begins, k)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[rows],
                        pa.array(keys, pa.binary()),
                        pa.array([minhash(s).tobytes() for s in sets], pa.binary()),
                    ],
                    names=["doc_id", "set_key", "minhash"],
                )

    return given.mapInArrow(run, f"doc_id {kind}, set_key binary, minhash binary")


def _shingle_sets(docs: DataFrame, id_col: str, text_col: str, k: int, wanted: DataFrame) -> DataFrame:
    """(node, copies, minhash, shingles) of the wanted (first, set_key, node, copies, minhash)."""
    given = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    given = given.join(wanted, given.doc_id.eqNullSafe(wanted["first"])).drop("doc_id", "first")

    def run(batches):
        for batch in batches:
            for rows, blob, begins in pieces(batch, "text"):
                part = batch.slice(rows.start, rows.stop - rows.start)
                sets, keys = _sets(blob, begins, k)
                # an id may occur with several texts
                own = pa.array([own == key.as_py() for own, key in zip(keys, part.column("set_key"), strict=True)])
                shingles = pa.array([s.tobytes() for s in sets], pa.binary())
                out = [part.column(c) for c in ("node", "copies", "minhash")] + [shingles]
                yield pa.RecordBatch.from_arrays(out, names=["node", "copies", "minhash", "shingles"]).filter(own)

    return given.mapInArrow(run, "node long, copies long, minhash binary, shingles binary").dropDuplicates(["node"])


def _banded(classes: DataFrame) -> DataFrame:
    """(band, bucket, node, minhash is left out): a row for each class and band."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.stack([np.frombuffer(v.as_py(), dtype=np.uint32) for v in batch.column("minhash")]).astype(U64)
            node = batch.column("node").to_numpy(zero_copy_only=False)
            n, bands = len(node), N_HASHES // BAND
            key = np.zeros((n, bands), dtype=U64)
            for r in range(BAND):
                key = mixed(key * U64(31) + values[:, r::BAND] + U64(1))
            key ^= mixed(np.arange(bands, dtype=U64))[None, :]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(node, bands))], names=["bucket", "node"]
            )

    return classes.select("node", "minhash").mapInArrow(run, "bucket long, node long")


def _arrays(column) -> list[np.ndarray]:
    return [np.frombuffer(v, dtype=U64) for v in column]


def intersections(left: list[np.ndarray], right: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets left[i] and right[j], by shared values only."""
    if len(i) < 64:
        return np.array([len(np.intersect1d(left[a], right[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], dtype=np.int64)
    ua, ub = np.unique(i), np.unique(j)
    va, vb = np.concatenate([left[a] for a in ua]), np.concatenate([right[b] for b in ub])
    oa = np.repeat(np.arange(len(ua)), [len(left[a]) for a in ua])
    ob = np.repeat(np.arange(len(ub)), [len(right[b]) for b in ub])
    shared = np.intersect1d(va, vb)
    ka, kb = np.isin(va, shared), np.isin(vb, shared)
    ca, cb = np.searchsorted(shared, va[ka]), np.searchsorted(shared, vb[kb])
    oa, ob = oa[ka], ob[kb]
    ra, rb = np.argsort(ca, kind="stable"), np.argsort(cb, kind="stable")
    ca, oa, cb, ob = ca[ra], oa[ra], cb[rb], ob[rb]
    total = np.zeros((len(ua), len(ub)), dtype=np.float32)
    for at in range(0, len(shared), 4096):
        wa, wb = slice(*np.searchsorted(ca, (at, at + 4096))), slice(*np.searchsorted(cb, (at, at + 4096)))
        a = np.zeros((len(ua), 4096), dtype=np.float32)
        b = np.zeros((len(ub), 4096), dtype=np.float32)
        a[oa[wa], ca[wa] - at] = 1
        b[ob[wb], cb[wb] - at] = 1
        total += a @ b.T
    return total[np.searchsorted(ua, i), np.searchsorted(ub, j)].astype(np.int64)


def similar(left, right, i, j, threshold: float) -> np.ndarray:
    """Which of the pairs (left[i], right[j]) have at least the threshold's Jaccard similarity, exactly."""
    common = intersections(left, right, i, j)
    sizes = np.array([len(s) for s in left])[i] + np.array([len(s) for s in right])[j]
    return common >= threshold * (sizes - common) - 1e-9


def _forest(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Numbers of the edges that join two parts, taken in order."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = top(x), top(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append(k)
    return kept


_COUNTED = "a long, b long, edge boolean, links long, rows_linked long"
_BLOCKED = "crowd long, blocks long, own long, node long, copies long, minhash binary, difference binary, size long, gone long, base long"


def differences(shingles: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, int]:
    """What a set has beyond ``base``, and (mixed, so that the two are told apart) what it lacks of it; and how many it lacks."""
    gone = np.setdiff1d(base, shingles, assume_unique=True)
    return np.sort(np.concatenate((np.setdiff1d(shingles, base, assume_unique=True), mixed(gone ^ U64(0x5851F42D4C957F2D))))), len(gone)


def _blocked(members: DataFrame) -> DataFrame:
    """Members (crowd, node, copies, minhash, shingles) dealt to blocks, their sets as differences from that of the crowd's smallest node."""
    held = F.sum(F.length("minhash") + F.length("shingles"))
    sized = members.groupBy("crowd").agg(F.greatest(F.ceil(F.sqrt(held / UNIT_BYTES)), F.ceil(held / MAX_BLOCK_BYTES)).cast("long").alias("blocks"), F.min("node").alias("first"))
    joined = members.join(sized, "crowd")
    dealt = joined.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks"))).drop("first")
    bases = joined.where("node = first").select(
        F.col("crowd").alias("base_crowd"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("base_own"), F.col("shingles").alias("base")
    )

    def run(pdf: pd.DataFrame, base: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({name.split()[0]: [] for name in _BLOCKED.split(", ")})
        base = np.frombuffer(base["base"].iat[0], dtype=U64)
        sets = _arrays(pdf["shingles"])
        told = [differences(x, base) for x in sets]
        out = pdf[["crowd", "blocks", "own", "node", "copies", "minhash"]]
        return out.assign(difference=[d.tobytes() for d, _ in told], size=[len(x) for x in sets], gone=[n for _, n in told], base=len(base))

    return dealt.groupBy("crowd", "own").cogroup(bases.groupBy("base_crowd", "base_own")).applyInPandas(run, _BLOCKED)


def _within_crowds(members: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """Links inside crowds: rows (a, b, edge) that span them, and (a, links, rows_linked) counts.

    ``members`` has crowd, node, copies, minhash, shingles.
    """
    dealt = stored(_blocked(members), "near-blocks")
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    task = (F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        least = least_agreement(threshold, tolerance)
        low, high = int(pdf["low"].iat[0]), int(pdf["high"].iat[0])
        pdf = pdf.sort_values("node", ignore_index=True)
        a = pdf[pdf["own"] == low].reset_index(drop=True)
        b = a if low == high else pdf[pdf["own"] == high].reset_index(drop=True)
        if not len(a) or not len(b):
            return pd.DataFrame({"a": [], "b": [], "edge": [], "links": [], "rows_linked": []}).astype({"edge": "bool"})
        ma, mb = (np.stack([np.frombuffer(v, dtype=np.uint32) for v in x["minhash"]]) for x in (a, b))
        da, db = _arrays(a["difference"]), _arrays(b["difference"])
        (na, ca, sa, ga), (nb, cb, sb, gb) = ([x[c].to_numpy() for c in ("node", "copies", "size", "gone")] for x in (a, b))
        base, edges = int(a["base"].iat[0]), []
        links, rows = {0: np.zeros(len(a), np.int64), 1: np.zeros(len(b), np.int64)}, {0: np.zeros(len(a), np.int64), 1: np.zeros(len(b), np.int64)}
        strip = max(1, PAIRS // len(b))
        for at in range(0, len(a), strip):
            i, j = (x.ravel() for x in np.meshgrid(np.arange(at, min(at + strip, len(a))), np.arange(len(b)), indexing="ij"))
            if low == high:
                i, j = i[i < j], j[i < j]
            i, j = survivors(ma, mb, i, j, least)
            if not len(i):
                continue
            common = base - ga[i] - gb[j] + intersections(da, db, i, j)
            ok = common >= threshold * (sa[i] + sb[j] - common) - 1e-9
            i, j = i[ok], j[ok]
            for side, own, copies in ((0, i, cb[j]), (1, j, ca[i])):
                np.add.at(links[side], own, 1)
                np.add.at(rows[side], own, copies)
            kept = _forest(na[i], nb[j])
            edges.append(np.column_stack((na[i][kept], nb[j][kept])))
        edges = np.concatenate(edges) if edges else np.empty((0, 2), np.int64)
        edges = edges[_forest(edges[:, 0], edges[:, 1])]
        spans = pd.DataFrame({"a": edges[:, 0], "b": edges[:, 1], "edge": True, "links": 0, "rows_linked": 0})
        counts = pd.DataFrame({"a": np.concatenate([na, nb]), "links": np.concatenate([links[0], links[1]]), "rows_linked": np.concatenate([rows[0], rows[1]])})
        counts = counts[counts["links"] > 0].groupby("a", as_index=False).sum()
        out = pd.concat([spans, counts.assign(b=counts["a"], edge=False)], ignore_index=True)
        return out.astype({"a": "int64", "b": "int64", "edge": "bool", "links": "int64", "rows_linked": "int64"})

    columns = ["crowd", *task, "own", "node", "copies", "minhash", "difference", "size", "gone", "base"]
    return dealt.select(*columns).groupBy("crowd", "low", "high").applyInPandas(run, _COUNTED)


def _candidates(crowds: DataFrame, buckets: DataFrame) -> DataFrame:
    """Pairs (a < b) that share a bucket but not a crowd, and all pairs of small crowds."""
    several = buckets.groupBy("bucket").agg(F.min("crowd").alias("lo"), F.max("crowd").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi")
    # a large bucket is cut into parts; two parts meet in a key of their own, and no more than BUCKET_PART nodes of either
    parts = F.ceil(F.col("n") / BUCKET_PART).cast("long")
    rows = buckets.join(several.select("bucket", parts.alias("parts")), "bucket").withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    across = rows.select("bucket", "own", "other", F.col("node").alias("a"), F.col("crowd").alias("ca")).join(
        rows.select("bucket", F.col("other").alias("own"), F.col("own").alias("other"), F.col("node").alias("b"), F.col("crowd").alias("cb")), ["bucket", "own", "other"]
    )
    small = crowds.where(f"crowd_size between 2 and {SMALL_CROWD}")
    within = small.select("crowd", F.col("node").alias("a")).join(small.select("crowd", F.col("node").alias("b")), "crowd")
    return across.where("a < b and ca != cb").select("a", "b").unionByName(within.where("a < b").select("a", "b")).distinct()


def _pruned(pairs: DataFrame, classes: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    def prune(batches):
        least = least_agreement(threshold, tolerance)
        for pdf in batches:
            if len(pdf):
                ma, mb = (np.stack([np.frombuffer(v, dtype=np.uint32) for v in pdf[c]]) for c in ("ma", "mb"))
                i, _ = survivors(ma, mb, np.arange(len(pdf)), np.arange(len(pdf)), least)
                yield pdf.iloc[i][["a", "b"]]

    ma = classes.select(F.col("node").alias("a"), F.col("minhash").alias("ma"))
    mb = classes.select(F.col("node").alias("b"), F.col("minhash").alias("mb"))
    return pairs.join(ma, "a").join(mb, "b").mapInPandas(prune, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs of at least the threshold's similarity, with both sides' numbers of copies."""

    def verify(batches):
        for pdf in batches:
            one = np.array([0])
            keep = [similar([x], [y], one, one, threshold)[0] for x, y in zip(_arrays(pdf["sa"]), _arrays(pdf["sb"]), strict=True)]
            yield pdf.loc[np.array(keep, dtype=bool), ["a", "b", "na", "nb"]]

    sa, sb = (
        sets.select(F.col("node").alias(c), F.col("copies").alias(f"n{c}"), F.col("shingles").alias(f"s{c}")) for c in ("a", "b")
    )
    return pairs.join(sa, "a").join(sb, "b").mapInPandas(verify, "a long, b long, na long, nb long")


def jaccard_join(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: float = 0.8, tolerance: float = 1e-6
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, class_id, n_links, n_copies, set_id``.

    Words are runs of anything but ASCII white space, unchanged; two texts are
    linked if the Jaccard similarity of their sets of ``k`` words in a row is
    at least ``threshold`` (a text of fewer words has one shingle, all of
    them).  ``set_id`` is the smallest id among rows of the same set and
    ``n_copies`` their number; ``n_links`` counts the other rows that the row
    is linked to, copies and near copies; ``class_id`` is the smallest id
    reachable over links.  A text without words (null too) is linked to
    nothing.  A null id is never the smallest of several.  Repeated rows count as copies
    of each other.  An empty table gives an empty result; other columns are ignored.
    Very long texts are taken whole.
    """
    rows = stored(_signatures(docs, id_col, text_col, k), "near-sets")
    wordless = rows.where("set_key is null").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"),
        F.lit(1).cast("long").alias("n_copies"), F.col("doc_id").alias("set_id"),
    )
    keyed = rows.where("set_key is not null")
    classes = stored(
        keyed.groupBy("set_key")
        .agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("set_id"), F.max("minhash").alias("minhash"))
        .select("set_key", F.monotonically_increasing_id().alias("node"), "copies", "set_id", "minhash"),  # written once, so they stay
        "near-classes",
    )

    banded = stored(_banded(classes), "near-bands")
    shared = banded.groupBy("bucket").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = stored(banded.join(shared, "bucket").select("bucket", "node", "lead"), "near-met")
    near = met.groupBy("node").agg(F.min("lead").alias("lead"))
    # One hop further, or members of a large group that miss its first bucket would be in crowds of their own.
    hop = met.select("bucket", "node").join(near, "node").groupBy("bucket").agg(F.min("lead").alias("lead"))
    lead = met.select("bucket", "node").join(hop, "bucket").groupBy("node").agg(F.min("lead").alias("crowd"))
    sized = lead.groupBy("crowd").agg(F.count(F.lit(1)).alias("crowd_size"))
    crowds = stored(lead.join(sized, "crowd"), "near-crowds")
    buckets = met.select("bucket", "node").join(crowds.select("node", "crowd"), "node")

    pairs = stored(_pruned(_candidates(crowds, buckets), classes, threshold, tolerance), "near-pairs")
    large = crowds.where(f"crowd_size > {SMALL_CROWD}")
    needed = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(large.select("node")).distinct()
    wanted = classes.join(needed, "node").select(F.col("set_id").alias("first"), "set_key", "node", "copies", "minhash")
    sets = stored(_shingle_sets(docs, id_col, text_col, k, wanted), "near-shingles")
    inside = stored(_within_crowds(large.join(sets, "node"), threshold, tolerance), "near-inside")
    across = stored(_verified(pairs, sets, threshold), "near-across")

    edges = inside.where("edge").select("a", "b").unionByName(across.select("a", "b"))
    joined = components(edges)
    counts = (
        inside.where("not edge").select(F.col("a").alias("node"), "rows_linked")
        .unionByName(across.select(F.col("a").alias("node"), F.col("nb").alias("rows_linked")))
        .unionByName(across.select(F.col("b").alias("node"), F.col("na").alias("rows_linked")))
        .groupBy("node").agg(F.sum("rows_linked").alias("rows_linked"))
    )
    labelled = (
        classes.select("set_key", "set_id", "copies", "node")
        .join(joined, "node", "left")
        .join(counts, "node", "left")
        .withColumn("root", F.coalesce("component", "node"))
    )
    least = labelled.groupBy("root").agg(F.min("set_id").alias("class_id"))
    described = labelled.join(least, "root").select(
        "set_key", "class_id", "set_id", (F.coalesce("rows_linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies")
    )
    return (
        keyed.select("doc_id", "set_key")
        .join(described, "set_key")
        .select("doc_id", "class_id", "n_links", "n_copies", "set_id")
        .unionByName(wordless)
    )


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
  UNION SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 4
), c AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g WHERE x.doc_id <> y.doc_id GROUP BY 1, 2
), l AS (
  SELECT p.a, p.b, k = ca.n AND k = cb.n AS same FROM p JOIN c ca ON ca.doc_id = p.a JOIN c cb ON cb.doc_id = p.b
  WHERE k >= 0.8 * (ca.n + cb.n - k) - 1e-9
), r(doc_id, root) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id
), g AS (
  SELECT doc_id, min(root) AS class_id FROM r GROUP BY doc_id
), n AS (
  SELECT a AS doc_id, count(*) AS n_links, count(*) FILTER (WHERE same) AS others, min(b) FILTER (WHERE same) AS first_b FROM l GROUP BY a
)
SELECT g.doc_id, class_id, coalesce(n_links, 0) AS n_links, coalesce(others, 0) + 1 AS n_copies,
  least(g.doc_id, coalesce(first_b, g.doc_id)) AS set_id
FROM g LEFT JOIN n ON n.doc_id = g.doc_id
"""
