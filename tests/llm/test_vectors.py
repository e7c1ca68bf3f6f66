"""Hard negatives and vector codes against brute force, on small tables with nulls, ties, copies and odd vectors."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from tidemark.llm import hard_negatives, queries, vector_codes

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, label int, embedding array<float>, place string, score string, rank string, code string, vector string, `a.b` string, `my col` string"


def table(spark, rows):
    return spark.createDataFrame([(i, y, v, "p", "s", "r", "c", "v", "x", "y") for i, y, v in rows], SCHEMA).repartition(3)


def some_rows(n=420, width=32, seed=5):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.2) for _ in range(width)] for _ in range(6)]
    rows = []
    for i in range(n):
        c = rng.choice(centres)
        rows.append((i, rng.randrange(4), [x + rng.gauss(0, 0.05) for x in c]))
    for i in (3, 100, 207):  # one vector many times, also as copies of an anchor
        rows += [(1000 + 10 * i + k, rows[i][1] if k % 2 else 9, rows[i][2]) for k in range(12)]
    rows += [rows[0], rows[100], (200, 2, rows[5][2])]  # repeated rows, an id with two rows
    rows += [(None, 1, rows[7][2]), (None, None, rows[8][2]), (500, None, rows[9][2]), (600, 1, None), (700, 1, [None] + [0.0] * (width - 1))]
    rows += [(800, 1, [math.nan] + [0.0] * (width - 1)), (900, 1, [math.inf] * width), (1100, 77, rows[10][2]), (1300, 1, [0.0] * width), (-100, 1, rows[11][2])]
    return rows


def integers(rows):
    return [(i, y, [math.floor(256 * float(np.float32(x))) for x in v]) for i, y, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]


def slow_negatives(rows):
    kept = [(i, (y + 1) % 10 if i is not None and i % 7 == 0 else y, v) for i, y, v in integers(rows) if y is not None]
    first = lambda found: sorted(found, key=lambda f: (-f[0], f[1] is None, f[1] or 0))[:5]
    out = []
    for a, (anchor, label, v) in enumerate(kept):
        if anchor is None or anchor % 100:
            continue
        scores = [(sum(x * y for x, y in zip(v, w, strict=True)), i, y) for r, (i, y, w) in enumerate(kept) if r != a]
        for p, positive, _ in first([s for s in scores if s[2] == label]):
            window = [s for s in scores if s[2] != label and 80 * p <= 100 * s[0] <= 100 * p]
            out += [(anchor, positive, k + 1, negative, p, n) for k, (n, negative, _) in enumerate(first(window))]
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_hard_negatives_are_those_of_brute_force(spark, monkeypatch):
    rows = some_rows()
    df = table(spark, rows)
    assert found(hard_negatives.hard_negatives_query(df)) == slow_negatives(rows)
    monkeypatch.setattr(hard_negatives, "BLOCK_COMPONENTS", 32 * 50)  # many blocks of both kinds
    monkeypatch.setattr(hard_negatives, "BLOCK_ANCHORS", 4)
    monkeypatch.setattr(hard_negatives, "STEP_ROWS", 16)
    monkeypatch.setattr(hard_negatives, "STEP_ANCHORS", 3)
    monkeypatch.setattr(hard_negatives, "STEP_PAIRS", 7)
    assert found(hard_negatives.hard_negatives_query(df)) == slow_negatives(rows)


def test_most_pairs_are_not_scored_exactly(spark, monkeypatch):
    scored, exact = [], hard_negatives._exact
    monkeypatch.setattr(hard_negatives, "_exact", lambda a, v, i, r: (scored.append(len(i)), exact(a, v, i, r))[1])
    rng = np.random.default_rng(3)
    v = rng.normal(0, 32, (4000, 32)).astype(np.int64)
    cells = hard_negatives.Cells.fitted(v.min(0), v.max(0))
    block = hard_negatives.Block(np.arange(4000), np.arange(4000), np.arange(4000) % 10, cells.codes(v), v.astype(np.int32))
    anchors = next(block.steps(40))
    list(hard_negatives.first_positives(anchors, block, cells.tables(), 5))
    assert sum(scored) < 0.05 * 40 * 4000
    low, high = hard_negatives._bounds(anchors.vectors, cells.tables()[0][np.arange(32), block.codes], cells.tables()[1])
    assert ((low <= v[:40] @ v.T) & (v[:40] @ v.T <= high)).all()


def test_hard_negatives_of_little_and_nothing(spark):
    assert found(hard_negatives.hard_negatives_query(table(spark, []))) == []
    assert found(hard_negatives.hard_negatives_query(table(spark, [(0, None, [1.0]), (100, 1, None)]))) == []
    assert found(hard_negatives.hard_negatives_query(table(spark, [(100, 1, [1.0]), (1, 2, [1.0])]))) == []  # no positive
    assert found(hard_negatives.hard_negatives_query(table(spark, [(100, 1, [1.0]), (1, 1, [-1.0]), (2, 2, [-1.0])]))) == []  # empty window
    with pytest.raises(Exception, match="components"):
        found(hard_negatives.hard_negatives_query(table(spark, [(100, 1, [1.0]), (1, 1, [1.0, 2.0])])))
    with pytest.raises(TypeError, match="integral"):
        hard_negatives.hard_negatives(spark.createDataFrame([("a", 1, [1.0])], "vec_id string, label int, embedding array<float>"))


def slow_codes(rows, parts=16, entries=64):
    kept = sorted(integers(rows), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    cut = [[tuple(v[p * len(v) // parts : (p + 1) * len(v) // parts]) for p in range(parts)] for _, _, v in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def assign(p, part):
        return min((sum((x - y) ** 2 for x, y in zip(part, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(2):
        held = [[[] for _ in books[p]] for p in range(parts)]
        for c in cut:
            for p, part in enumerate(c):
                held[p][assign(p, part)[1]].append(part)
        books = [[tuple(sum(x) // len(h) for x in zip(*h, strict=True)) if h else e for e, h in zip(books[p], held[p], strict=True)] for p in range(parts)]
    near = [[assign(p, part) for p, part in enumerate(c)] for c in cut]
    errors = [sum(d for d, _ in n) for n in near]
    by_label = {}
    for (_, y, _), e in zip(kept, errors, strict=True):
        by_label[y] = by_label.get(y, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for _, k in n), e, by_label[y], digest) for (i, y, _), n, e in zip(kept, near, errors, strict=True)), key=repr)


@pytest.mark.parametrize("n", [420, 3])
def test_vector_codes_are_those_of_plain_rounds(spark, n):
    rows = some_rows() if n == 420 else [(3, 1, [0.1] * 32), (1, None, [-0.2] * 32), (1, None, [0.3] * 32)]
    assert found(vector_codes.vector_codes(table(spark, rows))) == slow_codes(rows)


def test_bounds_spare_most_full_scans():
    rng = np.random.default_rng(1)
    parts = rng.normal(0, 40, (3000, 4)).astype(np.int64)
    old = parts[:64].copy()
    code, near, second = vector_codes.full_scan(parts, old)
    new = old + rng.integers(-2, 3, old.shape)
    code2, upper, lower, searched = vector_codes.reassign(parts, code, vector_codes._above(np.sqrt(near)), vector_codes._below(np.sqrt(second)), old, new)
    want, best, after = vector_codes.full_scan(parts, new)
    assert (code2 == want).all() and searched < 1500
    assert (upper.astype(float) >= np.sqrt(best)).all() and (lower.astype(float) <= np.sqrt(after)).all()


def test_vector_codes_of_nothing_and_of_wrong_vectors(spark):
    assert found(vector_codes.vector_codes(table(spark, []))) == []
    assert found(vector_codes.vector_codes(table(spark, [(1, 1, None), (2, 1, [None] * 16)]))) == []
    for rows in ([(1, 1, [1.0] * 15)], [(1, 1, [1.0] * 16), (2, 1, [1.0] * 32)], [(1, 1, [1e30] * 16)]):
        with pytest.raises(Exception, match="components"):
            found(vector_codes.vector_codes(table(spark, rows)))


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_vector_codes"])
def test_queries_give_the_rows_of_their_sql(spark, name):
    sql = queries.ORACLE_SQL[name].replace("FROM embeddings", f"FROM '{SF}/embeddings.parquet'")
    assert found(queries.QUERIES[name](spark, SF)) == sorted(duckdb.sql(sql).fetchall(), key=repr)
