"""The pipeline against plain Python, and its contract."""

import hashlib
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import SF, brute_exact, brute_links, reference_encoding
from tidemark.llm import queries


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, SF)
        assert out.columns == docs.columns and out.count() == 0


def test_pipeline_matches_plain_python(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    good = {r.doc_id for r in queries.QUERIES["op5_quality_gam"](spark, SF).where("predicted = 1").collect()}
    docs = [d for d in docs if d[0] in good]
    kept = {r[0] for r in brute_exact(docs) if r[3]}
    docs = [d for d in docs if d[0] in kept]
    first = {r[0] for r in brute_links(docs) if r[0] == r[1]}
    docs = [d for d in docs if d[0] in first]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = [d for d in docs if not any(t in (d[1] or "") for t in items)]
    own = reference_encoding()
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = sorted((i, len(e := own.encode_ordinary(t or "")), sha(" ".join(map(str, e)).encode()), sha((t or "").encode())) for i, t in docs)
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want


def test_near_stage_drops_copies_of_repeated_and_null_ids(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text, "en", "s", 1), (2, text + " x", "en", "s", 1), (None, "alone in the world of words", "en", "s", 1), (None, None, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {(r.doc_id, r.text) for r in corpus_pipeline.near_stage(spark, docs, SF).collect()} == {rows[0][:2], rows[2][:2], rows[3][:2]}


def test_stages_keep_columns_that_clash(spark):
    text = " ".join(f"w{k}" for k in range(60))
    names = ["score", "predicted", "leaks", "_text", "_sha256", "row", "doc_key", "first", "key", "digest", "missing", "my col", "lang-code", "a.b", "kept", "ti`ck"]
    rows = [(1, text, "en", "s", 9), (1, text + " x", "en", "s", 9), (2, text, "en", "s", 9), (2, text, "en", "s", 9), (None, None, None, None, None), (None, "", "en", "s", 0)]
    docs = spark.createDataFrame([(*r, *range(len(names))) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n.replace('`', '``')}` int" for n in names))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        kept[name] = out.collect()
        assert all(tuple(r)[5:] == tuple(range(len(names))) for r in kept[name])
    assert sorted((r.doc_id or 0, r.text or "") for r in kept["exact_dedup"]) == [(0, ""), (1, text), (1, text + " x")]
    assert len([r for r in kept["ngram_jaccard"] if r.doc_id == 1]) == 1 and len(kept["decontaminate"]) == len(rows)
    assert corpus_pipeline.token_stage(spark, docs, SF).count() == len(rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for table in os.listdir(SF):
        con.execute(f"CREATE VIEW {table[:-8]} AS SELECT * FROM '{SF}/{table}'")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, SF).select(*[F.col(c) for c in want.columns])
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want.fetchall()))
