"""Queries: retrieval over a text corpus, and checks of narrative text."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import retrieval
from tidemark.plans.registry import query
from tidemark.sources.market import table

_TOKEN = r"[\x{4e00}-\x{9fff}]|(?:[^\P{L}\x{4e00}-\x{9fff}]|[\p{M}\p{N}]){2,}"
_WORDS = f"w AS (SELECT * FROM (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '{_TOKEN}')) AS term FROM documents) WHERE NOT contains('{retrieval.STOPWORDS}', term))"
_QUERY = ("the", "idiot", "of", "license", "été")
_TERMS = "('" + "', '".join(_QUERY) + "')"


@query("k01_tokenize", f"WITH {_WORDS} SELECT doc_id, count(*) AS n, count(DISTINCT term) AS distinct_n FROM w GROUP BY doc_id")
def k01(spark, sf):
    terms = retrieval.tokens(table(spark, sf, "documents"))
    return terms.groupBy("doc_id").agg(F.sum("tf").alias("n"), F.count(F.lit(1)).alias("distinct_n"))


_BM25 = f"""WITH {_WORDS}, tf AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY 1, 2), dl AS (SELECT doc_id, count(*) AS dl FROM w GROUP BY 1), n AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
df AS (SELECT term, count(*) AS df FROM tf WHERE term IN {_TERMS} GROUP BY 1),
s AS (SELECT tf.doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN df USING (term) JOIN dl USING (doc_id) CROSS JOIN n GROUP BY 1)"""


def _index(spark, sf):
    return retrieval.TermIndex.kept(table(spark, sf, "documents").select("doc_id", "text"))


@query("k02_bm25", f"{_BM25} SELECT doc_id, round(score, 6) AS score FROM s")
def k02(spark, sf):
    return _index(spark, sf).bm25(list(_QUERY)).select("doc_id", F.round("score", 6).alias("score"))


_FACTORS = ("license", "idiot", "été")
_NAMED = "('" + "', '".join(_FACTORS) + "')"


@query("k03_final_score", f"""{_BM25}, a AS (SELECT source, avg(quality) AS authority FROM documents JOIN labels USING (doc_id) GROUP BY 1), f AS (SELECT doc_id, count(*) AS hits FROM tf WHERE term IN {_NAMED} GROUP BY 1)
SELECT d.doc_id, round((0.4 * score + 1.5 * (CASE WHEN lang = 'en' THEN 1 ELSE 0 END + CASE WHEN source = 'src1' THEN 1 ELSE 0 END) + 3.0 * coalesce(hits, 0)) * greatest(coalesce(authority, 0), 0.1), 6) AS score FROM s JOIN documents d USING (doc_id) LEFT JOIN a USING (source) LEFT JOIN f USING (doc_id)""")
def k03(spark, sf):
    """Topics are an entry's language and source, factors the words it names, authority the mean quality label of its source."""
    d, index = table(spark, sf, "documents").select("doc_id", "lang", "source"), _index(spark, sf)
    authority = table(spark, sf, "labels").join(d, "doc_id").groupBy("source").agg(F.avg("quality").alias("authority"))
    factors = index.postings.where(F.col("term").isin(*_FACTORS)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("factor_hits"))
    s = index.bm25(list(_QUERY)).join(d, "doc_id").join(authority, "source", "left").join(factors, "doc_id", "left")
    topics = F.size(F.array_intersect(F.array("lang", "source"), F.array(F.lit("en"), F.lit("src1"))))
    score = retrieval.final_score(F.col("score"), topics, F.coalesce("factor_hits", F.lit(0)), F.coalesce("authority", F.lit(0.0)))
    return s.select("doc_id", F.round(score, 6).alias("score"))


@query("k04_top_k_by_stance", f"{_BM25} SELECT doc_id, lang, rk FROM (SELECT s.doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY round(score, 6) DESC, s.doc_id) AS rk FROM s JOIN documents d USING (doc_id)) WHERE rk <= 5")
def k04(spark, sf):
    s = _index(spark, sf).bm25(list(_QUERY)).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    rk = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc(F.round("score", 6)), "doc_id"))
    return s.select("doc_id", "lang", rk.cast("long").alias("rk")).where("rk <= 5")


@query("k06_corpus_stats", "SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1, 2")
def k06(spark, sf):
    return table(spark, sf, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


# Fixed values of the guard of this query: what is never said, what a status must allow, what a status must add.
_FORBIDDEN = ("guarantee", "idiot")
_CONDITIONAL = {"license": ("SUPPORTED",), "copyright": ("SUPPORTED", "EXPLORATORY")}
_DISCLAIMERS = {"EXPLORATORY": ("all rights", "license"), "NOT_RUN": ("license",)}
_SAYS = lambda words: "(" + " OR ".join(f"contains(low, '{w}')" for w in words) + ")"
_NOT_ALLOWED = " OR ".join(f"({_SAYS([w])} AND status NOT IN ({', '.join(repr(x) for x in ok)}))" for w, ok in _CONDITIONAL.items())
_MISSING = "CASE " + " ".join(f"WHEN status = '{k}' THEN NOT {_SAYS(ws)}" for k, ws in _DISCLAIMERS.items()) + " ELSE false END"


@query("k07_narrative_guard", f"""WITH e AS (SELECT doc_id, lower(coalesce(text, '')) AS low, CASE WHEN quality = 1 THEN 'SUPPORTED' WHEN quality = 0 THEN 'EXPLORATORY' ELSE 'NOT_RUN' END AS status,
list_transform(regexp_extract_all(coalesce(text, ''), '([0-9]+(?:[.][0-9]+)?)%', 1), lambda x: x::DOUBLE) AS told, [n_chars / 10.0, n_chars % 100, coalesce(toxic, 0) * 100.0] AS evidence FROM documents LEFT JOIN labels USING (doc_id))
SELECT doc_id, status, {_SAYS(_FORBIDDEN)} AS forbidden, {_NOT_ALLOWED} AS conditional, {_MISSING} AS missing_disclaimer,
len(list_filter(told, lambda x: x <> 0 AND len(list_filter(evidence, lambda a: abs(a - x) <= 1.0 OR (a <> 0 AND abs(a - x) <= 0.05 * abs(a)))) = 0))::BIGINT AS unfounded FROM e""")
def k07(spark, sf):
    """Phrases never allowed, phrases that the status does not allow, missing disclaimers, and percentages that no evidence bears out within a point or a twentieth."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    low = F.lower(F.coalesce("text", F.lit("")))
    has = lambda words: F.greatest(*[low.contains(w) for w in words], F.lit(False))
    status = F.when(F.col("quality") == 1, "SUPPORTED").when(F.col("quality") == 0, "EXPLORATORY").otherwise("NOT_RUN")
    conditional = F.lit(False)
    for word, allowed in _CONDITIONAL.items():
        conditional = conditional | (low.contains(word) & ~status.isin(*allowed))
    missing = F.when(F.lit(False), True)
    for name, words in _DISCLAIMERS.items():
        missing = missing.when(status == name, ~has(words))
    told = F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([0-9]+(?:[.][0-9]+)?)%"), F.lit(1)), lambda x: x.cast("double"))
    evidence = F.array(F.col("n_chars") / 10.0, (F.col("n_chars") % 100).cast("double"), F.coalesce("toxic", F.lit(0)) * 100.0)
    borne = lambda x: F.exists(evidence, lambda a: (F.abs(a - x) <= 1.0) | ((a != 0) & (F.abs(a - x) <= 0.05 * F.abs(a))))
    return d.select(
        "doc_id", status.alias("status"), has(_FORBIDDEN).alias("forbidden"), conditional.alias("conditional"), missing.otherwise(False).alias("missing_disclaimer"),
        F.size(F.filter(told, lambda x: (x != 0) & ~borne(x))).cast("long").alias("unfounded"),
    )
