"""Each text operator against brute force on small tables with nulls, empties, long texts, ties and repeats."""

import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tidemark.llm import (
    bpe,
    decontaminate,
    exact_dedup,
    exchange,
    graph,
    jaccard_join,
    kernel,
    lm_score,
    quality,
    queries,
    substring_dedup,
    token_counts,
    toxicity,
    warc,
)

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, key long, chunk string, score string, leaks string"  # names that operators use too
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(seed, n, pool=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(pool)}" for _ in range(n)]


THUE_MORSE = "".join("ab"[k.bit_count() % 2] for k in range(1024))
OPPOSITE = THUE_MORSE.translate(str.maketrans("ab", "ba"))
FRAME = words_of(7, 49, 10**6)
PASSAGE = " ".join(words_of(1, 70, 10**6))
LONG = " ".join(words_of(2, 20000, 10**6))
TEXTS = [
    (1, "a b  c"), (2, "a b c"), (2, "a b c"), (3, None), (4, ""), (5, " "), (None, "a b c"), (None, None), (6, LONG), (7, LONG + " x"),
    (8, f"Start one. {PASSAGE} End"), (9, f"other {PASSAGE}"), (10, f"{PASSAGE} {PASSAGE}"), (11, "é ü 🙂   x"), (12, "A\tB\nC a b"),
    (13, PASSAGE + " tail"), (13, "same id, other text"), (14, "\x00 nul \x01"),
    (15, " ".join([THUE_MORSE, *FRAME])), (16, " ".join([OPPOSITE, *FRAME])),  # equal under any polynomial hash modulo a power of two
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", 1, "c", "s", "l") for i, t in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def null_last(x):
    return (x is None, x)


def test_kernel_words_match_the_pattern():
    for text in [t or "" for _, t in TEXTS] + ["x", " x ", "\x0b\x0c"]:
        blob = np.frombuffer(text.encode() + b"\n", dtype=np.uint8)
        got = [bytes(blob[a:b]).decode() for a, b in zip(*kernel.word_spans(blob), strict=True)]
        assert got == WORD.findall(text)


def test_packed_exchange_round_trip():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 2**63, 500, dtype=np.uint64) << np.uint64(1))
    for width in (4, 5, 7, 8):
        short = np.unique(exchange.shortened(keys, 8, width))
        at = exchange.cuts(short, 8, width)
        assert at[0] == 0 and at[-1] == len(short)
        part = short[at[3] : at[4]]
        low = exchange._unpacked(exchange._packed(part, width))
        assert (low == part & np.uint64(2 ** (8 * width) - 1)).all()
    assert exchange._unpacked(exchange._packed(keys[:1], 8)) == keys[:1]
    for places, n in (([0, 1, 2], 3), ([5], 1000), (list(range(0, 100, 2)), 100), ([], 9)):
        assert exchange._as_places(exchange._places(np.array(places, dtype=np.int64), n), n).tolist() == places


# 1


def test_warc_round_trip(spark):
    pages = [(1, "http://A.example.com/x", "p"), (2, "https://a.example.com/x#f", "p"), (3, None, None), (4, "u", ""), (4, "u", ""), (None, "v", "q"), (5, "w", "é" * 50000), (6, "http://b.org:8080/?a=1", "p\r\n\r\nq")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("d")).withColumn("offset", F.lit(1))
    kept = warc.archive(df, warc.scratch(spark, "t"), block_lines=2)
    keys = df.select(warc.url_key(F.col("url")).alias("url_key")).distinct()
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in kept.records(keys).collect()), key=lambda r: (null_last(r[0]), r[1]))
    lead = {}
    for i, _, h in pages:
        lead[h or ""] = max(lead.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in pages:
        data, top = (h or "").encode(), lead[h or ""]
        revisit = top >= 0 and i != top
        want.append((i, len(data), warc.payload_digest(data), "revisit" if revisit else "response", top if revisit else None))
    assert got == sorted(want, key=lambda r: (null_last(r[0]), r[1]))
    assert {r["page_id"] for r in kept.lookup(["http://a.example.com/x"])} == {1, 2}
    assert [r["payload"] for r in kept.lookup(["http://b.org:8080/?a=1"])] == [b"p\r\n\r\nq"]
    assert kept.lookup(["http://nowhere.net/"]) == []
    assert kept.directory.count() > 1


def test_a_common_key_fills_blocks_of_several_parts(spark):
    pages = [(k, "http://hot.org/" if k % 3 else f"http://h{k}.org/", f"page {k % 50}") for k in range(600)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)
    kept = warc.archive(df, warc.scratch(spark, "t"), block_lines=7)
    hot = spark.createDataFrame([("org,hot)/",), ("org,h",), ("zz",)], "url_key string")
    assert kept.directory.where("first_key <= 'org,hot)/' and last_key >= 'org,hot)/'").select("part").distinct().count() > 1
    assert sorted(r.page_id for r in kept.records(hot).collect()) == [k for k in range(600) if k % 3]
    assert sorted(r.page_id for r in warc.round_trip(spark, df).collect()) == list(range(600))


def test_parts_of_the_index_are_as_many_as_their_lines_need(spark, monkeypatch):
    monkeypatch.setattr(warc, "PART_LINES", 40)
    pages = [(k, "http://hot.org/" if k % 3 == 0 else f"http://h{k % 211}.org/", f"page {k}") for k in range(900)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)
    kept = warc.archive(df, warc.scratch(spark, "t"), block_lines=7)
    sizes = [r[0] for r in kept.directory.groupBy("part").agg(F.sum("lines")).select("sum(lines)").collect()]
    assert sum(sizes) == 900 and len(sizes) >= 20 and max(sizes) <= 2 * 40
    assert sorted(r.page_id for r in warc.round_trip(spark, df).collect()) == list(range(900))


def test_warc_of_nothing(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(spark, df).count() == 0


def test_url_keys(spark):
    urls = ["http://www.Example.com:80/a?b#c", "https://x.y:8443", None]
    keys = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(warc.url_key(F.col("u"))).collect()]
    assert keys == ["com,example,www)/a?b", "y,x:8443)/", ")/"]


def test_a_record_is_a_gzip_member():
    data = gzip.compress(warc.warc_record("http://x/", 3, b"body", None))
    assert warc.parse_record(gzip.decompress(data))["payload"] == b"body"
    broken = warc.warc_record("http://x/", 3, b"body", None).replace(b"body", b"bodx")
    with pytest.raises(ValueError):
        warc.parse_record(broken)


# 2


def brute_links(rows, k=5, threshold=0.8):
    sets = []
    for _, t in rows:
        w = WORD.findall(t or "")
        sets.append(frozenset(tuple(w[j : j + min(k, len(w))]) for j in range(max(1, len(w) - k + 1))) if w else frozenset())
    parent, links = list(range(len(rows))), [0] * len(rows)

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                parent[max(top(a), top(b))] = min(top(a), top(b))
    groups = {}
    for k2 in range(len(rows)):
        groups.setdefault(top(k2), []).append(rows[k2][0])
    least = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    return sorted(((rows[k2][0], least[top(k2)], links[k2]) for k2 in range(len(rows))), key=lambda r: tuple(map(null_last, r)))


def got_links(df):
    return sorted(((r.doc_id, r.class_id, r.n_links) for r in df.collect()), key=lambda r: tuple(map(null_last, r)))


def test_jaccard_join_is_exact(spark, docs):
    assert got_links(jaccard_join.jaccard_join(docs)) == brute_links(TEXTS)


@pytest.mark.parametrize(("unit", "most", "pairs"), [(512 << 10, 32 << 20, 700), (5_000, 20_000, 1 << 19)])
def test_jaccard_join_in_a_crowd(spark, monkeypatch, unit, most, pairs):
    for name, value in (("UNIT_BYTES", unit), ("MAX_BLOCK_BYTES", most), ("PAIRS", pairs)):
        monkeypatch.setattr(jaccard_join, name, value)
    rng = random.Random(3)
    base, rows = words_of(4, 120, 10**6), []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows + rows[:3], "doc_id long, text string")
    assert got_links(jaccard_join.jaccard_join(df)) == brute_links(rows + rows[:3])


def test_pairs_of_a_large_bucket_meet_once_each_in_keys_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BUCKET_PART", 5)
    monkeypatch.setattr(jaccard_join, "SMALL_CROWD", 0)
    nodes = [(k, k % 4) for k in range(60)]
    buckets = spark.createDataFrame([("hot", n, c) for n, c in nodes] + [("one", n, 0) for n in range(3)] + [("two", 1, 1), ("two", 2, 2)], "bucket string, node long, crowd long")
    crowds = spark.createDataFrame([(n, c, 15) for n, c in nodes], "node long, crowd long, crowd_size long")
    got = sorted(map(tuple, jaccard_join._candidates(crowds, buckets).collect()))
    assert got == sorted((a, b) for a, x in nodes for b, y in nodes if a < b and x != y)


def test_jaccard_join_in_parts_of_buckets(spark, docs, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BUCKET_PART", 1)
    assert got_links(jaccard_join.jaccard_join(docs)) == brute_links(TEXTS)


def test_differences_give_intersections():
    rng = np.random.default_rng(5)
    base, one, two = (np.unique(rng.integers(0, 60, 40)).astype(np.uint64) for _ in range(3))
    (a, gone_a), (b, gone_b) = jaccard_join.differences(one, base), jaccard_join.differences(two, base)
    assert len(base) - gone_a - gone_b + len(np.intersect1d(a, b)) == len(np.intersect1d(one, two))


def test_jaccard_join_of_nothing(nothing):
    assert jaccard_join.jaccard_join(nothing).count() == 0


def test_posterior_bound_is_a_beta_tail():
    least = jaccard_join.least_agreement(0.8, 1e-6)
    s = np.linspace(0, 1, 200001)
    for step, m in enumerate(least):
        n = (step + 1) * jaccard_join.STEP
        tail = lambda m: float(((s**m * (1 - s) ** (n - m))[s >= 0.8]).sum() / (s**m * (1 - s) ** (n - m)).sum())  # noqa: B023, E731
        assert tail(m) >= 0.9e-6 and (m == 0 or tail(m - 1) <= 1.1e-6)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1060)]
    parent = {x: x for e in edges for x in e}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(top(a), top(b))] = min(top(a), top(b))
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for a, b in edges if a != b for x in (a, b)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 3


def test_token_counts_of_documents(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    got = token_counts.count_documents(docs, token_counts_folder(spark), lambda: bpe.encoder(path, public_tokenizers.PATTERN).encode, end=50256, file_bytes=3000)
    own = reference_encoding()
    want = sorted(((i, len(own.encode_ordinary(t or ""))) for i, t in TEXTS), key=lambda r: (null_last(r[0]), r[1]))
    assert sorted(((r.doc_id, r.n_tokens) for r in got.collect()), key=lambda r: (null_last(r[0]), r[1])) == want


def token_counts_folder(spark):
    return warc.scratch(spark, "tokens")


def test_separator_scan_across_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_counts, "GROUP", 3)
    rng, files, want = np.random.default_rng(1), [], {}
    for k, share in enumerate((0.0, 0.001, 0.01, 0.3, 0.9)):
        x = rng.integers(1, 40, int(rng.integers(1, 4000))).astype("<u2")
        x[rng.random(len(x)) < share] = 0
        x.tofile(tmp_path / str(k))
        files.append((str(tmp_path / str(k)), 2 * len(x)))
        counts = token_counts.block_counts(x, 0)
        want |= {(files[-1][0], i): int(n) for i, n in enumerate(counts if counts[-1] else counts[:-1])}
    df = spark.createDataFrame([*files, files[0], (None, 4), ("empty", 0)], "file string, n_bytes long")
    got = {(r.file, r.ordinal): r.n_tokens for r in token_counts.token_counts(spark, df, end=0, block_tokens=64).collect()}
    assert got == want
    assert token_counts.token_counts(spark, df.limit(0), end=0).count() == 0


# 4


def tokens_of(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return [(i, [*WORD.findall((t or "").translate(low)), "</s>"]) for i, t in rows]


def backoff_automaton(learned, s, t):
    """States (histories as tuples) with arcs {word: (target, weight)} and failure arcs, from texts as token lists; plain Python."""
    one, two, three = Counter(), Counter(), Counter()
    for w in learned:
        run = ["<s>", *w]
        one.update(w)
        two.update(zip(run, w, strict=False))
        three.update(zip(run, w, w[1:], strict=False))
    total, known = sum(one.values()), len(one)
    base = lambda w: (one[w] + 0.5) / (total + 0.5 * (known + 1))
    arcs, failure = {(): {}}, {}
    held = {("<s>",): len(learned)} | {(w,): c for w, c in one.items() if w != "</s>"} | {p: c for p, c in two.items() if p[1] != "</s>"}
    for h, c in held.items():
        k = s if len(h) == 1 else t
        arcs[h], failure[h] = {}, (h[1:] if h[1:] in held else (), math.log10(k / (c + k)))
    p2 = lambda h, w: (two[h, w] + s * base(w)) / (held[h,] + s)
    after = lambda h, w: (h, w) if w != "</s>" else ()
    for w in one:
        arcs[()][w] = ((w,) if w != "</s>" else (), math.log10(base(w)))
    for (h, w), _ in two.items():
        arcs[h,][w] = (after(h, w), math.log10(p2(h, w)))
    for (g, h, w), c in three.items():
        arcs[g, h][w] = (after(h, w), math.log10((c + t * p2(h, w)) / (two[g, h] + t)))
    return arcs, failure, math.log10(base("")), one


def walked(model, words):
    arcs, failure, unknown, _ = model
    state, total = ("<s>",) if ("<s>",) in arcs else (), 0.0
    for w in words:
        while state and w not in arcs[state]:
            state, cost = failure[state]
            total += cost
        state, weight = arcs[state].get(w, ((), unknown))
        total += weight
    return total


def test_lm_scores_match_a_walk_on_an_explicit_automaton(spark, docs):
    trains = F.coalesce(F.col("doc_id"), F.lit(0)) % 3 != 1
    got = lm_score.lm_score(docs, trains=trains, strengths=(20.0, 2.0)).collect()
    token = tokens_of(TEXTS)
    learned = [w for i, w in token if (i or 0) % 3 != 1]
    model = backoff_automaton(learned, 20, 2)
    one = model[3]
    total, known = sum(one.values()), len(one)
    want = []
    for i, w in token:
        base = sum(math.log10((one[x] + 0.5) / (total + 0.5 * (known + 1))) for x in w)
        want.append((i, len(w), sum(one[x] > 0 for x in w), total, round(base, 6), round(walked(model, w), 6)))
    have = [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got]
    assert sorted(have, key=lambda r: tuple(map(null_last, r))) == sorted(want, key=lambda r: tuple(map(null_last, r)))


def test_lm_chunks_and_salted_reducers_agree(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, " ".join(words_of(rng.randrange(6), rng.randrange(1, 40), 12))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    model = backoff_automaton([w for i, w in tokens_of(rows) if i % 2], 300, 3)
    want = {i: pytest.approx(walked(model, w)) for i, w in tokens_of(rows)}
    monkeypatch.setattr(lm_score, "CHUNK_BYTES", 200)
    for limit in (1 << 16, 3):
        monkeypatch.setattr(exchange, "ROWS_PER_TASK", limit)
        assert {r.doc_id: r.score for r in lm_score.lm_score(df, trains=F.col("doc_id") % 2 == 1).collect()} == want


def test_lm_without_training_rows_or_rows(spark, docs, nothing):
    assert {r.score for r in lm_score.lm_score(docs, trains=F.lit(False)).collect()} == {0.0}
    assert lm_score.lm_score(nothing).count() == 0


def test_lm_states_sum_to_one(spark):
    learned = [(1, "a b a c a b"), (2, "b a"), (3, "a b c")]
    words = ["a", "b", "c", "zzz"]  # all unknown words are one
    both = spark.createDataFrame(learned, "doc_id long, text string").withColumn("t", F.lit(True))
    for history in ("", "a", "b", "a b", "b a", "c zzz"):
        texts = [f"{history} {w}" for w in words] + [history]
        probe = spark.createDataFrame(list(enumerate(texts, 10)), "doc_id long, text string").withColumn("t", F.lit(False))
        scores = {r.doc_id: r.score for r in lm_score.lm_score(both.unionByName(probe), trains=F.col("t"), strengths=(3.0, 1.0)).collect()}
        model = backoff_automaton([w for _, w in tokens_of(learned)], 3, 1)
        prefix = walked(model, history.split())
        # what the state after the history gives to each word, less what the end gives after that word; and what it gives to the end
        ends = [walked(model, [*history.split(), w, "</s>"]) - walked(model, [*history.split(), w]) for w in words]
        total = sum(10 ** (scores[10 + k] - ends[k] - prefix) for k in range(len(words))) + 10 ** (scores[10 + len(words)] - prefix)
        assert total == pytest.approx(1.0)


# 5


def test_quality_learns_and_scores_every_row(spark, docs, nothing):
    rng = random.Random(2)
    good = [(100 + k, " ".join(words_of(k, 60))) for k in range(80)]
    bad = [(300 + k, " ".join(rng.choice(["XX!!", "YY!!"]) for _ in range(60))) for k in range(80)]
    rows = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 300)) for i, _ in good + bad] + [(None, 1), (100, 1)], "doc_id long, quality int")
    model = quality.train(rows, labels)
    got = {r.doc_id: r.predicted for r in quality.score(rows, model).collect()}
    assert got == {i: int(i < 300) for i, _ in good + bad}
    scored = quality.score(docs, model, keep=("doc_id", "key")).collect()
    assert len(scored) == len(TEXTS) and all(0 <= r.score <= 1 for r in scored)
    assert quality.score(nothing, model).count() == 0


def plain_features(text):
    """FEATURES in plain Python, from their names' meanings."""
    raw, kinds = text.encode(), [(quality._CLASS[c]) for c in text.encode()]
    words, spans = [], []
    for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw):
        words.append(m[0])
        spans.append(m.span())
    if not words and not raw:
        return [0.0] * len(quality.FEATURES)
    n, some = len(words), max(len(words), 1)
    sizes = [len(w) for w in words]
    mean = sum(sizes) / some
    count = Counter(words)
    marks = lambda ks: sum(all(quality._CLASS[c] in ks for c in w) for w in words) / some
    caps = sum(sum(quality._CLASS[c] == 2 for c in w) >= 2 and not any(quality._CLASS[c] == 1 for c in w) for w in words)
    ended = sum(quality._CLASS[w[-1]] == 5 or (len(w) > 2 and w.endswith(b"!!")) for w in words)
    lines = [x for x in raw.split(b"\n") if x]
    share = [kinds.count(k) / max(len(raw), 1) for k in (2, 3, 4, 5, 6)]
    return [
        math.log1p(n), mean, math.sqrt(max(sum(x * x for x in sizes) / some - mean**2, 0)), sum(x <= 3 for x in sizes) / some, len(count) / some,
        max(count.values(), default=0) / some, sum(a == b for a, b in zip(words, words[1:], strict=False)) / some,
        len(set(zip(words, words[1:], strict=False))) / max(n - 1, 1), caps / some, ended / some, *share,
        math.log1p(n / max(len(lines), 1)), (len(lines) - len(set(lines))) / max(len(lines), 1), sum(quality._CLASS[w[0]] == 1 for w in words) / some,
        marks({5}), sum(w[-1:] in (b".", b"?") for w in words) / some,
    ]


def test_quality_features_and_scores_match_plain_python():
    rng = random.Random(11)
    pieces = ["The", "cat", "sat.", "WHY?", "no!!", "a", "a", "##", "é", "12", "\n", "\n", "x\ty", "end", "Été.", "", "same line\n", "same line\n"]
    texts = ["", " ", "one", *[" ".join(rng.choice(pieces) for _ in range(rng.randrange(60))) for _ in range(80)], LONG]
    blob, begins = kernel.blob_of(*kernel.text_bytes(quality.pa.array(texts)))
    got = quality.text_features(blob, begins)
    assert np.allclose(got, [plain_features(t) for t in texts], atol=1e-4)
    y = np.array([rng.random() < 1 / (1 + math.exp(-6 * (x[4] - 0.6))) for x in got], dtype=float)
    x = got.astype(np.float64)
    model = quality.fit(x, y, bins=8, rounds=40, pair_rounds=10)
    plain = []
    for row in x:
        bins = [sum(v >= e for e in edges) for v, edges in zip(row, model.edges, strict=True)]
        total = model.bias + sum(t[b] for t, b in zip(model.tables, bins, strict=True))
        total += sum(t[bins[i] // 4, bins[j] // 4] for (i, j), t in zip(model.pairs, model.pair_tables, strict=True))
        plain.append(1 / (1 + math.exp(-total)))
    assert np.allclose(model.score(x), plain)
    loss = lambda m: -np.mean(np.log(np.where(y == 1, m.score(x), 1 - m.score(x))))
    fewer = quality.fit(x, y, bins=8, rounds=5, pair_rounds=0)
    assert loss(model) < loss(fewer) < loss(quality.fit(x, y, bins=8, rounds=0, pair_rounds=0))


def test_a_boosted_tree_takes_the_best_cuts():
    rng = np.random.default_rng(3)
    g, h = rng.normal(size=9), rng.uniform(2, 5, 9)
    gain = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + 2)
    first = max(range(1, 9), key=lambda c: gain(0, c) + gain(c, 9))
    second = max((c for c in range(1, 9) if c != first), key=lambda c: sum(gain(a, b) for a, b in zip([0, *sorted((first, c))], [*sorted((first, c)), 9], strict=True)))
    cuts, want = [0, *sorted((first, second)), 9], np.zeros(9)
    for a, b in zip(cuts, cuts[1:], strict=False):
        want[a:b] = g[a:b].sum() / (h[a:b].sum() + 2)
    assert np.allclose(quality._shallow_tree(g, h, 2.0), want)


def test_training_takes_clashing_repeated_and_odd_rows(spark):
    good, bad = [" ".join(words_of(k, 50)) for k in range(40)], [" ".join(["XX!!", "YY!!"] * (k + 5)) for k in range(40)]
    rows = [(k, t, "a", 1) for k, t in enumerate(good + bad)] + [(3, None, "b", 2), (None, "x", "c", 3), (5, LONG, "d", 4), (5, LONG, "d", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, y string, quality int")
    labels = spark.createDataFrame([(k, int(k < 40), int(k % 3 == 0), "t") for k in range(80)] + [(7, 0, 1, "t"), (None, 1, 1, "t"), (9, 5, 1, "t")], "doc_id long, quality int, toxic int, text string")
    one = quality.train(df, labels)
    two = quality.train(df.repartition(7), labels.repartition(5))
    assert one.bias == two.bias and all((a == b).all() for a, b in zip(one.tables, two.tables, strict=True))
    first, second = toxicity.train(df, labels), toxicity.train(df.repartition(7), labels.repartition(5))
    assert first.lexicon.stems == second.lexicon.stems and (first.weights == second.weights).all()
    for bad_name in ("score", "predicted"):
        with pytest.raises(ValueError):
            quality.score(df.withColumn(bad_name, F.lit(1)), one, keep=(bad_name,))
        with pytest.raises(ValueError):
            toxicity.score(df.withColumn(bad_name, F.lit(1)), first, keep=(bad_name,))
    assert quality.score(df, one, keep=("text", "y")).columns == ["text", "y", "score", "predicted"]


def test_quality_without_labels(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.score(docs, quality.train(docs, labels)).collect()} == {0.5}


def test_quality_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = queries.QUERIES["op5_quality_gam"](spark, SF).join(labels, "doc_id").where("held_out")
    assert out.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] >= 0.8


# 6


def brute_exact(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    out = []
    for (i, _), n in zip(rows, norm, strict=True):
        ids = [j for (j, _), m in zip(rows, norm, strict=True) if m == n]
        keep = min((j for j in ids if j is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=lambda r: tuple(map(null_last, r)))


@pytest.mark.parametrize("capacity", [1, 4096])
def test_exact_dedup(docs, nothing, capacity):
    got = exact_dedup.exact_dedup(docs, bucket_capacity=capacity)
    assert sorted((tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")) for r in got.collect()), key=lambda r: tuple(map(null_last, r))) == brute_exact(TEXTS)
    assert exact_dedup.exact_dedup(nothing).count() == 0


def test_directory_splits_overfull_buckets(spark):
    entries = spark.range(2000).select(F.xxhash64("id").alias("key"))
    directory = exact_dedup.bucket_directory(entries, 50, 10)
    held = entries.withColumn("leaf", F.shiftrightunsigned("key", 54)).join(directory, "leaf").groupBy("bucket", "local_depth").count()
    assert held.agg(F.max("count")).first()[0] <= 50 and held.agg(F.sum("count")).first()[0] == 2000
    assert held.agg(F.min("local_depth")).first()[0] >= 4


def test_owners_hold_ranges_of_whole_buckets(spark):
    keys = spark.range(3000).select(F.xxhash64(F.col("id") % 2000).alias("key"))
    index = exact_dedup.build_index(keys, 50)
    assert index.count() == 2000 and index.agg(F.sum("rows")).first()[0] == 3000
    assert index.groupBy("bucket").agg(F.countDistinct("owner").alias("n"), F.count("*").alias("held")).where("n > 1 or held > 50").count() == 0
    ranges = [tuple(r) for r in index.groupBy("owner").agg(F.min("bucket"), F.max("bucket")).orderBy("owner").select("min(bucket)", "max(bucket)").collect()]
    assert len(ranges) > 1 and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:], strict=False))


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_keep_once_leaves_one_row_a_text(spark, docs, nothing, monkeypatch, most):
    monkeypatch.setattr(exact_dedup, "MAX_BROADCAST_KEYS", most)
    kept = exact_dedup.keep_once(docs)
    assert kept.columns == docs.columns
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    least = {}
    for i, t in TEXTS:
        least[norm(t)] = min(least.get(norm(t), (True, 0)), (i is None, i or 0))
    assert sorted((norm(r.text), r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted((n, *i) for n, i in least.items())
    assert exact_dedup.keep_once(nothing).count() == 0
    clashing = spark.createDataFrame([(1, "a b", 1, 2, 3), (2, "a  b", 4, 5, 6)], "doc_id long, text string, row int, _sha256 int, norm int")
    assert [tuple(r) for r in exact_dedup.keep_once(clashing).collect()] == [(1, "a b", 1, 2, 3)]


# 7

ITEMS = [(1, "What is the colour of the seventh stone in the river bed? It is deep violet with bands."), (2, " ".join(words_of(9, 30, 10**6))), (3, None), (4, ""), (None, "One two three four five six seven. Eight nine ten eleven twelve thirteen.")]


def test_decontamination_finds_items_in_any_place(spark, nothing):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = [
        (1, f"{LONG} {ITEMS[0][1]} {LONG}"), (2, ITEMS[1][1].upper()), (3, "What is the colour of the seventh stone in the river bed? Nobody knows."), (4, "the of in it is"),
        (5, None), (6, ""), (None, ITEMS[4][1]), (7, f"x {ITEMS[0][1]} y {ITEMS[1][1]}"), (7, "clean"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaked_pairs(df, bench).collect()}
    assert got == {(1, 1), (2, 2), (None, None), (7, 1), (7, 2)}
    apart = {(r.doc_id, r.item_id) for r in decontaminate.leaked_pairs(df, bench, max_items=1).collect()}
    assert apart == got
    assert decontaminate.leaked_pairs(nothing, bench).count() == 0
    assert decontaminate.leaked_pairs(df, bench.limit(0)).count() == 0
    assert decontaminate.find_leaks(df, bench, keep=("doc_id", "text")).count() == len(rows)


def plain_words(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def brute_leaks(rows, items, share=0.5, overlap=0.6):
    """Every item against every passage of its class, in plain Python."""
    items = [(i, t, w) for i, t in items if (w := plain_words(t))]
    n, mean = len(items), sum(len(w) for _, _, w in items) / len(items)
    df = Counter(t for _, _, w in items for t in set(w))
    out = {}
    for number, (i, t, w) in enumerate(items):
        tf = Counter(w)
        weight = {x: math.log1p((n - df[x] + 0.5) / (df[x] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(w) / mean)) for x, c in tf.items()}
        whole, stride = sum(weight.values()), max(16, 1 << (len(w) - 1).bit_length())
        ends = [m.end() for m in re.finditer(r"[.?!]\s+", t.rstrip())]
        parts = [plain_words(t[: ends[-1]]), plain_words(t[ends[-1] :])] if ends else [[], []]
        if not all(parts):
            cut = len(w) - max(1, len(w) // 4)
            parts = [w[:cut], w[cut:]]
        runs = lambda x, k: {tuple(x[j : j + k]) for j in range(len(x) - k + 1)}
        for d, (doc, text) in enumerate(rows):
            words = plain_words(text)
            for p in range(max(1, -(-len(words) // stride) - 1)):
                passage = words[p * stride : (p + 2) * stride]
                score = sum(v for x, v in weight.items() if x in set(passage)) / (share * whole)
                if score < 1 - 1e-9:
                    continue
                shares = []
                for part in parts:
                    own = runs(part, min(5, len(part))) if part else set()
                    shares.append(len(own & runs(passage, min(5, len(part)))) / len(own) if own else 1.0)
                if min(shares) >= overlap:
                    out[d, number] = max(out.get((d, number), ()), (score, *shares))
    return sorted((rows[d][0], items[k][0], *(round(x, 9) for x in v)) for (d, k), v in out.items())


def got_leaks(df, bench, **options):
    rows = decontaminate.leaked_pairs(df, bench, **options).collect()
    return sorted((r.doc_id, r.item_id, *(round(x, 9) for x in (r.score, r.question_overlap, r.answer_overlap))) for r in rows)


def test_decontamination_is_exact_in_any_grouping(spark, monkeypatch):
    rng = random.Random(8)
    items = [(k, " ".join(words_of(k, 18 + 3 * k, 60))) for k in range(12)] + [(3, " ".join(words_of(99, 25, 60)))]
    items += [(20, " ".join(words_of(20, 500, 900))), (21, " ".join(words_of(21, 140, 300)) + ". Yes, a b c d e f."), (22, "one two")]
    rows = []
    for k, (_, text) in enumerate(items * 2):
        w = text.split()
        for _ in range(k % 4):  # a few words changed
            w[rng.randrange(len(w))] = "other"
        lead = words_of(k, rng.randrange(700), 60)
        rows.append((k, " ".join([*lead, *w, *words_of(k + 1, rng.randrange(700), 60)])))
    bench, df = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_leaks(rows, items)
    assert len(want) >= len(items)
    for options in ({}, {"max_items": 1}, {"max_items": 5}):
        assert got_leaks(df, bench, **options) == want
    monkeypatch.setattr(decontaminate, "STEP_BYTES", 2000)
    assert got_leaks(df, bench, max_items=2) == want


def test_decontamination_holds_one_index_at_a_time(spark):
    described = decontaminate._described(spark.createDataFrame([(k, f"word{k} a b c") for k in range(40)], "item_id long, text string"))
    uris = decontaminate.write_indexes(described, 0.5, 1, 1 << 20)
    assert len(uris) > 20 and sum(len(decontaminate.read_index(u).items) for u in uris) == 40
    assert len(decontaminate._held) == 1
    plan = decontaminate.find_leaks(spark.createDataFrame([(1, "x")], "doc_id long, text string"), spark.createDataFrame([(k, f"word{k} a b c") for k in range(40)], "item_id long, text string"), max_items=1)
    assert plan._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_block_max_wand_retrieves_what_full_scoring_does():
    rng = random.Random(1)
    items = [(k, " ".join(words_of(k, rng.randint(5, 40), 120))) for k in range(60)]
    index = decontaminate.Index(items, 0.3)
    assert len(index.classes) == 3
    for k in range(200):
        words = np.concatenate([decontaminate.text_words(rng.choice(items)[1])[: rng.randint(1, 40)] for _ in range(2)])
        for numbers, own in index.classes:
            terms = np.flatnonzero(np.isin(own.terms, words))
            full = np.zeros(len(numbers))
            for t in terms:
                full[own.item[own.at[t] : own.at[t + 1]]] += own.impact[own.at[t] : own.at[t + 1]]
            _, blocks, _ = own.bounds(terms, np.zeros(len(terms), dtype=np.int64))
            assert {i for i, _ in own.search(terms, blocks)} == set(np.flatnonzero(full >= 1 - 1e-9))


# 8


def brute_substring(rows, window=50):
    where = {}
    tokens = [WORD.findall(t or "") for _, t in rows]
    rank = [-(2**63) if i is None else i for i, _ in rows]
    for r, w in zip(rank, tokens, strict=True):
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            where[key] = min(where.get(key, r), r)
    out = []
    for (i, _), r, w in zip(rows, rank, tokens, strict=True):
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if where[tuple(w[s : s + window])] < r:
                gone[s : s + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=lambda r: tuple(map(null_last, r)))


def test_substring_dedup(spark, docs, nothing, monkeypatch):
    got = lambda df: sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_dedup(df).collect()), key=lambda r: tuple(map(null_last, r)))
    assert got(docs) == brute_substring(TEXTS)
    rng = random.Random(6)
    shared = [words_of(50 + k, 130, 10**6) for k in range(4)]
    rows = []
    for i in range(40):
        s = shared[rng.randrange(4)]
        a = rng.randrange(40)
        rows.append((i, " ".join(words_of(900 + i, rng.randrange(60)) + s[a : a + rng.randrange(30, 90)] + words_of(i, rng.randrange(60)))))
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute_substring(rows)
    assert substring_dedup.substring_dedup(nothing).count() == 0


# 9


def reference_encoding():
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_is_exact_and_round_trips(spark, docs, nothing):
    path, pattern, own = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, reference_encoding()
    encoder, rng = bpe.Encoder(bpe.read_ranks(path), pattern, cache=50), random.Random(3)
    pool = list(encoder.ranks)
    for text in ["a" * 3000, "<|endoftext|>", "don't I'LL", " " * 300 + "x", "0123456789" * 40, "!?" * 200, "مرحبا 你好" * 20]:
        assert encoder.encode(text) == own.encode_ordinary(text)
    for _ in range(3000):
        text = b"".join(rng.choice(pool) for _ in range(rng.randint(1, 5))).decode("utf-8", "ignore")
        assert encoder.encode(text) == own.encode_ordinary(text)
    encoded = bpe.encode(docs, path, pattern)
    assert sorted((r.ids for r in encoded.collect())) == sorted(own.encode_ordinary(t or "") for _, t in TEXTS)
    assert sorted(bytes(r.bytes) for r in bpe.decode(encoded, path, pattern).collect()) == sorted((t or "").encode() for _, t in TEXTS)
    digest = bpe.round_trip_digests(docs, path, pattern, keep=("key",)).collect()
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = sorted((len(e := own.encode_ordinary(t or "")), sha(" ".join(map(str, e)).encode()), sha((t or "").encode())) for _, t in TEXTS)
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in digest) == want
    assert bpe.round_trip_digests(nothing, path, pattern).count() == 0


# 10


def test_levenshtein_trie_against_plain_distances():
    stems = ["idiot", "trash", "réeux", "scum", "disgust"]
    lexicon = toxicity.Lexicon(stems)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1]

    rng, letters = random.Random(1), "idotrashéuxcmgl"
    for _ in range(4000):
        w = list(rng.choice(stems) + rng.choice(["", "s", "ment", "x"]))
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice([[], [rng.choice(letters)], [w[k], rng.choice(letters)]])
            w = w or ["a"]
        word = "".join(w)
        best = min((min(distance(s, word[:j]) for j in range(len(word) + 1)), -len(s)) for s in stems if len(s) >= 5 or word.startswith(s))
        found = lexicon.match(word.encode())
        assert (found is not None) == (best[0] <= 1), word
        if found:
            assert found[1] == best[0]
            blob = np.frombuffer(word.encode() + b"\n", dtype=np.uint8)
            assert lexicon.possible(blob, *kernel.word_spans(blob, kernel.NOT_ALNUM)).all(), word


def test_quotation_and_misspelling(spark, docs, nothing):
    rng = random.Random(4)
    clean = [(k, " ".join(words_of(k, 40, 5000))) for k in range(200)]
    abuse = [(1000 + k, " ".join([*words_of(k, 20, 5000), rng.choice(["idiot", "moron"]), *words_of(k + 7, 20, 5000)])) for k in range(60)]
    labels = spark.createDataFrame([(i, int(i >= 1000)) for i, _ in clean + abuse] + [(None, 1)], "doc_id long, toxic int")
    model = toxicity.train(spark.createDataFrame(clean + abuse, "doc_id long, text string"), labels)
    assert {"idiot", "moron"} <= set(model.lexicon.stems)
    probe = spark.createDataFrame([(1, "w1 w2 idiot w3 w4"), (2, "w1 w2 idi0t w3"), (3, "he said “w1 idiot w2” w3"), (4, "w1 w2 w3"), (5, ""), (6, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(probe, model).collect()}
    assert got[1].score > got[2].score > got[4].score and got[1].score > got[3].score
    assert got[1].predicted == 1 and {got[k].predicted for k in (3, 4, 5, 6)} == {0}
    assert got[2].terms[0].edits == 1 and got[3].terms[0].quoted
    assert toxicity.score(docs, model, keep=("doc_id", "key")).count() == len(TEXTS)
    assert toxicity.score(nothing, model).count() == 0


def test_toxicity_without_labels(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert model.lexicon.stems == [] and {r.predicted for r in toxicity.score(docs, model).collect()} == {0}


def test_contract_folds(spark):
    rows = {r.doc_id: r for r in queries.QUERIES["op10_toxicity"](spark, SF).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())


def test_lexicon_is_all_that_has_support_and_precision(spark):
    rng = random.Random(13)
    toxic = [[*words_of(k, 25, 300), *rng.choices(["idiot", "idiots", "idiotic", "oaf", "scumbag"], k=2)] for k in range(60)]
    clean = [words_of(1000 + k, 25, 300) + rng.choices(["oafish", "idea", "scum"], k=1) for k in range(150)]
    rows = [(k, " ".join(w), 1) for k, w in enumerate(toxic)] + [(1000 + k, " ".join(w), 0) for k, w in enumerate(clean)]
    copies = [(5000 + k, rows[0][1] + (" x" if k % 2 else ""), 1) for k in range(30)]  # near copies count once
    sample = spark.createDataFrame(rows + copies, "doc_id long, text string, y int")
    assert sorted(r.doc_id for r in toxicity.distinct_texts(sample).collect()) == sorted(r[0] for r in rows)
    n, t = Counter(), Counter()
    for _, text, y in rows:
        for w in set(plain_words(text)):
            for stem in [w[:k] for k in range(4, min(len(w), 12) + 1)] if len(w) >= 4 else [w + toxicity.WHOLE] if len(w) >= 2 else []:
                (t if y else n)[stem] += 1
    rate = len(toxic) / len(rows)
    gain = {x: t[x] * math.log(t[x] / (t[x] + n[x]) / rate) + (n[x] * math.log(n[x] / (t[x] + n[x]) / (1 - rate)) if n[x] else 0) for x in t if t[x] >= 6 and t[x] >= 0.6 * (t[x] + n[x])}
    want = []
    for x in sorted(gain, key=lambda x: (-round(gain[x], 9), -len(x), x)):
        if not any(x.startswith(y) or y.startswith(x) for y in want):
            want.append(x)
    lexicon = toxicity.learn_lexicon(sample)
    assert lexicon.stems == want and "oaf" + toxicity.WHOLE in want
    assert lexicon.match(b"oaf") and not lexicon.match(b"oafish") and not lexicon.match(b"oa")


def test_toxicity_scores_match_plain_python(spark):
    lexicon = toxicity.Lexicon(["idiot", "scum"])
    model = toxicity.ToxicityModel(lexicon, np.array([2.0, 1.0]), np.array([0.7, 0.0]), np.array([-2.0, 0.5, 1.0, 0.3, 1.2, 0.1, 0.05]))
    texts = {1: "you idiot idiots and scum", 2: 'he said "idiot" once', 3: "idi0t", 4: "nothing here", 5: None}
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), model).collect()}
    plain = {1: (5.0, 0, 0, 0, 5), 2: (0, 0, 2.0, 0, 4), 3: (0, 0.7, 0, 0, 1), 4: (0, 0, 0, 0, 2), 5: (0, 0, 0, 0, 0)}  # exact, fuzzy, exact quoted, fuzzy quoted, words
    for k, (exact, fuzzy, quoted, both, words) in plain.items():
        a, b, c, d = (math.log1p(v) for v in (exact, fuzzy, quoted, both))
        x = [1.0, float(a > 0), a, math.log1p(100 * a / max(words, 1)), b, c, d]
        assert got[k].score == pytest.approx(1 / (1 + math.exp(-sum(u * v for u, v in zip(x, model.weights, strict=True)))))
    assert [tuple(t) for t in got[1].terms] == [("idiot", 0, False, 2), ("scum", 0, False, 1)]
