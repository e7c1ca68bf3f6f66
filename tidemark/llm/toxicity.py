"""Toxicity scores from a lexicon trie, Levenshtein automata and context windows.

The lexicon holds stems: word beginnings, and short words as a whole, that are far
commoner in texts labelled toxic.  It is kept as a trie, and each word that may match is run through the
intersection of the trie with the word's Levenshtein automaton, which finds the
stems within one edit of some beginning of the word.  A window of words around
each match tells quotation from abuse.  A logistic model over the matches of a
text, exact and misspelled, quoted and not, gives its score.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from tidemark.llm.common import carrying, crc_mod, labelled
from tidemark.llm.jaccard_join import N_HASHES, minhash, shingle_set
from tidemark.llm.kernel import NOT_ALNUM, lowered, pieces, span_hashes, word_spans

WINDOW = 8
FUZZY_FROM = 5  # shorter stems must match exactly
_CACHE = 200_000
_TERM = StructType([StructField("stem", StringType()), StructField("edits", IntegerType()), StructField("quoted", BooleanType()), StructField("times", LongType())])
_ADDED = StructType([StructField("score", DoubleType()), StructField("predicted", IntegerType()), StructField("terms", ArrayType(_TERM))])
SIGN = np.array([0x21 <= c < 0x7F and not chr(c).isalnum() for c in range(256)])

# Words that report speech, and words that address somebody.
REPORTING = frozenset(
    b"said says wrote writes quote quoted quotes called calls according claimed reported stated cited "
    b"dijo escribio cita sagte schrieb zitat dit ecrit citation".split()
)
ADDRESSING = frozenset(b"you your youre du dich ihr tu vous te usted".split())


def folded(blob: np.ndarray) -> np.ndarray:
    """A-Z and the capitals from A-grave to Thorn in lower case; double quotation marks of all kinds as ASCII ones."""
    out = lowered(blob)
    after = np.flatnonzero(out[:-1] == 0xC3) + 1
    capital = after[(out[after] >= 0x80) & (out[after] <= 0x9E) & (out[after] != 0x97)]
    out[capital] += 0x20
    two = np.flatnonzero((out[:-1] == 0xC2) & ((out[1:] == 0xAB) | (out[1:] == 0xBB)))
    out[two], out[two + 1] = 0x22, 0x20
    three = np.flatnonzero((out[:-2] == 0xE2) & (out[1:-1] == 0x80) & (out[2:] >= 0x9C) & (out[2:] <= 0x9F))
    out[three], out[three + 1], out[three + 2] = 0x22, 0x20, 0x20
    return out


#: Ends a stem that only a whole word matches; no word contains it.
WHOLE = "\n"


class Lexicon:
    """Stems in a trie; a filter on bytes that no word passes over which is within one edit of a stem."""

    def __init__(self, stems: list[str]):
        self.stems = stems
        self.trie: dict = {}
        for number, stem in enumerate(stems):
            node = self.trie
            for c in stem:
                node = node.setdefault(c, {})
            node[""] = number
        self.heads2, self.heads3 = np.zeros(1 << 16, bool), np.zeros(1 << 16, bool)
        self.tails: dict[int, np.ndarray] = {}
        for stem in stems:
            data = stem.removesuffix(WHOLE).encode()
            fuzzy = len(stem) >= FUZZY_FROM
            # An edit behind the head leaves the head; one in it leaves the tail, which begins where the head's last character has ended.
            head, tail = 3, max(len(data) // 2, self._end(data, 2))
            if fuzzy and len(data) - tail < 3 or len(data) < 3:
                head, tail = 2, max(len(data) // 2, self._end(data, 1))
            if head == 2:
                self.heads2[self._pair(*data[:2])] = True
            else:
                self.heads3[self._triple(*data[:3])] = True
            if fuzzy:
                for at in range(max(0, tail - 4), tail + 5):  # an edit before moves the tail by up to the four bytes of a character
                    self.tails.setdefault(at, np.zeros(1 << 16, bool))[self._triple(*data[tail : tail + 3])] = True

        self.seen: dict[bytes, tuple[int, int] | None] = {}

    @staticmethod
    def _end(data: bytes, at: int) -> int:
        """Where the UTF-8 character over a byte ends."""
        at += 1
        while at < len(data) and data[at] & 0xC0 == 0x80:
            at += 1
        return at

    @staticmethod
    def _pair(a, b):
        return a << 8 | b

    @staticmethod
    def _triple(a, b, c):
        return (a * 961 + b * 31 + c) & 0xFFFF

    def possible(self, blob: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which words may match; all others surely do not."""
        size = ends - starts
        pad = np.concatenate((blob, np.zeros(16, np.uint8))).astype(np.int64)
        at = lambda k: pad[starts + k]
        out = (size >= 2) & self.heads2[self._pair(at(0), at(1))]
        out |= (size >= 3) & self.heads3[self._triple(at(0), at(1), at(2))]
        for k, table in self.tails.items():
            here = np.flatnonzero(~out & (size >= k + 3))
            s = starts[here] + k
            out[here] = table[self._triple(pad[s], pad[s + 1], pad[s + 2])]
        return out

    @staticmethod
    def _walk(node: dict, text: str, at: int) -> int | None:
        """The stem at which the exact path of text[at:] from a node arrives, if any; stems are leaves."""
        while True:
            if "" in node:
                return node[""]
            if at >= len(text):
                return None
            node = node.get(text[at])
            if node is None:
                return None
            at += 1

    def match(self, word: bytes) -> tuple[int, int] | None:
        """(stem, edits) of the best stem within one edit of a beginning of the word: fewest edits, then longest."""
        if word in self.seen:
            return self.seen[word]
        if len(self.seen) >= _CACHE:
            self.seen.clear()
        text = word.decode("utf-8", "replace") + WHOLE
        exact = self._walk(self.trie, text, 0)
        if exact is not None:
            best = (0, exact)
        else:
            # The automaton's states with no edit yet are one path; each may take one edit, and then walks on exactly.
            ends, node = [], self.trie
            for i in range(len(text) + 1):
                ends.append(self._walk(node, text, i + 1))  # a character too many
                for c, child in node.items():
                    if c != "":
                        ends.append(self._walk(child, text, i))  # one missing
                        if i < len(text):
                            ends.append(self._walk(child, text, i + 1))  # another in its place
                node = node.get(text[i]) if i < len(text) else None
                if node is None:
                    break
            ranks = [(-len(self.stems[e]), e) for e in ends if e is not None and len(self.stems[e]) >= FUZZY_FROM]
            best = (1, min(ranks)[1]) if ranks else None
        found = self.seen[word] = (best[1], best[0]) if best else None
        return found

    def matches(self, blob: np.ndarray, begins: np.ndarray):
        """For each match in a folded blob: (text, stem, edits, quoted).

        Two words with one ASCII sign between them, of which neither matches, are also tried as one word with the sign in it.
        """
        starts, ends = word_spans(blob, NOT_ALNUM)
        if not self.stems or not len(starts):
            return
        data = blob.tobytes()
        quote = np.concatenate(([0], np.cumsum(blob == 0x22)))
        line_ends = np.flatnonzero(blob == 10)
        owner = None
        held = {}  # of a match's first word: last word, match
        for w in np.flatnonzero(self.possible(blob, starts, ends)).tolist():
            found = self.match(data[starts[w] : ends[w]])
            if found is not None:
                held[w] = w, found
        masked = np.flatnonzero((starts[1:] - ends[:-1] == 1) & SIGN[blob[ends[:-1]]])
        taken = set(held)
        for w in masked[self.possible(blob, starts[masked], ends[masked + 1])].tolist():
            found = self.match(data[starts[w] : ends[w + 1]]) if w not in taken and w + 1 not in taken else None
            if found is not None:
                held[w] = w + 1, found
                taken |= {w, w + 1}
        for w, (last, found) in sorted(held.items()):
            if owner is None:
                owner = np.searchsorted(begins, starts, "right") - 1
            k = int(np.searchsorted(line_ends, starts[w]))
            line = int(line_ends[k - 1]) + 1 if k else 0
            before, after = quote[starts[w]] - quote[line], quote[line_ends[k]] - quote[ends[last]]
            low, high = max(0, w - WINDOW), min(len(starts), last + WINDOW + 1)
            near = [data[starts[x] : ends[x]] for x in range(low, high) if owner[x] == owner[w]]
            close = [data[starts[x] : ends[x]] for x in range(max(0, w - 3), min(len(starts), last + 4)) if owner[x] == owner[w]]
            context = (before % 2 == 1 and after >= 1) + 0.5 * any(x in REPORTING for x in near) - 0.5 * any(x in ADDRESSING for x in close)
            yield int(owner[w]), found[0], found[1], context >= 0.75


NEAR = 0.8  # agreement of MinHash values from which labelled texts count as copies


def _first_of_copies(sketches: np.ndarray) -> np.ndarray:
    """Which rows agree with no row before them, that is kept, on NEAR of their MinHash values; rows with all values at their top are no copies."""
    kept, seen = np.ones(len(sketches), bool), {}
    for k, row in enumerate(sketches):
        if (row == 0xFFFFFFFF).all():
            continue
        bands = [(b, row[4 * b : 4 * b + 4].tobytes()) for b in range(N_HASHES // 4)]
        near = {other for band in bands for other in seen.get(band, ())}
        if any((sketches[other] == row).mean() >= NEAR for other in near):
            kept[k] = False
        else:
            for band in bands:
                seen.setdefault(band, []).append(k)
    return kept


def distinct_texts(sample: DataFrame) -> DataFrame:
    """The rows (doc_id, text, y) of a bounded sample without near copies of the same label, that of the smallest id staying.

    MinHash values of word shingles, half a kilobyte a row, are compared on the driver.
    """

    def sketch(batches):
        for batch in batches:
            for rows, blob, begins in pieces(batch, "text"):
                starts, ends = word_spans(blob)
                words, bound = span_hashes(blob, starts, ends), np.searchsorted(starts, begins)
                values = [minhash(shingle_set(words[a:b], 5)).tobytes() for a, b in zip(bound[:-1], bound[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[rows], batch.column("y")[rows], pa.array(values, pa.binary())], names=["doc_id", "y", "values"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    rows = sample.select("doc_id", "y", "text").mapInArrow(sketch, f"doc_id {kind}, y int, values binary").toPandas().sort_values(["y", "doc_id"], ignore_index=True)
    copies = []
    for _, part in rows.groupby("y"):
        values = np.stack([np.frombuffer(v, dtype=np.uint32) for v in part["values"]])
        copies += part["doc_id"][~_first_of_copies(values)].tolist()
    if not copies:
        return sample
    gone = sample.sparkSession.createDataFrame([(c,) for c in copies], f"doc_id {kind}")
    return sample.join(F.broadcast(gone), "doc_id", "left_anti")


def learn_lexicon(sample: DataFrame, *, lengths: tuple[int, int] = (4, 12), support: int = 6, precision: float = 0.6) -> Lexicon:
    """All stems of labelled texts (doc_id, text, y) with the support and precision, most telling first, none of which begins with another.

    A stem is a word beginning of ``lengths`` characters or a whole word of two or three.  Its support are the toxic texts,
    and its precision their share in all texts, that hold a word of it; near copies count once.
    """

    def count(batches):
        total = {0: Counter(), 1: Counter()}
        for batch in batches:
            labels = batch.column("y").to_pylist()
            for rows, blob, begins in pieces(batch, "text"):
                blob = folded(blob)
                data = blob.tobytes()
                starts, ends = word_spans(blob, NOT_ALNUM)
                bound = np.searchsorted(starts, begins)
                starts, ends = starts.tolist(), ends.tolist()
                for d, y in enumerate(labels[rows]):
                    total[y].update({data[starts[w] : ends[w]] for w in range(bound[d], bound[d + 1])})
        words = sorted(set(total[0]) | set(total[1]))
        yield pa.RecordBatch.from_pydict(
            {"word": [w.decode("utf-8", "replace") for w in words], "clean": [total[0][w] for w in words], "toxic": [total[1][w] for w in words]},
            schema=pa.schema([("word", pa.string()), ("clean", pa.int64()), ("toxic", pa.int64())]),
        )

    texts = distinct_texts(sample)
    words = texts.select("y", "text").mapInArrow(count, "word string, clean long, toxic long")
    words = words.groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    prefix = F.explode(F.sequence(F.lit(lengths[0]), F.least(F.length("word"), F.lit(lengths[1])))).alias("k")
    long = words.where(F.length("word") >= lengths[0]).select(F.expr("struct(word, clean, toxic)").alias("w"), prefix).select(F.expr("left(w.word, k)").alias("stem"), "w.clean", "w.toxic")
    short = words.where(F.length("word").between(2, lengths[0] - 1)).select(F.concat("word", F.lit(WHOLE)).alias("stem"), "clean", "toxic")
    stems = (
        long.unionByName(short)
        .groupBy("stem")
        .agg(F.sum("clean").alias("n"), F.sum("toxic").alias("t"))
        .where((F.col("t") >= support) & (F.col("t") >= precision * (F.col("t") + F.col("n"))))
    )
    rate = texts.agg(F.avg("y")).first()[0] or 0.5
    rate = min(max(rate, 1e-3), 1 - 1e-3)
    t, n = F.col("t"), F.col("n")
    gain = t * F.log(t / (t + n) / rate) + F.when(n > 0, n * F.log(n / (t + n) / (1 - rate))).otherwise(0)
    ranked = stems.withColumn("gain", gain).orderBy(F.desc("gain"), F.desc(F.length("stem")), "stem").select("stem").collect()  # as bounded as the sample
    kept, beginnings = set(), set()
    chosen: list[str] = []
    for (stem,) in ranked:
        own = {stem[:k] for k in range(1, len(stem))}
        if stem not in beginnings and not own & kept:
            chosen.append(stem)
            kept.add(stem)
            beginnings |= own
    return Lexicon(chosen)


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    exact: np.ndarray  # evidence of each stem
    fuzzy: np.ndarray  # evidence of its misspellings
    weights: np.ndarray = field(default_factory=lambda: np.zeros(7))

    def features(self, found: dict[tuple[int, int, bool], int], words: int) -> np.ndarray:
        """Of the numbers of one text's (stem, edits, quoted)."""
        sums = np.zeros((2, 2))
        for (stem, edits, quoted), times in found.items():
            sums[int(edits > 0), int(quoted)] += times * (self.fuzzy if edits else self.exact)[stem]
        sums = np.log1p(np.maximum(sums, 0))
        dense = np.log1p(100 * sums[0, 0] / max(words, 1))
        return np.array([1.0, float(sums[0, 0] > 0), sums[0, 0], dense, sums[1, 0], sums[0, 1], sums[1, 1]])

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


#: What a model believes before it sees labels: unquoted abuse tells, misspelled less, quoted hardly.
_PRIOR = np.array([-3.0, 1.0, 1.0, 0.3, 1.2, 0.1, 0.05])


def _matched(batches, text_col: str, lexicon: Lexicon):
    """(batch, rows, how often each (stem, edits, quoted) matches in each text, words of each text)."""
    for batch in batches:
        for rows, blob, begins in pieces(batch, text_col):
            blob = folded(blob)
            found: list[Counter] = [Counter() for _ in range(len(begins) - 1)]
            for d, stem, edits, quoted in lexicon.matches(blob, begins):
                found[d][stem, edits, bool(quoted)] += 1
            starts, _ = word_spans(blob, NOT_ALNUM)
            yield batch, rows, found, np.diff(np.searchsorted(starts, begins))


def train(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    trainable: Column | None = None, max_train_rows: int = 20000,
) -> ToxicityModel:
    """Lexicon, evidence and weights from at most ``max_train_rows`` labels, chosen as ``labelled`` says; one text and label an id.

    Further columns of either table are ignored, whatever they are called; very
    long texts are taken whole, empty and null ones match nothing.  Without
    labels there are no stems and every score is low.
    """
    sample = labelled(docs, labels, id_col, text_col, label_col, trainable, max_train_rows)
    lexicon = learn_lexicon(sample)

    def run(batches):
        for batch, rows, found, words in _matched(batches, "text", lexicon):
            flat = [[part for match, times in sorted(text.items()) for part in (match[0], match[1], int(match[2]), times)] for text in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("y")[rows], pa.array(words.astype(np.int64)), pa.array(flat, pa.list_(pa.int32()))], names=["y", "words", "found"]
            )

    rows = sample.select("y", "text").mapInArrow(run, "y int, words long, found array<int>").toPandas()
    rows = rows.assign(key=[tuple(f) for f in rows["found"]]).sort_values(["y", "words", "key"], ignore_index=True)  # the order in which tasks end must not matter
    y = rows["y"].to_numpy(dtype=float)
    texts = [{(int(f[k]), int(f[k + 1]), bool(f[k + 2])): int(f[k + 3]) for k in range(0, len(f), 4)} for f in rows["found"]]
    n, rate = len(lexicon.stems), float(np.clip(y.mean() if len(y) else 0.1, 1e-3, 0.999))
    count = np.zeros((2, 2, n))  # edits, label, stem
    for label, text in zip(y, texts, strict=True):
        for stem, edits in {(s, e) for s, e, _ in text}:
            count[edits, int(label), stem] += 1
    odds = np.log((count[:, 1] + 1) / (count[:, 0] + 1)) - np.log(rate / (1 - rate)) if n else np.zeros((2, 0))
    unseen = count[1].sum(axis=0) < 3 if n else np.zeros(0, bool)
    fuzzy = np.where(unseen, 0.5 * odds[0], np.minimum(odds[1] - 1, odds[0]))  # a misspelling never tells more
    model = ToxicityModel(lexicon, np.maximum(odds[0], 0), np.where(fuzzy > 0.5, fuzzy, 0))
    x = np.array([model.features(t, w) for t, w in zip(texts, rows["words"], strict=True)]).reshape(-1, len(_PRIOR))
    model.weights = _PRIOR.copy()
    if 0 < y.sum() < len(y):
        ridge = np.diag([1e-3, 1, 1, 1, 1, 4, 4])
        for _ in range(30):  # Newton steps towards labels and prior
            p = model.score(x)
            slope = x.T @ (y - p) - ridge @ (model.weights - _PRIOR)
            model.weights = model.weights + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, slope)
    return model


def score(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.3) -> DataFrame:
    """The columns ``keep`` of every row with ``score`` (probability of label 1), ``predicted`` and ``terms``.

    ``terms`` lists the matched stems with their edits, whether they are
    quoted, and how often.  Null and empty texts match nothing.  Each row is scored by itself:
    repeated rows, null ids and further columns pass; empty tables stay empty.
    ``keep`` may not name the columns that are added.
    """
    term = pa.struct([("stem", pa.string()), ("edits", pa.int32()), ("quoted", pa.bool_()), ("times", pa.int64())])

    def run(batches):
        stems = model.lexicon.stems
        for batch, rows, found, words in _matched(batches, "text", model.lexicon):
            p = model.score(np.array([model.features(f, w) for f, w in zip(found, words, strict=True)]))
            terms = [[{"stem": stems[s].removesuffix(WHOLE), "edits": e, "quoted": q, "times": n} for (s, e, q), n in sorted(f.items())] for f in found]
            added = [pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(terms, pa.list_(term))]
            yield pa.RecordBatch.from_arrays([batch.column("kept")[rows], *added], names=["kept", *_ADDED.names])

    return carrying(docs, text_col, keep, run, _ADDED)


def toxicity_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns: learned from the rows whose id hash mod 4 is not 2."""
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    model = train(docs, labels, trainable=~held_out)
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
