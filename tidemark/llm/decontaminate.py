"""Benchmark decontamination by BM25 search with block-max WAND.

Benchmark items are the indexed collection; every passage of every training
text is a query.  Impacts are divided by their item's threshold, a share of
the score that the item has against itself, so that an item is retrieved when
the impacts of its terms in the passage add up to 1.  Sums of the terms'
largest impacts, first over all items and then by block of items, rule out
almost all passages at once; the rest are searched document at a time with
pivots and block skips.  Retrieved items count only if enough of both their
question and their answer occurs in the passage.
"""

from __future__ import annotations

import pickle
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from tidemark.llm.common import carrying, scratch, stored
from tidemark.llm.files import opened, task_name
from tidemark.llm.kernel import NOT_ALNUM, lowered, pieces, span_hashes, window_hashes, word_spans

K1, B = 1.2, 0.75
ITEMS_PER_BLOCK = 4
GRAM = 5
#: Bytes of text that a task holds while the indexes pass by.
STEP_BYTES = 16 << 20
_SENTENCE_END = re.compile(r"[.?!]\s+")


def text_words(text: str) -> np.ndarray:
    """Hashes of a text's words: runs of letters, digits and non-ASCII characters, A-Z as a-z."""
    blob = lowered(np.frombuffer(text.encode() + b"\n", dtype=np.uint8))
    return span_hashes(blob, *word_spans(blob, NOT_ALNUM))


def grams(words: np.ndarray) -> np.ndarray:
    return np.unique(window_hashes(words, min(GRAM, len(words)))) if len(words) else np.empty(0, np.uint64)


def question_and_answer(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Words before and in the last sentence; of a single sentence, the last quarter is the answer."""
    last = [m.end() for m in _SENTENCE_END.finditer(text.rstrip())]
    if last:
        question, answer = text_words(text[: last[-1]]), text_words(text[last[-1] :])
        if len(question) and len(answer):
            return question, answer
    words = text_words(text)
    cut = len(words) - max(1, len(words) // 4)
    return words[:cut], words[cut:]


@dataclass
class Collection:
    """Statistics of all benchmark items with words: their number, their mean length, and how many hold each term."""

    items: int
    mean_words: float
    frequencies: dict[int, int]


def length_class(words: int) -> int:
    """The stride of an item: the least power of two that is no less than its words, and 16 at least."""
    return max(16, 1 << max(0, words - 1).bit_length())


class Postings:
    """Items of one length class: postings, and the largest impacts of each term, in all and by block of items.

    The class's passages are two strides of words long and begin every stride, so
    an occurrence of an item lies whole in one of them.  Which other items there
    are does not matter to a passage or to an item's score.
    """

    def __init__(self, stride: int, words: list[np.ndarray], share: float, whole: Collection):
        self.stride, n = stride, len(words)
        counted = [np.unique(w, return_counts=True) for w in words]
        item = np.repeat(np.arange(n), [len(t) for t, _ in counted])
        tf = np.concatenate([c for _, c in counted])
        size = np.array([len(w) for w in words], dtype=float)
        self.terms, where, df = np.unique(np.concatenate([t for t, _ in counted]), return_inverse=True, return_counts=True)
        spread = np.array([whole.frequencies[t] for t in self.terms.tolist()], dtype=float)
        idf = np.log1p((whole.items - spread + 0.5) / (spread + 0.5))
        weight = idf[where] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[item] / max(whole.mean_words, 1e-9)))
        impact = weight / (share * np.bincount(item, weight, n)[item])
        order = np.lexsort((item, where))
        self.item, self.impact = item[order], impact[order]
        self.posted = self.item.tolist()
        self.at = np.concatenate(([0], np.cumsum(df)))
        self.largest = np.maximum.reduceat(self.impact, self.at[:-1])
        # largest impacts by block, for the blocks that a term occurs in
        block = self.item // ITEMS_PER_BLOCK
        new = np.flatnonzero(np.concatenate(([True], (block[1:] != block[:-1]) | (where[order][1:] != where[order][:-1]))))
        self.block, self.block_max = block[new], np.maximum.reduceat(self.impact, new)
        self.block_at = np.searchsorted(new, self.at)
        self.n_blocks = -(-n // ITEMS_PER_BLOCK)

    def bounds(self, terms: np.ndarray, passage: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, block, sum of the terms' largest impacts in the block) where that sum reaches 1."""
        size = self.block_at[terms + 1] - self.block_at[terms]
        place = np.repeat(self.block_at[terms] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        key, number = np.unique(np.repeat(passage, size) * self.n_blocks + self.block[place], return_inverse=True)
        total = np.bincount(number, self.block_max[place], len(key))
        key, total = key[total >= 1 - 1e-5], total[total >= 1 - 1e-5]
        return key // self.n_blocks, key % self.n_blocks, total

    def search(self, terms: np.ndarray, blocks: np.ndarray) -> list[tuple[int, float]]:
        """All (item number, score) in ``blocks`` with a score of at least 1: block-max WAND.

        Blocks that ``terms`` cannot fill are left out by the caller; within a
        block the cursors move to pivots, bounded by the block's maxima.
        """
        found, posted = [], self.posted
        ranges = [(int(self.at[t]), int(self.at[t + 1]), int(self.block_at[t]), int(self.block_at[t + 1])) for t in terms]
        for block in blocks.tolist():
            low, high = block * ITEMS_PER_BLOCK, (block + 1) * ITEMS_PER_BLOCK
            cursors = []
            for begin, end, first, last in ranges:
                begin = bisect_left(posted, low, begin, end)
                if begin < end and posted[begin] < high:
                    most = float(self.block_max[first + int(np.searchsorted(self.block[first:last], block))])
                    cursors.append([posted[begin], begin, bisect_left(posted, high, begin, end), most])
            while cursors:
                cursors.sort()
                bound, item = 0.0, None
                for at, _, _, most in cursors:
                    bound += most
                    if bound >= 1 - 1e-5:
                        item = at
                        break
                if item is None:
                    break
                if cursors[0][0] == item:
                    score = sum(float(self.impact[c[1]]) for c in cursors if c[0] == item)
                    if score >= 1 - 1e-9:
                        found.append((item, score))
                    item += 1
                for c in cursors:
                    if c[0] < item:
                        c[1] = bisect_left(posted, item, c[1], c[2])
                        c[0] = posted[c[1]] if c[1] < c[2] else high
                cursors = [c for c in cursors if c[0] < high]
        return found

    def passages(self, words: np.ndarray, bound: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(document, passage's words, its indexed terms, blocks) of the passages that may reach an item of these blocks."""
        if not len(words):
            return
        stride = self.stride
        several = np.maximum(1, -(-np.diff(bound) // stride) - 1)
        first = np.concatenate(([0], np.cumsum(several)))
        place = np.searchsorted(self.terms, words)
        place[place == len(self.terms)] = 0
        hit = np.flatnonzero(self.terms[place] == words)
        if not len(hit):
            return
        owner = np.searchsorted(bound, hit, "right") - 1
        step = (hit - bound[owner]) // stride
        keys = [(first[owner] + s)[ok] * len(self.terms) + place[hit][ok] for s in (step, step - 1) for ok in [(s >= 0) & (s < several[owner])]]
        keys = np.unique(np.concatenate(keys))
        passage, term = keys // len(self.terms), keys % len(self.terms)
        begin = np.flatnonzero(np.concatenate(([True], passage[1:] != passage[:-1])))
        end = np.concatenate((begin[1:], [len(passage)]))
        likely = np.flatnonzero(np.add.reduceat(self.largest[term], begin) >= 1 - 1e-5)
        for few in np.array_split(likely, len(term) // 20_000 + 1):
            if not len(few):
                continue
            chosen = np.concatenate([np.arange(begin[k], end[k]) for k in few])
            row, blocks, _ = self.bounds(term[chosen], np.repeat(np.arange(len(few)), end[few] - begin[few]))
            for r in np.unique(row).tolist():
                k = few[r]
                d = int(np.searchsorted(first, passage[begin[k]], "right")) - 1
                start = bound[d] + (passage[begin[k]] - first[d]) * stride
                yield d, words[start : min(start + 2 * stride, bound[d + 1])], term[begin[k] : end[k]], blocks[row == r]


class Index:
    """A group of items, by length class, and what verification needs of each item."""

    def __init__(self, items: list[tuple[int, str]], share: float, collection: Collection | None = None):
        """``collection`` describes all items of the benchmark, of which these may be a group; by default these are all."""
        kept = [(item, text, words) for item, text in items if len(words := text_words(text or ""))]
        if collection is None:
            frequent = Counter(t for _, _, w in kept for t in np.unique(w).tolist())
            collection = Collection(len(kept), float(np.mean([len(w) for _, _, w in kept])) if kept else 0.0, frequent)
        by_class: dict[int, list[int]] = {}
        self.items, self.parts = [], []
        for number, (item, text, words) in enumerate(kept):
            question, answer = question_and_answer(text)
            self.items.append(item)
            self.parts.append((grams(question), len(question), grams(answer), len(answer)))
            by_class.setdefault(length_class(len(words)), []).append(number)
        self.classes = [(numbers, Postings(stride, [kept[k][2] for k in numbers], share, collection)) for stride, numbers in sorted(by_class.items())]

    def leaks(self, words: np.ndarray, bound: np.ndarray, overlap: float) -> list[tuple[int, int, float, float, float]]:
        """(document, item id, score, question overlap, answer overlap) of verified leaks, the best passage of each."""
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        for numbers, postings in self.classes:
            for d, passage, terms, blocks in postings.passages(words, bound):
                for found, score in postings.search(terms, blocks):
                    item, shares = numbers[found], []
                    for part, size in (self.parts[item][:2], self.parts[item][2:]):
                        have = window_hashes(passage, min(GRAM, size)) if size else part
                        shares.append(float(np.isin(part, have).mean()) if len(part) else 1.0)
                    if min(shares) >= overlap:
                        key = (d, item)
                        best[key] = max(best.get(key, (0.0, 0.0, 0.0)), (score, *shares))
        return [(d, self.items[item], *value) for (d, item), value in sorted(best.items())]


def _described(benchmark: DataFrame) -> DataFrame:
    """(row, item_id, text, n_words, terms, frequencies): items with words; terms ascending, and how many items hold each."""

    def run(batches):
        for batch in batches:
            words = [text_words(t) for t in batch.column("text").to_pylist()]
            terms = [np.unique(w).view(np.int64) for w in words]
            added = [pa.array([len(w) for w in words], pa.int64()), pa.array(terms, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=["item_id", "text", "n_words", "terms"])

    given = benchmark.select(F.col("item_id").cast("long"), "text").where("text is not null")
    read = given.mapInArrow(run, "item_id long, text string, n_words long, terms array<long>").where("n_words > 0")
    items = stored(read.withColumn("row", F.monotonically_increasing_id()), "benchmark-items")
    posted = items.select("row", F.explode("terms").alias("term"))
    frequent = posted.join(posted.groupBy("term").agg(F.count(F.lit(1)).alias("n")), "term")
    pairs = frequent.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("term", "n"))).alias("frequencies"))
    return stored(items.drop("terms").join(pairs, "row"), "benchmark-described")


def write_indexes(described: DataFrame, share: float, max_items: int, max_bytes: int) -> list[str]:
    """An index file on the shared folder for each group of items, built where the group is; their names.

    Items are dealt to groups by a hash, so many that a group has about
    ``max_items`` items and ``max_bytes`` of text or, on average, fewer.
    """
    row = described.agg(F.count(F.lit(1)).alias("n"), F.avg("n_words").alias("mean"), F.sum(F.length("text")).alias("size")).first()
    if not row.n:
        return []
    groups = max(-(-row.n // max_items), -(-row.size // max_bytes))
    folder = scratch(described.sparkSession, "benchmark-index")
    n, mean = row.n, row["mean"]

    def build(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table[c].to_pylist() for c in ("item_id", "text", "frequencies")), strict=True), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        found = {term % 2**64: count for *_, frequencies in rows for term, count in frequencies}
        index = Index([(item, text) for item, text, _ in rows], share, Collection(n, mean, found))
        system, path = opened(folder)
        system.create_dir(path, recursive=True)
        name = f"{table['group'][0].as_py()}-{task_name()}"
        with system.open_output_stream(f"{path}/{name}") as out:
            out.write(pickle.dumps(index))
        return pa.table({"uri": [f"{folder}/{name}"]})

    dealt = described.withColumn("group", F.pmod(F.hash("row"), F.lit(groups)))
    return sorted(r.uri for r in dealt.groupBy("group").applyInArrow(build, "uri string").collect())


_held: list[tuple[str, Index]] = []


def read_index(uri: str) -> Index:
    """An index file; the last one read stays in the worker."""
    if not _held or _held[0][0] != uri:
        _held.clear()
        system, path = opened(uri)
        with system.open_input_file(path) as f:
            _held.append((uri, pickle.loads(f.read())))
    return _held[0][1]


_LEAK = StructType([StructField("item_id", LongType()), *[StructField(n, DoubleType()) for n in ("score", "question_overlap", "answer_overlap")]])


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), share: float = 0.5,
    overlap: float = 0.6, max_items: int = 1000, max_bytes: int = 4 << 20,
) -> DataFrame:
    """The columns ``keep`` of every row of ``docs``, and ``leaks``: the benchmark items it contains.

    An item is retrieved for a passage whose BM25 score reaches ``share`` of
    the item's score against itself, and is a leak if at least ``overlap`` of
    the 5-word runs of its question and of its answer occur in that passage.
    An item's passages are the runs of 2s words that begin every s words of a
    text (the last may be shorter), s being the item's ``length_class``.  Of an
    item's passages in a text the one of the highest score counts.

    Items are indexed in groups of about ``max_items`` items and ``max_bytes``
    at most, each a file on the shared folder.  A task reads its texts once; it
    holds ``STEP_BYTES`` of them, or one longer text, and one index at a time.
    Passages rest on the item alone and scores on statistics of all items, so
    the grouping changes neither.  Null and empty texts leak nothing, very long
    ones are searched whole, null or wordless items are never found, equal
    items are all reported, a null item id is reported as null; repeated rows
    are judged each by itself.  ``keep`` names columns of any name but ``leaks``.
    """
    indexes = write_indexes(_described(benchmark), share, max_items, max_bytes)
    added = StructType([StructField("leaks", ArrayType(_LEAK))])
    leak = pa.list_(to_arrow_type(_LEAK))

    def judged(held):
        """Batches with their leaks: all indexes, one after the other, over all that is held."""
        found = [[[] for _ in range(part.num_rows)] for part, *_ in held]
        for uri in indexes:
            index = read_index(uri)
            for leaks, (_, words, bound) in zip(found, held, strict=True):
                for d, *one in index.leaks(words, bound, overlap):
                    leaks[d].append(dict(zip(_LEAK.names, one, strict=True)))
        for leaks, (part, *_) in zip(found, held, strict=True):
            ordered = [sorted(some, key=lambda x: (x["item_id"] is None, x["item_id"] or 0, -x["score"])) for some in leaks]
            yield pa.RecordBatch.from_arrays([part.column("kept"), pa.array(ordered, leak)], names=["kept", "leaks"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for rows, blob, begins in pieces(batch, "text"):
                blob = lowered(blob)
                starts, ends = word_spans(blob, NOT_ALNUM)
                held.append((batch.slice(rows.start, rows.stop - rows.start).select(["kept"]), span_hashes(blob, starts, ends), np.searchsorted(starts, begins)))
                size += len(blob)
                if size >= STEP_BYTES:
                    yield from judged(held)
                    held, size = [], 0
        yield from judged(held)

    return carrying(docs, text_col, keep, run, added)


def leaked_pairs(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per leak: ``doc_id, item_id, score, question_overlap, answer_overlap``; clean documents have none."""
    leaks = find_leaks(docs, benchmark, keep=("doc_id",), **options)
    return leaks.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")
