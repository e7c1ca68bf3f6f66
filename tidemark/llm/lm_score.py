"""Language-model scores from a weighted backoff automaton over words.

The model is a smoothed trigram model.  Its automaton has a state for every
history of training: the empty one, each word (and the beginning of a text), and
each two words in a row.  From a state, an arc leads over every word that
followed its history in training, to the state of the longest history that
training knows after that word.  Any other word takes the state's failure arc, to
the history without its first word, and tries again there; the empty history has
an arc over every word.  The weights are log10 of

    empty:    p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)), all unknown words together being one with c = 0
    h:        p(w | h) = (c(hw) + s p(w)) / (c(h) + s), s = strengths[0]
    gh:       p(w | gh) = (c(ghw) + t p(w | h)) / (c(gh) + t), t = strengths[1]

and of the failure arcs s / (c(h) + s) and t / (c(gh) + t), so that what a state
gives to all words, over its arcs and by failure, sums to 1.

The automaton grows with the corpus, so no task holds it whole.  Training counts
are kept by ranges of a hash.  A chunk of texts asks for the counts of the words,
pairs and triples in it, builds the part of the automaton that its texts can
reach, and walks each text once from left to right, carrying the state and adding
the weights of the arcs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import exchange
from tidemark.llm.common import crc_mod, stored
from tidemark.llm.kernel import NULL_ID, U64, joined, lowered, pack, rows_of, span_hashes, unpack, word_spans

END, BEGIN = U64(0x9AE16A3B2F90404F), U64(0xC3A5C85C97CB3127)
WIDTHS = (8, 5, 5)  # bytes of the hash of a word, pair and triple beyond its part; a word's is whole
RUN = 64  # tokens that are walked in a row
CHUNK_BYTES = 3 << 20  # larger chunks repeat more of their words, and send each but once
ROOT, BEGINNING, FIRST = 0, 1, 2  # states; from FIRST on, those of the chunk's words and then of its pairs


class Tokens:
    """Words and ends of a chunk's texts, and their distinct words, pairs and triples (levels 0, 1 and 2)."""

    def __init__(self, row: dict, parts: int):
        blob, begins, self.ids = unpack(row)
        self.trains, self.parts = bool(row["mark"]), parts
        blob = lowered(blob)
        starts, ends = word_spans(blob)
        self.bound = np.searchsorted(starts, begins) + np.arange(len(begins))  # with one end for each text
        self.token = np.full(self.bound[-1], END, dtype=U64)
        self.word = np.ones(len(self.token), bool)
        self.word[self.bound[1:] - 1] = False
        self.token[self.word] = span_hashes(blob, starts, ends)
        self.inner = np.ones(len(self.token), bool)
        self.inner[self.bound[:-1]] = False

    def hashes(self, level: int) -> np.ndarray:
        """Of the level + 1 tokens up to each token; a text's first word makes a pair with its beginning, and no triple (left out)."""
        if level == 0:
            return self.token
        history = np.empty_like(self.token)
        history[1:] = self.token[:-1]
        history[self.bound[:-1]] = BEGIN
        pair = joined(history, self.token, 0)
        return pair if level == 1 else joined(np.concatenate((pair[:1], pair[:-1])), self.token, 0)[self.inner]

    def distinct(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys, and how often each occurs in this chunk."""
        return np.unique(exchange.shortened(self.hashes(level), self.parts, WIDTHS[level]), return_counts=True)

    def trained(self, level: int, answers: list[dict] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Training counts of the keys, where each one first ends, and the number of the one that ends at each token (or -1).

        Counts are what came back, or this chunk's own where no other chunk has the key.
        """
        short = exchange.shortened(self.hashes(level), self.parts, WIDTHS[level])
        keys, first, at, counts = np.unique(short, return_index=True, return_inverse=True, return_counts=True)
        total = counts.astype(np.int64) if self.trains else np.zeros(len(keys), dtype=np.int64)
        mine = [a for a in answers or () if a["part"] // self.parts == level]
        places, values = exchange.received([a | {"part": a["part"] % self.parts} for a in mine], exchange.cuts(keys, self.parts, WIDTHS[level]))
        total[places] = values
        if level < 2:
            return total, first, at
        number = np.full(len(self.token), -1, dtype=np.int64)
        number[self.inner] = at
        return total, np.flatnonzero(self.inner)[first], number


@dataclass
class Automaton:
    """States and arcs are numbers; states from ``longer`` on are of two words.

    An arc leads from its ``source`` to its ``target``; ``failure`` and ``cost``
    are the states' failure arcs.  ``over[n][i]`` is the only arc over token i
    that can leave a state of n words, or -1.
    """

    longer: int
    source: np.ndarray
    target: np.ndarray
    weight: np.ndarray
    failure: np.ndarray
    cost: np.ndarray
    over: list[np.ndarray]

    def walk(self, begins: np.ndarray, ends: np.ndarray, state: np.ndarray, warm: np.ndarray) -> np.ndarray:
        """Walks all runs of tokens begins..ends side by side from their states; the summed weights, without the first ``warm`` tokens'."""
        total = np.zeros(len(begins))
        state = state.copy()
        live = np.arange(len(begins))
        for step in range(int((ends - begins).max(initial=0))):
            live = live[begins[live] + step < ends[live]]
            at, counts = begins[live] + step, step >= warm[live]
            here, added = state[live], np.zeros(len(live))
            waiting = np.arange(len(live))
            for words in (2, 1, 0):
                arc = self.over[words][at[waiting]]
                takes = (arc >= 0) & (self.source[arc] == here[waiting])
                taken, arc = waiting[takes], arc[takes]
                added[taken] += self.weight[arc]
                here[taken] = self.target[arc]
                waiting = waiting[~takes]
                # by failure, from a state of that many words
                fails = waiting[here[waiting] >= self.longer] if words == 2 else waiting[here[waiting] != ROOT]
                added[fails] += self.cost[here[fails]]
                here[fails] = self.failure[here[fails]]
            state[live] = here
            total[live] += np.where(counts, added, 0.0)
        return total

    def scores(self, bound: np.ndarray, start: int) -> np.ndarray:
        """Of each text, walked in runs of RUN tokens.

        The state after two tokens rests on these alone, from whatever state they
        were walked; so a run within a text sets out two tokens early.
        """
        size = np.diff(bound)
        runs = np.maximum(-(-size // RUN), 1)
        text = np.repeat(np.arange(len(size)), runs)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(runs) - runs, runs)
        begins = bound[text] + nth * RUN
        ends = np.minimum(begins + RUN, bound[text + 1])
        warm = np.where(nth > 0, 2, 0)
        return np.bincount(text, self.walk(begins - warm, ends, np.where(nth > 0, ROOT, start), warm), len(size))


def automaton(t: Tokens, found: list[tuple], base: np.ndarray, texts: int, strengths: tuple[float, float]) -> Automaton:
    """The states and arcs that a chunk's texts can reach.

    ``found`` is what ``trained`` tells of each level, ``base`` has p(w) of the
    chunk's words, ``texts`` is how many began in training.
    """
    (one, first1, word), (two, first2, pair), (three, first3, triple) = found
    s, more = strengths
    longer = FIRST + len(one)
    start, last = ~t.inner, ~t.word

    def of_word(tokens):  # the state after a word, if training knows it
        return np.where(one[word[tokens]] > 0, FIRST + word[tokens], ROOT)

    def of_pair(tokens):  # and after a pair that training knows; an end leads nowhere
        return np.where(last[tokens], ROOT, longer + pair[tokens])

    # arcs of the empty history, of words (and the beginning), of pairs
    before = np.maximum(first2 - 1, 0)
    held = np.where(start[first2], texts, one[word[before]])
    p2 = (two + s * base[word[first2]]) / (held + s)
    known = two > 0
    here = (three > 0) & known[pair[first3]] & known[pair[first3 - 1]]
    first3 = first3[here]
    p3 = (three[here] + more * p2[pair[first3]]) / (two[pair[first3 - 1]] + more)
    source = [np.full(len(one), ROOT), np.where(start[first2], BEGINNING, of_word(before))[known], longer + pair[first3 - 1]]
    target = [np.where(last[first1], ROOT, of_word(first1)), of_pair(first2)[known], of_pair(first3)]
    weight = [np.log10(base), np.log10(p2[known]), np.log10(p3)]

    over = [word]
    for numbers, there, arcs_before in ((pair, known, len(one)), (triple, here, len(one) + int(known.sum()))):
        arc = np.append(np.where(there, arcs_before + np.cumsum(there) - 1, -1), -1)
        over.append(arc[numbers])

    failure = np.concatenate((np.zeros(longer, dtype=np.int64), of_word(first2)))
    held = np.concatenate(([0, texts], one))
    cost = np.concatenate((np.log10(s / (held + s)), np.log10(more / (two + more))))
    return Automaton(longer, np.concatenate(source), np.concatenate(target), np.concatenate(weight), failure, cost, over)


#: To every chunk, the sums of its keys' counts that differ from its own; numbers of counted keys and of all counts.
SUMS = exchange.Reduction(np.add, 0, lambda own, total, several: total != own, lambda totals: [int((totals > 0).sum()), int(totals.sum())])


def lm_score(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", trains: Column | None = None, strengths: tuple[float, float] = (300.0, 3.0)
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, trains, n_tokens, n_known, train_tokens, base_score, score``.

    Learns from the rows where ``trains`` (a boolean column; default all) is
    true and scores all.  Tokens are runs of anything but ASCII white space
    with A-Z as a-z, and one end for each text; so a null or empty text is one
    token.  ``base_score`` is the text's log10 probability under the add-half
    unigram model, ``score`` under the automaton.  Without training rows every
    word is unknown and has probability 1.  Words are told apart by 64 bits of
    hash, pairs and triples by 43 or more (the more, the larger the corpus), and
    a triple counts only if both of its pairs are known.  Repeated rows count, and are scored, as often as they
    occur; null ids pass; other columns are ignored.
    """
    mark = trains if trains is not None else F.lit(True)
    chunks = stored(pack(docs, id_col, text_col, mark=mark, target=CHUNK_BYTES), "lm-chunks")
    parts, n_chunks = exchange.parts_for(chunks)

    def counted(*levels: int) -> DataFrame:
        """Answers to the chunks, the parts of level n being n * parts and up."""

        def ask(batches):
            for row in rows_of(batches):
                t = Tokens(row, parts)
                for level in levels:
                    keys, counts = t.distinct(level)
                    places = np.arange(len(keys)) if t.trains else np.empty(0, dtype=np.int64)
                    if len(keys):
                        yield from exchange.sends(row["chunk"], keys, parts, WIDTHS[level], places, counts[places], first_part=level * parts)

        return exchange.exchanged(chunks.mapInArrow(ask, exchange.SENT), SUMS, n_chunks)

    def begins_of(batches):
        texts = sum(len(row["marks"]) // 8 for row in rows_of(batches) if row["mark"])
        yield pa.RecordBatch.from_pydict({"texts": [texts]}, schema=pa.schema([("texts", pa.int64())]))

    words = stored(counted(0), "lm-words")
    n_known, n_train = exchange.notes(words, 2)
    n_texts = chunks.select("marks", "mark").mapInArrow(begins_of, "texts long").agg(F.sum("texts")).first()[0] or 0
    answered = exchange.by_chunk(words.unionByName(counted(1, 2)), "answers")

    def score(batches):
        for row in rows_of(batches):
            t = Tokens(row, parts)
            found = [t.trained(level, row["answers"]) for level in range(3)]
            counts, _, word = found[0]
            p = (counts + 0.5) / (n_train + 0.5 * (n_known + 1))
            model = automaton(t, found, p, n_texts, strengths)
            first, n = t.bound[:-1], len(t.ids)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(t.ids, mask=t.ids == NULL_ID),
                    pa.array([t.trains] * n, pa.bool_()),
                    pa.array(np.diff(t.bound).astype(np.int64)),
                    pa.array(np.add.reduceat((counts > 0)[word].astype(np.int64), first)),
                    pa.array(np.full(n, n_train, dtype=np.int64)),
                    pa.array(np.add.reduceat(np.log10(p)[word], first)),
                    pa.array(model.scores(t.bound, BEGINNING if n_texts else ROOT)),
                ],
                names=["doc_id", "trains", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    schema = "doc_id long, trains boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return chunks.join(answered, "chunk", "left").mapInArrow(score, schema)


def lm_query(docs: DataFrame) -> DataFrame:
    """The contract's columns: learned from the rows whose id hash mod 5 is not 1."""
    scored = lm_score(docs, trains=crc_mod(F.col("doc_id"), 5) != 1)
    return scored.select("doc_id", (~F.col("trains")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
