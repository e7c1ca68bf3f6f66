"""Disguised terms: characters of three and four bytes, and ASCII signs inside a word."""

import random

import numpy as np

from tidemark.llm import kernel, toxicity

STEMS = ["idiot", "stupid", "disgusting", "worthless", "réeux", "ab€cd", "x🙂yzu", "scum", "垃圾东西人"]


def possible(lexicon, word):
    blob = np.frombuffer(word.encode() + b"\n", dtype=np.uint8)
    return bool(lexicon.possible(blob, *kernel.word_spans(blob, kernel.NOT_ALNUM)).all())


def test_filter_passes_what_matches():
    lexicon = toxicity.Lexicon(STEMS)
    assert all(possible(lexicon, w) and lexicon.match(w.encode()) for w in ("i\u200bdiot", "s\u200btupid", "i🙂iot", "d🙂sgusting", "w🙂orthless", "abxcd"))
    rng, letters = random.Random(1), "idotsué€垃🙂\u200b𝒹"
    tried = 0
    for _ in range(20000):
        w = list(rng.choice(STEMS) + rng.choice(["", "s", "ment", "🙂", "é"]))
        k = rng.randrange(len(w))
        w[k : k + rng.choice([0, 1])] = rng.choice([[], [rng.choice(letters)]])
        word = "".join(w)
        if lexicon.match(word.encode()):
            tried += 1
            assert possible(lexicon, word), word
    assert tried > 10000


def found(text):
    blob = toxicity.folded(np.frombuffer(text.encode() + b"\n", dtype=np.uint8))
    lexicon = toxicity.Lexicon(STEMS)
    return [(lexicon.stems[s], edits) for _, s, edits, _ in lexicon.matches(blob, np.array([0, len(blob)]))]


def test_signs_inside_words():
    assert found("you id*ot and st.upid you") == [("idiot", 1), ("stupid", 1)]
    assert found("an idiot's, well-idiot") == [("idiot", 0), ("idiot", 0)]  # no match is found twice
    assert found("id ot st. upid i**ot sc-um w1/w2 a.b.c") == []
    assert found("worth-less!") == [("worthless", 1)]
