import random

import numpy as np
import pyarrow as pa

from worldfold.llm import words as w

from .helpers import corpus, words_of


def test_words_match_the_regular_expression_and_hash_alike():
    texts = [t for _, t in corpus(3, 20)] + ["Ünïcode É_b-c 12a", "a" * 10, "x" * (w.SEGMENT * 2 + 5) + " tail", "é" * 3]
    h, at = w.words(pa.array(texts, pa.string()))
    flat = [x for t in texts for x in words_of(t)]
    assert np.diff(at).tolist() == [len(words_of(t)) for t in texts]
    by: dict[str, int] = {}
    for word, x in zip(flat, h.tolist()):
        assert by.setdefault(word, x) == x
    assert len(set(by.values())) == len(by)


def test_window_hashes_depend_on_the_window_alone():
    rng = random.Random(2)
    base = np.array([rng.randrange(1 << 60) for _ in range(40)], np.uint64)
    both = np.concatenate([np.zeros(7, np.uint64), base, np.ones(3, np.uint64), base])
    h = w.window_hashes(both, 40)
    assert h[7] == h[50] and len(set(h.tolist())) == len(h) - 1
    assert len(w.window_hashes(base, 41)) == 0
