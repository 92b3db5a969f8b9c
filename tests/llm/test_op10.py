"""Shingle sets of whole batches of texts."""
import re

import numpy as np
import pyarrow as pa
import pytest

ODD = [None, "", " ", "\x1c\x1da b", "a b c d e f g h", "A B c\td\x0be\x0cf\rg", "É é À x y z w", "  lead and trail five more words \n",
       "one", "w" * 600 + " " + "w" * 601 + " a b c", "abcdefgh abcdefgh1 abcdefg a b", "a b c d e a b c d e a b c d e", "  \u0085 x y z",
       "\0 \0\0 a b c", "a b c d e"]


def _brute(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
@pytest.mark.parametrize("lo", [0, 3])
def test_shingle_sets_of_odd_texts(kind, lo):
    from logloom.llm.op10_ngram_join import shingle_sets
    found = shingle_sets(pa.array(ODD, pa.string()).cast(kind).slice(lo))
    hashes = {}
    for text, got in zip(ODD[lo:], found, strict=True):
        want = _brute(text)
        assert len(got) == len(want) and (np.diff(got.astype(object)) > 0).all()
        hashes.setdefault(frozenset(want), set()).add(got.tobytes())
    assert all(len(x) == 1 for x in hashes.values())                      # equal sets, equal hashes
    every = {s for text in ODD[lo:] for s in _brute(text)}
    assert len({h for got in found for h in got.tolist()}) == len(every)  # different shingles, different hashes
