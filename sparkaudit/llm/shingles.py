"""Word and shingle hashes of whole texts, the same in every process."""
import re

import numpy as np
import xxhash

WORD = re.compile(r"\w+")
# Words whose hash a Python worker remembers before it starts anew.
REMEMBERED = 200_000
MULTIPLIERS = np.random.default_rng(5).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_known: dict[str, int] = {}


def forget_words():
    """Empties the memory of words, so that it doesn't travel with task functions."""
    _known.clear()


def words_of(text):
    """Runs of letters, digits and underscores in lower case."""
    return WORD.findall(text.lower()) if text else []


def word_hashes(words):
    if len(_known) > REMEMBERED:
        _known.clear()
    known = _known
    found = [*map(known.get, words)]
    if None in found:
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        found = map(known.__getitem__, words)
    return np.fromiter(found, np.uint64, len(words))


def mixed(h):
    """Spreads every bit of 64-bit values over all others."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def combined(hashes, offsets):
    """One hash for every start: of the tokens at the given offsets from it."""
    n = len(hashes) - max(offsets)
    total = np.zeros(n, dtype=np.uint64)
    for k, o in enumerate(offsets):
        total += hashes[o:o + n] * MULTIPLIERS[k % 64]
    return mixed(total)


def shingle_set(text, width):
    """Sorted distinct hashes of the runs of ``width`` words; of all words together in a shorter text."""
    hashes = word_hashes(words_of(text))
    if not len(hashes):
        return hashes
    return np.unique(combined(hashes, range(min(width, len(hashes)))))
