"""Benchmark decontamination: spaced-seed hashes of benchmark items and documents are joined, overlaps around hits verified.

A mask picks some positions of a run of words and ignores the rest, so a hit survives a substituted word at an ignored
position. The masks below find every run of 15 words with at most 3 substitutions.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .shingles import MULTIPLIERS, combined, forget_words, mixed, word_hashes, words_of

# Words of the window that decides, and the share of its words that must be equal.
WINDOW = 15
IDENTITY = 0.8
# Any 3 ignored positions of 15 leave one of these masks untouched at some shift (checked in the tests).
MASKS = ((0, 1, 3, 4, 5, 6), (0, 1, 2, 6, 9, 10), (0, 1, 5, 6, 8, 10))
# Items of fewer words take no part; those below SHORT must occur word for word.
LEAST_WORDS, SHORT = 5, 8
# Words of benchmark items that one pass over the documents looks for; a larger benchmark takes more passes.
PASS_WORDS = 1_000_000
FILTER_BITS = 22


def allowed(n):
    """Substitutions allowed in an item of ``n`` words, or in a window of a longer one."""
    n = min(n, WINDOW)
    return 0 if n < SHORT else int(n * (1 - IDENTITY) + 1e-9)


def masks_of(n):
    """Masks that cannot miss an item of ``n`` words: for short ones the longest run that its substitutions leave whole."""
    if n >= WINDOW:
        return MASKS
    k = allowed(n)
    return (tuple(range(-(-(n - k) // (k + 1)))),)


def seeds(hashes, mask):
    """The masked hash at every start; masks of different shape never share one."""
    if len(hashes) <= mask[-1]:
        return np.empty(0, dtype=np.uint64)
    salt = np.uint64(sum(p * int(MULTIPLIERS[i % 64]) for i, p in enumerate(mask)) % 2**64 + len(mask))
    return mixed(combined(hashes, mask) + salt)


class Seeds:
    """Seeds of a bounded block of benchmark items, sorted by hash, with a bit filter in front."""

    def __init__(self, items):
        self.ids = [i for i, _ in items]
        self.words = [w for _, w in items]
        self.masks = sorted({m for w in self.words for m in masks_of(len(w))})
        parts = [(s := seeds(w, m), np.full(len(s), k), np.arange(len(s))) for k, w in enumerate(self.words) for m in masks_of(len(w))]
        h, item, at = (np.concatenate([p[j] for p in parts]) for j in range(3))
        order = np.argsort(h, kind="stable")
        self.hash, self.item, self.at = h[order], item[order].astype(np.int32), at[order].astype(np.int32)
        self.filter = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.filter[self.hash >> np.uint64(64 - FILTER_BITS)] = True

    def hits(self, hashes):
        """Distinct (item, start of the item in the document) that some seed proposes."""
        found = set()
        for mask in self.masks:
            s = seeds(hashes, mask)
            near = np.flatnonzero(self.filter[s >> np.uint64(64 - FILTER_BITS)])
            if len(near):
                low, high = (np.searchsorted(self.hash, s[near], side) for side in ("left", "right"))
                for p, i, j in zip(near[high > low], low[high > low], high[high > low], strict=True):
                    found.update(zip(self.item[i:j].tolist(), (p - self.at[i:j]).tolist(), strict=True))
        return found

    def overlaps(self, hashes):
        """Verified overlaps of one document: for each item the best (matches, start, item start, words)."""
        best = {}
        for item, shift in self.hits(hashes):
            words = self.words[item]
            first, last = max(0, -shift), min(len(words), len(hashes) - shift)
            # positions of the item outside the document are unequal
            equal = np.zeros(len(words), dtype=bool)
            equal[first:last] = words[first:last] == hashes[first + shift:last + shift]
            span = min(WINDOW, len(words))
            total = np.concatenate([[0], np.cumsum(equal)])
            good = np.flatnonzero(total[span:] - total[:-span] >= span - allowed(len(words)))
            if len(good):
                start, end = max(good[0], first), min(good[-1] + span, last)
                found = (int(total[end] - total[start]), -int(start + shift), -int(start), int(end - start))
                key = self.ids[item]
                best[key] = max(best.get(key, found), found)
        return {k: (m, -s, -i, n) for k, (m, s, i, n) in best.items()}


def passes(bench, id_col, text, words=None):
    """Seeds of the benchmark items, each of at most ``PASS_WORDS`` words and one item; items are read as a stream.

    They travel with the task function, which Spark broadcasts.
    """
    words = words or PASS_WORDS
    held, size = [], 0
    for row in bench.select(id_col, text).toLocalIterator():
        hashes = word_hashes(words_of(row[1]))
        if len(hashes) < LEAST_WORDS:
            continue
        if held and size + len(hashes) > words:
            yield Seeds(held)
            held, size = [], 0
        held.append((row[0], hashes))
        size += len(hashes)
    forget_words()
    if held:
        yield Seeds(held)


def find_overlaps(docs, bench, id_col="doc_id", text="text", item_id="item_id", item_text="text"):
    """One row per document and benchmark item that overlap: ids, ``start``, ``item_start``, ``n_words``, ``n_equal``.

    They overlap when on one alignment a window of ``WINDOW`` words (the whole item, if shorter) has at least
    ``IDENTITY`` of its words equal, where words of the item beyond the document's ends are unequal; the row spans the first to the last such window of the best alignment (most equal
    words, then the smallest start), as far as it is in the document. Positions count words. Only substitutions are tolerated, within one alignment.
    Missing or empty texts and items under ``LEAST_WORDS`` words overlap nothing. A repeated row gives repeated rows,
    a repeated item one. The documents are read once per pass of the benchmark and never shuffled.
    """
    id_type, item_type = docs.schema[id_col].dataType, bench.schema[item_id].dataType
    source = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"))
    schema = (source.schema.fields[0].dataType.simpleString(), item_type.simpleString())
    layout = f"_id {schema[0]}, _item {schema[1]}, start long, item_start long, n_words long, n_equal long"

    def finder(table):
        def run(batches):
            for batch in batches:
                rows = [(i, key, *o) for i, t in enumerate(batch.column(1).to_pylist())
                        for key, o in table.overlaps(word_hashes(words_of(t))).items()]
                if rows:
                    at, items, equal, start, item_start, n = (list(x) for x in zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(at)), pa.array(items), *(pa.array(x, pa.int64()) for x in (start, item_start, n, equal))],
                        names=["_id", "_item", "start", "item_start", "n_words", "n_equal"])
        return run

    found = docs.sparkSession.createDataFrame([], layout)
    for table in passes(bench, item_id, item_text):
        found = found.union(source.mapInArrow(finder(table), layout))
    return found.select(F.col("_id").cast(id_type).alias(id_col), F.col("_item").alias(item_id), "start", "item_start", "n_words", "n_equal")


def decontaminate(docs, bench, text="text", item_id="item_id", item_text="text"):
    """``docs`` without the rows that overlap a benchmark item; columns and all other rows stay as they are.

    Rows are judged where they are read: no shuffle and no join.
    """
    at = docs.columns.index(text)

    def keeper(table):
        def run(batches):
            for batch in batches:
                clean = [not table.overlaps(word_hashes(words_of(t))) for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))
        return run

    for table in passes(bench, item_id, item_text):
        docs = docs.mapInArrow(keeper(table), docs.schema)
    return docs
