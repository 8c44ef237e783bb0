"""Jaccard join and decontamination against brute force over all pairs and all alignments."""
import random
import re
from itertools import combinations

import numpy as np
import pytest

from sparkaudit.llm import decontaminate as dc
from sparkaudit.llm import jaccard_join as jj
from sparkaudit.llm.decontaminate import MASKS, WINDOW, allowed, decontaminate, find_overlaps, masks_of
from sparkaudit.llm.jaccard_join import common_counts, keep_one_of_each, prefix_length, similar_documents

WORDS = [f"w{i}" for i in range(400)]


def words(text):
    return re.findall(r"\w+", (text or "").lower())


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(4)
    base = [" ".join(rnd.choices(WORDS, k=n)) for n in (5, 40, 80, 80, 120, 300, 60, 60, 60, 60)]
    near = []
    for k in range(60):
        w = base[4].split()
        for _ in range(rnd.randrange(6)):
            w[rnd.randrange(len(w))] = rnd.choice(WORDS)
        near.append(" ".join(w))
    shared = base[1]
    mixed = [shared + " " + " ".join(rnd.choices(WORDS, k=n)) for n in (5, 8, 11, 60)]
    return [None, "", "...", "one two", "One, two!", *base, *near, *base[:3], base[5].upper(), *mixed, *[near[0]] * 40]


def brute(rows):
    """Links and groups of (id, text) rows by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))
    links = [0] * len(rows)
    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and len(a & b) / len(a | b) >= 0.8:
            links[i] += 1
            links[j] += 1
            x, y = group[i], group[j]
            group = [x if g == y else g for g in group]
    first = {}
    for (k, _), g in zip(rows, group, strict=True):
        first[g] = min(first.get(g, k), k)
    return links, [first[g] for g in group]


@pytest.mark.parametrize("block", [4096, 8])
def test_links_and_groups_equal_all_pairs(spark, texts, block, monkeypatch):
    monkeypatch.setattr(jj, "BLOCK", block)
    rows = list(enumerate(texts))
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, class_id int")
    links, groups = brute(rows)
    got = {r["doc_id"]: (r["n_links"], r["class_id"]) for r in similar_documents(df).collect()}
    assert got == {k: (n, g) for (k, _), n, g in zip(rows, links, groups, strict=True)}
    kept = keep_one_of_each(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted({g for g in groups})


def test_repeated_rows_missing_ids_and_empty_tables(spark):
    text = " ".join(WORDS[:30])
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (2, None), (2, None), (3, "a b")], "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["n_links"], r["class_id"] or 0) for r in similar_documents(df).collect()))
    assert got[0][:2] == (0, 2) and got[1:3] == [(1, 2, got[1][2])] * 2 and got[3:] == [(2, 0, 2), (2, 0, 2), (3, 0, 3)]
    kept = [r["text"] for r in keep_one_of_each(df).collect()]
    assert kept.count(text) == 1 and kept.count(None) == 2 and kept.count("a b") == 1
    assert similar_documents(df.where("false")).collect() == [] and keep_one_of_each(df.where("false")).collect() == []


def test_prefix_is_shortened_to_the_recall():
    d = prefix_length(0.8, 24, 0.9999)
    assert 1 - (1 - 0.8 ** d) ** 24 >= 0.9999 > 1 - (1 - 0.8 ** (d + 1)) ** 24


def test_common_counts_with_rare_and_frequent_shingles():
    rng = np.random.default_rng(2)
    sets = [np.unique(np.concatenate([rng.integers(0, 50, 30), rng.integers(50, 3000, 60)])).astype(np.uint64) for _ in range(200)]
    want = [[len(set(a) & set(b)) for b in sets] for a in sets]
    got = common_counts(sets)
    assert all(got[i, j] == want[i][j] for i in range(200) for j in range(200) if i != j)


def test_masks_miss_no_window_and_no_short_item():
    for n in range(dc.LEAST_WORDS, WINDOW + 1):
        for wrong in combinations(range(n), allowed(n)):
            assert any(all(p + s not in wrong for p in m) for m in masks_of(n) for s in range(n - m[-1]))
    assert masks_of(WINDOW + 9) == MASKS and allowed(WINDOW) == 3


def overlapping(doc, item):
    d, b = words(doc), words(item)
    n = min(WINDOW, len(b))
    if len(b) < dc.LEAST_WORDS:
        return False
    for shift in range(-len(b), len(d)):
        equal = [b[k] == d[k + shift] for k in range(max(0, -shift), min(len(b), len(d) - shift))]
        if any(sum(equal[k:k + n]) >= n - allowed(len(b)) for k in range(len(equal) - n + 1)):
            return True
    return False


@pytest.mark.parametrize("limit", [1_000_000, 60])
def test_overlaps_equal_trying_all_alignments(spark, limit, monkeypatch):
    monkeypatch.setattr(dc, "PASS_WORDS", limit)
    rnd = random.Random(9)
    few = WORDS[:30]
    items = [(i, " ".join(rnd.choices(WORDS, k=n))) for i, n in enumerate([3, 5, 7, 9, 12, 14, 15, 20, 45])] + [(99, None), (8, "again " * 4)]
    docs = [None, "", "short"]
    for i, t in items[:9]:
        for changes in range(6):
            w = t.split()
            for k in rnd.sample(range(len(w)), min(changes, len(w))):
                w[k] = rnd.choice(few)
            docs.append(" ".join(rnd.choices(WORDS, k=20)) + " " + " ".join(w).upper() + "! " + " ".join(rnd.choices(WORDS, k=15)))
        docs.append(" ".join(t.split()[len(t.split()) // 2:]))
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(docs)] + [(4, docs[4], "x")], "doc_id long, text string, start string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {(k, i) for k, t in enumerate(docs) for i, b in items if overlapping(t, b)}
    found = find_overlaps(df, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == want and len(want) > 20
    assert all(r["n_equal"] >= 0.75 * r["n_words"] for r in found)
    left = sorted(r["doc_id"] for r in decontaminate(df, bench).collect())
    assert left == sorted(k for k in [*range(len(docs)), 4] if not any(k == d for d, _ in want))
    assert decontaminate(df, bench).columns == df.columns
    assert find_overlaps(df.where("false"), bench).collect() == [] and find_overlaps(df, bench.where("false")).collect() == []
    assert decontaminate(df, bench.where("false")).count() == len(docs) + 1


def test_overlaps_at_the_ends_of_a_document(spark):
    item = " ".join(f"i{k}" for k in range(15))
    cut = lambda a, b: " ".join(item.split()[a:b])
    pad = " ".join(f"p{k}" for k in range(20))
    docs = [f"{cut(1, 15)} {pad}", f"{pad} {cut(0, 12)}", cut(2, 14), f"{cut(3, 15)} {pad}", f"{pad} {cut(3, 15)} {pad}",
            f"{cut(4, 15)} {pad}", cut(0, 11), f"{cut(3, 14)} other {pad}"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    rows = find_overlaps(df, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    got = {r["doc_id"]: (r["start"], r["item_start"], r["n_words"], r["n_equal"]) for r in rows}
    assert got == {0: (0, 1, 14, 14), 1: (20, 0, 12, 12), 2: (0, 2, 12, 12), 3: (0, 3, 12, 12), 4: (17, 0, 15, 12)}
