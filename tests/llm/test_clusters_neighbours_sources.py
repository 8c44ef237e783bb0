"""Clustering, one-bit search and the source audit against brute force."""
import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from sparkaudit.llm import one_bit_search, sharded_lloyd, source_divergence
from sparkaudit.llm.one_bit_search import Code, nearest, rotation
from sparkaudit.llm.sharded_lloyd import cluster

ODD = [(900, None), (901, [0.1] * 3), (902, [0.1, None] + [0.2] * 6), (903, [math.nan] * 8), (904, [math.inf] * 8), (None, [0.3] * 8)]
VECTORS = "vec_id long, embedding array<float>, cluster string, _v string, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(k, v, "a", "b", 1) for k, v in rows], VECTORS)


def lloyd(rows, k, rounds):
    v = [(i, [math.floor(256 * float(np.float32(x))) for x in e]) for i, e in rows
         if e is not None and len(e) == 8 and all(x is not None and math.isfinite(x) for x in e)]
    order = sorted(v, key=lambda r: ((0, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest()) if r[0] is not None else (1, ""), r[1]))
    centres = [e for _, e in order[:k]]
    for turn in range(rounds + 1):
        away = [[sum((a - b) ** 2 for a, b in zip(e, c, strict=True)) for c in centres] for _, e in v]
        near = [min(range(len(centres)), key=lambda c: (d[c], c)) for d in away]
        if turn < rounds:
            for c in range(len(centres)):
                held = [e for (_, e), n in zip(v, near, strict=True) if n == c]
                if held:
                    centres[c] = [sum(x) // len(held) for x in zip(*held, strict=True)]
    best = [d[n] for d, n in zip(away, near, strict=True)]
    inertia = [sum(d for d, n in zip(best, near, strict=True) if n == c) for c in range(len(centres))]
    return sorted(((-1 if i is None else i), n, d, inertia[n], sum(best), hashlib.sha256(",".join(map(str, centres[n])).encode()).hexdigest())
                  for (i, _), n, d in zip(v, near, best, strict=True))


@pytest.mark.parametrize("width,chunk,k", [(32, 1024, 7), (3, 5, 7), (4, 64, 300)])
def test_clusters_equal_plain_lloyd(spark, width, chunk, k, monkeypatch):
    monkeypatch.setattr(sharded_lloyd, "WIDTH", width)
    monkeypatch.setattr(sharded_lloyd, "CHUNK", chunk)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(i % 3, 0.4, 8)]) for i in range(90)]
    rows += [(500 + i, [0.5] * 8) for i in range(60)] + [rows[4]] * 3 + [(5, [2.0] * 8), (2**60 + 1, [-9.0] * 8)] + ODD
    got = cluster(frame(spark, rows), k=k, rounds=3, dims=8)
    assert got.columns[:3] == ["vec_id", "cluster", "distance"] and got.schema["vec_id"].dataType.simpleString() == "bigint"
    assert sorted(((-1 if r[0] is None else r[0]), *r[1:6]) for r in got.collect()) == lloyd(rows, k, 3)
    assert cluster(frame(spark, ODD[:1]), dims=8).collect() == []


def test_products_are_exact_at_any_size():
    a = np.array([[(1 << 27) - 1] * 64, [-(1 << 27) + 1] * 64], dtype=np.int64)
    assert sharded_lloyd.product(a, a.T).tolist() == [[64 * ((1 << 27) - 1) ** 2, -64 * ((1 << 27) - 1) ** 2]] + [
        [-64 * ((1 << 27) - 1) ** 2, 64 * ((1 << 27) - 1) ** 2]]


def neighbours(rows, k, queries):
    sound = sorted({(i, tuple(float(np.float32(x)) for x in v)) for i, v in rows
                    if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)})
    out = {}
    for q, e in sound:
        if queries(q):
            out[q] = sorted((math.dist(e, v), i) for i, v in sound if i != q and len(v) == len(e))[:k]
    return out


def found_by(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out[r["query_id"]]) + 1
        out[r["query_id"]].append((r["score"], r["vec_id"]))
    return out


@pytest.mark.parametrize("cell,part,stream", [(8192, 16384, 262_144), (40, 25, 3)])
def test_neighbours_on_ties_copies_and_odd_rows(spark, cell, part, stream, monkeypatch):
    for name, value in (("CELL", cell), ("PART", part), ("STREAM", stream)):
        monkeypatch.setattr(one_bit_search, name, value)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 8)]) for i in range(150)]
    rows += [(300 + i, [0.5] * 8) for i in range(80)] + [rows[7]] * 4 + [(905, [0.0] * 8), (800, [3.0] * 5), (801, [3.5] * 5)] + ODD
    df = frame(spark, rows)
    want = neighbours(rows, 10, lambda q: q % 50 == 0)
    got = found_by(nearest(df, df.where("vec_id % 50 = 0")))
    assert set(got) == set(want)
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    for q in (300, 350, 800):     # copies at distance 0 and short lists are exact
        assert [i for _, i in got[q]] == [i for _, i in want[q]]
    known = {(q, i): d for q, found in neighbours(rows, 999, lambda q: q % 50 == 0).items() for d, i in found}
    assert all(math.isclose(d, known[q, i], rel_tol=1e-12, abs_tol=1e-12) for q, found in got.items() for d, i in found)
    assert nearest(df.where("false"), df.where("false")).collect() == []


def test_recall_without_structure_and_cells_left_out_with_it(spark, monkeypatch):
    monkeypatch.setattr(one_bit_search, "CELL", 200)
    rng = np.random.default_rng(9)
    plain = rng.normal(size=(2000, 64))
    groups = rng.normal(size=(10, 64))[rng.integers(0, 10, 2000)] * 8 + rng.normal(size=(2000, 64)) * 0.3
    for x, structured in ((plain, False), (groups, True)):
        rows = list(enumerate(x.tolist()))
        df = frame(spark, rows)
        met = []
        meet = one_bit_search.searched
        monkeypatch.setattr(one_bit_search, "searched", lambda index, asked, *a, meet=meet, met=met: met.append(asked.count()) or meet(index, asked, *a))
        got, want = found_by(nearest(df, df.where("vec_id % 20 = 0"))), neighbours(rows, 10, lambda q: q % 20 == 0)
        monkeypatch.setattr(one_bit_search, "searched", meet)
        recall = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want) / 1000
        assert recall >= 0.97
        assert sum(met) <= 1000 and (not structured or sum(met) <= 500)      # 100 queries, 10 cells


def test_bounds_hold_and_leave_most_vectors_out():
    rng = np.random.default_rng(1)
    x, q, centre = rng.normal(size=(3000, 64)), rng.normal(size=(20, 64)), np.zeros(64)
    code = Code(centre, rotation(64))
    bits, length, fit = code.encode(x)
    assert bits.shape == (3000, 32)
    low, high = code.bounds(np.unpackbits(bits, axis=1).astype(np.float32) * 2 - 1, length, fit, q)
    true = ((x[:, None] - q[None]) ** 2).sum(axis=2)
    assert ((low <= true) & (true <= high)).mean() > 0.98
    assert (low <= np.sort(true, axis=0)[9]).mean() < 0.3


def audit(docs, least, top):
    docs = [tuple("" if x is None else x for x in d) for d in docs]
    terms = [Counter(re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)) for t, _, _ in docs]
    out = []
    for lang in {d[1] for d in docs}:
        here = [(s, c) for (_, la, s), c in zip(docs, terms, strict=True) if la == lang]
        df = Counter(w for _, c in here for w in c)
        kept = [w for w in df if df[w] >= least]
        counts = defaultdict(Counter)
        for s, c in here:
            counts[s].update({w: n for w, n in c.items() if df[w] >= least})

        def share(c, kept=kept):
            n = sum(c.values())
            return {w: 1 + 10**9 * (c[w] + 2) // (n + 2 * len(kept)) for w in kept}

        p, q = {s: share(c) for s, c in counts.items()}, share(sum(counts.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in p:
            pairs = [(-sum(f(p[s][w], p[o][w]) for w in kept), o.encode(), o) for o in p if o != s]
            marks = [(-f(p[s][w], q[w]), w.encode(), w) for w in kept if counts[s][w] and p[s][w] > q[w]]
            out += [(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(sorted(pairs))]
            out += [(lang, s, "term", w, -v, i + 1) for i, (v, _, w) in enumerate(sorted(marks)[:top])]
    return sorted(out)


@pytest.mark.parametrize("entries,numbers,slice_", [(200_000, 1 << 18, 1 << 20), (3, 4, 8)])
def test_divergences_equal_counting_by_hand(spark, entries, numbers, slice_, monkeypatch):
    for name, value in (("ENTRIES", entries), ("NUMBERS", numbers), ("SLICE", slice_)):
        monkeypatch.setattr(source_divergence, name, value)
    words = ["Apple", "pear", "Übung", "naïve", "a", "B", "zz", "ÀB", "don't", "x1y", " ", "漢字", "kiwi"]
    rng = np.random.default_rng(4)
    docs = [(" ".join(rng.choice(words, rng.integers(0, 9))), ["en", "de"][i % 2], f"s{i % 5 if i % 3 else 0}") for i in range(160)]
    docs += [("pear kiwi", "en", "s0")] * 60 + [(None, "en", None), ("", None, "s1"), (None, None, None), ("only once", "fr", "solo"),
                                                ("kiwi " * 4000 + "\x00end", "en", "long"), ("Apple", "en", "é")]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "text string, lang string, source string, term int, docs string")
    got = sorted(tuple(r) for r in source_divergence.source_divergence(df).collect())
    assert got == audit(docs, 10, 10)
    assert any(r[2] == "pair" and r[4] == 0 and r[0] == "" for r in got)
    assert source_divergence.source_divergence(df.where("false")).collect() == []


def test_shares_are_exact_beyond_longs():
    big = np.array([10**15, 0], dtype=np.int64)
    assert source_divergence.shares(big, 10**15, 2).tolist() == [1 + 10**9 * (10**15 + 2) // (10**15 + 4), 1]
