"""Source divergence audit: how far the words of the sources of a language lie apart, and which words do it.

Tasks fold whole documents into stripes, term -> (documents, occurrences by source), and spill them when they hold
many. Stripes of a term are merged by key, and the merged stripes give the divergences of all pairs of sources at once.
"""
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.scale import attach
from ..session import materialise

MIN_DOCS, TOP = 10, 10
# Entries (term and source) that a task folds before it spills, bytes of text split at a time, rows of a batch sent on.
ENTRIES, SLICE, BATCH = 200_000, 1 << 20, 20_000
# Numbers (term by source) of one bucket of merged stripes.
NUMBERS = 1 << 18
ONE = 1_000_000_000

STRIPE = "lang string, term string, docs bigint, sources array<string>, counts array<bigint>"
# Bytes that end a term become blanks; A-Z become lower case. A term is a run of ASCII letters and non-ASCII characters.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text):
    """Counts of the terms of a whole text, given as UTF-8 bytes, cut at blanks into slices of bounded size."""
    text = text.translate(LETTERS)
    if len(text) <= SLICE:
        return Counter(text.split())
    found, start = Counter(), 0
    while start < len(text):
        end = text.find(b" ", start + SLICE)
        end = len(text) if end < 0 else end
        found.update(text[start:end].split())
        start = end
    return found


def batches_of(stripes):
    rows = [(lang, term, docs, list(by), list(by.values())) for (lang, term), (docs, by) in stripes.items()]
    for start in range(0, len(rows), BATCH):
        lang, term, docs, sources, counts = zip(*rows[start:start + BATCH], strict=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(lang, pa.string()), pa.array([None if t is None else t.decode() for t in term], pa.string()),
             pa.array(docs, pa.int64()), pa.array(sources, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int64()))],
            names=["lang", "term", "docs", "sources", "counts"])


def fold(batches):
    """Stripes of the documents of a task. A stripe without a term lists the sources that a language has at all."""
    stripes, held = {}, 0
    for batch in batches:
        for lang, source, text in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), batch["text"], strict=True):
            found = terms_of(text.as_buffer().to_pybytes())
            found[None] = 0
            for term, n in found.items():
                stripe = stripes.get((lang, term))
                if stripe is None:
                    stripe = stripes[lang, term] = [0, {}]
                stripe[0] += 1
                by = stripe[1]
                if source in by:
                    by[source] += n
                else:
                    by[source] = n
                    held += 1
            if held >= ENTRIES:
                yield from batches_of(stripes)
                stripes, held = {}, 0
    yield from batches_of(stripes)


def merged_stripes(docs, text, lang, source, min_docs):
    """Stored stripes of the terms in at least ``min_docs`` documents of a language, and of its sources.

    Tasks send a term once, or once per spill, whatever its frequency. Stripes meet by (language, term); both
    aggregates work on that one distribution.
    """
    def plain(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    folded = docs.select(plain(lang).alias("lang"), plain(source).alias("source"),
                         plain(text).cast("binary").alias("text")).mapInArrow(fold, STRIPE)
    entry = F.posexplode(F.arrays_zip("sources", "counts")).alias("_at", "_entry")
    counted = (folded.repartition("lang", "term").select("lang", "term", "docs", entry)
               .groupBy("lang", "term", F.col("_entry.sources").alias("source"))
               .agg(F.sum("_entry.counts").alias("count"), F.sum(F.when(F.col("_at") == 0, F.col("docs"))).alias("docs")))
    whole = counted.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sort_array(F.collect_list(F.struct("source", "count"))).alias("stripe"))
    return materialise(whole.where((F.col("docs") >= min_docs) | F.col("term").isNull()))


def language_totals(stripes):
    """Per language: its sources in order, the occurrences ``n`` of kept terms in each, and the number ``v`` of kept terms."""
    kept = F.col("term").isNotNull()
    entries = stripes.select("lang", F.inline("stripe"))
    by_source = entries.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    sizes = stripes.groupBy("lang").agg(F.count_if(kept).alias("v"))
    listed = by_source.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("_groups"))
    return listed.join(sizes, "lang").select("lang", F.col("_groups.source").alias("sources"), F.col("_groups.n").alias("n"), "v")


def shares(counts, n, v):
    """1 + floor(10**9 * (count + 2) / (n + 2 v)), exactly; whole numbers of any size where longs would overflow."""
    if counts.size and int(counts.max()) > 9 * ONE - 3:
        counts = counts.astype(object)
    return (1 + (ONE * (counts + 2)) // (n + 2 * v)).astype(np.int64)


def distance(p, q):
    return (p - q) * (p - q) // (p + q)


def bucket_divergences(top):
    """A function of one bucket of a language's stripes: sums over its terms for every pair of sources, and the best
    ``top`` terms of every source."""
    def run(stripes, totals):
        columns = ["lang", "source", "part", "item", "value"]
        if totals.empty:
            return pd.DataFrame(columns=columns)
        about = totals.iloc[0]
        lang, v = about["lang"], int(about["v"])
        names, sizes = list(about["sources"]), [int(n) for n in about["n"]]
        place = {s: i for i, s in enumerate(names)}
        terms = stripes["term"].tolist()
        counts = np.zeros((len(names), len(terms)), dtype=np.int64)
        for t, (by, n) in enumerate(zip(stripes["sources"], stripes["counts"], strict=True)):
            counts[[place[s] for s in by], t] = n
        out = []
        if terms:
            p = np.stack([shares(c, n, v) for c, n in zip(counts, sizes, strict=True)])
            q = shares(counts.sum(axis=0), sum(sizes), v)
        for a, name in enumerate(names):
            sums = distance(p[a], p).sum(axis=1) if terms else np.zeros(len(names), dtype=np.int64)
            out += [(lang, name, "pair", other, int(s)) for b, (other, s) in enumerate(zip(names, sums, strict=True)) if b != a]
            if terms:
                more = np.flatnonzero((counts[a] > 0) & (p[a] > q))
                best = sorted((-int(f), terms[t].encode(), terms[t]) for t, f in zip(more, distance(p[a][more], q[more]), strict=True))
                out += [(lang, name, "term", term, -f) for f, _, term in best[:top]]
        return pd.DataFrame(out, columns=columns)
    return run


def source_divergence(docs, min_docs=MIN_DOCS, top=TOP, text="text", lang="lang", source="source"):
    """lang, source, part, item, value, rank: how each source of a language differs.

    Part ``pair``: every other source of the language (item) with the distance of the two (value), all ranks. Part
    ``term``: the ``top`` terms of the source (item) that the language as a whole uses less, by their share of the
    distance from it. Shares p are smoothed counts of the kept terms, those in ``min_docs`` documents of the language, in
    billionths; the distance of two is the sum of floor((p-q)**2/(p+q)). All arithmetic is exact. Ranks follow falling
    value, then the item's UTF-8 bytes.

    A missing text, language or source is ''. Repeated rows are documents of their own. A language without kept terms
    gives pairs of value 0, one with a single source only terms, an empty table an empty result. Other columns are not
    looked at.

    A stripe holds at most as many entries as the language has sources, and so does the result per source. Buckets of
    merged stripes are bounded in numbers (term by source); their sums are added afterwards.
    """
    stripes = merged_stripes(docs, text, lang, source, min_docs)
    totals = materialise(language_totals(stripes))
    buckets = F.greatest(F.lit(1), F.ceil(F.col("v") * F.size("sources") / NUMBERS)).cast("int")
    dealt = totals.withColumn("bucket", F.explode(F.sequence(F.lit(0), buckets - 1)))
    sizes = totals.select("lang", buckets.alias("_buckets"), "v")
    held = (attach(stripes.where("term IS NOT NULL"), sizes, ["lang"], "v", stored=True)
            .select("lang", "term", F.col("stripe.source").alias("sources"), F.col("stripe.count").alias("counts"),
                    F.pmod(F.xxhash64("term"), F.col("_buckets")).cast("int").alias("bucket")))
    sums = (held.groupBy("lang", "bucket").cogroup(dealt.groupBy("lang", "bucket"))
            .applyInPandas(bucket_divergences(top), "lang string, source string, part string, item string, value bigint"))
    added = sums.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = added.withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top))
