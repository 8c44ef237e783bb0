"""Quality classifier: document evidence from linear models, host and path-level beliefs by hierarchical empirical Bayes.

The models give every document a probability of being good. Their sums by path and host, shrunk step by step towards
the global share, are the prior odds that the document's own evidence is combined with.
"""
from pyspark.sql import functions as F

from ..operators.scale import attach, beside
from ..session import materialise, stored_rows
from .text_model import ends, fit_classes, hash_share, letter_words, with_features

# Labelled documents the models are fitted on, at most (a sample by hash).
SAMPLE = 10_000
LEAST, MOST = 1.0, 1e6


def shape_tokens(text):
    """Coarse shares of symbols, capitals, bars and repeated words, as tokens."""
    plain = F.coalesce(text, F.lit(""))
    size = F.greatest(F.length(plain), F.lit(1))
    words = F.filter(F.split(plain, r"\s+"), lambda w: w != "")
    share = lambda pattern: (size - F.length(F.regexp_replace(plain, pattern, ""))) / size
    level = lambda name, x: F.concat(F.lit(f"#{name}"), F.floor(F.sqrt(x) * 8).cast("string"))
    return F.array(level("symbol", share(r"[^\p{L}\p{M}\p{N}\s.,;:'\"()?-]+")), level("upper", share(r"\p{Lu}+")),
                   level("digit", share(r"\p{N}+")), level("bar", share(r"[|]+")),
                   level("distinct", F.size(F.array_distinct(words)) / F.greatest(F.size(words), F.lit(1))))


def quality_tokens(text):
    words = letter_words(text)
    return F.concat(words, ends(words), shape_tokens(text))


def fit_share(train, label):
    """Probability of ``label`` = 1 given the features; where only one value was seen, that value for all."""
    seen = sorted(r[0] for r in train.select(label).distinct().collect())
    if len(seen) < 2:
        return lambda docs, out: docs.withColumn(out, F.lit(float(seen[0]) if seen else 0.5))
    model = fit_classes(train, label, iterations=60)
    return lambda docs, out: model(docs, "_both").withColumn(out, F.col("_both")[1]).drop("_both")


def document_evidence(docs, labels, id_col="doc_id", text="text", sample=SAMPLE):
    """``docs`` with ``p_doc``: the probability that a document is of good quality and not toxic, from its text alone.

    ``labels`` has ``id_col``, ``quality`` and ``toxic`` (0 or 1; a missing one counts as the good value); repeated
    labels of a document count once, the smallest first. A missing or blank text has probability 0.
    """
    labels = labels.where(F.col(id_col).isNotNull())
    share = F.lit(float(sample)) / F.greatest(F.lit(labels.count()), F.lit(1))
    taken = (labels.where(hash_share(F.col(id_col)) < share).groupBy(F.col(id_col).alias("_lid"))
             .agg(F.coalesce(F.min("quality"), F.lit(1)).cast("double").alias("_quality"),
                  F.coalesce(F.max("toxic"), F.lit(0)).cast("double").alias("_toxic")))
    texts = docs.select(F.col(id_col).alias("_lid"), F.col(text).alias("_text")).join(F.broadcast(taken), "_lid")
    train = materialise(with_features(texts, quality_tokens(F.col("_text"))).select("_x", "_quality", "_toxic"))
    scored = with_features(docs, quality_tokens(F.col(text)))
    scored = fit_share(train, "_quality")(scored, "_pq")
    scored = fit_share(train, "_toxic")(scored, "_pt")
    good = F.when(F.trim(F.coalesce(F.col(text), F.lit(""))) != "", F.col("_pq") * (1 - F.col("_pt"))).otherwise(0.0)
    return scored.withColumn("p_doc", good).drop("_x", "_pq", "_pt")


def strength(groups):
    """Weight of the level above, in documents, by the method of moments; one row ``_m``.

    ``groups`` has each group's size ``_n`` and mean ``_mean`` and the mean ``_up`` it is shrunk towards. Groups that
    differ no more than chance allows give the largest weight.
    """
    n, spread = F.col("_n"), F.col("_up") * (1 - F.col("_up"))
    total = groups.agg(F.sum(n * (F.col("_mean") - F.col("_up")) ** 2).alias("q"), F.sum(spread).alias("s"),
                       (F.sum(n) - F.sum(n * n) / F.sum(n)).alias("d"), F.avg(spread).alias("v"))
    between = F.greatest((F.col("q") - F.col("s")) / F.col("d"), F.lit(0.0))
    weight = F.when((F.col("d") > 0) & (between > 0), F.col("v") / between - 1).otherwise(F.lit(MOST))
    return total.select(F.least(F.greatest(weight, F.lit(LEAST)), F.lit(MOST)).alias("_m"))


def shrunk(groups):
    """Adds ``_post``: the mean of each group drawn towards ``_up`` by the weight of its level."""
    m = F.col("_m")
    return (beside(groups, strength(groups))
            .withColumn("_post", (F.col("_sum") + m * F.col("_up")) / (F.col("_n") + m)))


def site_beliefs(scored, host="host", path="path"):
    """One row per (``host``, ``path``): its size and sum, the belief ``_up`` of its host, the weight ``_m``, the global mean.

    Sums by path are combined before the shuffle; hosts and the whole are sums of those.
    """
    paths = materialise(scored.groupBy(host, path).agg(F.count(F.lit(1)).alias("_n"), F.sum("p_doc").alias("_sum")))
    hosts = paths.groupBy(host).agg(F.sum("_n").alias("_n"), F.sum("_sum").alias("_sum"))
    whole = paths.agg((F.sum("_sum") / F.sum("_n")).alias("_up"))
    hosts = materialise(beside(hosts, whole).withColumn("_mean", F.col("_sum") / F.col("_n")))
    hosts = materialise(shrunk(hosts).select(host, F.col("_post").alias("_host"), F.col("_up").alias("_all"), F.col("_n").alias("_size")))
    paths = attach(paths, hosts, [host], "_size", stored=True)
    paths = materialise(paths.withColumn("_mean", F.col("_sum") / F.col("_n")).withColumn("_up", F.col("_host")))
    return beside(paths, strength(paths)).select(host, path, "_n", "_sum", "_up", "_m", "_all")


def logit(p):
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.ln(q / (1 - q))


def classify_quality(docs, labels, host, path, id_col="doc_id", text="text", threshold=0.5):
    """One row for each input row: ``id_col``, ``p_doc``, ``p_site``, ``score`` and ``keep``.

    ``p_site`` is the share of good documents on the row's path without the row itself, drawn towards its host and that
    towards all documents. ``score`` combines its odds, relative to the global share, with the document's evidence;
    ``keep`` where it is at least ``threshold``. A missing host or path is the empty one. Without labels every ``p_doc``
    is 0.5. Repeated rows are documents of their own; an empty table gives an empty result.
    """
    level = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    source = docs.select(F.col(id_col).alias("_id"), level(host).alias("host"), level(path).alias("path"), F.col(text).alias("_text"))
    named = labels.select(F.col(id_col).alias("_id"), "quality", "toxic")
    scored = materialise(document_evidence(source, named, "_id", "_text").select("_id", "host", "path", "p_doc"))
    if not stored_rows(scored):
        sites = scored.select("host", "path", F.lit(1).alias("_n"), *[F.lit(0.5).alias(c) for c in ("_sum", "_up", "_m", "_all")])
    else:
        sites = site_beliefs(scored)
    joined = attach(scored, sites, ["host", "path"], "_n")
    others = (F.col("_sum") - F.col("p_doc") + F.col("_m") * F.col("_up")) / (F.col("_n") - 1 + F.col("_m"))
    joined = joined.withColumn("p_site", F.least(F.greatest(others, F.lit(0.0)), F.lit(1.0)))
    odds = logit(F.col("p_doc")) + logit(F.col("p_site")) - logit(F.col("_all"))
    scored = joined.withColumn("score", 1 / (1 + F.exp(-odds)))
    return scored.select(F.col("_id").alias(id_col), "p_doc", "p_site", "score", (F.col("score") >= threshold).alias("keep"))
