"""Registered queries of the subpackage: each applies one operator to its whole table."""
import os

from pyspark.sql import functions as F

import corpus_pipeline

from .decontaminate import find_overlaps
from .jaccard_join import similar_documents
from .language import identify_languages
from .line_dedup import drop_frequent_lines
from .main_text import extract_text
from .one_bit_search import nearest
from .pii import BASE, find_pii, span_list
from .pieces import decode, encode, load_vocabulary
from .quality import classify_quality
from .sharded_lloyd import CLUSTERS, DIMS, ROUNDS, cluster
from .source_divergence import source_divergence
from .top_k import top_k
from .url_filter import judge_urls, rule_table, site_rule, word_rule

# Model file of the public tokenizer; it is read where it is installed.
MODEL = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
# Fixed values of the URL query.
SITE_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"),
              ("com/de/", "block")]
SPAM_WORDS = ["adult", "casino", "cheap-pills", "escort", "free-bets", "gambling", "lottery", "poker", "porn",
              "replica-watches", "viagra", "xxx"]


def op1_quality(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    return classify_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), host="source", path="lang")


def op2_decontamination(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_top_k(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(rows, rows.where("vec_id % 50 = 0"))


def op4_pieces(spark, sf_dir):
    vocabulary = load_vocabulary(MODEL)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    encoded = encode(docs, vocabulary).withColumnRenamed("text", "original")
    same = F.col("text") == F.coalesce("original", F.lit(""))
    return decode(encoded, vocabulary).select("doc_id", "n_tokens", "ids", same.alias("round_trip"))


def op5_url_filter(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = [site_rule(*r) for r in SITE_RULES] + [word_rule(w) for w in SPAM_WORDS]
    judged = judge_urls(pages, rule_table(spark, rules))
    site = F.when(~F.col("rule").startswith("~"), F.col("rule"))
    return judged.select("page_id", "host", "path", site.alias("rule"), "verdict")


def op6_line_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_frequent_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op7_language(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify_languages(docs).select("doc_id", "held_out", "lang_pred", "score")


def op8_pii(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_pii(docs)
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("bigint")
    base = span_list(F.filter("pii", lambda s: s["kind"].isin(*BASE)))
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE],
                        F.sha2(base, 256).alias("base_sha256"), span_list(F.col("pii")).alias("spans"))


def op9_main_text(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract_text(pages).select("page_id", "url", "text", "n_chars")


def op10_jaccard_join(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return similar_documents(docs).select("doc_id", "class_id", "copy_of", "n_links")


def op11_clusters(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return cluster(rows).drop("centroid")


def op12_nearest(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(rows, rows.where("vec_id % 100 = 0"))


def op13_source_divergence(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source")
    return source_divergence(docs)


QUERIES = {f.__name__: f for f in (
    op1_quality, op2_decontamination, op3_top_k, op4_pieces, op5_url_filter, op6_line_dedup, op7_language, op8_pii,
    op9_main_text, op10_jaccard_join, op11_clusters, op12_nearest, op13_source_divergence)}
QUERIES["pipeline"] = corpus_pipeline.run

_WORDS = "|".join(w.replace("-", "[^0-9A-Za-z/]") for w in SPAM_WORDS)
_RULES = ", ".join(f"('{site}', '{site.split('/', 1)[0]}', '/{site.split('/', 1)[1]}', '{verdict}')" for site, verdict in SITE_RULES)

# Lloyd's rounds, one after another: assignment, then the floors of the means.
_NEAREST = """a{r} AS (SELECT r, arg_min(c, (d, c)) AS c, CAST(min(d) AS BIGINT) AS d FROM (
  SELECT v.r, m.c, sum((v.x - m.x) * (v.x - m.x)) AS d FROM l v JOIN m{r} m USING (i) GROUP BY v.r, m.c) GROUP BY r)"""
_MOVED = """s{r} AS (SELECT a.c, l.i, sum(l.x) AS s, count(*) AS n FROM a{p} a JOIN l USING (r) GROUP BY a.c, l.i),
m{r} AS (SELECT m.c, m.i, CAST(CASE WHEN s.n IS NULL THEN m.x ELSE (s.s - (((s.s % s.n) + s.n) % s.n)) // s.n END AS BIGINT) AS x
  FROM m{p} m LEFT JOIN s{r} s USING (c, i))"""
_ROUNDS = ",\n".join([_NEAREST.format(r=0)] + [
    f"{_MOVED.format(r=r, p=r - 1)},\n{_NEAREST.format(r=r)}" for r in range(1, ROUNDS + 1)])

ORACLES = {
    "op11_clusters": f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e
  FROM embeddings WHERE len(embedding) = {DIMS} AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
l AS MATERIALIZED (SELECT r, unnest(e) AS x, unnest(range({DIMS})) AS i FROM v),
m0 AS (SELECT c, unnest(e) AS x, unnest(range({DIMS})) AS i FROM (
  SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, e) - 1 AS INTEGER) AS c, e FROM v) WHERE c < {CLUSTERS}),
{_ROUNDS}
SELECT v.vec_id, a.c AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.d) OVER () AS BIGINT) AS inertia, h.h AS centroid_sha256
FROM a{ROUNDS} a JOIN v USING (r)
JOIN (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS h FROM m{ROUNDS} GROUP BY c) h USING (c)""",
    "op13_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS r, COALESCE(lang, '') AS lang, COALESCE(source, '') AS source,
  translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS MATERIALIZED (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
c AS MATERIALIZED (SELECT g.lang, g.source, k.term, COALESCE(n, 0) AS n FROM g JOIN kept k ON g.lang = k.lang
  LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL) o
  ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
p AS MATERIALIZED (SELECT *, CAST(1 + (1000000000::HUGEINT * (n + 2)) //
  (sum(n) OVER (PARTITION BY lang, source) + 2 * count(*) OVER (PARTITION BY lang, source)) AS BIGINT) AS p FROM c),
q AS (SELECT lang, term, CAST(1 + (1000000000::HUGEINT * (n + 2)) //
  (sum(n) OVER (PARTITION BY lang) + 2 * count(*) OVER (PARTITION BY lang)) AS BIGINT) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term)),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, COALESCE(f.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL
  SELECT p.lang, p.source, 'term', p.term, (p - q) * (p - q) // (p + q) FROM p JOIN q ON p.lang = q.lang AND p.term = q.term
  WHERE n > 0 AND p > q),
ranked AS (SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
  CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM u)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10""",
    "op3_top_k": """
WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.e, c.e)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "op5_url_filter": f"""
WITH u AS (
  SELECT row_number() OVER () AS r, page_id,
    translate(COALESCE(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    COALESCE(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
rules(rule, rule_host, rule_path, verdict) AS (VALUES {_RULES}),
best AS (
  SELECT u.r, arg_max(s.rule, length(s.rule)) AS rule, arg_max(s.verdict, length(s.rule)) AS verdict
  FROM u JOIN rules s ON (u.host = s.rule_host OR suffix(u.host, '.' || s.rule_host)) AND prefix(u.path, s.rule_path)
  GROUP BY u.r)
SELECT u.page_id, u.host, u.path, b.rule,
  COALESCE(b.verdict, CASE WHEN regexp_matches(u.host, '(?s)(^|[^0-9A-Za-z/])({_WORDS})($|[^0-9A-Za-z])') THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN best b USING (r)""",
    "op6_line_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(COALESCE(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
shared AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT k.doc_id, count(*) AS n_lines, count(s.key) AS n_dropped,
  sha256(COALESCE(string_agg(CASE WHEN s.key IS NULL THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM k LEFT JOIN shared s ON k.key = s.key GROUP BY k.r, k.doc_id""",
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
