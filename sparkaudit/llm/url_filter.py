"""URL filters: pattern rules indexed by their rarest literal token.

The tokens of a URL fetch the rules that are indexed by one of them, and only those rules run their regular expression.
Everything is a DataFrame expression.
"""
import re
from dataclasses import dataclass

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise, stored_rows

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
TOKEN_GAP = "[^0-9A-Za-z]+"
# Rows of the rule index that may be broadcast (about 20 MB at 200 bytes a rule).
BROADCAST_RULES = 100_000
RULES = "rule string, pattern string, verdict string, priority int, literals array<string>"


@dataclass(frozen=True)
class Rule:
    """A pattern over host and path. ``literals`` are tokens that every match holds whole, between token gaps."""
    rule: str
    pattern: str
    verdict: str
    priority: int
    literals: tuple


def site_rule(site, verdict):
    """The rule ``host/path``: fits the host and its subdomains where the path starts with the rule's path.

    The longest fitting site rule wins, and any site rule wins over the other patterns.
    """
    host, slash, path = site.partition("/")
    host = host.translate(str.maketrans(UPPER, LOWER))
    literals = [t for t in re.split(TOKEN_GAP, host) if t]
    # the last token of the path may go on in the URL, so it is no whole token unless a gap ends it
    literals += [t for t in re.split(TOKEN_GAP, (slash + path))[:-1] if t]
    pattern = rf"(?s)^(?:[^/]*\.)?{re.escape(host)}{re.escape(slash + path)}"
    return Rule(site, pattern, verdict, 1000 + len(site), tuple(literals))


def word_rule(word, verdict="block"):
    """A pattern of the method itself: the word or hyphenated words between non-alphanumeric characters of the host."""
    tokens = tuple(t for t in re.split(TOKEN_GAP, word) if t)
    body = "[^0-9A-Za-z/]".join(re.escape(t) for t in tokens)
    return Rule(f"~{word}", rf"(?s)^(?:[^/]*[^0-9A-Za-z/])?{body}(?:[^0-9A-Za-z].*)?$", verdict, 1, tokens)


def rule_table(spark, rules):
    """Rules as a table; a large rule list can be any table with the columns of ``RULES``."""
    return spark.createDataFrame([(r.rule, r.pattern, r.verdict, r.priority, list(r.literals)) for r in rules], RULES)


def with_parts(urls, url="url"):
    """Adds ``host`` (A-Z in lower case) and ``path``; both empty for a missing URL or one without ``://``."""
    part = lambda n: F.coalesce(F.regexp_extract(F.col(url), URL, n), F.lit(""))
    return urls.withColumns({"host": F.translate(part(1), UPPER, LOWER), "path": part(2)})


def url_tokens(host, path):
    """Distinct tokens, and the empty token under which rules without a literal are indexed."""
    return F.array_distinct(F.concat(F.split(F.concat(host, path), TOKEN_GAP), F.array(F.lit(""))))


def rule_index(urls, rules):
    """The rules with the column ``token``: their literal that the fewest URLs hold (ties: the smaller token).

    Counts cover all URLs; they are combined before the shuffle and kept for tokens of rules alone.
    """
    wanted = rules.select(F.explode("literals").alias("token")).distinct()
    counts = (urls.select(F.explode(url_tokens(F.col("host"), F.col("path"))).alias("token"))
              .groupBy("token").count().join(wanted, "token", "left_semi"))
    order = F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token")
    rarest = (rules.select("rule", F.explode("literals").alias("token")).join(counts, "token", "left")
              .groupBy("rule").agg(F.min(order)["token"].alias("token")))
    return (rules.join(rarest, "rule", "left")
            .select("rule", "pattern", "verdict", "priority", F.coalesce("token", F.lit("")).alias("token")))


def judge_urls(urls, rules, default="allow", url="url"):
    """The rows of ``urls`` with ``host``, ``path``, ``rule`` (that decided, or missing) and ``verdict``.

    The fitting rule of the highest priority decides (ties: the smaller rule); without one the verdict is ``default``.
    Every row is judged, repeated rows each for itself; a missing URL has an empty host and fits no rule that needs
    a token. Columns with the four result names are replaced; any other name may occur. Rule names are unique; an empty rule
    table is allowed.
    """
    results = ["host", "path", "rule", "verdict"]
    others = [c for c in urls.columns if c not in results]
    # other columns travel as one, so their names meet no name of the index
    packed = urls.select(F.struct(*[F.col(f"`{c}`") for c in others], F.lit(0).alias("_none")).alias("_others"), F.col(url).alias("_url"))
    parts = with_parts(packed, "_url").drop("_url")
    index = materialise(rule_index(parts, rules))
    side = F.broadcast(index) if stored_rows(index) <= BROADCAST_RULES else index
    found = (parts.withColumn("_row", F.monotonically_increasing_id())
             .select("*", F.explode(url_tokens(F.col("host"), F.col("path"))).alias("token"))
             .join(side, "token", "left"))
    fits = F.when(F.expr("rlike(concat(host, path), pattern)"),
                  F.struct((-F.col("priority")).alias("order"), "rule", "verdict"))
    # all rows of a URL come from one task, so they meet before the shuffle
    best = found.select("_row", F.struct("_others", "host", "path").alias("_url"), fits.alias("_fit"))
    best = best.groupBy("_row").agg(F.first("_url").alias("_url"), F.min("_fit").alias("_fit"))
    return best.select(*[F.col("_url._others")[c].alias(c) for c in others], F.col("_url.host").alias("host"), F.col("_url.path").alias("path"),
                       F.col("_fit")["rule"].alias("rule"),
                       F.coalesce(F.col("_fit")["verdict"], F.lit(default)).alias("verdict"))
