"""Line dedup: lines that many documents share are dropped from every document.

Lines are exploded and hashed, the distinct documents of each hash are counted, and every document is put together
again from its remaining lines by position.
"""
from pyspark.sql import functions as F

from ..session import materialise

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text):
    """The lines of a text; a missing or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hash(line):
    """128-bit hash of a line without blanks at its ends and in lower case (A-Z only); missing for a blank line."""
    key = F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)
    return F.when(key != "", F.md5(key))


def frequent_lines(docs, min_docs=10, text="text"):
    """Hashes of the lines found in at least ``min_docs`` documents. A row is a document; it counts once per line.

    Repeats inside a document go before the lines are exploded and counts are combined before the shuffle, so a line
    that every document has costs one row per task.
    """
    hashes = F.array_distinct(F.transform(lines_of(F.col(text)), line_hash))
    return (docs.select(F.explode(hashes).alias("_line")).where(F.col("_line").isNotNull())
            .groupBy("_line").agg(F.count(F.lit(1)).alias("_docs")).where(F.col("_docs") >= min_docs))


def drop_frequent_lines(docs, min_docs=10, text="text"):
    """``docs`` with the shared lines taken out of ``text``, and the lines ``n_lines`` before and ``n_dropped``.

    Every input row gives one output row with all its columns; columns named ``n_lines`` or ``n_dropped`` are replaced.
    A missing text becomes an empty one (one line, none dropped). Blank lines are never dropped. Repeated rows are
    documents of their own. An empty table gives an empty table.

    The table of shared lines is stored first, so Spark knows its size: small, it is broadcast; large, lines and
    hashes meet by hash and Spark splits the partition of a very common line.
    """
    shared = materialise(frequent_lines(docs, min_docs, text).select("_line", F.lit(True).alias("_shared")))
    others = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rest = F.struct(*[F.col(c) for c in others if c != text], F.lit(0).alias("_none"))
    lines = (docs.withColumn("_row", F.monotonically_increasing_id())
             .select("_row", rest.alias("_rest"), F.posexplode(lines_of(F.col(text))).alias("_pos", "_text"))
             .select("_row", F.when(F.col("_pos") == 0, F.col("_rest")).alias("_rest"), "_pos", "_text",
                     line_hash(F.col("_text")).alias("_line")))
    kept = F.when(F.col("_shared").isNull(), F.struct("_pos", "_text"))
    whole = (lines.join(shared, "_line", "left").groupBy("_row")
             .agg(F.first("_rest", ignorenulls=True).alias("_rest"), F.count(F.lit(1)).alias("n_lines"),
                  F.count("_shared").alias("n_dropped"), F.collect_list(kept).alias("_kept")))
    joined = F.array_join(F.transform(F.array_sort("_kept"), lambda x: x["_text"]), "\n")
    return whole.select(*[joined.alias(c) if c == text else F.col("_rest")[c].alias(c) for c in others],
                        "n_lines", "n_dropped")
