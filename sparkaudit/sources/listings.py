"""Reading listings: a raw CSV, a Parquet table, or the listings derived from the order tables."""
from pyspark.errors import AnalysisException
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.columns import not_nan, number_or_null
from ..operators.scale import attach
from ..schema import LISTING_COLUMNS, LISTING_TYPES, NULL_TOKENS, RID
from .quoted import lines_of_files, quote_parity, read_quoted

# Listings derived from ``orders``, with defects of every family at known keys. Plain SQL that runs on any engine.
LISTINGS_SQL = """
SELECT r.o_orderkey AS rid,
  CASE WHEN r.home % 97 = 5 THEN NULL ELSE CAST(r.home % 40 AS DOUBLE) END AS brokered_by,
  CASE WHEN r.kind IN (0, 1) THEN 'sold'
       WHEN r.home % 10 = 0 THEN 'for_sale'
       WHEN r.home % 10 = 9 THEN 'ready_to_build'
       WHEN r.home % 2 = 0 THEN 'sold' ELSE 'for_sale' END AS status,
  CASE WHEN r.o_orderkey % 211 = 3 THEN CAST(0.0 AS DOUBLE)
       WHEN r.o_orderkey % 101 = 7 THEN NULL
       WHEN r.o_orderkey % 307 = 9 THEN ROUND(h.o_totalprice, 0) * 1000.0
       WHEN r.kind = 4 THEN ROUND(h.o_totalprice * 1.004, 0)
       ELSE ROUND(h.o_totalprice, 0) END AS price,
  CASE WHEN r.o_orderkey % 331 = 2 THEN CAST(99.0 AS DOUBLE) ELSE CAST(1 + r.home % 5 AS DOUBLE) END AS bed,
  CASE WHEN r.home % 83 = 6 THEN NULL ELSE CAST(1 + r.home % 3 AS DOUBLE) END AS bath,
  CAST(r.home % 17 AS DOUBLE) / CAST(8.0 AS DOUBLE) AS acre_lot,
  CASE WHEN r.home % 113 = 8 THEN NULL ELSE CAST(r.home AS DOUBLE) END AS street,
  'C' || CAST(h.o_custkey % 50 AS STRING) AS city,
  'S' || CAST(r.home % 20 AS STRING) AS state,
  CASE WHEN r.home % 127 = 4 THEN NULL
       WHEN r.home % 29 = 1 THEN CAST(90000 + r.home AS DOUBLE)
       ELSE CAST(10000 + r.home % 200 AS DOUBLE) END AS zip_code,
  CASE WHEN r.kind = 3 OR r.home % 37 = 2 THEN NULL
       ELSE CAST(800 + (r.home * 7) % 2400 AS DOUBLE) END AS house_size,
  CASE WHEN r.o_orderkey % 401 = 12 THEN '3019-04-02'
       WHEN r.o_orderkey % 401 = 13 THEN '0000-00-00'
       WHEN r.o_orderkey % 401 = 14 THEN 'unknown'
       WHEN r.o_orderkey % 401 = 15 THEN '1970-01-01'
       WHEN r.home % 10 = 9 OR r.home % 10 = 3 THEN NULL
       WHEN r.kind IN (0, 1) THEN CAST(CAST(r.o_orderdate AS DATE) AS STRING)
       ELSE CAST(CAST(h.o_orderdate AS DATE) AS STRING) END AS prev_sold_date
FROM (SELECT o.*,
             CASE WHEN o_orderkey % 10 = 1 THEN o_orderkey - 1 ELSE o_orderkey END AS home,
             CASE WHEN o_orderkey % 10 = 1 THEN CAST(((o_orderkey - 1) % 50) / 10 AS INT) ELSE -1 END AS kind
      FROM {orders} o) r
JOIN {orders} h ON h.o_orderkey = r.home
"""


def listings_from_orders(spark, folder):
    """The listings of a folder that holds the order tables."""
    return spark.sql(LISTINGS_SQL, orders=spark.read.parquet(f"{folder}/orders.parquet"))


def normalise(df):
    """One notion of missing: NaN becomes NULL in every floating-point column."""
    kinds = dict(df.dtypes)
    return df.select(*[not_nan(F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c)
                       for c in df.columns])


def read_raw_csv(spark, path, line_breaks=None):
    """Every column as text, with the texts that stand for a missing value nulled. Checks come later.

    The header names the columns, so missing or extra ones stay visible to the contract. Quotes inside a quoted field
    are doubled; a backslash is an ordinary character. Any file is split over tasks; one with line breaks inside quotes
    is cut into records first. ``line_breaks`` says whether there are any, and without it the quotes of each line are
    looked through first. A row that does not have the header's columns is an error, never a shifted or shortened record.
    """
    blocks = lines = None
    if line_breaks is None:
        lines = lines_of_files(spark, path)
        blocks = quote_parity(lines)
        line_breaks = not blocks.where("odd_lines > 0").isEmpty()
    if line_breaks:
        raw = read_quoted(spark, path, blocks, lines)
    else:
        raw = (spark.read.option("header", True).option("inferSchema", False).option("quote", '"').option("escape", '"')
               .option("mode", "FAILFAST").csv(path))
    return raw.select(*[F.when(~F.col(f"`{c}`").isin(NULL_TOKENS), F.col(f"`{c}`")).alias(c) for c in raw.columns])


def as_listing_type(column, name):
    """A column cast to the type that the listing column ``name`` has; a text that is no number becomes missing."""
    kind = LISTING_TYPES[name]
    return number_or_null(column.cast("string")) if kind == "double" else column.try_cast(kind)


def cast_listings(raw):
    """Text columns cast to the listing types; a text that is no number becomes missing."""
    kinds = dict(raw.dtypes)
    return normalise(raw.select(*[c for c in raw.columns if c not in LISTING_TYPES],
                                *[F.col(c).alias(c) if kinds[c] == LISTING_TYPES[c] else as_listing_type(F.col(c), c).alias(c)
                                  for c in LISTING_COLUMNS]))


def with_row_ids(df, name=RID):
    """File-order record ids 0, 1, 2, ... for a freshly scanned table; store the result so that they never change.

    Files count in the order of their paths, parts of a file by where they begin, records by their place in the part:
    Spark deals parts out to tasks by size. Ids are the place in the part plus the sizes of the parts before it, one
    count per part. A table that was not read from files counts in the order of its partitions.
    """
    try:
        part = df.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                         F.monotonically_increasing_id().alias("_mono"), *df.columns)
    except AnalysisException:
        part = df.select(F.lit("").alias("_file"), F.spark_partition_id().cast("bigint").alias("_block"),
                         F.monotonically_increasing_id().alias("_mono"), *df.columns)
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # one row per part of a file: small beside the table, and its size is checked before it is broadcast
    starts = (part.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_mono").alias("_first"))
              .select("_file", "_block", "_n", (F.sum("_n").over(before) - F.col("_n") - F.col("_first")).alias("_shift")))
    return (attach(part, starts, ["_file", "_block"], "_n")
            .select((F.col("_shift") + F.col("_mono")).alias(name), *df.columns))
