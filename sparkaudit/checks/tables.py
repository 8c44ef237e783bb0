"""Input tables of the registered queries, as SQL that any engine runs over the given tables."""
from ..sources.listings import LISTINGS_SQL

# Listings whose sale dates lie 12 years later, so that swapped year digits can leave the plausible range.
RECENT_SQL = """
SELECT rid, brokered_by, status, price, bed, bath, acre_lot, street, city, state, zip_code, house_size,
  CASE WHEN prev_sold_date LIKE '199%'
       THEN CAST(CAST(SUBSTR(prev_sold_date, 1, 4) AS INT) + 12 AS STRING) || SUBSTR(prev_sold_date, 5)
       ELSE prev_sold_date END AS prev_sold_date
FROM {listings}
"""

# The defects that the listings are derived with, as labels.
LABELS_SQL = """
SELECT o_orderkey AS rid, 'invalid_date' AS family, 'date ' || CAST(o_orderkey % 401 AS STRING) AS subtype
FROM {orders} WHERE o_orderkey % 401 IN (12, 13, 14, 15)
UNION ALL
SELECT o_orderkey, 'price_unit', 'x1000' FROM {orders}
WHERE o_orderkey % 307 = 9 AND o_orderkey % 211 <> 3 AND o_orderkey % 101 <> 7
UNION ALL
SELECT o_orderkey, 'price_unit', 'zero' FROM {orders} WHERE o_orderkey % 211 = 3
UNION ALL
SELECT rid, 'duplicate', 'kind ' || CAST(kind AS STRING)
FROM (SELECT o_orderkey AS rid, CASE WHEN o_orderkey % 10 = 1 THEN CAST(((o_orderkey - 1) % 50) / 10 AS INT)
                                     WHEN o_orderkey % 10 = 0 THEN CAST((o_orderkey % 50) / 10 AS INT)
                                     ELSE -1 END AS kind FROM {orders}) k
WHERE kind >= 2
"""

# Listings as raw text with values that are no numbers and statuses that do not exist.
RAW_SQL = """
SELECT CAST(brokered_by AS STRING) AS brokered_by,
  CASE WHEN rid % 89 = 3 THEN 'pending' WHEN rid % 97 = 3 THEN NULL ELSE status END AS status,
  CASE WHEN rid % 71 = 1 THEN 'ask agent' ELSE CAST(price AS STRING) END AS price,
  CASE WHEN rid % 73 = 1 THEN city ELSE CAST(bed AS STRING) END AS bed,
  CAST(bath AS STRING) AS bath, CAST(acre_lot AS STRING) AS acre_lot, CAST(street AS STRING) AS street,
  city, state, CAST(zip_code AS STRING) AS zip_code,
  CASE WHEN rid % 79 = 1 THEN '1,500' ELSE CAST(house_size AS STRING) END AS house_size, prev_sold_date
FROM {listings}
"""

# Listings as text with quotes, backslashes and line breaks inside fields and texts that look like numbers but are none.
QUOTED_SQL = """
SELECT rid, CAST(brokered_by AS STRING) AS brokered_by, status,
  CASE WHEN rid % 13 = 4 THEN '12d' ELSE CAST(price AS STRING) END AS price,
  CASE WHEN rid % 17 = 5 THEN '7f' ELSE CAST(bed AS STRING) END AS bed, CAST(bath AS STRING) AS bath,
  CAST(acre_lot AS STRING) AS acre_lot, CAST(street AS STRING) AS street,
  CASE WHEN rid % 7 = 1 THEN chr(34) || city || chr(34) || 'Fallon, ' || chr(34)
       WHEN rid % 7 = 2 THEN city || chr(92)
       WHEN rid % 7 = 3 THEN city || chr(10) || 'Bay' ELSE city END AS city,
  state, CAST(zip_code AS STRING) AS zip_code, CAST(house_size AS STRING) AS house_size, prev_sold_date
FROM {listings}
"""

LISTINGS = LISTINGS_SQL.format(orders="orders")
RECENT = RECENT_SQL.format(listings="listings")
LABELS = LABELS_SQL.format(orders="orders")
RAW = RAW_SQL.format(listings="listings")
QUOTED = QUOTED_SQL.format(listings="listings")
