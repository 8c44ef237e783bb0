"""The listings table: its columns and the fixed values of the rules that run on it."""
from pyspark.sql import types as T

RID = "rid"

# The listings schema, in the order of the file.
LISTING_TYPES = {
    "brokered_by": "double",
    "status": "string",
    "price": "double",
    "bed": "double",
    "bath": "double",
    "acre_lot": "double",
    "street": "double",
    "city": "string",
    "state": "string",
    "zip_code": "double",
    "house_size": "double",
    "prev_sold_date": "string",
}
LISTING_COLUMNS = list(LISTING_TYPES)

# The status categories and the date format a clean record follows.
STATUSES = ["for_sale", "sold", "ready_to_build"]
DATE_PATTERN = r"^\d{4}-\d{2}-\d{2}$"

# Date rule.
MIN_DATE = "1900-01-02"
MAX_DATE = "2026-12-31"
SENTINEL_DATES = ["1900-01-01", "1970-01-01"]

# Duplicate rule. A listing is one home offered by one broker in one status.
LISTING_KEY = ["street", "city", "state", "zip_code", "brokered_by", "status"]
COMPARED = ["bed", "bath", "acre_lot", "house_size", "prev_sold_date"]
PRICE_TOLERANCE = 0.01

# Price rule (Iglewicz & Hoaglin 1993 for the scale and the threshold).
MODIFIED_Z_SCALE = 0.6745
MODIFIED_Z_THRESHOLD = 3.5
MAD_FLOOR_QUANTILE = 0.05
MIN_GROUP_SIZE = 20

# The older rules.
LEGACY_PROPERTY_KEY = ["brokered_by", "price", "bed", "bath", "acre_lot",
                       "street", "city", "state", "zip_code", "house_size"]
LEGACY_HOME_KEY = ["street", "city", "state", "zip_code", "house_size"]
LEGACY_PLACEHOLDERS = ["####", "0000-00-00", "1900-01-01", "nan", "null", "none",
                       "missing", "unknown", "n/a", "na"]
LEGACY_SPAN_DAYS = 365

# The address that identifies a property.
PROPERTY_KEY = ["street", "zip_code", "city", "state"]

# Price model.
MODEL_FEATURES = ["bed", "bath", "acre_lot", "house_size", "zip_code", "state_code", "status_code", "sold_year"]
MODEL_PRICE_RANGE = (10_000, 50_000_000)

# Text a CSV reader takes for a missing value.
NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
               "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def listing_struct(with_rid=True):
    fields = [T.StructField(RID, T.LongType(), False)] if with_rid else []
    for name, kind in LISTING_TYPES.items():
        fields.append(T.StructField(name, T.StringType() if kind == "string" else T.DoubleType()))
    return T.StructType(fields)
