"""Property identity: which records describe the same address."""
from pyspark.sql import functions as F

from ..functions.columns import all_present
from ..schema import PROPERTY_KEY, RID


def property_id(key=PROPERTY_KEY, rid=RID):
    """An opaque id. Records with an incomplete address are a property of their own."""
    complete = all_present(key)
    return F.struct(*[F.when(complete, F.col(c)).alias(c) for c in key],
                    F.when(~complete, F.col(rid)).alias("lone"))


def property_text(pid="pid", key=PROPERTY_KEY):
    """The id as text, for hashing."""
    return F.concat_ws("|", *[F.col(pid)[c].cast("string") for c in [*key, "lone"]])


def with_property(df, key=PROPERTY_KEY):
    return df.withColumn("pid", property_id(key))


def property_sizes(df, key=PROPERTY_KEY):
    """(pid, n)."""
    return with_property(df, key).groupBy("pid").agg(F.count(F.lit(1)).alias("n"))


def size_distribution(df, key=PROPERTY_KEY):
    """How many properties have n records."""
    return property_sizes(df, key).groupBy("n").agg(F.count(F.lit(1)).alias("properties")).select(
        F.col("n").alias("records_per_property"), "properties")


def records_sharing_address(df, key=PROPERTY_KEY):
    """Records whose address another record has too, and the number of such addresses; no join back."""
    shared = property_sizes(df, key).where("n > 1")
    return shared.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.count(F.lit(1)).alias("addresses"))
