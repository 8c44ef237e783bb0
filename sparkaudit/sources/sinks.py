"""Writing results."""
from pyspark.sql import functions as F


def write_csv(df, path):
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df, path):
    df.write.mode("overwrite").json(path)


def write_lines(lines, path):
    """A short text whose lines keep their order: one file."""
    lines.orderBy("line_no").coalesce(1).select(F.col("line").alias("value")).write.mode("overwrite").text(path)
