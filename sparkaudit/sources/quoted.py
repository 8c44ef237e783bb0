"""CSV records that go on over line breaks inside quotes, read by many tasks.

A line belongs to the block of the file in which it begins. Every block counts its quotes; the parity of all quotes
before a block says whether it starts inside a quoted field, and from there every line knows the same of itself. A
record ends at the first line end outside quotes. Pieces of records that cross a block's end are put together afterwards.
"""
import csv
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import materialise

# task functions travel with their helpers, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WHOLE, TAIL, MIDDLE, HEAD = 0, 1, 2, 3
# Files whose headers may be broadcast.
FILES = 10_000
PIECE = "_file string, _block bigint, _seq bigint, _kind int, _text string"


def lines_of_files(spark, path):
    """Lines with the file and block they begin in; a line ends with \\n or \\r\\n."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), "value")


def quote_parity(lines):
    """Stored rows (_file, _block, odd_lines, inside): lines with an odd number of quotes, and whether the block begins
    inside quotes. One row per block: a file's blocks are as few beside its lines as the splits that Spark plans with."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = lines.groupBy("_file", "_block").agg(F.count_if(quotes % 2 == 1).alias("odd_lines"))
    inside = (F.sum("odd_lines").over(before) - F.col("odd_lines")) % 2 == 1
    return materialise(blocks.withColumn("inside", inside))


class Block:
    """Cuts the lines of one block, given batch by batch, into records and pieces of records."""

    def __init__(self, file, block, inside):
        self.file, self.block, self.inside, self.seq = file, block, inside, 0
        # lines of a record that is still open; of one that another block began, if the block begins inside quotes
        self.open, self.foreign = ([], True) if inside else (None, False)

    def cut(self, values):
        """Pieces (kind, text) that end in these lines."""
        odd = np.asarray(pc.count_substring(values, '"')) % 2 == 1
        ends = np.flatnonzero((np.cumsum(odd) + self.inside) % 2 == 0)      # lines that end outside quotes
        lines, start, out = values.to_pylist(), 0, []
        for end in ends.tolist():
            if self.open is None and end == start:
                out.append((WHOLE, lines[end]))
            else:
                text = "\n".join((self.open or []) + lines[start:end + 1])
                out.append((HEAD if self.foreign else WHOLE, text))
                self.open, self.foreign = None, False
            start = end + 1
        if start < len(lines):
            self.open = (self.open or []) + lines[start:]
        self.inside = bool((odd.sum() + self.inside) % 2)
        return out

    def rest(self):
        """The piece that the end of the block leaves open."""
        return [(MIDDLE if self.foreign else TAIL, "\n".join(self.open))] if self.open else []

    def batch(self, pieces):
        n = len(pieces)
        places = pa.array(range(self.seq, self.seq + n), pa.int64())
        self.seq += n
        return pa.RecordBatch.from_arrays(
            [pa.array([self.file] * n, pa.string()), pa.array([self.block] * n, pa.int64()), places,
             pa.array([k for k, _ in pieces], pa.int32()), pa.array([t for _, t in pieces], pa.string())],
            names=["_file", "_block", "_seq", "_kind", "_text"])


def pieces_of(lines, blocks):
    """(_file, _block, _seq, _kind, _text): whole records, and the pieces at the ends of blocks."""
    # only blocks that begin inside quotes are named to the tasks; at most as many as the splits that the driver plans
    inside = {(r["_file"], r["_block"]) for r in blocks.where("inside").select("_file", "_block").collect()}
    shared = lines.sparkSession.sparkContext.broadcast(inside)

    def run(batches):
        held = None
        for batch in batches:
            files, starts = batch["_file"].to_pylist(), batch["_block"].to_numpy()
            # lines of a block are neighbours, as a task reads its blocks one after another
            cuts = [0, *[i for i in range(1, len(files)) if starts[i] != starts[i - 1] or files[i] != files[i - 1]], len(files)]
            for low, high in zip(cuts, cuts[1:], strict=False):
                if low == high:
                    continue
                at = (files[low], int(starts[low]))
                if held is None or (held.file, held.block) != at:
                    if held is not None and held.open:
                        yield held.batch(held.rest())
                    held = Block(*at, at in shared.value)
                made = held.cut(batch["value"].slice(low, high - low))
                if made:
                    yield held.batch(made)
        if held is not None and held.open:
            yield held.batch(held.rest())
    return lines.mapInArrow(run, PIECE)


def records_of(pieces):
    """(_file, _block, _seq, _text): pieces joined into records, placed where the record begins."""
    pieces = materialise(pieces)
    ends = pieces.where(F.col("_kind") != WHOLE)
    # few rows: at most two per block
    order = Window.partitionBy("_file").orderBy("_block", F.col("_kind") == TAIL)
    begun = F.last(F.when(F.col("_kind") == TAIL, F.struct("_block", "_seq")), ignorenulls=True).over(order)
    joined = (ends.withColumn("_begun", begun).groupBy("_file", "_begun")
              .agg(F.array_sort(F.collect_list(F.struct("_block", "_text"))).alias("_parts"))
              .select("_file", F.col("_begun._block").alias("_block"), F.col("_begun._seq").alias("_seq"),
                      F.array_join(F.col("_parts._text"), "\n").alias("_text")))
    whole = pieces.where(F.col("_kind") == WHOLE).drop("_kind").unionByName(joined)
    text = F.regexp_replace(F.regexp_replace("_text", "\r\n", "\n"), "\r$", "")
    return whole.withColumn("_text", text).where(F.trim("_text") != "")


def read_quoted(spark, path, blocks=None, lines=None):
    """All columns of the CSV files as text, stored in file order; the header names them and is the same in every file.

    A record that does not have the header's columns is an error.
    """
    lines = lines_of_files(spark, path) if lines is None else lines
    records = materialise(records_of(pieces_of(lines, quote_parity(lines) if blocks is None else blocks)))
    first = F.min(F.struct("_block", "_seq", "_text"))
    headers = records.groupBy("_file").agg(first.alias("_first"))
    texts = [r[0] for r in headers.select("_first._text").distinct().limit(2).collect()]
    if len(texts) > 1:
        raise ValueError(f"the files of {path} do not have one header: {texts}")
    names = next(csv.reader(texts[0].split("\n"))) if texts else []
    if not names:
        raise ValueError(f"no header in {path}")
    header = F.struct("_block", "_seq") == F.struct(F.col("_first._block"), F.col("_first._seq"))
    body = records.join(F.broadcast(headers) if headers.count() <= FILES else headers, "_file").where(~header)
    # the order of files, blocks and places becomes the order of the stored table's files and rows
    ordered = (body.repartitionByRange("_file", "_block", "_seq").sortWithinPartitions("_file", "_block", "_seq")
               .select(F.from_csv("_text", ", ".join(f"c{i} string" for i in range(len(names))),
                                  {"quote": '"', "escape": '"', "mode": "FAILFAST"}).alias("_r")))
    return materialise(ordered.select(*[F.col(f"_r.c{i}").alias(name) for i, name in enumerate(names)]))
