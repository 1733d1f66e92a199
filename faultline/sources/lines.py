"""Batch scan of log files: lines in order, with numbers and byte offsets, whatever the number of splits.

Numbers and offsets are prefix sums in two levels: within a split, and over the splits of a file (one row each),
so no file goes through one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered(lines: DataFrame) -> DataFrame:
    """Adds line_no (from 1) and offset to (source_id, block, pos, raw, size): pos orders a block's lines, blocks
    order a source's."""
    within = Window.partitionBy("source_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("source_id", "block").agg(F.count("*").alias("_n"), F.sum("size").alias("_bytes"))
    before = Window.partitionBy("source_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("source_id", "block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_b0"))
    ranked = lines.withColumns({"_k": F.count("*").over(within), "_o": F.coalesce(F.sum("size").over(within), F.lit(0))})
    joined = ranked.join(blocks, ["source_id", "block"])
    return joined.withColumns({"line_no": F.col("_n0") + F.col("_k") + 1, "offset": F.col("_b0") + F.col("_o")}).drop("_k", "_o", "_n0", "_b0", "pos")


@dataclass(frozen=True)
class Log:
    """Log files as framing takes them: lines (tag, block, raw) as they are scanned, and the files they come from
    (tag, source_id, file_size).  A partition's rows are whole blocks, each in its order."""

    lines: DataFrame
    sources: DataFrame


def scan_log(spark: SparkSession, path: str | list[str]) -> Log:
    """A file's lines carry a hash of its name; names and sizes come from the listing, not with each line."""
    name = F.col("_metadata.file_path")
    lines = spark.read.option("lineSep", "\n").text(path).select(F.xxhash64(name).alias("tag"), F.col("_metadata.file_block_start").alias("block"), F.concat(F.col("value").cast("binary"), F.lit(b"\n")).alias("raw"))
    files = spark.read.format("binaryFile").load(path).select(F.xxhash64(name).alias("tag"), name.alias("source_id"), F.col("_metadata.file_size").alias("file_size"))
    return Log(lines, files)


def in_order(lines: DataFrame) -> Log:
    """Numbered lines (``read_log``, ``from_text``) for framing: one shuffle puts each block in order."""
    whole = F.concat(F.col("raw"), F.when(F.col("ended"), F.lit(b"\n")).otherwise(F.lit(b"")))
    rows = lines.select(F.xxhash64("source_id").alias("tag"), "block", "line_no", whole.alias("raw"))
    rows = rows.repartition("tag", "block").sortWithinPartitions("tag", "block", "line_no").drop("line_no")
    return Log(rows, lines.select(F.xxhash64("source_id").alias("tag"), "source_id", F.lit(None).cast("long").alias("file_size")).distinct())


def read_log(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(source_id, block, line_no, offset, raw, size, ended): a row per line; raw has no newline, size counts it,
    ended says whether there is one.  Files are split only at newlines; bytes are kept as they are."""
    scan = spark.read.option("lineSep", "\n").text(path)
    rows = scan.select(
        F.col("_metadata.file_path").alias("source_id"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("_size"),
        F.monotonically_increasing_id().alias("pos"), F.col("value").cast("binary").alias("raw"),
    ).withColumn("size", F.octet_length("raw").cast("long") + 1)
    out = numbered(rows)
    # the scan does not say whether the last line had a newline; the file's size does
    ended = F.col("offset") + F.col("size") <= F.col("_size")
    return out.withColumn("ended", ended).withColumn("size", F.col("size") - F.when(F.col("ended"), 0).otherwise(1)).drop("_size")


def from_text(logs: DataFrame, source: str, text: str) -> DataFrame:
    """The same lines from a table that holds one whole log per row."""
    lines = F.split(F.col(text), "\n", -1)
    rows = logs.where(F.col(text).isNotNull()).select(F.col(source).cast("string").alias("source_id"), F.lit(0).cast("long").alias("block"), F.posexplode(lines).alias("pos", "_line"), F.size(lines).alias("_n"))
    rows = rows.withColumn("ended", F.col("pos") < F.col("_n") - 1).where("ended or _line != ''")
    return numbered(rows.select("source_id", "block", F.col("pos").cast("long").alias("pos"), F.col("_line").cast("binary").alias("raw"), (F.octet_length("_line") + F.when(F.col("ended"), 1).otherwise(0)).cast("long").alias("size"), "ended"))
