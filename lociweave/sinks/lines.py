"""Export formats as tables of text, and writers for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociweave.functions.sequences import nexus_label

NEXUS_WIDTH = 70


def fasta(records: DataFrame, width: int | None = None) -> DataFrame:
    """(locus, record_order, text): a header line and the sequence, on one line or cut to width."""
    seq = F.col("seq") if width is None else F.regexp_replace("seq", f"(?s)(.{{{width}}})(?=.)", "$1\n")
    return records.select("locus", "record_order", F.concat(F.lit(">"), "seq_id", F.lit("\n"), seq).alias("text"))


def phylip(records: DataFrame, gap: str = "  ") -> DataFrame:
    """(locus, line_no, line): relaxed PHYLIP, line 0 the dimensions."""
    head = records.groupBy("locus").agg(F.concat_ws(" ", F.count(F.lit(1)), F.max(F.length("seq"))).alias("line"))
    body = records.select("locus", (F.col("record_order") + 1).cast("long").alias("line_no"), F.concat("seq_id", F.lit(gap), "seq").alias("line"))
    return head.select("locus", F.lit(0).cast("long").alias("line_no"), "line").unionByName(body)


def nexus_blocks(records: DataFrame, width: int = NEXUS_WIDTH) -> DataFrame:
    """(locus, block, record_order, line): interleaved rows, labels padded to the longest of the locus."""
    labelled = records.withColumn("label", nexus_label(F.col("seq_id")))
    widths = labelled.groupBy("locus").agg(F.max(F.length("label")).alias("w"))
    pieces = F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{width}}}"), F.lit(0))
    cut = labelled.join(widths, "locus").select("locus", "record_order", "label", "w", F.posexplode(pieces).alias("block", "piece"))
    return cut.select("locus", F.col("block").cast("long").alias("block"), "record_order", F.concat(F.rpad("label", F.col("w"), F.lit(" ")), F.lit(" "), "piece").alias("line"))


def nexus_head(records: DataFrame, datatype: str = "dna") -> DataFrame:
    """(locus, text): what precedes the blocks."""
    n, m = F.count(F.lit(1)), F.max(F.length("seq"))
    return records.groupBy("locus").agg(F.format_string(f"#NEXUS\n\nbegin data;\n  dimensions ntax=%d nchar=%d;\n  format datatype={datatype} missing=? gap=- interleave;\n  matrix", n, m).alias("text"))


def axt(pairs: DataFrame) -> DataFrame:
    """(locus, text) of loci with two records: both ids, then both sequences."""
    rows = F.sort_array(F.collect_list(F.struct("record_order", "seq_id", "seq")))
    two = pairs.groupBy("locus").agg(rows.alias("r")).where(F.size("r") == 2)
    first, second = F.get("r", F.lit(0)), F.get("r", F.lit(1))
    return two.select("locus", F.concat(F.lit(">"), first["seq_id"], F.lit("|"), second["seq_id"], F.lit("\n"), first["seq"], F.lit("\n"), second["seq"]).alias("text"))


def charsets(partitions: DataFrame, name: Column) -> DataFrame:
    """(locus, line): a charset of each partition."""
    return partitions.select("locus", F.concat(F.lit("    charset "), name, F.lit(" = "), F.col("start"), F.lit("-"), F.col("end"), F.lit(";")).alias("line"))


def partition_finder(partitions: DataFrame, name: Column) -> DataFrame:
    return partitions.select("locus", F.concat(name, F.lit(" = "), F.col("start"), F.lit("-"), F.col("end"), F.lit(";")).alias("line"))


def write_text(table: DataFrame, path: str, text: str, *order: str, mode: str = "errorifexists") -> None:
    """Text files in the order of the given columns: a range per task, so that the files' order is the order of the whole."""
    table.repartitionByRange(*order).sortWithinPartitions(*order).select(text).write.mode(mode).text(path)


def write_tsv(table: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Tab-separated with a header; nulls as NA."""
    columns = [F.coalesce(F.col(c).cast("string"), F.lit("NA")).alias(c) for c in table.columns]
    table.select(*columns).write.mode(mode).option("header", True).csv(path, sep="\t", quote="")
