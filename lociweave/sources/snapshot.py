"""Files read once, with the digest of the very bytes that were read, and what a run that resumes has still to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave.functions.sequences import safe_id


def stamps(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, modified) of files as they are now; no content is read."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def snapshot(spark: SparkSession, path: str, work: str, **parsed: Column) -> DataFrame:
    """(path, size, modified, sha256) and the parsed columns of every file, as a table under work.

    parsed: expressions of content, the bytes; they and the digest come from one read of a file, which has to fit in a
    row.  A file that was changed, came or went while files were read raises.  Runs jobs when called.
    """
    files = spark.read.format("binaryFile").load(path)
    read = files.select(
        "path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"),
        F.octet_length("content").alias("__read"), *[c.alias(n) for n, c in parsed.items()],
    )
    read.write.mode("errorifexists").parquet(work)
    table = spark.read.parquet(work)
    if odd := changed(table, stamps(spark, path)).orderBy("path").first():
        raise ValueError(f"{odd['path']} was {odd['fault']} while files were read")
    return table.drop("__read")


def changed(read: DataFrame, now: DataFrame) -> DataFrame:
    """(path, fault) of files whose stamps (path, size, modified) differ, or of which other than size bytes were read (__read)."""
    then = read.select("path", F.col("size").alias("size_then"), F.col("modified").alias("modified_then"), "__read")
    both = then.join(now.select("path", "size", "modified"), "path", "full_outer")
    fault = (
        F.when(F.col("size_then").isNull(), "added").when(F.col("size").isNull(), "removed")
        .when((F.col("size") != F.col("size_then")) | (F.col("modified") != F.col("modified_then")) | (F.col("__read") != F.col("size_then")), "changed")
    )
    return both.select("path", fault.alias("fault")).where("fault is not null")


def mapping_rows(lines: DataFrame) -> DataFrame:
    """(original_id, renamed_id) of lines (line, value) of tab-separated mappings; both ids are made safe, comments and empty lines aside."""
    cut = F.split("value", "\t")
    return lines.where("value != '' and not startswith(value, '#')").select("line", F.size(cut).alias("columns"), safe_id(F.get(cut, F.lit(0))).alias("original_id"), safe_id(F.get(cut, F.lit(1))).alias("renamed_id"))


def mapping_faults(rows: DataFrame) -> DataFrame:
    """(line, fault) of mapping_rows(): lines without a second column, and ids with two different names, at the later line."""
    short = rows.where("columns < 2").select("line", F.lit("two columns are needed").alias("fault"))
    named = rows.where("columns > 1").groupBy("original_id").agg(F.count_distinct("renamed_id").alias("names"), F.max("line").alias("line")).where("names > 1")
    return short.union(named.select("line", F.concat(F.lit("more than one name for "), "original_id")))


def mapping_snapshot(spark: SparkSession, path: str, work: str) -> tuple[DataFrame, DataFrame]:
    """(mapping, signature) of a mapping file: original_id and renamed_id; path, size, modified and sha256 of the bytes that it was parsed from.

    Raises if the file changes while it is read, a line lacks its second column, or an id has two names.
    """
    table = snapshot(spark, path, work, text=F.decode("content", "utf-8"))
    lines = table.select(F.posexplode(F.split("text", r"\r\n|\r|\n"))).select((F.col("pos") + 1).alias("line"), F.col("col").alias("value"))
    rows = mapping_rows(lines)
    if bad := mapping_faults(rows).orderBy("line").first():
        raise ValueError(f"{path}:{bad['line']}: {bad['fault']}")
    return rows.select("original_id", "renamed_id").distinct(), table.drop("text")


def to_resume(wanted: DataFrame, manifest: DataFrame, now: DataFrame) -> DataFrame:
    """(unit, reason) of the units of a run that aren't done: the others are skipped.

    wanted: unit, version, input_sha256, configuration.  manifest: the same of what was done, with output and
    output_sha256, a row per output (null if a unit has none).  now: output, sha256 of the files that are there.  A unit
    is done if everything it was made from is the same and all its outputs are there as they were written; reason is
    the first difference of: new, version, input, configuration, output missing, output changed.
    """
    outputs = manifest.join(now.select("output", F.col("sha256").alias("__now")), "output", "left")
    missing = F.col("output").isNotNull() & F.col("__now").isNull()
    differs = F.coalesce(F.col("__now") != F.col("output_sha256"), F.lit(False))
    made = ["version", "input_sha256", "configuration"]
    done = outputs.groupBy("unit").agg(*[F.max(c).alias(f"done_{c}") for c in made], F.bool_or(missing).alias("missing"), F.bool_or(differs).alias("differs"))
    joined = wanted.join(done, "unit", "left")
    unlike = lambda c: ~F.col(c).eqNullSafe(F.col(f"done_{c}"))
    reason = (
        F.when(F.col("missing").isNull(), "new").when(unlike("version"), "version").when(unlike("input_sha256"), "input").when(unlike("configuration"), "configuration")
        .when(F.col("missing"), "output missing").when(F.col("differs"), "output changed")
    )
    return joined.select("unit", reason.alias("reason")).where("reason is not null")
