"""What a supermatrix is made of, from its loci: no row of it is ever put together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociweave.functions.sequences import DNA_STATES, PROTEIN_STATES_REPORT, occurrences
from lociweave.model import check_seqtype
from lociweave.operators.concat import inclusion, taxa
from lociweave.operators.sites import site_classes_report

CLASSES = ("unresolved_only", "constant", "variable", "pis", "singleton")


def matrix_statistics(records: DataFrame, policy: str = "pad-gaps", seqtype: str = "nucl") -> DataFrame:
    """One row: taxa, loci, length, characters by kind with their shares, GC share of resolved bases, classes of columns.

    A column lies in one locus, and padding resolves nothing: the classes of a matrix are the sums over its loci,
    and padding adds to the missing characters only.  complete_codons is null unless seqtype is codon and the length
    a multiple of three; shares are null over nothing.
    """
    check_seqtype(seqtype)
    protein, seq = seqtype == "prot", F.upper("seq")
    states = PROTEIN_STATES_REPORT if protein else DNA_STATES
    counts = {"gaps": occurrences(seq, "-"), "missing": occurrences(seq, "?"), "resolved": occurrences(seq, states), "gc": occurrences(seq, "GC")}
    own = records.groupBy("locus").agg(*[F.sum(c).alias(k) for k, c in counts.items()])
    kept = inclusion(records, policy).where("status != 'skipped'").select("locus", "length", (F.size("missing") * F.col("length")).alias("padding"))
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("length", "padding", *counts, *CLASSES)]
    total = kept.join(own, "locus").join(site_classes_report(records, seqtype), "locus", "left").agg(F.count(F.lit(1)).alias("loci"), *sums)
    total = total.join(F.broadcast(taxa(records).agg(F.count(F.lit(1)).alias("taxa"))), F.lit(True))  # one row with one row
    total = total.withColumns({"cells": F.col("taxa") * F.col("length"), "missing": F.col("missing") + F.col("padding")})
    total = total.withColumn("ambiguous", F.expr("cells - resolved - gaps - missing"))
    share = lambda part, whole: F.try_divide(F.col(part).cast("double"), F.col(whole).cast("double"))
    whole_codons = F.when(F.col("length") % 3 == 0, F.floor(F.col("length") / 3)) if seqtype == "codon" else F.lit(None)
    return total.select(
        "taxa", "loci", "length", "cells", whole_codons.cast("long").alias("complete_codons"), F.col("gaps").alias("gap_characters"), F.col("missing").alias("missing_characters"),
        F.col("ambiguous").alias("ambiguous_characters"), share("gaps", "cells").alias("gap_ratio"), share("missing", "cells").alias("missing_ratio"), share("ambiguous", "cells").alias("ambiguous_ratio"),
        (F.lit(None).cast("double") if protein else share("gc", "resolved")).alias("gc_ratio"), *CLASSES,
    )


def inclusion_counts(status: DataFrame) -> DataFrame:
    """(status, n) of concat.inclusion rows: loci that are whole, padded and skipped."""
    return status.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def padding_faults(blocks: DataFrame, partitions: DataFrame, names: DataFrame) -> DataFrame:
    """(locus, taxon, fault): padding blocks that disagree with partitions (locus, start, end) or name no taxon of names, or come twice."""
    parts = partitions.select("locus", F.col("start").alias("from"), F.col("end").alias("to"))
    known = names.select("taxon", F.lit(True).alias("known"))
    times = blocks.groupBy("locus", "taxon").agg(F.count(F.lit(1)).alias("times"))
    joined = blocks.join(parts, "locus", "left").join(known, "taxon", "left").join(times, ["locus", "taxon"])
    fault = (
        F.when(F.col("from").isNull(), "unknown locus").when(F.col("known").isNull(), "unknown taxon").when(F.col("times") > 1, "twice")
        .when((F.col("start") != F.col("from")) | (F.col("end") != F.col("to")) | (F.col("length") != F.col("end") - F.col("start") + 1), "coordinates")
        .when(~F.col("fill_character").isin("?", "-"), "fill character")
    )
    return joined.select("locus", "taxon", fault.alias("fault")).where("fault is not null").distinct()


def inclusion_faults(status: DataFrame, partitions: DataFrame) -> DataFrame:
    """(locus, fault): loci that are kept without a partition, and partitions of loci that aren't kept."""
    kept = status.where("status != 'skipped'").select("locus", F.lit(True).alias("kept"))
    joined = kept.join(partitions.select("locus", F.lit(True).alias("placed")), "locus", "full_outer")
    fault = F.when(F.col("placed").isNull(), "no partition").when(F.col("kept").isNull(), "not included")
    return joined.select("locus", fault.alias("fault")).where("fault is not null")
