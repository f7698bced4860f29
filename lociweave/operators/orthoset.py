"""A set of orthogroup sequence files, checked as a whole before any of it is written.

members: orthogroup, taxon, taxon_order, gene, gene_order; the orthogroups and taxa that were selected.
sequences: taxon, gene, seq; one row a gene.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociweave.functions.sequences import safe_id
from lociweave.operators.orthogroups import effective_length

#: The columns of the report of chosen copies.
SELECTION = ("orthogroup", "taxon", "gene_id", "length", "effective_length", "sequence_type", "selected")


@dataclass(frozen=True)
class OrthoSet:
    """rows: orthogroup, taxon_order, gene_order, export_id, taxon, gene, seq; faults: orthogroup, taxon, gene, fault; selection: SELECTION."""

    rows: DataFrame
    faults: DataFrame
    selection: DataFrame


def export_id(keep_taxon: bool = True) -> Column:
    """The name of a sequence in its orthogroup's file."""
    return F.concat_ws("_", safe_id(F.col("taxon")), "gene") if keep_taxon else F.col("gene")


def prepared(members: DataFrame, sequences: DataFrame, keep_taxon: bool = True, longest: bool = False, seqtype: str = "codon") -> OrthoSet:
    """The set of members, with the longest copy of each taxon alone if asked for, and all that is wrong with it.

    Faults: a gene without sequence, one that a taxon of a group names twice (where copies are chosen), a name with white
    space, a name that a group has twice, and one that stands for several taxa.  A set with faults is not to be written.
    The longest copy is the one with most unambiguous letters, then the smallest gene.
    """
    found = members.join(sequences.select("taxon", "gene", "seq"), ["taxon", "gene"], "left")
    missing = found.where("seq is null").select("orthogroup", "taxon", "gene", F.lit("no sequence").alias("fault"))
    held = found.where("seq is not null").withColumns({"export_id": export_id(keep_taxon), "effective_length": effective_length(F.col("seq"), seqtype)})
    best = held.groupBy("orthogroup", "taxon").agg(F.min(F.struct(-F.col("effective_length"), "gene"))["gene"].alias("best"))
    marked = held.join(best, ["orthogroup", "taxon"])
    chosen = F.when(F.col("gene") == F.col("best"), "yes").otherwise("no")
    selection = marked.select("orthogroup", "taxon", F.col("gene").alias("gene_id"), F.length("seq").alias("length"), "effective_length", F.lit(seqtype).alias("sequence_type"), chosen.alias("selected"))
    rows = (marked.where("gene = best") if longest else held).select("orthogroup", "taxon_order", "gene_order", "export_id", "taxon", "gene", "seq")
    least = F.min(F.struct("orthogroup", "taxon", "gene")).alias("least")

    def several(times: Column, fault: str, *by: str) -> DataFrame:
        return rows.groupBy(*by).agg(least, times.alias("n")).where("n > 1").select("least.*", F.lit(fault).alias("fault"))

    faults = missing.unionByName(rows.where(r"export_id rlike '\\s'").select("orthogroup", "taxon", "gene", F.lit("white space in the name").alias("fault")))
    if longest:
        copies = held.groupBy("orthogroup", "taxon", "gene").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        faults = faults.unionByName(copies.select("orthogroup", "taxon", "gene", F.lit("gene named twice").alias("fault")))
    else:
        faults = faults.unionByName(several(F.count(F.lit(1)), "name used twice", "orthogroup", "export_id"))
    faults = faults.unionByName(several(F.count_distinct("taxon"), "name of several taxa", "export_id"))
    return OrthoSet(rows, faults, selection)


def fasta_lines(rows: DataFrame) -> DataFrame:
    """(orthogroup, taxon_order, gene_order, text) of the sequences: the header with taxon and orthogroup, then the sequence."""
    head = F.concat(F.lit(">"), "export_id", F.lit(" taxon="), "taxon", F.lit(" orthogroup="), F.col("orthogroup").cast("string"))
    return rows.select("orthogroup", "taxon_order", "gene_order", F.concat_ws("\n", head, "seq").alias("text"))


def write_set(found: OrthoSet, folder: str, longest: bool = False, mode: str = "errorifexists") -> None:
    """Writes sequences (a folder per orthogroup), map, paths and, where copies were chosen, copy_selection under folder; raises for a set with faults, or an empty one, before anything is written."""
    if bad := found.faults.orderBy("orthogroup", "taxon", "gene", "fault").first():
        raise ValueError(f"{bad['orthogroup']}: {bad['fault']}: {bad['gene']} of {bad['taxon']}")
    if found.rows.isEmpty():
        raise ValueError("no orthogroups")
    order = ["orthogroup", "taxon_order", "gene_order"]
    put = lambda df, *by: df.repartitionByRange(*by).sortWithinPartitions(*by)
    put(fasta_lines(found.rows), *order).select("orthogroup", "text").write.mode(mode).partitionBy("orthogroup").text(f"{folder}/sequences")
    put(found.rows, *order).select(F.concat_ws("\t", "export_id", "taxon").alias("line")).write.mode(mode).text(f"{folder}/map")
    paths = found.rows.select("orthogroup").distinct()
    put(paths, "orthogroup").select(F.concat(F.lit(f"{folder}/sequences/orthogroup="), F.col("orthogroup").cast("string")).alias("line")).write.mode(mode).text(f"{folder}/paths")
    if longest:
        put(found.selection, "orthogroup", "taxon", "gene_id").select(*SELECTION).write.mode(mode).option("header", True).csv(f"{folder}/copy_selection", sep="\t")
