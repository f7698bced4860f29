"""From cleaned, aligned loci to a supermatrix and its derivatives, as one plan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from lociweave.operators import codon, concat, qc, trim


@dataclass(frozen=True)
class Settings:
    gate: qc.Gate = field(default_factory=lambda: qc.Gate("codon"))
    protein_gate: qc.Gate = field(default_factory=lambda: qc.Gate("prot"))
    missing_taxa: str = "pad-gaps"
    paired_policy: str = "both"
    min_codon_informative: int = 0
    min_protein_informative: int = 0
    max_gap: float = 0.2
    max_n: float = 0.2
    max_x: float = 0.2
    table: int = 1
    fourfold_policy: str = "ignore-missing"


@dataclass(frozen=True)
class Prepared:
    decisions: DataFrame
    partitions: DataFrame
    missing: DataFrame
    supermatrix: DataFrame
    proteins: DataFrame
    positions: DataFrame
    fourfold: DataFrame


def _settled(df: DataFrame) -> DataFrame:
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df


def prepare(codons: DataFrame, proteins: DataFrame, mapping: DataFrame | None = None, settings: Settings = Settings(), trimmed: bool = True) -> Prepared:
    """codons, proteins: paired alignments of the same loci and records.

    Trims both by one mask, renames, judges both sides, keeps loci whose pair passes, and concatenates those.  If the
    session has a checkpoint folder, trimmed records and decisions are kept there, so that the tables that follow don't
    work them out again; that happens when this is called.
    """
    if trimmed:
        codons, proteins = trim.trim_pair(codons, proteins, max_gap=settings.max_gap, max_n=settings.max_n, max_x=settings.max_x)
    if mapping is not None:
        codons, proteins = trim.rename(codons, mapping), trim.rename(proteins, mapping)
    codons, proteins = _settled(codons), _settled(proteins)
    judged = [qc.qc_gate(codons, settings.gate), qc.qc_gate(proteins, settings.protein_gate)]
    decisions = _settled(qc.paired_decision(*judged, policy=settings.paired_policy, min_codon=settings.min_codon_informative, min_protein=settings.min_protein_informative))
    passed = decisions.where("paired_passed").select("locus")
    kept = codons.join(passed, "locus", "left_semi")
    return Prepared(
        decisions,
        concat.partitions(kept, settings.missing_taxa),
        concat.missing_blocks(kept, settings.missing_taxa),
        concat.supermatrix(kept, settings.missing_taxa),
        concat.supermatrix(proteins.join(passed, "locus", "left_semi"), settings.missing_taxa),
        codon.split_codon_positions(kept),
        codon.fourfold_sites(kept, settings.table, settings.fourfold_policy),
    )
