"""Expressions over whole sequences and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The letters that records may have, and those that count as resolved states.
DNA = "ACGTURYSWKMBDHVN-?"
PROTEIN = "ACDEFGHIKLMNPQRSTVWYBXZJUO*?-"
DNA_STATES = "ACGT"
PROTEIN_STATES_QC = "ACDEFGHIKLMNPQRSTVWYOU"
PROTEIN_STATES_REPORT = "ACDEFGHIKLMNPQRSTVWY"
AMBIGUOUS_BASES = "RYSWKMBDHV"


def characters(seq: Column) -> Column:
    """The characters of a sequence; none of an empty one."""
    return F.when(F.length(seq) > 0, F.split(seq, "")).otherwise(F.array().cast("array<string>"))


def codons(seq: Column) -> Column:
    """Complete triplets in order."""
    return F.regexp_extract_all(seq, F.lit("(?s)..."), F.lit(0))


def occurrences(seq: Column, letters: str) -> Column:
    """How many characters are among letters."""
    return (F.length(seq) - F.length(F.translate(seq, letters, ""))).cast("long")


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as a double, 0 over nothing."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / whole.cast("double"))


def normalize_dna(seq: Column) -> Column:
    return F.translate(F.upper(seq), "U", "T")


def normalize_nucleotides(seq: Column, keep_missing: bool = False) -> Column:
    """Upper case over A, C, G, T, N and -; ? stays if asked for."""
    away = AMBIGUOUS_BASES + ("" if keep_missing else "?")
    return F.translate(F.upper(seq), "U" + away, "T" + "N" * len(away))


def normalize_protein(seq: Column) -> Column:
    """Upper case over the 20 residues, X, - and ?."""
    return F.regexp_replace(F.upper(seq), "[^ACDEFGHIKLMNPQRSTVWYX?-]", "X")


def normalize_rna(seq: Column) -> Column:
    return F.translate(normalize_nucleotides(seq, keep_missing=True), "T", "U")


def safe_id(name: Column) -> Column:
    return F.translate(name, ":,()", "____")


def taxon_from_label(label: Column) -> Column:
    """File name without folders and its last extension."""
    return F.regexp_replace(F.regexp_extract(label, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")


#: Fixed values, a convention of file names: who aligned a locus, as what, and the end of the name.
ALIGNERS, ALIGNED_AS, ALIGNED_END = ("mafft", "muscle", "clustalw2", "prank", "macse"), ("nucl", "codon", "prot"), r"(?:\.trimmed)?\.aln\.fasta$"
_ALIGNED = rf"\.(?:{'|'.join(ALIGNERS)})\.(?:{'|'.join(ALIGNED_AS)}){ALIGNED_END}"


def input_key(path: Column, digits: int = 10) -> Column:
    """The stem of a file name, and the beginning of the SHA-256 of its path."""
    return F.concat_ws("_", taxon_from_label(path), F.substring(F.sha2(path.cast("binary"), 256), 1, digits))


def partition_name(path: Column) -> Column:
    """A charset name from a file name: an aligner's suffix goes, anything but ASCII letters and digits becomes _."""
    name = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), _ALIGNED, "")
    name = F.regexp_replace(name, "[^A-Za-z0-9_]", "_")
    return F.when(name.rlike("^[A-Za-z]"), name).otherwise(F.concat(F.lit("gene_"), name))


def locus_key(path: Column) -> Column:
    """The locus that an alignment file belongs to, from its name."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    for pattern in (
        r"^(.+)\.macse_original\.(?:NT|AA)\.(?:fasta|fa)$",
        rf"^(.+){_ALIGNED}",
        rf"^(.+?){ALIGNED_END}",
        r"^(.+)\.[^.]*$",
    ):
        name = F.when(name.rlike(pattern), F.concat(F.lit("\x00"), F.regexp_extract(name, pattern, 1))).otherwise(name)
    return F.translate(name, "\x00", "")


def nexus_label(name: Column) -> Column:
    """Quoted, inner quotes doubled, if it has punctuation or white space."""
    quoted = F.concat(F.lit("'"), F.replace(name, F.lit("'"), F.lit("''")), F.lit("'"))
    return F.when(name.rlike(r"[\s()\[\]{}/\\,;:=*'\"`+<>-]"), quoted).otherwise(name)
