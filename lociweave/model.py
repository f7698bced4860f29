"""The tables that operators take and return.

records: locus, record_order, seq_id, seq; one row per sequence, order within the locus explicit.
locus is a number, and loci are in its order: loci that have names get a number first (functions.running.numbered over
an order of theirs, or the place of their file in a list), as running totals deal rows to ranges by it.
cells: locus, record_order, seq_id, pos (from 1), ch.  codon cells: locus, record_order, seq_id, site (from 1), codon.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociweave.functions.sequences import characters, codons

RECORDS = "locus bigint, record_order int, seq_id string, seq string"
EVENT_FIELDS = ("input_file", "taxa_id", "event", "source_nt_positions", "original", "replacement", "action", "genetic_code", "input_kind")
SEQTYPES = ("nucl", "codon", "prot")


def check_seqtype(seqtype: str) -> None:
    if seqtype not in SEQTYPES:
        raise ValueError(f"seqtype must be one of {', '.join(SEQTYPES)}")


def check_ratio(**ratios: float) -> None:
    for name, value in ratios.items():
        if not 0 <= value <= 1:
            raise ValueError(f"{name} must be between 0 and 1")


def cells(records: DataFrame, seqtype: str = "nucl") -> DataFrame:
    """One row per character, upper case; U as T unless seqtype is prot."""
    seq = F.upper("seq") if seqtype == "prot" else F.translate(F.upper("seq"), "U", "T")
    exploded = records.select("locus", "record_order", "seq_id", F.posexplode(characters(seq)).alias("pos", "ch"))
    return exploded.withColumn("pos", F.col("pos") + 1)


def codon_cells(records: DataFrame) -> DataFrame:
    """One row per complete triplet, upper case, U as T."""
    seq = F.translate(F.upper("seq"), "U", "T")
    exploded = records.select("locus", "record_order", "seq_id", F.posexplode(codons(seq)).alias("site", "codon"))
    return exploded.withColumn("site", F.col("site") + 1)


def rebuilt(parts: DataFrame, order: str, part: str) -> DataFrame:
    """records from ordered parts; a record without parts isn't there."""
    pieces = F.sort_array(F.collect_list(F.struct(order, part)))
    return parts.groupBy("locus", "record_order", "seq_id").agg(F.array_join(pieces[part], "").alias("seq"))
