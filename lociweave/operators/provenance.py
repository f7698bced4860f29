"""Stops that preprocessing took out, brought back to the sequences of finished alignments.

changes: report_row (the order of the reports), input_file, input_kind, taxa_id, mapped_taxa_id, event,
source_nt_positions, source_aa_positions, original.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociweave.functions.ordered import PIECE, ordered_text
from lociweave.functions.sequences import locus_key, taxon_from_label

#: The events that tell of stops.
STOPS = ("terminal_stop", "internal_stop", "protein_terminal_stop", "protein_internal_stop")
REQUIRED = ("input_file", "taxa_id", "event", "source_nt_positions", "original")


def plain_path(path: Column) -> Column:
    """A path without doubled slashes and steps to the same folder."""
    return F.regexp_replace(path, r"/(?:\.?/)+", "/")


def source_key(input_file: Column, input_kind: Column) -> Column:
    """The locus of an edited file: source files by their stem, exports of an aligner by what precedes their endings."""
    return F.when(input_kind == "macse_alignment", locus_key(input_file)).otherwise(taxon_from_label(input_file))


def _given(df: DataFrame, *names: str) -> Column:
    """The first of the columns whose value is neither null, empty nor NA; columns that are missing don't count."""
    return F.coalesce(*[F.when(~F.col(n).isin("", "NA"), F.col(n)) for n in names if n in df.columns], F.lit(None).cast("string"))


def stop_changes(changes: DataFrame) -> DataFrame:
    """(locus_key, source, taxon, category, report_row, note) of the changes that took a stop out.

    A taxon goes by its mapped name, else by its own; a position by its nucleotides, else by its residues.
    """
    if missing := [c for c in REQUIRED if c not in changes.columns]:
        raise ValueError(f"not a report of changes: no columns {', '.join(missing)}")
    kind = F.coalesce("input_kind", F.lit("")) if "input_kind" in changes.columns else F.lit("")
    file = F.coalesce("input_file", F.lit(""))
    taxon = F.coalesce(_given(changes, "mapped_taxa_id"), F.col("taxa_id"), F.lit("NA"))
    note = F.concat_ws("-", F.coalesce(_given(changes, "source_nt_positions"), F.col("source_aa_positions") if "source_aa_positions" in changes.columns else F.lit(None), F.lit("NA")), F.coalesce("original", F.lit("NA")))
    category = F.when(F.contains(F.col("event"), F.lit("internal_stop")), "internal").otherwise("terminal")
    stops = changes.where(F.col("event").isin(*STOPS))
    return stops.select(source_key(file, kind).alias("locus_key"), plain_path(file).alias("source"), taxon.alias("taxon"), category.alias("category"), "report_row", note.alias("note"))


def collisions(changes: DataFrame) -> DataFrame:
    """(locus_key, sources): keys that stops of several source files would share."""
    sources = stop_changes(changes).where("source != ''").groupBy("locus_key").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    return sources.where(F.size("sources") > 1)


def check_collisions(changes: DataFrame) -> None:
    """Raises if a locus of changes isn't that of one file; runs a job."""
    if found := collisions(changes).orderBy("locus_key").first():
        raise ValueError(f"several source files have the locus key {found['locus_key']}: {', '.join(found['sources'])}")


def stop_index(changes: DataFrame, piece: int = PIECE) -> DataFrame:
    """(locus_key, taxon, audited_terminal_stop, audited_internal_stop): positions with what was there, joined by ; in the order of the reports; null where there are none."""
    text = ordered_text(stop_changes(changes), ["locus_key", "taxon", "category"], "report_row", "note", piece=piece)
    of = lambda c: F.max(F.when(F.col("category") == c, F.col("note"))).alias(f"audited_{c}_stop")
    return text.groupBy("locus_key", "taxon").agg(of("terminal"), of("internal"))


def with_provenance(records: DataFrame, files: DataFrame, index: DataFrame) -> DataFrame:
    """records with audited_terminal_stop and audited_internal_stop of stop_index(), NA where nothing is known.

    files: locus, file; a record is looked for by its file's locus key, so trimmed, translated or aligned files find the
    stops of their source, and by its id.
    """
    keys = files.select("locus", locus_key(F.col("file")).alias("locus_key"))
    placed = index.join(keys, "locus_key").select("locus", F.col("taxon").alias("seq_id"), "audited_terminal_stop", "audited_internal_stop")
    found = records.join(placed, ["locus", "seq_id"], "left")
    return found.withColumns({c: F.coalesce(c, F.lit("NA")) for c in ("audited_terminal_stop", "audited_internal_stop")})
