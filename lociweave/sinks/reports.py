"""Report tables: quality control, inclusion, orthogroup sets, and one JSON document of all figures."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociweave.model import EVENT_FIELDS
from lociweave.operators.orthogroups import longest_copy


def qc_reports(gate: DataFrame, path: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(paths that pass, paths that fail, details): of qc_gate's rows; path: the file of a locus."""
    named = gate.withColumn("File", path)
    details = named.select("File", *[F.col(c).alias(c[0].upper() + c[1:]) for c in gate.columns if c not in ("locus", "passed", "reasons")], F.col("reasons").alias("Issues"))
    return named.where("passed").select("File"), named.where("not passed").select("File"), details


def change_report(events: DataFrame, file: Column, code: int | str | None = None, kind: str = "source", protein: bool = False) -> DataFrame:
    """The fixed columns of a report of changes, from events of operators.normalize or frameshift; NA where there is nothing.

    file: the name that a locus is reported under.  Positions of nucleotides are nt positions; with protein they are
    positions of residues, in a column more.
    """
    span = F.concat_ws("-", "start", "end")
    place = F.when(F.col("start").isNotNull() & F.col("end").isNotNull(), span).otherwise("NA")
    told = {
        "input_file": file, "taxa_id": F.col("seq_id"), "event": F.col("event"), "source_nt_positions": F.lit("NA") if protein else place, "original": F.col("original"),
        "replacement": F.col("replacement"), "action": F.col("action"), "genetic_code": F.lit(None if code is None else str(code)), "input_kind": F.lit(kind),
    }
    if protein:
        told["source_aa_positions"] = place
    return events.select(*[F.coalesce(told[c].cast("string"), F.lit("NA")).alias(c) for c in (*EVENT_FIELDS, *["source_aa_positions"] * protein)])


def inclusion_report(inclusion: DataFrame, path: Column) -> DataFrame:
    """(gene, status, details) of concat.inclusion's rows."""
    missing = F.concat(F.lit("missing taxa: "), F.array_join("missing", ", "))
    details = F.when(F.col("length") == 0, "zero-column alignment").when(F.size("missing") > 0, missing).otherwise("")
    return inclusion.select(path.alias("gene"), "status", details.alias("details"))


def iqtree_head() -> str:
    return "#nexus\nbegin sets;"


def iqtree_tail(partitions: DataFrame, name: Column) -> DataFrame:
    """(text): the charpartition line over all partitions, in the order of their columns."""
    names = F.array_join(F.sort_array(F.collect_list(F.struct("start", name.alias("name"))))["name"], ", ")
    return partitions.agg(F.concat(F.lit("    charpartition my_genes = :"), names, F.lit(";\nend;")).alias("text"))


def orthogroup_set(members: DataFrame, keep_taxon: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(FASTA text per sequence, map, copy selection) of members with seq and effective_length, the longest copy of each taxon."""
    best = longest_copy(members).select("orthogroup", "taxon", F.col("gene").alias("best"))
    marked = members.join(best, ["orthogroup", "taxon"])
    name = F.concat_ws("_", "taxon", "gene") if keep_taxon else F.col("gene")
    chosen = marked.where("gene = best")
    text = F.concat(F.lit(">"), name, F.lit(" taxon="), "taxon", F.lit(" orthogroup="), "orthogroup", F.lit("\n"), "seq")
    selection = marked.select("orthogroup", "taxon", F.col("gene").alias("gene_id"), F.length("seq").alias("length"), "effective_length", (F.col("gene") == F.col("best")).alias("selected"))
    return chosen.select("orthogroup", "taxon", text.alias("text")), chosen.select(name.alias("original_id"), F.col("taxon").alias("renamed_id")), selection


def document(**tables: DataFrame) -> DataFrame:
    """(section, json): each table as a JSON array of its rows, sorted; for tables of roll-ups, whose rows are few."""
    sections = [t.agg(F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list(F.to_json(F.struct("*")))), ","), F.lit("]")).alias("json")).select(F.lit(n).alias("section"), "json") for n, t in tables.items()]
    out = sections[0]
    for s in sections[1:]:
        out = out.unionByName(s)
    return out


def html_page(title: str, tables: dict[str, DataFrame], rows: int = 50) -> str:
    """A self-contained page; the top rows of each table, which the caller has ordered, as the report shows them."""
    cell = lambda x: "Unavailable" if x is None else html.escape(f"{x:,}" if isinstance(x, int) and not isinstance(x, bool) else str(x))
    parts = [f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>"]
    for name, table in tables.items():
        head = "".join(f"<th>{html.escape(c)}</th>" for c in table.columns)
        body = "".join("<tr>" + "".join(f"<td>{cell(x)}</td>" for x in r) + "</tr>" for r in table.limit(rows).collect())
        parts.append(f"<h2>{html.escape(name)}</h2><table><tr>{head}</tr>{body}</table>")
    return "".join([*parts, "</body></html>"])


def changed_files(before: DataFrame, now: DataFrame) -> DataFrame:
    """Files of now (path, size, sha256) that before lacks or has with other content: what a resumed run has to do."""
    return now.join(before.select("path", "sha256"), ["path", "sha256"], "left_anti")
