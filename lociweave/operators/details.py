"""The details report of quality control: a row per alignment, columns in a fixed order, findings of its sequences as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociweave.functions.ordered import PIECE, ordered_text
from lociweave.operators.provenance import with_provenance
from lociweave.operators.qc import Gate, qc_gate, stop_findings
from lociweave.operators.sites import distinct_patterns


def columns(seqtype: str) -> dict[str, str]:
    """The report's columns, a fixed format, and where they come from."""
    ambiguous = {"X_ratio": "x_ratio"} if seqtype == "prot" else {"N_ratio": "n_ratio"}
    stops = {} if seqtype == "nucl" else {"Terminal_stop": "terminal_stop", "Internal_stop_count": "internal_stop"}
    return {
        "File": "file", "Seqtype": "seqtype", "Sequence_count": "sequence_count", "Alignment_length": "alignment_length", **ambiguous, "Gap_ratio": "gap_ratio",
        "Variable_sites": "variable_sites", "Parsimony_informative_sites": "parsimony_informative_sites", "Distinct_patterns": "distinct_patterns",
        "Singleton_sites": "singleton_sites", "Constant_sites": "constant_sites", "Missing_ratio": "missing_ratio", **stops,
        "Audited_terminal_stop": "audited_terminal_stop", "Audited_internal_stop": "audited_internal_stop", "Issues": "reasons",
    }


def finding_texts(findings: DataFrame, *names: str, between: str = "-", piece: int = PIECE) -> DataFrame:
    """(locus, names): per locus the findings of its records that are neither null nor NA, as id-finding joined by ; in the order of the records.

    findings: locus, record_order, seq_id and names; one pass for all names.
    """
    long = findings.select("locus", "record_order", "seq_id", F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*names))).alias("name", "what"))
    told = long.where("what is not null and what != 'NA'").withColumn("what", F.concat("seq_id", F.lit(between), "what"))
    text = ordered_text(told, ["locus", "name"], "record_order", "what", piece=piece)
    return text.groupBy("locus").agg(*[F.max(F.when(F.col("name") == n, F.col("what"))).alias(n) for n in names])


def qc_details(records: DataFrame, files: DataFrame, gate: Gate = Gate(), index: DataFrame | None = None, piece: int = PIECE) -> DataFrame:
    """locus, passed and the report's columns of every alignment; text columns are NA where there is nothing to tell.

    files: locus, file.  index: provenance.stop_index() of the changes before alignment; codon and protein alignments
    have its stops in the audited columns, and those that lost internal ones fail unless the gate allows them.
    """
    texts, audited = [], None
    if gate.seqtype != "nucl":
        found = stop_findings(records, gate.seqtype, gate.table).withColumn("internal_stop", F.concat(F.lit("inter-"), "internal_stops"))
        texts.append(finding_texts(found, "terminal_stop", "internal_stop", piece=piece))
        if index is not None:
            known = with_provenance(records.select("locus", "record_order", "seq_id"), files, index)
            texts.append(finding_texts(known, "audited_terminal_stop", "audited_internal_stop", piece=piece))
            audited = texts[-1].where("audited_internal_stop is not null").select("locus")
    out = qc_gate(records, gate, audited).join(files.select("locus", "file"), "locus", "left")
    out = out.join(distinct_patterns(records, "prot" if gate.seqtype == "prot" else "nucl"), "locus", "left")
    for t in texts:
        out = out.join(t, "locus", "left")
    patterns = F.when(F.col("alignment_length") > 0, F.coalesce("distinct_patterns", F.lit(0))).otherwise(0).cast("long")
    out = out.withColumns({"seqtype": F.lit(gate.seqtype), "distinct_patterns": patterns})
    text = ("terminal_stop", "internal_stop", "audited_terminal_stop", "audited_internal_stop")
    return out.select("locus", "passed", *[(F.coalesce(c, F.lit("NA")) if c in out.columns else F.lit("NA")).alias(t) if c in text else F.col(c).alias(t) for t, c in columns(gate.seqtype).items()])


def path_lists(details: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file) of the alignments that passed and of those that failed: lists without a header."""
    return details.where("passed").select(F.col("File").alias("file")), details.where("not passed").select(F.col("File").alias("file"))
