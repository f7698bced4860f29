"""The report of paired codon and protein alignments, and what each side retains by itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How the informative sites of both sides decide, and the report's columns in their order.
POLICIES = ("both", "either", "codon", "protein")
COLUMNS = ("Locus", "Codon_file", "Protein_file", "Codon_nonPIS_QC", "Protein_nonPIS_QC", "Codon_PIS", "Protein_PIS", "Minimum_codon_PIS", "Minimum_protein_PIS", "PIS_policy", "PIS_status", "Paired_status", "Reasons")


def check_options(seqtype: str, policy: str = "both", min_nucl: int | None = None, min_protein: int | None = None) -> None:
    """Raises for thresholds and policies that a kind of run has no use for."""
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {', '.join(POLICIES)}")
    if any(x is not None and x < 0 for x in (min_nucl, min_protein)):
        raise ValueError("thresholds of informative sites must not be negative")
    if seqtype == "prot" and min_nucl is not None:
        raise ValueError("prot has no nucleotide columns to ask informative sites of")
    if seqtype == "nucl" and min_protein is not None:
        raise ValueError("nucl has no residues to ask informative sites of")
    if seqtype not in ("codon", "pseudogene") and policy != "both":
        raise ValueError("a policy needs codon and protein alignments")


def independent(side: DataFrame, least: int = 0) -> DataFrame:
    """The rows of side (locus, passed, parsimony_informative_sites) that stay without regard to the other side; equality is enough."""
    return side.where(F.col("passed") & (F.col("parsimony_informative_sites") >= least))


def site_faults(side: DataFrame, expected: DataFrame) -> DataFrame:
    """(locus, fault): loci whose figures side lacks (missing) or has beyond those of expected (unexpected), or has more than once."""
    times = side.groupBy("locus").agg(F.count(F.lit(1)).alias("n"))
    both = times.join(expected.select("locus", F.lit(True).alias("due")).distinct(), "locus", "full_outer")
    fault = F.when(F.col("n").isNull(), "missing").when(F.col("due").isNull(), "unexpected").when(F.col("n") > 1, "twice")
    return both.select("locus", fault.alias("fault")).where("fault is not null")


def paired_report(codon: DataFrame, protein: DataFrame, policy: str = "both", min_codon: int = 0, min_protein: int = 0) -> DataFrame:
    """COLUMNS of every locus of either side; Paired_status is pass if both sides pass and policy is content with their informative sites.

    codon, protein: locus, file, passed (without regard to informative sites), parsimony_informative_sites; a row a
    locus.  What a side doesn't have is NA and counts as failed.
    """
    check_options("codon", policy, min_codon, min_protein)
    pick = lambda df, k: df.select("locus", *[F.col(c).alias(f"{k}_{c}") for c in ("file", "passed", "parsimony_informative_sites")])
    joined = pick(codon, "c").join(pick(protein, "p"), "locus", "full_outer")
    c, p = F.col("c_parsimony_informative_sites") >= min_codon, F.col("p_parsimony_informative_sites") >= min_protein
    known = F.col("c_parsimony_informative_sites").isNotNull() & F.col("p_parsimony_informative_sites").isNotNull()
    enough = F.coalesce(known & {"both": c & p, "either": c | p, "codon": c, "protein": p}[policy], F.lit(False))
    cp, pp = (F.coalesce(f"{k}_passed", F.lit(False)) for k in "cp")
    told = lambda ok: F.when(ok, "pass").otherwise("fail")
    reasons = F.array_join(F.array_compact(F.array(F.when(~cp, "codon_qc_failed"), F.when(~pp, "protein_qc_failed"), F.when(~enough, "pis_policy_failed"))), ";")
    text = lambda x: F.coalesce(F.col(x).cast("string"), F.lit("NA"))
    values: list[Column] = [
        F.col("locus"), text("c_file"), text("p_file"), told(cp), told(pp), text("c_parsimony_informative_sites"), text("p_parsimony_informative_sites"),
        F.lit(min_codon).cast("long"), F.lit(min_protein).cast("long"), F.lit(policy), told(enough), told(cp & pp & enough), F.when(reasons == "", "NA").otherwise(reasons),
    ]
    return joined.select(*[v.alias(n) for v, n in zip(values, COLUMNS, strict=True)])
