"""What became of every locus of every branch of a run, from reports that name loci by file.

details: branch, row (the order in the report), file, seqtype, parsimony_informative_sites, issues (joined by ;).
lists: branch, kind (pass, fail or retained), path; a list that is there but empty has one row with a null path.
pairs: branch, row, locus, status, reasons (joined by ;), minimum_codon_pis, minimum_protein_pis; the reports of paired
runs, in branches paired/NAME or pseudogene/paired/NAME.  Their first row has the thresholds of the branches NAME.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The reasons that are added here.
BELOW, UNKNOWN = "below_independent_PIS_threshold", "failure_reason_not_recorded"
STATES = ("pass", "fail")


def base_name(path: Column) -> Column:
    """What follows the last slash of either kind."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def pair_branch(branch: Column) -> Column:
    """The branch whose paired report has the thresholds of a branch."""
    inside = F.array_contains(F.split(branch, "/"), "pseudogene")
    return F.concat(F.when(inside, "pseudogene/").otherwise(""), F.lit("paired/"), F.regexp_extract(branch, r"([^/]*)$", 1))


def _reasons(joined: Column) -> Column:
    named = F.filter(F.split(F.coalesce(joined, F.lit("")), ";"), lambda x: ~x.isin("", "NA"))
    return F.array_sort(F.array_distinct(named))


def first_rows(report: DataFrame, key: str) -> DataFrame:
    """Per branch and key the first row, and in rows how many there are."""
    rest = [c for c in report.columns if c not in ("branch", key)]
    first = F.min_by(F.struct(*rest), F.col("row"))
    return report.groupBy("branch", key).agg(first.alias("first"), F.count(F.lit(1)).alias("rows")).select("branch", key, "first.*", "rows")


def _listed(lists: DataFrame) -> DataFrame:
    """Per branch and file name: on which lists it is, and how many paths of a list share it."""
    named = lists.where("path is not null").withColumn("locus", base_name(F.col("path")))
    paths = named.groupBy("branch", "locus", "kind").agg(F.count_distinct("path").alias("paths"))
    on = [F.bool_or(F.col("kind") == k).alias(f"on_{k}") for k in (*STATES, "retained")]
    return paths.groupBy("branch", "locus").agg(*on, F.max("paths").alias("paths"))


def _joined(details: DataFrame, lists: DataFrame, pairs: DataFrame) -> DataFrame:
    """The first row of every locus of a branch with its places on lists and its threshold; rows on lists alone have no row number."""
    once = first_rows(details.withColumn("locus", base_name(F.col("file"))), "locus")
    found = once.join(_listed(lists), ["branch", "locus"], "full_outer")
    kinds = lists.groupBy("branch").agg(F.bool_or(F.col("kind") == "retained").alias("has_retained"))
    least = pairs.groupBy(F.col("branch").alias("pair")).agg(*[F.min_by(f"minimum_{k}_pis", "row").alias(f"least_{k}") for k in ("codon", "protein")])
    found = found.join(kinds, "branch", "left").withColumn("pair", pair_branch(F.col("branch"))).join(least, "pair", "left")
    threshold = F.when(F.col("seqtype") == "codon", F.col("least_codon")).when(F.col("seqtype") == "prot", F.col("least_protein"))
    return found.withColumn("threshold", threshold).drop("pair", "least_codon", "least_protein")


def resolved(details: DataFrame, lists: DataFrame, pairs: DataFrame) -> DataFrame:
    """(branch, selection, locus, status, reasons, threshold): one row a branch and locus that has a row in a report.

    The first row of a locus counts.  Where a branch has a retained list, that decides, and a locus with fewer
    informative sites than the threshold of its kind has that as a further reason; else the pass list, then the fail
    list; a locus on none is not_evaluated.  Rows of paired reports bring their own status.  reasons: sorted, of failed
    loci only, never none.
    """
    found = _joined(details, lists, pairs).where("row is not null")
    on = lambda k: F.coalesce(f"on_{k}", F.lit(False))
    kept = F.coalesce("has_retained", F.lit(False))
    status = F.when(kept, F.when(on("retained"), "pass").otherwise("fail")).when(on("pass"), "pass").when(on("fail"), "fail").otherwise("not_evaluated")
    low = kept & F.coalesce(F.col("parsimony_informative_sites") < F.col("threshold"), F.lit(False))
    named = _reasons(F.col("issues"))
    named = F.when(low, F.array_sort(F.array_union(named, F.array(F.lit(BELOW))))).otherwise(named)
    selection = F.when(kept, "Independent").otherwise("Recorded QC")
    own = found.select("branch", selection.alias("selection"), "locus", status.alias("status"), named.alias("reasons"), F.when(kept, F.col("threshold")).cast("long").alias("threshold"))
    pair_rows = first_rows(pairs, "locus")
    told = F.when(F.col("status").isin(*STATES), F.col("status")).otherwise("not_evaluated")
    paired = pair_rows.select("branch", F.lit("Paired"), "locus", told, _reasons(F.col("reasons")), F.lit(None).cast("long"))
    reasons = F.when(F.col("status") != "fail", F.array().cast("array<string>")).when(F.size("reasons") == 0, F.array(F.lit(UNKNOWN))).otherwise(F.col("reasons"))
    return own.union(paired).withColumn("reasons", reasons)


def report_faults(details: DataFrame, lists: DataFrame, pairs: DataFrame) -> DataFrame:
    """(branch, locus, fault): what makes a report ambiguous: a locus with several rows, on the pass and the fail list, on a list with two paths, or on a list without a row; and a retained locus whose kind has no threshold."""
    found = _joined(details, lists, pairs)
    on = lambda k: F.coalesce(f"on_{k}", F.lit(False))
    tests = {
        "row repeated": F.col("rows") > 1,
        "passed and failed": on("pass") & on("fail"),
        "paths share a name": F.col("paths") > 1,
        "listed without a row": F.col("row").isNull(),
        "no threshold": F.col("row").isNotNull() & on("retained") & F.col("threshold").isNull(),
    }
    faults = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), name) for name, t in tests.items()]))
    own = found.select("branch", "locus", F.explode(faults).alias("fault"))
    return own.union(first_rows(pairs, "locus").where("rows > 1").select("branch", "locus", F.lit("row repeated")))


def branch_summary(status: DataFrame) -> DataFrame:
    """(branch, selection, evaluated, passed, failed, not_evaluated) of resolved()."""
    n = lambda s: F.count_if(F.col("status") == s)
    return status.groupBy("branch", "selection").agg((n("pass") + n("fail")).alias("evaluated"), n("pass").alias("passed"), n("fail").alias("failed"), n("not_evaluated").alias("not_evaluated"))
