"""Readers of the text tables around alignments.

Readers that check what they read (the orthogroup formats, taxon_sequences, taxon_list, informative_sites) run jobs when
they are called, so that a fault raises there and not in what is made of them.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lociweave.functions.sequences import locus_key, safe_id, taxon_from_label
from lociweave.operators.orthogroups import NO_GENE, genes_in_cell


def expand_paths(items: list[str]) -> list[str]:
    """Sequence files from sequence files and path lists.

    A file whose first line that isn't blank or a comment (# or ;) doesn't start with > is a list; its entries are
    looked for beside the list, from the working folder, and beside the list by their last part.
    """
    found: list[str] = []
    for item in items:
        with open(item, encoding="utf-8") as handle:
            lines = [x.strip() for x in handle]
        told = [x for x in lines if x and x[0] not in "#;"]
        if told and told[0].startswith(">") or not told:
            found.append(item)
            continue
        folder = os.path.dirname(os.path.abspath(item))
        for entry in told:
            tries = [os.path.join(folder, entry), entry, os.path.join(folder, re.split(r"[/\\]", entry)[-1])]
            hit = next((t for t in tries if os.path.isfile(t)), None)
            if hit is None:
                raise FileNotFoundError(f"{item}: {entry} does not exist")
            found.append(hit)
    if not found:
        raise ValueError("no input files")
    return found


def mapping(spark: SparkSession, path: str) -> DataFrame:
    """(original_id, renamed_id) of a tab-separated file without header; lines that start with # are comments, ids are made safe."""
    rows = spark.read.text(path).where("value != '' and not startswith(value, '#')")
    cut = F.split("value", "\t")
    return rows.select(safe_id(F.trim(F.get(cut, F.lit(0)))).alias("original_id"), safe_id(F.trim(F.get(cut, F.lit(1)))).alias("renamed_id")).distinct()


def names(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id): the first word of each line, comments aside."""
    rows = spark.read.text(path).where("trim(value) != '' and not startswith(value, '#')")
    return rows.select(F.regexp_extract("value", r"(\S+)", 1).alias("seq_id")).distinct()


def taxon_list(spark: SparkSession, *paths: str) -> list[str]:
    """The names of taxon lists, one a line, white space at its ends, comments (#) and blank lines aside; in the order of the lists.

    A list without names, or a name that comes twice, raises.
    """
    found: list[str] = []
    for path in paths:
        rows = numbered_lines(spark, path, (F.trim(F.translate("value", "\t", " ")) != "") & ~F.startswith(F.ltrim("value"), F.lit("#")))
        own = [r["value"].strip() for r in rows.orderBy("line").collect()]  # as many as there are columns
        if not own:
            raise ValueError(f"{path}: no taxa")
        found += own
    if twice := sorted({t for t in found if found.count(t) > 1}):
        raise ValueError(f"taxa named more than once: {', '.join(twice)}")
    return found


def json_report(spark: SparkSession, path: str, *required: str) -> DataFrame:
    """The rows of JSON reports, a document a file; one that isn't JSON, or lacks a required field, raises."""
    table = spark.read.json(path, multiLine=True, mode="FAILFAST")
    if missing := [c for c in required if c not in table.columns]:
        raise ValueError(f"{path}: missing fields: {', '.join(missing)}")
    return table


def numbered_lines(spark: SparkSession, path: str, keep: Column) -> DataFrame:
    """(value, line, nth): the lines of a file that keep is true of, their number in the file from 0 and among themselves from 1.

    Lines are counted within the pieces that the file is read in; only the pieces, one row each, are added up.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("piece"), F.monotonically_increasing_id().alias("at"))
    raw = raw.withColumn("kept", F.coalesce(keep, F.lit(False)))
    sums = raw.groupBy("piece").agg(F.count(F.lit(1)).alias("n"), F.count_if("kept").alias("k"), F.min("at").alias("first"))
    before = lambda c: (F.sum(c).over(Window.orderBy("piece")) - F.col(c)).alias(f"{c}_before")
    offsets = F.broadcast(sums.select("piece", "first", before("n"), before("k")))
    among = F.row_number().over(Window.partitionBy("piece").orderBy("at"))
    lines = raw.where("kept").withColumn("among", among).join(offsets, "piece")
    return lines.select("value", (F.col("n_before") + F.col("at") - F.col("first")).alias("line"), (F.col("k_before") + F.col("among")).alias("nth"))


def _checked(members: DataFrame, faults: DataFrame, path: str) -> DataFrame:
    """members, unless the file has a fault or no group."""
    first = faults.orderBy("line").first()
    if first:
        raise ValueError(f"{path}:{first['line'] + 1}: {first['fault']}")
    return members.select("orthogroup", "taxon", "gene")


def _told(value: Column) -> Column:
    return (F.trim(F.translate(value, "\t", " ")) != "") & ~F.startswith(F.ltrim(value), F.lit("#"))


def _matrix(spark: SparkSession, path: str, metadata: int, group: str | None, sentinels: tuple[str, ...] = NO_GENE) -> DataFrame:
    """Members of a table with so many columns before those of the taxa; group: the prefix of numbered groups, null if the first column names them."""
    head = spark.read.text(path).first()
    if head is None:
        raise ValueError(f"{path}: empty table")
    header = head["value"].rstrip("\r\n").split("\t")
    labels = spark.range(1).select(*[taxon_from_label(F.trim(F.lit(h))).alias(f"t{k}") for k, h in enumerate(header[metadata:])]).first() if len(header) > metadata else ()
    if not labels or len(set(labels)) < len(labels) or "" in labels:
        raise ValueError(f"{path}: taxa are missing, empty or named twice")
    rows = numbered_lines(spark, path, _told(F.col("value"))).where("line > 0").withColumn("cut", F.split("value", "\t", -1))
    if _told_header(header[0]):
        rows = rows.withColumn("nth", F.col("nth") - 1)
    name = F.trim(F.get("cut", F.lit(0))) if group is None else F.format_string(f"{group}%07d", F.col("nth"))
    rows = rows.withColumn("orthogroup", name)
    cells = rows.select("line", "orthogroup", F.posexplode(F.slice("cut", metadata + 1, len(labels))).alias("k", "cell"))
    cells = cells.select("line", "orthogroup", F.get(F.array(*map(F.lit, labels)), F.col("k")).alias("taxon"), genes_in_cell(F.col("cell"), sentinels).alias("genes"))
    twice = rows.groupBy("orthogroup").agg(F.count(F.lit(1)).alias("n"), F.max("line").alias("line")).where("n > 1")
    width = F.when(F.size("cut") != len(header), F.concat(F.lit(f"expected {len(header)} columns, found "), F.size("cut"))).when(F.col("orthogroup") == "", "empty group")
    cell = F.when(F.array_contains("genes", ""), "empty gene").when(F.size(F.array_distinct("genes")) < F.size("genes"), "gene named twice")
    faults = rows.select("line", width.alias("fault")).union(cells.select("line", cell.alias("fault"))).union(twice.select("line", F.concat(F.lit("group named twice: "), "orthogroup")))
    faults = faults.where("fault is not null").union(rows.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit(0).cast("long"), F.lit("no groups")))
    return _checked(cells.select("line", "orthogroup", "taxon", F.explode("genes").alias("gene")), faults, path)


def _told_header(first: str) -> bool:
    """Whether the first line counts among the lines that aren't comments."""
    return not first.lstrip().startswith("#")


def orthofinder(spark: SparkSession, path: str) -> DataFrame:
    """Members of a table with Orthogroup and a column per taxon; unique taxa, unique groups that aren't empty."""
    head = spark.read.text(path).first()
    if head is None or head["value"].split("\t")[0] != "Orthogroup":
        raise ValueError("the first column must be Orthogroup")
    return _matrix(spark, path, 1, None, ("",))


def sonicparanoid(spark: SparkSession, path: str) -> DataFrame:
    """A group column, then a column per taxon, labelled by its sequence file."""
    return _matrix(spark, path, 1, None)


def proteinortho(spark: SparkSession, path: str, prefix: str = "POG") -> DataFrame:
    """Three columns of figures, then a column per taxon; groups are numbered in their order, comments and blank lines aside."""
    return _matrix(spark, path, 3, prefix)


def _prefixed(rows: DataFrame, separator: str, strip: bool, path: str) -> DataFrame:
    """Members of rows (line, orthogroup, members); each member is a taxon, the separator and a gene."""
    cut = F.split("member", re.escape(separator), 2)
    each = rows.select("line", "orthogroup", F.explode("members").alias("member")).withColumns({"taxon": F.get(cut, F.lit(0)), "own": F.get(cut, F.lit(1))})
    each = each.withColumn("gene", F.col("own") if strip else F.col("member"))
    group = F.when((F.col("orthogroup") == "") | (F.size("members") == 0), "group or members are empty")
    member = F.when(F.col("own").isNull(), F.concat(F.lit(f"member lacks {separator}: "), "member")).when((F.col("taxon") == "") | (F.col("own") == ""), F.concat(F.lit("invalid member: "), "member"))
    repeated = each.groupBy("line", "orthogroup", "taxon", "gene").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    twice = rows.groupBy("orthogroup").agg(F.count(F.lit(1)).alias("n"), F.max("line").alias("line")).where("n > 1")
    faults = rows.select("line", group.alias("fault")).union(each.select("line", member.alias("fault"))).where("fault is not null")
    faults = faults.union(repeated.select("line", F.concat(F.lit("gene named twice: "), "gene"))).union(twice.select("line", F.concat(F.lit("group named twice: "), "orthogroup")))
    faults = faults.union(rows.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit(0).cast("long"), F.lit("no groups")))
    return _checked(each, faults, path)


def orthomcl(spark: SparkSession, path: str, separator: str = "|", strip: bool = False) -> DataFrame:
    """GROUP: taxon|gene taxon|gene ...; what stands before the first colon names the group."""
    rows = numbered_lines(spark, path, _told(F.col("value")))
    members = F.filter(F.split(F.regexp_extract("value", r"^[^:]*:(.*)$", 1), r"\s+"), lambda x: x != "")
    return _prefixed(rows.select("line", F.trim(F.regexp_extract("value", r"^([^:]*):", 1)).alias("orthogroup"), members.alias("members")), separator, strip, path)


def oma(spark: SparkSession, path: str, separator: str = "|", strip: bool = False) -> DataFrame:
    """GROUP, then members, all separated by tabs."""
    rows = numbered_lines(spark, path, _told(F.col("value")))
    cut = F.split("value", "\t", -1)
    members = F.filter(F.transform(F.slice(cut, F.lit(2), F.size(cut)), lambda x: F.trim(x)), lambda x: x != "")
    return _prefixed(rows.select("line", F.trim(F.get(cut, F.lit(0))).alias("orthogroup"), members.alias("members")), separator, strip, path)


#: Ends of the sequence files of taxa.
TAXON_FILES = (".fa", ".faa", ".fasta", ".fas", ".pep")


def taxon_sequences(spark: SparkSession, folder: str, wanted: DataFrame | None = None) -> DataFrame:
    """(taxon, gene, seq) of the sequence files of a folder, one a taxon; ids are made safe.

    Two files of one taxon, an empty or a repeated id, among all ids of a file, raise.  wanted: taxon, gene of the
    sequences to return.
    """
    from lociweave.sources.fasta import records_from_files

    records = records_from_files(spark, folder, TAXON_FILES).withColumn("taxon", taxon_from_label(F.col("file")))
    if two := records.groupBy("taxon").agg(F.count_distinct("file").alias("n")).where("n > 1").first():
        raise ValueError(f"{folder}: more than one file of taxon {two['taxon']}")
    named = records.select("taxon", safe_id(F.col("seq_id")).alias("gene"), "seq")
    bad = named.groupBy("taxon", "gene").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or gene = '' or gene is null").first()
    if bad:
        raise ValueError(f"{folder}: empty or repeated id {bad['gene']!r} of taxon {bad['taxon']}")
    return named if wanted is None else named.join(wanted.select("taxon", "gene").distinct(), ["taxon", "gene"], "left_semi")


def qc_details(spark: SparkSession, path: str, *required: str) -> DataFrame:
    """The rows of a tab-separated report with a header that must have the required columns."""
    table = spark.read.csv(path, sep="\t", header=True, inferSchema=False)
    table = table.toDF(*[c.removeprefix("\ufeff") for c in table.columns])
    if missing := [c for c in required if c not in table.columns]:
        raise ValueError(f"{path}: missing columns: {', '.join(missing)}")
    return table


def informative_sites(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """(locus, parsimony_informative_sites) of a details report; raises unless its loci are those of expected (locus)."""
    found = qc_details(spark, path, "File", "Parsimony_informative_sites").select(locus_key(F.col("File")).alias("locus"), F.col("Parsimony_informative_sites").cast("long").alias("parsimony_informative_sites"))
    odd = found.select("locus").distinct().withColumn("there", F.lit(1)).join(expected.select("locus").distinct().withColumn("due", F.lit(1)), "locus", "full_outer").where("there is null or due is null").orderBy("locus").first()
    if odd:
        raise ValueError(f"{path}: locus {odd['locus']} is {'missing' if odd['there'] is None else 'unexpected'}")
    return found


def edits(spark: SparkSession, *paths: str) -> DataFrame:
    """The rows of sequence-change reports, columns united by name, NA where a report lacks one."""
    from lociweave.operators.report import merge_events

    return merge_events(*[spark.read.csv(p, sep="\t", header=True, inferSchema=False) for p in paths])


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256) of files, for manifests and for what has changed since."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def charsets(spark: SparkSession, path: str) -> DataFrame:
    """(name, start, end) of the charset lines of a partition file."""
    pattern = r"(?i)^\s*charset\s+(\S+)\s*=\s*(\d+)\s*-\s*(\d+)\s*;"
    rows = spark.read.text(path).where(F.col("value").rlike(pattern))
    return rows.select(F.regexp_extract("value", pattern, 1).alias("name"), *[F.regexp_extract("value", pattern, k).cast("long").alias(n) for k, n in ((2, "start"), (3, "end"))])


def columns_map(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos): the columns, from 1, that the line #ColumnsMap of a trimming program's output keeps; it counts from 0."""
    rows = spark.read.text(path).where(F.col("value").startswith("#ColumnsMap\t"))
    items = F.split(F.substring_index("value", "\t", -1), ",")
    return rows.select(F.col("_metadata.file_path").alias("file"), F.explode(items).alias("item")).where("trim(item) != ''").select("file", (F.trim("item").cast("int") + 1).alias("pos"))


def charset_faults(parts: DataFrame, length: int) -> DataFrame:
    """(name, fault): partitions that don't follow on each other from 1 to length; parts are as many as loci."""
    from lociweave.functions.running import running_before

    sized = parts.withColumn("size", F.col("end") - F.col("start") + 1)
    placed = running_before(sized, "start", "size", "before")
    last = parts.agg(F.max("end").alias("last"))
    fault = F.when(F.col("size") < 1, "empty").when(F.col("start") != F.col("before") + 1, "not contiguous")
    gaps = placed.select("name", fault.alias("fault")).where("fault is not null")
    return gaps.unionByName(last.where((F.col("last") != length) | F.col("last").isNull()).select(F.lit(None).cast("string").alias("name"), F.lit("does not span the matrix").alias("fault")))
