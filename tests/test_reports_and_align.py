import json
import shutil

from pyspark.sql import functions as F

from lociweave.operators import concat, qc, report
from lociweave.plans.align import align, command
from lociweave.sinks import reports


def test_reports(records):
    r = records({1: [("a", "ACGT"), ("b", "ACGA")], 2: [("a", "A"), ("b", "AC")]})
    path = F.concat(F.lit("/x/"), F.col("locus"), F.lit(".fasta"))
    gate = qc.qc_gate(r)
    good, bad, details = reports.qc_reports(gate, path)
    assert [x[0] for x in good.collect()] == ["/x/1.fasta"] and [x[0] for x in bad.collect()] == ["/x/2.fasta"]
    assert {x["File"]: x["Issues"] for x in details.collect()}["/x/2.fasta"] == "length_mismatch;short_alignment"
    r = records({1: [("a", "AC"), ("b", "AC")], 2: [("a", "G")]})
    lines = {x["gene"]: tuple(x)[1:] for x in reports.inclusion_report(concat.inclusion(r), path).collect()}
    assert lines == {"/x/1.fasta": ("included", ""), "/x/2.fasta": ("padded", "missing taxa: b")}
    assert reports.iqtree_tail(concat.partitions(r), F.concat(F.lit("g"), "locus")).first()[0] == "    charpartition my_genes = :g1, g2;\nend;"
    doc = {x["section"]: json.loads(x["json"]) for x in reports.document(rollup=report.reason_rollup(gate)).collect()}
    assert {"kind": "status", "name": "failed", "n": 1} in doc["rollup"]
    page = reports.html_page("<T>", {"a & b": gate.select("locus", F.lit(None).alias("x"))})
    assert "&lt;T&gt;" in page and "Unavailable" in page


def test_orthogroup_set(spark):
    m = spark.createDataFrame([("g", "t", "a", "ACGT", 4), ("g", "t", "b", "ANNT", 2), ("g", "u", "c", "AC", 2)], "orthogroup string, taxon string, gene string, seq string, effective_length int")
    text, names, selection = reports.orthogroup_set(m)
    assert sorted(x["text"] for x in text.collect()) == [">t_a taxon=t orthogroup=g\nACGT", ">u_c taxon=u orthogroup=g\nAC"]
    assert sorted(map(tuple, names.collect())) == [("t_a", "t"), ("u_c", "u")] and selection.where("selected").count() == 2


def test_changed_files(spark):
    now = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "path string, size long, sha256 string")
    assert [x["path"] for x in reports.changed_files(now.where("path = 'a'"), now).collect()] == ["b"]


def test_align(records):
    r = records({1: [("a", "AC"), ("b", "ACG")], 2: [("a", "AC")]})

    def pad(source, target):
        text = open(source).read().splitlines()
        width = max(len(x) for x in text[1::2])
        open(target, "w").write("\n".join(x if x.startswith(">") else x.ljust(width, "-") for x in text))

    assert {(x["locus"], x["seq_id"]): x["seq"] for x in align(r, pad).collect()} == {(1, "a"): "AC-", (1, "b"): "ACG", (2, "a"): "AC"}
    assert {x["fault"] for x in align(r, shutil.copyfile).collect()} == {None, "unequal lengths"}
    assert all("not installed" in x["fault"] for x in align(r, command("mafft-that-is-not-here")).collect())
