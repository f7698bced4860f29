import gzip

import pytest
from pyspark.sql import functions as F

from lociweave.functions import sequences as s
from lociweave.operators import orthogroups, report, trim
from lociweave.sinks import lines
from lociweave.sources import fasta, tables

WIDE = [("OG1", "Human_gene:1", "Mouse_gene:2", "Fish_gene:3"), ("OG2", "Human_gene:4, Human_gene:5", "Mouse_gene:4", "Fish_gene:8"), ("OG3", "Human_gene:6", None, "Fish_gene:7")]


@pytest.fixture
def members(spark):
    return orthogroups.from_wide(spark.createDataFrame(WIDE, "Orthogroup string, Human string, Mouse string, Fish string"), "Orthogroup", ["Human", "Mouse", "Fish"])


def test_orthogroups(members):
    ids = lambda df: sorted(r["orthogroup"] for r in df.collect())
    assert ids(orthogroups.occupancy(members, "single-copy", 3)) == ["OG1"]
    assert ids(orthogroups.occupancy(members, "single-copy", 2)) == ["OG1", "OG2", "OG3"]
    assert ids(orthogroups.occupancy(members, "all-copies", 3)) == ["OG1", "OG2"]
    assert ids(orthogroups.occupancy(members, "all-copies", 2, max_copies=1)) == ["OG1", "OG3"]
    assert ids(orthogroups.occupancy(members, "all-copies", 2, max_copies=1, taxa=["Mouse", "Fish"])) == ["OG1", "OG2"]
    assert [tuple(r) for r in orthogroups.id_styles(members).collect()] == [("prefixed", 9)]
    name = members.where("orthogroup = 'OG1' and taxon = 'Human'").select(orthogroups.source_gene_id(F.col("taxon"), F.col("gene"), "prefixed")).first()[0]
    assert name == "gene_1"
    back = {tuple(r) for r in orthogroups.to_wide(members, ["Human", "Mouse", "Fish"]).collect()}
    assert back == {(a, b, c or "", d) for a, b, c, d in WIDE}


def test_longest_copy(spark):
    m = spark.createDataFrame([("g", "t", "b", 6), ("g", "t", "a", 6), ("g", "t", "c", 5), ("g", "u", "x", 0)], "orthogroup string, taxon string, gene string, effective_length int")
    assert {tuple(r) for r in orthogroups.longest_copy(m).collect()} == {("g", "t", "a", 6, 3), ("g", "u", "x", 0, 1)}


def test_cell_faults(spark):
    t = spark.createDataFrame([("a", "x,,y"), ("b", "x, x"), ("c", "*")], "g string, t string")
    assert {tuple(r) for r in orthogroups.cell_faults(t, "g", ["t"]).collect()} == {("a", "t", "empty gene"), ("b", "t", "repeated gene")}


def test_group_readers(spark, tmp_path):
    def wrote(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    rows = lambda df: sorted(tuple(r) for r in df.collect())
    got = rows(tables.proteinortho(spark, wrote("a", "# Species\tGenes\tAlg.-Conn.\tHuman.faa\tMouse.fa\n2\t3\t0.5\tH1,H2\tM1\n2\t1\t1\t*\tM2\n")))
    assert got == [("POG0000001", "Human", "H1"), ("POG0000001", "Human", "H2"), ("POG0000001", "Mouse", "M1"), ("POG0000002", "Mouse", "M2")]
    assert rows(tables.sonicparanoid(spark, wrote("b", "group_id\tHuman.faa\tMouse.pep\nSP1\tH1\tM1,M2\n"))) == [("SP1", "Human", "H1"), ("SP1", "Mouse", "M1"), ("SP1", "Mouse", "M2")]
    assert rows(tables.orthomcl(spark, wrote("c", "MCL1(3 genes,2 taxa): Human|H1 Mouse|M1\n"), strip=True)) == [("MCL1(3 genes,2 taxa)", "Human", "H1"), ("MCL1(3 genes,2 taxa)", "Mouse", "M1")]
    assert rows(tables.oma(spark, wrote("d", "OMA1\tHuman|H1\tMouse|M1\n"), strip=True)) == [("OMA1", "Human", "H1"), ("OMA1", "Mouse", "M1")]
    assert rows(tables.orthofinder(spark, wrote("e", "Orthogroup\tHuman\tMouse\nOG1\tH1, H2\t\n"))) == [("OG1", "Human", "H1"), ("OG1", "Human", "H2")]
    assert rows(tables.mapping(spark, wrote("f", "#x\ty\na:1\tA\nb\tB\n"))) == [("a_1", "A"), ("b", "B")]
    parts = tables.charsets(spark, wrote("g", "begin sets;\n  charset g1 = 1-3;\n charset g2 = 4 - 9;\n"))
    assert rows(parts) == [("g1", 1, 3), ("g2", 4, 9)]
    assert tables.charset_faults(parts, 9).count() == 0 and tables.charset_faults(parts, 10).count() == 1
    assert tables.file_digests(spark, wrote("h", "abc")).first()["sha256"].startswith("ba7816bf")


def test_groups_are_counted_and_not_lines(spark, tmp_path):
    (tmp_path / "a").write_text("# Species\tGenes\tAlg.-Conn.\tHuman.faa\tMouse.fa\n# a comment\n2\t3\t0.5\tH1,H2\tM1\n\n2\t1\t1\t*\tM2\n")
    got = sorted(tuple(r) for r in tables.proteinortho(spark, str(tmp_path / "a")).collect())
    assert got == [("POG0000001", "Human", "H1"), ("POG0000001", "Human", "H2"), ("POG0000001", "Mouse", "M1"), ("POG0000002", "Mouse", "M2")]


@pytest.mark.parametrize(
    ("reader", "text"),
    [
        ("proteinortho", "# Species\tGenes\tC\tH.faa\tM.fa\n2\t3\t0.5\tH1\n"),
        ("proteinortho", "# Species\tGenes\tC\tH.faa\tH.fa\n2\t3\t0.5\tH1\tM\n"),
        ("proteinortho", "# Species\tGenes\tC\tH.faa\tM.fa\n"),
        ("sonicparanoid", "g\tH.faa\nG1\tH1\nG1\tH2\n"),
        ("sonicparanoid", "g\tH.faa\nG1\tH1,H1\n"),
        ("orthofinder", "Orthogroup\tH\nOG1\tH1,,H2\n"),
        ("orthofinder", "Group\tH\nOG1\tH1\n"),
        ("orthofinder", "Orthogroup\tH\n \tH1\n"),
        ("orthomcl", "G1: H|a b\n"),
        ("orthomcl", "G1 H|a\n"),
        ("orthomcl", "G1: H|a H|a\n"),
        ("orthomcl", "G1: H|a\nG1: M|b\n"),
        ("oma", "O1\t|a\n"),
        ("oma", "O1\n"),
        ("oma", "# nothing\n"),
    ],
)
def test_group_readers_refuse(spark, tmp_path, reader, text):
    (tmp_path / "t").write_text(text)
    with pytest.raises(ValueError):
        getattr(tables, reader)(spark, str(tmp_path / "t"))


def test_lines_of_a_file_in_pieces(spark, tmp_path):
    lines_ = [f"{'#' if k % 5 == 0 else 'x'}{k}" for k in range(3000)]
    (tmp_path / "t").write_text("\n".join(lines_))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = tables.numbered_lines(spark, str(tmp_path / "t"), ~F.startswith("value", F.lit("#"))).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(got, key=lambda r: r["line"]) == [(x, k, k - k // 5) for k, x in enumerate(lines_) if k % 5]


def test_taxon_folder_and_reports(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "Human.faa").write_text(">g:1 x\nMA\n>g2\nMM\n")
    (tmp_path / "s" / "Mouse.pep").write_text(">m1\nMC\n")
    (tmp_path / "s" / "notes.txt").write_text("nothing")
    got = tables.taxon_sequences(spark, str(tmp_path / "s"))
    assert sorted(tuple(r) for r in got.collect()) == [("Human", "g2", "MM"), ("Human", "g_1", "MA"), ("Mouse", "m1", "MC")]
    some = spark.createDataFrame([("Human", "g_1"), ("Fish", "m1")], "taxon string, gene string")
    assert [tuple(r) for r in tables.taxon_sequences(spark, str(tmp_path / "s"), some).collect()] == [("Human", "g_1", "MA")]
    (tmp_path / "s" / "Human.fa").write_text(">z\nM\n")
    with pytest.raises(ValueError, match="Human"):
        tables.taxon_sequences(spark, str(tmp_path / "s"))
    (tmp_path / "d").write_text("File\tParsimony_informative_sites\n/x/g1.mafft.codon.aln.fasta\t7\n")
    loci = spark.createDataFrame([("g1",)], "locus string")
    assert [tuple(r) for r in tables.informative_sites(spark, str(tmp_path / "d"), loci).collect()] == [("g1", 7)]
    for wrong in (loci.limit(0), spark.createDataFrame([("g1",), ("g2",)], "locus string")):
        with pytest.raises(ValueError):
            tables.informative_sites(spark, str(tmp_path / "d"), wrong)
    with pytest.raises(ValueError, match="missing columns"):
        tables.qc_details(spark, str(tmp_path / "d"), "Issues")


def test_taxa_and_limits():
    assert orthogroups.select_taxa(["a", "b", "c"], drop=["b"]) == ["a", "c"] and orthogroups.select_taxa(["a", "b", "c"], ["c", "a"]) == ["a", "c"]
    for keep, drop in ((["a", "z"], None), (["a", "b"], ["b"]), (["a"], None), (["a", "a", "b"], None)):
        with pytest.raises(ValueError):
            orthogroups.select_taxa(["a", "b", "c"], keep, drop)
    assert orthogroups.copy_limit("INF") is None and orthogroups.copy_limit("3") == 3
    for text in ("0", "-1", "x", ""):
        with pytest.raises(ValueError):
            orthogroups.copy_limit(text)


def test_path_lists(tmp_path):
    (tmp_path / "x.fasta").write_text(">a\nAC\n")
    (tmp_path / "list").write_text("# loci\nsomewhere/x.fasta\n")
    assert tables.expand_paths([str(tmp_path / "list"), str(tmp_path / "x.fasta")]) == [str(tmp_path / "x.fasta")] * 2
    (tmp_path / "list").write_text("y.fasta\n")
    with pytest.raises(FileNotFoundError):
        tables.expand_paths([str(tmp_path / "list")])


def test_sequence_files(spark, tmp_path):
    (tmp_path / "g1.mafft.codon.aln.fasta").write_text(">a one\nAC\nGT\n>b\nAC-T\n")
    with gzip.open(tmp_path / "g2.fasta.gz", "wt") as f:
        f.write(">c\nA\n")
    spark.dataSource.register(fasta.FastaDataSource)
    got = spark.read.format("lociweave-fasta").load(str(tmp_path))
    assert [tuple(r)[1:] for r in got.orderBy("file_order", "record_order").collect()] == [(0, 0, "a", "ACGT"), (0, 1, "b", "AC-T"), (1, 0, "c", "A")]
    other = fasta.records_from_files(spark, str(tmp_path))
    assert sorted(tuple(r)[1:] for r in other.collect()) == [(0, "a", "ACGT"), (0, "c", "A"), (1, "b", "AC-T")]
    keys = {r[0] for r in got.select(s.locus_key(F.col("file"))).collect()}
    assert keys == {"g1", "g2.fasta"}
    with pytest.raises(ValueError):
        list(fasta.parse(["ACGT"]))


def test_faults(records):
    r = records({1: [("a", "ACG"), ("b", "ACG")], 2: [("a", "A"), ("a", "A")], 3: [("a", ""), ("b", "")], 4: [("a", "A"), ("b", "AC")], 5: [("a", "AC")]})
    assert {tuple(x) for x in fasta.alignment_faults(r, codon=True).collect()} == {(2, "duplicate ids"), (3, "empty"), (4, "unequal lengths"), (5, "length is not divisible by three")}
    assert {x["locus"] for x in fasta.input_faults(r).collect()} == {2, 3, 5}


def test_formats(spark, records, tmp_path):
    r = records({1: [("a", "ACG" * 30), ("b b", "ACT" * 30)]})
    assert [x["line"][:12] for x in lines.phylip(r).orderBy("line_no").collect()] == ["2 90", "a  ACGACGACG", "b b  ACTACTA"]
    blocks = [x["line"] for x in lines.nexus_blocks(r).orderBy("block", "record_order").collect()]
    assert blocks[0] == "a     " + ("ACG" * 30)[:70] and blocks[3] == "'b b' " + ("ACT" * 30)[70:]
    assert lines.axt(r).first()["text"].startswith(">a|b b\nACG")
    assert [len(x) for x in lines.fasta(r, 60).orderBy("record_order").first()["text"].split("\n")] == [2, 60, 30]
    lines.write_text(lines.fasta(r), str(tmp_path / "out"), "text", "locus", "record_order")
    assert "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))).startswith(">a\nACG")
    lines.write_tsv(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "tsv"))
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "tsv"), sep="\t", header=True).collect()] == [("1", "NA")]


def test_names(spark):
    df = spark.createDataFrame([("a/gene-1.fasta",), ("1x.mafft.codon.trimmed.aln.fasta",), ("it's",)], "n string")
    got = [tuple(r) for r in df.select(s.partition_name(F.col("n")), s.nexus_label(F.col("n")), s.taxon_from_label(F.col("n")), s.safe_id(F.lit("a:b;c,(d)"))).collect()]
    assert [g[0] for g in got] == ["gene_1_fasta", "gene_1x", "it_s"] and got[2][1] == "'it''s'" and got[0][2] == "gene-1" and got[0][3] == "a_b;c__d_"


def test_rename(records, spark, seqs):
    mapping = spark.createDataFrame([("a:1", "Species_A"), ("b", "Species_B")], "original_id string, renamed_id string")
    got = seqs(trim.rename(records({1: [("a:1", "A"), ("b", "C"), ("c", "G")]}), mapping))
    assert got == {(1, "Species_A"): "A", (1, "Species_B"): "C", (1, "c"): "G"}
    both = spark.createDataFrame([("a:1", "A"), ("a_1", "B")], mapping.schema)
    assert trim.rename(records({1: [("a:1", "A"), ("b", "C")]}), both).count() == 2
    odd = trim.rename(records({1: [("a", "A"), ("b", "C"), ("c", "C"), ("d", "G")]}), spark.createDataFrame([("a", ""), ("b", "x y"), ("c", "d")], mapping.schema))
    assert {tuple(r) for r in trim.rename_faults(odd).collect()} == {(1, "", "empty id"), (1, "x y", "white space in id"), (1, "d", "duplicate id")}
    assert trim.mapping_conflicts(mapping.union(spark.createDataFrame([("b", "Other")], mapping.schema))).first()["n"] == 2


def test_audit(spark):
    rows = [("f", "t1", "internal_stop", "replace", "4-6", "NA"), ("f", "t1", "internal_stop", "replace", "4-6", "NA"), ("f", "t2", "protein_internal_stop", "replace", "NA", "3-3"), ("f", "NA", "x", "skip", "6-4", "NA")]
    e = spark.createDataFrame(rows, "input_file string, taxa_id string, event string, action string, source_nt_positions string, source_aa_positions string")
    assert tuple(report.duplicates_ignored(e).first()) == (4, 3, 1)
    got = {r["taxon"]: tuple(r)[1:] for r in report.audit_by_taxon(e).collect()}
    assert got == {"t1": (1, 1, 3, None, 0), "t2": (1, 1, None, 1, 0), "Unassigned": (1, 0, None, None, 1)}
    gate = spark.createDataFrame([(1, False, "gap_ratio;short_alignment"), (2, False, "gap_ratio;short_alignment"), (3, False, "N_ratio"), (4, True, "")], "locus long, passed boolean, reasons string")
    roll = {(r["kind"], r["name"]): r["n"] for r in report.reason_rollup(gate).collect()}
    assert roll["status", "failed"] == 3 and roll["combination", "gap_ratio + short_alignment"] == 2 and roll["multiplicity", "2"] == 2 and roll["reason", "N_ratio"] == 1
    assert tuple(report.internal_stop_hint(gate.union(spark.createDataFrame([(5, False, "a;internal_stop")], gate.schema))).first()) == (1, 5)
    moved = report.relocate(e.limit(1).withColumn("input_file", F.lit("/tmp/a/x.fasta")).unionByName(e.limit(1)), "/tmp/a/", "/data/b")
    assert sorted(r["input_file"] for r in moved.collect()) == ["/data/b/x.fasta", "f"]
    merged = report.merge_events(e.drop("source_aa_positions"), e)
    assert merged.where("source_aa_positions = 'NA'").count() == 7


def test_branches(spark):
    b = spark.createDataFrame([(x,) for x in ("codon/raw", "prot/raw", "nucl/raw", "paired/raw", "pseudogene/codon", "codon/trimmed", "")], "branch string")
    got = lambda *a: {r["branch"] for r in report.active_branches(b, *a).collect()}
    assert got("nucl") == {"nucl/raw", ""} and got("pseudogene") == {"pseudogene/codon"} and got() == {r["branch"] for r in b.collect()}
    assert got("codon") == {"codon/raw", "prot/raw", "paired/raw", "codon/trimmed", ""} and "codon/trimmed" not in got("codon", True)
    d = spark.createDataFrame([("x", "1", "codon", "gap_ratio;N_ratio", 5), ("x", "2", "codon", "", 5), ("x", "3", "codon", "NA", 1), ("x", "4", "prot", "", 9), ("x", "4", "prot", "", 9)], "branch string, locus string, seqtype string, reasons string, parsimony_informative_sites long")
    at = lambda *loci: spark.createDataFrame([("x", k) for k in loci], "branch string, locus string")
    status = {r["locus"]: (r["status"], r["reasons"]) for r in report.branch_status(d, at("2"), at("1", "3")).collect()}
    assert status == {"1": ("fail", ["N_ratio", "gap_ratio"]), "2": ("pass", []), "3": ("fail", ["failure_reason_not_recorded"]), "4": ("not_evaluated", [])}
    kept = {r["locus"]: (r["status"], r["reasons"]) for r in report.branch_status(d, at("2"), at("1"), at("2"), {"codon": 3}).collect()}
    assert kept["3"] == ("fail", ["below_independent_PIS_threshold"]) and kept["2"][0] == "pass" and kept["4"] == ("fail", ["failure_reason_not_recorded"])
    roll = {(r["kind"], r["name"]): r["n"] for r in report.branch_rollup(report.branch_status(d, at("2"), at("1", "3"))).collect()}
    assert roll["status", "fail"] == 2 and roll["combination", "N_ratio + gap_ratio"] == 1 and roll["multiplicity", "1"] == 1
    paths = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    assert tuple(report.overview(paths("a.fa", "b.fa"), paths("q/a.mafft.codon.aln.fasta", "q/a.mafft.prot.aln.fasta")).first()) == (2, 1)


def test_rna_and_keys(records, spark, seqs):
    from lociweave.operators import concat, normalize

    r = records({1: [("a", "AtUR?-")]})
    assert seqs(normalize.clean_rna(r)) == {(1, "a"): "AUUN?-"}
    assert sorted((x["event"], x["start"], x["original"], x["replacement"]) for x in normalize.rna_events(r).collect()) == [("nucleotide_ambiguity", 4, "R", "N"), ("thymine_to_uracil", 2, "t", "U")]
    assert spark.range(1).select(s.input_key(F.lit("/x/gene.1.fasta"))).first()[0].startswith("gene.1_")
    parts = spark.createDataFrame([(1, "gene-1.fasta"), (2, "gene.1.fasta"), (3, "other.fasta")], "locus long, file string")
    with pytest.raises(ValueError, match="gene_1_fasta"):
        concat.check_names(parts, s.partition_name(F.col("file")))
    concat.check_names(parts.where("locus > 1"), s.partition_name(F.col("file")))
    after = trim.filter_sequences(records({1: [("a", "ACG"), ("b", "---")], 2: [("a", "---")]}), max_gap=0.5)
    assert {tuple(x) for x in trim.filter_faults(records({1: [("a", "ACG")], 2: [("a", "---")]}), after, True).collect()} == {(1, "fewer than two sequences"), (2, "no sequences remain")}
