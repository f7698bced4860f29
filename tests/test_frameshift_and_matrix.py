from pyspark.sql import functions as F

from lociweave.operators import concat, frameshift, matrix, trim
from lociweave.sources import tables


def _events(df):
    return sorted((r["seq_id"], r["event"], r["start"], r["original"]) for r in df.collect())


def test_frame_findings(records):
    r = records({1: [("a", "---A!GTGAGCT!CATAA---"), ("b", "---ATGTGAG!TGCATGA---"), ("c", "-" * 21), ("d", "ATGTG?---GCTTAN---AT-"), ("e", "")]})
    assert _events(frameshift.frame_findings(r)) == [
        ("a", "external_frameshift", 4, "A!G"), ("a", "internal_frameshift", 13, "!CA"), ("a", "internal_stop", 7, "TGA"), ("a", "terminal_stop", 16, "TAA"),
        ("b", "internal_frameshift", 10, "G!T"), ("b", "internal_stop", 7, "TGA"), ("b", "terminal_stop", 16, "TGA"),
    ]
    # in table 28 TAA and TGA are stops at the end only
    assert [e for _, e, _, _ in _events(frameshift.frame_findings(r.where("seq_id = 'b'"), 28))] == ["internal_frameshift", "terminal_stop"]


def test_masked_keeps_columns(records, seqs):
    r = records({1: [("a", "---A!GTGAGCTRUA---"), ("b", "aug---uga"), ("c", "------"), ("d", "TAA"), ("e", "")]})
    assert seqs(frameshift.masked(r)) == {(1, "a"): "---NNNNNNGCTNTA---", (1, "b"): "ATG---NNN", (1, "c"): "------", (1, "d"): "NNN", (1, "e"): ""}


def test_triplet_edits(records):
    before = records({1: [("a", "A!GGCTRAACATAA"), ("b", "GCT---")]})
    after = frameshift.masked(before)
    assert _events(frameshift.triplet_edits(before, after)) == [("a", "export_change", 7, "RAA"), ("a", "external_frameshift", 1, "A!G")]
    shorter = before.withColumn("seq", F.expr("left(seq, 3)"))
    assert ("b", "export_change", 4, "---") in _events(frameshift.triplet_edits(before, shorter))


def test_masked_pair(records, seqs):
    c, p = records({1: [("a", "GCTGGTAAA"), ("b", "GCTGGTAAA")]}), records({1: [("a", "a*k"), ("b", "AGJ")]})
    codon, protein = frameshift.masked_pair(c, p)
    assert seqs(codon) == {(1, "a"): "GCTNNNAAA", (1, "b"): "GCTGGTNNN"} and seqs(protein) == {(1, "a"): "AXK", (1, "b"): "AGX"}


def test_content_faults(records):
    source = records({1: [("a", "ACGT"), ("b", "ACG"), ("c", "A")]})
    aligned = records({1: [("a", "ac!-GT"), ("b", "A-TG"), ("d", "A")]})
    assert sorted(map(tuple, frameshift.content_faults(aligned, source).collect())) == [(1, "b", "changed"), (1, "c", "missing"), (1, "d", "unexpected")]


def test_transferred_columns(spark, records, seqs, tmp_path):
    c, p = records({1: [("a", "ATGGCTAAA"), ("b", "ATG---AAA")], 2: [("a", "ATG")]}), records({1: [("a", "MAK"), ("b", "M-K")], 2: [("a", "M")]})
    keep = spark.createDataFrame([(1, 3), (1, 1), (1, 1)], "locus long, pos int")
    assert seqs(trim.transfer_columns(c, keep, "codon")) == {(1, "a"): "ATGAAA", (1, "b"): "ATGAAA"}
    assert seqs(trim.transfer_columns(p, keep, "prot")) == {(1, "a"): "MK", (1, "b"): "MK"}
    assert sorted(map(tuple, trim.column_map_faults(keep, p).collect())) == [(1, "column twice"), (2, "no columns")]
    odd = spark.createDataFrame([(1, 4), (2, 0), (3, 1)], "locus long, pos int")
    assert sorted(map(tuple, trim.column_map_faults(odd, p).collect())) == [(1, "out of range"), (2, "out of range"), (3, "unknown locus")]
    (tmp_path / "map.txt").write_text("other\n#ColumnsMap\t0, 2, 5,\n")
    assert sorted(r["pos"] for r in tables.columns_map(spark, str(tmp_path / "map.txt")).collect()) == [1, 3, 6]


def test_matrix_statistics(records):
    r = records({1: [("a", "ACG"), ("b", "ACG"), ("c", "ATG"), ("d", "ATG")], 2: [("b", "---"), ("c", "NNN"), ("d", "???")]})
    row = matrix.matrix_statistics(r, seqtype="codon").first().asDict()
    want = dict(taxa=4, loci=2, length=6, cells=24, complete_codons=2, gap_characters=3, missing_characters=6, ambiguous_characters=3, gap_ratio=0.125, missing_ratio=0.25, gc_ratio=0.5)
    assert {k: row[k] for k in want} == want
    assert [row[k] for k in matrix.CLASSES] == [3, 2, 1, 1, 0]
    one = matrix.matrix_statistics(r, "skip-gene").first()
    assert (one["loci"], one["length"], one["missing_characters"], one["complete_codons"]) == (1, 3, 0, None)
    odd = matrix.matrix_statistics(records({1: [("a", "ANNX-?"), ("b", "ANNX-?")]}), seqtype="prot").first()
    assert (odd["constant"], odd["unresolved_only"], odd["ambiguous_characters"], odd["gc_ratio"]) == (3, 3, 2, None)
    none = matrix.matrix_statistics(r.limit(0)).first()
    assert (none["taxa"], none["cells"], none["gap_ratio"]) == (0, 0, None)


def test_matrix_metadata(spark, records):
    r = records({1: [("a", "AC"), ("b", "AC")], 2: [("a", "G")]})
    status, parts, blocks, names = concat.inclusion(r), concat.partitions(r), concat.missing_blocks(r), concat.taxa(r)
    assert {tuple(x) for x in matrix.inclusion_counts(status).collect()} == {("included", 1), ("padded", 1)}
    assert matrix.padding_faults(blocks, parts, names).isEmpty() and matrix.inclusion_faults(status, parts).isEmpty()
    more = spark.createDataFrame([(2, "a", 3, 4, 2, "?"), (1, "a", 1, 2, 2, "x"), (1, "z", 1, 2, 2, "?"), (9, "a", 1, 2, 2, "?")], blocks.schema)
    got = {(x["locus"], x["taxon"]): x["fault"] for x in matrix.padding_faults(blocks.union(blocks).union(more), parts, names).collect()}
    assert got == {(2, "b"): "twice", (2, "a"): "coordinates", (1, "a"): "fill character", (1, "z"): "unknown taxon", (9, "a"): "unknown locus"}
    assert {tuple(x) for x in matrix.inclusion_faults(status, parts.where("locus = 1")).collect()} == {(2, "no partition")}
