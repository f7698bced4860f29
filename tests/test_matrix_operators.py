import itertools
import random

import pytest
from pyspark.sql import functions as F

from lociweave.operators import codon, concat, normalize, qc, sites, trim


def test_informative_sites_policies(records):
    c, p = records({1: [("a", "GCT"), ("b", "GCT"), ("c", "GCC"), ("d", "GCC")]}), records({1: [("a", "A"), ("b", "A"), ("c", "A"), ("d", "A")]})
    sides = [sites.site_classes_qc(x, t).withColumn("passed", F.lit(True)) for x, t in ((c, "codon"), (p, "prot"))]
    assert [s.first()["parsimony_informative_sites"] for s in sides] == [1, 0]
    got = {k: qc.paired_decision(*sides, policy=k, min_codon=1, min_protein=1).first()["paired_passed"] for k in ("both", "either", "codon", "protein")}
    assert got == {"both": False, "either": True, "codon": True, "protein": False}
    with pytest.raises(ValueError):
        qc.paired_decision(*sides, policy="neither")


@pytest.mark.parametrize(("seqtype", "column", "pis"), [("prot", "AAXX", 0), ("prot", "AABB", 0), ("prot", "AALL", 1), ("nucl", "AARR", 0), ("nucl", "AANN", 0), ("nucl", "TTUU", 0), ("nucl", "AACC", 1)])
def test_resolved_states(records, seqtype, column, pis):
    r = records({1: [(str(k), ch) for k, ch in enumerate(column)]})
    assert sites.site_classes_qc(r, seqtype).first()["parsimony_informative_sites"] == pis


def test_ratios_and_patterns(records):
    s = qc.alignment_summary(records({1: [("a", "NAAGCT"), ("b", "AAAGCC")]}), "codon").first()
    assert s["n_ratio"] == 0.25
    s = qc.alignment_summary(records({1: [("a", "GCT---NNN???"), ("b", "GCTGCCGCTGCT")]}), "codon").first()
    assert (s["missing_ratio"], s["gap_ratio"], s["n_ratio"]) == (0.125, 0.125, 0.125)
    r = records({1: [("a", "UT"), ("b", "TU")]})
    assert sites.distinct_patterns(r, "nucl").first()[1] == 1 and sites.distinct_patterns(r, "prot").first()[1] == 2
    r = records({1: [("a", "ACG???"), ("b", "ACG---"), ("c", "ATGNNN"), ("d", "ATG???")]})
    assert sites.site_classes_report(r).first().asDict() == {"locus": 1, "unresolved_only": 3, "constant": 2, "variable": 1, "pis": 1, "singleton": 0}


def test_site_classes_against_definition(records):
    rng = random.Random(5)
    loci = {k: [(f"t{i}", "".join(rng.choice("ACGT-N?") for _ in range(30))) for i in range(6)] for k in range(12)}
    got = {r["locus"]: r for r in sites.site_classes_qc(records(loci)).collect()}
    for k, rows in loci.items():
        counts = [0, 0, 0, 0]
        for col in zip(*[s for _, s in rows], strict=True):
            n = sorted((col.count(x) for x in "ACGT" if x in col), reverse=True)
            counts[0 if len(n) < 2 else 1] += 1
            counts[2] += len(n) > 1 and n[1] > 1
            counts[3] += len(n) > 1 and n[1] <= 1 and 1 in n
        assert [got[k][c] for c in ("constant_sites", "variable_sites", "parsimony_informative_sites", "singleton_sites")] == counts


def test_stop_findings_skip_gaps(records):
    r = records({1: [("a", "ATG---TGAGCTTAA---"), ("b", "ATGGCTGCTGCTGCT---")]})
    got = qc.stop_findings(r).collect()
    assert [(x["seq_id"], x["terminal_stop"], x["internal_stops"]) for x in got] == [("a", "TAA", "3-TGA")]


def test_gate(records):
    r = records({1: [("a", "ATGGCT"), ("b", "ATGGCC")], 2: [("a", "AT-GCT"), ("b", "ATGGCT")], 3: [("a", "ATGTGAGCT"), ("b", "ATG---GCT")], 4: [("a", "ATG"), ("a", "ATGGCT"), ("c", "")], 5: [("a", "---"), ("b", "---")]})
    got = {x["locus"]: x["reasons"] for x in qc.qc_gate(r, qc.Gate("codon", min_length=2)).collect()}
    assert got == {1: "", 2: "frame_error", 3: "internal_stop", 4: "duplicate_ids;empty_sequence;length_mismatch;short_alignment", 5: "all_gap_columns;short_alignment"}
    with pytest.raises(ValueError):
        qc.Gate("codon", max_gap_ratio=float("nan"))


def test_equality_at_a_threshold_stays(records, seqs):
    r = records({1: [(str(k), "A-" if k == 0 else "AC") for k in range(5)]})
    assert set(seqs(trim.trim(r, "nucl")).values()) == {"A-", "AC"}
    assert set(seqs(trim.trim(r, "nucl", max_gap=0.1)).values()) == {"A"}
    assert trim.trim(records({1: [("a", "ATG"), ("b", "N--")]}), "codon", max_gap=1, max_n=0).count() == 0


def test_paired_mask(records, seqs):
    c, p = records({1: [("a", "GCNGGT"), ("b", "GCCGGA")]}), records({1: [("a", "AG"), ("b", "AG")]})
    left, right = trim.trim_pair(c, p, max_n=0, max_x=1)
    assert sorted(seqs(left).values()) == ["GGA", "GGT"] and set(seqs(right).values()) == {"G"}


def test_missing_columns_and_filters(records, seqs):
    assert trim.drop_missing_columns(records({1: [("a", "NNN"), ("b", "NNN")]}), "codon").count() == 0
    assert seqs(trim.drop_missing_columns(records({1: [("a", "AN-C"), ("b", "ANNC")], 2: [("a", "N"), ("b", "NN")]}))) == {(1, "a"): "AC", (1, "b"): "AC", (2, "a"): "N", (2, "b"): "NN"}
    kept = trim.filter_sequences(records({1: [("a", "AC--"), ("b", "ACGT"), ("c", "")]}), "nucl", max_gap=0.5)
    assert sorted(k[1] for k in seqs(kept)) == ["a", "b"]


def test_cleaning_codons(records, seqs):
    r = records({1: [("a", "atgtgagcttaa")], 2: [("a", "ATGTARGCTTAR")], 3: [("a", "ATGTANGCTGCT")], 4: [("a", "ATGG")], 5: [("a", "TAA"), ("b", "ATGGCT")]})
    got = seqs(normalize.clean_codon(r))
    assert got == {(1, "a"): "ATGNNNGCT", (2, "a"): "ATGNNNGCT", (3, "a"): "ATGTANGCTGCT".replace("TAN", "TAN"), (4, "a"): "ATG"}
    events = {(x["locus"], x["event"], x["start"], x["end"], x["original"], x["replacement"]) for x in normalize.codon_events(r).collect()}
    assert {(1, "internal_stop", 4, 6, "tga", "NNN"), (1, "terminal_stop", 10, 12, "taa", "-"), (4, "terminal_partial_codon", 4, 4, "G", "-"), (5, "terminal_stop", 1, 3, "TAA", "-")} <= events
    assert seqs(normalize.clean_codon(records({1: [("a", "atgtgagcttaa")]}), 2)) == {(1, "a"): "ATGTGAGCT"}


def test_cleaning_proteins(records, seqs):
    r = records({1: [("a", "mA*G**--"), ("b", "***"), ("c", "*--*"), ("d", "MBZJOU?X"), ("e", "")]})
    assert seqs(normalize.clean_protein(r)) == {(1, "a"): "MAXG--", (1, "d"): "MXXXXXXX"}
    events = [(x["seq_id"], x["event"], x["start"]) for x in normalize.protein_events(r).collect()]
    assert sorted(e for e in events if e[0] == "a") == [("a", "protein_internal_stop", 3), ("a", "protein_terminal_stop", 5), ("a", "protein_terminal_stop", 6)]
    assert sum(e[0] == "d" for e in events) == 6 and {e[0] for e in events if e[1] == "validation_error"} == {"b", "c", "e"}


def test_export_keeps_missing(records, seqs):
    r = records({1: [("a", "aU?rg")]})
    assert seqs(normalize.clean_export(r)) == {(1, "a"): "AT?NG"}
    assert sorted((x["start"], x["original"]) for x in normalize.export_events(r).collect()) == [(2, "U"), (4, "r")]


def test_translation_and_back(records, seqs):
    cds = records({1: [("a", "TTGGCTTAR"[:6]), ("b", "GCNAAA")]})
    assert seqs(codon.translate_cds(cds)) == {(1, "a"): "MA", (1, "b"): "AK"}
    assert seqs(codon.translate_cds(records({1: [("a", "ATGTGAGCT")]}), 27)) == {(1, "a"): "MWA"}
    aligned = records({1: [("a", "M-A"), ("b", "-AK"), ("c", "A")]})
    assert seqs(codon.back_translate(aligned, cds)) == {(1, "a"): "TTG---GCT", (1, "b"): "---GCNAAA"}
    assert [tuple(x) for x in codon.back_translation_faults(aligned, cds).collect()] == [(1, "c", "missing from CDS")]


def test_positions_and_fourfold(records, seqs):
    r = records({1: [("a", "GCTGGT"), ("b", "GCCGGA")]})
    assert seqs(codon.split_codon_positions(r), "codon_position") == {(1, "a", 1): "GG", (1, "b", 1): "GG", (1, "a", 2): "CG", (1, "b", 2): "CG", (1, "a", 3): "TT", (1, "b", 3): "CA"}
    assert seqs(codon.fourfold_sites(r)) == {(1, "a"): "TT", (1, "b"): "CA"}
    r = records({1: [("a", "AGT"), ("b", "AGC"), ("c", "???")]})
    assert seqs(codon.fourfold_sites(r, 5)) == {(1, "a"): "T", (1, "b"): "C", (1, "c"): "?"}
    assert set(seqs(codon.fourfold_sites(r, 1)).values()) == {""} == set(seqs(codon.fourfold_sites(r, 5, "require-all")).values())


def test_fourfold_against_definition(records, seqs):
    from lociweave.functions.genetic_code import fourfold_codons

    rng = random.Random(17)
    pool = ["GCT", "GCC", "GCA", "GGT", "???", "NNN", "ATG", "GC?"]
    rows = [[rng.choice(pool[:3] if rng.random() < 0.8 else pool) for _ in range(200)] for _ in range(3)]
    r = records({1: [(str(k), "".join(x)) for k, x in enumerate(rows)]})
    four = set(fourfold_codons(1))
    for policy in ("ignore-missing", "require-all"):
        keep = []
        for s, column in enumerate(zip(*rows, strict=True)):
            seen = [c for c in column if not (c == "???" and policy == "ignore-missing")]
            if len(seen) >= (2 if policy == "ignore-missing" else 1) and set(seen) <= four and len({c[:2] for c in seen}) == 1:
                keep.append(s)
        want = {(1, str(k)): "".join(x[s][2] for s in keep) for k, x in enumerate(rows)}
        assert seqs(codon.fourfold_sites(r, policy=policy)) == want


def test_4dtv(records):
    r = records({1: [("a", "ATG"), ("b", "ATG")], 2: [("a", "guggcu"), ("b", "GUGGCC")]})
    got = {x["locus"]: x for x in codon.pairwise_4dtv(r).collect()}
    assert (got[1]["sites"], got[1]["raw_4dtv"], got[1]["corrected_4dtv"]) == (0, None, None)
    assert (got[2]["sites"], got[2]["transversions"]) == (2, 0)


def test_supermatrix(records):
    r = records({1: [("sp1", "AAA"), ("sp2", "AAA"), ("sp3", "AAA")], 2: [("sp1", "CCC"), ("sp2", "CCC")]})
    pad = {x["taxon"]: x["seq"] for x in concat.rows(concat.supermatrix(r)).collect()}
    assert pad == {"sp1": "AAACCC", "sp2": "AAACCC", "sp3": "AAA???"}
    assert [tuple(x) for x in concat.missing_blocks(r).collect()] == [(2, "sp3", 4, 6, 3, "?")]
    skip = {x["taxon"]: x["seq"] for x in concat.rows(concat.supermatrix(r, "skip-gene")).collect()}
    assert skip == {f"sp{k}": "AAA" for k in (1, 2, 3)}
    status = {x["locus"]: (x["status"], x["missing"]) for x in concat.inclusion(r, "skip-gene").collect()}
    assert status == {1: ("included", []), 2: ("skipped", ["sp3"])}
    assert {x["taxon"]: tuple(x)[1:] for x in concat.coverage(r).collect()} == {"sp1": (2, 2, 0), "sp2": (2, 2, 0), "sp3": (1, 2, 3)}
    one = concat.raw_and_trimmed(concat.partitions(r), concat.partitions(r).where("locus = 2").withColumn("length", F.lit(1).cast("long"))).first()
    assert tuple(one) == (1, 1, 0, 3, 1)


def test_running_totals_cross_buckets(spark):
    from lociweave.functions.running import numbered, running_before

    df = spark.createDataFrame([(k * 3, k % 5) for k in range(40)], "o long, v long")
    got = {r["o"]: r["b"] for r in running_before(df, "o", "v", "b", bucket=7).collect()}
    total = list(itertools.accumulate([k % 5 for k in range(40)], initial=0))
    assert got == {k * 3: total[k] for k in range(40)}
    assert {r["o"]: r["i"] for r in numbered(df, "o", "i", bucket=7).collect()} == {k * 3: k for k in range(40)}
    sparse = spark.createDataFrame([((k**5) * 7_919, 1) for k in range(500)] + [(-5, 1)], "o long, v long")
    assert sorted(tuple(r) for r in numbered(sparse.select("o"), "o", "i", bucket=9).collect()) == [(-5, 0)] + [((k**5) * 7_919, k + 1) for k in range(500)]
    assert numbered(sparse.limit(0), "o", "i").count() == 0


def test_patterns_and_gate_on_odd_loci(records):
    from lociweave.operators import sites

    r = records({1: [("a", "AC-A"), ("b", "CA-A"), ("c", "AC-A")], 2: [("a", ""), ("b", "")], 3: [("x", "ACGA"), ("x", "AC!")]})
    assert {x["locus"]: x["distinct_patterns"] for x in sites.distinct_patterns(r).collect()} == {1: 4, 3: 4}
    got = {x["locus"]: x["reasons"] for x in qc.qc_gate(r, qc.Gate("nucl", min_length=4)).collect()}
    assert got[1] == "all_gap_columns" and got[2] == "empty_sequence;short_alignment" and got[3] == "duplicate_ids;invalid_characters;length_mismatch;short_alignment"
    assert codon.pair_faults(r).orderBy("locus").collect()[0]["fault"] == "not two sequences"


def test_back_translation_keeps_gaps_and_case(records, seqs):
    p, c = records({1: [("a", "-M--K-"), ("b", "MK"), ("c", "--")]}), records({1: [("a", "aTGaaaT"), ("b", "ATG"), ("c", "")]})
    assert seqs(codon.back_translate(p, c)) == {(1, "a"): "---aTG------aaa---", (1, "c"): "------"}
