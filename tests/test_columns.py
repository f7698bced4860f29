"""Columns added up as arrays: against plain Python, over records that tasks share, of unequal lengths and beyond ASCII; and no query explodes cells."""

import os
import random
from collections import Counter, defaultdict

import pytest

import __spark_entry__
from lociweave.operators import codon, sites, trim

SF = "/root/testdata/sf0.001"


def _loci(letters, seed, unit=1):
    rng = random.Random(seed)
    draw = lambda n: "".join(rng.choice(letters) for _ in range(n * unit))
    return {k: [(f"s{i}", draw(rng.choice((7, 7, 4)) if k % 2 else 9)) for i in range(6)] for k in range(8)}


def _columns(loci, unit=1, fold=True):
    out = defaultdict(lambda: defaultdict(list))
    for locus, rows in loci.items():
        for order, (_, seq) in enumerate(rows):
            seq = seq.upper().replace("U", "T") if fold else seq.upper()
            for p in range(len(seq) // unit):
                out[locus][p].append((order, seq[p * unit : p * unit + unit]))
    return out


def test_site_profile_patterns_and_gaps(spark, records):
    loci = _loci("ACGTuacgt-?Né中", 1)
    got = {r["locus"]: r for r in sites.site_profile(records(loci).repartition(5)).collect()}
    patterns = {r["locus"]: r["distinct_patterns"] for r in sites.distinct_patterns(records(loci).repartition(5)).collect()}
    for locus, columns in _columns(loci).items():
        want = Counter()
        for cells in columns.values():
            n = Counter(c for _, c in cells if c in "ACGT")
            twice = sum(x > 1 for x in n.values())
            kind = "constant" if len(n) <= 1 else "informative" if twice > 1 else "singleton" if 1 in n.values() else "other"
            want[kind] += 1
            want["full"] += all(c == "-" for _, c in cells)
        r = got[locus]
        assert (r["constant_sites"], r["parsimony_informative_sites"], r["singleton_sites"], r["full_gap_columns"]) == tuple(want[k] for k in ("constant", "informative", "singleton", "full"))
        assert r["max_gap_ratio"] == max(sum(c == "-" for _, c in x) / len(x) for x in columns.values())
        assert patterns[locus] == len({tuple(sorted(x)) for x in columns.values()})


@pytest.mark.parametrize("letters", ["ACN-", "acN-é"])
def test_trim_of_shared_loci(spark, records, seqs, letters):
    loci = _loci(letters, 2)
    got = seqs(trim.trim(records(loci).repartition(5), "nucl", max_gap=0.4, max_n=0.3, drop_invariant=True))
    want = {}
    for locus, columns in _columns(loci, fold=False).items():
        keep = {p for p, x in columns.items() if sum(c == "-" for _, c in x) / len(x) <= 0.4 and sum(c == "N" for _, c in x) / len(x) <= 0.3 and len({c for _, c in x}) > 1}
        want |= {(locus, name): "".join(c for p, c in enumerate(seq) if p in keep) for name, seq in loci[locus] if keep}
    assert got == want


def test_fourfold_of_shared_loci(spark, records, seqs):
    rng = random.Random(4)
    draw = lambda n: "".join(rng.choice(("GCA", "GCC", "GCT", "gcu", "???", "GGA")) if rng.random() < 0.97 else "AAA" for _ in range(n))
    loci = {k: [(f"s{i}", draw(12 if k else 12 - i)) for i in range(3)] for k in range(6)}
    for policy, least in (("ignore-missing", 2), ("require-all", 1)):
        got = seqs(codon.fourfold_sites(records(loci).repartition(5), policy=policy))
        for locus, columns in _columns(loci, 3).items():
            keep = set()
            for p, x in columns.items():
                counted = [c for _, c in x if policy == "require-all" or c != "???"]
                if len(counted) >= least and len({c[:2] for c in counted}) == 1 and counted[0][:2] in ("GC", "GG"):
                    keep.add(p)
            for name, seq in loci[locus]:
                seq = seq.upper().replace("U", "T")
                assert got[locus, name] == "".join(seq[3 * p + 2] for p in range(len(seq) // 3) if p in keep)


def test_paired_mask_of_shared_loci(spark, records, seqs):
    codons = {1: [("a", "AAACC-NNN"), ("b", "AAACCCAAA")], 2: [("é", "AAATTT")]}
    residues = {1: [("a", "K--"), ("b", "XXK")], 2: [("é", "中K")]}
    left, right = trim.trim_pair(records(codons).repartition(3), records(residues).repartition(3), max_gap=0, max_n=0.5, max_x=0.5)
    assert seqs(left) == {(1, "a"): "AAA", (1, "b"): "AAA", (2, "é"): "AAATTT"}
    assert seqs(right) == {(1, "a"): "K", (1, "b"): "X", (2, "é"): "中K"}


EXPLODED = (
    "trim_paired_mask", "fourfold_sites_require_all", "fourfold_sites", "qc_details_report", "paired_pis_policy", "paired_report", "trim_invariant", "raw_vs_trimmed",
    "site_classes_qc_protein", "qc_gate", "distinct_patterns",
)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", EXPLODED)
def test_no_cell_is_a_row(spark, name):
    plan = __spark_entry__.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan


IN_THE_ROW = ("frame_findings", "frameshift_edits", "frameshift_mask", "translate_cds", "back_translate", "pairwise_4dtv", "preprocess_codon_events", "change_report")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", IN_THE_ROW)
def test_no_triplet_is_a_row_or_a_text_of_its_own(spark, name):
    plan = __spark_entry__.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert not any(x in plan for x in ("explode", "lambda"))


def test_events_of_odd_letters(spark, records):
    """Beyond ASCII, of unequal lengths and with partial triplets: the same findings as of plain triplets."""
    before, after = records({1: [("a", "---AAéTGA!CC---ac")], 2: [("é", "")]}), records({1: [("a", "---NNNTGACCC")], 2: [("é", "")]})
    rows = lambda df: [tuple(r)[3:] for r in df.collect()]
    from lociweave.operators import frameshift, normalize

    assert rows(frameshift.frame_findings(before)) == [("internal_stop", 7, 9, "TGA"), ("external_frameshift", 10, 12, "!CC")]
    assert [r[0] for r in rows(frameshift.masked(before))] == ["---AAÉNNNNNN---", ""]
    assert sorted(rows(frameshift.triplet_edits(before, after)), key=lambda r: r[1]) == [
        ("export_change", 4, 6, "AAÉ", "NNN", "replace"), ("external_frameshift", 10, 12, "!CC", "CCC", "replace"), ("export_change", 13, 15, "---", None, "replace")
    ]
    found = rows(normalize.codon_events(records({1: [("a", "taaRéucc")], 2: [("b", "TAG")], 3: [("c", "")]})))
    assert sorted(map(str, found)) == sorted(map(str, [
        ("internal_stop", 1, 3, "taa", "NNN", "replace"), ("nucleotide_ambiguity", 4, 4, "R", "N", "replace"), ("uracil_to_thymine", 6, 6, "u", "T", "replace"),
        ("terminal_partial_codon", 7, 8, "cc", "-", "delete"), ("terminal_stop", 1, 3, "TAG", "-", "delete"), ("validation_error", None, None, "NA", "NA", "skip"),
        ("validation_error", None, None, "NA", "NA", "reject"),
    ]))
