import pytest

from lociweave.functions import genetic_code as gc


@pytest.mark.parametrize("table", list(gc.CHANGES))
def test_tables_are_whole(table):
    sense, stops, starts = gc.code(table)
    assert len(set(sense) | stops) == 64
    assert all(len(c) == 3 for c in starts) and set(sense.values()) <= set("ACDEFGHIKLMNPQRSTVWY")
    assert len(gc.translations(table)) == 125


@pytest.mark.parametrize(
    ("codon", "table", "stop"),
    [("TAR", 1, True), ("TRA", 1, True), ("TAN", 1, False), ("TRR", 1, False), ("NNN", 1, False), ("---", 1, False), ("TGA", 2, False), ("AGR", 2, True), ("AGR", 1, False), ("TAR", 6, False)],
)
def test_definite_stops(codon, table, stop):
    assert (codon in gc.stop_codons(table)) == stop


@pytest.mark.parametrize(("table", "codon"), [(27, "TGA"), (28, "TAA"), (28, "TGA"), (31, "TAA")])
def test_dual_coding_counts_only_at_the_end(table, codon):
    assert codon not in gc.stop_codons(table) and codon in gc.stop_codons(table, terminal=True)


def test_fourfold_and_translation():
    assert len(gc.fourfold_codons(1)) == 32 and "AGT" not in gc.fourfold_codons(1) and "AGT" in gc.fourfold_codons(5)
    assert gc.translations(1)["GCN"] == "A" and gc.translations(1)["NNN"] == "X" and gc.translations(1)["TAN"] == "X"


def test_unknown_table():
    with pytest.raises(ValueError):
        gc.code(7)
