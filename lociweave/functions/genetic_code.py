"""NCBI genetic codes as the standard code and what differs from it, and expressions over codons."""

from __future__ import annotations

from functools import lru_cache
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "TCAG"
#: Amino acids of the standard code, codons in the order of BASES, third base fastest.
STANDARD = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
#: Per table, codons that code for something else; "*X" both ends a sequence and codes for X.
CHANGES: dict[int, str] = {
    1: "",
    2: "AGA=* AGG=* ATA=M TGA=W",
    3: "ATA=M CTT=T CTC=T CTA=T CTG=T TGA=W",
    4: "TGA=W",
    5: "AGA=S AGG=S ATA=M TGA=W",
    6: "TAA=Q TAG=Q",
    9: "AAA=N AGA=S AGG=S TGA=W",
    10: "TGA=C",
    11: "",
    12: "CTG=S",
    13: "AGA=G AGG=G ATA=M TGA=W",
    14: "AAA=N AGA=S AGG=S TAA=Y TGA=W",
    15: "TAG=Q",
    16: "TAG=L",
    21: "TGA=W ATA=M AGA=S AGG=S AAA=N",
    22: "TCA=* TAG=L",
    23: "TTA=*",
    24: "AGA=S AGG=K TGA=W",
    25: "TGA=G",
    26: "CTG=A",
    27: "TAA=Q TAG=Q TGA=*W",
    28: "TAA=*Q TAG=*Q TGA=*W",
    29: "TAA=Y TAG=Y",
    30: "TAA=E TAG=E",
    31: "TGA=W TAA=*E TAG=*E",
    32: "TAG=W",
    33: "TAA=Y TGA=W AGA=S AGG=K",
}
#: Codons that can start a sequence; tables that aren't named start with ATG only.
STARTS: dict[int, str] = {
    1: "TTG CTG ATG",
    2: "ATT ATC ATA ATG GTG",
    3: "ATA ATG GTG",
    4: "TTA TTG CTG ATT ATC ATA ATG GTG",
    5: "TTG ATT ATC ATA ATG GTG",
    9: "ATG GTG",
    11: "TTG CTG ATT ATC ATA ATG GTG",
    12: "CTG ATG",
    13: "TTG ATA ATG GTG",
    21: "ATG GTG",
    23: "ATT ATG GTG",
    24: "TTG CTG ATG GTG",
    25: "TTG ATG GTG",
    26: "CTG ATG",
    32: "TTG CTG ATT ATC ATA ATG GTG",
    33: "TTG CTG ATG GTG",
}
#: The bases that IUPAC letters stand for.
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}


@lru_cache
def code(table: int = 1) -> tuple[dict[str, str], frozenset[str], frozenset[str]]:
    """(codon to amino acid, stop codons, start codons); codons that do both are in the first two."""
    if table not in CHANGES:
        raise ValueError(f"unknown genetic code {table}; known: {', '.join(map(str, CHANGES))}")
    values = dict(zip(map("".join, product(BASES, repeat=3)), STANDARD, strict=True))
    values |= dict(x.split("=") for x in CHANGES[table].split())
    stops = frozenset(c for c, a in values.items() if "*" in a)
    return {c: a[-1] for c, a in values.items() if a != "*"}, stops, frozenset(STARTS.get(table, "ATG").split())


@lru_cache
def stop_codons(table: int = 1, terminal: bool = False) -> tuple[str, ...]:
    """Codons, IUPAC letters included, that stand for nothing but stops; a codon that also codes counts only at the end."""
    sense, stops, _ = code(table)
    sure = {c for c in stops if terminal or c not in sense}
    return tuple(sorted(c for c in map("".join, product(IUPAC, repeat=3)) if {"".join(x) for x in product(*(IUPAC[b] for b in c))} <= sure))


@lru_cache
def translations(table: int = 1) -> dict[str, str]:
    """Codons over A, C, G, T and N to a residue: X if they could be several."""
    sense, stops, _ = code(table)
    found = {}
    for c in map("".join, product("ACGTN", repeat=3)):
        could = {sense.get(x, "*") for x in map("".join, product(*(IUPAC[b] for b in c)))}
        found[c] = could.pop() if len(could) == 1 else "X"
    return found


@lru_cache
def fourfold_codons(table: int = 1) -> tuple[str, ...]:
    """Codons whose third base doesn't matter for the amino acid."""
    sense, _, _ = code(table)
    return tuple(sorted(c for c in sense if len({sense.get(c[:2] + b) for b in BASES}) == 1))


def is_stop(codon: Column, table: int = 1, terminal: bool = False) -> Column:
    """Whether an upper-case codon, U as T, is a stop for sure."""
    return F.translate(codon, "U", "T").isin(list(stop_codons(table, terminal)))


def is_fourfold(codon: Column, table: int = 1) -> Column:
    return codon.isin(list(fourfold_codons(table)))


def residue_table(table: int = 1) -> tuple[str, str]:
    """(letters, residues): three letters as digits, from 1 by their place among letters and 0 for any other, are an index into residues.

    Upper-case codons over A, C, G, T, N have their residue; --- is -, anything else X.
    """
    letters, known = "-ACGTN", translations(table)
    return letters, "".join("-" if c == ("-", "-", "-") else known.get("".join(c), "X") for c in product("?" + letters, repeat=3))


def translate_codon(codon: Column, table: int = 1) -> Column:
    """Residue of an upper-case codon, three letters over A, C, G, T, N; --- is -, anything else X.

    The places of the three letters are digits of an index into one constant array; 0 is any other letter.
    """
    letters, residues = residue_table(table)
    a, b, c = (F.instr(F.lit(letters), F.substring(codon, k, 1)) for k in (1, 2, 3))
    return F.get(F.array(*map(F.lit, residues)), (a * 7 + b) * 7 + c)


def is_start(codon: Column, table: int = 1) -> Column:
    return codon.isin(sorted(code(table)[2]))


def is_transversion(a: Column, b: Column) -> Column:
    """Between a purine and a pyrimidine."""
    return a.isin("A", "G") != b.isin("A", "G")
